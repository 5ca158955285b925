"""Vendor logs and exports over small files."""

import json

from lodestream.sources import vendor


def lines(tmp_path, name, rows):
    (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(tmp_path / name)


def test_metrics(spark, tmp_path):
    path = lines(tmp_path, "m.json", [{"name": "snmp", "tags": {"agent_host": "s"}, "fields": {"sysUpTime": 9, "up": True}, "timestamp": 5}, {"name": "lldp"}])
    got = vendor.read_metrics(spark, path).orderBy("seq").collect()
    assert (got[0].fields, got[0].timestamp, got[1].tags) == ({"sysUpTime": "9", "up": "true"}, 5, None)


def test_leases(spark, tmp_path):
    head = "2024-01-01 00:00:0{}.250 INFO  [kea-dhcp4.leases/1.2] "
    text = head.format(0) + "DHCP4_LEASE_ALLOC [hwtype=1 aa:bb:cc:dd:ee:ff], cid=[no info], tid=0x1: lease 10.0.0.5 has been allocated for 3600 seconds\n"
    text += head.format(1) + "DHCP4_RELEASE [hwtype=1 aa:bb:cc:dd:ee:ff], cid=[no info], tid=0x2: address 10.0.0.5 was released properly.\n" + head.format(2) + "DHCP4_OTHER x\njunk\n"
    (tmp_path / "k.log").write_text(text)
    got = [tuple(r) for r in vendor.read_leases(spark, str(tmp_path / "k.log")).orderBy("seq").drop("seq").collect()]
    assert got == [(1704067200250000000, "DHCP4_LEASE_ALLOC", "aa:bb:cc:dd:ee:ff", "10.0.0.5", 3600), (1704067201250000000, "DHCP4_RELEASE", "aa:bb:cc:dd:ee:ff", "10.0.0.5", None)]


def test_host_interfaces(spark, tmp_path):
    rows = [{"action": "snapshot", "unixTime": 1, "hostIdentifier": "h", "snapshot": [{"interface": "e0", "mac": "m0"}, {"interface": "e1"}]}, {"action": "added", "unixTime": 2, "hostIdentifier": "h", "columns": {"interface": "e2", "mac": "m2"}}, {"action": "removed", "unixTime": 3, "hostIdentifier": "h", "columns": {"interface": "e2"}}]
    got = sorted((r.unixTime, r.interface, r.mac) for r in vendor.read_host_interfaces(spark, lines(tmp_path, "o.log", rows)).collect())
    assert got == [(1, "e0", "m0"), (1, "e1", None), (2, "e2", "m2")]


def test_access_records(spark, tmp_path):
    (tmp_path / "d").write_text('Mon Jan  1 00:00:00 2024\n\tPacket-Type = Access-Request\n\tUser-Name = "a\\"b\\\\c"\n\tTimestamp = 17\n\nMon Jan  1 00:00:01 2024\n\tPacket-Type = Access-Accept\n\tTimestamp = 17\n\n')
    got = [tuple(r) for r in vendor.read_access_records(spark, str(tmp_path / "d"), ["Packet-Type", "User-Name", "Timestamp"]).orderBy("seq").drop("seq").collect()]
    assert got == [("Access-Request", 'a"b\\c', "17"), ("Access-Accept", None, "17")]


def test_exports_and_audits(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"result": [{"sys_id": "1"}, {"sys_id": "2"}]}))
    assert sorted(r.sys_id for r in vendor.read_export(spark, str(tmp_path / "r.json"), "result", "result array<struct<sys_id string>>").collect()) == ["1", "2"]
    path = lines(tmp_path, "a.json", [{"properties": {"result": "success"}}, {"result": "failure"}])
    assert [r.result for r in vendor.read_audit_properties(spark, path, "result string").orderBy("seq").collect()] == ["success", "failure"]


def test_audit_log_of_lines_or_of_one_array(spark, tmp_path):
    rows = [{"Operation": "FileAccessed", "UserId": "a", "extra": 1}, {"Operation": "Login"}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    for name, array in (("lines.json", False), ("array.json", True)):
        got = vendor.read_objects(spark, str(tmp_path / name), "Operation string, UserId string", array)
        assert [(r.Operation, r.UserId) for r in got.orderBy("seq").collect()] == [("FileAccessed", "a"), ("Login", None)]
