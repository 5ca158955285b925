"""Joins and folds of raw feeds over small fixtures."""

import json

from pyspark.sql import functions as F

from lodestream.operators import feeds

METRIC = "name string, tags map<string,string>, fields map<string,string>, timestamp long, seq long"


def out(df, *columns):
    return [tuple(r) for r in df.orderBy("seq").select(*columns).collect()]


def test_latest_crosses_slices_and_spreads_rows_without_a_key(spark):
    facts = spark.createDataFrame([("a", 5, "x"), ("a", 3 * feeds.SLICE, None), ("b", 1, "y"), (None, 1, "z")], "k string, seq long, v string")
    rows = spark.createDataFrame([("a", 4), ("a", 5), ("a", 2 * feeds.SLICE), ("a", 3 * feeds.SLICE + 1), ("c", 9), (None, 10)], "k string, seq long")
    assert out(feeds.latest(rows, F.col("k"), facts, F.col("k"), F.col("v"), "w"), "w") == [(None,), ("x",), (None,), (None,), ("x",), (None,)]


def test_polls(spark):
    tags = {"agent_host": "s1", "ifIndex": "7", "ifName": "Gi1"}
    rows = [("snmp", {"agent_host": "s1"}, {"sysUpTime": "99"}, 1, 1), ("interface", tags, {"ifInErrors": "3"}, 1, 2), ("transceiver", tags, {"rx": "-3"}, 1, 3), ("lldp", tags, {"peer": "s2"}, 1, 4)]
    rows += [("interface", tags, {"ifInErrors": "4"}, 2, 5), ("bgp_peer", {"agent_host": "s1"}, {"bgpPeerState": "6"}, 1, 6), ("bgp_peer", {"agent_host": "s1"}, {"bgpPeerState": "3"}, 1, 7), ("snmp", {"agent_host": "s2"}, None, 1, 8)]
    df = spark.createDataFrame(rows, METRIC)
    assert out(feeds.port_polls(df, ["ifName", "sysUpTime", "ifInErrors", "rx", "peer"]), "timestamp", "ifName", "sysUpTime", "ifInErrors", "rx", "peer") == [(1, "Gi1", "99", "3", "-3", "s2"), (2, "Gi1", None, "4", None, None)]
    assert out(feeds.device_polls(df, ["sysUpTime"]), "sysUpTime", "bgp_established") == [("99", 1), (None, 0)]
    assert feeds.port_polls(df.limit(0), ["rx"]).count() == feeds.device_polls(df.limit(0), ["rx"]).count() == 0


def test_forwarding_ports(spark):
    entry = ({"agent_host": "s1", "sysName": "sw", "sysLocation": "hq", "index": "10.0.17.34.51.68.255"}, {"dot1qTpFdbPort": "3"})
    message = "01" + "000b" + "aabbccddeeff" + "0003"
    rows = [("fdb", *entry, 1, 1), ("ifXTable", {"agent_host": "s1", "ifIndex": "30"}, {"ifName": "Gi3"}, 1, 2), ("bridge_port", {"agent_host": "s1", "index": "3"}, {"dot1dBasePortIfIndex": "30"}, 1, 3), ("fdb", *entry, 2, 4)]
    rows += [("snmp_trap", {"source": "s1", "name": "cmnMacChangedNotification"}, {"cmnHistMacChangedMsg": message}, 3, 5), ("snmp_trap", {"source": "s9", "name": "cmnMacChangedNotification"}, {"cmnHistMacChangedMsg": "05" + message[2:]}, 3, 6), ("snmp_trap", {"source": "s1", "name": "other"}, {}, 3, 7)]
    got = out(feeds.forwarding_ports(spark.createDataFrame(rows, METRIC)), "sysName", "sysLocation", "ifName", "vlan", "mac", "operation")
    mac = "00:11:22:33:44:ff"
    assert got == [("sw", "hq", None, 10, mac, None), ("sw", "hq", "Gi3", 10, mac, None), ("sw", "hq", "Gi3", 11, "aa:bb:cc:dd:ee:ff", "added"), (None, None, None, 11, "aa:bb:cc:dd:ee:ff", "5")]


def test_access_steps(spark):
    rows = [("Access-Request", "u", "t1", "0x0201000901", "p1", 1), ("Access-Request", "u", "t1", "0x020200090d", "p2", 2), ("Access-Challenge", "u", "t1", None, None, 3), ("Access-Accept", "u", "t1", None, None, 4), ("Access-Reject", "w", "t2", None, None, 5)]
    df = spark.createDataFrame(rows, "`Packet-Type` string, `User-Name` string, Timestamp string, `EAP-Message` string, port string, seq long")
    assert out(feeds.access_steps(df), "`User-Name`", "port", "Timestamp", "outcome") == [("u", "p1", "t1", None), ("u", "p2", "t1", "success"), (None, None, "t2", "failure")]


def test_flows_and_signatures(spark):
    conn = spark.createDataFrame([("c1", 1), ("c2", 2), (None, 3)], "uid string, seq long")
    ssl = spark.createDataFrame([("c1", 2, "late"), ("c1", 1, None), (None, 3, "n")], "uid string, seq long, server_name string")
    assert out(feeds.service_flows(conn, ssl), "uid", "server_name", "ja4") == [("c1", None, None)]
    rows = [(1, "g", "a.exe", None, None, 1), (7, "g", None, "a.exe", "Valid", 2), (7, "g", None, "a.exe", "Expired", 3), (1, "h", "a.exe", None, None, 4)]
    events = spark.createDataFrame(rows, "EventID int, ProcessGuid string, Image string, ImageLoaded string, SignatureStatus string, seq long")
    assert out(feeds.image_signatures(events), "ProcessGuid", "SignatureStatus") == [("g", "Expired"), ("h", None)]


def test_item_versions(spark):
    rows = [(1, "srv", "d1", "c1", "name", "web", "t1"), (2, "srv", "d1", "c1", "assigned_to", "u1", "t1"), (3, "srv", "d2", "c1", "name", "db", "t2"), (4, "srv", "d1", "c2", "name", None, "t3"), (5, "other", "d9", "c1", "name", "x", "t3"), (6, "srv", "d1", "c3", "install_status", "7", "t4")]
    audit = spark.createDataFrame(rows, "seq long, tablename string, documentkey string, record_checkpoint string, fieldname string, newvalue string, sys_created_on string")
    users, groups = spark.createDataFrame([("u1", "u@x")], "sys_id string, email string"), spark.createDataFrame([], "sys_id string, name string")
    got = out(feeds.item_versions(audit, users, groups, ["srv"], ["name", "assigned_to", "support_group", "install_status"]), "documentkey", "name", "assigned_to", "recorded_at", "retracted")
    assert got == [("d1", "web", "u@x", "t1", False), ("d2", "db", None, "t2", False), ("d1", None, "u@x", "t3", False), ("d1", None, "u@x", "t4", True)]


def test_network_versions(spark):
    o = json.dumps
    rows = [
        (1, "dcim.site", 1, "create", "t1", None, o({"slug": "hq"})), (2, "tenancy.tenant", 4, "create", "t1", None, o({"slug": "ops"})), (3, "dcim.devicerole", 2, "create", "t1", None, o({"slug": "access"})),
        (4, "dcim.device", 9, "create", "t2", None, o({"name": "sw1", "site": 1, "role": 2, "tenant": 4, "custom_fields": {"criticality": "high"}})),
        (5, "dcim.interface", 5, "create", "t3", None, o({"name": "Gi1", "device": 9, "description": "uplink", "custom_fields": None})),
        (6, "dcim.site", 1, "update", "t4", None, o({"slug": "hq2"})), (7, "ipam.vlan", 6, "delete", "t5", o({"name": "voice", "vid": 20, "site": 1}), None),
    ]
    changes = spark.createDataFrame(rows, "seq long, kind string, id long, action string, time string, before string, after string")
    got = out(feeds.network_versions(changes), "object_kind", "site", "device", "port", "vid", "designation", "role", "tenant", "criticality", "retracted")
    assert got == [("device", "hq", "sw1", None, None, None, "access", "ops", "high", False), ("port", "hq", "sw1", "Gi1", None, "uplink", None, "ops", None, False), ("vlan", "hq2", None, None, 20, "voice", None, None, None, True)]


def test_identity_changes(spark):
    columns = "Worker_Email string, Supervisory_Organization string, Manager_Email string, Worker_Type string, Worker_Status string, Account_Type string, Privilege_Level string, Effective_Moment string, Entry_Moment string, Business_Process_Type string, seq long"
    workers = spark.createDataFrame([("a@x", "it", "m@x", "Contingent Worker", "Active", "", "Admin", "e", "2024-01-02T00:00:00Z", "End Contingent Worker Contract", 1), ("b@x", None, None, None, "Terminated", None, None, None, None, None, 2)], columns)
    user = [("User", "a@x", [("Group.DisplayName", None, '"fin\\"ance"')])]
    audit = spark.createDataFrame([("Add member to group", "success", "2024-01-02T00:00:00Z", user, 1), ("Remove member from group", "failure", "2024-01-01T00:00:00Z", user, 2)], "activityDisplayName string, result string, activityDateTime string, targetResources array<struct<type string, userPrincipalName string, modifiedProperties array<struct<displayName string, oldValue string, newValue string>>>>, seq long")
    got = [(r.user_principal, r.employment_status, r.account_type, r.group_name, r.retracted) for r in feeds.identity_changes(workers, audit).collect()]
    assert got == [("a@x", "contractor", None, None, True), ("a@x", None, None, 'fin"ance', False), ("b@x", "terminated", None, None, False)]


def test_collector_profile(spark):
    got = feeds.collector_profile(spark.range(2).withColumnRenamed("id", "seq"), "c", "1", "t", "ntp", first_seq=10)
    assert out(got, "collector_id", "collector_seq") == [("c", 10), ("c", 11)]
