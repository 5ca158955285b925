"""Joins and folds that turn raw feeds into one row an observation or one row a version.

Feeds carry ``seq``, their order in the file or log. Polled metrics have name, tags and fields (maps of text), timestamp
and seq. What a lookup knows is what its feed said up to the row's own seq, never later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.identity import SEPARATOR, compose_key

#: Fixed values of the protocols and vendors.
BGP_ESTABLISHED = "6"
MAC_OPERATIONS = {1: "added", 2: "removed"}
RADIUS_OUTCOMES = {"Access-Accept": "success", "Access-Reject": "failure"}
RETIRED = "7"
NETWORK_KINDS = {"dcim.device": "device", "ipam.vlan": "vlan", "dcim.interface": "port"}
ENDED_CONTRACT = "End Contingent Worker Contract"
GROUP_CHANGES = {"Add member to group": False, "Remove member from group": True}

#: Rows of a key between two of these marks of seq are one group, so that a hot key is many groups.
SLICE = 1 << 20


def latest(rows: DataFrame, key: Column, facts: DataFrame, fact_key: Column, value: Column, name: str, slice_width: int = SLICE) -> DataFrame:
    """rows with ``name``: the value of the last fact of the row's key with a seq up to its own; null without one.

    Both are cut into slices of seq, a slice starts with the last fact of those before it, and the running last value
    is taken within (key, slice). Only one row a key and slice passes through a window over the key alone. Rows without
    a key are spread by their seq.
    """
    aside = {c: f"_c{i}" for i, c in enumerate(rows.columns)}  # each by itself, so that those which nothing reads afterwards are in no shuffle
    place = F.floor(F.col("seq") / slice_width).alias("_s")
    known = facts.select(fact_key.alias("_k"), F.col("seq").alias("_at"), place, F.struct(value.alias("v")).alias("_v")).where(F.col("_k").isNotNull())
    own = rows.select(key.alias("_k"), F.col("seq").alias("_at"), place, *(F.col(c).alias(a) for c, a in aside.items()))
    ends = known.groupBy("_k", "_s").agg(F.max_by("_v", "_at").alias("_end"))
    ends = ends.unionByName(own.where("_k IS NOT NULL").select("_k", "_s").distinct(), allowMissingColumns=True).groupBy("_k", "_s").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col("_k").cast("string").alias("_k"), "_s", F.last("_end", ignorenulls=True).over(before).alias("_start")).where("_start IS NOT NULL")
    both = known.withColumn("_is", F.lit(False)).unionByName(own.withColumn("_is", F.lit(True)), allowMissingColumns=True).withColumn("_k", F.coalesce(F.col("_k").cast("string"), F.concat(F.lit("\0"), F.col("_at").cast("string"))))
    # a fact counts for the row of the same seq
    upto = Window.partitionBy("_k", "_s").orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(upto)).where("_is")
    out = out.join(starts, ["_k", "_s"], "left")
    return out.select(*(F.col(a).alias(c) for c, a in aside.items()), F.coalesce("_last", "_start")["v"].alias(name))


def _key(*parts: Column) -> Column:
    return compose_key(*(p.cast("string") for p in parts), sep=SEPARATOR)


def _tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def _field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def port_polls(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """A row an ``interface`` record: timestamp, seq and the columns asked for, from the record's fields, its port's
    ``transceiver`` and ``lldp`` records of the same poll, the poll's ``snmp`` scalar sysUpTime, and its tags. The later of
    several such records holds. One shuffle on the poll serves every lookup."""
    poll = Window.partitionBy("_agent", "timestamp")
    port = Window.partitionBy("_agent", "timestamp", "_port")
    of = lambda kind, w: F.max_by(F.when(F.col("name") == kind, F.col("fields")), F.when(F.col("name") == kind, F.col("seq"))).over(w)
    own = metrics.where(F.col("name").isin("interface", "transceiver", "lldp", "snmp")).withColumns({"_agent": _tag("agent_host"), "_port": _tag("ifIndex")})
    own = own.withColumns({"_up": of("snmp", poll), "_optic": of("transceiver", port), "_peer": of("lldp", port)}).where(F.col("name") == "interface")

    def value(name: str) -> Column:
        found = [F.try_element_at(m, F.lit(name)) for m in ("_peer", "_optic", "fields")]
        return F.coalesce(*found, *([F.try_element_at("_up", F.lit(name))] if name == "sysUpTime" else []), _tag(name)).alias(name)

    return own.select("timestamp", "seq", *map(value, columns))


def device_polls(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """A row an ``snmp`` record: timestamp, seq, the columns asked for from its fields and tags, and bgp_established, the
    number of the poll's ``bgp_peer`` records that are up."""
    up = (F.col("name") == "bgp_peer") & (_field("bgpPeerState") == BGP_ESTABLISHED)
    own = metrics.where(F.col("name").isin("snmp", "bgp_peer")).withColumn("_agent", _tag("agent_host"))
    own = own.withColumn("bgp_established", F.count_if(F.coalesce(up, F.lit(False))).over(Window.partitionBy("_agent", "timestamp"))).where(F.col("name") == "snmp")
    return own.select("timestamp", "seq", *(F.coalesce(_field(c), _tag(c)).alias(c) for c in columns), "bgp_established")


def _mac(digits: Column) -> Column:
    """Twelve hex digits as a hardware address."""
    return F.rtrim(F.regexp_replace(F.lower(digits), "(..)", "$1:"), F.lit(":"))


def forwarding_ports(metrics: DataFrame) -> DataFrame:
    """A row a forwarding-table entry and a row an address notification: timestamp, seq, sysName, sysLocation, ifName, vlan,
    mac and operation (null for an entry). The bridge port is named through the last ``bridge_port`` and ``ifXTable`` records
    before the row; a notification's device is named by the last entry of its agent."""
    entry = (F.col("name") == "fdb").alias("_entry")
    trap = (F.col("name") == "snmp_trap") & (_tag("name") == "cmnMacChangedNotification")
    index = F.split(_tag("index"), r"\.")
    octets = F.array_join(F.transform(F.slice(index, 2, 6), lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0")), "")
    message = _field("cmnHistMacChangedMsg")
    number = lambda c: F.conv(c, 16, 10).cast("int")
    kind = number(F.substring(message, 1, 2))
    operation = F.coalesce(*(F.when(kind == k, v) for k, v in MAC_OPERATIONS.items()), kind.cast("string"))
    rows = metrics.where((F.col("name") == "fdb") | trap).select(
        "timestamp", "seq", entry, F.when(F.col("name") == "fdb", _tag("agent_host")).otherwise(_tag("source")).alias("_agent"),
        F.when(F.col("name") == "fdb", _field("dot1qTpFdbPort").cast("int")).otherwise(number(F.substring(message, 19, 4))).alias("_bridge"),
        F.when(F.col("name") == "fdb", F.get(index, F.lit(0)).cast("int")).otherwise(number(F.substring(message, 3, 4))).alias("vlan"),
        F.when(F.col("name") == "fdb", _mac(octets)).otherwise(_mac(F.substring(message, 7, 12))).alias("mac"),
        F.when(F.col("name") != "fdb", operation).alias("operation"), F.struct(_tag("sysName").alias("n"), _tag("sysLocation").alias("l")).alias("_own"),
    )
    bridges = metrics.where(F.col("name") == "bridge_port")
    rows = latest(rows, _key(F.col("_agent"), F.col("_bridge")), bridges, _key(_tag("agent_host"), _tag("index").cast("int")), _field("dot1dBasePortIfIndex").cast("int"), "_if")
    names = metrics.where(F.col("name") == "ifXTable")
    rows = latest(rows, _key(F.col("_agent"), F.col("_if")), names, _key(_tag("agent_host"), _tag("ifIndex").cast("int")), _field("ifName"), "ifName")
    # entries name their device themselves, so only notifications look it up
    rows = latest(rows, F.when(~F.col("_entry"), F.col("_agent")), metrics.where(F.col("name") == "fdb"), _tag("agent_host"), F.struct(_tag("sysName").alias("n"), _tag("sysLocation").alias("l")), "_last")
    who = F.when(F.col("_entry"), F.col("_own")).otherwise(F.col("_last"))
    return rows.select("timestamp", "seq", who["n"].alias("sysName"), who["l"].alias("sysLocation"), "ifName", "vlan", "mac", "operation")


def access_steps(entries: DataFrame, kind: str = "Packet-Type", user: str = "User-Name", time: str = "Timestamp", message: str = "EAP-Message") -> DataFrame:
    """The steps of access exchanges: requests that carry the identity (outcome null), and accepts and rejects with the
    columns of the last request before them of the same user and time. Rounds in between are no steps."""
    k, eap = F.col(f"`{kind}`"), F.col(f"`{message}`")
    request = k == "Access-Request"
    whole = [F.col(f"`{c}`") for c in entries.columns]
    key = lambda: F.concat_ws(SEPARATOR, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in (user, time)))
    start = entries.where(request & eap.startswith("0x") & (F.substring(eap, 3, 2) == "02") & (F.substring(eap, 11, 2) == "01"))
    ends = latest(entries.where(k.isin(*RADIUS_OUTCOMES)), key(), entries.where(request), key(), F.struct(*whole), "_request")
    outcome = F.coalesce(*(F.when(k == name, said) for name, said in RADIUS_OUTCOMES.items())).alias("outcome")
    own = {"seq", time}
    ends = ends.select(*(F.col(f"`{c}`") if c in own else F.col(f"_request.`{c}`").alias(c) for c in entries.columns), outcome)
    return start.withColumn("outcome", F.lit(None).cast("string")).unionByName(ends)


def service_flows(conn: DataFrame, ssl: DataFrame, uid: str = "uid", columns: tuple[str, ...] = ("server_name", "ja4")) -> DataFrame:
    """Connections that have a handshake, with columns of the first handshake of their uid."""
    first = ssl.groupBy(uid).agg(F.min_by(F.struct(*(F.col(c) if c in ssl.columns else F.lit(None).cast("string").alias(c) for c in columns)), "seq").alias("_h"))
    kept = [F.col(c) for c in conn.columns if c not in columns]
    return conn.join(first, uid).select(*kept, *(F.col(f"_h.{c}").alias(c) for c in columns))


def image_signatures(events: DataFrame) -> DataFrame:
    """Process starts (event 1) with the SignatureStatus of the image load (event 7) of their own process and image; the last
    of several loads holds, null without one."""
    loads = events.where("EventID = 7").groupBy("ProcessGuid", F.col("ImageLoaded").alias("Image")).agg(F.max_by(F.struct("SignatureStatus"), "seq").alias("_s"))
    starts = events.where("EventID = 1").drop("SignatureStatus", "ImageLoaded")
    return starts.join(loads, ["ProcessGuid", "Image"], "left").select(*starts.columns, F.col("_s.SignatureStatus").alias("SignatureStatus"))


def item_versions(audit: DataFrame, users: DataFrame, groups: DataFrame, tables: list[str], fields: list[str]) -> DataFrame:
    """A row a version of an item: consecutive audit rows of an item that share a checkpoint are one update, and the version
    is the last value of each field after it.

    audit: seq, tablename, documentkey, record_checkpoint, fieldname, newvalue, sys_created_on; users: sys_id, email; groups:
    sys_id, name. assigned_to and support_group are shown by email and name. A version that retires the item is retracted.
    """
    order = Window.partitionBy("documentkey").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    own = audit.where(F.col("tablename").isin(tables))
    last = {f"_f_{f}": F.last(F.when(F.col("fieldname") == f, F.struct("newvalue")), ignorenulls=True).over(upto) for f in fields}
    fresh = ~F.coalesce(F.col("record_checkpoint").eqNullSafe(F.lag("record_checkpoint").over(order)) & F.lag("seq").over(order).isNotNull(), F.lit(False))
    retired = F.coalesce((F.col("fieldname") == "install_status") & (F.col("newvalue") == RETIRED), F.lit(False))
    own = own.withColumns(last | {"_fresh": fresh.cast("long")}).withColumn("_run", F.sum("_fresh").over(upto))
    state = F.struct(*(F.col(f"_f_{f}.newvalue").alias(f) for f in fields))
    first = lambda c: F.min_by(c, "seq").alias(c)
    out = own.groupBy("documentkey", "_run").agg(first("tablename"), F.min_by("sys_created_on", "seq").alias("recorded_at"), F.max_by(state, "seq").alias("_state"), F.bool_or(retired).alias("retracted"), F.min("seq").alias("seq"))
    out = out.select("seq", "documentkey", "tablename", *(F.col(f"_state.{f}").alias(f) for f in fields), "recorded_at", "retracted")
    for name, side, shown in (("assigned_to", users, "email"), ("support_group", groups, "name")):
        if name in fields:
            names = side.groupBy(F.col("sys_id").alias(name)).agg(F.max(shown).alias("_shown"))
            out = out.join(names, name, "left").withColumn(name, F.col("_shown")).drop("_shown")
    null = F.lit(None).cast("string")
    return out.select("seq", "documentkey", "tablename", *fields, "recorded_at", "retracted", null.alias("valid_from"), null.alias("valid_to"))


def network_versions(changes: DataFrame) -> DataFrame:
    """A row a change of a device, a VLAN or an interface, with what it refers to by name as of that change.

    changes: seq, kind, id, action, time, before and after (objects as JSON text). Sites, roles and tenants are named by
    their slugs, an interface's device by its name; an interface's site and tenant are its device's.
    """
    at = lambda c, path: F.get_json_object(c, f"$.{path}")
    gone = F.col("action") == "delete"
    every = changes.select("seq", "kind", F.col("id").cast("string").alias("id"), "time", gone.alias("retracted"), F.when(gone, F.col("before")).otherwise(F.col("after")).alias("data"))
    own = every.where(F.col("kind").isin(*NETWORK_KINDS))

    def named(rows: DataFrame, kind: str, wanted: Column, name: str, part: str | None = "slug") -> DataFrame:
        facts = every.where(F.col("kind") == kind)
        return latest(rows, wanted, facts, F.col("id"), at("data", part) if part else F.col("data"), name)

    port, vlan, device = (F.col("kind") == k for k in ("dcim.interface", "ipam.vlan", "dcim.device"))
    own = named(own, "dcim.device", F.when(port, at("data", "device")), "_device", None)
    own = own.withColumn("_device", F.when(port, F.col("_device")).otherwise(F.col("data")))
    own = named(own, "dcim.site", at("_device", "site"), "site")
    own = named(own, "dcim.devicerole", F.when(device, at("data", "role")), "role")
    own = named(own, "tenancy.tenant", at("_device", "tenant"), "tenant")
    what = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in NETWORK_KINDS.items()))
    null = F.lit(None).cast("string")
    return own.select(
        "seq", what.alias("object_kind"), "site", F.when(~vlan, at("_device", "name")).alias("device"), F.when(port, at("data", "name")).alias("port"), at("data", "vid").cast("int").alias("vid"),
        at("data", "custom_fields.commissioning_rx_dbm").cast("double").alias("commissioning_rx_dbm"), F.when(port, at("data", "description")).when(vlan, at("data", "name")).alias("designation"), "role", "tenant",
        at("data", "custom_fields.owning_team").alias("owning_team"), at("data", "custom_fields.criticality").alias("criticality"), F.col("time").alias("recorded_at"), "retracted", null.alias("valid_from"), null.alias("valid_to"),
    )


def identity_changes(workers: DataFrame, audit: DataFrame) -> DataFrame:
    """Changes to principals of the personnel system and of the directory's groups as one stream by the time of entry, at one
    moment the personnel system's first; changes without a time come last.

    workers: the report's columns; audit: activityDisplayName, result, activityDateTime and targetResources (array of structs
    with type, userPrincipalName and modifiedProperties of displayName, oldValue, newValue). Both carry seq.
    """
    text = lambda c: F.when(F.lower(c) != "", F.lower(c))
    null = F.lit(None).cast("string")
    status = text(F.col("Worker_Status"))
    hr = workers.select(
        F.col("Worker_Email").alias("user_principal"), F.col("Supervisory_Organization").alias("department"), F.col("Manager_Email").alias("manager"),
        F.when(status == "terminated", "terminated").when(F.col("Worker_Type") == "Contingent Worker", "contractor").otherwise(status).alias("employment_status"),
        text(F.col("Account_Type")).alias("account_type"), text(F.col("Privilege_Level")).alias("privilege_level"), null.alias("group_name"), F.col("Effective_Moment").alias("valid_from"), null.alias("valid_to"),
        F.col("Entry_Moment").alias("recorded_at"), F.coalesce(F.col("Business_Process_Type") == ENDED_CONTRACT, F.lit(False)).alias("retracted"), F.lit(0).alias("_source"), "seq",
    )
    user = F.get(F.filter("targetResources", lambda r: r["type"] == "User"), F.lit(0))
    group = F.get(F.filter(user["modifiedProperties"], lambda p: p["displayName"] == "Group.DisplayName"), F.lit(0))
    retract = F.coalesce(*(F.when(F.col("activityDisplayName") == k, F.lit(v)) for k, v in GROUP_CHANGES.items()))
    quoted = F.when(retract, group["oldValue"]).otherwise(group["newValue"])
    name = F.get_json_object(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "$.v")
    own = audit.where(F.col("activityDisplayName").isin(*GROUP_CHANGES) & (F.col("result") == "success"))
    ad = own.select(user["userPrincipalName"].alias("user_principal"), *(null.alias(c) for c in ("department", "manager", "employment_status", "account_type", "privilege_level")), name.alias("group_name"), null.alias("valid_from"), null.alias("valid_to"), F.col("activityDateTime").alias("recorded_at"), retract.alias("retracted"), F.lit(1).alias("_source"), "seq")
    entered = F.try_to_timestamp("recorded_at")
    return hr.unionByName(ad).orderBy(entered.asc_nulls_last(), "_source", "seq").drop("_source", "seq")


def collector_profile(df: DataFrame, collector_id: str, schema_version: str, tenant_id: str, clock_source: str, clock_offset_ms: float = 0.0, sampling_policy: str = "none", first_seq: int = 0) -> DataFrame:
    """df with what a collector says of itself in every row, and collector_seq, which counts on from first_seq by seq."""
    constants = {"collector_id": collector_id, "schema_version": schema_version, "tenant_id": tenant_id, "clock_source": clock_source, "clock_offset_ms": clock_offset_ms, "sampling_policy": sampling_policy}
    return df.withColumns({k: F.lit(v) for k, v in constants.items()} | {"collector_seq": F.col("seq") + first_seq})
