"""Telemetry stages, layer by layer: frame in, the same rows and some columns more.

A stage names the columns it reads and composes trackers over them. Frames carry an event time ``t`` (long, nanoseconds)
and a tie breaker ``seq``. Rows without the stage's key stay, get nulls and touch no state. All state is a window
partitioned by the key, so a stage costs one shuffle a key and rows of no key are spread by their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import network, text
from lodestream.functions.identity import compose_key, event_uid, mac_oui, normalize_hostname, normalize_text, render
from lodestream.operators import intervals, trackers
from lodestream.operators.trackers import DAY, HOUR, MINUTE, SECOND

Args = dict[str, str | Column]


def track(df: DataFrame, keys: list[str], tracker: Callable[[DataFrame], DataFrame], args: Args, outputs: dict[str, str]) -> DataFrame:
    """df with outputs of a tracker over the key: its arguments are named by ``args``, its results renamed by ``outputs``.

    The row's columns travel under numbers, so that none of them meets a tracker's names; each by itself, so that those which nothing reads
    afterwards are in no shuffle.
    """
    key = compose_key(*(F.col(k).cast("string") for k in keys))
    own = [(v if isinstance(v, Column) else F.col(v)).alias(n) for n, v in args.items()]
    kept = [c for c in df.columns if c not in outputs.values()]
    aside = {c: c if c in ("t", "seq") else f"_carried_{k}" for k, c in enumerate(kept)}  # no tracker changes t or seq
    work = df.select(F.coalesce(key, F.concat(F.lit("\0"), F.col("seq").cast("string"))).alias("entity"), key.isNotNull().alias("_known"), "t", "seq", *own, *(F.col(c).alias(a) for c, a in aside.items() if a != c))
    out = tracker(work)
    return out.select(*[F.col(a).alias(c) for c, a in aside.items()], *[F.when(F.col("_known"), F.col(o)).alias(n) for o, n in outputs.items()])


def distinct(df: DataFrame, keys: list[str], value: str, name: str, window_ns: int = HOUR) -> DataFrame:
    """name and name_first_in_window: different values of the key in the window."""
    return track(df, keys, lambda d: trackers.distinct_window(d, "v", window_ns), {"v": value}, {"distinct_n": name, "first_in_window": f"{name}_first_in_window"})


def novelty(df: DataFrame, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    """_changed, _first_seen and _distinct of a value."""
    name = name or value
    return track(df, keys, lambda d: trackers.value_novelty(d, "v"), {"v": value}, {"changed": f"{name}_changed", "first_seen": f"{name}_first_seen", "distinct_so_far": f"{name}_distinct"})


def baseline(df: DataFrame, keys: list[str], value: str, bucket_ns: int = HOUR, window_ns: int = 30 * DAY, min_buckets: int = 24) -> DataFrame:
    """A value against the key's own busiest bucket: _baseline_max, _baseline_buckets, _baseline_mature, _step and _ratio."""
    outputs = {"peak_reference": f"{value}_baseline_max", "peak_buckets": f"{value}_baseline_buckets", "peak_mature": f"{value}_baseline_mature", "peak_step": f"{value}_step"}
    out = track(df, keys, lambda d: trackers.bucket_peak(d, "v", bucket_ns, window_ns, min_buckets), {"v": value}, outputs)
    return out.withColumn(f"{value}_ratio", F.when(F.col(f"{value}_baseline_max") != 0, F.col(value) / F.col(f"{value}_baseline_max")))


# context


def versions(df: DataFrame, kind: str, key: Column, values: list[str]) -> DataFrame:
    """Bitemporal versions of records: kind, entity, valid_from, valid_to, recorded_at, change, values and a content uid.
    Records without a key or without recorded_at are left out."""
    change = F.coalesce(F.lower("change"), F.lit("assert")) if "change" in df.columns else F.lit("assert")
    out = df.select(F.lit(kind).alias("kind"), key.alias("entity"), "valid_from", "valid_to", "recorded_at", change.alias("change"), *values)
    out = out.where("entity IS NOT NULL AND recorded_at IS NOT NULL")
    return out.withColumn("uid", event_uid(*(render(F.col(c)) for c in ("kind", "entity", "valid_from", "valid_to", "recorded_at", "change", *values))))


def tc0_identity(df: DataFrame, principal: str = "principal", values: tuple[str, ...] = ("department",), group: str | None = None) -> DataFrame:
    """Profiles by principal; with a group column, one version a membership."""
    return versions(df, "group" if group else "profile", normalize_text(F.col(principal)), [group] if group else list(values))


def tc0_asset(df: DataFrame, host: str = "hostname", values: tuple[str, ...] = ("owner", "criticality")) -> DataFrame:
    return versions(df, "asset", normalize_hostname(F.col(host)), list(values))


def tc0_application(df: DataFrame, address: str = "server_address", port: str = "server_port", values: tuple[str, ...] = ("application",)) -> DataFrame:
    return versions(df, "application", compose_key(F.col(address), F.col(port).cast("string")), list(values))


def tc0_network(df: DataFrame, keys: dict[str, tuple[str, ...]], kind: str = "object_kind", values: tuple[str, ...] = ("name",)) -> DataFrame:
    """Ports, devices and VLANs, each keyed its own way."""
    parts = [versions(df.where(F.col(kind) == k), k, compose_key(*(F.col(c).cast("string") for c in own)), list(values)) for k, own in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# layer 1


def tc1_normalize(df: DataFrame, keys: list[str], counters: list[str], bits: int = 64, neighbor: tuple[str, str] | None = None, uptime_ns: str | None = None, tied: bool = False) -> DataFrame:
    """entity_key, interval_seconds, <counter>_delta, counter_reset and counter_wrapped of each port's polls, and link_key. Polls of one instant are out
    of order, or may be tied."""
    out = df.withColumn("entity_key", compose_key(*(F.col(k).cast("string") for k in keys)))

    def between(d: DataFrame) -> DataFrame:
        """The interval and all deltas by one track, so that they are against the same poll."""
        out = d.withColumn("s", (F.col("t") - F.lag("t").over(Window.partitionBy("entity").orderBy("t", "seq"))) / F.lit(float(SECOND)))
        return trackers.counter_deltas(out, own, bits, "up" if uptime_ns else None, tied) if own else out

    own = [f"v{k}" for k in range(len(counters))]
    args: Args = dict(zip(own, counters, strict=True)) | ({"up": uptime_ns} if uptime_ns else {})
    outputs = {"s": "interval_seconds"}
    for v, c in zip(own, counters, strict=True):
        outputs |= {f"{v}_delta": f"{c}_delta", f"{v}_reset": f"_{c}_reset", f"{v}_wrapped": f"_{c}_wrapped"}
    out = track(out, ["entity_key"], between, args, outputs)
    either = lambda kind: F.greatest(*[F.col(f"_{c}_{kind}") for c in counters]) if len(counters) > 1 else F.col(f"_{counters[0]}_{kind}")
    if counters:
        out = out.withColumns({"counter_reset": either("reset"), "counter_wrapped": either("wrapped")}).drop(*[f"_{c}_{k}" for c in counters for k in ("reset", "wrapped")])
    if neighbor:
        from lodestream.functions.identity import compose_link_key

        out = out.withColumn("link_key", compose_link_key(F.col("entity_key"), F.col(neighbor[0]), F.col(neighbor[1])))
    return out


def tc1_rate(df: DataFrame, key: str = "entity_key", errors: str = "errors_delta", octets: str = "octets_delta", speed_bps: str | None = None, bucket_ns: int = 5 * MINUTE, window_ns: int = 14 * DAY, min_buckets: int = 36, discards: tuple[str, ...] = ()) -> DataFrame:
    """error_rate and bits_per_second, utilisation, discard_rate (of what is known of the deltas), and both against the port's own peaks: traffic by hour of the day."""
    per = F.when(F.col("interval_seconds") > 0, F.col("interval_seconds"))
    out = df.withColumns({"error_rate": F.col(errors) / per, "bits_per_second": 8 * F.col(octets) / per, "_hour": F.pmod(F.floor(F.col("t") / HOUR), F.lit(24))})
    if discards:
        told = F.greatest(*(F.col(c).isNotNull() for c in discards), F.lit(False))
        out = out.withColumn("discard_rate", F.when(told, sum((F.coalesce(F.col(c), F.lit(0)) for c in discards), F.lit(0))) / per)
    if speed_bps:
        out = out.withColumn("utilisation", F.when(F.col(speed_bps) > 0, F.col("bits_per_second") / F.col(speed_bps)))
    out = baseline(out, [key], "error_rate", bucket_ns, window_ns, min_buckets)
    return baseline(out, [key, "_hour"], "bits_per_second", bucket_ns, window_ns, min_buckets).drop("_hour")


def tc1_change(df: DataFrame, key: str = "entity_key", columns: tuple[str, ...] = ("transceiver_serial", "neighbor")) -> DataFrame:
    for c in columns:
        df = novelty(df, [key], c)
    return df


def tc1_device(df: DataFrame, key: str = "device_key", uptime: str = "uptime", config: str = "config_hash", routes: str = "route_count", in_window: Column | None = None, min_buckets: int = 7) -> DataFrame:
    """device_rebooted (the uptime fell), reboots of the day so far and against the device's peaks, config_changed and
    whether that was in the change window, route_delta."""
    before = Window.partitionBy("entity").orderBy("t", "seq")
    out = track(df, [key], lambda d: d.withColumns({"b": F.coalesce(F.col("u") < F.lag("u").over(before), F.lit(False)), "d": F.col("r") - F.lag("r").over(before)}), {"u": uptime, "r": routes}, {"b": "device_rebooted", "d": "route_delta"})
    out = out.withColumn("_day", F.floor(F.col("t") / DAY).cast("long"))
    upto = Window.partitionBy("entity").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = track(out, [key, "_day"], lambda d: d.withColumn("n", F.sum(F.col("b").cast("long")).over(upto)), {"b": "device_rebooted"}, {"n": "device_reboots_in_bucket"}).drop("_day")
    out = baseline(out, [key], "device_reboots_in_bucket", DAY, 30 * DAY, min_buckets)
    out = novelty(out, [key], config, "config")
    window = F.coalesce(in_window, F.lit(False)) if in_window is not None else F.lit(None).cast("boolean")
    return out.withColumn("config_change_in_window", F.when(F.col("config_changed"), window))


def tc1_flap(df: DataFrame, key: str = "entity_key", status: str = "oper_status", last_change: str = "last_change", window_ns: int = HOUR, tied: bool = False) -> DataFrame:
    return track(df, [key], lambda d: trackers.link_flap(d, "s", "c", window_ns, tied), {"s": status, "c": last_change}, {"flaps": "link_flaps", "flaps_in_window": "link_flaps_in_window"})


def tc1_optical(df: DataFrame, key: str = "entity_key", channels: tuple[str, ...] = ("optical_tx_dbm", "optical_rx_dbm"), window_ns: int = 6 * HOUR, min_samples: int = 5) -> DataFrame:
    for c in channels:
        df = track(df, [key], lambda d: trackers.rolling_median(d, "v", window_ns, min_samples), {"v": c}, {"baseline": f"{c}_baseline", "deviation": f"{c}_deviation", "baseline_n": f"{c}_baseline_samples"})
    return df


def tc1_forecast(df: DataFrame, key: str = "entity_key", channel: str = "optical_rx_dbm", floor_dbm: float | Column | None = -14.0, window_ns: int = 7 * DAY, min_samples: int = 12, optic: str | None = None) -> DataFrame:
    """Where a port's level is heading; with an optic, its readings start anew when that changes."""
    outputs = {"slope_per_day": f"{channel}_trend_db_per_day", "residual_rms": f"{channel}_residual", "days_to_floor": f"{channel}_days_to_floor", "forecast_status": f"{channel}_forecast_status"}
    args: Args = {"v": channel, "f": floor_dbm if isinstance(floor_dbm, Column) else F.lit(floor_dbm).cast("double")} | ({"o": optic} if optic else {})
    return track(df, [key], lambda d: trackers.level_forecast(d, "v", F.col("f"), window_ns, min_samples, optic="o" if optic else None), args, outputs)


def binding_intervals(df: DataFrame, key: str, attributes: list[str], idle_ns: int = 7 * DAY, grant: str | None = None) -> DataFrame:
    """Which attributes a key was bound to, from when to when: ports to optics (TC1), addresses to ports (TC2)."""
    own = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("entity"), "t", "seq", *attributes, *([grant] if grant else []))
    return intervals.close_bindings(own, attributes, idle_ns, grant)


# layer 2


def tc2_cardinality(df: DataFrame, mac: str = "mac", port: str = "port_key", vlan: str = "vlan", window_ns: int = HOUR) -> DataFrame:
    """macs_per_port, ports_per_mac and ouis_per_vlan in the window, and the vendor's novelty on the port."""
    out = df.withColumn("mac_oui", mac_oui(F.col(mac)))
    out = distinct(distinct(out, [port], mac, "macs_per_port", window_ns), [mac], port, "ports_per_mac", window_ns)
    return novelty(distinct(out, [vlan], "mac_oui", "ouis_per_vlan", window_ns), [port], "mac_oui")


def tc2_baseline(df: DataFrame, key: str = "port_key", value: str = "macs_per_port", min_buckets: int = 24) -> DataFrame:
    return baseline(df, [key], value, HOUR, 30 * DAY, min_buckets)


def tc2_arp(df: DataFrame, sender_ip: str = "src_ip", sender_mac: str = "mac", target_ip: str = "dst_ip", window_ns: int = 5 * MINUTE, min_denominator: int = 10, excluded: tuple[str, ...] = ()) -> DataFrame:
    """arp_gratuitous, its ratio a sender, and how many MACs claim the sender's address."""
    out = df.withColumns({"arp_gratuitous": F.col(sender_ip) == F.col(target_ip), "arp_sender_ip_excluded": F.col(sender_ip).isin(*excluded) if excluded else F.lit(False)})
    out = track(out, [sender_mac], lambda d: trackers.ratio_window(d, F.col("g"), window_ns, min_denominator), {"g": "arp_gratuitous"}, {"ratio": "arp_gratuitous_ratio"})
    return distinct(out, [sender_ip], sender_mac, "macs_claiming_sender_ip", window_ns)


#: Results of an exchange that goes on, and of sign-ins and second factors that succeed.
PENDING = ("started", "start", "in-progress", "in_progress", "pending", "request")
SUCCESSES = ("success", "succeeded", "allow", "allowed", "0")
APPROVALS = ("success", "succeeded", "approved", "approve", "allow", "allowed", "accept")


def _timed(pairs: DataFrame, key: str, name: str, window_ns: int, min_samples: int) -> DataFrame:
    """Of paired rows the elapsed time against the key's own: _p99 of those before (null below min_samples), _ratio and _samples."""
    known = pairs.withColumn("_known", F.when(F.col("outcome") == "paired", F.col("elapsed_ns") / F.lit(float(SECOND))))
    out = track(known, [key], lambda d: trackers.transfer_envelope(d, "v", window_ns, 0.99, 1.0, min_samples), {"v": "_known"}, {"envelope": f"{name}_p99", "envelope_ratio": f"{name}_ratio", "samples": f"{name}_samples"})
    return out.withColumnRenamed("_known", f"{name}_seconds")


def tc2_auth(df: DataFrame, key: str = "port_key", result: str = "result", pending: tuple[str, ...] = PENDING, timeout_ns: int = 5 * MINUTE, supplicants: tuple[str, ...] = (), window_ns: int = 30 * DAY, min_samples: int = 100) -> DataFrame:
    """One row a finished 802.1X exchange of a port, or of the first of the supplicants that is known on it: attempts, the time since it
    began, and that time against the port's own exchanges. A row without a result begins one, as does a pending result."""
    r = F.lower(normalize_text(F.col(result)))
    who = F.coalesce(*(normalize_text(F.col(c).cast("string")) for c in supplicants)) if supplicants else F.lit(None).cast("string")
    port = F.col(key).cast("string")
    own = df.where(F.col(key).isNotNull()).select(F.coalesce(compose_key(port, who), port).alias("entity"), port.alias("auth_port_key"), "t", "seq", r.alias("r"))
    starts = F.coalesce(F.col("r").isin(*pending), F.lit(True))
    return _timed(intervals.pair_sessions(own, starts, ~starts, timeout_ns, ("auth_port_key",)), "auth_port_key", "auth_elapsed", window_ns, min_samples)


# layer 3


def tc3_cardinality(df: DataFrame, src: str = "src_ip", dst: str = "dst_ip", port: str = "dst_port", window_ns: int = HOUR) -> DataFrame:
    out = distinct(distinct(df, [src], dst, "dsts_per_src", window_ns), [dst], src, "srcs_per_dst", window_ns)
    return distinct(out, [src], port, "dst_ports_per_src", window_ns)


def tc3_reach(df: DataFrame, src: str = "src_ip", dst: str = "dst_ip", asn: str = "asn", bytes_out: str = "bytes_out", bytes_in: str = "bytes_in", window_ns: int = HOUR, min_denominator: int = 10, management: tuple[str, ...] = ()) -> DataFrame:
    """Where traffic goes: dst_is_private, _reserved, _multicast, _management, internal_dst_ratio, byte_asymmetry, and the
    network's novelty for the source."""
    d = F.col(dst)
    managed = F.lit(False)
    for block in management:
        managed = managed | network.in_block(d, block)
    out = df.withColumns({"dst_is_private": network.is_private(d), "dst_is_reserved": network.is_reserved(d), "dst_is_multicast": network.is_multicast(d), "dst_is_management": managed, "byte_asymmetry": F.col(bytes_out) / (F.col(bytes_in) + 1)})
    out = track(out, [src], lambda x: trackers.ratio_window(x, F.col("p"), window_ns, min_denominator), {"p": "dst_is_private"}, {"ratio": "internal_dst_ratio"})
    return novelty(out, [src], asn, "dst_asn")


def tc3_beacon(df: DataFrame, src: str = "src_ip", dst: str = "dst_ip", size: str = "bytes_out", window_ns: int = DAY, min_intervals: int = 12) -> DataFrame:
    """Regularity of a pair's flows: intervals, their mean, and the variation of times and sizes."""
    outputs = {"intervals_n": "flow_intervals", "mean_interval": "flow_mean_interval_s", "interval_cv": "flow_interval_cv", "size_cv": "flow_size_cv"}
    return track(df, [src, dst], lambda d: trackers.arrival_regularity(d, window_ns, min_intervals, "b"), {"b": size}, outputs)


def tc3_ttl(df: DataFrame, keys: tuple[str, ...] = ("src_ip", "dst_ip"), ttl: str = "ip_ttl", window_ns: int = DAY, min_samples: int = 5, min_shift: int = 2) -> DataFrame:
    out = track(df, list(keys), lambda d: trackers.value_history(d, "v", window_ns, min_samples), {"v": ttl}, {"established": "ip_ttl_established", "history_n": "ip_ttl_samples"})
    shift = F.col(ttl) - F.col("ip_ttl_established")
    return out.withColumns({"ip_ttl_shift": shift, "ip_ttl_shifted": F.abs(shift) >= min_shift, "ip_ttl_mature": F.col("ip_ttl_established").isNotNull()})


def tc3_baseline(df: DataFrame, src: str = "src_ip", dst: str = "dst_ip", min_buckets: int = 24) -> DataFrame:
    out = baseline(df, [src], "dsts_per_src", HOUR, 14 * DAY, min_buckets)
    return baseline(baseline(out, [dst], "srcs_per_dst", HOUR, 14 * DAY, min_buckets), [src], "byte_asymmetry", HOUR, 14 * DAY, min_buckets)


# layer 4

FLAGS = tuple(name for name, _ in network.TCP_FLAGS)


def tc4_flow(df: DataFrame, keys: tuple[str, ...] = ("src_ip", "src_port", "dst_ip", "dst_port"), flags: str = "tcp_flags", length: str = "data_len", bin_ns: int = MINUTE) -> DataFrame:
    """A flow's running rollup within its minute: packets, flag counts, bytes, bytes a packet, packets a minute, and the
    shares of flags."""
    out = df.withColumns({"flow_id": compose_key(*(F.col(k).cast("string") for k in keys)), "rollup_time": (F.floor(F.col("t") / bin_ns) * bin_ns).cast("long")})
    bits = network.tcp_flags(F.col(flags))
    upto = Window.partitionBy("entity").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    args: Args = {"len": F.col(length)} | {f"b_{n}": bits[n].cast("long") for n in FLAGS}
    sums = {f"n_{n}": F.sum(f"b_{n}").over(upto) for n in FLAGS} | {"n_len": F.sum("len").over(upto), "n_all": F.count("*").over(upto)}
    out = track(out, ["flow_id", "rollup_time"], lambda d: d.withColumns(sums), args, {f"n_{n}": f"flow_{n}" for n in FLAGS} | {"n_len": "flow_data_len", "n_all": "flow_packets"})
    every = sum((F.col(f"flow_{n}") for n in FLAGS), F.lit(0))
    ratio = lambda c: F.when(F.col("flow_all") > 0, c / F.col("flow_all"))
    out = out.withColumn("flow_all", every)
    return out.withColumns({"flow_bpp": F.col("flow_data_len") / F.col("flow_packets"), "flow_ppm": F.col("flow_packets") * (MINUTE / bin_ns), "flow_rst_ratio": ratio(F.col("flow_rst")), "flow_syn_ratio": ratio(F.col("flow_syn")), "flow_fin_ratio": ratio(F.col("flow_fin")), "flow_data_ratio": ratio(F.col("flow_ack") + F.col("flow_psh"))})


def tc4_envelope(df: DataFrame, keys: tuple[str, ...] = ("src_ip", "dst_ip", "dst_port"), values: tuple[str, ...] = ("flow_bpp", "flow_data_len"), window_ns: int = 30 * DAY, min_samples: int = 100, multiplier: float = 3.0) -> DataFrame:
    for v in values:
        df = envelope(df, list(keys), v, window_ns, min_samples, multiplier)
    return df


def envelope(df: DataFrame, keys: list[str], value: str, window_ns: int, min_samples: int, multiplier: float = 3.0) -> DataFrame:
    return track(df, keys, lambda d: trackers.transfer_envelope(d, "v", window_ns, 0.99, multiplier, min_samples), {"v": value}, {"envelope": f"{value}_envelope", "envelope_ratio": f"{value}_envelope_ratio", "breached": f"{value}_envelope_breached"})


# layer 5


def tc5_session(df: DataFrame, session: str = "session_key", action: str = "action", starts: tuple[str, ...] = ("start", "session_start", "logon", "login"), ends: tuple[str, ...] = ("end", "session_end", "logoff", "logout"), timeout_ns: int = 36 * HOUR, principal: str = "principal", window_ns: int = 30 * DAY, min_samples: int = 100) -> DataFrame:
    """One row a session's end, or a start that nothing followed: its duration against the principal's own sessions (principal is null where unknown)."""
    own = df.where(F.col(session).isNotNull()).select(F.col(session).cast("string").alias("entity"), F.col(principal).cast("string").alias("principal"), "t", "seq", F.lower(action).alias("a"))
    pairs = intervals.pair_sessions(own, F.col("a").isin(*starts), F.col("a").isin(*ends), timeout_ns, ("principal",))
    return _timed(pairs, "principal", "session_duration", window_ns, min_samples)


def tc5_novelty(df: DataFrame, principal: str = "principal", columns: dict[str, str] | None = None, asn: str = "asn", window_ns: int = DAY) -> DataFrame:
    """logcount of the day, running counts of different locations, apps and devices with their novelty, networks in the
    window. columns: name of the result to column."""
    out = track(df, [principal], lambda d: trackers.sum_window(d, "one", window_ns), {"one": F.lit(1)}, {"window_n": "logcount"})
    for name, c in (columns or {"location": "location", "app": "app", "device": "device"}).items():
        out = novelty(out, [principal], c, name)
    return distinct(out, [principal], asn, "asns_in_window", window_ns)


def tc5_cadence(df: DataFrame, principal: str = "principal", utc_offset_minutes: int = 0, min_samples: int = 32) -> DataFrame:
    """How usual the local hour and weekday are for the principal."""
    local = F.col("t") + F.lit(utc_offset_minutes * MINUTE)
    hour, weekday = F.pmod(F.floor(local / HOUR), F.lit(24)), F.pmod(F.floor(local / DAY) + 3, F.lit(7))
    names = {"cycle_share": "share", "surprise_bits": "surprise_bits", "cycle_unseen": "unseen", "cycle_mature": "mature"}
    out = track(df, [principal], lambda d: trackers.cyclic_histogram(d, F.col("b"), 24, min_samples), {"b": hour}, {k: f"hour_{v}" for k, v in names.items()})
    return track(out, [principal], lambda d: trackers.cyclic_histogram(d, F.col("b"), 7, min_samples), {"b": weekday}, {k: f"weekday_{v}" for k, v in names.items()})


def tc5_travel(df: DataFrame, principal: str = "principal", latitude: str = "latitude", longitude: str = "longitude", success: Column | None = None, refresh: Column | None = None, source_ip: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """travel_km, travel_hours, travel_kmh and travel_status; failures, token refreshes and excluded networks are no journey."""
    no = F.lit(False)
    for block in excluded if source_ip else ():
        no = no | network.in_block(F.col(source_ip), block)
    out_of = F.coalesce(no, F.lit(False)) | F.coalesce(refresh, F.lit(False)) if refresh is not None else F.coalesce(no, F.lit(False))
    failed = ~F.coalesce(success, F.lit(False)) if success is not None else F.lit(False)
    counts = ~out_of & ~failed
    args: Args = {"la": F.when(counts, F.col(latitude)), "lo": F.when(counts, F.col(longitude))}
    out = track(df, [principal], lambda d: trackers.geo_velocity(d, "la", "lo"), args, {"distance_km": "travel_km", "elapsed_hours": "travel_hours", "speed_kmh": "travel_kmh"})
    located = F.col(latitude).isNotNull() & F.col(longitude).isNotNull()
    status = F.when(failed, "failed").when(out_of, "excluded").when(~located, "unlocated").when(F.col("travel_km").isNull(), "first_for_principal").otherwise("measured")
    return out.withColumn("travel_status", F.when(F.col(principal).isNotNull(), status))


def tc5_risk(df: DataFrame, principal: str = "principal", success: Column | None = None, mfa: Column | None = None, run_ns: int = 10 * MINUTE, ratio_ns: int = DAY, min_denominator: int = 10, mfa_result: Column | None = None) -> DataFrame:
    """Runs of failures that end in a success, the share of sign-ins with a second factor, and with mfa_result (a text) runs of its denials that
    end in an approval. Rows whose outcome isn't known count in no run and have no counts."""
    ok = success if success is not None else F.lower(normalize_text(F.col("auth_result"))).isin(*SUCCESSES)
    factor = mfa if mfa is not None else F.col("mfa_used")
    answer = F.lower(normalize_text(mfa_result)) if mfa_result is not None else F.lit(None).cast("string")
    out = df.withColumn("mfa_challenge", F.coalesce(factor, F.lit(False)) | answer.isNotNull())
    runs = [("auth", ok, ("attempts", "failures"), "consecutive_auth_failures", "auth_failed_then_succeeded")]
    if mfa_result is not None:
        runs.append(("mfa", answer.isin(*APPROVALS), ("attempts", "denials"), "consecutive_mfa_denials", "mfa_denied_then_approved"))
    for name, good, (tries, bad), run, ended in runs:
        names = {"attempts": f"{name}_{tries}_in_window", "failures": f"{name}_{bad}_in_window", "consecutive_failures": run, "failure_then_success": ended}
        # rows without an outcome are a key of their own
        out = track(out.withColumn("_told", good.isNotNull()), [principal, "_told"], lambda d: trackers.outcome_run(d, F.col("ok"), run_ns), {"ok": good}, names)
        out = out.withColumns({n: F.when(F.col("_told"), F.col(n)) for n in names.values()}).drop("_told")
    return track(out, [principal], lambda d: trackers.ratio_window(d, F.col("m"), ratio_ns, min_denominator), {"m": "mfa_challenge"}, {"ratio": "mfa_ratio"})


def tc5_drift(df: DataFrame, entity: str = "principal", score: str = "mean_abs_z", window: str = "window_id", aggregate: str = "mean", min_windows: int = 4) -> DataFrame:
    """One row a (entity, window): drift of its aggregated score."""
    how = {"mean": F.avg, "max": F.max, "distinct": F.countDistinct}[aggregate]
    rows = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(window).alias("window_id")).agg(how(score).cast("double").alias("score"))
    return trackers.drift_trajectory(rows, "score", "window_id", min_windows=min_windows)


# layer 6


def tc6_certificate(df: DataFrame, keys: tuple[str, ...] = ("sni",), issuer: str = "issuer", subject: str = "subject", dst: str = "dst_ip", not_before: str = "not_before", not_after: str = "not_after", window_ns: int = 30 * DAY, min_samples: int = 5, warmup_ns: int = 7 * DAY) -> DataFrame:
    """The issuer a destination is known by, whether this one differs, validity, self-signed (outside), new to the estate."""
    out = track(df, list(keys), lambda d: trackers.value_history(d, "v", window_ns, min_samples), {"v": issuer}, {"established": "cert_issuer_established", "deviates": "cert_issuer_differs"})
    out = novelty(out, list(keys), issuer, "cert_issuer")
    signed = F.col(issuer) == F.col(subject)
    out = out.withColumns({"cert_issuer_mature": F.col("cert_issuer_established").isNotNull(), "cert_validity_days": (F.col(not_after) - F.col(not_before)) / F.lit(float(DAY)), "cert_self_signed": signed, "cert_self_signed_external": signed & ~network.is_private(F.col(dst))})
    # new to all: an issuer's own first row, so its rows meet by issuer and no estate-wide group forms
    start = df.agg(F.min("t").alias("_start"))
    out = track(out, [issuer], lambda d: d.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("t", "seq")) == 1), {}, {"n": "_first"})
    return out.join(F.broadcast(start)).withColumn("cert_issuer_new_to_estate", F.col("_first") & (F.col("t") - F.col("_start") >= warmup_ns)).drop("_first", "_start")


def tc6_cipher(df: DataFrame, keys: tuple[str, ...] = ("src_ip", "dst_ip"), cipher: str = "cipher_suite", window_ns: int = 30 * DAY, min_samples: int = 5) -> DataFrame:
    out = df.withColumn("cipher_rank", text.cipher_rank(F.col(cipher)))
    out = track(out, list(keys), lambda d: trackers.value_floor(d, "v", window_ns, min_samples), {"v": "cipher_rank"}, {"floor_value": "cipher_floor", "below_floor": "cipher_downgraded"})
    return out.withColumns({"cipher_tier": text.cipher_tier(F.col("cipher_rank")), "cipher_mature": F.col("cipher_floor").isNotNull(), "cipher_unrecognized": F.col(cipher).isNotNull() & F.col("cipher_rank").isNull()})


def tc6_content(df: DataFrame, declared: str = "declared", detected: str = "detected") -> DataFrame:
    a, b = text.media_category(F.col(declared)), text.media_category(F.col(detected))
    return df.withColumns({"content_category_declared": a, "content_category_detected": b, "content_category_crossed": a != b, "content_category_unclassified": (F.col(declared).isNotNull() & a.isNull()) | (F.col(detected).isNotNull() & b.isNull())})


def tc6_fingerprint(df: DataFrame, keys: tuple[str, ...] = ("src_ip",), fingerprint: str = "ja4") -> DataFrame:
    out = novelty(df, list(keys), fingerprint)
    upto = Window.partitionBy("entity").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return track(out, list(keys), lambda d: d.withColumn("n", F.count("v").over(upto)), {"v": fingerprint}, {"n": f"{fingerprint}_observations"})


# layer 7


def tc7_dns(df: DataFrame, suffixes: DataFrame, key: str = "src_ip", query: str = "query_name", failed: Column | None = None, window_ns: int = HOUR, min_queries: int = 20, min_days: int = 7) -> DataFrame:
    """Registered domain and subdomain with its entropy and label length, counts in the window, the share of unknown
    names, and both counts against the busiest day."""
    out = text.public_suffix(df, query, suffixes).withColumnsRenamed({"registered_domain": "dns_registered_domain", "subdomain": "dns_subdomain"})
    out = out.withColumns({"dns_subdomain_entropy": text.shannon_entropy(F.col("dns_subdomain")), "dns_mean_label_length": text.mean_label_length(F.col("dns_subdomain"))})
    out = distinct(distinct(out, [key, "dns_registered_domain"], "dns_subdomain", "dns_subdomains_per_domain", window_ns), [key], "dns_registered_domain", "dns_domains_per_client", window_ns)
    nx = failed if failed is not None else F.col("response_code") == "NXDOMAIN"
    out = track(out, [key], lambda d: trackers.ratio_window(d, F.col("x"), window_ns, min_queries), {"x": nx}, {"ratio": "dns_nxdomain_ratio"})
    return baseline(baseline(out, [key, "dns_registered_domain"], "dns_subdomains_per_domain", DAY, 30 * DAY, min_days), [key], "dns_domains_per_client", DAY, 30 * DAY, min_days)


def tc7_http(df: DataFrame, key: str = "src_ip", status: str = "status_code", path: str = "url_path", agent: str = "user_agent", window_ns: int = 10 * MINUTE, min_days: int = 7) -> DataFrame:
    """Status class, refused and served requests in the window, different paths against the busiest day, and the agent."""
    out = df.withColumns({"http_status_class": F.floor(F.col(status) / 100).cast("int"), "http_user_agent_family": text.user_agent_family(F.col(agent)), "http_user_agent_os": text.user_agent_os(F.col(agent))})
    for name, c in (("4xx", 4), ("2xx", 2)):
        out = track(out, [key], lambda d: trackers.ratio_window(d, F.col("f"), window_ns, 1), {"f": F.col("http_status_class") == c}, {"numerator": f"http_{name}_in_window"})
    out = novelty(distinct(out, [key], path, "http_distinct_paths", window_ns), [key], "http_user_agent_family")
    return baseline(out, [key], "http_distinct_paths", DAY, 30 * DAY, min_days)


WEEK_EPOCH = 4 * DAY  # the first Monday after the epoch


def tc7_saas(df: DataFrame, principal: str = "principal", operation: str = "operation", object_type: str = "object_type", records: str = "record_count", ok: Column | None = None, min_samples: int = 100) -> DataFrame:
    """Records of an operation against the principal's own envelope, and different object types so far in the week;
    failed operations count nowhere."""
    good = F.coalesce(ok, F.lit(False)) if ok is not None else F.lit(True)
    out = df.withColumns({"_n": F.when(good, F.col(records)), "_o": F.when(good, F.col(object_type)), "week_window_id": F.floor((F.col("t") - WEEK_EPOCH) / (7 * DAY)).cast("long")})
    out = track(out, [principal, operation], lambda d: trackers.transfer_envelope(d, "v", 30 * DAY, 0.99, 1.0, min_samples), {"v": "_n"}, {"envelope": "saas_baseline", "envelope_ratio": "saas_record_ratio"})
    out = track(out, [principal, "week_window_id"], lambda d: trackers.value_novelty(d, "v"), {"v": "_o"}, {"distinct_so_far": "saas_object_types_in_week"})
    return out.withColumn("saas_baseline_mature", F.col("saas_baseline").isNotNull()).drop("_n", "_o")


def tc7_endpoint(df: DataFrame, host: str = "host_key", parent: str = "parent_image", image: str = "image", peers: str | None = None, window_ns: int = 30 * DAY, warmup_ns: int = 7 * DAY) -> DataFrame:
    """endpoint_pair (parent and image by name, lower-cased) and its novelty for the host and its peer group."""
    name = lambda c: F.lower(F.element_at(F.split(c, r"[/\\]"), -1))
    out = df.withColumn("endpoint_pair", F.concat_ws(">", F.when(F.col(image).isNotNull(), name(F.col(parent))), name(F.col(image))))
    out = out.withColumn("endpoint_pair", F.when(F.col(parent).isNotNull() & F.col(image).isNotNull(), F.col("endpoint_pair")))
    for label, key in (("host", host), *((("peers", peers),) if peers else ())):
        out = track(out, [key], lambda d: trackers.pair_history(d, "v", window_ns, warmup_ns), {"v": "endpoint_pair"}, {"pair_seen": f"endpoint_{label}_seen", "pair_mature": f"endpoint_{label}_mature"})
    fresh = ~F.col("endpoint_host_seen") & F.col("endpoint_host_mature")
    if peers:
        fresh = fresh & F.coalesce(~F.col("endpoint_peers_seen") & F.col("endpoint_peers_mature"), F.lit(True))
    return out.withColumn("endpoint_pair_novel", F.when(F.col("endpoint_pair").isNotNull(), fresh))


def tc7_service(df: DataFrame, client: str = "src_ip", address: str = "dst_ip", port: str = "dst_port", name: str = "sni", size: str = "bytes_total", fingerprint: str = "ja4", window_ns: int = HOUR, min_days: int = 7) -> DataFrame:
    """A service (its name or address, and port): connections, bytes and clients in the window, clients against the
    busiest day, and the clients' fingerprints."""
    out = df.withColumn("service_key", compose_key(F.coalesce(name, address), F.col(port).cast("string")))
    out = track(out, ["service_key"], lambda d: trackers.sum_window(d, "b", window_ns), {"b": size}, {"window_n": "service_connections_in_window", "window_sum": "service_bytes_in_window"})
    out = novelty(distinct(out, ["service_key"], client, "service_clients_in_window", window_ns), ["service_key"], fingerprint, "service_client_fingerprint")
    return baseline(out, ["service_key"], "service_clients_in_window", DAY, 30 * DAY, min_days)


def flow_record(df: DataFrame, collector_id: str, tenant_id: str, names: dict[str, str], clock_offset_ms: int | None = None) -> DataFrame:
    """Exported flow records in the common terms, with an envelope. names: field of the exporter to column."""
    own = [F.col(k).alias(v) for k, v in names.items()]
    stamp = {"schema_version": "tc3.v1", "collector_id": collector_id, "clock_source": "ntp_disciplined", "sampling_policy": "full", "tenant_id": tenant_id}
    return df.select(*own, F.col("seq").alias("collector_seq"), F.col("t").alias("event_time"), *[F.lit(v).alias(k) for k, v in stamp.items()], F.lit(clock_offset_ms).cast("int").alias("clock_offset_ms"))


def entity_health(df: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """Counts of rows that carry each flag, by key."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.sum(F.coalesce(F.col(f).cast("long"), F.lit(0))).alias(f) for f in flags])
