"""Packet captures and the flow records in them.

``spark.read.format("pcap")`` is a data source of frames (classic captures of Ethernet, micro- or nanoseconds, either byte order). A file is cut
near multiples of ``splitBytes`` at a place from which a chain of plausible record headers starts; the task that reads up to a cut
checks that its own chain of records ends there, so a cut that is no record's start is an error and never a wrong row. Files are opened by
pyarrow's file systems: local or shared paths and the stores that it knows.

Frames become packets by column expressions. Flow messages (RFC 7011) become rows of sets; a data set takes the last template that its exporter announced
for it before, found by ``feeds.latest`` over the whole capture, so templates learned in one split serve all later ones.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestream.functions.identity import compose_key
from lodestream.operators.feeds import latest
from lodestream.session import written

FRAME = "path string, offset long, received_ns long, frame binary"
#: Fixed values of the formats: magic numbers with the ns a unit, the kind of link, protocols, sets and option kinds.
MAGIC = {0xA1B2C3D4: 1000, 0xA1B23C4D: 1}
ETHERNET, FLOW_PORT, FLOW_VERSION, VARIABLE, REVERSE = 1, 4739, 10, 65535, 29305
OPTIONS = {0: "eol", 1: "nop", 2: "mss", 3: "ws", 4: "sok", 5: "sack", 8: "ts"}
#: Registered information elements that are decoded: (name, kind); counters have a reverse, too.
ELEMENTS = {
    1: ("octetDeltaCount", "number"), 2: ("packetDeltaCount", "number"), 4: ("protocolIdentifier", "number"), 7: ("sourceTransportPort", "number"), 8: ("sourceIPv4Address", "address"), 11: ("destinationTransportPort", "number"),
    12: ("destinationIPv4Address", "address"), 16: ("bgpSourceAsNumber", "number"), 17: ("bgpDestinationAsNumber", "number"), 27: ("sourceIPv6Address", "address"), 28: ("destinationIPv6Address", "address"),
    52: ("minimumTTL", "number"), 53: ("maximumTTL", "number"), 150: ("flowStartSeconds", "number"), 152: ("flowStartMilliseconds", "number"),
}
REVERSIBLE = {1: "reverseOctetDeltaCount", 2: "reversePacketDeltaCount"}
CHAIN, PROBE, YEARS = 8, 1 << 20, 10 * 366 * 86400


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The path, the files of a folder, or those whose names match a pattern at its end."""
    from pyarrow import fs

    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    head, _, last = path.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    system, own = _open(head if pattern else path)
    if not pattern and system.get_file_info(own).type == fs.FileType.File:
        return [path]
    found = [i.path for i in system.get_file_info(fs.FileSelector(own)) if i.type == fs.FileType.File and (not pattern or fnmatch(i.base_name, pattern))]
    return sorted(scheme + p for p in found)


class Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int, endian: str, unit: int) -> None:
        self.path, self.start, self.end, self.endian, self.unit = path, start, end, endian, unit


def _starts(data: bytes, at: int, endian: str, unit: int, longest: int, around: int, is_end: bool) -> bool:
    """Whether a chain of plausible record headers starts here."""
    for _ in range(CHAIN):
        if at == len(data) and is_end:
            return True
        if at + 16 > len(data):
            return False
        seconds, fraction, held, whole = struct.unpack_from(endian + "IIII", data, at)
        if not (0 < held <= longest and held <= whole and fraction < 1_000_000_000 // unit and abs(seconds - around) < YEARS):
            return False
        at += 16 + held
    return True


class PcapReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.split = int(options.get("splitbytes", options.get("splitBytes", str(128 << 20))))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in (f for p in self.paths for f in _files(p)):
            system, own = _open(path)
            size = system.get_file_info(own).size
            with system.open_input_file(own) as f:
                head = f.read(40)
                if len(head) < 24:
                    raise ValueError(f"{path} is too short to be a capture")
                endian = next((e for e in "<>" if struct.unpack_from(e + "I", head)[0] in MAGIC), None)
                if endian is None:
                    raise ValueError(f"{path} is no classic capture")
                unit, (longest, link) = MAGIC[struct.unpack_from(endian + "I", head)[0]], struct.unpack_from(endian + "II", head, 16)
                if link != ETHERNET:
                    raise ValueError(f"{path} has link type {link}; only Ethernet is read")
                around = struct.unpack_from(endian + "I", head, 24)[0] if len(head) >= 40 else 0
                cuts = [24]
                for goal in range(24 + self.split, size, self.split):
                    f.seek(goal)
                    data = f.read(PROBE)
                    found = next((at for at in range(len(data)) if _starts(data, at, endian, unit, max(longest, 65535), around, goal + len(data) == size)), None)
                    if found is not None and cuts[-1] < goal + found < size:  # without a start near the goal the slice before goes on
                        cuts.append(goal + found)
            out += [Slice(path, a, b, endian, unit) for a, b in zip(cuts, [*cuts[1:], size], strict=True)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, own = _open(partition.path)
        with io.BufferedReader(system.open_input_file(own), 1 << 20) as f:
            at = f.seek(partition.start)
            while at + 16 <= partition.end:
                head = f.read(16)
                if len(head) < 16:
                    break
                seconds, fraction, held, _ = struct.unpack(partition.endian + "IIII", head)
                frame = f.read(held)
                if len(frame) < held:  # a capture that broke off: its last record isn't whole
                    at = partition.end
                    break
                yield partition.path, at, seconds * 1_000_000_000 + fraction * partition.unit, frame
                at += 16 + held
            if at > partition.end:
                raise ValueError(f"{partition.path}: the cut at {partition.end} is inside a record; read it with larger splitBytes")


class PcapSource(DataSource):
    """Register with ``spark.dataSource.register(PcapSource)``; options path (files, folders, patterns) and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return PcapReader(dict(self.options))


def _number(hexed: Column, at: Column, n: int) -> Column:
    """The n bytes from a place on as a number."""
    return F.conv(F.substring(hexed, 2 * at + 1, F.lit(2 * n)), 16, 10).cast("long")


def _address(hexed: Column, at: Column) -> Column:
    return F.concat_ws(".", *(_number(hexed, at + k, 1).cast("string") for k in range(4)))


def _datagrams(frames: DataFrame) -> DataFrame:
    """frames of IPv4 with hexed, its header's place and length, whole length, protocol and the transport's place; one VLAN tag is passed over."""
    hexed = F.col("hexed")
    out = frames.withColumn("hexed", F.hex("frame")).withColumn("size", F.octet_length("frame"))
    tagged = _number(hexed, F.lit(12), 2) == 0x8100
    out = out.withColumn("ip", F.when(tagged & (F.col("size") >= 18), 18).otherwise(14))
    out = out.where((F.col("size") >= F.col("ip") + 20) & (_number(hexed, F.col("ip") - 2, 2) == 0x0800))
    out = out.withColumns({"header": (_number(hexed, F.col("ip"), 1) % 16) * 4, "total": _number(hexed, F.col("ip") + 2, 2), "protocol": _number(hexed, F.col("ip") + 9, 1).cast("int")})
    return out.withColumn("transport", (F.col("ip") + F.col("header")).cast("int")).where(F.col("size") >= F.col("transport") + 8)


def tcp_options(data: bytes) -> tuple[str | None, int | None]:
    """The names of the options in order, and the segment size."""
    names, mss, at = [], None, 0
    while at < len(data):
        kind = data[at]
        names.append(OPTIONS.get(kind, str(kind)))
        if kind == 0:
            break
        length = 1 if kind == 1 else max(data[at + 1] if at + 1 < len(data) else 0, 2)
        if kind == 2 and length == 4:
            mss = int.from_bytes(data[at + 2 : at + 4], "big")
        at += length
    return ",".join(names) or None, mss


def packets(frames: DataFrame) -> DataFrame:
    """The TCP and UDP packets: path, offset, received_ns, src, dst, sport, dport, protocol, flags, window, options, mss, data_len.

    data_len is the datagram's less its headers, so a frame that was cut short has the length that its packet had. Other frames are left out.
    """
    import pandas as pd

    @F.pandas_udf("options string, mss long")
    def read_options(data):  # noqa: ANN001, ANN202
        found = [tcp_options(bytes(d)) if d is not None else (None, None) for d in data]
        return pd.DataFrame({"options": pd.Series([x[0] for x in found], dtype=object), "mss": pd.Series([x[1] for x in found], dtype="Int64")})

    hexed, at = F.col("hexed"), F.col("transport")
    out = _datagrams(frames).where("protocol IN (6, 17)")
    tcp = F.col("protocol") == 6
    out = out.where(~tcp | (F.col("size") >= at + 20)).withColumn("length", F.when(tcp, F.floor(_number(hexed, at + 12, 1) / 16) * 4).otherwise(8))
    out = out.withColumn("own", F.when(tcp, F.unhex(F.substring(hexed, 2 * at + 41, F.greatest(2 * F.col("length") - 40, F.lit(0)).cast("int"))))).withColumn("read", read_options("own"))
    return out.select(
        "path", "offset", "received_ns", _address(hexed, F.col("ip") + 12).alias("src"), _address(hexed, F.col("ip") + 16).alias("dst"), _number(hexed, at, 2).alias("sport"), _number(hexed, at + 2, 2).alias("dport"), "protocol",
        F.when(tcp, _number(hexed, at + 13, 1)).alias("flags"), F.when(tcp, _number(hexed, at + 14, 2)).alias("window"), F.when(tcp, F.col("read.options")).alias("options"), F.when(tcp, F.col("read.mss")).alias("mss"),
        (F.col("total") - F.col("header") - F.col("length")).alias("data_len"),
    )


def _hardware(hexed: Column, at: Column) -> Column:
    """Six bytes from a place on as a hardware address."""
    return F.concat_ws(":", *(F.lower(F.substring(hexed, 2 * (at + k) + 1, F.lit(2))) for k in range(6)))


def address_packets(frames: DataFrame) -> DataFrame:
    """The address-resolution packets of Ethernet and IPv4: path, offset, received_ns, operation, sha, spa, tha, tpa. Others are left out."""
    hexed, at = F.col("hexed"), F.col("at")
    out = frames.withColumns({"hexed": F.hex("frame"), "size": F.octet_length("frame")})
    tagged = (_number(hexed, F.lit(12), 2) == 0x8100) & (F.col("size") >= 18)
    out = out.withColumn("at", F.when(tagged, 18).otherwise(14)).where((F.col("size") >= F.col("at") + 28) & (F.substring(hexed, 2 * at - 3, F.lit(16)) == "0806000108000604"))
    return out.select("path", "offset", "received_ns", _number(hexed, at + 6, 2).alias("operation"), _hardware(hexed, at + 8).alias("sha"), _address(hexed, at + 14).alias("spa"), _hardware(hexed, at + 18).alias("tha"), _address(hexed, at + 24).alias("tpa"))


# flow records

MESSAGE = "path string, offset long, received_ns long, exporter_address string, message binary"
SETS = "path string, seq long, received_ns long, exporter_address string, domain long, export_time long, template_id long, fields string, body binary, refused string"
SETS_A_MESSAGE = 1 << 14  # a message of 64 KB has no more


def flow_messages(frames: DataFrame, port: int = FLOW_PORT) -> DataFrame:
    """The payloads of UDP datagrams to the port, with the address they came from."""
    hexed, at = F.col("hexed"), F.col("transport")
    out = _datagrams(frames).where((F.col("protocol") == 17) & (_number(hexed, at + 2, 2) == port))
    end = F.least(at + _number(hexed, at + 4, 2), F.col("ip") + F.col("total"), F.col("size"))
    body = F.unhex(F.substring(hexed, 2 * at + 17, F.greatest(2 * (end - at - 8), F.lit(0)).cast("int")))
    return out.select("path", "offset", "received_ns", _address(hexed, F.col("ip") + 12).alias("exporter_address"), body.alias("message"))


def _template(body: bytes) -> Iterator[tuple[int, str]]:
    """(template, its fields as ``element:length:enterprise`` joined by commas); the rest of a set may be padding."""
    at = 0
    while at + 4 <= len(body):
        name, count = struct.unpack_from("!HH", body, at)
        at += 4
        if name < 256:
            return
        fields = []
        for _ in range(count):
            element, length = struct.unpack_from("!HH", body, at)
            at += 4
            enterprise = 0
            if element & 0x8000:
                enterprise = struct.unpack_from("!I", body, at)[0]
                at += 4
            fields.append(f"{element & 0x7FFF}:{length}:{enterprise}")
        yield name, ",".join(fields)


def _sets(message: bytes) -> Iterator[tuple]:
    """(domain, export time, template, fields of a template or null, body of a data set or null, why the rest is refused or null)."""
    domain = moment = None
    try:
        version, length, moment, _, domain = struct.unpack_from("!HHIII", message)
        if version != FLOW_VERSION:
            raise ValueError(f"version {version}")
        if length != len(message):
            raise ValueError(f"length {length} of {len(message)} bytes")
        at = 16
        while at + 4 <= length:
            kind, size = struct.unpack_from("!HH", message, at)
            if size < 4:
                raise ValueError(f"a set of {size} bytes")
            body = message[at + 4 : at + size]
            at += size
            if kind == 2:
                for name, fields in _template(body):
                    yield domain, moment, name, fields, None, None
            elif kind >= 256:
                yield domain, moment, kind, None, body, None
    except (ValueError, struct.error) as e:
        yield domain, moment, None, None, None, str(e)


def flow_sets(messages: DataFrame) -> DataFrame:
    """A row a template or data set, in order of seq within a path; a message that isn't one of the version, or that breaks off, gives
    its sets up to there and a row with the reason in ``refused``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SETS.split(", ")])
        for batch in batches:
            rows = [(r["path"], r["offset"] * SETS_A_MESSAGE + k, r["received_ns"], r["exporter_address"], *s) for r in batch.to_pylist() for k, s in enumerate(_sets(r["message"] or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return messages.select(*(c.split()[0] for c in MESSAGE.split(", "))).mapInArrow(run, SETS)


NAMES = {name: "long" if kind == "number" else "string" for name, kind in ELEMENTS.values()} | dict.fromkeys(REVERSIBLE.values(), "long")
RECORD = "path string, seq long, received_ns long, exporter_address string, observation_domain_id long, export_time long, " + ", ".join(f"{n} {t}" for n, t in NAMES.items())


def _records(body: bytes, fields: str) -> Iterator[dict]:
    """The records of a data set; what remains and is shorter than a record is padding."""
    import ipaddress

    parts = [tuple(map(int, f.split(":"))) for f in fields.split(",")] if fields else []
    fixed = None if any(n == VARIABLE for _, n, _ in parts) else sum(n for _, n, _ in parts)
    at = 0
    while at < len(body) and parts and fixed != 0:
        if fixed is not None and at + fixed > len(body):
            return
        record: dict = {}
        for element, length, enterprise in parts:
            if length == VARIABLE:
                if at >= len(body):
                    return
                length, at = body[at], at + 1
                if length == 255:
                    length, at = int.from_bytes(body[at : at + 2], "big"), at + 2
            data, at = body[at : at + length], at + length
            if enterprise == 0 and element in ELEMENTS:
                name, kind = ELEMENTS[element]
                if kind == "number":
                    n = int.from_bytes(data, "big")
                    record[name] = n if n < 1 << 63 else None  # more than a long holds
                else:
                    record[name] = str(ipaddress.ip_address(data)) if len(data) in (4, 16) else None
            elif enterprise == REVERSE and element in REVERSIBLE:
                n = int.from_bytes(data, "big")
                record[REVERSIBLE[element]] = n if n < 1 << 63 else None
        yield record


def flow_records(sets: DataFrame, slice_width: int = 1 << 34) -> tuple[DataFrame, DataFrame]:
    """(records, sets that were skipped as their exporter had announced no template for them by then). The sets are written once, as
    templates and data are each read more than once."""
    sets = written(sets, "sets")
    key = compose_key(F.col("path"), F.col("exporter_address"), F.col("domain").cast("string"), F.col("template_id").cast("string"))
    templates = sets.where("fields IS NOT NULL")
    data = sets.where("body IS NOT NULL").drop("fields", "refused")
    data = latest(data, key, templates, key, F.col("fields"), "fields", slice_width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])
        for batch in batches:
            rows = [[r["path"], r["seq"], r["received_ns"], r["exporter_address"], r["domain"], r["export_time"], *(x.get(n) for n in NAMES)] for r in batch.to_pylist() for x in _records(r["body"], r["fields"])]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return data.where("fields IS NOT NULL").mapInArrow(run, RECORD), data.where("fields IS NULL").drop("fields")
