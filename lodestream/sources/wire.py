"""The wire contract: what a record must carry to be delivered, and the form in which it is.

Moments leave as UTC text of microseconds, cut and never rounded; nulls are left out; columns that end in ``_ns`` stay numbers, as they are
computed with. A frame that lacks what its contract asks for is refused as a whole, before anything is sent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of every scored event: its moments, where it came from, and what decided its numbers.
MOMENTS = ("event_time", "observed_time", "ingest_time")
ENVELOPE = ("collector_id", "tenant_id", "window_complete")
PROVENANCE = ("determinism_tier", "pipeline_fingerprint", "config_hash", "reference_data", "resumed_from")
SCORED = ("event_uid", "entity_key", "lineage_id", "osi_layer", "window_id", *PROVENANCE, *ENVELOPE)


@dataclass(frozen=True)
class Contract:
    """A kind of record: its name, the column its time is read from, all columns of moments, and what it must carry: the required columns and all of
    one of the variants, where there are any."""

    name: str
    time_column: str
    time_columns: tuple[str, ...]
    required: tuple[str, ...]
    variants: tuple[tuple[str, ...], ...] = ()

    @property
    def topic(self) -> str:
        return self.name.replace(":", ".")

    @property
    def filename(self) -> str:
        return self.name.replace(":", "_") + ".jsonlines"


def contracts(prefix: str, layers: dict[int, tuple[tuple[str, ...], ...]] | None = None) -> dict[str, Contract]:
    """The contracts under a prefix: scored events of each layer (with the layer's variants), bindings, edges, late arrivals, refusals, health, context, chains and risks."""
    scored = [Contract(f"{prefix}:score:l{n}", "event_time", MOMENTS, SCORED, (layers or {}).get(n, ())) for n in range(1, 8)]
    bound = [Contract(f"{prefix}:binding:{k}", "bind_start", ("bind_start", "bind_end"), ("binding_uid", "binding_method", *more)) for k, more in (("l1", ("port_key",)), ("l2", ("mac_address", "port_key")), ("l2_l3", ("ip", "mac_address")), ("l5_l2", ("user_principal", "port_key")))]
    rest = [
        Contract(f"{prefix}:lineage:edge", "created_time", ("created_time",), ("parent", "child", "relation", "join_method", "link_uid")),
        Contract(f"{prefix}:late", "event_time", MOMENTS, ("event_uid", "window_id", "osi_layer", *ENVELOPE)),
        Contract(f"{prefix}:quarantine", "ingest_time", ("ingest_time",), ("quarantine_reasons", "collector_id")),
        Contract(f"{prefix}:health:window", "window_end", ("window_start", "window_end"), ("collector_id", "rows", "late_rows")),
        Contract(f"{prefix}:health:stage", "window_end", ("window_start", "window_end"), ("stage", "rows")),
        Contract(f"{prefix}:health:collector", "event_time", ("event_time",), ("collector_id", "sequence_gap", "sequence_regressed")),
        Contract(f"{prefix}:context", "recorded_at", ("recorded_at", "valid_from", "valid_to"), ("context_kind", "context_entity", "context_uid", "change")),
        Contract(f"{prefix}:entity", "window_end", ("window_start", "window_end"), ("entity", "window_id", "rows")),
        Contract(f"{prefix}:risk", "event_time", ("event_time",), ("rule_id", "risk_score", "entity_key", "osi_layer")),
    ]
    return {c.name: c for c in (*scored, *bound, *rest)}


def event_time(value: Column, unit_ns: int = 1) -> Column:
    """A moment in the wire's form, from a number of units of unit_ns since the epoch; null for null."""
    micros = F.floor(value.cast("decimal(38,0)") * unit_ns / 1000).cast("long")
    seconds, rest = F.floor(micros / 1_000_000).cast("long"), F.pmod(micros, F.lit(1_000_000))
    at = F.date_format(F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(at, F.lit("."), F.lpad(rest.cast("string"), 6, "0"), F.lit("UTC"))


def _moment(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return event_time(F.unix_micros(name), 1000)
    if isinstance(kind, T.TimestampNTZType):
        return event_time(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)"), 1000)
    return F.col(name) if isinstance(kind, T.StringType) else event_time(F.col(name))


def check(df: DataFrame, contract: Contract) -> None:
    """Raise for a frame that the contract refuses."""
    missing = [c for c in (contract.time_column, *contract.required) if c not in df.columns]
    if missing:
        raise KeyError(f"{contract.name} needs columns {missing}")
    if contract.variants and not any(set(v) <= set(df.columns) for v in contract.variants):
        nearest = min(([c for c in v if c not in df.columns] for v in contract.variants), key=len)
        raise KeyError(f"{contract.name} carries none of its variants whole; the nearest lacks {nearest}")


def to_wire(df: DataFrame, contract: Contract) -> DataFrame:
    """df with its moments in the wire's form; moments that are text already stay. A row without its time is left out: it has no place in an index."""
    check(df, contract)
    own = [c for c in contract.time_columns if c in df.columns]
    return df.withColumns({c: _moment(df, c) for c in own}).where(F.col(contract.time_column).isNotNull())


def to_lines(df: DataFrame) -> DataFrame:
    """One column ``line``: a JSON object a row, without its null members; nulls within a value stay."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("line"))


def to_csv_lines(df: DataFrame, header: bool = True, **options: str) -> DataFrame:
    """One column ``line`` of separated values; the header is a row of its own, first in a single file that is written from it."""
    lines = df.select(F.to_csv(F.struct(*(F.col(c).cast("string").alias(c) for c in df.columns)), options).alias("line"))
    if not header:
        return lines
    head = df.sparkSession.createDataFrame([(options.get("sep", ",").join(df.columns),)], "line string")
    return head.unionByName(lines)


def write_wire(df: DataFrame, contract: Contract, path: str, mode: str = "append") -> None:
    """The records as lines in the folder of their kind under path."""
    to_lines(to_wire(df, contract)).write.mode(mode).text(f"{path.rstrip('/')}/{contract.filename}")
