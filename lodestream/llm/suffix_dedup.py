"""Removal of byte strings that repeat across documents, by sorting sampled suffixes and inducing the rest.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id. Sorting
every suffix costs 13 bytes and more a position, several times the input; so, as in induced sorting, a sample of
suffixes that depends on content alone is sorted, with the common-prefix question cut to what matters (are
``length`` bytes the same?), and verdicts on the other suffixes are induced from the sample:

1. Among the ``length - SEED + 1`` seeds of each window the one with the smallest hash is its anchor. Equal windows
   have equal anchors at equal places, and an anchor serves a run of neighbouring windows. A task emits one tuple an
   anchor: (hash of the seed, hash of all bytes that its windows cover, place). Tuples with the same bytes in a
   later document of the same task are settled there, so common passages shrink before the shuffle.
2. Tuples are dealt by seed and sorted. All windows of an anchor are repeats if the same bytes stand in an earlier
   document. An anchor whose seed occurs with different bytes around it is open.
3. Only open anchors have their windows compared one by one, in a second sort by the window's hash.
4. Documents meet their verdicts in groups dealt by id, and lose the union of the repeated windows.

Equality is decided by 128 bits for an anchor (its seed's hash and that of all bytes its windows cover) and by 96 bits
for a window: over 10^13 windows one false removal has a chance of some 10^-3. Verdicts are on the input: what another document loses doesn't matter.

Defined results: null text is empty; texts under ``length`` bytes lose nothing; a null id neither loses nor
causes a loss; rows that repeat an id don't touch each other, and each is judged by its own text. Other columns
than the id and the text are not carried. What is left of a text may cut a UTF-8 character and so stays bytes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import written

LENGTH = 50
SEED = 24  # bytes, a multiple of 8, at most LENGTH
PIECE = 1 << 22  # windows that are looked at in one go
HELD = 1_200_000
BUCKETS = 64
GROUP_BYTES = 12 << 20
U = np.uint64
ODD = 0x9E3779B97F4A7C15
BACK = pow(ODD, -1, 1 << 64)
PLACE = 28  # bits for a place within a piece


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _eights(raw: bytes) -> np.ndarray:
    """Mixed value of the 8 bytes from each place on."""
    out = np.empty(len(raw) - 7, U)
    for k in range(8):
        part = out[k::8]
        part[:] = np.frombuffer(raw, "<u8", len(part), k)
    return _mix(out)


class Powers:
    """Powers of an odd number and of its inverse, mod 2**64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, x, U))]) for x in (ODD, BACK))
        return self.up[:n], self.down[:n]


def _sums(eights: np.ndarray, powers: Powers) -> np.ndarray:
    return np.concatenate([np.zeros(1, U), np.cumsum(eights * powers.to(len(eights))[0])])


def window_hashes(raw: bytes, powers: Powers, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of the text, of 64 and of 32 bits."""
    if len(raw) < length:
        return np.zeros(0, U), np.zeros(0, np.uint32)
    eights, n = _eights(raw), len(raw) - length + 1
    sums = _sums(eights, powers)
    first = _mix((sums[length - 7 :] - sums[:n]) * powers.to(n)[1])
    sums = _sums(_mix(eights ^ U(ODD)), powers)
    return first, (_mix((sums[length - 7 :] - sums[:n]) * powers.to(n)[1]) >> U(32)).astype(np.uint32)


def anchors(raw: bytes, powers: Powers, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, context hash, first window, last window) of each anchor, in order."""
    parts = []
    for at in range(0, max(len(raw) - length + 1, 0), PIECE):
        text = raw[at : at + PIECE + length - 1]
        eights = _eights(text)
        hashes = eights[: len(text) - seed + 1]
        for k in range(8, seed, 8):
            hashes = _mix(hashes * U(3) + eights[k : k + len(hashes)])
        # smallest hash, then leftmost: a function of the window's bytes alone
        low = (hashes >> U(PLACE) << U(PLACE)) | np.arange(len(hashes), dtype=U)
        span, wide = 1, length - seed + 1
        while 2 * span <= wide:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        place = (low & U((1 << PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        sums = _sums(eights, powers)
        context = (sums[last + length - 7] - sums[first]) * powers.to(len(eights))[1][first]
        place = place[first]
        parts.append((hashes[place], _mix(context + _mix(((place - first) * 64 + (last - first)).astype(U))), first + at, last + at))
    if not parts:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


# packed tuples: a row holds arrays, so that Spark moves few rows

#: kind null: tuples for a bucket. Else verdicts on their way home; their bucket is -1 - home, so that one shuffle moves both.
TUPLES = "bucket int, kind int, docs binary, checks binary, counts binary, first binary, second binary, place binary"
VERDICTS = "home int, kind int, docs binary, checks binary, counts binary, place binary"


def _deal(to: np.ndarray, docs: np.ndarray, checks: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
    """(bucket, docs, checks, counts, *columns) as bytes for each bucket; rows of one document stay together."""
    order = np.lexsort((checks, docs, to))
    to, docs, checks, columns = to[order], docs[order], checks[order], [c[order] for c in columns]
    edges = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)] if len(to) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        starts = np.flatnonzero(np.r_[True, (docs[lo + 1 : hi] != docs[lo : hi - 1]) | (checks[lo + 1 : hi] != checks[lo : hi - 1])])
        counts = np.diff(np.r_[starts, hi - lo]).astype(np.uint32)
        yield (int(to[lo]), docs[lo:hi][starts].tobytes(), checks[lo:hi][starts].tobytes(), counts.tobytes(), *(c[lo:hi].tobytes() for c in columns))


def _undeal(table: pa.Table, columns: dict[str, type]) -> tuple[np.ndarray, ...]:
    """docs, checks and the columns, one entry a tuple."""
    whole = lambda k, kind: np.frombuffer(b"".join(table[k].to_pylist()), kind)
    counts = whole("counts", np.uint32)
    return np.repeat(whole("docs", np.int64), counts), np.repeat(whole("checks", np.uint32), counts), *(whole(k, v) for k, v in columns.items())


def _home(docs: np.ndarray, checks: np.ndarray, homes: int) -> np.ndarray:
    return (_mix(docs.astype(U) * U(3) + checks.astype(U)) % U(homes)).astype(np.int32)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


FULL, OPEN, SPAN, WINDOW = range(4)  # kinds of verdicts: anchor settled, anchor open, run of windows, window


def _homeward(kind: int, docs: np.ndarray, checks: np.ndarray, place: np.ndarray, homes: int) -> list[tuple]:
    """Rows of verdicts among tuples."""
    return [(-1 - r[0], kind, *r[1:4], None, None, r[4]) for r in _deal(_home(docs, checks, homes), docs, checks, [place])]


def _arrived(table: pa.Table) -> pa.Table | None:
    """The verdicts, if this group is no bucket but verdicts on their way home."""
    bucket = table["bucket"][0].as_py()
    if bucket >= 0:
        return None
    home = pa.array([-1 - bucket] * len(table), pa.int32())
    return pa.table([home] + [table[c] for c in ("kind", "docs", "checks", "counts", "place")], ["home", "kind", "docs", "checks", "counts", "place"])


def _settle(docs: np.ndarray, checks: np.ndarray, keys: tuple[np.ndarray, ...], columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): tuples sorted by keys and document; later marks those after another document with the same keys."""
    order = np.lexsort((docs, *keys[::-1]))
    new = np.zeros(len(order), bool)
    if len(new):
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    d = docs[order]
    return order, d > d[start] if len(d) else np.zeros(0, bool)


def _sampled(docs: DataFrame, buckets: int, homes: int, length: int) -> DataFrame:
    """Step 1: rows of tuples by bucket, and rows of verdicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            sizes = [len(h[2]) for h in held]
            doc, check = np.repeat(np.array([h[0] for h in held], np.int64), sizes), np.repeat(np.array([h[1] for h in held], np.uint32), sizes)
            key, context = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, U) for k in (2, 3))
            place = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes]) if held else np.zeros(0, np.uint32)
            order, later = _settle(doc, check, (key, context), [])
            doc, check, key, context, place = (x[order] for x in (doc, check, key, context, place))
            go = ~later
            rows = [(r[0], None, *r[1:]) for r in _deal((_mix(key[go]) % U(buckets)).astype(np.int32), doc[go], check[go], [key[go], context[go], place[go]])]
            return _batch(rows + _homeward(FULL, doc[later], check[later], place[later], homes), TUPLES)

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = _raw(text.as_py())
                if len(raw) < length or not doc.is_valid:
                    continue
                key, context, _, _ = anchors(raw, powers, length)
                held.append((doc.as_py(), zlib.crc32(raw), key, context))
                total += len(key)
                if total >= HELD:
                    yield flush()
                    held.clear()
                    total = 0
        yield flush()

    return docs.mapInArrow(run, TUPLES)


def _by_seed(tuples: DataFrame, homes: int) -> DataFrame:
    """Step 2: verdicts on anchors."""

    def run(table: pa.Table) -> pa.Table:
        if (verdicts := _arrived(table)) is not None:
            return verdicts
        doc, check, key, context, place = _undeal(table, {"first": U, "second": U, "place": np.uint32})
        order, later = _settle(doc, check, (key, context), [])
        doc, check, key, context, place = (x[order] for x in (doc, check, key, context, place))
        new_key = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        new_class = new_key | (np.r_[True, context[1:] != context[:-1]] if len(key) else new_key)
        starts = np.flatnonzero(new_key)
        mixed = np.zeros(len(key), bool)
        if len(starts):
            sizes = np.diff(np.r_[starts, len(key)])
            several = np.add.reduceat(new_class.astype(np.int64), starts) > 1
            docs_differ = np.maximum.reduceat(doc, starts) > np.minimum.reduceat(doc, starts)
            mixed = np.repeat(several & docs_differ, sizes)
        rows = []
        for kind, own in ((FULL, later), (OPEN, mixed & ~later)):
            rows += [(r[0], kind, *r[1:]) for r in _deal(_home(doc[own], check[own], homes), doc[own], check[own], [place[own]])]
        return pa.Table.from_batches([_batch(rows, VERDICTS)])

    return tuples.groupBy("bucket").applyInArrow(run, VERDICTS)


def _marks(table: pa.Table, kind: int) -> dict[tuple[int, int], np.ndarray]:
    """Places by (doc, check) of one kind of verdict."""
    own = table.filter(pc.equal(table["kind"], kind)) if len(table) else table
    doc, check, place = _undeal(own, {"place": np.uint32})
    order = np.lexsort((check, doc))
    doc, check, place = doc[order], check[order], place[order]
    edges = np.r_[0, np.flatnonzero((doc[1:] != doc[:-1]) | (check[1:] != check[:-1])) + 1, len(doc)] if len(doc) else [0]
    return {(int(doc[lo]), int(check[lo])): place[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)}


def _opened(homed: DataFrame, verdicts: DataFrame, buckets: int, homes: int, length: int) -> DataFrame:
    """Step 3: the windows of open anchors as tuples, and settled anchors as runs of windows."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        powers = Powers()
        full, opened = _marks(found, FULL), _marks(found, OPEN)
        parts: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        spans: list[tuple[int, int, np.ndarray]] = []
        done = set()
        for doc, text in zip(texts["doc_id"], texts["text"], strict=True):
            raw = _raw(text.as_py())
            me = (doc.as_py(), zlib.crc32(raw))
            if me in done or (me not in full and me not in opened):
                continue
            done.add(me)
            _, _, first, last = anchors(raw, powers, length)
            if me in full:
                spans.append((*me, np.stack([first[full[me]], last[full[me]]], 1).astype(np.uint32).ravel()))
            if me in opened:
                a, b = first[opened[me]], last[opened[me]]
                n = b - a + 1
                windows = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                one, two = window_hashes(raw, powers, length)
                parts.append((*me, one[windows], two[windows], windows.astype(np.uint32)))

        def flat(what: list[tuple], k: int, kind: type) -> np.ndarray:
            return np.concatenate([p[k] for p in what]) if what else np.zeros(0, kind)

        def owners(what: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
            sizes = [len(p[k]) for p in what]
            return np.repeat(np.array([p[0] for p in what], np.int64), sizes), np.repeat(np.array([p[1] for p in what], np.uint32), sizes)

        doc, check = owners(parts, 2)
        value, other, place = flat(parts, 2, U), flat(parts, 3, np.uint32), flat(parts, 4, np.uint32)
        order, later = _settle(doc, check, (value, other), [])
        doc, check, value, other, place = (x[order] for x in (doc, check, value, other, place))
        go = ~later
        rows = [(r[0], None, *r[1:]) for r in _deal((_mix(value[go]) % U(buckets)).astype(np.int32), doc[go], check[go], [value[go], other[go], place[go]])]
        for kind, (d, c), p in ((SPAN, owners(spans, 2), flat(spans, 2, np.uint32)), (WINDOW, (doc[later], check[later]), place[later])):
            rows += _homeward(kind, d, c, p, homes)
        return pa.Table.from_batches([_batch(rows, TUPLES)])

    return homed.groupBy("home").cogroup(verdicts.withColumnRenamed("home", "at").groupBy("at")).applyInArrow(run, TUPLES)


def _by_window(tuples: DataFrame, homes: int) -> DataFrame:
    """Step 3: windows that an earlier document has too."""

    def run(table: pa.Table) -> pa.Table:
        if (verdicts := _arrived(table)) is not None:
            return verdicts
        doc, check, value, other, place = _undeal(table, {"first": U, "second": np.uint32, "place": np.uint32})
        order, later = _settle(doc, check, (value, other), [])
        doc, check, place = (x[order][later] for x in (doc, check, place))
        return pa.Table.from_batches([_batch([(r[0], WINDOW, *r[1:]) for r in _deal(_home(doc, check, homes), doc, check, [place])], VERDICTS)])

    return tuples.groupBy("bucket").applyInArrow(run, VERDICTS)


def cover(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes lie in a window that starts at one of the places."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(homed: DataFrame, verdicts: DataFrame, length: int, with_kept: bool) -> DataFrame:
    """Step 4."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        spans, windows = _marks(found, SPAN), _marks(found, WINDOW)
        out: dict[str, list] = {x.split()[0]: [] for x in RESULT.split(", ")} | ({"kept": []} if with_kept else {})
        for doc, text in zip(texts["doc_id"].to_pylist(), texts["text"].to_pylist(), strict=True):
            raw = _raw(text)
            starts = []
            if doc is not None and raw:
                me = (doc, zlib.crc32(raw))
                if me in windows:
                    starts.append(windows[me].astype(np.int64))
                if me in spans:
                    run_of = spans[me].astype(np.int64).reshape(-1, 2)
                    n = run_of[:, 1] - run_of[:, 0] + 1
                    starts.append(np.repeat(run_of[:, 0] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()))
            kept, gone, runs = raw, 0, 0
            if starts:
                hit = cover(len(raw), np.concatenate(starts), length)
                gone, runs = int(hit.sum()), int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~hit].tobytes()
            for k, v in zip(out, (doc, len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                out[k].append(v)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=False)})

    return homed.groupBy("home").cogroup(verdicts.withColumnRenamed("home", "at").groupBy("at")).applyInArrow(run, RESULT + (", kept binary" if with_kept else ""))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_kept the bytes that remain."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = buckets = max(BUCKETS, math.ceil(size / GROUP_BYTES))

    anchored = written(_by_seed(_sampled(own, buckets, homes, length), homes), "anchored")

    @F.pandas_udf("int")
    def home(ids, texts):  # noqa: ANN001, ANN202
        import pandas as pd

        checks = np.array([zlib.crc32(_raw(t)) for t in texts.astype(object).where(texts.notna(), None)], np.uint32)
        return pd.Series(_home(ids.fillna(0).to_numpy().astype(np.int64), checks, homes))

    homed = own.withColumn("home", home("doc_id", "text"))
    windows = written(_by_window(_opened(homed, anchored, buckets, homes, length), homes), "windows")
    return _removed(homed, windows, length, with_kept)
