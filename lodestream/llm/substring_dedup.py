"""Removal of passages that repeat across documents, by fixed-block anchors.

A word goes if a window of ``length`` words covers it whose words also start in a document with a smaller id. Every
document is cut into non-overlapping reference blocks of ``block`` words, at most half of a window and a half word
more, so that each window holds a whole block of the document it stands in. Where two documents share a window, the
block in one's window is met by a rolling window of ``block`` words of the other. Steps:

1. Documents are packed, as they come, into written batches of bounded bytes (one longer document is a batch alone).
   A batch knows its own documents, so windows that repeat within it are settled there, once and for all.
2. Of what isn't settled a batch sends the keys of its blocks and of all its rolling windows (probes), once each and
   without places, to buckets by key. A bucket answers a batch with those of its keys that two batches or more have,
   one of them as a block: the hits.
3. Hits are extended: a batch walks from each hit to the windows around it and sends each (hash, document, place) to
   buckets by the window's hash, where all but those of the smallest document are repeats. Neighbouring windows that
   repeat are the maximal repeat, found by their union.
4. The batches meet their verdicts and each document loses the union of its repeated windows.

A frequent passage reaches a bucket once a batch at most, never once a document, so no group grows with the copies;
no text is compared pair by pair. Keys have 32 bits and the bucket's, and only choose what is looked at; a repeat is
decided by 96 bits of the window, without a later comparison of words: over 10^13 windows one false removal has a
chance of some 10^-3.

Defined results: null text has no words; documents under ``length`` words lose nothing; a null id neither loses nor
causes a loss; rows that repeat an id don't touch each other, and each is judged by its own text; ids are read as long, and
one that is no number stops the job. Columns other than the id and the text are not carried, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.suffix_dedup import Powers, _mix, cover
from lodestream.session import forget, written

LENGTH = 50
BATCH_BYTES = 8 << 20
BUCKETS = 64
BUCKET_BYTES = 12 << 20  # bytes of text a bucket
U = np.uint64

BATCH = "home long, n_bytes long, ids array<long>, texts array<string>"


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _batched(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """Step 1: rows of documents, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str | None] = []
        size = 0

        def packed() -> pa.RecordBatch:
            columns = [pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["n_bytes", "ids", "texts"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n = len(text) if text else 0
                if ids and size + n > batch_bytes:
                    yield packed()
                    ids.clear()
                    texts.clear()
                    size = 0
                ids.append(doc)
                texts.append(text)
                size += n
        if ids:
            yield packed()

    out = docs.mapInArrow(run, BATCH.removeprefix("home long, "))
    return out.select(F.monotonically_increasing_id().alias("home"), "*")


class Windows:
    """The words of a batch in one row, documents by ascending id, and their windows. Documents without a window are left out."""

    def __init__(self, ids: list[int | None], texts: list[str | None], length: int, block: int, powers: Powers) -> None:
        from xxhash import xxh3_64_intdigest

        cut = sorted(((doc, w) for doc, text in zip(ids, texts, strict=True) if doc is not None and len(w := _words(text)) >= length), key=lambda x: x[0])
        sizes = np.array([len(w) for _, w in cut], np.int64)
        n = int(sizes.sum())
        flat = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(w for _, w in cut)), U, n)
        starts = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.array([doc for doc, _ in cut], np.int64), sizes)
        self.within = np.arange(n) - np.repeat(starts, sizes)
        self.left = np.repeat(sizes, sizes) - self.within  # words from here to the document's end
        self.length, self.block = length, block
        self.flat, self.powers = flat, powers
        whole = self._hashes(flat, length)
        other = self._hashes(_mix(flat ^ U(0x9E3779B97F4A7C15)), length)
        self.places = np.flatnonzero(self.left[: len(whole)] >= length)
        self.first, self.second = whole[self.places], (other[self.places] >> U(32)).astype(np.uint32)
        # windows that a document with a smaller id in this batch has too; places ascend with ids
        order = np.argsort(self.first, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (self.first[order][1:] != self.first[order][:-1]) | (self.second[order][1:] != self.second[order][:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
        d = self.doc[self.places[order]]
        self.settled = np.zeros(len(order), bool)
        self.settled[order] = d > d[head]

    def _hashes(self, values: np.ndarray, span: int) -> np.ndarray:
        """A hash of the span values from each place on."""
        if len(values) < span:
            return np.zeros(0, U)
        up, down = self.powers.to(len(values))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(values * up)])
        return _mix((sums[span:] - sums[:-span]) * down[: len(values) - span + 1])

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, places) of the rolling windows of a block's size that lie in a window that isn't settled."""
        n, reach = len(self.flat), self.length - self.block + 1
        step = np.zeros(n + reach + 1, np.int64)
        open_at = self.places[~self.settled]
        step[open_at] += 1  # places are distinct
        step[open_at + reach] -= 1
        at = np.flatnonzero(np.cumsum(step[:n]) > 0)
        return self._hashes(self.flat, self.block)[at], at


def _dealt(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns by bucket; rows keep their order."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    edges = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)] if len(to) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(to[lo]), [c[order[lo:hi]] for c in columns]


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[t]) for k, (name, t) in enumerate(fields)})


def _whole(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column and how many each row has."""
    parts = [x or b"" for x in table[column].to_pylist()]
    return np.frombuffer(b"".join(parts), kind), np.array([len(x) for x in parts], np.int64) // np.dtype(kind).itemsize


KEYS = "bucket int, home long, blocks binary, probes binary"
HITS = "at long, bucket int, keys binary"


def _sent(batches: DataFrame, length: int, block: int, buckets: int) -> DataFrame:
    """Step 2, from the batches: each bucket's keys of reference blocks and of other rolling windows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in rows:
            for home, ids, texts in zip(batch["home"], batch["ids"], batch["texts"], strict=True):
                home, w = home.as_py(), Windows(ids.as_py(), texts.as_py(), length, block, powers)  # one row's texts at a time
                keys, at = w.probes()
                aligned = w.within[at] % block == 0
                blocks, probes = np.unique(keys[aligned]), np.unique(keys[~aligned])
                both = np.concatenate([blocks, probes])
                is_block = np.arange(len(both)) < len(blocks)
                out = []
                for bucket, (k, b) in _dealt((both % U(buckets)).astype(np.int32), (both >> U(32)).astype(np.uint32), is_block):
                    out.append((bucket, home, k[b].tobytes(), np.setdiff1d(k[~b], k[b]).tobytes()))
                yield from _table(out, KEYS).to_batches()

    return batches.select("home", "ids", "texts").mapInArrow(run, KEYS)


def _hits(sent: DataFrame) -> DataFrame:
    """Step 2, in the buckets: the keys that several batches have, one of them as a block."""

    def run(table: pa.Table) -> pa.Table:
        blocks, n_blocks = _whole(table, "blocks", np.uint32)
        probes, n_probes = _whole(table, "probes", np.uint32)
        homes = np.arange(len(table))
        keys, home = np.concatenate([blocks, probes]), np.concatenate([np.repeat(homes, n_blocks), np.repeat(homes, n_probes)])
        block = np.arange(len(keys)) < len(blocks)
        order = np.argsort(keys, kind="stable")
        keys, home, block = keys[order], home[order], block[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(keys)])
        met = (np.minimum.reduceat(home, starts) < np.maximum.reduceat(home, starts)) & np.maximum.reduceat(block, starts) if len(starts) else np.zeros(0, bool)
        hit = np.repeat(met, sizes)
        names, bucket = table["home"].to_pylist(), table["bucket"][0].as_py()
        return _table([(names[h], bucket, k.tobytes()) for h, (k,) in _dealt(home[hit], keys[hit])], HITS)

    return sent.groupBy("bucket").applyInArrow(run, HITS)


EXTENDED = "bucket long, home long, docs binary, counts binary, first binary, second binary, places binary"
VERDICTS = "at long, runs binary, places binary"


def _extended(batches: DataFrame, hits: DataFrame, length: int, block: int, buckets: int) -> DataFrame:
    """Step 3, from the batches: the windows around hits by bucket, and runs of settled windows on their way home (bucket below 0)."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        powers, out = Powers(), []
        for home, ids, own in zip(texts["home"].to_pylist(), texts["ids"].to_pylist(), texts["texts"].to_pylist(), strict=True):
            w = Windows(ids, own, length, block, powers)
            gone = w.places[w.settled]
            if len(gone):
                edge = np.flatnonzero(np.diff(gone) > 1)
                runs = np.stack([gone[np.r_[0, edge + 1]], gone[np.r_[edge, len(gone) - 1]]], 1)
                out.append((-1 - home, home, None, None, runs.astype(np.uint32).tobytes(), None, None))
            keys, n = _whole(found, "keys", np.uint32)
            if not len(keys):
                continue
            wanted = (np.repeat(np.array(found["bucket"].to_pylist(), U), n) << U(32)) | keys
            own_keys, at = w.probes()
            hit = np.zeros(len(w.flat) + 1, np.int64)
            hit[at[np.isin(((own_keys % U(buckets)) << U(32)) | (own_keys >> U(32)), wanted)] + 1] = 1
            before = np.cumsum(hit)  # hits before each place
            near = (before[w.places + length - block + 1] > before[w.places]) & ~w.settled
            place, first, second = w.places[near], w.first[near], w.second[near]
            for bucket, (p, a, b) in _dealt((first % U(buckets)).astype(np.int32), place, first, second):
                docs, counts = np.unique(w.doc[p], return_counts=True)  # ascending, as the places
                out.append((bucket, home, docs.tobytes(), counts.astype(np.uint32).tobytes(), a.tobytes(), b.tobytes(), p.astype(np.uint32).tobytes()))
        return _table(out, EXTENDED)

    return batches.select("home", "ids", "texts").groupBy("home").cogroup(hits.groupBy("at")).applyInArrow(run, EXTENDED)


def _judged(extended: DataFrame) -> DataFrame:
    """Step 3, in the buckets: places of the windows that a document with a smaller id has too."""

    def run(table: pa.Table) -> pa.Table:
        names = table["home"].to_pylist()
        if table["bucket"][0].as_py() < 0:
            return _table([(h, r, None) for h, r in zip(names, table["first"].to_pylist(), strict=True)], VERDICTS)
        docs, _ = _whole(table, "docs", np.int64)
        counts, _ = _whole(table, "counts", np.uint32)
        first, n = _whole(table, "first", U)
        second, places = _whole(table, "second", np.uint32)[0], _whole(table, "places", np.uint32)[0]
        doc, home = np.repeat(docs, counts), np.repeat(np.arange(len(table)), n)
        order = np.lexsort((doc, second, first))
        doc, first, second = doc[order], first[order], second[order]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = order[doc > doc[head]]
        return _table([(names[h], None, p.tobytes()) for h, (p,) in _dealt(home[later], places[later])], VERDICTS)

    return extended.groupBy("bucket").applyInArrow(run, VERDICTS)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _removed(batches: DataFrame, verdicts: DataFrame, length: int, with_kept: bool) -> DataFrame:
    """Step 4."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        runs = _whole(found, "runs", np.uint32)[0].astype(np.int64).reshape(-1, 2)
        n = runs[:, 1] - runs[:, 0] + 1
        starts = [np.repeat(runs[:, 0] - np.cumsum(n) + n, n) + np.arange(n.sum()), _whole(found, "places", np.uint32)[0].astype(np.int64)]
        out: dict[str, list] = {x.split()[0]: [] for x in RESULT.split(", ")} | ({"kept": []} if with_kept else {})
        for ids, own in zip(texts["ids"].to_pylist(), texts["texts"].to_pylist(), strict=True):
            cut = [_words(t) for t in own]
            placed = sorted((k for k, doc in enumerate(ids) if doc is not None and len(cut[k]) >= length), key=lambda k: ids[k])
            total = sum(len(cut[k]) for k in placed)
            hit, at, lost = cover(total, np.concatenate(starts), length), 0, {}
            for k in placed:
                lost[k] = hit[at : at + len(cut[k])]
                at += len(cut[k])
            for k, (doc, words) in enumerate(zip(ids, cut, strict=True)):
                gone = int(lost[k].sum()) if k in lost else 0
                kept = b" ".join(w for w, x in zip(words, lost[k].tolist(), strict=True) if not x) if gone else b" ".join(words)
                row = (doc, len(words), gone, hashlib.sha256(kept).hexdigest())
                for c, v in zip(out, (*row, kept.decode("utf-8", "surrogatepass")) if with_kept else row, strict=True):
                    out[c].append(v)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=False)})

    schema = RESULT + (", kept string" if with_kept else "")
    return batches.select("home", "ids", "texts").groupBy("home").cogroup(verdicts.groupBy("at")).applyInArrow(run, schema)


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_kept: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and with_kept the words that remain, joined by one space."""
    block = (length + 1) // 2
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    batches = written(_batched(own, batch_bytes), "batches", group_rows=1)
    size = batches.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(BUCKETS, math.ceil(size / BUCKET_BYTES))
    hits = written(_hits(_sent(batches, length, block, buckets)), "hits")
    verdicts = written(_judged(_extended(batches, hits, length, block, buckets)), "verdicts")
    forget(hits)
    return _removed(batches, verdicts, length, with_kept)
