"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Texts and items are read as UTF-8 bytes, A-Z lower-cased, and cut into words of letters, digits and
non-ASCII bytes. Each run of ``window`` item words (or a shorter item as a whole) is a pattern between
spaces; a text's words joined by spaces are scanned once. Matches are mapped to word places, and to
code-point offsets of the original text.

The automaton holds at most ``max_words`` item words, so that what is broadcast has a fixed bound. More
items are dealt into blocks of that size by hash and each block passes over the texts in turn, so every
item counts at any number of items.

Defined results: null or wordless texts have no words and are clean; null or wordless items match
nothing; items with equal windows are all named; repeated rows stay repeated; input columns with the
names of results are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import written

WINDOW = 13
MAX_WORDS = 100_000
#: Bytes of words as they are, A-Z lower-cased; all others become spaces.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS = "array<struct<start:int,end:int>>"
FOUND = {"n_words": "long", "hits": SPANS, "items": "array<string>", "spans": SPANS}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def windows(items: list[tuple[str, str | None]], window: int) -> dict[str, tuple[int, list[str]]]:
    """Pattern to (number of words, ids of the items that hold it)."""
    out: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        words = words_of(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            ids = out.setdefault((b" " + b" ".join(words[i : i + k]) + b" ").decode("latin-1"), (k, []))[1]
            if item not in ids[-1:]:
                ids.append(item)
    return out


def _merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _offsets(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets of runs of words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw)]
    starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    return [(int(starts[at[a][0]]) - 1, int(starts[at[b - 1][1] - 1])) for a, b in hits]


def _scan(docs: DataFrame, items: list[tuple[str, str | None]], text: str, window: int) -> DataFrame:
    """docs with FOUND, added to what earlier blocks found."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        patterns = windows(sent.value, window)
        automaton = ahocorasick.Automaton()
        for p, (k, ids) in patterns.items():
            automaton.add_word(p, (len(p), k, ids))
        if patterns:
            automaton.make_automaton()
        kinds = {"n_words": pa.int64(), "items": pa.list_(pa.string())} | dict.fromkeys(("hits", "spans"), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        for batch in batches:
            new: dict[str, list] = {k: [] for k in FOUND}
            for i, t in enumerate(batch[text]):
                t = t.as_py()
                words = words_of(t)
                hits, ids, spans = ([(x["start"], x["end"]) for x in batch["hits"][i].as_py()], set(batch["items"][i].as_py()), None) if "hits" in batch.schema.names else ([], set(), None)
                if words and patterns:
                    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
                    if matches := list(automaton.iter(line)):
                        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                        first = np.searchsorted(gaps, [end + 1 - n for end, (n, _, _) in matches]).tolist()
                        hits = _merged(hits + [(a, a + k) for a, (_, (_, k, _)) in zip(first, matches, strict=True)])
                        ids |= {x for _, (_, _, own) in matches for x in own}
                spans = _offsets(t, hits) if hits else []
                for k, v in (("n_words", len(words)), ("hits", [{"start": a, "end": b} for a, b in hits]), ("items", sorted(ids)), ("spans", [{"start": a, "end": b} for a, b in spans])):
                    new[k].append(v)
            rest = [(n, batch[n]) for n in batch.schema.names if n not in FOUND]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(new[k], kinds[k]) for k in FOUND], [n for n, _ in rest] + list(FOUND))

    own = docs.drop(*FOUND)
    return docs.mapInArrow(scan, own.select("*", *(F.lit(None).cast(t).alias(k) for k, t in FOUND.items())).schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """docs with n_words, hits (merged runs of hit words), items (ids found, sorted as strings) and spans (hits as code points)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x80-\x{10ffff}]+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / max_words))
    out = docs.drop(*FOUND)
    for b in range(blocks):
        if b:
            out = written(out, "decontaminated")  # one pass at a time holds an automaton
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        out = _scan(out, [tuple(r) for r in block.collect()], text, window)
    return out


def judged(found: DataFrame) -> DataFrame:
    """found with n_hit, n_items, items_sha256 and contaminated: a twentieth or more of the words are hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return found.withColumns({
        "n_hit": n_hit,
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
    }).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for op4: windows of texts joined to windows of items."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, k, array_to_string(w[s:s+k-1], ' ') AS g
  FROM (SELECT item, w, least({window}, len(w)) AS k, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM p),
o AS (
  SELECT doc_id, s, k, array_to_string(w[s:s+k-1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, k WHERE len(w) >= k)),
m AS (SELECT o.doc_id, o.s, o.k, p.item FROM o JOIN p ON o.k = p.k AND o.g = p.g),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""
