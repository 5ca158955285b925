"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character 1- to 3-grams of a language, most frequent first. A document's
own list is compared to each profile by out-of-place distance: the sum of the differences of ranks, with
the profile's length for an n-gram that the profile lacks. The language at the least distance wins; ties go
to the name that sorts first. Texts are lower-cased; whatever is not a letter separates words, and n-grams
may hold the gap at a word's edge. Code points are packed into one 64-bit number an n-gram.

Defined results: null text, or text without a letter, gives ``und`` with score 0, as does every text if
nothing was learned. A null id belongs to no fold: it is neither learned from nor held out. Whole texts
count, of any length. Repeated rows stay repeated.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE_SIZE = 400
MAX_LANGUAGES = 1000  # bounds the broadcast profiles: MAX_LANGUAGES * PROFILE_SIZE entries
FOLDS = 5
GAP = np.uint64((1 << 21) - 1)  # no code point
HELD_GRAMS = 1_000_000  # n-grams that a task holds before it counts them
MIN_SCORE = 0.05  # below it the pipeline takes a text for no language that was learned


@functools.cache
def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams_of(text: str | None) -> np.ndarray:
    """Every 1- to 3-gram of the text, packed; empty without letters."""
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[~_letters()[points]] = 0
    points = points[np.flatnonzero((points[1:] != 0) | (points[:-1] != 0))] if len(points) > 1 else points
    points = np.append(points, np.uint64(0))  # each gap is one zero now, at both ends too
    letter = points != 0
    points = np.where(letter, points, GAP)  # so that a letter after a gap isn't the letter alone
    two = (points[:-1] << np.uint64(21)) | points[1:]
    three = (two[:-1] << np.uint64(21)) | points[2:]
    # n-grams across a gap say nothing of a word
    return np.concatenate([points[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by the packed number."""
    values, counts = np.unique(grams, return_counts=True)
    if len(values) > size:  # only what can be among the first
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.argsort(-counts, kind="stable")][:size]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """How often each n-gram occurs in each language, over all rows: (lang, gram, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for t, name in zip(batch["t"], batch["lang"], strict=True):
                found = grams_of(t.as_py())
                waiting.setdefault(name.as_py(), []).append(found)
                held += len(found)
                if held >= HELD_GRAMS:  # bounded memory at any batch size
                    _fold(kept, waiting)
                    held = 0
                    if sum(len(v) for v, _ in kept.values()) > HELD_GRAMS:
                        yield from _counted(kept)
                        kept.clear()
        _fold(kept, waiting)
        yield from _counted(kept)

    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("lang")).where("t IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _fold(kept: dict[str, tuple[np.ndarray, np.ndarray]], waiting: dict[str, list[np.ndarray]]) -> None:
    """Add the n-grams that wait to the counts kept by language."""
    for name, found in waiting.items():
        values, n = np.unique(np.concatenate(found), return_counts=True)
        if name in kept:
            old, m = kept[name]
            both, at = np.unique(np.concatenate([old, values]), return_inverse=True)
            values, n = both, np.bincount(at, np.concatenate([m, n]), len(both))
        kept[name] = values, n.astype(np.int64)
    waiting.clear()


def _counted(kept: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for name, (values, n) in kept.items():
        if len(values):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """Profiles by language name. At most MAX_LANGUAGES * size numbers reach the driver; more languages are an error."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(docs, text, lang).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    rows = top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"]).alias("grams")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: their profiles are not broadcast")
    return {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in sorted(rows, key=lambda r: r["lang"])}


def distances(own: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[int]:
    """Out-of-place distance of a document's ranked n-grams to each profile, given as (sorted n-grams, their ranks)."""
    rank, out = np.arange(len(own)), []
    for grams, ranks in tables:
        at = np.minimum(np.searchsorted(grams, own), max(len(grams) - 1, 0))
        found = grams[at] == own if len(grams) else np.zeros(len(own), bool)
        out.append(int(np.where(found, np.abs(ranks[at] - rank), size).sum()) if len(grams) else size * len(own))
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """docs with lang_pred and score: 1 for a list that equals the profile, 0 for one that shares nothing with it."""
    own = docs.drop("lang_pred", "score")
    schema = own.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(sent.value)
        tables = [(g[(o := np.argsort(g))], o) for g in sent.value.values()]
        for batch in batches:
            langs, scores = [], []
            for t in batch[text]:
                mine = ranked(grams_of(t.as_py()), size)
                if not len(mine) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                far = distances(mine, tables, size)
                best = far.index(min(far))
                langs.append(names[best])
                scores.append(1.0 - far[best] / (size * len(mine)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return own.mapInArrow(predict, schema)


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score, learned from the labelled rows of the other folds."""
    held = F.coalesce(fold(F.col(doc_id)) == 0, F.lit(False))
    profiles = learn_profiles(docs.where(fold(F.col(doc_id)) != 0), text, lang)
    return identify(docs.withColumn("held_out", held), profiles, text)
