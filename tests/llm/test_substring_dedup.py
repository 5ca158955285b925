"""Removal of repeated passages against brute force."""

import hashlib
import random
import re

import pytest

from lodestream.llm import substring_dedup


def brute(rows, length):
    cut = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in cut:
        for k in range(len(w) - length + 1 if d is not None else 0):
            least[tuple(w[k : k + length])] = min(least.get(tuple(w[k : k + length]), d), d)
    out = []
    for d, w in cut:
        gone = set()
        for k in range(len(w) - length + 1 if d is not None else 0):
            if least[tuple(w[k : k + length])] < d:
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "batch_bytes"), [(50, 3000), (50, 1 << 20), (7, 200), (2, 100)])
def test_against_brute_force(spark, length, batch_bytes):
    """Passages of a window, a word more and less, and several; few and many batches."""
    r = random.Random(length)
    passages = [[str(r.randrange(300)) for _ in range(n)] for n in (length, length + 1, length // 2 + 1, 2 * length, 3 * length)]
    rows = []
    for d in range(120):
        words = []
        for _ in range(r.randrange(6)):
            words += r.choice(passages) if r.random() < 0.4 else [str(r.randrange(300)) for _ in range(r.randrange(60))]
        rows.append((d, " \n".join(words)))
    rows += [(7, rows[50][1]), (None, rows[3][1]), (None, None), (400, None), (401, ""), (402, "  \t\x0b"), (403, "ab " * 500), (404, "ab " * 500)]
    rows += [(405, rows[20][1])] * 2 + [(-3, rows[30][1]), (406, "Ünï cödé   𝄞 " * 60), (407, "Ünï cödé   𝄞 " * 60)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "own", "own") for x in rows], "doc_id long, text string, home string, n_words string").repartition(5)
    got = substring_dedup.remove_passages(df, length=length, batch_bytes=batch_bytes)
    want = brute(rows, length)
    assert sum(x[2] for x in want) > 1000
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_kept_words_and_empty_table(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, passage), (2, f"before {passage}\n after")], "doc_id long, text string")
    got = {x.doc_id: x.kept for x in substring_dedup.remove_passages(df, with_kept=True).collect()}
    assert got == {1: passage, 2: "before after"}
    assert substring_dedup.remove_passages(df.limit(0)).count() == 0


def test_a_passage_in_every_document(spark):
    """Documents of one passage with different words around it: the passage goes from all but the first."""
    passage = " ".join(f"w{k}" for k in range(55))
    rows = [(d, f"a{d} {passage} b{d} c{d}") for d in range(3000)]
    got = substring_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(20), batch_bytes=20_000)
    assert {(x.n_removed, x.n) for x in got.groupBy("n_removed").agg({"*": "count"}).toDF("n_removed", "n").collect()} == {(0, 1), (55, 2999)}


def test_a_task_reads_one_batch_at_a_time(spark, monkeypatch):
    """Row groups are read whole, so a file of many batches holds each in a row group of its own."""
    import pyarrow.parquet as pq

    tables = {}
    monkeypatch.setattr(substring_dedup, "written", lambda df, tag, *a, f=substring_dedup.written, **b: tables.setdefault(tag, f(df, tag, *a, **b)))
    rows = [(d, " ".join(f"w{d}x{k}" for k in range(200))) for d in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert substring_dedup.remove_passages(df, batch_bytes=10_000).count() == 150
    groups = [pq.ParquetFile(x.removeprefix("file:")).metadata for x in tables["batches"].inputFiles()]
    sizes = [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)]
    assert len(sizes) > 10 and max(sizes) == 1
