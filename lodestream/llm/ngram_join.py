"""N-gram Jaccard join by prefix trees, and the components of near duplicates.

A document's set holds its distinct word shingles as 64-bit hashes. Two sets of Jaccard similarity t or more
share a member among the first (n - ceil(t*n) + 1) of each in any global order; with ``extra`` more in each they
share 1 + extra, for the smaller of their extras. Steps:

1. One pass emits each set's first members in hash order, dealt by member into buckets as packed arrays. Exact
   copies within a task are emitted once, and once a bucket after the shuffle.
2. A member that over ``hot`` sets hold pairs nobody here. A set with at most as many hot members among its
   first as its smallest partner has extra ones shares a cold one with each partner, so all its links are among
   the pairs of cold members, whose number is linear. Parity bitmaps, folded to one length, bound the sets' difference from below and drop
   pairs that cannot link.
3. Sets with more hot members (large groups of near copies, short texts around a common line) are joined among
   themselves in a global order by exact frequency, rarest first, so that common passages stand behind the prefix.
   Each member's group first links to two of its sets (stars, linear in the group); only pairs of sets that are
   still in different components are looked at next.
4. Candidates of one probe set are stored in a prefix tree over the globally ordered sets. Its traversal carries
   the overlap of the shared path and leaves a subtree as soon as the overlap so far and the members that remain on
   either side can't reach what the similarity asks for.

Probes with many candidates are dealt into blocks. Nothing is capped: hot members and groups only take the other way.

Defined results: no text or no words gives an empty set, linked with nothing and its own component; under
``words`` words the whole sequence is the one shingle; a null id has a null component; rows that repeat an id are
one document, with the links of all its texts, and each row has the size of its own set. Columns other than the id and the text are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.plans.components import connected_components
from lodestream.session import written

WORDS = 5
PERCENT = 80  # similarity in hundredths
HOT = 16
BLOCK = 256
SKETCH = 512  # bits of the bitmaps that the last join compares
BUCKETS = 64
BUCKET_BYTES = 8 << 20
HELD = 1_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are what ASCII white space separates, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest

    cut = [t.encode("utf-8", "surrogatepass").translate(LOWER).split() if t else [] for t in texts]
    sizes = [len(w) for w in cut]
    flat = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(cut)), U, sum(sizes))
    odd = [(2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(words)]
    grams = np.zeros(max(len(flat) - words + 1, 0), U)
    for k in range(words if len(grams) else 0):
        grams = grams * U(odd[1]) + flat[k : k + len(grams)] * U(odd[k])
    grams = _mix(grams)
    out, at = [], 0
    for n in sizes:
        if n >= words:
            out.append(np.unique(grams[at : at + n - words + 1]))
        elif n:
            whole = U(n)
            for h in flat[at : at + n]:
                whole = _mix(np.array([int(whole) * odd[1] % (1 << 64)], U) + h)[0]
            out.append(np.array([whole], U))
        else:
            out.append(np.zeros(0, U))
        at += n
    return out


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def extra_size(n: int, percent: int = PERCENT) -> int:
    """How many members more than the prefix are emitted."""
    return min(n - prefix_size(n, percent), prefix_size(n, percent) // 4 + 1)


def bitmap(members: np.ndarray) -> bytes:
    """Parity of the members by place, in a power of two of bits that follows the size; a half folds onto the other by xor."""
    bits = 1 << max(8, (2 * len(members)).bit_length() - 1)
    count = np.bincount((members & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").tobytes()


def sketch(members: np.ndarray) -> np.ndarray:
    """The parity bitmap of SKETCH bits as signed 64-bit words."""
    count = np.bincount((members & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").view(np.int64)


def may_link(n: int, m: int, a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """False only if the bitmaps prove more difference than the similarity allows."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    differ = int(np.unpackbits(x ^ y).sum())
    return (100 + percent) * differ <= (100 - percent) * (n + m)


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    return -(-percent * (n + m) // (100 + percent))


# 1: one pass over the texts

EMITTED = "doc_id long, n long, high long, low long, bits binary, bucket int, docs binary, sizes binary, prints binary, counts binary, members binary"


def _emit(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        schema = pa.schema([(k, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for k, t in (x.split() for x in EMITTED.split(", "))])
        seen: set[int] = set()
        held: list[tuple[int, int, int, np.ndarray]] = []
        total = 0

        def blobs() -> pa.RecordBatch:
            doc, size, prints = (np.array([h[k] for h in held], kind) for k, kind in ((0, np.int64), (1, np.uint32), (2, U)))
            members = np.concatenate([h[3] for h in held]) if held else np.zeros(0, U)
            owner = np.repeat(np.arange(len(held)), [len(h[3]) for h in held])
            deal = (_mix(members) % U(buckets)).astype(np.int32)
            order = np.argsort(deal, kind="stable")
            deal, owner, members = deal[order], owner[order], members[order]
            edges = np.flatnonzero(np.diff(deal)) + 1
            rows: list[tuple] = []
            for lo, hi in zip([0, *edges], [*edges, len(deal)], strict=True) if len(deal) else ():
                own, n = np.unique(owner[lo:hi], return_counts=True)
                rows.append((int(deal[lo]), doc[own].tobytes(), size[own].tobytes(), prints[own].tobytes(), n.astype(np.uint32).tobytes(), members[lo:hi].tobytes()))
            none = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(none, schema.field(k).type) for k in range(5)] + [pa.array([r[k] for r in rows], schema.field(5 + k).type) for k in range(6)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = part["doc_id"].to_pylist()
                sets = shingle_sets(part["text"].to_pylist(), words)
                prints = [xxh3_128_intdigest(s.tobytes()) for s in sets]
                cols = [ids, [len(s) for s in sets], [(p >> 64) - (1 << 63) for p in prints], [(p & (1 << 64) - 1) - (1 << 63) for p in prints], [bitmap(s) for s in sets]]
                none = [None] * len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, *[none] * 6], schema, strict=True)], schema=schema)
                for doc, s, p in zip(ids, sets, prints, strict=True):
                    if len(s) and doc is not None and p not in seen:
                        seen.add(p)
                        first = s[: prefix_size(len(s), percent) + extra_size(len(s), percent)]
                        held.append((doc, len(s), p & (1 << 64) - 1, first))
                        total += len(first)
                if total >= HELD:
                    yield blobs()
                    held.clear()
                    total = 0
        yield blobs()

    return docs.mapInArrow(run, EMITTED)


# 2: buckets

GROUPED = "a long, b long, doc long, hot long"


def _paired(emitted: DataFrame, percent: int, hot: int) -> DataFrame:
    """Pairs (a, b) of sets that share a cold member, and (doc, hot): how many hot members of the bucket a set has."""

    def run(table: pa.Table) -> pa.Table:
        def whole(k: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(table[k].to_pylist()), kind)

        doc, size, prints, counts, members = whole("docs", np.int64), whole("sizes", np.uint32).astype(np.int64), whole("prints", U), whole("counts", np.uint32), whole("members", U)
        owner = np.repeat(np.arange(len(doc)), counts)
        order = np.lexsort((doc[owner], prints[owner], members))
        owner, members = owner[order], members[order]
        same = np.zeros(len(members), bool)  # copies of one set from several tasks: the smallest id stays
        same[1:] = (members[1:] == members[:-1]) & (prints[owner[1:]] == prints[owner[:-1]]) & (size[owner[1:]] == size[owner[:-1]])
        owner, members = owner[~same], members[~same]
        starts = np.flatnonzero(np.r_[True, members[1:] != members[:-1]]) if len(members) else np.zeros(0, np.int64)
        group = np.diff(np.r_[starts, len(members)])
        of = np.repeat(group, group)
        is_hot = of > hot
        cold = (of > 1) & ~is_hot
        m, w = members[cold], doc[owner[cold]]
        n = size[owner[cold]]
        found = []
        for step in range(1, hot):
            near = np.flatnonzero(m[step:] == m[:-step]) if len(m) > step else np.zeros(0, np.int64)
            if not len(near):
                break
            a, b, p, q = w[near], w[near + step], n[near], n[near + step]
            ok = (100 * np.minimum(p, q) >= percent * np.maximum(p, q)) & (a != b)
            found.append(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        heated, times = np.unique(doc[owner[is_hot]], return_counts=True)
        gap = pa.nulls(len(heated), pa.int64()), pa.nulls(len(pairs), pa.int64())
        return pa.table({
            "a": pa.chunked_array([pa.array(pairs[:, 0]), gap[0]]), "b": pa.chunked_array([pa.array(pairs[:, 1]), gap[0]]),
            "doc": pa.chunked_array([gap[1], pa.array(heated)]), "hot": pa.chunked_array([gap[1], pa.array(times.astype(np.int64))]),
        })

    blobs = emitted.where("bucket IS NOT NULL").select("bucket", "docs", "sizes", "prints", "counts", "members")
    return blobs.groupBy("bucket").applyInArrow(run, GROUPED)


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bitmaps don't rule out."""

    @F.pandas_udf("boolean")
    def keep(n: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([may_link(*x, percent) for x in zip(n, m, a, b, strict=True)], dtype=bool)

    for side in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs.where(keep("n_a", "n_b", "bits_a", "bits_b")).select("a", "b")


# 4: prefix trees


def tree_join(probe: list[int], sets: list[list[int]], percent: int = PERCENT) -> list[int]:
    """Places of the sets that link with the probe. All are sorted in one global order, as ranks or hashes.

    The tree is kept as the sets in sorted order: a run of them that agrees on its first members is a node. A node's
    path is walked once for all of its sets.
    """
    order = sorted(range(len(sets)), key=sets.__getitem__)
    place = {x: i for i, x in enumerate(probe)}
    n, found = len(probe), []
    # node: its sets [lo, hi), its depth, the overlap of its path, and how many probe members may still come
    stack = [(0, len(order), 0, 0, n)]
    while stack:
        lo, hi, depth, overlap, left = stack.pop()
        first, last = sets[order[lo]], sets[order[hi - 1]]
        sizes = [len(sets[order[i]]) for i in range(lo, hi)]
        shortest, longest = min(sizes), max(sizes)
        need, dead = least_overlap(n, shortest, percent), False
        while depth < len(first) and depth < len(last) and first[depth] == last[depth]:
            at = place.get(first[depth])
            if at is not None:
                overlap += 1
                left = n - 1 - at
            depth += 1
            if overlap + min(left, longest - depth) < need:
                dead = True
                break
        if dead:
            continue
        i = lo
        while i < hi and len(sets[order[i]]) == depth:  # sets that end here sort first
            m = depth
            if 100 * overlap >= percent * (n + m - overlap):
                found.append(order[i])
            i += 1
        while i < hi:
            j, step = i + 1, sets[order[i]][depth]
            while j < hi and sets[order[j]][depth] == step:
                j += 1
            stack.append((i, j, depth, overlap, left))
            i = j
    return found


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b) that link, by prefix trees: one for each probe a and block of its candidates."""
    many = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / block).alias("blocks"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("part"))
    own = dealt.join(sets.select(F.col("doc_id").alias("b"), "members"), "b")
    keys = dealt.select(F.col("a").alias("doc_id"), F.col("part").alias("probe_part")).distinct()
    probes = keys.join(sets.select("doc_id", F.col("members").alias("probe")), "doc_id").withColumnRenamed("doc_id", "probe_a")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        probe = np.frombuffer(right["probe"][0].as_py(), U).tolist()
        ids = left["b"].to_pylist()
        # more common members have no place of their own here; hash order is the global one
        got = tree_join(probe, [np.frombuffer(x, U).tolist() for x in left["members"].to_pylist()], percent)
        a = left["a"][0].as_py()
        return pa.table({"a": pa.array([a] * len(got), pa.int64()), "b": pa.array([ids[i] for i in got], pa.int64())})

    return own.groupBy("a", "part").cogroup(probes.groupBy("probe_a", "probe_part")).applyInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id, n, members (sorted hashes) and sketch of the documents whose id is among ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = shingle_sets(part["text"].to_pylist(), words)
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], ["doc_id", "n", "members", "sketch"])

    return docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, n long, members binary, sketch array<long>")


# 3: sets with many hot members


def _hot_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(member, doc, n, pos): the first members of each set by exact frequency, rarest first, that another set holds too."""

    @F.pandas_udf("array<long>")
    def unpacked(s: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64) for x in s])

    rows = sets.select(F.col("doc_id").alias("doc"), "n", F.explode(unpacked("members")).alias("member"))
    often = rows.groupBy("member").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(often, "member", "left").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "member"))).alias("all"))
    first = F.expr(f"slice(all, 1, int(n - (n * {percent} + 99) div 100 + 1))")
    out = ranked.select("doc", "n", F.posexplode(first).alias("pos", "x"))
    return out.where("x.df > 1").select(F.col("x.member").alias("member"), "doc", "n", F.col("pos").cast("long").alias("pos"))


def _bounded(a: str, b: str, percent: int) -> str:
    """SQL: sizes, and the places of a shared member, allow a link. True at the first member that linked sets share."""
    return f"""100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND
        {100 + percent} * (1 + least({a}.pos, {b}.pos) + least({a}.n - {a}.pos, {b}.n - {b}.pos) - 1) >= {percent} * ({a}.n + {b}.n)"""


def _stars(first: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member's sets with two of them: the most central one (the least place: fewest rare members) and one
    by hash, another for each member, so that a group of near copies grows together."""
    row = F.struct("pos", "doc", "n")
    centres = first.groupBy("member").agg(F.min(row).alias("c"), F.min_by(row, F.xxhash64("member", "doc")).alias("d")).select("member", F.explode(F.array("c", "d")).alias("c"))
    centres = centres.select("member", F.col("c.pos").alias("pos"), F.col("c.doc").alias("doc"), F.col("c.n").alias("n"))
    both = first.alias("x").join(centres.alias("c"), "member").where("x.doc <> c.doc").where(F.expr(_bounded("x", "c", percent)))
    return both.select(F.col("c.doc").alias("a"), F.col("x.doc").alias("b")).distinct()


def _across(first: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that share a member of both prefixes, are in different components so far, and whose sketches allow a
    link. The sketches stand in the join's condition: pairs without a chance are never made."""
    own = first.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")
    mixed = own.groupBy("member").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("member")
    own = own.join(mixed, "member", "left_semi").join(sets.select(F.col("doc_id").alias("doc"), "sketch"), "doc")
    own = written(own, "mixed")
    differ = " + ".join(f"bit_count(x.sketch[{k}] ^ y.sketch[{k}])" for k in range(SKETCH // 64))
    near = f"x.label < y.label AND {_bounded('x', 'y', percent)} AND {100 + percent} * ({differ}) <= {100 - percent} * (x.n + y.n)"
    both = own.alias("x").join(own.alias("y"), F.expr(f"x.member = y.member AND {near}"))
    return both.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def _numbered(own: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """own with one id a text, and (doc_id, node) of the further texts of an id: they are numbered past all ids.

    Only where ids repeat do texts move; an id with a third of all rows is met by partial aggregation.
    """
    several = own.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    several = written(several, "several")
    if several.isEmpty():
        return own, None
    marked = own.withColumn("mark", F.md5(F.coalesce("text", F.lit(""))))
    marks = marked.join(several, "doc_id", "left_semi").select("doc_id", "mark").distinct()
    heads = marks.groupBy("doc_id").agg(F.min("mark").alias("head"))
    past = (own.agg(F.max("doc_id")).first()[0] or 0) + 1
    further = marks.join(heads, "doc_id").where("mark <> head").select("doc_id", "mark", (F.lit(past) + F.monotonically_increasing_id()).alias("node"))
    further = written(further, "further")
    own = marked.join(further, ["doc_id", "mark"], "left").select(F.coalesce("node", "doc_id").alias("doc_id"), "text")
    return own, further.select("doc_id", "node")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own, further = _numbered(own)
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(BUCKETS, math.ceil(size / 6 * 0.25 * 20 / BUCKET_BYTES))  # a word in 6 characters, a quarter emitted, 20 bytes each
    emitted = written(_emit(own, words, percent, buckets), "emitted")
    rows = emitted.where("bucket IS NULL").select("doc_id", "n", "high", "low", "bits")
    grouped = written(_paired(emitted, percent, hot), "grouped")
    known = rows.where("doc_id IS NOT NULL").select("doc_id", "n", "bits").dropDuplicates(["doc_id"])

    cold = written(_possible(grouped.where("a IS NOT NULL").select("a", "b").distinct(), known, percent), "cold")
    # a partner may be as small as percent of n, and has fewer extra members then
    heated = grouped.where("doc IS NOT NULL").groupBy(F.col("doc").alias("doc_id")).agg(F.sum("hot").alias("hot"))
    heated = heated.join(known.select("doc_id", "n"), "doc_id").withColumn("m", F.expr(f"(n * {percent} + 99) div 100")).withColumn("p", F.expr(f"m - (m * {percent} + 99) div 100 + 1"))
    heated = written(heated.where("hot > least(m - p, p div 4 + 1)").select("doc_id"), "heated")
    needed = cold.select(F.col("a").alias("doc_id")).union(cold.select(F.col("b").alias("doc_id"))).union(heated).distinct()
    sets = written(_sets(own, needed, words), "sets").dropDuplicates(["doc_id"])

    if heated.isEmpty():
        links = written(_linked(cold, sets, percent), "links")
    else:
        first = written(_hot_prefixes(sets.join(heated, "doc_id", "left_semi"), percent), "first")
        stars = _possible(_stars(first, percent), known, percent)
        links = written(_linked(cold.unionByName(stars).distinct(), sets, percent), "links")
        more = _possible(_across(first, connected_components(links), sets, percent), known, percent)
        links = links.unionByName(written(_linked(more, sets, percent), "links"))

    # exact copies share a class, known by its smallest id
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("high", "low").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    member = rows.where("n > 0 AND doc_id IS NOT NULL").join(classes.where("copies > 1"), ["high", "low"]).where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    links = links.unionByName(member)
    if further is not None:
        links = links.unionByName(further.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    labels = connected_components(links)
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    if further is None:
        return out
    out = out.join(further.select(F.col("doc_id").alias("own"), F.col("node").alias("doc_id")), "doc_id", "left")
    return out.select(F.coalesce("own", "doc_id").alias("doc_id"), "n_shingles", "component_id")
