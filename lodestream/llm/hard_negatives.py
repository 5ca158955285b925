"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A row x becomes (x, sqrt(M - x.x)) with M the largest squared norm, and an anchor q becomes (q, 0): then the squared distance of
q and x is q.q + M - 2 q.x, so higher inner products are nearer rows and a window of scores is an annulus around the anchor.

1. Rows are dealt by (label, cell, hash of the id) into blocks of about ``block`` rows: a cell is a leaf of a small tree fitted on the ``SAMPLE`` rows with
   the smallest hash of their id, so a block holds neighbours of one label where there are enough. Each block
   becomes a vantage-point tree of all its rows, written once: a node knows the range of its rows' distances to its parent's vantage point and its smallest id.
2. Anchors go to all blocks, in parts of bounded size. In a block nodes are taken nearest first, bounded by the triangle inequality; a row that
   comes up is the next best of its block, ties by id. An anchor's best same-label rows of each block are merged into its positives.
3. Each positive's window of scores is an annulus. The traversal starts at its inner radius, leaves out nodes that lie wholly inside or outside, and
   ends with the first rows of another label. The blocks' finds are merged in the same order.

Bounds carry a margin over rounding and scores are whole numbers, so results are exact: no index is approximate, nothing is capped. Anchors against all rows
are a stated query set in blocks; each block keeps few rows an anchor, and merging ranks them in parts before it shuffles.

Defined results: rows with a null id, label or vector, or a component that is null or not finite take no part; shorter vectors end in zeros; rows
that repeat an id are rows of their own, and so are their anchors; an anchor without another row of its label, or a positive of negative score, gives no rows; an empty table gives none. Vectors
with a squared norm over 2**52 (after scaling), labels and ids that are no whole numbers stop the job. Other columns are not carried.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.vectors import finite, whole
from lodestream.session import written

POSITIVES, NEGATIVES, LOW, SCALE = 5, 5, 80, 256
BLOCK, PART, LEAF, SAMPLE, CELLS = 16_384, 4_096, 128, 4_096, 64


def augmented(x: np.ndarray, most: int) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])


def _apart(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - v) ** 2).sum(1))


class Tree:
    """Rows in the order of the tree's leaves, and its nodes.

    nodes: (start, end, vantage row, first child, smallest id) of each; the second child follows the first, and a leaf has child -1. ranges: each
    node's least and greatest distance to its parent's vantage point.
    """

    def __init__(self, order: np.ndarray, nodes: np.ndarray, ranges: np.ndarray) -> None:
        self.order, self.nodes, self.ranges = order, nodes, ranges

    @classmethod
    def of(cls, a: np.ndarray, ids: np.ndarray, leaf: int) -> Tree:
        order = np.arange(len(a))
        nodes, ranges = [[0, len(a), -1, -1, int(ids.min(initial=0))]], [(0.0, math.inf)]
        todo = [0]
        while todo:
            at = todo.pop()
            start, end = nodes[at][:2]
            if end - start <= leaf:
                continue
            own = order[start:end]
            vantage = own[np.argmax(_apart(a[own], a[own].mean(0)))]
            d = _apart(a[own], a[vantage])
            near = np.argsort(d, kind="stable")
            order[start:end], d, half = own[near], d[near], (end - start) // 2
            nodes[at][2:4] = int(vantage), len(nodes)
            for lo, hi in ((0, half), (half, end - start)):
                todo.append(len(nodes))
                nodes.append([start + lo, start + hi, -1, -1, int(ids[order[start + lo : start + hi]].min())])
                ranges.append((d[lo], d[hi - 1]))
        place = np.empty(len(a), np.int64)
        place[order] = np.arange(len(a))
        table = np.array(nodes, np.int64)
        inner = table[:, 3] >= 0
        table[inner, 2] = place[table[inner, 2]]
        return cls(order, table, np.array(ranges))


class Block:
    """A tree with its rows: ids, labels, uids (the rows' numbers) and vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, uids: np.ndarray, x: np.ndarray, nodes: np.ndarray, ranges: np.ndarray, most: int) -> None:
        self.ids, self.labels, self.uids, self.x, self.most = ids, labels, uids, x.astype(np.float64), most
        self.nodes, self.ranges = nodes.tolist(), ranges.tolist()
        inner = nodes[:, 2] >= 0
        self.slot = np.cumsum(inner) - 1  # of a node's vantage point among those
        self.vantage = augmented(x[nodes[inner, 2]], most)

    def best(self, q: np.ndarray, k: int, low: int | None, high: int | None, fits: np.ndarray, seen: dict[int, np.ndarray], far: np.ndarray, square: int) -> list[tuple[int, int, int]]:
        """The first k (score, id, place) in the window among the rows that fit, by score down, then id. far: the anchor's distances to the vantage points."""
        top = math.isqrt(square * self.most) + 1 if high is None else high
        heap: list[tuple[int, int, int, int]] = [(-top, self.nodes[0][4], 0, 0)]
        found: list[tuple[int, int, int]] = []
        while heap and len(found) < k:
            bound, least, is_row, at = heapq.heappop(heap)
            if is_row:
                found.append((-bound, least, at))
                continue
            start, end, _, child, _ = self.nodes[at]
            if child < 0:
                if at not in seen:
                    seen[at] = (self.x[start:end] @ q).astype(np.int64)
                scores = seen[at]
                own = fits[start:end].copy()
                if low is not None:
                    own &= (scores >= low) & (scores <= top)
                rows = np.flatnonzero(own)
                if len(rows) > k:  # no more than k rows of a leaf can count
                    rows = rows[np.lexsort((self.ids[start + rows], -scores[rows]))[:k]]
                for r in rows.tolist():
                    heapq.heappush(heap, (-int(scores[r]), int(self.ids[start + r]), 1, start + r))
                continue
            d = far[self.slot[at]]
            for c in (child, child + 1):
                near, wide = self.ranges[c]
                margin = 1e-6 + 1e-12 * (d + wide)
                inner, outer = max(d - wide, near - d, 0.0) - margin, d + wide + margin
                upper = min(top, math.floor((square + self.most - max(inner, 0.0) ** 2) / 2 + 1e-3))
                lower = (square + self.most - outer**2) / 2 - 1e-3
                if low is None or (upper >= low and lower <= top):
                    heapq.heappush(heap, (-upper, self.nodes[c][4], 0, c))
        return found


BLOCKS = "block int, n int, ids binary, labels binary, anchors binary, vectors binary, nodes binary, ranges binary"
ROW = "id long, label long, anchor boolean, cell int, vector binary"


def _cells(rows: DataFrame, scale: int, dim: int, most: int, cells: int) -> DataFrame:
    """The rows in whole numbers, with the leaf of a small tree that they fall into."""
    sample = rows.orderBy(F.xxhash64("id"), "id").select("id", "vector").limit(SAMPLE).toArrow()  # at most SAMPLE rows
    tree = vantage = None
    if cells > 1 and len(sample):
        a = augmented(whole(sample["vector"].combine_chunks(), scale, dim), most)
        tree = Tree.of(a, np.zeros(len(a), np.int64), max(1, len(a) // cells))
        vantage = a[tree.order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch["vector"], scale, dim)
            cell = np.zeros(len(x), np.int32)
            if tree is not None:
                a, todo = augmented(x, most), [(0, np.arange(len(x)))]
                while todo:
                    at, own = todo.pop()
                    _, _, v, child, _ = tree.nodes[at]
                    if child < 0 or not len(own):
                        cell[own] = at
                        continue
                    near = _apart(a[own], vantage[v]) <= tree.ranges[child][1]
                    todo += [(child, own[near]), (child + 1, own[~near])]
            columns = [batch["id"], batch["label"], batch["anchor"], pa.array(cell), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROW.split(", ")])

    return rows.mapInArrow(run, ROW)


def _indexed(rows: DataFrame, dim: int, most: int, blocks: int) -> DataFrame:
    """One block a partition, with its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if not sum(b.num_rows for b in own):
            return
        table = pa.Table.from_batches(own)
        ids, labels, anchors = (np.asarray(table[c], t) for c, t in (("id", np.int64), ("label", np.int64), ("anchor", bool)))
        x = np.frombuffer(b"".join(table["vector"].to_pylist()), np.int32).reshape(-1, dim)
        tree = Tree.of(augmented(x, most), ids, LEAF)
        packed = [v[tree.order].tobytes() for v in (ids, labels, anchors, x)] + [tree.nodes.tobytes(), tree.ranges.tobytes()]
        columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])

    dealt = rows.repartitionByRange(blocks, "label", "cell", F.xxhash64("id", "vector"))
    return dealt.select("id", "label", "anchor", "vector").mapInArrow(run, BLOCKS)


def _unpacked(row: dict, dim: int, most: int) -> Block:
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
    uids = (np.int64(row["block"]) << np.int64(32)) + np.arange(len(ids))
    return Block(ids, labels, uids, np.frombuffer(row["vectors"], np.int32).reshape(-1, dim), np.frombuffer(row["nodes"], np.int64).reshape(-1, 5), np.frombuffer(row["ranges"], np.float64).reshape(-1, 2), most)


ANCHOR = "uid long, id long, label long, vector binary"


def _anchors(index: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                ids, labels = (np.frombuffer(row[c], np.int64)[own] for c in ("ids", "labels"))
                x = np.frombuffer(row["vectors"], np.int32).reshape(-1, dim)[own]
                columns = [pa.array((row["block"] << 32) + own), pa.array(ids), pa.array(labels), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ANCHOR.split(", ")])

    return index.select("block", "ids", "labels", "anchors", "vectors").mapInArrow(run, ANCHOR)


FOUND = "uid long, anchor_id long, positive_uid long, positive_id long, positive_score long, found_uid long, found_id long, score long"


def _searched(index: DataFrame, queries: DataFrame, blocks: int, parts: int, dim: int, most: int, k: int, low: int | None) -> DataFrame:
    """Each block's best k rows for each query: rows of its label, or with low those of other labels in the windows of its positives."""
    sent = queries.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts))).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = index.drop("anchors").withColumn("own_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(own) and len(asked):
            block = _unpacked(own.to_pylist()[0], dim, most)
            held_labels = set(np.unique(block.labels).tolist())
            for a in asked.to_pylist():
                if a["label"] not in held_labels if low is None else held_labels == {a["label"]}:
                    continue
                q = np.frombuffer(a["vector"], np.int32).astype(np.float64)
                square, same = int(q @ q), block.labels == a["label"]
                far = np.sqrt(np.maximum(square + most - 2 * (block.vantage[:, :-1] @ q), 0))
                seen: dict[int, np.ndarray] = {}
                if low is None:
                    out += [(a["uid"], a["id"], None, None, None, int(block.uids[p]), i, s) for s, i, p in block.best(q, k, None, None, same & (block.uids != a["uid"]), seen, far, square)]
                    continue
                known: dict[int, list] = {}
                for w in a["windows"]:
                    score = w["score"]
                    if score not in known:  # 100 * negative >= low * positive, in whole numbers
                        known[score] = block.best(q, k, -(-low * score // 100), score, ~same, seen, far, square) if score >= 0 else []
                    out += [(a["uid"], a["id"], w["found_uid"], w["found_id"], score, int(block.uids[p]), i, s) for s, i, p in known[score]]
        return pa.table({c.split()[0]: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(FOUND.split(", "))})

    return held.groupBy("block", "own_part").cogroup(sent.groupBy("to", "part")).applyInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found_id", "found_uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(df: DataFrame, anchor: str, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: SQL for which rows are anchors; low: hundredths of the
    positive's score that a negative must reach."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.expr(anchor).alias("anchor"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite("vector")).withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * scale).cast("double") ** 2)
    n, most, dim, anchors = rows.agg(F.count("*"), F.max(norm), F.max(F.size("vector")), F.count_if("anchor")).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not anchors or not dim:
        return df.sparkSession.createDataFrame([], empty)
    if most > 1 << 52:
        raise ValueError(f"a squared norm of {most:.4g} (after scaling) is over 2**52")
    most, blocks, parts = int(most), math.ceil(n / block), math.ceil(anchors / PART)
    index = written(_indexed(_cells(rows, scale, dim, most, min(CELLS, blocks)), dim, most, blocks), "index")
    blocks = 1 + (index.agg(F.max("block")).first()[0] or 0)  # numbers of partitions
    queries = _anchors(index, dim)
    best = _ranked(_searched(index, queries, blocks, parts, dim, most, positives, None), positives, "uid")
    windows = best.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "found_id", "found_uid"))).alias("windows"))  # at most `positives`
    asked = written(queries.join(windows, "uid"), "asked")
    found = _ranked(_searched(index, asked, blocks, parts, dim, most, negatives, low), negatives, "uid", "positive_uid")
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The label of the query's rows: labels are moved on where the id is divisible by 7.
MOVED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def oracle(positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE) -> str:
    """DuckDB SQL: every anchor against every row."""
    return f"""WITH r AS MATERIALIZED (SELECT vec_id, {MOVED} AS label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_sum([CAST(a.v[i] * r.v[i] AS BIGINT) FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) AS score FROM r AS a, r WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own AND vec_id <> anchor_id
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives}),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND {low} * positive_score <= 100 * s.score AND s.score <= positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""
