"""Hard negatives by inner product: cover trees over norm-augmented candidates, searched best first.

An extra entry sqrt(M^2 - |x|^2) puts every candidate x of a tree on the sphere of radius M, the largest norm among them;
a query has a zero there, so inner products stay as they are and are |q| M times the cosine of an angle. A tree is made
by farthest-first order: cut where the distance to the nearest earlier candidate falls below a power of two, it gives
nets whose members lie further apart than that and cover all others within it, level by level. Each node keeps the
largest distance to what hangs below it. That radius as an angle bounds all inner products below the node from both
sides. The descent opens the node with the highest upper bound first, leaves out nodes whose bounds lie outside of every
window that is still open, and verifies candidates exactly, in whole numbers.

Spark deals the candidates by a hash of their row into shards of about ``shard_rows``, so that no vector, label or
source makes a large one, and each query meets the tree of every shard. A shard's best for a query and window are at
most ``most`` rows; the best of all shards are ranked by a window over (query, window). Two such passes: positives, then
the negatives within each positive's window.

Cases: rows with a null label, a null vector or null or non-finite entries take no part; a row with a null id is a
candidate after all others of its score and never an anchor; equal scores go by smaller id; repeated rows are rows of
their own (each repeated anchor has its results, and a copy of an anchor may be its positive); equal vectors are one leaf;
shorter vectors have zeros at their end; a positive with a negative score has an empty window; no anchors or an
empty table give no rows; texts of any length and other columns, clashing names too, are not read. Entries so large that
inner products could pass 2^62 raise an error.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.vectors import integer_vectors, matrix
from foliant.session import materialize

#: Nodes with so few candidates below them are verified without opening their children one by one.
LEAF = 48
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
FOUND = "query bigint, slot int, row bigint, vec_id bigint, score bigint"


class CoverTree:
    """A cover tree over different vectors of whole numbers; nodes are (level, vector), from the root down."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x = x
        self.exact = x.shape[1] * int(np.abs(x).max(initial=0)) ** 2 < 1 << 53
        self.wide = x.astype(np.float64)
        norms = (self.wide * self.wide).sum(axis=1)
        self.radius = math.sqrt(norms.max())
        y = np.column_stack([self.wide, np.sqrt(np.maximum(norms.max() - norms, 0))])
        self.root, nets, owners = self.order(y)
        # From the finest net up: what hangs below each member, how far away, how many.
        above, self.size, self.angle, self.children = np.arange(n), [np.ones(n, dtype=int)], [np.zeros(n)], [None]
        for members, owner in zip(nets[::-1], owners[::-1]):
            above = owner[above]
            far = np.zeros(n)
            np.maximum.at(far, above, np.sqrt(((y - y[above]) ** 2).sum(axis=1)))
            self.size.append(np.bincount(above, minlength=n))
            self.angle.append(2 * np.arcsin(np.minimum(1.0, far / (2 * self.radius or 1.0))))
            by_owner = members[np.argsort(owner[members], kind="stable")]
            starts = np.searchsorted(owner[by_owner], np.arange(n + 1))
            self.children.append((by_owner, starts))
        self.size, self.angle, self.children = self.size[::-1], self.angle[::-1], self.children[::-1]
        # Candidates below a node stand together: each takes its place from the root down.
        self.place = self.places(n)

    @staticmethod
    def order(y: np.ndarray) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
        """Root; by level, from coarse to fine, the members of the net below and each one's owner in the net above."""
        n = len(y)
        squares = (y * y).sum(axis=1)
        near = np.zeros(n, dtype=int)
        apart = np.maximum(squares + squares[0] - 2 * (y @ y[0]), 0)
        apart[0] = -1.0
        order, nets, owners, level = [0], [], [], None
        for _ in range(n - 1):
            best = int(apart.argmax())
            at = math.floor(0.5 * math.log2(max(apart[best], 1e-9)))
            if at != level:  # all within 2^(at + 1) of the members so far: a net is complete
                if level is not None:
                    nets.append(np.array(order))
                owners.append(near.copy())
                level = at
            order.append(best)
            closer = squares + squares[best] - 2 * (y @ y[best])
            gain = closer < apart
            apart[gain], near[gain] = np.maximum(closer[gain], 0), best
            apart[best], near[best] = -1.0, best
        if owners:
            nets.append(np.arange(n))
        return 0, nets, owners

    def places(self, n: int) -> np.ndarray:
        """Where each node's candidates begin, by level; the last level's are the places themselves."""
        begin = np.zeros(n, dtype=int)
        self.begin = [begin]
        for level in range(len(self.size) - 1):
            by_owner, starts = self.children[level]
            sizes = self.size[level + 1][by_owner]
            run = np.cumsum(sizes) - sizes
            owned = np.diff(starts)
            first = np.repeat(run[np.minimum(starts[:-1], len(run) - 1)], owned)
            owner = np.repeat(np.arange(n), owned)
            below = np.zeros(n, dtype=int)
            below[by_owner] = begin[owner] + run - first
            begin = below
            self.begin.append(begin)
        at = np.empty(n, dtype=int)
        at[begin] = np.arange(n)
        return at

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """All candidates below nodes of a level."""
        sizes = self.size[level][nodes]
        ends = np.cumsum(sizes)
        offsets = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        return self.place[np.repeat(self.begin[level][nodes], sizes) + offsets]

    def products(self, at: np.ndarray, q: np.ndarray, wide: np.ndarray | None) -> np.ndarray:
        """Exact inner products as long integers."""
        return self.x[at] @ q if wide is None else (self.wide[at] @ wide).astype(np.int64)


class Shard:
    """Candidates of a shard as rows sorted by id, below the leaves of a tree."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, known: np.ndarray, label: np.ndarray, x: np.ndarray):
        order = np.lexsort((row, vec_id, ~known))
        row, vec_id, known, label, x = row[order], vec_id[order], known[order], label[order], x[order]
        different, of = np.unique(x, axis=0, return_inverse=True)
        self.tree = CoverTree(different)
        grouped = np.argsort(of.ravel(), kind="stable")
        self.row, self.vec_id, self.known, self.label = row[grouped], vec_id[grouped], known[grouped], label[grouped]
        self.starts = np.searchsorted(of.ravel()[grouped], np.arange(len(different) + 1))
        self.single = len(different) == len(row)

    def rows_of(self, leaves: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.single:
            return leaves, scores
        counts = self.starts[leaves + 1] - self.starts[leaves]
        ends = np.cumsum(counts)
        offsets = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
        return np.repeat(self.starts[leaves], counts) + offsets, np.repeat(scores, counts)

    def search(self, own: int, label: int, q: np.ndarray, same: bool, windows: list[tuple[int, int]], most: int) -> list:
        """Of each window (lowest and highest score) the first rows as (place among the shard's rows, score)."""
        tree = self.tree
        largest = int(np.abs(q).max(initial=0))
        exact = tree.exact and len(q) * largest * max(largest, int(np.abs(tree.x).max(initial=0))) < 1 << 53
        wide = q.astype(np.float64) if exact else None
        reach = math.sqrt(float((q.astype(np.float64) ** 2).sum())) * tree.radius
        slack = 1e-9 * reach + 1e-6
        best = [(np.empty(0, dtype=int), np.empty(0, dtype=np.int64)) for _ in windows]
        floors = [low for low, _ in windows]

        def bounds(level: int, nodes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            angle = np.arccos(np.clip(scores / reach, -1, 1)) if reach else np.zeros(len(nodes))
            wide_by = tree.angle[level][nodes]
            upper = reach * np.cos(np.maximum(angle - wide_by, 0)) + slack
            return reach * np.cos(np.minimum(angle + wide_by, math.pi)) - slack, upper

        def open_at(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            wanted = np.zeros(len(lower), dtype=bool)
            for (_, high), floor in zip(windows, floors):
                wanted |= (upper >= floor) & (lower <= high)
            return wanted

        def verify(leaves: np.ndarray) -> None:
            scores = tree.products(leaves, q, wide)
            mine = scores >= min(floors)
            rows, scores = self.rows_of(leaves[mine], scores[mine])
            fit = (self.label[rows] == label) & (self.row[rows] != own) if same else self.label[rows] != label
            rows, scores = rows[fit], scores[fit]
            for k, (_, high) in enumerate(windows):
                inside = (scores >= floors[k]) & (scores <= high)
                if inside.any():
                    r, s = np.concatenate([best[k][0], rows[inside]]), np.concatenate([best[k][1], scores[inside]])
                    first = np.lexsort((self.row[r], self.vec_id[r], ~self.known[r], -s))[:most]
                    best[k] = r[first], s[first]
                    if len(first) == most:
                        floors[k] = max(floors[k], int(s[first[-1]]))

        root = np.array([tree.root])
        agenda = []
        if tree.size[0][tree.root] <= LEAF:
            verify(tree.below(0, root))
        else:
            agenda.append((-math.inf, -math.inf, 0, tree.root))
        while agenda:
            upper, lower, level, node = heapq.heappop(agenda)
            if -upper < min(floors):
                break
            if not any(-upper >= floor and lower <= high for (_, high), floor in zip(windows, floors)):
                continue
            by_owner, starts = tree.children[level]
            nodes = by_owner[starts[node] : starts[node + 1]]
            below = level + 1
            lows, highs = bounds(below, nodes, tree.products(nodes, q, wide))
            few = tree.size[below][nodes] <= LEAF
            near = few & open_at(lows, highs)
            if near.any():
                verify(tree.below(below, nodes[near]))
            for k in np.flatnonzero(~few):
                heapq.heappush(agenda, (-highs[k], lows[k], below, int(nodes[k])))
        return best


def nearest(candidates: DataFrame, queries: DataFrame, size: int, shards: int, same: bool, most: int) -> DataFrame:
    """query (its row), slot, row, vec_id, score: of each query's windows the first rows over all shards.

    ``candidates``: row, vec_id, label, x. ``queries``: row, label, x, windows (array of slot, low, high). ``same``: rows
    of the query's label other than itself, else those of other labels.
    """
    windows = "array<struct<slot:int,low:bigint,high:bigint>>"
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    feed = candidates.select(shard.alias("shard"), F.lit(0).alias("kind"), "row", "vec_id", "label", "x", F.lit(None).cast(windows).alias("windows"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "row", F.lit(None).cast("bigint").alias("vec_id"), "label", "x", F.col("windows").cast(windows)
    )
    dealt = feed.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        column = batch.column
        return [
            column(2).to_numpy(), column(3).fill_null(0).to_numpy(), column(3).is_valid().to_numpy(zero_copy_only=False),
            column(4).to_numpy(), matrix(column(5), size),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            shard_of, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(shard_of)]):
                if shard_of[a] != at:
                    at, held, tree = shard_of[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(arrays(part))
                elif held or tree:
                    if tree is None:
                        tree, held = Shard(*map(np.concatenate, zip(*held))), []
                    yield answers(tree, part)

    def answers(tree: Shard, part: pa.RecordBatch) -> pa.RecordBatch:
        row, _, _, label, x = arrays(part)
        found: list[tuple] = []
        for k, asks in enumerate(part.column(6).to_pylist()):
            best = tree.search(row[k], label[k], x[k], same, [(w["low"], w["high"]) for w in asks], most)
            for w, (rows, scores) in zip(asks, best):
                found.append((np.full(len(rows), row[k]), np.full(len(rows), w["slot"], dtype=np.int32), rows, scores))
        query, slot, rows, scores = map(np.concatenate, zip(*found))
        ids = pa.array(tree.vec_id[rows], pa.int64(), mask=~tree.known[rows])
        return pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(slot), pa.array(tree.row[rows]), ids, pa.array(scores)], names=[c.split()[0] for c in FOUND.split(", ")]
        )

    ranked = Window.partitionBy("query", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = dealt.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(ranked))
    return best.where(F.col("rank") <= most)


def hard_negatives(
    embeddings: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5, low_percent: int = 80, shard_rows: int = 4096
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on vec_id and label. An anchor's positives are its first ``positives`` other rows of its
    label by score; for each, the first ``negatives`` rows of other labels with scores from ``low_percent`` % of the
    positive's up to the positive's.
    """
    spark = embeddings.sparkSession
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows, size, largest = integer_vectors(given.where("label is not null"), "embedding")
    if size * largest**2 >= 1 << 62:
        raise ValueError("inner products must stay below 2^62")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    asked = rows.where(anchors)
    every = F.array(F.struct(F.lit(0).alias("slot"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
    close = nearest(rows, asked.withColumn("windows", every), size, shards, True, positives)
    close = materialize(close.select("query", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-close")
    least = F.expr(f"({low_percent} * positive_score + 99) div 100").alias("low")
    windows = close.where("positive_score >= 0").groupBy(F.col("query").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("slot", least, F.col("positive_score").alias("high")))).alias("windows")
    )
    far = nearest(rows, asked.join(windows, "row"), size, shards, False, negatives)
    named = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id"))
    return far.join(close, ["query", "slot"]).join(named, "query").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def contract_rows(embeddings: DataFrame) -> DataFrame:
    """Embeddings whose labels are moved on by one, modulo ten, where the id is divisible by seven."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", "embedding", moved.alias("label"))
