"""Hard negatives by a pivot table: inner products as distances, bracketed by the triangle inequality.

A row x gets one more component sqrt(M^2 - |x|^2), M being the largest norm, and an anchor q gets a zero; then
|q~ - x~|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner product is the smallest Euclidean distance. Each row is stored
with its distances to PIVOTS pivots (farthest-first from a bounded sample). For an anchor, max |d(q, p) - d(x, p)| and
min d(q, p) + d(x, p) over the pivots bracket d(q, x) and so its score; whole cells (the rows of one nearest pivot) are
bracketed by their least and largest distances alone. Only rows whose bracket can still matter are scored exactly.

Three passes use one index. First an anchor looks into one block of its own cell; its k-th best score of its own label there
is a floor. Then all cells that can reach the floor give the positives. Their scores set the windows of allowed negative
scores, and all cells that can hold such a score give the negatives. Rows lie in blocks of about ROWS_A_BLOCK, anchors in
groups of about ANCHORS_A_GROUP near the same pivots; a block goes to the groups that visit it and to no other. A task
keeps no more than the best of each anchor or window, and these few meet again by anchor.

Scores are integers: components are floor(scale * x), x as double. They are exact in doubles while M^2 is below 2^53, and
in Python's integers beyond that; a score beyond 64 bits is the nearest 64-bit value, in windows too. Brackets have a slack for rounding.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; an empty vector
has score 0 with all; a shorter vector counts as one with zeros behind; ties go to the smaller id; a row is never the
candidate of an anchor with its id; rows that share an id are candidates each, and anchors each, told apart by the number `anchor`;
anchors without positives, and positives without negatives in their window, have no rows; an empty table gives an empty result.
The result has its own columns only, so other columns of the table, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import table, written
from fleetlens.llm.multiindex import deal_cells

PIVOTS = 24
SAMPLE = 2000
ROWS_A_BLOCK = 16_384
ANCHORS_A_GROUP = 8_192
#: Blocks that a smaller table is cut into, so that it too is dealt over many tasks.
BLOCKS = 48
RESULT = "anchor long, anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1


def prepared(vectors: DataFrame, scale: float, vec_id: str, vector: str, label: Column | str) -> DataFrame:
    """vec_id, label and vec (whole numbers as doubles) of the rows that take part."""
    given = vectors.select(F.col(vec_id).alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("raw"))
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.expr(f"transform(raw, x -> CASE WHEN abs(x) < 1e12 THEN CAST(floor(x * {scale!r}D) AS DOUBLE) ELSE greatest(least(x * {scale!r}D, 1.7e308D), -1.7e308D) END)")  # so large, doubles are whole
    return given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & fine).select("vec_id", "label", whole.alias("vec"))


def padded(column, size: int | None = None) -> np.ndarray:
    """Vectors one below the other, with zeros behind."""
    size = max((len(v) for v in column), default=0) if size is None else size
    out = np.zeros((len(column), size))
    for i, v in enumerate(column):
        out[i, : min(len(v), size)] = v[:size]
    return out


class Pivots:
    """Pivots as whole-number vectors with their last, augmented component."""

    def __init__(self, vectors: list, norm: float, count: int):
        self.norm = norm  # M^2
        x = padded(vectors)
        rest = np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0))
        x = np.column_stack([x, rest])
        chosen = [int(np.argmax((x * x).sum(axis=1) - rest * rest))]
        far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < count and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        self.at, self.rest = x[chosen, :-1], rest[chosen]

    def distances(self, column, augment: bool) -> np.ndarray:
        """A row of distances to the pivots for each vector; an anchor's last component is zero (augment: False)."""
        x = padded(column, self.at.shape[1]) if len({len(v) for v in column}) != 1 or len(column[0]) != self.at.shape[1] else np.stack(column)
        whole = np.array([float(np.dot(v, v)) for v in column])
        last = np.sqrt(np.maximum(self.norm - whole, 0)) if augment else np.zeros(len(whole))
        inner = x @ self.at.T + last[:, None] * self.rest
        return np.sqrt(np.maximum((whole + last * last)[:, None] + ((self.at**2).sum(axis=1) + self.rest**2) - 2 * inner, 0))


class Block:
    """Rows of one block: ids, labels, pivot distances and vectors by length."""

    def __init__(self, rows: pd.DataFrame, exact: bool):
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.far = np.stack(rows["far"].tolist()).T
        self.exact, self.vec = exact, rows["vec"].tolist()
        sizes = {len(v) for v in self.vec}
        self.same = np.stack(self.vec) if len(sizes) == 1 and exact else None

    def scores(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products of v with the rows `at`."""
        if self.same is not None and len(v) == self.same.shape[1]:
            return (self.same[at] @ v).astype(np.int64)
        if self.exact:
            return np.array([int(np.dot(w[: len(v)], v[: len(w)])) for w in (self.vec[i] for i in at)], dtype=np.int64)
        whole = [int(c) for c in v]
        return np.array([max(-LARGEST, min(LARGEST, sum(a * int(b) for a, b in zip(whole, self.vec[i])))) for i in at], dtype=np.int64)

    def brackets(self, far: np.ndarray, own: float, norm: float, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that the pivots allow for the rows `at`."""
        mine = self.far[:, at]
        return scores_between(np.abs(mine - far[:, None]).max(axis=0), (mine + far[:, None]).min(axis=0), own, norm)


def scores_between(least, most, own, norm) -> tuple[np.ndarray, np.ndarray]:
    """Scores at distances most and least, widened for rounding, within 64 bits as scores are."""
    slack = 1e-9 * (own + norm) + 1e-6
    return tuple(np.clip(s, -LARGEST, LARGEST) for s in ((own + norm - most * most) / 2 - slack, (own + norm - least * least) / 2 + slack))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if k < len(at):
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or nothing to hold on to."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def same_label(block: Block, q, k: int, norm: float) -> list[tuple]:
    """The anchor's k best rows of its label in the block that can reach its floor."""
    at = np.flatnonzero((block.labels == q.label) & (block.ids != q.vec_id))
    if not len(at):
        return []
    low, high = block.brackets(q.far, q.own, norm, at)
    floor = max(q.floor, kth(low, k))
    at = at[~(high < floor)]
    s = block.scores(q.vec, at)
    return [(q.anchor, q.vec_id, 0, int(block.ids[at[i]]), int(s[i])) for i in best(s, block.ids[at], k)]


def other_labels(block: Block, q, k: int, norm: float) -> list[tuple]:
    """The k best rows of other labels in each of the anchor's windows of scores."""
    at = np.flatnonzero((block.labels != q.label) & (block.ids != q.vec_id))
    if not len(at):
        return []
    low, high = block.brackets(q.far, q.own, norm, at)
    wanted = np.zeros(len(at), dtype=bool)
    for least, most in zip(q.least, q.most):
        floor = max(least, kth(low[(low >= least) & (high <= most)], k))
        wanted |= ~((high < floor) | (low > most))
    at = at[wanted]
    s = block.scores(q.vec, at)
    out = []
    for n, (least, most) in enumerate(zip(q.least, q.most)):
        inside = np.flatnonzero((s >= least) & (s <= most))
        out += [(q.anchor, q.vec_id, n, int(block.ids[at[i]]), int(s[i])) for i in inside[best(s[inside], block.ids[at[inside]], k)]]
    return out


FOUND = "anchor long, anchor_id long, n int, id long, score long"


class Index:
    """Rows filed by nearest pivot and dealt to blocks; anchors visit blocks in groups."""

    def __init__(self, rows: DataFrame, pivots: Pivots, is_anchor, rows_a_block: int, anchors_a_group: int):
        self.spark, self.pivots = rows.sparkSession, pivots

        def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    far = pivots.distances(pdf["vec"].tolist(), augment=True)
                    yield pdf.assign(far=list(far), cell=far.argmin(axis=1).astype(np.int32))

        self.rows = written(rows.mapInPandas(file, "vec_id long, label long, vec array<double>, far array<double>, cell int"), "pivot-index")
        size = len(pivots.rest)
        bounds = [f(F.col("far")[j]).alias(f"{n}{j}") for j in range(size) for f, n in ((F.min, "a"), (F.max, "b"))]
        cells = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(is_anchor(F.col("vec_id")).cast("long")).alias("asked"), *bounds).collect()  # one for each pivot
        counts, asked = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.near, self.wide = np.full((size, size), np.inf), np.full((size, size), -np.inf)
        for r in cells:
            counts[r.cell], asked[r.cell] = r.n, r.asked or 0
            self.near[r.cell], self.wide[r.cell] = [r[f"a{j}"] for j in range(size)], [r[f"b{j}"] for j in range(size)]
        self.first, self.parts = deal_cells(counts, rows_a_block)
        groups, split = deal_cells(asked, anchors_a_group)
        self.filled = np.flatnonzero(counts)
        dealt = self.spark.createDataFrame([(int(c), int(self.first[c]), int(self.parts[c]), int(groups[c]), int(split[c])) for c in self.filled], "cell int, first int, parts int, crowd int, split int")
        spread = lambda start, parts: (F.col(start) + F.pmod(F.xxhash64("vec_id", "label", "vec"), F.col(parts))).cast("int")
        placed = self.rows.join(F.broadcast(dealt), "cell").select("vec_id", "label", "vec", "far", "cell", spread("first", "parts").alias("block"), spread("crowd", "split").alias("crowd"))
        asking = placed.where(is_anchor(F.col("vec_id"))).drop("far").withColumn("anchor", F.monotonically_increasing_id())
        self.placed, self.anchors = placed, written(asking, "pivot-anchors")

    def search(self, anchors: DataFrame, pick, k: int, route) -> DataFrame:
        """What pick(block, anchor, k, norm) finds of each anchor in the blocks that route(anchor, far, own) names, the k best of each (anchor, n)."""
        pivots, exact, norm = self.pivots, self.pivots.norm < EXACT, self.pivots.norm
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)

        def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if not len(pdf):
                    continue
                far = pivots.distances(pdf["vec"].tolist(), augment=False)
                for i, q in enumerate(pdf.itertuples(index=False)):
                    goes = route(q, far[i], float(np.dot(q.vec, q.vec)))
                    if len(goes):
                        yield pd.DataFrame([q] * len(goes), columns=pdf.columns).assign(far=[far[i]] * len(goes), goes=goes)

        sent = anchors.mapInPandas(visits, f"{kinds}, far array<double>, goes int")

        def scan(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(rows):
                block = Block(rows, exact)
                asked = asked.assign(own=[float(np.dot(v, v)) for v in asked["vec"]])
                for q in asked.itertuples(index=False):
                    out += pick(block, q, k, norm)
            return pd.DataFrame(out, columns=["anchor", "anchor_id", "n", "id", "score"]).astype({"anchor": "int64", "anchor_id": "int64", "n": "int32", "id": "int64", "score": "int64"})

        met = sent.select(F.col("goes").alias("block"), F.col("crowd").alias("band")).distinct()
        filed = self.placed.select(F.col("vec_id").alias("id"), "label", "vec", "far", "block").join(met, "block")
        found = sent.groupBy("goes", "crowd").cogroup(filed.groupBy("block", "band")).applyInPandas(scan, FOUND)
        order = Window.partitionBy("anchor", "n").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def blocks_of(self, wanted: np.ndarray) -> list[int]:
        """The blocks of the cells for which `wanted` (by filled cell) holds."""
        return sorted({b for c in self.filled[wanted] for b in range(int(self.first[c]), int(self.first[c] + self.parts[c]))})

    def cell_brackets(self, far: np.ndarray, own: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that any row of each filled cell can have."""
        near, wide = self.near[self.filled], self.wide[self.filled]
        least = np.maximum(np.maximum(far - wide, near - far), 0).max(axis=1)
        return scores_between(least, (far + wide).min(axis=1), own, self.pivots.norm)

    def without_spark(self) -> Index:
        """The part that tasks need: bounds and places of the cells."""
        out = object.__new__(Index)
        out.pivots, out.near, out.wide, out.filled, out.first, out.parts = self.pivots, self.near, self.wide, self.filled, self.first, self.parts
        return out


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", pivots: int = PIVOTS, sample: int = SAMPLE, rows_a_block: int | None = None, anchors_a_group: int = ANCHORS_A_GROUP) -> DataFrame:
    """Rows of RESULT: for each anchor (is_anchor(vec_id)) and each of its `positives` best rows of the same label, the
    `negatives` best rows of other labels whose score is from least_percent to most_percent of the positive's."""
    spark = vectors.sparkSession
    rows = prepared(vectors, scale, vec_id, vector, label)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    if not size.n:
        return spark.createDataFrame([], RESULT)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vec")).limit(sample).select("vec").collect()
    rows_a_block = rows_a_block or int(min(ROWS_A_BLOCK, max(256, -(-size.n // BLOCKS))))
    index = Index(rows, Pivots([r.vec for r in chosen], size.norm, pivots), is_anchor, rows_a_block, anchors_a_group)
    anchors, light = index.anchors, index.without_spark()

    first_look = index.search(anchors.withColumn("floor", F.lit(float("-inf"))), same_label, positives, lambda q, far, own: [q.block])
    floors = first_look.where(F.col("rank") == positives).select("anchor", F.col("score").cast("double").alias("floor"))
    known = written(anchors.join(floors, "anchor", "left").fillna({"floor": float("-inf")}), "pivot-floors")
    near = written(index.search(known, same_label, positives, lambda q, far, own: light.blocks_of(~(light.cell_brackets(far, own)[1] < q.floor))), "pivot-positives")
    share = lambda percent, whole: whole(F.expr(f"{percent} * CAST(score AS DECIMAL(20, 0)) / 100")).cast("long")
    windows = near.select("anchor", F.struct(F.col("rank"), share(least_percent, F.ceil).alias("least"), share(most_percent, F.floor).alias("most")).alias("w"))
    listed = windows.groupBy("anchor").agg(F.array_sort(F.collect_list("w")).alias("ws"))  # as many as positives at most
    asked = anchors.join(listed, "anchor").select(anchors["*"], F.col("ws.least").alias("least"), F.col("ws.most").alias("most"))

    def to_negatives(q, far, own) -> list[int]:
        low, high = light.cell_brackets(far, own)
        wanted = np.zeros(len(low), dtype=bool)
        for least, most in zip(q.least, q.most):
            wanted |= ~((high < least) | (low > most)) & (least <= most)
        return light.blocks_of(wanted)

    hard = index.search(asked, other_labels, negatives, to_negatives)
    positive = near.select("anchor", (F.col("rank") - 1).cast("int").alias("n"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(positive, ["anchor", "n"]).select("anchor", "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), lambda i: i % 100 == 0, label=label).drop("anchor")


#: Every anchor against every row, in DuckDB.
ORACLE = """
WITH taken AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM taken a JOIN taken b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT r, anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.r, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.r = s.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
