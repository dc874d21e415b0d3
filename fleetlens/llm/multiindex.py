"""Approximate nearest neighbours by an inverted multi-index.

Vectors are normalised and cut in two halves. k-means on a bounded sample (SAMPLE rows, by the hash of their id) gives
`cells` centroids for each half; every vector is filed under its pair of nearest centroids. A query walks the pairs in
the order of summed distance with a heap until the pairs it has passed hold `probe` of all vectors, and those
candidates are reranked by the exact cosine in double precision. Unless given, `probe` is the least share with which
TUNING queries (by the hash of their id) find `recall` of their true neighbours among all rows, measured beforehand.

Cells are dealt to blocks of about ROWS_A_BLOCK rows; a larger cell is cut into several. A query goes once to each
block that holds a cell of its walk, with the list of those cells, in groups of about QUERIES_A_GROUP queries, and a
group gives the `k` best for each of its queries; so neither hot cells nor equal vectors nor many queries meet in one
task, and no candidate is dropped.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; a shorter vector counts as
one with zeros behind (the index files by as many components as most vectors have); extreme sizes neither over- nor
underflow; ties go to the smaller id; rows that share an id are candidates each, but a query never finds its own id; fewer
candidates than k give fewer rows; an empty table gives an empty result. The result has its own columns only, so other
columns of the table, whatever their names, don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import table, written

SAMPLE = 20_000
TUNING = 64
ROWS_A_BLOCK = 4096
QUERIES_A_GROUP = 2048
RESULT = "query_id long, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 9) -> np.ndarray:
    """k centroids; an emptied one restarts at the point farthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        near = d.argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        far = iter(np.argsort(-d[np.arange(len(x)), near]))
        for e in np.flatnonzero(counts == 0):
            c[e] = x[next(far)]
    return c


def walk(d1: np.ndarray, d2: np.ndarray, counts: list[int], budget: int) -> list[int]:
    """Cells (i * len(d2) + j) by summed distance until they hold `budget` rows; a heap over the sorted halves. A pair comes
    on the heap once both pairs before it (of a smaller i, of a smaller j) have left it."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, base, step = d1[o1].tolist(), d2[o2].tolist(), (o1 * len(d2)).tolist(), o2.tolist()
    rows, columns = len(s1), len(s2)
    passed = [0] * (rows + 1)  # how many pairs of each i have left the heap: they leave in the order of j
    heap, out, held = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and held < budget:
        _, i, j = heapq.heappop(heap)
        cell = base[i] + step[j]
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        passed[i] = j + 1
        if j + 1 < columns and (i == 0 or passed[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < rows and passed[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return out


def deal_cells(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells share one, a large one has several of its own."""
    first, parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    block, held = 0, 0
    for c in np.flatnonzero(counts):
        parts[c] = -(-counts[c] // rows)
        if held and held + counts[c] > rows:
            block, held = block + 1, 0
        first[c] = block
        held += int(counts[c])
        if parts[c] > 1:
            block, held = block + int(parts[c]), 0
    return first, parts


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vec (array<double>) of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull() & fine)


def scaled(v) -> np.ndarray:
    """The vector times a power of two that brings its largest component to 1/2 at least and below 1: exact, and without
    over- or underflow in squares."""
    v = np.asarray(v, dtype=np.float64)
    return np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))


def unit(column, size: int) -> np.ndarray:
    """Unit vectors of `size` components: shorter ones with zeros behind, longer ones cut after normalising."""
    out = np.zeros((len(column), size))
    for i, v in enumerate(column):
        v = scaled(v)
        v = v[:size] / np.sqrt((v * v).sum())
        out[i, : len(v)] = v
    return out


def build(rows: DataFrame, cells: int, size: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Centroids of either half, from at most `sample` rows."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").collect()
    if not chosen:
        return None
    x = unit([r.vec for r in chosen], size)
    half = max(1, size // 2)
    return kmeans(x[:, :half], cells), kmeans(x[:, half:], cells) if size > half else np.zeros((1, 0))


class Vectors:
    """Rows of one block by length, scaled, with their norms: cosines with a query without padding any of them."""

    def __init__(self, column):
        lengths = np.array([len(v) for v in column])
        self.parts = []
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            x = np.stack([scaled(column[i]) for i in at])
            self.parts.append((at, x, np.sqrt((x * x).sum(axis=1))))
        self.n = len(lengths)

    def cosines(self, v, wanted: np.ndarray) -> np.ndarray:
        """Cosine of every row of wanted (a mask) with v; -2 for others."""
        v, out = scaled(v), np.full(self.n, -2.0)
        size = np.sqrt((v * v).sum())
        for at, x, norms in self.parts:
            mine = np.flatnonzero(wanted[at])
            few = min(len(v), x.shape[1])
            out[at[mine]] = (x[mine, :few] * v[:few]).sum(axis=1) / (norms[mine] * size)
        return out


def nearest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above -2, ties to the smaller id."""
    at = np.flatnonzero(scores > -2)
    if k < len(at):
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def tuned_probe(index: DataFrame, queries: list[tuple[int, list[float]]], distances, counts: np.ndarray, k: int, recall: float) -> float:
    """The share of all rows that the cells passed must hold for the queries to find `recall` of their true k neighbours."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                block, ids = Vectors(pdf["vec"].tolist()), pdf["vec_id"].to_numpy()
                for q, v in queries:
                    s = block.cosines(v, ids != q)
                    at = nearest(s, ids, k)
                    yield pd.DataFrame({"query_id": q, "cell": pdf["cell"].to_numpy()[at], "vec_id": ids[at], "score": s[at]})

    found = index.mapInPandas(best, "query_id long, cell int, vec_id long, score double")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "cell"))), 1, k)
    shares, vectors = [], dict(queries)
    for r in found.groupBy("query_id").agg(top.alias("top")).collect():
        d1, d2 = distances(unit([vectors[r.query_id]], sum(distances.sizes))[0])
        d = (d1[:, None] + d2[None, :]).ravel()
        shares += [counts[d <= d[x.cell]].sum() / counts.sum() for x in r.top]
    return float(np.sort(shares)[min(len(shares) - 1, int(np.ceil(recall * len(shares))) - 1)]) if shares else 0.0


class Distances:
    """Squared distances of a unit vector's halves to the centroids."""

    def __init__(self, c1: np.ndarray, c2: np.ndarray):
        self.c1, self.c2, self.sizes = c1, c2, (c1.shape[1], c2.shape[1])

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.sizes[0]
        return ((self.c1 - v[:half]) ** 2).sum(axis=1), ((self.c2 - v[half:]) ** 2).sum(axis=1)


def search(vectors: DataFrame, is_query, k: int = 5, cells: int | None = None, probe: float | None = None, recall: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row for which is_query(vec_id) holds.

    probe: the share of all rows that a query's cells must hold (tuned to `recall` if not given); cells: centroids of a
    half (by the number of rows, 256 at most).
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    lengths = rows.groupBy(F.size("vec").alias("size")).count()
    most = lengths.agg(F.sum("count").alias("n"), F.max_by("size", F.struct("count", -F.col("size"))).alias("size")).first()
    n, size = most.n or 0, most.size or 0
    cells = cells or int(min(256, max(16, 2 ** round(np.log2(max(n, 4) / 4) / 2))))
    made = build(rows, cells, size, sample)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    c1, c2 = made
    half, distances = c1.shape[1], Distances(c1, c2)

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x = unit(pdf["vec"].tolist(), size)
            i = ((c1 * c1).sum(1) - 2 * x[:, :half] @ c1.T).argmin(1)
            j = ((c2 * c2).sum(1) - 2 * x[:, half:] @ c2.T).argmin(1)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vec": pdf["vec"], "cell": (i * len(c2) + j).astype(np.int32)})

    index = written(rows.mapInPandas(file, "vec_id long, vec array<double>, cell int"), "multi-index")
    sizes = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}  # at most cells * cells rows
    counts = np.zeros(len(c1) * len(c2), dtype=np.int64)
    for cell, m in sizes.items():
        counts[cell] = m
    asked = index.where(is_query(F.col("vec_id"))).select("vec_id", "vec")
    if probe is None:
        tuning = [(r.vec_id, list(r.vec)) for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TUNING).collect()]
        probe = tuned_probe(index, tuning, distances, counts, k, recall)
    budget = max(int(np.ceil(probe * n)), k + 1)
    first, parts = deal_cells(counts, ROWS_A_BLOCK)
    groups = max(1, -(-asked.count() // QUERIES_A_GROUP))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = counts.tolist()
        for pdf in frames:
            for qid, vec, q in zip(pdf["vec_id"], pdf["vec"], unit(pdf["vec"].tolist(), size)):
                wanted: dict[int, list[int]] = {}
                for c in walk(*distances(q), many, budget):
                    for b in range(first[c], first[c] + parts[c]):
                        wanted.setdefault(int(b), []).append(c)
                yield pd.DataFrame({"id": qid, "vec": [vec] * len(wanted), "cells": list(wanted.values()), "block": list(wanted)})

    by = ["block", "crowd"]
    queries = asked.repartition("vec_id").mapInPandas(route, "id long, vec array<double>, cells array<int>, block int").withColumn("crowd", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    places = spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in np.flatnonzero(counts)], "cell int, first int, parts int")
    filed = index.join(F.broadcast(places), "cell").select(F.col("vec_id").alias("id"), "vec", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id", "vec"), F.col("parts"))).cast("int").alias("block"))
    filed = filed.withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block, ids, cell = Vectors(right["vec"].tolist()), right["id"].to_numpy(), right["cell"].to_numpy()
            for qid, v, cells_ in zip(left["id"], left["vec"], left["cells"]):
                s = block.cosines(v, np.isin(cell, np.asarray(cells_)) & (ids != qid))
                out += [(qid, int(ids[at]), float(s[at])) for at in nearest(s, ids, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = queries.groupBy(*by).cogroup(filed.groupBy(*by)).applyInPandas(rerank, RESULT)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op2_multi_index(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0)
