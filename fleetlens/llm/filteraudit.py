"""Filter interaction audit: what each of several filters removes, alone and in every order, by a subset-zeta transform.

A document's filters that it fails are the bits of its mask. Documents meet as counts by (part, mask, labels); no order is
ever applied to rows. Of a part's 2^k mask counts the zeta transform (k additions of half the array to the other half)
makes the survivors of every subset of filters: those whose mask lies in the subset's complement. Step i of an order then
is the difference between two neighbouring subsets, and the Shapley sum is one over all subsets without the filter.
The same is done with the documents labelled good and with those labelled toxic.

Whether a text is a copy of a smaller doc_id's is decided on sums as well: rows are counted by (doc_id, text digest), then
by (digest, part, mask, labels) with the least doc_id and its count, so that a text that a third of all rows share combines
before every shuffle and is never joined back. Texts are the same if their SHA-256 is; distinct words are told apart by
64-bit hashes within a text.

Defined cases: null text is empty (no words: fails A alone); null and empty part are one part, the empty string; rows of
one doc_id count each, and none is smaller than the other; a row without doc_id is no copy and makes none; of several
labels of a doc_id any that says 1 counts; labels without a document, or without doc_id, do nothing; an empty table gives
an empty result. The result has its own columns only, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import table, with_columns_from_text
from fleetlens.llm.tokens import BLANK, BYTE_VALUES, chunks, mix

FILTERS = "ABCDE"
FEW_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
IS_CAPITAL = np.zeros(256, dtype=bool)
IS_CAPITAL[65:91] = True
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(b"#$%&*|")] = True
IS_POINT = ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))
RESULT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def content_masks(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Bits 1, 2, 4, 8 of each text: few words, few distinct words, many capitals, a symbol."""
    out = np.zeros(batch.num_rows, dtype=np.int32)
    for chunk in chunks(batch, "text"):
        starts, ends = chunk.runs(BLANK)
        hashes, bounds = chunk.hashes(chunk.sums(BYTE_VALUES), starts, ends), chunk.per_text(starts)
        counts = np.diff(bounds)
        text = np.repeat(np.arange(chunk.n), counts)
        first = np.unique(mix(hashes ^ mix(text.astype(np.uint64))), return_index=True)[1]
        distinct = np.bincount(text[first], minlength=chunk.n)
        of_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[chunk.offsets])
        fails = [counts < FEW_WORDS, 100 * distinct < DISTINCT_PERCENT * counts, 100 * of_text(IS_CAPITAL[chunk.data]) > CAPITAL_PERCENT * of_text(IS_POINT[chunk.data]), of_text(IS_SYMBOL[chunk.data]) > 0]
        out[chunk.first : chunk.first + chunk.n] = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
    return [out]


def mask_counts(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """Rows (part, mask, good, toxic, n): how many documents fail just the filters of the mask. docs: doc_id, text and what
    `part` (lang if not given) names; labels: doc_id, quality, toxic."""
    part = F.col("lang") if part is None else part
    rows = docs.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    judged = with_columns_from_text(rows, "text", [("mask", T.IntegerType())], content_masks, keep_text=False)
    once = judged.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    marked = once.join(marks, "doc_id", "left").select("doc_id", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    known = F.col("doc_id").isNotNull()
    groups = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unnamed"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    originals = groups.withColumn("fine", F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    sums = originals.groupBy("part", "mask", "good", "toxic").agg(F.sum("fine").alias("fine"), F.sum(F.col("n") - F.col("fine")).alias("copies"))
    copy = 1 << FILTERS.index("E")
    both = F.array(F.struct("mask", F.col("fine").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), F.col("copies").alias("n")))
    return sums.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def survivors(counts: np.ndarray) -> np.ndarray:
    """counts[..., mask] to survivors[..., subset]: the sum over masks without a bit of the subset."""
    k = counts.shape[-1].bit_length() - 1
    out = counts.copy()
    for bit in range(k):
        halves = out.reshape(*out.shape[:-1], -1, 2, 1 << bit)
        halves[..., 1, :] += halves[..., 0, :]
    return out[..., ::-1]


def shapley_sums(alive: np.ndarray) -> np.ndarray:
    """Of each filter (last axis), what it removes summed over all orders: a subset without it stands before it in
    |subset|! * (k - 1 - |subset|)! of them."""
    size = alive.shape[-1]
    k = size.bit_length() - 1
    out = np.zeros((*alive.shape[:-1], k), dtype=np.int64)
    for bit in range(k):
        before = np.array([s for s in range(size) if not s >> bit & 1])
        ways = np.array([math.factorial(int(s).bit_count()) * math.factorial(k - 1 - int(s).bit_count()) for s in before])
        out[..., bit] = ((alive[..., before] - alive[..., before | 1 << bit]) * ways).sum(axis=-1)
    return out


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters (a letter each) and step. counts: as of mask_counts()."""
    k = len(filters)
    orders = np.array(list(itertools.permutations(range(k))))
    after = np.cumsum(1 << orders, axis=1)
    before = after - (1 << orders)
    names = np.repeat(["".join(filters[i] for i in o) for o in orders], k)
    letters = np.array(list(filters))[orders].ravel()
    full = (1 << k) - 1

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part, cells in zip(pdf["part"], pdf["cells"]):
                by = np.zeros((3, 1 << k), dtype=np.int64)  # all, good, toxic
                for c in cells:
                    by[:, c["mask"]] += c["n"] * np.array([1, c["good"], c["toxic"]])
                alive = survivors(by)
                lost = alive[:, before] - alive[:, after]
                bits = 1 << orders
                fails = alive[0, 0] - alive[0, bits]
                only = alive[0, full ^ bits] - alive[0, full]
                made = {"part": part, "filter_order": names, "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)), "filter": letters, "kept": alive[0, after], "removed": lost[0], "redundant": fails - lost[0], "unique_fails": only, "good_lost": lost[1], "toxic_lost": lost[2], "shapley": shapley_sums(alive[0])[orders]}
                yield pd.DataFrame({c: v.ravel() if isinstance(v, np.ndarray) else v for c, v in made.items()})

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))  # 4 * 2^k at most
    return cells.mapInPandas(rows, RESULT)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(mask_counts(docs.select("doc_id", "text", "lang"), labels))


#: Each order applied by comparing masks; what a filter removes is a plain count.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
    + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM words LEFT JOIN marks USING (doc_id)
), counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM masks GROUP BY part, mask
), f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, CAST(i AS INT) AS step, letter, bit,
    CAST(coalesce((SELECT sum(p.bit) FROM f p WHERE strpos(filter_order, p.letter) < i), 0) AS INT) AS before
  FROM orders, range(1, 6) r(i), f WHERE letter = substr(filter_order, i, 1)
), audited AS (
  SELECT part, filter_order, step, letter AS filter,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(g) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(x) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, filter, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley
FROM audited
"""
