"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

Method: every document gets a few measures; those that pass the fixed base rule feed one quantile sketch per
(lang, source, measure). The sketch is a log-bucket histogram with a relative error of ALPHA: a bucket count is a
sum, so sketches merge by addition, in any order and with the same result. A source with fewer than
`min_documents` uses its language's merged sketch, and a language with fewer the sketch of everything. From each
sketch come fences q50 - k*IQR - slack and q50 + k*IQR + slack, which are joined back by (lang, source).

Defined cases: null or empty text has no words and fails the base rule; null lang or source is a group of its own;
repeated rows are judged alike, each kept as a row; an empty table gives an empty result. Other columns pass through,
whatever their names; those named as an added one give way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import table, with_columns_from_text, written
from fleetlens.llm.tokens import BLANK, BYTE_VALUES, NEWLINE, chunks, mix, shingles

ALPHA = 0.01
BROADCAST_GROUPS = 100_000
GAMMA = (1 + ALPHA) / (1 - ALPHA)
MEASURES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("n_lines", T.LongType())]
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a code point within a word.
IN_WORD = ~BLANK & ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))


@dataclass(frozen=True)
class QualityRules:
    """Fences: k times the quartile range and a slack by measure, in that measure's unit: symbols a word, repeated lines a
    line with words, words in repeated windows a word, characters a word. A group of fewer than min_documents that pass the
    base rule takes its language's fences, and a language of fewer those of all."""

    k: float = 3.0
    symbol_slack: float = 0.1
    dup_slack: float = 0.3
    repeat_slack: float = 0.25
    length_slack: float = 1.0
    min_documents: int = 200


def measure(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows and lines with a word of each text."""
    out = [np.zeros(batch.num_rows, dtype=np.int64) for _ in MEASURES]
    for chunk in chunks(batch, "text"):
        starts, ends = chunk.runs(BLANK)
        sums = chunk.sums(BYTE_VALUES)
        hashes, bounds = chunk.hashes(sums, starts, ends), chunk.per_text(starts)
        counts = np.diff(bounds)
        of_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[chunk.offsets])
        windows, w_bounds = shingles(hashes, bounds, 3)
        w_text = np.repeat(np.arange(chunk.n), np.diff(w_bounds))
        again = repeated(windows, w_text) & (counts >= 3)[w_text]
        at = (bounds[:-1] - w_bounds[:-1])[w_text] + np.arange(len(windows))
        covered = np.zeros(len(hashes) + 3, dtype=bool)
        for k in range(3):
            covered[at[again] + k] = True
        l_starts, l_ends = chunk.runs(NEWLINE)
        lines = chunk.hashes(sums, l_starts, l_ends)
        worded = np.searchsorted(starts, l_ends, side="right") > np.searchsorted(starts, l_starts)
        l_text = np.searchsorted(chunk.offsets, l_starts, side="right") - 1
        keys = mix(lines[worded] ^ mix(l_text[worded].astype(np.uint64)))
        first = np.unique(keys, return_index=True)[1]
        dup = np.ones(len(keys), dtype=np.int64)
        dup[first] = 0
        rows = slice(chunk.first, chunk.first + chunk.n)
        out[0][rows] = counts
        out[1][rows] = of_text(IN_WORD[chunk.data])
        out[2][rows] = of_text(IS_SYMBOL[chunk.data])
        out[3][rows] = np.bincount(l_text[worded], weights=dup, minlength=chunk.n).astype(np.int64)
        out[5][rows] = np.bincount(l_text[worded], minlength=chunk.n)
        out[4][rows] = np.diff(np.concatenate([[0], np.cumsum(covered[: len(hashes)])])[bounds])
    return out


def repeated(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which hashes occur again in their own text."""
    keys = mix(hashes ^ mix(text.astype(np.uint64)))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flags = np.zeros(len(keys), dtype=bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


BASE_SQL = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

#: Both engines run this: {m} is the table of measures, with base_failed; the rest are numbers.
RULES_SQL = """
WITH long AS (
  SELECT lang, source, measure, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / {lng!r}) AS INT) ELSE -2147483648 END AS bucket, count(*) AS n
  FROM (
    SELECT lang, source, 'symbols' AS measure, CAST(n_symbols AS DOUBLE) / nullif(n_words, 0) AS v FROM {m} WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'dup', CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0) FROM {m} WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'repeat', CAST(n_repeat_words AS DOUBLE) / nullif(n_words, 0) FROM {m} WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'length', CAST(word_chars AS DOUBLE) / nullif(n_words, 0) FROM {m} WHERE NOT base_failed
  ) x GROUP BY 1, 2, 3, 4
), levels AS (
  SELECT 'source' AS level, lang, source, measure, bucket, sum(n) AS n FROM long GROUP BY lang, source, measure, bucket
  UNION ALL SELECT 'lang', lang, CAST(NULL AS STRING), measure, bucket, sum(n) FROM long GROUP BY lang, measure, bucket
  UNION ALL SELECT 'all', CAST(NULL AS STRING), CAST(NULL AS STRING), measure, bucket, sum(n) FROM long GROUP BY measure, bucket
), ranked AS (
  SELECT level, lang, source, measure, bucket,
    sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, measure) AS total
  FROM levels
), quantiles AS (
  SELECT level, lang, source, measure, max(total) AS total,
    min(CASE WHEN upto > floor(0.25 * (total - 1)) THEN bucket END) AS b25,
    min(CASE WHEN upto > floor(0.5 * (total - 1)) THEN bucket END) AS b50,
    min(CASE WHEN upto > floor(0.75 * (total - 1)) THEN bucket END) AS b75
  FROM ranked GROUP BY level, lang, source, measure
), wide AS (
  SELECT level, lang, source, measure, total,
    CASE WHEN b25 = -2147483648 THEN 0.0 ELSE {mid!r} * pow({gamma!r}, CAST(b25 AS DOUBLE)) END AS q25,
    CASE WHEN b50 = -2147483648 THEN 0.0 ELSE {mid!r} * pow({gamma!r}, CAST(b50 AS DOUBLE)) END AS q50,
    CASE WHEN b75 = -2147483648 THEN 0.0 ELSE {mid!r} * pow({gamma!r}, CAST(b75 AS DOUBLE)) END AS q75
  FROM quantiles
), fences AS (
  SELECT level, lang, source, max(total) AS total,
    max(CASE WHEN measure = 'symbols' THEN q50 + {k!r} * (q75 - q25) + {symbol_slack!r} END) AS symbols_most,
    max(CASE WHEN measure = 'dup' THEN q50 + {k!r} * (q75 - q25) + {dup_slack!r} END) AS dup_most,
    max(CASE WHEN measure = 'repeat' THEN q50 + {k!r} * (q75 - q25) + {repeat_slack!r} END) AS repeat_most,
    max(CASE WHEN measure = 'length' THEN q50 + {k!r} * (q75 - q25) + {length_slack!r} END) AS length_most,
    max(CASE WHEN measure = 'length' THEN q50 - {k!r} * (q75 - q25) - {length_slack!r} END) AS length_least
  FROM wide GROUP BY level, lang, source
), chosen AS (
  SELECT s.lang AS f_lang, s.source AS f_source,
    CASE WHEN s.total >= {min_documents} THEN s.symbols_most WHEN l.total >= {min_documents} THEN l.symbols_most ELSE a.symbols_most END AS symbols_most,
    CASE WHEN s.total >= {min_documents} THEN s.dup_most WHEN l.total >= {min_documents} THEN l.dup_most ELSE a.dup_most END AS dup_most,
    CASE WHEN s.total >= {min_documents} THEN s.repeat_most WHEN l.total >= {min_documents} THEN l.repeat_most ELSE a.repeat_most END AS repeat_most,
    CASE WHEN s.total >= {min_documents} THEN s.length_most WHEN l.total >= {min_documents} THEN l.length_most ELSE a.length_most END AS length_most,
    CASE WHEN s.total >= {min_documents} THEN s.length_least WHEN l.total >= {min_documents} THEN l.length_least ELSE a.length_least END AS length_least
  FROM (SELECT * FROM fences WHERE level = 'source') s
  JOIN (SELECT * FROM fences WHERE level = 'lang') l ON s.lang IS NOT DISTINCT FROM l.lang
  JOIN (SELECT * FROM fences WHERE level = 'all') a ON a.level IS NOT DISTINCT FROM (CASE WHEN s.level = 'source' THEN 'all' END)
)
"""

KEPT_SQL = """
SELECT {columns}, coalesce(NOT d.base_failed AND
    CAST(d.n_symbols AS DOUBLE) / nullif(d.n_words, 0) <= c.symbols_most AND CAST(d.n_dup_lines AS DOUBLE) / nullif(d.n_lines, 0) <= c.dup_most AND
    CAST(d.n_repeat_words AS DOUBLE) / nullif(d.n_words, 0) <= c.repeat_most AND
    CAST(d.word_chars AS DOUBLE) / nullif(d.n_words, 0) <= c.length_most AND CAST(d.word_chars AS DOUBLE) / nullif(d.n_words, 0) >= c.length_least, false) AS kept
FROM {m} d LEFT JOIN {chosen} c ON d.lang IS NOT DISTINCT FROM c.f_lang AND d.source IS NOT DISTINCT FROM c.f_source
"""


def _numbers(rules: QualityRules) -> dict:
    return {"lng": math.log(GAMMA), "gamma": GAMMA, "mid": 2 / (GAMMA + 1), **rules.__dict__}


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), keep_text: bool = True) -> DataFrame:
    """docs with the measures of MEASURES, base_failed and kept; docs must have text, lang and source.

    The measures are computed once and written to the shared folder, as the sketches and the final join both read them.
    Columns of docs named like an added one give way to it.
    """
    added = [n for n, _ in MEASURES] + ["base_failed", "kept"]
    docs = docs.drop(*added)
    measured = with_columns_from_text(docs, "text", MEASURES, measure, keep_text).withColumn("base_failed", F.expr(BASE_SQL))
    measured = written(measured, "quality")
    spark = docs.sparkSession
    columns = ", ".join(f"d.`{c}`" for c in measured.columns)
    chosen = written(spark.sql(RULES_SQL.format(m="{m}", **_numbers(rules)) + "SELECT * FROM chosen", m=measured), "quality-fences")
    # A row for each (lang, source); shuffled once they are many.
    hint = "/*+ BROADCAST(c) */ " if chosen.count() <= BROADCAST_GROUPS else ""
    return spark.sql(KEPT_SQL.format(m="{m}", chosen="{chosen}", columns=hint + columns), m=measured, chosen=chosen)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs, keep_text=False).select("doc_id", *[n for n, _ in MEASURES], "base_failed", "kept")


#: The measures in DuckDB: words and lines as lists, repeated windows as covered positions.
MEASURES_SQL = r"""
words AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}
), lined AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM words
), windows AS (
  SELECT rid, i, t FROM (
    SELECT rid, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2])) AS t, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), measured AS (
  SELECT l.*, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM lined l LEFT JOIN covered c USING (rid)
), base AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM measured)
"""


def oracle(docs: str = "documents", rules: QualityRules = QualityRules(), columns: str = "d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.n_lines, d.base_failed") -> str:
    """DuckDB SQL of judge() over a table; one statement."""
    body = (RULES_SQL.format(m="base", **_numbers(rules)) + KEPT_SQL.format(m="base", chosen="chosen", columns=columns)).strip()
    return "WITH " + MEASURES_SQL.replace("{docs}", docs).strip() + ", " + body.removeprefix("WITH ")
