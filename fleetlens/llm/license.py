"""License scan by canonical digest: normalise a whole text, hash it, and join it to known licence digests.

Canonical form: lower case; copyright lines dropped; equivalent spellings made one; every run of characters other than
letters and digits is one blank. SHA-256 of that form is the digest. A document is matched as an entire text, and so is
each of its lines as an entire notice; lines are hashed only where the canonical length equals that of a known
notice, which loses nothing as equal digests have equal lengths. DataFrame functions only.

Each text is normalised once: its digests are written to the shared folder, and both joins read them there.

Defined cases: null text is empty, and an empty canonical form matches nothing; repeated rows are scanned each; of known
texts with equal digests the smaller id holds; line licences are a sorted set; an empty table gives an empty result. Other
columns pass through, whatever their names; those named text_digest, license or line_licenses give way to the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import free_name, spread_join, table, written

#: Known digests beyond this number are joined by shuffle instead of broadcast.
BROADCAST_TEXTS = 100_000

#: Equivalent spellings, canonical one last.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("noncommercial", "non commercial"), ("per cent", "percent"), ("copyright holders", "copyright owner"), ("copyright holder", "copyright owner"), ("copyright owners", "copyright owner"), ("https", "http")]

#: Public licence notices and short licence texts by SPDX id.
KNOWN_TEXTS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: SPDX id, canonical length and SHA-256 of the canonical form of entire public licence texts.
KNOWN_DIGESTS: list[tuple[str, int, str]] = [
    ("Apache-2.0", 9701, "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Artistic-1.0-Perl", 5702, "fe5e2754088225b53b69f1a45c4eecc5c71ab693ce0f9e07644ce6ceaed93d27"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19511, "147090646e5214b12c69c17a616c056c0f4daf13cccbecdb5a17f63d9be3c628"),
    ("GFDL-1.3", 21874, "82a751ff10cbb01febb86b5390413add4d0ffb4072c50249f0757734ac3a93b4"),
    ("GPL-1.0", 11762, "2d47921d29f008ee550b830feff0fe3dd3797f57cbe7f34fef1ffc1d0ba0d3a5"),
    ("GPL-2.0", 17049, "a68777380ee9468dbcb12920a70e873d0b01d4322c910d0699c72de63fce64df"),
    ("GPL-3.0", 33265, "9e383951236fb84891be2d6ae1c518d774dc9cd5d9a08979304f4c2ab7dd9196"),
    ("LGPL-2.0", 23994, "116de230f9adc9f315ddbd4ab9ed0fd4e404ce08977d315d165cf0fd280f2b65"),
    ("LGPL-2.1", 25081, "4526497657ce5d416593599152e1495d0b5c6157da49f3ac41aa1bf5aa6f50b7"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22339, "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", 14271, "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]

#: Lines that start so are copyright lines, after blanks, quote marks and comment signs.
COPYRIGHT_LINE = r"(?im)^[ \t/*#;>-]*(copyright|\(c\)|©)[ \t:].*$"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, one a line, with a blank at either end; null as empty."""
    out = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, " "))
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " "), r"\n", " \n "), F.lit(" "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {one} "))
    return out


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), r"[ \n]+", " "))


def known_licenses(spark, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license and canonical length of each known text; equal digests keep the smaller id."""
    rows = spark.createDataFrame(texts or KNOWN_TEXTS, "license string, text string")
    form = canonical(F.col("text"))
    rows = rows.select("license", F.length(form).alias("length"), F.sha2(form, 256).alias("digest"))
    if texts is None:
        rows = rows.unionByName(spark.createDataFrame(KNOWN_DIGESTS, "license string, length int, digest string"))
    return rows.groupBy("digest", "length").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with text_digest, license (of the entire text, else null) and line_licenses (sorted ids of whole lines).

    Two equi-joins with the known digests: of entire texts, and of the lines whose canonical length a known text has.
    The second is keyed by the raw text's digest, so equal texts are looked up once.
    """
    docs = docs.drop("text_digest", "license", "line_licenses")
    small = known.count() <= BROADCAST_TEXTS
    # Of more known texts than that, the lengths aren't collected and lines of any length are hashed.
    lengths = sorted({r.length for r in known.select("length").distinct().collect()}) if small else []
    lines, raw, fits, unit, name, found_, digest = (free_name(docs, x) for x in ("lines", "raw", "fits", "unit", "known", "found", "digest"))
    whole = F.trim(F.regexp_replace(F.col(lines), r"[ \n]+", " "))
    line = lambda x: F.trim(F.regexp_replace(x, " +", " "))
    near_lines = F.filter(F.split(F.col(lines), "\n"), lambda x: F.length(x) >= (lengths[0] if lengths else 1 << 30 if small else 1))
    forms = F.filter(F.transform(near_lines, line), lambda x: F.length(x).isin(lengths) if small else F.length(x) > 0)
    out = docs.withColumn(lines, canonical_lines(F.col(text)))
    out = out.withColumn("text_digest", F.sha2(whole, 256)).withColumn(fits, F.array_distinct(F.transform(forms, lambda x: F.sha2(x, 256))))
    out = out.withColumn(raw, F.when(F.size(fits) > 0, F.sha2(F.col(text), 256)))
    kept = [c for c in docs.columns if keep_text or c != text]
    out = written(out.select(*[F.col(f"`{c}`") for c in kept], "text_digest", raw, fits, F.monotonically_increasing_id().alias(unit)), "licenses")
    index = known.select(F.col("digest").alias(digest), F.col("license").alias(name))
    # A frequent text's rows, and those without a fitting line, are dealt over tasks.
    if small:
        index = F.broadcast(index)
        out = out.join(index, F.col("text_digest") == F.col(digest), "left").drop(digest)
    else:
        out = spread_join(out, index.withColumnRenamed(digest, "text_digest"), ["text_digest"], unit, "left")
    found = (
        out.where(F.size(fits) > 0).select(raw, fits).distinct().select(raw, F.explode(fits).alias(digest))
        .join(index.withColumnRenamed(name, found_), digest).groupBy(raw).agg(F.array_sort(F.collect_set(found_)).alias(found_))
    )
    out = spread_join(out, found, [raw], unit, "left")
    return out.select(*[F.col(f"`{c}`") for c in kept], "text_digest", F.col(name).alias("license"), F.coalesce(found_, F.array().cast("array<string>")).alias("line_licenses"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, known_licenses(spark), keep_text=False)
    return out.select("doc_id", "text_digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"))


def oracle() -> str:
    """DuckDB SQL of op6: the same forms by RE2."""

    def lines(x: str) -> str:
        out = f"lower(regexp_replace(coalesce({x}, ''), '{COPYRIGHT_LINE.replace('(?im)', '')}', ' ', 'gim'))"
        out = f"' ' || regexp_replace(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), '\\n', ' ' || chr(10) || ' ', 'g') || ' '"
        for other, one in SPELLINGS:
            out = f"replace({out}, ' {other} ', ' {one} ')"
        return out

    flat = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    values = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN_TEXTS)
    digests = ", ".join(f"('{i}', '{d}')" for i, _, d in KNOWN_DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(i) AS license FROM (SELECT i, sha256({flat(lines('t'))}) AS digest FROM (VALUES {values}) AS k(i, t) UNION ALL SELECT i, digest FROM (VALUES {digests}) AS e(i, digest)) GROUP BY 1
), forms AS (
  SELECT row_number() OVER () AS rid, doc_id, {lines('text')} AS ls FROM documents
), hashed AS (
  SELECT rid, doc_id, ls, sha256({flat('ls')}) AS text_digest FROM forms
), lined AS (
  SELECT rid, string_agg(license, ',' ORDER BY license) AS line_licenses FROM (
    SELECT DISTINCT u.rid, k.license FROM (SELECT rid, unnest(string_split(ls, chr(10))) AS line FROM forms) u JOIN known k ON k.digest = sha256({flat('u.line')})
  ) GROUP BY rid
)
SELECT h.doc_id, h.text_digest, k.license, coalesce(l.line_licenses, '') AS line_licenses
FROM hashed h LEFT JOIN known k ON k.digest = h.text_digest LEFT JOIN lined l ON l.rid = h.rid"""
