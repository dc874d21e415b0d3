"""Near duplicates by MinHash with sequential Bayesian verification.

1. Every text's word shingles give a signature of bands * rows minima; texts with the same word sequence (by SHA-256 of
   it) form a class, and one of them stands for it.
2. Classes that share a band's hash are in one bucket. In each bucket the class with the largest total bucket size
   (the likeliest original of a group of copies) is compared with all others, so a bucket of n gives n - 1 pairs.
3. Pairs are pruned batch by batch of the signature as soon as the posterior chance of similarity >= threshold falls
   below `miss`; survivors are confirmed on full shingle sets.
4. Components come from rounds of large-star and small-star on the links. Buckets whose members are still in several
   components have a further hub while that halves what is left to compare; then the members outside a bucket's largest
   component are compared with all its members, in blocks of bounded size that hold full shingle sets. A block gives the
   links of a spanning forest of its components and nothing else, so its result is as long as its input at most, no
   candidate pair that could join two components goes unseen, and one rule prunes in buckets of any size.

At the defaults a pair of similarity 0.8 shares no band with probability 7e-5 and is pruned with less than `miss` a
batch. Rows of hot classes, hubs and buckets are dealt over several tasks. Everything is in tables of the shared folder;
nothing of the corpus comes to the driver.

Defined cases: a text without words (or null) has no shingles and is its own component; one with fewer words than a
shingle is one shingle; rows that share a doc_id are compared each; a row with a null doc_id is compared as any other and
links others, but its component is null and it is kept only if it is chosen; an empty table gives an empty result. Other
columns pass through, whatever their names; those named as an added one give way to it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import by_task, free_name, let_go, numbered, release, rows_of_tasks, spread_join, table, text_bytes, with_columns_from_text, written
from fleetlens.llm.tokens import chunks, shingles, words

#: Rows of the two sides of a block, and shingles in them, about which a larger bucket is cut.
X_BLOCK, Y_BLOCK, BLOCK_SHINGLES = 256, 1024, 1 << 20
#: Width of the size classes in a block comparison: similar sets are in the same class or in neighbouring ones.
SIZE_STEP = 1.26


@dataclass(frozen=True)
class NearDup:
    """percent: least similarity of a link, in whole percent (80 or more); miss: chance at which a pair is given up unverified."""

    shingle: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 5
    batch: int = 20
    miss: float = 1e-6

    @property
    def size(self) -> int:
        return self.bands * self.rows


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as written() does, after what earlier tables have left in the driver has gone: a run writes dozens of them, each with
    plans many times as large as what stays."""
    let_go(df.sparkSession)
    return written(df, name)


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(77))
    return draw.integers(0, 1 << 63, n, dtype=np.uint64), draw.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def sign(batch: pa.RecordBatch, how: NearDup) -> list[list]:
    """Set size, class key (SHA-256 of the word sequence, null without words) and signature of each text."""
    flip, times = seeds(how.size)
    sizes, keys, signatures = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
    for chunk in chunks(batch, "text"):
        hashes, bounds = words(chunk, lower=True)
        windows, w_bounds = shingles(hashes, bounds, how.shingle)
        raw = chunk.data.tobytes()
        for i in range(chunk.n):
            if bounds[i] == bounds[i + 1]:
                continue
            mine = np.unique(windows[w_bounds[i] : w_bounds[i + 1]])
            least = np.full(how.size, ~np.uint64(0))
            for at in range(0, len(mine), 1024):
                least = np.minimum(least, ((mine[at : at + 1024, None] ^ flip) * times).min(axis=0))
            row = chunk.first + i
            sizes[row] = len(mine)
            signatures[row] = (least >> np.uint64(32)).astype("<u4").tobytes()
            keys[row] = hashlib.sha256(b" ".join(raw[chunk.offsets[i] : chunk.offsets[i + 1]].lower().split())).digest()
    return [sizes, keys, signatures]


def fewest(n: int, t: float, miss: float) -> int:
    """Fewest of n equal hashes with which the posterior chance of agreement t or more is `miss` at least: a uniform prior
    gives a beta posterior, whose mass above t is P(Bin(n + 1, t) <= matches)."""
    mass, m = 0.0, 0
    while m <= n:
        mass += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t)) if t < 1 else float(m == n)
        if mass >= miss:
            break
        m += 1
    return m


def least_matches(how: NearDup) -> list[tuple[int, int]]:
    """(hashes seen, fewest equal ones to go on) after each batch."""
    return [(n, fewest(n, how.percent / 100, how.miss)) for n in [*range(how.batch, how.size, how.batch), how.size]]


def survivors(one: np.ndarray, many: np.ndarray, alive: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of many (of those in alive) one signature, or one for each row, doesn't rule out, batch by batch."""
    matches, seen = np.zeros(len(many), dtype=np.int64), 0
    for n, least in steps:
        with_ = one[seen:n] if one.ndim == 1 else one[alive, seen:n]
        matches[alive] += (many[alive, seen:n] == with_).sum(axis=1)
        alive, seen = alive[matches[alive] >= least], n
    return alive


def stacked(signatures: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype="<u4").reshape(-1, size)


def similar(x: set, y: set, how: NearDup) -> bool:
    both = len(x & y)
    return both > 0 and 100 * both >= how.percent * (len(x) + len(y) - both)


def shingle_set(text: bytes, size: int) -> set:
    w = text.lower().split()
    return set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else ({tuple(w)} if w else set())


def prune(pairs: DataFrame, signs: DataFrame, how: NearDup) -> DataFrame:
    """The pairs (a, b) that survive the sequential comparison of their signatures; b may be a hub; signs: id, sig, n_shingles."""
    left = signs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    right = signs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    both = spread_join(pairs.join(left, "a"), right, ["b"], "a").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * how.percent)
    steps = least_matches(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (stacked(batch.column(batch.schema.get_field_index(c)).to_pylist(), how.size) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).take(pa.array(survivors(x, y, np.arange(len(x)), steps)))
        release()

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def texts_of(ids: DataFrame, live: DataFrame) -> DataFrame:
    """id and text of the classes in ids (id), fetched where the rows lie by their numbers."""
    units = ids.select(F.col("id").alias("unit")).distinct()
    return stored(rows_of_tasks(live.select("id", "part", "text"), "part", "id", units).select("id", "text"), "near-texts")


def confirm(pairs: DataFrame, live: DataFrame, how: NearDup, salts: int = 64) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. A hub's text goes once to each of the tasks that its
    pairs are dealt to, ahead of the texts that it is compared with."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int").alias("salt"))
    texts = texts_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), live)
    mine = pairs.join(texts.select(F.col("id").alias("a"), "text"), "a").select("b", "salt", "a", "text")
    hubs = pairs.select("b", "salt").distinct().join(texts.select(F.col("id").alias("b"), "text"), "b")
    dealt = mine.unionByName(hubs.select("b", "salt", F.lit(None).cast("long").alias("a"), "text"))
    dealt = dealt.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: set = set()
        for batch in batches:
            yes = []
            for i, (a, text) in enumerate(zip(batch.column(batch.schema.get_field_index("a")).to_pylist(), text_bytes(batch, "text"))):
                own = shingle_set(text, how.shingle)
                if a is None:
                    hub = own
                elif similar(own, hub, how):
                    yes.append(i)
            yield batch.select(["a", "b"]).take(pa.array(yes, type=pa.int64()))
        hub = set()
        release()

    return dealt.mapInArrow(run, "a long, b long")


def sets_of(ids: DataFrame, live: DataFrame, how: NearDup) -> DataFrame:
    """id and full set (ascending 64-bit shingle hashes, 8 bytes each) of the classes in ids."""

    def rows(batch: pa.RecordBatch) -> list[list]:
        out: list = [None] * batch.num_rows
        for chunk in chunks(batch, "text"):
            windows, bounds = shingles(*words(chunk, lower=True), how.shingle)
            for i in range(chunk.n):
                out[chunk.first + i] = np.unique(windows[bounds[i] : bounds[i + 1]]).tobytes()
        return [out]

    return stored(with_columns_from_text(texts_of(ids, live), "text", [("full", T.BinaryType())], rows, keep_text=False), "near-sets")


def forest(one: list[tuple], two: list[tuple], how: NearDup, steps: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links (a, b) between members (id, root, n_shingles, sig, full) of one and of two that join different components, each
    exact on full sets: a spanning forest of what they join, so fewer than there are members."""
    if not one or not two:
        return []
    x, y = (stacked([m[3] for m in part], how.size) for part in (one, two))
    n_y = np.array([m[2] for m in two])
    sets = [np.frombuffer(m[4], dtype=np.uint64) for m in two]
    above: dict = {}

    def top(r):
        while r in above:
            r = above[r]
        return r

    out = []
    for (id_x, root_x, n_x, _, full), sig in zip(one, x):
        alive = np.flatnonzero(np.minimum(n_x, n_y) * 100 >= np.maximum(n_x, n_y) * how.percent)
        alive = survivors(sig, y, alive, steps)
        mine = top(root_x)
        alive = [j for j in alive.tolist() if top(two[j][1]) != mine]
        if not alive:
            continue
        own = np.frombuffer(full, dtype=np.uint64)
        lengths = n_y[alive]
        joined = np.concatenate([sets[j] for j in alive])
        place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        both = np.add.reduceat((own[place] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        for j in np.flatnonzero(100 * both >= how.percent * (n_x + lengths - both)).tolist():
            other = top(two[alive[j]][1])
            if other != top(root_x):
                above[max(other, top(root_x))] = min(other, top(root_x))
                out.append((id_x, two[alive[j]][0]))
    return out


def across(left: DataFrame, signs: DataFrame, live: DataFrame, how: NearDup) -> DataFrame:
    """Links (a, b) that join the components of each bucket's members; left: bucket, id, root.

    Members outside a bucket's largest component are compared with all its members of a like set size, both in blocks.
    """
    left = left.select("bucket", "id", "root").join(signs.select("id", "n_shingles"), "id")
    left = left.withColumn("c", F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(SIZE_STEP)).cast("int"))
    main = left.groupBy("bucket", "root").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max(F.struct("m", "root"))["root"].alias("main"))
    left = stored(spread_join(left, main, ["bucket"], "id"), "near-open")
    out_ = F.col("root") != F.col("main")
    blocks = lambda rows, many: F.ceil(F.greatest(F.sum(rows.cast("int")) / many, F.sum(F.when(rows, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    cuts = left.groupBy("bucket", "c").agg(blocks(out_, X_BLOCK).alias("x"), blocks(F.lit(True), Y_BLOCK).alias("y"))
    dealt = spread_join(left, cuts, ["bucket", "c"], "id").withColumn("at", F.xxhash64("id", F.lit(7)))
    # A block is (bucket, class of its x side, x block, class of its y side, y block).
    near = lambda name: F.explode(F.expr("array(c - 1, c, c + 1)")).alias(name)
    own = ["bucket", "id", "root", "n_shingles"]
    probes = dealt.where(out_).select(*own, F.col("c").alias("cx"), F.pmod("at", "x").cast("int").alias("xb"), near("cy"))
    probes = spread_join(probes, cuts.select("bucket", F.col("c").alias("cy"), F.col("y").alias("many")), ["bucket", "cy"], "id")
    probes = probes.select(*own, "cx", "xb", "cy", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("yb"), F.lit(0).alias("side"))
    filed = dealt.select(*own, F.col("c").alias("cy"), F.pmod("at", "y").cast("int").alias("yb"), near("cx"))
    filed = spread_join(filed, cuts.where("x > 0").select("bucket", F.col("c").alias("cx"), F.col("x").alias("many")), ["bucket", "cx"], "id")
    filed = filed.select(*own, "cx", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("xb"), "cy", "yb", F.lit(1).alias("side"))
    full = sets_of(left.select("id"), live, how).join(signs.select("id", "sig"), "id")
    block = ["bucket", "cx", "xb", "cy", "yb"]
    rows = spread_join(probes.unionByName(filed), full, ["id"], "bucket")
    rows = rows.select(*block, "side", "id", "root", "n_shingles", "sig", "full").repartition(*block).sortWithinPartitions(*block, "side", "id")
    steps = least_matches(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sides = None, ([], [])
        for batch in batches:
            found = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:5] != current:
                    found += forest(*sides, how, steps)
                    current, sides = row[:5], ([], [])
                sides[row[5]].append(row[6:])
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = forest(*sides, how, steps)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        release()

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """id and root (least id of its component) of every id in links (a, b), by large-star and small-star rounds."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both.where("v > u"), least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, f"{name}-large")  # read four times below: a plan with as many copies of it fills the driver
        # Now each u has smaller neighbours v only; all of them and u itself move to the least.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low.where("n > 1").select("u", "m"), ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), name)
        # Done when all are stars: no id has two neighbours below it, or one below and one above.
        ends = edges.select(F.col("u").alias("w"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("w"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if not ends.groupBy("w").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").limit(1).count():
            break
    pairs = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return pairs.unionByName(pairs.select(F.col("root").alias("id"), "root").distinct())


def _linked(signs: DataFrame, live: DataFrame, how: NearDup) -> DataFrame | None:
    """id and root of the classes that have links; None without any candidates."""
    width = 4 * how.rows
    bands = F.transform(F.sequence(F.lit(0), F.lit(how.bands - 1)), lambda i: F.xxhash64(F.substring(F.col("sig"), i * width + 1, F.lit(width)), i))
    entries = signs.select("id", F.explode(bands).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(spread_join(entries, shared, ["bucket"], "id"), "near-members")
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    left = stored(members.drop("n").join(degree, "id"), "near-ranked")
    labels: DataFrame | None = None

    def link(found: DataFrame) -> DataFrame:
        """Components with the links found (a, b)."""
        known = found.select("a", "b") if labels is None else found.select("a", "b").unionByName(labels.select(F.col("id").alias("a"), F.col("root").alias("b")))
        return stored(components(known, "near-star"), "near-labels")

    def unresolved(rows: DataFrame) -> DataFrame:
        """Rows of the buckets whose members are in several components, with their root."""
        rows = rows.drop("root")
        rows = rows.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ones = rows.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
        return stored(spread_join(rows, open_ones, ["bucket"], "id"), "near-left")

    before = None
    while True:
        hubs = left.groupBy("bucket").agg(F.max(F.struct("degree", "id"))["id"].alias("b"))
        at = spread_join(left, hubs, ["bucket"], "id").where("id <> b")
        likely = stored(prune(at.select(F.col("id").alias("a"), "b").distinct(), signs, how), "near-likely")
        labels = link(stored(confirm(likely, live, how), "near-links"))
        left = unresolved(at.drop("b"))
        cross = left.groupBy("bucket", "root").agg(F.count("*").cast("double").alias("m")).groupBy("bucket").agg(F.sum("m").alias("s"), F.max("m").alias("most"))
        work, rows = (x or 0.0 for x in cross.agg(F.sum((F.col("s") - F.col("most")) * F.col("s")), F.sum("s")).first())
        if work <= X_BLOCK * rows or before is not None and work > before / 2:
            break
        before = work
    return link(stored(across(left, signs, live, how), "near-across")) if work else labels


def near_duplicates(docs: DataFrame, how: NearDup = NearDup(), keep_text: bool = True) -> DataFrame:
    """docs with n_shingles, component_id (least doc_id reachable by links), kept (it is that document) and chosen (the
    one row of its component that stands for all, one with a doc_id if there is any; a row without words stands for itself)."""
    docs = docs.drop("n_shingles", "component_id", "kept", "chosen")
    key, sig = free_name(docs, "key"), free_name(docs, "sig")
    signed = with_columns_from_text(docs, "text", [("n_shingles", T.LongType()), (key, T.BinaryType()), (sig, T.BinaryType())], lambda batch: sign(batch, how))
    rows, part, unit = numbered(signed, "near-rows")
    narrow = rows.select(F.col(unit).alias("unit"), "doc_id", F.col(key).alias("key"))
    live = rows.select(F.col(unit).alias("id"), F.col(part).alias("part"), "text", F.col(sig).alias("sig"), "n_shingles")
    # A class goes by the row number of the member that stands for it.
    classes = stored(narrow.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "unit")).alias("rep")), "near-classes")
    signs = rows_of_tasks(live.drop("text"), "part", "id", classes.select(F.col("rep.unit").alias("unit")))
    signs = stored(signs.select("id", "sig", "n_shingles"), "near-signs")
    labels = _linked(signs, live, how)

    reps = classes.select("key", F.col("rep.unit").alias("id"), "rep")
    rooted = reps.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    reps = stored(spread_join(rooted, least, ["root"], "id").select("key", F.struct(F.col("least.doc_id"), F.col("least.unit")).alias("d")), "near-reps")
    decided = spread_join(narrow.where("key is not null"), reps, ["key"], "unit").select("unit", "d")
    decided = decided.unionByName(narrow.where("key is null").select("unit", F.struct("doc_id", "unit").alias("d")))
    rep = free_name(rows, "rep")
    out = by_task(rows if keep_text else rows.drop("text"), part, unit, decided, rep)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(f"{rep}.doc_id", "doc_id"))
    chosen = F.col(unit) == F.col(f"{rep}.unit")
    names = [c for c in docs.columns if keep_text or c != "text"]
    return out.select(
        *[F.col(f"`{c}`") for c in names], "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, chosen).alias("kept"),
        chosen.alias("chosen"),
    )


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, NearDup(shingle=4), keep_text=False).select("doc_id", "n_shingles", "component_id", "kept")


def oracle(shingle: int = 4, docs: str = "documents") -> str:
    """DuckDB SQL of op7: exact sets joined on shingles, and a recursive closure."""
    window = " || ' ' || ".join(f"w[i + {k}]" for k in range(shingle))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {shingle - 2}), lambda i: {window}) END) AS s FROM words
), parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), sizes AS (SELECT doc_id, len(s) AS n FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM parts a JOIN parts b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.node
), least AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sizes s JOIN least l USING (doc_id)"""
