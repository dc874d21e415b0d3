"""Best-fit packing of tokenised documents into fixed sequences by a grouping genetic algorithm.

Documents are tokenised, ended by one id, and cut into pieces of at most `capacity` ids (only the first piece may be
shorter). Full pieces are sequences already. The others are dealt by hash into blocks of about BLOCK pieces; each
block is a bin-packing problem of bounded size that `islands` evolve apart. An individual is a list of bins. Crossover
injects whole well-filled bins of one parent into the other, drops the bins that hold an injected piece twice, exchanges
displaced pieces with shorter ones where that fills a bin better (dominance), and best-fits what is left. After each epoch an island's elite migrates to the next one of its block (a window
over the block's few island rows), and the block's best individual is taken. Pieces of badly filled bins meet again
in a second level of blocks, so a block's last bin isn't lost at any size.

Defined cases: null or empty text is the end id alone; repeated rows are packed each; null doc_id is kept; an empty
table gives an empty result. Other columns pass through if named in `keep`.

Ids are those of the tokenizers library. Texts without characters beyond U+024F and without special-token strings
get them from tiktoken with the same vocabulary, which yields the same ids several times faster (tests compare them).
"""

from __future__ import annotations

import base64
import bisect
import json
import random
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import free_name, release, table, text_bytes, written

CAPACITY = 1024
END_ID = 2
BLOCK = 2048
#: Of an epoch. On real documents best fit leaves a block one sequence above its bound, which 50 don't save either (README).
GENERATIONS = 5
#: Bins below this share of the capacity meet again in the second level.
LOOSE = 0.99

_encoders: dict = {}


def encoder(json_path: str, ranks_path: str | None, pattern: str) -> Callable[[str], np.ndarray]:
    """text to ids (uint32), as tokenizers gives them from json_path; ranks_path: the same vocabulary for tiktoken."""
    if (json_path, ranks_path) in _encoders:
        return _encoders[json_path, ranks_path]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    exact: list = []

    def plain(text: str) -> np.ndarray:
        if not exact:
            from tokenizers import Tokenizer

            exact.append(Tokenizer.from_file(json_path))
        return np.array(exact[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if not ranks_path:
        _encoders[json_path, ranks_path] = plain
        return plain
    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        specials = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    del ranks
    odd = re.compile("|".join([r"[^\x00-\u024f]", *map(re.escape, specials)]))

    def encode(s: str) -> np.ndarray:
        return plain(s) if odd.search(s) else np.array(fast.encode_ordinary(s), dtype=np.uint32)

    _encoders[json_path, ranks_path] = encode
    return encode


def public_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cut_pieces(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of `total` ids."""
    first = (total - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def pieces(docs: DataFrame, paths: tuple[str, str | None, str], capacity: int = CAPACITY, end_id: int = END_ID, keep: tuple[str, ...] = ("doc_id",), keep_ids: bool = False) -> DataFrame:
    """A row for each piece: the kept columns (but for those named as an added one), piece, start, length, ids_crc32 and, if
    asked for, ids."""
    added = [("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64())] + [("ids", T.BinaryType(), pa.binary())] * keep_ids
    keep = tuple(k for k in keep if k not in {n for n, _, _ in added})
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(n, t) for n, t, _ in added])
    docs = docs.select(*keep, *(["text"] if "text" not in keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch in batches:
            rows: list[list] = [[] for _ in added]
            source: list[int] = []
            for i, text in enumerate(text_bytes(batch, "text")):
                ids = np.append(encode(text.decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                    raw = ids[start : start + length].tobytes()
                    source.append(i)
                    for column, value in zip(rows, (k, start, length, zlib.crc32(raw), raw)):
                        column.append(value)
            at = pa.array(source, type=pa.int64())
            arrays = [batch.column(batch.schema.get_field_index(k)).take(at) for k in keep]
            arrays += [pa.array(v, type=kind) for v, (_, _, kind) in zip(rows, added)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            del rows, arrays, batch
        release()

    return docs.mapInArrow(run, schema)


class Bins:
    """Bins with best fit in constant time: bins filed by free room, and a bit set of the rooms in use."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.filed: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def add_bin(self, items: list[int]) -> None:
        room = self.capacity - sum(self.lengths[i] for i in items)
        self.filed[room].append(len(self.bins))
        self.used |= 1 << room
        self.bins.append(items)
        self.room.append(room)

    def best_fit(self, item: int) -> None:
        need = self.lengths[item]
        fits = self.used >> need
        if not fits:
            self.add_bin([item])
            return
        room = need + (fits & -fits).bit_length() - 1
        b = self.filed[room].pop()
        if not self.filed[room]:
            self.used &= ~(1 << room)
        self.bins[b].append(item)
        self.room[b] = room - need
        self.filed[room - need].append(b)
        self.used |= 1 << (room - need)


def exchange(bins: list[list[int]], loose: list[int], lengths: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Bins made fuller by loose pieces in the place of shorter ones, which become loose: in each bin with room the exchange
    that fills it most. Loose pieces only get shorter, so what is left fits more easily."""
    rest = sorted((lengths[i], i) for i in loose)
    out = []
    for b in bins:
        room = capacity - sum(lengths[i] for i in b)
        best = (0, None, None)
        for place, i in enumerate(b) if room else ():
            k = bisect.bisect_right(rest, (lengths[i] + room, len(lengths))) - 1
            if k >= 0 and rest[k][0] - lengths[i] > best[0]:
                best = (rest[k][0] - lengths[i], place, k)
        if best[0]:
            _, place, k = best
            b = list(b)
            _, new = rest.pop(k)
            bisect.insort(rest, (lengths[b[place]], b[place]))
            b[place] = new
        out.append(b)
    return out, [i for _, i in rest]


def _build(bins: list[list[int]], loose: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    bins, loose = exchange(bins, loose, lengths, capacity)
    made = Bins(lengths, capacity)
    for b in bins:
        made.add_bin(list(b))
    for i in sorted(loose, key=lambda i: -lengths[i]):
        made.best_fit(i)
    return made.bins


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones: the sum of squared fills, negated so that smaller is better."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject a share of b's well-filled bins into a, drop a's bins with an injected piece, best-fit the displaced."""
    ranked = sorted(b, key=lambda x: -sum(lengths[i] for i in x))
    best = ranked[: max(1, len(ranked) // 2)]
    injected = rng.sample(best, max(1, len(best) // 2))
    held = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if held.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in held]
    return _build(injected + kept, displaced, lengths, capacity)


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empty the few worst bins and an eighth of the others, and place their pieces anew."""
    ranked = sorted(bins, key=lambda x: sum(lengths[i] for i in x))
    few = max(2, len(ranked) // 200)
    gone, rest = ranked[:few], ranked[few:]
    for _ in range(min(max(few, len(ranked) // 8), len(rest))):
        k = rng.randrange(len(rest))
        rest[k], rest[-1] = rest[-1], rest[k]
        gone.append(rest.pop())
    return _build(rest, [i for x in gone for i in x], lengths, capacity)


def evolve(lengths: list[int], capacity: int, rng: random.Random, elite: list[list[int]] | None, immigrant: list[list[int]] | None, generations: int = GENERATIONS, population: int = 5) -> list[list[int]]:
    """The best individual after some generations; stops at once when the bound of total length is met."""
    bound = -(-sum(lengths) // capacity)
    order = list(range(len(lengths)))
    score = lambda x: fitness(x, lengths, capacity)
    people = [x for x in (elite, immigrant) if x]
    if not people:
        people.append(_build([], order, lengths, capacity))
    if len(people[0]) <= bound:
        return people[0]
    while len(people) < population:
        people.append(mutate(people[0], lengths, capacity, rng))
    for _ in range(generations):
        people.sort(key=score)
        if len(people[0]) <= bound:
            break
        a, b = people[0], people[rng.randrange(1, len(people))]
        children = [crossover(a, b, lengths, capacity, rng), crossover(b, a, lengths, capacity, rng)]
        children.append(mutate(children[rng.randrange(2)], lengths, capacity, rng))
        people = sorted(people + children, key=score)[:population]
    return min(people, key=score)


def _assignment(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(assignment) -> list[list[int]] | None:
    if assignment is None or (isinstance(assignment, float)):
        return None
    out: list[list[int]] = [[] for _ in range(int(max(assignment)) + 1)]
    for i, k in enumerate(assignment):
        out[k].append(i)
    return out


def _epoch(capacity: int, seed: int, generations: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            elites, n_bins = [], []
            for block, island, lengths, elite, immigrant in zip(pdf["block"], pdf["island"], pdf["lengths"], pdf["elite"], pdf["immigrant"]):
                rng = random.Random(zlib.crc32(f"{seed}|{block}|{island}".encode()))
                best = evolve([int(x) for x in lengths], capacity, rng, _bins(elite), _bins(immigrant), generations)
                elites.append(_assignment(best, len(lengths)))
                n_bins.append(len(best))
            yield pd.DataFrame({"block": pdf["block"], "island": pdf["island"], "lengths": pdf["lengths"], "elite": elites, "n_bins": n_bins})
        release()

    return run


def _level(rows: DataFrame, capacity: int, block: int, islands: int, epochs: int, generations: int, seed: int) -> DataFrame:
    """rows (unit, length, ...) with bin_block, bin and offset."""
    n = rows.count()
    blocks = max(1, -(-n // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(seed)), F.lit(blocks)).cast("long"))
    grouped = written(dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("unit", "length"))).alias("items")), "pack-blocks")
    parts = max(1, min(blocks * islands, rows.sparkSession.sparkContext.defaultParallelism * 4))
    state = grouped.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.transform("items", lambda x: x["length"].cast("int")).alias("lengths"))
    state = state.withColumn("elite", F.lit(None).cast("array<int>")).withColumn("immigrant", F.lit(None).cast("array<int>")).repartition(parts, "block", "island")
    ring = Window.partitionBy("block").orderBy("island")
    whole = Window.partitionBy("block").orderBy("island").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for e in range(epochs):
        state = state.select("block", "island", "lengths", "elite", "immigrant").mapInPandas(_epoch(capacity, seed * 100 + e, generations), "block long, island int, lengths array<int>, elite array<int>, n_bins int")
        if e + 1 < epochs:
            state = state.withColumn("immigrant", F.coalesce(F.lag("elite").over(ring), F.last("elite").over(whole))).repartition(parts, "block", "island")
    best = state.groupBy("block").agg(F.min_by("elite", F.struct("n_bins", "island")).alias("elite"))
    placed = grouped.join(best, "block").select("block", F.explode(F.arrays_zip("items", "elite")).alias("x"))
    placed = placed.select(F.col("block").alias("bin_block"), F.col("x.items.unit").alias("unit"), F.col("x.elite").alias("bin"), F.col("x.items.length").alias("length"))
    at = Window.partitionBy("bin_block", "bin").orderBy(F.desc("length"), "unit")
    placed = placed.withColumn("offset", F.sum("length").over(at) - F.col("length")).withColumn("fill", F.sum("length").over(Window.partitionBy("bin_block", "bin")))
    return written(placed, "pack-level")


def pack(cut: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = 2, epochs: int = 2, generations: int = GENERATIONS, levels: int = 2, seed: int = 1) -> DataFrame:
    """A table of pieces (with length) with sequence_id and offset, to which columns of these names give way; every other
    column passes through, whatever its name."""
    cut = cut.drop("sequence_id", "offset")
    unit, placed_unit = free_name(cut, "unit"), free_name(cut, "placed")
    rows = written(cut.withColumn(unit, F.monotonically_increasing_id()), "pack-pieces")
    full = rows.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col(unit)).withColumn("offset", F.lit(0).cast("long"))
    left = rows.where(F.col("length") < capacity).select(F.col(unit).alias("unit"), "length")
    placed: DataFrame | None = None
    for level in range(levels):
        out = _level(left, capacity, block, islands, epochs, generations, seed + level)
        last = level + 1 == levels
        kept = out if last else out.where(F.col("fill") >= LOOSE * capacity)
        base = F.lit(level).cast("long") * (1 << 60) + F.col("bin_block") * (1 << 24) + F.col("bin")
        kept = kept.select(F.col("unit").alias(placed_unit), base.alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
        placed = kept if placed is None else placed.unionByName(kept)
        left = out.where(F.col("fill") < LOOSE * capacity).select("unit", "length")
    short = rows.where(F.col("length") < capacity).join(placed, F.col(unit) == F.col(placed_unit)).drop(placed_unit)
    return full.unionByName(short).drop(unit)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(pieces(docs, public_paths())).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
