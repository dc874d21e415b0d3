"""Capabilities of 128 bits (lo: bits 0 to 63, hi: 64 to 127) and their inverted index as bitmaps.

Nodes are numbered, and 64 of them make a block. The posting list of a bit is a word for each block in which any node owns
it; a requirement's candidates in a block are the AND of its bits' words. So a requirement touches a row for each of its bits
and blocks instead of one for each node, and only what survives is spelled out as nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.places import places
from fleetlens.operators.temporal import same_keys

#: The posting list of all nodes, which a requirement without bits takes.
EVERY = -1


def set_bits(lo: Column, hi: Column) -> Column:
    """The numbers of the bits that are set, ascending."""
    of = lambda word, first: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", word.cast("long"), b) == 1), lambda b: b + first)
    return F.concat(of(F.coalesce(lo, F.lit(0)), 0), of(F.coalesce(hi, F.lit(0)), 64))


def owns(lo: Column, hi: Column, need_lo: Column, need_hi: Column) -> Column:
    """Whether all needed bits are owned."""
    return (lo.bitwiseAND(need_lo) == need_lo) & (hi.bitwiseAND(need_hi) == need_hi)


def numbered(nodes: DataFrame, order: str) -> DataFrame:
    """nodes with block and position, by their place in `order`, which tells them apart."""
    out = places(nodes, [], [order], 100_000, "_place", "_all")
    return out.withColumns({"block": F.shiftright("_place", 6), "position": (F.col("_place") % 64).cast("int")}).drop("_place", "_all")


def postings(nodes: DataFrame) -> DataFrame:
    """bit, block and word of nodes that numbered() gave."""
    filed = nodes.select("block", "position", F.explode(F.concat(F.array(F.lit(EVERY)), set_bits(F.col("lo"), F.col("hi")))).alias("bit"))
    return filed.groupBy("bit", "block").agg(F.bit_or(F.expr("shiftleft(1L, position)")).alias("word"))


def candidates(needs: DataFrame, nodes: DataFrame, order: str, shards: int = 8) -> DataFrame:
    """need_lo, need_hi (each distinct requirement) and the columns of every node that owns all of its bits. Nodes without bits
    (nulls) own none, and a requirement of nulls asks for none. A bit that nearly all ask for is dealt over shards of blocks."""
    nodes = numbered(nodes, order)
    part = (F.col("block") % shards).cast("int")
    asked = needs.select(F.coalesce("need_lo", F.lit(0)).cast("long").alias("need_lo"), F.coalesce("need_hi", F.lit(0)).cast("long").alias("need_hi")).distinct()
    bits = set_bits(F.col("need_lo"), F.col("need_hi"))
    asked = asked.withColumn("bits", F.when(F.size(bits) > 0, bits).otherwise(F.array(F.lit(EVERY)))).withColumn("many", F.size("bits"))
    asked = asked.select("need_lo", "need_hi", "many", F.explode("bits").alias("bit")).withColumn("shard", F.explode(F.array(*[F.lit(s) for s in range(shards)])))
    words = asked.join(postings(nodes).withColumn("shard", part), ["bit", "shard"])
    both = words.groupBy("need_lo", "need_hi", "many", "block").agg(F.bit_and("word").alias("word"), F.count(F.lit(1)).alias("found"))
    left = both.where((F.col("found") == F.col("many")) & (F.col("word") != 0))
    spelled = left.select("need_lo", "need_hi", "block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", F.col("word"), b) == 1)).alias("position"))
    return spelled.join(nodes, ["block", "position"]).drop("block", "position")


def supply(nodes: DataFrame) -> DataFrame:
    """bit and nodes: how many own each bit of 128, counted on the bitmaps."""
    return postings(numbered(nodes, "idx")).where(F.col("bit") != EVERY).groupBy("bit").agg(F.sum(F.bit_count("word")).cast("long").alias("nodes"))


def bloom_words(digests: DataFrame, column: str, words: int) -> DataFrame:
    """A Bloom filter of `words` words with four bits of one word for each digest; filters of parts merge by OR of their words."""
    return digests.where(F.col(column).isNotNull()).select(word_of(column, words).alias("place"), mask_of(column).alias("mask")).groupBy("place").agg(F.bit_or("mask").alias("word"))


def word_of(column: str, words: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(1)), F.lit(words)).cast("int")


def mask_of(column: str) -> Column:
    h = F.xxhash64(F.col(column), F.lit(2))
    out = F.lit(0).cast("long")
    for k in range(4):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return out


#: The largest filter that is broadcast, and digests a word up to which it is worth it.
MOST_WORDS, DIGESTS_A_WORD = 1 << 20, 12


def with_maybe(rows: DataFrame, column: str, held: DataFrame, name: str = "maybe") -> DataFrame:
    """rows with `name`: false where the column's value surely isn't among held (a column of the same name), by a Bloom filter that is
    broadcast at a checked size; true for all where held has too many values for one. Null is never held."""
    many = held.count()
    if many > MOST_WORDS * DIGESTS_A_WORD:
        return rows.withColumn(name, F.col(column).isNotNull())
    words = max(1, min(MOST_WORDS, many // 4))
    place, word = "_bloom_place", "_bloom_word"
    bloom = bloom_words(held, column, words).select(F.col("place").alias(place), F.col("word").alias(word))
    looked = rows.withColumn(place, word_of(column, words)).join(F.broadcast(bloom), place, "left")
    return looked.withColumn(name, F.col(column).isNotNull() & F.coalesce(F.col(word).bitwiseAND(mask_of(column)) == mask_of(column), F.lit(False))).drop(place, word)


def missing(chunks: DataFrame, held: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, bytes of chunks (digest, size) that aren't held (digest); repeated ones count each time. Most chunks that
    aren't held never meet the held ones: only what the filter lets pass is shuffled by digest and checked exactly."""
    judged = with_maybe(chunks.select(key, "digest", "size"), "digest", held)
    sure = judged.groupBy(key).agg(F.sum(F.when(F.col("maybe"), 0).otherwise(F.col("size"))).alias("sure"))
    checked = judged.where("maybe").join(held.select("digest"), "digest", "left_anti").groupBy(key).agg(F.sum("size").alias("more"))
    out = sure.join(checked, same_keys(sure, checked, [key]), "left").select(sure[key], (F.col("sure") + F.coalesce("more", F.lit(0))).cast("long").alias("missing"))
    return out
