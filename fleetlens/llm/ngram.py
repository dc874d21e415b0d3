"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash
arrays in the shared folder, and memory-mapped by the workers that score.

Counting: each task hashes its words (64 bits) and gathers bigrams up to a bounded buffer, counts them there by
sorting, and sends one packed array to each shard of the hash range; the number of shards follows the text's size, so a
shard's arrays are of bounded size. A bigram is two 40-bit prefixes of its words' hashes. A bigram shard is merged,
sorted and written as arrays (key, count in a byte, with larger counts apart); what its bigrams say about their words (continuations, successors, totals)
goes as packed arrays to the word shards, where it meets the words' own counts and is written in the same manner.

Model, with bigram discounts D1, D2, D3+ and unigram discounts from counts of counts (Chen and Goodman), V known
words (the end included) and one unknown:
  p(w | v) = max(c(vw) - D, 0) / c(v.) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v.) * p(w)
  p(w) = max(n(.w) - D', 0) / n(..) + (1 - kept mass) / (V + 1)
A context never seen in training leaves p(w). The first word's context is the text's begin, the last token is its end.

Defined cases: null text is empty, which is the end alone; without training text every token is unknown and has
p = 1; null doc_ids are trained on; repeated rows count each; an empty table gives an empty result. Other columns pass
through, whatever their names; n_tokens, n_known, base_score, score and perplexity give way to the added ones.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import held_out, open_fs, put_file, release, shared_path, table, with_columns_from_text, written
from fleetlens.llm.tokens import P, chunks, mix, words

BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: Bigrams that a task holds before it counts and sends them, and text for each shard.
BUFFER = 2_500_000
SHARD_BYTES = 16 << 20
PREFIX = np.uint64(24)


def token_stream(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token) of every token, an end after each text's words, and the texts' token bounds."""
    n = len(bounds) - 1
    out_bounds = bounds + np.arange(n + 1)
    token = np.empty(len(hashes) + n, dtype=np.uint64)
    context = np.empty_like(token)
    at = np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(bounds))
    token[at] = hashes
    token[out_bounds[1:] - 1] = END
    context[1:] = token[:-1]
    context[out_bounds[:-1]] = BEGIN
    return context, token, out_bounds


def pair_key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The bigram's hash, from 40-bit prefixes."""
    return mix(mix(context) * P + token)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of firsts, distinct sorted keys, counts)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, dtype=np.int64)
    if weights is None:
        counts = np.diff(np.append(first, len(ranked)))
    else:
        counts = np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, dtype=np.int64)
    return order[first], ranked[first], counts


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the 64-bit space, so shards in order are one sorted array."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pack_pairs(context: np.ndarray, token: np.ndarray, counts: np.ndarray) -> bytes:
    """Two 40-bit words in 10 bytes, sorted so that the first 8 are differences, whose upper bytes deflate as the counts do."""
    high = (context << np.uint64(24)) | (token >> np.uint64(16))
    order = np.argsort(high)
    planes = np.diff(high[order], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    low = (token[order] & np.uint64(0xFFFF)).astype("<u2").tobytes()
    return np.int64(len(context)).tobytes() + planes[:5].tobytes() + low + zlib.compress(planes[5:].tobytes() + counts[order].astype("<u4").tobytes(), 1)


def unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    low = np.frombuffer(raw, "<u2", n, 8 + 5 * n)
    rest = zlib.decompress(raw[8 + 7 * n :])
    planes = np.concatenate([np.frombuffer(raw, np.uint8, 5 * n, 8).reshape(5, n), np.frombuffer(rest, np.uint8, 3 * n).reshape(3, n)])
    high = np.cumsum(planes.T.copy().view("<u8").reshape(n).astype(np.uint64))
    counts = np.frombuffer(rest, "<u4", n, 3 * n)
    return high >> np.uint64(24), ((high & np.uint64(0xFFFFFF)) << np.uint64(16)) | low.astype(np.uint64), counts.astype(np.int64)


def pack_sorted(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending keys as differences, and columns of small counts, deflated."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zlib.compress(np.int64(len(keys)).tobytes() + steps + b"".join(c.astype("<u4").tobytes() for c in columns), 1)


def unpack_sorted(raw: bytes, columns: int) -> list[np.ndarray]:
    data = zlib.decompress(raw)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    steps = np.frombuffer(data, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view("<u8").reshape(n)
    return [np.cumsum(steps.astype(np.uint64))] + [np.frombuffer(data, "<u4", n, 8 + 8 * n + 4 * n * k).astype(np.int64) for k in range(columns)]


def _count(shards: int):
    def flush(pairs: list, out: list) -> None:
        context, token = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        _, found, n = counted(token)
        at = shard_of(found, shards)
        for s, lo, hi in _cuts(at, shards):
            out.append((1, s, pack_sorted(found[lo:hi], n[lo:hi])))
        short_c, short_t = context >> PREFIX, token >> PREFIX
        first, keys, n = counted(pair_key(short_c, short_t))
        at = shard_of(keys, shards)
        for s, lo, hi in _cuts(at, shards):
            out.append((2, s, pack_pairs(short_c[first[lo:hi]], short_t[first[lo:hi]], n[lo:hi])))
        pairs.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, out = [], 0, []
        for batch in batches:
            for chunk in chunks(batch, "text"):
                context, token, _ = token_stream(*words(chunk, lower=True))
                pairs.append((context, token))
                held += len(token)
                if held >= BUFFER:
                    flush(pairs, out)
                    yield from _rows(out)
                    held = 0
        if pairs:
            flush(pairs, out)
            yield from _rows(out)
        release()

    return run


def _cuts(at: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    bounds = np.searchsorted(at, np.arange(shards + 1))
    return ((s, int(bounds[s]), int(bounds[s + 1])) for s in range(shards) if bounds[s] < bounds[s + 1])


def _rows(out: list) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(out), 16):
        part = out[at : at + 16]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.binary())], names=["kind", "shard", "packed"])
    out.clear()


def _merge_pairs(folder: str, shards: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        rows = [(1, shard, p, None) for p in pdf["packed"][pdf["kind"] == 1]]  # words have the same shards
        packed = pdf["packed"][pdf["kind"] == 2]
        if not len(packed):
            return pd.DataFrame(rows, columns=["kind", "shard", "packed", "said"])
        context, token, n = (np.concatenate(x) for x in zip(*map(unpack_pairs, packed)))
        first, keys, n = counted(pair_key(context, token), n)
        context, token = context[first], token[first]
        put_file(f"{folder}/pairs-{shard:06d}.key", lambda out: out.write(keys.astype("<u8").tobytes()))
        put_file(f"{folder}/pairs-{shard:06d}.n", lambda out: out.write(np.minimum(n, 255).astype(np.uint8).tobytes()))
        often = n >= 255
        put_file(f"{folder}/often-{shard:06d}.key", lambda out: out.write(keys[often].astype("<u8").tobytes()))
        put_file(f"{folder}/often-{shard:06d}.n", lambda out: out.write(n[often].astype("<u8").tobytes()))
        order, v, total = counted(context, n)
        parts = [np.add.reduceat(flag[np.argsort(context, kind="stable")], np.searchsorted(np.sort(context), v)) for flag in ((n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64))]
        for s, lo, hi in _cuts(shard_of(v << PREFIX, shards), shards):
            rows.append((3, s, pack_sorted(v[lo:hi], total[lo:hi], *[p[lo:hi] for p in parts]), None))
        _, w, before = counted(token)
        for s, lo, hi in _cuts(shard_of(w << PREFIX, shards), shards):
            rows.append((4, s, pack_sorted(w[lo:hi], before[lo:hi]), None))
        rows.append((0, shard, None, json.dumps({"pairs": len(n), "of": [int((n == k).sum()) for k in (1, 2, 3, 4)]})))
        del context, token, keys, n, v, w, before, total, parts, order
        release()
        return pd.DataFrame(rows, columns=["kind", "shard", "packed", "said"])

    return run


def _merge_words(folder: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        of = lambda kind, columns: [np.concatenate(x) for x in zip(*[unpack_sorted(p, columns) for p in pdf["packed"][pdf["kind"] == kind]])] or [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * columns
        word, n = of(1, 1)
        _, word, n = counted(word, n)
        context, total, one, two, more = of(3, 4)
        _, v, total_v = counted(context, total)
        ones, twos, mores = (counted(context, x)[2] for x in (one, two, more))
        token, before = of(4, 1)
        _, w, before = counted(token, before)
        begin = np.array([BEGIN >> PREFIX])
        known = np.concatenate([word, np.array([BEGIN])]) if np.isin(begin, v)[0] else word
        known, n = (np.sort(known), np.append(n, 0)[np.argsort(known, kind="stable")] if len(known) > len(word) else n)

        def at(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
            place = np.searchsorted(keys, known >> PREFIX)
            fits = place < len(keys)
            fits[fits] = keys[place[fits]] == known[fits] >> PREFIX
            out = np.zeros(len(known), dtype=np.int64)
            out[fits] = values[place[fits]]
            return out

        columns = {"n": n, "before": at(w, before), "total": at(v, total_v), "one": at(v, ones), "two": at(v, twos), "more": at(v, mores)}
        put_file(f"{folder}/words-{shard:06d}.key", lambda out: out.write(known.astype("<u8").tobytes()))
        for name, values in columns.items():
            put_file(f"{folder}/words-{shard:06d}.{name}", lambda out, values=values, kind="<u8" if name in ("n", "total") else "<u4": out.write(values.astype(kind).tobytes()))
        said = {"tokens": int(n.sum()), "words": int((n > 0).sum()), "before": int(before.sum()), "of": [int((before == k).sum()) for k in (1, 2, 3, 4)]}
        return pd.DataFrame([(0, shard, None, json.dumps(said))], columns=["kind", "shard", "packed", "said"])

    return run


def discounts(of: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of things counted once to four times; fallbacks where a number is 0."""
    n1, n2, n3, n4 = of
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    made = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(made)]


def train(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> dict:
    """Count docs and write the model; returns its description (folder, shards and a dozen numbers)."""
    spark: SparkSession = docs.sparkSession
    folder = shared_path(spark, "ngram-model")
    docs = docs.select(F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    schema = "kind int, shard long, packed binary"
    out = "kind int, shard long, packed binary, said string"
    pairs = written(docs.mapInArrow(_count(shards), schema).groupBy("shard").applyInPandas(_merge_pairs(folder, shards), out), "ngram-pairs")
    done = written(pairs.where("kind > 0").drop("said").groupBy("shard").applyInPandas(_merge_words(folder), out), "ngram-words")
    facts = lambda df, names: df.where("kind = 0").select(F.from_json("said", "tokens long, words long, before long, pairs long, of array<long>").alias("s")).agg(*[F.sum(f"s.{x}").alias(x) for x in names], *[F.sum(F.col("s.of")[k]).alias(f"of{k}") for k in range(4)]).first()
    p, w = facts(pairs, ["pairs"]), facts(done, ["tokens", "words", "before"])
    number = lambda x: int(x or 0)
    has = lambda kind: sorted(r.shard for r in kind.where("kind = 0").select("shard").collect())
    return {
        "folder": folder, "shards": shards, "pair_shards": has(pairs), "word_shards": has(done),
        "tokens": number(w.tokens), "words": number(w.words), "pairs": number(w.before),
        "d": discounts([number(p[f"of{k}"]) for k in range(4)]), "d1": discounts([number(w[f"of{k}"]) for k in range(4)]), "of1": [number(w[f"of{k}"]) for k in range(4)],
    }


@lru_cache(maxsize=4096)
def mapped(uri: str, kind: str) -> np.ndarray:
    """A model array: memory-mapped where the shared folder is a local path, else read."""
    from pyarrow import fs

    system, path = open_fs(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if system.get_file_info(path).size else np.zeros(0, dtype=kind)
    with system.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def look_up(model: dict, table_name: str, keys: np.ndarray, columns: list[tuple[str, str]]) -> list[np.ndarray]:
    """Columns of the sorted hash arrays at keys (ascending); 0 where a key isn't there."""
    out = [np.zeros(len(keys), dtype=np.int64) for _ in columns]
    there = set(model["word_shards" if table_name == "words" else "pair_shards"])
    for s, lo, hi in _cuts(shard_of(keys, model["shards"]), model["shards"]):
        if s not in there:
            continue
        stored = mapped(f"{model['folder']}/{table_name}-{s:06d}.key", "<u8")
        wanted = keys[lo:hi]
        place = np.searchsorted(stored, wanted)
        place[place == len(stored)] = 0
        hit = np.flatnonzero(stored[place] == wanted) if len(stored) else np.zeros(0, dtype=np.int64)
        for values, (name, kind) in zip(out, columns):
            values[lo + hit] = mapped(f"{model['folder']}/{table_name}-{s:06d}.{name}", kind)[place[hit]]
    return out


def scores(batch: pa.RecordBatch, model: dict) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    n_tokens, n_known = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2))
    base, score = (np.zeros(batch.num_rows) for _ in range(2))
    d, d1, of1 = np.array([0.0, *model["d"]]), np.array([0.0, *model["d1"]]), model["of1"]
    V, N, types = model["words"], model["tokens"], model["pairs"]
    removed = sum(x * k for x, k in zip(model["d1"], [of1[0], of1[1], V - of1[0] - of1[1]])) if types else 0.0
    for chunk in chunks(batch, "text", 3 << 20):
        context, token, bounds = token_stream(*words(chunk, lower=True))
        known, inverse = np.unique(np.concatenate([token, context]), return_inverse=True)
        n, before, total, one, two, more = look_up(model, "words", known, [("n", "<u8"), ("before", "<u4"), ("total", "<u8"), ("one", "<u4"), ("two", "<u4"), ("more", "<u4")])
        p1 = np.maximum(before - d1[np.minimum(before, 3)], 0) / max(types, 1) + (removed / types if types else 1.0) / (V + 1)
        gamma = np.where(total > 0, (d[1] * one + d[2] * two + d[3] * more) / np.maximum(total, 1), 1.0)
        w, v = inverse[: len(token)], inverse[len(token) :]
        pairs, pair_at = np.unique(pair_key(context >> PREFIX, token >> PREFIX), return_inverse=True)
        (seen,) = look_up(model, "pairs", pairs, [("n", "u1")])
        often = np.flatnonzero(seen == 255)
        seen[often] = look_up(model, "often", pairs[often], [("n", "<u8")])[0]
        c = seen[pair_at]
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total[v], 1) + gamma[v] * p1[w]
        b = np.log10((n[w] + 0.1) / (N + 0.1 * (V + 1)))
        rows = slice(chunk.first, chunk.first + chunk.n)
        n_tokens[rows] = np.diff(bounds)
        for out, values in ((n_known, n[w] > 0), (base, b), (score, np.log10(p))):
            out[rows] = np.add.reduceat(values.astype(out.dtype), bounds[:-1])
    return [n_tokens, n_known, base, score]


def score_documents(docs: DataFrame, model: dict, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, n_known, base_score, score (log10 probability) and perplexity."""
    names = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    docs = docs.drop(*[n for n, _ in names], "perplexity")
    out = with_columns_from_text(docs, "text", names, lambda batch: scores(batch, model), keep_text)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op10_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"), 10)))
    out = score_documents(docs, model, keep_text=False).withColumn("held_out", held_out(F.col("doc_id"), 10))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
