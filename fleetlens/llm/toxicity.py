"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

Kernel: a string's features are all its ordered 4-character subsequences within SPAN characters, each weighted by
DECAY to the power of the span it covers, so an insult with gaps or inserted characters still shares most features
with the plain one. Characters are 32 symbols: letters (look-alike digits and signs as letters), one for every other
ASCII character, and a few for the rest.

Features are scaled by their rarity in clean text, as common ones tell nothing.

Training (in one task, on a bounded sample of the sentences of labelled documents): the label of
a document is carried to the sentence that holds the word which most speaks for the label. A word speaks for it if its
log-likelihood ratio exceeds what chance gives the best of all words (Bonferroni, at ALPHA); documents that no such word
explains are rated anew by themselves, by words that no clean document has, until none is left or no word speaks for them. Windows of those sentences, and
copies of them with inserted or dropped-in characters, are positive, windows of clean sentences are negative. Those of
either that the others explain least (pivoted Cholesky) are landmarks; kernels with the landmarks, whitened by their own
kernel matrix, are the Nystroem features on which the machine is trained with squared hinge loss; then the clean windows
that score highest join the negatives, a few times over.

Scoring: as the kernel is an inner product of explicit features, the machine folds into one weight for each
4-subsequence. A window's value is the sum of its subsequences' weights, found for all windows of a batch with a few
vector operations a character; a document's value is its highest window's, and a logistic fit makes it a score.

Defined cases: null or empty text has the value of an empty window; unlabelled rows are scored as others; labels that are null
are ignored, repeated ones taken at their largest; without labels of both kinds every score is 0; an empty table gives
an empty result. Other columns pass through, whatever their names; score and predicted give way to the added ones.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import held_out, release, table, text_bytes, with_columns_from_text
from fleetlens.llm.tokens import chunks

SPAN, DECAY, WINDOW = 7, 0.8, 14
#: Chance at which one word at all speaks for a label by accident.
ALPHA = 0.05
#: A sentence: up to a mark and a blank, a line's end, the text's end or 400 characters.
SENTENCE = r"(?s).{1,400}?(?:[.!?](?=\s)|\n|\z)|.{1,400}"
SHAPES = [(0, *c) for c in combinations(range(1, SPAN), 3)]


def _symbols() -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[97:123] = out[65:91] = np.arange(1, 27)
    for sign, letter in zip(b"013457@$!", b"oieastasi"):
        out[sign] = letter - 96
    out[128:] = 27 + np.arange(128) % 5
    return out


SYMBOL = _symbols()


@dataclass(frozen=True)
class ToxicityTraining:
    """Bounds of the training sample: documents of each label, sentences of each document (by a hash), landmarks and
    windows of each label."""

    documents: int = 2000
    sentences: int = 128
    landmarks: int = 96
    windows: int = 3000
    rounds: int = 4
    cost: float = 10.0
    seed: int = 3


def features(text: bytes, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of a string's subsequences, equal codes summed, each times its rarity."""
    s = SYMBOL[np.frombuffer(text, dtype=np.uint8)]
    padded = np.concatenate([s, np.full(SPAN, -1, dtype=np.int32)])
    codes, weights = [], []
    for shape in SHAPES:
        part = [padded[k : k + len(s)] for k in shape]
        whole = np.minimum.reduce(part) >= 0
        codes.append((((part[0] << 15) | (part[1] << 10) | (part[2] << 5) | part[3])[whole]))
        weights.append(np.full(int(whole.sum()), DECAY ** (shape[3] + 1)))
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    summed = np.bincount(at, weights=np.concatenate(weights), minlength=len(found))
    return found, summed if rarity is None else summed * rarity[found]


def distinct_texts(texts: list[list[bytes]], draws: int = 3) -> list[list[bytes]]:
    """The texts (lists of sentences) without near copies: one is dropped if any of a few minima over its 4-word shingles came before."""
    out, seen = [], set()
    for t in texts:
        w = b" ".join(t).split()
        parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        minima = {(k, min(zlib.crc32(p, k) for p in parts)) for k in range(draws)}
        if seen.isdisjoint(minima):
            out.append(t)
        seen |= minima
    return out


def choose_landmarks(found: list[tuple], many: int) -> list[tuple]:
    """Pivoted Cholesky: one after the other, the features that those chosen so far explain least, scaled to norm 1."""
    found = [(c, w / np.linalg.norm(w)) for c, w in found if len(c) and np.linalg.norm(w) > 0]
    if not found:
        return []
    k = kernel(found, found)
    rest, parts, chosen = np.diag(k).copy(), np.zeros((len(found), 0)), []
    while len(chosen) < min(many, len(found)):
        at = int(np.argmax(rest))
        if rest[at] < 1e-3:
            break
        column = (k[:, at] - parts @ parts[at]) / math.sqrt(rest[at])
        parts = np.hstack([parts, column[:, None]])
        rest = rest - column**2
        chosen.append(at)
    return [found[i] for i in chosen]


def kernel(a: list, b: list) -> np.ndarray:
    """Kernel matrix of two lists of features."""
    index = {c: i for i, c in enumerate(sorted({int(c) for codes, _ in b for c in codes}))}
    right = np.zeros((len(b), len(index)))
    for j, (codes, weights) in enumerate(b):
        right[j, [index[int(c)] for c in codes]] = weights
    out = np.zeros((len(a), len(b)))
    for i, (codes, weights) in enumerate(a):
        there = [(index[int(c)], w) for c, w in zip(codes, weights) if int(c) in index]
        if there:
            at, w = zip(*there)
            out[i] = right[:, at] @ np.array(w)
    return out


def window_values(data: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """For each place of a byte array, the summed weights of the subsequences that begin there."""
    s = SYMBOL[data]
    n = len(s)
    total = np.zeros(n, dtype=np.float32)
    if n < 4:
        return total
    padded = np.concatenate([s, np.zeros(SPAN, dtype=np.int32)])
    heads = {k: (padded[:n] << 15) | (padded[k : k + n] << 10) for k in range(1, SPAN - 2)}
    tails = {g: (padded[: n + SPAN - g] << 5) | padded[g : n + SPAN] for g in range(1, SPAN)}
    for _, i, j, k in SHAPES:
        part = table_[heads[i] + tails[k - j][j : j + n]]
        part *= np.float32(DECAY ** (k + 1))
        total += part
    return total


def document_values(data: np.ndarray, offsets: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """The highest window of each text; texts are set apart by blanks that no window reaches across."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    spread = np.zeros(len(data) + n * SPAN, dtype=np.uint8)
    starts = offsets[:-1] + np.arange(n) * SPAN
    at = np.arange(len(data)) + np.repeat(np.arange(n) * SPAN, lengths)
    spread[at] = data
    values = np.cumsum(window_values(spread, table_), dtype=np.float64)
    values = np.concatenate([[0.0], values])
    ends = np.minimum(np.arange(len(spread)) + WINDOW, np.repeat(starts + lengths, lengths + SPAN))
    ends = np.maximum(ends, np.arange(len(spread)))
    sums = values[ends] - values[: len(spread)]
    return np.maximum.reduceat(sums, starts) if n else np.zeros(0)


def _words(text: bytes) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0d]+", text.lower())


def window_of(text: bytes, word: bytes) -> bytes:
    """The word within its text, with what stands around it up to a window."""
    low = text.lower()
    at = low.find(word)
    room = max(0, WINDOW - len(word)) // 2
    return low[max(0, at - room) : at + len(word) + room]


def variants(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with a character inserted, and with one sign between all its characters."""
    k = int(rng.integers(1, max(2, len(word))))
    letter = bytes([int(rng.integers(97, 123))])
    return [word[:k] + letter + word[k:], word[:k] + b"*" + word[k:], b".".join(bytes([c]) for c in word)]


def fit_line(z: np.ndarray, y: np.ndarray, cost: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; z: features, y: -1 or 1."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0, cost / max(1, (y > 0).sum()), cost / max(1, (y < 0).sum()))
    ridge = np.diag(np.append(np.full(z.shape[1], 1e-3), 1e-8))
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        h = ridge + (xa * wa[:, None]).T @ xa
        new = np.linalg.solve(h + 1e-10 * np.eye(len(h)), (xa * wa[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def rating(n: int, toxic: int, m: int, clean: int) -> float:
    """Signed log-likelihood ratio of a word in n of the toxic and m of the clean documents."""
    share = (n + m) / (toxic + clean)
    if not 0 < share < 1 or n / toxic <= m / clean:
        return 0.0
    part = lambda k, of: (k * math.log(k / (of * share)) if k else 0.0) + ((of - k) * math.log((of - k) / (of * (1 - share))) if of > k else 0.0)
    return 2 * (part(n, toxic) + part(m, clean))


def bar(words: int) -> float:
    """The log-likelihood ratio that the best of so many words without any meaning exceeds with a chance of ALPHA."""
    return NormalDist().inv_cdf(1 - ALPHA / max(1, words) / 2) ** 2


def witnesses(toxic: list[list[bytes]], clean: list[list[bytes]]) -> list[tuple[bytes, bytes]]:
    """(word, sentence) pairs that carry the label of toxic documents (lists of sentences), up to three of each."""
    strip = lambda w: w.strip(b".,;:!?\"'()")
    one: dict[bytes, bytes] = {}
    held = [{one.setdefault(w, w) for s in d for w in _words(s)} for d in toxic]  # a word is one object, however many hold it
    elsewhere = Counter(w for d in clean for w in {w for s in d for w in _words(s)})
    out: list[tuple[bytes, bytes]] = []
    unexplained = list(range(len(toxic)))
    while unexplained:
        here = Counter(w for i in unexplained for w in held[i])
        least = bar(len(here | elsewhere))
        # What speaks for the few documents left over may be their topic or language, unless clean ones never say it.
        later = len(unexplained) < len(toxic)
        rated = {w: rating(n, len(unexplained), elsewhere[w], len(clean)) for w, n in here.items() if len(strip(w)) >= 3 and not (later and elsewhere[w])}
        telling = {w for w, r in rated.items() if r >= least}
        left = []
        for i in unexplained:
            mine = sorted(held[i] & telling, key=lambda w: (-rated[w], w))[:3]
            out += [(strip(w), next(s for s in toxic[i] if w in s and w in _words(s))) for w in mine]
            if not mine:
                left.append(i)
        if len(left) == len(unexplained):
            break
        unexplained = left
    return out


def train(rows: list[tuple[int, bytes, int]], how: ToxicityTraining = ToxicityTraining()) -> dict | None:
    """The folded machine from (document, sentence, label) rows: weights by code, bias, logistic slope and place."""
    rng = np.random.default_rng(how.seed)
    by_label: list[dict[int, list[bytes]]] = [{}, {}]
    for doc, sentence, label in rows:
        by_label[label].setdefault(doc, []).append(sentence.lower())
    toxic, clean = (distinct_texts(list(by_label[label].values())) for label in (1, 0))
    if not toxic or not clean:
        return None
    found = witnesses(toxic, clean)
    often_seen = Counter(w for w, _ in found)
    strong = [w for w, _ in sorted(often_seen.items(), key=lambda x: (-x[1], x[0]))][: 8 * how.landmarks]
    if not strong:
        return None
    positive = [window_of(sentence, w) for w, sentence in found if w in set(strong)][: how.windows // 2]
    clean_docs, clean = clean, [b" ".join(d) for d in clean]
    toxic = [b" ".join(d) for d in toxic]
    some_sentence = lambda: (d := clean_docs[int(rng.integers(len(clean_docs)))])[int(rng.integers(len(d)))]
    for w in strong:
        for _ in range(max(1, how.windows // (8 * len(strong)))):
            around = [_words(some_sentence()) or [b"a"] for _ in range(2)]
            before, after = (a[int(rng.integers(len(a)))] for a in around)
            for v in [w, *variants(w, rng)]:
                positive.append(before[-3:] + b" " + v + b" " + after[:3])
    random_windows = lambda n: [t[(k := int(rng.integers(max(1, len(t) - WINDOW)))) : k + WINDOW] for t in (some_sentence() for _ in range(n))]
    negative = random_windows(how.windows)
    often = np.zeros(1 << 20)
    for x in random_windows(4 * how.windows):
        often[features(x)[0]] += 1
    rarity = np.log((4 * how.windows + 1) / (often + 1)) / math.log(4 * how.windows + 1)
    landmarks = choose_landmarks([features(b" " + w + b" ", rarity) for w in strong], how.landmarks)
    landmarks += choose_landmarks([features(x, rarity) for x in negative[: 4 * how.landmarks]], how.landmarks // 2)
    pos_features = [features(x, rarity) for x in positive]
    neg_features = [features(x, rarity) for x in negative]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    k_pos, k_neg = kernel(pos_features, landmarks), kernel(neg_features, landmarks)
    model: dict = {}
    for _ in range(how.rounds):
        z = np.vstack([k_pos, k_neg]) @ whiten
        y = np.concatenate([np.ones(len(k_pos)), -np.ones(len(k_neg))])
        w, bias = fit_line(z, y, how.cost)
        alpha = whiten @ w
        table_ = np.zeros(1 << 20, dtype=np.float32)
        for a, (codes, weights) in zip(alpha, landmarks):
            table_[codes] += a * weights * rarity[codes]
        model = {"codes": np.flatnonzero(table_), "weights": table_[np.flatnonzero(table_)], "bias": bias}
        hard: list[tuple[float, bytes]] = []
        for text in clean:
            data = np.frombuffer(text, dtype=np.uint8)
            if len(data) < 4:
                continue
            sums = np.concatenate([[0.0], np.cumsum(window_values(data, table_), dtype=np.float64)])
            ends = np.minimum(np.arange(len(data)) + WINDOW, len(data))
            at = int(np.argmax(sums[ends] - sums[: len(data)]))
            hard.append((float(sums[ends[at]] - sums[at]), bytes(data[at : at + WINDOW])))
        hard.sort(key=lambda x: (-x[0], x[1]))
        k_neg = np.vstack([k_neg, kernel([features(x, rarity) for _, x in hard[: how.windows // 4]], landmarks)])
    texts = toxic + clean
    f = np.array([_value(t, table_) for t in texts])
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    model["slope"], model["place"] = logistic(f, y)
    return model


def _value(text: bytes, table_: np.ndarray) -> float:
    data = np.frombuffer(text, dtype=np.uint8)
    return float(document_values(data, np.array([0, len(data)]), table_)[0])


def logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and place of the logistic curve on f, ridge-fitted; the place is moved to the best training accuracy."""
    order = np.argsort(f)
    ranked, labels = f[order], y[order]
    right = np.concatenate([[0], np.cumsum(labels == 0)]) + (labels == 1).sum() - np.concatenate([[0], np.cumsum(labels == 1)])
    best = np.flatnonzero(right == right.max())
    edges = np.concatenate([[ranked[0] - 1], (ranked[1:] + ranked[:-1]) / 2, [ranked[-1] + 1]])
    gaps = np.concatenate([[1], ranked[1:] - ranked[:-1], [1]])
    place = float(edges[best[np.argmax(gaps[best])]])
    spread = max(1e-6, float(np.median(f[y == 1]) - place)) if (y == 1).any() else 1.0
    return 4.0 / spread, place


def score_batch(batch: pa.RecordBatch, model: dict | None) -> list[np.ndarray]:
    out = np.zeros(batch.num_rows)
    if model is None:
        return [out]
    table_ = np.zeros(1 << 20, dtype=np.float32)
    table_[model["codes"]] = model["weights"]
    for chunk in chunks(batch, "text"):
        values = document_values(chunk.data, chunk.offsets, table_)
        x = np.clip(model["slope"] * (values - model["place"]), -500, 500)
        out[chunk.first : chunk.first + chunk.n] = 1 / (1 + np.exp(-x))
    return [out]


def training_sentences(docs: DataFrame, labels: DataFrame, how: ToxicityTraining, folds: int = 0) -> DataFrame:
    """doc_id, place, sentence and y of at most how.documents labelled texts of each label, by the hash of their id, that fold 0
    of `folds` doesn't hold; at most how.sentences of each, by a hash. Executors cut the texts."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    if folds:
        known = known.where(~held_out(F.col("doc_id"), folds))
    order = (F.xxhash64("doc_id", F.lit(how.seed)), "doc_id")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.where("y = 1").orderBy(*order).limit(how.documents).unionByName(known.where("y = 0").orderBy(*order).limit(how.documents))
    ids = {r.doc_id: int(r.y) for r in chosen.collect()}
    wanted = docs.sparkSession.createDataFrame([(i, y) for i, y in ids.items()], "doc_id long, y int")
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    cut = texts.select("doc_id", "y", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("place", "sentence")).where("trim(sentence) <> ''")
    few = Window.partitionBy("doc_id").orderBy(F.xxhash64("doc_id", "place"), "place")
    return cut.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= how.sentences).select("doc_id", "place", "sentence", "y")


def fit(docs: DataFrame, labels: DataFrame, how: ToxicityTraining = ToxicityTraining(), folds: int = 0) -> dict | None:
    """train() of the bounded sample of training_sentences(), in a task of an executor: only the folded machine comes here."""
    sample = training_sentences(docs, labels, how, folds).repartition(1).sortWithinPartitions("doc_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(batch.column(0).to_pylist(), text_bytes(batch, "sentence"), batch.column(3).to_pylist())]
        model = train(rows, how)
        if model is not None:
            made = [model["codes"].astype("<i4").tobytes(), model["weights"].astype("<f4").tobytes(), model["bias"], model["slope"], model["place"]]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in made], names=["codes", "weights", "bias", "slope", "place"])
        release()

    for r in sample.mapInArrow(run, "codes binary, weights binary, bias double, slope double, place double").collect():
        return {"codes": np.frombuffer(r.codes, dtype="<i4"), "weights": np.frombuffer(r.weights, dtype="<f4"), "bias": r.bias, "slope": r.slope, "place": r.place}
    return None


def score_toxicity(docs: DataFrame, model: dict | None, keep_text: bool = True) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5)."""
    docs = docs.drop("score", "predicted")
    out = with_columns_from_text(docs, "text", [("score", T.DoubleType())], lambda batch: score_batch(batch, model), keep_text)
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ToxicityTraining(), folds=5)
    out = score_toxicity(docs, model, keep_text=False).withColumn("held_out", held_out(F.col("doc_id"), 5))
    return out.select("doc_id", "held_out", "score", "predicted")
