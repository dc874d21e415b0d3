"""Token counts of a byte-fallback BPE vocabulary by rank-synchronous merging of ragged arrays.

Texts are normalised by the vocabulary's own rules, joined as one array of character numbers and cut into pre-tokens
wherever two neighbouring characters stand side by side in no piece of the vocabulary: no merge can cross such a place, so
the cut is exact for any vocabulary. The distinct pre-tokens of a chunk lie in one ragged array. Each round finds every
sequence's lowest-ranked pair by one segmented minimum, applies it at all its places in all sequences at once, and
retires the sequences without any pair; what is left of a sequence is its number of tokens. A character that no piece
holds counts its UTF-8 bytes.

Merging one place at a time, leftmost first, gives the same symbols unless a merge makes a pair that ranks no later than
itself beside another place of that round (long runs of blanks, whose pieces all share one rank). Such sequences are
noticed and merged one place at a time, from a heap. Pre-tokens are told apart by 64-bit hashes within a chunk.

Defined cases: null text is empty and an empty text has no tokens; strings of special tokens are plain text; bytes that
aren't UTF-8 count as the replacement character; texts of any length go through in slices of about SLICE characters.
Other columns pass through, whatever their names; those named as an added one give way to it. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import table, text_bytes, with_columns_from_text
from fleetlens.llm.tokens import mix, powers

SLICE = 1 << 20
LIMIT = 4096
NEVER = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces of a model file as arrays: characters, neighbours that some piece holds, and what pairs of symbols make."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        self.normalize = library.normalize
        plain = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        if not any(map(library.is_byte, range(library.get_piece_size()))) or any(map(library.is_unused, plain)):
            raise ValueError(f"{path}: only vocabularies with byte fallback and without unused pieces are known here")
        scores = {library.id_to_piece(i): library.get_score(i) for i in plain}
        symbols = {c: n for n, c in enumerate(sorted({c for p in scores for c in p}), 1)}
        self.n_chars = len(symbols) + 1
        self.alone = np.zeros(self.n_chars, dtype=bool)  # characters that are pieces themselves
        self.char = np.zeros(0x110000, dtype=np.int32)
        for c, n in symbols.items():
            self.char[ord(c)] = n
            self.alone[n] = c in scores
        self.beside = np.zeros((self.n_chars, self.n_chars), dtype=bool)
        for p in scores:
            for a, b in zip(p, p[1:]):
                self.beside[symbols[a], symbols[b]] = True
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        for p in scores:
            symbols.setdefault(p, len(symbols) + 1)
        pairs = {}
        for p, s in scores.items():
            for i in range(1, len(p)):
                if p[:i] in symbols and p[i:] in symbols:
                    pairs[symbols[p[:i]] << 32 | symbols[p[i:]]] = (rank[s], symbols[p])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks, self.made = (np.array([pairs[k][j] for k in self.keys.tolist()], dtype=np.int32) for j in (0, 1))
        self.pairs = pairs

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if they don't merge) and merged symbol of pairs."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER), self.made[at]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def one_by_one(words: Vocabulary, symbols: list[int]) -> int:
    """How many symbols are left if the lowest-ranked pair, the leftmost of equals, is merged again and again."""
    after, before, symbols, left = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1)), list(symbols), len(symbols)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(symbols) and (found := words.pairs.get(symbols[i] << 32 | symbols[after[i]])):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[after[i]], found[1]))

    for i in range(len(symbols) - 1):
        offer(i)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
            continue
        symbols[i], symbols[j] = made, -1
        after[i] = after[j]
        if after[j] < len(symbols):
            before[after[j]] = i
        left -= 1
        offer(before[i])
        offer(i)
    return left


def merged_counts(words: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols left of each sequence; the sequences (one symbol or more each) lie in `symbols` one after another."""
    out = lengths.copy()
    live = np.flatnonzero(lengths > 1)
    symbols = symbols[np.repeat(lengths > 1, lengths)]
    lengths = lengths[live]
    whole, from_ = symbols, np.cumsum(lengths) - lengths  # as they were, for those that are merged one by one
    size = lengths.copy()
    last, several = np.full(len(live), -1), np.zeros(len(live), dtype=bool)
    while len(live):
        starts = np.cumsum(lengths) - lengths
        rank, made = np.full(len(symbols), NEVER), np.zeros(len(symbols), dtype=np.int32)
        rank[:-1], made[:-1] = words.look_up(symbols[:-1], symbols[1:])
        rank[starts + lengths - 1] = NEVER
        low = np.minimum.reduceat(rank, starts)
        odd = several & (low <= last)
        owner = np.repeat(np.arange(len(live)), lengths)
        hit = np.flatnonzero((rank == low[owner]) & (rank < NEVER))
        first = np.ones(len(hit), dtype=bool)
        first[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
        place = np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
        take = hit[place % 2 == 0]  # of places that overlap every second one, from the left
        side = np.flatnonzero((take[1:] == take[:-1] + 2) & (owner[take[1:]] == owner[take[:-1]]))
        midway, _ = words.look_up(made[take[side]], symbols[take[side] + 2])  # beside a place that is merged only afterwards
        odd[owner[take[side]][midway <= rank[take[side]]]] = True
        for i in np.flatnonzero(odd):
            out[live[i]] = one_by_one(words, whole[from_[i] : from_[i] + size[i]].tolist())
        ended = (low == NEVER) & ~odd
        out[live[ended]] = lengths[ended]
        stays = ~(ended | odd)
        symbols = symbols.copy()
        symbols[take] = made[take]
        keep = stays[owner]
        keep[take + 1] = False
        several = (np.bincount(owner[take], minlength=len(live)) > 1)[stays]
        lengths = (lengths - np.bincount(owner[take], minlength=len(live)))[stays]
        symbols, live, last, from_, size = symbols[keep], live[stays], low[stays], from_[stays], size[stays]
    return out


def slices(words: Vocabulary, texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Characters (code points) of about `size` of them, starts of the pre-tokens, and the text of each pre-token."""
    buffer: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def cut(points: np.ndarray, text: np.ndarray) -> np.ndarray:
        chars = words.char[points]
        fresh = np.ones(len(points), dtype=bool)
        fresh[1:] = ~words.beside[chars[:-1], chars[1:]] | (text[1:] != text[:-1])
        return np.flatnonzero(fresh)

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points, text = np.concatenate(buffer), np.repeat(owners, [len(b) for b in buffer])
        starts = cut(points, text)
        return points, starts, text[starts]

    for i, raw in enumerate(texts):
        points = np.frombuffer(words.normalize(raw.decode("utf-8", "replace")).encode("utf-32-le"), dtype=np.uint32)
        while len(points) > size:  # a pre-token that the slice's end may cut goes to the next slice
            starts = cut(points[:size], np.zeros(size, dtype=np.int64))
            if starts[-1] == 0:
                break
            yield points[: starts[-1]], starts[:-1], np.full(len(starts) - 1, i)
            points = points[starts[-1] :]
        buffer.append(points)
        owners.append(i)
        held += len(points)
        if held >= size:
            yield flush()
            buffer, owners, held = [], [], 0
    if held:
        yield flush()


def token_counts(words: Vocabulary, texts: list[bytes], size: int = SLICE) -> np.ndarray:
    """The number of tokens of each text."""
    out = np.zeros(len(texts), dtype=np.int64)
    for points, starts, text in slices(words, texts, size):
        if not len(points):
            continue
        chars = words.char[points]
        lengths = np.diff(np.append(starts, len(points)))
        strange = np.flatnonzero(~words.alone[chars])
        spare = np.zeros(len(points), dtype=np.int64)  # bytes beyond the one symbol that such a character is
        spare[strange] = 1 * (points[strange] > 0x7F) + (points[strange] > 0x7FF) + (points[strange] > 0xFFFF)
        forward, back = (p[: len(points) + 1] for p in powers(len(points) + 1))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * forward[:-1])])
        hashes = mix((sums[starts + lengths] - sums[starts]) * back[starts] ^ mix(lengths.astype(np.uint64)))
        _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.repeat(starts[example] - (np.cumsum(lengths[example]) - lengths[example]), lengths[example]) + np.arange(lengths[example].sum())
        left = merged_counts(words, chars[at], lengths[example])
        out += np.bincount(text, weights=left[which] + np.add.reduceat(spare, starts), minlength=len(texts)).astype(np.int64)
    return out


def count_tokens(docs: DataFrame, path: str, column: str = "text", limit: int = LIMIT, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit of the text column, for the model file at `path` on every machine."""
    docs = docs.drop(*[n for n in ("n_bytes", "n_tokens", "over_limit") if n != column])

    def rows(batch: pa.RecordBatch) -> list:
        texts = text_bytes(batch, column)
        return [[len(t) for t in texts], token_counts(vocabulary(path), texts)]

    counted = with_columns_from_text(docs, column, [("n_bytes", T.LongType()), ("n_tokens", T.LongType())], rows, keep_text)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)
