"""Hard negatives, filter audit and token counts against plain Python."""

import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import filteraudit, hardneg, tokencount
from tests.llm.test_names_and_empties import ODD_NAMES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_negatives(rows, is_anchor, positives, negatives):
    """As hardneg.mine() says, by all pairs; a row is (vec_id, vector, label)."""
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in [r for r in rows if is_anchor(r[0])]:
        scored = [(-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, z) for j, w, z in rows if j != i]
        for far, p, _ in sorted(s for s in scored if s[2] == y)[:positives]:
            fits = sorted(s[:2] for s in scored if s[2] != y and 30 * -far <= 100 * -s[0] <= 90 * -far)
            out += [(i, p, n, q, -far, -s) for n, (s, q) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def vectors(rng, n):
    rows = [(i, [rng.gauss(c % 3, 1) / 4 for c in range(8)], rng.randrange(3)) for i in range(n)]
    rows += [(n + i, rows[i % 3][1], i % 3) for i in range(12)]  # ties
    rows += [(n + 20, None, 1), (n + 21, [1.0, None], 1), (n + 22, [float("nan")] * 8, 1), (n + 23, [float("inf")], 0), (n + 24, [0.5] * 8, None), (None, [0.5] * 8, 1)]
    return [*rows, (n + 25, [0.7] * 3, 1), (n + 26, [], 0), (n + 27, [-0.4] * 20, 2), (7, rows[5][1], 1), (10, rows[11][1], 2), (10, rows[10][1], rows[10][2])]


@pytest.mark.parametrize("blocks,groups", [(16, 3), (4096, 8192)])
def test_hard_negatives_by_all_pairs(spark, blocks, groups):
    rows = vectors(random.Random(2), 230)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    out = hardneg.mine(df.select("*", *[F.lit(n).alias(n) for n in ODD_NAMES]), lambda i: i % 10 == 0, positives=4, negatives=6, pivots=6, rows_a_block=blocks, anchors_a_group=groups)
    found = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect())
    assert found == plain_negatives(rows, lambda i: i % 10 == 0, 4, 6) and len(found) > 200
    assert hardneg.mine(df.limit(0), lambda i: i % 10 == 0).count() == 0


def test_hard_negatives_of_huge_components_and_one_hot_label(spark):
    rows = [(i, [2.0**14 * (i + 1) ** 2, -(2.0**14) * (i % 5), 1e-9], 0 if i % 3 else 1) for i in range(60)]
    out = hardneg.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), lambda i: i % 20 == 0, rows_a_block=8)
    found = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect())
    assert found == plain_negatives(rows, lambda i: i % 20 == 0, 5, 10) and len({r[4] for r in found}) > 1


def test_pivots_bracket_every_score_and_leave_out_cells():
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.05, (200, 6)) for c in (-1, 0, 1)]))
    norm = float((x * x).sum(axis=1).max())
    pivots = hardneg.Pivots(list(x), norm, 12)
    far, mine = pivots.distances(list(x), True), pivots.distances(list(x[::50]), False)
    for q, d in zip(x[::50], mine):
        low, high = hardneg.scores_between(np.abs(far - d).max(axis=1), (far + d).min(axis=1), float(q @ q), norm)
        assert (low <= x @ q).all() and (x @ q <= high).all()
        if abs(q).mean() > 128:  # of the outer clusters: most of the two others can't reach the best five
            assert (high >= np.sort(x @ q)[-5]).sum() < 400


def text_fails(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))]


def test_audit_by_applying_every_order(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)] + ["BIG", "é日", "a#b"]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([40, 400, 403])]) for _ in range(rng.choice([30, 99, 100, 150, 260]))) for _ in range(60)]
    rows = [(i, rng.choice([*texts, None, "", "SHOUT " * 120]), rng.choice(["en", "de", None, ""])) for i in range(300)]
    rows += [(5, rows[5][1], "en"), (5, texts[0], "en"), (None, texts[0], "fr"), (None, texts[0], "fr"), (900, "word " * 200_000, "long"), (901, texts[0].upper(), "fr")]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 320, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, x in marks if x == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    judged = [(lang or "", i, [*text_fails(t or ""), i is not None and i > least[t or ""]]) for i, t, lang in rows]
    want, removed = {}, {}
    for part in {p for p, _, _ in judged}:
        for order in itertools.permutations(range(5)):
            left = [r for r in judged if r[0] == part]
            fails = {f: sum(r[2][f] for r in left) for f in order}
            only = {f: sum(r[2][f] and sum(r[2]) == 1 for r in left) for f in order}
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[2][f]]
                left = [r for r in left if not r[2][f]]
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                want[part, "".join("ABCDE"[x] for x in order), step] = [len(left), len(gone), fails[f] - len(gone), only[f], sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone), f]
    want = {k: (*v[:6], removed[k[0], v[6]]) for k, v in want.items()}
    named = docs.select("*", *[F.lit(n).alias(n) for n in [*ODD_NAMES, "mask", "digest", "good", "toxic"] if n != "lang"])
    for table in (docs, named):
        out = filteraudit.audit(filteraudit.mask_counts(table, labels)).collect()
        assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out} == want and len(out) == len(want)
    assert filteraudit.audit(filteraudit.mask_counts(docs.limit(0), labels)).count() == 0


def test_zeta_transform_of_any_number_of_filters():
    counts = np.random.default_rng(0).integers(0, 50, (3, 64))
    alive = filteraudit.survivors(counts)
    for s in range(64):
        assert (alive[:, s] == sum(counts[:, m] for m in range(64) if not m & s)).all()
    assert (filteraudit.shapley_sums(alive).sum(axis=1) == math.factorial(6) * (alive[:, 0] - alive[:, 63])).all()


def odd_texts(rng):
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDE   \n\té😀日本的是▁.,0123456789#=-_\x00"
    texts = ["", " ", "  a", "a" + " " * 40 + "b" + " " * 17, " " * 1000, "▁▁ a", "\n\n  x", "日本語 テキスト", "😀 x", "<s>x</s><unk><0x0A>", "x" * 3000, "ab" * 500]
    texts += ["".join(rng.choice(alphabet[: rng.randrange(2, len(alphabet))]) for _ in range(rng.randrange(200))) for _ in range(800)]
    return texts + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(32, 0x3000), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(60)) for _ in range(200)]


@pytest.mark.parametrize("size", [1 << 20, 60, 7])
def test_token_counts_as_the_library_gives_them(size):
    from sentencepiece import SentencePieceProcessor

    texts = odd_texts(random.Random(size))
    want = [len(ids) for ids in SentencePieceProcessor(model_file=MODEL).encode(texts)]
    assert tokencount.token_counts(tokencount.vocabulary(MODEL), [t.encode() for t in texts], size).tolist() == want


def test_counts_where_one_merge_makes_an_earlier_pair():
    """Pieces whose ranks run against their making: all places at once and one by one differ, and the latter is meant."""
    words = object.__new__(tokencount.Vocabulary)
    a, b, ab, aba = 1, 2, 3, 4
    words.pairs = {a << 32 | b: (1, ab), ab << 32 | a: (0, aba), aba << 32 | b: (2, 5)}
    words.keys = np.array(sorted(words.pairs))
    words.ranks, words.made = (np.array([words.pairs[k][j] for k in sorted(words.pairs)], dtype=np.int32) for j in (0, 1))
    rng = random.Random(1)
    for sequence in [[a, b] * 3, [a, b, a], [a, a, b, b], *([rng.choice([a, b]) for _ in range(rng.randrange(1, 30))] for _ in range(200))]:
        left = list(sequence)
        while found := sorted((words.pairs[p][0], i) for i in range(len(left) - 1) if (p := left[i] << 32 | left[i + 1]) in words.pairs):
            i = found[0][1]
            left[i : i + 2] = [words.pairs[left[i] << 32 | left[i + 1]][1]]
        assert tokencount.merged_counts(words, np.array(sequence), np.array([len(sequence)])).tolist() == [len(left)] == [tokencount.one_by_one(words, sequence)]


def test_token_counts_over_a_table(spark):
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "日本 é"), (4, "word " * 100_000), (5, "y" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in [*ODD_NAMES, "n_tokens"]])
    out = tokencount.count_tokens(docs, MODEL)
    assert [c for c in out.columns if c not in ("n_bytes", "n_tokens", "over_limit")] == [c for c in docs.columns if c != "n_tokens"]
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()), key=repr) == want
    assert tokencount.count_tokens(docs.limit(0), MODEL).count() == 0
