"""Operators that SQL can't express, held against plain Python over small tables."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import mixing, multiindex, ngram, packing, quality, toxicity, urlfilter
from tests.llm.test_operators import DOC, empty, prose


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randrange(1, 300)), "en", ["web", "books", None][i % 3] if i % 7 else "wiki", 0, None, None) for i in range(150)]
    rows += [(200, None, "en", "web", None, None, None), (201, "", "de", "wiki", 0, None, None), (202, "x" * 30_000, "en", "web", 0, None, None)]
    rows += [(203, "word\n" * 4000, "en", "books", 0, None, None), (3, rows[3][1], "en", "web", 0, None, None), (None, "日本語 <|endoftext|> naïve", "en", None, 0, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


def test_pieces_and_packing(spark, docs):
    from tokenizers import Tokenizer

    paths = packing.public_paths()
    exact = Tokenizer.from_file(paths[0])
    want = collections.Counter()
    for r in docs.collect():
        ids = exact.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids) + 1, 1024)])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    out = packing.pack(packing.pieces(docs, paths)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    ends = collections.defaultdict(int)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024 and len(ends) <= math.ceil(1.01 * sum(ends.values()) / 1024) + 1


def test_genetic_packing_beats_best_fit():
    """Eighty full sequences cut into three pieces each, the hardest kind for best fit."""
    for seed in range(3):
        rng = random.Random(seed)
        lengths = [x for _ in range(80) for a in [rng.randrange(200, 450)] for b in [rng.randrange(200, min(450, 874 - a))] for x in (a, b, 1024 - a - b)]
        alone = packing.Bins(lengths, 1024)
        for i in sorted(range(240), key=lambda i: -lengths[i]):
            alone.best_fit(i)
        best = packing.evolve(lengths, 1024, rng, None, None, generations=12)
        assert sorted(i for b in best for i in b) == list(range(240)) and all(sum(lengths[i] for i in b) <= 1024 for b in best)
        assert len(best) <= len(alone.bins) - 2


def test_string_kernel_by_all_subsequences():
    rng = np.random.default_rng(2)
    weights = np.abs(rng.normal(size=1 << 20)).astype(np.float32)
    for text in (b"blockhead", b"a.b-c!d e", b"abc", b"", b"aaaaaaaaaa"):
        s, want = toxicity.SYMBOL[np.frombuffer(text, dtype=np.uint8)], collections.Counter()
        for at in itertools.combinations(range(len(s)), 4):
            if at[3] - at[0] < toxicity.SPAN:
                want[int(s[at[0]] << 15 | s[at[1]] << 10 | s[at[2]] << 5 | s[at[3]])] += toxicity.DECAY ** (at[3] - at[0] + 1)
        codes, values = toxicity.features(text)
        assert dict(zip(codes.tolist(), values.tolist())) == pytest.approx(dict(want))
        # The folded machine sees blanks after a text's end.
        padded, folded = [*s.tolist(), *[0] * (toxicity.SPAN - 1)], 0.0
        for at in itertools.combinations(range(len(padded)), 4):
            if at[0] < len(s) and at[3] - at[0] < toxicity.SPAN:
                a, b, c, d = (padded[i] for i in at)
                folded += weights[a << 15 | b << 10 | c << 5 | d] * toxicity.DECAY ** (at[3] - at[0] + 1)
        assert toxicity._value(text, weights) == pytest.approx(folded, rel=1e-4)


def test_landmarks_span_the_rest():
    found = [toxicity.features(w) for w in (b"blockhead", b"blockhead", b"nitwit nit", b"blackhead", b"river stone")]
    chosen = toxicity.choose_landmarks(found, 3)
    k = toxicity.kernel(chosen, chosen)
    assert len(chosen) == 3 and np.allclose(np.diag(k), 1) and np.linalg.det(k) > 0.1


def test_toxicity_training_cuts_sentences_of_labelled_documents(spark):
    texts = [(1, "One two. Three!  Four\nfive " + "x" * 900, 1), (2, None, 1), (3, "", 0), (5, "Clean one. Clean two.", 0), (5, "Clean one. Clean two.", 0), (6, "unlabelled", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    rows = lambda d: [(r.doc_id, r.sentence.strip(), r.y) for r in toxicity.training_sentences(d, labels, toxicity.ToxicityTraining()).orderBy("doc_id", "place").collect()]
    assert rows(docs) == [(1, s, 1) for s in ("One two.", "Three!", "Four", "five " + "x" * 395, "x" * 400, "x" * 105)] + [(5, "Clean one.", 0), (5, "Clean two.", 0)]
    assert rows(empty(spark)) == [] and toxicity.fit(empty(spark), labels) is None and toxicity.fit(docs.where("doc_id = 5"), labels) is None


def test_a_machine_fitted_in_a_task_finds_held_out_insults(spark):
    rng = random.Random(8)
    insults = ["nitwit", "dunderhead", "blockhead"]
    texts = {i: (prose(rng, 60) + (f" {rng.choice(insults)} " if i % 2 else " ") + prose(rng, 60)) for i in range(400)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    how = toxicity.ToxicityTraining(windows=600, rounds=2)
    model = toxicity.fit(docs, labels, how, folds=5)
    rows = [(r.doc_id, r.sentence.encode(), r.y) for r in toxicity.training_sentences(docs, labels, how, 5).orderBy("doc_id", "place").collect()]
    again = toxicity.train(rows, how)
    assert all(np.allclose(model[k], again[k]) for k in model) and all(zlib.crc32(str(d).encode()) % 5 for d, _, _ in rows)
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).where(F.col("doc_id").isin(held)).collect()}
    assert np.mean([got[i] == i % 2 for i in held]) >= 0.95 and len(held) > 50


def test_words_rarer_than_the_first_tier_still_speak():
    rng = random.Random(3)
    toxic = [[f"{prose(rng, 12)} nitwit {prose(rng, 12)}".encode()] for _ in range(300)] + [[f"{prose(rng, 12)} dunderhead {prose(rng, 12)}".encode()] for _ in range(6)]
    clean = [[prose(rng, 24).encode()] for _ in range(300)]
    assert {w for w, _ in toxicity.witnesses(toxic, clean)} == {b"nitwit", b"dunderhead"}


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= set(full)
    return out


def test_mix_targets_words_and_documents(spark, docs):
    out = mixing.mix(docs).collect()
    sizes, n = collections.Counter(), collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        n[r.source] += 1
    targets = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and all(math.isclose(r.target, targets[s], rel_tol=1e-9) for r in mine)
        assert all(r.taken == r.copies * r["size"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - targets[s]) <= 2
        with_words = [r for r in mine if r["size"]]
        assert abs(sum(r.copies for r in with_words) - len(with_words) * targets[s] / sizes[s]) <= max(6, 0.15 * n[s])


def kneser_ney(texts):
    """p(w | v) by dictionaries; words are strings, None the end, 0 the begin."""
    pairs = collections.Counter(x for t in texts for x in zip([0, *t], [*t, None]))
    words = collections.Counter(w for t in texts for w in [*t, None])
    before, after = collections.Counter(w for _, w in pairs), collections.defaultdict(list)
    for (v, _), c in pairs.items():
        after[v].append(c)

    def discount(counts):
        return [0.0, *ngram.discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])]

    d, d1 = discount(list(pairs.values())), discount(list(before.values()))
    kept = sum(max(c - d1[min(c, 3)], 0) for c in before.values()) / len(pairs)

    def p(v, w):
        low = max(before[w] - d1[min(before[w], 3)], 0) / len(pairs) + (1 - kept) / (len(words) + 1)
        if v not in after:
            return low
        c, total = pairs[v, w], sum(after[v])
        return max(c - d[min(c, 3)], 0) / total + sum(d[min(x, 3)] for x in after[v]) / total * low

    return p, words


def test_language_model_by_dictionaries(spark, docs):
    lower = lambda t: (t or "").encode().lower().split()
    train = [r for r in docs.collect() if not (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)]
    p, words = kneser_ney([lower(r.text) for r in train])
    n = sum(words.values())
    model = ngram.train(docs.where(~ngram.held_out(F.col("doc_id"), 10)))
    extra = spark.createDataFrame([(900, "never seen words here river1"), (901, "RIVER1 stone2")], "doc_id long, text string")
    for r in ngram.score_documents(docs.select("doc_id", "text").unionByName(extra), model).collect():
        w = [*lower(r.text), None]
        assert (r.n_tokens, r.n_known) == (len(w), sum(words[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((words[x] + 0.1) / (n + 0.1 * (len(words) + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([0, *w], w)), rel=1e-9)
    vocabulary = [*words, "never"]
    for v in (0, b"river1", b"stone2", "unseen"):
        assert sum(p(v, w) for w in vocabulary) == pytest.approx(1.0, rel=1e-9)


def test_cells_are_walked_in_the_order_of_summed_distance():
    rng = np.random.default_rng(6)
    for rows, columns in ((1, 1), (5, 3), (16, 16), (7, 1)):
        d1, d2 = rng.integers(0, 9, rows).astype(float), rng.integers(0, 9, columns).astype(float)
        counts = rng.integers(0, 4, rows * columns).tolist()
        whole = multiindex.walk(d1, d2, counts, 1 << 30)
        assert sorted(whole) == [c for c, n in enumerate(counts) if n]
        far = [d1[c // columns] + d2[c % columns] for c in whole]
        assert far == sorted(far)
        few = multiindex.walk(d1, d2, counts, sum(counts) // 2)
        assert few == whole[: len(few)] and sum(counts[c] for c in few) >= sum(counts) // 2 > sum(counts[c] for c in few[:-1]) - (not few)


@pytest.mark.parametrize("clustered", [True, False])
def test_multi_index_recall_by_a_tuned_probe(spark, clustered):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24)) * (0.3 if clustered else 3.0)
    rows = spark.createDataFrame([(i, v.tolist(), "q") for i, v in enumerate(x)] + [(5000, [1.0, 2.0], "odd"), (5050, (x[7] * 1e300).tolist(), "large")], "vec_id long, embedding array<double>, cell string").repartition(4)
    out = collections.defaultdict(list)
    for r in sorted(multiindex.search(rows, lambda i: i % 50 == 0).collect(), key=lambda r: r.rank):
        out[r.query_id].append(r)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 4000, 50):
        s = x @ x[q]
        s[q] = -2
        hit += len({r.vec_id for r in out[q] if r.vec_id < 4000} & set(np.argsort(-s)[:5].tolist()))
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in out[q] if r.vec_id < 4000) and [r.rank for r in out[q]] == [1, 2, 3, 4, 5]
    assert hit >= 0.9 * 400 and out[5050][0].vec_id == 7 and len(out[5000]) == 5


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else None
    if rest is None:
        return "", "", None
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER))
    fits = [h + p for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_without_expressions(spark):
    rng = random.Random(9)
    hosts = ["example.org", "www.Example.ORG", "a.com", "com", "org", "notexample.org", "x.example.org.net", "exampleXorg", "", "é.org", "a\n.org"]
    tails = ["", "/", "/es/", "/es/1", "/en/1", "/en/12", "/fr/x", "/FR/", "/de/", "?u=www.example.org/es/1", "#.example.org/es/", "/x?example.org/es/", "?q=1/de/", "/de", "//es/", "/ads/?x", "/Xcasino/", "/a-casino-b", "/casinos/"]
    urls = [f"{rng.choice(['http', 'https', '', 'a://b'])}://{h}{t}" for h in hosts for t in tails] + [None, "", "://", "no scheme org/es/"]
    urls += [urls[3]] * 5 + ["http://a.org/" + "y" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    rules = spark.createDataFrame(urlfilter.production_rules(), urlfilter.RULE_SCHEMA)
    for r in urlfilter.filter_urls(pages, rules).collect():
        host, path, rule = plain_verdict(r.url, urlfilter.HOST_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        name = next((n for n, x in urlfilter.PATTERN_RULES if host and re.search(x, host + r.url.split("://", 1)[1][len(host):])), None)
        want = {h + p: v for h, p, v in urlfilter.HOST_RULES}.get(rule, "block" if name else "allow")
        assert r.verdict == want and (rule is not None or r.pattern == name), r.url


def test_literal_tokens_are_in_every_match():
    known = {r"/ads?/": [], r"a+b/cat/": ["cat"], r"^x/(y/)?z/": ["x", "z"], r"/[^a-z]cat/": [], r"/cat(/|$)": ["cat"], r"/cat(s)?/": [], r"(foo|bar)/dog/": ["dog"], r"/Cat/": [], r"/wp-login\.php": ["wp", "login"]}
    assert {x: urlfilter.literal_tokens(x) for x in known} == known
    assert all(tokens for _, _, _, tokens, _, _ in urlfilter.production_rules())


def test_quality_verdicts_by_plain_quantiles(spark):
    """Fences and verdicts from sorted values: the sketch's quantile lies within ALPHA of the value at its rank."""
    rng = random.Random(12)
    rows = []
    for i in range(900):
        lines = [prose(rng, 12) for _ in range(8)]
        if i % 40 == 0:
            lines[1:6] = [lines[0]] * 5
        if i % 45 == 0:
            lines = [x.replace("1", "#|#|#") for x in lines]
        rows.append((i, "\n".join(lines), ["en", "de"][i % 2], f"s{i % 3}" if i % 9 else None))
    rules = quality.QualityRules(min_documents=120)
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rules).collect()
    measures = {"symbols": lambda r: r.n_symbols / r.n_words, "dup": lambda r: r.n_dup_lines / r.n_lines, "repeat": lambda r: r.n_repeat_words / r.n_words, "length": lambda r: r.word_chars / r.n_words}
    slack = {"symbols": rules.symbol_slack, "dup": rules.dup_slack, "repeat": rules.repeat_slack, "length": rules.length_slack}
    sure, quartiles = 0, {}
    for name, f in measures.items():
        for lang, source in {(r.lang, r.source) for r in out}:
            peers = [x for x in out if not x.base_failed and (x.lang, x.source) == (lang, source)]
            peers = peers if len(peers) >= 120 else [x for x in out if not x.base_failed and x.lang == lang]
            v = sorted(map(f, peers))
            quartiles[name, lang, source] = [v[math.floor(q * (len(v) - 1))] for q in (0.25, 0.5, 0.75)]
    for r in out:
        lines = (r.text or "").split("\n")
        assert r.n_lines == len(lines) and r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text))
        verdict, near = not r.base_failed, False
        for name, f in measures.items() if verdict else ():
            q25, q50, q75 = quartiles[name, r.lang, r.source]
            reach, error = rules.k * (q75 - q25) + slack[name], quality.ALPHA * (q50 + rules.k * (q25 + q75)) * 1.01 + 1e-9
            excess = abs(f(r) - q50) - reach if name == "length" else f(r) - q50 - reach
            near |= abs(excess) <= error
            verdict &= excess <= 0
        if not near:
            assert r.kept == verdict, r
            sure += 1
    assert sure > 800 and 20 < sum(not r.kept for r in out) < 100
