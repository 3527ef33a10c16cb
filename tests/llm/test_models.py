"""Toxicity, language, language model, URL trees: brute force, small corpora and edge cases."""

import random
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeseam.llm import langid, lm, toxicity, urlfilter
from codeseam.llm.common import blank_words
from codeseam.llm.queries import VOCABULARY, tokenizer_path

DOCS = "doc_id long, text string, lang string, score string"


def test_forward_and_expectation_match_enumeration():
    pieces = {"a": 0, "aa": 1, "▁a": 2, "ab": 3, "aab": 4, "b": 5}
    prob = np.random.default_rng(1).random((7, 2))
    judge = langid.Judge(langid.Model(["x", "y"], prob, pieces))

    def ways(s, at=0):
        if at == len(s):
            yield ()
        for end in range(at + 1, len(s) + 1):
            p = pieces.get(s[at:end], 6 if end == at + 1 else None)
            if p is not None:
                yield from ((p, *rest) for rest in ways(s, end))

    for word in ("a", "aab", "abaab", "cab", "aaaaaaab", "bbabacab"):
        total = [sum(np.prod(prob[list(w), j]) for w in ways("▁" + word)) for j in range(2)]
        assert np.exp(judge.forward([word])[0]) == pytest.approx(total)
    # one round of expectation from equal probabilities: every way of a word counts by its share
    expected = np.full(7, 0.1)
    for word, n in {"aab": 3, "ab": 2}.items():
        each = list(ways("▁" + word))
        weight = [7.0 ** -len(w) for w in each]
        for w, x in zip(each, weight):
            for p in w:
                expected[p] += n * x / sum(weight)
    got = langid.fit({"aab": 3, "ab": 2}, pieces, langid.Settings(rounds=1))
    assert got == pytest.approx(expected / expected.sum())
    assert np.isfinite(judge.forward(["ab" * 5000])).all()
    assert np.isfinite(langid.fit({"b" * 500: 1}, pieces, langid.Settings())).all()


def test_languages(spark):
    rng = random.Random(2)
    words = {"en": "the house and water under with", "de": "das haus und wasser unter mit"}
    rows = [(i, " ".join(rng.choices(words[k].split(), k=30)), k, "own") for i, k in enumerate(["en", "de"] * 30)]
    model = langid.trained(spark.createDataFrame(rows + [(99, None, "en", ""), (98, "x", None, "")], DOCS), tokenizer_path(VOCABULARY))
    assert model.langs == ["de", "en"]
    test = [(1, "the water", None, "a"), (1, "the water", None, "a"), (2, "das wasser mit", None, "b"), (3, None, None, "c"), (4, "", None, "d"), (5, "12 !?", None, "e"), (None, "under the house", None, "f"), (6, "wasser" * 2000, None, "g")]
    docs = spark.createDataFrame(test, DOCS)
    got = {r["doc_id"]: r for r in langid.identified(docs, model, "lang_", "p").collect()}
    assert {k: r["lang_"] for k, r in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en", 6: "de"}
    assert {k: r["score"] for k, r in got.items() if k} == {1: "a", 2: "b", 3: "c", 4: "d", 5: "e", 6: "g"}
    assert langid.identified(docs, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    clash = docs.withColumn("judged", F.lit(1)).withColumn("_judged", F.lit(2))
    assert langid.identified(clash, model).select("judged", "_judged").first() == (1, 2)
    none = langid.trained(docs, tokenizer_path(VOCABULARY))
    assert {r["lang_pred"] for r in langid.identified(docs, none).collect()} == {"und"}
    assert langid.identified(docs.limit(0), model).count() == 0


def test_base_scores_and_layouts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(40)] + ["Ä", "w1."], k=rng.randrange(60))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (None, "w1 new"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = docs.where("doc_id < 60")
    counts = Counter(t for i, text in rows if i is not None and i < 60 for t in lm.tokens(text))
    n, v = sum(counts.values()), len(counts)
    small = lm.Settings(words=20, own=8, head=30, shard=800, batch=64)
    got = lm.scored(docs, learn, small).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, text in rows:
        own = lm.tokens(text)
        assert by[i]["base_score"] == pytest.approx(sum(log10((counts[t] + 1) / (n + v + 1)) for t in own))
        assert (by[i]["n_tokens"], by[i]["n_known"], by[i]["train_tokens"]) == (len(blank_words(text)) + 1, sum(counts[t] > 0 for t in own), n)
    other = {r["doc_id"]: r["score"] for r in lm.scored(docs.repartition(7), learn.repartition(5), small).collect()}
    assert {i: r["score"] for i, r in by.items()} == pytest.approx(other)
    unseen = lm.scored(docs, docs.limit(0), small).collect()
    assert {r["n_known"] for r in unseen} == {0} and {r["train_tokens"] for r in unseen} == {0}
    assert lm.scored(docs.limit(0), learn, small).count() == 0


def test_model_learns_order(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{rng.randrange(12)}" for k in range(100))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lm.scored(docs.where("doc_id >= 200"), docs.where("doc_id < 200"), lm.Settings(words=30, own=30, batch=64))
    r = out.agg((F.sum("score") / F.sum("n_tokens")).alias("score"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).first()
    # which letter comes next is known: a factor of two a token
    assert r["score"] > r["base"] + 0.2


def test_model_is_normalised():
    words = lm.Vocabulary(100, 20, np.arange(5) * 128, np.zeros(5), np.arange(5), np.array([0, 1, 2, 2, 3]), 5, 2, np.r_[[30, 20, 10, 5, 5], np.ones(128)], np.zeros(133))
    m = lm.LogBilinear.start(words, lm.Settings(size=4))
    z = m.log_z()
    for u, v in ((0, 1), (2, 100)):
        scores = (m.x[u] @ m.c[0].T + m.x[v] @ m.c[1].T) @ m.r.T + m.b
        assert np.exp(scores - z[u, v]).sum() == pytest.approx(1, abs=1e-4)
    u, v = lm.contexts(np.array([5, 6, 7, 8]), np.array([0, 2]), 9)
    assert (u.tolist(), v.tolist()) == ([9, 5, 9, 7], [9, 9, 9, 9])
    again = m.unpacked(m.packed(np.full(len(m.r), 3.0), 7.0))
    assert all(np.allclose(getattr(again, k), getattr(m, k), atol=1e-6) for k in ("r", "b", "x", "c"))


def test_machine_learns_pairs():
    # an insult alone and a group alone are fine; together they are not
    rng = random.Random(4)
    s = toxicity.Settings(buckets=1 << 10, examples=30_000)
    rows = []
    for _ in range(600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        own = rng.sample(range(20, 120), 5) + [1] * insult + [2] * group
        rows.append((np.unique(np.array(own, np.int64)), int(insult and group)))
    m = toxicity.fit(rows, s)
    score = lambda *b: m.score(np.array(sorted({30, 40, 50, *b}), np.int64))
    assert score(1, 2) > 0.8 > 0.3 > max(score(1), score(2), score())
    full = 0.5 * sum(float(m.v[i] @ m.v[j]) for i in (1, 2, 30) for j in (1, 2, 30) if i != j) + float(m.w[[1, 2, 30]].sum()) + m.bias
    assert m.score(np.array([1, 2, 30])) == pytest.approx(1 / (1 + np.exp(-full)), rel=1e-4)


def test_toxicity_edge_cases(spark):
    s = toxicity.Settings(buckets=1 << 10, examples=2_000)
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "good day") for i in range(40)] + [(50, None), (50, None), (51, ""), (None, "you")], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (50, 0), (1, 0)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.trained(docs, labels, s), s).collect()
    assert len(got) == 44 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] > 0.5 > by[2]
    nothing = toxicity.trained(docs, labels.limit(0), s)
    assert len({r["score"] for r in toxicity.scored(docs, nothing, s).collect()}) == 1
    assert toxicity.scored(docs.limit(0), nothing, s).count() == 0


def test_trees_say_in_sql_what_they_say_in_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 2)).astype(float)
    start, trees = urlfilter.fit(x, y, urlfilter.Settings(trees=30))
    z = start + sum(t.apply(x) for t in trees)
    assert ((z > 0) == (y > 0)).mean() > 0.95
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    odds = F.lit(start)
    for t in trees[:5]:
        odds = odds + t.column([F.col(c) for c in "abc"])
    few = start + sum(t.apply(x) for t in trees[:5])
    assert [r[0] for r in df.select(odds).collect()] == pytest.approx(few.tolist())


def test_urls_from_labels(spark):
    bad = [f"http://shop{i}.example.com/win/{i}{i}{i}{i}?a=1&b=2&c={i}" for i in range(60)]
    good = [f"http://shop{i}.example.com/about/page" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate([*bad, *good, None, "nonsense", bad[0]])), "page_id long, url string").withColumn("host", F.lit("own"))
    labels = spark.createDataFrame([(u, 1) for u in bad[::2]] + [(u, 0) for u in good[::2]] + [(None, 1), (bad[0], 1)], "url string, blocked int")
    got = {r["page_id"]: r for r in urlfilter.judged(pages, [], labels).collect()}
    held = [(i, i < 60) for i in range(1, 120, 2)]
    assert sum((got[i]["verdict"] == "block") == bad_ for i, bad_ in held) >= 57
    assert got[120]["host"] == got[121]["host"] == "" and got[122]["verdict"] == got[0]["verdict"]
    assert {r["verdict"] for r in urlfilter.judged(pages, []).collect()} == {"allow"}
    assert urlfilter.judged(pages.limit(0), []).count() == 0
