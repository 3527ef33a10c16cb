import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeseam.llm import decontam, fingerprint, langid, linededup, minhash, packing, pii, toxicity, urlfilter
from codeseam.llm.common import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_keys():
    rng = random.Random(3)
    for _ in range(3000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
        b = bytes(c for c in a if rng.random() > 0.1) + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 2)))
        for e in (1, 2, 3):
            near = distance(a, b) <= e
            assert linededup.within(a, b, e) == near
            if near and min(len(a), len(b)) > e + 1:
                of, keys = linededup.byte_keys([a, b"other", b], e)
                assert set(keys[of == 0].tolist()) & set(keys[of == 2].tolist())


def test_packing_places_every_item_without_overlap():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 500)
    bins, offsets = packing.sum_of_squares(sizes, 100)
    for b in np.unique(bins):
        at = np.argsort(offsets[bins == b])
        ends = np.cumsum(sizes[bins == b][at])
        assert ends[-1] <= 100
        assert (offsets[bins == b][at] == np.concatenate([[0], ends[:-1]])).all()
    assert len(np.unique(bins)) <= 1.1 * np.ceil(sizes.sum() / 100)


def test_forward_sums_all_segmentations():
    model = langid.Judge(langid.Model(["x"], np.array([[0.1], [0.2], [0.3], [0.05]]), {"a": 0, "aa": 1, "▁a": 2}))
    # "▁aa": (▁)(a)(a), (▁)(aa), (▁a)(a); ▁ alone is the spare piece
    assert np.exp(model.forward(["aa"]))[0, 0] == pytest.approx(0.05 * 0.1 * 0.1 + 0.05 * 0.2 + 0.3 * 0.1)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8}


def test_edge_cases(spark):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(1, same, 5), (2, same, 5), (2, same, 5), (3, None, 5), (4, "", 5), (None, same, 5), (5, same.replace("w30", "w3x"), 5), (6, "short", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 80).collect() if r["doc_id"] is not None)
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 1, False), (6, 6, True)]
    lines = {(r["doc_id"], r["n_removed"]) for r in linededup.line_report(docs).collect()}
    assert {(1, 0), (2, 1), (3, 0), (4, 0), (None, 0), (5, 1), (6, 0)} == lines
    items = spark.createDataFrame([(7, " ".join(f"W{i}" for i in range(10, 22))), (8, "short"), (9, None)], "item_id long, text string")
    hit = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.decontaminate(docs, items).collect() if r["doc_id"]}
    assert hit == {1: (12, 1), 2: (12, 1), 3: (0, 0), 4: (0, 0), 5: (12, 1), 6: (1, 1)}
    prints = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] != prints[4]["fingerprint"] == prints[3]["fingerprint"]
    empty = docs.limit(0)
    assert minhash.near_duplicates(empty).count() == linededup.line_report(empty).count() == fingerprint.fingerprints(empty).count() == 0


def test_pseudonyms(spark):
    text = "card 4539578763621486 on 2021-02-28 from 10.1.2.3, not 4539578763621487 or 2021-02-30; call +1 (212) 555-0100 or a.b7@x.example.com"
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymized(docs, "k").collect()}
    assert got[1]["text"] == got[2]["text"] != text
    assert got[3]["text"] is None and got[3]["n_values"] == 0
    assert got[1]["n_values"] == 5 and "4539578763621487" in got[1]["text"] and "2021-02-30" in got[1]["text"]
    assert "4539578763621486" not in got[1]["text"] and "@x.example.com" in got[1]["text"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "https://A.net/x"), (2, "https://e.example.net/en/1"), (3, None), (4, "http://b.org/fr/"), (5, "http://c.net")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["rule"]) for r in urlfilter.judged(pages, [("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow")]).collect()}
    assert got == {1: ("a.net", "net/"), 2: ("e.example.net", "example.net/en/"), 3: ("", None), 4: ("b.org", "org/fr/"), 5: ("c.net", None)}


def test_word_edits_and_keys():
    rng = random.Random(5)
    hashes, none = linededup.WordHash(), np.empty(0, np.uint64)
    for n in [*range(17, 60), 100, 300, 1000]:
        for _ in range(4):
            a = [b"w%d" % rng.randrange(400) for _ in range(n)]
            b = list(a)
            for _ in range(max(2, n // 20)):
                at = rng.randrange(len(b))
                b[at : at + rng.randint(0, 1)] = [b"new%d" % rng.randrange(9)] * rng.randint(0, 1)
            if n < 60:
                assert linededup.word_distance(a, b) == distance(a, b)
            x, y = b" ".join(a), b" ".join(b)
            if n % 3 == 0:  # an edited byte makes two words of one
                y = x.replace(b"w", b"w ", 1)
            z = y.split()
            k = int(linededup.word_edits(min(len(a), len(z)), 5))
            near = linededup.word_distance(a, z) <= k if k else linededup.within(x, y, 2)
            assert linededup.linked(x, y, 2, 5) == near
            common = np.sort(linededup.word_grams([x], hashes)[1][: n // 2])
            for late in (none, common) if near else ():
                of, keys = linededup.line_keys([x, b"one more line", y], 2, 5, late, hashes)
                assert set(keys[of == 0].tolist()) & set(keys[of == 2].tolist())


def test_long_lines_with_replaced_words(spark):
    rng = random.Random(7)
    rows = []
    for i in range(12):
        words = [f"word{rng.randrange(5000)}" for _ in range(80)]
        rows.append((10 * i, " ".join(words)))
        for k in (1, 2, 3):
            for at in rng.sample(range(80), k):
                words[at] = f"other{rng.randrange(5000)}"
            rows.append((10 * i + k, " ".join(words) if k < 3 else " ".join(words[:40] + ["unlike"] * 40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in linededup.line_deduplicated(docs).where("text <> ''").collect()}
    assert kept == {10 * i + k for i in range(12) for k in (0, 3)}
    kept = {r["doc_id"] for r in linededup.line_report(docs, share=5).where("n_removed = 0").collect()}
    assert kept == {10 * i + k for i in range(12) for k in (0, 3)}


def test_short_equal_lines_are_removed(spark):
    rows = [(1, "All rights reserved.\n\nfirst"), (2, "second\nAll rights reserved.\n\nx"), (3, "x\nAll rights reserved!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.line_deduplicated(docs).collect()}
    assert got == {1: "All rights reserved.\n\nfirst", 2: "second\n\nx", 3: "All rights reserved!"}


@pytest.mark.parametrize("n", [100, 1000, 10_000, 20_000])
def test_collision_rate_is_generalised_jaccard(spark, n):
    # 5 % of the words have weight 20 against 10, the others 1
    heavy, n_docs = n // 20, 24
    rows = []
    for d in range(n_docs):
        words, top = [f"d{d}w{i}" for i in range(heavy, n)], [f"d{d}w{i}" for i in range(heavy)]
        rows.append((d, d, " ".join(words + top * 20), " ".join(words + top * 10)))
    texts = spark.createDataFrame(rows, "doc_id long, rid long, text string, edited string").repartition(4, "doc_id")
    got = fingerprint.signatures(texts).select(fingerprint.likeness(F.col("fp0"), F.col("fp1")).alias("same")).collect()
    jaccard = (n - heavy + 10 * heavy) / (n - heavy + 20 * heavy)
    # 24 * 64 samples: a standard error of 0.011
    assert sum(r["same"] for r in got) / n_docs == pytest.approx(jaccard, abs=0.04)


def test_written_forms_of_numbers(spark):
    forms = ["4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1486", "3782 822463 10005", "212-555-0100", "(212) 555-0100", "212.555.0100", "212 555 0100", "1-212-555-0100", "1 (212) 555-0100", "+12125550100", "+1 (212) 555-0100", "+1 (012) 555-0100", "2021-02-28T10:00"]
    stay = ["4539 5787 6362 1487", "2021-02-28x", "12125550100", "2021-02-30T10:00"]
    docs = spark.createDataFrame([(i, f"see {x}, then") for i, x in enumerate(forms + stay)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymized(docs, "k").collect()}
    new = [got[i]["text"].removeprefix("see ").removesuffix(", then") for i in range(len(forms + stay))]
    shape = lambda x: "".join("0" if c.isdigit() else c for c in x)
    digits = lambda x: "".join(c for c in x if c.isdigit())
    for i, (x, y) in enumerate(zip(forms, new)):
        assert got[i]["n_values"] == 1 and x != y and shape(x) == shape(y), x
    assert digits(new[0]) == digits(new[1]) == digits(new[2])
    assert len({digits(x)[-10:] for x in new[4:12]}) == 1
    assert new[12][4] in "01" and new[13].endswith("T10:00")
    assert new[len(forms) :] == stay


def test_suffix_rates_do_not_depend_on_the_most_frequent(spark):
    urls = [f"http://a.d{i}.org/fr/{k}" for i in range(30) for k in range(2 + i % 5)] + [f"http://b.d{i}.org/en/{i}" for i in range(40)]
    urls += [f"http://c.e{i}.net/{k}" for i in range(20) for k in range(3)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("net/", "block"), ("org/fr/", "allow")]
    labels = spark.createDataFrame([(u, i % 3 % 2) for i, u in enumerate(urls[::2])], "url string, blocked int")
    for given in (None, labels):
        all_, few = ({r["page_id"]: r["block_odds"] for r in urlfilter.judged(pages, rules, given, urlfilter.Settings(max_suffixes=n)).collect()} for n in (500, 3))
        assert len(all_) == len(few) == len(urls)
        assert few == pytest.approx(all_)


def test_labels_without_a_document_do_not_use_up_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(0, 200, 4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 8 // 4) for i in range(200)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda rows, s: len(rows))
    assert toxicity.trained(docs, labels, toxicity.Settings(max_train=40)) == 40
