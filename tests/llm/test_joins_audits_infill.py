"""Filter audits, set joins and fill-in-the-middle texts against plain programs."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeseam.llm import audit, infill, setjoin
from codeseam.llm.common import blank_words


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    own = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
    return own + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))


def test_filters_of_a_text():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.choice([0, 1, 3, 49, 50, 51, 80])
        words = [rng.choice(["a", "Bc", "é", "x\x1cy", "\x85", "漢", "D" * 9, "#" if rng.random() < 0.1 else "z", f"w{rng.randrange(99)}"]) for _ in range(n)]
        text = "".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in words)
        assert "".join(c for i, c in enumerate(audit.FILTERS) if audit.own_failures(text.encode()) >> i & 1) == failed(text)


def test_polynomial_is_what_subsets_remove():
    rng = random.Random(2)
    counts = [rng.randrange(50) for _ in range(32)]
    polynomial = audit.removal_polynomial(counts)
    assert audit.corners(polynomial).tolist() == [sum(n for m, n in enumerate(counts) if m & on) for on in range(32)]
    for i in range(5):
        assert audit.shapley(polynomial, i) == sum(Fraction(n, m.bit_count()) for m, n in enumerate(counts) if m >> i & 1)


def audited(docs, labels):
    good, toxic = ({d for d, *marks in labels if marks[k] == 1 and d is not None} for k in (0, 1))
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = defaultdict(list)
    for d, text, source in docs:
        parts[source or ""].append((d, failed(text or "") + "E" * (d is not None and d > least[text or ""])))
    rows = {}
    for part, own in parts.items():
        shares = defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                fails = [x for x in own if f in x[1]]
                shares[f] += len(gone)
                rows[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(x[1] == f for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return rows


def test_audit_against_every_order(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["same", "A", "#", "é"] if rng.random() < 0.5 else [f"w{k}" for k in range(60)]) for _ in range(rng.choice([2, 49, 50, 60, 90]))) for _ in range(12)] + ["", None, "x " * 100_000]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", "", None])) for i in range(150)] + [(None, texts[0], "s"), (None, None, "t"), (7, texts[0], "s"), (7, texts[0], "s"), (9, texts[1], "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("own") for c in ("part", "mask", "digest", "first", "good", "n")}).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("own"))
    got = audit.filter_audit(df, marks).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.FIGURES] for r in got} == audited(docs, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in docs})
    assert audit.filter_audit(df.limit(0), marks).count() == 0
    assert {r["good_lost"] for r in audit.filter_audit(df, marks.limit(0)).collect()} == {0}


def shingles(text, width):
    words = blank_words(text)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def classes(docs, percent, width):
    sets = [(d, shingles(t, width)) for d, t in docs if d is not None]
    root = {d: d for d, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    return {d: top(d) for d, _ in sets}


@pytest.mark.parametrize(("percent", "members", "queries"), [(90, 3, 2), (80, 2, 1), (90, 32, 512)])
def test_set_join_against_all_pairs(spark, monkeypatch, percent, members, queries):
    monkeypatch.setattr(setjoin, "MEMBERS", members)
    monkeypatch.setattr(setjoin, "QUERIES", queries)
    monkeypatch.setattr(setjoin, "COMMON_OF", 2)
    rng = random.Random(percent + members)
    passage = "a passage that very many of the documents have in the same words".split()
    docs = []
    for _ in range(14):
        base = [f"w{rng.randrange(200)}" for _ in range(rng.choice([3, 12, 40, 120]))] + passage * rng.randrange(2)
        for _ in range(rng.choice([1, 3, 14])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(30)}"
            docs.append(" ".join(own + passage[: rng.randrange(3)]))
    docs += [docs[0].upper(), docs[0], "", None, "one", "one two", "one two", "\x1c", "é  è"]
    rng.shuffle(docs)
    rows = list(enumerate(docs)) + [(None, docs[0]), (5, docs[5]), (900, "long " * 30_000 + " ".join(f"l{k}" for k in range(20_000))), (901, "long " * 30_000 + " ".join(f"l{k}" for k in range(20_000)) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("n", "g", "root", "rep", "lead", "h", "prefix")}).repartition(5)
    got = setjoin.similar_sets(df, percent=percent).collect()
    want = classes(rows, percent, 3)
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in got), key=str) == sorted(((d, len(shingles(t, 3))) for d, t in rows), key=str)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_set_join_edge_cases(spark):
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (0, "e f g h"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in setjoin.similar_sets(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 3), (4, 4)]
    assert setjoin.similar_sets(df.limit(0)).count() == 0


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = rng.choice(10**6, n, False).astype(np.uint64)
        b = np.concatenate([a[int(rng.integers(0, 8)) :], rng.choice(10**6, int(rng.integers(0, 8)), False).astype(np.uint64) + np.uint64(10**7)])
        common = np.sort(rng.choice(a, n // 2, False))
        percent = int(rng.choice([50, 80, 90, 100]))
        x, y = np.unique(a), np.unique(b)
        same = len(np.intersect1d(x, y))
        if same and 100 * same >= percent * (len(x) + len(y) - same):
            for late in (common, common[:0]):
                assert set(setjoin.first_tokens(x, late, percent).tolist()) & set(setjoin.first_tokens(y, late, percent).tolist())


def test_bins_bound_what_sets_share():
    rng = np.random.default_rng(5)
    for size in (5, 300, 100_000):
        a, b, c = (np.unique(rng.integers(0, 2**64, size, np.uint64) >> np.uint64(rng.integers(0, 4))) for _ in range(3))
        a = np.union1d(a, b[: size // 2])
        others = np.frombuffer(setjoin.binned(b), np.uint8), np.frombuffer(setjoin.binned(c), np.uint8)
        bound = setjoin.most_shared(np.array([len(a)]), np.frombuffer(setjoin.binned(a), np.uint8)[None], np.maximum(*others)[None])
        assert len(np.intersect1d(a, b)) <= bound[0] <= len(a)


def moved(doc_id, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_chunks_compose_in_any_way():
    rng = random.Random(5)
    signs = [" ", "\n", "a", "<", "P", "S", "M", ">", "é", "<P>", "<S"]
    for _ in range(600):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))).encode()
        cuts = sorted(rng.sample(range(1, len(text) + 1), min(len(text), rng.randrange(1, 8))))
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)]) if a < b]
        state, ends, marks = infill.SPACE, 0, 0
        for b in text:
            kind = infill.KIND[b]
            ends, marks, state = ends + (kind == infill.BLANK and state != infill.SPACE), marks + (kind == infill.GREATER and state == infill.NAMED), infill.NEXT[state, kind]
        whole = infill.prefixes(tuple(np.array(x) for x in zip(*map(infill.scanned, chunks), strict=True)))
        assert (whole[0][-1, 0], whole[1][-1, 0], whole[2][-1, 0]) == (ends, marks, state)
        assert marks == len(re.findall(b"<[PSM]>", text))


@pytest.mark.parametrize("chunk", [1, 5, 64, 1 << 16])
def test_fill_in_the_middle(spark, chunk):
    rng = random.Random(chunk)
    signs = [" ", "\n", "\t", "\x0b", "a", "bc", "<", ">", "S", "é", "漢", "🙂", "\x1c", "\x85", "\xa0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.choice([1, 2, 9, 40, 200]))) for _ in range(150)]
    texts += ["a <P> b c", "x <S>", "<M>", "<<P", "<P<S<M", "  ", "\n", "a", " a", "a ", "word " * 30 + "<" * 9 + "S>", "word\n" * 5_000, "é" * 70_000 + " b", " " * 70_000]
    rows = list(enumerate(texts)) + [(None, "one two three"), (None, None), (900, None), (901, ""), (3, texts[3]), (3, texts[3]), (902, "long words\n" * 40_000 + " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("n", "form", "output", "rid", "bytes", "no")}).repartition(3)
    if chunk < 5:
        df, rows = df.where("length(text) < 5000 or text is null"), [(d, t) for d, t in rows if t is None or len(t) < 5000]
    out = infill.filled_in(df, chunk=chunk).withColumn("back", infill.restored("form", "output"))
    got = sorted((tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()), key=str)
    assert got == sorted(((d, *moved(d, t or ""), t or "") for d, t in rows), key=str)
    assert infill.filled_in(df.limit(0), chunk=chunk).count() == 0
