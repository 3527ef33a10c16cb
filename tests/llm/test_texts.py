"""Tokens and packing, lines, windows, pseudonyms and the pipeline: brute force and edge cases."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

import corpus_pipeline
from codeseam.llm import decontam, linededup, packing, pii
from codeseam.llm.common import alnum_words
from codeseam.llm.queries import TOKENIZER, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return packing.WordTokenizer(tokenizer_path(TOKENIZER))


UNTOUCHED = Tokenizer.from_file(tokenizer_path(TOKENIZER))


def whole(text):
    return UNTOUCHED.encode(text, add_special_tokens=False).ids


def test_tokens_of_every_character(tokenizer):
    texts = [a + chr(c) + b for c in range(0x530) for a in ("", "a", " ", "1", ",", "'") for b in ("", "b", "'s", "é")]
    got = tokenizer.raw(pa.array(texts))
    assert [t for t, g in zip(texts, got) if np.frombuffer(g, "<u4").tolist() != whole(t)] == []


def test_tokens_of_mixed_texts(tokenizer):
    rng = random.Random(1)
    signs = "abcdefghijklmnopqrstuvwxyz'' \n\t.,0123AE'sdmtlréñ\x1c\x1d\x1f\x85\xadΣÀßİ́Жя漢🙂<|startofext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["x" * 5000, "ab" * 3000 + " c", "don't we'll I'd x's", "<|endoftext|>", " ", "\n\n", None]
    got = tokenizer.raw(pa.array(texts, pa.string()))
    assert [t for t, g in zip(texts, got) if np.frombuffer(g, "<u4").tolist() != whole(t or "")] == []


def test_special_tokens_in_texts(tokenizer):
    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "a", "don't", " ", "\n", "1", "é", "漢", "İ", "<|", "|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(10_000)]
    got = tokenizer.raw(pa.array(texts, pa.string()))
    assert [t for t, g in zip(texts, got) if np.frombuffer(g, "<u4").tolist() != whole(t)] == []
    assert whole("<|endoftext|>") == [49407]


def test_packed(spark, tokenizer):
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "four"), (1, "one two three"), (5, "word " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("own"))
    got = packing.packed(docs, tokenizer_path(TOKENIZER), capacity=128, with_ids=True).collect()
    own = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], tuple(r["ids"])) for r in got), key=str)
    expected = []
    for doc_id, text in rows:
        ids = [*whole(text or ""), 0]
        expected += [(doc_id, k, at, len(ids[at : at + 128]), tuple(ids[at : at + 128])) for k, at in enumerate(range(0, len(ids), 128))]
    assert own == sorted(expected, key=str)
    bins = defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        assert sum(n for _, n in placed) <= 128
        assert sorted(placed)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(placed), sorted(placed)[1:]))
    assert packing.packed(docs.limit(0), tokenizer_path(TOKENIZER)).count() == 0


def line_classes(lines, edits, share, min_bytes):
    """Least index of each line's class, by comparing all pairs."""
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(lines):
        for j in range(i):
            long = min(len(a), len(lines[j])) >= min_bytes
            if a and (a == lines[j] or long and linededup.linked(a, lines[j], edits, share)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(lines))]


@pytest.mark.parametrize("share", [0, 5])
def test_lines_against_all_pairs(spark, share):
    rng = random.Random(6)
    common = "shared words that very many of these lines begin with in the same order always".split()
    lines = []
    for family in range(12):
        base = common[: rng.choice([3, 12])] + [f"w{rng.randrange(300)}" for _ in range(rng.choice([10, 25, 60]))]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(own))
                own[at] = rng.choice([f"v{rng.randrange(50)}", own[at] + "x", own[at][1:] or "q"])
            lines.append(" ".join(own))
    lines += ["short", "short", "", "a", "été " * 30, "été " * 29 + "ete "]
    rng.shuffle(lines)
    root = line_classes([x.encode() for x in lines], 2, share, 40)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_doc"] for r in linededup.line_decisions(docs, 2, 40, share).collect()}
    assert got == {i: r for i, r in enumerate(root) if r != i}


def test_line_edge_cases(spark):
    rows = [(1, "same line\nown"), (2, None), (3, ""), (None, "same line"), (4, "same line\n\nsame line"), (4, "same line\n\nsame line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("gone", "_gone", "doc", "h", "root")})
    out = linededup.line_deduplicated(docs)
    assert out.columns == docs.columns and {r["gone"] for r in out.collect()} == {"gone"}
    assert sorted(map(str, [r["text"] for r in out.collect()])) == sorted(["same line\nown", "None", "", "same line", "", ""])
    assert linededup.line_deduplicated(docs.limit(0)).count() == 0


def test_windows_against_all_places(spark):
    rng = random.Random(7)
    words = [f"t{k}" for k in range(12)] + ["é"]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.choice([3, 6, 9])))) for k in range(12)] + [("i0", "t1 t2 t3"), (None, "t1"), ("x", None), ("y", "!!")]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 4, 30, 120])))) for i in range(60)] + [(90, None), (None, items[0][1]), (91, items[1][1].upper()), (91, "!")]
    docs[3] = (3, "T4, " + items[2][1].replace(" ", "; ") + " t9")
    windows = defaultdict(set)
    for item, text in items:
        own = alnum_words(text)
        if item and own:
            n = min(5, len(own))
            for i in range(len(own) - n + 1):
                windows[tuple(own[i : i + n])].add(item)
    expected = []
    for doc_id, text in docs:
        own, hit, of = alnum_words(text), set(), set()
        for w, ids in windows.items():
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    of |= ids
        expected.append((doc_id, len(own), len(hit), sorted(of)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit("own")).repartition(3)
    found = decontam.decontaminate(df, spark.createDataFrame(items, "item_id string, text string"), window=5, k=3).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=str) == sorted(expected, key=str)
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] and r["contaminated"] == (r["n_hit"] > 0)


def test_pseudonyms_are_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    assert df.select(pii.digits_permuted(F.col("s"), "k", "t").alias("s")).distinct().count() == 1000
    days = spark.range(5000).select(F.date_format(F.date_add(F.to_date(F.lit("1999-01-01")), F.col("id").cast("int")), "yyyy-MM-dd").alias("s"))
    moved = days.select(pii.date(F.col("s"), "k").alias("s")).distinct()
    assert moved.count() == 5000 and moved.where(F.to_date("s").isNull()).count() == 0
    hosts = spark.range(256).select(F.concat(F.lit("10.0.7."), F.col("id").cast("string")).alias("s"))
    assert hosts.select(pii.ip(F.col("s"), "k")).distinct().count() == 256


def test_pseudonyms_of_very_long_texts(spark):
    rows = [(1, "a@b" + ".b" * 400_000), (2, "x" * 1_000_000 + "@" + "y." * 300_000), (3, "9" * 1_000_000), (4, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumns({c: F.lit(c) for c in ("_found", "_kinds", "found", "kinds")})
    got = {r["doc_id"]: r for r in pii.pseudonymized(docs, "k").collect()}
    assert {k: len(r["text"] or "") for k, r in got.items()} == {i: len(t or "") for i, t in rows}
    assert got[1]["_found"] == "_found" and got[4]["n_values"] == 0
    assert pii.pseudonymized(docs.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymized(docs, "")


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    text = lambda lang, n=60: " ".join("".join(rng.choices("eatoinshr" if lang == "en" else "éàèuçqlv", k=5)) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "fr"), "en" if i % 2 else "fr", "s", 0) for i in range(60)]
    passage = text("en", 30)
    rows += [(100, rows[1][1], "en", "s", 0), (101, rows[1][1] + " more", "en", "s", 0), (102, f"{rows[3][1]}\n{passage}", "en", "s", 0), (103, None, "en", "s", 0), (104, "", None, "s", 0), (105, "12 34", None, "s", 0), (7, rows[7][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(0.25), "lang_pred": F.lit("own")})
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, now.limit(0), str(tmp_path))
        assert empty.count() == 0
        now = stage(spark, now, str(tmp_path))
        if name != "sequences":
            assert now.columns == docs.columns
            assert {r["score"] for r in now.select("score").collect()} == {0.25} and {r["lang_pred"] for r in now.select("lang_pred").collect()} == {"own"}
            now.write.parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = ids(now)
    assert set(kept["language"]) == set(range(60)) | {100, 101, 102}
    assert len(kept["lines"]) == len(kept["language"]) == 64
    assert not {102} & set(kept["leaks"]) and set(range(60)) <= set(kept["leaks"])
    assert set(kept["sequences"]) == set(kept["leaks"])
    whole_ = corpus_pipeline.run(spark, str(tmp_path))
    assert ids(whole_) == kept["sequences"]


@pytest.mark.parametrize("share", [0, 5])
def test_lines_with_counts_beyond_16_bits(spark, share):
    """Bytes, or one word, that occur 32,767 times and more, in one group that meets under a key."""
    rng = random.Random(9)
    tail = lambda: "".join(rng.choices("bcdefgh", k=6_000))
    lines = []
    for n in (32_766, 32_767, 32_768, 40_000, 1_000_000):
        end = tail()
        lines += ["a" * n + end, "a" * (n + 1) + end, "a" * n + tail()]
    word = [f"x{k}" for k in range(40)]
    for n in (32_767, 32_768):
        own = [f"y{rng.randrange(10**6)}" for _ in range(40)]
        lines += [" ".join(word + ["w"] * n + own), " ".join(word + ["w"] * (n + 1) + own), " ".join(word + ["w"] * n + own[::-1])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_doc"] for r in linededup.line_decisions(docs, 2, 60, share).collect()}
    # a line and the one after it differ by one letter, or by one word: " w", two bytes
    expected = {k + 1: k for k in range(0, len(lines), 3)}
    if share:  # 5 in 100 of so many words are more than the 40 at their end
        expected |= {k: 15 for k in range(16, 21)}
    assert got == expected
    nodes = spark.createDataFrame([(i, i, x.encode()) for i, x in enumerate(lines)], "node long, root long, line binary")
    pairs = {(r["a"], r["b"]) for r in linededup.prefix_pairs(nodes, 2, share, 60).collect()}
    assert pairs >= {(k + 1, k) for k in range(0, len(lines), 3)}


def test_counts_of_items_may_be_too_large(spark, monkeypatch):
    """With a table of four slots every item seems common; the near lines are found all the same."""
    lines = [f"line {k // 2} of the shared words alpha beta gamma delta epsilon zeta eta theta number {k // 2 * 7919}{'x' * (k % 2)}" for k in range(40)]
    nodes = spark.createDataFrame([(i, i, x.encode()) for i, x in enumerate(lines)], "node long, root long, line binary")
    monkeypatch.setattr(linededup, "COUNT_BITS", 2)
    for share in (0, 5):
        pairs = {(r["a"], r["b"]) for r in linededup.prefix_pairs(nodes, 2, share, 60).collect()}
        assert pairs >= {(k + 1, k) for k in range(0, 40, 2)}
