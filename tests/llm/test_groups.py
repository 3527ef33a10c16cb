"""Steps of corpus operators whose cost must not grow faster than their input."""

import random

from codeseam.llm import linededup


def test_settled_groups_are_not_moved(spark):
    # under key 1 all lines are connected; under 2 line 9 is not; 7 and 8 met in a small group
    pairs = spark.createDataFrame([(2, 1, 1), (3, 1, 1), (3, 1, 2), (9, 1, 2), (8, 7, None)], "a long, b long, hot long")
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, root long")
    got = linededup.unsettled(pairs, roots)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (3, 1), (9, 9)]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_items_of_large_groups_do_not_move(spark, monkeypatch):
    """Lines that share a passage, yet are not near, move by the rarest items of theirs alone."""
    rng = random.Random(5)
    own = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    lines = []
    for _ in range(60):
        line = f"the common passage of all {own(60)}"
        lines += [line, line[:70] + "é" + line[71:]]  # two bytes for one: two edits
    for k in range(60):  # near each other, and connected before
        lines.append(f"a family that is connected {own(2)} {'w' * 40}{own(2)}")
    roots = [*range(120), *[120] * 60]
    nodes = spark.createDataFrame([(i, r, x.encode()) for i, (r, x) in enumerate(zip(roots, lines, strict=True))], "node long, root long, line binary")
    rows, real = {}, linededup.written

    def kept(df, name):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(linededup, "written", kept)
    pairs = {(r["a"], r["b"]) for r in linededup.prefix_pairs(nodes, 2, 0, 60).collect()}
    near = {(a, b) for a in range(180) for b in range(a) if roots[a] != roots[b] and linededup.within(lines[a].encode(), lines[b].encode(), 2)}
    assert {(k + 1, k) for k in range(0, 120, 2)} <= near <= pairs
    # 2 edits change 4 words or 16 grams of 8 bytes; nothing of the family is in other lines
    assert max(rows.values()) <= 120 * (5 + 17)
