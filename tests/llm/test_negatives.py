"""Hard negatives against all products, and the bounds against true scores."""

import random

import numpy as np

from milepost.llm import negatives

ROWS = "id bigint, label int, v array<bigint>, score double"


def brute(rows, asked, positives=5, count=10, low=30, high=90):
    ok = {(i, label, tuple(v)) for i, label, v, *_ in rows if None not in (i, label, v) and v}
    anchors = {(i, label, tuple(v)) for i, label, v, *_ in asked if None not in (i, label, v) and v}
    out = []
    for i, label, v in anchors:
        others = [(sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in ok
                  if j != i and len(w) == len(v)]
        best = sorted((-s, j) for s, j, x in others if x == label)[:positives]
        for p, positive in best:
            inside = sorted((-s, j) for s, j, x in others
                            if x != label and low * -p <= 100 * s <= high * -p)
            out += [(i, positive, n + 1, j, -p, -s) for n, (s, j) in enumerate(inside[:count])]
    return sorted(out)


def vector_rows():
    rng = random.Random(8)
    centers = [[rng.randint(-200, 200) for _ in range(13)] for _ in range(4)]
    rows = [(k, k % 4, [x + rng.randint(-90, 90) for x in centers[(k // 3) % 4]], None)
            for k in range(500)]
    rows += [(600 + k, k % 2, rows[5][2], None) for k in range(60)]  # equal vectors
    rows += [(700, 1, None, None), (701, None, rows[0][2], None), (None, 1, rows[0][2], None),
             (702, 1, [], None), (703, 1, [5, -3], None), (704, 2, [4, 4], None), (705, 1, [6, 1], None),
             (706, 1, [0] * 13, 1.0), (707, 9, [1] * 13, None), (3, 2, [7] * 13, None)]
    return [*rows, *rows[:20]]


def test_negatives_equal_all_products(corpus, monkeypatch):
    monkeypatch.setattr(negatives, "PACK_ROWS", 150)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 40)
    rows = vector_rows()
    df = corpus.createDataFrame(rows, ROWS)
    asked = [r for r in rows if r[0] is not None and (r[0] % 10 == 3 or r[0] >= 700)]
    got = negatives.mine(df, corpus.createDataFrame(asked, ROWS))
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == brute(rows, asked)
    assert negatives.mine(df.limit(0), df.limit(0)).count() == 0
    assert negatives.mine(df, df.limit(0)).count() == 0


def test_large_numbers_are_exact(corpus):
    rng = random.Random(2)
    rows = [(k, k % 3, [rng.randint(0, 2**29) for _ in range(9)], None) for k in range(40)]
    df = corpus.createDataFrame(rows, ROWS)
    got = negatives.mine(df, df.where("id < 4"))
    assert sorted(map(tuple, got.collect())) == brute(rows, rows[:4])


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(6)
    m = rng.integers(-300, 300, (400, 21)) + 50 * rng.integers(-3, 4, (400, 1))
    frame = negatives.pd.DataFrame({
        "width": 21, "pack": 0, "id": np.arange(400), "label": 0, "v": list(m)})
    pack = negatives.Pack(next(negatives._pack_rows(frame).itertuples()))
    anchor = negatives.Anchor(0, 0, m[0])
    rows, true, before = np.arange(400), m @ m[0], np.inf
    for segments in negatives.LEVELS:
        low, high = pack.bounds(rows, anchor, segments)
        assert (low <= true).all() and (true <= high).all()
        assert (high - low).sum() <= before
        before = (high - low).sum()


def test_summaries_spare_exact_scores(monkeypatch):
    rng = np.random.default_rng(5)
    m = np.concatenate([rng.integers(-5, 6, (500, 16)) + 100 * k for k in range(-4, 5)])
    frame = negatives.pd.DataFrame({
        "width": 16, "pack": 0, "id": np.arange(len(m)), "label": 0, "v": list(m)})
    pack = negatives.Pack(next(negatives._pack_rows(frame).itertuples()))
    seen = []
    exact = negatives._exact_scores
    monkeypatch.setattr(negatives, "_exact_scores", lambda a, v: (seen.append(len(a)), exact(a, v))[1])
    negatives._in_bands(pack, np.arange(len(m)), negatives.Anchor(-1, 0, m[-1]), [(0, 2**62)], 5)
    assert 0 < seen[0] < 0.2 * len(m)
