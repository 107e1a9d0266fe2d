import random

import numpy as np
import pytest
from corpus_rows import DOCS, odd_rows

from milepost.llm import graph, minhash


def brute(rows, width, num=80, den=100):
    sets = []
    for row in rows:
        w = (row[1] or "").encode().lower().split()
        if len(w) >= width:
            sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
        else:
            sets.append({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            name = min(ids) if ids else None
            out.append((rows[i][0], len(sets[i]), name, rows[i][0] == name))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_odd_rows(odd, width):
    assert got(minhash.near_duplicates(odd, width)) == brute(odd_rows(), width)


def test_empty_table(none):
    assert minhash.near_duplicates(none, 2).count() == 0
    assert minhash.one_of_each(none).columns == none.columns


def test_one_of_each_keeps_columns_and_one_row(odd):
    kept = minhash.one_of_each(odd, 2)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {0, 4, 5, 6, 7, 9} <= set(ids)
    assert [r.text for r in kept.where("doc_id = 3").collect()] == ["another text of a known id"]


def test_one_of_each_keeps_one_row_of_each_component(corpus):
    texts = [f"{w} is a text of its own that shares no word pair with {w} others" for w in "abcde"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]),
            (9, texts[3]), (None, texts[4]), (5, texts[4]), (5, texts[4].upper()),
            (None, None), (None, None), (5, ""), (None, " \n")]
    df = corpus.createDataFrame([(k, t, "en", "s", 1, None) for k, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in minhash.one_of_each(df.repartition(3), 5, 95).collect()]
    five = [x for x in got if x[0] == 5 and x[1]]
    assert len(five) == 1 and five[0][1].lower() == texts[4]
    got.remove(five[0])
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]),
            (None, None), (None, None), (5, ""), (None, " \n")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_large_families_are_compared_in_blocks(corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(80), rng.randint(1, 9)):
            words[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(words), "en", "s", 1, None))
    df = corpus.createDataFrame(rows, DOCS)
    assert got(minhash.near_duplicates(df, 2)) == brute(rows, 2)


def test_threshold_and_forest():
    assert minhash.match_threshold(0.8) == 34
    sets = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64),
            np.arange(50, 60, dtype=np.uint64)]
    assert minhash._linked(sets, [1, 2, 3], 80, 100) == [(0, 1)]
    assert minhash._linked(sets, [1, 1, 3], 80, 100) == []


def test_components_of_a_path_and_a_star(corpus):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = graph.components(corpus.createDataFrame(edges, "a int, b int")).collect()
    roots = {}
    for r in found:
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, roots.values())) == [40, 41]
