"""Search, mixing, sharding, packing, and the registered queries."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_rows import DOCS, odd_rows

from milepost.llm import mixing, mtree, packing, sharding
from milepost.llm.text import stored

SF = "/root/testdata/sf0.001"


def vector_rows():
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)], 0) for k in range(400)]
    rows += [(1000 + k, rows[7][1], 0) for k in range(300)]  # equal vectors
    rows += [(2000, None, 0), (2001, [1.0, None], 0), (2002, [float("nan")] * 6, 0),
             (2003, [float("inf")] * 6, 0), (2004, [], 0), (None, [1.0] * 6, 0),
             (2005, [0.5, 0.25], 0), (2006, [0.5, -0.25], 0), rows[3]]
    return rows


def top_by_hand(rows, k):
    ok = [(i, np.floor(256 * np.array(np.float32(v), float)).astype(int)) for i, v, _ in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        found = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


def test_top_k_equals_all_distances(corpus, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 200)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 300)
    monkeypatch.setattr(mtree, "PAGE", 16)
    rows = vector_rows()
    df = corpus.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    asked = mtree.vectors(df).withColumnRenamed("vec_id", "query_id")
    got = mtree.search(mtree.index(df), asked, 5)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"),
                          ("score", "bigint")]
    assert set(map(tuple, got.collect())) == top_by_hand(rows, 5)
    empty = df.limit(0)
    nothing = mtree.vectors(empty).withColumnRenamed("vec_id", "query_id")
    assert mtree.search(mtree.index(empty), nothing, 5).count() == 0
    assert mtree.search(mtree.index(df), nothing, 5).count() == 0


def test_tree_skips_pages():
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.integers(-5, 5, (200, 8)) + 300 * np.eye(8, dtype=int)[k] for k in range(8)])
    pages = mtree.build(0, np.arange(1600), m.astype(float))
    tree = mtree.Tree(pages)
    leaves = sum(pages["leaf"])
    read = []
    tree.pages = [type("Seen", (tuple,), {"__iter__": lambda s: (read.append(1), tuple.__iter__(s))[1]})(p)
                  for p in tree.pages]
    tree.search(m[5].astype(float), 5, 5)
    assert 0 < len(read) < leaves


def fill_by_hand(caps, weights, budget):
    given, open_ = {}, dict(caps)
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if budget * weights[k] >= open_[k] * total]
        if not full:
            return {**given, **{k: budget * weights[k] // total for k in open_}}
        for k in full:
            given[k] = open_.pop(k)
        budget -= sum(given[k] for k in full)
    return given


def test_budgets_move_to_siblings_first(corpus):
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 400), ("d0", "de", "c", 50), ("d1", "en", "e", 30),
              ("d2", "fr", "f", 900), ("x", "", "", 5)]
    df = corpus.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    from pyspark.sql import functions as F

    got = {tuple(r)[:3]: r.given for r in mixing.leaf_budgets(df, F.sum("tokens"), 1).collect()}
    w = {"d0": 4, "d1": 3, "d2": 2, "x": 1}
    assert got == {tuple(r[:3]): r[3] for r in leaves}
    got = {tuple(r)[:3]: r.given for r in mixing.leaf_budgets(df, F.lit(600), 1).collect()}
    top = fill_by_hand({"d0": 460, "d1": 30, "d2": 900, "x": 5}, w, 600)
    lang = fill_by_hand({"en": 410, "de": 50}, {"en": 5, "de": 2}, top["d0"])
    source = fill_by_hand({"a": 10, "b": 400}, {"a": 1, "b": 1}, lang["en"])
    assert got[("d0", "en", "b")] == source["b"] and got[("d0", "de", "c")] == lang["de"]
    assert got[("d1", "en", "e")] == 30 and got[("d2", "fr", "f")] == top["d2"]


def test_mixing_takes_prefixes_of_seeded_epochs(odd, none):
    rows = mixing.select(odd, (3, 2), 2)
    assert rows.columns == [*odd.columns, "_domain", "_tokens", "_epoch"]
    times = Counter((r.doc_id, r.text) for r in rows.collect())
    # The repeated row comes and goes with its twin.
    assert all(n <= 2 for k, n in times.items() if k[0] != 0)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(none).count() == 0
    whole = mixing.select(odd, (1, 1), 1).agg({"_tokens": "sum"}).first()[0]
    assert whole == sum(len((r[1] or "").encode().split()) for r in odd_rows())


def test_shards_are_balanced_and_gapless(corpus, odd, none):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(1, 400) + str(k), "en", "s", 0, None) for k in range(1500)]
    rows += [(5000 + k, "copied text " * 20, "en", "s", 0, None) for k in range(60)]
    got = sharding.shard(corpus.createDataFrame(rows, DOCS), 8).collect()
    sizes, slots = Counter(), defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].add(r.slot)
    assert len(got) == len(rows) and set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values())
    counts = Counter(r.shard for r in got)
    assert all(slots[s] == set(range(counts[s])) for s in counts)
    assert len({r.shard for r in got if r.doc_id >= 5000}) == 1
    for r, text in ((r, t) for r in sharding.shard(odd).collect() for k, t, *_ in odd_rows()
                    if k == r.doc_id and k not in (3, None)):
        body = (text or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
    assert sharding.shard(odd).count() == len(odd_rows()) and sharding.shard(none).count() == 0


def test_bins_merge_over_several_levels(corpus, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 48)
    monkeypatch.setattr(sharding, "TASK_BINS", 48)
    rng = random.Random(3)
    # 63 buckets at 3 a task: 63, 21, 7, 3 and 1.
    rows = [(k, "w " * rng.randint(1, 60) + str(k), "en", "s", 0, None) for k in range(3000)]
    rows += [(5000 + k, "copied text", "en", "s", 0, None) for k in range(30)]
    got = sharding.shard(corpus.createDataFrame(rows, DOCS), 4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes, counts = Counter(), Counter(r.shard for r in got)
    for r in got:
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(4))
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values())
    assert max(counts.values()) - min(counts.values()) < 0.02 * len(rows)
    assert len({r.shard for r in got if r.doc_id >= 5000}) == 1


def test_items_go_where_the_dot_product_is_highest():
    rng = random.Random(6)
    demand = [[rng.randint(1, 50), rng.randint(0, 9), 1] for _ in range(200)]
    total = [sum(d[k] for d in demand) for k in range(3)]
    share = [[d[k] / total[k] for k in range(3)] for d in demand]
    got = sharding.pack(np.array(demand, float), 5)
    rest = [[0.2] * 3 for _ in range(5)]
    for k in sorted(range(200), key=lambda k: -max(share[k])):
        fit = [sum(a * b for a, b in zip(r, share[k], strict=True)) for r in rest]
        assert fit[got[k]] >= max(fit) - 1e-12
        rest[got[k]] = [a - b for a, b in zip(rest[got[k]], share[k], strict=True)]


def test_a_group_larger_than_a_shard_is_cut(corpus):
    rows = [(k, "same text here", "en", "s", 0, None) for k in range(400)]
    rows += [(1000 + k, f"text {k}", "en", "s", 0, None) for k in range(400)]
    sizes = Counter(r.shard for r in sharding.shard(corpus.createDataFrame(rows, DOCS), 8).collect())
    assert max(sizes.values()) < 1.3 * 100


def test_packing_is_a_round_trip(odd, none):
    tokenizer = packing._slow(packing.tokenizer_paths()[0])
    got = packing.pack(odd, 64).collect()
    texts = defaultdict(list)
    for k, t, *_ in odd_rows():
        texts[k].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    want, seen = Counter(), Counter()
    for k, versions in texts.items():
        for ids in versions:
            for a in range(0, len(ids), 64):
                part = np.array(ids[a : a + 64], "<u4")
                want[(k, a, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    place = defaultdict(list)
    for r in got:
        seen[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
        place[r.sequence_id].append((r.offset, r.length))
    assert seen == want
    for pieces in place.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("n", [1, 7, 300, 20000])
def test_cutting_stock_places_every_piece(n):
    rng = np.random.default_rng(n)
    sizes, demand = np.unique(rng.integers(1, 129, n), return_counts=True)
    found = packing.cutting_stock(sizes, demand.astype(float), 128)
    assert (sum(p * t for p, t in found) == demand).all()
    assert all((p * sizes).sum() <= 128 for p, _ in found)
    used, need = sum(t for _, t in found), (sizes * demand).sum() / 128
    assert used <= max(1.02 * need, need + 8) or used <= 1.02 * (demand[sizes > 64].sum()) + 8


def test_ids_equal_those_of_the_other_library():
    tokenizer = packing._slow(packing.tokenizer_paths()[0])
    for _, text, *_ in odd_rows():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert packing.token_ids(text or "", packing.tokenizer_paths()) == ids


def test_pipeline_stages_keep_the_columns(corpus):
    import corpus_pipeline as P

    docs = corpus.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(corpus, docs, SF), name)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= rows, name
        rows = docs.count()
    assert docs.select("doc_id").distinct().count() == rows
    pieces = P.STAGES[-1][1](corpus, docs, SF)
    assert pieces.select("doc_id").distinct().count() == rows


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert {"op2_line_spread", "op5_mtree_top_k", "op6_source_mixing"} <= set(entry.oracle_sql())
