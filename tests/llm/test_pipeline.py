"""The pipeline against plain Python, stage by stage and as a whole."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_minhash import brute
from test_tables import fill_by_hand

import corpus_pipeline as P
from milepost.llm import crf, mixing, packing
from milepost.llm.text import stored

SF = "/root/testdata/sf0.001"


def without_boilerplate(rows, least=10):
    sites, texts = defaultdict(set), defaultdict(set)
    for r in rows:
        for line in r["text"].split("\n"):
            sites[line].add(r["source"])
            texts[line].add(r["text"])
    gone = {x for x, s in sites.items() if min(len(s), len(texts[x])) >= least
            and re.search(r"[^\x20\x09-\x0D]", x)}
    out = []
    for r in rows:
        text = "\n".join(x for x in r["text"].split("\n") if x not in gone)
        out.append({**r, "text": text, "n_chars": len(text) if text != r["text"] else r["n_chars"]})
    return out


def mixed(rows, share=(4, 5)):
    def domain(r):
        return f"d{int(r['source'].removeprefix('src')) % 4}"

    size = {r["doc_id"]: len(r["text"].encode().split()) for r in rows}
    leaves = Counter()
    for r in rows:
        leaves[domain(r), r["lang"], r["source"]] += size[r["doc_id"]]
    given = {(): sum(leaves.values()) * share[0] // share[1]}
    for k, level in enumerate(mixing.LEVELS):
        caps = Counter()
        for leaf, n in leaves.items():
            caps[leaf[: k + 1]] += n
        for parent in {c[:k] for c in caps}:
            mine = {c: n for c, n in caps.items() if c[:k] == parent}
            w = {c: mixing.WEIGHTS[level].get(c[k], 1) for c in mine}
            given |= fill_by_hand(mine, w, given[parent])
    kept = []
    for leaf, tokens in leaves.items():
        times, rest = divmod(given[leaf], tokens) if tokens else (0, 0)
        own = [r for r in rows if (domain(r), r["lang"], r["source"]) == leaf]
        key = {r["doc_id"]: hashlib.md5(f"{mixing.SEED}:{times}:{r['doc_id']}".encode()).hexdigest()
               for r in own}
        upto = 0
        for r in sorted(own, key=lambda r: key[r["doc_id"]]):
            if times or upto < rest:
                kept.append(r)
            upto += size[r["doc_id"]]
    return kept


def as_set(rows):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows)


def test_pipeline_equals_plain_python(corpus):
    docs = corpus.read.parquet(f"{SF}/documents.parquet")
    labels = corpus.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in crf.score(docs, labels).where("predicted = 1").collect()}
    rows = [r.asDict() for r in docs.collect() if r.doc_id in good]
    assert 0 < len(rows) < docs.count()
    expected = [rows]
    expected.append(without_boilerplate(rows))
    keep = {k for k, _, name, kept in brute([(r["doc_id"], r["text"]) for r in expected[-1]], 5)
            if kept}
    expected.append([r for r in expected[-1] if r["doc_id"] in keep])
    expected.append(mixed(expected[-1]))
    df = docs
    for (name, stage), want in zip(P.STAGES[:-1], expected, strict=True):
        df = stored(stage(corpus, df, SF), name)
        assert df.columns == docs.columns
        assert as_set(r.asDict() for r in df.collect()) == as_set(want), name
    tokenizer = packing._slow(packing.tokenizer_paths()[0])
    want = Counter()
    for r in expected[-1]:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 1024):
            part = np.array(ids[a : a + 1024], "<u4")
            want[r["doc_id"], a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = P.run(corpus, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        ends = [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert [a for a, _ in sorted(pieces)] == ends
        assert sum(n for _, n in pieces) <= 1024


def with_tables(corpus, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_survive_odd_rows(corpus, odd, tmp_path):
    labels = corpus.read.parquet(f"{SF}/labels.parquet")
    sf = with_tables(corpus, tmp_path / "odd", odd, labels)
    df = corpus.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        before = Counter(str(r.doc_id) + str(r.lang) + str(r.source) for r in df.collect())
        df = stored(stage(corpus, df, sf), f"odd-{name}")
        after = df.collect()
        assert df.columns == odd.columns, name
        assert not Counter(str(r.doc_id) + str(r.lang) + str(r.source) for r in after) - before, name
        if name == "line_dedup":
            assert len(after) == sum(before.values())
    tokenizer = packing._slow(packing.tokenizer_paths()[0])
    want = Counter()
    for r in df.collect():
        want[r.doc_id] += 1 + len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    got = Counter()
    for r in P.STAGES[-1][1](corpus, df, sf).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_empty_tables_give_no_piece(corpus, odd, none, tmp_path):
    labels = corpus.read.parquet(f"{SF}/labels.parquet")
    assert P.run(corpus, with_tables(corpus, tmp_path / "none", none, labels)).count() == 0
    # Without a label the classifier accepts every row, so something is left to pack.
    sf = with_tables(corpus, tmp_path / "bare", odd, labels.limit(0))
    assert P.run(corpus, sf).count() > 0
