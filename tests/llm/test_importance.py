"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from corpus_rows import odd_rows

from milepost.llm import importance

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text):
    words = WORD.findall(lower(text))
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10000


def by_hand(docs, target, percent=25):
    s = Counter(bucket(g) for _, t in docs for g in grams(t)[1])
    t = Counter(bucket(g) for x in target for g in grams(x)[1])
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    rows = []
    for k, text in docs:
        words, found = grams(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
                 for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((k, len(found), weight, score, len(words)))
    able = sorted((r for r in rows if r[4] >= 20),
                  key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    ranks = {}
    for n, r in enumerate(able[: len(able) * percent // 100]):
        ranks.setdefault(r, []).append(n + 1)
    return Counter((*r[:4], ranks[r].pop() if ranks.get(r) else None) for r in rows)


def as_rows(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_features_equal_those_of_single_texts():
    rng = np.random.default_rng(3)
    texts = [("".join(rng.choice(list("ab1é \nZ-"), 40))) for _ in range(50)]
    texts += ["x" * 64, "x" * 65 + " y", "y " + "z" * 200 + " w", "", "é", "ends with", "starts"]
    of, hashed, words = importance.features([t.encode() for t in texts])
    for k, text in enumerate(texts):
        want_words, want = grams(text)
        assert words[k] == len(want_words)
        assert Counter(hashed[of == k].tolist()) == Counter(map(bucket, want))


def test_resampling_equals_plain_python(corpus):
    docs = corpus.read.parquet(f"{SF}/documents.parquet").repartition(5)
    target = corpus.read.parquet(f"{SF}/benchmark.parquet")
    got = importance.resample(docs, target)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert as_rows(got) == want


def test_odd_rows_and_empty_tables(corpus, odd, none):
    texts = [r[1] for r in odd_rows()[:6]]
    target = corpus.createDataFrame([(t,) for t in texts], "text string")
    rows = [(r[0], r[1]) for r in odd_rows()]
    clashing = odd.withColumnsRenamed({"lang": "_weight", "source": "rank"})
    for docs in (odd, clashing):
        assert as_rows(importance.resample(docs, target, 50)) == by_hand(rows, texts, 50)
    assert as_rows(importance.resample(odd, target.limit(0))) == by_hand(rows, [])
    assert importance.resample(none, target).count() == 0


def test_drawn_rows_are_the_ranked_ones(corpus, odd, none):
    target = odd.select("text")
    got = importance.drawn(odd, target, 50)
    assert got.columns == odd.columns
    ranked = importance.resample(odd, target, 50).where("rank IS NOT NULL")
    ids = {r.doc_id for r in ranked.collect()}
    assert {r.doc_id for r in got.collect()} == ids and got.count() >= ranked.count() > 0
    assert importance.drawn(none, target).count() == 0
