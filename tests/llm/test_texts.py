"""Line spread, secrets, compression bands, suffix dedup, the classifier."""

import base64
import collections
import hashlib
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from corpus_rows import DOCS, odd_rows

from milepost.llm import compression, crf, lines, secret_scan, suffix
from milepost.llm import text as T
from milepost.llm.queries import QUERIES
from milepost.session import fresh_path


def test_words_are_those_of_bytes_split():
    texts = [r[1] or "" for r in odd_rows()]
    data, offsets = T.raw(pa.array(texts))
    starts, ends, hashes, first = T.words(data, offsets, lower=True)
    seen = {}
    for k, text in enumerate(texts):
        words = text.encode().lower().split()
        mine = range(first[k], first[k + 1])
        assert [data[starts[i] : ends[i]].tobytes().lower() for i in mine] == words
        for i, w in zip(mine, words, strict=True):
            assert seen.setdefault(w, hashes[i]) == hashes[i]
    assert len(set(seen.values())) == len(seen)


def spread_rows():
    shared = "this line stands on many sites"
    rows = [(k, f"own {k}\n{shared}\n\nend {k}", "en", f"s{k}", 0, None) for k in range(12)]
    copy = "only copied\nnot boilerplate"
    rows += [(100 + k, copy, "en", f"s{k}", 0, None) for k in range(12)]
    rows += [(200, None, "en", "s1", None, None), (201, "", "en", None, 0, None),
             (202, shared, "en", None, 0, None), (202, shared, "en", None, 0, None)]
    rows += [(300 + k, f"nine sites\nrow {k}", "en", f"s{k % 9}", 0, None) for k in range(15)]
    # Ten texts: all but one stand on the first site, one was copied to nine others.
    rows += [(400 + k, f"copies count\nten {k}", "en", "a", 0, None) for k in range(10)]
    rows += [(420 + k, "copies count\nten 0", "en", f"b{k}", 0, None) for k in range(9)]
    return rows


def test_line_spread(corpus, none):
    df = corpus.createDataFrame(spread_rows(), DOCS)
    got = {(r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in lines.report(df).collect()}
    want = {(k, f"own {k}\n\nend {k}", 4, 1) for k in range(12)}
    want |= {(100 + k, "only copied\nnot boilerplate", 2, 0) for k in range(12)}
    want |= {(200, None, 0, 0), (201, "", 1, 0), (202, "", 1, 1)}
    want |= {(300 + k, f"nine sites\nrow {k}", 2, 0) for k in range(15)}
    want |= {(400 + k, f"ten {k}", 2, 1) for k in range(10)}
    want |= {(420 + k, "ten 0", 2, 1) for k in range(9)}
    assert got == want and lines.report(df).count() == len(spread_rows())
    cleaned = lines.cleaned(df)
    assert cleaned.columns == df.columns
    assert cleaned.where("doc_id = 202 and n_chars = 0 and text = ''").count() == 2
    assert lines.cleaned(none).count() == 0


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)


def spans_of(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text)
             if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text)
              if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def secret_texts():
    hexes = "0123456789abcdef01234567"
    return [
        "é PASSWORD = 'hunter2-long' and " + hexes, "token:abc", "secret=token: abcdef",
        "api_key=\"AKIA" + "A" * 16 + "\"", "AKIAAKIA" + "0" * 12, hexes[:23], None, "",
        "ſecret=abcdefgh toKen=abcdefgh", "password=" + hexes, "x" * 5000 + " passwd : " + hexes,
        "-----BEGIN RSA PRIVATE KEY----- http://me:pw@host",
    ]


def test_secrets_and_their_ledger(corpus, none):
    texts = secret_texts()
    rows = [(k, t, "en", "s", 0, None) for k, t in enumerate(texts)] * 2
    df = corpus.createDataFrame(rows, DOCS)
    ledger = secret_scan.open_ledger(corpus, fresh_path(corpus, "ledger"))
    got = secret_scan.findings(df, ledger).collect()
    assert len(got) == len(rows)
    for r in got:
        want = spans_of(texts[r.doc_id] or "")
        kinds = collections.Counter(k for k, _, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            kinds[k] for k in ("assign", "access", "hex")
        )
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in kinds] == joined.split(",") * bool(want)
    assert {r.spans for r in got if r.doc_id == 11} == {"pem:0:31,login:36:45"}
    # A second run scans nothing; a new rule version and a new blob are scanned alone.
    before = corpus.read.schema(secret_scan.LEDGER).parquet(ledger).count()
    secret_scan.findings(df, ledger)
    assert corpus.read.schema(secret_scan.LEDGER).parquet(ledger).count() == before
    rules = {**secret_scan.RULES, "hex@2": ("[0-9A-F]{24,}", 0, 24)}
    more = df.union(corpus.createDataFrame([(99, "new", "en", "s", 0, None)], DOCS))
    secret_scan.findings(more, ledger, rules)
    rows = corpus.read.schema(secret_scan.LEDGER).parquet(ledger).collect()
    later = [r.scanned for r in rows[:]]
    assert sum(s == ["hex@2"] for s in later) == before and sum(len(s) == 6 for s in later) == 1
    empty = secret_scan.open_ledger(corpus, fresh_path(corpus, "ledger"))
    assert secret_scan.findings(none, empty).count() == 0


def test_logins_of_any_length():
    run = secret_scan._scan(secret_scan.RULES)
    name = next(n for n in secret_scan.RULES if n.startswith("login@"))
    texts = ["x://u:" + "t" * 500 + "@h", "x://" + "u" * 90 + ":p@h", "x://:password@host",
             "x://u:@h", "x://u:p/q@h", "x://u:p q@h"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b"k"] * len(texts)), pa.array(texts), pa.array([[name]] * len(texts))],
        names=["blob", "text", "pending"],
    )
    found = next(run([batch])).column("found").to_pylist()
    assert [[(s["start"], s["end"]) for s in f] for f in found] == [
        [(1, 507)], [(1, 97)], [(1, 14)], [], [], [],
    ]


def test_compression_counts_and_verdict(odd, none):
    rows = odd_rows()
    got = sorted(map(tuple, compression.compression_rules(odd).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed").collect()), key=str)
    want = []
    for row in rows:
        text = row[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        held = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        where = collections.defaultdict(list)
        for k in range(len(w) - 7):
            where[tuple(w[k : k + 8])].append(k)
        covered = {k + i for v in where.values() if len(v) > 1 for k in v for i in range(8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((row[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
                     len(held) - len(set(held)), len(covered), failed))
    assert got == sorted(want, key=str)
    kept = {r.doc_id: r.kept for r in compression.compression_rules(odd).collect()}
    assert kept[16] and kept[12] and not kept[19] and not kept[5]
    assert compression.compression_rules(none).count() == 0


def test_compression_bands_by_length():
    squeeze = __import__("zstandard").ZstdCompressor(level=3).compress
    noise = np.random.default_rng(0).integers(0, 256, 9000, dtype=np.uint8).tobytes()
    prose = b" ".join(b"%x" % (k * 2654435761 % 2**20) for k in range(1200))
    bands = compression.Bands()
    assert not compression._verdict(noise, bands, squeeze)[3]
    assert not compression._verdict(b"again and again " * 500, bands, squeeze)[3]
    assert compression._verdict(prose, bands, squeeze)[3]
    # Half of the chunks are junk, though the whole is inside its band.
    assert not compression._verdict(prose[:4096] + b"x" * 4096, bands, squeeze)[3]
    assert compression._verdict(b"short", bands, squeeze)[3]


def test_encoded_text_is_rejected_at_every_length():
    squeeze = __import__("zstandard").ZstdCompressor(level=3).compress
    rng = np.random.default_rng(4)
    bands = compression.Bands()

    def base64_lines(n):
        coded = base64.b64encode(rng.bytes(n)).decode()
        return "\n".join(coded[k : k + 76] for k in range(0, n, 76))[:n].encode()

    def words(letters, n):
        return " ".join("".join(rng.choice(list(letters), 8)) for _ in range(n // 9 + 1))[:n].encode()

    letters = string.ascii_letters + string.digits
    for n in (300, 511, 700, 1023, 1500, 2047, 3000, 6000, 60_000):
        assert not compression._verdict(base64_lines(n), bands, squeeze)[3], n
        assert not compression._verdict(words(letters, n), bands, squeeze)[3], n
        assert compression._verdict(words("abcdefgh", n), bands, squeeze)[3], n
    # A short last chunk of base64 is a bad chunk; one too short to tell is none.
    clean = words("abcdefgh", 4096)
    assert compression._verdict(clean + base64_lines(1000), bands, squeeze)[1:3] == (2, 1)
    assert compression._verdict(clean + b"end", bands, squeeze)[1:3] == (2, 0)


def cut_by_hand(bodies, width):
    seen = collections.Counter(
        b[k : k + width] for b in bodies for k in range(len(b) - width + 1)
    )
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def repeat_rows():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage, other = word(90), word(64)
    texts = [
        word(200) + passage + word(50), word(30) + passage[5:] + word(80), passage, None, "",
        other, other, other[:40] + "X" + other[41:], "ab" * 200, word(500), "z" * 63, "z" * 63,
        passage + passage, word(10) + other[:63],
    ]
    texts += ["p" + other[: 20 + k] + "q" + other[20 + k :] + word(k) for k in range(30)]
    return [(k, t, "en", "s", 0, None) for k, t in enumerate(texts)]


def test_suffix_dedup_against_all_windows(corpus, none, monkeypatch):
    rows = repeat_rows()
    df = corpus.createDataFrame([*rows, rows[0]], DOCS)
    bodies = [(r[1] or "").encode() for r in [*rows, rows[0]]]
    for width, digit in ((64, 20), (64, 60), (40, 8)):
        want = sorted((r[0], *x) for r, x in zip([*rows, rows[0]], cut_by_hand(bodies, width), strict=True))
        assert sorted(map(tuple, suffix.cut_repeats(df, width, digit).collect())) == want
    monkeypatch.setattr(suffix, "IN_TASK", 3)
    assert sorted(map(tuple, suffix.cut_repeats(df, 40, 8).collect())) == want
    assert suffix.cut_repeats(none).count() == 0


def test_suffix_query_cuts_by_bytes_and_not_by_words(corpus, tmp_path):
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    prose = lambda n: " ".join(word(5) for _ in range(n))
    passages = [prose(66) + word(k) for k in (3, 4, 5)]  # of over 50 words; 398, 399, 400 bytes
    # The bytes around a passage differ, so that no longer string repeats.
    texts = [f"{a}{p}{b} {prose(40)}" for p in passages for a, b in (("X", "Y"), ("Z", "W"))]
    texts += [prose(300), prose(20)]
    rows = [(k, t, "en", "s", len(t), None) for k, t in enumerate(texts)]
    corpus.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op4_suffix_dedup"](corpus, str(tmp_path)).orderBy("doc_id").collect()
    want = cut_by_hand([t.encode() for t in texts], 400)
    assert [tuple(r)[:5] for r in got] == [(k, *x) for k, x in enumerate(want)]
    assert [r.n_removed for r in got] == [0, 0, 0, 0, 400, 400, 0, 0]
    assert [r.kept_text for r in got] == [t.replace(passages[2], "") for t in texts]


def test_suffix_parts_of_long_texts_overlap(monkeypatch):
    monkeypatch.setattr(suffix, "_PIECE", 300)
    offsets = np.array([0, 100, 1100, 1150])
    seen = [w for lo, hi, a, b in suffix._pieces(offsets, 64) for w in range(a, b - 63)]
    assert set(range(100, 1100 - 63)) <= set(seen)
    assert len([w for w in seen if 100 <= w <= 1100 - 64]) == 1000 - 63


def label_rows():
    rng = np.random.default_rng(0)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(12)) + "."
    docs, labels = [], []
    for k in range(160):
        body = [good() for _ in range(rng.integers(2, 8))]
        bad = k % 4 == 0
        if bad:
            body[rng.integers(len(body))] = " | ".join(["JUNK!!"] * 15)
            body.append("$$$ ### " * 20)
        docs.append((k, "\n".join(body), "en", "s", 0, 0.5))
        labels.append((k, int(not bad), 0))
    return docs, labels


def test_classifier_on_held_out_rows_and_odd_ones(corpus, odd, none):
    docs, labels = label_rows()
    table = corpus.createDataFrame([*labels, (None, 1, 0), (3, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    df = corpus.createDataFrame(docs, DOCS)
    got = crf.score(df, table).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out]
    right = sum(r.predicted == labels[r.doc_id][1] for r in held)
    assert len(held) > 20 and right >= 0.95 * len(held)
    kept = crf.accepted(df, table)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    assert crf.score(odd, table).count() == len(odd_rows())
    assert crf.score(none, table).count() == 0
    assert crf.score(df, table.limit(0)).where("predicted = 1").count() == len(docs)


def test_lines_belong_to_their_own_text():
    for texts, want in (
        (["ab\ncd\n", "ef"], [0, 3, 4]), (["ab", "", "ef"], [0, 1, 2, 3]),
        ([None, "\n\n", ""], [0, 1, 4, 5]), (["", ""], [0, 1, 2]),
    ):
        features, size, first = crf._line_features(*T.raw(pa.array(texts, pa.string())))
        assert first.tolist() == want and len(features) == len(size) == want[-1]


def test_score_is_the_same_alone_and_in_any_batch(corpus):
    docs, labels = label_rows()
    # Labelled: texts that end in line feeds, and an empty one of the largest doc_id.
    docs = [(k, t + "\n" * (k % 3), *rest) for k, t, *rest in docs] + [(999, "", "en", "s", 0, 0.5)]
    table = corpus.createDataFrame([*labels, (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert zlib.crc32(b"999") % 4 != 2
    model = crf.train(corpus.createDataFrame(docs, DOCS), table)
    texts = ["", *[d[1] for d in docs], None, "\n", "last\n"]

    def scores(part):
        batch = pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["text"])
        return next(crf._apply(model)([batch])).column("score").to_numpy()

    alone = np.concatenate([scores([t]) for t in texts])
    assert np.isfinite(alone).all() and len(set(alone.round(6))) > 20
    assert np.allclose(scores(texts), alone, rtol=0, atol=1e-12)
    assert np.allclose(scores(texts[::-1])[::-1], alone, rtol=0, atol=1e-12)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    unary, links = rng.normal(size=9), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 9])
    good, pairs = crf.marginals(unary, links, first)
    want, want_pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        total = 0
        part, part_pairs = np.zeros(b - a), np.zeros((2, 2))
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            w = sum(unary[a + k] for k in range(b - a) if y[k])
            w = np.exp(w + sum(links[y[k], y[k + 1]] for k in range(b - a - 1)))
            total += w
            part += w * np.array(y)
            for k in range(b - a - 1):
                part_pairs[y[k], y[k + 1]] += w
        want[a:b] = part / total
        want_pairs += part_pairs / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)
