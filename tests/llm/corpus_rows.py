"""Rows that every operator must survive."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"


def _prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n))


def odd_rows():
    """Rows with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    rng = random.Random(5)
    base = _prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    long = "\n".join(_prose(rng, 40) for _ in range(400))
    texts = [
        base, base, near, near + " tail", None, "", " \t\n", "one", "ONE", "one two", "One TWO",
        "é" * 30 + " ß " + "日本" * 10, long, long + "\n" + base, "line\n" * 50, "a\r\nb\rc\x0bd\x0ce",
        _prose(rng, 25), _prose(rng, 19), "<|endoftext|> text", "word " * 300,
    ]
    rows = [
        (k, t, ("en", "de", None)[k % 3], (None if k == 4 else f"src{k % 7}"),
         None if t is None else len(t), None)
        for k, t in enumerate(texts)
    ]
    rows.append(rows[0])  # a repeated row
    rows.append((3, "another text of a known id", "fr", "x", 26, 1.0))
    rows.append((None, base, "en", "src1", len(base), None))
    return rows
