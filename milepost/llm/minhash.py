"""Near-duplicate groups: an inverted join on signature coordinates.

Each distinct shingle set gets a MinHash signature. A set is posted under its
coordinate values; two sets are candidates if they agree on ``matches``
coordinates. As in list merging with skips, only the rarest
``coordinates - matches + 1`` postings of a set are merged (two sets that agree
often enough must share one of those), and the longer lists are skipped: the
candidates are looked up in the stored signatures instead. What is linked is then
decided on the full sets.

A posting list gives a spanning forest of its candidate pairs, not the pairs; long
lists are cut in blocks, and blocks are compared with each other where their sets
are not yet connected. What the forests connect is a family, and inside a family all
sets are compared exactly, in blocks of bounded size: twice within blocks drawn by
different hashes, which joins what is linked, and then between all blocks that still
hold different groups. No list and no family is capped, and no group is expanded
into its pairs.

``matches`` is chosen so that a pair at the similarity limit has a chance of
less than one in a million to be missed; sets far below it are rejected
exactly. Shingle identity is by 64-bit hash, set identity by 128 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from milepost.llm import text as T
from milepost.llm.graph import components

COORDINATES = 64
BLOCK = 256
BLOCK_BYTES = 1 << 24
MATRIX_CELLS = 1 << 22
_WORD = r"[^\x20\x09-\x0D]"
_RANDOM = np.random.default_rng(64)
_MULTIPLY = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def match_threshold(similarity: float, coordinates: int = COORDINATES, miss: float = 1e-6) -> int:
    """Most matches to ask for if a pair at ``similarity`` may fall short with chance ``miss``."""
    below = 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words are one shingle."""
    data, offsets = T.raw(column)
    for lo, hi in T.row_blocks(offsets):
        at = offsets[lo : hi + 1]
        _, _, hashes, first = T.words(data[at[0] : at[-1]], at - at[0], lower=True)
        n = len(hashes)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled[: n - k] = T.mix(rolled[: n - k] + hashes[k:] * np.uint64(2 * k + 3))
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest()
                yield np.frombuffer(whole, np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest 32-bit value of each coordinate's hash function."""
    low = np.full(COORDINATES, np.uint64(2**64 - 1))
    for k in range(0, len(shingles), 4096):
        part = shingles[None, k : k + 4096] * _MULTIPLY[:, None] + _ADD[:, None]
        np.minimum(low, part.min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(width: int):
    def run(batches):
        for batch in batches:
            sizes, keys, probes = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                probes.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(probes, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "key", "probe"],
            )

    return run


def _post(batches):
    """One row per coordinate: the coordinate's number above its 32-bit value."""
    places = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("probe").to_pylist()), np.uint32)
        tokens = (values.reshape(-1, COORDINATES).astype(np.int64) + places).ravel()
        rows = pa.array(np.repeat(np.arange(batch.num_rows), COORDINATES))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").take(rows), pa.array(tokens)], names=["node", "token"]
        )


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            keys, sets = [], []
            for s in shingle_sets(batch.column("text"), width):
                if len(s):
                    keys.append(set_key(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "items"]
            )

    return run


def _groups(batches, keys: tuple[str, ...]):
    """Runs of equal keys in a sorted stream, as record batches."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if rest and key != last:
                yield rest
                rest = []
            rest.append(batch.slice(a, b - a))
            last = key
    if rest:
        yield rest


def _column(parts: list[pa.RecordBatch], name: str) -> list:
    return [v for p in parts for v in p.column(name).to_pylist()]


def _probes(parts: list[pa.RecordBatch]) -> np.ndarray:
    rows = b"".join(v for p in parts for v in p.column("probe").to_pylist())
    return np.frombuffer(rows, np.uint32).reshape(-1, COORDINATES)


_PAIRS = "a bigint, b bigint"


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
    )


def _forests(matches: int):
    """A strongest spanning forest of each list: at most one edge fewer than members."""

    def forest(parts):
        nodes, probes = _column(parts, "node"), _probes(parts)
        free = np.ones(len(nodes), bool)
        best = np.full(len(nodes), -1)
        source = np.zeros(len(nodes), np.int64)
        at = 0
        for _ in range(len(nodes) - 1):
            free[at] = False
            agree = (probes == probes[at]).sum(1)
            closer = free & (agree > best)
            best[closer], source[closer] = agree[closer], at
            at = int(np.argmax(np.where(free, best, -2)))
            if best[at] >= matches:
                x, y = nodes[source[at]], nodes[at]
                yield (x, y) if x < y else (y, x)

    def run(batches):
        for parts in _groups(batches, ("token", "chunk")):
            if sum(p.num_rows for p in parts) > 1:
                pairs = list(forest(parts))
                if pairs:
                    yield _pair_batch(pairs)

    return run


def _forest_of(joined: np.ndarray, group: list[int]) -> list[tuple[int, int]]:
    """The pairs of the upper triangle of ``joined`` that join two groups of ``group``."""

    def top(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    found = []
    for i, j in zip(*np.nonzero(np.triu(joined, 1)), strict=True):
        x, y = top(i), top(j)
        if x != y:
            group[y] = x
            found.append((int(i), int(j)))
    return found


def _by_label(labels: list) -> tuple[np.ndarray, list[int]]:
    """For each place the first place of its label, as an array and as a list."""
    seen: dict = {}
    first = [seen.setdefault(label, i) for i, label in enumerate(labels)]
    return np.array(first), first


def _across(matches: int):
    """Candidate pairs that connect different families of one or two blocks of a list."""

    def run(batches):
        for parts in _groups(batches, ("token", "left", "right")):
            nodes = _column(parts, "node")
            home, group = _by_label(_column(parts, "family"))
            if len(set(group)) > 1:
                probes = _probes(parts)
                agree = np.zeros((len(nodes), len(nodes)), np.uint8)
                for c in range(COORDINATES):
                    agree += probes[:, None, c] == probes[None, :, c]
                joined = (agree >= matches) & (home[:, None] != home[None, :])
                pairs = _forest_of(joined, group)
                if pairs:
                    yield _pair_batch([(nodes[i], nodes[j]) for i, j in pairs])

    return run


def _linked(sets: list[np.ndarray], roots: list, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs, by place; pairs of one root are passed over."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, item, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    number = np.cumsum(common) - 1
    mine = common[item]
    owner, item, width = owner[mine], number[item[mine]], int(common.sum())
    both = np.zeros((n, n), np.int64)
    step = max(1, MATRIX_CELLS // n)
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    for lo in range(0, width, step):
        a, b = np.searchsorted(item, [lo, lo + step])
        table = np.zeros((n, min(step, width - lo)), np.float32)
        table[owner[a:b], item[a:b] - lo] = 1
        both += (table @ table.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    home, group = _by_label(roots)
    return _forest_of((den * both >= num * union) & (home[:, None] != home[None, :]), group)


def _compare(num: int, den: int):
    """Links inside each block of a sorted stream."""

    def run(batches):
        for parts in _groups(batches, ("family", "left", "right")):
            nodes, roots = _column(parts, "node"), _column(parts, "root")
            if len(set(roots)) > 1:
                sets = [np.frombuffer(x, np.uint64) for x in _column(parts, "items")]
                found = _linked(sets, roots, num, den)
                if found:
                    yield _pair_batch([(nodes[i], nodes[j]) for i, j in found])

    return run


def _within(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links of ``members(family, left, right, node, root, items)``, block by block."""
    order = ["family", "left", "right"]
    dealt = members.repartition(*order).sortWithinPartitions(*order)
    return T.stored(dealt.mapInArrow(_compare(num, den), _PAIRS), "links")


def _family_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """``(node, root)`` for the linked nodes of ``members(node, family, items)``."""
    weight = F.ceil(F.sum(F.octet_length("items")) / BLOCK_BYTES)
    sizes = T.stored(
        members.groupBy("family")
        .agg(F.greatest(F.ceil(F.count("*") / BLOCK), weight).alias("blocks")),
        "sizes",
    )
    placed = members.join(sizes, "family").withColumn("root", F.col("node"))

    def drawn(rows, seed):
        block = F.expr(f"pmod(xxhash64(node, {seed}), blocks)")
        return rows.withColumn("left", block).withColumn("right", F.lit(0).cast("bigint"))

    links = _within(drawn(placed, 1), num, den)
    if sizes.where("blocks > 1").isEmpty():
        return components(links)
    many = placed.where("blocks > 1")
    links = T.stored(links.union(_within(drawn(many, 2), num, den)), "links")
    roots = components(links)
    # Between blocks: a large group has blocks of its own, the small ones share some.
    rooted = (
        many.select("node", "family", "items").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    shape = rooted.groupBy("family", "root").agg(
        F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("items")) / BLOCK_BYTES).alias("size")
    )
    shape = T.stored(shape.withColumn("owner", F.when(F.col("size") >= 1, F.col("root"))), "shape")
    blocks = (
        shape.groupBy("family", "owner").agg(F.ceil(F.sum("size")).cast("int").alias("n"))
        .withColumn("upto", F.sum("n").over(W.partitionBy("family").orderBy("owner")))
        .withColumn("at", (F.col("upto") - F.col("n")).cast("int"))
    )
    blocks = T.stored(blocks.select(F.col("family").alias("f"), F.col("owner").alias("o"), "at", "n"),
                      "blocks")
    repeated = F.expr("inline(array_repeat(struct(at, o), n))")
    owners = blocks.select("f", repeated).groupBy("f").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "o"))), lambda x: x.o).alias("owners")
    )
    spread = rooted.join(shape.select("family", "root", "owner"), ["family", "root"])
    key = F.when(F.col("owner").isNull(), F.col("root")).otherwise(F.col("node"))
    spread = (
        spread.join(blocks, (F.col("family") == F.col("f")) & F.col("owner").eqNullSafe(F.col("o")))
        .withColumn("block", F.col("at") + F.pmod(F.xxhash64(key, F.lit(3)), F.col("n")).cast("int"))
        .drop("f").join(owners, F.col("family") == F.col("f"))
        .withColumn("other", F.explode(F.expr(
            "filter(sequence(0, size(owners) - 1), "
            "o -> owner IS NULL OR owners[o] IS NULL OR owners[o] <> owner)")))
        .select("family", F.least("block", "other").alias("left"),
                F.greatest("block", "other").alias("right"), "node", "root", "items")
    )
    more = _within(spread, num, den)
    tops = components(_by_root(more, roots))
    whole = T.stored(links.union(more), "links")
    ends = whole.select(F.col("a").alias("node")).union(whole.select("b")).distinct()
    return (
        ends.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        .join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        .select("node", F.coalesce("top", "root").alias("root"))
    )


def _families(postings: DataFrame, probe: DataFrame, matches: int) -> DataFrame:
    """``(node, family)``: every candidate pair of nodes is in one family."""
    order = ["token", "chunk"]
    joined = T.stored(
        postings.select(*order, "node", "probe").repartition(*order).sortWithinPartitions(*order)
        .mapInArrow(_forests(matches), _PAIRS).distinct(),
        "forest",
    )
    families = components(joined)
    long = postings.where(f"n > {2 * BLOCK}").select("token", "node")
    if not long.isEmpty():
        placed = long.join(families, "node", "left").select(
            "token", "node", F.coalesce("root", "node").alias("family")
        )
        placed = T.stored(placed, "placed")
        mixed = (
            placed.groupBy("token")
            .agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.count("*").alias("n"))
            .where("lo <> hi").select("token", F.expr(f"int(ceil(n / {BLOCK}))").alias("blocks"))
        )
        spread = (
            placed.join(mixed, "token").join(probe, "node")
            .withColumn("block", F.expr("int(pmod(xxhash64(node, 7), blocks))"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("token", "node", "family", "probe", F.least("block", "other").alias("left"),
                    F.greatest("block", "other").alias("right"))
        )
        order = ["token", "left", "right"]
        dealt = spread.repartition(*order).sortWithinPartitions(*order)
        more = T.stored(dealt.mapInArrow(_across(matches), _PAIRS).distinct(), "forest")
        families = components(joined.union(more))
    return families.withColumnRenamed("root", "family")


def near_duplicates(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, text_hash)`` per row of ``docs(doc_id, text)``.

    Words are runs without white space, A to Z lowered. Two documents are linked
    if ``den * |intersection| >= num * |union|`` of their sets of ``width``-word
    shingles; a component is what links connect, named by its smallest doc_id.

    A null or wordless text has an empty set and is linked with nothing; a text
    with fewer than ``width`` words is one shingle. Repeated rows and equal sets
    are one node (numbered once, when the table of sets is written), so they share a component. A null doc_id takes part, never
    names a component, and is not kept if its component has a name. Other columns
    are ignored. An empty table gives an empty result.
    """
    return _marked(docs, width, num, den).drop("top")


def _marked(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """:func:`near_duplicates` with ``top``, the component's node, null for an empty set."""
    matches = match_threshold(num / den)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = T.stored(
        texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            _sign(width),
            "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, probe binary",
        ),
        "signatures",
    )
    nodes = T.stored(
        signed.where("n_shingles > 0").groupBy("key")
        .agg(F.min("doc_id").alias("first_id"), F.first("probe").alias("probe"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    tokens = nodes.select("node", "probe").mapInArrow(_post, "node bigint, token bigint")
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    # A value that no other set has takes one of the first places of the prefix.
    ranked = (
        tokens.join(shared, "token").groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("list"))
        .where(F.size("list") >= matches)
        .select("node", F.slice("list", F.lit(1), F.size("list") - (matches - 1)).alias("list"))
    )
    probe = nodes.select("node", "probe")
    postings = T.stored(
        ranked.join(probe, "node")
        .select("node", "probe", F.inline("list"))
        .withColumn("chunk", F.expr(f"pmod(xxhash64(node), ceil(n / {2 * BLOCK}))").cast("int")),
        "postings",
    )
    families = T.stored(_families(postings, probe, matches), "families")
    wanted = nodes.join(families, "node").select("key", "node", "family", "first_id")
    homes = wanted.select(F.col("first_id").alias("home"))
    sets = (
        texts.join(homes.distinct(), texts.doc_id.eqNullSafe(F.col("home")), "left_semi")
        .mapInArrow(_full_sets(width), "key binary, items binary")
    )
    # Rows of one doc_id can hold one set twice, or other sets than the wanted one.
    members = sets.join(wanted.drop("first_id"), "key").groupBy("node").agg(
        F.first("family").alias("family"), F.first("items").alias("items")
    )
    roots = _family_links(T.stored(members, "members"), num, den)
    final = (
        nodes.select("key", "node", "first_id").join(roots, "node", "left")
        .select("key", "first_id", F.coalesce("root", "node").alias("top"))
    )
    names = final.groupBy("top").agg(F.min("first_id").alias("name"))
    named = final.join(names, "top").select("key", "name", "top")
    return (
        signed.select("doc_id", "n_shingles", "text_hash", "key").join(named, "key", "left")
        .withColumn("component_id", F.coalesce("name", "doc_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "top")
    )


def _by_root(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between nodes as links between their groups."""
    for side in ("a", "b"):
        named = roots.select(F.col("node").alias(side), F.col("root").alias("r"))
        links = links.join(named, side, "left").withColumn(side, F.coalesce("r", side)).drop("r")
    return links.select("a", "b")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_duplicates`.

    All columns stay as they are. The row is the one with the smallest doc_id, then
    the smallest text hash; a row without doc_id stays only if its component has no
    doc_id at all. A doc_id does not name a row: unrelated texts under one doc_id, or
    without any, all stay. Null and wordless texts are in no component and stay row by
    row.
    """
    wordless = ~F.coalesce(docs.text.rlike(_WORD), F.lit(False))
    # What is kept of a component has one doc_id, or none at all.
    marks = _marked(docs, width, num, den).where("kept AND top IS NOT NULL")
    marks = marks.groupBy("top", "doc_id", "text_hash").count().groupBy("top").agg(
        F.min("doc_id").alias("_kept_id"), F.min("text_hash").alias("_hash"),
        F.min_by("count", "text_hash").alias("_copies"),
    )
    marks = marks.withColumnRenamed("top", "_top")
    same = docs.doc_id.cast("bigint").eqNullSafe(marks._kept_id)
    both = docs.where(~wordless).join(marks, same & (F.xxhash64(docs.text) == marks._hash))
    single = both.where("_copies = 1").select(*docs.columns)
    repeated = both.where("_copies > 1").dropDuplicates(["_top"]).select(*docs.columns)
    return single.unionByName(repeated).unionByName(docs.where(wordless))
