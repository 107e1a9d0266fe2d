"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree of domain, language and source by weights. A node
gets no more than its leaves can give; what it cannot take goes to its siblings in
proportion to their weights, and only what all of them cannot take stays with the
ancestors. A leaf gives whole seeded epochs and then a prefix of the next one.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from milepost.llm.text import stored
from milepost.operators.distributed import running_totals

LEVELS = ("domain", "lang", "source")
WEIGHTS: Mapping[str, Mapping[str, int]] = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "es": 2, "fr": 2},
    "source": {},
}
SEED = 17


def domain_of(source: Column) -> Column:
    """Four domains, by the number in a source's name; ``other`` without a number."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("bigint") % 4).cast("string"))
                  ).otherwise("other")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("bigint")


def _fill(nodes: DataFrame, above: Sequence[str], level: str) -> DataFrame:
    """Share ``budget`` of each parent among its children: ``(w, cap)`` to ``given``.

    Children in order of ``cap / w`` are full as long as their part of what is left,
    among the weights that are left, reaches their cap; the rest share by weight.
    """
    parent = list(above) or [F.lit(0)]
    order = [(F.col("cap") / F.col("w")).asc(), F.col(level).asc()]
    upto = W.partitionBy(*parent).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rest = W.partitionBy(*parent).orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    all_of = W.partitionBy(*parent)
    before = F.coalesce(F.sum("cap").over(upto), F.lit(0))
    full = (F.col("budget") - before) * F.col("w") >= F.col("cap") * F.sum("w").over(rest)
    return (
        nodes.withColumn("full", full)
        .withColumn("taken", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_of))
        .withColumn("weights", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(all_of))
        .withColumn("given", F.expr(
            "CASE WHEN full THEN cap ELSE ((budget - taken) * w) div weights END"))
        .drop("full", "taken", "weights")
    )


def leaf_budgets(
    leaves: DataFrame,
    budget: Column,
    epochs: int,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """Add ``given`` to ``leaves(*levels, tokens)``: how many tokens each leaf is to give.

    ``budget`` is an aggregate of ``tokens``. Sums stay exact while budget times the
    weights of siblings is below 2**63.
    """
    whole = leaves.agg(budget.cast("bigint").alias("given"))
    above: DataFrame = whole
    for k, level in enumerate(levels):
        keys, parents = list(levels[: k + 1]), list(levels[:k])
        nodes = leaves.groupBy(*keys).agg((F.sum("tokens") * epochs).alias("cap"))
        nodes = nodes.withColumn("w", _weight(level, weights))
        up = above.withColumnRenamed("given", "budget")
        # The root has one row.
        nodes = nodes.join(up, parents) if parents else nodes.join(F.broadcast(up))
        nodes = _fill(nodes, parents, level)
        above = nodes.select(*keys, "given")
    return leaves.join(above, list(levels))


def select(
    docs: DataFrame,
    share: tuple[int, int] = (3, 5),
    epochs: int = 2,
    seed: int = SEED,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
) -> DataFrame:
    """``docs`` with ``_domain``, ``_tokens`` and ``_epoch``: one row per chosen document and epoch.

    The budget is ``share`` of all tokens (words). Each epoch of a leaf is an order
    by a seeded hash of the epoch and the doc_id; a leaf gives as many whole epochs
    as its budget holds, ``epochs`` at most, and of the next one the documents that
    start before the budget is used up. Equal doc_ids of a leaf come and go
    together. Null text has no tokens; a null language or source is the name ''; a
    null doc_id is one id. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    keys = [f"_{level}" for level in LEVELS]
    rows = docs.select(
        "*", domain_of(F.coalesce("source", F.lit(""))).alias("_domain"),
        F.coalesce("lang", F.lit("")).alias("_lang"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("_tokens"),
    )
    sizes = stored(
        rows.select(*[F.col(k).alias(n) for k, n in zip(keys, LEVELS, strict=True)],
                    F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                    F.col("_tokens").alias("tokens")),
        "sizes",
    )
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budget = F.expr(f"sum(tokens) * {share[0]} div {share[1]}")
    given = leaf_budgets(leaves, budget, epochs, weights).where("tokens > 0")
    plan = stored(
        given.select(*LEVELS, F.expr("given div tokens").alias("epochs"),
                     F.expr("given % tokens").alias("rest")),
        "plan",
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("id")))
    ordered = (
        sizes.join(plan.where("rest > 0"), list(LEVELS)).withColumn("ord", order)
        .groupBy(*LEVELS, "ord").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    )
    upto = running_totals(ordered, [F.col("ord")], {"upto": F.col("tokens")}, list(LEVELS))
    ends = upto.where("upto - tokens < rest").groupBy(*LEVELS).agg(F.max("ord").alias("last"))
    # Written, so that Spark knows how small it is and need not shuffle the documents.
    plan = stored(
        plan.join(ends, list(LEVELS), "left").select(
            *[F.col(n).alias(k) for k, n in zip(keys, LEVELS, strict=True)],
            F.col("epochs").alias("_epochs"), F.col("last").alias("_last"),
        ),
        "shares",
    )
    own = F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.col("_epochs").cast("string"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    times = F.col("_epochs") + F.when(own <= F.col("_last"), 1).otherwise(0)
    return (
        rows.join(plan, keys).withColumn("_times", times).where("_times > 0")
        .withColumn("_epoch", F.explode(F.expr("sequence(0, int(_times) - 1)")))
        .select(*docs.columns, "_domain", "_tokens", "_epoch")
    )


def report(docs: DataFrame, share: tuple[int, int] = (3, 5), epochs: int = 2) -> DataFrame:
    """``(doc_id, domain, lang, source, tokens, epoch)`` of :func:`select`."""
    rows = select(docs.select("doc_id", "text", "lang", "source"), share, epochs)
    return rows.select(
        "doc_id", F.col("_domain").alias("domain"), "lang", "source",
        F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"),
    )


def mixed(docs: DataFrame, share: tuple[int, int] = (3, 5), epochs: int = 1) -> DataFrame:
    """The chosen documents with their own columns, once per epoch."""
    return select(docs, share, epochs).select(*docs.columns)


def oracle(share: tuple[int, int] = (3, 5), epochs: int = 2, seed: int = SEED) -> str:
    """The report as SQL."""

    def case(level):
        rows = "".join(f" WHEN '{n}' THEN {w}" for n, w in WEIGHTS[level].items())
        return f"CASE {level}{rows} ELSE 1 END" if rows else "1"

    def fill(name, above, level, parents):
        keys = ", ".join([*parents, level])
        part = f"PARTITION BY {', '.join(parents)}" if parents else ""
        join = f"JOIN {above} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above}"
        return f"""
        {name}_n AS (
            SELECT {keys}, sum(tokens)::BIGINT * {epochs} AS cap, {case(level)}::BIGINT AS w
            FROM leaves GROUP BY {keys}),
        {name}_f AS (
            SELECT n.*, given AS budget, (given - coalesce(sum(cap) OVER (
                    {part} ORDER BY cap / w, {level}
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w >= cap * sum(w) OVER (
                    {part} ORDER BY cap / w, {level}
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_up
            FROM {name}_n n {join}),
        {name} AS (
            SELECT {keys}, (CASE WHEN full_up THEN cap ELSE
                ((budget - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ({part})) * w)
                // sum(CASE WHEN full_up THEN 0 ELSE w END) OVER ({part}) END)::BIGINT AS given
            FROM {name}_f)"""

    keys = "domain, lang, source"
    return f"""
    WITH d AS (
        SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang,
               coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, '') AS id,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
               CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> ''
                    THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4)
                    ELSE 'other' END AS domain
        FROM documents),
    leaves AS (SELECT {keys}, sum(tokens)::BIGINT AS tokens FROM d GROUP BY {keys}),
    root AS (SELECT (sum(tokens)::BIGINT * {share[0]}) // {share[1]} AS given FROM leaves),
    {fill("a", "root", "domain", [])},
    {fill("b", "a", "lang", ["domain"])},
    {fill("c", "b", "source", ["domain", "lang"])},
    plan AS (
        SELECT {keys}, given // tokens AS epochs, given % tokens AS rest
        FROM c JOIN leaves USING ({keys}) WHERE tokens > 0),
    o AS (
        SELECT d.*, epochs, rest, md5('{seed}:' || epochs || ':' || id) AS ord
        FROM d JOIN plan USING ({keys})),
    g AS (
        SELECT {keys}, ord, sum(tokens) AS tokens, any_value(rest) AS rest FROM o
        GROUP BY {keys}, ord),
    u AS (SELECT *, sum(tokens) OVER (PARTITION BY {keys} ORDER BY ord) - tokens AS pre FROM g),
    e AS (SELECT {keys}, max(ord) AS last FROM u WHERE pre < rest GROUP BY {keys}),
    t AS (
        SELECT o.*, (epochs + CASE WHEN ord <= last THEN 1 ELSE 0 END)::BIGINT AS times
        FROM o LEFT JOIN e USING ({keys}))
    SELECT doc_id, domain, lang0 AS lang, source0 AS source, tokens,
           unnest(range(times))::INTEGER AS epoch
    FROM t WHERE times > 0
    """
