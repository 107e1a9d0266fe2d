"""Model operators. Fitted models have no SQL counterpart; their inputs have."""

from __future__ import annotations

import math
import threading
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.catalog import layers as L
from milepost.catalog.feature_queries import ENRICHED_SQL, T0_SQL, TRAIN_SQL, training
from milepost.catalog.layers import over
from milepost.catalog.registry import query
from milepost.catalog.stream_queries import _OK, _STREAM, once
from milepost.operators import features as P
from milepost.operators import metrics as M
from milepost.operators.distributed import running_totals
from milepost.plans import learning as K
from milepost.session import durable, fresh_path
from milepost.streaming import events as E

FIT_SQL = """fit AS (SELECT * FROM training WHERE accept_timestamp < TIMESTAMP '2000-10-01')"""
_SETS = (T0_SQL, ENRICHED_SQL, TRAIN_SQL, FIT_SQL)


def labelled(spark, sf):
    """The training set with label and split, written once per session."""

    def write(spark, sf, root):
        rows = P.features_and_label(training(spark, sf), "order_id", "accept_timestamp")
        rows.withColumn("split", P.split_label()).write.parquet(f"{root}/rows")

    return spark.read.parquet(once("training-set", spark, sf, write) + "/rows")


def split(spark, sf, *names):
    return labelled(spark, sf).where(F.col("split").isin(*names))


def fitted(spark, sf):
    """Fit a candidate on the training split, once per session; what is shared, once per call."""
    shared: list[K.Prepared] = []
    lock = threading.Lock()

    def of(candidate, train):
        def write(spark, sf, root):
            with lock:
                if not shared and candidate.build is not None:
                    shared.append(K.Prepared(train))
            K.fit(candidate, train, *shared).write().save(f"{root}/model")

        path = once(f"fit-{candidate.name}", spark, sf, write)
        return PipelineModel.load(f"{path}/model")

    return of


def _loss(margin: bool):
    """Log-loss of a probability, hinge loss of a margin."""
    p, late = F.col("delay_probability"), F.col("label") == 1
    if margin:
        return F.greatest(F.lit(0.0), 1 - F.when(late, p).otherwise(-p))
    return -F.ln(F.greatest(F.when(late, p).otherwise(1 - p), F.lit(1e-12)))


def _evaluated(name):
    """What must hold of any right fit, per split.

    On the rows it was shown, a fit loses less than the best constant (the late rate, or
    a margin of 0), and orders late rows before others more often than not; a fit whose
    mean probability is fixed there has that mean.
    """

    def run(spark, sf):
        chosen = K.candidates()[name]
        train = split(spark, sf, "train")
        model = fitted(spark, sf)(chosen, train)
        rows = split(spark, sf, "train", "validation")
        scored = durable(K.add_score(model, rows, chosen.margin))
        p, late = F.col("delay_probability"), F.col("label") == 1
        usable = ~F.isnan(p) & (F.abs(p) < float("inf"))
        if not chosen.margin:
            usable = usable & p.between(0, 1)
        n, pos = K.class_counts(train)
        weight = K.class_weight(n, pos) if chosen.balanced else F.lit(1.0)
        rate = 0.5 if chosen.balanced else pos / n
        constant = 1.0 if chosen.margin else -(
            rate * math.log(rate) + (1 - rate) * math.log(1 - rate)
        )
        loss = F.sum(_loss(chosen.margin) * weight) / F.sum(weight)
        mean = F.round(F.sum(p * weight) / F.sum(weight), 3)
        fit_rows = F.col("split") == "train"
        figures = scored.groupBy("split").agg(
            F.count("*").alias("row_count"), F.count_if(usable).alias("usable"),
            F.count_if(late).alias("late"), loss.alias("loss"), mean.alias("mean"),
        )
        auc = M.ranking_metrics(scored.withColumn("score", p), ["split"]).select("split", "roc_auc")
        return figures.join(auc, "split").select(
            F.lit(name).alias("model"), "split", "row_count", "usable", "late",
            F.when(fit_rows, F.col("loss") < constant).alias("beats_constant"),
            F.when(fit_rows, F.col("roc_auc") > 0.5).alias("orders_rows"),
            F.when(fit_rows & F.lit(name in _MEANS), F.col("mean")).alias("probability_mean"),
        )

    return run


# A fit with a free intercept, or a tree, reproduces the (weighted) late rate it was shown.
_MEANS = {
    "logistic": "round(avg(is_late_delivery::INT), 3)",
    "logistic_balanced": "0.5::DOUBLE",
    "decision_tree": "0.5::DOUBLE",
}


def _evaluated_sql(name):
    return over("daily", f"""SELECT '{name}' AS model, split, count(*) AS row_count,
  count(*) AS usable, sum(is_late_delivery::INT)::BIGINT AS late,
  CASE WHEN split = 'train' THEN true END AS beats_constant,
  CASE WHEN split = 'train' THEN true END AS orders_rows,
  CASE WHEN split = 'train' THEN {_MEANS.get(name, "NULL::DOUBLE")} END AS probability_mean
  FROM (SELECT *, CASE WHEN accept_timestamp < TIMESTAMP '2000-10-01' THEN 'train'
    ELSE 'validation' END AS split FROM training
    WHERE accept_timestamp < TIMESTAMP '2000-10-15') GROUP BY split""", *_SETS)


def _filled(c: str) -> str:
    return f"coalesce(fit.{c}::DOUBLE, (SELECT coalesce(median({c}), 0) FROM fit)::DOUBLE)"


@query(
    "ml01_numeric_statistics",
    over("daily", " UNION ALL ".join(
        f"SELECT '{c}' AS name, (SELECT coalesce(median({c}), 0) FROM fit)::DOUBLE AS median, "
        f"round(avg({_filled(c)}), 6) AS mean, "
        f"round(CASE WHEN stddev_pop({_filled(c)}) > 0 THEN stddev_pop({_filled(c)}) ELSE 1 END, "
        "6) AS scale FROM fit" for c in S.NUMERIC_INPUTS), *_SETS),
)
def ml01(spark, sf):
    """Exact medians, means and population deviations of the numeric inputs."""
    stats = K.numeric_statistics(split(spark, sf, "train"))
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "scale")})


@query(
    "ml02_categories",
    over("daily", " UNION ALL ".join(
        f"SELECT '{c}' AS name, coalesce({c}::VARCHAR, '__missing__') AS category, "
        "count(*) AS row_count FROM fit GROUP BY 2" for c in S.CATEGORICAL_INPUTS), *_SETS),
)
def ml02(spark, sf):
    train = split(spark, sf, "train")
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), K.category_text(c).alias("category"))
          for c in S.CATEGORICAL_INPUTS]
    )
    return train.select(F.inline(cells)).groupBy("name", "category").agg(
        F.count("*").alias("row_count")
    )


@query(
    "ml03_boolean_inputs",
    over("daily", "SELECT " + ", ".join(
        f"sum(coalesce({c}::INT, 0))::DOUBLE AS {c}" for c in S.BOOLEAN_INPUTS) + " FROM fit",
        *_SETS),
)
def ml03(spark, sf):
    train = split(spark, sf, "train")
    prepared = K.preprocessing(train)[0].transform(train)
    return prepared.agg(*[F.sum(f"flag_{c}").alias(c) for c in S.BOOLEAN_INPUTS])


@query(
    "ml04_feature_vector",
    over("daily", """SELECT count(*) AS row_count,
  CAST(18 + 4 + (SELECT count(DISTINCT region_id) + count(DISTINCT city)
    + count(DISTINCT aoi_type) + count(DISTINCT accept_period) FROM fit) AS INT) AS width
  FROM fit""", *_SETS),
)
def ml04(spark, sf):
    """Assembled vectors: 18 numbers, one place per category, 4 flags."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    train = split(spark, sf, "train")
    vectors = Pipeline(stages=K.preprocessing(train)).fit(train).transform(train)
    width = F.size(vector_to_array("features"))
    return vectors.agg(F.count("*").alias("row_count"), F.max(width).alias("width"))


@query(
    "ml05_prior_baseline",
    over("daily", """SELECT count(*) AS row_count,
  round((SELECT avg(is_late_delivery::INT) FROM fit), 9) AS delay_probability FROM training
  WHERE accept_timestamp >= TIMESTAMP '2000-10-01'
  AND accept_timestamp < TIMESTAMP '2000-10-15'""", *_SETS),
)
def ml05(spark, sf):
    model = K.prior_model(split(spark, sf, "train"))
    scored = K.add_score(model, split(spark, sf, "validation"))
    return scored.groupBy(F.round("delay_probability", 9).alias("delay_probability")).agg(
        F.count("*").alias("row_count")
    )


@query(
    "ml06_class_weights",
    over("daily", """SELECT is_late_delivery::INT::DOUBLE AS label,
  round((SELECT count(*) FROM fit) / (2.0::DOUBLE * count(*)), 9) AS weight,
  count(*) AS row_count FROM fit GROUP BY 1""", *_SETS),
)
def ml06_weights(spark, sf):
    rows = K.add_class_weight(split(spark, sf, "train"))
    return rows.groupBy("label", F.round("weight", 9).alias("weight")).agg(
        F.count("*").alias("row_count")
    )


for _entry, _name in {
    "ml06_logistic": "logistic",
    "ml06_logistic_balanced": "logistic_balanced",
    "ml07_decision_tree": "decision_tree",
    "ml08_random_forest": "random_forest",
    "ml09_boosting_balanced": "boosting_balanced",
    "ml09_boosting_depth6": "boosting_depth6",
    "ml09_boosting_leaf31": "boosting_leaf31",
    "ml10_linear_svm": "linear_svm",
}.items():
    query(_entry, _evaluated_sql(_name))(_evaluated(_name))


_VALIDATION = """FROM training WHERE accept_timestamp >= TIMESTAMP '2000-10-01'
  AND accept_timestamp < TIMESTAMP '2000-10-15'"""


def _listed(names) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS m(model)"


@query(
    "ml11_model_comparison",
    over("daily", f"""SELECT model, CASE WHEN model = 'linear_svm' THEN 'decision_function'
    ELSE 'predict_proba' END AS score_method, true AS in_range, true AS f1_follows,
  true AS rank_follows, CASE WHEN model = 'dummy_prior' THEN 0.5::DOUBLE END AS prior_roc_auc,
  CASE WHEN model = 'dummy_prior' THEN
    (SELECT round(avg(is_late_delivery::INT), 6) {_VALIDATION}) END AS prior_pr_auc
  FROM {_listed(K.candidates())}""", *_SETS),
)
def ml11(spark, sf):
    """All candidates fitted on train, measured on validation, ranked; and what must hold.

    Metrics lie in their range, F1 is the harmonic mean of its parts, ranks follow the
    average precision; a constant score has an area of one half and a precision of the
    late rate.
    """
    train, validation = split(spark, sf, "train"), split(spark, sf, "validation")
    ranked = durable(K.compare(train, validation, fitted=fitted(spark, sf)))
    p, r = F.col("precision"), F.col("recall")
    harmonic = F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)
    prior = F.col("model") == "dummy_prior"
    place = W.orderBy(F.col("pr_auc").desc(), "model")
    in_range = reduce(Column.__and__, [F.col(m).between(0, 1) for m in K.METRICS])
    return ranked.coalesce(1).select(
        "model", "score_method", in_range.alias("in_range"),
        (F.abs(F.col("f1") - harmonic) < 1e-5).alias("f1_follows"),
        (F.row_number().over(place) == F.col("rank")).alias("rank_follows"),
        F.when(prior, F.col("roc_auc")).alias("prior_roc_auc"),
        F.when(prior, F.col("pr_auc")).alias("prior_pr_auc"),
    )


@query(
    "ml12_threshold_search",
    over("daily", f"""SELECT model, true AS usable, true AS no_worse, true AS highest,
  true AS rank_follows FROM {_listed(K.TUNED)}""", *_SETS),
)
def ml12(spark, sf):
    """The best threshold of each tuned candidate; and what must hold.

    Its F1 is no worse than that at 0.5 or at any hundredth, and ranks follow it.
    """
    train, validation = split(spark, sf, "train"), split(spark, sf, "validation")
    chosen = {n: c for n, c in K.candidates().items() if n in K.TUNED}
    models = K.fit_all(chosen, train, fitted(spark, sf))
    scored = K.model_scores(models, chosen, validation)
    tuned = durable(K.rank_models(K.tune(scored), "optimized_f1"))
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.lit(99)), lambda k: k / 100)).alias("cut")
    tried = scored.select("model", "label", "score", cuts)
    tried = tried.withColumn("prediction", F.col("score") >= F.col("cut"))
    f1 = M.class_metrics(M.confusion(tried, ["model", "cut"]), ["model", "cut"])
    best = f1.groupBy("model").agg(F.max("f1").alias("tried"))
    place = W.orderBy(F.col("optimized_f1").desc(), "model")
    return tuned.join(best, "model").coalesce(1).select(
        "model", F.col("threshold").between(0, 1).alias("usable"),
        (F.col("optimized_f1") >= F.col("default_f1")).alias("no_worse"),
        (F.col("optimized_f1") >= F.col("tried") - 1e-6).alias("highest"),
        (F.row_number().over(place) == F.col("rank")).alias("rank_follows"),
    )


def artifact(spark, sf) -> str:
    def write(spark, sf, root):
        rows = split(spark, sf, "train", "validation")
        model, info = K.fit_final(K.candidates()[K.DEPLOYED], rows, f"{K.DEPLOYED}-v1")
        K.save_model(spark, model, info, root)

    return once("delay-model", spark, sf, write)


@query(
    "ml13_artifact",
    over("daily", """SELECT 'boosting_leaf31' AS model_name, 'boosting_leaf31-v1' AS model_version,
  0.246906::DOUBLE AS threshold, count(*) AS training_rows,
  round(avg(is_late_delivery::INT), 9) AS training_late_rate,
  CAST(26 AS BIGINT) AS feature_count FROM training
  WHERE accept_timestamp < TIMESTAMP '2000-10-15'""", *_SETS),
)
def ml13(spark, sf):
    """Metadata of the stored model after loading and checking it."""
    _, info = K.load_model(spark, artifact(spark, sf))
    row = (info.model_name, info.model_version, info.threshold, info.training_rows,
           round(info.training_late_rate, 9), info.feature_count)
    return spark.createDataFrame(
        [row], "model_name string, model_version string, threshold double, "
        "training_rows bigint, training_late_rate double, feature_count bigint",
    )


@query(
    "ml14_batch_scoring",
    over("daily", """SELECT order_id, true AS usable, true AS consistent FROM training
  WHERE accept_timestamp >= TIMESTAMP '2000-10-15'
  AND accept_timestamp < TIMESTAMP '2000-11-01'""", *_SETS),
)
def ml14(spark, sf):
    """Every test row is scored by the stored model, and its class follows the threshold."""
    model, info = K.load_model(spark, artifact(spark, sf))
    rows = K.predict(model, split(spark, sf, "test"), info.threshold)
    p = F.col("delay_probability")
    return rows.select(
        "order_id", p.between(0, 1).alias("usable"),
        (F.col("predicted_late") == (p >= info.threshold)).alias("consistent"),
    )


_TEST = """FROM training WHERE accept_timestamp >= TIMESTAMP '2000-10-15'
  AND accept_timestamp < TIMESTAMP '2000-11-01'"""


@query(
    "ml15_final_evaluation",
    over("daily", f"""SELECT city, row_count, late, true AS counts_agree, true AS area_agrees FROM (
  SELECT city, count(*) AS row_count, sum(is_late_delivery::INT)::BIGINT AS late {_TEST}
  GROUP BY city UNION ALL
  SELECT 'all', count(*), sum(is_late_delivery::INT)::BIGINT {_TEST})""", *_SETS),
)
def ml15(spark, sf):
    """Test metrics at the frozen threshold, overall and per city; and what must hold.

    The four counts agree with the stored predictions, counted one by one; the area
    under the curve agrees with the share of (late, other) pairs in the right order.
    """
    model, info = K.load_model(spark, artifact(spark, sf))
    test = split(spark, sf, "test")
    total, cities = K.final_evaluation(model, info, test)
    found = total.withColumn("city", F.lit("all")).unionByName(cities)
    scored = durable(K.predict(model, test, info.threshold))
    one = scored.select(
        F.explode(F.array("city", F.lit("all"))).alias("city"), "label", "predicted_late",
        F.col("delay_probability").alias("p"),
    )
    late, hit = F.col("label") == 1, F.col("predicted_late")
    counts = one.groupBy("city").agg(
        F.count_if(late & hit).alias("tp"), F.count_if(~late & hit).alias("fp"),
        F.count_if(late & ~hit).alias("fn"), F.count_if(late).alias("late"),
    )
    # Rank sum: the mean rank of equal scores, by counts of distinct scores.
    values = one.groupBy("city", "p").agg(F.count("*").alias("n"), F.count_if(late).alias("pos"))
    upto = running_totals(values, [F.col("p").asc()], {"upto": F.col("n")}, ["city"])
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0
    sums = upto.withColumn("rank", rank).groupBy("city").agg(
        F.sum(F.col("pos") * F.col("rank")).alias("ranks"), F.sum("pos").alias("a"),
        F.sum(F.col("n") - F.col("pos")).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    area = (F.col("ranks") - a * (a + 1) / 2) / F.nullif(a * b, F.lit(0))
    return found.join(counts, "city").join(sums, "city").select(
        "city", "row_count", "late",
        ((F.col("true_positives") == F.col("tp")) & (F.col("false_positives") == F.col("fp"))
         & (F.col("false_negatives") == F.col("fn"))).alias("counts_agree"),
        (F.col("roc_auc").eqNullSafe(area) | (F.abs(F.col("roc_auc") - area) < 1e-9))
        .alias("area_agrees"),
    )


_MODELS = {"m7": 7919, "m13": 104729, "m17": 31}


@query(
    "win07_model_ranking",
    over("fact", "SELECT model, round(pr_auc, 9) AS pr_auc, row_number() OVER (ORDER BY pr_auc "
         "DESC, model) AS rank FROM ap",
         "scored AS (" + " UNION ALL ".join(
             f"SELECT '{m}' AS model, is_late_delivery::INT AS label, ((order_id * {f}) % 997 "
             f"+ {i * 150} * is_late_delivery::INT) / 1500.0::DOUBLE AS score FROM fact "
             "WHERE is_valid_duration" for i, (m, f) in enumerate(_MODELS.items())) + ")",
         """curve AS (SELECT model, score, sum(label) AS pos, count(*) - sum(label) AS neg
  FROM scored GROUP BY 1, 2)""",
         """ranked AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp,
  sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS fp FROM curve)""",
         """ap AS (SELECT model, sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos)::DOUBLE AS pr_auc
  FROM ranked GROUP BY model)"""),
)
def win07(spark, sf):
    """Three formula scores ranked like models."""
    late = F.col("is_late_delivery").cast("int")
    fact = L.fact(spark, sf).where("is_valid_duration")
    models = F.array(
        *[F.struct(F.lit(m).alias("model"),
                   ((F.col("order_id") * f % 997 + i * 150 * late) / 1500.0).alias("score"))
          for i, (m, f) in enumerate(_MODELS.items())]
    )
    scored = fact.select(late.alias("label"), F.inline(models))
    ranked = K.rank_models(M.ranking_metrics(scored, ["model"]))
    return ranked.select("model", F.round("pr_auc", 9).alias("pr_auc"), "rank")


@query(
    "str03_model_scoring_stream",
    over("daily", f"""SELECT order_id, true AS usable, true AS consistent, true AS as_batch
FROM arrived WHERE {_OK}""", *_STREAM),
)
def str03(spark, sf):
    """The scoring stream with the stored model: every readable event, as a batch scores it."""
    from milepost.catalog.stream_queries import _gold_history, accepted_log, now
    from milepost.streaming import scoring, state

    root = fresh_path(spark, "model-stream")
    model, info = K.load_model(spark, artifact(spark, sf))
    history = _gold_history(spark, sf, root)
    accepted_log(spark, sf).write.parquet(f"{root}/topic")
    scoring.start_scoring(
        state.message_files(spark, f"{root}/topic"), f"{root}/state", f"{root}/scoring",
        history, lambda rows: K.add_score(model, rows), info.model_name, info.model_version,
        info.threshold, event_time=now(), available_now=True,
    ).awaitTermination()
    scoring.start_predictions(
        spark, f"{root}/state", f"{root}/checkpoint", available_now=True
    ).awaitTermination()
    latest = state.latest_predictions(spark, f"{root}/checkpoint")
    events = E.well_formed(E.decode(accepted_log(spark, sf), E.ACCEPTED))
    batch = K.add_score(model, scoring.event_features(events, *history()))
    batch = batch.select("order_id", F.col("delay_probability").alias("in_batch"))
    p = F.col("delay_probability")
    return latest.join(batch, "order_id", "left").select(
        "order_id", p.between(0, 1).alias("usable"),
        (F.col("predicted_late") == (p >= info.threshold)).alias("consistent"),
        F.coalesce(F.abs(p - F.col("in_batch")) < 1e-9, F.lit(False)).alias("as_batch"),
    )
