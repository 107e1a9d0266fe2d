"""Delay models on ``pyspark.ml``: preprocessing, candidates, comparison, artifact.

All fitted values of the preprocessing are constants of a ``SQLTransformer``, so
a model is one ordinary ``PipelineModel`` that can be saved, loaded and applied
to tables and micro-batches.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from milepost import schemas as S
from milepost.operators import metrics as M
from milepost.operators.distributed import exact_medians
from milepost.plans.svm import RoundedHingeSVC
from milepost.session import durable, fresh_path

SEED = 42
# The candidates whose threshold is searched, and the one that is deployed.
TUNED = ("random_forest", "boosting_balanced", "boosting_depth6", "boosting_leaf31")
DEPLOYED = "boosting_leaf31"
MISSING = "__missing__"
#: Boosting with held-out rows ends at the first round that lowers their loss by less than this
#: part of it.
STOP_TOLERANCE = 1e-4
#: Rows of one task when a small table of vectors is dealt out.
PART_ROWS = 8192


# -- preprocessing ----------------------------------------------------------------------------
def numeric_statistics(train: DataFrame) -> DataFrame:
    """``(name, median, mean, scale)`` of every numeric input.

    Missing values count as the median (0 for a column without values); the
    scale is the population deviation, 1 for a constant column.
    """
    medians = {
        r["name"]: r["median"] if r["median"] is not None else 0.0
        for r in exact_medians(train, S.NUMERIC_INPUTS).collect()
    }
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in S.NUMERIC_INPUTS}
    wide = train.agg(
        *[F.avg(x).alias(f"mean_{c}") for c, x in filled.items()],
        *[F.stddev_pop(x).alias(f"scale_{c}") for c, x in filled.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.lit(medians[c]).alias("median"),
                F.col(f"mean_{c}").alias("mean"),
                F.when(F.col(f"scale_{c}") > 0, F.col(f"scale_{c}")).otherwise(1.0)
                .alias("scale"),
            )
            for c in S.NUMERIC_INPUTS
        ]
    )
    return wide.select(F.inline(rows))


def category_text(name: str):
    """A category as text, with its own value for missing."""
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def _columns(stats: Mapping[str, Row], scale_numeric: bool) -> SQLTransformer:
    """Numbers filled and scaled, categories as text, flags as numbers."""

    def numeric(c):
        s = stats[c]
        filled = f"coalesce(cast({c} AS double), {s['median']!r}D)"
        return f"({filled} - {s['mean']!r}D) / {s['scale']!r}D" if scale_numeric else filled

    columns = [f"{numeric(c)} AS num_{c}" for c in S.NUMERIC_INPUTS]
    columns += [
        f"coalesce(cast({c} AS string), '{MISSING}') AS cat_{c}" for c in S.CATEGORICAL_INPUTS
    ]
    columns += [f"coalesce(cast({c} AS double), 0.0D) AS flag_{c}" for c in S.BOOLEAN_INPUTS]
    return SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")


def _vector_stages() -> list:
    texts = [f"cat_{c}" for c in S.CATEGORICAL_INPUTS]
    index = StringIndexer(
        inputCols=texts, outputCols=[f"idx_{c}" for c in texts], handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    # The kept extra index stands for unknown categories; dropping it gives them zeros.
    one_hot = OneHotEncoder(
        inputCols=index.getOutputCols(), outputCols=[f"vec_{c}" for c in texts], dropLast=True
    )
    assembled = VectorAssembler(
        inputCols=[f"num_{c}" for c in S.NUMERIC_INPUTS] + one_hot.getOutputCols()
        + [f"flag_{c}" for c in S.BOOLEAN_INPUTS],
        outputCol="features",
    )
    return [index, one_hot, assembled]


def preprocessing(train: DataFrame, scale_numeric: bool = True) -> list:
    """Stages that turn the 26 inputs into one sparse ``features`` vector."""
    stats = {r["name"]: r for r in numeric_statistics(train).collect()}
    return [_columns(stats, scale_numeric), *_vector_stages()]


def class_counts(train: DataFrame) -> tuple[int, int]:
    row = train.agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("pos")).first()
    return row["n"], row["pos"] or 0


def class_weight(n: int, late: int) -> Column:
    """``n / (2 * n_class)`` per row, so that both classes weigh the same."""
    if not 0 < late < n:
        raise ValueError("both classes are needed")
    return F.when(F.col("label") == 1, n / (2.0 * late)).otherwise(n / (2.0 * (n - late)))


def add_class_weight(train: DataFrame) -> DataFrame:
    return train.withColumn("weight", class_weight(*class_counts(train)))


class Prepared:
    """What all candidates share: statistics, encoders, and the training rows as vectors.

    Statistics and encoders are fitted once. The vectors, scaled and unscaled, are cached
    when first asked for; a small table is dealt over no more tasks than its rows need.
    :meth:`release` frees them. May be used by several threads.
    """

    def __init__(self, train: DataFrame):
        self._train = train
        self.rows, self.late = class_counts(train)
        stats = {r["name"]: r for r in numeric_statistics(train).collect()}
        encoders = Pipeline(stages=[_columns(stats, False), *_vector_stages()]).fit(train).stages[1:]
        self._stages = {k: [_columns(stats, k), *encoders] for k in (False, True)}
        self._vectors: dict[bool, DataFrame] = {}
        self._lock = threading.Lock()

    def stages(self, scale_numeric: bool) -> list:
        return self._stages[scale_numeric]

    def vectors(self, scale_numeric: bool) -> DataFrame:
        """``label, weight, held_out, features``; a tenth of the rows is held out."""
        with self._lock:
            if scale_numeric not in self._vectors:
                both = 0 < self.late < self.rows
                weight = class_weight(self.rows, self.late) if both else F.lit(1.0)
                tenth = F.pmod(F.xxhash64(*S.MODEL_INPUTS, F.lit(SEED)), F.lit(10)) == 0
                rows = self._train.withColumns({"weight": weight, "held_out": tenth})
                made = PipelineModel(self.stages(scale_numeric)).transform(rows)
                made = made.select("label", "weight", "held_out", "features")
                cores = self._train.sparkSession.sparkContext.defaultParallelism
                if self.rows <= cores * PART_ROWS:
                    made = made.repartition(-(-self.rows // PART_ROWS))
                self._vectors[scale_numeric] = made.persist()
            return self._vectors[scale_numeric]

    def release(self) -> None:
        for df in self._vectors.values():
            df.unpersist()
        self._vectors.clear()


# -- candidates ------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Candidate:
    """A classifier and how it is fed and scored."""

    name: str
    build: Callable[[int], object] | None
    balanced: bool = False
    scale_numeric: bool = True
    margin: bool = False
    #: Its trees do not wait for each other, so a small table is worth all cores.
    spread: bool = False


Fit = Callable[[Candidate, DataFrame], PipelineModel]


def _common(balanced: bool) -> dict:
    return {"featuresCol": "features", "labelCol": "label",
            **({"weightCol": "weight"} if balanced else {})}


def _logistic(balanced: bool):
    # An L2 strength of 1 summed over the rows is 1/n in Spark's averaged loss.
    return lambda n: LogisticRegression(
        maxIter=500, regParam=1.0 / n, standardization=False, **_common(balanced)
    )


def _boosting(
    rounds: int, step: float, depth: int, leaf: int, share: float, balanced: bool,
    stop_early: bool = False,
):
    """Boosted trees; ``stop_early`` ends them when the held-out loss no longer falls."""
    stopping = {"validationIndicatorCol": "held_out", "validationTol": STOP_TOLERANCE}
    return lambda n: GBTClassifier(
        maxIter=rounds, stepSize=step, maxDepth=depth, minInstancesPerNode=leaf,
        subsamplingRate=share, seed=SEED, **_common(balanced), **(stopping if stop_early else {}),
    )


def candidates() -> dict[str, Candidate]:
    """The nine candidates.

    Spark has one boosted-tree learner, so the three boosted candidates are that
    learner with three settings.
    """
    # Ensemble sizes, depths, leaf sizes, rates and iteration limits.
    found = [
        Candidate("dummy_prior", None),
        Candidate("logistic", _logistic(False)),
        Candidate("logistic_balanced", _logistic(True), balanced=True),
        Candidate(
            "decision_tree",
            lambda n: DecisionTreeClassifier(
                maxDepth=16, minInstancesPerNode=20, seed=SEED, **_common(True)
            ),
            balanced=True, scale_numeric=False,
        ),
        Candidate(
            "random_forest",
            lambda n: RandomForestClassifier(
                numTrees=150, maxDepth=18, minInstancesPerNode=5, seed=SEED,
                featureSubsetStrategy="sqrt", **_common(True),
            ),
            balanced=True, scale_numeric=False, spread=True,
        ),
        Candidate("boosting_balanced", _boosting(150, 0.08, 5, 20, 1.0, True, True),
                  balanced=True, scale_numeric=False),
        Candidate("boosting_depth6", _boosting(250, 0.05, 6, 5, 0.9, False),
                  scale_numeric=False),
        Candidate("boosting_leaf31", _boosting(250, 0.05, 5, 20, 0.9, False),
                  scale_numeric=False),
        Candidate(
            "linear_svm",
            lambda n: RoundedHingeSVC(maxIter=5000, regParam=1.0 / n, **_common(True)),
            balanced=True, margin=True,
        ),
    ]
    return {c.name: c for c in found}


def prior_model(train: DataFrame) -> PipelineModel:
    """Every row gets the late rate of the training rows."""
    n, pos = class_counts(train)
    if n == 0:
        raise ValueError("no training rows")
    rate = pos / n
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, array({1.0 - rate!r}D, {rate!r}D) AS probability "
                                 "FROM __THIS__")
    ])


def fit(candidate: Candidate, train: DataFrame, prepared: Prepared | None = None) -> PipelineModel:
    """Fit preprocessing and classifier on rows with the 26 inputs and ``label``.

    ``prepared`` is shared between candidates that are fitted on the same rows.
    """
    if candidate.build is None:
        return prior_model(train)
    own = prepared or Prepared(train)
    try:
        if candidate.balanced and not 0 < own.late < own.rows:
            raise ValueError("both classes are needed")
        rows = own.vectors(candidate.scale_numeric)
        cores = train.sparkSession.sparkContext.defaultParallelism
        if candidate.spread and rows.rdd.getNumPartitions() < cores:
            rows = rows.repartition(cores)
        classifier = candidate.build(own.rows).fit(rows)
    finally:
        if prepared is None:
            own.release()
    # A freshly fitted classifier carries a summary over its training rows into
    # every task that scores; the stored form holds the model alone.
    path = fresh_path(train.sparkSession, "fitted")
    PipelineModel([*own.stages(candidate.scale_numeric), classifier]).write().save(path)
    return PipelineModel.load(path)


def fit_all(
    chosen: Mapping[str, Candidate], train: DataFrame, fitted: Fit | None = None,
    parallelism: int = 6,
) -> dict[str, PipelineModel]:
    """Fit candidates side by side: a fit is a chain of small jobs that leaves cores idle.

    Ensembles stand last in the list of candidates and take longest, so they start first.
    """
    prepared = None if fitted else Prepared(train)
    one = fitted or (lambda candidate, rows: fit(candidate, rows, prepared))
    with ThreadPoolExecutor(parallelism) as pool:
        run = inheritable_thread_target(train.sparkSession)(lambda c: one(c, train))
        names = list(reversed(chosen))
        models = dict(zip(names, pool.map(run, [chosen[n] for n in names]), strict=True))
    if prepared:
        prepared.release()
    return models


def add_score(model: PipelineModel, rows: DataFrame, margin: bool = False) -> DataFrame:
    """``delay_probability``: probability of the late class, or the margin of a linear SVM."""
    scored = model.transform(rows)
    column = "rawPrediction" if margin else "probability"
    vector = F.col(column)
    if scored.schema[column].dataType.typeName() != "array":
        vector = vector_to_array(vector)
    return rows_with(scored, rows, vector[1])


def rows_with(scored: DataFrame, rows: DataFrame, value) -> DataFrame:
    kept = [c for c in rows.columns if c != "delay_probability"]
    return scored.select(*kept, value.alias("delay_probability"))


def predict(
    model: PipelineModel, rows: DataFrame, threshold: float = S.FINAL_THRESHOLD
) -> DataFrame:
    """Probability and class of rows that have the 26 inputs."""
    S.require_columns(rows, S.MODEL_INPUTS, "model inputs")
    scored = add_score(model, rows)
    return scored.withColumn("predicted_late", M.apply_threshold("delay_probability", threshold))


# -- comparison -------------------------------------------------------------------------------------
METRICS = ("roc_auc", "pr_auc", "precision", "recall", "f1", "balanced_accuracy",
           "predicted_positive_rate")


def model_scores(
    models: Mapping[str, PipelineModel], chosen: Mapping[str, Candidate], rows: DataFrame
) -> DataFrame:
    """``(model, label, score)``: the scores of all models in one table, written once."""
    parts = [
        add_score(m, rows, chosen[n].margin)
        .select(F.lit(n).alias("model"), "label", F.col("delay_probability").alias("score"))
        for n, m in models.items()
    ]
    return durable(reduce(DataFrame.union, parts))


def _rounded(by: str = "") -> list[Column]:
    return [F.round(m, 6).alias(f"{by}{m}") for m in METRICS]


def evaluate(scored: DataFrame, chosen: Mapping[str, Candidate]) -> DataFrame:
    """Metrics of each model's scores at its own cut: 0.5, or 0 for a margin."""
    margins = F.col("model").isin([n for n, c in chosen.items() if c.margin])
    cut = F.when(margins, 0.0).otherwise(0.5)
    measured = M.binary_metrics(scored.withColumn("prediction", F.col("score") >= cut), ["model"])
    method = F.when(margins, "decision_function").otherwise("predict_proba")
    return measured.select("model", method.alias("score_method"), *_rounded())


def tune(scored: DataFrame) -> DataFrame:
    """Per model: the threshold with the best F1, and the metrics at 0.5 and there.

    One curve over all models, one measurement of both cuts.
    """
    best = M.best_f1(M.pr_curve(scored, ["model"]), ["model"]).select("model", "threshold")
    cuts = F.array(
        F.struct(F.lit("default").alias("at"), F.lit(0.5).alias("cut")),
        F.struct(F.lit("optimized").alias("at"), F.col("threshold").alias("cut")),
    )
    # One row per model and cut, so the small side.
    cut = best.select("model", F.inline(cuts))
    rows = scored.join(cut, "model").withColumn("prediction", F.col("score") >= F.col("cut"))
    measured = M.binary_metrics(rows, ["model", "at"]).select("model", "at", *_rounded())
    wide = measured.groupBy("model").agg(*[
        F.max(F.when(F.col("at") == at, F.col(m))).alias(f"{at}_{m}")
        for at in ("default", "optimized") for m in METRICS
    ])
    threshold = best.select("model", F.round("threshold", 6).alias("threshold"))
    return threshold.join(wide, "model")


def rank_models(results: DataFrame, by: str = "pr_auc") -> DataFrame:
    """Rank 1 is the best; one row per candidate, so a plain window is enough."""
    order = W.orderBy(F.col(by).desc_nulls_last(), F.col("model").asc())
    return results.coalesce(1).withColumn("rank", F.row_number().over(order))


def compare(
    train: DataFrame, validation: DataFrame, chosen: Mapping[str, Candidate] | None = None,
    fitted: Fit | None = None, parallelism: int = 6,
) -> DataFrame:
    """All candidates fitted on ``train``, measured on ``validation``, ranked by average precision."""
    chosen = chosen or candidates()
    models = fit_all(chosen, train, fitted, parallelism)
    return rank_models(evaluate(model_scores(models, chosen, validation), chosen))


def tune_all(
    train: DataFrame, validation: DataFrame, chosen: Mapping[str, Candidate] | None = None,
    fitted: Fit | None = None, parallelism: int = 6,
) -> DataFrame:
    """Candidates with probabilities (those of ``TUNED`` if none are given), by best F1."""
    chosen = chosen or {n: c for n, c in candidates().items() if n in TUNED}
    chosen = {n: c for n, c in chosen.items() if not c.margin}
    models = fit_all(chosen, train, fitted, parallelism)
    return rank_models(tune(model_scores(models, chosen, validation)), "optimized_f1")


# -- artifact -----------------------------------------------------------------------------------------
@dataclass(frozen=True)
class ModelInfo:
    """What is needed to use a stored model and to know how it was made."""

    model_name: str
    model_version: str
    threshold: float
    training_rows: int
    training_late_rate: float
    feature_count: int = len(S.MODEL_INPUTS)
    training_splits: tuple[str, ...] = ("train", "validation")
    test_used_for_training: bool = False
    spark_version: str = field(default="")

    def __post_init__(self):
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError("threshold must be between 0 and 1")
        if self.training_rows <= 0 or self.feature_count <= 0:
            raise ValueError("training rows and feature count must be positive")


def fit_final(
    candidate: Candidate, rows: DataFrame, version: str, threshold: float = S.FINAL_THRESHOLD
) -> tuple[PipelineModel, ModelInfo]:
    """Fit on train and validation together, with a frozen threshold."""
    n, pos = class_counts(rows)
    info = ModelInfo(
        candidate.name, version, threshold, n, pos / n, spark_version=rows.sparkSession.version
    )
    return fit(candidate, rows), info


def save_model(spark: SparkSession, model: PipelineModel, info: ModelInfo, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    text = spark.createDataFrame([(json.dumps(asdict(info)),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, ModelInfo]:
    """A stored model with its checked metadata."""
    raw = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    raw["training_splits"] = tuple(raw["training_splits"])
    info = ModelInfo(**raw)
    if info.feature_count != len(S.MODEL_INPUTS):
        raise ValueError(f"the model was made for {info.feature_count} inputs")
    return PipelineModel.load(f"{path}/model"), info


def final_evaluation(
    model: PipelineModel, info: ModelInfo, test: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Metrics of the test rows at the frozen threshold: overall and per city."""
    # Counts and curves read the scores, so a model of many trees scores each row once.
    scored = durable(predict(model, test, info.threshold).select(
        "city", "label", F.col("delay_probability").alias("score"),
        F.col("predicted_late").alias("prediction"),
    ))
    return M.binary_metrics(scored), M.binary_metrics(scored, ["city"])
