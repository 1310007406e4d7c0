"""Splits, encoders, pipelines and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evkit.functions import as_col, positive_probability, safe_ratio
from evkit.operators.boosting import Boosted, fit_boosted, load_boosted, save_boosted, score_boosted
from evkit.operators.categories import category_table, dictionary, encode_categories
from evkit.operators.evaluate import evaluate
from evkit.session import ensure_checkpoints, write_once

SEED = 42
HASH_DIGITS = 5
HASH_BUCKETS = 16**HASH_DIGITS
KINDS = ("lr", "gbt", "rf")
# Weight of a row of the compressed training table.
WEIGHT = "_weight"


def temporal_split(df: DataFrame, col: str, cutoff: object) -> tuple[DataFrame, DataFrame]:
    """(rows up to the cutoff, rows after it) (L4). Rows without a value are in neither."""
    return df.filter(F.col(col) <= cutoff), df.filter(F.col(col) > cutoff)


def _hash_text(row_id: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed))).cast("binary"))


def _hash_bucket(text: Column) -> Column:
    return F.conv(F.substring(text, 1, HASH_DIGITS), 16, 10).cast("int")


def stratified_part(
    df: DataFrame,
    row_id: str,
    label: str,
    frac: float = 0.2,
    seed: int = SEED,
    mode: str = "hash",
) -> DataFrame:
    """The rows with a label plus `part`, "test" for about (mode="hash") or exactly (mode="exact") `frac` of each
    label, else "train" (L5).

    Both are decided by a hash of the row id, which must be unique: a row falls on the same side on every run and at
    every partitioning. "exact" takes round(frac x class size) rows per class: a histogram of hash buckets gives the
    one bucket in which a class reaches its quota, only the rows of that bucket (about one in a million) are ranked,
    and the last hash taken is the class's cut. Cuts are a table with one row per class, however many there are.
    `df` is read twice: once for its ids and labels, and when the result is used.
    """
    df = df.filter(F.col(label).isNotNull())
    if mode == "hash":
        bucket = _hash_bucket(_hash_text(row_id, seed))
        is_test = bucket < F.lit(int(round(frac * HASH_BUCKETS)))
        return df.withColumn("part", F.when(is_test, "test").otherwise("train"))
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")

    hashed = df.select(F.col(label).alias("_class"), F.col(row_id).alias("_id"), _hash_text(row_id, seed).alias("_hash"))
    hashed = write_once(hashed.withColumn("_bucket", _hash_bucket(F.col("_hash"))), "row-hashes")
    per_bucket = hashed.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # A class has at most HASH_BUCKETS rows here.
    by_class = Window.partitionBy("_class")
    quota = F.round(F.sum("_n").over(by_class) * F.lit(frac)).cast("long")
    filled = F.sum("_n").over(by_class.orderBy("_bucket")) - F.col("_n")
    # The last bucket reached before the quota is full, and the rows it may still give.
    last = F.max_by(F.struct("_bucket", "_open"), F.when(F.col("_open") > 0, F.col("_bucket")))
    cuts = per_bucket.withColumn("_open", quota - filled).groupBy("_class").agg(last.alias("_cut"))
    cuts = cuts.filter(F.col("_cut").isNotNull()).select("_class", "_cut.*")
    edge = hashed.join(cuts, ["_class", "_bucket"])
    nth = F.row_number().over(Window.partitionBy("_class").orderBy("_hash", "_id"))
    edge = edge.withColumn("_nth", nth).filter(F.col("_nth") <= F.col("_open"))
    limits = edge.groupBy(F.col("_class").alias("_of")).agg(F.max(F.struct("_hash", "_id")).alias("_limit"))
    # As a table its size is known: a few classes are broadcast, many are joined by class.
    limits = write_once(limits, "class-cuts")
    place = F.struct(_hash_text(row_id, seed).alias("_hash"), F.col(row_id).alias("_id"))
    marked = df.join(limits, F.col(label) == F.col("_of"), "left")
    is_test = F.coalesce(place <= F.col("_limit"), F.lit(False))
    return marked.withColumn("part", F.when(is_test, "test").otherwise("train")).drop("_of", "_limit")


def stratified_split(
    df: DataFrame,
    row_id: str,
    label: str,
    frac: float = 0.2,
    seed: int = SEED,
    mode: str = "hash",
) -> tuple[DataFrame, DataFrame]:
    """(train, test) of `stratified_part`. Rows without a label are in neither."""
    marked = stratified_part(df, row_id, label, frac, seed, mode)
    return tuple(marked.filter(F.col("part") == part).drop("part") for part in ("train", "test"))


def string_index(df: DataFrame, cols: Sequence[str], order: str = "frequencyDesc") -> DataFrame:
    """`column`, `value`, `index` of every category (L1); see `category_table`."""
    return category_table(df, cols, order).select("column", "value", "index")


def ordinal_encode(
    train: DataFrame, df: DataFrame, cols: Sequence[str], suffix: str = "_code"
) -> DataFrame:
    """Alphabetical codes learnt on `train`; -1 for unseen values and nulls."""
    return encode_categories(df, dictionary(train, cols), {c: f"{c}{suffix}" for c in cols})


class ReferenceEncoder(Estimator):
    """Numbers and one-hot categories as `features`, with a reference level per category column (L2, L3).

    The last level (the least frequent, of equals the alphabetically last) is the zero vector, so a fit with an
    intercept is identified: each other level has one slot, its coefficient being the difference to that level. A
    category not seen in training is the zero vector, too, with invalid="keep". Slots carry their names in the
    metadata of `features`. The fitted stages are Spark's own, so a fitted pipeline can be saved.
    """

    def __init__(self, cats: Sequence[str] = (), nums: Sequence[str] = (), invalid: str = "keep",
                 invalid_numbers: str = "error") -> None:
        super().__init__()
        self.cats, self.nums = list(cats), list(nums)
        self.invalid, self.invalid_numbers = invalid, invalid_numbers

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        stages: list = []
        indexed, encoded = [f"{c}_indexed" for c in self.cats], [f"{c}_encoded" for c in self.cats]
        kept = list(range(len(self.nums)))
        if self.cats:
            indexer = StringIndexer(
                inputCols=self.cats, outputCols=indexed, handleInvalid=self.invalid, stringOrderType="frequencyDesc"
            ).fit(dataset)
            encoder = OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=False).fit(indexer.transform(dataset))
            stages = [indexer, encoder]
            at = len(kept)
            for labels, width in zip(indexer.labelsArray, encoder.categorySizes):
                kept += range(at, at + len(labels) - 1)
                at += width
        if not kept:
            raise ValueError("no feature has two values")
        inputs = self.nums + encoded
        stages.append(VectorAssembler(inputCols=inputs, outputCol="_all_features", handleInvalid=self.invalid_numbers))
        stages.append(VectorSlicer(inputCol="_all_features", outputCol="features", indices=kept))
        return PipelineModel(stages)


def build_pipeline(
    kind: str = "lr",
    cats: Sequence[str] = (),
    nums: Sequence[str] = (),
    label: str = "label",
    invalid: str = "keep",
    invalid_numbers: str = "error",
    **params: object,
) -> Pipeline:
    """Indexing, encoding, assembling and a classifier of Spark ML.

    kind="lr": one-hot categories with a reference level, and logistic regression. kind="rf": a forest on
    alphabetical codes, which count as numbers, so that any number of categories is allowed. Boosted trees are
    `fit_boosted`. `invalid` is what happens to categories not seen in training ("keep", "skip", "error"),
    `invalid_numbers` to null numbers. Further keywords go to the classifier.
    """
    cats, nums = list(cats), list(nums)
    if kind == "lr":
        stages = [ReferenceEncoder(cats, nums, invalid, invalid_numbers)]
        classifier = LogisticRegression(featuresCol="features", labelCol=label, **params)
    elif kind == "rf":
        stages = []
        indexed, codes = [f"{c}_indexed" for c in cats], [f"{c}_code" for c in cats]
        if cats:
            stages.append(StringIndexer(
                inputCols=cats, outputCols=indexed, handleInvalid=invalid, stringOrderType="alphabetAsc"))
            # A sum has no list of categories, so the trees take it for a number.
            sums = ", ".join(f"`{i}` + 0D AS `{c}`" for i, c in zip(indexed, codes))
            stages.append(SQLTransformer(statement=f"SELECT *, {sums} FROM __THIS__"))
        stages.append(VectorAssembler(inputCols=nums + codes, outputCol="features", handleInvalid=invalid_numbers))
        classifier = RandomForestClassifier(featuresCol="features", labelCol=label, **{"seed": SEED, **params})
    else:
        raise ValueError(f"unknown kind {kind!r}: one of lr, rf")
    return Pipeline(stages=[*stages, classifier])


def compressed(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Equal rows in `cols` as one row with their number as weight."""
    return train.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))


def fit(pipeline: Pipeline, train: DataFrame, compress: bool = True) -> PipelineModel:
    """Fit a pipeline of `build_pipeline`.

    Logistic regression learns from equal rows as one row with a weight (`compress`), which changes no sum of the
    fit: with few levels the passes over the rows become passes over their combinations. Levels are ranked on all
    rows before. The table that the passes read is kept in memory or on disk.
    """
    ensure_checkpoints(train.sparkSession)
    *prepare, classifier = pipeline.getStages()
    weighted = compress and isinstance(classifier, LogisticRegression) and not classifier.isSet("weightCol")
    if weighted:
        (encoder,) = prepare
        prepared = encoder.fit(train)
        cols = dict.fromkeys([*encoder.cats, *encoder.nums, classifier.getLabelCol()])
        kept = compressed(train, list(cols)).persist(StorageLevel.MEMORY_AND_DISK)
        rows = prepared.transform(kept)
        classifier = classifier.copy({classifier.weightCol: WEIGHT})
    else:
        kept = rows = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if weighted:
            return PipelineModel([prepared, classifier.fit(rows)])
        return pipeline.fit(rows)
    finally:
        kept.unpersist()


def train_model(
    kind: str, train: DataFrame, cats: Sequence[str], nums: Sequence[str], label: str,
    watched: str | Column | None = None, **params: object,
) -> PipelineModel | Boosted:
    """A fitted model of any of KINDS; `watched` rows decide when boosting stops and train the others."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}: one of {', '.join(KINDS)}")
    if kind == "gbt":
        return fit_boosted(train, cats, nums, label, watched, **params)
    return fit(build_pipeline(kind, cats, nums, label, **params), train)


def score(model: PipelineModel | Boosted, df: DataFrame, prob: str = "prob") -> DataFrame:
    """Input columns plus `prediction` and the success probability."""
    if isinstance(model, Boosted):
        return score_boosted(model, df, prob)
    scored = model.transform(df).withColumn(prob, positive_probability())
    return scored.select(*df.columns, "prediction", prob)


def save_model(model: PipelineModel | Boosted, base_rate: DataFrame | float, path: str) -> None:
    """Keep a model and its base rate (a number, or a table of one row with one) below `path`, on shared storage."""
    rate = float(base_rate.first()[0] if isinstance(base_rate, DataFrame) else base_rate)
    kind = "boosted" if isinstance(model, Boosted) else "pipeline"
    if isinstance(model, Boosted):
        save_boosted(model, f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    about = SparkSession.getActiveSession().createDataFrame([(kind, rate)], "kind string, base_rate double")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | Boosted, float]:
    """(model, base rate) as `save_model` kept them, in any session."""
    about = spark.read.parquet(f"{path}/about").first()
    if about["kind"] == "boosted":
        return load_boosted(spark, f"{path}/model"), about["base_rate"]
    return PipelineModel.load(f"{path}/model"), about["base_rate"]


def coefficients(model: PipelineModel, sample: DataFrame) -> DataFrame:
    """`slot`, `name`, `coefficient` of a logistic model, the intercept at slot -1.

    Names come from the metadata of the features column, one per slot of the one-hot vector.
    `sample` is any input of the model; only its schema is used.
    """
    fitted = model.stages[-1]
    attrs = model.transform(sample).schema["features"].metadata["ml_attr"]["attrs"]
    named = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    rows = [(-1, "intercept", float(fitted.intercept))]
    rows += [(i, name, float(fitted.coefficients[i])) for i, name in named]
    return sample.sparkSession.createDataFrame(rows, "slot int, name string, coefficient double")


def score_scenarios(
    model: PipelineModel | Boosted, scenarios: DataFrame, value: str | Column, base_rate: float | Column
) -> DataFrame:
    """Scenarios with `prob`, `xp` and `lift` over the base rate, 1 for a base rate of 0."""
    base = base_rate if isinstance(base_rate, Column) else F.lit(float(base_rate))
    scored = score(model, scenarios)
    return scored.withColumns(
        {
            "xp": as_col(value) * F.col("prob"),
            "lift": lift(F.col("prob"), base),
        }
    )


def lift(prob: str | Column, base_rate: Column) -> Column:
    """prob / base rate; 1 where the base rate is 0 or null."""
    return F.coalesce(safe_ratio(prob, base_rate), F.lit(1.0))


def compare_models(
    train: DataFrame,
    test: DataFrame,
    cats: Sequence[str],
    nums: Sequence[str],
    label: str,
    kinds: Sequence[str] = KINDS,
    settings: dict[str, dict] | None = None,
    watched: str | Column | None = None,
) -> DataFrame:
    """One row of hold-out metrics per kind of model, all on the same split.

    The held-out rows are read once: each model adds its score to them, and all metrics come from the counts per
    model and distinct score.
    """
    settings = settings or {}
    scored = test.select(*dict.fromkeys([*cats, *nums, label]))
    for kind in kinds:
        model = train_model(kind, train, cats, nums, label, watched, **settings.get(kind, {}))
        scored = score(model, scored, f"_prob_{kind}").withColumnRenamed("prediction", f"_pred_{kind}")
    each = F.array(*[
        F.struct(F.lit(k).alias("model"), F.col(f"_prob_{k}").alias("prob"), F.col(f"_pred_{k}").alias("prediction"))
        for k in kinds
    ])
    long = scored.select(F.col(label).alias("label"), F.explode(each).alias("one")).select("label", "one.*")
    return evaluate(long, "label", "prob", "prediction", by=["model"])
