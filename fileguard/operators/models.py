"""Training data preparation, split, classifier, attribution and training sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileguard.operators.scans import running_totals
from fileguard.schemas import FEATURES, LABEL_COLUMN, TRAINING_COLUMNS


def training_prepare(raw: DataFrame) -> DataFrame:
    """The 13 training columns with ``label`` 0 for good and 1 for ransom; any other class gives a NULL label."""
    kind = F.col(f"`{LABEL_COLUMN}`")
    label = F.when(kind == "good", 0).when(kind == "ransom", 1)
    keep = [c for c in ("row_id",) if c in raw.columns]
    return raw.select(
        *keep, label.alias("label"), *[F.col(f"`{a}`").alias(b) for a, b in zip(TRAINING_COLUMNS, FEATURES)]
    )


def rejected_labels(raw: DataFrame) -> DataFrame:
    """How many raw rows have a class the encoder does not know, by class."""
    kind = F.col(f"`{LABEL_COLUMN}`")
    unknown = raw.where(kind.isNull() | ~kind.isin("good", "ransom"))
    return unknown.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def class_split(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Benign and malicious subset."""
    return labelled.where("label = 0"), labelled.where("label = 1")


def seeded_key(row_id: str, seed: int) -> Column:
    """Reproducible pseudo-random order of rows, independent of partitioning and engine."""
    return F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(str(seed))))


def seeded_sample(rows: DataFrame, n: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in seeded order; a top-n, so partitions send at most ``n`` rows each."""
    return rows.withColumn("_key", seeded_key(row_id, seed)).orderBy("_key", row_id).limit(n).drop("_key")


def stratified_split(
    labelled: DataFrame, row_id: str = "row_id", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split``: in each class the first ``test_share`` of the rows in seeded order are 'test', the rest 'train'.

    The rank within a class is exact but no class is one task: hash keys spread evenly, so each class is cut by the
    key's first five hex digits, ranked inside, and offset by the counts of the cuts before it (at most 2^20 rows
    per class). Rows without a label are left out.
    """
    keyed = labelled.where("label is not null").withColumn("_key", seeded_key(row_id, seed))
    cut = F.conv(F.substring("_key", 1, 5), 16, 10).cast("bigint")
    ranked = running_totals(
        keyed.withColumns({"_chunk": cut, "_rank": F.lit(1).cast("bigint")}), "label", ["_key", row_id], ["_rank"]
    )
    sizes = labelled.groupBy("label").agg(F.count("*").alias("_size"))
    quota = F.ceil(F.col("_size") * F.lit(test_share))
    split = F.when(F.col("_rank") <= quota, F.lit("test")).otherwise(F.lit("train"))
    return (
        ranked.join(F.broadcast(sizes), "label")  # one row per class
        .withColumn("split", split)
        .select(*labelled.columns, "split")
    )


def train_classifier(
    train: DataFrame,
    features: list[str] = FEATURES,
    rounds: int = 300,
    depth: int = 6,
    step: float = 0.1,
    row_share: float = 0.8,
    column_share: float = 0.8,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees with log loss. Every round is a few Spark jobs over the whole training set."""
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    trees = GBTClassifier(
        labelCol="label",
        featuresCol="features",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=step,
        subsamplingRate=row_share,
        featureSubsetStrategy=str(column_share),
        seed=seed,
        checkpointInterval=10,
    )
    return Pipeline(stages=[assembler, trees]).fit(train)


def classifier_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``score`` (probability of class 1) and ``prediction``."""
    out = model.transform(rows)
    return out.withColumns(
        {"score": vector_to_array("probability")[1], "prediction": F.col("prediction").cast("int")}
    ).select(*rows.columns, "score", "prediction")


def feature_importances(model: PipelineModel, features: list[str] = FEATURES) -> list[tuple[str, float]]:
    """The trees' own split-gain importances, largest first."""
    gains = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, gains), key=lambda pair: (-pair[1], pair[0]))


def feature_attribution(
    model: PipelineModel,
    rows: DataFrame,
    features: list[str] = FEATURES,
    row_id: str = "row_id",
    repeats: int = 3,
    seed: int = 42,
    sample: int | None = None,
) -> DataFrame:
    """Mean absolute change of the score when a feature takes another row's value, per feature, largest first.

    All rows are explained, or ``sample`` of them if the caller gives a number. For each feature and repeat a row borrows the
    value of the row a seeded number of places further on, so one join on row numbers serves every feature and all
    rows x features x repeats are scored in one pass.
    """
    chosen = rows if sample is None else seeded_sample(rows, sample, row_id, seed)
    numbered = running_totals(
        chosen.select(row_id, *features).withColumns(
            {
                "_all": F.lit(0),
                "_key": seeded_key(row_id, seed),
                "_chunk": F.conv(F.substring(seeded_key(row_id, seed), 1, 4), 16, 10).cast("bigint"),
                "_n": F.lit(1).cast("bigint"),
            }
        ),
        "_all",
        ["_key", row_id],
        ["_n"],
    ).select("_n", *features)
    size = numbered.agg(F.count("*")).scalar()
    base = classifier_scores(model, numbered).select("_n", F.col("score").alias("base"), *features)
    tasks = base.withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in features]))).withColumn(
        "_repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)]))
    )
    shift = F.pmod(F.xxhash64("_feature", "_repeat", F.lit(seed)), F.greatest(size - 1, F.lit(1))) + 1
    donor = F.pmod(F.col("_n") - 1 + shift, size) + 1
    lent = numbered.select(F.col("_n").alias("_donor"), *[F.col(f).alias(f"_lent_{f}") for f in features])
    swapped = tasks.withColumn("_donor", donor).join(lent, "_donor").select(
        "_feature",
        "base",
        *[F.when(F.col("_feature") == f, F.col(f"_lent_{f}")).otherwise(F.col(f)).alias(f) for f in features],
    )
    return (
        classifier_scores(model, swapped)
        .groupBy(F.col("_feature").alias("feature"))
        .agg(F.avg(F.abs(F.col("score") - F.col("base"))).alias("attribution"))
        .orderBy(F.desc("attribution"), "feature")
    )


def permutations(features: list[str], n: int, seed: int) -> list[dict[str, int]]:
    """``n`` seeded orders of the features: place (from 1) by name. The order is that of a digest, the same in any engine."""
    digest = lambda m, f: hashlib.md5(f"{seed}|{m}|{f}".encode()).hexdigest()
    return [{f: k for k, f in enumerate(sorted(features, key=lambda f: digest(m, f)), 1)} for m in range(n)]


def sampled_shapley(
    rows: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    background: dict[str, float],
    row_id: str = "row_id",
    chains: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Contribution of each feature to each row's score: row_id, ``base`` (score of ``background``), ``prediction`` and one column
    ``phi_<feature>`` each. A row's contributions sum to prediction minus base.

    A chain takes the background row and gives it the row's values one by one in a seeded order; what a feature adds is the
    score after its turn less the score before. All coalitions of all rows are scored in one pass by ``scorer`` (adds ``score``),
    and a coalition adds its score to the feature that has just come and takes it from the one that comes next, so one
    grouping with partial sums ends it; the coalitions of a row are made in one task, which sums them up before the shuffle.
    """
    features = list(background)
    orders = permutations(features, chains, seed)
    place = {f: F.get(F.array(*(F.lit(o[f]) for o in orders)), F.col("_m")) for f in features}
    laid = rows.select(row_id, *features).withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    laid = laid.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = laid.select(
        row_id, "_m", "_k", *(F.when(place[f] <= F.col("_k"), F.col(f).cast("double")).otherwise(F.lit(float(background[f]))).alias(f) for f in features)
    )
    scored = scorer(mixed).select(row_id, "_m", "_k", F.col("score").cast("double").alias("score"))
    gains = [
        (F.sum(F.when(place[f] == F.col("_k"), F.col("score")).when(place[f] == F.col("_k") + 1, -F.col("score")).otherwise(0.0)) / chains).alias(f"phi_{f}")
        for f in features
    ]
    end = lambda k, name: F.avg(F.when(F.col("_k") == k, F.col("score"))).alias(name)
    return scored.groupBy(row_id).agg(end(0, "base"), end(len(features), "prediction"), *gains)


def class_rows(labelled: DataFrame, value: str, row_id: str = "row_id", rows_per_chunk: int = 1_000_000) -> DataFrame:
    """``label``, ``value`` and ``pos``, the row's 0-based position within its class by ``row_id``."""
    rows = labelled.where("label is not null").select(
        "label",
        row_id,
        value,
        F.floor(F.col(row_id) / F.lit(rows_per_chunk)).cast("bigint").alias("_chunk"),
        F.lit(1).cast("bigint").alias("pos"),
    )
    return running_totals(rows, "label", [row_id], ["pos"]).select("label", value, (F.col("pos") - 1).alias("pos"))


def hmm_sequences(
    labelled: DataFrame,
    value: str = "file_name_entropy",
    row_id: str = "row_id",
    per_class: int = 500,
    length: int = 15,
    seed: int = 42,
) -> DataFrame:
    """``per_class`` contiguous windows of ``length`` values per class, with replacement, as (label, seq, sequence).

    Start positions come from a seeded hash in [0, class size - length). The wanted positions are a table of
    per_class x length rows per class, so a plain equi-join on (label, position) fetches them.
    """
    rows = class_rows(labelled, value, row_id)
    sizes = labelled.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    draw = F.conv(
        F.substring(F.md5(F.concat_ws("|", F.col("label"), F.col("seq"), F.lit(str(seed)))), 1, 8), 16, 10
    ).cast("bigint")
    wanted = (
        sizes.where(F.col("n") > length)
        .withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))))
        .withColumn("start", F.pmod(draw, F.col("n") - length))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
        .select("label", "seq", "step", (F.col("start") + F.col("step")).alias("pos"))
    )
    return (
        wanted.join(rows, ["label", "pos"])
        .groupBy("label", "seq")
        .agg(F.sort_array(F.collect_list(F.struct("step", value))).alias("s"))
        .select("label", "seq", F.col(f"s.{value}").alias("sequence"))
    )
