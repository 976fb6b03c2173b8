"""Classification metrics and activity baselines as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileguard.functions.text import last_token
from fileguard.functions.time import minute_of


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, 0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0).cast("bigint"))


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Counts for all four pairs of ``label`` and ``prediction``, zeros included."""
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("label"),
                F.lit(b).alias("prediction"),
                _count((F.col("label") == a) & (F.col("prediction") == b)).alias("n"),
            )
            for a in (0, 1)
            for b in (0, 1)
        ]
    )
    return scored.agg(cells.alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def _tallies(scored: DataFrame) -> DataFrame:
    label, guess = F.col("label") == 1, F.col("prediction") == 1
    return scored.agg(
        _count(label & guess).alias("tp"),
        _count(~label & guess).alias("fp"),
        _count(label & ~guess).alias("fn"),
        _count(~label & ~guess).alias("tn"),
    )


def _f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / total)


def precision_recall_f1(scored: DataFrame) -> DataFrame:
    """Binary precision, recall and F1 of class 1; undefined values are 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = _tallies(scored).select(
        "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall")
    )
    return rated.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def classification_report(scored: DataFrame, names: tuple[str, str] = ("good", "ransom")) -> DataFrame:
    """Rows for both classes, accuracy, macro and weighted averages, with precision, recall, F1 and support."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn

    def entry(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("support")
        )

    rated = _tallies(scored).select(
        total.alias("total"),
        (tn + fp).alias("n0"),
        (tp + fn).alias("n1"),
        ratio(tp + tn, total).alias("accuracy"),
        ratio(tn, tn + fn).alias("p0"),
        ratio(tn, tn + fp).alias("r0"),
        ratio(tp, tp + fp).alias("p1"),
        ratio(tp, tp + fn).alias("r1"),
    )
    rated = rated.withColumns({"f0": _f1(F.col("p0"), F.col("r0")), "f1": _f1(F.col("p1"), F.col("r1"))})
    c = {k: F.col(k) for k in rated.columns}
    macro = [(c[f"{m}0"] + c[f"{m}1"]) / F.lit(2.0) for m in "prf"]
    weighted = [ratio(c[f"{m}0"] * c["n0"] + c[f"{m}1"] * c["n1"], c["total"]) for m in "prf"]
    rows = F.array(
        entry(names[0], c["p0"], c["r0"], c["f0"], c["n0"]),
        entry(names[1], c["p1"], c["r1"], c["f1"], c["n1"]),
        entry("accuracy", c["accuracy"], c["accuracy"], c["accuracy"], c["total"]),
        entry("macro avg", *macro, c["total"]),
        entry("weighted avg", *weighted, c["total"]),
    )
    return rated.select(F.explode(rows).alias("r")).select("r.*")


def score_counts(scored: DataFrame, score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score, the reduced form every threshold metric works on."""
    return scored.groupBy(F.col(score).alias("score")).agg(
        _count(F.col("label") == 1).alias("pos"), _count(F.col("label") == 0).alias("neg")
    )


def roc_auc(scored: DataFrame, score: str = "score") -> DataFrame:
    """Area under the ROC curve; a tie counts half. NULL when a class is missing.

    Summed over distinct scores: each contributes its positives times the negatives scored lower plus half of those
    scored equal. The negatives below come from ranges of scores: distinct scores are range-partitioned by Spark and
    only one subtotal per range is put in order.
    """
    counts = with_totals_below(score_counts(scored, score), "score", ["neg"])
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return counts.agg(area.alias("a"), pairs.alias("p")).select(
        F.when(F.col("p") > 0, F.col("a") / F.col("p")).alias("auc")
    )


def place_in_ranges(rows: DataFrame, order: str, ranges: int) -> DataFrame:
    """Add ``_range``, which does not decrease along ``order`` and cuts the rows into about equally large parts.

    The column is cut at approximate quantiles, so skewed values spread evenly too. ``ranges`` is a power of two:
    each row finds its range by binary search, one projection per halving.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 8 * ranges)).scalar()
    placed = rows.withColumn("_cuts", cuts).withColumn("_range", F.lit(0))
    half = ranges // 2
    while half:
        beyond = F.col(order) > F.col("_cuts")[F.col("_range") + (half - 1)]
        placed = placed.withColumn("_range", F.col("_range") + F.when(beyond, half).otherwise(0))
        half //= 2
    return placed.drop("_cuts")


def with_totals_below(rows: DataFrame, order: str, values: list[str], ranges: int = 1024) -> DataFrame:
    """Add ``<value>_below``: the sum of ``value`` over rows with a strictly smaller ``order`` (distinct doubles).

    Running sums are taken inside each range of ``order``, and the at most ``ranges`` subtotals are put in order and
    added.
    """
    placed = place_in_ranges(rows, order, ranges)
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        placed.groupBy("_range")
        .agg(*[F.sum(v).alias(v) for v in values])
        .select("_range", *[F.coalesce(F.sum(v).over(along), F.lit(0)).alias(f"_{v}_carry") for v in values])
    )
    local = placed.withColumns({f"_{v}_in": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return local.join(carry, "_range").select(
        *rows.columns, *[(F.col(f"_{v}_in") + F.col(f"_{v}_carry")).alias(f"{v}_below") for v in values]
    )


def top_extensions(events: DataFrame, n: int = 10) -> DataFrame:
    """Per drive, the ``n`` commonest name endings with their counts; ties go to the alphabetically first."""
    counts = (
        events.groupBy("drive_id", last_token(F.coalesce(F.col("local_title"), F.lit(""))).alias("extension"))
        .agg(F.count("*").alias("n"))
    )
    best = Window.partitionBy("drive_id").orderBy(F.desc("n"), F.asc("extension"))
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def activity_baseline(events: DataFrame, quantile: float = 0.95, approximate: bool = False) -> DataFrame:
    """Per drive: event rate over its time span (at least one second), busy-minute quantile and common endings.

    The quantile runs over non-empty minutes, a table bounded by elapsed time; ``approximate`` keeps a bounded sketch.
    """
    minutes = events.groupBy("drive_id", minute_of(F.col("timestamp")).alias("minute")).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    busy = F.percentile_approx("n", quantile, 10000).cast("double") if approximate else F.percentile("n", quantile)
    span = F.greatest(F.max("hi") - F.min("lo"), F.lit(1.0))
    rates = minutes.groupBy("drive_id").agg(
        F.sum("n").alias("events"), (F.sum("n") / span).alias("event_rate"), busy.alias("typical_burst_size")
    )
    common = (
        top_extensions(events)
        .groupBy("drive_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "extension"))).alias("t"))
        .select("drive_id", F.col("t.extension").alias("common_extensions"))
    )
    return rates.join(common, "drive_id")


#: Busy-minute sketches tell counts up to this apart exactly; larger ones share a step of 1/64 of their power of two.
EXACT_COUNT = 128


def count_step(n: Column) -> Column:
    """The upper end of the step that a count falls in: never below it, and less than 1/64 above it."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) - 6).cast("bigint")
    return F.when(n <= EXACT_COUNT, n).otherwise(F.ceil(n / width).cast("bigint") * width)


def burst_sketch(events: DataFrame) -> DataFrame:
    """(drive_id, hour, step, minutes): how many non-empty minutes of each hour have a count in each step.

    An hour has 60 rows at most. Sketches of whole hours can be stored and merged in any grouping: the sums are the same as
    those of one sketch over all of them, so the merged quantile has no rank error, and its value is less than 1/64 too high.
    """
    minute = minute_of(F.col("timestamp"))
    minutes = events.groupBy("drive_id", minute.alias("minute")).agg(F.count("*").alias("n"))
    hour = F.floor(F.col("minute") / 60).cast("bigint")
    return minutes.groupBy("drive_id", hour.alias("hour"), count_step(F.col("n")).alias("step")).agg(F.count("*").alias("minutes"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """(drive_id, step, minutes) of any sketches, hourly or merged ones."""
    rows = sketches[0].select("drive_id", "step", "minutes")
    for other in sketches[1:]:
        rows = rows.unionByName(other.select("drive_id", "step", "minutes"))
    return rows.groupBy("drive_id", "step").agg(F.sum("minutes").alias("minutes"))


def sketch_quantile(sketch: DataFrame, quantile: float = 0.95) -> DataFrame:
    """(drive_id, minutes, typical_burst_size): the smallest step that ``quantile`` of the minutes do not pass. A drive has a few
    thousand steps at most, however many minutes."""
    drive = Window.partitionBy("drive_id")
    along = drive.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merge_sketches(sketch).withColumns({"until": F.sum("minutes").over(along), "all": F.sum("minutes").over(drive)})
    return ranked.where(F.col("until") >= F.col("all") * F.lit(quantile)).groupBy("drive_id").agg(
        F.first("all").alias("minutes"), F.min("step").alias("typical_burst_size")
    )


def events_per_minute(events: DataFrame) -> DataFrame:
    """Tumbling one-minute counts per drive; also valid on a stream."""
    window = F.window(F.timestamp_micros("ts_us"), "1 minute")
    return events.groupBy("drive_id", window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        "drive_id", F.unix_micros("w.start").alias("minute_us"), "event_type", "n"
    )
