"""Counts, histograms and metrics: the numbers behind reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.functions.refs import ref_source
from patchloom.operators.filters import between_quantiles
from patchloom.operators.ranks import running


def value_counts(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """Rows per value, most first; equal counts in order of the value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.col(column)).limit(top_n) if top_n else counts


def ref_source_share(df: DataFrame, refs: str = "refs") -> DataFrame:
    """References per source, with their percentage."""
    counts = df.select(F.explode(refs).alias("ref")).groupBy(ref_source(F.col("ref")).alias("source")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # at most five rows


def commits_per_advisory(df: DataFrame, commits: str = "commits") -> DataFrame:
    return df.groupBy(F.size(commits).alias("commits")).agg(F.count("*").alias("n"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    safe = F.coalesce(F.col(label) == "safe", F.lit(False))
    return df.agg(F.count_if(safe).alias("safe"), F.count_if(~safe).alias("unsafe"))


def oversample_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """ratio = ceil(floor(safe / unsafe) * 2 / 3), at least 1; 10 when there is no unsafe row or unsafe is no minority."""
    counts = label_distribution(df, label)
    ratio = F.greatest(F.ceil(F.floor(F.col("safe") / F.nullif("unsafe", F.lit(0))) * 2 / 3), F.lit(1))
    return counts.withColumn("ratio", F.when((F.col("unsafe") == 0) | (F.col("unsafe") >= F.col("safe")), 10).otherwise(ratio).cast("long"))


def class_language_flow(df: DataFrame, top: int = 5) -> DataFrame:
    """Links of a class and a language with their rows, of the top commonest language sets; rows without class are left out."""
    rows = df.filter(F.col("bf_class").isNotNull() & F.col("language").isNotNull()).withColumn("set_", F.array_join(F.array_sort("language"), ","))
    commonest = value_counts(rows, "set_", top).select("set_")
    counted = rows.join(commonest, "set_", "left_semi").groupBy("bf_class", "language").agg(F.count("*").alias("n"))
    return counted.select("bf_class", F.explode("language").alias("language"), "n").groupBy("bf_class", "language").agg(F.sum("n").cast("long").alias("n"))


def top_unmapped_cwe(df: DataFrame, top: int = 10) -> DataFrame:
    return value_counts(df.filter("bf_class is null"), "cwe_id", top)


def histogram(df: DataFrame, column: str, bins: int = 20, by: str | None = None, filter_outliers: bool = False) -> DataFrame:
    """bin (1 to bins, of equal width between the extremes), n and mean per bin, and per by where given."""
    rows = between_quantiles(df, column) if filter_outliers else df
    edges = rows.agg(F.min(column).cast("double").alias("lo_"), F.max(column).cast("double").alias("hi_"))
    value = F.col(column).cast("double")
    place = F.when(F.col("hi_") > F.col("lo_"), F.floor((value - F.col("lo_")) / ((F.col("hi_") - F.col("lo_")) / bins)) + 1).otherwise(1)
    placed = rows.filter(F.col(column).isNotNull()).join(F.broadcast(edges)).withColumn("bin", F.least(place, F.lit(bins)).cast("int"))
    return placed.groupBy(*([by] if by else []), "bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def similarity_ratio(deleted: Column, added: Column, lines_a: Column, lines_b: Column) -> Column:
    return 1.0 - (deleted + added) / (lines_a + lines_b)


def project_files(df: DataFrame, factor: int = 3) -> DataFrame:
    """Per project: its distinct files, target = their number * factor, and the commits to exclude."""
    grouped = df.groupBy("project_url").agg(F.countDistinct("file_path").alias("files"), F.collect_set("vuln_commit_hash").alias("a"), F.collect_set("fixed_commit_hash").alias("b"))
    return grouped.select("project_url", "files", (F.col("files") * factor).alias("target"), F.array_sort(F.array_union("a", "b")).alias("excluded"))


def confusion_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """TN, FP, FN, TP and the metrics from them; a zero denominator gives 0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.groupBy(*(by or [])).agg(F.count_if(~y & ~p).alias("TN"), F.count_if(~y & p).alias("FP"), F.count_if(y & ~p).alias("FN"), F.count_if(y & p).alias("TP"))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("TN", "FP", "FN", "TP"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.withColumns({
        "Acc": ratio(tp + tn, tp + tn + fp + fn), "MCC": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "F1": ratio(2 * tp, 2 * tp + fp + fn), "Recall": ratio(tp, tp + fn), "Precision": ratio(tp, tp + fp), "preds_share": ratio(tp + fp, tp + tn + fp + fn),
    })


def curve_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row for each distinct score: cumulative TP and FP from the highest on, fpr, tpr, precision, and fpr and tpr before it.

    Rows are counted per score, and running sums go over ranges of scores, however these are spread.
    """
    per = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    rows = running(per, [], [F.desc("score")], {"p_": F.col("p"), "q_": F.col("q")})
    total = rows.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    rows = rows.join(F.broadcast(total)).withColumns({"TP": F.col("p") + F.col("p_"), "FP": F.col("q") + F.col("q_")})
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.col(b).cast("double")), F.lit(0.0))
    tp, fp = F.col("TP"), F.col("FP")
    return rows.select(
        "score", "TP", "FP", ratio(fp, "all_q").alias("fpr"), ratio(tp, "all_p").alias("tpr"), (tp / (tp + fp)).alias("precision"),
        ratio(F.col("q_"), "all_q").alias("fpr_before"), ratio(F.col("p_"), "all_p").alias("tpr_before"),
    )


def area_under_curve(points: DataFrame) -> DataFrame:
    """roc_auc by trapezoids and average_precision by steps, from curve_points."""
    area = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2
    return points.agg(F.sum(area).alias("roc_auc"), F.sum((F.col("tpr") - F.col("tpr_before")) * F.col("precision")).alias("average_precision"))
