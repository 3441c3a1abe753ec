"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Statistics are built-in expressions over the whole text. A random forest of shallow trees gives candidate rules: every
path from a root to a node below it, as a conjunction of comparisons. A lasso logistic regression over the rules'
outcomes keeps few of them, and the score is the logistic function of the kept rules' weights, as one column.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import crc_remainder, once, written

STATISTICS = (
    "words", "word_length", "distinct_words", "repeated_words", "symbols", "marks", "capitals", "digits", "repeated_lines",
)
_LINE = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+\d.eE]+)\)|^(\s*)Predict")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one double column for each of STATISTICS, 0 throughout for null and empty texts.

    words is log(1 + count) of runs between white space; repeated_words is the share of words equal to the one before;
    symbols and marks are shares of characters (symbols: not letters, digits, white space or common punctuation).
    """
    value = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    rows = docs.select(*docs.columns, once(F.struct(words.alias("w"), F.split(value, "\n").alias("l"))).alias("_cut")).withColumns({"_words": F.col("_cut.w"), "_lines": F.col("_cut.l")})
    n, chars = F.size("_words"), F.length(value)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    def characters(but: str) -> Column:
        return share(F.length(F.regexp_replace(value, but, "")), chars)

    after = F.arrays_zip(F.slice("_words", 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("_words", 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    repeated = F.size(F.filter(after, lambda p: p["a"] == p["b"]))
    return rows.withColumns({
        "words": F.log1p(n.cast("double")), "word_length": share(F.length(F.array_join("_words", "")), n),
        "distinct_words": share(F.size(F.array_distinct("_words")), n), "repeated_words": share(repeated, n),
        "symbols": characters(r"[\p{L}\p{N}\s.,;:'\"()?-]+"), "marks": characters(r"[\p{L}\p{N}\s]+"),
        "capitals": characters(r"[^\p{Lu}]+"), "digits": characters(r"[^0-9]+"),
        "repeated_lines": 1.0 - F.size(F.array_distinct("_lines")) / F.size("_lines"),
    }).drop("_words", "_lines", "_cut")


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(described: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The conjunction of comparisons that leads to each node below the root, from Spark's description of a tree."""
    rules, path = [], []
    for line in described.splitlines():
        m = _LINE.match(line)
        if m and m[2]:
            depth = len(m[1]) - 2  # the description indents the root's branches by two
            path = path[:depth] + [(names[int(m[3])], m[4], float(m[5]))]
            rules.append(tuple(sorted(set(path))))
    return rules


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, bound in rule:
        out = out & (F.col(name) <= bound if sign == "<=" else F.col(name) > bound)
    return out


@dataclass
class RuleEnsemble:
    """rules with their nonzero weights; score() is a column over the statistics."""

    intercept: float = 0.0
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            margin = margin + F.when(holds(rule), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-margin))


def fit_rules(labelled: DataFrame, label: str, trees: int = 16, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> RuleEnsemble:
    """An ensemble from rows with STATISTICS and a 0/1 label; rows with a null label are ignored.

    Without rows, or with one label only, no rule is kept and the score is the smoothed share of label 1.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), *STATISTICS)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return RuleEnsemble(float(math.log(share / (1 - share))))
    points = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5, featureSubsetStrategy="0.5").fit(points)
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t.toDebugString)))
    if not rules:
        return RuleEnsemble(float(math.log(ones / (n - ones))))
    outcomes = rows.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(outcomes)
    kept = {r: float(w) for r, w in zip(rules, lasso.coefficients, strict=True) if w}
    return RuleEnsemble(float(lasso.intercept), kept)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 2, folds: int = 4, threshold: float = 0.7) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Labels are learnt only from documents outside the held-out fold. Statistics of every whole text are written once to
    the shared folder, and both training and scoring read them. Null and empty texts have statistics 0 and are scored
    like others; repeated and null doc_ids keep their rows (a null one is never labelled); other columns are ignored.
    """
    held = crc_remainder(F.col("doc_id"), folds) == fold
    rows = written(with_statistics(docs.select("doc_id", "text")).select("doc_id", held.alias("held_out"), *STATISTICS), "statistics")
    marks = labels.select(F.col("doc_id"), F.col(label).alias("label_")).distinct()
    train = written(rows.filter(~F.col("held_out")).join(marks, "doc_id").select("label_", *STATISTICS), "labelled")
    score = fit_rules(train, "label_").score()
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
