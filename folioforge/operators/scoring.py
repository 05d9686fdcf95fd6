"""Scores of translated sections: modules in long form (id, module, score, skipped), weighted into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T

# Weights of the modules.
WEIGHTS = {"formula": 0.35, "semantic": 0.30, "logic": 0.20, "research": 0.15}
MODULE_LABELS = {"formula": "수식", "semantic": "의미", "logic": "논리", "research": "검증"}


def weight_of(module: Column) -> Column:
    """Weights in hundredths, so that sums are exact."""
    out = F.when(F.lit(False), F.lit(0))
    for name, w in WEIGHTS.items():
        out = out.when(module == name, F.lit(round(w * 100)))
    return out.otherwise(0)


def overall(scores: DataFrame, id_col: str) -> DataFrame:
    """(id, score, band): the weighted mean of the modules that were not skipped, truncated; 100 without any.

    Weights are a fixed map in the plan, and the mean is one aggregate with partial sums.
    """
    counted = F.when(~F.coalesce("skipped", F.lit(False)), weight_of(F.col("module"))).otherwise(0)
    total, sums = F.sum(counted), F.sum(counted * T.clamp(F.col("score")))
    score = F.when(F.coalesce(total, F.lit(0)) == 0, 100).otherwise(F.floor(sums / F.greatest(total, F.lit(1)))).cast("int")
    return scores.groupBy(id_col).agg(score.alias("score")).withColumn("band", T.score_band(F.col("score")))


def semantic(paragraph_scores: DataFrame, id_col: str, score_col: str = "para_score", unanswered: int = 7, none: int = 70) -> DataFrame:
    """(id, score): the mean of paragraph scores from 1 to 10 in tenths; unanswered count 7, no paragraphs give 70."""
    given = F.when(F.col("pos").isNull(), None).otherwise(F.coalesce(F.col(score_col), F.lit(unanswered)))
    mean = F.sum(given) * 10 / F.count(given)
    return paragraph_scores.groupBy(id_col).agg(F.coalesce(F.floor(mean), F.lit(none)).cast("int").alias("score"))


def penalised_semantic(score: Column, n_issues: Column, n_original: Column, n_translated: Column) -> Column:
    """3 less for each glossary issue, 10 less if the numbers of paragraphs differ by more than half; never below 0."""
    after = F.greatest(F.lit(0), score - 3 * n_issues)
    uneven = (n_original > 0) & ((2 * n_translated < n_original) | (n_translated > 2 * n_original))
    return F.when(uneven, F.greatest(F.lit(0), after - 10)).otherwise(after)


def logic(n_claims: Column, n_flagged: Column, n_issues: Column) -> Column:
    """The preserved share of claims in per cent, 5 less for each issue; 100 without claims."""
    kept = F.floor((n_claims - n_flagged) * 100 / F.greatest(n_claims, F.lit(1)))
    return F.when(n_claims == 0, 100).otherwise(F.greatest(F.lit(0), kept - 5 * n_issues)).cast("int")


def research(n_claims: Column, n_checked: Column, n_verified: Column) -> Column:
    """The verified share of checked claims in per cent; 80 if none could be checked, 100 without claims."""
    share = F.floor(n_verified * 100 / F.greatest(n_checked, F.lit(1)))
    return F.when(n_claims == 0, 100).when(n_checked == 0, 80).otherwise(share).cast("int")


def corpus_summary(scored: DataFrame, low: int = 60) -> DataFrame:
    """One row: sections, mean score, how many are low. Ids of low ones stay a table: low_sections()."""
    return scored.agg(
        F.count(F.lit(1)).alias("n_sections"), F.round(F.avg("score"), 6).alias("mean_score"), F.sum(F.when(F.col("score") < low, 1).otherwise(0)).alias("n_low")
    )


def low_sections(scored: DataFrame, low: int = 60) -> DataFrame:
    return scored.where(F.col("score") < low)


def report_line(modules: DataFrame, id_col: str) -> DataFrame:
    """(id, line): each module that ran with its score and, if it has any, its number of issues."""
    order = {m: i for i, m in enumerate(WEIGHTS)}
    rank, label = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(""))
    for m, i in order.items():
        rank, label = rank.when(F.col("module") == m, i), label.when(F.col("module") == m, MODULE_LABELS[m])
    count = F.when(F.col("n_issues") > 0, F.concat(F.lit(" ("), F.col("n_issues").cast("string"), F.lit("건)"))).otherwise("")
    part = F.concat(label, F.lit(" "), F.col("score").cast("string"), count)
    ran = modules.where(~F.coalesce("skipped", F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct(rank.alias("r"), part.alias("s"))))
    return ran.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x["s"]), " \\quad ").alias("line"))
