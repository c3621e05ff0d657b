"""Scores of judges: consensus, agreement, gates and verdict rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.numeric import coerce
from lacuna.functions.text import strip

AXES = ("novelty", "specificity", "feasibility", "evidence_grounding")
#: What stands for a baseline where none is named.
NO_BASELINE = ("", "none", "n/a", "na", "tbd", "no baseline", "no-baseline", "no comparison", "unspecified", "tba")
#: Fixed value: a quantitative threshold is a comparison or a figure, with or without a unit.
FIGURE = r"(>=|<=|>|<|≥|≤)|(\d+\.?\d*|\.\d+)\s*(%|pp|x|×|percent|points?|fold|σ|sd)?"


def panel_consensus(panel: DataFrame, item: str = "idea_id", judge: str = "judge") -> DataFrame:
    """Mean per axis, composite (mean of the means), number of judges and longest critique; of equally long ones the first judge's."""
    means = [F.round(F.avg(coerce(a, None)), 6).alias(a) for a in AXES]
    first = F.min_by("overall_critique", F.when(F.col("overall_critique").isNotNull(), F.struct(-F.length("overall_critique"), F.col(judge), F.col("overall_critique"))))
    d = panel.groupBy(item).agg(*means, F.countDistinct(judge).alias("n_judges"), first.alias("critique"))
    return d.withColumn("composite", F.round(sum(F.coalesce(F.col(a), F.lit(0.0)) for a in AXES) / len(AXES), 6))


def panel_agreement(panel: DataFrame, item: str = "idea_id") -> DataFrame:
    """``1 - mean(population deviation of an axis) / 4``, not below 0; axes with one score do not count, without any it is 1."""
    sd = [F.when(F.count(coerce(a, None)) >= 2, F.stddev_pop(coerce(a, None))).alias(a) for a in AXES]
    d = panel.groupBy(item).agg(*sd)
    given = F.filter(F.array(*AXES), lambda x: x.isNotNull())
    mean = F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(given), F.lit(0))
    return d.select(item, F.round(F.when(mean.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - mean / 4)), 6).alias("agreement"))


def testable(prediction: Column, baseline: Column) -> Column:
    """A prediction with a quantitative threshold and a baseline that is named; null and blank texts fail."""
    b = F.lower(strip(F.coalesce(baseline, F.lit(""))))
    return ~b.isin(*NO_BASELINE) & F.coalesce(prediction, F.lit("")).rlike("(?iU)" + FIGURE)


def worth_running(confidence: Column, verdict: Column, score: Column) -> Column:
    """Confidence of a half or more, and accepted, or sent back with 4 or more; no verdict passes."""
    return (F.coalesce(confidence, F.lit(0.0)) >= 0.5) & (verdict.isNull() | (verdict == "accept") | ((verdict == "revise") & (F.coalesce(score, F.lit(0.0)) >= 4.0)))


def settled_verdict(verdict: Column, tier: Column, ran: Column, confound: Column, enough_power: Column) -> Column:
    """Verdict after the rules that lower it; the first that applies counts."""
    return (
        F.when(tier == 0, "untestable")
        .when(~ran & (verdict == "yes"), "inconclusive")
        .when((confound >= 0.6) & (verdict == "yes"), "partial")
        .when(~enough_power & (verdict == "yes"), "partial")
        .otherwise(verdict)
    )


def critic_flags(overlap: Column, novelty: Column) -> Column:
    """Axes a critic has to object to: grounding below 0.8, novelty below 0.4."""
    flags = F.array(F.when(overlap < 0.8, F.lit("grounding")), F.when(novelty < 0.4, F.lit("novelty")))
    return F.array_compact(flags)


def loop_ends(verdict: Column, score: Column, iteration: Column, last: int) -> Column:
    """Accepted or 4 or more ends a revision loop; a rejection only in the last round."""
    return (verdict == "accept") | (score >= 4.0) | (iteration >= last)


def evidence_overlap(used: DataFrame, fed: DataFrame, item: str, paper: str = "paper_id", sentence: str = "gap_sentence") -> DataFrame:
    """Share of the used (paper, sentence) pairs that were fed, and what was made up.

    Used pairs count one by one, fed ones as a set; sentences are compared stripped.
    """
    known = fed.select(item, paper, strip(F.col(sentence)).alias("_s")).distinct().withColumn("_hit", F.lit(1))
    d = used.withColumn("_s", strip(F.col(sentence))).join(known, [item, paper, "_s"], "left")
    return d.groupBy(item).agg(F.round(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")), 6).alias("overlap"), F.count(F.lit(1)).alias("n_used"), F.count_if(F.col("_hit").isNull()).alias("n_made_up"))
