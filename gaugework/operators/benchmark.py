"""Ratios, comparisons, ranks and summary lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.functions import units as U
from gaugework.functions.constants import lookup
from gaugework.operators.groups import first_per_group, with_group_stats, with_rank
from gaugework.rules import limits as L
from gaugework.session import keep_table

_FIELD = {"display_name": 1, "label": 2, "group": 3, "unit": 4, "ratio_unit": 5}


def described(kpi: Column, field: str) -> Column:
    return lookup(kpi, {row[0]: row[_FIELD[field]] for row in L.COMPARED}, "string")


def by_revenue(kpi: Column) -> Column:
    return F.coalesce(lookup(kpi, {r[0]: r[6] for r in L.COMPARED}, "boolean"), F.lit(True))


def lower_is_better(kpi: Column) -> Column:
    return F.coalesce(lookup(kpi, {r[0]: r[7] for r in L.COMPARED}, "boolean"), F.lit(False))


def under_ceiling(kpi: Column, ratio: Column, profile: str = "compare") -> Column:
    """No ratio above its ceiling; the run profile also drops ratios that are not positive."""
    ceiling = lookup(kpi, L.CEILINGS[profile], "double")
    fine = ratio <= ceiling
    if profile == "run":
        fine = fine & (ratio > 0)
    return ceiling.isNull() | fine


def profile_ratios(
    values: DataFrame, revenue: DataFrame, reported: DataFrame | None = None,
    default_revenue: float | None = None, metrics: tuple[str, ...] = L.COMPARED_NAMES,
    ceilings: str = "compare",
) -> DataFrame:
    """Ratio of every metric of every company-year.

    Counts and percentages stand as they are.  The others are divided by revenue,
    unless the report states the ratio.  Without revenue there is no ratio.
    """
    keys = ["company_id", "report_year"]
    joined = values.filter(F.col("kpi").isin(*metrics) & F.col("value").isNotNull()).join(
        revenue.select(*keys, F.col("value_cr").alias("revenue_cr"), F.col("source").alias("revenue_source")),
        keys, "left",
    )
    if reported is not None:
        joined = joined.join(reported, [*keys, "kpi"], "left")
    else:
        joined = joined.withColumn("reported_ratio", F.lit(None).cast("double"))
    kpi = F.col("kpi")
    cash = F.coalesce("revenue_cr", F.lit(default_revenue)) if default_revenue else F.col("revenue_cr")
    unit = F.when(F.col("unit") != "", F.col("unit")).otherwise(
        F.coalesce(described(kpi, "unit"), F.lit(""))
    )
    whole = ~by_revenue(kpi)
    stated = F.col("reported_ratio").isNotNull()
    return (
        joined.withColumn("_n", U.normalised(kpi, F.col("value"), unit))
        .filter(F.col("_n.error").isNull())
        .withColumn(
            "ratio",
            F.when(whole, F.col("_n.value"))
            .when(stated, F.col("reported_ratio"))
            .when(cash > 0, F.col("_n.value") / cash),
        )
        .filter(F.col("ratio").isNotNull() & under_ceiling(kpi, F.col("ratio"), ceilings))
        .select(
            *keys, "kpi",
            described(kpi, "display_name").alias("display_name"),
            described(kpi, "group").alias("group"),
            F.col("_n.value").alias("normalized_value"),
            F.coalesce(described(kpi, "unit"), F.col("_n.unit")).alias("normalized_unit"),
            cash.alias("revenue_cr"),
            "ratio",
            F.coalesce(described(kpi, "ratio_unit"), F.lit("")).alias("ratio_unit"),
            F.when(whole, F.lit("absolute"))
            .when(stated, F.lit("reported_ratio"))
            .otherwise(F.lit("computed"))
            .alias("ratio_source"),
            F.when(~whole & stated, F.col("reported_ratio") / L.RUPEES_PER_CRORE).alias("reported_ratio_raw"),
        )
    )


def plain_ratio(kpi: Column, value: Column, revenue: Column) -> Column:
    """Dashboard form: the raw value where there is no positive revenue."""
    return F.when(by_revenue(kpi) & (revenue > 0), value / revenue).otherwise(value)


def compare(entries: DataFrame, by: str = "comparison_id") -> DataFrame:
    """Winner, loser and gap per (comparison, metric) with two entries or more.

    ``entries``: comparison, kpi, label, ratio.  Groups of any size are reduced by
    partial aggregates; the entries themselves stay rows.
    """
    low = lower_is_better(F.col("kpi"))
    first = F.struct(F.col("ratio"), F.col("label"))
    stats = entries.groupBy(by, "kpi").agg(
        F.count(F.lit(1)).alias("entries"),
        F.min("ratio").alias("lowest"),
        F.max("ratio").alias("highest"),
        F.min(first)["label"].alias("_low_label"),
        F.min(F.struct((-F.col("ratio")).alias("r"), F.col("label")))["label"].alias("_high_label"),
    )
    best = F.when(low, F.col("lowest")).otherwise(F.col("highest"))
    worst = F.when(low, F.col("highest")).otherwise(F.col("lowest"))
    return stats.filter(F.col("entries") >= 2).select(
        by, "kpi",
        described(F.col("kpi"), "display_name").alias("display_name"),
        described(F.col("kpi"), "group").alias("group"),
        described(F.col("kpi"), "ratio_unit").alias("unit"),
        "entries",
        F.when(low, F.col("_low_label")).otherwise(F.col("_high_label")).alias("winner"),
        best.alias("best"), worst.alias("worst"),
        F.when(worst > 0, F.abs(best - worst) / worst * 100).otherwise(F.lit(0.0)).alias("pct_gap"),
        F.when(low, F.col("_high_label")).otherwise(F.col("_low_label")).alias("loser"),
    )


def comparable(entries: DataFrame, by: str = "comparison_id", profile: str = "dashboard") -> DataFrame:
    """Entries of the (comparison, metric) groups whose every ratio is in range."""
    ceiling = lookup(F.col("kpi"), L.CEILINGS[profile], "double")
    fine = (F.col("ratio") >= 0) & (ceiling.isNull() | (F.col("ratio") <= ceiling))
    groups = entries.groupBy(by, "kpi").agg(F.every(fine).alias("_all")).filter("_all")
    return entries.join(groups, [by, "kpi"], "left_semi")


def win_counts(entries: DataFrame, comparisons: DataFrame, by: str = "comparison_id") -> DataFrame:
    """Metrics won per label; labels that won nothing stay with 0."""
    labels = entries.select(by, "label").distinct()
    wins = comparisons.groupBy(by, F.col("winner").alias("label")).agg(F.count(F.lit(1)).alias("wins"))
    return labels.join(wins, [by, "label"], "left").withColumn(
        "wins", F.coalesce("wins", F.lit(0).cast("long"))
    )


def overall_winner(wins: DataFrame, by: str = "comparison_id") -> DataFrame:
    """Label with most wins; the first label on ties."""
    return first_per_group(wins, [by], [F.col("wins").desc(), F.col("label")])


def rank_entries(ratios: DataFrame) -> DataFrame:
    """Rank, percentile and gap to the leader per (metric, year), best first.

    The ratios are worked out once and staged: ranks, leaders and the result all read them.
    """
    keys = ["kpi", "report_year"]
    ratios = keep_table(ratios, "ratios")
    low = lower_is_better(F.col("kpi"))
    ranked = with_rank(ratios, keys, "ratio", "rank", "percentile", descending=~low)
    led = with_group_stats(ranked, keys, _low=F.min("ratio"), _high=F.max("ratio"))
    leader = F.when(low, F.col("_low")).otherwise(F.col("_high"))
    return led.withColumn("gap_to_leader", F.col("ratio") - leader).drop("_low", "_high")


def share_scores(entries: DataFrame, by: str = "comparison_id") -> DataFrame:
    """Share of the comparison's total, 0-100, turned round where lower is better.

    The entries are worked out once and staged: totals and scores both read them.
    """
    entries = keep_table(entries, "entries")
    shared = with_group_stats(entries, [by, "kpi"], _total=F.sum("ratio"))
    part = F.col("ratio") / F.col("_total")
    score = F.when(lower_is_better(F.col("kpi")), 100 * (1 - part)).otherwise(100 * part)
    return shared.withColumn(
        "score", F.when(F.col("_total") == 0, F.lit(50.0)).otherwise(F.bround(score, 1))
    ).drop("_total")


def comparison_lines(comparisons: DataFrame) -> DataFrame:
    """One sentence per comparison; the leader follows the metric's direction."""
    return comparisons.withColumn(
        "line",
        F.format_string(
            "%s leads with %s %s (%s%% better than %s).",
            F.split("winner", " FY")[0], T.scientific(F.col("best")), F.col("unit"),
            F.format_string("%.1f", "pct_gap"), F.split("loser", " FY")[0],
        ),
    )


def overall_lines(wins: DataFrame, comparisons: DataFrame, by: str = "comparison_id") -> DataFrame:
    total = comparisons.groupBy(by).agg(F.count(F.lit(1)).alias("metrics"))
    return overall_winner(wins, by).join(total, by).withColumn(
        "line",
        F.format_string(
            "Overall: %s has lower ESG intensity on %d of %d metrics benchmarked.",
            F.split("label", " FY")[0], F.col("wins"), F.col("metrics"),
        ),
    )


def fact_lines(ratios: DataFrame) -> DataFrame:
    """One line of facts per company-year and metric."""
    ratio = F.when(F.col("ratio") < 0.001, T.scientific(F.col("ratio"))).otherwise(
        F.format_string("%.4f", "ratio")
    )
    source = F.when(F.col("ratio_source").contains("reported"), F.lit("reported in PDF")).otherwise(
        F.lit("computed")
    )
    return ratios.withColumn(
        "line",
        F.format_string(
            "%s: absolute=%s %s | intensity=%s %s [%s]",
            F.col("display_name"), T.plain_number(F.col("normalized_value"), 2),
            F.col("normalized_unit"), ratio, F.col("ratio_unit"), source,
        ),
    )
