"""Registration and downloads of reports as a log of status changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.constants import lookup
from gaugework.operators.groups import with_position
from gaugework.rules import limits as L


def stage(status: Column) -> Column:
    """How far a status is; an unknown one comes first."""
    return F.coalesce(lookup(status, {s: i for i, s in enumerate(L.STATUS_ORDER)}, "int"), F.lit(-1))


def may_follow(before: Column, status: Column) -> Column:
    """Is the change allowed?  A report's first status has null before it."""
    allowed = [F.concat_ws(">", F.lit(a), F.lit(b)) for a, nexts in L.STATUS_CHANGES.items() for b in nexts]
    change = F.concat_ws(">", F.coalesce(before, F.lit(L.NO_STATUS)), F.coalesce(status, F.lit("?")))
    return change.isin(*allowed)


def judged_changes(events: DataFrame) -> DataFrame:
    """Every event of the log (report_id, ts, status) with the status before it and whether it may follow.

    Events are numbered per report by time, then by how far the status is, and joined to
    their neighbour, so a report may have any number of them.  Repeated events stay
    repeated.  An event without a report is left out.
    """
    order = ["ts", "_stage", "status"]
    narrow = events.select("report_id", "ts", "status", stage(F.col("status")).alias("_stage"))
    placed = with_position(narrow, ["report_id"], order, "change_no")
    earlier = placed.select("report_id", (F.col("change_no") + 1).alias("change_no"), F.col("status").alias("before"))
    return placed.join(earlier, ["report_id", "change_no"], "left").select(
        "report_id", "change_no", "ts", "before", "status", may_follow(F.col("before"), F.col("status")).alias("allowed")
    )


def folded(events: DataFrame) -> DataFrame:
    """Last status per report, its changes, and how many of them are not allowed, with the first such."""
    bad = F.when(~F.col("allowed"), F.struct("change_no", F.concat_ws(">", F.coalesce("before", F.lit(L.NO_STATUS)), "status").alias("what")))
    return judged_changes(events).groupBy("report_id").agg(
        F.max_by("status", "change_no").alias("status"),
        F.count(F.lit(1)).alias("changes"),
        F.count_if(~F.col("allowed")).alias("refused"),
        F.min(bad)["what"].alias("first_refused"),
    )


def type_outcomes(company_years: DataFrame, reports: DataFrame, kinds: Sequence[str] = L.REPORT_KINDS) -> DataFrame:
    """What came of each report type of a company-year: one download, none found, all failed, or still open.

    The download that counts is the best one by score.  Candidates of a type are reduced
    by partial aggregates, however many there are.
    """
    keys = ["company_id", "report_year", "report_type"]
    done = F.col("status").isin(*L.USABLE_STATUS)
    best = F.min(F.when(done, F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), F.col("report_id"))))
    tried = reports.filter(F.col("report_type").isin(*kinds)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        best["report_id"].alias("report_id"),
    )
    grid = company_years.select("company_id", "report_year").distinct().withColumn(
        "report_type", F.explode(F.array(*[F.lit(k) for k in kinds]))
    )
    zero = F.lit(0).cast("long")
    return grid.join(tried, keys, "left").select(
        *keys, F.coalesce("candidates", zero).alias("candidates"), F.coalesce("failed", zero).alias("failed"), "report_id",
        F.when(F.col("candidates").isNull(), "not_found").when(F.col("report_id").isNotNull(), "downloaded")
        .when(F.col("candidates") == F.col("failed"), "failed").otherwise("open").alias("outcome"),
    )
