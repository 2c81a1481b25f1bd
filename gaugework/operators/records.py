"""Stored records: best per key, fallbacks, gaps, guarded writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import units as U
from gaugework.functions.constants import constant, let, lookup
from gaugework.operators.groups import first_per_group, firsts_per_group, newest_first
from gaugework.rules import limits as L
from gaugework.rules.catalogue import METRICS, Metric

KEY = ("company_id", "report_year", "kpi")


def type_priority(report_type: Column) -> Column:
    return F.coalesce(lookup(report_type, L.TYPE_PRIORITY, "int"), F.lit(L.OTHER_PRIORITY))


def plausible(kpi: Column, value: Column, profile: str = "store") -> Column:
    """Is the value in its metric's range?  Metrics without a range always pass."""
    table = {k: list(v) for k, v in L.PLAUSIBLE[profile].items()}
    bounds = F.try_element_at(constant(table, "map<string,array<double>>"), kpi)
    return bounds.isNull() | value.between(F.get(bounds, 0), F.get(bounds, 1))


def plausible_normalised(kpi: Column, value: Column, unit: Column, profile: str = "run") -> Column:
    """As ``plausible``, on the canonical value; an unknown unit fails."""
    names = list(L.PLAUSIBLE[profile])
    canonical = U.normalised(kpi, value, unit)["value"]
    fits = let(canonical, lambda v: plausible(kpi, v, profile))
    return ~kpi.isin(*names) | F.coalesce(fits, F.lit(False))


def expected_unit(kpi: Column, metrics: Sequence[Metric] = METRICS) -> Column:
    return lookup(kpi, {m.name: m.expected_unit for m in metrics}, "string")


def best_per_key(
    records: DataFrame,
    reports: DataFrame,
    profile: str = "store",
    gate_first: bool = False,
    least_confidence: float | None = L.READ_CONFIDENCE,
    tie: Sequence[str] = ("record_id",),
) -> DataFrame:
    """Best record per (company, year, metric): report type, then newest.

    By default the confidence and range gates follow the pick, so a poor best record
    leaves its key empty; ``gate_first`` lets the next record step in.
    """
    confidence = F.coalesce("confidence", F.lit(0.0))
    good = plausible(F.col("kpi"), F.col("value"), profile)
    if least_confidence is not None:
        good = good & (confidence >= least_confidence)
    joined = records.filter(F.col("value").isNotNull()).join(
        reports.select("report_id", "report_type"), "report_id"
    )
    if gate_first:
        joined = joined.filter(good)
    order = [
        type_priority(F.col("report_type")), F.col("extracted_at").desc_nulls_first(),
        *[F.col(t) for t in tie],
    ]
    best = first_per_group(joined, KEY, order)
    return best.filter(good).select(
        *KEY, "value",
        F.coalesce("unit", expected_unit(F.col("kpi"))).alias("unit"),
        F.col("extraction_method").alias("method"),
        confidence.alias("confidence"),
        F.coalesce("report_type", F.lit("unknown")).alias("report_type"),
        "report_id",
    )


def best_revenue(reports: DataFrame) -> DataFrame:
    """Stored revenue per (company, year): report type, then newest report."""
    order = [type_priority(F.col("report_type")), F.col("created_at").desc_nulls_first(), F.col("report_id")]
    return first_per_group(
        reports.filter(F.col("revenue_cr").isNotNull()), ["company_id", "report_year"], order
    ).select(
        "company_id", "report_year", "report_id", F.col("revenue_cr").alias("value_cr"),
        F.coalesce("revenue_unit", F.lit("INR_Crore")).alias("raw_unit"),
        F.coalesce("revenue_source", F.lit("db")).alias("source"),
        F.lit(L.CACHED_REVENUE_CONFIDENCE).alias("confidence"),
        F.lit("cached").alias("pattern_name"),
    )


def usable_reports(reports: DataFrame, need_file: bool = False) -> DataFrame:
    kept = reports.filter(F.col("status").isin(*L.USABLE_STATUS))
    return kept.filter(F.col("file_path").isNotNull()) if need_file else kept


def best_report(reports: DataFrame, need_file: bool = False) -> DataFrame:
    """Report to work from per (company, year)."""
    order = [type_priority(F.col("report_type")), F.col("created_at").desc_nulls_first(), F.col("report_id")]
    return first_per_group(usable_reports(reports, need_file), ["company_id", "report_year"], order)


def latest_parse(parsed: DataFrame) -> DataFrame:
    return first_per_group(
        parsed, ["report_id"], [F.col("parsed_at").desc_nulls_first(), F.col("parsed_id")]
    )


def latest_validated(records: DataFrame, tie: Sequence[str] = ("record_id",)) -> DataFrame:
    return first_per_group(
        records.filter("is_validated"), KEY,
        [F.col("extracted_at").desc_nulls_first(), *[F.col(t) for t in tie]],
    )


def wanted(company_years: DataFrame, kpis: Sequence[str]) -> DataFrame:
    """(company, year, metric) grid over a fixed metric list: one row per metric."""
    return company_years.select(
        "company_id", "report_year",
        F.explode(constant(list(kpis), "array<string>")).alias("kpi"),
    ).distinct()


def missing(grid: DataFrame, have: DataFrame) -> DataFrame:
    return grid.join(have, list(KEY), "left_anti")


def first_report_with_value(
    extracted: DataFrame, reports: DataFrame, profile: str = "run", tie: Sequence[str] = ("record_id",)
) -> DataFrame:
    """Each metric from the first report, by type then newest, that has a believable value."""
    joined = extracted.join(
        usable_reports(reports).select("report_id", "report_type", "created_at"), "report_id"
    ).filter(
        F.col("value").isNotNull()
        & plausible_normalised(F.col("kpi"), F.col("value"), F.col("unit"), profile)
    )
    order = [
        type_priority(F.col("report_type")), F.col("created_at").desc_nulls_first(),
        F.col("report_id"), *[F.col(t) for t in tie],
    ]
    return first_per_group(joined, KEY, order)


_PICKED = ("value", "unit", "method", "confidence")


def _fields(names: Sequence[str]) -> list[Column]:
    return [F.col({"method": "extraction_method"}.get(n, n)).alias(n) for n in names]


def _stored_pick(tie: Sequence[str], fields: Sequence[str] = _PICKED) -> tuple:
    """The pick of :func:`best_per_key`, before its gates; ``_priority`` is null without a report."""
    order = [F.col("_priority").alias("p"), newest_first(F.col("extracted_at")).alias("t"), *tie]
    return F.col("_priority").isNotNull(), order, _fields(fields)


def _believed(pick: str, profile: str, least_confidence: float = L.READ_CONFIDENCE) -> Column:
    """The pick where it passes the gates of :func:`best_per_key`, else null."""
    sure = F.coalesce(f"{pick}.confidence", F.lit(0.0)) >= least_confidence
    return F.when(plausible(F.col("kpi"), F.col(f"{pick}.value"), profile) & sure, F.col(pick))


def stored_and_fresh(
    records: DataFrame, reports: DataFrame, profile: str = "store", run_profile: str = "run",
    tie: Sequence[str] = ("record_id",), fields: Sequence[str] = _PICKED,
) -> DataFrame:
    """:func:`best_per_key` as ``stored`` and :func:`first_report_with_value` as ``fresh`` of the same records.

    One row per key with either, each a struct of ``fields`` or null; records are moved once for both.
    """
    about = reports.select(
        "report_id", type_priority(F.col("report_type")).alias("_priority"),
        F.when(F.col("status").isin(*L.USABLE_STATUS), F.struct(newest_first(F.col("created_at")).alias("t"))).alias("_usable"),
    )
    joined = records.filter(F.col("value").isNotNull()).join(about, "report_id")
    fresh = F.col("_usable").isNotNull() & plausible_normalised(
        F.col("kpi"), F.col("value"), F.col("unit"), run_profile
    )
    order = [F.col("_priority").alias("p"), F.col("_usable.t").alias("t"), F.col("report_id"), *tie]
    stored = _stored_pick(tie, tuple(dict.fromkeys((*fields, "confidence"))))
    picked = firsts_per_group(joined, KEY, stored=stored, fresh=(fresh, order, _fields(fields)))
    return picked.withColumn("stored", _believed("stored", profile)).filter(
        F.col("stored").isNotNull() | F.col("fresh").isNotNull()
    )


def stored_and_validated(
    records: DataFrame, reports: DataFrame, profile: str = "store", tie: Sequence[str] = ("record_id",)
) -> DataFrame:
    """:func:`best_per_key` as ``stored`` and :func:`latest_validated` as ``validated``, of records with a value.

    One row per key with either, each a struct or null; records are moved once for both.
    """
    about = reports.select("report_id", type_priority(F.col("report_type")).alias("_priority"))
    joined = records.filter(F.col("value").isNotNull()).join(about, "report_id", "left")
    order = [newest_first(F.col("extracted_at")).alias("t"), *tie]
    picked = firsts_per_group(
        joined, KEY, stored=_stored_pick(tie), validated=(F.col("is_validated"), order, _fields(_PICKED))
    )
    return picked.withColumn("stored", _believed("stored", profile)).filter(
        F.col("stored").isNotNull() | F.col("validated").isNotNull()
    )


def merge_by_precedence(*sources: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per key from the first source that has it; sources are keyed uniquely."""
    united = None
    for place, source in enumerate(sources):
        part = source.withColumn("_place", F.lit(place))
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    return first_per_group(united, keys, [F.col("_place")]).drop("_place")


def storable(
    new: DataFrame, stored: DataFrame, profile: str = "store", metrics: Sequence[Metric] = METRICS
) -> DataFrame:
    """New records worth appending: believable, not yet stored, each once.

    Of equal values the most confident record stays, then the first by unit and method.
    """
    same = ["company_id", "report_id", "kpi", "report_year", "value"]
    confidence = F.coalesce("confidence", F.lit(L.DEFAULT_CONFIDENCE))
    fresh = (
        new.filter(F.col("value").isNotNull() & plausible(F.col("kpi"), F.col("value"), profile))
        .filter(F.col("kpi").isin(*[m.name for m in metrics]))
        .withColumn("confidence", confidence)
        .withColumn("unit", F.coalesce("unit", expected_unit(F.col("kpi"), metrics)))
        .withColumn("is_validated", confidence >= L.VALID_CONFIDENCE)
        .join(stored.select(*same), same, "left_anti")
    )
    order = [F.col("confidence").desc()] + [F.col(c).asc_nulls_last() for c in ("unit", "extraction_method") if c in new.columns]
    return first_per_group(fresh, same, order)


def found_of_requested(values: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """How many of the requested metrics have a value, per key, with the summary text."""
    found = F.count_distinct(F.when(F.col("value").isNotNull() & F.col("kpi").isin(*names), F.col("kpi")))
    return values.groupBy(*keys).agg(found.alias("found")).select(
        *keys, "found", F.lit(len(names)).alias("requested"),
        F.concat(F.col("found").cast("string"), F.lit(f"/{len(names)}")).alias("summary"),
    )


def fill_revenue(reports: DataFrame, found: DataFrame) -> DataFrame:
    """Write value, unit and source together, only where a report has no revenue."""
    new = found.select(
        "report_id", F.col("value_cr").alias("_v"), F.col("raw_unit").alias("_u"),
        F.col("source").alias("_s"),
    )
    empty = F.col("revenue_cr").isNull() & F.col("_v").isNotNull()
    return (
        reports.join(new, "report_id", "left")
        .withColumn("revenue_unit", F.when(empty, F.col("_u")).otherwise(F.col("revenue_unit")))
        .withColumn("revenue_source", F.when(empty, F.col("_s")).otherwise(F.col("revenue_source")))
        .withColumn("revenue_cr", F.coalesce("revenue_cr", "_v"))
        .select(*reports.columns)
    )


def derive_missing_total(values: DataFrame) -> DataFrame:
    """Total emissions per key from canonical scope values, confidence times 0.99."""
    from gaugework.operators.extraction import derive_total

    canonical = values.withColumn(
        "_canonical", U.normalised(F.col("kpi"), F.col("value"), F.col("unit"))["value"]
    )
    scoped = canonical.withColumn(
        "_canonical",
        F.when(F.col("kpi") == "total_ghg_emissions", F.col("value")).otherwise(F.col("_canonical")),
    )
    return derive_total(
        scoped.filter(F.col("kpi").isin(*L.MILLION_SCALE_METRICS)),
        ["company_id", "report_year"], "_canonical", damp=0.99,
    ).withColumnRenamed("_canonical", "value")
