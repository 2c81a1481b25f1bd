"""Search results: queries, company, year and type checks, and download choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.constants import any_of, constant, let, words_constant
from gaugework.operators.groups import first_per_group, top_per_group
from gaugework.rules import discovery as R
from gaugework.rules import limits as L


def expand_queries(company_years: DataFrame) -> DataFrame:
    """One query per company-year and template."""
    company, year = F.col("company_name"), F.col("report_year")
    parts = []
    for kind, template in R.TEMPLATES:
        text = F.lit(template)
        for mark, value in (
            ("{company}", company),
            ("{past_year}", (year - 1).cast("string")),
            ("{year_short}", F.right(year.cast("string"), F.lit(2))),
        ):
            text = F.replace(text, F.lit(mark), value)
        parts.append(F.struct(F.lit(kind).alias("query_type"), text.alias("query_source")))
    return company_years.withColumn("_q", F.explode(F.array(*parts))).select(
        *company_years.columns, "_q.*"
    )


def position_score(position: Column) -> Column:
    return F.bround(1.0 / F.greatest(position, F.lit(1)), 4)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-z0-9]", "")


def name_tokens(name: Column) -> Column:
    """Wording that identifies a company: name, aliases, long words, word pairs."""
    lowered = F.lower(name)
    trimmed = F.transform(
        F.split(lowered, r"[\s&.,/()\-]+"), lambda w: F.regexp_replace(w, r"^[.,()&\-]+|[.,()&\-]+$", "")
    )
    words = F.filter(
        trimmed, lambda w: (w != "") & ~F.array_contains(words_constant(R.NAME_STOP_WORDS), w)
    )
    known = constant({k: list(v) for k, v in R.NAME_ALIASES.items()}, "map<string,array<string>>")
    aliases = F.coalesce(F.try_element_at(known, _bare(lowered)), F.array().cast("array<string>"))
    pairs = let(
        words,
        lambda ws: F.transform(
            F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))),
            lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1)),
        ),
    )
    return F.array_distinct(
        F.concat(
            F.array(F.trim(lowered)), aliases,
            F.filter(words, lambda w: F.length(w) >= R.NAME_WORD_MIN),
            F.filter(pairs, lambda p: F.length(p) >= R.NAME_PHRASE_MIN),
        )
    )


def url_core(url: Column) -> Column:
    """Host and path, lower case, without ``www.``, query and fragment."""
    core = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.\-]*://", "")
    return F.replace(F.regexp_replace(core, r"[?#].*$", ""), F.lit("www."), F.lit(""))


def company_matches(name: Column, title: Column, url: Column) -> Column:
    """Is a company token in the title, or its letters and digits in the address?"""
    seen = F.struct(F.lower(title).alias("title"), _bare(url_core(url)).alias("url"))
    tokens = name_tokens(name)
    return let(
        seen,
        lambda s: F.exists(
            tokens,
            lambda t: ((t != "") & F.contains(s["title"], t))
            | ((F.length(t) >= R.NAME_WORD_MIN) & (_bare(t) != "") & F.contains(s["url"], _bare(t))),
        ),
    )


def year_matches(text: Column, year: Column) -> Column:
    """Right fiscal year: a wrong-year sign rules it out, a clear sign accepts it, and
    the bare year counts only outside calendar dates."""
    text = F.lower(text)
    this, last, after = (y.cast("string") for y in (year, year - 1, year + 1))
    two = lambda y: F.right(y, F.lit(2))

    def has(*parts: Column | str) -> Column:
        return F.contains(text, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    wrong = (
        has(this, "-", two(after)) | has(this, "-", after) | has("fy", after)
        | has("fy", two(after)) | has(after)
    )
    clear = (
        has(last, "-", two(this)) | has(last, "_", this) | has(last, "–", two(this))
        | has("fy", this) | has("fy", two(this))
    )
    dated = F.concat(this, F.lit(r"-(0[1-9]|1[0-2])-([0-2][0-9]|3[01])"))
    bare = F.contains(F.regexp_replace(text, dated, F.lit("")), this)
    return ~wrong & (clear | bare)


def report_type(text: Column, with_brsr: bool = False) -> Column:
    """Type named by the wording; null when none is."""
    text = F.lower(text)
    rules = ((("BRSR", R.BRSR_WORDING),) if with_brsr else ()) + R.TYPE_WORDING
    out = F.lit(None).cast("string")
    for kind, wording in reversed(rules):
        out = F.when(any_of(text, wording), F.lit(kind)).otherwise(out)
    return out


def best_per_url(results: DataFrame) -> DataFrame:
    """One row per company-year and address: highest score, first seen on ties."""
    return first_per_group(
        results, ["company_id", "report_year", "url"], [F.col("score").desc(), F.col("seq")]
    )


def judge_results(results: DataFrame, with_brsr: bool = False) -> DataFrame:
    """Add the three checks and the verdict to search results."""
    text = F.concat_ws(" ", "title", "snippet", "url")
    return (
        results.withColumn("company_ok", company_matches(F.col("company_name"), F.col("title"), F.col("url")))
        .withColumn("year_ok", year_matches(text, F.col("report_year")))
        .withColumn("detected_type", report_type(text, with_brsr))
        .withColumn(
            "passed",
            F.col("company_ok") & F.col("year_ok")
            & F.coalesce(F.col("detected_type") == F.col("query_type"), F.lit(False)),
        )
    )


def discovery_summary(judged: DataFrame) -> DataFrame:
    """Passes and drops per company-year, and passes per returned type."""
    return judged.groupBy("company_id", "report_year").agg(
        F.count(F.lit(1)).alias("unique_results"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("dropped"),
        *[
            F.count_if(F.col("passed") & (F.col("query_type") == kind)).alias(f"{kind.lower()}_count")
            for kind in R.TYPE_ORDER
        ],
    )


def discovered(results: DataFrame, report_type_wanted: str | None = None, with_brsr: bool = False) -> DataFrame:
    """Accepted results per company-year and type, best first."""
    kinds = list(R.TYPE_ORDER) + (["BRSR"] if with_brsr else [])
    if report_type_wanted:
        kinds = [k for k in kinds if k.lower() == report_type_wanted.lower()]
        if not kinds:
            raise ValueError(f"unknown report type {report_type_wanted!r}")
    passed = judge_results(best_per_url(results), with_brsr).filter("passed")
    return passed.filter(F.col("query_type").isin(*kinds))


def _candidate_order() -> list[Column]:
    return [F.col("score").desc_nulls_last(), F.col("report_id")]


def chosen_downloads(reports: DataFrame) -> DataFrame:
    """The downloaded report that stands for each (company, year, type)."""
    return first_per_group(
        reports.filter(F.col("status") == "downloaded"),
        ["company_id", "report_year", "report_type"], _candidate_order(),
    )


def next_downloads(reports: DataFrame) -> DataFrame:
    """Best candidate not yet failed for each (company, year, type) without a download."""
    keys = ["company_id", "report_year", "report_type"]
    done = reports.filter(F.col("status") == "downloaded")
    open_ = reports.filter(~F.col("status").isin("downloaded", "failed"))
    return first_per_group(open_.join(done, keys, "left_anti"), keys, _candidate_order())


def retry_candidates(reports: DataFrame) -> DataFrame:
    """Oldest discovered or failed report per (company, year)."""
    return first_per_group(
        reports.filter(F.col("status").isin(*L.RETRY_STATUS)),
        ["company_id", "report_year"], [F.col("discovered_at").asc_nulls_last(), F.col("report_id")],
    )


def retry_worklist(reports: DataFrame, companies: DataFrame) -> DataFrame:
    """Company-years with a failed report, each once."""
    failed = reports.filter(F.col("status") == "failed").select("company_id", "report_year").distinct()
    return failed.join(companies.select("company_id", "company_name"), "company_id")


def first_registered(registered: DataFrame, most: int = 1) -> DataFrame:
    """First ``most`` registered rows per (company, year, type)."""
    return top_per_group(
        registered, ["company_id", "report_year", "report_type"], _candidate_order(), most
    )
