"""Unit cleaning, metric categories and conversion to canonical units.

The rule tables are small and fixed in size, so they travel as constant maps:
no join and no shuffle, however many records there are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework.functions.constants import constant, let, lookup
from gaugework.rules import units as R


def unit_synonym(unit: Column) -> Column:
    """Unit as the extractor writes it; unknown units are only trimmed."""
    return F.coalesce(lookup(F.trim(F.lower(unit)), R.SYNONYMS, "string"), F.trim(unit))


def clean_unit(unit: Column) -> Column:
    out = F.regexp_replace(F.trim(F.lower(unit)), r"[/\-_]", " ")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.regexp_replace(out, r"^\.+|\.+$", "")


def category_of(name: Column) -> Column:
    """Category of a metric name: exact, else the first part that fits."""
    lowered = F.trim(F.lower(name))
    parts = constant(list(R.CATEGORY_PARTS), "array<struct<part:string,category:string>>")
    fitting = F.filter(parts, lambda p: F.contains(lowered, p["part"]))
    return F.coalesce(lookup(lowered, R.CATEGORY_EXACT, "string"), F.get(fitting, 0)["category"])


def factor_of(category: Column, unit: Column) -> Column:
    """Factor from ``unit`` to the canonical unit of ``category``; null when unknown.

    The whole unit is tried first, then the unit without a known prefix or suffix.
    """

    def find(cleaned: Column) -> Column:
        tries = [cleaned]
        for prefix in R.UNIT_PREFIXES:
            tries.append(F.when(cleaned.startswith(prefix), F.substr(cleaned, F.lit(len(prefix) + 1))))
        for suffix in R.UNIT_SUFFIXES:
            head = F.left(cleaned, F.length(cleaned) - F.lit(len(suffix)))
            tries.append(F.when(cleaned.endswith(suffix), F.trim(head)))
        table = lookup(category, R.FACTORS, "map<string,double>")
        factors = F.transform(
            F.filter(F.array(*tries), lambda t: t.isNotNull()), lambda t: F.try_element_at(table, t)
        )
        return F.get(F.filter(factors, lambda f: f.isNotNull()), 0)

    return let(clean_unit(unit), find)


def normalised(name: Column, value: Column, unit: Column, category: Column | None = None) -> Column:
    """Struct of category, factor, canonical value and unit, and an error text.

    An unknown unit or an impossible percentage is an error on its own row; it
    never stops the job.
    """
    category = category_of(name) if category is None else F.coalesce(category, category_of(name))

    def judge(row: Column) -> Column:
        kind, number = row["category"], row["value"]
        known = lookup(kind, R.CANONICAL, "string")
        error = (
            F.when(known.isNull(), F.lit("unknown category"))
            .when((kind == "percentage") & ~number.between(0, 100), F.lit("percentage out of range"))
            .when(row["factor"].isNull(), F.lit("unknown unit"))
        )
        good = error.isNull()
        return F.when(
            number.isNotNull(),
            F.struct(
                kind.alias("category"),
                F.when(good, row["factor"]).alias("factor"),
                F.when(good, number * row["factor"]).alias("value"),
                F.when(good, known).alias("unit"),
                error.alias("error"),
            ),
        )

    def with_factor(kind: Column) -> Column:
        factor = F.when(kind.isin("count", "percentage"), F.lit(1.0)).otherwise(
            factor_of(kind, F.coalesce(unit, F.lit("")))
        )
        return F.struct(kind.alias("category"), factor.alias("factor"), value.alias("value"))

    return let(let(category, with_factor), judge)
