"""Rule values as constant columns, folded once by the optimizer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dict):
        return "map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in value.items()) + ")"
    if isinstance(value, tuple):
        return "struct(" + ", ".join(_sql(v) for v in value) + ")"
    if isinstance(value, list):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def constant(value: object, ddl: str) -> Column:
    """A nested constant as one foldable expression: dict is a map, list an array,
    tuple a struct."""
    return F.expr(f"CAST({_sql(value)} AS {ddl})")


def words_constant(words) -> Column:
    return constant(list(words), "array<string>")


def lookup(key: Column, table: dict, value_type: str) -> Column:
    """Value of ``key`` in a rule dictionary, null when absent."""
    return F.try_element_at(constant(table, f"map<string,{value_type}>"), key)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Keeps expressions small: a repeated sub-expression would be generated each time.
    """
    return F.get(F.transform(F.array(value), body), 0)


def boxed(value: Column) -> Column:
    """Keep a large CASE out of generated code, where it would pass the method size limit."""
    return let(F.lit(0), lambda _: value)


def any_of(text: Column, terms) -> Column:
    """Does ``text`` (lower case) contain one of ``terms``; stops at the first hit."""
    hit = F.lit(False)
    for term in reversed([t.lower() for t in terms]):
        hit = text.contains(term) | hit
    return hit
