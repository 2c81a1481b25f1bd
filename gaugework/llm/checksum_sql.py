"""CRC-32 for the SQL of a single-node engine that has no such function."""

from __future__ import annotations


def crc_table_sql() -> str:
    """A query of one row with one list: the remainder of each byte."""
    return """
      SELECT list(list_reduce(list_prepend(i, [x::BIGINT FOR x IN range(8)]),
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i)
      FROM (SELECT unnest(range(256))::BIGINT AS i)"""


def crc32_sql(text: str, table: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text`` by the list ``table``; both are column expressions."""
    codes = f"[('0x' || substr(hex({text}), 2 * k + 1, 2))::BIGINT FOR k IN range(0, strlen({text}))]"
    step = f"lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), {step}))"
