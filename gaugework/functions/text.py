"""Column functions over text.  No Python code runs per row.

White space, digits, word characters and letter case follow Unicode; the line
feed is the only line end.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework.functions.constants import any_of, let, words_constant
from gaugework.rules import text as R

#: Index word of a text with a number.
NUMBER_MARK = "has_numbers"
SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"


def rx(pattern: str, flags: str = "") -> str:
    """Pattern with Unicode classes, LF line ends and the given flags."""
    return f"(?{flags}dU){pattern}"


def packed_digits(text: Column) -> Column:
    """Text of digits and dashes only, two characters a byte; sorts as the text does.  Other texts have null."""
    codes = F.translate(text, "-0123456789", "123456789ab")
    return F.when(text.rlike("^[0-9-]*$"), F.unhex(F.when(F.length(text) % 2 == 1, F.concat(codes, F.lit("0"))).otherwise(codes)))


def found(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(rx(pattern, flags))


def group_or_null(text: Column, pattern: str, group: int, flags: str = "") -> Column:
    """Group of the first match; null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, rx(pattern, flags), group), F.lit(""))


def folded(text: Column) -> Column:
    """Lower case, with the four other characters that match a Latin letter in either case."""
    plain = F.when(F.length(text) < F.octet_length(text), F.translate(text, "\u017f\u0131\u0130\u212a", "siik")).otherwise(text)
    return F.lower(plain)


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Letters and digits in a row that every match of ``pattern`` holds, in lower case.

    Groups, classes, escapes and what may be absent are passed over; a pattern of
    alternatives needs nothing.  A text without one of these, folded, cannot match.
    """
    rest = re.sub(r"\\.", "\0", pattern)
    rest = re.sub(r"\[[^\]]*\]", "\0", rest)
    while "(" in rest:
        rest = re.sub(r"\([^()]*\)", "\0", rest)
    if "|" in rest:
        return ()
    rest = re.sub(r".(?:[?*]|\{\d*,?\d*\})", "\0", rest)
    return tuple(dict.fromkeys(re.findall(r"[a-z0-9%]+", rest.lower())))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def clean_text(text: Column) -> Column:
    """Drop control characters, keep at most one blank line, single spaces, no ends."""
    out = F.regexp_replace(text, R.CONTROL, "")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    out = F.regexp_replace(out, " {2,}", " ")
    return strip(out)


def preview(text: Column, n: int = 80) -> Column:
    return F.translate(F.substring(text, 1, n), "\n", " ")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(word_count(text) / F.lit(R.WORDS_PER_TOKEN)).cast("int"))


def keywords(text: Column) -> Column:
    """Sorted distinct index words, with ``has_numbers`` when a number occurs."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9]+"), F.lit(0))
    kept = F.filter(
        F.array_except(tokens, words_constant(R.STOP_WORDS)),
        lambda t: (F.length(t) > 2) | F.array_contains(words_constant(R.SHORT_TERMS), t),
    )
    marker = F.when(found(text, R.NUMBER), F.array(F.lit(NUMBER_MARK)))
    return F.array_sort(
        F.array_union(kept, F.coalesce(marker, F.array().cast("array<string>")))
    )


def pipe_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))


def number_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rx(R.NUMBER)))


def looks_like_table(text: Column) -> Column:
    """Pipes, many numbers, adjacent numbers, or a unit next to two numbers."""

    def mostly_numbers(tokens: Column) -> Column:
        numeric = F.filter(tokens, lambda t: t.rlike(r"^[(),.]*\d([\d,.]*\d)?[(),.]*$"))
        return (F.size(tokens) >= 4) & (
            F.size(numeric) > F.size(tokens) * F.lit(R.TABLE_NUMERIC_SHARE)
        )

    dense = let(words(text), mostly_numbers)
    unit_row = found(text, R.UNIT_WORD, "i") & (number_count(text) >= 2)
    return F.coalesce(
        (F.length(strip(text)) >= 10)
        & ((pipe_count(text) >= 2) | found(text, R.ADJACENT_NUMBERS) | unit_row | dense),
        F.lit(False),
    )


def sentences(text: Column) -> Column:
    """Trimmed sentences and lines, blank ones dropped."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.split(text, r"(?<=[.!?])(?U:\s)+(?=[A-Z\d])")
    lines = F.flatten(F.transform(parts, lambda p: F.split(p, "\n")))
    return F.filter(F.transform(lines, strip), lambda s: s != "")


def segments(
    text: Column,
    max_tokens: int = R.MAX_TOKENS,
    min_tokens: int = R.MIN_TOKENS,
    overlap: int = R.OVERLAP_SENTENCES,
) -> Column:
    """Token-bounded runs of sentences, each starting with the end of the one before.

    The fold carries sentence positions only; the strings are joined once per run.
    """
    most, least = int(max_tokens * R.WORDS_PER_TOKEN), int(min_tokens * R.WORDS_PER_TOKEN)
    return let(sentences(text), lambda parts: _runs(parts, text, most, least, overlap))


def _runs(parts: Column, text: Column, most: int, least: int, overlap: int) -> Column:
    sized = F.transform(parts, lambda s: F.struct(s.alias("s"), word_count(s).alias("w")))

    empty = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(
        empty.alias("cuts"), F.lit(0).alias("first"), F.lit(0).alias("i"),
        F.lit(0).alias("n"), F.array().cast("array<int>").alias("tail"),
    )

    def add(acc, item):
        flush = (acc["n"] + item["w"] > most) & (acc["n"] >= least)
        kept = acc["tail"] if overlap else F.array().cast("array<int>")
        carried = F.aggregate(kept, F.lit(0), lambda t, w: t + w)
        cut = F.struct(acc["first"].alias("a"), acc["i"].alias("b"))
        tail = F.concat(F.when(flush, kept).otherwise(acc["tail"]), F.array(item["w"]))
        return F.struct(
            F.when(flush, F.concat(acc["cuts"], F.array(cut))).otherwise(acc["cuts"]).alias("cuts"),
            F.when(flush, acc["i"] - F.size(kept)).otherwise(acc["first"]).alias("first"),
            (acc["i"] + 1).alias("i"),
            (F.when(flush, carried).otherwise(acc["n"]) + item["w"]).alias("n"),
            F.slice(tail, -F.least(F.size(tail), F.lit(max(overlap, 1))), F.lit(max(overlap, 1))).alias("tail"),
        )

    def finish(acc):
        last = F.struct(acc["first"].alias("a"), acc["i"].alias("b"))
        return F.when(acc["i"] > 0, F.concat(acc["cuts"], F.array(last))).otherwise(empty)

    cuts = F.aggregate(sized, start, add, finish)
    runs = F.transform(
        cuts, lambda c: F.array_join(F.slice(parts, c["a"] + 1, c["b"] - c["a"]), " ")
    )
    return F.when(F.size(parts) > 0, runs).when(strip(text) != "", F.array(text)).otherwise(
        F.array().cast("array<string>")
    )


def has_label(text: Column) -> Column:
    return any_of(F.lower(text), R.LABEL_WORDING)


def has_data_number(text: Column) -> Column:
    return found(text, R.DATA_NUMBER)


def table_text(cells: Column) -> Column:
    """Rows of cells as lines of `` | ``-separated text."""
    return F.array_join(
        F.transform(
            cells,
            lambda row: F.array_join(
                F.transform(
                    row,
                    lambda c: F.replace(
                        strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")
                    ),
                ),
                " | ",
            ),
        ),
        "\n",
    )


def filled_cells(cells: Column) -> Column:
    return F.size(F.filter(F.flatten(cells), lambda c: c.isNotNull() & (strip(c) != "")))


def is_footnote(text: Column, top: Column, page_height: Column) -> Column:
    return F.coalesce(
        (top > page_height * F.lit(R.FOOTNOTE_TOP))
        & (F.length(text) < R.FOOTNOTE_MAX_CHARS)
        & text.rlike(rx(R.FOOTNOTE_START)),
        F.lit(False),
    )


def parse_number(text: Column) -> Column:
    """Number with Indian or Western commas; null when it is not one."""
    return F.regexp_replace(text, "[, ]", "").try_cast("double")


def numeric_density(text: Column) -> Column:

    def share(tokens: Column) -> Column:
        numeric = F.filter(tokens, lambda t: t.rlike(rx(r"\d")))
        return F.coalesce(F.try_divide(F.size(numeric), F.size(tokens)), F.lit(0.0))

    return let(words(text), share)


def slug(text: Column, joiner: str = "_", most: int = 40) -> Column:
    out = F.regexp_replace(F.lower(text), "[^a-z0-9]+", joiner)
    out = F.regexp_replace(out, f"^{joiner}+|{joiner}+$", "")
    return F.substring(out, 1, most)


def file_name(year: Column, report_type: Column, company: Column, report_id: Column) -> Column:
    label = F.upper(F.translate(F.trim(report_type), " -", "__"))
    return F.concat(
        F.concat_ws("_", year.cast("string"), label, slug(company), F.substring(report_id.cast("string"), 1, 8)),
        F.lit(".pdf"),
    )


def plain_number(value: Column, decimals: int) -> Column:
    """Number with grouped thousands and fixed decimals."""
    return F.format_number(value, decimals)


def plain_text(value: Column) -> Column:
    """Shortest text of a number, without an exponent for large ones."""
    return F.when(F.abs(value) < 1e7, value.cast("string")).otherwise(F.format_string("%.1f", value))


def scientific(value: Column) -> Column:
    """Four-decimal scientific notation with a signed two-digit exponent."""
    return F.format_string("%.4e", value)


def figure(value: Column) -> Column:
    """Short form of a ratio: scientific below 0.001, four decimals below 1, else two."""
    size = F.abs(value)
    return (
        F.when(value == 0, F.lit("0"))
        .when(size < 0.001, scientific(value))
        .when(size < 1, F.format_string("%.4f", value))
        .otherwise(plain_number(value, 2))
    )
