"""Sets of rule terms as bit masks: all terms of all rules are found in a text in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework.functions.constants import constant, let, words_constant

#: Bits used of a 64-bit number; the sign stays free.
BITS = 62


def _trie(terms: Iterable[str]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def _pattern(node: dict) -> str:
    """Regular expression for the longest term below a node of the trie."""
    branches = []
    for c, child in node.items():
        if c:
            literal = c
            while len(child) == 1 and "" not in child:
                (c, child), = child.items()
                literal += c
            rest = _pattern(child)
            branches.append(re.sub(r"([^\w\s])", r"\\\1", literal) + rest)
    if not branches:
        return ""
    either = f"(?:{'|'.join(branches)})"
    return f"{either}?" if "" in node else either


class Terms:
    """Numbered terms; a set of them is a list of numbers with one bit for each."""

    def __init__(self, terms: Iterable[str]):
        self.terms = list(dict.fromkeys(t for t in terms if t))
        self.at = {t: i for i, t in enumerate(self.terms)}
        self.words = max(1, -(-len(self.terms) // BITS))
        # at one place all terms found are beginnings of the longest one
        implied = [[t for t in self.terms if long.startswith(t)] for long in self.terms]
        self._implied = [self.mask(ts) for ts in implied]

    def mask(self, terms: Iterable[str]) -> tuple[int, ...]:
        out = [0] * self.words
        for t in terms:
            if t in self.at:
                out[self.at[t] // BITS] |= 1 << self.at[t] % BITS
        return tuple(out)

    @property
    def type(self) -> str:
        return f"struct<{','.join(f'm{j}:bigint' for j in range(self.words))}>"

    def none(self) -> Column:
        return F.struct(*[F.lit(0).cast("long").alias(f"m{j}") for j in range(self.words)])

    def _merged(self, places: Column, table: Sequence[tuple[int, ...]]) -> Column:
        """Union of the table's masks at ``places`` (from 1), null-safe."""
        return F.struct(*[
            F.coalesce(_union(places, constant([row[j] for row in table], "array<bigint>")), F.lit(0).cast("long")).alias(f"m{j}")
            for j in range(self.words)
        ])

    def found_in(self, text: Column) -> Column:
        """Mask of the terms that a text contains anywhere."""
        if not self.terms:
            return self.none()
        names = words_constant(self.terms)
        longest = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_pattern(_trie(self.terms))}))"), F.lit(1)))
        return let(F.transform(longest, lambda t: F.array_position(names, t).cast("int")), lambda p: self._merged(p, self._implied))

    def equal_to(self, words: Column) -> Column:
        """Mask of the terms that are elements of ``words``."""
        if not self.terms:
            return self.none()
        names = words_constant(self.terms)
        table = [self.mask([t]) for t in self.terms]
        places = F.filter(F.transform(words, lambda w: F.array_position(names, w).cast("int")), lambda i: i > 0)
        return let(places, lambda p: self._merged(p, table))

    def containing(self, words: Column) -> Column:
        """Mask of the terms that contain an element of ``words``."""
        if not self.terms:
            return self.none()
        numbered = constant(list(enumerate(self.terms, 1)), "array<struct<i:int,t:string>>")
        hosts = F.flatten(F.transform(words, lambda w: F.transform(F.filter(numbered, lambda n: F.contains(n["t"], w)), lambda n: n["i"])))
        table = [self.mask([t]) for t in self.terms]
        return let(hosts, lambda p: self._merged(p, table))

    def parts_of_terms(self, words: Column) -> Column:
        """The few of ``words`` that lie inside some term; one search each in all terms at once."""
        every = F.lit("\n".join(self.terms))
        return F.filter(words, lambda w: F.contains(every, w))

    def listed(self, mask: Column) -> Column:
        """The terms of a mask, in order."""
        numbered = constant([(t, i // BITS, 1 << i % BITS) for i, t in enumerate(self.terms)], "array<struct<t:string,w:int,b:bigint>>")
        words = F.array(*[mask[f"m{j}"] for j in range(self.words)])
        return let(words, lambda w: F.transform(F.filter(numbered, lambda n: F.get(w, n["w"]).bitwiseAND(n["b"]) != 0), lambda n: n["t"]))

    def meet(self, a: Column, b: Column) -> Column:
        """Do two masks share a term?"""
        return reduce(Column.__or__, [a[f"m{j}"].bitwiseAND(b[f"m{j}"]) != 0 for j in range(self.words)])

    def shared(self, a: Column, b: Column) -> Column:
        """How many terms two masks share."""
        return reduce(Column.__add__, [F.bit_count(a[f"m{j}"].bitwiseAND(b[f"m{j}"])) for j in range(self.words)])

    def any(self, mask: Column) -> Column:
        return reduce(Column.__or__, [mask[f"m{j}"] != 0 for j in range(self.words)])

    def both(self, a: Column, b: Column) -> Column:
        """Union of two masks."""
        return F.struct(*[a[f"m{j}"].bitwiseOR(b[f"m{j}"]).alias(f"m{j}") for j in range(self.words)])

    def less(self, a: Column, b: Column) -> Column:
        """Terms of one mask that another lacks."""
        return F.struct(*[a[f"m{j}"].bitwiseAND(F.bitwise_not(b[f"m{j}"])).alias(f"m{j}") for j in range(self.words)])


def _union(places: Column, table: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.aggregate(places, zero, lambda a, i: a.bitwiseOR(F.coalesce(F.get(table, i - 1), zero)))
