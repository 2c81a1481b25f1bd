"""Judging of chunks by all rules, in numpy on Arrow batches of chunk features.

A batch holds what is known of some thousand chunks: masks of the rule terms found and a few
flags.  A rule is then a handful of bit operations on whole columns; the same in Spark
expressions would be interpreted node by node for every chunk and rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gaugework.functions.masks import BITS, Terms
from gaugework.rules import relevance as R

FLAGS = ("_digit", "_unit", "_data", "_unit_number", "_real_table")
#: What a score is made of.
PARTS = {
    "kw_score": "double", "exact_bonus": "double", "unit_bonus": "double", "numeric_bonus": "double", "data_bonus": "double",
    "ans_boost": "double", "answerable": "boolean", "type_mult": "double", "is_real_table": "boolean", "no_numeric_pen": "double",
    "no_unit_pen": "double", "penalty": "double",
}


def _meet(masks: np.ndarray, rule: np.ndarray) -> np.ndarray:
    return (masks & rule).any(axis=1)


def _shared(masks: np.ndarray, rule: np.ndarray) -> np.ndarray:
    return np.bitwise_count(masks & rule).sum(axis=1).astype(np.int64)


def _found_in(texts: pa.StringArray, terms: Terms) -> np.ndarray:
    """Masks of the terms that each text contains anywhere; a null text contains none."""
    out = np.zeros((len(texts), terms.words), np.int64)
    for i, term in enumerate(terms.terms):
        rows = np.flatnonzero(pc.fill_null(pc.match_substring(texts, term), False).to_numpy(zero_copy_only=False))
        out[rows, i // BITS] |= 1 << i % BITS
    return out


def _first_of(masks: np.ndarray, terms: Terms, wanted: Sequence[str]) -> np.ndarray:
    """Number (from 1) of the first of ``wanted`` that each mask holds, 0 for none."""
    out = np.zeros(len(masks), np.int64)
    for i, t in reversed(list(enumerate(wanted, 1))):
        out[_meet(masks, np.array(terms.mask([t]), np.int64))] = i
    return out


class WordMasks:
    """Masks of first words for lists of keywords; every distinct keyword is looked up once per batch."""

    def __init__(self, terms: Terms):
        self.terms = terms
        self.every = "\n".join(terms.terms)
        self.part = re.compile("|".join(["has_numbers", *map(re.escape, terms.terms)]))

    def of(self, keywords: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per row: first words inside a keyword, around one, equal to one; and whether it has a number."""
        n, width = len(keywords), self.terms.words
        counts = np.nan_to_num(keywords.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        coded = keywords.flatten().dictionary_encode()
        values = coded.dictionary.to_pylist()
        masks = np.zeros((len(values) + 1, 3 * width + 1), np.int64)
        for i, k in enumerate(values):
            if k in self.every or self.part.search(k):  # most are numbers and touch no first word
                masks[i] = self._masks_of(k)
        codes = coded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)
        out = np.zeros((n, 3 * width + 1), np.int64)
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            out[some] = np.bitwise_or.reduceat(masks[codes], starts, axis=0)
        return out[:, :width], out[:, width : 2 * width], out[:, 2 * width : 3 * width], out[:, -1] != 0

    def _masks_of(self, keyword: str) -> tuple[int, ...]:
        inside = self.terms.mask(t for t in self.terms.terms if t in keyword)
        # a keyword of one letter is no part of a word
        around = self.terms.mask(t for t in self.terms.terms if keyword in t) if len(keyword) > 1 else self.terms.mask(())
        exact = self.terms.mask([keyword]) if len(keyword) > 1 else self.terms.mask(())
        return (*inside, *around, *exact, int("has_numbers" in keyword))


class Judge:
    """All rules over batches of chunk features; rows of (chunk, rule) come out."""

    def __init__(self, rules: Sequence[dict], terms: Terms, first: Terms, layers, strict_exclude: bool, full: bool, carried: Sequence[str]):
        self.rules, self.terms, self.first = rules, terms, first
        self.layers, self.strict_exclude, self.full, self.carried = layers, strict_exclude, full, list(carried)
        self.names = pa.array([r["kpi"] for r in rules], pa.string())
        self.sets = [{s: np.array(terms.mask(r[s]), np.int64) for s in ("must", "exclude", "fallback", "penalty", "hints", "phrases")} for r in rules]
        self.firsts = [[np.array(layer, np.int64) for layer in ls] for ls in layers]

    def _features(self, batch: pa.RecordBatch, words: WordMasks) -> dict:
        inside, around, exact, numbered = words.of(batch.column("keywords"))
        f = {c: batch.column(c).fill_null(False).to_numpy(zero_copy_only=False) for c in FLAGS}
        near = inside | around
        return f | {
            "hits": _found_in(batch.column("_lower"), self.terms), "inside": inside, "near": near, "exact": exact, "part": near & ~exact,
            "_indexed_number": numbered, "length": batch.column("_length").to_numpy(zero_copy_only=False),
            "factor": batch.column("_factor").to_numpy(zero_copy_only=False),
        }

    def _strict(self, k: int, hits: np.ndarray, strict_exclude: bool) -> np.ndarray:
        clean = ~_meet(hits, self.sets[k]["exclude"])
        if not self.rules[k]["must"]:
            return clean
        needed = _meet(hits, self.sets[k]["must"])
        return needed & clean if strict_exclude else needed

    def _score(self, k: int, f: dict) -> dict[str, np.ndarray]:
        own, hits = self.sets[k], f["hits"]
        counted = lambda masks: sum((_shared(masks, layer) for layer in self.firsts[k]), np.zeros(len(hits), np.int64))
        word = (counted(f["exact"]) * R.EXACT_WORD + counted(f["part"]) * R.PART_WORD) / f["length"]
        phrase = _shared(hits, own["phrases"]) * R.PHRASE_BONUS
        unit = np.where(_meet(hits, own["hints"]), R.UNIT_BONUS, 0.0)
        numeric = np.where(f["_digit"], R.NUMERIC_BONUS, 0.0)
        data = np.where(f["_data"], R.DATA_BONUS, 0.0)
        named = _meet(hits, own["must"])
        answerable = named & f["_digit"] & f["_unit"]
        answer = np.where(answerable, R.ANSWER_BONUS, 0.0)
        base = (word + phrase + unit + numeric + data + answer) * f["factor"]
        no_number = np.where(f["_digit"], 0.0, R.NO_NUMBER_PENALTY)
        no_unit = np.where(named & ~f["_unit"], R.NO_UNIT_PENALTY, 0.0)
        penalty = _shared(hits, own["penalty"]) * R.TERM_PENALTY
        falls = _meet(hits, own["fallback"]) & f["_unit_number"]
        tier = np.where(self._strict(k, hits, self.strict_exclude), 0, np.where(falls, 1, 2)).astype(np.int32)
        score = np.maximum(0.0, base - no_number - no_unit - penalty)
        out = {"tier": tier, "score": score}
        if self.full:
            out |= {
                "kw_score": word, "exact_bonus": phrase, "unit_bonus": unit, "numeric_bonus": numeric, "data_bonus": data, "ans_boost": answer,
                "answerable": answerable, "type_mult": f["factor"], "is_real_table": f["_real_table"], "no_numeric_pen": no_number,
                "no_unit_pen": no_unit, "penalty": penalty,
            }
            out |= {f"_h{j}": hits[:, j] for j in range(self.terms.words)} | {f"_n{j}": f["near"][:, j] for j in range(self.first.words)}
        return out

    def _scored(self, batch: pa.RecordBatch, words: WordMasks, everything: bool) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
        """Rows of the batch that each rule takes, and what the rules say of them one after the other."""
        f, taken, made = self._features(batch, words), [], []
        for k in range(len(self.rules)):
            first = self.firsts[k][0] if self.firsts[k] else np.zeros(self.first.words, np.int64)
            rows = np.arange(batch.num_rows) if everything else np.flatnonzero(f["_indexed_number"] | _meet(f["inside"], first))
            taken.append(rows)
            made.append(self._score(k, {c: v[rows] for c, v in f.items()}))
        return taken, {c: np.concatenate([m[c] for m in made]) for c in made[0]}

    def scored(self, batch: pa.RecordBatch, words: WordMasks, everything: bool = False) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
        """Rows of the batch that each rule takes, by the keyword index or all, and what the rules say of them."""
        return self._scored(batch, words, everything)

    def candidates(self, batches: Iterator[pa.RecordBatch], everything: bool = False) -> Iterator[pa.RecordBatch]:
        """Every (chunk, rule) whose chunk has a number or a first word of the rule in its index."""
        if not self.rules:
            return
        words = WordMasks(self.first)
        for batch in batches:
            taken, made = self._scored(batch, words, everything)
            kpi = self.names.take(pa.array(np.repeat(np.arange(len(taken)), [len(t) for t in taken])))
            rows = pa.array(np.concatenate(taken))
            columns = {c: batch.column(c).take(rows) for c in self.carried} | {"kpi": kpi} | {c: pa.array(v) for c, v in made.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def listed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every chunk with the rules that take it (by number), their tiers and scores as lists."""
        words = WordMasks(self.first)
        for batch in batches:
            taken, made = self._scored(batch, words, False) if self.rules else ([], {"tier": np.zeros(0, np.int32), "score": np.zeros(0)})
            rows = np.concatenate([np.zeros(0, np.int64), *taken])
            order = np.argsort(rows, kind="stable")
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32))
            rule = np.repeat(np.arange(len(taken), dtype=np.int32), [len(t) for t in taken])
            lists = {"kpi": rule, "tier": made["tier"], "score": made["score"]}
            columns = {c: batch.column(c) for c in self.carried}
            columns |= {c: pa.ListArray.from_arrays(bounds, pa.array(v[order])) for c, v in lists.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def every_candidate(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self.candidates(batches, everything=True)

    def gates(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strict and fallback gate, in full with their reasons, for every (chunk, rule)."""
        quoted = lambda head, terms: [f"{head}: '{t}'" for t in terms]
        reasons = [
            pa.array(["no must_match term found", *quoted("must_match", r["must"])] if r["must"] else ["ok", *quoted("must_exclude hit", r["exclude"])])
            for r in self.rules
        ]
        falling = [pa.array(["unit_fallback: no unit+number pattern", *quoted("unit_fallback hit", r["fallback"])]) for r in self.rules]
        for batch in batches:
            hits = _found_in(batch.column("_lower"), self.terms)
            number = batch.column("_unit_number").fill_null(False).to_numpy(zero_copy_only=False)
            for k, rule in enumerate(self.rules):
                fallback = _meet(hits, self.sets[k]["fallback"]) & number
                columns = {c: batch.column(c) for c in self.carried} | {
                    "kpi": self.names.take(pa.array(np.full(batch.num_rows, k))), "relevant": pa.array(self._strict(k, hits, False)),
                    "fallback": pa.array(fallback),
                }
                if self.full:
                    why = _first_of(hits, self.terms, rule["must"] or rule["exclude"])
                    unit = np.where(fallback, _first_of(hits, self.terms, rule["fallback"]), 0)
                    columns |= {"reason": reasons[k].take(pa.array(why)), "fallback_reason": falling[k].take(pa.array(unit))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
