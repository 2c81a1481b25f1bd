"""Ranking of whole documents, in numpy on Arrow batches of their judged chunks.

Documents come one after the other, each with all its rows; some thousand chunks of many
documents are ranked at once by sorting their rows of (chunk, metric).  Nothing but the
chunks that were found leaves, so neither the rows of (chunk, metric) nor texts are moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gaugework.functions.masks import Terms
from gaugework.functions.verdicts import Judge, WordMasks, _found_in, _meet
from gaugework.rules import relevance as R

DIGITS = 6
#: What is said of a chunk for each metric that it was found for.
FOUND = "struct<kpi:string,position:int,score:double,is_neighbor:boolean>"


def rounded(x: np.ndarray) -> np.ndarray:
    """Millionths, halves to even by the decimal digits of the number, as ``bround`` has them."""
    scaled = x * 10**DIGITS
    out = np.rint(scaled).astype(np.int64)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = int(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_EVEN).scaleb(DIGITS))
    return out


def places(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of sorted groups its group's first row, and its place from 1."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    return start, np.arange(len(group)) - start + 1


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a document ends; ``_rows`` is the number of its rows."""
    held: list[pa.RecordBatch] = []
    open_rows = 0  # rows that are held of a document whose others are still to come
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index("_rows")).to_numpy(zero_copy_only=False)
        end = int(sizes[0]) - open_rows if open_rows else 0
        if end > batch.num_rows:
            held.append(batch)
            open_rows += batch.num_rows
            continue
        while end < batch.num_rows and end + sizes[end] <= batch.num_rows:
            end += int(sizes[end])
        if end:
            yield pa.concat_batches([*held, batch.slice(0, end)])
        held, open_rows = ([batch.slice(end)], batch.num_rows - end) if end < batch.num_rows else ([], 0)
    if held:
        raise ValueError("a document's rows are not all in one task")


class Documents:
    """Chunks of a batch of whole documents in the order of their numbers."""

    def __init__(self, batch: pa.RecordBatch):
        doc = batch.column("doc_id")
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(doc.slice(1), doc.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        number = np.cumsum(new) - 1
        index = batch.column("chunk_index").to_numpy(zero_copy_only=False)
        order = np.lexsort((index, number))
        self.batch = batch if (order == np.arange(batch.num_rows)).all() else batch.take(pa.array(order))
        self.number, self.index = number, index[order]
        self.count = int(number[-1]) + 1
        page = self.batch.column("page_number")
        self.paged = page.is_valid().to_numpy(zero_copy_only=False)
        self.page = pc.fill_null(page, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start, self.place = places(number)

    def next_to(self, rows: np.ndarray, step: int) -> np.ndarray:
        """Is the row before or after each row the document's next chunk, on no other page?"""
        at = rows + step
        inside = (at >= 0) & (at < len(self.number))
        at = np.where(inside, at, rows)
        same = (self.number[at] == self.number[rows]) & (self.index[at] == self.index[rows] + step)
        page = ~self.paged[at] | ~self.paged[rows] | (self.page[at] == self.page[rows])
        return inside & same & page


def _by_row(row: np.ndarray, count: int, said: pa.StructArray) -> pa.ListArray:
    """Lists of what is said of each row; ``row`` rises."""
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=count))])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), said)


class Ranker:
    """Best chunks per (document, metric): tiers, scores, page bonus, top k, neighbours, or the first chunks."""

    def __init__(
        self, judge: Judge, names: Sequence[str], asked: Sequence[int], k: int, carried: Sequence[str],
        wide: Sequence[tuple[int, Sequence[str]]] = (), extra: int = 0,
    ):
        self.judge, self.names, self.asked, self.k, self.carried = judge, pa.array(names, pa.string()), list(asked), k, list(carried)
        self.wide, self.extra, self.wide_terms = list(wide), extra, Terms(w for _, words in wide for w in words)

    def _anchors(self, docs: Documents, row, group, tier, score, groups: int):
        """The k best rows of each group: rows, groups, ranks and raised scores."""
        n0, n1 = (np.bincount(group[tier == t], minlength=groups) for t in (0, 1))
        allowed = np.where((n0 >= R.MIN_RELEVANT) | ((n0 > 0) & (n1 == 0)), 0, np.where(n1 > 0, 1, 2))
        usable = np.flatnonzero((tier <= allowed[group]) & (score > 0))
        row, group, score = row[usable], group[usable], score[usable]
        order = np.lexsort((row, -rounded(score), group))
        row, group, score = row[order], group[order], score[order]
        start, raw = places(group)
        page, on_page = docs.page[row], np.zeros(len(row), bool)
        for i in range(min(R.PAGE_BONUS_TOP, self.k)):
            at = np.minimum(start + i, len(row) - 1)
            on_page |= (group[at] == group) & docs.paged[row] & docs.paged[row[at]] & (page[at] != 0) & (page[at] == page)
        late = np.minimum(raw, self.k) > R.PAGE_BONUS_TOP
        raised = score + np.where(on_page & late, R.PAGE_BONUS, 0.0)
        order = np.lexsort((row, np.minimum(raw, self.k + 1), -rounded(raised), group))
        _, rank = places(group[order])
        best = order[rank <= self.k]
        return row[best], group[best], rank[rank <= self.k], raised[best]

    def _stitched(self, docs: Documents, row, group, rank, score):
        """Anchors and the chunks next to them, in the order of their positions."""
        none, own_of = np.iinfo(np.int64).max, np.ones(len(row), bool)
        sides = [(row, group, rank, np.zeros(len(row), np.int64), score, own_of)]
        for step in (-1, 1):
            near = docs.next_to(row, step)
            sides.append((row[near] + step, group[near], rank[near], np.full(near.sum(), step), score[near], np.zeros(near.sum(), bool)))
        row, group, rank, step, score, own = (np.concatenate(parts) for parts in zip(*sides, strict=True))
        key = group * len(docs.number) + row
        order = np.argsort(key, kind="stable")
        key, row, group, rank, step, score, own = (x[order] for x in (key, row, group, rank, step, score, own))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, np.zeros(0), np.zeros(0, bool)
        mine = np.minimum.reduceat(np.where(own, rank, none), first)
        adder = np.minimum.reduceat(np.where(own, none, rank * 4 + step + 1), first)
        best = np.maximum.reduceat(np.where(own, score, -np.inf), first)
        primary = (mine != none) & ((adder == none) | (adder // 4 > mine))
        score = np.where(primary, best, R.NEIGHBOUR_SCORE)
        row, group = row[first], group[first]
        order = np.lexsort((np.where(primary, 0, adder % 4), np.where(primary, mine, adder // 4), -rounded(score), ~primary, group))
        _, position = places(group[order])
        kept = position <= 2 * self.k
        order = order[kept]
        return row[order], group[order], position[kept], score[order], ~primary[order]

    def _opening(self, docs: Documents, have: np.ndarray, rules: int):
        """First k chunks of a document for each metric without a candidate."""
        rows = np.flatnonzero(docs.place <= self.k)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n in self.asked:
            lacking = rows if n >= rules else rows[~have[docs.number[rows] * rules + n]]
            out.append((lacking, np.full(len(lacking), n)))
        row, kpi = (np.concatenate(parts) for parts in zip(*out, strict=True))
        return row, kpi, docs.place[row]

    def found(self, docs: Documents, words: WordMasks) -> tuple[np.ndarray, ...]:
        """Rows, metrics (by number), positions, scores and marks of neighbours."""
        rules = max(len(self.judge.rules), 1)
        if self.judge.rules:
            taken, made = self.judge.scored(docs.batch, words)
            row, rule = np.concatenate(taken), np.repeat(np.arange(len(taken)), [len(t) for t in taken])
        else:
            row, rule, made = np.zeros(0, np.int64), np.zeros(0, np.int64), {"tier": np.zeros(0, np.int64), "score": np.zeros(0)}
        group = docs.number[row] * rules + rule
        have = np.bincount(group, minlength=docs.count * rules) > 0
        row, group, position, score, near = self._stitched(docs, *self._anchors(docs, row, group, made["tier"], made["score"], docs.count * rules))
        first, kpi, place = self._opening(docs, have, rules)
        return (
            np.concatenate([row, first]), np.concatenate([group % rules, kpi]), np.concatenate([position, place]),
            np.concatenate([score, np.zeros(len(first))]), np.concatenate([near, np.zeros(len(first), bool)]),
        )

    def _wider(self, docs: Documents, row: np.ndarray, kpi: np.ndarray) -> tuple[np.ndarray, ...]:
        """Up to ``extra`` further chunks per (document, metric) with one of its wide words; type, page and number decide."""
        held = _found_in(docs.batch.column("_words"), self.wide_terms)
        offers = [(np.flatnonzero(_meet(held, np.array(self.wide_terms.mask(words), np.int64))), n) for n, words in self.wide]
        rows = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in offers)])
        kpis = np.repeat(np.array([n for _, n in offers], np.int64), [len(r) for r, _ in offers])
        many = len(self.names)
        fresh = ~np.isin(rows * many + kpis, row * many + kpi)
        rows, kpis = rows[fresh], kpis[fresh]
        kind = docs.batch.column("chunk_type").dictionary_encode()
        names = kind.dictionary.to_pylist()
        by_name = np.array([sorted(names, reverse=True).index(n) for n in names] + [len(names)], np.int64)  # no type comes last
        kind = by_name[kind.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)]
        group = docs.number[rows] * many + kpis
        order = np.lexsort((rows, docs.page[rows], ~docs.paged[rows], kind[rows], group))
        _, place = places(group[order])
        kept = order[place <= self.extra]
        return rows[kept], kpis[kept], place[place <= self.extra]

    def _lists(self, docs: Documents, words: WordMasks) -> dict[str, pa.ListArray]:
        row, kpi, position, score, near = self.found(docs, words)
        order, count = np.lexsort((kpi, row)), len(docs.number)
        out = {"asked": _by_row(row[order], count, pa.StructArray.from_arrays(
            [self.names.take(pa.array(kpi[order])), pa.array(position[order], pa.int32()), pa.array(score[order]), pa.array(near[order])],
            ["kpi", "position", "score", "is_neighbor"],
        ))}
        if self.extra:
            row, kpi, position = self._wider(docs, row, kpi)
            order = np.argsort(row, kind="stable")
            out["wide"] = _by_row(row[order], count, pa.StructArray.from_arrays(
                [self.names.take(pa.array(kpi[order])), pa.array(position[order], pa.int32())], ["kpi", "position"]
            ))
        return out

    def every_chunk(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every chunk, document by document, with the metrics that it was found for as a list."""
        words = WordMasks(self.judge.first)
        for batch in whole_documents(batches):
            docs = Documents(batch)
            columns = {c: docs.batch.column(c) for c in self.carried} | self._lists(docs, words)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def by_chunk(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same of the chunks found."""
        for batch in self.every_chunk(batches):
            yield batch.filter(pc.greater(pc.list_value_length(batch.column("asked")), 0))


    def searched(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best chunks per document by the only rule, whatever the keyword index says, with their neighbours."""
        words = WordMasks(self.judge.first)
        for batch in whole_documents(batches):
            docs = Documents(batch)
            score = self.judge.scored(docs.batch, words, everything=True)[1]["score"]
            row = np.flatnonzero(score > 0)
            row = row[np.lexsort((row, -rounded(score[row]), docs.number[row]))]
            _, rank = places(docs.number[row])
            row, rank = row[rank <= self.k], rank[rank <= self.k]
            row, _, position, score, near = self._stitched(docs, row, docs.number[row], rank, score[row])
            columns = {c: docs.batch.column(c).take(pa.array(row)) for c in self.carried}
            columns |= {"score": pa.array(score), "is_neighbor": pa.array(near), "position": pa.array(position, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def funnel(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per (document, metric) candidates, gate passes, positive scores, finalists and the range of scores."""
        words, rules = WordMasks(self.judge.first), len(self.judge.rules)
        for batch in whole_documents(batches) if rules else ():
            docs = Documents(batch)
            taken, made = self.judge.scored(docs.batch, words)
            group = docs.number[np.concatenate(taken)] * rules + np.repeat(np.arange(rules), [len(t) for t in taken])
            count = lambda rows: np.bincount(group[rows], minlength=docs.count * rules)
            passed = made["tier"] == 0
            good = passed & (made["score"] > 0)
            low, high = np.full(docs.count * rules, np.inf), np.full(docs.count * rules, -np.inf)
            np.minimum.at(low, group[good], made["score"][good])
            np.maximum.at(high, group[good], made["score"][good])
            some = np.flatnonzero(count(np.ones(len(group), bool)))
            scored = count(good)[some]
            first = np.flatnonzero(docs.place == 1)
            counts = {
                "candidates": count(np.ones(len(group), bool))[some], "passed": count(passed)[some], "dropped": count(~passed)[some],
                "scored": scored, "final": np.minimum(scored, self.k), "answerable": count(good & made["answerable"])[some],
            }
            columns = {"doc_id": docs.batch.column("doc_id").take(pa.array(first[some // rules])), "kpi": self.names.take(pa.array(some % rules))}
            columns |= {c: pa.array(v, pa.int64()) for c, v in counts.items()}
            columns |= {"lowest": pa.array(low[some], mask=scored == 0), "highest": pa.array(high[some], mask=scored == 0)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


#: White space as ``text.strip`` takes it off.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Packer:
    """Contexts of whole documents from every chunk with its lists: texts are joined where they lie."""

    def __init__(self, names: Sequence[str], limit: int, after: int, wide: bool = False, sure: bool = False):
        self.names, self.limit, self.after, self.wide, self.sure = pa.array(names, pa.string()), limit, after, wide, sure

    def _said(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        said = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        names = said if pa.types.is_string(said.type) else pc.struct_field(said, "kpi")
        return row, pc.index_in(names, self.names).to_numpy(zero_copy_only=False).astype(np.int64), said

    def _picked(self, docs: Documents) -> tuple[np.ndarray, np.ndarray]:
        """Rows and groups of (document, metric) in the order of the contexts."""
        many = len(self.names)
        row, kpi, said = self._said(docs.batch.column("asked"))
        position = pc.struct_field(said, "position").to_numpy(zero_copy_only=False)
        near = pc.struct_field(said, "is_neighbor").to_numpy(zero_copy_only=False)
        group = docs.number[row] * many + kpi
        wanted = np.zeros(docs.count * many, bool)
        wanted[group] = True
        if self.sure:
            at, kpi, _ = self._said(docs.batch.column("sure"))
            wanted[docs.number[at] * many + kpi] = False
        if self.wide:
            at, kpi, said = self._said(docs.batch.column("wide"))
            row, group = np.concatenate([row, at]), np.concatenate([group, docs.number[at] * many + kpi])
            position = np.concatenate([position, pc.struct_field(said, "position").to_numpy(zero_copy_only=False) + self.after])
            near = np.concatenate([near, np.zeros(len(at), bool)])
        kept = np.flatnonzero(wanted[group])
        order = kept[np.lexsort((row[kept], position[kept], near[kept], group[kept]))]
        return row[order], group[order]

    def contexts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per (document, metric) the texts that fit into ``limit`` characters together, and their number."""
        for batch in whole_documents(batches):
            docs = Documents(batch)
            page = pc.fill_null(pc.cast(docs.batch.column("page_number"), pa.string()), "None")
            table = pc.fill_null(pc.equal(docs.batch.column("chunk_type"), "table"), False)
            block = pc.binary_join_element_wise(
                pc.if_else(table, "[TABLE | Page ", "[Page "), page, "]\n", docs.batch.column("content"), "\n\n", "", null_handling="emit_null"
            )
            told = block.is_valid().to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.utf8_length(block), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, group = self._picked(docs)
            start, _ = places(group)
            total = lambda n: (c := np.cumsum(n)) - (c[start] - n[start])
            if len(row):
                fits = (total(size[row]) <= self.limit) & (total(told[row].astype(np.int64)) > 0)  # a sum of no size is none
                row, group = row[fits], group[fits]
            if not len(row):
                continue
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            bounds = np.concatenate([first, [len(row)]])
            texts = pc.fill_null(block, "").take(pa.array(row))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), texts), "")
            columns = {
                "doc_id": docs.batch.column("doc_id").take(pa.array(row[first])), "kpi": self.names.take(pa.array(group[first] % len(self.names))),
                "blocks": pa.array(np.diff(bounds), pa.int32()), "context": pc.utf8_trim(joined, characters=SPACES),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
