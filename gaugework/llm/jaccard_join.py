"""Similarity join of documents on word shingles, with prefixes of token combinations.

A document is the set of its distinct shingles.  Equal sets are one node.  All shingles
have one global order: rare ones first, then frequent ones by count.  The frequent ones
are split into small classes; a node indexes its rare prefix shingles singly and pairs
of frequent ones of a class.  Its prefix runs until the class sizes, less one for each
class of pairs, exceed the shingles that a linked partner may lack by a quarter; two
linked nodes then share a stated number of keys, and nodes with fewer shared keys go.  Which shingles count as frequent only steers the work: any choice
gives the same links.

Candidates meet under the smallest node of their key and are verified there by counting
the shingles that they share exactly.  Only links are returned, and no more than join
what is connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.components import components
from gaugework.llm.staging import keep
from gaugework.llm.words import LOWER, mix, row_slices, shingle_hashes, text_bytes, word_hashes
from gaugework.operators.groups import first_per_group, top_per_group

SIZE = 5
#: Linked when PERCENT_OF * shared >= PERCENT * union.
PERCENT, PERCENT_OF = 80, 100
FREQUENT = 8
MOST_FREQUENT = 1 << 20
#: Shingles that one task holds for a comparison, and nodes that go first against all others.
ROOM, PIVOTS = 300_000, 8
_SLICE, _HELD = 1 << 20, 100_000


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z folded; null and blank texts have none."""
    data, bounds = text_bytes(column)
    for i, j in row_slices(bounds, _SLICE):
        part, cuts = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        hashes, _, _, rows = word_hashes(part, cuts, LOWER)
        shingles, runs = shingle_hashes(hashes, rows, SIZE)
        for r in range(j - i):
            yield np.unique(shingles[runs[r] : runs[r + 1]])


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    value = mix(shingles * np.uint64(2) + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([value], np.uint64)).astype(np.int64)[0])


def _lack(n: int) -> int:
    """Shingles of ``n`` that may be missing from a linked partner."""
    return n - -(-PERCENT * n // PERCENT_OF)


def _extra(n: int) -> int:
    """Keys that two linked sets share at least, if the smaller has ``n`` shingles."""
    return max(1, _lack(n) // 4)


class Signatures:
    """Index keys of a set, given the frequent shingles in ascending order of count."""

    def __init__(self, frequent: np.ndarray):
        order = np.argsort(frequent)
        self.values, self.rank = frequent[order], order

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        if n < 4:
            return np.zeros(0, np.uint64)  # such a set links with equal sets only
        need = _lack(n) + _extra(n)
        at = np.searchsorted(self.values, shingles)
        at[at == len(self.values)] = 0
        common = self.values[at] == shingles if len(self.values) else np.zeros(n, bool)
        rare = shingles[~common][:need]
        out = [mix(rare)]
        if len(rare) < need:
            rest = shingles[common][np.argsort(self.rank[at[common]])]
            for level in sorted({(n - _lack(n)).bit_length(), n.bit_length()}):
                out.append(self._pairs(rest, need - len(rare), level))
        return np.concatenate(out)

    def _pairs(self, rest: np.ndarray, need: int, level: int) -> np.ndarray:
        """Pairs within classes; their number follows the level, a size that both partners try."""
        kind = rest % np.uint64(max(1, (1 << level) // 16))
        again = np.ones(len(rest), bool)
        again[np.unique(kind, return_index=True)[1]] = False
        end = int(np.searchsorted(np.cumsum(again), need)) + 1
        order = np.argsort(kind[:end], kind="stable")
        rest, kind = rest[:end][order], kind[:end][order]
        out = [np.zeros(0, np.uint64)]
        for step in range(1, len(rest)):
            same = kind[step:] == kind[:-step]
            if not same.any():
                break
            out.append(mix(rest[step:][same] * np.uint64(3) + rest[:-step][same] + np.uint64(level)))
        return np.concatenate(out)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and one per shingle that several documents of a slice have."""
    for batch in batches:
        for i, j in row_slices(text_bytes(batch.column("text"))[1], 4 * _SLICE):
            sets = list(shingle_sets(batch.column("text").slice(i, j - i)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                 pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64())],
                ["doc_id", "n_shingles", "node", "shingle", "times"],
            )
            shingles, times = np.unique(np.concatenate(sets), return_counts=True)
            shingles, times = shingles[times > 1], times[times > 1]
            n = len(shingles)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, batch.column("doc_id").type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                 pa.array(shingles.astype(np.int64)), pa.array(times.astype(np.int64))],
                ["doc_id", "n_shingles", "node", "shingle", "times"],
            )


def _index(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(shared.value)
        for batch in batches:
            keys, nodes, held = [], [], 0
            for shingles in shingle_sets(batch.column("text")):
                own = signatures.keys(shingles)
                keys.append(_short(own))
                nodes.append(np.full(len(own), fingerprint(shingles), np.int64))
                held += len(own)
                if held > _HELD:
                    yield _pack(keys, nodes)
                    keys, nodes, held = [], [], 0
            if held:
                yield _pack(keys, nodes)

    return docs.select("text").mapInArrow(run, "key long, node long")


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _short(keys: np.ndarray) -> np.ndarray:
    """The 40 leading bits of the keys of one set, which travel lighter.

    Keys that fall together are told apart by their number among their like.  A partner
    that shares so many of them has as many, so a set never counts fewer shared keys than
    it has; keys of different sets that fall together only make more candidates.
    """
    short = np.sort(keys >> np.uint64(24)).astype(np.int64)
    return short | ((np.arange(len(short)) - np.searchsorted(short, short)) << 40)


def _pack(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])


def _unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(t, max_output_size=1 << 31) for t in column.to_pylist()], pa.binary())


def _few(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of each candidate; a row of the same id with another text is not the candidate."""
    for batch in (part for whole in batches for part in _few(whole)):
        out = [
            (node, len(s), packed)
            for node, packed, s in zip(batch.column("node").to_pylist(), batch.column("packed").to_pylist(), shingle_sets(_unpacked(batch.column("packed"))))
            if fingerprint(s) == node
        ]
        node, size, packed = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(packed, pa.binary())], ["node", "size", "packed"]
        )


def spanning_links(x: list[tuple[int, np.ndarray]], y: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between the named sets of ``x`` and ``y``, as many as join all that are connected.

    What a set shares with every set of ``y`` is counted at once, over an index of their shingles.
    """
    shingles = np.concatenate([s for _, s in y])
    sizes = np.array([len(s) for _, s in y])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], np.repeat(np.arange(len(y)), sizes)[order]
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while (up := parent.get(node, node)) != node:
            parent[node] = node = parent.get(up, up)
        return node

    out = []
    for node, own in x:
        low = np.searchsorted(shingles, own)
        count = np.searchsorted(shingles, own, "right") - low
        place = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        shared = np.bincount(owner[place], minlength=len(y))
        for k in np.flatnonzero(PERCENT_OF * shared >= PERCENT * (len(own) + sizes - shared)).tolist():
            a, b = root(node), root(y[k][0])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((node, y[k][0]))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (center, a, b): the sets of one comparison come together, and only they are held."""
    group, x, y = None, [], []

    def links() -> pa.RecordBatch:
        found = spanning_links(x, y) if x and y else []
        columns = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    for batch in (part for whole in batches for part in _few(whole)):
        columns = [batch.column(c).to_pylist() for c in ("center", "a", "b", "role", "node")]
        for center, a, b, role, node, shingles in zip(*columns, shingle_sets(_unpacked(batch.column("packed")))):
            if group != (center, a, b):
                if group:
                    yield links()
                group, x, y = (center, a, b), [], []
            if role != "y":
                x.append((node, shingles))
            if role != "x":
                y.append((node, shingles))
    if group:
        yield links()


def _slot(parts: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(parts))


def _each(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))


def _parts(members: DataFrame, name: str) -> DataFrame:
    """Slots of at most about ROOM shingles that the members under a center need."""
    return members.groupBy("center").agg(F.ceil(F.sum("size") / ROOM).alias(name))


def _verified(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = tasks.join(nodes.select("node", "packed"), "node").repartition("center", "a", "b")
    return keep(rows.sortWithinPartitions("center", "a", "b").mapInArrow(_compare, "a long, b long"), "links")


def _links(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links that join all linked nodes which share a key.

    Nodes whose keys have one center meet under it.  Most centers have few: one task
    compares them.  Members of a large one are dealt to slots; a few pivots go to every
    slot, and then those that the pivots left outside the largest component go to all
    slots, so that members already joined are not compared with each other.
    """
    members = candidates.select("center", "node").union(candidates.select("center", "center")).distinct()
    members = members.join(nodes.select("node", "size"), "node")
    members = keep(members.join(_parts(members, "parts"), "center"), "members")
    slot = F.lit(0).cast("long")
    small = members.filter("parts = 1").select("center", slot.alias("a"), slot.alias("b"), F.lit("xy").alias("role"), "node")
    links = _verified(small, nodes)
    large = members.filter("parts > 1")
    if not large.limit(1).count():
        return links

    pivots = top_per_group(large, ["center"], [F.xxhash64("node")], PIVOTS)
    tasks = pivots.select("center", slot.alias("a"), _each("parts").alias("b"), F.lit("x").alias("role"), "node").union(
        large.select("center", slot.alias("a"), _slot("parts").alias("b"), F.lit("y").alias("role"), "node")
    )
    links = links.union(_verified(tasks, nodes))
    rooted = large.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = first_per_group(rooted.groupBy("center", "root").count(), ["center"], [F.desc("count"), F.col("root")])
    outside = rooted.join(main.select("center", F.col("root").alias("main")), "center").filter("root <> main").drop("main")
    outside = keep(outside.join(_parts(outside, "slots"), "center"), "outside")
    slots = outside.select("center", "slots").distinct()
    tasks = outside.select("center", _slot("slots").alias("a"), _each("parts").alias("b"), F.lit("x").alias("role"), "node").union(
        large.join(slots, "center").select("center", _each("slots").alias("a"), _slot("parts").alias("b"), F.lit("y").alias("role"), "node")
    )
    return links.union(_verified(tasks, nodes))


def _several(candidates: DataFrame) -> DataFrame:
    """Rows of keys that several nodes have, with the smallest of them as ``center``."""
    keys = candidates.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("other"))
    return candidates.select("key", "node").join(keys.filter("center <> other").select("key", "center"), "key")


def _shared_enough(candidates: DataFrame, first: DataFrame) -> DataFrame:
    """Rows of nodes with as many shared keys as a linked node has at least."""
    partner = F.floor((PERCENT * F.col("n") + PERCENT_OF - 1) / PERCENT_OF)
    lack = partner - F.floor((PERCENT * partner + PERCENT_OF - 1) / PERCENT_OF)
    enough = candidates.groupBy("node").count().join(first, "node").filter(
        F.col("count") >= F.greatest(F.lit(1), F.floor(lack / 4))
    )
    return candidates.join(enough.select("node"), "node", "left_semi")


def link(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    The component is the smallest ``doc_id`` reachable by links, the row's own included.
    A text without words, or null, has no shingles and links with nothing.  Rows without
    ``doc_id`` link with nothing and have no component.  Repeated rows are copies of each
    other; rows of one id with different texts are told apart.  Other columns are not read.
    Whole texts are compared; names of sets and shingles are 64-bit hashes.
    """
    named = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = keep(
        docs.select("doc_id", "text").mapInArrow(_describe, f"doc_id {kind}, n_shingles long, node long, shingle long, times long"),
        "shingles",
    )
    rows = facts.filter("n_shingles is not null").select("doc_id", "n_shingles", "node")
    counts = facts.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = counts.filter(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "shingle").limit(MOST_FREQUENT)
    frequent = top.toPandas().sort_values(["times", "shingle"])["shingle"].to_numpy(np.int64).astype(np.uint64)

    first = rows.filter("doc_id is not null and node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n")
    )
    index = _index(named, frequent)
    again = index.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key")
    candidates = keep(index.join(again, "key").distinct(), "shared")
    candidates = keep(_several(_shared_enough(_several(candidates), first)), "candidates")
    wanted = keep(candidates.select("node").distinct().join(first, "node").select("doc_id", "node"), "wanted")
    packed = named.mapInArrow(_pack_texts, f"doc_id {kind}, packed binary")
    # repeated rows of an id are dropped where the join has brought them together
    # (a merge join at every size, so that the plan doesn't change with the input)
    nodes = packed.join(wanted.hint("merge"), "doc_id").select("doc_id", "node", "packed").distinct().select("node", "packed").mapInArrow(
        _candidates, "node long, size long, packed binary"
    )
    nodes = keep(nodes, "nodes")
    links = _links(candidates, nodes)
    groups = components(links)

    lowest = first.join(groups, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    lowest = lowest.select("node", "root").join(
        lowest.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root"
    ).select("node", "component_id")
    named_rows = rows.filter("doc_id is not null and node is not null").join(lowest, "node")
    alone = rows.filter("doc_id is null or node is null").withColumn("component_id", F.col("doc_id"))
    return named_rows.unionByName(alone).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names their component, one row per id; rows without id all stay.

    Of several rows of an id the one with the smallest text stays.  All columns stay.
    """
    ids = link(docs).filter("doc_id is not null").groupBy("doc_id").agg(
        F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n")
    )
    # stored, so that its size is known: as long as it is small, no text is shuffled
    special = keep(ids.filter("not stays or n > 1").select("doc_id", "stays"), "special")
    plain = docs.join(special.select("doc_id"), "doc_id", "left_anti")
    repeated = docs.join(special.filter("stays").select("doc_id"), "doc_id", "left_semi")
    once = first_per_group(repeated, ["doc_id"], [F.col("text").asc_nulls_last()])
    return plain.select(*docs.columns).unionByName(once.select(*docs.columns))
