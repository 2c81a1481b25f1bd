"""Exact top-k inner products by norm buckets.

Vectors of like length form blocks of bounded size; queries form blocks too.  A block
pair needs a query only if its current k-th score can be reached within the block's
greatest length.  Below that, the local cosine threshold ``score / (|q| * longest)``
picks the pruning: a low one keeps a prefix of the vectors by length, a high one also
bounds the coordinate where the query is largest, and a sorted column gives the range.
What is left is verified with exact integer products.

Every query starts from the k-th score within a bounded set of the longest vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.staging import keep
from gaugework.operators.groups import top_per_group

SCALE = 1024
BLOCK, QUERY_BLOCK, FIRST = 4096, 1024, 1024
#: Buckets per doubling of the length, and the local cosine from which coordinates prune.
STEPS, STEEP = 4, 0.3
#: Products whose lengths multiply to less than this are exact in double precision.
EXACT = float(1 << 52)


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` with components ``floor(scale * x)``; unusable vectors and ids are left out."""
    x = F.col(embedding).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    )
    rows = vectors.filter(F.coalesce(usable, F.lit(False)))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(rows), width)


def _scores(q: np.ndarray, rows: np.ndarray, reach: float) -> list[int]:
    """Exact products; Python integers where 64 bits might not do."""
    if reach < EXACT:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64).tolist()
    if reach < float(1 << 62):
        return (rows @ q).tolist()
    return [sum(int(a) * int(b) for a, b in zip(r, q)) for r in rows.tolist()]


class Block:
    """Vectors of one block, longest first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        length = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.rows, self.length = ids[order], rows[order], length[order]
        self.longest = float(self.length[0]) if len(ids) else 0.0
        self.unit = self.rows / np.maximum(self.length, 1e-300)[:, None]
        self.columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def candidates(self, q: np.ndarray, size: float, least: float | None) -> np.ndarray | None:
        """Places of vectors that may score ``least``; None for all."""
        slack = 1e-9
        if least is None or least <= 0 or not size or not self.longest:
            return None
        local = least / (size * self.longest)
        if local > 1 + slack:
            return np.zeros(0, np.int64)
        reach = int(np.searchsorted(-self.length, -least / size * (1 - slack), "right"))
        if local < STEEP:
            return np.arange(reach)
        axis = int(np.abs(q).argmax())
        part = q[axis] / size
        wide = np.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - part * part)) + slack
        low = part * local - wide if part > -local else -1.0 - slack
        high = part * local + wide if part < local else 1.0 + slack
        if axis not in self.columns:
            order = np.argsort(self.unit[:, axis], kind="stable")
            self.columns[axis] = order, self.unit[order, axis]
        order, values = self.columns[axis]
        found = order[np.searchsorted(values, low - slack) : np.searchsorted(values, high + slack, "right")]
        return found[found < reach]


def best(block: Block, q_id: int, q: np.ndarray, least: int | None, k: int) -> list[tuple[int, int]]:
    """The block's ``k`` best ``(score, id)`` for a query, without those under ``least``."""
    size = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
    at = block.candidates(q, size, least)
    ids, rows = (block.ids, block.rows) if at is None else (block.ids[at], block.rows[at])
    scores = _scores(q, rows, size * block.longest + 1)
    top = _exact_int(scores)
    other = ids != q_id
    if least is not None:
        other &= top >= least
    ids, top = ids[other], top[other]
    order = np.lexsort((ids, -top))[:k]
    return [(int(top[i]), int(ids[i])) for i in order]


def _exact_int(scores: list[int]) -> np.ndarray:
    try:
        return np.array(scores, np.int64)
    except OverflowError:
        raise ArithmeticError("an inner product doesn't fit into 64 bits") from None


def _read_block(batch: pa.RecordBatch, row: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(batch.column(prefix + "ids")[row].as_py() or [], np.int64)
    rows = batch.column(prefix + "rows")[row].values
    width = int(batch.column("width")[row].as_py())
    return ids, (rows.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width).astype(np.int64) if width else np.zeros((len(ids), 0), np.int64))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest products of each query, ties to smaller ids.

    Both tables have ``vec_id, v`` (see ``whole_vectors``).  A query meets all vectors
    of its own width but those with its own id; fewer than ``k`` of them give fewer rows,
    and a query without any gives none.  A query id that occurs in several rows is asked
    once, with its least vector; repeated vectors count as often as they occur.  The
    query set is a stated one: it meets the vectors in blocks, of which one of each is
    in a task at a time.
    """
    vectors = keep(vectors.withColumn("width", F.size("v")), "vectors")
    queries = keep(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v")), "queries")
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c, lambda s: F.sqrt(s))
    bucket = F.when(length > 0, F.floor(F.log2(length) * STEPS)).otherwise(F.lit(-1))
    sized = vectors.withColumns({"length": length, "bucket": bucket})

    # the longest vectors of each width are few by their bound, and so is the block made of them
    starts = top_per_group(sized.select("width", "length", "vec_id", "v"), ["width"], [F.desc("length"), F.col("vec_id"), F.col("v")], FIRST)
    starts = starts.groupBy("width").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("c")).select(
        "width", F.col("c.vec_id").alias("c_ids"), F.col("c.v").alias("c_rows")
    )
    rooms = queries.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("rooms"))
    room = F.pmod(F.xxhash64("vec_id"), F.col("rooms")).alias("room")
    asked = queries.join(rooms, "width").select("width", "rooms", room, F.struct("vec_id", "v").alias("q"))
    asked = asked.groupBy("width", "rooms", "room").agg(F.sort_array(F.collect_list("q")).alias("q")).select(
        "width", "rooms", "room", F.col("q.vec_id").alias("q_ids"), F.col("q.v").alias("q_rows")
    )

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(*_read_block(batch, row, "c_"))
                least = []
                for q_id, q in zip(*_read_block(batch, row, "q_")):
                    found = best(block, q_id, q, None, k)
                    least.append(found[-1][0] if len(found) == k else None)
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(c) for c in names[:-1]), pa.array([least], pa.list_(pa.int64()))], names
                )

    names = ["width", "room", "q_ids", "q_rows", "least"]
    ready = asked.join(starts, "width").mapInArrow(
        first_scores, "width int, room long, q_ids array<long>, q_rows array<array<long>>, least array<long>"
    )
    ready = keep(ready, "asked")

    blocks = sized.groupBy("width", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    dealt = sized.join(blocks, ["width", "bucket"]).select("width", "bucket", part.alias("part"), F.struct("vec_id", "v").alias("c"))
    dealt = dealt.groupBy("width", "bucket", "part").agg(F.collect_list("c").alias("c")).select(
        "width", F.col("c.vec_id").alias("c_ids"), F.col("c.v").alias("c_rows")
    )
    # each block of vectors visits each block of queries of its width
    visits = dealt.join(rooms, "width").select(
        "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rooms") - 1)).alias("room"), "c_ids", "c_rows"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(*_read_block(batch, row, "c_"))
                least = batch.column("least")[row].as_py()
                out = []
                for q_id, q, low in zip(*_read_block(batch, row, "q_"), least):
                    out += [(int(q_id), i, s) for s, i in best(block, q_id, q, low, k)]
                columns = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = visits.join(ready, ["width", "room"]).mapInArrow(search, "query_id long, vec_id long, score long")
    return top_per_group(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k, rank="rank").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
