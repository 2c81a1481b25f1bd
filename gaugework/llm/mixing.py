"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates that give every source its target words, those nearest to one
copy each (in relative entropy) are exponentials: ``rate = min(limit, exp(tilt * x))``
with ``x`` the document's words over its source's mean.  The dual has one tilt per
source.  Newton steps on all tilts at once find them, from counts per source and size,
so an iteration never touches documents.  Rates then become whole copies from large to
small documents, each taking over the words that the last rounding left, so that a
stretch of documents ends within its smallest one of its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.llm.staging import keep

WORD = r"[^\x20\x09-\x0D]+"
LIMIT = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: Different documents that are rounded together; a source has as many stretches as it needs.
STRETCH = 1000
STEPS, CLOSE = 60, 1e-7
#: Copies taken of ``x``: its rate and what larger documents left over, as a whole number.
_WHOLE = (
    "if(x.order = 0, x.n, greatest(0L, least({limit} * x.n, "
    "cast(floor(x.n * x.rate - a.rest / x.order + 0.5) as bigint))))"
)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sources: DataFrame, weights: Sequence[float], limit: int) -> DataFrame:
    """``source, docs, source_size, target``: shares by weight, stopped at ``limit`` times the size.

    What a stop cuts off is shared again among the others.  A round needs two sums of
    the source table; only those reach the driver.
    """
    spark = sources.sparkSession
    ordered = keep(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    before = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    place = F.col("before") + F.row_number().over(inside) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    table = keep(
        ordered.join(before, "part").withColumn("place", place).withColumn("weight", weight)
        .select("source", "docs", "source_size", "weight"), "sources",
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    stopped, rest, level = F.lit(False), float(total), 0.0
    most = F.col("source_size") * limit
    while True:
        open_weight, used = table.agg(
            F.sum(F.when(~stopped, F.col("weight"))), F.sum(F.when(stopped, most))
        ).first()
        rest = total - (used or 0)
        level = rest / open_weight if open_weight else 0.0
        share = F.lit(level) * F.col("weight")
        again = stopped | (share > most)
        if not open_weight or not table.filter(again & ~stopped).limit(1).count():
            break
        stopped = again
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(open_weight or 1))
    target = F.when(stopped, most.cast("double")).otherwise(share)
    return keep(table.select("source", "docs", "source_size", target.alias("target")), "targets")


def _rate(tilt: Column, size: Column, mean: Column, limit: int) -> Column:
    # a power this large is far beyond the limit already
    return F.least(F.lit(float(limit)), F.exp(F.least(tilt * size / mean, F.lit(50.0))))


def _tilts(sizes: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """``source, tilt`` by Newton steps, kept between bounds that shrink at every step.

    A source at its stop has rate ``limit`` throughout, the dual's end at infinity, and
    needs no step; one without words has none either.
    """
    free = targets.filter((F.col("source_size") > 0) & (F.col("target") < limit * F.col("source_size")))
    mean = F.col("source_size") / F.col("docs")
    state = free.select(
        "source", "target", mean.alias("mean"), F.log(F.col("target") / F.col("source_size")).alias("tilt"),
        F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
    )
    state = keep(state, "tilts")
    for _ in range(STEPS):
        power = F.col("tilt") * F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), limit)
        gained = F.col("n") * F.col("size") * rate
        slope = F.when(power < F.log(F.lit(float(limit))), gained * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = sizes.join(state.select("source", "tilt", "mean"), sizes["source"].eqNullSafe(state["source"])).groupBy(
            sizes["source"]
        ).agg(F.sum(gained).alias("got"), F.sum(slope).alias("slope"))
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        joined = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumns(
            {"off": F.abs(gap) / F.greatest("target", F.lit(1.0)), "low": low, "high": high,
             "next": F.col("tilt") - gap / F.col("slope")}
        )
        inside = F.col("next").isNotNull() & (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
        middle = (
            F.when(F.col("low") == float("-inf"), F.col("high") * 2 - 1)
            .when(F.col("high") == float("inf"), F.col("low") * 2 + 1)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        moved = F.when(F.col("off") <= CLOSE, F.col("tilt")).when(inside, F.col("next")).otherwise(middle)
        state = keep(joined.select("source", "target", "mean", moved.alias("tilt"), "low", "high", "off"), "tilts")
        if not state.filter(F.col("off") > CLOSE).limit(1).count():
            break
        state = state.drop("off")
    return state.select("source", "tilt")


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row of ``docs``.

    Sources by code point, a null source last and a source like any other, take the
    weights in turn; all sizes together are shared by weight, at most ``limit`` times a
    source's own size.  ``copies`` is 0 to ``limit``, ``taken`` is copies times size.
    Null and empty texts have size 0.  Rows equal in id, source and size share their copies
    as evenly as whole numbers allow.  Without rows the result is empty.  Other columns are not read.
    """
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    sized = keep(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sizes = keep(sized.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    sources = sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = _targets(sources, weights, limit)
    tilts = _tilts(sizes, targets, limit)
    plan = targets.join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "docs", "source_size", "target", "tilt"
    )
    rate = F.when(F.col("tilt").isNotNull(), _rate(F.col("tilt"), F.col("size"), F.col("source_size") / F.col("docs"), limit))
    rate = F.coalesce(rate, F.when(F.col("source_size") > 0, F.lit(float(limit))).otherwise(F.lit(1.0)))
    stretch = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("docs") / STRETCH))
    rated = sized.join(plan, sized["source"].eqNullSafe(F.col("s"))).select(
        "source", "source_size", "target", stretch.alias("stretch"),
        F.struct((-F.col("size")).alias("order"), F.xxhash64("doc_id", F.lit(7)).alias("mixed"), "doc_id", "n", rate.alias("rate")).alias("item"),
    )
    lists = rated.groupBy("source", "stretch").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sort_array(F.collect_list("item")).alias("items")
    )
    took = f"""aggregate(items, named_struct('rest', 0D, 'took', cast(array() as array<bigint>)), (a, x) -> named_struct(
        'rest', a.rest - x.order * (x.n * x.rate - {_WHOLE.format(limit=limit)}),
        'took', concat(a.took, array({_WHOLE.format(limit=limit)}))), a -> a.took)"""
    rows = lists.withColumn("took", F.expr(took)).select(
        "source", "source_size", "target", F.explode(F.arrays_zip("items", "took")).alias("x")
    ).select(
        F.col("x.items.doc_id").alias("doc_id"), "source", (-F.col("x.items.order")).alias("size"), "source_size", "target",
        F.col("x.took").alias("all"), F.col("x.items.n").alias("n"),
    )
    # equal rows share what was taken of them
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    copies_of = F.expr("cast(all div n + if(i < all % n, 1, 0) as int)")
    return each.select(
        "doc_id", "source", "size", "source_size", "target", copies_of.alias("copies"), (copies_of * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns stay.

    Rows of one ``doc_id`` share the first one's copies, rows without id are taken once.
    """
    plan = copies(docs.filter(F.col("doc_id").isNotNull()), weights, limit)
    plan = plan.groupBy("doc_id").agg(F.min("copies").alias("_copies"))
    taken = docs.join(plan, "doc_id", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    often = F.expr("explode(array_repeat(true, _copies))").alias("_again")
    return taken.filter("_copies > 0").select(*docs.columns, often).drop("_again")
