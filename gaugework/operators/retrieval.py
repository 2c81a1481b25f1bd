"""Ranking of chunks per metric, for every document and metric at once.

A chunk is read once: the rule terms it contains are found in one pass, and all
metrics are then judged on those few terms.  Documents are ranked whole, where their
chunks lie; of the very long ones narrow rows are moved, and texts are joined back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.functions.constants import constant, let, lookup, words_constant
from gaugework.functions.masks import BITS, Terms
from gaugework.functions.ranking import DIGITS, FOUND, Ranker
from gaugework.functions.verdicts import PARTS, Judge
from gaugework.operators.chunking import UNKNOWN
from gaugework.operators.groups import long_groups, top_per_group, unnest
from gaugework.rules import relevance as R
from gaugework.rules.catalogue import METRICS, Metric
from gaugework.session import cut_lineage, keep_table

#: Rows of (chunk, metric) of a document that one task may rank together; longer ones are cut down first.
MOST_TOGETHER = 500_000
_SETS = ("must", "exclude", "fallback", "penalty", "hints", "phrases")


def _lower(terms: Sequence[str]) -> list[str]:
    return [t.lower() for t in terms]


def _rules(metrics: Sequence[Metric]) -> list[dict]:
    out = []
    for m in metrics:
        gate = R.gate_of(m.name)
        out.append(
            {
                "kpi": m.name,
                "first": m.first_words(),
                "phrases": [k.lower() for k in m.keywords if len(k.split()) > 1],
                "keywords": list(m.keywords),
                "must": _lower(gate.must_match),
                "exclude": _lower(gate.must_exclude),
                "fallback": _lower(gate.unit_fallback),
                "penalty": _lower(gate.penalty_terms),
                "hints": _lower(gate.unit_hints),
            }
        )
    return out


def _once(items) -> list[str]:
    return list(dict.fromkeys(items))


class RuleBook:
    """Rules of some metrics with their terms numbered.

    ``terms`` are looked for in the text, ``first`` (first words of keywords) in the
    keyword index.  A first word counts once for each keyword that begins with it, so a rule
    has one mask of the first words that occur at least once, one of those that occur twice,
    and so on.
    """

    def __init__(self, rules: list[dict]):
        self.rules = rules
        self.terms = Terms(t for r in rules for s in _SETS for t in r[s])
        self.first = Terms(w for r in rules for w in r["first"])

    def _layers(self, words: list[str]) -> list[tuple[int, ...]]:
        times = Counter(words)
        return [self.first.mask(w for w in times if times[w] > k) for k in range(max(times.values(), default=1))]

    def judge(self, carried: Sequence[str], strict_exclude: bool = False, full: bool = False) -> Judge:
        layers = [self._layers(r["first"]) for r in self.rules]
        return Judge(self.rules, self.terms, self.first, layers, strict_exclude, full, carried)


def _carried(chunks: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "chunk_index", "page_number", "chunk_type") if c in chunks.columns]


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def chunk_features(chunks: DataFrame, *also: str) -> DataFrame:
    """What every metric needs to know about a chunk, worked out once per chunk."""
    text = F.col("content")
    kind = F.col("chunk_type")
    real = (T.pipe_count(text) >= R.MIN_PIPES) | (T.numeric_density(text) >= R.MIN_NUMERIC_DENSITY)
    return chunks.select(
        *_carried(chunks), *also,
        F.lower("content").alias("_lower"),
        T.found(text, r"\d").alias("_digit"),
        T.found(text, R.UNIT_PRESENT, "i").alias("_unit"),
        T.found(text, R.DATA_SENTENCE, "i").alias("_data"),
        T.found(text, R.UNIT_AFTER_NUMBER, "i").alias("_unit_number"),
        F.when(kind == "table", real).otherwise(F.lit(False)).alias("_real_table"),
        F.pow(F.greatest(F.coalesce("token_count", F.lit(1)), F.lit(1)), F.lit(R.LENGTH_POWER)).alias("_length"),
    ).withColumn(
        "_factor",
        F.when(kind == "table", F.when(F.col("_real_table"), R.TABLE_FACTOR).otherwise(R.PROSE_TABLE_FACTOR))
        .when(kind == "footnote", R.FOOTNOTE_FACTOR)
        .otherwise(1.0),
    )


def _breakdown(judged: DataFrame, book: RuleBook) -> DataFrame:
    """Parts of the score as one column, with the terms found by name."""
    by_name = lambda s: lookup(F.col("kpi"), {r["kpi"]: r[s] for r in book.rules}, "array<string>")
    mask = lambda head, n: F.struct(*[F.col(f"{head}{j}").alias(f"m{j}") for j in range(n)])
    near = book.first.listed(mask("_n", book.first.words))
    return judged.select(
        *[c for c in judged.columns if c not in PARTS and not c.startswith("_")],
        F.struct(
            *PARTS,
            F.array_intersect(by_name("penalty"), book.terms.listed(mask("_h", book.terms.words))).alias("penalty_hits"),
            let(near, lambda words: F.filter(
                by_name("keywords"), lambda k: F.array_contains(words, F.substring_index(F.lower(k), " ", 1))
            )).alias("matched_kws"),
        ).alias("breakdown"),
    )


def _judged(chunks: DataFrame, book: RuleBook, strict_exclude: bool, full: bool, everything: bool = False) -> DataFrame:
    """Rows of (chunk, metric) with tier and score: all, or those that the keyword index offers."""
    features = chunk_features(chunks, "keywords")
    judge = book.judge(_carried(chunks), strict_exclude, full)
    schema = _fields(chunks, _carried(chunks)) + "kpi string, tier int, score double"
    if full:
        schema += "".join(f", {name} {kind}" for name, kind in PARTS.items())
        schema += "".join(f", _h{j} long" for j in range(book.terms.words)) + "".join(f", _n{j} long" for j in range(book.first.words))
    return features.mapInArrow(judge.every_candidate if everything else judge.candidates, schema)


def _judged_lists(chunks: DataFrame, book: RuleBook, strict_exclude: bool) -> DataFrame:
    """Every chunk with its metrics (as numbers in the book), tiers and scores as lists: light to store and to move."""
    keys = ["doc_id", "chunk_index", "page_number"]
    judge = book.judge(keys, strict_exclude)
    return chunk_features(chunks, "keywords").mapInArrow(
        judge.listed, _fields(chunks, keys) + "kpi array<int>, tier array<int>, score array<double>"
    )


def _pairs(judged: DataFrame) -> DataFrame:
    """Rows of (chunk, metric) of such lists."""
    keys = ["doc_id", "chunk_index", "page_number"]
    rows = unnest(judged, F.arrays_zip("kpi", "tier", "score"), "_pair", *keys)
    return rows.select(*keys, "_pair.kpi", "_pair.tier", "_pair.score")


def judge_chunks(
    chunks: DataFrame, metrics: Sequence[Metric] = METRICS, strict_exclude: bool = False, full: bool = True
) -> DataFrame:
    """Every candidate (chunk, metric) with tier, score and breakdown.

    Tier 0 passes the strict gate, tier 1 only the unit fallback, tier 2 neither.
    """
    book = RuleBook([r for r in _rules(metrics) if r["first"]])
    judged = _judged(chunks, book, strict_exclude, full)
    return _breakdown(judged, book) if full else judged


def relevance(chunks: DataFrame, metrics: Sequence[Metric] = METRICS, reasons: bool = True) -> DataFrame:
    """Strict and fallback gate per (chunk, metric), with the reason as text if asked for."""
    book = RuleBook(_rules(metrics))
    keys = ["doc_id", "chunk_index"]
    seen = chunks.select(
        *keys, F.lower("content").alias("_lower"), T.found(F.col("content"), R.UNIT_AFTER_NUMBER, "i").alias("_unit_number")
    )
    schema = _fields(chunks, keys) + "kpi string, relevant boolean, fallback boolean"
    if reasons:
        schema += ", reason string, fallback_reason string"
    return seen.mapInArrow(book.judge(keys, full=reasons).gates, schema)


def _by_score() -> list[Column]:
    return [F.bround("score", DIGITS).desc(), F.col("chunk_index")]


def around(places: DataFrame, shared: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per place the chunks before, at and after it (``_at0`` to ``_at2``, null where there is none) with their pages."""
    reach = unnest(places, F.array(F.lit(-1), F.lit(0), F.lit(1)), "_step", *shared, "chunk_index", "page_number").select(
        *shared, (F.col("chunk_index") - F.col("_step")).alias("chunk_index"), F.struct("_step", "page_number").alias("_met")
    )
    return reach.groupBy(*shared, "chunk_index").agg(
        *[F.max(F.when(F.col("_met._step") == i, F.col("_met"))).alias(f"_at{i + 1}") for i in (-1, 0, 1)]
    )


def stitch(
    anchors: DataFrame, pool: DataFrame, keys: list[str], most: int
) -> DataFrame:
    """Add the chunks next to each anchor, page by page, and cap the result.

    ``anchors`` has keys, chunk_index, page_number, score and rank; ``pool`` offers
    the chunks that may be added, by doc_id (and further shared keys).  An anchor
    that an earlier anchor already reached counts as its neighbour.
    """
    shared = [k for k in keys if k in pool.columns]
    near = around(pool.select(*shared, "chunk_index", "page_number"), shared)
    return _stitched(anchors.join(near, [*shared, "chunk_index"]), keys, most)


def _stitched(anchors: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The same for anchors that hold the chunks around them."""
    met = unnest(anchors, F.array("_at0", "_at1", "_at2"), "_met", *keys, "rank", "score", F.col("page_number").alias("_page"), "chunk_index").select(
        *keys, "rank", "score", "_page", F.col("_met._step").alias("_step"),
        (F.col("chunk_index") + F.col("_met._step")).alias("chunk_index"), F.col("_met.page_number").alias("page_number"),
    ).filter(
        (F.col("_step") == 0)
        | F.col("_page").isNull()
        | F.col("page_number").isNull()
        | (F.col("_page") == F.col("page_number"))
    )
    own = F.col("_step") == 0
    chosen = met.groupBy(*keys, "chunk_index").agg(
        F.max("page_number").alias("page_number"),
        F.min(F.when(own, F.col("rank"))).alias("_own"),
        F.max(F.when(own, F.col("score"))).alias("_score"),
        F.min(F.when(~own, F.struct("rank", "_step"))).alias("_from"),
    )
    primary = F.col("_own").isNotNull() & (
        F.col("_from").isNull() | (F.col("_from.rank") > F.col("_own"))
    )
    listed = chosen.select(
        *keys, "chunk_index", "page_number",
        F.when(primary, F.col("_score")).otherwise(F.lit(R.NEIGHBOUR_SCORE)).alias("score"),
        (~primary).alias("is_neighbor"),
        F.when(primary, F.col("_own")).otherwise(F.col("_from.rank")).alias("_a"),
        F.when(primary, F.lit(0)).otherwise(F.col("_from._step")).alias("_b"),
    )
    order = [F.col("is_neighbor"), F.bround("score", DIGITS).desc(), F.col("_a"), F.col("_b")]
    return top_per_group(listed, keys, order, most, rank="position").drop("_a", "_b")


def _together(chunks: DataFrame) -> DataFrame:
    """The rows of a document one after the other in one task, with their number; moved only where they do not lie so."""
    return chunks.filter(F.col("doc_id").isNotNull()).withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy("doc_id")).cast("int"))


def _names(metrics: Sequence[Metric], book: RuleBook) -> list[str]:
    return _once([*(r["kpi"] for r in book.rules), *(m.name for m in metrics)])


def long_documents(chunks: DataFrame, metrics: Sequence[Metric] = METRICS) -> DataFrame | None:
    """Documents with more rows of (chunk, metric) than one task should rank, or None where there are none."""
    return long_groups(chunks, "doc_id", MOST_TOGETHER // max(len(metrics), 1))


def _wide_rules(metrics: Sequence[Metric]) -> list[tuple[str, list[str]]]:
    return [
        (m.name, _once(p.lower().split()[0] for p in (*m.keywords, *m.aliases)))
        for m in metrics
        if m.keywords or m.aliases
    ]


def _ranked(
    chunks: DataFrame, metrics: Sequence[Metric], top_k: int, strict_exclude: bool, carried: Sequence[str], every: bool, extra: int = 0
) -> DataFrame:
    book = RuleBook([r for r in _rules(metrics) if r["first"]])
    names = _names(metrics, book)
    keys = _once(["doc_id", "chunk_index", "page_number", *carried])
    wide = [(names.index(name), words) for name, words in _wide_rules(metrics)] if extra else ()
    out = [*keys, "_rows"] if every else keys
    ranker = Ranker(
        book.judge(keys, strict_exclude), names, [names.index(m.name) for m in metrics if m.keywords], min(top_k, R.MAX_K), out, wide, extra
    )
    together = _together(chunks.withColumn("_words", F.array_join("keywords", " ")) if extra else chunks)
    also = ["keywords", "_rows", *(["_words"] if extra else []), *[c for c in keys if c not in _carried(chunks)]]
    schema = _fields(together, out) + f"asked array<{FOUND}>" + (", wide array<struct<kpi:string,position:int>>" if extra else "")
    return chunk_features(together, *also).mapInArrow(ranker.every_chunk if every else ranker.by_chunk, schema)


def found_chunks(
    chunks: DataFrame,
    metrics: Sequence[Metric] = METRICS,
    top_k: int = R.REQUESTED_K,
    strict_exclude: bool = False,
    long: DataFrame | None | object = UNKNOWN,
    carried: Sequence[str] = ("chunk_type", "content"),
) -> DataFrame:
    """Every chunk that is among the best of some metric, once, with metric, position, score and mark for each (``asked``).

    The chunks of a document are judged and ranked where they lie together, so a row of (chunk,
    metric) is never moved or stored, and a text at most once.  Documents with more than
    ``MOST_TOGETHER`` such rows are ranked in parts (see ``_retrieve_long``).  ``long`` holds
    those (doc_id), or is None if there are none; left out, they are looked for, which
    reads ``chunks`` once more.
    """
    long = long_documents(chunks, metrics) if long is UNKNOWN else long
    found = _ranked(short_ones(chunks, long), metrics, top_k, strict_exclude, carried, every=False)
    if long is None:
        return found
    some = chunks.join(long, "doc_id", "left_semi")
    said = _retrieve_long(some, metrics, top_k, strict_exclude).groupBy("doc_id", "chunk_index").agg(
        F.collect_list(F.struct("kpi", "position", "score", "is_neighbor")).alias("asked")
    )
    keys = _once(["doc_id", "chunk_index", "page_number", *carried])
    return found.unionByName(some.select(*keys).join(said, ["doc_id", "chunk_index"]))


def short_ones(chunks: DataFrame, long: DataFrame | None) -> DataFrame:
    return chunks if long is None else chunks.join(long, "doc_id", "left_anti")


def every_chunk(chunks: DataFrame, metrics: Sequence[Metric] = METRICS, top_k: int = R.REQUESTED_K, extra: int = 0) -> DataFrame:
    """Every chunk of short documents with what it was found for (``asked``, may be empty), document by document.

    With ``extra``, up to so many further chunks per (document, metric) are marked too
    (``wide``), as :func:`wider` has them.  ``_rows`` is the number of a document's rows,
    which stay one after the other: what works on whole documents may follow.
    """
    return _ranked(chunks, metrics, top_k, False, ("chunk_type", "content"), True, extra)


def retrieve_wider(
    chunks: DataFrame, metrics: Sequence[Metric] = METRICS, extra: int = 5, long: DataFrame | None | object = UNKNOWN
) -> DataFrame:
    """What :func:`wider` adds to :func:`retrieve`, worked out where the chunks of a document lie."""
    long = long_documents(chunks, metrics) if long is UNKNOWN else long
    keys = ["doc_id", "chunk_index", "page_number", "chunk_type"]
    marked = _ranked(short_ones(chunks, long), metrics, R.REQUESTED_K, False, ("chunk_type",), True, extra)
    found = _as_wider(unnest(marked, F.col("wide"), "_for", *keys).select(
        "doc_id", "_for.kpi", "chunk_index", "page_number", "chunk_type", "_for.position"
    ))
    if long is None:
        return found
    some = chunks.join(long, "doc_id", "left_semi")
    return found.unionByName(wider(some, retrieve(some, metrics, long=long), metrics, extra).select(*found.columns))


def _as_wider(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.lit(R.WIDER_SCORE)).withColumn("is_neighbor", F.lit(False))


def retrieve(
    chunks: DataFrame,
    metrics: Sequence[Metric] = METRICS,
    top_k: int = R.REQUESTED_K,
    strict_exclude: bool = False,
    long: DataFrame | None | object = UNKNOWN,
) -> DataFrame:
    """Best chunks per (document, metric): gate, score, page bonus, top k, neighbours; see :func:`found_chunks`."""
    return one_per_metric(found_chunks(chunks, metrics, top_k, strict_exclude, long, ()))


def one_per_metric(found: DataFrame, *also: str) -> DataFrame:
    """Rows of (document, metric, chunk) of chunks found."""
    return unnest(found, F.col("asked"), "_for", "doc_id", "chunk_index", "page_number", *also).select(
        "doc_id", "_for.kpi", "chunk_index", "page_number", "_for.score", "_for.is_neighbor", "_for.position", *also
    )


def _retrieve_long(chunks: DataFrame, metrics: Sequence[Metric], top_k: int, strict_exclude: bool) -> DataFrame:
    """The same for documents of any length, which are cut down to the rows that can still win before anything is gathered.

    The text is read once: the narrow rows of (chunk, metric) are written out.
    """
    k, key = min(top_k, R.MAX_K), ["doc_id", "kpi"]
    book = RuleBook([r for r in _rules(metrics) if r["first"]])
    names = _names(metrics, book)
    judged = keep_table(_judged_lists(chunks, book, strict_exclude), "judged")
    places = judged.select("doc_id", "chunk_index", "page_number")
    found = stitch(_long_anchors(_pairs(judged), k), places, key, 2 * k)
    found = found.unionByName(_positional(judged, [names.index(m.name) for m in metrics if m.keywords], k))
    return found.withColumn("kpi", F.get(words_constant(names), F.col("kpi")))


def _allowed(n0: Column, n1: Column) -> Column:
    """Last tier that supplies rows, by the rows of tiers 0 and 1."""
    return F.when((n0 >= R.MIN_RELEVANT) | ((n0 > 0) & (n1 == 0)), 0).when(n1 > 0, 1).otherwise(2)


def _long_anchors(judged: DataFrame, k: int) -> DataFrame:
    """The k best rows per (document, metric) after the page bonus; no more than a few rows of a document are gathered.

    Within one page, tier and metric only the first ``k + 3`` scores can end in the top k:
    the page bonus keeps their order, and only the three best rows go without it.
    """
    key = ["doc_id", "kpi"]
    per_page = cut_lineage(
        top_per_group(judged, [*key, "tier", "page_number"], _by_score(), k + R.PAGE_BONUS_TOP)
    )
    heads = top_per_group(per_page, [*key, "tier"], _by_score(), max(k, R.MIN_RELEVANT))

    # These rows are enough to tell which tiers are used.
    group = W.partitionBy(*key)
    n0, n1 = (F.count_if(F.col("tier") == t).over(group) for t in (0, 1))
    usable = (
        heads.withColumn("_allowed", _allowed(n0, n1))
        .filter((F.col("tier") <= F.col("_allowed")) & (F.col("score") > 0))
    )
    leaders = top_per_group(usable, key, _by_score(), k, rank="_raw")

    # Pages of the three best rows, spread over the tiers that may supply rows.
    bonus_pages = (
        leaders.filter((F.col("_raw") <= R.PAGE_BONUS_TOP) & (F.col("page_number") != 0))
        .select(
            *key, "page_number",
            F.explode(F.sequence(F.lit(0), F.col("_allowed"))).alias("tier"),
        )
        .distinct()
    )
    on_page = per_page.join(
        bonus_pages, [*key, "tier", "page_number"], "left_semi"
    ).filter(F.col("score") > 0)
    firsts = leaders.select(*key, "chunk_index", F.lit(True).alias("_first"), "_raw")
    pool = on_page.withColumn("_on_page", F.lit(True)).unionByName(
        leaders.select(*on_page.columns).withColumn("_on_page", F.lit(False))
    )
    raised = (
        pool.groupBy(*key, "chunk_index")
        .agg(
            F.max("page_number").alias("page_number"),
            F.max("score").alias("score"),
            F.max("_on_page").alias("_on_page"),
        )
        .join(firsts, [*key, "chunk_index"], "left")
        .withColumn(
            "score",
            F.col("score")
            + F.when(
                F.col("_on_page") & (F.coalesce("_raw", F.lit(k)) > R.PAGE_BONUS_TOP),
                F.lit(R.PAGE_BONUS),
            ).otherwise(F.lit(0.0)),
        )
    )
    order = [F.bround("score", DIGITS).desc(), F.coalesce("_raw", F.lit(k + 1)), F.col("chunk_index")]
    return top_per_group(raised, key, order, k, rank="rank").drop("_first", "_raw", "_on_page")


def _positional(judged: DataFrame, numbers: Sequence[int], k: int) -> DataFrame:
    """First k chunks, score 0, for every (document, metric) without a candidate.

    A document's metrics with candidates are one mask; only those that lack one make rows.
    """
    words = max(numbers, default=0) // BITS + 1
    zero = F.lit(0).cast("long")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n % BITS)
    mask = lambda j: F.aggregate(
        "kpi", zero, lambda m, n: m.bitwiseOR(F.when((n >= j * BITS) & (n < (j + 1) * BITS), bit(n)).otherwise(zero))
    )
    have = judged.select("doc_id", *[mask(j).alias(f"_m{j}") for j in range(words)]).groupBy("doc_id").agg(
        *[F.bit_or(f"_m{j}").alias(f"_m{j}") for j in range(words)]
    )
    places = judged.select("doc_id", "chunk_index", "page_number")
    opening = top_per_group(places, ["doc_id"], [F.col("chunk_index")], k, rank="position").join(have, "doc_id", "left")
    lacking = F.array(*[
        F.when(F.coalesce(F.col(f"_m{n // BITS}").bitwiseAND(F.lit(1 << n % BITS)), zero) == 0, F.lit(n)) for n in numbers
    ]).cast("array<int>")
    return unnest(opening, lacking, "kpi", "doc_id", "chunk_index", "page_number", "position").select(
        "doc_id", "kpi", "chunk_index", "page_number",
        F.lit(0.0).alias("score"), F.lit(False).alias("is_neighbor"), "position",
    )


def _may_hold(keywords: Sequence[str]) -> Column:
    """True for every text in whose index one of ``keywords`` can be found: its parts are in the text or in the mark of numbers."""
    may = F.lit(False)
    for word in keywords:
        parts = [p for p in word.lower().split(" ") if p and p not in T.NUMBER_MARK]
        inside = F.lit(True)
        for p in parts:
            inside = inside & F.contains(F.lower("content"), F.lit(p))
        may = may | inside
    return may


def search(
    chunks: DataFrame,
    keywords: Sequence[str],
    top_k: int = R.REQUESTED_K,
    chunk_types: Sequence[str] | None = None,
    long: DataFrame | None | object = UNKNOWN,
) -> DataFrame:
    """Ad-hoc keyword search in every document, with stitched neighbours.

    ``chunks`` are read once, so they need not be stored.  Texts that lack the asked words
    go before their keywords are made.  What is found of a document is ranked where it
    lies; of documents with more than ``MOST_TOGETHER`` chunks (``long``, see
    :func:`found_chunks`) narrow rows are stored and moved.
    """
    asked = Metric("", "", "", "", "", None, None, keywords=tuple(keywords))
    index = F.array_join("keywords", " ")
    wanted = F.lit(False)
    for word in keywords:
        wanted = wanted | F.contains(index, F.lit(word.lower()))
    found = chunks.filter(_may_hold(keywords)).filter(wanted)
    if chunk_types:
        found = found.filter(F.col("chunk_type").isin(*chunk_types))
    if long is UNKNOWN:
        long = long_groups(found, "doc_id", MOST_TOGETHER)
    book, keys = RuleBook(_rules([asked])), ["doc_id", "chunk_index", "page_number"]
    ranker = Ranker(book.judge(keys), [""], [], top_k, keys)
    ranked = chunk_features(_together(short_ones(found, long)), "keywords", "_rows").mapInArrow(
        ranker.searched, _fields(chunks, keys) + "score double, is_neighbor boolean, position int"
    )
    if long is None:
        return ranked
    # every chunk found is judged once, so these narrow rows are the pool of neighbours too
    some = found.join(long, "doc_id", "left_semi")
    judged = keep_table(_judged(some, book, False, full=False, everything=True).select(*keys, "score"), "judged")
    anchors = top_per_group(judged.filter(F.col("score") > 0), ["doc_id"], _by_score(), top_k, rank="rank")
    return ranked.unionByName(stitch(anchors, judged, ["doc_id"], 2 * top_k))


def funnel(
    chunks: DataFrame, metrics: Sequence[Metric] = METRICS, top_k: int = R.MAX_K, long: DataFrame | None | object = UNKNOWN
) -> DataFrame:
    """Candidates, gate passes, positive scores and finalists per (document, metric), counted where a document's chunks lie."""
    long = long_documents(chunks, metrics) if long is UNKNOWN else long
    book = RuleBook([r for r in _rules(metrics) if r["first"]])
    ranker = Ranker(book.judge(["doc_id"], full=True), [r["kpi"] for r in book.rules], [], top_k, ["doc_id"])
    counts = "".join(f", {c} long" for c in ("candidates", "passed", "dropped", "scored", "final", "answerable"))
    counted = chunk_features(_together(short_ones(chunks, long)), "keywords", "_rows").mapInArrow(
        ranker.funnel, _fields(chunks, ["doc_id"]) + "kpi string" + counts + ", lowest double, highest double"
    )
    return counted if long is None else counted.unionByName(_funnel_long(chunks.join(long, "doc_id", "left_semi"), metrics, top_k))


def _funnel_long(chunks: DataFrame, metrics: Sequence[Metric], top_k: int) -> DataFrame:
    """The same for documents of any length."""
    passed, scored = F.col("tier") == 0, (F.col("tier") == 0) & (F.col("score") > 0)
    return judge_chunks(chunks, metrics).groupBy("doc_id", "kpi").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("dropped"),
        F.count_if(scored).alias("scored"),
        F.least(F.count_if(scored), F.lit(top_k)).alias("final"),
        F.count_if(scored & F.col("breakdown.answerable")).alias("answerable"),
        F.min(F.when(scored, F.col("score"))).alias("lowest"),
        F.max(F.when(scored, F.col("score"))).alias("highest"),
    )


def attach_text(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join type and text back to the few rows that retrieval kept."""
    return found.join(
        chunks.select("doc_id", "chunk_index", "chunk_type", "content"), ["doc_id", "chunk_index"]
    )


def wider(
    chunks: DataFrame, found: DataFrame, metrics: Sequence[Metric] = METRICS, extra: int = 5
) -> DataFrame:
    """Up to ``extra`` further chunks per (document, metric) by keyword or alias."""
    rules = _wide_rules(metrics)
    words = Terms(w for r in rules for w in r[1])
    offers = constant([(name, words.mask(first)) for name, first in rules], f"array<struct<kpi:string,first:{words.type}>>")
    seen = chunks.select(
        "doc_id", "chunk_index", "page_number", "chunk_type", words.found_in(F.array_join("keywords", " ")).alias("_in")
    )
    kpis = F.transform(F.filter(offers, lambda r: words.meet(r["first"], F.col("_in"))), lambda r: r["kpi"])
    offered = unnest(seen, kpis, "kpi", "doc_id", "chunk_index", "page_number", "chunk_type")
    fresh = offered.join(found, ["doc_id", "kpi", "chunk_index"], "left_anti")
    order = [
        F.col("chunk_type").desc(), F.col("page_number").asc_nulls_last(), F.col("chunk_index")
    ]
    return _as_wider(top_per_group(fresh, ["doc_id", "kpi"], order, extra, rank="position"))
