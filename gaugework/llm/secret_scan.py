"""Secrets in text: strong spans by pattern, weak ones by linking the parts of a credential.

A password assignment, an access key or a long hex string is a secret by itself.  A user
name, a short password, a mixed token or a server address is not: such a weak candidate
is reported only where a complementary part stands near it in the same scope.

* sides: identifier, secret, endpoint; a secret complements the other two, and they it;
* scope: text without a blank line; parts of different scopes are never linked;
* near: the parts do not overlap, and at most ``REACH`` code points lie between them.

Parts are intervals, joined by position.  Positions are dealt into bins as wide as the
reach, and of each bin only its first and last end and start are kept: a part meets a
complement exactly if one of its own or the next bin's four positions says so.  So the
join gives at most a few rows for each part and no pair of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.constants import let
from gaugework.llm.staging import keep

REACH = 200
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
BASE = KINDS[:3]
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
#: Sides that a part of each side needs near it.
COMPLEMENTS = {IDENTIFIER: (SECRET,), SECRET: (IDENTIFIER, ENDPOINT), ENDPOINT: (SECRET,)}
#: A hex string of so many characters counts as a secret in links; shorter ones are often plain numbers.
LONG_HEX = 32
BREAK = "\n\n"

_LEVEL = 128


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _assignment(names: tuple[str, ...], value: str) -> str:
    """Name, mark and value; group 2 is the value.  No part can match a line end."""
    return f"({'|'.join(map(_either_case, names))})[\"']?\\x20*[:=]\\x20*[\"']?({value}+)"


# The base patterns as the task words them.
ASSIGN = _assignment(("password", "passwd", "secret", "token", "api_?key"), "[A-Za-z0-9+/_.=-]")
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
LEAST_VALUE = 12

LOGIN = _assignment(("access_?key_?id", "client_?id", "account", "user_?name", "user", "login"), "[A-Za-z0-9+/_.@=-]")
CODE = _assignment(("passphrase", "credential", "private_?key", "access_?key", "auth", "pwd", "pass"), "[A-Za-z0-9+/_.=-]")
HOST = _assignment(("host_?name", "host", "endpoint", "server"), "[A-Za-z0-9.:/_-]")
ADDRESS = "(?:https?|ftp|s3|gs|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:[+]srv)?|redis|amqps?|ldaps?|ssh)://[^\\x00-\\x20\"'<>]+"
TEMPORARY = "ASIA[A-Z0-9]{12,}"
TOKEN = "[A-Za-z0-9+/_-]{32,}"

#: Pattern, group whose length counts, kind, side, least length, first length too long (0: none), text that must occur.
PATTERNS = (
    (ASSIGN, 2, "assign", SECRET, LEAST_VALUE, 0, "[:=]"),
    (ACCESS, 0, "access", IDENTIFIER, 0, 0, "AKIA"),
    (HEX, 0, "hex", SECRET, 0, 0, ""),
    (ASSIGN, 2, "key", SECRET, 6, LEAST_VALUE, "[:=]"),
    (LOGIN, 2, "identifier", IDENTIFIER, 3, 0, "[:=]"),
    (TEMPORARY, 0, "identifier", IDENTIFIER, 0, 0, "ASIA"),
    (CODE, 2, "key", SECRET, 6, 0, "[:=]"),
    (TOKEN, 0, "key", SECRET, 1, 0, ""),
    (HOST, 2, "endpoint", ENDPOINT, 4, 0, "[:=]"),
    (ADDRESS, 0, "endpoint", ENDPOINT, 0, 0, "://"),
)

_PART = "array<struct<start:int,kind:int,stop:int,scope:int,side:int>>"


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _running(numbers: Column) -> Column:
    """Sums of an array up to each element, over blocks, so that long arrays stay cheap."""

    def inside(a: Column, before: Column) -> Column:
        block = lambda i: F.floor(i / _LEVEL).cast("int")
        return F.transform(a, lambda _, i: F.get(before, block(i)) + _total(F.slice(a, block(i) * _LEVEL + 1, i % _LEVEL + 1)))

    def blocks(a: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _LEVEL).cast("int"))
        sums = F.transform(places, lambda b: _total(F.slice(a, b * _LEVEL + 1, F.lit(_LEVEL))))
        before = let(sums, lambda s: F.transform(s, lambda _, b: _total(F.slice(s, F.lit(1), b))))
        return let(before, lambda p: inside(a, p))

    return let(numbers, blocks)


def _parts(text: Column, pattern: str, group: int, kinds: list[tuple]) -> Column:
    """Parts of one pattern, in order; positions come from what lies between the matches."""
    none = F.array().cast(_PART)

    def made(found: Column, sizes: Column, gaps: Column) -> Column:
        steps = F.transform(sizes, lambda _, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
        breaks = F.transform(sizes, lambda _, i: let(F.get(gaps, i), lambda g: (F.length(g) - F.length(F.replace(g, F.lit(BREAK)))) / 2).cast("int"))

        def of_kind(starts: Column, scopes: Column, kind: str, side: int, least: int, most: int) -> Column:
            def part(n: Column, i: Column) -> Column:
                shown = F.when(n >= LONG_HEX, side) if kind == "hex" else F.lit(side)
                return F.when((n >= least) & (n < most if most else F.lit(True)), F.struct(
                    F.get(starts, i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                    (F.get(starts, i) + F.length(F.get(found, i))).alias("stop"), F.get(scopes, i).alias("scope"), shown.alias("side"),
                ))

            return F.filter(F.transform(sizes, part), lambda x: x.isNotNull()).cast(_PART)

        def of(starts: Column, scopes: Column) -> Column:
            return F.concat(*[of_kind(starts, scopes, *row[2:6]) for row in kinds])

        return let(_running(steps), lambda starts: let(_running(breaks), lambda scopes: of(starts, scopes)))

    def placed(found: Column) -> Column:
        measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        sizes = F.transform(measured, lambda x: F.when(_mixed(x), F.length(x)).otherwise(0) if pattern == TOKEN else F.length(x))
        parts = let(sizes, lambda n: let(F.split(text, pattern), lambda gaps: made(found, n, gaps)))
        return F.when(F.exists(found, _mixed) if pattern == TOKEN else F.size(found) > 0, parts).otherwise(none)

    needs = kinds[0][-1]
    possible = F.lit(True) if not needs else text.contains("=") | text.contains(":") if needs == "[:=]" else text.contains(needs)
    return F.when(possible, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _mixed(token: Column) -> Column:
    """Both cases and a digit."""
    return token.rlike("[a-z]") & token.rlike("[A-Z]") & token.rlike("[0-9]")


def all_parts(text: Column) -> Column:
    """Strong and weak parts of a text: array of (start, kind, stop, scope, side)."""
    groups: dict[str, list[tuple]] = {}
    for row in PATTERNS:
        groups.setdefault(row[0], []).append(row)
    return F.concat(*[_parts(text, pattern, rows[0][1], rows) for pattern, rows in groups.items()])


def _weak(part: Column) -> Column:
    return part["kind"] >= len(BASE)


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The rows of ``parts (text_id, start, kind, stop, scope, side)`` that are weak and have a complement near.

    An interval join by bins: see the top of the module.  Rows come back once each.
    """
    bin_of = lambda place: F.floor(place / reach).cast("int")
    mark = lambda axis, place: F.struct(F.lit(axis).alias("axis"), place.alias("place"))
    known = parts.filter("side is not null")
    edges = known.select("text_id", "scope", "side", F.explode(F.array(mark("stop", F.col("stop")), mark("start", F.col("start")))).alias("m"))
    bins = edges.groupBy("text_id", "scope", F.col("side").alias("near"), "m.axis", bin_of(F.col("m.place")).alias("bin")).agg(
        F.min("m.place").alias("low"), F.max("m.place").alias("high")
    )
    probe = lambda near, axis, place, step: F.struct(
        F.lit(near).alias("near"), F.lit(axis).alias("axis"), place.alias("place"), (bin_of(place) + step).alias("bin")
    )

    def probes(nears: tuple[int, ...]) -> Column:
        before = [probe(n, "stop", F.col("start"), step) for n in nears for step in (0, -1)]
        return F.array(*before, *[probe(n, "start", F.col("stop"), step) for n in nears for step in (0, 1)])

    wanted = F.when(F.col("side") == SECRET, probes(COMPLEMENTS[SECRET])).otherwise(probes(COMPLEMENTS[IDENTIFIER]))
    asked = known.filter(F.col("kind") >= len(BASE)).select("*", F.explode(wanted).alias("p")).select(
        "text_id", "scope", "start", "kind", "stop", "p.near", "p.axis", "p.place", "p.bin"
    )
    # in its own bin and the next one, a stop at most the reach before a start, or a start as far behind a stop
    near = F.when(F.col("axis") == "stop", (F.col("low") <= F.col("place")) & (F.col("high") >= F.col("place") - reach)).otherwise(
        (F.col("high") >= F.col("place")) & (F.col("low") <= F.col("place") + reach)
    )
    met = asked.join(bins, ["text_id", "scope", "near", "axis", "bin"]).filter(near)
    return met.select("text_id", "start", "kind", "stop").distinct()


def _told(spans: Column) -> Column:
    """Spans as text, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")
    )), ",")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` for every row.

    ``spans`` lists ``kind:start:end`` of strong spans and of weak ones with a complement
    near, by start and then kind, in code points, ends exclusive; the span of an assignment
    runs from its name to its value.  ``base_sha256`` is the digest of the strong ones listed
    likewise.  Spans of different kinds may overlap.  Null and empty texts have no spans,
    repeated rows are judged alike, a null ``doc_id`` stays null, other columns are not
    read; whole texts are scanned.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", "text", all_parts(text).alias("parts"))
    exists = lambda side: F.exists("parts", lambda p: p["side"] == side)
    may_link = F.exists("parts", _weak) & exists(SECRET) & (exists(IDENTIFIER) | exists(ENDPOINT))
    # only texts whose parts may link need a name; equal texts share it, and their links
    kept = keep(
        found.select("doc_id", "parts", F.when(F.coalesce(may_link, F.lit(False)), F.sha2("text", 256)).alias("text_id")), "secret-parts"
    )
    texts = kept.filter("text_id is not null").groupBy("text_id").agg(F.first("parts").alias("parts"))
    links = linked(texts.select("text_id", F.explode("parts").alias("p")).select("text_id", "p.*"), reach)
    spans = "array<struct<start:int,kind:int,stop:int>>"
    links = links.groupBy("text_id").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("more"))
    alone = kept.filter("text_id is null").select("doc_id", "parts", F.lit(None).cast(spans).alias("more"))
    every = alone.union(kept.filter("text_id is not null").join(links, "text_id", "left").select("doc_id", "parts", "more"))
    base = F.transform(F.filter("parts", lambda p: ~_weak(p)), lambda p: F.struct(
        p["start"].alias("start"), p["kind"].alias("kind"), p["stop"].alias("stop")
    ))
    every = every.select("doc_id", base.alias("base"), F.coalesce("more", F.array().cast(spans)).alias("more"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind)))
    counts = [number(kind).cast("long").alias(f"n_{kind}") for kind in BASE]
    return every.select(
        "doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_linked"),
    )


def scan_sql(reach: int = REACH) -> str:
    """The same scan in the SQL of a single-node engine: every pair of parts of a document is compared."""
    quoted = lambda p: p.replace("'", "''")
    found = []
    for pattern, group, kind, side, least, most, _ in PATTERNS:
        mixed = "AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[0-9]')" if pattern == TOKEN else ""
        upper = f"AND length(v[i]) < {most}" if most else ""
        shown = f"CASE WHEN length(m[i]) >= {LONG_HEX} THEN {side} END" if kind == "hex" else f"{side}"
        found.append(f"""
        SELECT r, {KINDS.index(kind)} AS kind, {shown} AS side, start, start + length(m[i]) AS stop,
          (length(array_to_string(g[:i], '#')) - length(replace(array_to_string(g[:i], '#'), chr(10) || chr(10), ''))) // 2 AS scope
        FROM (SELECT *, CAST(list_sum([length(x) FOR x IN g[:i]]) + coalesce(list_sum([length(x) FOR x IN m[:i - 1]]), 0) AS BIGINT) AS start
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT r, regexp_extract_all(t, '{quoted(pattern)}') AS m, regexp_extract_all(t, '{quoted(pattern)}', {group}) AS v,
                    regexp_split_to_array(t, '{quoted(pattern)}') AS g FROM texts)))
        WHERE length(v[i]) >= {least} {upper} {mixed}""")
    near = " OR ".join(f"(a.side = {a} AND b.side = {b})" for a, bs in COMPLEMENTS.items() for b in bs)
    names = "['" + "', '".join(KINDS) + "']"
    told = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    parts AS ({" UNION ALL ".join(found)}),
    links AS (
      SELECT DISTINCT a.r, a.kind, a.start, a.stop FROM parts a JOIN parts b ON a.r = b.r AND a.scope = b.scope AND ({near})
      WHERE a.kind >= {len(BASE)} AND (b.stop BETWEEN a.start - {reach} AND a.start OR b.start BETWEEN a.stop AND a.stop + {reach})
    ), base AS (
      SELECT r, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{n}" for k, n in enumerate(BASE))}, {told} AS listed
      FROM parts WHERE kind < {len(BASE)} GROUP BY r
    ), every AS (
      SELECT r, {told} AS spans, count(*) FILTER (kind >= {len(BASE)}) AS n_linked
      FROM (SELECT r, kind, start, stop FROM parts WHERE kind < {len(BASE)} UNION ALL SELECT r, kind, start, stop FROM links) GROUP BY r
    )
    SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in BASE)}, sha256(coalesce(listed, '')) AS base_sha256,
      coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
    FROM texts LEFT JOIN base USING (r) LEFT JOIN every USING (r)
    """
