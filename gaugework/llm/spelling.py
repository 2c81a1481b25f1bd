"""Spelling variants by permuterm rotations: words one inserted, deleted or replaced character apart.

A word is closed by a terminator and turned in all ways.  In the rotation that starts
behind a character, that character comes last; two words that differ in it alone share
the rest of the rotation, and the shorter word of an insertion has that rest as a whole
rotation of its own.  So all rotations, whole and without their last character, are
brought together by that prefix; the words of one prefix are neighbours.  A prefix holds
at most one word for each character that may stand last and one whole rotation, however
many words there are, so no group of rotations is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.checksum_sql import crc32_sql, crc_table_sql
from gaugework.llm.staging import keep
from gaugework.operators.groups import unnest

LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST = 6
FEWEST = 5
#: A form is so many times as frequent as its variant.
RATIO = 5
#: One in so many (document, run) pairs loses a character.
NOISE = 199
#: Closes a word; no word may hold it.
END = "\u0001"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(run: Column) -> Column:
    """A-Z to a-z and nothing else; whole words in plain letters take the fast way."""
    low = F.lower(run)
    plain = F.octet_length(run) == F.length(run)
    return F.when((low == run) | plain, low).otherwise(F.translate(run, _UPPER, _LOWER))


def counted_words(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, noise: int = NOISE) -> DataFrame:
    """``word, n`` of all words with ``shortest`` characters and ``fewest`` occurrences or more.

    Words are lower-cased runs of letters of whole texts.  Where ``noise`` divides the
    crc32 of ``doc_id:run``, the run loses the character that the crc32 points to, before
    lengths are judged.  A null id counts as an empty one, a null text has no words;
    repeated rows count each; other columns are not read.
    """
    # shorter runs cannot become words, so they are not even cut out
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    runs = unnest(docs, found, "run", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    runs = runs.select("id", _lower(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= fewest) & (F.length("word") >= shortest))


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, word, n, role``: every rotation of every word, whole (0) and without its last character.

    Dropping any of several equal characters in a row makes the same word, so of these
    only the last one stands for a deletion (2); all stand for a replacement (1).
    """
    length = F.length("word")
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("i"))
    behind = F.substring("word", F.col("i") + 1, length)
    whole = F.struct(F.concat(behind, F.lit(END), F.substring("word", F.lit(1), F.col("i"))).alias("prefix"), F.lit(0).alias("role"))
    edited, after = F.substring("word", F.col("i"), F.lit(1)), F.substring("word", F.col("i") + 1, F.lit(1))
    cut = F.struct(
        F.concat(behind, F.lit(END), F.substring("word", F.lit(1), F.col("i") - 1)).alias("prefix"),
        F.when(edited == after, 1).otherwise(2).alias("role"),
    )
    both = F.when(F.col("i") == 0, F.array(whole)).otherwise(F.array(whole, cut))
    return turned.select("word", "n", F.explode(both).alias("r")).select("r.prefix", "word", "n", "r.role")


def nearest(words: DataFrame) -> DataFrame:
    """``word, n_near, best`` of the words with near words, from distinct ``word, n``.

    ``n_near`` counts the near words; ``best`` (order = -n, word) is the most frequent of
    them, of equals the first in code-point order.  Each group gives one row for each of
    its words, not one for each pair: the best of the others is the first of the sorted
    group, or the second for that first itself.
    """
    named = F.struct((-F.col("n")).alias("order"), F.col("word"), F.col("role"))
    groups = rotations(words).groupBy("prefix").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") > 0, named))).alias("cuts"),
        F.min(F.when(F.col("role") == 0, named)).alias("whole"),
    )
    groups = groups.filter((F.size("cuts") > 1) | ((F.size("cuts") > 0) & F.col("whole").isNotNull()))
    whole = F.col("whole")
    bare = lambda x: F.when(x.isNotNull(), F.struct(x["order"].alias("order"), x["word"].alias("word")))

    def cut_row(x: Column, i: Column) -> Column:
        other = F.get(F.col("cuts"), F.when(i == 0, 1).otherwise(0))
        shorter = F.when(x["role"] == 2, whole)
        return F.struct(
            x["word"].alias("word"),
            (F.size("cuts") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).cast("long").alias("n_near"),
            F.least(bare(other), bare(shorter)).alias("best"),
        )

    groups = groups.withColumn("longer", F.filter("cuts", lambda x: x["role"] == 2))
    whole_row = F.struct(whole["word"].alias("word"), F.size("longer").cast("long").alias("n_near"), bare(F.get("longer", F.lit(0))).alias("best"))
    rows = F.concat(F.transform("cuts", cut_row), F.when(whole.isNotNull(), F.array(whole_row)).otherwise(F.array()))
    found = groups.select(F.explode(rows).alias("r")).select("r.*").filter("n_near > 0")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` of every word in ``links (word, form)``, following forms to the last.

    Pointers double each round, so rounds grow with the logarithm of the longest chain;
    forms never run in a circle, as each is more frequent than its variant.
    """
    found = keep(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        above = found.select(F.col("word").alias("root"), F.col("root").alias("above"))
        found = keep(
            found.join(above, "root", "left").select(
                "word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        if not found.filter("moved").limit(1).count():
            return found.drop("moved")
        found = found.drop("moved")


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` from distinct ``word, n`` (each read several times).

    A word's form is its most frequent near word, if that is ``ratio`` times as frequent;
    its root is where forms lead, or itself.  Null words and counts are left out, an empty
    word is near to single characters, words that hold ``END`` are refused.
    """
    words = words.select("word", F.col("n").cast("long").alias("n")).dropna()
    words = words.withColumn("word", F.when(F.col("word").contains(END), F.raise_error(F.lit("a word holds the terminator"))).otherwise(F.col("word")))
    joined = words.join(nearest(words), "word", "left")
    most = -F.col("best.order")
    likely = most >= ratio * F.col("n")
    named = keep(
        joined.select(
            "word", F.when(likely, F.col("best.word")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, most).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(named.filter("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, noise: int = NOISE, ratio: int = RATIO) -> DataFrame:
    """The spelling groups of the words of ``docs``; see :func:`counted_words` and :func:`group`."""
    return group(keep(counted_words(docs, shortest, fewest, noise), "spelling-words"), ratio)


def variants_sql(shortest: int = SHORTEST, fewest: int = FEWEST, noise: int = NOISE, ratio: int = RATIO) -> str:
    """The same groups in the SQL of a single-node engine, by words with one character taken out."""
    return f"""
    WITH RECURSIVE crc(t) AS ({crc_table_sql()}
    ), runs AS (
      SELECT id, run, count(*) AS n FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
          unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{LETTERS}+')) AS run
        FROM documents) GROUP BY ALL
    ), hashed AS (
      SELECT run, n, {crc32_sql("id || ':' || run", "t")} AS h FROM runs, crc
    ), words AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % {noise} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM hashed) WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {fewest}
    ), less AS (
      SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
      FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
    ), near AS (
      SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
    ), best AS (
      SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS most FROM near GROUP BY word
    ), forms AS (
      SELECT word, CASE WHEN most >= {ratio} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near,
        CASE WHEN most >= {ratio} * n THEN most END AS form_n
      FROM words LEFT JOIN best USING (word)
    ), walk AS (
      SELECT word, word AS here, 0 AS step FROM forms
      UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL
    )
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word) USING (word)
    """
