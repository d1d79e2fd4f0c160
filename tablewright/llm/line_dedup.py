"""Line deduplication by an exact set-similarity join, with DataFrame and SQL functions only.

A line is the set of its words.  Words are ordered by rarity (how often words of
their hash bucket occur, rarest first); lines with equal sets become one, and the
others meet on the words of their prefixes.  A pair is looked at only if its
sizes, the positions of the shared word, and the parity bits of the two sets allow the similarity; then
the sets themselves decide.  A line goes if an earlier line is so similar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import materialise, settle

#: Lines with fewer distinct words match only lines of an equal set, so they are grouped and not joined.
LEAST_WORDS = 8
PERCENT = 90
#: Index lists of more lines first meet their earliest one, which settles most of them.
LONG_LIST = 64
#: So many rows of numbers and hashes (some 40 MB) are broadcast after a count, more are joined by a shuffle.
FEW_LINES = 1_000_000
#: Hash buckets that word frequencies are counted in.
BUCKETS = 1 << 16


def _spaced(column: Column) -> Column:
    """``column`` with a space for all other ASCII white space inside a line."""
    spaced = column
    for other in "\t\v\f\r":
        spaced = F.replace(spaced, F.lit(other), F.lit(" "))
    # most lines have none; to see that, one pass of a pattern costs less than four replacements
    return F.when(column.rlike("[\t\u000b\f\r]"), spaced).otherwise(column)


def _lines(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``doc, line, mark, value``: number (from 0), hash and text of each line of documents with an id."""
    return (
        docs.filter(F.col(id_column).isNotNull())
        .select(F.col(id_column).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "value"))
        .filter(F.octet_length("value") > 0)
        .select("doc", "line", F.xxhash64("value").alias("mark"), "value")
    )


def _with_spaces(lines: DataFrame) -> DataFrame:
    """``lines`` with words that only spaces part; their hashes stay those of the texts."""
    return lines.withColumn("value", _spaced(F.col("value")))


def _rarity(docs: DataFrame, text: str) -> str:
    """A table of fixed size, as SQL: for every bucket the binary logarithm of how often its words occur."""
    # two splits at one character cost less than one at a pattern
    lines = docs.select(F.explode(F.split(text, "\n")).alias("value"))
    words = lines.select(F.explode(F.split(_spaced(F.col("value")), " ")).alias("word")).filter("word <> ''")
    counted = words.groupBy(F.xxhash64("word").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    table = ["0"] * BUCKETS
    for bucket, n in counted.collect():  # at most BUCKETS rows
        table[bucket] = str(min(n.bit_length(), 31))
    return f"cast(split('{','.join(table)}', ',') as array<bigint>)"  # folded into one constant


def _keyed(lines: DataFrame, rarity: str) -> DataFrame:
    """``lines`` with ``keys`` for ``value``: distinct words as longs, rarest first: the logarithm above, 58 bits of hash below.

    No filter on what is computed here: Catalyst would move it down and compute the words twice.
    """
    # each word is hashed once; what stands outside the lambdas is compiled for arrays of longs
    words = F.array_remove(F.transform(F.split("value", " "), lambda x: F.xxhash64(x)), F.xxhash64(F.lit("")))
    key = f"shiftleft(get({rarity}, cast(h & {BUCKETS - 1} as int)), 58) | shiftrightunsigned(h, 6)"
    lines = lines.withColumn("words", words)
    keys = f"sort_array(array_distinct(transform(words, h -> {key})))"
    return lines.withColumn("keys", F.expr(keys)).drop("value", "words")


#: 64 parity bits of a set.  Two sets differ in at least as many words as their bits differ.
PARITY = "aggregate(keys, 0L, (bits, x) -> bits ^ shiftleft(1L, cast(x & 63 as int)))"


#: Words that the smaller of two lines needs in its prefix: they share at least this part of twice its size.
SHORT = f"slice(prefix, 1, n - cast(ceil({2 * PERCENT} * n / {100 + PERCENT}) as int) + 1)"


def _postings(one: DataFrame, prefix: str = "prefix") -> DataFrame:
    """One row for each prefix word of each distinct line, with the size class: similar lines are in the same or a neighbouring one."""
    kept = [c for c in ("done",) if c in one.columns]
    return one.select("id", "n", "bits", *kept, F.expr(_size_class("n")).alias("class"), F.posexplode(F.expr(prefix)).alias("pos", "word"))


def _size_class(n: str) -> str:
    """Sizes up to the square of the allowed quotient apart share a class."""
    return f"cast(floor(ln({n}) / {2 * math.log(100 / PERCENT)!r}) as int)"


def _listed(postings: DataFrame, size_class: str) -> DataFrame:
    """``list`` stands for a word and a size class; two that hash alike only cost comparisons."""
    return postings.withColumn("list", F.expr(f"xxhash64(word, {size_class})")).drop("word")


def _can_match() -> str:
    """Length, position and parity filters on two postings x and y of one list."""
    need = f"ceil({PERCENT} * (x.n + y.n) / {100 + PERCENT})"
    return (
        f"x.n * 100 >= y.n * {PERCENT} AND y.n * 100 >= x.n * {PERCENT} "
        f"AND least(x.n - x.pos, y.n - y.pos) >= {need} AND x.n + y.n - bit_count(x.bits ^ y.bits) >= 2 * {need}"
    )


def _narrowed(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lines`` at the places ``wanted`` (doc, line, mark).  They are broadcast if few, else both sides are shuffled."""
    return lines.join(_few(wanted), ["doc", "line", "mark"], "left_semi")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW_LINES else rows


def _verified(pairs: DataFrame, one: DataFrame, lines: DataFrame, rarity: str) -> DataFrame:
    """``id`` of the later line (ids follow the order of lines) of each pair (u, v) that is similar enough, by the sets themselves."""
    pairs = materialise(pairs.selectExpr("least(u, v) AS u", "greatest(u, v) AS v").distinct(), "line-pairs")
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    places = materialise(one.select("id", "at").join(_few(ids), "id", "left_semi"), "line-places")
    keyed = _keyed(_with_spaces(_narrowed(lines, places.select("at.*"))), rarity).dropDuplicates(["doc", "line", "mark"])
    sets = places.join(keyed.select(F.struct("doc", "line", "mark").alias("at"), "keys"), "at")
    sets = materialise(sets.select("id", "keys"), "line-sets")
    both = (
        pairs.join(sets.selectExpr("id AS u", "keys AS x"), "u")
        .join(sets.selectExpr("id AS v", "keys AS y"), "v")
        .withColumn("shared", F.size(F.array_intersect("x", "y")))
        .filter(f"100 * shared >= {PERCENT} * (size(x) + size(y) - shared)")
    )
    return materialise(both.select(F.col("v").alias("id")).distinct(), "matched-lines")


def later_matches(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, line, mark`` of every line that an earlier one matches with a Jaccard similarity of ``PERCENT`` or more.

    Earlier means a smaller document id, then a smaller line number.  Rows that repeat an id with
    the same line at the same place hold that line once.  Lines of documents without an id neither go nor make others go.
    """
    rarity, lines = _rarity(docs, text), _lines(docs, id_column, text)
    shaped = materialise(
        _keyed(_with_spaces(lines), rarity).select(
            F.struct("doc", "line", "mark").alias("at"), F.size("keys").alias("n"),
            F.struct(F.xxhash64("keys").alias("a"), F.xxhash64("keys", F.lit(1)).alias("b")).alias("set"), F.expr(PARITY).alias("bits"),
            F.expr(f"slice(keys, 1, size(keys) - cast(ceil(size(keys) * {PERCENT} / 100) as int) + 1)").alias("prefix"),
        ),
        "lines",
    ).filter(F.col("n") >= 1)
    one = shaped.filter(F.col("n") >= LEAST_WORDS).groupBy("set").agg(F.min("at").alias("at"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("n", "bits", "prefix")])
    placed = one.repartitionByRange("at").sortWithinPartitions("at")
    one = materialise(placed.withColumn("id", F.monotonically_increasing_id()), "distinct-lines")  # numbered in order, once, when written
    postings = _listed(_postings(one, SHORT), "class")
    # lists that are long, as those of many variants of one line are, first meet their earliest line alone
    long_lists = postings.groupBy("list").agg(F.count("*").alias("lines")).filter(F.col("lines") > LONG_LIST).select("list")
    long_lists = materialise(postings.join(long_lists, "list"), "long-lists")
    first = long_lists.groupBy("list").agg(F.min_by(F.struct("id", "n", "bits", "pos"), "id").alias("y")).select("list", "y.*")
    near = long_lists.alias("x").join(first.alias("y"), "list").filter(_can_match() + " AND x.id <> y.id")
    easy = _verified(near.selectExpr("x.id AS u", "y.id AS v"), one, lines, rarity)
    # then every line meets the larger ones in the lists of its words, in its own size class and the next one
    marked = one.join(_few(easy.select("id", F.lit(True).alias("done"))), "id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    marked = marked.select("id", "n", "bits", "prefix", "done")
    both_classes = F.explode(F.expr(f"array_distinct(array(class, {_size_class(f'n * 100 div {PERCENT}')}))")).alias("of")
    smaller = _listed(_postings(marked, SHORT).select("*", both_classes), "of").drop("class", "of")
    larger = _listed(_postings(marked), "class").drop("class")
    pairs = smaller.alias("x").join(larger.alias("y"), "list").filter(
        f"NOT (x.done AND y.done) AND (x.n < y.n OR x.n = y.n AND x.id < y.id) AND {_can_match()}"
    )
    hard = _verified(pairs.selectExpr("x.id AS u", "y.id AS v"), one, lines, rarity)
    gone = easy.union(hard).distinct().withColumn("gone", F.lit(True))
    repeated = one.select("id", "set", "at", "rows").join(_few(gone), "id", "left").filter("gone OR rows > 1")
    repeated = repeated.select("set", F.col("at").alias("first"), "gone")
    short = shaped.filter(F.col("n") < LEAST_WORDS).groupBy("set").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    repeated = repeated.union(short.filter("rows > 1").select("set", "first", F.lit(None).cast("boolean")))
    repeated = materialise(repeated, "repeated-lines")
    return (
        shaped.select("at", "set").join(_few(repeated), "set")
        .filter("gone OR first < at AND struct(first.doc, first.line) <> struct(at.doc, at.line)")
        .select("at.*").distinct()
    )


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later matching lines taken out of the text, plus ``n_lines`` and ``n_removed``.

    Lines are what stands between line feeds; every line that has a word is compared, and words end at any ASCII
    white space.  Lines without a word stay.
    Null texts have no lines and stay null; a text that loses every line becomes empty.
    """
    clash = {"n_lines", "n_removed"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be hidden by the result")
    gone = settle(docs.sparkSession, lambda: later_matches(docs, id_column, text), "later-lines")
    few = gone.count() <= FEW_LINES
    gone = gone.groupBy("doc").agg(F.collect_set(F.struct("line", "mark")).alias("_gone"))
    gone = gone.withColumnRenamed("doc", "_doc")
    joined = docs.join(F.broadcast(gone) if few else gone, F.col(id_column) == F.col("_doc"), "left")
    kept = F.expr("filter(_lines, (x, i) -> NOT array_contains(_gone, struct(i AS line, xxhash64(x) AS mark)))")
    lines = F.split(text, "\n")
    cut = joined.withColumn("_lines", lines).withColumn("_kept", F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(kept))
    left = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join("_kept", "\n"))
    out = [left.alias(c) if c == text else F.col(c) for c in docs.columns]
    counts = [F.coalesce(F.size(c), F.lit(0)).cast("long") for c in ("_lines", "_kept")]
    return cut.select(*out, counts[0].alias("n_lines"), (counts[0] - counts[1]).alias("n_removed"))
