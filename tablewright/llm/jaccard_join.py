"""Exact Jaccard join of word-shingle sets that uses relations between sets.

Equal sets become one.  A set's prefix holds its rarest shingles: two sets that link share one of
them, and a shingle that only one set has needs no index list, so lists hold
repeated shingles alone.  A set's position in a list (how many rarer shingles it has) bounds the sizes it can still link
with through that list; a common passage at the end of long prefixes thus joins nobody.  Sets that share
prefix lists in this way, directly or through others, form a group, and every link lies inside a group.  In a group the sets stand in
order of size, index lists follow that order, and of each list only the positions are
read whose sizes can still link; the rest is skipped as a block.  The overlaps of a set that is close to
one already done are derived from that one's answers by the lists of their
differences alone.  Large groups are cut into blocks by size class; a first round against
hub blocks connects most sets.  Those left over meet only sets that share a prefix list with
their block, and of the lists only those that still hold two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.components import components
from tablewright.llm.text import Numbers, lower_words, raw_texts, slices
from tablewright.session import materialise, settle

WORDS = 5
PERCENT = 75
#: Bytes of text behind one bucket of shingles.
BUCKET_BYTES = 8 << 20
#: Shingles a task gathers before it passes them on.
HELD = 1 << 20
#: Sets, and shingles, of one block; the size of a unit of work.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 19
#: Sets whose answers others of the unit are derived from.
LEADERS = 16

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _FACTOR
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after the other, and how many each has.

    Fewer than ``WORDS`` words make one shingle; no words, none.
    """
    number, parts = Numbers(), []
    for raw in texts:
        parts.append(number.of(lower_words(raw)))
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    sizes = np.array([len(p) for p in parts], np.int64)
    h = words[np.concatenate([*parts, np.zeros(0, np.int64)])]
    owner = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    shingle = np.full(len(h), WORDS, np.uint64)
    for k in range(WORDS):
        ahead = np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])
        inside = place + k < sizes[owner]
        shingle = np.where(inside, _mix(shingle * _FACTOR + ahead), shingle)
    starts = (place + WORDS <= sizes[owner]) | ((place == 0) & (sizes[owner] < WORDS))
    owner, shingle = owner[starts], shingle[starts]
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], np.bincount(owner[new], minlength=len(parts)).astype(np.int64)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n + (-n * PERCENT) // 100 + 1, 0)


_SHINGLES = "row bigint, n bigint, sent bigint, sig binary, bucket int, hashes binary, owners binary"


def _index_rows(docs: DataFrame, id_column: str, text: str, buckets: int) -> DataFrame:
    """Two kinds of rows: each document's (``row``, id, n, sent, sig); and, per bucket, packed shingles with their documents.

    Shingles are ordered lower half of the hash range first, by frequency, then the upper
    half by hash.  The lower half is sent, and as much of the upper as the prefix needs beyond it.
    Hashes travel cut to 48 bits: two that fall together only cost a comparison.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in _SHINGLES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held = TaskContext.get().partitionId() << 40, 0
        first, hashes, owners = row, [], []

        def packed(kind_of_id: pa.DataType) -> pa.RecordBatch:
            h, o = np.concatenate(hashes), np.concatenate(owners)
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(cuts))
            h, o = h[order], o[order]
            short = np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            n = len(used)
            return pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, kind_of_id), pa.array([first] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.binary()), pa.array(used, pa.int32()),
                    pa.array([short[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()),
                    pa.array([o[cuts[b] : cuts[b + 1]].astype("<u2").tobytes() for b in used], pa.binary()),
                ],
                names,
            )

        for batch in slices(batches):
            sets, sizes = shingle_sets(raw_texts(batch.column(1)))
            wanted, sent, sigs = prefix_length(sizes), [], []
            for at, n, p in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), wanted.tolist()):
                own = sets[at : at + n]
                lower = int(np.searchsorted(own, np.uint64(1 << 63)))
                take = max(lower, p)
                hashes.append(own[:take])
                owners.append(np.full(take, row + len(sent) - first))
                sent.append(take)
                sigs.append(xxhash.xxh3_128_digest(own.tobytes()))
                held += take
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + n)), pa.array(sizes), pa.array(sent, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names
            )
            row += n
            if held > HELD or row - first > 60_000:
                yield packed(batch.column(0).type)
                first, hashes, owners, held = row, [], [], 0
        if hashes:
            yield packed(batch.column(0).type)

    return docs.select(id_column, text).mapInArrow(run, f"id {kind}, {_SHINGLES}")


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: the shingles that more than one document has, with their documents."""
    hashes, rows = [], []
    for first, h, o in zip(*(table.column(c).to_pylist() for c in ("row", "hashes", "owners"))):
        wide = np.zeros((len(h) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
        hashes.append(wide.view("<u8").reshape(-1))
        rows.append(np.frombuffer(o, "<u2").astype(np.int64) + first)
    h, rows = np.concatenate(hashes), np.concatenate(rows)
    order = np.argsort(h, kind="stable")
    h, rows = h[order], rows[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    df = np.repeat(np.diff(edge), np.diff(edge))
    some = df > 1
    return pa.table({"row": pa.array(rows[some]), "h": pa.array(h[some].astype(np.int64)), "df": pa.array(df[some].astype(np.int64))})


class Group:
    """Sets in order of size, with index lists in that order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        hashes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        kinds, ids = np.unique(hashes, return_inverse=True)
        often = np.bincount(ids, minlength=len(kinds)) > 1  # a shingle of one set meets nobody
        number = np.cumsum(often) - 1
        mine = often[ids]
        ids, owner = number[ids[mine]], owner[mine]
        starts = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.sets = [np.sort(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])]
        order = np.lexsort((owner, ids))
        self.lists, ids = owner[order], ids[order]
        self.starts = np.searchsorted(ids, np.arange(int(often.sum()) + 1))
        self.leaders: dict[int, np.ndarray] = {}

    def _count(self, shingles: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of ``shingles`` each set from ``low`` to ``high`` has; other positions of the lists are skipped."""
        n = len(self.sizes)
        parts = [self.lists[self.starts[s] : self.starts[s + 1]] for s in shingles]
        if (low, high) != (0, n):
            parts = [p[np.searchsorted(p, low) : np.searchsorted(p, high)] for p in parts]
        return np.bincount(np.concatenate([*parts, np.zeros(0, np.int64)]), minlength=n)

    def overlaps(self, x: int) -> np.ndarray:
        """Overlap of set ``x`` with every set whose size can link to it (others: not to be read)."""
        low = int(np.searchsorted(self.sizes * 100, self.sizes[x] * PERCENT))
        high = int(np.searchsorted(self.sizes * PERCENT, self.sizes[x] * 100, side="right"))
        own = self.sets[x]
        best = max(self.leaders, key=lambda r: self.leaders[r][x], default=None)
        if best is not None:
            leader = self.sets[best]
            gone, new = np.setdiff1d(leader, own, True), np.setdiff1d(own, leader, True)
            if 2 * (len(gone) + len(new)) < len(own):
                return self.leaders[best] - self._count(gone, low, high) + self._count(new, low, high)
        if len(self.leaders) >= LEADERS:
            return self._count(own, low, high)
        self.leaders[x] = self._count(own, 0, len(self.sizes))  # a leader's answers serve sets of other sizes too
        return self.leaders[x]

    def links(self, x: int) -> np.ndarray:
        sizes = self.sizes
        near = (sizes * 100 >= sizes[x] * PERCENT) & (sizes * PERCENT <= sizes[x] * 100)
        both = np.where(near, self.overlaps(x), 0)
        return np.flatnonzero(near & (both > 0) & (100 * both >= PERCENT * (sizes + sizes[x] - both)))


def spanning_links(rows: list[int], labels: list[int], asked: list[bool], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what ``labels`` does not join yet: no more than there are sets, whatever the number of links."""
    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    group = Group([sets[i] for i in order])
    parent = {labels[i]: labels[i] for i in order}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, i in enumerate(order):
        if asked[i]:
            for y in group.links(x).tolist():
                a, b = top(labels[i]), top(labels[order[y]])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((rows[i], rows[order[y]]))
    return out


def _unit_links(table: pa.Table) -> pa.Table:
    """Links of one unit of work: whole small groups, or two blocks of a large one."""
    columns = [table.column(c).to_pylist() for c in ("grp", "row", "label", "asked", "hashes")]
    by_group: dict[int, list[int]] = {}
    for i, g in enumerate(columns[0]):
        by_group.setdefault(g, []).append(i)
    found = []
    for members in by_group.values():
        row, label, asked, raw = ([c[i] for i in members] for c in columns[1:])
        found += spanning_links(row, label, asked, [np.frombuffer(x, np.uint64) for x in raw])
    return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})


def _links(units: DataFrame) -> DataFrame:
    return materialise(units.groupBy("unit").applyInArrow(_unit_links, "u bigint, v bigint"), "links")


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column, n_shingles, component_id``, one row per row of ``docs``.

    ``component_id``: the smallest id that links lead to, the row's own included.  Null and wordless texts have no shingles and
    link with nothing.  Rows that repeat an id are documents of their own; null ids are
    larger than any other (a component of null ids alone has a null id).
    """
    return settle(docs.sparkSession, lambda: _components_of_documents(docs, id_column, text), "jaccard-components")


def _components_of_documents(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    index = materialise(_index_rows(docs, id_column, text, buckets), "shingles")
    every = index.filter("bucket IS NULL").select("id", "row", "n", "sent", "sig")
    equal = materialise(every.filter("n > 0").groupBy("sig").agg(F.min("row").alias("row")), "equal-sets")
    one = every.join(equal, ["sig", "row"]).select("id", "row", "n", "sent", "sig")  # a row for each distinct set
    prefix = materialise(_prefixes(index, one), "prefixes")
    groups = settle(spark, lambda: _groups(prefix), "group-labels")
    links = settle(spark, lambda: _verified(docs, one, groups, prefix, id_column, text), "all-links")
    joined = settle(spark, lambda: components(links), "link-labels")
    named = (
        every.join(equal.withColumnRenamed("row", "node"), "sig", "left")
        .join(joined, "node", "left")
        .select("id", "n", F.coalesce("label", "node").alias("component"))
    )
    named = materialise(named, "components")
    # written first, so that the join below reads plain shuffles, which Spark splits where a component is large
    smallest = materialise(named.filter("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least")), "least-ids")
    return named.join(smallest, "component", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")
    )


def _prefixes(index: DataFrame, one: DataFrame) -> DataFrame:
    """``h, row, n, reach, strong``: the prefix of each set, without the shingles that no other set has.

    If ``h`` is the first shingle that the set shares with another one, their overlap is at most the ``n - place + 1``
    shingles from there on, so the other one has at most ``reach`` shingles.  The smaller set of a
    link has to reach its own size at least: it is ``strong`` in that list.
    """
    lists = (
        index.filter("bucket IS NOT NULL").groupBy("bucket")
        .applyInArrow(_repeated, "row bigint, h bigint, df bigint")
        .join(one.select("row", "n", "sent"), "row")
    )
    # the sets' own single shingles are the rarest, so they fill the prefix first
    order = Window.partitionBy("row").orderBy(F.expr("h >= 1L << 47"), F.expr("IF(h >= 1L << 47, 0, df)"), "h")
    alone = F.col("sent") - F.count("*").over(Window.partitionBy("row"))
    return (
        lists.withColumn("place", F.row_number().over(order)).withColumn("alone", alone)
        .withColumn("wanted", F.expr(f"n - CAST(ceil(n * {PERCENT} / 100) AS BIGINT) + 1"))
        .filter("place <= wanted - alone")
        # where the upper half was sent too, its single shingles may stand behind: the least place is taken
        .withColumn("before", F.expr("place - 1 + IF(sent > wanted, alone, 0)"))
        .withColumn("reach", F.expr(f"(n - before) * {100 + PERCENT} div {PERCENT} - n"))
        .selectExpr("h", "row", "n", "reach", "reach >= n AS strong")
    )


def _groups(prefix: DataFrame) -> DataFrame:
    """``node, label`` of the groups: sets that share prefix lists with a strong set in reach, directly or through others."""
    first = (
        prefix.groupBy("h").agg(
            F.expr("min(row) FILTER (WHERE strong)").alias("first"), F.count("*").alias("rows"),
            F.expr("min(n) FILTER (WHERE strong)").alias("least"), F.expr("max(reach) FILTER (WHERE strong)").alias("most"),
        )
        .filter("rows > 1 AND first IS NOT NULL")
    )
    open_ = prefix.join(first, "h").filter("strong OR least <= reach AND n <= most")
    return components(open_.selectExpr("row AS u", "first AS v"))


def _sets(docs: DataFrame, members: DataFrame, id_column: str, text: str) -> DataFrame:
    """``row, grp, label, hashes`` of the sets in ``members`` (id, sig, row, grp), from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, sizes = shingle_sets(raw_texts(batch.column(0)))
            parts = np.split(sets, np.cumsum(sizes)[:-1]) if len(sizes) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(p.tobytes()) for p in parts], pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["sig", "hashes"],
            )

    ids = members.select(F.col("id").alias("_id")).distinct()
    chosen = docs.join(ids, F.col(id_column).eqNullSafe(F.col("_id")), "left_semi").select(text)
    again = chosen.mapInArrow(run, "sig binary, hashes binary")
    return again.join(members.select("sig", "row", "grp", "n"), "sig").select("row", "grp", "n", "hashes")


def _verified(docs: DataFrame, one: DataFrame, groups: DataFrame, prefix: DataFrame, id_column: str, text: str) -> DataFrame:
    """Links enough to connect what is connected, every pair of a group that could link having been looked at."""
    members = materialise(
        one.join(groups.selectExpr("node AS row", "label AS grp"), "row").select("id", "sig", "row", "grp", "n"), "members"
    )
    sizes = members.groupBy("grp").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    sizes = materialise(sizes.withColumn("large", F.expr(f"sets > {BLOCK_SETS} OR shingles > {BLOCK_SHINGLES}")), "groups")
    work = sizes.agg(F.sum(F.expr("IF(large, 0, shingles)")), F.count_if("large")).first()
    tasks = max(1, -(-(work[0] or 0) // BLOCK_SHINGLES))
    sets = materialise(_sets(docs, members, id_column, text).join(sizes.select("grp", "large"), "grp"), "sets")
    small = sets.filter("NOT large").select(
        F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("string").alias("unit"), "grp", "row",
        F.col("row").alias("label"), F.lit(True).alias("asked"), "hashes",
    )
    links = _links(small)
    if not work[1]:
        return links
    placed = materialise(_blocks(sets.filter("large")), "blocks")
    hubs = _links(_hub_units(placed))
    label = components(hubs)
    label = placed.select("row", "grp", "class", "block").join(label.withColumnRenamed("node", "row"), "row", "left")
    label = materialise(label.withColumn("label", F.coalesce("label", "row")), "labels")
    return links.union(hubs).union(_links(_rest_units(placed, label, prefix)))


def _blocks(sets: DataFrame) -> DataFrame:
    """Adds ``class`` (sizes a factor of 100 / PERCENT apart; only neighbours can link) and ``block`` inside it."""
    classed = sets.withColumn("class", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int"))
    sizes = classed.groupBy("grp", "class").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    )
    return classed.join(sizes, ["grp", "class"]).withColumn("block", F.expr("pmod(xxhash64(row, 7), blocks)").cast("int")).drop("blocks")


_UNIT = "concat_ws('/', grp, lc, lb, rc, rb) AS unit"


def _hub_units(placed: DataFrame) -> DataFrame:
    """Units of the first block of a class and any block of the same or a neighbouring class; the sets of the first ask."""
    shape = placed.select("grp", "class", "block").distinct()
    hubs = shape.filter("block = 0").selectExpr("grp", "class AS lc", "block AS lb")
    units = materialise(
        hubs.join(shape.selectExpr("grp", "class AS rc", "block AS rb"), "grp").filter("abs(lc - rc) <= 1").selectExpr("*", _UNIT),
        "units",
    )
    own = F.col("row").alias("label")
    ask = placed.join(units.selectExpr("grp", "lc AS class", "lb AS block", "unit"), ["grp", "class", "block"])
    met = placed.join(units.selectExpr("grp", "rc AS class", "rb AS block", "unit"), ["grp", "class", "block"])
    return ask.select("unit", "grp", "row", own, F.lit(True).alias("asked"), "hashes").union(
        met.select("unit", "grp", "row", own, F.lit(False).alias("asked"), "hashes")
    )


def _rest_units(placed: DataFrame, label: DataFrame, prefix: DataFrame) -> DataFrame:
    """Units for the sets outside their group's largest component: a block's askers, and the sets that share a list with one.

    A link that is still missing joins two components, one of them not the largest, and its sets share a
    prefix list; so lists inside one component need no look, and a set meets only the lists it is in.
    """
    main = label.groupBy("grp", "label").agg(F.count("*").alias("sets")).groupBy("grp").agg(F.max_by("label", "sets").alias("main"))
    listed = prefix.join(label.join(main, "grp"), "row")
    live = listed.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("strong").alias("s"))
    listed = materialise(
        listed.join(live.filter("a <> b AND s").select("h"), "h")
        .selectExpr("h", "row", "grp", "class", "block", "strong", "label <> main AS rest"),
        "open-lists",
    )
    left = listed.filter("rest").selectExpr("h", "row", "grp", "class AS lc", "block AS lb", "strong AS ls")
    right = listed.selectExpr("h", "row", "class AS rc", "block AS rb", "strong AS rs")
    near = "abs(lc - rc) <= 1 AND (ls OR rs)"
    # by blocks on one side, so a long list costs its sets times the blocks it touches, not its pairs
    ask = left.join(right.drop("row").distinct(), "h").filter(near).selectExpr(_UNIT, "row", "true AS asked")
    met = left.drop("row").distinct().join(right, "h").filter(near).selectExpr(_UNIT, "row", "false AS asked")
    return (
        ask.union(met).distinct()
        .join(label.select("row", "label"), "row").join(placed.select("row", "grp", "hashes"), "row")
        .select("unit", "grp", "row", "label", "asked", "hashes")
    )
