"""Merkle manifest of a dataset: a hash tree per group of rows, a tree over the groups, and a proof for every row.

Where a row stands in its group is looked up, not sorted out.  The ids of a group are kept as compressed bitmaps, one per 4096
neighbouring ids: a mask of the 64 words that have bits, those words, and a directory of the bits before each.  Rows of
one (group, 4096 ids) meet their bitmap in a join, count the bits before their own, and add the rows of the bitmaps before
theirs, summed in three steps (131,072 bitmaps, as many of those, the rest), so that no window holds a group.  Ids that
several rows share are in more bitmaps, one per binary digit of their number of rows.

The places are then slots: 729 rows form an array keyed by (group, place / 729), which is folded six levels at once; the
arrays' tops are slots of the next round.  The arrays are written once and carry the leaves, so proofs are made by joining each
array to the path above it and folding in place.  All of it is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainkit.llm.common import cut
from trainkit.operators import split

FAN = 3  # children of a node
LEVELS = 6  # folded in one array
SLOTS = FAN**LEVELS
ID_BITS = 12  # ids of a bitmap: 64 words of 64
WORD_BITS = 6
STEP_BITS = 17  # bitmaps of the first step of offsets, and firsts of the second
NO_ID = -(1 << (63 - ID_BITS)) - 1  # the bitmap of null ids, before all others


def digest(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts, one behind the other, in UTF-8."""
    return F.sha2(F.concat(*texts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields: `-` for null, else the value's UTF-8 bytes counted, `:`, and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _shift(name: str, value: Column, by: Column | int) -> Column:
    return F.call_function(name, value, by if isinstance(by, Column) else F.lit(by))


def _below(bit: Column) -> Column:
    """A mask of the bits below `bit`."""
    return F.bitwise_not(_shift("shiftleft", F.lit(-1).cast("long"), bit))


def _has(word: Column, bit: Column) -> Column:
    return _shift("shiftright", word, bit).bitwiseAND(F.lit(1)) == 1


def _bitmaps(rows: DataFrame) -> DataFrame:
    """(group, chunk, n, slices): the compressed bitmaps of a group's ids with their directories; slice s holds ids whose number of rows has binary digit s."""
    times = rows.groupBy("group", "chunk", "low").agg(F.count("*").alias("n"))
    digits = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: _has(F.col("n"), i)))
    set_ = times.select("group", "chunk", F.explode(digits).alias("slice"), F.shiftright("low", WORD_BITS).cast("int").alias("word"), F.col("low").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    one = F.lit(1).cast("long")
    words = set_.groupBy("group", "chunk", "slice", "word").agg(F.bit_or(_shift("shiftleft", one, F.col("bit"))).alias("bits"))
    sparse = words.groupBy("group", "chunk", "slice").agg(
        F.bit_or(_shift("shiftleft", one, F.col("word"))).alias("occupied"), F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words")
    )
    before = F.transform(F.sequence(F.lit(0), F.size("words")), lambda i: F.aggregate(F.slice("words", F.lit(1), i), F.lit(0), lambda n, w: n + F.bit_count(w)))
    known = sparse.withColumn("before", before).withColumn("size", F.element_at("before", -1).cast("long"))
    return known.groupBy("group", "chunk").agg(F.sum(_shift("shiftleft", F.col("size"), F.col("slice"))).alias("n"), F.collect_list(F.struct("slice", "occupied", "words", "before")).alias("slices"))


def _rank(slices: Column, low: Column) -> Column:
    """Rows of a bitmap with smaller ids."""
    word, bit = F.shiftright(low, WORD_BITS).cast("int"), low.bitwiseAND(F.lit(63)).cast("int")

    def of(s: Column) -> Column:
        at = F.bit_count(s["occupied"].bitwiseAND(_below(word)))
        inside = F.when(_has(s["occupied"], word), F.bit_count(F.get(s["words"], at).bitwiseAND(_below(bit)))).otherwise(0)
        return _shift("shiftleft", (F.get(s["before"], at) + inside).cast("long"), s["slice"])

    return F.aggregate(slices, F.lit(0).cast("long"), lambda n, s: n + of(s))


def _offsets(bitmaps: DataFrame) -> DataFrame:
    """`bitmaps` with the rows of the group's earlier bitmaps (`ahead`) and of the whole group (`total`)."""
    known = bitmaps.withColumn("near", F.shiftright("chunk", STEP_BITS)).withColumn("far", F.shiftright("chunk", 2 * STEP_BITS))

    def ahead(keys: list[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    far = known.groupBy("group", "far").agg(F.sum("n").alias("n")).withColumn("ahead3", ahead(["group"], "far")).withColumn("total", F.sum("n").over(Window.partitionBy("group"))).drop("n")
    near = known.groupBy("group", "far", "near").agg(F.sum("n").alias("n")).withColumn("ahead2", ahead(["group", "far"], "near")).drop("n")
    first = known.withColumn("ahead1", ahead(["group", "near"], "chunk"))
    joined = first.join(near.join(far, ["group", "far"]).drop("far"), ["group", "near"])
    return joined.select("group", "chunk", "slices", (F.col("ahead1") + F.col("ahead2") + F.col("ahead3")).alias("ahead"), "total")


def _among_equal(rows: DataFrame) -> DataFrame:
    """(row_key, later): the place of each row among those that share its group and id, by leaf; equal leaves are alike.

    Numbers count rows of one input partition with one leaf; leaves count up within 4096 beginnings, then those add up.
    """
    keys = ["group", "chunk", "low"]
    parted = rows.withColumn("part", F.shiftright("row_key", 33)).withColumn("start", F.substring("leaf", 1, 3))
    inside = parted.withColumn("inner", F.row_number().over(Window.partitionBy(*keys, "leaf", "part").orderBy("row_key")) - 1)
    counts = parted.groupBy(*keys, "start", "leaf", "part").agg(F.count("*").alias("n"))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    near = counts.withColumn("ahead", F.coalesce(F.sum("n").over(upto(*keys, "start").orderBy("leaf", "part")), F.lit(0)))
    far = counts.groupBy(*keys, "start").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto(*keys).orderBy("start")), F.lit(0))).drop("n")
    offsets = near.join(far, [*keys, "start"]).select(*keys, "leaf", "part", (F.col("ahead") + F.col("before")).alias("offset"))
    return inside.join(offsets, [*keys, "leaf", "part"]).select("row_key", (F.col("offset") + F.col("inner")).alias("later"))


def _placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` with their place in the group and the group's total, and the largest total."""
    bitmaps = cut(_bitmaps(rows))
    known = cut(_offsets(bitmaps))
    largest = known.agg(F.max("total")).first()[0] or 0
    met = rows.join(known, ["group", "chunk"]).withColumn("place", F.col("ahead") + _rank(F.col("slices"), F.col("low"))).drop("slices", "ahead")
    if bitmaps.where(F.exists("slices", lambda s: s["slice"] > 0)).isEmpty():
        return met, largest
    several = rows.groupBy("group", "chunk", "low").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    later = _among_equal(rows.join(several, ["group", "chunk", "low"], "left_semi"))
    return met.join(later, "row_key", "left").withColumn("place", F.col("place") + F.coalesce("later", F.lit(0))).drop("later"), largest


def _above(level: Column) -> Column:
    """The nodes over a level: one for each run of FAN, the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * FAN + 1, F.lit(FAN)), "")))


def _arrays(nodes: DataFrame) -> DataFrame:
    """(group, block, total, slots, n0 .. n6, top) from nodes (group, place, total, digest, *carried): SLOTS neighbours and the levels above them.

    A level is there as long as the one below it has several nodes in the whole group; runs at the end are shorter.
    """
    carried = [c for c in nodes.columns if c not in ("group", "place", "total")]
    slotted = nodes.select("group", "total", F.floor(F.col("place") / SLOTS).alias("block"), F.struct((F.col("place") % SLOTS).cast("int").alias("slot"), *carried).alias("s"))
    arrays = slotted.groupBy("group", "block").agg(F.first("total").alias("total"), F.sort_array(F.collect_list("s")).alias("slots"))
    arrays = arrays.withColumn("n0", F.transform("slots", lambda s: s["digest"]))
    for k in range(LEVELS):
        arrays = arrays.withColumn(f"n{k + 1}", F.when(F.col("total") > FAN**k, _above(F.col(f"n{k}"))))
    return arrays.withColumn("top", F.coalesce(*[F.get(f"n{k}", F.lit(0)) for k in reversed(range(LEVELS + 1))]))


def _tree(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The rounds of arrays, the last with one array a group."""
    rounds = []
    while True:
        rounds.append(cut(_arrays(nodes)))
        if largest <= SLOTS:
            return rounds
        largest = -(-largest // SLOTS)
        nodes = rounds[-1].select("group", F.col("block").alias("place"), F.ceil(F.col("total") / SLOTS).alias("total"), F.col("top").alias("digest"))


def _steps(slot: Column) -> Column:
    """What stands left and right of a slot's ancestors inside their runs, level by level."""

    def step(k: int) -> Column:
        start = F.floor(slot / FAN ** (k + 1)).cast("int") * FAN
        own = F.floor(slot / FAN**k).cast("int") - start
        left, right = F.slice(f"n{k}", start + 1, own), F.slice(f"n{k}", start + own + 2, FAN - 1 - own)
        return F.when(F.col(f"n{k + 1}").isNotNull(), F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))

    return F.filter(F.array(*[step(k) for k in range(LEVELS)]), lambda p: p.isNotNull())


def _paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(group, slot fields, path, tops of `above`): each slot of the first round with its siblings up to the root; `above` has a row per group."""
    tops = [c for c in above.columns if c not in ("group", "path")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for arrays in reversed(rounds):
        joined = arrays.join(above.withColumnRenamed("path", "rest"), ["group", "block"])
        slots = F.transform("slots", lambda s: F.struct(s.alias("s"), _steps(s["slot"]).alias("steps")))
        rows = joined.select("group", "block", "rest", *tops, F.explode(slots).alias("x"))
        rows = rows.select("group", (F.col("block") * SLOTS + F.col("x.s.slot")).alias("block"), F.concat("x.steps", "rest").alias("path"), F.col("x.s").alias("s"), *tops)
        above = rows.drop("s")
    return rows.select("group", "s.*", "path", *tops)


def folded(path: Column, start: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, start, lambda own, p: digest(p["left"], own, p["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def manifest(docs: DataFrame, fields: Sequence[Column], id_col: str = "doc_id", group_col: str = "source", claimed: Column | None = None) -> DataFrame:
    """(id, source, leaf, claimed, path, subroot, root) of every row.

    Leaves ascend by id in their group; groups ascend bytewise, null first.  `path` lists the siblings up to the root as
    (left, right) of each level.  `claimed` is carried along: a leaf digest that somebody else has of the row, or null.

    Null ids come first in their group.  Rows that share an id follow each other by leaf, equal rows too, each as a leaf of its
    own.  Null fields are `-`, so empty texts differ from null ones.  An empty table gives no rows.  Other columns are left out, whatever
    their names; ids are whole numbers.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    number = F.col("id")
    taken = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("group"), leaf(fields).alias("digest"), (claimed if claimed is not None else F.lit(None)).cast("string").alias("claimed"), F.monotonically_increasing_id().alias("row_key"))
    rows = cut(taken)
    rows = rows.withColumn("chunk", F.coalesce(F.shiftright(number, ID_BITS), F.lit(NO_ID))).withColumn("low", F.coalesce(number.bitwiseAND(F.lit((1 << ID_BITS) - 1)), F.lit(0)))
    placed, largest = _placed(rows.withColumn("leaf", F.col("digest")))
    leaves = _tree(placed.select("group", "place", "total", "digest", "id", "claimed"), largest)

    subroots = leaves[-1].select("group", F.col("top").alias("digest"))
    n = subroots.count()
    ranked = split.numbered(subroots, [], [F.col("group")], split.order_bucket(subroots, ["group"], split.buckets_for(n), n), "number")
    nodes = ranked.select(F.lit("").alias("group"), (F.col("number") - 1).alias("place"), F.lit(n).cast("long").alias("total"), "digest", F.col("group").alias("of"))
    groups = _tree(nodes, n)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    tops = _paths(groups, groups[-1].select("group", nothing.alias("path"), F.col("top").alias("root")))
    above = tops.select(F.col("of").alias("group"), "path", F.col("digest").alias("subroot"), "root")
    source = F.when(F.col("group") != "", F.expr("substring(group, 2)"))
    return _paths(leaves, above).select("id", source.alias("source"), F.col("digest").alias("leaf"), "claimed", "path", "subroot", "root")
