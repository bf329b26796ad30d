"""Merkle manifest of a dataset: one tree per group over rows in the order of their ids, one tree over the groups.

1. Ids become bitmaps: one 64-bit word per group and 64 ids, OR-ed map-side; words without a row are left out, so a
   sparse range of ids costs no more than its rows. Every word keeps how many rows it stands for, and a directory of
   such counts, 1,024 entries to a node and as many levels as the range of ids needs, tells how many rows lie before it.
2. A row's leaf coordinate is a rank query: rows before its word, plus the bits below its own. No order of all rows is
   made. Words that hold a repeated or missing id cannot be ranked by bits alone; their rows are counted by (id, leaf
   digest) in lanes of the digest, and equal rows are counted once and dealt out again in blocks.
3. Coordinates are slots: every 1,024 slots of a group make an array, which is reduced by ten levels in place. Its one
   node is a slot of the next pass, until a group has one node. A block never holds more than 1,024 nodes, whatever the
   share of a group.
4. Paths go down the same blocks: a block hands its own path to its slots, joined on (group, block).

Defined cases: a group of one row is its own subroot; null groups are a group of their own, the first; rows of one id
go by the digest of their leaf, null ids come first; repeated rows are leaves of their own; a null value is ``-``; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspan.llm.stored import store

WORD_BITS = 6     # ids per word of a bitmap: 2**6, the bits of a long
DIRECTORY_BITS = 10
BLOCK_BITS = 10   # slots per array and levels per pass
LANE_DIGITS = 3   # hex digits of the digest that deal out rows of one id
NODE = "struct<side:int,digest:string>"


def row_digest(values: Sequence[Column]) -> Column:
    """Hex SHA-256 of the values, each as its byte length, a colon and its text, or ``-`` if it is null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A string that sorts as the group does bytewise, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _directory(words: DataFrame, low: int, high: int) -> DataFrame:
    """``words`` with ``before``: the rows of the group in lesser words."""
    levels = [words]
    while high - low >= 1 << DIRECTORY_BITS:
        low, high = low >> DIRECTORY_BITS, high >> DIRECTORY_BITS
        levels.append(levels[-1].groupBy("group", F.shiftright("word", DIRECTORY_BITS).alias("word")).agg(
            F.sum("rows").alias("rows")))
    earlier = Window.orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    top = earlier.partitionBy("group")
    done = levels.pop().withColumn("before", F.coalesce(F.sum("rows").over(top), F.lit(0)))
    while levels:
        above = done.select("group", F.col("word").alias("node"), F.col("before").alias("above"))
        here = levels.pop().withColumn("node", F.shiftright("word", DIRECTORY_BITS))
        inside = F.coalesce(F.sum("rows").over(earlier.partitionBy("group", "node")), F.lit(0))
        done = here.withColumn("before", inside).join(above, ["group", "node"]).withColumn(
            "before", F.col("before") + F.col("above")).drop("node", "above")
    return done


def _slots_of_ties(rows: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Slots of rows whose words hold an id more than once, or no id: by id, then digest."""
    same = ["group", "word", "__id", "lane"]
    rows = rows.withColumn("__id", F.coalesce("id", F.lit(0))).withColumn("lane", F.substring("leaf", 1, LANE_DIGITS))
    kinds = rows.groupBy(*same, "before", "id", "leaf", *carried).agg(F.count("*").alias("copies"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    lanes = kinds.groupBy(*same).agg(F.sum("copies").alias("copies")).withColumn("skip", F.coalesce(
        F.sum("copies").over(earlier.partitionBy("group", "word").orderBy("__id", "lane")), F.lit(0))).drop("copies")
    within = earlier.partitionBy(*same).orderBy("leaf", *carried)
    kinds = kinds.withColumn("inside", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(lanes, same)
    kinds = kinds.withColumn("first", F.col("before") + F.col("skip") + F.col("inside"))
    step = 1 << BLOCK_BITS
    pieces = kinds.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(step).cast("long"))))
    pieces = pieces.repartition("group", "first", "at")
    each = F.sequence(F.col("at"), F.least(F.col("at") + step, F.col("copies")) - 1)
    return pieces.withColumn("at", F.explode(each)).withColumn("slot", F.col("first") + F.col("at")).select(
        "group", "slot", "id", "leaf", *carried)


def slots(leaves: DataFrame, carried: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with ``slot``, their rank in the group; group and number of rows) of stored (group, id, leaf)."""
    low, high = leaves.agg(F.min("id"), F.max("id")).first()
    low, high = (0, 0) if low is None else (low >> WORD_BITS, high >> WORD_BITS)
    one = F.expr("shiftleft(1L, cast(id & 63 AS int))")
    lesser = F.expr("~shiftleft(-1L, cast(id & 63 AS int))")
    rows = leaves.withColumn("word", F.coalesce(F.shiftright("id", WORD_BITS), F.lit(low - 1).cast("long")))
    words = store(rows.groupBy("group", "word").agg(
        F.coalesce(F.bit_or(one), F.lit(0).cast("long")).alias("bits"),
        F.count("*").alias("rows")), "id-words")
    sizes = words.groupBy("group").agg(F.sum("rows").alias("size"))
    placed = _directory(words, low - 1, high)
    single = F.col("rows") == F.bit_count("bits")
    by_bits = rows.join(placed.where(single), ["group", "word"]).withColumn(
        "slot", F.col("before") + F.bit_count(F.col("bits").bitwiseAND(lesser)))
    tied = _slots_of_ties(rows.join(placed.where(~single), ["group", "word"]), carried)
    return by_bits.select("group", "slot", "id", "leaf", *carried).union(tied), sizes


def _pairs(nodes: Column) -> Column:
    """The next level: every two nodes, or a last one alone, become their digest."""
    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int")), lambda i: F.sha2(
        F.concat(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))).cast("binary"), 256))


def climb(nodes: DataFrame, sizes: DataFrame) -> list[DataFrame]:
    """The passes from (group, slot, leaf, ...) to one node per group, each a stored table of blocks.

    A block has its ``items`` in order of slots, its ``levels`` of nodes and the ``top`` they end in.
    """
    sizes = sizes.withColumn("height", F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0))
    most = sizes.agg(F.max("height")).first()[0]
    passes: list[DataFrame] = []
    while not passes or len(passes) * BLOCK_BITS < (most or 0):
        done = len(passes) * BLOCK_BITS
        rest = [c for c in nodes.columns if c not in ("group", "slot")]
        blocks = nodes.groupBy("group", F.shiftright("slot", BLOCK_BITS).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("slot", *rest))).alias("items")).join(sizes, "group")
        count = F.greatest(F.lit(0), F.least(F.lit(BLOCK_BITS), F.col("height") - done))
        start = F.array(F.transform("items", lambda x: x["leaf"]))
        grown = F.aggregate(
            F.slice(F.sequence(F.lit(1), F.lit(BLOCK_BITS)), F.lit(1), count), start,
            lambda levels, _: F.concat(levels, F.array(_pairs(F.element_at(levels, -1)))))
        blocks = blocks.withColumn("levels", grown).withColumn("top", F.element_at("levels", -1)[0])
        passes.append(store(blocks.select("group", "block", "items", "levels", "top"), "tree-blocks"))
        nodes = passes[-1].select("group", F.col("block").alias("slot"), F.col("top").alias("leaf"))
    return passes


def _path(levels: Column, place: Column) -> Column:
    """Sibling of the node above ``place`` on every level; side -1 is left, 1 right, 0 none."""
    def sibling(nodes: Column, level: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(2), level)).cast("int")
        odd = own % 2 == 1
        other = F.get(nodes, F.when(odd, own - 1).otherwise(own + 1))
        side = F.when(other.isNull(), 0).when(odd, -1).otherwise(1)
        return F.struct(side.alias("side"), other.alias("digest"))
    return F.transform(F.slice("levels", F.lit(1), F.size(levels) - 1), sibling)


def descend(passes: list[DataFrame], above: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Items of the first pass with ``path`` to the end of ``above``, whose rows are (group, path, *fields)."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for k, blocks in reversed(list(enumerate(passes))):
        items = blocks.join(above, ["group", "block"]).select(
            "group", "levels", F.col("path").alias("further"), *fields, F.posexplode("items").alias("place", "item"))
        items = items.withColumn("path", F.concat(_path(F.col("levels"), F.col("place")), "further"))
        if k:
            above = items.select("group", F.col("item.slot").alias("block"), "path", *fields)
    return items.select("group", "item.*", "path", *fields)


def _group_slots(tops: DataFrame) -> DataFrame:
    """The groups in bytewise order: sorted in ranges, numbered within a range, and shifted by earlier ranges."""
    own = store(tops.orderBy("group").withColumn("__id", F.monotonically_increasing_id()), "subroots")
    own = own.withColumn("part", F.shiftright("__id", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return store(own.join(parts, "part").select(
        F.lit("").alias("group"), (F.col("skip") + F.col("__id").bitwiseAND((1 << 33) - 1)).alias("slot"),
        F.col("top").alias("leaf"), F.col("group").alias("id")), "groups")


def manifest(
    docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "lang",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``leaf``, ``subroot``, ``root``, ``path`` and the carried columns.

    ``columns`` are hashed into the leaf in their order. ``path`` lists (side, digest) of the siblings from leaf to
    root; a level without sibling has side 0. ``carry`` are further columns of ``docs``, by name.
    """
    carry = carry or {}
    leaves = store(docs.select(
        group_key(F.col(group_col)).alias("group"), F.col(id_col).cast("long").alias("id"),
        row_digest([F.col(c) for c in columns]).alias("leaf"), *[c.alias(n) for n, c in carry.items()]), "leaves")
    placed, sizes = slots(leaves, list(carry))
    passes = climb(placed, sizes)
    groups = _group_slots(passes[-1].select("group", "top"))
    roots = climb(groups, groups.groupBy("group").agg(F.count("*").alias("size")))
    start = roots[-1].select("group", F.col("top").alias("root"), F.expr(f"cast(array() AS array<{NODE}>)").alias("path"))
    tops = descend(roots, start, ["root"]).select(
        F.col("id").alias("group"), F.col("leaf").alias("subroot"), "root", "path")
    return descend(passes, tops, ["subroot", "root"]).drop("group", "slot")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(
        F.when(step["side"] == -1, F.concat(step["digest"], node)).when(
            step["side"] == 1, F.concat(node, step["digest"])).otherwise(node).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """Digest of the siblings of a path, from leaf to root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), "").cast("binary"), 256)
