"""Jaccard self-join of word-shingle sets, complete, with signature trees.

Two texts link when ``100 * |common| >= 75 * |either|`` over their distinct shingles.

1. Equal sets become one class, so copies meet once however many there are. Each class has its size
   and a token bitmap of at least twice as many bits as shingles.
2. Linked sets share a shingle among the first ``n - ceil(0.75 n) + 1`` of each in one order of all
   shingles, so classes meet in the lists of those shingles. The order is by hash, with shingles that
   are frequent in a bounded sample last, which shortens the lists; any order is complete. Lists are
   built in packed buckets and equal ones kept once. Long ones are cut into pieces by size; a piece
   is walked with itself and with the next.
3. Over each list a tree is built: a leaf is a class, a node holds the OR of its bitmaps and the range
   of its sizes. Two trees are walked at once from their roots; a pair of nodes is dropped when the
   largest overlap any of its members can have is too small for the least sizes below it.
4. Pairs that remain at the leaves are compared exactly on the whole sets. In a crowd of near copies
   each class first meets its closest candidates only; components are formed. In lists that were not
   walked in full (crowds, and more than two pieces) the members outside the list's largest component
   then meet each other and that component, as pairs of pieces made by a join. Every candidate pair
   that components have not joined is compared, so no link between components is lost; a crowd never
   meets itself in full, and costs a number of pieces, not its square.

Defined cases: a text of fewer than five words is one shingle of all of them; null text, or text
without words, has an empty set, links with nothing and is its own component; rows with equal sets are
linked; a repeated id is one row each time; a null id is no component's least id unless all are null;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinspan.llm import octets, packed, shingles
from clinspan.llm.components import components
from clinspan.llm.stored import discard, store

PERCENT = 75
SAMPLE_ONE_IN = 64      # texts read for the frequent shingles
MOST_FREQUENT = 20_000  # frequent shingles known to all tasks at most
PIECE = 1024            # members of a list that are walked with as many others
CLOSEST = 8             # candidates a class meets in the first walk
LEAF, FAN = 16, 8


def prefix_length(n: int) -> int:
    return n + (-n * PERCENT // 100) + 1


def bitmap(codes: np.ndarray) -> bytes:
    """Bit ``code mod width`` of each code, for the least power of two of at least twice their number."""
    width = max(64, 1 << (2 * len(codes) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(codes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def class_of(codes: np.ndarray) -> int:
    """A 64-bit name of a set, the same for two sets only by a chance of hashes."""
    return octets.name(codes, len(codes))


def _plain(codes: np.ndarray) -> np.ndarray:
    return codes & np.uint64((1 << 63) - 1)


def _map_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, name, bits = [], [], []
        for codes in shingles.sets(batch["__text"]):
            size.append(len(codes))
            name.append(class_of(codes) if len(codes) else None)
            bits.append(bitmap(codes) if len(codes) else None)
        yield pa.RecordBatch.from_arrays(
            [batch["__id"], batch["__key"], pa.array(size, pa.int64()), pa.array(name, pa.int64()),
             pa.array(bits, pa.binary())], ["__id", "__key", "n_shingles", "class", "bits"])


def _map_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(shingles.sets(batch["__text"]))
        if found:
            codes, times = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[times > 1].astype(np.int64)), pa.array(times[times > 1])], ["code", "times"])


def _map_prefixes(buckets: int, last: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, parts, names, sizes = set(), [], [], []
            for codes in shingles.sets(batch["__text"], last):
                n = len(codes)
                if not n or (name := class_of(_plain(codes))) in done:
                    continue
                done.add(name)
                parts.append(codes[:prefix_length(n)])
                names.append(name)
                sizes.append(n)
            if not parts:
                continue
            count = [len(p) for p in parts]
            bucket, key = packed.bucket_and_key(np.concatenate(parts), buckets)
            yield packed.pack(bucket, {
                "key": key, "class": np.repeat(np.array(names, np.int64), count),
                "size": np.repeat(np.array(sizes, np.uint32), count)})
    return run


def _lists(size_of_piece: int):
    """Lists of one bucket: classes that share a prefix shingle and have another of fitting size there, in pieces by size,
    each piece once alone and once with the next."""
    def run(table: pa.Table) -> pa.Table:
        key, name, size = (packed.unpack(table[n], k) for n, k in (("key", "u4"), ("class", "i8"), ("size", "u4")))
        order = np.lexsort((name, size, key))
        key, name, size = key[order], name[order], size[order].astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, size = key[new], name[new], size[new]
        fits = np.zeros(len(key) + 1, bool)
        fits[1:-1] = (key[1:] == key[:-1]) & (size[:-1] * 100 >= size[1:] * PERCENT)
        keep = fits[1:] | fits[:-1]
        key, name, size = key[keep], name[keep], size[keep]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        ends = np.r_[edge, len(key)]
        seen: set[int] = set()
        rows = []
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):
            whole = octets.name(name[a:z].view(np.uint64), 0)
            if whole in seen:
                continue
            seen.add(whole)
            pieces = -(-(z - a) // size_of_piece)
            for piece in range(pieces):
                low = a + piece * size_of_piece
                middle, high = min(low + size_of_piece, z), min(low + 2 * size_of_piece, z)
                rows.append((whole, piece, pieces, 0, name[low:middle]))
                if middle < high and size[middle - 1] * 100 >= size[middle] * PERCENT:
                    rows.append((whole, piece, pieces, middle - low, name[low:high]))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                        ["of", "piece", "pieces", "cut", "members"])
    return run


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words as bitmaps of ``width`` bits."""
    while bits.shape[1] * 64 > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Tree:
    """Levels of nodes over rows of bitmaps, the rows themselves as level 0."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        extra = sizes - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, sizes, sizes, extra)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(bits), step)
            self.levels.append((
                np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.maximum.reduceat(extra, at)))
            step = FAN

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes of ``level``."""
        fan = LEAF if level == 1 else FAN
        first = nodes * fan
        return first, np.minimum(first + fan, len(self.levels[level - 1][0])) - first


def _possible(one, i, two, j) -> tuple[np.ndarray, np.ndarray]:
    """(largest overlap that members of node pairs can have, whether it is enough for any of them)."""
    common = np.empty(len(i), np.int64)
    words = one[0].shape[1]
    step = max(1, (1 << 20) // words)
    for low in range(0, len(i), step):
        some = slice(low, low + step)
        common[some] = np.bitwise_count(one[0][i[some]] & two[0][j[some]]).sum(1)
    overlap = np.minimum(common + np.minimum(one[3][i], two[3][j]), np.minimum(one[2][i], two[2][j]))
    return overlap, overlap * (100 + PERCENT) >= PERCENT * (one[1][i] + two[1][j])


def walk(a: Tree, b: Tree, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf pairs (row of a, row of b, largest overlap) that may link; each pair once, and no row with itself, if
    the trees are one."""
    at, bt = len(a.levels) - 1, len(b.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        overlap, enough = _possible(a.levels[at], i, b.levels[bt], j)
        i, j, overlap = i[enough], j[enough], overlap[enough]
        if not (at or bt) or not len(i):
            if itself and not at:
                i, j, overlap = i[i < j], j[i < j], overlap[i < j]
            return i, j, overlap
        if at >= bt:
            first, many = a.children(at, i)
            j = np.repeat(j, many)
            i = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            at -= 1
        if bt > at:
            first, many = b.children(bt, j)
            i = np.repeat(i, many)
            j = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            bt -= 1
        if itself:
            keep = i < j if at == 0 else i <= j
            i, j = i[keep], j[keep]


def candidates(bits: list[bytes], sizes: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, estimate of the Jaccard value) of the members that may link.

    ``side`` is all 0 for pairs among the members, else 0 and 1 for pairs across.
    """
    width = np.array([len(x) for x in bits], np.int64) * 8
    found = []
    for w in np.unique(width).tolist():
        for v in (w, 2 * w):  # sets that may link differ by less than two in width
            mine, other = np.flatnonzero(width == w), np.flatnonzero(width == v)
            if not len(other):
                continue
            words = [fold(np.frombuffer(b"".join([bits[k] for k in which]), np.uint64).reshape(len(which), -1), w)
                     for which in (mine, other)]
            across = side.any()
            if not across and v == w:
                tree = Tree(words[0], sizes[mine])
                i, j, overlap = walk(tree, tree, True)
                found.append((mine[i], mine[j], overlap))
                continue
            for s, t in (((0, 1),) if v == w else ((0, 1), (1, 0))) if across else ((None, None),):
                x = mine if s is None else mine[side[mine] == s]
                y = other if t is None else other[side[other] == t]
                if len(x) and len(y):
                    one = words[0] if s is None else words[0][side[mine] == s]
                    two = words[1] if t is None else words[1][side[other] == t]
                    i, j, overlap = walk(Tree(one, sizes[x]), Tree(two, sizes[y]), False)
                    found.append((x[i], y[j], overlap))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float)
    i, j, overlap = (np.concatenate(x) for x in zip(*found))
    return i, j, overlap / (sizes[i] + sizes[j] - overlap)


def _closest(i, j, value, members: int, closest: int) -> np.ndarray:
    """Pairs among the ``closest`` best of either end."""
    keep = np.zeros(len(i), bool)
    for end in (i, j):
        order = np.lexsort((-value, end))
        begin = np.searchsorted(end[order], np.arange(members))
        rank = np.arange(len(order)) - begin[end[order]]
        keep[order[rank < closest]] = True
    return keep


def _walk_lists(second: bool, closest: int):
    """Candidate pairs of many pieces: the closest of each class, or all that components have not joined."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("list", "ascending"), ("n_shingles", "ascending"), ("class", "ascending")])
        table = table.combine_chunks()
        lists, cuts, names, sizes, places = (table[c].to_numpy() for c in ("list", "cut", "class", "n_shingles", "place"))
        roots, wholes = table["root"].to_numpy(), table["of"].to_numpy()
        bits = table["bits"].to_pylist()
        edge = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else np.zeros(0, np.int64)
        ends = np.r_[edge, len(lists)].tolist()
        out = []
        for a, z in zip(ends[:-1], ends[1:]):
            root = roots[a:z]
            if second and (root == root[0]).all():
                continue
            side = ((places[a:z] >= cuts[a]) & (cuts[a] > 0)).astype(np.int64)
            i, j, value = candidates(bits[a:z], sizes[a:z].astype(np.int64), side)
            crowd = 0
            if second:
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
            else:
                keep = _closest(i, j, value, z - a, closest)
                crowd = wholes[a] if not keep.all() else 0
                i, j = i[keep], j[keep]
            if len(i):
                x, y = names[a:z][i], names[a:z][j]
                out.append((np.minimum(x, y), np.maximum(x, y), np.full(len(i), crowd)))
        if not out:
            out = [(np.zeros(0, np.int64),) * 3]
        x, y, crowd = (np.concatenate(c) for c in zip(*out))
        return pa.table({"a": x, "b": y, "crowd": crowd})
    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets link."""
    for batch in batches:
        one, two = shingles.sets(batch["text_a"]), shingles.sets(batch["text_b"])
        keep = []
        for x, y in zip(one, two):
            common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def frequent(texts: DataFrame) -> np.ndarray:
    """Codes of shingles that are frequent in one of ``SAMPLE_ONE_IN`` texts, at most ``MOST_FREQUENT``, sorted: all that
    are seen more often than a number which the counts of counts tell, so the driver gets no more than it keeps."""
    counted = store(
        texts.where(F.pmod(F.crc32(F.encode("__text", "UTF-8")), F.lit(SAMPLE_ONE_IN)) == 0).select("__text")
        .mapInArrow(_map_frequent, "code long, times long").groupBy("code").agg(F.sum("times").alias("times")), "frequent")
    more = Window.orderBy(F.desc("times")).rowsBetween(Window.unboundedPreceding, 0)
    sizes = counted.groupBy("times").agg(F.count("*").alias("codes")).withColumn("upto", F.sum("codes").over(more))
    least = sizes.where(F.col("upto") <= MOST_FREQUENT).agg(F.min("times")).first()[0]
    rows = [] if least is None else counted.where(F.col("times") >= least).select("code").collect()
    discard(counted)
    return np.sort(np.array([r.code for r in rows], np.int64).astype(np.uint64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"),
    ).withColumn("__key", F.xxhash64("__id", "__text"))


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    joined = members.join(roots, F.col("class") == F.col("node"), "left")
    return joined.withColumn("root", F.coalesce("root", "class")).drop("node")


def _apart(crowds: DataFrame) -> DataFrame:
    """What is left to compare in crowded lists: members outside the list's largest component, among themselves and with
    the pieces of that component. Rows are pairs of pieces whose sizes fit (``list``, ``of``, ``cut``, ``members``).

    Members outside are dealt out by band of size (sets that link differ by one band at most) and hash.
    """
    largest = (
        crowds.groupBy("of", "root").agg(F.count("*").alias("many"))
        .groupBy("of").agg(F.max(F.struct("many", "root")).alias("top"), F.sum("many").alias("all"))
        .where("top.many < all").select("of", F.col("top.root").alias("largest")))
    members = crowds.join(largest, "of")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / PERCENT))
    outside = members.where("root <> largest").withColumn("band", band)
    pieces = outside.groupBy("of", "band").agg(F.ceil(F.count("*") / PIECE).alias("parts"))
    outside = outside.join(pieces, ["of", "band"]).withColumn("part", F.pmod(F.xxhash64("class"), "parts"))
    piece = (F.collect_list("class").alias("members"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    mine = outside.groupBy("of", "band", "part").agg(*piece).withColumn("name", F.xxhash64("band", "part", F.lit(1)))
    other = members.where("root = largest").groupBy("of", "piece").agg(*piece).withColumn("name", F.xxhash64("piece", F.lit(2)))
    columns = ["of", "name", "members", "low", "high"]
    mine, other = mine.select(columns), other.select(columns)
    a, b = mine.alias("a"), mine.select(*columns, F.lit(True).alias("outside")).union(
        other.select(*columns, F.lit(False))).alias("b")
    fit = (F.col("a.high") * 100 >= F.col("b.low") * PERCENT) & (F.col("b.high") * 100 >= F.col("a.low") * PERCENT)
    once = ~F.col("b.outside") | (F.col("a.name") <= F.col("b.name"))
    itself = F.col("b.outside") & (F.col("a.name") == F.col("b.name"))
    return a.join(b, (F.col("a.of") == F.col("b.of")) & fit & once).select(
        F.xxhash64("a.of", "a.name", "b.name").alias("list"), "a.of",
        F.when(itself, 0).otherwise(F.size("a.members")).alias("cut"),
        F.when(itself, F.col("a.members")).otherwise(F.concat("a.members", "b.members")).alias("members"))


def _classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row per document: ``__id``, ``__key``, ``n_shingles``, ``class``; the ``root`` of each class)."""
    spark = texts.sparkSession
    buckets = packed.bucket_count(spark)
    kind = texts.schema["__id"].dataType.simpleString()
    rows = store(texts.select("__id", "__key", "__text").mapInArrow(
        _map_classes, f"__id {kind}, __key long, n_shingles long, class long, bits binary"), "classes")
    classes = rows.where("class is not null").groupBy("class").agg(
        F.min("__key").alias("__key"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    lists = (
        texts.select("__text").mapInArrow(
            _map_prefixes(buckets, frequent(texts)), packed.ddl(["key", "class", "size"]))
        .groupBy("bucket").applyInArrow(_lists(PIECE), "of long, piece int, pieces int, cut int, members array<long>")
        .groupBy("of", "piece", (F.col("cut") > 0).alias("across"))
        .agg(*(F.first(c).alias(c) for c in ("pieces", "cut", "members")))
        .withColumn("list", F.xxhash64("of", "piece", "across")))
    lists = store(lists, "lists")

    def walked(some: DataFrame, second: bool, roots: DataFrame | None) -> DataFrame:
        members = some.select("list", "of", "cut", F.size("members").alias("many"), F.posexplode("members").alias("place", "class"))
        members = members.join(classes, "class")
        members = members.withColumn("root", F.col("class")) if roots is None else _with_roots(members, roots)
        # A long piece is a group of its own; short lists share one.
        bucket = F.when(F.col("many") > PIECE // 2, F.col("list")).otherwise(F.pmod("list", F.lit(buckets)))
        return (
            members.withColumn("bucket", bucket)
            .select("bucket", "list", "of", "cut", "place", "class", "n_shingles", "bits", "root")
            .groupBy("bucket").applyInArrow(_walk_lists(second, CLOSEST), "a long, b long, crowd long"))

    found = store(walked(lists, False, None), "pairs")
    pairs = found.select("a", "b").distinct()
    cut_short = found.where("crowd <> 0").select(F.col("crowd").alias("of")).union(lists.where("pieces > 2").select("of"))
    crowded = lists.where("cut = 0").join(cut_short.distinct(), "of", "left_semi")
    in_crowds = crowded.select(F.explode("members").alias("class"))
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(in_crowds).distinct()
    held = store(
        texts.select("__key", "__text").join(classes.select("class", "__key").join(ends, "class"), "__key")
        .dropDuplicates(["class"]).select("class", "__text"), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(held.select(F.col("class").alias("a"), F.col("__text").alias("text_a")), "a")
            .join(held.select(F.col("class").alias("b"), F.col("__text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a long, b long"))

    links = store(linked(pairs), "links")
    roots = components(links)
    crowds = store(_with_roots(
        crowded.select("of", "piece", F.explode("members").alias("class"))
        .join(classes.select("class", "n_shingles"), "class"), roots), "crowds")
    rest = walked(_apart(crowds), True, roots).select("a", "b").distinct()
    more = store(linked(rest), "links")
    roots = components(links.union(more))
    for done in (lists, found, held, links, crowds, more):
        discard(done)
    named = classes.select("class").join(roots, F.col("class") == F.col("node"), "left").select(
        "class", F.coalesce("root", "class").alias("root"))
    return rows, named


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``, the least id reachable by links."""
    rows, named = _classes(_texts(docs, id_col, text_col))
    ids = rows.where("class is not null").groupBy("class").agg(F.min("__id").alias("least")).join(named, "class")
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    told = ids.select("class", "root").join(least, "root").select("class", "component_id")
    return rows.select("__id", "n_shingles", "class").join(told, "class", "left").select(
        F.col("__id").alias(id_col), "n_shingles",
        F.when(F.col("class").isNull(), F.col("__id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for all except the least id (and then hash) of each component; rows without words stay."""
    rows, named = _classes(_texts(docs, id_col, text_col))
    first = F.min(F.struct("__id", "__key")).alias("first")
    least = rows.where("class is not null").groupBy("class").agg(first).join(named, "class").groupBy("root").agg(
        F.min("first").alias("first"))
    kept = least.select(F.col("first.__key").alias("__kept"), F.lit(True).alias("__one")).union(
        rows.where("class is null").select("__key", F.lit(False)).distinct())
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    key = F.xxhash64(F.col(f"d.`{id_col}`"), F.coalesce(F.col(f"d.`{text_col}`"), F.lit("")))
    found = docs.alias("d").join(kept.alias("k"), key == F.col("k.__kept")).select(
        F.struct(*columns).alias("__row"), "k.__kept", "k.__one")
    equal = Window.partitionBy("__kept").orderBy(F.lit(0))
    return found.withColumn("__rank", F.row_number().over(equal)).where("__rank = 1 OR NOT __one").select("__row.*")
