"""Removal of byte strings that repeat across or inside documents, by sparse suffix sorting.

A repeat is a string of ``WIDTH`` bytes that also starts earlier: in a document with a smaller id, or
further left in the same one. Every byte covered by a repeat goes.

1. Exact copies of a text are found by digest. All but the first are removed whole (their strings all
   start in the first); only firsts go on, so a text with millions of copies counts once.
2. Each window of ``WIDTH`` bytes is assigned to an anchor: the ``GRAM``-byte string inside it with the
   least hash, the rightmost of equals. Equal windows have equal anchors at equal places, so anchors
   seen once are dropped without losing a repeat (packed entries, one shuffle by hash range).
3. The region of windows around each remaining anchor is sent to the anchor's bucket. Equal regions
   collapse onto the earliest, first inside each batch of texts, so that a passage of millions of
   documents arrives once per batch, then in the bucket; their bytes are compared. The rest are cut
   into ``BLOCK``-byte blocks aligned at the anchor, each block a symbol, and all regions of the bucket
   form one text whose suffixes are sorted by linear grouping (:mod:`clinspan.llm.suffix_groups`). A
   window holds ``SHARED`` whole blocks, so equal windows lie around suffixes in one run of neighbours
   of which each shares ``SHARED`` blocks with the next. Inside a run only the bytes around the shared
   blocks are left to compare: up to 15 before them and up to 20 behind. Windows equal there are
   repeats, and all but the earliest are marked. No hash decides: hashes only bring rows together.
4. Marks go back to their documents.

Defined cases: null text is empty; texts shorter than ``WIDTH`` bytes stay whole; a null id counts as
the smallest; rows that are equal in id and text are one document and get the same result; rows that
share an id only are told apart by a hash of both, which also orders them where it matters; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspan.llm import octets, packed
from clinspan.llm.suffix_groups import suffix_array

WIDTH = 100
GRAM = 32
BLOCK = 16
SHARED = (WIDTH - BLOCK + 1) // BLOCK  # whole blocks in any window
REACH = WIDTH - GRAM + 1  # grams in a window
SEGMENT = 1 << 20
TOLD = 255  # in place of an anchor's place: a region that its batch has shown to be a repeat
_POSITION = np.uint64((1 << 21) - 1)

ANCHORS = {"key": np.uint32, "doc": np.int64, "start": np.uint32, "windows": np.uint8, "at": np.uint8}
REGIONS = {"key": np.uint32, "number": np.int64, "doc": np.int64, "start": np.uint32, "windows": np.uint8, "at": np.uint8}
_PLACE = np.dtype([("key", "<u4"), ("start", "<u4"), ("windows", "u1"), ("at", "u1")])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by its start."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside the texts: row, hash, first window's start in the text, windows, anchor's place."""
    found = []
    for low in range(0, max(len(data) - WIDTH + 1, 0), SEGMENT):
        part = data[low:low + SEGMENT + WIDTH - 1]
        hashes = octets.window_hash(octets.prefix_hash(part), GRAM)
        if len(hashes) < REACH:
            continue
        tagged = (hashes & ~_POSITION) | (_POSITION - np.arange(len(hashes), dtype=np.uint64))
        place = (_POSITION - (sliding_least(tagged, REACH) & _POSITION)).astype(np.int64)
        starts = np.arange(len(place))
        row = np.searchsorted(offsets, starts + low, side="right") - 1
        inside = starts + low + WIDTH <= offsets[row + 1]
        starts, row, place = starts[inside], row[inside], place[inside]
        if not len(starts):
            continue
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
        count = np.diff(np.r_[new, len(starts)])
        first = starts[new]
        found.append((row[new], hashes[place[new]], first + low - offsets[row[new]], count, place[new] - first))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _map_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["__key"].to_numpy()
            rows = [[] for _ in range(5)]
            for first, _, data, offsets in octets.slices(batch["__text"]):
                row, *rest = anchors(data, offsets)
                for kept, x in zip(rows, (keys[first + row], *rest)):
                    kept.append(x)
            if not rows[0]:
                continue
            doc, hashes, start, windows, at = (np.concatenate(x) for x in rows)
            bucket, key = packed.bucket_and_key(hashes, buckets)
            yield packed.pack(bucket, {
                "key": key, "doc": doc.astype(np.int64), "start": start.astype(np.uint32),
                "windows": windows.astype(np.uint8), "at": at.astype(np.uint8)})
    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Anchors of one bucket that stand at two or more places, packed by document."""
    key, doc, start, windows, at = (packed.unpack(table[n], kind) for n, kind in ANCHORS.items())
    order = np.lexsort((start, doc, key))
    key, doc, start, windows, at = (x[order] for x in (key, doc, start, windows, at))
    new = np.ones(len(key), bool)  # equal rows of the input give the same place twice
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    key, doc, start, windows, at = (x[new] for x in (key, doc, start, windows, at))
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    keep = same[1:] | same[:-1]
    place = np.empty(int(keep.sum()), _PLACE)
    for name, x in (("key", key), ("start", start), ("windows", windows), ("at", at)):
        place[name] = x[keep]
    doc = doc[keep]
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order]
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    ends = np.r_[edge, len(doc)]
    offsets = (ends * _PLACE.itemsize).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets), pa.py_buffer(place)])
    bucket = table["bucket"][0].as_py()
    return pa.table({"__key": pa.array(doc[edge], pa.int64()), "bucket": pa.array(np.full(len(edge), bucket), pa.int32()),
                     "places": blob})


def _copies(words: np.ndarray, low: np.ndarray, size: np.ndarray, places: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each range of bytes equals one at an earlier place; ``places`` hold the first key last.

    Rows of the input that are equal stand at one place, and are no copies of each other.
    """
    name = octets.name_ranges(words, low, size)
    order = np.lexsort((*places, name))
    head = np.ones(len(order), bool)
    head[1:] = name[order][1:] != name[order][:-1]
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    copy = np.zeros(len(order), bool)
    copy[order] = ~head
    copy[order] &= (size[order] == size[first]) & octets.equal_ranges(words, low[order], low[first], size[order])
    copy[order] &= ~np.logical_and.reduce([x[order] == x[first] for x in places])
    return copy


def _map_regions(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", *REGIONS, "octets"]
        for batch in batches:
            data, offsets = octets.buffers(batch["__text"])
            keys, numbers = batch["__key"].to_numpy(), batch["__doc"].to_numpy()
            bucket, row, place = [], [], []
            for i, held in enumerate(batch["__places"].to_pylist()):
                for item in held:
                    part = np.frombuffer(item["places"], _PLACE)
                    place.append(part)
                    bucket.append(np.full(len(part), item["bucket"], np.int32))
                    row.append(np.full(len(part), i, np.int64))
            if not place:
                continue
            bucket, row, place = np.concatenate(bucket), np.concatenate(row), np.concatenate(place)
            order = np.lexsort((place["key"], bucket))  # equal regions have one key and meet in one slice
            bucket, row, place = bucket[order], row[order], place[order]
            base = int(offsets[0])
            whole = data[base:offsets[-1]].tobytes() + bytes(8)
            words = octets.words_at(whole)
            for at in range(0, len(row), 1 << 16):  # the regions overlap, so they hold more than the texts
                some = slice(at, at + (1 << 16))
                b, r, p = bucket[some], row[some], place[some]
                low = offsets[r] - base + p["start"]
                size = p["windows"].astype(np.int64) + WIDTH - 1
                fits = low + size <= offsets[r + 1] - base
                b, r, p, low, size = b[fits], r[fits], p[fits], low[fits], size[fits]
                told = _copies(words, low, size, (p["start"], keys[r], numbers[r]))
                b = np.where(told, (keys[r] % buckets).astype(np.int32), b)
                ends = np.where(told, low, low + size)
                pieces = [whole[x:y] for x, y in zip(low.tolist(), ends.tolist())]
                out = packed.pack(b, {
                    "key": p["key"], "number": numbers[r], "doc": keys[r], "start": p["start"],
                    "windows": p["windows"], "at": np.where(told, TOLD, p["at"]).astype(np.uint8)})
                _, joined = packed.pack_bytes(b, pieces)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(joined, pa.binary())], names)
    return run


def _marks(table: pa.Table) -> pa.Table:
    """Windows of one bucket that also start earlier, as ranges of bytes by document."""
    parts = {n: packed.unpack(table[n], kind) for n, kind in REGIONS.items()}
    words = octets.words_at(b"".join([*table["octets"].to_pylist(), bytes(8)]))
    length = parts["windows"].astype(np.int64) + WIDTH - 1
    told = parts["at"] == TOLD
    held = np.where(told, 0, length)
    low = np.cumsum(held) - held
    left = np.flatnonzero(~told)
    place = (parts["start"], parts["doc"], parts["number"])
    left = left[np.lexsort((*(x[left] for x in place), parts["key"][left]))]
    same = np.zeros(len(left), bool)  # equal rows of the input give the same region twice
    same[1:] = np.logical_and.reduce([x[left][1:] == x[left][:-1] for x in (*place, parts["key"])])
    left = left[~same]
    copy = _copies(words, low[left], length[left], tuple(x[left] for x in place))
    copies, firsts = np.r_[np.flatnonzero(told), left[copy]], left[~copy]
    out = [(parts["number"][copies], parts["doc"][copies], parts["start"][copies].astype(np.int64), length[copies])]
    _, inverse, times = np.unique(parts["key"][firsts], return_inverse=True, return_counts=True)
    firsts = firsts[times[inverse] > 1]
    if len(firsts):
        firsts = firsts[np.lexsort(tuple(x[firsts] for x in place))]
        owner, shift = _repeated_windows(words, low[firsts], length[firsts], parts["at"][firsts].astype(np.int64))
        run = np.ones(len(owner), bool)
        run[1:] = (owner[1:] != owner[:-1]) | (shift[1:] != shift[:-1] + 1)
        begin = np.flatnonzero(run)
        size = np.diff(np.r_[begin, len(owner)])
        who = firsts[owner[begin]]
        out.append((parts["number"][who], parts["doc"][who], parts["start"][who] + shift[begin], size + WIDTH - 1))
    number, doc, start, size = (np.concatenate(x) for x in zip(*out))
    return pa.table({
        "__key": pa.array(doc, pa.int64()), "__doc": pa.array(number, pa.int64()),
        "start": pa.array(start, pa.int64()), "stop": pa.array(start + size, pa.int64())})


def _equal_to_one_before(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row equals an earlier one in all columns: met by a hash, told by the columns."""
    name = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        name = octets.mix(name ^ x)
    order = np.argsort(name, kind="stable")
    met = name[order][1:] == name[order][:-1]
    same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in columns])
    if (met & ~same).any():  # unlike rows of one hash: an order of the columns themselves
        order = np.lexsort(columns)
        same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in columns])
    again = np.zeros(len(order), bool)
    again[order[1:]] = same
    return again


def _repeated_windows(words, low, length, at) -> tuple[np.ndarray, np.ndarray]:
    """(region, window) of the windows equal to one of an earlier region; regions come in document order."""
    lead = at % BLOCK
    blocks = (length - lead) // BLOCK
    base = np.cumsum(blocks + 1) - (blocks + 1)
    region = np.repeat(np.arange(len(low)), blocks)
    step = np.arange(len(region)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = low[region] + lead[region] + BLOCK * step
    one, two = words[start], words[start + 8]
    order = np.lexsort((two, one))
    new = np.ones(len(order), np.int64)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    symbol = np.empty(len(order), np.int64)
    symbol[order] = np.cumsum(new)
    text = np.zeros(int((blocks + 1).sum()), np.int64)
    text[base[region] + step] = symbol  # 0 ends each region
    order = np.array(suffix_array(text.tolist()), np.int64)
    ended = np.r_[text, np.zeros(SHARED, np.int64)]
    agree = np.ones(len(order) - 1, bool)
    for k in range(SHARED):
        a, b = ended[order[:-1] + k], ended[order[1:] + k]
        agree &= (a == b) & (a != 0)
    group_in_order = np.cumsum(np.r_[0, ~agree])
    crowd = np.bincount(group_in_order)
    group = np.empty(len(order), np.int64)
    group[order] = group_in_order
    windows = length - (WIDTH - 1)
    owner = np.repeat(np.arange(len(low)), windows)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    block = -(-(shift - lead[owner]) // BLOCK)
    held = group[base[owner] + block]
    near = crowd[held] > 1
    owner, shift, block, held = owner[near], shift[near], block[near], held[near]
    begin = low[owner] + shift
    ahead = lead[owner] + BLOCK * block - shift
    behind = begin + ahead + SHARED * BLOCK
    after = WIDTH - SHARED * BLOCK - ahead
    around = [(held * BLOCK + ahead).astype(np.uint64)]
    around += [octets.word(words, begin + k, ahead - k) for k in range(0, BLOCK, 8)]
    around += [octets.word(words, behind + k, after - k) for k in range(0, WIDTH - SHARED * BLOCK, 8)]
    again = _equal_to_one_before(around)
    return owner[again], shift[again]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept bytes and the removed ranges of each document."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        first = batch["__first"].to_pylist()
        marks = batch["__marks"].to_pylist()
        kept, spans, sizes = [], [], []
        for a, z, data, offsets in octets.slices(batch["__text"]):
            whole, ends = data.tobytes(), offsets.tolist()
            for i in range(a, z):
                text = whole[ends[i - a]:ends[i - a + 1]]
                n = len(text)
                removed = []
                if first[i] is None:
                    removed = [(0, n)] if n >= WIDTH else []
                elif marks[i]:
                    for m in sorted((m["start"], m["stop"]) for m in marks[i]):
                        if removed and m[0] <= removed[-1][1]:
                            removed[-1] = (removed[-1][0], max(removed[-1][1], m[1]))
                        else:
                            removed.append(m)
                at, left = 0, []
                for x, y in removed:
                    left.append(text[at:x])
                    at = y
                left.append(text[at:])
                kept.append(b"".join(left))
                spans.append([{"start": x, "stop": y} for x, y in removed])
                sizes.append(n)
        for low in range(0, len(sizes), 1000):
            some = slice(low, low + 1000)
            yield pa.RecordBatch.from_arrays(
                [batch["__id"][some], pa.array(sizes[some], pa.int64()), pa.array(kept[some], pa.binary()),
                 pa.array(spans[some], kind)], ["__id", "n_bytes", "kept", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes``, the ``kept`` bytes and the removed ``spans`` of bytes."""
    spark = docs.sparkSession
    buckets = packed.bucket_count(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(
        F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
    ).withColumns({
        "__doc": F.coalesce(F.col("__id").cast("long"), F.lit(-(1 << 63))),
        "__key": F.xxhash64("__id", "__text")})
    firsts = (
        texts.groupBy(F.md5(F.encode("__text", "UTF-8")).alias("digest"), F.octet_length("__text").alias("size"))
        .agg(F.min(F.struct("__doc", "__key")).alias("first"))
        .select(F.col("first.__key").alias("__key"), F.col("first.__doc").alias("__first")))

    def with_texts(side: DataFrame) -> DataFrame:
        return texts.join(side, "__key", "left")

    anchor_rows = (
        # A range, as an equality would become a join key and deal the texts out once more.
        with_texts(firsts).where(F.col("__first").between(F.col("__doc"), F.col("__doc"))).select("__key", "__text", "__id", "__doc")
        .mapInArrow(_map_anchors(buckets), packed.ddl(list(ANCHORS))))
    places = (
        anchor_rows.groupBy("bucket").applyInArrow(_repeated, "__key long, bucket int, places binary")
        .groupBy("__key").agg(F.collect_list(F.struct("bucket", "places")).alias("__places")))
    regions = (
        with_texts(places).where("__places is not null").select("__key", "__doc", "__text", "__places", "__id")
        .mapInArrow(_map_regions(buckets), packed.ddl([*REGIONS, "octets"])))
    marks = (
        regions.groupBy("bucket").applyInArrow(_marks, "__key long, __doc long, start long, stop long")
        .groupBy("__key", F.col("__doc").alias("__of"))
        .agg(F.collect_list(F.struct("start", "stop")).alias("__marks")))
    told = firsts.join(
        marks.withColumnRenamed("__key", "__of_key"),
        (F.col("__key") == F.col("__of_key")) & (F.col("__first") == F.col("__of")), "left",
    ).select("__key", "__first", "__marks")
    return (
        with_texts(told)
        .withColumn("__first", F.when(F.col("__first") == F.col("__doc"), F.col("__first")))
        .select("__id", "__text", "__first", "__marks", "__key", "__doc")
        .mapInArrow(_cut, f"__id {kind}, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")
        .withColumnRenamed("__id", id_col))
