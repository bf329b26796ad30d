"""Phrase collocations: phrases that are frequent, scored by how rarely their parts stand apart.

Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words; a phrase is 1 to 4 words in a row of a piece,
per language. A phrase counts as frequent from ``LEAST`` occurrences on.

1. Every task counts the hashes of its phrases and deals them by hash into partitions. Each partition merges the
   tasks' counts into one Misra-Gries summary with more counters than ``SLACK`` times its mass over ``LEAST``; whenever
   there are more keys than counters, the first count that does not fit is taken off all of them. What is taken off adds
   up to less than ``LEAST / SLACK``, so every frequent phrase keeps a counter, whatever the order of merging. Mass,
   and so the counters, are known to a partition before it merges; a partition is a range of hashes, and a phrase of any
   frequency sends it one count per batch.
2. The surviving hashes set bits in one bitmap of fixed size (``FILTER_BITS``), the only thing that travels to all tasks.
   In a second pass over the texts the phrases whose own bit and whose parts' bits are set are counted by their
   words, and exact counts of at least ``LEAST`` remain. A full bitmap would let all phrases pass and change no result.
3. Scores, cuts and containment are joins and sums over the frequent phrases. A phrase's parts are frequent as well,
   since they occur wherever it does.

Within ``SLICES`` slices of texts, phrases of equal 64-bit hashes are taken to be equal; beyond them words decide.

Defined cases: null text is empty, null language is ``und``; phrases do not cross pieces or rows; repeated rows count
once each; ties of score and count go by the phrase's bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspan.llm import octets, packed
from clinspan.llm.stored import store

LEAST = 30             # occurrences of a frequent phrase
WORDS = 4              # of the longest phrase
CONTAINED = 80         # percent of its occurrences inside a longer phrase that drop a phrase
SCALE = 2_000_000      # of the score
SLACK = 4              # counters of a summary, in units of mass / LEAST
FILTER_BITS = 1 << 27  # 16 MB, whatever the input
BATCH = 1 << 21        # phrases that a task counts at once
SLICES = 8             # slices of texts whose phrases it then looks up
TOP = 2000             # of each language
_BREAKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_BLANKS = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and rows of the words of lower-cased texts, and how many words of its piece each begins."""
    solid = ~(_BREAKS | _BLANKS)[data]
    before = np.r_[False, solid[:-1]] if len(data) else solid
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    before[cut] = False
    starts = np.flatnonzero(solid & ~before)
    row = np.searchsorted(offsets, starts, side="right") - 1
    after = np.r_[solid[1:], False] if len(data) else solid
    after[cut - 1] = False
    stops = np.flatnonzero(solid & ~after) + 1
    breaks = np.r_[0, np.cumsum(_BREAKS[data])]
    piece = breaks[starts] + row  # a new row or break starts another piece
    last = np.searchsorted(piece, piece, side="right")
    return starts, stops, row, last - np.arange(len(starts))


def phrase_keys(data: np.ndarray, words: tuple, languages: np.ndarray) -> list[np.ndarray]:
    """For 1 to ``WORDS`` words, the hash of the phrase that begins at each word; only the first ones of a piece have all."""
    starts, stops, row, left = words
    word = octets.range_hash(octets.prefix_hash(data), starts, stops)
    made, keys = languages[row], []
    for k in range(WORDS):
        here = np.zeros(len(word), np.uint64)
        here[:len(word) - k] = word[k:]
        made = octets.mix(made * octets.BASE + here)
        keys.append(made[left > k])
    return keys


def language_hashes(column: pa.Array) -> np.ndarray:
    data, offsets = octets.buffers(column)
    return octets.range_hash(octets.prefix_hash(data), offsets[:-1], offsets[1:])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Bytes, words and phrase hashes of slices of a batch of (language, text), with the language of each row."""
    languages = language_hashes(batch.column(0))
    for at, to, data, offsets in octets.slices(batch.column(1)):
        data = octets.lower(data)
        words = word_runs(data, offsets)
        yield data, words, phrase_keys(data, words, languages[at:to]), batch.column(0).slice(at, to - at)


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    ends = np.r_[at, len(keys)]
    return keys[at], np.diff(ends) if counts is None else octets.run_sums(counts, ends)


def _map_hashes(buckets: int):
    """Counts of phrase hashes, packed by bucket: keys seen once, then the others with their counts."""
    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = tally(np.concatenate(held))
        bucket, low = packed.bucket_and_key(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, low, counts = bucket[order], low[order], counts[order]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        once, more, times = [], [], []
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            single = counts[a:z] == 1
            once.append(low[a:z][single].tobytes())
            more.append(low[a:z][~single].tobytes())
            times.append(counts[a:z][~single].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(buckets), pa.int32()), *[pa.array(x, pa.binary()) for x in (once, more, times)]],
            ["bucket", "once", "more", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, keys, _ in _slices(batch):
                held += keys
                size += sum(map(len, keys))
                if size >= BATCH:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)
    return run


def merged(summary: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray], capacity: int) -> tuple:
    """Two Misra-Gries summaries as one of at most ``capacity`` counters, and what was taken off every counter."""
    keys, counts = tally(np.concatenate((summary[0], more[0])), np.concatenate((summary[1], more[1])))
    if len(keys) <= capacity:
        return (keys, counts), 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > off
    return (keys[left], counts[left] - off), off


def frequent(parts: list[tuple[np.ndarray, np.ndarray]], least: int, slack: int = SLACK) -> np.ndarray:
    """Keys that may have ``least`` occurrences in the parts together, none of those that have left out."""
    capacity = slack * sum(int(counts.sum()) for _, counts in parts) // least + 1
    summary, off = (np.zeros(0, np.uint32), np.zeros(0, np.int64)), 0
    held, size = [], 0
    for k, part in enumerate(parts):
        held.append(part)
        size += len(part[0])
        if size >= capacity or k == len(parts) - 1:
            more = tuple(np.concatenate(x) for x in zip(*held))
            summary, taken = merged(summary, more, capacity)
            off, held, size = off + taken, [], 0
    return summary[0][summary[1] + off >= least]


def _summarise(buckets: int, least: int):
    bits = FILTER_BITS // buckets // 8 * 8

    def run(table: pa.Table) -> pa.Table:
        """The slice of the bitmap that one bucket's surviving keys set."""
        parts = []
        for once, more, times in zip(*[table[n].to_pylist() for n in ("once", "more", "times")]):
            once, more = np.frombuffer(once, np.uint32), np.frombuffer(more, np.uint32)
            counts = np.r_[np.ones(len(once), np.int64), np.frombuffer(times, np.uint32).astype(np.int64)]
            parts.append((np.concatenate((once, more)), counts))
        found = frequent(parts, least)
        places = np.zeros(bits, np.uint8)
        places[(found.astype(np.uint64) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)] = 1
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()),
                         "bits": pa.array([np.packbits(places, bitorder="little").tobytes()], pa.binary())})
    return run


def survivors(texts: DataFrame, least: int = LEAST) -> tuple[np.ndarray, int]:
    """The bitmap over the phrase hashes of (language, text), and the number of its partitions."""
    buckets = packed.bucket_count(texts.sparkSession)
    rows = texts.mapInArrow(_map_hashes(buckets), "bucket int, once binary, more binary, times binary").groupBy(
        "bucket").applyInArrow(_summarise(buckets, least), "bucket int, bits binary")
    each = FILTER_BITS // buckets // 8
    bitmap = np.zeros(buckets * each, np.uint8)
    for row in rows.toLocalIterator(prefetchPartitions=True):
        bitmap[row["bucket"] * each:(row["bucket"] + 1) * each] = np.frombuffer(row["bits"], np.uint8)
    return bitmap, buckets


def _passes(bitmap: np.ndarray, buckets: int, keys: np.ndarray) -> np.ndarray:
    bits = FILTER_BITS // buckets // 8 * 8
    bucket, low = packed.bucket_and_key(keys, buckets)
    at = bucket.astype(np.int64) * bits + (low.astype(np.uint64) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def texts_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """``data[start:stop]`` of each range as strings, runs of blanks as one space."""
    sizes = stops - starts
    ends = np.r_[0, np.cumsum(sizes)]
    taken = data[np.arange(ends[-1]) - np.repeat(ends[:-1] - starts, sizes)] if len(starts) else data[:0]
    taken = np.where(taken == 9, np.uint8(32), taken)
    keep = np.ones(len(taken), bool)
    keep[1:] = (taken[1:] != 32) | (taken[:-1] != 32)  # ranges begin and end with a word's bytes
    ends = np.r_[0, np.cumsum(keep)][ends]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [
        None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(taken[keep]))]).cast(pa.string())


def _map_phrases(shared, buckets: int):
    """Counts by words of the phrases that pass the bitmap, and of all words of a language as length 0."""
    names = ["lang", "n_words", "phrase", "count"]

    def row_batch(lang: pa.Array, length: np.ndarray, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [lang.cast(pa.string()), pa.array(length, pa.int32()), phrase, pa.array(count, pa.int64())], names)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """``held``: (hashes, first word, number of words) of occurrences in a slice, and (bytes, words, languages)."""
        slices = [h[3] for h in held]
        keys = np.concatenate([h[0] for h in held])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        count, chosen = np.diff(np.r_[at, len(keys)]), order[at]
        of = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])[chosen]
        first = np.concatenate([h[1] for h in held])[chosen]
        length = np.concatenate([h[2] for h in held])[chosen]
        for k, (data, (starts, stops, row, _), languages) in enumerate(slices):
            mine = np.flatnonzero(of == k)
            begin, size = first[mine], length[mine]
            lang = languages.take(pa.array(row[begin]))
            yield row_batch(lang, size, texts_of(data, starts[begin], stops[begin + size - 1]), count[mine])
        for k, (_, (_, _, row, _), languages) in enumerate(slices):
            found = pa.compute.value_counts(languages.take(pa.array(row)))
            n = len(found)
            yield row_batch(found.field(0), np.zeros(n, np.int32), pa.array([""] * n, pa.string()), found.field(1).to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        held = []
        for batch in batches:
            for data, words, keys, languages in _slices(batch):
                left = words[3]
                fits = np.zeros((WORDS, len(left)), bool)
                for k in range(WORDS):
                    fits[k][left > k] = _passes(bitmap, buckets, keys[k])
                    if k:  # both parts without an end word are frequent if the phrase is
                        fits[k] &= fits[k - 1]
                        fits[k][:-1] &= fits[k - 1][1:]
                found = [np.flatnonzero(f) for f in fits]
                hashes = [keys[k][(np.cumsum(left > k) - 1)[f]] for k, f in enumerate(found)]
                sizes = np.repeat(np.arange(1, WORDS + 1, dtype=np.int32), [len(f) for f in found])
                held.append((np.concatenate(hashes), np.concatenate(found), sizes, (data, words, languages)))
                if len(held) == SLICES:
                    yield from flush(held)
                    held = []
        if held:
            yield from flush(held)
    return run


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """Stored exact counts (lang, n_words, phrase, count) of frequent phrases; n_words 0 is the number of all words."""
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bitmap, buckets = survivors(texts, least)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    found = texts.mapInArrow(_map_phrases(shared, buckets), "lang string, n_words int, phrase string, count long")
    found = found.groupBy("lang", "n_words", "phrase").agg(F.sum("count").alias("count"))
    return store(found.where(f"n_words = 0 OR count >= {least}"), "phrases")


def _part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counted: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the frequent phrases of two words and more that no longer one contains."""
    split = F.split("phrase", " ")
    part = counted.where("n_words > 0").select("lang", F.col("phrase").alias("part"), "count")
    long = counted.where("n_words > 1").select("lang", "phrase", "n_words", F.col("count").alias("a"))
    cuts = long.select("lang", "phrase", "a", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", _part(split, 1, F.col("k"))).withColumn(
        "right", _part(split, F.col("k") + 1, F.col("n_words") - F.col("k")))
    cuts = cuts.join(part.withColumnsRenamed({"part": "left", "count": "l"}), ["lang", "left"])
    cuts = cuts.join(part.withColumnsRenamed({"part": "right", "count": "r"}), ["lang", "right"])
    exact = F.expr(f"cast({SCALE} AS decimal(10,0)) * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    inside = long.where("n_words > 2").select("lang", "a", "n_words", split.alias("words"), F.explode(
        F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size"))
    inside = inside.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)).alias("at"))
    inside = inside.groupBy("lang", _part(F.col("words"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    wide = "cast({} AS decimal(38,0))".format
    dropped = F.expr(f"longer IS NOT NULL AND 100 * {wide('longer')} >= {contained} * {wide('a')}")
    return least.join(inside, ["lang", "phrase"], "left").where(~dropped).select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each language, with their ``rank``. Salted, so a language spans tasks until few are left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(4096)))
    for salts in (4096, 64):
        own = Window.partitionBy("lang", F.pmod("salt", F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top).drop("salt")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    counted = counts(docs, text_col, lang_col, least)
    total = counted.where("n_words = 0").select("lang", F.col("count").alias("n"))
    return best(scored(counted), top).join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
