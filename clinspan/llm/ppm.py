"""Language-model scores by prediction by partial matching over bytes, beside word unigram scores.

The model is a trie of byte contexts up to ``ORDER`` long, counted over all training texts (lower-cased
A-Z, a start mark repeated before each text, an end mark after it). A symbol's probability is found from
the longest context seen on: ``count / (total + distinct)`` if the symbol was seen there, else the escape
``distinct / (total + distinct)`` and on with the context one byte shorter, where the symbols of the
longer context are excluded from total and distinct; below the empty context all symbols not seen are
equally likely. As the trie is fixed while scoring, what a context excludes from the next is a sum that
is stored with it, and a text's score is a sum over its windows of ``ORDER + 1`` bytes.

Counting is packed by hash range, so no task holds the corpus' counts. The counts are not bounded, only
what travels to the tasks is: of the trie, contexts seen at least so often that ``MOST_NODES`` nodes
suffice, each with all its symbols (a shorter context is seen no less often, so all that a window after
such a context needs is there), and the ``MOST_WORDS`` most frequent words. All other windows and words
meet their counts in a join by hash range: counts of windows lie by the ``NEAR`` bytes before the symbol,
so that a bucket has all contexts that are at least so long, and the shorter ones, whose number is bounded
by the alphabet, travel whole. So every score is that of the whole model.

Defined cases: null texts are empty; an empty text is its end mark; texts of any length are scored
whole; a training set without rows gives every symbol 1 / ``ALPHABET`` and every word 1; repeated rows
get equal scores; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.llm import octets, packed
from clinspan.llm.stored import store

ORDER = 5
START, END = 0xFE, 0xFF  # bytes that no UTF-8 text holds
ALPHABET = 255           # 254 bytes and the end
MOST_NODES = 1 << 21
MOST_WORDS = 1 << 19
SLICE = 1 << 20
FLUSH = 1 << 20          # distinct windows a task holds before it sends them
NEAR = 3                 # bytes of context that windows of one bucket share
WORD = ORDER + 1         # marks word counts among those of orders 0 to ORDER
END_WORD = np.uint64(0x656E64)


def marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window of each symbol: it and the ORDER before it, as a number; first window of each text and the end)."""
    data = octets.lower(data)
    size = np.diff(offsets)
    ends = np.cumsum(size + ORDER + 1)
    begin = ends - (size + ORDER + 1)
    stream = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint8)
    shift = np.repeat(begin + ORDER - offsets[:-1], size)
    stream[np.arange(len(data)) + shift] = data
    stream[ends - 1] = END
    window = np.zeros(max(len(stream) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        window <<= np.uint64(8)
        window |= stream[k:len(stream) - ORDER + k]
    keep = np.ones(len(window), bool)
    for k in range(ORDER):  # windows that end in a start mark
        at = begin[1:] - ORDER + k
        keep[at] = False
    return window[keep], np.r_[0, np.cumsum(size + 1)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word)."""
    data = octets.lower(data)
    starts, stops, row = octets.words(data, offsets)
    return octets.range_hash(octets.prefix_hash(data), starts, stops), row


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sums = np.diff(np.r_[at, len(keys)]) if counts is None else np.add.reduceat(counts, at)
    return keys[at], sums.astype(np.int64)


def low_bytes(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def near(window: np.ndarray) -> np.ndarray:
    """The last bytes of each window's context, which decide its bucket."""
    return (window >> np.uint64(8)) & low_bytes(NEAR)


def shorter(keys: np.ndarray, counts: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of ``orders`` as sums of those of a higher order."""
    return [tally(keys & low_bytes(order + 1), counts) for order in orders]


def context_totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each node, how often its context is seen; all nodes of a context are given, in order."""
    of = keys >> np.uint64(8)
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    return np.repeat(np.add.reduceat(counts, at), np.diff(np.r_[at, len(of)])) if len(of) else counts


def _map_counts(buckets: int):
    names = ["bucket", "order", "keys", "counts"]

    def rows(order: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bucket, _ = packed.bucket_and_key(near(keys) if order == ORDER else keys, buckets)
        out = packed.pack(bucket, {"keys": keys, "counts": counts.astype(np.uint32)})
        return pa.RecordBatch.from_arrays(
            [out["bucket"], pa.array(np.full(out.num_rows, order), pa.int32()), out["keys"], out["counts"]], names)

    def flush(held, words):
        if len(held[0]):
            yield rows(ORDER, *held)
            yield rows(NEAR - 1, *tally(held[0] & low_bytes(NEAR), held[1]))
        if len(words[0]):
            yield rows(WORD, *words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held, words = none, none
        for batch in batches:
            for _, _, data, offsets in octets.slices(batch.column(0), SLICE):
                window, _ = marked(data, offsets)
                new = tally(window)
                held = tally(np.concatenate((held[0], new[0])), np.concatenate((held[1], new[1])))
                hashes, _ = word_hashes(data, offsets)
                new = tally(np.concatenate((hashes, np.full(len(offsets) - 1, END_WORD))))
                words = tally(np.concatenate((words[0], new[0])), np.concatenate((words[1], new[1])))
                if len(held[0]) + len(words[0]) > FLUSH:
                    yield from flush(held, words)
                    held, words = none, none
        yield from flush(held, words)
    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    """Counts of one bucket summed over the tasks, a row for each order."""
    orders = table["order"].to_numpy()
    out = {"bucket": [], "order": [], "keys": [], "counts": [], "total": []}
    for order in np.unique(orders).tolist():
        part = table.filter(pa.array(orders == order))
        keys, counts = tally(packed.unpack(part["keys"], np.uint64), packed.unpack(part["counts"], np.uint32).astype(np.int64))
        for name, value in zip(out, (part["bucket"][0].as_py(), order, keys.tobytes(), counts.tobytes(), int(counts.sum()))):
            out[name].append(value)
    return pa.table({
        "bucket": pa.array(out["bucket"], pa.int32()), "order": pa.array(out["order"], pa.int32()),
        "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary()),
        "total": pa.array(out["total"], pa.int64())})


def _kept(nodes: int, words: int):
    """Of stored counts, nodes of contexts and words seen at least so often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for order, k, c in zip(batch["order"].to_pylist(), batch["keys"].to_pylist(), batch["counts"].to_pylist()):
                k, c = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                if order == WORD:
                    out.append((WORD, k, c, c >= words))
                if order == ORDER:
                    out += [(n, *g, context_totals(*g) >= nodes)
                            for n, g in zip(range(NEAR, ORDER + 1), shorter(k, c, range(NEAR, ORDER + 1)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o for o, *_ in out], pa.int32()), pa.array([k[e].tobytes() for _, k, _, e in out], pa.binary()),
                 pa.array([c[e].tobytes() for *_, c, e in out], pa.binary())], ["order", "keys", "counts"])
    return run


def _levels(seen: np.ndarray) -> Iterator[tuple[int, int]]:
    """How many are at least 1, 2, 4, ..."""
    for k in range(40):
        n = int((seen >= 1 << k).sum())
        if not n:
            break
        yield k, n


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words, and nodes of long contexts, are seen at least 1, 2, 4, ... times."""
    for batch in batches:
        out = []
        for order, k, c in zip(batch["order"].to_pylist(), batch["keys"].to_pylist(), batch["counts"].to_pylist()):
            k, c = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
            if order == WORD:
                out += [(True, *x) for x in _levels(c)]
            if order == ORDER:
                for g in shorter(k, c, range(NEAR, ORDER + 1)):
                    out += [(False, *x) for x in _levels(context_totals(*g))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[n] for x in out], kind) for n, kind in enumerate((pa.bool_(), pa.int32(), pa.int64()))],
            ["word", "level", "many"])


class Lookup:
    """Open-addressed table from 64-bit keys to values, read and written many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, empty):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.used = np.zeros(size, bool)
        self.keys = np.zeros(size, np.uint64)
        self.values = np.full(size, empty, values.dtype)
        self.empty = empty
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = ~self.used[slot]
            self.keys[slot[free]] = keys[left[free]]  # of several for one place the last stays
            self.used[slot[free]] = True
            done = self.keys[slot] == keys[left]
            done &= self.used[slot]
            self.values[slot[done]] = values[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * octets.BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if not self.used[0] or len(miss):
            miss = np.flatnonzero((self.keys[slot] != keys) | ~self.used[slot])
        out[miss] = self.empty
        miss = miss[self.used[slot[miss]]]
        slot = slot[miss]
        while len(miss):
            slot = (slot + 1) & (len(self.keys) - 1)
            found = self.used[slot] & (self.keys[slot] == keys[miss])
            out[miss[found]] = self.values[slot[found]]
            more = self.used[slot] & ~found
            miss, slot = miss[more], slot[more]
        return out


@dataclass
class Trie:
    """Counts by order: ``grams[o]`` are (keys in order, counts) of a symbol and the o before it."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    words: tuple[np.ndarray, np.ndarray]
    held: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"grams": self.grams, "words": self.words, "held": {}}

    def contexts(self) -> list[tuple[np.ndarray, ...]]:
        """For each order: contexts in order, total, distinct, and what each excludes from the total of the next."""
        if "contexts" not in self.held:
            out = []
            for order, (keys, counts) in enumerate(self.grams):
                of = keys >> np.uint64(8)
                at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
                less = np.zeros(len(at), np.int64)
                if order and len(at):
                    shorter, their = self.grams[order - 1]
                    place = np.searchsorted(shorter, keys & low_bytes(order))
                    less = np.add.reduceat(their[place], at)
                total = np.add.reduceat(counts, at) if len(at) else less
                out.append((of[at], total, np.diff(np.r_[at, len(of)]), less))
            self.held["contexts"] = out
        return self.held["contexts"]

    def seen(self) -> Lookup:
        """log10 of the probability of each window that was seen whole."""
        if "seen" not in self.held:
            keys, counts = self.grams[ORDER]
            of, total, distinct, _ = self.contexts()[ORDER]
            at = np.searchsorted(of, keys >> np.uint64(8))
            value = np.log10(counts / np.maximum(total[at] + distinct[at], 1)) if len(keys) else np.zeros(0)
            self.held["seen"] = Lookup(keys, value, 1.0)
        return self.held["seen"]

    def known(self) -> Lookup:
        if "known" not in self.held:
            self.held["known"] = Lookup(*self.words, 0)
        return self.held["known"]

    def escape(self, window: np.ndarray) -> np.ndarray:
        """log10 of the probability of windows by the full rule."""
        out = np.zeros(len(window))
        left = np.arange(len(window))
        less, fewer = np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
        for order in range(ORDER, -1, -1):
            of, total, distinct, excludes = self.contexts()[order]
            keys, counts = self.grams[order]
            if not len(of):
                continue
            context = (window[left] >> np.uint64(8)) & low_bytes(order)
            at = np.minimum(np.searchsorted(of, context), len(of) - 1)
            here = of[at] == context
            who, at = left[here], at[here]
            key = window[who] & low_bytes(order + 1)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found = keys[place] == key
            mass, kinds = total[at] - less[who], distinct[at] - fewer[who]
            out[who[found]] += np.log10(counts[place[found]] / (mass + kinds)[found])
            lost = ~found & (mass + kinds > 0)
            out[who[lost]] += np.log10(kinds[lost] / (mass + kinds)[lost])
            less[who], fewer[who] = excludes[at], distinct[at]
            gone = np.zeros(len(window), bool)
            gone[who[found]] = True
            left = left[~gone[left]]
        out[left] -= np.log10(ALPHABET - fewer[left])
        return out

    def score(self, window: np.ndarray) -> np.ndarray:
        out, _ = self.score_here(window, whole=True)
        return out

    def score_here(self, window: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the windows whose context is not here (unless the trie is ``whole``); these score 0."""
        out = self.seen().get(window)
        new = np.flatnonzero(out == 1.0)
        far = new[:0]
        if not whole and len(new):
            of = self.contexts()[ORDER][0]
            context = window[new] >> np.uint64(8)
            at = np.minimum(np.searchsorted(of, context), max(len(of) - 1, 0))
            here = of[at] == context if len(of) else np.zeros(len(new), bool)
            new, far = new[here], new[~here]
        out[new] = self.escape(window[new])
        out[far] = 0.0
        return out, far


@dataclass
class Model:
    counts: DataFrame   # stored: bucket, order, keys, counts, total
    trie: object        # broadcast Trie
    low: object         # broadcast counts of the orders below NEAR, all of them
    whole: bool         # the trie has all counts
    buckets: int
    tokens: int
    distinct: int


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all of ``docs``."""
    spark = docs.sparkSession
    buckets = packed.bucket_count(spark)
    counts = store(
        docs.select(text_col).mapInArrow(_map_counts(buckets), "bucket int, order int, keys binary, counts binary")
        .groupBy("bucket").applyInArrow(_sum_counts, "bucket int, order int, keys binary, counts binary, total long"),
        "ppm-counts")
    told = counts.where(F.col("order") == WORD).agg(F.sum("total"), F.sum(F.length("keys") / 8)).first()
    sizes = counts.select("order", "keys", "counts").mapInArrow(_sizes, "word boolean, level int, many long").groupBy(
        "word", "level").agg(F.sum("many").alias("many")).collect()

    short = counts.where(F.col("order") == NEAR - 1).select("keys", "counts").collect()
    low = shorter(np.frombuffer(b"".join(bytes(r["keys"]) for r in short), np.uint64),
                  np.frombuffer(b"".join(bytes(r["counts"]) for r in short), np.int64), range(NEAR))
    nodes, words = Counter(), Counter()
    for r in sizes:
        (words if r.word else nodes)[r.level] += r.many
    for g in low:
        nodes.update(dict(_levels(context_totals(*g))))

    def least(levels: Counter, most: int) -> int:
        return 1 << next((k for k in range(64) if levels[k] <= most), 0)

    often = least(nodes, MOST_NODES)
    rows = counts.select("order", "keys", "counts").mapInArrow(
        _kept(often, least(words, MOST_WORDS)), "order int, keys binary, counts binary").collect()
    parts = []
    for keys, count in low:
        enough = context_totals(keys, count) >= often
        parts.append((keys[enough], count[enough]))
    for order in range(NEAR, WORD + 1):
        mine = [r for r in rows if r.order == order]
        keys = np.frombuffer(b"".join(bytes(r["keys"]) for r in mine), np.uint64)
        count = np.frombuffer(b"".join(bytes(r["counts"]) for r in mine), np.int64)
        parts.append(tally(keys, count))
    trie = Trie(parts[:WORD], parts[WORD])
    share = spark.sparkContext.broadcast
    return Model(counts, share(trie), share(low), often == 1, buckets, int(told[0] or 0), int(told[1] or 0))


def _map_scores(shared, whole: bool):
    names = ["__id", "__key", "n_tokens", "known", "logs", "rare", "score", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            columns = [[] for _ in range(6)]
            for _, _, data, offsets in octets.slices(batch["__text"], SLICE):
                window, ends = marked(data, offsets)
                score, far = trie.score_here(window, whole)
                hashes, row = word_hashes(data, offsets)
                rows = len(offsets) - 1
                hashes = np.concatenate((hashes, np.full(rows, END_WORD)))
                row = np.concatenate((row, np.arange(rows)))
                count = trie.known().get(hashes)
                columns[0].append(np.bincount(row, minlength=rows))
                columns[1].append(np.bincount(row, count > 0, minlength=rows).astype(np.int64))
                columns[2].append(np.bincount(row, np.log10(count + 1.0), minlength=rows))
                columns[3].append(np.bincount(row, count == 0, minlength=rows).astype(np.int64))
                columns[4].append(octets.run_sums(score, ends))
                columns[5].append(np.diff(np.searchsorted(far, ends)))
            if columns[0]:
                yield pa.RecordBatch.from_arrays(
                    [batch["__id"], batch["__key"], *(pa.array(np.concatenate(c)) for c in columns)], names)
    return run


def _map_rare(shared, whole: bool, buckets: int):
    """Words and windows that are not among those that travel, packed by hash range; their orders are negative."""
    names = ["bucket", "order", "keys", "counts", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            keys = batch["__key"].to_numpy()
            asked = {WORD: [], ORDER: []}
            for first, _, data, offsets in octets.slices(batch["__text"], SLICE):
                hashes, row = word_hashes(data, offsets)
                rare = trie.known().get(hashes) == 0
                asked[WORD].append((hashes[rare], keys[first + row[rare]]))
                if not whole:
                    window, ends = marked(data, offsets)
                    _, far = trie.score_here(window, whole)
                    asked[ORDER].append((window[far], keys[first + np.searchsorted(ends, far, side="right") - 1]))
            for order, parts in asked.items():
                if not parts:
                    continue
                what, docs = (np.concatenate(x) for x in zip(*parts))
                bucket, _ = packed.bucket_and_key(near(what) if order == ORDER else what, buckets)
                out = packed.pack(bucket, {"keys": what, "docs": docs})
                none = pa.nulls(out.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [out["bucket"], pa.array(np.full(out.num_rows, -order), pa.int32()), out["keys"], none, out["docs"]], names)
    return run


_SUMS = {"logs": np.float64, "known": np.int64, "rare": np.int64, "score": np.float64, "far": np.int64}


def _meet_rare(shared, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """The counts of one bucket's rare words and the scores of its windows, summed by document and packed by it."""
        def part(order: int, other: str, kind) -> tuple[np.ndarray, np.ndarray]:
            mine = table.filter(pa.compute.equal(table["order"], order))
            return packed.unpack(mine["keys"], np.uint64), packed.unpack(mine[other], kind)

        keys, counts = part(WORD, "counts", np.int64)
        words, docs = part(-WORD, "docs", np.int64)
        count = np.zeros(len(words), np.int64)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
            count = np.where(keys[place] == words, counts[place], 0)
        window, of = part(-ORDER, "docs", np.int64)
        window, place = np.unique(window, return_inverse=True)
        score = np.zeros(0)
        if len(window):
            grams = shorter(*part(ORDER, "counts", np.int64), range(NEAR, ORDER + 1))
            score = Trie([*shared.value, *grams], (window[:0], of[:0])).escape(window)[place]
        ask, far = len(docs), len(of)
        docs = np.concatenate((docs, of))
        values = {
            "logs": np.r_[np.log10(count + 1.0), np.zeros(far)], "known": np.r_[count > 0, np.zeros(far, bool)].astype(np.int64),
            "rare": np.repeat([1, 0], (ask, far)), "score": np.r_[np.zeros(ask), score], "far": np.repeat([0, 1], (ask, far))}
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
        ends = np.r_[at, len(docs)]
        # Fewer buckets than words have: each of theirs sends a row to each of these.
        bucket, _ = packed.bucket_and_key(docs[at].view(np.uint64), max(1, buckets // packed.BUCKETS_PER_PARTITION))
        return pa.Table.from_batches([packed.pack(bucket, {
            "docs": docs[at], **{n: octets.run_sums(v[order], ends) for n, v in values.items()}})])
    return run


def _sum_rare(table: pa.Table) -> pa.Table:
    docs = packed.unpack(table["docs"], np.int64)
    keys, where = np.unique(docs, return_inverse=True)
    sums = {f"all_{n}": np.bincount(where, packed.unpack(table[n], kind), minlength=len(keys)).astype(kind)
            for n, kind in _SUMS.items()}
    return pa.table({"__key": keys, **sums})


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10)."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(
        F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
    ).withColumn("__key", F.xxhash64("__id", "__text"))
    scored = texts.select("__id", "__key", "__text").mapInArrow(
        _map_scores(model.trie, model.whole),
        f"__id {kind}, __key long, n_tokens long, known long, logs double, rare long, score double, far long")
    rare = texts.select("__key", "__text").mapInArrow(
        _map_rare(model.trie, model.whole, model.buckets), "bucket int, order int, keys binary, counts binary, docs binary")
    held = model.counts.where(F.col("order").isin([WORD] if model.whole else [WORD, ORDER])).select(
        "bucket", "order", "keys", "counts", F.lit(None).cast("binary").alias("docs"))
    sums = (
        rare.union(held).groupBy("bucket")
        .applyInArrow(_meet_rare(model.low, model.buckets), packed.ddl(["docs", *_SUMS]))
        .groupBy("bucket").applyInArrow(_sum_rare, "__key long, all_logs double, all_known long, all_rare long, "
                                        "all_score double, all_far long"))

    def mine(total: str, one: str) -> Column:
        """Equal rows share a key, so their sums are those of all of them."""
        share = F.when(F.col(f"all_{one}") > 0, F.col(one) / F.col(f"all_{one}")).otherwise(0.0)
        return F.coalesce(F.col(total) * share, F.lit(0.0))

    each = F.log10(F.lit(float(model.tokens + model.distinct + 1)))
    return scored.join(sums, "__key", "left").select(
        F.col("__id").alias(id_col), "n_tokens",
        (F.col("known") + F.round(mine("all_known", "rare")).cast("long")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + mine("all_logs", "rare") - F.col("n_tokens") * each).alias("base_score"),
        (F.col("score") + mine("all_score", "far")).alias("score"))
