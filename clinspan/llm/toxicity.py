"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

Fitting reads the whole texts of a bounded sample of labels. A string's evidence for a class is the likelihood
ratio of the number of different words it follows in each class, so a passage that is only copied
counts once. The toxic dictionary holds the words with evidence for the toxic class, the ordinary one
those with evidence for the other; both end in the same words that are common in ordinary text, at the
same distances, so a window without evidence compresses to the same length under both. (zstandard's own
trainer keeps what is frequent, which the classes share: on the check tables it ranked a toxic document
above an ordinary one in 70 of 100 cases, contents chosen by contrast in more than 99.)

Each window is compressed by two match finders. Its gap is its compressed length under the ordinary dictionary less that under the toxic one. A
text is described by its largest gap and how many and what part of its windows reach each of a few
gaps; a logistic function, fitted on the sample, turns that into a score from 0 to 1.

Defined cases: null and empty texts have one window of a space and get the score of such a text; labels
of 1 are toxic and of 0 ordinary, null labels and null texts are not learned from; without labels of
both classes every score is the share of toxic labels (0 if there are none); texts of any length are
read whole; repeated rows get equal scores; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clinspan.llm import octets, packed
from clinspan.llm.stored import discard, store

TOXIC_SAMPLE, ORDINARY_SAMPLE = 2500, 5000  # labelled texts read for fitting at most, those of least hash
MOST_STRINGS = 20_000     # of each class that the driver chooses among; a dictionary holds some hundreds
LEAST_CONTEXTS = 4        # different words a string with evidence follows
LEAST_EVIDENCE = 25.0     # likelihood ratio statistic
LEAST_RATIO = 5.0         # of its rates in the two classes
START = (6, 7, 8)         # bytes of a word start, with the space before it
WHOLE = 0.8               # part of a start's evidence that makes one word stand for it
EVIDENCE_BYTES = 6000     # of a dictionary
COMMON_WORDS = 600
WINDOW, STEP = 256, 232
GAPS = (1, 2, 3, 4, 6)
MOST_GAP, MOST_TOTAL = 12, 40
#: Match finders, least match and step of the two compressions of a window.
FINDERS = ((zstandard.STRATEGY_FAST, 5, 1), (zstandard.STRATEGY_GREEDY, 6, 0))
GLUE = b"\x02"  # stands in no plain text
#: Starts every window and ends both dictionaries, so that no window pays for its first match.
CARRIER = bytes(range(3, 32)) + bytes(range(31, 2, -1))
REJECT = 0.7
#: Lower-cased letters and all bytes of other scripts; the rest is space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weight: tuple[float, ...] = ()
    base: float = 0.0


def plain(text: bytes) -> bytes:
    return b" " + text.translate(_PLAIN) + b" "


def _strings(data: bytes, base: int, size: int | None) -> tuple[np.ndarray, ...]:
    """Of whole words, or starts of ``size`` bytes: hash of string and word before, hash, where it stands."""
    octet = np.frombuffer(data, np.uint8)
    starts, stops, _ = octets.words(octet, np.array([0, len(octet)]))
    prefix = octets.prefix_hash(octet)
    word = octets.range_hash(prefix, starts, stops)
    before = np.concatenate((np.zeros(min(1, len(word)), np.uint64), word[:-1]))
    low, high = starts - 1, stops + 1 if size is None else starts - 1 + size
    fits = slice(None) if size is None else high < stops + 1
    name = octets.range_hash(prefix, low[fits], high[fits])
    return octets.mix(name * octets.BASE ^ before[fits]), name, low[fits] + base, high[fits] + base


def _map_pairs(buckets: int):
    """Strings of (label, text) with the word before each, once a batch: whole words with the spaces around them, and the
    starts of longer ones. Packed by string, so that all its pairs meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, held = batch.column(0).to_numpy(), []
            for at, to, data, offsets in octets.slices(batch.column(1)):
                whole, ends = data.tobytes(), offsets.tolist()
                for row, a, z in zip(range(at, to), ends[:-1], ends[1:]):
                    text = plain(whole[a:z])
                    for kind in (None, *START):
                        pair, name, _, _ = _strings(text, 0, kind)
                        _, first = np.unique(pair, return_index=True)
                        held.append((pair[first], name[first], np.full(len(first), 2 * (kind is None) + labels[row], np.uint8)))
            if not held:
                continue
            pair, name, kind = (np.concatenate(x) for x in zip(*held))
            _, first = np.unique(np.stack((pair, kind.astype(np.uint64)), 1), axis=0, return_index=True)
            pair, name, kind = pair[first], name[first], kind[first]
            bucket, _ = packed.bucket_and_key(name, buckets)
            yield packed.pack(bucket, {"pair": pair, "name": name, "kind": kind})
    return run


def _count_pairs(table: pa.Table) -> pa.Table:
    """For each string of a bucket that follows enough different words in a class, how many it follows in each; and, with
    no string, the sums over whole words of the bucket."""
    pair, name, kind = (packed.unpack(table[n], k) for n, k in (("pair", np.uint64), ("name", np.uint64), ("kind", np.uint8)))
    _, first = np.unique(np.stack((pair, kind.astype(np.uint64)), 1), axis=0, return_index=True)
    name, kind = name[first], kind[first]
    keys, place = np.unique(name, return_inverse=True)
    toxic, ordinary = (np.bincount(place[kind & 1 == k], minlength=len(keys)) for k in (1, 0))
    often = np.maximum(toxic, ordinary) >= LEAST_CONTEXTS
    return pa.table({
        "name": pa.array([*keys[often].view(np.int64).tolist(), None], pa.int64()),
        "toxic": pa.array([*toxic[often].tolist(), int((kind == 3).sum())], pa.int64()),
        "ordinary": pa.array([*ordinary[often].tolist(), int((kind == 2).sum())], pa.int64())})


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    def part(x: Column, share: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / n / share)).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def evidence(sample: DataFrame) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Of stored (label, text), the strings that follow many more words in toxic texts with their evidence, and those that
    do so in ordinary ones; the ``MOST_STRINGS`` strongest each."""
    spark = sample.sparkSession
    counts = store(
        sample.select("label", "text").mapInArrow(_map_pairs(packed.bucket_count(spark)), packed.ddl(["pair", "name", "kind"]))
        .groupBy("bucket").applyInArrow(_count_pairs, "name long, toxic long, ordinary long"), "toxic-counts")
    words = counts.where("name IS NULL").agg(F.sum("toxic"), F.sum("ordinary")).first()
    sides: list[dict[int, float]] = []
    for mine, other, m, o in (("toxic", "ordinary", *words), ("ordinary", "toxic", *words[::-1])):
        if not m or not o:
            return {}, {}
        k, j, m, o = F.col(mine), F.col(other), F.lit(float(m)), F.lit(float(o))
        p = (k + j) / (m + o)
        value = 2 * (_likelihood(k, m, p) + _likelihood(j, o, p))
        good = counts.where(F.col("name").isNotNull() & (k >= LEAST_CONTEXTS) & (k / m >= LEAST_RATIO * (j + 1) / o))
        rows = good.select("name", value.alias("value")).where(F.col("value") > LEAST_EVIDENCE)
        # few tasks hold them: the counts of a sample of bounded size
        sides.append({r.name: r.value for r in rows.orderBy(F.desc("value"), "name").limit(MOST_STRINGS).collect()})
    discard(counts)
    wanted = np.array(sorted({*sides[0], *sides[1]}), np.int64)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, bytes] = {}
        for batch in batches:
            for _, _, data, offsets in octets.slices(batch.column(0)):
                whole, ends = data.tobytes(), offsets.tolist()
                for a, z in zip(ends[:-1], ends[1:]):
                    text = plain(whole[a:z])
                    for kind in (None, *START):
                        _, name, low, high = _strings(text, 0, kind)
                        for i in np.flatnonzero(np.isin(name.view(np.int64), wanted)).tolist():
                            found.setdefault(int(name[i].view(np.int64)), text[low[i]:high[i]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["name", "string"])

    spelling = {r["name"]: bytes(r["string"]) for r in sample.select("text").mapInArrow(
        spelled, "name long, string binary").groupBy("name").agg(F.min("string").alias("string")).collect()}
    return tuple({spelling[n]: v for n, v in side.items()} for side in sides)


def choose(found: dict[bytes, float]) -> list[bytes]:
    """Strings for a dictionary, strongest first.

    Of strings that begin alike the strongest stands for all; it is a whole word if one word has nearly
    all of its evidence, as longer matches tell more, and else the common start of many words.
    """
    taken, covered, chosen = set(), set(), []
    for string in sorted(found, key=lambda x: (-found[x], len(x), x)):
        starts = [string[:n] for n in range(START[0], len(string) + 1)]
        if len(string) < START[0] or any(x in taken for x in starts) or string in covered:
            continue
        taken.add(string)
        covered.update(starts)
        chosen.append(string)
    words = sorted((x for x in found if x.endswith(b" ")), key=lambda x: (-found[x], x))
    return [next((w for w in words if w.startswith(x) and found[w] >= WHOLE * found[x]), x) for x in chosen]


def _map_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a task each longer word is."""
    seen: Counter = Counter()
    for batch in batches:
        for _, _, data, offsets in octets.slices(batch.column(0)):
            whole, ends = data.tobytes(), offsets.tolist()
            for a, z in zip(ends[:-1], ends[1:]):
                seen.update({w for w in plain(whole[a:z]).split() if len(w) > 4})
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "texts"])


def dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, of equal length and with the same end.

    Long strings lose the space behind them, so that a match leaves the next word's start to match.
    """
    sides = []
    for found in evidence(sample):
        held, size = [], 0
        for string in choose(found):
            string = string if len(string) < 7 else string.rstrip()
            size += len(string) + 1
            if size > EVIDENCE_BYTES:
                break
            held.append(string + GLUE)
        sides.append(b"".join(reversed(held)))
    common = (
        sample.where("label = 0").select("text").mapInArrow(_map_words, "word binary, texts long").groupBy("word")
        .agg(F.sum("texts").alias("texts")).orderBy(F.desc("texts"), "word").limit(COMMON_WORDS).collect())
    end = b"".join(b" " + bytes(r["word"]) + GLUE for r in reversed(common)) + CARRIER
    size = max(8, *map(len, sides))
    return tuple(GLUE * (size - len(side)) + side + end for side in sides)


def _compressors(content: bytes):
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    for strategy, least, target in FINDERS:
        settings = zstandard.ZstdCompressionParameters(
            window_log=15, hash_log=14, chain_log=13, search_log=4, min_match=least, target_length=target,
            strategy=strategy, write_content_size=False, write_checksum=False, write_dict_id=False)
        yield zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress


def describe(texts: list[bytes], model: Model) -> np.ndarray:
    """A row of figures for each plain text."""
    windows, ends = [], [0]
    for text in texts:
        windows += [CARRIER + text[at:at + WINDOW] for at in range(0, max(len(text) - WINDOW + STEP, 1), STEP)]
        ends.append(len(windows))
    ends = np.array(ends)
    many = np.maximum(np.diff(ends), 1)
    columns = [np.log(many)]
    for ordinary, toxic in zip(_compressors(model.ordinary), _compressors(model.toxic)):
        gaps = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], np.int64)
        total = octets.run_sums(gaps, ends)
        columns += [np.minimum(np.maximum.reduceat(gaps, ends[:-1]), MOST_GAP) if len(texts) else total,
                    np.minimum(total, MOST_TOTAL), total / many]
        for gap in GAPS:
            count = octets.run_sums((gaps >= gap).astype(np.int64), ends)
            columns += [np.log1p(count), count / many]
    return np.stack(columns, axis=1).astype(float)


def score(texts: list[bytes], model: Model) -> np.ndarray:
    if not model.weight:
        return np.full(len(texts), model.base)
    x = (describe(texts, model) - np.array(model.mean)) / np.array(model.scale)
    total = (x * np.array(model.weight[:-1])).sum(1)  # row by row, so that equal texts get equal bits in any batch
    return 1 / (1 + np.exp(-np.clip(total + model.weight[-1], -50, 50)))


def fit_figures(x: np.ndarray, y: np.ndarray, model: Model) -> Model:
    """The logistic function of texts' figures, whose classes are ``y``."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    ridge = 1e-2 * np.eye(z.shape[1])
    weight = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ weight, -30, 30)))
        weight = weight + np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (y - p) - ridge @ weight)
    return Model(model.toxic, model.ordinary, tuple(mean), tuple(scale), tuple(weight))


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, text): the whole texts of the labels of least hash of the id. The ids are chosen among the labels alone, so
    only that bounded list meets the texts. Copies weigh as often as they are labelled."""
    chosen = None
    for label, most in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE)):
        some = labels.where((F.col(label_col) == label) & F.col(id_col).isNotNull()).select(
            F.col(id_col).alias("__id"), F.lit(label).alias("label")).distinct().orderBy(
            F.xxhash64("__id"), "__id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where("text is not null")
    found = rows.join(F.broadcast(chosen), "__id")
    return found.repartition(docs.sparkSession.sparkContext.defaultParallelism, "__id").select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the whole texts of at most ``TOXIC_SAMPLE`` and ``ORDINARY_SAMPLE`` labels.

    Strings are counted and windows compressed where the texts lie; counts and figures come to the driver, no texts.
    """
    sample = store(sample_of(docs, labels, id_col, text_col, label_col), "toxic-sample")
    present = {r.label for r in sample.select("label").distinct().collect()}
    if len(present) < 2:
        discard(sample)
        return Model(b"", b"", base=float(1 in present))
    model = Model(*dictionaries(sample))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in octets.slices(batch.column(1)):
                whole, ends = data.tobytes(), offsets.tolist()
                found += describe([plain(whole[a:z]) for a, z in zip(ends[:-1], ends[1:])], model).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["label", "figures"])

    rows = sample.select("label", "text").mapInArrow(figures, "label int, figures array<double>").collect()
    rows = sorted((r["label"], r["figures"]) for r in rows)  # sums do not depend on the order of tasks
    discard(sample)
    return fit_figures(np.array([f for _, f in rows]), np.array([float(y) for y, _ in rows]), model)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``, the score of each whole text; a column of that name is replaced."""
    rest = [c for c in docs.columns if c != into]
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in octets.slices(batch.column(at)):
                whole, ends = data.tobytes(), offsets.tolist()
                found.append(score([plain(whole[a:z]) for a, z in zip(ends[:-1], ends[1:])], model))
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*rest, into])

    kept = docs.select(*[F.col(f"`{c}`") for c in rest])
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(into, DoubleType())]))
