"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces of equal length are exchangeable, so the packing is computed on the number of pieces of each
length, of which there are at most the greatest permitted length: a table of proven size, whatever the
corpus. Lengths are taken in descending order. Pieces go to the open bins with the least room that
holds them, bins with equal contents together; when none holds them, bins of the permitted length open
that cost least for each token they can be expected to hold, given the tokens still to come. At last
each bin shrinks to the least permitted length that holds its contents.

Documents then get places: each piece has a rank among the pieces of its length, and the packing says
which bin, and where in it, each rank of a length goes. Ranks are sums over hash blocks of a length
plus running sums inside a block, so a length that a third of the documents share is spread over many
tasks. Texts are counted, never moved.

Defined cases: null and empty texts are one piece of 0 tokens, which shares a bin; a text longer than
the greatest permitted length is cut into pieces of that length and a rest, nothing is dropped; equal
rows are packed one by one; null ids are packed like others; without any document there are no rows;
other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinspan.llm.mixing import word_count
from clinspan.llm.stored import store

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 64          # cost of a bin, in tokens
ATTENTION = 65_536     # a bin of n tokens costs n * n / ATTENTION on top of n
BLOCKS = 64            # hash blocks of a length
COPIES = 4096          # equal rows that are ranked as one


@dataclass
class Packing:
    """``runs``: length, first rank, end rank, first bin, pieces in each bin, offset; ``bins``: first bin, capacity, used."""

    runs: np.ndarray
    bins: np.ndarray
    count: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bin, capacity, offset) of pieces."""
        order = np.lexsort((self.runs[:, 1], self.runs[:, 0]))
        runs = self.runs[order]
        top = int(runs[:, 2].max(initial=0)) + 1
        run = runs[np.searchsorted(runs[:, 0] * top + runs[:, 1], length * top + rank, side="right") - 1]
        inside = rank - run[:, 1]
        number = run[:, 3] + inside // run[:, 4]
        capacity = self.bins[np.searchsorted(self.bins[:, 0], number, side="right") - 1, 1]
        return number, capacity, run[:, 5] + inside % run[:, 4] * length


def cost(capacity: int, overhead: float, attention: float) -> float:
    return overhead + capacity + capacity * capacity / attention


def best_fit(counts: dict[int, int], lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD,
             attention: float = ATTENTION) -> Packing:
    """Pack ``counts[n]`` pieces of ``n`` tokens each, none longer than the greatest permitted length."""
    permitted = sorted(lengths)
    groups: list[tuple[int, int, int]] = []      # first bin, number of bins, tokens in each
    rooms: list[tuple[int, int]] = []            # room, group
    runs: list[tuple[int, ...]] = []
    opened = 0
    to_come = sum(n * c for n, c in counts.items())

    def keep(first: int, number: int, used: int, room: int) -> None:
        groups.append((first, number, used))
        insort(rooms, (room, len(groups) - 1))

    for n in sorted((n for n in counts if n > 0 and counts[n] > 0), reverse=True):
        left, rank = counts[n], 0
        to_come -= n * left
        while left:
            at = bisect_left(rooms, (n, -1))
            if at < len(rooms):
                room, group = rooms.pop(at)
                first, number, used = groups[group]
            else:
                def price(c: int) -> float:
                    bins = -(-left // (c // n))
                    return cost(c, overhead, attention) / min(c, (left * n + to_come) / bins)

                room = min((c for c in permitted if c >= n), key=lambda c: (price(c), c))
                first, number, used = opened, -(-left // (room // n)), 0
                opened += number
                groups.append((first, number, used))
            each = min(room // n, left)
            full = min(number, left // each)
            runs.append((n, rank, rank + full * each, first, each, used))
            keep(first, full, used + each * n, room - each * n)
            if full < number:
                keep(first + full, number - full, used, room)
            rank += full * each
            left -= full * each
    if counts.get(0):
        runs.append((0, 0, counts[0], 0, counts[0], 0))
        if not opened:
            keep(0, 1, 0, permitted[0])
            opened = 1
    final = sorted((groups[g][0], next(c for c in permitted if c >= groups[g][2]), groups[g][2]) for _, g in rooms)
    return Packing(np.array(runs, np.int64).reshape(-1, 6), np.array(final, np.int64).reshape(-1, 3), opened)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS,
         overhead: float = OVERHEAD, attention: float = ATTENTION) -> DataFrame:
    """One row per piece: id, ``piece``, ``start`` (in tokens of its text), ``n_tokens``, ``bin_id``, ``capacity``,
    ``bin_offset``. A token is a word."""
    most = max(lengths)
    items = docs.select(F.col(id_col).alias("id"), word_count(F.col(f"`{text_col}`")).alias("n")).groupBy("id", "n").agg(
        F.count("*").alias("copies"))
    items = items.select("id", "n", F.expr(
        f"explode(transform(sequence(0L, (copies - 1) div {COPIES}), "
        f"b -> named_struct('block', b, 'copies', least(copies - b * {COPIES}, {COPIES}L))))").alias("part"))
    items = items.select("id", "n", "part.block", "part.copies", F.expr(f"n div {most}").alias("whole"))
    rows = items.select("id", "n", "block", "copies", "whole", F.explode(F.array(
        F.struct(F.lit(most).cast("long").alias("length"), (F.col("copies") * F.col("whole")).alias("weight"),
                 F.lit(False).alias("rest")),
        F.struct((F.col("n") - F.col("whole") * most).alias("length"),
                 F.when((F.col("n") == 0) | (F.col("n") % most > 0), F.col("copies")).otherwise(0).alias("weight"),
                 F.lit(True).alias("rest")))).alias("kind"))
    rows = rows.select("id", "n", "block", "copies", "whole", "kind.*").where("weight > 0")
    rows = store(rows.withColumn("spot", F.xxhash64("id", "n", "block", "rest")), "pieces")
    rows = rows.withColumn("part", F.pmod("spot", F.lit(BLOCKS)))
    sizes = store(rows.groupBy("length", "part").agg(F.sum("weight").alias("weight")), "piece-counts")
    counts = {int(r.length): int(r.weight) for r in
              sizes.groupBy("length").agg(F.sum("weight").alias("weight")).collect()}
    packing = best_fit(counts, lengths, overhead, attention)
    before = sizes.select("length", "part", (F.sum("weight").over(
        Window.partitionBy("length").orderBy("part")) - F.col("weight")).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("spot", "id", "n", "block", "rest")
    ranked = rows.withColumn("upto", F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.join(before, ["length", "part"]).withColumn("first", F.col("before") + F.col("upto") - F.col("weight"))
    each = ranked.select("id", "length", "rest", "whole", "first", F.explode(F.expr("sequence(0L, weight - 1)")).alias("i"))
    pieces = each.select(
        "id", F.when(F.col("rest"), F.col("whole")).otherwise(F.expr("i % greatest(whole, 1L)")).alias("piece"),
        F.col("length").alias("n_tokens"), (F.col("first") + F.col("i")).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number, capacity, offset = packing.places(batch["n_tokens"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["piece"], pa.array(batch["piece"].to_numpy() * most), batch["n_tokens"],
                 pa.array(number), pa.array(capacity), pa.array(offset)],
                ["id", "piece", "start", "n_tokens", "bin_id", "capacity", "bin_offset"])

    return pieces.mapInArrow(
        run, f"id {kind}, piece long, start long, n_tokens long, bin_id long, capacity long, bin_offset long",
    ).withColumnRenamed("id", id_col)
