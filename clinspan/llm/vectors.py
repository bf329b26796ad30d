"""Near-duplicate vectors by cross-polytope hashing, with several probes and exact verification.

Vectors are compared only within a label. Equal vectors of a label form one class with a weight. A
class's unit vector is rotated at random (three rounds of sign flips and a fast Hadamard transform);
its cross-polytope hash is the axis it lies closest to, with sign. ``HASHES`` of them make the code of
one of ``TABLES`` tables, and the next closest axes give ``PROBES`` further codes to look up. Classes
meet where the code of one is a code or probe of the other. A bucket is compared as matrix products
inside one task; a bucket above ``PIECE`` rows is dealt out as pairs of pieces. Only cosines of at
least ``LEAST`` in double precision link.

A task returns a number of linked vectors and one link into a forest for each class, never pairs: a
pair that meets in several tables or buckets is counted where it meets first, which every task can tell
from the codes that travel with the class.

Defined cases: a null label, null or empty vector, null, NaN or infinite component, or zero vector
links with nothing, and its row is its own component; vectors of different length never link; equal
rows are linked vectors; a null id is no least id unless all ids of its component are null, and its
row is not kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspan.llm.components import components
from clinspan.llm.stored import store

LEAST = 0.93
TABLES, HASHES, PROBES = 5, 2, 3
PIECE = 2048
SEED = 20240607
BUCKETS_PER_PARTITION = 4


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (a power of two wide) after sign flips and Hadamard transforms in turn."""
    for flip in signs:
        x = x * flip
        step = 1
        while step < x.shape[1]:
            x = x.reshape(len(x), -1, 2, step)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), -1)
            step *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def codes(rows_of_unit: np.ndarray) -> np.ndarray:
    """(rows, tables, 1 + probes): a row's own code in each table, then its probes, nearest first."""
    rows, width = rows_of_unit.shape
    size = 1 << max(1, (width - 1).bit_length())
    padded = np.zeros((rows, size))
    padded[:, :width] = rows_of_unit
    random = np.random.default_rng([SEED, size])
    out = np.empty((rows, TABLES, 1 + PROBES), np.int32)
    for table in range(TABLES):
        best, loss = [], []
        for _ in range(HASHES):
            y = rotate(padded, random.choice((-1.0, 1.0), (3, size)))
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
            if top.shape[1] < 3:
                top = np.pad(top, ((0, 0), (0, 3 - top.shape[1])), mode="edge")
            value = np.take_along_axis(y, top, 1)
            best.append(top * 2 + (value < 0))
            loss.append(np.abs(value[:, :1]) - np.abs(value))
        choices, costs = [], []
        for alternative in range(3 ** HASHES):
            code, cost = np.zeros(rows, np.int64), np.zeros(rows)
            for h in range(HASHES):
                k = alternative // 3 ** h % 3
                code = code * (2 * size) + best[h][:, k]
                cost = cost + loss[h][:, k] ** 2
            choices.append(code)
            costs.append(cost)
        choices, costs = np.stack(choices, 1), np.stack(costs, 1)
        costs[:, 0] = -1.0
        order = np.argsort(costs, axis=1, kind="stable")[:, :1 + PROBES]
        out[:, table] = np.take_along_axis(choices, order, 1)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow or underflow on the way."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _map_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["dim", "table", "code", "base", "class", "weight", "label", "vector", "codes"]
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            lists = part["vector"]
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            for width in np.unique(size).tolist():
                rows = np.flatnonzero(size == width)
                x = flat[begin[rows][:, None] + np.arange(width)]
                found = codes(unit(x))
                many = TABLES * (1 + PROBES)
                which = pa.array(np.repeat(rows, many))
                vectors = pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), many)))
                told = pa.array([c.tobytes() for c in found], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), many)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows) * many, width), pa.int32()),
                    pa.array(np.tile(np.repeat(np.arange(TABLES), 1 + PROBES), len(rows)), pa.int32()),
                    pa.array(found.reshape(-1).astype(np.int64)),
                    pa.array(np.tile(np.arange(1 + PROBES) == 0, len(rows) * TABLES)),
                    part["class"].take(which), part["weight"].take(which), part["label"].take(which), vectors, told], names)


def _meet(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For code arrays of pairs, by table: equal codes; x probes y's code; y probes x's code."""
    return (x[:, :, 0] == y[:, :, 0], (x[:, :, 1:] == y[:, :, :1]).any(2), (y[:, :, 1:] == x[:, :, :1]).any(2))


def _link_buckets(table: pa.Table) -> pa.Table:
    """For each class of the buckets: the linked vectors counted here, and a link into the bucket's forest."""
    cols = ["dim", "label", "table", "code", "cell_a", "cell_b"]
    table = table.combine_chunks()
    key = [table[c].to_numpy() for c in cols]
    order = np.lexsort(key[::-1])
    key = [k[order] for k in key]
    name, weight, base, piece, at = (table[c].to_numpy(zero_copy_only=False)[order] for c in ("class", "weight", "base", "piece", "table"))
    new = np.zeros(len(order), bool)
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    edge = np.flatnonzero(new).tolist()
    dims = key[0]
    vectors, told = table["vector"].to_pylist(), table["codes"].to_pylist()
    out_name, out_count, out_root = [], [], []
    for a, z in zip([0, *edge] if len(order) else [], [*edge, len(order)]):
        mine = base[a:z]
        if z - a < 2 or not mine.any():
            continue
        rows = order[a:z].tolist()
        x = np.frombuffer(b"".join([vectors[r] for r in rows]), f"f{len(vectors[rows[0]]) // int(dims[a])}")
        x = unit(x.reshape(z - a, -1))
        near = np.argwhere(x[mine] @ x.T >= LEAST)
        owner = np.flatnonzero(mine)
        i, j = owner[near[:, 0]], near[:, 1]
        n, p = name[a:z], piece[a:z]
        keep = n[i] != n[j]
        keep &= ~mine[j] | (i < j)
        low, high = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
        keep &= (low == key[4][a]) & (high == key[5][a])
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        shape = (-1, TABLES, 1 + PROBES)
        ends = np.unique(np.r_[i, j])
        spread = np.frombuffer(b"".join([told[rows[e]] for e in ends.tolist()]), np.int32).reshape(shape)
        same, probes, probed = _meet(spread[np.searchsorted(ends, j)], spread[np.searchsorted(ends, i)])
        t = int(at[a])
        any_way = same | probes | probed  # x is the row j, y the base row i
        first = ~any_way[:, :t].any(1)
        here = mine[j] | ~(probed[:, t] & (n[j] < n[i]))  # both ways: counted where the base is the lesser
        first &= here
        count = np.zeros(z - a, np.int64)
        np.add.at(count, i[first], weight[a:z][j[first]])
        np.add.at(count, j[first], weight[a:z][i[first]])
        up: dict[int, int] = {}

        def root(v: int) -> int:
            while (w := up.get(v, v)) != v:
                up[v] = up.get(w, w)
                v = w
            return v

        for u, v in zip(n[i].tolist(), n[j].tolist()):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
        out_name += n[ends].tolist()
        out_count += count[ends].tolist()
        out_root += [root(v) for v in n[ends].tolist()]
    return pa.table({"class": pa.array(out_name, pa.int64()), "linked": pa.array(out_count, pa.int64()),
                     "root": pa.array(out_root, pa.int64())})


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (the least id reachable) and ``kept``."""
    spark = table.sparkSession
    element = table.schema[vector_col].dataType.elementType.simpleString()
    held = "array<float>" if element == "float" else "array<double>"
    rows = table.select(
        F.col(id_col).alias("__id"), F.col(vector_col).cast(held).alias("vector"), F.col(label_col).alias("label"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("class", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("label", "vector")))
    rows = rows.select("__id", "label", "vector", "class")
    classes = rows.where("class is not null").groupBy("class").agg(
        F.min("__id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"),
        F.first("vector").alias("vector"))
    dealt = classes.select("class", "weight", F.xxhash64("label").alias("label"), "vector").mapInArrow(
        _map_codes, "dim int, table int, code long, base boolean, class long, weight long, label long, vector binary, codes binary")
    keys = ["dim", "label", "table", "code"]
    large = dealt.groupBy(*keys).agg(F.count("*").alias("many"), F.max("base").alias("any")).where(
        (F.col("many") > PIECE) & F.col("any")).select(*keys, F.ceil(F.col("many") / PIECE).cast("int").alias("pieces"))
    dealt = dealt.join(large, keys, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("class"), F.col("pieces")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.withColumns({
        "cell_a": F.least("piece", "other"), "cell_b": F.greatest("piece", "other")})
    groups = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = (
        dealt.withColumn("bucket", F.pmod(F.xxhash64(*keys, "cell_a", "cell_b"), F.lit(groups)))
        .select("bucket", *keys, "cell_a", "cell_b", "piece", "base", "class", "weight", "vector", "codes")
        .groupBy("bucket").applyInArrow(_link_buckets, "class long, linked long, root long")
        .groupBy("class", "root").agg(F.sum("linked").alias("linked")))
    links = store(links, "vector-links")
    roots = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("class").agg(F.sum("linked").alias("linked"))
    named = (
        classes.select("class", "least", "weight").join(counts, "class", "left")
        .join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    told = named.join(least, "root").select(
        "class", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    whole = rows.select("__id", "class").join(told, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("__id")).otherwise(F.col("component_id"))
    return whole.select(
        F.col("__id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(False)).alias("kept"))
