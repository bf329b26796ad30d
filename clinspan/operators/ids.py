"""Gap-free ids and record positions without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspan.session import active, complete, exists, stored

HEX_DIGITS = 4
BLOCK_ROWS = 100_000


def _upto(*partition: str):
    return Window.partitionBy(*partition).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def dense_id(df: DataFrame, key_hash: Column, out: str, within: str | None = None,
             unique: bool = False, also: dict[str, Column] | None = None,
             digits: int = HEX_DIGITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``out`` = 1..N in the order of ``key_hash``, a hex digest of the record's key; records with one
    key go by a hash of the whole record.

    A digest spreads evenly, so its leading ``digits`` cut the table into 16^digits equal buckets. Rows
    are numbered inside their bucket and shifted by the number of rows in earlier buckets. Everything
    depends on row content only: a recomputed task numbers its rows the same way, and nothing has to be
    cached. ``digits`` and ``block_rows`` say how the work is cut, and never change an id.

    Bucket sizes are counted before anything is shuffled and travel to all tasks, so rows meet once, in a
    bucket of ``block_rows`` at most. A third of the rows may share a key, unless it is declared ``unique``,
    or be equal in everything: rows of larger buckets are numbered by :func:`_crowded`.

    ``within`` restarts the numbering per value of a low-cardinality column. ``also`` maps further id
    columns to a condition: the rows that meet it are numbered 1..M in the same pass.
    """
    columns = df.columns
    flags = {out: F.lit(True), **(also or {})}
    part = [*([within] if within else []), "_bucket"]
    keyed = df.withColumn("_hash", F.coalesce(key_hash, F.lit("")))
    keyed = keyed.withColumn("_bucket", F.coalesce(F.substring("_hash", 1, digits), F.lit("")))
    # one row per bucket, at most 16^digits
    sizes = keyed.groupBy(*part).agg(
        F.count("*").alias("_rows"), *[F.count_if(flag).alias(f"_size_{k}") for k, flag in flags.items()])
    running = _upto(*part[:-1]).orderBy("_bucket")
    offsets = sizes.select(*part, "_rows", *[
        (F.sum(f"_size_{k}").over(running) - F.col(f"_size_{k}")).alias(f"_offset_{k}") for k in flags])
    large = F.broadcast(offsets.where(F.col("_rows") > block_rows))
    even = df if unique else keyed.join(large.select(*part), part, "left_anti").select(*columns)
    # what the order needs besides is computed after the shuffle, which carries the rows only
    bucket = F.coalesce(F.substring(F.coalesce(key_hash, F.lit("")), 1, digits), F.lit(""))
    even = even.repartition(*part[:-1], bucket).withColumns({
        "_bucket": bucket, "_hash": F.coalesce(key_hash, F.lit("")),
        "_row": F.lit(0) if unique else F.xxhash64(*[F.col(f"`{c}`") for c in columns])})
    inside = _upto(*part).orderBy("_hash", "_row")
    even = even.withColumns({f"_place_{k}": F.count_if(flag).over(inside) for k, flag in flags.items()})
    numbered = even.join(F.broadcast(offsets.drop("_rows")), part).select(*columns, *[
        F.when(flag, (F.col(f"_offset_{k}") + F.col(f"_place_{k}")).cast("bigint")).alias(k) for k, flag in flags.items()])
    return numbered if unique else numbered.unionByName(_crowded(keyed.join(large, part), columns, flags, part, block_rows))


def _crowded(keyed: DataFrame, columns: list[str], flags: dict[str, Column], part: list[str], block_rows: int) -> DataFrame:
    """Rows of large buckets with their ids, however many of them have one key or are equal.

    Equal rows are collapsed to one with a count (combined before the shuffle). Rows with one key are cut
    into lanes by the leading bits of the record hash: only the sizes of (key, lane), one slim row each,
    are summed within a bucket, and rows are numbered inside their lane. Equal rows are expanded at the
    end, more than ``block_rows`` of them in blocks dealt out anew.
    """
    rows = keyed.groupBy(*keyed.columns).agg(F.count("*").alias("_copies"))
    rows = rows.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in columns])).withColumn(
        "_lane", F.shiftright("_row", 56))
    counted = {name: F.when(flag, F.col("_copies")).otherwise(0) for name, flag in flags.items()}
    lane = [*part, "_hash", "_lane"]
    sizes = rows.groupBy(*lane).agg(*[F.sum(n).alias(f"_size_{k}") for k, n in counted.items()])
    along = _upto(*part).orderBy("_hash", "_lane")
    before = sizes.select(*lane, *[
        (F.sum(f"_size_{k}").over(along) - F.col(f"_size_{k}")).alias(f"_before_{k}") for k in flags])
    inside = _upto(*lane).orderBy("_hash", "_row")
    placed = rows.withColumns({f"_place_{k}": F.sum(n).over(inside) - n for k, n in counted.items()}).join(before, lane)
    firsts = placed.select(*columns, "_copies", *[
        (F.col(f"_offset_{k}") + F.col(f"_before_{k}") + F.col(f"_place_{k}") + 1).cast("bigint").alias(f"_first_{k}") for k in flags])

    def expanded(some: DataFrame, low: Column, number: Column) -> DataFrame:
        each = some.select("*", F.explode(F.sequence(low, low + number - 1)).alias("_copy"))
        return each.select(*columns, *[F.when(flags[k], F.col(f"_first_{k}") + F.col("_copy")).alias(k) for k in flags])

    few = firsts.where(F.col("_copies") <= block_rows)
    many = firsts.where(F.col("_copies") > block_rows).select(
        "*", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {block_rows})")).alias("_block"))
    many = many.repartition(F.xxhash64(f"_first_{next(iter(flags))}", "_block"))
    low = F.col("_block") * block_rows
    return expanded(few, F.lit(0).cast("bigint"), F.col("_copies")).unionByName(
        expanded(many, low, F.least(F.lit(block_rows), F.col("_copies") - low)))


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key. Spark keeps one row per key and task before it shuffles."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def number_in_order(df: DataFrame, group: str, position: str, flag: Column, out: str,
                    rows_per_bucket: int = 100_000) -> DataFrame:
    """Number the flagged rows 1..N by (group, position), groups in the order of the hash of their name;
    other rows get NULL.

    Rows are cut into buckets of consecutive positions and numbered inside. A bucket is shifted by the
    flagged rows of its group's earlier buckets, those of earlier groups with the same leading hash digits,
    and those of earlier leading digits (16^3 rows at most): no window holds all groups. Bucket sizes are
    counted once and stored; only flagged rows are shuffled, the others stay where they are.
    """
    flag = F.coalesce(flag, F.lit(False))
    name = F.sha2(F.coalesce(F.col(group).cast("string"), F.lit("")), 256)
    bucketed = df.where(flag).withColumns({"_bucket": F.floor(F.col(position) / rows_per_bucket), "_name": name})
    sizes = stored("bucket-sizes", bucketed.groupBy("_name", "_bucket").agg(F.count("*").alias("_size")))

    def earlier(window) -> Column:
        window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.sum("_size").over(window) - F.col("_size")

    in_group = sizes.withColumn("_in_group", earlier(Window.partitionBy("_name").orderBy("_bucket")))
    digits = F.substring("_name", 1, 3)
    groups = sizes.groupBy("_name").agg(F.sum("_size").alias("_size")).withColumn("_digits", digits)
    in_digits = groups.withColumn("_in_digits", earlier(Window.partitionBy("_digits").orderBy("_name")))
    tops = groups.groupBy("_digits").agg(F.sum("_size").alias("_size"))
    in_all = tops.withColumn("_in_all", earlier(Window.orderBy("_digits")))
    offsets = (in_group.drop("_size").join(in_digits.drop("_size"), "_name").join(in_all.drop("_size"), "_digits")
               .select("_name", "_bucket", (F.col("_in_group") + F.col("_in_digits") + F.col("_in_all")).alias("_offset")))
    inside = Window.partitionBy("_name", "_bucket").orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # a position may be null, and so its bucket
    placed = bucketed.withColumn("_place", F.count("*").over(inside)).join(
        offsets.withColumnsRenamed({"_name": "_its_name", "_bucket": "_its_bucket"}),
        (F.col("_name") == F.col("_its_name")) & F.col("_bucket").eqNullSafe(F.col("_its_bucket")))
    numbered = placed.select(*df.columns, (F.col("_offset") + F.col("_place")).alias(out))
    return numbered.unionByName(df.where(~flag).withColumn(out, F.lit(None).cast("bigint")))


def _batches(path: str) -> list[str]:
    """Folders of the committed batches of an id map."""
    spark = active()
    if not exists(path):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = sorted(f.getPath().getName() for f in found)
    return [f"{path}/{n}" for n in names if n.startswith("batch-") and complete(f"{path}/{n}")]


def remembered_ids(rows: DataFrame, key: str, path: str, out: str, key_hash: Column | None = None) -> DataFrame:
    """The map (``key``, ``out``) of all keys met so far, stored at ``path``; keys of ``rows`` that are new get the next ids.

    Ids never change: new keys are those an anti-join with the map leaves, numbered in the order of their hash from its
    last id on, and written as a further batch. A batch counts once it is committed, so a run that failed or is
    repeated leaves no gap and numbers no key twice. One run at a time may write a map. Null keys get no id.
    """
    spark = active()
    batches = _batches(path)
    known = spark.read.parquet(*batches) if batches else None
    new = rows.select(key).where(F.col(f"`{key}`").isNotNull()).distinct()
    last = 0
    if known is not None:
        new, last = new.join(known, key, "left_anti"), known.agg(F.max(out)).first()[0] or 0
    digest = F.sha2(F.col(key).cast("string"), 256) if key_hash is None else key_hash
    numbered = dense_id(new, digest, out, unique=True).withColumn(out, F.col(out) + last)
    folder = f"{path}/batch-{len(batches):06d}"
    numbered.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(*batches, folder)
