import hashlib

from pyspark.sql import functions as F

from clinspan.operators.ids import dense_id, first_row, number_in_order


def digest(column):
    return F.sha2(F.col(column).cast("string"), 256)


def test_ids_are_gap_free_and_follow_the_hash(spark):
    df = spark.range(3000).select(F.col("id").alias("k"))
    out = dense_id(df, digest("k"), "n", unique=True, digits=2).select("n", digest("k").alias("h")).orderBy("n").collect()
    assert [r.n for r in out] == list(range(1, 3001))
    assert [r.h for r in out] == sorted(r.h for r in out)


def test_copies_in_one_third_of_the_rows_are_spread_over_blocks(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"))
    out = dense_id(df, digest("k"), "n", block_rows=13, also={"even": F.col("k") % 2 == 0})
    rows = out.collect()
    assert sorted(r.n for r in rows) == list(range(1, 3001))
    assert len([r for r in rows if r.k == 0]) == 1000
    evens = [r.even for r in rows if r.k % 2 == 0]
    assert sorted(evens) == list(range(1, len(evens) + 1))
    assert all(r.even is None for r in rows if r.k % 2)


def test_numbering_restarts_per_class(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") < 30, "M").otherwise("F").alias("c"))
    rows = dense_id(df, digest("k"), "n", within="c", unique=True).collect()
    assert sorted(r.n for r in rows if r.c == "M") == list(range(1, 31))
    assert sorted(r.n for r in rows if r.c == "F") == list(range(1, 71))


def test_a_recomputed_plan_gives_the_same_ids(spark):
    df = spark.range(500).select(F.col("id").alias("k"))
    one = {r.k: r.n for r in dense_id(df.repartition(3), digest("k"), "n").collect()}
    two = {r.k: r.n for r in dense_id(df.repartition(7, "k"), digest("k"), "n").collect()}
    assert one == two


def test_first_row_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    first = first_row(df, ["k"], [F.col("v").desc()])
    assert {r.k: r.v for r in first.collect()} == {k: max(v for v in range(1000) if v % 7 == k) for k in range(7)}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_flagged_rows_are_numbered_in_order_across_buckets(spark):
    df = spark.range(100).select(F.lit("f").alias("file"), F.col("id").alias("row"))
    rows = number_in_order(df, "file", "row", F.col("row") % 3 == 0, "n", rows_per_bucket=10).orderBy("row").collect()
    assert [r.n for r in rows if r.n] == list(range(1, 35))
    assert all((r.n is not None) == (r.row % 3 == 0) for r in rows)


def test_ids_do_not_depend_on_how_the_work_is_cut(spark):
    rows = [("a", 1)] * 12 + [("b", 2)] * 3 + [(None, i % 7) for i in range(60)] + [("c", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v int")
    key = F.sha2("k", 256)
    seen = [sorted((r.k or "", r.v, r.n) for r in dense_id(df, key, "n", block_rows=b, digits=d).collect())
            for b, d in ((100, 4), (5, 4), (1, 1), (7, 2))]
    assert all(s == seen[0] for s in seen)
    assert sorted(n for _, _, n in seen[0]) == list(range(1, len(rows) + 1))
    order = [k for k, _, _ in sorted(seen[0], key=lambda r: r[2])]
    digest_of = {k: hashlib.sha256(k.encode()).hexdigest() if k else "" for k in "abc"} | {"": ""}
    assert [digest_of[k] for k in order] == sorted(digest_of[k] for k in order)


def test_rows_with_one_key_are_numbered_by_many_tasks(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    numbered = dense_id(df, F.sha2(F.col("k").cast("string"), 256), "n")
    assert numbered.agg(F.count_distinct("n").alias("c"), F.max("n").alias("m")).first() == (30000, 30000)
    text = numbered._jdf.queryExecution().executedPlan().toString()
    lanes = numbered.where("k IS NULL").select(F.shiftright(F.xxhash64("k", "v"), 56).alias("lane")).distinct().count()
    assert lanes > 200 and "_lane" in text


def test_generated_numbers_go_file_by_file_without_one_window(spark):
    df = spark.range(900).select((F.col("id") % 9).cast("string").alias("file"), F.expr("id div 9").alias("row"))
    out = number_in_order(df, "file", "row", F.col("row") % 2 == 0, "n", rows_per_bucket=10)
    rows = sorted(out.where("n IS NOT NULL").collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(1, len(rows) + 1))
    files = [r.file for r in rows]
    assert len(set(files)) == 9 and sum(a != b for a, b in zip(files, files[1:])) == 8
    assert all(a.row < b.row for a, b in zip(rows, rows[1:]) if a.file == b.file)


def test_rows_are_shuffled_once_and_only_as_they_are(spark):
    import re

    df = spark.range(5000).select((F.col("id") % 4000).alias("k"), F.lit("x").alias("v"))
    for unique in (True, False):
        numbered = dense_id(df, digest("k"), "n", unique=unique, digits=2)
        numbered.collect()
        final = numbered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        whole = [line for line in final.splitlines() if re.search(r"Exchange hashpartitioning\(.*REPARTITION", line)]
        assert len(whole) == 1 and "SortMergeJoin" not in final and "_lane" not in final
        ids = sorted(r.n for r in numbered.collect())
        assert ids == list(range(1, 5001))
