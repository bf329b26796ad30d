"""Session helpers: small constant tables and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def active() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    return spark


def sql_literal(value) -> str:
    """A Python value as Spark SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(sql_literal(v) for v in value) + ")"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def constant_table(columns: str, rows: Sequence[Sequence]) -> DataFrame:
    """A fixed small table as a plan-local relation, marked for broadcast.

    ``columns`` is a DDL list such as ``"code string, concept_id bigint"``. Only tables stated in
    ``clinspan.fixed`` (a few hundred rows at most) go through here.
    """
    parts = [c.strip().split(" ", 1) for c in columns.split(", ")]
    names = ", ".join(f"_{i}" for i in range(len(parts)))
    casts = ", ".join(f"CAST(_{i} AS {t}) AS {n}" for i, (n, t) in enumerate(parts))
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    table = active().sql(f"SELECT {casts} FROM VALUES {values} AS fixed_rows({names})")
    return F.broadcast(table)


_MADE: list[str] = []


def shared_dir(name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset: both are
    shared by the driver and all executors."""
    spark = active()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def exists(path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    spark = active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def complete(folder: str) -> bool:
    """Whether a write to the folder was committed."""
    return exists(f"{folder}/_SUCCESS")


def stored(name: str, df: DataFrame) -> DataFrame:
    """``df`` written once to a shared folder and read back, for what several results start from."""
    folder = shared_dir(name)
    df.write.parquet(folder)
    return active().read.schema(df.schema).parquet(folder)


def remove_shared_dirs() -> None:
    """Delete the folders this process made, once nothing reads them any more."""
    spark = active()
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
