"""Reading patient/encounter CSV files.

The dialect is the usual one: a quote opens a quoted value only as its first character, two quotes inside one are a
quote, what follows a closing quote is taken as it stands, and a quote elsewhere is a character like others.

Files are read as lines, so a file of any size is split among tasks. Whether a line starts a record depends on all lines
before it, but only through one bit: is a quoted value open? So every line is a function of that bit: it keeps it, turns
it, or sets it. The functions of a split are composed for both values of the bit, and chained over the splits of a
file; no task sees a whole file. A line that holds a whole record stays where it is, only the lines of records with
quoted line breaks meet. Each file is read by its own header, and is accepted or rejected by itself.

A value may have 131,072 characters; a longer one rejects its file, and so does a record over ``MOST_RECORD``, which holds
one unless it has hundreds of values of that length. Lines end with ``\\n`` or ``\\r\\n``; another ``\\r`` outside quotes
rejects the file. A quoted value still open at the end of a file ends there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspan.fixed import concepts as fixed
from clinspan.functions import spans
from clinspan.session import active, stored

KNOWN_COLUMNS = fixed.REQUIRED_COLUMNS + fixed.OPTIONAL_COLUMNS
MOST_VALUE = 131_072      # characters
MOST_RECORD = 64_000_000  # characters of a record with line breaks
# FIXED VALUES: why a file is rejected
EMPTY_FILE = "CSV file is empty or has no headers"
NOT_UTF8 = "File must be UTF-8 encoded"
MISSING = "Missing required columns: "
UNREADABLE = "CSV parsing error: "
LONG_VALUE = UNREADABLE + "field larger than field limit (131072)"
LONE_RETURN = UNREADABLE + "new-line character seen in unquoted field - do you need to open the file with newline=''?"
# What can be taken off a line from its start as long as no quoted value stays open. All parts are flat or possessive,
# so a long run costs no stack.
_CLOSED = r'\G(?:"[^"]*+"|,|[^",\r][^,\r]*+|\r++\z)'
_VALUE = r'\G,((?:"[^"]*+")*+(?:[^",\r][^,\r]*+)?+)'  # of a record with a comma before it
_QUOTED = r'^((?:"[^"]*+")*+)'


@dataclass(frozen=True)
class RawCsv:
    """``records``: ``file``, ``row`` (the header is row 1) and the known columns of accepted files as text;
    ``files``: every ``file`` with the ``error`` that rejects it, or NULL."""

    records: DataFrame
    files: DataFrame


def canonical_name(header: Column) -> Column:
    name = F.replace(F.replace(F.trim(F.lower(header)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    aliases = F.create_map(*[F.lit(x) for pair in fixed.COLUMN_ALIASES for x in pair])
    return F.coalesce(F.try_element_at(aliases, name), name)


def _values(record: Column) -> Column:
    """The values of a record as they are written, quotes included."""
    plain = (F.instr(record, '"') == 0) & (F.instr(record, "\r") == 0)
    return F.when(plain, F.split(record, ",", -1)).otherwise(
        F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_VALUE), 1))


def _plain(value: Column) -> Column:
    """A written value without its quotes; an empty one is NULL."""
    quoted = F.regexp_extract(value, _QUOTED, 1)
    inner = F.replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit('""'), F.lit('"'))
    rest = F.substring(value, F.length(quoted) + 1, F.length(value))
    # most quoted values hold no other quote
    whole = F.locate('"', value, 2) == F.length(value)
    return F.nullif(F.when(~value.startswith('"'), value).when(whole, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(
        F.concat(inner, rest)), F.lit(""))


def _after(text: Column) -> Column:
    """What is left of a line read from where no quoted value is open: '' , or from an opening quote or a lone return on."""
    plain = (F.instr(text, '"') == 0) & (F.instr(text, "\r") == 0)
    return F.when(plain, "").otherwise(F.regexp_replace(text, _CLOSED, ""))


def _turn(before: DataFrame, partition: tuple[str, ...], order: str, shut: str, opened: str, names: tuple[str, str]) -> DataFrame:
    """Add whether a value is open before each row, if none (``names[0]``) or one (``names[1]``) is before its partition.

    ``shut`` and ``opened`` are the bit after a row that finds none or one open. Equal ones set the bit; otherwise the row
    turns it (``shut``) or keeps it. So the bit is the last one set, turned as often as rows turned it since.
    """
    earlier = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.col(shut) == F.col(opened), (F.col(shut) & ~F.col(opened)).cast("int")
    rows = before.withColumn("_turns", F.coalesce(F.sum(turns).over(earlier), F.lit(0)))
    rows = rows.withColumn("_set", F.last(F.when(sets, F.struct(F.col(shut).alias("bit"), "_turns")), ignorenulls=True).over(earlier))
    since = (F.col("_turns") - F.coalesce(F.col("_set._turns"), F.lit(0))) % 2 == 1
    return rows.withColumns({
        name: F.coalesce(F.col("_set.bit"), F.lit(start)) != since for name, start in zip(names, (False, True))}).drop("_turns", "_set")


def _lines(path: str) -> DataFrame:
    """Lines with their split and place, the bit before them (``open_shut``, ``open_opened``) and records started up to them
    (``starts_shut``, ``starts_opened``), each for both values of the bit before the split."""
    lines = active().read.text(path, lineSep="\n").select(
        "value", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///").alias("file"),
        F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    quote = F.instr("value", '"')
    lines = lines.withColumns({
        "_shut": _after(F.col("value")),
        "_opened": F.when(quote == 0, '"').otherwise(_after(F.substring("value", quote + 1, F.length("value"))))})
    lines = lines.withColumns({
        "shut": F.col("_shut").startswith('"'), "opened": F.col("_opened").startswith('"'),
        "bad_shut": F.col("_shut").startswith("\r"), "bad_opened": F.col("_opened").startswith("\r"),
        "blank": F.col("value").rlike(r"^\r*\z")}).drop("_shut", "_opened")
    lines = _turn(lines, ("file", "block"), "at", "shut", "opened", ("open_shut", "open_opened"))
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({
        f"starts_{s}": F.count_if(~F.col(f"open_{s}") & ~F.col("blank")).over(upto) for s in ("shut", "opened")})


def _splits(lines: DataFrame) -> DataFrame:
    """A row for each split: the bit and the records before it, and what is known of its file."""
    def later(kind: str, s: str) -> Column:
        return F.when(F.col(f"open_{s}"), F.col(f"{kind}opened")).otherwise(F.col(f"{kind}shut"))

    splits = lines.groupBy("file", "block").agg(
        *[F.max_by(later("", s), "at").alias(s) for s in ("shut", "opened")],
        *[F.max(f"starts_{s}").alias(f"starts_{s}") for s in ("shut", "opened")],
        *[F.bool_or(later("bad_", s)).alias(f"bad_{s}") for s in ("shut", "opened")],
        F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.first("file_size").alias("file_size"),
        F.sum(F.octet_length("value") + 1).alias("bytes"))
    splits = _turn(splits, ("file",), "block", "shut", "opened", ("inside", "_"))
    splits = splits.withColumns({
        n: F.when(F.col("inside"), F.col(f"{n}_opened")).otherwise(F.col(f"{n}_shut")) for n in ("starts", "bad")})
    whole = Window.partitionBy("file")
    order = whole.orderBy("block")
    after = F.when(F.col("inside"), F.col("opened")).otherwise(F.col("shut"))
    # a last line without an end makes the lines one byte longer than the file, a byte order mark three shorter
    ended = ~(F.sum("bytes").over(whole) - F.max("file_size").over(whole)).isin(1, -2)
    return splits.select(
        "file", "block", "inside",
        F.coalesce(F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("records_before"),
        F.bool_and("valid").over(whole).alias("valid"), F.bool_or("bad").over(whole).alias("bad"),
        F.last(after).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("left_open"),
        ended.alias("ended"), F.sum("starts").over(whole).alias("records"))


def _placed(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """The lines of readable files with the ``row`` of their record; ``several`` if it has more of them."""
    held = lines.join(splits.where("valid AND NOT bad"), ["file", "block"])
    inside = F.when(F.col("inside"), F.col("open_opened")).otherwise(F.col("open_shut"))
    row = F.col("records_before") + F.when(F.col("inside"), F.col("starts_opened")).otherwise(F.col("starts_shut"))
    several = inside | F.col("shut")
    return held.where(inside | ~F.col("blank")).select(
        "file", "block", "at", "value", row.alias("row"), several.alias("several"),
        (F.col("left_open") & (row == F.col("records"))).alias("left_open"), "ended")


def _records(placed: DataFrame, long: DataFrame) -> DataFrame:
    """``file``, ``row``, ``block`` and text of each record of files that are not too long to be read."""
    pieces = placed.where("several").join(long, "file", "left_anti").groupBy("file", "row").agg(
        F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines"),
        F.first("left_open").alias("left_open"), F.first("ended").alias("ended"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    close = F.when(~F.col("left_open"), "").when(F.col("ended"), '\n"').otherwise('"')
    several = pieces.select("file", "block", "row", F.concat(text, close).alias("value"))
    return placed.where("NOT several").select("file", "block", "row", "value").union(several)


def read_csv(path: str) -> RawCsv:
    """Read a file, or a folder of files, as text columns. Records are found once and parsed once, and stored."""
    lines = stored("csv-lines", _lines(path))
    splits = stored("csv-splits", _splits(lines))
    placed = _placed(lines, splits)
    long = stored("csv-long", placed.where("several").groupBy("file", "row").agg(F.sum(F.length("value")).alias("n")).where(
        F.col("n") > MOST_RECORD).select("file").distinct())
    records = stored("csv-records", _records(placed, long))
    long_values = records.where(F.length("value") > MOST_VALUE).where(F.exists(
        _values(F.col("value")), lambda v: F.length(_plain(v)) > MOST_VALUE)).select("file")
    long = stored("csv-long", long.union(long_values).distinct())
    headers = records.where("row = 1").select("file", _values(F.regexp_replace("value", "^﻿", "")).alias("headers"))
    names = F.transform("headers", lambda h: F.coalesce(canonical_name(_plain(h)), F.lit("")))
    # of several headers with one name the last is used
    place = [F.when(F.array_contains("names", c), (F.size("names") + 1 - F.array_position(F.reverse("names"), c)).cast("int"))
             for c in KNOWN_COLUMNS]
    absent = F.array_compact(F.array(*[F.when(~F.array_contains("names", c), c) for c in fixed.REQUIRED_COLUMNS]))
    headers = stored("csv-headers", stored("csv-names", headers.select("file", names.alias("names"))).select(
        "file", F.array(*place).alias("places"),
        F.when(F.size(absent) > 0, F.concat(F.lit(MISSING), F.array_join(absent, ", "))).alias("missing")))
    found = splits.groupBy("file").agg(
        F.first("valid").alias("valid"), F.first("bad").alias("bad"), F.first("records").alias("records"))
    # Scans leave empty files out, so they come from the listing that the driver keeps for any read of files.
    listed = active().createDataFrame(
        [(re.sub("^file:/+", "file:///", f),) for f in active().read.text(path).inputFiles()], "file string")
    files = listed.join(found, "file", "left").join(headers, "file", "left").join(
        long.withColumn("long", F.lit(True)), "file", "left").select(
        "file",
        F.when(F.coalesce("records", F.lit(0)) == 0, EMPTY_FILE).when(~F.col("valid"), NOT_UTF8)
         .when(F.col("bad"), LONE_RETURN).when(F.col("long"), LONG_VALUE).otherwise(F.col("missing")).alias("error"))
    good = splits.select("file", "block").join(headers.where("missing IS NULL").select("file", "places"), "file").join(
        long, "file", "left_anti")
    # the values the known columns have, in their order, out of one parse; their quotes are taken off in the array, as an
    # expression for each column would make code too long to be compiled
    picked = spans.let(_values(F.col("value")), lambda v: F.transform(
        "places", lambda p: F.when(p.isNotNull(), F.try_element_at(v, p))))
    values = F.when(F.instr("value", '"') > 0, F.transform("values", lambda v: F.when(v.isNotNull(), _plain(v)))).otherwise(F.col("values"))
    parsed = records.where("row > 1").join(good, ["file", "block"]).select("file", "row", "value", picked.alias("values"))
    # stored as columns, so that readers parse nothing again and read the columns they use
    return RawCsv(stored("csv-values", parsed.select("file", "row", values.alias("values")).select("file", "row", *[
        F.nullif(F.col("values")[i], F.lit("")).alias(c) for i, c in enumerate(KNOWN_COLUMNS)])), files)
