"""Work that is done once: on the rows that need it, and not again by every reader."""

from pyspark.sql import functions as F

from clinspan.fixed import patterns
from clinspan.functions import normalize as nz
from clinspan.operators import ids, ingest, lookup, phi
from clinspan.session import stored
from clinspan.sources import csv_in

ROWS = "ID,First,Last,DOB,Sex,Notes\n,Ann,Lee,1980-01-02,F,\"a \"\"b\"\",\nc\"\np1,Bob,Lee,bad,M,\"x\"y\n,Cid,Lee,02/01/1980,M,\"\"\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_parsed_once(spark, tmp_path):
    (tmp_path / "in.csv").write_text(ROWS)
    raw = csv_in.read_csv(str(tmp_path / "in.csv"))
    got = raw.records.orderBy("row").select("patient_id", "first_name", "clinical_notes").collect()
    assert [tuple(r) for r in got] == [(None, "Ann", 'a "b",\nc'), ("p1", "Bob", "xy"), (None, "Cid", None)]
    assert "regexp" not in plan(raw.records).lower()
    done = ingest.ingest(raw)
    assert "gettimestamp" not in plan(done.summary).lower()
    assert sorted(r[0] for r in done.patients.select("source_patient_id").collect()) == ["CSV-PAT-00000001", "CSV-PAT-00000002"]
    assert [r.message for r in done.issues.where("level = 'error'").collect()] == ["Row 3: Invalid or missing date_of_birth 'bad'"]


def test_only_flagged_rows_are_numbered_and_their_sizes_counted_once(spark):
    rows = stored("numbered", spark.createDataFrame(
        [(f, p, p is None or p % 3 == 0) for f in ("a", "b", None) for p in (None, *range(50))], "f string, p int, wanted boolean"))
    got = ids.number_in_order(rows, "f", "p", F.col("wanted"), "n", rows_per_bucket=7)
    planned = plan(got)
    made = got.collect()
    assert len(made) == 153 and sorted(r.n for r in made if r.n) == list(range(1, 3 * 18 + 1))
    assert all((r.n is not None) == r.wanted for r in made)
    of = {f: [r.n for r in sorted((r for r in made if r.f == f and r.n), key=lambda r: -1 if r.p is None else r.p)] for f in ("a", "b", None)}
    assert all(ns == list(range(ns[0], ns[0] + 18)) for ns in of.values())
    assert planned.count("/numbered-") == 2


def test_a_shape_never_hides_a_date(spark):
    texts = ["2020-1-5", "2020-01-05 ", "31/12/2020", "12/31/2020", "31/31/1999", "2020/3/4", "05-06-2020", "2020-02-30", "-2020-1-5", "0001-02-2020",
             "+2020-1-5", "2020-1-5\n", "20201-1-5", "1-2", "", None, "2020-1-5 1:2:3", "2020-1-5t01:02:03", "1/2/2020 3:4:5", "x2020-1-5", "0001/2/2020"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")

    def plainly(layouts):
        text = F.nullif(F.trim("t"), F.lit(""))
        text = F.when(~text.rlike(r"(?<!\d)(\d{3}|\d{5,})(?!\d)"), text)
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in layouts])

    found = [nz.parse_date(F.col("t")), plainly(nz.DATE_FORMATS).cast("date"), nz.parse_datetime(F.col("t")),
             plainly(nz.DATETIME_FORMATS).cast("timestamp_ntz")]
    got = rows.select(*[c.cast("string") for c in found]).collect()
    assert [(r[0], r[2]) for r in got] == [(r[1], r[3]) for r in got] and sum(r[0] is not None for r in got) >= 7
    # a text is only tried by the layouts it has the shape of
    assert "RLIKE" in plan(rows.select(nz.parse_date(F.col("t"))))


NOTES = [
    "Mr. Karim Haddad, MRN: 884213 DOB: 03/14/1956 National ID: 1098765432 Phone: 555-123-4567 or +966 12 345 6789, fax: (555) 123-4567.",
    "Lives at 12 Palm Street, Springfield, TX 12345-6789. Aged 93 years. age 9, aged 104. SSN: 123-45-6789, SSN 123 45 6789, AB-123456, AB12345.",
    "Account #: 77 acct number: 5 Billing Number: X-1 License #: L1 Driver's License: D5 Member ID: M7 Policy Number: P9 Serial #: S3 device id: q",
    "fe80:0:0:1:2:3:4:ab at 10.20.30.40 or 10.20.30 1F2E3D4C-AAAA-BBBB-CCCC-0123456789AB; VIN: 1HGCM82633A004352 Born: March 4, 1956 born 1956-03-04",
    "Lee, Ann met ٣٣٣٣٣ and ١.٢.٣; 1098765432 5551234 123456789 Subscriber Number: 9, NPI Number: 3, Smith, ſo", "", None,
]


def test_short_parts_never_hide_an_identifier(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(NOTES)], "doc_id int, text string")
    got = phi.detect(rows, known_names=["Karim Haddad"])
    # the walk over hits keeps an end for each pattern that hit, not for each there is
    assert f"array_repeat(-1, {len(patterns.PHI_PATTERNS) + 1})" not in plan(got)
    got = got.orderBy("doc_id").collect()
    monkeypatch.setattr(patterns, "PHI_NEEDS_PART", {})
    monkeypatch.setattr(patterns, "PHI_NEEDS_DIGITS", {0: 0})
    assert got == phi.detect(rows, known_names=["Karim Haddad"]).orderBy("doc_id").collect()
    assert len({d.type for r in got for d in r.phi or []}) >= 13


def test_tokens_use_one_pattern_a_text(spark):
    rows = spark.createDataFrame([("Ab  c\n-é \x0b9\x85\xa0z \t\x1c",), ("",), (None,)], "text string")
    found = rows.select(lookup.tokens("text").alias("t"))
    got = [(t.start, t.raw, t.bare, t.word) for t in found.first().t]
    assert got == [(0, "Ab  ", "Ab", True), (4, "c\n", "c", True), (6, "-", "-", False), (7, "é \x0b", "é", False), (10, "9", "9", True),
                   (11, "\x85", "\x85", False), (12, "\xa0", "\xa0", False), (13, "z \t", "z", True), (16, "\x1c", "\x1c", False)]
    assert plan(found).count("regexp_replace(") == 1 and "RLIKE" not in plan(found)
