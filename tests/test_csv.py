import datetime as dt
import random
from dataclasses import replace

from clinspan.operators import deid, ingest, linkage
from clinspan.plans import pipeline
from clinspan.sources import csv_in, export, text_in
from registry.settings import DEID, TOKENS


def load(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return ingest.ingest(csv_in.read_csv(str(path)), dt.date(2020, 1, 1))


GOOD = """ID,First,Last Name,DOB,Sex,Source System,Admit Date,Dept,ICD10,Diagnosis,Notes
p1,Nora,Al-Noor,1980-02-03,F,KFSHRC,2020-05-06 07:08:09,Cardio,I50.9,Heart failure,"line one
line ""two"", end"
p1,Nora,Al-Noor,03/02/1980,F,King Fahd Medical City,,,I10,,
,Adam,Saleh,1970-01-01,boy,,,,,,
,,Saleh,bad,x,,,,,,
,Lina,Khoury,1990-01-01,w,,,Onc,,,
"""


def test_rows_become_patients_encounters_and_messages(spark, tmp_path):
    got = load(tmp_path, GOOD)
    people = {r.source_patient_id: r for r in got.patients.collect()}
    assert set(people) == {"p1", "CSV-PAT-00000001", "CSV-PAT-00000002"}
    assert (people["p1"].gender, people["p1"].source_system, people["p1"].date_of_birth) == ("female", "HIS", dt.date(1980, 2, 3))
    assert people["CSV-PAT-00000001"].first_name == "Adam" and people["CSV-PAT-00000002"].gender == "other"
    visits = sorted(got.encounters.collect(), key=lambda r: r.row)
    assert [v.encounter_id for v in visits] == ["CSV-ENC-0000000001", "CSV-ENC-0000000002", "CSV-ENC-0000000003"]
    assert visits[0].admission_diagnosis == "Heart failure (I50.9)" and visits[0].clinical_notes == 'line one\nline "two", end'
    assert visits[0].admission_date == dt.datetime(2020, 5, 6, 7, 8, 9)
    # the encounter of a later row keeps the source system of the patient's first row
    assert (visits[1].source_system, visits[1].admission_diagnosis, visits[1].chief_complaint) == ("HIS", "ICD: I10", "Not specified")
    assert visits[1].admission_date == dt.datetime(2020, 1, 1) and visits[1].department == "General"
    assert visits[2].encounter_type == "outpatient" and visits[2].discharge_diagnosis is None
    assert sorted(r.message for r in got.issues.collect()) == [
        "Row 3: Missing admission_date, using current date", "Row 5: Invalid or missing date_of_birth 'bad'",
        "Row 5: Missing first_name", "Row 6: Missing admission_date, using current date"]
    total = got.summary.first()
    assert (total.row_count, total.valid_row_count, total.patients, total.errors, total.success) == (5, 4, 3, 2, True)


def test_missing_columns_reject_the_file(spark, tmp_path):
    got = load(tmp_path, "ID,First,DOB\n1,a,2020-01-01\n")
    total = got.summary.first()
    assert total.file_error == "Missing required columns: last_name, gender" and not total.success
    assert got.patients.count() == 0 and got.issues.first().message == total.file_error


def test_no_valid_row_fails_and_empty_file_is_an_error(spark, tmp_path):
    got = load(tmp_path, "First,Last,DOB,Sex\n,x,2020-01-01,M\n")
    assert got.summary.first().file_error == "No valid patient records found in CSV" and not got.summary.first().success
    assert load(tmp_path, "", "empty.csv").summary.first().file_error == "CSV file is empty or has no headers"


def test_last_of_equal_headers_wins(spark, tmp_path):
    got = load(tmp_path, "First,first-name,Last,DOB,Sex\nA,B,C,2020-01-01,M\n")
    assert got.patients.first().first_name == "B"


def test_export_prefers_the_encounter_and_falls_back_to_patients(spark, tmp_path):
    people = spark.createDataFrame(
        [(1, "t", "HIS", "s1", "male", 1980, 40, "R1"), (2, "t", "LAB", "s2", "male", 1981, 39, "R2")],
        "src_ord int, patient_token string, source_system string, surrogate_id string, gender string,"
        " year_of_birth int, age_at_data_collection int, region string")
    visits = spark.createDataFrame(
        [("t", "e", "ICU", "icu", dt.datetime(2020, 1, 2, 3, 4, 5))],
        "patient_token string, encounter_id string, source_system string, encounter_type string, admission_date timestamp_ntz"
    ).selectExpr("*", "cast(null as timestamp_ntz) discharge_date", "'d' department", "'c' chief_complaint",
                 "'x, \"y\"' admission_diagnosis", "cast(null as string) clinical_notes")
    rows = export.deid_csv_rows(people, visits)
    row = rows.first()
    assert (row.surrogate_id, row.source_system, row.region, row.month_of_birth) == ("s2", "ICU", "R2", None)
    export.write_deid_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()
    assert back.admission_date == "2020-01-02T03:04:05" and back.admission_diagnosis == 'x, "y"'
    assert export.deid_csv_rows(people, visits.where("false")).count() == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Ünï\ncode", encoding="utf-8")
    row = text_in.read_records(str(tmp_path / "*.txt")).first()
    assert row.doc_id.endswith("a.txt") and row.text == "Ünï\ncode"


def upload(tmp_path, **files):
    folder = tmp_path / "up"
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    return ingest.ingest(csv_in.read_csv(str(folder)), dt.date(2020, 1, 1))


ONE = "ID,first_name,last_name,DOB,Sex\na1,Ann,Lee,1950-01-01,F\na2,Bob,Ray,1960-01-01,M\n"
TWO = "last_name,first_name,ID,Birth Date,Gender\nFox,Cat,b1,1970-01-01,F\nKay,Dan,b2,1980-01-01,M\n"


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    got = upload(tmp_path, one=ONE, two=TWO)
    people = {r.source_patient_id: (r.first_name, r.last_name) for r in got.patients.collect()}
    assert people == {"a1": ("Ann", "Lee"), "a2": ("Bob", "Ray"), "b1": ("Cat", "Fox"), "b2": ("Dan", "Kay")}
    assert got.patients.select("src_ord").distinct().count() == 4


def test_before_and_after_belong_to_one_record(spark, tmp_path):
    people = upload(tmp_path, one=ONE, two=TWO).patients
    links = linkage.token_map(linkage.with_token(people, TOKENS))
    rows = deid.before_after(people, links, replace(DEID, date_shift_range=(0, 0))).collect()
    assert len(rows) == 4
    assert all(r.date_of_birth.year == r.year_of_birth for r in rows)


def test_files_are_rejected_one_by_one(spark, tmp_path):
    got = upload(tmp_path, good=ONE, latin=ONE.replace("Ann", "Zo\u00eb").encode("latin-1"), empty="", open='ID,first_name\n"a,b\n',
                 few="ID,first_name\n1,a\n", blank=TWO + "\n\n")
    files = {r.file.rsplit("/", 1)[1]: (r.file_error, r.row_count, r.success) for r in got.files.collect()}
    assert files == {
        "good.csv": (None, 2, True), "blank.csv": (None, 2, True), "latin.csv": ("File must be UTF-8 encoded", 0, False),
        "empty.csv": ("CSV file is empty or has no headers", 0, False),
        "open.csv": ("Missing required columns: last_name, date_of_birth, gender", 0, False),
        "few.csv": ("Missing required columns: last_name, date_of_birth, gender", 0, False)}
    total = got.summary.first()
    assert (total.row_count, total.patients, total.errors, total.success) == (4, 4, 4, True)
    assert got.issues.count() == 4


def test_records_are_found_across_splits(spark, tmp_path):
    """Splits of a few lines, with quoted line breaks, blank lines and commas on their borders."""
    lines = ["ID,first_name,last_name,DOB,Sex,Notes"]
    for i in range(300):
        note = ['"one\n\ntwo ""%d"", three"' % i, "plain", '"a\nb\nc\nd"', ""][i % 4]
        lines.append(f"p{i},F{i},L{i},1950-01-01,M,{note}")
        if i % 7 == 0:
            lines.append("")
    path = tmp_path / "big.csv"
    path.write_text("\n".join(lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        raw = csv_in.read_csv(str(path))
        rows = raw.records.orderBy("row").collect()
        splits = csv_in._lines(str(path)).select("block").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert splits > 5
    assert [r.row for r in rows] == list(range(2, 302)) and [r.patient_id for r in rows] == [f"p{i}" for i in range(300)]
    assert rows[4].clinical_notes == 'one\n\ntwo "4", three' and rows[2].clinical_notes == "a\nb\nc\nd"


def test_an_upload_goes_through_the_whole_pipeline(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "a.csv").write_text(GOOD)
    (folder / "b.csv").write_text(TWO)
    got, done = pipeline.upload(str(folder), TOKENS, DEID)
    assert done.tables.person.count() == 5 and done.tables.visit_occurrence.count() == 3
    assert done.tables.measurement.count() == 0 and "race_concept_id" in done.tables.person.columns
    rows = export.deid_csv_rows(done.people, done.encounters).collect()
    assert len(rows) == 3 and all(r.patient_token for r in rows)


def python_rows(data):
    """(rows after the header as dictionaries, error) of csv.DictReader over the text of a file."""
    import csv
    import io

    try:
        reader = csv.DictReader(io.StringIO(data))
        return [dict(r) for r in reader], None
    except csv.Error as error:
        return [], f"CSV parsing error: {error}"


PARTS = ["a", '"', '""', ",", "\n", "\r\n", "", "b c", '"x', 'y"', '"p,q"', '"m\nn"', "é", " ", '5" tall', '"s"t"', "\n\n"]
HEAD = "first_name,last_name,date_of_birth,gender,mrn\n"


def read_back(spark, path, split="64"):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        raw = csv_in.read_csv(str(path))
        rows = raw.records.collect()
        return rows, {r.file.rsplit("/", 1)[1]: r.error for r in raw.files.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_random_files_read_as_by_the_standard_reader(spark, tmp_path):
    """Random marks, cut into splits of 64 bytes: stray and doubled quotes, open ends, returns, short and long rows."""
    rng = random.Random(8)
    want, folder = {}, tmp_path / "many"
    folder.mkdir()
    for i in range(60):
        parts = PARTS + (["\r"] if i % 10 == 0 else [])
        text = HEAD + "".join(rng.choice(parts) for _ in range(rng.randint(0, 150)))
        want[f"f{i}.csv"] = python_rows(text)
        (folder / f"f{i}.csv").write_bytes(text.encode())
    rows, errors = read_back(spark, folder)
    got = {}
    for r in rows:
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.row] = r
    assert errors == {name: error for name, (_, error) in want.items()}
    names = HEAD.strip().split(",")
    assert sum(e is not None for e in errors.values()) > 1
    for name, (expected, _) in want.items():
        mine = got.get(name, {})
        assert sorted(mine) == list(range(2, len(expected) + 2)), name
        for k, one in enumerate(expected):
            assert [mine[k + 2][c] or "" for c in names] == [one[c] or "" for c in names], (name, k)


def test_stray_quotes_keep_all_records(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        'first_name,last_name,date_of_birth,gender,city\nAnn,A,2000-01-01,F,5" tall\nBob,B,2000-01-01,M,x\n'
        'Cyd,C,2000-01-01,F,6" tall\nDan,D,2000-01-01,M,"y"\n')
    rows, errors = read_back(spark, tmp_path / "q.csv", "20")
    assert [(r.first_name, r.city) for r in sorted(rows, key=lambda r: r.row)] == [
        ("Ann", '5" tall'), ("Bob", "x"), ("Cyd", '6" tall'), ("Dan", "y")]
    assert errors == {"q.csv": None}


def test_wide_files_long_values_and_many_quotes(spark, tmp_path):
    folder = tmp_path / "odd"
    folder.mkdir()
    wide = ",".join(f"x{i}" for i in range(3000))
    (folder / "wide.csv").write_text(f"{wide},{HEAD.strip()}\n" + ",".join(map(str, range(3000))) + ',A,B,2000-01-01,M,"1"\n')
    (folder / "quotes.csv").write_text(HEAD + 'A,B,2000-01-01,M,"' + '""' * 100_000 + '"\n')
    for name, n in (("fits", 131_072), ("long", 131_073)):
        (folder / f"{name}.csv").write_text(HEAD + 'A,B,2000-01-01,M,"' + "z\n" * (n // 2) + "z" * (n % 2) + '"\n')
    (folder / "bom.csv").write_bytes(b"\xef\xbb\xbf" + HEAD.encode() + b'A,B,2000-01-01,M,"open')
    (folder / "mac.csv").write_bytes(HEAD.replace("\n", "\r").encode() * 2)
    rows, errors = read_back(spark, folder, "100000")
    found = {r.file.rsplit("/", 1)[1]: r for r in rows}
    limit = "CSV parsing error: field larger than field limit (131072)"
    assert errors == {"wide.csv": None, "quotes.csv": None, "fits.csv": None, "long.csv": limit, "bom.csv": None,
                      "mac.csv": csv_in.LONE_RETURN}
    assert found["wide.csv"].mrn == "1" and found["quotes.csv"].mrn == '"' * 100_000
    assert found["fits.csv"].mrn == "z\n" * 65_536 and found["bom.csv"].mrn == "open"


def test_a_record_too_long_to_be_gathered_rejects_its_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_in, "MOST_RECORD", 1000)
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text(HEAD + 'A,B,2000-01-01,M,"' + "line\n" * 1000)
    (folder / "b.csv").write_text(HEAD + "A,B,2000-01-01,M,1\n")
    rows, errors = read_back(spark, folder)
    assert errors == {"a.csv": csv_in.LONG_VALUE, "b.csv": None} and [r.mrn for r in rows] == ["1"]
