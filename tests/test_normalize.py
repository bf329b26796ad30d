import datetime as dt
from dataclasses import replace
import hashlib
import hmac

from pyspark.sql import functions as F

from registry.settings import DEID, TOKENS
from clinspan.functions import normalize as nz
from clinspan.functions.redact import redact_note
from clinspan.functions.secure import patient_token, shift_days


def values(spark, texts, build):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_names_lose_article_case_blanks_and_hyphens(spark):
    assert values(spark, [" al-Noor", "Al Amin", "Abdul-Al Karim", None, "Noral-"], nz.normalize_name) == [
        "NOOR", "AMIN", "ABDULKARIM", "", "NOR"]


def test_dates_take_the_first_layout_that_fits(spark):
    assert values(spark, ["2020-1-5", "31/12/2020", "12/31/2020", "01/02/2020", "2020/03/04", "05-06-2020",
                          "12-31-2020", "2020-02-30", " ", None, "20-01-2020x", "120-01-01"], nz.parse_date) == [
        dt.date(2020, 1, 5), dt.date(2020, 12, 31), dt.date(2020, 12, 31), dt.date(2020, 2, 1),
        dt.date(2020, 3, 4), dt.date(2020, 6, 5), dt.date(2020, 12, 31), None, None, None, None, None]


def test_datetimes(spark):
    assert values(spark, ["2020-01-05 10:20:30", "2020-01-05", "2020-01-05T01:02:03", "05/01/2020 00:00:01",
                          "13/14/2020", "2020-01-05 25:00:00"], nz.parse_datetime) == [
        dt.datetime(2020, 1, 5, 10, 20, 30), dt.datetime(2020, 1, 5), dt.datetime(2020, 1, 5, 1, 2, 3),
        dt.datetime(2020, 1, 5, 0, 0, 1), None, None]


def test_gender_and_source_words(spark):
    assert values(spark, [" m", "BOY", "woman", "F ", "x", "", None], nz.parse_gender) == [
        "male", "male", "female", "female", "other", "other", "other"]
    assert values(spark, ["KFSHRC", " King Fahd Medical City", "elsewhere", None], nz.source_system) == [
        "HIS", "LAB", "HIS", "HIS"]


def test_icd_code_needs_parentheses(spark):
    assert values(spark, ["Sepsis (A41.9)", "ICD: A41.9", "(x) (I10) (E11.9)", None], nz.icd_code) == [
        "A41.9", None, "I10", None]


def test_age_is_exact_to_the_birthday(spark):
    births = ["1930-01-01", "1930-01-02", "1931-01-01", "2019-12-31"]
    assert values(spark, births, lambda c: nz.age_on(c.cast("date"), dt.date(2020, 1, 1))) == [90, 89, 89, 0]


def test_token_equals_python_hmac(spark):
    texts = ["NID:1|DOB:20200101|NAME:ÄB|GEN:male", "x"]
    for config in (TOKENS, replace(TOKENS, secret_key=b"k" * 100, use_salt=False)):
        salt = config.salt if config.use_salt else b""
        expected = ["PT-" + hmac.new(config.secret_key, salt + t.encode(), hashlib.sha256).hexdigest()[:16].upper()
                    for t in texts]
        assert values(spark, texts, lambda c: patient_token(c, config)) == expected


def test_shift_is_constant_per_key_and_in_range(spark):
    days = values(spark, ["a", "a", *map(str, range(500))], lambda c: shift_days(c, DEID))
    assert days[0] == days[1] and min(days) >= -365 and max(days) <= 365 and len(set(days)) > 200
    assert set(values(spark, list("abcdef"), lambda c: shift_days(c, replace(DEID, date_shift_range=(5, 5))))) == {5}


def test_redaction_orders_and_case(spark):
    note = "Mail a3@b.example at noon, MRN-123, call 1234567890. Dr. Omar Saleh"
    legacy, = values(spark, [note], lambda c: redact_note(c, "legacy"))
    safe, = values(spark, [note], lambda c: redact_note(c, "safe"))
    strict, = values(spark, [note], lambda c: redact_note(c, "safe", strict_case=True))
    assert "a3@" in legacy and "a3@" not in safe
    assert "[MRN]" in safe and "[ID]" in safe
    assert "at noon" in strict and "at noon" not in safe
