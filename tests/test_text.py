import random
import re

import pytest
from pyspark.sql import functions as F

from registry.settings import KNOWN_NAMES
from clinspan.fixed import lexicon, patterns
from clinspan.functions import spans
from clinspan.operators import notes, phi, records, terminology
from clinspan.sources import export


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


# --- a plain-Python statement of what the operators promise ----------------------------------


def walk(spans_in_order):
    kept, stop = [], 0
    for span in spans_in_order:
        if span[0] >= stop:
            kept.append(span)
            stop = span[1]
    return kept


def all_phrases(text):
    hits = set()
    for phrases, *_ in lexicon.CONCEPTS:
        for phrase in phrases:
            for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(phrase)}(?![A-Za-z0-9])", text, re.I):
                hits.add((m.start(), m.end(), phrase))
    return hits


def phi_spans(text):
    hits = [(m.start(), m.end(), "name", patterns.KNOWN_NAME_CONFIDENCE, 0)
            for name in KNOWN_NAMES for m in re.finditer(re.escape(name), text, re.I)]
    for place, (kind, pattern) in enumerate(patterns.PHI_PATTERNS, start=1):
        found = [(m.start(), m.end(), kind, patterns.PHI_CONFIDENCE, place) for m in re.finditer(pattern, text, re.I)]
        hits += [h for h in found if not any(e[0] <= h[0] and h[1] <= e[1] for e in hits)]
    hits.sort(key=lambda h: (h[0], -h[3]))
    return [(s, e, kind) for s, e, kind, *_ in walk(hits)]


def entity_spans(text):
    hits = [(m.start(), m.end(), kind) for kind, _, pattern in patterns.ENTITY_PATTERNS
            for m in re.finditer(pattern, text, re.I)]
    hits.sort(key=lambda h: (h[0], -(h[1] - h[0])))
    return walk(hits)


def sentence_spans(text):
    cuts = [m.end() for m in re.finditer(lexicon.SENTENCE_END, text)]
    bounds = list(zip([0, *cuts], [*cuts, len(text)]))
    return [(a, b) for a, b in bounds if text[a:b].strip()]


PIECES = ["Dr. Omar Al-Qahtani", "Khalid Al-Habib", "Smith, John", "patient", "the", "DOB: 03/14/1956", "5551234567", "555-1234",
          "1098765432", "MRN: 88-21", "AB-123456", "12 Palm Street", "Springfield, TX 12345", "a.b@c.example", "https://x.y/z?q=1", "10.0.0.1",
          "age: 93 years", "+966 5 123 4567", "fingerprint", "VIN: 1HGCM82633A004352", "\n\n", ".", "! ", "é", "naïve", "(", "BP: 120/80", "aspirin",
          "500 mg of Ecotrin", "NSTEMI", "non-STEMI", "coronary artery disease (CAD)", "heart failure", "egfr gene mutation positive", "T790M",
          "no evidence of", "family history:", "PMH:", "EGFR", "type 2 diabetes mellitus", "SpO2 94%", "HR 98 bpm", "chest pain", "CT scan", "LDL cholesterol",
          "Policy # A-1", "Acct # 99", "2020", "\x01", "\x02", "12345-6789", "ß", "日本", "𝒳", "FAMILY HISTORY:\n", "PAST HISTORY:\n", "\t"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return [rng.choice(["", " "]).join(rng.choice(PIECES) + rng.choice([" ", " ", "\n", ", "]) for _ in range(rng.randint(0, 40)))
            for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return random_texts(250, 7)


def spans_by_doc(df, *columns):
    out = {}
    for row in df.collect():
        out.setdefault(row.doc_id, []).append(tuple(row[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_identifiers_equal_the_plain_statement(spark, texts):
    got = spans_by_doc(phi.phi_rows(phi.detect(frame(spark, texts), known_names=KNOWN_NAMES)), "start", "end", "type")
    for i, text in enumerate(texts):
        assert got.get(i, []) == phi_spans(text), repr(text)


def test_masked_text_replaces_every_detection(spark, texts):
    masks = dict(patterns.PHI_MASKS)
    rows = phi.detect(frame(spark, texts), known_names=KNOWN_NAMES).select("doc_id", phi.mask(F.col("text"), F.col("phi")).alias("m")).collect()
    for row in rows:
        text, expected, at = texts[row.doc_id], "", 0
        for start, end, kind in phi_spans(text):
            expected += text[at:start] + masks[kind]
            at = end
        assert row.m == expected + text[at:]


def test_a_long_run_of_words_does_not_exhaust_the_stack(spark):
    words = "word " * 20000
    texts = [words + ", TX 12345", "9 " + words + "Road end", words]
    got = spans_by_doc(phi.phi_rows(phi.detect(frame(spark, texts), known_names=KNOWN_NAMES)), "start", "end", "type")
    assert got[0][0][0] == 0 and len(got[2]) == 10000
    road = re.search(r"Road", texts[1]).end()
    assert got[1][0] == (2, 11, "name") or got[1][0] == (0, road, "geographic")


def test_clinical_entities_equal_the_plain_statement(spark, texts):
    got = spans_by_doc(records.entity_rows(frame(spark, texts)), "start", "end", "type")
    for i, text in enumerate(texts):
        assert got.get(i, []) == sorted(entity_spans(text)), repr(text)


def test_phrases_and_sentences_equal_the_plain_statement(spark, texts):
    df = frame(spark, texts)
    found = spans_by_doc(notes.candidates(df), "start", "end", "trigger")
    kept = spans_by_doc(notes.entity_rows(notes.extract(df)), "start", "end")
    cut = spans_by_doc(spans.rows_of(df.select("doc_id", notes.sentences("text").alias("s")), "s", "doc_id"), "start", "end")
    for i, text in enumerate(texts):
        phrases = all_phrases(text)
        assert found.get(i, []) == sorted(phrases), repr(text)
        longest_first = sorted(phrases, key=lambda p: (p[0], -p[1]))
        assert kept.get(i, []) == [p[:2] for p in walk(longest_first)]
        assert cut.get(i, []) == sentence_spans(text), repr(text)


def entities(spark, text, threshold=0.5):
    return {r.text: r for r in notes.entity_rows(notes.extract(frame(spark, [text]), threshold)).collect()}


def test_context_flags(spark):
    found = entities(spark, (
        "HISTORY OF PRESENT ILLNESS:\nThis person has chest pain since early this morning with nausea; there is no"
        " evidence of\npulmonary congestion.\n\nPAST MEDICAL HISTORY:\nHeart failure. KRAS wild-type.\n\nFAMILY HISTORY:\nPneumonia and EGFR."))
    assert found["pulmonary congestion"].negated and not found["chest pain"].negated
    # "person" contains the family cue "son"
    assert found["chest pain"].subject == "family" and not found["chest pain"].historical
    assert found["Heart failure"].historical and found["Heart failure"].subject == "patient"
    assert found["KRAS"].negated
    assert found["Pneumonia"].subject == "family" and found["EGFR"].subject == "patient"
    assert not found["EGFR"].historical


def test_present_illness_is_current(spark):
    found = entities(spark, "HISTORY OF PRESENT ILLNESS:\nHistory of sepsis.\n\nPLAN:\nHistory of sepsis, now AKI")
    assert not found["AKI"].negated and found["AKI"].historical
    first = [r for r in notes.entity_rows(notes.extract(frame(spark, ["HISTORY OF PRESENT ILLNESS:\nHistory of sepsis."]))).collect()]
    assert not first[0].historical


def test_threshold_is_clamped_and_exact_terms_score_higher(spark):
    assert entities(spark, "Sepsis and septic shock", 0.91).keys() == {"Sepsis"}
    assert entities(spark, "sepsis", -3).keys() == {"sepsis"} and not entities(spark, "sepsis", 7)


def test_record_stats_and_exports(spark):
    df = frame(spark, ["No pneumonia & <fever>. Old aspirin\nuse", ""])
    extracted = notes.extract(df)
    stats = {r.doc_id: r for r in notes.stats(extracted).collect()}
    assert (stats[0].words, stats[0].sentences, stats[0].negated_entities, stats[0].vocabularies_used) == (
        7, 2, 1, ["RxNorm", "SNOMED CT"])
    assert (stats[1].words, stats[1].sentences, stats[1].entities_linked) == (0, 0, 0)
    html = {r.doc_id: r.html for r in export.annotated_html(extracted).collect()}
    assert "&amp; &lt;fever&gt;" in html[0] and "line-through" in html[0] and "italic" in html[0]
    rows = {r.span_text: r for r in export.entity_csv_rows(extracted).collect()}
    assert rows["aspirin"].context == "Old aspirin use" and rows["pneumonia"].negated == "yes"
    assert export.operations_text(extracted).where("doc_id = 0").first().log.count("\n[") == 8
    assert '"entities_linked":2' in export.entity_json(extracted).where("doc_id = 0").first().json


def code(spark, text, match):
    row = frame(spark, [text]).select(match(F.col("text")).alias("m")).first()
    return row.m.code if row.m else None


def test_vocabulary_matches(spark):
    t = terminology
    assert code(spark, " Heart Attack ", t.snomed_match) == "22298006"
    assert code(spark, "failure of the heart", t.snomed_match) is None
    assert code(spark, "", t.snomed_match) is None
    assert code(spark, "1000mg PO", t.rxnorm_match) is None
    assert code(spark, "1000mg PO", lambda c: t.rxnorm_match(c, skip_empty=False)) == "860975"
    assert code(spark, "insulin", t.rxnorm_match) == "847230"
    assert code(spark, "heart rate: 98 bpm", t.loinc_match) is None
    assert code(spark, "Pulse", t.loinc_match) == "8867-4"
    assert code(spark, "STENT", t.cpt_match) == "92928"


def test_mapping_routes_and_dictionaries(spark, tmp_path):
    rows = spark.createDataFrame([("condition", "pneumonia"), ("medication", "Lipitor"), ("procedure", "nothing")], "type string, text string")
    got = {r.text: (r.terminology_system, [m.system for m in r.mappings]) for r in terminology.map_entities(rows).collect()}
    assert got["pneumonia"][0] == "SNOMED CT" and got["Lipitor"] == ("RxNorm", ["RxNorm"]) and got["nothing"] == (None, [])
    assert {r.vocabulary: r.entries for r in terminology.terminology_counts().collect()} == {
        "snomed": 28, "icd10": 24, "loinc": 26, "rxnorm": 20, "cpt": 25}
    terminology.vocabulary("loinc").write.json(str(tmp_path / "loinc"))
    assert terminology.vocabulary("loinc", str(tmp_path / "loinc")).count() == 26
    assert terminology.vocabulary("loinc", str(tmp_path / "nowhere")).count() == 0


def test_time_grows_with_the_length_of_a_note(spark):
    """Four times the text in at most five times the time, beyond planning."""
    import time

    base = "Call 555-123-4567 or mail a.b@c.example now. No fever, denies dyspnea. PLAN:\nmetformin 500 mg for type 2 diabetes.\n"

    def took(times, run):
        df = frame(spark, [base * times])
        run(df).collect()
        started = time.time()
        run(df).collect()
        return time.time() - started

    for run in (lambda df: phi.detect(df).select(F.size("phi")), lambda df: notes.extract(df).select(F.size("entities")),
                lambda df: records.clinical_entities(df).select(F.size("entities"))):
        plan = took(1, run)
        short, long = took(640, run) - plan, took(2560, run) - plan
        assert long < 5 * max(short, 0.8), (plan, short, long)


def test_a_repeated_id_stays_one_row_each(spark):
    df = frame(spark, ["No fever. Type 2 diabetes."] * 3).withColumn("doc_id", F.lit(1))
    found = notes.extract(df)
    for build in (export.entity_json, export.operation_array, export.operations_text):
        out = build(found)
        assert out.count() == 3
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_one_file_per_document_is_written_by_tasks_without_files_beside_it(spark, tmp_path, monkeypatch):
    from registry import text_queries
    from registry.queries import QUERIES

    monkeypatch.setattr(text_queries, "shared_dir", lambda name: str(tmp_path / name))
    row = QUERIES["text_read"](spark, "/root/testdata/sf0.001").first()
    files = [p.name for p in (tmp_path / "records").rglob("*") if p.is_file()]
    assert sum(f.startswith("part-") for f in files) == row.files == 200 and not any(f.endswith(".crc") for f in files)
    # more folders than the driver lists by itself
    assert sum(p.is_dir() for p in (tmp_path / "records").iterdir()) > int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.threshold"))


def test_records_are_read_as_they_are(spark, tmp_path):
    from clinspan.sources import text_in

    texts = {"a.txt": "one\r\ntwo\x00 ا\n\n", "b.txt": "﻿no end", "c.txt": " "}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    rows = text_in.read_records(str(tmp_path)).collect()
    assert {r.doc_id.rsplit("/", 1)[1]: r.text for r in rows} == texts and all(r.doc_id.startswith("file:///") for r in rows)


def test_tasks_write_documents_without_hadoop_and_only_whole_attempts_are_read(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from clinspan.sources import text_in
    from registry.inputs import write_texts

    monkeypatch.setattr(DataFrameWriter, "text", lambda *args, **kwargs: pytest.fail("Hadoop starts a process for each file"))
    texts = [None, "", "one\r\ntwo ا", "same", "same"]
    rows = spark.createDataFrame([(k % 2 or None, t) for k, t in enumerate(texts)], "part int, text string")
    folders = write_texts(rows.repartition(3), str(tmp_path / "records"))
    left = tmp_path / "records" / "part=failed-0"
    left.mkdir()
    (left / "part-000000000.txt").write_bytes(b"half")
    read = [r.text for r in text_in.read_records(*folders).collect()]
    assert sorted(read) == sorted(f"{t or ''}\x00" for t in texts)


def test_cues_and_constants_are_found_in_one_step(spark):
    from clinspan.functions.spans import constant_value

    cues = [lexicon.NEGATION_BEFORE, lexicon.NEGATION_AFTER, lexicon.HISTORY_CUES, lexicon.FAMILY_CUES]
    some = random.Random(3)
    texts = ["", "No", "no", "s/p", "in 2", "in 20", "wild.type", "x"] + [c for cs in cues for c in cs] + [
        "".join(some.choice(some.choice(some.choice(cues)).split(" ")) + " " for _ in range(3))[some.randrange(4):] for _ in range(400)]
    rows = frame(spark, texts).select("text", *[notes._any_cue(F.col("text"), c).alias(f"c{k}") for k, c in enumerate(cues)])
    assert all(list(r)[1:] == [any(c in r.text for c in cs) for cs in cues] for r in rows.collect())
    for pairs in ({"ab": (1,), "ac": (2,), "b": (3,)}, {"ab": (1,), "é": (2,)}):
        keys = ["ab", "ac", "b", "a", "", "é", "zz", None]
        found = frame(spark, keys).select("text", constant_value(pairs, F.col("text")).alias("v")).collect()
        assert {r.text: r.v for r in found} == {k: pairs.get(k, (None,))[0] for k in keys}
    # a cue list is one pattern: a lambda over the cues would make the sentence's lower case anew for each of them
    plan = notes.extract(frame(spark, texts))._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan
