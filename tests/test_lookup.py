"""Vocabularies and dictionaries as tables give what the built-in constants give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from clinspan.fixed import patterns, vocabularies
from clinspan.operators import lookup, notes, terminology
from registry.inputs import inputs

SF = "/root/testdata/sf0.001"
MATCHERS = {
    "snomed": terminology.snomed_match, "icd10": terminology.icd10_match, "loinc": terminology.loinc_match,
    "rxnorm": terminology.rxnorm_match, "cpt": terminology.cpt_match}


@pytest.fixture(scope="module")
def texts(spark):
    """Names of all vocabularies whole, cut, mixed, with doses, blanks and other case; repeated, empty and null texts."""
    rng = random.Random(6)
    names = [n for _, t, syn, _ in vocabularies.SNOMED for n in [t, *syn]]
    names += [n for _, a, b, *_ in vocabularies.ICD10 for n in (a, b)] + [n for _, a, b, *_ in vocabularies.LOINC for n in (a, b)]
    names += [n for _, a, b, brands, *_ in vocabularies.RXNORM for n in (a, b, *brands)] + [n for _, a, b, _ in vocabularies.CPT for n in (a, b)]
    names += [a for a, _ in patterns.LAB_ALIASES]
    words = sorted({w for n in names for w in n.split()})
    rows = names + [n.upper() + " " for n in names] + [n[:k] for n in names for k in (1, 2, 3, 5)] + [n + " 500 mg daily" for n in names]
    rows += [" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(400)]
    rows += [" ".join(rng.sample(n.split(), min(len(n.split()), rng.randint(1, 4))) + rng.sample(words, rng.randint(0, 1))) for n in names * 3]
    rows += ["", " ", None, "500 mg", "%", "zzz"] + names[:20]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")


def codes(df):
    return {r.id: (r.text, r.match and (r.match.code, r.match.term, r.match.system)) for r in df.collect()}


@pytest.mark.parametrize("name", list(MATCHERS))
def test_a_vocabulary_table_matches_as_the_constants_do(spark, texts, tmp_path, name):
    path = str(tmp_path / name)
    terminology.vocabulary(name).write.json(path)
    want = codes(texts.withColumn("match", MATCHERS[name](F.col("text"))))
    assert codes(lookup.match(texts, name, terminology.vocabulary(name, path))) == want
    assert sum(m is not None for _, m in want.values()) > 100
    empty = terminology.vocabulary(name, str(tmp_path / "nowhere"))
    assert not any(m for _, m in codes(lookup.match(texts.limit(50), name, empty)).values())


def test_matches_by_shuffle_are_the_same(spark, texts, monkeypatch):
    want = codes(lookup.match(texts, "snomed", terminology.vocabulary("snomed")))
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)
    assert codes(lookup.match(texts, "snomed", terminology.vocabulary("snomed"))) == want


def test_a_dictionary_table_finds_what_the_constants_find(spark):
    note = inputs(spark, SF).note.select("doc_id", "text")
    edges = ["Type 2 diabetes, hypertension;HYPERTENSION", "no hypertensions, xhypertension 2hypertension", "(hypertension)", "hypertension",
             "éhypertensioné chronic\nkidney disease chronic  kidney disease", "", None]
    note = note.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(edges, 1)], "doc_id bigint, text string"))
    dictionary = spark.createDataFrame([(p, p.upper()) for p in notes.TRIGGERS], "trigger string, phrase string")
    want = sorted((r.doc_id, r.start, r.end, r.trigger) for r in notes.candidates(note).collect())
    got = sorted((r.doc_id, r.start, r.end, r.trigger) for r in lookup.phrases(note, dictionary).collect())
    assert got == want and len(want) > 500


def test_phrases_of_marks_and_other_scripts(spark):
    rows = [(1, "a+b (+) c-reactive protein, السكري x(+)x STRASSE straße the the the")]
    dictionary = spark.createDataFrame(
        [("(+)",), ("C-Reactive",), (" السكري ",), ("strasse",), ("a",), ("the the",), ("",), (None,)], "phrase string")
    got = sorted((r.start, r.phrase) for r in lookup.phrases(spark.createDataFrame(rows, "doc_id int, text string"), dictionary).collect())
    text = rows[0][1]
    assert got == sorted([(0, "a"), (4, "(+)"), (8, "C-Reactive"), (text.index("ا"), " السكري "),
                          (text.index("STRASSE"), "strasse"), (text.index("the"), "the the"), (text.index("the") + 4, "the the")])
    assert lookup.phrases(spark.createDataFrame(rows, "doc_id int, text string"), dictionary.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [lookup.BROADCAST_BYTES, -1])
def test_many_phrases(spark, monkeypatch, bound):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", bound)
    dictionary = spark.range(100_000).select(F.concat(F.lit("alpha "), F.col("id").cast("string"), F.lit(" omega")).alias("phrase"), "id")
    text = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("x alpha "), (F.col("id") * 150).cast("string"), F.lit(" Omega y alpha 7 beta")).alias("text"))
    got = {r.doc_id: r.id for r in lookup.phrases(text, dictionary).collect()}
    assert got == {i: i * 150 for i in range(500)}


def test_copies_of_names_and_of_forms_of_texts_meet_once(spark):
    n = 40_000  # all pairs of them would be 1.6 billion
    names = spark.range(n).select((F.lit(n) - F.col("id")).alias("ord"), F.concat(F.lit("c"), "id").alias("code"), F.lit("Red large ring").alias(
        "description"), F.lit(None).cast("string").alias("long_description"))
    texts = spark.range(n).select("id", F.concat(F.lit("large "), F.col("id").cast("string"), F.lit(" RING  red")).alias("text"))
    started = time.time()
    got = lookup.match(texts, "icd10", names).groupBy("match.code").count().collect()
    assert [tuple(r) for r in got] == [(f"c{n - 1}", n)] and time.time() - started < 60


def test_words_match_as_a_plain_search_does(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(9)]
    names = [" ".join(rng.choices(pool, k=rng.randint(1, 7))) for _ in range(60)] + ["", " "]
    texts = [" ".join(rng.choices([*pool, "x", "y", "z"], k=rng.randint(0, 8))) for _ in range(300)]
    want = {}
    for text in texts:
        mine, best = set(text.split()), None
        for i, name in enumerate(names):
            shared = len(mine & set(name.split()))
            if mine and shared >= min(2, len(mine)) and shared >= len(mine) * 0.6:
                best = min(best or (0, 0), (-shared / max(len(mine), len(set(name.split()))), i))
        want[text] = best and f"c{best[1]}"
    vocabulary = spark.createDataFrame([(i, f"c{i}", n, None) for i, n in enumerate(names)], "ord int, code string, description string, long_description string")
    rows = lookup.match(spark.createDataFrame([(t,) for t in texts], "text string"), "icd10", vocabulary).collect()
    assert {r.text: r.match and r.match.code for r in rows} == want and len(rows) == len(texts)
