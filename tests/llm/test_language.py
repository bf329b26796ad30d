"""Toxicity, personal data and language-model scores."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from odd_rows import CARD, SF, odd_documents

from clinspan.llm import ppm, private_spans, toxicity
from clinspan.llm.queries import QUERIES

INSULTS = ("nitwitted", "blockhead", "dunderhead")


def sentences(rng, insults):
    syllables = ["ba", "ko", "ti", "ren", "mu", "sal", "dor", "pen", "li", "gra"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(40, 120))]
    for _ in range(insults):
        words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
    return " ".join(words)


@pytest.fixture(scope="module")
def rude(spark):
    rng = random.Random(5)
    rows = [(i, sentences(rng, 5 if i % 4 == 0 else 0), int(i % 4 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_held_out(rude):
    model = toxicity.fit(rude.select("doc_id", "text"), rude.where("doc_id < 240").select("doc_id", "toxic"))
    scored = toxicity.score_documents(rude.where("doc_id >= 240"), model).collect()
    right = [(r.score >= toxicity.REJECT) == bool(r.toxic) for r in scored]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in scored)


def test_toxicity_evidence_is_counted_by_context(spark):
    rng = random.Random(1)
    rows = [(1, sentences(rng, 4) + " glorious copied passage") for _ in range(60)] + [(0, sentences(rng, 0)) for _ in range(120)]
    found = toxicity.evidence(spark.createDataFrame(rows, "label int, text string").repartition(4))[0]
    # the same by brute force: different words before each whole word
    before, total = [{}, {}], [0, 0]
    for label, text in rows:
        words = ["", *toxicity.plain(text.encode()).split()]
        for a, b in zip(words, words[1:]):
            before[label].setdefault(b, set()).add(a)
    total = [sum(map(len, x.values())) for x in before]
    for word, contexts in before[1].items():
        k, j = len(contexts), len(before[0].get(word, ()))
        p = (k + j) / sum(total)
        value = 2 * sum(x * np.log(x / n / q) for x, n, q in (
            (k, total[1], p), (total[1] - k, total[1], 1 - p), (j, total[0], p), (total[0] - j, total[0], 1 - p)) if x)
        good = k >= 4 and k / total[1] >= toxicity.LEAST_RATIO * (j + 1) / total[0] and value > toxicity.LEAST_EVIDENCE
        key = b" " + word + b" "
        assert (key in found) == good and (not good or abs(found[key] - value) < 1e-6)
    chosen = {x.strip().decode() for x in toxicity.choose(found)}
    assert set(INSULTS) <= chosen and not {"copied", "passage"} & chosen


def test_toxicity_is_learned_from_the_end_of_long_texts(spark):
    """Insults stand behind 20,000 bytes of ordinary words, in fitting and in scoring."""
    rng = random.Random(7)
    rows = [(i, " ".join(sentences(rng, 0) for _ in range(40)) + " " + sentences(rng, 6 * (i % 2)), i % 2) for i in range(160)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert min(len(t) for _, t, _ in rows) > 15_000
    model = toxicity.fit(frame.select("doc_id", "text"), frame.where("doc_id < 100").select("doc_id", "toxic"))
    scored = toxicity.score_documents(frame.where("doc_id >= 100"), model).collect()
    assert np.mean([(r.score >= toxicity.REJECT) == bool(r.toxic) for r in scored]) > 0.95


def test_toxicity_query_on_held_out_labels(spark):
    """Precision and recall on labels that were not learned from, also of texts over 8,000 bytes."""
    folder = SF.replace("0.001", "0.1")
    rows = QUERIES["op3_toxicity"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").join(
        spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "octet_length(text) AS size"), "doc_id").collect()
    for least in (0, 8_000):
        some = [r for r in rows if r.size >= least and r.toxic is not None]
        right = sum(r.predicted and r.toxic for r in some)
        print("precision, recall", least, right / max(1, sum(r.predicted for r in some)), right / max(1, sum(r.toxic for r in some)), len(some))
        # some 300 toxic texts are learned from here; measured 0.98 and 0.82, over 8,000 bytes 1.0 and 0.9
        assert right >= 0.9 * sum(r.predicted for r in some) and right >= 0.75 * sum(r.toxic for r in some)


def test_toxicity_without_two_classes(rude):
    only = toxicity.fit(rude, rude.where("toxic = 0").select("doc_id", "toxic"))
    assert {r.score for r in toxicity.score_documents(rude.limit(3), only).collect()} == {0.0}
    none = toxicity.fit(rude, rude.limit(0).select("doc_id", "toxic"))
    assert {r.score for r in toxicity.score_documents(rude.limit(3), none).collect()} == {0.0}


def test_toxicity_of_odd_documents(odd, rude):
    model = toxicity.fit(rude.select("doc_id", "text"), rude.select("doc_id", "toxic"))
    out = toxicity.score_documents(odd, model)
    rows = out.collect()
    assert len(rows) == odd.count() and set(out.columns) == set(odd.columns)
    assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1
    assert toxicity.score_documents(odd.limit(0), model).count() == 0


def test_toxicity_query(spark):
    rows = QUERIES["op3_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)


def test_base_patterns():
    rng = random.Random(3)
    parts = ["a", "b.", "@", "mail", "x-y", ".com", " ", "+1", "(", ")", "-", CARD, "4012 8888 8888 1881", "555",
             "192.168.0.1", "1.2.3", "999.1.1.1", "é", ".", "0", "12", "\n", "+49 30 123456", "%"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        got = [(k, a, z) for k in private_spans.KINDS for a, z in private_spans.base_spans(text)[k]]
        assert got == brute.private(text), text


def test_base_patterns_are_linear():
    import time

    for text in ("1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000, "a@b.c" * 40_000):
        started = time.time()
        private_spans.all_spans(text, {})
        assert time.time() - started < 20, text[:10]


def all_cuts(count, spans):
    """Every segmentation, as lists of span numbers."""
    if not count:
        return [[]]
    out = list(all_cuts(count - 1, spans))
    for k, (i, j, *_) in enumerate(spans):
        if j == count:
            out += [cut + [k] for cut in all_cuts(i, spans)]
    return out


def test_segmentation_and_chances_against_all_cuts():
    run = f"+1 (269) 555-3296 {CARD} 10.0.0.1"
    starts, spans = private_spans.segments(run, " ", " ")
    rng = random.Random(2)
    weights = {n: rng.uniform(-1, 2) for _, _, kind, f in spans for n in private_spans.names(kind, f)}
    cuts = all_cuts(len(starts) - 1, spans)
    value = [sum(private_spans.value(weights, spans[k][2], spans[k][3]) for k in cut) for cut in cuts]
    best = cuts[int(np.argmax(value))]
    assert private_spans.best(len(starts) - 1, spans, weights) == [(spans[k][0], spans[k][1], spans[k][2]) for k in best]
    chance = np.exp(np.array(value) - np.max(value))
    chance /= chance.sum()
    want = [sum(c for c, cut in zip(chance, cuts) if k in cut) for k in range(len(spans))]
    assert np.allclose(private_spans.chances(len(starts) - 1, spans, weights), want)


def test_numbers_that_stand_together_are_told_apart(spark):
    weights = private_spans.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    text = f"Write to +1 (269) 555-3296 {CARD} now"
    assert brute.private(text) == []
    found = private_spans.all_spans(text, weights)
    assert [(k, text[a:z], b) for k, a, z, b in found] == [("card", CARD, False), ("phone", "+1 (269) 555-3296", False)]
    assert private_spans.mask(text, found) == "Write to [PHONE] [CARD] now"


def test_private_spans_of_odd_documents(spark, odd):
    weights = private_spans.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").union(odd.select(
        "doc_id", "text", "lang", "source", "n_chars")))
    rows = private_spans.find_private(odd, weights).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is not None:
            text = dict(odd_documents())[r.doc_id]
            assert [(s.kind, s.start, s.stop) for s in r.spans if s.base] == brute.private(text)
    masked = private_spans.mask_documents(odd, weights, length_col="n_chars")
    assert masked.schema == odd.schema
    by_id = {r.doc_id: r for r in masked.collect()}
    assert "[EMAIL]" in by_id[18].text and CARD not in by_id[18].text and by_id[18].n_chars == len(by_id[18].text)
    assert by_id[8].text is None and by_id[7].text == ""
    assert private_spans.find_private(odd.limit(0), private_spans.fit(odd.limit(0))).count() == 0


def test_private_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op4_private_spans"](spark, SF).collect():
        base = brute.private(docs[r.doc_id])
        line = ",".join(f"{k}:{a}:{z}" for k, a, z in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in private_spans.KINDS]


def check_scores(rows, docs, train):
    model = brute.Ppm(train, ppm.ORDER)
    for r in rows:
        tokens, known, total, base = model.base(docs[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(model.score(docs[r.doc_id]), rel=1e-9)


@pytest.mark.parametrize("frequent", [1 << 19, 50])
def test_scores_query(spark, monkeypatch, frequent):
    monkeypatch.setattr(ppm, "MOST_WORDS", frequent)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_ppm_score"](spark, SF).collect()
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    assert {r.doc_id for r in rows if r.held_out} == held and len(rows) == len(docs)
    check_scores(rows, docs, [t for i, t in docs.items() if i not in held])


def test_scores_are_probabilities(spark):
    """Over all next symbols of a context the model's probabilities sum to 1."""
    model = ppm.train(spark.createDataFrame([("abracadabra",), ("abba",)], "text string")).trie.value
    for context in (b"\xfe\xfe\xfe\xfe\xfe", b"\xfeabra", b"dabra", b"zzabr", b"zzzzz"):
        window = np.array([int.from_bytes(context + bytes([s])) for s in [*range(0xFE), 0xFF]], np.uint64)
        assert np.sum(10 ** model.score(window)) == pytest.approx(1)


def test_scores_of_a_bounded_trie(spark, monkeypatch):
    monkeypatch.setattr(ppm, "MOST_NODES", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = ppm.train(docs)
    trie = model.trie.value
    assert sum(len(k) for k, _ in trie.grams) <= 3000
    for order in range(1, ppm.ORDER + 1):
        keys, _ = trie.grams[order]
        assert np.isin(keys & ppm.low_bytes(order), trie.grams[order - 1][0]).all()
    assert all(r.score < 0 for r in ppm.score_documents(docs, model).collect())


@pytest.mark.parametrize("nodes", [0, 3000, 50000])
def test_scores_do_not_depend_on_the_bound(spark, monkeypatch, nodes):
    monkeypatch.setattr(ppm, "MOST_NODES", nodes)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_ppm_score"](spark, SF).collect()
    check_scores(rows, docs, [t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    twice = spark.createDataFrame([(1, "abracadabra"), (1, "abracadabra"), (2, "zebra")], "doc_id long, text string")
    rows = ppm.score_documents(twice, ppm.train(twice)).collect()
    assert len(rows) == 3
    check_scores(rows, {1: "abracadabra", 2: "zebra"}, ["abracadabra", "abracadabra", "zebra"])


def test_scores_of_odd_documents(odd):
    out = ppm.score_documents(odd, ppm.train(odd))
    rows = out.collect()
    assert len(rows) == odd.count()
    docs = {i: t for i, t in odd_documents() if i is not None}
    check_scores([r for r in rows if r.doc_id is not None], docs, [t for _, t in odd_documents()])
    empty = ppm.train(odd.limit(0))
    got = ppm.score_documents(odd.where("doc_id = 11"), empty).first()
    assert got.train_tokens == 0 and got.base_score == 0 and got.score == pytest.approx(-8 * np.log10(ppm.ALPHABET))
    assert ppm.score_documents(odd.limit(0), empty).count() == 0


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 5000, 3000)).astype(np.uint64)
    table = ppm.Lookup(keys, np.arange(len(keys)), -1)
    asked = np.arange(6000, dtype=np.uint64)
    want = np.full(6000, -1)
    want[keys.astype(int)] = np.arange(len(keys))
    assert (table.get(asked) == want).all()
    assert (ppm.Lookup(keys[:0], np.zeros(0, int), -1).get(asked) == -1).all()
