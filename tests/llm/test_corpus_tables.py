"""Decontamination, collocations and the Merkle manifest against plain versions."""

import hashlib
import random

import brute
import numpy as np
import pytest
from odd_rows import PROSE, SF

from clinspan.llm import collocations, merkle, positional_index
from clinspan.llm.queries import QUERIES


def hits(df, id_col="doc_id"):
    return sorted(((r[id_col], r.n_words, r.n_hit, list(r["items"]), r.n_items) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def bench_items(spark):
    words = PROSE.split()
    return spark.createDataFrame(
        [(1, PROSE), (2, " ".join(words[5:15])), (3, " ".join(words[5:16])), (3, "one two three"), (4, "one two"), (4, "ONE-two"),
         (5, "a a a a a a a a a a a a"), (6, ""), (7, None), (8, "..."), (None, "one two three four five"), (10, "never seen here"),
         (10, " ".join(reversed(words))), (9, "é" * 300)], "item_id long, text string")


def test_decontamination_of_odd_documents(odd, bench_items):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [tuple(r) for r in bench_items.collect()]
    got = hits(positional_index.decontaminate(odd, bench_items))
    assert got == sorted(brute.contamination(docs, items), key=repr)
    assert hits(positional_index.decontaminate(odd, bench_items, window=4)) == sorted(brute.contamination(docs, items, 4), key=repr)
    assert positional_index.decontaminate(odd.limit(0), bench_items).count() == 0
    clean = positional_index.decontaminate(odd, bench_items.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.n_hit or r.n_items for r in clean)


def test_decontamination_of_random_texts(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))  # noqa: E731  few words: many lists agree by chance
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    items = [(i, text(rng.randint(1, 9))) for i in range(25)] + [(99, docs[3][1])]
    frames = [spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))]
    got = hits(positional_index.decontaminate(*frames, window=5))
    assert got == sorted(brute.contamination(docs, items, 5), key=repr)


@pytest.mark.parametrize("slop", [1, 3])
def test_proximity(spark, slop):
    rng = random.Random(slop)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(30)]
    items = [(i, text(rng.randint(1, 7))) for i in range(20)]
    docs.append((50, "zero one and two three then four"))
    items.append((50, "zero one two three four"))
    wanted = positional_index.phrases(spark.createDataFrame(items, "item_id long, text string"), window=5)
    postings = positional_index.build_index(spark.createDataFrame(docs, "doc_id long, text string"), wanted.terms)
    found = positional_index.search(postings, wanted, slop).join(wanted.items, "phrase")
    got = {(r.id, r.item_id) for r in found.join(postings.where("term = ''").select("doc", "id"), "doc").collect()}
    want = {(d, int(i)) for d, _, _, held, _ in brute.contamination(docs, items, 5, slop) for i in held}
    assert got == want and (slop < 2 or (50, 50) in got)


def test_decontamination_without_broadcast(spark, odd, bench_items, monkeypatch):
    want = hits(positional_index.decontaminate(odd, bench_items))
    monkeypatch.setattr(positional_index, "BROADCAST_BYTES", -1)
    assert hits(positional_index.decontaminate(odd, bench_items)) == want


def test_decontamination_is_native(spark, documents):
    import io
    from contextlib import redirect_stdout

    out = QUERIES["op11_decontaminate"](spark, SF)
    with redirect_stdout(io.StringIO()) as said:
        out.explain("formatted")
    assert "Python" not in said.getvalue() and "Arrow" not in said.getvalue()
    assert out.count() == documents.count()


def as_set(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def test_collocations_of_random_texts(spark):
    rng = random.Random(2)
    words = ["New", "york", "city", "a", "b", "É", "c\td", "x.", "y,", "z\n", " ", "w:w"]
    docs = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for _ in range(300)]
    docs += [("en", "the big red dog")] * 40 + [("en", "big red")] * 3 + [("fr", None), ("de", "ein wort"), ("xx", "")]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    want = brute.collocations(docs, least=10, top=50)
    assert len(want) > 60 and as_set(collocations.collocations(df, least=10, top=50)) == want


def test_collocations_of_odd_documents(odd):
    docs = [(r.lang, r.text) for r in odd.collect()]
    assert as_set(collocations.collocations(odd, least=2)) == brute.collocations(docs, least=2)
    assert collocations.collocations(odd.limit(0)).count() == 0


def test_collocations_with_a_full_filter(spark, odd, monkeypatch):
    """A bitmap that lets everything pass changes nothing."""
    want = as_set(collocations.collocations(odd, least=2))
    monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 13)
    monkeypatch.setattr(collocations, "BATCH", 500)
    assert as_set(collocations.collocations(odd, least=2)) == want


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(3)
    for least in (5, 30):
        draws = np.r_[rng.zipf(1.3, 40000) % 30000, np.repeat(np.arange(40000, 40020), least)].astype(np.uint32)
        rng.shuffle(draws)
        parts = [collocations.tally(p) for p in np.array_split(draws, 37)]
        keys, counts = collocations.tally(draws)
        found = collocations.frequent(parts, least, slack=1)
        assert set(keys[counts >= least]) <= set(found)
        assert len(found) <= len(draws) // least + 1
        tight = collocations.frequent(parts, least)
        assert set(keys[counts >= least]) <= set(tight) and min(counts[np.isin(keys, tight)]) > least // 2


def test_scores_need_more_than_64_bits(spark):
    big = 4_000_000_000_000_000_001
    rows = [("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, n_words int, phrase string, count long")).collect()
    assert [(r.phrase, r.score) for r in got] == [("a b", 2_000_000 * (big - 1) // (2 * big))]


def digest(row, columns):
    def one(v):
        if v is None:
            return "-"
        return f"{len(str(v).encode())}:{v}"
    return hashlib.sha256("".join(one(row[c]) for c in columns).encode()).hexdigest()


def check_manifest(docs, columns):
    rows = docs.collect()
    root, want = brute.merkle([(r.lang, r.doc_id, digest(r, columns)) for r in rows])
    out = merkle.manifest(docs, columns)
    out = out.withColumn("folded", merkle.fold(out.leaf, out.path)).withColumn("proof", merkle.proof_digest(out.path)).collect()
    assert len(out) == len(rows) and all(r.root == root == r.folded for r in out)
    paths = sorted((r.leaf, r.subroot, r.proof) for r in out)
    wanted = sorted((leaf, sub, hashlib.sha256("".join(p).encode()).hexdigest())
                    for (_, _, leaf), all_of in want.items() for sub, p in all_of)
    assert paths == wanted


def test_manifest_of_odd_documents(odd):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    check_manifest(odd, columns)
    assert merkle.manifest(odd.limit(0), columns).count() == 0
    check_manifest(odd.limit(1), columns)


def test_manifest_of_many_groups_and_ids(spark):
    """Sparse, negative, repeated and missing ids; groups of one row to several passes; a repeated row over blocks."""
    rng = random.Random(9)
    rows = [(rng.choice([rng.randrange(-3000, 3000), rng.randrange(-2**63, 2**63), None]), rng.choice(["a", "B", "é", "", None]),
             str(rng.randrange(5))) for _ in range(2500)]
    rows += [(i, "long", "x") for i in range(1500)] + [(7, "long", "same")] * 1200 + [(0, f"g{i}", "y") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(7)
    check_manifest(df, ["doc_id", "lang", "text"])


def test_manifest_tells_what_changed(spark, documents):
    rows = QUERIES["op13_merkle_manifest"](spark, SF).collect()
    import zlib

    assert len(rows) == documents.count()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows)
    assert len({r.root for r in rows}) == 1
