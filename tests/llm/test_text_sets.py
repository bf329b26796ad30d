"""Repeats and near copies of documents against plain versions."""

import random

import brute
import numpy as np
import pytest
from odd_rows import PROSE, odd_documents

from clinspan.llm import octets, packed, repeats, signature_trees
from clinspan.llm.queries import QUERIES
from clinspan.llm.suffix_groups import lyndon_groups, suffix_array


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(3000):
        text = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(0, 16))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([0] * 5000) == list(range(4999, -1, -1))


def test_groups_share_their_longest_lyndon_prefix():
    text = list(b"mississippi")

    def prefix(i):
        end = next((j for j in range(i + 1, len(text)) if text[j:] < text[i:]), len(text))
        return tuple(text[i:end])

    groups, _ = lyndon_groups(text)
    found = [{prefix(i) for i in g} for g in groups]
    assert all(len(f) == 1 for f in found)
    assert [min(f) for f in found] == sorted({prefix(i) for i in range(len(text))})


def digest(out):
    return {r.doc_id: (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in out.collect()}


def test_repeats_query(spark):
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op8_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got == brute.repeats(docs)


def test_repeats_of_random_texts(spark):
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 260))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for i in range(160)]
    rows += [(200, "ab" * 400), (201, "a" * 99), (202, "a" * 100), (203, "a" * 101), (204, "a" * 100)]
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    import hashlib

    got = {i: (n, r, s, hashlib.sha256(k).hexdigest()) for i, (n, r, s, k) in digest(out).items()}
    assert got == brute.repeats(rows)


def test_repeats_of_long_texts_across_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 9)
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, base), (2, base[700:3000] + "x" + base[100:900]), (3, "y" + base[2500:])]
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute.repeats(rows)
    assert {i: v[:3] for i, v in digest(out).items()} == {i: v[:3] for i, v in want.items()}


def test_repeats_do_not_rest_on_hashes(spark, monkeypatch):
    rng = random.Random(8)
    stem = bytes(rng.choice(b"abcd") for _ in range(400))
    texts = [stem[:200], stem[50:300], b"x" + stem[:150] + b"y" + stem[150:], bytes(rng.choice(b"ab") for _ in range(300)), stem]
    data, low = b"".join(texts) + bytes(8), np.cumsum([0, *map(len, texts)])[:-1]
    size = np.array([len(t) for t in texts])
    at = np.array([20, 2, 5, 3, 4])  # aligned alike for the parts of one text
    args = (octets.words_at(data), low, size, at)
    want = {tuple(x) for x in np.transpose(repeats._repeated_windows(*args)).tolist()}
    copies = repeats._copies(args[0], np.array([0, 1, 0]), np.array([100, 100, 100]), (np.array([3, 2, 1]),)).tolist()
    monkeypatch.setattr(octets, "mix", lambda x: x * np.uint64(0))
    assert want and {tuple(x) for x in np.transpose(repeats._repeated_windows(*args)).tolist()} == want
    assert copies == [True, False, False]
    assert repeats._copies(args[0], np.array([0, 300, 0]), np.array([100, 100, 100]), (np.array([1, 1, 1]),)).sum() == 0


def test_repeats_of_a_passage_that_most_documents_hold(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(i, f"{i} own words {i * 7919} " * (i % 3) + passage[i % 2:] + f" end {i} " * (i % 4)) for i in range(900)]
    frame = spark.createDataFrame(rows + rows[5:8], "doc_id long, text string").repartition(3)
    want = brute.repeats(rows)
    assert {i: v[:3] for i, v in digest(repeats.remove_repeats(frame)).items()} == {i: v[:3] for i, v in want.items()}


def test_repeats_of_odd_documents(odd):
    rows = [r for r in repeats.remove_repeats(odd).collect()]
    assert len(rows) == odd.count()
    known = {r.doc_id: r for r in rows if r.doc_id is not None}
    first = [r for r in rows if r.doc_id == 1]
    assert len(first) == 2 and all(not r.spans and bytes(r.kept) == PROSE.encode() for r in first)
    assert known[5].kept == b"" and known[3].kept == b"" and known[7].n_bytes == 0 and known[8].kept == b""
    assert known[14].kept.decode(errors="ignore").startswith("é") and known[15].kept != known[14].kept
    want = brute.repeats([(i, t) for i, t in odd_documents() if i is not None and i not in (1,)] + [(1, PROSE)])
    for i, r in known.items():
        assert (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans)) == want[i][:3], i


def test_repeats_of_nothing(odd):
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


def jaccard(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in signature_trees.jaccard_classes(df).collect()}


def test_jaccard_query(spark):
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op10_jaccard_join"](spark, "/root/testdata/sf0.001").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got == brute.jaccard(docs)


@pytest.mark.parametrize("piece, closest", [(1024, 8), (4, 1), (7, 2)])
def test_jaccard_of_crowds(spark, monkeypatch, piece, closest):
    """Near copies around the threshold, with lists cut into pieces and crowds walked twice."""
    monkeypatch.setattr(signature_trees, "PIECE", piece)
    monkeypatch.setattr(signature_trees, "CLOSEST", closest)
    rng = random.Random(11)
    rows = []
    for base in range(4):
        words = [f"b{base}w{k}" for k in range(rng.choice((6, 30, 90)))]
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(copy[:rng.randint(len(copy) - 2, len(copy))])))
    rng.shuffle(rows)
    assert jaccard(spark.createDataFrame(rows, "doc_id long, text string")) == brute.jaccard(rows)


@pytest.mark.parametrize("piece", [2, 5])
def test_jaccard_of_long_lists_with_several_components(spark, monkeypatch, piece):
    """All texts share a passage that is in every prefix; tails of several lengths make components of several sizes."""
    monkeypatch.setattr(signature_trees, "PIECE", piece)
    monkeypatch.setattr(signature_trees, "CLOSEST", 1)
    rng = random.Random(13)
    rows = []
    for family in range(9):
        tail = [f"f{family}t{k}" for k in range(rng.choice((8, 25, 60)))]
        for i in range(rng.choice((1, 2, 14))):
            rows.append((len(rows), " ".join(PROSE.split()[:14] + tail + [f"end{i % 7}", f"own{i}"][:rng.randint(0, 2)])))
    rng.shuffle(rows)
    assert jaccard(spark.createDataFrame(rows, "doc_id long, text string")) == brute.jaccard(rows)


def test_pieces_of_crowded_lists_cover_all_pairs_apart(spark, monkeypatch):
    monkeypatch.setattr(signature_trees, "PIECE", 3)
    rng = random.Random(17)
    rows = [(of, k // 3, of * 100 + k, 20 + k + rng.randint(0, 3), rng.choice((1, 1, 1, 2, 3, 100 + k)))
            for of in (1, 2) for k in range(30)] + [(3, 0, 900 + k, 30, 5) for k in range(3)]
    frame = spark.createDataFrame(rows, "of long, piece int, class long, n_shingles long, root long")
    met = set()
    for r in signature_trees._apart(frame).collect():
        assert r.of != 3 and len(r.members) == len(set(r.members))
        mine, other = (r.members[:r.cut], r.members[r.cut:]) if r.cut else (r.members, r.members)
        met |= {(min(x, y), max(x, y)) for x in mine for y in other if x != y}
    want = {(x[2], y[2]) for x in rows for y in rows
            if x[0] == y[0] and x[2] < y[2] and x[4] != y[4] and min(x[3], y[3]) * 100 >= 75 * max(x[3], y[3])}
    assert want <= met


def test_jaccard_order_of_shingles_is_free(spark, monkeypatch):
    monkeypatch.setattr(signature_trees, "SAMPLE_ONE_IN", 1)
    rows = [(i, " ".join(PROSE.split()[i % 5:]) + f" end{i % 3}") for i in range(30)]
    assert jaccard(spark.createDataFrame(rows, "doc_id long, text string")) == brute.jaccard(rows)


def test_jaccard_of_odd_documents(odd):
    rows = signature_trees.jaccard_classes(odd).collect()
    assert len(rows) == odd.count()
    want = brute.jaccard([(i, t) for i, t in odd_documents() if i is not None])
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert signature_trees.jaccard_classes(odd.limit(0)).count() == 0


def test_keep_one(odd):
    kept = signature_trees.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    want = brute.jaccard([(i, t) for i, t in odd_documents() if i is not None])
    firsts = {c if n else i for i, (n, c) in want.items()}
    assert [i for known, i in ids if known] == sorted(firsts)
    assert sum(not known for known, _ in ids) == 2


def test_walk_finds_all_that_may_link():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 60))).astype(np.uint64) for _ in range(120)]
    sets += [np.delete(s, rng.integers(len(s))) for s in sets if len(s) > 4]
    bits = [signature_trees.bitmap(s * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    sizes = np.array([len(s) for s in sets])
    i, j, _ = signature_trees.candidates(bits, sizes, np.zeros(len(sets), np.int64))
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert len(found) == len(i)
    for a in range(len(sets)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 75 * (sizes[a] + sizes[b] - common):
                assert (b, a) in found


def test_packing_of_entries_round_trips():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 1000).astype(np.uint64) >> np.uint64(20)
    bucket, key = packed.bucket_and_key(hashes, 16)
    assert np.bincount(bucket, minlength=16).min() > 20
    out = packed.pack(bucket, {"key": key, "n": np.arange(1000)})
    back = packed.unpack(out["n"], np.int64)
    assert sorted(back.tolist()) == list(range(1000)) and (packed.unpack(out["key"], np.uint32) == key[back]).all()
