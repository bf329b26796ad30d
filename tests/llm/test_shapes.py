"""Chat formatting, images, vectors, mixing, packing and the pipeline."""

import contextlib
import json
import random
import threading
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from compare import bag, duck
from odd_rows import SF, odd_documents
from pyspark.sql import functions as F

import corpus_pipeline
from clinspan.llm import chat, components, images, mixing, packing, vectors
from clinspan.llm.queries import ORACLES, QUERIES


def test_chat_query(spark):
    df = QUERIES["op1_chat_format"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    cur = duck(SF).execute(ORACLES["op1_chat_format"])
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag([d[0] for d in cur.description], cur.fetchall())


ODD_TURNS = [
    (1, 0, "user", "a | b \\ <|turn|> </turn>"), (1, 1, "assistant", ""), (1, 2, None, None), (1, 3, "assistant", "x<"),
    (None, 0, "user", "lost"), (None, None, "assistant", "id"), (2, 5, "assistant", "same"), (2, 5, "assistant", "same"),
    (2, 5, "user", "|turn|>"), (3, 1, "<|body|>", "é" * 40000), (4, 0, "assistant", "|" * 50 + "\\" * 51),
]


def test_chat_of_odd_turns(spark):
    turns = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("part", F.lit("clash")).withColumn("head", F.lit("clash"))
    out = chat.format_chat(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    rows = out.select("*", chat.read_chat(F.col("formatted")).alias("read"),
                      chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(rows) == 5
    for r in rows:
        mine = sorted(((t or 0) if t is not None else -1, role or "", text or "") for c, t, role, text in ODD_TURNS if c == r.conv_id)
        assert [(x.role, x.text) for x in r.read] == [(role, text) for _, role, text in mine]
        assert list(r.loss) == [text for _, role, text in mine if role == "assistant" and text]
        assert all(chat_unescape(r.formatted[s.start:s.start + s.length]) == text for s, text in zip(r.loss_spans, r.loss))
    assert chat.format_chat(turns.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def chat_unescape(text):
    import re

    return re.sub(r"(?s)\\(.)", r"\1", text)


def test_chat_parts(spark):
    part = dict(kind=None, text=None, ref=None, width=None, height=None, seconds=None, pages=None)
    lists = [
        [dict(part, kind="text", text="look <"), dict(part, kind="image", ref="s3://a.png", width=57, height=28),
         dict(part, kind="text", text="|body|> at this")],
        [dict(part, kind="audio", ref="b.wav", seconds=2.0), dict(part, kind="document", ref="c.pdf", pages=3),
         dict(part, kind="image", ref=None), dict(part, kind="video", text="dropped"), dict(part, kind="text", text="fine")],
        None, [],
    ]
    rows = [json.dumps(dict(conv_id=1, turn=k, role=("user", "assistant")[k % 2], parts=x)) for k, x in enumerate(lists)]
    frame = spark.read.schema(f"conv_id long, turn long, role string, parts array<{chat.PART}>").json(
        spark.createDataFrame([(r,) for r in rows], "value string").select("value").rdd.map(lambda r: r.value))
    got = chat.format_chat(frame).select("*", chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert got.formatted == (
        "<|turn|>user<|body|>look <<|image:1.2|>\\|body\\|> at this<|end|>\n"
        "<|turn|>assistant<|body|><|audio:2.1|><|document:2.2|><|image:2.3|>fine<|end|>\n"
        "<|turn|>user<|body|><|end|>\n<|turn|>assistant<|body|><|end|>\n")
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in got.attachments] == [
        (1, 2, "image", "s3://a.png", 3), (2, 1, "audio", "b.wav", 25), (2, 2, "document", "c.pdf", 1536), (2, 3, "image", None, 1)]
    assert all(got.formatted[a.start:].startswith(f"<|{a.kind}:{a.turn}.{a.part}|>") for a in got.attachments)
    assert got.n_turns == 4 and list(got.loss) == ["fine"] and got.n_tokens == 2 + 3 + 6 + 25 + 1536 + 1 + 1


def links_frame(spark, links):
    return spark.createDataFrame(links, "a long, b long")


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(400, 800), rng.randrange(400, 800)) for _ in range(250)]
    links += [(5, 5), (None, 3), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components.components(links_frame(spark, links)).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == brute.roots({x for link in real for x in link}, real)
    assert components.components(links_frame(spark, [])).count() == 0


def vector_rows():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.normal(size=24)
        for c in range(rng.integers(1, 6)):
            noise = rng.normal(size=24)
            rows.append((len(rows), (base + noise * rng.choice([0, 0.1, 0.3])).astype(np.float32).tolist(), int(k % 3)))
    crowd = rng.normal(size=24)
    rows += [(len(rows) + i, (crowd + rng.normal(size=24) * 0.12).astype(np.float32).tolist(), 1) for i in range(80)]
    n = len(rows)
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 24, 1), (n + 3, [None] + [1.0] * 23, 1), (n + 4, [nan] + [1.0] * 23, 1),
             (n + 5, [inf] + [1.0] * 23, 1), (n + 6, [1.0] * 24, None), (n + 7, [1.0] * 24, 7), (n + 8, [2.0] * 24, 7),
             (n + 9, [1.0] * 23, 7), (n + 10, [1e-30] * 24, 7), (n + 11, [1e30] * 24, 7), (n + 12, [1.0] * 24, 7)]
    return rows


@pytest.mark.parametrize("piece", [2048, 8])
def test_vectors(spark, monkeypatch, piece):
    monkeypatch.setattr(vectors, "PIECE", piece)
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()}
    want = brute.vectors(rows)
    linked = sum(n for n, _, _ in want.values())
    assert sum(n for n, _, _ in got.values()) >= 0.98 * linked
    assert all(got[i][0] <= want[i][0] for i in want)
    quiet = [i for i, v in want.items() if not v[0]]
    assert all(got[i] == want[i] for i in quiet) and linked > 4000


def test_vector_recall():
    rng = np.random.default_rng(1)
    for width in (16, 64, 200):
        x = vectors.unit(rng.normal(size=(1500, width)))
        n = rng.normal(size=x.shape)
        n = vectors.unit(n - (n * x).sum(1, keepdims=True) * x)
        y = vectors.LEAST * x + np.sqrt(1 - vectors.LEAST ** 2) * n
        met = np.logical_or.reduce(vectors._meet(vectors.codes(x), vectors.codes(y))).any(1)
        assert met.mean() > 0.9, width


def test_vectors_of_repeated_and_missing_ids(spark):
    rows = [(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (3, [2.0, 4.0], 1), (None, None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in vectors.near_duplicates(frame).collect())
    assert got == [(0, 0, 0, False), (0, 3, 3, False), (3, 3, 3, True), (4, 3, 3, False), (4, 3, 3, False)]
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: tuple(r[1:]) for r in QUERIES["op5_vector_near_dedup"](spark, SF).collect()}
    assert got == brute.vectors(rows)


def test_edited_images_are_found(spark):
    got = {r.media_id: r for r in QUERIES["op2_image_copies"](spark, SF).collect()}
    pairs = [(got[i], got[i + 1]) for i in got if i % 2 == 0]
    assert np.mean([a.component_id == b.component_id for a, b in pairs]) > 0.9
    mixed = {}
    for i, r in got.items():
        mixed.setdefault(r.component_id, set()).add(i // 2)
    assert np.mean([len(m) == 1 for m in mixed.values()]) > 0.97


def test_odd_images(spark):
    rng = np.random.default_rng(6)
    image = images.render(rng.normal(size=(1, 64)))[0]
    flat = bytes(64 * 64)
    rows = [(1, image.tobytes(), 64, 64), (1, image.tobytes(), 64, 64), (2, None, 4, 4), (3, b"", 0, 0), (4, b"abc", 64, 64),
            (5, flat, 64, 64), (6, flat, 64, 64), (7, b"\x01" * 9, 3, 3), (8, image.tobytes(), None, 64),
            (None, np.rot90(image).tobytes(), 64, 64), (10, image.tobytes(), 32, 128)]
    frame = spark.createDataFrame(rows, "media_id long, pixels binary, width int, height int").withColumn("class", F.lit("clash"))
    got = [(r.media_id, r.component_id, r.n_keypoints > 0) for r in images.copies(frame).collect()]
    assert sum(x == (1, 1, True) for x in got) == 2
    assert (None, 1, True) in got and (2, 2, False) in got and (3, 3, False) in got and (4, 4, False) in got
    assert (5, 5, False) in got and (6, 5, False) in got and (7, 7, False) in got and (8, 8, False) in got
    assert images.copies(frame.limit(0)).count() == 0


def test_only_pairs_of_images_with_matches_of_one_scale_and_turn_are_judged():
    rng = np.random.default_rng(5)
    one, two = np.zeros(60, images._KEYPOINT), np.zeros(60, images._KEYPOINT)
    for side in (one, two):
        side["turn"], side["scale"] = rng.integers(0, images.TURNS, 60), rng.integers(0, len(images.SCALES), 60)
    pair, left, right = rng.integers(0, 12, 700), rng.integers(0, 60, 700), rng.integers(0, 60, 700)
    ways = [(p, int(two["scale"][r]) - int(one["scale"][k]), (int(two["turn"][r]) - int(one["turn"][k])) % images.TURNS)
            for p, k, r in zip(pair.tolist(), left, right)]

    def may(some, p):
        return any(sum((q, s) == (p, scale) and (t - turn + 1) % images.TURNS <= 2 for q, s, t in some) >= images.LEAST_AGREEING
                   for q0, scale, turn in some if q0 == p)

    for size in (0, 60, 150, 700):
        wanted = [k for k in range(size) if may(ways[:size], ways[k][0])]
        assert images._one_way(pair[:size], one, two, left[:size], right[:size], 12).tolist() == wanted
    assert 0 < len([k for k in range(150) if may(ways[:150], ways[k][0])]) < 150


def test_crowds_of_images_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(images, "SMALL", 4)
    rng = np.random.default_rng(7)
    image = images.render(rng.normal(size=(1, 64)))[0].astype(int)
    rows = [(i, np.clip(image + rng.integers(-2, 3, image.shape), 0, 255).astype(np.uint8).tobytes(), 64, 64) for i in range(30)]
    got = images.copies(spark.createDataFrame(rows, "media_id long, pixels binary, width int, height int")).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("crowded", [1, 4])
def test_images_that_share_crowded_descriptors_only(spark, monkeypatch, crowded):
    """Two images share six corners; of each, ten images more show one, which is near in ``crowded`` tables."""
    def points_are_pixels(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["__id"], batch["class"], batch["pixels"]], ["__id", "class", "points"])

    monkeypatch.setattr(images, "_map_keypoints", points_are_pixels)
    rng = np.random.default_rng(12)
    pair = np.zeros(6, images._KEYPOINT)
    bits = rng.integers(0, 256, (6, 32), dtype=np.uint8)
    pair["bits"] = bits.view("V32")[:, 0]
    pair["x"], pair["y"] = 10.0 + 9 * np.arange(6), 20.0 + 7 * np.arange(6) ** 2
    moved = pair.copy()
    moved["x"] += 4
    held = [pair, moved]
    for k in range(6):
        for n in range(10):
            other = pair[k:k + 1].copy()
            changed = bits[k:k + 1].copy()
            changed[:, 8 * crowded::8] ^= np.uint8(1 << n % 8)
            other["bits"], other["x"] = changed.view("V32")[:, 0], 100 + n
            held.append(other)
    rows = [(i, p.tobytes(), len(p.tobytes()), 1) for i, p in enumerate(held)]
    got = {r.media_id: r.component_id for r in images.copies(
        spark.createDataFrame(rows, "media_id long, pixels binary, width int, height int")).collect()}
    assert got == {i: 0 if i < 2 else i for i in range(len(held))}


def drawn_points(rng, kinds, n):
    """Keypoints of an image, each of one of a few kinds of corners."""
    points = np.zeros(n, images._KEYPOINT)
    points["bits"] = kinds[rng.integers(0, len(kinds), n)].view("V32")[:, 0]
    points["x"], points["y"] = rng.integers(10, 200, (2, n))
    points["scale"], points["turn"] = rng.integers(0, 3, n), rng.integers(0, 3, n)
    return points


def blocks_of(held, parts):
    out = []
    for part in np.array_split(np.arange(len(held)), parts):
        ends = np.cumsum([len(held[i]) for i in part])
        out.append(images._Block(part.astype(np.int64).tobytes(), ends.astype(np.int64).tobytes(), b"".join(held[i].tobytes() for i in part)))
    return out


@pytest.mark.parametrize("small, most, piece, wide", [(256, 1 << 21, 1 << 14, 64), (3, 40, 50, 5), (256, 7, 1, 1)])
def test_blocks_of_images_meet_in_full(monkeypatch, small, most, piece, wide):
    """All pairs, judged one by one, give the same components, and every link told is one of theirs."""
    for name, value in (("SMALL", small), ("MOST", most), ("PIECE", piece), ("WIDE", wide)):
        monkeypatch.setattr(images, name, value)
    rng = np.random.default_rng(31)
    kinds = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    kinds[20:, :24] = kinds[:20, :24] ^ np.uint8(1) * (np.arange(24) % 8 < 2)     # near in the last table only, and
    kinds[20:, 24:] = kinds[:20, 24:]
    kinds[30:, :24] = rng.integers(0, 256, (10, 24), dtype=np.uint8)              # far in the others
    held = [drawn_points(rng, kinds, int(n)) for n in rng.integers(1, 25, 50)]
    for i in range(14):
        moved = held[i % 9].copy()
        moved["x"], moved["y"] = 200 - moved["y"] + rng.uniform(-1, 1, len(moved)), moved["x"] + 5
        moved["turn"] = (moved["turn"] + 18 + rng.integers(-1, 2, len(moved))) % images.TURNS
        held.append(moved[:len(moved) - i % 3])
    links = set()
    for a, x in enumerate(held):
        for b, y in enumerate(held[:a]):
            u, v = (np.ascontiguousarray(k["bits"]).view(np.uint64).reshape(-1, images.TABLES) for k in (x, y))
            i, j = np.nonzero((u[:, None] == v[None]).any(-1))
            near = np.bitwise_count(u[i] ^ v[j]).sum(-1) <= images.MOST_BITS_APART
            if images.agreeing(y[j[near]], x[i[near]]) >= images.LEAST_AGREEING:
                links.add((b, a))
    want = brute.roots(range(len(held)), links)
    assert 5 < len(set(want.values())) < len(held)
    blocks = blocks_of(held, 3)
    got = [link for k, one in enumerate(blocks) for m, two in enumerate(blocks[k:]) for link in images._Meeting(one, two, not m).links()]
    assert {tuple(sorted(x)) for x in got} <= links
    assert brute.roots(range(len(held)), got) == want


def test_images_that_look_alike_are_not_shuffled_by_pairs(spark, monkeypatch):
    """Images of three corners each, the same in all, are no copies: what is shuffled follows the images, not their pairs."""
    def points_are_pixels(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["__id"], batch["class"], batch["pixels"]], ["__id", "class", "points"])

    monkeypatch.setattr(images, "_map_keypoints", points_are_pixels)
    rng = np.random.default_rng(32)
    kinds = rng.integers(0, 256, (3, 32), dtype=np.uint8)
    rows = []
    for i in range(700):
        points = drawn_points(rng, kinds, 3)
        points["bits"] = kinds.view("V32")[:, 0]
        rows.append((i, points.tobytes(), len(points.tobytes()), 1))
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    most, over = [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            with contextlib.suppress(OSError):    # a file may go meanwhile
                most[0] = max(most[0], sum(f.stat().st_size for d in top for f in Path(d).rglob("shuffle_*.data")))

    frame = spark.createDataFrame(rows, "media_id long, pixels binary, width int, height int")
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = images.copies(frame).collect()
    finally:
        over.set()
        watcher.join()
    assert {r.media_id: r.component_id for r in got} == {i: i for i in range(700)}
    assert 0 < most[0] < 20 * sum(len(r[1]) for r in rows)


def test_corners_of_a_pale_part_are_kept(spark):
    """A crop that shows none of the strongest corners of its original."""
    rows = []
    for n in range(3):
        parts = images.render(np.random.default_rng(20 + n).normal(size=(4, 64))).astype(float)
        parts[3] = 127.5 + (parts[3] - 127.5) * 0.4
        whole = np.rint(np.block([[parts[0], parts[1]], [parts[2], parts[3]]])).astype(np.uint8)
        rows += [(2 * n, whole.tobytes(), 128, 128), (2 * n + 1, whole[60:, 60:].tobytes(), 68, 68)]
    got = images.copies(spark.createDataFrame(rows, "media_id long, pixels binary, width int, height int")).collect()
    assert {r.media_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(6)}


def test_every_match_proposes():
    one, two = np.zeros(105, images._PLACE), np.zeros(105, images._PLACE)
    one["x"], one["y"] = 10.0 * np.arange(105), 7.0 * np.arange(105)
    two["x"], two["y"] = one["x"] + 50.0 * np.arange(105), one["y"]
    two["x"][100:] = one["x"][100:] - 60
    assert images.agreeing(one, two) == 5


def test_temperature():
    tokens = {"big": 9000, "mid": 900, "small": 100, "none": 0}
    made = mixing.plan(tokens, target=0.8, most_repeats=50)
    shares = mixing.weights(tokens, made.exponent)
    assert mixing.entropy(shares) == pytest.approx(0.8 * np.log(3), rel=1e-6)
    assert made.quotas["big"] == pytest.approx(9000) and made.quotas["none"] == 0
    capped = mixing.plan(tokens, target=0.99, most_repeats=3)
    assert capped.quotas["small"] / 100 == pytest.approx(3, rel=1e-6) and capped.exponent > made.exponent
    assert mixing.plan({}).quotas == {}


def plain_mix(rows, columns, source, made, tokens):
    """Passes of each row (with its place in the permutation) by walking the permutation."""
    out = {}
    for s, quota in made.quotas.items():
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["block"], r["place"]))
        whole = int(quota / tokens[s] + 1e-9) if tokens[s] else 1
        rest = max(quota - whole * tokens[s], 0)
        total, open_ = 0, tokens[s] > 0
        ends = {}
        for r in mine:
            ends[(r["block"], r["place"])] = ends.get((r["block"], r["place"]), 0) + r["n"]
        for key in sorted(ends):
            total += ends[key]
            open_ = open_ and total <= rest + 1e-6
            for r in mine:
                if (r["block"], r["place"]) == key:
                    out.setdefault(r["id"], []).append(whole + open_)
    return out


@pytest.mark.parametrize("budget", [None, 3000.0])
def test_mixing_against_a_walk(spark, budget):
    rng = random.Random(3)
    rows = [(i, "src0" if i % 3 else f"src{i % 7}", " ".join(["w"] * rng.randint(0, 40))) for i in range(240)]
    docs = spark.createDataFrame(rows, "id long, source string, text string")
    tokens = {}
    for _, s, t in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    made = mixing.plan(tokens, 0.9, 4.0, budget)
    place = mixing.place([F.col(c) for c in docs.columns])
    placed = [dict(id=r.id, source=r.source, n=len(r.text.split()), place=r.place, block=r.block)
              for r in docs.withColumn("place", place).withColumn("block", mixing.block_of(place)).collect()]
    want = {i: sum(v) for i, v in plain_mix(placed, docs.columns, "source", made, tokens).items()}
    got = {r.id: r["count"] for r in mixing.mix(docs, target=0.9, budget=budget).groupBy("id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}
    if budget is None:
        assert set(got) == {i for i, *_ in rows}
        taken = sum(n * got[i] for (i, _, t) in rows for n in [len(t.split())])
        assert taken <= made.budget and taken > 0.9 * made.budget


def test_mixing_of_odd_documents(odd):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert out.distinct().count() == odd.distinct().count() and out.count() >= odd.count()
    assert mixing.mix(odd, pass_col="n").where("n = 0").count() == odd.count()
    assert mixing.mix(odd.limit(0)).count() == 0


def test_best_fit_places():
    rng = random.Random(0)
    for _ in range(200):
        counts = {(rng.randint(0, 8192) if rng.random() < 0.5 else rng.randint(0, 600)): rng.randint(1, 40)
                  for _ in range(rng.randint(0, 40))}
        made = packing.best_fit(counts)
        length = np.array([n for n, c in counts.items() for _ in range(c)], np.int64)
        rank = np.array([r for c in counts.values() for r in range(c)], np.int64)
        if not len(length):
            assert made.count == 0
            continue
        number, capacity, offset = made.places(length, rank)
        assert set(number.tolist()) == set(range(made.count))
        for b in range(made.count):
            mine = (number == b) & (length > 0)
            order = np.argsort(offset[mine])
            ends = np.cumsum(length[mine][order])
            assert (offset[mine][order] == ends - length[mine][order]).all()
            used = int(length[mine].sum())
            assert capacity[number == b][0] == min(c for c in packing.LENGTHS if c >= used)


def test_best_fit_takes_the_least_room_that_holds():
    made = packing.best_fit({60: 1, 50: 1, 40: 2}, lengths=(100,))
    number, _, _ = made.places(np.array([60, 50, 40, 40]), np.array([0, 0, 0, 1]))
    assert number.tolist() == [0, 1, 0, 1]


def test_packing_query_against_brute_force(spark):
    docs = {r.doc_id: len(brute.words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts, most = {}, max(packing.LENGTHS)
    for n in docs.values():
        for piece in [most] * (n // most) + [n % most] * (n % most > 0 or n == 0):
            counts[piece] = counts.get(piece, 0) + 1
    bins = {}
    for r in QUERIES["op7_best_fit_pack"](spark, SF).collect():
        bins.setdefault((r.bin_id, r.capacity), []).append(r.n_tokens)
    assert sorted((c, sum(n)) for (_, c), n in bins.items()) == brute.best_fit(counts, packing.LENGTHS)


def test_mixing_query_against_a_walk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    place = mixing.place([F.col(c) for c in docs.columns])
    placed = [dict(id=r.doc_id, source=r.source, n=len(brute.words(r.text)), place=r.place, block=r.block)
              for r in docs.withColumn("place", place).withColumn("block", mixing.block_of(place)).collect()]
    tokens = {}
    for r in placed:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n"]
    made = mixing.plan(tokens)
    want = {i: sum(v) for i, v in plain_mix(placed, docs.columns, "source", made, tokens).items()}
    rows = QUERIES["op9_temperature_mix"](spark, SF).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r["pass"])
    assert {i: len(v) for i, v in got.items()} == {i: n for i, n in want.items() if n}
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    lengths = {r["id"]: (r["source"], r["n"]) for r in placed}
    assert all((r.source, r.n_tokens) == lengths[r.doc_id] for r in rows)


def test_packing_of_odd_documents(odd):
    out = packing.pack(odd, lengths=(8, 64, 256)).collect()
    want = []
    for i, text in odd_documents():
        n = len((text or "").split())
        want += [(i or 0, k, k * 256, min(256, n - k * 256)) for k in range(max(1, -(-n // 256)))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.n_tokens) for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    for rows in bins.values():
        filled = sorted((r.bin_offset, r.n_tokens) for r in rows if r.n_tokens)
        at = 0
        for offset, n in filled:
            assert offset == at
            at += n
        assert at <= rows[0].capacity and len({r.capacity for r in rows}) == 1
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    docs = spark.range(100).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    out = packing.pack(docs, lengths=(4, 16)).collect()
    assert len({(r.bin_id, r.bin_offset) for r in out}) == 100


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_best_fit_pack"](spark, SF).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {i: len(brute.words(t)) for i, t in docs.items()}


def test_pipeline_stages(spark, odd, documents):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "private_spans", "temperature_mix", "best_fit_pack"]
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.mask_private, corpus_pipeline.mix_sources):
        assert stage(spark, documents, SF).columns == names
        assert stage(spark, odd, SF).columns == odd.columns
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_pipeline(spark, documents):
    from clinspan.llm import private_spans
    from clinspan.llm.stored import store

    rows = corpus_pipeline.run(spark, SF).collect()
    kept = store(corpus_pipeline.drop_toxic(spark, documents, SF), "t")
    docs = {r.doc_id: r for r in kept.collect()}
    found = brute.jaccard([(i, r.text) for i, r in docs.items()])
    alive = {i for i, (n, c) in found.items() if not n or c == i}
    weights = private_spans.fit(kept.where(F.col("doc_id").isin(list(alive))))
    words = {i: len(brute.words(private_spans.mask(docs[i].text or "", private_spans.all_spans(docs[i].text or "", weights)))) for i in alive}
    assert {r.doc_id for r in rows} == alive
    once = {}
    for r in rows:
        once.setdefault((r.doc_id, r.piece), set()).add((r.start, r.n_tokens))
    assert all(len(v) == 1 for v in once.values())
    assert {i: sum(n for (d, _), v in once.items() if d == i for _, n in v) for i in alive} == words
    assert len({(r.bin_id, r.bin_offset) for r in rows if r.n_tokens}) == sum(1 for r in rows if r.n_tokens)
