"""Registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    from clinspan.llm.repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["stop"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_jaccard_join")
def op10(spark, sf_dir):
    from clinspan.llm.signature_trees import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + length(regexp_replace(role || text, '[^\\|]', '', 'g')) + 24)::BIGINT
    AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op1_chat_format", OP1_SQL)
def op1(spark, sf_dir):
    from clinspan.llm import chat

    both = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_chat(turns.withColumn("parts", chat.text_parts(F.coalesce("text", F.lit("")))))
    read = out.select(
        "conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"),
        chat.read_chat(F.col("formatted")).alias("turns"),
        chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.aggregate("loss", F.lit(0).cast("long"), lambda n, t: n + F.char_length(t)).alias("loss_chars"),
        F.sha2(F.array_join("loss", "").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


@query("op3_toxicity")
def op3(spark, sf_dir):
    from clinspan.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold != 1)
    model = toxicity.fit(docs, labels)
    return toxicity.score_documents(docs, model).select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


@query("op4_private_spans")
def op4(spark, sf_dir):
    from clinspan.llm import private_spans

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = private_spans.find_private(docs, private_spans.fit(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.withColumn("base", F.filter("spans", lambda s: s["base"])).select(
        "doc_id", *[count(kind) for kind in private_spans.KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op5_vector_near_dedup")
def op5(spark, sf_dir):
    from clinspan.llm.vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_ppm_score")
def op6(spark, sf_dir):
    from clinspan.llm import ppm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    out = ppm.score_documents(docs, ppm.train(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), *out.columns[1:])


@query("op9_temperature_mix")
def op9(spark, sf_dir):
    from clinspan.llm import mixing

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, pass_col="pass")
    return mixed.select("doc_id", "source", "pass", mixing.word_count(F.col("text")).alias("n_tokens"))


@query("op7_best_fit_pack")
def op7(spark, sf_dir):
    from clinspan.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query("op2_image_copies")
def op2(spark, sf_dir):
    from clinspan.llm import images

    return images.copies(images.media_of(table(spark, sf_dir, "embeddings")))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc, size, s, array_to_string(w[s:s + size - 1], ' ') AS phrase
  FROM (SELECT doc, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT doc, item_id, p.size, s FROM places p JOIN windows i ON p.size = i.size AND p.phrase = i.phrase),
hit AS (SELECT doc, count(DISTINCT pos) AS n FROM (SELECT doc, unnest(range(s, s + size)) AS pos FROM found) GROUP BY doc),
held AS (
  SELECT doc, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc, item_id::VARCHAR AS item FROM found) GROUP BY doc)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc) LEFT JOIN held USING (doc)"""


@query("op11_decontaminate", OP11_SQL)
def op11(spark, sf_dir):
    from clinspan.llm import positional_index

    out = positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
phrases AS (
  SELECT lang, size, array_to_string(w[s:s + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM cut, range(1, 5) t(size) WHERE len(w) >= size)),
counted AS (SELECT lang, size, phrase, count(*) AS a FROM phrases GROUP BY lang, size, phrase HAVING count(*) >= 30),
long AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM long) c
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
least_cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_size AS (SELECT *, unnest(range(2, size)) AS short FROM long),
inside AS (
  SELECT lang, array_to_string(w[s:s + short - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - short + 2)) AS s FROM inner_size) GROUP BY ALL),
ranked AS (
  SELECT c.lang, c.phrase, a, l, r, score, row_number() OVER (
    PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
  FROM least_cut c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query("op12_collocations", OP12_SQL)
def op12(spark, sf_dir):
    from clinspan.llm import collocations

    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE values_of AS (
  SELECT doc_id, lang, coalesce(n_chars, 0) AS chars, n_chars IS NULL AS none,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS inverted
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp,
    sha256(head || CASE WHEN none THEN '-' ELSE strlen(chars::VARCHAR) || ':' || chars END || tail) AS leaf,
    sha256(head || CASE WHEN none THEN '-' ELSE strlen((chars + bad)::VARCHAR) || ':' || (chars + bad) END || tail) AS tampered
  FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND xor(inverted, 4294967295::BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS bad FROM values_of)),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM leaves),
tree AS (
  SELECT grp, 0 AS lvl, list(leaf ORDER BY slot) AS nodes FROM placed GROUP BY grp
  UNION ALL
  SELECT grp, lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM tree WHERE len(nodes) > 1),
subroots AS (
  SELECT grp, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS slot FROM tree WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS lvl, list(subroot ORDER BY slot) AS nodes FROM subroots
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM top WHERE len(nodes) > 1),
levels AS (SELECT grp, list(nodes ORDER BY lvl) AS levels FROM tree GROUP BY grp),
tops AS (SELECT list(nodes ORDER BY lvl) AS levels FROM top),
steps AS (
  SELECT doc_id, leaf, tampered, subroot, t.levels[len(t.levels)][1] AS root,
    list_concat(
      list_transform(range(0, len(l.levels) - 1), lambda k: {'odd': (p.slot // (1 << k)) % 2 = 1, 'node': coalesce(l.levels[k + 1][
        CASE WHEN (p.slot // (1 << k)) % 2 = 1 THEN p.slot // (1 << k) ELSE p.slot // (1 << k) + 2 END], '')}),
      list_transform(range(0, len(t.levels) - 1), lambda k: {'odd': (s.slot // (1 << k)) % 2 = 1, 'node': coalesce(t.levels[k + 1][
        CASE WHEN (s.slot // (1 << k)) % 2 = 1 THEN s.slot // (1 << k) ELSE s.slot // (1 << k) + 2 END], '')})) AS path
  FROM placed p JOIN levels l USING (grp) JOIN subroots s USING (grp), tops t),
folded AS (
  SELECT *, list_reduce(list_prepend({'odd': false, 'node': tampered}, path),
    lambda x, y: {'odd': false, 'node': sha256(CASE WHEN y.odd THEN y.node || x.node ELSE x.node || y.node END)}).node AS folded_root
  FROM steps)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.node), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark, sf_dir):
    from clinspan.llm import merkle

    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns]
    out = merkle.manifest(
        table(spark, sf_dir, "documents"), columns, carry={"tampered": F.when(chosen, merkle.row_digest(changed))})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return out.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
