"""Queries over clinical notes: entities, identifiers, vocabulary matches, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinspan.fixed import patterns, vocabularies
from clinspan.functions import spans
from clinspan.functions.normalize import word_count
from clinspan.operators import lookup, notes, phi, records, terminology
from clinspan.plans import pipeline
from clinspan.session import shared_dir
from clinspan.sources import export, text_in
from registry import note_oracles as sql
from registry.inputs import FOLDERS, write_texts
from registry.oracle_views import rows as values
from registry.queries import joined, query
from registry.settings import KNOWN_NAMES


@query("text_read", "SELECT count(*) AS files, cast(sum(length(text)) AS bigint) AS chars FROM fx_note")
def _(x):
    # one file per document, as uploaded, in folders enough to be listed by tasks
    folders = write_texts(x.note.select("text", F.pmod("doc_id", F.lit(FOLDERS)).alias("part")), shared_dir("records"))
    return text_in.read_records(*folders).agg(
        F.count("*").alias("files"), F.sum(F.length(F.replace("text", F.lit("\x00"), F.lit("")))).alias("chars"))


@query("text_stats", sql.TEXT_STATS)
def _(x):
    return x.note.select("doc_id", F.length("text").alias("characters"), word_count(F.col("text")).alias("words"))


@query("span_find", sql.SPAN_FIND)
def _(x):
    return spans.rows_of(x.note.select("doc_id", spans.find_spans("text", r"\d+").alias("found")), "found", "doc_id")


@query("sentence_split", sql.SENTENCES)
def _(x):
    return spans.rows_of(x.note.select("doc_id", notes.sentences("text").alias("found")), "found", "doc_id").drop("text")


@query("section_detect", sql.SECTIONS)
def _(x):
    return spans.rows_of(x.note.select("doc_id", notes.sections("text").alias("found")), "found", "doc_id").drop("end")


@query("dictionary_containment", sql.CANDIDATES)
def _(x):
    return notes.candidates(x.note).select("doc_id", "start", "end", "trigger")


@query("dictionary_ner", sql.NER)
def _(x):
    return notes.candidates(x.note).select(
        "doc_id", "start", "end", "trigger", F.round("confidence", 2).alias("confidence"))


@query("resolve_overlaps", sql.RESOLVED)
def _(x):
    return notes.entity_rows(x.extracted).select("doc_id", "start", "end", F.lower("text").alias("trigger"))


def _flag(key, column, oracle):
    @query(key, oracle)
    def _(x):
        return notes.entity_rows(x.extracted).select("doc_id", "start", column)


_flag("negation_flag", "negated", sql.FLAG.format("negated"))
_flag("temporality_flag", "historical", sql.FLAG.format("historical"))
_flag("experiencer_flag", "subject", sql.FLAG.format("subject"))


@query("threshold_filter", sql.THRESHOLD)
def _(x):
    return notes.entity_rows(notes.extract(x.note.select("doc_id", "text"), 0.9)).select(
        "doc_id", "start", "concept", "confidence")


@query("note_extract", sql.EXTRACT)
def _(x):
    return notes.entity_rows(x.extracted).select(
        "doc_id", "text", "entity_type", "layer", "color", "start", "end", "vocabulary", "code", "concept",
        "semantic_tag", "confidence", "negated", "historical", "subject", "note", F.length("context").alias("context_chars"))


@query("extraction_stats", sql.STATS)
def _(x):
    return notes.stats(x.extracted).select("*").drop("threshold").withColumn(
        "vocabularies_used", F.array_join("vocabularies_used", ", "))


@query("notes_rollup", sql.ROLLUP)
def _(x):
    return notes.notes_rollup(x.extracted)


@query("operations_log", sql.OPERATIONS)
def _(x):
    return notes.operations(notes.stats(x.extracted))


@query("operations_text", sql.OPERATIONS_TEXT)
def _(x):
    return export.operations_text(x.extracted)


@query("entities_csv_write", sql.CSV_ROWS)
def _(x):
    folder = shared_dir("entities_csv")
    export.write_entity_csv(export.entity_csv_rows(x.extracted), folder)
    return x.spark.read.options(header=True, escape='"').csv(folder)


_DOCUMENT = """source_note string, stats struct<candidate_spans:bigint,entities_linked:bigint>, vocabularies_used array<string>,
    operations array<struct<step:int,count:bigint>>, entities array<struct<text:string,start:int,code:string,confidence:double,negated:boolean>>"""


@query("entities_json_write", sql.JSON)
def _(x):
    folder = shared_dir("entities_json")
    export.write_json(export.entity_json(x.extracted), folder)
    read = x.spark.read.text(folder).select(F.from_json("value", _DOCUMENT).alias("d")).select("d.*")
    told = F.transform("entities", lambda e: F.concat_ws(
        ":", e["start"].cast("string"), e["text"], e["code"], e["confidence"].cast("string"), e["negated"].cast("string")))
    return read.select("source_note", "stats.candidate_spans", "stats.entities_linked",
                       F.array_join("vocabularies_used", ", ").alias("vocabularies_used"),
                       F.size("operations").alias("steps"), F.array_join(told, "|").alias("entities"))


@query("annotated_html", sql.HTML)
def _(x):
    return export.annotated_html(x.extracted)


# --- identifiers -----------------------------------------------------------------------------


@query("phi_detect", sql.PHI_ROWS)
def _(x):
    return phi.phi_rows(phi.detect(x.note, known_names=KNOWN_NAMES))


@query("phi_mask", sql.PHI_MASK)
def _(x):
    return phi.detect(x.note, known_names=KNOWN_NAMES).select("doc_id", phi.mask(F.col("text"), F.col("phi")).alias("masked"))


@query("phi_summary", sql.PHI_SUMMARY)
def _(x):
    return phi.summary(phi.detect(x.note, known_names=KNOWN_NAMES)).select("doc_id", "total_phi_found", joined("types_found"))


@query("phi_by_type", sql.PHI_BY_TYPE)
def _(x):
    listed = phi.summary(phi.detect(x.note, known_names=KNOWN_NAMES)).select("doc_id", F.explode_outer("phi_by_type").alias("type", "found"))
    return listed.where(F.col("type").isNotNull()).select(
        "doc_id", "type", F.array_join(F.transform("found", lambda d: F.concat_ws(
            "~", d["text"], d["replacement"], d["confidence"].cast("string"))), "|").alias("found"))


@query("phi_type_counts", sql.PHI_TYPES)
def _(x):
    return phi.type_counts(phi.detect(x.note, known_names=KNOWN_NAMES))


# --- vocabulary matches ----------------------------------------------------------------------

CLINICAL, LABS, DRUGS, PROCEDURES = ("condition", "symptom"), ("lab_test", "vital_sign"), ("medication",), ("procedure",)


def _kind(*kinds):
    return f"(SELECT text AS t FROM ce_final WHERE type IN ({', '.join(map(repr, kinds))}))"


def _matched(x, kinds, match):
    """Match the text of every entity of some kinds that the notes hold."""
    rows = records.entity_rows(x.note).where(F.col("type").isin(*kinds))
    return rows.select("doc_id", "start", match(F.col("text"))["code"].alias("code"))


def _full_sql(kinds, best):
    listed = ", ".join(map(repr, kinds))
    return (f"SELECT doc_id, start, code FROM (SELECT doc_id, start, text AS t FROM ce_final WHERE type IN ({listed})) "
            f"LEFT JOIN ({best}) USING (t)")


def _overlap_sql(names, source):
    """Best entry per text ``t`` by shared words, from (name, code, term) rows in order."""
    table = values("name, code, term, ord", [(n.lower(), c, t, i) for i, (n, c, t) in enumerate(names)])
    return f"""SELECT t, code, term FROM (SELECT t, code, term, row_number() OVER (PARTITION BY t ORDER BY score DESC, ord) AS rn FROM (
        SELECT t, code, term, ord, shared / greatest(len(tw), len(cw)) AS score FROM (
            SELECT t, code, term, ord, tw, cw, len(list_intersect(tw, cw)) AS shared FROM
            (SELECT DISTINCT t, list_distinct(string_split_regex(lower(trim(t)), '\\s+')) AS tw FROM {source}),
            (SELECT code, term, ord, list_distinct(string_split_regex(name, '\\s+')) AS cw FROM ({table})))
        WHERE shared >= least(2, len(tw)) AND shared >= len(tw) * 0.6 AND shared > 0)) WHERE rn = 1"""


_SNOMED_NAMES = [(n, c, term) for c, term, syn, _ in vocabularies.SNOMED for n in [term, *syn]]
_ICD_NAMES = [(n, c, short) for c, short, long, _, _ in vocabularies.ICD10 for n in (short, long)]


_EVERY = (*CLINICAL, *LABS, *DRUGS, *PROCEDURES)
_DIAGNOSES = "(SELECT regexp_replace(admission_diagnosis, '\\s*\\(.*\\)$', '') AS t FROM fx_encounter WHERE admission_diagnosis IS NOT NULL)"


@query("token_overlap_match", _full_sql(_EVERY, _overlap_sql(_SNOMED_NAMES, _kind(*_EVERY))))
def _(x):
    return _matched(x, _EVERY, lambda t: terminology.overlap_match(t, terminology._snomed_names()))


@query("best_match", f"""SELECT encounter_id, code FROM (SELECT encounter_id, regexp_replace(admission_diagnosis, '\\s*\\(.*\\)$', '') AS t
    FROM fx_encounter WHERE admission_diagnosis IS NOT NULL) LEFT JOIN ({_overlap_sql(_ICD_NAMES, _DIAGNOSES)}) USING (t)""")
def _(x):
    """The diagnosis of every encounter, without its code, against the names of codes."""
    text = F.regexp_replace("admission_diagnosis", r"\s*\(.*\)$", "")
    rows = x.encounter.where("admission_diagnosis IS NOT NULL")
    return rows.select("encounter_id", terminology.icd10_match(text)["code"].alias("code"))


@query("icd10_match", _full_sql(CLINICAL, _overlap_sql(_ICD_NAMES, _kind(*CLINICAL))))
def _(x):
    return _matched(x, CLINICAL, terminology.icd10_match)


def _snomed_sql(source):
    exact = values("name, code, term, ord", [(n.lower(), c, t, i) for i, (n, c, t) in enumerate(_SNOMED_NAMES)])
    return f"""SELECT d.t, coalesce(e.code, b.code) AS code, coalesce(e.term, b.term) AS term FROM (SELECT DISTINCT t FROM {source}) d
    LEFT JOIN (SELECT name, arg_min(code, ord) AS code, arg_min(term, ord) AS term FROM ({exact}) GROUP BY 1) e ON e.name = lower(trim(d.t))
    LEFT JOIN ({_overlap_sql(_SNOMED_NAMES, source)}) b ON b.t = d.t"""


@query("snomed_match", _full_sql(CLINICAL, _snomed_sql(_kind(*CLINICAL))))
def _(x):
    return _matched(x, CLINICAL, terminology.snomed_match)


def _loinc_sql(source):
    table = values("code, term, short, component, ord", [
        (c, s, s.lower(), comp.lower(), i) for i, (c, comp, s, *_) in enumerate(vocabularies.LOINC)])
    return f"""SELECT t, arg_min(code, ord) AS code, arg_min(term, ord) AS term FROM (
        SELECT t, coalesce(target, lower(trim(t))) AS key FROM (SELECT DISTINCT t FROM {source})
        LEFT JOIN ({values("alias, target", patterns.LAB_ALIASES)}) ON alias = lower(trim(t)))
        JOIN ({table}) ON contains(short, key) OR contains(component, key) GROUP BY 1"""


@query("loinc_match", _full_sql(LABS, _loinc_sql(_kind(*LABS))))
def _(x):
    return _matched(x, LABS, terminology.loinc_match)


def _rxnorm_sql(source):
    table = values("code, term, name, generic, ord", [
        (c, n, n.lower(), g.lower(), i) for i, (c, n, g, *_) in enumerate(vocabularies.RXNORM)])
    exact = values("brand, code, term, ord", [
        (b.lower(), c, n, i) for i, (c, n, g, brands, *_) in enumerate(vocabularies.RXNORM) for b in (n, g, *brands)])
    return f"""SELECT t, coalesce(ec, pc) AS code, coalesce(et, pt) AS term FROM (
        SELECT t, d, arg_min(x.code, x.ord) AS ec, arg_min(x.term, x.ord) AS et FROM (
            SELECT DISTINCT t, trim(regexp_replace(lower(trim(t)), '\\s*\\d+\\s*(mg|mcg|ml|units?|g)\\b.*', '')) AS d FROM {source})
        LEFT JOIN ({exact}) x ON brand = d GROUP BY 1, 2) LEFT JOIN (
        SELECT d, arg_min(y.code, y.ord) AS pc, arg_min(y.term, y.ord) AS pt FROM (
            SELECT DISTINCT trim(regexp_replace(lower(trim(t)), '\\s*\\d+\\s*(mg|mcg|ml|units?|g)\\b.*', '')) AS d FROM {source})
        JOIN ({table}) y ON starts_with(name, d) OR starts_with(generic, d) GROUP BY 1) USING (d) WHERE d <> ''"""


@query("rxnorm_match", _full_sql(DRUGS, _rxnorm_sql(_kind(*DRUGS))))
def _(x):
    return _matched(x, DRUGS, terminology.rxnorm_match)


def _cpt_sql(source):
    table = values("code, term, short, long, ord", [
        (c, s, s.lower(), l.lower(), i) for i, (c, s, l, _) in enumerate(vocabularies.CPT)])
    return f"""SELECT t, arg_min(code, ord) AS code, arg_min(term, ord) AS term FROM (SELECT DISTINCT t FROM {source})
        JOIN ({table}) ON contains(short, lower(t)) OR contains(long, lower(t)) GROUP BY 1"""


@query("cpt_match", _full_sql(PROCEDURES, _cpt_sql(_kind(*PROCEDURES))))
def _(x):
    return _matched(x, PROCEDURES, terminology.cpt_match)


# --- whole records ---------------------------------------------------------------------------


@query("clinical_entities", sql.ENTITIES)
def _(x):
    return records.entity_rows(x.note)


_CLINICAL, _LAB = _kind("condition", "symptom"), _kind("lab_test", "vital_sign")
_MAPPED = f"""SELECT 'c' AS route, t, coalesce(s.code, i.code) AS code, coalesce(s.term, i.term) AS term,
        CASE WHEN s.code IS NOT NULL THEN 'SNOMED CT' WHEN i.code IS NOT NULL THEN 'ICD-10-CM' END AS system
        FROM ({_snomed_sql(_CLINICAL)}) s LEFT JOIN ({_overlap_sql(_ICD_NAMES, _CLINICAL)}) i USING (t)
    UNION ALL SELECT 'm', t, code, term, CASE WHEN code IS NOT NULL THEN 'RxNorm' END FROM ({_rxnorm_sql(_kind("medication"))})
    UNION ALL SELECT 'p', t, code, term, 'CPT' FROM ({_cpt_sql(_kind("procedure"))})
    UNION ALL SELECT 'l', t, code, term, 'LOINC' FROM ({_loinc_sql(_LAB)})"""


_MAPPED_ROWS = f"""SELECT doc_id, start, text, type, context, CASE type WHEN 'condition' THEN 'conditions' WHEN 'symptom' THEN 'symptoms'
    WHEN 'medication' THEN 'medications' WHEN 'procedure' THEN 'procedures' WHEN 'lab_test' THEN 'lab_tests' ELSE 'vital_signs' END AS bucket,
    term AS normalized_term, code AS terminology_code, system AS terminology_system
    FROM (SELECT *, CASE WHEN type IN ('condition', 'symptom') THEN 'c' WHEN type = 'medication' THEN 'm'
        WHEN type = 'procedure' THEN 'p' ELSE 'l' END AS route FROM ce_final) e
    LEFT JOIN ({_MAPPED}) m ON m.t = e.text AND m.route = e.route"""


@query("map_entity", f"SELECT * EXCLUDE (context) FROM ({_MAPPED_ROWS})")
def _(x):
    return records.mapped_entities(x.note).select(
        "doc_id", "start", "text", "type", "bucket", "normalized_term", "terminology_code", "terminology_system")


@query("record_process", f"""SELECT r.*, coalesce(told, '') AS entities, types_found FROM ({sql.RECORDS}) r JOIN ({sql.PHI_SUMMARY}) USING (doc_id)
    LEFT JOIN (SELECT doc_id, string_agg(concat_ws('~', bucket, text, terminology_code, terminology_system, normalized_term, length(context)), '|'
        ORDER BY start) AS told FROM ({_MAPPED_ROWS}) GROUP BY 1) USING (doc_id)""")
def _(x):
    rows = records.process(x.note, KNOWN_NAMES)
    told = F.transform("entities", lambda e: F.concat_ws(
        "~", e["bucket"], e["text"], e["terminology_code"], e["terminology_system"], e["normalized_term"],
        F.length(e["context"]).cast("string")))
    return rows.select(*[c for c in rows.columns if c not in ("entities", "phi", "mappings", "phi_summary")],
                       F.array_join(told, "|").alias("entities"),
                       F.array_join("phi_summary.types_found", "; ").alias("types_found"))


@query("step_report", sql.PIPELINE)
def _(x):
    return pipeline.step_report(x.patient, x.encounter, x.observation, x.cdm, x.people, x.tokens_config, counts=x.counts)


# --- vocabularies and dictionaries that are tables ---------------------------------------------

_PART_NAMES = "(SELECT p_partkey AS ord, lower(p_name || ' ' || p_type || ' ' || p_brand) AS name FROM part)"
_PART_TEXTS = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN upper(p_name) || '  old ' || p_brand
    WHEN l_linenumber % 4 = 1 THEN p_type || ' ' || p_name WHEN l_linenumber % 4 = 2 THEN 'a ' || p_brand || ' of ' || l_suppkey || ' ' || p_type
    ELSE p_name || ' ' || p_type || ' ' || p_brand END AS t FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("vocabulary_match", f"""SELECT * FROM (WITH texts AS (SELECT DISTINCT t, list_distinct(regexp_extract_all(lower(t), '\\S+')) AS mine FROM {_PART_TEXTS}),
    names AS (SELECT ord, list_distinct(string_split(name, ' ')) AS theirs FROM {_PART_NAMES}),
    pairs AS (SELECT t, ord, len(list_intersect(mine, theirs)) AS shared, len(mine) AS n, greatest(len(mine), len(theirs)) AS most FROM texts, names),
    best AS (SELECT t, arg_min(ord, (-shared / most, ord)) AS ord FROM pairs
        WHERE shared >= least(2, n) AND shared >= n * 0.6 GROUP BY t)
    SELECT l_orderkey, l_linenumber, cast(ord AS varchar) AS code FROM {_PART_TEXTS} LEFT JOIN best USING (t))""")
def _(x):
    """Lines of text about parts, matched to the names of all parts by shared words."""
    parts = x._derive("SELECT p_partkey AS ord, cast(p_partkey AS string) AS code, p_name || ' ' || p_type || ' ' || p_brand AS description,"
                      " CAST(NULL AS string) AS long_description FROM {part}", "part")
    texts = x._derive(f"SELECT * FROM {_PART_TEXTS}".replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"), "lineitem", "part")
    return lookup.match(texts, "icd10", parts, "t").select("l_orderkey", "l_linenumber", F.col("match.code").alias("code"))


_PHRASES = """(SELECT DISTINCT array_to_string(w[s:s + 1], ' ') AS phrase FROM (SELECT w, unnest(range(1, len(w))) AS s
    FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)) WHERE lower(w[s]) <> lower(w[s + 1]))"""


@query("phrase_table_match", f"""SELECT * FROM (WITH pieces AS (SELECT doc_id, phrase, string_split(lower(text), lower(phrase)) AS p, length(phrase) AS size
        FROM documents JOIN {_PHRASES} ON contains(lower(text), lower(phrase))),
    cut AS (SELECT doc_id, phrase, size, unnest(range(1, len(p))) AS i, p FROM pieces),
    hits AS (SELECT doc_id, phrase, list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * size AS start FROM cut
        WHERE NOT regexp_matches(CASE WHEN p[i] = '' AND i > 1 THEN 'x' ELSE right(p[i], 1) END, '[A-Za-z0-9]')
        AND NOT regexp_matches(CASE WHEN p[i + 1] = '' AND i + 1 < len(p) THEN 'x' ELSE left(p[i + 1], 1) END, '[A-Za-z0-9]'))
    SELECT lower(phrase) AS phrase, count(DISTINCT doc_id) AS documents, count(*) AS hits, cast(sum(start) AS bigint) AS starts
    FROM (SELECT DISTINCT doc_id, lower(phrase) AS phrase, start FROM hits) GROUP BY 1)""")
def _(x):
    """Pairs of different words of the benchmark, looked up in all documents."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    pairs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    dictionary = x.table("benchmark").select(F.explode(pairs).alias("phrase")).select(F.lower("phrase").alias("phrase")).where(
        F.split("phrase", " ")[0] != F.element_at(F.split("phrase", " "), -1)).distinct()
    found = lookup.phrases(x.table("documents").select("doc_id", "text"), dictionary)
    return found.groupBy("phrase").agg(
        F.count_distinct("doc_id").alias("documents"), F.count("*").alias("hits"), F.sum("start").cast("bigint").alias("starts"))
