"""DuckDB SQL for the note operators.

RE2 has no look-around, so phrase borders and sentence ends are checked on the neighbouring
characters, phrases are looked up one by one, and overlaps are resolved by following pointers.
"""

from __future__ import annotations

from clinspan.fixed import concepts, lexicon, patterns
from registry.oracle_views import VIEWS, quoted, rows
from registry.settings import KNOWN_NAMES

WS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
_CLASSES = {c[0]: c for c in lexicon.ENTITY_CLASSES}
_TRIGGERS = []
for _i, (_phrases, _kind, _vocab, _code, _term, _tag, _conf, _note) in enumerate(lexicon.CONCEPTS):
    for _p in _phrases:
        _TRIGGERS.append((_p, _i, _kind, _CLASSES[_kind][1], _CLASSES[_kind][2], _CLASSES[_kind][3], _vocab,
                          _code, _term, _tag, min(_conf + (0.02 if _p == _term.lower() else 0), 0.99), _note))


def located(source: str, pattern: str) -> str:
    """doc_id, start, end, m of every match, by bracketing matches and splitting at the brackets."""
    return f"""SELECT doc_id, cast(start - length(m) AS bigint) AS start, cast(start AS bigint) AS "end", m FROM (
        SELECT doc_id, i, split_part(p, chr(2), 1) AS m,
            sum(CASE WHEN i = 0 THEN length(p) ELSE length(p) - 1 END) OVER (PARTITION BY doc_id ORDER BY i)
            - CASE WHEN i = 0 THEN 0 ELSE length(split_part(p, chr(2), 2)) END AS start
        FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (
            SELECT doc_id, string_split(regexp_replace(text, {quoted('(' + pattern + ')')},
                chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM {source}))) WHERE i > 0"""


def any_of(text: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(c)})" for c in cues) + ")"


def note_views(prefix: str, source: str) -> None:
    """Views of all stages over (doc_id, text) rows of ``source``."""
    p = prefix
    VIEWS[f"{p}sent"] = f"""SELECT doc_id, start, start + length(s) AS "end", s FROM (
        SELECT doc_id, s, cast(coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start
        FROM (SELECT doc_id, unnest(ps) AS s, unnest(range(len(ps))) AS i FROM (
            SELECT doc_id, string_split(regexp_replace(regexp_replace(text,
                '([.!?]+)({WS}|$)', '\\1' || chr(1) || '\\2', 'g'),
                '(\\n{WS}*\\n)', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM {source})))
        WHERE regexp_matches(s, '[^' || {quoted(WS[1:])})"""
    VIEWS[f"{p}sect"] = f"""SELECT doc_id, start, trim(regexp_replace(m, '^{WS}+|:$', '', 'g')) AS name
        FROM ({located(source, '(?m:^)' + WS + '*[A-Z][A-Z /&-]{3,}:')})"""
    VIEWS.setdefault("trig", rows(
        "trigger, ord, kind, label, layer, color, vocabulary, code, concept, tag, conf, note", _TRIGGERS).replace(
        "SELECT * FROM", "SELECT * REPLACE (cast(conf AS double) AS conf) FROM", 1))
    VIEWS[f"{p}cand"] = f"""SELECT doc_id, trigger, start, start + length(trigger) AS "end", conf FROM (
        SELECT doc_id, trigger, conf, txt, i, n, cast(sum(length(p)) OVER (PARTITION BY doc_id, trigger ORDER BY i)
            + i * length(trigger) AS bigint) AS start
        FROM (SELECT doc_id, trigger, conf, txt, len(ps) AS n, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (
            SELECT doc_id, trigger, conf, txt, string_split(txt, trigger) AS ps
            FROM (SELECT doc_id, lower(text) AS txt FROM {source}) JOIN trig ON contains(txt, trigger))))
        WHERE i < n - 1 AND NOT regexp_matches(CASE WHEN start = 0 THEN ' ' ELSE substr(txt, start, 1) END, '[a-z0-9]')
          AND NOT regexp_matches(substr(txt, start + length(trigger) + 1, 1), '[a-z0-9]')"""
    VIEWS[f"{p}longest"] = f"""SELECT doc_id, start, arg_max(trigger, length(trigger)) AS trigger, max("end") AS "end"
        FROM {p}cand GROUP BY 1, 2"""
    VIEWS[f"{p}ptr"] = f"""SELECT a.doc_id, a.start, a."end", a.trigger, b.start AS nxt,
        row_number() OVER (PARTITION BY a.doc_id ORDER BY a.start) AS rn
        FROM {p}longest a ASOF LEFT JOIN {p}longest b ON a.doc_id = b.doc_id AND a."end" <= b.start"""
    VIEWS[f"{p}kept"] = f"""SELECT doc_id, start, "end", trigger, nxt FROM {p}ptr WHERE rn = 1
        UNION ALL SELECT q.doc_id, q.start, q."end", q.trigger, q.nxt
        FROM {p}kept k JOIN {p}ptr q ON q.doc_id = k.doc_id AND q.start = k.nxt"""
    VIEWS[f"{p}placed"] = f"""SELECT k.doc_id, k.start, k."end", k.trigger, s.s AS sentence, k.start - s.start AS rel,
        lower(replace(s.s, chr(10), ' ')) AS flat, lower(coalesce(h.name, '')) AS header,
        t.* EXCLUDE (trigger)
        FROM {p}kept k JOIN trig t ON t.trigger = k.trigger
        JOIN {p}sent s ON s.doc_id = k.doc_id AND s.start <= k.start AND k.start < s."end"
        ASOF LEFT JOIN {p}sect h ON h.doc_id = k.doc_id AND h.start <= k.start"""
    before = "lower(replace(substr(sentence, cast(greatest(rel - 45, 0) + 1 AS bigint), cast(least(rel, 45) AS bigint)), chr(10), ' '))"
    after = "lower(replace(substr(sentence, cast(rel + length(trigger) + 1 AS bigint), 30), chr(10), ' '))"
    VIEWS[f"{p}ent"] = f"""SELECT *, round(conf, 2) AS confidence, family AND layer = 'clinical' AS fam_flag,
        CASE WHEN family AND layer = 'clinical' THEN 'family' ELSE 'patient' END AS subject,
        NOT family AND NOT present AND past AS historical FROM (
        SELECT *, ({any_of(before, lexicon.NEGATION_BEFORE)} OR {any_of(after, lexicon.NEGATION_AFTER)}) AS negated,
            (contains(header, 'family history') OR {any_of('flat', lexicon.FAMILY_CUES)}) AS family,
            (contains(header, 'present illness') OR contains(flat, 'present illness')) AS present,
            (contains(header, 'past') OR contains(header, 'pmh') OR {any_of('flat', lexicon.HISTORY_CUES)}) AS past
        FROM {p}placed)"""


note_views("n_", "fx_note")
VIEWS["enc_note"] = "SELECT encounter_id AS doc_id, clinical_notes AS text FROM fx_encounter WHERE clinical_notes <> ''"
note_views("e_", "enc_note")
VIEWS["n_stats"] = rf"""SELECT doc_id, characters, words, coalesce(se.c, 0) AS sentences, coalesce(h.c, 0) AS sections,
    coalesce(ca.c, 0) AS candidate_spans, coalesce(e.c, 0) AS entities_linked, coalesce(e.c, 0) AS entities_passed_threshold,
    0 AS entities_below_threshold, coalesce(neg, 0) AS negated_entities, coalesce(hist, 0) AS historical_entities,
    coalesce(fam, 0) AS family_entities, coalesce(clin, 0) AS clinical_layer, coalesce(mol, 0) AS molecular_layer,
    coalesce(vocabs, '') AS vocabularies_used, coalesce(nv, 0) AS nv
    FROM (SELECT doc_id, length(text) AS characters, len(regexp_extract_all(text, '[^{WS[1:-1]}]+')) AS words FROM fx_note)
    LEFT JOIN (SELECT doc_id, count(*) AS c FROM n_sent GROUP BY 1) se USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS c FROM n_sect GROUP BY 1) h USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS c FROM n_cand GROUP BY 1) ca USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS c, count(*) FILTER (WHERE negated) AS neg, count(*) FILTER (WHERE historical) AS hist,
        count(*) FILTER (WHERE fam_flag) AS fam, count(*) FILTER (WHERE layer = 'clinical') AS clin,
        count(*) FILTER (WHERE layer = 'molecular') AS mol, count(DISTINCT vocabulary) AS nv,
        array_to_string(list_sort(list(DISTINCT vocabulary)), ', ') AS vocabs FROM n_ent GROUP BY 1) e USING (doc_id)"""

TEXT_STATS = f"SELECT doc_id, length(text) AS characters, len(regexp_extract_all(text, '[^{WS[1:-1]}]+')) AS words FROM fx_note"
SPAN_FIND = f"""SELECT doc_id, start, "end", m AS text FROM ({located('fx_note', '[0-9]+')})"""
SENTENCES = 'SELECT doc_id, start, "end" FROM n_sent'
SECTIONS = "SELECT doc_id, start, name FROM n_sect"
CANDIDATES = 'SELECT doc_id, start, "end", trigger FROM n_cand'
NER = 'SELECT doc_id, start, "end", trigger, round(conf, 2) AS confidence FROM n_cand'
RESOLVED = 'SELECT doc_id, start, "end", trigger FROM n_kept'
FLAG = "SELECT doc_id, start, {} FROM n_ent"
THRESHOLD = "SELECT doc_id, start, concept, confidence FROM n_ent WHERE conf >= 0.9"
EXTRACT = f"""SELECT doc_id, substr(text, cast(start + 1 AS bigint), length(trigger)) AS text, kind AS entity_type, layer, color, start, "end",
    vocabulary, code, concept, tag AS semantic_tag, confidence, negated, historical, subject, note,
    length(regexp_replace(sentence, '^{WS}+|{WS}+$', '', 'g')) AS context_chars
    FROM n_ent JOIN (SELECT doc_id, text FROM fx_note) USING (doc_id)"""
STATS = "SELECT * EXCLUDE (nv) FROM n_stats"
ROLLUP = """SELECT (SELECT count(*) FROM fx_note) AS notes, (SELECT count(*) FROM n_cand) AS candidate_spans,
    (SELECT count(*) FROM n_kept) AS entities_linked,
    (SELECT count(*) FROM n_ent WHERE vocabulary = 'SNOMED CT') AS snomed_concepts"""
OPERATIONS = """SELECT doc_id, 1 AS step, 'Document parsed' AS operation,
        characters || ' characters, ' || words || ' tokens ingested' AS detail, characters AS count FROM n_stats
    UNION ALL SELECT doc_id, 2, 'Segmentation', 'Split into ' || sentences || ' sentences across ' || sections || ' sections', sentences FROM n_stats
    UNION ALL SELECT doc_id, 3, 'Named-entity recognition (MedCAT-style)', candidate_spans || ' candidate spans detected', candidate_spans FROM n_stats
    UNION ALL SELECT doc_id, 4, 'Overlap resolution', entities_linked || ' spans retained after longest-match resolution', entities_linked FROM n_stats
    UNION ALL SELECT doc_id, 5, 'Entity linking', 'Linked to SNOMED CT / HGNC / HGVS / ClinVar / LOINC (' || nv || ' vocabularies)', entities_linked FROM n_stats
    UNION ALL SELECT doc_id, 6, 'Context detection (MetaCAT-style)', 'Negation=' || negated_entities || ', Historical=' || historical_entities
        || ', Family=' || family_entities, entities_passed_threshold FROM n_stats
    UNION ALL SELECT doc_id, 7, 'Confidence threshold ≥ 0.50', entities_passed_threshold || ' entities passed, 0 below threshold', entities_passed_threshold FROM n_stats
    UNION ALL SELECT doc_id, 8, 'Structured export ready',
        'Entities available as CSV / JSON / annotated HTML; flow into de-id → OMOP → cohort', entities_passed_threshold FROM n_stats"""
CSV_ROWS = f"""SELECT substr(text, cast(start + 1 AS bigint), length(trigger)) AS span_text, label AS entity_type, layer, vocabulary,
    concept, code, cast(confidence AS varchar) AS confidence, CASE WHEN negated THEN 'yes' ELSE 'no' END AS negated,
    CASE WHEN historical THEN 'yes' ELSE 'no' END AS historical, subject,
    replace(regexp_replace(sentence, '^{WS}+|{WS}+$', '', 'g'), chr(10), ' ') AS context
    FROM n_ent JOIN (SELECT doc_id, text FROM fx_note) USING (doc_id)"""


def _esc(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


HTML = f"""SELECT doc_id, '<!doctype html><html><head><meta charset="utf-8"><title>Annotated note</title></head>'
    || '<body style="font-family:monospace;white-space:pre-wrap;line-height:1.8">' || coalesce(marked, '')
    || {_esc("substr(text, cast(coalesce(last, 0) + 1 AS bigint))")} || '</body></html>' AS html
    FROM fx_note LEFT JOIN (SELECT doc_id, max("end") AS last, string_agg(
        {_esc("substr(text, cast(prev + 1 AS bigint), cast(start - prev AS bigint))")}
        || '<span style="background:' || color || '22;border:1px solid ' || color || '66;border-radius:3px;padding:0 2px;'
        || CASE WHEN negated THEN 'text-decoration:line-through;' ELSE '' END
        || CASE WHEN historical THEN 'font-style:italic;' ELSE '' END
        || '" title="' || {_esc("concept")} || ' [' || vocabulary || ' ' || code || '] conf=' || confidence || '">'
        || {_esc("substr(text, cast(start + 1 AS bigint), length(trigger))")} || '</span>', '' ORDER BY start) AS marked
        FROM (SELECT e.*, text, coalesce(lag(e."end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev
              FROM n_ent e JOIN (SELECT doc_id, text FROM fx_note) USING (doc_id)) GROUP BY 1) USING (doc_id)"""

_COUNTS = """(SELECT (SELECT count(*) FROM fx_patient) AS records, (SELECT count(DISTINCT patient_token) FROM tmap) AS people,
    (SELECT count(*) FROM fx_encounter) AS encounters, (SELECT count(*) FROM fx_observation) AS observations,
    (SELECT count(*) FROM visit) AS visits, (SELECT count(*) FROM cond) AS conds, (SELECT count(*) FROM meas) AS labs,
    (SELECT count(*) FROM drug) AS drugs, (SELECT count(*) FROM enc_note) AS notes, (SELECT count(*) FROM e_cand) AS cands,
    (SELECT count(*) FROM e_kept) AS linked, (SELECT count(*) FROM e_ent WHERE vocabulary = 'SNOMED CT') AS snomed)"""
_STEPS = [
    (1, "Clinical Text Extraction & SNOMED Annotation", [("entities_linked", "linked"), ("clinical_notes_processed", "notes"),
                                                         ("candidate_spans", "cands"), ("snomed_concepts", "snomed")]),
    (2, "Data Generation", [("unique_patients", "people"), ("source_records", "records"), ("encounters", "encounters"),
                            ("observations", "observations")]),
    (3, "Patient Linkage (Tokenization)", [("unique_patients", "people"), ("source_records_linked", "records"),
                                           ("duplicate_records_linked", "records - people")]),
    (4, "De-identification (PDPL + HiPS)", [("unique_patients", "people"), ("records_deidentified", "records")]),
    (5, "OMOP CDM Transformation", [("unique_patients", "people"), ("visits", "visits"), ("conditions", "conds"),
                                    ("measurements", "labs"), ("drugs", "drugs")]),
    (6, "Cohort & Analytics Ready", [("unique_patients", "people"), ("visits", "visits"), ("conditions", "conds"),
                                     ("measurements", "labs"), ("drug_exposures", "drugs")]),
]
PIPELINE = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {n} AS step, {quoted(name)} AS name, '{figure}' AS figure, {value} AS value,"
    f" {quoted(concepts.DEID_METHOD) if n == 4 else 'CAST(NULL AS varchar)'} AS method FROM counts"
    for n, name, figures in _STEPS for figure, value in figures) + ")"
VIEWS["counts"] = f"SELECT * FROM {_COUNTS}"

OPERATIONS_TEXT = f"""SELECT doc_id, 'CLINICAL TEXT EXTRACTION — OPERATIONS / AUDIT LOG' || chr(10) || 'Threshold: 0.5' || chr(10) || chr(10)
    || string_agg('[' || step || '] ' || operation || chr(10) || '      ' || detail || '  (count: ' || count || ')', chr(10) ORDER BY step)
    || chr(10) || chr(10) || 'Vocabularies used: ' || any_value(vocabularies_used) AS log
    FROM ({OPERATIONS}) JOIN (SELECT doc_id, vocabularies_used FROM n_stats) USING (doc_id) GROUP BY doc_id"""

# --- identifiers and clinical entities -------------------------------------------------------
# RE2's \b and \w know ASCII only. Other letters become "_", which is a word character outside
# [A-Za-z0-9], and other blanks become " "; both keep every offset.
VIEWS["plain"] = r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[\x0b\x1c-\x1f\x{85}\pZ]', ' ', 'g'),
    '[^\x00-\x7f]', '_', 'g') AS text FROM fx_note"""


def _hits(kinds: list[tuple]) -> str:
    return " UNION ALL ".join(
        f"""SELECT doc_id, start, "end", {place} AS place, '{kind}' AS type, {conf}::DOUBLE AS confidence
        FROM ({located('plain', '(?i:' + pattern + ')')})""" for place, (kind, conf, pattern) in enumerate(kinds))


def _chain(name: str, source: str) -> None:
    """``name``: the spans of ``source`` (one per start) kept when walking left to right."""
    VIEWS[f"{name}_ptr"] = f"""SELECT a.*, b.start AS nxt, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.start) AS rn
        FROM {source} a ASOF LEFT JOIN (SELECT doc_id, start FROM {source}) b ON a.doc_id = b.doc_id AND a."end" <= b.start"""
    VIEWS[name] = f"""SELECT doc_id, start, "end", place, type, confidence, nxt FROM {name}_ptr WHERE rn = 1
        UNION ALL SELECT q.doc_id, q.start, q."end", q.place, q.type, q.confidence, q.nxt
        FROM {name} k JOIN {name}_ptr q ON q.doc_id = k.doc_id AND q.start = k.nxt"""


_KNOWN = len(KNOWN_NAMES)
VIEWS["phi_hits"] = _hits(
    [("name", patterns.KNOWN_NAME_CONFIDENCE, n.replace(".", "\\.")) for n in KNOWN_NAMES]
    + [(kind, patterns.PHI_CONFIDENCE, p) for kind, p in patterns.PHI_PATTERNS])
VIEWS["phi_open"] = f"""SELECT h.* FROM phi_hits h WHERE place < {_KNOWN} OR NOT EXISTS (SELECT 1 FROM phi_hits e
    WHERE e.doc_id = h.doc_id AND e.place < h.place AND e.start <= h.start AND e."end" >= h."end")"""
VIEWS["phi_best"] = """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start
    ORDER BY confidence DESC, place) AS k FROM phi_open) WHERE k = 1"""
_chain("phi_kept", "phi_best")
VIEWS["masks"] = rows("type, replacement", patterns.PHI_MASKS)
VIEWS["phi_final"] = """SELECT doc_id, substr(text, start + 1, "end" - start) AS text, type, start, "end", confidence, replacement
    FROM phi_kept JOIN masks USING (type) JOIN (SELECT doc_id, text FROM fx_note) USING (doc_id)"""
PHI_ROWS = "SELECT * FROM phi_final"
VIEWS["phi_masked"] = """SELECT doc_id, coalesce(marked, '') || substr(text, coalesce(last, 0) + 1) AS masked
    FROM fx_note LEFT JOIN (SELECT doc_id, max("end") AS last,
        string_agg(substr(full_text, prev + 1, start - prev) || replacement, '' ORDER BY start) AS marked
        FROM (SELECT p.*, n.text AS full_text, coalesce(lag(p."end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev
              FROM phi_final p JOIN (SELECT doc_id, text FROM fx_note) n USING (doc_id)) GROUP BY 1) USING (doc_id)"""
PHI_MASK = "SELECT doc_id, masked FROM phi_masked"
PHI_SUMMARY = """SELECT doc_id, coalesce(n, 0) AS total_phi_found, coalesce(types, '') AS types_found FROM fx_note LEFT JOIN (
    SELECT doc_id, cast(sum(c) AS bigint) AS n, string_agg(type, '; ' ORDER BY lo) AS types FROM (
        SELECT doc_id, type, count(*) AS c, min(start) AS lo FROM phi_final GROUP BY 1, 2) GROUP BY 1) USING (doc_id)"""
PHI_TYPES = "SELECT type, count(*) AS detections, count(DISTINCT doc_id) AS notes FROM phi_final GROUP BY 1"

VIEWS["ce_hits"] = _hits(patterns.ENTITY_PATTERNS)
VIEWS["ce_best"] = """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start
    ORDER BY "end" DESC, place) AS k FROM ce_hits) WHERE k = 1"""
_chain("ce_kept", "ce_best")
VIEWS["ce_final"] = """SELECT doc_id, substr(text, start + 1, "end" - start) AS text, type, start, "end", confidence,
    substr(text, greatest(start - 50, 0) + 1, "end" + 50 - greatest(start - 50, 0)) AS context
    FROM ce_kept JOIN (SELECT doc_id, text FROM fx_note) USING (doc_id)"""
ENTITIES = "SELECT * FROM ce_final"
RECORDS = f"""SELECT doc_id, masked AS deidentified_text, characters AS character_count, words AS word_count,
    coalesce(n, 0) AS entities_extracted, coalesce(p, 0) AS phi_detected, coalesce(n, 0) AS terminology_mappings,
    coalesce(conditions, 0) AS conditions, coalesce(medications, 0) AS medications, coalesce(procedures, 0) AS procedures,
    coalesce(lab_tests, 0) AS lab_tests, coalesce(vital_signs, 0) AS vital_signs, coalesce(symptoms, 0) AS symptoms
    FROM phi_masked JOIN ({TEXT_STATS}) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS p FROM phi_final GROUP BY 1) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE type = 'condition') AS conditions,
        count(*) FILTER (WHERE type = 'medication') AS medications, count(*) FILTER (WHERE type = 'procedure') AS procedures,
        count(*) FILTER (WHERE type = 'lab_test') AS lab_tests, count(*) FILTER (WHERE type = 'vital_sign') AS vital_signs,
        count(*) FILTER (WHERE type = 'symptom') AS symptoms FROM ce_final GROUP BY 1) USING (doc_id)"""

JSON = """SELECT text AS source_note, candidate_spans, entities_linked, vocabularies_used, 8 AS steps, coalesce(told, '') AS entities
    FROM fx_note JOIN n_stats USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(start || ':' || substr(text, cast(start + 1 AS bigint),
        length(trigger)) || ':' || code || ':' || confidence || ':' || negated, '|' ORDER BY start) AS told
        FROM n_ent JOIN (SELECT doc_id, text FROM fx_note) USING (doc_id) GROUP BY 1) USING (doc_id)"""
PHI_BY_TYPE = """SELECT doc_id, type, string_agg(text || '~' || replacement || '~' || confidence, '|' ORDER BY start) AS found
    FROM phi_final GROUP BY 1, 2"""
