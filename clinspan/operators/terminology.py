"""Matching of entity texts to vocabulary entries.

The vocabularies are constants of a few dozen entries, so a match is an expression over the text
alone: nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.fixed import patterns, vocabularies as fixed
from clinspan.functions import spans
from clinspan.session import active, constant_table, sql_literal

MATCH = "struct<code:string,term:string,system:string>"


def _lower(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def _entries(names: str, rows: list[tuple]) -> Column:
    """Vocabulary entries (code, term, system, then what they are compared by) as a constant array."""
    def entry(row: tuple) -> str:
        match = spans.struct_sql("code, term, system", row[:3])
        keys = ", ".join(f"'{n}', {sql_literal(v)}" for n, v in zip(names.split(", "), row[3:]))
        return f"named_struct('match', {match}, {keys})"

    return F.expr("array(" + ", ".join(entry(r) for r in rows) + ")")


def _first(entries: Column, condition) -> Column:
    """Match of the first entry, in vocabulary order, that meets the condition."""
    return F.get(F.filter(entries, condition), F.lit(0))["match"]


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def overlap_match(text: Column, names: list[tuple[str, str, str, str]]) -> Column:
    """Best entry by shared words: at least two (or all) words and 60 % of the text's words.

    ``names`` are (name, code, term, system) in order; on equal scores the earlier one wins.
    """
    options = _entries("words, place", [
        (code, term, system, list(dict.fromkeys(name.split())), -i)
        for i, (name, code, term, system) in enumerate(names)])

    def best(mine: Column) -> Column:
        def scored(o: Column) -> Column:
            shared = F.size(F.array_intersect(mine, o["words"]))
            enough = (shared >= F.least(F.lit(2), F.size(mine))) & (shared >= F.size(mine) * 0.6)
            score = shared / F.greatest(F.size(mine), F.size(o["words"]), F.lit(1))
            return F.struct(F.when(enough, score).otherwise(0.0).alias("score"),
                            o["place"].alias("place"), o["match"].alias("match"))

        return F.array_max(F.filter(F.transform(options, scored), lambda s: s["score"] > 0))

    return spans.let(words(_lower(text)), best)["match"]


def _snomed_names() -> list[tuple[str, str, str, str]]:
    return [(name.lower(), code, term, "SNOMED CT")
            for code, term, synonyms, _ in fixed.SNOMED for name in [term, *synonyms]]


def snomed_match(text: Column) -> Column:
    exact = _entries("names", [(code, term, "SNOMED CT", [n.lower() for n in [term, *synonyms]])
                               for code, term, synonyms, _ in fixed.SNOMED])
    key = _lower(text)
    return F.coalesce(_first(exact, lambda e: F.array_contains(e["names"], key)),
                      overlap_match(text, _snomed_names()))


def icd10_match(text: Column) -> Column:
    return overlap_match(text, [
        (name.lower(), code, short, "ICD-10-CM")
        for code, short, long, _, _ in fixed.ICD10 for name in (short, long)])


def loinc_match(text: Column) -> Column:
    aliases = spans.constant_map({alias: (name,) for alias, name in patterns.LAB_ALIASES})
    key = _lower(text)
    term = F.coalesce(F.try_element_at(aliases, key), key)
    entries = _entries("short, component", [(code, short, "LOINC", short.lower(), component.lower())
                                            for code, component, short, *_ in fixed.LOINC])
    return _first(entries, lambda e: F.contains(e["short"], term) | F.contains(e["component"], term))


def drug_name(text: Column) -> Column:
    """The text without a dose and whatever follows it."""
    return _lower(F.regexp_replace(_lower(text), F.lit("(?U)" + patterns.DOSE_TAIL), F.lit("")))


def rxnorm_match(text: Column, skip_empty: bool = True) -> Column:
    """Exact name, generic or brand; else the first drug whose name starts with the text.

    A text that is only a dose leaves nothing to look up. With ``skip_empty=False`` it maps to the
    first drug of the vocabulary, since every name starts with the empty text.
    """
    entries = _entries("exact, name, generic", [
        (code, name, "RxNorm", [x.lower() for x in (name, generic, *brands)], name.lower(), generic.lower())
        for code, name, generic, brands, _, _ in fixed.RXNORM])
    key = drug_name(text)
    found = F.coalesce(
        _first(entries, lambda e: F.array_contains(e["exact"], key)),
        _first(entries, lambda e: F.startswith(e["name"], key) | F.startswith(e["generic"], key)))
    return F.when(key != "", found) if skip_empty else found


def cpt_match(text: Column) -> Column:
    key = _lower(text)
    entries = _entries("short, long", [(code, short, "CPT", short.lower(), long.lower())
                                       for code, short, long, _ in fixed.CPT])
    return _first(entries, lambda e: F.contains(e["short"], key) | F.contains(e["long"], key))


def mappings(kind: Column, text: Column, skip_empty: bool = True) -> Column:
    """All matches of an entity, by its class; the first one is the best."""
    none = F.lit(None).cast(MATCH)
    clinical = kind.isin("condition", "diagnosis", "symptom")
    first = (F.when(clinical, snomed_match(text))
             .when(kind == "medication", rxnorm_match(text, skip_empty))
             .when(kind == "procedure", cpt_match(text))
             .when(kind.isin("lab_test", "lab_value", "vital_sign"), loinc_match(text)))
    second = F.when(clinical, icd10_match(text)).otherwise(none)
    return F.array_compact(F.array(first, second))


def map_entities(entities: DataFrame, kind: str = "type", text: str = "text",
                 skip_empty: bool = True) -> DataFrame:
    """Entity rows with their vocabulary matches.

    Matching is an expression over the row, so nothing is shuffled and a text that dominates the
    corpus does no harm. Finding the entities costs far more than matching them; a join through
    distinct texts would find them twice.
    """
    matched = entities.withColumn("mappings", mappings(F.col(kind), F.col(text), skip_empty))
    best = F.get("mappings", F.lit(0))
    return matched.select(
        *entities.columns, "mappings", best["term"].alias("normalized_term"),
        best["code"].alias("terminology_code"), best["system"].alias("terminology_system"))


_SHAPES = {
    "snomed": ("code string, term string, synonyms array<string>, semantic_type string",
               fixed.SNOMED, fixed.SNOMED_VERSION),
    "icd10": ("code string, description string, long_description string, category string, snomed_mapping string",
              fixed.ICD10, fixed.ICD10_VERSION),
    "loinc": ("code string, component string, short_name string, unit string, range_low double, range_high double",
              fixed.LOINC, fixed.LOINC_VERSION),
    "rxnorm": ("code string, name string, generic_name string, brand_names array<string>, drug_class string, common_doses array<string>",
               fixed.RXNORM, fixed.RXNORM_VERSION),
    "cpt": ("code string, short_description string, long_description string, category string",
            fixed.CPT, fixed.CPT_VERSION),
}


def vocabulary(name: str, path: str | None = None) -> DataFrame:
    """A vocabulary as a table with ``ord``, its entry order.

    Without a path this is the built-in one. A path names row-shaped JSON with the same columns; a
    path that does not exist gives an empty vocabulary.
    """
    columns, entries, _ = _SHAPES[name]
    columns = "ord bigint, " + columns
    if path is None:
        return constant_table(columns, [(i, *e) for i, e in enumerate(entries)])
    spark = active()
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).json(path)


def terminology_counts() -> DataFrame:
    """Version and number of entries per vocabulary."""
    return constant_table("vocabulary string, version string, entries bigint",
                          [(n, version, len(entries)) for n, (_, entries, version) in _SHAPES.items()])
