"""Vocabularies and dictionaries that are tables: matching texts to names, and finding phrases in notes.

Nothing here holds a vocabulary in an expression, so it may have any number of entries. What decides between candidates
is the same as for the built-in vocabularies (``terminology``), whose matchers are expressions over constants.

Texts are matched once however often they occur. Candidates come from an inverted index of the names, the rarest key first:

- shared words (``by_words``): a match needs a number of shared words that the text alone decides, so two of its rarest
  words, as many as may be missing and two more, are in the name. Only pairs of those are looked up;
- containment (``by_part``): the text's rarest run of three characters is looked up among all runs of the names;
- equality and beginnings (``by_name``): whole names, then their first three characters.

Candidates are then compared in full. Index and counts are broadcast after a check of their size, else joined by shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.fixed import patterns
from clinspan.functions import spans
from clinspan.operators import terminology
from clinspan.operators.notes import phrase_key
from clinspan.session import stored

BROADCAST_BYTES = 64 << 20  # of a table that travels to all tasks
RUN = 3                     # characters of a looked-up run
_BORDER = "A-Za-z0-9"
_WORDS = list(string.ascii_letters + string.digits)  # the same, one by one
_BLANK = " \t\n\x0b\f\r"  # what \\s is in a pattern


def sized(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcast if its size, which is added up first, allows that."""
    def bytes_of(c: str, kind: str) -> Column:
        if kind.startswith(("array", "struct")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kind == "string" else F.lit(16)

    width = [bytes_of(c, kind) for c, kind in table.dtypes]
    size = table.agg(F.sum(sum(width, F.lit(0)))).first()[0]
    return F.broadcast(table) if (size or 0) <= BROADCAST_BYTES else table


def names_of(vocabulary: DataFrame, system: str, code: str, term: str, *names: str) -> DataFrame:
    """One row per name of each entry of a vocabulary table with ``ord``: ``ord``, ``place``, ``name``, ``match``.

    ``names`` are columns of texts or arrays of texts; the entry's order, then theirs, decides between equal scores.
    """
    kinds = dict(vocabulary.dtypes)
    every = F.concat(*[F.col(n) if kinds[n].startswith("array") else F.array(n) for n in names])
    match = F.struct(F.col(code).alias("code"), F.col(term).alias("term"), F.lit(system).alias("system"))
    return vocabulary.select("ord", match.alias("match"), F.posexplode(every).alias("place", "name")).where(
        "name IS NOT NULL").withColumn("name", F.lower("name"))


def _best(found: DataFrame, score: Column | None = None) -> DataFrame:
    """The match of each text with the highest score, then the first in the vocabulary."""
    rank = F.struct((-score if score is not None else F.lit(0)).alias("score"), "ord", "place")
    return found.groupBy("text").agg(F.min_by("match", rank).alias("match"))


def _pairs(words: Column) -> Column:
    """Hashes of the pairs of different words, whichever comes first in ``words``."""
    def with_later(w: Column, i: Column) -> Column:
        return F.transform(F.slice(words, i + 2, F.size(words)), lambda v: F.xxhash64(F.least(w, v), F.greatest(w, v)))

    return F.flatten(F.transform(words, with_later))


def by_words(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text, match): names that share at least two (or all) words and 60 % of the text's words with it, best share first.

    What matches depends on the words of a name and, of a text, on its number of words and those that any name has. So
    names with the same words compete as one, the first of them, and texts with the same such words are matched once.
    """
    split = names.withColumn("theirs", F.array_sort(F.array_distinct(F.filter(F.split("name", r"(?U)\s+"), lambda w: w != ""))))
    sets = split.groupBy("theirs").agg(F.min(F.struct("ord", "place")).alias("at"), F.min_by("match", F.struct("ord", "place")).alias("match"))
    sets = sets.select("theirs", "at.*", "match")
    postings = sets.select(F.explode("theirs").alias("word"), F.size("theirs").alias("most"), "ord", "place", "match")
    # the best name of a text of one word is the shortest with that word
    one = postings.groupBy("word").agg(
        F.count("*").alias("names"), F.min_by("match", F.struct("most", "ord", "place")).alias("only"))
    mine = texts.select("text", terminology.words(terminology._lower(F.col("text"))).alias("mine"))
    words = mine.select("text", F.size("mine").alias("n"), F.explode("mine").alias("word")).join(
        sized(one.select("word", "names")), "word", "left")
    ranked = words.groupBy("text", "n").agg(F.sort_array(F.collect_list(
        F.when(F.col("names").isNotNull(), F.struct("names", "word")))).alias("known"))
    needed = F.greatest(F.least(F.lit(2), F.col("n")), F.ceil(F.col("n") * 6 / F.lit(10)).cast("int"))
    forms = stored("lookup-forms", ranked.select(
        "text", "n", needed.alias("needed"), F.transform("known", lambda k: k["word"]).alias("known")).where(
        F.size("known") >= F.col("needed")))
    distinct = forms.select("n", "needed", "known").distinct()
    single = distinct.where("n = 1").join(
        sized(one.select(F.array("word").alias("known"), F.col("only").alias("match"))), "known").select("n", "known", "match")
    # a match lacks so few of the known words that two of the rarest, as many as it may lack and two more, are in the name
    asked = distinct.where("n > 1").select("n", "known", F.explode(F.array_distinct(_pairs(
        F.slice("known", F.lit(1), F.size("known") - F.col("needed") + 2)))).alias("pair"))
    indexed = sets.select("ord", "place", "theirs", "match", F.explode(F.array_distinct(_pairs(F.col("theirs")))).alias("pair"))
    held = asked.join(sized(indexed), "pair").withColumn("shared", F.size(F.array_intersect("known", "theirs"))).where(
        (F.col("shared") >= 2) & (F.col("shared") >= F.col("n") * 0.6))
    score = F.col("shared") / F.greatest(F.col("n"), F.size("theirs"))
    several = held.groupBy("n", "known").agg(
        F.min_by("match", F.struct((-score).alias("score"), "ord", "place")).alias("match"))
    return forms.join(single.unionByName(several), ["n", "known"]).select("text", "match")


def _runs(text: Column, size: Column | int) -> Column:
    """All runs of ``size`` characters of a text, once each."""
    last = F.length(text) - size
    return F.when(last >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, size)))).otherwise(F.array().cast("array<string>"))


def by_part(texts: DataFrame, names: DataFrame, key: Column) -> DataFrame:
    """(text, match): the first name that contains the key of the text; every name contains an empty one."""
    runs = F.concat(*[_runs(F.col("name"), F.lit(k)) for k in range(1, RUN + 1)])
    postings = names.select("ord", "place", "name", "match", F.explode(runs).alias("run")).unionByName(
        names.orderBy("ord", "place").limit(1).withColumn("run", F.lit("")))
    counts = postings.groupBy("run").agg(F.count("*").alias("names"))
    keyed = texts.select("text", key.alias("key"))
    own = F.when(F.col("key") == "", F.array(F.lit(""))).otherwise(_runs(F.col("key"), F.least(F.length("key"), F.lit(RUN))))
    asked = keyed.select("text", "key", F.explode(own).alias("run"))
    rare = asked.join(sized(counts), "run", "left").groupBy("text", "key").agg(
        F.min_by("run", F.struct(F.coalesce("names", F.lit(0)), "run")).alias("run"))
    return _best(rare.join(sized(postings.drop("match")), "run").where(F.contains("name", F.col("key"))).join(
        sized(names.select("ord", "place", "match")), ["ord", "place"]))


def by_name(texts: DataFrame, names: DataFrame, key: Column, beginnings: DataFrame | None = None) -> DataFrame:
    """(text, match): the first entry with the key as a name; else the first of ``beginnings`` that begins with it."""
    keyed = texts.select("text", key.alias("key")).where("key <> ''")
    exact = _best(keyed.join(names.withColumnRenamed("name", "key"), "key"))
    if beginnings is None:
        return exact
    rest = keyed.join(exact, "text", "left_anti").withColumn("run", F.substring("key", F.lit(1), F.least(F.length("key"), F.lit(RUN))))
    heads = beginnings.withColumn("run", F.explode(F.array_distinct(F.array(
        *[F.substring("name", F.lit(1), F.lit(k)) for k in range(1, RUN + 1)]))))
    return exact.unionByName(_best(rest.join(heads, "run").where(F.startswith("name", F.col("key")))))


def _either(texts: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    found = texts.join(first.withColumnRenamed("match", "first"), "text", "left").join(second, "text", "left")
    return found.select("text", F.coalesce("first", "match").alias("match")).where("match IS NOT NULL")


def match(rows: DataFrame, name: str, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``match`` (code, term, system), or NULL: the matcher of a vocabulary over a table of its columns.

    ``name`` is snomed, icd10, loinc, rxnorm or cpt, the table as :func:`terminology.vocabulary` reads it.
    """
    texts = rows.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    key = terminology._lower(F.col("text"))
    if name == "snomed":
        names = names_of(vocabulary, "SNOMED CT", "code", "term", "term", "synonyms")
        found = _either(texts, by_name(texts, names, key), by_words(texts, names))
    elif name == "icd10":
        found = by_words(texts, names_of(vocabulary, "ICD-10-CM", "code", "description", "description", "long_description"))
    elif name == "loinc":
        aliases = spans.constant_map({alias: (target,) for alias, target in patterns.LAB_ALIASES})
        names = names_of(vocabulary, "LOINC", "code", "short_name", "short_name", "component")
        found = by_part(texts, names, F.coalesce(F.try_element_at(aliases, key), key))
    elif name == "rxnorm":
        names = names_of(vocabulary, "RxNorm", "code", "name", "name", "generic_name", "brand_names")
        found = by_name(texts, names, terminology.drug_name(F.col("text")), names.where("place < 2"))
    elif name == "cpt":
        found = by_part(texts, names_of(vocabulary, "CPT", "code", "short_description", "short_description", "long_description"), key)
    else:
        raise ValueError(f"unknown vocabulary {name!r}")
    return rows.join(found.withColumnRenamed("text", "_text"), F.col(text) == F.col("_text"), "left").drop("_text")


def tokens(text: str) -> Column:
    """Tokens in order: runs of ASCII letters and digits, and every other character that is not white space.

    Each has ``start``, ``raw`` (with the white space after it), ``bare`` and ``word`` (whether it is such a run).
    """
    pieces = spans.find_spans(text, rf"(?:[{_BORDER}]+|[^{_BORDER}\s])\s*")
    # a pattern for each token would take longer than finding them all
    bare = F.transform(pieces, lambda p: F.struct(p["start"], p["text"].alias("raw"), F.rtrim(p["text"], F.lit(_BLANK)).alias("bare")))
    return F.transform(bare, lambda p: F.struct(p["start"], p["raw"], p["bare"], F.substring(p["bare"], 1, 1).isin(_WORDS).alias("word")))


def _windows(tokens: Column, sizes: Column) -> Column:
    """(start, end, key, tokens) of every run of so many tokens with no letter or digit next to it."""
    def glued(i: Column) -> Column:  # nothing between a token and the next
        return F.get(tokens, i)["raw"] == F.get(tokens, i)["bare"]

    def window(i: Column, k: Column) -> Column:
        last = F.get(tokens, i + k - 1)
        raw = F.array_join(F.transform(F.slice(tokens, i + 1, k - 1), lambda t: t["raw"]), "")
        return F.struct(F.get(tokens, i)["start"].alias("start"), (last["start"] + F.length(last["bare"])).alias("end"),
                        phrase_key(F.concat(raw, last["bare"])).alias("_key"), k.alias("_tokens"))

    def fits(i: Column, k: Column) -> Column:
        before = (i > 0) & F.get(tokens, i - 1)["word"] & glued(i - 1)
        after = (i + k < F.size(tokens)) & F.get(tokens, i + k)["word"] & glued(i + k - 1)
        return (i + k <= F.size(tokens)) & ~F.coalesce(before, F.lit(False)) & ~F.coalesce(after, F.lit(False))

    return F.flatten(F.transform(tokens, lambda _, i: F.transform(
        F.filter(sizes, lambda k: fits(i, k)), lambda k: window(i, k))))


def phrases(notes: DataFrame, dictionary: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Every occurrence of a phrase of ``dictionary`` in notes (doc_id, text), with ``start``, ``end`` and its columns.

    A phrase occurs where the text has it character for character, in any case, with no ASCII letter or digit next to it.
    Windows of as many tokens as phrases of the dictionary have are joined with the phrases; overlapping ones all count.
    """
    words = dictionary.withColumn("_phrase", F.regexp_replace(phrase, r"^\s+|\s+$", "")).where("_phrase <> ''")
    words = words.withColumns({
        "_key": phrase_key(F.col("_phrase")), "_chars": F.length("_phrase"), "_tokens": F.size(tokens("_phrase"))})
    sizes = [r[0] for r in words.select("_tokens").distinct().orderBy("_tokens").collect()]  # a few small numbers
    sizes = F.array(*[F.lit(k) for k in sizes]) if sizes else F.array().cast("array<int>")
    found = notes.select("doc_id", F.inline(spans.let(tokens("text"), lambda t: _windows(t, sizes))))
    held = found.join(sized(words.drop("_phrase")), ["_key", "_tokens"]).where(F.col("end") - F.col("start") == F.col("_chars"))
    return held.select("doc_id", "start", "end", *dictionary.columns)
