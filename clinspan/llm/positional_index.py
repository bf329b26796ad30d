"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

1. The index holds one posting (document, position) per word of the documents that the search terms have, written by
   the tasks that scan the texts as segments sorted by term. Texts are read once. A document's head, the posting of
   the empty term, has its id and number of words.
2. Equal items are one phrase. Each window of a phrase (ten words, or all of a shorter one) names the terms that are
   rarest in the index; a window with a term the index lacks cannot occur and is left out.
3. Only the lists of those rarest terms are read. A posting minus the term's place in the phrase is the place where the
   phrase would begin: lists adjusted in this way are intersected by counting distinct places per (document, phrase,
   beginning).
4. What remains is compared word for word with the postings of its documents. The places that agree, in order, tell
   which windows occur in full and which words of the document they cover.

With ``slop`` every word may stand up to that many words after its place (a proximity match); 0 is the exact phrase.

Words are compared as strings, so nothing depends on hashes. Small tables are broadcast only after their size was
added up (``BROADCAST_BYTES``); larger ones are joined by shuffle. A term that is in every document makes long lists, but
it is never the key of a shuffle: lists are met by document, phrase and beginning.

Defined cases: null text has no words, neither has an item without any, and such an item never occurs; a document
without words has no hits; repeated documents are one row each; items of the same id count once, those of a null id
count as one whose id is not hashed; null document ids are kept; an empty table of items leaves every document clean;
an empty table of documents gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.llm.stored import store

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
RAREST = 3                   # terms of a window whose lists are intersected
BROADCAST_BYTES = 64 << 20   # of the strings and numbers of a table that travels to all tasks


def words(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, BREAK), "")


def sized(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcast if its added-up size allows that."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t == "string" else F.lit(16) for c, t in table.dtypes), F.lit(0))
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


@dataclass
class Phrases:
    """``table``: phrase, words, width of a window; ``items``: phrase, item_id; ``terms``: the distinct words."""

    table: DataFrame
    items: DataFrame
    terms: DataFrame


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Phrases:
    own = store(items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0), "items")
    table = own.select("words").distinct().select(
        F.monotonically_increasing_id().alias("phrase"), "words", F.least(F.size("words"), F.lit(window)).alias("width"))
    table = store(table, "phrases")
    terms = store(table.select(F.explode("words").alias("term")).distinct(), "terms")
    return Phrases(table, own.join(table.select("phrase", "words"), "words").select("phrase", "item_id").distinct(), terms)


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (term, doc, pos) of ``terms``; positions count from 1, heads have the term '' and ``id``, ``n_words``."""
    head = terms.sparkSession.range(1).select(F.lit("").alias("term"))
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    rows = rows.select("doc", "id", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "term"))
    rows = rows.join(sized(store(terms.union(head), "terms")), "term")
    at_head = F.col("pos") == 0
    return store(rows.select(
        "term", "doc", "pos", F.when(at_head, F.col("id")).alias("id"), F.when(at_head, F.col("n_words")).alias("n_words"),
    ).sortWithinPartitions("term", "doc", "pos"), "postings")


def _anchors(postings: DataFrame, table: DataFrame) -> DataFrame:
    """(term, phrase, place, need): the places of the rarest terms of each window that can occur."""
    counts = postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))
    places = table.select("phrase", "width", F.posexplode("words").alias("place", "term")).join(counts, "term", "left")
    known = places.groupBy("phrase", "width").agg(F.sort_array(F.collect_list(
        F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("known"))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("known") - F.col("width") + 1),
        lambda s: F.array_sort(F.transform(F.slice("known", s, F.col("width")), lambda x: F.struct(x["n"], x["place"], x["term"]))))
    possible = F.filter(windows, lambda w: F.get(w, 0)["n"] > 0)
    rare = F.array_distinct(F.flatten(F.transform(possible, lambda w: F.slice(w, 1, RAREST))))
    found = known.select("phrase", F.least(F.col("width"), F.lit(RAREST)).alias("need"), F.explode(rare).alias("x"))
    return found.select(F.col("x.term").alias("term"), "phrase", F.col("x.place").alias("place"), "need")


def search(postings: DataFrame, wanted: Phrases, slop: int = 0) -> DataFrame:
    """(doc, phrase, begin, width, places): where windows of phrases occur, with the places that agree, sorted.

    ``begin`` is the position of the phrase's first word (place 0), whether or not that word itself agrees.
    """
    shifts = F.sequence(F.lit(0), F.lit(slop))
    lists = postings.join(sized(store(_anchors(postings, wanted.table), "anchors")), "term")
    lists = lists.select("doc", "phrase", "place", "need", (F.col("pos") - F.col("place")).alias("begin"))
    if slop:
        lists = lists.withColumn("shift", F.explode(shifts)).withColumn("begin", F.col("begin") - F.col("shift"))
    met = store(lists.groupBy("doc", "phrase", "begin").agg(
        F.count_distinct("place").alias("n"), F.max("need").alias("need")).where("n >= need").select("doc", "phrase", "begin"), "met")
    asked = met.join(wanted.table, "phrase").select("doc", "phrase", "begin", "width", F.posexplode("words").alias("place", "term"))
    asked = asked.withColumn("pos", F.col("begin") + F.col("place"))
    if slop:
        asked = asked.withColumn("shift", F.explode(shifts)).withColumn("pos", F.col("pos") + F.col("shift"))
    theirs = postings.where("term <> ''").select("term", "doc", "pos").join(
        sized(store(met.select("doc").distinct(), "met-docs")), "doc", "left_semi")
    agree = asked.join(theirs, ["doc", "pos", "term"]).groupBy("doc", "phrase", "begin", "width").agg(
        F.sort_array(F.collect_set("place")).alias("places"))
    return agree.where(F.size(window_starts(F.col("places"), F.col("width"))) > 0)


def window_starts(places: Column, width: Column) -> Column:
    """Places at which a window of the phrase begins that agrees in full."""
    return F.filter(places, lambda x, i: F.coalesce(F.get(places, i + width - 1) == x + width - 1, F.lit(False)))


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items`` and ``items``, the sorted ids of the items as strings."""
    wanted = phrases(items, text_col=text_col, window=window)
    postings = build_index(docs, wanted.terms, id_col, text_col)
    found = store(search(postings, wanted), "found")
    cover = F.array_distinct(F.flatten(F.transform(
        window_starts(F.col("places"), F.col("width")), lambda s: F.sequence(s, s + F.col("width") - 1))))
    hit = found.select("doc", "begin", F.explode(cover).alias("place")).select(
        "doc", (F.col("begin") + F.col("place")).alias("pos")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    held = found.select("doc", "phrase").distinct().join(wanted.items, "phrase").select("doc", "item_id").distinct()
    held = held.groupBy("doc").agg(
        F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    heads = postings.where("term = ''").select("doc", "id", "n_words")
    return heads.join(hit.join(held, "doc"), "doc", "left").select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
