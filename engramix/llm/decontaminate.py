"""Benchmark decontamination (operator 9): a distributed positional inverted index, in
DataFrame functions only.

1. Every item is cut into windows of ``WINDOW`` consecutive words (shorter items are
   one window). Only the items' words are counted in the corpus.
2. The two rarest places of each window become its anchors. Neighbouring windows share
   them, so an item has few.
3. Postings (row, position) of the anchor words are taken from the corpus. A posting
   minus the anchor's place in the item is an alignment of the item with the row.
4. Per (row, item, alignment) the lists are intersected: a window stays where both
   anchors are posted at its alignment. The whole window is then compared word by word.

``phrase_hits`` gives the exact phrases; ``proximity_matches`` gives rows where a window's
two rarest words stand within a distance, in any order.

Rows are keyed by id and a 64-bit hash of the text, so repeated ids are safe.
Null and empty texts have no words; items without words have no windows; empty
tables give no hits. Items with a null id count as hits but are not listed. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keyed_rows, let, lower_ascii, materialize

WINDOW = 10
#: Up to so many words of all items together, the items are broadcast; beyond, they are joined by a shuffle.
BROADCAST_WORDS = 1_000_000
#: Between words: ASCII but letters (of either case) and digits.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """The words of a text in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def lower_word(word: Column) -> Column:
    """A-Z lower-cased; only words with other letters need the slower way."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(lower_ascii(word))


def phrase_words(text: Column) -> Column:
    return F.transform(split_words(text), lower_word)


def item_windows(items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, words (of the item), start, len: the windows of all items."""
    words = items.select(F.col(item_id).alias("item_id"), phrase_words(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    return words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("start")).withColumn(
        "len", F.least(F.size("words"), F.lit(window))
    )


def corpus_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key and the words of every row, not yet lower-cased."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), split_words(F.col(text_col)).alias("words"))


def term_counts(words: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (term) occurs in the corpus; 0 where it doesn't."""
    each = words.select(F.explode("words").alias("word")).select(lower_word(F.col("word")).alias("term"))
    counted = each.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def choose_anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """item_id, start, len, a1, a2 (places in the item) with t1, t2: the two rarest places of each window.

    Windows with a word that the corpus lacks can't occur and are left out. Of
    equally rare places the earlier goes first; windows of one word have a1 = a2.
    """
    places = windows.select(
        "item_id", "start", "len", F.posexplode(F.expr("slice(words, start + 1, len)")).alias("o", "term")
    ).join(counts, "term")
    ranked = places.groupBy("item_id", "start", "len").agg(
        F.sort_array(F.collect_list(F.struct("n", (F.col("start") + F.col("o")).alias("at"), "term"))).alias("r")
    )
    first, second = F.col("r")[0], F.coalesce(F.get("r", F.lit(1)), F.col("r")[0])
    return ranked.filter(F.col("r")[0]["n"] > 0).select(
        "item_id", "start", "len", first["at"].alias("a1"), second["at"].alias("a2"), first["term"].alias("t1"), second["term"].alias("t2")
    )


def postings(words: DataFrame, terms: DataFrame) -> DataFrame:
    """term, id, key, pos of every occurrence of ``terms`` in the corpus."""
    each = words.select("id", "key", F.posexplode("words").alias("pos", "word"))
    return each.select("id", "key", "pos", lower_word(F.col("word")).alias("term")).join(terms, "term", "left_semi")


def rows_with_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """id, key (hash of the text), n_hit and items (sorted ids as strings) of the rows with hits.

    Only rows with an alignment are split into words again for the exact comparison.
    """
    corpus = corpus_words(docs, id_col, text_col)
    # Items are keyed by a row number: ids may be null or repeated.
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("name"), F.col(item_text).alias("text")))
    windows = materialize(item_windows(numbered, "item", "text", window))
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    anchors = materialize(choose_anchors(windows, term_counts(corpus, vocabulary)))
    places = anchors.select("item_id", F.explode(F.array(F.struct(F.col("t1").alias("term"), F.col("a1").alias("at")), F.struct(F.col("t2").alias("term"), F.col("a2").alias("at")))).alias("a"))
    places = places.select("item_id", "a.term", "a.at").distinct()
    # One row per anchor word, its places in the items beside it.
    by_term = places.groupBy("term").agg(F.collect_list(F.struct("item_id", "at")).alias("places"))
    posted = postings(corpus, by_term.select("term")).join(by_term, "term")
    aligned = (
        posted.select("id", "key", "pos", F.inline("places"))
        .groupBy("id", "key", "item_id", (F.col("pos") - F.col("at")).alias("shift"))
        .agg(F.collect_set("at").alias("at"))
    )
    by_item = anchors.groupBy("item_id").agg(F.collect_list(F.struct("start", "len", "a1", "a2")).alias("windows"))
    texts = windows.filter(F.col("start") == 0).select("item_id", "words").join(numbered.select(F.col("item").alias("item_id"), "name"), "item_id")
    intersected = F.filter("windows", lambda w: F.array_contains("at", w["a1"]) & F.array_contains("at", w["a2"]) & (w["start"] + F.col("shift") >= 0))
    items_side = by_item.join(texts, "item_id")
    n_words = windows.filter(F.col("start") == 0).agg(F.sum(F.size("words"))).first()[0]
    if (n_words or 0) <= BROADCAST_WORDS:  # an item with most of the alignments is then no hot spot
        items_side = F.broadcast(items_side)
    candidates = (
        aligned.join(items_side, "item_id")
        .select("id", "key", F.col("name").alias("item_id"), "shift", F.col("words").alias("item_words"), intersected.alias("windows"))
        .filter(F.size("windows") > 0)
        .groupBy("id", "key")
        .agg(F.collect_list(F.struct("item_id", "shift", "item_words", "windows")).alias("alignments"))
    )
    candidates = materialize(candidates)
    # The texts of all other rows stay where they are.
    aligned_docs = keyed_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), candidates, "left_semi", "id", "text")
    return (
        aligned_docs.select("id", F.xxhash64("text").alias("key"), "text")
        .join(candidates.withColumnsRenamed({"id": "c_id", "key": "c_key"}), F.col("id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key")))
        .select("id", "key", let(phrase_words(F.col("text")), lambda w: _confirmed(w, F.col("alignments"))).alias("hits"))
        .select("id", "key", "hits.*")
        .filter(F.col("n_hit") > 0)
        .dropDuplicates(["id", "key"])
    )


def phrase_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, and the sorted ids (as strings) of the items with hits."""
    found = rows_with_hits(docs, items, id_col, text_col, item_id, item_text, window)
    out = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.size(split_words(F.col(text_col))).cast("bigint").alias("n_words"))
    return out.join(
        found.withColumnsRenamed({"id": "f_id", "key": "f_key"}), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), "left"
    ).select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )



def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    found = materialize(rows_with_hits(docs, items, id_col, text_col, item_id, item_text, window).select("id", "key"))
    return keyed_rows(docs, found, "left_anti", id_col, text_col)


def _confirmed(words: Column, alignments: Column) -> Column:
    """struct<n_hit, items>: the alignments' windows compared word by word."""

    def exact(a: Column) -> Column:
        return F.filter(
            a["windows"],
            lambda w: F.slice(words, (w["start"] + a["shift"] + 1).cast("int"), w["len"])
            == F.slice(a["item_words"], w["start"] + 1, w["len"]),
        )

    checked = F.transform(
        alignments,
        lambda a: F.struct(
            a["item_id"].cast("string").alias("item"),
            F.flatten(F.transform(exact(a), lambda w: F.sequence(w["start"] + a["shift"], w["start"] + a["shift"] + w["len"] - 1))).alias("at"),
        ),
    )
    return let(
        F.filter(checked, lambda c: F.size(c["at"]) > 0),
        lambda hits: F.struct(
            F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["at"])))).cast("bigint").alias("n_hit"),
            F.sort_array(F.array_distinct(F.array_compact(F.transform(hits, lambda h: h["item"])))).alias("items"),
        ),
    )


def proximity_matches(
    docs: DataFrame, items: DataFrame, distance: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """id, item_id, n_near: how many postings of an item's rarest two words lie within
    ``distance`` words of each other in a row, in either order.

    For every item one pair of words is sought: the anchors of its rarest window.
    A running maximum over the merged posting lists finds the nearest earlier partner,
    so a row with many postings costs their number, not its square.
    """
    corpus = corpus_words(docs, id_col, text_col)
    windows = item_windows(items, item_id, item_text, window)
    counts = term_counts(corpus, windows.select(F.explode("words").alias("term")).distinct())
    anchors = choose_anchors(windows, counts).join(counts.select(F.col("term").alias("t1"), "n"), "t1")
    rarest = anchors.groupBy("item_id").agg(F.min(F.struct("n", "start", "t1", "t2")).alias("r")).select("item_id", "r.t1", "r.t2")
    sides = rarest.select("item_id", F.explode(F.array(F.struct(F.col("t1").alias("term"), F.lit(1).alias("side")), F.struct(F.col("t2").alias("term"), F.lit(2).alias("side")))).alias("s"))
    sides = sides.select("item_id", "s.*").distinct()
    merged = postings(corpus, sides.select("term").distinct()).join(sides, "term")
    before = W.partitionBy("id", "key", "item_id").orderBy("pos", "side").rowsBetween(W.unboundedPreceding, -1)
    other = F.max(F.when(F.col("side") == 1, F.col("pos"))).over(before), F.max(F.when(F.col("side") == 2, F.col("pos"))).over(before)
    near = F.when(F.col("side") == 2, F.col("pos") - other[0]).otherwise(F.col("pos") - other[1])
    return (
        merged.select("id", "item_id", "key", near.alias("gap"))
        .filter(F.col("gap") <= distance)
        .groupBy("id", "key", "item_id")
        .agg(F.count(F.lit(1)).alias("n_near"))
        .select(F.col("id").alias(id_col), "item_id", "n_near")
    )
