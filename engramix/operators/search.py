"""Text search for a batch of queries: BM25 over postings, containment scoring, fallback, entity mentions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources.scratch import stored
from . import scan

K1, B = 1.2, 0.75


def top_k(df: DataFrame, k: int, order: list[Column], by: str | list[str], rank: str = "rank_position") -> DataFrame:
    """The first k rows of each group, with their rank. Spark cuts each task's rows before the shuffle."""
    keys = [by] if isinstance(by, str) else by
    cut = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)
    return cut.withColumn(rank, F.col(rank).cast("bigint"))


def tokens(text: Column) -> Column:
    """All tokens in order (letters, digits, underscore of any script)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))


#: Queries in one block; a block is the most that is broadcast to meet every document.
PER_BLOCK = 2000


def query_blocks(queries: DataFrame, key: str = "query_id") -> list[DataFrame]:
    """The queries (distinct keys) in blocks of about ``PER_BLOCK``, each one row with the array ``qs``."""
    n = queries.count()
    blocks = max(1, -(-n // PER_BLOCK))
    part = F.pmod(F.xxhash64(key), F.lit(blocks))
    return [queries.filter(part == b).agg(F.collect_list(F.struct(*queries.columns)).alias("qs")) for b in range(blocks)]


def against_blocks(docs: DataFrame, queries: DataFrame, body) -> DataFrame:
    """``body(docs with qs)`` for every block of queries: each document is read once per block and
    meets the block's queries inside its row."""
    parts = [body(docs.join(F.broadcast(block))) for block in query_blocks(queries)]
    return reduce(DataFrame.unionAll, parts)


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "node_id", text_col: str = "search_text") -> DataFrame:
    """query_id, node_id, score, rank_position of the k best documents of each query.

    Two passes: one counts documents, tokens, and the documents of each term that some query asks for; the other scores each document
    where it is read (``scan.ranked``). The result, k rows a query, is stored.
    """
    late = F.col("updated_s").cast("bigint") if "updated_s" in docs.columns else F.lit(None).cast("bigint")
    split = docs.select(F.col(id_col).alias("node_id"), late.alias("updated_s"), tokens(F.col(text_col)).alias("ts"))
    return stored(best_by_tokens(split, queries, k).select("query_id", "node_id", "score", "rank_position"))


def term_weights(split: DataFrame, asked: DataFrame, n: int | None = None, total: int | None = None) -> tuple[dict[str, float], int, int]:
    """The idf of each asked term (``asked``: terms) that a document (``split``: ts) holds, the number of documents and of their tokens."""
    # No token is empty: the empty one counts documents and their tokens.
    every = F.array(F.lit("")) if n is None else F.array().cast("array<string>")
    each = split.select(F.size("ts").alias("len"), F.explode(F.concat(every, F.array_distinct("ts"))).alias("term"))
    wanted = asked.select(F.explode(F.concat(every, "terms")).alias("term")).distinct()
    counts = {r["term"]: (r["n"], r["tokens"]) for r in each.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens")).collect()}
    n, total = counts.pop("", (0, 0)) if n is None else (n, total)
    return {t: math.log1p((n - df + 0.5) / (df + 0.5)) for t, (df, _) in counts.items()}, n, total


def best_by_tokens(split: DataFrame, queries: DataFrame, k: int, n: int | None = None, total: int | None = None) -> DataFrame:
    """``bm25`` of documents whose tokens are known (``split``: node_id, updated_s, ts); ``n`` and ``total``, if they are known too: documents and tokens."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("terms"))
    weights, n, total = term_weights(split, asked, n, total)
    blocks = scan.blocks(asked, ["terms"])
    if not weights or not blocks:
        return split.sparkSession.createDataFrame([], f"query_id bigint, node_id {split.schema['node_id'].dataType.simpleString()}, score double, rank_position bigint")
    scored = scan.ranked(split, blocks, k, weights, K1, B, total / n)
    return top_k(scored, k, [F.desc("score"), F.desc_nulls_last("updated_s"), F.asc("node_id")], "query_id")


def grams(text: Column, size: Column | int) -> Column:
    """The different runs of ``size`` characters of a text. Characters are split once, so the cost is linear in the text's length."""
    chars = F.split(text, "")
    width = F.lit(size) if isinstance(size, int) else size

    def runs(cs: Column) -> Column:
        at = F.when(F.size(cs) >= width, F.sequence(F.lit(1), F.size(cs) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(cs, i, width), ""))

    # The characters are bound to a name, or they would be split again for every run.
    return F.array_distinct(F.get(F.transform(F.array(F.filter(chars, lambda c: c != "")), runs), F.lit(0)))


#: Characters of a gram; a shorter term is a gram of its own.
GRAM = 3


def holding_fields(fields: DataFrame, terms: DataFrame) -> DataFrame:
    """field, term of the fields (``field``) that hold a term (``term``) as a substring.

    Postings of grams lead from a term's rarest gram to the fields that may hold it, and the substring test proves it. Gram sizes that no
    term needs are not made; a field's grams are as many as its characters at most.
    """
    size = F.least(F.length("term"), F.lit(GRAM))
    asked = terms.select("term", size.alias("size")).distinct().withColumn("gram", F.explode(grams(F.col("term"), F.col("size"))))
    # One row, of three numbers at most.
    sizes = asked.agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    cut = fields.select("field").distinct().join(F.broadcast(sizes))
    cut = cut.select("field", F.explode(F.flatten(F.transform("sizes", lambda n: grams(F.col("field"), n)))).alias("gram"))
    postings = cut.join(asked.select("gram").distinct(), "gram", "left_semi")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    met = rarest.select("term", F.col("r.gram").alias("gram")).join(postings, "gram")
    return met.filter(F.contains("field", "term")).select("field", "term")


def term_counts(docs: DataFrame, queries: DataFrame, k: int | None, id_col: str = "node_id", text_col: str = "search_text") -> DataFrame | None:
    """``scan.held_terms`` of the documents and queries (query_id, q, terms); none without queries."""
    blocks = scan.blocks(queries, ["q", "terms"])
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    late = F.col("updated_s").cast("bigint") if "updated_s" in docs.columns else F.lit(None).cast("bigint")
    rows = docs.select(F.col(id_col).alias("node_id"), late.alias("updated_s"), low.alias("low"), T.fields(low).alias("fields"))
    return scan.held_terms(rows, blocks, k) if blocks else None


def containment(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "node_id", text_col: str = "search_text") -> DataFrame:
    """Score (terms + 1) for the whole query plus 1 for each term that a document holds as a substring.

    A term has no blanks, so it lies inside one field of the text: terms meet the different fields of a batch, where the documents are
    read (``scan.held_terms``). Only documents with all terms of a query are searched for the whole of it.
    """
    asked = queries.select("query_id", F.lower("query_text").alias("q"), T.fields(F.col("query_text")).alias("terms"))
    held = term_counts(docs, asked, k, id_col, text_col)
    if held is None:
        return docs.sparkSession.createDataFrame([], f"query_id bigint, node_id {docs.schema[id_col].dataType.simpleString()}, score bigint, rank_position bigint")
    total = held.select("query_id", "node_id", "updated_s", (F.col("n") + F.when(F.col("whole"), F.col("size") + 1).otherwise(0)).alias("score"))
    best = top_k(total, k, [F.desc("score"), F.desc_nulls_last("updated_s"), F.asc("node_id")], "query_id")
    return best.select("query_id", "node_id", "score", "rank_position")


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, and ``second`` for the queries that ``first`` has nothing for."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def entity_mentions(queries: DataFrame, entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """query_id, entity_id, matched_text: names (and ``aliases``: entity_id, alias) that a query holds as whole words.

    Names become keys of their words, queries become their runs of as many words as names have,
    so the substring test is an equi-join.
    """
    names = entities.select("entity_id", F.col("canonical_name").alias("name"))
    if aliases is not None:
        names = names.unionAll(aliases.join(entities.select("entity_id"), "entity_id", "left_semi").select("entity_id", F.col("alias").alias("name")))
    names = names.select("entity_id", tokens(F.col("name")).alias("ts")).filter(F.size("ts") > 0).select("entity_id", F.size("ts").alias("n"), F.array_join("ts", " ").alias("key")).distinct()
    lengths = names.agg(F.array_sort(F.collect_set("n")).alias("lengths"))  # one row, of the different lengths only
    grams = queries.select("query_id", tokens(F.col("query_text")).alias("ts")).join(F.broadcast(lengths))
    runs = F.flatten(
        F.transform(
            F.filter("lengths", lambda n: n <= F.size("ts")),
            lambda n: F.transform(F.sequence(F.lit(1), F.size("ts") - n + 1), lambda i: F.array_join(F.slice("ts", i, n), " ")),
        )
    )
    asked = grams.select("query_id", F.explode(F.array_distinct(runs)).alias("key"))
    return asked.join(names.select("entity_id", "key"), "key").select("query_id", "entity_id", F.col("key").alias("matched_text"))
