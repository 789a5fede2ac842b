"""Text columns: terms, CJK bigrams, coverage, similarity, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def normalize(text: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def object_key(entity: Column, literal: Column) -> Column:
    return F.when(entity.isNotNull(), F.concat(F.lit("entity:"), entity.cast("string"))).otherwise(
        F.concat(F.lit("literal:"), F.coalesce(normalize(literal), F.lit("")))
    )


def fields(text: Column) -> Column:
    """Lower-case fields between white space, in order, each once."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), ""))


def cjk_bigrams(text: Column) -> Column:
    """Neighbouring pairs inside runs of CJK characters, each once."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CJK}{{2,}})"), F.lit(1))
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.array_distinct(F.flatten(pairs))


def summary_terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(fields(text), cjk_bigrams(text))))


def word_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, or single CJK characters, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([0-9a-z_]+|{CJK})"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def query_terms(query: Column) -> Column:
    return F.array_distinct(F.concat(fields(query), cjk_bigrams(query)))


def match_lowered(query: Column, terms: Column, low: Column) -> Column:
    """1 where the lower-cased text holds the whole (normalised) query, else the share of its terms that it holds."""
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    return F.when(F.contains(low, query) & (query != ""), 1.0).when(F.size(terms) == 0, 0.0).otherwise(hits / F.size(terms))


def match_score(query: Column, text: Column) -> Column:
    return match_lowered(normalize(query), query_terms(query), F.lower(F.coalesce(text, F.lit(""))))


def join_unique(pieces: Column) -> Column:
    """Non-empty pieces joined by blanks; a piece that the text already holds is left out."""
    return F.aggregate(
        pieces,
        F.lit(""),
        lambda acc, p: F.when(p.isNull() | (F.trim(p) == "") | F.contains(F.lower(acc), F.lower(F.trim(p))), acc)
        .when(acc == "", F.trim(p))
        .otherwise(F.concat(acc, F.lit(" "), F.trim(p))),
    )


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order and repetitions."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def cjk_heavy(text: Column) -> Column:
    """Han characters, and at least a third as many as ASCII letters."""
    han, latin = F.regexp_count(text, F.lit(r"\p{IsHan}")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return (han > 0) & (han >= F.greatest(F.lit(1), F.floor(latin / 3)))


def has_ascii_letter(text: Column) -> Column:
    return text.rlike("[A-Za-z]")
