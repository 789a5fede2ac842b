"""Quality rules (operator 3): a rule bitmask ledger.

``measure`` takes all measurements of a text in one pass; ``ledger`` evaluates
every rule once and keeps the measurements with one failure bit per rule.
Policies are versioned masks over those bits: applying another policy, or
computing what a rule alone rejects, is bit arithmetic over the ledger and
never reads the texts again.

Null and empty texts have no words and fail ``too_few_words``. Repeated rows
give repeated results. 5-word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, coverage, let

WINDOW = 5
#: (rule, failing condition over the measurements). A rule's bit is its place; only append.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    ("shouting", "n_words >= 10 AND 2 * n_upper > word_chars"),
    ("exclamations", "2 * n_marks > n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: The rules of each policy version; "base" is the minimum that any policy includes.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": [name for name, _ in RULES],
}


def policy_mask(version: str) -> int:
    return reduce(lambda a, b: a | b, (BITS[name] for name in POLICIES[version]), 0)


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more."""

    def located(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: coverage(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda e, j: F.coalesce((j > 0) & (F.get(s, j - 1)["h"] == e["h"]), F.lit(False))
                            | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)),
                        ),
                        lambda e: e["i"],
                    )
                ),
                WINDOW,
            ),
        )

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    zero = F.lit(0).cast("bigint")
    return F.when(
        F.size(words) >= WINDOW,
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), located(h)).otherwise(zero)),
    ).otherwise(zero)


def _without(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("bigint")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        F.col(id_col).alias(id_col),
        let(
            blank_words(text),
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                _repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("bigint").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            ),
        ).alias("l"),
        _without(text, r"[#*$%&|<>]+").alias("n_symbols"),
        _without(text, r"\p{Lu}+").alias("n_upper"),
        _without(text, "!+").alias("n_marks"),
    ).select(id_col, "w.*", "l.*", "n_symbols", "n_upper", "n_marks")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failure_bits``: every rule evaluated once per text."""
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        (F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)).cast("bigint") for name, condition in RULES),
    )
    return measure(docs, id_col, text_col).withColumn("failure_bits", bits)


def fails(version: str) -> Column:
    """Whether a ledger row fails a policy."""
    return F.col("failure_bits").bitwiseAND(F.lit(policy_mask(version)).cast("bigint")) != 0


def apply_policies(rows: DataFrame, versions: list[str], id_col: str = "doc_id") -> DataFrame:
    """One ``kept_<version>`` column per policy version."""
    return rows.select(id_col, "failure_bits", *[(~fails(v)).alias(f"kept_{v}") for v in versions])


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that fail nothing else, and rows kept without it."""
    mask = policy_mask(version)
    active = F.col("failure_bits").bitwiseAND(F.lit(mask).cast("bigint"))
    aggregates = []
    for name in POLICIES[version]:
        bit = F.lit(BITS[name]).cast("bigint")
        rest = F.lit(mask & ~BITS[name]).cast("bigint")
        aggregates.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.count_if(active.bitwiseAND(bit) != 0).alias("n_failed"),
                F.count_if(active == bit).alias("n_failed_only"),
                F.count_if(active.bitwiseAND(rest) == 0).alias("n_kept_without"),
            )
        )
    return rows.agg(F.array(*aggregates).alias("r")).select(F.inline("r"))
