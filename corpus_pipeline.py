"""A corpus pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``:

1. language ID drops texts without a determined language;
2. MinHash near-dedup keeps one document of each group (five-word shingles, similarity 0.8);
3. benchmark decontamination drops documents that hold a window of a benchmark item;
4. PII redacts personal data in the texts and counts their characters anew;
5. SentencePiece adds the texts' piece ids, and whether these decode to the text.

Empty tables, null columns and repeated rows pass through every stage (see the
operators); of repeated rows, stage 2 keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix.llm import decontaminate, language_id, near_dup, pii, sentencepiece_scan
from engramix.llm.common import appended, clear_scratch, materialize, read_table, scratch_mark

#: Below this probability a language counts as undetermined.
LEAST_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    pred, score = appended(docs.columns, ["__lang", "__score"])
    found = language_id.identify(docs, model, pred_col=pred, score_col=score)
    sure = (F.col(pred) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return found.filter(sure).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs, shingle_words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact_pii(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids, decoded = appended(docs.columns, ["piece_ids", "__decoded"])
    (decodes,) = appended([*docs.columns, ids], ["decodes"])
    encoded = sentencepiece_scan.encode(docs, ids_col=ids, decoded_col=decoded)
    return encoded.select(*docs.columns, ids, F.col(decoded).eqNullSafe(F.col("text")).alias(decodes))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Language ID, near-dedup and SentencePiece have no SQL form; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage's result is written, its inner tables are deleted."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = scratch_mark()
        result = stage(spark, docs, sf_dir)
        inner = scratch_mark()
        docs = materialize(result)
        clear_scratch(spark, before, inner)
    return STAGES[-1][1](spark, docs, sf_dir)
