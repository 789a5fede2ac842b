"""Labelled samples for the classifiers: bounded, spread evenly over the labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import give_back, ship_package

#: Values of the hash by which rows are thinned out.
HASHES = 1 << 31
#: How many times ``per_label`` rows pass the thinning, so that enough are left.
MARGIN = 4


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids have none."""
    return F.crc32(id_col.cast("string")) % modulus


def balanced_ids(labelled: DataFrame, label: str, per_label: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_label`` ids of each label, by the order of a hash of the id.

    Labels are counted first; ids whose hash lies above a threshold of the label's count are
    left out where they are read, so about ``MARGIN * per_label`` rows of a label are
    ranked, however many it has.
    """
    named = labelled.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("s_id"), F.col(label).alias("label"))
    counts = named.groupBy("label").agg(F.count(F.lit(1)).alias("c")).select(F.col("label").alias("c_label"), "c")
    share = F.least(F.lit(1.0), F.lit(float(MARGIN * per_label + 100)) / F.col("c"))
    # One row per label: classes of a model that is far larger.
    thinned = named.join(F.broadcast(counts), F.col("label") == F.col("c_label")).filter(F.pmod(F.xxhash64("s_id"), F.lit(HASHES)) < share * HASHES)
    order = W.partitionBy("label").orderBy(F.xxhash64("s_id"), "s_id")
    return thinned.select("s_id", "label", F.row_number().over(order).alias("place")).filter(F.col("place") <= per_label).select("s_id", "label").distinct()


def sample_features(
    docs: DataFrame, ids: DataFrame, features: Callable[[str], bytes], id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[object, bytes, object]]:
    """(id, ``features`` of the text, label) of the sampled ids, in a fixed order.

    ``ids`` is bounded, so it is broadcast. Texts stay with the executors: the driver gets their
    features, one of an id that is repeated.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["s_id", "label", "found"])
        give_back()

    kinds = {f.name: f.dataType.simpleString() for f in ids.schema.fields}
    rows = (
        docs.select(F.col(id_col).alias("s_id"), F.col(text_col).alias("s_text"))
        .join(F.broadcast(ids), "s_id")
        .select("s_id", "label", "s_text")
        .mapInArrow(run, f"s_id {kinds['s_id']}, label {kinds['label']}, found binary")
        .groupBy("s_id", "label")
        .agg(F.min("found").alias("found"))
        .collect()
    )
    return sorted(((r.s_id, bytes(r.found), r.label) for r in rows), key=lambda r: (r[0], str(r[2])))
