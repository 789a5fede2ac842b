"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the shingle and quality operators: runs of anything but the space and \t..\r.
BLANKS = r"[\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()
_SCRATCH: list[str] = []


#: Bytes of a batch that goes to a Python worker, at most (a longer text makes a batch of its own).
ARROW_BYTES = 1 << 20


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application: their Python workers need
    it wherever the driver was started. Every operator with a Python worker calls this
    itself. Batches are kept small, as a worker and its executor hold several at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="engramix-")
    # The driver serves the archive from here until it ends.
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/engramix", "zip", root, "engramix"))
    _SHIPPED.add(context.applicationId)


def give_back() -> None:
    """Return a Python worker's freed memory to the machine: workers are reused by later stages
    and count towards their executor's memory meanwhile."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character left as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda that names a computed column directly would compute it again for
    every element, as the optimizer may fold the column into the lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_words(text: Column) -> Column:
    """The words between blanks; no text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where the session names none (tests on one machine) a temporary folder
    is made and kept in the session's settings.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        folder = tempfile.mkdtemp(prefix="engramix-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/engramix-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def scratch_mark() -> int:
    """The number of tables written so far, for ``clear_scratch``."""
    return len(_SCRATCH)


def clear_scratch(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete the tables that operators of this process have written (those between two marks), and
    give their number. To be called once the results that read them are stored: results are lazy, so no operator can tell."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for name in _SCRATCH[since:until]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    del _SCRATCH[since:until]
    return n


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and
    a lost executor costs only the tasks that it ran."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Up to so many rows (an id and a hash each) a list of row keys is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000


def appended(names: list[str], wanted: list[str]) -> list[str]:
    """``wanted`` names for further columns; one that is taken (whatever its case) gets underscores in front."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed_rows(docs: DataFrame, keys: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` semi- or anti-joined (``how``) with ``keys`` (id, key): the id, null-safe, and the
    64-bit hash of the text. The keys are broadcast only after they are counted."""
    keys = keys.select(F.col("id").alias("__k_id"), F.col("key").alias("__k_key"))
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return docs.join(keys, docs[id_col].eqNullSafe(F.col("__k_id")) & (F.xxhash64(docs[text_col]) == F.col("__k_key")), how)


def prefix_sums(values: Column, block: int = 512) -> Column:
    """``[v0, v0+v1, ...]`` of an array of longs, in blocks so that long arrays
    don't cost the square of their length."""

    def running(part: Column) -> Column:
        return F.aggregate(
            part,
            F.array().cast("array<bigint>"),
            lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x)),
        )

    def blocked(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        parts = F.transform(starts, lambda b: running(F.slice(v, b * block + 1, F.lit(block))))

        def join(p: Column) -> Column:
            totals = running(F.transform(p, lambda x: F.element_at(x, -1)))
            return let(
                totals,
                lambda t: F.flatten(
                    F.transform(
                        p,
                        lambda part, b: F.transform(part, lambda x: x + F.when(b > 0, F.get(t, b - 1)).otherwise(F.lit(0).cast("bigint"))),
                    )
                ),
            )

        return let(parts, join)

    return let(
        values,
        lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).when(F.size(v) <= block, running(v)).otherwise(blocked(v)),
    )


def prefix_max(values: Column, block: int = 512) -> Column:
    """``[v0, max(v0, v1), ...]`` of an array of longs, in blocks like ``prefix_sums``."""

    def running(part: Column) -> Column:
        last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-(1 << 62)))
        return F.aggregate(part, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.greatest(last(acc), x.cast("bigint")))))

    def blocked(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        parts = F.transform(starts, lambda b: running(F.slice(v, b * block + 1, F.lit(block))))

        def join(p: Column) -> Column:
            tops = running(F.transform(p, lambda x: F.element_at(x, -1)))
            return let(
                tops,
                lambda t: F.flatten(F.transform(p, lambda part, b: F.transform(part, lambda x: F.greatest(x, F.coalesce(F.when(b > 0, F.get(t, b - 1)), x))))),
            )

        return let(parts, join)

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).when(F.size(v) <= block, running(v)).otherwise(blocked(v)))


#: Characters of a text's blocks.
TEXT_BLOCK = 1024


def text_blocks(text: Column) -> Column:
    """A text in blocks of ``TEXT_BLOCK`` characters, in one pass. ``substring`` counts characters from a text's start, so
    cutting many pieces from a text costs the square of its length; from blocks it doesn't."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` (counted from 0) of a text in blocks; fewer where it ends."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    last = F.floor((start + F.greatest(length, F.lit(1)) - 1) / TEXT_BLOCK).cast("int")
    piece = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(length <= 0, F.lit("")).otherwise(F.substring(piece, (start - first * TEXT_BLOCK + 1).cast("int"), length.cast("int")))


def regex_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<s, e, m>>``: start and end
    (exclusive) in code points, and the matched string.

    The pieces between the matches come from ``split`` with the same pattern; a
    running sum over the lengths of pieces and matches gives the positions.
    The pattern must not match the empty string.
    """

    def spans(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        lengths = F.zip_with(
            F.slice(pieces, F.lit(1), F.size(found)),
            found,
            lambda p, m: (F.length(p) + F.length(m)).cast("bigint"),
        )
        return let(
            prefix_sums(lengths),
            lambda ends: F.zip_with(
                found, ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"))
            ),
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")),
    )


def coverage(starts: Column, width: Column | int) -> Column:
    """Count of positions in the union of ``[s, s + width)``; ``starts`` ascending."""
    width = F.lit(width) if isinstance(width, int) else width
    return let(
        starts,
        lambda s: F.aggregate(
            F.transform(
                s,
                lambda x, i: F.least(width, F.coalesce(F.get(s, i + 1) - x, width)).cast("bigint"),
            ),
            F.lit(0).cast("bigint"),
            lambda a, x: a + x,
        ),
    )
