"""Idempotent upserts, alias resolution, stable keys and cache upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensure(have: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` with the rows of ``fresh`` whose keys it lacks."""
    return have.unionByName(fresh.dropDuplicates(keys).join(have.select(*keys), keys, "left_anti"))


def replace(have: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` with the rows of ``fresh`` in place of those with the same keys."""
    return have.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """alias, entity_id: of several entities the surest, then the latest."""
    best = F.max(F.struct("confidence", "created", "entity_id")).alias("b")
    return aliases.groupBy("alias").agg(best).select("alias", F.col("b.entity_id").alias("entity_id"))


def names_or_aliases(wanted: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, entity_id of entities with that name or alias, each once."""
    by_name = wanted.join(entities, "name").select("name", "entity_id")
    return by_name.union(wanted.join(aliases.withColumnRenamed("alias", "name"), "name").select("name", "entity_id")).distinct()


def node_key(kind: Column, key: Column) -> Column:
    """A stable positive number of a node, from its kind and id."""
    digest = F.sha2(F.concat(kind, F.lit("\0"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def mark_orphans(cache: DataFrame, refs: DataFrame) -> DataFrame:
    """cache_key, kept: whether anything still refers to a cached row."""
    hit = refs.select("cache_key", F.lit(True).alias("hit")).distinct()
    return cache.join(hit, "cache_key", "left").select("cache_key", F.coalesce("hit", F.lit(False)).alias("kept"))
