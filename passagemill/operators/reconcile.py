"""Files on disk against files in the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.titles import EXTENSIONS, extension
from passagemill.operators.search import in_scope
from passagemill.plans.passages import SCHEME_VERSION

MAX_FILE_SIZE = 104_857_600


def scanned_once(entries: DataFrame) -> DataFrame:
    """One row per path (the largest of repeated ones)."""
    return entries.groupBy(F.col("path").alias("source")).agg(F.max(F.struct("mtime", "size")).alias("x")).select("source", F.col("x.size").alias("size"), F.col("x.mtime").alias("disk_mtime"), F.lit(True).alias("on_disk"))


def _met(entries: DataFrame, indexed: DataFrame, scopes: list[str] | None) -> DataFrame:
    files = indexed.where((F.col("source_type") == "file") & in_scope(F.col("source"), scopes))
    known = files.select("source", "mtime", "file_hash", "scheme_version", F.lit(True).alias("in_index"))
    return scanned_once(entries).where(in_scope(F.col("source"), scopes)).join(known, "source", "full_outer")


def _stale() -> Column:
    return F.coalesce("scheme_version", F.lit(0)) < SCHEME_VERSION


def unreadable(source: Column, supported: list[str]) -> Column:
    """Whether a file is of a kind that only a missing extra could read."""
    return ~extension(source).isin(supported)


def sync_diff(entries: DataFrame, indexed: DataFrame, max_file_size: int = MAX_FILE_SIZE, scopes: list[str] | None = None, hashes: DataFrame | None = None, supported: list[str] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """``(source, action)``: oversized, ingest, unchanged, delete or unreadable.

    Times decide first; ``hashes(source, hash)`` is only asked where they differ.  ``existing`` lists
    paths that are still there though the scan has no reader for them.
    """
    met = _met(entries, indexed, scopes)
    met = met.join(hashes.select("source", "hash"), "source", "left") if hashes is not None else met.withColumn("hash", F.lit(None).cast("string"))
    met = met.join(existing.select("source", F.lit(True).alias("there")), "source", "left") if existing is not None else met.withColumn("there", F.lit(None).cast("boolean"))
    action = (
        F.when(F.col("on_disk").isNull(), F.when(unreadable(F.col("source"), supported or EXTENSIONS) & F.coalesce("there", F.lit(False)), "unreadable").otherwise("delete"))
        .when(F.col("size") > max_file_size, "oversized")
        .when(F.col("in_index").isNull() | _stale(), "ingest")
        .when(F.col("disk_mtime") == F.col("mtime"), "unchanged")
        .when(F.col("hash") == F.col("file_hash"), "unchanged")
        .otherwise("ingest")
    )
    return met.select("source", action.alias("action"))


def file_states(entries: DataFrame, indexed: DataFrame, scopes: list[str] | None = None, hashes: DataFrame | None = None, supported: list[str] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """``(source, state)`` of files on disk, and of indexed sources that are no files.  Indexed files
    the scan has no reader for are ``unreadable`` if ``existing`` lists them; vanished ones are left out."""
    every = _met(entries, indexed, scopes)
    met = every.where("on_disk")
    met = met.join(hashes.select("source", "hash"), "source", "left") if hashes is not None else met.withColumn("hash", F.lit(None).cast("string"))
    by_scheme = F.when(_stale(), "stale_scheme").otherwise("ingested")
    same = (F.col("disk_mtime") == F.col("mtime")) | F.coalesce(F.col("hash") == F.col("file_hash"), F.lit(False))
    files = met.select("source", F.when(F.col("in_index").isNull(), "not_ingested").when(same, by_scheme).otherwise("stale").alias("state"))
    others = indexed.where((F.col("source_type") != "file")).select("source", by_scheme.alias("state"))
    if existing is not None:
        there = existing.select("source").distinct()
        kept = every.where(F.col("on_disk").isNull() & unreadable(F.col("source"), supported or EXTENSIONS)).join(there, "source", "left_semi")
        files = files.unionByName(kept.select("source", F.lit("unreadable").alias("state")))
    return files.unionByName(others)


def replace_sources(chunks: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """The index after ``sources`` were replaced by the rows of ``fresh`` (none: deleted)."""
    kept = chunks.join(sources.select("source").distinct(), "source", "left_anti").select(*chunks.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)
