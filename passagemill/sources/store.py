"""The index: passages and postings in parts by source, and a manifest that moves when a change is whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.operators.reconcile import replace_sources
from passagemill.operators.search import postings

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("source_type", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("file_hash", T.StringType()),
        T.StructField("mtime", T.DoubleType()), T.StructField("ingested_at", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("ocr_engine", T.StringType()), T.StructField("scheme_version", T.IntegerType()),
    ]
)


class DimensionMismatchError(ValueError):
    """The index holds vectors of another length."""


PARTS = 64  #: of a new index; a source belongs to one by the hash of its name
POSTINGS = "part int, field string, term string, id string, source string, tf bigint, dl int"


class IndexStore:
    """Readers see what the manifest names.  A change writes new files for the parts its sources belong
    to, with their postings, and then moves the manifest; all other parts stay as they are.  Files of
    the state before stay for those who still read it and go with the next change.

    The manifest is moved through the Hadoop file system of the path, so the index lies wherever all
    executors can read and write.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, parts: int = PARTS):
        self.spark, self.path, self.dim, self.parts = spark, path.rstrip("/"), dim, parts
        found = self._manifest()
        if found:
            self.parts = found.get("parts", parts)
            if found["dim"] != dim:
                raise DimensionMismatchError(f"the index at {path} holds vectors of {found['dim']}, not {dim} numbers")

    # -- files ----------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict | None:
        if not self._files().exists(self._path("current.json")):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/current.json", wholetext=True).first()[0])

    def _move(self, manifest: dict) -> None:
        jvm, files = self.spark._jvm, self._files()
        fresh, name = self._path(f".{uuid.uuid4().hex}.json"), self._path("current.json")
        out = files.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(fresh), files.makeQualified(name), options)

    # -- reading --------------------------------------------------------------------------------

    def part_of(self, source: Column) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(self.parts)).cast("int")

    def read(self, source: str | None = None) -> DataFrame:
        """All passages, or those of one source, of whose part alone the files are read."""
        found = self._manifest()
        rows = self._rows(found, None if source is None else [self.spark.range(1).select(self.part_of(F.lit(source))).first()[0]])
        return rows if source is None else rows.where(F.col("source") == source)

    def _rows(self, found: dict | None, parts: list[int] | None = None) -> DataFrame:
        if found is None:
            return self.spark.createDataFrame([], SCHEMA)
        if "snapshot" in found:  # the layout before parts
            rows = self.spark.read.parquet(f"{self.path}/{found['snapshot']}")
        else:
            places = [f"{self.path}/{x['rows']}" for n, x in found["held"].items() if parts is None or int(n) in parts]
            rows = self.spark.read.schema(SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], SCHEMA)
        missing = {"parent_id": F.lit(""), "ocr_engine": F.lit(""), "scheme_version": F.lit(0)}
        for name, value in missing.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, value)
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA])

    def postings(self) -> tuple[DataFrame, DataFrame] | None:
        """The stored postings ``(field, term, id, source, tf, dl)``, by term within each file, and the
        totals ``(field, n, avgdl)``; None for an index that has none yet."""
        found = self._manifest()
        if found is None or "held" not in found or not found["held"]:
            return None
        rows = self.spark.read.schema(POSTINGS).parquet(*[f"{self.path}/{x['postings']}" for x in found["held"].values()]).drop("part")
        totals = []
        for field in ("text", "title"):
            n, words = (sum(x[key][field] for x in found["held"].values()) for key in ("n", "words"))
            totals.append((field, n, words / n if n else 0.0))
        return rows, self.spark.createDataFrame(totals, "field string, n bigint, avgdl double")

    # -- writing --------------------------------------------------------------------------------

    def commit(self, rows: DataFrame, parts: list[int] | None = None) -> None:
        """Make ``rows`` the content of the index, or of the given parts of it."""
        before = self._manifest() or {}
        name = f"data-{uuid.uuid4().hex}"
        parted = rows.select(*SCHEMA.fieldNames()).withColumn("part", self.part_of(F.col("source")))
        parted.repartition("part", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("part", "source", "chunk_index").write.partitionBy("part").parquet(f"{self.path}/{name}/rows")
        # The postings are made from what was written, so that nothing is computed twice.
        written = self.spark.read.schema(T.StructType([*SCHEMA.fields, T.StructField("part", T.IntegerType())])).parquet(f"{self.path}/{name}/rows")
        both = [postings(written, field).withColumn("field", F.lit(field)) for field in ("text", "title")]
        where = written.select("id", "source", "part")
        listed = both[0].unionByName(both[1]).join(where, "id").select("part", "field", "term", "id", "source", "tf", "dl")
        listed.repartition("part", "field", F.pmod(F.xxhash64("term"), F.lit(4))).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{self.path}/{name}/postings")
        sizes = [F.size(F.regexp_extract_all(F.lower(F.coalesce(f, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))) for f in ("text", "title")]
        totals = written.groupBy("part").agg(F.count("*").alias("n"), F.sum(sizes[0]).alias("text"), F.sum(sizes[1]).alias("title")).collect()  # a row a part
        made = self._files()
        held = {} if parts is None else {k: v for k, v in before.get("held", {}).items() if int(k) not in parts}
        for r in totals:
            terms = f"{name}/postings/part={r['part']}"
            if not made.exists(self._path(terms)):
                made.mkdirs(self._path(terms))
            held[str(r["part"])] = {"rows": f"{name}/rows/part={r['part']}", "postings": terms, "n": {"text": r["n"], "title": r["n"]}, "words": {"text": r["text"], "title": r["title"]}}
        used = {x["rows"].split("/")[0] for x in held.values()}
        held_before = {x["rows"].split("/")[0] for x in before.get("held", {}).values()} | {before[k] for k in ("snapshot",) if k in before}
        self._move({"dim": self.dim, "parts": self.parts, "held": held, "before": sorted(held_before - used)})
        for old in [*before.get("before", []), name]:
            if old not in used and old not in held_before:
                made.delete(self._path(old), True)

    def _touched(self, sources: DataFrame) -> list[int] | None:
        """The parts that hold the sources; all of them for an index of the layout before parts."""
        if "held" not in (self._manifest() or {"held": {}}):
            return None
        return sorted(r[0] for r in sources.select(self.part_of(F.col("source"))).distinct().collect())  # at most as many as there are parts

    def replace(self, fresh: DataFrame, sources: DataFrame) -> None:
        """Replace all passages of ``sources`` by those of ``fresh``; none: they are deleted."""
        parts = self._touched(sources)
        self.commit(replace_sources(self._rows(self._manifest(), parts), fresh.select(*SCHEMA.fieldNames()), sources), parts)

    def drop(self, sources: DataFrame) -> None:
        self.replace(self.spark.createDataFrame([], SCHEMA), sources)

    def delete(self, source: str) -> int:
        n = self.read(source).count()
        if n:
            self.drop(self.spark.createDataFrame([(source,)], "source string"))
        return n
