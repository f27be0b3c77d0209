"""Document, chunk and job tables on Parquet: upserts, deletes and states by plans over append-only rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampType

from pagewright.functions.scalars import failure_reason

DOCUMENT_STATES = ("uploaded", "processing", "ready", "failed")
JOB_STATES = ("queued", "running", "completed", "failed")


def _fields(strings: str, ints: str = "", times: str = "") -> StructType:
    return StructType([StructField(c, StringType()) for c in strings.split()] + [StructField(c, IntegerType()) for c in ints.split()] + [StructField(c, TimestampType()) for c in times.split()])


DOCUMENTS = _fields("id title original_filename mime_type file_path status category owner", "version", "created_at updated_at")
CHUNKS = _fields("document_id chunk_id title section checksum vector_point_id keyword_document_id", "chunk_index page token_count", "created_at")
JOBS = _fields("id document_id status failure_reason", "retry_count", "created_at updated_at")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; of equal order the one that is largest as a whole."""
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in others])).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with changed keys replaced; of repeated changes of a key the last by ``_seq`` holds. A null key is a key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_seq")))
    last = changes.withColumn("_turn", turn).filter("_turn = 1").drop("_turn", "_seq")
    gone = last.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return table.join(gone, same, "left_anti").unionByName(last)


def delete_documents(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in ``gone`` (document_id). Tables: name -> (rows, id column)."""
    return {name: (rows.join(gone.select(F.col("document_id").alias(key)), key, "left_anti")) for name, (rows, key) in tables.items()}


def list_documents(documents: DataFrame) -> DataFrame:
    return documents.select("id", "title", "original_filename", "mime_type", "status", "version", "created_at", "updated_at").orderBy(F.desc("created_at"), "id")


def ready_counts(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count_if(F.col("status") == "ready").alias("ready"), F.count(F.lit(1)).alias("total"))


def payload_filter(points: DataFrame, field: str, value) -> DataFrame:
    """Points whose payload field equals a value."""
    return points.filter(F.col("payload").getField(field) == F.lit(value))


def term_filter(rows: DataFrame, field: str, value) -> DataFrame:
    """Keyword documents whose field is exactly a value."""
    return rows.filter(F.col("document").getField(field) == F.lit(value))


def poll_state(documents: DataFrame, document_id: str) -> DataFrame:
    """The document's state where it is final; no row while it is not."""
    return documents.filter((F.col("id") == document_id) & F.col("status").isin("ready", "failed")).select("id", "status")


def failed_job(jobs: DataFrame, message) -> DataFrame:
    return jobs.withColumns({"status": F.lit("failed"), "failure_reason": failure_reason(message)})


class ParquetTable:
    """A keyed table as versions in a folder. A write makes a new version and then an empty pointer file for it, whose
    number is the largest; a reader takes the largest pointer there is, so no path is ever overwritten and a crash leaves
    the last version in place. Older versions than the one before are removed."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def _current(self) -> str | None:
        found = self._pointers()
        return found[-1][1] if found else None

    def _fs(self, path: str):
        made = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), made

    def _pointers(self) -> list[tuple[int, str]]:
        fs, folder = self._fs(f"{self.path}/pointers")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names if "-" in n)

    def read(self) -> DataFrame:
        """The current rows; an empty table where nothing was written."""
        version = self._current()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def replace(self, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        before = self._pointers()
        rows.write.parquet(f"{self.path}/{version}")
        fs, pointer = self._fs(f"{self.path}/pointers/{(before[-1][0] if before else 0) + 1:012d}-{version}")
        fs.createNewFile(pointer)
        number, first = next(p for p in self._pointers() if p[0] == (before[-1][0] if before else 0) + 1)
        if first != version:
            fs.delete(pointer, False)
            raise RuntimeError(f"{self.path}: another writer came first")
        for number, old in before[:-1]:
            for gone in (f"{self.path}/pointers/{number:012d}-{old}", f"{self.path}/{old}"):
                where, path = self._fs(gone)
                where.delete(path, True)

    def upsert(self, changes: DataFrame) -> None:
        self.replace(upsert(self.read(), changes, self.keys))

    def delete_documents(self, gone: DataFrame, key: str = "document_id") -> None:
        self.replace(self.read().join(gone.select(F.col("document_id").alias(key)), key, "left_anti"))
