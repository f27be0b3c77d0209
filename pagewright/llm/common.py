"""Shared folder tables, text folding, bounded membership filters and small SQL fragments of the corpus operators."""

from __future__ import annotations

import contextlib
import contextvars
import json
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bits of a membership filter at most (16 MB), and bits for each key below that.
FILTER_BITS = 1 << 27
BITS_A_KEY = 16
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 1 << 15

_recorded: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("recorded", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a qualified path: ``spark.checkpoint.dir``, else the folder given
    to ``SparkContext.setCheckpointDir``. Where neither is set, a local master gets a folder of its own (it has one
    machine only) and any other an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        context.setCheckpointDir(found)
        found = context.getCheckpointDir()
    path = context._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if (made := _recorded.get()) is not None:
        made.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the scratch paths that are made inside, for ``delete_path`` once the results over them are used up."""
    made: list[str] = []
    token = _recorded.set(made)
    try:
        yield made
    finally:
        _recorded.reset(token)


class Table:
    """A DataFrame written to the shared folder; lost executors cost nothing that is not on shared disk."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, tag)
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


class MaybeIn:
    """A membership filter: one hashed bit for each row of ``keys``, BITS_A_KEY bits a key and FILTER_BITS at most, so
    that it may be broadcast at every size. A row it rejects is surely not among the keys; one it lets through may be,
    and is for the caller to join. Beyond FILTER_BITS / BITS_A_KEY keys it lets ever more rows through, at worst all."""

    def __init__(self, keys: DataFrame, *names: str):
        wanted = BITS_A_KEY * keys.count()
        self.bits = max(BITMAP_BITS, min(FILTER_BITS, 1 << max(0, wanted - 1).bit_length()))
        place = keys.select(self._place(*[F.col(c) for c in names]).alias("place"))
        maps = place.groupBy(F.expr(f"place div {BITMAP_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % BITMAP_BITS).alias("bitmap"))
        self.table = Table(maps, "filter")

    def _place(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.bits))

    def split(self, rows: DataFrame, *key: Column) -> tuple[DataFrame, DataFrame]:
        """(rows whose key may be among the keys, rows whose key is not), with the columns of ``rows``. No row moves."""
        marked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), self._place(*key).alias("place"))
        marked = marked.select("row", F.expr(f"place div {BITMAP_BITS}").alias("bucket"), (F.col("place") % BITMAP_BITS).cast("int").alias("bit"))
        met = marked.join(F.broadcast(self.table.read()), "bucket", "left")
        byte = F.conv(F.hex(F.expr("substring(bitmap, bit div 8 + 1, 1)")), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, F.col("bit") % 8), F.lit(0)) == 1
        return met.filter(hit).select("row.*"), met.filter(~hit).select("row.*")


def without(rows: DataFrame, bad: DataFrame, names: list[str], key: list[Column]) -> DataFrame:
    """The rows whose key is not among ``bad`` (a stored table of few rows against ``rows``; its columns ``names`` match
    ``key``, null equal to null). Only rows that the filter lets through are exchanged."""
    maybe, surely = MaybeIn(bad, *names).split(rows, *key)
    inner = bad.select(*[F.col(c).alias(f"_bad_{c}") for c in names])
    keyed = maybe.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[k.alias(f"_key_{c}") for c, k in zip(names, key, strict=True)])
    same = [F.col(f"_key_{c}").eqNullSafe(F.col(f"_bad_{c}")) for c in names]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return surely.unionByName(keyed.join(inner, on, "left_anti").select("row.*"))


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text, the split key of the training folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def inline_rows(spark: SparkSession, rows: list, fields: str) -> DataFrame:
    """A small driver-side list as a DataFrame without leaving the JVM: ``fields`` is a DDL struct body."""
    names = [f.strip().split(":")[0] for f in fields.split(",")]
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{fields}>>")))
