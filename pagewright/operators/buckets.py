"""Keyed tables in hash buckets with delta files, tombstones and one commit over several tables.

A commit writes the changed rows alone, as a generation in a folder of its own, split by the hash of the key. A manifest
names, for each table, its generations and the buckets that each has rows in; the manifest of the largest number is what
readers see, so that a commit over several tables is seen whole or not at all. A writer that dies leaves files that no
manifest names, which ``vacuum`` removes. A bucket with more than MAX_GENERATIONS is rewritten by the commit that makes
it so; no other bucket is read or written then.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Generations of a bucket that a read joins at most.
MAX_GENERATIONS = 6
#: Manifests that stay after ``vacuum``, for readers that began before.
KEPT_MANIFESTS = 2


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Store:
    """Tables by name as (schema, key columns). Null is a key like others; a key stands once in a table. ``buckets`` and
    ``spread`` (files of a bucket in one write) are fixed with the first commit and chosen so that a file fits a task."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[StructType, list[str]]], buckets: int = BUCKETS, spread: int = 1):
        self.spark, self.path, self.tables, self.spread = spark, path.rstrip("/"), tables, spread
        self.buckets = self.manifest().get("buckets", buckets)

    # Files

    def _fs(self, path: str):
        made = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), made

    def _names(self, path: str) -> list[str]:
        fs, folder = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/commits") if n.endswith(".json"))

    def _load(self, number: int) -> dict:
        fs, path = self._fs(f"{self.path}/commits/{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest manifest; that of an empty store where nothing was committed."""
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else {"number": 0, "tables": {}}

    def _publish(self, manifest: dict) -> None:
        """Makes a manifest visible under the next number. An empty lock file, which a file system creates once only,
        settles which of two writers has the number; the manifest then appears whole, by a rename."""
        name = f"{self.path}/commits/{manifest['number']:012d}"
        fs, lock = self._fs(f"{name}.lock")
        fs.mkdirs(lock.getParent())
        if not fs.createNewFile(lock):
            raise Conflict(f"{self.path}: commit {manifest['number']} is taken")
        _, draft = self._fs(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._fs(f"{name}.json")
        if not fs.rename(draft, final):
            raise OSError(f"{name}: manifest could not be renamed")

    # Rows

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.tables[table][1]]), F.lit(self.buckets)).cast("int")

    def _stored(self, table: str) -> StructType:
        return StructType(list(self.tables[table][0].fields)).add("_gone", "boolean")

    def _open(self, table: str, generation: dict, buckets: list[int]) -> DataFrame:
        folders = [f"{self.path}/{table}/{generation['folder']}/_bucket={b}" for b in buckets]
        return self.spark.read.schema(self._stored(table)).parquet(*folders)

    def _rows(self, table: str, generations: list[dict], wanted: set[int] | None = None) -> DataFrame:
        """The rows that count, of all buckets or the wanted ones. Buckets of one generation are read as they are. Of
        others the first generation loses the keys of later ones, by an anti-join in which the deltas are the small side."""
        schema, keys = self.tables[table]
        order: dict[int, list[int]] = defaultdict(list)
        for i, g in enumerate(generations):
            for b in g["buckets"]:
                if wanted is None or b in wanted:
                    order[b].append(i)
        clean, first, later = defaultdict(list), defaultdict(list), defaultdict(list)
        for b, found in order.items():
            (first if len(found) > 1 else clean)[found[0]].append(b)
            for i in found[1:]:
                later[i].append(b)
        empty = self.spark.createDataFrame([], self._stored(table))
        union = lambda parts: [self._open(table, generations[i], sorted(bs)) for i, bs in sorted(parts.items())]
        rows = empty
        for part in union(clean):
            rows = rows.unionByName(part)
        if later:
            deltas = None
            for i, bs in sorted(later.items()):
                part = self._open(table, generations[i], sorted(bs)).withColumn("_turn", F.lit(i))
                deltas = part if deltas is None else deltas.unionByName(part)
            new = _last(deltas, keys, F.col("_turn")).drop("_turn")
            named = new.select(*[F.col(f"`{k}`").alias(f"_key{n}") for n, k in enumerate(keys)])
            same = F.lit(True)
            for n, k in enumerate(keys):
                same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_key{n}"))
            for part in union(first):
                rows = rows.unionByName(part.join(named, same, "left_anti"))
            rows = rows.unionByName(new)
        return rows.filter("not _gone").select(*[F.col(f"`{c}`") for c in schema.names])

    def read(self, table: str) -> DataFrame:
        """The rows of the newest commit, also if later ones follow while they are read."""
        return self._rows(table, self.manifest()["tables"].get(table, []))

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of a bounded set of keys (the key columns), from the buckets of these keys alone."""
        names = self.tables[table][1]
        wanted = {r[0] for r in keys.select(self._bucket(table).alias("b")).distinct().collect()}
        found = self._rows(table, self.manifest()["tables"].get(table, []), wanted)
        return found.join(F.broadcast(keys.select(*names).distinct()), names, "left_semi")

    # Changes

    @contextmanager
    def commit(self) -> Iterator[Change]:
        """Changes that become visible together at the end of the block, or not at all where it raises."""
        change = Change(self, self.manifest())
        yield change
        change.publish()

    def vacuum(self) -> list[str]:
        """Removes, and names, the folders that none of the last KEPT_MANIFESTS manifests names, older manifests, and
        locks of dead writers. To be run while no writer is at work."""
        numbers = self._numbers()
        kept = [self._load(n) for n in numbers[-KEPT_MANIFESTS:]]
        gone = []
        for table in self.tables:
            named = {g["folder"] for m in kept for g in m["tables"].get(table, [])}
            gone += [f"{table}/{n}" for n in self._names(f"{self.path}/{table}") if n not in named]
        valid = {f"{n:012d}.{kind}" for n in numbers[-KEPT_MANIFESTS:] for kind in ("json", "lock")}
        stale = [f"commits/{n}" for n in self._names(f"{self.path}/commits") if not n.endswith(".crc") and n not in valid]
        for name in gone + stale:
            fs, path = self._fs(f"{self.path}/{name}")
            fs.delete(path, True)
        return sorted(gone)


class Change:
    """What one commit changes: rows by key, deletes by key or by the value of any column."""

    def __init__(self, store: Store, base: dict):
        self.store, self.base = store, base
        self.tables = {t: [dict(g) for g in gs] for t, gs in base["tables"].items()}

    def read(self, table: str) -> DataFrame:
        """The rows as this commit would leave them."""
        return self.store._rows(table, self.tables.get(table, []))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Sets the rows of their keys. Of rows of one key that of the largest ``_seq`` counts, if there is such a
        column; of equal ones that of the largest hash."""
        schema, keys = self.store.tables[table]
        seq = F.col("_seq") if "_seq" in rows.columns else F.lit(0)
        named = rows.select(*[F.col(f"`{c}`").cast(schema[c].dataType) for c in schema.names], seq.alias("_turn"))
        self._write(table, _last(named.withColumn("_gone", F.lit(False)), keys, F.col("_turn")).drop("_turn"))

    def delete(self, table: str, gone: DataFrame) -> None:
        """Deletes the rows whose values of the columns of ``gone`` are among its rows; keys are not looked up."""
        schema, keys = self.store.tables[table]
        columns = gone.columns
        found = gone if set(columns) == set(keys) else self.read(table).join(gone.distinct(), columns, "left_semi")
        blank = [F.col(f"`{c}`") if c in keys else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names]
        self._write(table, found.select(*keys).distinct().select(*blank, F.lit(True).alias("_gone")))

    def _write(self, table: str, rows: DataFrame) -> None:
        folder = uuid.uuid4().hex
        keys = [F.col(f"`{k}`") for k in self.store.tables[table][1]]
        rows = rows.withColumn("_bucket", self.store._bucket(table))
        dealt = rows.repartition("_bucket", F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(self.store.spread)))
        dealt.write.partitionBy("_bucket").parquet(f"{self.store.path}/{table}/{folder}")
        touched = sorted(int(n.split("=")[1]) for n in self.store._names(f"{self.store.path}/{table}/{folder}") if n.startswith("_bucket="))
        if touched:
            self.tables.setdefault(table, []).append({"folder": folder, "buckets": touched})
            self._shorten(table)

    def _shorten(self, table: str, most: int = MAX_GENERATIONS) -> None:
        """Rewrites the buckets that have more than ``most`` generations."""
        count: dict[int, int] = defaultdict(int)
        for g in self.tables[table]:
            for b in g["buckets"]:
                count[b] += 1
        full = {b for b, n in count.items() if n > most}
        if not full:
            return
        rows = self.store._rows(table, self.tables[table], full)
        for g in self.tables[table]:
            g["buckets"] = [b for b in g["buckets"] if b not in full]
        self.tables[table] = [g for g in self.tables[table] if g["buckets"]]
        self._write(table, rows.withColumn("_gone", F.lit(False)))

    def publish(self) -> None:
        self.store._publish({"number": self.base["number"] + 1, "buckets": self.store.buckets, "tables": self.tables})


def _last(rows: DataFrame, keys: list[str], turn: Column) -> DataFrame:
    """The row of the largest turn for each key, joined before rows move; of equal turns the one of the largest hash."""
    others = [c for c in rows.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    top = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(row, F.struct(turn, F.xxhash64(row))).alias("_row"))
    found = top.select(*[F.col(f"`{k}`") for k in keys], *[F.col("_row").getField(c).alias(c) for c in others])
    return found.select(*[F.col(f"`{c}`") for c in rows.columns])
