"""A stored index of vectors in cells.

Centroids come from k-means on a bounded sample. Vectors are stored as Parquet, a folder for each cell, in files of bounded
size. A query looks into the folders of its nearest centroids alone and scores what lies there exactly; with all cells as
probes the answer is the exact one. How many cells a query needs depends on the data: the index is built with the number
that finds a target share of the true neighbours of sampled rows among the sample, whose rows lie farther apart than all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.search import QUERY_BLOCK, best_of_queries

#: Rows of the sample (the smallest hashes of the key), cells at most, rounds of k-means, and rows of one file.
SAMPLE, MAX_CELLS, ROUNDS, FILE_ROWS = 20_000, 1024, 12, 1_000_000
#: Neighbours and sampled queries by which the default number of probes is chosen, and the share of them it must find.
NEIGHBOURS, QUERIES, RECALL = 10, 256, 0.94


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample; a cell that empties keeps its place."""
    sample = _unit(sample)
    cells = min(cells, len(sample))
    made = sample[np.arange(cells) * len(sample) // max(1, cells)]
    for _ in range(ROUNDS):
        nearest = (sample @ made.T).argmax(axis=1)
        total = np.zeros_like(made)
        np.add.at(total, nearest, sample)
        filled = np.bincount(nearest, minlength=cells) > 0
        made = np.where(filled[:, None], _unit(total), made)
    return made


def probes_for(sample: np.ndarray, made: np.ndarray) -> int:
    """The least number of nearest cells that hold the share RECALL of the nearest rows of sampled queries."""
    sample = _unit(sample)
    asked = sample[np.arange(min(QUERIES, len(sample))) * len(sample) // min(QUERIES, len(sample))]
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    turn = np.argsort(np.argsort(-(asked @ made.T), axis=1, kind="stable"), axis=1)  # a cell's place among a query's
    needed = np.sort(np.take_along_axis(turn, (sample @ made.T).argmax(axis=1)[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1


def build(vectors: DataFrame, key: str, path: str, cells: int | None = None) -> None:
    """Stores vectors (key, vector, all of one length) at ``path``. ``cells``: about the root of the number of rows by
    default, MAX_CELLS at most. Rows without key or vector are left out."""
    spark = vectors.sparkSession
    rows = vectors.select(key, F.col("vector").cast("array<float>").alias("vector")).filter(F.col(key).isNotNull() & F.col("vector").isNotNull())
    cells = cells or max(1, min(MAX_CELLS, math.isqrt(rows.count())))
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64(key), key).select("vector").limit(SAMPLE).collect()], np.float64)
    made = centroids(sample, cells) if len(sample) else np.zeros((0, 0))
    probes = probes_for(sample, made) if len(sample) else 0
    kept = [(i, c, probes) for i, c in enumerate(made.tolist())]
    spark.createDataFrame(kept, "cell int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    held = spark.sparkContext.broadcast(made)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((_unit(v) @ held.value.T).argmax(axis=1).astype(np.int32))], names=[*part.schema.names, "cell"])

    kind = rows.schema[key].dataType.simpleString()
    placed = rows.mapInArrow(place, f"`{key}` {kind}, vector array<float>, cell int")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("files"))  # one row a cell
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("file", F.pmod(F.xxhash64(key), F.col("files")))
    dealt.repartition("cell", "file").drop("file", "files").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, key: str, queries: DataFrame, limit: int, probes: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, score, rank) for queries (query_id, query_vector), by cosine rounded to six decimals, then key, among
    the vectors of each query's ``probes`` nearest cells, by default the number that ``build`` chose; the plan lists the folders of these cells alone."""
    stored = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    made = np.array([r["centroid"] for r in stored])
    count = min(len(made), probes or max([r["probes"] for r in stored], default=0))
    vectors = spark.read.parquet(f"{path}/vectors") if stored else None

    def found(asked: np.ndarray, score) -> DataFrame:
        near = np.argsort(-(_unit(asked) @ made.T), axis=1, kind="stable")[:, :count] if stored else np.zeros((len(asked), 0), int)
        best, fields = score(near)
        if vectors is None:
            return spark.createDataFrame([], fields)
        cells = [int(c) for c in np.unique(near)]
        return vectors.filter(F.col("cell").isin(cells)).select(key, "vector", "cell").mapInArrow(best, fields)

    kind = vectors.schema[key].dataType if vectors is not None else queries.schema["query_id"].dataType
    return best_of_queries(queries, key, kind, limit, found, block)
