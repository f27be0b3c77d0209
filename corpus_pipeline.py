"""The corpus pipeline: language ID, exact dedup, near-duplicate join, decontamination, packing, in this order.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, which is written as Parquet and read
again in between. All but the last return the columns of documents. Extra columns pass through; null texts, empty tables
and repeated rows are defined by each stage. A stage's result is lazy over scratch tables of its own. ``run`` deletes them
once it has written the result. Where stages are called one by one, a stage deletes those of the one before it in the same
thread and for the same tables, unless its docs still read them, as in a chain without writes.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import chosen_path, decontam, langid, packing, radix_dedup
from pagewright.llm.common import Table, delete_path, recorded

#: By thread, and there by the folder of tables: scratch paths of stages that were called one by one.
_left = threading.local()


def _plain(path: str) -> str:
    """A path with one slash behind a scheme that names no host, as both ways of writing it occur."""
    return path.replace(":///", ":/")


def _stage(operator: Callable[..., DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(operator)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        paths = _left.__dict__.setdefault(sf_dir, [])
        read = docs.inputFiles() if paths else []
        for path in [p for p in paths if not any(f.startswith(f"{p}/") for f in map(_plain, read))]:
            delete_path(spark, path)
            paths.remove(path)
        with recorded() as made:
            result = operator(spark, docs, sf_dir)
        paths.extend(map(_plain, made))
        return result

    return run


@_stage
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose predicted language has at least half of the text's positions. Null, empty and letterless texts go, and
    those of no one language; where no lang was learned all others stay. Repeated rows stay as often as they stand."""
    return langid.keep_identified(docs)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest doc_id; null texts count as empty, null ids rank
    lowest, and of wholly repeated rows one stays."""
    return radix_dedup.drop_exact_duplicates(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked texts, the one with the smallest doc_id; texts without words all stay."""
    return chosen_path.drop_near_duplicates(docs)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the contamination rule leaves clean; null and wordless texts are clean, repeated rows fare alike."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document; null texts are empty, repeated rows are packed each for itself."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Language ID and the tokeniser are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            result = stage.__wrapped__(spark, docs, sf_dir)
        table = Table(result, name)
        for path in made + ([before.path] if before else []):
            delete_path(spark, path)
        docs, before = table.read(), table
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
