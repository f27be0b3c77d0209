"""Exact duplicate groups by distributed most-significant-byte radix partitioning.

Rows are split by their first bytes, then every part with more than one row by its next bytes, and so on until a part
is a single row or its texts have ended together. Bytes alone decide equality; no digest does. The digit widens from
round to round, so that a text of n bytes takes about log(n) rounds. A part is named by the bytes it was split by, so a
round needs no more than the count of each part: counts are combined on the map side and those of two rows or more are
stored. A bounded filter over them tells most rows that are alone where they lie, without an exchange; a row that the
filter lets through by chance goes on and ends alone. Texts move when their part is counted again, and once more when a
part of several rows has ended and its rows meet their group in an equi-join, whose hot parts adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MaybeIn, Table, fold_ascii

FIRST_DIGIT = 64
DIGIT_GROWTH = 64


def _leading(text: Column, width: int) -> Column:
    """The first ``width`` bytes of the folded text; as many characters hold them."""
    head = fold_ascii(F.substring(text, 1, width)).cast("binary")
    return F.substring(head, 1, width)


def radix_groups(df: DataFrame, text: str, order: str) -> DataFrame:
    """Groups of rows with equal texts after lower-casing A-Z.

    Returns ``row`` (the struct of all columns), ``keep_id`` (the largest ``order`` of the group), ``group_size`` and
    ``kept`` (true for exactly one row of each group).

    Null texts count as empty, and all empty texts form one group. Null orders rank lowest. Rows that repeat the
    largest order value are told apart by where they are stored, so one row stays even of wholly repeated rows. An
    empty table gives an empty result.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    body, rank = F.col("row").getField(text), F.col("row").getField(order)
    alone = lambda part: part.select("row", rank.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    width = FIRST_DIGIT
    counts = Table(rows.groupBy(_leading(body, width).alias("digit")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digit"), "counts")
    maybe, single = MaybeIn(counts.read(), "digit").split(rows, _leading(body, width))
    active = Table(maybe.select("row", F.monotonically_increasing_id().alias("rid")), "radix").read()
    result = alone(single)
    ended = lambda w: F.coalesce(F.octet_length(body), F.lit(0)) <= w
    while not active.isEmpty():
        width *= DIGIT_GROWTH
        parts = active.groupBy(_leading(body, width).alias("digit"), ended(width).alias("ended"))
        parts = parts.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(rank.alias("ord"), F.col("rid"))).alias("top")).filter("n > 1")
        parts = Table(parts, "counts").read()
        maybe, single = MaybeIn(parts, "digit", "ended").split(active, _leading(body, width), ended(width))
        over = maybe.filter(ended(width)).join(parts.filter("ended").hint("merge"), _leading(body, width) == F.col("digit"), "left")
        over = over.select("row", F.when(F.col("n").isNull(), rank).otherwise(F.col("top.ord")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("rid") == F.col("top.rid"), F.lit(True)).alias("kept"))
        result = result.unionByName(alone(single)).unionByName(over)
        active = Table(maybe.filter(~ended(width)), "radix").read()
    return result


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the folded text, UTF-8)."""
    groups = radix_groups(docs.select("doc_id", "text"), "text", "doc_id")
    digest = F.sha2(fold_ascii(F.col("row.text")).cast("binary"), 256)
    return groups.select("row.doc_id", "keep_id", "group_size", "kept", digest.alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest doc_id."""
    return radix_groups(docs, "text", "doc_id").filter("kept").select("row.*")


ORACLE = """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM folded
"""
