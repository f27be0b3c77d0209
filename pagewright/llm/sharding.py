"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Each row gets a stored id, and by it a source block. How many rows of a block go to each shard is drawn from the
multivariate hypergeometric law, exactly as a uniform shuffle of all rows would fall: row sums are the block sizes,
column sums the shard sizes. Every block is permuted and dealt out by its counts, rows are exchanged, and every shard
is permuted again. Only the counts (blocks x shards) reach the driver; ids, sizes and checksums are all that is
exchanged. The main path is DataFrame operations only.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, inline_rows

#: Rows that one block or one part of a shard holds about; MAX_BLOCKS bounds what the driver holds.
BLOCK_ROWS = 200_000
MAX_BLOCKS = 4096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement from ``good`` + ``bad`` items are good. Exact for any sizes:
    an urn for few draws, else ratio-of-uniforms rejection from the mode (Stadlober 1990)."""
    total = good + bad
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if draws == total:
        return good
    if draws > total - draws:
        return good - hypergeometric(rng, good, bad, total - draws)
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    if draws <= 32:
        hit, left = 0, good
        for i in range(draws):
            if rng.randrange(total - i) < left:
                hit, left = hit + 1, left - 1
        return hit
    share = good / total
    centre = draws * share + 0.5
    spread = math.sqrt((total - draws) * draws * share * (1 - share) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (draws + 1) * (good + 1) // (total + 2)

    def weight(k: int) -> float:
        return math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1) + math.lgamma(bad - draws + k + 1)

    top = weight(mode)
    most = min(draws, good)
    while True:
        u = 1.0 - rng.random()
        x = centre + width * (rng.random() - 0.5) / u
        if not 0 <= x < most + 1:
            continue
        k = int(x)
        if 2 * math.log(u) <= top - weight(k):
            return k


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Counts of rows that each block sends to each shard, drawn as a uniform shuffle would give them."""
    rng = random.Random(seed)
    free = list(shard_sizes)
    matrix = []
    for size in block_sizes:
        rest, left, row = sum(free), size, []
        for s, room in enumerate(free):
            rest -= room
            got = hypergeometric(rng, room, rest, left) if s + 1 < len(free) else left
            row.append(got)
            left -= got
        free = [a - b for a, b in zip(free, row, strict=True)]
        matrix.append(row)
    return matrix


def assign_shards(rows: DataFrame, rid: str, shards: int, seed: int) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard) to rows that hold a stored unique long ``rid``.

    Shard sizes differ by one at most. Equal contents, null contents and repeated rows need no care, as only ``rid``
    decides; no rows give no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = rows.sparkSession
    r = F.col(rid)
    total = rows.count()
    blocks = max(1, min(MAX_BLOCKS, max(8, math.ceil(total / BLOCK_ROWS))))
    parts = max(1, min(MAX_BLOCKS, math.ceil(total / shards / BLOCK_ROWS)))
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), r), F.lit(blocks)).cast("int")
    sizes = {x["block"]: x["n"] for x in rows.select(block.alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(sizes)
    target = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([sizes[b] for b in order], target, seed)
    ends = [[b, [sum(row[: s + 1]) for s in range(shards - 1)]] for b, row in zip(order, matrix, strict=True)]
    deal = inline_rows(spark, ends, "block:int, ends:array<bigint>")
    within = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("deal"), r), r)
    dealt = rows.withColumn("block", block).withColumn("turn", F.row_number().over(within)).join(F.broadcast(deal), "block")
    dealt = dealt.withColumn("shard", F.expr("size(filter(ends, e -> e < turn))")).drop("ends", "turn", "block")
    part = F.pmod(F.xxhash64(F.lit(seed), F.lit("part"), r), F.lit(parts)).cast("int")
    table = Table(dealt.withColumn("part", part), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.read().groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    again = Window.partitionBy("shard", "part").orderBy(F.xxhash64(F.lit(seed), F.lit("slot"), r), r)
    placed = table.read().withColumn("turn", F.row_number().over(again)).join(F.broadcast(starts), ["shard", "part"])
    return placed.withColumn("slot", F.col("start") + F.col("turn") - 1).drop("start", "turn", "part")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law).

    Null texts count as empty. The ids that the shuffle draws on are written to the shared folder first, so a task
    that runs again deals the same rows to the same slots.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = Table(docs.select("doc_id", (F.length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("rid")), "rows")
    placed = assign_shards(narrow.read(), "rid", shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _free(name: str, columns: list[str]) -> str:
    """The name, with underscores before it where the table has a column of that name."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42) -> None:
    """Writes whole rows as Parquet under ``path``/shard=N with their slot, in slot order within each file. Where the table
    has a column shard or slot, the own one is called _shard or _slot. An empty table writes no rows."""
    shard, slot = _free("shard", docs.columns), _free("slot", docs.columns)
    stored = Table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")
    placed = assign_shards(stored.read().select("rid"), "rid", shards, seed)
    whole = stored.read().join(placed, "rid").repartition("shard", F.expr(f"slot div {BLOCK_ROWS}")).sortWithinPartitions("shard", "slot")
    whole.select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot)).write.partitionBy(shard).parquet(path)
    stored.drop()
