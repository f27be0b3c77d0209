"""Best-fit packing of tokenised documents into fixed-length sequences, planned over a histogram of lengths.

Documents are tokenised where they lie; from then on only lengths move. The driver sees one count per length (2,048 at
most) and runs best-fit decreasing over the counts: a bin group stands for all sequences that look alike. The plan maps
ranges of ranks within a length to sequences and offsets, and pieces take their places by a join on their rank.
"""

from __future__ import annotations

import bisect
import functools
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, inline_rows

SEQUENCE = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k"
#: Pieces that are ranked by one task about, and the plan's rows up to which it is broadcast.
RANK_ROWS = 200_000
BROADCAST_PLAN = 100_000
SLICE_ROWS = 256
LONG_RUN = 50_000
HAS_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of the byte-level BPE file; equal to the tokenizers library's, which takes over texts that spell a special
    token or hold a run of white space or of other characters of LONG_RUN, which the faster one may not survive. The
    ranks file of the same vocabulary is several times faster."""

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]

    @functools.cached_property
    def full(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text, then the end id; null is empty."""
        text = text or ""
        if any(s in text for s in self.special) or len(text) >= LONG_RUN and HAS_LONG_RUN.search(text):
            got = self.full.encode(text, add_special_tokens=False).ids
        else:
            got = self.fast.encode_ordinary(text)
        got.append(END_ID)
        return np.array(got, "<u4")


PIECES = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def tokenized_pieces(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id (of any type), piece, start, length, ids_crc32. Documents of up to 2,048 tokens
    stay whole; longer ones are cut from their end on, so that only the first piece may be shorter."""
    paths = (json_path or tokenizer_path(f"{TOKENIZER}.json"), ranks_path or tokenizer_path(f"{TOKENIZER}.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*paths)
        for batch in batches:
            arrow = pa.schema([batch.schema.field(0), *PIECES])
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                owners, rows = [], []
                for i in range(part.num_rows):
                    ids = encoder.ids(part.column(1)[i].as_py())
                    begin, piece = 0, 0
                    while begin < len(ids):
                        end = begin + ((len(ids) - begin - 1) % SEQUENCE + 1)
                        owners.append(i)
                        rows.append((piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())))
                        begin, piece = end, piece + 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners)), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), PIECES, strict=True))], schema=arrow)

    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return rows.mapInArrow(run, schema)


def best_fit_plan(counts: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, last rank + 1, first sequence, pieces a sequence, offset).

    The piece of rank x in a range lies in sequence ``first + (x - first rank) // pieces`` at ``offset + ((x - first
    rank) % pieces) * length``. Each piece goes to the fullest sequence that still holds it, as if taken one by one:
    a sequence just used is again the fullest, so it takes all that fit before the next is begun.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, sequences) alike in it
    free: list[int] = []
    plan, next_seq = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                r = free[at]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r], free[at]
            else:
                r, first, n = capacity, next_seq, -(-left // (capacity // length))
                next_seq += n
            each = r // length
            full = min(n, left // each)
            used = [(first, full, each)] if full else []
            if full < n and left - full * each:
                used.append((first + full, 1, left - full * each))
            for seq, bins, q in used:
                plan.append((length, rank, rank + bins * q, seq, q, capacity - r))
                rank, left = rank + bins * q, left - bins * q
            taken = sum(bins for _, bins, _ in used)
            rest = [(seq, bins, r - q * length) for seq, bins, q in used] + ([(first + taken, n - taken, r)] if taken < n else [])
            for seq, bins, gap in rest:
                if gap:
                    if gap not in room:
                        bisect.insort(free, gap)
                    room.setdefault(gap, []).append((seq, bins))
    return plan


def pack_documents(docs: DataFrame, **tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty: one piece that holds the end id alone. Documents of equal id or text are packed each for
    itself. An empty table gives no rows. Ranks within a length are counted by parts, so a length that a third of all
    pieces share is ranked by many tasks.
    """
    spark = docs.sparkSession
    pieces = Table(tokenized_pieces(docs, **tokenizer).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    rows = pieces.read()
    counts = {x["length"]: x["n"] for x in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts)
    parts = max(1, math.ceil(max(counts.values(), default=1) / RANK_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    turn = F.row_number().over(Window.partitionBy("length", "part").orderBy("rid"))
    ranked = rows.withColumn("turn", turn).join(starts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("turn") - 1)
    table = inline_rows(spark, [list(x) for x in plan], "length:bigint, lo:bigint, hi:bigint, seq:bigint, each:bigint, at:bigint")
    table = F.broadcast(table) if len(plan) <= BROADCAST_PLAN else table
    placed = ranked.join(table.withColumnRenamed("length", "size"), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq") + F.expr("(rank - lo) div each")).alias("sequence_id"),
        (F.col("at") + (F.col("rank") - F.col("lo")) % F.col("each") * F.col("length")).alias("offset"),
    )
