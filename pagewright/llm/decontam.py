"""Benchmark decontamination through a distributed positional inverted index.

The index is document-partitioned: a segment covers some whole documents and holds, for each term of the test
vocabulary, the sorted list of the places where it stands. Places run through the segment, with a gap between
documents, so that one number tells document and position. Segments are written to the shared folder and queried
where they lie; no postings are shuffled. A test phrase intersects the lists of its terms from the rarest on, each
shifted by the term's offset, so that what remains are the starts of exact matches; a proximity query intersects within
a span instead. Test phrases go out in blocks of a bounded size, one pass over the index each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .bytewords import TERM, fold_texts, folded_slices, words_of
from .common import Table, without

WINDOW = 13
#: Bytes of folded text in a segment, and windows that are held and broadcast at once.
SEGMENT_BYTES = 4 << 20
BLOCK_WINDOWS = 200_000
GAP = 64
#: Share of a document's words that must be hit: one in MIN_SHARE.
MIN_SHARE = 20

INDEX_SCHEMA = "rids array<long>, ids array<string>, n_words array<long>, base array<long>, terms binary, starts binary, places binary"
INDEX_ARROW = pa.schema([("rids", pa.list_(pa.int64())), ("ids", pa.list_(pa.string()))] + [(c, pa.list_(pa.int64())) for c in ("n_words", "base")] + [(c, pa.binary()) for c in ("terms", "starts", "places")])


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """Segments over rows of rid, doc_id, text (ids are held as text); ``vocabulary``: sorted term hashes to index, None for
    all."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def segment(rids: list[int], ids: list[str], texts: list[bytes]) -> dict:
        hashes, _, _, ptr, _ = words_of(texts, TERM)
        sizes = np.diff(ptr)
        base = np.concatenate([[0], np.cumsum(sizes + GAP)])[:-1]
        places = np.arange(len(hashes)) + np.repeat(base - ptr[:-1], sizes)
        if (known := held.value) is not None:
            at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            keep = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            hashes, places = hashes[keep], places[keep]
        order = np.argsort(hashes, kind="stable")
        hashes, width = hashes[order], 4 if base[-1] + sizes[-1] < 1 << 32 else 8
        terms, first = np.unique(hashes, return_index=True)
        packed = bytes([width]) + places[order].astype(f"<u{width}").tobytes()
        return {"rids": rids, "ids": ids, "n_words": sizes.tolist(), "base": base.tolist(), "terms": terms.tobytes(), "starts": np.append(first, len(hashes)).astype(np.int64).tobytes(), "places": packed}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, ids, texts, size = [], [], [], 0
        for batch in batches:
            for lo, hi, part in folded_slices(batch.column(2), SEGMENT_BYTES // 4):
                rids += batch.column(0).slice(lo, hi - lo).to_pylist()
                ids += batch.column(1).slice(lo, hi - lo).to_pylist()
                texts += part
                size += sum(map(len, part)) + GAP * len(part)
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist([segment(rids, ids, texts)], INDEX_ARROW)
                    rids, ids, texts, size = [], [], [], 0
        if rids:
            yield pa.RecordBatch.from_pylist([segment(rids, ids, texts)], INDEX_ARROW)

    return docs.select("rid", F.col("doc_id").cast("string"), "text").mapInArrow(run, INDEX_SCHEMA)


class Segment:
    """One segment of the index, for look-ups."""

    def __init__(self, row: dict):
        self.base = np.asarray(row["base"], np.int64)
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.places = np.frombuffer(row["places"], f"<u{row['places'][0]}", offset=1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of terms, -1 for those that are absent."""
        if not len(self.terms):
            return np.full(hashes.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.starts[term] : self.starts[term + 1]].astype(np.int64)

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of exact matches of consecutive terms, from the rarest list on."""
        counts = self.starts[terms + 1] - self.starts[terms]
        order = np.argsort(counts, kind="stable")
        found = self.postings(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            lst = self.postings(terms[k])
            want = found + k
            at = np.minimum(np.searchsorted(lst, want), len(lst) - 1)
            found = found[lst[at] == want]
        return found

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """Places of the rarest term that have every other term at most ``width`` words away in the same document."""
        counts = self.starts[terms + 1] - self.starts[terms]
        order = np.argsort(counts, kind="stable")
        found = self.postings(terms[order[0]])
        for k in order[1:]:
            if not len(found):
                break
            lst, own = self.postings(terms[k]), self.owner(found)
            lo = np.maximum(found - width, self.base[own])
            hi = np.minimum(found + width, self.base[own] + self.n_words[own] - 1)
            found = found[np.searchsorted(lst, lo, "left") < np.searchsorted(lst, hi, "right")]
        return found

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, "right") - 1


def item_windows(rows: list[Row]) -> list[tuple[str, np.ndarray]]:
    """(item_id as text, term hashes) of the distinct windows of benchmark items: every 13 consecutive words; an item
    of fewer, but not none, is one window."""
    found: dict[tuple, None] = {}
    for row in rows:
        h = words_of(fold_texts([row["text"]]), TERM)[0]
        if not len(h):
            continue
        width = min(WINDOW, len(h))
        for i in range(len(h) - width + 1):
            found[(str(row["item_id"]), h[i : i + width].tobytes())] = None
    return [(item, np.frombuffer(w, np.uint64)) for item, w in found]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Windows in blocks of a bounded number (an item is never split)."""
    rows: list[Row] = []
    size = 0
    for row in benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")).toLocalIterator():
        rows.append(row)
        size += len(row["text"] or "") // 2 + 1
        if size >= BLOCK_WINDOWS:
            yield item_windows(rows)
            rows, size = [], 0
    if rows:
        yield item_windows(rows)


HITS_SCHEMA = "rid long, doc_id string, n_words long, spans array<long>, items array<string>"


def match_segments(index: DataFrame, windows: list[tuple[str, np.ndarray]]) -> DataFrame:
    """One row per document of the index: rid, doc_id, n_words, hit spans (start, end, start, end ...; apart and sorted) and the
    item_ids with occurring windows."""
    spark = index.sparkSession
    widths = sorted({len(w) for _, w in windows})
    tables = [(n, np.stack([w for _, w in windows if len(w) == n]), [i for i, w in windows if len(w) == n]) for n in widths]
    held = spark.sparkContext.broadcast(tables)
    arrow = pa.schema([("rid", pa.int64()), ("doc_id", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                starts, lengths, who = [], [], []
                for width, table, items in held.value:
                    numbers = seg.find(table)
                    for w in np.flatnonzero((numbers >= 0).all(axis=1)):
                        found = seg.phrase(numbers[w])
                        if len(found):
                            starts.append(found)
                            lengths.append(np.full(len(found), width))
                            who.append(np.repeat(items[w], len(found)))
                spans: list[list[int]] = [[] for _ in seg.base]
                names: list[list[str]] = [[] for _ in seg.base]
                if starts:
                    at, width, item = np.concatenate(starts), np.concatenate(lengths), np.concatenate(who)
                    order = np.argsort(at, kind="stable")
                    at, ends, item = at[order], np.maximum.accumulate(at[order] + width[order]), item[order]
                    fresh = np.append(True, at[1:] > ends[:-1])
                    lo, hi = at[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(at) - 1)]
                    own = seg.owner(lo)
                    for d, a, b in zip(own.tolist(), (lo - seg.base[own]).tolist(), (hi - seg.base[own]).tolist(), strict=True):
                        spans[d] += [a, b]
                    own = seg.owner(at)
                    for d in np.unique(own).tolist():
                        names[d] = np.unique(item[own == d]).tolist()
                yield pa.RecordBatch.from_pydict({"rid": row["rids"], "doc_id": row["ids"], "n_words": row["n_words"], "spans": spans, "items": names}, arrow)

    return index.mapInArrow(run, HITS_SCHEMA)


def proximity_matches(index: DataFrame, phrases: list[tuple[str, str]], width: int = WINDOW) -> DataFrame:
    """(rid, doc_id, item, place): documents in which all terms of a phrase stand within ``width`` words of its rarest term."""
    tables = [(name, words_of(fold_texts([text]), TERM)[0]) for name, text in phrases]
    arrow = pa.schema([("rid", pa.int64()), ("doc_id", pa.string()), ("item", pa.string()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                for name, terms in tables:
                    numbers = seg.find(np.unique(terms))
                    if len(numbers) and (numbers >= 0).all():
                        found = seg.near(numbers, width)
                        own = seg.owner(found)
                        yield pa.RecordBatch.from_pydict({"rid": [row["rids"][d] for d in own.tolist()], "doc_id": [row["ids"][d] for d in own.tolist()], "item": [name] * len(found), "place": (found - seg.base[own]).tolist()}, arrow)

    return index.mapInArrow(run, "rid long, doc_id string, item string, place long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of all blocks become counts."""
    arrow = pa.schema([("rid", pa.int64()), ("doc_id", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            hit, reach = 0, 0
            for a, b in sorted(zip(row["spans"][::2], row["spans"][1::2], strict=True)):
                hit += max(0, b - max(a, reach))
                reach = max(reach, b)
            items = sorted(set(row["items"]))
            out.append({"rid": row["rid"], "doc_id": row["doc_id"], "n_words": row["n_words"], "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(), "contaminated": hit > 0 and MIN_SHARE * hit >= row["n_words"]})
        yield pa.RecordBatch.from_pylist(out, arrow)


DIGEST_SCHEMA = "rid long, doc_id string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs`` (rid, doc_id, text): rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and are clean; null and wordless benchmark texts have no windows. With no
    windows at all every row is clean. Repeated items and rows count as they stand. Where all windows fit one block,
    only their terms are indexed; else all terms are, and the blocks' spans meet by ``rid`` and ``doc_id``: rows that
    share both must have equal texts, and give one row then. Ids may be of any type and come back in it.
    """
    blocks = _blocks(benchmark)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        vocabulary = np.unique(np.concatenate([w for _, w in first])) if first else np.zeros(0, np.uint64)
        index = Table(build_index(docs, vocabulary), "postings")
        hits = match_segments(index.read(), first)
    else:
        index = Table(build_index(docs), "postings")
        parts = [Table(match_segments(index.read(), b), "hits").read() for b in chain([first, second], blocks)]
        together = parts[0]
        for p in parts[1:]:
            together = together.unionByName(p)
        hits = together.groupBy("rid", "doc_id").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    found = hits.mapInArrow(_digest, DIGEST_SCHEMA)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return contamination(rows, benchmark).drop("rid")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean rows of ``docs`` with all their columns, repeated ones as often as they stand. The verdict on a row
    depends on its text alone, so contaminated rows are named by doc_id and a hash of the text, and no row is stored."""
    key = [F.col("doc_id"), F.xxhash64("text")]
    found = contamination(docs.select(key[1].alias("rid"), "doc_id", "text"), benchmark)
    bad = Table(found.filter("contaminated").select("doc_id", "rid").distinct(), "contaminated").read()
    return without(docs, bad, ["doc_id", "rid"], key)


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
lens AS (SELECT DISTINCT n FROM bl),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dg.n AS n, item_id FROM dg JOIN win ON dg.gram = win.gram AND dg.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
