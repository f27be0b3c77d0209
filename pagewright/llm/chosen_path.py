"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed word 5-grams; equal sets are one class from the start. A class is embedded as a vector of
minwise values, whose coordinates are the tokens that paths are chosen from: two sets of similarity s share each with
probability s. Every run starts at a root, and each node of the recursion splits its sets on coordinates drawn from its
path; sets that share the value go down together. Buckets of bounded size are compared by brute force on bit sketches;
larger ones split again. A bucket that similar sets keep large cannot be split by chance, so a node is first compared
with a pivot: all within an outer distance of it are joined to it, and only sets beyond an inner distance go on, and
these only where the node holds a set beyond the outer distance, for all others are in the pivot's group by then. The two
distances differ by a link's span and the noise of the sketches, so that one pivot loses a link of the least similarity
with a chance of 3.4e-5 at most.

A node below a root has as many children as keep a link's two sets together with even odds, one and for one path in
four a second, so that texts that share a part do not multiply; a root has FIRST. A bucket still large after DEPTH splits
is compared block by block on its sketches, so no branch ends without a comparison. Runs repeat until a link of the least
similarity is met with the target recall: 10 runs miss 3e-5 where every node splits to the last depth.

What is found joins sets to candidate groups. Each group is then compared exactly on its full sets, in blocks of bounded
size, so that links, their counts and classes rest on true Jaccard similarities. Pairs are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import TERM, fold_texts, folded_slices, mix, words_of
from .common import MaybeIn, Table, without
from .components import connected_components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Minwise values of a set: the first COORDS are what paths choose from, the low bits of all are the sketch.
MINWISE = 256
COORDS = 64
#: Children of a root, one path in how many below has a second child, splits of a branch at most, sets of a small bucket.
FIRST, SECOND, DEPTH = 4, 4, 4
BUCKET = 1000
#: Sketch similarity from which a pair is a candidate, and the pivot's inner and outer similarity.
CANDIDATE = 0.62
INNER, OUTER = 0.78, 0.42
#: Heavy nodes (some 50 bytes each) up to which their pivots are broadcast; more are joined by merging.
BROADCAST_NODES = 1 << 17
#: Sets, and grams of sets, that one block of the exact comparison holds about.
BLOCK = 512
BLOCK_GRAMS = 1 << 20
COLUMNS = 4096
GROUP_BYTES = 1 << 19


def _binomial(n: int, p: float) -> np.ndarray:
    return np.array([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])


def parted(share: np.ndarray) -> np.ndarray:
    """How likely the splits of a large root part a pair that agrees in a share of the coordinates, down to DEPTH."""
    lost = np.zeros_like(share)
    for _ in range(DEPTH - 1):
        one = 1 - share + share * lost
        lost = one * (1 - 1 / SECOND) + one**2 / SECOND
    return (1 - share + share * lost) ** FIRST


def runs_miss(runs: int, similarity: float) -> float:
    """How likely a pair of the similarity meets in no run, where every node is large and splits to the last: the pair
    agrees in a binomial number of its COORDS values; a run succeeds where its root's value is among them and the splits
    below, which draw from the same values, do not part the pair."""
    apart = parted(np.arange(COORDS + 1) / COORDS)
    roots, others = _binomial(runs, similarity), _binomial(COORDS - runs, similarity)
    at = np.arange(runs + 1)[:, None]
    return float((roots[:, None] * others[None, :] * apart[at + np.arange(COORDS - runs + 1)[None, :]] ** at).sum())


def sketch_miss(similarity: float) -> float:
    """How likely sketches lose a pair of the similarity: in a bucket, or at one pivot that lies in line with both, where
    every bit in which the two differ counts against the farther one."""
    differ = _binomial(MINWISE, (1 - similarity) / 2)
    apart = 2 * np.arange(MINWISE + 1) / MINWISE
    return float(differ[1 - apart < CANDIDATE].sum() + differ[apart > INNER - OUTER].sum())


def runs_for(recall: float, similarity: float) -> int:
    """Runs, one for each coordinate at most, after which a pair of the similarity is met with the given probability in
    spite of splits below the roots. The sketches' misses come off what the runs may miss, down to half of it."""
    may = max(1 - recall - sketch_miss(similarity), (1 - recall) / 2)
    return next((r for r in range(1, COORDS) if runs_miss(r, similarity) <= may), COORDS)


def shingles(texts: list[bytes], kind: np.ndarray = TERM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 5-gram hashes of each text, one after another, and their pointers. Texts of fewer words, but not
    none, have all their words as one gram; wordless texts have no grams."""
    h, _, _, ptr, _ = words_of(texts, kind)
    sizes = np.diff(ptr)
    n = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    starts = np.repeat(ptr[:-1], n) + (np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n))
    width = np.repeat(np.minimum(sizes, WORDS), n)
    gram = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        gram = np.where(width > k, mix(gram * np.uint64(3) + padded[starts + k] + np.uint64(k + 1)), gram)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    keep = np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])) if len(gram) else np.zeros(0, bool)
    return gram[keep], np.searchsorted(owner[keep], np.arange(len(texts) + 1))


def minwise(grams: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A row of MINWISE values for each non-empty set, in order."""
    filled = np.flatnonzero(np.diff(ptr))
    out = np.empty((len(filled), MINWISE), np.uint32)
    if not len(filled):
        return out
    seeds = np.random.default_rng(11).integers(1, 1 << 63, MINWISE, dtype=np.uint64)
    low = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    first = ptr[:-1][filled]
    for i in range(MINWISE):
        v = low * np.uint32(int(seeds[i]) >> 32 | 1)
        v += np.uint32(int(seeds[i]) & 0xFFFFFFFF)
        out[:, i] = np.minimum.reduceat(v, first)
    return out


def sketch_bits(values: np.ndarray) -> np.ndarray:
    """One bit of each minwise value, mixed, in 64-bit words: sets of similarity s agree in (1 + s) / 2 of the bits."""
    v = values * np.uint32(0x9E3779B1)
    v ^= v >> np.uint32(16)
    return np.packbits((v & np.uint32(1)).astype(np.uint8), axis=1).view(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of broadcast rows of sketches."""
    return 1 - 2 * np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) / MINWISE


@dataclass(frozen=True)
class Scheme:
    """How texts become sets and where sets meet: the bytes of words, the least similarity of a link, sketches of minwise
    values and the similarity that two of them tell, from which on a bucket's pair is a candidate, the pivot's inner and
    outer similarity, and the roots of a set's minwise values."""

    kind: np.ndarray
    threshold: float
    sketch: Callable[[np.ndarray], np.ndarray]
    estimate: Callable[[np.ndarray, np.ndarray], np.ndarray]
    candidate: float
    inner: float
    outer: float
    roots: Callable[[np.ndarray], np.ndarray]


def chosen_paths(threshold: float, recall: float) -> Scheme:
    runs = runs_for(recall, threshold)

    def roots(values: np.ndarray) -> np.ndarray:
        start = np.random.default_rng(5).permutation(COORDS)[:runs]
        return mix(mix(values[:, start].astype(np.uint64) + np.uint64(0xD6E8FEB8)) + np.arange(1, runs + 1, dtype=np.uint64))

    return Scheme(TERM, threshold, sketch_bits, similarity, CANDIDATE, INNER, OUTER, roots)


SETS = "sig binary, n int, coords binary, sketch binary, roots binary"
SETS_ARROW = [("sig", pa.binary()), ("n", pa.int32()), ("coords", pa.binary()), ("sketch", pa.binary()), ("roots", pa.binary())]


def _embed(scheme: Scheme):
    """Rows that end in a text -> their other columns, signature of the set, its size, path coordinates, sketch and roots;
    all empty for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carry, schema = batch.columns[:-1], pa.schema([*list(batch.schema)[:-1], *SETS_ARROW])
            for lo, hi, texts in folded_slices(batch.columns[-1], GROUP_BYTES):
                grams, ptr = shingles(texts, scheme.kind)
                values = minwise(grams, ptr)
                n = np.diff(ptr)
                filled = np.flatnonzero(n)
                made = [np.ascontiguousarray(values[:, :COORDS]), scheme.sketch(values), np.ascontiguousarray(scheme.roots(values))]
                sums = [np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)]
                if len(filled):  # sums of two independent scramblings tell sets apart
                    for s, salt in zip(sums, (0x5851F42D4C957F2D, 0x14057B7EF767814F), strict=True):
                        s[filled] = np.add.reduceat(mix(grams ^ np.uint64(salt)), ptr[:-1][filled])
                row = {int(d): i for i, d in enumerate(filled)}
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(lo, hi - lo) for c in carry),
                    pa.array([sums[0][d].tobytes() + sums[1][d].tobytes() if d in row else None for d in range(hi - lo)], pa.binary()),
                    pa.array(n.astype(np.int32)),
                    *(pa.array([m[row[d]].tobytes() if d in row else None for d in range(hi - lo)], pa.binary()) for m in made),
                ], schema=schema)

    return run


NODES = "path long, id long, coords binary, sketch binary"
NODES_ARROW = pa.schema([("path", pa.int64()), ("id", pa.int64()), ("coords", pa.binary()), ("sketch", pa.binary())])
EDGES_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _step(path: np.ndarray, coords: np.ndarray, child: int) -> np.ndarray:
    """The child paths of rows: each node draws a coordinate from its path, and the row's value there goes with it."""
    draw = mix(path.view(np.uint64) * np.uint64(2) + np.uint64(2 * child + 1))
    pick = (draw >> np.uint64(8)) % np.uint64(COORDS)
    value = coords[np.arange(len(coords)), pick.astype(np.int64)].astype(np.uint64)
    return mix(draw ^ mix(value + np.uint64(0xD6E8FEB8))).view(np.int64)


def _rows(batch: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    """A column of equal-length binaries as a matrix."""
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), dtype).reshape(batch.num_rows, -1)


def _seconds(path: np.ndarray) -> np.ndarray:
    """Which paths have a second child."""
    return mix(path.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(SECOND) == 0


def _roots(payload: list[str]):
    """Rows of id, the payload columns, roots -> a row for each root with the payload columns."""
    schema = pa.schema([NODES_ARROW.field(c) for c in ("path", "id", *payload)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for path in _rows(batch, "roots", np.int64).T:
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(path)), *(batch.column(batch.schema.get_field_index(c)) for c in ("id", *payload))], schema=schema)

    return run


TIED = "path long, a long, b long, coords binary, sketch binary"
TIED_ARROW = pa.schema([("path", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("coords", pa.binary()), ("sketch", pa.binary())])


def _tie(scheme: Scheme):
    """Rows of large nodes with their pivot -> edges to the pivot (b null where a row is too far from it), each with its
    node, and with coordinates and sketch where the row is not near the pivot and may go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path, ids, pivots = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("path", "id", "pivot_id"))
            near = scheme.estimate(_rows(batch, "sketch", np.uint64), _rows(batch, "pivot_sketch", np.uint64))
            said = np.flatnonzero((near < scheme.inner) | (ids != pivots))
            far = pa.array(near[said] < scheme.inner)
            own = (pc.if_else(far, batch.column(batch.schema.get_field_index(c)).take(pa.array(said)), pa.scalar(None, pa.binary())) for c in ("coords", "sketch"))
            yield pa.RecordBatch.from_arrays([pa.array(path[said]), pa.array(ids[said]), pa.array(pivots[said], mask=near[said] < scheme.outer), *own], schema=TIED_ARROW)

    return run


def _split(at_root: bool):
    """Rows of large nodes that are not near their pivot -> the same at the child nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest in batches:
            path = rest.column(rest.schema.get_field_index("path")).to_numpy()
            for child in range(FIRST if at_root else 2):
                part = rest if at_root or not child else rest.filter(pa.array(_seconds(path)))
                if part.num_rows:
                    get = lambda c, b=part: b.column(b.schema.get_field_index(c))
                    step = _step(get("path").to_numpy(), _rows(part, "coords", np.uint32), child)
                    yield pa.RecordBatch.from_arrays([pa.array(step), get("id"), get("coords"), get("sketch")], schema=NODES_ARROW)

    return run


def _brute(scheme: Scheme):
    """Rows in order of path -> (a, b) edges that span the candidate groups of each bucket."""

    def edges(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        path = batch.column(0).to_numpy()
        first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        size = np.diff(np.append(first, len(path)))
        if not (size > 1).any():
            return None
        ids, sk = batch.column(1).to_numpy(), _rows(batch, "sketch", np.uint64)
        out = []
        two = first[size == 2]
        ok = scheme.estimate(sk[two], sk[two + 1]) >= scheme.candidate
        out.append((ids[two[ok]], ids[two[ok] + 1]))
        for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own, rest = sk[f : f + n], np.arange(n)
            seen = np.zeros(n, bool)
            while len(rest):  # grow one group after the other; a row is compared with those not yet reached
                seed, rest = rest[:1], rest[1:]
                seen[seed] = True
                front = seed
                while len(front) and len(rest):
                    hit = np.zeros(len(rest), bool)
                    source = np.zeros(len(rest), np.int64)
                    for x in front.tolist():
                        new = ~hit & (scheme.estimate(own[rest], own[x]) >= scheme.candidate)
                        hit |= new
                        source[new] = x
                    out.append((ids[f + rest[hit]], ids[f + source[hit]]))
                    front, rest = rest[hit], rest[~hit]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]))], schema=EDGES_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            path = whole.column(0).to_numpy()
            cut = int(np.searchsorted(path, path[-1]))  # the last bucket may go on
            if cut:
                if (got := edges(whole.slice(0, cut))) is not None:
                    yield got
                held = [whole.slice(cut)]
            else:
                held = [whole]
        if held and (got := edges(held[0])) is not None:
            yield got

    return run


def candidate_edges(sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Edges (a, b) that span groups of likely similar sets, from rows of id, coords, sketch, roots."""
    kinds = {"path": "path long", "id": "id long", "coords": "coords binary", "sketch": "sketch binary"}
    at_root = lambda *c: sets.select("id", *c, "roots").mapInArrow(_roots(list(c)), ", ".join(kinds[x] for x in ("path", "id", *c)))
    bare, light_rows, full = at_root(), at_root("sketch"), at_root("coords", "sketch")
    compared = lambda rows: rows.select("path", "id", "sketch").repartition("path").sortWithinPartitions("path", "id").mapInArrow(_brute(scheme), "a long, b long")
    found = []
    for depth in range(DEPTH + 1):
        sizes = bare.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot_id")).filter("size > 1")
        sizes = Table(sizes, "nodes").read()
        heavy = Table(sizes.filter(F.col("size") > BUCKET), "heavy").read()
        few = heavy.count()
        # few heavy nodes go to the rows, so that rows of light nodes are not exchanged with their coordinates
        beside = F.broadcast if few <= BROADCAST_NODES else lambda df: df.hint("merge")
        if not depth:  # most sets meet no other at most roots
            light_rows = MaybeIn(sizes, "path").split(light_rows, F.col("path"))[0]
        found.append(compared(light_rows.join(beside(heavy.select("path")), "path", "left_anti")))
        if not few:
            break
        if depth == DEPTH:
            blocks = heavy.select("path", F.ceil(F.col("size") / BUCKET).cast("int").alias("blocks"))
            rows = light_rows.join(beside(blocks), "path").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            rows = rows.select("path", "id", "sketch", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            found.append(compared(rows.withColumn("path", F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")))))
            break
        pivots = sets.select(F.col("id").alias("pivot_id"), F.col("sketch").alias("pivot_sketch")).join(beside(heavy.select("path", "pivot_id")), "pivot_id")
        pivots = Table(pivots, "pivots").read()
        # one join a level: each row of a large node meets its one pivot, and only rows far from it are kept with coordinates
        tied = full.join(beside(pivots), "path").select("path", "id", "coords", "sketch", "pivot_id", "pivot_sketch")
        tied = Table(tied.mapInArrow(_tie(scheme), TIED), "tied").read()
        found.append(tied.filter("b is not null").select("a", "b"))
        # where all of a node are tied to its pivot, no partner of theirs is left to meet in it
        going = Table(tied.filter("b is null").select("path").distinct(), "going").read()
        split = tied.filter("coords is not null").join(beside(going), "path", "left_semi").select("path", F.col("a").alias("id"), "coords", "sketch")
        full = Table(split.mapInArrow(_split(not depth), NODES), "split").read()
        bare, light_rows = full.select("path", "id"), full.select("path", "id", "sketch")
    edges = found[0]
    for e in found[1:]:
        edges = edges.unionByName(e)
    return edges


def _exact(threshold: float, kind: np.ndarray = TERM):
    """Rows of root, low, high, block, id, text in order of (root, low, high) -> links of each row and spanning edges."""
    arrow = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def compare(ids: np.ndarray, block: np.ndarray, texts: list[str], across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, ptr = shingles(fold_texts(texts), kind)
        n, m = np.diff(ptr), len(ids)
        owner = np.repeat(np.arange(m), n)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        fresh = np.append(True, grams[1:] != grams[:-1])
        number = np.cumsum(fresh) - 1
        shared = np.bincount(number)[number] > 1
        owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
        common = np.zeros((m, m))  # in double precision, so that a similarity of just the threshold is a link
        for c in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
            lo, hi = np.searchsorted(number, [c, c + COLUMNS])
            dense = np.zeros((m, min(COLUMNS, int(number[-1]) + 1 - c)), np.float32)
            dense[owner[lo:hi], number[lo:hi] - c] = 1
            common += dense @ dense.T
        linked = (1 + threshold) * common >= threshold * (n[:, None] + n[None, :]) - 1e-6
        np.fill_diagonal(linked, False)
        if across:  # one of the two blocks may be empty
            linked &= block[:, None] != block[None, :]
        left, edges = np.ones(m, bool), []
        for seed in range(m):
            if not left[seed]:
                continue
            left[seed], front = False, [seed]
            while front:
                x = front.pop()
                new = np.flatnonzero(linked[x] & left)
                left[new] = False
                edges += [(x, y) for y in new.tolist()]
                front += new.tolist()
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return linked.sum(axis=1), ids[pairs[:, 0]], ids[pairs[:, 1]]

    def out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
            part = batch.slice(lo, hi - lo)
            ids = part.column(4).to_numpy()
            links, a, b = compare(ids, part.column(3).to_numpy(), part.column(5).to_pylist(), bool(key[1, lo] != key[2, lo]))
            none = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, ids[:0]])), pa.array(links.astype(np.int64)), none(len(ids)), none(len(ids))], schema=arrow)
            yield pa.RecordBatch.from_arrays([none(len(a)), none(len(a)), pa.array(a), pa.array(b)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 2 * BLOCK):
                held.append(batch.slice(at, 2 * BLOCK))
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                last = [whole.column(i)[whole.num_rows - 1].as_py() for i in range(3)]
                key = np.stack([whole.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
                cut = int(np.flatnonzero((key == np.array(last)[:, None]).all(axis=0))[0])
                if cut:
                    yield from out(whole.slice(0, cut))
                held = [whole.slice(cut)]
        if held and held[0].num_rows:
            yield from out(held[0])

    return run


def _blocks(rows, grams):
    """How many blocks the exact comparison makes of so many rows with so many grams."""
    return F.ceil(F.greatest(rows / BLOCK, grams / BLOCK_GRAMS)).cast("int")


def _compared(docs: DataFrame, placed: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (id, links) and spanning edges (a, b) among rows of node, root, block, first, last, step, doc_id, h. A row
    meets its own block and those from first to last by step; its text is found again by doc_id and hash."""
    key = [F.col("doc_id"), F.xxhash64("text")]
    maybe, _ = MaybeIn(placed, "doc_id", "h").split(docs.select("doc_id", "text"), *key)
    placed = placed.withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_h"))
    texts = maybe.join(placed.hint("merge"), same).groupBy("node", "root", "block", "first", "last", "step").agg(F.any_value("text").alias("text"))  # repeated rows have one text
    texts = texts.select("root", "block", "text", F.col("node").alias("id"), F.explode(F.sequence("first", "last", "step")).alias("other"))
    texts = texts.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "text")
    compared = texts.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(_exact(scheme.threshold, scheme.kind), "id long, links long, a long, b long")
    return Table(compared, "links").read()


def _edges_of_rest(docs: DataFrame, members: DataFrame, edges: DataFrame, scheme: Scheme) -> DataFrame:
    """What is left of the edges that span each group, once its blocks have been compared in themselves and with one of
    them: only pairs within the group's largest part need no look. The rest, often no row at all, meets the whole group."""
    members = members.filter("blocks > 1")
    if members.isEmpty():
        return edges
    parts = connected_components(edges.join(members.select(F.col("node").alias("a")), "a", "left_semi")).withColumnRenamed("root", "part")
    members = Table(members.select("node", "root", "n", "doc_id", "h").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts").read()
    counts = members.groupBy("root", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams"))
    counts = counts.groupBy("root").agg(F.max_by(F.struct("part", "rows", "grams"), F.struct("rows", "part")).alias("main"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"))
    left = F.col("rows") - F.col("main.rows"), F.col("grams") - F.col("main.grams")
    counts = counts.filter(left[0] > 0).select("root", F.col("main.part").alias("main"), _blocks(*left).alias("rest"), _blocks(F.col("main.rows"), F.col("main.grams")).alias("others"))
    counts = Table(counts, "rest").read()
    if counts.isEmpty():
        return edges
    is_rest, node = F.col("part") != F.col("main"), F.xxhash64("node")
    block = F.when(is_rest, F.pmod(node, F.col("rest"))).otherwise(F.col("rest") + F.pmod(node, F.col("others"))).cast("int")
    last = F.when(is_rest, F.col("rest") + F.col("others") - 1).otherwise(F.col("rest") - 1)
    placed = members.join(counts, "root").select("node", "root", block.alias("block"), F.lit(0).alias("first"), last.alias("last"), F.lit(1).alias("step"), "doc_id", "h")
    return edges.unionByName(_compared(docs, placed, scheme).filter("id is null").select("a", "b"))


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, count_links: bool = True, scheme: Scheme | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id of any type, text): rid, doc_id, h, n, class_id, n_links, n_copies, keep_rid.

    ``rid``: a number given to the row here; ``h``: a hash of its text; ``n``: the size of its set. ``scheme``: other words,
    sketches and roots than those of chosen paths, with its own threshold and recall. ``class_id``: the smallest doc_id of the connected
    component of links, equal sets included. ``n_links``: how many other distinct sets have a Jaccard similarity of at
    least ``threshold`` with the row's. ``n_copies``: rows whose set is equal, itself included. ``keep_rid``: the row of
    the component that stays, the one with the smallest doc_id. Texts without words have no set: each is a class of its
    own, without links. Texts of fewer than five words are one gram. Null ids rank lowest; a component of null ids alone
    has a null class_id.

    Texts are read twice, for their sets and for the exact comparison; the second time only those of candidate groups
    move, found again by doc_id and ``h``. Links are counted by comparing every pair of a group's blocks. Without
    ``count_links`` n_links is null, and blocks are compared only as far as classes depend on it: in themselves, with one
    of them, and with the rows outside the largest part that this gives; classes are the same.
    """
    scheme = scheme or chosen_paths(threshold, recall)
    narrow = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("h"), "text")
    schema = narrow.drop("text").schema.simpleString()[len("struct<") : -1]
    sets = Table(narrow.mapInArrow(_embed(scheme), f"{schema}, {SETS}"), "sets").read()
    filled = sets.filter("n > 0")
    classes = Table(filled.groupBy("sig").agg(F.min("rid").alias("id"), F.count(F.lit(1)).alias("n_copies")), "classes").read()
    leaders = filled.join(classes.select(F.col("id").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "id")
    leaders = Table(leaders.select("id", "doc_id", "h", "n", "coords", "sketch", "roots"), "leaders").read()
    groups = Table(connected_components(candidate_edges(leaders, scheme)), "groups").read()
    named = Table(groups.join(leaders.select(F.col("id").alias("node"), "doc_id", "h", "n"), "node"), "members").read()
    sizes = Table(named.groupBy("root").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")), "sizes").read()
    named = named.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    last, step = (F.col("blocks") - 1, F.lit(1)) if count_links else (F.col("block"), F.greatest("block", F.lit(1)))
    placed = named.select("node", "root", "block", F.lit(0).alias("first"), last.alias("last"), step.alias("step"), "doc_id", "h")
    compared = _compared(docs, placed, scheme)
    edges = compared.filter("id is null").select("a", "b")
    if not count_links:
        edges = _edges_of_rest(docs, named, edges, scheme)
    parts = connected_components(edges).withColumnRenamed("node", "id")
    classes = classes.join(parts, "id", "left")
    n_links = F.lit(None).cast("long")
    if count_links:
        links = compared.filter("id is not null").groupBy("id").agg(F.sum("links").alias("n_links"))
        classes, n_links = classes.join(links, "id", "left"), F.coalesce("n_links", F.lit(0))
    classes = classes.select("sig", "n_copies", n_links.alias("n_links"), F.coalesce("root", "id").alias("root"))
    known = Table(filled.select("rid", "doc_id", "h", "n", "sig").join(classes, "sig").select("rid", "doc_id", "h", "n", "n_copies", "n_links", "root"), "known").read()
    best = Table(known.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.min("doc_id").alias("class_id")), "best").read()
    linked = known.join(best, "root").select("rid", "doc_id", "h", "n", "class_id", "n_links", "n_copies", F.col("first.rid").alias("keep_rid"))
    none = F.lit(0 if count_links else None).cast("long")
    alone = sets.filter("n = 0").select("rid", "doc_id", "h", "n", F.col("doc_id").alias("class_id"), none.alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.col("rid").alias("keep_rid"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies."""
    return similar_classes(docs, threshold, recall).select("doc_id", "class_id", "n_links", "n_copies")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each group of linked documents, with all columns; texts without words all stay. Rows are named by doc_id
    and a hash of the text; where rows repeat both and one of them stays, any one of them is taken."""
    found = similar_classes(docs, threshold, recall, count_links=False)
    some = found.groupBy("doc_id", "h").agg(F.count_if(F.col("rid") != F.col("keep_rid")).alias("gone"), F.count_if(F.col("rid") == F.col("keep_rid")).alias("stays")).filter("gone > 0")
    gone = Table(some, "dropped").read()
    key = [F.col("doc_id"), F.xxhash64("text")]
    left = without(docs, gone, ["doc_id", "h"], key)
    repeated = gone.filter("stays > 0")
    if repeated.isEmpty():
        return left
    maybe, _ = MaybeIn(repeated, "doc_id", "h").split(docs, *key)
    keyed = maybe.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key[0].alias("_doc"), key[1].alias("_h"))
    again = keyed.join(repeated.hint("merge"), F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")), "left_semi")
    return left.unionByName(again.groupBy("_doc", "_h").agg(F.any_value("row").alias("row")).select("row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
s AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS sig FROM g GROUP BY doc_id),
c AS MATERIALIZED (SELECT sig, min(doc_id) AS id, count(*) AS n_copies, any_value(n) AS n FROM s GROUP BY sig),
cg AS MATERIALIZED (SELECT doc_id, gram FROM g WHERE doc_id IN (SELECT id FROM c)),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM cg x JOIN cg y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN c ca ON ca.id = p.a JOIN c cb ON cb.id = p.b WHERE 9 * common >= 4 * (ca.n + cb.n)),
reach(a, b) AS (SELECT id, id FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
deg AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT w.doc_id, coalesce(root.root, w.doc_id) AS class_id, coalesce(deg.n_links, 0) AS n_links, coalesce(c.n_copies, 1) AS n_copies
FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN c ON c.sig = s.sig LEFT JOIN root ON root.id = c.id LEFT JOIN deg ON deg.id = c.id
"""
