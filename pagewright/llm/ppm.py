"""Language-model scores by prediction by partial matching over bytes, and a unigram baseline over tokens.

Training counts every run of ORDER + 1 symbols (bytes of the folded text, an end mark, start marks as context) over all
training rows; the runs of held-out rows are gathered with them, at a count of 0. The byte-context trie follows from the
counts by marginals, a table for each order. Escapes are estimated as in method D: a context that saw d distinct symbols
in t occurrences gives the escape d / 2t and a symbol of n occurrences (2n - 1) / 2t. After an escape the shorter
context excludes the symbols that the longer one has seen. The code length of a text is the sum over its bytes and its
end.

The price of a run depends on the trie alone. So each distinct run is priced once, by joins down the orders: a run that
was trained at its longest context by that context's total, and the few others by escapes. A context has at most 257
children, so no key of these joins is hot. Prices, and those of tokens, are dealt by a hash to hash tables of bounded
size in the shared folder. Scoring reads the documents once, whatever the size: a task holds the tables' cells while
they are few, and beyond that takes them in turns for each block of its documents.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import NONSPACE, folded_slices, groups_by_bytes, mix, words_of
from .common import Table, id_crc, scratch_path
from .warc import store_of

ORDER = 5
BITS = 9
END, START = 256, 257
ALPHABET = 257
FOLDS = 10
#: Cells of one hash table (12 bytes each, half of them used about), and cells that a task holds at once.
TABLE_CELLS = 1 << 17
HELD_CELLS = 1 << 24
#: Bytes of text taken at once: with all cells held, and where they come in turns.
GROUP_BYTES, TURN_BYTES = 1 << 20, 16 << 20
COUNT_SYMBOLS = 4 << 20
ALPHA = 0.1

_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def long_grams(text: bytes, piece: int = GROUP_BYTES) -> Iterator[np.ndarray]:
    """Packed (context, symbol) of every position of a text, its end included, the symbol in the low bits; a piece of the
    text at a time."""
    data = np.frombuffer(text, np.uint8)
    for lo in range(0, len(text) + 1, piece):
        hi = min(lo + piece, len(text) + 1)
        symbols = np.full(hi - lo + ORDER, START, np.uint64)
        first = max(0, lo - ORDER)
        part = data[first : min(hi, len(text))]
        symbols[first - lo + ORDER : first - lo + ORDER + len(part)] = part
        if hi > len(text):
            symbols[-1] = END
        packed = symbols.copy()
        for k in range(1, ORDER + 1):
            packed[k:] |= symbols[:-k] << np.uint64(BITS * k)
        yield packed[ORDER:]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for many short texts at once, and the pointers of the texts into the positions."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    symbols = np.full(int(sizes.sum()) + len(texts) * (ORDER + 1), START, np.uint64)
    real = np.zeros(len(symbols), bool)
    at = 0
    for t in texts:
        at += ORDER
        symbols[at : at + len(t)] = np.frombuffer(t, np.uint8)
        symbols[at + len(t)] = END
        real[at : at + len(t) + 1] = True
        at += len(t) + 1
    packed = symbols.copy()
    for k in range(1, ORDER + 1):
        packed[k:] |= symbols[:-k] << np.uint64(BITS * k)
    return packed[real], np.concatenate([[0], np.cumsum(sizes + 1)])


def _blocks(texts: list[bytes], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(packed positions, indexes of texts, their pointers), about ``limit`` bytes of text at a time."""
    for lo, hi in groups_by_bytes([len(t) for t in texts], limit):
        if hi - lo == 1 and len(texts[lo]) > limit:
            for packed in long_grams(texts[lo], limit):
                yield packed, np.array([lo]), np.array([0, len(packed)])
        else:
            packed, ptr = grams(texts[lo:hi])
            yield packed, np.arange(lo, hi), ptr


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(kind, key, n) over rows of text, held_out: kind 0 for packed symbol runs of all rows with their count in training
    rows, 1 for hashes of training tokens, 2 for ends of training texts. Each task adds up what it has read before
    anything is exchanged."""
    arrow = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def batch_of(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        size = ends = 0

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            return _sum_by(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))

        def found(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for learn in (True, False):
                own = batch.column(0).filter(pc.equal(batch.column(1), not learn))
                for _, _, texts in folded_slices(own, GROUP_BYTES):
                    for packed, _, _ in _blocks(texts, GROUP_BYTES):
                        keys, n = np.unique(packed, return_counts=True)
                        yield 0, keys, n * learn
                    if learn:
                        yield 1, *np.unique(words_of(texts, NONSPACE)[0], return_counts=True)

        for batch in batches:
            ends += int((~batch.column(1).to_numpy(zero_copy_only=False)).sum())
            for kind, keys, n in found(batch):
                held[kind].append((keys, n))
                size += len(keys)
                if size > COUNT_SYMBOLS // 2:
                    held = {k: [merged(k)] if held[k] else [] for k in held}
                    size = 0
                    if sum(len(held[k][0][0]) for k in held if held[k]) > COUNT_SYMBOLS:
                        for k in held:
                            if held[k]:
                                yield batch_of(k, *held[k][0])
                        held = {0: [], 1: []}
        for kind in held:
            if held[kind]:
                yield batch_of(kind, *merged(kind))
        if ends:
            yield batch_of(2, np.zeros(1, np.uint64), np.array([ends]))

    counted = rows.select("text", "held_out").mapInArrow(run, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _context(key: Column, order: int) -> Column:
    return F.shiftright(key, BITS).bitwiseAND(F.lit((1 << BITS * order) - 1))


def _symbol(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << BITS) - 1))


def run_prices(runs: DataFrame) -> DataFrame:
    """(key, price) of every run of (key, n): the log10 probability of its symbol after its context, from a trie that has
    learned each run n times."""
    n, t = F.col("n"), F.col("t")
    own = F.count_if(n > 0), F.sum("n"), F.count_if(n == 0)
    contexts = runs.withColumn("context", _context(F.col("key"), ORDER))
    stats = contexts.groupBy("context").agg(own[0].alias("d"), own[1].alias("t"), own[2].alias("new"))
    level = Table(contexts.join(stats.hint("merge"), "context"), "level").read()
    known = level.filter("n > 0").select("key", F.log10((n - 0.5) / t).alias("price"))
    kids = level.filter("n > 0 and new > 0").groupBy("context").agg(F.collect_list(_symbol(F.col("key"))).alias("seen"))
    unseen = level.filter("n = 0").select("key", "context", "d", "t").join(kids.hint("merge"), "context", "left")
    escape = lambda d, t: F.log10(d / 2) - F.log10(t)
    open_runs = Table(unseen.select("key", F.when(F.col("d") > 0, escape(F.col("d"), t)).otherwise(0.0).alias("price"), "seen"), "open")
    priced = [known]
    counts = runs.filter("n > 0")
    for k in range(ORDER - 1, -1, -1):
        counts = counts.select(F.col("key").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
        counts = Table(counts, "counts").read()
        todo = open_runs.read().withColumn("context", _context(F.col("key"), k))
        nodes = counts.select(_context(F.col("key"), k).alias("context"), F.struct(_symbol(F.col("key")).alias("s"), "n").alias("kid"))
        nodes = nodes.join(todo.select("context").distinct().hint("merge"), "context", "left_semi").groupBy("context").agg(F.collect_list("kid").alias("kids"))
        met = todo.join(nodes.hint("merge"), "context", "left")
        left = F.when(F.col("seen").isNull(), F.col("kids")).otherwise(F.filter("kids", lambda x: ~F.array_contains("seen", x["s"])))
        met = met.withColumn("left", left).withColumn("own", F.expr(f"get(filter(kids, x -> x.s = (key & {(1 << BITS) - 1})), 0).n"))
        met = met.withColumn("total", F.aggregate("left", F.lit(0).cast("long"), lambda a, x: a + x["n"]).cast("double")).withColumn("distinct", F.size("left"))
        price = (
            F.when(F.col("own").isNotNull(), F.col("price") + F.log10(F.col("own") - 0.5) - F.log10("total"))
            .when(F.col("kids").isNotNull() & (F.col("distinct") > 0), F.col("price") + escape(F.col("distinct"), F.col("total")))
            .otherwise(F.col("price"))
        )
        seen = F.when(F.col("kids").isNull(), F.col("seen")).otherwise(F.transform("kids", lambda x: x["s"]))
        step = Table(met.select("key", price.alias("price"), seen.alias("seen"), F.col("own").isNotNull().alias("over")), "open")
        priced.append(step.read().filter("over").select("key", "price"))
        open_runs = Table(step.read().filter("not over").select("key", "price", "seen"), "open")
    rest = F.greatest(F.lit(1), ALPHABET - F.coalesce(F.size("seen"), F.lit(0)))
    last = open_runs.read().select("key", (F.col("price") - F.log10(F.when(F.col("seen").isNull(), F.lit(ALPHABET)).otherwise(rest))).alias("price"))
    for part in [*priced[1:], last]:
        known = known.unionByName(part)
    return known


class Cells:
    """Prices by key, in hash tables that lie in files of the shared folder. ``places``: file and number of each table."""

    def __init__(self, folder: str, bits: int, places: dict[int, tuple[str, int]]):
        self.folder, self.bits, self.places = folder, bits, places
        self.turns = max(1, (1 << bits) // HELD_CELLS)
        self.turn, self.keys, self.prices = -1, np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def _load(self, turn: int) -> None:
        if turn == self.turn:
            return
        n = (1 << self.bits) // self.turns
        self.keys = self.prices = None  # the last turn's go before the next come
        self.keys, self.prices, self.turn = np.full(n, _FREE), np.zeros(n, np.float32), turn
        fs, root = store_of(self.folder)
        first = turn * (n // TABLE_CELLS)
        by_file: dict[str, list[tuple[int, int]]] = {}
        for table in range(first, first + n // TABLE_CELLS):
            if table in self.places:
                name, number = self.places[table]
                by_file.setdefault(name, []).append((number, table - first))
        for name, wanted in by_file.items():
            with fs.open_input_file(f"{root}/{name}") as f:
                for number, at in wanted:
                    f.seek(number * TABLE_CELLS * 12)
                    own = slice(at * TABLE_CELLS, (at + 1) * TABLE_CELLS)
                    self.keys[own] = np.frombuffer(f.read(TABLE_CELLS * 8), np.uint64)
                    self.prices[own] = np.frombuffer(f.read(TABLE_CELLS * 4), np.float32)

    def add_prices(self, keys: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Writes the prices of keys that are there into ``out``; says which are."""
        home = (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.zeros(len(keys), bool)
        for turn in range(self.turns):
            self._load(turn)
            base = turn * len(self.keys)
            if self.turns == 1:
                own, at, want = None, home, keys
            else:
                own = np.flatnonzero(home // len(self.keys) == turn)
                at, want = home[own] - base, keys[own]
            there = self.keys[at]
            hit = there == want
            todo = np.flatnonzero(~hit & (there != _FREE))
            at = at if own is not None else at.copy() if len(todo) else at
            while len(todo):
                at[todo] = at[todo] & ~(TABLE_CELLS - 1) | at[todo] + 1 & TABLE_CELLS - 1
                there = self.keys[at[todo]]
                hit[todo] = there == want[todo]
                todo = todo[(there != want[todo]) & (there != _FREE)]
            if own is None:
                out[hit] = self.prices[at[hit]]
                found = hit
            else:
                out[own[hit]] = self.prices[at[hit]]
                found[own[hit]] = True
        return found


def write_cells(prices: DataFrame, entries: int, tag: str) -> tuple[str, int, dict[int, tuple[str, int]]]:
    """Stores (key, price) in hash tables of TABLE_CELLS cells: folder, bits of a cell's number, place of each table. The
    driver gets a line for each table only; a task that runs again writes a file of another name."""
    folder = scratch_path(prices.sparkSession, tag)
    bits = max(TABLE_CELLS.bit_length() - 1, (2 * max(1, entries) - 1).bit_length())
    shift = bits - (TABLE_CELLS.bit_length() - 1)
    dealt = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("price", pa.float32())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = mix(batch.column(0).to_numpy().view(np.uint64))
            part = (home >> np.uint64(64 - shift)).astype(np.int32) if shift else np.zeros(len(home), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), batch.column(1)], schema=dealt)

    placed = pa.schema([("part", pa.int32()), ("name", pa.string()), ("number", pa.int32())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(folder)
        name, out, written = f"{uuid.uuid4().hex}.cells", None, []

        def table(part: int, keys: np.ndarray, price: np.ndarray) -> None:
            nonlocal out
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            cells, prices = np.full(TABLE_CELLS, _FREE), np.zeros(TABLE_CELLS, np.float32)
            at = (mix(keys) >> np.uint64(64 - bits)).astype(np.int64) & TABLE_CELLS - 1
            todo = np.arange(len(keys))
            while len(todo):
                free = cells[at] == _FREE
                cells[at[free]] = keys[todo[free]]
                prices[at[free]] = price[todo[free]]
                lost = cells[at] != keys[todo]
                if free.any() and not lost.any():
                    break
                prices[at[~lost]] = price[todo[~lost]]
                todo, at = todo[lost], at[lost] + 1 & TABLE_CELLS - 1
            out.write(cells.tobytes())
            out.write(prices.tobytes())
            written.append((part, name, len(written)))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if held and held[0].column(0)[0].as_py() != parts[lo]:
                    table(*_joined(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            table(*_joined(held))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*written, strict=True), placed, strict=True)] if written else [pa.array([], f.type) for f in placed], schema=placed)

    rows = prices.select("key", F.col("price").cast("float").alias("price")).mapInArrow(deal, "part int, key long, price float")
    rows = rows.repartition("part").sortWithinPartitions("part").mapInArrow(write, "part int, name string, number int")
    return folder, bits, {x["part"]: (x["name"], x["number"]) for x in rows.collect()}


def _joined(held: list[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray]:
    whole = pa.Table.from_batches(held)
    return held[0].column(0)[0].as_py(), whole.column(1).to_numpy().view(np.uint64), whole.column(2).to_numpy()


class Adaptive:
    """The same model learned as it reads, symbol by symbol, on one machine."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def log10(self, text: bytes, learn: bool = True) -> float:
        """log10 probability of a text and its end; with ``learn`` every symbol is learned once it is coded. An empty
        text has its end alone, of probability 1 / 257 to begin with."""
        symbols = [START] * self.order + list(text) + [END]
        total = 0.0
        for i in range(self.order, len(symbols)):
            s, excluded, done = symbols[i], set(), False
            for k in range(self.order, -1, -1):
                own = self.counts.get(tuple(symbols[i - k : i]))
                if not own:
                    continue
                left = {a: n for a, n in own.items() if a not in excluded}
                if not left:
                    continue
                t, d = sum(left.values()), len(left)
                if s in left:
                    total += math.log10((left[s] - 0.5) / t)
                    done = True
                    break
                total += math.log10(d / (2 * t))
                excluded |= set(left)
            if not done:
                total -= math.log10(max(1, ALPHABET - len(excluded)))
            for k in range(self.order + 1) if learn else ():
                own = self.counts.setdefault(tuple(symbols[i - k : i]), {})
                own[s] = own.get(s, 0) + 1
        return total


def adaptive_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, score, the log10 probability of each folded text by itself, from a model that starts
    empty and learns as it reads. Null texts are empty; rows do not depend on each other."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [Adaptive().log10(t) for _, _, texts in folded_slices(batch.column(1), GROUP_BYTES) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("score", "double"))


def score_documents(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text is a multiple of ``folds`` are held out; all others are learned from. Null texts
    are empty and have one token, the end. Repeated rows are learned and scored as often as they stand. With no training
    rows every symbol is equally likely and the baseline is that of an empty vocabulary (N = V = 0). An empty table
    gives no rows. The score covers the folded text (A-Z lower-cased) and its end; long texts are taken piece by piece.
    """
    rows = docs.select("doc_id", (id_crc(F.col("doc_id")) % folds == 0).alias("held_out"), "text")
    counts = Table(corpus_counts(rows), "counts").read()
    runs, tokens = counts.filter("kind = 0").select("key", "n"), counts.filter("kind = 1")
    stats = {x["kind"]: x for x in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    size = lambda kind, what: stats[kind][what] if kind in stats else 0
    ends = size(2, "n")
    n_all, v_all = size(1, "n") + ends, size(1, "rows") + (1 if ends else 0)
    bottom = math.log10(n_all + ALPHA * (v_all + 1))
    unknown, end_price = math.log10(ALPHA) - bottom, math.log10(ends + ALPHA) - bottom
    of_runs = write_cells(run_prices(runs), size(0, "rows"), "run-prices")
    of_tokens = write_cells(tokens.select("key", (F.log10(F.col("n") + ALPHA) - bottom).alias("price")), size(1, "rows"), "token-prices")
    schema = rows.select("doc_id", "held_out").schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run, by_token = Cells(*of_runs), Cells(*of_tokens)
        for batch in batches:
            score, base = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            n_tokens, n_known = np.ones(batch.num_rows, np.int64), np.full(batch.num_rows, int(ends > 0))
            limit = GROUP_BYTES if by_run.turns == by_token.turns == 1 else TURN_BYTES
            for lo, hi, texts in folded_slices(batch.column(2), limit):
                for packed, own, ptr in _blocks(texts, limit):
                    price = np.zeros(len(packed), np.float32)
                    by_run.add_prices(packed, price)
                    score[lo + own] += np.add.reduceat(price, ptr[:-1], dtype=np.float64)
                h, _, _, ptr, _ = words_of(texts, NONSPACE)
                price = np.full(len(h), unknown)
                known = np.append(0, np.cumsum(by_token.add_prices(h, price)))
                sums = np.append(0.0, np.cumsum(price))
                base[lo:hi] = sums[ptr[1:]] - sums[ptr[:-1]] + end_price
                n_tokens[lo:hi] += np.diff(ptr)
                n_known[lo:hi] += known[ptr[1:]] - known[ptr[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score)], names=schema.names)

    scored = rows.mapInArrow(run, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
