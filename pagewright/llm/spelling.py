"""Spelling variants: words at an edit distance of one, found by a self-join of the vocabulary's trie.

Two words at distance one share all before the edit and all behind it. So the vocabulary is dealt by the code points that
two such words must share: for an edit in a window of places, the prefix before the window and the suffix behind it. A word
takes part for each window of its length and of the length above. A part too large for one task is dealt anew by the halves
of its window; a window of one place leaves at most one word for each letter, so every part gets small, however many words
share a prefix, and no pair is missed or found twice.

Within a part, a trie is walked level by level with each node's active nodes, those at distance one: a node's children make
new active pairs (two siblings: a replaced letter; a child and its parent: one more letter), and a pair goes on to the
children that both have. Pairs that end together are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Table

RUN = "[A-Za-zÀ-ÿ]+"
#: One run in so many loses a letter.
DAMAGE = 199
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: Words of a part that one task takes at once, and rows of a task's forest about.
PART, ROWS = 20_000, 1 << 16
#: Large parts whose keys are broadcast (16 bytes each); more are joined by merging.
BROADCAST_PARTS = 1 << 17
#: Levels after which pairs of single words are compared as strings.
DEEP = 32


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the runs of all texts, some damaged by rule. A null text has none; a null id is hashed as empty."""
    runs = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run")).filter(F.length("run") >= MIN_LENGTH)
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % DAMAGE == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= MIN_COUNT)


def _key(word: Column, size: Column, lo: Column, hi: Column) -> Column:
    """What all words of a part share: class, window, the prefix before it and the suffix behind it."""
    behind = size - hi
    return F.xxhash64(size, lo, hi, F.substr(word, F.lit(1), lo), F.when(behind > 0, F.substr(word, F.length(word) - behind + 1)).otherwise(F.lit("")))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", _key(F.col("word"), F.col("size"), F.col("lo"), F.col("hi")))


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of word, n, size, lo, hi -> the same at both halves of their window."""
    middle = F.expr("lo + (hi - lo) div 2")
    halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return rows.select("word", "n", "size", F.inline(F.filter(halves, lambda w: w.lo < w.hi)))


class _Forest:
    """Sorted words of several parts, each with the first place of its window and the place behind it."""

    def __init__(self, words: list[str], part: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray):
        self.words, self.part, self.lo, self.hi, self.size = words, part, lo, hi, size
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.offset = np.cumsum(self.length) - self.length
        self.points = np.append(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), 0).astype(np.int64)

    def children(self, first: np.ndarray, last: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of nodes (words first to last, a depth): pointers, letters (0: a word ends), first and last word of children."""
        n = last - first
        node = np.repeat(np.arange(len(n)), n)
        word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        inside = depth[node] < self.length[word]
        letter = np.where(inside, self.points[np.where(inside, self.offset[word] + depth[node], 0)], 0)
        start = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (letter[1:] != letter[:-1]))) if len(node) else np.zeros(0, np.int64)
        begin = word[start]
        return np.searchsorted(node[start], np.arange(len(n) + 1)), letter[start], begin, begin + np.diff(np.append(start, len(node)))

    def extend(self, u: np.ndarray, v: np.ndarray, banned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Active pairs (rows of first, last, depth) -> the pairs of children by the same letter, and whether words end."""
        tables = []
        for side in (u, v):
            one, at = np.unique(side[:, 0] * (1 << 32) + side[:, 2], return_index=True)
            which = np.searchsorted(one, side[:, 0] * (1 << 32) + side[:, 2])
            tables.append((which, *self.children(*side[at].T)))
        (iu, pu, lu, fu, eu), (iv, pv, lv, fv, ev) = tables
        n = pu[iu + 1] - pu[iu]
        pair = np.repeat(np.arange(len(n)), n)
        child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(pu[iu], n)
        owner = np.repeat(np.arange(len(pv) - 1), np.diff(pv))
        have, want = owner * (1 << 21) + lv, iv[pair] * (1 << 21) + lu[child]
        at = np.searchsorted(have, want)
        ok = (np.append(have, -1)[at] == want) & (lu[child] != banned[pair])
        pair, child, at = pair[ok], child[ok], at[ok]
        return np.stack([fu[child], eu[child], u[pair, 2] + 1], 1), np.stack([fv[at], ev[at], v[pair, 2] + 1], 1), lu[child] == 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words at distance one whose edit lies in their part's window: the last place of a run of letters
        where one of the run's is left out."""
        first = np.flatnonzero(np.append(True, self.part[1:] != self.part[:-1]))
        last = np.append(first[1:], len(self.part))
        grown = last - first > 1
        nodes = np.stack([first[grown], last[grown], self.lo[first[grown]]], 1)
        u, v, banned = np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        none = np.zeros(0, np.int64)
        out, step = [(none, none)], 0
        while len(nodes) or len(u):
            u, v, ended = self.extend(u, v, banned)
            out.append((u[ended, 0], v[ended, 0]))
            u, v, step = u[~ended], v[~ended], step + 1
            if step > DEEP:  # long tails of single words
                alone = (u[:, 1] - u[:, 0] == 1) & (v[:, 1] - v[:, 0] == 1)
                same = np.array([self.words[a][d:] == self.words[b][e:] for (a, _, d), (b, _, e) in zip(u[alone].tolist(), v[alone].tolist(), strict=True)], bool)
                out.append((u[alone][same, 0], v[alone][same, 0]))
                u, v = u[~alone], v[~alone]
            banned = np.full(len(u), -1)
            if len(nodes):
                ptr, letter, begin, end = self.children(*nodes.T)
                parent = np.repeat(np.arange(len(nodes)), np.diff(ptr))
                child = np.stack([begin, end, nodes[parent, 2] + 1], 1)
                many = (np.diff(ptr)[parent] > 1) & (letter > 0)
                longer = np.flatnonzero(many)
                # siblings: each child with those before it that do not end a word
                rank = np.arange(len(letter)) - ptr[parent] - (letter[ptr[parent]] == 0)
                n = np.where(many, rank, 0)
                right = np.repeat(np.arange(len(letter)), n)
                left = right - 1 - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                u = np.concatenate([u, child[longer], child[left]])
                v = np.concatenate([v, nodes[parent[longer]], child[right]])
                banned = np.concatenate([banned, letter[longer], np.full(len(left), -1)])
                nodes = child[(end - begin > 1) & (letter > 0) & (child[:, 2] < self.hi[begin])]
        a, b = (np.concatenate([o[i] for o in out]) for i in (0, 1))
        right_class = np.maximum(self.length[a], self.length[b]) == self.size[a]
        return a[right_class], b[right_class]


PAIRS = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of path, word, n, size, lo, hi in order of path and word -> pairs of words at distance one."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        path, n, size, lo, hi = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("path", "n", "size", "lo", "hi"))
        words = batch.column(batch.schema.get_field_index("word"))
        a, b = _Forest(words.to_pylist(), path, lo, hi, size).pairs()
        return pa.RecordBatch.from_arrays([words.take(pa.array(a)), pa.array(n[a]), words.take(pa.array(b)), pa.array(n[b])], schema=PAIRS)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        path = whole.column(whole.schema.get_field_index("path")).to_numpy()
        cut = int(np.flatnonzero(path == path[-1])[0])  # the last part may go on
        if cut:
            yield found(whole.slice(0, cut))
        held = [whole.slice(cut)]
    if held:
        yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words at an edit distance of exactly one, once. ``words``: distinct (word, n)."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    rows = words.select("word", "n", sizes).select("word", "n", "size", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    rows = _keyed(_halves(rows))
    found = None
    while True:
        large = Table(rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("hi") - F.col("lo")).alias("places")).filter((F.col("rows") > PART) & (F.col("places") > 1)).select("path"), "parts").read()
        few = large.count()
        beside = F.broadcast if few <= BROADCAST_PARTS else lambda df: df.hint("merge")
        small = rows.join(beside(large), "path", "left_anti") if few else rows
        joined = small.repartition("path").sortWithinPartitions("path", "word").mapInArrow(_join, "a string, n_a long, b string, n_b long")
        found = joined if found is None else found.unionByName(joined)
        if not few:
            return found
        rows = Table(_keyed(_halves(rows.join(beside(large), "path", "left_semi").drop("path"))), "halves").read()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of the chain of forms, by doubling. A form is RATIO times as frequent as its
    word, so chains are short and have no cycles."""
    now = Table(forms.select("word", F.col("form").alias("root")), "roots").read()
    while True:
        on = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
        if on.filter("_next is not null").isEmpty():
            return now
        now = Table(on.select("word", F.coalesce("_next", "root").alias("root")), "roots").read()


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    ``form``: the word's near word of largest n (ties: smallest in code-point order) where that n is RATIO times the word's
    at least. Repeated rows count each, an empty table gives no rows, other columns play no part.
    """
    words = Table(vocabulary(docs), "vocabulary").read()
    pairs = Table(near_pairs(words), "near").read()
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    ways = ways.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    has = -F.col("best.minus") >= RATIO * F.col("n")
    known = Table(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n")), "forms").read()
    roots = _roots(known.filter("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
x AS (SELECT doc_id, run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
h AS (SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM x, t),
d AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS turn FROM p),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND turn = 1),
chain(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.*, c.root FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) c USING (word)
"""
