"""Toxicity scores by a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

A word enters as a word vector (hashed) and as the pooled vectors of its character n-grams (hashed, with marks at its
ends). Both tables hold one fixed coordinate, the shrunken log-odds of the word or n-gram in toxic training documents,
and trained ones. The network reads windows of WINDOW words that overlap by half, attends over their words and gives a
score; a document's score is that of its strongest window, calibrated on training rows that the network did not see.
Only documents are labelled, so training goes back and forth between choosing the strongest windows of toxic documents
and fitting the network (multiple-instance learning). All is trained in numpy on a bounded sample of labelled rows, in one task.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gru
from .bytewords import TERM, fold_texts, folded_slices, mix, words_of
from .common import id_crc

FOLDS = 5
#: Bounds of the training sample: labelled rows of each class, and characters of a class from which no more rows follow.
#: Texts are never cut.
ROWS_PER_CLASS = 1500
CLASS_CHARS = 18_000_000
WINDOW, STRIDE = 32, 16
WORD_BITS, GRAM_BITS = 17, 17
GRAMS = (3, 4, 5)
VECTOR = 3
HIDDEN = 8
INPUTS = 3 + 2 * VECTOR
#: Pseudo-count of the log-odds' shrinkage to the share of toxic rows.
SHRINK = 4.0
ROUNDS, EPOCHS, BATCH = 3, 4, 256
GROUP_BYTES = 1 << 19
BLOCK_WINDOWS = 8192


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pointers of the texts into their words, the words as numbers, and of each distinct word: its hash bucket, its
    n-gram buckets one after another and their pointers."""
    h, s, e, ptr, data = words_of(texts, TERM)
    distinct, first, number = np.unique(h, return_index=True, return_inverse=True)
    s, n = s[first], (e - s)[first]
    size = n + 2
    place = np.concatenate([[0], np.cumsum(size)])
    buf = np.zeros(int(place[-1]), np.uint64)
    inner = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    buf[np.repeat(place[:-1] + 1, n) + inner] = np.frombuffer(data, np.uint8)[np.repeat(s, n) + inner]
    buf[place[:-1]] = 1
    buf[place[1:] - 1] = 2
    keys, owners = [], []
    for g in GRAMS:
        count = np.maximum(0, size - g + 1)
        at = np.repeat(place[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count)
        key = np.full(len(at), g, np.uint64)
        for k in range(g):
            key = (key << np.uint64(8)) | buf[at + k]
        keys.append(key)
        owners.append(np.repeat(np.arange(len(distinct)), count))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    grams = (mix(key[order]) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
    return ptr, number, (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64), grams, np.searchsorted(owner[order], np.arange(len(distinct) + 1))


def windows(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first word and length of all overlapping windows; texts without words have none."""
    n = np.diff(ptr)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
    owner = np.repeat(np.arange(len(n)), count)
    order = np.arange(int(count.sum())) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count)
    begin = np.minimum(order * STRIDE, np.maximum(0, n[owner] - WINDOW))
    return owner, ptr[:-1][owner] + begin, np.minimum(WINDOW, n[owner])


class Scorer:
    """Tables of log-odds, trained vectors and weights."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.word_odds, self.gram_odds = np.zeros(1 << WORD_BITS, np.float32), np.zeros(1 << GRAM_BITS, np.float32)
        w = {"x": rng.normal(0, 0.4, (6 * h, INPUTS)), "b": np.zeros((6 * h, 1)), "uf": gru.init(h, rng), "ub": gru.init(h, rng), "a": rng.normal(0, 0.3, (1, 2 * h)), "o": rng.normal(0, 0.3, (1, 2 * h)), "ob": np.zeros((1, 1)), "word": rng.normal(0, 0.02, (VECTOR, 1 << 12)), "gram": rng.normal(0, 0.02, (VECTOR, 1 << 12))}
        self.w = {k: v.astype(np.float32) for k, v in w.items()}
        self.scale, self.shift, self.length, self.prior = 1.0, 0.0, 0.0, 0.0

    def inputs(self, words: np.ndarray, grams: np.ndarray, ptr: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
        """Features (INPUTS, words) of distinct words."""
        if not len(words):
            return np.zeros((INPUTS, 0), np.float32)
        odds, first, count = gram_odds[grams], ptr[:-1], np.diff(ptr).astype(np.float32)
        rows = [word_odds[words], np.add.reduceat(odds, first) / count, np.maximum.reduceat(odds, first)]
        rows += [v[words & 4095] for v in self.w["word"]]
        rows += [np.add.reduceat(v[grams & 4095], first) / count for v in self.w["gram"]]
        return np.stack(rows).astype(np.float32)

    def windows_forward(self, features: np.ndarray, number: np.ndarray, begin: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows; with ``keep`` also what the backward pass needs."""
        w, h = self.w, HIDDEN
        n = len(begin)
        projected = w["x"] @ features + w["b"]
        pf, pb = np.ascontiguousarray(projected[: 3 * h]), np.ascontiguousarray(projected[3 * h :])
        steps = int(length.max(initial=0))
        mask = (np.arange(steps)[:, None] < length[None, :]).astype(np.float32)
        at = np.minimum(begin[None, :] + np.arange(steps)[:, None], len(number) - 1)
        ids = number[at]
        f = gru.forward(w["uf"], lambda t: np.take(pf, ids[t], axis=1), steps, n, mask, keep)
        b = gru.forward(w["ub"], lambda t: np.take(pb, ids[steps - 1 - t], axis=1), steps, n, mask[::-1], keep)
        (sf, cf), (sb, cb) = (f, b) if keep else ((f, None), (b, None))
        back = sb[::-1]
        attend = np.stack([(w["a"][:, :h] @ sf[t] + w["a"][:, h:] @ back[t])[0] for t in range(steps)]) + (mask - 1) * 1e9
        attend = np.exp(attend - attend.max(axis=0))
        attend *= mask
        attend /= attend.sum(axis=0)
        pooled = np.concatenate([np.einsum("tb,thb->hb", attend, sf), np.einsum("tb,thb->hb", attend, back)])
        logit = (w["o"] @ pooled + w["ob"])[0]
        return (logit, (ids, mask, sf, back, cf, cb, attend, pooled)) if keep else logit

    def windows_backward(self, features: np.ndarray, saved: tuple, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the word features, from those of the logits."""
        w, h = self.w, HIDDEN
        ids, mask, sf, back, cf, cb, attend, pooled = saved
        both = np.concatenate([sf, back], axis=1)
        dp = w["o"].T @ d[None, :]
        da = np.einsum("hb,thb->tb", dp, both)
        ds = attend * (da - (attend * da).sum(axis=0))
        dh = attend[:, None, :] * dp[None] + ds[:, None, :] * w["a"].T[None]
        grads = {"o": (pooled @ d)[None, :], "ob": d.sum().reshape(1, 1), "a": np.einsum("tb,thb->h", ds, both)[None, :]}
        grads["uf"], gf = gru.backward(w["uf"], cf, dh[:, :h], mask)
        grads["ub"], gb = gru.backward(w["ub"], cb, dh[::-1, h:], mask[::-1])
        dproj = np.concatenate([gf, gb[::-1]], axis=1) * mask[:, None, :]
        flat = ids.ravel()
        dproj = np.stack([np.bincount(flat, dproj[:, j].ravel(), features.shape[1]) for j in range(6 * h)]).astype(np.float32)
        grads["x"], grads["b"] = dproj @ features.T, dproj.sum(axis=1, keepdims=True)
        return grads, w["x"].T @ dproj

    def document_logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The strongest window's logit (NaN without words) and the number of windows of each text."""
        ptr, number, words, grams, gptr = distinct_words(texts)
        owner, begin, length = windows(ptr)
        best = np.full(len(texts), -np.inf)
        if len(owner):
            features = self.inputs(words, grams, gptr, self.word_odds, self.gram_odds)
            for at in range(0, len(owner), BLOCK_WINDOWS):
                part = slice(at, at + BLOCK_WINDOWS)
                np.maximum.at(best, owner[part], self.windows_forward(features, number, begin[part], length[part]))
        return np.where(np.isfinite(best), best, np.nan), np.bincount(owner, minlength=len(texts))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logit, count = self.document_logits(texts)
        z = np.where(np.isnan(logit), self.prior, self.scale * np.nan_to_num(logit) + self.shift + self.length * np.log(np.maximum(1, count)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _log_odds(buckets: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Shrunken log-odds of toxic rows among those that hold a bucket, against their share; 0 for buckets of no row."""
    toxic, clean = np.zeros(size), np.zeros(size)
    for b, y in zip(buckets, labels, strict=True):
        (toxic if y else clean)[np.unique(b)] += 1
    share = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
    p = (toxic + SHRINK * share) / (toxic + clean + SHRINK)
    return np.where(toxic + clean > 0, np.log(p / (1 - p)) - math.log(share / (1 - share)), 0).astype(np.float32)


def _spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after another."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _held(number: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words that windows hold, the windows' words numbered among them, and where each window begins there."""
    held, local = np.unique(number[_spans(begin, length)], return_inverse=True)
    return held, local, np.cumsum(length) - length


def fit(sample: list[tuple[int, str]], seed: int = 9) -> Scorer:
    """A scorer from (label, text) rows. Without rows of both classes it gives every text the share of toxic rows."""
    model = Scorer(seed)
    labels = np.array([int(y) for y, _ in sample])
    share = (labels.sum() + 0.5) / (len(labels) + 1.0) if len(labels) else 0.5
    model.prior = math.log(share / (1 - share))
    if not len(labels) or labels.min() == labels.max():
        model.scale, model.shift = 0.0, model.prior
        return model
    rng = np.random.default_rng(seed)
    texts = fold_texts([t for _, t in sample])
    ptr, number, words, grams, gptr = distinct_words(texts)
    per_doc = [np.unique(number[ptr[i] : ptr[i + 1]]) for i in range(len(texts))]
    gram_of = [np.unique(np.concatenate([grams[gptr[w] : gptr[w + 1]] for w in d.tolist()] or [grams[:0]])).astype(np.int32) for d in per_doc]
    # log-odds for training come from the other folds, so that no row's features know its own label
    fold = np.empty(len(labels), np.int64)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        fold[rng.permutation(own)] = np.arange(len(own)) % 4
    owner, begin, length = windows(ptr)
    odds = {}
    for f in (0, 1, 2, 3, None):
        use = [i for i in range(len(labels)) if fold[i] != f]
        odds[f] = (_log_odds([words[per_doc[i]] for i in use], labels[use], 1 << WORD_BITS), _log_odds([gram_of[i] for i in use], labels[use], 1 << GRAM_BITS))
    train, check = fold != 3, fold == 3

    def features(f: int | None) -> np.ndarray:
        return model.inputs(words, grams, gptr, *odds[f])

    def all_logits() -> np.ndarray:
        out = np.empty(len(owner), np.float32)
        for f in range(4):
            own = np.flatnonzero(fold[owner] == f)
            x = features(f)
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192]
                out[part] = model.windows_forward(x, number, begin[part], length[part])
        return out

    adam = gru.Adam(model.w, 0.01, 1e-4)
    for turn in range(ROUNDS):
        if turn:
            strength = all_logits()
        else:
            strength = np.empty(len(owner), np.float32)
            for f in range(4):
                x = features(f)
                power = np.maximum(x[0], x[2])[number]
                own = np.flatnonzero(fold[owner] == f)
                best = np.array([np.sort(power[b : b + n])[-3:].sum() for b, n in zip(begin[own].tolist(), length[own].tolist(), strict=True)])
                strength[own] = best
        rank = np.lexsort((-strength, owner))
        place = np.empty(len(owner), np.int64)
        starts = np.searchsorted(owner[rank], owner[rank])
        place[rank] = np.arange(len(owner)) - starts
        positive = np.flatnonzero((place == 0) & (labels[owner] == 1) & train[owner])
        negative = np.flatnonzero((labels[owner] == 0) & train[owner] & ((place < 2) | (rng.random(len(owner)) < 0.1)))
        for _ in range(EPOCHS):
            reps = max(1, min(8, len(negative) // (3 * max(1, len(positive)))))
            chosen = rng.permutation(np.concatenate([np.repeat(positive, reps), negative]))
            by_fold = [chosen[fold[owner[chosen]] == f] for f in range(3)]
            xs = [features(f) for f in range(3)]
            for at in range(0, max(len(c) for c in by_fold), BATCH):
                for f in range(3):
                    part = by_fold[f][at : at + BATCH]
                    if not len(part):
                        continue
                    held, local, starts = _held(number, begin[part], length[part])
                    x = xs[f][:, held]
                    logit, saved = model.windows_forward(x, local, starts, length[part], keep=True)
                    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                    grads, dx = model.windows_backward(x, saved, ((p - labels[owner[part]]) / len(part)).astype(np.float32))
                    grads["word"] = np.stack([np.bincount(words[held] & 4095, dx[3 + j], 4096) for j in range(VECTOR)]).astype(np.float32)
                    count = np.diff(gptr)[held]
                    own = grams[_spans(gptr[held], count)] & 4095
                    grads["gram"] = np.stack([np.bincount(own, np.repeat(dx[3 + VECTOR + j] / count, count), 4096) for j in range(VECTOR)]).astype(np.float32)
                    adam.step(grads)
    logits = all_logits()
    best = np.full(len(labels), -np.inf)
    np.maximum.at(best, owner, logits)
    many = np.log(np.maximum(1, np.bincount(owner, minlength=len(labels))))
    use = np.isfinite(best) & check if len(set(labels[np.isfinite(best) & check].tolist())) == 2 else np.isfinite(best)
    model.scale, model.shift, model.length = _calibrate(best[use], many[use], labels[use])
    model.word_odds, model.gram_odds = odds[None]
    return model


def _calibrate(logit: np.ndarray, many: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and weight of the log window count of a logistic regression with a small ridge, by Newton steps."""
    x = np.stack([logit, np.ones(len(logit)), many], axis=1)
    w, ridge = np.array([1.0, 0.0, 0.0]), np.diag([1.0, 0.1, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ (w - np.array([1.0, 0.0, 0.0]))
        w -= np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad), -0.5, 0.5)
    return max(0.05, float(w[0])), float(w[1]), float(w[2])


def held_out(doc_id: Column) -> Column:
    return id_crc(doc_id) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text, doc_id) of labelled rows outside the held-out fold: at most ROWS_PER_CLASS of each class, drawn by the hash
    of the id, as whole texts; a row follows while those before it have less than CLASS_CHARS. The drawn ids are few, so
    that the documents are filtered by a broadcast of them."""
    rows = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = []
    for y in (0, 1):
        ids.append(rows.filter(F.col("toxic") == y).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS_PER_CLASS))
    drawn = ids[0].unionByName(ids[1])
    got = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").filter("text is not null")
    top = got.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("toxic", "text"))).filter("turn = 1")
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    fit_in = top.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).filter(F.col("before") < CLASS_CHARS)
    return fit_in.select("toxic", "text", "doc_id")


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str]]:
    """(label, text) of the training rows."""
    return [(x["toxic"], x["text"]) for x in training_rows(docs, labels).sort("doc_id").collect()]


def train(rows: DataFrame) -> bytes:
    """The pickled state of a scorer fitted to training rows by one task, so that the driver gets tables and weights alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(fit(sample)))], pa.binary())], names=["state"])

    state = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "state binary").collect()
    return bytes(state[0][0]) if state else pickle.dumps(vars(fit([])))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Whole texts are scored in all their windows. Null, empty and wordless texts get the share of toxic training rows.
    Ids labelled twice count once in each class that they have. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, labels)))
    rows = docs.select(F.col("doc_id").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Scorer()
        vars(model).update(pickle.loads(held.value))
        for batch in batches:
            for lo, hi, texts in folded_slices(batch.column(2), GROUP_BYTES):
                score = model.scores(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    schema = rows.select("doc_id", "held_out").schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, schema)
