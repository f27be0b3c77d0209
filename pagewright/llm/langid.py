"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte position of a text; the document's probabilities are the means over its positions. It is
trained in numpy on the driver from a bounded sample of labelled rows and goes out as a few kilobytes of weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gru
from .bytewords import fold_texts, folded_slices
from .common import id_crc, inline_rows

UNDETERMINED = "und"
LETTER = r"\p{L}"
FOLDS, HELD_FOLD = 3, 1
#: Bounds of the training sample: distinct texts of each label, whole texts; a row follows while those of its label before
#: it have less than LABEL_CHARS characters, or less than its share of ALL_CHARS. Of more than LABELS labels those with the
#: most texts are learned, so that the sample is bounded however many there are.
ROWS_PER_LABEL = 300
LABEL_CHARS = 1_000_000
ALL_CHARS = 32_000_000
LABELS = 1000
HIDDEN = 8
TRAIN_STEPS, TRAIN_WIDTH, TRAIN_LENGTH = 250, 256, 48
#: Score from which a text counts as one in its predicted language: that has half of the text's positions or more.
SURE = 0.5
LENGTH = 128
GROUP_BYTES = 1 << 19
#: Label probabilities held at once.
CELLS = 1 << 24


def training_sample(rows: DataFrame, label: Column, text: Column) -> list[tuple[str, str]]:
    """(label, text) of min(ROWS_PER_LABEL, distinct texts) rows for each label: its texts of the smallest hashes, copies
    counted once. The first pass estimates distinct texts by label, the second reads the texts below a hash bound that
    about four times the rows fall under and keeps one copy of each before the exchange. A label that the bound left
    short is read again in whole."""
    rows = rows.select(label.alias("label"), text.alias("text"), F.xxhash64(text, F.lit(1)).alias("h")).filter("label is not null and length(trim(text)) > 0")
    many = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS + 1).collect()
    learned = [x["label"] for x in many[:LABELS]]
    if len(many) > LABELS:
        rows = rows.join(F.broadcast(inline_rows(rows.sparkSession, [(k,) for k in learned], "label: string")), "label")
    chars = min(LABEL_CHARS, ALL_CHARS // max(1, len(learned)))
    bounds = {x["label"]: 4 * ROWS_PER_LABEL * (1 << 64) // x["n"] - (1 << 63) for x in many[:LABELS] if x["n"] > 4 * ROWS_PER_LABEL}
    sample, got = _smallest(rows, bounds, chars)
    short = [k for k in bounds if got.get(k, 0) < ROWS_PER_LABEL]
    if short:
        again = rows.join(F.broadcast(inline_rows(rows.sparkSession, [(k,) for k in short], "label: string")), "label")
        sample = [x for x in sample if x[0] not in set(short)] + _smallest(again, {}, chars)[0]
    return sorted(sample)


def _smallest(rows: DataFrame, bounds: dict[str, int], chars: int) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """(label, text) of the ROWS_PER_LABEL distinct texts of the smallest hashes, up to the label's bound if any and to
    ``chars``; and how many texts each label had before that."""
    if bounds:
        small = inline_rows(rows.sparkSession, list(bounds.items()), "label: string, bound: long")
        rows = rows.join(F.broadcast(small), "label", "left").filter("bound is null or h <= bound")
    once = rows.withColumn("copy", F.row_number().over(Window.partitionBy("label", "h").orderBy("text"))).filter("copy = 1")
    top = once.withColumn("turn", F.row_number().over(Window.partitionBy("label").orderBy("h"))).filter(F.col("turn") <= ROWS_PER_LABEL)
    before = Window.partitionBy("label").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    found = top.withColumn("many", F.max("turn").over(Window.partitionBy("label"))).filter(F.col("before") < chars)
    found = found.select("label", "text", "many").collect()
    return [(x["label"], x["text"]) for x in found], {x["label"]: x["many"] for x in found}


class Tagger:
    """The trained network: byte tables and weights, labels in order."""

    def __init__(self, sample: list[tuple[str, str]], seed: int = 3):
        self.labels = sorted({k for k, _ in sample})
        self.weights: dict[str, np.ndarray] = {}
        if self.labels:
            self._train(sample, seed)

    def _train(self, sample: list[tuple[str, str]], seed: int) -> None:
        rng = np.random.default_rng(seed)
        number = {k: i for i, k in enumerate(self.labels)}
        by_label: list[list[np.ndarray]] = [[] for _ in self.labels]
        for k, t in sample:
            by_label[number[k]].append(np.frombuffer(fold_texts([t])[0], np.uint8))
        h, c = HIDDEN, len(self.labels)
        w = {"xf": rng.normal(0, 0.3, (3 * h, 256)), "xb": rng.normal(0, 0.3, (3 * h, 256)), "uf": gru.init(h, rng), "ub": gru.init(h, rng), "o": rng.normal(0, 0.3, (c, 2 * h)), "ob": np.zeros((c, 1))}
        w = {k: v.astype(np.float32) for k, v in w.items()}
        steps, width = TRAIN_LENGTH, TRAIN_WIDTH
        adam = gru.Adam(w, 0.02)
        for step in range(TRAIN_STEPS):
            adam.rate = 0.02 * min(1.0, 2 * (1 - step / TRAIN_STEPS))
            x, mask = np.zeros((steps, width), np.int64), np.zeros((steps, width), np.float32)
            y = rng.integers(0, c, width)
            for j, k in enumerate(y.tolist()):
                t = by_label[k][rng.integers(len(by_label[k]))]
                at = rng.integers(max(1, len(t) - steps + 1))
                part = t[at : at + steps]
                x[: len(part), j], mask[: len(part), j] = part, 1
            sf, cf = gru.forward(w["uf"], lambda t, x=x: w["xf"][:, x[t]], steps, width, mask, keep=True)
            sb, cb = gru.forward(w["ub"], lambda t, x=x: w["xb"][:, x[steps - 1 - t]], steps, width, mask[::-1], keep=True)
            both = np.concatenate([sf, sb[::-1]], axis=1)
            grads, dh = {"o": np.zeros_like(w["o"]), "ob": np.zeros_like(w["ob"])}, np.empty_like(both)
            some = max(1, CELLS // (c * width))
            for at in range(0, steps, some):
                part = both[at : at + some]
                logits = np.einsum("ch,thb->tcb", w["o"], part) + w["ob"]
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[:, y, np.arange(width)] -= 1
                d = (p * mask[at : at + some, None, :] / mask.sum()).astype(np.float32)
                grads["o"] += np.einsum("tcb,thb->ch", d, part)
                grads["ob"] += d.sum(axis=(0, 2))[:, None]
                dh[at : at + some] = np.einsum("ch,tcb->thb", w["o"], d)
            for name, cache, part, order, m in (("f", cf, dh[:, :h], x, mask), ("b", cb, dh[::-1, h:], x[::-1], mask[::-1])):
                du, dg = gru.backward(w["u" + name], cache, part, m)
                seen = order.ravel()
                dx = np.stack([np.bincount(seen, dg[:, j].ravel(), 256) for j in range(3 * h)])
                grads |= {"u" + name: du, "x" + name: dx.astype(np.float32)}
            adam.step(grads)
        self.weights = w

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all positions of each text; zeros for empty ones."""
        c = len(self.labels)
        out = np.zeros((len(texts), c))
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        pieces = -(-sizes // LENGTH)
        total = int(pieces.sum())
        if not total or not c:
            return out
        owner = np.repeat(np.arange(len(texts)), pieces)
        order = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(pieces)])[:-1], pieces)
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1][owner] + order * LENGTH
        length = np.minimum(LENGTH, sizes[owner] - order * LENGTH)
        data = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
        block = max(1, min(GROUP_BYTES // LENGTH, CELLS // c))
        for at in range(0, total, block):  # the pieces of a long text come in blocks too
            part = slice(at, at + block)
            sums = self._sums(data, start[part], length[part])
            for k in range(c):
                out[:, k] += np.bincount(owner[part], sums[k], len(texts))
        return out / np.maximum(1, sizes)[:, None]

    def _sums(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Label probabilities of pieces, summed over their positions."""
        w, c, total = self.weights, len(self.labels), len(start)
        x = np.ascontiguousarray(data[start[None, :] + np.arange(LENGTH)[:, None]]).astype(np.intp)
        mask = (np.arange(LENGTH)[:, None] < length[None, :]).astype(np.float32)
        forward = gru.forward(w["uf"], lambda t: np.take(w["xf"], x[t], axis=1, mode="clip"), LENGTH, total)
        backward = gru.forward(w["ub"], lambda t: np.take(w["xb"], x[LENGTH - 1 - t], axis=1, mode="clip"), LENGTH, total, mask[::-1])
        sums = np.zeros((c, total), np.float32)
        for t in range(LENGTH):
            p = w["o"] @ np.concatenate([forward[t], backward[LENGTH - 1 - t]]) + w["ob"]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= mask[t] / p.sum(axis=0)
            sums += p
        return sums


def predict(docs: DataFrame, tagger: Tagger, carry: list[Column]) -> DataFrame:
    """``carry`` columns with lang_pred and score. A text that is null or has no letter is undetermined with score 0, and
    so is every text where no label was learned."""
    held = docs.sparkSession.sparkContext.broadcast((tagger.labels, tagger.weights))
    rows = docs.select(F.struct(*carry).alias("row"), F.when(F.col("text").rlike(LETTER), F.col("text")).alias("text"))
    arrow = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger([])
        model.labels, model.weights = held.value
        for batch in batches:
            for lo, hi, texts in folded_slices(batch.column(1), GROUP_BYTES):
                p = model.probabilities(texts)
                best = p.argmax(axis=1) if p.shape[1] else np.zeros(hi - lo, np.int64)
                names = [model.labels[b] if t and model.labels else UNDETERMINED for b, t in zip(best.tolist(), texts, strict=True)]
                score = p[np.arange(hi - lo), best] if p.shape[1] else np.zeros(hi - lo)
                score = np.clip(score, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names), pa.array(score)], schema=pa.schema([batch.schema.field(0), *arrow]))

    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    return id_crc(doc_id) % FOLDS == HELD_FOLD


def train(docs: DataFrame) -> Tagger:
    """A tagger from the labelled rows outside the held-out fold. Rows without a language or text teach nothing."""
    return Tagger(training_sample(docs.filter(~held_out(F.col("doc_id"))), F.col("lang"), F.col("text")))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. An empty table gives no rows."""
    return predict(docs, train(docs), [F.col("doc_id").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out")])


def keep_identified(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """The rows of ``docs`` in one language, with all their columns: those whose predicted language has a score of at least
    ``sure``. Null and letterless texts are undetermined and go; where no label was learned nothing is known of the
    others, which stay. The stored text alone decides, so repeated rows fare alike."""
    tagger = train(docs)
    found = predict(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), tagger, [F.col("_row").alias("_row")])
    known = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= sure) if tagger.labels else F.col("_row.text").rlike(LETTER)
    return found.filter(known).select("_row.*")
