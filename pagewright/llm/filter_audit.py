"""Filter interaction audit: what each of five text filters removes, alone, in every order, and on average over all orders.

Words are exploded and aggregated by (document, word), then by document for totals and distincts; the other flags are
outer-joined to these. A row's failures are five bits, so 32 conditional counts for each part say all there is to know:
every order and step is a sum of some of them.

A: under ``MIN_WORDS`` words. B: 100 * distinct words < ``MIN_DISTINCT`` * words. C: 100 * [A-Z] > ``MAX_UPPER`` * code
points. D: holds any of ``SIGNS``. E: equal to the text of a smaller doc_id, removed or not.

Nulls: a null text is empty, a null lang is the part ''. A null doc_id is neither smaller nor larger than any other, so its
row never fails E and makes none fail, and it has no labels. Of several labels of a doc_id one of 1 is enough. Repeated
rows count as often as they stand. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3
SIGNS = "#$%&*|"
SPACES = r"[\x20\x09-\x0D]+"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
#: Characters of text whose words one task aggregates about, so that its hash map stays small, and tasks at most.
TASK_CHARS, MAX_TASKS = 1 << 22, 1 << 16


def word_totals(texts: DataFrame, chars: int) -> DataFrame:
    """(doc_id, h, total, distinct) of rows (doc_id, h, text) of so many characters: words of all rows of the key, so that
    repeated rows count each; wordless texts are absent. Texts go to their key once, and both aggregations run there."""
    fewest = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = texts.repartition(min(MAX_TASKS, max(fewest, chars // TASK_CHARS)), "doc_id", "h")
    words = placed.select("doc_id", "h", F.explode(F.split("text", SPACES)).alias("word")).filter("word <> ''")
    counted = words.groupBy("doc_id", "h", "word").agg(F.count(F.lit(1)).alias("times"))
    return counted.groupBy("doc_id", "h").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("distinct"))


def _failures() -> Column:
    """The bits of a row's failures, from total, distinct, upper, points, signs, repeats."""
    fails = [F.col("total") < MIN_WORDS, 100 * F.col("distinct") < MIN_DISTINCT * F.col("total"), 100 * F.col("upper") > MAX_UPPER * F.col("points"), F.col("signs"), F.col("repeats")]
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3] + bits[4]


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): part, fails (bit i: filter i of ``FILTERS``), good, toxic."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h"))
    points = F.length("text")
    flags = base.select(
        "doc_id", "part", "h", F.unhex(F.sha2("text", 256)).alias("sha"), points.alias("points"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("upper"), F.col("text").rlike(f"[{SIGNS}]").alias("signs"),
    )
    flags = Table(flags, "flags").read()
    # one row of each text's smallest id: joined by id and text, so that a group of copies meets no single key
    first = flags.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    rows = flags.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    chars = flags.agg(F.sum("points")).first()[0] or 0
    totals = word_totals(base.select("doc_id", "h", "text"), chars).withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))
    totals = rows.join(totals, same, "left").select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), *[F.expr(f"coalesce({c}, 0)").alias(c) for c in ("total", "distinct")], "rows")
    marked = flags.join(first.withColumn("first", F.lit(True)), ["doc_id", "sha"], "left")
    # without an id no row repeats; with one, all but those of the smallest id do
    marked = marked.withColumn("repeats", F.col("doc_id").isNotNull() & F.col("first").isNull()).drop("first", "sha")
    known = marked.join(totals, same, "left").withColumn("total", F.expr("total div rows")).drop("_doc", "_h", "rows")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    known = known.join(marks, "doc_id", "left")
    return known.select("part", _failures().alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _steps() -> Column:
    """The steps of all orders as an array: order, step, the bit of the step's filter and the bits of those before it."""
    rows = []
    for order in ORDERS:
        bits = [1 << FILTERS.index(f) for f in order]
        rows += [{"filter_order": order, "step": i + 1, "own": bits[i], "before": sum(bits[:i])} for i in range(len(bits))]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, own: int, before: int>>")


def _summed(counts: str, wanted: Callable[[Column], Column]) -> Column:
    """The sum of the counts of all masks that are wanted."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(wanted(m), F.get(counts, m)).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley."""
    found = document_failures(docs, labels)
    # counted once by mask first: the conditional counts then read at most 128 rows of each part
    found = found.groupBy("part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    kinds = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counted = found.groupBy("part").agg(*[F.sum(F.when((F.col("fails") == m) & kind, F.col("n")).otherwise(0)).alias(f"{name}{m}") for name, kind in kinds.items() for m in range(MASKS)])
    counts = counted.select("part", *[F.array(*[f"{name}{m}" for m in range(MASKS)]).alias(name) for name in kinds])
    steps = counts.select("*", F.inline(_steps()))
    has = lambda m: m.bitwiseAND(F.col("own")) != 0
    clear = lambda m: m.bitwiseAND(F.col("before")) == 0
    removed = lambda m: has(m) & clear(m)
    # a row that fails k filters is removed by each of them in one of k orders
    share = F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(has(m), F.get("every", m) * (len(ORDERS) / F.bit_count(m)).cast("int")).otherwise(0))
    return steps.select(
        "part", "filter_order", "step",
        _summed("every", lambda m: clear(m) & ~has(m)).alias("kept"), _summed("every", removed).alias("removed"), _summed("every", lambda m: has(m) & ~clear(m)).alias("redundant"),
        _summed("every", lambda m: m == F.col("own")).alias("unique_fails"), _summed("good", removed).alias("good_lost"), _summed("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM d LEFT JOIN l USING (doc_id)),
long AS (SELECT part, row_number() OVER () AS id, good, toxic, [CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END] AS fails FROM f),
n AS MATERIALIZED (SELECT part, list_filter(fails, lambda x: x IS NOT NULL) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM long GROUP BY 1, 2),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, i::INTEGER AS step, o[i] AS own, o[:i - 1] AS before FROM orders, range(1, 6) r(i)),
s AS (SELECT part, o, step, own, list_contains(fails, own) AS has, len(list_filter(fails, lambda z: contains(before, z))) > 0 AS gone, len(fails) AS k, n, good, toxic FROM n, steps),
by_step AS (SELECT part, o AS filter_order, step, own, sum(CASE WHEN NOT has AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN has AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN has AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN has AND k = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN has AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN has AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM by_step
"""
