import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.operators import chunking
from pagewright.operators.markdown import parse_blocks

MD = "# Title\n\nintro\n\n<!-- page: 12 -->\n\n## Lock\n\nbody one\n\n- a\n- b\n\n```py\nx = 1\n```\n\n| a | b |\n| - | - |\n| 1 | 2 |\n\n---\n\n> said\n\n<div>raw</div>\n\nUnder\n===\n"


def test_ids(spark):
    row = spark.range(1).select(scalars.stable_chunk_id(F.lit("redis"), F.lit(3)).alias("c"), scalars.point_id(F.lit("redis:000003")).alias("p")).first()
    assert row.c == "redis:000003"
    assert row.p == str(uuid.uuid5(uuid.NAMESPACE_URL, "redis:000003"))


def test_normalise(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(scalars.l2_normalise(F.col("v")).alias("v")).collect()
    assert [r.v for r in rows] == [[0.6, 0.8], [0.0, 0.0]]


def test_blocks():
    got = [(b.kind, b.level, b.page) for b in parse_blocks(MD)]
    assert got == [("heading", 1, None), ("paragraph", 0, None), ("page_marker", 0, 12), ("heading", 2, None), ("paragraph", 0, None), ("list", 0, None), ("code", 0, None), ("table", 0, None), ("hr", 0, None), ("blockquote", 0, None), ("other", 0, None), ("heading", 1, None)]


def test_sections_and_pages():
    assert chunking.chunk_markdown("start\n\n## First\n\none\n\n## Second\n\ntwo") == [("start", None, None), ("one", "First", None), ("two", "Second", None)]
    # a page marker relabels text that is still held
    assert chunking.chunk_markdown("<!-- page: 1 -->\n\nearly\n\n<!-- page: 2 -->\n\n## Next\n\nlate") == [("early", None, 2), ("late", "Next", 2)]


def test_sentences_match_column_form(spark):
    assert chunking.sentences("A.\n\nB.") == ["A.", "B."]
    assert chunking.sentences("!。") == ["!", "。"]
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab .!?。．\n 　锁") for _ in range(40)) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.sentence_units(F.col("t")).alias("u")).collect()
    assert all(r.u == chunking.sentences(r.t) for r in got)


def test_sentences_of_long_runs_take_time_in_proportion(spark):
    made = {"gap": "a" + " " * 60_000 + "b. c" + " \u3000\x85" * 20_000, "marks": "a" + "." * 60_000 + "b. c", "plain": "one two " * 40_000 + "three. four"}
    rows = spark.createDataFrame([(k, v) for k, v in made.items()], "k string, t string")
    began = time.monotonic()
    got = {r.k: r.u for r in rows.select("k", scalars.sentence_units(F.col("t")).alias("u")).collect()}
    assert time.monotonic() - began < 15
    assert got == {"gap": ["a" + " " * 60_000 + "b.", " c"], "marks": ["a" + "." * 60_000 + "b.", " c"], "plain": ["one two " * 40_000 + "three.", " four"]}
    edges = "".join(f"{c}x{c}\n{c}\n" for c in scalars.SPACES)
    assert spark.range(1).select(scalars.sentence_units(F.lit(edges)).alias("u")).first().u == chunking.sentences(edges)


def test_windows_stay_in_budget_and_cover():
    text = "word " * 400
    parts = chunking.split_windows(text, 30, 8)
    assert all(chunking.count_tokens(p) <= 30 for p in parts) and len(parts) > 5
    at = 0
    for p in parts:
        found = text.find(p, max(0, at - 4 * 9))
        assert found <= at
        at = found + len(p)
    assert at == len(text)
    assert chunking.split_windows("x" * 320, 12, 2)[0] == "x" * 48
    with pytest.raises(ValueError):
        chunking.check_budget(8, 8)


def test_chunk_table(spark):
    docs = spark.createDataFrame([("d", "t", MD), ("e", "t", None), ("f", "t", "")], "document_id string, title string, markdown string")
    rows = chunking.chunk_documents(docs, 30, 4).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == [f"d:{i:06d}" for i in range(1, len(rows) + 1)]
    assert all(r.checksum and r.token_count > 0 for r in rows)
    assert chunking.chunk_documents(docs.filter("false")).count() == 0
