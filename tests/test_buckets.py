import os

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pagewright.operators import buckets

KIND = StructType([StructField("id", StringType()), StructField("n", LongType()), StructField("owner", StringType())])


def _store(spark, path, **more):
    return buckets.Store(spark, f"file://{path}/s", {"a": (KIND, ["id"]), "b": (KIND, ["id", "n"])}, buckets=4, **more)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_upserts_and_deletes_equal_a_dict(spark, tmp_path):
    """Commits of changes, repeats, a null key and deletes, with rewrites of full buckets in between."""
    store, want = _store(spark, tmp_path), {}
    for turn in range(8):
        with store.commit() as change:
            new = [(None if i % 11 == 0 else f"k{(i * (turn + 3)) % 40}", turn * 100 + i, f"o{i % 3}") for i in range(15)]
            change.upsert("a", spark.createDataFrame([(*r, s) for s, r in enumerate(new)], "id string, n long, owner string, _seq int"))
            want |= {r[0]: r for r in new}
            gone = [f"k{(turn * 7 + i) % 40}" for i in range(4)] + ["absent"]
            change.delete("a", spark.createDataFrame([(g,) for g in gone], "id string"))
            for g in gone:
                want.pop(g, None)
        if turn % 4 == 3:
            assert _rows(store.read("a")) == sorted(want.values(), key=str)
    assert max(sum(b in g["buckets"] for g in store.manifest()["tables"]["a"]) for b in range(4)) <= buckets.MAX_GENERATIONS
    with store.commit() as change:
        change.delete("a", spark.createDataFrame([("o1",)], "owner string"))
    assert _rows(store.read("a")) == sorted((r for r in want.values() if r[2] != "o1"), key=str)
    assert _rows(store.read("b")) == []


def test_a_commit_over_two_tables_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = _store(spark, tmp_path)
    first = spark.createDataFrame([("x", 1, "o")], KIND)
    with store.commit() as change:
        change.upsert("a", first)
        change.upsert("b", first)
    with pytest.raises(ZeroDivisionError), store.commit() as change:
        change.upsert("a", spark.createDataFrame([("y", 2, "o")], KIND))
        raise ZeroDivisionError
    assert _rows(store.read("a")) == _rows(store.read("b")) == [("x", 1, "o")]
    orphans = store.vacuum()
    assert len(orphans) == 1 and orphans[0].startswith("a/")
    assert store.vacuum() == [] and _rows(store.read("a")) == [("x", 1, "o")]


def test_a_reader_keeps_its_commit_and_the_second_writer_fails(spark, tmp_path):
    store = _store(spark, tmp_path)
    with store.commit() as change:
        change.upsert("a", spark.createDataFrame([("x", 1, "o")], KIND))
    seen = store.read("a")
    with pytest.raises(buckets.Conflict), store.commit() as late:
        with store.commit() as change:
            change.upsert("a", spark.createDataFrame([("x", 2, "o")], KIND))
        late.upsert("a", spark.createDataFrame([("x", 3, "o")], KIND))
    assert _rows(seen) == [("x", 1, "o")] and _rows(store.read("a")) == [("x", 2, "o")]


def test_a_dead_writer_blocks_no_one_after_vacuum(spark, tmp_path):
    store = _store(spark, tmp_path)
    rows = spark.createDataFrame([("x", 1, "o")], KIND)
    os.makedirs(tmp_path / "s" / "commits")
    (tmp_path / "s" / "commits" / "000000000001.lock").touch()
    with pytest.raises(buckets.Conflict), store.commit() as change:
        change.upsert("a", rows)
    assert store.read("a").count() == 0
    store.vacuum()
    with store.commit() as change:
        change.upsert("a", rows)
    assert _rows(store.read("a")) == [("x", 1, "o")]


def test_changes_of_one_percent_write_little_and_lookups_read_few_buckets(spark, tmp_path):
    store = buckets.Store(spark, f"file://{tmp_path}/s", {"a": (KIND, ["id"])}, buckets=32)
    rows = spark.range(200_000).selectExpr("cast(id as string) id", "id n", "sha2(cast(id as string), 256) owner")
    with store.commit() as change:
        change.upsert("a", rows)
    before = _size(tmp_path)
    with store.commit() as change:
        change.upsert("a", rows.filter("n % 100 = 7").selectExpr("id", "-n n", "owner"))
    assert _size(tmp_path) - before < 0.05 * before
    assert store.read("a").filter("n < 0").count() == 2000 and store.read("a").count() == 200_000
    found = store.lookup("a", spark.createDataFrame([("107",), ("108",), ("nope",)], "id string"))
    assert _rows(found.select("id", "n")) == [("107", -107), ("108", 108)]
    read = {f.rsplit("_bucket=", 1)[1].split("/")[0] for f in found.inputFiles()}
    assert len(read) <= 3
