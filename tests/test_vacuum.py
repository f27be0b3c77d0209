import pytest

from pagewright.operators import search
from pagewright.streaming import ingest


def test_orphans_of_a_failed_batch_are_hidden_and_removed(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    (source / "a.md").write_text("# One\n\nStones are grey, mostly.\n")
    ingest.ingest_files(spark, f"file://{source}", target)
    before = ingest.live(spark, target, "vectors").count()
    assert before and ingest.vacuum(spark, target) == []

    def fail(*_):
        raise OSError("the store is away")

    (source / "a.md").write_text("# Two\n\nRivers run on.\n")
    with monkeypatch.context() as m:
        m.setattr(search, "postings", fail)
        with pytest.raises(OSError, match="away"):
            ingest.ingest_files(spark, f"file://{source}", target)
    assert ingest.live(spark, target, "vectors").count() == before
    gone = ingest.vacuum(spark, target)
    assert {g.split("/")[0] for g in gone} == {"texts", "chunks", "vectors", "keywords"}
    assert ingest.live(spark, target, "chunks").count() == before

    ingest.ingest_files(spark, f"file://{source}", target)
    gone = ingest.vacuum(spark, target)
    assert {g.split("/")[0] for g in gone} == set(ingest.BATCHED)
    assert [h.text for h in ingest.live(spark, target, "texts").collect()] == ["Rivers run on."]
