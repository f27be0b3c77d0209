"""Nulls, empty tables, repeated rows, clashing names, string ids, damaged and hostile input of the corpus operators."""

import hashlib
import os
import random
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import chosen_path, common, decontam, html_tree, langid, packing, ppm, radix_dedup, sharding, warc
from pagewright.llm.bytewords import fold_texts

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, _row string, rid long, _rid long, shard int, slot int, h long, digit string, place long"


def _clashing(spark, texts, ids=None):
    rows = [(i, t, "en", "s", 1, "a", "b", 7, 8, 3, 4, 9, "d", 5) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, CLASHING)


def _prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    base = [_prose(rng, 60, words) for _ in range(12)]
    item = _prose(rng, 20, words)
    texts = base + [base[0].upper(), base[1], base[2] + " tail", base[3].replace(" ", ", ", 4)] + [f"{item} and {base[4][:40]}", None, "", "  ", "12 34", "short text"]
    return texts, item


def _grams(text):
    w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_pipeline_stage_by_stage(spark, corpus, tmp_path):
    texts, item = corpus
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 3
    docs = _clashing(spark, [t for _, t in rows], [i for i, _ in rows])
    want = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    expected = {"language_id": Counter(want)}
    best = {}
    for i, t in want:
        best[t.lower()] = max(best.get(t.lower(), -1), i)
    want = [(i, texts[i]) for i in best.values()]
    expected["exact_dedup"] = Counter(want)
    root = {i: i for i, _ in want}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, t in want:
        for j, u in want:
            a, b = _grams(t), _grams(u)
            if i < j and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = [(i, t) for i, t in want if find(i) == i]
    expected["ngram_jaccard_join"] = Counter(want)
    windows = {" ".join(item.split()[k : k + 13]) for k in range(8)}
    want = [(i, t) for i, t in want if not any(w in t for w in windows)]
    expected["decontamination"] = Counter(want)
    assert len({sum(c.values()) for c in expected.values()}) == 4  # every stage drops something
    found = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, found, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        found = spark.read.parquet(f"{tmp_path}/{k}")
        assert found.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in found.collect()) == expected[name], name
        assert found.filter("rid = 7 and _rid = 8 and shard = 3 and row = 'a'").count() == found.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, found, str(tmp_path))
    assert sorted(r.doc_id for r in packed.collect()) == sorted(i for i, _ in want)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _clashing(spark, ["a"]).filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_string_ids_and_repeated_rows(spark, corpus):
    texts, item = corpus
    ids = [f"id-{i:02d}" for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)] + [(ids[5], texts[5])] * 2 + [(None, texts[6])] * 2, "doc_id string, text string")
    n = docs.count()
    exact = radix_dedup.exact_duplicates(docs).collect()
    assert len(exact) == n and sum(r.kept for r in exact) == len({(t or "").lower() for t in texts})
    assert {r.keep_id for r in exact if r.text_sha256 == hashlib.sha256(texts[6].encode()).hexdigest()} == {"id-06"}
    near = chosen_path.near_duplicates(docs).collect()
    assert len(near) == n and {r.class_id for r in near if r.doc_id in ("id-01", "id-13")} == {"id-01"}
    assert {r.n_copies for r in near if r.doc_id == "id-05"} == {3}
    kept = Counter(r.doc_id for r in chosen_path.drop_near_duplicates(docs).collect())
    assert kept["id-05"] == 1 and kept[None] == 1 and kept["id-06"] == 0 and kept["id-17"] == kept["id-18"] == 1
    bench = spark.createDataFrame([("x", item)], "item_id string, text string")
    hits = decontam.contaminated_documents(docs, bench).collect()
    assert len(hits) == n and [r.doc_id for r in hits if r.contaminated] == ["id-16"]
    assert decontam.drop_contaminated(docs, bench).count() == n - 1
    pieces = packing.pack_documents(docs).collect()
    assert Counter(r.doc_id for r in pieces) == Counter(r.doc_id for r in exact)
    scored = ppm.score_documents(docs).collect()
    assert len(scored) == n and all(r.held_out == (zlib.crc32((r.doc_id or "").encode()) % 10 == 0) for r in scored)


def test_links_are_found_in_deep_recursions(spark, monkeypatch):
    """Pairs of a similarity of 0.80 to 0.85 among texts that share most grams with many others, small buckets."""
    monkeypatch.setattr(chosen_path, "BUCKET", 8)
    rng = random.Random(5)
    texts, links = [], 0
    shared = [f"s{i}" for i in range(70)]
    for p in range(150):
        own = [f"p{p}x{i}" for i in range(60)]
        texts += [" ".join(shared + own), " ".join(shared[rng.randrange(6, 9) :] + own + [f"q{p}y{i}" for i in range(rng.randrange(17, 22))])]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [_grams(t) for t in texts]
    found = 0
    for i in range(0, len(texts), 2):
        s = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])
        if s >= 0.8:
            links += 1
            assert s < 0.85
            found += got[i].class_id == got[i + 1].class_id
    assert links >= 75 and found >= 0.98 * links


def test_filter_lets_all_keys_through(spark, monkeypatch):
    monkeypatch.setattr(common, "BITS_A_KEY", 1)
    keys = spark.range(0, 3000, 3).selectExpr("id as k")
    maybe, surely = common.MaybeIn(keys, "k").split(spark.range(3000), F.col("id"))
    through = {r.id for r in maybe.collect()}
    assert {r.id for r in surely.collect()} == set(range(3000)) - through and set(range(0, 3000, 3)) <= through


def test_shared_folder_without_settings(tmp_path):
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "from pagewright.llm.common import Table, shared_dir\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "a = shared_dir(s); assert a == shared_dir(s), a\n"
        "assert Table(s.range(3), 't').read().count() == 3\n"
        "s.sparkContext.setCheckpointDir('%s/own'); assert '/own/' in shared_dir(s) + '/', shared_dir(s)\n"
    ) % (os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), tmp_path)
    (tmp_path / "conf").mkdir()
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf")}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_damaged_archives_raise(spark, tmp_path):
    body = os.urandom(200_000).hex()
    member = warc.encode_record("response", "urn:page:1", "u", "2024-01-01T00:00:00Z", body.encode(), len(body), hashlib.sha256(body.encode()).hexdigest(), None)
    for name, data in (("cut", member[: len(member) // 2]), ("length", zlib.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\n", wbits=31))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(data)
        with pytest.raises(Exception, match="ends within|malformed"):
            warc.read_archive(spark, f"file://{tmp_path}/{name}").collect()


def test_predicates_on_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://{i}/", "x" * 200 * i, "extra") for i in (1, 2, 2, 3)], "page_id long, url string, html string, record_type string")
    warc.archive_pages(pages, f"file://{tmp_path}/w")
    back = warc.read_archive(spark, f"file://{tmp_path}/w")
    for test, n in (("record_type <> 'warcinfo'", 4), ("record_type not in ('warcinfo')", 4), ("uri = 'http://2/' or uri = 'http://1/'", 3), ("refers_to is null and record_type = 'response'", 4), ("not (uri like 'http://3%') and uri is not null", 3)):
        assert back.filter(test).count() == n, test
    assert sorted(r.page_id for r in warc.roundtrip(pages).collect()) == [1, 2, 2, 3]


def test_hostile_pages_take_linear_time(spark):
    for part in ("<a '", '<a "', "<!x", "</x>", "<div></q>", "<a '>\""):
        start = time.time()
        html_tree.Page(part * 30_000)
        assert time.time() - start < 10, part
    pages = spark.createDataFrame([(1, "u", "<article><p>Words here, and more of them to read.</p></article>", "t")] * 2, "page_id long, url string, html string, text string")
    assert [r.n_chars for r in html_tree.extract(pages).collect()] == [37, 37]
    assert html_tree.extract(pages.filter("false")).count() == 0


def test_long_runs_are_tokenised():
    e = packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    for text in (" " * 2_000_000, "x" * 2_000_000, "\n" * 2_000_000, "a " * 400_000):
        assert e.ids(text).tolist() == [*e.full.encode(text, add_special_tokens=False).ids, 0]


def test_long_texts_in_blocks(monkeypatch):
    rng = random.Random(3)
    sample = [("en", _prose(rng, 40, ["the", "thing", "ation"])) for _ in range(8)] + [("es", _prose(rng, 40, ["él", "ción", "que"])) for _ in range(8)]
    monkeypatch.setattr(langid, "TRAIN_STEPS", 20)
    model = langid.Tagger(sample)
    texts = fold_texts([_prose(rng, 3000, ["the", "él", "thing"]), "the", ""])
    whole = model.probabilities(texts)
    monkeypatch.setattr(langid, "GROUP_BYTES", 1024)
    assert np.allclose(whole, model.probabilities(texts), atol=1e-6)
    text = fold_texts([_prose(rng, 500, ["ab", "ö"])])[0]
    assert np.concatenate(list(ppm.long_grams(text, 7))).tolist() == ppm.grams([text])[0].tolist()


def test_sharding_edges(spark, tmp_path):
    docs = _clashing(spark, ["a", None, "", "a"] * 10)
    rows = sharding.shard_documents(docs).collect()
    assert Counter(r.shard for r in rows) == Counter({s: 5 for s in range(8)}) and {r.size for r in rows} == {1, 2}
    assert sharding.shard_documents(docs.filter("false")).count() == 0
    sharding.write_shards(docs, f"{tmp_path}/s", 4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert set(back.columns) == {*docs.columns, "_shard", "_slot"} and back.filter("shard = 3 and slot = 4 and _rid = 8").count() == 40
    assert sorted(r._slot for r in back.filter("_shard = 2").collect()) == list(range(10))
