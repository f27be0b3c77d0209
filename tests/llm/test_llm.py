import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import chosen_path, decontam, html_tree, langid, packing, ppm, radix_dedup, sharding, toxicity, warc
from pagewright.llm.bytewords import TERM, fold_texts, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digit string, rid string"


def _docs(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def _prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(1)
    base = [_prose(rng, 80, [f"w{i}" for i in range(500)]) for _ in range(20)]
    near = [b.replace("w1", "v1", 2) for b in base[:5]]
    return base + near + base[:6] + [base[0].upper(), None, "", "  ", "one two", "One Two", "x" * 70_000, "x" * 70_000 + "y", None]


def test_exact_dedup(spark, mixed):
    got = {r.doc_id: r for r in radix_dedup.exact_duplicates(_docs(spark, mixed)).collect()}
    groups = {}
    for i, t in enumerate(mixed):
        groups.setdefault(fold_texts([t])[0], []).append(i)
    assert len(got) == len(mixed)
    for body, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(body).hexdigest())
    docs = _docs(spark, mixed)
    kept = radix_dedup.drop_exact_duplicates(docs.unionByName(docs))
    assert kept.count() == len(groups) and kept.columns == docs.columns
    assert radix_dedup.exact_duplicates(docs.filter("false")).count() == 0


def test_near_duplicates(spark, mixed):
    def grams(t):
        w = [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for t in mixed]
    classes = {s for s in sets if s}
    links = {s: sum(1 for o in classes if o != s and len(s & o) / len(s | o) >= 0.8) for s in classes}
    got = {r.doc_id: r for r in chosen_path.near_duplicates(_docs(spark, mixed)).collect()}
    for i, s in enumerate(sets):
        assert got[i].n_links == (links[s] if s else 0)
        assert got[i].n_copies == (sets.count(s) if s else 1)
    assert chosen_path.near_duplicates(_docs(spark, mixed).filter("false")).count() == 0


def test_a_block_without_rows_counts_no_link_twice():
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, 0, high, 0, i, f"{text} {i}") for high in (0, 1) for i in (5, 6)]  # block 1 of the group got no row
    names = ["root", "low", "high", "block", "id", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    got = Counter()
    for part in chosen_path._exact(0.8)(iter([batch])):
        for r in part.to_pylist():
            if r["id"] is not None:
                got[r["id"]] += r["links"]
    assert got == {5: 1, 6: 1}


def test_a_similarity_of_just_the_threshold_is_a_link():
    words = [f"w{i}" for i in range(400)]
    for extra in range(1, 40):  # sets of 4 e and 5 e grams, the smaller within the larger
        rows = [(1, 0, 0, 0, i, " ".join(words[: n + 4])) for i, n in ((5, 4 * extra), (6, 5 * extra), (7, 5 * extra + 1))]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["root", "low", "high", "block", "id", "text"])
        found = [r for part in chosen_path._exact(0.8)(iter([batch])) for r in part.to_pylist()]
        want = {5: 1, 6: 1 + (5 * extra >= 0.8 * (5 * extra + 1)), 7: int(5 * extra >= 0.8 * (5 * extra + 1))}
        assert {r["id"]: r["links"] for r in found if r["id"] is not None} == want


def test_classes_without_counts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    texts = []
    for g in range(3):  # chains: each text differs from the one before in one word, or in two that are not linked then
        w = [f"g{g}w{i}" for i in range(90)]
        for i in range(30 + 30 * g):
            for _ in range(1 + (rng.random() < 0.15)):
                w[rng.randrange(90)] = f"g{g}n{rng.random()}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    monkeypatch.setattr(chosen_path, "BLOCK", 7)
    docs = _docs(spark, texts)
    sets, links = [chosen_path.shingles(fold_texts([t]))[0] for t in texts], []
    for i, a in enumerate(sets):
        links += [(i, j) for j in range(i) if 9 * len(np.intersect1d(a, sets[j])) >= 4 * (len(a) + len(sets[j]))]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    got = chosen_path.similar_classes(docs, count_links=False).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (r, None) for i, r in enumerate(root)} and 3 < len(set(root)) < len(texts)


def test_large_near_group_is_split_by_pivots(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        texts.append(" ".join(w))
    monkeypatch.setattr(chosen_path, "BUCKET", 10)
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    got = chosen_path.near_duplicates(_docs(spark, texts)).collect()
    assert {r.class_id for r in got} == {0}
    assert {r.n_links for r in got} == {59}


def test_links_survive_splits_below_the_root():
    rng, pairs = np.random.default_rng(1), 100_000
    a = rng.integers(1 << 32, size=(pairs, chosen_path.COORDS), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, ~a)
    left = np.arange(pairs)
    for run in range(chosen_path.runs_for(chosen_path.RECALL, 0.8)):
        rows = left[a[left, run] == b[left, run]]
        paths = rng.integers(1 << 62, size=len(rows))
        for depth in range(chosen_path.DEPTH):
            both = []
            for c in range(chosen_path.FIRST if not depth else 2):
                has = np.ones(len(rows), bool) if not depth or not c else chosen_path._seconds(paths)
                p = chosen_path._step(paths[has], a[rows[has]], c)
                both.append((rows[has], p, chosen_path._step(paths[has], b[rows[has]], c) == p))
            rows, paths = np.concatenate([r[same] for r, _, same in both]), np.concatenate([p[same] for _, p, same in both])
        left = np.setdiff1d(left, rows)
    assert len(left) <= 15  # 10 at the promised recall


def test_pivots_keep_links_in_spite_of_sketch_noise():
    rng = np.random.default_rng(2)
    lost = 0
    for _ in range(8):
        pivot, x = (rng.integers(1 << 32, size=(5000, chosen_path.MINWISE), dtype=np.uint32) for _ in range(2))
        kind = rng.random(pivot.shape)
        x = np.where(kind < 0.8, pivot, x)
        y = np.where((kind >= 0.6) & (kind < 0.8), ~pivot, x)
        p, x, y = (chosen_path.sketch_bits(v) for v in (pivot, x, y))
        lost += int(((chosen_path.similarity(x, p) >= chosen_path.INNER) & (chosen_path.similarity(y, p) < chosen_path.OUTER)).sum())
    assert lost <= 4  # of 40,000


def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(40)]
    items = [_prose(rng, 30, words), "short item", None, ""]
    texts = [_prose(rng, 60, words) + " " + items[0] + " end", "a short item, here", "clean text", None, "", items[0].upper()]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    docs = _docs(spark, texts)
    for block in (200_000, 10):
        decontam.BLOCK_WINDOWS = block
        got = {r.doc_id: r for r in decontam.contaminated_documents(docs, bench).collect()}
        for i, t in enumerate(texts):
            w = fold_texts([t])[0].decode().replace(",", "").split()
            hit, found = set(), set()
            for item, b in enumerate(items):
                b = (b or "").split()
                for k in range(max(0, len(b) - min(13, len(b)) + 1) if b else 0):
                    win = b[k : k + min(13, len(b))]
                    for p in range(len(w) - len(win) + 1):
                        if w[p : p + len(win)] == win:
                            hit |= set(range(p, p + len(win)))
                            found.add(str(item))
            assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), len(hit), len(found))
            assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert got[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    decontam.BLOCK_WINDOWS = 200_000
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns
    index = decontam.build_index(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"))
    assert {r.doc_id for r in decontam.proximity_matches(index, [("p", "item short")], 3).collect()} == {"1"}


def test_sharding(spark):
    docs = _docs(spark, ["é" * (i % 5) for i in range(203)])
    rows = sharding.shard_documents(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.size == 2 * (r.doc_id % 5) + 1 and r.text_crc32 == zlib.crc32(("é" * (r.doc_id % 5)).encode())
    assert sorted(map(len, by.values())) == [25] * 5 + [26] * 3
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    matrix = sharding.communication_matrix([100, 50, 70], [74, 73, 73], 5)
    assert [sum(r) for r in matrix] == [100, 50, 70] and [sum(c) for c in zip(*matrix, strict=True)] == [74, 73, 73]
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 300, 700, 200) for _ in range(4000)]
    assert abs(np.mean(draws) - 60) < 0.5 and abs(np.var(draws) - 200 * 0.3 * 0.7 * 800 / 999) < 2.5


def test_warc(spark, tmp_path):
    big = "<p>" + "ä" * 200
    pages = spark.createDataFrame([(5, "http://a/", big), (3, "http://b/", big), (1, "u", "x"), (2, "u", "x"), (4, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.roundtrip(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 1: ("response", None), 2: ("response", None), 4: ("response", None)}
    assert all(got[k].payload_bytes == 403 and got[k].payload_digest == hashlib.sha256(big.encode()).hexdigest() for k in (3, 5))
    warc.archive_pages(pages, f"file://{tmp_path}/w")
    back = warc.read_archive(spark, f"file://{tmp_path}/w").filter("record_type = 'response' and uri like 'http://b%'").collect()
    assert [bytes(r.payload) for r in back] == [big.encode()]
    assert warc.roundtrip(pages.filter("false")).count() == 0


def test_warc_hands_back_other_filters(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    warc.archive_pages(pages, f"file://{tmp_path}/w")
    kinds = warc.read_archive(spark, f"file://{tmp_path}/w").filter("record_type <> 'warcinfo'").select("record_type").collect()
    assert "response" in {r.record_type for r in kinds} and "warcinfo" not in {r.record_type for r in kinds}


def test_packing(spark):
    texts = ["a b c", None, "", "word " * 5000, "<|endoftext|> x"] + [f"some text {i} " * (i % 90) for i in range(200)]
    rows = packing.pack_documents(_docs(spark, texts)).collect()
    encoder = packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    seqs, pieces = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for i, t in enumerate(texts):
        ids = encoder.full.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert r.length == 2048 or r.piece == 0
    assert packing.pack_documents(_docs(spark, texts).filter("false")).count() == 0


def test_best_fit_plan_equals_one_by_one():
    rng = random.Random(4)
    counts = Counter(rng.randint(1, 60) for _ in range(400))
    free = []
    for n in sorted(counts.elements(), reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(60 - n)
    plan = packing.best_fit_plan(dict(counts), 60)
    bins = {s + j for _, lo, hi, s, q, _ in plan for j in range(-(-(hi - lo) // q))}
    assert len(bins) == len(free)


def test_language_id(spark):
    rng = random.Random(5)
    texts, langs = [], []
    for i in range(120):
        texts.append(_prose(rng, 30, ["the", "thing", "ation", "ing"]) if i % 2 else _prose(rng, 30, ["él", "ción", "señor", "que"]))
        langs.append("en" if i % 2 else "es")
    docs = _docs(spark, texts + [None, "", "12 34"], langs + ["en"] * 3)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert np.mean([got[i].lang_pred == langs[i] for i in range(120)]) > 0.98
    assert [got[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert langid.keep_identified(docs).count() == 120
    assert langid.identify(docs.filter("false")).count() == 0


def test_language_sample_has_every_label(spark):
    rows = spark.range(20_000).selectExpr("concat('few', id % 40) as label", "concat('boiler plate ', id % 40, ' ', id % 2000 >= 1000) as text", "id")
    more = spark.range(3000).selectExpr("'many' as label", "concat('text ', id % 1500) as text", "id")
    got = Counter(langid.training_sample(rows.unionByName(more.unionByName(rows.selectExpr("'hot' as label", "'one text' as text", "id"))), F.col("label"), F.col("text")))
    assert max(got.values()) == 1
    assert Counter(k for k, _ in got) == Counter({"many": 300, "hot": 1} | {f"few{i}": 2 for i in range(40)})


def test_more_labels_than_five_hundred(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_STEPS", 20)
    docs = _docs(spark, [f"text {i} of a noisy table" for i in range(1200)], [f"l{i % 600}" for i in range(1200)])
    assert len(langid.train(docs).labels) > 500
    assert langid.identify(docs.limit(50)).filter("lang_pred <> 'und'").count() == 50


def test_texts_stay_where_no_language_was_learned(spark):
    docs = _docs(spark, ["some words", "más", None, "", "12 34"], [None] * 5)
    assert sorted(r.doc_id for r in langid.keep_identified(docs).collect()) == [0, 1]


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(300):
        t = _prose(rng, rng.randint(5, 120), words).split()
        if i % 4 == 0:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["nasty", "vileone"])
        texts.append(" ".join(t))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = _docs(spark, texts + [None, ""])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, lab).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert len(got) == 302 and np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert got[300].score == got[301].score
    assert toxicity.score_documents(docs, lab.filter("false")).count() == 302


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    texts = [f"{i} " + "clean words " * 4000 + "nasty" for i in range(20)]
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    sample = lambda: toxicity.training_sample(_docs(spark, texts), lab)
    whole = Counter((i % 2, texts[i]) for i in range(20) if zlib.crc32(str(i).encode()) % toxicity.FOLDS)
    assert Counter(sample()) == whole
    monkeypatch.setattr(toxicity, "CLASS_CHARS", 50_000)
    few = Counter(sample())
    assert few <= whole and Counter(y for y, _ in few) == {0: 2, 1: 2}


def test_toxicity_steps_read_their_own_words_alone():
    rng = random.Random(8)
    texts = [_prose(rng, rng.randint(1, 90), [f"w{i}" for i in range(60)]).encode() for _ in range(12)]
    model = toxicity.Scorer()
    ptr, number, words, grams, gptr = toxicity.distinct_words(texts)
    odds = np.random.default_rng(2).standard_normal((2, 1 << 17)).astype(np.float32)
    features = model.inputs(words, grams, gptr, *odds)
    _, begin, length = toxicity.windows(ptr)
    part = slice(3, 9)
    d = np.linspace(-1, 1, 6).astype(np.float32)
    logit, saved = model.windows_forward(features, number, begin[part], length[part], keep=True)
    grads, dx = model.windows_backward(features, saved, d)
    held, local, starts = toxicity._held(number, begin[part], length[part])
    few, kept = model.windows_forward(features[:, held], local, starts, length[part], keep=True)
    own, dx_held = model.windows_backward(features[:, held], kept, d)
    assert np.allclose(logit, few, atol=1e-5) and all(np.allclose(grads[k], own[k], atol=1e-4) for k in grads)
    spread = np.zeros_like(dx)
    spread[:, held] = dx_held
    assert len(held) < len(words) and np.allclose(dx, spread, atol=1e-4)
    many = toxicity._spans(gptr[held], np.diff(gptr)[held])
    assert many.tolist() == [i for w in held.tolist() for i in range(gptr[w], gptr[w + 1])]


def test_gradients_of_the_recurrent_network():
    from pagewright.llm import gru

    rng = np.random.default_rng(0)
    u, x = gru.init(3, rng).astype(np.float64), rng.standard_normal((5, 9, 4))
    loss = lambda u: float((gru.forward(u, lambda t: x[t].astype(np.float32).copy(), 5, 4) ** 2).sum())
    states, cache = gru.forward(u, lambda t: x[t].astype(np.float32).copy(), 5, 4, keep=True)
    du, _ = gru.backward(u, cache, 2 * states)
    for i, j in ((0, 0), (4, 1), (8, 2)):
        up, down = u.copy(), u.copy()
        up[i, j] += 1e-3
        down[i, j] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - du[i, j]) < 0.02 * max(1, abs(du[i, j]))


def test_marginals_match_enumeration():
    page = html_tree.Page("<div><p>a</p><ul><li>b</li></ul></div>")
    forest, rng = html_tree.Forest([page]), np.random.default_rng(1)
    n = len(page.parent)
    node, edge = rng.standard_normal((n, 2)), rng.standard_normal((n, 2, 2))
    p, _, log_z = forest.marginals(node, edge)
    total, one = 0.0, np.zeros(n)
    for s in range(1 << n):
        y = [(s >> i) & 1 for i in range(n)]
        w = math.exp(sum(node[i, y[i]] for i in range(n)) + sum(edge[i, y[i], y[page.parent[i]]] for i in range(1, n)))
        total += w
        one += w * np.array(y)
    assert np.allclose(p, one / total) and abs(log_z - math.log(total)) < 1e-9


def test_html_extraction(spark):
    src = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Big news</h1><p>First &amp; best,\n words here to read and read again. <b>Bold</b> end.<p>Second paragraph, with more of it.</article><div class="comments"><p>I disagree, nice post.</p></div><form><p>Log in</p><button>ok</button></form><footer>&copy; someone</footer></body></html>'
    pages = spark.createDataFrame([(1, "u", src), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_tree.extract(pages).collect()}
    want = "Big news First & best, words here to read and read again. Bold end. Second paragraph, with more of it."
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}


def test_html_keeps_formulas_and_listings(spark):
    src = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Big news</h1><p>First and best, the sum <math><mi>a</mi><mo>+</mo><mspace/><mi>b</mi></math> to read and read <svg><text>drawn</text></svg> again <object>instead</object> here.</p><xmp>if a < b &amp; c</xmp><p>Second paragraph, with more of it.</p></article><div class="comments"><p>I disagree, nice post.</p></div><form><p>Log in</p></form><footer>&copy; someone</footer></body></html>'
    text = html_tree.extract(spark.createDataFrame([(1, "u", src)], "page_id long, url string, html string")).first().text
    assert text == "Big news First and best, the sum a+b to read and read drawn again instead here. if a < b &amp; c Second paragraph, with more of it."


def test_lm_scores(spark, monkeypatch):
    rng = random.Random(7)
    texts = [_prose(rng, 40, ["alpha", "beta", "gamma", "Delta"]) for _ in range(60)] + [None, "", "zz zz"]
    docs = _docs(spark, texts)
    got = {r.doc_id: r for r in ppm.score_documents(docs).collect()}
    tokens = [fold_texts([t])[0].split() + ["\n"] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in enumerate(tokens):
        want = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert abs(got[i].base_score - want) < 1e-6 and got[i].n_tokens == len(w) and got[i].n_known == sum(c[x] > 0 for x in w) and got[i].train_tokens == n
    model = ppm.Adaptive()
    for i in train:
        model.log10(fold_texts([texts[i]])[0])
    for i in range(len(texts)):
        assert abs(got[i].score - model.log10(fold_texts([texts[i]])[0], learn=False)) < 1e-4
    monkeypatch.setattr(ppm, "TABLE_CELLS", 64)
    monkeypatch.setattr(ppm, "HELD_CELLS", 128)
    monkeypatch.setattr(ppm, "GROUP_BYTES", 50)
    monkeypatch.setattr(ppm, "TURN_BYTES", 70)
    again = {r.doc_id: r for r in ppm.score_documents(docs).collect()}
    assert all(abs(again[i].score - got[i].score) < 1e-6 and abs(again[i].base_score - got[i].base_score) < 1e-6 and again[i].n_known == got[i].n_known for i in got)
    assert ppm.Adaptive().log10(b"aaaaaaaa") > ppm.Adaptive().log10(b"abcdefgh")
    alone = {r.doc_id: r.score for r in ppm.adaptive_scores(docs).collect()}
    assert abs(alone[60] + math.log10(257)) < 1e-9 and alone[60] == alone[61]
    assert ppm.score_documents(docs.filter("false")).count() == 0
    assert ppm.score_documents(docs.filter("doc_id = 0").selectExpr("0 as doc_id", "text")).count() == 1


def test_prices_of_all_symbols_sum_to_one(spark):
    rng = random.Random(8)
    texts = fold_texts([_prose(rng, 30, ["alpha", "beta", "gammą"]) for _ in range(20)])
    keys, n = np.unique(ppm.grams(texts)[0], return_counts=True)
    counts = dict(zip(keys.tolist(), n.tolist(), strict=True))
    contexts = [int(keys[3]) >> ppm.BITS, int(keys[50]) >> ppm.BITS, 0, 12345]
    wanted = {c << ppm.BITS | s for c in contexts for s in range(ppm.ALPHABET)}
    rows = [(k, counts.get(k, 0)) for k in wanted | set(counts)]
    got = {r.key: r.price for r in ppm.run_prices(spark.createDataFrame(rows, "key long, n long")).collect()}
    assert len(got) == len(rows)
    for c in contexts:
        assert abs(sum(10 ** got[c << ppm.BITS | s] for s in range(ppm.ALPHABET)) - 1) < 1e-6


def test_words_do_not_depend_on_place():
    h, _, _, ptr, _ = words_of(fold_texts(["Same word, same", None, "é same"]), TERM)
    assert ptr.tolist() == [0, 3, 3, 5] and h[0] == h[2] == h[4] and h[1] != h[3]
