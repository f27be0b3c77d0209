import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from pagewright.llm import bbit, chosen_path, filter_audit, queries, spelling
from pagewright.llm.bytewords import NONSPACE, fold_texts

SF = "/root/testdata/sf0.001"
#: Columns that clash with those the operators make.
DOCS = "doc_id long, text string, lang string, source string, word string, n long, path long, part string, h long, rid string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "x", 1, 2, "p", 3, "y") for i, t, lang in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_minhash_near_dedup", "op13_filter_interaction_audit"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "labels"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = c.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_near_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(400)}
    words |= {"prefix" + "".join(rng.choice("xyz") for _ in range(4)) for _ in range(60)}  # one prefix holds many
    words |= {"z" * 5000 + x for x in ("a", "b", "ab")}
    monkeypatch.setattr(spelling, "PART", 5)
    monkeypatch.setattr(spelling, "ROWS", 64)
    got = spelling.near_pairs(spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long").repartition(3)).collect()
    want = {frozenset((a, b)) for a in words for b in words if a < b and _near(a, b)}
    assert len(got) == len(want) and {frozenset((r.a, r.b)) for r in got} == want


def _variants(rows):
    runs = Counter()
    for i, t, _ in rows:
        for run in re.findall(spelling.RUN, (t or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            runs[run] += 1
    words = {w: n for w, n in runs.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        near = sorted(((-words[o], o) for o in words if o != w and _near(o, w)))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        out[w] = [n, len(near), form, words[form] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {(w, *v) for w, v in out.items()}


def test_spelling_edges(spark):
    text = "Strasse strasse STRASSE " * 40 + "stras\u00dfe strase " * 7 + "\u00c9toile \u00e9toile \u00e9toilez " * 6
    rows = [(1, text, "de"), (1, text, "de"), (None, text, None), (2, None, "x"), (3, "", "x"), (4, "q" * 70_000 + " q" * 9, "x"), *[(9 + i, "q" * 70_000, "x") for i in range(6)]]
    got = spelling.spelling_variants(_docs(spark, rows))
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert {tuple(r) for r in got.collect()} == _variants(rows)
    assert spelling.spelling_variants(_docs(spark, []).filter("false")).count() == 0


def _grams(text):
    return set(chosen_path.shingles(fold_texts([text]), NONSPACE)[0].tolist())


def test_minhash_edges_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}," for i in range(200)]
    texts = [" ".join(base)] * 2
    for n in (1, 2, 3, 4, 5, 6, 8):  # from links to none
        for _ in range(4):
            w = list(base)
            for _ in range(n):
                w[rng.randrange(200)] = f"n{rng.random()}"
            texts.append(" ".join(w))
    texts += [None, "", " \n", "One two", "one TWO", "one\ttwo", "x" * 70_000, "X" * 70_000, "a\u00a0b c d e f"]
    monkeypatch.setattr(chosen_path, "BUCKET", 6)
    monkeypatch.setattr(chosen_path, "BLOCK", 5)
    ids = list(range(len(texts) - 1)) + [0]
    got = bbit.near_duplicates(_docs(spark, [(i, t, "en") for i, t in zip(ids, texts, strict=True)] + [(None, texts[0], "en"), (None, None, None)])).collect()
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[0]), (None, None)]
    sets, root = [_grams(t) for _, t in rows], list(range(len(rows)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = defaultdict(list)
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r].append(rows[i][0])
    want = Counter()
    for i, (d, _) in enumerate(rows):
        component = min(least[root[i]], default=None)
        want[(d, len(sets[i]), component, d == component)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert bbit.near_duplicates(_docs(spark, [(1, "a", "b")]).filter("false")).count() == 0


def test_bits_tell_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(1 << 32, size=(4000, chosen_path.MINWISE), dtype=np.uint32)
    for s in (0.0, 0.5, 0.85):
        b = np.where(rng.random(a.shape) < s, a, rng.integers(1 << 32, size=a.shape, dtype=np.uint32))
        told = bbit.estimate(bbit.low_bits(a), bbit.low_bits(b))
        assert abs(told.mean() - s) < 0.005 and told.std() < 0.05
        if s == 0.85:
            assert (bbit.bands(a) == bbit.bands(b)).any(axis=1).mean() > 0.999
    assert bbit.bands_miss(0.85, True) < 1e-4 and bbit.signature_miss(0.85) < 1e-5


def test_texts_that_share_a_part_do_not_multiply(spark, monkeypatch):
    """All are tied to the pivot of their node, so no level follows the roots."""
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(150)]
    docs = _docs(spark, [(i, " ".join(shared + [f"o{rng.random()}" for _ in range(25)]), "en") for i in range(80)])
    monkeypatch.setattr(chosen_path, "BUCKET", 20)
    made = []
    before = chosen_path.Table.__init__

    def noted(self, df, tag):
        before(self, df, tag)
        made.append((tag, self.read().count()))

    monkeypatch.setattr(chosen_path.Table, "__init__", noted)
    got = chosen_path.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i for i in range(80)}
    assert sum(n for tag, n in made if tag == "tied") > 200 and sum(n for tag, n in made if tag == "split") == 0


def _audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    found = []
    for d, t, lang in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
        first = min((i for i, x, _ in rows if (x or "") == t and i is not None), default=None)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and first < d}
        found.append((lang or "", {f for f, bad in fails.items() if bad}, d in good, d in toxic))
    out = set()
    for part in {f[0] for f in found}:
        mine, made = [f for f in found if f[0] == part], []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                left = [x for x in left if f not in x[1]]
                made.append([part, "".join(order), step, len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone), f])
        total = Counter()
        for m in made:
            total[m[-1]] += m[4]
        out |= {(*m[:-1], total[m[-1]]) for m in made}
    return out


def test_audit_edges_equal_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(230))
    rows = [(1, long, "en"), (2, long, "de"), (2, long, "de"), (3, long + " A", "en"), (4, "A# b", None), (5, None, ""), (None, long, "en"), (None, None, None), (6, "w " * 300, "en"), (7, long.upper(), "en"), (7, "\u00c9\u00c9 x", "en"), (8, "\u000b\f\n", "en"), (9, "$" * 70_000, "en")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (6, None, 1), (99, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(_docs(spark, rows), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in got.collect()} == _audit(rows, labels)
    assert filter_audit.audit(_docs(spark, rows).filter("false"), marks).count() == 0
