"""What the driver's Python holds while a model is trained."""

import random
import tracemalloc

from pagewright.llm import toxicity


def test_toxicity_is_not_trained_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    docs = spark.createDataFrame([(i, " ".join([word() for _ in range(150)] + ["vile"] * (i % 2))) for i in range(400)], "doc_id long, text string").cache()
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic")
    docs.count()
    tracemalloc.start()
    scored = toxicity.score_documents(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20  # the tables of log-odds are 1 MB; before, the words and n-grams of the sample took 84 MB here
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    rows = scored.orderBy("doc_id").collect()
    want = model.scores([t.encode() for t in (r.text for r in docs.orderBy("doc_id").collect())])
    assert max(abs(r.score - w) for r, w in zip(rows, want.tolist(), strict=True)) < 1e-6
    docs.unpersist()
