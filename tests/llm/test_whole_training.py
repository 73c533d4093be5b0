"""op4 learns from all trusted text, and a model of any size gives the same numbers."""

import math
import random

from docketry.llm import kneser_ney as K


def _docs(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(vocab, k=r.randint(1, 60))), "en") for i in range(120)]
    rows += [(500, "rare " + " ".join(r.choices(vocab, k=2000)) + " pair rare pair", "en"), (None, "w1 W2 unseen", None), (501, None, "en"), (502, " ", "en"), (503, "w1 rare", "de"), ((1 << 53) + 1, "w3 w4", "de")]
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(120), 500]], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), labels


def test_sharded_scores_equal_those_of_one_process(spark, monkeypatch):
    docs, _ = _docs(spark)
    tables = K.estimate(docs.select("text"))
    want = sorted((r.doc_id or 0, r.lang or "", r.n_words, r.nll) for r in K.perplexities(docs, K.collected(tables)).collect())
    monkeypatch.setattr(K, "MOST", 20)
    monkeypatch.setattr(K, "BATCH", 7)
    got = sorted((r.doc_id or 0, r.lang or "", r.n_words, r.nll) for r in K.sharded(docs, tables).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9)


def test_all_trusted_text_trains(spark, monkeypatch):
    docs, labels = _docs(spark)
    texts = []
    estimate = K.estimate
    monkeypatch.setattr(K, "estimate", lambda t: texts.extend(r.text for r in t.collect()) or estimate(t))
    monkeypatch.setattr(K, "TRUSTED", 50)  # pairs of a broadcast model; no bound on what trains
    monkeypatch.setattr(K, "HELD_OUT", 1 << 40)
    K.classify(docs, labels).collect()
    assert len(texts) == 120 and any(len(t.split()) > 1500 for t in texts)  # one of "en" is held out
