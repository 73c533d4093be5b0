"""The pipeline over a small corpus: what each stage must and must not keep."""

import random

import corpus_pipeline
from docketry.llm.common import staged


def test_stages(spark):
    r = random.Random(2)
    sentence = lambda n: " ".join(r.choice(["the", "of", "and"] if r.random() < 0.3 else [f"word{r.randrange(3000)}"]) for _ in range(n))
    texts = [sentence(r.randint(60, 150)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    near = texts[3].split()
    near[10] = "changed"
    rows += [(100, texts[5], "en", "s0", 1), (101, " ".join(near), "en", "s0", 1), (102, "short text", "en", "s0", 1), (103, "a | b " * 100, "en", "s0", 1), (104, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, ""), name)
        kept[name] = [x.doc_id for x in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept["quality_rules"]) == {*range(60), 100, 101}
    assert set(kept["exact_dedup"]) == {*range(60), 100, 101} - {5}
    assert set(kept["ngram_jaccard_join"]) == {*range(60), 100} - {5}
    assert set(kept["mixing"]) <= set(kept["ngram_jaccard_join"]) and len(kept["mixing"]) > 30
    assert set(kept["best_fit_packing"]) == set(kept["mixing"])
