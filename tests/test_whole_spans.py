"""References whose literal also begins a longer one of the same text."""

from docketry.plans import registry


def _order(spark, tmp_path):
    # 234561: the text has R2-1234561 and, later, R2-123456.
    spark.range(234561, 234562).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_spans_are_those_of_the_matches(spark, tmp_path):
    got = registry.queries()["reference_spans"](spark, _order(spark, tmp_path)).collect()
    text = "See R1-334561 and R2-1234561, revision of R1-434561; reply to R2-123456."
    assert [(r.start, r.end) for r in got] == [(4, 13), (18, 28), (42, 51), (62, 71)]
    assert all(text[r.start : r.end] == r.literal for r in got)


def test_the_cue_is_that_of_the_match(spark, tmp_path):
    got = registry.queries()["relation_cue"](spark, _order(spark, tmp_path)).collect()
    assert [(r.start, r.relation) for r in got] == [(4, "reference"), (18, "reference"), (42, "revision"), (62, "reply")]
