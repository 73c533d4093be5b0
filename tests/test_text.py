"""Literal cases of the text and rule expressions."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import rules as R
from docketry.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_tokenize_expands_compounds(spark):
    text = "HARQ HARQ-ACK GNSS-less multi-TRP 6G NR-NTN RAN1#125 PUSCH/PDCCH"
    want = "harq harq-ack harq ack gnss-less gnss less multi-trp multi trp 6g nr-ntn nr ntn ran1#125 ran1 125 pusch pdcch".split()
    assert one(spark, T.tokenize(F.col("t")), t=text) == want
    assert one(spark, T.tokenize(F.col("t")), t="x-b#c") == ["x-b#c", "x", "b#c", "x-b", "c"]
    assert one(spark, T.tokenize(F.col("t")), t=None) == []


def test_parse_query():
    assert T.parse_query('"HARQ feedback" of ARQ') == ([["harq", "feedback"]], ["harq", "feedback", "arq"])


def test_phrase_needs_whole_tokens(spark):
    tokens = T.tokenize(F.col("t"))
    assert one(spark, T.contains_phrase(tokens, ["harq", "feedback"]), t="the HARQ feedback")
    assert not one(spark, T.contains_phrase(tokens, ["arq", "feedback"]), t="the HARQ feedback")


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Nokia / Ericsson\nSamsung; Nokia", ["Nokia / Ericsson", "Samsung", "Nokia"]), ("Example Co., Ltd., Qualcomm", ["Example Co., Ltd.", "Qualcomm"]), ("A; a;A ", ["A"]), (None, [])],
)
def test_split_organizations(spark, raw, want):
    assert one(spark, T.split_organizations(F.col("t")), t=raw) == want


def test_variants(spark):
    got = one(spark, T.exact_variants(F.col("t")), t="Fast-ARQ")
    assert {"Fast ARQ", "fast arq", "Fast-ARQ"} <= set(got) and not any("HARQ" in x for x in got)


def test_joined_suffix(spark):
    assert one(spark, T.strip_joined_suffix(F.col("t"), ["Amazon Web Services", "Amazon"]), t="GNSS resilienceAmazon") == "GNSS resilience"


@pytest.mark.parametrize(
    ("text", "reason", "n"),
    [
        ("Support X and Y; details remain open", "whole", 1),
        ("First thing. Second thing.", "sentence", 2),
        ("We propose:\n- one\n- two", ["whole", "list_item", "list_item"], 3),
        ("1) one\n2) two", "number", 2),
        ("Option 1: a\nOption 2: b", "option", 2),
        ("  \n- a\n\n 2. b ", ["list_item", "number"], 2),
    ],
)
def test_segments_are_exact(spark, text, reason, n):
    got = one(spark, T.segments(F.col("t")), t=text)
    assert [s.reason for s in got] == ([reason] * n if isinstance(reason, str) else reason)
    assert all(s.parent == (0 if got[0].reason == "whole" and i else None) for i, s in enumerate(got))
    assert all(text[s.start : s.end] == s.literal for s in got)


def test_spans_count_code_points(spark):
    text = "x𝔘 R1-2605236, R1-2605237 and R1-26052367890"
    got = one(spark, T.spans(F.col("t"), R.REFERENCE_LINK), t=text)
    assert [(text[s.start : s.end], s.literal) for s in got] == [("R1-2605236",) * 2, ("R1-2605237",) * 2]


def test_chair_reference_accepts_a_following_letter(spark):
    assert one(spark, F.regexp_extract_all(F.col("t"), F.lit(R.REFERENCE_CHAIR), F.lit(0)), t="R1-2605236HARQ related") == ["R1-2605236"]
    assert one(spark, F.regexp_extract_all(F.col("t"), F.lit(R.REFERENCE_CHAIR), F.lit(0)), t="R1-260523678HARQ") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Study the matter", "study"), ("It is selected", "select"), ("This is endorsed", "endorse"), ("It remains open", "unclassified"), ("to be down-selected", "unclassified"),
        ("down-select from the two", "unclassified"), ("select one of these", "unclassified"), ("further select between", "unclassified"), ("is down-selected", "select"), (None, "unclassified"),
    ],
)
def test_disposition(spark, text, want):
    assert one(spark, R.disposition(F.col("t")), t=text) == want


@pytest.mark.parametrize(("raw", "want"), [("124b", "124bis"), ("124bis", "124bis"), ("RAN1#124b", "124bis"), ("TSGR1_124", "124"), ("0119-e", "119-e"), ("x", None), ("", None)])
def test_meeting(spark, raw, want):
    assert one(spark, R.normalize_meeting(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("name", "role", "stamp"),
    [("tdocList_2025-09-02_14h28.xlsx", "historical", "2025-09-02 14:28"), ("TDoc_List_Meeting_RAN2#131.xlsx", "current", None), ("tdocList_2025-09-03_10h00_eom.xlsx", "close", "2025-09-03 10:00"), ("x.xlsx", "unknown", None), ("a_2025-13-41.x", "unknown", None)],
)
def test_snapshot_names(spark, name, role, stamp):
    assert one(spark, R.snapshot_role(F.col("t")), t=name) == role
    assert one(spark, F.date_format(R.filename_timestamp(F.col("t")), "yyyy-MM-dd HH:mm"), t=name) == stamp


@pytest.mark.parametrize(("name", "want"), [("n_eom1.docx", "eom"), ("n_final.docx", "explicit_final"), ("n_revision.docx", "intermediate"), ("n.docx", "unknown"), ("n_final_eom2.docx", "unknown")])
def test_chair_label(spark, name, want):
    assert one(spark, R.chair_label(F.col("t")), t=name) == want


@pytest.mark.parametrize(
    ("text", "kind", "ordinal", "body"),
    [("Proposal 2: Use it", "proposal", 2, "Use it"), (" Observation", "observation", None, ""), ("Proposals follow", None, None, None), ("AGREEMENT: yes", "agreement", None, "yes"), ("For further study: x", "ffs", None, "x")],
)
def test_labels(spark, text, kind, ordinal, body):
    got = one(spark, R.label_of(F.col("t")), t=text)
    assert (got and (got.kind, got.ordinal, got.body)) == (kind and (kind, ordinal, body))
