"""Ordered classification rules as CASE expressions.

The rule tables are data; the first rule that matches wins, so their order
matters. ``compile_rules`` turns a table into one expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Document roles that may carry the rule; empty: none may.
    roles: tuple[str, ...] = field(default=())


CONTRIBUTION, REPORT = "contribution", "meeting_report"

# Kinds a role may state, labels, inline cues, heading kinds.
AUTHORITY = {
    CONTRIBUTION: ("proposal", "observation", "conclusion", "ffs"),
    REPORT: ("agreement", "conclusion", "ffs", "decision"),
}
LABELS = (
    ("proposal", "Proposal"),
    ("observation", "Observation"),
    ("conclusion", "Conclusion"),
    ("agreement", "Agreements?"),
    ("decision", "Decision"),
    ("ffs", "FFS"),
    ("ffs", "For further study"),
)
INLINE = (
    Rule("proposal", r"\bwe propose that\b|\bthe source proposes\b", (CONTRIBUTION,)),
    Rule("agreement", r"\bit was agreed that\b|\bthe meeting agreed\b", (REPORT,)),
    Rule("agreement", r"\bwe agree that\b|\bit is agreed in our view\b", ()),
    Rule("conclusion", r"\bit was concluded that\b|\bthe meeting concluded\b", (REPORT,)),
    Rule("decision", r"\bthe meeting decided\b", (REPORT,)),
    Rule("ffs", r"\bFFS\b|\bleft for further study\b", (CONTRIBUTION, REPORT)),
)
HEADINGS = {
    "proposal": "proposal", "proposals": "proposal", "observation": "observation", "observations": "observation",
    "conclusion": "conclusion", "conclusions": "conclusion", "agreement": "agreement", "agreements": "agreement",
    "decision": "decision", "decisions": "decision", "open issues": "ffs", "issues for further study": "ffs", "for further study": "ffs",
}
DISPOSITIONS = (
    ("study", r"\bstud(?:y|ies|ied|ying)\b"),
    ("select", r"\bselect(?:ed)?\b|\bis selected\b"),
    ("endorse", r"\bendorse(?:d|ment)?\b"),
    ("adopt", r"\badopt(?:ed|ion)?\b"),
    ("reuse", r"\breused?\b|\bcan be reused\b"),
    ("defer", r"\bdefer(?:red)?\b|\bleft for later\b"),
)
PENDING_SELECT = r"\bto be (?:down-)?selected\b|\b(?:down[ -]select|(?:further )?select) (?:one )?(?:from|between)\b|\bselect one of\b"
CONTEXT_LABEL = r"(?i)^\s*(?:note(?:\s+\d+)?|remark|condition|exception|ffs)\s*:"
RELATIONS = (
    ("supersession", r"(?i)\b(?:supersedes?|replaces?)\b"),
    ("revision", r"(?i)\b(?:revision of|revised version of|updated version of)\b"),
    ("reply", r"(?i)\b(?:reply LS to|reply to|in reply to)\b"),
)
REFERENCE_CHAIR = r"(?<![\w-])R[12]-[0-9]{6,8}(?![0-9-])"
REFERENCE_LINK = r"\bR[12]-\d{6,8}\b"
REFERENCE_LIST = r"\b[A-Z][A-Z0-9]?-\d{5,}\b"
REPORT_TITLE = r"(?i)\b(?:report(?:\s+of)?|final\s+minutes(?:\s+of)?)\s+RAN[12]\s*#\s*(\d+(?:bis|b|-e)?)(?:\s+meeting)?\b"
COVERAGE_PRIORITY = {"ambiguous": 3, "unresolved": 2, "source_missing": 2, "body_not_local": 2, "not_extracted": 2, "linked": 1, "no_link": 0}


def label_pattern(name: str) -> str:
    """Groups: label, ordinal, body."""
    return rf"(?iuUd)^\s*({name})(?=\s|:|$)(?:\s+(\d+))?\s*:?[ \t]*(.*)$"


def _first(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.lit(None)
    for cond, value in reversed(pairs):
        out = F.when(cond, value).otherwise(out)
    return out


def label_of(text: Column) -> Column:
    """struct<kind, label, ordinal, body> of the first matching label, or null."""
    t = F.coalesce(text, F.lit(""))
    part = lambda p, k: F.regexp_extract(t, p, k)
    return _first(
        [
            (
                t.rlike(p := label_pattern(name)),
                F.struct(F.lit(kind).alias("kind"), part(p, 1).alias("label"), F.nullif(part(p, 2), F.lit("")).cast("int").alias("ordinal"), F.trim(part(p, 3)).alias("body")),
            )
            for kind, name in LABELS
        ]
    )


def allowed(role: Column, kind: Column) -> Column:
    """The authority matrix: whether the role may state the kind."""
    return _first([(role == r, kind.isin(*kinds)) for r, kinds in AUTHORITY.items()] + [(F.lit(True), F.lit(False))])


def inline_of(text: Column, role: Column) -> Column:
    """struct<kind, cue, ok> of the first matching inline cue, or null."""
    t = F.coalesce(text, F.lit(""))
    return _first(
        [
            (
                t.rlike("(?i)" + r.pattern),
                F.struct(F.lit(r.kind).alias("kind"), F.regexp_extract(t, f"(?i){r.pattern}", 0).alias("cue"), (role.isin(*r.roles) if r.roles else F.lit(False)).alias("ok")),
            )
            for r in INLINE
        ]
    )


def heading_kind(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[\d.\s]+", ""), r"[\s:]+", " "))
    return _first([(plain == k, F.lit(v)) for k, v in HEADINGS.items()])


def disposition(text: Column) -> Column:
    """First matching disposition; a pending selection selects nothing."""
    t = F.coalesce(text, F.lit(""))
    hit = lambda kind, p: t.rlike("(?i)" + p) & (~t.rlike("(?i)" + PENDING_SELECT) if kind == "select" else F.lit(True))
    return F.coalesce(_first([(hit(k, p), F.lit(k)) for k, p in DISPOSITIONS]), F.lit("unclassified"))


def relation_near(text: Column, start: Column, end: Column, before: int = 80, after: int = 40) -> Column:
    """The relation that a cue around a reference states; plain if none."""
    lo = F.greatest(start - before, F.lit(0))
    window = F.substring(text, lo + 1, end + after - lo)
    return F.coalesce(_first([(window.rlike(p), F.lit(k)) for k, p in RELATIONS]), F.lit("reference"))


def document_role(title: Column, kind: Column, category: Column, organizations: Column) -> Column:
    """Agenda, chair material, meeting report, contribution or unknown, in this order."""
    t, k, c = (F.lower(F.coalesce(x, F.lit(""))) for x in (title, kind, category))
    foreign = F.exists(F.coalesce(organizations, F.array().cast("array<string>")), lambda o: F.lower(o) != "etsi mcc")
    return (
        F.when((k == "agenda") | t.rlike(r"^(?:draft )?agenda\b"), "agenda")
        .when(k.contains("chair") | t.rlike(r"\bchair(?:man)?(?:'s)? notes?\b"), "chair_material")
        .when((k == "report") & t.rlike(r"\b(?:report|minutes)\b") & ~foreign, REPORT)
        .when(foreign & ((k != "") | (c != "")), CONTRIBUTION)
        .otherwise("unknown")
    )


def availability(downloaded: Column, listed: Column, url: Column) -> Column:
    return F.when(downloaded & url.isNotNull(), "downloadable").when(listed, "listed_only").otherwise("unknown")


# --- list snapshots and meetings ------------------------------------------------


def snapshot_role(filename: Column) -> Column:
    name = F.lower(filename)
    return (
        F.when(name.rlike(r"(?:^|[^a-z])(?:eom|final)(?:[^a-z]|$)"), "close")
        .when(name.contains("tdoc_list_meeting"), "current")
        .when(filename_timestamp(filename).isNotNull(), "historical")
        .otherwise("unknown")
    )


STAMP = r"(20\d{2})-?([01]\d)-?([0-3]\d)(?:[_T-]?([0-2]\d)h([0-5]\d))?"


def filename_timestamp(filename: Column) -> Column:
    """A naive timestamp in a file name, null if there is none or it is no date."""
    g = lambda k: F.regexp_extract(filename, STAMP, k)
    text = F.concat_ws("", g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit(" "), F.coalesce(F.nullif(g(4), F.lit("")), F.lit("00")), F.lit(":"), F.coalesce(F.nullif(g(5), F.lit("")), F.lit("00")))
    return F.when(filename.rlike(STAMP), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))).cast("timestamp_ntz")


def chair_label(filename: Column) -> Column:
    """explicit_final, eom, intermediate; unknown if none or several agree not."""
    hits = lambda p, name: F.when(F.lower(filename).rlike(p), F.lit(name))
    found = F.array_compact(F.array(hits(r"(?:^|[^a-z])final(?:[^a-z]|$)", "explicit_final"), hits(r"(?:^|[^a-z])eom\d*(?:[^a-z0-9]|$)", "eom"), hits(r"(?:^|[^a-z])rev(?:ision)?\d*(?:[^a-z0-9]|$)", "intermediate")))
    return F.when(F.size(found) == 1, F.get(found, 0)).otherwise("unknown")


def normalize_meeting(value: Column, alias: bool = True) -> Column:
    """Digits without leading zeros and an optional bis or -e; null if malformed.

    A group prefix is dropped; ``alias`` reads a trailing b as bis.
    """
    body = F.regexp_replace(F.lower(F.trim(value)), r"^(?:ran[12]\s*#|tsgr[12]_)\s*", "")
    p = r"^0*(\d+)(bis|b|-e)?$"
    tail = F.regexp_extract(body, p, 2)
    tail = F.when(tail == "b", F.lit("bis") if alias else F.lit(None)).otherwise(tail)
    return F.when(body.rlike(p), F.concat(F.regexp_extract(body, p, 1), tail))


def meeting_key(meeting: Column) -> Column:
    """struct<number, rank> that orders meetings: '' < bis < -e; null is last."""
    tail = F.regexp_extract(meeting, r"^\d+(.*)$", 1)
    number = F.regexp_extract(meeting, r"^(\d+)", 1).try_cast("int")
    rank = F.when(tail == "", 0).when(tail == "bis", 1).when(tail == "-e", 2).otherwise(3)
    return F.struct(F.coalesce(number, F.lit(2**31 - 1)).alias("number"), rank.alias("rank"))


def related_ids(text: Column) -> Column:
    """All document identifiers of a cell, first seen first."""
    fixed = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "_", "-"))
    return F.array_distinct(F.regexp_extract_all(fixed, F.lit(REFERENCE_LIST), F.lit(0)))
