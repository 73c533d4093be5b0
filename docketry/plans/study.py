"""Views, plans and completion over one document, a topic or a range of meetings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import rules as R
from docketry.operators import metadata as M
from docketry.plans import pipelines as P


def document_view(document: str, meta: DataFrame, evidence: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Three independent sections on one document: metadata, evidence, links at either end."""
    return {
        "metadata": meta.filter(F.col("id") == document),
        "evidence": evidence.filter(F.col("id") == document),
        "links": edges.filter((F.col("source") == document) | (F.col("target") == document)),
    }


def study_views(meta: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document (id): how much each section holds; one plan for all documents."""
    n = F.count(F.lit(1))
    e = evidence.groupBy("id").agg(n.alias("evidence"), F.count_distinct("kind").alias("kinds"))
    out = edges.select(F.col("source").alias("id"), F.lit("out").alias("side"))
    ends = out.unionByName(edges.select(F.col("target").alias("id"), F.lit("in").alias("side")))
    links = ends.groupBy("id").agg(F.count_if(F.col("side") == "out").alias("cites"), F.count_if(F.col("side") == "in").alias("cited"))
    return meta.join(e, "id", "left").join(links, "id", "left").na.fill(0, ["evidence", "kinds", "cites", "cited"])


def block_lookup(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each reference (doc_id, member, pos, start, end, row, cell) with the text that it
    locates: a slice of its block, or a cell of its table."""
    j = refs.join(blocks.select("doc_id", "member", "pos", "text", "rows"), ["doc_id", "member", "pos"], "left")
    cell = F.get(F.get("rows", F.col("row")), F.col("cell"))
    cut = F.substring("text", F.coalesce("start", F.lit(0)) + 1, F.coalesce(F.col("end") - F.coalesce("start", F.lit(0)), F.length("text")))
    return j.withColumn("located", F.when(F.col("row").isNotNull(), cell).otherwise(cut)).drop("text", "rows")


def filter_propositions(rows: DataFrame, organizations: list[str] = (), ids: list = (), meetings: list[str] = (), kinds: list[str] = ()) -> DataFrame:
    """Propositions by any of the given organisations, identifiers, meetings and kinds."""
    out = rows.filter(M.has_any(F.col("orgs"), list(organizations)))
    for name, wanted in (("id", ids), ("meeting", meetings), ("kind", kinds)):
        if wanted:
            out = out.filter(F.col(name).isin(list(wanted)))
    return out


def passages(**sources: DataFrame) -> DataFrame:
    """Passages (doc_id, text) of several source classes, with the class's name."""
    parts = [rows.select("doc_id", "text", F.lit(kind).alias("kind")) for kind, rows in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def historical_coverage(coverage: DataFrame, candidates: DataFrame, meetings: DataFrame) -> DataFrame:
    """Per meeting of a range: references discussed, how their metadata resolves by
    precedence, and whether that is complete; meetings without notes are missing."""
    resolved = M.resolve_precedence(coverage.select("meeting", "ref").distinct(), candidates, "ref")
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    g = resolved.groupBy("meeting").agg(F.count(F.lit(1)).alias("references"), count("resolved"), count("ambiguous"), count("unresolved"))
    state = F.when(F.col("references").isNull(), "missing").when(F.col("resolved") == F.col("references"), "complete").otherwise("partial")
    return meetings.join(g, "meeting", "left").withColumn("completeness", state).na.fill(0, ["references", "resolved", "ambiguous", "unresolved"])


def historical_corpus(discussed: DataFrame) -> DataFrame:
    """Bodies (ref, meeting) once each, with where they were discussed, and how often."""
    each = discussed.groupBy("ref", "body_meeting", "meeting", "pos").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("ref", "body_meeting").agg(F.sum("n").alias("edges"), F.min("meeting").alias("first_meeting"), F.max("meeting").alias("last_meeting"), F.count_distinct("meeting").alias("meetings"))


def link_preparation(graph: DataFrame, meta: DataFrame, receipts: DataFrame, states: DataFrame) -> DataFrame:
    """What each target of a graph still needs: metadata, body, text, extraction."""
    t = graph.select(F.col("target").alias("id")).distinct()
    there = lambda d, name: d.select("id").distinct().withColumn(name, F.lit(True))
    j = t.join(there(meta, "m"), "id", "left").join(there(receipts, "b"), "id", "left").join(there(receipts.filter("status = 'parsed'"), "p"), "id", "left").join(there(states.filter("status = 'CURRENT'"), "x"), "id", "left")
    need = F.when(F.col("m").isNull(), "metadata").when(F.col("b").isNull(), "body").when(F.col("p").isNull(), "text").when(F.col("x").isNull(), "extraction").otherwise("nothing")
    return j.select("id", need.alias("needs"))


# --- completion -------------------------------------------------------------------

Stage = Callable[[DataFrame], DataFrame]


def complete(items: DataFrame, stages: dict[str, Stage], key: list[str]) -> DataFrame:
    """Run the stages in order over all ``items``; each takes the items that are left
    and returns (key, error or null). An item stops at its first failure and harms
    no other; returns (key, done, failed_at, error)."""
    state = items.select(*key).withColumn("done", F.lit(0)).withColumn("failed_at", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    for name, stage in stages.items():
        left = items.join(state.filter("failed_at IS NULL").select(*key), key, "left_semi")
        ran = stage(left).select(*key, F.col("error").alias("__e"), F.lit(True).alias("__ran"))
        j = state.join(ran, key, "left")
        failed = F.col("__ran") & F.col("__e").isNotNull()
        state = j.select(
            *key, F.when(F.col("__ran") & F.col("__e").isNull(), F.col("done") + 1).otherwise(F.col("done")).alias("done"),
            F.when(failed, name).otherwise(F.col("failed_at")).alias("failed_at"), F.coalesce("error", "__e").alias("error"),
        )
    return state


def plan_and_complete(status: DataFrame, stages: dict[str, Stage], key: list[str], limit: int = P.PLAN_DEFAULT) -> DataFrame:
    """The selected items of a bounded plan, completed; others with their state."""
    plan = P.completion_plan(status, key, limit)
    ran = complete(plan.filter("state = 'selected'"), stages, key)
    return plan.select(*key, "state").join(ran, key, "left")


# --- requests and profiles ----------------------------------------------------------


def normalize_request(terms: list[str], meetings: list[str] = (), first: str | None = None, last: str | None = None) -> dict:
    """Terms collapsed, each once in order; a range needs both ends, and a term that
    can be searched must be there."""
    clean = list(dict.fromkeys(" ".join(t.split()) for t in terms if t.split()))
    if not any(c.isalnum() for t in clean for c in t):
        raise ValueError("no term that can be searched")
    if (first is None) != (last is None):
        raise ValueError("a range needs both of its ends")
    return {"terms": clean, "meetings": list(dict.fromkeys(m.strip() for m in meetings if m.strip())), "range": None if first is None else [first.strip(), last.strip()]}


def decide_terms(terms: DataFrame, decisions: DataFrame) -> DataFrame:
    """A profile's next revision: decisions (term, decision) on its terms (term, state);
    a decision on an unknown term is an error."""
    d = decisions.select(F.lower("term").alias("__k"), "decision")
    unknown = d.join(terms.select(F.lower("term").alias("__k")), "__k", "left_anti")
    one = unknown.agg(F.min("__k").alias("__bad"))  # one row
    j = terms.withColumn("__k", F.lower("term")).join(d, "__k", "left").crossJoin(F.broadcast(one))
    ok = F.when(F.col("__bad").isNotNull(), F.raise_error(F.concat(F.lit("unknown term: "), F.col("__bad"))).cast("boolean")).otherwise(True)
    return j.filter(ok).withColumn("state", F.coalesce("decision", "state")).drop("__k", "__bad", "decision")


def authority_meeting(role: Column, title: Column, group: Column) -> Column:
    """struct<meeting, reason>: the meeting that a report's title names, or why none."""
    named = F.regexp_extract(title, r"(?i)\bRAN([12])\s*#", 1)
    meeting = R.normalize_meeting(F.regexp_extract(title, R.REPORT_TITLE, 1))
    reason = (
        F.when(role != R.REPORT, "not a meeting report").when(~title.rlike(R.REPORT_TITLE), "title names no meeting")
        .when(F.concat(F.lit("RAN"), named) != group, "title names another group").when(meeting.isNull(), "malformed meeting")
    )
    return F.struct(F.when(reason.isNull(), meeting).alias("meeting"), reason.alias("reason"))
