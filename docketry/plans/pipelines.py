"""Public compositions of the operators: what a user of the engine calls.

Each takes DataFrames and returns DataFrames; nothing is collected, and meetings
and terms are columns of one plan instead of loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import rules as R
from docketry.functions import text as T
from docketry.operators import evidence as E
from docketry.operators import inventory as I
from docketry.operators import links as L
from docketry.operators import metadata as M
from docketry.operators import search as S
from docketry.operators import topics as P

# The stages of completion in order; rows of a plan by default and at most.
STAGES = ("metadata", "body", "normalized", "indexed", "extracted", "linked")
PLAN_DEFAULT, PLAN_MOST = 20, 50


def candidate_inventory(meta: DataFrame, topic: str, fields: list[str], organizations: Column, position: str) -> tuple[DataFrame, DataFrame]:
    """Matching rows with their level, and facets by organisation."""
    found = I.topic_match(meta, topic, fields).filter("level IS NOT NULL")
    return found, I.facet(found, organizations, position)


def topic_study(blocks: DataFrame, evidence: DataFrame, query: str, per_group: int = 10, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Documents that a query finds, and evidence (doc_id, kind, statement) that
    shares a token with it, the first of each kind."""
    hits = S.rollup_documents(S.search_blocks(blocks, query), most)
    _, terms = T.parse_query(query)
    near = evidence.filter(F.arrays_overlap(T.tokenize(F.col("statement")), F.array(*map(F.lit, terms))))
    return hits, I.top_per_group(near, "kind", ["doc_id", "statement"], per_group)


def discussion_coverage(blocks: DataFrame, meta: DataFrame, query: str, key: tuple[str, ...] = ("doc_id", "member")) -> DataFrame:
    """References discussed under a topic, with how their metadata resolves.

    Regions of a note are found, literal references are paired with the topic's
    anchor in their region, and each is joined with current metadata (ref,
    meeting).
    """
    _, terms = T.parse_query(query)
    want = F.array(*map(F.lit, terms))
    cut = F.regexp_replace("text", f"({R.REFERENCE_CHAIR[:-len('(?![0-9-])')]})(?![0-9-])", "$1 ")
    r = E.regions(blocks, key)
    anchors = r.filter(F.size(F.array_intersect(T.tokenize(cut), want)) > 0).select(*key, "region", "pos", F.col("text").alias("anchor"))
    refs = r.select(*key, "region", "pos", F.explode(F.regexp_extract_all("text", F.lit(R.REFERENCE_CHAIR), F.lit(0))).alias("ref"))
    pairs = E.associate(anchors, refs.distinct(), [*key, "region"])
    known = meta.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return pairs.join(known, "ref", "left").withColumn("state", state).drop("n")


def coverage_summary(coverage: DataFrame, group: str) -> DataFrame:
    return coverage.groupBy(group).agg(
        F.count(F.lit(1)).alias("associations"), F.count_distinct("ref").alias("references"), F.count_if(F.col("state") == "resolved").alias("resolved"),
        F.when(F.bool_and(F.col("state") == "resolved"), "complete").otherwise("partial").alias("completeness"),
    )


def missing_stages(status: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Add missing (stages not done, in order) and next; one flag column a stage."""
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(s), F.lit(False)), F.lit(s)) for s in stages]))
    return status.withColumn("missing", missing).withColumn("next", F.get("missing", 0))


def completion_plan(items: DataFrame, order: list[str], limit: int = PLAN_DEFAULT) -> DataFrame:
    """Eligible items of the first batch are selected, of later ones deferred,
    others excluded; the split is one column."""
    if not 1 <= limit <= PLAN_MOST:
        raise ValueError(f"limit must be from 1 to {PLAN_MOST}")
    first = items.filter("eligible").orderBy(*order).limit(limit).select(*order, F.lit(True).alias("__in"))
    state = F.when(~F.col("eligible"), "excluded").when(F.col("__in"), "selected").otherwise("deferred")
    return items.join(first, order, "left").withColumn("state", state).drop("__in")


def proposition_corpus(units: DataFrame) -> DataFrame:
    """Candidates (doc_id, unit, segment, start, end, literal, reason, group_id) of
    units (doc_id, unit, kind, text): exact segments; rows of one document and
    kind that read alike share a group and are all kept."""
    s = units.select("doc_id", "unit", "kind", F.posexplode(T.segments(F.col("text"))).alias("segment", "s"))
    s = s.select("doc_id", "unit", "kind", "segment", "s.*").withColumn("surface", T.surface(F.col("literal")))
    g = s.groupBy("doc_id", "kind", "surface").agg(F.count(F.lit(1)).alias("n"))
    gid = F.when(F.col("n") > 1, F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "kind", "surface"), 256), 1, 24))
    return s.join(g, ["doc_id", "kind", "surface"]).withColumn("group_id", gid).drop("n", "surface")


#: Reviews up to so many are broadcast to the pairs.
FEW_REVIEWS = 1_000_000


def relation_corpus(accepted: DataFrame, reviews: DataFrame, scope: str, limit: int | None = 5000) -> DataFrame:
    """Pairs of accepted propositions of disjoint organisations, reviewed or pending;
    all of them if ``limit`` is None, else an error beyond it."""
    pairs = L.disjoint_pairs(accepted, scope, limit).withColumn("pair_id", L.pair_identity(F.col("left_id"), F.col("right_id")))
    latest = M.review_history(reviews, "pair_id").select("pair_id", "decision")
    # Pairs may be very many more than reviews and are then not to be shuffled.
    if reviews.count() <= FEW_REVIEWS:
        latest = F.broadcast(latest)
    return pairs.join(latest, "pair_id", "left").withColumn("state", F.when(F.col("decision").isNull(), "pending").otherwise("reviewed"))


def report_passages(blocks: DataFrame, phrase: str, k: int, limit: int, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Literal passages of a phrase with k blocks around, the first ``limit`` of each
    document and how many there are."""
    hit = F.col("text").rlike(T.phrase_pattern(phrase))
    found = E.adjacent_context(blocks, hit, k, key)
    return P.capped(found, key[0], ["pos"], limit)


# --- rendering -----------------------------------------------------------------


def render(rows: DataFrame, columns: list[str], title: str, order: list, offset: int = 0, limit: int = 20) -> str:
    """A page of rows as text; at most 100 rows come to the driver."""
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("offset must be 0 or more and limit from 1 to 100")
    page = rows.orderBy(*order).offset(offset).limit(limit).select(F.concat_ws("\n", *[F.format_string(f"  {c}: %s", F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns]).alias("x"))
    body = [f"{offset + i}.\n{r.x}" for i, r in enumerate(page.collect(), 1)]
    return "\n".join([title, f"rows: {rows.count()}", *body])
