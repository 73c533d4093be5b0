"""Candidate inventories: match levels, facets, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T

# Weights of the fields; fields that can anchor a match.
FIELD_WEIGHTS = {
    "title": 3, "abstract": 3, "agenda_item_description": 2, "related_work_item": 2, "document_type": 1, "status": 0, "release": 1, "specification": 1, "intended_for": 1,
}
ANCHORS = ("title", "abstract", "agenda_item_description")
RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def topic_match(meta: DataFrame, topic: str, fields: list[str]) -> DataFrame:
    """Add level (HIGH, MEDIUM, LOW or null), covered tokens and best weight.

    HIGH: one anchor field covers all topic tokens. MEDIUM: all fields together
    do, two or more matching. LOW: the anchors cover two or more and half of
    them. Some anchor must hold a token that is not generic.
    """
    stop = set(T.TOPIC_STOP)
    tokens = list(dict.fromkeys(t for t in T.re_tokens(topic) if t not in stop))
    want = F.array(*map(F.lit, tokens))
    specific = F.array(*map(F.lit, [t for t in tokens if t not in T.GENERIC] or [""]))
    hit = {f: F.array_intersect(want, T.meaningful_tokens(F.col(f))) for f in fields}
    anchors = [f for f in fields if f in ANCHORS]
    union = lambda names: F.array_distinct(F.flatten(F.array(*[F.col(f"__{f}") for f in names])))
    m = meta.select("*", *[h.alias(f"__{f}") for f, h in hit.items()])
    m = m.withColumn("__anchor", union(anchors)).withColumn("__all", union(fields))
    n = len(tokens)
    full = T.any_of([F.size(f"__{f}") == n for f in anchors])
    some = sum((F.when(F.size(f"__{f}") > 0, 1).otherwise(0) for f in fields), F.lit(0))
    level = (
        F.when(~F.arrays_overlap("__anchor", specific), None).when(full, "HIGH").when((F.size("__all") == n) & (some >= 2), "MEDIUM")
        .when((F.size("__anchor") >= 2) & (F.size("__anchor") * 2 >= n), "LOW")
    )
    weight = F.greatest(F.lit(0), *[F.when(F.size(f"__{f}") > 0, F.lit(FIELD_WEIGHTS.get(f, 0))).otherwise(0) for f in fields])
    m = m.withColumn("level", level).withColumn("covered", F.size("__all")).withColumn("weight", weight)
    return m.drop("__anchor", "__all", *[f"__{f}" for f in fields])


def best_topic(matches: DataFrame, key: str) -> DataFrame:
    """The best of a key's matches (topic_index, level, ratio, weight)."""
    rank = F.when(F.col("level") == "HIGH", 3).when(F.col("level") == "MEDIUM", 2).when(F.col("level") == "LOW", 1)
    order = F.struct(rank, "ratio", "weight", -F.col("topic_index"))
    return matches.filter(F.col("level").isNotNull()).groupBy(key).agg(F.max_by("topic_index", order).alias("topic_index"), F.max_by("level", order).alias("level"))


def facet(rows: DataFrame, values: Column, position: str, unknown: str = "(unknown)") -> DataFrame:
    """(value, n) of an array column: most common first, ties by first place."""
    each = rows.select(F.explode_outer(values).alias("value"), position).withColumn("value", F.coalesce("value", F.lit(unknown)))
    return each.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first")).orderBy(F.desc("n"), "first")


def batches(rows: DataFrame, order: list[str], size: int, group: list[str]) -> DataFrame:
    """Eligible rows in order, in batches of ``size`` within each group."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("int"))


def top_per_group(rows: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group, and whether there were more."""
    w = Window.partitionBy(group)
    # One row more than is asked for tells whether there are more; so each task
    # keeps limit + 1 rows of a group before anything is shuffled.
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).filter(F.col("rank") <= limit + 1)
    return ranked.withColumn("truncated", F.max("rank").over(w) > limit).filter(F.col("rank") <= limit)


def grouped_ids(rows: DataFrame, group: str, id_: str) -> DataFrame:
    """(group, ids): the identifiers of each group in order; a report of one array a
    group, for groups that a reader can read."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(id_)).alias("ids"))


def conditional_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition, and ``n`` of all."""
    return rows.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()], F.count(F.lit(1)).alias("n"))


def metadata_only(meta: DataFrame, used: DataFrame, key: str, title: str, query: str) -> DataFrame:
    """Rows whose title shares a token with the query and that ``used`` does not name."""
    tokens = [t for t in T.re_tokens(query) if t not in T.TOPIC_STOP]
    hit = F.arrays_overlap(T.meaningful_tokens(F.col(title)), F.array(*map(F.lit, tokens)))
    return meta.filter(hit).join(used, key, "left_anti")


def explicit_plan(wanted: DataFrame, meta: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The rows that ``wanted`` names; a name without a row is an error, as is a plan
    of no or more than ``limit`` rows."""
    j = wanted.join(meta.withColumn("__there", F.lit(True)), key, "left")
    name = F.concat_ws(" ", *[F.col(k).cast("string") for k in key])
    there = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("not known: "), name)).cast("boolean")).otherwise(True)
    return guarded(j.filter(there).drop("__there"), limit, "documents in one plan")


def fetch_plan(rows: DataFrame, minimum: str, wanted: list[str], limit: int) -> DataFrame:
    """Downloadable rows of at least a level; more than ``limit`` is an error."""
    from docketry.operators.metadata import has_any

    rank = F.when(F.col("level") == "HIGH", 3).when(F.col("level") == "MEDIUM", 2).when(F.col("level") == "LOW", 1)
    plan = rows.filter((rank >= RANK[minimum]) & (F.col("availability") == "downloadable") & has_any(F.col("organizations"), wanted))
    return guarded(plan, limit, "documents in one plan")


def guarded(rows: DataFrame, limit: int, what: str) -> DataFrame:
    """``rows``, or an error if there are more than ``limit``."""
    n = rows.groupBy().agg(F.count(F.lit(1)).alias("__n"))  # one row
    checked = rows.crossJoin(F.broadcast(n))
    message = F.concat(F.lit(f"more than {limit} {what}: "), F.col("__n").cast("string"))
    return checked.filter(F.when(F.col("__n") > limit, F.raise_error(message).cast("boolean")).otherwise(True)).drop("__n")


def preflight(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("selected"), F.count_if("cached").alias("cached"), F.count_if((F.col("availability") == "downloadable") & ~F.col("cached")).alias("to_download"),
        F.count_if(F.col("availability") == "listed_only").alias("listed_only"), F.count_if(F.col("availability") == "unknown").alias("unknown"),
    )


def overall_status(statuses: DataFrame, key: str) -> DataFrame:
    """parsed, partial, text_unavailable, unsupported or failed."""
    n = F.count(F.lit(1))
    c = lambda s: F.count_if(F.col("status") == s)
    state = (
        F.when(c("parsed") == n, "parsed").when(c("parsed") > 0, "partial").when(c("text_unavailable") > 0, "text_unavailable").when(c("unsupported") == n, "unsupported").otherwise("failed")
    )
    return statuses.groupBy(key).agg(state.alias("status"))
