"""Metadata with provenance: merges, upserts, current views and resolution.

A metadata row carries a ``layer`` (its authority) and an ``apply_order``; rows
of one key fold into one by aggregates, so any number of sources merges in one
shuffle. Plain Parquet has no MERGE; upserts are full outer joins that return
the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """Null and empty values are no values."""
    return c.isNotNull() & (c.cast("string") != "")


def merge_by_provenance(rows: DataFrame, key: list[str], ranked: list[str], first: list[str] = (), flags: list[str] = (), maps: list[str] = ()) -> DataFrame:
    """One row per key. ``ranked``: the present value of highest (layer,
    apply_order); ``first``: the earliest present one; ``flags``: any;
    ``maps``: union, later layers winning."""
    rank, age = F.struct("layer", "apply_order"), F.struct(-F.col("layer"), -F.col("apply_order"))
    # A value that is absent must not win where every rank is null.
    aggs = [F.max_by(F.when(present(F.col(c)), F.col(c)), F.when(present(F.col(c)), rank)).alias(c) for c in ranked]
    aggs += [F.max_by(F.when(present(F.col(c)), F.col(c)), F.when(present(F.col(c)), age)).alias(c) for c in first]
    aggs += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags]
    out = rows.groupBy(*key).agg(*aggs)
    for m in maps:
        # The last value of each entry, combined before it is shuffled.
        each = rows.select(*key, "layer", "apply_order", F.explode(m).alias("__k", "__v")).groupBy(*key, "__k").agg(F.max_by("__v", F.struct("layer", "apply_order")).alias("__v"))
        whole = each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(m))
        out = out.join(whole, key, "left")
    return out


def current_view(directory: DataFrame, current: DataFrame, supplements: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Directory and current list drive; supplements (with apply_order) fill only
    what is driven; the current list is applied last."""
    keys = directory.select(key).union(current.select(key)).distinct()
    rows = (
        directory.select(key, *columns, F.lit(1).alias("layer"), F.lit(0).cast("long").alias("apply_order"))
        .unionByName(supplements.join(keys, key, "left_semi").select(key, *columns, F.lit(2).alias("layer"), F.col("apply_order").cast("long").alias("apply_order")))
        .unionByName(current.select(key, *columns, F.lit(2).alias("layer"), F.lit(2**62).alias("apply_order")))
    )
    return merge_by_provenance(rows, [key], columns)


def _joined(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, list[str]]:
    rest = [c for c in old.columns if c not in key]
    n = new.select(*key, *[F.col(c).alias(f"__{c}") for c in rest], F.lit(True).alias("__new"))
    return old.withColumn("__old", F.lit(True)).join(n, key, "full_outer"), rest


def upsert_keep(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New values where there are any, else the old ones."""
    j, rest = _joined(old, new, key)
    return j.select(*key, *[F.coalesce(f"__{c}", c).alias(c) for c in rest])


def upsert_artifacts(old: DataFrame, new: DataFrame, key: list[str], overwrite: list[str], earliest: str, checksum: str) -> DataFrame:
    """``overwrite`` columns take the new row's value, ``earliest`` the least, the
    rest the new one if there is any; a checksum that differs is an error."""
    j, rest = _joined(old, new, key)
    clash = F.col(checksum).isNotNull() & F.col(f"__{checksum}").isNotNull() & (F.col(checksum) != F.col(f"__{checksum}"))
    out = []
    for c in rest:
        if c in overwrite:
            out.append(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        elif c == earliest:
            out.append(F.least(c, f"__{c}").alias(c))
        elif c == checksum:
            out.append(F.when(clash, F.raise_error(F.concat(F.lit("checksum conflict: "), *[F.col(k).cast("string") for k in key]))).otherwise(F.coalesce(f"__{c}", c)).alias(c))
        else:
            out.append(F.coalesce(f"__{c}", c).alias(c))
    return j.select(*key, *out)


def upsert_last(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` of each key; of equal ones the new row."""
    rows = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("__n"))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__n")


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that ``new`` has are replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def query_rows(meta: DataFrame, title: str | None = None, status: str | None = None, organization: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """Conjunction of the given conditions: title and status are ILIKE patterns
    (% and _ are wildcards), an organisation matches case-folded and whole."""
    out = meta
    if groups:
        out = out.filter(F.col("working_group").isin(groups))
    if title is not None:
        out = out.filter(F.ilike(F.col("title"), F.lit(f"%{title}%")))
    if status is not None:
        out = out.filter(F.ilike(F.col("status"), F.lit(status)))
    if "current_view_present" in meta.columns:
        out = out.filter("current_view_present")
    if organization is not None:
        out = out.filter(F.exists("organizations", lambda o: F.lower(o) == organization.casefold()))
    return out


def has_all(orgs: Column, wanted: list[str]) -> Column:
    """Every wanted organisation is there (search, evidence)."""
    low = F.transform(orgs, F.lower)
    return F.forall(F.array(*[F.lit(w.casefold()) for w in wanted]), lambda w: F.array_contains(low, w))


def has_any(orgs: Column, wanted: list[str]) -> Column:
    """Some wanted organisation is there, or none is wanted (inventory, planning)."""
    if not wanted:
        return F.lit(True)
    return F.arrays_overlap(F.transform(orgs, F.lower), F.array(*[F.lit(w.casefold()) for w in wanted]))


def resolve_precedence(references: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Each reference's metadata by precedence.

    ``candidates``: key, tier, rank, signature, url, value. Of the best (tier,
    rank) more than one signature is ambiguous, none unresolved; else the least
    url's row is taken.
    """
    best = candidates.withColumn("__d", F.dense_rank().over(Window.partitionBy(key).orderBy("tier", "rank"))).filter("__d = 1")
    one = best.groupBy(key).agg(
        F.count_distinct("signature").alias("n"), F.min_by("value", F.struct("url", "value")).alias("value"), F.min("tier").alias("tier")
    )
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    out = references.join(one, key, "left")
    return out.select(*references.columns, state.alias("state"), F.when(F.col("n") == 1, F.col("value")).alias("value"), "tier")


def exactly_one(references: DataFrame, meta: DataFrame, key: str, meeting: str) -> DataFrame:
    """resolved_here, resolved_elsewhere, ambiguous or unresolved, by the number of
    metadata rows of a reference."""
    g = meta.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(meeting).alias("found"))
    out = references.join(g, key, "left")
    state = (
        F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").when(F.col("found") == F.col(meeting), "resolved_here").otherwise("resolved_elsewhere")
    )
    return out.withColumn("state", state)


def snapshot_rows(rows: DataFrame, headers: DataFrame, on: Column, value: Column, wanted: str, order: list[str]) -> DataFrame:
    """List rows with their snapshot's header where ``value`` reads ``wanted`` in any
    case, in order of time."""
    return rows.join(headers, on).filter(F.upper(value) == wanted.upper()).orderBy(*order)


def difference(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows that ``other`` has not."""
    return rows.subtract(other)


def point_lookup(rows: DataFrame, **key: object) -> DataFrame:
    """The rows of a key; normalised identifiers are equal in any case."""
    out = rows
    for name, value in key.items():
        c = F.col(name)
        out = out.filter(F.lower(c) == value.lower() if isinstance(value, str) else c == value)
    return out


def distinct_by_digest(*tables: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Union of tables, one row for each digest of ``columns``: the one of greatest
    ``order``."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    rest = [c for c in out.columns if c != order]
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
    best = out.withColumn("digest", digest).groupBy("digest").agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r"))
    return best.select("digest", "__r.*")


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.col("snapshot_timestamp").asc_nulls_last(), "source_url")


def snapshot_for_role(snapshots: DataFrame, key: str) -> DataFrame:
    """Per key: the current list, else the close, else the latest historical one."""
    order = F.struct(F.col("snapshot_timestamp").isNotNull(), "snapshot_timestamp", "source_url")
    pick = lambda role: F.max_by(F.when(F.col("role") == role, F.col("source_url")), F.when(F.col("role") == role, order))
    return snapshots.groupBy(key).agg(F.coalesce(pick("current"), pick("close"), pick("historical"), F.max("source_url")).alias("source_url"))


def known_keys(*tables: DataFrame) -> DataFrame:
    """UNION DISTINCT of one-column tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()


def expand_range(spark, start: int, end: int, known: DataFrame) -> DataFrame:
    """Integers of the range and the known suffixed identifiers inside it."""
    from docketry.functions.rules import meeting_key

    plain = spark.range(start, end + 1).select(F.col("id").cast("string").alias("meeting"))
    k = meeting_key(F.col("meeting"))
    inside = ((k["number"] > start) | (k["number"] == start)) & ((k["number"] < end) | ((k["number"] == end) & (k["rank"] == 0)))
    return plain.union(known.select("meeting").filter(inside)).distinct()


def review_history(reviews: DataFrame, key: str) -> DataFrame:
    """Latest review of each key, and whether its history is 1..n, each review
    superseding the one before."""
    w = Window.partitionBy(key).orderBy("sequence")
    ok = (F.col("sequence") == F.row_number().over(w)) & F.col("supersedes").eqNullSafe(F.lag("review_id").over(w))
    return reviews.withColumn("__ok", ok).groupBy(key).agg(
        F.max_by("decision", "sequence").alias("decision"), F.max("sequence").alias("n_reviews"), F.bool_and("__ok").alias("valid")
    )
