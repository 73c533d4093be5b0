"""Term mining, coverage, merging and accounting over passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T

# A term is at most four words; 40 candidates are listed.
MOST_WORDS, CANDIDATES = 4, 40


def occurrences(passages: DataFrame, phrase: str) -> DataFrame:
    """Each literal occurrence of a phrase, with offsets."""
    found = T.spans(F.col("text"), T.phrase_pattern(phrase))
    return passages.select(*[c for c in passages.columns if c != "text"], F.explode(found).alias("s")).select(*[c for c in passages.columns if c != "text"], "s.start", "s.end", "s.literal")


def candidate_windows(passages: DataFrame, atoms: list[str]) -> DataFrame:
    """Candidate terms: per segment, from the first to one past the last word that
    is a seed atom, two to four words; segments without one, of two to four
    words, are related."""
    seg = passages.filter(T.any_of([F.lower(F.col("text")).contains(a) for a in atoms]))
    seg = seg.select(*[c for c in passages.columns if c != "text"], F.posexplode(F.regexp_extract_all("text", F.lit(r"[^,;/|\n]+"), F.lit(0))).alias("segment", "s"))
    seg = seg.withColumn("words", F.regexp_extract_all("s", F.lit(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"), F.lit(0))).drop("s")
    at = F.filter(F.transform("words", lambda w, i: F.when(F.lower(w).isin(atoms), i)), lambda i: i.isNotNull())
    seg = seg.withColumn("at", at).withColumn("n", F.size("words"))
    first, last = F.array_min("at"), F.array_max("at")
    n = F.least(F.greatest(F.least(last + 1, F.col("n") - 1) - first + 1, F.lit(2)), F.lit(MOST_WORDS))
    term = F.when(F.size("at") > 0, F.slice("words", first + 1, n)).when(F.col("n").between(2, MOST_WORDS), F.col("words"))
    seg = seg.withColumn("term", F.array_join(term, " ")).withColumn("state", F.when(F.size("at") > 0, "candidate").otherwise("related"))
    return seg.filter((F.size(term) >= 2)).drop("words", "at", "n")


def support(found: DataFrame) -> DataFrame:
    """Per (term, state): occurrences, meetings, documents, chair and title
    occurrences and the score n + 3 meetings + 2 documents + 2 chair + titles."""
    f = found.dropDuplicates()
    g = f.groupBy("term", "state").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("meeting").alias("meetings"), F.count_distinct("doc_id").alias("documents"),
        F.count_if(F.col("kind") == "chair").alias("chair"), F.count_if(F.col("kind") == "title").alias("titles"), F.min("meeting").alias("first_meeting"), F.max("meeting").alias("last_meeting"),
    )
    return g.withColumn("score", F.col("n") + 3 * F.col("meetings") + 2 * F.col("documents") + 2 * F.col("chair") + F.col("titles"))


def term_list(terms: DataFrame, limit: int = CANDIDATES, trimmed: tuple[str, ...] = ("candidate", "related")) -> DataFrame:
    """All terms of other states, and the first ``limit`` of the trimmed ones."""
    order = [F.when(F.col("state") == "exact", 0).when(F.col("state") == "candidate", 1).otherwise(2), F.desc("score"), F.lower("term"), F.col("term")]
    limited = F.col("state").isin(*trimmed)
    # Top-k of the limited part, so no window holds all terms.
    top = terms.filter(limited).orderBy(*order).limit(limit)
    return terms.filter(~limited).unionByName(top)


def merge_records(rows: DataFrame, key: str) -> DataFrame:
    """Records of a key as one: united organisations and associations, any flag,
    the meeting only if all agree."""
    one = F.when(F.min("meeting") == F.max("meeting"), F.min("meeting"))
    out = rows.groupBy(key).agg(F.bool_or("flag").alias("flag"), one.alias("meeting"))
    for c in ("orgs", "associations"):
        # Distinct values are combined before they are shuffled.
        united = rows.select(key, F.explode(c).alias("__v")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("__v")).alias(c))
        out = out.join(united, key, "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out.select(key, "orgs", "associations", "flag", "meeting")


def accounting(items: DataFrame, units: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """Units and candidates of each item, zero where there are none."""
    count = lambda d, n: d.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    return items.join(count(units, "units"), key, "left").join(count(candidates, "candidates"), key, "left").na.fill(0, ["units", "candidates"])


def study_counts(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: documents, those indexed and extracted; blocks, statements among
    them, documents with blocks."""
    a = documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if("indexed").alias("indexed"), F.count_if("extracted").alias("extracted"))
    b = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.count_if("statement").alias("statements"), F.count_distinct("doc_id").alias("with_blocks"))
    return a.crossJoin(F.broadcast(b))  # one row each


def timeline(events: DataFrame, key: str, order: Column) -> DataFrame:
    """Events of each key in order."""
    return events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("event").alias("event")))), lambda x: x["event"]).alias("events"))


def distinct_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps once each, in the order of their canonical JSON."""
    j = F.to_json(F.struct(*[F.col(c) for c in sorted(gaps.columns)]))
    return gaps.withColumn("gap", j).dropDuplicates(["gap"]).orderBy("gap")


def capped(rows: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` of each group, with the group's total."""
    # The totals are grouped counts, so the window keeps ``limit`` rows a task.
    totals = rows.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("total"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("n") <= limit)
    return first.join(totals, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def outcomes(blocks: DataFrame, k: int, key: tuple[str, ...], phrase: str) -> DataFrame:
    """Outcome labels with the up to ``k`` following blocks, until a heading or
    another label, where the heading or the text holds the phrase."""
    w = Window.partitionBy(*key).orderBy("pos")
    label = F.col("text").rlike(r"(?iuUd)^\s*(?:Agreements?|Decision|Conclusion|FFS|For further study)(?=\s|:|$)")
    b = blocks.withColumn("label", (F.col("type") != "heading") & label)
    b = b.withColumn("heading", F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    still, n, text = F.lit(True), F.lit(0), F.col("text")
    for i in range(1, k + 1):
        plain = F.coalesce((F.lead("type", i).over(w) != "heading") & ~F.lead("label", i).over(w), F.lit(False))
        still = still & plain
        n = n + still.cast("int")
        text = F.concat(text, F.when(still, F.concat(F.lit("\n"), F.coalesce(F.lead("text", i).over(w), F.lit("")))).otherwise(""))
    out = b.withColumn("n_following", n).withColumn("passage", text).filter("label")
    return out.filter(F.concat_ws(" ", "heading", "passage").rlike(T.phrase_pattern(phrase))).drop("label")
