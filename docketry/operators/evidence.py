"""Statement extraction, discussion regions and context, as window plans.

Blocks come in order ``pos`` within a ``member`` of a document. The sequential
rules of extraction become windows over (doc, member):

* the heading in force is the last heading at or before a block, allowed or not;
* a label without a body takes the next block's text, and a block that is taken
  is not looked at itself: within a run of such labels every second one is
  taken, so parity in the run decides;
* regions are islands between boundaries, numbered by a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import rules as R

SECTION_CAP = 200


def _w(*key: str):
    return Window.partitionBy(*key).orderBy("pos")


def with_heading(blocks: DataFrame, key: tuple[str, ...] = ("doc_id", "member")) -> DataFrame:
    """Add ``heading``: the text of the last heading up to each block."""
    upto = _w(*key).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("heading", F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(upto))


def with_consumption(blocks: DataFrame, key: tuple[str, ...] = ("doc_id", "member")) -> DataFrame:
    """Add ``taker`` (takes the next block's text) and ``taken``.

    ``eligible``: a label that the role allows, without a body, followed by a
    block that is no heading and not blank.
    """
    w = _w(*key)
    plain_next = F.lead((F.col("type") != "heading") & (F.trim("text") != "")).over(w)
    may = F.coalesce(F.col("eligible") & plain_next, F.lit(False))
    b = blocks.withColumn("__may", may)
    b = b.withColumn("__run", F.sum(F.when(F.col("__may"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(F.col("__may").cast("int")).over(Window.partitionBy(*key, "__run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("taker", F.col("__may") & (nth % 2 == 1))
    return b.withColumn("taken", F.coalesce(F.lag("taker").over(w), F.lit(False))).drop("__may", "__run")


def extract_statements(blocks: DataFrame, key: tuple[str, ...] = ("doc_id", "member")) -> DataFrame:
    """Statements of text blocks (doc_id, member, pos, type, text, role), in the
    order heading, taken, label, inline cue, heading in force.

    A label or cue that the role does not allow ends its block's evaluation and
    is counted: basis 'rejected'. Blocks that say nothing are left out.
    """
    w = _w(*key)
    # The generator keeps the rules from being computed again by each later step.
    found = F.struct(F.when(F.col("type") != "heading", R.label_of(F.col("text"))).alias("label"), R.inline_of(F.col("text"), F.col("role")).alias("inline"))
    b = blocks.select("*", F.explode(F.array(found)).alias("__r")).select(*blocks.columns, "__r.label", "__r.inline")
    b = b.withColumn("label_ok", F.coalesce(R.allowed(F.col("role"), F.col("label.kind")), F.lit(False)))
    b = b.withColumn("eligible", F.coalesce(F.col("label_ok") & (F.col("label.body") == ""), F.lit(False)))
    b = with_heading(with_consumption(b, key), key)
    b = b.withColumn("next_text", F.lead("text").over(w)).withColumn("hk", R.heading_kind(F.col("heading")))
    hk_ok = F.coalesce(R.allowed(F.col("role"), F.col("hk")), F.lit(False))
    row = lambda kind, basis, text: F.struct(kind.alias("kind"), F.lit(basis).alias("basis"), text.alias("statement"))
    none = F.lit(None).cast("string")
    said = (
        F.when((F.col("type") == "heading") | F.col("taken") | (F.trim("text") == ""), None)
        .when(F.col("label").isNotNull() & ~F.col("label_ok"), row(F.col("label.kind"), "rejected", none))
        .when(F.col("label").isNotNull(), row(F.col("label.kind"), "label", F.when(F.col("taker"), F.concat_ws("\n", F.trim("text"), F.col("next_text"))).otherwise(F.trim("text"))))
        .when(F.col("inline").isNotNull() & ~F.col("inline.ok"), row(F.col("inline.kind"), "rejected", none))
        .when(F.col("inline").isNotNull(), row(F.col("inline.kind"), "inline", F.trim("text")))
        .when(hk_ok, row(F.col("hk"), "heading", F.trim("text")))
    )
    out = b.withColumn("s", said).filter("s IS NOT NULL")
    return out.select(*key, "pos", "role", "s.kind", "s.basis", "s.statement")


def table_statements(blocks: DataFrame) -> DataFrame:
    """Per row of a table block: its first labelled cell, whether allowed or not."""
    cells = blocks.filter("type = 'table'").select("doc_id", "pos", "role", F.posexplode("rows").alias("row", "cells")).select("doc_id", "pos", "role", "row", F.posexplode("cells").alias("cell", "text"))
    lab = cells.withColumn("label", R.label_of(F.col("text"))).filter("label IS NOT NULL")
    first = lab.groupBy("doc_id", "pos", "role", "row").agg(F.min_by(F.struct("cell", "text", F.col("label.kind").alias("kind")), "cell").alias("c"))
    ok = F.coalesce(R.allowed(F.col("role"), F.col("c.kind")), F.lit(False))
    return first.select("doc_id", "pos", "row", "c.cell", "c.kind", "c.text", ok.alias("allowed"))


def number_evidence(rows: DataFrame, key: str, order: list) -> DataFrame:
    """A dense sequence from 0 in evidence order."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def member_gate(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """Of meeting reports only blocks of parsed text members count."""
    good = members.filter(F.col("status").isin("parsed") & F.lower("member").rlike(r"\.(?:docx?|pdf)$")).select("doc_id", "member")
    reports = blocks.filter(F.col("role") == R.REPORT).join(good, ["doc_id", "member"], "left_semi")
    return blocks.filter(F.col("role") != R.REPORT).unionByName(reports.select(*blocks.columns))


def regions(blocks: DataFrame, key: tuple[str, ...] = ("doc_id", "member"), cap: int = SECTION_CAP) -> DataFrame:
    """Add region, its size and truncated; regions are cut at ``cap`` blocks.

    A heading starts a run; a table and an unheaded text block stand alone.
    """
    b = with_heading(blocks, key)
    alone = (F.col("type") == "table") | F.col("heading").isNull()
    after_table = F.coalesce(F.lag(F.col("type") == "table").over(_w(*key)), F.lit(False))
    starts = ((F.col("type") == "heading") | alone | after_table).cast("int")
    b = b.withColumn("region", F.sum(starts).over(_w(*key).rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*key, "region")
    b = b.withColumn("in_region", F.row_number().over(own.orderBy("pos"))).withColumn("region_size", F.count(F.lit(1)).over(own))
    return b.withColumn("truncated", F.col("region_size") > cap).filter(F.col("in_region") <= cap)


def associate(anchors: DataFrame, references: DataFrame, key: list[str]) -> DataFrame:
    """Each reference (key, pos, ref) with the anchor (key, pos, anchor) of its own
    block, else its region's first; regions without anchors have none."""
    a = anchors.select(*key, F.col("pos").alias("apos"), "anchor")
    pick = F.struct((F.col("apos") != F.col("pos")).alias("other"), "apos")
    j = references.join(a, key).groupBy(*key, "pos", "ref").agg(F.min_by(F.struct("anchor", "apos"), pick).alias("a"))
    basis = F.when(F.col("a.apos") == F.col("pos"), "same_block").otherwise("same_section")
    return j.select(*key, "pos", "ref", "a.anchor", F.col("a.apos").alias("anchor_pos"), basis.alias("basis"))


def adjacent_context(blocks: DataFrame, hit: Column, k: int, key: tuple[str, ...]) -> DataFrame:
    """Hits with the up to ``k`` non-blank blocks on either side within ``key``.

    A window over positions takes the place of the inequality join.
    """
    around = _w(*key).rangeBetween(-k, k)
    near = F.collect_list(F.when(F.trim("text") != "", F.struct("pos", "text"))).over(around)
    b = blocks.withColumn("hit", hit).withColumn("near", near).filter("hit")
    return b.withColumn("context", F.array_sort(F.filter("near", lambda x: x["pos"] != F.col("pos")))).drop("near", "hit")


def forward_context(blocks: DataFrame, start: Column, label: Column, key: tuple[str, ...], most: int = 3) -> DataFrame:
    """Starts with how many of the following blocks are labelled context: the
    first that is not ends it."""
    w = _w(*key)
    b = blocks.withColumn("start", start).withColumn("__l", F.coalesce(label, F.lit(False)))
    ahead = [F.coalesce(F.lead("__l", i).over(w), F.lit(False)) for i in range(1, most + 1)]
    n, still = F.lit(0), F.lit(True)
    for a in ahead:
        still = still & a
        n = n + still.cast("int")
    return b.withColumn("n_context", n).filter("start").drop("start", "__l")


def heading_path(blocks: DataFrame, levels: int = 6, key: tuple[str, ...] = ("doc_id", "member")) -> DataFrame:
    """Add ``heading_path``: a level's last heading, unless a shallower one came
    after it."""
    upto = _w(*key).rowsBetween(Window.unboundedPreceding, 0)
    b = blocks
    for k in range(1, levels + 1):
        at = F.when(F.col("level") == k, F.struct("pos", "text"))
        b = b.withColumn(f"__h{k}", F.last(at, ignorenulls=True).over(upto))
    path = []
    for k in range(1, levels + 1):
        above = [F.coalesce(F.col(f"__h{j}.pos"), F.lit(-1)) for j in range(1, k)]
        alive = F.col(f"__h{k}").isNotNull()
        for x in above:
            alive = alive & (F.col(f"__h{k}.pos") > x)
        path.append(F.when(alive, F.col(f"__h{k}.text")))
    return b.withColumn("heading_path", F.array_compact(F.array(*path))).drop(*[f"__h{k}" for k in range(1, levels + 1)])


def option_parents(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Consecutive option units take the last unit that introduces options."""
    w = _w(key)
    option = F.col("text").rlike(r"(?i)^\s*Option\s+\d+\s*[:.)]")
    intro = F.col("text").rlike(r"(?i)\b(?:following\s+)?options?\b[^\n.?!]*:\s*$")
    u = units.withColumn("option", option).withColumn("intro", intro & ~option)
    breaks = (~F.col("option")) | (F.lag("pos").over(w) != F.col("pos") - 1)
    u = u.withColumn("island", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(key, "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parent = F.last(F.when(F.col("intro"), F.col("pos")), ignorenulls=True).over(own)
    return u.withColumn("parent", F.when(F.col("option"), parent)).drop("intro", "island")


def matched_span(statements: DataFrame) -> DataFrame:
    """The source span that holds a match of the joined statement.

    ``statements``: id, spans array<struct<start, end>>, m_start, m_end; spans were
    joined with one separator each.
    """
    parts = statements.select("id", "m_start", "m_end", F.posexplode("spans").alias("i", "s"))
    w = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum(F.col("s.end") - F.col("s.start") + 1).over(w), F.lit(0))
    p = parts.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("s.end") - F.col("s.start"))
    inside = p.filter((F.col("lo") <= F.col("m_start")) & (F.col("m_end") <= F.col("hi")))
    return inside.select("id", F.col("i").alias("span"), (F.col("s.start") + F.col("m_start") - F.col("lo")).alias("start"), (F.col("s.start") + F.col("m_end") - F.col("lo")).alias("end"))
