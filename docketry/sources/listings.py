"""Directory pages: links, meetings, lists and documents found in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import rules as R

ANCHOR = r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'


def page_links(pages: DataFrame, page: str = "url", html: str = "html", base: str | None = None) -> DataFrame:
    """(page, pos, name, link): unique links of each page, first occurrence first.

    Empty names, queries, fragments, scripts and dot names are dropped, and with
    ``base`` every link that is not under it.
    """
    found = F.arrays_zip(
        F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ANCHOR), F.lit(2)).alias("label"),
    )
    each = pages.select(F.col(page).alias("page"), F.posexplode(found).alias("pos", "a"))
    origin = F.regexp_extract("page", r"^(https?://[^/]+)", 1)
    href = F.regexp_replace("a.href", "&amp;", "&")
    link = F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(F.regexp_extract("page", r"^([^?#]*/)", 1), href))
    last = F.regexp_extract(F.regexp_replace(link, "/$", ""), r"([^/]*)$", 1)
    name = F.try_url_decode(F.regexp_replace(last, r"\+", "%2B"))
    out = each.withColumn("link", link).withColumn("name", name)
    out = out.filter(~href.rlike(r"(?i)^(?:\?|#|javascript:)") & (href != "") & (F.col("name") != "") & ~F.col("name").isin(".", ".."))
    if base is not None:
        out = out.filter(F.col("link").startswith(base))
    first = F.row_number().over(Window.partitionBy("page", "link").orderBy("pos"))
    return out.withColumn("__n", first).filter("__n = 1").select("page", "pos", "name", "link")


def meetings(links: DataFrame, prefix: str) -> DataFrame:
    """Normalised meetings of links named ``prefix`` + identifier, the last link of
    each; in chronological order."""
    body = F.regexp_extract(F.upper("name"), rf"^{prefix.upper()}(.+)$", 1)
    m = links.withColumn("meeting", R.normalize_meeting(body)).filter("meeting IS NOT NULL")
    last = m.groupBy("meeting").agg(F.max_by("link", F.struct("page", "pos")).alias("link"))
    k = R.meeting_key(F.col("meeting"))
    return last.orderBy(k["number"], k["rank"])


def resolve_meeting(meetings_: DataFrame, wanted: str) -> DataFrame:
    """The literal match, else the only alias match; several are an error."""
    exact = F.upper("meeting") == wanted.upper()
    alias = R.normalize_meeting(F.col("meeting")) == R.normalize_meeting(F.lit(wanted))
    hit = meetings_.filter(exact | alias).withColumn("__e", exact)
    w = Window.partitionBy(F.lit(1))  # at most the aliases of one meeting
    hit = hit.withColumn("__x", F.max("__e").over(w)).filter(F.col("__e") | ~F.col("__x")).withColumn("__n", F.count(F.lit(1)).over(w))
    return hit.filter(F.when(F.col("__n") > 1, F.raise_error(F.lit(f"several meetings for {wanted}")).cast("boolean")).otherwise(True)).drop("__e", "__x", "__n")


def artifacts(links: DataFrame, directories: DataFrame, suffix: str = r"\.[^/.]+$") -> DataFrame:
    """Files in named directories (link): (directory, name, link)."""
    d = directories.select(F.col("link").alias("directory"))
    return links.join(d, F.regexp_replace("page", "/$", "") == F.regexp_replace("directory", "/$", "")).filter(F.col("name").rlike(suffix)).select("directory", "name", "link")


def document_lists(files: DataFrame) -> DataFrame:
    """Files whose name says that they list documents, by link once."""
    low = F.lower("name")
    return files.filter(low.contains("tdoc") & low.contains("list")).dropDuplicates(["link"])


def listed_documents(files: DataFrame, group: str = "R1") -> DataFrame:
    """Documents by a full match of the file name; the last link wins."""
    pattern = rf"^({group}-[0-9]+)(?:\.[^.]+)?$"
    f = files.withColumn("id", F.regexp_extract("name", pattern, 1)).filter("id <> ''")
    return f.groupBy("id").agg(F.max("link").alias("link")).orderBy("id")


def artifact_id(link: Column) -> Column:
    return F.substring(F.sha2(link, 256), 1, 16)


def chair_snapshots(files: DataFrame) -> DataFrame:
    """Note snapshots with their identifier and the role their name gives."""
    return files.select("name", "link", artifact_id(F.col("link")).alias("snapshot_id"), R.chair_label(F.col("name")).alias("role"))


def select_snapshot(snapshots: DataFrame, wanted: str | None = None) -> DataFrame:
    """The ``wanted`` one, else the only final one, else the only one, else ambiguous;
    one row. A wanted one that is not there is an error."""
    n, finals = F.count(F.lit(1)), F.count_if(F.col("role") == "explicit_final")
    if wanted is not None:
        there = F.max(F.when(F.col("snapshot_id") == wanted, F.col("snapshot_id")))
        pick = F.coalesce(there, F.raise_error(F.lit(f"no snapshot {wanted}")).cast("string"))
    else:
        pick = F.when(finals == 1, F.max(F.when(F.col("role") == "explicit_final", F.col("snapshot_id")))).when((finals == 0) & (n == 1), F.max("snapshot_id"))
    return snapshots.agg(n.alias("n"), pick.alias("snapshot_id")).withColumn("state", F.when(F.col("n") == 0, "missing").when(F.col("snapshot_id").isNull(), "ambiguous").otherwise("selected"))
