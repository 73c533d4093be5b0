"""Acquisition: bytes are landed once, normalised once, and both have a receipt.

Bytes and blocks are only ever added, each run's in a generation of its own, and
count from the moment that a commit of the receipts names that generation. A run
that fails, or that another run's commit overtakes, leaves the receipts as they
were; what it wrote is never read.

Fetching runs on the executors, file by file, and its result is written before
anything reads it, so that no URL is asked for twice in a run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import rules as R
from docketry.operators import inventory as I
from docketry.operators import metadata as M
from docketry.sources import listings, packages, store
from docketry.sources.directory import get_with_retry, http_bytes
from docketry.sources.repository import Repository

Fetch = Callable[[str], bytes]

#: Raised when a parser or the form of blocks changes, so that they are made anew.
VERSION = "1"
LANDED = "url string, sha256 string, content binary, error string"
RECEIPT = "id string, url string, sha256 string, identity string, status string, block_count long, references long, raw string, blocks string"
STORED = "url string, member string, block_id string, order int, type string, text string, level int, heading_path array<string>, rows array<array<string>>, page int, sheet string"


def fetched(urls: DataFrame, fetch: Fetch) -> DataFrame:
    """The bytes of each URL, once, or why there are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["url"]:
                content, error = None, None
                try:
                    content = get_with_retry(url, fetch)
                except (OSError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"url": [url], "content": [content], "error": [error]})

    got = urls.select("url").distinct().mapInPandas(run, "url string, content binary, error string")
    return got.select("url", F.sha2("content", 256).alias("sha256"), "content", "error")


def refuse(rows: DataFrame, message) -> None:
    """An error with the first of ``rows``' messages, if there are any."""
    first = rows.select(message.alias("m")).limit(1).collect()
    if first:
        raise ValueError(first[0]["m"])


class Bodies:
    """Bodies of documents: their raw bytes, their blocks and their receipts."""

    def __init__(self, repo: Repository, kind: str, fetch: Fetch = http_bytes, version: str = VERSION):
        self.repo, self.kind, self.fetch, self.spark = repo, kind, fetch, repo.spark
        self.version = f"{version}:{','.join(sorted(packages.PARSERS))}"
        self.root = f"{repo.root}/{kind}"

    def receipts(self, version: int | None = None) -> DataFrame:
        return self.repo.table(f"{self.kind}_receipts", RECEIPT, version)

    def _identity(self, sha256):
        return F.sha2(F.concat_ws("|", sha256, F.lit(self.version)), 256)

    def _read(self, what: str, schema: str) -> DataFrame:
        path = f"{self.root}/{what}"
        schema += ", generation string"
        return self.spark.read.schema(schema).parquet(path) if store.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def raw(self) -> DataFrame:
        """Landed bytes that a receipt names."""
        named = self.receipts().select("url", F.col("raw").alias("generation")).distinct()
        return self._read("raw", LANDED).join(named, ["url", "generation"], "left_semi")

    def _normalise(self, files: DataFrame, generation: str) -> DataFrame:
        """Write the blocks of files (url, content), numbered through all members of a
        file; (url, status, block_count, references)."""
        members = packages.package_members(files.select(F.col("url").alias("path"), "content"))
        beside = f"{self.root}/parsed/{generation}"
        packages.parse_blocks(members).write.parquet(beside)
        parsed = self.spark.read.parquet(beside)
        order = F.row_number().over(Window.partitionBy("path").orderBy("nth", "pos"))
        found = parsed.filter("pos IS NOT NULL").withColumn("order", order)
        found = found.select(F.col("path").alias("url"), F.col("filename").alias("member"), F.format_string("b%06d", "order").alias("block_id"), "order", "type", "text", "level", "heading_path", "rows", "page", "sheet")
        found.write.parquet(f"{self.root}/blocks/generation={generation}")
        blocks = self._read("blocks", STORED).filter(F.col("generation") == generation)
        literal = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(R.REFERENCE_CHAIR), F.lit(0)))
        in_rows = F.aggregate(F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))), F.lit(0), lambda n, c: n + F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(R.REFERENCE_CHAIR), F.lit(0))))
        counts = blocks.groupBy("url").agg(F.count(F.lit(1)).alias("block_count"), F.sum(literal + in_rows).alias("references"))
        status = I.overall_status(parsed.select(F.col("path").alias("url"), "nth", "status").distinct(), "url")
        return status.join(counts, "url", "left").na.fill(0, ["block_count", "references"])

    def execute(self, plan: DataFrame, refresh: bool = False) -> DataFrame:
        """Land and normalise what a plan (id, url, availability) names: (id, status, message).

        What is only listed or not known to be there is skipped; what was landed is
        not fetched again (with ``refresh`` it is, and must not have changed), and not
        normalised again unless its identity changed. A file that fails harms no
        other; provenance that is not what a receipt says stops the run, and all
        receipts stay as they were.
        """
        generation, since = uuid.uuid4().hex, self.repo.version()
        old = self.receipts(since)
        wanted = plan.filter((F.col("availability") == "downloadable") & F.col("url").isNotNull()).select("id", "url").distinct()
        clash = wanted.join(old.select("id", F.col("url").alias("known")), "id").filter("url <> known")
        refuse(clash, F.concat(F.lit("another source than its receipt says: "), "id"))
        kept = wanted.join(old, ["id", "url"])
        landing = f"{self.root}/raw/generation={generation}"
        fetched(wanted if refresh else wanted.join(old, "url", "left_anti"), self.fetch).write.parquet(landing)
        new = self._read("raw", LANDED).filter(F.col("generation") == generation)
        same = new.filter("error IS NULL").join(old.select("url", F.col("sha256").alias("before")).distinct(), "url").filter("sha256 <> before")
        refuse(same, F.concat(F.lit("changed since it was landed: "), "url"))
        new = new.join(old, "url", "left_anti")
        stale = kept.filter(F.col("identity") != self._identity(F.col("sha256")))
        files = new.filter("error IS NULL").select("url", "sha256", "content", "generation")
        if not stale.isEmpty():  # else no landed bytes are read
            files = files.unionByName(self.raw().join(stale.select("url").distinct(), "url", "left_semi").select(files.columns))
        done = self._normalise(files, generation).join(files.select("url", "sha256", F.col("generation").alias("raw")), "url")
        ids = wanted.join(kept.join(stale, "id", "left_anti").select("id"), "id", "left_anti")
        made = ids.join(done, "url").withColumn("identity", self._identity(F.col("sha256"))).withColumn("blocks", F.lit(generation))
        columns = [c.split()[0] for c in RECEIPT.split(", ")]
        # Documents at a URL that another one has landed share its bytes and blocks.
        shared = ids.join(done, "url", "left_anti").join(old.drop("id").dropDuplicates(["url"]), "url")
        merged = M.upsert_keep(old.select(columns), made.select(columns).unionByName(shared.select(columns)), ["id"])
        self.repo.commit(since, **{f"{self.kind}_receipts": merged.select(columns)})
        now = self.receipts().select("id", "status", "raw", "blocks")
        failed = ids.join(new.filter("error IS NOT NULL").select("url", "error"), "url").select("id", "error")
        reach = F.when(F.col("availability") == "listed_only", "only listed").when(~F.col("availability").eqNullSafe("downloadable") | F.col("url").isNull(), "availability not known")
        message = reach.when(F.col("error").isNotNull(), F.col("error")).when(F.col("blocks") != generation, "reused").when(F.col("raw") != generation, "normalised again").otherwise("downloaded")
        status = F.when(reach.isNotNull(), "not_fetched").when(F.col("error").isNotNull(), "failed").otherwise(F.col("status"))
        return plan.select("id", "url", "availability").distinct().join(now, "id", "left").join(failed, "id", "left").select("id", status.alias("status"), message.alias("message"))

    def blocks(self) -> DataFrame:
        """The blocks of all documents, as their receipts name them."""
        named = self.receipts().select("id", "url", F.col("blocks").alias("generation"))
        return self._read("blocks", STORED).join(named, ["url", "generation"]).drop("url", "generation")

    def invalid(self) -> DataFrame:
        """(id, reason) of all receipts that do not hold: raw bytes gone or changed, made
        by another version, or blocks not as many, dense and distinct as they say."""
        return self._invalid(self.receipts(), self.raw(), self.blocks())

    def _invalid(self, receipts: DataFrame, raw: DataFrame, blocks: DataFrame) -> DataFrame:
        found = raw.select("url", F.col("generation").alias("raw"), F.sha2("content", 256).alias("bytes"))
        b = blocks.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("order").alias("last"), F.count_distinct("member", "block_id").alias("ids"))
        j = receipts.join(found, ["url", "raw"], "left").join(b, "id", "left").na.fill(0, ["n", "last", "ids"])
        reason = (
            F.when(F.col("bytes").isNull(), "raw bytes missing").when(F.col("bytes") != F.col("sha256"), "raw bytes changed").when(F.col("identity") != self._identity(F.col("sha256")), "stale")
            .when(F.col("n") != F.col("block_count"), "block count").when((F.col("last") != F.col("n")) | (F.col("ids") != F.col("n")), "blocks repeat")
        )
        return j.select("id", reason.alias("reason")).filter("reason IS NOT NULL")

    def load(self, id_: str) -> DataFrame:
        """One document's blocks in order; an error if its receipt does not hold. Reads
        that document's generations only."""
        one = self.receipts().filter(F.col("id") == id_)
        r = one.first()
        if r is None:
            raise ValueError(f"not normalised: {id_}")
        mine = lambda what, schema, generation: self._read(what, schema).filter((F.col("generation") == generation) & (F.col("url") == r["url"]))
        blocks = mine("blocks", STORED, r["blocks"]).drop("url", "generation").withColumn("id", F.lit(id_))
        refuse(self._invalid(one, mine("raw", LANDED, r["raw"]), blocks), F.concat_ws(": ", "id", "reason"))
        return blocks.orderBy("order")


# --- note snapshots -----------------------------------------------------------------

#: Raised when the rules that find or label snapshots change.
RULES = "1"
NOTE = "id string, grp string, meeting string, url string, name string, role string, ruleset string, discovered_at timestamp"


class Notes:
    """Discovered note snapshots (their receipts) and their bodies."""

    def __init__(self, repo: Repository, fetch: Fetch = http_bytes, rules: str = RULES):
        self.repo, self.rules, self.bodies = repo, rules, Bodies(repo, "notes", fetch)

    def discover(self, files: DataFrame, group: str, meeting: str, now) -> DataFrame:
        """Add files (name, link) as snapshots of a meeting. One that is known keeps its
        first time and gets the labels of the present rules."""
        found = listings.chair_snapshots(files).select(
            F.col("snapshot_id").alias("id"), F.lit(group).alias("grp"), F.lit(meeting).alias("meeting"), F.col("link").alias("url"), "name", "role",
            F.lit(self.rules).alias("ruleset"), F.lit(now).cast("timestamp").alias("discovered_at"),
        ).dropDuplicates(["id"])
        since = self.repo.version()
        old = self.repo.table("notes", NOTE, since)
        known = old.select("id", F.col("url").alias("__url"), F.col("discovered_at").alias("__at"))
        refuse(found.join(known, "id").filter("url <> __url"), F.concat(F.lit("identity of another file: "), "url"))
        kept = found.join(known, "id", "left").withColumn("discovered_at", F.least("discovered_at", "__at")).select(old.columns)
        self.repo.commit(since, notes=M.upsert_keep(old, kept, ["id"]).select(old.columns))
        return self.inventory(group, meeting)

    def inventory(self, group: str, meeting: str) -> DataFrame:
        """A meeting's snapshots in order; an error if older rules labelled any."""
        rows = self.repo.table("notes", NOTE).filter((F.col("grp") == group) & (F.col("meeting") == meeting))
        refuse(rows.filter(F.col("ruleset") != self.rules), F.concat(F.lit("discover again, labelled by older rules: "), "url"))
        return rows.orderBy("url", "id")

    def select(self, group: str, meeting: str, wanted: str | None = None) -> DataFrame:
        return listings.select_snapshot(self.inventory(group, meeting).withColumnRenamed("id", "snapshot_id"), wanted)

    def fetch(self, group: str, meeting: str) -> DataFrame:
        """Land and normalise all snapshots of a meeting."""
        return self.bodies.execute(self.inventory(group, meeting).select("id", "url", F.lit("downloadable").alias("availability")))

    def load(self, group: str, meeting: str, wanted: str | None = None) -> DataFrame:
        """The blocks of the selected snapshot, checked."""
        found = self.select(group, meeting, wanted).first()  # one row
        if found["state"] != "selected":
            raise ValueError(f"{found['state']}: {found['n']} snapshots")
        return self.bodies.load(found["snapshot_id"])


# --- meetings -------------------------------------------------------------------------


def ingest_meeting(repo: Repository, pages: DataFrame, meeting: str, fetch: Fetch, aliases: dict[str, list[str]], wanted: str | None = None) -> DataFrame:
    """From a meeting's directory pages (url, html) to its documents, in one commit.

    Lists named on the pages are landed and read; one that cannot be is a snapshot
    with ``parse_error``. The current list (or ``wanted``) is applied last, over the
    other lists in order of time and over the directory, which with the current list
    says which documents there are. Returns the snapshots.
    """
    spark, columns = repo.spark, ["title", "status", "url"]
    links = listings.page_links(pages)
    lists = listings.document_lists(links)
    names = lists.select(F.col("link").alias("url"), "name", R.snapshot_role(F.col("name")).alias("role"), R.filename_timestamp(F.col("name")).alias("stamp"))
    if wanted and names.filter(F.col("url") == wanted).isEmpty():
        raise ValueError(f"no list {wanted}")
    generation = uuid.uuid4().hex
    landing = f"{repo.root}/lists/raw/generation={generation}"
    fetched(names, fetch).write.parquet(landing)
    landed = spark.read.schema(LANDED).parquet(landing)
    old = repo.table("artifacts", "url string, meeting string, sha256 string, raw string")
    clash = landed.join(old.select("url", F.col("sha256").alias("before")), "url").filter("sha256 <> before")
    refuse(clash, F.concat(F.lit("changed since it was landed: "), "url"))
    read = f"{repo.root}/lists/cells/{generation}"
    packages.list_cells(landed.filter("error IS NULL").select(F.col("url").alias("path"), "content")).write.parquet(read)
    cells = spark.read.parquet(read)
    heads = packages.header_rows(cells.filter("error IS NULL"), aliases)
    rows = packages.list_rows(cells.filter("error IS NULL").drop("error"), heads)
    good = rows.filter("id IS NOT NULL AND NOT superseded")
    n = good.groupBy(F.col("path").alias("url")).agg(F.count(F.lit(1)).alias("rows"))
    bad = cells.filter("error IS NOT NULL").select(F.col("path").alias("url"), "error").unionByName(landed.filter("error IS NOT NULL").select("url", "error"))
    read_ = names.join(bad, "url", "left").join(heads.select(F.col("path").alias("url"), F.lit(True).alias("__head")), "url", "left").join(n, "url", "left")
    error = F.coalesce("error", F.when(F.col("__head").isNull(), "no header that names documents"))
    snapshots = read_.select(F.lit(meeting).alias("meeting"), "url", "name", "role", "stamp", error.alias("parse_error"), F.when(error.isNull(), F.coalesce("rows", F.lit(0))).alias("rows"))
    pick = snapshots.select("meeting", F.col("url").alias("source_url"), "role", F.col("stamp").alias("snapshot_timestamp"))
    chosen = [wanted] if wanted else [r["source_url"] for r in M.snapshot_for_role(pick, "meeting").collect()]  # at most one row
    value = lambda c: F.col("fields")[c] if c in aliases else F.lit(None).cast("string")
    listed = good.select("id", F.col("path").alias("list"), value("title").alias("title"), value("status").alias("status"), F.lit(None).cast("string").alias("url"))
    current = listed.filter(F.col("list").isin(chosen)).drop("list")
    age = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("stamp").asc_nulls_first(), "url"))  # the lists of one meeting
    others = listed.join(names.select(F.col("url").alias("list"), age.alias("apply_order")), "list").filter(~F.col("list").isin(chosen)).drop("list")
    directory = listings.listed_documents(links).select("id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("status"), F.col("link").alias("url"))
    view = M.current_view(directory, current, others, "id", columns)
    repo.import_manifest(
        meeting,
        landed.filter("error IS NULL").select("url", F.lit(meeting).alias("meeting"), "sha256", F.lit(generation).alias("raw")),
        snapshots,
        view.select("id", F.lit(meeting).alias("meeting"), *columns, F.lit(True).alias("current")),
    )
    return repo.table("snapshots").filter(F.col("meeting") == meeting)
