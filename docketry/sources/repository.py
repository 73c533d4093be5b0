"""A metadata repository of Parquet tables, changed whole generation by generation.

A commit writes the tables it changes beside the others and then adds one numbered
file that names the tables of all; the file of the greatest number counts. Nothing
is ever replaced: a reader sees all tables of a commit or none, at any moment, and a
commit that fails leaves the one before. Of two commits that change the same table
from the same version, one fails. Older versions stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import metadata as M
from docketry.sources import store


def data_root(spark: SparkSession, explicit: str | None = None) -> str:
    """The given root, else the session's ``docketry.data.root``, else ``data``."""
    return explicit or spark.conf.get("docketry.data.root", None) or "data"


class Repository:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only

    def version(self) -> int:
        """The number of the last commit; 0 if there is none."""
        return max((int(n) for n in store.names(self.spark, f"{self.root}/commits") if n.isdigit()), default=0)

    def _pointer(self, version: int) -> dict[str, str]:
        return json.loads(store.read_text(self.spark, f"{self.root}/commits/{version:012d}")) if version else {}

    def tables(self) -> list[str]:
        return sorted(self._pointer(self.version()))

    def table(self, name: str, schema: str | None = None, version: int | None = None) -> DataFrame:
        """A table of the last commit, or of ``version``; an absent one is empty, if its
        schema is given."""
        path = self._pointer(self.version() if version is None else version).get(name)
        if path is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.parquet(path)
        if schema is None:
            return rows
        # Columns that an older generation has not are null.
        fields = self.spark.createDataFrame([], schema).schema.fields
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def commit(self, since: int | None = None, **changed: DataFrame) -> None:
        """Replace the given tables, all or none.

        ``since`` is the version that they were made from, by default the present one:
        if another commit has changed one of them after it, this one is an error and
        changes nothing. Commits to other tables do not matter.
        """
        if self.read_only:
            raise PermissionError("the repository is open for reading only")
        then = self._pointer(self.version() if since is None else since)
        written = {name: f"{self.root}/{name}/{uuid.uuid4().hex}" for name in changed}
        for name, rows in changed.items():
            rows.write.parquet(written[name])
        while True:
            now = self.version()
            pointer = self._pointer(now)
            clash = sorted(n for n in written if pointer.get(n) != then.get(n))
            if clash:
                raise RuntimeError(f"changed by another commit: {', '.join(clash)}")
            try:
                return store.create_text(self.spark, f"{self.root}/commits/{now + 1:012d}", json.dumps(pointer | written, sort_keys=True))
            except FileExistsError:
                if self.version() == now:  # not taken by a commit
                    raise

    def import_manifest(self, meeting: str, artifacts: DataFrame, snapshots: DataFrame, rows: DataFrame) -> None:
        """One unit of work: artifacts are upserted, a meeting's snapshots replaced, the
        current flag of its documents cleared and then set by the ``rows``."""
        since = self.version()
        old = self.table("artifacts", artifacts._jdf.schema().toDDL(), since)
        known = self.table("snapshots", snapshots._jdf.schema().toDDL(), since)
        docs = self.table("documents", rows._jdf.schema().toDDL(), since)
        cleared = docs.withColumn("current", F.col("current") & (F.col("meeting") != meeting))
        merged = M.upsert_keep(cleared.withColumnRenamed("current", "__c"), rows.withColumnRenamed("current", "__c"), ["id", "meeting"]).withColumnRenamed("__c", "current")
        self.commit(
            since,
            artifacts=M.upsert_keep(old, artifacts, ["url"]),
            snapshots=known.filter(F.col("meeting") != meeting).unionByName(snapshots),
            documents=merged.select(*rows.columns),
        )


# --- manifests ------------------------------------------------------------------

#: Fields of older manifests by their present names.
RENAMED = {"records": "rows", "checksum": "digest", "file": "path"}


def write_manifest(spark: SparkSession, root: str, name: str, outputs: dict[str, dict], expected: dict[str, int]) -> str:
    """A receipt of written outputs (``store.write_records`` entries); row counts that
    do not agree are an error. Written beside and moved into place."""
    for k, n in expected.items():
        if outputs[k]["rows"] != n:
            raise ValueError(f"{k} has {outputs[k]['rows']} rows, expected {n}")
    path, beside = f"{root.rstrip('/')}/{name}", f"{root.rstrip('/')}/{name}.{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps({"name": name, "outputs": outputs}, sort_keys=True),)], "value string").coalesce(1).write.text(beside)
    store.swap(spark, beside, path)
    return path


def read_manifest(spark: SparkSession, path: str, schemas: dict, hydrate: bool = True) -> tuple[dict, dict[str, DataFrame]]:
    """The receipt, with older field names read as the present ones, and, if wanted,
    its outputs, whose digests are checked."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    outputs = {k: {RENAMED.get(f, f): v for f, v in entry.items()} for k, entry in found["outputs"].items()}
    tables = {k: store.read_records(spark, outputs[k], s) for k, s in schemas.items()} if hydrate else {}
    return found | {"outputs": outputs}, tables


def save_artifact(rows: DataFrame, root: str, kind: str, key: list[str]) -> str:
    """Rows as an artifact named by its content; its identifier."""
    entry = store.write_records(rows, f"{root.rstrip('/')}/{kind}", "a", key)
    return f"{entry['path'].rsplit('/', 1)[1]}@{entry['digest']}"


def load_artifact(spark: SparkSession, root: str, kind: str, artifact: str, schema) -> DataFrame:
    """The rows of an artifact; an error if they are not what its identifier says."""
    name, digest = artifact.split("@")
    return store.read_records(spark, {"path": f"{root.rstrip('/')}/{kind}/{name}", "digest": digest}, schema)
