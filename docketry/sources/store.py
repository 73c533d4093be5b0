"""Content-addressed JSON lines with integrity checks, and tables by key."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, else the warehouse;
    a temporary one only where the driver is the only executor."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="docketry-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        return _OWN[app]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, p = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver itself, without a job."""
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, whole or not at all; ``FileExistsError`` if there is one.

    It is written beside and renamed. Of two writers at once one fails where a
    rename refuses a name that is taken, as HDFS does; elsewhere the name is looked
    up just before.
    """
    fs, p = _file_system(spark, path)
    folder, name = path.rsplit("/", 1)
    _, w = _file_system(spark, f"{folder}/_{name}.{uuid.uuid4().hex}")
    out = fs.create(w, False)
    out.write(text.encode())
    out.close()
    if fs.exists(p) or not fs.rename(w, p):
        fs.delete(w, False)
        raise FileExistsError(path)


def swap(spark: SparkSession, written: str, path: str) -> None:
    """Put a whole written folder in the place of ``path``."""
    fs, p = _file_system(spark, path)
    _, w = _file_system(spark, written)
    fs.delete(p, True)
    fs.mkdirs(p.getParent())
    if not fs.rename(w, p):
        raise OSError(f"cannot rename {written} to {path}")


def logical_digest(df: DataFrame) -> str:
    """A SHA-256 of the rows whatever their order and partitions, and their number.

    Rows are hashed one by one; their SHA-256 digests are added up in parts of 60
    bits, so nothing is collected or sorted, and the sums are hashed.
    """
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16, 31, 46)]
    *sums, n = df.agg(*lanes, F.count(F.lit(1))).first()
    return hashlib.sha256(",".join(str(x or 0) for x in [*sums, n]).encode()).hexdigest() + f"-{n}"


def write_records(df: DataFrame, root: str, name: str, key: list[str]) -> dict:
    """Write gzip JSON lines at a path named by content; same rows, same path.

    Returns the manifest entry: path, digest and rows. The rows are written beside
    and moved into place whole, so a path that is there is a whole one; one that
    holds other rows is an error.
    """
    spark, digest = df.sparkSession, logical_digest(df)
    path = f"{root.rstrip('/')}/{name}-{digest[:16]}"
    entry = {"path": path, "digest": digest, "rows": int(digest.rsplit("-", 1)[1])}
    if exists(spark, path):
        read_records(spark, entry, df.schema)
        return entry
    beside = f"{path}.{uuid.uuid4().hex}"
    df.sortWithinPartitions(*key).write.option("compression", "gzip").option("ignoreNullFields", "false").json(beside)
    swap(spark, beside, path)
    return entry


def read_records(spark: SparkSession, entry: dict, schema: StructType) -> DataFrame:
    """The rows of a manifest entry; an error if they are not what was written."""
    df = spark.read.schema(schema).json(entry["path"])
    found = logical_digest(df)
    if found != entry["digest"]:
        raise ValueError(f"integrity error: {entry['path']} has {found}, expected {entry['digest']}")
    return df


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte_size, sha256) of files, on the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def conflicts(known: DataFrame, found: DataFrame) -> DataFrame:
    """Immutable files whose bytes changed: path, before, after."""
    b = known.select("path", F.col("sha256").alias("before"))
    return found.join(b, "path").filter("before <> sha256").select("path", "before", F.col("sha256").alias("after"))


def overwrite_keys(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace exactly the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def validated(blocks: DataFrame, receipts: DataFrame) -> DataFrame:
    """Documents whose blocks are as their receipt says: (doc_id, reason or null).

    Dense numbers from 1, unique (member, block) and the receipt's count.
    """
    g = blocks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("order").alias("last"), F.count_distinct("order").alias("orders"), F.count_distinct("member", "block_id").alias("ids")
    )
    j = receipts.join(g, "doc_id", "left")
    reason = (
        F.when(F.col("status") != "parsed", "not parsed").when(F.col("n").isNull(), "no blocks").when(F.col("n") != F.col("block_count"), "block count")
        .when((F.col("last") != F.col("n")) | (F.col("orders") != F.col("n")), "order not dense").when(F.col("ids") != F.col("n"), "blocks repeat")
    )
    return j.select("doc_id", reason.alias("reason"))
