"""Shared helpers: word rules, staged tables and vectorised tokenisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


_OWN: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where that is unset, a
    folder of the warehouse, or, if the driver is the only executor, one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
                _OWN[app] = tempfile.mkdtemp(prefix="docketry-")
                atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
            else:
                _OWN[app] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/docketry-{app}"
        at = _OWN[app]
    return at.rstrip("/")


#: Whether a query's shuffle files are deleted when it ends, not at some later collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, own: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of ``df``,
    and later stages read the same rows however often they run. With ``own``, to which
    the table is added for ``drop_staged``, the shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if own is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if own is not None:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _STAGED.append((spark, path))
    if own is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(spark: SparkSession, own: list[str]) -> None:
    """Delete the tables ``own``, which nothing reads any more."""
    for path in own:
        _delete(spark, path)
    _STAGED[:] = [x for x in _STAGED if x[1] not in own]
    own.clear()


def clear_staged(spark: SparkSession) -> int:
    """Delete the tables that this process has staged in ``spark``'s application; the
    frames that read them must be done with. Returns how many there were."""
    app = spark.sparkContext.applicationId
    mine = [x for x in _STAGED if x[0].sparkContext.applicationId == app]
    for x in mine:
        _delete(spark, x[1])
        _STAGED.remove(x)
    return len(mine)


#: A key is hot if it has more than this share of the rows, and more rows than that.
HOT_SHARE, HOT_ROWS = 20_000, 500


def hot_keys(counts: DataFrame, on: list[str], total: int) -> DataFrame | None:
    """Of ``counts`` (``on``, __n) the hot keys, with the parts that each is dealt to;
    None if there are none. At most ``HOT_SHARE`` keys can be hot."""
    most = max(HOT_ROWS, total // HOT_SHARE)
    hot = counts.filter(F.col("__n") > most).select(*on, F.ceil(F.col("__n") / F.lit(float(most))).cast("int").alias("__parts"))
    hot = staged(hot, "hot")
    return None if hot.isEmpty() else hot


def counted(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose keys ``on`` are unique, however many rows
    of ``left`` a key has.

    Rows of a key in ``hot`` (``hot_keys``, broadcast) are dealt to its parts by a
    hash of ``by``, and the row of ``right`` is repeated for each part.
    """
    if hot is None:
        return left.join(right, on, how)
    parts = F.coalesce("__parts", F.lit(1))
    a = left.join(F.broadcast(hot), on, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    b = right.join(F.broadcast(hot), on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return a.join(b, [*on, "__part"], how).drop("__part")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shards_for(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))


# --- vectorised words -------------------------------------------------------

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence extended on its right by one element."""
    with np.errstate(over="ignore"):
        return mix((np.asarray(left, dtype=np.uint64) * _GOLD) ^ mix(np.asarray(right, dtype=np.uint64) + _GOLD))


def hash_words(words) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    if len(words) == 0:
        return np.empty(0, dtype=np.uint64)
    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=False)


class Words:
    """The words of a batch of texts: ``ids`` into ``vocab``, with ``counts`` per text."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        flat = parts.values[int(offsets[0]) : int(offsets[-1])] if len(offsets) else parts.values
        offsets = offsets - (offsets[0] if len(offsets) else 0)
        real = np.asarray(pc.fill_null(pc.not_equal(flat, ""), False))
        seen = np.concatenate(([0], np.cumsum(real)))
        flat = flat.filter(pa.array(real))
        enc = flat.dictionary_encode()
        self.vocab = enc.dictionary.to_numpy(zero_copy_only=False)
        self.ids = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = seen[offsets[1:]]
        self.starts = seen[offsets[:-1]]
        self.counts = self.ends - self.starts
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = hash_words(self.vocab)
        return self._hashes

    def stream(self) -> np.ndarray:
        """The hash of each word in order."""
        return self.hashes[self.ids] if len(self.ids) else np.empty(0, dtype=np.uint64)


def as_array(column) -> pa.Array:
    """An Arrow string column as one array of its own, whatever it is a slice of."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    # Copied: string kernels go wrong on a cast slice.
    return column.take(pa.array(range(len(column)), pa.int64())) if column.offset else column
