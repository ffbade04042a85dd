"""Session-level helpers: shared folder, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _written.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_written() -> None:
    """Deletes the intermediate tables of this process; results derived from them are gone with the session anyway."""
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent - local sessions, as in tests - a folder of our own is made and set.
    """
    global _own_dir
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="newsloom-")
        atexit.register(shutil.rmtree, _own_dir, True)
        spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a compressed columnar copy that every executor can read, so a lost executor costs a task
    retry and never a recomputation of earlier stages.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written[path] = spark
    return path


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` gave, once all that needs them is materialized itself."""
    for t in tables:
        path = getattr(t, "_newsloom_path", None)
        if path in _written:
            _remove(path)


class BitFilter:
    """A filter of fixed size over 64-bit hashes: what was put in passes, most else doesn't.

    Its 2^bits bits are all that is broadcast, whatever the number of hashes; a fuller filter lets more through and loses
    nothing, so callers check what passes by a join or by value.
    """

    def __init__(self, hashes: DataFrame, bits: int):
        """``hashes`` has one bigint column. Bits are set in words of 64 on the map side; only words reach the driver."""
        self.shift = 64 - bits
        (name,) = hashes.columns
        slots = hashes.select(F.shiftrightunsigned(name, self.shift).alias("slot"))
        words = slots.groupBy((F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
        filled = np.zeros(1 << max(bits - 6, 0), np.uint64)
        filled[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        self._shared = hashes.sparkSession.sparkContext.broadcast(filled)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(self.shift)
        return ((self._shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ``key``: the one delivered last (greatest ``order``, nulls first); ties keep one of the equal rows.

    Implemented as a max over a struct so that the map side already reduces re-deliveries.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    return (
        df.groupBy(key)
        .agg(F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_r"))
        .select(key, F.col(f"_r.{order}").alias(order), *[F.col(f"_r.{c}").alias(c) for c in rest])
    )
