"""Building blocks of the distributed operators: staging, range order, skew-proof lookups."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key with more rows than this is handled apart from the hash join. The keys above it
#: number at most rows / HOT_ROWS, which is what bounds every broadcast of hot keys.
HOT_ROWS = 1_000_000

OPEN_END = (1 << 63) - 1

_staged: list[tuple[SparkSession, str]] = []


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only if unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    path = "file://" + tempfile.mkdtemp(prefix="veritrail-")
    _staged.append((spark, path))
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for spark, path in _staged:
        try:
            _drop(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


atexit.register(_drop_all)


@contextmanager
def staging() -> Iterator[None]:
    """Tables that are staged inside are removed at its end, so that a long-lived driver does not fill the
    shared folder. What is derived from them must be written or collected inside."""
    mark = len(_staged)
    try:
        yield
    finally:
        for spark, path in _staged[mark:]:
            _drop(spark, path)
        del _staged[mark:]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts lineage without machine-local storage: a lost executor costs a re-read, never a wrong
    result. The table is removed when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def _code() -> str:
    """A hash of this package's source: what older code derived is not taken for what this would."""
    root = Path(__file__).resolve().parent.parent
    return hashlib.sha256(b"".join(p.read_bytes() for p in sorted(root.rglob("*.py")))).hexdigest()[:12]


def fingerprint(*sources: DataFrame) -> str:
    """A hash of the files that ``sources`` read: their paths, lengths and times of change."""
    spark = sources[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    said = []
    for source in sources:
        for name in sorted(source.inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            status = path.getFileSystem(conf).getFileStatus(path)
            said.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:24]


def derived_path(name: str, *sources: DataFrame) -> tuple[str, bool]:
    """Where a table that is derived from ``sources`` is kept in the shared folder, and if it is there whole.

    The path names the files it is derived from and the code that does it, so a change of either
    makes another table; readers never meet one that is out of date.
    """
    spark = sources[0].sparkSession
    path = f"{shared_dir(spark)}/{name}-{_code()}-{fingerprint(*sources)}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return path, done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def derived(name: str, build: Callable[[], DataFrame], *sources: DataFrame) -> DataFrame:
    """The table that ``build`` derives from ``sources``: made once, then read while these stay as they are."""
    path, there = derived_path(name, *sources)
    if not there:
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return sources[0].sparkSession.read.parquet(path)


def in_range_order(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in global order of ``cols``: range-partitioned, then sorted inside each partition."""
    return df.repartitionByRange(width(df.sparkSession), *cols).sortWithinPartitions(*cols)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``left`` to ``right`` (unique on ``keys``), safe when one key is hot.

    ``right`` carries in column ``rows`` how many rows of ``left`` have the key. Keys above
    ``hot_rows`` are broadcast (at most |left| / hot_rows of them); all others are joined by
    shuffle, so no task gets more than ``hot_rows`` rows of one key.
    """
    hot = right.filter(F.col(rows) > hot_rows).drop(rows)
    cold = right.filter(F.col(rows) <= hot_rows).drop(rows)
    marks = F.broadcast(hot.select(*keys))
    return left.join(F.broadcast(hot), keys).unionByName(left.join(marks, keys, "left_anti").join(cold, keys))
