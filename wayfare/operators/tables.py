"""Fixed dimensions, work tables, and broadcasts behind a check of their size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: mode, label, speed in km/h, longest link in metres; the order is the bit position
MODES = (
    (0, "subway", "Metro", 32.0, 3500.0),
    (1, "brt", "BRT", 20.0, 2500.0),
    (2, "light_rail", "Light rail", 24.0, 3500.0),
    (3, "cable_car", "Cable car", 16.0, 4000.0),
    (4, "commuter_rail", "Commuter rail", 45.0, 12000.0),
    (5, "regional_rail", "Regional rail", 55.0, 16000.0),
    (6, "monorail", "Monorail", 25.0, 4000.0),
)
OTHER_SPEED_KMH, OTHER_LINK_M = 22.0, 3000.0
DWELL_MIN = 0.55
TRANSFER_MIN = 3.0
FALLBACK_WAIT_MIN = 4.0
UNREACHABLE_MIN = 90.0
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 100_000

_LOCAL: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SHARED: dict[tuple[str, str], bool] = {}


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODES, "bit int, mode string, label string, speed_kmh double, max_link_m double")


def lookup(values: dict, key: F.Column, other: float) -> F.Column:
    """A small fixed dimension as an expression."""
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(other))


def speed_kmh(mode: F.Column) -> F.Column:
    return lookup({m: s for _, m, _, s, _ in MODES}, mode, OTHER_SPEED_KMH)


def max_link_m(mode: F.Column) -> F.Column:
    return lookup({m: x for _, m, _, _, x in MODES}, mode, OTHER_LINK_M)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df for a broadcast if it has at most so many rows, else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared(spark: SparkSession, root: str) -> bool:
    """Whether what tasks write under root is there for the driver and for other tasks: each of some tasks writes a row, and all are read back. Asked once for each folder."""
    own, key = spark.sparkContext, (spark.sparkContext.applicationId, root)
    if key not in _SHARED:
        n, path = 2 * own.defaultParallelism, f"{root}/shared-{uuid.uuid4().hex}"
        spark.range(0, n, 1, n).write.parquet(path)
        _SHARED[key] = spark.read.schema("id long").parquet(path).count() == n
        place = own._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(own._jsc.hadoopConfiguration()).delete(place, True)
    return _SHARED[key]


def checked(spark: SparkSession, root: str) -> str:
    """root, if it can hold work tables. A cluster's can be a plain path or a file: URL too, as machines may share a mounted folder; what one of them keeps to itself is refused."""
    root = root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (":" not in root or root.startswith("file:")) and not shared(spark, root):
        raise ValueError(f"{root} isn't shared: set spark.checkpoint.dir to a folder that all executors share")
    return root


def work_root(spark: SparkSession) -> str:
    """The folder for work tables, which all executors share: spark.checkpoint.dir or what setCheckpointDir() was given, else the warehouse's; on a
    local master a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.startswith("local["):
            if not _LOCAL:
                _LOCAL.append(tempfile.mkdtemp(prefix="wayfare-"))
                atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
            return "file://" + _LOCAL[0]
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return checked(spark, root)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    path = f"{work_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def path_of(df: DataFrame) -> str:
    """Where a stored() table lies."""
    return _PATHS[df]


def drop(*tables: DataFrame) -> None:
    """Deletes stored() tables that no frame in use reads any more; others are left alone."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
