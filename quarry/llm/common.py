"""Shared plumbing: scratch tables in the shared folder, shipping of code to executors, words.

Arrow batches are bounded in bytes by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set), and the
operators' functions take a batch in groups of texts of a megabyte or two.
Intermediate tables lie in a folder of the application; results that are not yet read depend on them, so they go when the
process ends (``drop_all``), or once ``settled`` has written what was made of them.
"""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts spell it.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Stands in for a null doc_id where an order is needed: null comes last.
LAST_ID = (1 << 63) - 1
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Tables written so far in this process, in order.
_MADE: list[str] = []
#: Temporary folders of local sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def ship(module: str) -> None:
    """Pickle this module's functions by value, so executors need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def kept(name: str, make):
    """make(), kept in this Python worker until another name is asked for: one cache at a time, over
    tasks. (Functions that are pickled by value get new globals with every task.)"""
    slot = sys.__dict__.setdefault("_quarry_slot", {})
    if name not in slot:
        slot.clear()
        gc.collect()
        slot[name] = make()
    return slot[name]


def small_batches(spark: SparkSession) -> None:
    """Texts are long: batches of ``BATCH_ROWS`` rows where the session and its context have no setting of their own. A setting, be it the default's value, stays."""
    if BATCH not in spark.conf.getAll and not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{scratch_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into the shared folder and read back: cuts lineage and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make, name: str) -> DataFrame:
    """make(), written; the tables that it wrote on the way are deleted."""
    first = len(_MADE)
    out = written(make(), name)
    for path in _MADE[first:-1]:
        drop_path(spark, path)
    del _MADE[first:-1]
    return out


def drop_all(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; results that were not written are lost with them."""
    drop_path(spark, f"{scratch_dir(spark)}/quarry/{spark.sparkContext.applicationId}")
    _MADE.clear()


@atexit.register
def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _MADE else None
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_all(spark)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """A written table, to be sent to every executor if it has no more rows than that; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


ship(__name__)
