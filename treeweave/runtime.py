"""Session helpers shared by the whole library: tables, checkpoints, schema checks."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that ``materialize`` wrote, by the identity of their DataFrame.
_written: dict[int, tuple[weakref.ref, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    all runs in one process, as in local tests, is a temporary folder made and
    set; elsewhere executors would not see it, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="treeweave-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage as ``checkpoint()`` does, survives lost executors, and
    gives the next plan true sizes, so broadcast choices rest on real figures.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these tables, once nothing reads them any more; other tables are left alone.

    Loops call it for the tables of the round before last, so the shared folder
    holds a round or two and not the whole history.
    """
    for df in tables:
        ref, path = _written.pop(id(df), (lambda: None, ""))
        if df is not None and ref() is df:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which the cluster sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until it clashes with no column of ``df``, whatever the case."""
    return free_name(df.columns, wish)


def free_name(columns: list[str], wish: str) -> str:
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def col_of(name: str):
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")
