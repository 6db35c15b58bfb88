"""What a session needs to run this package's Python functions on its executors."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each context, unless their path has it already."""
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if _ROOT in paths or "site-packages" in str(_ROOT) or any("loomgraph.zip" in f for f in context.listFiles):
        return
    folder = tempfile.mkdtemp(prefix="loomgraph-code-")  # on the driver, which serves the file to the executors
    with zipfile.ZipFile(archive := f"{folder}/loomgraph.zip", "w") as z:
        for p in sorted((_ROOT / "loomgraph").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    context.addPyFile(archive)
    sys.path[:] = [p for p in sys.path if not p.endswith("loomgraph.zip")]  # addPyFile put it before the sources


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see.

    Where it is unset, a session with its executors in its own process gets a folder of its own; on a
    cluster that is an error, as a folder of one machine is none of the others'.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        found = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, found, True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def spread(df: DataFrame, column: str) -> DataFrame:
    """df by a column over so many tasks that all cores have work; adaptive execution would join them again where bytes are few, however long they take."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), column)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there; loops stay cheap and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever filesystem it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
