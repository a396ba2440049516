"""Session facilities shared by all operators: table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what the session names in ``spark.checkpoint.dir``. Only where that is
    unset (tests, a single machine) a temporary folder is made and set.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    context = spark.sparkContext
    if not path:
        path = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        path = getattr(shared_dir, "_own", None)
        if path is None or not os.path.isdir(path):
            path = shared_dir._own = tempfile.mkdtemp(prefix="tesserine-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage: the files survive the loss of executors.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored_path(df, name))


def stored_path(df: DataFrame, name: str) -> str:
    """As ``stored``, but returns where the files lie."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


#: Where the intermediate tables of this process lie, oldest first.
_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder; ``working_tables`` deletes what is put there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextlib.contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the intermediate tables that were written inside.

    Results are lazy: write or collect them before the end.
    """
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _written[before:]
