"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..checkpoints import checkpoint_dir
from ..shipping import ship

BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named, a new temporary one on one machine (as in tests), and an error on a cluster."""
    return checkpoint_dir(spark)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table of written() that nothing reads any more; only what lies in the session's shared folder is touched."""
    own = scratch_dir(df.sparkSession).split(":", 1)[-1]
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if own in folder and folder.rsplit("/", 1)[-1].startswith("table-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A small table of the driver's. It goes as Arrow, so that no executor starts further Python workers to read pickled rows."""
    names = [c.split(" ", 1)[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    fields = [pa.array(columns[n], kinds[c.split(" ", 1)[1]]) for n, c in zip(names, schema.split(", "))]
    return spark.createDataFrame(pa.Table.from_arrays(fields, names))


def released() -> None:
    """Give freed memory back to the system: workers live on between stages, and what they keep counts beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, which give back what a task has freed.

    Batches are bounded by bytes, too (``BATCH``, or less if the session says so): each is held several times, in the executor and its worker.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BYTES).removesuffix("b")) <= BATCH:
        conf.set(BYTES, str(BATCH))

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        released()

    return df.mapInArrow(task, schema)
