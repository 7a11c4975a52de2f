"""What an operator needs of the cluster: durable intermediate tables and Arrow batches of a bounded size."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a function over Arrow batches sees at once. Spark bounds the bytes of a batch (maxBytesPerBatch).
BATCH_ROWS = 512
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder takes its place if driver and executors are one machine (a local master, as in
    tests); on a cluster that is an error, since executors would write to disks that the others cannot read."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder; intermediate tables need one that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts the lineage, and survives the loss of any executor.

    The files are removed by ``discard``, or when the driver ends, since a lazy result may still read them before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lexloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.lexloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of ``durable`` that nothing reads any more."""
    entry = (df.sparkSession, df.lexloom_path)
    if entry in _written:
        _written.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; then its folder is the cluster's to clean
            return


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` whose function sees at most BATCH_ROWS rows at once; the session's settings stay as they are."""

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(at, BATCH_ROWS)

    return df.mapInArrow(lambda batches: fn(sliced(batches)), schema)
