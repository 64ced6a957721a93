"""Tables written once to the folder that the whole cluster sees."""

from __future__ import annotations

import gc
import tempfile
import uuid

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark, name):
    """A new folder below ``spark.checkpoint.dir``; only a local session without that setting gets a temporary one."""
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df, name):
    """``df`` written to the shared folder and read again: later steps neither recompute it nor need its executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark):
    """Has the driver collect its garbage between the steps of a long job.

    Spark drops the shuffle files and broadcasts of finished steps only when the driver's heap is collected, which a
    driver with little data of its own puts off, growing its heap instead.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows and bytes of text that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark):
    """Keeps the session's Arrow batches small: their buffers stand outside the heap, on both sides, in every task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def gathered(batches, take, size, most):
    """Lists of what ``take`` makes of consecutive batches, with at most about ``most`` entries by ``size`` in each."""
    held, total = [], 0
    for batch in batches:
        for found in take(batch):
            held.append(found)
            total += size(found)
            if total >= most:
                yield held
                held, total = [], 0
    if held:
        yield held


def shuffle_partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
