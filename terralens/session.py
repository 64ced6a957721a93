"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def build_session(app="terralens", master=None, shuffle_partitions=None):
    """A session with the settings the jobs are tuned for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: AQE
    coalesces small shuffles and splits skewed join partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_dir(spark, name):
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    A local session without that setting uses its ``spark.local.dir``; on a cluster the setting is required, as
    executors do not see each other's folders.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = spark.conf.get("spark.local.dir", "/tmp").split(",")[0]
    return f"{shared.rstrip('/')}/terralens-{name}-{uuid.uuid4().hex}"


def materialise(df, name):
    """Write ``df`` once to the shared folder and read it back: later steps neither recompute it nor depend on executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark):
    """Gives the Python workers of all executors this package, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "terralens_shipped", False):
        return
    folder = os.path.join(SparkFiles.getRootDirectory(), "shipped")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "terralens.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for top, _, names in os.walk(PACKAGE):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(top, name)
                bundle.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    context.terralens_shipped = True
