"""Cutting lineage: write a table once to the shared folder of the cluster and read it back.

A table read back has known rows and bytes, which decide how it is joined. The files are
ordinary Parquet in shared storage, so a lost executor costs nothing but a re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; only a local session may fall back to a folder of its own."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            named = tempfile.mkdtemp(prefix="skyload-")
        context.setCheckpointDir(named)
        folder = context.getCheckpointDir()
    return folder


# Folders of the tables staged by this process.
STAGED: list[str] = []

# What is known of the heavy keys of tables, by plan; the tables of heavy keys are staged tables too.
PROFILES: dict[tuple, DataFrame | None] = {}

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def fit_generated_code(spark: SparkSession) -> None:
    """Let Spark split generated methods that are too long for the JVM to compile.

    HotSpot leaves methods above 8000 bytes interpreted, Spark's default limit is 65535. Scaling some 30
    features makes such methods and then runs twenty times slower. Any other value
    that the session has is kept; results do not depend on it.
    """
    if spark.conf.get(METHOD_LIMIT) == "65535":
        spark.conf.set(METHOD_LIMIT, "8000")


def stage(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written now."""
    spark = df.sparkSession
    fit_generated_code(spark)
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remembered(kind: str, df: DataFrame, parts: Sequence, make: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The answer of ``make`` for the plan of ``df``, found once per session and plan.

    Only for what steers the balance of a job and never its result: the files behind a plan may change meanwhile.
    """
    label = (kind, df.sparkSession.sparkContext.applicationId, df.semanticHash(), *map(str, parts))
    if label not in PROFILES:
        PROFILES[label] = make()
    return PROFILES[label]


def release_staged(spark: SparkSession) -> int:
    """Delete the tables staged so far by this process; call it when all results are written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    released = 0
    PROFILES.clear()
    while STAGED:
        path = hadoop.Path(STAGED.pop())
        released += bool(path.getFileSystem(configuration).delete(path, True))
    return released
