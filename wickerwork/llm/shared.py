"""Tables that outlive lost executors, and small column helpers the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What Spark hands to a Python worker at a time, whatever the texts' lengths: bounds the memory of worker and executor.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master without that setting gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def durable(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wickerwork/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to BATCH_BYTES; a lower one stays. All operators that hand texts to Python
    call this, as the setting counts when a plan runs, which may be after the operator has returned."""
    found = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(_BATCH_SETTING, "256m").strip().lower())
    now = int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_by_weight(groups: DataFrame, count: str) -> tuple[DataFrame, DataFrame]:
    """groups (one row a key, count its rows) as (hot, cold). Hot keys hold more than 1/(4 n) of all counted rows, n the shuffle partitions:
    so there are fewer than 4 n, a proven bound for a broadcast, and a cold key is too small for a hot task."""
    share = (groups.agg(F.sum(count)).first()[0] or 0) / (4 * partitions_of(groups.sparkSession))
    return groups.where(F.col(count) > share), groups.where(F.col(count) <= share)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of one byte a character take the fast built-in."""
    one_byte = F.octet_length(text) == F.length(text)
    return F.when(one_byte, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
