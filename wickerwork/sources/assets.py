"""Inventories, profiles, checksums and exports."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerwork.operators.skew import heavy_keys


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, extension of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    return files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))


def scan_assets(spark: SparkSession, root: str, rules: Sequence[tuple[str, str]], key_assets: Sequence[str] = ()) -> DataFrame:
    """list_files with database_guess (the first rule (substring, name) that fits the path, case folded) and is_key_asset (the
    path ends with one of key_assets)."""
    files, guess = list_files(spark, root), None
    for part, name in rules:
        guess = (F if guess is None else guess).when(F.lower("path").contains(part.lower()), name)
    guess = F.lit("unknown") if guess is None else guess.otherwise("unknown")
    key = F.lit(False)
    for k in key_assets:
        key = key | F.col("path").endswith(k)
    return files.withColumns({"database_guess": guess, "is_key_asset": key})


def asset_summary(assets: DataFrame) -> DataFrame:
    return assets.groupBy("database_guess").agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if("is_key_asset").alias("key_assets")
    )


def file_headers(spark: SparkSession, path) -> DataFrame:
    """file and its first line. Each task keeps one line a file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def profile(df: DataFrame, count_cols: Sequence[str] = ()) -> DataFrame:
    """(metric, key, value): rows, columns, an order-free digest of the contents, and value counts of count_cols. The digest is
    a sum of row hashes, so repeated rows do not cancel; everything is combined before the shuffle."""
    digest = F.sum(F.xxhash64(*(F.col(c) for c in df.columns)).cast("decimal(38,0)"))
    total = df.agg(F.count("*").alias("n"), digest.alias("d"))
    head = total.select(
        F.explode(
            F.array(
                F.struct(F.lit("rows").alias("metric"), F.lit("").alias("key"), F.col("n").cast("string").alias("value")),
                F.struct(F.lit("columns").alias("metric"), F.lit("").alias("key"), F.lit(str(len(df.columns))).alias("value")),
                F.struct(F.lit("digest").alias("metric"), F.lit("").alias("key"), F.coalesce(F.col("d").cast("string"), F.lit("0")).alias("value")),
            )
        ).alias("r")
    ).select("r.*")
    if not count_cols:
        return head
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")) for c in count_cols))).alias("r"))
    return head.union(cells.groupBy("r.metric", "r.key").agg(F.count("*").cast("string").alias("value")))


def profile_index(frames: Mapping[str, DataFrame], count_cols: Sequence[str] = ()) -> DataFrame:
    """The profiles of many tables in one: dataset, metric, key, value."""
    out = None
    for name, df in frames.items():
        one = profile(df, [c for c in count_cols if c in df.columns]).select(F.lit(name).alias("dataset"), "*")
        out = one if out is None else out.union(one)
    return out


def stream_digest(uri: str, block: int = 4 << 20) -> tuple[str, int]:
    """SHA-256 and length of a file of any size, read a block at a time, from any store that pyarrow opens."""
    local = re.fullmatch(r"file:/*(/.*)", uri)
    store, path = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    digest, size = hashlib.sha256(), 0
    with store.open_input_stream(path) as stream:
        while data := stream.read(block):
            digest.update(data)
            size += len(data)
    return digest.hexdigest(), size


def verify_checksums(spark: SparkSession, expected: DataFrame, root: str) -> DataFrame:
    """expected(path relative to root, sha256[, bytes]) with exists and valid. Only names and lengths of files come from the listing; digests are
    taken in the tasks by streaming, a file to a task, in a block's memory. Only files that are expected are read."""
    base = root.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        F.col("path").alias("uri"), F.expr(f"substring(path, instr(path, '{base.split('://')[-1]}') + {len(base.split('://')[-1]) + 1})").alias("path"), "length"
    )
    wanted = listed.join(expected.select("path").distinct(), "path", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [stream_digest(uri) for uri in batch["uri"]]
            yield pd.DataFrame({"path": batch["path"], "actual_sha256": [d for d, _ in found], "actual_bytes": [n for _, n in found]})

    dealt = wanted.repartition(max(1, spark.sparkContext.defaultParallelism), F.xxhash64("path"))
    found = dealt.mapInPandas(run, "path string, actual_sha256 string, actual_bytes long")
    joined = expected.join(found, "path", "left")
    valid = F.lower("sha256") == F.col("actual_sha256")
    if "bytes" in expected.columns:
        valid = valid & (F.col("bytes").isNull() | (F.col("bytes") == F.col("actual_bytes")))
    return joined.withColumns({"exists": F.col("actual_sha256").isNotNull(), "valid": F.coalesce(valid, F.lit(False))})


#: Rows of a value that one exported file holds, about.
EXPORT_ROWS = 1_000_000


def export_by(df: DataFrame, col: str, path: str, mode: str = "error", rows_per_file: int = EXPORT_ROWS) -> None:
    """One folder per value of col. A value of many rows is dealt to as many files as its count asks for; heavy values are few (see
    heavy_keys), all others are one file each."""
    heavy = F.broadcast(heavy_keys(df, col, rows_per_file).select(col, F.col("parts").alias("_files")))
    salted = df.join(heavy, col, "left").withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.coalesce("_files", F.lit(1))))
    salted.repartition(F.col(col), F.col("_salt")).select(*df.columns).write.mode(mode).partitionBy(col).parquet(path)


def asset_readiness(required: DataFrame, inventory: DataFrame) -> DataFrame:
    """required(plugin, capability, path) against inventory(path): required and present assets and the status."""
    joined = required.join(inventory.select("path", F.lit(True).alias("present")).distinct(), "path", "left")
    out = joined.groupBy("plugin", "capability").agg(F.count("*").alias("required"), F.count_if(F.col("present")).alias("present"))
    return out.withColumn("status", F.when(F.col("required") == F.col("present"), "ready").otherwise("blocked_missing_assets"))
