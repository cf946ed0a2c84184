"""Readers of the evidence file formats; parsing runs in the tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wickerwork.functions.text import null_text
from wickerwork.operators.skew import lookup_join


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, start, at, line): the lines of files; start is the first byte of the byte range that a task read, at grows along it."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )


def _carried(lines: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """lines with sums (name -> column of numbers) over all lines of the file up to and with each. A byte range is summed by itself; what
    lies before it comes from one row a range, so that a large file is many tasks' work."""
    here = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    per = lines.groupBy("file", "start").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = per.select("file", "start", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    own = lines.withColumns({n: F.sum(c).over(here) for n, c in sums.items()})
    return own.join(before, ["file", "start"]).withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop(*(f"_b_{n}" for n in sums))


def _quoted_records(lines: DataFrame) -> DataFrame:
    """(file, first, record) of delimited files: lines joined where a quoted field goes on; first is the number of a record's first line, from
    1. A line goes on from the one before where the quotes up to it are odd; their number is carried over byte ranges."""
    quotes = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))).cast("long")
    counted = _carried(lines.withColumn("own", quotes), {"quotes": F.col("own"), "line_no": F.lit(1)})
    begins = (F.col("quotes") - F.col("own")) % 2 == 0
    started = _carried(counted.withColumn("begins", begins.cast("long")), {"nth": F.col("begins")})
    whole = started.where("begins = 1 AND own % 2 = 0").select("file", F.col("line_no").alias("first"), F.col("line").alias("record"))
    parts = started.where("NOT (begins = 1 AND own % 2 = 0)").groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    joined = parts.select("file", F.col("l")[0]["line_no"].alias("first"), F.array_join(F.col("l.line"), "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_table(spark: SparkSession, path, schema: StructType, sep: str = ",", bad_rows: str = "fail", nulls: bool = True) -> DataFrame:
    """A delimited table with a header, read as strings and cast by schema; a byte-order mark is tolerated. Quoted fields may hold line
    breaks: then records are put together over the byte ranges of the file (see _quoted_records), which many tasks read.

    bad_rows: 'fail' raises on a row of the wrong width, 'skip' leaves it out. Text that does not fit its type becomes null.
    With nulls, markers of missing values become null.
    """
    mode = {"fail": "FAILFAST", "skip": "DROPMALFORMED"}[bad_rows]
    text = StructType([StructField(f.name, StringType()) for f in schema])
    lines = _lines(spark, path)
    if lines.where((F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1).limit(1).count():
        records = _quoted_records(lines).where("first > 1 AND record <> ''")
        options = {"sep": sep, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": "_bad"}
        parsed = records.select("record", F.from_csv("record", ", ".join(f"`{f.name}` string" for f in [*schema, StructField("_bad", StringType())]), options).alias("r"))
        if bad_rows == "skip":
            raw = parsed.where("r._bad IS NULL").select("r.*")
        else:
            wrong = F.raise_error(F.concat(F.lit("row of the wrong width: "), F.col("record")))
            raw = parsed.select(*(F.when(F.col("r._bad").isNotNull(), wrong).otherwise(F.col(f"r.`{f.name}`")).alias(f.name) for f in schema))
    else:
        raw = (
            spark.read.schema(text)
            .options(header=True, sep=sep, mode=mode, encoding="UTF-8", quote='"', escape='"', multiLine=False, enforceSchema=True)
            .csv(path)
        )
    value = lambda f: null_text(f.name) if nulls else F.col(f.name)
    return raw.select(*(value(f).try_cast(f.dataType).alias(f.name) for f in schema))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """seq_id (first word of the header), header, sequence. Bodies over several lines are joined; of repeated ids the last
    record stays. Records are split by the reader, so a large file is many tasks' work."""
    records = spark.read.option("lineSep", "\n>").text(path).select(
        F.regexp_replace("value", r"^[﻿\s]*>?", "").alias("r"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at")
    )
    records = records.select(
        F.trim(F.regexp_extract("r", r"^([^\r\n]*)", 1)).alias("header"),
        F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"\s+", "")).alias("sequence"),
        "f",
        "at",
    ).where("header <> ''")
    records = records.withColumn("seq_id", F.element_at(F.split("header", r"\s+"), 1))
    last = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("f"), F.desc("at")))
    return records.withColumn("n", last).where("n = 1").select("seq_id", "header", "sequence")


def read_sectioned(spark: SparkSession, path, begin: str, end: str, id_regex: str = r".+", sep: str = "\t") -> DataFrame:
    """file, line_no, fields (array) of the lines between a begin and an end marker line. The first line of a section is its
    header and gives the number of columns; lines of another width, or whose first field does not fit id_regex, are
    left out. Which section a line is in is carried over the byte ranges of a file, so a large one is many tasks' work."""
    lines = _lines(spark, path).withColumn("line", F.regexp_replace("line", "\r$", ""))
    marks = {"begun": (F.col("line") == begin).cast("long"), "ended": (F.col("line") == end).cast("long"), "line_no": F.lit(1)}
    inside = _carried(lines, marks).where((F.col("begun") > F.col("ended")) & (F.col("line") != begin))
    fields = F.transform(F.split("line", sep), lambda x: F.regexp_replace(x, r'^"|"$', ""))
    inside = inside.select("file", (F.col("line_no") - 1).cast("int").alias("line_no"), F.concat_ws(":", "begun", "file").alias("section"), fields.alias("fields"))
    headers = inside.groupBy("section").agg(F.min(F.struct("line_no", F.size("fields").alias("width"))).alias("h"))
    known = lookup_join(inside, headers, "section")
    good = (F.size("fields") == F.col("h.width")) & (F.col("line_no") > F.col("h.line_no")) & F.col("fields")[0].rlike(f"^(?:{id_regex})$")
    return known.where(good).select("file", "line_no", "fields")


def read_sdf_properties(spark: SparkSession, path, props: Sequence[str] | None = None) -> DataFrame:
    """file, record (a number that grows along the file), property, value of SDF property blocks; props: only these. Lines may end in CRLF."""
    records = spark.read.option("lineSep", "$$$$").text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("record"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value")
    )
    shape = F.lit(r">\s*<([^>\n]+)>[^\n]*\r?\n((?:(?!>\s*<)[^\n]+\r?\n?)*)")
    names = F.regexp_extract_all("value", shape, 1)
    values = F.transform(F.regexp_extract_all("value", shape, 2), lambda x: F.trim(F.regexp_replace(x, r"\s+$", "")))
    rows = records.select("file", "record", F.explode(F.arrays_zip(names.alias("property"), values.alias("value"))).alias("p"))
    rows = rows.select("file", "record", "p.property", "p.value")
    return rows.where(F.col("property").isin(*props)) if props else rows


def read_snapshots(spark: SparkSession, path) -> DataFrame:
    """file, file_sha256, position, record (JSON text), record_sha256 of landed JSON: an object with `records`, or an array."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), F.sha2("content", 256).alias("file_sha256"), F.decode("content", "UTF-8").alias("body")
    )
    records = F.from_json(F.coalesce(F.get_json_object("body", "$.records"), F.col("body")), "array<string>")
    rows = files.select("file", "file_sha256", F.posexplode(records).alias("position", "record"))
    return rows.withColumn("record_sha256", F.sha2("record", 256))


def read_keyed_json(spark: SparkSession, paths: Sequence[str], record_schema: str) -> DataFrame:
    """id and the record's fields from a JSON object id -> record; the first path that exists is read. Lists are joined with
    '|', objects are given as JSON text."""
    found = None
    for path in paths:
        try:
            found = spark.read.text(path, wholetext=True)
            break
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
    if found is None:
        raise FileNotFoundError(f"none of {list(paths)}")
    rows = found.select(F.explode(F.from_json("value", f"map<string,struct<{record_schema}>>")).alias("id", "r")).select("id", "r.*")

    def flat(name: str, kind: str):
        if kind.startswith("array"):
            return F.array_join(F.transform(name, lambda x: x.cast("string")), "|").alias(name)
        return F.to_json(name).alias(name) if kind.startswith(("map", "struct")) else F.col(name)

    return rows.select("id", *(flat(c, k) for c, k in rows.dtypes if c != "id"))
