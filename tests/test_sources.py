"""Readers and file operators on files that the tests write."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from wickerwork.sources import assets, readers


def test_read_table(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("﻿id,name,x\n1,\"a,b\",2.5\n2,NaN,zz\n3,c\n".encode())
    schema = StructType([StructField("id", IntegerType()), StructField("name", StringType()), StructField("x", DoubleType())])
    got = readers.read_table(spark, str(path), schema, bad_rows="skip").collect()
    assert [tuple(r) for r in got] == [(1, "a,b", 2.5), (2, None, None)]
    with pytest.raises(Exception):
        readers.read_table(spark, str(path), schema).collect()
    tsv = tmp_path / "t.tsv"
    tsv.write_text("id\tname\tx\n7\tq\t1\n")
    assert readers.read_table(spark, str(tsv), schema, sep="\t").first()["x"] == 1.0


def test_read_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">s1 first one\nMK\nv a\n>s2\nGG\n>s1 again\nTT\n")
    got = {r.seq_id: (r.header, r.sequence) for r in readers.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"s1": ("s1 again", "TT"), "s2": ("s2", "GG")}


def test_read_sectioned(spark, tmp_path):
    (tmp_path / "m.txt").write_text('!head\n!begin\n"ID"\tA\tB\n"p1"\t1\t2\np2\t3\n??\t4\t5\np3\t6\t7\n!end\np4\t8\t9\n')
    got = readers.read_sectioned(spark, str(tmp_path / "m.txt"), "!begin", "!end", r"p\d+").orderBy("line_no").collect()
    assert [r.fields for r in got] == [["p1", "1", "2"], ["p3", "6", "7"]]


def test_read_sdf(spark, tmp_path):
    (tmp_path / "x.sdf").write_text("mol\n\n> <ID>\nC1\n\n> <SMILES>\nCCO\n\n$$$$\nmol\n> <ID>\nC2\n\n$$$$\n")
    rows = readers.read_sdf_properties(spark, str(tmp_path / "x.sdf")).orderBy("record", "property").collect()
    assert [(r.property, r.value) for r in rows] == [("ID", "C1"), ("SMILES", "CCO"), ("ID", "C2")]
    assert readers.read_sdf_properties(spark, str(tmp_path / "x.sdf"), ["ID"]).count() == 2


def test_read_snapshots(spark, tmp_path):
    body = json.dumps({"records": [{"a": 1}, {"a": 2}]})
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.json").write_text(body)
    (tmp_path / "s/two.json").write_text('[{"b": 3}]')
    rows = readers.read_snapshots(spark, str(tmp_path / "s")).orderBy("file", "position").collect()
    assert [json.loads(r.record) for r in rows] == [{"a": 1}, {"a": 2}, {"b": 3}]
    assert rows[0].file_sha256 == hashlib.sha256(body.encode()).hexdigest() and rows[0].record_sha256 == hashlib.sha256(rows[0].record.encode()).hexdigest()


def test_read_keyed_json(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"r1": {"names": ["a", "b"], "n": 3, "m": {"x": 1}}}))
    r = readers.read_keyed_json(spark, [str(tmp_path / "absent.json"), str(tmp_path / "k.json")], "names array<string>, n int, m struct<x:int>").first()
    assert (r.id, r.names, r.n, r.m) == ("r1", "a|b", 3, '{"x":1}')
    with pytest.raises(FileNotFoundError):
        readers.read_keyed_json(spark, [str(tmp_path / "absent.json")], "n int")


def test_assets(spark, tmp_path):
    (tmp_path / "kegg").mkdir()
    (tmp_path / "kegg/a.tsv").write_text("id\tname\n1\tx\n")
    (tmp_path / "b.CSV").write_text("q\n")
    got = assets.scan_assets(spark, str(tmp_path), [("KEGG", "kegg")], ["a.tsv"])
    assert {(r.extension, r.database_guess, r.is_key_asset) for r in got.collect()} == {("tsv", "kegg", True), ("csv", "unknown", False)}
    assert {r.database_guess: (r.files, r.bytes) for r in assets.asset_summary(got).collect()} == {"kegg": (1, 12), "unknown": (1, 2)}
    assert {r.header for r in assets.file_headers(spark, str(tmp_path / "kegg")).collect()} == {"id\tname"}
    want = [("kegg/a.tsv", hashlib.sha256(b"id\tname\n1\tx\n").hexdigest(), 12), ("b.CSV", "0" * 64, 2), ("no.txt", "0" * 64, None)]
    checked = assets.verify_checksums(spark, spark.createDataFrame(want, "path string, sha256 string, bytes long"), str(tmp_path))
    assert {r.path: (r.exists, r.valid) for r in checked.collect()} == {"kegg/a.tsv": (True, True), "b.CSV": (True, False), "no.txt": (False, False)}
    needed = spark.createDataFrame([("p", "c", "x"), ("p", "c", "y"), ("q", "c", "x")], "plugin string, capability string, path string")
    ready = assets.asset_readiness(needed, spark.createDataFrame([("x",)], "path string"))
    assert {r.plugin: r.status for r in ready.collect()} == {"p": "blocked_missing_assets", "q": "ready"}


def test_profile_digest_ignores_order_and_sees_repeats(spark):
    df = spark.range(50).withColumn("v", F.col("id") % 3)
    digest = lambda d: assets.profile(d).where("metric = 'digest'").first()["value"]
    assert digest(df) == digest(df.orderBy(F.desc("id"))) != digest(df.union(df.limit(1)))
    assert {r.key: r.value for r in assets.profile(df, ["v"]).where("metric = 'v'").collect()} == {"0": "17", "1": "17", "2": "16"}


def test_export_by(spark, tmp_path):
    assets.export_by(spark.range(20).withColumn("g", F.col("id") % 2), "g", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/g=1")).count() == 10


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_sdf_lines_may_end_in_crlf(spark, tmp_path, end):
    lines = ["mol", "M  END", "> <ID>", "A1", "", "> <NOTE>", "two", "lines", "", "$$$$", "mol", "M  END", "> <ID>", "B2", "", "$$$$", ""]
    (tmp_path / "x.sdf").write_bytes(end.join(lines).encode())
    rows = readers.read_sdf_properties(spark, f"file://{tmp_path}/x.sdf").orderBy("record", "property").collect()
    assert [(r.property, r.value) for r in rows] == [("ID", "A1"), ("NOTE", "two\nlines"), ("ID", "B2")]
    assert len({r.record for r in rows}) == 2


def test_quoted_line_breaks_over_byte_ranges(spark, tmp_path):
    import csv

    rows = [(str(i), ["plain", 'has "quotes"', "two\nlines", "three\n\n\"lines\"\r\nhere", "a,b", "", "ends in break\n"][i % 7] + ("x" * (i % 300)), str(i / 4)) for i in range(3000)]
    schema = StructType([StructField("id", IntegerType()), StructField("note", StringType()), StructField("x", DoubleType())])
    for n, end in (("a", "\n"), ("b", "\r\n")):
        with (tmp_path / f"{n}.csv").open("w", newline="", encoding="utf-8-sig") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "note", "x"])
            w.writerows(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.read_table(spark, str(tmp_path), schema, nulls=False)
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10
        got = sorted((r.id, r.note, r.x) for r in df.collect())
        want = sorted([(int(a), b, float(c)) for a, b, c in rows] * 2)
        assert [(a, b or "", c) for a, b, c in got] == want
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad/c.csv").write_text('id,note,x\n1,"a\nb",2\n2,c\n\n3,"d\n",4\n')
        assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "bad"), schema, bad_rows="skip", nulls=False).orderBy("id").collect()] == [(1, "a\nb", 2.0), (3, "d\n", 4.0)]
        with pytest.raises(Exception, match="wrong width"):
            readers.read_table(spark, str(tmp_path / "bad"), schema).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sections_over_byte_ranges(spark, tmp_path):
    lines, want = ["!head"], []
    for section in range(3):
        lines += ["!begin", '"ID"\tA']
        for i in range(2000):
            good = i % 9 != 0
            if good:
                want.append((len(lines), [f"p{i}", str(section)]))
            lines.append(f'"p{i}"\t{section}' if good else f"p{i}")
        lines += ["!end", "p1\tbetween"]
    (tmp_path / "m.txt").write_bytes("\r\n".join(lines).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = readers.read_sectioned(spark, str(tmp_path / "m.txt"), "!begin", "!end", r"p\d+")
        assert sorted((r.line_no, r.fields) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_checksums_stream_files_of_any_size(spark, tmp_path):
    with (tmp_path / "big.bin").open("wb") as f:
        f.truncate((3 << 30) + 5)  # sparse
    (tmp_path / "odd name %41+é.txt").write_bytes(b"x")
    zeros = hashlib.sha256()
    for _ in range(3 << 8):
        zeros.update(bytes(4 << 20))
    zeros.update(bytes(5))
    want = [("big.bin", zeros.hexdigest(), (3 << 30) + 5), ("odd name %41+é.txt", hashlib.sha256(b"x").hexdigest(), 1)]
    got = assets.verify_checksums(spark, spark.createDataFrame(want, "path string, sha256 string, bytes long"), f"file://{tmp_path}").collect()
    assert {r.path for r in got if r.valid} == {"big.bin", "odd name %41+é.txt"}


def test_export_of_a_value_with_most_rows(spark, tmp_path):
    df = spark.range(3000).selectExpr("if(id % 10 = 0, id, -1) AS g", "id AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a few rows are one file
    try:
        assets.export_by(df, "g", str(tmp_path / "out"), rows_per_file=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out/g=-1").glob("*.parquet"))) > 1 and len(list((tmp_path / "out/g=10").glob("*.parquet"))) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000
