"""WARC archives: a distributed writer, and a reader that salvages what a damaged file still holds."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerwork.llm.shared import bound_batches, durable, shared_dir, split_by_weight

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_BEGINNING = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def revisits(pages: DataFrame, id_col: str, payload: Column, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page with a smaller id has too. Narrow: ids and digests only; payloads that
    a large share of the pages have, such as the empty one, are joined by a broadcast of bounded size."""
    keyed = pages.select(F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    keyed = keyed.where(F.col("n") >= least_bytes).where("page_id IS NOT NULL").select("page_id", "digest")
    groups = durable(keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1"))
    hot, cold = split_by_weight(groups, "c")
    met = keyed.join(F.broadcast(hot), "digest").unionByName(keyed.join(cold, "digest"))
    return met.where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _urn(page_id: str | None) -> str:
    """An id as a record's name: percent-encoded, so that no sign of it breaks a header; a null id has a name of its own."""
    return "urn:page-without-id" if page_id is None else "urn:page:" + quote(str(page_id), safe="")


def _qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark itself takes it to, so that tasks write where Spark will read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub("^file:/+", "file:///", full)


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    level: int = 3,
    max_bytes: int = 1_000_000_000,
) -> DataFrame:
    """Write one record a page as gzip members, files of at most about max_bytes, below path (a folder that all executors share);
    returns (file, records, bytes) of what was written, and has written when it returns.

    Of pages with equal payloads of at least least_bytes bytes the one with the smallest id is a response record, the
    others are revisit records without payload that name it; a page counts by its id and its payload. A file gets its final name by a rename when it is
    complete; a task that runs again makes the same file again, so a lost executor leaves no half or double one.

    Null payloads are empty. A page with a null id is a response of its own, 'urn:page:null'. Pages with the same id
    and payload are alike in type. Control characters in a URL are replaced by blanks; a null URL is left out.
    An empty table writes no file.
    """
    bound_batches(pages.sparkSession)
    path = _qualified(pages.sparkSession, path)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    known = revisits(pages, id_col, payload, least_bytes)
    rows = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
        .join(known, ["page_id", "digest"], "left")
        .select("page_id", "url", F.encode("payload", "UTF-8").alias("payload"), "refers_to")
        .select(
            F.col("page_id").cast("string").alias("page_id"),
            F.regexp_replace("url", r"[\x00-\x1f\x7f]", " ").alias("url"),
            "payload",
            F.col("refers_to").cast("string").alias("refers_to"),
        )
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        part, records, size, out, made = "", 0, 0, None, []

        def close() -> None:
            nonlocal out, records, size
            out.close()
            name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{len(made):04d}.warc.gz"
            store.move(part, name)
            made.append((name, records, size))
            records, size, out = 0, 0, None

        for batch in batches:
            for page_id, url, body, refers in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<{_urn(page_id)}>")]
                headers += [("WARC-Target-URI", url)] if url is not None else []
                headers += [("WARC-Payload-Digest", "sha1:" + sha1_base32(body)), ("Content-Type", "application/http; msgtype=response")]
                if refers is not None:
                    headers += [("WARC-Refers-To", f"<{_urn(refers)}>"), ("WARC-Profile", _PROFILE)]
                data = _member(headers, http if refers is not None else http + bytes(body), level)
                if out is None:
                    part = f"{folder}/{uuid.uuid4().hex}.unfinished"
                    out = store.open_output_stream(part)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= max_bytes:
                    close()
        if out:
            close()
        if made:
            yield pd.DataFrame(made, columns=["file", "records", "bytes"])

    return durable(rows.mapInPandas(run, "file string, records long, bytes long"))


def _one(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record that starts at `at`: (its fields, its end), or why there is none."""
    if not (version := _VERSION.match(data, at)):
        return "no version line"
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        return "headers do not end"
    headers = {}
    for line in data[version.end() : end].decode("utf-8", "replace").split("\r\n"):
        key, colon, value = line.partition(":")
        if line and not colon:
            return "bad header line"
        headers[key.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        return "no content length"
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "content length does not lead to the end of a record"
    block = data[start:stop]
    http, payload = {}, block
    if "application/http" in headers.get("content-type", ""):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers.get("warc-type", "")
    if kind == "revisit":
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    else:
        size, actual = len(payload), sha1_base32(payload)
        if digest and digest != actual:
            return "payload digest differs"
        digest = actual
    return {
        "record_type": kind,
        "record_id": headers.get("warc-record-id", "").strip("<>"),
        "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers.get("warc-refers-to", "").strip("<>") or None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if kind != "revisit" else None,
    }, stop + 4


def _inflate(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """The gzip member at `at` and its end, or None where it fails its checks."""
    unpacker, out, fed = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and fed < len(data):
            out.append(unpacker.decompress(data[fed : fed + 65536]))
            fed = min(fed + 65536, len(data))
    except zlib.error:
        return None
    return (b"".join(out), fed - len(unpacker.unused_data)) if unpacker.eof else None


def _inflate_some(data: memoryview, at: int) -> bytes:
    """What the member at `at` unpacks to before it breaks off."""
    unpacker, out, fed, step = zlib.decompressobj(31), [], at, 65536
    while step and not unpacker.eof and fed < len(data):
        before = unpacker.copy()
        try:
            out.append(unpacker.decompress(data[fed : fed + step]))
            fed += step
        except zlib.error:
            unpacker, step = before, step // 16  # the good bytes before the bad one, down to single ones
    return b"".join(out)


def salvage_plain(data: bytes) -> Iterator[dict]:
    """Records of bytes without gzip members; between them, for bytes that pass no check, gaps with offset, length, reason."""
    yield from _salvage(data, _VERSION, lambda at: _one(data, at))


def _salvage(data: bytes, beginning: re.Pattern, read) -> Iterator[dict]:
    """read(at) gives (a record's fields or a list of findings, the end), or why there is nothing; then the next beginning is tried."""
    at, bad, why = 0, None, ""
    while at < len(data):
        found = read(at)
        if isinstance(found, str):
            if bad is None:
                bad, why = at, found
            following = beginning.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        what, end = found
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad, "reason": why}
            bad = None
        for x in what if isinstance(what, list) else [{"kind": "record", **what}]:
            yield x | {"offset": at, "length": end - at}
        at = end
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad, "reason": why}


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of a whole file of gzip members, plain records, or both. After a check that fails, reading goes on at the next
    place, member or version line, from which a valid record can be read; the bytes up to there are a gap. Members may hold several
    records. Of a member that breaks off, the valid records before the break are kept; their offset is the member's and their
    length reaches to the next member or version line, from which reading goes on."""
    view = memoryview(data)

    def read(at: int):
        if not data.startswith(_MAGIC, at):
            return _one(data, at)
        member = _inflate(view, at)
        findings = list(salvage_plain(member[0] if member else _inflate_some(view, at)))
        records = [x for x in findings if x["kind"] == "record"]
        if member and (records or not member[0]):
            return findings, member[1]
        if not records:
            return "gzip member without a valid record" if member else "gzip member that does not unpack"
        following = _BEGINNING.search(data, at + 1)
        end = following.start() if following else len(data)
        return [*records, {"kind": "gap", "reason": "gzip member that breaks off"}], end

    yield from _salvage(data, _BEGINNING, read)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records and gaps of all *.warc and *.warc.gz files below path: file, kind ('record' or 'gap'), offset, length, reason,
    record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest[, payload]. A file is one task's
    input and may hold up to 2 GB, Spark's bound for one value; write_warc starts another at 1 GB. Empty files give nothing."""
    names = ["file", "kind", "offset", "length", "reason", "record_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest"]
    kinds = {"offset": "long", "length": "long", "payload_bytes": "long"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names) + (", payload binary" if with_payload else "")
    columns = names + ["payload"] * with_payload

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                for found in salvage(bytes(content)):
                    if not with_payload:
                        found.pop("payload", None)
                    rows.append(found)
                    held += len(found.get("payload") or b"")
                    if len(rows) >= 10_000 or held > 16_000_000:
                        yield _frame(rows, name, columns)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, name, columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, schema)


def _frame(rows: list[dict], name: str, columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame([{"file": name, **r} for r in rows]).reindex(columns=columns).astype(object)
    frame = frame.where(frame.notna(), None)
    for c in ("offset", "length", "payload_bytes"):
        frame[c] = frame[c].astype("Int64")
    return frame


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages(page_id, url, html) to archives and read them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to. path: a folder of its own below spark.checkpoint.dir unless given. Nulls and repeats: see write_warc."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]
    path = path or f"{shared_dir(spark)}/wickerwork/warc-{uuid.uuid4().hex}"
    if not write_warc(pages, path, least_bytes=least_bytes).limit(1).count():
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    id_of = lambda c: F.when(F.col(c).startswith("urn:page:"), F.url_decode(F.substring(c, 10, 1 << 30))).cast(kind)
    return read_warc(spark, path).where("kind = 'record'").select(
        id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to")
    )
