"""Mixing, sharding, BPE, WARC, nearest neighbours, toxicity and language model against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wickerwork.llm import warc
from wickerwork.llm.ann import nearest_neighbours
from wickerwork.llm.bpe import ByteBPE, bpe_decode, bpe_encode
from wickerwork.llm.hmm_lm import HMM, Counts, Pieces, _endings, expect, log_likelihoods, score_documents
from wickerwork.llm.mixing import in_mixed_order, mix_sources
from wickerwork.llm.queries import QUERIES, SQL, vocabulary
from wickerwork.llm.sharding import shard_by_size, write_shards
from wickerwork.llm.toxicity import FEATURES, Lexicon, features, fit_toxicity
from wickerwork.llm.words import WordBatch


def test_mixing(spark):
    counts = {"hot": 700, "a": 90, "b": 40, "c": 7, None: 20}
    rows = [(f"{s}{i}", s, i, i) for s, n in counts.items() for i in range(n)] + [("hot1", "hot", 1, 1), (None, "a", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, mix_slot int, rows int")
    period, block = 50, 4
    got = mix_sources(docs, weights={"hot": 0.5, "a": 0.3, "b": 0.15}, block_rows=block, period=period, buckets=8)
    assert [c for c in got.columns if c not in docs.columns] == ["mix_source", "mix_block", "mix_release", "mix_deadline", "mix_position"]
    got = got.orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(len(rows)))
    assert Counter(r.source for r in got) == Counter(r[1] for r in rows)
    slots = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        assert slots.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
    mixed = in_mixed_order(docs, period=period)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)
    assert mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="more sources"):
        mix_sources(docs, period=3).collect()


def test_pfair_lag_within_a_period(spark):
    docs = spark.createDataFrame([(i, f"s{i % 7}") for i in range(7 * 60)], "doc_id long, source string")
    weights = {f"s{i}": w for i, w in enumerate([0.41, 0.2, 0.13, 0.1, 0.08, 0.05, 0.03])}
    got = mix_sources(docs, weights=weights, block_rows=1, period=60, buckets=4).where("mix_slot < 60").collect()
    order = [r.mix_source for r in sorted(got, key=lambda r: r.mix_slot)]
    share = Counter(order)
    assert len(order) == 60
    done = Counter()
    for slot, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[x] - share[x] * slot / 60) < 1 for x in share)


def test_mixing_keeps_the_given_weights(spark):
    weights = {"hot": 0.2} | {f"s{i}": 0.8 / 18 for i in range(18)} | {"tiny": 0.0001, "never": 0.0}
    docs = spark.createDataFrame([(i, s) for s in weights for i in range(1500 if s == "hot" else 20 if s in ("tiny", "never") else 330)], "doc_id long, source string")
    got = mix_sources(docs, weights=weights, block_rows=1, buckets=4).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(docs.count())) and {r.source for r in got[-20:]} == {"never"}
    total, done, left = sum(weights.values()), Counter(), Counter(r.source for r in got)
    for n, r in enumerate(got):
        assert r.mix_release <= r.mix_slot < r.mix_deadline and r.mix_block == done[r.source]
        done[r.source] += 1
        for s, w in weights.items():
            assert done[s] == left[s] or s == "never" or abs(done[s] - w / total * (r.mix_slot + 1)) < 1 + 1e-9, (n, s)


def test_mixing_more_sources_than_400(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"s{i % 450}") for i in range(1000)], "doc_id long, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (mix_sources(docs), QUERIES["op1_mixing"](spark, str(tmp_path))):
        assert sorted(r.mix_position for r in got.collect()) == list(range(1000))


def test_sharding(spark):
    rng = np.random.default_rng(4)
    texts = ["w" * int(n) for n in rng.integers(0, 400, 900)] + ["hot text " * 9] * 500 + [None, None, "", "é" * 50, "x" * 30_000]
    texts += [f"group {i} " * 40 for i in range(10) for _ in range(12)] + ["cut in rows " * 30] * 700 + [""] * 2000
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)] + [(None, "w", 1, "s"), (3, texts[3], 1, "s")], "doc_id long, text string, size int, shard string")
    got = shard_by_size(docs, 4).collect()
    assert len(got) == len(texts) + 2
    by, shards = defaultdict(list), defaultdict(set)
    for r in got:
        by[r.shard].append(r)
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            shards[t].add(r.shard)
            assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
    total = sum(r.size for r in got)
    assert set(by) == set(range(4))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 4) < total / 4 / 10
    assert all(len(s) == 1 for t, s in shards.items() if t != "cut in rows " * 30)
    assert total / 4 > 500 * 82 and total / 4 < 700 * 361 and len(shards["cut in rows " * 30]) > 1
    assert shard_by_size(docs.limit(0), 8).count() == 0
    assert sum(r.size for r in shard_by_size(docs.limit(3), 8).collect()) == sum(len(t) + 1 for t in texts[:3])


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    rows = [(i % 50, f"t{i % 70} " * (i % 9), i) for i in range(400)] + [(None, None, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    write_shards(docs, 3, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(back.columns) == ["doc_id", "shard", "slot", "text"]
    assert sorted(map(str, back.select("doc_id", "text", "slot").collect())) == sorted(map(str, docs.collect()))
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "Hello  world\n\n don't WE'LL 12345 été ñandú 日本 🙂", " <|endoftext|>a<|endoftext|>", "ab" * 9000 + " " * 300, "aaaaaaaa" * 30, " \t x"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in enumerate(texts)] + [(None, "x", 5, "")], "doc_id long, text string, n_tokens int, ids string")
    got = {r.doc_id: r for r in bpe_encode(docs, vocabulary(), digests=True).collect()}
    library = Tokenizer.from_file(vocabulary())
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].n_tokens == len(want)
    back = {r.doc_id: r.text for r in bpe_decode(bpe_encode(docs, vocabulary()), vocabulary()).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts)) and back[None] == "x"
    coder = ByteBPE(vocabulary())
    for i in range(300):
        ids = list(np.random.default_rng(i).integers(0, 50257, 5))
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert bpe_encode(docs.limit(0), vocabulary()).count() == 0


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\nfoo" * 3, "é" * 70_000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", t, "k") for i, t in enumerate(html)] + [(None, None, "null id", "k")], "page_id long, url string, html string, kind string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(html) + 1
    first = {}
    for i, t in enumerate(html):
        data = (t or "").encode()
        origin = first.setdefault(data, i)
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == warc.sha1_base32(data)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if origin == i else ("revisit", origin))
    assert got[None].record_type == "response"
    large = {r.page_id: r for r in warc.round_trip(pages, least_bytes=1).collect()}
    assert large[3].record_type == large[4].record_type == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0


def _plain(i, body):
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{warc.sha1_base32(body)}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage(spark, tmp_path, zipped):
    records = [_plain(i, bytes([65 + i]) * 300 + bytes(range(256)) * (i + 1)) for i in range(6)]
    pack = (lambda r: zlib.compressobj(6, zlib.DEFLATED, 31)) if zipped else None
    parts = []
    for r in records:
        if pack:
            z = pack(r)
            r = z.compress(r) + z.flush()
        parts.append(bytearray(r))
    parts[1][len(parts[1]) // 2] ^= 0xFF  # damaged inside
    del parts[3][len(parts[3]) // 2 :]  # cut short
    data = b"junk" + b"".join(map(bytes, parts))
    (tmp_path / f"x.warc{'.gz' * zipped}").write_bytes(data)
    got = warc.read_warc(spark, f"file://{tmp_path}", with_payload=True).orderBy("offset").collect()
    assert [r.record_id for r in got if r.kind == "record"] == [f"urn:page:{i}" for i in (0, 2, 4, 5)]
    assert bytes(got[-1].payload) == records[5].split(b"\r\n\r\n", 1)[1][:-4]
    gaps = [(r.offset, r.length) for r in got if r.kind == "gap"]
    starts = np.cumsum([4] + [len(p) for p in parts])
    assert gaps == [(0, 4), (starts[1], len(parts[1])), (starts[3], len(parts[3]))]
    assert sum(r.length for r in got) == len(data)


def _gz(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _ids(data):
    return [x["record_id"].removeprefix("urn:page:") for x in warc.salvage(data) if x["kind"] == "record"]


def test_salvage_decides_at_every_place():
    zipped_body = [_plain(i, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + _gz(b"hello %d" % i)) for i in range(5)]
    assert _ids(b"".join(zipped_body)) == ["0", "1", "2", "3", "4"]
    assert all(x["kind"] == "record" for x in warc.salvage(b"".join(zipped_body)))
    damaged = zipped_body[2].replace(b"Content-Length: ", b"Content-Length: 9")
    found = list(warc.salvage(b"".join(zipped_body[:2]) + damaged + b"".join(zipped_body[3:])))
    assert [x["kind"] for x in found] == ["record", "record", "gap", "record", "record"] and found[2]["length"] == len(damaged)
    mixed = _gz(_plain(0, b"a")) + _plain(1, b"b") + b"noise" + _gz(_plain(2, b"c") + _plain(3, b"d")) + _plain(4, b"e")
    assert _ids(mixed) == ["0", "1", "2", "3", "4"]
    assert [(x["offset"], x["length"]) for x in warc.salvage(mixed) if x["kind"] == "gap"] == [(mixed.index(b"noise"), 5)]


def test_salvage_keeps_what_a_broken_member_still_holds():
    rng = np.random.default_rng(3)
    many = [_plain(i, rng.bytes(3000)) for i in range(20)]
    member = bytearray(_gz(b"".join(many)))
    for damaged in (bytes(member[:-6]), bytes(member[: len(member) * 3 // 4]), bytes(member[:-8]) + b"\0" * 8):
        got = _ids(damaged + _gz(_plain(99, b"z")))
        whole = 20 if len(damaged) > len(member) - 10 else 14
        assert got[-1] == "99" and got[:-1] == [str(i) for i in range(len(got) - 1)] and len(got) - 1 >= whole
    member[len(member) // 2] ^= 0xFF
    got = _ids(bytes(member) + _plain(98, b"y"))
    assert got[-1] == "98" and len(got) >= 9
    assert list(warc.salvage(b"")) == [] and [x["kind"] for x in warc.salvage(b"\x1f\x8b\x08junk")] == ["gap"]


def test_warc_pages_with_one_id_and_different_payloads(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (2, "c"), (1, "a")] + [(10 + i, None) for i in range(40)]
    pages = spark.createDataFrame([(i, None, t) for i, t in rows], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.round_trip(pages).collect())
    first = {}
    for i, t in sorted((i, t or "") for i, t in rows):
        first.setdefault(t, i)
    want = [(i, warc.sha1_base32((t or "").encode()), *(("response", 0) if first[t or ""] == i else ("revisit", first[t or ""]))) for i, t in rows]
    assert got == sorted(want)


def test_warc_files_have_a_bound(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, f"{i} " * 50) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(pages, f"file://{tmp_path}/w", max_bytes=5000).collect()
    assert len(files) > 3 and sum(f.records for f in files) == 200 and all(f.bytes < 6000 for f in files)
    assert warc.read_warc(spark, f"file://{tmp_path}/w").where("kind = 'record'").count() == 200


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(map(tuple, cursor.fetchall()), key=key)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(c, 1, (250, 16)) for c in rng.normal(0, 2, (5, 16))]).astype(np.float32)
    data[700:900] = data[700] + rng.normal(0, 1e-3, (200, 16))  # a dense spot
    data[40] = data[41] = data[42]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [1.0, None] + [0.0] * 14), (9200, [1.0]), (9250, [float("inf")] * 16), (9300, [])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), sample_size=400, leaf_points=16, block_rows=32).collect()
    x = data.astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r.vec_id)
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12 and r.vec_id != r.query_id
    assert sorted(found) == list(range(0, len(data), 50)) and all(len(v) == 5 for v in found.values())
    hits = 0
    for q, own in found.items():
        score = unit @ unit[q]
        score[q] = -2
        hits += len(set(own) & set(np.lexsort((np.arange(len(score)), -score))[:5].tolist()))
    assert hits >= 0.9 * 5 * len(found)
    few = nearest_neighbours(vectors.where("vec_id < 3"), vectors.where("vec_id = 0")).collect()
    assert len(few) == 2
    assert nearest_neighbours(vectors.limit(0), vectors).count() == 0 and nearest_neighbours(vectors, vectors.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_toxicity(docs, labels)
    scored = model.score(docs).join(labels.select("doc_id", "toxic"), "doc_id").where("pmod(crc32(cast(doc_id as string)), 5) = 0").collect()
    right = np.mean([r.predicted == r.toxic for r in scored])
    assert len(scored) > 300 and right > 0.97 and all(0 <= r.score <= 1 for r in scored)
    some = docs.limit(40).withColumnsRenamed({"lang": "_features", "source": "row", "n_chars": "score"})
    some = some.union(some)
    clean = model.keep_clean(some)
    assert clean.columns == some.columns
    want = {r.doc_id for r in model.score(some).collect() if r.score < 0.5}
    assert sorted(clean.collect(), key=str) == sorted((r for r in some.collect() if r.doc_id in want), key=str)
    hot = [r.score for r in scored if r.toxic]
    cold = [r.score for r in scored if not r.toxic]
    assert np.mean([h > c for h in hot for c in cold]) > 0.98
    odd = spark.createDataFrame([(1, None, 1.0), (None, "", 1.0), (3, "You idiot! " * 60_000, 1.0)], "doc_id long, text string, score double")
    assert model.score(odd).count() == 3 and model.keep_clean(odd).columns == odd.columns
    none = fit_toxicity(docs.limit(0), labels)
    assert none.score(odd).count() == 3 and none.score(docs.limit(0)).count() == 0
    nulls = labels.selectExpr("cast(null as bigint) as doc_id", "toxic").union(labels.selectExpr("doc_id", "cast(null as int)"))
    assert fit_toxicity(docs, nulls).trees is None


def test_toxicity_features():
    got = features(["", "YOU are GREAT!! he11o sooo b@d", "?"], Lexicon())
    assert got.shape == (3, len(FEATURES)) and not got[0].any()
    row = dict(zip(FEATURES, got[1], strict=True))
    assert row["second_person_rate"] == pytest.approx(1 / 6) and row["digit_in_word_rate"] == pytest.approx(1 / 6)
    assert row["capital_words"] == pytest.approx(2 / 6) and row["symbol_in_word_rate"] == pytest.approx(1 / 6) and row["stretched_rate"] == pytest.approx(1 / 6)


def _random_hmm(rng, k, c):
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return HMM(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, c))))


def test_forward_equals_enumeration(monkeypatch):
    rng = np.random.default_rng(6)
    hmm = _random_hmm(rng, 3, 5)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 6, 0, 4, 7)]

    def brute(s):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = hmm.start[path[0]] * hmm.emit[path[0], s[0]]
            for i in range(1, len(s)):
                p *= hmm.move[path[i - 1], path[i]] * hmm.emit[path[i], s[i]]
            total += p
        return math.log(total)

    got = log_likelihoods(hmm, sequences)
    assert np.allclose(got, [brute(s) if len(s) else 0.0 for s in sequences])
    long = rng.integers(0, 5, 700).astype(np.uint16)
    plain = log_likelihoods(hmm, [long])[0]
    monkeypatch.setattr("wickerwork.llm.hmm_lm.LONG_TEXT", 3)
    assert np.allclose(log_likelihoods(hmm, [long, *sequences]), [plain, *got])


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(8)
    source = _random_hmm(rng, 2, 6)
    sequences = []
    for n in rng.integers(1, 150, 200):
        z, s = rng.choice(2, p=source.start), []
        for _ in range(n):
            s.append(rng.choice(6, p=source.emit[z]))
            z = rng.choice(2, p=source.move[z])
        sequences.append(np.array(s, np.uint16))
    tokens = sum(map(len, sequences))
    prior = np.full(6, 1 / 6)
    hmm, last = HMM.guess(2, prior, rng), -np.inf
    for _ in range(6):
        now = log_likelihoods(hmm, sequences).sum()
        assert now > last - 1.0
        last = now
        sums = Counts(np.zeros(2), np.zeros((2, 2)), np.zeros((2, 6)))
        expect(hmm, Pieces.of(sequences), sums)
        assert sums.emit.sum() == pytest.approx(tokens) and sums.start.sum() == pytest.approx(len(sequences))
        assert sums.move.sum() == pytest.approx(tokens - len(sequences))
        hmm = sums.model(prior)


@pytest.mark.parametrize("most", [1, 2, 5, 64, 1000])
def test_expected_counts_are_those_of_uncut_sequences(most):
    rng = np.random.default_rng(9)
    hmm = _random_hmm(rng, 3, 5)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 6, 4, 7, 0, 60, 5, 131)]
    got, want = (Counts(np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))) for _ in range(2))
    expect(hmm, Pieces.of(sequences, most), got)
    for s in sequences:
        forward, backward = np.zeros((len(s), 3)), np.ones((len(s), 3))
        for t in range(len(s)):
            forward[t] = (forward[t - 1] @ hmm.move if t else hmm.start) * hmm.emit[:, s[t]]
        for t in range(len(s) - 2, -1, -1):
            backward[t] = hmm.move @ (hmm.emit[:, s[t + 1]] * backward[t + 1])
        for t in range(len(s)):
            p = forward[t] * backward[t] / forward[-1].sum()
            want.emit[:, s[t]] += p
            if t:
                want.move += hmm.move * np.outer(forward[t - 1], hmm.emit[:, s[t]] * backward[t]) / forward[-1].sum()
            else:
                want.start += p
    assert np.allclose(got.start, want.start) and np.allclose(got.move, want.move) and np.allclose(got.emit, want.emit)


def test_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(5001, None), (5002, ""), (5003, "The x the ÉÉ"), (None, "the of")], "doc_id long, text string")).withColumn("h", docs.doc_id)
    rows = docs.collect()
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in rows]
    held = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows]
    count = Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            count.update([*t, None])
    n, v = sum(count.values()), len(count)
    trace = []
    got = {r.doc_id: r for r in score_documents(docs, local_words=500, own_classes=100, buckets=64, trace=trace).collect()}
    assert len(got) == len(rows)
    vocabulary = sorted({x for t in tokens for x in t})
    batch = WordBatch([" ".join(vocabulary)], fold=True)
    hashed, ending = dict(zip(vocabulary, batch.hash.view(np.int64).tolist(), strict=True)), dict(zip(vocabulary, _endings(batch, 64).tolist(), strict=True))
    own = {w: i for i, w in enumerate(sorted((w for w in vocabulary if count[w]), key=lambda w: (-count[w], hashed[w]))[:100])}
    in_ending = [w for w in vocabulary if count[w] and w not in own]
    held_by, words_of = Counter(), Counter(ending[w] for w in in_ending)
    for w in in_ending:
        held_by[ending[w]] += count[w]
    hmm = trace[0]

    def brute_score(t):
        total, state = 0.0, None
        for w in [*t, None]:
            c = 164 if w is None else own.get(w, 100 + ending.get(w, 0))
            state = (hmm.start if state is None else state @ hmm.move) * hmm.emit[:, c]
            total += math.log10(state.sum())
            state = state / state.sum()
            if w is not None and w not in own:
                total += math.log10((count[w] + 1) / (held_by[ending[w]] + words_of[ending[w]] + 1))
        return total

    gain = []
    for r, t, h in zip(rows, tokens, held, strict=True):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.train_tokens) == (h, len(t) + 1, n)
        assert g.n_known == sum(count[x] > 0 for x in [*t, None])
        assert g.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in [*t, None]), abs=1e-6)
        assert g.score == pytest.approx(brute_score(t), rel=1e-9, abs=1e-6)
        if h:
            gain.append(g.score - g.base_score)
    assert sum(gain) > 0  # the latent states help on unseen texts
    assert score_documents(docs.limit(0)).count() == 0


def test_warc_takes_any_id_and_a_folder_without_scheme(spark, tmp_path):
    ids = ["a b", "line\nbreak", "null", "", None, "50%+é", "<urn:page:1>", "a/b", "same", "Same"]
    pages = spark.createDataFrame([(i, "http://h/", "body" if (i or "").lower() == "same" else f"b{n}") for n, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages, f"{tmp_path}/archives").collect()}
    assert set(got) == set(ids) and list((tmp_path / "archives").glob("*.warc.gz"))
    assert got["same"].refers_to == "Same" and got["same"].record_type == "revisit" and got["Same"].refers_to is None
