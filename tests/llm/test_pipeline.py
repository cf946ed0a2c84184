"""Every stage of the pipeline on its own input against a plain version of it."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import brute_components, left_by_brute_force
from wickerwork.llm.mixing import mix_sources
from wickerwork.llm.queries import vocabulary
from wickerwork.llm.shared import durable
from wickerwork.llm.toxicity import fit_toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, state = docs.columns, docs
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        held[name] = (state, durable(stage(spark, state, sf)))
        state = held[name][1]
        assert name == "bpe" or state.columns == columns

    before, after = held["toxicity"]
    score = {r.doc_id: r.score for r in fit_toxicity(before, spark.read.parquet(f"{sf}/labels.parquet")).score(before).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == {i for i, s in score.items() if s < 0.5}

    before, after = ({r.doc_id: r for r in x.collect()} for x in held["line_dedup"])
    for i, words in left_by_brute_force({i: r.text for i, r in before.items()}).items():
        if words == before[i].text.split():
            assert after[i] == before[i]
        elif words:
            assert after[i].text.split() == words and after[i].n_chars == len(after[i].text)
        else:
            assert i not in after

    before, after = ({r.doc_id: r for r in x.collect()} for x in held["near_dedup"])
    ids = sorted(before)
    groups = brute_components([before[i].text for i in ids], 5, 80)
    assert set(after) == {ids[k] for k, (_, c) in enumerate(groups) if c == k}

    before, after = held["mixing"]
    assert sorted(before.collect()) == sorted(after.collect())
    place = {r.doc_id: r.mix_position for r in mix_sources(before, period=400).collect()}
    parts = defaultdict(list)
    for r in corpus_pipeline.mixing(spark, before, sf).select("doc_id", F.spark_partition_id().alias("p")).collect():
        parts[r.p].append(place[r.doc_id])
    order = [x for p in sorted(parts) for x in parts[p]]
    assert order == sorted(order)

    before, after = held["bpe"]
    texts, library = {r.doc_id: r.text for r in before.collect()}, Tokenizer.from_file(vocabulary())
    got = after.collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_take_empty_and_odd_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "text", None, None, None), (1, None, "en", None, 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], docs.schema)
    for table, rows in ((docs.limit(0), 0), (odd, 4)):
        state = table
        for _, stage in corpus_pipeline.STAGES:
            state = durable(stage(spark, state, sf))
        assert state.count() == rows


def test_near_duplicates_of_one_id_are_dropped_by_their_own_text(spark):
    from wickerwork.llm.near_dedup import drop_near_duplicates

    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "y"), (2, b, "z"), (None, a, "n"), (3, None, "0"), (3, b + " more", "w")], "doc_id int, text string, digest string")
    assert sorted(r.digest for r in drop_near_duplicates(docs).collect()) == ["0", "n", "x", "z"]


def test_a_thousand_sources_are_mixed_in_sql_functions(spark):
    from wickerwork.llm.mixing import mix_sources

    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 1000)) as source")
    got = mix_sources(docs, period=4004)
    assert "Pandas" not in got._jdf.queryExecution().toString() and "Python" not in got._jdf.queryExecution().toString()
    rows = got.orderBy("mix_position").collect()
    assert [r.mix_position for r in rows] == list(range(6000)) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
