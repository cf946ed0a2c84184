"""Filter audit and phrase collocations against brute force."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import pytest

from wickerwork.llm import collocations
from wickerwork.llm.collocations import HatTrie, mine_collocations
from wickerwork.llm.filter_audit import audit_filters, order_rows, shapley_by_least_squares
from wickerwork.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, id string, mask int"


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_collocations"])
def test_against_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


def test_shapley_equals_the_mean_over_orders():
    v = [0, 5, 9, 11, 4, 8, 12, 13, 2, 7, 10, 12, 6, 9, 13, 17]
    want = [Fraction(0)] * 4
    orders = list(permutations(range(4)))
    for order in orders:
        before = 0
        for i in order:
            want[i] += Fraction(v[before | 1 << i] - v[before], len(orders))
            before |= 1 << i
    assert shapley_by_least_squares(v, 4) == want


def audit_by_hand(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    low = {}
    for i, text, *_ in docs:
        if i is not None:
            low[text or ""] = min(i, low.get(text or "", i))
    fails = []
    for i, text, lang, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)}
        bad |= {"D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and low[t] < i}
        fails.append((lang or "", i, {x for x, y in bad.items() if y}))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                total[f] += len(gone)
                redundant = sum(f in x[2] for x in own) - len(gone) - sum(f in x[2] for x in left)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[2] == {f} for x in own), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return out


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i % 90}" for i in range(200_000))
    prose = " ".join(f"word{i}" for i in range(120))
    docs = [
        (1, prose, "en"), (2, prose, "de"), (3, prose, "en"), (3, prose, "en"), (2, "AB cd" * 40, "en"), (None, prose, "en"), (None, None, None), (4, None, "fr"),
        (5, "", "fr"), (6, long, "en"), (7, long, None), (8, "é" * 300, "de"), (9, " \t\n ", "de"), (10, "A# b" * 200, "fr"), (11, "a b c " * 99, "en"),
    ]
    docs = [(*d, "x", 7) for d in docs]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, None), (None, 1, 1), (10, None, 1), (77, 1, 1)]
    got = audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audit_by_hand(docs, labels)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got} == want and len(got) == len(want)
    assert audit_filters(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_order_rows_have_zeros():
    rows = order_rows("x", {c: {0: 5} for c in ("rows", "good", "toxic")}, "ABCDE")
    assert len(rows) == 600 and {r[3:] for r in rows} == {(5, 0, 0, 0, 0, 0, 0)}


def phrases_by_hand(docs, least, longest, top, within=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            inside = (q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not any(100 * candidates[q] >= within * a for q in inside):
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, lo, hi, n[lang], -s) for i, (s, a, p, lo, hi) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def words_of(seed, n, size):
    state, out = seed, []
    for i in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append("Wé"[state % 2] + str(min(state >> 8 & 63, state >> 16 & 63) % size) + (". " if state >> 20 & 31 == 0 else "\t" if state >> 20 & 31 == 1 else ""))
    return " ".join(out)


@pytest.mark.parametrize(("longest", "small"), [(4, False), (4, True), (2, False), (3, True)])
def test_collocations_by_hand(spark, monkeypatch, longest, small):
    docs = [(words_of(i, 700, 12), ["en", "de", None][i % 3]) for i in range(12)] + [(None, "fr"), ("", "en"), (" x y  " * 9, "en"), (" . , ", None), ("copy of a LINE. " * 8, "en")]
    docs += [docs[0]] * 3
    table = spark.createDataFrame([(*d, 1, "y") for d in docs], "text string, lang string, n int, phrase string")
    if small:
        # Workers load the module anew, so the limits are lowered for a counter of this process.
        for name, value in (("SLICE", 200), ("MAX_ENTRIES", 60), ("MAX_WORDS", 25), ("BURST", 3)):
            monkeypatch.setattr(collocations, name, value)
        texts = [(d[0] or "").encode() for d in docs]
        counter = collocations.PhraseCounter("en", dict.fromkeys(range(1, longest + 1)))
        seen, want = Counter(), Counter()
        for batch in [*counter.feed(texts), *counter.flush()]:
            assert batch["size"][0].as_py() == 0 or batch["phrase"].to_pylist() == sorted(batch["phrase"].to_pylist(), key=str.encode)
            for size, p, n in zip(batch["size"].to_pylist(), batch["phrase"].to_pylist(), batch["n"].to_pylist(), strict=True):
                seen[size, p] += n
        for text in texts:
            for piece in re.split(rb"[.,;:!?\x0A-\x0D]", text.lower()):
                w = [x.decode() for x in re.split(rb"[ \t]+", piece) if x]
                want[0, ""] += len(w)
                for size in range(1, longest + 1):
                    want.update((size, " ".join(w[i : i + size])) for i in range(len(w) - size + 1))
        assert seen == want
    got = mine_collocations(table, least=5, longest=longest, top=40).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == phrases_by_hand(docs, 5, longest, 40)
    assert mine_collocations(table.limit(0)).count() == 0


def test_runs_cross_the_shuffle_by_prefix_partition(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    docs = spark.createDataFrame([("en", text)] * 2, "lang string, text string").repartition(1)
    rows = collocations._runs(docs, {1: None, 2: None}, {}).collect()
    assert len(rows) <= 2 * collocations.PARTS + 1 and sum(len(r["counts"]) for r in rows) == 8 * 40_000


@pytest.mark.parametrize("merge", [3, 500_000])
def test_packed_runs_are_summed_by_partition(monkeypatch, merge):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "MERGE", merge)
    want, packed = Counter(), []
    for turn in range(5):
        text = " ".join(f"\u00e9{i * (turn + 1) % 7}" for i in range(60))
        w = text.split()
        want.update([(0, "")] * len(w) + [(k, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1)])
        counter = collocations.PhraseCounter("fr", {1: None, 2: None, 3: None})
        packed += [collocations.packed(b) for b in [*counter.feed([text.encode()]), *counter.flush()]]
    rows = pa.Table.from_batches(packed).sort_by([("lang", "ascending"), ("part", "ascending")]).to_batches(max_chunksize=2)
    got = [r for b in collocations.merged(iter(rows), 9) for r in b.to_pylist()]
    assert {r["lang"] for r in got} == {"fr"} and len(got) > 20
    assert sorted((r["size"], r["phrase"], r["n"]) for r in got) == sorted((*k, n) for k, n in want.items() if n >= 9 or k[0] == 0)
    assert list(collocations.merged(iter([]), 9)) == []


def test_trie_bursts_and_gives_back_whole_subtrees(monkeypatch):
    import numpy as np

    monkeypatch.setattr(collocations, "BURST", 4)
    trie, want = HatTrie(3), Counter()
    for turn in range(3):
        keys = sorted((1 + i % 3, ((i * 7 % 11) << 20) | (i + turn) % 5) for i in range(60))
        trie.add(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.ones(60, np.int64))
        want.update(keys)
    assert any(burst for burst, _ in trie.root.values())
    assert trie.entries == len(want) == sum(trie.held.values())
    got = Counter()
    for word in trie.largest():
        suffixes, counts = [], []
        assert trie.take(word, suffixes, counts) == len(suffixes)
        got.update({(word, s): c for s, c in zip(suffixes, counts, strict=True)})
    assert got == want and trie.entries == 0
