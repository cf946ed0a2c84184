"""Exact and near deduplication and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from wickerwork.llm.components import components
from wickerwork.llm.exact_dedup import exact_dedup
from wickerwork.llm.line_dedup import Passages, dedup_lines
from wickerwork.llm.near_dedup import OnePermutation, common_counts, drop_near_duplicates, near_duplicates, shingle_sets

DOCS = "doc_id long, text string, hi int, norm string, kept string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(texts):
    return [(i, t, 0, "x", "y") for i, t in enumerate(texts)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    texts = ["A b", "a B", None, "", "É", "é", "x" * 100_000, "X" * 100_000] + ["same"] * 60 + ["Same", "tail"]
    docs = spark.createDataFrame(rows_of(texts) + [(None, "a b", 0, "", ""), (7, "X" * 100_000, 0, "", "")], DOCS)
    got = exact_dedup(docs, keep=keep, partitions=5).collect()
    assert len(got) == len(texts) + 2
    groups = {}
    for i, t in [*enumerate(texts), (None, "a b"), (7, "x" * 100_000)]:
        groups.setdefault(lower(t), []).append(i)
    pick = min if keep == "smallest" else max
    for r in got:
        g = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
        assert r.keep_id == pick(x for x in g if x is not None) and r.group_size == len(g)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def mutated(rng, words, share):
    return [rng.choice("abcdefgh") * 4 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE TWO"]
    for size in (3, 5, 8, 20, 60, 300):
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            texts += [" ".join(mutated(rng, base, s)) for s in (0, 0, 0.02, 0.04, 0.06, 0.1)]
    base = [rng.choice(vocab) for _ in range(80)]
    texts += [" ".join(mutated(rng, base, 0.03)) for _ in range(60)]  # a large group, linked through one another
    rng.shuffle(texts)
    want = brute_components(texts, width, 80)
    docs = spark.createDataFrame([*rows_of(texts), (None, "one two", 0, "", "")], DOCS)
    got = {r.doc_id: r for r in near_duplicates(docs, width=width).collect()}
    assert len(got) == len(texts) + 1 and got[None].kept and got[None].component_id is None
    for i, (n, c) in enumerate(want):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i), texts[i]
    kept = drop_near_duplicates(docs, width=width)
    assert kept.columns == docs.columns and kept.count() == 1 + sum(c == i for i, (_, c) in enumerate(want))
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_in_a_large_bucket_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr("wickerwork.llm.near_dedup.BLOCK", 7)
    monkeypatch.setattr("wickerwork.llm.near_dedup.BLOCK_SHINGLES", 300)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(mutated(rng, base, 0.09)) for _ in range(60)] + ["long " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60_000))] * 2
    docs = spark.createDataFrame([*rows_of(texts), (5, texts[5], 0, "", "")], DOCS)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, bands=4, rows=1).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute_components(texts, 5, 80))}


def test_densified_bins_estimate_jaccard():
    rng = np.random.default_rng(0)
    hasher = OnePermutation(64, 1)
    for size in (5, 50, 2000):
        pool = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
        same = [np.mean(hasher.bucket_keys(np.sort(rng.permutation(pool)[: max(1, int(0.8 * size))])) == hasher.bucket_keys(pool)) for _ in range(60)]
        assert abs(np.mean(same) - max(1, int(0.8 * size)) / size) < 0.06


def test_common_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 90, int(n)).astype(np.uint64)) for n in (0, 5, 40, 80, 60, 1)]
    got = common_counts(sets[:4], sets[2:], columns=7)
    assert [[len(np.intersect1d(x, y)) for y in sets[2:]] for x in sets[:4]] == got.tolist()
    assert common_counts([], sets).shape == (0, 6) and not common_counts(sets, [sets[0]]).any()


def test_shingle_sets_count_distinct():
    sets = list(shingle_sets(["a b a b a", "A", "", "x y"], 2))
    assert [len(s) for s in sets] == [2, 1, 0, 1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (9, 8), (4, 5), (5, 5), (5, 4), (None, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {x: 1 for x in (1, 2, 3, 8, 9)} | {4: 4, 5: 4} | {100 + i: 100 for i in range(41)}
    assert got == want


def test_equal_passages_have_equal_fingerprints_at_equal_places():
    rng = np.random.default_rng(1)
    p = Passages(12)
    texts = [rng.integers(0, 3 if i % 2 else 2**40, int(n)).astype(np.uint64) for i, n in enumerate([40, 200, 5, 12, 0, 90, 11, 60])]
    texts += [np.concatenate([texts[1][20:60], texts[0][5:35], texts[5][50:]]), np.full(50, 7, np.uint64)]
    words, first = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    start, mark, lines = p.winnow(words, first)
    assert start.tolist() == [first[i] + j for i, t in enumerate(texts) for j in range(len(t) - 11)]
    assert all(0 <= m - s < p.window for s, m in zip(start, mark, strict=True)) and len(lines) == len(words) - p.width + 1
    seen, inside = {}, set()
    again = p.repeated_inside(words, first, start, mark, lines)
    for s, m, a in zip(start.tolist(), mark.tolist(), again.tolist(), strict=True):
        passage, text = words[s : s + 12].tobytes(), int(np.searchsorted(first, s, side="right"))
        assert seen.setdefault(passage, m - s) == m - s
        assert a == ((text, passage) in inside)
        inside.add((text, passage))


def left_by_brute_force(texts, min_words=50, line_words=None):
    """Words left of each text, by looking up every passage and every line in those of all earlier places."""
    seen, lines, out = set(), set(), {}
    for i in sorted(texts):
        words = texts[i].split()
        gone = set()
        for j in range(len(words) - min_words + 1):
            passage = tuple(words[j : j + min_words])
            if passage in seen:
                gone.update(range(j, j + min_words))
            seen.add(passage)
        at = 0
        for line in texts[i].split("\n"):
            own = tuple(line.split())
            if line_words and line_words <= len(own) < min_words:
                if own in lines:
                    gone.update(range(at, at + len(own)))
                lines.add(own)
            at += len(own)
        out[i] = [w for j, w in enumerate(words) if j not in gone]
    return out


@pytest.mark.parametrize("line_words", [None, 2])
def test_line_dedup_equals_brute_force(spark, line_words):
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(400)]
    lines = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    texts = {}
    for i in range(90):
        text = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(len(pool) - 90)
            kind = rng.random()
            if kind < 0.5:
                text.append(" ".join(pool[a : a + rng.randrange(20, 90)]))
            elif kind < 0.7:
                text.append("\n" + rng.choice(lines) + "\n")
            elif kind < 0.8:
                text.append(" ".join(["la", "lo"][: rng.randrange(1, 3)] * rng.randrange(20, 70)))
            else:
                text.append(" ".join(f"n{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 60))))
        texts[i] = rng.choice([" ", "\n", "\n\n"]).join(text)
        if i % 9 == 8:
            texts[i] = texts[i - rng.randrange(1, 8)].replace(" ", "  ")  # a copy but for the layout
    docs = spark.createDataFrame([(i, t, 0, "", "") for i, t in texts.items()], DOCS)
    got = {r.doc_id: r for r in dedup_lines(docs, line_words=line_words).collect()}
    want = left_by_brute_force(texts, 50, line_words)
    for i, text in texts.items():
        assert got[i].text.split() == want[i], i
        assert got[i].words_cut == len(text.split()) - len(want[i])
        assert got[i].words_cut or got[i].text == text


def test_line_dedup_equals_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.text for r in dedup_lines(docs, line_words=4).collect()}
    want = left_by_brute_force(texts, 50, 4)
    assert {i: t.split() for i, t in got.items()} == want and want != {i: t.split() for i, t in texts.items()}


def test_line_dedup_takes_any_columns_and_repeated_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a " + passage, 1, "x", "m"), (1, "a " + passage, 2, "y", "m"), (2, "b " + passage, 3, None, None), (2, "b " + passage, 4, "z", "m"), (1, "c " + passage, 5, "v", "m")]
    docs = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, version int, row string, masks string, matches int, _doc int, `a.b` int")
    cut = dedup_lines(docs)
    assert cut.columns == [*docs.columns, "words_cut", "bytes_cut"]
    got = sorted(cut.collect(), key=lambda r: r.version)
    assert [(r.row, r.masks, r.matches, r._doc) for r in got] == [(*r[3:], 7, 8) for r in rows]
    assert [r.text for r in got[2:4]] == ["b", "b"] and got[0].text == got[1].text
    assert {got[0].text, got[4].text} in ({"a", rows[4][1]}, {rows[0][1], "c"})  # of two texts with one id, a hash says which is first


def test_line_dedup(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    short = [word() for _ in range(30)]
    texts = []
    for i in range(30):
        own = [word() for _ in range(rng.randrange(5, 120))]
        at = rng.randrange(len(own))
        middle = passage if i % 3 == 0 else short if i % 3 == 1 else []
        sep = rng.choice([" ", "\n"])
        texts.append((own[:at], middle, own[at:], sep))
    docs = [(i, s.join([*a, *m, *b]), 0, "", "") for i, (a, m, b, s) in enumerate(texts)]
    docs += [(100, " ".join(passage), 0, "", ""), (101, None, 0, "", ""), (102, "", 0, "", ""), (None, " ".join(passage), 0, "", "")]
    docs += [(103, " ".join(passage) + "\n" + " ".join(passage), 0, "", "")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert len(got) == len(docs)
    for i, (a, m, b, s) in enumerate(texts):
        if m is passage and i > 0:
            assert got[i].text.split() == a + b and got[i].words_cut == 60
            assert got[i].bytes_cut == len(" ".join(passage))
        else:
            assert got[i].text == docs[i][1] and got[i].words_cut == 0
    assert got[100].text == "" and got[103].text == "" and got[101].text is None and got[102].text == ""
    assert got[None].text == " ".join(passage)
    left = dedup_lines(spark.createDataFrame(docs, DOCS), drop_empty=True)
    assert left.where("doc_id in (100, 103)").count() == 0 and left.where("doc_id in (101, 102)").count() == 2
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_of_a_passage_that_most_texts_have(spark):
    passage = " ".join(f"p{i}" for i in range(52))
    docs = [(i, f"a{i} b{i} {passage} c{i} d{i}", 0, "", "") for i in range(60)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {0: docs[0][1]} | {i: f"a{i} b{i}\nc{i} d{i}" for i in range(1, 60)}


def test_line_dedup_keeps_beyond_ascii_bytes(spark):
    passage = " ".join(f"wörd{i}é" for i in range(55))
    docs = [(1, "Ünïcode vorher. " + passage + " danach ß", 0, "", ""), (2, "außen " + passage + "\nrest ñ", 0, "", "")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1] == docs[0][1] and got[2] == "außen\nrest ñ"


def test_line_dedup_where_an_earlier_text_quotes_the_middle(spark):
    rng = random.Random(11)
    docs, gone = [], {}
    for case in range(40):
        size = rng.randrange(50, 98)
        quoted = rng.randrange(26, min(size, 75))
        at = rng.randrange(size - quoted + 1)
        passage = [f"p{case}x{i}" for i in range(size)]
        around = lambda n, c=case: [f"o{c}x{n}x{i}" for i in range(12)]
        first = [*around(0), *passage[at : at + quoted], *around(1)]
        for k, middle in enumerate([first, passage, passage, passage]):
            own = (around(2 * k + 2), around(2 * k + 3))
            docs.append((10 * case + k, " ".join([*own[0], *middle, *own[1]]), 0, "", ""))
            gone[10 * case + k] = " ".join(own[0]) + "\n" + " ".join(own[1])
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    for i, text, *_ in docs:
        if i % 10 == 0:
            assert got[i] == text
        elif i % 10 > 1:
            assert got[i] == gone[i], i
