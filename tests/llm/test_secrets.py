"""Secret scans: base spans against plain pattern matching, automata on held-out credentials."""

import hashlib
import random
import re

from wickerwork.llm.queries import QUERIES
from wickerwork.llm.secret_scan import LEAST_LOG_ODDS, Automaton, base_spans, classes, log_odds, scan_secrets

HEXES, CAPS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def pick(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def base_by_hand(text):
    """All matches of the whole patterns over the whole text, the short ones dropped afterwards."""
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)), [sum(x[1] == k for x in out) for k in range(3)]


def odd_texts():
    rng = random.Random(7)
    bits = ["password=", "Passwd: ", 'secret"="', "TOKEN  =  ", "api_key:", "apikey='", "toſen=abcdefgh", "Key", " ", "\n", "é", "AKIA", "akia", "=", ":", "'", "x" * 30, "a" * 23, "f" * 24, "\U0001f600"]
    bits += [pick(rng, HEXES, n) for n in (5, 12, 24, 40)] + [pick(rng, CAPS, n) for n in (15, 16, 17)]
    return [None, "", "password=abcde", "password=abcdef", "token=token=abcdef", "AKIAAKIA" + "A" * 11, *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(300)), "0" * 300_000, "secret: " * 20_000 + "abcdefg"]


def test_base_spans():
    for text in odd_texts():
        spans = base_spans(text or "")
        assert (",".join(f"{k}:{a}:{b}" for a, k, b, _ in spans), [sum(s[1] == k for s in spans) for k in ("assign", "access", "hex")]) == base_by_hand(text)


def test_scan(spark):
    rng = random.Random(3)
    texts = [f'say token = "{pick(rng, HEXES, 40)}" {pick(rng, "ghijklmnopr", rng.randrange(16, 25))} end' for _ in range(200)]
    planted = [f"é {pick(rng, HEXES, 22)} ordinary" for _ in range(5)]
    clean = ["thinginterationalities of " + pick(rng, "ghijklmnopr", 20) + "." for _ in range(20)]
    odd = odd_texts()
    rows = [(i % 7 if i % 5 else None, x, "y", i) for i, x in enumerate(odd)]
    for r in scan_secrets(spark.createDataFrame(rows, "doc_id int, text string, spans string, nth int").repartition(5), id_col="nth").collect():
        base, counts = base_by_hand(odd[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    rows = [(i % 7 if i % 5 else None, x, "y", i) for i, x in enumerate(texts + planted + clean)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans string, nth int").repartition(5)
    got = scan_secrets(docs, id_col="nth").collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    for r in got:
        base, counts = base_by_hand(rows[r.doc_id][1])
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("format")] == (base.split(",") if base else [])
        assert r.n_format == len(spans) - sum(counts)
        order = [(int(s.split(":")[1]), ("assign", "access", "hex", "format").index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)
    found = {r.doc_id: r.spans for r in got}
    assert all(found[len(texts) + i] == "format:2:24" for i in range(len(planted)))
    assert not any(found[len(texts) + len(planted) + i] for i in range(len(clean)))
    assert len(scan_secrets(docs).collect()) == len(rows)
    empty = scan_secrets(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]
    assert [r.spans for r in scan_secrets(docs.where("text = 'no such row'").union(spark.createDataFrame([(1, pick(rng, HEXES, 20), "", 1)], docs.schema))).collect()] == [""]


def test_automata_tell_formats_apart():
    rng = random.Random(11)
    keys = ["AKIA" + pick(rng, CAPS, 16) for _ in range(400)]
    tokens = [pick(rng, HEXES, 40) for _ in range(400)]
    words = [pick(rng, "abcdefghiklmnoprstu", rng.randrange(16, 30)) for _ in range(600)]
    formats, ordinary = {"access": Automaton.infer(keys[:300]), "hex": Automaton.infer(tokens[:300])}, Automaton.infer(words[:500])
    assert all(log_odds(v, formats, ordinary) >= LEAST_LOG_ODDS for v in keys[300:] + tokens[300:])
    assert not any(log_odds(v, formats, ordinary) >= LEAST_LOG_ODDS for v in words[500:])
    assert formats["access"].log_likelihood(keys[-1]) > formats["hex"].log_likelihood(keys[-1])
    # Each state's probabilities sum to less than one by what the smoothing keeps for classes never seen.
    assert all(sum(2.718281828**p for p, _ in s.values()) + 2.718281828**e <= 1 + 1e-9 for s, e in zip(ordinary.steps, ordinary.ends, strict=True))
    assert classes("a9Z-g/F") == "hdL-l/H"
    fixed = Automaton.infer(["22", "333"] * 50)
    assert fixed.log_likelihood("11") > fixed.log_likelihood("1") and Automaton.infer([]).log_likelihood("abc") < 0


def test_query(spark, sf):
    got = QUERIES["op13_secret_scan"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        base, counts = base_by_hand(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == [*counts, hashlib.sha256(base.encode()).hexdigest()]
