"""Secret scans: patterns for credentials, and probabilistic automata inferred from those found, which score all other candidates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.llm.shared import bound_batches, durable

KINDS = ("assign", "access", "hex")
#: The kind of spans that the automata add; it sorts after the others.
INFERRED = "format"
# The patterns of the three kinds and the least characters of a match (of the value, for assign).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A candidate is a maximal run of so many and more of the characters that values are made of.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Training reads at most so many different values of a kind, and three times as many other candidates, of at most so many characters.
TRAINING_VALUES, TRAINING_LENGTH = 2000, 256
#: Natural log of how many times likelier a credential format must make a candidate than the ordinary candidates do.
LEAST_LOG_ODDS = math.log(1000.0)
#: Significance of the test by which states count as different.
ALPHA = 0.05

_CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"} | {c: c for c in "+/_.=-"}
_CLASS_OF = str.maketrans({c: k for k, chars in _CLASSES.items() for c in chars})
_LOG_SIZE = {k: math.log(len(chars)) for k, chars in _CLASSES.items()}
_SMOOTHING = 0.05


def classes(value: str) -> str:
    """A value as its character classes: digits, a-f, g-z, A-F, G-Z, and each sign for itself."""
    return value.translate(_CLASS_OF)


class _State:
    """n strings came here, `end` of them ended; to: class -> [next state, strings that went on there]."""

    __slots__ = ("end", "n", "to")

    def __init__(self):
        self.n, self.end, self.to = 0, 0, {}

    def share(self, c: str) -> float:
        return self.to[c][1] / self.n if c in self.to else 0.0


def _prefix_tree(words: Iterable[str]) -> _State:
    root = _State()
    for word in words:
        at = root
        at.n += 1
        for c in word:
            step = at.to.setdefault(c, [None, 0])
            step[0] = step[0] or _State()
            step[1] += 1
            at = step[0]
            at.n += 1
        at.end += 1
    return root


def _differ(a: _State, b: _State, bound: float) -> bool:
    """Whether counts from a and b on contradict that they are one state (Hoeffding's bound, here and along common paths)."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        limit = bound * (a.n**-0.5 + b.n**-0.5)
        if limit >= 1:  # too few to tell, and fewer below
            continue
        if abs(a.end / a.n - b.end / b.n) > limit or any(abs(a.share(c) - b.share(c)) > limit for c in a.to.keys() | b.to.keys()):
            return True
        stack += [(a.to[c][0], y) for c, (y, _) in b.to.items() if c in a.to and a.to[c][0] is not y]
    return False


def _fit(red: _State, blue: _State) -> float:
    """Log likelihood a symbol of what the tree below blue has seen, were red in its place."""
    total, symbols, stack = 0.0, 0, [(red, blue)]
    while stack:
        a, b = stack.pop()
        whole = a.n + _SMOOTHING * (len(_CLASSES) + 1)
        total += b.end * math.log((a.end + _SMOOTHING) / whole)
        symbols += b.n
        for c, (y, count) in b.to.items():
            x, seen = a.to.get(c, (None, 0))
            total += count * math.log((seen + _SMOOTHING) / whole)
            if x:
                stack.append((x, y))
    return total / symbols


def _fold(a: _State, b: _State) -> None:
    """Add the tree below b to a, which may have loops; transitions stay deterministic."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        a.n, a.end = a.n + b.n, a.end + b.end
        for c, (y, count) in b.to.items():
            if c in a.to:
                a.to[c][1] += count
                stack.append((a.to[c][0], y))
            else:
                a.to[c] = [y, count]


class Automaton:
    """A deterministic probabilistic automaton over character classes. steps: for each state class -> (log probability, next state)."""

    def __init__(self, steps: list[dict[str, tuple[float, int]]], ends: list[float], other: list[float]):
        self.steps, self.ends, self.other = steps, ends, other

    @classmethod
    def infer(cls, values: Iterable[str], alpha: float = ALPHA) -> Automaton:
        """Merge states of the values' prefix tree. Red states stand, blue ones are their successors still to be judged, that with most counts
        first. A blue state that differs from every red one turns red; else it is merged into that red state, of those it doesn't differ
        from, which fits its counts best."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        root = _prefix_tree(classes(v) for v in values)
        red, names = [root], {id(root): 0}
        while True:
            blue = [(step[1], i, c, r) for i, r in enumerate(red) for c, step in r.to.items() if id(step[0]) not in names]
            if not blue:
                break
            _, _, symbol, parent = max(blue, key=lambda x: (x[0], -x[1], x[2]))
            state = parent.to[symbol][0]
            alike = [r for r in red if not _differ(r, state, bound)]
            if alike:
                best = max(alike, key=lambda r: _fit(r, state))
                parent.to[symbol][0] = best
                _fold(best, state)
            else:
                names[id(state)] = len(red)
                red.append(state)
        whole = [r.n + _SMOOTHING * (len(_CLASSES) + 1) for r in red]
        steps = [{c: (math.log((n + _SMOOTHING) / w), names[id(x)]) for c, (x, n) in r.to.items()} for r, w in zip(red, whole, strict=True)]
        return cls(steps, [math.log((r.end + _SMOOTHING) / w) for r, w in zip(red, whole, strict=True)], [math.log(_SMOOTHING / w) for w in whole])

    def log_likelihood(self, value: str) -> float:
        """Natural log of the probability of exactly this value; a class that a state has never seen costs the smoothed rest and starts anew."""
        total, at = 0.0, 0
        for c in classes(value):
            step = self.steps[at].get(c)
            total -= _LOG_SIZE[c]
            if step is None:
                total, at = total + self.other[at], 0
            else:
                total, at = total + step[0], step[1]
        return total + self.ends[at]


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the patterns' matches, leftmost and non-overlapping within a kind, without those that are too short."""
    found = [(*m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out = [(a, "assign", b, v) for a, b, v in found]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        # A match that is long enough lies in one candidate, which holds all of its kind around it.
        for run in CANDIDATE.finditer(text):
            out += [(m.start(), kind, m.end(), m[0]) for m in pattern.finditer(text, *run.span()) if len(m[0]) >= LEAST[kind]]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its id, spans (start, kind, end, value) of the patterns, and candidates (start, end, value), the other runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans, others = [], []
            for text in batch["text"]:
                own = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": b, "value": v} for a, k, b, v in own])
                taken, free = [(a, b) for a, _, b, _ in own], []
                for m in CANDIDATE.finditer(text):
                    if not any(a < m.end() and m.start() < b for a, b in taken):
                        free.append({"start": m.start(), "end": m.end(), "value": m[0]})
                others.append(free)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans, "candidates": others})

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {source.dtypes[0][1]}, spans array<struct<start:int,kind:string,end:int,value:string>>, candidates array<struct<start:int,end:int,value:string>>"
    return source.mapInPandas(run, schema)


def infer_formats(scanned: DataFrame, sample: int = TRAINING_VALUES, longest: int = TRAINING_LENGTH) -> tuple[dict[str, Automaton], Automaton]:
    """(an automaton for each kind of which there are values, one of other candidates), from the values with the smallest hashes: at most
    `sample` different ones a kind and three times as many others, each of at most `longest` characters."""
    values = scanned.select(F.explode("spans").alias("s")).select("s.kind", "s.value")
    others = scanned.select(F.explode("candidates").alias("s")).select(F.lit("").alias("kind"), "s.value")
    distinct = values.union(others).where(F.length("value") <= longest).distinct()
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    rows = distinct.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("kind") == "", 3 * sample).otherwise(sample)).orderBy("kind", "nth").collect()
    by_kind: dict[str, list[str]] = {}
    for row in rows:
        by_kind.setdefault(row.kind, []).append(row.value)
    ordinary = Automaton.infer(by_kind.pop("", []) or ["word"])
    return {k: Automaton.infer(v) for k, v in by_kind.items()}, ordinary


def log_odds(value: str, formats: dict[str, Automaton], ordinary: Automaton) -> float:
    """How much likelier (natural log) the likeliest credential format makes a value than the ordinary candidates do."""
    return max((a.log_likelihood(value) for a in formats.values()), default=-math.inf) - ordinary.log_likelihood(value)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_log_odds: float = LEAST_LOG_ODDS, sample: int = TRAINING_VALUES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format: one row per document, whatever its ids.

    The patterns' matches are the base: assign (a name, a sign, a value of 6 characters and more), access (AKIA and capitals or digits, 20 and
    more), hex (24 and more). They also are the labelled credentials from which automata of each kind's format are inferred; every other run
    of 16 characters and more of [A-Za-z0-9+/_.=-] that no base span touches is scored by all of them, and is added as a span of kind
    `format` where the likeliest format beats the automaton of ordinary candidates by least_log_odds. spans lists all as kind:start:end (code points, end exclusive)
    by start, then kind; base_sha256 is the digest of the same list of the base alone.

    The texts are read once; the matches and candidates found are written, the automata fitted on a bounded sample of them (see
    infer_formats) and all candidates scored. Without any labelled value nothing is added. Null text counts as empty. Repeated ids and rows, ties and
    extra columns change nothing. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    scanned = durable(scan(docs, id_col, text_col))
    formats, ordinary = infer_formats(scanned, sample)
    kind_order = F.expr("array(" + ", ".join(f"'{k}'" for k in (*KINDS, INFERRED)) + ")")

    def score(values: pd.Series) -> pd.Series:
        return pd.Series([[float(log_odds(v, formats, ordinary)) for v in some] for some in values])

    odds = F.pandas_udf(score, "array<double>")
    as_span = lambda x: F.struct(x["start"].alias("start"), F.array_position(kind_order, x["kind"]).cast("int").alias("at"), x["kind"].alias("kind"), x["end"].alias("end"))
    with_odds = scanned.withColumn("odds", F.when(F.size("candidates") > 0, odds(F.transform("candidates", lambda x: x["value"]))))
    added = F.filter(F.arrays_zip("candidates", "odds"), lambda x: x["odds"] >= least_log_odds)
    added = F.transform(added, lambda x: F.struct(x["candidates"]["start"].alias("start"), F.lit(len(KINDS) + 1).alias("at"), F.lit(INFERRED).alias("kind"), x["candidates"]["end"].alias("end")))
    added = F.when(F.size("candidates") > 0, added).otherwise(F.array().cast("array<struct<start:int,at:int,kind:string,end:int>>"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    lists = with_odds.select("doc_id", F.transform("spans", as_span).alias("base"), added.alias("added"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return lists.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_format")
    )
