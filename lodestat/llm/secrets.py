"""Secret scans: fixed patterns, and formats learnt from what they find.

Base spans are the matches of three patterns (assign, access, hex). Their values label credentials by format. From a
bounded sample of them (SAMPLE of each format, those of least hash, so that reruns agree) an automaton of each format
is inferred, from ordinary strings of the corpus two more: strings with digits, and other words. Every candidate (a
run of credential characters that base spans do not cover) of every document is then scored by how much likelier the best
format makes it than the automata of ordinary strings do. A run above a limit is a span of kind `format`. In other
runs the parts between punctuation, and in long ones windows that cover all of it, are scored likewise. A run that base
spans cover in part is a candidate like any other: a key is found whole though a pattern matches within it. What is
added lies outside of the base spans at least in part.

Nulls and empty texts have no spans; ties and repeated rows get equal results; very long texts and runs are read whole;
an empty table gives an empty result. A column of the input named as the result is replaced, others pass through.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .automata import LOG_SIZE, Automaton, classes
from .common import saved

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Parts of a run: between any punctuation, and between that which names and keys do not have.
PARTS = (re.compile(r"[A-Za-z0-9]{6,}"), re.compile(r"[A-Za-z0-9_-]{6,}"))
DIGIT = re.compile(r"[0-9]")
HINTS = ("passw", "secret", "token", "api")
#: Values from which an automaton is inferred, of each format and each kind of ordinary strings, and their most characters:
#: longer values are found like others, but teach no format.
SAMPLE, SAMPLE_CHARS = 1000, 256
#: Ordinary strings: with a digit and of so many characters or more, and all others.
ORDINARY, ORDINARY_CHARS = ("plain", "word"), 12
#: Rounds of taking out of the ordinary strings what formats make likelier.
CLEANED = 2
#: Log-likelihood ratio (natural) that a string must reach, whole and for each character.
MIN_RATIO, MIN_RATIO_PER_CHAR = 20.0, 0.5
#: Characters of the windows of a longer run, and of the steps between them.
WINDOW, STEP = 64, 32
#: Runs whose verdict a worker keeps, but for those of the text at hand; beyond, it starts anew.
CACHE = 150_000
SPAN = "array<struct<kind:string,start:int,stop:int>>"


def base_spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base matches, in order of start, then kind."""
    if not text:
        return []
    found, low = [], text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str | None, taken: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of credential characters that lie within no base span."""
    starts = [x[1] for x in taken]
    ends = list(accumulate((x[2] for x in taken), max))
    out = []
    for m in CANDIDATE.finditer(text or ""):
        a, b = m.span()
        before = bisect_right(starts, a) if taken else 0  # spans that start no later than the candidate
        if not before or ends[before - 1] < b:
            out.append((a, b, m.group()))
    return out


def _outside(spans: list[tuple[int, int]], base: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
    """Those of the spans that no single base span holds."""
    return [(a, b) for a, b in spans if not any(x <= a and b <= y for _, x, y, _ in base)]


def _sampled(size: int):
    """A function over batches of texts that yields, of each kind, the distinct values of least hash."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[str, int]] = {}
        limit: dict[str, int] = {}

        def note(kind: str, value: str) -> None:
            if len(value) > SAMPLE_CHARS:
                return
            h = xxh64_intdigest(value.encode()) >> 1
            if h <= limit.get(kind, h):
                mine = held.setdefault(kind, {})
                mine[value] = h
                if len(mine) >= 4 * size:
                    held[kind] = dict(sorted(mine.items(), key=lambda x: (x[1], x[0]))[:size])
                    limit[kind] = max(held[kind].values())

        for batch in batches:
            for text in batch["text"]:
                base = base_spans(text)
                for kind, _, _, value in base:
                    note(kind, value)
                held_by = [(a, b) for _, a, b, _ in base]
                free = {v for a, b, v in candidates(text, base) if not any(x < b and a < y for x, y in held_by)} if base else set(CANDIDATE.findall(text or ""))
                for value in free:
                    note(ORDINARY[0] if len(value) >= ORDINARY_CHARS and DIGIT.search(value) else ORDINARY[1], value)
        rows = [(kind, value, h) for kind, mine in held.items() for value, h in sorted(mine.items(), key=lambda x: (x[1], x[0]))[:size]]
        yield pd.DataFrame(rows, columns=["kind", "value", "h"])

    return sample


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict[str, Automaton]:
    """An automaton for each format that has labelled values, and for each kind of ordinary strings."""
    values = saved(docs.select(F.col(text).alias("text")).mapInPandas(_sampled(sample), "kind string, value string, h long").distinct())
    picked = None
    for kind in (*KINDS[:3], *ORDINARY):
        part = values.where(F.col("kind") == kind).orderBy("h", "value").limit(sample)
        picked = part if picked is None else picked.union(part)
    by_kind: dict[str, list[str]] = {}
    for kind, value, _ in picked.collect():  # 5 * sample strings at most
        by_kind.setdefault(kind, []).append(value)
    return inferred(by_kind)


def inferred(values: dict[str, list[str]]) -> dict[str, Automaton]:
    """Automata of the formats and of ordinary strings from their values.

    Credentials that stand in the corpus without a label are among the ordinary strings. So these are first described
    by one state each, and what a format makes likelier than that is taken out, CLEANED times; the rest gets its
    automaton.
    """
    models = {kind: Automaton(sorted(found)) for kind, found in sorted(values.items()) if kind not in ORDINARY}
    rest = {kind: sorted(values[kind]) for kind in ORDINARY if kind in values}
    for _ in range(CLEANED):
        flat = models | {kind: Automaton(found, flat=True) for kind, found in rest.items()}
        rest = {kind: [v for v in found if ratio(v, flat) <= 0] for kind, found in rest.items()}
    return models | {kind: Automaton(found) for kind, found in rest.items()}


def ratio(value: str, models: dict[str, Automaton]) -> float:
    """How much likelier the likeliest format makes the value than the likelier automaton of ordinary strings does."""
    symbols = classes(value)
    formats = [m.log_likelihood(value, symbols) for k, m in models.items() if k not in ORDINARY]
    ordinary = [m.log_likelihood(value, symbols) for k, m in models.items() if k in ORDINARY]
    return max(formats) - max(-6.0 * len(value), *ordinary) if formats else float("-inf")


def _likely(value: str, models: dict[str, Automaton]) -> bool:
    """Whether the ratio reaches both limits. No format makes a value likelier than its characters within their classes
    are, so most values need no look at the formats: an automaton of ordinary strings makes them too likely for that."""
    least = max(MIN_RATIO, MIN_RATIO_PER_CHAR * len(value))
    symbols = classes(value)
    most = -sum(LOG_SIZE.get(c, 0.0) for c in symbols)
    for kind in reversed(ORDINARY):
        if kind in models and most - models[kind].log_likelihood(value, symbols) < least:
            return False
    return ratio(value, models) >= least


def judged(value: str, models: dict[str, Automaton]) -> list[tuple[int, int]]:
    """The stretches of a run that are likely credentials: all of it, or parts and windows, joined where they overlap."""
    if _likely(value, models):
        return [(0, len(value))]
    tried = set() if value.isalnum() else {m.span() for part in PARTS for m in part.finditer(value)} - {(0, len(value))}
    if len(value) > WINDOW:
        tried |= {(k, k + WINDOW) for k in (*range(0, len(value) - WINDOW, STEP), len(value) - WINDOW)}
    out: list[list[int]] = []
    for a, b in sorted(x for x in tried if _likely(value[x[0] : x[1]], models)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def all_spans(text: str | None, models: dict[str, Automaton], known: dict[str, list[tuple[int, int]]] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, in order of start, then kind; `known` keeps verdicts on runs."""
    known = {} if known is None else known
    base = base_spans(text)
    if len(known) >= CACHE:
        known.clear()
    likely = {}
    for value in {v for _, _, v in candidates(text, base)} if base else set(CANDIDATE.findall(text or "")):
        found = known.get(value)
        if found is None:
            found = judged(value, models)
            if len(value) <= WINDOW:
                known[value] = found
        if found:
            likely[value] = found
    added = [(a + x, a + y) for a, _, value in candidates(text, base) for x, y in likely.get(value, ())] if likely else []
    added = [("format", a, b) for a, b in (_outside(added, base) if base else added)]
    return sorted([x[:3] for x in base] + added, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, text: str = "text", models: dict[str, Automaton] | None = None, out: str = "secret_spans") -> DataFrame:
    """The documents with an array of spans; models are learnt from the same documents unless given."""
    models = learn(docs, text) if models is None else models

    @F.pandas_udf(SPAN)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[tuple[int, int]]] = {}
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "stop": b} for k, a, b in all_spans(t, models, known)] for t in texts])

    return docs.withColumn(out, spans(F.col(text)))


def digest(frame: DataFrame, column: str = "secret_spans") -> DataFrame:
    """Counts by base kind, the hash of the base spans and all spans as text, in place of the array."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter(column, lambda s: s["kind"] != "format")
    count = lambda kind: F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return frame.select(*[c for c in frame.columns if c != column], *(count(k) for k in KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col(column)).alias("spans"))


def redacted(text: str | None, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping spans replaced by the mask."""
    if not spans:
        return text
    parts, at = [], 0
    for _, a, b in spans:
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents with their secrets masked and n_chars (if there is such a column) of the new text."""
    models = learn(docs, text)

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[tuple[int, int]]] = {}
        for texts in batches:
            yield pd.Series([redacted(t, all_spans(t, models, known)) for t in texts], dtype=object)

    out = docs.withColumn(text, masked(F.col(text)))
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    """What `digest` gives for base spans; for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
