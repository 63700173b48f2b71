"""Personal data: fixed patterns, and a character tagger that learns their forms from what the patterns find.

Base spans are the matches of four patterns (email, ip, card, phone). They label the corpus. From a bounded sample (SPANS
windows of each kind, PLAIN windows without any, those of least hash, so that reruns agree) one task trains a
bidirectional LSTM with a CRF over its tags. It sees each labelled window as it stands and VARIED times changed: many
spans are written in another form of the same kind (spelt-out or bracketed addresses, other separators, no country code,
a number before a card), some are replaced by numbers that are no personal data. So it learns forms that the patterns
miss and does not take every number for one.

Every text is then read in windows of WINDOW characters that overlap by half. Windows are decoded side by side, and the
spans that they propose are reconciled over the whole text: one that touches the edge of its window is left to the
window that holds it whole; of those that overlap the choice of the largest sum of certainties is taken, by a sweep over
the text. An added span must be certain to MIN_SURE in every character, must not cut a word or number, must hold what
its kind cannot be without (see `plausible`), and must cover a letter or digit that no base span covers. A span without
a digit or an at sign, and without both "at" as a word and a dot, is never plausible, so windows that hold none of these
are not decoded: the result is the same.

Nulls and empty texts have no spans; ties, that is equal windows and repeated rows, get equal results; very long texts
are read whole, each by one task, BLOCK windows at a time; an empty table gives an empty result; without a labelled span
there is no tagger and base spans are all. A column of the input named as the result is replaced, others pass through.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import saved
from .secrets import redacted
from .tagger_kernel import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
PART = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A span holds one of these, or is an address with "at" spelt out and a dot, spelt out or not (see `plausible`).
SIGNS = re.compile(r"[0-9@]")
AT, DOT = re.compile(r"(?i:\bat(?![A-Za-z0-9]))"), re.compile(r"\.|(?i:dot)")
#: Windows from which the tagger learns: of each kind, how often each is varied, and without any span.
SPANS, VARIED, PLAIN = 200, 3, 600
#: Characters of these windows, and rounds of training.
LEARNT, TRAINED = 80, 6
#: Characters of a window that is decoded, and from one to the next; windows that are decoded side by side.
WINDOW, STEP, BLOCK = 128, 64, 512
#: Certainty of every character of an added span.
MIN_SURE = 0.5
SPAN = "array<struct<kind:string,start:int,stop:int>>"
EDGE = re.compile(r"[A-Za-z0-9]")
#: A number that is called: after a plus, zeros or brackets, or in three groups.
CALLED = re.compile(r"(?:\+|00|\([0-9]{2,4}\))[\x20().0-9-]+|[0-9]{2,4}([\x20.-])[0-9]{3,4}\1[0-9]{3,4}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a number is 255 at most."""
    short = part.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


def digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def is_card(value: str) -> bool:
    found = digits(value)
    return 12 <= len(found) <= 19 and luhn(found)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: from each at sign back over the local part, not into the address before, and on over the domain."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        else:
            last = at + 1
        at = text.find("@", last)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, in order of start, then kind."""
    if not text:
        return []
    found = [("email", a, b) for a, b in emails(text)]
    for m in DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts = list(PART.finditer(text, *m.span()))
            for i in range(0, len(parts) - 3, 4):
                if all(small(p.group()) for p in parts[i : i + 4]):
                    found.append(("ip", parts[i].start(), parts[i + 3].end()))
    found += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and is_card(m.group())]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# What the tagger learns from


def _cut(text: str, low: int, spans: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
    """A window of LEARNT characters with what of the spans lies in it."""
    high = min(len(text), low + LEARNT)
    return text[low:high], [(k, max(a, low) - low, min(b, high) - low) for k, a, b in spans if a < high and b > low]


def _sampled(size: int, plain: int):
    """A function over batches of texts that yields windows of least hash: of each kind, and without any span."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[int, tuple]] = {}

        def note(kind: str, window: tuple[str, list]) -> None:
            mine, most = held.setdefault(kind, {}), plain if kind == "" else size
            mine[xxh64_intdigest(window[0].encode("utf-8", "surrogatepass")) >> 1] = window
            if len(mine) >= 4 * most:
                held[kind] = {h: mine[h] for h in sorted(mine)[:most]}

        for batch in batches:
            for text in batch["text"]:
                text = text or ""
                spans = base_spans(text)
                for kind, a, b in spans:
                    if b - a < LEARNT:
                        shift = xxh64_intdigest(text[a:b].encode()) % (LEARNT - (b - a))
                        note(kind, _cut(text, max(0, a - shift), spans))
                for m in PART.finditer(text):  # numbers that no pattern takes, and a window at any place
                    window = _cut(text, max(0, m.start() - xxh64_intdigest(m.group().encode()) % LEARNT), spans)
                    if not window[1]:
                        note("", window)
                if text:
                    window = _cut(text, xxh64_intdigest(text[:LEARNT].encode("utf-8", "surrogatepass")) % len(text), spans)
                    if not window[1]:
                        note("", window)
        rows = [(kind, h, *mine[h]) for kind, mine in held.items() for h in sorted(mine)[: plain if kind == "" else size]]
        frame = pd.DataFrame(rows, columns=["kind", "h", "window", "spans"])
        yield frame.assign(spans=pd.Series([[{"kind": k, "start": a, "stop": b} for k, a, b in x] for x in frame["spans"]], dtype=object))

    return sample


def other_form(kind: str, value: str, draw: np.random.Generator) -> tuple[str, int, int]:
    """The same datum written otherwise, and where it stands in what is written."""
    turn = int(draw.integers(4))
    if kind == "email":
        name, _, domain = value.partition("@")
        at, dot = [("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot ")][turn]
        out = name + at + domain.replace(".", dot)
        return out, 0, len(out)
    if kind == "ip":
        out = value.replace(".", ["[.]", ".", "[.]", "(.)"][turn])
        return out, 0, len(out)
    found = digits(value)
    if kind == "card":
        sign = ["-", " ", ".", ""][turn]
        out = sign.join(found[i : i + 4] for i in range(0, len(found), 4))
        front = f"{int(draw.integers(100))} " if draw.random() < 0.4 else ""
        return front + out, len(front), len(front) + len(out)
    local = found[-10:]
    sign = ["-", ".", " ", ""][int(draw.integers(3))]
    out = [f"({local[:3]}) {local[3:6]}{sign or '-'}{local[6:]}", sign.join((local[:3], local[3:6], local[6:])), f"00{found}", f"+{found[:-10] or '1'}{sign}{sign.join((local[:3], local[3:6], local[6:]))}"][turn]
    return out, 0, len(out)


def no_datum(draw: np.random.Generator) -> str:
    """A number that is no personal datum: a date, a time, a year, a decimal, a version, an amount, an order, a hash."""
    n = lambda low, high: int(draw.integers(low, high))
    return [
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", f"{n(1900, 2100)}-{n(1900, 2100)}", f"{n(0, 1000)}.{n(0, 10**6)}",
        f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 1000)},{n(0, 1000):03}.{n(0, 100):02}", f"{n(10**3, 10**8)}", f"#{n(1, 10**6)}", hashlib.sha1(str(n(0, 10**9)).encode()).hexdigest()[: n(8, 41)], f"{n(10**13, 10**15)}", f"@{n(1, 10**4)}",
    ][n(0, 12)]


def varied(window: str, spans: list[tuple[str, int, int]], draw: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The window with each span as it stands, in another form, or replaced by a number that is none."""
    out, told, at, size = [], [], 0, 0
    for kind, a, b in spans:
        if a < at:
            continue  # two kinds share characters: the first is told
        value, turn = window[a:b], draw.random()
        whole = a > 0 and b < len(window) and len(digits(value)) >= (10 if kind == "phone" else 0)
        out.append(window[at:a])
        size += a - at
        if turn < 0.15 and whole:
            value = no_datum(draw)
        elif turn < 0.6 and whole:
            value, low, high = other_form(kind, value, draw)
            told.append((kind, size + low, size + high))
        else:
            told.append((kind, size, size + len(value)))
        out.append(value)
        size += len(value)
        at = b
    return "".join([*out, window[at:]]), told


def examples(windows: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, lengths and tags of windows, padded to the longest."""
    lengths = np.array([len(w) for w, _ in windows])
    ids = np.zeros((len(windows), lengths.max()), np.uint8)
    tags = np.zeros(ids.shape, np.int64)
    for row, (window, spans) in enumerate(windows):
        ids[row, : len(window)] = symbols(window)
        for kind, a, b in spans:
            tags[row, a] = 1 + 2 * KINDS.index(kind)
            tags[row, a + 1 : b] = 2 + 2 * KINDS.index(kind)
    return ids, lengths, tags


def trained(windows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = TRAINED, seed: int = 13) -> Tagger:
    """A tagger from labelled windows, each of a labelled kind once as it stands and VARIED times varied."""
    draw = np.random.Generator(np.random.PCG64(seed))
    both = [w for window, spans in windows if window for w in ((window, spans), *(varied(window, spans, draw) for _ in range(VARIED if spans else 0)))]
    model = Tagger(len(KINDS), seed)
    model.train(*examples(both), rounds, seed)
    return model


def labelled_windows(docs: DataFrame, text: str = "text", spans: int = SPANS, plain: int = PLAIN) -> DataFrame:
    """kind (empty: none), h, window and its spans: the bounded sample from which the tagger learns. Saved."""
    schema = f"kind string, h long, window string, spans {SPAN}"
    found = saved(docs.select(F.col(text).alias("text")).mapInPandas(_sampled(spans, plain), schema).dropDuplicates(["kind", "h"]))
    picked = None
    for kind in ("", *KINDS):
        part = found.where(F.col("kind") == kind).orderBy("h").limit(spans if kind else plain)
        picked = part if picked is None else picked.unionByName(part)
    return saved(picked)


def learn(docs: DataFrame, text: str = "text", spans: int = SPANS, plain: int = PLAIN, rounds: int = TRAINED) -> Tagger | None:
    """A tagger learnt from the base spans of the documents, in one task, from the bounded sample; None without any."""
    kinds = len(KINDS)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["kind", "h", "window", "spans"]), *batches]).sort_values(["kind", "h"])  # the bounded sample
        if (rows["kind"] != "").any():
            windows = [(w, [(s["kind"], s["start"], s["stop"]) for s in x]) for w, x in zip(rows["window"], rows["spans"])]
            yield pd.DataFrame({"model": [trained(windows, rounds).flat().astype("<f4").tobytes()]})

    model = labelled_windows(docs, text, spans, plain).coalesce(1).mapInPandas(fit, "model binary").collect()  # some 60 KB
    return Tagger(kinds).load(np.frombuffer(model[0].model, "<f4")) if model else None


# Finding spans


def plausible(kind: str, text: str, a: int, b: int) -> bool:
    """Whether a span can be of its kind at all, and does not cut a word or number."""
    value, found = text[a:b], digits(text[a:b])
    if a and EDGE.match(text[a - 1]) and EDGE.match(value[0]) or b < len(text) and EDGE.match(text[b]) and EDGE.match(value[-1]):
        return False
    if kind == "email":
        at, dot = re.search(r"@|(?i:\bat\b)", value), re.search(r"\.|(?i:\bdot\b)", value)
        if "@" in value and re.search(r"\s", value):
            return False
        return bool(at and dot and at.start() > 0 and re.search(r"[A-Za-z0-9]\W*$", value[: at.start()]) and EDGE.match(value[-1]))
    if kind == "ip":
        parts = PART.findall(value)
        return len(parts) == 4 and all(map(small, parts)) and not re.search(r"[A-Za-z]", value)
    if kind == "card":
        return is_card(value) and not re.search(r"[A-Za-z]", value)
    return 9 <= len(found) <= 15 and bool(CALLED.fullmatch(value))


def proposals(tags: np.ndarray, share: np.ndarray, length: int) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, least certainty) of the spans of a decoded window."""
    at = 0
    while at < length:
        tag = int(tags[at])
        if not tag:
            at += 1
            continue
        kind, stop = (tag - 1) // 2, at + 1
        while stop < length and tags[stop] == 2 + 2 * kind:
            stop += 1
        yield KINDS[kind], at, stop, float(share[at:stop].min())
        at = stop


def reconciled(found: dict[tuple[str, int, int], float]) -> list[tuple[str, int, int]]:
    """Of spans that overlap the choice of the largest sum of certainties; of equal sums that of earlier spans."""
    order = sorted(found, key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    ends = [s[2] for s in order]
    best, last = [0.0], [-1]
    for i, span in enumerate(order):
        before = int(np.searchsorted(ends[:i], span[1], "right"))
        with_it = best[before] + found[span] * (span[2] - span[1])
        take = with_it > best[i] + 1e-9
        best.append(with_it if take else best[i])
        last.append(before if take else -1)
    out, i = [], len(order)
    while i > 0:
        if last[i] >= 0:
            out.append(order[i - 1])
            i = last[i]
        else:
            i -= 1
    return out[::-1]


def window_starts(text: str, every: bool = False) -> list[int]:
    """Where the windows of a text start that can hold a span; `every`: all windows."""
    last = max(0, -(-(len(text) - WINDOW) // STEP))
    if every:
        return [k * STEP for k in range(last + 1)] if text else []
    out: dict[int, None] = {}
    over = lambda at: range(max(0, (at - WINDOW) // STEP + 1), min(last, at // STEP) + 1)  # noqa: E731  the windows that hold a place
    for m in SIGNS.finditer(text):
        for k in over(m.start()):
            out[k * STEP] = None
    for m in AT.finditer(text):
        for k in over(m.start()):
            if k * STEP not in out and DOT.search(text, k * STEP, k * STEP + WINDOW):
                out[k * STEP] = None
    return list(out)


def added_spans(texts: list[str], models: Tagger, every: bool = False) -> list[list[tuple[str, int, int]]]:
    """What the tagger adds to the base spans of each text."""
    proposed: list[dict[tuple[str, int, int], float]] = [{} for _ in texts]
    waiting: list[tuple[int, int]] = []

    def decode() -> None:
        lengths = np.array([min(WINDOW, len(texts[i]) - low) for i, low in waiting])
        ids = np.zeros((len(waiting), int(lengths.max())), np.uint8)
        for row, (i, low) in enumerate(waiting):
            ids[row, : lengths[row]] = symbols(texts[i][low : low + WINDOW])
        tags, share = models.decode(ids, lengths)
        for row in np.flatnonzero(tags.any(1)):
            (i, low), length = waiting[row], int(lengths[row])
            for kind, a, b, sure in proposals(tags[row], share[row], length):
                whole = (a > 0 or low == 0) and (b < length or low + b == len(texts[i]))
                if whole and sure >= MIN_SURE and plausible(kind, texts[i], low + a, low + b):
                    key = (kind, low + a, low + b)
                    proposed[i][key] = max(sure, proposed[i].get(key, 0.0))
        waiting.clear()

    for i, text in enumerate(texts):
        for low in window_starts(text, every):
            waiting.append((i, low))
            if len(waiting) >= BLOCK:
                decode()
    if waiting:
        decode()
    out = []
    for text, found in zip(texts, proposed):
        base = base_spans(text) if found else []
        new = {s: p for s, p in found.items() if EDGE.search("".join(c for k, c in enumerate(text[s[1] : s[2]], s[1]) if not any(a <= k < b for _, a, b in base)))}
        out.append(reconciled(new))
    return out


def all_spans(texts: list[str | None], model: Tagger | None, every: bool = False) -> list[list[tuple[str, int, int]]]:
    """Base and added spans of each text, in order of start, then kind."""
    texts = [t or "" for t in texts]
    more = added_spans(texts, model, every) if model is not None else [[] for _ in texts]
    return [sorted([*base_spans(t), *x], key=lambda s: (s[1], KINDS.index(s[0]))) for t, x in zip(texts, more)]


def find_personal_data(docs: DataFrame, text: str = "text", model: Tagger | None = None, out: str = "pii_spans", base: str | None = "pii_base") -> DataFrame:
    """The documents with arrays of all spans and of the base spans; the tagger is learnt from them unless given."""
    model = learn(docs, text) if model is None else model

    @F.pandas_udf(f"struct<every:{SPAN},base:{SPAN}>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        told = lambda found: [{"kind": k, "start": a, "stop": b} for k, a, b in found]
        for texts in batches:
            found = all_spans(list(texts), model)
            yield pd.DataFrame({"every": pd.Series([told(x) for x in found], dtype=object), "base": pd.Series([told(base_spans(t)) for t in texts], dtype=object)})

    found = docs.withColumn("_pii", spans(F.col(text)))
    made = {out: F.col("_pii.every")} | ({base: F.col("_pii.base")} if base else {})
    return found.withColumns(made).drop("_pii")


def digest(frame: DataFrame, column: str = "pii_spans", base: str = "pii_base") -> DataFrame:
    """Counts by kind and the hash of the base spans, and all spans as text, in place of the arrays."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return frame.select(*[c for c in frame.columns if c not in (column, base)], *(count(k) for k in KINDS), F.sha2(line(F.col(base)), 256).alias("base_sha256"), line(F.col(column)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their personal data masked."""
    model = learn(docs, text)

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t, x, "[PERSONAL]") for t, x in zip(texts, all_spans(list(texts), model))], dtype=object)

    return docs.withColumn(text, masked(F.col(text)))
