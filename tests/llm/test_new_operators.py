"""Filter audit, threshold clustering and personal data against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from test_llm import awkward, empty, small

from lodestat.llm import audit, clustering, pii
from lodestat.llm.common import ready
from lodestat.llm.tagger_kernel import Tagger


def test_galloping_sets():
    draw = random.Random(4)
    for _ in range(400):
        lists = [sorted(draw.sample(range(60), draw.randrange(40))) for _ in range(5)]
        assert audit.union_size(lists) == len(set().union(*lists))
        assert audit.difference_size(lists[0], lists[1:]) == len(set(lists[0]) - set().union(*lists[1:]))
    ids = list(range(0, 3000, 3))
    assert all(audit.gallop(ids, k, low) == max(low, -(-k // 3)) for k in range(0, 3000, 7) for low in (0, 5, 400))


def slow_audit(docs, labels):
    rows = docs.collect()
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    good, toxic = {r.doc_id for r in labels if r.quality == 1}, {r.doc_id for r in labels if r.toxic == 1}
    by_part = collections.defaultdict(list)
    for r in rows:
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, failed in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), r.doc_id is not None and r.doc_id > first[text])) if failed}
        by_part[r.lang or ""].append((fails, r.doc_id in good, r.doc_id in toxic))
    out = {}
    for part, mine in by_part.items():
        summed = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [m for m in mine if f in m[0] and not m[0] & before]
                summed[f] += len(here)
                out[part, "".join(order), step] = [sum(not m[0] & (before | {f}) for m in mine), len(here), sum(f in m[0] and bool(m[0] & before) for m in mine), sum(m[0] == {f} for m in mine), sum(m[1] for m in here), sum(m[2] for m in here)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(summed[order[step - 1]])
    return out


def test_filter_audit(spark):
    from conftest import SMALL

    ready(spark)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic")
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 0), (3, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int"))
    for docs, told in ((small(spark), labels), (awkward(spark), odd), (awkward(spark), labels.where("false"))):
        found = audit.filter_audit(docs, told).collect()
        expected = slow_audit(docs, [r for r in told.collect() if r.doc_id is not None])
        assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found} == expected and len(found) == len(expected)
    assert audit.filter_audit(empty(spark), labels).count() == 0


def test_many_blocks_add_up(spark, monkeypatch):
    ready(spark)
    docs = spark.createDataFrame([(i % 50, f"x{i % 7} #" if i % 3 else "A", "en") for i in range(500)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(50)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) AS toxic")
    monkeypatch.setattr(audit, "RANGE_IDS", 8)
    found = audit.filter_audit(docs, labels).collect()
    expected = slow_audit(docs, labels.collect())
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found} == expected


def slow_clusters(vectors, k, rounds):
    """vectors: (id, integers)."""
    by_hash = sorted(vectors, key=lambda v: (hashlib.sha256(f"2:{v[0] if v[0] is not None else ''}".encode()).hexdigest(), v[1]))
    centroids = [list(v[1]) for v in by_hash[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        mine = collections.defaultdict(list)
        for _, x in vectors:
            mine[nearest(x)[1]].append(x)
        for i, xs in mine.items():
            centroids[i] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [(i, *nearest(x)) for i, x in vectors]
    sums = collections.Counter()
    for _, d, c in found:
        sums[c] += d
    return collections.Counter((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found)


def test_clusters(spark):
    from conftest import SMALL

    ready(spark)
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    nan, inf = float("nan"), float("inf")
    x = [0.25 * i for i in range(64)]
    bad = [None, [], x[:63], [*x, 1.0], [*x[:63], None], [nan, *x[1:]], [*x[:5], inf, *x[6:]], [-inf] * 64]
    near = [[v + 0.004 * (j % 3) for v in x] for j in range(6)] + [[-v for v in x]] * 4 + [[0.0] * 64, [-0.001] * 64, [2.0**19] * 64]
    odd = spark.createDataFrame([(i, v, None, 1) for i, v in enumerate(bad)] + [(i if i % 4 else None, v, 2, 3) for i, v in enumerate(near)], "vec_id long, embedding array<double>, label int, cluster int")
    for table in (rows, odd, odd.unionByName(odd), odd.where("false"), odd.where("size(embedding) <> 64")):
        kept = [(r.vec_id, [int(np.floor(256 * float(c))) for c in r.embedding]) for r in table.collect() if r.embedding and len(r.embedding) == 64 and all(c is not None and np.isfinite(c) for c in r.embedding)]
        found = clustering.cluster_vectors(table)
        assert collections.Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect()) == slow_clusters(kept, 40, 5)
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_threshold_algorithm_stops_early_and_breaks_ties():
    draw = np.random.Generator(np.random.PCG64(3))
    for span in (2, 50, 10**6):
        centroids = draw.integers(-span, span, (40, 6))
        centroids[7] = centroids[3]
        vectors = np.concatenate([draw.integers(-span, span, (300, 6)), centroids])
        which, best, looked = clustering.Nearest(centroids).of(vectors)
        gaps = ((vectors[:, None] - centroids) ** 2).sum(2)
        assert (which == gaps.argmin(1)).all() and (best == gaps.min(1)).all()
    close = np.repeat(np.arange(40)[:, None] * 1000, 64, 1)
    _, _, looked = clustering.Nearest(close).of(close + 1)
    assert looked == 80  # the nearest one, and the next, which its lists show before they can stop


# Personal data


def slow_base(text):
    """The patterns as they stand, by their plain regular expressions."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * c, 10)) for c in d[-2::-2])
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_patterns(spark):
    texts = [r.text or "" for r in small(spark).collect()]
    draw = random.Random(8)
    texts += ["".join(draw.choice("ab.@-+ 01259%_(") for _ in range(draw.randrange(60))) for _ in range(4000)]
    texts += ["".join(draw.choice("0123456789 -.") for _ in range(draw.randrange(80))) for _ in range(3000)]
    texts += ["a@b@c.d", "x@a.b_y@c.d@e.f", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1.2.3.4.5", "007.0.0.000255", "+1 (743) 555-3824.", "@a.b", "4785380592391139 1", "12 4785380592391139"]
    for text in texts:
        assert pii.base_spans(text) == slow_base(text), text
    for long in ("a" * 10**6, "1" * 10**6, "1." * 10**6, "a@" * 10**5, "+1" + " " * 10**6, "1 " * 10**6):
        pii.base_spans(long)


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(awkward_personal(spark), spans=60, plain=120, rounds=6)


PLAIN = "the quick brown fox jumps over the lazy dog while seven old men sat near water and spoke of small things again "


def datum(kind, draw):
    if kind == "email":
        return f"{draw.choice(['ann', 'bob.lee', 'c_d', 'eve9'])}{draw.randrange(100)}@{draw.choice(['mail', 'post'])}{draw.randrange(9)}.{draw.choice(['example.com', 'example.org', 'test.net'])}"
    if kind == "ip":
        return ".".join(str(draw.randrange(256)) for _ in range(4))
    if kind == "card":
        head = "4" + "".join(str(draw.randrange(10)) for _ in range(14))
        return next(head + str(c) for c in range(10) if pii.luhn(head + str(c)))
    return f"+{draw.randrange(1, 50)} ({draw.randrange(200, 999)}) {draw.randrange(200, 999)}-{draw.randrange(1000, 9999)}"


def sentence(value, draw):
    cut = draw.randrange(10, 90)
    return f"{PLAIN[cut:]}{draw.choice(['write to ', 'see ', '', 'from '])}{value}{draw.choice([' ', ', ', '. ', chr(10)])}{PLAIN[:cut]}"


def awkward_personal(spark):
    draw = random.Random(2)
    texts = [sentence(datum(kind, draw), draw) for kind in pii.KINDS for _ in range(80)] + [PLAIN * k for k in range(1, 40)]
    ready(spark)
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_tagger_finds_held_out_forms(model):
    """Spans whose form no pattern matches, as the labels of the corpus do not tell of them."""
    draw, forms = random.Random(99), np.random.Generator(np.random.PCG64(5))
    found = tried = 0
    while tried < 200:
        kind = pii.KINDS[tried % 4]
        value, low, high = pii.other_form(kind, datum(kind, draw), forms)
        text = sentence(value, draw)
        at = text.index(value)
        if any(a < at + high and b > at + low for _, a, b in pii.base_spans(text)):
            continue
        tried += 1
        found += (kind, at + low, at + high) in pii.all_spans([text], model)[0]
    assert found >= 160


def test_tagger_leaves_clean_texts_alone(model):
    draw, forms = random.Random(7), np.random.Generator(np.random.PCG64(6))
    texts = [sentence(pii.no_datum(forms), draw) for _ in range(300)] + [PLAIN * 50]
    assert sum(len(x) for x in pii.all_spans(texts, model)) - sum(len(pii.base_spans(t)) for t in texts) <= 3
    assert pii.all_spans([None, "", "x", " "], model) == [[], [], [], []]


def test_windows_without_signs_change_nothing(model, spark):
    draw, forms = random.Random(17), np.random.Generator(np.random.PCG64(7))
    texts = [sentence(pii.other_form(k, datum(k, draw), forms)[0], draw) * 3 for k in pii.KINDS for _ in range(8)] + [r.text or "" for r in small(spark).limit(40).collect()]
    assert pii.all_spans(texts, model) == pii.all_spans(texts, model, every=True)


def test_spans_do_not_depend_on_where_they_stand(model):
    draw = random.Random(27)
    value = f"({draw.randrange(200, 999)}) {draw.randrange(200, 999)}-{draw.randrange(1000, 9999)}"
    text = PLAIN * 400 + "call " + value + " or " + PLAIN * 3
    found = pii.all_spans([text], model)[0]
    assert [text[a:b] for _, a, b in found] in ([value], [])
    for _, a, b in found:
        assert pii.plausible("phone", text, a, b)
    texts = [sentence(datum("email", draw), draw) for _ in range(20)]
    assert pii.all_spans(texts, model) == [pii.all_spans([t], model)[0] for t in texts]


def test_reconciled_is_the_best_choice():
    draw = random.Random(6)
    for _ in range(300):
        found = {}
        for _ in range(draw.randrange(8)):
            a = draw.randrange(20)
            found[draw.choice(pii.KINDS), a, a + draw.randrange(1, 8)] = draw.randrange(1, 1000) / 1000
        worth = lambda spans: sum(found[s] * (s[2] - s[1]) for s in spans)
        apart = lambda spans: all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(spans, 2))
        most = max(worth(c) for n in range(len(found) + 1) for c in itertools.combinations(found, n) if apart(c))
        chosen = pii.reconciled(found)
        assert apart(chosen) and abs(worth(chosen) - most) < 1e-6


def test_personal_data_query(spark, model):
    for docs in (small(spark), awkward(spark), empty(spark)):
        found = pii.digest(pii.find_personal_data(docs, model=model))
        rows = found.collect()
        assert len(rows) == docs.count()
        for r in rows:
            base, told = slow_base(r.text or ""), [tuple(s.split(":")) for s in r.spans.split(",") if s]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
            assert not collections.Counter((k, str(a), str(b)) for k, a, b in base) - collections.Counter(told)
    assert pii.learn(empty(spark)) is None and pii.find_personal_data(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, PLAIN)], "doc_id long, text string")
    assert pii.find_personal_data(nothing).first().pii_spans == []


def test_redaction(spark):
    docs = awkward_personal(spark)
    for r in pii.redact(docs).collect():
        assert not pii.base_spans(r.text)


def test_slopes_of_the_tagger():
    draw = np.random.Generator(np.random.PCG64(1))
    tagger = Tagger(2)
    for k, p in tagger.parts.items():
        tagger.parts[k] = p.astype(np.float64) + draw.normal(0, 0.05, p.shape)
    ids, lengths = draw.integers(1, 99, (3, 7)).astype(np.uint8), np.array([7, 4, 5])
    tags = np.array([[0, 1, 2, 2, 0, 3, 4], [1, 2, 0, 0, 0, 0, 0], [0, 0, 3, 0, 1, 0, 0]])
    _, slopes = tagger.loss_and_slopes(ids, lengths, tags)
    for name, p in tagger.parts.items():
        for _ in range(5):
            at = tuple(draw.integers(0, n) for n in p.shape) if name != "embed" else (int(draw.choice(ids[0])), int(draw.integers(p.shape[1])))
            was = p[at]
            ends = []
            for step in (1e-3, -1e-3):
                p[at] = was + step
                ends.append(tagger.loss_and_slopes(ids, lengths, tags)[0])
            p[at] = was
            assert abs((ends[0] - ends[1]) / 2e-3 - slopes[name][at]) < 1e-3
    best, share = tagger.decode(ids, lengths)
    scores, _ = tagger._emissions(ids, lengths)
    steps = tagger.parts["steps"] + tagger.allowed
    for row in range(3):
        n = lengths[row]
        ways = {way: tagger.parts["start"][way[0]] + tagger.parts["stop"][way[-1]] + sum(scores[row, t, k] for t, k in enumerate(way)) + sum(steps[a, b] for a, b in zip(way, way[1:])) for way in itertools.product(range(5), repeat=int(min(n, 5)))} if n <= 5 else {}
        if ways:
            top = max(ways, key=ways.get)
            assert tuple(best[row, :n]) == top
            whole = np.logaddexp.reduce(list(ways.values()))
            for t in range(n):
                assert abs(np.exp(np.logaddexp.reduce([v for w, v in ways.items() if w[t] == top[t]]) - whole) - share[row, t]) < 1e-4


def test_plausible_spans_lie_in_decoded_windows():
    """Whatever a tagger may propose: a plausible span lies in a window that is decoded, with "at" spelt out and no digit too."""

    class Proposing:
        def decode(self, ids, lengths):
            tags = np.zeros(ids.shape, np.int64)
            for row, n in enumerate(lengths):
                window = "".join(chr(31 + c) if 1 <= c < 96 else "." for c in ids[row, :n])
                if (a := window.find("mary.")) >= 0 and (b := window.find(".org")) > a:
                    tags[row, a], tags[row, a + 1 : b + 4] = 1, 2
            return tags, np.ones(ids.shape)

    filler = "words go on and on " * 12
    texts = [f"{filler}{value} {filler}" for value in ("mary.poe (at) example.org", "mary.poe at mail.example.org", "mary.poe [AT] a.org", "mary.poe@a.org.org")]
    found = pii.all_spans(texts, Proposing())
    assert found == pii.all_spans(texts, Proposing(), every=True)
    assert [[t[a:b] for _, a, b in x] for t, x in zip(texts, found)][:3] == [["mary.poe (at) example.org"], ["mary.poe at mail.example.org"], ["mary.poe [AT] a.org"]]
    draw = random.Random(5)
    for _ in range(3000):  # plausible pieces of any make
        text = "".join(draw.choice(["at", "At", "dot", ".", " ", "a", "é", "_", "(", ")", "7", "+", "@", "-", "word "]) for _ in range(draw.randrange(2, 24)))
        a = draw.randrange(len(text))
        b = draw.randrange(a + 1, len(text) + 1)
        if any(pii.plausible(kind, text, a, b) for kind in pii.KINDS):
            assert pii.window_starts(text) == [0], (text, a, b)
