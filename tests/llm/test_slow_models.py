"""The k-d tree's cuts and the language model's scores, each against a plain computation on a small table."""

import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_llm import awkward, small

from lodestat.llm import scoring, sharding


def test_cuts_are_weighted_medians(spark):
    for docs, shards in ((small(spark), 24), (small(spark), 5), (awkward(spark), 3)):
        frame = sharding.coordinates(docs, "doc_id", "text", "source", "lang")
        rows = [r.asDict() for r in frame.collect()]
        whole = sum(r["size"] for r in rows)
        widths = {d: max(1.0, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in sharding.DIMENSIONS}
        leaves = []

        def check(node, mine):
            if node.low is None:
                leaves.append((node.first, mine))
                assert node.shards == 1
                return
            spans = {d: (max(r[d] for r in mine) - min(r[d] for r in mine)) / widths[d] if mine else 0 for d in sharding.DIMENSIONS}
            assert not mine or math.isclose(spans[node.dim], max(spans.values()))
            goal = sum(r["size"] for r in mine) * (node.shards // 2) / node.shards
            below, best = 0, goal
            for r in sorted(mine, key=lambda r: r[node.dim]):  # the cut nearest to the goal, by sorting
                below += r["size"]
                best = min(best, abs(below - goal))
            low, high = [r for r in mine if r[node.dim] < node.cut], [r for r in mine if r[node.dim] >= node.cut]
            assert abs(sum(r["size"] for r in low) - goal) <= best + sharding.NEAR_ENOUGH * whole / shards + 1e-6
            check(node.low, low)
            check(node.high, high)

        check(sharding.kd_tree(frame, shards), rows)
        assert sorted(first for first, _ in leaves) == list(range(shards)) and sum(len(m) for _, m in leaves) == len(rows)


def test_scores_by_hand(spark):
    """Every word's class, its softmax over all classes, and its part of the class, word by word."""
    sizes = {"head": 40, "bands": 5, "table_words": 300}
    docs = small(spark).where("doc_id < 60").unionByName(small(spark).where("doc_id >= 190").withColumn("text", F.concat("text", F.lit(" neverseen Neverseen"))))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: (t or "").encode().lower().split()
    counts = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    ends = sum(not held(i) for i, _ in rows)
    frame = docs.select("doc_id", "text", scoring.fold("doc_id").alias("fold"))
    learning = frame.where(F.pmod("fold", F.lit(5)) != 1)
    lexicon = scoring.Lexicon(scoring.word_counts(learning), **sizes)
    model = scoring.train(scoring.classed(frame, lexicon).where(F.pmod("fold", F.lit(5)) != 1), lexicon)
    r, q, b, places = model.parts
    tokens, types = sum(counts.values()) + ends, len(counts) + 1

    def of_class(word):
        """Class, and the part of the class that the word has."""
        if word is None:
            return scoring.END_CLASS, 1.0
        at = lexicon.index.get(word)
        kind = int(lexicon.classes[at]) if at is not None else scoring.RARE_CLASS
        return kind, (counts[word] + 0.5) / lexicon.weight[kind] if at is None or at >= sizes["head"] else 1.0

    found = {x.doc_id: x for x in scoring.score_documents(docs, **sizes).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        base = score = 0.0
        before = [scoring.END_CLASS] * scoring.CONTEXT  # the nearest word first
        for word in [*words(text), None]:
            base += math.log10(((counts[word] if word else ends) + 0.5) / (tokens + 0.5 * (types + 1)))
            kind, part = of_class(word)
            hat = sum(r[c] * places[k] for k, c in enumerate(before))
            logits = np.array([float(hat @ q[c]) + float(b[c, 0]) for c in range(len(q))])
            share = math.exp(logits[kind] - np.logaddexp.reduce(logits))
            score += math.log10(share * part)
            before = [kind, *before[:-1]]
        x = found[i]
        assert x.held_out == held(i) and x.n_tokens == len(words(text)) + 1 and x.train_tokens == tokens
        assert x.n_known == sum(w in counts for w in words(text)) + 1
        assert math.isclose(x.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(x.score, score, rel_tol=1e-4, abs_tol=1e-3), (i, x.score, score)
