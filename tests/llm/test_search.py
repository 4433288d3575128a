"""Ranked search for many items against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np

from pacewright.llm import search
from pacewright.llm.search import accumulated, ranked_documents, sharing_graph

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, most=20):
    counts = [(k, Counter(terms(t))) for k, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (k, c), length in zip(counts, lengths, strict=True):
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 75 + 25 * length * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, k is None, k or 0, k))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:most], 1)]
    return Counter(out)


def ranked(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 id", "2 rank", "'x' item_id").repartition(5)
    return ranked_documents(d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 id", "4 score"), **more)


def corpus(rng):
    words = ["the", "of", "É", "日本", "a1", "x_y", "KK", *(f"w{k}" for k in range(60))]
    text = lambda n: "".join(rng.choice(words[:7] if rng.random() < 0.5 else words) + rng.choice([" ", "-", "\n", " "]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(200)] + [(None, text(30)), (None, None), (7, ""), (8, "\x00 --")]
    docs += [(300 + k, "W3 the w4") for k in range(40)] + [(5, "W3 the w4")] * 3  # ties
    items = [(k, text(rng.randint(1, 40))) for k in range(25)] + [(3, "w3 W3 w4"), (None, "the of w9"), (30, None), (31, ""), (32, "unheard")]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus(random.Random(12))
    docs.append((900, "w3 " * 150_000))
    assert Counter(map(tuple, ranked(spark, docs, items).collect())) == brute(docs, items)
    monkeypatch.setattr(search, "ITEMS", 7)  # several blocks of items, and few documents at once
    monkeypatch.setattr(search, "ACCUMULATORS", 1000)
    assert Counter(map(tuple, ranked(spark, docs, items, most=3).collect())) == brute(docs, items, 3)


def test_nothing_to_rank(spark):
    docs, items = corpus(random.Random(13))
    assert ranked(spark, [], items).count() == 0
    assert ranked(spark, docs, []).count() == 0
    assert ranked(spark, [(1, None), (2, "  ")], items).count() == 0
    assert ranked(spark, docs, []).columns == ["item_id", "rank", "doc_id", "score"]


def test_shared_sets_are_added_once():
    rng = np.random.default_rng(3)
    common = set(range(20))
    sets = [common | set(rng.choice(np.arange(20, 60), 5, replace=False).tolist()) for _ in range(100)]
    graph = sharing_graph(60, sets)
    leaves = rng.integers(0, 1 << 40, (60, 9))
    assert (accumulated(graph, leaves) == np.stack([leaves[sorted(s)].sum(axis=0) for s in sets])).all()
    # without sharing each item adds up its 25 terms
    assert len(graph.pairs) + sum(len(t) - 1 for t in graph.tops) < 500 < sum(len(s) - 1 for s in sets)
    assert sharing_graph(3, [{0, 1}, {2}, set()]).pairs == []
