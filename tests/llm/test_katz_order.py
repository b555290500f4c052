"""Katz scores of order two and three against a plain model of any order."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import katz


def plain(texts, order):
    """Probability of a word after a list of words, by recursion over the context."""
    tables = [defaultdict(Counter) for _ in range(order)]
    for t in texts:
        words = ["<s>", *t, None]
        for i in range(1, len(words)):
            for m in range(min(order, i + 1)):
                tables[m][tuple(words[i - m : i])][words[i]] += 1
    low = [Counter(c for x in table.values() for c in x.values()) for table in tables]
    discounts = [katz.good_turing([n[i] for i in range(katz.GT_LIMIT + 2)]) for n in low]
    cut = lambda m, c: c * (discounts[m][c] if c <= katz.GT_LIMIT else 1.0)

    def p(w, h):
        m, seen = len(h), tables[len(h)].get(tuple(h), Counter())
        if m and not seen:
            return p(w, h[1:])
        n = sum(seen.values())
        free = n - sum(cut(m, c) for c in seen.values())
        size, rest = (n, free) if free > 1e-12 else (n + 1, 1)
        if not m:
            return (cut(0, seen[w]) if seen[w] else rest) / size
        room = 1 - sum(p(x, h[1:]) for x in seen)
        if room <= 1e-12:
            return cut(m, seen[w]) / (n - free)
        return cut(m, seen[w]) / size if seen[w] else rest / size / room * p(w, h[1:])

    return p, tables


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("hot", [0.02, 0.25])
def test_katz_of_any_order(spark, monkeypatch, order, hot):
    monkeypatch.setattr(katz, "HOT_SHARE", hot)
    draw = random.Random(7)
    texts = [[f"w{min(int(draw.expovariate(0.3)), 25)}" for _ in range(draw.randrange(12))] for _ in range(150)]
    texts += [["w0"], [], ["new", "w1", "w2", "w3"], ["w1", "w2", "new", "w1", "w2"]] + texts[:3]
    held = [i % 5 == 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3, "doc_id")
    got = {r.doc_id: r.score for r in katz.katz_scores(docs, F.col("doc_id") % 5 == 2, ranges=2, order=order).collect()}
    p, tables = plain([t for t, h in zip(texts, held, strict=True) if not h], order)
    words = [w for w in tables[0][()]]
    for h in list(tables[order - 1])[:4]:
        assert sum(p(w, list(h)) for w in [*words, "unseen"]) == pytest.approx(1.0)
    for i, t in enumerate(texts):
        line = ["<s>", *t, None]
        want = sum(math.log10(p(line[j], line[max(0, j - order + 1) : j])) for j in range(1, len(line)))
        assert got[i] == pytest.approx(want, abs=1e-8), (i, t)
