"""Operators that must not form pairs or gather a key's rows, against plain versions, with their row counts asserted."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.functions import learning as L
from tideline.operators import assignment as A
from tideline.operators import graph as G
from tideline.operators import relational as R
from tideline.operators import windows as W


def rows_made(frame):
    """The largest number of rows that any node of the plan gave, after the frame was collected."""
    todo, most = [frame._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.finalPhysicalPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            most = max(most, metric.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


# The last entry before a time

ASKED, ENTRIES = "k int, at timestamp, n int", "k int, since timestamp, id int, note string"


def plain_as_of(asked, entries):
    out = []
    for k, at, n in asked:
        own = [(since, i, note) for kk, since, i, note in entries if kk == k and k is not None and since is not None and at is not None and since <= at]
        out.append((n, max(own)[1] if own else None))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_last_entry_before(spark, seed):
    import datetime as dt

    rng = random.Random(seed)
    at = lambda: rng.choice([None, *[dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 200)) for _ in range(12)]])
    asked = [(rng.choice([1, 2, 3, None]), at(), i) for i in range(150)] + [(9, dt.datetime(2024, 1, 1), 999)]
    entries = [(rng.choice([1, 2, 4, None]), at(), i, "x") for i in range(60)]
    got = R.as_of(spark.createDataFrame(asked, ASKED), spark.createDataFrame(entries, ENTRIES), "k", "at", "since").select("n", "_entry.id").collect()
    assert sorted(map(tuple, got)) == plain_as_of(asked, entries)


def test_last_entry_of_a_hot_key_is_carried_not_joined(spark):
    n = 3000
    base = spark.range(n)
    asked = base.select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.col("id").cast("int").alias("n"))
    entries = base.select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 60 + 30).alias("since"), F.col("id").cast("int").alias("id"))
    found = R.as_of(asked, entries, "k", "at", "since")
    got = {r.n: r["_entry"] and r["_entry"].id for r in found.collect()}
    assert got == {i: i - 1 if i else None for i in range(n)} and rows_made(found) <= 2 * n


# Folds that merge


def fold(weights, x=0.5):
    for w in weights:
        x = max(0.0, min(1.0, x + w))
    return x


def test_slices_of_a_history_fold_apart(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        weights = [rng.choice([0.15, -0.12, 0.10, -0.05, 0.12, 0.9, -0.9]) for _ in range(rng.randint(0, 60))]
        want[k] = fold(weights)
        rows += [(k, i * 7 // 20, i, w) for i, w in enumerate(weights)]
    slices = spark.createDataFrame(rows, "k int, slice int, i int, w double").groupBy("k", "slice").agg(L.clamped_sum(W.ordered_list("w", "i")).alias("s"))
    got = {r.k: r.m for r in slices.groupBy("k").agg(L.merged_sums(W.ordered_list("s", "slice")).alias("t")).select("k", L.applied(F.col("t")).alias("m")).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if k in got} and len(got) == len({r[0] for r in rows})


def test_merging_any_cut_gives_the_fold(spark):
    rng = random.Random(4)
    weights = [rng.uniform(-0.6, 0.6) for _ in range(50)]
    for _ in range(6):
        cuts = sorted({0, *rng.sample(range(1, 50), 5), 50})
        parts = F.array(*[L.clamped_sum(F.array(*[F.lit(w) for w in weights[a:b]])) for a, b in zip(cuts, cuts[1:])])
        got = spark.range(1).select(L.applied(L.merged_sums(parts)).alias("x")).first()["x"]
        assert got == pytest.approx(fold(weights), abs=1e-9)


def test_an_empty_slice_changes_nothing(spark):
    none = L.clamped_sum(F.array().cast("array<double>"))
    some = L.clamped_sum(F.array(F.lit(0.3), F.lit(0.4)))
    for parts in ([none], [none, some], [some, none], [none, none, some]):
        x = spark.range(1).select(L.applied(L.merged_sums(F.array(*parts))).alias("x")).first()["x"]
        assert x == pytest.approx(0.5 if parts == [none] else 1.0)


# Order of a graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "prerequisite string, dependent string")


def test_a_chain_of_fifty_levels(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(50)]
    got = {r.node: r.level for r in G.topological_levels(edges(spark, chain + chain[:3] + [("n0", "n40"), ("n7", "n7"), ("x", "n50"), (None, "y")])).collect()}
    assert got == {f"n{i}": i for i in range(51)} | {"x": 0}


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="4 nodes"):
        G.topological_levels(edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e")]))
    assert G.topological_levels(edges(spark, [])).count() == 0


# Near values of bits


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


@pytest.mark.parametrize("most", [0, 3, 4, 6])
def test_near_bits_are_found_exactly(spark, most):
    rng = random.Random(most)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:40]:
        for flips in (1, 3, 4, 6, 7):
            w = v
            for i in rng.sample(range(64), flips):
                w ^= 1 << i
            values.append(w)
    values += [values[0], values[0], 0, (1 << 64) - 1, 1 << 63]
    rows = [(i, signed(v)) for i, v in enumerate(values)] + [(None, 5), (9999, None)]
    got = {(r.a, r.b, r.distance) for r in R.hamming_pairs(spark.createDataFrame(rows, "id int, bits long"), "id", "bits", most).collect()}
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= most}
    assert got == want


def test_two_slices_leave_few_candidates_of_skewed_bits(spark):
    """The upper half of all values is the same, so slices of it say nothing."""
    rng = random.Random(7)
    values = {signed((0xABCDEF01 << 32) | rng.getrandbits(32)) for _ in range(1500)}
    frame = spark.createDataFrame([(v,) for v in values], "bits long")
    pairs = len(values) * (len(values) - 1) // 2
    cut = lambda n: R.hamming_candidates(frame, "bits", n)
    found = cut(2)
    n = found.count()
    assert n == len(set(map(tuple, found.collect()))) and n <= pairs
    spread = spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(1500)], "bits long")
    assert R.hamming_candidates(spread, "bits", 4).count() < pairs / 500


def test_copies_are_compared_once(spark):
    frame = spark.createDataFrame([(i, 77) for i in range(300)] + [(1000, 76)], "id int, bits long")
    assert R.hamming_candidates(frame, "bits", 4).count() == 1
    assert R.hamming_pairs(frame, "id", "bits", 4).count() == 300 * 299 // 2 + 300


# Taking turns


def plain_turns(hits):
    wishes, taken = defaultdict(list), defaultdict(set)
    for label, query, item, rank in sorted(hits, key=lambda h: (h[3], h[2])):
        wishes[label, query].append(item)
    out = []
    for label, query in sorted(wishes):
        free = next((i for i in wishes[label, query] if i not in taken[label]), None)
        if free is not None:
            taken[label].add(free)
            out.append((query, free))
    return sorted(out)


@pytest.mark.parametrize("items", [200, 3000])
def test_turns_of_a_thousand_queries_of_one_label(spark, items):
    rng = random.Random(items)
    hits = [(1, q, i, r) for q in range(1000) for r, i in enumerate(rng.sample(range(items), 8))] + [(2, q, i, 0) for q in range(5) for i in (q, 3)]
    got = sorted(map(tuple, A.in_turn(spark.createDataFrame(hits, "label int, query int, id int, rank int")).collect()))
    assert got == plain_turns(hits)


def test_nobody_asks(spark):
    assert A.in_turn(spark.createDataFrame([], "label int, query int, id int, rank int")).count() == 0


# The nearest of a partition


@pytest.mark.parametrize("block", [7, 20_000])
def test_nearest_vectors_by_blocks(spark, monkeypatch, block):
    import numpy as np

    from tideline.operators import retrieval as V

    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(120, 4)), 1)
    v[5] = 0
    v[60:70] = v[50:60]  # ties
    labels = [int(x) for x in rng.integers(0, 3, 120)]
    rows = [(i, v[i].tolist(), labels[i]) for i in range(120)]
    vectors = spark.createDataFrame([(i, x, c) for i, x, c in rows], "id int, vector array<double>, label int")
    queries = spark.createDataFrame([(1000 + i, x, c) for i, x, c in rows if i % 9 == 5] + [(2000, [1.0, 0.0, 0.0, 0.0], 77)], "query int, vector array<double>, label int")
    unit = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    want = []
    for i, _, c in rows:
        if i % 9 == 5:
            ranked = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in range(120) if labels[j] == c)[:6]
            want += [(1000 + i, j, r + 1) for r, (_, j) in enumerate(ranked)]
    found = V.topk_filtered(queries, vectors, "label", 6)
    assert sorted((r.query, r.id, r["rank"]) for r in found.collect()) == sorted(want)
    assert V.topk_filtered(queries, vectors.where("false"), "label", 6).count() == 0


# Folds that look at what matters only


def test_quiz_answers_fold_as_one_by_one(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(80):
        outcome, wrong, done, revealed = None, 0, False, False
        for i in range(rng.randint(1, 6)):
            g = rng.choice(["CORRECT", "PARTIAL", "INCORRECT", "INCORRECT", "NOT_AN_ANSWER", "NOT_AN_ANSWER"])
            rows.append((k, i, g))
            if not done and g != "NOT_AN_ANSWER":
                outcome, wrong = g, wrong + (g == "INCORRECT")
                revealed = wrong >= 2
                done = g != "INCORRECT" or revealed
        want[k] = (outcome, wrong, revealed, 1.0 if outcome == "CORRECT" else 0.5 if outcome == "PARTIAL" and not revealed else 0.0)
    from tideline.functions import structure as X

    got = X.quiz_fold(spark.createDataFrame(rows, "k int, i int, g string"), ["k"], ["i"], "g").collect()
    assert {r.k: (r.outcome, r.attempts, r.revealed, r.points) for r in got} == want


def test_alerts_fold_as_one_by_one(spark):
    import datetime as dt

    from tideline.streaming import alerts

    rng, start = random.Random(9), dt.datetime(2024, 1, 1)
    rows, want = [], {}
    for k in range(40):
        state, last, sent, resolved, t = "ok", None, 0, 0, 0
        for i in range(rng.randint(1, 15)):
            t += rng.choice([0, 1, 5, 20])
            hit = rng.random() < 0.7
            rows.append((k, start + dt.timedelta(minutes=t), i, hit))
            if hit and (state == "ok" or t - last >= 15):
                last, sent = t, sent + 1
            resolved += not hit and state == "firing"
            state = "firing" if hit else "ok"
        want[k] = (state, last, sent, resolved)
    got = alerts.fold_alerts(spark.createDataFrame(rows, "k int, ts timestamp, id int, hit boolean"), ["k"], ["ts", "id"], "hit", 900).collect()
    assert {r.k: (r.state, r.last_notified and (r.last_notified - start).seconds // 60, r.sent, r.resolved) for r in got} == want
