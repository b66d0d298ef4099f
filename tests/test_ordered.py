"""Ordered operators against direct computation: nulls, ties, repeats, hot groups, empty tables."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairwright.operators import metrics as M
from pairwright.operators import ordered as O
from pairwright.operators import relational as R


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    values = [0.5, -0.0, 0.0, 1e300, -3.0, 2.0**-1070, -(2.0**-1070), 7.0]
    return [(r.choice(["a", "a", "a", "b", None]), r.choice([r.gauss(0, 1), r.choice(values)]), i) for i in range(2500)] + [("c", 1.5, 9000), ("c", None, 9001)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, x double, i long").repartition(7)


def test_quantiles(frame):
    qs = [i / 300 for i in range(301)]
    got = {x.k: x.q for x in O.quantiles(frame, ["k"], "x", qs, one_task=0).collect()}
    want = {x.k: x.q for x in frame.groupBy("k").agg(F.percentile("x", qs).alias("q")).collect()}
    assert got == want and len(got) == 4
    weighed = O.quantiles(frame, [], "x", [0.3, 0.0, 1.0], F.col("i") % 3, one_task=0).first().q
    assert weighed == frame.agg(F.percentile("x", [0.3, 0.0, 1.0], F.col("i") % 3).alias("q")).first().q
    assert O.quantiles(frame.where("false"), ["k"], "x", qs, one_task=0).collect() == []


def test_numbers(frame, rows):
    by = defaultdict(list)
    for k, x, i in rows:
        by[k].append((x is None, -(x or 0.0), i))
    want = {(k, i): n + 1 for k, v in by.items() for n, (_, _, i) in enumerate(sorted(v))}
    got = O.numbered_by(frame, ["k"], [F.desc("x"), F.col("i")], "n").collect()
    assert {(x.k, x.i): x.n for x in got} == want and len(got) == len(rows)
    assert O.numbered_by(frame.where("false"), ["k"], [F.col("i")], "n").collect() == []


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_draw(spark, frame, rows, one_task, monkeypatch):
    monkeypatch.setattr(O, "DIGITS", 1)  # bins that hold several rows
    quota = spark.createDataFrame([("a", 777), (None, 50), ("c", 5), ("b", 0)], "k string, _w long")
    got = O.draw(frame, ["k"], F.sha2(F.col("i").cast("string"), 256), ["i"], quota, one_task).collect()
    assert Counter(x.k for x in got) == {"a": 777, None: 50, "c": 2}
    h = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    for k, n in (("a", 777), (None, 50)):
        assert sorted(x.i for x in got if x.k == k) == sorted(sorted((x[2] for x in rows if x[0] == k), key=h)[:n])
    twice = O.draw(frame.union(frame), ["k"], F.sha2(F.col("i").cast("string"), 256), ["i"], quota, one_task)
    assert twice.count() == 777 + 50 + 4
    with pytest.raises(ValueError):
        O.draw(frame, [], F.lit("0"), ["i"], quota)


def test_spearman(spark):
    r = random.Random(2)
    rows = [(k, float(r.randrange(6)), r.choice([None, r.randrange(4)]) if k == "n" else r.randrange(4)) for k in ("a", "b", "n", None) for _ in range(200)] + [("one", 1.0, 2), ("flat", 1.0, 2), ("flat", 1.0, 3), ("flat", 1.0, 4)]
    got = {x.k: x for x in M.spearman(spark.createDataFrame(rows, "k string, x double, y long"), ["k"], "x", "y").collect()}

    def ranks(v):
        at = defaultdict(list)
        for n, x in enumerate(sorted(v)):
            at[x].append(n + 1)
        return [sum(at[x]) / len(at[x]) for x in v]

    for k in ("a", "b", "n", None):
        xy = [(x, y) for kk, x, y in rows if kk == k and y is not None]
        a, b = ranks([x for x, _ in xy]), ranks([y for _, y in xy])
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        c = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5
        assert abs(got[k].spearman - c) < 1e-9 and got[k].n == 200
    assert got["one"].spearman != got["one"].spearman and got["flat"].spearman != got["flat"].spearman


def test_areas_of_a_hot_group(spark):
    r = random.Random(3)
    rows = [("hot", r.randrange(2), r.choice([0.5, r.random()])) for _ in range(3000)] + [("small", 1, 0.2), ("small", 0, 0.2), (None, 1, 0.1)]
    df = spark.createDataFrame(rows, "k string, label int, score double")
    got = {x.k: x.auc for x in M.roc_auc(df, ["k"]).collect()}
    pos, neg = ([s for k, y, s in rows if k == "hot" and y == v] for v in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(got["hot"] - want) < 1e-12 and got["small"] == 0.5 and got[None] is None


def test_ranks_of_runs(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", 3.0, True), ("a", 9.0, False), ("a", None, True), (None, 2.0, True)], "k string, s double, complete boolean")
    got = sorted(((x.k, x.s, x.rank) for x in R.complete_ranks(df, ["k"], "s").collect()), key=str)
    assert got == sorted([("a", 1.0, 3), ("a", 3.0, 1), ("a", 3.0, 1), ("a", 9.0, None), ("a", None, None), (None, 2.0, 1)], key=str)


def brute_pairs(rows):
    """All pairs of a cell by label; rows: (id, code, language, problem, split)."""
    out = defaultdict(set)
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if None not in (a[1], b[1], a[3], b[3]) and a[2] == b[2] and a[4] == b[4] and a[1] != b[1]:
                out[a[4], a[2], int(a[3] == b[3])].add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_generated_pairs(spark):
    from pairwright.operators.splits import generate_pairs

    rows = [(i, f"s{i}", "c", f"p{i % 2}", "train") for i in range(40)]  # 380 positives, 400 negatives
    rows += [(100 + i, f"s{i % 3}", "java", f"q{i % 4}" if i else None, "train") for i in range(13)]  # copies, a missing problem
    rows += [(200 + i, "same", "go", f"q{i % 4}", "test") for i in range(9)] + [(300, "alone", "py", "x", "test"), (301, None, "py", "x", "test"), (302, "y", None, "x", None), (303, "z", None, "x", None), (304, "w", None, "v", None)]
    df = spark.createDataFrame(rows, "code_id long, code string, language string, problem_id string, split string").repartition(4)
    every = brute_pairs(rows)
    for quota in (150, 10**6):
        got = generate_pairs(df, quota)
        by = defaultdict(list)
        for r in got.collect():
            by[r.split, r.language, r.label].append((r.left_id, r.right_id))
        for cell in {k[:2] for k in every}:
            n = min(quota, *(len(every[(*cell, y)]) for y in (0, 1)))
            for y in (0, 1):
                assert len(by[(*cell, y)]) == len(set(by[(*cell, y)])) == n and set(by[(*cell, y)]) <= every[(*cell, y)]
        assert {k[:2] for k in by if by[k]} <= {k[:2] for k in every}
    assert generate_pairs(df.where("false"), 5).collect() == []
