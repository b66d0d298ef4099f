"""Edit distances and ranking losses against brute force."""

import itertools
import math
import random

from pairwright.operators import graphs as G
from pairwright.operators import relational as R
from pairwright.operators import sampling as S


def brute_distance(n1, e1, n2, e2):
    n = max(n1, n2)
    return min(abs(n1 - n2) + len({(p[a], p[b]) for a, b in e1} ^ set(e2)) for p in itertools.permutations(range(n)))


def graph(r, n, share):
    return {(a, b) for a in range(n) for b in range(n) if r.random() < share}


def test_edit_distance():
    r = random.Random(5)
    for _ in range(120):
        n1, n2 = r.randint(0, 6), r.randint(0, 6)
        e1, e2 = graph(r, n1, r.choice([0.1, 0.3, 0.7])), graph(r, n2, r.choice([0.1, 0.3]))
        d = brute_distance(n1, e1, n2, e2)
        assert G.edit_distance(n1, e1, n2, e2) == G.edit_distance(n2, e2, n1, e1) == d
        most = max(n1 + len(e1), n2 + len(e2))
        assert G.graph_edit_similarity(n1, e1, n2, e2) == (max(0.0, 1 - d / most) if most else 1.0)
    for _ in range(3):
        e1, e2 = graph(r, 7, 0.2), graph(r, 7, 0.2)
        assert G.edit_distance(7, e1, 7, e2) == brute_distance(7, e1, 7, e2)


def test_edit_distance_of_twelve_nodes():
    """Copies with up to three edits are told within the steps; a search that runs out says so."""
    r = random.Random(6)
    solved = 0
    for _ in range(20):
        e1 = graph(r, 12, 0.12)
        e2 = set(e1)
        for x in r.sample([(a, b) for a in range(12) for b in range(12)], r.randint(0, 3)):
            e2 ^= {x}
        p = r.sample(range(12), 12)
        d = G.edit_distance(12, e1, 12, {(p[a], p[b]) for a, b in e2}, 4000)
        solved += d is not None and d <= len(e1 ^ e2)
    assert solved >= 17
    assert G.edit_distance(12, graph(r, 12, 0.5), 12, graph(r, 12, 0.5), 5) is None and G.graph_edit_similarity(12, {(0, 1)}, 12, {(0, 0), (1, 2)}, 0) is None


def test_edit_similarities(spark):
    g = spark.createDataFrame([("a", 3, [(0, 1), (1, 2)]), ("b", 3, [(2, 1), (1, 0)]), ("c", 0, []), ("d", 2, [(0, 0)])], "code_id string, n int, edges array<struct<src:int,dst:int>>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "c"), ("a", "d"), ("a", "missing"), (None, "a")], "left_id string, right_id string")
    got = {(x.left_id, x.right_id): x.similarity for x in G.edit_similarities(pairs, g).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 0.0, ("c", "c"): 1.0, ("a", "d"): 1 - 4 / 5}
    assert G.edit_similarities(pairs.limit(0), g).collect() == []


def test_ranking_loss(spark):
    r = random.Random(7)
    rows = [(k, r.choice([0, 1, 1]), r.choice([0.5, r.gauss(0, 3)])) for k in ("a", "b", None) for _ in range(150)] + [("one", 1, 0.3), ("hot", 0, 800.0), ("hot", 1, -800.0), ("a", None, 1.0), ("a", 1, None)]
    df = spark.createDataFrame(rows, "k string, label int, score double").repartition(4)
    for block in (7, 10_000):
        got = {x.k: (x.pairs, x.loss) for x in R.ranking_loss(df, ["k"], block).collect()}
        for k in ("a", "b", None, "hot", "one"):
            pos, neg = ([s for kk, y, s in rows if kk == k and y == v and s is not None] for v in (1, 0))
            soft = [max(0, y - x) + math.log1p(math.exp(-abs(y - x))) for x in pos for y in neg]
            assert got[k][0] == len(soft) and abs(got[k][1] - (sum(soft) / len(soft) if soft else 0)) < 1e-9
    assert R.ranking_loss(df.limit(0), ["k"]).collect() == []


def test_budget_of_many_pairs(spark):
    """The pass in order and its second phase, for a hundred thousand pairs."""
    import hashlib

    r = random.Random(8)
    pairs = sorted({(r.randrange(3000), r.randrange(3000)) for _ in range(100_000)})
    df = spark.createDataFrame(pairs, "left_id long, right_id long").repartition(8)
    chosen = {}
    for a, b in pairs:
        h = hashlib.sha256(f"4:{a}/{b}".encode()).hexdigest()
        key = (min(a, b), max(a, b))
        chosen[key] = min(chosen.get(key, (h, a, b)), (h, a, b))
    order = sorted(chosen.values())
    for n, budget in ((20_000, 801), (0, 802), (50, 900), (30_000, 0)):
        seen, kept, rest = set(), [], []
        for _, a, b in order:
            if (not n or len(kept) < n) and (not budget or len(seen | {a, b}) <= budget):
                seen |= {a, b}
                kept.append((a, b))
            else:
                rest.append((a, b))
        more = [p for p in rest if set(p) <= seen] if budget else []
        kept += more[: n - len(kept)] if n else more
        assert {tuple(x) for x in S.budget_select(df, n, budget, 4).collect()} == set(kept), (n, budget)
