"""The other corpus operators against brute force, round trips and held-out labels."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairwright.llm import chat_format, decontaminate, minhash, mixing, quality_knn, quality_rules, token_output, warc
from pairwright.llm.common import fresh_path
from pairwright.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, did int, rid string, id string, size string, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, a, s, None, 1, "x", None, "y", "z") for i, t, a, s in rows], DOCS).repartition(4)


def words(r, n, vocab=4000):
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def odd_rows(r):
    rows = [(i, " ".join(words(r, r.randint(0, 90))), r.choice(["en", "fr", None]), r.choice(["a", "b", "ß", None])) for i in range(120)]
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, " \n ", "en", "a"), (5, rows[5][1], "en", "a"), (None, rows[6][1], "en", "b"), (203, "x " * 9000, "en", "c"), (204, "y" * 20000, "en", "c"), (rows[7][0], rows[7][1], rows[7][2], rows[7][3])]
    return rows


# ---- mixing ----


def brute_targets(total):
    """Words of each source: shared by weights 1, 2, 3, at most three times its own."""
    order = sorted([s for s in total if s is not None]) + [None] * (None in total)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(total.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 3 * total[s]}
        if not over:
            return target | {s: weight[s] * share for s in free}
        target |= {s: 3.0 * total[s] for s in over}
        left -= sum(3 * total[s] for s in over)
        free -= over
    return target


def brute_pareto(rows, target):
    """Times each (id, text) of one source is taken; rows: (id, rid, size, u), one for each document."""
    measure = [int(np.floor(np.log2(z + 2) * 64 + 1e-6)) for _, _, z, _ in rows]
    total = sum(z for _, _, z, _ in rows)
    if target >= 3 * total * (1 - 1e-12):
        c = 1e18
    else:
        c = 0.0
        while True:
            done = [c * m >= 3 for m in measure]
            free = sum(z * m for (_, _, z, _), m, d in zip(rows, measure, done, strict=True) if not d)
            new = (target - 3 * sum(z for (_, _, z, _), d in zip(rows, done, strict=True) if d)) / free if free else c
            if max(c, new) == c:
                break
            c = max(c, new)
    take, ranking = [], []
    for k, ((i, rid, z, u), m) in enumerate(zip(rows, measure, strict=True)):
        e = min(3.0, c * m)
        take.append(int(np.floor(e + 1e-9)))
        f = max(0.0, e - take[-1])
        if f > 1e-9 and z > 0:
            odds = (u / (1 - u)) / (f / (1 - f))
            ranking.append((odds / (1 + odds), i or 0, rid, k))
    ranking.sort()
    rest = target - sum(t * z for t, (_, _, z, _) in zip(take, rows, strict=True))
    cut, drawn = 1.0, set()
    for g, _, _, k in ranking:
        z = rows[k][2]
        if z > rest:  # the document at the cut
            cut = np.floor(g * 4096**2) / 4096**2
            if z / 2 < rest:
                drawn.add(k)
            break
        drawn.add(k)
        rest -= z
    for _ in range(3):
        gap = target - sum((t + (k in drawn)) * rows[k][2] for k, t in enumerate(take))
        near = [(abs(g - cut), i, rid, k) for g, i, rid, k in ranking if gap and abs(gap - (-1 if k in drawn else 1) * rows[k][2]) <= abs(gap) / 2]
        if near:
            drawn ^= {min(near)[3]}
    return [t + (k in drawn) for k, t in enumerate(take)]


def test_mixing(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = odd_rows(r)
    for k in range(90):  # the same id and text in several sources, and many times in one
        rows += [(700, rows[11][1], "en", s) for s in (("a", "b", None)[k % 3], "ß") if k < 60 or s == "ß"]
    rows += [(None, rows[12][1], "en", s) for s in ("a", "a", "b", None)]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    total = defaultdict(int)
    for _, t, _, s in rows:
        total[s] += size(t)
    target = brute_targets(total)
    text = F.coalesce("text", F.lit(""))
    src = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    df2 = df.select("doc_id", "text", "source", src.alias("src"), F.regexp_count(text, F.lit(WORD.pattern)).cast("long").alias("size"), F.xxhash64("doc_id", text).alias("rid"), F.col("doc_id").alias("id"))
    by = defaultdict(list)
    for x in df2.select("doc_id", "text", "source", "rid", "src", "size", mixing.uniform(mixing.SEED).alias("u")).collect():
        key = f"{mixing.SEED}/{'null' if x.doc_id is None else x.doc_id}/{x.src}/{x.size}"
        assert x.u == (int(hashlib.sha256(key.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        by[x.source].append((x.doc_id, x.rid, size(x.text), x.u, x.text))
    want, copies = Counter(), Counter()
    for s, some in by.items():
        for x, n in zip(some, brute_pareto([y[:4] for y in some], target[s]), strict=True):
            want[x[0], x[2], total[s], round(target[s], 6), n] += 1
            copies[x[0], x[4], s] += n
    assert Counter((x.doc_id, x.size, x.source_size, round(x.target, 6), x.copies) for x in got) == want
    assert all(0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size for x in got)
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.copies(df)
    assert out.columns == df.columns
    assert Counter(tuple(x) for x in out.select("doc_id", "text", "source").collect()) == +copies
    empty = docs(spark, [])
    assert mixing.mix(empty).count() == 0 and mixing.copies(empty).count() == 0


def test_mixing_meets_its_targets(spark):
    r = random.Random(30)
    rows = [(k, " ".join(words(r, r.choice((5, 60, 200, 900)))), "en", "abcd"[min(3, r.randrange(7))]) for k in range(900)]
    total, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        total[s] += len(t.split())
    target = brute_targets(total)
    of = {i: s for i, _, _, s in rows}
    for x in mixing.mix(docs(spark, rows)).collect():
        taken[of[x.doc_id]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] for s in total), (dict(taken), target)


# ---- WARC ----


def test_warc(spark):
    big = "<p>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\n" + "</p>"
    rows = [(1, "http://x/1", big), (7, "http://x/ü\r\nX: y", big), (3, None, big), (None, "u", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (8, "u", ""), (9, "u", "z" * 100), (10, "u", "z" * 100), (11, "u", "z" * 99), (12, "u", "z" * 99), (9, "v", "z" * 100)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = fresh_path(spark, "warc-test")
    got = warc.read_archives(warc.write_archives(df, path)).collect()
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = [q for q, _, g in rows if (g or "").encode() == raw and q is not None]
        ref = min(same) if len(raw) >= 100 and (p is None or p > min(same)) else None
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if ref is not None else "response", ref))
    assert Counter(tuple(x[:5]) for x in got) == Counter(want)
    assert Counter(x.html for x in got if x.record_type == "response") == Counter(h or "" for (_, _, h), w in zip(rows, want, strict=True) if w[3] == "response")
    assert warc.roundtrip(df.limit(0)).count() == 0


# ---- near duplicates ----


def brute_similarity(a, b):
    out = 0.0
    for d in a.keys() & b.keys():
        out += 1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys())
    return out


def shingle_bag(text):
    w = WORD.findall(text or "")
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute_classes(rows):
    bags = [shingle_bag(t) for _, t, _, _ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or bags[i].keys() & bags[j].keys() and brute_similarity(bags[i], bags[j]) >= 0.8 - 1e-9:
            label[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups


def test_similarity_and_signatures():
    r = np.random.default_rng(0)
    n, total = 60, 0.0
    for _ in range(n):
        ha = np.sort(r.choice(2**60, 80, replace=False).astype(np.uint64))
        keep = r.random(80) < 0.8
        wa = r.integers(1, 6, 80)
        hb, wb = ha[keep], np.where(r.random(keep.sum()) < 0.8, wa[keep], r.integers(1, 6, keep.sum()))
        exact = minhash.similarity(ha, wa, hb, wb)
        slow = brute_similarity(Counter(dict(zip(ha.tolist(), wa.tolist(), strict=True))), Counter(dict(zip(hb.tolist(), wb.tolist(), strict=True))))
        assert abs(exact - slow) < 1e-9
        with np.errstate(over="ignore"):
            sig = minhash.signatures(np.repeat([0, 1], [len(ha), len(hb)]), np.concatenate([ha, hb]), np.concatenate([wa, wb]), 2)
        total += (sig[0] == sig[1]).mean() - exact
    assert abs(total / n) < 0.02


def test_near_duplicates(spark):
    r = random.Random(9)
    rows = []
    base = [words(r, n) for n in (120, 60, 200)]
    for k in range(90):
        w = list(base[k % 3])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randrange(9999)}"
        rows.append((k, " ".join(w), "en", "a"))
    rows += [(100 + k, " ".join(words(r, r.randint(1, 60))), "en", "a") for k in range(40)]
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, "a b", "en", "a"), (203, "a  b", "en", "a"), (204, "a b c", "en", "a"), (3, rows[3][1], "en", "a"), (None, rows[4][1], "en", "b"), (206, "x " * 3000, "en", "b"), (207, "x " * 3001, "en", "b"), (None, "alone here", "en", "b")]
    df = docs(spark, rows)
    got = minhash.near_classes(df).collect()
    groups = brute_classes(rows)
    want = Counter()
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            want[rows[i][0], min(ids) if ids else None, len(g)] += 1
    assert Counter(map(tuple, got)) == want
    kept = minhash.representatives(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert minhash.near_classes(docs(spark, [])).count() == 0
    assert minhash.representatives(docs(spark, [])).count() == 0


def test_blocks_of_pairs():
    """Links of a block join just the classes that links between all pairs join."""
    r = random.Random(12)
    base = [words(r, 80), ["a", "b"] * 60, words(r, 40)]
    texts = []
    for k in range(90):
        w = list(base[k % 3])
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = f"n{r.randrange(50)}"
        texts.append(" ".join(w))
    texts += ["", "one", "two words", "one"]
    bags = [shingle_bag(t) for t in texts]
    side = np.array([r.randint(0, 1) for _ in texts])
    given = np.array([r.randrange(200) for _ in texts])

    def classes(links):
        label = [int(x) for x in given]
        for i, j in links:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
        return label

    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if bags[i].keys() & bags[j].keys() and brute_similarity(bags[i], bags[j]) >= 0.8 - 1e-9]
    for within in (True, False):
        for rows in (5, 256):
            got = minhash.block_links([t.encode() for t in texts], given, np.zeros(len(texts), int) if within else side, within, rows=rows, entries=400 if rows == 5 else 1 << 15)
            assert set(map(lambda x: tuple(sorted(x)), got)) <= set(near)
            want = [(i, j) for i, j in near if within or side[i] != side[j]]
            assert classes(got) == classes(want)


def test_large_bucket_of_unlike_copies(spark):
    """2,000 copies of one text, each edited on its own: most pairs are candidates, few are links."""
    r = random.Random(31)
    base = words(r, 90)
    rows = []
    for k in range(2000):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 3, 3))):
            w[r.randrange(len(w))] = f"new{r.randrange(9)}"
        rows.append((k, " ".join(w), "en", "a"))
    bags = [shingle_bag(t) for _, t, _, _ in rows]
    terms = {}
    at = [[terms.setdefault(g, len(terms)) for g in b] for b in bags]
    hold = np.zeros((len(rows), len(terms)), np.float32)
    for i, x in enumerate(at):
        hold[i, x] = 1
    assert all(max(b.values()) == 1 for b in bags)  # so probability Jaccard is Jaccard
    both = hold @ hold.T
    size = hold.sum(1)
    link = both / (size[:, None] + size[None, :] - both) >= 0.8 - 1e-6
    same = [t for _, t, _, _ in rows]
    label = np.arange(len(rows))
    while True:
        new = np.where(link, label[None, :], len(rows)).min(1)
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    assert 3 < len(set(label.tolist())) and len(set(same)) > 1000
    assert 0.05 < (both / (size[:, None] + size[None, :] - both) < 0.8).mean()
    for block in (1024, 150):
        got = minhash.classes(docs(spark, rows), block=block).select("id", "label").collect()
        groups = defaultdict(set)
        for x in got:
            groups[x.label].add(x.id)
        want = defaultdict(set)
        for i, x in enumerate(label.tolist()):
            want[x].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)]
    got = dict(map(tuple, minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


# ---- rules ----


def brute_rules(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def brute_bin(x):
    v = round(x * 10**6)
    off = max(0, v.bit_length() - 11)
    return (v >> off << off) / 10**6


def brute_kept(rows, k):
    """Verdict of row k by quartiles of its own group, blended with its language's and those of all."""
    data = [(a, s, brute_rules(t)) for _, t, a, s in rows]
    good = [d for d in data if not d[2][5]]

    def measures(t, b):
        n, chars, sym, dup, rep, _ = b
        lines = sum(1 for x in (t or "").split("\n") if WORD.search(x))
        return [round(x / y, 6) if y else 0.0 for x, y in ((sym, chars), (chars, n), (dup, lines), (rep, n))]

    values = [measures(t, d[2]) for (_, t, _, _), d in zip(rows, data, strict=True)]
    own = [i for i, d in enumerate(data) if not d[2][5] and d[:2] == data[k][:2]]
    lang, every = [i for i, d in enumerate(data) if not d[2][5] and d[0] == data[k][0]], [i for i, d in enumerate(data) if not d[2][5]]
    fine = not data[k][2][5] and bool(good)

    def quartile(group, m, p):
        v = sorted(brute_bin(values[i][m]) for i in group)
        return v[max(0, -(-len(v) * p // 4) - 1)] if v else 0.0

    def blended(m, p):
        out = quartile(every, m, p)
        for group in (lang, own):
            out = (len(group) * quartile(group, m, p) + 4 * out) / (len(group) + 4)
        return out

    for m, (low, slack) in enumerate(((False, 0.05), (True, 1.5), (False, 0.3), (False, 0.1))):
        lo, hi = blended(m, 1), blended(m, 3)
        width = max(slack, 3 * (hi - lo))
        fine &= values[k][m] <= hi + width and (not low or values[k][m] >= lo - width)
    return fine


def test_rules(spark):
    r = random.Random(5)
    rows = odd_rows(r)
    for k in range(60):
        w = words(r, 60)
        if k % 4 == 0:
            w = w + w[:30]
        t = " ".join(w).replace(" w1", "\nw1")
        rows.append((300 + k, t + ("\n" + t.split("\n")[0]) * (k % 3), "en", "a"))
    rows += [(400, " ".join(x + "%%%" for x in words(r, 50)), "en", "a"), (401, "a|b " * 5 + "\n" * 50, "en", "a")]
    rows.append((402, " ".join(words(r, 60_000)), "fr", "b"))
    df = docs(spark, rows)
    got = quality_rules.judge(df).collect()
    assert Counter((x.doc_id, *x[1:7]) for x in got) == Counter((i, *brute_rules(t)) for i, t, _, _ in rows)
    assert sum(x.kept for x in got) > 100
    assert not any(x.base_failed and x.kept for x in got)
    assert Counter((x.doc_id, x.kept) for x in got) == Counter((i, brute_kept(rows, k)) for k, (i, *_) in enumerate(rows))
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_rules_reject_by_each_measure(spark):
    """A document far outside its own source's fences goes, by whichever measure; the same one stays where it is common."""
    r = random.Random(6)
    plain = lambda: " ".join(words(r, 60, 10**6))
    odd = {
        "symbols": lambda: " ".join(x + "%%" * (k % 3 == 0) for k, x in enumerate(words(r, 60, 10**6))),
        "length": lambda: " ".join(x + "abcdef" for x in words(r, 60, 10**6)),
        "lines": lambda: "\n".join([*(["same line"] * 5), plain(), plain()]),
        "repeats": lambda: (lambda w: " ".join(w + w[:15]))(words(r, 110, 10**6)),
    }
    rows = [(k, plain(), "en", "clean") for k in range(60)]
    for n, make in enumerate(odd.values()):
        rows.append((100 + n, make(), "en", "clean"))
        rows += [(1000 * (n + 1) + k, make(), "en", f"like{n}") for k in range(30)]
    got = {x.doc_id: x for x in quality_rules.judge(docs(spark, rows)).collect()}
    assert not any(x.base_failed for x in got.values())
    assert {i for i, x in got.items() if not x.kept} == {100, 101, 102, 103}


def test_rules_in_any_partitioning(spark):
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(F.lit("g").alias("group"), F.lit("en").alias("lang"), F.lit(False).alias("base_failed"), *[F.round(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**9)) / (10**9 if k != 1 else 10**7), 6).alias(m) for k, m in enumerate(quality_rules.MEASURES)])
    got = {tuple(quality_rules.fences(rows.repartition(n)).first()) for n in (1, 3, 17)}
    assert len(got) == 1


# ---- chats ----


def legal(seq):
    state = -1
    for s in seq:
        if s not in chat_format.FOLLOWS[state]:
            return False
        state = s
    return state == 2 if seq else True


def brute_repair(roles):
    """Least cost by trying every sequence of choices, up to two insertions before each turn."""
    best = [10**9]

    def go(i, out, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            for tail in ((), (2,), (1, 2)):
                if legal([*out, *tail]):
                    best[0] = min(best[0], cost + 3 * len(tail))
            return
        r = roles[i]
        if out:
            c = 2 + (0 if r == out[-1] else 1 if r < 0 else 4)
            go(i + 1, out, cost + c)
        for ins in ((), (1,), (2,), (1, 2), (2, 1)):
            for q in (0, 1, 2):
                seq = [*out, *ins, q]
                state, ok = -1, True
                for s in seq:
                    ok &= s in chat_format.FOLLOWS[state]
                    state = s
                    if not ok:
                        break
                if ok:
                    go(i + 1, seq, cost + 3 * len(ins) + (0 if q == r else 1 if r < 0 else 4))

    go(0, [], 0)
    return best[0]


def test_repair():
    for n in range(1, 5):
        for roles in itertools.product((-1, 0, 1, 2), repeat=n):
            cost, plan, tail = chat_format.repair(list(roles))
            assert cost == brute_repair(roles), roles
            seq = []
            for role, inserted, action in plan:
                seq += inserted
                if action != chat_format.MERGED:
                    seq.append(role)
            assert legal([*seq, *tail])


def test_chats_of_odd_roles(spark):
    """Whole rows against the SQL, on conversations whose turns repeat roles, lack them or have unknown ones."""
    import duckdb
    import pandas as pd

    from pairwright.llm.oracles import CHATS

    r = random.Random(12)
    roles = ["user", "user", "assistant", "assistant", "system", "Human ", "bot", "tool", None, ""]
    rows = [(c if c else None, r.choice([None, t, t // 2]), r.choice(roles), r.choice(["hi", "a <|im_end|> b", "", None, "é\nü"])) for c in range(120) for t in range(r.randint(1, 7))]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, cost int").repartition(5)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.execute(CHATS).fetchall()
    got = [tuple(x) for x in chat_format.format_chats(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[4] for x in got) > 20 and sum(x[5] for x in got) > 20 and sum(x[6] for x in got) > 20


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there <|im_end|>"), (1, 2, "assistant", "yo"), (2, 0, "assistant", None), (3, 1, "gpt", "b"), (3, 0, "Human", "a"), (None, None, None, "x"), (4, 0, "system", "s"), (4, 1, "system", "t"), (5, 0, "user", "q"), (5, 0, "user", "q"), (6, 0, "", "")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, cost int").repartition(3)
    got = {x.conv_id: x for x in chat_format.format_chats(df, keep_text=True).collect()}
    assert len(got) == 7
    assert got[1].rendered == "<|im_start|>user\nhi\nthere < |im_end|><|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert got[2].n_inserted == 1 and got[2].rendered.startswith("<|im_start|>user\n<|im_end|>")
    assert got[3].cost == 0 and got[3].roles == "ua"
    assert got[None].n_relabeled == 1 and got[6].cost == brute_repair([-1])
    assert all(x.rendered_sha256 == hashlib.sha256(x.rendered.encode()).hexdigest() for x in got.values())
    assert chat_format.format_chats(df.limit(0)).count() == 0


# ---- tokens ----


def test_blocks():
    r = np.random.default_rng(1)
    wide = token_output.LANES * token_output.BLOCK_STEPS
    for n, k in ((1, 1), (5, 3), (1023, 2), (5000, 50), (300_001, 4000), (wide, 90), (wide + 1, 90), (2 * wide + 70_001, 3000)):
        ids = np.minimum(r.geometric(0.01, n), k).astype("<u4") * 7
        lengths = np.array([n])
        data = token_output.write_file(ids, [None], lengths)
        got, docs_, size = token_output.read_file(data)
        assert (got == ids).all() and docs_ == [None] and size.tolist() == [n]
        # one block alone, and from every checkpoint inside it
        f = token_output.TokenFile(data)
        assert len(f.blocks) == -(-n // wide)
        for b in range(len(f.blocks) - 1, -1, -1):
            for mark in range(len(f.blocks[b][5])):
                start, part = f.block(b, mark)
                assert start == b * wide + mark * token_output.CHECK_STEPS * token_output.LANES
                assert (part == ids[start : min(n, (b + 1) * wide)]).all()
    data = bytearray(data)
    data[-9] ^= 1
    with pytest.raises(ValueError):
        token_output.read_file(bytes(data))
    assert (token_output.TokenFile(bytes(data)).block(0)[1] == ids[:wide]).all()  # the damage is in the last block
    f = token_output.frequencies(np.array([10**9, 1, 1, 0]))
    assert f.sum() == 1 << token_output.BITS and f.min() >= 1


@pytest.mark.parametrize("plain", [False, True])
def test_tokens(spark, plain):
    from tokenizers import Tokenizer

    r = random.Random(2)
    rows = odd_rows(r) + [(500 + k, t, "en", "a") for k, t in enumerate(["a  b", " lead", "tail ", "x\n\ny z", "don't I'll", "é ñ. 漢字。", "t\tx", "nb  sp", "<|endoftext|> hi", "foo,bar. (baz)", "a \n b", "\x1c x", "hello <|endoftext|> there", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|>", "<|endoftext| >"])]
    rows.append((600, " ".join(words(r, 230_000)), "en", "a"))  # runs over a block's end
    rows += [(None, f"no id {k}", "en", "a") for k in range(50)]
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = plain  # off as the library has it
    path = fresh_path(spark, "tokens-test")
    manifest = token_output.write_tokens(docs(spark, rows), path, tokenizer_path(), plain=plain)
    got = token_output.read_tokens(manifest).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted([i for i, *_ in rows], key=lambda i: (i is not None, i or 0))
    at = 0
    want = Counter()
    for i, t, _, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    for x in got:
        assert x.start == at
        at += x.n_tokens
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == want
    blocks = sorted(map(tuple, token_output.read_blocks(manifest).collect()))
    assert len(blocks) > manifest.count() and [b[0] for b in blocks] == np.cumsum([0, *(len(b[1]) for b in blocks)])[:-1].tolist()
    ids = np.array([x for b in blocks for x in b[1]], "<u4")
    assert all(zlib.crc32(ids[x.start : x.start + x.n_tokens].tobytes()) == x.ids_crc32 for x in got)
    assert token_output.roundtrip(docs(spark, []), tokenizer_path()).count() == 0


# ---- classifier ----


def test_classifier(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {x.doc_id: x for x in quality_knn.score(d, labels).collect()}
    truth = {x.doc_id: x.quality for x in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(x.predicted == int(x.score >= 0.7) and 0 <= x.score <= 1 for x in got.values())
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.93
    # labels of held-out rows have no influence
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {x.doc_id: x.score for x in quality_knn.score(d, flipped).collect()}
    assert all(again[i] == got[i].score for i in got)
    rows = docs(spark, odd_rows(random.Random(1)))
    assert quality_knn.score(rows, labels.limit(0)).where("score = 0.5").count() == rows.count()
    assert quality_knn.accepted(rows, labels).columns == rows.columns
    assert quality_knn.score(rows.limit(0), labels).count() == 0


def brute_votes(cosines, labels, k, power):
    """Votes of the k nearest; those that tie at the last place share what is left."""
    order = sorted(range(len(cosines)), key=lambda i: -cosines[i])
    last = cosines[order[min(k, len(order)) - 1]]
    above, equal = [i for i in order if cosines[i] > last], [i for i in order if cosines[i] == last]
    share = (min(k, len(order)) - len(above)) / len(equal)
    votes = [(max(float(cosines[i]), 1e-6) ** power, labels[i]) for i in above] + [(max(float(last), 1e-6) ** power * share, labels[i]) for i in equal]
    return sum(w * y for w, y in votes) / sum(w for w, _ in votes)


def test_votes_and_terms():
    r = np.random.default_rng(8)
    vectors = r.integers(-2, 3, (60, 4)).astype(np.float32)  # many ties
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = r.integers(0, 2, len(vectors)).astype(float)
    near = vectors @ vectors.T
    for n in (len(vectors), 40, 3):
        got = quality_knn.Voter(None, None, vectors[:n], labels[:n]).votes(near[:, :n])
        assert np.allclose(got, [brute_votes(row[:n], labels[:n], quality_knn.K, quality_knn.POWER) for row in near], atol=1e-9)
    # terms against a loop over one text at a time
    texts = ["ab ab ab Abc 12", "", "a", "слово дело слово дело слово", " ".join(f"w{k % 8}" for k in range(40)), "x\ny"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    got = quality_knn.counts(raw, off)
    for t, row in zip(texts, got, strict=True):
        b, w = t.encode(), t.split()
        pairs = Counter(int(quality_knn._TERM[quality_knn._CLASS[x] * 128 + quality_knn._CLASS[y]]) for x, y in zip(b, b[1:], strict=False))
        assert {int(k): int(row[k]) for k in np.flatnonzero(row[: quality_knn.PAIRS])} == dict(pairs)
        two = list(zip(w, w[1:], strict=False))
        assert row[quality_knn.PAIRS :].tolist() == [sum(x == y for x, y in two), sum(x == y for x, y in zip(w, w[8:], strict=False)), len(two) - len(set(two)), len(w)]


def test_classifier_by_brute_force(spark):
    """Every score from the fitted vectors, one document and one cosine at a time; what the sample holds."""
    r = random.Random(50)
    rows = [(k, " ".join(words(r, r.randint(5, 60))) if k % 3 else " ".join(words(r, 3) * 15), "en", "a") for k in range(200)]
    rows += [(7, "another text of the same id", "en", "a"), (7, rows[7][1], "en", "b"), (None, "no id here", None, None), (900, None, None, None), (901, "z", None, None), (902, " ".join(words(r, 40_000)), None, None)]
    labels = [(k, int(k % 3 > 0)) for k in range(150)] + [(10**6 + k, 0) for k in range(3000)] + [(3, 1), (None, 1), (5, None)]
    df, known = docs(spark, rows), spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").repartition(3)
    fair = [k for k in range(150) if zlib.crc32(str(k).encode()) % 4 != 2]
    for sample in (4096, 40):
        voter = quality_knn.fit(df, known, sample)
        assert len(voter.labels) == min(len(fair), sample)  # labels without a document take no place
        got = quality_knn.score(df, known, sample).collect()
        assert len(got) == len(rows)
        want = Counter()
        for i, t, _, _ in rows:
            raw = np.frombuffer((t or "").encode(), np.uint8)
            x = quality_knn._weigh(quality_knn.counts(raw, np.array([0, len(raw)])), voter.idf)[0].astype(np.float64) @ voter.basis.astype(np.float64)
            norm = np.sqrt((x * x).sum())
            cosines = [round(float((x / norm * v).sum()), 6) for v in voter.vectors.astype(np.float64)] if norm > 1e-6 else []
            want[i, round(brute_votes(cosines, voter.labels, quality_knn.K, quality_knn.POWER) if cosines else float(voter.labels.mean()), 2)] += 1
        assert sum((want - Counter((x.doc_id, round(x.score, 2)) for x in got)).values()) <= 4  # at a border of rounding
        again = {(x.doc_id, x.score) for x in quality_knn.score(df.repartition(9), known.repartition(2), sample).collect()}
        assert {(x.doc_id, round(x.score, 4)) for x in got} == {(i, round(s, 4)) for i, s in again}


def test_classifier_beyond_ascii(spark):
    """Repeated phrases are poor in every script."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    voter = quality_knn.fit(d, labels)
    for phrase in ("one two three four five six ", "это очень простая фраза из слов ", "λόγος και έργο σε μία φράση "):
        raw = np.frombuffer((phrase * 30).encode(), np.uint8)
        assert voter.score(raw, np.array([0, len(raw)]))[0] < 0.3, phrase


# ---- contamination ----


def brute_align(t, q):
    h = np.zeros((len(q) + 1, len(t) + 1), int)
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == t[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    r = np.random.default_rng(3)
    pairs = [(r.integers(1, 6, r.integers(1, 40)).astype(np.uint64), r.integers(1, 6, r.integers(3, 20)).astype(np.uint64)) for _ in range(40)]
    score, end, begin = decontaminate.align([t for t, _ in pairs], [q for _, q in pairs])
    for (t, q), s, e, b in zip(pairs, score, end, begin, strict=True):
        assert s == brute_align(t, q)
        if s:
            assert brute_align(t[b : e + 1], q) == s


def test_decontamination(spark):
    r = random.Random(8)
    items = [(k, " ".join(words(r, r.randint(12, 50), 900))) for k in range(20)] + [(90, None), (91, ""), (92, "forty two"), (93, "Once"), (None, " ".join(words(r, 30, 900)))]
    items += [(0, items[1][1]), items[2]]
    rows, want = [], set()
    for k in range(120):
        w = words(r, r.randint(0, 200), 900)
        if k % 3 == 0:
            item, text = items[r.randrange(20)]
            part = text.split()
            for _ in range(len(part) // 10):
                part[r.randrange(len(part))] = "edited"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + r.choice(["", ","]) for x in part]
            want.add((k, item))
        rows.append((k, " ".join(w), "en", "a"))
    rows += [(300, None, None, None), (301, "", "en", "a"), (302, " ".join([items[3][1]] * 200), "en", "a"), (None, items[4][1], "en", "a")]
    rows.append((303, " ".join(words(r, 60_000, 10**6)) + " " + items[6][1], "en", "a"))  # at the end of a very long text
    rows += [(304, "say forty, TWO at once more", "en", "a"), (305, "forty one two", "en", "a"), (306, "forty two", "en", "a")]
    want |= {(302, 3), (None, 4), (303, 6), (304, 92), (304, 93), (306, 92)}  # short items as wholes
    want |= {(d, 0) for d, k in want if k == 1}
    df, bench = docs(spark, rows), spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, score double")
    for block in (8 << 20, 900):
        got = Counter((x.doc_id, x.item_id) for x in decontaminate.find(df, bench, block_bytes=block).collect())
        assert set(got) == want and max(got.values()) == 1
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns
    bad = {d for d, _ in want}
    assert Counter(x.doc_id for x in left.collect()) == Counter(i for i, *_ in rows if i not in bad)
    assert decontaminate.find(df, bench.limit(0)).count() == 0 and decontaminate.find(df.limit(0), bench).count() == 0


def test_decontamination_of_edited_copies(spark):
    """Every passage that reaches the least score with a shared n-gram is found, however it was edited and whatever is frequent."""
    r = random.Random(21)
    items = {k: words(r, 48, 3000) for k in range(7)}

    def replaced(w, every, first=0):
        return [f"new{r.randrange(10**6)}" if i % every == first else x for i, x in enumerate(w)]

    def among(w):
        return words(r, 40, 3000) + w + words(r, 40, 3000)

    rows, want = [], set()
    for k, w in ((0, replaced(items[0], 5, 4)), (1, replaced(items[1], 6, 5)), (2, [x for i, v in enumerate(items[2]) for x in ([v, f"in{i}"] if i % 3 == 2 else [v])])):
        rows.append((k, " ".join(among(w)), "en", "a"))
        want.add((k, k))
    # a variant with a new half, many times: its n-grams are the frequent half of the item's
    hot = items[3][:32] + [f"other{i}" for i in range(16)]
    for k in range(100, 160):
        rows.append((k, " ".join(hot), "en", "a"))
        want.add((k, 3))
    rows.append((4, " ".join(among(replaced(items[3][:32], 16, 9))), "en", "a"))  # frequent n-grams alone
    want.add((4, 3))
    # a third of an item is no copy; words between those of an item, only its start in a row
    rows.append((5, " ".join(among(items[4][:16])), "en", "a"))
    rows.append((6, " ".join(items[5][:3] + [x for i, v in enumerate(items[5][3:]) for x in (v, f"gap{i}")]), "en", "a"))
    want.add((6, 5))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    brute = set()
    for d, t, *_ in rows:
        for k, w in items.items():
            one, two = (decontaminate._text_tokens(x) for x in (t, " ".join(w)))
            if grams(t.split()) & grams(w) and decontaminate.align([one], [two])[0][0] >= 0.5 * 2 * len(w):
                brute.add((d, k))
    assert brute == want
    assert {(x.doc_id, x.item_id) for x in decontaminate.find(docs(spark, rows), bench).collect()} == want


def test_seeds_and_blocks(spark):
    """Seeds against one item at a time; blocks keep to their bytes; what goes to the tasks holds no list of entries."""
    r = random.Random(40)
    texts = [(k, " ".join(words(r, r.randint(1, 60), 60))) for k in range(50)]
    items = decontaminate.Items(texts, 3)
    df = np.array([r.choice((0, 0, 1, 2, 3, 9, 50)) for _ in items.grams], np.int64)
    entries = items.entries.tolist()
    want = set()
    for i in range(len(items.ids)):
        own = [(p, k) for j, p, k in entries if j == i and df[k] > 0]
        if own:
            middle = sorted(df[k] for _, k in own)[(len(own) - 1) // 2]
            want |= {(i, p, k, bool(df[k] <= middle)) for p, k in own}
    items.seeds(df)
    got = {(int(items.of[e]), int(items.place[e]), int(np.searchsorted(items.grams, items.lookup.grams[g])), bool(items.rare[e])) for g in range(len(items.lookup.grams)) for e in range(items.begin[g], items.begin[g + 1])}
    assert got == want and items.entries is None
    bench = spark.createDataFrame([*texts, *[(900 + k, "one and the same text of this item") for k in range(40)], texts[0]], "item_id long, text string")
    blocks = [x for block in decontaminate._blocks(bench, 1, 1500) for x in block]
    assert sorted(i for b in blocks for i in b.ids) == sorted([*(k for k, _ in texts), *range(900, 940)])
    size = dict(texts) | {900 + k: "one and the same text of this item" for k in range(40)}
    assert len(blocks) > 3 and all(sum(len(size[i]) + 64 for i in b.ids) <= 1500 for b in blocks)


def test_decontamination_bounds():
    r = random.Random(22)
    items = decontaminate.Items([(k, " ".join(words(r, 12, 30))) for k in range(4)], 3)
    items.seeds(np.ones(len(items.grams), np.int64))
    h = decontaminate._text_tokens(" ".join(words(r, 400, 45)))
    a = np.array([r.randrange(370) for _ in range(200)])
    z, item = a + np.array([r.randint(1, 30) for _ in a]), np.array([r.randrange(4) for _ in a])
    top = items.bounds(h, a, z, item)
    for i, j, k, got in zip(a, z, item, top, strict=True):
        best = run = 0
        for x in h[i:j]:
            run = max(0, run) + (2 if x in items.words[k] else -1)
            best = max(best, run)
        assert max(got, 0) == best >= decontaminate.align([h[i:j]], [items.words[k]])[0][0]
