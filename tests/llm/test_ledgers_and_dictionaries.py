"""Prefix tries, spelling variants and secret scans against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pairwright.llm import conversation_trie, secret_scan, spelling_variants
from pairwright.llm.common import fresh_path

# ---- tries ----

TURNS = "conv_id long, turn long, role string, text string, part int, depth string, k1 string, n string, lead int"


def brute_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r.encode())}:{r}:{x}".encode()).hexdigest(), r, x))
    conv = {c: [v[2:] for v in sorted(vs)] for c, vs in conv.items()}
    new = {}
    for c, vs in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = conv.get(c - int(math.fmod(c, 5)), [])[:h] + vs[h:]
    members = defaultdict(list)
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members[tuple(new[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    digest = lambda p, m: hashlib.sha256(",".join(str(c) for c in m if len(new[c]) == len(p)).encode()).hexdigest()
    return sorted([(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], digest(p, m)) for p, m in members.items()], key=str)


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", None, 2) for r in rows], TURNS).repartition(5)


def trie_rows(spark, rows):
    df = conversation_trie.trie(turns(spark, rows))
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie_brute(spark):
    r = random.Random(4)
    say = [("user", "hi"), ("user", "hé"), ("assistant", "ok"), ("assistant", ""), (None, None), ("", ""), ("us", "er:hi"), ("user:", "hi")]
    rows = [(c, t, *r.choice(say)) for c in [*range(-12, 60), 1000, 1002, 1004, 70001, 70004, 140003] for t in range(r.randint(1, 12))]
    rows += [(c, t, *say[c % 2]) for c in range(200, 260) for t in range(8)]  # many that agree
    rows += [(None, 0, "user", "no conversation"), (3, None, "user", "first"), (3, None, None, "first"), (4, 2, "user", "tie"), (4, 2, "user", "tie"), (4, 2, "user", "tie a")]
    rows += rows[:20]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_long_conversation(spark):
    rows = [(7, t, "user", f"{t % 13}") for t in range(900)] + [(c, t, "user", f"{t % 13}") for c in (5, 6, 8, 12) for t in range(40)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "FAN", 2)
    monkeypatch.setattr(conversation_trie, "CHUNK", 2)
    rows = [(c, t, "user", "same") for c in range(100) for t in range(3)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_empty(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []


# ---- spelling ----


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_variants(rows):
    n = brute_words(rows)
    some = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in some.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(some[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def variant_rows(spark, rows, hot):
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, n int, word string, lo double").repartition(3)
    return sorted(tuple(r) for r in spelling_variants.variants(df, hot).collect())


def test_variants_brute(spark):
    r = random.Random(9)
    letters = "abé"
    words = ["".join(r.choice(letters) for _ in range(r.choice([4, 5, 5, 6, 6, 7, 9]))) for _ in range(500)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaaaab", "aabaa", "z" * 3000, "z" * 3001, "z" * 1500 + "y" + "z" * 1500, "Straße", "STRASSE", "strasse", "×÷×÷×", "ÀÉÎõü"]
    rows = [(i, " ".join(f"{r.choice(words).upper() if r.random() < 0.2 else r.choice(words)}{r.choice([',', ' ', '1', '-'])}" for _ in range(r.randint(0, 160)))) for i in range(70)]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (100, None), (101, ""), (102, "1 2 3")] + [(200 + i, " ".join(words[-14:])) for i in range(7)]
    want = brute_variants(rows)
    assert len(want) > 100 and sum(w[3] is not None for w in want) > 10
    for hot in (3, 128):
        assert variant_rows(spark, rows, hot) == want


def test_variants_empty(spark):
    assert variant_rows(spark, [], 128) == [] and variant_rows(spark, [(1, None), (2, "one two")], 128) == []


# ---- secrets ----

KINDS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, bool),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, bool),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, bool),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, bool),
}


def brute_secrets(i, text):
    found = [(m.start(), k, m.end(), name) for k, (name, (p, flags, ok)) in enumerate(KINDS.items()) for m in re.finditer(p, text or "", flags) if ok(m)]
    join = lambda spans: ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans))
    count = Counter(k for _, k, _, _ in found)
    return (i, count[0], count[1], count[2], hashlib.sha256(join([s for s in found if s[1] < 3]).encode()).hexdigest(), join(found))


def secret_docs(r):
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    caps = lambda n: "".join(r.choice("ABCDEFXYZ0189") for _ in range(n))
    bits = ["token", "Secret", "pass", "PASSWD", "password", "api_key", "APIKEY", "api key", "=", ":", " ", "  ", '"', "'", "short", "longenough_value", "a=b", "==", "é", "ſecret", "\n", "AKIA", "akia", "."]
    bits += [hexes(31), hexes(32), hexes(50).upper(), hexes(64), "AKIA" + caps(11), "AKIA" + caps(12), "AKIA" + caps(30), "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + caps(36), "xoxb-" + caps(12), f"eyJ{caps(9)}.{caps(9)}.{caps(9)}", "token: secret: longvalue123"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (None, rows[5][1]), (5, rows[5][1]), (202, "x " * 70000 + "token=abcdefgh12")] + [(300 + i, "password = hunter2hunter2") for i in range(60)]


def secret_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, part int, digest string, kind string").repartition(6)


def test_secrets_brute(spark):
    rows = secret_docs(random.Random(2))
    df = secret_scan.scan(secret_frame(spark, rows), fresh_path(spark, "ledger"))
    want = sorted([brute_secrets(*r) for r in rows], key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want
    assert df.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert secret_scan.scan(secret_frame(spark, []), fresh_path(spark, "ledger")).collect() == []


def scanned(spark, path):
    return Counter((r.kind, r.version) for r in secret_scan.read_ledger(spark, path).collect())


def test_secrets_ledger(spark):
    """Only blobs and rule versions that are new are scanned; results cover all versions."""
    rows = secret_docs(random.Random(3))
    path, first, later = fresh_path(spark, "ledger"), rows[:100], rows[50:]
    blobs = lambda x: len({t or "" for _, t in x})
    base = secret_scan.BASE
    secret_scan.scan(secret_frame(spark, first), path, base).collect()
    assert scanned(spark, path) == {(r.kind, 1): blobs(first) for r in base}
    got = secret_scan.scan(secret_frame(spark, later), path)  # all rules: of the base ones only new blobs
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([brute_secrets(*r) for r in later], key=str)
    after = scanned(spark, path)
    assert after == {(r.kind, 1): blobs(rows) if r in base else blobs(later) for r in secret_scan.RULES}
    secret_scan.scan(secret_frame(spark, later), path).collect()
    assert scanned(spark, path) == after
    newer = tuple(r._replace(version=2, least=40) if r.kind == "hex" else r for r in secret_scan.RULES)
    got = secret_scan.scan(secret_frame(spark, later), path, newer)
    assert scanned(spark, path) == after + Counter({("hex", 2): blobs(later)})
    spans = {r.doc_id: r.spans for r in got.collect()}
    for i, t in later:
        want = [s for s in brute_secrets(i, t)[5].split(",") if s and not (s.startswith("hex") and int(s.split(":")[2]) - int(s.split(":")[1]) < 40)]
        assert spans[i] == ",".join(want)
