"""MinHash near-dedup with ProbMinHash signatures.

Documents are weighted sets of shingles of five words (weight: how often the shingle occurs).
Each shingle starts a Poisson process of its weight; the first arrival in each of `SLOTS`
signature slots estimates the probability Jaccard similarity, and a process stops as soon as
its next arrival is later than every slot's. Bands of `ROWS` slots give candidates, and every
link is verified on the shingles themselves (exact probability Jaccard, `LEAST` or more).

Equal texts are one node. A bucket is not expanded into its pairs: its members are compared
with a leader, so a group of n copies of one text costs about n comparisons. Where that leaves
members of a bucket in different classes, all pairs of unlike classes are compared in salted
blocks of bounded size: common shingles are counted by products of matrices, and a block gives
only the links that join classes. In large buckets blocks whose distances (1 - similarity) to
the leader exclude a link by the triangle inequality are left out. Every pair that shares a
bucket is so verified or excluded by proof; nothing is dropped for a bucket's size.

Cases: texts that are equal as a whole are one class, empty ones (null counts as empty) too; a
text of one to four words is one shingle; a similarity of just `LEAST` links; a very long text
is shingled whole, and is a block of its own if it is beyond a block's bytes; a null id is
carried as null, and a class of null ids alone has a null class id; rows that repeat are copies;
an empty table gives an empty result; extra columns are ignored, and kept by `representatives`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, attached, keyed, lean, mix64, packed, shuffle_parts, text_bytes, unpack, word_hashes, word_spans, written
from .segments import _groups, _kgrams

WORDS = 5
LEAST = 0.8
SLOTS = 128
ROWS = 4
SEED = 23
#: A similarity this close below the least counts as equal to it, however its terms were summed.
TIE = 1e-9
#: Texts compared with one copy of their leader's text.
STAR = 256
#: Rows, and bytes of compressed text, of one side of a block of remaining pairs.
BLOCK = 1024
BLOCK_BYTES = 2 << 20


def shingles(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle."""
    start, end, first = word_spans(raw, off)
    h = word_hashes(raw, start, end)
    n = np.diff(first)
    if not len(h):
        return np.zeros(0, np.int64), h
    text = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(np.arange(len(h)) + words <= first[1:][text])
    out = _kgrams(h, words)[at]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        extra = []
        for t in short:
            x = np.uint64(n[t])
            for w in h[first[t] : first[t + 1]]:
                x = mix64(np.array([x * np.uint64(31) + w]))[0]
            extra.append(x)
        return np.concatenate([text[at], short]), np.concatenate([out, np.array(extra, np.uint64)])
    return text[at], out


def weighted(text: np.ndarray, h: np.ndarray, bits: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of every distinct shingle of a text."""
    key = np.sort((text.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(head, len(key)))
    key = key[head]
    return (key >> np.uint64(64 - bits)).astype(np.int64), key << np.uint64(bits), weight


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """(n, slots) hashes of the shingles that arrive first; a text without shingles has zeros."""
    best = np.full(n * slots, np.inf)
    who = np.zeros(n * slots, np.uint64)
    late = np.full(n, np.inf)
    time, step = np.zeros(len(h)), np.uint64(SEED)
    rate = 1.0 / weight
    while len(h):
        step = step + np.uint64(0x9E3779B97F4A7C15)
        r = mix64(h + step)
        time = time - np.log(((r >> np.uint64(11)) + np.float64(0.5)) * 2.0**-53) * rate
        on = time < late[text]
        text, h, time, rate, r = text[on], h[on], time[on], rate[on], r[on]
        if not len(h):
            break
        at = text * slots + (mix64(r) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(best, at, time)
        won = time == best[at]
        who[at[won]] = h[won]
        some = text[np.append(True, text[1:] != text[:-1])]
        late[some] = best.reshape(n, slots)[some].max(1)
        on = time < late[text]
        text, h, time, rate = text[on], h[on], time[on], rate[on]
    return who.reshape(n, slots)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, slots = sig.shape
    part = sig.reshape(n, slots // rows, rows)
    out = np.arange(slots // rows, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        out = mix64(out * np.uint64(31) + part[:, :, i])
    return out


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard: sum over common d of 1 / sum over e of max(a_e/a_d, b_e/b_d)."""
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    ratio = a / b
    by = np.argsort(ratio, kind="stable")
    r, sa, sb = ratio[by], np.append(0, np.cumsum(a[by])), np.append(0, np.cumsum(b[by]))
    k = np.searchsorted(r, ratio, "right")  # e up to k have a_e/b_e <= a_d/b_d
    return float((1 / ((sa[-1] - sa[k] + only_a) / a + (sb[k] + only_b) / b)).sum())


def _signed(rows: DataFrame) -> DataFrame:
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                raw, off = text_bytes(batch.column("text"))
                for i, j in _groups(off, STEP):
                    t, h, w = weighted(*shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
                    n = j - i
                    sig = signatures(t, h, w, n)
                    b = bands(sig)
                    some = np.zeros(n, bool)
                    some[t] = True
                    flat = b[some].ravel().view(np.int64)
                    size = np.where(some, b.shape[1], 0)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))
                    part = batch.slice(i, n)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("did", "rid", "id", "body")), lists], ["did", "rid", "id", "body", "bands"])

    return rows.withColumn("body", F.md5("text")).mapInArrow(lean(run), "did long, rid long, id long, body string, bands array<long>")


def _bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and weight of the distinct shingles of every text, sorted by hash, and where each text's begin (len+1)."""
    off, bits = np.append(0, np.cumsum([len(x) for x in texts])), max(12, len(texts).bit_length())
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n, parts = np.zeros(len(texts), np.int64), []
    for i, j in _groups(off, STEP):
        with np.errstate(over="ignore"):
            t, h, w = weighted(*shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i]), bits)
        n[i:j] = np.bincount(t, minlength=j - i)
        parts.append((h, w))
    h, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, w, np.append(0, np.cumsum(n))


def _flat(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether all shingles of a text weigh the same: then probability Jaccard is Jaccard."""
    out = np.ones(len(first) - 1, bool)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.minimum.reduceat(w, first[some]) == np.maximum.reduceat(w, first[some])
    return out


def _verify(pairs: DataFrame, texts: DataFrame, star: int = STAR) -> DataFrame:
    """(a, b, s) of pairs (a, b), b a leader: each text is sent once for each of its pairs, a leader's
    once for every `star` of them."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / star).cast("int").alias("parts"))
    spokes = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")).join(texts.select(F.col("node").alias("a"), "z"), "a")
    hubs = parts.join(texts.select(F.col("node").alias("b"), "z"), "b").select(F.lit(None).cast("long").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "z")
    dealt = spokes.select("a", "b", "part", "z").unionByName(hubs).repartition(shuffle_parts(pairs.sparkSession), "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches):
        hub, hub_w, hub_flat = None, None, False
        for batch in batches:
            a, b, z = (batch.column(c).to_pylist() for c in ("a", "b", "z"))
            for lo in range(0, len(a), 512):
                hi = min(len(a), lo + 512)
                h, w, first = _bags([unpack(x) for x in z[lo:hi]])
                flat = _flat(w, first)
                s, i = np.zeros(hi - lo), 0
                while i < hi - lo:
                    if a[lo + i] is None:
                        hub, hub_w, hub_flat = h[first[i] : first[i + 1]].copy(), w[first[i] : first[i + 1]].copy(), flat[i]
                        i += 1
                        continue
                    j = i + 1
                    while j < hi - lo and a[lo + j] is not None:
                        j += 1
                    own = h[first[i] : first[j]]
                    if len(hub):
                        at = np.searchsorted(hub, own)
                        at[at == len(hub)] = 0
                        both = np.append(0, np.cumsum(hub[at] == own))[first[i : j + 1] - first[i]]
                        both, n = np.diff(both), np.diff(first[i : j + 1])
                        s[i:j] = both / (n + len(hub) - both)
                        for k in np.flatnonzero((both > 0) & ~(flat[i:j] & hub_flat)) + i:
                            s[k] = similarity(h[first[k] : first[k + 1]], w[first[k] : first[k + 1]], hub, hub_w)
                    i = j
                keep = [k for k in range(lo, hi) if a[k] is not None]
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64()), pa.array(s[np.array(keep, np.int64) - lo], pa.float64())], ["a", "b", "s"])

    return dealt.mapInArrow(lean(run), "a long, b long, s double")


class _Union:
    """Classes of a few members, joined as links are found."""

    def __init__(self, label: np.ndarray):
        _, self.of = np.unique(label, return_inverse=True)

    def join(self, x: int, y: int) -> bool:
        p, q = self.of[x], self.of[y]
        if p == q:
            return False
        self.of[self.of == max(p, q)] = min(p, q)
        return True


def block_links(texts: list[bytes], label: np.ndarray, side: np.ndarray, within: bool, least: float = LEAST, rows: int = 256, entries: int = 1 << 15) -> list[tuple[int, int]]:
    """Links that join classes among the texts of a block, as pairs of places.

    Pairs of unlike side are compared, and pairs of one side if `within`. What two texts have in common is found for
    whole tiles by products of matrices: the probability of each in the other's shingles, which bounds the similarity, and is
    exact where all shingles weigh the same. Pairs that reach the bound are verified; pairs of one class need no look.
    """
    by = np.lexsort((label, side))
    h, w, first = _bags([texts[i] for i in by])
    label, side = label[by], side[by]
    flat, n = _flat(w, first), np.diff(first)
    total = np.add.reduceat(np.append(w, 0), first[:-1]) * (n > 0)
    mass = (w / np.repeat(np.maximum(total, 1), n)).astype(np.float32)
    cut = [0]
    while cut[-1] < len(n):
        cut.append(max(cut[-1] + 1, min(cut[-1] + rows, int(np.searchsorted(first, first[cut[-1]] + entries, "right")) - 1)))
    tiles = [(a, z, np.unique(h[first[a] : first[z]])) for a, z in zip(cut[:-1], cut[1:], strict=True)]
    union, out = _Union(label), []

    def matrix(a, z, cols):
        at = slice(first[a], first[z])
        c = np.searchsorted(cols, h[at])
        c[c == len(cols)] = 0
        on = cols[c] == h[at]
        p = np.zeros((z - a, len(cols)), np.float32)
        p[np.repeat(np.arange(z - a), n[a:z])[on], c[on]] = mass[at][on]
        return p, (p > 0).astype(np.float32)

    for i, (a, z, own) in enumerate(tiles):
        for b, y, other in tiles[i:]:
            if not within and side[a] == side[y - 1]:
                continue
            one, two = union.of[a:z], union.of[b:y]
            if one[0] == two[0] and (one == one[0]).all() and (two == one[0]).all():
                continue
            cols = np.intersect1d(own, other, assume_unique=True)
            if not len(cols):
                continue
            p, on = matrix(a, z, cols)
            q, on2 = (p, on) if a == b else matrix(b, y, cols)
            both = (on @ on2.T).astype(np.float64)
            plain = flat[a:z, None] & flat[None, b:y]
            near = both >= (least - TIE) * np.maximum(n[a:z, None] + n[None, b:y] - both, 1)
            if not plain.all():
                near = np.where(plain, near, np.minimum(p @ on2.T, on @ q.T) >= least - 1e-3)
            near &= one[:, None] != two[None, :]
            if not within:
                near &= side[a:z, None] != side[None, b:y]
            if a == b:
                near &= np.arange(z - a)[:, None] < np.arange(y - b)[None, :]
            for r, c in zip(*np.nonzero(near), strict=True):
                x, v = a + int(r), b + int(c)
                if union.of[x] == union.of[v]:
                    continue
                if plain[r, c] or similarity(h[first[x] : first[x + 1]], w[first[x] : first[x + 1]], h[first[v] : first[v + 1]], w[first[v] : first[v + 1]]) >= least - TIE:
                    union.join(x, v)
                    out.append((int(by[x]), int(by[v])))
    return out


def _rest(members: DataFrame, labels: DataFrame, sims: DataFrame, texts: DataFrame, least: float, block: int, block_bytes: int) -> DataFrame:
    """(a, b): links between the classes that the leaders left in one bucket, over all of its pairs.

    A bucket's largest class is its main one; in buckets beyond a block other members are compared with each other and
    with the main class. Buckets of more than `block` members are cut into cells by their distance to the leader, of which only like ones
    can hold a link (triangle inequality), and cells by hashes into parts; every pair of parts is a block of its own, so
    no bucket gathers in one task.
    """
    slack = 1 - least + 1e-6
    now = members.where("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    mixed = counts.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    # the leader has been compared with every member
    now = attached(now, "key", mixed).where("node != leader").select("key", "node", "leader", "label", (F.col("label") != F.col("main")).cast("int").alias("other"), "n")
    now = now.join(sims.select(F.col("a").alias("node"), F.col("b").alias("leader"), "s"), ["node", "leader"])
    now = now.withColumn("cell", F.when(F.col("n") > block, F.floor((1 - F.col("s")) / slack)).otherwise(0).cast("int")).join(texts.select("node", "size"), "node")
    now = written(now.select("key", "node", "label", "other", "cell", "size"), "near-open")
    # a bucket that fits a block is compared whole, in one block
    fits = now.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("mb")).select("key", ((F.col("m") <= block) & (F.col("mb") <= block_bytes)).alias("fits"))
    now = attached(now, "key", fits).select("key", "node", "label", F.when(F.col("fits"), 1).otherwise(F.col("other")).alias("other"), F.when(F.col("fits"), 0).otherwise(F.col("cell")).alias("cell"), "size")
    parts = now.groupBy("key", "other", "cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / block_bytes)).cast("int").alias("parts"))
    # all pairs of groups (other, cell) of a bucket that can hold a link, and of their parts
    own = written(parts, "near-parts")
    left, right = own.select("key", F.col("other").alias("o1"), F.col("cell").alias("c1"), F.col("parts").alias("p1")), own.select("key", F.col("other").alias("o2"), F.col("cell").alias("c2"), F.col("parts").alias("p2"))
    met = left.join(right, "key").where((F.abs(F.col("c1") - F.col("c2")) <= 1) & (F.col("o2") == 1) & ((F.col("o1") == 0) | (F.col("c1") <= F.col("c2"))))
    meets = F.struct("o1", "c1", "p1", "o2", "c2", "p2")
    met = met.select("key", F.col("o1").alias("other"), F.col("c1").alias("cell"), F.lit(0).alias("side"), meets.alias("m")).unionByName(met.where("o1 != o2 or c1 != c2").select("key", F.col("o2").alias("other"), F.col("c2").alias("cell"), F.lit(1).alias("side"), meets.alias("m")))
    met = met.groupBy("key", "other", "cell").agg(F.collect_list(F.struct("side", "m")).alias("meets"))
    same = (F.col("m.o1") == F.col("m.o2")) & (F.col("m.c1") == F.col("m.c2"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("m.p1")).otherwise(F.col("m.p2"))).cast("int")
    rows = now.join(met, ["key", "other", "cell"]).select("key", "node", "label", F.explode("meets").alias("x")).select("key", "node", "label", "x.side", "x.m")
    rows = rows.withColumn("same", same).withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("m.p2")).otherwise(F.col("m.p1")) - 1)))
    i = F.when(F.col("same"), F.least("mine", "with")).when(F.col("side") == 0, F.col("mine")).otherwise(F.col("with"))
    j = F.when(F.col("same"), F.greatest("mine", "with")).when(F.col("side") == 0, F.col("with")).otherwise(F.col("mine"))
    half = F.when(F.col("same"), (F.col("mine") == F.greatest("mine", "with")) & (F.col("mine") != F.col("with"))).otherwise(F.col("side") == 1).cast("int")
    within = F.col("same") & (i == j)
    place = F.xxhash64("key", "m.o1", "m.c1", "m.o2", "m.c2", i, j)
    rows = rows.select("key", "node", "label", place.alias("place"), half.alias("side"), within.alias("within"))
    dealt = rows.join(texts.select("node", "z"), "node").repartition(shuffle_parts(members.sparkSession), "key", "place").sortWithinPartitions("key", "place")

    def run(batches):
        def flush(held):
            nodes, label, side = (np.array([x[k] for x in held], np.int64) for k in (1, 2, 4))
            got = block_links([unpack(x[6]) for x in held], label, side, held[0][5], least) if len(held) > 1 and (label != label[0]).any() else []
            return [(int(nodes[x]), int(nodes[y])) for x, y in got]

        held, out = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "label", "place", "side", "within", "z")), strict=True):
                if held and (held[0][0] != row[0] or held[0][3] != row[3]):
                    out += flush(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        out = flush(held) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of edges (a, b).

    Labels move to neighbours and then along labels, so long chains shrink quickly; each round is
    a written table.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), f"{tag}-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        nxt = labels.join(near, labels.node == near.n, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("m"), F.col("label").alias("far"))
        nxt = written(nxt.join(jump, F.col("label") == F.col("m"), "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), f"{tag}-labels")
        labels = nxt.select("node", "label")
        if not nxt.where("old != label").limit(1).count():
            return labels


def classes(docs: DataFrame, least: float = LEAST, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(did, rid, id, label) for every row of docs: equal labels are one class."""
    rows = keyed(docs)
    signed = written(_signed(rows), "near-signed")
    nodes = signed.groupBy("body").agg(F.min(F.struct("did", "rid")).alias("one"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(attached(buckets, "key", leaders), "near-members")

    pairs = written(members.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "near-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    places = nodes.join(wanted, "node").select("node", "one.did", "one.rid")
    texts = packed(rows).select("did", "rid", "z").join(places, ["did", "rid"]).groupBy("node").agg(F.first("z").alias("z"))
    texts = written(texts.withColumn("size", F.octet_length("z").cast("long")), "near-texts")
    sims = written(_verify(pairs, texts), "near-links")
    labels = components(sims.where(F.col("s") >= least - TIE))
    more = written(_rest(members, labels, sims, texts, least, block, block_bytes), "near-links")
    if more.limit(1).count():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    named = nodes.select("body", "node").join(labels, "node", "left").select("body", F.coalesce("label", "node").alias("label"))
    return signed.select("did", "rid", "id", "body").join(named, "body").drop("body")


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id, class_size): class_id is the smallest doc_id of the class."""
    rows = written(classes(docs, least), "near-classes")
    # written, so that the join's two sides are shuffles of their own and a large class can be split
    names = written(rows.groupBy("label").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "near-names")
    return rows.join(names, "label").select(F.col("id").alias("doc_id"), "class_id", "class_size")


def representatives(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of docs for each class, that of the smallest id; the columns of docs."""
    rows = classes(docs, least)
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "rid", "did")).alias("x")).select("x.did", "x.rid")
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("did"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("rid"))
    # rows that repeat share their key: the first of them stays
    got = own.join(best, ["did", "rid"]).groupBy("did", "rid").agg(F.first("_row").alias("_row"))
    return got.select("_row.*")
