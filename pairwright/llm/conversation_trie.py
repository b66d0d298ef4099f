"""Prefix trie of conversations by mergeable partial tries.

Conversations are rebuilt first: conversation c takes the first h turns of conversation c - c % 5
and its own turns after its first h, h = crc32(decimal c) % 9. A node is a distinct sequence of
turns (role and text). Its name is the XOR of 120-bit hashes of its (depth, turn) pairs, so names
of prefixes are running XORs, and a parent's name is the child's without its last hash.

1. Turns are numbered, and prefixes named, by scans of a range-partitioned order: each partition
   scans its rows, one row a partition carries the state over to the next. No conversation has to
   fit into a task.
2. Each partition combines its rows into a partial trie: one row a node, with members, smallest
   member and the list of members that end there.
3. Partial tries are merged by node in rounds of at most `FAN` partials, end lists in chunks of
   neighbouring ids.
4. Sums over subtrees roll up by doubling: after round r a node holds the sums of all that lies
   less than 2**r below it, so a trie of depth d takes log2(d) rounds.

Cases: rows without conv_id name no conversation and are left out; a null turn comes first; ties
of turn are ordered by the MD5 of role and text, rows that repeat are turns of their own; null role
or text is empty; c % 5 has the sign of c; a rebuilt conversation without turns ends at the root;
extra columns are ignored; an empty table gives an empty trie, without a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shuffle_parts, written

FAMILY, HEADS = 5, 9
#: Rows that a task combines at a time.
LOCAL = 1 << 19
#: Partial tries merged at a time.
FAN = 64
#: Bits of a conv_id within a chunk of an end list.
CHUNK = 16


def _lanes(*parts) -> list:
    """Two 60-bit numbers from the MD5 of columns."""
    h = F.md5(F.concat_ws(":", *parts))
    return [F.conv(F.substring(h, i, 15), 16, 10).cast("long").alias(f"t{k}") for k, i in ((1, 1), (2, 16))]


def scan(rows: DataFrame, order: list[str], lanes: list[str], tag: str) -> DataFrame:
    """rows with `at`, their number from 1 within conv_id by `order`, and `lanes` as running XORs there."""
    n = shuffle_parts(rows.sparkSession)
    columns = rows.columns
    names = [*columns, "at", "part", "head", "last"]

    def run(batches):
        part = TaskContext.get().partitionId()
        first = key = held = None
        count, state = 0, [np.int64(0)] * len(lanes)
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column("conv_id").to_numpy()
            first = k[0] if first is None else first
            index = np.arange(len(k))
            new = np.append(key is None or k[0] != key, k[1:] != k[:-1])
            open_ = np.cumsum(new) == 0  # rows that go on with the last batch's key
            start = np.maximum.accumulate(np.where(new, index, 0))
            at = index - start + 1 + np.where(open_, count, 0)
            cols = {c: b.column(c) for c in columns}
            for i, c in enumerate(lanes):
                v = cols[c].to_numpy()
                total = np.bitwise_xor.accumulate(v)
                run_ = total ^ np.where(start > 0, total[start - 1], 0) ^ np.where(open_, state[i], 0)
                cols[c], state[i] = pa.array(run_), run_[-1]
            key, count = k[-1], at[-1]
            if held is not None:
                yield held
            last = np.zeros(len(k), bool)
            held = pa.RecordBatch.from_arrays([*cols.values(), pa.array(at), pa.array(np.full(len(k), part, np.int32)), pa.array(k == first), pa.array(last)], names)
        if held is not None:
            last = np.arange(held.num_rows) == held.num_rows - 1
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(last)], names)

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", at long, part int, head boolean, last boolean"
    sort = ["conv_id", *order]
    local = written(rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort).mapInArrow(lean(run), schema), tag)
    ends = sorted(local.where("last").select("part", "conv_id", "at", "head", *lanes).collect())  # a row a partition
    carry, before = [], None
    for e in ends:
        state = [e.conv_id, e.at, *[e[c] for c in lanes]]
        if before is not None:
            carry.append((e.part, *before))
            if e.head and e.conv_id == before[0]:
                state = [e.conv_id, e.at + before[1], *[e[c] ^ x for c, x in zip(lanes, before[2:], strict=True)]]
        before = state
    over = rows.sparkSession.createDataFrame(carry, "part int, conv_id long, _at long" + "".join(f", _{c} long" for c in lanes))
    out = local.join(F.broadcast(over), ["part", "conv_id"], "left")
    zero = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
    return out.select(*[F.col(c).bitwiseXOR(zero(c)).alias(c) if c in lanes else F.col(c) for c in columns], (F.col("at") + zero("at")).alias("at"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, size, bytes, t1, t2), and (conv_id, size) of each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(conv.isNotNull()).select(conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), *_lanes(F.octet_length(role).cast("string"), role, text), F.octet_length(text).cast("long").alias("bytes"))
    turns = scan(written(turns, "trie-turns"), ["turn", "t1", "t2"], [], "trie-numbered").drop("turn")
    own = written(turns.groupBy("conv_id").agg(F.max("at").alias("n")), "trie-lengths")
    heads = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % HEADS
    plan = own.select("conv_id", "n", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("donor"))
    plan = plan.join(own.select(F.col("conv_id").alias("donor"), F.col("n").alias("given")), "donor", "left")
    plan = plan.withColumn("keep", F.least("h", F.coalesce("given", F.lit(0))))
    plan = written(plan.withColumn("size", F.col("keep") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "trie-plan")
    first = turns.where(F.col("at") < HEADS).withColumnRenamed("conv_id", "donor").join(plan, "donor").where("at <= keep")
    rest = turns.join(plan.select("conv_id", "h", "keep", "size"), "conv_id").where("at > h")
    cols = ["conv_id", "size", "bytes", "t1", "t2"]
    both = first.select(*cols, F.col("at").alias("depth")).unionByName(rest.select(*cols, (F.col("at") - F.col("h") + F.col("keep")).alias("depth")))
    return both, plan.select("conv_id", "size")


def partial_tries(rows: DataFrame) -> DataFrame:
    """One row for each node of a partition's rows: k1, k2, p1, p2, depth, bytes, n, lead, ends, part."""
    names = ["k1", "k2", "p1", "p2", "depth", "bytes", "n", "lead", "ends", "part"]

    def combined(batches):
        t = pa.Table.from_batches(batches)
        c = {x: t.column(x).to_numpy() for x in t.column_names}
        order = np.lexsort((c["conv_id"], c["k2"], c["k1"]))
        c = {x: v[order] for x, v in c.items()}
        top = np.flatnonzero(np.append(True, (c["k1"][1:] != c["k1"][:-1]) | (c["k2"][1:] != c["k2"][:-1])))
        ended = np.append(0, np.cumsum(c["depth"] == c["size"]))
        offsets = ended[np.append(top, len(order))].astype(np.int32)
        ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(c["conv_id"][c["depth"] == c["size"]]))
        first = {x: pa.array(c[x][top]) for x in ("k1", "k2", "p1", "p2", "depth", "bytes", "conv_id")}
        n, part = np.diff(np.append(top, len(order))), np.full(len(top), TaskContext.get().partitionId())
        return pa.RecordBatch.from_arrays([*[first[x] for x in ("k1", "k2", "p1", "p2", "depth", "bytes")], pa.array(n), first["conv_id"], ends, pa.array(part)], names)

    def run(batches):
        pend, held = [], 0
        for b in batches:
            pend, held = [*pend, b], held + b.num_rows
            if held >= LOCAL:
                yield combined(pend)
                pend, held = [], 0
        if held:
            yield combined(pend)

    return rows.select("conv_id", "depth", "size", "bytes", "k1", "k2", "p1", "p2").mapInArrow(lean(run), "k1 long, k2 long, p1 long, p2 long, depth long, bytes long, n long, lead long, ends array<long>, part long")


def merged(df: DataFrame, key: list[str], aggs: list) -> DataFrame:
    """df's partials merged by key, at most FAN of them at a time."""
    parts = (df.agg(F.max("part").alias("m")).first().m or 0) + 1
    while parts > FAN:
        parts = -(-parts // FAN)
        df = df.withColumn("part", F.col("part") % parts).groupBy(*key, "part").agg(*aggs)
    return df.groupBy(*key).agg(*aggs)


def end_digests(lists: DataFrame) -> DataFrame:
    """SHA-256 of each node's ends in order; lists: k1, k2, chunk, ids. Only a chunk is held."""
    n = shuffle_parts(lists.sparkSession)

    def run(batches):
        key, digest = None, None
        for b in batches:
            out = []
            for k1, k2, ids in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("ids"), strict=True):
                text = ",".join(map(str, ids.as_py())).encode()
                if key == (k1, k2):
                    digest.update(b"," + text)
                    continue
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["k1", "k2", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], ["k1", "k2", "ends_sha256"])

    dealt = lists.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "chunk").select("k1", "k2", "ids")
    return dealt.mapInArrow(lean(run), "k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(k1, k2, sums): each node's sums over its subtree. nodes: k1, k2, p1, p2, depth and sums."""
    deepest = nodes.agg(F.max("depth").alias("d")).first().d or 0
    now = nodes.select("k1", "k2", F.col("p1").alias("j1"), F.col("p2").alias("j2"), "depth", *sums)
    for r in range(int(deepest).bit_length()):
        # j is the ancestor 2**r above, where there is one
        add = now.where(F.col("depth") >= 1 << r).groupBy(F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        grown = now.join(add, ["k1", "k2"], "left").select("k1", "k2", "j1", "j2", "depth", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums])
        if deepest >= 2 << r:
            far = F.col("depth") >= 2 << r
            above = now.where(F.col("depth") >= 1 << r).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j1").alias("n1"), F.col("j2").alias("n2"))
            jumped = grown.where(far).join(above, ["j1", "j2"]).select("k1", "k2", F.col("n1").alias("j1"), F.col("n2").alias("j2"), "depth", *sums)
            grown = jumped.unionByName(grown.where(~far))
        now = written(grown, "trie-rollup")
    return now.select("k1", "k2", *sums)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    turns, convs = rebuilt(conversations)
    lane = _lanes(F.col("depth").cast("string"), F.col("t1").cast("string"), F.col("t2").cast("string"))
    turns = turns.select("conv_id", "depth", "size", "bytes", *lane, lane[0].alias("k1"), lane[1].alias("k2"))
    named = scan(written(turns, "trie-rebuilt"), ["depth"], ["k1", "k2"], "trie-prefixes")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), "size", *[zero.alias(c) for c in ("bytes", "k1", "k2", "p1", "p2")])
    named = named.select("conv_id", "depth", "size", "bytes", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i in (1, 2)])
    partials = written(partial_tries(named.unionByName(root)), "trie-partials")

    key = ["k1", "k2"]
    nodes = merged(partials.drop("ends"), key, [F.sum("n").alias("n"), *[F.min(c).alias(c) for c in ("p1", "p2", "depth", "bytes", "lead")]])
    nodes = written(nodes, "trie-nodes")
    ids = partials.select(*key, F.col("part"), F.explode("ends").alias("id")).withColumn("chunk", F.shiftright("id", CHUNK))
    lists = ids.groupBy(*key, "chunk", "part").agg(F.collect_list("id").alias("ids"))
    lists = merged(lists, [*key, "chunk"], [F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids")])
    digests = written(end_digests(lists), "trie-ends")

    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = written(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n") - 1) * F.col("bytes")}), "trie-counted")
    sums = rolled_up(nodes, ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("lead").alias("parent_conv_id"))
    below = nodes.where("depth > 0").join(above, ["p1", "p2"]).unionByName(nodes.where("depth = 0"), allowMissingColumns=True)
    out = below.drop("n_leaves", "saved_tokens").join(sums, key).join(digests, key, "left")
    return out.select(F.col("lead").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
