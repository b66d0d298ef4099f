"""Graph records as rows of arrays: canonical graphs, audits of them, features for message passing.

records(code_id, language, code, types, labels, ids, edges, ddg_ids, ddg_edges): node arrays of the syntax layer in their
order, edges as structs of positions (src, dst); the dependence layer has node ids and edges of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as X
from .graphs import let, overlay, turned

# Canonical categories; the place in this order is the id. Coarse groups of categories.
CATEGORIES = (
    "Control_If", "Control_Loop", "Control_Switch", "Control_Return", "Control_Break", "Var_Decl", "Func_Decl", "Class_Decl", "Param_Decl", "Assign_Op", "Binary_Op",
    "Unary_Op", "Call_Expr", "Access_Expr", "Literal_Num", "Literal_Str", "Literal_Bool", "Literal_Null", "Structural_Block", "Identifier_Context", "Literal_Generic",
    "Control_Generic", "Type_Meta", "Canonical_Unknown",
)
COARSE = {
    "Control": ("Control_If", "Control_Loop", "Control_Switch", "Control_Return", "Control_Break", "Control_Generic"),
    "Declaration": ("Var_Decl", "Func_Decl", "Class_Decl", "Param_Decl"), "Operator": ("Assign_Op", "Binary_Op", "Unary_Op"),
    "Call/Access": ("Call_Expr", "Access_Expr", "Identifier_Context"), "Literal": ("Literal_Num", "Literal_Str", "Literal_Bool", "Literal_Null", "Literal_Generic"),
    "Structure/Meta": ("Structural_Block", "Type_Meta"), "Unknown": ("Canonical_Unknown",),
}


def with_categories(records: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """records with `categories`: every distinct type is judged once, then looked up."""
    kinds = records.select("language", F.explode(F.array_distinct("types")).alias("t")).distinct()
    kinds = kinds.withColumn("c", X.canonical_type(F.col("t"), F.col("language"), aliases))
    table = kinds.groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("t", "c"))).alias("_names"))
    # a few types and languages; a join by language would put all records of one into a task
    table = table.withColumnRenamed("language", "_language")
    j = records.join(F.broadcast(table), records["language"].eqNullSafe(table["_language"]), "left")
    return j.withColumn("categories", F.transform("types", lambda t: F.try_element_at("_names", t))).drop("_names", "_language")


def with_places(records: DataFrame, cap: int) -> DataFrame:
    """records with `places`: where each dependence node stands among the first `cap` nodes of the syntax layer, else -1."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def find(values: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for own, known in zip(values, ids, strict=True):
            at = {} if known is None else {x: i for i, x in reversed(list(enumerate(known))) if x is not None}
            out.append(None if own is None else [at.get(x, -1) for x in own])
        return pd.Series(out, dtype=object)

    # not marked so, the call could be moved into lambdas that read its result
    return records.withColumn("places", find.asNondeterministic()("ddg_ids", F.slice("ids", 1, cap)))


def projected(edges: Column, places: Column) -> Column:
    """Dependence edges by the `places` of their ends; ends elsewhere drop them."""
    placed = F.transform(edges, lambda e: F.struct(F.get(places, e["src"]).alias("src"), F.get(places, e["dst"]).alias("dst")))
    return F.filter(placed, lambda e: (e["src"] >= 0) & (e["dst"] >= 0))


def both_ways(edges: Column) -> Column:
    return let(edges, lambda e: F.sort_array(overlay(e, turned(e))))


def bounded(edges: Column, n: Column) -> Column:
    """Edges between positions 0 .. n-1."""
    return let(n, lambda n: F.filter(edges, lambda e: (e["src"] >= 0) & (e["dst"] >= 0) & (e["src"] < n) & (e["dst"] < n)))


def canonical_graphs(records: DataFrame, cap: int = 512, buckets: int = 4096, slots: int = 4, source_slots: int = 96, strip_types: bool = False, strip_topology: bool = False) -> DataFrame:
    """code_id, language, canonical, lexical, source, ast_edges, next_edges, ddg_edges of records that have nodes.

    The first `cap` nodes stay. Canonical ids count from 1, as 0 is padding; without types every node has id 1, without
    topology there are no edges. Nodes that follow each other are joined both ways.
    """
    r = with_places(with_categories(records.where(F.size("types") > 0)), cap)
    n = F.least(F.size("types"), F.lit(cap))
    r = r.withColumn("n", n).withColumn("categories", F.slice("categories", 1, cap))
    labels = F.slice(F.arrays_zip(F.col("types").alias("t"), F.slice(F.coalesce("labels", F.array()), F.lit(1), F.size("types")).alias("l"), F.col("categories").alias("c")), 1, cap)
    names = F.transform(labels, lambda x: X.lexical_source(x["t"], F.coalesce(x["l"], F.lit("")), x["c"], F.col("language")))
    place = F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c, i + 1)])
    ids = F.transform("categories", lambda c: F.lit(1) if strip_types else F.try_element_at(place, c))
    none = F.array().cast("array<struct<src:int,dst:int>>")
    follow = F.when(F.col("n") > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.array(F.struct(i.alias("src"), (i + 1).alias("dst")), F.struct((i + 1).alias("src"), i.alias("dst")))))).otherwise(none)
    edges = (none, none, none) if strip_topology else (both_ways(bounded(F.col("edges"), F.col("n"))), follow, both_ways(projected(F.col("ddg_edges"), F.col("places"))))
    return r.select("code_id", "language", ids.alias("canonical"), X.lexical_sketches(names, buckets, slots).alias("lexical"), X.source_sketch(F.col("code"), buckets, source_slots).alias("source"), *[e.alias(c) for e, c in zip(edges, ("ast_edges", "next_edges", "ddg_edges"), strict=True)])


def audit(records: DataFrame, cap: int = 256, keys=("language",)) -> DataFrame:
    """By keys: codes, codes cut off, nodes kept, unknown ones, dependence edges exported and those that can be projected."""
    r = with_places(with_categories(records), cap)
    inside = projected(bounded(F.col("ddg_edges"), F.size("ddg_ids")), F.col("places"))
    per = r.select(*keys, (F.size("types") > 0).alias("some"), (F.size("types") > cap).alias("cut"), F.least(F.size("types"), F.lit(cap)).alias("nodes"), F.size(F.filter(F.slice("categories", 1, cap), lambda c: c == "Canonical_Unknown")).alias("unknown"), F.size("ddg_edges").alias("edges"), F.size(inside).alias("inside"))
    g = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("codes"), F.count_if("some").alias("available"), F.count_if("cut").alias("truncated"), F.sum("nodes").alias("nodes"), F.sum("unknown").alias("unknown"), F.count_if(F.col("edges") == 0).alias("empty_ddg"), F.sum("edges").alias("ddg_edges"), F.sum("inside").alias("projectable"))
    rate = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return g.select("*", rate("truncated", "codes").alias("truncated_fraction"), rate("unknown", "nodes").alias("unknown_fraction"), rate("projectable", "ddg_edges").alias("projectable_fraction"))


def message_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """code_id, place, five features of every node: one, ln(1 + degrees) of the graph taken both ways with a loop at each node,
    and the relative place. nodes(code_id, place), edges(code_id, src, dst) by places, repeats kept."""
    ends = edges.select("code_id", F.explode(F.array("src", "dst")).alias("place")).groupBy("code_id", "place").agg(F.count(F.lit(1)).alias("d"))
    last = nodes.groupBy("code_id").agg(F.max("place").alias("last"))
    j = nodes.join(ends, ["code_id", "place"], "left").join(last, "code_id")
    d = F.coalesce("d", F.lit(0)) + 1.0
    return j.select("code_id", "place", F.lit(1.0).alias("one"), F.log1p(d).alias("log_in"), F.log1p(d).alias("log_out"), F.log1p(2 * d).alias("log_degree"), F.coalesce(F.try_divide("place", "last"), F.lit(0.0)).alias("position"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """code_id and eight values of each graph: ln(1 + n) / 10, ln(1 + e) / 10, density (at most 1), and of the degrees of the graph
    taken both ways with loops the mean, deviation and maximum (both ways together), and the mean in and out."""
    ends = edges.select("code_id", F.explode(F.array("src", "dst")).alias("place")).groupBy("code_id", "place").agg(F.count(F.lit(1)).alias("d"))
    e = edges.groupBy("code_id").agg(F.count(F.lit(1)).alias("e"))
    d = 2 * (F.coalesce("d", F.lit(0)) + 1.0)
    g = nodes.select("code_id", "place").join(ends, ["code_id", "place"], "left").groupBy("code_id").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.max(d).alias("top"))
    g = g.join(e, "code_id", "left").withColumn("e", F.coalesce("e", F.lit(0)))
    return _statistics(g)


def _statistics(g: DataFrame) -> DataFrame:
    room = F.greatest(F.lit(1.0), F.col("n") * F.greatest(F.lit(1), F.col("n") - 1))
    return g.select("code_id", (F.log1p("n") / 10).alias("nodes"), (F.log1p("e") / 10).alias("edges"), F.least(F.lit(1.0), F.col("e") / room).alias("density"), (F.col("mean") / 20).alias("mean_degree"), (F.col("sd") / 20).alias("sd_degree"), (F.col("top") / 50).alias("top_degree"), (F.col("mean") / 40).alias("mean_in"), (F.col("mean") / 40).alias("mean_out"))


def with_degrees(records: DataFrame) -> DataFrame:
    """records with `degrees`: how many ends of edges each node has, loops counted twice. Edges stay in the row of their graph."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def count(edges: pa.Array, n: pa.Array) -> pa.Array:
        n = pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), pc.fill_null(pc.list_value_length(edges), 0).to_numpy(zero_copy_only=False))
        starts, ends = np.cumsum(n) - n, edges.flatten()
        out = np.zeros(int(n.sum()), np.int32)
        for end in ("src", "dst"):
            out += np.bincount(ends.field(end).to_numpy(zero_copy_only=False) + starts[row], minlength=len(out)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(out)).astype(np.int32)), pa.array(out), type=pa.list_(pa.int32()))

    return records.withColumn("degrees", count.asNondeterministic()("edges", F.size("ids")))


def message_features_of_rows(records: DataFrame) -> DataFrame:
    """The features of `message_features`, as an array for each graph that is a row with ids and edges by places."""
    both = F.transform("degrees", lambda x, i: F.struct(F.lit(1.0).alias("one"), F.log1p(x + 1.0).alias("log_in"), F.log1p(x + 1.0).alias("log_out"), F.log1p(2 * (x + 1.0)).alias("log_degree"), F.coalesce(F.try_divide(i, F.col("last")), F.lit(0.0)).alias("position")))
    return with_degrees(records).select("code_id", "degrees", (F.size("degrees") - 1).alias("last")).select("code_id", both.alias("features"))


def graph_statistics_of_rows(records: DataFrame) -> DataFrame:
    """The values of `graph_statistics` for graphs that are rows with ids and edges by places."""
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x))
    g = with_degrees(records).select("code_id", F.transform("degrees", lambda x: 2 * (x + 1.0)).alias("d"), F.size("edges").alias("e")).withColumn("n", F.size("d"))
    g = g.withColumn("mean", total("d", lambda x: x) / F.col("n"))
    return _statistics(g.select("code_id", "n", "e", "mean", F.sqrt(total("d", lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / F.col("n")).alias("sd"), F.array_max("d").alias("top")))


def slot_profile(assignments: DataFrame, groups: tuple[str, ...] = tuple(COARSE)) -> DataFrame:
    """slot, group, share of the slot's mass, and the slot's entropy over the number of groups (1 is even).

    assignments(slot, category, mass): how much of a node of a category a slot takes.
    """
    coarse = F.create_map(*[F.lit(x) for g, cs in COARSE.items() for c in cs for x in (c, g)])
    m = assignments.groupBy("slot", F.try_element_at(coarse, F.col("category")).alias("group")).agg(F.sum("mass").alias("mass")).where("group is not null")
    total = m.groupBy("slot").agg(F.sum("mass").alias("total"))
    q = m.join(total, "slot").withColumn("share", F.col("mass") / F.greatest(F.col("total"), F.lit(1e-12)))
    # an empty group adds its floor, as every group is counted
    floor = -1e-12 * math.log(1e-12)
    term = lambda c: -F.greatest(c, F.lit(1e-12)) * F.log(F.greatest(c, F.lit(1e-12)))
    h = q.groupBy("slot").agg(((F.sum(term(F.col("share"))) + (len(groups) - F.count(F.lit(1))) * floor) / F.log(F.lit(float(len(groups))))).alias("entropy"))
    return q.join(h, "slot").select("slot", "group", "share", "entropy")
