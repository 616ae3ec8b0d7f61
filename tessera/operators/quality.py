"""Rules over the graph: conditions on neighbours, ordered checks, findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Condition = Mapping[str, object]


def matching(nodes: DataFrame, edges: DataFrame, condition: Condition) -> DataFrame:
    """Ids of the nodes (one row an id) that a condition holds for.

    {"property": (column, filter, value)}, {"not": c}, {"all": [c, ..]}, {"any": [c, ..]}, or {"neighbours": {"rel", "side",
    "atLeast", "where"}}. Properties are filters of one scan; each neighbours condition is a count by id, joined to those nodes
    that the properties leave open. What isn't known to hold (a null property) doesn't.
    """
    asked: list[Mapping[str, object]] = []
    holds = _compiled(condition, asked, None)
    # nodes that may match, whatever their neighbours
    rows = nodes.where(_compiled(condition, [], True))
    for i, body in enumerate(asked):
        near, far = ("src", "dst") if body["side"] == "out" else ("dst", "src")
        e = edges.where(F.col("rel") == body["rel"]).select(F.col(near).alias("id"), F.col(far).alias("far"))
        if body.get("where"):
            e = e.join(matching(nodes, edges, body["where"]).withColumnRenamed("id", "far"), "far", "left_semi")
        n = e.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= body.get("atLeast", 1))
        rows = rows.join(n.select("id", F.lit(True).alias(f"__asked{i}")), "id", "left")
    return rows.where(holds).select("id")


def _compiled(condition: Condition, asked: list[Mapping[str, object]], known: bool | None) -> Column:
    """A condition as a column that is never null. Neighbours become flags, and are listed in ``asked``; with ``known``, all of
    them are taken to hold or not, whichever lets more nodes through."""
    from tessera.operators.predicates import FILTERS

    (kind, body), *more = condition.items()
    if more:
        raise ValueError("a condition has one kind")
    if kind == "property":
        column, op, value = body
        return F.coalesce(FILTERS[op](F.col(column), value), F.lit(False))
    if kind == "not":
        return ~_compiled(body, asked, None if known is None else not known)
    if kind == "all":
        return reduce(Column.__and__, [_compiled(c, asked, known) for c in body], F.lit(True))
    if kind == "any":
        return reduce(Column.__or__, [_compiled(c, asked, known) for c in body])
    if kind == "neighbours":
        asked.append(body)
        return F.lit(known) if known is not None else F.coalesce(F.col(f"__asked{len(asked) - 1}"), F.lit(False))
    raise ValueError(f"unknown condition {kind}")


def first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, in order; null if none does."""
    return F.coalesce(*[F.when(failed, name) for name, failed in checks])


def findings(rule: str, rows: DataFrame, key: str, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("target"), (detail if detail is not None else F.lit("")).alias("detail"))


def without_dismissed(found: DataFrame, dismissed: DataFrame, disabled: Sequence[str] = ()) -> DataFrame:
    """Exact repeats once; neither dismissed targets nor disabled rules."""
    rows = found.where(~F.col("rule").isin(*disabled)) if disabled else found
    return rows.dropDuplicates(["rule", "target", "detail"]).join(dismissed, ["rule", "target"], "left_anti")


def not_in(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key).distinct(), key, "left_anti")


def paths_between(edges: DataFrame, inputs: DataFrame, sinks: DataFrame, hops: int) -> DataFrame:
    """(input, sink): sinks that an input reaches along src -> dst in exactly ``hops`` steps."""
    front = inputs.select("input", F.col("input").alias("at"))
    for _ in range(hops):
        front = front.join(edges, F.col("at") == F.col("src")).select("input", F.col("dst").alias("at")).distinct()
    return front.withColumnRenamed("at", "sink").join(sinks, "sink", "left_semi").select("input", "sink")


def validated(units: DataFrame, contract: Mapping[str, Sequence[str]], known: DataFrame) -> DataFrame:
    """(id, refused) of unit results (id, kind, key: map, ref) that a contract of key fields by kind doesn't allow.

    Reasons, comma-joined in this order: ``kind`` unknown; ``missing:f`` and ``extra:f`` of a known kind's key fields;
    ``reference`` that ``known`` (ref) doesn't list. What nothing is said against gives no row.
    """
    fields = F.create_map(*[x for k, names in contract.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names]))])
    rows = units.join(known.select("ref", F.lit(True).alias("listed")).distinct(), "ref", "left")
    wanted, held = F.try_element_at(fields, F.col("kind")), F.map_keys("key")
    named = lambda what, names: F.transform(F.array_sort(names), lambda f: F.concat(F.lit(f"{what}:"), f))
    reasons = F.concat(
        F.when(wanted.isNull(), F.array(F.lit("kind"))).otherwise(F.concat(named("missing", F.array_except(wanted, held)), named("extra", F.array_except(held, wanted)))),
        F.when(F.col("listed").isNull(), F.array(F.lit("reference"))).otherwise(F.array().cast("array<string>")),
    )
    return rows.select("id", F.array_join(reasons, ",").alias("refused")).where("refused <> ''")
