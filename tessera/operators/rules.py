"""Code rules over derived relations: each takes its relations and settings and returns its findings (rule, target, detail).

Settings hold thresholds and switches by rule name; ``judged`` runs the rules that are switched on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cycles import components

DEFAULTS: Mapping[str, Mapping[str, object]] = {
    "dependency-cycle": {},
    "sql-input": {},
    "route-outside-group": {},
    "large-file": {"lines": 1_900},
    "change-hotspot": {"heat": 60_000},
    "dead-export": {},
    "debt-marker": {"pattern": "[%$&*#]{3}"},
    "development-value": {"names": "password|token"},
    "declared-unused": {},
    "used-undeclared": {},
    "operation-without-route": {},
    "route-without-operation": {},
}


def _found(rule: str, rows: DataFrame, target: str, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(target).cast("string").alias("target"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def dependency_cycles(imports: DataFrame) -> DataFrame:
    """Each ring of files that import one another: its first member, and all of them in order. ``imports``: src, dst.

    Rings are the strongly connected components of several files, and files that import themselves.
    """
    named = components(imports)
    alone = imports.where("src = dst").select(F.col("src").alias("component")).distinct().withColumn("loop", F.lit(True))
    members = named.groupBy(F.col("component").alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.collect_list("id").alias("ids"))
    members = members.join(alone.withColumnRenamed("component", "ring"), "ring", "left").where("n > 1 OR loop")
    members = members.select("ring", F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",").alias("members"))
    return _found("dependency-cycle", members, "ring", F.col("members"))


def sql_inputs(flows: DataFrame) -> DataFrame:
    """Sinks that run what a builder made from inputs: (src_kind, src, dst_kind, dst) flows from input to build to sink."""
    into = flows.where("src_kind = 'input' AND dst_kind = 'build'").select(F.col("dst").alias("build")).distinct()
    runs = flows.where("src_kind = 'build' AND dst_kind = 'sink'").select(F.col("src").alias("build"), F.col("dst").alias("sink")).distinct()
    return _found("sql-input", runs.join(into, "build", "left_semi"), "sink", F.col("build"))


def routes_outside(routes: DataFrame, serves: DataFrame) -> DataFrame:
    """Routes (key, service, path, inside) outside their service's group whose first path segment the group protects, or which
    serve an operation that isn't public (``serves``: key, public). Services without a group aren't judged."""
    root = F.element_at(F.filter(F.split("path", "/"), lambda p: p != ""), 1)
    rooted = routes.withColumn("root", F.coalesce(root, F.lit("")))
    guarded = rooted.where("inside").select("service", "root", F.lit(True).alias("guarded")).distinct()
    judged = rooted.where("NOT inside").join(guarded.select("service").distinct(), "service", "left_semi")
    secured = serves.where("NOT public").select("key", F.lit(True).alias("secured")).distinct()
    rows = judged.join(guarded, ["service", "root"], "left").join(secured, "key", "left").where("guarded OR secured")
    return _found("route-outside-group", rows, "key", F.when(F.col("guarded"), F.concat(F.lit("group "), "root")).otherwise("contract"))


def large_files(files: DataFrame, lines: int) -> DataFrame:
    return _found("large-file", files.where(F.col("lines") >= lines), "file", F.col("lines"))


def hotspots(files: DataFrame, changes: DataFrame, heat: int) -> DataFrame:
    """Files whose lines times commits reach ``heat``."""
    n = changes.groupBy("file").agg(F.count_distinct("commit_id").alias("n"))
    rows = files.join(n, "file").withColumn("heat", F.col("lines") * F.col("n")).where(F.col("heat") >= heat)
    return _found("change-hotspot", rows, "file", F.col("heat"))


def without(rule: str, held: DataFrame, other: DataFrame, key: str = "key") -> DataFrame:
    """Keys of ``held`` that ``other`` lacks: dead exports, what is declared and unused or used and undeclared, operations
    without a route and routes without an operation."""
    return _found(rule, held.select(key).distinct().join(other.select(key).distinct(), key, "left_anti"), key)


def debt_markers(docs: DataFrame, pattern: str) -> DataFrame:
    return _found("debt-marker", docs.where(F.col("text").rlike(pattern)), "doc_id", F.regexp_count("text", F.lit(pattern)))


def development_values(docs: DataFrame, names: str) -> DataFrame:
    value = f"({names})[=:] *([A-Za-z0-9]+)"
    return _found("development-value", docs.where(F.col("text").rlike(value)), "doc_id", F.regexp_extract("text", value, 1))


def judged(rules: Mapping[str, Callable[[Mapping[str, object]], DataFrame]], settings: Mapping[str, Mapping[str, object]] | None = None) -> DataFrame:
    """The findings of all rules that aren't switched off ({"on": False}), each run with its settings over the defaults."""
    unknown = set(settings or {}) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    held = {name: {"on": True, **DEFAULTS[name], **(settings or {}).get(name, {})} for name in rules}
    parts = [rule({k: v for k, v in held[name].items() if k != "on"}) for name, rule in rules.items() if held[name]["on"]]
    if not parts:
        raise ValueError("no rule is on")
    return reduce(DataFrame.unionByName, parts).distinct()
