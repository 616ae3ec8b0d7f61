"""Extraction plugins as table functions: what a plugin answers for a unit, held against what it has declared.

A plugin is a function from a unit's row to answers; it runs as a Python table function of one fixed schema. What it has not
declared (kinds, fields, types, ends) is found by joins with its contract and refused, row by row, with the rule's name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

ANSWER = "what string, kind string, key string, from_kind string, from_key string, to_kind string, to_key string, fields map<string,string>, message string"
# The types of declared fields, as SQL reads them.
TYPES = {"text": "string", "integer": "int", "bigint": "bigint", "boolean": "boolean", "timestamp": "timestamp", "json": "variant"}


@dataclass(frozen=True)
class Field:
    type: str = "text"
    required: bool = False


@dataclass(frozen=True)
class Contract:
    """``vertices``: fields of each kind; ``edges``: (kinds it may start at, kinds it may end at, fields) of each kind."""

    vertices: Mapping[str, Mapping[str, Field]]
    edges: Mapping[str, tuple[Sequence[str], Sequence[str], Mapping[str, Field]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        wrong = [f"{k}.{n}" for k, fs in self._fields().items() for n, f in fs.items() if f.type not in TYPES]
        wrong += [f"{k}: {e}" for k, (a, b, _) in self.edges.items() for e in (*a, *b) if e not in self.vertices]
        if wrong or set(self.vertices) & set(self.edges):
            raise ValueError(f"the contract names what it doesn't declare: {', '.join(wrong) or 'a kind twice'}")

    def _fields(self) -> dict[str, Mapping[str, Field]]:
        return {**self.vertices, **{k: fs for k, (_, _, fs) in self.edges.items()}}

    def kinds(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([("vertex", k) for k in self.vertices] + [("edge", k) for k in self.edges], "what string, kind string")

    def fields(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, n, f.type, f.required) for k, fs in self._fields().items() for n, f in fs.items()], "kind string, name string, type string, required boolean")

    def ends(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, side, e) for k, (a, b, _) in self.edges.items() for side, es in (("from", a), ("to", b)) for e in es], "kind string, side string, end_kind string")


def vertex(kind: str, key: str, **fields: object) -> dict:
    return {"what": "vertex", "kind": kind, "key": key, "fields": fields}


def edge(kind: str, start: tuple[str, str], end: tuple[str, str], **fields: object) -> dict:
    return {"what": "edge", "kind": kind, "from_kind": start[0], "from_key": start[1], "to_kind": end[0], "to_key": end[1], "fields": fields}


def problem(message: str) -> dict:
    return {"what": "problem", "message": message}


def answers(units: DataFrame, unit: str, plugin: Callable[[Row], Iterable[dict]]) -> DataFrame:
    """(unit, answer's columns): what the plugin yields for every row of ``units``. A unit whose plugin fails answers with a
    problem after what it had yielded by then."""

    class Plugin:
        def eval(self, row: Row):
            try:
                for a in plugin(row):
                    fields = {k: None if v is None else str(v) for k, v in (a.get("fields") or {}).items()}
                    yield tuple(a.get(c) for c in ("what", "kind", "key", "from_kind", "from_key", "to_kind", "to_key")) + (fields, a.get("message"))
            except Exception as fault:
                yield ("problem",) + (None,) * 7 + (f"{type(fault).__name__}: {fault}",)

    name = f"plugin_{uuid.uuid4().hex}"
    units.sparkSession.udtf.register(name, udtf(Plugin, returnType=ANSWER))
    columns = ", ".join(f"'{c}', u.`{c}`" for c in units.columns)
    return units.sparkSession.sql(f"SELECT u.`{unit}` AS unit, a.* FROM {{units}} u, LATERAL {name}(named_struct({columns})) a", units=units)


def _fits(value: Column, type_: Column) -> Column:
    return F.coalesce(*[F.when(type_ == t, (F.try_parse_json(value) if t == "json" else value.try_cast(sql)).isNotNull()) for t, sql in TYPES.items()], F.lit(True))


def judged(found: DataFrame, contract: Contract, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of ``answers`` (already stored: they are read several times).

    ``refused``: (unit, what, kind, key, rule, name): undeclared-kind, undeclared-field, wrong-type and missing-field by field's
    name, end-not-allowed and end-missing by side. An edge is missing an end where no accepted vertex of any unit has its kind and
    key, nor ``known`` (kind, key). ``accepted``: the vertices and edges without any refusal. Edges are named ``from>to``.
    The contract's tables are as small as the contract and are broadcast; ends meet vertices by a join on their keys.
    """
    spark = found.sparkSession
    small = F.broadcast
    name = F.coalesce("key", F.concat_ws(">", "from_key", "to_key"))
    rows = found.where("what IN ('vertex', 'edge')").withColumn("id", name).drop("message")
    said = lambda df, rule, what: df.select("unit", "what", "kind", "id", F.lit(rule).alias("rule"), what.alias("name"))
    none = F.lit(None).cast("string")
    kinds, fields, ends = small(contract.kinds(spark)), contract.fields(spark), contract.ends(spark)
    unknown = said(rows.join(kinds, ["what", "kind"], "left_anti"), "undeclared-kind", none)
    declared = rows.join(kinds, ["what", "kind"], "left_semi")
    values = declared.select("unit", "what", "kind", "id", F.explode("fields").alias("name", "value")).join(small(fields), ["kind", "name"], "left")
    extra = said(values.where("type IS NULL"), "undeclared-field", F.col("name"))
    wrong = said(values.where(F.col("type").isNotNull() & F.col("value").isNotNull() & ~_fits(F.col("value"), F.col("type"))), "wrong-type", F.col("name"))
    needed = declared.join(small(fields.where("required").select("kind", "name")), "kind")
    missing = said(needed.where(F.try_element_at("fields", F.col("name")).isNull()), "missing-field", F.col("name"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_kind").alias("end_kind"), F.col(f"{s}_key").alias("end_key")) for s in ("from", "to")])
    held = declared.where("what = 'edge'").select("unit", "what", "kind", "id", F.inline(sides))
    allowed = held.join(small(ends), ["kind", "side", "end_kind"], "left_semi")
    barred = said(held.join(small(ends), ["kind", "side", "end_kind"], "left_anti"), "end-not-allowed", F.col("side"))
    refused = unknown.unionByName(extra).unionByName(wrong).unionByName(missing).unionByName(barred)
    keys = ["unit", "what", "kind", "id"]
    safe = [F.col(f"r.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys]
    good = rows.alias("r").join(refused.select(*keys).distinct().alias("x"), safe, "left_anti")
    there = good.where("what = 'vertex'").select(F.col("kind").alias("end_kind"), F.col("key").alias("end_key")).distinct()
    if known is not None:
        there = there.unionByName(known.select(F.col("kind").alias("end_kind"), F.col("key").alias("end_key"))).distinct()
    dangling = said(allowed.join(there, ["end_kind", "end_key"], "left_anti"), "end-missing", F.col("side"))
    good = good.alias("r").join(dangling.select(*keys).distinct().alias("x"), safe, "left_anti")
    return good, refused.unionByName(dangling)
