"""State machines as folds over ordered events.

A refused event leaves the state where it was, so the state before an event depends on all events before it. Every event is a
function from state to state; these compose, so a run of events is one small map. Events are dealt over ranges of (subject,
order): each range gives the maps of its first and its last subject, the only ones that another range may share; the maps are
composed in the order of the ranges, and every range is then gone through again from its own start.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut


@dataclass(frozen=True)
class Step:
    """An allowed transition: ``event`` leads from ``source`` to ``target`` where all guards hold."""

    source: str
    event: str
    target: str
    guards: tuple[str, ...] = ()
    label: str | None = None


@dataclass(frozen=True)
class Machine:
    """A table of transitions. ``guards`` names boolean SQL expressions over an event's columns (null counts as false).

    Of several transitions that leave a state on an event the first whose guards hold is taken. A table that can't be right
    is refused: undeclared or repeated states, repeated ids, undeclared guards, states that nothing reaches.
    """

    name: str
    initial: str
    states: tuple[str, ...]
    steps: tuple[Step, ...]
    guards: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        def check(right: bool, what: str) -> None:
            if not right:
                raise ValueError(f"machine {self.name}: {what}")

        check(len(set(self.states)) == len(self.states), "a state is declared twice")
        check(self.initial in self.states, f"the initial state {self.initial} is not declared")
        check(len(set(self.ids)) == len(self.ids), "a transition id is declared twice")
        for s in self.steps:
            check(s.source in self.states and s.target in self.states, f"{self.id_of(s)} names a state that is not declared")
            check(bool(s.event.strip()), f"{self.id_of(s)} names no event")
            check(all(g in self.guards for g in s.guards), f"{self.id_of(s)} names a guard that is not declared")
        reached, more = set(), {self.initial}
        while more:
            reached |= more
            more = {s.target for s in self.steps if s.source in reached} - reached
        check(reached == set(self.states), f"nothing reaches {', '.join(sorted(set(self.states) - reached))}")

    def id_of(self, step: Step) -> str:
        return f"{self.name}/{step.source}--{step.event}{'' if step.label is None else '-' + step.label}-->{step.target}"

    @cached_property
    def ids(self) -> list[str]:
        return [self.id_of(s) for s in self.steps]

    @cached_property
    def _leaving(self) -> dict[tuple[str, str], list[tuple[str, Step]]]:
        out: dict[tuple[str, str], list[tuple[str, Step]]] = {}
        for i, s in zip(self.ids, self.steps):
            out.setdefault((s.source, s.event), []).append((i, s))
        return out

    def step(self, state: str, event: str | None, held: frozenset[str]) -> tuple[str, str | None, str | None, str | None]:
        """(state after, transition id, refusal code, guard that refused) of an event under the guards that hold.

        Of transitions that all were refused, the one is named most of whose guards hold, the first of equal ones, by its first
        guard that doesn't.
        """
        if state not in self.states:
            return state, None, f"{self.name}/unknown-state", None
        ways = self._leaving.get((state, event), [])
        if not ways:
            return state, None, f"{self.name}/no-transition", None
        for i, s in ways:
            if held.issuperset(s.guards):
                return s.target, i, None, None
        _, closest = max(ways, key=lambda way: sum(g in held for g in way[1].guards))
        return state, None, f"{self.name}/guard-refused", next(g for g in closest.guards if g not in held)

    def held(self) -> Column:
        """The names of the guards that hold for an event."""
        return F.array_compact(F.array(*[F.when(F.expr(e), F.lit(g)) for g, e in self.guards.items()])) if self.guards else F.array().cast("array<string>")

    def mermaid(self) -> str:
        """The table as a state diagram, in code point order."""
        rows = sorted(zip(self.steps, self.ids), key=lambda x: (x[0].source, x[0].event, x[0].target, x[1]))
        lines = ["stateDiagram-v2", f"  [*] --> {self.initial}"]
        lines += [f"  {s.source} --> {s.target}: {s.event}{f' [{" & ".join(s.guards)}]' if s.guards else ''}" for s, _ in rows]
        return "\n".join(lines + [f"  {s} --> [*]" for s in sorted(set(self.states) - {s.source for s in self.steps})])


def follow(machine: Machine, events: DataFrame, subject: str, order: Sequence[str], event: str, begun: str | None = None) -> DataFrame:
    """``events`` with ``before``, ``after``, ``transition``, ``code`` and ``guard`` (see ``Machine.step``).

    A subject's events are taken by ``order``, from the machine's initial state or from the one that its column ``begun`` holds
    (the same in all its rows; null: initial; a state that isn't declared refuses everything). Events of one subject may be any
    number: they lie in several ranges, which work side by side. Two rows a range are composed by one task and broadcast, as many as
    there are shuffle partitions. A null subject is a subject; rows that tie in everything ordered by are taken in any order.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in events.columns if c not in ("before", "after", "transition", "code", "guard")]
    start = F.coalesce(F.col(begun), F.lit(machine.initial)) if begun else F.lit(machine.initial)
    rows = events.select(*names, machine.held().alias("__held"), start.cast("string").alias("__start"))
    rows = rows.repartitionByRange(n, subject, *order).sortWithinPartitions(subject, *order).withColumn("__range", F.spark_partition_id())
    rows = cut(rows)
    key, what = names.index(subject), names.index(event)
    held, begin, place = len(names), len(names) + 1, len(names) + 2
    states = machine.states

    def fields(b: pa.RecordBatch):
        return zip(b.column(key).to_pylist(), b.column(what).to_pylist(), map(frozenset, b.column(held).to_pylist()), b.column(begin).to_pylist())

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The composed map of the first and of the last subject of a range."""

        @lru_cache(1 << 16)
        def moved(e: str | None, h: frozenset[str]) -> tuple[int, ...]:
            return tuple(states.index(machine.step(s, e, h)[0]) for s in states)

        @lru_cache(1 << 16)
        def then(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
            return tuple(b[x] for x in a)

        still = tuple(range(len(states)))
        ends: list[tuple] = []
        now, kind, range_ = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            kind, range_ = b.schema.field(key).type, b.column(place)[0].as_py()
            for k, e, h, s in fields(b):
                if now is None or now[0] != k:
                    if now and not ends:
                        ends.append(now)
                    now = (k, still, s)
                now = (k, then(now[1], moved(e, h)), now[2])
        if now:
            ends.append(now)
            ks, ms, ss = zip(*ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([range_] * len(ends), pa.int32()), pa.array(range(len(ends)), pa.int32()), pa.array(ks, kind), pa.array(ms, pa.list_(pa.int32())), pa.array(ss)], names=["range", "place", "key", "map", "start"]
            )

    type_ = rows.schema[subject].dataType.simpleString()

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state in which a range finds its first subject, where an earlier range has it too."""
        last: tuple | None = None
        out, before = [], None
        for b in batches:
            for range_, k, map_, start in zip(*[c.to_pylist() for c in b.columns]):
                on = range_ != before and last is not None and last[0] == k
                state = last[1] if on else start
                if on:
                    out.append((range_, state))
                last = (k, states[map_[states.index(state)]] if state in states else state)
                before = range_
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([s for _, s in out], pa.string())], names=["__range", "__into"])

    # two rows a range: one task composes them in order, and what comes of it is as small
    ends = cut(rows.mapInArrow(maps, f"range int, place int, key {type_}, map array<int>, start string"))
    into = ends.repartition(1).sortWithinPartitions("range", "place").drop("place").mapInArrow(starts, "__range int, __into string")
    joined = rows.join(F.broadcast(into), "__range", "left").select(*rows.columns, "__into")

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, now, state = True, None, ""
        step = lru_cache(1 << 16)(machine.step)
        for b in batches:
            out = []
            for k, e, h, s in fields(b):
                if first or now != k:
                    carried = b.column(place + 1)[0].as_py() if first else None
                    state = s if carried is None else carried
                    first, now = False, k
                after, *more = step(state, e, h)
                out.append((state, after, *more))
                state = after
            if out:
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(c, pa.string()) for c in zip(*out)], names=[*names, "before", "after", "transition", "code", "guard"])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + [f"{c} string" for c in ("before", "after", "transition", "code", "guard")])
    return joined.mapInArrow(steps, schema)
