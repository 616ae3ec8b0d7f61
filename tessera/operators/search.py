"""Ranked text search, term mentions and exact vector search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.connections import grouped_top


def ranked(entries: DataFrame, text: str) -> DataFrame:
    """One best match per node: title prefix 0, title 1, another field 3; then the shorter value, then the value.

    ``entries``: (kind, id, label, value, is_title), one row per text field.
    """
    v = F.lower("value")
    rank = F.when(F.col("is_title") & F.startswith(v, F.lit(text.lower())), 0).when(F.col("is_title"), 1).otherwise(3)
    hits = entries.where(F.instr(v, text.lower()) > 0).withColumn("rank", rank)
    best = F.min(F.struct("rank", F.length("value").alias("n"), "value"))
    return hits.groupBy("kind", "id", "label").agg(best.alias("b")).select("kind", "id", "label", F.col("b.rank").alias("rank"), F.col("b.value").alias("value"))


def flat(entries: DataFrame, text: str, limit: int) -> DataFrame:
    return ranked(entries, text).orderBy("rank", F.length("label"), "label", "id").limit(limit)


def grouped(entries: DataFrame, text: str, per_kind: int) -> DataFrame:
    """Each kind's best rows with its total, best rank and place among the groups.

    The group whose best answer ranks highest leads, then the fuller one, then the kind's name.
    """
    found = ranked(entries, text)
    top = grouped_top(found, ["kind"], [F.asc("rank"), F.length("label"), F.asc("label"), F.asc("id")], max(1, min(per_kind, 20)))
    # one row a kind: as few as the catalogue has kinds
    kinds = found.groupBy("kind").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.orderBy("best", F.desc("n"), "kind"))
    return top.join(kinds.select("kind", "best", place.alias("place")), "kind")


def catalogue_ranked(kinds: DataFrame, text: str) -> DataFrame:
    """(name, word, rank, matched) of catalogue entries: the word itself 0, its start 1, inside it 2, in the definition 3."""
    needle, word, definition = text.strip().lower(), F.lower("word"), F.lower(F.coalesce("definition", F.lit("")))
    rank = F.when(word == needle, 0).when(F.startswith(word, F.lit(needle)), 1).when(F.instr(word, needle) > 0, 2).when(F.instr(definition, needle) > 0, 3)
    hits = kinds.withColumn("rank", rank).where(F.col("rank").isNotNull() & F.lit(needle != ""))
    return hits.select("name", "word", "rank", F.when(F.col("rank") == 3, F.col("definition")).otherwise(F.col("word")).alias("matched"))


def _brought(rows: DataFrame) -> list:
    """Rows on the driver whose number a parameter bounds: names of one automaton, one block of queries."""
    return rows.collect()


#: Names of terms that one automaton holds; more are dealt over several, each of which goes over the texts.
NAMES = 200_000


#: Mentions that a task holds as rows before it hands them on.
MENTIONS = 20_000


def folded(text: str) -> str:
    """Lower case character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _in_word(c: str) -> bool:
    return c.isalnum() or c in "_$"


def found_terms(automaton, line: str) -> dict:
    """Number of mentions of every term in a line: whole words only, of one term's names the longest that begins first."""
    hits: dict = {}
    low = folded(line)
    for end, (name, terms) in automaton.iter(low):
        start = end - len(name) + 1
        if not (start and _in_word(low[start - 1])) and not (end + 1 < len(low) and _in_word(low[end + 1])):
            for term in terms:
                hits.setdefault(term, []).append((start, start - end - 1))
    out = {}
    for term, places in hits.items():
        upto, n = 0, 0
        for start, size in sorted(places):
            if start >= upto:
                upto, n = start - size, n + 1
        out[term] = n
    return out


def term_mentions(texts: DataFrame, terms: DataFrame, definitions: DataFrame | None = None, names: int = NAMES) -> DataFrame:
    """(id, line, term, n): mentions of terms (term, name: one row for each of a term's names) in texts (id, text), by line from 1.

    Any case, whole words (not beside a letter, digit, ``_`` or ``$``), of one term's overlapping names the longest at the
    earliest place. Lines that define the term itself, ``definitions`` (id, term, line_start, line_end), don't count for it.
    All names are looked for at once by an Aho-Corasick automaton, built in every task from at most ``names`` of them; larger term
    tables are dealt over several automata. The work is one pass over the texts for each and what it finds.
    """
    def mentions(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, line_, term, many = zip(*rows)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(line_, pa.int32()), pa.array(term), pa.array(many, pa.int64())], names=["id", "line", "term", "n"])

    some = terms.where("name IS NOT NULL AND name <> ''").select("term", "name").distinct()
    parts = max(1, -(-some.count() // names))
    dealt = some.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    kind, of = texts.schema["id"].dataType.simpleString(), terms.schema["term"].dataType.simpleString()
    out = None
    for part in range(parts):
        held: dict[str, list] = {}
        for r in _brought(dealt.where(F.col("part") == part).select("term", "name")):
            held.setdefault(folded(r["name"]), []).append(r["term"])
        held_ = texts.sparkSession.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch], held_=held_) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for name, mine in held_.value.items():
                automaton.add_word(name, (name, mine))
            automaton.make_automaton()
            for b in batches:
                rows: list[tuple] = []
                for i in range(b.num_rows):  # one text at a time: a batch of long texts holds very many mentions
                    for n, line in enumerate((b.column(1)[i].as_py() or "").split("\n") if held_.value else ()):
                        rows += [(i, n + 1, term, many) for term, many in found_terms(automaton, line).items()]
                        if len(rows) >= MENTIONS:
                            yield mentions(b, rows)
                            rows = []
                if rows:
                    yield mentions(b, rows)

        found = texts.select("id", "text").mapInArrow(search, f"id {kind}, line int, term {of}, n long")
        out = found if out is None else out.unionByName(found)
    if definitions is not None:
        d = definitions.select("id", "term", "line_start", "line_end")
        own = F.col("line").between(F.col("line_start"), F.col("line_end"))
        out = out.alias("m").join(d.alias("d"), (F.col("m.id") == F.col("d.id")) & (F.col("m.term") == F.col("d.term")) & own, "left_anti")
    return out


def glossary(docs: DataFrame, key: str) -> DataFrame:
    """(key, n, term, definition) of Markdown texts: lines that begin with a term in bold and go on, after a dash or a colon,
    with its definition. Of a term that a text defines twice, the first counts."""
    line = r"(?m)^[ \t]*(?:[-*+][ \t]+)?\*\*([^*\n]+)\*\*[ \t]*(?:—|–|-|:)[ \t]*(\S[^\n]*)$"
    terms, said = (F.regexp_extract_all("text", F.lit(line), F.lit(i)) for i in (1, 2))
    rows = docs.select(key, F.posexplode(F.arrays_zip(terms.alias("term"), said.alias("definition"))).alias("n", "x"))
    rows = rows.select(key, (F.col("n") + 1).alias("n"), F.trim("x.term").alias("term"), F.trim("x.definition").alias("definition"))
    return rows.groupBy(key, "term").agg(F.min(F.struct("n", "definition")).alias("m")).select(key, "m.n", "term", "m.definition")


def line_range(docs: DataFrame, first: int, last: int) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.where((F.col("n") >= first - 1) & (F.col("n") < last)).select("doc_id", (F.col("n") + 1).cast("long").alias("line"), "text")


def _distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` from one query."""
    if metric == "l2":
        return np.sqrt(((x - q) ** 2).sum(1))
    if metric == "inner_product":
        return -(x @ q)
    if metric == "cosine":
        return 1 - (x @ q) / (np.sqrt((x * x).sum(1)) * np.sqrt(q @ q))
    raise ValueError(metric)


def _nearest(vectors: DataFrame, queries: DataFrame, metric: str, k: int, block: int, within: list[str], names: list[str], others: bool) -> DataFrame:
    """(*within, query_id, rank, *names, distance): each query's k nearest of the vectors with the same ``within``.

    Up to ``block`` queries are broadcast, and vectors stay where they are. More meet the vectors in a block join: about ``block``
    of each in one task, whatever their numbers and however unequal the spaces; then nothing goes through the driver but two
    counts. The best of each batch or pair of blocks are ranked together.
    """
    _distances(metric, np.ones((1, 1)), np.ones(1))  # refuses unknown metrics here
    v = vectors.where("embedding IS NOT NULL").select(*within, *names, F.col("embedding").cast("array<double>").alias("v"))
    q = queries.where("embedding IS NOT NULL").select(*within, "query_id", F.col("embedding").cast("array<double>").alias("q"))
    if within:
        v, q = v.dropna(subset=within), q.dropna(subset=within)
    batches = max(1, -(-q.count() // block))
    kinds = dict(v.dtypes) | dict(q.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*within, "query_id", *names)) + ", distance double"

    def near(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n, many, at, dist = left.num_rows, [], [], []
        if n and right.num_rows:
            x = left.column("v").combine_chunks().flatten().to_numpy().reshape(n, -1)
            # places of the names in their order, for ties
            order = [np.unique(np.array(left.column(c).to_pylist()), return_inverse=True)[1] for c in names]
            own = left.column(names[0]).to_numpy() if others else None
            ids = right.column("query_id").to_numpy()
            mine = right.column("q").combine_chunks().flatten().to_numpy().reshape(right.num_rows, -1)
            for i, y in enumerate(mine):
                d = np.round(_distances(metric, x, y), 6)
                some = np.flatnonzero(own != ids[i]) if others else np.arange(n)
                if len(some) > k:
                    some = some[d[some] <= np.partition(d[some], k - 1)[k - 1]]
                some = some[np.lexsort((*(o[some] for o in reversed(order)), d[some]))[:k]]
                many.append(len(some))
                at.append(some)
                dist.append(d[some])
        rows = np.concatenate([np.zeros(0, np.int64), *at])
        cols = [pa.array([key[i].as_py()] * len(rows), key[i].type) for i in range(len(within))]
        cols.append(right.column("query_id").take(pa.array(np.repeat(np.arange(len(many)), many))))
        cols += [left.column(c).take(pa.array(rows)) for c in names]
        return pa.table([*cols, pa.array(np.concatenate([np.zeros(0), *dist]))], [*within, "query_id", *names, "distance"])

    if batches == 1:
        few = v.sparkSession.sparkContext.broadcast(pa.Table.from_pylist([r.asDict() for r in _brought(q)], to_arrow_schema(q.schema)))

        def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                whole = pa.Table.from_batches([b])
                for key in set(zip(*(whole.column(c).to_pylist() for c in within))) if within else [()]:
                    mine, theirs = whole, few.value
                    for c, x in zip(within, key):
                        mine, theirs = mine.filter(pc.field(c) == x), theirs.filter(pc.field(c) == x)
                    yield from near(tuple(map(pa.scalar, key)), mine, theirs).combine_chunks().to_batches()

        out = v.mapInArrow(scan, schema)
    else:
        parts = max(1, -(-v.count() // block))
        part, asked = (F.pmod(F.xxhash64(*c), F.lit(n)).cast("int") for c, n in ((names, parts), (["query_id"], batches)))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        keys = [*within, "part", "asked"]
        v = v.select("*", part.alias("part"), every(batches).alias("asked"))
        q = q.select("*", every(parts).alias("part"), asked.alias("asked"))
        out = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(near, schema)
    rank = F.row_number().over(W.partitionBy(*within, "query_id").orderBy("distance", *names))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(*within, "query_id", "rank", *names, "distance")


def exact_neighbours(vectors: DataFrame, queries: DataFrame, metric: str, k: int, block: int = 4_096) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest of all vectors (vec_id, embedding), the query itself excluded, ties by
    id. Distances count to 6 places; null vectors take no part."""
    return _nearest(vectors, queries.select(F.col("vec_id").alias("query_id"), "embedding"), metric, k, block, [], ["vec_id"], True)


def scoped_neighbours(vectors: DataFrame, queries: DataFrame, sources: Sequence[str], metric: str, k: int, block: int = 4_096) -> DataFrame:
    """(space, query_id, rank, source, item, distance): the k nearest vectors (source, space, item, embedding) of a set of
    sources to each query (space, query_id, embedding), in the query's space alone; ties by source, then item.

    An item is known by its source and its name, so two sources may hold the same name. No sources give no rows, vectors of no
    space take no part; spaces may differ in dimension.
    """
    return _nearest(vectors.where(F.col("source").isin(*sources)), queries, metric, k, block, ["space"], ["source", "item"], False)
