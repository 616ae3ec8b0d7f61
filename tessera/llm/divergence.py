"""Source divergence audit: how the sources of a language differ in their use of words.

Every kept term becomes one row with an array over the sources of its language (a wide vector); the JVM's higher-order functions
turn it into one contribution a pair of sources, and sums of these combine on the map side before they are shuffled.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_counted, materialize

#: What each byte of a text becomes: terms are runs of ASCII letters, taken in lower case, and of whatever isn't ASCII.
LETTERS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Terms that a task gathers before it hands their counts on.
HELD = 200_000


def share(count: Column, of: Column) -> Column:
    """floor(10^9 * count / of) for 0 <= count <= of, exact: three digits at a time, so that no product exceeds 1000 * of.
    Exact up to 9 * 10^15 terms of a language; beyond, the session's overflow check raises."""
    first = count * 1_000
    second = (first % of) * 1_000
    third = (second % of) * 1_000
    whole = lambda a: F.call_function("div", a, of)
    return whole(first) * 1_000_000 + whole(second) * 1_000 + whole(third)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[collections.Counter, collections.Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"]
            )

    for b in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in b.columns]):
            n, docs = held.setdefault((lang, source), (collections.Counter(), collections.Counter()))
            terms = text.translate(LETTERS).split()
            size -= len(n)
            n.update(terms)
            docs.update(set(terms))
            size += len(n)
            if size >= HELD:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term.

    One pass over the texts as bytes: all that isn't of a term becomes a space, and A-Z lower case. Counts of some documents are
    gathered in the task and handed on, some hundred thousand at a time; sums by (lang, source, term) are all that is shuffled.
    """
    empty = F.lit("")
    texts = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    counts = texts.mapInArrow(_terms, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text).

    A language keeps the terms that ``least`` of its documents hold. Every source of it has of each kept term the smoothed
    share p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)) in whole numbers. Part ``pair``: the sum over all kept terms of
    (p - q)^2 / (p + q), rounded down for each term, for every other source of the language. Part ``term``: the ``top`` terms
    that a source uses more than its language does, by the same measure.

    Null lang, source and text count as empty; every (lang, source) that occurs has its rows, also without any term. Every row
    is a document, also one that repeats an id. An empty table gives no rows. A source of most rows costs no task more than
    others: its counts combine before the shuffle, and vectors are spread by term. Memory is bounded by the number of
    sources of a language (a vector's length).
    """
    counts = term_counts(docs)
    vectors = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    vectors = materialize(vectors.where(F.col("docs") >= least).drop("docs"))

    # one row a language: its sources in order with their numbers of kept terms, the terms' number and the sum of both
    of_source = vectors.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    zero = F.lit(0).cast("long")
    sources = groups.join(of_source, ["lang", "source"], "left").groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", zero).alias("n")))).alias("sources"), F.coalesce(F.sum("n"), zero).alias("total")
    )
    kept = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    langs = materialize(sources.join(kept, "lang", "left").withColumn("v", F.coalesce("v", zero)).withColumn("many", F.col("v")))

    # the wide vectors: counts and shares by the place of the source. Each expression is used once: what a lambda or a filter
    # mentions again would be computed again
    wide = join_counted(vectors, langs, "lang")
    counted = lambda held: F.transform("sources", lambda s: F.struct(F.coalesce(F.try_element_at(held, s["source"]), zero).alias("n"), (s["n"] + F.col("v") * 2).alias("of")))
    wide = wide.select(
        "lang", "term", (share(F.col("n") + 2, F.col("total") + F.col("v") * 2) + 1).alias("q"),
        F.element_at(F.transform(F.array(F.map_from_entries("cells")), counted), 1).alias("counts"),
    )
    shares = F.transform("counts", lambda c: F.struct(c["n"].alias("n"), (share(c["n"] + 2, c["of"]) + 1).alias("p")))
    wide = materialize(wide.select("lang", "term", "q", shares.alias("vector")))

    # contributions of a term: each source with those after it
    each = wide.select("lang", F.col("vector.p").alias("ps"), F.posexplode("vector.p").alias("i", "p"))
    later = F.slice("ps", F.col("i") + 2, F.size("ps"))
    parts = each.select("lang", "i", F.inline(F.transform(later, lambda q, k: F.struct((F.col("i") + 1 + k).alias("j"), distance(F.col("p"), q).alias("f")))))
    sums = parts.groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))

    named = langs.select("lang", F.col("sources.source").alias("names")).select("lang", "names", F.posexplode("names").alias("i", "a"))
    after = F.slice("names", F.col("i") + 2, F.size("names"))
    named = named.select("lang", "i", "a", F.inline(F.transform(after, lambda b, k: F.struct((F.col("i") + 1 + k).alias("j"), b.alias("b")))))
    pairs = named.join(sums, ["lang", "i", "j"], "left").select("lang", "a", "b", F.coalesce("value", zero).alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "value", F.inline(both)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

    used = wide.select("lang", "term", "q", F.posexplode("vector").alias("i", "x")).where((F.col("x.n") > 0) & (F.col("x.p") > F.col("q")))
    terms = used.select("lang", "i", F.col("term").alias("item"), distance(F.col("x.p"), F.col("q")).alias("value"))
    first = F.row_number().over(W.partitionBy("lang", "i").orderBy(F.desc("value"), "item"))
    place = langs.select("lang", F.posexplode("sources.source").alias("i", "source"))
    terms = terms.withColumn("rank", first).where(F.col("rank") <= top).join(place, ["lang", "i"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
