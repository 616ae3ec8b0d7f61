"""The language of a path: its name, its longest known extension, its first line, its content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What decides between several languages of one extension, in order. A rule that holds ends the search, also
# where its language is no candidate.
RULES = (
    (".ts", r"\A\x{FEFF}?\s*(?:<\?xml\b[^>]*>\s*)?(?:(?:<!--[\s\S]*?-->|<!DOCTYPE\b[^>]*>)\s*)*<TS\b", "XML"),
    (".tsx", r"\A\x{FEFF}?\s*(?:<\?xml\b[^>]*>\s*)?(?:(?:<!--[\s\S]*?-->|<!DOCTYPE\b[^>]*>)\s*)*<TS\b", "XML"),
    (".md", r"(?m)^\s*\(define_", "GCC Machine Description"),
    (".yaml", r"""(?m)^\s*openapi\s*:\s*['"]?3""", "OASv3-yaml"),
    (".yaml", r"""(?m)^\s*swagger\s*:\s*['"]?2""", "OASv2-yaml"),
    (".yml", r"""(?m)^\s*openapi\s*:\s*['"]?3""", "OASv3-yaml"),
    (".yml", r"""(?m)^\s*swagger\s*:\s*['"]?2""", "OASv2-yaml"),
    (".html", r"(?i)<emu-[a-z]", "Ecmarkup"),
    (".htm", r"(?i)<emu-[a-z]", "Ecmarkup"),
    (".sql", r"(?is)\A(?=.*\$\$)(?=.*CREATE\s+(OR\s+REPLACE\s+)?FUNCTION)", "PLpgSQL"),
    (".sql", r"(?m)^\s*GO\s*$|(?i:\[dbo\])", "TSQL"),
    (".sql", r"(?i:VARCHAR2\b)|(?m:^\s*BEGIN\b[\s\S]*\bEND\s*;)", "PLSQL"),
    (".h", r"(?i)@interface|@protocol|#import\s", "Objective-C"),
    (".h", r"(?m)^\s*(class|namespace|template\s*<)|std::", "C++"),
)
# The language of an extension whose content decides nothing.
PREFERRED = {
    ".ts": "TypeScript", ".tsx": "TSX", ".json": "JSON", ".md": "Markdown", ".markdown": "Markdown", ".yaml": "YAML", ".yml": "YAML", ".html": "HTML", ".htm": "HTML", ".sql": "SQL", ".txt": "Text",
    ".h": "C", ".hh": "C++", ".hpp": "C++", ".hxx": "C++", ".m": "Objective-C", ".mm": "Objective-C++",
}


def _interpreter(content: Column) -> Column:
    """The program that a first line ``#!`` names, lower-cased, without ``env`` and its options; null without one."""
    words = F.split(F.trim(F.substring(F.substring_index(content, "\n", 1), 3, 1 << 20), F.lit(" \t\r")), r"\s+")
    base = lambda w: F.substring_index(w, "/", -1)
    rest = F.filter(F.slice(words, 2, F.size(words)), lambda w, i: ~F.startswith(w, F.lit("-")))
    program = F.lower(base(F.when(base(words[0]) == "env", F.try_element_at(rest, F.lit(1))).otherwise(words[0])))
    return F.when(F.startswith(content, F.lit("#!")), F.nullif(program, F.lit("")))


def _openapi(content: Column) -> Column:
    """The rule of a JSON document that names its own kind."""
    held = F.try_parse_json(content)

    def states(key: str, start: str) -> Column:
        value = F.try_variant_get(held, f"$.{key}", "variant")
        return (F.schema_of_variant(value) == "STRING") & F.startswith(F.try_variant_get(held, f"$.{key}", "string"), F.lit(start))

    return F.when(states("openapi", "3"), "OASv3-json").when(states("swagger", "2"), "OASv2-json")


def language_of_paths(
    paths: DataFrame, index: DataFrame, overrides: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, preferred: Mapping[str, str] = PREFERRED, most: int = 100_000
) -> DataFrame:
    """``paths`` (path, content) with ``language`` and ``candidates``.

    ``index``: (kind, key, language), of kind name, extension (with its dot) or interpreter. A file's name counts first, then its
    longest extension that the index knows (``.h.in`` before ``.in``). Several languages are decided by the content and then by
    the extension's default, which must be among them; otherwise the language is ``ambiguous``. A path that the index knows
    neither by name nor by extension takes the language of its first line's interpreter (also without its version), JSON if
    its content is JSON, or else is ``unknown``. ``overrides`` (path, language) go before all. Content may be null.

    Only the distinct endings of names are looked up; index entries, up to ``most`` keys, are broadcast.
    """
    name = F.lower(F.substring_index("path", "/", -1))
    rows = paths.withColumn("__name", name).withColumn("__ending", F.regexp_extract("__name", r"\.[\s\S]*", 0))
    held = index.groupBy("kind", F.lower("key").alias("key")).agg(F.array_sort(F.collect_set("language")).alias("__languages"))
    small = F.broadcast if index.limit(most + 1).count() <= most else lambda df: df
    of = lambda kind, key: small(held.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("__languages")))

    # every ending from a dot on, the longest that is known
    endings = rows.where("__ending <> ''").select("__ending").distinct()
    parts = F.split("__ending", r"\.")
    each = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    known = endings.select("__ending", F.explode(each).alias("__extension")).join(of("extension", "__extension"), "__extension")
    longest = known.groupBy("__ending").agg(F.max_by(F.struct("__extension", "__languages"), F.length("__extension")).alias("__by_ending"))

    rows = rows.join(of("name", "__name").withColumnRenamed("__languages", "__by_name"), "__name", "left").join(longest, "__ending", "left")
    rows = rows.withColumn("__program", _interpreter(F.col("content"))).withColumn("__plain", F.regexp_replace("__program", r"[0-9.]+\z", ""))
    for key in ("__program", "__plain"):
        rows = rows.join(of("interpreter", key).withColumnRenamed("__languages", f"{key}_languages"), key, "left")
    shebang = F.coalesce("__program_languages", "__plain_languages")[0]
    json = F.when(F.try_parse_json("content").isNotNull(), "JSON")

    candidates = F.coalesce("__by_name", "__by_ending.__languages")
    # an extension decides by its own rules, a name by those of its own text
    kind = F.when(F.col("__by_name").isNotNull(), F.col("__name")).otherwise(F.col("__by_ending.__extension"))
    text = F.coalesce("content", F.lit(""))
    ruled = F.coalesce(*[F.when((F.col("__kind") == e) & text.rlike(p), language) for e, p, language in rules], F.when(F.col("__kind") == ".json", _openapi(text)))
    default = F.coalesce(*[F.when(F.col("__kind") == e, language) for e, language in preferred.items()])
    rows = rows.withColumn("__candidates", candidates).withColumn("__kind", kind).withColumn("__chosen", F.when(F.size("__candidates") > 1, F.coalesce(ruled, default)))
    decided = F.when(F.array_contains("__candidates", F.col("__chosen")), F.col("__chosen")).otherwise("ambiguous")
    other = F.coalesce(shebang, json, F.lit("unknown"))
    language = F.when(F.col("__candidates").isNull(), other).when(F.size("__candidates") == 1, F.col("__candidates")[0]).otherwise(decided)
    out = rows.withColumns({"language": language, "candidates": F.coalesce("__candidates", F.array(other))})
    if overrides is not None:
        said = overrides.select("path", F.col("language").alias("__said"))
        out = out.join(said, "path", "left").withColumns({"language": F.coalesce("__said", "language"), "candidates": F.when(F.col("__said").isNotNull(), F.array("__said")).otherwise(F.col("candidates"))})
    return out.select(*paths.columns, "language", "candidates")
