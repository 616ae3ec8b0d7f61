"""Identity: canonical keys, name-based uids, digests, display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of node uids (any fixed UUID; ours is the URL namespace of RFC 4122).
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def canonical_key(fields: Sequence[tuple[str, Column]]) -> Column:
    """A key as JSON in contract order; nulls are written, so that equal text means equal keys."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields]), {"ignoreNullFields": "false"})


def name_uid(kind: Column, key: Column) -> Column:
    """A version-5 UUID of kind, a zero byte and the canonical key, in SQL functions only."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(kind, "UTF-8"), F.unhex(F.lit("00")), F.encode(key, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def shortened(text: Column, most: int = 90) -> Column:
    """Text cut at a word before ``most`` characters, with an ellipsis if cut."""
    # \\z, not $: the latter also matches before a final line break
    head = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*\z", "")
    return F.when(F.length(text) > most, F.concat(head, F.lit("…"))).otherwise(text)


def search_line(label: Column, value: Column) -> Column:
    """The line a search row is shown by: the label, a hash cut to 7 digits, and the first line of the matched text."""
    short = F.when(label.rlike(r"\A[0-9a-f]{7,64}\z"), F.substring(label, 1, 7)).otherwise(label)
    first = F.regexp_replace(F.substring_index(value, "\n", 1), r"\A\s+|\s+\z", "")
    return F.when((value == "") | (value == label), short).otherwise(F.concat(short, F.lit(" — "), shortened(first)))


def redacted(context: Column, words: Sequence[str]) -> Column:
    """A map without the entries whose folded name contains one of the words."""
    folded = lambda k: F.regexp_replace(F.lower(k), "[^a-z]", "")
    hit = lambda k: F.greatest(*[F.contains(folded(k), F.lit(w)).cast("int") for w in words], F.lit(0)) > 0
    return F.map_filter(context, lambda k, _: ~hit(k))


def pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000)))), "")
