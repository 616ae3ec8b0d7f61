"""Queries over the opinion relation: agreement, language, refinement, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import aggregates as A
from tessera.operators import opinions as O
from tessera.plans.registry import query

FIELDS = ("grade", "amount", "title")
AGREED = """SELECT holder, CASE WHEN count(DISTINCT grade) = 1 THEN max(grade) END AS grade, CASE WHEN count(DISTINCT amount) = 1 THEN max(amount) END AS amount,
    CASE WHEN count(DISTINCT title) = 1 THEN max(title) END AS title FROM opinion WHERE state = 'open' GROUP BY holder"""
NOW = 1_735_689_600_000


@query("agreed_values", AGREED)
def agreed_values(t):
    return O.agree(t.opinion, "holder", FIELDS)


@query("agreed_group_by", f"WITH a AS ({AGREED}) SELECT grade AS value, count(*) AS n FROM a GROUP BY grade ORDER BY n DESC, value ASC NULLS LAST LIMIT 20")
def agreed_group_by(t):
    return A.group_by(O.agree(t.opinion, "holder", ["grade"]), "grade")


@query("agreed_count", f"WITH a AS ({AGREED}) SELECT count(*) AS n FROM a WHERE grade = 'g1'")
def agreed_count(t):
    return O.agree(t.opinion, "holder", ["grade"]).where("grade = 'g1'").agg(F.count(F.lit(1)).alias("n"))


@query(
    "contested",
    """SELECT holder, contested FROM (SELECT holder, concat_ws(',', CASE WHEN count(DISTINCT grade) > 1 THEN 'grade' END, CASE WHEN count(DISTINCT amount) > 1 THEN 'amount' END,
    CASE WHEN count(DISTINCT title) > 1 THEN 'title' END) AS contested FROM opinion WHERE state = 'open' GROUP BY holder) x WHERE contested <> ''""",
)
def contested(t):
    return O.contested(t.opinion, "holder", FIELDS)


CHOSEN = """chosen AS (SELECT o.* FROM opinion o JOIN (SELECT holder, min(CASE WHEN lang = 'de' THEN 0 WHEN lang = 'en' THEN 1 WHEN lang IS NULL THEN 2 END) AS best FROM opinion
    WHERE state = 'open' AND title IS NOT NULL GROUP BY holder) b ON o.holder = b.holder
    WHERE o.state = 'open' AND o.title IS NOT NULL AND (CASE WHEN lang = 'de' THEN 0 WHEN lang = 'en' THEN 1 WHEN lang IS NULL THEN 2 END) = b.best)"""


@query("language_value", f"WITH {CHOSEN} SELECT holder, CASE WHEN count(DISTINCT title) = 1 THEN max(title) END AS title, count(*) AS opinions FROM chosen GROUP BY holder")
def language_value(t):
    rows = O.choose_language(t.opinion, "holder", "title", "de", "en")
    return rows.groupBy("holder").agg(O.agreed("title").alias("title"), F.count("title").alias("opinions"))


@query("language_contested", f"WITH {CHOSEN} SELECT holder FROM chosen GROUP BY holder HAVING count(DISTINCT title) > 1")
def language_contested(t):
    return O.contested(O.choose_language(t.opinion, "holder", "title", "de", "en"), "holder", ["title"]).select("holder")


@query(
    "label_fallback",
    """WITH r AS (SELECT holder, title, CASE WHEN lang = 'fr' THEN 0 WHEN lang = 'de' THEN 1 WHEN lang IS NULL THEN 2 ELSE 3 END AS r FROM opinion WHERE state = 'open' AND title IS NOT NULL)
    SELECT r.holder, CASE WHEN count(DISTINCT title) = 1 THEN max(title) END AS title FROM r JOIN (SELECT holder, min(r) AS best FROM r GROUP BY holder) b ON r.holder = b.holder AND r.r = b.best GROUP BY r.holder""",
)
def label_fallback(t):
    return O.agree(O.label_language(t.opinion, "holder", "title", "fr", "de"), "holder", ["title"])


@query("opinions_list", "SELECT holder, id, said_by, rn FROM (SELECT holder, id, said_by, CAST(row_number() OVER (PARTITION BY holder ORDER BY id DESC) AS INTEGER) AS rn FROM opinion) x WHERE rn <= 5")
def opinions_list(t):
    return O.newest(t.opinion.select("holder", "id", "said_by"), "holder", [F.desc("id")], 5)


@query(
    "opinion_details",
    """WITH u AS (SELECT holder, 'grade' AS field, grade AS v, id FROM opinion WHERE state = 'open' UNION ALL SELECT holder, 'title', title, id FROM opinion WHERE state = 'open' UNION ALL SELECT holder, 'amount', CAST(amount AS VARCHAR), id FROM opinion WHERE state = 'open'),
      n AS (SELECT holder, field, string_agg(CAST(id AS VARCHAR) || '=' || v, ',' ORDER BY id DESC) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY holder, field ORDER BY id DESC) AS rn FROM u WHERE v IS NOT NULL) x WHERE rn <= 3 GROUP BY 1, 2)
    SELECT u.holder, u.field, false AS is_key, CASE WHEN count(DISTINCT v) = 1 THEN max(v) END AS value, count(DISTINCT v) > 1 AS contested, count(v) AS opinions, coalesce(max(n.newest), '') AS newest FROM u LEFT JOIN n ON n.holder = u.holder AND n.field = u.field GROUP BY 1, 2
    UNION ALL SELECT DISTINCT holder, 'holder', true, CAST(holder AS VARCHAR), false, 0, '' FROM opinion WHERE state = 'open'""",
)
def opinion_details(t):
    return O.details(t.opinion, "holder", ["grade", "title", "amount"], ["holder"])


@query("product_file_index", "SELECT f.path, c.mode, c.bytes, c.form FROM file f LEFT JOIN (SELECT file, CASE WHEN count(DISTINCT flag) = 1 THEN max(flag) END AS mode, CASE WHEN count(DISTINCT added) = 1 THEN max(added) END AS bytes, CASE WHEN count(DISTINCT removed) = 1 THEN max(removed) END AS form FROM change GROUP BY file) c ON c.file = f.file")
def product_file_index(t):
    stated = t.change.groupBy("file").agg(O.agreed("flag").alias("mode"), O.agreed("added").alias("bytes"), O.agreed("removed").alias("form"))
    return t.file.select("file", "path").join(stated, "file", "left").select("path", "mode", "bytes", "form")


@query(
    "opinion_origin",
    "SELECT holder, split_part(evidence, ':', 1) AS file, CAST(split_part(evidence, ':', 2) AS BIGINT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY holder ORDER BY said_at DESC, id DESC) AS rn FROM opinion WHERE state = 'open' AND evidence IS NOT NULL) x WHERE rn = 1",
)
def opinion_origin(t):
    last = t.opinion.where("state = 'open' AND evidence IS NOT NULL").groupBy("holder").agg(F.max_by("evidence", F.struct("said_at", "id")).alias("e"))
    return last.select("holder", F.split_part("e", F.lit(":"), F.lit(1)).alias("file"), F.split_part("e", F.lit(":"), F.lit(2)).cast("long").alias("line"))


@query("holder_label", f"WITH a AS ({AGREED}) SELECT holder, coalesce(title, grade, 'holder ' || CAST(holder AS VARCHAR)) AS label FROM a")
def holder_label(t):
    return O.agree(t.opinion, "holder", FIELDS).select("holder", F.coalesce("title", "grade", F.concat(F.lit("holder "), F.col("holder").cast("string"))).alias("label"))


ORDER = ("view", "click", "purchase")


@query(
    "refinement",
    """WITH p AS (SELECT holder, CASE producer WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS r, CASE WHEN count(DISTINCT grade) = 1 THEN max(grade) END AS grade
      FROM opinion WHERE state = 'open' AND producer IN ('view', 'click', 'purchase') AND grade IS NOT NULL GROUP BY holder, producer)
    SELECT p.holder, grade FROM p JOIN (SELECT holder, max(r) AS r FROM p GROUP BY holder) m ON p.holder = m.holder AND p.r = m.r""",
)
def refinement(t):
    return O.refine(t.opinion, "holder", "grade", ORDER)


@query("refinement_undeclared", "SELECT holder, string_agg(DISTINCT grade, '|' ORDER BY grade) AS grade FROM opinion WHERE state = 'open' AND grade IS NOT NULL GROUP BY holder")
def refinement_undeclared(t):
    return O.undeclared(t.opinion, "holder", "grade")


@query(
    "live_versus_open",
    "SELECT holder, count(*) FILTER (WHERE state = 'open') AS open, count(*) FILTER (WHERE state IN ('open', 'confirmed')) AS live, count(DISTINCT split_part(said_by, '@', 1)) FILTER (WHERE state = 'open') AS producers FROM opinion GROUP BY holder",
)
def live_versus_open(t):
    state = F.col("state")
    producer = F.split_part("said_by", F.lit("@"), F.lit(1))
    return t.opinion.groupBy("holder").agg(F.count(F.when(state == "open", 1)).alias("open"), F.count(F.when(state.isin(*O.LIVE), 1)).alias("live"), F.count_distinct(F.when(state == "open", producer)).alias("producers"))


BUCKETS = "(SELECT 0 AS bucket UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)"


@query(
    "histogram",
    f"""WITH a AS ({AGREED}) SELECT b.bucket, count(a.holder) AS n FROM {BUCKETS} b LEFT JOIN a ON a.amount IS NOT NULL AND
    (CASE WHEN a.amount >= 4 THEN 3 WHEN a.amount >= 2 THEN 2 WHEN a.amount >= 1 THEN 1 ELSE 0 END) = b.bucket GROUP BY b.bucket""",
)
def histogram(t):
    return A.histogram(O.agree(t.opinion, "holder", ["amount"]), "amount", [2, 1, 4, float("inf")])


@query(
    "histogram_age",
    f"""WITH a AS (SELECT holder, ({NOW} - max(said_at)) / 86400000.0 AS age FROM opinion GROUP BY holder) SELECT b.bucket, count(a.holder) AS n FROM {BUCKETS} b LEFT JOIN a ON
    (CASE WHEN age >= 360 THEN 3 WHEN age >= 340 THEN 2 WHEN age >= 336 THEN 1 ELSE 0 END) = b.bucket GROUP BY b.bucket""",
)
def histogram_age(t):
    last = t.opinion.groupBy("holder").agg(F.max("said_at").alias("said_at"))
    return A.histogram(A.age_days(last, "said_at", NOW), "age", [336, 340, 360])


@query("top_n", f"WITH a AS ({AGREED}) SELECT holder, amount FROM a WHERE amount IS NOT NULL ORDER BY amount DESC, holder LIMIT 10")
def top_n(t):
    return A.top_n(O.agree(t.opinion, "holder", ["amount"]), "amount", "holder", 10)


@query("latest_opinion", "SELECT holder, id, said_by FROM (SELECT *, row_number() OVER (PARTITION BY holder ORDER BY said_at DESC, id DESC) AS rn FROM opinion) x WHERE rn = 1")
def latest_opinion(t):
    return t.opinion.groupBy("holder").agg(F.max(F.struct("said_at", "id", "said_by")).alias("m")).select("holder", "m.id", "m.said_by")


@query(
    "producer_statistics",
    "SELECT producer, count(*) AS opinions, count(DISTINCT holder) AS holders, count(*) FILTER (WHERE evidence IS NULL) AS unevidenced, min(id) AS first_id, max(id) AS last_id FROM opinion GROUP BY producer",
)
def producer_statistics(t):
    return t.opinion.groupBy("producer").agg(
        F.count(F.lit(1)).alias("opinions"), F.count_distinct("holder").alias("holders"), F.count(F.when(F.col("evidence").isNull(), 1)).alias("unevidenced"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query(
    "opinion_history",
    "SELECT id, holder, CAST(lag(id) OVER (PARTITION BY holder, producer ORDER BY id) AS BIGINT) AS previous, count(*) OVER (PARTITION BY holder) AS total FROM opinion",
)
def opinion_history(t):
    before = F.lag("id").over(W.partitionBy("holder", "producer").orderBy("id"))
    return t.opinion.select("id", "holder", before.alias("previous"), F.count(F.lit(1)).over(W.partitionBy("holder")).alias("total"))


@query(
    "edge_attribute_agreement",
    "SELECT l_orderkey, l_partkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS flag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) END AS status, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey",
)
def edge_attribute_agreement(t):
    return t.lineitem.groupBy("l_orderkey", "l_partkey").agg(O.agreed("l_returnflag").alias("flag"), O.agreed("l_linestatus").alias("status"), F.count(F.lit(1)).alias("n"))
