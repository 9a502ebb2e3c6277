"""Queries of the page, form and lifecycle operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forms as fm
from ..operators import layout as ly
from ..operators import lifecycle as lc
from ..operators import series as sr
from . import register
from .catalog import ORACLE_SQL, query, read


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus AS st, lower(split_part(o_orderpriority, '-', 2)) AS v, unnest(CASE WHEN o_orderstatus = 'O' THEN [NULL] ELSE ['Urgent', 'High', 'Médium'] END) AS x FROM orders)
SELECT o_orderkey, CASE WHEN x IS NULL THEN 'Priorité' ELSE 'Priorité ' || x END AS label, CASE WHEN x IS NULL THEN 'choice' ELSE 'checkbox' END AS kind, CASE WHEN x IS NULL THEN v WHEN replace(lower(x), 'é', 'e') = v THEN 'true' END AS value,
 CASE WHEN x IS NULL THEN 'KNOWN' WHEN replace(lower(x), 'é', 'e') = v THEN 'KNOWN' WHEN st = 'P' THEN 'NEEDS_REVIEW' ELSE 'NOT_PROVIDED' END AS status FROM o""")
def options_expanded(spark, sf_dir):
    """Groups of boxes to a row for each option; finished orders have no options."""
    status = F.col("o_orderstatus")
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("Priorité").alias("label"), F.lit("choice").alias("kind"), F.lower(F.get(F.split("o_orderpriority", "-"), 1)).alias("value"), F.when(status == "P", "NEEDS_REVIEW").otherwise("KNOWN").alias("status"),
        F.when(status != "O", F.array(*map(F.lit, ["Urgent", "High", "Médium"]))).alias("options"))
    return fm.expand_groups(rows).select("o_orderkey", "label", "kind", "value", "status")


@query("""
WITH b AS (SELECT l_orderkey AS page_id, l_returnflag AS head, l_partkey * 10 + l_linenumber AS ordinal, 's' || l_suppkey AS option, CASE WHEN l_quantity >= 48 THEN NULL ELSE l_quantity < 25 END AS state FROM lineitem),
g AS (SELECT page_id, head, string_agg(option, ', ' ORDER BY ordinal, option) FILTER (state) AS value, string_agg(option, ',' ORDER BY ordinal, option) AS options, bool_or(state IS NULL) AS doubt FROM b GROUP BY ALL)
SELECT page_id, head, value, options, CASE WHEN doubt THEN 'NEEDS_REVIEW' WHEN value IS NULL THEN 'NOT_PROVIDED' ELSE 'KNOWN' END AS status FROM g""")
def boxes_collapsed(spark, sf_dir):
    """Boxes to one field for each group of a page."""
    state = F.when(F.col("l_quantity") < 48, F.col("l_quantity") < 25)
    boxes = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("head"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.concat(F.lit("s"), "l_suppkey").alias("option"), state.alias("state"))
    return fm.collapse_boxes(boxes).withColumn("options", F.array_join("options", ","))


@query("""
WITH r AS (SELECT l_orderkey, string_agg(l_partkey, '+' ORDER BY l_shipdate, l_partkey) AS r FROM lineitem GROUP BY 1)
SELECT c_custkey AS patient_id, string_agg(o_orderkey || ':' || coalesce(r, ''), ' ' ORDER BY o_orderdate, o_orderkey) AS visits FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY 1""")
def visits_snapshot(spark, sf_dir):
    """Patients with their visits and the records of each, nested."""
    patients = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"))
    visits = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("visit_id"), F.col("o_orderdate").alias("date"))
    records = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("visit_id"), F.col("l_partkey").alias("record_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linestatus").alias("state"))
    shown = F.transform("visits", lambda v: F.concat(v["visit_id"].cast("string"), F.lit(":"), F.coalesce(F.array_join(F.transform(v["records"], lambda r: r["record_id"].cast("string")), "+"), F.lit(""))))
    return fm.snapshot(patients, visits, records).select("patient_id", F.array_join(shown, " ").alias("visits"))


def _lines(spark, sf_dir: str):
    """Parts as text lines, forty to a page: place by number and size, handwriting by type."""
    x = F.pmod(F.col("p_partkey") * 37, F.lit(400)).cast("int")
    y = F.col("p_size") * 7
    return read(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 40).alias("page_id"), F.col("p_partkey").alias("i"), F.col("p_name").alias("text"), x.alias("x0"), y.alias("y0"), (x + 30 + F.col("p_size")).alias("x1"), (y + 9).alias("y1"),
        F.col("p_type").isin("STANDARD", "PROMO", "ECONOMY").alias("hand"), F.lit(10).alias("th"))


_LINES = """
WITH t AS (SELECT p_partkey // 40 AS page_id, p_partkey AS i, p_name AS text, CAST(p_partkey * 37 % 400 AS INT) AS x0, p_size * 7 AS y0, CAST(p_partkey * 37 % 400 AS INT) + 30 + p_size AS x1, p_size * 7 + 9 AS y1, p_type IN ('STANDARD', 'PROMO', 'ECONOMY') AS hand FROM part)
"""


@query(_LINES + """,
j AS (SELECT v.page_id, v.i, l.i AS label_i, l.text AS label, v.text, abs((v.y0 + v.y1) / 2.0 - (l.y0 + l.y1) / 2.0) AS dy, v.x0 - l.x1 AS gap FROM t v JOIN t l ON v.page_id = l.page_id AND v.hand AND NOT l.hand),
s AS (SELECT *, CAST(dy AS DOUBLE) + CAST(0.05 AS DOUBLE) * greatest(gap, 0) AS score FROM j WHERE dy <= 6 AND gap BETWEEN -5 AND 120)
SELECT page_id, i, label_i, label, text, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id, i ORDER BY score, label_i) AS r FROM s) WHERE r = 1""")
def labels_paired(spark, sf_dir):
    """Handwriting with the printed label nearest on its row."""
    return ly.label_pairs(_lines(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_LINES + """,
c AS (SELECT page_id, i, text, CAST(floor((y0 + y1) / 2.0 / 60) AS INT) AS row, CAST(floor((x0 + x1) / 2.0 / 100) AS INT) AS col FROM t) SELECT * FROM c WHERE row < 5 AND col < 4""")
def cells_filled(spark, sf_dir):
    """Lines in the cells of a table of five rows and four columns on each page."""
    lines = _lines(spark, sf_dir)
    grid = lambda step, n: F.array(*[F.lit(step * k) for k in range(n + 1)])
    return ly.in_cells(lines, lines.select("page_id").distinct().withColumns({"xs": grid(100, 4), "ys": grid(60, 5)}))


@query(_LINES + "SELECT page_id, i, row_number() OVER (PARTITION BY page_id ORDER BY floor((y0 + y1) / 2.0 / 20), x0, i) AS place FROM t")
def lines_in_order(spark, sf_dir):
    """Lines as they are read: by bands, then from the left."""
    return ly.reading_order(_lines(spark, sf_dir)).select("page_id", "i", F.col("place").cast("bigint").alias("place"))


@query("""
WITH e AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS value, 1 + event_id % 3 AS weight FROM events WHERE value IS NOT NULL), p AS (SELECT *, CASE WHEN value - lag(value) OVER w <= 50 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY value)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS g FROM p) SELECT user_id, CAST(sum(value * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) AS value, CAST(sum(weight) AS BIGINT) AS weight FROM g GROUP BY user_id, g""")
def ruling_lines(spark, sf_dir):
    """Positions (whole numbers, as pixels are, so that their mean doesn't hang on the order of the sum) closer than a gap make one line, at their weighted mean."""
    rows = read(spark, sf_dir, "events").where("value is not null").select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("value"), F.expr("1 + event_id % 3").alias("weight"))
    return ly.lines_of_gaps(rows, "user_id", "value", "weight", 50)


@query("SELECT o_orderkey AS record_id, CAST(coalesce(max(l_linenumber), -1) + 1 AS INT) AS next_idx FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def page_index_next(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return lc.next_page_index(orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("record_id"), F.col("l_linenumber").alias("page_idx")))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, 'N° ' || CASE event_type WHEN 'purchase' THEN 'dossier' WHEN 'click' THEN 'rue' ELSE 'fiche' END AS label, regexp_replace(props, '[^A-Za-z0-9]', '', 'g') || event_id AS raw FROM events)
SELECT user_id AS record_id, arg_min(upper(raw), event_id) AS code FROM e WHERE event_type NOT IN ('click', 'error') GROUP BY 1""")
def codes_suggested(spark, sf_dir):
    """The first code read on a record: streets are no record labels, errors are illegible."""
    kind = F.col("event_type")
    label = F.concat(F.lit("N° "), F.when(kind == "purchase", "dossier").when(kind == "click", "rue").otherwise("fiche"))
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("record_id"), F.lit(0).alias("page_idx"), F.col("event_id").alias("ordinal"), label.alias("label"), F.concat("props", F.lit(" "), "event_id").alias("value"), F.when(kind == "error", "ILLEGIBLE").otherwise("KNOWN").alias("status"))
    return lc.suggested_codes(rows)


@query(f"SELECT bucket, count(*) AS n FROM ({ORACLE_SQL['register_follow_up']}) GROUP BY 1")
def follow_up_buckets(spark, sf_dir):
    """How many patients are late, lost or due soon."""
    return register.register_follow_up(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))


@query(register.CELLS + """,
f AS (SELECT record_id, 0 AS page_idx, count(*) AS n FROM s GROUP BY 1) SELECT record_id, page_idx, n FROM f""")
def placed_values(spark, sf_dir):
    """How many values of a page found their visit."""
    return sr.series_values(register.fields(spark, sf_dir)).groupBy("record_id", "page_idx").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey AS patient_id, CAST(l_linenumber AS INT) AS place, max(strftime(l_shipdate, '%Y-%m-%d')) AS date, max(l_returnflag) AS modalite, max(CASE WHEN l_linestatus = 'F' THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END) AS poids,
 max(CASE WHEN l_returnflag = 'R' THEN l_returnflag END) AS complication FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2""")
def deliveries_listed(spark, sf_dir):
    """Earlier deliveries as rows: a line of an order is one, the form has room for five."""
    told = {
        "date": F.date_format("l_shipdate", "yyyy-MM-dd"), "modalite": F.col("l_returnflag"), "poids": F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int").cast("string")),
        "complication": F.when(F.col("l_returnflag") == "R", F.col("l_returnflag")),
    }
    cells = F.array(*[F.struct(F.concat(F.lit("acc"), "l_linenumber", F.lit(f"_{c}")).alias("key"), v.alias("value")) for c, v in told.items()])
    return fm.previous_deliveries(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patient_id"), F.lit(fm.HISTORY_PAGE).alias("page_type"), F.inline(cells)))


@query("""
WITH p AS (SELECT l_orderkey AS patient_id, l_linenumber AS k, bool_or(l_returnflag = 'R') AS t, max(strftime(l_shipdate, '%Y-%m-%d')) AS day FROM lineitem GROUP BY 1, 2)
SELECT patient_id, vaccine, coalesce(bool_or(t) FILTER (p.k = v.k), false) AS ticked, CASE WHEN vaccine = 'rubeole' THEN max(day) FILTER (p.k = 7) END AS date
FROM p CROSS JOIN (VALUES ('vat_1', 1), ('vat_2', 2), ('vat_3', 3), ('vat_4', 4), ('vat_5', 5), ('rubeole', 6), ('hepatite_b', 0)) v(vaccine, k) GROUP BY patient_id, vaccine""")
def vaccines_given(spark, sf_dir):
    """Seven vaccines a patient: lines 1 to 5 tick the numbered ones, line 6 another, line 7 dates it."""
    n = F.col("l_linenumber")
    key = F.when(n <= 5, F.concat(F.lit("vat_"), n)).when(n == 6, "rubeole").otherwise("rubeole_date")
    value = F.when(n <= 6, (F.col("l_returnflag") == "R").cast("string")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return fm.vaccinations(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patient_id"), F.lit(fm.HISTORY_PAGE).alias("page_type"), key.alias("key"), value.alias("value")))


@query("""
WITH f AS (SELECT o_orderkey AS patient_id, CASE o_orderstatus WHEN 'F' THEN 'Complications' WHEN 'O' THEN 'Antécédents de la femme' ELSE 'Autre' END AS section, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN ' RAS ' WHEN '5-LOW' THEN 'Néant' WHEN '3-MEDIUM' THEN '0' ELSE o_orderpriority END AS value, o_totalprice FROM orders)
SELECT patient_id, section, value FROM f WHERE section <> 'Autre' AND o_totalprice > 50000 AND lower(trim(value)) NOT IN ('ras', 'néant', '0')""")
def facts_noted(spark, sf_dir):
    """What a patient's summary tells: certain entries of the noted sections that say something."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("patient_id"), F.when(status == "F", "Complications").when(status == "O", "Antécédents de la femme").otherwise("Autre").alias("section"),
        F.when(priority == "4-NOT SPECIFIED", " RAS ").when(priority == "5-LOW", "Néant").when(priority == "3-MEDIUM", "0").otherwise(priority).alias("value"), F.when(F.col("o_totalprice") > 50000, "KNOWN").otherwise("NEEDS_REVIEW").alias("status"))
    return fm.noted_facts(rows).drop("status")


@query("""
WITH c AS (SELECT o_orderkey AS record_id, count(*) FILTER (l_returnflag = 'N') AS waiting, count(*) FILTER (l_returnflag = 'A') AS n, min(l_linenumber) FILTER (l_returnflag = 'R') AS e FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY 1), f AS (SELECT * FROM c WHERE waiting = 0)
SELECT record_id, 0 AS place, CASE WHEN n > 0 THEN 'AI_PROCESSED' ELSE 'PROCESSING_FAILED' END AS state, CASE WHEN n = 0 THEN 'E' || e END AS note FROM f UNION ALL SELECT record_id, 1, 'NEEDS_REVIEW', NULL FROM f WHERE n > 0""")
def reading_moves(spark, sf_dir):
    """Events after reading: lines are pages that were read (A), refused (R) or still wait (N)."""
    flag = F.col("l_returnflag")
    records = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") == "O", "PENDING_AI").otherwise("NEEDS_REVIEW").alias("state"))
    pages = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("page_idx"), (flag == "A").alias("is_read"), F.when(flag == "R", F.concat(F.lit("E"), "l_linenumber")).alias("error"))
    return lc.moves_after_reading(records, pages)
