"""Register queries: the driver's orders and lines written as register pages, then read back by the operators themselves.

An order is a record of its customer, a line is a visit in the column of its
line number. Values are written as people write them (dates three ways, weights
in grams or kilograms, pressures in either unit, columns by number or by
header); the SQL works out what they mean from the tables, not from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import quality as ql
from ..operators import series as sr
from . import panels
from .catalog import query, read

HEADERS = [
    "1er trimestre - Visite 1", "1er trimestre - Visite 2", "1er trimestre - Visite 3", "2ème trimestre - Visite 1", "2ème trimestre - Visite 2", "2ème trimestre - Visite 3",
    "3ème trimestre - 7ème mois", "3ème trimestre - 8ème mois", "3ème trimestre - 9ème mois",
]
AS_OF = "1999-06-01"


def _cells(rows: DataFrame, page_idx: int, page_type: str, first: Column, cells: list[tuple]) -> DataFrame:
    """One field for each of the cells (key, label, kind, value) of a row; those without a value are NOT_PROVIDED."""
    out = rows.withColumn("j", F.explode(F.array(*map(F.lit, range(len(cells))))))
    of = lambda i: F.get(F.array(*[F.lit(c[i]) for c in cells]), F.col("j")) if isinstance(cells[0][i], str) else _chosen([c[i] for c in cells])
    out = sr.once(out, value=_chosen([c[3].cast("string") for c in cells]))  # a cell's text is made for this cell only, and once
    status = F.when(F.col("value").isNull(), "NOT_PROVIDED").otherwise(F.col("read_as"))
    return out.select(
        "record_id", F.lit(page_idx).alias("page_idx"), F.lit(page_type).alias("page_type"), (first + F.col("j")).cast("int").alias("ordinal"), of(0).alias("key"), of(1).alias("label"), of(2).alias("kind"), "value",
        status.alias("status"), F.lit("AI").alias("origin"), F.col("at").cast("int").alias("column"))


def _chosen(columns: list[Column]) -> Column:
    """The j-th of the columns; the others aren't worked out."""
    out = F.lit(None).cast("string")
    for j, c in reversed(list(enumerate(columns))):
        out = F.when(F.col("j") == j, c).otherwise(out)
    return out


def fields(spark, sf_dir: str) -> DataFrame:
    """The fields of all records: an antenatal page (0), a delivery page (1) of finished orders, an identification page (2)."""
    orders = read(spark, sf_dir, "orders").withColumn("record_id", F.concat(F.lit("r"), "o_orderkey")).withColumn("lmp", F.to_date("o_orderdate"))
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = read(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(in_order)).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    percent = lambda c: F.round(F.col(c) * 100).cast("int")
    lines = lines.withColumns({"t": percent("l_tax"), "d": percent("l_discount"), "q": F.col("l_quantity").cast("int"), "k": F.col("l_linenumber")})
    lines = lines.withColumn("day", F.date_add("lmp", 30 + 25 * F.col("k") + F.col("q")))
    sure, flag = F.col("l_linestatus") == "F", F.col("l_returnflag")
    lines = lines.withColumn("read_as", F.when(sure, "KNOWN").otherwise("NEEDS_REVIEW")).withColumn("at", F.when(sure, F.col("k")))
    head = F.when(sure, "x").when(flag == "A", "Autre").otherwise(F.get(F.array(*map(F.lit, HEADERS)), F.col("k") - 1))
    label = lambda name: F.concat(F.lit(f"{name} | "), head)
    key = lambda name: F.concat(F.lit(name), F.col("n"))
    date = F.when(flag == "N", F.date_format("day", "dd/MM/yyyy")).when(flag == "A", F.col("day").cast("string")).otherwise(F.date_format("day", "dd - MM - yyyy"))
    grams = 45_000 + 400 * F.col("q") + 300 * F.col("k") + F.when(F.col("t") == 8, 12_000).otherwise(0)
    grams = F.when((F.col("d") == 10) & (F.col("t") == 0), 4500).otherwise(grams)
    kilos = F.concat((grams / 1000).cast("int"), F.lit(","), F.pmod((grams / 100).cast("int"), F.lit(10)))
    torr = [(90 + F.col("q")).cast("string"), (55 + 3 * F.col("t")).cast("string")]
    swapped = (F.col("d") == 5) & (F.col("t") == 5)
    pressure = F.when(sure, F.when(swapped, F.concat_ws("/", torr[1], torr[0])).otherwise(F.concat_ws("/", *torr))).otherwise(F.concat(10 + F.floor(F.col("q") / 10), F.lit(",5 / "), 5 + F.col("t")))
    weeks = 4 + 4 * F.col("k") + F.floor(F.col("q") / 7) + F.when(F.col("d") >= 9, 3).otherwise(0)
    cells = [
        (key("d"), label("Venue le"), "date", F.when(F.col("q") > 1, date)),
        (key("w"), label("Poids (kg)"), "weight", F.when(F.col("q") < 50, F.when(sure, grams.cast("string")).otherwise(kilos))),
        (key("bp"), label("T.A."), "text", pressure),
        (key("ga"), label("Âge probable"), "weeks", F.concat(weeks, F.lit(" SA"))),
        (key("rdv"), label("Rendez-vous"), "date", F.date_add("day", F.when(F.col("d") == 0, 0).otherwise(28)).cast("string")),
        (key("hiv"), label("VIH"), "text", F.when(flag == "R", "Négatif").when(flag == "A", "+")),
    ]
    visits = _cells(lines, 0, "grossesse_actuelle", 100 * F.col("n"), cells)
    orders = orders.withColumns({"read_as": F.lit("KNOWN"), "at": F.lit(None), "p": F.left("o_orderpriority", F.lit(1)).cast("int"), "m": F.floor(F.col("o_totalprice") / 1000)})
    lmp, p, status = F.col("lmp"), F.col("p"), F.col("o_orderstatus")
    facts = _cells(orders, 0, "grossesse_actuelle", F.lit(0), [
        (F.lit("ddr"), F.lit("DDR"), "date", F.when(status != "P", lmp)), (F.lit("dpa"), F.lit("Date prévue d'accouchement"), "date", F.date_add(lmp, F.when(p == 1, 290).otherwise(281)))])
    tick = lambda cond: F.when(cond, "true")
    birth = F.when(p == 2, F.concat(2 + F.pmod("m", F.lit(3)), F.lit(",5 kg"))).otherwise((2000 + 10 * F.pmod("m", F.lit(100))).cast("string"))
    boxes = {"mode_voie_basse_instrumentale": p.isin(2, 3), "mode_cesarienne_urgence": p.isin(2, 4), "lieu_domicile": p == 5, "lieu_maternite": p.isin(1, 2)}
    born = _cells(orders.where("o_orderstatus = 'F'"), 1, "accouchement", F.lit(0), [
        (F.lit("date_accouchement"), F.lit("Date"), "date", F.date_format(F.date_add(lmp, 266), "dd.MM.yyyy")), (F.lit("nn_age_gestationnel"), F.lit("Age"), "weeks", F.when(p == 5, "34").otherwise("38")),
        (F.lit("nn_poids"), F.lit("Poids"), "weight", birth), (F.lit("nn_sexe"), F.lit("Sexe"), "sex", F.when(p < 3, "F").otherwise("M")),
        *[(F.lit(k), F.lit(k), "checkbox", tick(c)) for k, c in boxes.items()]])
    told = [(F.lit(f"acc{i}_date"), F.lit("Date"), "date", F.when(F.pmod("m", F.lit(4)) >= i, "2020")) for i in (1, 2, 3)]
    past = _cells(orders, 2, "identification_antecedents", F.lit(0), [
        (F.lit("gestation"), F.lit("Gestation"), "integer", p), (F.lit("parite"), F.lit("Parité"), "integer", F.when(p == 3, "deux").otherwise(F.pmod("m", F.lit(5)).cast("string"))),
        (F.lit("enfants_vivants"), F.lit("Enfants vivants"), "integer", F.pmod("m", F.lit(7))), (F.lit("obst_avortement_nombre"), F.lit("Avortements"), "integer", F.when(status == "O", 1).otherwise(0)), *told])
    return visits.unionByName(facts).unionByName(born).unionByName(past)


# The meaning of the same rows, from the tables: c holds a value for each cell that has a sure column, s the last one of each measure of a visit.
CELLS = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
v AS (SELECT 'r' || o_orderkey AS record_id, o_custkey, o_orderstatus, l_linenumber AS col, n, l_returnflag AS flag, l_linestatus = 'F' AS sure, CAST(round(l_tax * 100) AS INT) AS t, CAST(round(l_discount * 100) AS INT) AS d, CAST(l_quantity AS INT) AS q,
 CAST(o_orderdate AS DATE) AS lmp, CAST(o_orderdate AS DATE) + (30 + 25 * l_linenumber + CAST(l_quantity AS INT)) AS day FROM l JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' OR l_returnflag <> 'A'),
p AS (SELECT *, CASE WHEN sure THEN CASE WHEN d = 5 AND t = 5 THEN 55 + 3 * t ELSE 90 + q END ELSE 10 * (10 + q // 10) + 5 END AS sys, CASE WHEN sure THEN CASE WHEN d = 5 AND t = 5 THEN 90 + q ELSE 55 + 3 * t END ELSE 10 * (5 + t) END AS dia FROM v),
c AS (SELECT record_id, col, n, sure, 'date' AS measure, 'd' || n AS key, NULL::DOUBLE AS num, NULL::INT AS sys, NULL::INT AS dia, CAST(day AS VARCHAR) AS day, NULL AS code FROM p WHERE q > 1
 UNION ALL SELECT record_id, col, n, sure, 'weight', 'w' || n, CASE WHEN d = 10 AND t = 0 THEN 4500 ELSE 45000 + 400 * q + 300 * col + CASE WHEN t = 8 THEN 12000 ELSE 0 END END / 1000.0::DOUBLE, NULL, NULL, NULL, NULL FROM p WHERE q < 50
 UNION ALL SELECT record_id, col, n, sure, 'bp', 'bp' || n, NULL, sys, dia, NULL, NULL FROM p
 UNION ALL SELECT record_id, col, n, sure, 'gaWeeks', 'ga' || n, 4 + 4 * col + q // 7 + CASE WHEN d >= 9 THEN 3 ELSE 0 END, NULL, NULL, NULL, NULL FROM p
 UNION ALL SELECT record_id, col, n, sure, 'appointment', 'rdv' || n, NULL, NULL, NULL, CAST(day + CASE WHEN d = 0 THEN 0 ELSE 28 END AS VARCHAR), NULL FROM p
 UNION ALL SELECT record_id, col, n, sure, 'hiv', 'hiv' || n, NULL, NULL, NULL, NULL, CASE flag WHEN 'R' THEN 'neg' ELSE 'pos' END FROM p WHERE flag <> 'N'),
s AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY record_id, col, measure ORDER BY n DESC) AS r FROM c) WHERE r = 1),
o AS (SELECT 'r' || o_orderkey AS record_id, o_custkey, o_orderkey, o_orderstatus AS st, CAST(left(o_orderpriority, 1) AS INT) AS p, CAST(floor(o_totalprice / 1000) AS BIGINT) AS m, CAST(o_orderdate AS DATE) AS began FROM orders),
z AS (SELECT record_id, col, max(day) FILTER (measure = 'date') AS date, max(day) FILTER (measure = 'appointment') AS appointment, CAST(max(num) FILTER (measure = 'gaWeeks') AS INT) AS gaWeeks, max(key) FILTER (measure = 'date') AS date_key,
 max(key) FILTER (measure = 'appointment') AS appointment_key, max(key) FILTER (measure = 'gaWeeks') AS ga_key FROM s GROUP BY ALL)
"""
_VALUE = ["record_id", "page_idx", "col", "measure", "key", "status", "num", "sys", "dia", "day", "code"]


@query(CELLS + "SELECT record_id, 0 AS page_idx, col, measure, key, CASE WHEN sure THEN 'KNOWN' ELSE 'NEEDS_REVIEW' END AS status, num, sys, dia, day, code FROM s")
def register_values(spark, sf_dir):
    """Every placed value of every record."""
    return sr.series_values(fields(spark, sf_dir)).select(*_VALUE)


@query(CELLS + """
SELECT record_id, 0 AS page_idx, 'lmp' AS name, 'ddr' AS key, CAST(began AS VARCHAR) AS day, NULL::DOUBLE AS num, NULL AS word FROM o WHERE st <> 'P'
UNION ALL SELECT record_id, 0, 'edd', 'dpa', CAST(began + CASE WHEN p = 1 THEN 290 ELSE 281 END AS VARCHAR), NULL, NULL FROM o
UNION ALL SELECT record_id, 1, 'date', 'date_accouchement', CAST(began + 266 AS VARCHAR), NULL, NULL FROM o WHERE st = 'F'
UNION ALL SELECT record_id, 1, 'gaWeeks', 'nn_age_gestationnel', NULL, CASE WHEN p = 5 THEN 34 ELSE 38 END, NULL FROM o WHERE st = 'F'
UNION ALL SELECT record_id, 1, 'birthWeight', 'nn_poids', NULL, CASE WHEN p = 2 THEN (2 + m % 3) * 1000 + 500 ELSE 2000 + 10 * (m % 100) END, NULL FROM o WHERE st = 'F'
UNION ALL SELECT record_id, 1, 'sex', 'nn_sexe', NULL, NULL, CASE WHEN p < 3 THEN 'F' ELSE 'M' END FROM o WHERE st = 'F'
UNION ALL SELECT record_id, 1, 'mode', NULL, NULL, NULL, CASE WHEN p = 3 THEN 'vaginal' ELSE 'cesarean' END FROM o WHERE st = 'F' AND p IN (2, 3, 4)
UNION ALL SELECT record_id, 1, 'place', NULL, NULL, NULL, CASE WHEN p = 5 THEN 'domicile' ELSE 'maternite' END FROM o WHERE st = 'F' AND p IN (1, 2, 5)""")
def register_facts(spark, sf_dir):
    """What a page says once: last period, due date, delivery."""
    return sr.series_facts(fields(spark, sf_dir)).drop("page_kind")


@query(CELLS + "SELECT record_id, 0 AS page_idx, col, date, appointment, gaWeeks, date_key, appointment_key, ga_key FROM z")
def register_visits(spark, sf_dir):
    """Values pivoted to one row a visit."""
    return sr.visits(sr.series_values(fields(spark, sf_dir))).select("record_id", "page_idx", "col", "date", "appointment", "gaWeeks", "date_key", "appointment_key", "ga_key")


_SEEN = """,
k AS (SELECT z.*, o.* EXCLUDE (record_id), coalesce(date, 'col' || col) AS same_key FROM z JOIN o USING (record_id)),
g AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, same_key ORDER BY (st = 'P') DESC, began DESC, o_orderkey DESC, col DESC) AS r FROM k) WHERE r = 1)
"""


def _merged(spark, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), "o_orderkey").alias("record_id"), F.col("o_custkey").alias("patient_id"), (F.col("o_orderstatus") == "P").alias("is_pending"), F.struct("o_orderdate", "o_orderkey").alias("created_at"),
        F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("lmp"), F.lit(None).cast("date").alias("birth"))
    return sr.merged_visits(sr.visits(sr.series_values(fields(spark, sf_dir))).join(orders, "record_id"))


@query(CELLS + _SEEN + """
SELECT o_custkey AS patient_id, record_id, col, date, CAST(coalesce(gaWeeks, CASE WHEN st <> 'P' THEN floor(date_diff('day', began, CAST(date AS DATE)) / 7.0 * 10 + 0.5) / 10 END) AS DOUBLE) AS x FROM g""")
def register_points(spark, sf_dir):
    """A patient's visits over all photos, each once, and where they lie on the axis."""
    return sr.points(_merged(spark, sf_dir)).select("patient_id", "record_id", "col", "date", "x")


@query(CELLS + _SEEN + """,
d AS (SELECT o_custkey, date, max(appointment) AS appointment FROM g WHERE date IS NOT NULL GROUP BY ALL),
a AS (SELECT o_custkey, date, appointment, (SELECT min(e.date) FROM d e WHERE e.o_custkey = d.o_custkey AND e.date > d.date) AS came, row_number() OVER (PARTITION BY o_custkey ORDER BY date DESC) AS r FROM d WHERE appointment > date)
SELECT o_custkey AS patient_id, date AS given_on, appointment, came AS came_on, CAST(date_diff('day', CAST(appointment AS DATE), CAST(came AS DATE)) AS INT) AS delay_days,
 CASE WHEN date_diff('day', CAST(appointment AS DATE), CAST(came AS DATE)) > 3 THEN 'late' WHEN date_diff('day', CAST(appointment AS DATE), CAST(came AS DATE)) < -3 THEN 'early' WHEN came IS NOT NULL THEN 'in time' END AS timeliness, r = 1 AND came IS NULL AS is_open FROM a""")
def register_appointments(spark, sf_dir):
    """Appointments and whether the patient came."""
    seen = _merged(spark, sf_dir).where("date is not null").groupBy("patient_id", F.col("date").alias("given_on")).agg(F.max("appointment").alias("appointment"))
    out = sr.appointments_of_visits(seen)
    return out.withColumn("came_on", F.col("came_on").cast("string"))


@query("""
WITH o AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'F') AS born, max(CAST(o_orderdate AS DATE)) AS seen, max(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority = '1-URGENT') AS given,
 count_if(o_orderpriority = '2-HIGH') > 1 AS early, count_if(o_orderpriority = '5-LOW') > 1 AS late FROM orders GROUP BY 1),
s AS (SELECT *, CASE WHEN born IS NULL THEN 'ANTENATAL' WHEN NOT early THEN 'POSTPARTUM_EARLY' WHEN NOT late THEN 'POSTPARTUM_LATE' ELSE 'DONE' END AS step FROM o),
w AS (SELECT *, step <> 'DONE' AND given IS NOT NULL AND (born IS NULL OR given >= born) AS written FROM s),
d AS (SELECT *, CASE WHEN step = 'DONE' THEN NULL WHEN written THEN given + 60 WHEN born IS NULL THEN seen + 28 WHEN step = 'POSTPARTUM_EARLY' THEN born + 7 ELSE born + 42 END AS due FROM w),
f AS (SELECT *, coalesce(CAST(floor((epoch_us(TIMESTAMP '2001-01-15 09:00:00') - epoch_us(CAST(due AS TIMESTAMP)) - 43200000000) / 86400000000.0) AS INT), 0) AS days_late FROM d),
b AS (SELECT *, CASE WHEN step = 'DONE' THEN 'DONE' WHEN due IS NULL THEN 'LATER' WHEN days_late > 30 THEN 'LOST' WHEN days_late > 0 THEN 'LATE' WHEN days_late >= -7 THEN 'SOON' ELSE 'LATER' END AS bucket FROM f)
SELECT o_custkey AS patient_id, step, CAST(due AS VARCHAR) AS due, days_late, bucket, CASE WHEN step = 'DONE' THEN 'DELIVERY' WHEN written THEN 'WRITTEN' WHEN born IS NOT NULL THEN 'DELIVERY' ELSE 'LAST_VISIT' END AS anchor FROM b""")
def register_follow_up(spark, sf_dir):
    """What each patient waits for next, and since when."""
    day, of = F.to_date("o_orderdate"), lambda c: F.max(F.when(c, F.to_date("o_orderdate")))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    patients = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(
        of(status == "F").alias("delivered_on"), F.max(day).alias("last_visit"), of(priority == "1-URGENT").alias("appointment_given"), (F.count_if(priority == "2-HIGH") > 1).alias("has_early"), (F.count_if(priority == "5-LOW") > 1).alias("has_late"))
    patients = patients.withColumn("open_appointment", F.date_add("appointment_given", 60))
    return sr.follow_up(patients, "2001-01-15 09:00:00").withColumn("due", F.col("due").cast("string"))


ALERTS = CELLS + """,
y AS (SELECT z.*, CAST(date AS DATE) AS day, CAST(appointment AS DATE) AS app, CASE WHEN st <> 'P' THEN began END AS lmp FROM z JOIN o USING (record_id)),
dw AS (SELECT *, lag(day) OVER w AS pday, lag(gaWeeks) OVER w AS pga, coalesce(day <= lag(day) OVER w, false) AS bad FROM y WHERE day IS NOT NULL WINDOW w AS (PARTITION BY record_id ORDER BY col)),
dd AS (SELECT *, bad OR coalesce(lead(bad) OVER w, false) AS doubtful FROM dw WINDOW w AS (PARTITION BY record_id ORDER BY col)),
de AS (SELECT *, lag(doubtful) OVER w AS pdoubtful FROM dd WINDOW w AS (PARTITION BY record_id ORDER BY col)),
sp AS (SELECT *, coalesce(num, sys) AS b, lag(coalesce(num, sys)) OVER w AS a, lead(coalesce(num, sys)) OVER w AS e FROM s WHERE measure IN ('weight', 'bp') WINDOW w AS (PARTITION BY record_id, measure ORDER BY col)),
h AS (SELECT record_id, p AS gr, CASE WHEN p <> 3 THEN m % 5 END AS pa, m % 7 AS living, CASE WHEN st = 'O' THEN 1 ELSE 0 END AS ab, least(m % 4, 3) AS told FROM o),
r AS (SELECT record_id, 0 AS page_idx, key, 'format' AS code FROM s WHERE (measure = 'weight' AND NOT num BETWEEN 30 AND 200) OR (measure = 'gaWeeks' AND NOT num BETWEEN 4 AND 45) OR (measure = 'bp' AND NOT (sys BETWEEN 60 AND 260 AND dia BETWEEN 30 AND 160))
 UNION ALL SELECT record_id, 0, key, 'bp_order' FROM s WHERE measure = 'bp' AND sys BETWEEN 60 AND 260 AND dia BETWEEN 30 AND 160 AND sys <= dia
 UNION ALL SELECT record_id, 0, date_key, 'future' FROM y WHERE day > DATE '1999-06-02'
 UNION ALL SELECT record_id, 0, appointment_key, 'appointment_before_visit' FROM y WHERE app <= day
 UNION ALL SELECT record_id, 0, ga_key, 'ga_lmp' FROM y WHERE abs(gaWeeks - round(date_diff('day', lmp, day) / 7.0)) > 2
 UNION ALL SELECT record_id, 0, date_key, 'date_order' FROM dw WHERE bad
 UNION ALL SELECT record_id, 0, ga_key, 'ga_dates' FROM de WHERE lmp IS NULL AND NOT doubtful AND NOT pdoubtful AND abs(gaWeeks - pga - date_diff('day', pday, day) / 7.0) > 2
 UNION ALL SELECT record_id, 0, key, 'spike' FROM sp WHERE (b - a) * (b - e) > 0 AND least(abs(b - a), abs(b - e)) > CASE measure WHEN 'weight' THEN 8 ELSE 50 END
 UNION ALL SELECT record_id, 0, unnest(['dpa', 'ddr']), 'edd_lmp' FROM o WHERE st <> 'P' AND p = 1
 UNION ALL SELECT record_id, 1, 'nn_age_gestationnel', 'birth_ga' FROM o WHERE st = 'F' AND p = 5
 UNION ALL SELECT record_id, 1, unnest(['mode_voie_basse_instrumentale', 'mode_cesarienne_urgence']), 'two_modes' FROM o WHERE st = 'F' AND p = 2
 UNION ALL SELECT record_id, 2, unnest(['parite', 'gestation']), 'parity_gravidity' FROM h WHERE pa > gr
 UNION ALL SELECT record_id, 2, unnest(['obst_avortement_nombre', 'gestation']), 'obstetric_sum' FROM h WHERE pa + ab > gr
 UNION ALL SELECT record_id, 2, 'enfants_vivants', 'living_parity' FROM h WHERE living > pa + 1
 UNION ALL SELECT record_id, 2, 'parite', 'deliveries_parity' FROM h WHERE told > pa)
"""


@query(ALERTS + "SELECT record_id, page_idx, key, code FROM r")
def register_alerts(spark, sf_dir):
    """All rules over all records."""
    return ql.check(fields(spark, sf_dir), AS_OF).select("record_id", "page_idx", "key", "code")


@query(ALERTS + "SELECT record_id, page_idx, key, list_aggregate(list_sort(list(code)), 'string_agg', ',') AS alerts, 'NEEDS_REVIEW' AS status FROM r GROUP BY ALL")
def register_flagged(spark, sf_dir):
    """Fields after the check: the alerts of each, and what was sure is to be reviewed."""
    rows = fields(spark, sf_dir).withColumns({"reason": F.lit(None).cast("string"), "coherence": F.lit(None).cast("boolean"), "alerts": F.lit(None).cast("array<string>")})
    out = ql.apply(rows, ql.check(rows, AS_OF)).where("alerts is not null")
    return out.select("record_id", "page_idx", "key", F.array_join("alerts", ",").alias("alerts"), "status")


# ---------------------------------------------------------------- patients and panels

PROFILES = CELLS + """,
kn AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY record_id, col, measure ORDER BY n DESC) AS r FROM c WHERE sure) WHERE r = 1),
pv AS (SELECT o_custkey, avg(sys) AS systolic, avg(dia) AS diastolic, CASE WHEN min(num) FILTER (measure = 'gaWeeks') IS NOT NULL THEN least(min(num) FILTER (measure = 'gaWeeks'), 99) END AS firstGa, count(DISTINCT day) FILTER (measure = 'date') AS n_visits, min(CASE code WHEN 'pos' THEN 1 WHEN 'neg' THEN 2 END) AS hiv_r FROM kn JOIN o USING (record_id) GROUP BY 1),
pf AS (SELECT o_custkey, arg_max(CASE WHEN p = 3 THEN 'vaginal' ELSE 'cesarean' END, (began, o_orderkey)) FILTER (p IN (2, 3, 4)) AS mode, arg_max(CASE WHEN p = 5 THEN 'domicile' ELSE 'maternite' END, (began, o_orderkey)) FILTER (p IN (1, 2, 5)) AS place,
 CAST(arg_max(CASE WHEN p = 2 THEN (2 + m % 3) * 1000 + 500 ELSE 2000 + 10 * (m % 100) END, (began, o_orderkey)) AS DOUBLE) AS birthWeight, CAST(arg_max(CASE WHEN p = 5 THEN 34 ELSE 38 END, (began, o_orderkey)) AS DOUBLE) AS gaAtBirth FROM o WHERE st = 'F' GROUP BY 1),
hv AS (SELECT DISTINCT o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
w AS (SELECT oc.o_custkey, systolic, diastolic, firstGa, coalesce(n_visits, 0) AS n_visits, mode, place, birthWeight, gaAtBirth, CASE WHEN hiv_r = 1 THEN 'pos' WHEN hiv_r = 2 THEN 'neg' WHEN hv.o_custkey IS NOT NULL THEN 'notRecorded' END AS hiv
 FROM (SELECT DISTINCT o_custkey FROM orders) oc LEFT JOIN pv USING (o_custkey) LEFT JOIN pf USING (o_custkey) LEFT JOIN hv USING (o_custkey))
"""


def _profiles(spark, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("r"), "o_orderkey").alias("record_id"), F.col("o_custkey").alias("patient_id"), F.struct("o_orderdate", "o_orderkey").alias("created_at"), "o_orderstatus")
    idx = F.explode(F.when(F.col("o_orderstatus") == "F", F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(2))))
    return sr.profiles(fields(spark, sf_dir), orders.withColumn("page_idx", idx).drop("o_orderstatus"))


@query(PROFILES + "SELECT o_custkey AS patient_id, round(systolic, 6) AS systolic, round(diastolic, 6) AS diastolic, firstGa, n_visits, mode, place, birthWeight, gaAtBirth, hiv FROM w")
def register_profiles(spark, sf_dir):
    """One row a patient: what the panels count."""
    rows = _profiles(spark, sf_dir)
    return rows.select("patient_id", F.round("systolic", 6).alias("systolic"), F.round("diastolic", 6).alias("diastolic"), "firstGa", F.col("n_visits").cast("bigint").alias("n_visits"), "mode", "place", "birthWeight", "gaAtBirth", "hiv")


def _histogram_sql(metric: str, panel: str, lo: float, hi: float, step: float) -> str:
    n = round((hi - lo) / step)
    at = f"CASE WHEN {metric} < {lo} THEN -1 WHEN {metric} >= {hi} THEN {n} ELSE CAST(floor(({metric} - {lo}) / {step}) AS INT) END"
    return f"""SELECT '{panel}' AS panel, '{metric}' AS metric, CAST(b AS VARCHAR) AS bin, CASE WHEN b >= 0 THEN CAST({lo} + b * {step} AS DOUBLE) END AS from_value, CASE WHEN b < {n} THEN CAST({lo} + (b + 1) * {step} AS DOUBLE) END AS to_value,
 CASE WHEN c BETWEEN 1 AND 4 THEN NULL ELSE c END AS n, total FROM (SELECT b, count(w.o_custkey) AS c FROM range(-1, {n + 1}) t(b) LEFT JOIN w ON b = {at} AND nullif({metric}, 0) IS NOT NULL GROUP BY 1), (SELECT count(nullif({metric}, 0)) AS total FROM w) WHERE total > 0"""


def _counts_sql(metric: str, panel: str, value: str, domain) -> str:
    return f"""SELECT '{panel}', '{metric}', b, NULL, NULL, CASE WHEN c BETWEEN 1 AND 4 THEN NULL ELSE c END, NULL FROM (SELECT b, count(w.o_custkey) AS c FROM (SELECT unnest({list(domain)}) AS b) LEFT JOIN w ON b = {value} GROUP BY 1)"""


_PANELS = [_histogram_sql(m, p, *panels.ag.BINS[m]) for m, p in (("systolic", "bp"), ("diastolic", "bp"), ("birthWeight", "delivery"), ("gaAtBirth", "delivery"))] + [
    _counts_sql("firstVisit", "anc", "CASE WHEN firstGa <= 13 THEN 't1' WHEN firstGa <= 27 THEN 't2' WHEN firstGa IS NOT NULL THEN 't3' END", ("t1", "t2", "t3")),
    _counts_sql("visitCounts", "anc", "CASE WHEN n_visits > 0 THEN CAST(least(n_visits, 9) AS VARCHAR) END", "123456789"), _counts_sql("mode", "delivery", "mode", ("vaginal", "cesarean")), _counts_sql("place", "delivery", "place", panels.PLACES),
    _counts_sql("preterm", "delivery", "CASE WHEN gaAtBirth < 37 THEN 'preterm' WHEN gaAtBirth IS NOT NULL THEN 'term' END", ("preterm", "term")),
    _counts_sql("hiv", "tests", "coalesce(hiv, 'notRecorded')", ("pos", "neg", "notRecorded", "noPage")),
    *[f"SELECT 'completeness', 'recorded', '{name}', NULL, NULL, CASE WHEN c BETWEEN 1 AND 4 THEN NULL ELSE c END, total FROM (SELECT count_if({cond}) AS c, count(*) AS total FROM w)"
      for name, cond in (("bp", "systolic IS NOT NULL"), ("hemoglobin", "false"), ("hiv", "hiv IN ('pos', 'neg')"), ("syphilis", "false"), ("birthWeight", "birthWeight IS NOT NULL"))],
]


@query(PROFILES + " UNION ALL ".join(_PANELS))
def register_panels(spark, sf_dir):
    """All panels over all patients."""
    return panels.build(_profiles(spark, sf_dir))
