"""Registered queries over the driver's tables, each with the SQL that checks it.

The operators know nothing of these tables: every query hands them column names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display as dp
from ..functions import reading as rd
from ..functions import text as tf
from ..functions import values as vf
from ..operators import aggregate as ag
from ..operators import forms as fm
from ..operators import joins as jn
from ..operators import lifecycle as lc
from ..operators import windows as wd

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts"):
    """Whole seconds of a timestamp without time zone, as UTC."""
    return F.expr(f"unix_micros(cast(cast({ts} as string) || 'Z' as timestamp)) div 1000000")


def millis(ts: str = "ts"):
    return F.expr(f"unix_micros(cast(cast({ts} as string) || 'Z' as timestamp)) div 1000")


# ---------------------------------------------------------------- aggregates


@query("""
WITH b AS (SELECT l_returnflag, CASE WHEN l_extendedprice < 10000 THEN -1 WHEN l_extendedprice >= 90000 THEN 16 ELSE CAST(floor((l_extendedprice - 10000) / 5000) AS INT) END AS bin FROM lineitem),
g AS (SELECT DISTINCT l_returnflag FROM b), d AS (SELECT l_returnflag, unnest(range(-1, 17)) AS bin FROM g),
c AS (SELECT l_returnflag, bin, count(*) AS c FROM b GROUP BY ALL), t AS (SELECT l_returnflag, count(*) AS total FROM b GROUP BY ALL)
SELECT d.l_returnflag, CAST(d.bin AS INT) AS bin, CASE WHEN d.bin >= 0 THEN 10000.0 + d.bin * 5000 END::DOUBLE AS from_value, CASE WHEN d.bin < 0 THEN 10000.0 WHEN d.bin < 16 THEN 10000.0 + d.bin * 5000 + 5000 END::DOUBLE AS to_value,
 CASE WHEN coalesce(c, 0) BETWEEN 1 AND 4 THEN NULL ELSE coalesce(c, 0) END AS n, total FROM d LEFT JOIN c USING (l_returnflag, bin) JOIN t USING (l_returnflag)""")
def hist_masked_price(spark, sf_dir):
    return ag.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", 10000, 90000, 5000, ["l_returnflag"])


@query("""
WITH m AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1),
b AS (SELECT CASE WHEN v < 50000 THEN -1 WHEN v >= 250000 THEN 20 ELSE CAST(floor((v - 50000) / 10000) AS INT) END AS bin FROM m),
c AS (SELECT bin, count(*) AS c FROM b GROUP BY 1), d AS (SELECT unnest(range(-1, 21)) AS bin)
SELECT CAST(d.bin AS INT) AS bin, CASE WHEN d.bin >= 0 THEN 50000.0 + d.bin * 10000 END::DOUBLE AS from_value, CASE WHEN d.bin < 0 THEN 50000.0 WHEN d.bin < 20 THEN 50000.0 + d.bin * 10000 + 10000 END::DOUBLE AS to_value,
 CASE WHEN coalesce(c, 0) BETWEEN 1 AND 4 THEN NULL ELSE coalesce(c, 0) END AS n, (SELECT count(*) FROM m) AS total FROM d LEFT JOIN c USING (bin)""")
def hist_two_level_mean(spark, sf_dir):
    return ag.histogram(ag.mean_per_entity(read(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice"), "mean_value", 50000, 250000, 10000)


@query("""
WITH s AS (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus), p AS (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O', 'P', 'X')),
c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS c FROM orders GROUP BY ALL)
SELECT o_orderpriority, o_orderstatus, CASE WHEN coalesce(c, 0) BETWEEN 1 AND 4 THEN NULL ELSE coalesce(c, 0) END AS n FROM p CROSS JOIN s LEFT JOIN c USING (o_orderpriority, o_orderstatus)""")
def dense_counts_masked(spark, sf_dir):
    return ag.dense_counts(read(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"], ["o_orderpriority"])


@query("""
SELECT c_nationkey, c_mktsegment, CASE WHEN count(*) BETWEEN 1 AND 11 THEN NULL ELSE count(*) END AS population, CASE WHEN count(*) >= 12 THEN round(avg(c_acctbal), 4) END AS mean_balance, count(*) < 12 AS suppressed FROM customer GROUP BY ALL""")
def suppress_small_population(spark, sf_dir):
    return ag.suppress_small(read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], F.round(F.avg("c_acctbal"), 4), "mean_balance", 12)


@query("""
SELECT user_id, coalesce(list_extract(['error', 'purchase', 'signup', 'view'], min(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END)), 'none') AS outcome FROM events GROUP BY 1""")
def dominant_outcome(spark, sf_dir):
    return ag.dominant(read(spark, sf_dir, "events"), "user_id", "event_type", ["error", "purchase", "signup", "view"])


@query("""
SELECT o_custkey, least(min(o_totalprice / 10000), 99.0) AS first_value, CASE WHEN least(min(o_totalprice / 10000), 99.0) <= 5 THEN 't1' WHEN least(min(o_totalprice / 10000), 99.0) <= 15 THEN 't2' ELSE 't3' END AS band
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1""")
def first_bucketed(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") / 10000).alias("v"))
    return ag.first_banded(rows, "o_custkey", "v", (5, 15), ("t1", "t2", "t3"), 99.0)


@query("SELECT user_id, CAST(least(count(DISTINCT CAST(ts AS DATE)), 9) AS BIGINT) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def capped_distinct_days(spark, sf_dir):
    return ag.capped_distinct(read(spark, sf_dir, "events").where("event_type = 'purchase'"), "user_id", F.to_date("ts"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE value IS NOT NULL GROUP BY ALL")
def last_non_null(spark, sf_dir):
    return ag.last_known(read(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("""
SELECT user_id, coalesce(list_extract(['purchase', 'cart', 'click'], min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'cart' THEN 2 WHEN 'click' THEN 3 END)), 'autre') AS picked FROM events WHERE value > 60 GROUP BY 1""")
def priority_pick(spark, sf_dir):
    return ag.priority_pick(read(spark, sf_dir, "events").where("value > 60"), "user_id", "event_type", ["purchase", "cart", "click"], "autre")


@query("""
WITH j AS (SELECT d.lang, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), a AS (SELECT lang, count(*) AS total, CAST(count_if(quality IS NOT NULL) AS BIGINT) AS q, CAST(count_if(toxic = 1) AS BIGINT) AS t, CAST(count_if(length(text) >= 20000) AS BIGINT) AS l FROM j GROUP BY 1),
u AS (SELECT lang, total, unnest(['quality', 'toxic', 'long']) AS measure, unnest([q, t, l]) AS c FROM a)
SELECT lang, measure, CASE WHEN c BETWEEN 1 AND 4 THEN NULL ELSE c END AS recorded, total FROM u""")
def completeness(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("size")).join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return ag.completeness(rows, {"quality": F.col("quality").isNotNull(), "toxic": F.col("toxic") == 1, "long": F.col("size") >= 20000}, ["lang"])


_PRED = "CASE WHEN n_chars < 300 THEN 'NEEDS_REVIEW' WHEN n_chars % 7 = 0 THEN 'NOT_PROVIDED' ELSE 'KNOWN' END"
_REF = "CASE WHEN quality = 1 THEN 'KNOWN' ELSE 'NOT_PROVIDED' END"


@query(f"""
WITH r AS (SELECT lang, {_PRED} AS p, {_REF} AS f, toxic = 0 AS same FROM documents JOIN labels USING (doc_id)),
o AS (SELECT *, CASE WHEN p = 'NEEDS_REVIEW' THEN 'a_revoir' WHEN f = 'KNOWN' AND p = 'KNOWN' THEN CASE WHEN same THEN 'correct' ELSE 'erreur_silencieuse' END WHEN f = 'KNOWN' THEN 'manque'
 WHEN p = 'KNOWN' THEN 'erreur_silencieuse' WHEN p = f THEN 'correct' ELSE 'statut_different' END AS o FROM r)
SELECT lang, count(*) AS fields, CAST(count_if(o = 'correct') AS BIGINT) AS correct, CAST(count_if(o = 'a_revoir') AS BIGINT) AS a_revoir, CAST(count_if(o = 'statut_different') AS BIGINT) AS statut_different, CAST(count_if(o = 'manque') AS BIGINT) AS manque, CAST(count_if(o = 'erreur_silencieuse') AS BIGINT) AS erreur_silencieuse,
 round_even(count_if(o = 'correct') / count(*), 3) AS accuracy, round_even(count_if(o = 'correct' AND f = 'KNOWN') / nullif(count_if(f = 'KNOWN'), 0), 3) AS known_accuracy, round_even(count_if(o = 'a_revoir') / count(*), 3) AS review_share,
 round_even(count_if(o = 'correct' AND p <> 'NEEDS_REVIEW') / nullif(count_if(p <> 'NEEDS_REVIEW'), 0), 3) AS auto_accuracy FROM o GROUP BY 1""")
def eval_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("lang", F.expr(_PRED).alias("pred_status"), F.expr(_REF).alias("ref_status"), (F.col("toxic") == 0).alias("same"))
    return ag.evaluation_summary(rows.withColumn("outcome", ag.outcome(F.col("pred_status"), F.col("ref_status"), F.col("same"))), ["lang"])


@query("""
WITH w AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT word, count(*) AS n_groups FROM w GROUP BY 1 HAVING count(*) >= 5""")
def doc_frequency_words(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return ag.document_frequency(docs, F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), "source", 5)


_PREFIXES = ["ver", "ent", "sch", "the", "que", "mie", "ion", "her"]
_VOCABULARY = ["the", "and", "of", "de", "la", "der", "die", "und", "que", "les", "en", "to"]


@query(f"""
WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT doc_id, CAST(len(list_filter({_PREFIXES}, lambda p: len(list_filter(w, lambda x: starts_with(x, p))) > 0)) AS BIGINT) AS n_prefixes, CAST(len(list_intersect(w, {_VOCABULARY})) AS BIGINT) AS n_known FROM w)
SELECT *, n_prefixes >= 3 OR (n_prefixes >= 1 AND n_known >= 5) AS accepted FROM c""")
def gate_domain_words(spark, sf_dir):
    return ag.domain_gate(read(spark, sf_dir, "documents"), "doc_id", F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), _PREFIXES, _VOCABULARY)


@query("""
WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY md5('s' || event_id), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id, value FROM r WHERE r <= ceil(n * 0.05)""")
def stratified_sample_hash(spark, sf_dir):
    return ag.stratified_sample(read(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "event_id", 0.05, "s")


@query("""
WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical, count(*) OVER (PARTITION BY text) AS n_same FROM documents) SELECT * FROM g WHERE n_same > 1""")
def conflict_groups(spark, sf_dir):
    return ag.conflict_groups(read(spark, sf_dir, "documents"), F.col("text"), "doc_id")


# ---------------------------------------------------------------- windows


@query("""
WITH n AS (SELECT user_id, event_id, value, lag(value) OVER w AS before_value, lead(value) OVER w AS after_value FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT * FROM n WHERE (value - before_value) * (value - after_value) > 0 AND least(abs(value - before_value), abs(value - after_value)) > 50""")
def spike_two_neighbours(spark, sf_dir):
    return wd.spikes(read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", 50).drop("ts")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_shipdate AS DATE) AS d, lag(CAST(l_shipdate AS DATE)) OVER w AS prev FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)),
v AS (SELECT *, coalesce(d <= prev, false) AS violates FROM p)
SELECT l_orderkey, l_linenumber, CAST(d AS VARCHAR) AS d, CAST(prev AS VARCHAR) AS previous, violates, violates OR coalesce(lead(violates) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice), false) AS doubtful FROM v""")
def order_violations(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.to_date("l_shipdate").alias("d"))
    out = wd.order_violations(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], "d").drop("l_partkey", "l_extendedprice")
    return out.withColumn("d", F.col("d").cast("string")).withColumn("previous", F.col("previous").cast("string"))


@query("""
WITH p AS (SELECT user_id, event_id, value, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS t FROM events), n AS (SELECT user_id, event_id, value, lag(value) OVER w AS previous, (t - lag(t) OVER w) / 3600 AS elapsed FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, value, previous, round(elapsed, 6) AS elapsed FROM n WHERE abs(value - previous - elapsed) > 80""")
def delta_vs_elapsed(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "value", seconds().alias("t"))
    return wd.delta_vs_elapsed(rows, ["user_id"], ["t", "event_id"], "value", F.col("t").cast("double"), 3600, 80).drop("t").withColumn("elapsed", F.round("elapsed", 6))


@query("""
WITH r AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, day, event_type, value FROM r WHERE r = 1""")
def merge_same_key_newest(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return wd.newest_of_same_key(rows, ["user_id", "day", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "day", "event_type", "value")


@query("SELECT user_id, count(*) AS n_points, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS change FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def first_last_change(spark, sf_dir):
    return wd.first_last_change(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@query("""
WITH s AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE']) AS c_mktsegment), r AS (SELECT c_nationkey, c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
SELECT n_nationkey, s.c_mktsegment, c_custkey AS latest, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_acctbal < 5000 THEN 'review' ELSE 'done' END AS state FROM nation CROSS JOIN s LEFT JOIN (SELECT * FROM r WHERE r = 1) x ON x.c_nationkey = n_nationkey AND x.c_mktsegment = s.c_mktsegment""")
def booklet_state(spark, sf_dir):
    """For every nation and segment of a fixed list, the latest customer and its state."""
    rows = read(spark, sf_dir, "customer")
    latest = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.max_by(F.struct("c_custkey", "c_acctbal"), F.struct("c_acctbal", -F.col("c_custkey"))).alias("m"))
    positions = F.explode(F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"]))).alias("c_mktsegment")
    domain = read(spark, sf_dir, "nation").select("n_nationkey", positions)
    out = domain.join(latest, (F.col("n_nationkey") == latest["c_nationkey"]) & (domain["c_mktsegment"] == latest["c_mktsegment"]), "left")
    return out.select("n_nationkey", domain["c_mktsegment"], F.col("m.c_custkey").alias("latest"), F.when(F.col("m").isNull(), "missing").when(F.col("m.c_acctbal") < 5000, "review").otherwise("done").alias("state"))


@query("""
WITH f AS (SELECT conv_id, turn, role, min(turn) OVER (PARTITION BY conv_id, role) AS f FROM conversations) SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY f, role, turn) AS number FROM f""")
def section_numbering(spark, sf_dir):
    return wd.numbered_by_section(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "role", "turn").withColumn("number", F.col("number").cast("bigint"))


@query("""
WITH c AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM c)
SELECT user_id, run, event_type, count(*) AS n_rows, min(ts) AS first_at FROM r GROUP BY ALL""")
def gaps_islands(spark, sf_dir):
    return wd.runs(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
WITH c AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c)
SELECT conv_id, run, role, count(*) AS n_rows, min(turn) AS first_at FROM r GROUP BY ALL""")
def gaps_islands_roles(spark, sf_dir):
    return wd.runs(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")


@query("""
WITH t AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, event_id FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 7200 THEN 0 ELSE 1 END AS n FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n, min(t) AS begin_s, max(t) AS end_s FROM s GROUP BY ALL""")
def session_2h(spark, sf_dir):
    return wd.sessions(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", seconds(), 7200, "event_id")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS t, event_id FROM events),
k AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY ALL UNION ALL SELECT k.user_id, k.event_type, (SELECT min(e.t) FROM e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.t - k.t > 86400) FROM k WHERE k.t IS NOT NULL)
SELECT k.user_id, k.event_type, k.t AS at_s, min(e.event_id) AS event_id FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.t = k.t WHERE k.t IS NOT NULL GROUP BY ALL""")
def dedup_ttl(spark, sf_dir):
    return wd.first_sightings(read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], seconds(), 86400, "event_id")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders) SELECT * FROM r WHERE place <= 3""")
def topn_per_group(spark, sf_dir):
    return wd.top_n(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("""
WITH b AS (SELECT o_orderkey, o_orderpriority, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) AS p, o_totalprice FROM orders) SELECT o_orderkey, o_orderpriority, o_totalprice FROM b WHERE p > 0 ORDER BY p, o_totalprice DESC, o_orderkey LIMIT 100""")
def sort_bucket(spark, sf_dir):
    """The 100 first orders by priority, then price: a top-k report."""
    rank = F.array_position(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM"])), F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").where(rank > 0).orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority", "o_totalprice")


# ---------------------------------------------------------------- joins


@query("""
WITH v AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'view'), p AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'purchase')
SELECT v.user_id, v.event_id, v.t, CAST(min(p.t) AS VARCHAR) AS next_at, CASE WHEN min(p.t) IS NULL THEN 'none' WHEN (min(p.t) - v.t) / 86400000.0 > 3 THEN 'late' ELSE 'in time' END AS came FROM v LEFT JOIN p ON p.user_id = v.user_id AND p.t > v.t GROUP BY v.user_id, v.event_id, v.t""")
def asof_next_event(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", millis().alias("t"))
    out = jn.next_after(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'purchase'").select("user_id", "t"), "user_id", "t", "t")
    return out.withColumn("came", F.when(F.col("next_at").isNull(), "none").when((F.col("next_at") - F.col("t")) / 86_400_000 > 3, "late").otherwise("in time")).withColumn("next_at", F.col("next_at").cast("string"))


@query("""
WITH c AS (SELECT c_custkey, translate(regexp_replace(upper('AMN-' || (c_custkey % 9973)), '[^A-Z0-9]', '', 'g'), 'OQDILSZBG', '000115286') AS a FROM customer), s AS (SELECT s_suppkey, translate(regexp_replace(upper('AMN-' || (s_suppkey * 13 % 9973)), '[^A-Z0-9]', '', 'g'), 'OQDILSZBG', '000115286') AS b FROM supplier)
SELECT c_custkey, s_suppkey, CAST(levenshtein(a, b) AS INT) AS distance FROM c, s WHERE levenshtein(a, b) <= 1""")
def linkage_edit1(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("AMN-"), F.expr("cast(c_custkey % 9973 as string)")).alias("code"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("AMN-"), F.expr("cast(s_suppkey * 13 % 9973 as string)")).alias("code"))
    return jn.within_one_edit(c, s, "code", "code", ("c_custkey", "s_suppkey"))


@query("""
WITH d AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: length(x) >= 10)) AS w FROM documents), b AS (SELECT DISTINCT item_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: length(x) >= 10)) AS w FROM benchmark),
c AS (SELECT doc_id, item_id, count(*) AS n FROM d JOIN b USING (w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id) AS r FROM c WHERE n >= 3) SELECT doc_id, item_id, n AS n_common FROM r WHERE r = 1""")
def label_overlap_argmax(spark, sf_dir):
    """The benchmark item that shares most long words with each document, three at least."""
    words = lambda t: F.explode(F.filter(F.split(F.regexp_replace(F.lower(t), "[^a-z]+", " "), " "), lambda w: F.length(w) >= 10)).alias("w")
    return jn.overlap_argmax(read(spark, sf_dir, "documents").select("doc_id", words("text")), read(spark, sf_dir, "benchmark").select("item_id", words("text")), "doc_id", "item_id", "w", 3, "item_id")


@query("""
SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice < 1000 THEN 'a' WHEN p_retailprice < 1200 THEN 'b' WHEN p_retailprice < 1500 THEN 'c' ELSE 'd' END AS name FROM part WHERE p_retailprice >= 900 AND p_retailprice < 2000""")
def interval_cell_join(spark, sf_dir):
    return jn.interval_join(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", [900.0, 1000.0, 1200.0, 1500.0, 2000.0], ["a", "b", "c", "d"])


@query("""
WITH v AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'), l AS (SELECT user_id, value, max(event_id) AS k FROM events WHERE event_type = 'view' GROUP BY ALL),
j AS (SELECT v.event_id, v.user_id, v.value, l.value AS x, CAST(l.k AS VARCHAR) AS k FROM v ASOF JOIN l ON v.user_id = l.user_id AND v.value >= l.value) SELECT event_id, user_id, value, k AS label, round(value - x, 6) AS distance FROM j WHERE value - x <= 12""")
def nearest_left_match(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    labels = e.where("event_type = 'view'").groupBy("user_id", "value").agg(F.max("event_id").alias("k"))
    out = jn.nearest_left(e.where("event_type = 'purchase'").drop("event_type"), labels, "user_id", "value", 12, "k")
    return out.withColumn("distance", F.round("distance", 6))


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def anti_missing(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
WITH b AS (SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM benchmark), d AS (SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM documents) SELECT w FROM d SEMI JOIN b USING (w) WHERE w <> ''""")
def semi_known_words(spark, sf_dir):
    words = lambda name: read(spark, sf_dir, name).select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")).alias("w")).where("w <> ''").distinct()
    return words("documents").join(words("benchmark"), "w", "left_semi")


_ORDER_PARTS = """
o AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_orderkey, l_partkey, q, p_name, p_type FROM o JOIN part ON p_partkey = l_partkey)"""


def _order_parts(spark, sf_dir):
    """The parts of each order, once each: an order is a small page, and there are as many as the data has."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    return lines.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")


@query(f"""
WITH RECURSIVE {_ORDER_PARTS},
t AS (SELECT l_orderkey, l_partkey, q, [x FOR x IN list_distinct(string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' ')) IF x <> ''] AS w FROM l),
c AS (SELECT r.l_orderkey, r.l_partkey AS ref_id, p.l_partkey AS pred_id, CAST(len(list_intersect(r.w, p.w)) AS DOUBLE) AS c, CAST(len(r.w) AS DOUBLE) AS nr, CAST(len(p.w) AS DOUBLE) AS np FROM t r JOIN t p ON p.l_orderkey = r.l_orderkey AND r.q <= 25 AND p.q > 25),
s AS (SELECT l_orderkey, ref_id, pred_id, c / nr - CAST(0.1 AS DOUBLE) * (np - c) / np AS score FROM c WHERE c > 0 AND c / nr >= 0.5),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, pred_id, ref_id) AS n FROM s),
g AS (
  SELECT l_orderkey, n, ref_id, pred_id, score, [ref_id] AS rs, [pred_id] AS ps FROM n WHERE n = 1
  UNION ALL
  SELECT l_orderkey, n, ref_id, pred_id, score, list_append(rs, ref_id), list_append(ps, pred_id) FROM (
    SELECT n.*, g.rs, g.ps, row_number() OVER (PARTITION BY n.l_orderkey ORDER BY n.n) AS k FROM n JOIN g ON g.l_orderkey = n.l_orderkey AND n.n > g.n WHERE NOT list_contains(g.rs, n.ref_id) AND NOT list_contains(g.ps, n.pred_id)) WHERE k = 1)
SELECT l_orderkey, ref_id, pred_id, round(score, 6) AS score FROM g""")
def greedy_match(spark, sf_dir):
    """One-to-one matches within an order of its small lines with its large ones, by the words of their parts."""
    lines = _order_parts(spark, sf_dir).withColumn("tokens", tf.tokens(F.concat_ws(" ", "p_name", "p_type")))
    refs = lines.where("q <= 25").select("l_orderkey", F.col("l_partkey").alias("ref_id"), F.col("l_partkey").alias("ref_order"), "tokens")
    preds = lines.where("q > 25").select("l_orderkey", F.col("l_partkey").alias("pred_id"), F.col("l_partkey").alias("pred_order"), "tokens")
    return jn.greedy_match(refs, preds, "l_orderkey").withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- scalar functions


@query(r"""SELECT conv_id, turn, trim(regexp_replace(lower(regexp_replace(strip_accents(replace(replace(replace(replace(text, 'œ', 'oe'), 'Œ', 'Oe'), 'æ', 'ae'), 'Æ', 'Ae')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9/?]+', ' ', 'g')) AS folded FROM conversations""")
def fold_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tf.fold(F.col("text")).alias("folded"))


@query()
def fold_text_exact(spark, sf_dir):
    """The full Unicode form of fold_text."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tf.fold_exact(F.col("text")).alias("folded"))


_LABELS = ["Date de naissance", "Poids (kg)", "Âge gestationnel", "Périmètre crânien", "Sexe", "Nombre d''enfants", "Profession", "Blood group"]
_KIND_SQL = " ".join(f"WHEN regexp_matches(f, '{rule}') THEN '{kind}'" for kind, rule in tf.KIND_RULES)


@query(f"""
WITH l AS (SELECT o_orderkey, list_extract([{", ".join(f"'{x}'" for x in _LABELS)}], CAST(o_orderkey % 8 AS INT) + 1) AS label FROM orders), f AS (SELECT *, trim(regexp_replace(lower(strip_accents(label)), '[^a-z0-9/?]+', ' ', 'g')) AS f FROM l)
SELECT o_orderkey, label, CASE {_KIND_SQL} ELSE 'text' END AS kind FROM f""")
def infer_kind(spark, sf_dir):
    label = F.get(F.array(*[F.lit(x.replace("''", "'")) for x in _LABELS]), F.expr("cast(o_orderkey % 8 as int)"))
    return read(spark, sf_dir, "orders").select("o_orderkey", label.alias("label")).withColumn("kind", tf.infer_kind(F.col("label")))


_WORDS = ["Neg", "++", "traces", "non immunisée", "oui", "RAS", "positif", "absent", "Aucune", "autre"]


@query(f"""
WITH w AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'toxo' ELSE 'oedema' END AS measure, list_extract([{", ".join(f"'{x}'" for x in _WORDS)}], CAST(event_id % 10 AS INT) + 1) AS written FROM events), f AS (SELECT *, trim(regexp_replace(lower(strip_accents(written)), '[^a-z0-9/?]+', ' ', 'g')) AS t FROM w)
SELECT event_id, measure, written, CASE WHEN measure = 'toxo' AND contains(t, 'non immun') THEN 'non_immune' WHEN measure = 'toxo' AND contains(t, 'immun') THEN 'immune' WHEN regexp_full_match(t, 'neg\\w*|0|absent\\w*') THEN 'neg'
 WHEN regexp_full_match(t, 'pos\\w*|present\\w*') OR regexp_full_match(written, '\\+{{1,4}}') THEN 'pos' WHEN contains(t, 'trace') THEN 'traces' WHEN t IN ('oui', 'yes', 'o') THEN 'yes' WHEN regexp_full_match(t, 'non|no|aucun\\w*|ras|n') THEN 'no' END AS code FROM f""")
def category_code(spark, sf_dir):
    written = F.get(F.array(*map(F.lit, _WORDS)), F.expr("cast(event_id % 10 as int)"))
    rows = read(spark, sf_dir, "events").select("event_id", F.expr("case when event_id % 2 = 0 then 'toxo' else 'oedema' end").alias("measure"), written.alias("written"))
    return rows.withColumn("code", vf.category(F.col("measure"), F.col("written")))


@query("""
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d - %m - %y') WHEN 2 THEN strftime(o_orderdate, '%m.%Y') ELSE strftime(o_orderdate, '31/%m/%Y') END AS written, o_orderdate AS d FROM orders)
SELECT o_orderkey, written, CASE o_orderkey % 4 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN '20' || strftime(d, '%y-%m-%d') WHEN 2 THEN strftime(d, '%Y-%m') ELSE CAST(CAST(try_strptime(written, '%d/%m/%Y') AS DATE) AS VARCHAR) END AS value,
 CASE o_orderkey % 4 WHEN 2 THEN 'month' ELSE 'day' END AS precision, CASE o_orderkey % 4 WHEN 3 THEN try_strptime(written, '%d/%m/%Y') IS NOT NULL ELSE true END AS ok FROM d""")
def parse_date_multi(spark, sf_dir):
    written = F.expr("case o_orderkey % 4 when 0 then date_format(o_orderdate, 'dd/MM/yyyy') when 1 then date_format(o_orderdate, 'dd - MM - yy') when 2 then date_format(o_orderdate, 'MM.yyyy') else date_format(o_orderdate, \"'31/'MM/yyyy\") end")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return rows.withColumn("p", vf.parse_date(F.col("written"))).select("o_orderkey", "written", "p.value", "p.precision", "p.ok")


@query("""
WITH w AS (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS i, CASE p_partkey % 3 WHEN 0 THEN CAST(floor(p_retailprice) AS BIGINT) // 1000 || ' ' || lpad(CAST(CAST(floor(p_retailprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || ' g' WHEN 1 THEN (p_partkey % 90) || ',5 cm' ELSE 'none' END AS written FROM part)
SELECT p_partkey, written, CASE p_partkey % 3 WHEN 0 THEN CAST(i AS DOUBLE) WHEN 1 THEN p_partkey % 90 + 0.5 END AS n FROM w""")
def parse_number(spark, sf_dir):
    i = "cast(floor(p_retailprice) as bigint)"
    written = F.expr(f"case p_partkey % 3 when 0 then ({i} div 1000) || ' ' || lpad(cast({i} % 1000 as string), 3, '0') || ' g' when 1 then (p_partkey % 90) || ',5 cm' else 'none' end")
    return read(spark, sf_dir, "part").select("p_partkey", written.alias("written")).withColumn("n", vf.first_number(F.col("written")))


@query("""
WITH w AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 90) || ',4 kg' WHEN 1 THEN (2000 + event_id % 6000) || ' g' WHEN 2 THEN '' || (event_id % 120) ELSE (event_id % 12) || '.25' END AS written, CASE event_id % 3 WHEN 0 THEN 'Poids (kg)' ELSE 'Poids' END AS label FROM events),
n AS (SELECT *, CASE event_id % 4 WHEN 0 THEN event_id % 90 + 0.4 WHEN 1 THEN 2000 + event_id % 6000 WHEN 2 THEN event_id % 120 ELSE event_id % 12 + 0.25 END::DOUBLE AS n, event_id % 4 = 0 AS kg, event_id % 3 = 0 AS kgl FROM w),
g AS (SELECT *, CASE WHEN kg OR n < 10 OR (kgl AND NOT event_id % 4 = 1) THEN n * 1000 ELSE n END AS g FROM n)
SELECT event_id, written, label, CAST(round_even(g, 0) AS INT) AS value, CASE WHEN kgl OR (kg AND n >= 25) THEN g BETWEEN 25000 AND 250000 ELSE g BETWEEN 300 AND 7000 END AS ok FROM g""")
def weight_units(spark, sf_dir):
    written = F.expr("case event_id % 4 when 0 then (event_id % 90) || ',4 kg' when 1 then (2000 + event_id % 6000) || ' g' when 2 then '' || (event_id % 120) else (event_id % 12) || '.25' end")
    rows = read(spark, sf_dir, "events").select("event_id", written.alias("written"), F.expr("case event_id % 3 when 0 then 'Poids (kg)' else 'Poids' end").alias("label"))
    return rows.withColumn("w", vf.weight_grams(F.col("written"), F.col("label"))).select("event_id", "written", "label", "w.value", "w.ok")


@query("""
WITH w AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'TA ' || (90 + event_id % 80) || '/' || (50 + event_id % 50) WHEN 1 THEN (10 + event_id % 8) || ',5 / ' || (5 + event_id % 6) ELSE '' || event_id END AS written FROM events)
SELECT event_id, written, CAST(CASE event_id % 3 WHEN 0 THEN 90 + event_id % 80 WHEN 1 THEN (10 + event_id % 8) * 10 + 5 END AS INT) AS sys, CAST(CASE event_id % 3 WHEN 0 THEN 50 + event_id % 50 WHEN 1 THEN (5 + event_id % 6) * 10 END AS INT) AS dia FROM w""")
def bp_parse(spark, sf_dir):
    written = F.expr("case event_id % 3 when 0 then 'TA ' || (90 + event_id % 80) || '/' || (50 + event_id % 50) when 1 then (10 + event_id % 8) || ',5 / ' || (5 + event_id % 6) else '' || event_id end")
    rows = read(spark, sf_dir, "events").select("event_id", written.alias("written"))
    return rows.withColumn("bp", vf.blood_pressure(F.col("written"))).select("event_id", "written", F.col("bp.sys").alias("sys"), F.col("bp.dia").alias("dia"))


@query(r"""
WITH v AS (SELECT conv_id, turn, trim(text) AS v FROM conversations) SELECT conv_id, turn, coalesce(v <> '' AND (regexp_matches(v, '(?i)^\s*(c\s*\.?\s*i\s*\.?\s*n|cni|c\W{0,2}m)\s*[:;.]') OR regexp_matches(replace(v, '/', 'x'), '(?:\+?\d[\s.-]?){9,}') OR regexp_matches(upper(v), '\b[A-Z]{1,2}\s?\d{5,7}\b')), false) AS personal FROM v""")
def pii_shape(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(tf.has_personal_shape(F.col("text")), F.lit(False)).alias("personal"))


@query()
def pii_rule(spark, sf_dir):
    """The whole cascade on labels and values, Arabic similarity included."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tf.is_personal(F.col("role"), F.col("text")).alias("personal"))


@query("SELECT c_custkey, '***' || right(c_name, 4) AS masked, regexp_replace(trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9/?]+', ' ', 'g')), '[^a-z0-9]+', '_', 'g')[1:60] AS slug FROM customer")
def mask_tail_slug(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", tf.mask_tail(F.col("c_name")).alias("masked"), tf.slug(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("slug"))


@query()
def similarity_ratio(spark, sf_dir):
    """Similarity of each part's name in an order with the name of the part before it there."""
    before = Window.partitionBy("l_orderkey").orderBy("l_partkey")
    rows = _order_parts(spark, sf_dir).select("l_orderkey", "l_partkey", F.lag("l_partkey").over(before).alias("other"), "p_name", F.lag("p_name").over(before).alias("other_name"))
    return rows.where("other is not null").select("l_orderkey", "l_partkey", "other", F.round(tf.similarity("other_name", "p_name"), 6).alias("ratio"))


# ---------------------------------------------------------------- shapes


@query("""
WITH o AS (SELECT DISTINCT p_type FROM part), g AS (SELECT p_brand, list(DISTINCT p_type) AS l FROM part WHERE p_size <= 5 GROUP BY 1) SELECT p_brand, p_type, list_contains(l, p_type) AS ticked FROM g CROSS JOIN o""")
def explode_options(spark, sf_dir):
    """A row for each option of a group, ticked or not; the options are the types there are."""
    part = read(spark, sf_dir, "part")
    options = part.agg(F.collect_set("p_type").alias("options"))
    ticked = part.where("p_size <= 5").groupBy("p_brand").agg(F.collect_set("p_type").alias("l"))
    return ticked.join(F.broadcast(options)).select("p_brand", "l", F.explode("options").alias("p_type")).select("p_brand", "p_type", F.array_contains("l", F.col("p_type")).alias("ticked"))  # one row of options


@query("SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS value, bool_or(p_size IS NULL) AS doubtful FROM part WHERE p_size <= 5 GROUP BY 1")
def collapse_options(spark, sf_dir):
    rows = read(spark, sf_dir, "part").where("p_size <= 5")
    return rows.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ", ").alias("value"), F.bool_or(F.col("p_size").isNull()).alias("doubtful"))


@query("""
WITH l AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, day, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'view') AS view FROM l WHERE r = 1 AND event_type IN ('click', 'purchase', 'view') GROUP BY ALL""")
def pivot_series(spark, sf_dir):
    """Long cells to one row per visit, the last cell of a measure wins; columns from a fixed list, so one pass."""
    rows = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    last = lambda m: F.max_by(F.when(F.col("event_type") == m, F.col("value")), F.when(F.col("event_type") == m, F.struct("ts", "event_id"))).alias(m)
    return rows.where(F.col("event_type").isin("click", "purchase", "view")).groupBy("user_id", "day").agg(last("click"), last("purchase"), last("view"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '^The ') THEN 'the' WHEN regexp_matches(text, '^[A-Z]{2}') THEN 'capitals' WHEN regexp_matches(text, '[#*$%&|]') THEN 'symbols' WHEN regexp_matches(text, '^.{0,20}\\.') THEN 'short start' END AS rule FROM documents""")
def rule_first_match(spark, sf_dir):
    rules = [("the", "^The "), ("capitals", "^[A-Z]{2}"), ("symbols", "[#*$%&|]"), ("short start", r"^.{0,20}\.")]
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.col("text").rlike(rule), name).otherwise(out)
    return read(spark, sf_dir, "documents").select("doc_id", out.alias("rule"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN NOT l_quantity BETWEEN 2 AND 48 THEN 'format' END, CASE WHEN l_discount >= 0.1 THEN 'discount' END, CASE WHEN l_extendedprice / l_quantity > 2000 THEN 'unit_price' END]) AS code FROM lineitem) SELECT * FROM v WHERE code IS NOT NULL""")
def dq_ranges(spark, sf_dir):
    """All violations of a row in one pass, no union of scans."""
    codes = F.array_compact(F.array(F.when(~F.col("l_quantity").between(2, 48), "format"), F.when(F.col("l_discount") >= 0.1, "discount"), F.when(F.col("l_extendedprice") / F.col("l_quantity") > 2000, "unit_price")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(codes).alias("code"))


@query("""
SELECT l_orderkey, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS returned, CAST(count_if(l_returnflag = 'N') AS BIGINT) AS kept FROM lineitem GROUP BY 1 HAVING count_if(l_returnflag = 'R') > 0 AND count_if(l_returnflag = 'N') > 0""")
def dq_exclusive(spark, sf_dir):
    both = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_returnflag") == "N").alias("kept"))
    return both.where("returned > 0 and kept > 0")


@query("""
WITH s AS (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) SELECT o_orderkey, n, total, o_totalprice FROM orders JOIN s ON o_orderkey = l_orderkey WHERE total > o_totalprice""")
def dq_sum(spark, sf_dir):
    sums = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    o = read(spark, sf_dir, "orders")
    return o.join(sums, o["o_orderkey"] == sums["l_orderkey"]).where("total > o_totalprice").select("o_orderkey", "n", "total", "o_totalprice")


@query("""
WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1), d AS (SELECT o_custkey, CAST(last AS DATE) + 28 AS due FROM l), f AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2001-01-15 09:00:00') - epoch_us(CAST(due AS TIMESTAMP)) - 43200000000) / 86400000000.0) AS INT) AS days_late FROM d)
SELECT o_custkey, CAST(due AS VARCHAR) AS due, days_late, CASE WHEN days_late > 30 THEN 'LOST' WHEN days_late > 0 THEN 'LATE' WHEN days_late >= -7 THEN 'SOON' ELSE 'LATER' END AS bucket FROM f""")
def due_bucket(spark, sf_dir):
    last = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    rows = last.select("o_custkey", F.date_add(F.to_date("last"), 28).alias("due")).withColumn("days_late", vf.days_late(F.lit("2001-01-15 09:00:00").cast("timestamp"), F.col("due")))
    return rows.select("o_custkey", F.col("due").cast("string").alias("due"), "days_late", vf.due_bucket(F.col("days_late")).alias("bucket"))


_NEXT = {"view": ["click", "view", "purchase"], "click": ["purchase", "click", "view"], "purchase": ["view", "signup"], "signup": ["view"], "error": ["view", "error"]}


@query("""
WITH p AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
SELECT * FROM p WHERE from_state IS NOT NULL AND NOT CASE from_state WHEN 'view' THEN to_state IN ('click', 'view', 'purchase') WHEN 'click' THEN to_state IN ('purchase', 'click', 'view') WHEN 'purchase' THEN to_state IN ('view', 'signup') WHEN 'signup' THEN to_state IN ('view') WHEN 'error' THEN to_state IN ('view', 'error') ELSE false END""")
def state_illegal(spark, sf_dir):
    return lc.illegal_moves(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", _NEXT).select("user_id", "event_id", "from_state", "to_state")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY 1")
def state_current(spark, sf_dir):
    return lc.current_state(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
SELECT doc_id, 'both' AS part FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unlabelled' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def setops(spark, sf_dir):
    d, lab = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    return d.intersect(lab).withColumn("part", F.lit("both")).union(d.subtract(lab).withColumn("part", F.lit("unlabelled")))


@query("""
SELECT o_orderkey, count(*) AS n_lines, string_agg(l_linenumber || ':' || CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' ORDER BY l_linenumber, l_quantity) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def nested_document(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("a"))
    doc = read(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    shown = F.transform("a", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_quantity"].cast("int").cast("string")))
    return doc.select("o_orderkey", F.size("a").cast("bigint").alias("n_lines"), F.array_join(shown, ",").alias("lines"))


@query("SELECT o_orderkey, CAST((o_orderkey - 1) // 8 AS INT) + 1 AS booklet, CAST((o_orderkey - 1) % 8 AS INT) + 1 AS position FROM orders WHERE o_orderkey >= 1")
def booklet_position(spark, sf_dir):
    patient, position = fm.booklet_position(F.col("o_orderkey"))
    return read(spark, sf_dir, "orders").where("o_orderkey >= 1").select("o_orderkey", patient.alias("booklet"), position.alias("position"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE contains(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), 'MER123') OR levenshtein(translate(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), 'OQDILSZBG', '000115286'), translate('CUSTOMER000000123', 'OQDILSZBG', '000115286')) <= 1
 OR contains(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), 'CUSTOMER000000123')""")
def search_codes(spark, sf_dir):
    """Customers found by a code or what looks like it."""
    c = read(spark, sf_dir, "customer")
    return c.where(rd.search_match(F.col("c_name"), F.lit("Customer#000000123")) | jn.normalized_code(F.col("c_name"), True).contains("MER123")).select("c_custkey", "c_name")


@query("""
WITH v AS (SELECT event_id, list_extract(['RAS', 'néant', 'Normal', 'asthme', '0', '-', 'diabète', 'aucune'], CAST(event_id % 8 AS INT) + 1) AS v FROM events) SELECT event_id, v FROM v WHERE lower(v) NOT IN ('ras', 'aucun', 'aucune', 'néant', 'neant', 'rien', 'normal', 'non', '-', '0')""")
def noteworthy_filter(spark, sf_dir):
    v = F.get(F.array(*map(F.lit, ["RAS", "néant", "Normal", "asthme", "0", "-", "diabète", "aucune"])), F.expr("cast(event_id % 8 as int)"))
    return read(spark, sf_dir, "events").select("event_id", v.alias("v")).where(rd.noteworthy(F.col("v")))


@query("""
WITH w AS (SELECT event_id, list_extract(['integer', 'weight', 'weight', 'date', 'checkbox', 'text'], CAST(event_id % 6 AS INT) + 1) AS kind, CASE event_id % 6 WHEN 0 THEN (event_id % 50) || ' ans' WHEN 1 THEN (event_id % 90 + 10) || ',5 kg' WHEN 2 THEN '' || (event_id % 600) WHEN 3 THEN (event_id % 28 + 1) || '/' || (event_id % 12 + 1) || '/2024' WHEN 4 THEN 'oui' ELSE '-' END AS written FROM events)
SELECT event_id, kind, written, CASE event_id % 6 WHEN 0 THEN '' || (event_id % 50) WHEN 1 THEN '' || ((event_id % 90 + 10) * 1000 + 500) WHEN 2 THEN '' || CASE WHEN event_id % 600 < 300 THEN (event_id % 600) * 1000 ELSE event_id % 600 END WHEN 3 THEN '2024-' || lpad('' || (event_id % 12 + 1), 2, '0') || '-' || lpad('' || (event_id % 28 + 1), 2, '0') WHEN 4 THEN 'true' END AS value,
 CASE event_id % 6 WHEN 5 THEN 'NOT_PROVIDED' ELSE 'KNOWN' END AS status FROM w""")
def typed_corrections(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ["integer", "weight", "weight", "date", "checkbox", "text"])), F.expr("cast(event_id % 6 as int)"))
    written = F.expr("case event_id % 6 when 0 then (event_id % 50) || ' ans' when 1 then (event_id % 90 + 10) || ',5 kg' when 2 then '' || (event_id % 600) when 3 then (event_id % 28 + 1) || '/' || (event_id % 12 + 1) || '/2024' when 4 then 'oui' else '-' end")
    rows = read(spark, sf_dir, "events").select("event_id", kind.alias("kind"), written.alias("written"))
    return rows.withColumn("t", dp.typed(F.col("kind"), F.col("written"))).select("event_id", "kind", "written", "t.value", "t.status")


@query("""
WITH c AS (SELECT o_orderkey, list_extract(['CAPTURED', 'NEEDS_REVIEW', 'VALIDATED', 'SYNC_FAILED', 'SYNCED', 'PROCESSING_FAILED'], CAST(o_orderkey % 6 AS INT) + 1) AS state FROM orders)
SELECT state, count(*) AS n, CASE state WHEN 'CAPTURED' THEN 0 WHEN 'PROCESSING_FAILED' THEN 1 WHEN 'NEEDS_REVIEW' THEN 2 WHEN 'VALIDATED' THEN 3 ELSE 4 END AS step,
 CASE state WHEN 'CAPTURED' THEN 'WAIT_NETWORK' WHEN 'NEEDS_REVIEW' THEN 'REVIEW' WHEN 'VALIDATED' THEN 'LINK' WHEN 'SYNCED' THEN 'NONE' ELSE 'RETRY' END AS action FROM c GROUP BY ALL""")
def step_progress(spark, sf_dir):
    state = F.get(F.array(*map(F.lit, ["CAPTURED", "NEEDS_REVIEW", "VALIDATED", "SYNC_FAILED", "SYNCED", "PROCESSING_FAILED"])), F.expr("cast(o_orderkey % 6 as int)"))
    n = read(spark, sf_dir, "orders").select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))
    return n.select("state", "n", rd.step_index(F.col("state")).alias("step"), lc.next_action(F.col("state"), F.lit(False)).alias("action"))


@query("""
WITH a AS (SELECT event_type, event_id, CASE event_id % 4 WHEN 0 THEN 'Casa' WHEN 1 THEN 'ILLEGIBLE' WHEN 2 THEN 'Rabat' ELSE 'EMPTY' END AS a, event_id % 3 AS v FROM events),
j AS (SELECT event_type, CASE WHEN a = 'ILLEGIBLE' THEN 'abstention' WHEN v = 0 THEN CASE WHEN a = 'EMPTY' THEN 'juste' ELSE 'fausse' END WHEN (v = 1 AND a = 'Casa') OR (v = 2 AND a = 'Rabat') THEN 'juste' ELSE 'fausse' END AS j FROM a)
SELECT event_type, count(*) AS n, CAST(count_if(j = 'juste') AS BIGINT) AS juste, CAST(count_if(j = 'fausse') AS BIGINT) AS fausse, CAST(count_if(j = 'abstention') AS BIGINT) AS abstention FROM j GROUP BY 1""")
def verdict_shares(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", F.expr("case event_id % 4 when 0 then 'Casa' when 1 then 'ILLEGIBLE' when 2 then 'Rabat' else 'EMPTY' end").alias("a"), F.expr("case event_id % 3 when 0 then cast(array() as array<string>) when 1 then array('casa') else array('Rabat ') end").alias("v"))
    return rd.verdict_shares(rows, "event_type", "a", "v")


@query("""
SELECT p_brand, median(p_size) AS median_size, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1""")
def median_and_bounds(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.percentile("p_size", F.lit(0.5)).alias("median_size"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("""
WITH c AS (SELECT c_nationkey, c_custkey, 's' || (c_custkey % 7) AS label, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 7 ORDER BY c_custkey) AS n FROM customer) SELECT c_nationkey, c_custkey, CASE WHEN n = 1 THEN label ELSE label || '_' || n END AS id FROM c""")
def unique_ids(spark, sf_dir):
    """Ids from labels, numbered from the second of a name."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page_id"), F.col("c_custkey").alias("ordinal"), F.expr("'s' || (c_custkey % 7)").alias("label"), F.col("c_custkey").cast("string").alias("value"), F.lit("KNOWN").alias("status"))
    return fm.deduplicated(rows).select(F.col("page_id").alias("c_nationkey"), F.col("ordinal").alias("c_custkey"), "id")


@query("""
WITH n AS (SELECT n_nationkey, s_suppkey, s_acctbal FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey) SELECT n_nationkey, count(s_suppkey) AS n_suppliers, coalesce(string_agg(s_suppkey, ',' ORDER BY s_acctbal, s_suppkey), '') AS suppliers FROM n GROUP BY 1""")
def snapshot_nested(spark, sf_dir):
    """Nations with their suppliers nested, grouped before the join."""
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_acctbal", "s_suppkey"))).alias("a"))
    n = read(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.select("n_nationkey", F.coalesce(F.size("a"), F.lit(0)).cast("bigint").alias("n_suppliers"), F.coalesce(F.array_join(F.transform("a", lambda x: x["s_suppkey"].cast("string")), ","), F.lit("")).alias("suppliers"))


# ---------------------------------------------------------------- Spark's own, beyond the form language


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extras_cube(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT event_type, epoch_us(date_trunc('hour', ts)) // 1000000 AS hour_s, count(*) AS n FROM events GROUP BY ALL")
def extras_tumbling(spark, sf_dir):
    w = read(spark, sf_dir, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.unix_timestamp("w.start").alias("hour_s"), "n")
