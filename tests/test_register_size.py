"""What the register's queries cost at size: what is compiled, what is shuffled, how often it is read."""

import re

from pyspark.sql import functions as F

from rosterlake.functions.text import fold, fold_text
from rosterlake.functions.values import day_of
from rosterlake.operators import quality as ql
from rosterlake.operators import series as sr
from rosterlake.plans import register
from tests.test_panels import FIELDS, cell

COMPILED = 8000  # bytes of a generated method, beyond which Java never compiles it


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df):
    return len(re.findall(r"(?<!Reused)Exchange hash", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]))


def largest_method(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", df.select("*")._jdf.queryExecution().explainString(mode))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_reading_values_is_compiled(spark, tmp_path):
    rows = spark.createDataFrame([cell("a", 0, "TA | x", "120/80")], FIELDS)
    assert largest_method(spark, sr.series_values(rows)) < COMPILED


def test_visits_find_their_values_without_another_shuffle(spark):
    rows = spark.createDataFrame([cell("a", 0, "TA | x", "120/80"), cell("a", 1, "Venue le | x", "2020-01-02"), cell("a", 2, "Venue le | x", "2020-01-03")], FIELDS)
    assert exchanges(sr.visits(sr.series_values(rows))) == 1
    got = [(r["col"], r["date"], r["date_key"]) for r in sr.visits(sr.series_values(rows)).collect()]
    assert got == [(1, "2020-01-03", "k2")]


def test_folding_and_days_are_as_before(spark):
    words = ["", " ", "Venue le", "T.A.", "Poids (kg)", "2ème trimestre - Visite 1", "ŒDÈMES", "ªº²", "ÿ?/", "وزن الأم", "a\tb\n\x7f!", "İ", "Straße", "K", None]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold(F.col("w")).alias("f"))
    assert {r["w"]: r["f"] for r in df.collect() if r["w"] not in (None, "Straße", "İ", "K")} == {w: fold_text(w) for w in words if w not in (None, "Straße", "İ", "K")}
    days = spark.createDataFrame([(2024, 2, 29), (2023, 2, 29), (999, 1, 1), (2020, 0, 1), (2020, 13, 1), (2020, None, 1), (None, 1, 1)], "y int, m int, d int")
    got = [r[0] for r in days.select(day_of(F.col("y"), F.col("m"), F.col("d")).cast("string")).collect()]
    assert got == ["2024-02-29", None, "0999-01-01", None, None, None, None]


def lines_read(spark, df):
    return len(re.findall(r"FileScan parquet [^\n]*l_orderkey", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]))


def test_appointments_read_the_lines_once(spark):
    assert lines_read(spark, register.register_appointments(spark, "/root/testdata/sf0.001")) == 1


def test_a_visit_keeps_the_appointment_of_the_one_before(spark):
    rows = [("p", "2020-01-01", "2020-01-20"), ("p", "2020-01-18", None), ("p", "2020-02-01", "2020-01-25"), ("p", "2020-02-10", "2020-03-01"), ("q", "2020-01-01", "2020-02-01"), (None, "2020-01-01", "2020-02-01")]
    visits = spark.createDataFrame(rows, "patient_id string, given_on string, appointment string")
    want = [tuple(r) for r in sr.appointments(visits, visits.select("patient_id", F.col("given_on").alias("seen_on"))).orderBy("patient_id", "given_on").collect()]
    got = [tuple(r) for r in sr.appointments_of_visits(visits).orderBy("patient_id", "given_on").collect()]
    assert got == want and [(r[1], str(r[3]), r[5], r[6]) for r in got if r[0] == "p"] == [("2020-01-01", "2020-01-18", "in time", False), ("2020-02-10", "None", None, True)]


def leaves(df):
    return len(re.findall(r"LogicalRDD|LocalRelation", plan(df)))


def test_rules_over_visits_and_due_dates_are_one_pass(spark):
    """All codes of a row come from one reading of it."""
    visits = spark.createDataFrame([("r", 0, "antenatal", k, d, a, g, f"d{k}", f"a{k}", f"g{k}") for k, d, a, g in [
        (1, "2020-01-01", "2020-02-01", 8), (2, None, "2020-03-01", 10), (3, "2020-01-20", "2020-01-20", 20), (4, "2020-01-10", None, 22), (5, "2031-01-01", None, 30)]] + [("r", 0, "postpartum_mother", 0, "2019-01-01", "2018-01-01", None, "m", "ma", None)],
        "record_id string, page_idx int, page_kind string, col int, date string, appointment string, gaWeeks int, date_key string, appointment_key string, ga_key string")
    facts = spark.createDataFrame([("r", 0, "antenatal", "edd", "e", "2020-10-01", None, None), ("s", 0, "antenatal", "lmp", "l", "2020-01-01", None, None), ("s", 0, "antenatal", "edd", "e", "2020-11-01", None, None)], "record_id string, page_idx int, page_kind string, name string, key string, day string, num double, word string")
    found = ql.visit_dates(visits, facts, "2021-01-01")
    assert leaves(found) == 2
    assert {(r["key"], r["code"]) for r in found.collect()} == {("a3", "appointment_before_visit"), ("d4", "date_order"), ("d5", "future")}
    due = ql.due_dates(facts)
    assert leaves(due) == 1 and {(r["record_id"], r["key"], r["code"]) for r in due.collect()} == {("s", "e", "edd_lmp"), ("s", "l", "edd_lmp")}


def test_boxes_that_exclude_each_other_are_read_once(spark):
    keys = ["mode_cesarienne_urgence", "mode_voie_basse_instrumentale", "nn_vivant", "nn_mort_ne", "lieu_domicile"]
    fields = spark.createDataFrame([("a", 1, "accouchement", i, k, k, "checkbox", "true", "KNOWN", "AI", None) for i, k in enumerate(keys)] + [("b", 1, "accouchement", 0, keys[0], "", "checkbox", "true", "KNOWN", "AI", None)], FIELDS)
    found = ql.exclusive(fields)
    assert leaves(found) == 1
    assert {(r["record_id"], r["key"], r["code"], r["params"]["with"]) for r in found.collect()} == {("a", k, c, c) for c, ks in (("two_modes", keys[:2]), ("alive_stillborn", keys[2:4])) for k in ks}


def test_profiles_deal_pages_not_fields(spark):
    """Which tests a page shows is summed up by page before pages meet their patients."""
    rows = spark.createDataFrame([cell("a", 0, "VIH | x", "neg"), cell("a", 1, "TA | x", "120/80"), cell("b", 0, "Ag HBs | x", None, status="NOT_PROVIDED"), cell("c", 0, "TA | x", None)], FIELDS)
    pages = spark.createDataFrame([("a", 0, "p", 1), ("b", 0, "p", 2), ("c", 0, "q", 1), ("d", 0, "s", 1)], "record_id string, page_idx int, patient_id string, created_at int")
    df = sr.profiles(rows, pages)
    got = {r["patient_id"]: (r["antenatal"], r["hiv"], r["syphilis"], r["hbs"]) for r in df.collect()}
    assert got == {"p": (True, "neg", None, "notRecorded"), "q": (True, None, None, None), "s": (False, None, None, None)}
    top = df._jdf.queryExecution().optimizedPlan().toString()
    joined = [x for x in re.findall(r"Join Inner[^\n]*\n((?:[^\n]*\n){2})", top) if "hiv_row" in x]
    assert joined and all("Aggregate [record_id" in x for x in joined)
