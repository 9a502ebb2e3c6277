from rosterlake.operators import series as sr
from rosterlake.plans import panels

FIELDS = "record_id string, page_idx int, page_type string, ordinal int, key string, label string, kind string, value string, status string, origin string, column int"
WOMEN = "antenatal boolean, systolic double, diastolic double, hemoglobin double, temperature double, firstGa double, n_visits int, mode string, place string, birthWeight double, gaAtBirth double, hiv string, syphilis string, hbs string, hcv string"


def cell(record, n, label, value, column=1, status="KNOWN"):
    return (record, 0, "grossesse_actuelle", n, f"k{n}", label, "text", value, status, "AI", column)


def test_a_missing_age_is_no_late_one(spark):
    """A patient without a written gestational age has no first one; one beyond 99 weeks counts as 99."""
    rows = [cell("a", 0, "TA | x", "120/80"), cell("b", 0, "Age probable | x", "20"), cell("b", 1, "Age probable | y", "12", 2), cell("c", 0, "Age probable | x", "120"), cell("d", 0, "Age probable | x", "11", status="NEEDS_REVIEW"), cell("d", 1, "TA | x", "110/70")]
    pages = spark.createDataFrame([(r, 0, r, 1) for r in "abcd"], "record_id string, page_idx int, patient_id string, created_at int")
    got = {r["patient_id"]: (r["firstGa"], r["n_visits"]) for r in sr.profiles(spark.createDataFrame(rows, FIELDS), pages).collect()}
    assert got == {"a": (None, 0), "b": (12.0, 0), "c": (99.0, 0), "d": (None, 0)}


def woman(ga, visits):
    return (True, 120.0, 80.0, None, None, ga, visits, None, None, None, None, None, None, None, None)


def counts(spark, women):
    return {(r["metric"], r["bin"]): r["n"] for r in panels.build(spark.createDataFrame(women, WOMEN)).collect() if r["panel"] == "anc"}


def test_visits_are_counted_for_those_who_have_any(spark):
    got = counts(spark, [woman(None, 0)] * 7 + [woman(10.0, 12)] * 6 + [woman(30.0, 9)] * 5 + [woman(13.5, 1)] * 5 + [woman(13.0, 2)] * 2)
    assert {b: got["firstVisit", b] for b in ("t1", "t2", "t3")} == {"t1": 8, "t2": 5, "t3": 5}
    assert [got["visitCounts", str(k)] for k in range(1, 10)] == [5, None, 0, 0, 0, 0, 0, 0, 11]
    assert not [k for k in counts(spark, [woman(10.0, 0)] * 9) if k[0] == "visitCounts"]  # nobody has a visit: no such panel
