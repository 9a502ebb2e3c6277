from pyspark.sql import functions as F

from rosterlake.functions import display
from rosterlake.operators import forms

FORMS = [("accouchement", 0, "date_acc", "Date d'accouchement", "Accouchement", 0), ("accouchement", 0, "vat_1", "VAT 1", "Vaccins", 1), ("accouchement", 0, "vat_2", "VAT 2", "Vaccins", 2), ("identification", 1, "age", "Age", "Identité", 0)]
FORM = "page_type string, type_rank int, ref_id string, ref_label string, section string, ref_order int"
FIELD = "page_id string, ordinal int, id string, label string, kind string, value string, status string, source string, options array<string>"


def test_contract_keys(spark):
    ref = spark.createDataFrame(FORMS, FORM)
    rows = [("p", 0, "a", "DATE D'ACCOUCHEMENT", "date", "x", "KNOWN", "ocr", None), ("p", 1, "b", "Date d’accouchement ", "date", "y", "KNOWN", "humain", None), ("p", 2, "b", "VAT 1", "checkbox", None, "NOT_PROVIDED", "ocr", None), ("p", 3, "b", "vat 2", "checkbox", "true", "KNOWN", "ocr", None), ("p", 4, "z", "Other", "text", "t", "KNOWN", "ocr", None), ("p", 5, "z", "Other too", "text", "t", "KNOWN", "ocr", None), ("q", 0, "k", "Age", "integer", "3", "KNOWN", "ocr", None)]
    fields = spark.createDataFrame(rows, FIELD)
    other = spark.createDataFrame([("q", "postpartum")], "page_id string, page_type string")
    types = {r["page_id"]: r["page_type"] for r in forms.classify(fields, ref, other).collect()}
    assert types == {"p": "accouchement", "q": "postpartum"}
    got = forms.contract_fields(fields, forms.classify(fields, ref, other), ref).orderBy("page_id", "ordinal").collect()
    assert [r["key"] for r in got] == ["date_acc", "b", "vat_1", "vat_2", "z", "z_", "k"]
    assert [r["section"] for r in got][:3] == ["Accouchement", "Autres champs lus", "Vaccins"] and got[1]["origin"] == "MANUAL"


def test_duplicates_and_options(spark):
    rows = [("p", 0, "", "Fièvre", "text", "non", "KNOWN", None, None), ("p", 1, "", "fievre", "text", "non", "KNOWN", None, None), ("p", 2, "", "FIEVRE", "text", "oui", "KNOWN", None, None), ("p", 3, "", "??", "text", "x", "KNOWN", None, None)]
    assert [r["id"] for r in forms.deduplicated(spark.createDataFrame(rows, FIELD)).orderBy("ordinal").collect()] == ["fievre", "fievre_2", "champ"]
    group = spark.createDataFrame([("p", 0, "v", "VAT", "text", "1, 3", "KNOWN", None, ["1", "2", "3"]), ("p", 1, "t", "Text", "text", "x", "KNOWN", None, None)], FIELD)
    got = [(r["label"], r["value"], r["status"]) for r in forms.expand_groups(group).collect()]
    assert got == [("VAT 1", "true", "KNOWN"), ("VAT 2", None, "NOT_PROVIDED"), ("VAT 3", "true", "KNOWN"), ("Text", "x", "KNOWN")]
    boxes = spark.createDataFrame([("p", "VAT", 1, "2", False), ("p", "VAT", 0, "1", True), ("p", "VAT", 2, "3", True), ("p", "M", 0, "a", None)], "page_id string, head string, ordinal int, option string, state boolean")
    got = {r["head"]: (r["value"], r["options"], r["status"]) for r in forms.collapse_boxes(boxes).collect()}
    assert got == {"VAT": ("1, 3", ["1", "2", "3"], "KNOWN"), "M": (None, ["a"], "NEEDS_REVIEW")}
    ref = spark.createDataFrame(FORMS, FORM)
    match = forms.matched_to_form(group.withColumn("page_type", F.lit("accouchement")), ref).collect()
    assert {r["ref_id"] for r in match} == {"vat_1", "vat_2"}


def test_grid_and_snapshot(spark):
    rows = [("p", i, "x", lab, "text", str(i), "KNOWN", None, None) for i, lab in enumerate(["TA | v1", "TA | v2", "Poids | v1", "Poids | v2", "Seul | v1", "Autre | v1", "Autre | v3"])]
    assert {(r["row"], r["col"]) for r in forms.grid_cells(spark.createDataFrame(rows, FIELD)).collect()} == {("TA", "v1"), ("TA", "v2"), ("Poids", "v1"), ("Poids", "v2")}
    p = spark.createDataFrame([("a",), ("b",)], "patient_id string")
    v = spark.createDataFrame([("v1", "a", "2026-02-01"), ("v2", "a", "2026-01-01")], "visit_id string, patient_id string, date string")
    r = spark.createDataFrame([("r1", "v1", "2026-02-01", "SYNCED")], "record_id string, visit_id string, created_at string, state string")
    got = {x["patient_id"]: x["visits"] for x in forms.snapshot(p, v, r).collect()}
    assert [x["visit_id"] for x in got["a"]] == ["v2", "v1"] and got["a"][1]["records"][0]["record_id"] == "r1" and got["b"] is None
    a, b = forms.booklet_position(F.col("id"))
    assert [tuple(x) for x in spark.range(7, 11).select(a, b).collect()] == [(1, 7), (1, 8), (2, 1), (2, 2)]


def test_show_and_typed(spark):
    shown = [("weight", "62700", "KNOWN", "62,7 kg"), ("weight", "3250", "KNOWN", "3250 g"), ("date", "2026-02-06", "KNOWN", "06/02/2026"), ("checkbox", "true", "KNOWN", "Oui"), ("text", None, "NEEDS_REVIEW", "?"), ("sex", "F", "KNOWN", "Féminin"), ("weight", "63000", "KNOWN", "63 kg")]
    rows = spark.createDataFrame([s[:3] for s in shown], "k string, v string, s string").select(display.show(F.col("k"), F.col("v"), F.col("s")).alias("x")).collect()
    assert [r["x"] for r in rows] == [s[3] for s in shown]
    cases = [("integer", "3", "3", "KNOWN"), ("weight", "3250 g", "3250", "KNOWN"), ("weight", "62,7 kg", "62700", "KNOWN"), ("weight", "62.5", "62500", "KNOWN"), ("date", "6/2/2026", "2026-02-06", "KNOWN"), ("date", "31/2/2026", None, None), ("checkbox", "non", None, "NOT_PROVIDED"), ("text", "?", None, "UNKNOWN"), ("text", "-", None, "NOT_PROVIDED"), ("sex", "fille", "F", "KNOWN"), ("integer", "abc", None, None)]
    rows = spark.createDataFrame([c[:2] for c in cases], "k string, t string").select(display.typed(F.col("k"), F.col("t")).alias("x")).collect()
    assert [(r["x"]["value"], r["x"]["status"]) for r in rows] == [c[2:] for c in cases]


def test_small_things(spark):
    one = spark.range(1)
    parts = one.select(display.message_parts(F.lit("aaaa\nbbb\ncc\n" + "d" * 12), 8).alias("p")).first()["p"]
    assert parts == ["aaaa\nbbb", "cc", "d" * 8, "d" * 4]
    assert one.select(display.nice_ticks(F.lit(0.0), F.lit(9.0)).alias("t")).first()["t"] == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]
    assert tuple(one.select(display.relative_time(F.lit(50 * 86400)).alias("r")).first()["r"]) == (2, "month")
    a, b = display.label_and_rest(F.lit("Age : 30 ans"))
    assert tuple(one.select(a, b).first()) == ("Age", "30 ans")
