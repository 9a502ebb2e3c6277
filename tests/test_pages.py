from pyspark.sql import functions as F

from rosterlake.functions import display
from rosterlake.functions import values as vf
from rosterlake.operators import forms, layout, lifecycle, series


def test_pressures_need_two_digits(spark):
    cases = [("12,5/7", (125, 70)), ("104 / 74", (104, 74)), ("9,5 / 5", None), ("10,5 / 5", (105, 50))]
    got = spark.createDataFrame([c[:1] for c in cases], "t string").select(vf.blood_pressure(F.col("t")).alias("b")).collect()
    assert [tuple(r["b"]) if r["b"] else None for r in got] == [c[1] for c in cases]


def test_dropped_pages(spark):
    pages = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, False), ("b", 0, False), ("c", 0, False), ("c", 1, False)], "record_id string, page_idx int, is_read boolean")
    commands = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 0, 3), ("a", 2, 4), ("a", 9, 5), ("b", 0, 1), ("c", 1, 1), ("c", 0, 2)], "record_id string, page_idx int, at int")
    drops = lifecycle.dropped_pages(pages, commands)
    got = {(r["record_id"], r["at"]): r["verdict"] for r in drops.collect()}
    assert got == {("a", 1): "dropped", ("a", 2): "page_read", ("a", 3): "no_page", ("a", 4): "dropped", ("a", 5): "no_page", ("b", 1): "only_page", ("c", 1): "dropped", ("c", 2): "only_page"}
    events = lifecycle.drop_events(drops, spark.createDataFrame([("a", "NEEDS_REVIEW"), ("c", "CAPTURED")], "record_id string, state string"))
    assert {tuple(r) for r in events.collect()} == {("a", "NEEDS_REVIEW", 1, "DROP page 0"), ("a", "NEEDS_REVIEW", 4, "DROP page 2"), ("c", "CAPTURED", 1, "DROP page 1")}


def test_next_index_and_codes(spark):
    pages = spark.createDataFrame([("a", 0), ("a", 3), ("b", None)], "record_id string, page_idx int")
    assert {r["record_id"]: r["next_idx"] for r in lifecycle.next_page_index(pages).collect()} == {"a": 4, "b": 0}
    rows = [("a", 1, 0, "N° de fiche", "zz 9", "KNOWN"), ("a", 0, 1, "Code", "ab/12 ?", "NEEDS_REVIEW"), ("a", 0, 0, "Code", "x1", "ILLEGIBLE"), ("b", 0, 0, "Age", "31", "KNOWN"), ("c", 0, 0, "Code", "?", "KNOWN"), ("c", 0, 1, "Code", "q" * 21, "KNOWN")]
    fields = spark.createDataFrame(rows, "record_id string, page_idx int, ordinal int, label string, value string, status string")
    assert [tuple(r) for r in lifecycle.suggested_codes(fields).collect()] == [("a", "AB/12")]


def test_added_fields(spark):
    requests = spark.createDataFrame([
        ("r", 0, 1, "Poids (kg)", "62,5"), ("r", 0, 2, " Poids  (kg)", "-"), ("r", 0, 3, "Nom", "x"), ("r", 0, 4, "A", "x"), ("r", 0, 5, "Remarque", "inconnu"), ("r", 0, 6, "Remarque 2", "06 12 34 56 78"), ("r", 0, 7, "!!!", "ok"), ("r", 0, 8, None, "x"),
    ], "record_id string, page_idx int, at int, label string, text string")
    fields = spark.createDataFrame([("r", 0, "poids_kg"), ("r", 0, "poids_kg__")], "record_id string, page_idx int, key string")
    got = {r["at"]: (r["refused"], r["key"], r["kind"], r["value"], r["status"]) for r in lifecycle.added_fields(requests, fields).collect()}
    assert got[1] == (None, "poids_kg_", "weight", "62", "KNOWN")  # the unit in an added label isn't read
    assert got[2] == (None, "poids_kg___", "weight", None, "NOT_PROVIDED")
    assert got[3][0] == got[6][0] == "personal" and got[4][0] == "too_short"
    assert got[5] == (None, "remarque", "text", None, "UNKNOWN") and got[7] == (None, "champ", "text", "ok", "KNOWN")


def test_split_mixed(spark):
    cases = [("Province El Jadida", 0.45, ("Province", "El Jadida")), ("Age: 31", 0.5, ("Age:", "31")), ("Age:", 0.5, None), ("abc", 0.5, None), ("Province El Jadida", 0.9, None), ("abcdefghij", 0.3, ("abc", "defghij")), ("N: 5", 0.5, ("N:", "5"))]
    got = spark.createDataFrame([c[:2] for c in cases], "t string, s double").select(layout.split_mixed(F.col("t"), F.col("s")).alias("x")).collect()
    assert [tuple(r["x"]) if r["x"] else None for r in got] == [c[2] for c in cases]


def test_merged_visits_ties_and_kinds(spark):
    """Two columns of one page with one date: the later counts; kinds of page stay apart; pending after linked."""
    rows = [("p", "antenatal", "r1", 0, 2, "2025-01-01", False, 1), ("p", "antenatal", "r1", 0, 3, "2025-01-01", False, 1), ("p", "postpartum_mother", "r1", 1, 0, "2025-01-01", False, 1), ("p", "antenatal", "r2", 0, 5, None, True, 0), ("p", "antenatal", "r3", 0, 5, None, False, 9)]
    df = spark.createDataFrame(rows, "patient_id string, page_kind string, record_id string, page_idx int, col int, date string, is_pending boolean, created_at int")
    got = {(r["page_kind"], r["record_id"], r["col"]) for r in series.merged_visits(df).collect()}
    assert got == {("antenatal", "r1", 3), ("postpartum_mother", "r1", 0), ("antenatal", "r2", 5)}


def test_copied_identifiers(spark):
    codes = spark.createDataFrame([("p", "A64l85"), ("p", "778"), ("p", ""), ("p", None), ("q", "BK123456"), ("r", "BK123456"), ("s", "A64185")], "page_id string, code string")
    ids = spark.createDataFrame([("p", "A64185"), ("p", "A64185"), ("q", "CIN: ZT98765"), ("r", "0612345678"), ("p", None)], "page_id string, value string")
    assert {tuple(r) for r in lifecycle.copied_identifiers(codes, ids).collect()} == {("p", "A64l85"), ("q", "BK123456")}


def test_waiting(spark):
    states = spark.createDataFrame([("CAPTURED",), ("SAVED",), ("SYNCED",), ("NEEDS_REVIEW",), ("SYNC_FAILED",), (None,)], "state string")
    assert lifecycle.waiting_for_network(states).first()["n_waiting"] == 3
    assert lifecycle.waiting_for_network(states.limit(0)).first()["n_waiting"] == 0


def test_summary_of_a_patient(spark):
    page = "identification_antecedents"
    rows = [
        ("p", page, "acc1_date", "x", "2019-03-01", "KNOWN"), ("p", page, "acc1_poids", "x", "3100", "KNOWN"), ("p", page, "acc3_modalite", "x", None, "NOT_PROVIDED"), ("p", page, "acc5_complication", "x", "HPP", "KNOWN"),
        ("p", page, "acc7_date", "x", "2019-03-01", "KNOWN"), ("p", page, "vat_2", "x", "true", "KNOWN"), ("p", page, "rubeole", "x", "true", "KNOWN"), ("p", page, "rubeole_date", "x", "2020-01-01", "KNOWN"),
        ("p", "grossesse", "a", "Complications", "HTA", "KNOWN"), ("p", "grossesse", "b", "Complications", "RAS", "KNOWN"), ("p", "grossesse", "c", "Complications", "HTA", "NEEDS_REVIEW"), ("p", "grossesse", "d", None, "HTA", "KNOWN"),
        ("q", "grossesse", "acc1_date", "Complications", None, None),
    ]
    latest = spark.createDataFrame(rows, "patient_id string, page_type string, key string, section string, value string, status string")
    assert [r["key"] for r in forms.noted_facts(latest).collect()] == ["a"]
    assert {tuple(r) for r in forms.previous_deliveries(latest).collect()} == {("p", 1, "2019-03-01", None, "3100", None), ("p", 5, None, None, None, "HPP")}
    got = {r["vaccine"]: (r["ticked"], r["date"]) for r in forms.vaccinations(latest).collect()}
    assert len(got) == 7 and {k for k, v in got.items() if v[0]} == {"vat_2", "rubeole"} and got["rubeole"][1] == "2020-01-01"
    assert forms.vaccinations(latest.limit(0)).collect() == []


def test_numbered_boxes(spark):
    """One row whose numbers are read, one where they aren't, a box far off and one with a plain label."""
    boxes = [
        ("p", "a", 10, 100, "VAT 1"), ("p", "b", 40, 101, ""), ("p", "c", 70, 100, "VAT 3"), ("p", "far", 900, 100, ""), ("p", "word", 100, 100, "oui"),
        ("p", "d", 10, 300, "Dose 4"), ("p", "e", 40, 300, "Dose 4"), ("p", "f", 10, 500, "VAT 9"), ("q", "g", 40, 100, None),
    ]
    df = spark.createDataFrame([(p, i, x, y, 12, 12, label, 20.0) for p, i, x, y, label in boxes], "page_id string, box_id string, x int, y int, w int, h int, label string, th double")
    lines = spark.createDataFrame([("p", 1, "□2 □4 6", 20, 96, 90, 116), ("p", 0, "VAT", 0, 96, 9, 116), ("p", 2, "Dose □4", 0, 296, 90, 316), ("q", 0, "1 2 3", 0, 96, 9, 116)], "page_id string, i int, text string, x0 int, y0 int, x1 int, y1 int")
    got = {r["box_id"]: r["label"] for r in layout.numbered_boxes(df, lines).collect()}
    assert got == {"a": "VAT 2", "b": "VAT 4", "c": "VAT 6", "far": "", "word": "oui", "d": "Dose 1", "e": "Dose 2", "f": "VAT 1", "g": None}


def test_moves_after_reading(spark):
    records = spark.createDataFrame([(r, "PENDING_AI") for r in "abcde"] + [("z", "NEEDS_REVIEW")], "record_id string, state string")
    pages = [("a", 0, True, None), ("a", 1, False, "dark"), ("b", 0, True, None), ("b", 1, False, None), ("c", 0, False, None), ("d", 1, False, "late"), ("d", 0, False, "first"), ("z", 0, True, None)]
    got = {tuple(r) for r in lifecycle.moves_after_reading(records, spark.createDataFrame(pages, "record_id string, page_idx int, is_read boolean, error string")).collect()}
    assert got == {("a", 0, "AI_PROCESSED", None), ("a", 1, "NEEDS_REVIEW", None), ("d", 0, "PROCESSING_FAILED", "first"), ("e", 0, "PROCESSING_FAILED", None)}


def test_translated(spark):
    texts = ["Lecture du texte (PaddleOCR)", "Relecture de 3 valeur(s) douteuse(s) ou non rattachée(s) par m:4b", "modèle m:4b absent (lancer `ollama pull m:4b`)", "Autre chose", None]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(display.translated(F.col("t")).alias("x")).collect()]
    assert got == ["Reading the text (PaddleOCR)", "Second reading of 3 doubtful or unlinked value(s) by m:4b", "model m:4b missing (run `ollama pull m:4b`)", "Autre chose", None]
