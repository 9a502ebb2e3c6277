from pyspark.sql import functions as F

from rosterlake.operators import quality, series

SCHEMA = "record_id string, page_idx int, page_type string, ordinal int, key string, label string, kind string, value string, status string, origin string, column int, reason string, coherence boolean, alerts array<string>"
AS_OF = "2026-10-04"


def page(rows, page_type="grossesse_actuelle", record="r1", idx=0):
    return [(record, idx, page_type, i, key, label, kind, value, "KNOWN" if value else "NOT_PROVIDED", "AI", col, None, None, None) for i, (key, label, kind, value, col) in enumerate(rows)]


def antenatal(**change):
    rows = {
        "ddr": ("DDR", "date", "2025-04-26", None), "dpa": ("Date prévue d'accouchement", "date", "2026-01-31", None),
        "d2": ("Venue le | x", "date", "2025-07-20", 2), "d5": ("Venue le | x", "date", "2025-09-28", 5), "d6": ("Venue le | x", "date", "2025-11-01", 6),
        "ga2": ("Age probable | x", "weeks", "12", 2), "ga5": ("Age probable | x", "weeks", "22", 5), "ga6": ("Age probable | x", "weeks", "27", 6),
        "w2": ("Poids (kg) | x", "weight", "58800", 2), "w5": ("Poids (kg) | x", "weight", "62700", 5), "w6": ("Poids (kg) | x", "weight", "64300", 6),
        "bp2": ("TA | x", "text", "104/74", 2), "bp5": ("TA | x", "text", "104/74", 5), "bp6": ("TA | x", "text", "12/7", 6),
        "hiv2": ("VIH | x", "text", "Neg", 2), "hiv5": ("VIH | x", "text", None, 5), "rdv2": ("Rendez-vous | x", "date", "2025-08-17", 2),
    }
    for k, v in change.items():
        rows[k] = (*rows[k][:2], v, rows[k][3]) if not isinstance(v, tuple) else v
    return page([(k, *v) for k, v in rows.items()])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_series_of_the_clean_page(spark):
    fields = frame(spark, antenatal())
    assert series.page_types(fields).first()["page_type"] == "grossesse_actuelle"
    v = {(r["col"], r["measure"]): r for r in series.series_values(fields).collect()}
    assert v[2, "weight"]["num"] == 58.8 and (v[6, "bp"]["sys"], v[6, "bp"]["dia"]) == (120, 70) and v[2, "hiv"]["code"] == "neg"
    assert (5, "hiv") not in v
    seen = {r["col"]: r for r in series.visits(series.series_values(fields)).collect()}
    assert (seen[2]["date"], seen[2]["gaWeeks"], seen[2]["appointment"]) == ("2025-07-20", 12, "2025-08-17")


ALERTS = [
    ({}, set()),
    ({"rdv2": "2025-01-29"}, {("rdv2", "appointment_before_visit")}),
    ({"w5": "82700"}, {("w5", "spike")}),
    ({"dpa": "2026-03-31"}, {("dpa", "edd_lmp"), ("ddr", "edd_lmp")}),
    ({"ga5": "32"}, {("ga5", "ga_lmp")}),
    ({"d5": "2025-07-01"}, {("d5", "date_order"), ("ga5", "ga_lmp")}),
    ({"ddr": None, "ga6": "40"}, {("ga6", "ga_dates")}),
    ({"d6": "2026-10-06"}, {("d6", "future"), ("ga6", "ga_lmp")}),
    ({"bp5": "74/104"}, {("bp5", "bp_order")}),
    ({"bp5": "320/74"}, {("bp5", "format"), ("bp5", "spike")}),
    ({"hiv5": ("BCF | x", "text", "52", 5)}, {("hiv5", "format")}),
]


def ident(record, g, p, living, abort, *acc):
    rows = [("gestation", "G", "integer", g, None), ("parite", "P", "integer", p, None), ("enfants_vivants", "E", "integer", living, None), ("obst_avortement_nombre", "A", "integer", abort, None)]
    return page(rows + [(f"acc{n}_date", "D", "date", "2020", None) for n in acc], "identification_antecedents", record)


def test_alerts(spark):
    """All cases in one check, a record each."""
    rows, want = [], {}
    for k, (change, codes) in enumerate(ALERTS):
        rows += [(f"a{k}", *r[1:]) for r in antenatal(**change)]
        want[f"a{k}"] = codes
    more = {
        "i0": (ident("i0", "2", "3", None, "0"), {("parite", "parity_gravidity"), ("gestation", "parity_gravidity"), ("obst_avortement_nombre", "obstetric_sum"), ("gestation", "obstetric_sum")}),
        "i1": (ident("i1", "3", "2", "4", "0"), {("enfants_vivants", "living_parity")}),
        "i2": (ident("i2", "3", "1", None, None, 1, 2), {("parite", "deliveries_parity")}),
        "b0": (page([("mode_voie_basse_instrumentale", "a", "checkbox", "true", None), ("mode_cesarienne_urgence", "b", "checkbox", "true", None)], "accouchement", "b0"), {("mode_voie_basse_instrumentale", "two_modes"), ("mode_cesarienne_urgence", "two_modes")}),
        "g0": ([("g0", *r[1:]) for r in antenatal()] + page([("date_accouchement", "d", "date", "2026-01-24", None), ("nn_age_gestationnel", "g", "weeks", "34", None)], "accouchement", "g0", 1), {("nn_age_gestationnel", "birth_ga")}),
    }
    for k, (r, codes) in more.items():
        rows += r
        want[k] = codes
    got = {k: set() for k in want}
    found = quality.check(frame(spark, rows), AS_OF).collect()
    for r in found:
        got[r["record_id"]].add((r["key"], r["code"]))
    assert got == want
    assert next(r for r in found if r["code"] == "birth_ga")["params"]["expected"] == "39"


def test_no_sure_column_no_value(spark):
    rows = page([("w", "Poids (kg) | inconnue", "weight", "58800", None), ("v", "Poids (kg) | 2ème trimestre - Visite 1", "weight", "60000", None)])
    got = series.series_values(frame(spark, rows)).collect()
    assert [(r["col"], r["num"]) for r in got] == [(4, 60.0)]


def test_postpartum_page_types(spark):
    mother = page([("a", "Température", "text", "37", None), ("b", "Pouls", "text", "80", None), ("c", "Lochies", "text", "x", None), ("d", "7ème et 8ème jour", "checkbox", "true", None)], None)
    baby = page([("a", "Age", "text", "43 jours", None), ("b", "Périmètre crânien", "text", "37", None), ("c", "Allaitement", "text", "oui", None)], None, idx=1)
    got = {r["page_idx"]: r["page_type"] for r in series.page_types(frame(spark, mother + baby)).collect()}
    assert got == {0: "postpartum_precoce_mere", 1: "postpartum_tardif_nouveau_ne"}


def test_apply_flags_and_clears(spark):
    fields = frame(spark, antenatal())
    alert = spark.createDataFrame([("r1", 0, "w5", "spike")], "record_id string, page_idx int, key string, code string")
    once = quality.apply(fields, alert)
    w5 = once.where("key = 'w5'").first()
    assert (w5["status"], w5["reason"], w5["coherence"], w5["alerts"]) == ("NEEDS_REVIEW", "incoherent", True, ["spike"])
    back = quality.apply(once, alert.limit(0)).where("key = 'w5'").first()
    assert (back["status"], back["reason"], back["coherence"]) == ("KNOWN", None, False)
    human = quality.apply(fields.withColumn("origin", F.lit("CONFIRMED")), alert).where("key = 'w5'").first()
    assert (human["status"], human["alerts"]) == ("KNOWN", None)


def test_follow_up(spark):
    schema = "patient_id string, delivered_on string, last_visit string, open_appointment string, appointment_given string, has_early boolean, has_late boolean"
    rows = [
        ("a", None, "2026-01-01", None, None, False, False), ("f", "2026-01-01", "2025-12-01", None, None, True, False), ("g", "2026-01-01", None, None, None, True, True),
        ("h", None, "2026-01-01", "2026-02-01", "2026-01-01", False, False), ("n", None, None, None, None, False, False),
    ]
    df = spark.createDataFrame(rows, schema)

    def at(now, who):
        r = series.follow_up(df, now).where(f"patient_id = '{who}'").first()
        return r["step"], str(r["due"]) if r["due"] else None, r["days_late"], r["bucket"], r["anchor"]

    assert at("2026-01-20 12:00:00", "a") == ("ANTENATAL", "2026-01-29", -9, "LATER", "LAST_VISIT")
    assert at("2026-01-25 12:00:00", "a")[2:4] == (-4, "SOON")
    assert at("2026-02-10 12:00:00", "a")[2:4] == (12, "LATE")
    assert at("2026-03-15 12:00:00", "a")[2:4] == (45, "LOST")
    assert at("2026-01-29 09:00:00", "a")[2:4] == (-1, "SOON")
    assert at("2026-01-10 12:00:00", "f") == ("POSTPARTUM_LATE", "2026-02-12", -33, "LATER", "DELIVERY")
    assert at("2026-01-10 12:00:00", "g")[3] == "DONE"
    assert at("2026-02-03 12:00:00", "h")[2:] == (2, "LATE", "WRITTEN")
    assert at("2026-02-03 12:00:00", "n") == ("ANTENATAL", None, 0, "LATER", None)


def test_appointments(spark):
    given = spark.createDataFrame([("i", "2026-01-01", "2026-02-01"), ("h", "2026-01-01", "2026-02-01"), ("j", "2026-01-01", "2026-01-01")], "patient_id string, given_on string, appointment string")
    seen = spark.createDataFrame([("i", "2026-01-01"), ("i", "2026-02-06"), ("h", "2026-01-01"), ("j", "2026-01-01")], "patient_id string, seen_on string")
    got = {r["patient_id"]: (str(r["came_on"]) if r["came_on"] else None, r["delay_days"], r["timeliness"], r["is_open"]) for r in series.appointments(given, seen).collect()}
    assert got == {"i": ("2026-02-06", 5, "late", False), "h": (None, None, None, True)}
