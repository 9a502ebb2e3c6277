from pyspark.sql import functions as F

from rosterlake.operators import forms as fm
from rosterlake.operators import lifecycle as lc
from rosterlake.operators import messages as ms

FIELDS = "record_id string, page_idx int, ordinal int, key string, label string, kind string, section string, value string, status string, origin string, reason string, alert string"
PAGES = "record_id string, page_idx int, page_type string, title string, error string"


def field(ordinal, label, value=None, status="KNOWN", section=None, kind="text", origin="AI", reason=None, alert=None, key="une_cle", page=0):
    return ("r", page, ordinal, key, label, kind, section, value, status, origin, reason, alert)


def test_values_of_a_page(spark):
    rows = [
        field(0, "HTA | Famille", "aucun", section="Antécédents"), field(1, "Poids", "3250", "KNOWN", "Naissance", "weight"), field(2, "HTA | Mari", "oui", "NEEDS_REVIEW", "Antécédents", origin="CORRECTED"),
        field(3, None, None, "UNKNOWN", "Naissance"), field(4, "Vide", None, "NOT_PROVIDED", "Naissance"), field(5, "Diabète | Mari", "x", section="Antécédents"), field(6, "HTA | Mère", "y", section="Antécédents"), field(7, "Seul", "z"),
    ]
    df = spark.createDataFrame(rows, FIELDS)
    text = ms.value_texts(ms.described(df)).first()["text"]
    assert text == (
        "*Antécédents*\nHTA : 1. Famille *aucun* · 2. ⚠️ Mari *oui* ✏️\n3. Diabète | Mari : *x*\n4. HTA | Mère : *y*\n\n*Naissance*\n5. Poids : *3250 g*\n6. Une cle : *Inconnu*\n8. Seul : *z*"
    )  # sections stay together, empty boxes keep their number, rows that don't follow each other don't join
    assert "7. Vide : *—*" in ms.value_texts(ms.described(df), include_empty=True).first()["text"]


def test_pages_with_doubts_and_without(spark):
    doubts = [field(k, f"F{k}", str(k), "NEEDS_REVIEW", reason="incoherent" if k == 1 else "x", alert="Date : avant" if k == 1 else None) for k in range(1, 18)]
    rows = [*doubts, field(1, "Sûr", "1", page=1), field(1, "Rien", None, "NOT_PROVIDED", page=4)]
    pages = [("r", 0, "accouchement", "T", None), ("r", 1, "inconnue", "Titre lu", None), ("r", 2, None, None, "floue"), ("r", 3, None, None, None), ("r", 4, None, None, None), ("s", 0, None, None, "")]
    got = {(r["record_id"], r["page_idx"]): r for r in ms.page_messages(spark.createDataFrame(rows, FIELDS), spark.createDataFrame(pages, PAGES)).collect()}
    first = got["r", 0]
    assert first["review_text"] == "📄 *Page 1/5 · Accouchement*\n📊 17 valeur(s) lue(s)\n⚠️ 17 à vérifier : 1. F1, 2. F2, 3. F3, 4. F4, 5. F5 (+12)\n\n👇 Que voulez-vous faire ?"
    listed = first["doubts_text"].split("\n")
    assert listed[:3] == ["⚠️ *17 valeur(s) restent à vérifier :*", "• 1. F1 : *1* (ne colle pas avec le reste du registre)", "   ↳ Date : avant"] and listed[3] == "• 2. F2 : *2*"
    assert sum(x.startswith("• ") for x in listed) == 15
    assert got["r", 1]["review_text"].startswith("📄 *Page 2/5 · Titre lu*") and "✅ Aucune incertitude restante." in got["r", 1]["review_text"] and got["r", 1]["doubts_text"] is None
    assert got["r", 2]["review_text"] == "❌ *Page 3/5 · lecture impossible*\nfloue\n\n👇 Reprendre la photo, ou ignorer cette page ?"
    assert got["r", 3]["review_text"].split("\n")[1] == "Raison inconnue." and got["r", 3]["values_text"] is None
    assert got["r", 4]["values_text"] == "Aucune valeur lue sur cette page." and got["r", 4]["review_text"].startswith("📄 *Page 5/5 · Page*")
    assert got["s", 0]["review_text"].endswith("👇 Reprendre la photo ?")
    assert ms.page_messages(spark.createDataFrame([], FIELDS), spark.createDataFrame([], PAGES)).count() == 0


def test_candidates_and_ends(spark):
    records = spark.createDataFrame([("r", "P1"), ("s", None)], "record_id string, code string")
    found = [("r", k, f"C{k}", ["SAME_CODE", "CLOSE_AGE"] if k == 1 else None if k == 2 else []) for k in range(1, 12)]
    texts = {r["record_id"]: r["text"] for r in ms.link_texts(records, spark.createDataFrame(found, "record_id string, rank int, patient_code string, reasons array<string>")).collect()}
    lines = texts["r"].split("\n")
    assert lines[0] == "👤 *Ce registre (P1) est-il celui d'une patiente déjà suivie ?*" and lines[2:4] == ["1️⃣ C1 · même code, âge proche", "2️⃣ C2"] and lines[9] == "8️⃣ C8" and lines[11].startswith("👇 Choisissez")
    assert texts["s"].startswith("👤 Aucune patiente suivie avec le code **.")
    pages = spark.createDataFrame([("r", 0, "accouchement", None, None), ("r", 3, None, None, None)], PAGES)
    ends = {r["record_id"]: r["text"] for r in ms.final_texts(records, pages, spark.createDataFrame([field(1, "A", "1")], FIELDS)).collect()}
    assert ends["r"] == "✅ *Registre enregistré* · code P1 · 2 page(s)\n\n📄 *Page 1 · Accouchement*\n1. A : *1*\n\n📄 *Page 2 · Page*\nAucune valeur lue sur cette page.\n\n🗂️ Résultat final enregistré (dossier r), visible sur le tableau de bord."
    assert ends["s"].startswith("✅ *Registre enregistré* · code  · 0 page(s)")


CASES = [
    ("format", {"measure": "weight", "value": "1047.0"}, "Poids 1047 : valeur impossible pour ce champ", "Weight 1047: not a possible value for this field"),
    ("format", {"measure": "bp", "value": "1047/74"}, "TA 1047/74 : chiffres impossibles pour une tension", "BP 1047/74: not a possible value for this field"),
    ("format", {"measure": "gaWeeks", "value": "47"}, "Âge gestationnel 47 SA : valeur impossible", "Gestational age 47: not a possible value for this field"),
    ("bp_order", {"value": "60/90"}, "TA 60/90 : le 1er chiffre devrait être le plus grand", "BP 60/90: the first number should be the larger one"),
    ("spike", {"measure": "hemoglobin", "value": "4.25", "before": "11.0", "after": "11.5"}, "Hémoglobine 4,2 : très loin des visites voisines (11 et 11,5)", "Haemoglobin 4.25: far from the visits before and after (11 and 11.5)"),
    ("spike", {"measure": "bp", "value": "220/80", "before": "120/80", "after": "118/70"}, "TA 220/80 : très loin des visites voisines (120/80 et 118/70)", "BP 220/80: far from the visits before and after (120/80 and 118/70)"),
    ("future", {"value": "2030-09-01"}, "Date 01/09/2030 : dans le futur", "Date 1 Sept 2030: in the future"),
    ("termDate_lmp", {"value": "2025-01-01", "lmp": "2024-03-01", "expected": "2024-12-13"}, "Date de dépassement 01/01/2025 : la DDR (01/03/2024) donne le 13/12/2024", "Overdue date 1 Jan 2025: the LMP (1 Mar 2024) gives 13 Dec 2024"),
    ("ga_dates", {"value": "30", "previous": "20", "weeks": "4"}, "30 SA lu : 4 semaines après la visite à 20 SA", "30 wk read: 4 weeks after the visit at 20 wk"),
    ("alive_stillborn", {"with": "x"}, "Vivant et mort-né cochés ensemble", "Alive and stillborn both ticked"),
    ("no_such_code", {}, None, None),
]


def test_alerts_in_words(spark):
    df = spark.createDataFrame([(k, c, p) for k, (c, p, _, _) in enumerate(CASES)], "k int, code string, params map<string,string>")
    got = df.select("k", ms.alert_text(F.col("code"), F.col("params")).alias("fr"), ms.alert_text(F.col("code"), F.col("params"), "en").alias("en")).orderBy("k").collect()
    for r, (_, _, fr, en) in zip(got, CASES, strict=True):
        assert (r["fr"], r["en"]) == (fr and fr + " : à vérifier sur le papier.", en and en + " — check on the paper.")


def test_what_counts_as_open(spark):
    """What is unknown on paper is settled; an empty box stays empty even if a person wrote so."""
    rows = [("KNOWN", "AI"), ("KNOWN", "CORRECTED"), ("UNKNOWN", "AI"), ("UNKNOWN", "MANUAL"), ("NOT_PROVIDED", "CORRECTED"), ("NOT_APPLICABLE", "AI"), ("NEEDS_REVIEW", "MANUAL"), ("ILLEGIBLE", "AI")]
    fields = spark.createDataFrame([("r", 0, "s", *x) for x in rows], "record_id string, page_idx int, section string, status string, origin string")
    got = fm.section_counts(fields).first()
    assert (got["known"], got["review"], got["edited"], got["empty"], got["total"]) == (2, 2, 2, 2, 8)
    quality = fm.reading_quality(fields).first()
    assert (quality["pages_read"], quality["auto_read_percent"], quality["human_checked"]) == (1, 17, 4)
    assert tuple(fm.reading_quality(fields.limit(0)).first()) == (0, None, 0)
    pages = spark.createDataFrame([("r", True), ("u", False), ("v", True)], "record_id string, fields_read boolean")
    blocked = {tuple(r) for r in lc.validation_blockers(pages, fields).collect()}
    assert blocked == {("r", 0, 2), ("u", 1, 0)}
    assert lc.validation_blockers(pages.where("fields_read"), fields.where("status = 'UNKNOWN'")).count() == 0
