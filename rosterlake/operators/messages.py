"""What is told about pages, records and alerts, as text: one row for each message, put together by grouping.

Fields are long rows: record_id, page_idx, ordinal, key, label, kind, section,
value, status, origin, reason, alert (the text of its first alert). A page's
fields, a record's pages and a record's candidates are few; each is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import show
from .windows import numbered_by_section

# What has something to show, what needs a look, how many are named.
SHOWN, DOUBTFUL, EDITED = ["KNOWN", "UNKNOWN", "NEEDS_REVIEW", "ILLEGIBLE"], ["NEEDS_REVIEW", "ILLEGIBLE"], ["CORRECTED", "MANUAL"]
NAMED, LISTED, CANDIDATES = 5, 15, 8
PAGE_NAMES = {
    "identification_antecedents": "Identification et antécédents", "accouchement": "Accouchement", "grossesse_actuelle": "Grossesse actuelle", "postpartum_precoce_mere": "Post-partum précoce · mère",
    "postpartum_precoce_nouveau_ne": "Post-partum précoce · nouveau-né", "postpartum_tardif_mere": "Post-partum tardif · mère", "postpartum_tardif_nouveau_ne": "Post-partum tardif · nouveau-né",
}
REASONS = {
    "non_rattache": "écriture rattachée à aucun champ", "etiquette_douteuse": "étiquette mal lue", "champ_nouveau": "champ inconnu du registre", "choix_nouveau": "case inconnue du registre", "valeur_douteuse": "lecture incertaine",
    "incoherent": "ne colle pas avec le reste du registre", "lieu_corrige": "nom de lieu corrigé", "etiquette_manuscrite": "nom du champ écrit à la main",
}
LINK_REASONS = {"SAME_CODE": "même code", "SIMILAR_CODE": "code proche", "SAME_AGE": "même âge", "CLOSE_AGE": "âge proche", "SAME_GESTATION": "même gestation"}
MEASURES_FR = {"weight": "Poids", "fundalHeight": "HU", "fhr": "BCF", "temperature": "Température", "pulse": "Pouls", "hemoglobin": "Hémoglobine", "headCirc": "Périmètre crânien", "length": "Taille", "bp": "TA", "gaWeeks": "Âge gestationnel"}
MEASURES_EN = {"weight": "Weight", "fundalHeight": "Fundal height", "fhr": "FHR", "temperature": "Temperature", "pulse": "Pulse", "hemoglobin": "Haemoglobin", "headCirc": "Head circumference", "length": "Length", "bp": "BP", "gaWeeks": "Gestational age"}


def named(of: Column, names: dict[str, str], other: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if other is None else other
    for k, v in names.items():
        out = F.when(of == k, v).otherwise(out)
    return out


def alert_text(code: Column, params: Column, lang: str = "fr") -> Column:
    """An alert in words, from its code and parameters; unknown codes have none."""
    p = lambda k: F.try_element_at(params, F.lit(k))
    n = lambda k: p(k).try_cast("double")
    day = lambda k: F.try_to_date(F.substring(p(k), 1, 10), "yyyy-MM-dd")
    whole = lambda k: F.regexp_replace(p(k), r"\.0$", "")
    if lang == "fr":
        num = lambda k: F.when(n(k).isNull(), p(k)).otherwise(F.replace(F.regexp_replace(F.format_string("%.1f", F.bround(n(k), 1)), r"\.0$", ""), F.lit("."), F.lit(",")))
        d = lambda k: F.date_format(day(k), "dd/MM/yyyy")
        m, bp, ga = named(p("measure"), MEASURES_FR), p("measure") == "bp", p("measure") == "gaWeeks"
        say = {
            "format": F.when(bp, F.concat(F.lit("TA "), p("value"), F.lit(" : chiffres impossibles pour une tension"))).when(ga, F.concat(F.lit("Âge gestationnel "), whole("value"), F.lit(" SA : valeur impossible")))
            .otherwise(F.concat(m, F.lit(" "), num("value"), F.lit(" : valeur impossible pour ce champ"))),
            "bp_order": F.concat(F.lit("TA "), p("value"), F.lit(" : le 1er chiffre devrait être le plus grand")),
            "spike": F.concat(m, F.lit(" "), num("value"), F.lit(" : très loin des visites voisines ("), num("before"), F.lit(" et "), num("after"), F.lit(")")),
            "date_order": F.concat(F.lit("Venue le "), d("value"), F.lit(" : pas après la visite précédente ("), d("previous"), F.lit(")")),
            "future": F.concat(F.lit("Date "), d("value"), F.lit(" : dans le futur")),
            "appointment_before_visit": F.concat(F.lit("Rendez-vous "), d("value"), F.lit(" : avant la visite du "), d("visit")),
            "ga_lmp": F.concat(whole("value"), F.lit(" SA lu : la DDR ("), d("lmp"), F.lit(") et la date de venue ("), d("visit"), F.lit(") donnent environ "), p("expected"), F.lit(" SA")),
            "ga_dates": F.concat(whole("value"), F.lit(" SA lu : "), p("weeks"), F.lit(" semaines après la visite à "), whole("previous"), F.lit(" SA")),
            "edd_lmp": F.concat(F.lit("DPA "), d("value"), F.lit(" : la DDR ("), d("lmp"), F.lit(") donne le "), d("expected")),
            "termDate_lmp": F.concat(F.lit("Date de dépassement "), d("value"), F.lit(" : la DDR ("), d("lmp"), F.lit(") donne le "), d("expected")),
            "parity_gravidity": F.concat(F.lit("Parité "), p("parity"), F.lit(" plus grande que la gestité "), p("gravidity")),
            "obstetric_sum": F.concat(F.lit("Parité "), p("parity"), F.lit(" + avortements "), p("abortions"), F.lit(" dépassent la gestité "), p("gravidity")),
            "living_parity": F.concat(p("living"), F.lit(" enfants vivants pour une parité de "), p("parity"), F.lit(" (naissances multiples ?)")),
            "deliveries_parity": F.concat(p("listed"), F.lit(" accouchements antérieurs décrits pour une parité de "), p("parity")),
            "two_modes": F.lit("Voie basse et césarienne cochées ensemble"), "alive_stillborn": F.lit("Vivant et mort-né cochés ensemble"),
            "birth_ga": F.concat(num("value"), F.lit(" SA à la naissance : la DDR ("), d("lmp"), F.lit(") et la date d'accouchement donnent environ "), p("expected"), F.lit(" SA")),
        }
        end = " : à vérifier sur le papier."
    else:
        d = lambda k: F.regexp_replace(F.date_format(day(k), "d MMM yyyy"), " Sep ", " Sept ")
        m = named(p("measure"), MEASURES_EN, F.lit("Value"))
        say = {
            "format": F.concat(m, F.lit(" "), whole("value"), F.lit(": not a possible value for this field")), "bp_order": F.concat(F.lit("BP "), p("value"), F.lit(": the first number should be the larger one")),
            "spike": F.concat(m, F.lit(" "), whole("value"), F.lit(": far from the visits before and after ("), whole("before"), F.lit(" and "), whole("after"), F.lit(")")),
            "date_order": F.concat(F.lit("Visit on "), d("value"), F.lit(": not after the previous visit ("), d("previous"), F.lit(")")), "future": F.concat(F.lit("Date "), d("value"), F.lit(": in the future")),
            "appointment_before_visit": F.concat(F.lit("Appointment "), d("value"), F.lit(": before the visit of "), d("visit")),
            "ga_lmp": F.concat(whole("value"), F.lit(" wk read: the LMP ("), d("lmp"), F.lit(") and the visit date ("), d("visit"), F.lit(") give about "), p("expected"), F.lit(" wk")),
            "ga_dates": F.concat(whole("value"), F.lit(" wk read: "), p("weeks"), F.lit(" weeks after the visit at "), whole("previous"), F.lit(" wk")),
            "edd_lmp": F.concat(F.lit("Due date "), d("value"), F.lit(": the LMP ("), d("lmp"), F.lit(") gives "), d("expected")), "termDate_lmp": F.concat(F.lit("Overdue date "), d("value"), F.lit(": the LMP ("), d("lmp"), F.lit(") gives "), d("expected")),
            "parity_gravidity": F.concat(F.lit("Parity "), p("parity"), F.lit(" greater than gravidity "), p("gravidity")), "obstetric_sum": F.concat(F.lit("Parity "), p("parity"), F.lit(" + abortions "), p("abortions"), F.lit(" exceed gravidity "), p("gravidity")),
            "living_parity": F.concat(p("living"), F.lit(" living children for a parity of "), p("parity"), F.lit(" (multiple births?)")), "deliveries_parity": F.concat(p("listed"), F.lit(" previous deliveries described for a parity of "), p("parity")),
            "two_modes": F.lit("Vaginal and caesarean both ticked"), "alive_stillborn": F.lit("Alive and stillborn both ticked"),
            "birth_ga": F.concat(whole("value"), F.lit(" wk at birth: the LMP ("), d("lmp"), F.lit(") and the delivery date give about "), p("expected"), F.lit(" wk")),
        }
        end = " — check on the paper."
    out = F.lit(None).cast("string")
    for k, text in say.items():
        out = F.when(code == k, text).otherwise(out)
    return F.concat(out, F.lit(end))


def described(fields: DataFrame) -> DataFrame:
    """Fields with number (sections kept together), name, told (the value in words), flag, edited."""
    rows = fields.withColumn("section", F.coalesce("section", F.lit("")))
    rows = numbered_by_section(rows, ["record_id", "page_idx"], "section", "ordinal")
    words = F.replace("key", F.lit("_"), F.lit(" "))
    name = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1_000_000))))
    doubt = F.coalesce(F.col("status").isin(DOUBTFUL), F.lit(False))
    return rows.withColumns({
        "name": name, "told": show(F.coalesce("kind", F.lit("text")), F.col("value"), F.col("status")), "doubt": doubt, "shown": F.coalesce(F.col("status").isin(SHOWN), F.lit(False)),
        "flag": F.when(doubt, "⚠️ ").otherwise(""), "edited": F.when(F.col("origin").isin(EDITED), " ✏️").otherwise(""),
    })


def value_texts(rows: DataFrame, include_empty: bool = False) -> DataFrame:
    """record_id, page_idx, text: the numbered values of each page, by section; cells of a table row share a line. rows: of described()."""
    page = ["record_id", "page_idx"]
    some = rows if include_empty else rows.where("shown")
    some = some.withColumn("row", F.when(F.col("name").contains(" | "), F.substring_index("name", " | ", 1)))
    w = Window.partitionBy(*page).orderBy("number")
    before = F.lag("section").over(w)
    joins = F.coalesce((before == F.col("section")) & (F.lag("row").over(w) == F.col("row")), F.lit(False))
    some = some.withColumns({"head": F.when((F.col("section") != "") & ~before.eqNullSafe(F.col("section")), F.concat(F.lit("\n*"), "section", F.lit("*\n"))).otherwise(""), "new": F.when(joins, 0).otherwise(1)})
    some = some.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.concat(F.col("number").cast("string"), F.lit(". "), "flag")
    line = F.concat(start, "name", F.lit(" : *"), "told", F.lit("*"), "edited")
    cell = F.concat(start, F.expr("substring(name, length(row) + 4)"), F.lit(" *"), "told", F.lit("*"), "edited")
    cells = F.array_sort(F.collect_list(F.struct("number", cell.alias("cell"))))
    lines = some.groupBy(*page, "run").agg(F.count("*").alias("n"), F.first("row").alias("row"), cells.alias("cells"), F.first(line).alias("line"), F.max("head").alias("head"))
    text = F.concat("head", F.when(F.col("n") > 1, F.concat("row", F.lit(" : "), F.array_join("cells.cell", " · "))).otherwise(F.col("line")))
    return lines.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("run", text.alias("text")))).alias("t")).select(*page, F.btrim(F.array_join("t.text", "\n"), F.lit("\n")).alias("text"))


def page_messages(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """record_id, page_idx, values_text, review_text, doubts_text of each page; a page without fields says why it could not be read.

    pages: record_id, page_idx, page_type, title, error.
    """
    page = ["record_id", "page_idx"]
    rows = described(fields)
    doubts = F.array_sort(F.collect_list(F.when(F.col("doubt"), F.struct("number", "name", "told", named(F.col("reason"), REASONS).alias("why"), "alert"))))
    told = rows.groupBy(*page).agg(F.count_if("shown").alias("n_shown"), F.count("*").alias("n_fields"), doubts.alias("doubts"))
    w = Window.partitionBy("record_id")
    places = pages.withColumns({"place": F.row_number().over(w.orderBy("page_idx")).cast("string"), "total": F.count("*").over(w)})
    all_ = places.join(told, page, "left").join(value_texts(rows), page, "left")
    name = F.coalesce(named(F.col("page_type"), PAGE_NAMES), F.nullif("title", F.lit("")), F.lit("Page"))
    n = F.size("doubts")
    first = F.array_join(F.transform(F.slice("doubts", 1, NAMED), lambda x: F.concat(x["number"].cast("string"), F.lit(". "), x["name"])), ", ")
    doubt_line = F.when(n > 0, F.concat(F.lit("⚠️ "), n.cast("string"), F.lit(" à vérifier : "), first, F.when(n > NAMED, F.concat(F.lit(" (+"), (n - NAMED).cast("string"), F.lit(")"))).otherwise(""))).otherwise("✅ Aucune incertitude restante.")
    where = F.concat(F.lit("Page "), "place", F.lit("/"), F.col("total").cast("string"), F.lit(" · "))
    review = F.concat_ws("\n", F.concat(F.lit("📄 *"), where, name, F.lit("*")), F.concat(F.lit("📊 "), F.col("n_shown").cast("string"), F.lit(" valeur(s) lue(s)")), doubt_line, F.lit(""), F.lit("👇 Que voulez-vous faire ?"))
    failed = F.concat_ws("\n", F.concat(F.lit("❌ *"), where, F.lit("lecture impossible*")), F.coalesce(F.nullif("error", F.lit("")), F.lit("Raison inconnue.")), F.lit(""), F.concat(F.lit("👇 Reprendre la photo"), F.when(F.col("total") > 1, ", ou ignorer cette page ?").otherwise(" ?")))
    item = lambda x: F.concat(F.lit("• "), x["number"].cast("string"), F.lit(". "), x["name"], F.lit(" : *"), x["told"], F.lit("*"), F.coalesce(F.concat(F.lit(" ("), x["why"], F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit("\n   ↳ "), x["alert"]), F.lit("")))
    listed = F.concat(F.lit("⚠️ *"), n.cast("string"), F.lit(" valeur(s) restent à vérifier :*\n"), F.array_join(F.transform(F.slice("doubts", 1, LISTED), item), "\n"), F.lit("\n\n👇 Vous les avez vérifiées sur le registre ? Confirmez-les telles quelles, ou corrigez."))
    bad = F.col("error").isNotNull() | F.coalesce(F.col("n_fields") == 0, F.lit(True))
    return all_.select(*page, F.when(~bad, F.coalesce("text", F.lit("Aucune valeur lue sur cette page."))).alias("values_text"), F.when(bad, failed).otherwise(review).alias("review_text"), F.when(~bad & (n > 0), listed).alias("doubts_text"))


def link_texts(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """record_id, text: whether a record is one of the patients that it may belong to.

    records: record_id, code; candidates: record_id, rank (from 1), patient_code, reasons (array).
    """
    why = F.array_join(F.transform("reasons", lambda r: named(r, LINK_REASONS, r)), ", ")
    number = F.when(F.col("rank") < 10, F.concat(F.col("rank").cast("string"), F.lit("️⃣"))).otherwise(F.concat(F.col("rank").cast("string"), F.lit(".")))
    line = F.concat(number, F.lit(" "), "patient_code", F.when(F.coalesce(why, F.lit("")) != "", F.concat(F.lit(" · "), why)).otherwise(""))
    lines = candidates.where(F.col("rank") <= CANDIDATES).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    code = F.coalesce("code", F.lit(""))
    none = F.concat(F.lit("👤 Aucune patiente suivie avec le code *"), code, F.lit("*.\n\n👇 Créer la patiente, ou décider plus tard sur le tableau de bord ?"))
    some = F.concat(F.lit("👤 *Ce registre ("), code, F.lit(") est-il celui d'une patiente déjà suivie ?*\n\n"), F.array_join("l.line", "\n"), F.lit("\n\n👇 Choisissez la patiente, une nouvelle patiente, ou « Je ne sais pas »."))
    return records.join(lines, "record_id", "left").select("record_id", F.when(F.col("l").isNull(), none).otherwise(some).alias("text"))


def final_texts(records: DataFrame, pages: DataFrame, fields: DataFrame) -> DataFrame:
    """record_id, text: what is told once a record is kept. records: record_id, code; pages and fields as above."""
    page = ["record_id", "page_idx"]
    name = F.coalesce(named(F.col("page_type"), PAGE_NAMES), F.nullif("title", F.lit("")), F.lit("Page"))
    told = pages.join(value_texts(described(fields)), page, "left").withColumn("place", F.row_number().over(Window.partitionBy("record_id").orderBy("page_idx")))
    part = F.concat(F.lit("\n📄 *Page "), F.col("place").cast("string"), F.lit(" · "), name, F.lit("*\n"), F.coalesce("text", F.lit("Aucune valeur lue sur cette page.")))
    parts = told.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))).alias("p"))
    n = F.coalesce(F.size("p"), F.lit(0))
    head = F.concat(F.lit("✅ *Registre enregistré* · code "), F.coalesce("code", F.lit("")), F.lit(" · "), n.cast("string"), F.lit(" page(s)"))
    end = F.concat(F.lit("\n🗂️ Résultat final enregistré (dossier "), F.col("record_id").cast("string"), F.lit("), visible sur le tableau de bord."))
    return records.join(parts, "record_id", "left").select("record_id", F.concat_ws("\n", head, F.array_join("p.part", "\n"), end).alias("text"))
