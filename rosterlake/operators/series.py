"""Cells of register pages to visits: page types, measures, columns, series, trends, appointments, follow-up.

Fields come as one long table: record_id, page_idx, page_type, ordinal, key,
label, kind, value (text), status, origin, column. Rules are generated ``when``
chains over the folded row label, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..functions.values import TESTS, age_days, blood_pressure, category, due_bucket, days_late, iso_date, plain_number

USABLE = ("KNOWN", "NEEDS_REVIEW")
PAGE = ["record_id", "page_idx"]
# Row labels of the register and what they measure; the first match counts.
ROWS = [
    ("date", r"^venue le$|^date de (la )?consultation$|^date de (la )?visite$"),
    ("appointment", r"rendez vous|^revenir\b|^rdv\b"),
    ("gaWeeks", r"^age probable$|^age gestationnel$"),
    ("weight", r"^poids\b"),
    ("bp", r"^ta$|^t a$|^tension( arterielle)?$"),
    ("fundalHeight", r"^hu\b|hauteur uterine"),
    ("fhr", r"^bcf\b|bruits? du coeur"),
    ("temperature", r"^temperature\b|^t$|^t c$"),
    ("pulse", r"^pouls\b"),
    ("hemoglobin", r"^hemoglobine\b|^hb$"),
    ("glycemia", r"^bilan glycemique|^glycemie"),
    ("albuminuria", r"^albuminurie|^proteinurie"),
    ("glycosuria", r"^glucosurie|^glycosurie"),
    ("oedema", r"^o?edemes?$"),
    ("fetalMovements", r"^mouvements actifs"),
    ("hiv", r"\bvih\b|\bhiv\b"),
    ("syphilis", r"syphilis|\btpha\b|\bvdrl\b"),
    ("hbs", r"\bag ?hbs\b|^hbs\b"),
    ("hcv", r"hepatite c\b|\bvhc\b|\bhcv\b"),
    ("toxo", r"^toxoplasmose"),
    ("rubella", r"^rubeole$"),
    ("iron", r"^fer$"),
    ("headCirc", r"perimetre cranien"),
    ("length", r"^taille$"),
    ("ageDays", r"^age$"),
]
NUMERIC = ("weight", "fundalHeight", "fhr", "temperature", "pulse", "hemoglobin", "glycemia", "headCirc", "length")
CATEGORICAL = ("albuminuria", "glycosuria", "oedema", "fetalMovements", "iron", *TESTS)
VISIT_COLUMNS = [
    "1er trimestre visite 1", "1er trimestre visite 2", "1er trimestre visite 3", "2eme trimestre visite 1", "2eme trimestre visite 2", "2eme trimestre visite 3",
    "3eme trimestre 7eme mois", "3eme trimestre 8eme mois", "3eme trimestre 9eme mois",
]
KIND_OF_PAGE = {
    "grossesse_actuelle": "antenatal",
    "accouchement": "delivery",
    "postpartum_precoce_mere": "postpartum_mother",
    "postpartum_tardif_mere": "postpartum_mother",
    "postpartum_precoce_nouveau_ne": "postpartum_newborn",
    "postpartum_tardif_nouveau_ne": "postpartum_newborn",
}
ANTENATAL_ROWS = ["venue le", "age probable", "hu cm", "bcf", "glucosurie", "albuminurie", "poids kg", "examen des seins", "mouvements actifs", "anomalies squelette"]
MOTHER_HINTS = ["pouls", "lochies", "perinee", "globe uterin", "sphincters", "mollets", "desire utiliser"]
NEWBORN_HINTS = ["allaitement", "bcg", "refus de teter", "nouveau ne premature", "vaccins administres", "tirage sous costal", "supplementation en vitamine d"]
FACTS = [("lmp", r"^ddr$|date des dernieres regles"), ("edd", r"^date prevue d accouchement$|^dpa$"), ("termDate", r"^date de depassement de terme$"), ("height", r"^taille$")]
DELIVERY_FACTS = {"date_accouchement": "date", "nn_poids": "birthWeight", "nn_perimetre_cranien": "headCirc", "nn_age_gestationnel": "gaWeeks", "nn_sexe": "sex"}
PLACES = ["maternite", "clinique_privee", "maison_accouchement", "domicile", "autre"]


def _first(text: Column, rules) -> Column:
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(text.rlike(rule), name).otherwise(out)
    return out


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """Adds columns as a generated row: filters further up see them as plain columns and aren't pushed below, which would repeat their expressions in each use."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def row_part(label: Column) -> Column:
    return F.get(F.split(label, r"\|", 2), 0)


def measure_of(label: Column) -> Column:
    """The measure of a label; the folded row stands once in the expression, as a lambda's variable."""
    return F.element_at(F.transform(F.array(fold(row_part(label))), lambda row: _first(row, ROWS)), 1)


def column_of(column: Column, head: Column) -> Column:
    """The written column, else the place of the folded header among the register's nine."""
    at = F.array_position(F.array(*map(F.lit, VISIT_COLUMNS)), head)
    return F.coalesce(column.cast("int"), F.nullif(at.cast("int"), F.lit(0)))


def page_types(fields: DataFrame) -> DataFrame:
    """record_id, page_idx, page_type of each page by its printed labels; null where that isn't clear."""
    age = F.when((fold(F.col("label")) == "age") & F.col("status").isin(*USABLE), age_days(F.col("value")))
    rows = once(fields, __row=fold(row_part(F.col("label"))), __age=age)
    agg = rows.groupBy(*PAGE).agg(F.collect_set("__row").alias("rows"), F.min_by("__age", F.when(F.col("__age").isNotNull(), F.col("ordinal"))).alias("age"))
    agg = agg.withColumn("text", F.concat_ws(" ", "rows"))
    text = F.col("text")
    hints = lambda words: sum((text.contains(w).cast("int") for w in words[1:]), text.contains(words[0]).cast("int"))
    antenatal = (F.size(F.array_intersect("rows", F.array(*map(F.lit, ANTENATAL_ROWS)))) >= 3) | (F.size(F.array_except(F.array(F.lit("ddr"), F.lit("date prevue d accouchement")), "rows")) == 0)
    newborn = text.contains("perimetre cranien") & (hints(NEWBORN_HINTS) > 0)
    mother = hints(MOTHER_HINTS) >= 2
    kind = (
        F.when(antenatal, "grossesse_actuelle")
        .when(mother & ~newborn, F.when(text.rlike("7eme et 8eme jour|apres le 8eme jour"), "postpartum_precoce_mere").otherwise("postpartum_tardif_mere"))
        .when(newborn & ~mother, F.when(F.col("age") <= 21, "postpartum_precoce_nouveau_ne").when(F.col("age") > 21, "postpartum_tardif_nouveau_ne"))
    )
    return agg.select(*PAGE, kind.alias("page_type"))


def page_kind(page_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in KIND_OF_PAGE.items():
        out = F.when(page_type == name, kind).otherwise(out)
    return out


def usable(fields: DataFrame) -> DataFrame:
    return fields.where(F.col("status").isin(*USABLE) & F.col("value").isNotNull() & (F.col("value") != ""))


def series_values(fields: DataFrame) -> DataFrame:
    """One row for each placed value: record_id, page_idx, page_kind, col, measure, key, status, origin, num, sys, dia, day, word, code.

    A value without a sure column is dropped; pages of one visit use column 0; of
    several fields for one measure of a visit, the last one counts.
    """
    rows = usable(fields).withColumn("page_kind", page_kind(F.col("page_type"))).where("page_kind is not null and page_kind <> 'delivery'")
    antenatal = F.col("page_kind") == "antenatal"
    rows = once(rows.where(~(antenatal & ~F.col("label").contains("|"))), __cut=F.split("label", r"\|", 2))
    rows = once(rows, __row=fold(F.get("__cut", 0)), __head=F.when(antenatal & F.col("column").cast("int").isNull(), fold(F.get("__cut", 1))))
    rows = once(rows, measure=_first(F.col("__row"), ROWS)).where(F.col("measure").isNotNull() & (~F.col("measure").isin("ageDays", "length") | (F.col("page_kind") == "postpartum_newborn")))
    rows = once(rows, col=F.when(antenatal, column_of(F.col("column"), F.col("__head"))).otherwise(0)).where("col is not null")
    n, m, v, f = F.col("__n"), F.col("measure"), F.col("value"), F.col("__f")
    rows = once(rows, __n=F.when(m.isin(*NUMERIC, "gaWeeks", "ageDays"), plain_number(v)), __f=F.when(m.isin(*CATEGORICAL, "ageDays"), fold(v)))
    grams = F.when(n < 10, F.rint(n * 1000)).otherwise(F.rint(n))
    kilos = F.bround(F.when((F.col("kind") == "weight") & (n >= 1000), n / 1000).otherwise(n), 1)
    num = (
        F.when(m == "weight", F.when(F.col("page_kind") == "postpartum_newborn", grams).otherwise(kilos)).when(m == "gaWeeks", F.floor(n).cast("double"))
        .when(m == "ageDays", age_days(v, n, f).cast("double")).when(m.isin(*NUMERIC), n)
    )
    bp = F.when(m == "bp", blood_pressure(v))
    word = F.when(m.isin(*CATEGORICAL) & (F.trim(v) != ""), v)
    # a step at a time: one generated method for all of them would be too large to be compiled
    rows = once(once(rows, num=num, bp=bp), day=F.when(m.isin("date", "appointment"), iso_date(v)), word=word).where("num is not null or bp is not null or day is not null or word is not null")
    rows = once(rows, code=F.when(F.col("word").isNotNull(), F.when(F.col("word") == "true", "yes").otherwise(category(m, F.col("word"), f))))
    rows = rows.select(*PAGE, "page_kind", "col", "measure", "ordinal", "key", "status", "origin", "num", F.col("bp.sys").alias("sys"), F.col("bp.dia").alias("dia"), "day", "word", "code")
    # dealt and sorted once, by page: visits, trends and joins by page find their rows together
    w = Window.partitionBy(*PAGE, "page_kind", "col", "measure").orderBy("ordinal")
    return rows.repartition(*PAGE).withColumn("__later", F.lead(F.lit(True)).over(w)).where("__later is null").drop("ordinal", "__later")


def series_facts(fields: DataFrame) -> DataFrame:
    """record_id, page_idx, page_kind, name, key, day, num, word: what an antenatal or delivery page says once."""
    rows = usable(fields).withColumn("page_kind", page_kind(F.col("page_type")))
    ante = rows.where((F.col("page_kind") == "antenatal") & ~F.col("label").contains("|"))
    ante = once(once(ante, __row=fold(F.col("label"))), name=_first(F.col("__row"), FACTS)).where("name is not null").drop("__row")
    name = F.lit(None).cast("string")
    for key, fact in DELIVERY_FACTS.items():
        name = F.when(F.col("key") == key, fact).otherwise(name)
    born = rows.where("page_kind = 'delivery'").withColumn("name", name).where("name is not null")
    n = F.col("__n")
    grams = F.when(n < 10, F.rint(n * 1000)).otherwise(F.rint(n))
    typed = once(
        once(ante.unionByName(born), __n=plain_number(F.col("value"))), day=F.when(F.col("name").isin("lmp", "edd", "termDate", "date"), iso_date(F.col("value"))),
        num=F.when(F.col("name") == "birthWeight", grams).when(F.col("name").isin("height", "headCirc", "gaWeeks"), n), word=F.when(F.col("name") == "sex", F.col("value")))
    last = typed.where("day is not null or num is not null or word is not null").groupBy(*PAGE, "page_kind", "name").agg(F.max_by(F.struct("key", "day", "num", "word"), "ordinal").alias("v"))
    ticked = rows.where((F.col("page_kind") == "delivery") & (F.col("value") == "true"))
    boxes = ticked.groupBy(*PAGE, "page_kind").agg(
        F.count_if(F.col("key").startswith("mode_")).alias("modes"), F.count_if(F.col("key").startswith("mode_") & F.col("key").contains("cesarienne")).alias("cuts"),
        F.min_by("key", F.when(F.col("key").startswith("lieu_"), F.col("ordinal"))).alias("place"), F.count_if(F.col("key").startswith("lieu_")).alias("places"))
    none = [F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("day"), F.lit(None).cast("double").alias("num")]
    mode = boxes.where("modes > 0").select(*PAGE, "page_kind", F.lit("mode").alias("name"), *none, F.when(F.col("cuts") > 0, "cesarean").otherwise("vaginal").alias("word"))
    place = boxes.where("places > 0").select(*PAGE, "page_kind", F.lit("place").alias("name"), *none, F.regexp_replace("place", "^lieu_", "").alias("word"))
    return last.select(*PAGE, "page_kind", "name", "v.key", "v.day", "v.num", "v.word").union(mode).union(place)


def visits(values: DataFrame) -> DataFrame:
    """One row for each visit: record_id, page_idx, page_kind, col, date, appointment, gaWeeks, ageDays and their keys."""
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    agg = values.groupBy(*PAGE, "page_kind", "col").agg(
        of("date", "day").alias("date"), of("appointment", "day").alias("appointment"), of("gaWeeks", "num").cast("int").alias("gaWeeks"), of("ageDays", "num").cast("int").alias("ageDays"),
        of("date", "key").alias("date_key"), of("appointment", "key").alias("appointment_key"), of("gaWeeks", "key").alias("ga_key"),
        F.count_if(~F.col("measure").isin("date", "appointment", "gaWeeks", "ageDays")).alias("n_values"))
    return agg.where("n_values > 0 or date is not null")


def merged_visits(rows: DataFrame) -> DataFrame:
    """One row for each visit of a patient seen on several photos: same date, else same column, else its own page; the newest counts, pending records after linked ones.

    rows: patient_id, page_kind, record_id, page_idx, col, date, is_pending, created_at, ...
    Kinds of page are apart; of two columns of one page with one date the later counts.
    """
    same = F.coalesce(F.col("date"), F.when(F.col("col") > 0, F.concat(F.lit("col"), F.col("col"))), F.concat_ws(".", "record_id", "page_idx"))
    w = Window.partitionBy("patient_id", "page_kind", "same_key").orderBy(F.desc("is_pending"), F.desc("created_at"), F.desc("page_idx"), F.desc("col"))
    return rows.withColumn("same_key", same).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def points(merged: DataFrame) -> DataFrame:
    """Adds x: the written age in weeks, or weeks since the last period to one decimal; for newborns days, written or since birth. merged also has lmp, birth, page_kind."""
    weeks = F.floor(F.datediff(F.to_date("date"), F.to_date("lmp")) / 7 * 10 + 0.5) / 10
    days = F.coalesce(F.col("ageDays").cast("double"), F.datediff(F.to_date("date"), F.to_date("birth")).cast("double"))
    return merged.withColumn("x", F.when(F.col("page_kind") == "postpartum_newborn", days).otherwise(F.coalesce(F.col("gaWeeks").cast("double"), weeks)))


def appointments(given: DataFrame, seen: DataFrame) -> DataFrame:
    """patient_id, given_on, appointment, came_on, delay_days, timeliness, is_open.

    given: patient_id, given_on, appointment (dates; not later than given_on are
    dropped); seen: patient_id, seen_on, every visit of the patient. came_on is
    the first visit after the one that gave it; only the latest can be open.
    """
    none = seen.select("patient_id", F.lit(None).cast(given.schema["given_on"].dataType).alias("given_on"), F.lit(None).cast(given.schema["appointment"].dataType).alias("appointment"), F.to_date("seen_on").alias("__seen"))
    return _kept_or_open(given.select("patient_id", "given_on", "appointment", F.lit(None).cast("date").alias("__seen")).union(none))


def appointments_of_visits(visits: DataFrame) -> DataFrame:
    """appointments, where each row is a visit and what it gave: patient_id, given_on, appointment (null if none). The visits are read once."""
    return _kept_or_open(visits.select("patient_id", "given_on", "appointment", F.to_date("given_on").alias("__seen")))


def _kept_or_open(rows: DataFrame) -> DataFrame:
    """rows: patient_id, given_on, appointment, __seen (the day of a visit, null if the row is none)."""
    day = lambda c: F.unix_date(F.to_date(c))
    # latest first, so that the frame only grows: linear in the rows of a patient
    rows = rows.withColumn("__t", F.coalesce(day("given_on"), day("__seen")).cast("bigint"))
    ahead = Window.partitionBy("patient_id").orderBy(F.col("__t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("came", F.min(day("__seen")).over(ahead)).where(F.to_date("appointment") > F.to_date("given_on"))
    w = Window.partitionBy("patient_id").orderBy(F.desc("given_on"), F.desc("appointment"))
    delay = F.col("came") - day("appointment")
    late = F.when(delay > 3, "late").when(delay < -3, "early").when(delay.isNotNull(), "in time")
    return out.withColumn("r", F.row_number().over(w)).select(
        "patient_id", "given_on", "appointment", F.date_from_unix_date(F.col("came").cast("int")).alias("came_on"), delay.cast("int").alias("delay_days"), late.alias("timeliness"), ((F.col("r") == 1) & F.col("came").isNull()).alias("is_open"))


def follow_up(patients: DataFrame, as_of: str) -> DataFrame:
    """patient_id, step, due, days_late, bucket, anchor.

    patients: patient_id, delivered_on, last_visit, open_appointment,
    appointment_given, has_early, has_late (postpartum pages photographed).
    """
    born, app = F.col("delivered_on").isNotNull(), F.col("open_appointment").isNotNull()
    step = F.when(~born, "ANTENATAL").when(~F.col("has_early"), "POSTPARTUM_EARLY").when(~F.col("has_late"), "POSTPARTUM_LATE").otherwise("DONE")
    written = app & (~born | (F.to_date("appointment_given") >= F.to_date("delivered_on"))) & (step != "DONE")
    due = (
        F.when(step == "DONE", F.lit(None)).when(written, F.to_date("open_appointment")).when(~born, F.date_add(F.to_date("last_visit"), 28))
        .otherwise(F.date_add(F.to_date("delivered_on"), F.when(step == "POSTPARTUM_EARLY", 7).otherwise(42)))
    )
    anchor = F.when(step == "DONE", "DELIVERY").when(written, "WRITTEN").when(born, "DELIVERY").when(F.col("last_visit").isNotNull(), "LAST_VISIT")
    rows = patients.select("patient_id", step.alias("step"), due.alias("due"), anchor.alias("anchor")).withColumn("days_late", F.coalesce(days_late(F.lit(as_of).cast("timestamp"), F.col("due")), F.lit(0)))
    return rows.withColumn("bucket", F.when(F.col("step") == "DONE", "DONE").when(F.col("due").isNull(), "LATER").otherwise(due_bucket(F.col("days_late"))))


def profiles(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each patient: what the population panels count. pages: record_id, page_idx, patient_id, created_at. Only KNOWN values count."""
    sure = fields.where("status = 'KNOWN'")
    of_page = pages.select(*PAGE, "patient_id", "created_at")
    v = series_values(sure).join(of_page, PAGE)
    anc = F.col("page_kind") == "antenatal"
    m = lambda name: F.when(anc & (F.col("measure") == name), F.col("num"))
    test = lambda t: F.min(F.when(anc & (F.col("measure") == t), F.when(F.col("code") == "pos", 1).when(F.col("code") == "neg", 2)))
    by_visit = v.groupBy("patient_id").agg(
        F.avg(F.when(anc & (F.col("measure") == "bp"), F.col("sys"))).alias("systolic"), F.avg(F.when(anc & (F.col("measure") == "bp"), F.col("dia"))).alias("diastolic"), F.avg(m("hemoglobin")).alias("hemoglobin"),
        F.avg(F.when((F.col("page_kind") == "postpartum_mother") & (F.col("measure") == "temperature"), F.col("num"))).alias("temperature"), F.when(F.min(m("gaWeeks")).isNotNull(), F.least(F.min(m("gaWeeks")), F.lit(99.0))).alias("firstGa"),
        F.count_distinct(F.when(anc & (F.col("measure") == "date"), F.col("day"))).alias("n_visits"), *[test(t).alias(f"{t}_r") for t in ("hiv", "syphilis", "hbs", "hcv")])
    order = F.struct("created_at", "page_idx")
    f = series_facts(sure).join(of_page, PAGE)
    fact = lambda name, c: F.max_by(F.when(F.col("name") == name, F.col(c)), F.when((F.col("name") == name) & F.col(c).isNotNull(), order))
    born = f.where("page_kind = 'delivery'").groupBy("patient_id").agg(fact("mode", "word").alias("mode"), fact("birthWeight", "num").alias("birthWeight"), fact("gaWeeks", "num").alias("gaAtBirth"))
    ticked = sure.where((F.col("page_type") == "accouchement") & (F.col("value") == "true") & F.col("key").startswith("lieu_")).join(of_page, PAGE)
    rank = F.array_position(F.array(*map(F.lit, PLACES)), F.regexp_replace("key", "^lieu_", ""))
    of_page_place = ticked.groupBy("patient_id", *PAGE, "created_at").agg(F.min(F.when(rank > 0, rank).otherwise(len(PLACES))).alias("r"))
    place = of_page_place.groupBy("patient_id").agg(F.max_by("r", order).alias("r")).select("patient_id", F.element_at(F.array(*map(F.lit, PLACES)), F.col("r").cast("int")).alias("place"))
    rows = once(fields.where("page_type = 'grossesse_actuelle'"), __cut=F.split("label", r"\|", 2))
    rows = once(once(rows, __row=fold(F.get("__cut", 0))), __m=_first(F.col("__row"), ROWS))
    shows = [f"{t}_row" for t in ("hiv", "syphilis", "hbs", "hcv")]
    of_its_rows = rows.groupBy(*PAGE).agg(*[F.max((F.col("__m") == c.removesuffix("_row")).cast("int")).alias(c) for c in shows])  # a row for each page before anything is dealt
    shown = of_its_rows.join(of_page, PAGE).groupBy("patient_id").agg(F.lit(True).alias("antenatal"), *[F.max(c).alias(c) for c in shows])
    out = of_page.select("patient_id").distinct().join(by_visit, "patient_id", "left").join(born, "patient_id", "left").join(place, "patient_id", "left").join(shown, "patient_id", "left")
    antenatal = F.coalesce("antenatal", F.lit(False))
    outcome = lambda t: F.when(F.col(f"{t}_r") == 1, "pos").when(F.col(f"{t}_r") == 2, "neg").when(F.coalesce(f"{t}_row", F.lit(0)) == 1, "notRecorded")
    return out.select(
        "patient_id", antenatal.alias("antenatal"), "systolic", "diastolic", "hemoglobin", "temperature", "firstGa", F.coalesce("n_visits", F.lit(0)).alias("n_visits"), "mode", "place", "birthWeight", "gaAtBirth",
        *[outcome(t).alias(t) for t in ("hiv", "syphilis", "hbs", "hcv")])
