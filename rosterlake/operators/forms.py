"""Readings to contract fields: page classification, keys and sections, duplicates, options, sections and grids, snapshots.

Long tables: fields are page_id, ordinal, id, label, kind, value, status and
others; reference forms are page_type, type_rank, ref_id, ref_label, section.
Order is data here, so it is always a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, slug, tokens
from .lifecycle import TO_REVIEW

OTHER_SECTION = "Autres champs lus"
UNKNOWN_PAGE = "unknown"
LEAST_LABELS = 3
EMPTY = ["NOT_PROVIDED", "NOT_APPLICABLE"]
FINAL_KEYS = ["record_id", "page_idx", "ordinal", "key", "label", "kind", "section", "value", "status", "origin"]


def classify(fields: DataFrame, forms: DataFrame, fallback: DataFrame, least: int = LEAST_LABELS) -> DataFrame:
    """page_id, page_type: the form that shares most folded labels (least at the fewest; ties to the first form), else the fallback's (page_id, page_type), else unknown."""
    from .joins import overlap_argmax

    seen = fields.select("page_id", fold(F.col("label")).alias("w"))
    known = forms.select("page_type", "type_rank", fold(F.col("ref_label")).alias("w"))
    best = overlap_argmax(seen, known, "page_id", "page_type", "w", least, "type_rank").select("page_id", F.col("page_type").alias("best"))
    pages = fields.select("page_id").distinct().join(best, "page_id", "left").join(fallback.select("page_id", F.col("page_type").alias("other")), "page_id", "left")
    return pages.select("page_id", F.coalesce("best", "other", F.lit(UNKNOWN_PAGE)).alias("page_type"))


def contract_fields(fields: DataFrame, types: DataFrame, forms: DataFrame) -> DataFrame:
    """The fields with key, section and origin: a field whose label is on the page's form takes its key, the first of each key; keys that are taken get underscores."""
    ref = forms.select("page_type", fold(F.col("ref_label")).alias("w"), "ref_id", F.col("section").alias("ref_section"))
    rows = fields.withColumn("w", fold(F.col("label"))).join(types, "page_id").join(ref, ["page_type", "w"], "left")
    first = F.row_number().over(Window.partitionBy("page_id", "ref_id").orderBy("ordinal"))
    rows = rows.withColumn("wanted", F.when(F.col("ref_id").isNotNull() & (first == 1), F.col("ref_id")).otherwise(F.col("id")))
    same = F.row_number().over(Window.partitionBy("page_id", "wanted").orderBy("ordinal"))
    keyed = rows.withColumn("n", same).withColumn("key", F.concat("wanted", F.repeat(F.lit("_"), F.col("n") - 1)))
    # a key with underscores may be taken by another field that is called so: the later one gets one more for each
    clash = F.row_number().over(Window.partitionBy("page_id", "key").orderBy("n", "ordinal"))
    keyed = keyed.withColumn("key", F.concat("key", F.repeat(F.lit("_"), clash - 1)))
    return keyed.withColumn("section", F.coalesce("ref_section", F.lit(OTHER_SECTION))).withColumn("origin", F.when(F.col("source") == "humain", "MANUAL").otherwise("AI")).drop("w", "ref_id", "ref_section", "wanted", "n")


def deduplicated(fields: DataFrame) -> DataFrame:
    """Without fields whose folded label, value and status came before; id from the label, numbered from the second of a name."""
    rows = fields.withColumn("w", fold(F.col("label")))
    again = F.row_number().over(Window.partitionBy("page_id", "w", "value", "status").orderBy("ordinal"))
    rows = rows.withColumn("r", again).where("r = 1").withColumn("base", F.coalesce(F.nullif(slug(F.col("label")), F.lit("")), F.lit("champ")))
    n = F.row_number().over(Window.partitionBy("page_id", "base").orderBy("ordinal"))
    return rows.withColumn("n", n).withColumn("id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "n"))).drop("w", "r", "base", "n")


def expand_groups(fields: DataFrame) -> DataFrame:
    """A row for each option of a group (label, kind checkbox, value true or null, status); fields without options as they are."""
    checked = F.transform(F.split(F.coalesce("value", F.lit("")), ","), fold)
    has = F.coalesce(F.size("options"), F.lit(0)) > 0
    rows = fields.withColumn("option", F.explode_outer(F.when(has, F.col("options")))).withColumn("on", F.col("option").isNotNull() & F.array_contains(checked, fold(F.col("option"))))
    option = F.col("option").isNotNull()
    status = F.when(F.col("on"), "KNOWN").when(F.col("status") == "NEEDS_REVIEW", "NEEDS_REVIEW").otherwise("NOT_PROVIDED")
    return rows.withColumns({
        "label": F.when(option, F.concat_ws(" ", "label", "option")).otherwise(F.col("label")), "kind": F.when(option, "checkbox").otherwise(F.col("kind")),
        "value": F.when(option, F.when(F.col("on"), "true")).otherwise(F.col("value")), "status": F.when(option, status).otherwise(F.col("status")),
    }).drop("option", "on", "options")


def collapse_boxes(boxes: DataFrame) -> DataFrame:
    """page_id, head, value, options, status: the ticked options of a group in order; any doubtful box makes the group doubtful. boxes: page_id, head, ordinal, option, state."""
    agg = boxes.groupBy("page_id", "head").agg(F.array_sort(F.collect_list(F.struct("ordinal", "option", "state"))).alias("b"))
    on = F.array_join(F.transform(F.filter("b", lambda x: x["state"]), lambda x: x["option"]), ", ")
    doubt = F.exists("b", lambda x: x["state"].isNull())
    value = F.nullif(on, F.lit(""))
    return agg.select("page_id", "head", value.alias("value"), F.transform("b", lambda x: x["option"]).alias("options"), F.when(doubt, "NEEDS_REVIEW").when(value.isNull(), "NOT_PROVIDED").otherwise("KNOWN").alias("status"))


def matched_to_form(fields: DataFrame, forms: DataFrame) -> DataFrame:
    """page_id, ref_id, pred_id, score: gold fields of the page's form matched to expanded readings, one to one."""
    from .joins import greedy_match

    preds = expand_groups(fields).withColumn("pred_order", F.row_number().over(Window.partitionBy("page_id").orderBy("ordinal", "label"))).select("page_id", F.concat_ws("#", "id", "pred_order").alias("pred_id"), "pred_order", tokens(F.col("label")).alias("tokens"))
    refs = fields.select("page_id", "page_type").distinct().join(forms, "page_type").select("page_id", "ref_id", "ref_order", tokens(F.col("ref_label")).alias("tokens"))
    return greedy_match(refs, preds, "page_id")


def section_counts(fields: DataFrame) -> DataFrame:
    """record_id, section, known, review, edited, empty, total: each field counts once, the first that fits of review, empty, edited, known."""
    state = F.when(F.col("status").isin(*TO_REVIEW), "review").when(F.col("status").isin(*EMPTY), "empty").when(F.col("origin").isin("CORRECTED", "MANUAL"), "edited").otherwise("known")
    count = lambda s: F.count_if(F.col("s") == s).alias(s)
    return fields.withColumn("s", state).groupBy("record_id", "section").agg(count("known"), count("review"), count("edited"), count("empty"), F.count("*").alias("total"))


def reading_quality(fields: DataFrame) -> DataFrame:
    """pages_read, auto_read_percent, human_checked: how many pages gave fields, which share of what is written was read without help, how many fields a person looked at.

    fields: record_id, page_idx, status, origin. The share is rounded half up, null if nothing is written.
    """
    written = F.coalesce(~F.col("status").isin(*EMPTY), F.lit(True))
    auto = F.count_if((F.col("origin") == "AI") & (F.col("status") == "KNOWN"))
    share = F.floor(F.try_divide(100 * auto, F.count_if(written)) + 0.5).cast("int")
    return fields.agg(F.count_distinct("record_id", "page_idx").alias("pages_read"), share.alias("auto_read_percent"), F.count_if(~F.col("origin").eqNullSafe("AI")).alias("human_checked"))


def grid_cells(fields: DataFrame) -> DataFrame:
    """page_id, row, col, value of the rows that form grids: two columns or more, and the same columns as another row."""
    cut = F.split("label", r"\|", 2)
    cells = fields.where(F.col("label").contains("|")).select("page_id", F.trim(F.get(cut, 0)).alias("row"), F.trim(F.get(cut, 1)).alias("col"), "value")
    sets = cells.groupBy("page_id", "row").agg(F.array_sort(F.collect_set("col")).alias("cols")).where(F.size("cols") >= 2)
    shared = sets.groupBy("page_id", "cols").agg(F.count("*").alias("n")).where("n >= 2")
    return cells.join(sets.join(shared, ["page_id", "cols"]).select("page_id", "row"), ["page_id", "row"], "left_semi")


def booklet_position(page_number: Column, pages: int = 8) -> tuple[Column, Column]:
    """(patient, position) of a page in booklets of eight pages, both from 1."""
    return F.floor((page_number - 1) / pages).cast("int") + 1, F.pmod(page_number - 1, F.lit(pages)).cast("int") + 1


def snapshot(patients: DataFrame, visits: DataFrame, records: DataFrame) -> DataFrame:
    """One nested row for each patient: visits with their records, oldest first. Records are grouped before they are joined."""
    by_visit = records.groupBy("visit_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "record_id", "state"))).alias("records"))
    rows = visits.join(by_visit, "visit_id", "left").groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("date", "visit_id", "records"))).alias("visits"))
    return patients.join(rows, "patient_id", "left")


# Sections whose entries are told in a patient's summary, and what is told of earlier deliveries and vaccines.
NOTED_SECTIONS = ["Antécédents héréditaires et familiaux", "Antécédents de la femme", "Antécédents obstétricaux", "Complications"]
DELIVERY_COLUMNS = ["date", "modalite", "poids", "complication"]
VACCINES = ["rubeole", "hepatite_b"]
HISTORY_PAGE = "identification_antecedents"


def noted_facts(latest: DataFrame) -> DataFrame:
    """The certain entries of the noted sections that say more than "nothing to report".

    latest: a patient's newest fields: patient_id, page_type, key, section,
    value, status. Null values and unknown sections are left out.
    """
    from ..functions.reading import noteworthy

    return latest.where(F.col("section").isin(NOTED_SECTIONS) & (F.col("status") == "KNOWN") & noteworthy(F.col("value")))


def previous_deliveries(latest: DataFrame, most: int = 5) -> DataFrame:
    """patient_id, place and the columns of each earlier delivery of which something is written: at most ``most`` rows a patient, as the form has."""
    part = lambda k: F.regexp_extract("key", rf"^acc(\d)_({'|'.join(DELIVERY_COLUMNS)})$", k)
    rows = latest.where((F.col("page_type") == HISTORY_PAGE) & F.col("value").isNotNull()).select("patient_id", "value", part(1).try_cast("int").alias("place"), part(2).alias("c"))
    return rows.where(F.col("place").between(1, most)).groupBy("patient_id", "place").agg(*[F.max(F.when(F.col("c") == c, F.col("value"))).alias(c) for c in DELIVERY_COLUMNS])


def vaccinations(latest: DataFrame) -> DataFrame:
    """patient_id, vaccine, ticked, date: seven rows for each patient with a history page, vat_1 to vat_5 without dates."""
    names = [*(f"vat_{n}" for n in range(1, 6)), *VACCINES]
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    one = lambda v: F.struct(F.lit(v).alias("vaccine"), F.coalesce(value(v) == "true", F.lit(False)).alias("ticked"), (value(f"{v}_date") if v in VACCINES else F.lit(None).cast("string")).alias("date"))
    rows = latest.where(F.col("page_type") == HISTORY_PAGE).groupBy("patient_id").agg(F.array(*map(one, names)).alias("v"))
    return rows.select("patient_id", F.inline("v"))
