"""Record lifecycle over event logs: states, transitions, edits, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which state may follow which.
TRANSITIONS = {
    "CAPTURED": ["PENDING_AI", "MANUAL_REVIEW_REQUIRED"],
    "PENDING_AI": ["AI_PROCESSED", "PROCESSING_FAILED"],
    "AI_PROCESSED": ["NEEDS_REVIEW"],
    "NEEDS_REVIEW": ["VALIDATED", "CAPTURED", "MANUAL_REVIEW_REQUIRED"],
    "MANUAL_REVIEW_REQUIRED": ["VALIDATED", "CAPTURED"],
    "PROCESSING_FAILED": ["PENDING_AI", "MANUAL_REVIEW_REQUIRED", "CAPTURED"],
    "VALIDATED": ["PATIENT_LINKED", "SUSPECTED_DUPLICATE"],
    "SUSPECTED_DUPLICATE": ["PATIENT_LINKED"],
    "PATIENT_LINKED": ["SAVED"],
    "SAVED": ["SYNCED", "SYNC_FAILED"],
    "SYNC_FAILED": ["SYNCED", "SAVED"],
    "SYNCED": [],
}
# Statuses that ask for a look; what is unknown on paper is settled.
TO_REVIEW = ["NEEDS_REVIEW", "ILLEGIBLE"]
# States that wait for the network.
WAITING = ["CAPTURED", "PENDING_AI", "SAVED", "SYNC_FAILED"]


def may_follow(before: Column, after: Column, transitions: Mapping[str, Sequence[str]] = TRANSITIONS) -> Column:
    out = F.lit(False)
    for state, nexts in transitions.items():
        out = F.when(before == state, after.isin(*nexts) if nexts else F.lit(False)).otherwise(out)
    return out


def illegal_moves(events: DataFrame, entity: str, order: Sequence[str], state: str, transitions: Mapping[str, Sequence[str]] = TRANSITIONS) -> DataFrame:
    """Events whose state may not follow the entity's previous one."""
    w = Window.partitionBy(entity).orderBy(*order)
    moves = events.withColumn("from_state", F.lag(state).over(w)).withColumn("to_state", F.col(state))
    return moves.where(F.col("from_state").isNotNull() & ~may_follow(F.col("from_state"), F.col("to_state"), transitions))


def current_state(events: DataFrame, entity: str, order: Sequence[str], state: str) -> DataFrame:
    """entity, state (of its last event), n_events."""
    return events.groupBy(entity).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("n_events"))


def validation_blockers(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """record_id, unread_pages, open_fields of the records that may not be validated yet.

    pages: record_id, fields_read (boolean); fields: record_id, status.
    """
    unread = pages.groupBy("record_id").agg(F.count_if(~F.col("fields_read")).alias("unread_pages"))
    open_fields = fields.groupBy("record_id").agg(F.count_if(F.col("status").isin(*TO_REVIEW)).alias("open_fields"))
    both = unread.join(open_fields, "record_id", "full")
    return both.select("record_id", F.coalesce("unread_pages", F.lit(0)).alias("unread_pages"), F.coalesce("open_fields", F.lit(0)).alias("open_fields")).where("unread_pages > 0 or open_fields > 0")


def edited_fields(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """The fields after their edits, oldest first: value, status, origin, ai_value, n_edits.

    fields: field_id, value, status, origin; edits: field_id, at, action
    (confirm or set), value, status. Confirming keeps the value and makes it
    KNOWN (NOT_PROVIDED if null); setting another value corrects, the same one
    confirms; manual fields stay manual; the first set on a read value keeps it.
    """
    log = edits.groupBy("field_id").agg(F.array_sort(F.collect_list(F.struct("at", "action", "value", "status"))).alias("log"))
    start = F.struct(F.col("value").cast("string").alias("value"), F.col("status").alias("status"), F.col("origin").alias("origin"), F.lit(None).cast("string").alias("ai_value"), F.lit(False).alias("kept"))

    def step(s, e):
        confirm, manual = e["action"] == "confirm", s["origin"] == "MANUAL"
        same = s["value"].eqNullSafe(e["value"]) & s["status"].eqNullSafe(e["status"])
        keep_ai = ~confirm & (s["origin"] == "AI") & ~s["kept"]
        return F.struct(
            F.when(confirm, s["value"]).otherwise(e["value"]).alias("value"),
            F.when(confirm, F.when(s["value"].isNull(), "NOT_PROVIDED").otherwise("KNOWN")).otherwise(e["status"]).alias("status"),
            F.when(manual, "MANUAL").when(confirm | same, "CONFIRMED").otherwise("CORRECTED").alias("origin"),
            F.when(keep_ai, s["value"]).otherwise(s["ai_value"]).alias("ai_value"),
            (s["kept"] | keep_ai).alias("kept"),
        )

    out = fields.join(log, "field_id", "left").withColumn("s", F.aggregate(F.coalesce("log", F.array().cast(log.schema["log"].dataType)), start, step))
    return out.select("field_id", "s.value", "s.status", "s.origin", "s.ai_value", F.coalesce(F.size("log"), F.lit(0)).alias("n_edits"))


def superseded_pages(pages: DataFrame) -> DataFrame:
    """page_id, supersedes: the patient's latest earlier page of the same type; unknown types replace nothing.

    pages: page_id, patient_id, page_type, created_at.
    """
    w = Window.partitionBy("patient_id", "page_type").orderBy("created_at", "page_id")
    known = F.col("page_type").isNotNull() & (F.col("page_type") != "inconnue")
    return pages.where(known).select("page_id", F.lag("page_id").over(w).alias("supersedes"))


def visits_for(records: DataFrame, visits: DataFrame) -> DataFrame:
    """record_id, visit_id, is_new: the visit of the patient on that day, or a new one shared by the day's records.

    records: record_id, patient_id, created_at; visits: visit_id, patient_id, date.
    """
    day = F.to_date("created_at")
    known = visits.groupBy("patient_id", F.to_date("date").alias("day")).agg(F.min("visit_id").alias("known_id"))
    out = records.withColumn("day", day).join(known, ["patient_id", "day"], "left")
    made = F.concat(F.lit("vis_"), F.substring(F.sha2(F.concat_ws("|", "patient_id", F.col("day").cast("string")), 256), 1, 12))
    return out.select("record_id", F.coalesce("known_id", made).alias("visit_id"), F.col("known_id").isNull().alias("is_new"))


def next_action(state: Column, online: Column) -> Column:
    """What a record waits for."""
    return (
        F.when(state.isin("CAPTURED", "PENDING_AI", "SAVED"), F.when(online, "NONE").otherwise("WAIT_NETWORK")).when(state.isin("NEEDS_REVIEW", "MANUAL_REVIEW_REQUIRED"), "REVIEW")
        .when(state.isin("VALIDATED", "SUSPECTED_DUPLICATE"), "LINK").when(state.isin("PROCESSING_FAILED", "SYNC_FAILED"), "RETRY").otherwise("NONE")
    )


def next_page_index(pages: DataFrame) -> DataFrame:
    """record_id, next_idx: the index a new page gets; 0 for a record without pages (a row with a null page_idx)."""
    return pages.groupBy("record_id").agg((F.coalesce(F.max("page_idx"), F.lit(-1)) + 1).alias("next_idx"))


def dropped_pages(pages: DataFrame, commands: DataFrame) -> DataFrame:
    """record_id, page_idx, at, verdict of each command to drop a page: dropped, or no_page, page_read, only_page.

    pages: record_id, page_idx, is_read; commands: record_id, page_idx, at.
    Read pages stay and so does a record's last page. Commands count in the
    order of at, then page_idx; a second one for a page finds none.
    """
    of_page = Window.partitionBy("record_id", "page_idx").orderBy("at")
    sizes = pages.groupBy("record_id").agg(F.count("*").alias("n_pages"))
    rows = commands.withColumn("again", F.row_number().over(of_page)).join(pages, ["record_id", "page_idx"], "left").join(sizes, "record_id", "left")
    first = F.when(F.col("is_read").isNull(), "no_page").when(F.col("is_read"), "page_read").when((F.col("again") > 1) & (F.col("n_pages") > 1), "no_page")
    rows = rows.withColumn("verdict", first)
    so_far = F.count_if(F.col("verdict").isNull()).over(Window.partitionBy("record_id").orderBy("at", "page_idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("place", so_far)
    return rows.select("record_id", "page_idx", "at", F.coalesce("verdict", F.when(F.col("place") < F.col("n_pages"), "dropped").otherwise("only_page")).alias("verdict"))


def drop_events(drops: DataFrame, states: DataFrame) -> DataFrame:
    """record_id, state, at, note: an event with the record's present state for each page that was dropped. states: record_id, state."""
    done = drops.where("verdict = 'dropped'").join(states, "record_id")
    return done.select("record_id", "state", "at", F.concat(F.lit("DROP page "), F.col("page_idx")).alias("note"))


def suggested_codes(fields: DataFrame, most: int = 20) -> DataFrame:
    """record_id, code: the first legible value of a record label, by page and place, that is a code once cleaned."""
    from ..functions.text import is_record_label

    code = F.upper(F.regexp_replace("value", r"[^A-Za-z0-9\-/]", ""))
    rows = fields.where((F.coalesce("status", F.lit("")) != "ILLEGIBLE") & is_record_label(F.col("label"))).select("record_id", "page_idx", "ordinal", code.alias("code"))
    return rows.where(F.length("code").between(1, most)).groupBy("record_id").agg(F.min_by("code", F.struct("page_idx", "ordinal")).alias("code"))


def added_fields(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """record_id, page_idx, at, label, refused, key, kind, value, status: fields that a person adds by label and text.

    requests: record_id, page_idx, at, label, text; fields: record_id, page_idx,
    key. refused: too_short or personal; such rows have no key. A key that is
    taken gets underscores, requests of one page in the order of at.
    """
    from ..functions.text import infer_kind, is_personal, slug, special_word
    from ..functions.values import parse
    from .series import once

    label, text = F.substring(F.trim(F.regexp_replace("label", r"\s+", " ")), 1, 80), F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 120)
    rows = requests.select("record_id", "page_idx", "at", label.alias("label"), text.alias("text"))
    rows = rows.withColumn("personal", is_personal(F.col("label"), F.col("text")))
    rows = rows.withColumn("refused", F.when(F.length("label") < 2, "too_short").when(F.col("personal"), "personal"))
    rows = rows.withColumn("base", F.when(F.col("refused").isNull(), F.coalesce(F.nullif(slug(F.col("label")), F.lit("")), F.lit("champ"))))
    taken = fields.select("record_id", "page_idx", F.regexp_replace("key", "_+$", "").alias("base"), (F.length("key") - F.length(F.regexp_replace("key", "_+$", ""))).alias("n"))
    taken = taken.groupBy("record_id", "page_idx", "base").agg(F.collect_set("n").alias("taken"))
    nth = F.row_number().over(Window.partitionBy("record_id", "page_idx", "base").orderBy("at", "label"))
    rows = rows.withColumn("nth", nth).join(taken, ["record_id", "page_idx", "base"], "left")
    used = F.coalesce("taken", F.array().cast("array<int>"))
    free = F.get(F.array_except(F.sequence(F.lit(0), F.size(used) + F.col("nth")), used), F.col("nth") - 1)
    kind = infer_kind(F.col("label"))
    rows = once(rows, key=F.concat("base", F.repeat(F.lit("_"), free)), kind=F.when(F.col("base").isNotNull(), kind))
    empty, unknown = F.col("text").isin("", "-"), special_word(F.col("text")) == "unknown"
    status = F.when(empty, "NOT_PROVIDED").when(F.coalesce(unknown, F.lit(False)), "UNKNOWN").otherwise("KNOWN")
    rows = once(rows, status=F.when(F.col("base").isNotNull(), status))
    # parse stands in a lambda: with all its branches one generated method would be too large to compile
    read = F.element_at(F.transform(F.array("text"), lambda t: parse(F.col("kind"), t, F.lit(""))["value"]), 1)
    value = F.when(F.col("status") == "KNOWN", F.coalesce(read, F.col("text")))
    return rows.select("record_id", "page_idx", "at", "label", "refused", "key", "kind", value.alias("value"), "status")


def copied_identifiers(codes: DataFrame, ids: DataFrame) -> DataFrame:
    """page_id, code: codes that repeat an identifier of their page, misread perhaps, or look like an identity number where the page has one.

    codes: page_id, code; ids: page_id, value. A code is compared with the
    identifiers of its own page only.
    """
    from ..functions.text import ID_PREFIX, ID_SHAPE, same_identifier

    number = lambda c: F.col(c).rlike(ID_PREFIX) | F.upper(F.col(c)).rlike(ID_SHAPE)
    pairs = codes.where("code <> ''").join(ids.select("page_id", "value"), "page_id")
    hit = (number("code") & number("value")) | same_identifier(F.col("code"), F.col("value"))
    return pairs.where(hit).select("page_id", "code").distinct()


def waiting_for_network(records: DataFrame) -> DataFrame:
    """n_waiting: records whose next step needs the network, failed uploads included. records: state."""
    return records.agg(F.count_if(F.col("state").isin(WAITING)).alias("n_waiting"))


def unread_pages(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages that were neither read nor refused so far: what a start after a stop still has to read. done: page_id."""
    return pages.join(done.select("page_id").distinct(), "page_id", "left_anti")


def moves_after_reading(records: DataFrame, pages: DataFrame) -> DataFrame:
    """record_id, place, state, note: the events that the reading of a record's pages leads to.

    records: record_id, state; pages: record_id, page_idx, is_read, error. Only
    records in PENDING_AI move, and only once no page waits: to
    PROCESSING_FAILED with the first page's error if none could be read, else
    to AI_PROCESSED and NEEDS_REVIEW. Records without pages fail without a note.
    """
    read = F.coalesce("is_read", F.lit(False))
    counts = pages.groupBy("record_id").agg(F.count_if(~read & F.col("error").isNull()).alias("waiting"), F.count_if(read).alias("read"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_idx"))).alias("error"))
    ready = records.where("state = 'PENDING_AI'").select("record_id").join(counts, "record_id", "left").where("coalesce(waiting, 0) = 0")
    event = lambda state, note: F.struct(F.lit(state).alias("state"), note.alias("note"))
    none = F.lit(None).cast("string")
    moves = F.when(F.col("read") > 0, F.array(event("AI_PROCESSED", none), event("NEEDS_REVIEW", none))).otherwise(F.array(event("PROCESSING_FAILED", F.col("error").cast("string"))))
    return ready.select("record_id", F.posexplode(moves).alias("place", "m")).select("record_id", "place", "m.state", "m.note")
