"""Commands to the record store, replayed: which are carried out, which are refused and why, and the events that follow.

A record is a capture of pages. It is read, checked, validated and linked to a
patient; each command is allowed or not by the record's state, its pages and
their open fields. Commands come as a table or as a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lifecycle import TRANSITIONS
from .replay import as_they_come, in_order

MOST_CODE = 20
REPLAYED = "record_id string, command_id bigint, verb string, verdict string, state string, n_pages int, code string, linked boolean, events array<struct<state:string,note:string>>"


@dataclass
class Record:
    """state: None before the record is made. pages: by index, whether read, the error, how many fields are open."""

    state: str | None = None
    pages: list[dict] = field(default_factory=list)
    code: str | None = None
    linked: bool = False

    def page(self, index: int | None) -> dict | None:
        return next((p for p in self.pages if p["index"] == index), None)

    def may(self, state: str) -> bool:
        return state in TRANSITIONS[self.state]


class Refused(Exception):
    pass


def refuse(when: bool, why: str) -> None:
    if when:
        raise Refused(why)


def unread(index: int) -> dict:
    return {"index": index, "read": False, "error": None, "open": 0}


def number(c: dict) -> int:
    """The argument as a number; 0 if it is none."""
    return int(c["arg"]) if (c["arg"] or "").isdecimal() else 0


def create(r: Record, c: dict) -> list:
    refuse(r.state is not None, "exists")
    r.pages = [unread(k) for k in range(number(c))]
    return ["CAPTURED", "PENDING_AI"]


def add_page(r: Record, c: dict) -> list:
    """A page may come as long as the record can still be captured; a record that was read is read again."""
    refuse(r.state not in ("PENDING_AI", "CAPTURED") and not r.may("CAPTURED"), "closed")
    index = max((p["index"] for p in r.pages), default=-1) + 1
    r.pages.append(unread(index))
    again = [] if r.state in ("PENDING_AI", "CAPTURED") else [("CAPTURED", f"ADD page {index}")]
    return again + ["PENDING_AI"] * (r.state != "PENDING_AI")


def reading(r: Record, c: dict) -> list:
    """The outcome of a page's reading. Once no page waits, the record goes on; it fails if no page could be read."""
    page = r.page(c["page_idx"])
    refuse(page is None, "no_page")
    refuse(page["read"] or page["error"] is not None, "not_waiting")
    page |= {"read": True, "open": number(c)} if c["verb"] == "read" else {"error": c["arg"] or "?"}
    if r.state != "PENDING_AI" or any(not p["read"] and p["error"] is None for p in r.pages):
        return []
    if any(p["read"] for p in r.pages):
        return ["AI_PROCESSED", "NEEDS_REVIEW"]
    return [("PROCESSING_FAILED", min(r.pages, key=lambda p: p["index"])["error"])]


def retry(r: Record, c: dict) -> list:
    refuse(not r.may("PENDING_AI"), "refused")
    for p in r.pages:
        p["error"] = None
    return [("PENDING_AI", "RETRY")]


def replace_page(r: Record, c: dict) -> list:
    page = r.page(c["page_idx"])
    refuse(page is None, "no_page")
    refuse(not r.may("CAPTURED"), "refused")
    page |= unread(page["index"])
    return [("CAPTURED", f"RETAKE page {page['index']}"), "PENDING_AI"]


def drop_page(r: Record, c: dict) -> list:
    page = r.page(c["page_idx"])
    refuse(page is None, "no_page")
    refuse(page["read"], "page_read")
    refuse(len(r.pages) == 1, "only_page")
    r.pages.remove(page)
    return [(r.state, f"DROP page {page['index']}")]


def set_code(r: Record, c: dict) -> list:
    code = (c["arg"] or "").strip().upper()
    refuse(len(code) > MOST_CODE, "code_too_long")
    refuse(not code, "code_empty")
    refuse(r.linked, "patient_chosen")
    r.code = code
    return [(r.state, "CODE")]


def review(r: Record, c: dict) -> list:
    """So many fields of a page are still open after it was looked at."""
    page = r.page(c["page_idx"])
    refuse(page is None, "no_page")
    refuse(not page["read"], "unread_page")
    page["open"] = number(c)
    return []


def validate(r: Record, c: dict) -> list:
    for p in sorted(r.pages, key=lambda p: p["index"]):
        refuse(not p["read"], "unread_page")
        refuse(p["open"] > 0, "open_fields")
    refuse(not r.may("VALIDATED"), "refused")
    return ["VALIDATED"]


def link(r: Record, c: dict) -> list:
    """To a new patient or a known one; who isn't sure puts it off."""
    refuse(not r.code, "no_code")
    if c["arg"] == "UNSURE":
        return ["SUSPECTED_DUPLICATE"] if r.state == "VALIDATED" else []
    refuse(c["arg"] not in ("CREATE", "EXISTING"), "no_patient")
    refuse(not r.may("PATIENT_LINKED"), "refused")
    r.linked = True
    return [("PATIENT_LINKED", c["arg"]), "SAVED", "SYNCED"]


VERBS = {
    "create": create, "add_page": add_page, "read": reading, "failed": reading, "retry": retry, "replace_page": replace_page, "drop_page": drop_page, "set_code": set_code, "review": review, "validate": validate, "link": link,
}


def step(r: Record, c: dict) -> tuple:
    events, verdict = [], "done"
    try:
        refuse(c["verb"] not in VERBS, "unknown_verb")
        refuse(r.state is None and c["verb"] != "create", "no_record")
        events = [e if isinstance(e, tuple) else (e, None) for e in VERBS[c["verb"]](r, c)]
    except Refused as why:
        verdict = str(why)
    r.state = events[-1][0] if events else r.state
    return c["record_id"], c["command_id"], c["verb"], verdict, r.state, len(r.pages), r.code, r.linked, [{"state": s, "note": note} for s, note in events]


def _ready(commands: DataFrame) -> DataFrame:
    return commands.select(F.col("record_id").cast("string").alias("record_id"), F.col("command_id").cast("bigint").alias("command_id"), "verb", F.col("page_idx").cast("int").alias("page_idx"), F.col("arg").cast("string").alias("arg"))


def replayed(commands: DataFrame) -> DataFrame:
    """A row for each command, in the order of command_id in its record: verdict (done, or why not), the record after it, its events.

    commands: record_id, command_id, verb, page_idx, arg (create: how many
    photos; read, review: how many open fields; failed: the error; set_code:
    the code; link: CREATE, EXISTING, UNSURE, anything else for no such patient).
    """
    return in_order(_ready(commands), "record_id", ["command_id"], Record, step, REPLAYED)


def carried_out(commands: DataFrame) -> DataFrame:
    """replayed() of a stream of commands."""
    return as_they_come(_ready(commands), "record_id", ["command_id"], Record, step, REPLAYED)


def events_of(done: DataFrame) -> DataFrame:
    """record_id, command_id, place, state, note: the event log that replayed commands leave."""
    return done.select("record_id", "command_id", F.posexplode("events").alias("place", "e")).select("record_id", "command_id", "place", "e.state", "e.note")
