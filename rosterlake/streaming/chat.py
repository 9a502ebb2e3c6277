"""A guided conversation over a stream of messages: photos of a register's pages come in, answers move it on.

One machine serves tables and streams. Everything that depends on a message
alone (the choice it makes, the kinds of value it would fit, whether it names a
person) is worked out in Spark beforehand; what is left for each message is one
step of the user's session: an action, and with it the command to the record
store. Messages of a user are taken in the order of time; users are independent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display as dp
from ..functions import text as tf
from .replay import as_they_come, in_order

# Answers and commands that users type, the machine's limits.
DONE = ["btn_done", "terminé", "termine", "terminer", "fini", "fin", "ok", "c'est tout"]
CANCEL = ["btn_cancel", "annuler", "/annuler", "stop"]
HELP = ["/aide", "/help", "/start", "aide"]
BACK = ["0", "retour"]
KINDS = ["text", "integer", "date", "weight", "length", "weeks", "sex", "checkbox"]
MOST_PAGES, MOST_CANDIDATES, IDLE_SECONDS = 10, 8, 7200
CODE = r"[A-Za-z0-9][A-Za-z0-9 \-_/]{0,19}"

# The state that an action leads to; the others stay where they are. Both ends of a record lead to idle.
LEADS_TO = {
    "cancelled": "idle", "page_saved": "collecting", "collected": "ask_code", "code_set": "review", "page_replaced": "review", "doubts_shown": "confirm_uncertain", "fields_shown": "choose_field",
    "photo_wanted": "retake", "label_wanted": "add_label", "value_wanted": "edit_value", "added_value_wanted": "add_value", "page_confirmed": "review", "page_dropped": "review", "value_set": "review",
    "field_added": "review", "field_refused": "review", "back": "review", "validated": "link", "dropped_and_validated": "link", "linked": "idle",
}

LOG = "user string, message_id bigint, from_state string, action string, to_state string, record_no int, page int, n_pages int, open_fields int, command string"


def features(messages: DataFrame, arabic: bool = True) -> DataFrame:
    """What the machine needs of each message.

    messages: user, message_id, at (timestamp), kind (image or text), text; of
    an image what its reading gives: error (boolean), kinds (of its fields, as
    they are shown), doubtful (their numbers, from 1), code (read on it);
    n_candidates (patients that the record may belong to).
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[️⃣]", ""), r"^\s+|\s+$", ""), r"[.)]+$", "")
    label = F.regexp_replace(text, r"\s+", " ")
    personal = tf.is_personal(label, F.lit(""), arabic)
    named = text.rlike(tf.PERSON_HEADER) | text.rlike(tf.ID_PREFIX)
    image = F.col("kind") == "image"
    return messages.select(
        F.col("user").cast("string").alias("user"), F.col("message_id").cast("bigint").alias("message_id"), F.unix_micros("at").alias("at"), image.alias("image"), text.alias("text"),
        F.when(plain.rlike(r"^\d{1,3}$"), plain.cast("int")).alias("choice"), F.filter(F.array(*[F.when(dp.typed(F.lit(k), text)["status"].isNotNull(), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull()).alias("fits"),
        F.length(label).alias("label_length"), tf.infer_kind(label).alias("label_kind"), F.coalesce(personal, F.lit(False)).alias("personal_label"), F.coalesce(tf.is_record_label(label), F.lit(False)).alias("record_label"),
        F.coalesce(named, F.lit(False)).alias("personal_value"), F.coalesce(tf.has_personal_shape(text), F.lit(False)).alias("personal_shape"),
        F.coalesce("error", F.lit(False)).alias("error"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.coalesce("doubtful", F.array().cast("array<int>")).alias("doubtful"),
        F.col("code").cast("string").alias("code"), F.coalesce(F.col("n_candidates").cast("int"), F.lit(0)).alias("n_candidates"),
    )


@dataclass
class Session:
    """What is kept of a user between two messages."""

    state: str = "idle"
    record_no: int = 0
    at: int | None = None
    pages: list[dict] = field(default_factory=list)
    current: int = 0
    edit: int = 0
    label: dict | None = None
    candidates: int = 0

    def begin(self) -> None:
        self.state, self.pages, self.current, self.edit, self.label, self.candidates = "idle", [], 0, 0, None, 0

    @property
    def page(self) -> dict:
        return self.pages[self.current]

    @property
    def failed(self) -> bool:
        return self.page["error"] or not self.page["kinds"]

    @property
    def code(self) -> str | None:
        return next((p["code"] for p in self.pages if p["code"]), None)


def confirmed(s: Session) -> str:
    return "page_confirmed" if s.current + 1 < len(s.pages) else "validated"


def in_review(s: Session, m: dict) -> str:
    if s.failed:
        last = s.current == len(s.pages) - 1
        drop = "drop_refused" if not s.page["error"] else "dropped_and_validated" if last else "page_dropped"  # the store keeps pages that were read, empty ones too
        may = {4: "photo_wanted"} | ({5: drop} if len(s.pages) > 1 else {})
    else:
        may = {1: "doubts_shown" if s.page["doubtful"] else confirmed(s), 2: "fields_shown", 3: "values_shown", 4: "photo_wanted", 5: "label_wanted"}
    return may.get(m["choice"], "bad_choice")


def in_fields(s: Session, m: dict) -> str:
    answer = m["text"].lower()
    if answer in BACK:
        return "back"
    return "fields_shown" if answer == "tout" else "value_wanted" if m["choice"] is not None and 1 <= m["choice"] <= len(s.page["kinds"]) else "bad_field"


def in_value(s: Session, m: dict) -> str:
    if m["text"].lower() == BACK[1] or s.edit > len(s.page["kinds"]):
        return "back"
    return "value_set" if s.page["kinds"][s.edit - 1] in m["fits"] else "bad_value"


def in_added_value(s: Session, m: dict) -> str:
    if m["text"].lower() == BACK[1]:
        return "back"
    return "field_refused" if s.label["personal"] or m["personal_value"] or (m["personal_shape"] and not s.label["record"]) else "field_added"


#: What an answer does in each state.
ANSWERS = {
    "idle": lambda s, m: "greeted",
    "collecting": lambda s, m: "collected" if m["text"].lower() in DONE else "more_wanted",
    "ask_code": lambda s, m: "code_set" if re.fullmatch(CODE, s.code if s.code and m["choice"] == 1 else m["text"]) else "bad_code",
    "review": in_review,
    "confirm_uncertain": lambda s, m: {1: confirmed(s), 2: "fields_shown"}.get(m["choice"], "bad_choice"),
    "choose_field": in_fields,
    "edit_value": in_value,
    "retake": lambda s, m: "back" if m["text"].lower() in BACK and not s.page["error"] else "photo_awaited",
    "add_label": lambda s, m: "back" if m["text"].lower() == BACK[1] else "added_value_wanted" if 2 <= m["label_length"] <= 80 else "bad_label",
    "add_value": in_added_value,
    "link": lambda s, m: "linked" if m["choice"] is not None and 1 <= m["choice"] <= s.candidates + 2 else "bad_choice",
}
#: What a photo does, where it isn't too many.
PHOTOS = {"idle": "page_saved", "collecting": "page_saved", "retake": "page_replaced", "ask_code": "code_first"}


def action_of(s: Session, m: dict) -> str:
    if m["image"]:
        act = PHOTOS.get(s.state, "busy")
        return "too_many_pages" if act == "page_saved" and len(s.pages) >= MOST_PAGES else act
    answer = m["text"].lower()
    if answer in HELP or answer == "/status":
        return "status" if answer == "/status" else "helped"
    if answer in CANCEL:
        return "nothing_to_cancel" if s.state == "idle" else "cancelled"
    return "unknown_command" if answer.startswith("/") else ANSWERS[s.state](s, m)


def step(s: Session, m: dict) -> tuple:
    """Moves the session on by one message; a row of the log."""
    if s.at is not None and m["at"] - s.at > IDLE_SECONDS * 1_000_000:
        s.begin()
    s.at, before, act, command = m["at"], s.state, action_of(s, m), None
    photo = {k: m[k] for k in ("error", "kinds", "doubtful", "code")}
    if act == "page_saved":
        index = max((p["index"] for p in s.pages), default=-1) + 1
        s.record_no += index == 0
        s.pages.append(photo | {"index": index})
        command = f"add_page {index}" if index else "create_record"
    elif act == "page_replaced":
        command = f"replace_page {s.page['index']}"
        s.pages[s.current] = photo | {"index": s.page["index"]}
    elif act == "code_set":
        command = f"set_code {s.code if s.code and m['choice'] == 1 else m['text']}"
    elif act in ("page_dropped", "dropped_and_validated"):
        command = f"drop_page {s.pages.pop(s.current)['index']}"
        s.current = min(s.current, len(s.pages) - 1)
    elif act == "value_wanted":
        s.edit = m["choice"]
    elif act == "value_set":
        command = f"set_field {s.page['index']} {s.edit}"
        s.page["doubtful"] = [x for x in s.page["doubtful"] if x != s.edit]
    elif act == "added_value_wanted":
        s.label = {"kind": m["label_kind"], "personal": m["personal_label"], "record": m["record_label"]}
    elif act == "field_added":
        command = f"add_field {s.page['index']}"
        s.page["kinds"] = [*s.page["kinds"], s.label["kind"]]
    elif act == "linked":
        command = f"link {'EXISTING ' + str(m['choice']) if m['choice'] <= s.candidates else 'CREATE' if m['choice'] == s.candidates + 1 else 'UNSURE'}"
    if before == "confirm_uncertain" and act in ("page_confirmed", "validated"):
        command = f"confirm_fields {s.page['index']}"
        s.page["doubtful"] = []
    if act == "page_confirmed":
        s.current += 1
    if act in ("validated", "dropped_and_validated"):
        command = "; ".join(filter(None, [command, "validate"]))
        s.candidates = min(m["n_candidates"], MOST_CANDIDATES)
    seen = bool(s.pages) and before not in ("idle", "collecting")
    shown = s.current + 1 if seen else 0, len(s.pages), len(s.page["doubtful"]) if seen else 0
    s.state = LEADS_TO.get(act, s.state)
    row = m["user"], m["message_id"], before, act, s.state, s.record_no, *shown, command
    if s.state == "idle":
        s.begin()
    return row


def log(messages: DataFrame, arabic: bool = True) -> DataFrame:
    """The log of a table of messages (as features() takes them): a row for each, with states, action and command."""
    return in_order(features(messages, arabic), "user", ["at", "message_id"], Session, step, LOG)


def followed(messages: DataFrame, arabic: bool = True) -> DataFrame:
    """log() of a stream of messages."""
    return as_they_come(features(messages, arabic), "user", ["at", "message_id"], Session, step, LOG)


def records_of(steps: DataFrame) -> DataFrame:
    """user, record_no, n_messages, n_pages, n_commands, outcome (linked, cancelled, or open) of the records that conversations opened."""
    ended = F.max_by("action", F.when(F.col("action").isin("linked", "cancelled"), F.col("message_id")))
    rows = steps.where("record_no > 0").where(~((F.col("from_state") == "idle") & (F.col("to_state") == "idle")))
    made = F.count_if(F.col("command").startswith("create_record") | F.col("command").startswith("add_page"))
    return rows.groupBy("user", "record_no").agg(F.count("*").alias("n_messages"), made.alias("n_pages"), F.count("command").alias("n_commands"), F.coalesce(ended, F.lit("open")).alias("outcome"))


def commands_of(steps: DataFrame, messages: DataFrame) -> DataFrame:
    """What conversations ask of the record store, as commands.replayed() takes it: record_id, command_id, verb, page_idx, arg.

    steps: log(messages). A photo is followed by its reading. A message gives
    four commands at most, numbered behind its own number times ten.
    """
    rows = steps.where("command is not null").select("user", "message_id", "record_no", "action", "open_fields", F.posexplode(F.split("command", "; ")).alias("k", "c"))
    word = lambda i: F.get(F.split("c", " "), i)
    verb = F.when(word(0) == "create_record", "create").when(word(0).isin("set_field", "confirm_fields"), "review").otherwise(word(0))
    index = F.when(word(0).isin("replace_page", "drop_page", "set_field", "confirm_fields"), word(1).try_cast("int"))
    arg = F.when(word(0) == "create_record", "1").when(word(0) == "set_code", F.expr("substring(c, 10)")).when(word(0) == "link", word(1)).when(word(0) == "set_field", F.col("open_fields").cast("string")).when(word(0) == "confirm_fields", "0")
    asked = rows.select("user", "record_no", "message_id", "k", verb.alias("verb"), index.alias("page_idx"), arg.alias("arg")).where("verb <> 'add_field'")
    photos = messages.where("kind = 'image'").select(F.col("user").cast("string").alias("user"), "message_id", F.coalesce("error", F.lit(False)).alias("error"), F.size(F.coalesce("doubtful", F.array().cast("array<int>"))).alias("open"))
    place = F.when(word(0) == "create_record", 0).when(word(0).isin("add_page", "replace_page"), word(1).try_cast("int"))
    taken = rows.where(F.col("action").isin("page_saved", "page_replaced")).select("user", "record_no", "message_id", place.alias("page_idx")).join(photos, ["user", "message_id"])
    read = taken.select("user", "record_no", "message_id", F.lit(9).alias("k"), F.when(F.col("error"), "failed").otherwise("read").alias("verb"), "page_idx", F.when(F.col("error"), "unreadable").otherwise(F.col("open").cast("string")).alias("arg"))
    return asked.union(read).select(F.concat_ws("/", "user", "record_no").alias("record_id"), (F.col("message_id") * 10 + F.col("k")).alias("command_id"), "verb", "page_idx", "arg")
