import pytest
from pyspark.sql import functions as F

from rosterlake.functions import display as dp
from rosterlake.streaming import chat
from rosterlake.streaming import commands as cm

SCHEMA = "user string, message_id long, at string, kind string, text string, error boolean, kinds array<string>, doubtful array<int>, code string, n_candidates int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("at", F.col("at").cast("timestamp"))


def said(texts, user="u", start=0, hour=10, candidates=0):
    """Texts, or photos as (error, kinds, doubtful, code), a minute after each other."""
    out = []
    for k, x in enumerate(texts, start):
        photo = x if isinstance(x, tuple) else (None, None, None, None)
        out.append((user, k, f"2026-01-01 {hour + k // 60:02d}:{k % 60:02d}:00", "image" if isinstance(x, tuple) else "text", None if isinstance(x, tuple) else x, *photo, candidates))
    return out


GOOD, DOUBT, BROKEN, EMPTY = (False, ["integer", "date"], [], None), (False, ["integer", "date"], [2], "C-7"), (True, None, None, None), (False, [], [], None)


GOOD, DOUBT, BROKEN, EMPTY = (False, ["integer", "date"], [], None), (False, ["integer", "date"], [2], "C-7"), (True, None, None, None), (False, [], [], None)


def steps(spark, rows, **kw):
    return [(r["action"], r["to_state"], r["command"]) for r in chat.log(table(spark, rows), arabic=False).orderBy("user", "message_id").collect()]
LIST = [("9", 20, "link CREATE"), ("10", 20, "link UNSURE"), ("11", 20, None), ("1", 0, "link CREATE"), ("2", 0, "link UNSURE"), ("0", 0, None)]
PERSONAL = [("Téléphone", "x", "field_refused"), ("Groupe", "06 12 34 56 78", "field_refused"), ("N° dossier", "0612345678", "field_added"), ("Groupe", "CIN : AB1", "field_refused"), ("Groupe", "retour", "back")]
#: Conversations, each of one user; all of them are one table.
TALKS = {
    "whole": ([GOOD, DOUBT, "bonjour", "Terminé", "1", "1", "1", "1", "2"], 20),
    "fields": ([DOUBT, "fin", "PAT_1", "2", "3", "tout", "2.", "31/2/2026", "3/4/2026", "5", "x", "Groupe  sanguin", "A+", "2", "3️⃣", "aucun"], 0),
    "doubt": ([DOUBT, "fin", "PAT_1", "2", "2", "?", "1"], 0),
    "pages": ([GOOD, BROKEN, EMPTY, "ok", "P1", "1", "1", "4", "0", "texte", GOOD, "4", "retour", "1", "4", "retour", "5"], 0),
    "only": ([BROKEN, "ok", "P1", "5"], 0),
    "last": ([GOOD, BROKEN, "ok", "P1", "1", "5"], 0),
    "dropped": ([BROKEN, GOOD, "ok", "P1", "5", "1"], 0),
    "words": ([GOOD, "/aide", "/STATUS", "/x", "Annuler", "stop", GOOD], 0),
    "many": ([GOOD] * 11 + ["ok", GOOD, "P1", GOOD], 0),
} | {f"list {k}": ([GOOD, "ok", "P 1", "1", x[0]], x[1]) for k, x in enumerate(LIST)} | {f"personal {k}": ([GOOD, "ok", "P1", "5", *x[:2]], 0) for k, x in enumerate(PERSONAL)}


@pytest.fixture(scope="module")
def got(spark):
    """(action, state, command) of each message of each conversation."""
    rows = [r for user, (texts, n) in TALKS.items() for r in said(texts, user, candidates=n)]
    rows += said([GOOD], "idle") + [("idle", 9, "2026-01-01 12:00:00", "text", "ok", None, None, None, None, 0), ("idle", 10, "2026-01-01 14:00:01", "text", "ok", None, None, None, None, 0)]
    out = {}
    for r in chat.log(table(spark, rows), arabic=False).orderBy("user", "message_id").collect():
        out.setdefault(r["user"], []).append((r["action"], r["to_state"], r["command"]))
    return out


def test_a_record_from_photo_to_patient(got):
    assert got["whole"] == [
        ("page_saved", "collecting", "create_record"), ("page_saved", "collecting", "add_page 1"), ("more_wanted", "collecting", None), ("collected", "ask_code", None), ("code_set", "review", "set_code C-7"),
        ("page_confirmed", "review", None), ("doubts_shown", "confirm_uncertain", None), ("validated", "link", "confirm_fields 1; validate"), ("linked", "idle", "link EXISTING 2"),
    ]


def test_the_list_of_patients_ends_after_eight(got):
    assert [got[f"list {k}"][-1][2] for k in range(len(LIST))] == [x[2] for x in LIST]


def test_fields_are_corrected_and_added(got):
    assert [x[0] for x in got["fields"]] == ["page_saved", "collected", "code_set", "fields_shown", "bad_field", "fields_shown", "value_wanted", "bad_value", "value_set", "label_wanted", "bad_label", "added_value_wanted", "field_added", "fields_shown", "value_wanted", "value_set"]
    assert [x[2] for x in got["fields"] if x[2]] == ["create_record", "set_code PAT_1", "set_field 0 2", "add_field 0", "set_field 0 3"]
    assert got["doubt"][-1] == ("validated", "link", "validate")  # the doubt is gone once its field was set


def test_no_personal_data_is_added(got):
    assert [got[f"personal {k}"][-1][:2] for k in range(len(PERSONAL))] == [(x[2], "review") for x in PERSONAL]


def test_pages_that_could_not_be_read(got):
    assert [x[0] for x in got["pages"][5:]] == ["page_confirmed", "bad_choice", "photo_wanted", "photo_awaited", "photo_awaited", "page_replaced", "photo_wanted", "back", "page_confirmed", "photo_wanted", "back", "drop_refused"]  # a page that was read stays, even without fields
    assert [x[2] for x in got["pages"] if x[2]][-1] == "replace_page 1"
    assert got["last"][-1] == ("dropped_and_validated", "link", "drop_page 1; validate")
    assert got["only"][-1][0] == "bad_choice"  # the only page stays
    assert [x[0] for x in got["dropped"][-2:]] == ["page_dropped", "validated"]


def test_sessions_end(got):
    assert [x[0] for x in got["idle"]] == ["page_saved", "collected", "greeted"]  # two hours are kept, more aren't
    assert [x[0] for x in got["words"]] == ["page_saved", "helped", "status", "unknown_command", "cancelled", "nothing_to_cancel", "page_saved"]
    assert [x[0] for x in got["many"]][-5:] == ["too_many_pages", "collected", "code_first", "code_set", "busy"]


def test_the_store_does_what_conversations_ask(spark):
    """Every command of every conversation is carried out, and linked conversations end in linked records."""
    rows = table(spark, [r for user, (texts, n) in TALKS.items() for r in said(texts, user, candidates=n)])
    steps = chat.log(rows, arabic=False)
    done = cm.replayed(chat.commands_of(steps, rows)).collect()
    assert {r["verdict"] for r in done} == {"done"}
    ends = {r["record_id"]: r["state"] for r in sorted(done, key=lambda r: r["command_id"])}
    assert ends["whole/1"] == "SYNCED" and ends["doubt/1"] == "VALIDATED" and ends["list 1/1"] == "SUSPECTED_DUPLICATE" and ends["only/1"] == "PROCESSING_FAILED"
    assert chat.commands_of(steps.limit(0), rows).count() == 0


def test_odd_messages(spark):
    rows = said([None, "", "  ", GOOD, "", None]) + [(None, 1, "2026-01-01 10:00:00", "text", "ok", None, None, None, None, None), ("v", 1, None, "text", "ok", None, None, None, None, None)]
    got = chat.log(table(spark, [r for r in rows if r[2] is not None]), arabic=False)
    assert got.count() == 6 and {r["user"] for r in got.collect()} == {"u"}
    assert chat.log(table(spark, rows).limit(0), arabic=False).count() == 0
    assert chat.records_of(got).collect()[0]["outcome"] == "open"


def test_typed_answers(spark):
    """aucun is an answer, an empty box is not; yes and no are words of their own."""
    cases = [("text", "aucun", "aucun", "KNOWN"), ("text", "vide", None, "NOT_PROVIDED"), ("text", "Non renseigné", None, "NOT_PROVIDED"), ("text", "NSP", None, "UNKNOWN"), ("text", "nc", "nc", "KNOWN"), ("checkbox", "1", None, None), ("checkbox", "pas coché", None, "NOT_PROVIDED"), ("checkbox", "yes", "true", "KNOWN"), ("checkbox", "0", None, None), ("text", "x" * 121, None, None)]
    df = spark.createDataFrame(cases, "kind string, text string, value string, status string").withColumn("t", dp.typed(F.col("kind"), F.col("text")))
    assert [(r["t"]["value"], r["t"]["status"]) for r in df.collect()] == [c[2:] for c in cases]


def test_stream_equals_table(spark, tmp_path):
    """Two batches of a stream give the log of the whole table; sessions live between them."""
    talks = [[GOOD, DOUBT, "ok", "1", "1", "2", "2", "?", "1", "1"], [BROKEN, GOOD, "fin", "P1", "5", "1", "1", "annuler"], ["bonjour", "/aide", GOOD, "stop"]]
    rows = [r for u, t in enumerate(talks) for r in said(t, f"u{u}", candidates=3)]
    for part in ([r for r in rows if r[1] < 5], [r for r in rows if r[1] >= 5]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        import time

        files = sorted((tmp_path / "in").glob("part-*"), key=lambda f: spark.read.parquet(str(f)).agg(F.max("message_id")).first()[0])
        for k, f in enumerate(files):
            (tmp_path / "stream").mkdir(exist_ok=True)
            f.rename(tmp_path / "stream" / f.name)
            time.sleep(1.1)
            source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/stream").withColumn("at", F.col("at").cast("timestamp"))
            made = chat.followed(source, arabic=False).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            made.awaitTermination()
            assert k == 1 or spark.read.parquet(f"{tmp_path}/out").count() == 14
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)
    assert got == sorted(map(tuple, chat.log(table(spark, rows), arabic=False).collect()), key=repr) and len(got) == len(rows)
