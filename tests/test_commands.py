import random

from pyspark.sql import functions as F

from rosterlake.operators import lifecycle as lc
from rosterlake.streaming import commands as cm

SCHEMA = "record_id string, command_id long, verb string, page_idx int, arg string"


def done(spark, rows, record="r"):
    table = spark.createDataFrame([(record, k, verb, page, arg) for k, (verb, page, arg) in enumerate(rows)], SCHEMA)
    return cm.replayed(table).orderBy("command_id").collect()


MADE, READ = ("create", None, "2"), [("read", 0, "0"), ("read", 1, "0")]


def test_from_capture_to_patient(spark):
    rows = done(spark, [MADE, ("set_code", None, " pat-1 "), ("read", 0, "1"), ("read", 1, "0"), ("validate", None, None), ("review", 0, "0"), ("validate", None, None), ("link", None, "UNSURE"), ("link", None, "CREATE"), ("set_code", None, "x")])
    assert [r["verdict"] for r in rows] == ["done", "done", "done", "done", "open_fields", "done", "done", "done", "done", "patient_chosen"]
    assert [(e["state"], e["note"]) for r in rows for e in r["events"]] == [
        ("CAPTURED", None), ("PENDING_AI", None), ("PENDING_AI", "CODE"), ("AI_PROCESSED", None), ("NEEDS_REVIEW", None), ("VALIDATED", None), ("SUSPECTED_DUPLICATE", None),
        ("PATIENT_LINKED", "CREATE"), ("SAVED", None), ("SYNCED", None),
    ]
    assert (rows[-1]["state"], rows[-1]["code"], rows[-1]["linked"]) == ("SYNCED", "PAT-1", True)


REFUSED = [
    ([("read", 0, "0"), MADE, MADE], ["no_record", "done", "exists"]),
    ([("create", None, None), ("validate", None, None), ("add_page", None, None), ("read", 0, None)], ["done", "refused", "done", "done"]),
    ([MADE, ("read", 0, "0"), ("read", 0, "0"), ("read", 5, "0"), ("drop_page", 0, None), ("drop_page", 1, None), ("drop_page", 0, None), ("drop_page", 1, None)], ["done", "done", "not_waiting", "no_page", "page_read", "done", "page_read", "no_page"]),
    ([("create", None, "1"), ("failed", 0, "dark"), ("drop_page", 0, None), ("validate", None, None), ("retry", None, None), ("retry", None, None), ("read", 0, "0")], ["done", "done", "only_page", "unread_page", "done", "refused", "done"]),
    ([MADE, *READ, ("replace_page", 1, None), ("validate", None, None), ("replace_page", 1, None), ("read", 1, "0"), ("validate", None, None), ("add_page", None, None), ("replace_page", 0, None)], ["done", "done", "done", "done", "unread_page", "refused", "done", "done", "closed", "refused"]),
    ([MADE, ("set_code", None, " "), ("set_code", None, "x" * 21), ("link", None, "CREATE"), ("set_code", None, "x" * 20), ("link", None, "CREATE"), ("link", None, "who"), ("link", None, "UNSURE")], ["done", "code_empty", "code_too_long", "no_code", "done", "refused", "no_patient", "done"]),
    ([MADE, ("review", 0, "1"), ("review", 7, "1"), ("fly", None, None), (None, None, None)], ["done", "unread_page", "no_page", "unknown_verb", "unknown_verb"]),
]


def test_what_is_refused(spark):
    table = spark.createDataFrame([(f"r{n}", k, verb, page, arg) for n, (rows, _) in enumerate(REFUSED) for k, (verb, page, arg) in enumerate(rows)], SCHEMA)
    got = cm.replayed(table).orderBy("record_id", "command_id").collect()
    for n, (_, want) in enumerate(REFUSED):
        assert [r["verdict"] for r in got if r["record_id"] == f"r{n}"] == want, n


def test_a_page_that_comes_later_is_read_too(spark):
    rows = done(spark, [("create", None, "1"), ("read", 0, "0"), ("add_page", None, None), ("validate", None, None), ("read", 1, "0"), ("validate", None, None)])
    assert [e["note"] or e["state"] for r in rows for e in r["events"]][-6:] == ["NEEDS_REVIEW", "ADD page 1", "PENDING_AI", "AI_PROCESSED", "NEEDS_REVIEW", "VALIDATED"]
    assert [(e["state"], e["note"]) for e in rows[2]["events"]] == [("CAPTURED", "ADD page 1"), ("PENDING_AI", None)]
    assert rows[3]["verdict"] == "unread_page" and rows[5]["state"] == "VALIDATED"
    failed = done(spark, [MADE, ("failed", 1, "late"), ("failed", 0, "first")])
    assert [(e["state"], e["note"]) for e in failed[2]["events"]] == [("PROCESSING_FAILED", "first")]


def test_every_move_is_legal(spark):
    """Whatever the commands, the events they leave never break the table of transitions, and the last one is the record's state."""
    r = random.Random(7)
    rows = [(f"r{r.randrange(40)}", k, r.choice([*cm.VERBS, "read", "read", "create"]), r.randrange(3), r.choice(["0", "1", "2", "CREATE", "UNSURE", None])) for k in range(4000)]
    found = cm.replayed(spark.createDataFrame(rows, SCHEMA)).cache()
    events = cm.events_of(found).where("note is null or note not like 'DROP%' and note <> 'CODE'")
    assert lc.illegal_moves(events, "record_id", ["command_id", "place"], "state").count() == 0
    assert found.count() == 4000 and found.where("state = 'SYNCED'").count() > 0
    last = {x["record_id"]: x["state"] for x in lc.current_state(cm.events_of(found), "record_id", ["command_id", "place"], "state").collect()}
    ends = {x["record_id"]: x["state"] for x in found.groupBy("record_id").agg(F.max_by("state", "command_id").alias("state")).collect()}
    assert {k: v for k, v in ends.items() if v} == last


def test_stream_equals_table(spark, tmp_path):
    rows = [(f"r{k % 3}", k, v, p, a) for k, (v, p, a) in enumerate([MADE] * 3 + [("read", 0, "0")] * 6 + [("set_code", None, "c")] * 3 + [("read", 1, "0")] * 3 + [("validate", None, None)] * 3 + [("link", None, "CREATE")] * 3)]
    rows += [(None, 99, "create", None, "1")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows[:8], rows[8:]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
            cm.carried_out(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = cm.replayed(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, want.collect())) and want.count() == len(rows) - 1
