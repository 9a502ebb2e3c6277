import json

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import lifecycle
from rosterlake.sources import files
from rosterlake.streaming import events


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    log = [("a", "CAPTURED"), ("b", "CAPTURED"), ("a", "PENDING_AI"), ("a", "AI_PROCESSED"), ("b", "PENDING_AI"), ("a", "NEEDS_REVIEW"), ("a", "SYNCED"), ("b", "SYNCED")]
    rows = spark.createDataFrame([(r, i, s) for i, (r, s) in enumerate(log)], "record_id string, event_id long, state string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "checkpoint"))
    try:
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        got = run(spark, events.validated(stream), "moves").where("not legal")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.checkpointLocation")
    want = lifecycle.illegal_moves(rows, "record_id", ["event_id"], "state")
    pick = lambda d: {(r["record_id"], r["event_id"], r["from_state"], r["to_state"]) for r in d.collect()}
    assert pick(got) == pick(want) and len(pick(want)) == 2


def test_messages_once(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "2026-01-01 10:00:00"), ("m1", "2026-01-01 10:10:00"), ("m2", "2026-01-01 10:20:00")], "message_uuid string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "checkpoint"))
    try:
        got = run(spark, events.deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "once")
    finally:
        spark.conf.unset("spark.sql.streaming.checkpointLocation")
    assert sorted(r["message_uuid"] for r in got.collect()) == ["m1", "m2"]
    assert events.session_counts(rows, "message_uuid").count() == 2
    old = rows.withColumn("received_at", F.lit("2026-01-01 11:05:00").cast("timestamp"))
    assert {r["message_uuid"] for r in events.fresh(old).collect()} == {"m1", "m2"} and events.fresh(old).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "index.csv").write_text("path,split,duplicate_of\na,dev,\nb,dev,a\nc,test,\n")
    assert files.read_index(spark, str(tmp_path / "index.csv"), "dev").count() == 1
    assert files.read_index(spark, str(tmp_path / "index.csv"), "dev", duplicates=True).count() == 2
    with pytest.raises(PermissionError):
        files.read_index(spark, str(tmp_path / "index.csv"), "test")
    doc = {"source": "s", "title": "t", "threshold": 0.7, "fields": [{"id": "a", "label": "L", "kind": "integer", "value": 3, "status": "KNOWN"}, {"id": "b", "label": "M", "kind": "checkbox", "value": True, "status": "KNOWN"}]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    assert [(r["ordinal"], r["id"], r["value"]) for r in files.read_predictions(spark, str(tmp_path / "p.json")).orderBy("ordinal").collect()] == [(0, "a", "3"), (1, "b", "true")]
    (tmp_path / "words.txt").write_text("# no\n\npoids\n age \n")
    assert {r["word"] for r in files.read_words(spark, str(tmp_path / "words.txt")).collect()} == {"poids", "age"}
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "x.bin").write_bytes(b"one two")
    got = files.read_lines(spark, str(tmp_path / "img"), lambda b: [(w, 1.0, 0, 0, 9, 9) for w in b.decode().split()]).collect()
    assert [r["text"] for r in got] == ["one", "two"]
    digest = files.read_digests(spark, str(tmp_path / "img")).withColumn("s", files.recorded_sample(F.col("sha256"), 15)).first()
    assert digest["s"] == int(digest["sha256"], 16) % 15
    key = F.lit("0123456789abcdef")
    back = spark.range(1).select(files.decrypted(files.encrypted(F.lit("été"), key), key).alias("v")).first()
    assert back["v"] == "été"
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 3, "d", True)], "id int, at int, v string, gone boolean")
    assert {(r["id"], r["v"]) for r in files.latest(log, "id", ["at"], "gone").collect()} == {(1, "b")}


def test_readings_survive_a_second_start(spark, tmp_path):
    """A second start reads new pages only; a page that comes again isn't read again."""
    schema, source, out = "page_id string, record_id string", f"{tmp_path}/in", f"{tmp_path}/out"
    read = lambda pages: pages.withColumn("n_fields", F.length("page_id"))
    for rows in ([("a", "r"), ("bb", "r"), ("a", "r")], [("bb", "r"), ("ccc", "s")], []):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        events.read_as_they_come(spark.readStream.schema(schema).json(source), read, out, f"{tmp_path}/state").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("page_id", "n_fields", "batch").collect()) == [("a", 1, 0), ("bb", 2, 0), ("ccc", 3, 1)]


def test_index_and_templates(spark, tmp_path):
    photos = spark.createDataFrame([("z", "1", "9", "p", 0, "t", "train", None), ("b", "2", "10", "p", 0, "t", "train", None), ("c", "3", None, "p", 0, "t", "train", None), ("a", "4", "3", "p", 0, "t", "test", "z")], "path string, sha256 string, page_number string, patient string, position int, page_type string, split string, duplicate_of string")
    files.write_index(photos, f"{tmp_path}/index")
    lines = [x for f in sorted((tmp_path / "index").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("path,")]
    assert [x.split(",")[0] for x in lines] == ["a", "c", "z", "b"]
    files.write_templates(spark.createDataFrame([("acc", 1, "b", "g", "Poids", "weight"), ("acc", 0, "a", "g", "Date", "date"), ("id", 0, "c", "g", "Nom", "text")], "page_type string, ordinal int, field_id string, groupe string, libelle string, type string"), f"{tmp_path}/t")
    found = [f.read_text().splitlines() for f in sorted((tmp_path / "t" / "page_type=acc").glob("part-*"))]
    assert found == [["field_id,groupe,libelle,type,value,status", "a,g,Date,date,,", "b,g,Poids,weight,,"]]


def test_report_keeps_the_order_of_partitions(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k == 3 else f"x{k}") for k in range(8)], "k int, x string").repartitionByRange(3, "k").sortWithinPartitions("k")
    files.write_report(df, str(tmp_path))
    lines = [x for f in sorted((tmp_path / "markdown").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [f"| {k} | {'' if k == 3 else f'x{k}'} |" for k in range(8)]
    assert spark.read.json(f"{tmp_path}/json").count() == 8
