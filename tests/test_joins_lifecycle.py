import itertools
import random

from pyspark.sql import functions as F

from rosterlake.operators import joins, layout, lifecycle, windows


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d = [i, *itertools.accumulate(zip(d, d[1:], b, strict=False), lambda left, t, x=x: min(left + 1, t[1] + 1, t[0] + (x != t[2])), initial=i)][1:]
    return d[-1]


def test_one_edit_is_exact(spark):
    r = random.Random(4)
    codes = ["".join(r.choice("AMN27OZ1-") for _ in range(r.randint(1, 5))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(codes)), "i long, code string")
    got = {tuple(x) for x in joins.within_one_edit(df.withColumnRenamed("i", "a"), df.withColumnRenamed("i", "b"), "code", "code", ("a", "b")).collect()}
    fold = lambda c: c.replace("-", "").translate(str.maketrans(*joins.LOOKALIKE))
    want = {(i, j, distance(fold(x), fold(y))) for i, x in enumerate(codes) for j, y in enumerate(codes) if fold(x) and fold(y) and distance(fold(x), fold(y)) <= 1}
    assert got == want


def test_candidates(spark):
    rec = spark.createDataFrame([("r", "AMN-27", 30, 2)], "record_id string, code string, age int, gestation int")
    pat = spark.createDataFrame([("p1", "AMN-Z1", 31, 2, 0), ("p2", "amn 27", 40, None, 1), ("p3", "AMN-99", 30, 2, 2)], "patient_id string, code string, age int, gestation int, scan_order int")
    got = [(x["patient_id"], x["reasons"], x["score"]) for x in joins.patient_candidates(rec, pat).orderBy("place").collect()]
    assert got == [("p2", ["SAME_CODE"], 11), ("p1", ["SIMILAR_CODE", "CLOSE_AGE", "SAME_GESTATION"], 8)]


def test_greedy_match_is_one_to_one(spark):
    refs = spark.createDataFrame([("p", "r1", 0, ["date", "accouchement"]), ("p", "r2", 1, ["date", "accouchement"]), ("p", "r3", 2, ["poids"])], "page string, ref_id string, ref_order int, tokens array<string>")
    preds = spark.createDataFrame([("p", "x", 0, ["date", "accouchement"]), ("p", "y", 1, ["accouchement", "date"]), ("p", "z", 2, ["poids", "naissance"])], "page string, pred_id string, pred_order int, tokens array<string>")
    got = {(r["ref_id"], r["pred_id"], round(r["score"], 3)) for r in joins.greedy_match(refs, preds, "page").collect()}
    assert got == {("r1", "x", 1.0), ("r2", "y", 1.0), ("r3", "z", 0.95)}


def test_greedy_match_against_a_plain_loop(spark):
    """Many ties and several pages; every tie goes to the lower pred_order, then the lower ref_order."""
    r = random.Random(7)
    words = ["date", "lieu", "poids", "sexe", "mere"]
    side = lambda name, n: [(page, f"{name}{k}", k, r.sample(words, r.randint(0, 3))) for page in range(12) for k in range(n)]
    refs, preds = side("r", 9), side("p", 11)
    want = set()
    for page in range(12):
        pairs = []
        for _, ref, i, a in (x for x in refs if x[0] == page):
            for _, pred, j, b in (x for x in preds if x[0] == page):
                common = len({*a} & {*b})
                if common and common / len(a) >= 0.5:
                    pairs.append((-(common / len(a) - 0.1 * (len(b) - common) / len(b)), j, i, ref, pred))
        used = set()
        for score, _, _, ref, pred in sorted(pairs):
            if not used & {ref, pred}:
                used |= {ref, pred}
                want.add((page, ref, pred, round(-score, 9)))
    df = lambda rows, n: spark.createDataFrame(rows, f"page int, {n}_id string, {n}_order int, tokens array<string>")
    got = [(*tuple(x)[:3], round(x["score"], 9)) for x in joins.greedy_match(df(refs, "ref"), df(preds, "pred"), "page").collect()]
    assert len(got) == len(want) > 50 and {*got} == want
    assert joins.greedy_match(df([], "ref"), df(preds, "pred"), "page").collect() == []


def test_transitions(spark):
    log = [("a", s) for s in ("CAPTURED", "PENDING_AI", "AI_PROCESSED", "NEEDS_REVIEW", "SYNCED")] + [("b", "SYNCED"), ("b", "SAVED")]
    df = spark.createDataFrame([(r, i, s) for i, (r, s) in enumerate(log)], "r string, i long, s string")
    assert {(x["r"], x["from_state"], x["to_state"]) for x in lifecycle.illegal_moves(df, "r", ["i"], "s").collect()} == {("a", "NEEDS_REVIEW", "SYNCED"), ("b", "SYNCED", "SAVED")}
    assert {x["r"]: x["state"] for x in lifecycle.current_state(df, "r", ["i"], "s").collect()} == {"a": "SYNCED", "b": "SAVED"}


def test_edits(spark):
    fields = spark.createDataFrame([("a", "5", "NEEDS_REVIEW", "AI"), ("b", None, "NEEDS_REVIEW", "AI"), ("c", "5", "KNOWN", "AI"), ("d", "5", "KNOWN", "MANUAL"), ("e", "1", "KNOWN", "AI")], "field_id string, value string, status string, origin string")
    edits = spark.createDataFrame([("a", 1, "confirm", None, None), ("b", 1, "confirm", None, None), ("c", 1, "set", "6", "KNOWN"), ("c", 2, "set", "7", "KNOWN"), ("d", 1, "set", "6", "KNOWN")], "field_id string, at long, action string, value string, status string")
    got = {r["field_id"]: tuple(r)[1:] for r in lifecycle.edited_fields(fields, edits).collect()}
    assert got["a"] == ("5", "KNOWN", "CONFIRMED", None, 1) and got["b"] == (None, "NOT_PROVIDED", "CONFIRMED", None, 1)
    assert got["c"] == ("7", "KNOWN", "CORRECTED", "5", 2) and got["d"] == ("6", "KNOWN", "MANUAL", None, 1) and got["e"] == ("1", "KNOWN", "AI", None, 0)


def test_visits_and_superseded(spark):
    rec = spark.createDataFrame([("r1", "p", "2026-01-02 09:00:00"), ("r2", "p", "2026-01-02 15:00:00"), ("r3", "p", "2026-01-03 09:00:00")], "record_id string, patient_id string, created_at string")
    seen = spark.createDataFrame([("v9", "p", "2026-01-03 08:00:00")], "visit_id string, patient_id string, date string")
    got = {r["record_id"]: (r["visit_id"], r["is_new"]) for r in lifecycle.visits_for(rec, seen).collect()}
    assert got["r1"] == got["r2"] and got["r1"][1] and got["r3"] == ("v9", False)
    pages = spark.createDataFrame([("a", "p", "x", 1), ("b", "p", "x", 2), ("c", "p", "inconnue", 3), ("d", "p", None, 4)], "page_id string, patient_id string, page_type string, created_at long")
    assert {r["page_id"]: r["supersedes"] for r in lifecycle.superseded_pages(pages).collect()} == {"a": None, "b": "a"}


def test_ttl_counts_from_the_kept_one(spark):
    df = spark.createDataFrame([("m", t, i) for i, t in enumerate([0, 50, 3590, 3601, 7000, 7202])], "k string, t long, i long")
    assert sorted(r["at_s"] for r in windows.first_sightings(df, ["k"], F.col("t"), 3600, "i").collect()) == [0, 3601, 7202]


LINES = "page_id string, i int, text string, x0 int, y0 int, x1 int, y1 int, hand boolean, th double"


def test_layout(spark):
    rows = [
        ("p", 0, "Poids (kg)", 0, 0, 100, 20, False, 20.0), ("p", 1, "58.8", 120, 2, 160, 22, True, 20.0), ("p", 2, "الوزن", 400, 0, 450, 20, False, 20.0), ("p", 3, "60", 350, 0, 380, 20, True, 20.0),
        ("p", 4, "Observations", 0, 100, 120, 120, False, 20.0), ("p", 5, "rien", 10, 130, 60, 150, True, 20.0), ("q", 0, "Poids", 0, 0, 90, 20, False, 20.0),
    ]
    df = spark.createDataFrame(rows, LINES)
    pairs = layout.label_pairs(df)
    assert {(r["i"], r["label_i"]) for r in pairs.collect()} == {(1, 0), (3, 2)}
    assert {(r["i"], r["label_i"]) for r in layout.attach_rest(df, pairs).collect()} == {(5, 4)}
    cells = spark.createDataFrame([("p", [0, 110, 200], [0, 50, 200])], "page_id string, xs array<int>, ys array<int>")
    assert {(r["i"], r["row"], r["col"]) for r in layout.in_cells(df, cells).collect()} == {(0, 0, 0), (1, 0, 1), (4, 1, 0), (5, 1, 0)}
    assert [(r["v"], layout.box_state) and r["s"] for r in spark.createDataFrame([(0.4,), (0.0,), (0.02,)], "v double").withColumn("s", layout.box_state(F.col("v"))).collect()] == [True, False, None]


def test_codes_that_many_have_are_compared_once(spark):
    """Pairs are as many as the keys ask for, but the join on deletions sees each code once; keys with several codes or no code keep their pairs."""
    left = spark.range(400).select(F.col("id").alias("a"), F.lit("AB-12").alias("code")).union(spark.createDataFrame([(7, "AB-13"), (900, "AB-12X"), (901, None), (902, "-"), (None, "ab12"), (None, "ab13")], "a long, code string"))
    right = spark.createDataFrame([(1, "ab 12"), (1, "ab 14"), (2, "zz"), (3, "ab1"), (3, None)], "b long, code string")
    df = joins.within_one_edit(left, right, "code", "code", ("a", "b"))
    got = [tuple(r) for r in df.collect()]
    by_hand = {(a, 1, d) for a in range(400) for d in (0, 1)} | {(a, 3, 1) for a in range(400)} | {(7, 1, 1), (900, 1, 1), (None, 1, 0), (None, 1, 1), (None, 3, 1)}
    assert len(got) == len(set(got)) and set(got) == by_hand
    join = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "(k#" in x]
    assert join and all("levenshtein" in x for x in join)
    tops = df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert tops.startswith("Union")  # not one distinct over all pairs
