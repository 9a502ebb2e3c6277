import difflib

from pyspark.sql import functions as F

from rosterlake.functions import reading
from rosterlake.operators import lifecycle


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_bars(spark):
    cases = [("TA", "text", "|51/97", "151/97"), ("TA", "text", "|137/92", "137/92"), ("HU (cm)", "length", "|27", "27"), ("BCF", "text", "|29", "129"), ("Date de visite", "date", "0|/12/2025", "01/12/2025"), ("TA", "text", "104/74", "104/74")]
    got = values(spark, [c[:3] for c in cases], "l string, k string, t string", reading.pipe_reading(F.col("l"), F.col("k"), F.col("t")))
    assert got == [c[3] for c in cases]


def test_odd_and_first_status(spark):
    assert values(spark, [("KAS",), ("RAS",), (")",), ("7",), ("Normal",), ("a§b",)], "t string", reading.looks_odd(F.col("t"))) == [True, False, True, False, False, True]
    cases = [("text", "Normal", 0.95, ("Normal", "KNOWN", 0.95)), ("text", ":Teacher", 0.95, ("Teacher", "NEEDS_REVIEW", 0.57)), ("weeks", "99", 0.95, ("99", "NEEDS_REVIEW", 0.57)), ("text", "....", 0.9, (None, "NOT_PROVIDED", 0.9)), ("text", "?", 0.95, (None, "UNKNOWN", 0.95)), ("text", "Normal", 0.8, ("Normal", "NEEDS_REVIEW", 0.8))]
    got = values(spark, [c[:3] for c in cases], "k string, t string, s double", reading.first_status(F.col("k"), F.col("t"), F.lit("x"), F.col("s")))
    assert [tuple(g) for g in got] == [c[3] for c in cases]


def test_flags(spark):
    rows = [("a", "KNOWN", 0.95, None), ("b", "KNOWN", 0.95, None), ("c", "NEEDS_REVIEW", 0.5, None), ("d", "KNOWN", 0.9, "lieu_corrige")]
    df = spark.createDataFrame(rows, "id string, status string, confidence double, reason string")
    got = {r["id"]: (r["status"], r["confidence"], r["reason"]) for r in reading.flagged(df, F.when(F.col("id") == "b", "champ_nouveau"), F.lit(False), F.lit(False)).collect()}
    assert got == {"a": ("KNOWN", 0.95, None), "b": ("NEEDS_REVIEW", 0.6, "champ_nouveau"), "c": ("NEEDS_REVIEW", 0.5, "valeur_douteuse"), "d": ("KNOWN", 0.9, "lieu_corrige")}
    f = spark.createDataFrame([("ElSaidida", "KNOWN", 0.95, None, None, "El Jadida"), ("Rabat", "KNOWN", 0.95, None, None, "rabat")], "value string, status string, confidence double, reason string, read_value string, s string")
    assert [(r["value"], r["read_value"], r["status"]) for r in reading.place_corrected(f, "s").collect()] == [("El Jadida", "ElSaidida", "NEEDS_REVIEW"), ("Rabat", None, "KNOWN")]


def test_small_predicates(spark):
    assert values(spark, [("RAS",), ("Néant",), ("asthme",), (None,), ("true",), ("false",)], "v string", reading.noteworthy(F.col("v"))) == [False, False, True, False, True, False]
    assert values(spark, [("MIDWIFE",), ("EPIDEMIOLOGIST",)], "r string", reading.allowed(F.col("r"), "dashboard")) == [False, True]
    assert values(spark, [("VALIDATED",), ("?",)], "s string", reading.step_index(F.col("s"))) == [3, -1]
    assert values(spark, [("SAVED", True), ("SAVED", False), ("SYNC_FAILED", True)], "s string, o boolean", lifecycle.next_action(F.col("s"), F.col("o"))) == ["NONE", "WAIT_NETWORK", "RETRY"]
    assert values(spark, [("AMN-27",), ("XMN-Z7",), ("Q-1",)], "c string", reading.search_match(F.col("c"), F.lit("amn27"))) == [True, True, False]
    v = spark.createDataFrame([("p", "Casa", ["casa "]), ("p", "ILLEGIBLE", ["x"]), ("p", "", []), ("p", "y", ["x"])], "prompt string, a string, v array<string>")
    assert tuple(reading.verdict_shares(v, "prompt", "a", "v").first()) == ("p", 4, 2, 1, 1)


def test_known_words(spark):
    vocabulary, words = ["bilan", "grossesse", "tension", "poids", "الوزن", "hiv"], ["bilah", "grosesse", "tensoin", "zzzz", "poids", "وزن", "hib", "tention"]
    got = {r["word"] for r in reading.known_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in vocabulary], "word string")).collect()}
    bare = [v.removeprefix("ال") for v in vocabulary]
    want = {w for w in words if w in bare or len(w) >= 4 and any(abs(len(v) - len(w)) <= 2 and difflib.SequenceMatcher(None, v, w).ratio() >= 0.8 for v in bare)}
    assert got == want
