import random

from pyspark.sql import functions as F

from rosterlake.functions import text as tf
from rosterlake.functions import values as vf


def column(spark, rows, schema, **made):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in made.items()]).collect()


def test_fold(spark):
    texts = ["Âge gestationnel", "œdème", "الاسم الكَامِل", "Nom — Prénom (CIN)", "T°", "3½", "أإآؤئ", None, ""]
    rows = column(spark, [(t,) for t in texts], "t string", a=tf.fold(F.col("t")), b=tf.fold_exact("t"))
    want = ["age gestationnel", "oedeme", "الاسم الكامل", "nom prenom cin", "t", None, "اااوي", None, ""]
    assert [r["a"] for r in rows if r["a"] != "3"] == [w for w, t in zip(want, texts, strict=True) if t != "3½"]
    assert all(r["a"] == r["b"] for r, t in zip(rows, texts, strict=True) if t != "3½")


def test_parse(spark):
    cases = [
        ("date", "12/11/2022", "", "2022-11-12", True), ("date", "31/02/2022", "", None, False), ("date", "3/2021", "", "2021-03", True), ("date", "2019", "", "2019", True), ("date", "1-2-22", "", "2022-02-01", True),
        ("weight", "3626 g", "", "3626", True), ("weight", "3626 9", "", "3626", True), ("weight", "3,2 kg", "", "3200", True), ("weight", "36779", "", "36779", False),
        ("weight", "58.8", "Poids (kg) visite", "58800", True), ("weight", "66 kg", "Poids", "66000", True), ("weight", "35000", "Poids naissance", "35000", False),
        ("weeks", "40 SA", "", "40", True), ("integer", "21 ans", "", "21", True), ("sex", "F", "", "F", True), ("text", "R.A.S", "", "aucun", True), ("text", "", "", None, False),
    ]
    rows = column(spark, [c[:3] for c in cases], "k string, t string, l string", p=vf.parse(F.col("k"), F.col("t"), F.col("l")))
    assert [(r["p"]["value"], r["p"]["ok"]) for r in rows] == [c[3:] for c in cases]


def test_comparable(spark):
    pairs = [("text", "Fièvre", "fievre"), ("date", "12/11/2022", "12-11-2022"), ("text", "RAS", "aucun")]
    rows = column(spark, pairs, "k string, a string, b string", a=vf.comparable(F.col("k"), F.col("a")), b=vf.comparable(F.col("k"), F.col("b")))
    assert all(r["a"] == r["b"] != "" for r in rows)


def test_kinds(spark):
    labels = {"Date d'accouchement | 1": "date", "Poids de naissance": "weight", "Age gestationnel": "weeks", "Age": "integer", "Profession": "text", "تاريخ": "date"}
    rows = column(spark, [(x,) for x in labels], "t string", k=tf.infer_kind(F.col("t")))
    assert [r["k"] for r in rows] == list(labels.values())


def test_pressure_and_category(spark):
    rows = column(spark, [("104/74",), ("12/7",), ("12.5/8",), ("no",)], "t string", p=vf.blood_pressure(F.col("t")))
    assert [r["p"] and tuple(r["p"]) for r in rows] == [(104, 74), (120, 70), (125, 80), None]
    words = [("hiv", "Neg", "neg"), ("x", "++", "pos"), ("x", "traces", "traces"), ("toxo", "non immunisée", "non_immune"), ("x", "oui", "yes")]
    rows = column(spark, words, "m string, t string, w string", c=vf.category(F.col("m"), F.col("t")))
    assert [r["c"] for r in rows] == [w[2] for w in words]


def test_personal(spark):
    yes = [("Nom du conjoint", ""), ("CIN", ""), ("N° de téléphone", ""), ("Patiente", ""), ("Remarque", "0612345678"), ("Remarque", "AB123456"), ("MÈRE — Tazi Meryem", ""), ("الاسم الكاملر", "")]
    no = [("Profession", "x"), ("Nombre d'enfants", "3"), ("Antécédents familiaux", ""), ("A domicile", ""), ("Date", "12/11/2022"), ("Poids", "58.8"), ("Nom de l’établissement", "x"), ("N° de fiche", "A64185")]
    rows = column(spark, yes + no, "l string, v string", p=tf.is_personal(F.col("l"), F.col("v")))
    assert [r["p"] for r in rows] == [True] * len(yes) + [False] * len(no)


def test_label_reason(spark):
    vocabulary = ["poids", "kg", "age", "وزن"]
    rows = column(spark, [("Poids (kg)",), ("Poids zorglub",), ("33A$A-11",), ("H(:M",), ("الوزن",)], "t string", r=tf.label_reason(F.col("t"), vocabulary))
    assert [r["r"] for r in rows] == [None, "champ_nouveau", "etiquette_douteuse", "etiquette_douteuse", None]


def test_restore_letters(spark):
    fix = tf.restore_letters(["Commerçante", "Maternité", "Asthme léger"])
    rows = column(spark, [("Commer ante",), ("Maternit",), ("Maternité",), ("Commerxante",), ("asthme l ger",), (None,)], "t string", r=fix("t"))
    assert [r["r"] for r in rows] == ["Commerçante", "Maternité", None, None, "asthme léger", None]


def test_identifiers_and_keys(spark):
    rows = column(spark, [("CIN : A64185", "A64l85"), ("A64185", "Z99999")], "a string, b string", s=tf.same_identifier(F.col("a"), F.col("b")), k=tf.keyed_id("s")("a"), m=tf.mask_tail(F.col("b")))
    assert [r["s"] for r in rows] == [True, False] and len(rows[0]["k"]) == 10 and rows[0]["m"] == "***4l85"


def longest_common(a, b):
    """(length, place in a, place in b) of the longest common string, the first in a, then in b."""
    return max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]), default=(0, 0, 0))


def in_common(a, b):
    n, i, j = longest_common(a, b)
    return n and n + in_common(a[:-i], b[:-j]) + in_common(a[-i + n :], b[-j + n :])


def test_similarity_by_definition(spark):
    r = random.Random(3)
    made = lambda: "".join(r.choice("abc ") for _ in range(r.randint(0, 12)))
    pairs = [(made(), made()) for _ in range(150)] + [("", ""), ("cold widget", "old gadget"), ("tide", "diet"), ("diet", "tide")]
    got = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string").select("a", "b", tf.similarity("a", "b").alias("x")).collect()
    want = {(a, b): 2 * in_common(a, b) / (len(a) + len(b)) if a or b else 1.0 for a, b in pairs}
    assert all((x["x"] is None) if x["a"] is None or x["b"] is None else abs(x["x"] - want[x["a"], x["b"]]) < 1e-9 for x in got)
