"""Consistency rules over register series: one pass per shape of rule, all violations of a row at once.

A violation is (record_id, page_idx, key, code, params). Physical ranges tell
misread digits, they judge nobody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import PAGE, USABLE

# What can be, by measure.
POSSIBLE = {"weight": (30, 200), "fundalHeight": (5, 50), "fhr": (60, 220), "temperature": (34, 43), "pulse": (30, 220), "hemoglobin": (3, 25), "headCirc": (20, 60), "length": (30, 80)}
NEWBORN_WEIGHT = (400, 7000)
SYSTOLIC, DIASTOLIC, GA_WEEKS = (60, 260), (30, 160), (4, 45)
SPIKE = {"weight": 8, "fundalHeight": 8, "hemoglobin": 4, "bp": 50}
GA_TOLERANCE, EDD_DAYS, TERM_DAYS, DATE_TOLERANCE = 2, 280, 287, 4
EXCLUSIVE = [
    ("two_modes", ("mode_voie_basse_non_instrumentale", "mode_voie_basse_instrumentale"), ("mode_cesarienne_programmee", "mode_cesarienne_urgence")),
    ("alive_stillborn", ("nn_vivant",), ("nn_mort_ne",)),
]


def _found(df: DataFrame, key: Column, code, params: dict[str, Column]) -> DataFrame:
    pairs = [x for k, c in params.items() for x in (F.lit(k), c.cast("string"))]
    return df.select(*PAGE, key.alias("key"), (code if isinstance(code, Column) else F.lit(code)).alias("code"), F.create_map(*pairs).alias("params")).where("key is not null and code is not null")


def _hits(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """The violations of all rules (condition, key, code, params) of a row in one pass."""
    hit = lambda cond, key, code, params: F.when(cond & key.isNotNull(), F.struct(key.alias("key"), F.lit(code).alias("code"), F.create_map(*[x for k, c in params.items() for x in (F.lit(k), c.cast("string"))]).alias("params")))
    rows = df.where(_any([r[0] for r in rules])).withColumn("__f", F.explode(F.array(*[hit(*r) for r in rules]))).where("__f is not null")
    return rows.select(*PAGE, "__f.key", "__f.code", "__f.params")


def _any(conditions: list[Column]) -> Column:
    out = F.coalesce(conditions[0], F.lit(False))
    for c in conditions[1:]:
        out = out | F.coalesce(c, F.lit(False))
    return out


def formats(values: DataFrame) -> DataFrame:
    """Values that cannot be, and pressures written the wrong way round."""
    m, n, s, d = F.col("measure"), F.col("num"), F.col("sys"), F.col("dia")
    ok = F.when((m == "weight") & (F.col("page_kind") == "postpartum_newborn"), n.between(*NEWBORN_WEIGHT)).when(m == "gaWeeks", n.between(*GA_WEEKS))
    for name, bounds in POSSIBLE.items():
        ok = ok.when(m == name, n.between(*bounds))
    bp_ok = s.between(*SYSTOLIC) & d.between(*DIASTOLIC)
    code = F.when(m == "bp", F.when(~bp_ok, "format").when(s <= d, "bp_order")).when(~ok, "format")
    return _found(values, F.col("key"), code, {"measure": m, "value": F.coalesce(n.cast("string"), F.concat_ws("/", s, d))})


def visit_dates(visits: DataFrame, facts: DataFrame, as_of: str) -> DataFrame:
    """future, appointment_before_visit, ga_lmp, date_order, ga_dates."""
    lmp = facts.where("name = 'lmp'").select(*PAGE, F.to_date("day").alias("lmp"))
    rows = visits.join(lmp, PAGE, "left").withColumn("d", F.to_date("date")).withColumn("a", F.to_date("appointment"))
    ante, d = F.col("page_kind") == "antenatal", F.col("d")
    rows = rows.withColumn("dated", ante & d.isNotNull())  # trends go over an antenatal page's dated visits; the others stand apart
    w = Window.partitionBy(*PAGE, "dated").orderBy("col")
    rows = rows.withColumns({"p": F.lag("d").over(w), "pga": F.lag("gaWeeks").over(w)}).withColumn("bad", F.coalesce(F.col("dated") & (d <= F.col("p")), F.lit(False)))
    rows = rows.withColumn("doubtful", F.col("bad") | F.coalesce(F.lead("bad").over(w), F.lit(False))).withColumn("pdoubtful", F.lag("doubtful").over(w))
    expected, weeks = F.rint(F.datediff("d", "lmp") / 7), F.datediff("d", "p") / 7
    ga, sure = F.col("gaWeeks"), F.col("dated") & F.col("lmp").isNull() & ~F.col("doubtful") & ~F.col("pdoubtful")
    return _hits(rows, [
        (d > F.date_add(F.to_date(F.lit(as_of)), 1), F.col("date_key"), "future", {"value": F.col("date")}),
        (ante & (F.col("a") <= d), F.col("appointment_key"), "appointment_before_visit", {"value": F.col("appointment"), "visit": F.col("date")}),
        (ante & (F.abs(ga - expected) > GA_TOLERANCE), F.col("ga_key"), "ga_lmp", {"value": ga, "expected": expected.cast("int"), "lmp": F.col("lmp"), "visit": F.col("date")}),
        (F.col("bad"), F.col("date_key"), "date_order", {"value": F.col("date"), "previous": F.col("p")}),
        (sure & (F.abs(ga - F.col("pga") - weeks) > GA_TOLERANCE), F.col("ga_key"), "ga_dates", {"value": ga, "previous": F.col("pga"), "weeks": F.rint(weeks).cast("int")}),
    ])


def spikes(values: DataFrame) -> DataFrame:
    """Values far from both neighbouring visits that have the measure, on the same side."""
    tolerance = F.lit(None).cast("double")
    for m, t in SPIKE.items():
        tolerance = F.when(F.col("measure") == m, float(t)).otherwise(tolerance)
    w = Window.partitionBy(*PAGE, "measure").orderBy("col")
    rows = values.where("page_kind = 'antenatal'").withColumn("t", tolerance).withColumn("b", F.coalesce("num", "sys")).where("t is not null and b is not null")
    rows = rows.withColumn("shown", F.when(F.col("measure") == "bp", F.concat_ws("/", "sys", "dia")).otherwise(F.col("num").cast("string")))
    rows = rows.withColumns({"a": F.lag("b").over(w), "c": F.lead("b").over(w), "before": F.lag("shown").over(w), "after": F.lead("shown").over(w)}).where("(b - a) * (b - c) > 0 and least(abs(b - a), abs(b - c)) > t")
    return _found(rows, F.col("key"), "spike", {"measure": F.col("measure"), "value": F.col("shown"), "before": F.col("before"), "after": F.col("after")})


def due_dates(facts: DataFrame) -> DataFrame:
    """edd_lmp and termDate_lmp: the written date against the last period; both fields are flagged."""
    of = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    page = facts.where("page_kind = 'antenatal'").groupBy(*PAGE).agg(*[of(n, c).alias(f"{n}_{c}") for n in ("lmp", "edd", "termDate") for c in ("day", "key")])
    rules = []
    for name, days in (("edd", EDD_DAYS), ("termDate", TERM_DAYS)):
        expected = F.date_add(F.to_date("lmp_day"), days)
        bad, params = F.abs(F.datediff(F.to_date(f"{name}_day"), expected)) > DATE_TOLERANCE, {"value": F.col(f"{name}_day"), "expected": expected, "lmp": F.col("lmp_day")}
        rules += [(bad, F.col(key), f"{name}_lmp", params) for key in (f"{name}_key", "lmp_key")]
    return _hits(page, rules)


def birth_age(facts: DataFrame) -> DataFrame:
    """birth_ga: age at birth on the delivery page against the record's last period."""
    last = lambda n, c: F.max_by(F.when(F.col("name") == n, F.col(c)), F.when(F.col("name") == n, F.col("page_idx")))
    lmp = facts.where("page_kind = 'antenatal' and name = 'lmp'").groupBy("record_id").agg(F.max_by("day", "page_idx").alias("lmp"))
    born = facts.where("page_kind = 'delivery'").groupBy("record_id").agg(last("date", "day").alias("born"), last("gaWeeks", "num").alias("ga"), last("gaWeeks", "key").alias("k"), F.max("page_idx").alias("page_idx"))
    expected = F.rint(F.datediff(F.to_date("born"), F.to_date("lmp")) / 7)
    rows = born.join(lmp, "record_id").where(F.abs(F.col("ga") - expected) > GA_TOLERANCE)
    return _found(rows, F.col("k"), "birth_ga", {"value": F.col("ga"), "expected": expected.cast("int"), "lmp": F.col("lmp")})


def history(fields: DataFrame) -> DataFrame:
    """parity_gravidity, obstetric_sum, living_parity, deliveries_parity on identification pages: one row per page, then its codes."""
    rows = fields.where("page_type = 'identification_antecedents'")
    whole = F.col("status").isin(*USABLE) & F.col("value").rlike(r"^-?\d+$") & (F.col("kind") == "integer")
    of = lambda k: F.max(F.when((F.col("key") == k) & whole, F.col("value").try_cast("int")))
    told = F.regexp_extract("key", "^acc([1-5])_(?:date|modalite|poids)$", 1)
    page = rows.groupBy(*PAGE).agg(of("gestation").alias("g"), of("parite").alias("p"), of("enfants_vivants").alias("l"), of("obst_avortement_nombre").alias("a"),
                                   F.count_distinct(F.when((told != "") & F.col("value").isNotNull() & (F.col("value") != ""), told)).alias("n"))
    hit = lambda cond, code, *keys: F.when(cond, F.array(*[F.struct(F.lit(k).alias("key"), F.lit(code).alias("code")) for k in keys]))
    found = F.flatten(F.array_compact(F.array(
        hit(F.col("p") > F.col("g"), "parity_gravidity", "parite", "gestation"), hit(F.col("p") + F.col("a") > F.col("g"), "obstetric_sum", "obst_avortement_nombre", "gestation"),
        hit(F.col("l") > F.col("p") + 1, "living_parity", "enfants_vivants"), hit(F.col("n") > F.col("p"), "deliveries_parity", "parite"))))
    rows = page.withColumn("f", F.explode(found))
    return _found(rows, F.col("f.key"), F.col("f.code"), {"parity": F.col("p"), "gravidity": F.col("g"), "abortions": F.col("a"), "living": F.col("l"), "listed": F.col("n")})


def exclusive(fields: DataFrame) -> DataFrame:
    """Boxes that exclude each other, both ticked; every ticked one is flagged."""
    ticked = fields.where((F.col("page_type") == "accouchement") & (F.col("value") == "true")).groupBy(*PAGE).agg(F.collect_set("key").alias("k"))
    found = []
    for code, left, right in EXCLUSIVE:
        one, two = (F.array_intersect("k", F.array(*map(F.lit, x))) for x in (left, right))
        found.append(F.when((F.size(one) > 0) & (F.size(two) > 0), F.arrays_zip(F.array_union(one, two).alias("key"), F.array_repeat(F.lit(code), F.size(F.array_union(one, two))).alias("code"))))
    rows = ticked.withColumn("f", F.explode(F.flatten(F.array_compact(F.array(*found)))))
    return _found(rows, F.col("f.key"), F.col("f.code"), {"with": F.col("f.code")})


def check(fields: DataFrame, as_of: str) -> DataFrame:
    """All violations of the records' fields, each code once for a field.

    Seven rules read the series, so values and facts are kept (spilling to
    disk, made again where an executor is lost) rather than made seven times.
    """
    from . import series as sr

    values = sr.series_values(fields).select(*PAGE, "page_kind", "col", "measure", "key", "num", "sys", "dia", "day").persist()
    facts = sr.series_facts(fields).persist()
    seen = sr.visits(values)
    found = formats(values).union(visit_dates(seen, facts, as_of)).union(spikes(values)).union(due_dates(facts)).union(birth_age(facts)).union(history(fields)).union(exclusive(fields))
    return found.groupBy(*PAGE, "key", "code").agg(F.first("params").alias("params"))


def apply(fields: DataFrame, violations: DataFrame) -> DataFrame:
    """Fields with alerts, status, reason and coherence after the check: only read values are flagged, a cleared alert gives KNOWN back."""
    alerts = violations.groupBy(*PAGE, "key").agg(F.array_sort(F.collect_set("code")).alias("__alerts"))
    rows = fields.join(alerts, [*PAGE, "key"], "left")
    mine = (F.coalesce("origin", F.lit("AI")) == "AI") & F.col("__alerts").isNotNull()
    flagged = mine & (F.col("status") == "KNOWN")
    back = ~mine & F.coalesce("coherence", F.lit(False)) & (F.coalesce("origin", F.lit("AI")) == "AI") & (F.col("status") == "NEEDS_REVIEW")
    reason = F.when(flagged, F.coalesce("reason", F.lit("incoherent"))).when(back & (F.col("reason") == "incoherent"), F.lit(None)).otherwise(F.col("reason"))
    new = {"alerts": F.when(mine, F.col("__alerts")), "status": F.when(flagged, "NEEDS_REVIEW").when(back, "KNOWN").otherwise(F.col("status")), "reason": reason,
           "coherence": F.when(mine, F.coalesce("coherence", F.lit(False)) | flagged).otherwise(F.lit(False))}
    return rows.withColumns({f"__{k}_new": c for k, c in new.items()}).drop("__alerts", *[k for k in new if k in rows.columns]).withColumnsRenamed({f"__{k}_new": k for k in new})


def output_violations(fields: DataFrame, kinds=("text", "integer", "date", "weight", "length", "weeks", "sex", "checkbox")) -> DataFrame:
    """page_id, id, code: what a reading must not hold (ids twice, unknown kinds, no label, KNOWN without value, confidence out of range)."""
    w = Window.partitionBy("page_id", "id")
    codes = F.array_compact(F.array(
        F.when(F.count("*").over(w) > 1, "duplicate_id"), F.when(~F.col("kind").isin(*kinds), "unknown_kind"), F.when(F.coalesce(F.trim("label"), F.lit("")) == "", "no_label"),
        F.when((F.col("status") == "KNOWN") & F.col("value").isNull(), "known_without_value"), F.when(~F.col("confidence").between(0, 1), "confidence_range")))
    return fields.withColumn("code", codes).select("page_id", "id", F.explode("code").alias("code"))


def manifest_violations(listed: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem: missing, modified or unlisted files. Both: path, sha256."""
    a, b = listed.select("path", F.col("sha256").alias("want")), files.select("path", F.col("sha256").alias("got"))
    both = a.join(b, "path", "full")
    return both.select("path", F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("got") != F.col("want"), "modified").alias("problem")).where("problem is not null")
