"""The population panels in tidy form: panel, metric, bin, from_value, to_value, n, total.

Women are one row each (see operators.series.profiles, or a cohort file); every
panel is a histogram or dense counts over them, with small cells masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as ag

TESTS = ("hiv", "syphilis", "hbs", "hcv")
PLACES = ("maternite", "clinique_privee", "maison_accouchement", "domicile", "autre")


def cohort(rows: DataFrame) -> DataFrame:
    """Women of the synthetic cohort file (all columns text). Blank cells are null; a blood pressure of 0 counts as missing."""
    num = lambda c: ag.number(F.col(f"`{c}`"))
    test = lambda c: F.when(num(c).isNull(), "notRecorded").when(num(c) == 1, "pos").otherwise("neg")
    mode = num("type of delivery (0=vaginal,1=cesarean)")
    return rows.select(
        F.lit(True).alias("antenatal"), F.nullif(num("mean systolic bp (mmhg)"), F.lit(0.0)).alias("systolic"), F.nullif(num("mean diastolic bp (mmhg)"), F.lit(0.0)).alias("diastolic"),
        F.nullif(num("hemoglobin (g/dl)"), F.lit(0.0)).alias("hemoglobin"), F.lit(None).cast("double").alias("temperature"), num("gestational age at enrollment (weeks)").alias("firstGa"), F.lit(0).alias("n_visits"),
        F.when(mode.isNotNull(), F.when(mode == 1, "cesarean").otherwise("vaginal")).alias("mode"), F.lit(None).cast("string").alias("place"), num("child birth weight (g)").alias("birthWeight"),
        num("gestational age at birth (weeks)").alias("gaAtBirth"), test("hiv test result").alias("hiv"), test("syphilis test result").alias("syphilis"), F.lit(None).cast("string").alias("hbs"), test("hepatitis c test result").alias("hcv"))


def build(women: DataFrame, k: int = ag.K) -> DataFrame:
    """All panels; no rows at all for fewer than k women.

    One scan and one shuffle: every woman gives a cell to each metric, the
    counts of the cells (as many as the panels have bins) become one map, and
    the rows of all panels are looked up in it.
    """
    nonzero = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    cells: dict[str, Column] = {"women": F.lit("all")}
    shown: list[tuple] = []  # panel, metric, bin, from_value, to_value, what its total counts, what must occur
    for metric, panel in (("systolic", "bp"), ("diastolic", "bp"), ("temperature", "temperature"), ("hemoglobin", "hemoglobin"), ("birthWeight", "delivery"), ("gaAtBirth", "delivery")):
        lo, hi, step = ag.BINS[metric]
        n = len(ag.edges(lo, hi, step))
        cells[metric] = F.when(nonzero(metric).isNotNull(), ag.bin_index(nonzero(metric), lo, hi, step).cast("string"))
        at = lambda b: float(lo + b * step)  # noqa: B023, E731
        shown += [(panel, metric, str(b), at(b) if b >= 0 else None, float(lo) if b < 0 else at(b) + step if b < n else None, metric, None if panel == "delivery" else metric) for b in range(-1, n + 1)]
    counts = {
        "firstVisit": ("anc", ag.band(F.col("firstGa"), ag.TRIMESTERS, ("t1", "t2", "t3")), ("t1", "t2", "t3")),
        "visitCounts": ("anc", F.when(F.col("n_visits") > 0, F.least("n_visits", F.lit(9)).cast("string")), tuple("123456789")),
        "mode": ("delivery", F.col("mode"), ("vaginal", "cesarean")),
        "place": ("delivery", F.col("place"), PLACES),
        "preterm": ("delivery", F.when(nonzero("gaAtBirth") < ag.PRETERM_WEEKS, "preterm").when(nonzero("gaAtBirth").isNotNull(), "term"), ("preterm", "term")),
    }
    cells["some visitCounts"] = F.when(F.col("n_visits") > 0, "all")
    for t in TESTS:  # a test that no woman has is left out, and so are visits that nobody has
        counts[t] = ("tests", F.coalesce(F.col(t), F.when(F.col("antenatal"), "notRecorded").otherwise("noPage")), ("pos", "neg", "notRecorded", "noPage"))
        cells[f"some {t}"] = F.when(F.col(t).isNotNull(), "all")
    for metric, (panel, value, domain) in counts.items():
        cells[metric] = F.when(value.isin(*domain), value)
        shown += [(panel, metric, b, None, None, None, f"some {metric}" if panel == "tests" or metric == "visitCounts" else None) for b in domain]
    births = F.col("mode").isNotNull() | nonzero("birthWeight").isNotNull()
    known = {"bp": nonzero("systolic").isNotNull(), "hemoglobin": nonzero("hemoglobin").isNotNull(), "hiv": F.col("hiv").isin("pos", "neg"), "syphilis": F.col("syphilis").isin("pos", "neg"), "birthWeight": births & nonzero("birthWeight").isNotNull()}
    for measure, there in known.items():
        cells[f"recorded {measure}"] = F.when(there, measure)
        shown.append(("completeness", "recorded", measure, None, None, "women", None))
    one = [F.struct(F.lit(m).alias("m"), v.alias("b")) for m, v in cells.items()]
    each = women.select(F.explode(F.array(*one)).alias("c")).select("c.*").where("b is not null").groupBy("m", "b").agg(F.count("*").alias("c"))
    totals = each.groupBy("m").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("bins"), F.sum("c").alias("total"))
    held = totals.agg(F.map_from_entries(F.collect_list(F.struct("m", F.struct("bins", "total")))).alias("held"))
    null = lambda x, kind: F.lit(x).cast(kind)
    spec = F.array(*[
        F.struct(F.lit(p).alias("panel"), F.lit(m).alias("metric"), F.lit(b).alias("bin"), null(f, "double").alias("from_value"), null(t, "double").alias("to_value"), null(total, "string").alias("of"), null(must, "string").alias("must"),
                 F.lit(f"recorded {b}" if p == "completeness" else m).alias("at")) for p, m, b, f, t, total, must in shown])
    rows = held.select("held", F.explode(spec).alias("s")).select("held", "s.*")
    total = lambda m: F.try_element_at("held", m)["total"]
    rows = rows.where((F.coalesce(total(F.lit("women")), F.lit(0)) >= k) & (F.col("must").isNull() | (total(F.col("must")) > 0)))
    n = F.coalesce(F.try_element_at(F.try_element_at("held", F.col("at"))["bins"], F.col("bin")), F.lit(0)).cast("bigint")
    return rows.select("panel", "metric", "bin", "from_value", "to_value", ag.mask(n, k).alias("n"), F.when(F.col("of").isNotNull(), total(F.col("of"))).alias("total"))
