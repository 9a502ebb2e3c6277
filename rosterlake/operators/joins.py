"""Joins that have no keyword of their own: as-of, interval, nearest, edit distance, overlap, greedy one-to-one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_after(left: DataFrame, right: DataFrame, entity: str, left_at: str, right_at: str, name: str = "next_at") -> DataFrame:
    """Left rows with the least right time strictly after theirs, null if none: union and one window, no range join.

    Times are whole numbers (days or microseconds).
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes]
    both = left.select("*", F.lit(True).alias("__left"), F.col(entity).alias("__e"), F.col(left_at).cast("bigint").alias("__t"), F.lit(None).cast("bigint").alias("__r")).union(
        right.select(*none, F.lit(False), F.col(entity), F.col(right_at).cast("bigint"), F.col(right_at).cast("bigint")))
    # latest first, so that the frame only grows: linear in the rows of an entity
    ahead = Window.partitionBy("__e").orderBy(F.col("__t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, F.min("__r").over(ahead)).where("__left").select(*left.columns, name)


def interval_join(df: DataFrame, value: str, bounds: Sequence[float], names: Sequence) -> DataFrame:
    """name: of the interval [bounds[i], bounds[i + 1]) that holds the value; rows outside all are dropped. No shuffle."""
    held = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(value)))
    return df.where((F.col(value) >= bounds[0]) & (F.col(value) < bounds[-1])).withColumn("name", F.get(F.array(*map(F.lit, names)), held - 1))


def nearest_left(values: DataFrame, labels: DataFrame, band: str, x: str, reach: float, label_key: str) -> DataFrame:
    """Each value with the label of its band that stands nearest to its left within reach; values without one are dropped.

    The last label at or before a value is the nearest: labels and values are
    merged and filled forward, so no band is multiplied with itself.
    """
    kind = values.select(F.struct(*values.columns)).schema[0].dataType
    v = values.select(F.struct(*values.columns).alias("row"), F.col(band).alias("b"), F.col(x).cast("double").alias("at"), F.lit(1).alias("o"), F.lit(None).cast("struct<x:double,k:string>").alias("l"))
    t = labels.select(F.lit(None).cast(kind), F.col(band), F.col(x).cast("double"), F.lit(0), F.struct(F.col(x).cast("double").alias("x"), F.col(label_key).cast("string").alias("k")))
    w = Window.partitionBy("b").orderBy("at", "o", F.col("l.k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = v.union(t).withColumn("l", F.last("l", ignorenulls=True).over(w)).where("row is not null")
    return filled.where(F.col("at") - F.col("l.x") <= reach).select("row.*", F.col("l.k").alias("label"), (F.col("at") - F.col("l.x")).alias("distance"))


LOOKALIKE = ("OQDILSZBG", "000115286")


def normalized_code(code: Column, ascii_only: bool = False) -> Column:
    """Upper case, letters and digits only; two spellings of the rule exist for non-ASCII letters."""
    return F.regexp_replace(F.upper(code), "[^A-Z0-9]" if ascii_only else r"[^\p{L}\p{N}]", "")


def lookalike_code(code: Column, ascii_only: bool = False) -> Column:
    """The normalised code with the letters that handwriting mixes up with digits as those digits."""
    return F.translate(normalized_code(code, ascii_only), *LOOKALIKE)


def code_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(lookalike_code(a), lookalike_code(b))


def deletions(code: Column) -> Column:
    """A code and all of it with one character taken out: codes within one edit share one of these."""
    out = F.transform(F.sequence(F.lit(1), F.greatest(F.length(code), F.lit(1))), lambda i: F.concat(F.substring(code, F.lit(1), i - 1), F.substring(code, i + 1, F.length(code))))
    return F.array_distinct(F.concat(F.array(code), out))


def within_one_edit(left: DataFrame, right: DataFrame, left_code: str, right_code: str, keys: tuple[str, str]) -> DataFrame:
    """keys..., distance of all pairs whose look-alike codes are at most one edit apart: equal-key join on deletions, then the distance."""
    sides = []
    for rows, code, key in ((left, left_code, keys[0]), (right, right_code, keys[1])):
        codes = F.array_distinct(F.collect_list(lookalike_code(F.col(code))))
        sides.append(rows.groupBy(key).agg(codes.alias("c")).select(key, (F.size("c") > 1).alias("m"), F.explode("c").alias("c")).where("c <> ''"))
    one, two = sides
    of = lambda rows, name: rows.select(F.col("c").alias(name)).distinct().withColumn("k", F.explode(deletions(F.col(name))))
    # codes are compared once each, however many rows have them
    near = of(one, "lc").join(of(two, "rc"), "k").where(F.levenshtein("lc", "rc", 1) >= 0).select("lc", "rc", F.levenshtein("lc", "rc").cast("int").alias("distance")).distinct()
    a, b = one.select(keys[0], F.col("m").alias("lm"), F.col("c").alias("lc")), two.select(keys[1], F.col("m").alias("rm"), F.col("c").alias("rc"))
    pairs = lambda x, y: x.join(near, "lc").join(y, "rc").select(*keys, "distance")
    # only a key with several codes can meet another at one distance twice
    twice = pairs(a.where("lm"), b).union(pairs(a.where("not lm"), b.where("rm"))).distinct()
    return pairs(a.where("not lm"), b.where("not rm")).union(twice)


def patient_candidates(records: DataFrame, patients: DataFrame) -> DataFrame:
    """record_id, patient_id, reasons, score, place: likely patients of each record, best first.

    records: record_id, code, age, gestation; patients: patient_id, code, age,
    gestation, scan_order. Age within a year and equal gestation are reasons;
    the score is 10 for the same code, else 5, plus the number of reasons.
    """
    pairs = within_one_edit(records, patients, "code", "code", ("record_id", "patient_id"))
    mine, theirs = records.select("record_id", F.col("age").alias("a"), F.col("gestation").alias("g")), patients.select("patient_id", "scan_order", F.col("age").alias("b"), F.col("gestation").alias("h"))
    full = pairs.join(mine, "record_id").join(theirs, "patient_id")
    reasons = F.array_compact(F.array(
        F.when(F.col("distance") == 0, "SAME_CODE").otherwise("SIMILAR_CODE"), F.when(F.col("a") == F.col("b"), "SAME_AGE").when(F.abs(F.col("a") - F.col("b")) <= 1, "CLOSE_AGE"), F.when(F.col("g") == F.col("h"), "SAME_GESTATION")))
    scored = full.withColumn("reasons", reasons).withColumn("score", F.when(F.col("distance") == 0, 10).otherwise(5) + F.size("reasons"))
    w = Window.partitionBy("record_id").orderBy(F.desc("score"), "scan_order", "patient_id")
    return scored.withColumn("place", F.row_number().over(w)).select("record_id", "patient_id", "reasons", "score", "place")


def overlap_argmax(items: DataFrame, forms: DataFrame, item: str, form: str, token: str, least: int, form_rank: str) -> DataFrame:
    """item, form, n_common: the form that shares most distinct tokens with the item, ties to the lower form_rank; none below least."""
    common = items.select(item, token).distinct().join(forms.select(form, form_rank, token).distinct(), token).groupBy(item, form, form_rank).agg(F.count("*").alias("n_common"))
    best = common.where(F.col("n_common") >= least).groupBy(item).agg(F.max_by(F.struct(form, "n_common"), F.struct("n_common", -F.col(form_rank))).alias("m"))
    return best.select(item, f"m.{form}", "m.n_common")


def greedy_match(refs: DataFrame, preds: DataFrame, page: str, least: float = 0.5, penalty: float = 0.1) -> DataFrame:
    """page, ref_id, pred_id, score: one-to-one by token overlap within a page, best score first, then lower pred_order, then lower ref_order.

    refs: page, ref_id, ref_order, tokens; preds: page, pred_id, pred_order,
    tokens (arrays without repeats, no null ids). Pairs come from a join on
    shared tokens; a page's pairs, at most its refs times its preds, meet in
    one row, so a page must be small in itself (a form), however many there are.
    """
    r = refs.select(page, "ref_id", "ref_order", F.col("tokens").alias("rt"))
    p = preds.select(page, "pred_id", "pred_order", F.col("tokens").alias("pt"))
    pairs = r.withColumn("t", F.explode("rt")).join(p.withColumn("t", F.explode("pt")), [page, "t"]).groupBy(page, "ref_id", "ref_order", "pred_id", "pred_order").agg(
        F.count("*").alias("common"), F.first(F.size("rt")).alias("nr"), F.first(F.size("pt")).alias("np"))
    scored = pairs.where(F.col("common") / F.col("nr") >= least).withColumn("score", F.col("common") / F.col("nr") - F.lit(penalty) * (F.col("np") - F.col("common")) / F.col("np"))
    best_first = scored.groupBy(page).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pred_order", "ref_order", "ref_id", "pred_id"))).alias("l"))
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["ref_id"] == x["ref_id"]) | (k["pred_id"] == x["pred_id"]))
    kept = F.aggregate("l", F.filter("l", lambda x: F.lit(False)), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return best_first.select(page, F.explode(kept).alias("m")).select(page, "m.ref_id", "m.pred_id", (-F.col("m.s")).alias("score"))
