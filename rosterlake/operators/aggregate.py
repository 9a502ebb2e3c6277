"""Population aggregates with small-cell suppression.

Every operator takes column names and works on whole tables at once: partial
aggregation first, one shuffle on the group keys. Dense domains (bins, fixed
categories) are filled from a map of the counts, which holds as many entries as
the domain, so no join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 5
#: (low, high, step) of the shipped histograms.
BINS = {
    "systolic": (70, 160, 10),
    "diastolic": (40, 110, 10),
    "temperature": (35.0, 40.0, 0.5),
    "hemoglobin": (7, 16, 1),
    "birthWeight": (1500, 5000, 500),
    "gaAtBirth": (30, 44, 2),
}
TRIMESTERS = (13, 27)
PRETERM_WEEKS = 37


def mask(n: Column, k: int = K) -> Column:
    """Null for 1 to k - 1; 0 and larger counts as they are."""
    return F.when(n.between(1, k - 1), F.lit(None)).otherwise(n)


def number(text: Column) -> Column:
    """Tolerant number: null where it isn't one."""
    return F.trim(text).try_cast("double")


def bin_index(value: Column, lo: float, hi: float, step: float) -> Column:
    """-1 below lo, the number of bins at hi and above, else the bin."""
    n = len(edges(lo, hi, step))
    return F.when(value < lo, -1).when(value >= hi, n).otherwise(F.least(F.floor((value - lo) / step).cast("int"), F.lit(n - 1)))


def edges(lo: float, hi: float, step: float) -> list[float]:
    out, x = [], lo
    while x < hi:
        out.append(x)
        x = round(x + step, 2)
    return out


def histogram(df: DataFrame, value: str, lo: float, hi: float, step: float, by: Sequence[str] = (), k: int | None = K, complementary: bool = False) -> DataFrame:
    """by..., bin, from_value, to_value, n, total: all bins of every group, open ones at both ends, small counts masked.

    complementary: where a group has a single masked bin, its smallest other
    non-empty bin is masked too, so that the total doesn't give it away.
    """
    n = len(edges(lo, hi, step))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, bin_index(F.col(value), lo, hi, step).alias("bin")).agg(F.count("*").alias("c"))
    held = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"), F.sum("c").alias("total"))
    rows = held.select(*by, "m", "total", F.explode(F.sequence(F.lit(-1), F.lit(n))).alias("bin"))
    raw = F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("bigint")
    shown = mask(raw, k) if k else raw
    if complementary and k:
        small = F.size(F.filter(F.map_values("m"), lambda c: c.between(1, k - 1)))
        next_least = F.array_min(F.filter(F.map_values("m"), lambda c: c >= k))
        first = F.array_min(F.map_keys(F.map_filter("m", lambda _, c: c == next_least)))
        shown = F.when((small == 1) & (F.col("bin") == first), F.lit(None)).otherwise(shown)
    at = F.lit(lo) + F.col("bin") * F.lit(step)
    return rows.select(
        *by, "bin", F.when(F.col("bin") >= 0, at).cast("double").alias("from_value"),
        F.when(F.col("bin") < 0, F.lit(lo)).when(F.col("bin") < n, at + step).cast("double").alias("to_value"), shown.alias("n"), "total")


def dense_counts(df: DataFrame, key: str, domain: Sequence[str], by: Sequence[str] = (), k: int | None = K) -> DataFrame:
    """by..., key, n: a row for every value of the domain, also where it doesn't occur."""
    counts = df.where(F.col(key).isin(*domain)).groupBy(*by, key).agg(F.count("*").alias("c"))
    held = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(key, "c"))).alias("m"))
    raw = F.coalesce(F.try_element_at("m", F.col(key)), F.lit(0)).cast("bigint")
    rows = held.select(*by, "m", F.explode(F.array(*map(F.lit, domain))).alias(key))
    return rows.select(*by, key, (mask(raw, k) if k else raw).alias("n"))


def mean_per_entity(df: DataFrame, entity: Sequence[str], value: str, name: str = "mean_value") -> DataFrame:
    """One mean for each entity that has a value."""
    return df.where(F.col(value).isNotNull()).groupBy(*entity).agg(F.avg(value).alias(name))


def suppress_small(df: DataFrame, by: Sequence[str], value: Column, name: str, k: int = K) -> DataFrame:
    """by..., population (masked), the value where the population is k or more, suppressed."""
    agg = df.groupBy(*by).agg(F.count("*").alias("p"), value.alias("v"))
    return agg.select(*by, mask(F.col("p"), k).alias("population"), F.when(F.col("p") >= k, F.col("v")).alias(name), (F.col("p") < k).alias("suppressed"))


def dominant(df: DataFrame, entity: str, outcome: str, ranking: Sequence[str], default: Column | str = "none") -> DataFrame:
    """The outcome of each entity that ranks first; default if none of the ranking occurs."""
    rank = F.lit(None).cast("int")
    for i, x in reversed(list(enumerate(ranking))):
        rank = F.when(F.col(outcome) == x, i).otherwise(rank)
    best = df.groupBy(entity).agg(F.min(rank).alias("r"))
    return best.select(entity, F.coalesce(F.get(F.array(*map(F.lit, ranking)), "r"), default if isinstance(default, Column) else F.lit(default)).alias("outcome"))


def band(value: Column, bounds: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the first bound that the value doesn't exceed; the last name beyond all."""
    out = F.lit(names[-1])
    for b, name in reversed(list(zip(bounds, names, strict=False))):
        out = F.when(value <= b, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def first_banded(df: DataFrame, entity: str, value: str, bounds: Sequence[float], names: Sequence[str], seed: float = 99) -> DataFrame:
    """entity, first_value (least value, at most seed), band."""
    least = df.where(F.col(value).isNotNull()).groupBy(entity).agg(F.least(F.min(value), F.lit(seed)).alias("first_value"))
    return least.withColumn("band", band(F.col("first_value"), bounds, names))


def capped_distinct(df: DataFrame, entity: str, value: Column, cap: int = 9) -> DataFrame:
    """entity, n: distinct values, at most cap; entities without a value are left out."""
    n = df.select(entity, value.alias("v")).where("v is not null").groupBy(entity).agg(F.count_distinct("v").alias("c"))
    return n.select(entity, F.least("c", F.lit(cap)).cast("bigint").alias("n"))


def last_known(df: DataFrame, entity: Sequence[str], value: str, order: Sequence[str], name: str = "last_value") -> DataFrame:
    """The value of each entity that comes last in the order, nulls passed over."""
    return df.where(F.col(value).isNotNull()).groupBy(*entity).agg(F.max_by(value, F.struct(*order)).alias(name))


def priority_pick(df: DataFrame, entity: str, value: str, ranking: Sequence[str], default: str) -> DataFrame:
    """As dominant: the most specific of the ticked values."""
    return dominant(df, entity, value, ranking, default).withColumnRenamed("outcome", "picked")


def completeness(df: DataFrame, measures: dict[str, Column], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """by..., measure, recorded (masked), total."""
    agg = df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"__{m}") for m, c in measures.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"__{m}").alias("c")) for m in measures])).alias("p")
    return agg.select(*by, "total", pairs).select(*by, F.col("p.measure").alias("measure"), mask(F.col("p.c"), k).alias("recorded"), "total")


def document_frequency(df: DataFrame, text: Column, group: str, least: int = 5) -> DataFrame:
    """word, n_groups of the words that occur in ``least`` groups or more."""
    words = df.select(group, F.explode(F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))).alias("word")).distinct()
    return words.groupBy("word").agg(F.count("*").alias("n_groups")).where(F.col("n_groups") >= least)


def domain_gate(df: DataFrame, entity: str, text: Column, prefixes: Sequence[str], vocabulary: Sequence[str], strong: int = 3, weak: int = 1, known: int = 5) -> DataFrame:
    """entity, n_prefixes, n_known, accepted: enough domain prefixes, or one and enough known words. No shuffle."""
    words = F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))
    hit = F.size(F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.exists(F.col("__w"), lambda w: w.startswith(p))))
    seen = F.size(F.array_intersect("__w", F.array(*map(F.lit, vocabulary))))
    out = df.select(entity, words.alias("__w")).select(entity, hit.cast("bigint").alias("n_prefixes"), seen.cast("bigint").alias("n_known"))
    return out.withColumn("accepted", (F.col("n_prefixes") >= strong) | ((F.col("n_prefixes") >= weak) & (F.col("n_known") >= known)))


def stratified_sample(df: DataFrame, stratum: str, key: str, share: float, seed: str = "") -> DataFrame:
    """The first ceil(share of the stratum) rows of each stratum in the order of a hash of the key; a sampling operator."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    sizes = df.groupBy(stratum).agg(F.ceil(F.count("*") * share).alias("__take"))
    placed = df.withColumn("__h", h).join(sizes, stratum)
    return placed.withColumn("__r", F.expr(f"row_number() over (partition by {stratum} order by __h, {key})")).where("__r <= __take").drop("__h", "__r", "__take")


def conflict_groups(df: DataFrame, content: Column, key: str) -> DataFrame:
    """key, canonical (the least key with that content), n_same: rows whose content occurs twice or more."""
    tagged = df.select(key, F.sha2(content, 256).alias("h"))
    groups = tagged.groupBy("h").agg(F.min(key).alias("canonical"), F.count("*").alias("n_same")).where("n_same > 1")
    return tagged.join(groups, "h").select(key, "canonical", "n_same")


OUTCOMES = ("correct", "a_revoir", "statut_different", "manque", "erreur_silencieuse")


def outcome(pred_status: Column, ref_status: Column, same_value: Column) -> Column:
    """What became of a field: right, to review, other status, missed or silently wrong."""
    return (
        F.when(pred_status == "NEEDS_REVIEW", "a_revoir")
        .when((ref_status == "KNOWN") & (pred_status == "KNOWN"), F.when(same_value, "correct").otherwise("erreur_silencieuse"))
        .when(ref_status == "KNOWN", "manque")
        .when(pred_status == "KNOWN", "erreur_silencieuse")
        .when(pred_status == ref_status, "correct")
        .otherwise("statut_different")
    )


def evaluation_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares over rows of (outcome, pred_status, ref_status): one row for each group, shares half-even to 3 places."""
    ok, known, auto = F.col("outcome") == "correct", F.col("ref_status") == "KNOWN", F.col("pred_status") != "NEEDS_REVIEW"
    share = lambda a, b: F.bround(F.try_divide(F.count_if(a).cast("double"), F.count_if(b) if b is not None else F.count("*")), 3)
    return rows.groupBy(*by).agg(
        F.count("*").alias("fields"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        share(ok, None).alias("accuracy"), share(ok & known, known).alias("known_accuracy"), share(F.col("outcome") == "a_revoir", None).alias("review_share"), share(ok & auto, auto).alias("auto_accuracy"))
