"""How far a reading can be trusted: oddities, physical plausibility, first status, reasons of doubt, and small predicates on records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import code_distance, normalized_code
from ..operators.quality import DIASTOLIC, GA_WEEKS, NEWBORN_WEIGHT, POSSIBLE, SYSTOLIC
from ..operators.series import measure_of
from .text import ODD_CHARS, STOPWORDS, bare_word, fold, similarity, special_word
from .values import blood_pressure, parse, plain_number

THRESHOLD, SURE, SINGLE_CAP = 0.7, 0.9, 0.6
NOTHING = r"(?iu)^(ras|aucun|aucune|néant|neant|rien|normal|non|-|0)$"
PERMISSIONS = {"patient_profiles": ["MIDWIFE", "SUPERVISOR"], "original_image": ["MIDWIFE", "SUPERVISOR"], "dashboard": ["SUPERVISOR", "EPIDEMIOLOGIST"], "record_pdf": ["MIDWIFE", "SUPERVISOR"]}
STEPS = [
    ("photo", ["CAPTURED", "PENDING_AI"]), ("reading", ["AI_PROCESSED", "PROCESSING_FAILED"]), ("review", ["NEEDS_REVIEW", "MANUAL_REVIEW_REQUIRED"]),
    ("patient", ["VALIDATED", "SUSPECTED_DUPLICATE"]), ("sent", ["PATIENT_LINKED", "SAVED", "SYNC_FAILED", "SYNCED"]),
]


def noteworthy(value: Column) -> Column:
    """Whether a written value says more than "nothing to report"."""
    return F.coalesce((value != "false") & ~F.trim(value).rlike(NOTHING), F.lit(False))


def allowed(role: Column, permission: str, table: Mapping[str, Sequence[str]] = PERMISSIONS) -> Column:
    return role.isin(*table[permission])


def step_index(state: Column) -> Column:
    """Place of a state among the five steps, from 0; -1 for none."""
    out = F.lit(-1)
    for i, (_, states) in enumerate(STEPS):
        out = F.when(state.isin(*states), i).otherwise(out)
    return out


def search_match(code: Column, query: Column) -> Column:
    """Whether a code holds the query or is within one edit of it, look-alikes being equal."""
    return normalized_code(code, True).contains(normalized_code(query, True)) | (code_distance(code, query) <= 1)


def suggestions(patients: DataFrame, code: str, query: str, most: int = 4) -> DataFrame:
    """At most ``most`` patients whose codes are within two edits of the query: a top-k report."""
    near = patients.withColumn("distance", code_distance(F.col(code), F.lit(query)))
    return near.where("distance <= 2").orderBy("distance", code).limit(most)


def looks_odd(text: Column) -> Column:
    """Almost "ras" (one letter off), nearly nothing, or stray characters."""
    t, raw = fold(text), F.trim(text)
    differ = sum(((F.substring(t, i + 1, 1) != c).cast("int") for i, c in enumerate("ras")), F.lit(0))
    few = (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) < 2) & ~raw.rlike(r"^\d+$")
    return ((F.length(t) == 3) & (differ == 1)) | few | raw.rlike(r"[^\p{L}\p{N} /.,'\-°:()+%]")


def plausible(label: Column, text: Column) -> Column:
    """Whether the value can be for its row; null for rows that measure nothing."""
    bp, n = blood_pressure(text), plain_number(text)
    kg = F.lower(label).contains("kg") | (n >= 25)
    whole = F.trim(text).rlike(r"(?i)^\d{1,3}(?:[.,]\d)?\s*[/\\]\s*\d{1,3}(?:[.,]\d)?\s*(?:[mc]m ?hg)?$")
    bp_ok = whole & bp["sys"].between(*SYSTOLIC) & bp["dia"].between(*DIASTOLIC) & (bp["sys"] > bp["dia"])

    def judged(m):
        out = F.when(m == "bp", F.coalesce(bp_ok, F.lit(False))).when(m == "gaWeeks", F.coalesce(n.between(*GA_WEEKS), F.lit(False)))
        weight = F.when(kg, n.between(*POSSIBLE["weight"])).otherwise(n.between(*NEWBORN_WEIGHT) | (n < 10))
        out = out.when(m == "weight", F.coalesce(weight, F.lit(False)))
        for name, bounds in POSSIBLE.items():
            if name != "weight":
                out = out.when(m == name, F.coalesce(n.between(*bounds), F.lit(False)))
        return out

    return F.element_at(F.transform(F.array(measure_of(label)), judged), 1)


def pipe_reading(label: Column, kind: Column, text: Column) -> Column:
    """A bar next to a digit is a one or the edge of a box: the first reading that can be; a one if neither can."""
    one, edge = F.regexp_replace(text, r"\|(?=\d)|(?<=\d)\|", "1"), F.trim(F.replace(text, F.lit("|"), F.lit("")))
    ok = lambda c: F.coalesce(plausible(label, c), F.when(kind != "text", parse(kind, c, label)["ok"]), F.lit(False))
    return F.when(~text.rlike(r"\|\d|\d\|"), text).when(ok(one), one).when(ok(edge), edge).otherwise(one)


def first_status(kind: Column, text: Column, label: Column, score: Column, threshold: float = THRESHOLD) -> Column:
    """struct<value, status, confidence> of a text as it was read; without text nothing is provided."""
    made = lambda v, s, c: F.struct(v.cast("string").alias("value"), (F.lit(s) if isinstance(s, str) else s).alias("status"), F.bround(c.cast("double"), 3).alias("confidence"))
    bare = F.regexp_replace(text, r"^[\s:;_.,]+(?=\S)", "")
    t = F.when(text.rlike(r"[\p{L}\p{N}]"), bare).otherwise(text)
    trimmed = (t != F.trim(text)) & (kind == "text")
    word, p = special_word(t), parse(kind, t, label)
    odd = looks_odd(t) | trimmed
    conf = score * F.when(p["ok"], 1.0).otherwise(0.6) * F.when(odd, 0.6).otherwise(1.0)
    sure = (score >= SURE) & p["ok"] & ~odd & (conf >= threshold)
    none = F.lit(None)
    return (
        F.when(F.coalesce(t, F.lit("")).rlike(r"^(?:[\s._…·]*|[\s._…·\-–—]{3,})$"), made(none, "NOT_PROVIDED", F.lit(0.9))).when(word == "unknown", made(none, "UNKNOWN", score))
        .when(word == "illegible", made(none, "ILLEGIBLE", score)).otherwise(made(F.coalesce(p["value"], t), F.when(sure, "KNOWN").otherwise("NEEDS_REVIEW"), conf))
    )


def flagged(fields: DataFrame, label_reason: Column, new_choice: Column, chosen_new: Column) -> DataFrame:
    """Fields with a reason for each doubt: the one they have, the label's, a new choice, else a doubtful value; distrusted KNOWN ones go to review.

    new_choice: an option isn't in the vocabulary; chosen_new: and it is ticked.
    """
    had = F.col("reason").isNotNull()
    reason = F.coalesce("reason", label_reason, F.when(new_choice, "choix_nouveau"))
    distrust = ~had & (label_reason.isNotNull() | (new_choice & chosen_new))
    down = F.coalesce(distrust, F.lit(False)) & (F.col("status") == "KNOWN")
    rows = fields.withColumns({"__reason": reason, "__down": down})
    rows = rows.withColumns({"status": F.when(F.col("__down"), "NEEDS_REVIEW").otherwise(F.col("status")), "confidence": F.when(F.col("__down"), F.least("confidence", F.lit(SINGLE_CAP))).otherwise(F.col("confidence"))})
    return rows.withColumn("reason", F.coalesce("__reason", F.when(F.col("status") == "NEEDS_REVIEW", "valeur_douteuse"))).drop("__reason", "__down")


def place_corrected(fields: DataFrame, suggestion: str) -> DataFrame:
    """Values replaced by a suggested place; what was read is kept in read_value, and the field is for review."""
    s = F.trim(suggestion)
    use = F.coalesce((F.length(s).between(1, 60)) & (fold(s) != fold(F.col("value"))) & ~F.upper(s).isin("EMPTY", "ILLEGIBLE"), F.lit(False))
    rows = fields.withColumn("__use", use)
    known = F.col("__use") & (F.col("status") == "KNOWN")
    return rows.select(
        *[c for c in fields.columns if c not in ("value", "read_value", "reason", "status", "confidence")], F.when(F.col("__use"), s).otherwise(F.col("value")).alias("value"), F.when(F.col("__use"), F.col("value")).otherwise(F.col("read_value")).alias("read_value"),
        F.when(F.col("__use"), "lieu_corrige").otherwise(F.col("reason")).alias("reason"), F.when(known, "NEEDS_REVIEW").otherwise(F.col("status")).alias("status"), F.when(known, F.least("confidence", F.lit(SINGLE_CAP))).otherwise(F.col("confidence")).alias("confidence"))


def verdict(answer: Column, values: Column) -> Column:
    """juste, fausse or abstention of an answer against the written values (an array)."""
    norm = lambda c: F.regexp_replace(fold(c), r"[\s.,;:|]+", "")
    a = F.trim(answer)
    right = F.array_contains(F.transform(values, norm), norm(a)) | (norm(F.array_join(values, " ")) == norm(a))
    return F.when(F.upper(a).startswith("ILLEGIBLE"), "abstention").when(F.size(values) == 0, F.when((a == "") | F.upper(a).startswith("EMPTY"), "juste").otherwise("fausse")).when(right, "juste").otherwise("fausse")


def verdict_shares(rows: DataFrame, prompt: str, answer: str, values: str) -> DataFrame:
    """prompt, n, juste, fausse, abstention."""
    v = rows.withColumn("v", verdict(F.col(answer), F.col(values)))
    return v.groupBy(prompt).agg(F.count("*").alias("n"), *[F.count_if(F.col("v") == x).alias(x) for x in ("juste", "fausse", "abstention")])


def known_words(words: DataFrame, vocabulary: DataFrame, word: str = "word", ratio: float = 0.8) -> DataFrame:
    """word: the distinct words that the vocabulary holds, or nearly (four letters or more, lengths within two, similarity by ratio).

    Exact hits are an equal join; the rest meets vocabulary words of like length
    and shared first or last letter pair, before the ratio is worked out in Python.
    """
    w = words.select(F.col(word).alias("word")).distinct().withColumn("bare", bare_word(F.col("word")))
    v = vocabulary.select(bare_word(F.col(word)).alias("bare")).distinct()
    exact = w.join(v, "bare", "left_semi").select("word")
    rest = w.join(v, "bare", "left_anti").where(F.length("bare") >= 4)
    # a ratio of 0.8 with lengths within two leaves a common bigram
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    left = rest.withColumn("n", F.length("bare")).withColumn("g", F.explode(pairs(F.col("bare"))))
    right = v.select(F.col("bare").alias("known"), F.length("bare").alias("m"), F.explode(pairs(F.col("bare"))).alias("g"))
    near = left.join(right, "g").where(F.abs(F.col("n") - F.col("m")) <= 2).select("word", "bare", "known").distinct()
    return exact.union(near.where(similarity("known", "bare") >= ratio).select("word").distinct())


def label_reasons(fields: DataFrame, vocabulary: DataFrame, label: str = "label", share: float = 0.75) -> DataFrame:
    """fields with label_reason: etiquette_douteuse (misread), champ_nouveau (too few known words), or null.

    vocabulary: word. A word is known as known_words() has it: in the vocabulary,
    or nearly. Each different label is judged once; without any vocabulary there
    is nothing to say about labels. A null label is misread.
    """
    text = F.regexp_replace(F.replace(F.col("l"), F.lit("|"), F.lit(" ")), r"(?<=[\p{L}\p{N}_])\.(?=[\p{L}\p{N}_])", "")
    chars = F.regexp_replace(text, r"\s", "")
    words = F.filter(F.split(F.replace(fold(text), F.lit("/"), F.lit(" ")), " "), lambda w: (w != "") & ~w.isin(STOPWORDS) & ~w.rlike(r"^\d+$"))
    labels = fields.select(F.coalesce(label, F.lit("")).alias("l")).distinct()
    odd = text.rlike(ODD_CHARS) | (chars == "") | (F.regexp_count(chars, F.lit(r"\p{L}")) < 0.6 * F.length(chars)) | (F.size(words) == 0)
    labels = labels.select("l", odd.alias("odd"), words.alias("words"))
    single = labels.where("not odd").select("l", F.explode("words").alias("word"))
    known = known_words(single, vocabulary.select(F.explode(F.split(fold(F.col("word")), " ")).alias("word")).where("word <> ''")).withColumn("known", F.lit(1))
    shares = single.join(known, "word", "left").groupBy("l").agg(F.avg(F.coalesce("known", F.lit(0))).alias("share"))
    reason = F.when(F.lit(vocabulary.isEmpty()), F.lit(None)).when(F.col("odd"), "etiquette_douteuse").when(F.col("share") < share, "champ_nouveau")
    judged = labels.join(shares, "l", "left").select("l", reason.alias("label_reason"))
    return fields.join(judged, F.coalesce(fields[label], F.lit("")) == judged["l"], "left").drop("l")
