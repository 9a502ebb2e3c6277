"""Typed readings of written values, as Column expressions: numbers, dates, weights, pressures, categories.

Dates are never guessed: impossible ones are null (``try_to_date``), partial
ones keep their precision. Rounding is half to even throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, special_word


def first_number(text: Column) -> Column:
    """The first number: thousands may stand apart, decimals follow a comma or a point."""
    t = F.replace(text, F.lit(","), F.lit("."))
    apart = F.regexp_extract(t, r"(?<!\d)(\d{1,2} \d{3})(?!\d)", 1)
    return F.when(apart != "", F.replace(apart, F.lit(" "), F.lit("")).try_cast("double")).otherwise(F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double"))


def plain_number(text: Column) -> Column:
    """The first number with a decimal comma or point."""
    return F.replace(F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def day_of(y: Column, m: Column, d: Column) -> Column:
    """A date of the Gregorian calendar from its numbers, null if there is none."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), two(m), F.lit("-"), two(d)).try_cast("date")


def parse_date(text: Column) -> Column:
    """struct<value, precision, ok>: ISO text to the day, month or year that was written."""
    t = F.translate(F.regexp_replace(text, r"\s+", ""), "-.", "//")
    full = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
    part = lambda rule, i: F.regexp_extract(t, rule, i).try_cast("int")
    year = F.when(part(full, 3) < 100, part(full, 3) + 2000).otherwise(part(full, 3))
    day = day_of(year, part(full, 2), part(full, 1))
    month = r"^(\d{1,2})/(\d{4})$"
    made = lambda value, precision, ok: F.struct(value.alias("value"), F.lit(precision).alias("precision"), ok.alias("ok"))
    return (
        F.when(t.rlike(full), made(day.cast("string"), "day", F.coalesce(day.isNotNull() & year.between(1950, 2100), F.lit(False))))
        .when(t.rlike(month), made(F.format_string("%04d-%02d", part(month, 2), part(month, 1)), "month", F.coalesce(part(month, 1).between(1, 12), F.lit(False))))
        .when(t.rlike(r"^(19|20)\d{2}$"), made(t, "year", F.lit(True)))
        .otherwise(made(F.lit(None).cast("string"), None, F.lit(False)))
    )


def iso_date(text: Column) -> Column:
    """A full date only, as ISO text; ISO-shaped text passes as it is."""
    t = F.trim(text)
    full = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$"
    bare = F.regexp_replace(t, r"\s+", "")
    part = lambda i: F.regexp_extract(bare, full, i).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(bare.rlike(full), day_of(year, part(2), part(1)).cast("string"))


def weight_grams(text: Column, label: Column) -> Column:
    """struct<value, ok>: grams, the unit taken from text, label or size; plausible for a mother or a newborn."""
    n, t = first_number(text), fold(text)
    kg_label = F.array_contains(F.split(fold(label), " "), "kg")
    in_kg = t.contains("kg") | (n < 10) | (kg_label & ~t.rlike(r"\d\s*g\b"))
    grams = F.when(in_kg, n * 1000).otherwise(n)
    adult = kg_label | (t.contains("kg") & (n >= 25))
    ok = F.when(adult, grams.between(25_000, 250_000)).otherwise(grams.between(300, 7000))
    return F.struct(F.rint(grams).cast("int").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))


def blood_pressure(text: Column) -> Column:
    """struct<sys, dia>, null if there is none; both below 30 are taken as centimetres of mercury."""
    rule = r"(\d{2,3}(?:[.,]\d)?)\s*[/\\]\s*(\d{1,3}(?:[.,]\d)?)"
    part = lambda i: F.replace(F.regexp_extract(text, rule, i), F.lit(","), F.lit(".")).try_cast("double")
    s, d = part(1), part(2)
    scale = F.when((s < 30) & (d < 30), 10).otherwise(1)
    return F.when(s.isNotNull() & d.isNotNull(), F.struct(F.rint(s * scale).cast("int").alias("sys"), F.rint(d * scale).cast("int").alias("dia")))


TESTS = ("hiv", "syphilis", "hbs", "hcv", "toxo", "rubella")


def category(measure: Column, text: Column, folded: Column | None = None) -> Column:
    """neg, pos, traces, immune, non_immune, yes, no, or null. Punctuation is gone from folded text, so signs are read on the raw one.

    folded: the folded text, where a column holds it already.
    """
    t, raw = fold(text) if folded is None else folded, F.trim(text)
    test = measure.isin(*TESTS)
    return (
        F.when(test & t.rlike("non immun"), "non_immune").when(test & t.rlike("immun"), "immune")
        .when(t.rlike(r"^(?:neg\w*|negati\w*|0|absent\w*|negative)$"), "neg")
        .when(t.rlike(r"^(?:pos\w*|positi\w*|present\w*)$") | raw.rlike(r"^\+{1,4}$"), "pos")
        .when(t.rlike("trace"), "traces").when(t.rlike("^(?:oui|yes|o)$"), "yes").when(t.rlike(r"^(?:non|no|aucun\w*|ras|n)$"), "no")
    )


def age_days(text: Column, n: Column | None = None, folded: Column | None = None) -> Column:
    """Days from days, weeks or months. n, folded: the number and the folded text, where columns hold them already."""
    n, t = plain_number(text) if n is None else n, fold(text) if folded is None else folded
    return F.when(t.rlike(r"\bsem|\bsemaines?\b|\bweeks?\b"), n * 7).when(t.rlike(r"\bmois\b|\bmonths?\b"), n * 30).otherwise(n).cast("int")


def parse(kind: Column, text: Column, label: Column) -> Column:
    """struct<value, ok>: the value of a written text by its kind, as text."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n, f = first_number(t), fold(t)
    made = lambda v, ok: F.struct(v.cast("string").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))
    whole = n == F.floor(n)
    digits = F.replace(F.replace(f, F.lit("ans"), F.lit("")), F.lit(" "), F.lit(""))
    w, d = weight_grams(t, label), parse_date(t)
    shown = F.when(whole, n.cast("int").cast("string")).otherwise(n.cast("string"))
    return (
        F.when(t == "", made(F.lit(None), F.lit(False)))
        .when((special_word(t) == "none") & ~kind.isin("integer", "weight", "length", "weeks", "sex"), made(F.lit("aucun"), F.lit(True)))
        .when(kind == "text", made(F.regexp_replace(t, r"\s+", " "), F.lit(True)))
        .when(kind == "integer", F.when(digits.rlike(r"^\d{1,3}$"), made(digits.try_cast("int"), F.lit(True))).otherwise(made(F.when(whole, n.cast("int")), F.lit(False))))
        .when(kind == "date", made(d["value"], d["ok"])).when(kind == "weight", made(w["value"], w["ok"]))
        .when(kind == "length", made(shown, n.between(10, 70))).when(kind == "weeks", made(n.cast("int"), whole & n.between(4, 45)))
        .when(kind == "sex", F.when(f.isin("f", "fille", "feminin", "femme"), made(F.lit("F"), F.lit(True))).when(f.isin("m", "g", "garcon", "masculin", "homme"), made(F.lit("M"), F.lit(True))).otherwise(made(F.lit(None), F.lit(False))))
    )


def comparable(kind: Column, text: Column) -> Column:
    """One form for equal values: what parse makes of it, folded; empty for null."""
    p = parse(kind, text, F.lit(""))
    return F.when(text.isNull(), "").when(kind == "checkbox", F.lower(text)).otherwise(fold(F.when(p["ok"] & p["value"].isNotNull(), p["value"]).otherwise(text)))


def days_late(as_of: Column, due: Column) -> Column:
    """Whole days since noon of the due day; -1 on the morning of that day."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(due.cast("timestamp")) - 43_200) / 86_400).cast("int")


def due_bucket(late: Column) -> Column:
    return F.when(late > 30, "LOST").when(late > 0, "LATE").when(late >= -7, "SOON").otherwise("LATER")


def confidence(score: Column, format_ok: Column, odd: Column) -> Column:
    return F.bround(score * F.when(format_ok, 1.0).otherwise(0.6) * F.when(odd, 0.6).otherwise(1.0), 3)
