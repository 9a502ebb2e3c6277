"""How values are shown and typed corrections are read, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import day_of

UNITS = {"weight": "g", "length": "cm", "weeks": "SA"}
# Answers that users type. "aucun" is none of them: it is an answer of its own.
TYPED_UNKNOWN = ["?", "??", "inconnu", "inconnue", "nsp", "ne sait pas"]
EMPTY_WORDS = ["-", "vide", "non renseigné"]
YES_WORDS = ["oui", "o", "x", "coché", "coche", "vrai", "yes"]
NO_WORDS = ["non", "n", "faux", "no", "pas coché"]


def show(kind: Column, value: Column, status: Column, heavy_in_kg: bool = True) -> Column:
    """A value as text; mothers' weights in kilograms unless told otherwise (reports always give grams)."""
    n = value.try_cast("double")
    kg = F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.1f", n / 1000), r"0$", ""), r"\.$", ""), F.lit(" kg"))
    out = F.when(kind == "checkbox", F.when(F.lower(value) == "true", "Oui").otherwise(value)).when((kind == "date") & value.rlike(r"^\d{4}-\d\d-\d\d$"), F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "dd/MM/yyyy"))
    out = out.when(kind == "sex", F.when(F.upper(value) == "F", "Féminin").when(F.upper(value) == "M", "Masculin").otherwise(value))
    if heavy_in_kg:
        out = out.when((kind == "weight") & (n >= 10_000), F.replace(kg, F.lit("."), F.lit(",")))
    for k, unit in UNITS.items():
        out = out.when(kind == k, F.concat_ws(" ", value, F.lit(unit)))
    missing = F.when(status == "NEEDS_REVIEW", "?").otherwise("—")
    return F.when(status == "UNKNOWN", "Inconnu").when(status == "ILLEGIBLE", "illisible").when(status.isin("NOT_PROVIDED", "NOT_APPLICABLE") | value.isNull(), missing).otherwise(out.otherwise(value))


def typed(kind: Column, text: Column) -> Column:
    """struct<value, status>: a correction by kind; status null where the answer doesn't fit."""
    raw = F.trim(text)
    low = F.lower(raw)
    made = lambda v, s: F.struct(v.cast("string").alias("value"), (F.lit(s) if s is None or isinstance(s, str) else s).cast("string").alias("status"))
    none = F.lit(None)
    weight = r"^(\d{1,6}(?:[.,]\d{1,3})?)\s*(kg|g)?$"
    n, unit = F.replace(F.regexp_extract(low, weight, 1), F.lit(","), F.lit(".")).try_cast("double"), F.regexp_extract(low, weight, 2)
    grams = F.rint(F.when((unit == "kg") | ((unit == "") & (n < 300)), n * 1000).otherwise(n)).cast("int")
    whole = F.regexp_extract(low, r"^(\d{1,5})(?:\s*(?:g|cm|sa|semaines?|ans?))?$", 1).try_cast("int")
    date = r"^(\d{1,2})[/.\- ](\d{1,2})[/.\- ](\d{4}|\d{2})$"
    part = lambda i: F.regexp_extract(raw, date, i).try_cast("int")
    day = day_of(F.when(part(3) < 100, part(3) + 2000).otherwise(part(3)), part(2), part(1))
    sex = F.when(low.isin("f", "fille", "féminin"), "F").when(low.isin("m", "garçon", "garcon", "masculin"), "M")
    known = lambda v: made(v, F.when(v.isNotNull(), "KNOWN"))
    return (
        F.when(raw == "", made(none, None)).when(low.isin(TYPED_UNKNOWN), made(none, "UNKNOWN")).when(low.isin(EMPTY_WORDS), made(none, "NOT_PROVIDED"))
        .when(kind == "checkbox", F.when(low.isin(YES_WORDS), made(F.lit("true"), "KNOWN")).when(low.isin(NO_WORDS), made(none, "NOT_PROVIDED")).otherwise(made(none, None)))
        .when(kind == "weight", known(grams)).when(kind.isin("integer", "length", "weeks"), known(whole)).when(kind == "date", known(day)).when(kind == "sex", known(sex))
        .otherwise(known(F.when(F.length(raw) <= 120, raw)))
    )


def relative_time(seconds: Column) -> Column:
    """struct<n, unit>: hours below two days, days below 45, else months of 30 days."""
    hours, days = F.floor(seconds / 3600 + 0.5).cast("int"), F.floor(seconds / 86_400 + 0.5).cast("int")
    made = lambda n, u: F.struct(n.cast("int").alias("n"), F.lit(u).alias("unit"))
    return F.when(hours < 48, made(hours, "hour")).when(days < 45, made(days, "day")).otherwise(made(F.floor(days / 30 + 0.5), "month"))


def nice_ticks(low: Column, high: Column, count: int = 5) -> Column:
    """Axis ticks at 1, 2, 2.5 or 5 times a power of ten that cover the range."""
    raw = F.greatest(high - low, F.lit(1e-9)) / count
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(raw / power <= 1, 1.0).when(raw / power <= 2, 2.0).when(raw / power <= 2.5, 2.5).when(raw / power <= 5, 5.0).otherwise(10.0) * power
    first = F.floor(low / step)
    return F.transform(F.sequence(first.cast("int"), F.ceil(high / step).cast("int")), lambda i: F.round(i * step, 6))


def message_parts(text: Column, most: int = 4096) -> Column:
    """A text in parts of at most ``most`` characters, cut at line breaks; only longer lines are cut within."""
    lines = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(x), F.lit(1)) - 1) / most).cast("int")), lambda i: F.substring(x, i * most + 1, F.lit(most))))))
    start = F.array().cast("array<string>")

    def add(parts, line):
        last = F.get(parts, F.size(parts) - 1)
        joined = F.concat_ws("\n", last, line)
        return F.when((F.size(parts) > 0) & (F.length(joined) <= most), F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(joined))).otherwise(F.concat(parts, F.array(line)))

    return F.aggregate(lines, start, add)


def label_and_rest(text: Column) -> tuple[Column, Column]:
    """A line cut at its first colon; the rest is null without one."""
    rule = r"^([^:]{2,60}?)\s*:\s*(.*)$"
    return F.when(text.rlike(rule), F.regexp_extract(text, rule, 1)).otherwise(text), F.when(text.rlike(rule), F.nullif(F.regexp_extract(text, rule, 2), F.lit("")))


# Messages of the reading steps in French, as patterns, and in English, in the order in which they are tried.
MESSAGES_EN = [
    (r"Lecture du texte \(PaddleOCR\)", "Reading the text (PaddleOCR)"),
    (r"Tableaux, cases à cocher, étiquettes", "Tables, checkboxes, labels"),
    (r"Vérification : est-ce bien une fiche de santé \?", "Checking: is this a health record?"),
    (r"Relecture de (\d+) valeur\(s\) douteuse\(s\) ou non rattachée\(s\) par (.+)", "Second reading of $1 doubtful or unlinked value(s) by $2"),
    (r"Presque aucun texte sur cette image : ce n'est pas une fiche à lire\.", "Almost no text on this image: it is not a record to read."),
    (r"Cette image n'est pas une fiche ou un registre de santé\.", "This image is not a health record or registry."),
    (r"Cette image ne ressemble pas à une fiche de santé \(aucun mot du domaine lu\)\.", "This image does not look like a health record (no health-related words read)."),
    (r"serveur Ollama injoignable \(lancer `ollama serve`\)", "Ollama server unreachable (run `ollama serve`)"),
    (r"modèle (\S+) absent \(lancer `ollama pull \S+`\)", "model $1 missing (run `ollama pull $1`)"),
    (r"PaddleOCR a échoué : ", "PaddleOCR failed: "),
    (r"Image illisible \(formats acceptés : PNG, JPG\)\.", "Unreadable image (accepted formats: PNG, JPG)."),
]


def translated(message: Column, rules: Sequence[tuple[str, str]] = MESSAGES_EN) -> Column:
    """The message with each rule's matches replaced, in their order; texts without a rule stay as they are."""
    return reduce(lambda m, r: F.regexp_replace(m, F.lit(r[0]), F.lit(r[1])), rules, message)
