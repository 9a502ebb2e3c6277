"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities are found by shape: e-mail addresses, secrets (quoted or bare after a
key word, or long hexadecimal strings), telephone numbers (international, with a
leading zero, or 3-3-4 digits), IP addresses (v4, v6), long numbers (cards, accounts,
identity numbers in their usual groups, IBANs) and titled names (a family name has one
surrogate, with or without a given name before it). A surrogate is a function of a secret key,
the type, the entity's canonical form and an attempt number, so an entity gets
the same one in every document and spelling. It keeps the type and the format:
letters stay letters of their case, digits digits, separators in place; numbers
that pass the Luhn check still do, octets stay octets, names keep title, gender
and script.

Collision checks make surrogates distinct: of the entities whose surrogates
meet, or hit a real entity, all but one take the next attempt, until none do; after
IN_FORMAT attempts surrogates grow by a letter or digit (an IP address by a port).
Only entities past attempt 0 are joined back; texts are not shuffled unless
those are too many to broadcast.

Not detected: secrets under eight characters, with spaces, or without a key word
unless they are 32 hexadecimal digits or more; other key words than those of
SECRET_HEAD; national telephone numbers without a leading zero in other groups
than 3-3-4, local ones, and dotted or slashed ones that read as a date; identity
numbers of letters with fewer than nine digits (but eight and a letter are) or
in other groups than GROUPED; IPv6 without a digit or ending in ::; addresses with non-ASCII letters; names
without a title, third and further names; postal addresses and dates of birth.
Shapes are all that is looked at, so a bare word of eight characters after
"password:", and numbers grouped like a telephone's, are replaced too. One number
in national and in international form counts as two entities.

Edge cases: null texts stay null, empty ones empty; text around entities is
untouched; ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import row_key, settled
from .host_rules import let

EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,4}"
# Words that a secret follows.
SECRET_HEAD = r"(?=[AaPpSsTt])(?i:token|secret|password|passwd|api[_-]?key)[\"']?[ \t]*+[=:][ \t]*+"
SECRET = SECRET_HEAD + r"""(?:"[^"\s]{8,}+"|'[^'\s]{8,}+'|[^\s"']\S{7,}(?<![.,;:!?)\]}>"']))|(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"""
IP6 = (
    r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,34}::)(?=[A-Fa-f:]{0,38}\d)(?:[0-9A-Fa-f]{1,4}::?){1,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"
)
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
# What may stand between two digits of a telephone number, and a date, which is none; an IP address ends it.
GAP = r"[ .()/\u00A0\u202F\u2010-\u2013-]"
DATE = r"\(?\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})(?![./-]?\d)"
PHONE = (
    rf"\+\d(?:{GAP}{{0,3}}(?!{IP})\d){{6,22}}(?!\d)|(?<![\d.,+/-])(?=\(?0\d)(?!{DATE})\(?0\d(?:{GAP}{{0,3}}(?!{IP})\d){{7,10}}(?!\d|[.,/-]\d)"
    r"|(?<![\d.,+/-])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|[.,/-]\d)"
)
# Groupings of card and identity numbers.
GROUPED = [r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{3}[ -]\d{2}[ -]\d{4}", r"\d{3}-\d{3}-\d{3}", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"(?:\d{2})?\d{6}-\d{4}", r"[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?"]
IBAN = r"(?<![A-Za-z\d])[A-Z]{2}\d{2}(?=(?:[ A-Z]{0,9}\d){8})(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![A-Za-z\d])"
NUMBER = rf"{IBAN}|(?<![\d.,-])(?:{'|'.join(GROUPED)})(?![\d]|-\d)|(?<![\d.,])\d{{8}}-?[A-HJ-NP-TV-Z](?![A-Za-z\d])|(?<![\d.,])\d{{9,}}+(?![.,]\d)"
# Titles by gender.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Lord", "Don", "Signor", "Senhor", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Lady", "Doña", "Signora", "Senhora", "госпожа"]
NEUTRAL = ["Dr", "Prof"]
TITLES = MALE + FEMALE + NEUTRAL
PERSON = r"(?<![\p{L}])(?:" + "|".join(TITLES) + r")\.? \p{Lu}\p{Ll}[\p{L}'-]{0,30}(?: \p{Lu}\p{Ll}[\p{L}'-]{0,30})?"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IP6, IP, PHONE, NUMBER, PERSON))
#: What a text without a title must hold for any entity to be there: an e-mail address has @, a secret = or : or 32
#: hexadecimal digits, an IPv6 address :, a telephone, IP or long number a digit. It follows from each pattern, whatever its format.
CHEAP = r"[@=:\d]|[A-Fa-f]{32}"
#: So many attempts keep the format; each one beyond adds a letter or digit, so a format whose space is full is no dead end.
IN_FORMAT = 4
# Given names by script and gender, and syllables of family names.
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Marco", "Nico", "Oscar", "Paul", "Robin", "Simon", "Victor"],
    ("latin", "f"): ["Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Sofia"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Тимур"],
    ("cyrillic", "f"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "София"],
}
SYLLABLES = {"latin": ["ba", "der", "fo", "gan", "hel", "ka", "lin", "mor", "na", "pel", "ron", "sa", "ter", "val", "wen", "zu"], "cyrillic": ["ба", "вер", "го", "дан", "зел", "ка", "лин", "мор", "на", "пел", "рон", "са", "тер", "вал", "шен", "зу"]}
TYPES = ["email", "secret", "phone", "ip", "number", "person"]


def kind_of(e: Column) -> Column:
    return (
        F.when(e.rlike(f"^(?:{SECRET})$"), "secret").when(e.contains("@"), "email").when(e.rlike(r"^(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:]*)$"), "ip")
        .when(e.rlike(f"^(?:{PHONE})$"), "phone").when(e.rlike(r"\d"), "number").otherwise("person")
    )


def secret_parts(e: Column) -> tuple[Column, Column, Column]:
    """What stands before a secret's value, the value, and the quote after it."""
    head = F.regexp_extract(e, f"^{SECRET_HEAD}[\"']?", 0)
    tail = F.regexp_extract(e, "[\"']$", 0)
    return head, F.substring(e, F.length(head) + 1, F.length(e) - F.length(head) - F.length(tail)), tail


def title_of(e: Column) -> Column:
    return F.regexp_extract(e, r"^\p{L}+\.? ", 0)


def canonical(kind: Column, e: Column) -> Column:
    """What makes two spellings the same entity."""
    return (
        F.when(kind == "email", F.lower(e)).when(kind == "secret", F.lower(secret_parts(e)[1]))
        .when(kind.isin("phone", "number"), F.regexp_replace(e, r"\D", "")).when(kind == "ip", F.lower(e)).otherwise(F.concat(gender(e), F.lit(":"), F.regexp_replace(e, r"^\p{L}+\.? ", "")))
    )


def gender(e: Column) -> Column:
    title = F.regexp_replace(title_of(e), r"\.? $", "")
    return F.when(title.isin(MALE), "m").when(title.isin(NEUTRAL), "n").otherwise("f")


def stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """256 hexadecimal digits."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{k}")), 256) for k in range(4)])


def draw(hexes: Column, i: Column, n: int) -> Column:
    """A number below n out of the i-th (from 0) pair of digits, wrapping round."""
    return F.pmod(F.conv(F.substring(hexes, F.pmod(i, F.lit(125)) * 2 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(n))


def luhn_sum(digits: Column) -> Column:
    """Of an array of digits, the last being the check digit."""
    return F.aggregate(F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))), F.lit(0), lambda a, b: a + b)


def digit_array(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def same_format(e: Column, hexes: Column, hexadecimal: bool) -> Column:
    """e with its letters and digits drawn anew by their index; case and all else stay."""
    low, high = ("0123456789abcdef", "0123456789ABCDEF") if hexadecimal else ("", "")
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), draw(hexes, i, len(alphabet)) + 1, F.lit(1))
    az = "abcdefghijklmnopqrstuvwxyz"

    def one(c, i):
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), pick(low, i)).when(c.rlike("[A-F]"), pick(high, i)).when(c.rlike("[a-z]"), pick(az, i)).when(c.rlike("[A-Z]"), pick(az.upper(), i)).otherwise(c)
        return F.when(c.rlike("[0-9]"), pick("0123456789", i)).when(c.rlike("[a-z]"), pick(az, i)).when(c.rlike("[A-Z]"), pick(az.upper(), i)).otherwise(c)

    return F.array_join(F.transform(F.split(e, ""), one), "")


def new_digits(canon: Column, hexes: Column, keep: int, luhn: bool, more: Column) -> Column:
    """As many digits as canon has and ``more``: the first ``keep`` stay; a number that passes the Luhn check still does."""
    n = F.length(canon) + more
    fresh = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i <= keep, F.substring(canon, i, F.lit(1)).cast("int")).otherwise(draw(hexes, i, 10)))
    if not luhn:
        return fresh
    fixed = let(fresh, lambda d: let(F.concat(F.slice(d, F.lit(1), F.size(d) - 1), F.array(F.lit(0))), lambda z: F.concat(F.slice(z, F.lit(1), F.size(z) - 1), F.array(F.pmod(10 - luhn_sum(z) % 10, F.lit(10)).cast("int")))))
    return F.when(luhn_sum(digit_array(canon)) % 10 == 0, fixed).otherwise(fresh)


def into_format(e: Column, digits: Column) -> Column:
    """The digits of e replaced one after the other."""
    marks = F.split(F.regexp_replace(e, r"\d", "\x00"), "\x00", -1)
    return F.array_join(F.zip_with(marks, F.transform(digits, lambda d: d.cast("string")), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def person(key: str, e: Column, hexes: Column, attempt: Column) -> Column:
    """Title, given and family name. A family name's surrogate hangs on that name alone, so "Mr. John Smith" and "Mr. Smith" keep theirs in common.

    A further attempt changes the given name; the family name only where it stands alone.
    """
    name = F.regexp_replace(e, r"^\p{L}+\.? ", "")
    family, full = F.substring_index(name, " ", -1), name.contains(" ")
    cyrillic = name.rlike(r"\p{IsCyrillic}")
    tries = F.when(full, 0).otherwise(attempt)
    by_family = F.sha2(F.concat_ws("|", F.lit(key), F.lit("family"), family, F.when(tries > 0, tries.cast("string"))), 256)

    def choose(script):
        spelled = lambda h, n: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(F.array(*map(F.lit, SYLLABLES[script])), draw(h, i, 16))), ""))
        usual = lambda g: F.get(F.array(*map(F.lit, GIVEN[script, g])), draw(hexes, F.lit(0), 16))
        by_gender = F.when(gender(e) == "m", usual("m")).when(gender(e) == "f", usual("f")).otherwise(F.when(draw(hexes, F.lit(5), 2) == 0, usual("m")).otherwise(usual("f")))
        given = F.when(attempt == 0, by_gender).otherwise(spelled(hexes, F.lit(2) + attempt))
        last = spelled(by_family, F.lit(5) + tries)
        return F.when(full, F.concat_ws(" ", given, last)).otherwise(last)

    return F.concat(title_of(e), F.when(cyrillic, choose("cyrillic")).otherwise(choose("latin")))


def surrogate(key: str, kind: Column, canon: Column, e: Column, attempt: Column) -> Column:
    """The replacement of e, in e's own format for the first IN_FORMAT attempts."""
    more = F.greatest(attempt - F.lit(IN_FORMAT - 1), F.lit(0))
    longer = lambda x: F.concat(x, F.repeat(F.substring(x, 1, 1), more))

    def made(h):
        local = F.substring_index(e, "@", 1)
        domain = F.substring_index(e, "@", -1)
        host = F.substring_index(domain, ".", 1)
        head, inner, tail = secret_parts(e)
        octet = lambda k, n: (draw(h, F.lit(k), n) + 1).cast("string")
        port = F.when(more > 0, F.concat(F.lit(":"), (draw(h, F.lit(20), 60_000) + more).cast("string"))).otherwise("")
        return (
            F.when(kind == "email", F.concat(same_format(longer(local), h, False), F.lit("@"), same_format(host, F.reverse(h), False), F.substring(domain, F.length(host) + 1, F.length(domain))))
            .when(kind == "secret", F.concat(head, same_format(longer(inner), h, True), tail))
            .when(kind == "phone", into_format(e, new_digits(canon, h, 1, False, more)))
            .when((kind == "ip") & e.contains(":"), same_format(longer(e), h, True))
            .when(kind == "ip", F.concat(F.concat_ws(".", octet(0, 222), octet(3, 254), octet(6, 254), octet(9, 254)), port))
            .when(kind == "number", into_format(e, new_digits(canon, h, 1, True, more)))
            .otherwise(person(key, e, h, attempt))
        )

    return let(stream(key, kind, canon, attempt), made)


def may_hold(text: Column) -> Column:
    """Whether an entity may be in the text: follows from each pattern."""
    found = text.rlike(CHEAP)
    for title in TITLES:
        found = found | text.contains(f"{title}. ") | text.contains(f"{title} ")
    return F.coalesce(found, F.lit(False))


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), 0)


def attempts(found: DataFrame, key: str, most: int = 50) -> DataFrame:
    """kind, canon, attempt of the entities whose surrogate of attempt 0 would not be distinct. found: kind, canon, e."""
    known = settled(found.groupBy("kind", "canon").agg(F.min("e").alias("e")))
    real = known.select("kind", F.col("canon").alias("new"))
    taken = pending = None
    bumped = None
    for k in range(most):
        tried = (known if pending is None else pending).withColumn("new", canonical(F.col("kind"), surrogate(key, F.col("kind"), F.col("canon"), F.col("e"), F.lit(k))))
        free = tried.join(real, ["kind", "new"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "new"], "left_anti")
        good = free.groupBy("kind", "new").agg(F.min("canon").alias("canon"))
        good, pending_next = settled(good), None
        pending_next = settled((known if pending is None else pending).join(good, ["kind", "canon"], "left_anti"))
        taken = good.select("kind", "new") if taken is None else taken.union(good.select("kind", "new"))
        if k:
            mine = good.select("kind", "canon", F.lit(k).alias("attempt"))
            bumped = mine if bumped is None else bumped.union(mine)
        pending = pending_next
        if pending.isEmpty():
            break
    else:
        raise ValueError(f"surrogates still collide after {most} attempts")
    return bumped if bumped is not None else known.select("kind", "canon", F.lit(0).alias("attempt")).limit(0)


def replace(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """The documents' own columns with surrogates in the text, and __found: each entity's type."""
    some = docs.where(may_hold(F.col("text"))).select(row_key().alias("key"), F.explode(entities(F.col("text"))).alias("e"))
    typed = some.select("key", "e", kind_of(F.col("e")).alias("kind")).withColumn("canon", canonical(F.col("kind"), F.col("e")))
    typed = settled(typed)
    bumped = attempts(typed, key)
    by_row = typed.join(bumped, ["kind", "canon"]).groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("__bumped"))
    joined = docs.withColumn("__key", row_key()).join(by_row.withColumnRenamed("key", "__key"), "__key", "left")
    # texts without any entity are left alone, without a look at each place
    holds = may_hold(F.col("text"))
    listed = joined.withColumn("__found", F.when(holds, entities(F.col("text"))).otherwise(F.array().cast("array<string>")))

    def one(e):
        kind = kind_of(e)
        return let(kind, lambda k: let(canonical(k, e), lambda c: surrogate(key, k, c, e, F.coalesce(F.try_element_at(F.col("__bumped"), F.concat_ws("|", k, c)), F.lit(0)))))

    new = F.array_join(F.zip_with(F.split("text", ANY, -1), F.transform("__found", one), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size("__found") > 0, new).otherwise(F.col("text")).alias("text")
    return listed.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.transform("__found", kind_of).alias("__found"))


def report(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities and how many of each type."""
    done = replace(docs.select("doc_id", "text"), key)
    count = lambda t: F.size(F.filter("__found", lambda x: x == t)).cast("bigint").alias(f"n_{t}")
    return done.select("doc_id", "text", F.size("__found").cast("bigint").alias("n_entities"), *map(count, TYPES))


def clean(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """The documents' own columns, text replaced, n_chars (if there) following it."""
    done = replace(docs, key).drop("__found")
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else done
