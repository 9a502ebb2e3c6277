import numbers
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import block_dedup, components, decontaminate, host_rules, lang_ppm, license_digest, mixing, ngram_join, pii_surrogate, quality_rank, sieve, suffix_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, t1 string, rate double"


def corpus():
    """Nulls, empty and long texts, ties, exact and near copies, shared passages, several scripts."""
    r = random.Random(5)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "né", "ü", "то", "B", "") for b in ("ra", "s,", "tu", "x", "ß9", ".")]
    text = lambda n: " ".join(r.choice(vocabulary) or "o" for _ in range(n))
    passage, long_text = text(60), text(3000)
    docs = [text(r.randint(1, 90)) for _ in range(25)]
    docs += [None, None, "", "   ", "\n\t", "one", "one", "One two", "one two three", "x" * 900, "x" * 900 + "y", "ab" * 600]
    docs += [docs[3], docs[3], docs[4] + " more", docs[5].upper(), long_text, long_text + " tail", text(20) + "\n" + passage + "\n" + text(20), passage, text(7) + " " + passage]
    docs += [long_text[:4000] + text(30) + long_text[4000:], text(50) + " " + long_text[500:1500], passage.replace(" ", " "), "a a a a a a " * 30]
    for k in range(12):  # near copies of one text
        w = docs[20].split() + passage.split()
        w[k] = "changed"
        docs.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(docs)] + [(3, docs[3]), (None, docs[3]), (None, None), (None, passage)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None, None, 7, "clash", 0.5) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_block_dedup(docs):
    for window in (35, 6):
        assert ordered(block_dedup.report(docs, window).collect()) == ordered(brute.blocks(corpus(), window))
    assert block_dedup.report(docs.limit(0)).count() == 0


def test_suffix_dedup(docs):
    assert ordered(suffix_dedup.report(docs).collect()) == ordered(brute.suffixes(corpus(), 400))
    assert suffix_dedup.report(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeats(docs, window=100)


def test_suffix_dedup_goes_by_bytes_not_words(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    own = [" ".join(word() for _ in range(100)) for _ in range(4)]
    shared = " ".join(word() for _ in range(80))
    short, long = shared[:399], shared[:400]  # over 60 words; the edges differ, so that no byte beyond them repeats
    texts = [own[0] + "|" + short + "<", own[1] + "~" + short + ">", own[2] + "|" + long[::-1] + "<", own[3] + "~" + long[::-1] + ">"]
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in suffix_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (400, 1), 3: (400, 1)}


def test_ngram_join(docs):
    got = ngram_join.join(docs)
    assert ordered(got.collect()) == ordered(brute.joined(corpus(), 4, 85))
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_one_id_is_one_node(spark):
    """Ids that come with several texts tie together what those texts link with; rows without an id link too."""
    w = [f"w{i}" for i in range(30)]
    v = [f"v{i}" for i in range(30)]
    rows = [(2, w), (5, [*w, "x"]), (5, v), (9, [*v, "y"]), (7, v), (11, ["z"] * 9), (11, ["q"] * 3), (12, ["q"] * 3), (None, [*v, "u"]), (None, ["n", "o"]), (20, []), (5, [])]
    rows = [(i, " ".join(t)) for i, t in rows]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(brute.joined(rows, 4, 85))
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 5, 7, 9) and r["n_shingles"]} == {2}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_of_short_texts(spark, n, percent):
    """Sets of 1 to 40 shingles, many of them strangers that hold one common passage."""
    r = random.Random(n)
    common = [f"c{i}" for i in range(12)]
    docs = []
    for k in range(150):
        w = [f"d{k}x{i}" for i in range(r.randint(4, 30))] + (common if k % 2 else [])
        for _ in range(3):
            docs.append((len(docs), " ".join(w)))
            w = list(w)
            match r.randint(0, 3):
                case 0:
                    w.append(f"e{len(docs)}")
                case 1:
                    w[r.choice([0, -1])] = f"f{len(docs)}"
                case 2:
                    w.pop(r.choice([0, -1]))
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), n, percent).collect()
    assert ordered(got) == ordered(brute.joined(docs, n, percent))


def test_strangers_share_no_group(spark):
    """100,000 short unrelated texts, half of them with one passage: groups stay small."""
    docs = spark.range(100_000).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(8) + F.col("id") % 12), lambda i: F.concat(F.hex(F.xxhash64("id", i)))), F.when(F.col("id") % 2 == 0, " ".join(f"c{i}" for i in range(9)))).alias("text"),
    )
    every = docs.select("doc_id", *ngram_join.rp.text_keys(), "text").mapInArrow(ngram_join.described(4), ngram_join.META.format(kind="bigint")).persist()
    common = ngram_join.common_shingles(every)
    assert len(common[0]) == 6  # those of the passage alone
    groups = ngram_join.together(ngram_join.candidates(docs, 4, 85, common), every.where("n >= 0"), 85).groupBy("root").count()
    assert (groups.agg(F.max("count")).first()[0] or 0) <= 100


def test_ngram_join_in_blocks(spark, monkeypatch):
    """Groups larger than a block meet block by block; links are counted once."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for k in range(70):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"n{k}"
        docs.append((k, " ".join(w[: 60 - k % 7])))
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert ordered(ngram_join.join(frame).collect()) == ordered(brute.joined(docs, 4, 85))
    monkeypatch.setattr(ngram_join, "LISTED", 5)
    monkeypatch.setattr(ngram_join, "HOT", 3)
    assert ordered(ngram_join.join(frame).collect()) == ordered(brute.joined(docs, 4, 85))
    monkeypatch.setattr(ngram_join, "HOT", 10**6)
    for percent in (80, 93):
        assert {r["doc_id"] for r in ngram_join.one_of_each(frame, 4, percent).collect()} == {c for _, _, c, _ in brute.joined(docs, 4, percent)}


def test_one_of_each(spark, docs):
    left = ngram_join.one_of_each(docs, 5, 80)
    assert left.columns == docs.columns
    want = [c for _, n, c, _ in set(brute.joined(corpus(), 5, 80)) if n]
    blank = [(d, n) for d, n, _, _ in brute.joined(corpus(), 5, 80) if not n]
    got = [r["doc_id"] for r in left.collect()]
    assert len(got) == len(set(want)) + len(blank) and set(got) == set(want) | {d for d, _ in blank}
    rows = [(1, "a b c d e f g h")] * 3 + [(1, "other words")] * 2 + [(None, "a b c d e f g h"), (None, "none of these"), (None, "none of these"), (4, "")]
    left = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered((r["doc_id"],) for r in left) == [(1,), (4,), (None,)]


def test_sieve(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k")).persist()
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("key"))
    table = sieve.table_of(keys)
    inside = {r["id"] for r in sieve.sifted(rows, "key", table).collect()}
    outside = {r["id"] for r in sieve.sifted(rows, "key", table, inside=False).collect()}
    assert inside >= set(range(0, 3000, 3)) and not inside & outside and len(inside | outside) == 3000 and len(outside) > 1700
    assert sieve.sifted(rows, "key", sieve.table_of(keys.limit(0))).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (100, 102), (102, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(edges.limit(0)).count() == 0


ITEMS = [(1, "Ka RA lo s tu, x mi ra ka tu x lo"), (2, "one two"), (3, None), (4, ""), (None, "o o o"), (5, "one, TWO!"), (22, "unfound words here")]


def test_decontaminate(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    planted = [(500, "x ka ra LO s tu x MI ra ka tu x"), (501, "was one-two there"), (502, "café one two, one two")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    want = brute.contaminated(corpus() + planted, [i for i in ITEMS if i[0] is not None], 10)
    known = [i for i in ITEMS if i[0] is not None]
    got = decontaminate.report(more, spark.createDataFrame(known, "item_id long, text string"))
    assert ordered(got.collect()) == ordered(want)
    # the same from several small broadcasts, one after the other
    many = decontaminate.scan(more, spark.createDataFrame(known, "item_id long, text string"), slice_bytes=12)
    whole = decontaminate.scan(more, spark.createDataFrame(known, "item_id long, text string"))
    pick = lambda d: sorted((repr(r["doc_id"]), sorted({(h["begin"], h["end"]) for h in r["hits"]}), r["items"]) for r in d.collect())
    assert pick(many) == pick(whole)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.where("text like '%one two%'").count() == 0
    cut = decontaminate.clean(spark.createDataFrame(planted, "doc_id long, text string"), spark.createDataFrame(known, "item_id long, text string"), mode="span")
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[501] == "was  there"
    with pytest.raises(ValueError):
        decontaminate.clean(docs, items, mode="all")


def against_sql(query, got, **tables):
    c = duckdb.connect()
    for name, rows in tables.items():
        c.register(name, rows)
    want = c.sql(query).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def one(x):
        if pd.isna(x):
            return "-"
        return repr(round(float(x), 6)) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    key = lambda d: sorted(tuple(map(one, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_host_rules(spark, docs):
    rows = corpus() + [(600 + k, "a b c " * 30 if k % 2 else " ".join(f"w{i}" for i in range(80)) + " # $ *") for k in range(12)]
    rows = [(i, t, None if k % 9 == 0 else f"s{k % 4}") for k, (i, t) in enumerate(rows)]
    data = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    data["doc_id"] = data["doc_id"].astype("Int64")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    against_sql(host_rules.ORACLE, host_rules.judge(df), documents=data)
    kept = {r["doc_id"] for r in host_rules.judge(df).where("kept").collect()}
    left = host_rules.keep(df.withColumn("host", F.lit(1)))
    assert {r["doc_id"] for r in left.collect()} == kept and left.columns == ["doc_id", "text", "source", "host"]
    strict = host_rules.judge(df, max_rate=0.5).where("not base_failed and not kept").count()
    assert strict > 0  # a host goes as a whole
    assert host_rules.judge(df.limit(0)).count() == 0


def test_licenses(spark, docs):
    mit = license_digest.KNOWN[0][1]
    rows = corpus() + [(700, "Copyright (c) 2020 Someone\n" + mit.upper().replace("LICENSE", "LICENCE")), (701, "text\nReleased under the MIT license!\nLicensed under the Apache License, Version 2.0.\n"), (702, mit + " more"), (703, "Copyright 2001 by X")]
    data = pd.DataFrame(rows, columns=["doc_id", "text"])
    data["doc_id"] = data["doc_id"].astype("Int64")
    got = license_digest.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    against_sql(license_digest.ORACLE, got, documents=data)
    by = {r["doc_id"]: r for r in got.where("doc_id >= 700").collect()}
    assert (by[700]["license_id"], by[701]["license_id"], by[702]["license_id"], by[703]["digest"]) == ("MIT", None, None, None)
    assert by[701]["notices"] == "Apache-2.0,MIT"
    assert license_digest.scan(docs.limit(0)).count() == 0


def test_every_license(spark):
    """A document for each licence with a full text, and notices in other words."""
    whole = {r["license_id"]: r["text"] for r in license_digest.known_licenses(spark).where("length(text) > 400").collect()}
    assert {"MIT", "ISC", "0BSD", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"} <= set(whole)
    notices = {"Licensed under the MIT license, see LICENSE": "MIT", "Copyright (c) 2020 X. Licensed under the MIT License.": "MIT", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "Distributed under the BSD 3-Clause License": "BSD-3-Clause", "no license": ""}
    rows = [(f"Copyright (c) 2020 Someone\n\n{t}\n",) for t in whole.values()] + [(t,) for t in notices]
    got = {r["doc_id"]: r for r in license_digest.scan(spark.createDataFrame([(k, *t) for k, t in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [got[k]["license_id"] for k in range(len(whole))] == list(whole)
    assert [got[len(whole) + k]["notices"] for k in range(len(notices))] == list(notices.values())


PII = [
    (1, 'To Anna.Bell@Mail3.example.com, ANNA.BELL@MAIL3.EXAMPLE.COM: +1 (830) 555-5433 or +1-830-555-5433, 10.2.3.4, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 4539 1488 0343 6467'),
    (2, "Frau Müller met Mr. John Smith and Mrs. Smith; господин Иванов. Mr. John Smith, 4539148803436467"),
    (3, None), (4, ""), (None, "a@b.co"), (5, "12:30 3.14 version 1.2.3.4.5 none 1234"),
]


def test_surrogates(spark):
    df = spark.createDataFrame(PII, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit("clash"))
    got = {r["doc_id"]: r["text"] for r in pii_surrogate.clean(df).collect()}
    one, two = got[1], got[2]
    for secret in ("anna", "555-5433", "10.2.3.4", "24be64", "4539 1488", "Müller", "Smith", "Иванов"):
        assert secret.lower() not in (one + two).lower()
    mails = [w.strip(",:") for w in one.split() if "@" in w]
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper() and mails[0].endswith(".example.com")
    card = one.split(", ")[-1]
    digits = [int(c) for c in card if c.isdigit()]
    assert len(digits) == 16 and card.count(" ") == 3 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    assert two.endswith(card.replace(" ", ""))  # one number in two formats
    names = [w for w in two.split("Mr. ")[1:]]
    assert names[0].split(" and")[0] == names[1].split(",")[0]
    assert got[3] is None and got[4] == "" and got[5] == PII[5][1]
    again = {r["doc_id"]: r["text"] for r in pii_surrogate.clean(df, "another key").collect()}
    assert again[1] != one
    empty = pii_surrogate.report(df.limit(0))
    assert empty.count() == 0 and empty.columns[:3] == ["doc_id", "text", "n_entities"]


def test_surrogates_stay_distinct(spark):
    """Short numbers collide; no two get the same surrogate, none a real one."""
    df = spark.createDataFrame([(k, f"ip 10.0.{k // 250}.{k % 250}. and Mr. A{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x") for k in range(1300)], "doc_id long, text string")
    rows = pii_surrogate.report(df).collect()
    ips = {r["text"].split()[1] for r in rows}
    names = {r["text"].split("Mr. ")[1] for r in rows}
    assert len(ips) == 1300 and len(names) == 676


def test_full_formats(spark):
    """All 676 addresses of one format, and all of 26 tokens of one: surrogates grow and stay distinct, none is a real one."""
    abc = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.co" for a in abc for b in abc]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(mails)] + [(1000, mails[5].upper())], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii_surrogate.report(df).collect()}
    new = [got[k] for k in range(676)]
    assert len(set(new)) == 676 and not set(new) & set(mails) and all(m.endswith(".co") and "@" in m for m in new)
    assert got[1000].lower() == got[5]


def test_family_names_stay_together(spark):
    rows = [(1, "Mr. John Smith and Mr. Smith, Mrs. Smith, Dr. Smith; Dr Peter Smith, Mr. Jones. господин Иван Петров, господин Петров")]
    text = pii_surrogate.report(spark.createDataFrame(rows, "doc_id long, text string")).first()["text"]
    last = [x.split()[-1].strip(".,;") for x in text.replace(" and ", ", ").replace(";", ",").replace(". господин", ", господин").split(", ")]
    assert len(set(last[:5])) == 1 and last[5] != last[0] and last[6] == last[7] and not {"Smith", "Jones", "Петров"} & set(last)


# The shortest and the space-grouped forms of each pattern, by type; nothing else in them passes the pre-filter.
FORMS = [
    ("email", "a@b.c"), ("email", "to.x_y@mail-1.example.org"), ("phone", "+49 30 123 45 67"), ("phone", "+221 77 123 45 67"), ("phone", "+1 22 33 44"), ("phone", "+1223344"), ("phone", "+1 (830) 555-5433"),
    ("ip", "1.2.3.4"), ("number", "123456789"), ("number", "4539 1488 0343 6467"), ("number", "4539-1488-0343-6467"), ("secret", 'token="abcdefgh"'), ("secret", 'api_key : "abcdefgh"'), ("secret", "abcdefab" * 4), ("secret", "A1" * 16),
    *[("person", f"{t} Ab") for t in pii_surrogate.TITLES], ("ip", "fe80::1"), ("ip", "2001:0db8:0000:0000:0000:ff00:0042:8329"), ("person", "Mr. John Smith"),
]


def test_prefilter_misses_no_form(spark):
    """Each form is replaced in a text of its own, and by the same surrogate as in one with a colon and a year."""
    rows = [(2 * k + j, f"so {e} now{more}") for k, (_, e) in enumerate(FORMS) for j, more in enumerate(("", " at 12:30 in 2020"))]
    got = {r["doc_id"]: r for r in pii_surrogate.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (kind, e) in enumerate(FORMS):
        alone, longer = got[2 * k], got[2 * k + 1]
        assert (e, alone["n_entities"], alone[f"n_{kind}"]) == (e, 1, 1)
        assert e not in alone["text"] and longer["text"] == alone["text"] + " at 12:30 in 2020"


# Of no table at hand: by type, with what must not be left of them.
OTHERS = [
    ("secret", 'token = "' + "eyJhbGciOi.J9x-" * 20 + '"', "eyJhbGciOi"), ("secret", "0123456789abcdef" * 9, "0123456789abcdef"), ("secret", "token = 's1ngle-qu0ted'", "s1ngle"), ("secret", "password: c0rrecth0rse!x", "c0rrecth0rse"),
    ("secret", '"api_key": "q8w7e6r5t4"', "q8w7e6r5t4"), ("secret", "password=p@ssw0rd99.example", "p@ssw0rd99"), ("phone", "+33 6 12 34 56 78", "12 34 56 78"), ("phone", "+33 (0)6 12 34 56 78", "12 34 56 78"), ("phone", "06 12 34 56 78", "12 34 56 78"),
    ("phone", "06.12.34.56.78", "12.34.56.78"), ("phone", "(555) 123-4567", "123-4567"), ("phone", "555-123-4567", "123-4567"), ("phone", "1-555-123-4567", "123-4567"), ("phone", "(030) 1234567", "1234567"), ("number", "123-45-6789", "45-6789"),
    ("number", "123.456.789-09", "456.789"), ("number", "850709-9805", "0709-9805"), ("number", "12345678Z", "2345678"), ("number", "DE89 3704 0044 0532 0130 00", "3704 0044 0532"), ("number", "12345678901234567890123", "345678901234567890123"), ("number", "3782 822463 10005", "822463"),
]
PLAIN = "On 01.02.2020 12:30, 05/11/2021 10:00, 2020-01-02 and 1990 2000 2010 it cost 1,234,567,890.12 or 0.123456789; 3.14159265358979 in 1.2.3.4.5; the token: a 12-34 match, 100 200 300."


def test_surrogates_of_other_formats(spark):
    """Secrets without bounds and quotes, national telephone and identity numbers; dates and amounts stay."""
    rows = [(k, f"see {e} there") for k, (_, e, _) in enumerate(OTHERS)] + [(900, PLAIN), (901, "+1 (826) 555-4081 190.137.223.204")]
    got = {r["doc_id"]: r for r in pii_surrogate.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (kind, e, part) in enumerate(OTHERS):
        assert (e, got[k]["n_entities"], got[k][f"n_{kind}"], part in got[k]["text"]) == (e, 1, 1, False)
        assert got[k]["text"].startswith("see ") and got[k]["text"].endswith(" there") and len(got[k]["text"]) == len(rows[k][1])
    assert got[900]["text"] == PLAIN
    assert (got[901]["n_phone"], got[901]["n_ip"]) == (1, 1) and "137.223" not in got[901]["text"]


def test_one_secret_in_any_quotes(spark):
    value = "Q8w7e6r5t4y3"
    rows = [(1, f'token="{value}"'), (2, f"token='{value}'"), (3, f"token={value}"), (4, f"token: {value}.")]
    got = {r["doc_id"]: r["text"] for r in pii_surrogate.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    new = got[3].removeprefix("token=")
    assert new != value and got == {1: f'token="{new}"', 2: f"token='{new}'", 3: f"token={new}", 4: f"token: {new}."}


def test_quality(spark):
    r = random.Random(2)
    clean = lambda: " ".join(r.choice(["the", "house", "of", "river", "and", "old", "green"]) for _ in range(80)) + "."
    junk = lambda: " ".join(r.choice(["A***", "B%%%", "###", "!!", "ZZZ"]) for _ in range(80))
    rows = [(i, clean() if i % 4 else junk()) for i in range(400)] + [(1000, None), (1001, ""), (None, clean())]
    labels = [(i, int(i % 4 > 0), 0) for i in range(400)] + [(5, 7, 0), (None, 1, 0), (9999, 1, 0), (8, None, 0)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality_rank.classify(df, lab).collect()}
    assert all(got[i]["predicted"] == int(i % 4 > 0) for i in range(400))
    assert 0 < got[1001]["score"] < 1 and got[1000]["score"] == got[1001]["score"]
    assert sum(got[i]["held_out"] for i in range(400)) > 50
    none = quality_rank.classify(df, lab.where("quality = 1")).collect()
    assert {x["score"] for x in none} == {0.5}
    assert quality_rank.classify(df.limit(0), lab).count() == 0


def test_quality_over_all_pairs(spark):
    """The weights are a minimum of the loss over every pair, the threshold a quantile of every labelled row."""
    import numpy as np

    r = random.Random(4)
    text = lambda k: " ".join(r.choice(["the", "old", "River", "a!", "B%%", "zz"][k : k + 5]) for _ in range(r.randint(3, 30)))
    rows = [(i, text(r.random() < 0.35 + 0.3 * (i % 3 > 0))) for i in range(600)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(7, 1), (7, 1)], "doc_id long, quality int")
    train = quality_rank.labelled(df, lab)
    assert train.count() == lab.where(~quality_rank.held_out()).count()
    weights, shift = quality_rank.fit(train)
    got = train.toPandas()
    x, y = np.array([np.frombuffer(v, np.float32) for v in got["x"]]).astype(float), got["quality"].to_numpy()
    raw, scale = x @ weights, x.std(0) + 1e-3
    z = (x - x.mean(0)) / scale
    p = 1 / (1 + np.exp(raw[y == 1][:, None] - raw[y == 0][None, :]))
    grad = (p.sum(0) @ z[y == 0] - p.sum(1) @ z[y == 1]) / p.size + quality_rank.RIDGE * weights * scale
    assert 0.05 < p.mean() < 0.6 and np.abs(grad).max() < 5e-4
    k, ordered_raw = (y == 0).sum(), np.sort(raw)
    assert abs(np.log(0.7 / 0.3) - shift - ordered_raw[k - 1 : k + 1].mean()) < 1e-9
    values = spark.createDataFrame([(v,) for v in [1.0, 1.0, 5.0, -3.0, 1e9, 1.0, 2.0]], "raw double")
    assert [quality_rank.ranked(values, k) for k in range(1, 8)] == [-3.0, 1.0, 1.0, 1.0, 2.0, 5.0, 1e9]


def peak_mb(run):
    """What numpy and Python hold at most while run goes on; and what it gives."""
    import tracemalloc

    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_memory_of_the_join():
    """A batch of texts, a list of sketches and a full block stay small in a task, with the same results."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(0)
    text = pa.array([" ".join(map(str, r.integers(0, 99999, 300))) for _ in range(1500)])
    shingles = ngram_join.Shingles(5)
    most, names = peak_mb(lambda: [ngram_join.set_keys(x) for _, x in shingles.sets(text)])
    assert most < 30 and names == [ngram_join.set_keys(x) for k in range(0, 1500, 100) for _, x in ngram_join.Shingles(5).sets(text[k : k + 100])]
    sets = [np.sort(r.integers(0, 1 << 63, 12000).astype(np.uint64) * np.uint64(2)) for _ in range(80)]
    sketches = [ngram_join.sketch(x) for x in sets]
    many = 20
    size, held = np.full(80 * many, 12000), sketches * many
    most, edges = peak_mb(lambda: ngram_join.alike(np.arange(80 * many), size, held, 80))
    assert most < 22 and {(a % 80, b % 80) for a, b in edges} == {(k, k) for k in range(80)} and len(edges) == 80 * (many - 1)
    half = [np.unique(np.r_[x[:6000], sets[0][6000:]]) for x in sets]
    most, own = peak_mb(lambda: ngram_join.overlaps(half, half))
    assert most < 60
    assert (own == ngram_join.overlaps(half, list(half))).all() and own[1, 2] == len(np.intersect1d(half[1], half[2]))


def test_sieves_in_one_step(spark):
    keys = lambda lo, hi: sieve.table_of(spark.range(lo, hi).select(F.xxhash64("id").alias("k")))
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("k"))
    got = sieve.sifted(rows, "k", keys(0, 2000), keys(1500, 3000))
    assert {x["id"] for x in got.collect()} >= set(range(1500, 2000)) and got.count() < 700
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_language(spark):
    r = random.Random(3)
    say = {"en": ["the", "house", "which", "was", "there"], "de": ["das", "schöne", "haus", "über", "nicht"], "fr": ["la", "maison", "était", "qui", "où"]}
    rows = [(i, " ".join(r.choice(say[k]) for _ in range(40)), k) for i, k in enumerate(list(say) * 60)] + [(900, None, "en"), (901, "", None), (902, "123 !!", "en"), (903, "das schöne haus", None), (None, "la maison", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in lang_ppm.identify(df).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:180])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "fr"]
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[900]["score"] == 0
    assert {x["lang_pred"] for x in lang_ppm.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_lengths_by_hand():
    """Frozen statistics of one text: lengths of single bytes add up as written."""
    import numpy as np

    m = lang_ppm.Model({"xx": [b"abababab"]}, least=1)
    raw = np.frombuffer(b"ab", np.uint8)
    # a first: order 0 has a, b four times each, two kinds; b after a: order 1 has b four times, one kind
    want = -np.log2(4 / 10) - np.log2(4 / 5)
    assert abs(m.lengths(raw, np.array([0, 2]))[0, 0] - want) < 1e-5
    # an unseen byte: escape at order 0, then one in 256
    other = np.frombuffer(b"z", np.uint8)
    assert abs(m.lengths(other, np.array([0, 1]))[0, 0] - (np.log2(10 / 2) + 8)) < 1e-5


def by_hand(rows, entropy_share, max_repeat, block_docs, hashes):
    """Weights by plain bisection and draws by plain loops; hashes has what Spark's hash gives for each row, block and source."""
    import math

    count = lambda t: len((t or "").split())
    tokens = {}
    for _, text, source in rows:
        tokens[source or ""] = tokens.get(source or "", 0) + count(text)
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}

    def weights(alpha):
        z = sum(p**alpha for p in share.values())
        return {s: p**alpha / z for s, p in share.items()}

    even = lambda a: -sum(w * math.log(w) for w in weights(a).values()) / math.log(len(share)) >= entropy_share
    fits = lambda a: max(w / share[s] for s, w in weights(a).items()) <= max_repeat
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if even(mid) else (low, mid)
    alpha = 1.0 if even(1.0) else low
    if not fits(alpha):
        low, high = alpha, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
        alpha = high
    out = []
    for s, w in weights(alpha).items():
        mine = [r for r in hashes if r["src"] == s]
        epochs, rest = divmod(round(w * total), tokens[s])
        blocks = {}
        for r in mine:
            out += [(r["doc_id"], s or None, e) for e in range(epochs)]
            blocks.setdefault(r["block"], []).append(r)
        for block in sorted(blocks.values(), key=lambda b: (b[0]["block_order"][epochs], b[0]["block"])):
            if rest <= 0:
                break
            left = rest
            for r in sorted((r for r in block if r["n"]), key=lambda r: r["order"][epochs]):
                left -= r["n"]
                if left < 0:
                    break
                out.append((r["doc_id"], s or None, epochs))
            rest -= sum(r["n"] for r in block)
    return out


def test_mixing_by_hand(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "big" if i % 10 else f"s{i % 30}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for _, _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    held = spark.createDataFrame(list(sizes.items()), "source string, docs long")
    key = mixing.row_key()
    hashes = df.join(held, "source").withColumn("key", key).select(
        "doc_id", F.col("source").alias("src"), F.size(host_rules.words(F.col("text"))).alias("n"), F.pmod(F.xxhash64(F.lit(0), "key"), F.ceil(F.col("docs") / 50)).alias("block"), "key").withColumn(
        "order", F.array(*[F.xxhash64(F.lit(2), F.lit(e).cast("long"), "key") for e in range(9)])).withColumn("block_order", F.array(*[F.xxhash64(F.lit(1), F.lit(e).cast("long"), "src", "block") for e in range(9)])).collect()
    for entropy, repeat in ((0.9, 4.0), (0.97, 1.5), (0.1, 4.0)):
        got = mixing.mix(df, entropy_share=entropy, max_repeat=repeat, block_docs=50).select("doc_id", "source", "epoch").collect()
        assert ordered(got) == ordered(by_hand(rows, entropy, repeat, 50, hashes))


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "big" if i % 10 else f"s{i % 30}") for i in range(3000)] + [(None, "x y", None), (9000, None, "big"), (9001, "", ""), (9002, "z", "s10")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, entropy_share=0.9, block_docs=100)
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("epoch").alias("e"), F.first("weight").alias("w")).collect()}
    total = sum(len((t or "").split()) for _, t, _ in rows)
    for r in by.values():
        assert r["n"] <= r["w"] * total + 1 and r["n"] > r["w"] * total - 12
    w = [r["w"] for r in by.values()]
    assert abs(sum(w) - 1) < 1e-6
    repeats = {s: r["w"] * total for s, r in by.items()}
    assert all(repeats[s] <= 4.01 * n for s, n in ((k, sum(len((t or "").split()) for _, t, x in rows if (x or None) == k)) for k in repeats))
    pairs = got.groupBy("doc_id", "source", "epoch").count().where("count > 1 and doc_id is not null").count()
    assert pairs == 0  # a document is drawn once an epoch
    assert ordered(got.collect()) == ordered(mixing.mix(df.repartition(5), entropy_share=0.9, block_docs=100).collect())
    assert mixing.mix(df.limit(0)).count() == 0
