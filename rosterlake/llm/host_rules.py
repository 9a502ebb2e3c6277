"""Host-level quality rules, in DataFrame functions only.

Base rules judge each document by its words. Their failures are summed by
host (here ``source``); each host's failure rate is shrunk towards the mean of
all hosts by a beta prior fitted to the hosts' rates by moments, so that a host
of a few documents is not condemned by them; a host whose shrunk rate passes
``max_rate`` is rejected, and the verdict is joined back to its documents.

Edge cases: a null text has no words and fails; documents without a source form
one host; with one host, or hosts of one rate, the prior is the weakest allowed;
an empty table gives an empty result; repeated rows count each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import settled

#: A host goes if its shrunk failure rate is above this.
MAX_RATE = 0.8
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    held = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(held == "", F.array().cast("array<string>")).otherwise(F.split(held, SPACES))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: higher-order functions would otherwise repeat it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(w: Column) -> Column:
    """A hash of each 3-word window; none where none can repeat."""
    three = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.array().cast("array<bigint>")).otherwise(three)


def words_in_repeats(w: Column, hashes: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more in w. Equal hashes are held against their words."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(a, b):
        alike = [F.get(w, a["i"] + k) == F.get(w, b["i"] + k) for k in range(3)]
        return F.coalesce((a["h"] == b["h"]) & alike[0] & alike[1] & alike[2], F.lit(False))

    again = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(x, F.get(s, k + 1))), lambda x: x["i"]))
    width = lambda at: F.aggregate(F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda x, y: x + y)
    return let(let(placed, again), width)


def repeated_words(w: Column) -> Column:
    """words_in_repeats; 0 without a closer look where no two windows have one hash."""
    return let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(words_in_repeats(w, h))).cast("bigint")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source, the five counts and base_failed of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("__text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    duplicates = F.when(F.col("__text").contains("\n"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)
    counted = docs.select("doc_id", "source", text.alias("__text"), words(F.col("text")).alias("__words")).select(
        "doc_id", "source", F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("__text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        duplicates.cast("bigint").alias("n_dup_lines"),
        let(F.col("__words"), repeated_words).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def host_verdicts(hosts: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """host, n, failed, rate (shrunk) and host_kept. hosts: host, n, failed."""
    raw = F.col("failed") / F.col("n")
    fitted = F.greatest(F.col("m") * (1 - F.col("m")) / F.nullif("v", F.lit(0.0)) - 1, F.lit(1.0))
    prior = hosts.agg(F.avg(raw).alias("m"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("v")).select("m", F.when(F.col("v") > 0, fitted).otherwise(1.0).alias("strength"))
    shrunk = (F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    # one row for all hosts
    return hosts.join(F.broadcast(prior)).select("host", "n", "failed", shrunk.alias("rate")).withColumn("host_kept", F.col("rate") <= max_rate)


def judge(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, host_rate and kept.

    Verdicts are broadcast while they are few; beyond that a hot host's rows are split by AQE's skew join.
    """
    judged = settled(base_rules(docs))
    hosts = judged.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    hosts = settled(host_verdicts(hosts, max_rate).select("host", F.round("rate", 9).alias("host_rate"), "host_kept"))
    return judged.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def keep(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The documents that pass the base rules and whose host does, with their own columns.

    Each text is judged once: what passes is written, and a host's failures are its rows less those.
    """
    good = settled(docs.where(~_failed(F.col("text"))))
    rows = docs.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n"))
    passed = good.groupBy(F.col("source").alias("__host")).agg(F.count("*").alias("passed"))
    hosts = rows.join(passed, F.col("host").eqNullSafe(F.col("__host")), "left").select("host", "n", (F.col("n") - F.coalesce("passed", F.lit(0))).alias("failed"))
    # written, so that their size is known when the join is planned: texts are shuffled only where they are too many to broadcast
    bad = settled(host_verdicts(hosts, max_rate).where(~F.col("host_kept")).select(F.col("host").alias("__host")))
    return good.join(bad, F.col("source").eqNullSafe(F.col("__host")), "left_anti")


def _failed(text: Column) -> Column:
    """base_failed as one expression on the text.

    d windows that are no first ones make 2 * d repeated windows and 6 * d words at most: a closer look only beyond that.
    """

    def repeats_too_much(w):
        beyond = lambda h: F.when(600 * (F.size(h) - F.size(F.array_distinct(h))) <= MAX_REPEAT_PCT * F.size(w), False).otherwise(100 * words_in_repeats(w, h) > MAX_REPEAT_PCT * F.size(w))
        return let(windows(w), beyond)

    return let(words(text), lambda w: F.when(F.size(w) < MIN_WORDS, True).otherwise(repeats_too_much(w)))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
lines AS (SELECT d.*, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (SELECT *, CASE WHEN len(w) < 4 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END AS g FROM lines),
uniq AS (SELECT *, row_number() OVER () AS rid FROM grams),
each AS (SELECT rid, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM uniq),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM each) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
base AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM uniq LEFT JOIN rep USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source AS host, count(*) AS n, sum(CAST(base_failed AS INT)) AS failed FROM judged GROUP BY source),
prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1.0 END AS strength FROM (SELECT avg(failed / n) AS m, coalesce(var_samp(failed / n), 0) AS v FROM hosts)),
rates AS (SELECT host, (failed + m * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 9) AS host_rate, NOT base_failed AND rate <= 0.8 AS kept
FROM judged LEFT JOIN rates ON source IS NOT DISTINCT FROM host
"""
