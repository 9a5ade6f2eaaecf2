"""Quality rules with host verdicts, in DataFrame functions only.

1. Each document is measured inside its own row (no row per word leaves it) and tested
   by the RULES. The first two are *base* rules, which a document must pass itself.
2. Failures of each rule are summed by host. Rates are shrunk towards the corpus by a
   beta prior for each rule, fitted to all hosts (method of moments): a host with few
   documents is judged mostly by the prior, a host with many by its own rate.
3. A host is *strict* in a rule if its shrunk rate is more than SPREAD standard
   deviations of the prior above the prior's mean, so the limit follows the corpus. A
   host is out if its shrunk rate of base failures is above ``max_host_rate``.
4. Host verdicts join back: a document stays if it passes the base rules, its host isn't
   out, and it fails no other rule in which its host is strict. A document that passes
   all rules goes only with a host that is out.

Measures go to a table in the shared folder, so texts are read once. The host table
is broadcast only if it is counted small; beyond that both sides are dealt by host
and a salt, so a host with a third of all rows is many tasks.

Edge cases: null text has no words and fails; null hosts are one host; documents are
counted as often as they come; null and equal ids are rows of their own; an empty table
gives an empty result. A very long text is measured whole in its own row. Other columns
aren't read, whatever they are called. Prior: with fewer than two hosts, or equal rates
of all, the prior is the corpus rate with the weight of ``PRIOR_DOCS`` documents; hosts
that differ more than a beta distribution allows leave it the weight of one document.
A rate equal to its limit is not above it.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Hosts whose shrunk failure rate is above this lose all their documents.
MAX_HOST_RATE = 0.5
PRIOR_DOCS = 100.0
#: Standard deviations of the prior above its mean from which on a host is strict in a rule.
SPREAD = 1.0
#: Variances of rates up to this are rounding, not difference.
SAME = 1e-12
SALTS = 32
#: Rule -> what fails it. Limits of the soft rules: a symbol in ten words, three in ten
#: lines repeated, mean word lengths from 3 to 10.
BASE_RULES = {
    "short": lambda: F.col("n_words") < MIN_WORDS,
    "repeats": lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
}
SOFT_RULES = {
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "lines": lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    "word_length": lambda: (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words")),
}
RULES = BASE_RULES | SOFT_RULES
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in order; null gives none."""
    one = F.translate(F.coalesce(text, F.lit("")), _SPACES[1:], " " * 5)
    return F.array_remove(F.split(one, " ", -1), "")


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more in the text.

    Windows are hashed to 64 bits. Only where a hash repeats are windows sorted by
    (hash, place); places next to an equal hash repeat, and the words they cover are
    counted over the places in order.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            size = F.size(s)
            here = lambda i: F.element_at(s, i)["h"]
            same = lambda x, i: ((i > 0) & (here(F.greatest(i, F.lit(1))) == x["h"])) | ((i + 2 <= size) & (here(F.least(i + 2, size)) == x["h"]))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        def count(p: Column) -> Column:
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
            return F.aggregate(p, start, step, lambda acc: acc["n"])

        return let(let(tagged, places), count)

    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)``; n_lines have a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(_SPACES)) != ""), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    stats = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    return rows.select(
        "id",
        "host",
        stats.alias("s"),
        F.length(_removed(text, _SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_removed(text, _SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("l"),
    ).select("id", "host", "s.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "s.n_repeat_words")


def judged(measured: DataFrame) -> DataFrame:
    """``measured`` with ``fails_<rule>`` for every rule, and ``base_failed``."""
    out = measured.select("*", *[f().alias(f"fails_{rule}") for rule, f in RULES.items()])
    return out.withColumn("base_failed", reduce(or_, [F.col(f"fails_{rule}") for rule in BASE_RULES]))


def host_counts(rows: DataFrame) -> DataFrame:
    """``(host, host_docs, failed_base, failed_<rule>...)`` of judged documents."""
    failed = {"base": "base_failed"} | {rule: f"fails_{rule}" for rule in SOFT_RULES}
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.col(c).cast("long")).alias(f"failed_{rule}") for rule, c in failed.items()])


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(weight, centre) of each rule's beta prior: two numbers a rule, whatever the number of hosts.

    With m and v the mean and variance of the hosts' rates, a + b = m(1 - m)/v - 1 and
    a = m(a + b).
    """
    rules = ["base", *SOFT_RULES]
    rate = lambda rule: F.col(f"failed_{rule}") / F.col("host_docs")
    r = hosts.agg(F.sum("host_docs").alias("n"), *[f(x).alias(f"{name}_{rule}") for rule in rules for name, f, x in (("m", F.avg, rate(rule)), ("v", F.var_samp, rate(rule)), ("f", F.sum, F.col(f"failed_{rule}")))]).first()
    out = {}
    for rule in rules:
        m, v, failed = r[f"m_{rule}"], r[f"v_{rule}"], r[f"f_{rule}"]
        out[rule] = (max(m * (1 - m) / v - 1, 1.0), m) if v and v > SAME else (PRIOR_DOCS, failed / r.n if r.n else 0.0)
    return out


def host_verdicts(hosts: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Hosts with ``rate_<rule>``, shrunk to (failed + a)/(docs + a + b), ``strict_<rule>`` and ``host_kept``."""
    found = priors(hosts)
    shrunk = {rule: (F.col(f"failed_{rule}") + centre * weight) / (F.col("host_docs") + weight) for rule, (weight, centre) in found.items()}
    limit = {rule: centre + SPREAD * math.sqrt(centre * (1 - centre) / (weight + 1)) for rule, (weight, centre) in found.items()}
    strict = [(shrunk[rule] > limit[rule]).alias(f"strict_{rule}") for rule in SOFT_RULES]
    return hosts.select("*", *[x.alias(f"rate_{rule}") for rule, x in shrunk.items()], *strict, (shrunk["base"] <= max_host_rate).alias("host_kept"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every document's measures and failed rules, its host's figures and verdicts, and ``kept``."""
    ws = Workspace(docs.sparkSession, "quality")
    measured = ws.table(judged(measure(docs, id_col, text_col, host_col)), "measured")
    hosts = host_verdicts(ws.table(host_counts(measured), "hosts"), max_host_rate)
    same = F.col("host").eqNullSafe(F.col("__host"))
    hosts = hosts.withColumnRenamed("host", "__host")
    if hosts.count() <= BROADCAST_ROWS:
        joined = measured.join(F.broadcast(hosts), same, "left")
    else:
        salted = hosts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("__own", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__salt")
    strict = reduce(or_, [F.col(f"fails_{rule}") & F.col(f"strict_{rule}") for rule in SOFT_RULES])
    return joined.drop("__host").withColumn("kept", ~F.col("base_failed") & F.col("host_kept") & ~strict).withColumnRenamed("id", id_col)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, w[i:i+4] AS g FROM (
    SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)),
repeats AS (
  SELECT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM repeats GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, 10 * n_symbols > n_words AS fails_symbols,
         10 * n_dup_lines > 3 * n_lines AS fails_lines, (word_chars < 3 * n_words OR word_chars > 10 * n_words) AS fails_word_length FROM base),
rules AS (
  UNPIVOT (SELECT source, base_failed AS base, fails_symbols AS symbols, fails_lines AS lines, fails_word_length AS word_length FROM judged)
  ON base, symbols, lines, word_length INTO NAME rule VALUE fails),
hosts AS (
  SELECT rule, source, count(*) AS docs, sum(CAST(fails AS INT)) AS failed FROM rules GROUP BY rule, source),
prior AS (
  SELECT rule, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 100.0 END AS weight,
         CASE WHEN v > 1e-12 THEN m ELSE p END AS centre
  FROM (SELECT rule, avg(failed / docs) AS m, var_samp(failed / docs) AS v, sum(failed) / sum(docs) AS p FROM hosts GROUP BY rule)),
rates AS (
  SELECT rule, source, (failed + centre * weight) / (docs + weight) AS rate, centre + sqrt(centre * (1 - centre) / (weight + 1)) AS lim
  FROM hosts JOIN prior USING (rule)),
verdicts AS (
  SELECT source, bool_or(rule = 'base' AND rate > 0.5) AS host_out, bool_or(rule = 'symbols' AND rate > lim) AS strict_symbols,
         bool_or(rule = 'lines' AND rate > lim) AS strict_lines, bool_or(rule = 'word_length' AND rate > lim) AS strict_word_length
  FROM rates GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR host_out OR (fails_symbols AND strict_symbols) OR (fails_lines AND strict_lines)
            OR (fails_word_length AND strict_word_length)) AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: measures and verdicts of every document; the host is the source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
