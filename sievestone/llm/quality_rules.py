"""Quality rules whose cutoffs are chosen under control of the risk to reject good texts.

A rule rejects a text when one of its statistics (whole per mille, so that a grid of cutoffs is exact) exceeds a cutoff.
For every stratum (language and length) and rule, labelled good texts form a holdout. A cutoff is admitted if the exact
binomial test rejects "more than `risk` of good texts are above it": with k of n holdout texts above the cutoff, the
chance of k or fewer successes among n at that rate must not exceed the level. Along the grid, tests run from lenient to
strict and stop at the first failure (a fixed sequence needs no correction); across tested strata and rules the level is
divided by their number (Bonferroni), and the risk by the number of rules. So, with confidence 1 - `delta`, in no stratum do
the rules together reject more than `risk` of good texts. A stratum is tested if its holdout is large enough to pass a test
on its own (`least_holdout` texts), which depends on its size alone; smaller ones have no cutoff and no rejection.

Everything is built-in DataFrame expressions. Statistics are computed once and written to the shared folder; only they are
joined with labels. Every language has strata of its own. What reaches the driver is the admitted cutoffs: for each at least
`least_holdout` labelled good texts exist, so they are fewer than the labels by that factor.

Defined results: null and empty texts have no words and fail the base rule. Null languages share the stratum `*`. Repeated
rows are judged alike. A text is good if it is labelled 1 and never otherwise; a trial of the holdout is a distinct doc_id,
however often it is labelled or its rows are repeated (of several texts under one id, the one with the largest statistics in
the order of RULES). Three-word windows are compared by 64-bit hashes. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import work_folder, written

SPACE = " \t\n\x0b\x0c\r"
RULES = ("symbols", "dup_lines", "repeat_words", "capitals", "marks")
GRID = (900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 75, 50, 30, 20, 10)
LENGTHS = (200, 1000)
RISK, DELTA = 0.05, 0.05


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the base counts of rows (doc_id, text, lang); no shuffle."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", text.alias("text")).select(
        "doc_id", "lang", "text",
        F.array_remove(F.split(F.translate("text", SPACE[1:], " " * 5), " "), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: _without(line, SPACE) > 0).alias("lines"),
    )
    n = F.size("words")
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    rows = rows.select(
        "doc_id", "lang", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        _without(F.col("text"), SPACE).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.length("text") - _without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
        (F.length("text") - _without(F.col("text"), "!?")).cast("long").alias("n_marks"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n > 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # Only texts with a repeated window are sorted: pairs of hash and position, neighbours of equal hash, their positions.
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("pairs", F.when(repeated, pairs))
    same = lambda a, b: F.coalesce(F.get("pairs", a)["h"] == F.get("pairs", b)["h"], F.lit(False))
    found = F.filter("pairs", lambda x, i: same(i, i - 1) | same(i, i + 1))
    rows = rows.withColumn("found", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        "found",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).cast("long").alias("n")),
        lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("windows", "pairs", "found")


def per_mille() -> dict[str, Column]:
    share = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeat_words": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "marks": share("n_marks", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def length_class() -> Column:
    return F.when(F.col("n_words") < LENGTHS[0], 0).when(F.col("n_words") < LENGTHS[1], 1).otherwise(2)


def log_gamma(x: Column) -> Column:
    """For x >= 1: Stirling's series after eight steps of the recurrence; exact to about 1e-13."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - reduce(lambda a, b: a + b, [F.log(x + i) for i in range(8)])


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of n trials; 1 where k is at or above the mean. Sums downwards from k, where terms fall at least
    geometrically; beyond 40 standard deviations' worth of terms the geometric bound of the rest is added."""
    k, n = k.cast("double"), n.cast("double")
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    terms = F.least(k, F.ceil(40 * F.sqrt(n * rate)) + 100)
    odds = (1 - rate) / rate
    total = F.aggregate(
        F.sequence(F.lit(0), terms.cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1) * odds).alias("term"), (a["total"] + a["term"]).alias("total")),
        lambda a: a["total"] + a["term"] / (1 - k / (n - k + 1) * odds),
    )
    return F.when((k >= n * rate) | (n == 0), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(first) * total))


def stratum() -> Column:
    return F.concat_ws("|", F.coalesce("lang", F.lit("*")), length_class().cast("string"))


def least_holdout(risk: float = RISK, delta: float = DELTA) -> int:
    """Of how many texts none must exceed a cutoff for a test to pass if it were the only stratum."""
    return math.ceil(math.log(delta / len(RULES)) / math.log1p(-risk / len(RULES)))


def calibrate(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff for every stratum ("lang|length") and rule with an admitted cutoff."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = 1 and most = 1").select("doc_id")
    shares = per_mille()
    marks = F.struct(*[shares[r].alias(r) for r in RULES], stratum().alias("stratum"))
    trials = stats.where(~base_failed()).join(good, "doc_id").groupBy("doc_id").agg(F.max(marks).alias("x")).select("x.*")
    # Counts of texts above each cutoff in one pass: one row for each stratum.
    counts = [F.count(F.when(F.col(r) > c, 1)).alias(f"{r}_{c}") for r in RULES for c in GRID]
    strata = trials.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts).where(F.col("n") >= least_holdout(risk, delta))
    level = delta / F.greatest(F.lit(1), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) * len(RULES))  # strata are few by now
    long = strata.withColumn("level", level).select("stratum", "n", "level", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r in RULES for i, c in enumerate(GRID)])).alias("t"))
    passed = binomial_tail(F.col("t.k"), F.col("n"), risk / len(RULES)) <= F.col("level")
    so_far = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tests = long.select("stratum", "t.rule", "t.step", "t.cutoff", passed.alias("passed")).withColumn("passed", F.min("passed").over(so_far))
    return tests.where("passed").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, stratum and the rules that reject, for rows (doc_id, text, lang)."""
    stats = written(statistics(docs), work_folder(docs.sparkSession), "statistics")
    cutoffs: dict[str, dict[str, int]] = {}
    for r in calibrate(stats, labels.select("doc_id", "quality"), **limits).collect():
        cutoffs.setdefault(r["rule"], {})[r["stratum"]] = r["cutoff"]
    shares = per_mille()
    rejects = []
    for rule in RULES:
        per_stratum = [F.lit(x) for pair in sorted(cutoffs.get(rule, {}).items()) for x in pair]
        above = shares[rule] > F.try_element_at(F.create_map(*per_stratum), F.col("stratum")) if per_stratum else F.lit(False)
        rejects.append(F.when(above, F.lit(rule)))
    rows = stats.withColumn("stratum", stratum()).withColumn("rejected_by", F.concat_ws(",", *rejects))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & (F.col("rejected_by") == "")).alias("kept"), "stratum", "rejected_by")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    ws, rate = r"[\x20\x09-\x0D]", RISK / len(RULES)
    shares = {"symbols": "n_symbols * 1000 // greatest(word_chars, 1)", "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "repeat_words": "n_repeat_words * 1000 // greatest(n_words, 1)", "capitals": "n_capitals * 1000 // greatest(word_chars, 1)", "marks": "n_marks * 1000 // greatest(word_chars, 1)"}
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, lang, t, list_filter(string_split_regex(t, '{ws}+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{ws}', '', 'g')) > 0) AS lines FROM d),
i AS (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM s),
w AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c FROM i),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM w WHERE c > 1) GROUP BY rid),
c AS (SELECT s.rid, doc_id, lang, len(words)::BIGINT AS n_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '{ws}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
             length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_marks, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN r ON s.rid = r.rid),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN n_words < {LENGTHS[0]} THEN 0 WHEN n_words < {LENGTHS[1]} THEN 1 ELSE 2 END AS length,
             {", ".join(f"{v} AS {k}" for k, v in shares.items())} FROM c),
o AS (SELECT *, coalesce(lang, '*') || '|' || length AS stratum FROM m),
g AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
t AS (SELECT unnest(max(struct_pack({", ".join(f"{r} := {r}" for r in RULES)}, stratum := stratum))) FROM o JOIN g ON o.doc_id = g.doc_id WHERE NOT base_failed GROUP BY o.doc_id),
h AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS held FROM t) WHERE held >= {least_holdout()}),
u AS (UNPIVOT (SELECT * EXCLUDE held FROM h) ON {", ".join(RULES)} INTO NAME rule VALUE x),
e AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (x > cutoff) AS k
      FROM u CROSS JOIN (VALUES {", ".join(f"({i}, {c})" for i, c in enumerate(GRID))}) v(step, cutoff) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {rate} THEN 1.0 ELSE
             list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({rate}) + (n - j) * ln(1 - {rate})))) END AS p FROM e),
f AS (SELECT *, bool_and(p <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM h) * {len(RULES)})) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM p),
q AS (SELECT stratum, {", ".join(f"min(cutoff) FILTER (rule = '{r}' AND ok) AS c_{r}" for r in RULES)} FROM f GROUP BY stratum),
z AS (SELECT o.*, concat_ws(',', {", ".join(f"CASE WHEN {r} > c_{r} THEN '{r}' END" for r in RULES)}) AS rejected_by FROM o LEFT JOIN q ON o.stratum = q.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, stratum, rejected_by FROM z
"""
