"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Each text is measured (words, symbols, punctuation, repeated lines, windows and neighbours). For every language and source a quantile sketch of
each measure is kept: counts by logarithmic bin, so a quantile is right within 1 % of its value, sketches merge by adding counts,
and a merge in any order gives the same result. A source with fewer than `least` documents takes its language's merged sketch, a
language with fewer that of all documents. A measure's upper limit is its median plus the larger of `spread` interquartile ranges
and a smallest spread; mean word length has a lower limit, too. The limits are joined to the documents by language and source, and a
document beyond any limit is rejected, as is one that fails the fixed base rules.

Scale: a sketch has at most about 1,400 bins for each group and measure, whatever the number of documents; counting is combined
before the shuffle, so a hot source costs no more than any other. The limits (a row for each language and source) are counted: up to
100,000 are broadcast, more are joined by shuffling, where the adaptive planner splits a hot source.

Defined results: null text has no words and fails the base rules. A null language or source is a group like any other. Repeated rows
are rows. An empty table gives no rows. Measures are held under names starting with _q_, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import SPACE, counted_side, let
from tidewheel.plans.scratch import materialize

WINDOW = 8
GAMMA = 1.01 / 0.99
#: Measure -> smallest spread above the median.
SPREADS = {"symbols": 0.05, "punct": 0.10, "dup_lines": 0.50, "repeats": 0.25, "echoes": 0.20, "word_length": 6.0}
SPREAD, LEAST = 6.0, 50


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _repeated(words: Column) -> Column:
    """Words inside windows of 8 that occur twice or more in the text."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda z: F.filter(z, lambda x, k: F.coalesce(x["h"] == F.get(z, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(z, k + 1)["h"], F.lit(False)))
        at = lambda z: F.sort_array(F.transform(same(z), lambda x: x["i"]))
        total = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed, lambda z: let(at(z), total))).otherwise(F.lit(0))

    return F.when(n > WINDOW, let(hashes, covered)).otherwise(F.lit(0))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and the measures of its text as _q_n_words, _q_word_chars, _q_n_symbols, _q_n_dup_lines, _q_n_repeat_words, _q_n_lines, _q_n_punct and _q_n_echoes (words equal to the one before)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    echoes = lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False))))
    by_words = let(_words(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeated(w).alias("r"), echoes(w).alias("e")))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    # the two structs are read several times each, so the planner keeps this projection apart and evaluates them once
    own = docs.select(*keep, by_words.alias("_q_w"), lines.alias("_q_l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("_q_s"), F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")).alias("_q_p"))
    names = {"n_words": "_q_w.n", "word_chars": "_q_w.c", "n_symbols": "_q_s", "n_dup_lines": "_q_l.d", "n_repeat_words": "_q_w.r", "n_lines": "_q_l.n", "n_punct": "_q_p", "n_echoes": "_q_w.e"}
    return own.select(*keep, *(F.col(c).cast("long").alias(f"_q_{n}") for n, c in names.items()))


def measures() -> dict[str, Column]:
    """The adaptive measures of a measured row; null for a text without words."""
    words, chars = F.col("_q_n_words"), F.col("_q_word_chars")
    own = {"symbols": F.col("_q_n_symbols") / chars, "punct": F.col("_q_n_punct") / chars, "dup_lines": F.col("_q_n_dup_lines") / F.col("_q_n_lines"), "repeats": F.col("_q_n_repeat_words") / words, "echoes": F.col("_q_n_echoes") / words, "word_length": chars / words}
    return {n: F.when(words > 0, c) for n, c in own.items()}


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: how many documents have the measure in the bin. Bin b holds values up to GAMMA ** b; bin -1000 holds zero."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), c.alias("value")) for n, c in measures().items())))
    value = F.col("x.value")
    binned = F.when(value > 1e-8, F.ceil(F.log(value) / math.log(GAMMA))).otherwise(F.lit(-1000)).cast("int")
    return rows.select("lang", "source", pairs.alias("x")).where("x.value is not null").groupBy("lang", "source", F.col("x.measure").alias("measure"), binned.alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """q1, q2, q3 and total n of each group and measure, from sketches merged over everything but `by`. A group has a bounded number of bins."""
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    value = F.when(F.col("bin") == -1000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (1 + GAMMA))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.struct("bin", value.alias("v"))))["v"]
    return ranked.groupBy(*by, "measure").agg(*(at(q).alias(n) for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))), F.max("total").alias("total"))


def limits(sketch: DataFrame, spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """lang, source and for each measure its upper limit (hi_<measure>) and for word_length a lower one (lo_word_length)."""
    floor = F.coalesce(*(F.when(F.col("measure") == n, F.lit(v)) for n, v in SPREADS.items()))
    bound = F.struct((F.col("q2") + F.greatest(spread * (F.col("q3") - F.col("q1")), floor)).alias("hi"), (F.col("q2") / 3).alias("lo"))
    own = quantiles(sketch, ["lang", "source"]).select("lang", "source", "measure", F.when(F.col("total") >= least, bound).alias("own"))
    lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.when(F.col("total") >= least, bound).alias("of_lang"))
    every = quantiles(sketch, []).select(F.col("measure").alias("m2"), bound.alias("of_all"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).join(F.broadcast(every), F.col("measure") == F.col("m2"))
    chosen = both.select("lang", "source", "measure", F.coalesce("own", "of_lang", "of_all").alias("b"))
    of = lambda n, c: F.max(F.when(F.col("measure") == n, F.col(c)))
    return chosen.groupBy("lang", "source").agg(*(of(n, "b.hi").alias(f"hi_{n}") for n in SPREADS), of("word_length", "b.lo").alias("lo_word_length"))


def judged(docs: DataFrame, carry: list[str], spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """The columns `carry` (with lang and source) of docs, the measures, and _q_base_failed and _q_kept of every row. The texts are measured once, and the measures kept with the rows in the shared folder."""
    keep = list(dict.fromkeys([*carry, "lang", "source"]))
    rows = materialize(measured(docs, keep), "measured")
    bounds = counted_side(limits(sketches(rows), spread, least), 100_000).select(F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), F.struct(*(f"hi_{n}" for n in SPREADS), "lo_word_length").alias("_q_limits"))
    words, repeats = F.col("_q_n_words"), F.col("_q_n_repeat_words")
    failed = (words < 20) | (100 * repeats > 30 * words)
    of = measures()
    fine = F.lit(True)
    for n in SPREADS:
        fine = fine & (of[n] <= F.col(f"_q_limits.hi_{n}"))
    fine = fine & (of["word_length"] >= F.col("_q_limits.lo_word_length"))
    with_limits = rows.join(bounds, F.col("lang").eqNullSafe(F.col("_q_lang")) & F.col("source").eqNullSafe(F.col("_q_source")), "left")
    return with_limits.withColumns({"_q_base_failed": failed, "_q_kept": ~failed & F.coalesce(fine, F.lit(False))}).drop("_q_lang", "_q_source", "_q_limits")


def good(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, that pass."""
    return judged(docs, docs.columns, **how).where("_q_kept").select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
k AS (SELECT *, row_number() OVER () AS k FROM w),
win AS (SELECT k, i, array_to_string(ws[i:i+7], ' ') AS s FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM k)),
hit AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT j) AS r FROM (SELECT k, unnest(range(i, i + 8)) AS j FROM hit) GROUP BY k),
f AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(r, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^!-/:-@\[-`{-~]', '', 'g')) AS n_punct,
  len(list_filter(list_zip(ws[1:len(ws) - 1], ws[2:len(ws)]), lambda z: z[1] = z[2])) AS n_echoes FROM k LEFT JOIN rep USING (k)),
m AS (SELECT * FROM (SELECT lang, source, unnest([{'measure': 'symbols', 'v': n_symbols / word_chars}, {'measure': 'punct', 'v': n_punct / word_chars},
  {'measure': 'dup_lines', 'v': n_dup_lines / n_lines}, {'measure': 'repeats', 'v': n_repeat_words / n_words}, {'measure': 'echoes', 'v': n_echoes / n_words}, {'measure': 'word_length', 'v': word_chars / n_words}], recursive := true)
  FROM f WHERE n_words > 0)),
s AS (SELECT lang, source, measure, CASE WHEN v > 1e-8 THEN ceil(ln(v) / ln(1.01 / 0.99))::INT ELSE -1000 END AS bin, count(*) AS n FROM m GROUP BY ALL),
g AS (SELECT 0 AS lvl, lang, source, measure, bin, sum(n) AS n FROM s GROUP BY ALL UNION ALL SELECT 1, lang, NULL, measure, bin, sum(n) FROM s GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, measure, bin, sum(n) FROM s GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lvl, lang, source, measure) AS total FROM g),
q AS (SELECT lvl, lang, source, measure, max(total) AS total, min(bin) FILTER (upto >= 0.25 * total) AS b1, min(bin) FILTER (upto >= 0.5 * total) AS b2,
  min(bin) FILTER (upto >= 0.75 * total) AS b3 FROM u GROUP BY ALL),
v AS (SELECT *, CASE WHEN b1 = -1000 THEN 0 ELSE 2 * pow(1.01 / 0.99, b1) / (1 + 1.01 / 0.99) END AS q1, CASE WHEN b2 = -1000 THEN 0 ELSE 2 * pow(1.01 / 0.99, b2) / (1 + 1.01 / 0.99) END AS q2,
  CASE WHEN b3 = -1000 THEN 0 ELSE 2 * pow(1.01 / 0.99, b3) / (1 + 1.01 / 0.99) END AS q3 FROM q),
h AS (SELECT *, q2 + greatest(6 * (q3 - q1), CASE measure WHEN 'symbols' THEN 0.05 WHEN 'punct' THEN 0.1 WHEN 'dup_lines' THEN 0.5 WHEN 'repeats' THEN 0.25 WHEN 'echoes' THEN 0.2 ELSE 6 END) AS hi FROM v),
c AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.total >= 50 THEN o.hi WHEN l.total >= 50 THEN l.hi ELSE a.hi END AS hi,
  CASE WHEN o.total >= 50 THEN o.q2 WHEN l.total >= 50 THEN l.q2 ELSE a.q2 END / 3 AS lo
  FROM h o JOIN h l ON l.lvl = 1 AND o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN h a ON a.lvl = 2 AND o.measure = a.measure WHERE o.lvl = 0),
b AS (SELECT lang, source, max(hi) FILTER (measure = 'symbols') AS sy, max(hi) FILTER (measure = 'punct') AS pu, max(hi) FILTER (measure = 'dup_lines') AS du,
  max(hi) FILTER (measure = 'repeats') AS re, max(hi) FILTER (measure = 'echoes') AS ec, max(hi) FILTER (measure = 'word_length') AS wl, max(lo) FILTER (measure = 'word_length') AS wlo FROM c GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(n_symbols / word_chars <= sy AND n_punct / word_chars <= pu AND n_dup_lines / n_lines <= du
  AND n_repeat_words / n_words <= re AND n_echoes / n_words <= ec AND word_chars / n_words <= wl AND word_chars / n_words >= wlo, false)) AS kept
FROM f LEFT JOIN b ON f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source
"""
