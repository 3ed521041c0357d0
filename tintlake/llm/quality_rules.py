"""Operator 7: quality rules whose cutoffs limit the risk of rejecting a clean document.

Cutoffs are fixed in advance, from lenient to strict. On labelled clean documents an exact (Clopper-Pearson) upper
bound of the share that a cutoff rejects must stay within ``alpha`` divided by the number of rules. Per stratum and
rule the cutoffs are tested in their order and testing stops at the first that fails, so one error probability
serves the whole sequence; over strata and rules it is divided (Bonferroni). With probability 1 - ``delta`` no
stratum loses more than ``alpha`` of its clean documents. A stratum with too few labels keeps everything.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, small_batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in FIELDS])

#: rule -> (numerator, denominator, cutoffs from lenient to strict); a document is rejected above the cutoff.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbol_rate": ("n_symbols", "word_chars", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)),
    "dup_line_rate": ("n_dup_lines", "n_words", (0.5, 0.3, 0.2, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01, 0.005)),
    "repeat_word_rate": ("n_repeat_words", "n_words", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "word_length": ("word_chars", "n_words", (100.0, 60.0, 40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
}


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """FIELDS of one whole text; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes split at ASCII white space only, as the word pattern does
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n >= 3:
        threes = list(zip(words, words[1:], words[2:]))
        if len(set(threes)) < n - 2:
            often = Counter(threes)
            upto = 0  # words before this are counted
            for i, x in enumerate(threes):
                if often[x] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


@F.arrow_udf(SCHEMA)
def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([(c, pa.int64()) for c in FIELDS])
    for batch in batches:
        yield pa.array([dict(zip(FIELDS, measure(x.as_py()))) for x in batch], kind)


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, exact but for rounding: the regularised incomplete beta function of 1 - p at n - k and
    k + 1, by its continued fraction, whose length grows with the root of n only."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    flip = x > (a + 1) / (a + b + 2)  # there the fraction of the complement converges fast
    if flip:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # convergents by forward recurrence, scaled so that the last denominator is 1
    value, m = 1.0, 0
    above, below, last_above, last_below = 1.0, 1.0, 1.0, 0.0
    while True:
        m += 1
        h = m // 2
        step = h * (b - h) * x / ((a + m - 1) * (a + m)) if m % 2 == 0 else -(a + h) * (a + b + h) * x / ((a + m - 1) * (a + m))
        above, last_above = above + step * last_above, above
        below, last_below = below + step * last_below, below
        above, last_above, last_below, below = above / below, last_above / below, last_below / below, 1.0
        if abs(above - value) <= 1e-15 * abs(above) and m > 1:
            break
        value = above
    tail = front / above
    return min(1.0, max(0.0, 1 - tail if flip else tail))


def certified(k: int, n: int, limit: float, error: float) -> bool:
    """Whether the exact upper bound of the rate, at confidence 1 - error, is at most ``limit``.

    The bound is the rate p at which P(X <= k) = error, and that probability falls in p.
    """
    return n > 0 and k < n and k <= n * limit and at_most(k, n, limit) <= error


#: What a rule rejects in a stratum, by cutoff: clean documents, and junk.
Counts = dict[str, tuple[list[int], list[int]]]


def choose(counts: dict[str | None, tuple[int, Counts]], alpha: float, delta: float) -> dict[str | None, dict[str, float | None]]:
    """A certified cutoff per stratum and rule: of those, the most lenient that rejects nearly as much labelled junk
    as the strictest. None if none is certified, or if they reject no junk. counts: clean documents, and Counts.

    All cutoffs before the first failure are certified at once, so any of them may be picked afterwards.
    """
    error = delta / max(1, len(counts) * len(RULES))
    out: dict[str | None, dict[str, float | None]] = {}
    for stratum, (n, above) in counts.items():
        out[stratum] = {}
        for rule, (_, _, cutoffs) in RULES.items():
            clean, junk = above[rule]
            good = 0
            while good < len(cutoffs) and certified(clean[good], n, alpha / len(RULES), error):
                good += 1
            most = junk[good - 1] if good else 0
            out[stratum][rule] = next(c for c, k in zip(cutoffs, junk) if k >= 0.99 * most) if most else None
    return out


def _rate(rule: str):
    over, under, _ = RULES[rule]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0)


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float, delta: float, doc_id: str, stratum: str) -> dict:
    """Cutoffs from the labelled documents that pass the base rules. ``measured`` has FIELDS, id, stratum, base_failed.

    One row a stratum comes to the driver: how many of its clean and junk documents each cutoff rejects.
    """
    given = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("q"))
    rows = measured.where(~F.col("base_failed")).join(given, F.col(doc_id) == F.col("labelled"))
    over = {f"{r}_{i}_{q}": F.count_if((_rate(r) > c) & (F.col("q") == q)) for r, (_, _, cs) in RULES.items() for i, c in enumerate(cs) for q in (0, 1)}
    found = rows.groupBy(stratum).agg(F.count_if(F.col("q") == 1).alias("n"), *[c.alias(k) for k, c in over.items()]).collect()
    column = lambda x, r, q: [x[f"{r}_{i}_{q}"] for i in range(len(RULES[r][2]))]
    return choose({x[stratum]: (x["n"], {r: (column(x, r, 1), column(x, r, 0)) for r in RULES}) for x in found}, alpha, delta)


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, doc_id="doc_id", text="text", stratum="lang") -> DataFrame:
    """Per document: doc_id, FIELDS, base_failed, kept, rules (names of the rules that it breaks).

    base_failed: under 50 words, or more than half of the words lie in repeated 3-word windows; so null and empty
    texts fail. A null stratum is a stratum; one without labels has no cutoffs and keeps what passes the base rules.
    Rows that repeat an id are judged each by its own text. Labels of a repeated id count as clean only if all do.
    Empty tables give an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    m = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), measures(F.col(text)).alias("m")).select("doc_id", "stratum", "m.*")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = cut(m.withColumn("base_failed", base), "rules-measured")
    cutoffs = calibrate(m, labels, alpha, delta, "doc_id", "stratum")
    schema = T.StructType([T.StructField("s", m.schema["stratum"].dataType), *[T.StructField(r, T.DoubleType()) for r in RULES]])
    limits = spark.createDataFrame([(s, *[c[r] for r in RULES]) for s, c in cutoffs.items()], schema)
    x = m.join(limits, m["stratum"].eqNullSafe(limits["s"]), "left")
    broken = F.filter(F.array(*[F.when(_rate(r) > F.col(r), F.lit(r)) for r in RULES]), lambda y: y.isNotNull())
    x = x.withColumn("rules", broken)
    return x.select("doc_id", *FIELDS, "base_failed", (~F.col("base_failed") & (F.size("rules") == 0)).alias("kept"), "rules")


def oracle(alpha: float = 0.05, delta: float = 0.05) -> str:
    """The same in DuckDB, rules as text: windows of words as rows, binomial tails as sums, cutoffs as rows."""
    rate = lambda r: "CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1} ELSE 0 END".format(*RULES[r][:2])
    cutoffs = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, (_, _, cs) in RULES.items() for i, c in enumerate(cs))
    rates = " UNION ALL ".join(f"SELECT r, stratum, doc_id, base_failed, '{r}' AS rule, {k} AS nth, {rate(r)} AS rate FROM m" for k, r in enumerate(RULES))
    limit = alpha / len(RULES)
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
threes AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS three FROM w WHERE len(w) > 2),
often AS (SELECT r, i FROM threes QUALIFY count(*) OVER (PARTITION BY r, three) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) t(k) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM w),
f AS (SELECT w.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines USING (r) LEFT JOIN repeated USING (r)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
rates AS ({rates}),
given AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY 1),
labelled AS (SELECT r.*, q FROM rates r JOIN given USING (doc_id) WHERE NOT base_failed),
cs AS (SELECT * FROM (VALUES {cutoffs}) t(rule, i, c)),
counts AS (SELECT stratum, rule, i, any_value(c) AS c, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND rate > c) AS k, count(*) FILTER (q = 0 AND rate > c) AS junk FROM labelled JOIN cs USING (rule) GROUP BY 1, 2, 3),
tails AS (SELECT stratum, rule, i, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({limit}::DOUBLE) + (n - x) * ln(1 - {limit}::DOUBLE))) AS p
  FROM (SELECT stratum, rule, i, n, unnest(range(0, k + 1)) AS x FROM counts WHERE n > 0 AND k < n) t GROUP BY 1, 2, 3),
passed AS (SELECT c.*, n > 0 AND k < n AND k <= n * {limit}::DOUBLE AND coalesce(p, 1) <= {delta}::DOUBLE / ((SELECT count(*) FROM (SELECT DISTINCT stratum FROM labelled) t) * {len(RULES)}) AS ok
  FROM counts c LEFT JOIN tails t ON c.stratum IS NOT DISTINCT FROM t.stratum AND c.rule = t.rule AND c.i = t.i),
good AS (SELECT * FROM passed p WHERE NOT EXISTS (SELECT 1 FROM passed o WHERE o.stratum IS NOT DISTINCT FROM p.stratum AND o.rule = p.rule AND o.i <= p.i AND NOT o.ok)),
chosen AS (SELECT stratum, rule, arg_min(c, i) AS cutoff FROM (SELECT *, arg_max(junk, i) OVER (PARTITION BY stratum, rule) AS most FROM good) t WHERE most > 0 AND junk >= 0.99::DOUBLE * most GROUP BY 1, 2),
broken AS (SELECT r, string_agg(x.rule, ',' ORDER BY nth) AS rules FROM rates x JOIN chosen c ON x.stratum IS NOT DISTINCT FROM c.stratum AND x.rule = c.rule WHERE rate > cutoff GROUP BY r)
SELECT doc_id, {', '.join(FIELDS)}, base_failed, NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS rules FROM m LEFT JOIN broken USING (r)
"""
