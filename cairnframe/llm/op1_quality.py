"""Quality rules with risk-controlled thresholds.

Each rule compares one number of a document (share of symbols, of capitals, of repeated words ...) with a cutoff.  Cutoffs are
not guessed.  In every stratum (language) the labelled rows fall into two halves by a hash of their id.  The tuning half ranks
the rules by the bad rows they catch, each at the step of its ladder of cutoffs that catches most while it spares the good rows.  The
holdout half, which had no say in that, then tests the nested sets "first rule", "first two rules" ... in this order.  The null
hypothesis of a set is "it rejects more than ``alpha`` of the good documents of this stratum"; its exact p-value is the binomial
tail P(Bin(n, alpha) <= k), k of n good holdout rows being rejected (the Clopper-Pearson bound read the other way round).  A
set counts as long as it and all before it stay under ``delta / strata``: fixed-sequence testing inside a stratum, Bonferroni
over strata.  So with probability 1 - delta no stratum loses more than ``alpha`` of its good documents to the chosen rules.

Only DataFrame functions run.  Documents are read once for their numbers; labelled rows are counted per (stratum, rule, level)
with partial sums; the table of cutoffs has one row per stratum.

Defined cases:

* null or empty text: no words, ``base_failed``.
* null language: a stratum of its own.  A stratum with too few labels to prove anything gets no cutoffs: it keeps
  what the base rules keep.
* repeated rows are judged alike, each by itself; several labels of a doc_id count as its lowest quality; null labels and null
  doc_ids never calibrate.
* empty documents or labels: no rows, or base rules only.  Extra columns pass through :func:`filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, join_small, let, materialise

ALPHA = 0.02
DELTA = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A cutoff is of use if it rejects at least this share of the bad rows, and this many times the share of the good ones.
MIN_BAD, MIN_RATIO = 0.01, 4.0

_SHARES = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
#: rule -> (numerator, denominator, ladder of cutoffs from lenient to strict); more than the cutoff is a rejection
RULES = {
    "symbols": ("n_symbols", "word_chars", _SHARES),
    "capitals": ("n_capitals", "word_chars", _SHARES),
    "shouts": ("n_shouts", "n_words", _SHARES),
    "digits": ("n_digits", "word_chars", _SHARES),
    "dup_lines": ("n_dup_lines", "n_lines", _SHARES),
    "repeats": ("n_repeat_words", "n_words", _SHARES),
    "word_length": ("word_chars", "n_words", (20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0, 6.0)),
}
NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_digits")


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``hashes`` has one entry per three-word window, in order."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def among(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, among))


def numbers(text: Column) -> Column:
    """A struct of :data:`NUMBERS`, all bigint, of one text."""
    t = F.coalesce(text, F.lit(""))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, "")).cast("long")

    def of_words(w: Column) -> Column:
        n = F.size(w)
        hashes = F.when(n >= 3, F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(n.cast("long").alias("n_words"), let(hashes, _repeat_words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), of_words)
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    return let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda s: F.struct(
            s["w"]["n_words"].alias("n_words"),
            left(r"[\x20\x09-\x0D]+").alias("word_chars"),
            left(r"[^#*$%&|<>]+").alias("n_symbols"),
            s["l"]["n_dup_lines"].alias("n_dup_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
            s["l"]["n_lines"].alias("n_lines"),
            left(r"[^A-Z]+").alias("n_capitals"),
            left(r"[^!?]+").alias("n_shouts"),
            left(r"[^0-9]+").alias("n_digits"),
        ),
    )


def base_failed(x: Column) -> Column:
    return (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])


def _value(x: Column, rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.when(x[bottom] > 0, x[top].cast("double") / x[bottom]).otherwise(F.lit(0.0))


def _lgamma(x: Column) -> Column:
    """log Gamma(x), x >= 1, by Stirling's series at x + 10."""
    y = x + 10
    down = F.log(x)
    for i in range(1, 10):
        down = down + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046728 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to rounding where k <= n * p, and 1 above, where nothing is to be decided.

    Terms fall at least geometrically below k.  Those more than 60 standard deviations below it vanish in a double.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    most = F.least(k, F.ceil(60 * F.sqrt(n * p * (1 - p)) + 60)).cast("int")
    zero = F.struct(first.alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(
        F.sequence(F.lit(0), most),
        zero,
        lambda a, i: F.struct((a["t"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: stratum, cutoffs (map from rule to cutoff).

    ``measured`` has doc_id, stratum and x (the numbers); ``labels`` doc_id and quality (1 good, 0 bad).
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    x = F.col("x")
    rows = measured.where(~base_failed(x)).join(marks, "doc_id")
    half = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1), 16, 10).cast("int") % 2
    rows = materialise(rows.select("stratum", half.alias("half"), (F.col("quality") > 0).alias("good"), "x"), "op1-labelled")
    levels = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), sum(((_value(x, r) > c).cast("int") for c in ladder), F.lit(0)).alias("level"))
            for r, (_, _, ladder) in RULES.items()
        ]
    )
    counted = (
        rows.where("half = 0")
        .select("stratum", "good", F.explode(levels).alias("e"))
        .groupBy("stratum", F.col("e.rule").alias("rule"), F.col("e.level").alias("level"))
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    ladder = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i + 1).alias("step"), F.lit(c).alias("cutoff")) for r, (_, _, cs) in RULES.items() for i, c in enumerate(cs)])
    steps = counted.select("stratum").distinct().select("stratum", F.explode(ladder).alias("s")).select("stratum", "s.*")
    # a row at level L is rejected by the steps 1..L
    hit = F.col("level") >= F.col("step")
    tuned = (
        steps.join(counted, ["stratum", "rule"])
        .groupBy("stratum", "rule", "step", "cutoff")
        .agg(
            F.sum(F.when(hit, F.col("good")).otherwise(0)).alias("kg"),
            F.sum("good").alias("ng"),
            F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias("kb"),
            F.sum("bad").alias("nb"),
        )
        .where((F.col("kg") * len(RULES) <= alpha * F.col("ng")) & (F.col("kb") > 0) & (F.col("kb") >= MIN_BAD * F.col("nb")) & (F.col("kb") * F.col("ng") >= MIN_RATIO * F.col("kg") * F.col("nb")))
        .groupBy("stratum", "rule")
        .agg(F.max_by(F.struct("cutoff", "kb"), F.struct(F.col("kb"), -F.col("step"))).alias("b"))
    )
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(F.col("b.kb").desc(), "rule"))
    tuned = tuned.select("stratum", F.struct(rank.alias("rank"), "rule", "b.cutoff").alias("t")).groupBy("stratum").agg(F.sort_array(F.collect_list("t")).alias("tuned"))
    held = join_small(rows.where("half = 1 AND good"), materialise(tuned, "op1-tuned"), "stratum")
    failing = F.filter("tuned", lambda t: _fails(x, t))
    first = held.select("stratum", "tuned", F.coalesce(F.get(failing, F.lit(0))["rank"], F.lit(len(RULES) + 1)).alias("first"))
    counts = first.groupBy("stratum").agg(F.first("tuned").alias("tuned"), F.count("*").alias("n"), *[F.count_if(F.col("first") <= i).alias(f"k{i}") for i in range(1, len(RULES) + 1)])
    strata = max(1, rows.select("stratum").distinct().count())
    ks = F.array(*[F.struct(F.lit(i).alias("rank"), binomial_tail(F.col(f"k{i}"), F.col("n"), alpha).alias("p")) for i in range(1, len(RULES) + 1)])
    passed = let(F.filter(ks, lambda s: s["p"] > F.lit(delta / strata)), lambda bad: F.coalesce(F.get(bad, F.lit(0))["rank"], F.lit(len(RULES) + 1)) - 1)
    kept = F.filter("tuned", lambda t: t["rank"] <= F.col("upto"))
    return counts.withColumn("upto", passed).select("stratum", F.map_from_entries(F.transform(kept, lambda t: F.struct(t["rule"], t["cutoff"]))).alias("cutoffs"))


def _rejected(x: Column, cutoffs: Column) -> Column:
    """By any rule that has a cutoff in the document's stratum."""
    hits = [F.coalesce(_value(x, r) > F.element_at(cutoffs, F.lit(r)), F.lit(False)) for r in RULES]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def _fails(x: Column, t: Column) -> Column:
    """Whether the numbers are over the cutoff of one tuned rule."""
    return F.element_at(F.create_map(*[y for r in RULES for y in (F.lit(r), _value(x, r))]), t["rule"]) > t["cutoff"]


def _stratum(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


#: Ids of labelled documents that may be broadcast: some 16 MB.
LABELS = 500_000


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, x: the numbers of every document."""
    return docs.select("doc_id", _stratum(F.col("lang")).alias("stratum"), numbers(F.col("text")).alias("x"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document its numbers, base_failed and kept."""
    measured = materialise(measure(docs), "op1-numbers")
    cutoffs = materialise(calibrate(measured, labels, alpha, delta), "op1-cutoffs")
    out = join_small(measured, cutoffs, "stratum", "left")
    x = F.col("x")
    return out.select("doc_id", *[x[n].alias(n) for n in NUMBERS], base_failed(x).alias("base_failed"), (~base_failed(x) & ~_rejected(x, F.col("cutoffs"))).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that base rules and certified rules keep, with the columns they came with.

    The numbers of labelled documents are computed a second time where they are applied: that costs less than shuffling every text
    to join them.  Up to ``LABELS`` labelled ids are broadcast to find these documents; with more, all are measured.
    """
    some = materialise(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct(), "op1-ids")
    if some.limit(LABELS + 1).count() <= LABELS:
        measured = materialise(measure(docs.join(F.broadcast(some), "doc_id", "left_semi")), "op1-numbers")
    else:
        measured = materialise(measure(docs), "op1-numbers")
    cutoffs = materialise(calibrate(measured, labels, alpha, delta), "op1-cutoffs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _stratum(F.col("lang")).alias("stratum"), numbers(F.col("text")).alias("x"))
    out = join_small(rows, cutoffs, "stratum", "left")
    return out.select("row", (~base_failed(F.col("x")) & ~_rejected(F.col("x"), F.col("cutoffs"))).alias("ok")).where("ok").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *NUMBERS[:5], "base_failed", "kept")


def _sql() -> str:
    rule_rows = ", ".join(f"('{r}', {i + 1}, {c}::DOUBLE)" for r, (_, _, cs) in RULES.items() for i, c in enumerate(cs))
    values = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, CASE WHEN {b} > 0 THEN {t}::DOUBLE / {b} ELSE 0.0 END AS v FROM x" for r, (t, b, _) in RULES.items())
    m, p = len(RULES), repr(ALPHA)
    return rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM t
), g AS (
  SELECT doc_id, i, word, lead(word) OVER v AS b, lead(word, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM g WHERE c IS NOT NULL
), rep AS (
  SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM h, (VALUES (0), (1), (2)) z(o) WHERE n > 1 GROUP BY doc_id
), x AS (
  SELECT t.doc_id, stratum,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
    length(regexp_replace(text, '[^!?]+', '', 'g'))::BIGINT AS n_shouts,
    length(regexp_replace(text, '[^0-9]+', '', 'g'))::BIGINT AS n_digits
  FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id
), y AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM x
), vals AS ({values}
), marks AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), lab AS (
  SELECT y.doc_id, stratum, quality > 0 AS good, ('0x' || substr(md5(y.doc_id::VARCHAR), 1, 1))::INT % 2 AS half FROM y JOIN marks USING (doc_id) WHERE NOT base_failed
), ladder(rule, step, cutoff) AS (VALUES {rule_rows}
), tested AS (
  SELECT stratum, rule, step, cutoff,
    count(*) FILTER (WHERE good AND v > cutoff) AS kg, count(*) FILTER (WHERE good) AS ng,
    count(*) FILTER (WHERE NOT good AND v > cutoff) AS kb, count(*) FILTER (WHERE NOT good) AS nb
  FROM lab JOIN vals USING (doc_id) JOIN ladder USING (rule) WHERE half = 0 GROUP BY ALL
), tuned AS (
  SELECT stratum, rule, arg_max(cutoff, kb * 100 - step) AS cutoff, max(kb) AS kb FROM tested
  WHERE kg * {m} <= {ALPHA}::DOUBLE * ng AND kb > 0 AND kb >= {MIN_BAD}::DOUBLE * nb AND kb * ng >= {MIN_RATIO}::DOUBLE * kg * nb GROUP BY stratum, rule
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY kb DESC, rule) AS rank FROM tuned
), firsts AS (
  SELECT lab.stratum, lab.doc_id, min(CASE WHEN v > cutoff THEN rank END) AS first
  FROM lab JOIN ranked ON lab.stratum = ranked.stratum JOIN vals ON vals.doc_id = lab.doc_id AND vals.rule = ranked.rule WHERE half = 1 AND good GROUP BY ALL
), ks AS (
  SELECT stratum, r AS rank, count(*) AS n, count(*) FILTER (WHERE first <= r) AS k FROM firsts, range(1, {m} + 1) z(r) GROUP BY ALL
), tails AS (
  SELECT stratum, rank, CASE WHEN k > n * {p} THEN 1.0 ELSE
    (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))) FROM range(0, k + 1) r(j)) END AS p_value
  FROM ks
), seq AS (
  SELECT *, max(p_value) OVER (PARTITION BY stratum ORDER BY rank ROWS UNBOUNDED PRECEDING) AS worst, (SELECT count(DISTINCT stratum) FROM lab) AS strata FROM tails
), best AS (
  SELECT ranked.* FROM ranked JOIN seq USING (stratum, rank) WHERE worst <= {DELTA}::DOUBLE / strata
), hit AS (
  SELECT DISTINCT y.doc_id FROM y JOIN best USING (stratum) JOIN vals ON vals.doc_id = y.doc_id AND vals.rule = best.rule WHERE v > cutoff
)
SELECT y.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit.doc_id IS NULL AS kept
FROM y LEFT JOIN hit ON y.doc_id = hit.doc_id
"""


SQL = _sql()
