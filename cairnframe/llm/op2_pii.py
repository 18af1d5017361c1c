"""Personal data: fixed patterns, and identifiers that bootstrapped contexts discover.

Four fixed kinds (e-mail, IPv4, payment card, phone) are found by regular expressions whose repetitions are possessive and
whose starts are bound to run starts, so that long junk costs linear time and no stack.  They are seeds, and so are keys: words of
``KEY`` hexadecimal digits or more.  Every word with a digit or an ``@`` is a candidate instance; numeric groups one space apart
(``123 45 6789``, a card or phone in groups) are one instance.  The one and the two plain words left and right of it are lexical
patterns.  On the bipartite graph of patterns and instances Spark iterates until the scores settle: a pattern's confidence is
the score of the instances it meets, over *all* occurrences of its words in the corpus (so "the" never counts for much); an
instance's score is one minus the product of the doubts of its confident patterns.  Patterns need ``SUPPORT`` different supported
instances, of any kind: what was discovered teaches patterns in its turn.  Instances over the threshold that are none of the four
kinds are the discoveries, spans of kind ``context``: a key is one only where its contexts say so.

DataFrame functions only.  Texts are read twice (spans and candidates; occurrences of the surviving patterns' words) and never
shuffled; all joins are on narrow rows, the first aggregations are partial.  A numeric identifier one space from a span of a fixed
kind is part of that instance.

Defined cases: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows are judged apart by a
row number fixed on shared storage; null doc_ids stay; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, documents, drop_scratch, join_small, let, materialise

_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
_GROUP = r"[()+.-]*+[0-9][0-9()+.-]*+(?![^\x20\x09-\x0D])"
#: Numeric groups one space apart, or a word with a digit or an @.
CANDIDATE = rf"(?<![^\x20\x09-\x0D])(?:{_GROUP}(?:\x20{_GROUP})*+|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
KINDS = ("email", "ip", "card", "phone", "context")

#: Rounds until scores must have settled; more is an error, not a result.
ROUNDS = 100
SUPPORT = 3
CONFIDENCE = 0.5
#: A candidate has at least this many characters; 1 leaves none out.
SHORTEST = 5
#: Hexadecimal digits that make a word a seed of its own.
KEY = 32
_BLOCK = 128


def _running(d: Column) -> Column:
    """Prefix sums of an array of integers: inside blocks, plus the sums of the blocks before."""

    def add(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, y: a + y)

    def with_blocks(sums: Column) -> Column:
        before = F.transform(sums, lambda _, b: add(F.slice(sums, F.lit(1), b)))
        return let(before, lambda pre: F.transform(d, lambda _, i: F.get(pre, F.floor(i / _BLOCK).cast("int")) + add(F.slice(d, i - F.pmod(i, F.lit(_BLOCK)) + 1, F.pmod(i, F.lit(_BLOCK)) + 1))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / _BLOCK).cast("int")), lambda b: add(F.slice(d, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(blocks, with_blocks)


def located(text: Column, pattern: str, body) -> Column:
    """``body(m, start, pieces, i, hits)`` for all matches; start in code points, pieces what lies between the matches."""

    def with_pieces(hits: Column) -> Column:
        def placed(pieces: Column) -> Column:
            d = F.transform(hits, lambda m, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))
            return let(d, lambda x: let(_running(x), lambda starts: F.transform(hits, lambda m, i: body(m, F.get(starts, i), pieces, i, hits))))

        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_pieces)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def one(a: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return a + F.when(i % 2 == 1, twice).otherwise(x)

    return F.pmod(F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), one), F.lit(10)) == 0


def _valid_card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end>> of the fixed kinds, in order."""
    rules = [
        (EMAIL, text.contains("@"), lambda m: F.lit(True)),
        (IP, text.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")),
        (CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), _valid_card),
        (PHONE, text.contains("+"), lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)),
    ]
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    found = []
    for k, (pattern, guard, valid) in enumerate(rules):
        hits = located(text, pattern, lambda m, s, p, i, h, k=k, valid=valid: F.struct(s.alias("start"), F.lit(k).alias("k"), (s + F.length(m)).alias("end"), valid(m).alias("ok")))
        kept = F.transform(F.filter(hits, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["k"], x["end"]))
        found.append(F.coalesce(F.when(guard, kept), none))
    return F.sort_array(F.concat(*found))


def _candidates(text: Column, spans: Column, shortest: int = SHORTEST) -> Column:
    """array<struct<start, end, inst, pats, base>>: candidates, the patterns beside them, whether a span of a fixed kind is in them."""

    def spaced(piece: Column) -> Column:
        return F.translate(piece, "\t\n\x0b\x0c\r", " " * 5)

    def beside(piece: Column, side: str) -> list[Column]:
        """The patterns of one side: its nearest word, its two nearest words; null where there are fewer."""
        trim, n = (F.rtrim, -1) if side == "L" else (F.ltrim, 1)

        def both(x: Column) -> Column:
            near = F.substring_index(x, " ", n)
            rest = trim(F.substring(x, F.lit(1), F.length(x) - F.length(near)) if side == "L" else F.substring(x, F.length(near) + 1, F.length(x)))
            far = F.substring_index(rest, " ", n)
            pair = F.concat_ws(" ", far, near) if side == "L" else F.concat_ws(" ", near, far)
            return F.struct(F.when(near != "", F.concat(F.lit(side), near)).alias("one"), F.when(far != "", F.concat(F.lit(side), pair)).alias("two"))

        got = let(trim(spaced(piece)), both)
        return [got["one"], got["two"]]

    def one(m: Column, start: Column, pieces: Column, i: Column, hits: Column) -> Column:
        lead = F.length(m) - F.length(F.regexp_replace(m, r"^[^\p{L}\p{N}]+", ""))
        inst = F.lower(F.regexp_replace(m, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
        s = (start + lead).alias("start")
        end = start + lead + F.length(inst)
        base = F.exists(spans, lambda x: (x["start"] < end) & (x["end"] > start + lead))
        pats = F.array_compact(F.array(*beside(F.lower(F.get(pieces, i)), "L"), *beside(F.lower(F.get(pieces, i + 1)), "R")))
        return F.struct(s, end.alias("end"), inst.alias("inst"), pats.alias("pats"), base.alias("base"))

    got = F.when(text.rlike("[0-9@]"), located(text, CANDIDATE, one))
    return F.coalesce(F.filter(got, lambda x: F.length(x["inst"]) >= shortest), F.array().cast("array<struct<start:int,end:int,inst:string,pats:array<string>,base:boolean>>"))


def scan(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """row, doc_id, spans, words: what one reading of the texts finds.  ``row`` is fixed once written."""
    t = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", let(t, lambda x: let(base_spans(x), lambda s: F.struct(s.alias("spans"), _candidates(x, s, shortest).alias("words")))).alias("f"))
    return materialise(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "f.spans", "f.words"), "op2-found")


def graph(found: DataFrame) -> DataFrame:
    """(pat, inst, n, seed, base): how often an instance stands beside a pattern ("L" or "R" and one or two words)."""
    occ = found.select(F.explode("words").alias("w")).select("w.inst", "w.base", F.explode("w.pats").alias("pat"))
    seed = F.max("base") | F.first(F.col("inst").rlike(rf"^[0-9a-f]{{{KEY},}}$"))
    return occ.groupBy("pat", "inst").agg(F.count("*").alias("n"), seed.alias("seed"), F.max("base").alias("base"))


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pat, total): occurrences of each pattern's words in all texts."""
    named = patterns.select("pat", F.substring("pat", 2, 1 << 30).alias("word"))
    wanted = materialise(named.select("word").distinct(), "op2-wanted")
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD), F.lit(0))
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    every = docs.select(F.explode(let(words, lambda w: F.concat(w, pairs(w)))).alias("word"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        counts = every.join(F.broadcast(wanted), "word", "left_semi").groupBy("word").agg(F.count("*").alias("total"))
    else:  # counted before the join: a frequent word is then one row a task
        counts = every.groupBy("word").agg(F.count("*").alias("total")).join(wanted, "word", "left_semi")
    return named.join(counts, "word").select("pat", "total")


def bootstrap(docs: DataFrame, found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(inst, score) of discovered instances."""
    edges = materialise(graph(found), "op2-edges")
    # instances of any kind: later rounds admit patterns by what was discovered
    able = materialise(edges.groupBy("pat").agg(F.count("*").alias("k")).where(F.col("k") >= support).select("pat"), "op2-able")
    totals = materialise(pattern_totals(docs, able), "op2-totals")
    # an instance is a seed wherever it stands if it is one anywhere
    seeds = materialise(edges.where("seed").groupBy("inst").agg(F.max("base").alias("base")), "op2-seeds")
    graphed = materialise(edges.join(totals, "pat").select("pat", "inst", "n", "total"), "op2-graph")
    drop_scratch(edges, able, totals)
    ones = seeds.select("inst", F.lit(1.0).alias("score"))
    told, before = None, None
    for _ in range(rounds):
        scores = ones if told is None else ones.unionByName(told.join(seeds, "inst", "left_anti"))
        met = graphed.join(scores, "inst")
        conf = (
            met.groupBy("pat")
            .agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.first("total").alias("total"), F.count_if(F.col("score") >= confidence).alias("k"))
            .select("pat", F.least(F.col("mass") / (F.col("total") + 1), F.lit(0.999)).alias("conf"), "k")
            .where((F.col("k") >= support) & (F.col("conf") >= confidence))
        )
        new = graphed.join(materialise(conf.select("pat", "conf"), "op2-conf"), "pat").groupBy("inst").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        told = materialise(new, "op2-scores")
        state = told.agg(F.count("*"), F.sum(F.round(F.col("score").cast("decimal(20,10)"), 6))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"scores did not settle in {rounds} rounds")
    return told.where(F.col("score") >= confidence).join(seeds.where("base"), "inst", "left_anti")


def find(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, base (array of start, k, end), spans (base and discovered, in order; ``k`` counts in :data:`KINDS`)."""
    found = scan(docs, shortest)
    fresh = materialise(bootstrap(docs, found, support, confidence), "op2-fresh")
    occ = found.select("row", F.explode("words").alias("w")).where("NOT w.base").select("row", "w.inst", F.struct(F.col("w.start").alias("start"), F.lit(4).alias("k"), F.col("w.end").alias("end")).alias("s"))
    more = join_small(occ, fresh.select("inst"), "inst").groupBy("row").agg(F.collect_list("s").alias("more"))
    out = found.select("row", "doc_id", "spans").join(more, "row", "left")
    return out.select("doc_id", F.col("spans").alias("base"), F.sort_array(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:int,k:int,end:int>>")))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(documents(spark, sf_dir))
    counts = [_count(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    digests = [F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")]
    return out.select("doc_id", *counts, *digests, _count(F.col("spans"), 4).alias("n_context"), F.size("spans").cast("long").alias("n_spans"))
