"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Patterns give the base spans (email, ip, card, phone).  They are the seeds:

1. Mentions: every word with a digit, with the words left and right of it
   (lower-cased, without marks, from ``CONTEXT`` code points to each side).
   A mention inside a base span is a seed.
2. Graph: a lexical pattern is a left word, a right word, or both; it is
   linked with the instances (mention texts) that it stands next to.
3. Scores, in ``ROUNDS`` rounds: a pattern's score is the mean score of its
   instances, damped for few (``PRIOR``); with ``MIN_SUPPORT`` instances and a
   score of ``MIN_SCORE`` or more it is trusted.  An instance's score is 1 for
   a seed, else the noisy-or of its trusted patterns, 1 - prod(1 - score): one
   trusted neighbour is enough, whatever stands on the other side, and
   patterns that say little say nothing however many they are.
4. Mentions in a trusted pattern whose instance score is high too are found
   (kind context), where they meet no base span.

The text is read once, row by row, with built-in functions; only spans and
mentions go on, in a table in the shared folder.  Links are distinct (pattern,
instance) pairs, so repeated rows add nothing; the joins are equi-joins of
plain tables, which AQE splits where a word is frequent.

Null text counts as empty.  Spans are in code points, end exclusive.  Equal
rows get equal results; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_SPANS, cut, matches, pattern_spans, span_text

# The base patterns, in the order of their kinds.  Where the
# stated pattern begins with a run of characters, a match can only begin at
# the run's start or at the end of the match before; saying so keeps the
# search linear in long runs.  Repeated groups are possessive: nothing follows
# them, and a run of any length needs no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")
BASE = KINDS[:4]

MENTION = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
CONTEXT = 64
ROUNDS = 3
MIN_SUPPORT = 5
MIN_SCORE = 0.75
#: MIN_SUPPORT seeds, even beside one instance that is none yet, make a trusted pattern.
PRIOR = 0.5

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """Base spans of each kind."""
    ip = lambda m: F.rlike(m, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    card = lambda m: F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
    phone = lambda m: F.length(_digits(m)).between(10, 15)
    has = lambda c: F.contains(text, F.lit(c))
    return [pattern_spans(text, "email", EMAIL, needs=has("@")), pattern_spans(text, "ip", IP, ip, has(".")),
            pattern_spans(text, "card", CARD, card), pattern_spans(text, "phone", PHONE, phone, has("+"))]


_MARKS = r"""^[^\p{L}\p{N}+@]+|[^\p{L}\p{N}]+$"""


def _word(piece: Column, pattern: str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(piece, pattern, 1), _MARKS, ""))


def mentions(text: Column, base: Column) -> Column:
    """Structs (start, end, instance, left, right, seed) of all words with a
    digit."""
    def of(ms: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            before = F.right(m["before"], F.lit(CONTEXT))
            after = F.substring(m["after"], 1, CONTEXT)
            # the word before may be a mention itself
            left = F.when(F.trim(F.translate(before, "\t\n\x0b\f\r", "     ")) != "", _word(before, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$")) \
                .otherwise(F.lit(""))
            right = _word(after, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)")
            return F.struct(
                m["start"].alias("start"), m["end"].alias("end"),
                F.regexp_replace(m["text"], _MARKS, "").alias("instance"), left.alias("left"), right.alias("right"),
                F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])).alias("seed"))
        return F.transform(ms, one)

    kind = "array<struct<start:bigint,end:bigint,instance:string,left:string,right:string,seed:boolean>>"
    return F.when(F.rlike(text, F.lit("[0-9]")), of(matches(text, MENTION))).otherwise(F.array().cast(kind))


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, _key (a hash of the text), the base
    spans of each kind, and mentions."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"))
    kinds = [s.alias(k) for s, k in zip(base_spans(F.col("text")), BASE)]
    rows = rows.select("doc_id", "text", *kinds)
    return rows.select("doc_id", F.unhex(F.md5("text")).alias("_key"), *BASE,
                       mentions(F.col("text"), F.concat(*BASE)).alias("mentions"))


def _patterns() -> Column:
    """The patterns of a mention."""
    left = F.when(F.col("left") != "", F.concat(F.lit("< "), F.col("left")))
    right = F.when(F.col("right") != "", F.concat(F.lit("> "), F.col("right")))
    return F.array_compact(F.array(left, right, F.concat(left, F.lit(" "), right)))


def trusted(mentioned: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR, min_support: int = MIN_SUPPORT,
            min_score: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """From mentions (instance, left, right, seed) the trusted patterns
    (pattern, score) and all instances (instance, score)."""
    links = cut(mentioned.select("instance", "seed", F.explode(F.array_distinct(_patterns())).alias("pattern"))
                .groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "links")
    seeds = links.groupBy("instance").agg(F.max("seed").alias("seed"))
    scores = cut(seeds.select("instance", "seed", F.col("seed").cast("double").alias("score")), "instances")
    for _ in range(rounds):
        # a pattern stands by its instances
        patterns = cut(links.join(scores.select("instance", "score"), "instance")
                       .groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + prior)).alias("score"),
                                               F.count(F.lit(1)).alias("support"))
                       .filter((F.col("support") >= min_support) & (F.col("score") >= min_score)), "patterns")
        # an instance by the trusted patterns that it stands in
        gained = (links.join(patterns.select("pattern", "score"), "pattern").groupBy("instance")
                  .agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("gained")))
        scores = cut(seeds.join(gained, "instance", "left").select(
            "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("gained", F.lit(0.0))).alias("score")), "instances")
    return patterns, scores


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, spans of each base kind, and the spans
    found by context."""
    rows = cut(extract(docs, doc_id, text), "extracted")
    mentioned = rows.select("doc_id", "_key", F.inline("mentions"))
    patterns, instances = trusted(mentioned.select("instance", "left", "right", "seed").distinct(), **options)
    good = cut(instances.filter(~F.col("seed") & (F.col("score") >= options.get("min_score", MIN_SCORE)))
               .select("instance"), "found")
    new = (mentioned.filter("not seed").join(good, "instance")
           .select("doc_id", "_key", "start", "end", F.explode(F.array_distinct(_patterns())).alias("pattern"))
           .join(patterns.select("pattern"), "pattern")
           .groupBy("doc_id", "_key").agg(F.collect_set(F.struct(
               F.lit("context").alias("kind"), "start", "end")).alias("context")))
    new = new.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "context")
    return (rows.join(cut(new, "context"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
            .select("doc_id", *BASE, F.coalesce("context", F.array().cast(NO_SPANS)).alias("context")))


def digest(found: DataFrame) -> DataFrame:
    """Counts and span texts of ``personal_data``'s rows."""
    base = F.concat(*BASE)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias("n_" + k) for k in BASE],
        F.sha2(span_text(base, KINDS), 256).alias("base_sha256"),
        span_text(F.concat(base, "context"), KINDS).alias("spans"))
