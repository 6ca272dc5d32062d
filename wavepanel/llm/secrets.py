"""Secret scan: fixed patterns, and character Markov models that tell random
strings from ordinary ones.

Patterns give the base spans.  For everything else, two first-order Markov
models over the characters of ``ALPHABET`` are trained, one on random strings
and one on ordinary words and identifiers.  A candidate (a run of
``MIN_CHARS`` or more such characters) is a secret if its log-likelihood ratio
per character reaches ``THRESHOLD``; it is added where it meets no base span.

Training: labelled samples are a table (text, random).  The default table has
random strings of the usual kinds (hexadecimal, base64, upper case and
digits), made from hashes of row numbers, and words of about
``TRAIN_DOCS`` documents, taken by a hash, ``TRAIN_WORDS`` words of each; words with a digit
are left out of these, as they may be secrets.  Counting pairs of characters
is one aggregate; the model is one array of log-ratios (alphabet squared),
put into the scan as a scalar.

The scan reads each row alone, without a shuffle or a join, with built-in
functions only.  Null text counts as empty.  Spans are in code points, end
exclusive.  Rows that repeat get equal results; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pattern_spans, span_text

# The base patterns, in the order of their kinds.
ASSIGN = (r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
MIN_CHARS = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.4
TRAIN_DOCS = 2000
TRAIN_WORDS = 300
TRAIN_RANDOM = 3000


def labelled_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The default (text, random) samples."""
    spark = docs.sparkSession
    n = F.col("id").cast("string")
    made = spark.range(TRAIN_RANDOM, numPartitions=1).select(F.explode(F.array(
        F.sha1(n), F.base64(F.unhex(F.sha2(n, 256))),
        F.concat(F.lit("AK"), F.upper(F.translate(F.substring(F.base64(F.unhex(F.sha1(n))), 1, 20), "+/=", ""))),
        F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(n, F.lit("x")), 384))), "+/", "-_"), 1, 40),
    )).alias("text"), F.lit(True).alias("random"))
    # about TRAIN_DOCS rows by a hash; nothing is sorted or gathered for it
    rows = docs.agg(F.count(F.lit(1)).alias("n")).select(F.greatest("n", F.lit(1)).alias("n")).scalar()
    place = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = docs.filter(F.col(text).isNotNull() & (place < F.lit(float(TRAIN_DOCS)) / rows)).select(F.slice(
        F.regexp_extract_all(F.substring(F.col(text), 1, 20 * TRAIN_WORDS), F.lit(r"[A-Za-z_-]{3,}"), F.lit(0)),
        1, TRAIN_WORDS).alias("w"))
    return made.unionByName(sample.select(F.explode("w").alias("text"), F.lit(False).alias("random")))


def _code(char: Column) -> Column:
    """1 to len(ALPHABET); 0 for a character outside."""
    return F.instr(F.lit(ALPHABET), char)


def log_ratios(samples: DataFrame) -> Column:
    """The model as a scalar: for characters a, b at place a * (n + 1) + b the
    log of P(b | a) among random strings over P(b | a) among ordinary ones,
    with add-half smoothing; a = 0 is the start."""
    n = len(ALPHABET)
    places = F.sequence(F.lit(1), F.length("text"))
    pairs = samples.filter(F.length("text") > 0).select("random", F.explode(F.transform(places, lambda i: F.struct(
        F.when(i == 1, 0).otherwise(F.instr(F.lit(ALPHABET), F.substring("text", i - 1, F.lit(1)))).alias("a"),
        _code(F.substring("text", i, F.lit(1))).alias("b")))).alias("p")).select("random", "p.a", "p.b").filter("b > 0")
    counts = pairs.groupBy("a", "b").agg(F.sum(F.col("random").cast("long")).alias("r"),
                                         F.sum((~F.col("random")).cast("long")).alias("o"))
    every = samples.sparkSession.range((n + 1) * (n + 1), numPartitions=1).select(
        F.floor(F.col("id") / (n + 1)).cast("int").alias("a"), (F.col("id") % (n + 1)).cast("int").alias("b"))
    whole = every.join(counts, ["a", "b"], "left").fillna(0, ["r", "o"])
    sums = whole.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    ratio = F.log(((F.col("r") + 0.5) / (F.col("ra") + 0.5 * n)) / ((F.col("o") + 0.5) / (F.col("oa") + 0.5 * n)))
    model = (whole.join(sums, "a").select("a", "b", ratio.alias("x"))
             .groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "x"))), lambda s: s["x"]).alias("m")))
    return cut(model, "markov").scalar()


def _score(token: Column, model: Column) -> Column:
    """Log-likelihood ratio per character, in time linear in the token."""
    n = len(ALPHABET) + 1
    walk = F.aggregate(F.split(token, ""), F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum")),
                       lambda acc, c: _step(acc, _code(c), model, n))
    return walk["sum"] / F.length(token)


def _step(acc: Column, b: Column, model: Column, n: int) -> Column:
    return F.struct(b.alias("a"), (acc["sum"] + F.get(model, acc["a"] * n + b)).alias("sum"))


def base_spans(text: Column) -> list[Column]:
    """Base spans of each kind.  ``AKIA`` and hexadecimal runs are matched
    whole, so asking for their least length in the pattern drops the same."""
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    return [pattern_spans(text, "assign", ASSIGN, long_value, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))),
            pattern_spans(text, "access", ACCESS, needs=F.contains(text, F.lit("AKIA"))), pattern_spans(text, "hex", HEX)]


def scan(docs: DataFrame, model: Column, doc_id: str = "doc_id", text: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the base spans of each kind (assign,
    access, hex) and the spans that the models add (markov)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       model.alias("model"))
    assign, access, hexa = base_spans(F.col("text"))
    rows = rows.select(
        "doc_id", assign.alias("assign"), access.alias("access"), hexa.alias("hex"),
        pattern_spans(F.col("text"), "markov", CANDIDATE, lambda m: _score(m, F.col("model")) >= threshold).alias("markov"))
    base = F.concat("assign", "access", "hex")
    free = F.filter("markov", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "assign", "access", "hex", free.alias("markov"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and span texts of ``scan``'s rows."""
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias("n_" + k) for k in ("assign", "access", "hex")],
        F.sha2(span_text(base, KINDS), 256).alias("base_sha256"),
        span_text(F.concat(base, "markov"), KINDS).alias("spans"))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the default samples and scan."""
    return scan(docs, log_ratios(labelled_samples(docs, doc_id, text)), doc_id, text)
