"""URL filter: rules on hosts and paths, then words of the host.

Names of hosts are words written together.  They are segmented by a unigram
model: the split with the largest product of word probabilities, found by
Viterbi.  Multinomial naive Bayes then scores the words of host and path.

1. Host and path are cut out of each url; rules on them decide first, the
   longest that fits.
2. Words are counted over the words of all page titles and the labelled
   examples (which count ``LEXICON_WEIGHT`` times): a plain aggregate.
3. Each distinct letter run of a host gives its substrings of up to
   ``MAX_WORD`` letters; a join with the counts leaves the known words, and
   Viterbi goes once along the run.  So neither the vocabulary nor the hosts
   need fit in one place, and each run is segmented once.
4. Naive Bayes is trained on the labelled examples (a fixed, small table:
   broadcast by nature) and scores each url from its host's words and its
   path's tokens.

A null url, or one without ``://``, has an empty host and path; with no words
it is allowed.  Repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, ship_package

MAX_WORD = 16
LEXICON_WEIGHT = 50
ALPHA = 0.5
#: Log-odds from which a url is blocked: of steps of a quarter the one with the
#: most right verdicts on the labelled examples, each left out in turn.
BLOCK_AT = 0.75

# Rules as (verdict, host, path).
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]

# Labelled examples for naive Bayes, written as their words.
EXAMPLES = [
    ("block", "adult x videos"), ("block", "free adult cams"), ("block", "xxx porn tube"), ("block", "hot sex chat"),
    ("block", "adult dating x"), ("block", "nude cams live"), ("block", "free bets casino"), ("block", "sports bets bonus"),
    ("block", "online casino slots"), ("block", "poker bets jackpot"), ("block", "free spins casino bonus"),
    ("block", "cheap pills pharmacy"), ("block", "buy viagra online"), ("block", "free download crack keygen"),
    ("block", "warez torrent free"), ("block", "escort adult sex"), ("block", "betting odds free bets"),
    ("block", "payday loans fast cash"), ("block", "replica watches cheap"), ("block", "win money lottery"),
    ("allow", "news daily world"), ("allow", "blog science"), ("allow", "city library"), ("allow", "school of music"),
    ("allow", "health and care"), ("allow", "travel guide"), ("allow", "open data wiki"), ("allow", "garden and home"),
    ("allow", "weather today"), ("allow", "history museum"), ("allow", "the book shop"), ("allow", "university press"),
    ("allow", "photo blog"), ("allow", "food and recipes"), ("allow", "local sports club"), ("allow", "software docs"),
    ("allow", "forum help"),
    ("block", "spam links"), ("block", "link farm seo"), ("block", "spam mail offers"), ("block", "click ads banner"),
    ("block", "popup ads network"), ("block", "ads tracker click"), ("block", "track clicks pixel"), ("block", "casino win jackpot"),
    ("block", "win prizes free"), ("block", "cheap meds pills"), ("block", "diet pills discount"), ("block", "adult webcams"),
    ("block", "porn videos free"), ("block", "phishing login verify"), ("block", "malware download"), ("block", "roulette betting"),
    ("block", "blackjack casino"), ("block", "loans no credit check"), ("block", "fake luxury watches"), ("block", "sexy girls chat"),
    ("allow", "farm shop local"), ("allow", "running track club"), ("allow", "free software downloads"), ("allow", "video lessons"),
    ("allow", "adult education school"), ("allow", "online course"), ("allow", "cheap travel tips"), ("allow", "music chat forum"),
    ("allow", "watches repair shop"), ("allow", "credit union bank"), ("allow", "mail help"), ("allow", "network engineering"),
    ("allow", "science journal"), ("allow", "city council news"), ("allow", "garden farm"), ("allow", "recipes kitchen"),
    ("allow", "book review"), ("allow", "public health info"), ("allow", "games wiki"), ("allow", "research papers archive"),
]

# Words that any host or path may have; they are not scored.
FURNITURE = {"www", "m", "blog", "example", "html", "index", "and", "of", "the", "no"}

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_RUN = re.compile("[a-z]+")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = tuple(RULES)) -> tuple[Column, Column]:
    """The longest rule that fits (written ``host/path``) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, examples: Sequence[tuple[str, str]], html: str = "html") -> DataFrame:
    """(word, n): how often each word of ``a-z`` occurs in page titles, plus
    the words of the labelled examples."""
    title = F.lower(F.regexp_extract(F.col(html), r"(?is)<title[^>]*>([^<]*)", 1))
    seen = (pages.select(F.explode(F.regexp_extract_all(title, F.lit("[a-z]+"), F.lit(0))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    known = Counter(w for _, text in examples for w in text.split())
    lexicon = pages.sparkSession.createDataFrame(
        sorted((w, n * LEXICON_WEIGHT) for w, n in known.items()), "word string, n long")
    return seen.unionByName(lexicon).groupBy("word").agg(F.sum("n").alias("n"))


def segment(run: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """Viterbi: the split of ``run`` with the largest sum of log-probabilities.
    ``known``: that of the word at (start, length); a letter string that is no
    word costs ``unknown`` and ln 10 more a letter.  Of equal splits the one
    with the shorter last word."""
    best, last = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(end - 1, max(-1, end - MAX_WORD - 1), -1):
            p = known.get((start, end - start), unknown - math.log(10) * (end - start))
            if best[start] + p > best[end]:
                best[end], last[end] = best[start] + p, start
    words, end = [], len(run)
    while end:
        words.append(run[last[end]:end])
        end = last[end]
    return words[::-1]


def _segment_rows(total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = math.log(1.0 / (total + 1))
        for batch in batches:
            runs = batch.column(0).to_pylist()
            words = []
            for text, found in zip(runs, batch.column(1).to_pylist()):
                known = {(f["start"], f["len"]): math.log(f["n"] / total) for f in found or []}
                words.append(segment(text, known, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return run


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) for a table of distinct letter runs."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = F.sequence(F.lit(0), F.length("run") - 1)
    parts = runs.select("run", F.explode(starts).alias("start")).select(
        "run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("run") - F.col("start")))).alias("len"))
    words = parts.withColumn("word", F.substring("run", F.col("start") + 1, F.col("len")))
    known = (words.join(counts, "word").groupBy("run")
             .agg(F.collect_list(F.struct("start", "len", "n")).alias("found")))
    return runs.join(known, "run", "left").select("run", "found").mapInArrow(
        _segment_rows(float(max(total, 1))), "run string, words array<string>")


def naive_bayes(examples: Sequence[tuple[str, str]], alpha: float = ALPHA) -> dict[str, float]:
    """log P(word | block) - log P(word | allow) of each example word that is
    not furniture."""
    of = {k: Counter(w for v, text in examples if v == k for w in text.split() if w not in FURNITURE)
          for k in ("block", "allow")}
    words = sorted(set(of["block"]) | set(of["allow"]))
    size = {k: sum(c.values()) + alpha * len(words) for k, c in of.items()}
    return {w: math.log((of["block"][w] + alpha) / size["block"]) - math.log((of["allow"][w] + alpha) / size["allow"])
            for w in words}


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                rules: Sequence[tuple[str, str, str]] = tuple(RULES), examples: Sequence[tuple[str, str]] = tuple(EXAMPLES),
                block_at: float = BLOCK_AT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (log-odds
    of the words), words (of the host)."""
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    counts = cut(word_counts(pages, examples, html), "words")

    runs_of = lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))
    hosts = rows.select("host").distinct()
    host_runs = cut(hosts.select("host", F.posexplode(runs_of(F.col("host"))).alias("pos", "run")), "runs")
    of_run = segmented(host_runs.select("run").distinct(), counts)
    host_words = cut(host_runs.join(of_run, "run").groupBy("host").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda s: s["words"])).alias("words")), "hosts")

    ratios = naive_bayes(examples)
    prior = math.log(sum(v == "block" for v, _ in examples) / max(1, sum(v == "allow" for v, _ in examples)) or 1.0)
    model = F.create_map(*[F.lit(x) for pair in sorted(ratios.items()) for x in pair])
    tokens = F.concat(F.coalesce("words", F.array().cast("array<string>")),
                      runs_of(F.translate(F.col("path"), UPPER, LOWER)))
    score = F.aggregate(tokens, F.lit(prior), lambda a, t: a + F.coalesce(F.try_element_at(model, t), F.lit(0.0)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (rows.join(host_words, "host", "left")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(score >= block_at, "block").otherwise("allow")).alias("verdict"),
                    score.alias("score"), F.coalesce("words", F.array().cast("array<string>")).alias("words")))
