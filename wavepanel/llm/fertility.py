"""Quality rule: tokeniser fertility.

Two public vocabularies read the words of each whole text.  A text that is
far from what a vocabulary was made for needs many tokens for its characters,
falls back to bytes, or repeats few tokens.  Measured per document, words
encoded one by one:

- chars_per_token: code points of words per token of the piece vocabulary
- chars_per_token_multi: the same for the multilingual byte vocabulary
- byte_share: share of byte-fallback tokens in the piece vocabulary
- entropy: bits per token of the document's distribution of piece tokens

A document is rejected if a plain count fails (``base_failed``), or if a
measure lies outside the band of its script (``BANDS``; the script that most
of its letters have) or outside the band learned for its language: with
labels, the quantiles of all clean labelled documents that pass the counts
(``FLOOR``, ``TAIL``; of its script if its language has fewer than
``MIN_CLEAN``).  They come from counts by thousandths, so they are the same in
every run and the counts don't grow with the corpus.

The words are numbered by a dictionary per worker of bounded size (emptied
when full, which changes no result); everything else is array arithmetic on
these numbers, a document at a time, so memory follows the longest document.

A null or empty text has no words: all counts 0, measures null, failed.
Rows are judged one by one, so repeated rows get equal results and an empty
table gives none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hold, ship_package

#: Words that a worker remembers.
CACHE_WORDS = 300_000

SYMBOLS = b"#*$%&|<>"

# First and last code point of the blocks by which a letter's
# script is told.
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0E00, 0x0E7F, "thai"), (0x1E00, 0x1EFF, "latin"),
    (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]

#: Per script: (least, most) of each measure; other scripts have the last band.
BANDS: dict[str, dict[str, tuple[float, float]]] = {
    "latin": {"chars_per_token": (1.45, 8.0), "chars_per_token_multi": (1.2, 9.0), "byte_share": (0.0, 0.10),
              "entropy": (3.0, 15.0)},
    "greek": {"chars_per_token": (0.6, 6.0), "chars_per_token_multi": (0.4, 7.0), "byte_share": (0.0, 0.30),
              "entropy": (3.0, 15.0)},
    "cyrillic": {"chars_per_token": (1.0, 7.0), "chars_per_token_multi": (0.6, 8.0), "byte_share": (0.0, 0.20),
                 "entropy": (3.0, 15.0)},
    "other": {"chars_per_token": (0.2, 8.0), "chars_per_token_multi": (0.2, 9.0), "byte_share": (0.0, 0.95),
              "entropy": (2.0, 15.0)},
}

MEASURES = ("chars_per_token", "chars_per_token_multi", "byte_share", "entropy")
#: Share of clean documents below the learned floor of chars_per_token_multi,
#: and outside each other end of a learned band.
FLOOR, TAIL = 0.01, 0.001
#: Clean documents that a language's or a script's own band needs.
MIN_CLEAN = 100

_FIRST = np.array([s[0] for s in SCRIPTS])
_LAST = np.array([s[1] for s in SCRIPTS])

_NAMES = [s[2] for s in SCRIPTS]


def script_of(text: str) -> str:
    """The script of most letters; ``none`` without a letter of a known block.
    Of equal counts the one listed first."""
    if text.isascii():
        points = np.frombuffer(text.encode(), np.uint8)
        return "latin" if ((points | 32) - 97 < 26).any() else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[(points > 0x7A) | ((points | 32) - 97 < 26)]
    block = np.searchsorted(_FIRST, points, "right") - 1
    inside = (block >= 0) & (points <= _LAST[block])
    counts = np.bincount(block[inside], minlength=len(SCRIPTS))
    by_script: dict[str, int] = {}
    for name, n in zip(_NAMES, counts.tolist()):
        by_script[name] = by_script.get(name, 0) + n
    best = max(by_script, key=by_script.get)
    return best if by_script[best] else "none"


class _Numbers(dict):
    """Numbers words in the order of their first use; ``new`` holds those not
    yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class _Column:
    """A growing array."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, values) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(end, len(self.data)), self.data.dtype)])
        self.data[self.n:end] = values
        self.n = end


class Meter:
    def __init__(self, piece_path: str, multi_path: str, multi_pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(multi_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.multi = tiktoken.Encoding("multi", pat_str=multi_pattern, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.reset()

    def reset(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.first = _Column(np.uint16), _Column(np.int64)
        self.n_ids, self.n_bytes, self.n_multi = _Column(np.int32), _Column(np.int32), _Column(np.int32)

    def _learn(self) -> None:
        words = [w.decode("utf-8", "replace") for w in self.numbers.new]
        self.numbers.new = []
        encoded = self.pieces.encode(words, num_threads=1)
        lengths = np.fromiter(map(len, encoded), np.int32, len(words))
        ids = np.fromiter(chain.from_iterable(encoded), np.uint16, int(lengths.sum()))
        of_word = np.repeat(np.arange(len(words)), lengths)
        self.first.extend(self.ids.n + np.cumsum(lengths) - lengths)
        self.ids.extend(ids)
        self.n_ids.extend(lengths)
        self.n_bytes.extend(np.bincount(of_word[self.is_byte[ids]], minlength=len(words)))
        self.n_multi.extend(np.fromiter(map(len, map(self.multi.encode_ordinary, words)), np.int32, len(words)))

    def measure(self, text: str | None) -> dict:
        """Counts and measures of one whole text."""
        text = text or ""
        data = text.encode("utf-8", "replace")
        words = data.split()
        if len(self.numbers) > CACHE_WORDS:
            self.reset()
        codes = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.new:
            self._learn()
        n_bytes = sum(map(len, words))
        lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else []
        out = {
            "n_words": len(words), "word_chars": len(text) - (len(data) - n_bytes),
            "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(codes),
            "script": script_of(text), "chars_per_token": None, "chars_per_token_multi": None, "byte_share": None,
            "entropy": None,
        }
        if words:
            word, times = np.unique(codes, return_counts=True)
            lengths = self.n_ids.data[word]
            n = int((lengths * times).sum())
            starts = self.first.data[word] - (np.cumsum(lengths) - lengths)
            ids = self.ids.data[np.repeat(starts, lengths) + np.arange(int(lengths.sum()))]
            counts = np.bincount(ids, weights=np.repeat(times, lengths))
            share = counts[counts > 0] / max(n, 1)
            out["chars_per_token"] = out["word_chars"] / max(n, 1)
            out["chars_per_token_multi"] = out["word_chars"] / max(int((self.n_multi.data[word] * times).sum()), 1)
            out["byte_share"] = float((self.n_bytes.data[word] * times).sum() / max(n, 1))
            out["entropy"] = float(-(share * np.log2(share)).sum()) + 0.0
        return out


def repeated_words(codes: np.ndarray, window: int = 3) -> int:
    """Number of words inside windows that occur twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    k = int(codes.max()) + 1
    if k < 1 << 20:
        key = (codes[:n] * k + codes[1:n + 1]) * k + codes[2:]
    else:
        pair = np.unique(codes[:n] * k + codes[1:n + 1], return_inverse=True)[1]
        key = pair * k + codes[2:]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[at] > 1)
    covered = np.zeros(len(codes), bool)
    for i in range(window):
        covered[again + i] = True
    return int(covered.sum())


_METERS: dict[tuple, Meter] = {}


def base_failed(m: Mapping) -> bool:
    return m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]


def in_bands(m: Mapping, bands: Mapping) -> bool:
    band = bands.get(m["script"], bands["other"])
    return all(low <= m[k] <= high for k, (low, high) in band.items())


def learned_bands(clean: DataFrame) -> DataFrame:
    """From clean documents (script, _lang, measures) a row per script and
    language, and one per script with an empty language: _script, _of, and
    _bands with a struct (low, high) per measure."""
    thousandths = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col(k) * 1000).alias("b")) for k in MEASURES])
    counts = (clean.select("script", F.explode(F.array_distinct(F.array("_lang", F.lit("")))).alias("_of"), *MEASURES)
              .select("script", "_of", F.inline(thousandths)).groupBy("script", "_of", "k", "b").agg(F.count(F.lit(1)).alias("n")))
    whole = Window.partitionBy("script", "_of", "k")
    counts = counts.withColumn("_sum", F.sum("n").over(whole.orderBy("b"))).withColumn("_all", F.sum("n").over(whole))
    floor = F.when(F.col("k") == "chars_per_token_multi", FLOOR).otherwise(TAIL)
    ends = (counts.filter(F.col("_all") >= MIN_CLEAN).groupBy("script", "_of", "k").agg(
        (F.min(F.when(F.col("_sum") > floor * F.col("_all"), F.col("b"))) / 1000).alias("low"),
        (F.min(F.when(F.col("_sum") >= (1 - TAIL) * F.col("_all"), F.col("b") + 1)) / 1000).alias("high")))
    return ends.groupBy(F.col("script").alias("_script"), "_of").agg(F.struct(*[
        F.max(F.when(F.col("k") == k, F.struct("low", "high"))).alias(k) for k in MEASURES]).alias("_bands"))


_RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, script string, chars_per_token double, chars_per_token_multi double, "
           "byte_share double, entropy double")


def judge(docs: DataFrame, piece_path: str, multi_path: str, multi_pattern: str, doc_id: str = "doc_id",
          text: str = "text", bands: Mapping[str, Mapping[str, tuple[float, float]]] = BANDS,
          labels: DataFrame | None = None, lang: str = "lang") -> DataFrame:
    """One row per document: the counts, base_failed, kept, and the measures.
    With ``labels`` (doc_id, quality; 1 is clean) bands are learned too; the
    texts are read once."""
    ship_package(docs.sparkSession)
    key = (piece_path, multi_path, multi_pattern)
    names = [c.split()[0] for c in _RESULT.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([*[(c.split()[0], kinds[c.split()[1]]) for c in _RESULT.split(", ")], ("_lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("fertility", _METERS.clear)
        if key not in _METERS:
            _METERS[key] = Meter(*key)
        meter = _METERS[key]
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = meter.measure(t.as_py())
                failed = base_failed(m)
                rows.append({"doc_id": i, "base_failed": failed, "kept": not failed and in_bands(m, bands), **m})
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[c] for r in rows], schema.field(c).type) for c in names], batch.column(2)], schema=schema)

    of = F.lit("") if labels is None else F.coalesce(F.col(lang), F.lit(""))
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), of.cast("string").alias("_lang"))
    found = found.mapInArrow(run, _RESULT + ", _lang string")
    if labels is None:
        return found.drop("_lang")
    found = cut(found, "measured")
    clean = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality")).filter("_quality = 1")
    learned = cut(learned_bands(found.filter("not base_failed").join(clean, F.col("doc_id") == F.col("_id"), "left_semi")), "bands")
    of_script = learned.filter("_of = ''").select(F.col("_script").alias("_s"), F.col("_bands").alias("_wide"))
    rows = (found.join(F.broadcast(learned), (F.col("script") == F.col("_script")) & (F.col("_lang") == F.col("_of")), "left")
            .join(F.broadcast(of_script), F.col("script") == F.col("_s"), "left"))
    band = F.coalesce("_bands", "_wide")
    inside = F.lit(True)
    for k in MEASURES:
        inside = inside & F.coalesce(F.col(k).between(band[k]["low"], band[k]["high"]), F.lit(True))
    return rows.withColumn("kept", F.col("kept") & inside).select(*names)
