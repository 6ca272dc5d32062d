"""Language ID: a bidirectional gated recurrent network over bytes.

The bytes of a word (lower-cased A-Z, between two blanks) go through a GRU
from the left and one from the right; their states at each position give the
probabilities of the languages there.  A document's language has the largest
mean log-probability over all positions of all its words; ``score`` is the
mean probability of that language.

The state starts anew at each word, so a word's label sums depend on the word
alone: a worker remembers them for the words that it met (bounded, emptied
when full, no influence on results).  Words longer than ``MAX_BYTES`` are read
in parts of that length, so whole texts of any length are read in bounded
memory.

Training is backpropagation through time with Adam in numpy on the driver, on
words of at most ``TRAIN_DOCS`` documents a language and ``TRAIN_WORDS`` words
of each, taken evenly by a hash of the id.  Only ``text`` and ``lang`` of the
given labelled rows are read; rows without a language, and rows whose text is
null, are no examples.

A null text, or one without a letter, is ``und`` with score 0; so is every
text if nothing was learned.  Rows are judged one by one, so repeated rows
get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, ship_package

TRAIN_DOCS = 800
TRAIN_WORDS = 60
MAX_BYTES = 40
CACHE_WORDS = 250_000

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Marks say nothing about a language; they part words as blanks do.
_NO_MARKS = bytes.maketrans(b".,;:!?*$%&#|\"()", b" " * 15)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


@dataclass
class Network:
    """Weights by name, for two directions d in (f, b): ``Ed`` (256, 3H) input
    of each byte, ``Ud`` (H, 2H) gates, ``Vd`` (H, H) candidate; ``W`` (2H, L)
    and ``c`` (L) labels."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    def __post_init__(self):
        self.known = _Known()

    def __getstate__(self):
        return {"languages": self.languages, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.known = _Known()

    @property
    def hidden(self) -> int:
        return self.weights["Vf"].shape[0]

    def states(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """GRU states (T, N, H) of byte sequences ``x`` (T, N); a state stays
        where the mask is 0."""
        w, H = self.weights, self.hidden
        h = np.zeros((x.shape[1], H), np.float32)
        out = np.empty((*x.shape, H), np.float32)
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in steps:
            e = w["E" + d][x[t]]
            g = _sigmoid(e[:, :2 * H] + h @ w["U" + d])
            z, r = g[:, :H], g[:, H:]
            n = np.tanh(e[:, 2 * H:] + (r * h) @ w["V" + d])
            m = mask[t][:, None]
            new = h + m * z * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n))
            out[t] = h = new
        return out

    def log_probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(T, N, L) for every position."""
        w = self.weights
        logits = (self.states(x, mask, "f") @ w["W"][:self.hidden] + self.states(x, mask, "b") @ w["W"][self.hidden:]
                  + w["c"])
        top = logits.max(-1, keepdims=True)
        return logits - top - np.log(np.exp(logits - top).sum(-1, keepdims=True))

    def word_sums(self, words: Sequence[bytes]) -> np.ndarray:
        """For each word the sums over its positions of log-probabilities and
        of probabilities, and the number of positions: (N, 2L + 1)."""
        L = len(self.languages)
        out = np.zeros((len(words), 2 * L + 1), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for start in range(0, len(order), 1024):
            part = order[start:start + 1024]
            x, mask = _padded([words[i] for i in part])
            lp = self.log_probabilities(x, mask)
            lp_mask = mask[:, :, None]
            out[part, :L] = (lp * lp_mask).sum(0)
            out[part, L:2 * L] = (np.exp(lp) * lp_mask).sum(0)
            out[part, 2 * L] = mask.sum(0)
        return out

    def classify(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each whole text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        split = [_words(t) for t in texts]
        coded = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in split]
        self.known.learn(self)
        L = len(self.languages)
        names, scores = [], []
        for text, codes in zip(texts, coded):
            if not len(codes) or not _LETTER.search(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = np.zeros(2 * L + 1)
            for i in range(0, len(codes), 4096):
                total += self.known.sums[codes[i:i + 4096]].sum(0, dtype=np.float64)
            best = int(total[:L].argmax())
            names.append(self.languages[best])
            scores.append(min(1.0, float(total[L + best] / total[2 * L])))
        return names, scores


class _Known(dict):
    """Numbers words in the order of their first use; ``sums`` has the label
    sums of each, once learned."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.sums: np.ndarray | None = None

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def clear(self) -> None:
        super().clear()
        self.new = []

    def learn(self, net: Network) -> None:
        if not self.new:
            return
        if self.sums is None:
            self.sums = np.zeros((1 << 14, 2 * len(net.languages) + 1), np.float32)
        while len(self) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[len(self) - len(self.new):len(self)] = net.word_sums(self.new)
        self.new = []


def _words(text: str | None) -> list[bytes]:
    """The words' bytes without common marks, long ones in parts."""
    words = (text or "").encode("utf-8", "replace").lower().translate(_NO_MARKS).split()
    if words and max(map(len, words)) > MAX_BYTES:
        words = [w[i:i + MAX_BYTES] for w in words for i in range(0, len(w), MAX_BYTES)]
    return words


def _padded(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte sequences as (T, N), a blank at both ends, and where they are."""
    lengths = np.array([len(w) for w in words]) + 2
    T = int(lengths.max(initial=2))
    x = np.frombuffer(b"".join((b" " + w).ljust(T) for w in words), np.uint8).reshape(len(words), T).T
    mask = (np.arange(T)[:, None] < lengths).astype(np.float32)
    return np.ascontiguousarray(x), mask


def new_network(languages: Sequence[str], hidden: int, rng: np.random.Generator) -> Network:
    w = {}
    for d in "fb":
        w["E" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        w["U" + d] = rng.normal(0, hidden ** -0.5, (hidden, 2 * hidden)).astype(np.float32)
        w["V" + d] = rng.normal(0, hidden ** -0.5, (hidden, hidden)).astype(np.float32)
    w["W"] = rng.normal(0, hidden ** -0.5, (2 * hidden, len(languages))).astype(np.float32)
    w["c"] = np.zeros(len(languages), np.float32)
    return Network(list(languages), w)


def gradients(net: Network, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions, each labelled with its word's
    language, and its gradients by backpropagation through time."""
    w, H = net.weights, net.hidden
    kept = {d: [] for d in "fb"}
    h = {d: net.states(x, mask, d, kept[d]) for d in "fb"}
    logits = h["f"] @ w["W"][:H] + h["b"] @ w["W"][H:] + w["c"]
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    N, total = x.shape[1], mask.sum()
    right = p[:, np.arange(N), label]
    loss = float(-(np.log(right + 1e-12) * mask).sum() / total)
    p[:, np.arange(N), label] -= 1.0
    dlogits = p * (mask / total)[:, :, None]
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["W"][:H] = np.einsum("tnh,tnl->hl", h["f"], dlogits)
    grads["W"][H:] = np.einsum("tnh,tnl->hl", h["b"], dlogits)
    grads["c"] = dlogits.sum((0, 1))
    for d, own in (("f", w["W"][:H]), ("b", w["W"][H:])):
        back = np.zeros((N, H), np.float32)
        for t, before, z, r, n in reversed(kept[d]):
            m = mask[t][:, None]
            dh = back + dlogits[t] @ own.T
            dz = dh * m * (n - before) * z * (1 - z)
            dn = dh * m * z * (1 - n * n)
            drh = dn @ w["V" + d].T
            dr = drh * before * r * (1 - r)
            dg = np.concatenate([dz, dr], 1)
            grads["V" + d] += (r * before).T @ dn
            grads["U" + d] += before.T @ dg
            np.add.at(grads["E" + d], x[t], np.concatenate([dg, dn], 1))
            back = dh * (1 - m * z) + drh * r + dg @ w["U" + d].T
    return loss, grads


def train(words: Sequence[bytes], labels: Sequence[str], hidden: int = 16, steps: int = 300, batch: int = 256,
          rate: float = 0.02, seed: int = 7) -> Network:
    """Fit a network to words and their languages."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = new_network(languages, hidden, rng)
    if len(languages) < 2:
        return net
    index = {name: i for i, name in enumerate(languages)}
    y = np.array([index[name] for name in labels])
    of = [np.flatnonzero(y == k) for k in range(len(languages))]
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, -(-batch // len(of))) for rows in of])
        x, mask = _padded([words[i] for i in pick])
        _, grads = gradients(net, x, mask, y[pick])
        lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] -= (lr * (first[k] / (1 - 0.9 ** step))
                               / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS,
        words: int = TRAIN_WORDS, **options) -> Network:
    """Train on a bounded sample of ``labelled``: about ``per_language``
    documents of each language, by a hash of the key (of the text, where the
    key is null), ``words`` words each from a place that the hash picks."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # a row per language, as many as the network has outputs
    counts = rows.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return train([], [], **options)
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r.l, per_language / r.n)])
    mark = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))).otherwise(F.xxhash64(F.col(text)))
    share = F.pmod(mark, F.lit(1 << 20)) / F.lit(float(1 << 20))
    parts = F.split(F.trim(F.col(text)), r"[\x20\x09-\x0D]+")
    at = (F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.greatest(F.size(parts) - words, F.lit(1))) + 1).cast("int")
    # rows of one key, or copies without a key, are one example
    sample = (rows.filter(share < F.element_at(rates, F.col(lang)))
              .groupBy(F.col(lang).alias("l"), mark.alias("h")).agg(F.min(F.slice(parts, at, words)).alias("w")))
    picked = sorted((r.l, r.h, r.w) for r in sample.collect())
    pairs = [(w, name) for name, _, chosen in picked for w in _words(" ".join(chosen))]
    return train([w for w, _ in pairs], [name for _, name in pairs], **options)


def language(net: Network, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    box = net

    @F.pandas_udf("lang_pred string, score double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        model = _worker_network(box)
        names, scores = [], []
        values = texts.tolist()
        for i in range(0, len(values), 500):
            n, s = model.classify(values[i:i + 500])
            names += n
            scores += s
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return classify(text)


_NETWORKS: dict[bytes, Network] = {}


def _worker_network(net: Network) -> Network:
    """The same network object for all tasks of a worker process, so that its
    memory of words lasts."""
    hold("langid", _NETWORKS.clear)
    key = b"".join(net.weights[k].tobytes() for k in sorted(net.weights))
    if key not in _NETWORKS:
        _NETWORKS.clear()
        _NETWORKS[key] = net
    return _NETWORKS[key]


def identify(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    ship_package(docs.sparkSession)
    # not moved below a filter or run twice for its two fields
    return (docs.withColumn("__lang", language(net, F.col(text)))
            .select(*[F.col(f"`{c}`") for c in docs.columns], "__lang.lang_pred", "__lang.score"))
