"""Scores of whole texts by a gated recurrent language model.

Texts are lower-cased (A-Z); their tokens are words (runs of characters other
than space and tab..carriage return) and one end.  The model gives
``P(token | all tokens before)`` as ``P(class) * P(token | class)``: the most
frequent ``LM_WORDS`` words of the training texts, in the order of their
counts, form classes of ``CLASS`` words; one more class has all other words.
Both softmaxes read the state of a GRU; inside the class of other words a
word weighs its count + 1, and all unseen words together weigh 1.  So the
probabilities of the known words and of one unseen word sum to 1.

* Counts: all words of all texts, partial sums in the tasks, then by word.
  The words above a count (at most ``HEAD`` of them, by a histogram of
  counts) are broadcast; tokens of other words go through a join with the
  counts.  Words that occur often anywhere are among the broadcast ones, so
  the join has no hot key.
* Training: biases start at the counts of all training texts.  In each of
  ``ROUNDS`` rounds every task trains its own copy with Adam on segments of
  ``SEGMENT`` tokens, its round's share of all segments of all training
  texts, by a hash of key and place: the rounds together train on every
  segment, each once.  Gradients go back through a window of ``WINDOW``
  tokens, the state runs on through the segment.  The copies are averaged by
  tokens, in a tree of tasks.
* Scoring: documents run side by side in lanes, one after the other; the
  state is carried across windows to a document's end, so the score is that
  of the complete text, in memory that does not depend on its length.

A null text is empty: its only token is the end.  Without training texts all
words are unseen.  A null key counts as training.  Repeated rows are counted,
trained on and scored as rows of their own.  Only the named columns are read.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship_package

HEAD = 1 << 18
LM_WORDS = 1024
CLASS = 32
HIDDEN = 16
WINDOW, SEGMENT = 32, 128
ROUNDS = 2
#: Lanes in training and in scoring.
TRAIN_LANES, LANES = 256, 512
#: Bytes of text that a task splits into words at once.
TEXT = 16 << 20
#: Tokens whose softmax is computed at once.
STRETCH = 4096
#: Copies averaged by one task.
FAN = 32

#: The end of a text as a token; words have no space.
END = " "
_PADDED = -1e4


class Room:
    """Arrays by name, used again: fresh memory costs more than the sums."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype=np.float32) -> np.ndarray:
        size, held = math.prod(shape), self.held.get(name)
        if held is None or held.size < size or held.dtype != dtype:
            held = self.held[name] = np.empty(size, dtype)
        return held[:size].reshape(shape)


class Model:
    """Weights by name: ``E`` (K + 2, 3H) gate inputs of each token (K: other
    words, K + 1: the start), ``U`` (H, 2H) gates, ``V`` (H, H) candidate,
    ``Wc``, ``bc`` classes, ``Ww`` (C, H, CLASS), ``bw`` words."""

    def __init__(self, counts: list[int], total: int, seed: int = 5, hidden: int = HIDDEN, size: int = CLASS):
        K = len(counts)
        C = -(-K // size)
        rng = np.random.default_rng(seed)
        mass = np.zeros(C * size)
        mass[:K] = counts
        by_class = mass.reshape(C, size)
        classes = np.append(by_class.sum(1), max(total - sum(counts), 0) + 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            bw = np.where(by_class > 0, np.log(by_class / by_class.sum(1, keepdims=True)), _PADDED)
        self.words, self.size, self.room, self.every = K, size, Room(), np.arange(STRETCH)
        self.weights = {k: v.astype(np.float32) for k, v in {
            "E": rng.normal(0, 0.3, (K + 2, 3 * hidden)), "U": rng.normal(0, hidden ** -0.5, (hidden, 2 * hidden)),
            "V": rng.normal(0, hidden ** -0.5, (hidden, hidden)), "Wc": rng.normal(0, 0.02, (hidden, C + 1)),
            "bc": np.log(classes / classes.sum()), "Ww": rng.normal(0, 0.02, (C, hidden, size)), "bw": bw}.items()}

    def packed(self) -> bytes:
        return b"".join(self.weights[k].tobytes() for k in sorted(self.weights))

    def unpack(self, data: bytes) -> None:
        at = 0
        for k in sorted(self.weights):
            w = self.weights[k]
            self.weights[k] = np.frombuffer(data, np.float32, w.size, at).reshape(w.shape).copy()
            at += w.nbytes

    def inputs(self, tokens: np.ndarray) -> np.ndarray:
        """What the network reads before each token of a text."""
        return np.concatenate([np.array([self.words + 1], tokens.dtype), tokens[:-1]])

    def states(self, x: np.ndarray, h: np.ndarray, keep: bool = False, widths: list[int] | None = None) -> np.ndarray:
        """States (T + 1, B, H) around the tokens of a window, ``h`` first;
        ``x`` (T, B) is read.  At a start the state is 0.  ``widths``: lanes
        that still run.  The array is overwritten by the next call, and so
        are with ``keep`` the gates z and r, r * before and the candidates."""
        w, room, (T, B), H, kind = self.weights, self.room, x.shape, h.shape[1], h.dtype
        # sigmoid(a) = (tanh(a / 2) + 1) / 2; each gate's numbers lie side by side
        E = room("E", (3, len(w["E"]), H), kind)
        E[:] = w["E"].reshape(-1, 3, H).transpose(1, 0, 2)
        E[:2] *= 0.5
        U = w["U"].reshape(H, 2, H).transpose(1, 0, 2) * kind.type(0.5)
        starts = x == self.words + 1
        some = starts.any(1)
        hs = room("states", (T + 1, B, H), kind)
        hs[0] = h
        if keep:
            gates, resets, candidates = room("gates", (T, 2, B, H), kind), room("resets", (T, B, H), kind), room("candidates", (T, B, H), kind)
            self.kept = starts, some, gates, resets, candidates
        for t in range(T):
            n = widths[t] if widths else B
            before, now = hs[t, :n], hs[t + 1, :n]
            if some[t]:
                before = np.where(starts[t, :n, None], kind.type(0), before)
            e = np.take(E, x[t, :n], axis=1, out=room("inputs", (3, n, H), kind), mode="clip")
            g = gates[t] if keep else room("gates", (2, n, H), kind)
            np.matmul(before, U, out=g)
            g += e[:2]
            np.tanh(g, out=g)
            g += 1.0
            g *= 0.5
            reset = np.multiply(g[1], before, out=resets[t] if keep else room("resets", (n, H), kind))
            c = np.matmul(reset, w["V"], out=candidates[t] if keep else room("candidates", (n, H), kind))
            c += e[2]
            np.tanh(c, out=c)
            np.subtract(c, before, out=now)
            now *= g[0]
            now += before
            if n < B:
                hs[t + 1, n:] = hs[t, n:]
        self.last = hs[T].copy()
        return hs

    def _softmax(self, w: np.ndarray, b: np.ndarray, h: np.ndarray, y: np.ndarray, out: np.ndarray, dw: np.ndarray | None = None,
                 db: np.ndarray | None = None, dh: np.ndarray | None = None, scale: float = 0.0) -> None:
        """Into ``out`` the logarithms of softmax(h @ w + b) at ``y``; into
        ``dh``, and added to ``dw`` and ``db``, the gradients of -scale * their sum."""
        room, kind, across = self.room, h.dtype, np.ascontiguousarray(w.T)
        for i in range(0, len(y), STRETCH):
            at = slice(i, i + STRETCH)
            own = h[at]
            m = len(own)
            pick = y[at], self.every[:m]
            # a column for each token: sums over few classes then run along the tokens
            p = np.matmul(across, own.T, out=room("softmax", (len(b), m), kind))
            p += b[:, None]
            total = np.max(p, axis=0, out=room("total", (m,), kind))
            p -= total
            own_logit = p[pick]
            np.exp(p, out=p)
            np.sum(p, axis=0, out=total)
            np.subtract(own_logit, np.log(total, out=room("log", (m,), kind)), out=out[at])
            if dh is not None:
                p *= np.divide(kind.type(scale), total, out=total)
                p[pick] -= scale
                dw += (p @ own).T
                db += p.sum(1)
                np.matmul(p.T, across, out=dh[at])

    def log_probabilities(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None, scale: float = 0.0):
        """Natural logarithms of P(y | h) for M tokens; with ``grads`` the
        gradients of -scale * their sum are added, and that of h returned."""
        w, C, room, kind = self.weights, len(self.weights["Ww"]), self.room, h.dtype
        M, H = h.shape
        of = np.minimum(y, self.words) // self.size
        of[y >= self.words] = C
        out, inner = np.empty(M, kind), np.zeros(M, kind)
        learn = grads is not None
        dh = room("dh", (M, H), kind) if learn else None
        self._softmax(w["Wc"], w["bc"], h, of, out, *((grads["Wc"], grads["bc"], dh, scale) if learn else ()))
        order = np.argsort(of.astype(np.uint16), kind="stable")
        ends = np.searchsorted(of[order], np.arange(C + 1))
        n = int(ends[C])  # the tokens in a class of the model's words
        own = np.take(h, order[:n], axis=0, out=room("by class", (n, H), kind), mode="clip")
        places = y[order[:n]] % self.size
        back = room("back by class", (n, H), kind) if learn else None
        for c in range(C):
            at = slice(ends[c], ends[c + 1])
            if ends[c] < ends[c + 1]:
                self._softmax(w["Ww"][c], w["bw"][c], own[at], places[at], inner[at],
                              *((grads["Ww"][c], grads["bw"][c], back[at], scale) if learn else ()))
        out[order] += inner
        if learn:
            dh[order[:n]] += back
        return out, dh

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray, grads: dict | None = None) -> tuple[float, dict]:
        """Mean cross-entropy of a window and its gradients (in ``grads``),
        back to the window's start; the state goes on in ``last``."""
        w, room, (T, B), H, kind = self.weights, self.room, x.shape, h.shape[1], h.dtype
        if grads is None:
            grads = {k: np.empty_like(v) for k, v in w.items()}
        for g in grads.values():
            g.fill(0)
        hs = self.states(x, h, keep=True)
        starts, some, gates, resets, candidates = self.kept
        flat, real = hs[1:].reshape(-1, H), mask.ravel()
        if real.all():
            lp, into = self.log_probabilities(flat, y.ravel(), grads, 1.0 / len(real))
        else:
            at = np.flatnonzero(real)
            lp, d = self.log_probabilities(np.take(flat, at, axis=0, out=room("real", (len(at), H), kind), mode="clip"), y.ravel()[at],
                                           grads, 1.0 / max(len(at), 1))
            into = room("into", flat.shape, kind)
            into.fill(0)
            into[at] = d
        into = into.reshape(T, B, H)
        befores = hs[:-1]
        befores[starts] = 0
        U = np.ascontiguousarray(w["U"].reshape(H, 2, H).transpose(1, 2, 0))
        steps = room("steps", (3, T, B, H), kind)
        both, a, dhz, drh, dh, back = room("both", (2, B, H), kind), *(room(k, (B, H), kind) for k in ("a", "dhz", "drh", "dh of t", "back"))
        back.fill(0)
        for t in range(T - 1, -1, -1):
            before, (z, r), n = befores[t], gates[t], candidates[t]
            dz, dr, dn = steps[:, t]
            np.add(back, into[t], out=dh)
            np.multiply(dh, z, out=dhz)
            np.subtract(1.0, z, out=a)
            np.subtract(n, before, out=dz)
            dz *= dhz
            dz *= a
            np.multiply(n, n, out=a)
            np.subtract(1.0, a, out=a)
            np.multiply(dhz, a, out=dn)
            np.matmul(dn, w["V"].T, out=drh)
            np.subtract(1.0, r, out=a)
            a *= resets[t]
            np.multiply(drh, a, out=dr)
            np.matmul(steps[:2, t], U, out=both)
            np.subtract(dh, dhz, out=back)
            drh *= r
            back += drh
            back += both[0]
            back += both[1]
            if some[t]:
                back[starts[t]] = 0
        by_gate = steps.reshape(3, -1, H)
        grads["V"] += resets.reshape(-1, H).T @ by_gate[2]
        for i in range(2):
            grads["U"][:, i * H:(i + 1) * H] += befores.reshape(-1, H).T @ by_gate[i]
        # rows of one token are summed where they lie side by side
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        seen = x.ravel()[order]
        firsts = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
        for i in range(3):
            rows = np.take(by_gate[i], order, axis=0, out=room("by token", (len(order), H), kind), mode="clip")
            grads["E"][seen[firsts], i * H:(i + 1) * H] += np.add.reduceat(rows, firsts, axis=0)
        return float(-lp.mean()) if len(lp) else 0.0, grads

    def score(self, texts: list[np.ndarray], lanes: int = LANES, window: int = 2 * WINDOW) -> np.ndarray:
        """Log-likelihood of each text of tokens, all of them to their ends."""
        out = np.zeros(len(texts))
        loads = [(0, i, []) for i in range(min(lanes, len(texts)))]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):  # the longest to the emptiest lane
            size, lane, own = loads[0]
            own.append(i)
            heapq.heapreplace(loads, (size + len(texts[i]), lane, own))
        loads.sort(key=lambda x: (-x[0], x[1]))
        ys = [np.concatenate([texts[i] for i in own]) for _, _, own in loads]
        xs = [np.concatenate([self.inputs(texts[i]) for i in own]) for _, _, own in loads]
        ids = [np.repeat(np.array(own), [len(texts[i]) for i in own]) for _, _, own in loads]
        sizes = np.array([len(y) for y in ys], np.int64)
        h = np.zeros((len(ys), self.weights["V"].shape[0]), np.float32)
        for t in range(0, int(sizes.max(initial=0)), window):
            on = int((sizes > t).sum())
            steps = int(min(window, sizes[0] - t))
            x, y = np.zeros((steps, on), np.int64), np.full((steps, on), -1, np.int64)
            of = np.zeros((steps, on), np.int64)
            for k in range(on):
                n = min(steps, int(sizes[k]) - t)
                x[:n, k], y[:n, k], of[:n, k] = xs[k][t:t + n], ys[k][t:t + n], ids[k][t:t + n]
            widths = [int((sizes[:on] > t + s).sum()) for s in range(steps)]
            states = self.states(x, h[:on], widths=widths)[1:].reshape(-1, h.shape[1])
            h[:on] = self.last
            real = np.flatnonzero(y.ravel() >= 0)
            if len(real) < y.size:
                states = np.take(states, real, axis=0, out=self.room("real", (len(real), h.shape[1])), mode="clip")
            lp, _ = self.log_probabilities(states, y.ravel()[real])
            out += np.bincount(of.ravel()[real], lp, len(texts))
        return out


def fit_segments(model: Model, segments: Iterator[tuple[np.ndarray, np.ndarray]], lanes: int = TRAIN_LANES,
                 window: int = WINDOW, rate: float = 0.02) -> int:
    """Train on (inputs, tokens) of segments, ``lanes`` side by side; returns
    the number of tokens."""
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    grads = {k: np.zeros_like(v) for k, v in model.weights.items()}
    change = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = tokens = 0
    held: list = []

    def run() -> None:
        nonlocal step, tokens
        held.sort(key=lambda s: -len(s[1]))
        sizes = np.array([len(y) for _, y in held])
        T = int(sizes[0])
        x, y = np.zeros((T, len(held)), np.int64), np.zeros((T, len(held)), np.int64)
        mask = np.arange(T)[:, None] < sizes
        for k, (a, b) in enumerate(held):
            x[:len(a), k], y[:len(b), k] = a, b
        h = np.zeros((len(held), model.weights["V"].shape[0]), np.float32)
        for t in range(0, T, window):
            on = int((sizes > t).sum())  # the longest first: only lanes that still run
            model.gradients(x[t:t + window, :on], y[t:t + window, :on], mask[t:t + window, :on], h[:on], grads)
            h = model.last
            step += 1
            for k, g in grads.items():
                a = np.subtract(g, first[k], out=change[k])
                a *= 0.1
                first[k] += a
                g *= g
                g -= second[k]
                g *= 0.01
                second[k] += g
                # the change is rate * (mean / (1 - 0.9 ** step)) / (sqrt(square / (1 - 0.99 ** step)) + 1e-6)
                np.divide(second[k], 1 - 0.99 ** step, out=a)
                np.sqrt(a, out=a)
                a += 1e-6
                np.divide(first[k], a, out=a)
                a *= rate / (1 - 0.9 ** step)
                model.weights[k] -= a
        tokens += int(mask.sum())

    for segment in segments:
        held.append(segment)
        if len(held) == lanes:
            run()
            held.clear()
    if held:
        run()
    return tokens


def segments_of(model: Model, tokens: np.ndarray, mark: int, chosen: int, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The segments of a text that a round trains on, by a hash of its mark;
    each segment is in one of the rounds."""
    places = np.arange(-(-len(tokens) // SEGMENT), dtype=np.uint64)
    mixed = (np.uint64(mark % (1 << 64)) + places + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    inputs = model.inputs(tokens)
    for k in np.flatnonzero((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(rounds) == chosen):
        at = slice(int(k) * SEGMENT, (int(k) + 1) * SEGMENT)
        yield inputs[at], tokens[at]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``TEXT`` bytes of text, whole rows each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT, "right")))
        yield batch.slice(at, end - at)
        at = end


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after the other, and how many
    each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty one
    upto = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64))
    return (words.filter(real) if upto[-1] < len(words) else words), np.diff(upto[offsets - offsets[0]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            words, sizes = _words(part.column("text"))
            held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            coded = words.dictionary_encode()
            codes, different = coded.indices.to_numpy(), len(coded.dictionary)
            every = np.append(np.bincount(codes, minlength=different), len(held))
            out = np.append(np.bincount(codes[np.repeat(held, sizes)], minlength=different), held.sum())
            found = pa.concat_arrays([coded.dictionary, pa.array([END])])
            for i in range(0, len(found), 1 << 16):
                at = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([found[at], pa.array((every - out)[at], pa.int64()), pa.array(out[at], pa.int64())],
                                                 ["word", "train", "held"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, train, held) of all tokens of (text, held_out); the end is a space."""
    return (docs.select("text", "held_out").mapInArrow(_count, "word string, train bigint, held bigint")
            .groupBy("word").agg(F.sum("train").alias("train"), F.sum("held").alias("held")))


class Vocabulary:
    """The broadcast words: places, log10(count + 1), whether known, and the
    model's tokens (``words`` of them; that number stands for other words)."""

    def __init__(self, words: list[str], train: np.ndarray, lm_words: int):
        self.places = pa.array(words, pa.string())
        self.log_count = np.append(np.log10(train + 1.0), 0.0)
        self.known = np.append(train > 0, False)
        best = sorted((i for i in range(len(words)) if train[i] > 0), key=lambda i: (-train[i], words[i]))[:lm_words]
        #: The place of the end; as many as there are words stand for a word that is not there.
        self.end = words.index(END) if END in words else len(words)
        if self.end < len(words) and train[self.end] > 0 and self.end not in best:
            best[-1] = self.end
        self.words = len(best)
        self.counts = [int(train[i]) for i in best]
        self.token = np.full(len(words) + 1, self.words, np.uint16)
        self.token[best] = np.arange(self.words)


_CODED = ("n_tokens bigint, known bigint, log_count double, n_other bigint, log_other double, "
          "rare array<string>, times array<bigint>, tokens binary")


def _encode(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = box.value
        missing = len(v.places)
        for batch in batches:
            for part in _slices(batch):
                words, sizes = _words(part.column("text"))
                starts = np.append(0, np.cumsum(sizes + 1))
                is_word = np.ones(starts[-1], bool)
                is_word[starts[1:] - 1] = False
                at = np.full(starts[-1], v.end, np.int32)
                at[is_word] = pc.fill_null(pc.index_in(words, value_set=v.places), missing).to_numpy(zero_copy_only=False)
                tokens, logs, known = v.token[at], v.log_count[at], v.known[at]
                other = tokens == v.words
                sums = [np.add.reduceat(x, starts[:-1]) for x in (
                    known.astype(np.int64), logs, other.astype(np.int64), np.where(other, logs, 0.0))]
                # each text's words beyond the broadcast ones, and how often it has them
                rare = np.flatnonzero(at == missing)
                place = np.cumsum(is_word) - 1
                place[starts[1:] - 1] = len(words)
                coded = pa.concat_arrays([words, pa.array([END])]).take(pa.array(place[rare])).dictionary_encode()
                row = np.searchsorted(starts, rare, "right") - 1
                keys, times = np.unique(row * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
                row, code = np.divmod(keys, max(len(coded.dictionary), 1))
                cuts = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in ("doc", "key", "held_out")), pa.array(sizes + 1, pa.int64()),
                    *(pa.array(x) for x in sums), pa.ListArray.from_arrays(cuts, coded.dictionary.take(pa.array(code))),
                    pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
                    pa.Array.from_buffers(pa.binary(), len(sizes), [
                        None, pa.py_buffer((starts * 2).astype(np.int32)), pa.py_buffer(tokens)])], [
                    "doc", "key", "held_out", "n_tokens", "known", "log_count", "n_other", "log_other", "rare", "times", "tokens"])

    return run


def _train(box, chosen: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = box.value
        start = model.packed()

        def segments() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for mark, tokens in zip(batch.column("mark").to_pylist(), batch.column("tokens")):
                    yield from segments_of(model, np.frombuffer(tokens.as_py(), np.uint16).astype(np.int64), mark, chosen, rounds)

        n = fit_segments(model, segments())
        weights = model.packed()
        model.unpack(start)  # the broadcast model serves the worker's next task too
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()),
                pa.array([weights], pa.binary())], ["part", "n", "weights"])

    return run


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    total = int(rows["n"].sum())
    mean = sum(np.frombuffer(w, np.float32).astype(np.float64) * (n / total) for w, n in zip(rows["weights"], rows["n"]))
    return pd.DataFrame({"part": [int(rows["part"].min())], "n": [total], "weights": [mean.astype(np.float32).tobytes()]})


def train(encoded: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Train on (mark, tokens) of all given texts, as the module says."""
    spark = encoded.sparkSession
    for chosen in range(rounds):
        box = spark.sparkContext.broadcast(model)
        copies = cut(encoded.select("mark", "tokens").mapInArrow(_train(box, chosen, rounds), "part bigint, n bigint, weights binary"),
                     f"copies-{chosen}")
        while (n := copies.count()) > FAN:
            group = F.pmod("part", F.lit(math.ceil(n / FAN)))
            copies = cut(copies.groupBy(group).applyInPandas(_average, copies.schema), f"averages-{chosen}")
        rows = copies.toPandas()  # at most FAN copies
        box.unpersist()
        if len(rows):
            model.unpack(_average(rows)["weights"][0])
    return model


def _score(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = box.value
        for batch in batches:
            texts = [np.frombuffer(t.as_py(), np.uint16) for t in batch.column("tokens")]
            kept = [c for c in batch.schema.names if c != "tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(texts), pa.float64())],
                                             [*kept, "ln"])

    return run


def _head(counts: DataFrame, most: int) -> Column:
    """Words frequent enough to be among the ``most`` that are broadcast."""
    bucket = F.floor(F.log2(F.col("train") + F.col("held")) * 16)
    taken, least = 0, None
    # at most 16 rows for each doubling of a count
    for r in sorted(counts.groupBy(bucket.alias("b")).count().collect(), key=lambda r: -r["b"]):
        taken += r["count"]
        if taken > most:
            break
        least = r["b"]
    return bucket >= F.lit(least) if least is not None else F.lit(False)


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", head: int = HEAD,
          lm_words: int = LM_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of ``docs``: (key, held_out, n_tokens, n_known,
    train_tokens, base_score, score), learned from the rows where
    ``held_out`` is not true."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out")).withColumn("doc", F.monotonically_increasing_id())
    counts = cut(count_words(rows), "words")
    known = counts.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("N"), F.count(F.when(F.col("train") > 0, 1)).alias("V")).first()
    in_head = _head(counts, head)
    words = counts.filter(in_head).toPandas().sort_values("word")
    vocabulary = Vocabulary(words["word"].tolist(), words["train"].to_numpy(np.int64), lm_words)
    box = spark.sparkContext.broadcast(vocabulary)
    kind = rows.schema["key"].dataType.simpleString()
    coded = cut(rows.mapInArrow(_encode(box), f"doc bigint, key {kind}, held_out boolean, {_CODED}"), "tokens")
    learn = coded.filter(~F.col("held_out")).select(F.xxhash64("key").alias("mark"), "tokens")
    net = spark.sparkContext.broadcast(train(learn, Model(vocabulary.counts, known.N), rounds))
    kept = coded.drop("rare", "times")
    scored = kept.mapInArrow(_score(net), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema
                                                    if f.name != "tokens") + ", ln double")
    rare = (coded.select("doc", F.inline(F.arrays_zip("rare", "times")))
            .join(counts.filter(~in_head & (F.col("train") > 0)).select(F.col("word").alias("rare"), "train"), "rare")
            .groupBy("doc").agg(F.sum(F.col("times") * F.log10(F.col("train") + 1.0)).alias("rare_log"),
                                F.sum("times").alias("rare_known")))
    rest = known.N - sum(vocabulary.counts) + known.V - vocabulary.words + 1
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return (scored.join(rare, "doc", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.N).cast("long").alias("train_tokens"),
        (F.col("log_count") + rare_log - F.col("n_tokens") * F.lit(math.log10(known.N + known.V + 1))).alias("base_score"),
        (F.col("ln") / F.lit(math.log(10)) + F.col("log_other") + rare_log
         - F.col("n_other") * F.lit(math.log10(rest))).alias("score")))
