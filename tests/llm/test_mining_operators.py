"""Hard negatives, collocations and the language model against brute force, on
generated tables of edge cases (nulls, ties, repeated rows, empty and long
texts, empty tables, extra columns with clashing names)."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavepanel.llm import collocations, gru_lm, hard_negatives, queries

SF = "/root/testdata/sf0.001"
CLASH = ("key", "row", "anchor", "list", "score", "rank", "n", "l", "f", "word", "doc", "held_out", "tokens", "idx", "k")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# hard negatives

def vectors(n=260, width=11, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), (rng.integers(-3, 4, width) / 4).tolist()) for i in range(n)]  # many ties
    rows += [rows[0], rows[0], rows[5], (100, 1, [None] * width), (200, 2, [math.nan] + [0.1] * (width - 1)), (300, None, [0.5] * width),
             (400, 1, None), (500, 1, [math.inf] * width), (600, 1, []), (601, 2, [0.25]), (None, 1, [0.5] * width), (None, 1, [0.5] * width),
             (700, 1, [300.0, -2.5] + [0.0] * (width - 2)), (800, 2, [0.0] * width), (900, 0, [1e300] * width), (901, 1, [0.75] * width)]
    return rows


def brute_negatives(rows, anchor, positives=5, negatives=5):
    usable = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or abs(x * 256) > 2 ** 26 for x in v):
            continue
        usable.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for place, (a, label, v) in enumerate(usable):
        if a is None or not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0, k) for k, (i, _, w) in enumerate(usable)]
        scored.sort()
        same = [s for s in scored if usable[s[3]][1] == label and s[3] != place][:positives]
        for p in same:
            own = [s for s in scored if usable[s[3]][1] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            for rank, s in enumerate(own[:negatives], 1):
                out.append((a, usable[p[3]][0], rank, usable[s[3]][0], -p[0], -s[0]))
    return out


@pytest.mark.parametrize("per_round", [None, 4])
def test_hard_negatives(spark, per_round):
    rows = vectors()
    df = clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, anchors_per_round=per_round)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, lambda i: i % 20 == 0)
    assert len(want) > 100
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_hard_negatives_of_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    none = spark.createDataFrame([(1, 1, [0.5])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(none, F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("most", [1, 130, 5000, 2 ** 26])
def test_table_scores_are_inner_products(most):
    rng = np.random.default_rng(most)
    a, r = rng.integers(-most, most + 1, (7, 13)), rng.integers(-most, most + 1, (50, 13))
    tables = hard_negatives._block_tables(a, most)
    assert (hard_negatives.scores(tables, hard_negatives.bit_planes(r)) == r @ a.T).all()


# collocations

def brute_phrases(rows, least, longest=5):
    f, n = defaultdict(Counter), Counter()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        inside = {p[i:i + k] for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                  if a >= often[p[i:i + k]]}
        found = []
        for p, a in often.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found), 1)]
    return out


def texts(seed=1):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "New", "york", "city", "é", "日本", "a", "a b", "x y", "end"]
    rows = []
    for i in range(160):
        some = rng.choice(words, int(rng.integers(0, 40))).tolist()
        rows.append((" ".join(w + str(rng.choice(["", "", "", ",", ".", "\n", "\t", "  ", ";:"])) for w in some), ["en", "fr", None][i % 3]))
    return rows + [(None, "en"), ("", "fr"), (" \t\n,,", None), ("a " * 3000, "en"), ("new york city " * 5, ""), ("z" * 50000, "en"),
                   *[("New York City of the end. " * 3, "en")] * 8]


@pytest.mark.parametrize("trie_phrases", [None, 7])
def test_collocations(spark, trie_phrases, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 500)
    rows = texts()
    df = clashing(spark.createDataFrame(rows, "text string, lang string")).repartition(3)
    got = collocations.collocations(df, min_count=4, trie_phrases=trie_phrases)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, 4)
    assert len(want) > 100
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_collocations_top_and_empty(spark):
    rows = texts(2)
    df = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.collocations(df, min_count=4, top=3)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in brute_phrases(rows, 4) if r[1] <= 3)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_trie_finds_its_phrases_and_no_others():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    phrases = list({tuple(rng.choice(words[:60 if i % 3 else 400], 3)) for i in range(9000)})
    trie = collocations.Trie(["en"] * len(phrases), [list(p) for p in phrases])
    of = trie.symbols_of("en", words)
    text = np.append(of[rng.integers(0, 61, 200_000)], 0)
    place, at = trie.advance(text)
    index = {tuple(of[1 + int(w[1:])] for w in p): i for i, p in enumerate(phrases)}
    want = [(index[t], i + 2) for i in range(len(text) - 2) if (t := tuple(text[i:i + 3])) in index]
    assert sorted(zip(place.tolist(), at.tolist())) == sorted(want)


# language model

def test_lm_base_columns(spark):
    rows = [(1, "The cat, the CAT"), (2, None), (3, ""), (None, "no id the"), (4, "dog " * 5000), (4, "dog again"), (5, "É é x \t\n日本"),
            (6, "only-held-out words " * 3), (20, "x" * 100_000)] + [(i, f"the cat sat {i % 7}") for i in range(30, 90)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    assert any(held(i) for i, _ in rows)
    split = lambda t: (t or "").encode().lower().split() + [b" "]
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    N, V = sum(c.values()), len(c)
    want = Counter((i, held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), N,
                    round(sum(math.log10((c[w] + 1) / (N + V + 1)) for w in split(t)), 6)) for i, t in rows)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    for head in (1 << 18, 3):  # words beyond the broadcast ones go through a join
        got = gru_lm.score(df, out, head=head, lm_words=8).collect()
        assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert gru_lm.score(df.limit(0), out).collect() == []
    assert all(r.n_known == 0 for r in gru_lm.score(df, F.lit(True)).collect())


def brute_score(model, tokens):
    """Step by step, with the whole distribution of every token."""
    w, K = {k: v.astype(np.float64) for k, v in model.weights.items()}, model.words
    H = w["V"].shape[0]
    h, total, last = np.zeros(H), 0.0, K + 1
    for y in tokens:
        e = w["E"][last]
        g = 1 / (1 + np.exp(-(e[:2 * H] + h @ w["U"])))
        n = np.tanh(e[2 * H:] + (g[H:] * h) @ w["V"])
        h = h + g[:H] * (n - h)
        classes = np.exp(h @ w["Wc"] + w["bc"])
        classes /= classes.sum()
        p = np.zeros(K + 1)
        for c in range(len(w["Ww"])):
            q = np.exp(h @ w["Ww"][c] + w["bw"][c])
            q = classes[c] * q / q.sum()
            n_own = min(K, (c + 1) * model.size) - c * model.size
            p[c * model.size:c * model.size + n_own] = q[:n_own]
        p[K] = classes[-1]
        assert abs(p.sum() - 1) < 1e-6
        total += math.log(p[y])
        last = y
    return total


def small_model():
    model = gru_lm.Model([50, 30, 20, 9, 5, 3, 2], 140, size=3, hidden=5)
    rng = np.random.default_rng(0)
    for k in ("Wc", "Ww"):
        model.weights[k] += rng.normal(0, 0.5, model.weights[k].shape).astype(np.float32)
    return model


def test_lm_scores_complete_texts():
    model, rng = small_model(), np.random.default_rng(1)
    docs = [rng.integers(0, 8, n).astype(np.uint16) for n in (1, 5, 300, 64, 65, 128, 2, 40, 1000)]
    want = [brute_score(model, d.tolist()) for d in docs]
    for lanes, window in ((3, 16), (512, 64), (1, 7)):
        assert np.allclose(model.score(docs, lanes, window), want, rtol=1e-4)
    assert model.score([]).shape == (0,)


def test_lm_gradients():
    model, rng = small_model(), np.random.default_rng(2)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    y = rng.integers(0, 8, (6, 4))
    x = np.vstack([np.full((1, 4), 8), y[:-1]])
    x[3, 1] = 8  # a text starts inside the window
    mask = np.arange(6)[:, None] < [6, 6, 4, 2]
    h = rng.normal(0, 0.3, (4, 5))
    _, grads = model.gradients(x, y, mask, h)
    for name, at in (("E", (8, 2)), ("E", (int(x[2, 0]), 12)), ("U", (1, 7)), ("V", (2, 3)), ("Wc", (1, 2)), ("bc", (1,)), ("Ww", (0, 2, 1)),
                     ("bw", (1, 0))):
        w, was = model.weights[name], model.weights[name][at]
        losses = []
        for step in (1e-3, -1e-3):
            w[at] = was + step
            losses.append(model.gradients(x, y, mask, h)[0])
        w[at] = was
        assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][at]) < 2e-4


def test_lm_windows_use_their_memory_again():
    model, rng = gru_lm.Model([9] * 64, 900), np.random.default_rng(4)
    y = rng.integers(0, 65, (32, 256))
    x = np.vstack([np.full((1, 256), 65), y[:-1]])
    h = np.zeros((256, gru_lm.HIDDEN), np.float32)
    first = model.gradients(x, y, np.ones(x.shape, bool), h)
    tracemalloc.start()
    again = model.gradients(x, y, np.ones(x.shape, bool), h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first[0] == again[0] and all(np.array_equal(first[1][k], again[1][k]) for k in first[1])
    assert peak < 1 << 20  # one array of a window's states alone has half of that


def test_lm_words_of_slices(monkeypatch):
    texts = ["  The cat\t\x0bTHE\x1c ", None, "", " ", "cat É é x\u3000y x\u3000y", "end", "the " * 9, "\n\x85 \x0c"]
    held = [False, True, False, True, False, True, False, True]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(range(8)), pa.array(texts, pa.string()), pa.array(held)],
                                       ["doc", "key", "text", "held_out"])
    words = [[w.decode() for w in (t or "").encode().lower().split()] + [" "] for t in texts]
    for head in (["the"], sorted({w for ws in words for w in ws}), [" ", "cat"]):
        v = gru_lm.Vocabulary(head, np.arange(len(head)) + 1, 2)
        for size in (1, 20, 1 << 20):
            monkeypatch.setattr(gru_lm, "TEXT", size)
            train, out = Counter(), Counter()
            for b in gru_lm._count(iter([batch.slice(0, 3), batch.slice(3)])):
                for r in b.to_pylist():
                    train[r["word"]] += r["train"]
                    out[r["word"]] += r["held"]
            assert +train == Counter(w for ws, o in zip(words, held) for w in ws if not o)
            assert +out == Counter(w for ws, o in zip(words, held) for w in ws if o)
            rows = [r for b in gru_lm._encode(SimpleNamespace(value=v))(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()]
            assert [(r["doc"], r["key"], r["held_out"]) for r in rows] == [(i, i, o) for i, o in enumerate(held)]
            for r, ws in zip(rows, words):
                at = [head.index(w) if w in head else len(head) for w in ws]
                assert np.frombuffer(r["tokens"], np.uint16).tolist() == v.token[at].tolist()
                assert (r["n_tokens"], r["known"], r["n_other"]) == (len(ws), int(v.known[at].sum()), int((v.token[at] == v.words).sum()))
                assert math.isclose(r["log_count"], v.log_count[at].sum()) and len(r["rare"]) == len(set(r["rare"]))
                assert math.isclose(r["log_other"], v.log_count[at][v.token[at] == v.words].sum())
                assert Counter(dict(zip(r["rare"], r["times"]))) == Counter(w for w in ws if w not in head)


def test_lm_trains_on_every_segment_once():
    model, rng = small_model(), np.random.default_rng(3)
    for size in (1, 127, 128, 129, 5000):
        tokens = rng.integers(0, 8, size)
        parts = [s for chosen in range(gru_lm.ROUNDS) for s in gru_lm.segments_of(model, tokens, 17 * size, chosen)]
        assert sum(len(y) for _, y in parts) == size
        want = Counter(tuple(tokens[i:i + gru_lm.SEGMENT].tolist()) for i in range(0, size, gru_lm.SEGMENT))
        assert Counter(tuple(y.tolist()) for _, y in parts) == want


def test_lm_training_round_counts_all_tokens(spark):
    model = small_model()
    texts = [np.arange(n, dtype=np.uint16) % 8 for n in (1, 300, 128, 40, 1000)]
    df = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "mark long, tokens binary")
    box = spark.sparkContext.broadcast(model)
    gru_lm.ship_package(spark)
    n = sum(r.n for chosen in range(3) for r in df.mapInArrow(
        gru_lm._train(box, chosen, 3), "part bigint, n bigint, weights binary").collect())
    assert n == sum(map(len, texts))


def test_lm_learns_order(spark):
    """Words that follow each other in a fixed order become likely, also in
    texts held out, and much likelier than by their counts."""
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(words[(i + j) % 12] for j in range(60))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")
    got = gru_lm.score(df, F.col("doc_id") % 10 == 3).toPandas()
    out = got[got["held_out"]]
    assert len(out) == 600
    assert out["score"].sum() > 0.5 * out["base_score"].sum()
    again = gru_lm.score(df, F.col("doc_id") % 10 == 3).toPandas()
    assert got.sort_values("doc_id")["score"].tolist() == again.sort_values("doc_id")["score"].tolist()


def test_lm_query_beats_counts_on_held_out_documents(spark):
    got = queries.op13_gru_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b
