"""MinHash near-dedup: universal hash minima, banding, signature
verification, exact confirmation, and connected components by alternating
large-star and small-star.

1. Every whole text becomes its set of distinct 5-word shingles (64-bit
   hashes), and the set a signature: the minima of ``HASHES`` universal
   hashes (a * x + b mod 2**64, upper half).  Documents with equal sets are
   one node; copies collapse before anything is joined.
2. Nodes that agree on all rows of a band share a bucket.  ``BANDS`` bands of
   ``ROWS`` rows miss a pair of similarity 0.85 with a probability below
   1e-7.
3. What of a set occurs in no other candidate's set (its private part)
   bounds its similarity with all others.  Nodes with too large a private
   part link with nothing and leave; the bound also rules out pairs.
4. Pairs come from stars, never from all pairs of a bucket: the members of a
   bucket are paired with its hub, the member with the smallest private
   share.  A pair whose signatures agree in fewer than ``AGREE`` hashes is
   none (a true one fails that with a probability below 1e-9); the others
   are confirmed on their full sets.
5. Components of the links: large-star and small-star in turn until the
   edges rest.
6. Buckets whose members then are in one component have nothing left to
   find.  The members of the others are compared in blocks of bounded size,
   by signature, private part and a histogram of the set that bounds the
   intersection; only pairs of different components that pass all three
   leave a task, and are confirmed on full sets.  So no link that would join
   two components is missed, and a large group costs a star.

Sets are recomputed for documents in shared buckets only.  Tables between
the steps lie in the shared folder.

Documents with fewer words than a shingle have their whole sequence as the
one shingle; without words (or null) their set is empty, they link with
nothing.  A doc_id that stands for several texts is linked by all their sets,
which are in one component.  A row with a null doc_id takes no part: its component_id is
null and it is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hold, ship_package

SHINGLE = 5
#: Links: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Agreeing hashes of a candidate, of HASHES.
AGREE = 57
CACHE_WORDS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, np.uint64)


_A, _B = _family(HASHES)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = xxhash.xxh3_64_intdigest(word)
        return n


_HASHES_OF = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix64's end)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES_OF) > CACHE_WORDS:
        _HASHES_OF.clear()
    h = np.fromiter(map(_HASHES_OF.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    x = h[:n] + np.uint64(k)
    for i in range(1, k):
        x = x * _MIX + h[i:i + n]
    return np.unique(_mixed(x))


def signature(found: np.ndarray) -> np.ndarray:
    """Minima of the hash family over a set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(found), 2048):
        x = (found[start:start + 2048, None] * _A + _B) >> np.uint64(32)
        low = np.minimum(low, x.min(0).astype(np.uint32))
    return low


def bands(sig: np.ndarray) -> list[int]:
    """One 64-bit hash per band."""
    return [xxhash.xxh3_64_intdigest(sig[i:i + ROWS].tobytes(), seed=i) - (1 << 63) for i in range(0, HASHES, ROWS)]


_SIGNED = "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("near_dup", _HASHES_OF.clear)
    for batch in batches:
        for start in range(0, len(batch), 2000):
            part = batch.slice(start, 2000)
            n, keys, sigs, of = [], [], [], []
            for t in part.column(1):
                found = shingles(t.as_py())
                n.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                sig = signature(found) if len(found) else None
                sigs.append(None if sig is None else sig.tobytes())
                of.append([] if sig is None else bands(sig))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()),
                 pa.array(of, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "sig", "bands"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if not len(batch):
            continue
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, HASHES) for i in (2, 3))
        keep = pa.array((a == b).sum(1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, set of a, set of b) whose full sets link them."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (v.values.to_numpy() for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


#: Classes of the histogram of a set.
CLASSES = 64


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, histogram and set of texts."""
    hold("near_dup", _HASHES_OF.clear)
    for batch in batches:
        for start in range(0, len(batch), 1000):
            part = batch.slice(start, 1000)
            found = [shingles(t.as_py()) for t in part.column(1)]
            classes = [np.bincount((f >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=CLASSES) for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary()),
                 pa.array([c.astype("<u4").tobytes() for c in classes], pa.binary()),
                 pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))],
                names=["doc_id", "set_key", "classes", "set"])


_SET = "doc_id long, set_key binary, classes binary, set array<long>"


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """Connected components of (a, b) pairs by large-star and small-star in
    turn: (node, component), component the smallest node of each."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        # large-star: each larger neighbour of a node goes to its smallest
        large = cut(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .filter("a != b").distinct(), name)
        # small-star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        state = now


def _may_link(n1, p1, n2, p2):
    """Whether two sets of sizes n with private parts p can reach the
    threshold: they have min(n - p) in common at most."""
    common = F.least(n1 - p1, n2 - p2)
    return 100 * common >= THRESHOLD * (n1 + n2 - common)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link them."""
    end = lambda e: sets.select(F.col("node").alias(e), F.col("set").alias("set_" + e))
    return cut(pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "set_a", "set_b")
               .mapInArrow(_confirmed, "a long, b long"), "links")


#: Members of a bucket that one row of the block comparison holds.
BLOCK = 512


def _rows(members) -> dict[str, np.ndarray]:
    values = members.flatten()
    get = lambda name: values.field(name)
    return {
        "node": get("node").to_numpy(), "component": get("component").to_numpy(), "n": get("n").to_numpy(),
        "private": get("private").to_numpy(),
        "sig": np.frombuffer(b"".join(get("sig").to_pylist()), "<u4").reshape(-1, HASHES),
        "classes": np.frombuffer(b"".join(get("classes").to_pylist()), "<u4").reshape(-1, CLASSES).astype(np.int64),
    }


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of a bucket's members the pairs that may still link."""
    for batch in batches:
        a, b = [], []
        for i in range(len(batch)):
            same = batch.column(0)[i].as_py() == batch.column(1)[i].as_py()
            x, y = _rows(batch.column(2).slice(i, 1)), _rows(batch.column(3).slice(i, 1))
            for k in range(len(x["node"])):
                n, p = x["n"][k], x["private"][k]
                most = np.minimum(n - p, y["n"] - y["private"])
                ok = (y["component"] != x["component"][k]) & (100 * most >= THRESHOLD * (n + y["n"] - most))
                if same:
                    ok[:k + 1] = False
                at = np.flatnonzero(ok)
                at = at[(y["sig"][at] == x["sig"][k]).sum(1) >= AGREE]
                most = np.minimum(y["classes"][at], x["classes"][k]).sum(1)
                at = at[100 * most >= THRESHOLD * (n + y["n"][at] - most)]
                a += [int(x["node"][k])] * len(at)
                b += y["node"][at].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut(rows.mapInArrow(_sign, _SIGNED), "signed")

    # nodes: documents with equal sets, and the smallest doc_id of each
    known = signed.filter("doc_id is not null and n_shingles > 0")
    by_set = cut(known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
                 .withColumn("node", F.monotonically_increasing_id()), "by_set")
    nodes = cut(known.join(by_set, ["set_key", "doc_id"])
                .select("node", "doc_id", "set_key", F.col("n_shingles").alias("n"), "sig", "bands")
                .dropDuplicates(["node"]), "nodes")
    # the sets of a doc_id that stands for several texts belong together
    named = known.select("doc_id", "set_key").join(by_set.select("set_key", "node"), "set_key").select("doc_id", "node")
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).filter("a != hi")
    twins = cut(named.join(several.select("doc_id", "a"), "doc_id").filter("node != a")
                .select("a", F.col("node").alias("b")).distinct(), "twins")

    # buckets with two nodes or more
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = cut(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket"), "shared")
    entries = cut(entries.join(shared, "bucket"), "entries")
    wanted = cut(nodes.select("node", "doc_id", "set_key").join(entries.select("node").distinct(), "node"), "wanted")
    sets = cut(rows.join(wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets, _SET)
               .join(wanted, ["doc_id", "set_key"]).select("node", "classes", "set").dropDuplicates(["node"]), "sets")

    # private parts; nodes with too large a one link with nothing
    private = (sets.select("node", F.explode("set").alias("x")).groupBy("x")
               .agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("node")).filter("_n = 1")
               .groupBy("node").agg(F.count(F.lit(1)).alias("private")))
    sized = cut(sets.select("node", F.size("set").cast("long").alias("n")).join(private, "node", "left")
                .select("node", "n", F.coalesce("private", F.lit(0)).alias("private"))
                .filter(100 * (F.col("n") - F.col("private")) >= THRESHOLD * F.col("n")), "sized")
    members = cut(entries.join(sized, "node"), "members")

    # a star in each bucket
    share = F.col("private") / F.col("n")
    hubs = cut(members.groupBy("bucket").agg(F.min(F.struct(share.alias("s"), "node", "n", "private")).alias("hub"),
                                             F.count(F.lit(1)).alias("_n"))
               .filter("_n > 1").select("bucket", "hub"), "hubs")
    stars = (members.join(hubs, "bucket").filter(F.col("node") != F.col("hub.node"))
             .filter(_may_link(F.col("n"), F.col("private"), F.col("hub.n"), F.col("hub.private")))
             .select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct())
    sig = lambda e: nodes.select(F.col("node").alias(e), F.col("sig").alias("sig_" + e))
    likely = cut(stars.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b")
                 .mapInArrow(_agreeing, "a long, b long"), "likely")
    links = _confirm(likely, sets).unionByName(twins)
    found = cut(components(links), "components")

    # buckets whose members are in several components, block by block
    placed = (members.join(found, "node", "left")
              .select("bucket", "node", "n", "private", F.coalesce("component", "node").alias("component")))
    placed = cut(placed, "placed")
    open_buckets = cut(placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                                    F.count(F.lit(1)).alias("size"))
                       .filter("lo != hi").select("bucket", "size"), "open")
    blocks = cut(placed.join(open_buckets, "bucket")
                 .withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)))
                 .join(nodes.select("node", "sig"), "node").join(sets.select("node", "classes"), "node")
                 .groupBy("bucket", "block")
                 .agg(F.collect_list(F.struct("node", "component", "n", "private", "sig", "classes")).alias("rows")),
                 "blocks")
    x = blocks.select("bucket", F.col("block").alias("i"), F.col("rows").alias("x"))
    y = blocks.select("bucket", F.col("block").alias("j"), F.col("rows").alias("y"))
    across = (x.join(y, "bucket").filter("i <= j").select("i", "j", "x", "y")
              .mapInArrow(_compare_blocks, "a long, b long").distinct())
    more = _confirm(across, sets)
    if not more.isEmpty():
        found = cut(components(links.unionByName(more)), "components")

    # a component is named by its smallest doc_id
    placed = cut(by_set.join(found, "node", "left").select("set_key", "doc_id", F.coalesce("component", "node").alias("component")),
                 "named")
    names = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = placed.join(names, "component").select("set_key", "component_id")
    return (signed.join(of_set, "set_key", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = (near_duplicates(docs, doc_id, text).filter("not kept").select(F.col("doc_id").alias("__id")).distinct())
    return docs.join(cut(gone, "gone"), F.col(f"`{doc_id}`") == F.col("__id"), "left_anti")
