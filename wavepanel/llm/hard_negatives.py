"""Hard-negative mining by Four-Russians scoring.

Every component x becomes the whole number floor(scale * x); a score is the
whole-number inner product of an anchor and a row.  An anchor's positives are
its best other rows of the same label; its negatives for a positive are the
best rows of another label whose score lies between ``low`` and ``high``
percent of the positive's.

Scores are exact and come from table look-ups.  Eight dimensions form a
group; for each anchor and group the sums of all 256 subsets of its eight
components are computed once.  The rows' components are cut into bit planes
(two's complement, as many as the largest needs) and the bits of a group in a
plane packed into a byte: the byte picks the subset sum of a whole block of
anchors at once, the groups' sums are added, and planes are shifted and added
from the top one (the sign, subtracted) down.

Anchors are taken in rounds of about ``ROUND`` and broadcast; in a round the
rows are read twice, once for positives and once, with the bounds they set,
for negatives.  Rows are never shuffled: a task keeps the best few per anchor
and passes on those, so labels or equal vectors that hold most of the rows
change nothing.  No row, and no score inside the bounds, is skipped.

Rows take no part if label or vector is null, a component is null or not
finite, or beyond +-2**26 after scaling (a sum of products would leave the
range of a long).  Missing components of shorter vectors count as 0, an empty
vector scores 0.  Ties go to the smaller key, null keys last, and among equal
keys to the row read first.  Repeated rows are rows of their own: an anchor's
copy is another row, and a copy of an anchor is an anchor.  An empty table,
or one without anchors, gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship_package

#: Anchors broadcast at once (about; a hash deals them to rounds).
ROUND = 4096
#: Rows and anchors scored at a time: their scores stay in a core's cache.
ROWS, ANCHORS = 2048, 256
#: Scaled components beyond this take no part.
LARGEST = 2.0 ** 26

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, K): for each group of eight dimensions and each byte the
    sum of the components whose bit is set, for every one of K anchors."""
    K, D = anchors.shape
    padded = np.zeros((K, -(-D // 8) * 8), np.int64)
    padded[:, :D] = anchors
    return np.stack([_BITS.astype(np.int64) @ padded[:, g:g + 8].T for g in range(0, padded.shape[1], 8)]) \
        if D else np.zeros((0, 256, K), np.int64)


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """(planes, groups, n) bytes of n rows, the lowest bits first; the last
    plane is the sign."""
    n, D = rows.shape
    least = max(int(rows.max(initial=0)), -int(rows.min(initial=0)) - 1)
    planes = least.bit_length() + 1
    return np.stack([np.packbits(((rows >> p) & 1).astype(np.uint8), axis=1).T for p in range(planes)])


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(n, K) inner products by look-ups, shifts and sums."""
    P, G, n = planes.shape
    K = tables.shape[2]
    total, part = np.zeros((n, K), tables.dtype), np.empty((n, K), tables.dtype)
    for p in range(P - 1, -1, -1):
        total += total
        for g in range(G):
            np.take(tables[g], planes[p, g], axis=0, out=part, mode="clip")
            if p == P - 1:
                total -= part
            else:
                total += part
    return total


def _block_tables(anchors: np.ndarray, rows_bound: int) -> np.ndarray:
    """Tables in the smallest type that holds every step of every score."""
    tables = subset_sums(anchors)
    most = int(np.abs(tables).max(axis=1, initial=0).sum(axis=0).max(initial=0)) * 2 * max(1, rows_bound)
    return tables.astype(np.int32) if most < 2 ** 31 else tables


class _Best:
    """The first ``limit`` entries of each of n lists, by score descending,
    key ascending (null last), row."""

    def __init__(self, n: int, limit: int):
        self.limit, self.floor = limit, np.full(n, np.iinfo(np.int64).min)
        self.entries = [np.zeros(0, np.int64) for _ in range(5)]

    def add(self, of, score, none, key, row) -> None:
        """Entries below a full list's last may be left out by the caller."""
        columns = [np.concatenate(c) for c in zip(self.entries, (of, score, none, key, row))]
        of, score, none, key, row = columns
        order = np.lexsort((row, key, none, -score, of))
        sorted_of = of[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_of[1:] != sorted_of[:-1]])) if len(of) else []
        sizes = np.diff(np.append(starts, len(of))).astype(np.int64)
        place = np.arange(len(of)) - np.repeat(starts, sizes)
        kept = order[place < self.limit]
        self.entries = [c[kept] for c in columns]
        last = order[place == self.limit - 1]
        self.floor[of[last]] = score[last]


def _matrix(vectors: pa.ListArray, scale: float, width: int) -> np.ndarray:
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


_FOUND = "list bigint, score bigint, none bigint, key bigint, row bigint"


def _scan(box, scale: float, limit: int):
    """The best entries of a task's rows for the lists of a broadcast round:
    the anchors' positives, or (with bounds) the positives' negatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, ids, bounds = box.value
        K, width = anchors.shape
        names = pa.array(labels, pa.string())
        known = {v: i for i, v in enumerate(dict.fromkeys(labels))}
        of_anchor = np.array([known[v] for v in labels])
        values = pa.array(list(known), pa.string())
        lists = 1 if bounds is None else bounds.shape[2]
        best = _Best(K * lists, limit)
        tables, bound = {}, 0
        for batch in batches:
            whole = _matrix(batch.column("vector"), scale, width)
            of_row = pc.index_in(batch.column("label"), values).fill_null(-1).to_numpy(zero_copy_only=False)
            keys, rows = batch.column("key"), batch.column("row").to_numpy()
            nones = keys.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            keys = keys.fill_null(0).to_numpy()
            need = int(np.abs(whole).max(initial=0))
            if need > bound:  # tables are made again in a wider type if rows need it
                tables, bound = {}, 1 << need.bit_length()
            for i in range(0, len(whole), ROWS):
                at = slice(i, i + ROWS)
                planes, label, none, key, row = bit_planes(whole[at]), of_row[at], nones[at], keys[at], rows[at]
                for a in range(0, K, ANCHORS):
                    to = slice(a, a + ANCHORS)
                    if a not in tables:
                        tables[a] = _block_tables(anchors[to], bound)
                    s = scores(tables[a], planes)
                    same = label[:, None] == of_anchor[None, to]
                    if bounds is None:
                        fit = same & (s >= best.floor[to]) & (row[:, None] != ids[None, to])
                        r, c = np.nonzero(fit)
                        found = [(a + c, r, c)]
                    else:
                        found = []
                        for j in range(lists):
                            low = np.maximum(bounds[0, to, j], best.floor[j::lists][to])
                            r, c = np.nonzero((s >= low) & (s <= bounds[1, to, j]) & ~same)
                            found.append(((a + c) * lists + j, r, c))
                    of = np.concatenate([f[0] for f in found])
                    if len(of):
                        r, c = (np.concatenate([f[k] for f in found]) for k in (1, 2))
                        best.add(of, s[r, c].astype(np.int64), none[r], key[r], row[r])
        columns = best.entries
        for i in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i:i + (1 << 16)], pa.int64()) for c in columns],
                                             ["list", "score", "none", "key", "row"])

    return run


def _first(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("list").orderBy(F.desc("score"), F.asc("none"), F.asc("key"), F.asc("row"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
            .select("list", "rank", "score", "row", F.when(F.col("none") == 0, F.col("key")).alias("key")))


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         scale: float = 256.0, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
         anchors_per_round: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): the first ``n_negatives`` rows of another label with
    ``low * positive <= 100 * negative <= high * positive``, for the first
    ``n_positives`` rows of the label of each anchor.

    ``is_anchor`` is a condition on ``rows``; whole-number keys are expected.
    """
    spark = rows.sparkSession
    ship_package(spark)
    usable = (F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(
        F.abs(x * F.lit(scale)) <= F.lit(LARGEST), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0)))))
    read = rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("string").alias("label"),
                       F.col(f"`{vector}`").cast("array<double>").alias("vector"),
                       F.coalesce(is_anchor, F.lit(False)).alias("anchor")).filter(usable)
    table = cut(read.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = table.agg(F.count(F.when(F.col("anchor"), 1)).alias("anchors"), F.max(F.size("vector")).alias("width")).first()
    out = None
    rounds = math.ceil(size.anchors / (anchors_per_round or ROUND))
    for n in range(rounds):
        # about ROUND rows; the driver holds the anchors of a round and their positives
        picked = (table.filter(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == n))
                  .select("key", "label", "vector", "row").toArrow().combine_chunks().sort_by("row"))
        if not picked.num_rows:
            continue
        anchors = _matrix(picked.column("vector").combine_chunks(), scale, size.width)
        labels, ids, keys = picked["label"].to_pylist(), picked["row"].to_numpy(), picked["key"].to_pylist()
        columns = table.select("key", "label", "vector", "row")
        box = spark.sparkContext.broadcast((anchors, labels, ids, None))
        positives = _first(columns.mapInArrow(_scan(box, scale, n_positives), _FOUND), n_positives).collect()
        bounds = np.stack([np.ones((len(labels), n_positives), np.int64), np.zeros((len(labels), n_positives), np.int64)])
        queries = []
        for p in positives:
            bounds[:, p["list"], p["rank"] - 1] = (-(-low * p["score"] // 100), high * p["score"] // 100)
            queries.append((p["list"] * n_positives + p["rank"] - 1, keys[p["list"]], p["key"], p["score"]))
        box.unpersist()
        box = spark.sparkContext.broadcast((anchors, labels, ids, bounds))
        negatives = _first(columns.mapInArrow(_scan(box, scale, n_negatives), _FOUND), n_negatives)
        asked = spark.createDataFrame(queries, "list bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        result = cut(negatives.join(asked, "list").select(
            "anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), f"negatives-{n}")
        box.unpersist()
        out = result if out is None else out.unionByName(result)
    if out is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                         "positive_score bigint, negative_score bigint")
    return out
