"""Token counts: rollups by source, language and tokenizer version, kept up
by signed deltas.

A store is a folder in shared storage.  A batch of changes (inserts, deletes,
revised counts) is turned into signed rows (sign, n_tokens) per document:

- insert: +1 with the new count
- delete: -1 with what the store holds of that document and version
- revise: both

The rows are written first, under ``batch=<id>/rows``; their sums by source,
language and version, a row a group, then under ``batch=<id>/rollup``.
Totals add up the batches' rollups, in any order, and never read documents;
the rows are there to look up what a later change takes away: a document's
present count is the sum of its signed rows.  A batch counts once its rollup
has Spark's ``_SUCCESS`` file: committing an id again does nothing, and a
commit that was cut off is written anew.  ``compact`` folds the batches
committed so far into one base of net rows and one rollup; a reader sees
either the old batches or the new base, as the base names what it holds.

Deletes and revisions of what the store doesn't hold do nothing (as deletes)
or insert (as revisions); an insert of what it holds is a revision, so a
batch that repeats a row, or an insert, can't count a document twice.  Of
several changes of one document and version in a batch the one with the
largest ``seq`` counts.  A null source or language is a group of its own; a
change with a null doc_id or version, or an unknown op, is refused: it moves
no total, and is counted in its group's ``n_refused``.  A null text has no
tokens.  An empty batch commits.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator, Mapping
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, ship_package
from .word_ids import encoder

_DELTA = "doc_id long, source string, lang string, tokenizer string, sign int, n_tokens long, refused int"
_ROLLUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_refused long"

_COUNTERS: dict[str, Callable[[str | None], int]] = {}


def _counter(path: str, pattern: str | None) -> Callable[[str | None], int]:
    """Number of tokens of a text: ``.tiktoken`` ranks with the pattern that
    parts words, else a word vocabulary."""
    if not path.endswith(".tiktoken"):
        encode = encoder(path).encode
        return lambda text: len(encode(text)) // 4
    if path not in _COUNTERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode_bytes = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _COUNTERS[path] = lambda text: len(encode_bytes.encode_ordinary(text or ""))
    return _COUNTERS[path]


def count_versions(docs: DataFrame, versions: Mapping[str, tuple[str, str | None]],
                   texts: Mapping[str, str] = MappingProxyType({"text": "n_tokens"})) -> DataFrame:
    """A row for each row of ``docs`` and tokenizer version ({name: (file,
    word pattern)}), with ``tokenizer`` and the counts of ``count_tokens``.
    One pass over the texts counts all versions."""
    ship_package(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in texts]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept],
                       *[F.col(f"`{t}`").alias(f"__text{i}") for i, t in enumerate(texts)])
    counts = list(texts.values())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["tokenizer string"]
                       + [f"`{n}` long" for n in counts])
    names = [f.name for f in kept] + ["tokenizer"] + counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {name: _counter(*file) for name, file in versions.items()}
        for batch in batches:
            own = batch.columns[:len(kept)]
            texts_of = batch.columns[len(kept):]
            for name, count in counters.items():
                found = [pa.array([count(t.as_py()) for t in c], pa.int64()) for c in texts_of]
                yield pa.RecordBatch.from_arrays([*own, pa.array([name] * batch.num_rows, pa.string()), *found], names=names)

    return rows.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, tokenizer_path: str, texts: Mapping[str, str] = MappingProxyType({"text": "n_tokens"})) -> DataFrame:
    """``docs`` with the number of tokens of each whole text column in
    ``texts`` ({text column: name of its count}) instead of the texts.  A map:
    no text is shuffled."""
    ship_package(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in texts]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept],
                       *[F.col(f"`{t}`").alias(f"__text{i}") for i, t in enumerate(texts)])
    counts = list(texts.values())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` long" for n in counts])
    names = [f.name for f in kept] + counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            columns = batch.columns
            found = [pa.array([len(encode(t.as_py())) // 4 for t in c], pa.int64()) for c in columns[len(kept):]]
            yield pa.RecordBatch.from_arrays([*columns[:len(kept)], *found], names=names)

    return rows.mapInArrow(run, schema)


class RollupStore:
    """Signed deltas under ``path``; ``path`` must be shared by all executors."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[str]:
        """Names of the complete folders of a kind."""
        root = self._fs_path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory()]
        return sorted(n for n in names if n.startswith(kind + "=")
                      and self._fs.exists(self._fs_path(f"{self.path}/{n}/rollup/_SUCCESS")))

    def batches(self) -> list[str]:
        """Ids of the committed batches, folded ones included."""
        folded = self._folded()
        return sorted(folded | {n.split("=", 1)[1] for n in self._committed("batch")})

    def _base(self) -> str | None:
        bases = self._committed("base")
        return max(bases, key=lambda n: int(n.split("=")[1])) if bases else None

    def _folded(self) -> set[str]:
        base = self._base()
        if base is None:
            return set()
        return {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/folded-{base}").collect()}

    def _read(self, part: str, schema: str) -> DataFrame:
        """``rows`` or ``rollup`` of all batches that count."""
        folded, base = self._folded(), self._base()
        paths = [f"{self.path}/{n}/{part}" for n in self._committed("batch") if n.split("=", 1)[1] not in folded]
        paths += [f"{self.path}/{base}/{part}"] if base else []
        if not paths:
            return self.spark.createDataFrame([], schema)
        # the folders' names are no columns
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)

    def deltas(self) -> DataFrame:
        """All signed rows that count."""
        return self._read("rows", _DELTA)

    def present(self) -> DataFrame:
        """The documents that the store holds, with their counts."""
        return (self.deltas().groupBy("doc_id", "source", "lang", "tokenizer")
                .agg(F.sum("sign").alias("n"), F.sum("n_tokens").alias("n_tokens"))
                .filter("n > 0").drop("n"))

    def report(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_refused: the batches'
        rollups added up."""
        return (self._read("rollup", _ROLLUP).groupBy("source", "lang", "tokenizer")
                .agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_refused")])
                .filter("n_docs != 0 or n_tokens != 0 or n_refused != 0"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        return self.report().filter("n_docs != 0 or n_tokens != 0").drop("n_refused")

    def _write(self, folder: str, rows: DataFrame, rollup: DataFrame | None = None) -> None:
        """The rows, then the rollup (of the rows written, if none is given)."""
        rows.write.mode("overwrite").parquet(f"{folder}/rows")
        if rollup is None:
            rollup = (self.spark.read.schema(_DELTA).parquet(f"{folder}/rows").groupBy("source", "lang", "tokenizer")
                      .agg(F.sum("sign").cast("long").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
                           F.sum("refused").cast("long").alias("n_refused")))
        rollup.coalesce(1).write.mode("overwrite").parquet(f"{folder}/rollup")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes (op, doc_id, source, lang, tokenizer,
        n_tokens, and optionally seq); False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
            raise ValueError("a batch id has letters, digits, _ and - only")
        if batch_id in self.batches():
            return False
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        latest = changes.filter(_sound()).groupBy("doc_id", "tokenizer").agg(
            F.max_by(F.struct("op", "source", "lang", "n_tokens"), F.struct(seq.alias("s"), "op", "n_tokens")).alias("x"))
        new = latest.select(F.col("doc_id"), F.col("tokenizer"), "x.*")
        if self.batches():
            # what the store holds of the changed documents goes
            out = self.present().join(new.select("doc_id", "tokenizer").distinct(), ["doc_id", "tokenizer"], "left_semi")
            gone = out.select("doc_id", "source", "lang", "tokenizer", F.lit(-1).alias("sign"), (-F.col("n_tokens")).alias("n_tokens"),
                              F.lit(0).alias("refused"))
        else:
            gone = self.spark.createDataFrame([], _DELTA)
        come = new.filter("op != 'delete'").select(
            F.col("doc_id").cast("long"), "source", "lang", "tokenizer", F.lit(1).alias("sign"),
            F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens"), F.lit(0).alias("refused"))
        unsound = changes.filter(~F.coalesce(_sound(), F.lit(False))).select(
            F.col("doc_id").cast("long"), "source", "lang", "tokenizer", F.lit(0).alias("sign"),
            F.lit(0).cast("long").alias("n_tokens"), F.lit(1).alias("refused"))
        self._write(f"{self.path}/batch={batch_id}", gone.unionByName(come).unionByName(unsound))
        return True

    def compact(self) -> None:
        """Fold all committed batches into one base of net rows."""
        batches = self.batches()
        last = self._base()
        number = int(last.split("=")[1]) + 1 if last else 0
        # first what it will hold; it counts once the base itself is complete
        (self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/folded-base={number}"))
        self._write(f"{self.path}/base={number}", self.present().select(
            "doc_id", "source", "lang", "tokenizer", F.lit(1).alias("sign"), "n_tokens", F.lit(0).alias("refused")), self.report())


def _sound() -> Column:
    return F.col("doc_id").isNotNull() & F.col("tokenizer").isNotNull() & F.col("op").isin("insert", "delete", "revise")


def refused(changes: DataFrame) -> DataFrame:
    """The number of changes that a commit leaves out."""
    return changes.filter(~F.coalesce(_sound(), F.lit(False))).agg(F.count(F.lit(1)).alias("refused"))


def new_store(spark: SparkSession) -> RollupStore:
    """A store in a new folder of the shared storage."""
    return RollupStore(spark, scratch_path(spark, "rollup"))
