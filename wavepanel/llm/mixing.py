"""Mixing sources to target weights by a splitting tree.

1. Targets: the sources share all words by weight; a target stops at
   ``max_epochs`` times its source's words, and the excess is shared again
   among the others by weight until none is above.
2. Blocks: a hash of the row permutes each source's documents and cuts them
   into ``BLOCKS`` blocks at most.  A source's quota is a number of blocks:
   all of them once per whole epoch, and of the last epoch as many of the
   permuted ones as come nearest to the target.  So a source misses its
   target by less than a block, 1/65536 of its documents (one document, in a
   source of fewer documents).
3. Splitting tree: the quotas are halved among the output shards, level by
   level; what goes left is a multivariate hypergeometric draw without
   replacement (source by source, by inversion of a hash), so shards have
   equal numbers of blocks and the quotas are met exactly.
4. Each shard takes its numbers of blocks from each source's permuted list,
   one after the other, so shards are disjoint; a second hash shuffles the
   documents inside the shard.

All randomness is a hash of (seed, row), so reruns and recomputed tasks
agree.  Per-source tables have a row per source; the per-block table at most
65536 rows per source, whatever the size of the corpus.

A null text has size 0.  A null source is a source of its own, last in
order.  Documents of size 0 are taken as often as their block; that adds no
words.  Rows that repeat all columns share a block and are taken alike.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, n_words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCKS = 65536
SHARDS = 16
#: Blocks that one number holds as bits.
WORD = 32
#: Sources whose rows of ``_deals`` (some 33 kB each) are broadcast; with more of them
#: documents meet the per-block table in a join by source and block.
SENT = 1000
SEED = "mix"


def _key(docs: DataFrame, doc_id: str, text: str) -> Column:
    """The hash that permutes the rows."""
    return F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(docs[f"`{doc_id}`"].cast("string"), F.lit("")),
                             F.coalesce(docs[f"`{text}`"], F.lit(""))))


def _block(key: Column) -> Column:
    """One of BLOCKS from the first four hexadecimal digits."""
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id, _source, size and _block of every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("_source"), n_words(F.col(text)).alias("size"),
                       _block(_key(docs, doc_id, text)).alias("_block"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to a table with a row per source (_source, source_size).

    With sources in order of cap / weight, the capped ones come first.  If
    the first k are capped, the others share at the level (all words - their
    caps) / the others' weights; that level grows with k as long as the next
    one is rightly capped and falls beyond, so the largest is the true one.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("_w", w.cast("long")).withColumn("_cap", max_epochs * F.col("source_size"))
    by_level = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = (rows.withColumn("_total", F.sum("source_size").over(whole))
            .withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
            .withColumn("_rest", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
            .withColumn("_level", (F.col("_total") - F.col("_caps")).cast("double") / F.col("_rest")))
    return (rows.withColumn("_at", F.max("_level").over(whole))
            .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_at") * F.col("_w")))
            .select("_source", "source_size", "target"))


def _quotas(blocks: DataFrame, target: DataFrame) -> DataFrame:
    """Per block: _source, _block, _rank (in permuted order, from 0), _n
    (blocks of the source), source_size, target, _epochs, _last (blocks of
    the last, partial epoch)."""
    order = Window.partitionBy("_source").orderBy("_block")
    whole = Window.partitionBy("_source")
    joined = blocks.join(target, blocks["_source"].eqNullSafe(target["_source"])).drop(target["_source"])
    part = (joined.withColumn("_rank", F.row_number().over(order) - 1)
            .withColumn("_n", F.count(F.lit(1)).over(whole))
            .withColumn("_epochs", F.when(F.col("source_size") > 0,
                                          F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("_part", F.col("target") - F.col("_epochs") * F.col("source_size"))
            .withColumn("_sum", F.sum("_words").over(order)))
    # a block is in the last epoch if its end is nearer to the target than its start
    near = F.col("_sum") - F.col("_part") <= F.col("_part") - (F.col("_sum") - F.col("_words"))
    return part.withColumn("_last", F.sum(F.when(near & (F.col("_part") > 0), 1).otherwise(0)).over(whole))


def _uniform(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def hypergeometric(good: Column, bad: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``draws`` drawn without replacement are good ones: by
    inversion, from the mode outwards (10 standard deviations to each side,
    beyond which less than 1e-20 lies)."""
    whole = good + bad
    lo, hi = F.greatest(F.lit(0), draws - bad), F.least(good, draws)
    mode = F.least(hi, F.greatest(lo, F.floor((draws + 1) * ((good + 1) / (whole + 2))).cast("long")))
    spread = (F.ceil(10 * F.sqrt(draws * (good / whole) * (bad / whole) + 1)) + 10).cast("long")
    none = F.array().cast("array<bigint>")

    def drawn(v: Column) -> Column:
        up = F.when(v["top"] > v["mode"], F.sequence(v["mode"] + 1, v["top"])).otherwise(none)
        down = F.when(v["low"] < v["mode"], F.sequence(v["mode"] - 1, v["low"], F.lit(-1).cast("long"))).otherwise(none)
        # masses relative to the mode's: that of k from its inner neighbour's
        rise = lambda k: (good - k + 1) * (draws - k + 1) / (k * (bad - draws + k + 0.0))
        fall = lambda k: (k + 1) * (bad - draws + k + 1) / ((good - k) * (draws - k + 0.0))

        def side(start: Column, steps: Column, ratio) -> Column:
            """Sums of masses outwards from the mode."""
            return F.aggregate(steps, F.struct(F.lit(1.0).alias("p"), start.alias("sum")), lambda a, k: F.struct(
                (a["p"] * ratio(k)).alias("p"), (a["sum"] + a["p"] * ratio(k)).alias("sum")))["sum"]

        def pick(start: Column, steps: Column, ratio, at: Column) -> Column:
            """The place where the running sum first exceeds ``at``."""
            return F.aggregate(steps, start, lambda a, k: F.struct(
                (a["p"] * ratio(k)).alias("p"), (a["sum"] + a["p"] * ratio(k)).alias("sum"),
                F.when((a["hit"] < 0) & (a["sum"] + a["p"] * ratio(k) > at), k).otherwise(a["hit"]).alias("hit")))

        def choose(at: Column) -> Column:
            begin = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"),
                             F.when(at < 1.0, v["mode"]).otherwise(F.lit(-1).cast("long")).alias("hit"))
            return let(pick(begin, up, rise, at), lambda r: let(
                pick(F.struct(F.lit(1.0).alias("p"), r["sum"].alias("sum"), r["hit"].alias("hit")), down, fall, at),
                lambda s: F.when(s["hit"] >= 0, s["hit"]).otherwise(v["mode"])))

        return let(uniform * side(side(F.lit(1.0), up, rise), down, fall), choose)

    ends = F.struct(mode.alias("mode"), F.least(hi, mode + spread).alias("top"), F.greatest(lo, mode - spread).alias("low"))
    return F.when((whole <= 0) | (draws <= 0), F.lit(0).cast("long")).otherwise(let(ends, drawn))


def shard_quotas(quota: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(_source, _blocks) rows split among shards: (_shard, _source, _count,
    _start), _start the first place in the source's list that the shard takes.

    ``shards`` is a power of two.  Each level turns a node's row into two,
    with the counts of all sources in one array (a row per source there)."""
    node = quota.groupBy().agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce(F.col("_source"), F.lit("")).alias("s"), F.col("_source").isNull().alias("null"),
        F.col("_blocks").alias("n")))).alias("of")).select(F.lit(0).alias("_shard"), "of")
    total = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    level = 1
    while level < shards:
        start = F.struct(F.floor(total(F.col("of")) / 2).cast("long").alias("draws"), total(F.col("of")).alias("rest"),
                         F.array().cast("array<bigint>").alias("left"))

        number = F.lit(level)

        def draw(a, x):
            got = hypergeometric(x["n"], a["rest"] - x["n"], a["draws"],
                                 _uniform(F.lit(seed), number, F.col("_shard"), x["s"], x["null"]))
            # the draw is one struct field, read twice
            return F.aggregate(F.array(got), a, lambda b, g: F.struct(
                (b["draws"] - g).alias("draws"), (b["rest"] - x["n"]).alias("rest"),
                F.array_append(b["left"], g).alias("left")))

        node = node.withColumn("_left", F.aggregate(F.col("of"), start, draw)["left"])
        side = lambda n: F.transform(F.col("of"), lambda x, i: F.struct(
            x["s"].alias("s"), x["null"].alias("null"), n(x, F.get(F.col("_left"), i)).alias("n")))
        node = node.select(F.explode(F.array(
            F.struct((F.col("_shard") * 2).alias("_shard"), side(lambda x, g: g).alias("of")),
            F.struct((F.col("_shard") * 2 + 1).alias("_shard"), side(lambda x, g: x["n"] - g).alias("of")))).alias("x")
        ).select("x.*")
        node = cut(node, "tree")
        level *= 2
    order = Window.partitionBy("_source").orderBy("_shard")
    return (node.select("_shard", F.explode("of").alias("x"))
            .select("_shard", F.when(~F.col("x.null"), F.col("x.s")).alias("_source"), F.col("x.n").alias("_count"))
            .withColumn("_start", F.sum("_count").over(order) - F.col("_count")))


def _plan(sized: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """One row per block with its source's target and quotas."""
    blocks = sized.groupBy("_source", "_block").agg(F.sum("size").alias("_words"))
    sums = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    return _quotas(blocks, targets(sums, weights, max_epochs))


def _cuts(plan: DataFrame, shards: int) -> DataFrame:
    """Per source (_of) its _shards: structs of a shard and the places from
    start to before end that it takes of the source's list."""
    quota = (plan.groupBy("_source").agg(F.max(F.col("_epochs") * F.col("_n") + F.col("_last")).alias("_blocks")))
    return shard_quotas(quota, shards).groupBy(F.col("_source").alias("_of")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_start").alias("start"), F.col("_shard").alias("shard"),
                                             (F.col("_start") + F.col("_count")).alias("end")))).alias("_shards"))


def _shard_of(place: Column) -> Column:
    return F.filter("_shards", lambda x: (x["start"] <= place) & (place < x["end"]))[0]["shard"]


def _places(plan: DataFrame, shards: int) -> DataFrame:
    """Per taken block (_s, _b) its _takes: structs of the epoch and the shard
    that the block is dealt to in it."""
    # a block's places in its source's list: one per epoch
    places = (plan.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs"))))
              .filter((F.col("_epoch") < F.col("_epochs")) | (F.col("_rank") < F.col("_last")))
              .withColumn("_place", F.col("_epoch") * F.col("_n") + F.col("_rank"))
              .join(_cuts(plan, shards), F.col("_source").eqNullSafe(F.col("_of")))
              .select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), F.col("_epoch"),
                      _shard_of(F.col("_place")).alias("_shard")))
    return cut(places.groupBy("_s", "_b").agg(F.collect_list(F.struct("_epoch", "_shard")).alias("_takes")), "places")


def _deals(plan: DataFrame, shards: int) -> DataFrame:
    """One row per source with all that deals its documents: _s, _epochs, _n,
    _last, _shards, and the blocks that it has as bits (_bits, WORD of them in
    each number) with how many come before each number (_before)."""
    have = plan.select("_source", F.floor(F.col("_block") / WORD).cast("int").alias("_word"),
                       F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_block") % WORD).alias("_bit"),
                       F.col("_rank").cast("long").alias("_at"))
    none = plan.select("_source").distinct().select(
        "_source", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS // WORD - 1))).alias("_word"), F.lit(0).cast("long").alias("_bit"),
        F.lit(None).cast("long").alias("_at"))
    words = have.unionByName(none).groupBy("_source", "_word").agg(F.bit_or("_bit").alias("bits"), F.min("_at").alias("at"))
    # words without a block are never looked up
    listed = words.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct(
        F.col("_word"), "bits", F.coalesce("at", F.lit(0).cast("long")).alias("at")))).alias("_words"))
    sums = plan.select(F.col("_source").alias("_s"), "_epochs", "_n", "_last").distinct()
    return cut(sums.join(listed, F.col("_s").eqNullSafe(F.col("_source")))
               .join(_cuts(plan, shards), F.col("_s").eqNullSafe(F.col("_of")))
               .select("_s", "_epochs", "_n", "_last", "_shards", F.col("_words.bits").alias("_bits"),
                       F.col("_words.at").alias("_before")), "deals")


def _takes(block: Column) -> Column:
    """The _takes of a document's block, as in ``_places``, from its source's row of ``_deals``."""
    word = F.floor(block / WORD).cast("int")
    below = F.call_function("shiftleft", F.lit(1).cast("long"), block % WORD) - 1
    rank = F.get("_before", word) + F.bit_count(F.get("_bits", word).bitwiseAND(below))
    return let(rank, lambda r: F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("_epochs")), lambda e: (e < F.col("_epochs")) | (r < F.col("_last"))),
        lambda e: F.struct(e.alias("_epoch"), let(e * F.col("_n") + r, _shard_of).alias("_shard"))))


def _order(key: Column) -> Column:
    """The place of a take in its shard's shuffle."""
    return F.xxhash64(F.lit(SEED), key, F.col("_take._epoch"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words
    the mix takes of it, repeats counted), shards (those it is dealt to, one
    per copy, in order).

    The rows are dealt and put in order as in ``mixed_rows``, with a row's
    number in place of its columns; the copies are counted from that."""
    key = _key(docs, doc_id, text)
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("_source"), n_words(F.col(text)).alias("size"),
                            key.alias("_key"), _block(key).alias("_block"), F.monotonically_increasing_id().alias("_row")), "sized")
    plan = cut(_plan(sized, weights, max_epochs), "plan")
    dealt = (sized.join(_places(plan, shards), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
             .withColumn("_take", F.explode("_takes"))
             .select("_row", F.col("_take._shard").alias("_shard"), _order(F.col("_key")).alias("_order")))
    # a shard spans several tasks, by the order's range, so none is hot
    mixed = cut(dealt.withColumn("_range", F.shiftrightunsigned("_order", 58)).repartition("_shard", "_range")
                .sortWithinPartitions("_shard", "_order"), "mixed")
    copies = mixed.groupBy(F.col("_row").alias("_r")).agg(
        F.count(F.lit(1)).alias("_copies"), F.sort_array(F.collect_list("_shard")).alias("shards"))
    sources = plan.select(F.col("_source").alias("_s"), "source_size", "target").distinct()
    return (sized.join(sources, F.col("_source").eqNullSafe(F.col("_s"))).join(copies, F.col("_row") == F.col("_r"), "left")
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * F.coalesce("_copies", F.lit(0).cast("long"))).alias("taken"),
                    F.coalesce("shards", F.array().cast("array<int>")).alias("shards")))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int = SHARDS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with
    ``_shard`` and ``_order`` (its place in the shard's shuffle)."""
    sized = _sized(docs, doc_id, text, source)
    plan = cut(_plan(cut(sized.select("_source", "_block", "size"), "sized"), weights, max_epochs), "plan")
    key = "__mix_key"
    rows = docs.withColumn(key, _key(docs, doc_id, text))
    own = F.col(f"`{source}`").eqNullSafe(F.col("_s"))
    if plan.select("_source").distinct().count() <= SENT:
        # the texts are not shuffled to find their places
        found = rows.join(F.broadcast(_deals(plan, shards)), own).withColumn("_takes", _takes(_block(F.col(key))))
    else:
        found = rows.join(_places(plan, shards), own & (_block(F.col(key)) == F.col("_b")))
    return (found.withColumn("_take", F.explode("_takes"))
            .select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_take._shard").alias("_shard"),
                    _order(F.col(key)).alias("_order")))
