"""The registered queries of the text operators, and DuckDB SQL for those that
SQL can express.  Each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, exact_dedup, fertility, gru_lm, hard_negatives, langid, mixing, near_dup, packing, pii, secrets,
               token_counts, url_filter)
from .common import cut, documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: rules, then segmented host words and naive Bayes."""
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document by tokeniser fertility."""
    import public_tokenizers

    return fertility.judge(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"),
                           tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                           labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: patterns, and Markov models of random strings."""
    return secrets.digest(secrets.secrets(documents(spark, sf_dir)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts; the largest doc_id stays."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: patterns, and bootstrapped contexts."""
    return pii.digest(pii.personal_data(documents(spark, sf_dir)))


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter is held out of training."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    net = langid.fit(docs.filter(~F.coalesce(_held_out(), F.lit(False))))
    found = langid.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, counted from the rows
    dealt to the shards (which the SQL's columns leave out)."""
    return mixing.mix(documents(spark, sf_dir)).drop("shards")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates; the smallest doc_id stays."""
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version, for two
    versions, after three batches: all documents come in; toxic ones are
    deleted and low-quality ones recounted without their symbols; the last
    batch is sent twice.  The totals are the sums of the batches' rollups.

    All counts come from one pass over the texts, so only numbers are joined
    with the labels."""
    import public_tokenizers

    symbols = r"[#*$%&|<>]+"
    docs = documents(spark, sf_dir).select(
        "doc_id", "source", "lang", "text",
        F.when(F.rlike("text", F.lit(symbols)), F.regexp_replace("text", symbols, "")).alias("clean"))
    store = token_counts.new_store(spark)
    versions = {"word_bpe_49k": (tokenizer_file("word_bpe_49k.json"), None),
                "byte_bpe_50k": (tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)}
    counted = cut(token_counts.count_versions(docs.withColumn("changed", F.col("clean").isNotNull()), versions,
                                              {"text": "n_tokens", "clean": "n_clean"}), "counted")
    store.commit("load", counted.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", "tokenizer", "n_tokens"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    revised = counted.join(labels.filter("quality = 0 and toxic = 0"), "doc_id").select(
        F.lit("revise").alias("op"), "doc_id", "source", "lang", "tokenizer",
        F.when(F.col("changed"), F.col("n_clean")).otherwise(F.col("n_tokens")).alias("n_tokens"))
    deleted = labels.filter("toxic = 1").select(
        F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("lang"), F.explode(F.array(*map(F.lit, versions))).alias("tokenizer"),
        F.lit(0).cast("long").alias("n_tokens"))
    changes = revised.unionByName(deleted)
    for _ in range(2):
        store.commit("labels", changes)
    return store.report()


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is noise."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    noisy = vectors.select("vec_id", "embedding", F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (label + 1) % 10)
                           .otherwise(label).alias("label"))
    return hard_negatives.mine(noisy, F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of 2 to 5 words of every language."""
    return collocations.collocations(documents(spark, sf_dir))


def op13_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document; a seventh is held out of training."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return gru_lm.score(documents(spark, sf_dir), held_out)


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_best_fit_packing, op3_fertility, op4_secrets, op5_exact_dedup, op6_pii, op7_language_id,
    op8_mixing, op9_minhash_near_dedup, op10_token_rollups, op11_hard_negatives, op12_collocations,
    op13_gru_lm)}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

ORACLE = {
    "op5_exact_dedup": f"""
        with d as (select doc_id, {_ASCII_LOWER} as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept,
               sha256(d.t) as text_sha256
        from d join g on d.t = g.t""",
    "op8_mixing": f"""
        with d as (
          select doc_id, source, cast({_WORDS} as bigint) as size,
                 substr(md5('mix|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 4) as block
          from documents),
        s as (
          select source, cast(sum(size) as bigint) as source_size,
                 [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
          from d group by source),
        l as (
          select a.*, (select cast(sum(source_size) as bigint) from s) as total,
                 (select coalesce(sum(3 * b.source_size), 0) from s b
                  where 3 * b.source_size / b.w < 3 * a.source_size / a.w) as caps,
                 (select sum(b.w) from s b where 3 * b.source_size / b.w >= 3 * a.source_size / a.w) as rest
          from s a),
        t as (
          select source, source_size,
                 least(cast(3 * source_size as double),
                       (select max(cast(total - caps as double) / rest) from l) * w) as target
          from l),
        b as (
          select d.source, d.block, cast(sum(size) as bigint) as words from d group by 1, 2),
        c as (
          select b.source, b.block, b.words, t.source_size, t.target,
                 case when source_size > 0 then floor(target / source_size) else 0 end as epochs,
                 sum(words) over (partition by b.source order by b.block) as upto,
                 row_number() over (partition by b.source order by b.block) as place
          from b join t on b.source is not distinct from t.source),
        q as (
          select *, target - epochs * source_size as part,
                 sum(case when target - epochs * source_size > 0
                           and upto - (target - epochs * source_size) <= (target - epochs * source_size) - (upto - words)
                     then 1 else 0 end) over (partition by source) as quota
          from c)
        select d.doc_id, d.size, q.source_size, q.target,
               cast(d.size * (q.epochs + case when q.place <= q.quota then 1 else 0 end) as bigint) as taken
        from d join q on d.source is not distinct from q.source and d.block = q.block""",
    "op11_hard_negatives": """
        with v as (
          select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label,
                 list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
          from embeddings
          where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
        s as (
          select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
                 cast(list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2])) as bigint) as score
          from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
        p as (
          select anchor_id, vec_id as positive_id, score as positive_score from s where same
          qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        n as (
          select p.*, s.vec_id as negative_id, s.score as negative_score,
                 row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
          from p join s using (anchor_id)
          where not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
        select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score
        from n where rank <= 5""",
    "op12_collocations": f"""
        with d as (select coalesce(lang, 'und') as lang, {_ASCII_LOWER} as t, row_number() over () as d from documents),
        p as (
          select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w
          from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d)),
        o as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
        g as (select lang, w[i : i + k - 1] as ws from o, range(1, 6) r(k) where i + k - 1 <= len(w)),
        f as (select lang, len(ws) as k, array_to_string(ws, ' ') as phrase, any_value(ws) as ws, count(*) as f
              from g group by 1, 2, 3),
        sizes as (select lang, sum(f) as n from f where k = 1 group by lang),
        c as (select * from f where k > 1 and f >= 100),
        around as (
          select lang, phrase, max(f) as f from (
            select lang, f, array_to_string(ws[1 : k - 1], ' ') as phrase from c
            union all select lang, f, array_to_string(ws[2 : k], ' ') from c) group by 1, 2),
        kept as (select c.* from c left join around a using (lang, phrase) where a.f is null or a.f < c.f),
        cuts as (
          select c.lang, c.phrase, c.f as a, j, array_to_string(c.ws[1 : j], ' ') as lp,
                 array_to_string(c.ws[j + 1 : k], ' ') as rp
          from kept c, range(1, 5) r(j) where j < k),
        s as (
          select x.lang, x.phrase, x.a, x.j, l.f as l, r.f as r, n.n,
                 (1000 * cast(x.a as hugeint) * cast(n.n as hugeint)) // (cast(l.f as hugeint) * cast(r.f as hugeint)) as score
          from cuts x join f l on l.lang = x.lang and l.phrase = x.lp join f r on r.lang = x.lang and r.phrase = x.rp
          join sizes n on n.lang = x.lang),
        best as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1)
        select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint) as rank,
               phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n,
               cast(score as bigint) as score
        from best qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000""",
}
