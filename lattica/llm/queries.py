"""The registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ballhash, cotrain, countmin, frames, packing, pii, secrets, shuffle, simhash, tiling
from .tokens import public


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_table(spark, sf_dir)).drop("linked")


def op2_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = frames.write_frames(_table(spark, sf_dir), public("byte_bpe_50k.json"), end=0)
    back = frames.read_frames(spark, frames.offsets(files))
    return back.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_near(simhash.with_next(_table(spark, sf_dir)), bits=128)


def op4_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ballhash.near_duplicates(_table(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classified(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op6_uniform_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle.shuffled(_table(spark, sf_dir).select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark")).drop("tiles")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir))


def pack_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> their tokens in sequences of at most 2048, a row a piece.

    Null text: as empty. Null, repeated and equal rows are documents of their own; other columns are ignored. Empty
    table: no rows.
    """
    out = packing.packed(packing.tokenized(docs, public("word_bpe_49k.json")), rows=docs.count())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countmin.without_repeats(_table(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir)
    return pii.find_documents(docs, pii.train(docs))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op1's base findings."""
    return secrets.scan_documents(_table(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 fingerprints beside the documents."""
    return simhash.with_next(_table(spark, sf_dir), marks=False).select("doc_id", "n_chars", "edited_sha256")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's shards: rows, slots and bytes of all."""
    g = op6_uniform_shuffle(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"))
    return g


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op10's base findings."""
    return pii.find_documents(_table(spark, sf_dir), pii.SkipChain.fit({})).select("doc_id", *[f"n_{k}" for k in pii.KINDS])


def sequence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8's documents: that their pieces are all there is of them."""
    out = op8_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.max("doc_tokens").alias("doc_tokens"), F.min("start").alias("first"))
    return out.select("doc_id", (F.col("tokens") == F.col("doc_tokens")).alias("whole"), "first")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_seekable_frames, op3_simhash, op4_ball_hashing, op5_cotraining, op6_uniform_shuffle, op7_string_tiling, op8_packing, op9_repeated_windows, op10_personal_data, base_secrets, edited_texts, shard_sizes, base_personal_data, sequence_tokens)}

ORACLES = {
    "op9_repeated_windows": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
p as (select doc_id, words, unnest(range(1, len(words) - 11)) as i from d where len(words) >= 13),
w as (select doc_id, i, array_to_string(words[i:i+12], ' ') as window_words from p),
first as (select window_words, min(doc_id) as least from w group by 1),
gone as (select distinct w.doc_id, unnest(range(w.i, w.i + 13)) as spot from w join first using (window_words) where first.least < w.doc_id),
marks as (select doc_id, list(spot) as spots from gone group by 1)
select d.doc_id, len(words)::bigint as n_words, coalesce(len(spots), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda j: spots is null or not list_contains(spots, j)), lambda j: words[j]), ' '), '')) as kept_sha256
from d left join marks using (doc_id)""",
    "base_secrets": r"""
select doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 6))::bigint as n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20))::bigint as n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 24))::bigint as n_hex from documents""",
    "edited_texts": r"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(lead(coalesce(text, '')) over (order by doc_id), first_value(coalesce(text, '')) over (order by doc_id)) as nxt from documents)
select doc_id, length(text)::bigint as n_chars, sha256(substring(text, 1, length(text) - length(text) // 2) || substring(nxt, 1, length(text) // 2)) as edited_sha256 from d""",
    "shard_sizes": """
select shard::int as shard, (n // 8 + case when shard < n % 8 then 1 else 0 end)::bigint as n, (n // 8 + case when shard < n % 8 then 1 else 0 end)::bigint as slots,
  (n // 8 + case when shard < n % 8 then 1 else 0 end - 1)::bigint as last from (select count(*) as n from documents), unnest(range(8)) u(shard)""",
    "base_personal_data": r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
m as (select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::bigint as n_email,
  len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::double)) <= 255))::bigint as n_ip,
  list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as cards,
  len(list_filter(list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))), lambda n: n between 9 and 15))::bigint as n_phone from d)
select doc_id, n_email, n_ip, n_phone, len(list_filter(cards, lambda x: length(x) between 12 and 19 and
  list_sum(list_transform(range(1, length(x) + 1), lambda i: case when i % 2 = 1 then substring(x, length(x) - i + 1, 1)::int else (2 * substring(x, length(x) - i + 1, 1)::int) // 10 + (2 * substring(x, length(x) - i + 1, 1)::int) % 10 end)) % 10 = 0))::bigint as n_card from m""",
    "sequence_tokens": "select doc_id, true as whole, 0::bigint as first from documents",
}
