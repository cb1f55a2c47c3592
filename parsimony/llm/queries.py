"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotrain, ctw, decontaminate, linededup, pii, sharding, simhash, template, topk
from .common import table

#: Where the public vocabulary files lie.
TOKENIZERS = str(Path(public_tokenizers.path("word_bpe_49k.json")).parent)


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 7 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return ctw.score(docs, "doc_id", "text", "held_out")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, "doc_id", "text", tau=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dealt = sharding.shard(docs, ["doc_id", "size", "text_crc32"], 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_bpe(spark: SparkSession, sf_dir: str, path: str = f"{TOKENIZERS}/word_bpe_49k.json") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, "text", Path(path).read_text(encoding="utf-8"), ids=False)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=20, k=20, scale=64)


#: Words of a text in DuckDB, as ``common.words`` finds them, and its shingles.
_WORDS = r"list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def op4_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = cotrain.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", ["lang", "source", "n_chars"])
    return cotrain.score(docs, "text", ["lang", "source", "n_chars"], model).select("doc_id", "p_text", "p_meta", "p_clean", "keep")


def op5_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return template.extract_all(pages, "page_id", "url", "html")


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.dedup(docs, "doc_id", "text", "source").select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


OP6_SQL = """
WITH split AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
lines AS (SELECT doc_id, source, pos, raw, trim(raw, ' ') AS line FROM split),
wide AS (SELECT line FROM lines WHERE length(line) >= 16 GROUP BY line HAVING count(DISTINCT source) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.raw,
         w.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.pos) > 1 AS gone
  FROM lines l LEFT JOIN wide w ON l.line = w.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       length(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), ''))::BIGINT AS n_chars,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    hits = decontaminate.contained(docs, items, "doc_id", "text", "item_id", "text")
    return hits.select("doc_id", "item_id", "n_item", "n_hit")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_hit FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_hit::BIGINT AS n_hit FROM h JOIN n USING (item_id) WHERE n_hit * 100 >= n_item * 80
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, "text", pii.train(docs, "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op1_ctw": op1_ctw, "op2_simhash": op2_simhash, "op3_sharding": op3_sharding, "op4_cotrain": op4_cotrain, "op5_template": op5_template}
QUERIES |= {"op6_linededup": op6_linededup, "op7_bpe": op7_bpe, "op8_decontaminate": op8_decontaminate}
QUERIES |= {"op9_topk": op9_topk, "op10_pii": op10_pii}
SQL = {"op6_linededup": OP6_SQL, "op8_decontaminate": OP8_SQL}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    return QUERIES | {"pipeline": pipeline}


def oracle_sql() -> dict:
    return dict(SQL)
