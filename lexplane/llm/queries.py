"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_lines, op2_warc, op3_mixing, op4_forest, op5_divergence, op6_sstable, op7_ordinal, op8_toxicity, op9_bpe, op10_simhash, op11_sentencepiece, op12_merkle, op13_alignment
from .common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op1_lines.drop_boilerplate(Scratch(spark, "op1"), _read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op2_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    archives = op2_warc.write_monolithic(scratch, op2_warc.revisits(scratch, _read(spark, sf_dir, "pages")))
    return op2_warc.read_archives(op2_warc.normalise(scratch, archives))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op3_mixing.decisions(Scratch(spark, "op3"), _read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_forest.near_duplicates(Scratch(spark, "op4"), _read(spark, sf_dir, "embeddings"))


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_divergence.quality(Scratch(spark, "op5"), _read(spark, sf_dir, "documents"))


def op6_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = op9_bpe.default_vocab()
    return op6_sstable.read_shards(op6_sstable.write_shards(Scratch(spark, "op6"), _read(spark, sf_dir, "documents"), path))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return op7_ordinal.classify(docs, op7_ordinal.train(docs, _read(spark, sf_dir, "labels")))


def op8_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return op8_toxicity.score(docs, op8_toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op9_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_bpe.digests(_read(spark, sf_dir, "documents"), *op9_bpe.default_vocab())


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op10")
    fps = scratch.table(op10_simhash.fingerprints(_read(spark, sf_dir, "documents")), "fingerprints")
    out = op10_simhash.near_duplicates(scratch, fps)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_sentencepiece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_sentencepiece.digests(_read(spark, sf_dir, "documents"), op11_sentencepiece.default_model())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = op12_merkle.document_leaves(_read(spark, sf_dir, "documents"))
    return op12_merkle.prove(*op12_merkle.manifest(Scratch(spark, "op12"), leaves))


def op13_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = (*op9_bpe.default_vocab(), op11_sentencepiece.default_model())
    return op13_alignment.alignments(Scratch(spark, "op13"), _read(spark, sf_dir, "documents"), *both)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_warc_normalise, op3_mix_sources, op4_embedding_forest, op5_divergence_rules, op6_sstable_shards, op7_ordinal_quality, op8_weak_toxicity, op9_speculative_bpe, op10_simhash_trie, op11_sentencepiece_offsets, op12_merkle_manifest, op13_segment_alignment)}

_WS = r"[\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op1_line_dedup": rf"""
WITH lines AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
seen AS (SELECT source, unnest(list_distinct(list_transform(ls, lambda x: regexp_replace(x, '^{_WS}|{_WS}$', '', 'g')))) AS line FROM lines),
pages AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
bad AS (SELECT s.source, list(s.line) AS ls FROM (SELECT source, line, count(*) AS n FROM seen WHERE line <> '' GROUP BY source, line) s
        JOIN pages p ON s.source IS NOT DISTINCT FROM p.source WHERE s.n >= 3 AND s.n > 0.1 * p.n GROUP BY s.source),
kept AS (SELECT doc_id, l.source, text, l.ls, CASE WHEN b.ls IS NULL THEN l.ls ELSE list_filter(l.ls, lambda x: NOT list_contains(b.ls, regexp_replace(x, '^{_WS}|{_WS}$', '', 'g'))) END AS ks
         FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(ks), 0)::BIGINT AS n_dropped,
       length(CASE WHEN len(ks) < len(ls) THEN array_to_string(ks, chr(10)) ELSE text END)::BIGINT AS kept_chars,
       md5(CASE WHEN len(ks) < len(ls) THEN array_to_string(ks, chr(10)) ELSE text END) AS kept_md5
FROM kept""",
}
