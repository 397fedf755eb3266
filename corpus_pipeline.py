"""From raw documents to token ids: toxicity, line and near-duplicate removal, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes every stage but the
last as Parquet under ``spark.checkpoint.dir`` and reads it again. The stages carry the five columns of ``documents``
and ignore others; ``n_chars`` follows the text. Stage by stage:

* toxicity: documents predicted toxic go; the scorer is fitted on the stage's own documents.
* line dedup: repeated lines go; a null text becomes empty. No document goes.
* near dedup: one document of each group stays; of rows that share its doc_id, the first by content. Rows
  without a doc_id stay.
* source mix: a row for each repeat, in training order; a document taken in part keeps its first words. Rows
  without a doc_id or words cannot be taken.
* sentence pieces: the ids of each row.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.llm import lines, minhash, mixing, sentence_pieces
from stallwise.llm.common import WORD, kept, table
from stallwise.llm.queries import ORACLES, QUERIES
from stallwise.llm.toxicity import Toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = Toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(lines.drop_lines(docs, carry=["lang", "source"]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = (docs.join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r"))
           .select("doc_id", *(F.col(f"r.{c}") for c in rest)))
    return one.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.where("doc_id is not null")  # before the targets are set, so that others make up for them
    shares = (mixing.mix(docs).where("taken > 0").select("doc_id", "size", F.explode("shares").alias("share"))
              .select("doc_id", "size", "share.words", "share.position"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    rows = docs.select(*COLUMNS).join(shares, "doc_id").withColumn(
        "text", F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text")))
    return _sized(rows.orderBy("position", "doc_id"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "source"])


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates),
          ("source_mix", mix_sources), ("sentence_pieces", encode_pieces)]

#: Boosted trees have no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
