"""A training-corpus pipeline over documents (doc_id, text, lang, source, n_chars).

Each stage takes (spark, docs, sf_dir) and returns what it keeps, in the columns of documents; the last returns the
packed sequences. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import language, neardup, packing, secrets, toxicity
from tallyspark.llm.common import fresh, materialize, table
from tallyspark.llm.queries import tokenizer

#: Documents that score at least this much are toxic.
TOXIC = 0.3
#: A margin below this share of the compressed size is too narrow to name a language.
NARROW = 0.001


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents given; keeps documents below TOXIC. Null and empty texts are not toxic, long
    ones are judged whole, repeated rows go or stay together; without labels of both classes nothing goes."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    own = fresh(docs, "toxicity")
    return toxicity.score(docs, model, out_col=own).where(F.col(own) < TOXIC).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones among them) and texts whose margin is narrow, at any length; the
    predicted language fills a null lang. Repeated rows go or stay together; without any learned language all go."""
    dicts = language.learn(docs, F.lit(True))
    own = "found_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = "_" + own
    out = language.identify(docs, dicts, narrow=NARROW, prefix=own).where(~F.col(f"{own}rejected"))
    return out.withColumn("lang", F.coalesce("lang", f"{own}pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id. Of rows that share an id,
    any one stays. Rows with a null id, and those without a word (null and empty texts among them), stay; texts are compared
    whole, and of no documents there are none."""
    parts = neardup.near_duplicates(docs, words=5, percent=80)
    gone = parts.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    keyed = left.where("doc_id is not null").dropDuplicates(["doc_id"])
    return keyed.unionByName(left.where("doc_id is null")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding is replaced by a mark; no document goes. Null and empty texts stay as they are, long ones are scanned
    whole, repeated rows give repeated results, and n_chars follows the text."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, sequence and place. A null or empty text is one piece of the end id, a long one is cut
    into pieces, repeated rows are packed as separate documents, and of no documents there are no pieces."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), 4096, 1, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The stages train classifiers and compress texts, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
