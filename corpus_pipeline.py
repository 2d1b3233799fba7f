"""A pipeline over documents: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mound.llm import mixing, pii, sentencepiece_codec, simhash, toxicity
from mound.llm.tables import read, settle

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity model does not predict as toxic.

    The model learns from ``labels`` of ``sf_dir``, those of the held-out fifth never. Null and empty texts have the
    model's offset as their score; equal texts go or stay together, repeated rows too; an empty table stays empty. Like
    all stages but the last it returns the columns of documents; others, whatever their names, are left behind.
    """
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    return toxicity.score(docs.select(*DOCUMENTS), model).filter("predicted = 0").select(*DOCUMENTS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near-equal fingerprints.

    Null, empty and wordless texts share the fingerprint zero and so are one group. Of rows with one id one stays; a row
    without an id stays only where its group has none with an id, and then one of them. A long text is read whole.
    """
    return simhash.keep_one(docs.select(*DOCUMENTS))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every document stays, a null text as null, an empty one as empty.

    ``n_chars`` follows where the text changes. Repeated rows are redacted alike.
    """
    return pii.redact(docs.select(*DOCUMENTS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit every document as often as its source's rate asks.

    Null is a source of its own. A source without words, null and empty texts alone, has rate 0 and goes; beside words
    such texts come as often as others of their source. Equal rows draw alike.
    """
    return mixing.mix(docs.select(*DOCUMENTS))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with parity and round trip; a row for each row, none for a null or empty text's ids."""
    out = sentencepiece_codec.encode(docs.select(*DOCUMENTS))
    return out.select("doc_id", "source", "n_tokens", "ids", "parity", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("pii", redact_pii),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode_texts),
]

# The first stages fit a model and walk links, so no SQL gives the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder before the next reads it; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
