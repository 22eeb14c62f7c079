"""A training corpus from raw documents, stage by stage; each stage is one operator of plumbline.llm.

Defined results of every stage: an empty table gives an empty one, columns besides those of
documents go, and texts are taken whole. What nulls, ties and repeated rows come to is stated at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard, mixing, pii, toxicity
from plumbline.llm.common import id_bucket, materialize, table
from plumbline.llm.queries import KEY, MIX

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go; learned as in op5.

    Every row is judged by its own text, so rows of null or repeated ids are too; null and empty texts
    hold no evidence and stay, unless the model takes a text without any for toxic.
    """
    taught = id_bucket(F.col("doc_id"), 5) != 0
    model = toxicity.fit(docs.where(taught), table(spark, sf_dir, "labels").where(taught))
    return toxicity.score(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays.

    Rows of a null id and null or empty texts stay: they have no link. Of several rows of one id, whole copies
    among them, the one with the least hash of its text stays.
    """
    return jaccard.keep_one_per_group(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go.

    Every row is judged by its own text, whatever its id; null and empty texts and items match nothing.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its personal data replaced; n_chars follows the text (null of a null one).

    Rows are mapped one by one, so repeated ones come out alike; null and empty texts stay as they are.
    """
    out = pii.pseudonymize(docs, KEY).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix: source of the mix, block, slot and position.

    Every row has a position of its own. A null source, or one without a weight, is mixed as "(other)"; rows of one
    id, or of none, are ordered by their other columns.
    """
    return mixing.mix(docs, MIX)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_pii),
    ("mixing sources to target weights", mix_sources),
]

#: The first stage is learned, so no SQL states these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
