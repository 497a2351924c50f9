"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; the result of a stage is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import decontaminate, mixing, near, sharding, toxicity
from strataframe.llm.cluster import Scratch
from strataframe.llm.queries_text import held_out, table
from strataframe.llm.rowwise import fresh

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_SCORE = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; learnt from the labels outside the held-out third.

    Null and empty texts score by the bias alone. Repeated rows stay repeated; columns keep their values, whatever their names.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    (score,) = fresh(docs, "score")
    scored = toxicity.score(docs, toxicity.train(docs, labels), out=score)
    return scored.where(F.col(score) < TOXIC_SCORE).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Null and empty texts all stay; rows with equal id and text are one document. A null id counts as the largest.
    """
    return near.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows. Null and empty texts stay."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources as rows: documents repeated, cut or left out as their sources' targets ask.

    A null source is a source. Rows without words are kept once; ``n_chars`` is counted anew (null for a null text).
    """
    out = mixing.materialise(mixing.mix(docs), [*docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; a null id is a key of its own. Repeats of a document share its shard."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: The toxicity model and the jump hash are not expressible in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written to the shared folder and read back."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else scratch.cut(out)
    return docs
