"""From raw documents to token ids, one written table per stage.

    toxicity            drops texts that the classifier takes for toxic
    near_dedup          keeps one row of every group of near copies (five-word Jaccard 0.8)
    decontamination     drops texts that hold a benchmark item
    secrets             masks secrets inside the texts
    encoding            token ids of what is left, checked by decoding

Every stage gets what the one before has written, works on all of it and
returns the columns of the documents; the last returns `doc_id`, `lang`,
`source`, `n_tokens`, `ids` (packed, see `meterloom.llm.bpe`) and `exact`,
whether decoding gives the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import bpe, decontaminate, nearcopies, secrets, toxicity
from meterloom.llm.common import fold, table
from meterloom.llm.queries import vocabulary_path
from meterloom.session import discard, settle, settle_mapped

TOXIC_FROM = 0.5


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = fold("doc_id", 5) != 0
    model = toxicity.train(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return toxicity.score(docs, model, score_col="__toxic").where(F.col("__toxic") < TOXIC_FROM).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay; where a secret is masked, `n_chars` follows the text."""
    forest = secrets.train(secrets.labelled_findings(spark))
    out = secrets.redact(docs.withColumn("__before", F.length("text")), forest, path_col="source")
    changed = F.length("text") - F.col("__before")
    return out.withColumn("n_chars", (F.col("n_chars") + F.coalesce(changed, F.lit(0))).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    codec = bpe.prepare(docs, vocabulary_path())
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), codec), codec)
    rows = coded.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))
    return settle_mapped(rows, "encoded")


STAGES = [("toxicity", toxic_out), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("secrets", masked), ("encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        written = made if hasattr(made, "settled_at") else settle(made, f"stage-{name}")
        if number:
            discard(docs)
        docs = written
    return docs


#: Two stages are trained, so SQL can't express the rows; tests hold them against a plain version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
