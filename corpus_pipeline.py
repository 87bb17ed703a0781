"""The corpus pipeline: five stages, each on all that its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but
the last return the columns of ``documents``.

1. quality     drops documents that the quality classifier rejects (score < 0.3)
2. language    drops documents without a recognisable language: without letters, or with n-grams too unlikely in the predicted one
3. near_copies keeps one document of each near-duplicate component, the smallest id
4. leaks       drops documents that hold a benchmark item
5. packing     packs what is left into sequences of at most 4096 tokens

Models are trained on the documents that a stage is given, with the labels of sf_dir.
Null ids: such rows are judged like others, and are in no near-duplicate group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkshards.llm import decontaminate, jaccard, langid, packing, quality
from sparkshards.llm.common import fresh_dir, table

MIN_SCORE = 0.3
#: Nats by which the mean log-probability of an n-gram may lie below that of the predicted language.
#: On sf0.1 the median document has -5.5 and the lowest -8.6; four junk texts tried had -11.5 and less (-9.8 when learned from sf0.001).
#: Of two or three letters alone, as of a short word, too little is known: such text may pass.
LANGUAGE_MARGIN = 4.0


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents under column names that clash with nothing, and the text's name."""
    names = [f"k{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier gives at least MIN_SCORE."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    plain, text = _plain(docs)
    return quality.score(plain, model, MIN_SCORE, text, plain.columns).where("predicted = 1").select(*plain.columns).toDF(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what has a recognisable language; without any language to learn, everything."""
    langs, matrix = langid.train(docs, F.lit(True))
    if not langs:
        return docs
    plain, text = _plain(docs)
    found = langid.identify(plain, langs, matrix, text_col=text, keep=plain.columns, margin=LANGUAGE_MARGIN)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*plain.columns).toDF(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the text with the smallest id of each component; copies under one id count as near copies, other texts under it are texts of their own."""
    plain, text = _plain(docs)
    number = plain.columns[docs.columns.index("doc_id")]
    told, names = jaccard.texts_apart(plain, number, text, "__name")
    found = jaccard.text_components(told, 80, 5, "__name", text).where("name is not null")
    stays = F.col("component")
    if names is not None:  # names that are no ids are larger than all or smaller: the smallest id is found again
        found = found.join(names, "name", "left")
        hit = found.where("nth > 1").select("component").distinct()
        first = F.struct(F.coalesce("id", "name").alias("id"), F.coalesce("nth", F.lit(1)).alias("nth"), "name")
        least = found.join(hit, "component", "left_semi").groupBy("component").agg(F.min(first)["name"].alias("least"))
        found, stays = found.join(least, "component", "left"), F.coalesce("least", "component")
    # one row for each name that goes or comes again; texts meet it in a single shuffle
    marks = found.groupBy(F.col("name").alias("__id")).agg(F.max(F.col("name") != stays).alias("__goes"), F.count(F.lit(1)).alias("__rows")).where("__goes or __rows > 1")
    known = told.where("__name is not null").join(marks, F.col("__name") == F.col("__id"), "left").where("__goes is null or not __goes")
    first = F.row_number().over(Window.partitionBy("__name").orderBy(text))
    kept = known.withColumn("__first", first).where("__rows is null or __first = 1").select(*plain.columns)
    return kept.unionByName(plain.where(F.col(number).isNull())).toDF(*docs.columns)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_copies", near_copies_stage),
    ("leaks", leaks_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the models nor the tokenizer; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh_dir(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
