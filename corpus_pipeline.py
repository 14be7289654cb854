"""The training-data pipeline: stages over the documents, each reading what the one before has written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.llm.line_dedup import dedup_lines
from memspark.llm.minhash import near_duplicates
from memspark.llm.mixing import mix_sources, n_words
from memspark.llm.names import inner
from memspark.llm.packing import pack
from memspark.llm.quality_classifier import score
from memspark.llm.queries.op1_quality_classifier import THRESHOLD, train
from memspark.llm.queries.op5_best_fit_packing import CAPACITY, VOCABULARY
from memspark.llm.store import stored
from memspark.llm.textbatch import small_batches
from memspark.tables import table

#: A table of ids and numbers is broadcast up to this many rows.
BROADCAST_ROWS = 400_000
#: Rows of an Arrow batch of the pipeline's session.
BATCH_ROWS = 1_000
#: Near-duplicates of the pipeline are at least this similar; op3's contract is another.
NEAR_PERCENT = 80


def _bounded(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows at most between Spark and Python: whole texts pass, so that a batch has many bytes a row.

    A stage's rows are worked out when its caller writes them, so the setting outlasts the stage; ``run`` gives it back.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _narrow(df: DataFrame) -> DataFrame:
    """``df``, a stored table of ids and numbers, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. A null text counts as empty; repeated rows are judged alike; no row gives none."""
    _bounded(spark)
    (name,) = inner(docs, "score")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), name=name)
    return scored.where(F.col(name) >= THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their copied lines; n_chars follows the text. A document that consisted of copied lines only goes.

    A document that had no word, or a null text, stays as it is. Rows of one id share their line numbers; no row gives none.
    """
    all_, removed = inner(docs, "lines", "removed")
    cut = dedup_lines(docs, counts=(all_, removed))
    cut = cut.where((F.col(removed) == 0) | (F.ltrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) != ""))
    n_chars = F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Null, empty and wordless texts are in no group and stay, as do rows without id. Rows of one id stay or go together.
    """
    _bounded(spark)
    (gone_id,) = inner(docs, "gone")
    gone = near_duplicates(docs, NEAR_PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(_narrow(stored(gone, "near_gone")), F.col("doc_id") == F.col(gone_id), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Rows that agree in id, source and size share their copies evenly, the first ones taking one more. A null source is a
    source; a text without words is never taken; no row gives none.
    """
    of, rows, copies, size, source, nth = inner(docs, "id", "rows", "copies", "size", "source", "nth")
    taken = mix_sources(docs).groupBy(F.col("doc_id").alias(of), F.col("source").alias(source), F.col("size").alias(size))
    taken = stored(taken.agg(F.sum("copies").alias(copies), F.count("*").alias(rows)), "taken")
    per_id = taken.groupBy(of).agg(F.sum(rows).alias(rows), F.sum(copies).alias(copies))
    single = _narrow(stored(per_id.where(f"{rows} = 1 AND {copies} > 0").drop(rows), "single"))
    out = docs.join(single, docs["doc_id"].eqNullSafe(F.col(of))).drop(of)
    again = stored(per_id.where(f"{rows} > 1").select(of), "repeated")
    if again.limit(1).count():
        repeated = docs.join(_narrow(again), docs["doc_id"].eqNullSafe(F.col(of)), "left_semi").withColumn(size, n_words("text"))
        # reruns give the same row its copies: rows that agree in all of these are alike
        number = F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy("text", "lang", "n_chars"))
        repeated = repeated.withColumn(nth, number).withColumnRenamed(size, size + "2")
        same = F.col("doc_id").eqNullSafe(F.col(of)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(size) == F.col(size + "2"))
        repeated = repeated.join(taken, same)
        share = F.floor(F.col(copies) / F.col(rows)) + (F.col(nth) <= F.col(copies) % F.col(rows)).cast("long")
        out = out.unionByName(repeated.withColumn(copies, share).where(F.col(copies) > 0).select(*docs.columns, copies))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document. A null text is an empty document; repeated rows are packed each for itself."""
    _bounded(spark)
    return pack(docs, public_tokenizers.path(VOCABULARY), CAPACITY)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("minhash near-dedup", near), ("source mixing", mix), ("best-fit packing", packing)]
#: The classifier and the mix's random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark, BATCH_ROWS):
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
