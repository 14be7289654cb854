"""Retrieval datasets in files: corpus and queries as JSON lines, judgements as tab-separated text, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def judgements(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, id, grade; wrong lines) of text ``lines`` (value, header: whether a line is its file's first).

    Empty lines and those that begin with # drop out, and so does a first line whose grade is no number.
    """
    rows = lines.withColumn("value", F.trim("value")).where("value <> '' AND NOT startswith(value, '#')")
    cells = F.transform(F.split("value", "\t"), lambda x: F.trim(x))
    rows = rows.withColumn("_c", cells).withColumn("_grade", F.when(F.size(cells) >= 3, F.expr("try_cast(_c[2] AS BIGINT)")))
    good = rows.where("_grade IS NOT NULL").select(F.col("_c")[0].alias("qid"), F.col("_c")[1].alias("id"), F.col("_grade").alias("grade"))
    return good, rows.where("_grade IS NULL AND NOT (header AND size(_c) >= 3)").select("value")


def problems(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """problem, id of what makes a dataset unsound: repeated ids, and judgements or relations of unknown ids."""
    row = lambda df, name, c: df.select(F.lit(name).alias("problem"), F.col(c).cast("string").alias("id"))
    repeated = lambda df, c: df.groupBy(c).agg(F.count("*").alias("_n")).where("_n > 1")
    unknown = lambda df, c, among, key: df.select(c).distinct().join(among.select(F.col(key).alias(c)).distinct(), c, "left_anti")
    out = row(repeated(corpus, "doc_id"), "duplicate document", "doc_id").unionByName(row(repeated(queries, "qid"), "duplicate query", "qid"))
    out = out.unionByName(row(unknown(qrels, "qid", queries, "qid"), "unknown query", "qid")).unionByName(row(unknown(qrels, "id", corpus, "doc_id"), "unknown document", "id"))
    if relations is not None:
        for end in ("from", "to"):
            out = out.unionByName(row(unknown(relations, end, corpus, "doc_id"), f"unknown {end}", end))
    return out


def read_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """corpus (doc_id, record_type, payload, scope), queries (qid, text), qrels and what is wrong with them, of a folder."""
    corpus = spark.read.schema("doc_id string, record_type string, payload string, scope string").json(f"{folder}/corpus_seed.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").withColumnRenamed("_id", "qid")
    lines = spark.read.text(f"{folder}/qrels.tsv").select("value", (F.col("_metadata.file_block_start") == 0).alias("_first"))
    # the header is the only line of a file whose third cell is no number and that names ids
    lines = lines.select("value", (F.col("_first") & F.col("value").rlike("(?i)id\\t.*id\\t")).alias("header"))
    qrels, wrong = judgements(lines)
    return {"corpus": corpus, "queries": queries, "qrels": qrels, "wrong_lines": wrong, "problems": problems(corpus, queries, qrels)}
