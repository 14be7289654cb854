"""Scoped listings, briefings and reports, for whole tables of scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import scope_chain
from memspark.operators.search import top


def in_scope(scopes: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` (scope, ...) seen from each of ``scopes`` (query_scope): those of its chain of ancestors and of itself."""
    chain = scopes.select("query_scope", F.explode(scope_chain(F.col("query_scope"))).alias("scope")).distinct()
    return records.join(chain, "scope")


def list_records(scopes: DataFrame, records: DataFrame, order: list[Column], k: int, wanted: Column | None = None) -> DataFrame:
    """The first ``k`` records of each scope, with their place."""
    # no scope shows more than k records of any one scope, so a scope that all see, such as the root, is cut before the join
    first = top(records if wanted is None else records.where(wanted), ["scope"], order, k, "_place").drop("_place")
    return top(in_scope(scopes, first), ["query_scope"], order, k)


def briefing(scopes: DataFrame, sections: dict[str, tuple[DataFrame, Column, list[Column], int]]) -> DataFrame:
    """query_scope, section, lines: for each section (records, line, order, k) the first k lines of each scope, in order."""
    out = None
    for name, (records, line, order, k) in sections.items():
        found = list_records(scopes, records, order, k).select("query_scope", F.lit(name).alias("section"), "rank", line.alias("line"))
        out = found if out is None else out.unionByName(found)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return out.groupBy("query_scope", "section").agg(F.array_join(lines, "\n").alias("lines"))


def counts(scopes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """query_scope and a count of each table's records in it, in one pass."""
    rows = None
    for name, records in tables.items():
        some = records.select("scope", F.lit(name).alias("_table"))
        rows = some if rows is None else rows.unionByName(some)
    # records are counted by their own scope first, so that the join has a row for each scope, however many records the root has
    own = rows.groupBy("scope").agg(*[F.sum((F.col("_table") == n).cast("long")).alias(n) for n in tables])
    seen = in_scope(scopes, own).groupBy("query_scope").agg(*[F.sum(n).alias(n) for n in tables])
    return scopes.select("query_scope").distinct().join(seen, "query_scope", "left").na.fill(0)


def keywords(texts: DataFrame, k: int = 12) -> DataFrame:
    """group, term, n, rank: the most frequent terms of each group of ``texts`` (group, content), stop words left out."""
    from memspark.functions.text import STOP_WORDS, keyword_terms

    terms = texts.select("group", F.explode(keyword_terms(F.col("content"))).alias("term")).where(~F.col("term").isin(STOP_WORDS))
    return top(terms.groupBy("group", "term").agg(F.count("*").alias("n")), ["group"], [F.col("n").desc(), F.col("term")], k)
