"""An inverted index as a stored table, and BM25 search over it that leaves out what can't reach the first k.

Scores are sums over terms, and no term gives more than its largest weight in any record. The rarest terms of a query are
looked up first; their k-th best sum is a floor that the k-th result can't fall below. Terms whose largest weights add up to
less than the floor can't lift a record over it alone, so only the records that hold one of the other terms are candidates; and of
those, only the ones that all terms left could still lift are looked up further. Common terms make no pairs of query and record.

Without a stored index, a record's tokens are counted where the record is read, for the terms that are asked for: a token isn't a row. Some
thousand queries are then scored there whole, a matrix of records and queries at a time, and only the first k of each task move.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text
from memspark.functions.scoring import bound
from memspark.functions.stem import fold, stem as stem_of, stemmed
from memspark.operators.stored import spread, stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Rows of a table of query terms that is broadcast, at most.
BROADCAST_ROWS = 400_000
#: Postings of the rarest terms that a query begins with, for each result that is wanted; scores are rounded, so that the floor has a margin.
SEEDS, MARGIN = 16, 5e-6
#: Tokens that a task counts at a time, and stems that it remembers between batches, at most.
BLOCK_TOKENS, KNOWN_STEMS = 1_000_000, 500_000
#: Queries that are scored where the records are, at most; and cells of a matrix of records and queries.
SCORED_QUERIES, BLOCK_CELLS = 2_000, 1_000_000


class Index(NamedTuple):
    """``postings``: id, dl, term, places of each distinct term of each record, and the records' other columns; or the ``records`` (id, content, ...).

    A null term stands for the record itself.
    """

    postings: DataFrame | None = None
    records: DataFrame | None = None


def index_tokens(x: Column) -> Column:
    """Letters and digits in runs, lower case: what is indexed."""
    return F.filter(_split(x), lambda t: t != "")


def _split(x: Column) -> Column:
    """Like :func:`index_tokens`, with an empty token where the text begins or ends with other characters."""
    return F.split(F.lower(x), r"[^\p{L}\p{N}]+")


def tokens_of(records: DataFrame) -> DataFrame:
    """id, dl, term, place of the tokens of ``records`` (id, content, ...), and the other columns; a null term stands for the record itself."""
    kept = [c for c in records.columns if c != "content"]
    tokens = records.withColumn("_tokens", index_tokens(F.coalesce("content", F.lit(""))))
    itself = F.array(F.lit(None).cast("string"))
    tokens = tokens.select(*kept, F.size("_tokens").alias("dl"), F.posexplode(F.concat(itself, "_tokens")).alias("place", "term"))
    return tokens.withColumn("place", F.col("place") - 1)


def postings_of(records: DataFrame) -> DataFrame:
    """The postings of ``records`` (id, content, ...), each record's within its row: its tokens are sorted there, and runs of equal ones are a posting."""
    kept = [c for c in records.columns if c != "content"]
    placed = F.array_sort(F.transform(index_tokens(F.coalesce("content", F.lit(""))), lambda t, i: F.struct(t.alias("term"), i.alias("at"))))

    def runs(p: Column) -> Column:
        starts = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (x["term"] != F.get(p, i - 1)["term"]), i)), lambda i: i.isNotNull())
        both = F.array(F.struct(starts.alias("starts"), F.transform(p, lambda x: x["at"]).alias("at")))

        def posting(b: Column, start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(b["starts"], j + 1), F.size(p))
            return F.struct(F.get(p, start)["term"].alias("term"), F.size(p).alias("dl"), F.slice(b["at"], start + 1, end - start).alias("places"))

        return F.transform(both, lambda b: F.transform(b["starts"], lambda start, j: posting(b, start, j)))[0]

    itself = bound(placed, lambda p: F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size(p).alias("dl"), F.array().cast("array<int>").alias("places"))), runs(p)))
    return records.select(*kept, F.explode(itself).alias("_p")).select(*kept, "_p.*")


def build_index(records: DataFrame) -> Index:
    """The stored index of ``records`` (id, content, ...), in order of terms: a reader of few terms skips most of it."""
    return Index(stored(postings_of(records).repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "index"))


def _phrases(queries: DataFrame, stem: bool) -> DataFrame:
    """qid, _phrase, _times, _parts of ``queries`` (qid, query)."""
    phrases = queries.select("qid", F.explode(text.search_terms(F.col("query"))).alias("_phrase")).groupBy("qid", "_phrase").agg(F.count("*").alias("_times"))
    phrases = phrases.withColumn("_parts", index_tokens(F.col("_phrase"))).where(F.size("_parts") > 0)
    if stem:
        parts = phrases.select("qid", "_phrase", "_times", F.posexplode("_parts").alias("_at", "_part")).withColumn("_part", stemmed("_part"))
        phrases = parts.groupBy("qid", "_phrase", "_times").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"]).alias("_parts"))
    # phrases of the same parts are one
    return phrases.groupBy("qid", F.array_join("_parts", " ").alias("_phrase"), "_parts").agg(F.sum("_times").alias("_times"))


def _stems(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """_token, term: the stem of each distinct term of ``postings`` that is a stem of ``wanted`` (term) too."""
    distinct = stored(postings.select(F.col("term").alias("_token")).where("_token IS NOT NULL").distinct(), "distinct")
    found = spread(distinct, distinct.count(), "_token").withColumn("term", stemmed("_token"))
    return stored(found.join(wanted.select("term").distinct(), "term", "left_semi"), "stems")


class _Known(dict):
    """By token: the part that its stem is, -1 for none and -2 for the empty token; found when first met."""

    def __init__(self, parts: dict[str, int]):
        self.parts = parts

    def __missing__(self, token: str) -> int:
        self[token] = part = self.parts.get(stem_of(fold(token)), -1) if token else -2
        return part


class _Tree:
    """The phrases of queries by their parts: finds them in lists of tokens, many lists at once."""

    def __init__(self, phrases: list[str], stem: bool):
        self.phrases, self.stem = phrases, stem
        split = [p.split(" ") for p in phrases]
        self.parts = {p: i for i, p in enumerate(sorted({p for parts in split for p in parts}))}
        below: dict[int, int] = {}  # node * number of parts + part: the node below
        ends = {}
        for number, parts in enumerate(split):
            node = 0
            for part in parts:
                node = below.setdefault(node * len(self.parts) + self.parts[part], len(below) + 1)
            ends[node] = number
        self.keys = np.array(sorted(below), np.int64)
        self.nodes = np.array([below[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array([ends.get(node, -1) for node in range(len(below) + 1)], np.int64)
        self.inner = np.zeros(len(below) + 1, bool)
        self.inner[self.keys // max(1, len(self.parts))] = True

    def places(self, tokens: pa.Array, known: _Known) -> np.ndarray:
        """The parts that distinct ``tokens`` are, -1 for those that are none and -2 for the empty one."""
        if not self.stem:
            found = pc.index_in(tokens, value_set=pa.array(list(self.parts), pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
            return np.where(pc.equal(tokens, "").to_numpy(zero_copy_only=False), -2, found)
        if len(known) > KNOWN_STEMS:
            known.clear()
        return np.fromiter(map(known.__getitem__, tokens.to_numpy(zero_copy_only=False)), np.int64, len(tokens))

    def counts(self, lists: pa.Array, known: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The length of each list; and list, phrase and how often it is there, of the phrases that are there at all."""
        encoded = lists.flatten().dictionary_encode()
        part = self.places(encoded.dictionary, known)[encoded.indices.to_numpy()]
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        owner, part = owner[part > -2], part[part > -2]
        lengths = np.bincount(owner, minlength=len(lists))
        at, node, keys = np.flatnonzero(part >= 0), 0, []
        while at.size and self.keys.size:
            step = node * len(self.parts) + part[at]
            i = np.minimum(np.searchsorted(self.keys, step), self.keys.size - 1)
            there = self.keys[i] == step
            at, node = at[there], self.nodes[i[there]]
            number = self.ends[node]
            keys.append(owner[at[number >= 0]] * len(self.phrases) + number[number >= 0])
            # a longer phrase goes on with the next token of the same list
            more = self.inner[node] & (at + 1 < part.size)
            at, node = at[more], node[more]
            more = (owner[at] == owner[at + 1]) & (part[at + 1] >= 0)
            at, node = at[more] + 1, node[more]
        key, times = np.unique(np.concatenate([*keys, np.empty(0, np.int64)]).astype(np.int64), return_counts=True)
        return lengths, key // max(1, len(self.phrases)), key % max(1, len(self.phrases)), times


def _blocks(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that cost about ``most`` together."""
    block = np.cumsum(cost) // most
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(cost)]
    yield from zip(edges, edges[1:])


def _counted(records: DataFrame, phrases: list[str], stem: bool) -> DataFrame:
    """dl, _numbers of the ``phrases`` that ``records`` (content, ...) hold, how often (_times), and the other columns."""
    kept = [c for c in records.columns if c != "content"]
    tree = _Tree(phrases, stem)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(tree.parts)
        for batch in batches:
            for start, end in _blocks(pc.list_value_length(batch.column("_tokens")).to_numpy().astype(np.int64), BLOCK_TOKENS):
                rows = batch.slice(start, end - start)
                lengths, owner, number, times = tree.counts(rows.column("_tokens"), known)
                at = pa.array(np.searchsorted(owner, np.arange(len(lengths) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (number, times)]
                yield pa.RecordBatch.from_arrays([*map(rows.column, kept), pa.array(lengths, pa.int32()), *lists], names=[*kept, "dl", "_numbers", "_times"])

    texts = records.select(*kept, _split(F.coalesce("content", F.lit(""))).alias("_tokens"))
    numbers = F.array().cast("array<int>")
    schema = records.select(*kept, F.lit(0).alias("dl"), numbers.alias("_numbers"), numbers.alias("_times")).schema
    for field in schema:
        field.nullable = True
    return texts.mapInArrow(counted, schema)


class Asked(NamedTuple):
    """``terms``: qid, _phrase, _df, _factor (what a weight counts), _most (by the largest weight); ``postings``: _phrase, id, _weight; whether the terms are few.

    ``records``: id, _ok, dl, _numbers, _times if each id is one record's, and ``length``, their average.
    """

    terms: DataFrame
    postings: DataFrame
    few: bool
    records: DataFrame | None = None
    length: float = 0.0


def _looked_up(phrases: DataFrame, found: DataFrame, few: bool, stem: bool, places: bool) -> DataFrame:
    """_phrase, _tf of the records of ``found`` (id, dl, term, place or ``places``) by a join with the terms; a null phrase stands for the record itself."""
    terms = phrases.select("_phrase", "_parts").distinct().select("_phrase", F.size("_parts").alias("_len"), F.posexplode("_parts").alias("_off", "term"))
    terms = F.broadcast(terms) if few else terms
    if stem:
        renamed = found.withColumnRenamed("term", "_token")
        found = renamed.join(_stems(found, terms), "_token", "left").where("term IS NOT NULL OR _token IS NULL").drop("_token")
    # one pass: the records themselves, for the totals, and the places of query terms
    by = ["_phrase", "id", *(["scope"] if "scope" in found.columns else []), "_ok", "dl"]
    hits = found.join(terms, "term", "left").where("term IS NULL OR _phrase IS NOT NULL")
    place = F.explode_outer("places") if places else F.col("place")
    hits = stored(hits.select(*by, "_len", "_off", place.alias("_pos")), "places")
    one = hits.where("_len = 1").groupBy(*by).agg(F.count("*").alias("_tf"))
    several = hits.where("_len > 1").groupBy(*by, "_len", (F.col("_pos") - F.col("_off")).alias("_at")).agg(F.countDistinct("_off").alias("_c"))
    several = several.where("_c = _len").groupBy(*by).agg(F.count("*").alias("_tf"))
    return hits.where("_phrase IS NULL").select(*by, F.lit(0).cast("long").alias("_tf")).unionByName(one).unionByName(several)


def asked(queries: DataFrame, index: Index, stem: bool = False, wanted: Column | None = None) -> Asked:
    """What the terms of ``queries`` (qid, query) weigh in which records of ``index``; of those that aren't ``wanted``, only the statistics count."""
    phrases = stored(_phrases(queries, stem), "phrases")
    few = (phrases.agg(F.sum(F.size("_parts"))).first()[0] or 0) <= BROADCAST_ROWS
    found = (index.records if index.postings is None else index.postings).withColumn("_ok", F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False)))
    scope = ["scope"] if "scope" in found.columns else []
    by = ["id", *scope, "_ok", "dl"]
    records = None
    if index.postings is None and few:
        names = [r[0] for r in phrases.select("_phrase").distinct().orderBy("_phrase").collect()]  # as many as a broadcast may hold
        records = stored(_counted(found.select("id", *scope, "_ok", "content"), names, stem), "counted")
        numbered = queries.sparkSession.createDataFrame(list(enumerate(names)), "_number int, _phrase string")
        phrases = phrases.join(F.broadcast(numbered), "_phrase").drop("_phrase").withColumnRenamed("_number", "_phrase")
        postings = records.select(*by, F.explode(F.arrays_zip("_numbers", "_times")).alias("_p")).select(*by, F.col("_p._numbers").alias("_phrase"), F.col("_p._times").alias("_tf"))
        themselves = records
    else:
        hits = _looked_up(phrases, found if index.postings is not None else tokens_of(found), few, stem, index.postings is not None)
        hits = stored(hits, "hits")
        postings, themselves = hits.where("_phrase IS NOT NULL"), hits.where("_phrase IS NULL")
    totals = F.sum("_c"), F.sum(F.col("dl") * F.col("_c")), F.max("_c"), F.count("*"), F.countDistinct("id")
    n, length, most, rows, ids = themselves.groupBy(*by).agg(F.count("*").alias("_c")).agg(*totals).first()
    if most and most > 1:  # records of one id and length count as one
        postings = postings.groupBy("_phrase", *by).agg(F.sum("_tf").alias("_tf"))
    average = length / n if n else 0.0
    weight = F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
    postings = postings.select("_phrase", "id", *scope, "_ok", weight.alias("_weight"))
    frequency = postings.groupBy("_phrase").agg(F.count("*").alias("_df"), F.max("_weight").alias("_most"))
    idf = F.greatest(F.log((F.lit(n or 0) - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(LEAST_IDF))
    found = phrases.select("qid", "_phrase", "_times").join(frequency.select("_phrase", "_df", idf.alias("_idf"), "_most"), "_phrase")
    found = found.select("qid", "_phrase", "_df", (F.col("_times") * F.col("_idf")).alias("_factor"), (F.col("_times") * F.col("_idf") * F.col("_most")).alias("_most"))
    return Asked(stored(found, "asked"), postings.where("_ok").drop("_ok"), few, records if most == 1 and ids == rows else None, average)


class _Best:
    """The best of what has been seen of each query's scores: ids, queries, scores, and a ``floor`` that the first ``k`` don't fall below."""

    def __init__(self, queries: int, k: int, ids: pa.DataType):
        self.k, self.floor = k, np.zeros(queries)
        self.ids, self.queries, self.scores = [pa.array([], ids)], [np.empty(0, np.int64)], [np.empty(0)]
        self.rows = 0

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        """``scores`` of ``ids`` (rows) by query; 0 is none."""
        if len(ids) >= self.k:
            self.floor = np.maximum(self.floor, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k] - MARGIN)
        row, query = np.nonzero((scores > 0) & (scores >= self.floor))
        self.ids.append(ids.take(pa.array(row)))
        self.queries.append(query)
        self.scores.append(scores[row, query])
        self.rows += len(row)
        if self.rows > BLOCK_CELLS:
            self.cut()

    def cut(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Of equal scores the ``k`` least ids stay; of others, those that aren't below the floor, as rounding may make them equal."""
        ids, query, score = pa.concat_arrays(self.ids), np.concatenate(self.queries), np.concatenate(self.scores)
        place = np.empty(len(ids), np.int64)
        place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, -score, query))
        query, score = query[order], score[order]
        first = np.searchsorted(query, np.arange(len(self.floor)))
        kth = first + self.k - 1
        full = np.searchsorted(query, np.arange(len(self.floor)), "right") > kth
        self.floor[full] = np.maximum(self.floor[full], score[kth[full]] - MARGIN)
        new = np.ones(len(ids), bool)
        new[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1])
        run = np.flatnonzero(new)
        equal = np.arange(len(ids)) - np.repeat(run, np.diff([*run, len(ids)]))
        kept = (equal < self.k) & (score >= self.floor[query])
        ids, query, score = ids.take(pa.array(order[kept])), query[kept], score[kept]
        self.ids, self.queries, self.scores, self.rows = [ids], [query], [score], 0
        return ids, query, score


def _seen(allowed: pa.Table, queries: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The scopes that are ``allowed`` (qid, scope), and which of the ``queries`` see each; a last row is for any other scope."""
    scope = allowed.column("scope").combine_chunks()
    scopes = pc.unique(scope)
    seen = np.zeros((len(scopes) + 1, len(queries)), bool)
    query = pc.index_in(allowed.column("qid").combine_chunks(), value_set=queries).fill_null(-1).to_numpy(zero_copy_only=False)
    seen[pc.index_in(scope, value_set=scopes).to_numpy(zero_copy_only=False)[query >= 0], query[query >= 0]] = True
    return scopes, seen


def _scored(found: Asked, k: int, allowed: pa.Table | None = None) -> DataFrame:
    """qid, id, _s: the scores that may be among the first ``k``, found where the records are, in the scopes that are ``allowed`` to a query (qid, scope)."""
    terms = found.terms.select("qid", "_phrase", "_factor").toArrow()
    qids = terms.column("qid").combine_chunks().dictionary_encode(null_encoding="encode")
    phrase = terms.column("_phrase").combine_chunks().to_numpy()
    order = np.argsort(phrase, kind="stable")
    phrase, query, factor = phrase[order], qids.indices.to_numpy()[order].astype(np.int64), terms.column("_factor").combine_chunks().to_numpy()[order]
    names, length, width = qids.dictionary, found.length, len(qids.dictionary)
    starts = np.searchsorted(phrase, np.arange(phrase.max(initial=-1) + 2))
    scopes, seen = _seen(allowed, names) if allowed is not None else (None, None)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            ids, lists = batch.column("id"), batch.column("_numbers")
            best = best or _Best(width, k, ids.type)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            owner, number = np.repeat(np.arange(len(ids)), np.diff(ends)), lists.flatten().to_numpy()
            times = batch.column("_times").flatten().to_numpy()
            weight = times * (K1 + 1) / (times + K1 * (1 - B + B * batch.column("dl").to_numpy()[owner] / length))
            queries = starts[number + 1] - starts[number]
            scope = None if scopes is None else pc.index_in(batch.column("scope"), value_set=scopes).fill_null(len(scopes)).to_numpy(zero_copy_only=False)
            for lo, hi in _blocks(np.bincount(owner, queries, len(ids)) + width, BLOCK_CELLS):
                of = slice(ends[lo], ends[hi])
                n = queries[of]
                # each posting meets the queries that ask for its phrase
                term = np.repeat(starts[number[of]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = np.repeat((owner[of] - lo) * width, n) + query[term]
                scores = np.bincount(cell, np.repeat(weight[of], n) * factor[term], (hi - lo) * width)
                scores = scores.reshape(-1, width)
                best.add(ids.slice(lo, hi - lo), scores if scope is None else scores * seen[scope[lo:hi]])
        if best:
            ids, at, score = best.cut()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), ids, pa.array(score)], names=["qid", "id", "_s"])

    schema = found.terms.select("qid").schema.add(found.records.schema["id"]).add("_s", "double")
    return found.records.where("_ok AND size(_numbers) > 0").select("id", *(["scope"] if scopes is not None else []), "dl", "_numbers", "_times").mapInArrow(scored, schema)


def _sums(found: Asked, terms: DataFrame, allowed: DataFrame | None, *more: str) -> DataFrame:
    """qid, id, _s of the records that hold some of ``terms``, in the scopes that are ``allowed`` to a query (qid, scope)."""
    pairs = (F.broadcast(terms) if found.few else terms).join(found.postings, "_phrase")
    if allowed is not None:
        pairs = pairs.join(allowed.select("qid", "scope").distinct(), ["qid", "scope"], "left_semi")
    return pairs.groupBy("qid", "id", *more).agg(F.sum(F.col("_factor") * F.col("_weight")).alias("_s"))


def candidates(found: Asked, k: int, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(qid, id, _s of the records that may be among the first ``k``; the terms that their sums still lack)."""
    rarest = Window.partitionBy("qid").orderBy("_df", "_phrase").rowsBetween(Window.unboundedPreceding, -1)
    seeds = found.terms.withColumn("_before", F.coalesce(F.sum("_df").over(rarest), F.lit(0))).where(F.col("_before") < SEEDS * k)
    best = Window.partitionBy("qid").orderBy(F.col("_s").desc())
    floor = _sums(found, seeds.drop("_before"), allowed).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    floor = floor.groupBy("qid").agg(F.min("_s").alias("_floor"), F.count("*").alias("_c")).where(F.col("_c") == k).drop("_c")
    lightest = Window.partitionBy("qid").orderBy("_most", "_phrase")
    terms = found.terms.join(floor, "qid", "left").withColumn("_floor", F.coalesce(F.col("_floor") - MARGIN, F.lit(0.0)))
    terms = terms.withColumn("_rest", F.sum("_most").over(lightest.rowsBetween(Window.unboundedPreceding, 0)) < F.col("_floor"))
    left = F.sum(F.when(F.col("_rest"), F.col("_most")).otherwise(0.0)).over(Window.partitionBy("qid"))
    terms = stored(terms.withColumn("_left", left), "terms_cut")
    some = stored(_sums(found, terms.where("NOT _rest"), allowed, "_floor", "_left").where("_s + _left >= _floor"), "sums")
    # these sums are nearer the whole than those of the rarest terms: their k-th best is a higher floor
    higher = some.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("qid", (F.col("_s") - MARGIN).alias("_higher"))
    some = some.join(higher, "qid", "left").where(F.col("_s") + F.col("_left") >= F.coalesce("_higher", "_floor"))
    return some.select("qid", "id", "_s"), terms.where("_rest").select("qid", "_phrase", "_factor")


def search_index(queries: DataFrame, index: Index, k: int = 10, wanted: Column | None = None, stem: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank: BM25 of the records of ``index`` for ``queries`` (qid, query).

    A query term with - or _ inside is a phrase: its parts must follow one another. A repeated term counts again. Statistics are those
    of all records; ``wanted`` (a condition on the columns of the index) and ``allowed`` (qid, scope; the index has a scope) cut the matches
    only. Terms that half of the records hold get the least weight. With ``stem``, terms meet by their folded stems.
    """
    found = asked(queries, index, stem, wanted)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    asking = found.terms.select("qid").distinct().count() if found.records is not None else 0
    pairs = None
    if allowed is not None and found.records is not None and asking <= SCORED_QUERIES:
        allowed = stored(allowed.select("qid", "scope").where("qid IS NOT NULL AND scope IS NOT NULL").distinct(), "allowed")
        if allowed.select("scope").distinct().count() * asking <= BLOCK_CELLS:
            pairs = allowed.toArrow()  # scopes times queries are few
    if found.records is not None and asking <= SCORED_QUERIES and (allowed is None or pairs is not None):
        scored = _scored(found, k, pairs).select("qid", "id", F.round("_s", 6).alias("score"))
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    some, rest = candidates(found, k, allowed)
    some = stored(some, "candidates")
    more = some.select("qid", "id").join(F.broadcast(rest) if found.few else rest, "qid").join(found.postings.select("_phrase", "id", "_weight"), ["_phrase", "id"])
    more = more.groupBy("qid", "id").agg(F.sum(F.col("_factor") * F.col("_weight")).alias("_m"))
    scored = some.join(more, ["qid", "id"], "left").select("qid", "id", F.round(F.col("_s") + F.coalesce("_m", F.lit(0.0)), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
