"""Ranking operators: corpus statistics, BM25, cosine, fusion, collapse, gate and row selection.

Statistics are always those of the pool that is passed in: filter first, then rank.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scores import dot
from quern.functions.text import tokens
from quern.session import cut_lineage, stored

#: Fixed values of the keyword score and of reciprocal rank fusion.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Rows of a block when many queries are scored at once.
BLOCK = 1000
#: Blocks of queries that a task scores at most, as it keeps the lists of all of them.
PACKS = 8
#: What ``tokens`` finds in a lower-case text.
WORD = re.compile(r"[a-z0-9_.\-/]{2,}")


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, len, counts): every text is tokenised once, its terms counted inside its row; what is written is read by each step.

    Same as ``tokens`` and ``term_counts`` (null counts where there is no term), which take four times the CPU.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                long, ends, terms, tf = [], [], [], []
                for text in part.column(1).to_pylist():
                    held = WORD.findall(text)
                    own = Counter(held)
                    terms += (some := sorted(own))
                    tf += [own[term] for term in some]
                    long.append(len(held))
                    ends.append(len(terms))
                starts = [None if n == 0 else end for n, end in zip(long, [0, *ends])] + ends[-1:]
                each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.int32())], names=["term", "tf"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(long, pa.int32()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), each)], names=["id", "len", "counts"])

    return stored(texts.mapInArrow(count, f"id {dict(texts.dtypes)['id']}, len int, counts array<struct<term: string, tf: int>>"))


def postings(words: DataFrame) -> DataFrame:
    """(id, len, term, tf)."""
    return words.select("id", "len", F.inline("counts"))


def document_frequency(words: DataFrame) -> DataFrame:
    """(term, df, uses) over the whole pool, combined on the map side."""
    return postings(words).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))


def idf(df: Column, n: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def pool_size(words: DataFrame) -> DataFrame:
    return words.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avgdl"))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """(id, score) of the documents that hold a query term. Negative idf becomes epsilon times the mean idf of the pool."""
    words = lengths(docs, id_col, text_col)
    size = F.broadcast(pool_size(words))
    df = document_frequency(words).crossJoin(size).withColumn("idf", idf(F.col("df"), F.col("n")))
    mean = F.broadcast(df.agg(F.avg("idf").alias("mean_idf")))
    spark = docs.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(tokens("q")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    terms = df.join(F.broadcast(asked), "term").crossJoin(mean).select("term", "times", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    own = F.filter("counts", lambda c: c["term"].isin(*asked_words(query)))  # before rows are made of them
    hit = words.select("id", "len", F.inline(own)).join(F.broadcast(terms), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return hit.crossJoin(size).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))


def asked_words(query: str) -> list[str]:
    """The distinct tokens of a query given as plain text."""
    return sorted({w for w in re.split(r"[^a-z0-9_.\-/]+", query.lower()) if len(w) >= 2})


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds ``rank`` by descending score, then id. With ``k`` the top is taken before the single-task window."""
    if k is not None:
        scores = scores.orderBy(F.col("score").desc(), "id").limit(k)
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


def cosine(vectors: DataFrame, id_col: str, vec_col: str, probe: DataFrame) -> DataFrame:
    """(id, score) against the one vector ``probe`` (column ``q``), rounded to four places."""
    return vectors.crossJoin(F.broadcast(probe)).select(F.col(id_col).alias("id"), F.round(dot(vec_col, "q"), 4).alias("score"))


def packed(df: DataFrame, rows: int = BLOCK) -> DataFrame:
    """Up to ``rows`` neighbouring rows in one: every column becomes the array of its values."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = [pa.concat_arrays([c]) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in columns], names=part.schema.names)

    return df.mapInArrow(pack, ", ".join(f"{name} array<{kind}>" for name, kind in df.dtypes))


def sealed(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Like ``packed``, but a block is one binary value ``name``, which a join copies without a look at its parts; ``opened`` reads it."""
    rows = rows or packed.__defaults__[0]

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(at, rows).columns], names=batch.schema.names)
                to = pa.BufferOutputStream()
                with pa.ipc.new_stream(to, part.schema) as stream:
                    stream.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([to.getvalue().to_pybytes()], pa.binary())], names=[name])

    return df.mapInArrow(seal, f"{name} binary")


def opened(value: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def _best(scores: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int | None, floor: float, slack: float) -> pa.RecordBatch:
    """Of a block [ids, queries] what can be among the ``k`` best of a query, or at or above ``floor``, once scores are rounded; -inf is no score."""
    keep = (scores > -np.inf) & (scores >= floor - slack)
    if k is not None and len(ids) > k:
        keep &= scores >= np.partition(scores, len(ids) - k, axis=0)[len(ids) - k] - slack
    row, query = np.nonzero(keep)
    return pa.RecordBatch.from_arrays([pa.array(queries[query], pa.int64()), pa.array(ids[row], pa.int64()), pa.array(scores[row, query], pa.float64())], names=["query", "id", "score"])


def _flat(column: pa.Array) -> list[pa.Array]:
    """The values of the (nested) array in the one row of ``column``: row lengths of the inner arrays, then their values."""
    inner = column.flatten()
    return [inner.value_lengths().to_numpy(zero_copy_only=False), inner.flatten()]


def top_each(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (query, id, score) of every query with their ``rank``, by descending score, then id."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_each(vectors: DataFrame, id_col: str, vec_col: str, probes: DataFrame, k: int | None = None, floor: float = -np.inf, rounded: bool = True) -> DataFrame:
    """(query, id, score) of every row against every row (query, q) of ``probes``, in blocks; scores as in ``cosine``.

    With ``k`` or ``floor`` at least the rows that are among the ``k`` best of a query, or reach the floor; null vectors have no score.
    """
    rows = packed(vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")))
    asked = packed(probes.where("q is not null").select(F.col("query").cast("long").alias("query"), F.col("q").cast("array<double>").alias("q")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
                ids, queries = (one[x].flatten().to_numpy() for x in ("id", "query"))
                v, q = (_flat(one[x])[1].to_numpy(zero_copy_only=False).reshape(n, -1) for x, n in (("v", len(ids)), ("q", len(queries))))
                yield _best(np.nan_to_num(v @ q.T, nan=-np.inf), queries, ids, k, floor, 1e-4)

    got = rows.crossJoin(asked).mapInArrow(score, "query long, id long, score double")
    return got.withColumn("score", F.round("score", 4)) if rounded else got


def near_pairs(vectors: DataFrame, id_col: str, vec_col: str, block_col: str, least: float, rows: int = BLOCK) -> DataFrame:
    """(block, a, b, score) of all pairs a < b of one block whose inner product, rounded to four places, reaches ``least``.

    Blocks are cut into packs of ``rows`` vectors; two packs are one matrix product, so a hot block becomes many small
    tasks. Null vectors are in no pair.
    """
    kept = vectors.where(F.col(vec_col).isNotNull()).select(F.col(block_col).alias("block"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    size = kept.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / rows).alias("packs"))
    packs = kept.join(F.broadcast(size), "block").withColumn("pack", F.pmod(F.xxhash64("id"), F.col("packs")))
    packs = packs.groupBy("block", "pack").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("flat"))
    schema = "block {}, a long, b long, score double".format(dict(kept.dtypes)["block"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
                x, y = (one[c].flatten().to_numpy() for c in ("ids", "ids2"))
                v, w = (one[c].flatten().to_numpy().reshape(n, -1) for c, n in (("flat", len(x)), ("flat2", len(y))))
                got = v @ w.T
                left, right = np.nonzero(got >= least - 1e-4)
                if one["pack"][0].as_py() == one["pack2"][0].as_py():
                    left, right = left[keep := x[left] < y[right]], right[keep]
                low, high = np.minimum(x[left], y[right]), np.maximum(x[left], y[right])
                block = pa.array([one["block"][0].as_py()] * len(left), batch.column("block").type)
                yield pa.RecordBatch.from_arrays([block, pa.array(low), pa.array(high), pa.array(got[left, right])], names=["block", "a", "b", "score"])

    other = packs.select("block", F.col("pack").alias("pack2"), F.col("ids").alias("ids2"), F.col("flat").alias("flat2"))
    both = packs.join(other.hint("merge"), "block").where("pack <= pack2")
    return both.mapInArrow(score, schema).withColumn("score", F.round("score", 4)).where(F.col("score") >= least)


class Best:
    """What a task has to keep of the scores of its blocks: for every query the ``k`` best ids, or all from ``floor`` up.

    An id may have several rows (the parts of a note); all rows count that are not below the best row of the k-th id. The bound
    rises from block to block, so a task returns about ``k`` ids a query, however many blocks it reads. ``single``: an id has one
    row, so the k-th best of a block is a bound before its rows are kept, and they need no sort by id.
    """

    def __init__(self, k: int | None, floor: float = -np.inf, slack: float = 1e-6, single: bool = False):
        self.k, self.floor, self.slack, self.single, self.packs = k, floor, slack, single, {}

    def add(self, scores: np.ndarray, queries: np.ndarray, ids: np.ndarray, parts: np.ndarray | None = None) -> None:
        """``scores`` of a block [ids, queries]; -inf is no score."""
        pack = self.packs.setdefault(queries.tobytes(), {"queries": queries, "least": np.full(len(queries), self.floor - self.slack), "rows": [], "new": 0})
        keep = (scores > -np.inf) & (scores >= pack["least"])
        if self.single and self.k is not None and len(ids) > self.k and np.count_nonzero(keep) > self.k * len(queries):
            pack["least"] = np.maximum(pack["least"], np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k] - self.slack)
            keep &= scores >= pack["least"]
        row, column = np.nonzero(keep)
        pack["rows"].append((column, ids[row], np.zeros(len(row), np.int64) if parts is None else parts[row], scores[row, column]))
        pack["new"] += len(row)
        if self.k is not None and pack["new"] > 2 * self.k * len(queries):
            self._cut(pack)

    def _cut(self, pack: dict) -> None:
        column, ids, parts, scores = (np.concatenate(x) for x in zip(*pack["rows"]))
        c, v = column, scores
        if not self.single:
            order = np.lexsort((-scores, ids, column))
            c, i, v = column[order], ids[order], scores[order]
            first = np.r_[True, (c[1:] != c[:-1]) | (i[1:] != i[:-1])] if len(c) else np.zeros(0, bool)
            c, v = c[first], v[first]
        order = np.lexsort((-v, c))
        c, v = c[order], v[order]
        starts = np.searchsorted(c, np.arange(len(pack["queries"])))
        full = np.flatnonzero(np.diff(np.r_[starts, len(c)]) >= self.k)
        pack["least"][full] = np.maximum(pack["least"][full], v[starts[full] + self.k - 1] - self.slack)
        keep = scores >= pack["least"][column]
        pack["rows"], pack["new"] = [(column[keep], ids[keep], parts[keep], scores[keep])], 0

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, ids, parts, scores), a pack of queries at a time."""
        for pack in self.packs.values():
            if self.k is not None:
                self._cut(pack)
            column, ids, parts, scores = (np.concatenate(x) for x in zip(*pack["rows"]))
            yield pack["queries"][column], ids, parts, scores

    def batches(self) -> Iterator[pa.RecordBatch]:
        for queries, ids, _, scores in self.rows():
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["query", "id", "score"])


def bm25_each(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query, id, score) of the documents that hold a term of a row (query, text) of ``queries``, in blocks; scores as in ``bm25``.

    With ``k`` at least the rows that are among the ``k`` best of a query. Queries of the same words are scored once.
    """
    counted = lengths(docs, id_col, text_col)
    size = F.broadcast(pool_size(counted))
    df = stored(document_frequency(counted).crossJoin(size).withColumn("idf", idf(F.col("df"), F.col("n"))))
    mean = F.broadcast(df.agg(F.avg("idf").alias("mean_idf")))
    worth = df.crossJoin(mean).select("term", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    uses = queries.select(F.col("query").cast("long").alias("query"), F.explode(tokens("text")).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    # A term in just half of the pool is worth 0 and still makes a hit.
    weight = F.when(F.col("idf") == 0, 1e-300).otherwise(F.col("times") * F.col("idf"))
    bags = uses.join(worth, "term").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("bag"))
    alike = stored(bags.groupBy("bag").agg(F.min("query").alias("query"), F.collect_list("query").alias("alike")))
    many, most = alike.agg(F.count(F.lit(1)), F.max(F.size("alike"))).first()
    full = max(1, -(-many // packed.__defaults__[0]))
    asked = alike.select("query", F.col("bag.term").alias("terms"), F.col("bag.weight").alias("weights"))
    asked = cut_lineage(sealed(asked.repartition(full), "asks")).coalesce(-(-full // PACKS))  # the rows are read and sealed once for each partition of it
    rows = sealed(counted.where("len > 0").select(F.col("id").cast("long").alias("id"), "len", "counts"), "block").crossJoin(size.select("avgdl"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, single=True)
        for batch in batches:
            for i in range(batch.num_rows):
                block, asks = opened(batch.column("block")[i]), opened(batch.column("asks")[i])
                ids, long, queries = (x.to_numpy() for x in (block.column("id"), block.column("len"), asks.column("query")))
                held, tf = block.column("counts").flatten().flatten()
                doc, tf = np.repeat(np.arange(len(ids)), block.column("counts").value_lengths()), tf.to_numpy()
                terms, weights, wide = asks.column("terms").flatten(), asks.column("weights").flatten().to_numpy(), asks.column("terms").value_lengths()
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * long[doc] / batch.column("avgdl")[i].as_py()))
                scores = block_product(doc, held, part, np.repeat(np.arange(len(queries)), wide), terms, weights, len(ids), len(queries))
                best.add(np.where(scores == 0, -np.inf, scores), queries, ids)
        yield from best.batches()

    got = rows.crossJoin(asked).mapInArrow(score, "query long, id long, score double").withColumn("score", F.round("score", 6))
    if (most or 1) == 1:
        return got
    got = got if k is None else top_each(got, k).drop("rank")
    return got.join(alike.select("query", "alike"), "query").select(F.explode("alike").alias("query"), "id", "score")


def share_each(rows: DataFrame, asked: DataFrame, k: int, floor: float) -> DataFrame:
    """(query, id, score): the share of ``most`` that the terms of a row (query, most, terms, weights) reach in a row (id, words), from about ``floor`` up."""
    held = packed(rows.where(F.size("words") > 0).select(F.col("id").cast("long").alias("id"), "words"))
    asks = cut_lineage(packed(asked.where(F.size("terms") > 0).select("query", "most", "terms", "weights")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, floor)
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
                ids, queries, most = (one[x].flatten().to_numpy() for x in ("id", "query", "most"))
                (long, words), (wide, terms), (_, weights) = (_flat(one[x]) for x in ("words", "terms", "weights"))
                row, column = np.repeat(np.arange(len(ids)), long), np.repeat(np.arange(len(queries)), wide)
                best.add(block_product(row, words, np.ones(len(row)), column, terms, weights.to_numpy() / most[column], len(ids), len(queries)), queries, ids)
        yield from best.batches()

    return held.crossJoin(asks).mapInArrow(score, "query long, id long, score double")


def block_product(row: np.ndarray, words: pa.Array, left: np.ndarray, column: np.ndarray, terms: pa.Array, right: np.ndarray, n: int, m: int) -> np.ndarray:
    """[n, m]: sums of left * right over equal words; (row, word) and (column, term) are unique."""
    vocabulary = terms.unique()
    size = len(vocabulary)
    term = pc.index_in(terms, vocabulary).to_numpy(zero_copy_only=False)
    at = pc.index_in(words, vocabulary)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    word, row, left = at.drop_null().to_numpy(zero_copy_only=False), row[known], left[known]
    out = np.zeros((n, m))
    if not len(word):
        return out
    in_rows, in_columns = np.bincount(word, minlength=size), np.bincount(term, minlength=size)
    # Terms of many rows and columns are multiplied as matrices, the others pair by pair.
    common = in_rows * in_columns > n * m // 250
    for some in np.array_split(np.flatnonzero(common), max(1, common.sum() // 1000)):
        place = np.full(size, -1)
        place[some] = np.arange(len(some))
        a, b = np.zeros((n, len(some))), np.zeros((len(some), m))
        x, y = place[word] >= 0, place[term] >= 0
        a[row[x], place[word[x]]] = left[x]
        b[place[term[y]], column[y]] = right[y]
        out += a @ b
    order = np.argsort(term, kind="stable")
    first = np.cumsum(in_columns) - in_columns
    rare = np.flatnonzero(~common[word])
    for some in np.array_split(rare, max(1, in_columns[word[rare]].sum() // 5_000_000)):
        times = in_columns[word[some]]
        own = np.repeat(some, times)
        other = order[np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[word[some]], times)]
        out += np.bincount(row[own] * m + column[other], left[own] * right[other], n * m).reshape(n, m)
    return out


def fuse(*lists: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists: one union and one aggregation."""
    out = lists[0].select(*by, "rank")
    for other in lists[1:]:
        out = out.unionByName(other.select(*by, "rank"))
    return out.groupBy(*by).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"))


def collapse(units: DataFrame, parent: str) -> DataFrame:
    """The best unit of each parent by score, then unit id."""
    best = units.groupBy(parent).agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("r"), F.count(F.lit(1)).alias("units"))
    return best.select(F.col(parent).alias("parent"), F.col("r.id").alias("unit"), F.col("r.score").alias("score"), "units")


def select_rows(rows: DataFrame, floor: float, window: float, slack: float = 0.02) -> DataFrame:
    """Score floor, a rescue of the first row just under it, and a window under the top score."""
    top = Window.partitionBy("query")
    first = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    rows = rows.withColumn("top", F.max("score").over(top)).withColumn("place", F.row_number().over(first))
    keep = (F.col("score") >= floor) | ((F.col("place") == 1) & (F.col("score") >= floor - slack))
    return rows.where(keep & (F.col("score") >= F.col("top") - window)).withColumn("rank", F.row_number().over(first)).drop("top", "place")


def demote(rows: DataFrame, flag: str, cap: int) -> DataFrame:
    """Flagged rows after the others, at most ``cap`` of them."""
    side = Window.partitionBy("query", flag).orderBy("rank")
    rows = rows.withColumn("n", F.row_number().over(side)).where(~F.col(flag) | (F.col("n") <= cap))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(flag, "rank"))).drop("n")
