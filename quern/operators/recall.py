"""Ranked recall: a table of queries against pools of notes, in one plan.

Notes are cut into units (their chunks, or the whole note). A unit's words are counted once, inside its row, and
written; everything else is derived from that table: document frequencies by one shuffle on the term, pool sizes by one
partial aggregation, hits of queries without a vector in blocks that keep what can be answered, hits of the others by
one join of the postings with the terms of these queries.

A unit matches a query when it holds a real term of it: no stop word, or a stop word in at most a twentieth of the units.
The keyword score is Okapi BM25 over the pool plus a bounded boost for labels that the query names. Where a query
has a vector, the cosine order and the keyword order are fused by reciprocal ranks; if the best keyword score is
negative the cosine order decides and only matched units without a vector keep a keyword rank. A note is
represented by its best unit and its best cosine. Queries without a vector pass the keyword gate or get nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import term_counts, tokens
from quern.operators.ranking import B, EPSILON, K1, RRF_K, Best, _flat, block_product, packed
from quern.session import cut_lineage, stored

#: The stop words of the keyword match.
STOP_WORDS = tuple(
    """
    about above after again am an and are as at be been before being below between
    both but by can could did do does doing don during each for from further had has
    have having he her here hers herself him himself his how if in into is it its
    itself just me more most my myself no nor not of on once only or other our ours
    ourselves own same she should so some such than that the their theirs them
    themselves then there these they this those through to too until very was we
    were what when where which while who whom why will with would you your yours
    yourself yourselves
    aren couldn didn doesn hadn hasn haven isn shouldn wasn weren won wouldn
    """.split()
)
#: Share of the units a stop word may be in, label boost and its most labels, and the gate's parameters.
RARE_SHARE = 20
BOOST, BOOST_LABELS = 0.4, 2
GATE_UNITS, GATE_WORDS, GATE_INFORMATIVE, GATE_RARE, GATE_ONE_SHARE, GATE_RARE_SHARE = 20, 2, 0.5, 0.1, 0.25, 0.12


def units_of(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(pool, note, part, weight, labels, text): the current chunks of each note, or the whole note as part 0."""
    whole = F.concat_ws("\n", "name", "description", "body")
    kept = ["pool", "note", "weight", "labels"]
    return notes.join(chunks.select("note", "part", "search_text"), "note", "left").select(*kept, F.coalesce("part", F.lit(0)).cast("long").alias("part"), F.coalesce("search_text", whole).alias("text"))


def _pooled(one: dict[str, pa.Array]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pool, scores, queries, notes, parts) for each pool that a pack of units and a pack of queries share; -inf where no real term matches."""
    notes, parts, lens, queries, avgdl = (one[x].flatten().to_numpy() for x in ("note", "part", "len", "query", "avgdl"))
    in_pool, for_pool = (np.array(one[x].flatten().to_pylist(), object) for x in ("pool", "asked_pool"))
    (each, words), (_, tf), (tags, labels) = (_flat(one[x]) for x in ("words", "tf", "labels"))
    (wide, terms), (_, weights), (_, reals), (many, named) = (_flat(one[x]) for x in ("terms", "weights", "reals", "named"))
    tf, weights, reals = tf.to_numpy(), weights.to_numpy(), reals.to_numpy()
    for pool in {*in_pool} & {*for_pool}:
        mine, ours = in_pool == pool, for_pool == pool
        n, m = mine.sum(), ours.sum()
        at, to = np.cumsum(mine) - 1, np.cumsum(ours) - 1
        w, t, l, q = np.repeat(mine, each), np.repeat(ours, wide), np.repeat(mine, tags), np.repeat(ours, many)
        row, column = np.repeat(np.arange(len(mine)), each)[w], np.repeat(np.arange(len(ours)), wide)[t]
        part = tf[w] * (K1 + 1) / (tf[w] + K1 * (1 - B + B * lens[row] / avgdl[ours][0]))
        held, said = words.filter(pa.array(w)), terms.filter(pa.array(t))
        scores = block_product(at[row], held, part, to[column], said, weights[t], n, m)
        real = block_product(at[row], held, np.ones(len(row)), to[column], said, reals[t], n, m)
        shared = block_product(at[np.repeat(np.arange(len(mine)), tags)[l]], labels.filter(pa.array(l)), np.ones(l.sum()), to[np.repeat(np.arange(len(ours)), many)[q]], named.filter(pa.array(q)), np.ones(q.sum()), n, m)
        scores += BOOST * np.minimum(np.rint(shared), BOOST_LABELS)
        yield pool, np.where(real > 0.5, scores, -np.inf), queries[ours], notes[mine], parts[mine]


class Recall:
    """Statistics of the pools of ``units``; ``answer`` ranks a table of queries."""

    def __init__(self, units: DataFrame):
        words = units.select("pool", "note", "part", "weight", "labels", tokens("text").alias("w"))
        self.words = stored(words.select("pool", "note", "part", "weight", "labels", F.size("w").alias("len"), term_counts(F.col("w")).alias("counts")))
        self.labels = self.words.select("note", "labels").where(F.size("labels") > 0).distinct()
        self.units = self.words.select("pool", "note", "part", "weight")
        self.postings = self.words.select("pool", "note", "part", "len", F.inline("counts"))
        self.size = self.words.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
        held = self.postings.groupBy("pool", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))
        n, df = F.col("n"), F.col("df")
        self.terms = stored(held.join(self.size, "pool").withColumn("idf", F.log(n - df + 0.5) - F.log(df + 0.5)))
        floor = self.terms.groupBy("pool").agg((EPSILON * F.avg("idf")).alias("floor"))
        self.pools = self.size.join(floor, "pool", "left").join(self._cuts(), "pool", "left")

    def _cuts(self) -> DataFrame:
        """Per pool the df up to which terms hold a share of all uses; over distinct df values, never over terms."""
        by_df = self.terms.groupBy("pool", "df").agg(F.sum("uses").alias("uses"))
        w = Window.partitionBy("pool")
        run = by_df.select("pool", "df", F.sum("uses").over(w.orderBy("df")).alias("run"), F.sum("uses").over(w).alias("total"))
        cut = lambda mass: F.min(F.when(F.col("run") >= mass * F.col("total"), F.col("df")))
        return run.groupBy("pool").agg(cut(GATE_INFORMATIVE).alias("informative"), cut(GATE_RARE).alias("rare"))

    def query_terms(self, queries: DataFrame) -> DataFrame:
        """(query, pool, term, times, df, idf, real) of the terms that the pool holds; df is null for others."""
        asked = queries.select("query", "pool", F.explode(tokens("text")).alias("term")).groupBy("query", "pool", "term").agg(F.count(F.lit(1)).alias("times"))
        known = asked.join(self.terms.select("pool", "term", "df", "idf"), ["pool", "term"], "left").join(self.pools, "pool")
        stop = F.col("term").isin(*STOP_WORDS)
        idf = F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))
        real = F.col("df").isNotNull() & (~stop | (F.col("df") * RARE_SHARE <= F.col("n")))
        return known.select("query", "pool", "term", "times", "df", "n", "avgdl", "informative", "rare", idf.alias("idf"), stop.alias("stop"), real.alias("real"))

    def matches(self, queries: DataFrame, terms: DataFrame) -> DataFrame:
        """(query, note, part, bm25): matched units with the label boost, rounded to six places."""
        hit = self.postings.join(terms.where("df is not null"), ["pool", "term"])
        part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        scored = hit.groupBy("query", "pool", "note", "part").agg(F.sum(part).alias("score"), F.max("real").alias("real")).where("real")
        boost = self.boosts(queries)
        total = F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6)
        return scored.join(boost, ["query", "note"], "left").select("query", "note", "part", total.alias("bm25"))

    def named(self, queries: DataFrame) -> DataFrame:
        """(query, pool, label): tokens of the query, and what stands behind a slash in one."""
        said = queries.select("query", "pool", F.explode(F.array_distinct(tokens("text"))).alias("token"))
        ends = F.transform(F.sequence(F.lit(2), F.size(F.split("token", "/"))), lambda i: F.array_join(F.slice(F.split("token", "/"), i, 1000), "/"))
        return said.select("query", "pool", F.explode(F.concat(F.array("token"), F.when(F.contains("token", F.lit("/")), ends).otherwise(F.array().cast("array<string>")))).alias("label")).distinct()

    def boosts(self, queries: DataFrame) -> DataFrame:
        """(query, note, boost): labels that are a token of the query, or end a path in it; an equi-join on the label."""
        pools = self.units.select("note", "pool").distinct()
        own = self.labels.select("note", F.explode("labels").alias("label")).join(pools, "note")
        found = own.join(self.named(queries), ["pool", "label"]).groupBy("query", "note").agg(F.countDistinct("label").alias("k"))
        return found.select("query", "note", (BOOST * F.least("k", F.lit(BOOST_LABELS))).alias("boost"))

    def best(self, terms: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
        """(query, note, part, score): of ``matches``, in blocks, at least all units that are not below the best unit of a query's ``k``-th note.

        Packs of units are multiplied with packs of queries, pool by pool, so no pair of a query and a unit is a row; with
        ``queries`` scores hold the label boost. Scores are not rounded.
        """
        weight = F.col("times") * F.col("idf")
        asked = terms.where("df is not null").groupBy("query", "pool", "avgdl").agg(F.collect_list("term").alias("terms"), F.collect_list(weight).alias("weights"), F.collect_list(F.col("real").cast("double")).alias("reals")).where(F.exists("reals", lambda x: x > 0))
        if queries is None:
            asked = asked.withColumn("named", F.array().cast("array<string>"))
        else:
            said = self.named(queries).join(self.labels.select(F.explode("labels").alias("label")).distinct(), "label")
            asked = asked.join(said.groupBy("query").agg(F.collect_set("label").alias("named")), "query", "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
        asked = asked.select(F.col("query").cast("long").alias("query"), F.col("pool").alias("asked_pool"), "avgdl", "terms", "weights", "reals", "named")
        rows = self.words.where("len > 0").select("pool", F.col("note").cast("long").alias("note"), "part", "len", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.col("counts.term").alias("words"), F.col("counts.tf").alias("tf"))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[str, Best] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    one = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
                    for pool, scores, queries, notes, parts in _pooled(one):
                        kept.setdefault(pool, Best(k)).add(scores, queries, notes, parts)
            for best in kept.values():
                for x in best.rows():
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in x], names=["query", "note", "part", "score"])

        return packed(rows).crossJoin(cut_lineage(packed(asked))).mapInArrow(score, "query long, note long, part long, score double")

    def answer(self, queries: DataFrame, cosines: DataFrame, top_k: int) -> DataFrame:
        """``queries`` (query, pool, text), ``cosines`` (query, note, part, cosine) or None: (query, rank, note, part, mode, score, fusion, bm25)."""
        terms = stored(self.query_terms(queries))
        if cosines is None:
            return self.gate(stored(self._by_words(queries, terms, top_k)), queries, terms)
        cosines = stored(cosines)
        near = cosines.select("query").distinct()
        fused = self._fused(queries.join(near, "query", "left_semi"), terms.join(near, "query", "left_semi"), cosines, top_k)
        rest = self._by_words(queries.join(near, "query", "left_anti"), terms.join(near, "query", "left_anti"), top_k)
        return self.gate(stored(fused.unionByName(rest)), queries, terms)

    def _by_words(self, queries: DataFrame, terms: DataFrame, top_k: int) -> DataFrame:
        """Answers of queries without a vector: the keyword order, a note standing where its best unit does."""
        place = Window.partitionBy("query").orderBy(F.col("bm25").desc(), "note", "part")
        found = self.best(terms, top_k, queries).select("query", "note", "part", F.round("score", 6).alias("bm25")).withColumn("place", F.row_number().over(place))
        one = found.withColumn("first", F.row_number().over(Window.partitionBy("query", "note").orderBy("place"))).where("first = 1")
        ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where(F.col("rank") <= top_k)
        return ranked.select("query", "rank", "note", "part", F.lit("keyword").alias("mode"), F.lit(None).cast("double").alias("score"), F.round(1.0 / (RRF_K + F.col("place")), 6).alias("fusion"), "bm25")

    def _fused(self, queries: DataFrame, terms: DataFrame, cosines: DataFrame, top_k: int) -> DataFrame:
        """Answers of queries with a vector; every match has a rank here, as fusion needs those of far rows, too."""
        place = Window.partitionBy("query").orderBy(F.col("bm25").desc(), "note", "part")
        by_words = self.matches(queries, terms).withColumn("word_rank", F.row_number().over(place))
        sem = cosines.join(self.units, ["note", "part"]).select("query", "note", "part", F.round(F.col("cosine") * F.col("weight"), 4).alias("sem"))
        by_sem = sem.withColumn("sem_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("sem").desc(), "note", "part")))
        both = by_words.join(by_sem, ["query", "note", "part"], "full_outer")
        q = Window.partitionBy("query")
        both = both.withColumns({"hybrid": F.max("sem").over(q).isNotNull(), "best": F.max(F.when(F.col("word_rank") == 1, F.col("bm25"))).over(q)})
        # with a negative best score only matched units without a cosine keep a keyword rank, counted anew
        lone = F.row_number().over(Window.partitionBy("query", F.col("sem").isNull() & F.col("word_rank").isNotNull()).orderBy("word_rank"))
        word_rank = F.when(F.col("best") >= 0, F.col("word_rank")).when(F.col("sem").isNull() & F.col("word_rank").isNotNull(), F.when(F.col("hybrid"), lone).otherwise(F.col("word_rank")))
        rr = lambda c: F.coalesce(1.0 / (RRF_K + c), F.lit(0.0))
        both = both.withColumn("list_rank", word_rank).where("list_rank is not null or sem_rank is not null")
        both = both.withColumn("fusion", F.round(rr(F.col("list_rank")) + rr(F.col("sem_rank")), 6))
        # keyword mode keeps the keyword order itself, whose fused score falls with the rank
        order = (F.when(~F.col("hybrid"), F.col("word_rank")), F.col("fusion").desc(), F.col("note"), F.col("part"))
        file = Window.partitionBy("query", "note")
        one = both.withColumns({"score": F.max("sem").over(file), "first": F.row_number().over(file.orderBy(*order))}).where("first = 1")
        ranked = one.withColumn("rank", F.row_number().over(q.orderBy(*order))).where(F.col("rank") <= top_k)
        out = ranked.select("query", "rank", "note", "part", F.when(F.col("hybrid"), "hybrid").otherwise("keyword").alias("mode"), "score", "fusion", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
        return out

    def gate(self, ranked: DataFrame, queries: DataFrame, terms: DataFrame) -> DataFrame:
        """Drops the answers of keyword queries whose first row says too little about the query."""
        top = ranked.where("rank = 1 and mode = 'keyword'").select("query", "note", "part")
        w = Window.partitionBy("query")
        # a real stop word counts only where the query has no other real term
        own = terms.withColumn("other", F.max(F.col("real") & ~F.col("stop")).over(w))
        own = own.withColumn("asked", F.col("real") & (~F.col("stop") | ~F.col("other")))
        tf = self.words.select("note", "part", "len", "counts").join(top, ["note", "part"]).select("query", "len", F.inline("counts"))
        sized = own.join(tf, ["query", "term"], "left")
        cap = F.floor(F.col("n") / 2)
        got = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        one = F.greatest(F.lit(0.0), F.log(F.col("n") - 1 + 0.5) - F.log(F.lit(1.5)))
        each = sized.groupBy("query").agg(
            F.max("n").alias("n"), F.count_if(F.col("asked") & F.col("tf").isNotNull() & (F.col("df") <= F.least("informative", cap))).alias("informative"),
            F.count_if("asked").alias("terms"), F.count_if(F.col("asked") & F.col("tf").isNotNull() & (F.col("df") <= F.least("rare", cap))).alias("rare"),
            F.coalesce(F.sum(F.when(F.col("asked"), got)), F.lit(0.0)).alias("got"),
            ((K1 + 1) * (F.coalesce(F.sum(F.when(F.col("asked"), F.col("idf"))), F.lit(0.0)) + F.max(one) * F.count_if(F.col("df").isNull() & ~F.col("stop")))).alias("most"),
        )
        share = F.when(F.col("most") > 0, F.col("got") / F.col("most")).otherwise(F.lit(0.0))
        own = top.join(self.labels, "note").select("query", F.explode("labels").alias("label"))
        named = own.join(self.named(queries), ["query", "label"], "left_semi").select("query", F.lit(True).alias("named")).distinct()
        passes = (F.col("n") < GATE_UNITS) | (F.col("informative") >= GATE_WORDS) | ((F.col("informative") >= 1) & (share >= GATE_ONE_SHARE)) | ((F.col("terms") > 0) & (F.col("rare") == F.col("terms")) & (share >= GATE_RARE_SHARE))
        verdict = each.join(named, "query", "left").select("query", (passes | F.coalesce("named", F.lit(False))).alias("passes"), F.round(share, 6).alias("score_share"))
        return ranked.join(verdict, "query", "left").where("mode = 'hybrid' or passes").drop("passes")
