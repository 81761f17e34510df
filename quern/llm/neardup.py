"""Problem 3: near-duplicate records by multi-index hashing.

Each text gets a fingerprint of ``SEGMENTS * WORDS`` min-hash words of its word shingles. It is cut into
segments, and each segment into one table per position of the small Hamming ball of radius one word: two
segments that differ in at most one word agree in a table that leaves that word out. Pairs that match in
two tables at least are candidates. Their complete distance decides: first the Hamming distance of the
fingerprints (two bits of every word) and the ratio of their sizes, which travel with the ids, then, for
what is left, the exact Jaccard similarity of the shingle sets.

At similarity 0.55, the lowest that occurs above the gap of this project's data, one segment catches a
pair with probability 0.55^4 + 4 * 0.55^3 * 0.45 = 0.39; at least two of twenty-four segments catch it
with probability 0.9999, and more similar pairs sooner. ``SLACK`` standard deviations over the distance expected at the
wanted similarity let 0.9999 of the pairs at that very similarity through.

Texts with the same words are one class before any table is built, so groups of exact copies, however
large, cost one row. Texts with fewer words than a shingle have no shingles and are in no pair.
Null ``description`` or ``body`` counts as empty. Of one key the highest ``rev`` counts. A hot table key is
split by the skew join of adaptive execution; joins that move sets never broadcast them.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.session import cut_lineage, once, stored

SEGMENTS, WORDS = 24, 4
BITS = 2 * SEGMENTS * WORDS
#: A candidate agrees in two tables at least: by itself, chance agreement in one table grows with the square of the collection.
MATCHES = 2
#: Standard deviations that the distance of a wanted pair may exceed its expectation by.
SLACK = 3.8
#: Shingles that are hashed at once.
BLOCK = 8192
_word = re.compile(r"[^\W_]+")
_seeded = np.random.default_rng(20240607)
_mul = _seeded.integers(1, 2**63, SEGMENTS * WORDS, dtype=np.uint64) | np.uint64(1)
_add = _seeded.integers(0, 2**63, SEGMENTS * WORDS, dtype=np.uint64)
_mix = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
PRINT = "struct<shingles:array<bigint>,print:array<int>,bits:array<bigint>>"
_known: dict[str, int] = {}


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _mix[1]
    x = (x ^ (x >> np.uint64(27))) * _mix[2]
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> list[int]:
    try:
        return [_known[w] for w in words]
    except KeyError:
        if len(_known) > 1_000_000:
            _known.clear()
        for w in words:
            if w not in _known:
                _known[w] = int.from_bytes(hashlib.blake2b(w.encode(errors="surrogatepass"), digest_size=8).digest(), "little")
        return [_known[w] for w in words]


def shingle_hashes(texts: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the runs of ``n`` words of many texts, and how many each text has."""
    size = np.array([len(w) for w in texts], dtype=np.int64)
    each = np.array([h for w in texts for h in _word_hashes(w)], dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), size)
    if len(each) < n:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    rolled = np.zeros(len(each) - n + 1, dtype=np.uint64)
    for k in range(n):
        rolled = _scramble(rolled * _mix[0] + each[k : k + len(rolled)])
    whole = owner[: len(rolled)] == owner[n - 1 :]
    rolled, owner = rolled[whole], owner[: len(rolled)][whole]
    order = np.lexsort((rolled, owner))
    rolled, owner = rolled[order], owner[order]
    first = np.ones(len(rolled), dtype=bool)
    first[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
    return rolled[first], np.bincount(owner[first], minlength=len(texts))


def min_hashes(shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The min-hash words of every text, [texts, SEGMENTS * WORDS]; a text without shingles has the largest number."""
    out = np.full((len(size), SEGMENTS * WORDS), np.uint64(2**64 - 1))
    owner = np.repeat(np.arange(len(size)), size)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK, None] * _mul[None] + _add[None]
        part ^= part >> np.uint64(32)
        own = owner[at : at + BLOCK]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] = np.minimum(out[own[first]], np.minimum.reduceat(part, first, axis=0))
    return out


def bits_of(mins: np.ndarray) -> np.ndarray:
    """Two bits of every word, packed: [texts, bits / 64] as signed numbers."""
    two = np.stack([_scramble(mins) & np.uint64(1), (_scramble(mins) >> np.uint64(1)) & np.uint64(1)], axis=2).astype(np.uint8)
    return np.packbits(two.reshape(len(mins), -1), axis=1).view(np.int64)


def most_distance(least: float) -> int:
    """The largest Hamming distance (of two bits a word) at which a pair of similarity ``least`` is still looked at."""
    words, other = SEGMENTS * WORDS, 1 - least
    return math.ceil(words * other + SLACK * math.sqrt(words * (1.5 * other - other * other)))


def fingerprints(df: DataFrame, n: int) -> DataFrame:
    """``df`` (id, text) with its shingles, its fingerprint (32 bits a word) and two bits of each word."""

    @F.pandas_udf(PRINT)
    def make(texts: pd.Series) -> pd.DataFrame:
        shingles, size = shingle_hashes([words_of(t) for t in texts], n)
        mins = min_hashes(shingles, size)
        parts = np.split(shingles.view(np.int64), np.cumsum(size)[:-1])
        return pd.DataFrame({"shingles": parts, "print": list((_scramble(mins) >> np.uint64(32)).astype(np.uint32).view(np.int32)), "bits": list(bits_of(mins))})

    return df.select("id", once(make)("text").alias("f")).select("id", "f.*")


def _tables(prints: DataFrame) -> DataFrame:
    """(id, key): for each segment, one key for each word left out; the tables of the ball of radius one."""
    word = lambda i: F.element_at("print", i + 1)
    keys = [F.xxhash64(F.lit(s * WORDS + k), *[word(s * WORDS + j) for j in range(WORDS) if j != k]) for s in range(SEGMENTS) for k in range(WORDS)]
    return prints.select("id", F.explode(F.array(*keys)).alias("key"))


class NearDuplicates:
    """Candidate search and verification over one table; the parts are materialised once.

    ``classes`` (id, rep): the smallest id with the same words. ``links`` (a, b, similarity): pairs of
    representatives, a < b, whose similarity is at least ``least``.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int = 5, least: float = 0.8):
        plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
        texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), plain.alias("plain"))
        texts = stored(texts.select("id", "text", F.xxhash64("plain").alias("h1"), F.xxhash64(F.lit(7), "plain").alias("h2")))
        reps = texts.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
        whole = stored(fingerprints(texts.join(reps.select(F.col("rep").alias("id")), "id", "left_semi"), n)).where(F.size("shingles") > 0)
        self.classes = texts.select("id", "h1", "h2").join(reps, ["h1", "h2"]).select("id", "rep").join(whole.select(F.col("id").alias("rep")), "rep", "left_semi").select("id", "rep")
        tables = _tables(whole)
        x, y = tables.select(F.col("id").alias("a"), "key"), tables.select(F.col("id").alias("b"), "key").hint("merge")
        pairs = x.join(y, "key").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MATCHES).select("a", "b")
        short = whole.select("id", F.size("shingles").alias("size"), *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITS // 64)])
        self.candidates = pairs = cut_lineage(self._close(pairs, short, least))
        asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = whole.select("id", "shingles").join(asked, "id", "left_semi")
        left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
        score = F.col("common") / (F.col("total") - F.col("common"))
        self.links = cut_lineage(shared.select("a", "b", score.alias("similarity")).where(F.col("similarity") >= least))

    @staticmethod
    def _close(pairs: DataFrame, short: DataFrame, least: float) -> DataFrame:
        """The pairs whose sizes and whole fingerprints allow a similarity of ``least``."""
        side = lambda name: short.select(*[F.col(c).alias(name if c == "id" else f"{name}_{c}") for c in short.columns]).hint("merge")
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        ratio = F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size")
        distance = sum((F.bit_count(F.col(f"a_bits{i}").bitwiseXOR(F.col(f"b_bits{i}"))) for i in range(BITS // 64)), F.lit(0))
        return both.where(ratio & (distance <= most_distance(least))).select("a", "b")

    def pairs(self) -> DataFrame:
        """Every pair of ids, copies expanded: a < b."""
        left = self.classes.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
        right = self.classes.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
        between = self.links.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("ia", "ib")
        twins = left.join(right.hint("merge"), (F.col("a") == F.col("b")) & (F.col("ia") < F.col("ib"))).select("ia", "ib")
        return between.unionAll(twins).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))

    def groups(self) -> DataFrame:
        """One row for each id that has any duplicate: id, group_id (smallest id), rep, links of its class, copies."""
        degree = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        copies = self.classes.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
        comp = components(self.links).withColumnRenamed("node", "rep")
        found = self.classes.join(comp, "rep", "left").join(degree, "rep", "left").join(copies, "rep")
        return found.where("links is not null or copies > 1").select("id", F.coalesce("component", "rep").alias("group_id"), "rep", F.coalesce("links", F.lit(0)).alias("links"), "copies")


def memory_texts(memories: DataFrame) -> DataFrame:
    """(memory_id, text) of the current rows: description and body joined by a space."""
    last = memories.where("memory_id is not null").groupBy("memory_id").agg(F.max_by(F.struct("description", "body"), F.struct("rev", "updated_at", F.xxhash64("description", "body"))).alias("r"))
    return last.select("memory_id", F.concat_ws(" ", F.coalesce("r.description", F.lit("")), F.coalesce("r.body", F.lit(""))).alias("text"))
