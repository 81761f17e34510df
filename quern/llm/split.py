"""Problem 1: cut oversized chunks into pieces at natural borders.

Dynamic programming over border positions. Every border has a penalty (section < paragraph < list
line < line < sentence < word < character; borders inside a code fence cost much more), every piece
pays for being there and for its distance from an even size. The cheapest chain of cuts wins, subject
to ``limit`` characters a piece *including* the repeated sentence it starts with.

Defined results: null or blank text gives one empty piece that is not oversized; null ``continued``
means false; among rows with one (parent, index) the highest ``rev`` counts, then the highest
``chunk_id``; repeated rows fall together; a text without any white space is cut between characters,
never before a combining mark. Extra columns are ignored. An empty table gives an empty result.

Overlap: a piece begins with the last sentence (or line) of the piece before it, also across blank lines. Of a
sentence longer than ``overlap``, and at a cut between words, the last whole words that fit into ``overlap`` are
repeated. Nothing is repeated at a section border (the next piece is no continuation), inside a code fence, at a
cut between characters, and where the repetition leaves no room for any text. The repeated first line of a
chunk that was itself continued stays whole up to half the limit.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import once

LIMIT = 1200
OVERLAP = 240

SECTION, PARAGRAPH, ITEM, LINE, SENTENCE, WORD, CHAR = range(7)
PENALTY = np.array([0.0, 0.05, 0.15, 0.3, 0.6, 2.5, 12.0])
FENCE_PENALTY = 8.0

_fence = re.compile(r" {0,3}(`{3,}|~{3,})")
#: Up to three spaces, one to six hash signs, a title, and perhaps a closing run of hash signs behind a space.
_heading = re.compile(r"[ ]{0,3}(#{1,6})(?![^ \t])[ \t]*(.*?)(?:(?:^|[ \t]+)#+)?[ \t]*")
_item = re.compile(r"[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]")
_sentence_gap = re.compile(r"[.!?。！？…][\"')\]]*\s+(?=\S)|[。！？]")

PIECES = "array<struct<text:string,heading:string,continued:boolean>>"


def _borders(text: str, step: int):
    """Positions, kinds, whether inside a fence, and the headings seen: (position, level, title)."""
    kind: dict[int, int] = {}
    fenced: set[int] = set()
    titles: list[tuple[int, int, str]] = []
    at, fence, blank = 0, "", False
    for line in text.split("\n"):
        mark = _fence.match(line)
        opening = bool(mark) and not fence
        if at:
            if fence:
                kind[at] = LINE
                fenced.add(at)
            elif blank:
                kind[at] = PARAGRAPH
            else:
                kind[at] = ITEM if _item.match(line) else LINE
        if not fence and not opening:
            title = _heading.fullmatch(line)
            if title and title[2].strip():
                if at:
                    kind[at] = SECTION
                titles.append((at, len(title[1]), title[2].strip()))
        inside = bool(fence) or opening
        for gap in _sentence_gap.finditer(line):
            if not inside and gap.end() < len(line):
                kind.setdefault(at + gap.end(), SENTENCE)
        if inside:
            fenced.update(at + gap.end() for gap in re.finditer(r"\s+", line))
        if opening:
            fence = mark[1]
        elif fence and mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
            fence = ""
        blank = not line.strip()
        at += len(line) + 1
    stops = sorted({0, len(text), *kind})
    for low, high in zip(stops, stops[1:]):
        if high - low <= step:
            continue
        for gap in re.finditer(r"\s+", text[low:high]):
            if low + gap.end() < high:
                kind.setdefault(low + gap.end(), WORD)
    stops = sorted({0, len(text), *kind})
    for low, high in zip(stops, stops[1:]):
        for cut in range(low + step // 4, high, step // 4) if high - low > step else ():
            while cut < high and unicodedata.combining(text[cut]):
                cut += 1
            if cut < high:
                kind.setdefault(cut, CHAR)
    return kind, fenced, titles


def _path(base: str, titles: list[tuple[int, int, str]], at: int) -> str:
    """The headings that hold at a position, outermost first: seen from there, each one above all that follow it."""
    inner, above = [], 7
    for _, level, title in reversed([t for t in titles if t[0] <= at]):
        if level < above:
            inner, above = [title, *inner], level
    outer = [x for x in base.split(" > ") if x]
    if inner and outer and outer[-1] == inner[0]:
        outer.pop()
    return " > ".join(outer + inner)


def _tail(said: str, overlap: int) -> str:
    """``said``, or its last whole words within ``overlap`` characters."""
    return said if len(said) <= overlap else said[-overlap - 1 :].partition(" ")[2].strip()


def split_text(text: str, heading: str = "", lead: str = "", limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, str, bool]]:
    """Pieces (text, heading, continued) of ``text``; ``lead`` is the sentence its first piece repeats."""
    lead = lead if len(lead) <= limit // 2 else _tail(lead, overlap)
    kinds, fenced, titles = _borders(text, max(8, (limit - overlap) // 3))
    pos = np.array([0, *sorted(k for k in kinds if 0 < k < len(text)), len(text)], dtype=np.int64)
    n = len(pos)
    cost = np.zeros(n)
    repeat = np.zeros(n, dtype=np.int64)
    again: dict[int, str] = {0: lead}
    unit = before = 0  # where the current sentence or line begins, and the last one that isn't blank
    for j in range(1, n - 1):
        p = int(pos[j])
        k = kinds[p]
        cost[j] = PENALTY[k] + (FENCE_PENALTY if p in fenced else 0.0)
        if text[unit:p].strip():
            before = unit
        if k not in (SECTION, CHAR) and p not in fenced and before not in fenced:
            said = text[before:p].strip()
            if said and "\n" not in said and not _fence.match(said):
                again[j] = _tail(said, overlap)
                repeat[j] = len(again[j]) + 1 if again[j] else 0
        if k <= SENTENCE:
            unit = p
    if lead:
        repeat[0] = len(lead) + 1
    room = limit - overlap // 2
    even = len(text) / max(1, -(-len(text) // room))
    best = np.full(n, np.inf)
    came = np.zeros(n, dtype=np.int64)
    best[0] = 0.0
    low = np.searchsorted(pos, pos - limit, side="left")
    for j in range(1, n):
        i = np.arange(low[j], j)
        size = pos[j] - pos[i]
        total = best[i] + 1.0 + 0.5 * ((size - even) / even) ** 2
        total[size + repeat[i] > limit] = np.inf
        k = int(np.argmin(total))
        if not np.isfinite(total[k]):  # the repeated sentence leaves no room: go on without it
            total = best[i] + 1.0
            total[repeat[i] == 0] = np.inf
            k = int(np.argmin(total))
            repeat[i[k]] = 0
        best[j] = total[k] + cost[j]
        came[j] = i[k]
    cuts = [n - 1]
    while cuts[-1] > 0:
        cuts.append(int(came[cuts[-1]]))
    cuts.reverse()
    out = []
    for a, b in zip(cuts, cuts[1:]):
        body = text[pos[a] : pos[b]].strip("\n").rstrip()
        said = again.get(a, "") if repeat[a] else ""
        if not body.strip():
            continue
        out.append((f"{said}\n{body}" if said else body, _path(heading, titles, int(pos[a])), bool(said)))
    return out


def current_chunks(chunks: DataFrame) -> DataFrame:
    """The row of each (parent_id, chunk_index) with the highest ``rev``, its text made ready."""
    row = F.struct("text", "heading", F.coalesce("continued", F.lit(False)).alias("continued"), "chunk_id")
    latest = chunks.groupBy("parent_id", "chunk_index").agg(F.max_by(row, F.struct("rev", "chunk_id", F.xxhash64("text", "heading", "continued"))).alias("r"))
    text = F.trim(F.regexp_replace(F.coalesce("r.text", F.lit("")), "\r\n", "\n"), F.lit(" \t\r\n"))
    got = latest.select("parent_id", "chunk_index", "r.chunk_id", F.coalesce("r.heading", F.lit("")).alias("heading"), "r.continued", text.alias("whole"))
    at = F.instr("whole", "\n")
    lead = F.when(F.col("continued"), F.when(at == 0, F.col("whole")).otherwise(F.expr("substring(whole, 1, instr(whole, '\\n') - 1)"))).otherwise(F.lit(""))
    body = F.when(F.col("continued"), F.when(at == 0, F.lit("")).otherwise(F.expr("substring(whole, instr(whole, '\\n') + 1)"))).otherwise(F.col("whole"))
    return got.withColumn("lead", lead).withColumn("body", body)


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row a piece: parent_id, chunk_index, piece_no (from 0), pieces, cut (the chunk was too long), heading, continued, text."""

    @F.pandas_udf(PIECES)
    def cut(text: pd.Series, heading: pd.Series, lead: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"text": x, "heading": h, "continued": c} for x, h, c in split_text(t, head, first, limit, overlap)] for t, head, first in zip(text, heading, lead)])

    long: Column = F.char_length("body") > limit
    ready = current_chunks(chunks)
    whole = F.array(F.struct(F.col("whole").alias("text"), F.col("heading").alias("heading"), F.col("continued").alias("continued")))
    done = ready.withColumn("cut", once(cut)(F.when(long, F.col("body")), F.when(long, F.col("heading")), F.when(long, F.col("lead"))))
    pieces = F.when(long & (F.size("cut") > 0), F.col("cut")).otherwise(whole)
    return (
        done.withColumn("parts", pieces)
        .select("parent_id", "chunk_index", F.size("parts").alias("pieces"), long.alias("cut"), F.posexplode("parts").alias("piece_no", "p"))
        .select("parent_id", "chunk_index", "piece_no", "pieces", "cut", "p.heading", "p.continued", "p.text")
    )


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The chunks that were too long for ``split_oversized``."""
    return split_oversized(chunks, limit).where((F.col("piece_no") == 0) & F.col("cut")).select("parent_id", "chunk_index")
