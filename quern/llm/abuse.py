"""Problem 8: abusive, hateful or sexual content, scored by a bidirectional gated recurrent network.

Every text is read whole, in all its overlapping windows of ``WINDOW`` words: one begins at every word, in
training as in scoring. A word enters as the mean of rows of one table, picked by hashes of the word and of its
character trigrams, so spellings that were never seen still have a vector. Two gated recurrent layers read the
text in both directions, attention pools their states over each window, and a logistic unit scores it; the
score of a document is that of its worst window.

The recurrent states are shared by the windows. A text is read in tiles of ``TILE`` words, each entered
``CONTEXT`` words before it, so the state at a word has read that many words in its direction, or all there are;
tiles are counted from the beginning of the text, so a score doesn't depend on other texts or on batches.

The network is trained in numpy on a bounded sample of labelled documents (at most ``MAX_LABELLED`` of them and
``MAX_CHARS`` characters, whole texts picked by a hash of the id), in a fixed number of steps. A step takes chunks of
``STARTS`` windows, and the worst window of each is moved towards its label. Labels belong to documents and
raters err, so training alternates: the chunk of an abusive document that scores highest now stands for it
(at first by the log odds of its words), documents that contradict the network after a round are set aside, and the
clean chunks that score highest are shown most often.

Defined results: a text without words (null, blank) scores 0, a text shorter than a window is one window;
documents with contradicting labels are not used for training; a word is read in lower case, with look-alike
letters, digits for letters, spaced letters and repeated letters folded, and only numbers and hashes are read as one
token each; without both labels nothing can be learnt, and every score is 0.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.mixing import source_name

WINDOW = 32
CONTEXT, TILE = 16, 64
#: Windows of a chunk in training, and the words it has with its context.
STARTS = 33
CHUNK = CONTEXT + STARTS + WINDOW - 1 + CONTEXT
WIDTH, STATE, ROWS = 24, 16, 16384
MAX_LABELLED, MAX_CHARS = 5000, 32_000_000
THRESHOLD = 0.5
ROUNDS, STEPS, BATCH = 4, 120, 240
#: Share of the labelled documents that is kept from training to find the threshold, which 0.5 then stands for.
HELD_OUT = 0.15

#: Letters of other alphabets that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans("аесорхуіјѕԁһкмтвнαεορτυνκι", "aecopxyijsdhkmtbhaeoptuvki")
LEET = str.maketrans("013457@$!", "oieastasi")
_keep = frozenset("*@$!'")
_break = {i: " " for i in range(128) if not chr(i).isalnum() and chr(i) not in _keep}
_break.update(dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))  # invisible characters vanish
_break_ascii = "".join(_break.get(i) or chr(i) for i in range(128))
_edges = re.compile(r"^[^\w*@$]+|[^\w*]+$")
#: Certainly a hash: hexadecimal, two digits or more, and of digest length or with a digit that stands for no letter.
_hash = re.compile(r"(?=(?:.*[0-9]){2})(?:[0-9a-f]{16,}|(?=.*[2689])[0-9a-f]{7,15})")
_escape = re.compile(r"\\u(0[0-9a-f]{3})")
_runs = re.compile(r"(.)\1{2,}")
PAD = ""


def canonical(word: str) -> str:
    """The form a raw word is read in."""
    word = _edges.sub("", word)
    if word.isdigit():
        return "0"
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word).lower()
        if any("a" <= c <= "z" for c in word) or all(ord(c) in LOOKALIKES for c in word):
            word = word.translate(LOOKALIKES)
    if not word.isalpha() and "*" not in word:
        if _hash.fullmatch(word):
            return "0a"
        word = word.translate(LEET)
    return _runs.sub(r"\1", word).replace("’", "'")


def raw_words(text: str) -> list[str]:
    """Words as they are written, in lower case; three or more single letters in a row are one word."""
    text = text.lower()
    if "\\u0" in text:  # letters that an exporter left escaped
        text = _escape.sub(lambda m: chr(int(m[1], 16)), text)
    words = text.translate(_break_ascii if text.isascii() else _break).split()
    single = [i for i, w in enumerate(words) if len(w) == 1]
    if len(single) < 3:
        return words
    out, at = [], 0
    for i, j in enumerate(single):
        if i and single[i - 1] == j - 1:
            continue
        end = j
        while i + 1 < len(single) and single[i + 1] == end + 1:
            i, end = i + 1, end + 1
        if end - j >= 2:
            out += [*words[at:j], "".join(words[j : end + 1])]
            at = end + 1
    return out + words[at:]


@lru_cache(maxsize=100_000)
def features(word: str) -> list[int]:
    if word == PAD:
        return [0]
    marked = f"^{word}$"
    grams = [marked] + [marked[i : i + 3] for i in range(len(marked) - 2)]
    return [1 + zlib.crc32(g.encode(errors="surrogatepass")) % (ROWS - 1) for g in grams]


class Words:
    """Numbers for words; 0 is padding. Raw spellings are remembered, forms are shared."""

    def __init__(self) -> None:
        self.raw: dict[str, int] = {}
        self.form: dict[str, int] = {PAD: 0}

    def ids(self, text: str | None) -> np.ndarray:
        words = raw_words(text) if text else []
        known = self.raw
        try:
            return np.array([known[w] for w in words], dtype=np.int32)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.form.setdefault(canonical(w), len(self.form))
            return np.array([known[w] for w in words], dtype=np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        n = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        h, d = STATE, WIDTH
        self.p = {"table": n(ROWS, d, scale=0.5), "w": n(2, d, 3 * h, scale=d**-0.5), "u": n(2, h, 3 * h, scale=h**-0.5), "b": np.zeros((2, 3 * h), np.float32), "att": n(2 * h, scale=0.3), "out": n(2 * h, scale=0.3), "bias": np.array([-1.0], np.float32)}
        self.p["table"][0] = 0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def vectors(self, words: list[str]) -> np.ndarray:
        got = [features(w) for w in words]
        flat = np.concatenate(got)
        ends = np.cumsum([0] + [len(g) for g in got[:-1]])
        return np.add.reduceat(self.p["table"][flat], ends, axis=0) / np.array([len(g) for g in got], np.float32)[:, None]

    def projections(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates, for both directions: [2, words, 3 * STATE]."""
        x = self.vectors(words)
        return np.stack([x @ self.p["w"][k] + self.p["b"][k] for k in (0, 1)])

    def pulls(self, projected: np.ndarray, ids: np.ndarray, inside: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Attention logits and values of the words of many rows [n, length], without ``skip`` words at both ends.

        ``inside`` is false beyond the text; states are zero there.
        """
        h, (n, length) = STATE, ids.shape
        logits, values = (np.zeros((length - 2 * skip, n), np.float32) for _ in range(2))
        whole = inside.all(axis=0)
        for k in (0, 1):
            u, side = self.p["u"][k], projected[k]
            ur, un = np.ascontiguousarray(0.5 * u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
            both = np.stack([self.p["att"][k * h : (k + 1) * h], self.p["out"][k * h : (k + 1) * h]], axis=1)
            state = np.zeros((n, h), np.float32)
            for t in range(length - skip) if k == 0 else range(length - 1, skip - 1, -1):
                x = side[ids[:, t]]
                gate = state @ ur
                x[:, : 2 * h] *= 0.5
                gate += x[:, : 2 * h]
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
                new = state @ un
                new *= gate[:, :h]
                new += x[:, 2 * h :]
                np.tanh(new, out=new)
                state -= new
                state *= gate[:, h:]
                state += new
                if not whole[t]:
                    state *= inside[:, t, None]
                if skip <= t < length - skip:
                    got = state @ both
                    logits[t - skip] += got[:, 0]
                    values[t - skip] += got[:, 1]
        return logits, values

    def score_texts(self, projected: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows of all texts, in order: probability, the text it belongs to, and the word it begins at."""
        size = np.array([len(x) for x in texts])
        tiles = -(-size // TILE)
        owner = np.repeat(np.arange(len(texts)), tiles)
        first = (np.arange(tiles.sum()) - np.repeat(np.cumsum(tiles) - tiles, tiles)) * TILE
        at = first[:, None] - CONTEXT + np.arange(TILE + 2 * CONTEXT)
        inside = (at >= 0) & (at < size[owner, None])
        stream = np.concatenate(texts)
        ids = stream[np.where(inside, (np.cumsum(size) - size)[owner, None] + at, 0)]
        logits, values = (x.T for x in self.pulls(projected, ids, inside, CONTEXT))
        own = inside[:, CONTEXT:-CONTEXT]
        # every text has room for one window at least; empty places weigh nothing
        room = np.maximum(size, WINDOW)
        place = np.arange(size.sum()) + np.repeat(np.cumsum(room) - room - np.cumsum(size) + size, size)
        weight, pulled = np.zeros(room.sum() + WINDOW), np.zeros(room.sum() + WINDOW)
        weight[place] = np.exp(logits[own].astype(np.float64) - logits.max())
        pulled[place] = weight[place] * values[own]
        for k in range(WINDOW.bit_length() - 1):  # sums over 2, 4, ... WINDOW words
            weight[: -(1 << k)] += weight[1 << k :].copy()
            pulled[: -(1 << k)] += pulled[1 << k :].copy()
        count = room - WINDOW + 1
        text = np.repeat(np.arange(len(texts)), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        where = start + (np.cumsum(room) - room)[text]
        return _sigmoid(pulled[where] / weight[where] + self.p["bias"][0]), text, start

    def step(self, words: list[str], ids: np.ndarray, inside: np.ndarray, allowed: np.ndarray, wanted: np.ndarray, rate: float) -> float:
        """One step of Adam on the cross entropy of the worst windows of chunks.

        ``ids`` [n, CHUNK] holds places in ``words``, ``allowed`` [n, STARTS] the windows that exist.
        """
        h, n, length = STATE, len(ids), ids.shape[1]
        got = [features(w) for w in words]
        flat, size = np.concatenate(got), np.array([len(g) for g in got])
        x = np.add.reduceat(self.p["table"][flat], np.cumsum(size) - size, axis=0) / size[:, None].astype(np.float32)
        hs = np.zeros((length, n, 2 * h), np.float32)
        mask = inside.T[:, :, None].astype(np.float32)
        # Both directions at once: at place i the first is at word i, the second at word length - 1 - i.
        sides = [x @ self.p["w"][k] + self.p["b"][k] for k in (0, 1)]
        ur, un = np.ascontiguousarray(self.p["u"][:, :, : 2 * h]), np.ascontiguousarray(self.p["u"][:, :, 2 * h :])
        masks = np.stack([mask, mask[::-1]], axis=1)
        state, kept = np.zeros((2, n, h), np.float32), []
        for i in range(length):
            given = np.stack([sides[0][ids[:, i]], sides[1][ids[:, length - 1 - i]]])
            rz = state @ ur
            rz += given[:, :, : 2 * h]
            rz = _sigmoid(rz)
            hn = state @ un
            new = np.tanh(given[:, :, 2 * h :] + rz[:, :, :h] * hn)
            kept.append((state, rz, hn, new))
            state = (new + rz[:, :, h:] * (state - new)) * masks[i]
            hs[i, :, :h], hs[length - 1 - i, :, h:] = state[0], state[1]
        logit, value = hs @ self.p["att"], hs @ self.p["out"]
        e = np.exp((logit - logit.max(axis=0)).astype(np.float64)) * mask[:, :, 0]
        slide = lambda y: np.lib.stride_tricks.sliding_window_view(y, WINDOW, axis=0)[CONTEXT : CONTEXT + STARTS].sum(axis=2)
        total = slide(e)
        pooled = np.where(allowed.T, slide(e * value) / np.maximum(total, 1e-300), -np.inf)
        worst = pooled.argmax(axis=0)
        each = np.arange(n)
        score = pooled[worst, each]
        prob = _sigmoid(score + self.p["bias"][0]).astype(np.float32)
        loss = float(-np.mean(wanted * np.log(prob + 1e-7) + (1 - wanted) * np.log(1 - prob + 1e-7)))
        t = np.arange(length)[:, None]
        a = (e / total[worst, each] * ((t >= worst + CONTEXT) & (t < worst + CONTEXT + WINDOW))).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((prob - wanted) / n).astype(np.float32)
        dvalue = d * a
        dlogit = dvalue * (value - score.astype(np.float32))
        g["bias"][0] = d.sum()
        g["out"], g["att"] = np.tensordot(dvalue, hs, 2), np.tensordot(dlogit, hs, 2)
        dhs = dvalue[:, :, None] * self.p["out"] + dlogit[:, :, None] * self.p["att"]
        dside = np.zeros((2, length, n, 3 * h), np.float32)
        back = np.zeros((2, n, h), np.float32)
        urt, unt = np.ascontiguousarray(ur.transpose(0, 2, 1)), np.ascontiguousarray(un.transpose(0, 2, 1))
        for i in range(length - 1, -1, -1):
            before, rz, hn, new = kept[i]
            r, z = rz[:, :, :h], rz[:, :, h:]
            dh = (np.stack([dhs[i, :, :h], dhs[length - 1 - i, :, h:]]) + back) * masks[i]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dnew * hn * r * (1 - r)
            drz = np.concatenate([dr, dz], axis=2)
            dhn = dnew * r
            turned = before.transpose(0, 2, 1)
            g["u"][:, :, : 2 * h] += turned @ drz
            g["u"][:, :, 2 * h :] += turned @ dhn
            back = dh * z + drz @ urt + dhn @ unt
            dside[0, i, :, : 2 * h], dside[0, i, :, 2 * h :] = drz[0], dnew[0]
            dside[1, length - 1 - i, :, : 2 * h], dside[1, length - 1 - i, :, 2 * h :] = drz[1], dnew[1]
        dx = np.zeros_like(x)
        for k in (0, 1):
            per_word = _sum_by(ids.T.ravel(), dside[k].reshape(-1, 3 * h), len(words))
            g["w"][k], g["b"][k] = x.T @ per_word, per_word.sum(axis=0)
            dx += per_word @ self.p["w"][k].T
        g["table"] = _sum_by(flat, np.repeat(dx / size[:, None], size, axis=0), ROWS)
        g["table"][0] = 0
        self.t += 1
        norm = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((x * x).sum() for x in g.values())))))
        for k, p in self.p.items():
            self.m[k] += 0.1 * (g[k] * norm - self.m[k])
            self.v[k] += 0.01 * ((g[k] * norm) ** 2 - self.v[k])
            p -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)
        return loss


def _sum_by(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sums of the rows of ``values`` by key."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    out = np.zeros((size, values.shape[1]), np.float32)
    out[keys[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def chunks_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts in chunks: (text, places in the stream of all texts [n, CHUNK], inside, allowed)."""
    size = np.array([len(x) for x in texts])
    count = -(-np.where(size > 0, np.maximum(size - WINDOW + 1, 1), 0) // STARTS)
    text = np.repeat(np.arange(len(texts)), count)
    first = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STARTS
    at = first[:, None] - CONTEXT + np.arange(CHUNK)
    inside = (at >= 0) & (at < size[text, None])
    allowed = first[:, None] + np.arange(STARTS) <= np.maximum(size[text, None] - WINDOW, 0)
    return text, np.where(inside, (np.cumsum(size) - size)[text, None] + at, 0), inside, allowed


def train(texts: list[str | None], abusive: list[bool], seed: int = 5, rounds: int = ROUNDS, steps: int = STEPS) -> Network | None:
    """A network trained on labelled texts; None without both kinds."""
    if not any(abusive) or all(abusive):
        return None
    random = np.random.default_rng(seed)
    book = Words()
    each = [book.ids(t) for t in texts]
    forms = list(book.form)
    bad_doc = np.array(abusive)
    doc, places, inside, allowed = chunks_of(each)
    filled = [x for x in each if len(x)]
    if not filled:
        return None
    stream = np.concatenate(filled)
    # Log odds of a word by the documents it is in; a chunk's first score is the sum of its strongest words.
    seen = np.zeros((2, len(forms)))
    for w, label in zip(each, bad_doc):
        seen[int(label), np.unique(w)] += 1
    odds = np.log((seen[1] + 0.3) / (bad_doc.sum() + 0.6)) - np.log((seen[0] + 0.3) / ((~bad_doc).sum() + 0.6))
    odds[odds < 2 * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))] = 0
    scores = np.concatenate([np.partition(odds[stream[places[k : k + 8192]]] * inside[k : k + 8192], -6, axis=1)[:, -6:].sum(axis=1) for k in range(0, len(places), 8192)])
    net = Network(seed)
    held = random.random(len(each)) < HELD_OUT
    off = np.zeros(len(each), dtype=bool)
    for turn in range(rounds):
        best = np.full(len(each), -np.inf)
        np.maximum.at(best, doc, scores)
        if turn:
            off = np.where(bad_doc, best < 0.5, best > 0.8)
        else:  # an abusive document must stand out from nine of ten clean ones, or else it teaches nothing yet
            off = bad_doc & (best <= np.quantile(best[~bad_doc & np.isfinite(best)], 0.9)) if (~bad_doc & np.isfinite(best)).any() else off
        off = off | held
        bad = np.flatnonzero(bad_doc[doc] & ~off[doc] & ((scores >= best[doc]) if turn < 1 else ((scores >= best[doc]) | (scores > 0.7))))
        good = np.flatnonzero(~bad_doc[doc] & ~off[doc])
        if not len(bad) or not len(good):
            return None
        hard = good[np.argsort(-scores[good], kind="stable")][: max(BATCH, len(good) // 8)]
        for i in range(steps):
            third = BATCH // 3
            at = np.concatenate([random.choice(bad, third), random.choice(hard, third), random.choice(good, BATCH - 2 * third)])
            used, ids = np.unique(stream[places[at]], return_inverse=True)
            last = turn == rounds - 1
            rate = 0.01 if not last else 0.01 * 0.5 * (1 + np.cos(np.pi * i / steps)) + 1e-4
            net.step([forms[j] for j in used], ids.reshape(BATCH, CHUNK), inside[at], allowed[at], bad_doc[doc[at]].astype(np.float32), rate)
        probability, text, start = net.score_texts(net.projections(forms), filled)
        text = np.flatnonzero([len(x) > 0 for x in each])[text]
        scores = np.maximum.reduceat(probability, np.flatnonzero(np.diff(text, prepend=-1) | (start % STARTS == 0)))
    best = np.zeros(len(each))
    np.maximum.at(best, doc, scores)
    net.p["bias"] -= np.float32(best_threshold(best[held], bad_doc[held]))
    return net


def best_threshold(scores: np.ndarray, wanted: np.ndarray) -> float:
    """The logit above which right ones outnumber wrong ones most, the middle of the scores it may lie between; 0 without both labels."""
    if not wanted.any() or wanted.all():
        return 0.0
    scores = np.clip(scores, 1e-6, 1 - 1e-6)
    logit = np.log(scores / (1 - scores))
    order = np.argsort(-logit, kind="stable")
    gain = np.cumsum(np.where(wanted[order], 1, -1))
    k = int(gain.argmax())
    after = logit[order[k + 1]] if k + 1 < len(order) else logit[order[k]] - 2
    return float((logit[order[k]] + after) / 2)


def labelled_sample(documents: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, text, abusive) of at most ``bound`` documents and ``chars`` characters whose labels agree, picked by a hash of the id."""
    said = F.lower(F.trim("label"))
    agreed = labels.where(said.isin("abusive", "clean") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(said == "abusive").alias("all"), F.max(said == "abusive").alias("any")).where("all = any")
    order = (F.xxhash64("doc_id", F.lit(3)), F.col("doc_id"))
    chosen = agreed.orderBy(*order).limit(bound).select("doc_id", F.col("all").alias("abusive"))
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("abusive").alias("abusive"))
    upto = F.sum(F.char_length(F.coalesce("text", F.lit("")))).over(Window.orderBy(*order))  # of at most ``bound`` rows
    return rows.withColumn("upto", upto).where(F.col("upto") <= chars).drop("upto")


_fitted: dict[str, Network | None] = {}


def fit(documents: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Network | None:
    """The network for these labels; the last one is kept and used again for the very same sample."""
    rows = sorted(labelled_sample(documents, labels, bound).collect(), key=lambda r: r.doc_id)
    digest = hashlib.sha256()
    for r in rows:
        digest.update(repr((r.text, r.abusive)).encode(errors="surrogatepass"))
    name = digest.hexdigest()
    if name not in _fitted:
        _fitted.clear()
        _fitted[name] = train([r.text for r in rows], [r.abusive for r in rows])
    return _fitted[name]


def score_documents(documents: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, source, score) of every document; ``score`` is that of its worst window."""
    held = documents.sparkSession.sparkContext.broadcast({k: v for k, v in net.p.items()} if net else None)

    @F.pandas_udf("double")
    def worst(batches: pd.Series) -> pd.Series:
        return _score_batch(batches, held.value)

    return documents.select("doc_id", source_name().alias("source"), worst("text").alias("score"))


_state: dict = {}


def _score_batch(texts: pd.Series, weights: dict | None) -> pd.Series:
    if weights is None:
        return pd.Series(np.zeros(len(texts)))
    if _state.get("weights") is not weights or len(_state["book"].raw) > 500_000:
        net = Network()
        net.p = weights
        _state.update(weights=weights, net=net, book=Words(), projected=np.zeros((2, 0, 3 * STATE), np.float32))
    net, book = _state["net"], _state["book"]
    out = np.zeros(len(texts))
    rows, owners, held = [], [], 0

    def flush() -> None:
        nonlocal rows, owners, held
        if not rows:
            return
        have = _state["projected"].shape[1]
        if have < len(book.form):
            _state["projected"] = np.concatenate([_state["projected"], net.projections(list(book.form)[have:]).astype(np.float32)], axis=1)
        probability, text, _ = net.score_texts(_state["projected"], rows)
        out[owners] = np.maximum.reduceat(probability, np.flatnonzero(np.diff(text, prepend=-1)))
        rows, owners, held = [], [], 0

    for i, text in enumerate(texts):
        ids = book.ids(text)
        if not len(ids):  # no words, nothing to score: 0
            continue
        rows.append(ids)
        owners.append(i)
        held += len(ids)
        if held >= 65536:
            flush()
    flush()
    return pd.Series(out)


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= threshold).alias("abusive"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"))
