"""Problem 5: personal information in free text, by bootstrapped contextual extraction.

Seed entities (listed name parts, plain addresses of mail, numbers with a country code or behind the name
of a document, plain street words) induce lexical patterns: the words before them, the partner of a name,
the domain behind an at-sign, the town behind a street. Patterns and the instances they hold make a graph,
summed over the whole corpus by Spark, whose scores are iterated: a pattern is worth the mean score of its
instances, an unseen instance the mean worth of its patterns. Instances at or above ``ACCEPT`` (unlisted
name parts, shapes of numbers, ways to spell an at-sign, street words and endings, words for a box) join
the lexicon that the final scan matches with. A number right behind the name of a document is itself a seed.

Equal texts are scanned once. A lexicon of at most ``BROADCAST_ENTRIES`` goes to every task; beyond that
the entries a text can use are joined to it, with the same result. Regular expressions run only over lines that
hold what they cannot match without (a digit, an at-sign, a title, a word of the lexicon).

Defined results: null or empty text has no findings and stays as it is; a record and kind is reported
once; placeholders such as ``[email]`` or ``<phone>`` are no findings; repeated rows of one id fall
together; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Set

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage, once, stored

ROUNDS = 3
#: Least score of an unseen instance, by label. Names need more, as any capitalised words are candidates.
ACCEPT = {"given": 0.4, "family": 0.4, "street_after": 0.4, "street_lead": 0.4, "street_trail": 0.4, "joined": 0.2, "box": 0.2, "email": 0.3, "phone": 0.15, "id_number": 0.15}
#: A larger lexicon is joined to the texts instead of being sent to every task.
BROADCAST_ENTRIES = 100_000
KINDS = ("email", "phone", "id_number", "address", "name")

TITLES = r"(?:mr|mrs|ms|miss|mx|dr|prof|herrn?|frau|se[ñn]ora?|sra?|mme|mlle|monsieur|madame|sir)"
TITLE_WORDS = frozenset("mr mrs ms miss mx dr prof herr herrn frau senora señora senor señor sr sra mme mlle monsieur madame sir".split())
_apart = r"[ \t ]"
_name_rest = r"(?:[^\W\d_]|['’](?=[^\W\d_])|-(?=[^\W\d_]))++"
_name_word = rf"[^\W\d_]{_name_rest}"
_bound = r"(?<![\w@.’'-].)"  # behind the first letter, whose class the search can skip to
_after_name = rf"(?:(,){_apart}?|{_apart})((?:[^\W\d_]\.?{_apart})?)"
_pair = re.compile(rf"([^\W\d_]{_bound}{_name_rest}){_after_name}({_name_word})(?!['’-]?[\w@])", re.S)
_cap_pair = re.compile(rf"([^\W\d_a-z]{_bound}{_name_rest}){_after_name}([^\W\d_a-z]{_name_rest})(?!['’-]?[\w@])", re.S)
_title = re.compile(rf"{TITLES}\.?", re.I)
_title_sign = re.compile(r"\b(?:m(?:rs?|s|iss|x|me|lle|onsieur|adame)|dr|prof|herrn?|frau|se[ñn]ora?|sra?|sir)\b")
_titled = re.compile(rf"(?<![\w@.-])({TITLES})\.?{_apart}+({_name_word})", re.I)
_letters = re.compile(r"[^\W\d_]+")
_at = r"(?:[ \t]?@[ \t]?|[ \t]*[\[({][ \t]*(?:at|ät|arroba|chez)[ \t]*[\])}][ \t]*|[ \t]+(?:at|AT|arroba)[ \t]+(?=[\w-]+[ \t]+(?:dot|DOT|punto|punkt|point)[ \t])|＠|&#64;|%40)"
_dot = r"(?:\.|[ \t]*[\[({][ \t]*(?:dot|punto|punkt|point)[ \t]*[\])}][ \t]*|[ \t]+(?:dot|DOT|punto|punkt|point)[ \t]+)"
_mail = re.compile(rf"(?<![\w.+/-])(?:mailto:)?([a-z0-9][\w.+-]*)({_at})([a-z0-9](?:[\w-]*[a-z0-9])?(?:{_dot}[a-z0-9](?:[\w-]*[a-z0-9])?)*{_dot}[a-z]{{2,12}})(?![\w@])(:[\w~/]\S*/?\S*|/\S)?", re.I)
_at_signs = ("@", "＠", "&#64;", "%40")
_at_bracket = re.compile(r"[\[({][ \t]*(?:at|ät|arroba|chez)[ \t]*[\])}]", re.I)
_dot_words = ("dot", "punto", "punkt", "point")
_number = re.compile(r"(?<![\w@/.:+#=-])[#(+]{0,2}(?:[A-Z]{1,2}(?=\d))?[+(]?\d(?:\d|[ .\-/()]{1,2}(?=[\d(]))*(?:-?[A-Z]\b)?(?:[ ]?(?:ext|x|App|poste)\.?[ ]?\d{1,5})?(?![\w@:]|\.\d)")
_spaces = re.compile(r"\s+")
_last_words = re.compile(r"([^\W\d_][\w.'’/-]*|[^\w\s])[\s:#\"'=(<\[]*$")
_id_cue = re.compile(r"(?:ssn|social[ -]security(?:[ -](?:number|no\.?))?|passport(?:[ -](?:number|no\.?))?|reisepass(?:-?nr\.?)?|passeport|pasaporte|dni|nie|nif|national[ -]id|id[ -]card|ausweis(?:-?nr\.?)?|steuer-?id|tax[ -]?id|tin|driver'?s?[ -]licen[cs]e|f[üu]hrerschein|permis(?: de conduire)?|health[ -]insurance(?:[ -](?:number|no\.?))?|krankenversicherung\w*|num[ée]ro de s[ée]curit[ée] sociale)[\s:#=\"'.]*$", re.I)
_box = re.compile(r"(?<!\w)(p\.?[ \t]?o\.?[ \t]?box|postfach|apartado(?: de correos)?|bo[iî]te postale)[ \t#:]*(?:n[or°º]\.?[ \t]*)?\d+((?:,[ \t]*[^\W\d_][\w-]+)?)", re.I)
_box_words = ("box", "postfach", "apartado", "postale")
_word_cap = r"[^\W\d_][\w'’-]*"
_house = r"\d{1,5}[ \t]?[A-Za-z]?"
_street_after = re.compile(rf"(?<![\w.:/-])({_house})[,]?[ \t]+((?:{_word_cap}[ \t]+){{1,3}}?)({_word_cap}\.?)(?![\w-])((?:,[ \t]*(?:apt|suite|unit|flat|no)\.?[ \t]*#?\w+|,[ \t]*(?:\d{{4,5}}[ \t]+)?{_word_cap}){{0,2}})", re.I)
_street_lead = re.compile(rf"(?<![\w.:/-])({_house})[,]?[ \t]+({_word_cap})[ \t]+((?:(?:de|du|des|la|le|les|l['’]|del|los|las|el)[ \t]*)*(?:{_word_cap})(?:[ \t]+{_word_cap})?)((?:,[ \t]*\d{{4,5}}[ \t]+{_word_cap})?)")
_street_trail = re.compile(rf"(?<![\w.-])({_word_cap})[ \t]+((?:(?:de|del|la|los|las|el)[ \t]+)*{_word_cap}(?:[ \t]+{_word_cap}){{0,2}}),?[ \t]+(?:n[º°o]\.?[ \t]*)?(\d{{1,5}}[A-Za-z]?)(?![\w-])((?:,[ \t]*{_word_cap})?)")
_joined_ends = "straße strasse str. gasse allee weg platz ufer ring damm hof berg markt chaussee".split()
_street_joined = re.compile(rf"(?<![\w.-])([^\W\d_][\w'’-]*?)({'|'.join(map(re.escape, _joined_ends))})[ \t]+(\d{{1,5}}[ \t]?[A-Za-z]?)(?![\w-])((?:,[ \t]*\d{{4,5}}[ \t]+{_word_cap})?)", re.I)
#: A house number with what stands before it: up to seven words.
_door = re.compile(r"(?<=[ \t.º°oO])\d{1,5}(?!\d)")
_town_tail = re.compile(r"[A-Za-z]?,[ \t]*[^\W\d_]")

#: Seed words for streets; more are found by the company they keep.
STREETS_AFTER = frozenset("street st st. road rd rd. avenue ave ave. lane ln ln. drive court close boulevard blvd blvd. way place square terrace crescent".split())
STREETS_LEAD = frozenset("rue avenue boulevard place chemin allée quai impasse route cours".split())
STREETS_TRAIL = frozenset("calle avenida plaza paseo carrera camino via viale piazza ronda".split())
#: Endings that only streets have, and plain words for a box; the other endings must earn their score.
STREETS_JOINED = frozenset(("straße", "strasse", "str.", "gasse", "allee", "platz"))
BOXES = frozenset(("pobox", "postfach", "apartado"))


def _left(text: str, at: int) -> str:
    """The last one or two words before a position, on its line."""
    before = text[max(0, at - 60) : at]
    words = []
    for _ in range(2):
        m = _last_words.search(before)
        if not m:
            break
        words.append(m[1].lower())
        before = before[: m.start()]
    return " ".join(reversed(words)) or "^"


def _shape(number: str) -> str:
    if number.count("(") > number.count(")"):
        number = number.replace("(", "", 1)
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "d", re.sub(r"[ ]?(?:ext|x|App|poste)\.?[ ]?\d{1,5}$", "", number.lstrip("#"))))


def _style(mail: re.Match) -> str:
    at = _spaces.sub(" ", mail[2].lower())
    dot = "[dot]" if re.search(r"dot|pun[kt]|point", mail[3], re.I) and not re.fullmatch(r"[\w.-]+", mail[3]) else "."
    return f"{at}|{dot}|{':' if mail[4] else ''}"


def _domain(mail: re.Match) -> str:
    return re.sub(_dot, ".", mail[3].lower())


def _each(regex: re.Pattern, text: str, accept, at: int, ends: int) -> Iterator[re.Match]:
    """Matches that ``accept`` takes; after a refused one the search goes on at the next word."""
    while m := regex.search(text, at, ends):
        if accept(m):
            yield m
            at = m.end()
        else:
            at = m.start() + len(m[0].split(None, 1)[0])


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in spans:
        text = text[:a] + "\x00" * (b - a) + text[b:]
    return text


def _mails(text: str) -> list[re.Match]:
    low = text.lower()
    if any(x in low for x in _at_signs) or any(x in low for x in _dot_words) or _at_bracket.search(text):
        return list(_mail.finditer(text))
    return []


def _boxes(text: str) -> list[re.Match]:
    low = text.lower()
    return list(_box.finditer(text)) if any(x in low for x in _box_words) else []


def _box_name(m: re.Match) -> str:
    return "".join(_letters.findall(m[1].lower()))


def _streets(text: str, known: dict[str, Set[str]], capital: Callable[[str, re.Match], bool]) -> Iterator[tuple[str, re.Match, str, str]]:
    """(label, match, word, town part) of streets whose word is ``known`` or that ``capital`` takes by their looks."""
    for regex, label, word in ((_street_after, "street_after", 3), (_street_lead, "street_lead", 2)):
        words = known[label]
        for m in _each(regex, text, lambda m: m[word].lower() in words or capital(label, m), 0, len(text)):
            yield label, m, m[word].lower(), m[4]
    trail = known["street_trail"]
    seen = [-1, -1]  # ends of the lines that were searched already
    for d in _door.finditer(text):
        at = d.start()
        before = text[max(0, at - 120) : at].rpartition("\n")[2].lower().split()[-8:]
        joined = bool(before) and before[-1].endswith(_ends) and at > seen[0]
        seek = at > seen[1] and (not trail.isdisjoint(before) or bool(_town_tail.match(text, d.end())))
        if not (joined or seek):
            continue
        begins, ends = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        ends = len(text) if ends < 0 else ends
        if seek:
            seen[1] = ends
            for m in _each(_street_trail, text, lambda m: m[1].lower() in trail or capital("street_trail", m), begins, ends):
                yield "street_trail", m, m[1].lower(), m[4]
        if joined:
            seen[0] = ends
            for m in _street_joined.finditer(text, begins, ends):
                if m[1][0].isupper() or m[0].isupper() or m[4]:
                    yield "joined", m, m[2].lower(), m[4]


_ends = tuple(_joined_ends)
_ends_bare = tuple(end.rstrip(".") for end in _joined_ends)
_SEED_STREETS = {"street_after": STREETS_AFTER, "street_lead": STREETS_LEAD, "street_trail": STREETS_TRAIL}
_KIND_GROUP = {"street_after": 3, "street_lead": 2, "street_trail": 1}


def _numbers(text: str) -> Iterator[tuple[re.Match, str, bool]]:
    """(match, shape, whether the name of a document stands right before it) of numbers of six digits or more."""
    for m in _number.finditer(text):
        if m.end() - m.start() >= 6 and sum(map(str.isdigit, m[0])) >= 6:
            yield m, _shape(m[0]), bool(_id_cue.search(text[max(0, m.start() - 60) : m.start()]))


def observe(text: str, counts: Counter) -> None:
    """Add a text's (label, pattern, instance, seed) to ``counts``; names are matched with the seed names later."""
    hidden = []
    for m in _mails(text):
        style = _style(m)
        counts["email", "domain:" + _domain(m), style, style == "@|.|"] += 1
        hidden.append(m.span())
    text = _blank(text, hidden)
    for m, shape, cue in _numbers(text):
        digits = sum(c.isdigit() for c in m[0])
        left = _left(text, m.start())
        counts["id_number", "left:" + left, shape, False] += 1
        if cue:
            counts["id_number", "cue", shape, False] += 1
        counts["phone", "left:" + left, shape, m[0].startswith(("+", "00")) and 10 <= digits <= 15 and not cue] += 1
    at = 0
    while m := _cap_pair.search(text, at):
        a, b = m[1], m[4]
        at = m.end(1)
        if not (a[0].isupper() and b[0].isupper()) or _title.fullmatch(a):
            continue
        at = m.end()
        g, f = (b.lower(), a.lower()) if m[2] else (a.lower(), b.lower())
        left = _left(text, m.start())
        for pattern in (f"family:{f}", f"left:{left}"):
            counts["given", pattern, g, False] += 1
        for pattern in (f"given:{g}", f"left:{left}"):
            counts["family", pattern, f, False] += 1
    if _title_sign.search(text.lower()):
        for m in _titled.finditer(text):
            if m[2][0].isupper():
                counts["family", f"title:{m[1].lower()}", m[2].lower(), False] += 1
    for m in _boxes(text):
        w = _box_name(m)
        counts["box", "town:" + m[2].rsplit(" ", 1)[-1].lower(), w, w in BOXES] += 1
        counts["box", "left:" + _left(text, m.start()), w, w in BOXES] += 1
    for label, m, w, tail in _streets(text, _SEED_STREETS, lambda label, m: bool(m[4]) and m[_KIND_GROUP[label]][0].isupper()):
        seed = w in (STREETS_JOINED if label == "joined" else _SEED_STREETS[label])
        town = tail.rsplit(" ", 1)[-1].lower() if tail else ""
        counts[label, "town:" + town, w, seed] += 1
        counts[label, "left:" + _left(text, m.start()), w, seed] += 1


def pattern_graph(texts: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(label, pattern, instance, seed, n) summed over all texts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        columns = ["label", "pattern", "instance", "seed"]
        for batch in batches:
            for text in batch["text"]:
                observe(text, counts)
            if len(counts) > 200_000:
                yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=[*columns, "n"])
                counts.clear()
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=[*columns, "n"])

    rows = texts.select("text").mapInPandas(scan, "label string, pattern string, instance string, seed boolean, n long")
    graph = rows.groupBy("label", "pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))
    listed = name_seeds(name_parts).withColumn("listed", F.lit(True))
    return graph.join(listed, ["label", "instance"], "left").select("label", "pattern", "instance", F.coalesce("listed", "seed").alias("seed"), "n")


def name_seeds(name_parts: DataFrame) -> DataFrame:
    """(label, instance): seed given and family names in lower case."""
    return name_parts.select(F.lower(F.trim("part_kind")).alias("label"), F.lower(F.trim("part_text")).alias("instance")).where("label in ('given', 'family') and instance <> ''").distinct()


def bootstrap(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(label, instance, score): seeds have 1, others the mean worth of their patterns after ``rounds``."""
    seeds = graph.groupBy("label", "instance").agg(F.max("seed").alias("seed"))
    sure = (F.col("label") == "id_number") & (F.col("pattern") == "cue")
    scores = seeds.select("label", "instance", F.col("seed").cast("double").alias("score"), "seed")
    for _ in range(rounds):
        worth = graph.join(scores.drop("seed"), ["label", "instance"]).groupBy("label", "pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 1)).alias("worth"))
        worth = worth.withColumn("worth", F.when(sure, 1.0).when(F.col("pattern").isin("left:^", "town:"), F.least("worth", F.lit(0.2))).otherwise(F.col("worth")))
        # the partner of a name or the domain of an address says more than the words before it
        weight = F.col("n") * F.when(F.col("pattern").startswith("left:"), 1.0).when(sure, 10.0).otherwise(3.0)
        found = graph.join(worth, ["label", "pattern"]).groupBy("label", "instance").agg((F.sum(weight * F.col("worth")) / F.sum(weight)).alias("score"))
        scores = cut_lineage(seeds.join(found, ["label", "instance"]).select("label", "instance", F.when(F.col("seed"), 1.0).otherwise(F.col("score")).alias("score"), "seed"))
    return scores.select("label", "instance", "score")


def accepted(scores: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(label, instance, score): the lexicon, with every seed name."""
    least = F.create_map(*[F.lit(x) for pair in ACCEPT.items() for x in pair])
    good = scores.where(F.col("score") >= least[F.col("label")])
    seeds = name_seeds(name_parts).withColumn("score", F.lit(1.0))
    return good.unionByName(seeds).groupBy("label", "instance").agg(F.max("score").alias("score"))


class Lexicon:
    """Accepted instances by label, as the scan of a text needs them."""

    def __init__(self, rows: Iterable[tuple[str, str, float]]):
        self.of: dict[str, dict[str, float]] = {label: {} for label in ACCEPT}
        for label, instance, score in rows:
            self.of[label][instance] = score
        first = lambda label: frozenset(m[0] for m in map(_letters.search, self.of[label]) if m)
        self.given_first, self.family_first = first("given"), first("family")
        self.street_first = first("street_after") | first("street_lead") | first("street_trail")
        self.street_words = {label: self.of[label].keys() for label in ("street_after", "street_lead", "street_trail")}


def find(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of personal information, in order and not overlapping."""
    lex = lexicon.of
    out: list[tuple[int, int, str]] = []
    hidden = []
    for m in _mails(text):
        if _style(m) in lex["email"]:
            out.append((m.start(), m.start(4) if m[4] else m.end(), "email"))
        hidden.append(m.span())
    text = _blank(text, hidden)
    low = text.lower()
    words = set(_letters.findall(low))
    places = [m.span() for m in _boxes(text) if _box_name(m) in lex["box"]]
    streets = not words.isdisjoint(lexicon.street_first) or any(w.endswith(_ends_bare) for w in words)
    for label, m, w, tail in _streets(text, lexicon.street_words, lambda label, m: False) if streets else ():
        if w in lex[label] and (label == "joined" or tail or m[3 if label == "street_lead" else 2].strip()[:1].isupper()):
            places.append(m.span())
    out += [(a, b, "address") for a, b in places]
    text = _blank(text, places)
    phones, ids = lex["phone"], lex["id_number"]
    numbers = []
    for m, shape, cue in _numbers(text):
        p, i = phones.get(shape, 0.0), ids.get(shape, 0.0)
        if cue or i > p:
            numbers.append((*m.span(), "id_number"))
        elif p > 0:
            numbers.append((*m.span(), "phone"))
    out += numbers
    text = _blank(text, [x[:2] for x in numbers])
    given, family = lex["given"], lex["family"]
    if not words.isdisjoint(lexicon.family_first):
        if not words.isdisjoint(lexicon.given_first):
            at = 0
            while m := _pair.search(text, at):
                a, b = m[1].lower(), m[4].lower()
                if (a in family and b in given) if m[2] else (a in given and b in family) or (a in family and b in given):
                    out.append((*m.span(), "name"))
                    at = m.end()
                else:
                    at = m.end(1)
        if not words.isdisjoint(TITLE_WORDS):
            for m in _titled.finditer(text):
                if m[2].lower() in family:
                    out.append((*m.span(), "name"))
    done: list[tuple[int, int, str]] = []
    for span in sorted(out, key=lambda x: (x[0], -x[1])):
        if not done or span[0] >= done[-1][1]:
            done.append(span)
    return done


def mentions(text: str) -> set[tuple[str, str]]:
    """Every (label, instance) that a lexicon could hold and that could matter to ``find`` in this text."""
    out = {("email", _style(m)) for m in _mails(text)}
    out |= {("box", _box_name(m)) for m in _boxes(text)}
    for _, shape, _ in _numbers(text):
        out |= {("phone", shape), ("id_number", shape)}
    for word in re.findall(_word_cap + r"\.?", text.lower()):
        out |= {(label, w) for label in ("street_after", "street_lead", "street_trail") for w in (word, word.rstrip("."))}
    out |= {("joined", end) for end in _joined_ends}
    for word in re.findall(_name_word, text.lower()):
        out |= {("given", word), ("family", word)}
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*parts, text[at:]])


_holder = re.compile(r"\[(?:email|phone|id_number|address|name)\]|<(?:email|phone|address|name|id)>|\*{3}REDACTED\*{3}", re.I)
SPANS = "array<struct<at:int,to:int,kind:string>>"


def _spans(text: str, lexicon: Lexicon) -> list[dict]:
    return [{"at": a, "to": b, "kind": kind} for a, b, kind in find(text, lexicon)]


def spans_of(texts: DataFrame, lexicon: DataFrame, entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """``texts`` (h1, h2, text) that hold any personal information, with their ``spans``."""
    head = lexicon.limit(entries + 1).collect()
    if len(head) <= entries:
        held = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in head])

        @F.pandas_udf(SPANS)
        def mark(batch: pd.Series) -> pd.Series:
            if _state.get("rows") is not held.value:
                _state.update(rows=held.value, lexicon=Lexicon(held.value))
            return pd.Series([_spans(t, _state["lexicon"]) for t in batch])

        return texts.withColumn("spans", once(mark)("text")).where(F.size("spans") > 0)

    @F.pandas_udf("array<struct<label:string,instance:string>>")
    def mentioned(batch: pd.Series) -> pd.Series:
        return pd.Series([[{"label": a, "instance": b} for a, b in mentions(t)] for t in batch])

    @F.pandas_udf(SPANS)
    def mark_each(batch: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([_spans(t, Lexicon((r["label"], r["instance"], r["score"]) for r in rows)) for t, rows in zip(batch, own)])

    each = texts.select("h1", "h2", F.explode(once(mentioned)("text")).alias("m")).select("h1", "h2", "m.*")
    own = each.join(lexicon, ["label", "instance"]).groupBy("h1", "h2").agg(F.collect_list(F.struct("label", "instance", "score")).alias("own"))
    cue = F.array().cast("array<struct<label:string,instance:string,score:double>>")
    return texts.join(own, ["h1", "h2"], "left").withColumn("spans", once(mark_each)("text", F.coalesce("own", cue))).drop("own").where(F.size("spans") > 0)


_state: dict = {}


def _hashes(df: DataFrame) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(5), "text")})


def scan(records: DataFrame, name_parts: DataFrame, entries: int = BROADCAST_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(``records`` with h1 and h2, and (h1, h2, spans) of the texts that hold personal information)."""
    texts = stored(_hashes(records.select("text").where("text <> ''").distinct()))
    graph = cut_lineage(pattern_graph(texts, name_parts))
    return _hashes(records), spans_of(texts, cut_lineage(accepted(bootstrap(graph), name_parts)), entries).select("h1", "h2", "spans")


def redacted(records: DataFrame, name_parts: DataFrame, entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(src, row_id, text, claim, kinds, clean, redacted): ``clean`` has placeholders; one row a distinct record."""
    rows, spans = scan(records, name_parts, entries)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([redact(t, [(x["at"], x["to"], x["kind"]) for x in s]) for t, s in zip(texts, spans)])

    both = rows.distinct().join(spans, ["h1", "h2"], "left")
    hit = both.where("spans is not null").withColumn("clean", clean("text", "spans"))
    rest = both.where("spans is null").withColumn("clean", F.col("text"))
    held = F.coalesce(F.col("text").rlike("(?i)" + _holder.pattern), F.lit(False))
    kinds = F.coalesce(F.array_sort(F.array_distinct("spans.kind")), F.array().cast("array<string>"))
    return hit.unionByName(rest).select("src", "row_id", "text", "claim", kinds.alias("kinds"), "clean", (F.col("spans").isNotNull() | held).alias("redacted"))


def records_of(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    a = entries.select(F.lit("entries").alias("src"), F.col("entry_id").cast("long").alias("row_id"), "text", F.col("redacted").alias("claim"))
    b = chunks.select(F.lit("memory_chunks").alias("src"), F.col("chunk_id").cast("long").alias("row_id"), F.col("search_text").alias("text"), F.lit(None).cast("boolean").alias("claim"))
    return a.unionByName(b)


def found(entries: DataFrame, chunks: DataFrame, name_parts: DataFrame) -> DataFrame:
    rows, spans = scan(records_of(entries, chunks), name_parts)
    kinds = spans.select("h1", "h2", F.array_distinct("spans.kind").alias("kinds"))
    return rows.select("src", "row_id", "h1", "h2").distinct().join(kinds, ["h1", "h2"]).select("src", "row_id", F.explode("kinds").alias("kind")).distinct()
