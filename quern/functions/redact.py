"""Masking of secrets and of instructions hidden in text.

``RULES`` are the public shapes of credentials, in the order they are applied; all of them run in Java and in RE2, so a
SQL twin can state them. Replacements hold no shape themselves, so a second pass changes nothing but nested addresses.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (kind, pattern, groups kept before the marker). Public formats of tokens and keys.
RULES = (
    ("private-key", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", 0),
    ("aws-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0),
    ("github-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,})", 0),
    ("gitlab-token", r"\bglpat-[A-Za-z0-9_-]{16,}", 0),
    ("slack-token", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", 0),
    ("stripe-key", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0),
    ("google-key", r"\bAIza[0-9A-Za-z_-]{30,}", 0),
    ("npm-token", r"\bnpm_[A-Za-z0-9]{30,}", 0),
    ("pypi-token", r"\bpypi-[A-Za-z0-9_-]{40,}", 0),
    ("model-key", r"\bsk-[A-Za-z0-9_-]{20,}", 0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]*", 0),
    ("authorization", r"(?i)(\bauthorization[\"']?\s*[:=]\s*[\"']?(?:bearer|basic|token)\s+)[^\s\"',;]+", 1),
    ("url-password", r"([a-zA-Z][a-zA-Z0-9+.-]*://[^:@/?#\s]*:)[^@/\s\[]+@", 1),
    ("cookie", r"(?i)(\b(?:set-)?cookie:\s*)[^\r\n\[]+", 1),
    ("quoted-value", r"(?i)(\b[a-z0-9_.-]*(?:api[_-]?key|secret|token|passwd|password|passphrase|credential)[a-z0-9_-]*[\"']?\s*[:=]\s*)\"[^\"\n\[]{4,}\"", 1),
    ("value", r"(?i)(\b[a-z0-9_.-]*(?:api[_-]?key|secret|token|passwd|password|passphrase|credential)[a-z0-9_-]*[\"']?\s*[:=]\s*)[^\s,;\"'\[<{(][^\s,;\"']{5,}", 1),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0),
)
PASSES = 2
MARKER = "[redacted:{}]"


def _to(kind: str, kept: int, reference: str) -> str:
    at = "@" if kind == "url-password" else ""
    return (reference.format(1) if kept else "") + MARKER.format(kind) + at


def redact(text: Column) -> Column:
    """``text`` with credentials masked; null stays null."""
    for _ in range(PASSES):
        for kind, pattern, kept in RULES:
            text = F.regexp_replace(text, pattern, _to(kind, kept, "${}"))
    return text


def redact_sql(text: str) -> str:
    for _ in range(PASSES):
        for kind, pattern, kept in RULES:
            text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), _to(kind, kept, "\\{}"))
    return text


def holds_secret(text: Column) -> Column:
    """Whether a rule other than the address of mail matches."""
    out = F.lit(False)
    for kind, pattern, _ in RULES:
        if kind != "email":
            out = out | text.rlike(pattern)
    return F.coalesce(out, F.lit(False))


SECRET_MANIFEST = r"(?m)^kind:[ \t]*Secret[ \t]*\r?$"
MANIFEST_VALUE = r"(?m)^([ \t]+[A-Za-z0-9_.-]+:[ \t]*)[A-Za-z0-9+/]{8,}={0,2}[ \t]*\r?$"


def mask_manifest(text: Column) -> Column:
    """The encoded values of a cluster manifest whose kind is Secret; other manifests stay."""
    return F.when(text.rlike(SECRET_MANIFEST), F.regexp_replace(text, MANIFEST_VALUE, "$1[redacted:manifest]")).otherwise(text)


def agreed_start(short: Column, wide: Column) -> Column:
    """The longest common beginning of two masked forms that does not end inside a marker."""
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(short), F.length(wide)))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr(short, i, F.lit(1)) == F.substr(wide, i, F.lit(1))), i).otherwise(n))
    start = F.substring(short, 1, same) if isinstance(same, int) else F.substr(short, F.lit(1), same)
    return F.regexp_replace(start, r"\[[^\]]*$", "")


HIDDEN_CATEGORIES = ("Cc", "Cf")


def fold(text: str) -> str:
    """Compatibility form without control and invisible characters (line breaks and tabs stay)."""
    text = unicodedata.normalize("NFKC", text)
    return "".join(c for c in text if c in "\n\t" or unicodedata.category(c) not in HIDDEN_CATEGORIES)


#: Orders to a reader that change the rules it works by, in the folded text.
ORDERS = re.compile(
    r"\b(?:ignore|disregard|forget|override)\s+(?:all\s+|any\s+|the\s+|your\s+)*(?:previous|prior|above|earlier|system)\s+(?:instructions?|prompts?|rules?|messages?|context)"
    r"|\byou\s+are\s+now\s+(?:a|an|the|in)\b|\bnew\s+(?:system\s+)?instructions?\s*:|</?\s*(?:system|assistant|instructions?)\s*>|\breveal\s+(?:the\s+|your\s+)*(?:system\s+)?prompt\b|\bdo\s+not\s+tell\s+the\s+user\b",
    re.I,
)


def _mask_orders(texts: pd.Series) -> pd.DataFrame:
    """The folded text with such orders masked, and their number; a text without any stays as it is."""
    out, hits = [], []
    for text in texts:
        masked, n = ORDERS.subn("[masked:order]", fold(text)) if text else (text, 0)
        out.append(masked if n else text)
        hits.append(n)
    return pd.DataFrame({"text": out, "hits": hits})


def mask_orders(text: Column) -> Column:
    return F.pandas_udf(_mask_orders, "struct<text:string,hits:int>").asNondeterministic()(text)


def _inert(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t).replace("<", "‹").replace(">", "›"))


def inert(text: Column) -> Column:
    """Folded text in which angle brackets can't be markup."""
    return F.pandas_udf(_inert, "string")(text)


SCRUB = ((r"/(?:home|Users)/[A-Za-z0-9._-]+", "~"), (r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b", "<ip>"), (r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}\b)?", "<ip>"))


def scrub(text: Column) -> Column:
    """Home folders and network addresses out of text that leaves the house."""
    for pattern, to in SCRUB:
        text = F.regexp_replace(text, pattern, to)
    return text
