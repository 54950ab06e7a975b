"""Search terms and snippets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webloom.config import DEFAULTS

# Words that are no search terms.
STOPWORDS = frozenset(
    "a an and are as at be but by for from has have he her hers him his i if in into is it its me my not of on or our ours she so that the their theirs them then there these they this those to too us was we were what when where which who will with you your yours".split()
)

# Spellings of technical names kept as one term, in the order they are rewritten.
_NAMES = (("c++", "cpp"), ("c#", "csharp"), ("f#", "fsharp"), ("asp.net", "aspnet"), (".net", "dotnet"), ("node.js", "nodejs"), ("next.js", "nextjs"), ("vue.js", "vuejs"))
_SPACED = (("http", "/", "2"), ("sha", "-", "256"))
#: (pattern, term): names stand by themselves; parts of the spaced ones may stand apart.
SPELLINGS = (
    *((rf"(?<![0-9a-z]){re.escape(spelling)}(?![0-9a-z])", name) for spelling, name in _NAMES),
    *((rf"\b{a}\s*{sign}\s*{b}\b", a + b) for a, sign, b in _SPACED),
)
#: Texts without this have none of the spellings.
_ANY_SPELLING = r"c\+\+|[cf]#|\.net|\.js|http\s*/\s*2|sha\s*-\s*256"


def fold_text(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def terms_of(text: str | None, stopwords: Iterable[str] = (), min_len: int = 2, keep_numbers: bool = False) -> list[str]:
    """The search terms of one string, as ``search_terms`` gives them for a column."""
    folded = fold_text(text or "")
    for pattern, name in SPELLINGS:
        folded = re.sub(pattern, name, folded)
    stop = STOPWORDS | {fold_text(w) for w in stopwords}
    words = re.split("[^0-9a-z]+", folded)
    return [w for w in words if len(w) >= min_len and w not in stop and (keep_numbers or not w.isdigit())]


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(fold_text, na_action="ignore")


def folded(text: Column) -> Column:
    """Compatibility-normalised text without letter case; plain ASCII never leaves the JVM."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.lower(text)).otherwise(_folded(F.when(~plain, text)))


def search_terms(text: Column, stopwords: Iterable[str] = (), min_len: int = 2, keep_numbers: bool = False) -> Column:
    """The terms of a text in order, repeats kept; null text gives no terms.

    Words of fewer than ``min_len`` letters, stopwords (the default ones and
    ``stopwords``) and, unless ``keep_numbers``, pure numbers are left out.
    """
    folded_text = folded(F.coalesce(text, F.lit("")))
    spelt = folded_text
    for pattern, name in SPELLINGS:
        spelt = F.regexp_replace(spelt, pattern, name)
    spelt = F.when(folded_text.rlike(_ANY_SPELLING), spelt).otherwise(folded_text)
    stop = sorted(STOPWORDS | {fold_text(w) for w in stopwords})
    words = F.split(spelt, "[^0-9a-z]+")
    return F.filter(words, lambda w: (F.length(w) >= min_len) & ~w.isin(stop) & (F.lit(True) if keep_numbers else F.translate(w, "0123456789", "") != ""))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def build_snippet(title: str | None, body: str | None, terms: Iterable[str], width: int = DEFAULTS.snippet_chars, lead: int = DEFAULTS.snippet_lead) -> str:
    """The excerpt that holds most different terms.

    Terms are looked for as substrings of the text without letter case, in the
    body or, if it is blank, the title. Each hit opens a window ``lead`` before
    it; the first with most terms wins. Cut ends are marked by an ellipsis.
    """
    terms = set(terms)
    if not terms:
        return (body or title or "").strip()[:width]
    text = (body or "").strip() or (title or "").strip()
    if not text:
        return ""
    low = text.casefold()
    hits = sorted((m.start(), t) for t in terms for m in re.finditer(f"(?={re.escape(t)})", low))
    if not hits:
        head = text[:width].strip()
        return head + ("…" if len(text) > len(head) else "")
    # hits are sorted, so the window of each is a stretch that moves forward
    best_start, most = 0, 0
    inside: dict[str, int] = {}
    left = right = 0
    for at, _ in hits:
        start = max(0, at - lead)
        while right < len(hits) and hits[right][0] < start + width:
            inside[hits[right][1]] = inside.get(hits[right][1], 0) + 1
            right += 1
        while hits[left][0] < start:
            term = hits[left][1]
            inside[term] -= 1
            if not inside[term]:
                del inside[term]
            left += 1
        if len(inside) > most:
            best_start, most = start, len(inside)
    chunk = text[best_start : best_start + width].strip()
    return ("…" if best_start else "") + chunk + ("…" if best_start + width < len(text) else "")


@F.pandas_udf(StringType())
def snippet(title: pd.Series, body: pd.Series, terms: pd.Series) -> pd.Series:
    """``build_snippet`` for columns; apply it after the limit, when few rows are left."""
    return pd.Series([build_snippet(t, b, [] if k is None else list(k)) for t, b, k in zip(title, body, terms)], index=title.index, dtype=object)


def seed_list(raw: Column) -> Column:
    """The different addresses of a pasted list, in order."""
    return F.array_distinct(F.filter(F.split(raw, r"[\s,;]+"), lambda x: x != ""))
