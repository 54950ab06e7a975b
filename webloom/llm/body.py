"""The main body of a page, by its maximum-scoring run of lines.

Every line has a score, the log odds that it is the page's own text: fitted
weights of its words and signs first, then of its form and of what stands around it. One
linear scan finds the run of lines whose scores add up to most: the body. What
lies outside is site furniture, and so are the runs inside that count against it.

The weights come from labelled pages, and the labels from the pages themselves:
a wording that stands on page after page of its site is furniture, long
paragraphs and what stands between them are own text. The lines these labels
leave open are labelled by the fitted model, which is then fitted anew.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable
from itertools import chain, filterfalse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.templates import MONTHS

#: Pages the weights are fitted to, at most, and pages of one site among them.
SAMPLE_PAGES, SITE_PAGES = 4000, 120
#: In the sample, a wording is its site's furniture from so many pages and such a share of the site's pages on.
REPEATED_PAGES, REPEATED_SHARE = 4, 0.05
#: Rounds of labelling the open lines by the model and fitting it anew.
ROUNDS = 2
#: How likely an open line is what its place suggests.
LIKELY = 0.85
#: So many open lines under a line of furniture may be its list, where a page has no paragraphs.
LISTED = 6
#: Words of a paragraph whose lines label a page's own text.
PARAGRAPH_WORDS = 18
#: What one line adds to a run, at least and at most: a single line cannot end a long body.
LEAST, MOST = -2.0, 6.0
#: A line that scores less by itself is no open line.
CERTAIN = -3.0
_CLIP = 8.0
#: A line of fewer words ends no sentence with its full stop.
SENTENCE_WORDS = 4
#: What is told of so many lines of fewer than so many words is remembered, as they come again and again.
REMEMBERED, SHORT = 200_000, 20
DEBUG = False

BLANK, TITLE, OWN, FURNITURE = range(4)

FORMAT = re.compile("[­​-‏⁠﻿]")
_TOKEN = re.compile(r"[^\W\d_]+|\d(?:[\d.,:/-]*\d)?|[·|/›>»¤@©#→←…•*=:;{}()$—–-]|\.(?=\w)")
_BULLETS = frozenset("•*-#")
_WORD = re.compile(r"[^\W\d_]+")
# what may follow the end of a sentence, how sentences end, and how other lines end besides
_CLOSING, _STOPS, _ENDS = "\"'”»“)]", frozenset(".?!…。！？"), frozenset(".?!:…。！？")
_SPLIT = re.compile(r"(?<=[.?!])\s+")
_LINK = re.compile(r"https?://\S+")
_QUOTED = re.compile(r"[“„«\"]\s?[^“”„«»\"]{3,}?\s?[”“»\"]")
_NAME = re.compile(r"[^\W\d_]+")


def brand_of(domain: str | None) -> str:
    """The site's name in its domain: the letters at the start of the label before the last."""
    labels = (domain or "").casefold().split(".")
    match = _NAME.match(labels[-2]) if len(labels) > 1 else None
    return match.group() if match else ""


def slug_of(url: str | None) -> str:
    """The words of the last part of the URL's path, joined."""
    path = (url or "").partition("://")[2].partition("?")[0].partition("#")[0]
    return "".join(_WORD.findall(path.rpartition("/")[2].casefold())) if "/" in path else ""


def is_own_title(key: str, slug: str) -> bool:
    """Whether the URL's last part begins with the words of a line."""
    # most lines begin with another word
    first = key.partition(" ")[0]
    if first.isalpha() and not slug.startswith(first):
        return False
    joined = "".join(filter(str.isalpha, key.split()))
    return len(joined) > 8 and slug.startswith(joined)


class Line:
    """One line: its text, words and what the scan needs to know of it."""

    __slots__ = ("base", "begins", "bullet", "cuts", "key", "kind", "known", "row", "score", "sentence", "signs", "text", "words")

    def __init__(self, text: str, words: int, kind: int, sentence: bool, bullet: str, key: str, base: float, cuts: tuple[list[str], bool] = ([], False), signs: str = "", begins: str = "", known: bool = False) -> None:
        self.text, self.words, self.kind, self.sentence, self.bullet, self.key, self.base = text, words, kind, sentence, bullet, key, base
        self.score, self.cuts, self.signs, self.begins, self.known = 0.0, cuts, signs, begins, known


class _Tokens(dict):
    """The tokens of a text's parts between blanks."""

    def __missing__(self, part: str) -> tuple[str, ...]:
        bare = part.rstrip(".,!?")
        told = (bare,) if bare.isalpha() else tuple(["0" if t[0].isdigit() else t for t in _TOKEN.findall(part)])
        if len(self) < REMEMBERED:
            self[part] = told
        return told


_TOKENS = _Tokens()


def tokens_of(text: str, brand: str) -> list[str]:
    """Words and signs in lower case; numbers, dates and the site's name are slots."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    parts = text.split()
    if len(_TOKENS) + len(parts) >= REMEMBERED:
        _TOKENS.clear()
    tokens = list(chain.from_iterable(map(_TOKENS.__getitem__, parts)))
    # a month beside a number is part of a date
    if "0" in tokens and not MONTHS.isdisjoint(tokens):
        tokens = [t for k, t in enumerate(tokens) if not (t in MONTHS and "0" in tokens[max(0, k - 1) : k + 2])]
    if brand and brand[:4] in text:
        # names are often cut short or followed by a number in the domain
        head = brand[:4]
        tokens = ["@" if t.startswith(head) and len(t) >= 4 and (t.startswith(brand) or brand.startswith(t) and 5 * len(t) >= 4 * len(brand)) else t for t in tokens]
    return tokens


def signs_of(tokens: list[str]) -> str:
    """The signs and slots alone, in their order, and whether a word comes first: they tell rows, paths, lists and code."""
    return ("w" if tokens and tokens[0].isalpha() else "") + "".join(filterfalse(str.isalpha, tokens))


def local_features(tokens: list[str], signs: str, words: int, ends: bool) -> Iterable[str]:
    """What a line tells by itself: words, signs, how it begins, its whole wording, its form."""
    form = f"n{min(6, words.bit_length())}{'.' if ends else ''}"
    if not tokens:
        return (form,)
    if words < SHORT:
        # a longer line's whole wording and order of signs hardly come again
        return chain(dict.fromkeys(tokens), ("^" + tokens[0], "^" + " ".join(tokens[:2]), form, "=" + " ".join(tokens), "~" + signs, "~" + signs + form))
    return chain(dict.fromkeys(tokens), ("^" + tokens[0], "^" + " ".join(tokens[:2]), form))


def _level(score: float) -> int:
    """Whole steps of a score, the open ones finer."""
    return max(-6, math.floor(score)) if score < -1 else -1 if score < -0.5 else 0 if score < 0.5 else 1 if score < 2 else 2


def _stand(score: float) -> str:
    """A neighbour's score in three steps."""
    return "-" if score < CERTAIN else "0" if score < 0.5 else "+"


#: Features of lines that are no open ones, a few thousand at most; then those of open ones, by all that they tell of.
_CLOSED: dict[tuple, tuple[str, ...]] = {}
_OPEN: dict[tuple, tuple[str, ...]] = {}


def context_features(lines: list[Line]) -> list[tuple[str, ...]]:
    """For each of a page's filled lines: its score by itself, its form, and what stands around it.

    Open lines with the same bullet that follow each other are a list: they
    share what stands before and after it.
    """
    own = sum([x.words for x in lines if x.base >= CERTAIN])
    said = sum([x.words for x in lines if x.base >= 0 and x.sentence])
    state = "abc"[0 if 4 * said < own else 1 if 3 * said < 2 * own else 2]
    out: list[tuple[str, ...]] = []
    n = len(lines)
    i = 0
    while i < n:
        x = lines[i]
        if x.kind == TITLE or x.sentence or x.base < CERTAIN:
            form = "t" if x.kind == TITLE else "s" if x.sentence else "f"
            level = _level(x.base)
            size = min(5, x.words.bit_length())
            feats = _CLOSED.get((level, form, x.bullet, size, state))
            if feats is None:
                feats = _CLOSED[level, form, x.bullet, size, state] = (f"L{level}{form}", f"{form}{x.bullet}{size}", f"{state}{form}{x.bullet}{size}", f"{state}{level}{form}")
            out.append(feats)
            i += 1
            continue
        j = i + 1
        while j < n and lines[j].bullet == x.bullet and lines[j].base >= CERTAIN and not lines[j].sentence and lines[j].kind != TITLE:
            j += 1
        before, after = lines[i - 1] if i else None, lines[j] if j < n else None
        v = "^" if before is None else "t" if before.kind == TITLE else ("s" if before.sentence else "f") + _stand(before.base)
        w = "$" if after is None else "t" if after.kind == TITLE else ("s" if after.sentence else "f") + _stand(after.base)
        size = min(6, (j - i).bit_length())
        head = before.key if before is not None and before.kind != TITLE and not before.sentence else None
        shared = None
        for y in lines[i:j]:
            stand = _level(y.base), state, y.bullet, min(5, y.words.bit_length()), y.signs, v, w, size, head
            feats = _OPEN.get(stand)
            if feats is None:
                if shared is None:
                    # with the page's state, and without it where that state is rare
                    shared = [f"{x.bullet}<{v}", f"{state}{x.bullet}<{v}", f"{state}{x.bullet}>{w}", f"{state}{x.bullet}<{v}>{w}{size}", f"{x.bullet}*{state}{size}"]
                    if head is not None:
                        shared += [f"C{state}{x.bullet}", f"C={x.bullet}{head}", *[f"C:{x.bullet}{t}" for t in head.split()]]
                level, _, bullet, length, *_ = stand
                if len(_OPEN) >= REMEMBERED:
                    _OPEN.clear()
                feats = _OPEN[stand] = (f"L{level}f", f"L{level}f{bullet}", f"{state}f{bullet}{length}", f"{state}{level}f{bullet}", f"{bullet}~{y.signs}", *shared)
            out.append(feats)
        i = j
    return out


def _score(weights: dict[str, float], feats: Iterable[str]) -> float:
    return max(-_CLIP, min(_CLIP, weights[""] + sum(filter(None, map(weights.get, feats)))))


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last place of the maximum-scoring run; (0, -1) if nothing scores."""
    best, region, total, begin = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, region = total, (begin, i)
    return region


class BodyModel:
    """Weights of what lines hold (``local``) and of what stands around them (``context``)."""

    def __init__(self, local: dict[str, float], context: dict[str, float]) -> None:
        self.local, self.context = local, context
        #: lines of furniture and paragraphs of the sample, as labelled
        self.furniture: list[Line] = []
        self.paragraphs: list[Line] = []
        #: the sample's filled lines, as judged
        self.sample: list[list[Line]] = []
        #: rows of the features that were fitted, those of no weight too
        self.rows: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self._weighted = frozenset(local)
        self._seen: dict[tuple, tuple] = {}
        self._closed: dict[tuple, float] = {}

    def __getstate__(self):
        return self.local, self.context

    def __setstate__(self, state):
        self.__init__(*state)

    def read(self, domain: str | None, url: str | None, title: str | None, text: str) -> list[Line]:
        """The page's lines with the scores of what each of them holds."""
        brand = brand_of(domain)
        own = "".join(_WORD.findall(title.casefold())) if title else ""
        slug = slug_of(url)
        if len(slug) <= 12:
            slug = ""
        low_title = " ".join(title.casefold().split()) if title else ""
        seen, local = self._seen, self.local
        if not text.isascii() and FORMAT.search(text):
            text = FORMAT.sub("", text)
        size = len(low_title)
        titled, quoted = size > 8 and low_title in text.casefold(), "“" in text or "„" in text or "«" in text or '"' in text
        # without weights lines have no scores, and what is read is a shard's at most
        blank = len(local) < 2
        out = []
        for raw in text.split("\n"):
            line = raw.strip()
            if not line:
                out.append(Line("", 0, BLANK, False, "", "", 0.0))
                continue
            words = line.count(" ") + 1
            judged = line
            if titled and len(line) >= size and low_title in (low := line.casefold()):
                if len(line) <= size + 6 and "".join(_WORD.findall(low)) == own:
                    out.append(Line(line, words, TITLE, False, "", "", 0.0))
                    continue
                judged = low.replace(low_title, " ¤ ")
            elif quoted and ("“" in line or "„" in line or "«" in line or '"' in line):
                judged = _QUOTED.sub(" ¤ ", line)
            known = seen.get((judged, brand))
            if known is None:
                end = line[-8:].rstrip(_CLOSING)[-1:]
                ends = end in _ENDS
                tokens = tokens_of(judged, brand)
                signs, key, before = "", judged, False
                if words < SHORT:
                    signs, key = signs_of(tokens), " ".join(tokens)
                    before = not blank and local.get("=" + key, 0.0) < 0
                    if signs != "w":
                        key = " ".join([t for t in tokens if t.isalnum() or t in "@¤"])
                base = 0.0 if blank else self.line_score(tokens, signs, words, ends)
                bullet = tokens[0] if tokens and tokens[0] in _BULLETS else ""
                sentence = end in _STOPS and words >= SENTENCE_WORDS
                known = base, sentence, bullet, key, (tokens, ends), signs, (tokens[0] if tokens else "") + signs, before
                if words < SHORT or blank and judged is line:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[judged, brand] = known
            base, sentence, bullet, key, cuts, signs, begins, before = known
            own_title = slug and not sentence and is_own_title(key, slug)
            out.append(Line(line, words, TITLE if own_title else OWN, sentence, bullet, key, base, cuts, signs, begins, before))
        return out

    def read_many(self, pages: list[tuple]) -> tuple[list[list[Line]], Words]:
        """The filled lines of (domain, url, title, text) of many pages as ``read`` tells them, and their words, of which ``row`` tells the line's."""
        local, get = self.local, self.local.get
        blank = len(local) < 2
        texts: list[str] = []
        brands: dict[int, str] = {}
        told: list[tuple[str, str, int, str, bool]] = []
        slugs: list[str] = []
        numbers: list[int] = []
        for domain, url, title, text in pages:
            brand = brand_of(domain)
            head = brand[:4]
            own = "".join(_WORD.findall(title.casefold())) if title else ""
            slug = slug_of(url)
            slugs.append(slug if len(slug) > 12 else "")
            low_title = " ".join(title.casefold().split()) if title else ""
            ascii_text = text.isascii()
            if not ascii_text and FORMAT.search(text):
                text = FORMAT.sub("", text)
            size = len(low_title)
            titled, quoted = size > 8 and low_title in text.casefold(), "“" in text or "„" in text or "«" in text or '"' in text
            if _OTHER_SPACE.search(text):
                ascii_text = None
            n = 0
            for raw in text.split("\n"):
                line = raw.strip()
                if not line:
                    continue
                n += 1
                words = line.count(" ") + 1
                judged = line
                if titled and len(line) >= size and low_title in (low := line.casefold()):
                    if len(line) <= size + 6 and "".join(_WORD.findall(low)) == own:
                        told.append((line, "", words, "", True))
                        texts.append("")
                        continue
                    judged = low.replace(low_title, " ¤ ")
                elif quoted and ("“" in line or "„" in line or "«" in line or '"' in line):
                    judged = _QUOTED.sub(" ¤ ", line)
                folded = (judged if ascii_text or judged.isascii() else unicodedata.normalize("NFKC", judged)).casefold()
                if head and head in folded:
                    brands[len(texts)] = brand
                texts.append(folded if ascii_text is not None else " ".join(folded.split()))
                told.append((line, judged, words, line[-8:].rstrip(_CLOSING)[-1:], False))
            numbers.append(n)
        held = Words(texts, brands)
        import numpy as np

        names = held.names
        scores = np.zeros(len(texts)) if blank else held.sums(np.array([get(t, 0.0) for t in names]), distinct=True)
        signed = held.sums((~held.alpha).astype(float)).tolist()
        out, tokens_of_all, k = [], held.tok.tolist(), 0
        shapes: dict[tuple, float] = {}
        beginnings: dict[tuple[int, int], float] = {}
        for n, slug in zip(numbers, slugs):
            lines = []
            for (line, judged, words, end, is_title), a, size, score, marks in zip(told[k : k + n], held.begins[k : k + n].tolist(), held.sizes[k : k + n].tolist(), scores[k : k + n].tolist(), signed[k : k + n]):
                if is_title:
                    x = Line(line, words, TITLE, False, "", "", 0.0)
                    x.row = k
                    k += 1
                    lines.append(x)
                    continue
                first = names[tokens_of_all[a]] if size else ""
                ends, short = end in _ENDS, words < SHORT
                signs, key, before = "", judged, False
                if short:
                    tokens = [names[t] for t in tokens_of_all[a : a + size]]
                    whole = key = " ".join(tokens)
                    signs = "w"
                    if marks or not tokens:
                        signs = signs_of(tokens)
                        key = " ".join([t for t in tokens if t.isalnum() or t in "@¤"])
                    wording = 0.0 if blank else get("=" + whole, 0.0)
                    before = wording < 0
                if not blank:
                    # how lines begin, their signs and forms are few
                    shape = min(6, words.bit_length()), ends, signs if short and size else None
                    told_shape = shapes.get(shape)
                    if told_shape is None:
                        form = f"n{shape[0]}{'.' if ends else ''}"
                        told_shape = shapes[shape] = local[""] + get(form, 0.0) + (get("~" + signs, 0.0) + get("~" + signs + form, 0.0) if shape[2] is not None else 0.0)
                    score += told_shape
                    if size:
                        begin = tokens_of_all[a], tokens_of_all[a + 1] if size > 1 else -1
                        told_begin = beginnings.get(begin)
                        if told_begin is None:
                            told_begin = beginnings[begin] = get("^" + first, 0.0) + get(f"^{first} {names[begin[1]]}" if size > 1 else "^" + first, 0.0)
                        score += told_begin + (wording if short else 0.0)
                    score = -_CLIP if score < -_CLIP else _CLIP if score > _CLIP else score
                sentence = end in _STOPS and words >= SENTENCE_WORDS
                x = Line(line, words, TITLE if slug and not sentence and is_own_title(key, slug) else OWN, sentence, first if first in _BULLETS else "", key, score, ([], ends), signs, first + signs, before)
                x.row = k
                k += 1
                lines.append(x)
            out.append(lines)
        return out, held

    def judge_many(self, pages: list[tuple]) -> tuple[list[list[Line]], Words]:
        """``judge`` of many pages, without their blank lines, as ``read_many`` gives them."""
        out, held = self.read_many(pages)
        if len(self.context) >= 2:
            for lines in out:
                mark_furniture(lines, list(map(self.place_score, context_features(lines))))
        return out, held

    def judge(self, domain: str | None, url: str | None, title: str | None, text: str) -> list[Line]:
        """The page's lines, each blank, title, own or furniture; a model without weights finds no furniture."""
        lines = self.read(domain, url, title, text)
        if len(self.context) < 2:
            return lines
        filled = [x for x in lines if x.kind != BLANK]
        mark_furniture(filled, [self.place_score(feats) for feats in context_features(filled)])
        return lines

    def line_score(self, tokens: list[str], signs: str, words: int, ends: bool) -> float:
        """``_score`` of ``local_features``: of a long line's many words, those that have weights are told at once."""
        if words < SHORT:
            return _score(self.local, local_features(tokens, signs, words, ends))
        local = self.local
        held = self._weighted.intersection(tokens)
        get = local.get
        extra = get(f"n{min(6, words.bit_length())}{'.' if ends else ''}", 0.0)
        if tokens:
            extra += get("^" + tokens[0], 0.0) + get("^" + " ".join(tokens[:2]), 0.0)
        return max(-_CLIP, min(_CLIP, local[""] + extra + math.fsum(map(local.__getitem__, held))))

    def place_score(self, feats: tuple[str, ...]) -> float:
        """The score of a line's form and of what stands around it; lines that stand alike share it."""
        score = self._closed.get(feats)
        if score is None:
            if len(self._closed) >= REMEMBERED:
                self._closed.clear()
            score = self._closed[feats] = _score(self.context, feats)
        return score


#: White space besides blanks that parts texts.
_OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\u1680\u2028\u2029]")


class Words:
    """The tokens of many lines as numbers: ``tok`` line after line, ``row`` the line of each, ``names`` what they are.

    The same as ``tokens_of`` every line, but each different part of a text is
    told once. Texts are in lower case, and parted by blanks alone.
    """

    def __init__(self, texts: list[str], brands: dict[int, str]) -> None:
        """``brands`` has the site's name of the lines that may hold it."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        held = parts.flatten().dictionary_encode()
        codes = held.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        zero, site = number["0"], number["@"]
        unique = held.dictionary.to_pylist()
        if len(_TOKENS) + len(unique) >= REMEMBERED:
            _TOKENS.clear()
        told = list(map(_TOKENS.__getitem__, unique))
        sizes = np.fromiter(map(len, told), np.int64, len(told))
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(told)), np.int64, int(sizes.sum()))
        times = sizes[codes]
        ends = np.cumsum(times)
        tok = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - times), times) + np.arange(int(times.sum()))]
        row = np.repeat(row, times)
        self.names = names = list(number)
        # a month beside a number is part of a date
        months = np.array([t in MONTHS for t in names])[tok]
        if months.any():
            is_zero = tok == zero
            beside = np.zeros(len(tok), dtype=bool)
            beside[1:] |= is_zero[:-1] & (row[1:] == row[:-1])
            beside[:-1] |= is_zero[1:] & (row[1:] == row[:-1])
            tok, row = tok[~(months & beside)], row[~(months & beside)]
        if brands:
            heads = {b[:4] for b in brands.values()}
            near = np.any([[t[:n] in heads for t in names] for n in {len(h) for h in heads}], axis=0)
            lines = np.zeros(len(texts), dtype=bool)
            lines[list(brands)] = True
            for k in np.flatnonzero(near[tok] & lines[row]).tolist():
                t, brand = names[tok[k]], brands[int(row[k])]
                if len(t) >= 4 and (t.startswith(brand) or t.startswith(brand[:4]) and brand.startswith(t) and 5 * len(t) >= 4 * len(brand)):
                    tok[k] = site
        self.tok, self.row = tok, row
        self.alpha = np.fromiter(map(str.isalpha, names), bool, len(names))
        self.sizes = np.bincount(row, minlength=len(texts))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def sums(self, values, distinct: bool = False):
        """For each line the sum of its tokens' ``values``, or of its different tokens'."""
        import numpy as np

        held = values[self.tok] != 0
        row, tok = self.row[held], self.tok[held]
        if distinct:
            row, tok = np.divmod(distinct_of(row * len(values) + tok), len(values))
        return np.bincount(row, weights=values[tok], minlength=len(self.sizes))


def distinct_of(keys):
    """The different ones of many numbers, in order."""
    import numpy as np

    keys = np.sort(keys)
    return keys[np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]))]


def mark_furniture(filled: list[Line], scores: list[float]) -> None:
    """Sets the kind of the filled lines outside the maximum-scoring run, and of those inside that count against it."""
    for x, score in zip(filled, scores):
        x.score = 1.0 if x.kind == TITLE else score
    first, last = best_region([max(LEAST, min(MOST, x.score)) for x in filled])
    if not any(x.score >= 0 and x.kind != TITLE for x in filled):
        # no line speaks for itself: what is not known as furniture is all the page has to say
        first, last = 0, len(filled) - 1
        for x in filled:
            x.score = 0.0 if x.base >= CERTAIN and not x.known else x.score
    for i, x in enumerate(filled):
        if x.kind != TITLE and (x.score < 0 or not first <= i <= last):
            x.kind = FURNITURE


class Encoded:
    """Rows of features as numbers; features of fewer than ``least`` rows are left out.

    Equal rows are held once: ``place`` tells which of ``rows`` each row is.
    Features of the same rows are held once too, as they get the same weight.
    """

    def __init__(self, rows: Iterable[tuple[str, ...]], place: list[int], least: int) -> None:
        import numpy as np

        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        rows = list(rows)
        flat = np.array(list(map(number.__getitem__, chain.from_iterable(rows))), dtype=np.int64)
        row = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), np.int64, len(rows)))
        self.place, self.rows = np.array(place, dtype=np.int64), len(rows)
        times = np.bincount(self.place, minlength=len(rows))
        counts = np.bincount(flat, weights=times[row], minlength=len(number)).astype(np.int64)
        kept = counts >= least
        self.names = [f for f, k in zip(number, kept.tolist()) if k]
        self.counts = dict(zip(self.names, counts[kept].tolist())) | {"": len(place)}
        held = kept[flat]
        flat, row = (np.cumsum(kept) - 1)[flat[held]], row[held]
        order = np.argsort(flat, kind="stable")
        begins = np.searchsorted(flat[order], np.arange(len(self.names)))
        # the rows of a feature by the sum of their random numbers
        sums = np.random.default_rng(1).integers(0, 1 << 63, len(rows), dtype=np.uint64)[row[order]]
        _, first, self.group, self.alike = np.unique(np.add.reduceat(sums, begins) if len(begins) else sums, return_index=True, return_inverse=True, return_counts=True)
        chosen = np.full(len(self.names), -1)
        chosen[first] = np.arange(len(first))
        held = chosen[flat] >= 0
        self.flat, row = chosen[flat[held]], row[held]
        #: rows that hold features, and where each begins; then the rows of each feature, and where these begin
        self.live = np.unique(row)
        self.begins = np.searchsorted(row, self.live)
        order = np.argsort(self.flat, kind="stable")
        self.of_feature = row[order]
        self.feature_begins = np.searchsorted(self.flat[order], np.arange(len(first)))

    def _sums(self, w, b: float, room):
        import numpy as np

        z = np.full(self.rows, b)
        if len(self.live):
            z[self.live] += np.add.reduceat((w * self.alike).take(self.flat, mode="clip", out=room), self.begins)
        return z

    def fit(self, labels, strengths, ridge: float = 1.0, steps: int = 60) -> dict[str, float]:
        """Logistic regression: the weight of each feature, and the bias ''; keeps the rows' scores as ``scores``."""
        import numpy as np

        strength = np.bincount(self.place, weights=strengths, minlength=self.rows)
        told = np.bincount(self.place, weights=strengths * labels, minlength=self.rows)
        w, b = np.zeros(len(self.alike)), 0.0
        past, past_b = np.full(len(self.alike), 1e-8), 1e-8
        # what is added up is written to the same memory in each step
        room = np.empty(len(self.flat))
        for step in range(steps):
            error = strength / (1 + np.exp(-np.clip(self._sums(w, b, room), -30, 30))) - told
            grad = ridge * w
            if len(w):
                grad += np.add.reduceat(error.take(self.of_feature, mode="clip", out=room), self.feature_begins)
            past = 0.9 * past + 0.1 * grad * grad
            past_b = 0.9 * past_b + 0.1 * error.sum() ** 2
            rate = 0.3 / (1 + step / 20)
            w -= rate * grad / np.sqrt(past)
            b -= rate * error.sum() / math.sqrt(past_b)
        self.scores = np.clip(self._sums(w, b, room), -_CLIP, _CLIP)[self.place]
        return {"": float(b)} | {f: v for f, v in zip(self.names, w[self.group].tolist()) if abs(v) > 1e-3}


def sample_pages(pages: DataFrame, most: int = SAMPLE_PAGES, of_site: int = SITE_PAGES) -> list[tuple]:
    """(domain, url, title, text) of whole sites in the order of their hash, of ``of_site`` pages each, ``most`` in all, at most.

    Only sites and their numbers of pages are ordered over all rows; hot sites
    are thinned by the hash of the page's id before any row is moved.
    """
    site = F.lower("domain")
    rows = pages.where("extracted_text <> '' and domain is not null").select(site.alias("site"), F.col("id").cast("long").alias("id"), F.col("normalized_url").alias("url"), "title", F.col("extracted_text").alias("text"))
    sizes = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    chosen, held = [], 0
    for s, n in ((r["site"], r["n"]) for r in sizes.orderBy(F.xxhash64("site"), "site").limit(most).collect()):
        if held >= most:
            break
        chosen.append((s, min(1.0, of_site / n)))
        held += min(n, of_site)
    if not chosen:
        return []
    few = F.broadcast(pages.sparkSession.createDataFrame(chosen, "site string, share double"))
    part = rows.join(few, "site").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).limit(2 * most)
    out = [(r["id"] if r["id"] is not None else -1, r["site"], r["url"], r["title"], r["text"]) for r in part.drop("share").collect()]
    return [r[1:] for r in sorted(out, key=lambda r: (r[1], r[0], r[4]))]


def fit_body_model(sample: list[tuple], rounds: int = ROUNDS) -> BodyModel:
    """The model of a sample of pages; an empty sample gives a model without weights."""
    blank = BodyModel({"": 0.0}, {"": 0.0})
    read = [[x for x in blank.read(*page) if x.kind != BLANK] for page in sample]
    sizes = Counter(page[0] for page in sample)
    on_site: dict[str, Counter] = {s: Counter() for s in sizes}
    begun: dict[str, Counter] = {s: Counter() for s in sizes}
    # what only stands on pages without paragraphs is no furniture: it is what these pages say
    beside: dict[str, set[str]] = {s: set() for s in sizes}
    for page, lines in zip(sample, read):
        on_site[page[0]].update({x.key for x in lines if x.key and x.kind != TITLE})
        begun[page[0]].update({x.begins for x in lines if x.kind != TITLE})
        if any([x.sentence and x.words >= PARAGRAPH_WORDS for x in lines]):
            beside[page[0]].update([x.key for x in lines])
    strong, places, trust = [], [], []
    # rows of equal lines are held once; the first is the title lines', without features
    rows: list[tuple[str, ...]] = [()]
    place: list[int] = []
    of_line: dict[tuple[int, int], int] = {}
    of_form: dict[tuple, int] = {}
    furniture: dict[str, Line] = {}
    paragraphs: dict[str, Line] = {}
    inside: Counter = Counter()
    outside: Counter = Counter()
    for page, lines in zip(sample, read):
        counts, starts, near = on_site[page[0]].get, begun[page[0]].get, beside[page[0]]
        often = max(REPEATED_PAGES, REPEATED_SHARE * sizes[page[0]])
        long = [i for i, x in enumerate(lines) if x.sentence and x.words >= PARAGRAPH_WORDS and counts(x.key, 0) < REPEATED_PAGES]
        first, last = (long[0], long[-1]) if long else (0, -1)
        paragraph = set(long)
        listed = 0  # the line of furniture above the open lines before this one
        below = False  # whether only open lines stand between the last paragraph or title and this line
        for i, x in enumerate(lines):
            title, is_long = x.kind == TITLE, i in paragraph
            if title:
                place.append(0)
            else:
                # lines read alike share their cuts
                at = id(x.cuts), x.words
                k = of_line.get(at)
                if k is None:
                    tokens, ends = x.cuts
                    form = " ".join(tokens), min(6, x.words.bit_length()), ends, x.words < SHORT
                    k = of_form.get(form)
                    if k is None:
                        k = of_form[form] = len(rows)
                        rows.append(tuple(local_features(tokens, x.signs, x.words, ends)))
                    of_line[at] = k
                place.append(k)
            open_line = not title and not is_long and (counts(x.key, 0) < often or x.key not in near)
            strong.append(None if open_line or title else float(is_long))
            if strong[-1] == 0.0:
                furniture.setdefault(x.key, x)
            elif is_long and not title:
                paragraphs.setdefault(x.text, x)
            # on pages without paragraphs the model is surer to err
            trust.append(0.75 if long else 0.25)
            between = first < i < last or bool(long) and i == first - 1
            if x.sentence or between:
                places.append((LIKELY, None))
            elif not long:
                places.append((0.5 if starts(x.begins, 0) >= often or listed and i - listed <= LISTED else LIKELY, x.signs))
            else:
                places.append((1 - LIKELY if starts(x.begins, 0) >= often else LIKELY if below else 0.5, x.signs))
            below = is_long or title or below and open_line
            listed = i if strong[-1] == 0.0 else listed if open_line else 0
            if open_line and long and not x.sentence:
                (inside if between else outside)[x.signs] += 1
    # forms of lines that mostly stand between paragraphs are likelier own wherever they stand
    mostly = {signs for signs, n in inside.items() if n > outside[signs]}
    open_lines = [LIKELY if signs is not None and signs in mostly else p for p, signs in places]
    if not any(y == 0.0 for y in strong) or not any(y == 1.0 for y in strong):
        return blank
    import numpy as np

    titles = np.array([x.kind == TITLE for lines in read for x in lines])
    fixed = np.array([y is not None for y in strong])
    known = np.array([y if y is not None else 0.0 for y in strong])
    opened, trusted = np.array(open_lines), np.array(trust)
    labels = opened
    # labels near one half say little; title lines are known and teach nothing
    strength = np.where(titles, 0.0, np.where(fixed, 1.0, np.maximum(0.3, np.abs(2 * opened - 1))))
    held = Encoded(rows, place, 4)
    for k in range(rounds + 1):
        y = np.where(fixed, known, labels)
        local = held.fit(y, strength)
        bases = iter(np.where(titles, 0.0, held.scores).tolist())
        number: dict[tuple[str, ...], int] = {}
        around = []
        for lines in read:
            for x in lines:
                x.base = next(bases)
            around += [number.setdefault(feats, len(number)) for feats in context_features(lines)]
        beside_others = Encoded(number, around, 5)
        context = beside_others.fit(y, strength)
        at = 0
        if k == rounds:
            scores = beside_others.scores.tolist()
            # of a short line's features the last but two is its whole wording
            whole = [len(feats) > 2 and feats[-3][0] == "=" and len(feats[-3]) > 1 and local.get(feats[-3], 0.0) < 0 for feats in rows]
            row = iter(place)
            for lines in read:
                for x in lines:
                    x.known = whole[next(row)]
                mark_furniture(lines, scores[at : at + len(lines)])
                at += len(lines)
            break
        scores = np.where(titles, 1.0, beside_others.scores)
        steps, within = np.clip(scores, LEAST, MOST).tolist(), np.zeros(len(scores), dtype=bool)
        for lines in read:
            first, last = best_region(steps[at : at + len(lines)])
            within[at + first : at + last + 1] = True
            at += len(lines)
        labels = opened + trusted * (np.where(within, 1 / (1 + np.exp(-scores)), 0.0) - opened)
    model = BodyModel(local, context)
    model.furniture, model.paragraphs, model.sample = list(furniture.values()), list(paragraphs.values()), read
    model.rows = held.counts, beside_others.counts
    return model
