"""Template residue and error-page text, by character n-gram likelihoods.

Models of the characters within words are fitted: error notices, filler, site
furniture and natural prose. Words get the log ratio of their likelihoods; the
windows of words in which a ratio adds up are the residue. A page is excluded
if residue covers the larger part of its main text, or if an unfilled field
stands in the place of a value.

The labels come from the pages: what pages of an error status say instead of
paragraphs are notices, long paragraphs are prose, wordings that come back all
over a site are furniture. Filler begins with well-known dummy text. What these
models find is then added to the labels, and they are fitted anew. Likewise sentences with quoted fields speak of fields, and lines
with several fields and few words are templates left unfilled; n-grams of
either tell the fields that are left.

Every page takes part. Shards of whole sites, and of parts of large ones, are
fitted in tasks; their counts are added up and their weights averaged, so what
comes to the driver are n-grams and features, whatever the corpus' size.
"""

from __future__ import annotations

import gc
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, compress, islice

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.body import BLANK, FORMAT, FURNITURE, PARAGRAPH_WORDS, TITLE, BodyModel, Line, fit_body_model
from webloom.llm.furniture import kept, page_columns
from webloom.llm.templates import MONTHS, with_slots

ORDER = 4
#: Share of the background, the mean of all models, in each model's probabilities.
BACKGROUND = 0.1
#: A window counts from this log ratio on.
WINDOW = 9.0
#: A window's words must have so much log ratio each, so that weak signs repeated many times are none.
DENSITY = 1.2
#: Share of the main text that residue must cover.
COVERAGE = 0.5
#: A shard holds about so many pages and so many characters of text; larger sites are cut into parts of about so many pages.
SHARD_PAGES, SHARD_CHARS, PART_PAGES = 2000, 32_000_000, 120
#: A feature of a line must be met so often in the mean shard.
SHARD_ROWS = 4
#: Log ratio from which on down a clause speaks of the field in it.
SPOKEN = -3.0
#: What is told of so many words, and lines of fewer than so many characters, is remembered, as they come again and again.
REMEMBERED, SHORT_LINE = 200_000, 120
#: A paragraph is filler to begin with if it holds two of the dummy text's longer words, and so large a share of them.
DUMMY_SHARE, DUMMY_LETTERS = 0.05, 4
#: Words of fewer clauses with fields are names, not ways to speak of fields.
NAMED = 3
#: Pages whose words are looked up together, where they are judged and where a shard is fitted.
PREPARED, FIT_PREPARED = 250, 1000
#: Rounds of adding what the models find to their labels.
ROUNDS = 1

# The reason phrases of HTTP, and dummy text that editors of the crawl's languages leave in pages.
REASONS = (
    "Bad Request. Unauthorized. Payment Required. Forbidden. Not Found. Method Not Allowed. Not Acceptable. Request Timeout. Conflict. Gone. Length Required. Precondition Failed. Content Too Large. "
    "URI Too Long. Misdirected Request. Unprocessable Content. Locked. Too Early. Upgrade Required. Too Many Requests. Unavailable For Legal Reasons. Internal Server Error. Not Implemented. Bad Gateway. Service Unavailable. Gateway Timeout."
).split(". ")
LATIN = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
]
DUMMY = [
    # the first post and page of a new site
    "Welcome. This is your first post. Edit or delete it, then start writing! This is an example page. This is a new page.",
    "Willkommen. Dies ist dein erster Beitrag. Bearbeite oder lösche ihn und beginne mit dem Schreiben! Dies ist eine Beispielseite.",
    "Bienvenue. Ceci est votre premier article. Modifiez-le ou supprimez-le, puis commencez à écrire ! Ceci est une page d’exemple.",
    "Te damos la bienvenida. Esta es tu primera entrada. Edítala o bórrala, ¡luego empieza a escribir! Esta es una página de ejemplo.",
    *"bla bla bla|blah blah blah|asdf asdf asdf|qwerty qwerty|foo bar baz|test test test|TODO|TBD|xxx xxx|heading 0 heading 0|replace this text".split("|"),
    *"dummy text|sample text|sample paragraph|placeholder text|your text here|text goes here|insert text here|description coming soon|content coming soon".split("|"),
    *"Blindtext|Platzhalter|Beispieltext|Text folgt|Inhalt folgt in Kürze|hier kommt der Text|Überschrift hier".split("|"),
    *"faux texte|texte à venir|texte ici|contenu bientôt disponible|texte à remplacer|à compléter".split("|"),
    *"texto de ejemplo|texto de relleno|el texto va aquí|contenido próximamente|prueba prueba prueba|por completar".split("|"),
]

#: Unfilled fields in the notations of common template languages.
FIELD = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%=?[^%\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|\[\[[^\[\]\n]{1,60}\]\]|<<[^<>\n]{1,60}>>|@@\w+@@|\*\|\w+\|\*|%[A-Z][A-Z_]{2,}%|__[A-Z][A-Z_]+__|XX-[A-Z_]+-XX"
    r"|\[(?:your|insert|enter|add|ihr|hier|votre|insérez|su|inserte)\s[^\[\]\n]{1,50}\]|(?<![\w{])\{[a-z_]+(?:\.[a-z_]+)*\}(?![\w}])|(?<![\w<])<(?:author|date|price|product|city|company|headline|heading|body|summary|tagline|title|name|email|phone|address|site_name|page_title|cta_text)>",
    re.I,
)
_COMMAND = re.compile(r"^\s*(?:\$ |echo |>>> )|^[\w.]+ ?= ?[\"'(\[{]")
_VALUE = re.compile(r"/\w+(?:/\w+)+|\b(?=\w*\d)\w+\b")
_WORD = re.compile(r"[^\W\d_]+|0")
_CLAUSE = re.compile(r"(?<=[.?!])\s+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_BARE = re.compile(r"[\"'“”„‘’`«]\s*\x01\s*[\"'“”‘’`»]")
QUOTED = "\x02"
# every notation of a field holds one of these
_OPENING = ("{", "[", "<", "@", "%", "_", "*", "XX-")
_MARKS = ".,:;!?"


def may_hold_field(text: str) -> bool:
    """Whether a text has a sign that fields have; plain searches are much cheaper than ``FIELD``."""
    return any([x in text for x in _OPENING])


def words_of(text: str) -> list[str]:
    """Words in lower case; numbers, codes and paths are slots."""
    return _WORD.findall(with_slots(_VALUE.sub("0", text)))


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + ORDER] for i in range(max(1, len(padded) - ORDER + 1))]


def _parts(lines: list[str]):
    """(words, codes, sizes): the different words of lines, which of them the lines hold, and how many each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.utf8_split_whitespace(pa.array(lines, pa.string()))
    held = parts.flatten().dictionary_encode()
    return held.dictionary.to_pylist(), held.indices.to_numpy(zero_copy_only=False), np.diff(parts.offsets.to_numpy())


def count_words(lines: Iterable[str]) -> Counter:
    """The counts of ``words_of`` the lines, told of each different word once."""
    import numpy as np

    counts: Counter = Counter()
    lines = list(lines)
    if not lines:
        return counts
    words, codes, sizes = _parts(lines)
    row = np.repeat(np.arange(len(lines)), sizes)
    plain = [_PLAIN[w] for w in words]
    # dates go over several words
    months, numbers = (np.array(x, dtype=bool)[codes] for x in ([not MONTHS.isdisjoint(p) for p in plain], ["0" in p for p in plain]))
    dated = (np.bincount(row[months], minlength=len(lines)) > 0) & (np.bincount(row[numbers], minlength=len(lines)) > 0)
    for i in np.flatnonzero(dated).tolist():
        counts.update(words_of(lines[i]))
    for p, n in zip(plain, np.bincount(codes[~dated[row]], minlength=len(words)).tolist()):
        if n:
            for w in p:
                counts[w] += n
    return counts


class Grams(Counter):
    """Counts of n-grams."""


def _coded(words: list[str]) -> bool:
    """Whether ``_windows`` can tell the words' n-grams: characters of 16 bits and no blanks."""
    joined = "".join(words)
    return joined.isascii() and " " not in joined or max(joined) <= "\uffff" and " " not in joined


def _windows(words: list[str]):
    """(codes, begins): the n-grams at the places of the joined words, and where the words begin.

    Places within a word or right before it that begin no n-gram have codes of none.
    """
    import numpy as np

    units = np.frombuffer((" " + " ".join(words) + "   ").encode("utf-16-le"), "<u2").astype(np.uint64)
    second, third, fourth = units[1:-2], units[2:-1], units[3:]
    blank = third == 32
    # words of one letter have a single n-gram, which is shorter
    codes = units[:-3] | second << np.uint64(16) | third << np.uint64(32) | np.where(blank, np.uint64(0), fourth) << np.uint64(48)
    codes[(second == 32) | blank & (units[:-3] != 32)] = 0
    begins = np.zeros(len(words), dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words[:-1]), np.int64, len(words) - 1) + 1, out=begins[1:])
    return codes, begins


def grams_of(words: Counter) -> Grams:
    """The n-grams of counted words."""
    import numpy as np

    counts = Grams()
    short = list(words)
    if short and not _coded(short):
        short = [w for w in short if _coded([w])]
    if short:
        codes, begins = _windows(short)
        times = np.repeat(np.fromiter(map(words.__getitem__, short), np.int64, len(short)), np.diff(begins, append=len(codes)))
        held = codes != 0
        found, where = np.unique(codes[held], return_inverse=True)
        text = found.astype("<u8").tobytes().decode("utf-16-le")
        counts.update({text[ORDER * k : ORDER * k + ORDER].rstrip("\0"): int(n) for k, n in enumerate(np.bincount(where, weights=times[held]).tolist())})
    if len(short) < len(words):
        for w in words.keys() - set(short):
            for g in _grams(w):
                counts[g] += words[w]
    return counts


class _Shares(dict):
    """The share of each n-gram among the n-grams of counted words, or among counted n-grams."""

    def __init__(self, words: Counter) -> None:
        counts = words if isinstance(words, Grams) else grams_of(words)
        total = max(1, sum(counts.values()))
        super().__init__({g: n / total for g, n in counts.items() if n > 0})


class _Ratios(dict):
    """Log ratios of a word's likelihoods under pairs of models, by the word as it stands."""

    def __init__(self, models: list[_Shares], pairs: list[tuple[int, int]]) -> None:
        super().__init__()
        self.none = (0.0,) * len(pairs)
        import numpy as np

        grams = list(set().union(*models))
        shares = np.array([[m.get(g, 0.0) for g in grams] for m in models])
        smooth = (1 - BACKGROUND) * shares + BACKGROUND * shares.mean(axis=0)
        self.of_gram = dict(zip(grams, zip(*[np.log(smooth[a] / smooth[b]).tolist() for a, b in pairs])))

    def __missing__(self, word: str) -> tuple[float, ...]:
        get = self.of_gram.get
        found = [r for w in _PLAIN[word] for g in _grams(w) if (r := get(g)) is not None]
        value = tuple([max(-6.0, min(6.0, sum(r))) for r in zip(*found)]) if found else self.none
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def plain_words(word: str) -> list[str]:
    """``words_of`` one word; most are plain ones."""
    bare = word.strip(_MARKS)
    if bare.isalpha():
        return [bare.casefold() if bare.isascii() else unicodedata.normalize("NFKC", bare).casefold()]
    if bare.isdecimal():
        return ["0"]
    return words_of(word)


class _Plain(dict):
    """``plain_words`` of words, as they come again and again."""

    def __missing__(self, word: str) -> list[str]:
        found = plain_words(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


_PLAIN = _Plain()


class _Bounds(dict):
    """The most that a word can add to a window of any kind of residue."""

    def __init__(self, ratios: _Ratios, kinds: int) -> None:
        import numpy as np

        super().__init__()
        #: the kinds' ratios against prose, gram by gram; grams that speak for none of them still count
        self.of_gram = {g: r[:kinds] for g, r in ratios.of_gram.items()}
        self.none = (0.0,) * kinds
        # the same by the code of the n-gram, at the end those without one
        short = [g for g in self.of_gram if max(g) <= "\uffff" and " " not in g[1:-1]]
        codes = np.frombuffer("".join([g.ljust(ORDER, "\0") for g in short]).encode("utf-16-le"), "<u8")
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.table = np.array([self.of_gram[short[k]] for k in order] + [self.none]).T

    def __missing__(self, word: str) -> float:
        get = self.of_gram.get
        sums = [0.0] * len(self.none)
        for w in plain_words(word):
            for g in _grams(w):
                if r := get(g):
                    for k, x in enumerate(r):
                        sums[k] += x
        value = min(6.0, max(0.0, *sums))
        if len(self) < REMEMBERED:
            self[word] = value
        return value

    def prepare(self, words: set[str]) -> None:
        """Looks up many words at once; some are left to be looked up one by one."""
        import numpy as np

        new = words.difference(self)
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = words
        if not len(self.codes):
            return
        told = {w: found for w in new if (found := _PLAIN[w])}
        plain = list(chain.from_iterable(told.values()))
        if plain and not _coded(plain):
            told = {w: found for w, found in told.items() if _coded(found)}
            plain = list(chain.from_iterable(told.values()))
        if not plain:
            return
        codes, begins = _windows(plain)
        at = np.searchsorted(self.codes, codes)
        at[self.codes.take(at, mode="clip") != codes] = len(self.codes)
        sizes = np.fromiter(map(len, told.values()), np.int64, len(told))
        begins = begins[np.cumsum(sizes) - sizes]
        most = np.max([np.add.reduceat(row.take(at), begins) for row in self.table], axis=0)
        self.update(zip(told, np.clip(most, 0.0, 6.0).tolist()))


def best_window(scores: list[float]) -> tuple[float, int]:
    """The largest sum of consecutive scores, and how many they are."""
    best, size, total, begin = 0.0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, size = total, i - begin + 1
    return best, size


class ResidueModel:
    """Tells error notices, filler and unfilled fields from other lines."""

    def __init__(self, kinds: list[Counter], furniture: Counter, prose: Counter, spoken: Counter, unfilled: Counter) -> None:
        n = self.kinds = len(kinds)
        # each kind of residue against prose, then against furniture
        self.ratios = _Ratios([_Shares(x) for x in (*kinds, furniture, prose)], [*((k, n + 1) for k in range(n)), *((k, n) for k in range(n))])
        self.bounds = _Bounds(self.ratios, n)
        self.left_open = _Ratios([_Shares(unfilled), _Shares(spoken)], [(0, 1)])
        self._seen: dict[str, int] = {}
        self._ahead: dict[str, int] = {}

    def prepare(self, lines: Iterable[str]) -> None:
        """Tells many different lines at once that are no residue, which is cheaper than one by one; they are kept until the next are told."""
        import numpy as np

        self._ahead = {}
        new = [x for x in lines if x and x not in self._seen]
        if not new:
            return
        words, codes, sizes = _parts(new)
        self.bounds.prepare(set(words))
        most = np.array(list(map(self.bounds.__getitem__, words)))
        row = np.repeat(np.arange(len(new)), sizes)
        sums = np.bincount(row, weights=most[codes], minlength=len(new))
        none = sums + 1e-6 < np.maximum(WINDOW, DENSITY * sizes / 2)
        self._ahead = dict.fromkeys(compress(new, none.tolist()), 0)

    def may_be_residue(self, line: str) -> bool:
        """False for lines known to be no residue."""
        return self._ahead.get(line) != 0 and self._seen.get(line) != 0

    def residue(self, line: str) -> int:
        """The kind of residue, from 1, of which a window covers half of the line; 0 if none does."""
        kind = self._seen.get(line)
        if kind is None:
            kind = self._ahead.get(line)
            if kind is None:
                kind = self._residue(line)
            if len(self._seen) < REMEMBERED and len(line) < SHORT_LINE:
                self._seen[line] = kind
        return kind

    def _residue(self, line: str) -> int:
        parts = line.split()
        # a window of half the words must reach its density: no sum of positive ratios below that can hold one
        if sum(map(self.bounds.__getitem__, parts)) < max(WINDOW, DENSITY * len(parts) / 2):
            return 0
        words, n = [self.ratios[w] for w in parts], self.kinds
        for kind in range(n):
            best, size = best_window([w[kind] for w in words])
            if best >= max(WINDOW, DENSITY * size) and 2 * size >= len(words) and sum([w[kind + n] for w in words]) > 2.0:
                return kind + 1
        return 0

    def fields(self, line: str) -> int:
        """How a line's fields stand: 0 none, 1 spoken of, 2 alone amid words, 3 several or with hardly a word: in place of values.

        A clause speaks of its fields if one is quoted, or if its words are
        those of clauses with quoted fields.
        """
        found = several = 0
        for clause in fields_of(line):
            words = _WORD.findall(clause)
            bare = clause.count("\x01")
            if not bare:
                found = max(found, 1)
                continue
            several += bare
            if several > 1 or 2 * bare > len(words):
                return 3
            found = max(found, 2 if sum([self.left_open[w][0] for w in words]) > SPOKEN else 1)
        return found


def fields_of(line: str) -> list[str]:
    """The clauses of a line that hold a field: \\x01 if it stands bare, QUOTED otherwise; commands have none."""
    if not may_hold_field(line) or not FIELD.search(line) or _COMMAND.search(line):
        return []
    return [c for c in _CLAUSE.split(_BARE.sub(f" {QUOTED} ", FIELD.sub(" \x01 ", line))) if "\x01" in c or QUOTED in c]


def may_be_residue(title: str | None, text: str | None, model: ResidueModel) -> bool:
    """Whether a page holds a line of residue or a field at all; if not, ``judge_page`` gives no reason whatever its body."""
    if not text:
        return False
    if title and fields_of(title) or not text.isascii() and FORMAT.search(text):
        return True
    hinted = may_hold_field(text)
    for raw in text.split("\n"):
        line = raw.strip()
        if line and (model.residue(line) or hinted and (fields_of(line) or title and title in line and fields_of(line.replace(title, "")))):
            return True
    return False


def judge_page(domain: str | None, url: str | None, title: str | None, text: str | None, body: BodyModel, model: ResidueModel) -> tuple[str | None, float, list[Line]]:
    """(reason, coverage, lines): the reason is 'field', 'residue' or None."""
    if not text or not text.strip():
        return None, 0.0, []
    lines = body.judge(domain, url, title, text)
    own = covered = 0
    stand = {model.fields(title)} if title else set()
    hinted = may_hold_field(text)
    for x in lines:
        if x.kind in (BLANK, TITLE) or x.kind == FURNITURE and x.known:
            continue
        # share prompts quote the title, which is judged by itself
        if hinted:
            stand.add(model.fields(x.text.replace(title, "") if title else x.text))
        if model.residue(x.text):
            covered += x.words
        elif x.kind == FURNITURE:
            continue
        own += x.words
    coverage = covered / own if own else 0.0
    # a page that speaks of fields shows single ones too
    field = 3 in stand or 2 in stand and 1 not in stand
    return "field" if field else "residue" if own and coverage >= COVERAGE else None, coverage, lines


def _clauses(page: str, title: str | None) -> tuple[list[str], list[str]]:
    """The clauses of a page that speak of quoted fields, and those with several bare ones."""
    spoken, left = [], []
    whole = f"{page}\n{title or ''}"
    for line in whole.split("\n") if may_hold_field(whole) else ():
        if may_hold_field(line) and FIELD.search(line) and not _COMMAND.search(line):
            for clause in _CLAUSE.split(FIELD.sub(" \x01 ", line)):
                if _BARE.search(clause):
                    spoken.append(clause)
                elif clause.count("\x01") > 1:
                    left.append(clause)
    return spoken, left


def fit_shard(pages: list[tuple], rounds: int = ROUNDS) -> list[tuple[str, str, float, float]]:
    """(table, key, a, b): what a shard's pages (site, url, title, text, status) tell of the models, to be added up.

    Of features a is their weight by rows, b the rows; of n-grams a is the
    count; of words of clauses with fields a is the count and b the clauses.
    """
    body = fit_body_model([p[:4] for p in pages if p[0]])
    wordings = {x.key for x in body.furniture}
    told = set()
    spoken, left = [], []
    for *page, status in pages:
        if status is not None and status >= 400:
            lines = [x for x in body.judge(*page) if x.kind not in (BLANK, TITLE)]
            if not any(x.sentence and x.words >= PARAGRAPH_WORDS for x in lines):
                told |= {x.text for x in lines if x.key not in wordings and (x.sentence or x.kind != FURNITURE)}
        one, other = _clauses(page[3], page[2])
        spoken += one
        left += other
    labels = [[*REASONS, *sorted(told)], list(DUMMY), list(LATIN)]
    latin = frozenset(w for x in LATIN for w in words_of(x) if len(w) >= DUMMY_LETTERS)
    prose = {}
    for x in body.paragraphs:
        p, tokens = x.text, x.cuts[0]
        if not latin.isdisjoint(tokens) or "@" in tokens or not p.isascii():
            words = _WORD.findall(p.casefold())
            dummy = [w for w in words if w in latin]
            if len(set(dummy)) > 1 and len(dummy) >= DUMMY_SHARE * len(words):
                labels[2].append(p)
                continue
        prose[p] = None
    furniture, told_prose = count_words(x.text for x in body.furniture), count_words(prose)
    kinds = known = [count_words(x) for x in labels]
    fewer = told_prose
    for _ in range(rounds):
        model = ResidueModel(kinds, furniture, fewer, Counter(), Counter())
        more: list[set[str]] = [set() for _ in labels]
        for i, lines in enumerate(body.sample):
            if i % FIT_PREPARED == 0:
                model.prepare({x.text for near in body.sample[i : i + FIT_PREPARED] for x in near})
            # if all lines that may be residue were some, they would still have to cover the page
            open_lines = [(x, model.may_be_residue(x.text)) for x in lines]
            most = sum([x.words for x, may in open_lines if may])
            if not most or most < COVERAGE * sum([x.words for x, may in open_lines if may or x.kind != FURNITURE]):
                continue
            told_lines = [model.residue(x.text) for x in lines]
            judged = [(x, k) for x, k in zip(lines, told_lines) if not (x.kind == FURNITURE and x.known)]
            own = sum(x.words for x, k in judged if k or x.kind != FURNITURE)
            if own and sum(x.words for x, k in judged if k) >= COVERAGE * own:
                # what else such a page says is residue of the same kind
                most = max(range(1, len(labels) + 1), key=lambda n: sum(x.words for x, k in judged if k == n))
                for x, k in judged:
                    if k or x.kind != FURNITURE:
                        more[(k or most) - 1].add(x.text)
        fewer = Counter(told_prose)
        fewer.subtract(count_words(p for p in set().union(*more) if p in prose))
        kinds = [a + count_words(x) for a, x in zip(known, more)]
    out = [(f"kind{k}", g, float(n), 0.0) for k, x in enumerate(kinds) for g, n in grams_of(x).items()]
    out += [(name, g, float(n), 0.0) for name, x in (("furniture", furniture), ("prose", fewer)) for g, n in grams_of(x).items()]
    clauses = Counter(w for clause in spoken + left for w in set(words_of(clause)))
    for name, x in (("spoken", spoken), ("left", left)):
        out += [(name, w, float(n), 0.0) for w, n in count_words(x).items()]
    out += [("clauses", w, float(n), 0.0) for w, n in clauses.items()]
    for name, weights, rows in zip(("local", "context"), (body.local, body.context), body.rows):
        out += [(name, f, weights.get(f, 0.0) * n, float(n)) for f, n in rows.items()]
    return out


def shards(pages: DataFrame, most: int = SHARD_PAGES, of_site: int = PART_PAGES) -> tuple[DataFrame, int]:
    """(shard, id, site, url, title, text, status) of all pages with text, and the number of shards.

    A shard holds whole sites; those of more than ``of_site`` pages are cut into
    parts by the hash of the page's id, so that no shard is one site's.
    """
    site, status = F.lower(F.coalesce("domain", F.lit(""))).alias("site"), F.col("status_code").cast("int").alias("status")
    rows = pages.where("extracted_text <> ''").select(F.col("id").cast("long").alias("id"), site, F.col("normalized_url").cast("string").alias("url"), F.col("title").cast("string").alias("title"), F.col("extracted_text").cast("string").alias("text"), status)
    sizes = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    total = sizes.agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).first()
    count = max(1, math.ceil((total["n"] or 0) / most), math.ceil((total["chars"] or 0) / SHARD_CHARS))
    # one row for each site of more than ``of_site`` pages
    cut = F.broadcast(sizes.where(F.col("n") > of_site).select("site", F.ceil(F.col("n") / of_site).alias("parts")))
    placed = rows.join(cut, "site", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    return placed.select(F.pmod(F.xxhash64("site", "part"), F.lit(count)).cast("int").alias("shard"), "id", "site", "url", "title", "text", "status"), count


def fit_models(pages: DataFrame, rounds: int = ROUNDS, shard_pages: int = SHARD_PAGES) -> tuple[BodyModel, ResidueModel]:
    """Both models, fitted to all pages: a shard in a task, counts added up and weights averaged by their rows."""
    rows, count = shards(pages, shard_pages)

    def fit(part):
        import pandas as pd

        part = part.astype(object).where(part.notna(), None).sort_values(["site", "id", "text"])
        rows = list(zip(part["site"], part["url"], part["title"], part["text"], part["status"]))
        # a shard's many lines hold no cycles, and need not be looked through for any
        gc.disable()
        try:
            told = fit_shard(rows, rounds)
        finally:
            gc.enable()
        return pd.DataFrame(told, columns=["kind", "key", "a", "b"])

    # shards are few and costly: in many small partitions they are spread evenly
    tasks = min(count, 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    added = rows.repartition(tasks, "shard").groupBy("shard").applyInPandas(fit, "kind string, key string, a double, b double").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # a feature counts if it is as frequent as it has to be in a single shard; n-grams and words of clauses with fields are as many as languages have
    tables: dict[str, dict[str, tuple[float, float]]] = {}
    for r in added.where((~F.col("kind").isin("local", "context")) | (F.col("key") == "") | (F.col("b") >= SHARD_ROWS * count)).collect():
        tables.setdefault(r["kind"], {})[r["key"]] = (r["a"], r["b"])
    # sums differ in their last digits with the order of tasks
    weights = [{f: round(a / b, 9) for f, (a, b) in sorted(tables.get(name, {}).items()) if b and abs(a / b) > 1e-3 or f == ""} for name in ("local", "context")]
    body = BodyModel(*[w or {"": 0.0} for w in weights])
    grams = lambda name: Grams({g: int(a) for g, (a, _) in sorted(tables.get(name, {}).items())})
    clauses = tables.get("clauses", {})
    spoken, left = (Counter({w: int(n) for w, (n, _) in sorted(tables.get(name, {}).items()) if clauses[w][0] >= NAMED}) for name in ("spoken", "left"))
    return body, ResidueModel([grams(f"kind{k}") for k in range(3)], grams("furniture"), grams("prose"), spoken, left)


def broadcast_models(pages: DataFrame) -> Broadcast:
    """The models, fitted once, to all pages; a few MB, whatever the corpus' size."""
    return pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, fit_models(pages)))


def residue_pages(pages: DataFrame, models: Broadcast | None = None) -> DataFrame:
    """(page_id, reason, coverage): the pages to exclude.

    ``reason`` is 'field' (an unfilled template field in title or text, in place
    of a value) or 'residue' (filler, an error, refusal, expiry or outage
    message, or a notice about scripts or the browser, covering the larger part
    of the main text). A page's own status code has no say. Pages with null or
    blank text are never listed; a null title is no title. One row per input row.
    Without ``models`` these are fitted to ``pages``.
    """
    models = models or broadcast_models(pages)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        body, model = kept(models)
        for batch in batches:
            found = []
            rows = zip(*(c.to_pylist() for c in batch.columns))
            while part := list(islice(rows, PREPARED)):
                model.prepare({line.strip() for *_, text in part if text for line in text.split("\n")})
                for page, *rest in part:
                    reason, coverage, _ = judge_page(*rest, body, model) if may_be_residue(rest[2], rest[3], model) else (None, 0.0, [])
                    if reason:
                        found.append((page, reason, coverage))
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], ["page_id", "reason", "coverage"])

    return page_columns(pages.where("extracted_text is not null")).mapInArrow(judge, "page_id bigint, reason string, coverage double")


def exclude_residue(pages: DataFrame) -> DataFrame:
    """``pages`` without those of ``residue_pages``; rows with a null id stay."""
    found = residue_pages(pages).select(F.col("page_id").alias("__page")).distinct()
    return pages.join(found, pages["id"].cast("long") == F.col("__page"), "left_anti")
