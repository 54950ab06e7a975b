"""Lines repeated across one site's pages, found by template trees.

Lines are parsed into templates by a token tree of fixed depth: the number of
tokens, then the first tokens, then a leaf with the templates of these lines. A
template has wildcard slots where its lines differ in filled-in values: numbers
(one slot for any of them), the page's own heading or title, and words framed
by numbers, as in dates of any notation and language. Which framed words are
values is learned: each leaf keeps the different fillings of its slots, the
leaves of all partitions are merged by adding them up, and a slot filled in
several ways becomes a wildcard, while one always filled alike stays literal.
All other tokens are literal, so a line that names another page or topic is
another template.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.skew import keyed_lookup
from webloom.session import Scratch

MIN_PAGES = 5
MIN_SHARE = 0.05
#: A tree that has grown to so many templates is begun anew; ids stay the same.
TREE_TEMPLATES = 50_000
#: The tree's depth below the number of tokens.
DEPTH = 2

# Names of the months, with their usual short forms, in the crawl's languages.
_MONTHS = (
    "january february march april may june july august september october november december "
    "jan feb mar apr jun jul aug sep sept oct nov dec "
    "januar februar märz april mai juni juli august september oktober november dezember jän mrz okt dez "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre janv févr avr juil déc "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre ene abr ago dic"
)
MONTHS = frozenset(_MONTHS.split())
_MONTH = "(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"

SLOT, TITLE, OPEN = "0", "¤", "*"
#: Words framed by numbers are values where they are filled in so many ways; so many stand between two numbers at most.
FILLINGS, FRAME = 3, 3
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\d+(?:[^\w\s]+\d+)*")
# fixed values: endings of ordinal numbers
_ORDINAL = re.compile(r"\d+(?:[^\w\s]+\d+)*(?:(?:st|nd|rd|th|er|[ºª])\b)?")
_DATE = re.compile(rf"0(?:st|nd|rd|th|er|º|\.)?\s+(?:de\s+|of\s+)?{_MONTH}\b\.?,?(?:\s+(?:de\s+|del\s+)?0)?|\b{_MONTH}\.?\s+0(?:st|nd|rd|th)?(?:,?\s+0)?|0[-/.]{_MONTH}[-/.]0")
_TOKEN = re.compile(r"[^\W_]+")
_HEADING_TOKENS, _HEADING_CHARS = 3, 12


def with_numbers(text: str) -> str:
    """The text without letter case, every number, ordinals too, replaced by ``SLOT``."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    return _ORDINAL.sub(SLOT, text) if _DIGIT.search(text) else text


def with_slots(text: str) -> str:
    """The text without letter case, every number and date replaced by ``SLOT``."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    if not _DIGIT.search(text):
        return text
    return _DATE.sub(SLOT, _NUMBER.sub(SLOT, text))


#: Two templates of a line: with its framed words as they are, and with slots in their place (None if it has none).
Parsed = tuple[int | None, int | None]


def _id(tokens: list[str]) -> int | None:
    """The id of a template, the same wherever it was parsed; None if nothing but values is left."""
    # numbers that follow each other are one value
    wording = "".join([t for k, t in enumerate(tokens) if t != SLOT or tokens[k - 1 : k] != [SLOT]])
    return xxhash.xxh3_64_intdigest(wording.encode()) - (1 << 63) if wording.strip(SLOT + TITLE + OPEN) else None


def framed(tokens: list[str]) -> list[int]:
    """Places of the words between two numbers, ``FRAME`` of them at most, or right before two numbers."""
    numbers = [k for k, t in enumerate(tokens) if t == SLOT]
    if len(numbers) < 2:
        return []
    out = [k for a, b in zip(numbers, numbers[1:]) if 1 < b - a <= FRAME + 1 for k in range(a + 1, b)]
    return sorted({*out, *(a - 1 for a, b in zip(numbers, numbers[1:]) if b == a + 1 and a and tokens[a - 1] != SLOT)})


class TemplateTree:
    """token count -> first ``DEPTH`` tokens -> leaf of templates; gives template ids."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def parse(self, tokens: list[str]) -> Parsed:
        """The line's template without and with slots for its framed words."""
        open_places = set(framed(tokens))
        shape = [OPEN if k in open_places else t for k, t in enumerate(tokens)]
        node = self.root.setdefault(len(tokens), {})
        for token in shape[:DEPTH]:
            node = node.setdefault(token, {})
        # in the leaf: the template of this shape, with its fillings met so far
        template = node.get(tuple(shape[DEPTH:]))
        if template is None:
            template = node[tuple(shape[DEPTH:])] = (_id(shape) if open_places else None, {})
            self.size += 1
        slotted, fillings = template
        filling = tuple(tokens[k] for k in sorted(open_places))
        if filling not in fillings:
            fillings[filling] = _id(tokens)
            self.size += bool(open_places)
        return fillings[filling], slotted


def line_templates(text: str, title: str | None, tree: TemplateTree) -> list[Parsed]:
    """The templates of each line; None for lines without wording."""
    lines = [_TOKEN.findall(line) for line in with_numbers(text).split("\n")]
    names = []
    own = _TOKEN.findall(with_numbers(title)) if title else []
    if own:
        names.append("".join(own))
    if not own or own not in lines:
        # the heading is not known from the title: a line that stands inside another line
        names += [n for n in _inner_lines(lines) if n not in names]
    out: list[Parsed] = []
    for tokens in lines:
        if not tokens:
            out.append((None, None))
            continue
        if names:
            joined = "".join(tokens)
            for name in names:
                if len(name) < len(joined) and name in joined and (cut := _cut(tokens, name)) is not tokens:
                    tokens = cut
                    break
                if name == joined and name == names[0] and own:
                    tokens = [TITLE]
                    break
        out.append(tree.parse(tokens))
    return out


def _inner_lines(lines: list[list[str]]) -> list[str]:
    """The joined lines that are a run of another line's tokens, in the order of the page.

    Each token is looked up once by the characters that follow it, so the cost
    stays linear unless many lines begin alike.
    """
    candidates = dict.fromkeys([n for l in lines if len(l) >= _HEADING_TOKENS and len(n := "".join(l)) >= _HEADING_CHARS])
    begun: dict[str, list[str]] = {}
    for n in candidates:
        begun.setdefault(n[:_HEADING_CHARS], []).append(n)
    found = set()
    for l in lines if candidates else ():
        joined = "".join(l)
        at, starts = 0, []
        for token in l:
            starts.append(at)
            at += len(token)
        for at in starts:
            for n in begun.get(joined[at : at + _HEADING_CHARS], ()):
                end = at + len(n)
                if len(n) < len(joined) and joined.startswith(n, at) and (end == len(joined) or end in starts):
                    found.add(n)
    return [n for n in candidates if n in found]


def _cut(tokens: list[str], name: str) -> list[str]:
    """The tokens with the run that spells ``name`` replaced by the title's slot."""
    for i in range(len(tokens)):
        if not name.startswith(tokens[i]):
            continue
        spelt = ""
        for j in range(i, len(tokens)):
            spelt += tokens[j]
            if spelt == name:
                return [*tokens[:i], TITLE, *tokens[j + 1 :]]
            if not name.startswith(spelt):
                break
    return tokens


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, site, plain, slotted): one row per page, with the templates of its lines; ``site`` is the domain without letter case."""

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tree = TemplateTree()
        for batch in batches:
            plain, slotted = [], []
            for title, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = line_templates(text, title, tree) if text else []
                plain.append([p for p, _ in found])
                slotted.append([s for _, s in found])
                if tree.size > TREE_TEMPLATES:
                    tree = TemplateTree()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plain, pa.list_(pa.int64())), pa.array(slotted, pa.list_(pa.int64()))], ["page_id", "site", "plain", "slotted"])

    rows = pages.select(F.col("id").cast("long").alias("page_id"), F.lower("domain").alias("site"), F.col("title").cast("string").alias("title"), F.col("extracted_text").alias("text"))
    return rows.mapInArrow(parse, "page_id bigint, site string, plain array<bigint>, slotted array<bigint>")


def merged_slots(parsed: DataFrame, fillings: int = FILLINGS) -> DataFrame:
    """(template): the slotted templates of all partitions that are filled in at least ``fillings`` ways: their slots are wildcards."""
    pairs = parsed.select(F.explode(F.arrays_zip("plain", "slotted")).alias("x")).where("x.slotted is not null").select(F.col("x.slotted").alias("template"), F.col("x.plain").alias("filled"))
    return pairs.groupBy("template").agg(F.countDistinct("filled").alias("n")).where(F.col("n") >= fillings).select("template")


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, line_no, template): the lines whose template stands on many pages of the site.

    A template counts once a page. It is repeated if it stands on ``min_pages``
    pages and on a share of ``min_share`` of all rows of the site, rows without
    text included. Lines are cut at line feeds and numbered from 1. Pages with
    a null domain belong to no site and give no rows; so do null and empty
    texts. A page row delivered twice counts twice and gives its lines twice.
    """
    scratch = Scratch(pages.sparkSession, "templates")
    parsed = scratch.keep(_parsed(pages.where("domain is not null")))
    totals = parsed.groupBy("site").agg(F.count(F.lit(1)).alias("rows"))
    # a line counts for its template with slots and for the one without: where the slots are no wildcards the first is dropped below
    each = parsed.select("site", F.explode(F.concat(F.transform(F.array_distinct("plain"), lambda x: F.struct(x.alias("template"), F.lit(False).alias("slots"))), F.transform(F.array_distinct("slotted"), lambda x: F.struct(x.alias("template"), F.lit(True).alias("slots"))))).alias("t"))
    counts = each.where("t.template is not null").groupBy("site", "t.template", "t.slots").agg(F.count(F.lit(1)).alias("pages"))
    # at most 1 / min_share times a page's mean number of lines remain for a site
    often = scratch.keep(counts.where(F.col("pages") >= min_pages).join(totals, "site").where(F.col("pages") >= F.col("rows") * F.lit(min_share)))
    wild = often.where("slots").join(merged_slots(parsed), "template", "left_semi")
    by_site = often.where("not slots").unionByName(wild).groupBy("site").agg(F.collect_set("template").alias("often"))
    lines = keyed_lookup(parsed, scratch.keep(by_site), ["site"], "inner")
    each_line = lines.select("page_id", "often", F.posexplode(F.arrays_zip("plain", "slotted")).alias("at", "t"))
    slotted = F.expr("t.slotted is not null and array_contains(often, t.slotted)")
    return each_line.select("page_id", (F.col("at") + 1).cast("int").alias("line_no"), F.when(slotted, F.col("t.slotted")).when(F.expr("array_contains(often, t.plain)"), F.col("t.plain")).alias("template")).where("template is not null")


def remove_repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` with the repeated lines taken out of ``extracted_text``; null texts stay null."""
    found = repeated_lines(pages, min_pages, min_share).groupBy(F.col("page_id").alias("__page")).agg(F.collect_set("line_no").alias("__lines"))
    kept = F.expr("array_join(transform(filter(transform(split(extracted_text, '\\n', -1), (x, i) -> struct(x as l, i + 1 as n)), s -> not array_contains(__lines, s.n)), s -> s.l), '\\n')")
    joined = pages.join(found, F.col("id").cast("long") == F.col("__page"), "left")
    return joined.withColumn("extracted_text", F.when(F.col("__lines").isNull(), F.col("extracted_text")).otherwise(kept)).drop("__page", "__lines")
