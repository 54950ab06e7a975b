"""Keyword-stuffed and link-list pages, by robust Mahalanobis distance.

Each page's own text (its body's lines) is measured: how much of it stands in
sentences, its function words, entropy, repetition, links and outgoing links.
Per language a robust centre and scatter are fitted over all pages: medians
first, then concentration steps on the nearer half. Pages far from the centre
are outliers; those whose deviation points towards spam are flagged, unless
their text is residue.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.body import FORMAT, OWN, BodyModel, Line, distinct_of
from webloom.llm.furniture import kept, page_columns
from webloom.llm.residue import broadcast_models, residue_pages
from webloom.session import Scratch

# Frequent function words of the crawl's languages.
FUNCTION_WORDS = {
    "en": "the a an of and or to in on at by for from with without is are was were be been it its this that these those as when while if so before after once has have had can cannot must not no nothing why how who which there than then but both all each every one most only into later",
    "de": "der die das den dem des ein eine einen einem einer und oder zu im in an am auf aus bei mit ohne für von vor nach ist sind war werden wird wurde es sie er wir man wenn falls damit bevor nachdem dass sich nicht kein keine nur aber alle jede jeder jedes warum wie was auch um als so denn haben hat muss",
    "fr": "le la les l un une des du de d et ou à au aux en dans sur par pour avec sans est sont était il elle nous on que qui qu quand si ne pas se ce cette ces son sa ses leur leurs plus tout tous toutes avant après pourquoi comment chaque faut reste soit y",
    "es": "el la los las un una unos unas de del y o a al en con sin por para es son era está quedan se que quien cuando si no su sus lo le nos este esta estos estas más todo todos antes después cómo cada hay qué tocar rara listo",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY_FUNCTION = frozenset().union(*_FUNCTION.values())
_WORD = re.compile(r"[^\W\d_]+")
# Signs of code, and the slot of a value between words.
_MARKS = frozenset("=(){}$>;0.")
_URL = re.compile(r"https?://\S+|\bwww\.\S+")

#: Sign of each feature's deviation towards spam.
FEATURES = {"sentence_share": -1, "function_share": -1, "entropy": -1, "repetition": 1, "link_share": 1, "outlinks": 1}
#: Squared distance beyond which a page is an outlier: chi-squared, 6 degrees of freedom, 99.9 %.
CUTOFF = 22.46
#: Cosine between a page's deviation and the spam direction, and the largest share of own words in sentences that don't repeat, of a flagged page.
DIRECTION, MOST_SENTENCES = 0.45, 0.5
STEPS = 2
MIN_WORDS = 5

_MEASURED = "page_id bigint, lang string, words int, sentence_share double, function_share double, entropy double, repetition double, link_share double"


def language_of(words: list[str]) -> str:
    """The language with most different function words in the text; ties, as of texts without any, go to the first listed."""
    seen = set(words)
    return max(_FUNCTION, key=lambda k: len(_FUNCTION[k] & seen))


def is_code(tokens: list[str]) -> bool:
    """Whether a line's tokens are those of code, of a request or of a table's row: signs and values between the words."""
    marks = sum(map(_MARKS.__contains__, tokens))
    return marks > 0 and 3 * marks >= sum(map(str.isalpha, tokens))


def measures(own: list[Line], whole: str = "") -> tuple[str, int, float, float, float, float, float]:
    """Language, words, then the features of the page's own lines (but the outgoing links).

    Own words without any function word have the language of the ``whole`` text.
    """
    words: list[str] = []
    loose: list[str] = []
    total = sure = size = linked = 0
    for x in own:
        size += len(x.text) + 1
        total += x.words
        if "http" in x.text or "www." in x.text:
            bare = _URL.sub(" ", x.text)
            linked += len(x.text) - len(bare)
            found, code = _WORD.findall(bare.casefold()), False
        else:
            found = list(filter(str.isalpha, x.cuts[0]))
            code = not x.sentence and len(found) < len(x.cuts[0]) and is_code(x.cuts[0])
        words += found
        if not code:
            loose += found
        if x.sentence or code:
            sure += x.words
    n = len(words)
    lang = language_of(_WORD.findall(whole.casefold()) if _ANY_FUNCTION.isdisjoint(words) else words)
    entropy = 1 - sum([c * math.log(c) for c in Counter(words).values() if c > 1]) / (n * math.log(n)) if n > 1 else 1.0
    function = sum(map(_FUNCTION[lang].__contains__, loose)) / len(loose) if loose else 0.3 if n else 0.0
    repetition = 1 - len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0.0
    return lang, total, (sure / total if total else 1.0), function, entropy, repetition, linked / max(1, size)


#: Pages that are measured together.
TOGETHER = 500


def measures_many(pages: list[tuple], body: BodyModel) -> list[tuple[str, int, float, float, float, float, float]]:
    """``measures`` of the own lines of (domain, url, title, text) of many pages."""
    import numpy as np

    judged, held = body.judge_many(pages)
    names, n, size = held.names, len(pages), len(held.names)
    page = np.repeat(np.arange(n), np.fromiter(map(len, judged), np.int64, n))
    # lines by number: whether own, whether a sentence, and their words
    own = np.fromiter((x.kind == OWN for lines in judged for x in lines), bool, len(page))
    sentence = np.fromiter((x.sentence for lines in judged for x in lines), bool, len(page))
    counted = np.fromiter((x.words for lines in judged for x in lines), np.int64, len(page))
    letters = held.sums(held.alpha.astype(float))
    marks = held.sums(np.array([t in _MARKS for t in names], dtype=float))
    code = ~sentence & (letters < held.sizes) & (marks > 0) & (3 * marks >= letters)
    total = np.bincount(page[own], weights=counted[own], minlength=n)
    sure = np.bincount(page[own & (sentence | code)], weights=counted[own & (sentence | code)], minlength=n)
    # own words of the pages, in their order
    chosen = own[held.row] & held.alpha[held.tok]
    word, line = held.tok[chosen], held.row[chosen]
    at = page[line]
    words = np.bincount(at, minlength=n)
    is_function = np.array([[t in f for t in names] for f in _FUNCTION.values()])
    known = is_function.any(axis=0)[word]
    seen_at, seen = np.divmod(distinct_of(at[known] * size + word[known]), size)
    different = np.array([np.bincount(seen_at, weights=f[seen], minlength=n) for f in is_function])
    lang = different.argmax(axis=0)
    loose = ~code[line]
    spoken = np.bincount(at[loose], minlength=n)
    function = np.bincount(at[loose], weights=is_function[lang[at[loose]], word[loose]], minlength=n)
    keys = np.sort(at * size + word)
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1])))
    times = np.diff(begins, append=len(keys)).astype(float)
    spread = np.bincount(keys[begins] // size, weights=times * np.log(times), minlength=n)
    near = at[1:] == at[:-1]
    pairs = np.bincount(distinct_of((at[1:][near] * size + word[:-1][near]) * size + word[1:][near]) // (size * size), minlength=n)
    langs, told = list(_FUNCTION), different.any(axis=0).tolist()
    out = []
    for k, lines in enumerate(judged):
        text = pages[k][3]
        # links are cut out of their lines, and texts without own function words are read whole
        if not told[k] or "http" in text or "www." in text or not text.isascii() and FORMAT.search(text):
            mine = [x for x in lines if x.kind == OWN]
            for x in mine:
                a = held.begins[x.row]
                x.cuts = [names[t] for t in held.tok[a : a + held.sizes[x.row]].tolist()], x.cuts[1]
            out.append(measures(mine, text))
            continue
        w, t, s = int(words[k]), int(total[k]), int(spoken[k])
        entropy = 1 - float(spread[k]) / (w * math.log(w)) if w > 1 else 1.0
        out.append((langs[lang[k]], t, float(sure[k]) / t if t else 1.0, float(function[k]) / s if s else 0.3 if w else 0.0, entropy, 1 - int(pairs[k]) / (w - 1) if w > 1 else 0.0, 0.0))
    return out


def measure_pages(pages: DataFrame, models: Broadcast) -> DataFrame:
    """One row of ``_MEASURED`` per page with text."""

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        body, _ = kept(models)
        schema = pa.schema([("page_id", pa.int64()), ("lang", pa.string()), ("words", pa.int32()), *((f, pa.float64()) for f in list(FEATURES)[:5])])
        for batch in batches:
            rows = []
            pages_of = zip(*(c.to_pylist() for c in batch.columns))
            while part := list(islice(pages_of, TOGETHER)):
                rows += [(page, *told) for (page, *_), told in zip(part, measures_many([rest for _, *rest in part], body))]
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return page_columns(pages.where("extracted_text <> ''")).mapInArrow(measure, _MEASURED)


def outlinks(links: DataFrame) -> DataFrame:
    """(page_id, outlinks): log of the number of links of a page, counted before the shuffle."""
    return links.where("source_page_id is not null and target_normalized_url is not null").groupBy(F.col("source_page_id").cast("long").alias("page_id")).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("outlinks"))


#: Least spread of a feature, so that one that hardly varies doesn't decide alone.
FLOOR = 0.02
#: Median of chi-squared with as many degrees of freedom as there are features.
TYPICAL = 5.35

#: Squared distance of ``f`` from ``centre`` under the inverse scatter ``inverse``, row by row.
_DISTANCE = "aggregate(sequence(0, {n} * {n} - 1), 0D, (a, k) -> a + inverse[k] * (f[k div {n}] - centre[k div {n}]) * (f[k % {n}] - centre[k % {n}]))"


def _with_model(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with their language's centre and inverse scatter: a broadcast of one row per language."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, [float(x) for x in c], [float(x) for x in inv.ravel()]) for k, (c, inv) in sorted(model.items())], "lang string, centre array<double>, inverse array<double>")
    return rows.join(F.broadcast(table), "lang").withColumn("d", F.expr(_DISTANCE.format(n=len(FEATURES))))


def _fit(rows: DataFrame) -> dict:
    """Per language the robust centre and inverse scatter; some dozens of numbers a language reach the driver."""
    import numpy as np

    n = range(len(FEATURES))
    median = lambda c, name: F.percentile_approx(c, 0.5, 10_000).alias(name)
    centre = {r["lang"]: np.array([r[f"m{i}"] for i in n]) for r in rows.groupBy("lang").agg(*[median(F.col("f")[i], f"m{i}") for i in n]).collect()}
    table = rows.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in sorted(centre.items())], "lang string, centre array<double>")
    mads = rows.join(F.broadcast(table), "lang").groupBy("lang").agg(*[median(F.abs(F.col("f")[i] - F.col("centre")[i]), f"m{i}") for i in n]).collect()
    model = {r["lang"]: (centre[r["lang"]], np.diag(1 / np.maximum(FLOOR, 1.4826 * np.array([r[f"m{i}"] for i in n])) ** 2)) for r in mads}
    pairs = [(i, j) for i in n for j in n if i <= j]
    for _ in range(STEPS):
        far = _with_model(rows, model)
        half = far.groupBy("lang").agg(median("d", "half"))
        near = far.join(F.broadcast(half), "lang").where("d <= half")
        # the sums are partial per task: one row per language is shuffled
        sums = near.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("f")[i]).alias(f"s{i}") for i in n], *[F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
        model = {}
        for r in sums:
            mean = np.array([r[f"s{i}"] for i in n]) / r["n"]
            product = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in n] for i in n]) / r["n"]
            model[r["lang"]] = (mean, np.linalg.inv(product - np.outer(mean, mean) + np.diag(np.full(len(FEATURES), FLOOR**2))))
        # the nearer half is narrower than the whole: the median distance is made the normal one
        middle = {r[0]: r[1] for r in _with_model(rows, model).groupBy("lang").agg(median("d", "half")).collect()}
        model = {k: (c, inv * min(1.0, TYPICAL / middle[k]) if middle.get(k) else inv) for k, (c, inv) in model.items()}
    return model


def spam_pages(pages: DataFrame, links: DataFrame, cutoff: float = CUTOFF, direction: float = DIRECTION, most_sentences: float = MOST_SENTENCES) -> DataFrame:
    """(page_id, distance, direction): pages whose own text is keywords, tags or links.

    ``distance`` is the squared robust distance from the language's centre,
    ``direction`` the cosine of the deviation with the spam direction. Pages of
    residue, without text, or with fewer than ``MIN_WORDS`` own words are never
    flagged. Links with a null source are ignored; a page without links has
    none. One row per input row.
    """
    n = len(FEATURES)
    scratch = Scratch(pages.sparkSession, "spam")
    models = broadcast_models(pages)
    measured = measure_pages(pages, models).where(F.col("words") >= MIN_WORDS)
    # a page has one row on either side, so the join cannot gather anywhere
    rows = measured.join(outlinks(links), "page_id", "left").fillna(0.0, ["outlinks"])
    rows = scratch.keep(rows.select("page_id", "lang", F.array(*FEATURES).alias("f")))
    model = _fit(rows)
    if not model:
        return pages.sparkSession.createDataFrame([], "page_id bigint, distance double, direction double")
    signs = F.array(*[F.lit(float(x)) for x in FEATURES.values()])
    # deviations in units of each feature's own scatter
    scaled = F.expr(f"transform(sequence(0, {n} - 1), k -> (f[k] - centre[k]) * sqrt(inverse[k * {n} + k]))")
    judged = _with_model(rows, model).withColumn("z", scaled).withColumn("signs", signs)
    cosine = F.expr(f"aggregate(sequence(0, {n} - 1), 0D, (a, k) -> a + z[k] * signs[k]) / sqrt({n} * greatest(aggregate(z, 0D, (a, v) -> a + v * v), 1e-12))")
    judged = judged.withColumn("direction", cosine)
    flagged = (F.col("d") > cutoff) & (F.col("direction") > direction) & (F.col("f")[0] * (1 - F.col("f")[3]) <= most_sentences)
    found = scratch.keep(judged.where(flagged).select("page_id", F.col("d").alias("distance"), "direction"))
    # residue, which is no spam, is only looked for on the pages flagged
    few = pages.join(found.select(F.col("page_id").alias("__page")).distinct(), F.col("id").cast("long") == F.col("__page"), "left_semi")
    return found.join(residue_pages(few, models).select("page_id").distinct(), "page_id", "left_anti")
