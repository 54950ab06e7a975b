"""Corpus documents that hold passages of held-out items, by suffix arrays.

Each batch of documents is a shard. Its words are numbered by the items'
vocabulary; only stretches in which every pair of neighbouring words also
stands in an item can hold a passage, so the shard's suffix array is built over
those stretches alone. Every item suffix is then binary-searched in it: each
range of equal words gives the documents and the items it joins, and a suffix
automaton of the item, run over the document's stretches, gives the longest
verbatim match of each such pair.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 13
#: Items are searched in blocks of at most so many bytes of text, each broadcast.
BLOCK_BYTES = 16 << 20

_WORD = re.compile(r"[^\W_]+")

SCHEMA = "doc_id bigint, item_id bigint, match_words int, doc_word int, item_word int"


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, without letter case and accents."""
    if text.isascii():
        return _WORD.findall(text.lower())
    plain = unicodedata.normalize("NFD", text.casefold())
    return _WORD.findall("".join([c for c in plain if not unicodedata.combining(c)]) if not plain.isascii() else plain)


class _Numbering(dict):
    def __missing__(self, word: str) -> int:
        return 0


class ItemIndex:
    """The words of the items, numbered, with a separator 0 between items."""

    def __init__(self, items: list[tuple[int, str]], min_words: int) -> None:
        import numpy as np

        self.min_words = min_words
        self.numbers = _Numbering()
        flat, owner, place = [], [], []
        for item, text in items:
            words = words_of(text or "")
            if len(words) < min_words:
                continue
            for k, w in enumerate(words):
                flat.append(self.numbers.setdefault(w, len(self.numbers) + 1))
                owner.append(item)
                place.append(k)
            flat.append(0)
            owner.append(-1)
            place.append(-1)
        self.text = np.asarray(flat, dtype=np.int64)
        self.owner = np.asarray(owner, dtype=np.int64)
        self.place = np.asarray(place, dtype=np.int64)
        self.size = len(self.numbers) + 1
        both = (self.text[:-1] > 0) & (self.text[1:] > 0) if len(flat) > 1 else np.zeros(0, bool)
        pairs = self.text[:-1][both] * self.size + self.text[1:][both] if len(flat) > 1 else np.zeros(0, np.int64)
        self.pairs = np.unique(pairs)
        self._automata: dict[int, tuple[Automaton, list[int]]] = {}
        self.table = None
        if self.size * self.size <= 1 << 27:
            self.table = np.zeros(self.size * self.size, dtype=bool)
            self.table[self.pairs] = True

    def automaton(self, owner: int) -> tuple[Automaton, list[int]]:
        """The automaton of an item, and the places of its words; one is kept, as pairs come by item."""
        if owner not in self._automata:
            import numpy as np

            own = np.flatnonzero(self.owner == owner)
            # an id given twice has several texts, each for itself
            parts = np.split(own, np.flatnonzero(np.diff(own) != 1) + 1)
            self._automata = {owner: (Automaton([self.text[p].tolist() for p in parts]), self.place[own].tolist())}
        return self._automata[owner]

    def known_pair(self, codes):
        import numpy as np

        if self.table is not None:
            return self.table[codes]
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        return self.pairs[at] == codes


class Automaton:
    """All runs of words of one item: finds its longest run in other texts in time linear in these."""

    def __init__(self, parts: list[list[int]]) -> None:
        self.step, self.link, self.length, self.end = [{}], [-1], [0], [-1]
        at = 0
        for words in parts:
            last = 0
            for w in words:
                last = self._add(last, w, at)
                at += 1

    def _new(self, step: dict, link: int, length: int, end: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.step) - 1

    def _add(self, last: int, w: int, at: int) -> int:
        if w in self.step[last] and self.length[self.step[last][w]] == self.length[last] + 1:
            return self.step[last][w]
        state = self._new({}, 0, self.length[last] + 1, at)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            if self.length[q] == self.length[p] + 1:
                self.link[state] = q
            else:
                copy = self._new(dict(self.step[q]), self.link[q], self.length[p] + 1, self.end[q])
                while p >= 0 and self.step[p].get(w) == q:
                    self.step[p][w] = copy
                    p = self.link[p]
                self.link[q] = self.link[state] = copy
        return state

    def longest(self, text, stretches: list[tuple[int, int]]) -> tuple[int, int, int]:
        """(length, first place in ``text``, first place in the item) of the longest common run; the first of equal ones."""
        best = (0, -1, -1)
        for begin, end in stretches:
            state = size = 0
            for i, w in enumerate(text[begin:end].tolist(), begin):
                while state and w not in self.step[state]:
                    state = self.link[state]
                    size = self.length[state]
                if w in self.step[state]:
                    state = self.step[state][w]
                    size += 1
                if size > best[0]:
                    best = (size, i - size + 1, self.end[state] - size + 1)
        return best


def suffix_array(text):
    """Starts of all suffixes in order, by prefix doubling."""
    import numpy as np

    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    step = 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1 and step < n:
        second = np.full(n, -1, dtype=np.int64)
        second[:-step] = rank[step:]
        key = (rank.astype(np.int64) + 1) * (n + 2) + second + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank, step = new, step * 2
    return order


def _bounds(text, order, queries, width: int):
    """For each row of ``queries`` (word numbers), the range of suffixes that begin with it."""
    import numpy as np

    padded = np.concatenate([text, np.zeros(width, dtype=np.int64)])
    found = []
    for upper in (False, True):
        lo, hi = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(order), dtype=np.int64)
        while (active := lo < hi).any():
            mid = (lo + hi) >> 1
            at = order[np.minimum(mid, len(order) - 1)]
            seen = padded[at[:, None] + np.arange(width)]
            differs = seen != queries
            first = differs.argmax(1)
            row = np.arange(len(queries))
            less = differs.any(1) & (seen[row, first] < queries[row, first])
            go = less | (~differs.any(1) if upper else np.zeros(len(queries), dtype=bool))
            lo = np.where(active & go, mid + 1, lo)
            hi = np.where(active & ~go, mid, hi)
        found.append(lo)
    return found


def search_shard(texts: list[tuple[int, str]], index: ItemIndex) -> list[tuple[int, int, int, int, int]]:
    """(doc, item, length, doc_word, item_word) of the longest match of each document and item.

    Documents come as (place in the shard, text) and are returned by place.
    """
    import numpy as np

    m = index.min_words
    get = index.numbers.__getitem__
    arrays, lengths = [], []
    for _, text in texts:
        ids = np.fromiter(map(get, w), dtype=np.int64, count=len(w)) if (w := words_of(text)) else np.zeros(0, np.int64)
        arrays += [ids, np.zeros(1, np.int64)]
        lengths.append(len(ids) + 1)
    if not arrays or not len(index.text):
        return []
    text = np.concatenate(arrays)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    live = (text[:-1] > 0) & (text[1:] > 0)
    live[live] = index.known_pair(text[:-1][live] * index.size + text[1:][live])
    edge = np.diff(np.concatenate([[0], live.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - begin >= m - 1
    begin, end = begin[keep], end[keep] + 1  # words begin..end-1
    if not len(begin):
        return []
    where = np.concatenate([np.append(np.arange(a, b), -1) for a, b in zip(begin, end)])
    part = np.where(where >= 0, text[where], -np.arange(len(where)) - 1)  # no two separators are equal

    order = suffix_array(part)
    first = np.unique(part[:-1] * index.size + part[1:])
    t = index.text
    if len(t) < m:
        return []
    rows = np.lib.stride_tricks.sliding_window_view(t, m)
    codes = rows[:, 0] * index.size + rows[:, 1]
    at = np.minimum(np.searchsorted(first, codes), len(first) - 1)
    suffixes = np.flatnonzero((rows > 0).all(1) & (first[at] == codes))
    # equal beginnings are searched once; their ranges share no suffix, so all ranges together are no longer than the shard
    wordings, which = np.unique(rows[suffixes], axis=0, return_inverse=True)
    owners: dict[int, set[int]] = {}
    for k, owner in zip(which.ravel().tolist(), index.owner[suffixes].tolist()):
        owners.setdefault(k, set()).add(owner)
    document = np.searchsorted(starts, where, side="right") - 1
    stretches: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(begin.tolist(), end.tolist()):
        stretches.setdefault(int(np.searchsorted(starts, a, side="right") - 1), []).append((a, b))
    pairs: set[tuple[int, int]] = set()
    for k in range(0, len(wordings), 20_000):
        lo, hi = _bounds(part, order, wordings[k : k + 20_000], m)
        for i in np.flatnonzero(hi > lo).tolist():
            docs = np.unique(document[order[lo[i] : hi[i]]]).tolist()
            pairs.update((d, owner) for owner in owners[k + i] for d in docs)
    found = []
    for doc, owner in sorted(pairs, key=lambda p: (p[1], p[0])):
        automaton, places = index.automaton(owner)
        size, doc_at, item_at = automaton.longest(text, stretches[doc])
        found.append((texts[doc][0], owner, size, int(doc_at - starts[doc]), places[item_at]))
    return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for row in benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


_KEPT: dict[str, ItemIndex] = {}


def kept_index(name: str, block: list[tuple[int, str]], min_words: int) -> ItemIndex:
    """The index of a broadcast block; a Python worker builds it once and keeps it from task to task."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = ItemIndex(block, min_words)
    return _KEPT[name]


def find_leaks(documents: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, shard_chars: int = 8_000_000) -> DataFrame:
    """The longest match, of ``min_words`` words at least, of each document and item, as ``SCHEMA``.

    ``doc_word`` and ``item_word`` are the word positions, from 0, at which it
    begins. A passage that several items share is reported for each. Null or
    short texts match nothing; rows that repeat an id are all searched, and the
    longest match counts. The items are held-out sets of bounded size: they are
    broadcast in blocks of at most 16 MB, one pass over the corpus each.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= 2 * min_words - 1)
    result = None
    for block in _blocks(benchmark, "item_id", "text"):
        index = spark.sparkContext.broadcast((uuid.uuid4().hex, block, min_words))

        def search(batches: Iterator, index=index) -> Iterator:
            import pyarrow as pa

            built = kept_index(*index.value)

            def rows(ids, texts):
                found = search_shard(list(enumerate(texts)), built)
                columns = list(zip(*found)) if found else [[]] * 5
                columns[0] = [ids[d] for d in columns[0]]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()])], ["doc_id", "item_id", "match_words", "doc_word", "item_word"])

            ids, texts, held = [], [], 0
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids.append(doc)
                    texts.append(text.as_py())
                    held += len(texts[-1])
                    if held >= shard_chars:
                        yield rows(ids, texts)
                        ids, texts, held = [], [], 0
            if ids:
                yield rows(ids, texts)

        found = docs.mapInArrow(search, SCHEMA)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], SCHEMA)
    return result.groupBy("doc_id", "item_id").agg(F.max(F.struct("match_words", F.negative("doc_word").alias("d"), F.negative("item_word").alias("i"))).alias("m")).select(
        "doc_id", "item_id", "m.match_words", F.negative("m.d").alias("doc_word"), F.negative("m.i").alias("item_word")
    )


def remove_leaked(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents without any leak. Rows with a null id stay."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
