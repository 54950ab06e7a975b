"""Texts above a token limit cut into overlapping pieces at natural boundaries.

Agglomerative: the text is first cut at every sentence end, line end and
paragraph end (finer where a sentence alone is too long); adjacent segments
stand in a heap by the strength of the boundary between them, and the weakest
boundary is removed first as long as the joined segment, with the overlap it
will carry, stays within the limit. What is left are the pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.tokens import DEFAULT_TOKENIZER, ByteBpe, broadcast_vocabulary, tokenizer

LIMIT, OVERLAP = 2048, 128

#: Tokens left free in a piece: cut out of its text, it may be encoded in a few more tokens at its ends.
SLACK = 8

#: Boundary strengths.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 5, 4, 3, 2, 1, 0
NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", CLAUSE: "clause", WORD: "word", CHARACTER: "character"}

SCHEMA = "doc_id bigint, piece_no int, start_char int, end_char int, n_tokens int, overlap_tokens int, boundary string, text string"


def boundary_strengths(data: bytes, ends):
    """The strength of the boundary after each token; -1 where a character would be cut."""
    import numpy as np

    b = np.frombuffer(data, dtype=np.uint8)
    n = len(b)
    at = ends[:-1]  # boundaries inside the text
    left, right = b[at - 1], b[at]
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    strength = np.where((right & 0xC0) == 0x80, -1, CHARACTER)
    whole = strength >= 0
    strength[whole & (space[right] | space[left])] = WORD

    def before(k):
        return np.where(at - k >= 0, b[np.maximum(at - k, 0)], 0)

    quote = np.isin(left, list(b"\"')]}"))
    mark = np.where(quote, before(2), left)
    follows = space[right] | space[left]
    strength[whole & follows & np.isin(mark, list(b",;:"))] = CLAUSE
    strength[whole & follows & np.isin(mark, list(b".!?"))] = SENTENCE
    # the ideographic comma, full stop, exclamation and question mark
    three = (before(3).astype(np.int64) << 16) | (before(2).astype(np.int64) << 8) | left
    strength[whole & np.isin(three, [0xE38081, 0xEFBC8C])] = CLAUSE
    strength[whole & np.isin(three, [0xE38082, 0xEFBC81, 0xEFBC9F])] = SENTENCE
    # a run of white space with line ends: the cut comes after it
    newlines = np.concatenate([[0], np.cumsum(b == 10)])
    text_before = np.maximum.accumulate(np.where(space[b], -1, np.arange(n))) if n else np.zeros(0)
    ended = newlines[at] - newlines[text_before[at - 1] + 1]
    after_break = whole & (ended >= 1) & ~space[right]
    strength[after_break] = np.where(ended[after_break] >= 2, PARAGRAPH, LINE)
    return strength


def merge_segments(cuts: list[tuple[int, int]], n: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Segments between cuts (token, strength) merged, weakest boundary first.

    Gives (start, end, strength of the boundary before it). All but the first
    segment leave room for the overlap.
    """
    starts = [0, *(c for c, _ in cuts)]
    ends = [*(c for c, _ in cuts), n]
    strength = [PARAGRAPH, *(s for _, s in cuts)]
    k = len(starts)
    nxt = list(range(1, k + 1))
    prv = list(range(-1, k - 1))
    alive = [True] * k
    heap = [(strength[i + 1], ends[i + 1] - starts[i], i, i + 1, ends[i + 1]) for i in range(k - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j, end = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or nxt[i] != j or ends[j] != end or end - starts[i] != size:
            continue
        if size > (limit if starts[i] == 0 else limit - overlap):
            continue  # both only grow: this boundary stays
        ends[i], alive[j], nxt[i] = end, False, nxt[j]
        if nxt[j] < k:
            prv[nxt[j]] = i
            q = nxt[i]
            heapq.heappush(heap, (strength[q], ends[q] - starts[i], i, q, ends[q]))
        if (p := prv[i]) >= 0:
            heapq.heappush(heap, (strength[i], ends[i] - starts[p], p, i, ends[i]))
    return [(starts[i], ends[i], strength[i]) for i in range(k) if alive[i]]


def split_text(text: str, tok: ByteBpe, limit: int, overlap: int) -> list[tuple]:
    """Rows of ``SCHEMA`` without the id; empty if the text is within the limit."""
    import numpy as np

    ids = np.asarray(tok.encode(text), dtype=np.int64)
    n = len(ids)
    if n <= limit:
        return []
    data = text.encode("utf-8", "replace")
    ends = np.cumsum(tok.byte_lengths[ids])
    strength = boundary_strengths(data, ends)  # of the cut before token i + 1
    room = limit - overlap - SLACK
    chosen = np.flatnonzero(strength >= SENTENCE) + 1
    for level in (CLAUSE, WORD, CHARACTER):
        edges = np.concatenate([[0], chosen, [n]])
        long = np.flatnonzero(np.diff(edges) > room)
        if not len(long):
            break
        extra = [(edges[i] + np.flatnonzero(strength[edges[i] : edges[i + 1] - 1] >= level) + 1) for i in long]
        chosen = np.unique(np.concatenate([chosen, *extra]))
    pieces = merge_segments([(int(c), int(strength[c - 1])) for c in chosen], n, limit - SLACK, overlap)

    whole = np.concatenate([[True], strength >= 0, [True]])  # token positions at which a character begins
    offset = np.concatenate([[0], ends])
    rows = []
    work = [(s, e, b) for s, e, b in reversed(pieces)]
    while work:
        s, e, b = work.pop()
        begin = max(0, s - overlap)
        while begin > 0 and not whole[begin]:
            begin -= 1
        while True:
            if e - begin <= limit:
                piece = data[offset[begin] : offset[e]].decode("utf-8")
                size = tok.count(piece)
                if size <= limit:
                    break
            if begin < s:
                begin += 1
                while not whole[begin]:
                    begin += 1
            else:
                middle = next(m for d in range(e - s) for m in ((s + e) // 2 + d, (s + e) // 2 - d) if s < m < e and whole[m])
                work += [(middle, e, max(0, int(strength[middle - 1]))), (s, middle, b)]
                piece = None
                break
        if piece is None:
            continue
        start_char = len(data[: offset[begin]].decode("utf-8"))
        rows.append((len(rows), start_char, start_char + len(piece), size, s - begin, NAMES[b] if rows else "start", piece))
    return rows


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Ordered pieces of each text above ``limit`` tokens, as ``SCHEMA``.

    ``boundary`` is the kind of boundary at which the piece's own part begins;
    ``overlap_tokens`` before it repeat the end of the preceding piece. A piece
    never cuts a character and never has more than ``limit`` tokens. Texts
    within the limit, empty and null ones give no rows; equal rows give equal
    pieces, once each. Byte-level vocabularies only: their tokens have at least
    a byte each, so shorter texts are not even sent to Python.
    """
    if not tokenizer_path.endswith(".tiktoken"):
        raise ValueError("splitting needs a byte-level vocabulary (.tiktoken)")
    if limit < 4 * SLACK or not 0 <= overlap <= limit // 2:
        raise ValueError("the limit must be 32 at least, the overlap at most half of it")
    vocabulary = broadcast_vocabulary(documents.sparkSession, tokenizer_path)

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = tokenizer(vocabulary)
        schema = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("n_tokens", pa.int32()), ("overlap_tokens", pa.int32()), ("boundary", pa.string()), ("text", pa.string())])
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(doc, *r) for r in split_text(text.as_py(), tok, limit, overlap)]
                if (held := sum(len(r[7]) for r in rows[-64:]) + held) > 1 << 25:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    long = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") > limit)
    return long.mapInArrow(split, SCHEMA)
