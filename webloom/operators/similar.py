"""The most similar pages of each page, exactly, without a table of pairs.

All pairs of a job may be similar, so pairs are scored in memory, a block of
sources against a slice of targets at a time, and only the best of each source
are kept. Terms of many pages are multiplied as dense matrices, the others by
their postings. A small job is one task's work. The pages of a larger one are
numbered and packed, its sources cut into blocks, and each block meets all
pages of the job as a stream: no task holds more than a block and a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import Scratch

#: Jobs of more pages or terms are worked on in blocks of their sources; blocks and slices hold about so many at most.
SMALL_PAGES, SMALL_TERMS = 2_000, 1_000_000
BLOCK_PAGES, BLOCK_TERMS, SLICE_PAGES, SLICE_TERMS = 8_192, 4_000_000, 512, 200_000
#: So many blocks are made of a larger job at least, for as many tasks.
LEAST_BLOCKS = 8
#: Terms of this share of a job's pages are multiplied as dense columns, so many of them at most.
DENSE_SHARE, DENSE_TERMS = 1 / 16, 2_048
#: Terms of one row of a large job's vocabulary; products added at once.
CHUNK_TERMS, ADDED = 10_000, 2_000_000
#: By how much a matrix product may differ from the sum that is kept.
CLOSE = 1e-9

RESULT = "crawl_job_id bigint, source_page_id bigint, target_page_id bigint, score double, shared_terms array<string>"


class Vocabulary:
    """A job's terms in the order of their spelling, with their weights per occurrence and first pages."""

    def __init__(self, terms, df, first, n: int) -> None:
        import numpy as np

        self.terms, self.df, self.first = terms, df, first
        self.idf = np.log((n + 1) / (df + 1))
        often = np.flatnonzero((df >= max(2, DENSE_SHARE * n)) & (df < n))
        often = np.sort(often[np.argsort(-df[often], kind="stable")[:DENSE_TERMS]])
        self.column = np.full(len(df), -1, dtype=np.int32)
        self.column[often] = np.arange(len(often))
        self.columns = len(often)


class Vectors:
    """Pages with their terms: page i has ``ids[ptr[i]:ptr[i + 1]]``, in order, and weights of a norm of 1."""

    def __init__(self, words: Vocabulary, pages, ptr, ids, tf) -> None:
        import numpy as np

        self.pages, self.ptr, self.ids = pages, ptr, ids
        self.row = np.repeat(np.arange(len(pages)), np.diff(ptr))
        w = tf * words.idf[ids]
        norm = np.sqrt(np.bincount(self.row, weights=w * w, minlength=len(pages)))
        self.w = w / np.where(norm > 0, norm, 1.0)[self.row]
        self.raw = w

    def dense(self, words: Vocabulary):
        import numpy as np

        out = np.zeros((len(self.pages), words.columns))
        column = words.column[self.ids]
        held = column >= 0
        out[self.row[held], column[held]] = self.w[held]
        return out


class Best:
    """The best targets so far of each source of a block."""

    def __init__(self, words: Vocabulary, sources: Vectors, least: float, top: int, important: int, shown: int) -> None:
        import numpy as np

        self.words, self.sources, self.least, self.top, self.shown = words, sources, least, top, shown
        n, size = len(sources.pages), len(words.df)
        # heaviest terms first; ties go to the term that came first, then by spelling
        order = np.lexsort((sources.ids, words.first[sources.ids], -sources.raw, sources.row))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order)) - sources.ptr[sources.row[order]]
        self.important = (place < important) & (sources.w > 0)
        self.matrix = sources.dense(words)
        rare = np.flatnonzero((words.column[sources.ids] < 0) & (sources.w > 0))
        rare = rare[np.argsort(sources.ids[rare], kind="stable")]
        self.rare_row, self.rare_w = sources.row[rare], sources.w[rare]
        self.rare_ptr = np.searchsorted(sources.ids[rare], np.arange(size + 1))
        self.at = {int(p): i for i, p in enumerate(sources.pages)}
        self.limit = np.full(n, float(least))
        self.kept: list[list[tuple]] = [[] for _ in range(n)]
        # of the source looked at: weights, important terms, terms
        self.weight, self.heavy, self.has = np.zeros(size), np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)

    def meet(self, t: Vectors) -> None:
        """Scores all pairs with the targets of a slice and keeps the best."""
        import numpy as np

        n, m = len(self.sources.pages), len(t.pages)
        scores = self.matrix @ t.dense(self.words).T
        flat = scores.reshape(-1)
        rare = np.flatnonzero((self.words.column[t.ids] < 0) & (t.w > 0))
        begin, count = self.rare_ptr[t.ids[rare]], self.rare_ptr[t.ids[rare] + 1] - self.rare_ptr[t.ids[rare]]
        rare, begin, count = rare[count > 0], begin[count > 0], count[count > 0]
        ends = np.cumsum(count)
        a = 0
        while a < len(rare):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ADDED, side="right")))
            c = count[a:b]
            where = np.repeat(begin[a:b] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            np.add.at(flat, self.rare_row[where] * m + np.repeat(t.row[rare[a:b]], c), self.rare_w[where] * np.repeat(t.w[rare[a:b]], c))
            a = b
        for j, page in enumerate(t.pages.tolist()):
            if (i := self.at.get(page)) is not None:
                scores[i, j] = -1.0
        hit = scores >= (self.limit - CLOSE)[:, None]
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            found = np.flatnonzero(hit[i])
            self._open(i)
            few = 4 * self.top
            if len(found) > 2 * few:
                close = scores[i, found]
                part = np.argpartition(-close, few - 1)[:few]
                got = self._exact(t, found[part])
                # what is left out scores less than each of these: if enough of them count, it can't come in
                if len(got) >= self.top and sorted((g[0] for g in got), reverse=True)[self.top - 1] > close[part].min() + CLOSE:
                    self._add(i, t, got)
                    self._close(i)
                    continue
            self._add(i, t, self._exact(t, found))
            self._close(i)

    def _terms(self, i: int) -> slice:
        return slice(self.sources.ptr[i], self.sources.ptr[i + 1])

    def _open(self, i: int) -> None:
        part = self._terms(i)
        ids = self.sources.ids[part]
        self.weight[ids], self.heavy[ids], self.has[ids] = self.sources.w[part], self.important[part], True

    def _close(self, i: int) -> None:
        ids = self.sources.ids[self._terms(i)]
        self.weight[ids], self.heavy[ids], self.has[ids] = 0.0, False, False

    def _exact(self, t: Vectors, found) -> list[tuple]:
        """(score, page, place in the slice) of targets that count; equal vectors have equal scores, however they were multiplied."""
        import numpy as np

        begin, size = t.ptr[found], t.ptr[found + 1] - t.ptr[found]
        offsets = np.cumsum(size) - size
        where = np.repeat(begin - offsets, size) + np.arange(int(size.sum()))
        ids = t.ids[where]
        score = np.add.reduceat(self.weight[ids] * t.w[where], offsets)
        good = np.logical_or.reduceat(self.heavy[ids], offsets) & (score >= self.least)
        return list(zip(score[good].tolist(), t.pages[found[good]].tolist(), found[good].tolist()))

    def _add(self, i: int, t: Vectors, got: list[tuple]) -> None:
        best = sorted([*self.kept[i], *got], key=lambda g: (-g[0], g[1]))[: self.top]
        for k, g in enumerate(best):
            if isinstance(g[2], int):
                ids = t.ids[t.ptr[g[2]] : t.ptr[g[2] + 1]]
                best[k] = (g[0], g[1], ids[self.has[ids]][: self.shown])
        self.kept[i] = best
        if len(best) == self.top:
            self.limit[i] = max(self.least, best[-1][0])

    def result(self, job: int):
        """The rows of the block; none if nothing was found."""
        import numpy as np
        import pyarrow as pa

        rows = [(int(p), *g) for p, kept in zip(self.sources.pages.tolist(), self.kept) for g in kept]
        for at in range(0, len(rows), 5_000):
            part = rows[at : at + 5_000]
            ends = np.cumsum([0, *(len(r[3]) for r in part)]).astype(np.int32)
            terms = self.words.terms.take(pa.array(np.concatenate([r[3] for r in part])))
            columns = [pa.array([job] * len(part), pa.int64()), *(pa.array([r[k] for r in part], kind) for k, kind in ((0, pa.int64()), (2, pa.int64()), (1, pa.float64()))), pa.ListArray.from_arrays(pa.array(ends), terms)]
            yield pa.RecordBatch.from_arrays(columns, ["crawl_job_id", "source_page_id", "target_page_id", "score", "shared_terms"])


def _slices(ptr) -> Iterator[tuple[int, int]]:
    """Consecutive pages of a slice."""
    import numpy as np

    a, n = 0, len(ptr) - 1
    while a < n:
        b = max(a + 1, min(a + SLICE_PAGES, int(np.searchsorted(ptr, ptr[a] + SLICE_TERMS, side="right")) - 1))
        yield a, b
        a = b


def _meet(best: Best, words: Vocabulary, pages, ptr, ids, tf) -> None:
    for a, b in _slices(ptr):
        best.meet(Vectors(words, pages[a:b], ptr[a : b + 1] - ptr[a], ids[ptr[a] : ptr[b]], tf[ptr[a] : ptr[b]]))


def _runs(batches: Iterator, keys: list[str]) -> Iterator[tuple]:
    """(keys' values, batch): the batches, sorted by keys, cut where a key changes."""
    import numpy as np

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _whole_jobs(make: Callable) -> Callable:
    """For pages sorted by job, with their terms joined by spaces: each job is numbered, packed and scored by itself."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def job_rows(job, held):
            table = pa.Table.from_batches(held).combine_chunks()
            if table.num_rows < 2:
                return
            by_page = np.argsort(table.column("page_id").to_numpy())
            pages = table.column("page_id").to_numpy()[by_page]
            words = [pc.split_pattern(c, " ") for c in table.column("text").take(pa.array(by_page)).chunks]
            row = np.repeat(np.arange(len(pages)), np.concatenate([np.diff(w.offsets.to_numpy()) for w in words]))
            coded = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order))
            met, tf = np.unique(row * len(order) + number[coded.indices.to_numpy()], return_counts=True)
            row, ids = met // len(order), met % len(order)
            page = pages[row]
            first = np.full(len(order), np.iinfo(np.int64).max)
            np.minimum.at(first, ids, page)
            words = Vocabulary(coded.dictionary.take(pa.array(order)), np.bincount(ids, minlength=len(order)), first, len(pages))
            ptr = np.searchsorted(row, np.arange(len(pages) + 1))
            best = make(words, Vectors(words, pages, ptr, ids, tf))
            _meet(best, words, pages, ptr, ids, tf)
            yield from best.result(job)

        now, held = None, []
        for (job,), part in _runs(batches, ["crawl_job_id"]):
            if job != now and held:
                yield from job_rows(now, held)
                held = []
            now = job
            held.append(part)
        if held:
            yield from job_rows(now, held)

    return run


def _blocks(make: Callable) -> Callable:
    """For rows sorted by job, block and kind: the vocabulary (0), the block's pages (1), all pages of the job (2)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def packed(parts):
            pages = np.concatenate([p.column("page_id").to_numpy() for p in parts])
            sizes = np.concatenate([np.diff(p.column("ids").offsets.to_numpy()) for p in parts])
            ids, tf = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]) for c in ("ids", "tfs"))
            return pages, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), ids, tf

        def opened(held):
            vocabulary = held[0]
            numbers = [p.column(c).flatten().to_numpy() for c in ("ids", "firsts") for p in vocabulary]
            df, first = np.concatenate(numbers[: len(vocabulary)]), np.concatenate(numbers[len(vocabulary) :])
            words = Vocabulary(pa.concat_arrays([p.column("terms").flatten() for p in vocabulary]), df, first, int(vocabulary[0].column("n")[0].as_py()))
            return words, make(words, Vectors(words, *packed(held[1])))

        now, held, words, best = None, {}, None, None
        for (job, block, kind), part in _runs(batches, ["crawl_job_id", "block", "kind"]):
            if (job, block) != now:
                if best:
                    yield from best.result(now[0])
                now, held, best = (job, block), {}, None
            if kind < 2:
                held.setdefault(kind, []).append(part)
            elif 1 in held or best:
                if not best:
                    words, best = opened(held)
                    held = {}
                _meet(best, words, *packed([part]))
        if best:
            yield from best.result(now[0])

    return run


def best_pairs(texts: DataFrame, least: float, top: int, important: int, shown: int, small_pages: int = SMALL_PAGES, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """(crawl_job_id, source_page_id, target_page_id, score, shared_terms): each page's ``top`` targets by cosine, ties by id.

    ``texts`` are an index' pages with their terms. A target counts from a score
    of ``least`` on, if it has one of the source's ``important`` heaviest terms;
    of the terms shared the first ``shown`` are told.
    """
    spark = texts.sparkSession
    rows = texts.where("token_count > 0 and crawl_job_id is not null and page_id is not null").select(F.col("crawl_job_id").cast("long").alias("crawl_job_id"), F.col("page_id").cast("long").alias("page_id"), "token_count", "terms")
    sizes = rows.groupBy("crawl_job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("m"))
    large = sizes.where((F.col("n") > small_pages) | (F.col("m") > SMALL_TERMS))
    scratch = Scratch(spark, "similar")
    # few: each holds more than a small job's pages or terms
    large = F.broadcast(scratch.keep(large.withColumn("blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / block_pages), F.ceil(F.col("m") / BLOCK_TERMS)).cast("int"))))
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def make(words, sources):
        return Best(words, sources, least, top, important, shown)

    small = rows.join(large.select("crawl_job_id"), "crawl_job_id", "left_anti").select("crawl_job_id", "page_id", F.array_join("terms", " ").alias("text"))
    whole = small.repartition(tasks, "crawl_job_id").sortWithinPartitions("crawl_job_id").mapInArrow(_whole_jobs(make), RESULT)

    hot = rows.join(large.select("crawl_job_id"), "crawl_job_id").select("crawl_job_id", "page_id", F.explode("terms").alias("term")).groupBy("crawl_job_id", "page_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    hot = scratch.keep(hot)
    spelled = Window.partitionBy("crawl_job_id").orderBy("term")
    words = scratch.keep(hot.groupBy("crawl_job_id", "term").agg(F.count(F.lit(1)).cast("int").alias("df"), F.min("page_id").alias("first")).withColumn("id", (F.row_number().over(spelled) - 1).cast("int")))
    numbered = hot.hint("merge").join(words.select("crawl_job_id", "term", "id").hint("merge"), ["crawl_job_id", "term"])
    pages = scratch.keep(numbered.groupBy("crawl_job_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("id", "tf"))).alias("v")).select("crawl_job_id", "page_id", F.col("v.id").alias("ids"), F.col("v.tf").alias("tfs")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    chunks = words.groupBy("crawl_job_id", F.floor(F.col("id") / CHUNK_TERMS).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("id", "df", "first", "term"))).alias("v")).join(large, "crawl_job_id")
    told = chunks.select("crawl_job_id", every, F.lit(0).alias("kind"), "page_id", "n", F.col("v.df").alias("ids"), none("array<int>", "tfs"), F.col("v.first").alias("firsts"), F.col("v.term").alias("terms"))
    placed = pages.join(large, "crawl_job_id")
    vector = ["page_id", "n", "ids", "tfs", none("array<bigint>", "firsts"), none("array<string>", "terms")]
    own = placed.select("crawl_job_id", F.pmod(F.xxhash64("page_id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), *vector)
    met = placed.select("crawl_job_id", every, F.lit(2).alias("kind"), *vector)
    sorted_rows = told.unionByName(own).unionByName(met).repartition(tasks, "crawl_job_id", "block").sortWithinPartitions("crawl_job_id", "block", "kind", "page_id")
    return whole.unionByName(sorted_rows.mapInArrow(_blocks(make), RESULT))
