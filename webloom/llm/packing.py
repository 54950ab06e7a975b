"""Documents packed into containers of fixed capacity by the sum-of-squares rule.

A document goes where the sum, over the open levels, of the squared number of
containers at that level becomes smallest; this keeps the levels evenly filled,
so that a fitting gap is nearly always open. Shards are packed independently
and in parallel; the containers they leave unfilled are packed again as whole
items, over as many shards as these need, until they fit into one shard or
packing again fills no more of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.tokens import DEFAULT_TOKENIZER, broadcast_vocabulary, tokenizer
from webloom.session import Scratch

CAPACITY = 2048
#: Items packed in one task, about. A task holds two numbers of each.
SHARD_ITEMS = 200_000
#: Unfilled containers are packed again unless more than this share of a stage's items are left.
STILL = 0.9


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document; a null text has 0 tokens."""
    vocabulary = broadcast_vocabulary(documents.sparkSession, tokenizer_path)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = tokenizer(vocabulary)
        for batch in batches:
            n = [tok.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["doc_id", "n_tokens"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id bigint, n_tokens int")


def sum_of_squares(sizes, capacity: int):
    """The container of each size (0..capacity), as numbers from 0, and the containers' levels.

    Ties go to the fullest container. Size 0 joins the last container used.
    """
    import numpy as np

    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    levels: list[int] = []
    out = np.empty(len(sizes), dtype=np.int64)
    last = -1
    big = np.int64(1) << 40
    for i, s in enumerate(sizes):
        s = int(s)
        if s == 0:
            if last < 0:
                last = len(levels)
                levels.append(0)
                open_at[0].append(last)
            out[i] = last
            continue
        # levels 1..capacity-s: the squares fall by 2 n(h) - 1 and rise by 2 n(h+s) + 1, or by nothing if full
        change = 2 * (count[s + 1 :] - count[1 : capacity - s + 1]) + 2
        if len(change):
            change[-1] -= 1
            change[count[1 : capacity - s + 1] == 0] = big
            h = capacity - s - int(change[::-1].argmin())
            best = int(change[h - 1])
        else:
            best = big
        fresh = 2 * int(count[s]) + 1 if s < capacity else 0
        if best < fresh or (best == fresh and best < big):
            last = open_at[h].pop()
            count[h] -= 1
            level = h + s
            levels[last] = level
        else:
            last = open_at[0].pop() if open_at[0] else len(levels)
            if last == len(levels):
                levels.append(0)
            level = s
            levels[last] = level
        if level < capacity:
            open_at[level].append(last)
            count[level] += 1
        out[i] = last
    return out, levels


def _pack_shard(capacity: int, stage: int):
    def pack(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["item"], kind="stable")
        shard = int(pdf["shard"].iloc[0])
        bins, levels = sum_of_squares(pdf["size"].to_numpy(), capacity)
        level = pd.Series(levels)
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "container": [f"{stage}-{shard}-{b}" for b in bins], "level": level.to_numpy()[bins]})

    return pack


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = DEFAULT_TOKENIZER, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_id, doc_id, piece_no, start_token, n_tokens, container_tokens).

    Every document is placed once and whole, unless it has more than
    ``capacity`` tokens: it is then cut into pieces of ``capacity`` tokens, a
    container each, and a last piece that is packed like a document. Empty and
    null texts (0 tokens) are placed too, and need no room. Every row is placed,
    rows of a repeated or null id too. No documents give no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    # a row's own number tells repeated ids apart; it is fixed once written
    counts = scratch.keep(token_counts(documents, id_col, text_col, tokenizer_path).withColumn("row", F.monotonically_increasing_id()))
    last = F.when(F.col("n_tokens") > 0, F.ceil(F.col("n_tokens") / F.lit(capacity)) - 1).otherwise(0).cast("int")
    pieces = counts.select("row", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "row", "doc_id", "piece_no", (F.col("piece_no") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("size")
    )
    full = pieces.where(F.col("size") == capacity).select(
        F.concat(F.lit("full-"), "row", F.lit("-"), "piece_no").alias("container_id"), "doc_id", "piece_no", "start_token", F.col("size").alias("n_tokens"), F.col("size").alias("container_tokens")
    )
    small = pieces.where(F.col("size") < capacity).withColumn("item", F.col("row").cast("string"))

    items = small.select("item", "size")
    stages: list[DataFrame] = []
    before = small.count()
    shards = max(1, -(-before // shard_items))
    while True:
        stage = len(stages)
        keyed = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(stage)), F.lit(shards)).cast("int"))
        packed = scratch.keep(keyed.groupBy("shard").applyInPandas(_pack_shard(capacity, stage), "item string, container string, level int"))
        stages.append(packed)
        if shards == 1:
            break
        items = packed.where(F.col("level") < capacity).select(F.col("container").alias("item"), F.col("level").alias("size")).distinct()
        left = items.count()
        # packing again pays while it fills containers; every stage has as many shards as its items need
        if left > STILL * before:
            break
        before, shards = left, max(1, -(-left // shard_items))
    where = stages[0]
    for later in stages[1:]:
        nxt = later.select(F.col("item").alias("container"), F.col("container").alias("__to"), F.col("level").alias("__level"))
        where = where.join(nxt, "container", "left").select("item", F.coalesce("__to", "container").alias("container"), F.coalesce("__level", "level").alias("level"))
    packed = small.join(where, "item").select(
        F.col("container").alias("container_id"), "doc_id", "piece_no", "start_token", F.col("size").alias("n_tokens"), F.col("level").alias("container_tokens")
    )
    return full.unionByName(packed)
