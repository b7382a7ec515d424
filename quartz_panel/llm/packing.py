"""Packing into length buckets that minimise padding, and token-budget batches inside each bucket.

The histogram of all lengths (at most ``longest`` + 1 rows, whatever the input) comes to the driver,
where dynamic programming chooses the bucket boundaries of least total padding.  Sequences longer
than ``longest`` are cut into pieces of that length and a rest, so no token is lost.  Batches form
inside shards of a bucket; the number of shards follows the bucket's count, so no task gets more
than about ``shard_rows`` rows of one bucket and no window spans a whole bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .quality import words_of
from .store import written


def word_count(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit(""))))


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over positive lengths with the least padding in all.

    least[k][i]: padding of the lengths up to the i-th in k buckets; of equal costs the shortest last bucket wins."""
    pairs = sorted((n, c) for n, c in zip(lengths, counts, strict=True) if n > 0 and c > 0)
    if not pairs:
        return []
    size, many = np.array(pairs, np.int64).T
    rows, tokens = np.concatenate([[0], np.cumsum(many)]), np.concatenate([[0], np.cumsum(size * many)])
    m = len(size)
    least, back = np.full(m + 1, np.inf), []
    least[0] = 0
    for _ in range(min(buckets, m)):
        new, came = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0
        for i in range(1, m + 1):
            cost = least[:i] + size[i - 1] * (rows[i] - rows[:i]) - (tokens[i] - tokens[:i])
            came[i] = i - 1 - int(np.argmin(cost[::-1]))
            new[i] = cost[came[i]]
        least = new
        back.append(came)
    out, i = [], m
    for came in reversed(back):
        if not i:
            break
        out.append(int(size[i - 1]))
        i = int(came[i])
    return out[::-1]


def packed(docs: DataFrame, length=word_count, buckets: int = 16, longest: int = 2048, token_budget: int = 65_536, shard_rows: int = 50_000) -> DataFrame:
    """doc_id, piece, start (in tokens), n_tokens, bucket, bucket_len, padding, batch, slot: a row for each piece.

    ``length`` gives a text's tokens; ``longest`` bounds the length of a piece and so the histogram.
    A batch holds token_budget // bucket_len pieces, one at least.  Texts without a token (null, empty)
    have one row with n_tokens 0 and null bucket, bucket_len, padding, batch and slot.  Repeated rows
    are packed like others.  An empty table gives an empty result; other columns are ignored.
    """
    lengths = written(docs.select("doc_id", length(F.col("text")).cast("long").alias("n")), "lengths")
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("int")
    pieces = lengths.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(longest)).alias("n_tokens"))
    histogram = pieces.groupBy("n_tokens").count().collect()
    bounds = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    many = [sum(r[1] for r in histogram if low < r[0] <= high) for low, high in zip([0, *bounds], bounds, strict=False)]
    bound_list = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<int>")
    shards = F.array(*(F.lit(max(1, -(-n // shard_rows))) for n in many)) if bounds else F.array().cast("array<int>")
    real = F.col("n_tokens") > 0
    pieces = pieces.withColumn("bucket", F.when(real, F.size(F.filter(bound_list, lambda b: b < F.col("n_tokens")))))
    pieces = pieces.withColumn("bucket_len", F.get(bound_list, F.col("bucket")))
    spread = F.xxhash64("doc_id", "piece")
    pieces = pieces.withColumn("shard", F.when(real, F.pmod(spread, F.get(shards, F.col("bucket")))).otherwise(-1 - F.pmod(spread, F.lit(1024))))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece")) - 1
    pieces = pieces.withColumn("rank", rank)
    each = F.greatest(F.floor(F.lit(token_budget) / F.col("bucket_len")), F.lit(1)).cast("int")
    return pieces.select(
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        "bucket",
        "bucket_len",
        (F.col("bucket_len") - F.when(real, F.col("n_tokens"))).cast("long").alias("padding"),
        F.when(real, F.concat_ws("-", "bucket", "shard", F.floor(F.col("rank") / each))).alias("batch"),
        F.when(real, F.pmod("rank", each)).alias("slot"),
    )
