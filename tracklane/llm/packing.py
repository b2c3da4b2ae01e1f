"""Texts into containers of fixed capacity (problem 8).

Lengths in tokens are planned, not texts: the histogram of lengths, which has no
more rows than the capacity has tokens, is packed best fit in falling length, all
texts of a length at a time, so the plan is a short list of slot ranges. Texts then
take the planned slots by their rank within their length, a join on (length, rank).
Only texts longer than a container are cut, into full containers and a rest that
is planned like any other item.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.operators.positions import with_positions
from tracklane.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PLAN = "n int, rank_from long, rank_to long, per_bin long, first_bin long, at int"


@dataclass(frozen=True)
class PackConfig:
    capacity: int = 2048
    vocabulary: str = VOCABULARY
    rank_block: int = 500_000  # texts of one length numbered in one task
    broadcast_rows: int = 100_000  # of the plan; a longer one is joined by length and stretch of ranks


def encoder(vocabulary: str):
    """The byte-level BPE in a rank file (tiktoken's format)."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary)
    for b in batches:
        n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n"])


def token_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n): tokens of each text; 0 for a null or empty one."""
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(
        partial(_count, vocabulary=vocabulary), "id bigint, n bigint"
    )


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit in falling length over counts: rows of PLAN.

    Row (n, rank_from, rank_to, per_bin, first_bin, at): the items of length n with
    ranks in the range go, ``per_bin`` to each, into the bins from ``first_bin`` on,
    one after another from offset ``at``. Open bins are kept as ranges of bins with
    the same room left.
    """
    plan, room, free, bins = [], [], {}, 0  # room: sorted distinct rooms; free: room -> ranges (first, count)

    def leave(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in free:
                insort(room, left)
                free[left] = []
            free[left].append((first, count))

    for n in sorted(histogram, reverse=True):
        todo, rank = histogram[n], 0
        while todo:
            i = bisect_left(room, n)
            if i < len(room):
                r = room[i]
                first, count = free[r].pop()
                if not free[r]:
                    del free[r], room[i]
            else:
                r, first, count = capacity, bins, -(-todo // (capacity // n))
                bins += count
            k = r // n
            full = min(count, todo // k)
            if full:
                plan.append((n, rank, rank + full * k, k, first, capacity - r))
                leave(r - k * n, first, full)
                rank, todo, first, count = rank + full * k, todo - full * k, first + full, count - full
            if todo and count:  # fewer than k items are left: one more bin takes them
                plan.append((n, rank, rank + todo, todo, first, capacity - r))
                leave(r - todo * n, first, 1)
                todo, first, count = 0, first + 1, count - 1
            leave(r, first, count)
    return plan


def pack(docs: DataFrame, doc_id: str, text: str, cfg: PackConfig = PackConfig()) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container, offset) of every piece of every text.

    A text of up to ``capacity`` tokens is one piece 0; a longer one is cut every
    ``capacity`` tokens. A text without tokens (null or empty) takes no room: one row
    with n_tokens 0 and a null container. Repeated texts, and rows repeated under an
    id, are packed each. No rows give no containers. Other columns are ignored.
    """
    spark, cap = docs.sparkSession, cfg.capacity
    counts = cut(token_counts(docs, doc_id, text, cfg.vocabulary))
    whole = F.greatest(F.ceil(F.col("n") / cap), F.lit(1))
    items = counts.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)))
    items = items.select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * cap).alias("start_token"), F.least(F.col("n") - F.col("piece") * cap, F.lit(cap)).cast("int").alias("n"))
    # bounded: one row per length up to the capacity
    histogram = {r["n"]: r["count"] for r in items.filter("n > 0").groupBy("n").count().collect()}
    plan = plan_bins(histogram, cap)
    parts = max(histogram.values(), default=1) // cfg.rank_block + 1
    ranked = with_positions(items.filter("n > 0"), ["n"], ["id", "piece"], F.pmod(F.xxhash64("id", "piece"), F.lit(parts)), "rank")
    slots = spark.createDataFrame(plan, PLAN).withColumnRenamed("n", "length")
    inside = (F.col("n") == F.col("length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    if len(plan) <= cfg.broadcast_rows:
        slots = F.broadcast(slots)
    else:  # a frequent length is split by stretches of ranks, so it never meets in one task
        stretch = lambda r: F.floor(r / cfg.rank_block)
        slots = slots.withColumn("stretch", F.explode(F.sequence(stretch(F.col("rank_from")), stretch(F.col("rank_to") - 1))))
        inside = inside & (stretch(F.col("rank")) == F.col("stretch"))
    nth = F.col("rank") - F.col("rank_from")
    placed = ranked.join(slots, inside).select(
        F.col("id").alias(doc_id),
        "piece",
        "start_token",
        F.col("n").alias("n_tokens"),
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).alias("container"),
        (F.col("at") + nth % F.col("per_bin") * F.col("n")).cast("int").alias("offset"),
    )
    empty = items.filter("n = 0").select(
        F.col("id").alias(doc_id), "piece", "start_token", F.col("n").alias("n_tokens"), F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("offset")
    )
    return placed.unionByName(empty)
