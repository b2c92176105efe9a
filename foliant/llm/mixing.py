"""Mixing sources to target weights.

The words of a source's documents, in a pseudorandom order of the documents, are one row of words, packed into blocks
of ``block_words``. Sources share the total by weight, no source taking more than ``most_times`` its own words. The
output is made of shards of slots, a slot taking one block. Each shard draws its counts of slots per source from a
multinomial; the draws of a source are numbered on over the shards, and number t takes block ``perm(t mod n)`` of the
source's n blocks, ``perm`` being a pseudorandom permutation of the block indexes; slots and blocks are joined by
index. A source's quota of slots is its target over its mean block length: draws beyond it are handed, in order, to
the sources that drew too few, so that each source ends within half a block of its target and no block is taken more
than ``most_times`` times. All pseudorandom numbers are hashes or seeded draws: reruns agree.

Positions of documents in their source are sums over buckets of document hashes, first per bucket, then over buckets,
then within, so no source is sorted in one task.

Cases: a null text has no words, takes no place and is taken 0 times; a null source is a source of its own, the last;
repeated rows are documents of their own (one id's rows are ordered by size, which makes equal ones interchangeable);
without any words all targets are 0; an empty table gives no rows. Only doc_id, text and source are read for counts;
materialised blocks carry lang too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 256
MOST_TIMES = 3
SHARD_SLOTS = 16_384
#: Documents that a bucket of a source should have; a bucket is summed and numbered in one task.
BUCKET_ROWS = 4096
#: Sources are few: their sizes come to the driver, so more than this is an error.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Plan:
    """Per source in order: name, documents, words, target words, blocks, quota of slots."""

    names: list[str | None]
    documents: list[int]
    words: list[int]
    targets: list[float]
    blocks: list[int]
    quotas: list[int]


def share_out(words: list[int], weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> list[float]:
    """Targets: all words by weight; what exceeds ``most_times`` a source's words is shared anew among the others."""
    limit, targets = [most_times * w for w in words], [0.0] * len(words)
    left, open_ = float(sum(words)), list(range(len(words)))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        due = {i: left * weights[i % len(weights)] / total for i in open_}
        over = [i for i in open_ if due[i] > limit[i]]
        if not over:
            for i in open_:
                targets[i] = due[i]
            break
        for i in over:
            targets[i] = float(limit[i])
            left -= limit[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def plan_mix(sized: DataFrame, block_words: int = BLOCK_WORDS) -> Plan:
    """``sized``: source, size."""
    rows = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).orderBy(F.col("source").asc_nulls_last())
    found = rows.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    words = [r["words"] for r in found]
    targets = share_out(words)
    blocks = [-(-w // block_words) for w in words]
    quotas = [min(MOST_TIMES * n, round(t * n / w)) if w else 0 for w, t, n in zip(words, targets, blocks)]
    return Plan([r["source"] for r in found], [r["n"] for r in found], words, targets, blocks, quotas)


def sources(spark, plan: Plan) -> DataFrame:
    """source, source_no, source_size, target, buckets."""
    each = zip(plan.names, plan.words, plan.targets, plan.documents)
    rows = [(name, i, w, t, -(-n // BUCKET_ROWS)) for i, (name, w, t, n) in enumerate(each)]
    return spark.createDataFrame(rows, "source string, source_no int, source_size long, target double, buckets long")


def placed(sized: DataFrame, seed: int = 0) -> DataFrame:
    """``sized`` (source_no, buckets, doc_id, size and more) with ``start``: the word position of the document in its
    source."""
    order = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0)))
    rows = sized.withColumn("spot", order).withColumn("bucket", F.pmod("spot", "buckets"))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source_no").orderBy("bucket")
    before = F.sum("words").over(run) - F.col("words")
    offsets = sums.select("source_no", "bucket", before.alias("offset"))
    inner = Window.partitionBy("source_no", "bucket").orderBy("spot", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    start = F.col("offset") + F.sum("size").over(inner) - F.col("size")
    return rows.join(offsets, ["source_no", "bucket"]).withColumn("start", start).drop("spot", "bucket", "buckets", "offset")


def drawn(spark, plan: Plan, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, source_no, count: multinomial draws of each shard."""
    total = sum(plan.quotas)
    if not total:
        return spark.createDataFrame([], "shard long, source_no int, count long")
    shares = np.array(plan.quotas) / total
    shards = -(-total // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                slots = min(shard_slots, total - shard * shard_slots)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(slots, shares)
                mine = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "source_no": mine.astype("int32"), "count": counts[mine]})

    return spark.range(0, shards, 1, min(shards, tasks(spark))).mapInPandas(draw, "shard long, source_no int, count long")


def tasks(spark) -> int:
    """How many tasks small rows are dealt to that make much work each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def permute(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: a Feistel network, walked on while it leads beyond n."""
    half = max(1, -(-max(1, int(n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    rng = np.random.default_rng([key, n])
    odd = rng.integers(0, 1 << 62, rounds, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 62, rounds, dtype=np.uint64)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for a, b in zip(odd, add):
            mixed = (right + b) * a
            mixed ^= mixed >> np.uint64(29)
            left, right = right, left ^ ((mixed * a >> np.uint64(17)) & mask)
        return (left << np.uint64(half)) | right

    out = step(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = step(out[far])
    return out.astype(np.int64)


def slots(spark, plan: Plan, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, source_no, block_no: one row for each slot of the mix."""
    draws = materialize(drawn(spark, plan, seed, shard_slots), "mix-draws")
    run = Window.partitionBy("source_no").orderBy("shard")
    numbered = materialize(draws.withColumn("first", F.sum("count").over(run) - F.col("count")), "mix-numbered")
    got = np.zeros(len(plan.quotas), dtype=np.int64)
    for row in draws.groupBy("source_no").agg(F.sum("count").alias("n")).collect():
        got[row["source_no"]] = row["n"]
    quota, blocks = np.array(plan.quotas, dtype=np.int64), np.array(plan.blocks, dtype=np.int64)
    over, short = np.maximum(got - quota, 0), np.maximum(quota - got, 0)
    over_from, short_to = np.cumsum(over) - over, np.cumsum(short)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, source, first, count in batch.itertuples(index=False):
                number = first + np.arange(count)
                to = np.full(count, source)
                spare = number >= quota[source]
                rank = over_from[source] + number[spare] - quota[source]
                to[spare] = np.searchsorted(short_to, rank, side="right")
                number[spare] = got[to[spare]] + rank - (short_to - short)[to[spare]]
                block = np.empty(count, dtype=np.int64)
                for s in np.unique(to):
                    mine = to == s
                    block[mine] = permute(number[mine] % blocks[s], int(blocks[s]), seed + int(s))
                yield pd.DataFrame({"shard": shard, "source_no": to.astype("int32"), "block_no": block})

    # One small row for a shard and source makes all its slots, so rows are dealt out by their number, not their size.
    rows = numbered.select("shard", "source_no", "first", "count").repartition(tasks(spark), "shard", "source_no")
    # Written, so that what joins with it goes by its size and not by that of the few rows it comes from.
    return materialize(rows.mapInPandas(take, "shard long, source_no int, block_no long"), "mix-slots")


def sized_documents(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), *more
    )


def with_source(sized: DataFrame, named: DataFrame) -> DataFrame:
    """Adds source_no, source_size, target, buckets; ``named`` has at most MOST_SOURCES rows."""
    known = F.broadcast(named.withColumnRenamed("source", "known_source"))
    return sized.join(known, sized["source"].eqNullSafe(known["known_source"])).drop("known_source")


def block_range(block_words: int) -> Column:
    first = F.floor(F.col("start") / block_words).cast("long")
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    return F.sequence(first, last)


def mix_counts(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words the mix takes of each document, repeats counted."""
    spark = docs.sparkSession
    sized = materialize(sized_documents(docs), "mix-sizes")
    plan = plan_mix(sized, block_words)
    rows = with_source(sized, sources(spark, plan)).drop("source")
    out = ["doc_id", "size", "source_size", "target"]
    spots = placed(rows.where("size > 0"), seed)
    covered = spots.select("*", F.explode(block_range(block_words)).alias("block_no")).withColumn(
        "words",
        F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block_words)
        - F.greatest("start", F.col("block_no") * block_words),
    )
    times = materialize(
        slots(spark, plan, seed).groupBy("source_no", "block_no").agg(F.count("*").alias("times")), "mix-times"
    )
    taken = (
        covered.join(times, ["source_no", "block_no"], "left")
        .groupBy("source_no", "start", *out)
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        .select(*out, "taken")
    )
    return taken.unionByName(rows.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The mix itself: shard, doc_id, text, lang, source, n_chars; one row for each stretch of a document in a slot.

    A stretch is the part of a document that lies in the block; a document within one block keeps its text as it is.
    Which stretches of a document are taken is found on rows without texts, so texts are shuffled once, to meet theirs.
    Rows are known by doc_id and a hash of text and source; equal rows share out the places of their key in turn.
    """
    spark = docs.sparkSession
    key = [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k1"),
        F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), "source").alias("k2"),
    ]
    sized = materialize(sized_documents(docs, *key), "mix-sizes")
    plan = plan_mix(sized.select("source", "size"), block_words)
    rows = with_source(sized, sources(spark, plan)).where("size > 0").select("k1", "k2", "doc_id", "source_no", "buckets", "size")
    low = F.greatest(F.col("start"), F.col("block_no") * block_words) - F.col("start")
    high = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block_words) - F.col("start")
    taken = (
        placed(rows, seed)
        .select("k1", "k2", "source_no", "start", "size", F.explode(block_range(block_words)).alias("block_no"))
        .join(slots(spark, plan, seed), ["source_no", "block_no"])
        .groupBy("k1", "k2", "start")
        .agg(F.sort_array(F.collect_list(F.struct("shard", low.cast("int").alias("low"), high.cast("int").alias("high")))).alias("cuts"))
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_list(F.struct("start", "cuts"))).alias("places"))
    )
    texts = docs.select(*key, "doc_id", "text", "lang", "source").where(F.col("text").isNotNull())
    turn = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("lang"))
    met = texts.withColumn("turn", turn).join(taken, ["k1", "k2"])
    cuts = F.get("places", F.col("turn") - 1)["cuts"]
    pieces = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))

    def stretches(words: Column) -> Column:
        def cut(c: Column) -> Column:
            all_of_it = (c["low"] == 0) & (c["high"] == F.size(words))
            part = F.array_join(F.slice(words, c["low"] + 1, c["high"] - c["low"]), "")
            return F.struct(c["shard"].alias("shard"), F.when(all_of_it, F.col("text")).otherwise(part).alias("text"))

        return F.transform(cuts, cut)

    cut = F.element_at(F.transform(F.array(pieces), stretches), 1)
    out = met.where(cuts.isNotNull()).select("doc_id", "lang", "source", F.explode(cut).alias("s"))
    return out.select("s.shard", "doc_id", "s.text", "lang", "source", F.length("s.text").cast("long").alias("n_chars"))
