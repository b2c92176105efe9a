"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has bit i set if bit i is set in over half of the XXH64 hashes of its word shingles. Two
fingerprints link if at most three bits differ. Cut into two halves, one half then differs by at most one bit: each
half is indexed under every variant with one bit wildcarded (64 keys a fingerprint), rows with equal keys are joined
and the whole distance is verified. Rows of one fingerprint are one entry of the index. An index key that more
fingerprints share than ``bucket_most`` is not paired off: its members are dealt anew by the variants of the halves of
what is left of the other half, and so on down to four bits, so that no bucket makes all pairs of a large group and
no link is lost. Connected components come from alternating large-star and small-star steps, each written to the
shared folder.

Cases: null or blank text has fingerprint zero and links like any other; fewer words than a shingle make one shingle of
what there is; repeated shingles count each time; a null doc_id is linked but never names a component unless it has no
other member (then null); repeated rows stay rows; an empty table gives no rows; other columns are not read. Long
texts are hashed in blocks, so memory does not grow with the number of shingles.

The pipeline's stage has its own parameters: five words and a similarity of 0.8. Such pairs differ in about ten bits of
a SimHash, too many for wildcards of one bit to be selective. It takes the least hashes of each text's set of shingles
instead: similar sets must share several of them (``prefix``), so no similar pair is missed. Texts that share too few
are left out, the most common of a text's keys aren't needed, and the sets of the pairs that are left are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import materialize

#: A-Z to a-z, all other bytes as they are: safe on UTF-8.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 15
MOST_BITS = 3
#: Widths of the halves that are cut, level by level.
LEVELS = (32, 16, 8, 4)
#: The 64 orders of the lanes (fixed values).
LANE_SEEDS, LANE_FACTORS = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, (2, 64), dtype=np.uint64) | np.uint64(1)
#: A text has one key more for each so many shingles than it takes to meet a similar one.
SPARE = 20
#: So many of a text's groups are looked through for an earlier one that a pair has in common.
GROUPS_KNOWN = 64
#: About so many hashes and members at most of a large group are compared with so many others at once.
BLOCK_HASHES, BLOCK_MEMBERS = 1 << 18, 1024
#: Bits of the bitmap of ``may_be_in``: 4 MB, whatever the size of the tables.
BITMAP_BITS = 1 << 25


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    join, digest = b" ".join, xxhash.xxh64_digest
    for at in range(0, total, BLOCK):
        ends = range(at, min(at + BLOCK, total))
        raw = b"".join([digest(join(words[i : i + shingle]), seed) for i in ends])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def wildcards(fp: Column, low: int, width: int) -> Column:
    """One key for each bit of both ``width``-bit halves of the ``2 * width`` bits from bit ``low`` up."""
    keys = []
    for half in (0, 1):
        part = F.shiftrightunsigned(fp, low + half * width).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            tag = (half * width + bit) << 32
            keys.append(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit))).bitwiseOR(F.lit(tag)))
    return F.array(*keys)


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def rest_of(key: Column, low: Column, width: int) -> Column:
    """Lowest bit of the half that the key does not hold."""
    return low + F.when(F.shiftrightunsigned(key, 32) < width, F.lit(width)).otherwise(F.lit(0))


def links(fps: DataFrame, bucket_most: int = 256) -> DataFrame:
    """a, b with a < b: pairs of distinct fingerprints (column fp) at most three bits apart."""
    # Dealt before they are multiplied, so that the number of files they come from doesn't bound the tasks.
    dealt = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = dealt.select("fp", F.explode(wildcards(F.col("fp"), 0, LEVELS[0])).alias("key")).select(
        "fp", "key", F.lit(0).alias("low"), F.col("key").alias("path")
    )
    found = []
    for level, width in enumerate(LEVELS):
        last = level == len(LEVELS) - 1
        if last:
            cold = index
        else:
            full = materialize(
                index.groupBy("path").count().where(F.col("count") > bucket_most).select("path"), "simhash-full"
            )
            cold = index.join(full, "path", "left_anti")
        a, b = (cold.select("path", F.col("fp").alias(x)) for x in "ab")
        # Spark sizes a table after an explode as if it hadn't more rows, and would broadcast this one.
        found.append(a.hint("merge").join(b, "path").where((F.col("a") < F.col("b")) & (bits_apart(F.col("a"), F.col("b")) <= MOST_BITS)).select("a", "b"))
        if last or full.isEmpty():
            break
        nxt = LEVELS[level + 1]
        rest = rest_of(F.col("key"), F.col("low"), width)
        members = index.join(full, "path").select("fp", "path", rest.alias("low"))
        deeper = None
        for start in range(0, 64, width):
            mine = members.where(F.col("low") == start).select(
                "fp", "path", "low", F.explode(wildcards(F.col("fp"), start, nxt)).alias("key")
            )
            deeper = mine if deeper is None else deeper.unionByName(mine)
        index = materialize(
            deeper.select("fp", "key", "low", F.xxhash64("path", "key", "low").alias("path")), "simhash-index"
        )
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: for each node of the edges (a, b) the smallest node it is connected with."""
    edges = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.unionByName(edges.where("false")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket_most: int = 256) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    marked = materialize(fingerprints(docs, shingle), "simhash-fp")
    entries = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-entries")
    groups = materialize(components(links(entries.select("fp"), bucket_most)), "simhash-groups")
    member = entries.join(groups, entries["fp"] == groups["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of_entry = materialize(member.join(named, "root").select("fp", "component_id"), "simhash-member")
    return marked.join(of_entry, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The different hashes of a text's word shingles, in ascending order; empty without words."""
    words = (text or "").encode().translate(LOWER).split()
    total = max(1, len(words) - shingle + 1) if words else 0
    join, digest = b" ".join, xxhash.xxh64_digest
    raw = b"".join([digest(join(words[i : i + shingle]), seed) for i in range(total)])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def lanes(hashes: np.ndarray) -> np.ndarray:
    """A wider fingerprint of a set: 64 lanes of eight bits, each taken from the set's least hash in an order of its own.

    Two sets agree in a lane with the probability of their similarity. Given as eight signed 64-bit integers. The stage
    doesn't use it any more: a pair may share no key of these by chance.
    """
    least = np.full(64, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[at : at + 2048, None] ^ LANE_SEEDS) * LANE_FACTORS).min(axis=0))
    return ((least >> np.uint64(16)) & np.uint64(0xFF)).astype(np.uint8).view(">i8").astype(np.int64)


def set_name(hashes: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes()), "big", signed=True)


def prefix(hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """A set's keys, the upper halves of its least hashes, and how many of them any similar set has too, at least.

    Similar sets of n and m hashes have o >= s * max(n, m) in common. Of these the first k are among the first n - o + k
    of the one and m - o + k of the other, since the other o - k stand behind them. Here k is 1 and one more for each
    ``SPARE`` shingles; as a similar set may be smaller, only what the smallest has is counted on, less the keys that two
    hashes share.
    """
    n = len(hashes)
    need = math.ceil(similarity * n - 1e-6)
    first = hashes[: n - need + 1 + n // SPARE] >> np.uint64(32)
    keys = np.unique(first).astype(np.uint32)
    return keys, max(1, 1 + need // SPARE - (len(first) - len(keys)))


def prefixes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key, entry (name of the text's set of shingles), size (of the set), least and keys (``prefix``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text.as_py(), shingle) for text in batch.column(2)]
            keys, least = zip(*(prefix(hashes, similarity) for hashes in found)) if found else ((), ())
            columns = [
                batch.column(0), batch.column(1), pa.array([set_name(h) for h in found], pa.int64()), pa.array([len(h) for h in found], pa.int32()),
                pa.array(least, pa.int32()), pa.array([k.view(np.int32) for k in keys], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "entry", "size", "least", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, entry bigint, size int, least int, keys array<int>")


def one_of_each(marked: DataFrame, copied: DataFrame) -> DataFrame:
    """entry, first (a doc_id), size, least, keys: one row of ``marked`` for each entry. ``copied``: entries with several.

    Only rows that may have copies are shuffled.
    """
    rows = may_be_in(marked.withColumnRenamed("doc_id", "first"), copied, ["entry"])
    about = ["first", "size", "least", "keys"]
    several = rows.where("`may be in`").groupBy("entry").agg(F.first(F.struct(*about)).alias("one")).select("entry", "one.*")
    return rows.where("not `may be in`").select("entry", *about).unionByName(several)


def text_key() -> Column:
    """With doc_id, what tells rows apart: an id may have several texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def may_be_in(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``may be in``: false only if no row of ``wanted`` has their ``key`` (of columns that aren't null).

    The keys' hashes set bits of one bitmap of a fixed size, which is broadcast: rows that a join would drop are known
    before they are shuffled. The more keys, the more rows are true without need, so an exact join follows.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(BITMAP_BITS)) + 1
    bits = wanted.select(F.bitmap_bucket_number(place).alias("near bucket"), F.bitmap_bit_position(place).alias("bit"))
    bits = bits.groupBy("near bucket").agg(F.bitmap_construct_agg("bit").alias("near bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("near bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    found = rows.withColumn("near bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "near bucket", "left")
    return found.select(*rows.columns, maybe.alias("may be in"))


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = 5) -> DataFrame:
    """entry, hashes array<bigint>, of the entries in ``wanted`` (doc_id, entry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for entry, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if entry in seen:
                    continue
                hashes = shingle_set(text.as_py(), shingle)
                if set_name(hashes) == entry:  # a repeated id may have another text
                    seen.add(entry)
                    columns = [pa.array([entry], pa.int64()), pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["entry", "hashes"])

    texts = may_be_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, ["doc_id"])
    texts = texts.where("`may be in`").join(wanted, "doc_id")
    return texts.select("entry", "text").mapInArrow(run, "entry bigint, hashes array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose sets have at least that share of their union in common."""
    one, two = (sets.select(F.col("entry").alias(x), F.col("hashes").alias("of_" + x)) for x in "ab")
    common = pairs.join(one, "a").join(two, "b").select(
        "a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("all")
    )
    return common.where(F.col("both") / (F.col("all") - F.col("both")) >= similarity).select("a", "b")


def shared_keys(entries: DataFrame) -> DataFrame:
    """grp, entry, degree: the keys that an entry needs to meet all similar ones; degree tells how many entries it meets.

    An entry with fewer keys that others have too than ``least`` is like no other. Of a pair's keys the one that the
    fewest entries have is before all others of the pair in both entries' order, so each may leave out the last
    ``least`` - 1: the most common ones.
    """
    index = entries.select("entry", "least", F.explode("keys").alias("grp"))
    counted = index.withColumn("n", F.count("*").over(Window.partitionBy("grp"))).where("n > 1")
    own = Window.partitionBy("entry")
    ranked = counted.select(
        "grp", "entry", "least", F.row_number().over(own.orderBy("n", "grp")).alias("place"),
        F.count("*").over(own).alias("had"), F.sum("n").over(own).alias("degree"),
    )
    return ranked.where("place <= had - least + 1").select("grp", "entry", "degree")


def with_pivots(groups: DataFrame) -> DataFrame:
    """pivot, entry, degree, n: members of groups (grp, entry, open, degree) with the open member that meets most entries.

    n tells how many members a pivot has."""
    pivot = F.max(F.struct("open", "degree", "entry")).over(Window.partitionBy("grp"))
    named = groups.withColumn("pivot", pivot["entry"]).where("entry <> pivot")
    return named.select("pivot", "entry", "degree").distinct().withColumn("n", F.count("*").over(Window.partitionBy("pivot")))


def plausible(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those that may be similar by their sizes and keys.

    Of the text whose keys end first, all shingles that the other has too are among the keys both have or not among its
    keys at all: what it has in common with the other is no more than these.
    """
    last = F.element_at("keys", -1).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("last")
    about = known.select("entry", "size", "least", "keys", last)
    one, two = (about.select(F.col("entry").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in about.columns[1:]]) for x in "ab")
    met = F.size(F.array_intersect("keys_a", "keys_b"))
    rest = F.when(F.col("last_a") <= F.col("last_b"), F.col("size_a") - F.size("keys_a")).otherwise(F.col("size_b") - F.size("keys_b"))
    room = (met + rest) * F.lit(1 + 1 / similarity) + F.lit(1e-6) >= F.col("size_a") + F.col("size_b")
    fit = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(similarity) - F.lit(1e-6)
    enough = met >= F.greatest("least_a", "least_b")
    return pairs.join(one, "a").join(two, "b").where(fit & enough & room).select("a", "b")


def pairs_in_groups(dealt: DataFrame, entries: DataFrame, similarity: float, roots: DataFrame | None = None) -> DataFrame:
    """a, b: members of a group of ``dealt`` that may be similar by their sizes and that its pivot does not link both.

    ``both`` is what a member has in common with the pivot (0 for all: not known); ``lacks`` tells groups of members that
    lack a shingle of the pivot together. What is known of a pair is the same in all groups of one pivot and kind, so it
    is made in the first that both are in only, as far as the first ``GROUPS_KNOWN`` of both tell; others make it again,
    and none is lost. With ``roots`` (node, root: links known so far) pairs of one component are left out.
    """
    key = ["pivot", "entry", "lacks"]
    meets = dealt.groupBy(*key).agg(F.slice(F.sort_array(F.collect_set("grp")), 1, GROUPS_KNOWN).alias("meets"))
    about = entries.select("entry", F.col("entry").alias("root"))
    if roots is not None:
        about = about.drop("root").join(roots.withColumnRenamed("node", "entry"), "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    rows = dealt.join(meets, key).join(about, "entry")
    a, b = (rows.select("grp", *[F.col(c).alias(f"{c}_{x}") for c in ("entry", "root", "linked", "size", "both", "lacks", "meets")]) for x in "ab")
    once = F.col("linked_b") | (F.col("entry_a") < F.col("entry_b"))
    # What two texts can have in common: of the pivot's shingles, and of others unless they only lack one together.
    others = F.when(F.col("lacks_a"), 0).otherwise(F.least(F.col("size_a") - F.col("both_a"), F.col("size_b") - F.col("both_b")))
    room = (F.least("both_a", "both_b") + others) * F.lit(1 + 1 / similarity) + F.lit(1e-6) >= F.col("size_a") + F.col("size_b")
    met = F.coalesce(F.array_min(F.array_intersect("meets_a", "meets_b")) < F.col("grp"), F.lit(False))
    apart = (F.col("entry_a") != F.col("entry_b")) & (F.col("root_a") != F.col("root_b"))
    pairs = a.where("not linked_a").join(b, "grp").where(apart & once & room & ~met)
    return pairs.select(F.least("entry_a", "entry_b").alias("a"), F.greatest("entry_a", "entry_b").alias("b"))


def overlaps(values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values the sets ``left`` have in common with the sets ``right``; ``values`` holds all sets in a row."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    different, column, times = np.unique(values, return_inverse=True, return_counts=True)
    several = times[column] > 1
    owner, column = owner[several], np.cumsum(times > 1)[column[several]] - 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int((times > 1).sum()), 2048):
        at = slice(*np.searchsorted(column, [start, start + 2048]))
        held = np.zeros((len(sizes), 2048), np.float32)
        held[owner[at], column[at] - start] = 1
        both += held[left] @ held[right].T
    return both


def connecting(near: np.ndarray, joined: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the symmetric ``near`` that connect all it connects, given that those in ``joined`` are connected."""
    left, front, found = near.any(axis=1) & ~joined, np.nonzero(joined)[0], []
    while True:
        while len(front):
            reached = near[front]
            new = np.nonzero(left & reached.any(axis=0))[0]
            found += zip(front[reached[:, new].argmax(axis=0)], new) if len(new) else []
            left[new] = False
            front = new
        front = np.nonzero(left)[0][:1]
        if not len(front):
            return found
        left[front] = False


def links_in_blocks(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect all similar members (pivot, entry, linked, size) of a pivot, as those it links are.

    Members are dealt into blocks of like sizes; each block with a member that isn't linked meets those of its pivot
    that can hold similar texts. A meeting of two blocks is one matrix product, so a crowd costs no row a pair.
    """
    step = math.log(1 / similarity) + 1e-9  # similar sets are at most one class apart
    rows = members.withColumn("class", F.floor(F.log("size") / F.lit(step)))
    parts = F.ceil(F.greatest(F.sum("size") / F.lit(BLOCK_HASHES), F.count("*") / F.lit(BLOCK_MEMBERS)))
    rows = rows.join(rows.groupBy("pivot", "class").agg(parts.alias("parts")), ["pivot", "class"])
    part = F.pmod(F.xxhash64("entry"), "parts")
    rows = materialize(rows.select("pivot", "entry", "linked", "class", (F.shiftleft("class", 32) + part).alias("block")), "near-blocks")
    blocks = rows.groupBy("pivot", "block", "class").agg(F.max(~F.col("linked")).alias("open"))
    a, b = (blocks.select("pivot", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "class", "open")]) for x in "ab")
    meet = a.join(b, "pivot").where("block_a <= block_b and class_b <= class_a + 1 and (open_a or open_b)")
    meet = materialize(meet.select("pivot", "block_a", "block_b"), "near-meetings")
    sides = meet.select("*", F.col("block_a").alias("block"), F.lit(False).alias("other"))
    sides = sides.unionByName(meet.where("block_a < block_b").select("*", F.col("block_b").alias("block"), F.lit(True).alias("other")))

    def run(table: pa.Table) -> pa.Table:
        entry, linked, other = (table[c].to_numpy() for c in ("entry", "linked", "other"))
        lists = pa.concat_arrays(table["hashes"].chunks)
        sizes = lists.value_lengths().to_numpy()
        left, right = np.nonzero(~other)[0], np.nonzero(other if other.any() else ~other)[0]
        both = overlaps(lists.flatten().to_numpy(), sizes, left, right).astype(np.float64)
        found = both / (sizes[left][:, None] + sizes[right] - both) >= similarity
        found &= ~(linked[left][:, None] & linked[right]) & (entry[left][:, None] != entry[right])
        near = np.zeros((len(entry), len(entry)), bool)
        near[np.ix_(left, right)] = found
        pairs = entry[np.array(connecting(near | near.T, linked), np.int64).reshape(-1, 2)]
        return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    meeting = sides.join(rows.select("pivot", "block", "entry", "linked"), ["pivot", "block"]).join(sets, "entry")
    meeting = meeting.select("pivot", "block_a", "block_b", "other", "entry", "linked", "hashes")
    return meeting.groupBy("pivot", "block_a", "block_b").applyInArrow(run, "a bigint, b bigint")


def similar_links(
    docs: DataFrame, entries: DataFrame, shingle: int = 5, similarity: float = 0.8, group_most: int = 32, rounds: int = 1
) -> DataFrame:
    """a, b: links between entries (entry, first, size, least, keys) that make the components of all similar pairs.

    Entries without keys get them from ``docs``. Every member of a group of entries that share a key is compared with a
    pivot: the member that meets most other entries, which in a crowd of edited copies is the text they were made from.
    Members it links need no comparison with each other. The others are compared with all members of the pivot's groups:
    in pairs if these are up to ``group_most``, and in blocks if they are more, after ``rounds`` of pivots. So no pair of
    similar texts is torn.
    """
    if "keys" not in entries.columns:
        marked = prefixes(docs, shingle, similarity)
        entries = one_of_each(marked, marked.groupBy("entry").count().where("count > 1")).join(entries.select("entry"), "entry", "left_semi")
    tried = materialize(with_pivots(shared_keys(entries).withColumn("open", F.lit(True))), "near-tried")
    names = materialize(tried.select("entry").union(tried.select("pivot")).distinct(), "near-names")
    known = may_be_in(entries, names, ["entry"]).where("`may be in`").join(names, "entry", "left_semi").drop("may be in")
    known = materialize(known, "near-known")

    found, sets = [], None
    for left in range(rounds - 1, -1, -1):
        pairs = materialize(plausible(tried.select(F.col("pivot").alias("a"), F.col("entry").alias("b")), known, similarity), "near-pairs")
        few = tried.where((F.col("n") > 1) & (F.col("n") <= group_most)).join(known.select("entry", "size"), "entry").select(
            F.col("pivot").alias("grp"), "pivot", "entry", F.lit(False).alias("linked"), "size", F.lit(0).alias("both"), F.lit(False).alias("lacks")
        )
        others = materialize(plausible(pairs_in_groups(few, known, similarity).distinct(), known, similarity), "near-others")
        many = tried.where(F.col("n") > group_most)
        if sets is None:  # of later rounds too
            names = [x.select(F.col(c).alias("entry")) for x, c in ((pairs, "a"), (pairs, "b"), (others, "a"), (others, "b"), (many, "entry"))]
            names = materialize(reduce(DataFrame.unionByName, names).distinct(), "near-names")
            sets = sets_of(docs, known.join(names, "entry", "left_semi").select(F.col("first").alias("doc_id"), "entry"), shingle)
            sets = materialize(sets, "near-sets")
        linked = materialize(similar(pairs, sets, similarity).distinct(), "near-links")
        found.append(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        # Of two that one pivot links, and of a pivot and one that it links, nothing more needs to be known.
        roots = linked.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        one, two = (roots.select(F.col("node").alias(x), F.col("root").alias("root_" + x)) for x in "ab")
        others = others.join(one, "a", "left").join(two, "b", "left")
        apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
        found.append(materialize(similar(others.where(apart).select("a", "b"), sets, similarity), "near-links"))

        linked = linked.select(F.col("a").alias("pivot"), F.col("b").alias("entry"), F.lit(True).alias("linked"))
        many = many.join(linked, ["pivot", "entry"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
        many = many.join(many.groupBy("pivot").agg(F.min("linked").alias("all")).where("not all"), "pivot")
        many = materialize(many.join(known.select("entry", "size"), "entry"), "near-many")
        if many.isEmpty():
            break
        if left:
            tried = materialize(with_pivots(many.select(F.col("pivot").alias("grp"), "entry", (~F.col("linked")).alias("open"), "degree")), "near-tried")
        else:
            found.append(materialize(links_in_blocks(many, sets, similarity), "near-links"))
    return reduce(DataFrame.unionByName, found).distinct()


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each component of similar texts: that with the smallest doc_id (of several texts of that id in
    the component, that with the smallest hash); its repeated rows shrink to one.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of at least ``similarity``; no such
    pair is missed. Texts with equal sets are one entry. A document is a row's id and text: texts
    of one id that aren't similar all stay. All columns of ``docs`` stay as they are. Rows without a doc_id are kept.
    """
    named = docs.where("doc_id is not null")
    marked = materialize(prefixes(named, shingle, similarity), "near-keys")
    entries = marked.groupBy("entry").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("rows"))
    entries = materialize(entries.select("entry", "rows", F.col("first.doc_id").alias("first"), F.col("first.text_key").alias("text_key")), "near-entries")
    keyed = one_of_each(marked, entries.where("rows > 1").select("entry"))
    groups = materialize(components(similar_links(named, keyed, shingle, similarity)), "near-groups")
    member = entries.join(groups, entries["entry"] == groups["node"], "left").select(
        "entry", "rows", F.struct("first", "text_key").alias("head"), F.coalesce("root", "entry").alias("root")
    )
    heads = materialize(member.groupBy("root").agg(F.min("head").alias("kept"), F.sum("rows").alias("rows")), "near-heads")
    # Rows alone in their component stay as they are: of the texts only those of the others are shuffled.
    others = member.join(heads.where("rows > 1"), "root", "left_semi")
    others = marked.join(others, "entry", "left_semi").select(F.col("doc_id").alias("near id"), F.col("text_key").alias("near text key"))
    rows = named.select(*[named[c] for c in docs.columns], named["doc_id"].cast("long").alias("near id"), text_key().alias("near text key"))
    rows = may_be_in(rows, materialize(others, "near-others"), ["near id", "near text key"])
    kept = heads.select(F.col("kept.first").alias("near id"), F.col("kept.text_key").alias("near text key"))
    one = rows.where("`may be in`").join(kept, ["near id", "near text key"], "left_semi").dropDuplicates(["near id", "near text key"])
    return rows.where("not `may be in`").unionByName(one).select(docs.columns).unionByName(docs.where("doc_id is null"))
