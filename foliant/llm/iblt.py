"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with built-in functions only.

A text is cut into paragraphs (lines; a line goes on to a new piece every ``PIECE`` words, so that a long line is not
one unit). Each distinct paragraph gives a 64-bit key: 48 bits of its hash and 16 check bits of those. A sketch has
three rows of eight cells; a key is added to one cell of each row: the cell's count goes up and its xor takes the key
in. Subtracting two sketches cell by cell cancels what both hold. Peeling then takes keys out of the cells that hold
just one (count 1 or -1, check bits right) until all cells are empty; the keys taken are the paragraphs that differ.
If cells stay full, it is tried again with a larger sketch: both versions' keys are dealt to 2^k parts of 24 cells
each, twice as many with each retry and with other cells for each key, and the parts are peeled as rows of their own, so that a long text is spread over
tasks. The likeness of two texts is the share of their distinct paragraphs that both hold.

Cases: a null text is an empty one; texts without words have no paragraphs and an empty sketch; two such are alike
(1.0). Repeated paragraphs of a text count once. Equal texts have equal fingerprints. With one document, the next is
itself. Ties in doc_id are ordered by text, null ids come last; repeated rows stay rows. Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.quality import let
from foliant.session import materialize

PIECE = 32
#: Up to PIECE words of a line, with the blanks after them.
PARAGRAPH = rf"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){{1,{PIECE}}}+"
ROWS, WIDTH = 3, 8
CELLS = ROWS * WIDTH
#: Rounds of peeling; each takes out every key that stands alone.
ROUNDS = 8
#: Keys for each part of a larger sketch, at the first retry.
PER_PART = 8
MOST_RETRIES = 12
#: Bounds of the buckets in which neighbours are looked up, and rows a bucket should have.
BOUNDS, BUCKET_ROWS = 128, 8192

LONG_MASK = ~0xFFFF


def keys_of(text: Column) -> Column:
    """Sorted distinct keys of the paragraphs of a text."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    high = F.transform(pieces, lambda p: F.xxhash64(F.rtrim(p)).bitwiseAND(F.lit(LONG_MASK)))
    return F.array_sort(F.array_distinct(F.transform(high, lambda h: h.bitwiseOR(check(h)))))


def check(high: Column) -> Column:
    return F.xxhash64(high).bitwiseAND(F.lit(0xFFFF).cast("long"))


def is_key(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFF).cast("long")) == check(x.bitwiseAND(F.lit(LONG_MASK)))


def cell_at(key: Column, row: int) -> Column:
    return F.shiftrightunsigned(key, 17 + 9 * row).bitwiseAND(F.lit(WIDTH - 1).cast("long")).cast("int") + WIDTH * row


def placed(key: Column, sign: Column, salt: int = 0) -> Column:
    """A key with its cells; with a salt other ones, so that keys which share all their cells part at a retry."""
    spot = F.xxhash64(key, F.lit(salt)) if salt else key
    return F.struct(
        key.alias("k"), sign.alias("s"), *[cell_at(spot, row).alias(f"p{row}") for row in range(ROWS)]
    )


def cell(n: Column, x: Column) -> Column:
    return F.struct(n.alias("n"), x.alias("x"))


def put(cells: Column, entries: Column, sign: int = 1) -> Column:
    """The cells with each entry added ``sign`` times its own sign; each row of cells looks at one place of a key."""

    def filled(row: int, bound: Column) -> Column:
        def add(c: Column, i: Column) -> Column:
            mine = i + WIDTH * row
            return F.aggregate(
                bound,
                c,
                lambda acc, e: F.when(
                    e[f"p{row}"] == mine, cell(acc["n"] + sign * e["s"], acc["x"].bitwiseXOR(e["k"]))
                ).otherwise(acc),
            )

        return F.transform(F.slice(cells, WIDTH * row + 1, WIDTH), add)

    return let(entries, lambda bound: F.concat(*[filled(row, bound) for row in range(ROWS)]))


def empty_cells() -> Column:
    return F.array_repeat(cell(F.lit(0), F.lit(0).cast("long")), CELLS)


def sketch(keys: Column) -> Column:
    return put(empty_cells(), F.transform(keys, lambda k: placed(k, F.lit(1))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: cell(x["n"] - y["n"], x["x"].bitwiseXOR(y["x"])))


def net(taken: Column) -> Column:
    """Without what was taken out and put back: a sum of keys that passed for one by chance."""
    back = lambda e: F.struct(e["k"].alias("k"), (-e["s"]).alias("s"))
    return F.filter(taken, lambda e: ~F.array_contains(taken, back(e)))


def peel(cells: Column, salt: int = 0) -> Column:
    """array of struct(k, s): the keys left in a difference of sketches, s 1 or -1 by side; null if peeling stuck."""
    none = F.array().cast("array<struct<k:bigint,s:int,p0:int,p1:int,p2:int>>")

    def alone(c: Column, i: Column) -> Column:
        spot = F.xxhash64(c["x"], F.lit(salt)) if salt else c["x"]
        row = F.floor(i / WIDTH)
        at = F.call_function("shiftrightunsigned", spot, (17 + 9 * row).cast("int")).bitwiseAND(F.lit(WIDTH - 1).cast("long")).cast("int") + WIDTH * row
        return F.when((F.abs(c["n"]) == 1) & is_key(c["x"]), at == i).otherwise(False)

    def round_(state: Column, _: Column) -> Column:
        fresh = F.array_distinct(F.transform(F.filter(state["cells"], alone), lambda c: placed(c["x"], c["n"], salt)))
        next_ = lambda f: F.struct(
            F.when(F.size(f) == 0, state["cells"]).otherwise(put(state["cells"], f, -1)).alias("cells"),
            F.concat(state["taken"], f).alias("taken"), (F.size(f) == 0).alias("done"),
        )
        return F.when(state["done"], state).otherwise(F.element_at(F.transform(F.array(fresh), next_), 1))

    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(cells.alias("cells"), none.alias("taken"), F.lit(False).alias("done")),
        round_,
    )
    return F.element_at(
        F.transform(
            F.array(end),
            lambda s: F.when(
                ~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["x"] != 0)),
                net(F.transform(s["taken"], lambda e: F.struct(e["k"].alias("k"), e["s"].alias("s")))),
            ),
        ),
        1,
    )


def fingerprint(cells: Column) -> Column:
    """The cells as text: counts and xors in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.hex(c["n"]), F.lit(":"), F.hex(c["x"]))), ".")


def differences(pairs: DataFrame) -> DataFrame:
    """pair, n_differing: how many keys only one of ``keys_a`` and ``keys_b`` holds.

    ``pairs``: pair (unique), cells_a, cells_b (base sketches), keys_a, keys_b. Base sketches first; the pairs on which
    peeling sticks are dealt to larger ones.
    """
    tried = materialize(
        pairs.select("pair", "keys_a", "keys_b", peel(subtract(F.col("cells_a"), F.col("cells_b"))).alias("left")),
        "iblt-base",
    )
    found = tried.where("left is not null").select("pair", F.size("left").cast("long").alias("n_differing"))
    return found.unionByName(retried(tried.where("left is null")))


def retried(stuck: DataFrame) -> DataFrame:
    """pair, n_differing of pairs (pair, keys_a, keys_b) on which the base sketch stuck: the pairs, then the parts, are
    dealt to larger sketches until none is left."""
    found, k = [], 0
    both = F.size("keys_a") + F.size("keys_b")
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(both / PER_PART, F.lit(2.0))))).cast("int")
    entries = stuck.select(
        "pair", parts.alias("parts"), F.explode(F.concat(signed("keys_a", 1), signed("keys_b", -1))).alias("e")
    )
    while True:
        dealt = entries.groupBy("pair", F.pmod(F.xxhash64("e.k"), F.col("parts")).alias("part"), "parts").agg(
            F.collect_list("e").alias("es")
        )
        salt = k + 1
        sketched = put(empty_cells(), F.transform("es", lambda e: placed(e["k"], e["s"], salt)))
        left = F.transform(F.array(sketched), lambda cells: peel(cells, salt))[0]
        again = dealt.select("pair", "parts", "es", left.alias("left"))
        n = F.when(F.col("left").isNotNull(), F.size("left"))
        peeled = materialize(
            again.select("pair", "parts", n.alias("n"), F.when(F.col("left").isNull(), F.col("es")).alias("es")), "iblt-parts"
        )
        found.append(peeled.where("n is not null").groupBy("pair").agg(F.sum("n").alias("n")))
        stuck, k = peeled.where("n is null"), k + 1
        if stuck.isEmpty():
            break
        if k > MOST_RETRIES:
            raise RuntimeError(f"peeling stuck after {k} retries")
        entries = stuck.select("pair", (2 * F.col("parts")).alias("parts"), F.explode("es").alias("e"))
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    return total.groupBy("pair").agg(F.sum("n").cast("long").alias("n_differing"))


def signed(keys: str, sign: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("s")))


def likeness(n_a: Column, n_b: Column, n_differing: Column) -> Column:
    """Shared paragraphs over all paragraphs of two texts; 1.0 if neither has any."""
    union = (n_a + n_b + n_differing) / 2
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((union - n_differing) / union)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys, cells and the same of the next document (next_text, next_keys, next_cells), in descending
    order of doc_id; null ids come last, in the order of their texts' hashes.

    Rows are dealt to buckets of neighbouring ids (of hashes, for null ids); the head of each bucket is also put, as a
    guest, at the end of the bucket before it, and the first head at the end of the last. So one window per bucket finds
    all neighbours. Only texts are shuffled: keys and cells are made after that, once for each row.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = rows.agg(F.count("doc_id").alias("n"), F.count("*").alias("all"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    wanted = min(BOUNDS, math.ceil(counts["n"] / BUCKET_ROWS))
    cuts = rows.stat.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.001) if wanted > 1 else []
    cuts = sorted({int(c) for c in cuts})
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # Beyond BOUNDS * BUCKET_ROWS rows each range of ids is split evenly.
    split = max(1, math.ceil(counts["n"] / (BOUNDS * BUCKET_ROWS)))
    level = F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))
    ends = F.array(*[F.lit(int(x)).cast("long") for x in [(counts["a"] or 1) - 1, *cuts, counts["b"] or 0]])
    low, high = F.get(ends, level), F.get(ends, level + 1)
    inner = F.floor((F.col("doc_id") - low - 1) * split / F.greatest(high - low, F.lit(1)))
    level = level * split + F.least(F.greatest(inner, F.lit(0)), F.lit(split - 1)).cast("int")
    # Null ids: buckets below zero, the more so the larger the hash.
    without = max(1, math.ceil((counts["all"] - counts["n"]) / BUCKET_ROWS))
    spot = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    below = -1 - F.floor((spot / F.lit(2.0**64) + 0.5) * without).cast("long")
    bucket = F.when(F.col("doc_id").isNull(), F.greatest(below, F.lit(-without))).otherwise(level).cast("long")
    rows = rows.select("doc_id", "text", spot.alias("spot"), bucket.alias("bucket"))
    # One small row for each bucket.
    tops = materialize(rows.groupBy("bucket").agg(F.max("doc_id").alias("top"), F.min("spot").alias("top_spot")), "iblt-tops")
    first = (rows["bucket"] == tops["bucket"]) & rows["doc_id"].eqNullSafe(tops["top"]) & rows["spot"].eqNullSafe(tops["top_spot"])
    heads = rows.join(tops, first).groupBy(tops["bucket"], "doc_id", "spot").agg(F.min("text").alias("text"))
    down = Window.orderBy(F.col("bucket").desc())
    ahead = tops.select("bucket", F.lag("bucket").over(down).alias("host"), F.min("bucket").over(Window.partitionBy()).alias("last"))
    guests = heads.join(ahead.select("bucket", F.coalesce("host", "last").alias("host")), "bucket").select(
        "doc_id", "text", "spot", F.col("host").alias("bucket"), F.lit(True).alias("guest")
    )
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition("bucket")
    keyed = dealt.select("*", keys_of(F.col("text")).alias("keys"))
    keyed = keyed.select("*", sketch(F.col("keys")).alias("cells"))
    near = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("spot"), F.col("text"))
    ahead = [F.lead(c).over(near).alias("next_" + c) for c in ("text", "keys", "cells")]
    return keyed.select("doc_id", "text", "keys", "cells", "guest", *ahead).where("not guest").drop("guest")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its
    last floor(n_chars / 2) code points replaced by as many from the start of the next document.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    paired = with_next(docs).select("*", n.cast("long").alias("n_chars"), edited.alias("edited"))
    keyed = paired.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "keys", "cells", "next_keys", "next_cells",
        keys_of(F.col("edited")).alias("edited_keys"),
    )
    left = lambda other: F.size(peel(subtract(F.col("cells"), F.col(other))))
    differ = lambda other: F.transform(F.array(left(other)), lambda n: F.when(n >= 0, n).cast("long"))[0]
    sketched = keyed.select("*", sketch(F.col("edited_keys")).alias("edited_cells"))
    tried = materialize(
        sketched.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "edited_sha256",
            fingerprint(F.col("cells")).alias("fingerprint"), fingerprint(F.col("edited_cells")).alias("edited_fingerprint"),
            "keys", "edited_keys", "next_keys", differ("edited_cells").alias("d_edited"), differ("next_cells").alias("d_next"),
        ),
        "iblt-tried",
    )
    pair = lambda kind, name: tried.where(f"d_{name} is null").select(
        F.struct("row", F.lit(kind).alias("kind")).alias("pair"), F.col("keys").alias("keys_a"), F.col(f"{name}_keys").alias("keys_b")
    )
    found = materialize(retried(pair(0, "edited").unionByName(pair(1, "next"))), "iblt-found")
    by_row = found.groupBy("pair.row").agg(
        F.max(F.when(F.col("pair.kind") == 0, F.col("n_differing"))).alias("r_edited"),
        F.max(F.when(F.col("pair.kind") == 1, F.col("n_differing"))).alias("r_next"),
    )
    return tried.join(by_row, "row", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.size("keys"), F.size("edited_keys"), F.coalesce("d_edited", "r_edited")).alias("near_edited"),
        likeness(F.size("keys"), F.size("next_keys"), F.coalesce("d_next", "r_next")).alias("near_next"),
    )
