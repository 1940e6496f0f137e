"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

An item of a benchmark leaks into a text where a window of the item's size is similar to it: weighted
Jaccard similarity (each shingle weighs as often as it occurs) of five-word shingles of at least 0.8. Words
are runs of letters and digits in lower case. A text shorter than an item is one window for it.

1. *Anchors.* Texts are probed at every ``stride``-th shingle for shingles of the benchmark. A similar window
   differs from its item in so few places that no stride this long can step over all the others.
2. *Windows.* In texts with an anchor, all windows of item size are laid out that hold enough shingles of items
   of that size; equal windows are one from here on.
3. *SimHash.* Windows and items get 64-bit fingerprints: the sign, bit by bit, of the summed shingle hashes.
4. *Multi-index Hamming blocks.* Fingerprints are cut into ``blocks``; two that differ in at most ``radius`` bits differ
   in at most radius // blocks bits of some block. Items are listed under all such variants of their
   blocks, so the join by block finds every pair within the radius.
5. *Verification.* The exact similarity of the pairs within the radius decides.

Only DataFrame functions are used. The fingerprint is the one step that can lose a pair: at similarity
0.8 the distance is about 9.7 bits with a deviation of 2.9, so a radius of 20 misses fewer than one
in a thousand such windows, and none that are equal.

Null texts count as empty. Texts and items without a word match nothing; those of fewer than five words are
one shingle. Repeated rows and items each match. Rows with a null doc_id are searched too. Other columns
are dropped. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.scratch import materialize

#: Rows of two numbers that are sent to every task at most; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
WIDTH = 5
BITS = 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(rows: DataFrame, keys: list[str], name: str, stride: int = 1) -> DataFrame:
    """``keys`` and hashes of the word runs that begin at every ``stride``-th word; a short text is one run.

    The words are a column of their own, so that they are cut once and not for each run.
    """
    own, last = F.col("_words"), F.size("_words") - WIDTH
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), lambda i: F.xxhash64(F.slice(own, i + 1, WIDTH)))
    return rows.select(*keys, words(F.col("text")).alias("_words")).select(
        *keys, F.when(F.size(own) > 0, many).otherwise(F.array().cast("array<bigint>")).alias(name))


def longest_stride(sizes: list[int], percent: int) -> int:
    """The longest stride that meets an unchanged shingle in every window similar to an item.

    A window of w shingles shares at least p (w + n) / (100 + p) with an item of n >= w, so it has at most
    w - that of its own.
    """
    windows = {(w, n) for n in sizes for w in range(-(-percent * n // 100), n + 1)}
    fits = [s for s in range(1, 9) if all(w // s > w - -(-percent * (w + n) // (100 + percent)) for w, n in windows)]
    return max(fits, default=1)


def fingerprints(contents: DataFrame, keys: list[str]) -> DataFrame:
    """The SimHash of each row's ``content``, an array of shingle hashes; ``keys`` name the row."""
    bits = contents.select(*keys, F.explode("content").alias("h")).groupBy(*keys).agg(
        *(F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{b}") for b in range(BITS)))
    ones = [F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    return bits.select(*keys, reduce(Column.bitwiseOR, ones).alias("print"))


def block_rows(prints: DataFrame, blocks: int, flips: int) -> DataFrame:
    """``prints`` with block and value, for every value that ``flips`` changed bits can give the block."""
    width = BITS // blocks
    masks = [m for m in range(1 << width) if bin(m).count("1") <= flips]
    value = F.call_function("shiftrightunsigned", F.col("print"), F.col("block") * width).bitwiseAND(F.lit((1 << width) - 1))
    rows = prints.withColumn("block", F.explode(F.array(*(F.lit(b) for b in range(blocks)))))
    return rows.withColumn("value", F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: value.bitwiseXOR(m))))


def weighted_overlap(a: Column, b: Column) -> Column:
    """Shingles that two arrays share, each as often as in the array that has fewer of it."""
    times = lambda own, x: F.size(F.filter(own, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def anchored(docs: DataFrame, vocabulary: DataFrame, stride: int, small: bool) -> DataFrame:
    """doc_id and check of the texts with a probed shingle in ``vocabulary`` (h).

    ``explode_outer``, as for ``explode`` Spark puts a filter on the array below the cutting into words,
    which then cuts anew for every run.
    """
    probes = shingles(docs, ["doc_id", "check"], "hashes", stride).select("doc_id", "check", F.explode_outer("hashes").alias("h"))
    return probes.join(F.broadcast(vocabulary) if small else vocabulary, "h", "left_semi").select("doc_id", "check").distinct()


def same_text(a: str, b: str) -> Column:
    """Whether rows of ``a`` and ``b`` are one text of one doc_id, told by the hash ``check``: a doc_id alone may be null or repeated."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.check") == F.col(f"{b}.check"))


def windows(texts: DataFrame, index: DataFrame, percent: int, small: bool) -> DataFrame:
    """(row, n, start, size): windows of ``size`` shingles that hold enough shingles of items of n shingles.

    ``texts`` has row and hashes; ``index`` (h, n) has the shingles of the items by size.
    """
    hits = (
        texts.select("row", F.size("hashes").alias("all"), F.posexplode("hashes").alias("pos", "h"))
        .join(F.broadcast(index) if small else index, "h")
        .groupBy("row", "n", "all").agg(F.sort_array(F.collect_list("pos")).alias("at")))
    size = F.least("n", "all")
    needed = F.ceil(F.lit(percent) * (size + F.col("n")) / (100 + percent)).cast("int")
    hits = hits.withColumn("size", size).withColumn("needed", needed).where(F.size("at") >= F.col("needed"))

    def starts(i: Column) -> Column:
        first, last = F.get("at", i), F.get("at", i + F.col("needed") - 1)
        low, high = F.greatest(last - F.col("size") + 1, F.lit(0)), F.least(first, F.col("all") - F.col("size"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    found = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("needed")), starts)))
    return hits.select("row", "n", "size", F.explode(found).alias("start"))


def checked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``check``, a hash of the text."""
    return docs.withColumn("check", F.xxhash64("text"))


def contaminations(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, windows, first_word, similarity: each text and item with similar windows.

    ``windows`` is their number, ``similarity`` the best of them, ``first_word`` the first word of the first.
    """
    return leaks(docs, benchmark, **options).drop("check")


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, percent: int = 80, radius: int = 20, blocks: int = 8,
) -> DataFrame:
    """``contaminations`` with ``check`` beside the doc_id, so that a text can be told from others of its doc_id."""
    if BITS % blocks:
        raise ValueError("blocks must divide 64")
    items = materialize(shingles(benchmark, ["item_id"], "content"))
    items = materialize(items.where(F.size("content") > 0).withColumn("n", F.size("content")).withColumn("item", F.monotonically_increasing_id()))
    index = materialize(items.select(F.explode("content").alias("h"), "n").distinct())
    small = index.count() <= BROADCAST_ROWS
    sizes = [r.n for r in items.select("n").distinct().collect()]  # lengths, not items
    stride = longest_stride(sizes, percent)
    docs = checked(docs.select("doc_id", "text"))
    near = materialize(anchored(docs, index.select("h").distinct(), stride, small))
    held = docs.alias("d").join(near.alias("a"), same_text("d", "a"), "left_semi")
    texts = materialize(shingles(held, ["doc_id", "check"], "hashes").withColumn("row", F.monotonically_increasing_id()))
    laid = windows(texts, index, percent, small).join(texts, "row").select(
        "doc_id", "check", "row", "n", "start", F.slice("hashes", F.col("start") + 1, F.col("size")).alias("content"))
    laid = materialize(laid.withColumn("key", F.xxhash64("content")))
    contents = materialize(laid.groupBy("n", "key").agg(F.first("content").alias("content")))
    flips = radius // blocks
    probes = block_rows(fingerprints(contents, ["n", "key"]), blocks, 0)
    listed = block_rows(fingerprints(items, ["n", "item"]), blocks, flips).withColumnRenamed("print", "item_print")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    pairs = probes.join(listed, ["n", "block", "value"]).where(distance <= radius).select("n", "key", "item").distinct()
    overlap = weighted_overlap(F.col("content"), F.col("item_content"))
    union = F.size("content") + F.size("item_content") - overlap
    similar = materialize(
        pairs.join(contents, ["n", "key"]).join(items.select("item", "item_id", F.col("content").alias("item_content")), "item")
        .withColumn("overlap", overlap).withColumn("union", union)
        .where(100 * F.col("overlap") >= percent * F.col("union"))
        .select("n", "key", "item", "item_id", F.round(F.col("overlap") / F.col("union"), 6).alias("similarity")))
    return (
        laid.select("doc_id", "check", "row", "n", "start", "key").join(similar, ["n", "key"]).groupBy("row", "doc_id", "check", "item", "item_id")
        .agg(F.count("*").alias("windows"), F.min("start").cast("int").alias("first_word"), F.max("similarity").alias("similarity"))
        .drop("row", "item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a similar window; other texts of their doc_id stay."""
    found = materialize(leaks(docs, benchmark, **options).select("doc_id", "check").distinct())
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.check"))
    return docs.alias("d").join(found.alias("f"), same, "left_anti")
