"""Benchmark decontamination by spaced-seed hashing.

A fixed mask lays over consecutive words and ignores those at its zeros, so a seed survives substitutions
there. The two masks used are such that any 13 aligned words of which at most two differ share a seed (four
shorter ones do the same for items of 5 to 12 words with one word in five substituted). The texts' seeds are
joined with the benchmark's, and each hit is verified on the words around it: an overlap counts if, aligned, at
least 80 % of 13 words (of all words of a shorter item) agree.

All of it is DataFrame functions. A bit table over the benchmark's seeds, bounded by a parameter, drops most
seeds of a text before they become rows; what is dropped cannot match. The benchmark side is broadcast only
below a checked size and otherwise joined by a shuffle.

Defined results: null and empty texts, and texts or items of fewer than five words, overlap with nothing;
words are maximal runs of letters and digits in lower case; repeated rows count once; an empty table on either
side gives an empty result; equal items are each reported; very long texts are read whole; other columns pass through
remove_overlapping whatever their names, and take no part in find_overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import held, staged, table

#: Seeds for items of at least WINDOW words, and for shorter ones.
MASKS = ("11101011", "11001111")
SHORT_MASKS = ("1111", "11011", "11101", "10111")
#: Words that must align, the share of them that must agree, and the fewest words of an item.
WINDOW, AGREE, LEAST_WORDS = 13, 0.8, 5
#: Bits of the table for each benchmark seed, and bits at most; beyond, it is only less selective.
BITS_PER_SEED, MOST_BITS_LOG2 = 32, 24
#: Benchmark seeds up to which their table is broadcast (about 0.4 kB each).
MOST_BROADCAST = 200_000


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(hashes: Column, at: Column, mask: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), *(F.get(hashes, at + i) for i, c in enumerate(mask) if c == "1"))


def _positions(size: Column, mask: str) -> Column:
    last = size - len(mask)
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _places(hashes: Column, size: Column, mask: str, number: int) -> Column:
    """All seeds of one mask with their places."""
    return F.transform(_positions(size, mask), lambda at: F.struct(_seed(hashes, at, mask, number).alias("seed"), at.alias("at")))


def _context(hashes: Column, at: Column) -> Column:
    """The words from WINDOW - 1 before the seed to as many behind it; null beyond the text."""
    reach = WINDOW - 1
    pad = F.array_repeat(F.lit(None).cast("long"), reach)
    longest = max(map(len, MASKS))
    return F.slice(F.concat(pad, hashes, pad, pad), at + 1, 2 * reach + longest)


def hashed_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, hashes and item_words of the items that are long enough."""
    items = held(benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text")), word_hashes(F.col("text")).alias("hashes"))
    return items.select("item_id", "hashes", F.size("hashes").alias("item_words")).filter(F.col("item_words") >= LEAST_WORDS)


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """One row for each mask and place of ``items``: seed, item_id, item_words, window, and the words around."""
    hashes, size = F.col("hashes"), F.col("item_words")
    lists = []
    for number, mask in enumerate((*MASKS, *SHORT_MASKS)):
        fits = size >= WINDOW if number < len(MASKS) else size < WINDOW
        places = F.transform(_places(hashes, size, mask, number), lambda p: F.struct(p["seed"].alias("seed"), p["at"].alias("item_at"), _context(hashes, p["at"]).alias("item_context")))
        lists.append(F.when(fits, places).otherwise(F.slice(places, 1, 0)))
    seeds = items.select("item_id", "item_words", F.explode(F.concat(*lists)).alias("s")).select("item_id", "item_words", "s.*")
    return seeds.withColumn("window", F.least(F.col("item_words"), F.lit(WINDOW)))


def _bit(seed: Column, bits_log2: int, which: int) -> Column:
    return F.shiftrightunsigned(seed, 64 - bits_log2) if which == 0 else seed.bitwiseAND(F.lit((1 << bits_log2) - 1).cast("long"))


def bit_table(seeds: DataFrame, bits_log2: int) -> DataFrame:
    """One row with one array: two bits set for each seed."""
    marks = seeds.select(F.explode(F.array(_bit(F.col("seed"), bits_log2, 0), _bit(F.col("seed"), bits_log2, 1))).alias("bit"))
    cells = marks.groupBy(F.shiftright("bit", 6).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    every = seeds.sparkSession.range(1 << (bits_log2 - 6)).select(F.col("id").cast("int").alias("cell"))
    full = every.join(cells, "cell", "left").select("cell", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "word"))), lambda c: c["word"]).alias("bits"))


def _is_set(bits: Column, bit: Column) -> Column:
    return F.get(bits, F.shiftright(bit, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int"))) != 0


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs: id, text_key, item_id, with hits, agreeing (most words that agree in one window), window, word_at."""
    # Items of the same words are one until the end: the least id stands for all.
    items = staged(hashed_items(benchmark), "benchmark-items")
    lead = items.groupBy("hashes").agg(F.min("item_id").alias("lead"))
    alike = items.join(lead, "hashes").select("item_id", "lead")
    seeds = staged(benchmark_seeds(lead.select(F.col("lead").alias("item_id"), "hashes", F.size("hashes").alias("item_words"))), "benchmark-seeds")
    count = seeds.count()
    short = seeds.filter(F.col("item_words") < WINDOW).limit(1).count() > 0
    bits_log2 = min(MOST_BITS_LOG2, max(12, (count * BITS_PER_SEED).bit_length()))
    bits = bit_table(seeds, bits_log2).scalar()

    keyed = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_key"))
    hashed = held(keyed, word_hashes(F.col("text")).alias("hashes")).drop("text").filter(F.size("hashes") >= LEAST_WORDS).withColumn("bits", bits)
    # A row for each place, whose seeds and bits are compiled code: lambdas are interpreted, element by element. Most places go at once.
    hashes, at = F.col("hashes"), F.col("at")
    placed = hashed.select("id", "text_key", "hashes", "bits", F.explode(F.sequence(F.lit(0), F.size("hashes") - 1)).alias("at"))
    seeds_here, marked = [], F.lit(False)
    for number, mask in enumerate((*MASKS, *SHORT_MASKS) if short else MASKS):
        seed = _seed(hashes, at, mask, number)
        known = (at + len(mask) <= F.size("hashes")) & _is_set(F.col("bits"), _bit(seed, bits_log2, 0)) & _is_set(F.col("bits"), _bit(seed, bits_log2, 1))
        marked = marked | known
        seeds_here.append(F.when(known, seed))
    found = placed.filter(marked).select("id", "text_key", "hashes", "at", F.explode(F.array_compact(F.array(*seeds_here))).alias("seed"))
    places = found.select("id", "text_key", "seed", "at", _context(hashes, at).alias("context"))

    hits = places.join(F.broadcast(seeds) if count <= MOST_BROADCAST else seeds, "seed")
    same = F.zip_with("context", "item_context", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    inside = F.transform("item_context", lambda b: b.isNotNull().cast("int"))
    hits = held(hits, same.alias("same"), inside.alias("inside"))
    # All windows that lie in the item: a running sum over the aligned words gives each one's agreeing words.
    begins = F.sequence(F.lit(1), F.size("same") - F.col("window") + 1)
    sums = F.transform(
        begins,
        lambda i: F.when(
            F.aggregate(F.slice("inside", i, F.col("window")), F.lit(0), lambda a, x: a + x) == F.col("window"),
            F.aggregate(F.slice("same", i, F.col("window")), F.lit(0), lambda a, x: a + x),
        ).otherwise(0),
    )
    best = hits.withColumn("agreeing", F.array_max(sums)).filter(F.col("agreeing") >= F.ceil(F.lit(AGREE) * F.col("window") - F.lit(1e-9)))
    pairs = best.groupBy("id", "text_key", F.col("item_id").alias("lead")).agg(
        F.count("*").alias("hits"), F.max("agreeing").cast("long").alias("agreeing"), F.max("window").cast("long").alias("window"), F.min("at").cast("long").alias("word_at")
    )
    every = pairs.join(alike, pairs["lead"].eqNullSafe(alike["lead"])).drop("lead")
    return every.select(F.col("id").alias(id_column), "text_key", "item_id", "hits", "agreeing", "window", "word_at")


def remove_overlapping(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap with an item; rows that share an id are judged by their own text."""
    found = find_overlaps(docs.select(id_column, text), benchmark, id_column, text).select(F.col(id_column).alias("id"), F.col("text_key").alias("key")).distinct()
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_column).alias("own_id"), F.xxhash64(F.col(text)).alias("own_key"))
    return marked.join(found, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_anti").select("row.*")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return find_overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"), F.max("window").alias("window"))
