"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Texts become words and every five consecutive words a hash. Of the six hashes within ten words
the least is the fingerprint of that ten-word window: equal windows have equal fingerprints, so
no shared span of ten words escapes. A bitmap of the benchmark's fingerprints, of SPREAD bits
for each and 2^MOST_BITS (8 MB) at most, drops most windows within the scan; what passes is
joined with the benchmark's windows on the words themselves, so a hit is exact, whatever the
bitmap lets through. Items of fewer than ten words are one window of their own
length, whose hash goes through the same bitmap.

Only windows that pass the bitmap are shuffled. A window that many documents share is a hot
join key, which adaptive execution splits; identical items count as one class until the end.

Defined results: null or wordless texts have no words and no hits; wordless items have no
window; every document row gives one row, repeats included; items that repeat an id count
once, and those with a null id are not listed; an empty benchmark gives no hits; other columns
are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgrain.llm.common import lower_ascii, materialize

WINDOW, GRAM = 10, 5
#: Bits of the bitmap, as powers of two, and for each fingerprint.
BITS, MOST_BITS, SPREAD = 20, 26, 32
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAKS), "")


def _from(array: Column, k: int) -> Column:
    return F.slice(array, k + 1, F.size(array))


def _grams(hashes: Column, n: int) -> Column:
    """The hash of the n hashes from each place on; the last n - 1 are of fewer and match nothing but by chance."""
    return reduce(lambda acc, k: F.zip_with(acc, _from(hashes, k), lambda a, b: F.xxhash64(a, b)), range(1, n), hashes)


def _least(array: Column, n: int) -> Column:
    """The least of the n values from each place on."""
    have = 1
    while have < n:
        step = min(have, n - have)
        array, have = F.zip_with(array, _from(array, step), lambda a, b: F.least(a, b)), have + step
    return array


def _with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds word hashes, then for each window length an array w<n> with the fingerprint of the window that starts at each word."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    for n in lengths:
        if n == WINDOW:
            df = df.withColumn("grams", _grams(F.col("hashes"), GRAM)).withColumn(f"w{n}", _least(F.col("grams"), WINDOW - GRAM + 1)).drop("grams")
        else:
            df = df.withColumn(f"w{n}", _grams(F.col("hashes"), n))
    return df


def bits_for(prints: int) -> int:
    return min(max((SPREAD * prints - 1).bit_length(), BITS), MOST_BITS)


def _bitmap(prints: DataFrame, bits: int) -> DataFrame:
    """One row with an array of 2^(bits - 6) longs; the bit that the lowest bits of each print name is set."""
    cells = 1 << (bits - 6)
    place = F.col("print").bitwiseAND(F.lit((1 << bits) - 1))
    set_bits = prints.groupBy(F.shiftright(place, 6).cast("int").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(print & {63} as int))")).alias("bits"))
    every = prints.sparkSession.range(0, cells, 1, 1).select(F.col("id").cast("int").alias("cell"))
    return every.join(set_bits, "cell", "left").agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all")).select(F.col("all.bits").alias("bitmap"))


def windows_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The benchmark's (class, n, at, window) and (class, item_id): items with the same words are one class."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("class", F.sha2(F.array_join("words", " "), 256))
    classes = items.groupBy("class").agg(F.any_value("words").alias("words"))
    size = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.size("words") - size)
    windows = classes.select("class", "words", size.alias("n"), F.explode(starts).alias("at"))
    return windows.select("class", "n", "at", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("window"), "words"), items.select("class", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    windows, members = windows_of(benchmark)
    windows = materialize(windows, "benchmark-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # 1 to WINDOW at most

    items = _with_hashes(windows.dropDuplicates(["class"]).select("n", "words"), lengths)
    prints = reduce(DataFrame.unionByName, [items.where(F.col("n") == n).select(F.explode(f"w{n}").alias("print")) for n in lengths], windows.sparkSession.createDataFrame([], "print long")).distinct()
    prints = materialize(prints, "benchmark-prints")
    bits = bits_for(prints.count())
    bitmap = materialize(_bitmap(prints, bits), "benchmark-bitmap")

    def passing(n: int) -> Column:
        starts = F.array_compact(F.transform(F.slice(f"w{n}", 1, F.greatest(F.size("words") - n + 1, F.lit(0))), lambda h, i: F.when(_bit(h), i)))
        return F.transform(starts, lambda s: F.struct(s.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("words", s + 1, n), " ").alias("window")))

    def _bit(h: Column) -> Column:
        cell = F.shiftright(h.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int")
        word = F.get(F.col("bitmap"), cell)
        return F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    scanned = _with_hashes(docs.select("doc_id", words_of(F.col("text")).alias("words")), lengths).withColumn("bitmap", bitmap.scalar())
    found = F.concat(*[passing(n) for n in lengths]) if lengths else F.expr("cast(array() as array<struct<at:int,n:int,window:string>>)")
    rows = materialize(scanned.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"), found.alias("found")), "decontam-scan")

    known = windows.select("window").distinct()
    hits = rows.select("row", F.inline("found")).join(known, "window")
    hits = materialize(hits, "decontam-hits")
    order = W.partitionBy("row").orderBy("at", "n").rowsBetween(W.unboundedPreceding, -1)
    upto = F.col("at") + F.col("n")
    covered = hits.select("row", F.greatest(upto - F.greatest("at", F.coalesce(F.max(upto).over(order), F.lit(0))), F.lit(0)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = hits.select("row", "window").distinct().join(windows.select("window", "class").distinct(), "window").select("row", "class").distinct().join(members, "class")
    named = named.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    out = rows.select("doc_id", "row", "n_words").join(covered, "row", "left").join(named, "row", "left")
    ids = F.coalesce("item_ids", F.expr("cast(array() as array<string>)"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
