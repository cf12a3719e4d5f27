"""Benchmark decontamination by winnowing, in built-in expressions only.

Of the hashes of K consecutive words, the least in each window of W = 13 - K + 1 is a fingerprint. So
any 13 words that a text shares with a benchmark item share a fingerprint, wherever they stand.
Fingerprints of both sides are joined; each hit is then extended over the words around it, which
compares the words themselves, to all shared windows of 13 that hold it. Items of fewer words are
one window; for the lengths that such items have, every word sequence of that length is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import shared_dir, stored

#: Words of a window, and of a gram.
WINDOW, GRAM = 13, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A-Z lower-cased; runs of a-z, 0-9 and everything beyond ASCII."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""), F.expr("CAST(array() AS array<string>)"))


def grams(hashed: Column, n: int) -> Column:
    """Hashes of every n consecutive words, from the words' hashes."""
    from_to = F.sequence(F.lit(0), F.size(hashed) - n)
    each = F.transform(from_to, lambda i: F.xxhash64(F.lit(n), *[F.get(hashed, i + j) for j in range(n)]))
    return F.when(F.size(hashed) >= n, each).otherwise(F.expr("CAST(array() AS array<bigint>)"))


def fingerprints(g: Column, w: int) -> Column:
    """The least of every w grams, or of all if there are fewer."""
    least = F.transform(F.sequence(F.lit(1), F.greatest(F.size(g) - w + 1, F.lit(1))), lambda i: F.array_min(F.slice(g, i, w)))
    return F.when(F.size(g) > 0, F.array_distinct(least)).otherwise(g)


def version(text: Column) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(text, F.length(text))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, version) of every row.

    n_hit: words inside an occurrence of an item's window; contaminated: they are at least 5 % of the
    words. Null or wordless texts and items have no words and no windows. Repeated rows stay rows, and rows of
    one doc_id are judged each by its own text (version); a null doc_id is as good as any. Repeated items count
    once. An empty benchmark leaves everything clean, an empty table of documents gives an empty result.
    Other columns are not read.
    """
    spark = docs.sparkSession
    work = shared_dir(spark, "decontam")
    w = window - gram + 1
    text = F.col("text").cast("string")
    docs = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("anon"), text.alias("text"), version(text).alias("version"))
    row = ["doc_id", "anon", "version"]

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("words")).where("size(words) > 0").distinct()
    items = stored(items.withColumn("n", F.size("words")), f"{work}/items")
    short = sorted(r["n"] for r in items.where(f"n < {window}").select("n").distinct().collect())  # at most 12 lengths
    hashed = F.transform("words", lambda x: F.xxhash64(x))

    # Every gram of a long item, with the words that its windows can reach; a short item as a whole.
    at = F.posexplode(grams(F.col("h"), gram))
    reach = window - gram
    long = items.where(f"n >= {window}").withColumn("h", hashed).select("item_id", "words", "n", at.alias("at", "gram"))
    long = long.select("item_id", "gram", F.lit(gram).alias("size"), F.lit(window).alias("wide"), F.least("at", F.lit(reach)).alias("before"), F.slice("words", F.greatest(F.col("at") - reach, F.lit(0)) + 1, F.least("at", F.lit(reach)) + window).alias("item"))
    table = long
    for n in short:
        whole = items.where(f"n = {n}").withColumn("h", hashed).select("item_id", F.element_at(grams(F.col("h"), n), 1).alias("gram"), F.lit(n).alias("size"), F.lit(n).alias("wide"), F.lit(0).alias("before"), F.col("words").alias("item"))
        table = table.unionByName(whole)
    # A passage that many items have is one row, with the set of them: a document meets the passage, not each item.
    place = ["gram", "size", "wide", "before", "item"]
    table = table.groupBy(*place).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    table = stored(table.withColumn("of", F.sha2(F.array_join("items", ","), 256)), f"{work}/grams")
    sets = stored(table.select("of", "items").distinct(), f"{work}/sets")

    each = docs.select(*row, words_of(F.col("text")).alias("words"))
    each = each.select(*row, F.size("words").cast("long").alias("n_words"), hashed.alias("h"))
    # An array that a lambda reads is a column of its own, or it would be made anew for each element.
    each = each.withColumn("g", grams(F.col("h"), gram))
    each = each.select(*row, "n_words", "h", fingerprints(F.col("g"), w).alias("g"))
    if short:
        each = each.withColumn("g", F.array_distinct(F.concat("g", *[grams(F.col("h"), n) for n in short])))
    each = each.select(*row, "n_words", F.posexplode_outer("g").alias("i", "gram"))
    met = each.join(table.select("gram").distinct().withColumn("met", F.col("gram")), "gram", "left")
    met = stored(met.groupBy(*row).agg(F.max("n_words").alias("n_words"), F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("times"), F.collect_set("met").alias("met")), f"{work}/met")

    hit = docs.join(met.where("size(met) > 0").select(*row, "met"), row).dropDuplicates(row)
    hit = hit.select(*row, "met", words_of(F.col("text")).alias("words")).withColumn("h", hashed)
    found = None
    for n in [gram] + [x for x in short if x != gram]:
        own = hit.select(*row, "met", "words", F.posexplode(grams(F.col("h"), n)).alias("at", "gram")).where(F.array_contains("met", F.col("gram")))
        own = own.select(*row, "gram", "at", F.lit(n).alias("size"), F.least("at", F.lit(reach)).alias("left"), F.slice("words", F.greatest(F.col("at") - reach, F.lit(0)) + 1, F.least("at", F.lit(reach)) + window).alias("near"))
        found = own if found is None else found.unionByName(own)
    pair = found.join(table.drop("items"), ["gram", "size"])
    back = F.sequence(F.lit(0), F.when(F.col("wide") == F.col("size"), F.lit(0)).otherwise(F.least("left", "before", F.lit(reach))))
    starts = F.filter(
        F.transform(back, lambda j: F.when((F.slice("near", F.col("left") - j + 1, F.col("wide")) == F.slice("item", F.col("before") - j + 1, F.col("wide"))) & (F.size(F.slice("near", F.col("left") - j + 1, F.col("wide"))) == F.col("wide")), F.col("at") - j)),
        lambda x: x.isNotNull(),
    )
    hits = stored(pair.select(*row, "of", F.explode(starts).alias("start"), "wide").distinct(), f"{work}/hits")
    # Ends are found per start: the widest window counts; a word is hit once.
    wide = hits.groupBy(*row, "start").agg(F.max("wide").alias("wide"))
    spans = wide.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("wide")).alias("end")))).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    n_hit = F.aggregate("s", zero, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")), lambda a: a["n"])
    # The items of every combination of sets are put together once, not for each document.
    who = stored(hits.groupBy(*row).agg(F.array_join(F.array_sort(F.collect_set("of")), ",").alias("all")), f"{work}/who")
    union = who.select("all").distinct().select("all", F.explode(F.split("all", ",")).alias("of")).join(sets, "of")
    union = union.select("all", F.explode("items").alias("item")).groupBy("all").agg(F.array_sort(F.collect_set("item")).alias("items"))
    union = union.select("all", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    both = spans.select(*row, n_hit.alias("n_hit")).join(who, row).join(union, "all").drop("all")
    out = met.select(*row, "n_words", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).join(both, row, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.when(~F.col("anon"), F.col("doc_id")).alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "version",
    )
