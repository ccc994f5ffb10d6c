"""Benchmark decontamination with DataFrame operations: a broadcast hash set of test n-grams against all token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlog.llm.common import own_name, stored, text_keys

#: Fixed values of the contamination rule.
SIZE = 13
WORD_LOWERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: n-grams in one broadcast. A row has a gram of at most LONG_GRAM bytes and numbers, under 400 bytes in the hash table, so one
#: broadcast stays under 100 MB, whatever the items hold. More grams go in blocks.
GRAMS_PER_BROADCAST = 250_000
#: Longer grams are verified by their SHA-256.
LONG_GRAM = 256
#: Rows of fixed size (at most some 200 bytes) that may be broadcast in place of a shuffle; counted before.
ROWS_TO_BROADCAST = 250_000


def words_of(text: F.Column) -> F.Column:
    """The text's words, A-Z not yet lowered; null has none."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def lowered(words: F.Column) -> F.Column:
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows of ``benchmark`` (item_id, text) by item: size, gram (its lowered words), item.

    A window is 13 consecutive words, or all words of an item that has fewer; items without words have none. A null
    item_id marks words but is not among the items. Ids are kept as strings, repeated ids once.
    """
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.split(F.translate(F.array_join(words_of(F.col("text")), " "), UPPER, LOWER), " ").alias("words"))
    words = words.filter(F.col("words")[0] != "")
    size = F.least(F.size("words"), F.lit(SIZE))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))
    return words.select("item", size.alias("size"), F.explode(grams).alias("gram")).select("size", "gram", "item").distinct()


def grams_of(windows: DataFrame) -> DataFrame:
    """One row for each gram of ``windows``: size, gram, key (hash of its words), item_list.

    ``item_list`` stands for the set of items that hold the gram, 128 bits and a count; windows of equal sets share it.
    """
    parts = [F.bit_xor(F.xxhash64(F.lit(1), "item")), F.bit_xor(F.xxhash64(F.lit(2), "item")), F.count("item")]
    named = windows.filter("item is not null").groupBy("size", "gram").agg(F.concat_ws(":", *(p.cast("string") for p in parts)).alias("named_list"))
    every = windows.select("size", "gram").distinct().join(named, ["size", "gram"], "left")
    key = F.xxhash64(F.transform(F.split("gram", " "), lambda w: F.lower(w)), F.col("size"))
    return every.select("size", "gram", key.alias("key"), F.coalesce("named_list", F.lit("0:0:0")).alias("item_list"))


def verified_by(gram: F.Column) -> F.Column:
    """The gram, or its SHA-256 behind a blank, with which no gram begins."""
    return F.when(F.octet_length(gram) <= LONG_GRAM, gram).otherwise(F.concat(F.lit(" "), F.sha2(gram.cast("binary"), 256)))


def find_hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc rows with the words that test windows cover: doc_id, key_a, key_b, copies, n_words, spans (array of start and size), item_lists.

    Every window of every document is hashed on its lower-case words and probes the broadcast set; a hit is then
    verified word for word. One more element of each document's array meets a marker row of the set, so a document without
    hits also comes through and nothing is joined back. Rows are then grouped by document, with map-side aggregation.
    ``grams`` is read several times and should be a written table. Its blocks, of rows of bounded size, make one pass over the documents each.
    """
    lengths = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most 13 values
    n_grams = grams.count()
    blocks = max(1, -(-n_grams // GRAMS_PER_BROADCAST))

    tokens = docs.select(F.col("doc_id"), *text_keys(F.col("text")), words_of(F.col("text")).alias("words"))

    def keys(low: F.Column, size: int) -> F.Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(low) - size + 1), lambda i: F.xxhash64(F.slice(low, i, size), F.lit(size)))
        return F.when(F.size(low) >= size, windows).otherwise(F.array().cast("array<bigint>"))

    marker = 0x5BD1E995
    # the lowered words are bound to a lambda variable: inlined into the inner lambda they would be made anew for every window
    bound = F.array(F.transform("words", lambda w: F.lower(w)))
    hashes = F.flatten(F.transform(bound, lambda low: F.concat(F.array(F.lit(marker).cast("bigint")), *(keys(low, s) for s in lengths))))
    hashed = tokens.select("doc_id", "key_a", "key_b", "words", F.size("words").alias("n_words"), hashes.alias("hashes"))
    each = hashed.select("doc_id", "key_a", "key_b", "words", "n_words", F.posexplode_outer("hashes").alias("place", "key"))  # never empty; a plain posexplode would make the array twice, once for a filter
    # place 0 is the marker; then come the windows of the first size, of the second, and so on
    at = F.col("place")
    start = F.lit(0)
    before = F.lit(1)
    for s in lengths:
        start = F.when(F.col("size") == s, at - before).otherwise(start)
        before = before + F.greatest(F.col("n_words") - s + 1, F.lit(0))

    spark = docs.sparkSession
    none = spark.range(1).select(F.lit(0).alias("size"), F.lit("").alias("check"), F.lit(marker).cast("bigint").alias("key"), F.lit(None).cast("string").alias("item_list"))
    found = None
    for block in range(blocks):
        part = grams if blocks == 1 else grams.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block)
        part = part.select("size", verified_by(F.col("gram")).alias("check"), "key", "item_list").unionByName(none)
        hits = each.join(F.broadcast(part), "key").withColumn("start", start)
        marks = (F.col("size") == 0) & (F.col("place") == 0)
        same = (F.col("size") > 0) & (F.col("place") > 0) & (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))
        same = same & (verified_by(lowered(F.expr("slice(words, start + 1, size)"))) == F.col("check"))
        hits = hits.filter(marks | same).select("doc_id", "key_a", "key_b", "n_words", F.when(F.col("size") > 0, F.struct("start", "size")).alias("span"), "item_list", marks.cast("int").alias("copy") if block == 0 else F.lit(0).alias("copy"))
        found = hits if found is None else found.unionByName(hits)
    grouped = found.groupBy("doc_id", "key_a", "key_b", "n_words").agg(F.sum("copy").alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item_list")).alias("item_lists"))
    return grouped.select("doc_id", "key_a", "key_b", "copies", "n_words", "spans", "item_lists")


def items_of(sets: DataFrame, windows: DataFrame, grams: DataFrame) -> DataFrame:
    """One row of fixed size for each of ``sets`` (set_key, item_lists): set_key, n_items, items_sha256.

    Each list is read once, from one gram that has it; only the ids that one row's digest is made of meet in a task.
    """
    one = grams.groupBy("item_list").agg(F.min(F.struct("size", "gram")).alias("g")).select("item_list", "g.size", "g.gram")
    wanted = sets.select("set_key", F.explode("item_lists").alias("item_list"))
    lists = one.join(wanted.select("item_list").distinct(), "item_list").join(windows.filter("item is not null"), ["size", "gram"]).select("item_list", "item")
    each = wanted.join(lists, "item_list").select("set_key", "item").distinct()
    ids = each.groupBy("set_key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return ids.select("set_key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))


def maybe_broadcast(rows: DataFrame) -> DataFrame:
    """A written table of rows of fixed size: broadcast if it is small by count, else left to a shuffle join, which AQE splits."""
    return F.broadcast(rows) if rows.count() <= ROWS_TO_BROADCAST else rows


def covered(spans: str = "spans") -> F.Column:
    """Number of words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, span):
        stop = span["start"] + span["size"]
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["n"] + F.greatest(stop - F.greatest(acc["end"], span["start"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"].cast("long"))


def is_contaminated() -> F.Column:
    return (covered() > 0) & (covered() * 20 >= F.col("n_words").cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of a window of ``benchmark``; a document is contaminated if hit words are at least
    a twentieth of its words. Null texts have no words. Repeated rows give repeated results, empty tables give no hits or
    no rows, other columns are ignored, null ids stand for themselves. Item ids stay out of the broadcast and of the documents'
    rows: documents with the same lists of items share one digest, made once and joined back.
    """
    windows = stored(benchmark_windows(benchmark), "windows")
    grams = stored(grams_of(windows), "grams")
    lists_key = F.when(F.size("item_lists") > 0, F.sha2(F.array_join("item_lists", ",").cast("binary"), 256))
    hits = stored(find_hits(docs, grams).withColumn("set_key", lists_key), "hits")
    sets = hits.filter("set_key is not null").groupBy("set_key").agg(F.first("item_lists").alias("item_lists"))
    items = stored(items_of(sets, windows, grams), "items")
    # rows without hits get keys of their own, that meet nothing
    own = hits.withColumn("set_key", F.coalesce("set_key", F.col("key_a").cast("string")))
    return own.join(maybe_broadcast(items), "set_key", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered().alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        "key_a",
        "key_b",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; a null or empty text is clean.

    Equal texts stay or go together, so a text's key is what is removed: no text is shuffled while those keys are few.
    """
    a, b = own_name(docs, "_a"), own_name(docs, "_b")
    hits = find_hits(docs, stored(grams_of(benchmark_windows(benchmark)), "grams"))
    bad = stored(hits.filter(is_contaminated()).select(F.col("key_a").alias(a), F.col("key_b").alias(b)).distinct(), "bad")
    key_a, key_b = text_keys(docs["text"])
    return docs.join(maybe_broadcast(bad), (key_a == bad[a]) & (key_b == bad[b]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and text of every row of ``docs``, hit words (and what lies between them and the next word) cut out.

    Repeated rows are cut alike and stay repeated, a null text stays null, an empty table gives no rows, an empty benchmark cuts nothing.
    """
    found = find_hits(docs, stored(grams_of(benchmark_windows(benchmark)), "grams")).filter(F.size("spans") > 0)
    hits = found.groupBy("key_a", "key_b").agg(F.first("spans").alias("spans"))  # equal texts have equal spans
    key_a, key_b = text_keys(docs["text"])
    joined = docs.select("doc_id", "text").join(hits, (key_a == hits["key_a"]) & (key_b == hits["key_b"]), "left")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?:{WORD})(?:[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)"), F.lit(0))
    head = F.regexp_extract("text", "^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*", 0)
    kept = F.filter(pieces, lambda w, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["start"] + s["size"])))
    return joined.select("doc_id", F.when(F.size("spans") > 0, F.concat(head, F.array_join(kept, ""))).otherwise(F.col("text")).alias("text"))
