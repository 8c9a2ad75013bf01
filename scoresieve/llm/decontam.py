"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprints are the k-gram hashes that are the least of some w consecutive ones. With
k + w - 1 = window, every run of `window` words holds w consecutive k-grams, so two texts that share such a
run share the fingerprint that is least in it. Hits are extended word by word to both sides; as each
window holds an anchor of its own, window - k words to each side are enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, after lower-casing.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 4
#: Fingerprints of the benchmark (about 250 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows that say how many words a document has are spread over so many join keys.
SPREAD = 1024


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS, -1), "")


def _paired(df: DataFrame, a: str, b: str, shift: int, out: str, f) -> DataFrame:
    """out[i] = f(a[i], b[i + shift]) wherever both exist."""
    n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), f))


def _fingerprints(df: DataFrame, pad: int) -> DataFrame:
    """Add ``marks``: an array of (len, f, p, near) for the winnowed k-grams of column ``ws``: of each window the first least one. near: hashes of the words around."""
    if (WINDOW, K) != (10, 4):
        raise ValueError("the passes below are laid out for windows of 10 words and 4-grams")
    hashed = lambda x, y: F.xxhash64(x, y)
    lesser = lambda x, y: F.least(x, y)
    side, span = WINDOW - K, WINDOW - K + 1
    df = df.withColumn("h", F.transform("ws", lambda x: F.xxhash64(x)))
    df = _paired(df, "h", "h", 1, "g2", hashed)
    df = _paired(df, "g2", "g2", 2, "g", hashed)  # 4-grams
    df = _paired(df, "g", "g", 1, "m2", lesser)
    df = _paired(df, "m2", "m2", 2, "m4", lesser)
    df = _paired(df, "m4", "m4", 3, "m7", lesser)  # least of each 7 consecutive 4-grams
    # The first place of a window's least 4-gram is the window's before unless the value changes, or the place leaves with a
    # value that occurs again. (A column used once, within a lambda, would be inlined there and computed for each element.)
    moved = lambda v, i: (i == 0) | (F.get("m7", i - 1) != v) | (F.get("g", i - 1) == v)
    places = F.transform("m7", lambda v, i: F.when(moved(v, i), (i + F.array_position(F.slice("g", i + 1, span), v) - 1).cast("int")))
    chosen = F.when(F.size("m7") > 0, F.filter(places, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("at", chosen).withColumn("hp", F.concat(F.array_repeat(F.lit(pad), side), "h", F.array_repeat(F.lit(pad), side)))
    mark = lambda i: F.struct(F.lit(0).alias("len"), F.get("g", i).alias("f"), i.alias("p"), F.slice("hp", i + 1, K + 2 * side).alias("near"))
    return df.withColumn("marks", F.when((F.size("hp") > 0) & (F.size("g") >= 0), F.transform("at", mark)))


def _whole(length: int) -> Column:
    """All runs of `length` words of column ``ws``, as marks without surroundings."""
    mark = lambda i: F.struct(F.lit(length).alias("len"), F.xxhash64(F.slice("ws", i + 1, length)).alias("f"), i.alias("p"), F.lit(None).cast("array<bigint>").alias("near"))
    return F.when(F.size("ws") >= length, F.transform(F.sequence(F.lit(0), F.size("ws") - length), mark)).otherwise(F.array().cast("array<struct<len:int,f:bigint,p:int,near:array<bigint>>>"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """What each document shares with the items of a benchmark.

    A window is 10 consecutive words of an item; an item of fewer words, but not none, is one window. A document's word
    is hit if it lies in an occurrence of a window. Returns one row for each row of docs: ``doc_id``, ``n_words``,
    ``n_hit``, ``n_items``, ``items_sha256`` (hex digest of the distinct ids of its items, sorted as strings and
    comma-joined) and ``contaminated``.

    Null texts have no words. Items that share an id count as one; a null item id is written as the empty string.
    Rows that share an id and a text are treated alike; rows that share only an id are apart; null ids come back as null.
    Words are compared by 64-bit hashes. An empty benchmark hits nothing; only the named columns are read.
    """
    return _overlaps(docs, benchmark, id_col, text_col, item_col, item_text).drop("text_hash")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of overlaps() with ``text_hash``, which tells rows that share an id apart."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text)).alias("ws"))
    n = F.size("ws")
    short = [r[0] for r in items.where((n > 0) & (n < WINDOW)).select(n.alias("n")).distinct().collect()]  # nine lengths at most
    # (The filter that is inferred below a plain explode would repeat all passes in one expression.)
    long_marks = _fingerprints(items.where(n >= WINDOW), 1).select("item", F.explode_outer("marks").alias("m"))
    short_marks = items.where((n > 0) & (n < WINDOW)).select("item", F.struct(n.alias("len"), F.xxhash64("ws").alias("f"), F.lit(0).alias("p"), F.lit(None).cast("array<bigint>").alias("near")).alias("m"))
    spark = docs.sparkSession
    own = spark.range(SPREAD).select(F.lit(None).cast("string").alias("item"), F.lit(-1).alias("len"), F.col("id").alias("f"), F.lit(None).cast("array<bigint>").alias("theirs"))
    test = long_marks.union(short_marks).select("item", "m.len", "m.f", F.col("m.near").alias("theirs")).distinct().union(own)

    base = docs.select(F.col(id_col).alias("d"), _text_hash(F.col(text_col)).alias("t"), words_of(F.col(text_col)).alias("ws"))
    base = _fingerprints(base, 0)
    count = F.array(F.struct(F.lit(-1).alias("len"), F.pmod("t", F.lit(SPREAD)).alias("f"), F.lit(-1).alias("p"), F.lit(None).cast("array<bigint>").alias("near")))
    marks = F.concat(count, "marks", *(_whole(x) for x in sorted(short)))
    marks = base.select("d", "t", F.size("ws").alias("n"), F.inline(marks))
    few = test.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = marks.join(F.broadcast(test) if few else test, ["len", "f"])

    same = lambda i: F.get("near", F.lit(i)) == F.get("theirs", F.lit(i))
    side = WINDOW - K
    # words matched to either side before the nearest difference
    left = F.coalesce(*(F.when(~same(i), F.lit(side - 1 - i)) for i in range(side - 1, -1, -1)), F.lit(side))
    right = F.coalesce(*(F.when(~same(i), F.lit(i - side - K)) for i in range(side + K, 2 * side + K)), F.lit(side))
    core = same(side) & same(side + 1) & same(side + 2) & same(side + 3)
    hits = both.withColumn("l", F.when(F.col("len") == 0, left).otherwise(0)).withColumn("r", F.when(F.col("len") == 0, right).otherwise(0))
    hits = hits.where((F.col("len") != 0) | (core & (F.col("l") + F.col("r") + K >= WINDOW)))
    width = F.when(F.col("len") == 0, F.lit(K)).otherwise(F.col("len"))
    hits = hits.select("d", "t", "n", "item", F.when(F.col("len") >= 0, F.col("p") - F.col("l")).alias("a"), F.when(F.col("len") >= 0, F.col("p") + width + F.col("r")).alias("b"))

    by_doc = Window.partitionBy("d", "t").orderBy("a", "b")
    reach = F.coalesce(F.max("b").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = hits.withColumn("new", F.coalesce(F.greatest(F.lit(0), F.col("b") - F.greatest("a", reach)), F.lit(0)))
    found = counted.groupBy("d", "t").agg(F.max("n").alias("n"), F.sum("new").alias("hit"), F.array_sort(F.collect_set("item")).alias("items"), F.count_if(F.col("a").isNull()).alias("copies"))
    found = found.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select(
        F.col("d").alias("doc_id"), F.col("t").alias("text_hash"), F.col("n").cast("long").alias("n_words"), F.col("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs none of whose words are hit, with all columns. Each row goes by its own text, also where ids are null or shared."""
    bad = _overlaps(docs, benchmark, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_text")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_hit_id"]) & (_text_hash(docs[text_col]) == bad["_hit_text"]), "left_anti")
