"""N-gram Jaccard join by parity sketches.

Each shingle of a document flips one bit of a wide bit sketch, so the sketches of
two sets differ in at most as many bits as their symmetric difference has elements.
Sets with a Jaccard similarity of at least t differ in at most
``d = (1 - t) * (|A| + |B|) / (1 + t)`` elements. Documents are put into bands of
similar size; the sketch of a band is cut into more than d blocks, so that two
similar sets agree in whole blocks (pigeonhole). Documents are joined on the
values of blocks; candidates are pruned by the Hamming distance of folded
sketches and verified on the exact shingle sets.

Blocks that hold next to nothing would join unrelated documents. A document
publishes only blocks of at least w shingles, for the largest w with which they
alone still guarantee a hit: of M blocks at most d are touched by a difference,
so M - d less the number of its blocks below w must be 1 or more. An untouched
block holds the same shingles in both sets, so two documents meet in one that
holds the larger of their two w, which both publish. This holds
for sets of every size, so no linked pair is missed.

Equal sets are one representative, and only representatives publish keys. What a key is shared by is found by
aggregation, and rows are joined to it so that no frequent key is one task's (see ``skew``); members of a large bucket
are compared in tiles.

Only connectivity is wanted, so a group of copies is never expanded into pairs.
The first round verifies each document against one hub: the least member of most
of its buckets. The second verifies the pairs across components in a slice of the
buckets that still hold several, which joins nearly all that can be joined. The third
does so in all buckets that then still do, for pairs that no bucket of the slice
held. Pairs inside a component add nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .hashing import WordHasher, mix, shingle_set
from .scratch import dropped, stored, unused
from .skew import joined, marked

#: Ratio of the largest to the smallest set in a band.
BAND = 1.5
#: Distinct documents whose ids may be broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Partners of a document that one task compares with it.
MEMBERS = 2000
#: Members of a bucket that are compared with one another in one piece.
TILE = 1024
#: Longs of the sketch that buckets are pruned by, above and below a similarity of 0.85. Two unrelated sets differ in
#: half of its bits; it must have so many that this is more than linked sets of common sizes may differ by.
NARROW, BROAD = 4, 12
#: The second round looks at one bucket in so many; most links lie in many buckets, and what they join needs no more comparing.
SLICES = 12
#: Bits of a pruning sketch for each element by which linked sets may differ.
SHARP = 16


class Bands:
    """Size bands, and for each the number of sketch blocks that pigeonholing needs."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.weak, self.most = (2, 1.25) if num * 100 < 85 * den else (4, 1.4)  # shingles that a block is to hold, and blocks for each difference
        self.known: dict[int, tuple[int, int]] = {}

    def low(self, band: int) -> int:
        return math.ceil(BAND**band - 1e-9)

    def of(self, n: int) -> int:
        band = max(0, int(math.log(max(n, 1)) / math.log(BAND)))
        while self.low(band + 1) <= n:
            band += 1
        while self.low(band) > n:
            band -= 1
        return band

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to total."""
        return (self.den - self.num) * total // (self.den + self.num)

    def blocks(self, band: int) -> tuple[int, int]:
        """Largest difference in this band, and the number of blocks, which is always larger (pigeonhole)."""
        if band not in self.known:
            self.known[band] = self._blocks(band)
        return self.known[band]

    def _blocks(self, band: int) -> tuple[int, int]:
        low, high = self.low(band), self.low(band + 1) - 1
        d = self.most_apart(2 * high)
        if not d:
            return 0, 1
        m = d + 1
        for _ in range(40):
            rate = low / m
            thin = m * sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(self.weak))
            need = d + 1 + math.ceil(thin + 2 * math.sqrt(thin))
            if need <= m or m > self.most * d + 2:
                break
            m = min(need, m + max(1, d // 20))
        return d, m

    def bits(self, band: int) -> int:
        """Bits of the sketch that candidates in this band are pruned by: so many that it is close to the true difference."""
        return 64 * max(4, math.ceil(SHARP * self.blocks(band)[0] / 64))

    def joined(self, n: int) -> list[int]:
        """Bands in which a set of n elements takes part: its own, and those whose members may be larger partners of it."""
        own = self.of(n)
        found = [own]
        while self.low(found[-1] + 1) * self.num <= n * self.den:
            found.append(found[-1] + 1)
        return found

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The values of the sketch blocks that a set publishes, as join keys."""
        out = []
        place, flips = mix(tokens ^ np.uint64(0xA0761D6478BD642F)), None
        for band in self.joined(len(tokens)):
            d, m = self.blocks(band)
            block = ((place >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            if flips is None:  # the low 32 bits name the bit within the block; a value of its own for each bit makes patterns comparable as one number
                flips = mix((place & np.uint64(0xFFFFFFFF)) ^ np.uint64(0xE7037ED100000000))
            block = block.astype(np.int64)
            value = np.zeros(m, np.uint64)
            np.bitwise_xor.at(value, block, flips)
            filled = np.bincount(block, minlength=m)
            at = next(at for w in range(self.weak, -1, -1) if len(at := np.flatnonzero(filled >= w)) > d)
            out.append(mix(value[at] ^ mix(at.astype(np.uint64) + np.uint64((band + 1) << 40))))
        return np.concatenate(out)


def _folded(hashed: np.ndarray, width: int) -> np.ndarray:
    """A parity sketch of width bits (a multiple of 64), as longs."""
    place = ((hashed >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=width) & 1).astype(np.uint8)).view(np.int64)


def _each(hasher: WordHasher, batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    for words in hasher.words(batch.column(1)):
        yield shingle_set(words, shingle)


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(x) for x in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _slices(batches, most_bytes: int = 8 << 20):
    for batch in batches:
        rows = max(1, min(batch.num_rows, int(most_bytes * batch.num_rows / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _folds(num: int, den: int) -> list[str]:
    return [f"f{i}" for i in range(NARROW if num * 100 >= 85 * den else BROAD)]


def _meta_schema(num: int, den: int) -> str:
    return "id long, n long, s1 long, s2 long, " + ", ".join(f"{f} long" for f in _folds(num, den)) + ", band int, wide array<array<bigint>>, keys array<bigint>"


def _meta(shingle: int, num: int, den: int):
    def run(batches):
        hasher, bands, names = WordHasher(), Bands(num, den), _folds(num, den)
        for batch in _slices(batches):
            n, one, two, fold, band, wide, keys = [], [], [], [], [], [], []
            for tokens in _each(hasher, batch, shingle):
                n.append(len(tokens))
                hashed = mix(tokens)
                one.append(np.bitwise_xor.reduce(hashed))
                two.append(np.add.reduce(mix(tokens + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
                fold.append(_folded(hashed, 64 * len(names)))
                band.append(bands.of(len(tokens)))
                wide.append([_folded(hashed, bands.bits(b)) for b in bands.joined(len(tokens))] if len(tokens) else [])
                keys.append(bands.keys(tokens) if len(tokens) else tokens)
            fold = np.array(fold, np.int64).reshape(-1, len(names))
            inner = _lists([x.view(np.uint64) for own in wide for x in own])
            offsets = np.r_[0, np.cumsum([len(own) for own in wide])].astype(np.int32)
            numbers = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two))
            columns = [batch.column(0), pa.array(n, pa.int64()), *numbers, *(pa.array(fold[:, i]) for i in range(len(names))), pa.array(band, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), inner), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "s1", "s2", *names, "band", "wide", "keys"])

    return run


def _compared(shingle: int, num: int, den: int):
    def run(batches):
        """Rows sorted by hub and part, the hub's own text first: compare each member with it."""
        hasher, at, own = WordHasher(), None, []
        for batch in _slices(batches):
            hub, part, member, ids = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            found = []
            for i, tokens in enumerate(_each(hasher, batch, shingle)):
                if at != (hub[i], part[i]):
                    at, own = (hub[i], part[i]), []
                if not member[i]:
                    own.append(tokens)
                    continue
                for other in own:
                    common = len(np.intersect1d(tokens, other, assume_unique=True))
                    if common and den * common >= num * (len(tokens) + len(other) - common):
                        found.append((hub[i], ids[i]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, table: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose exact shingle sets are similar enough, as a stored table.

    Texts travel, as they are far smaller than their sets: each b once for each of its pairs, and each a once for every
    MEMBERS of its pairs, so that a hub with very many partners is spread over tasks. A task holds one hub's set.
    """
    pairs = stored(pairs, "pairs")
    total = pairs.count()
    parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")).withColumn("parts", F.ceil(F.col("size") / MEMBERS).cast("int"))
    members = joined(pairs, parts, ["a"], total, "size").select(F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"))
    hubs = parts.select(F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"))
    jobs = members.union(hubs)
    rows = table.join(F.broadcast(jobs) if total <= BROADCAST_IDS else jobs, "id").select("hub", "text", "part", "member", "id")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "member")
    links = stored(rows.mapInArrow(_compared(shingle, num, den), "a long, b long"), "links")
    dropped(pairs)
    return links


def _near(x: str, y: str, num: int, den: int):
    """Condition that two sets' sizes and the Hamming distance of their folded sketches leave them a chance."""
    apart = sum((F.bit_count(F.col(f"{x}.{f}").bitwiseXOR(F.col(f"{y}.{f}"))) for f in _folds(num, den)), F.lit(0))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((den + num) * apart <= (den - num) * (n + m))


def similar_documents(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of at least num/den.

    Words are runs of bytes other than white space, A-Z lower-cased. Returns one row for each
    row of docs: ``doc_id``, ``n_shingles`` (size of its set) and ``component_id`` (smallest id
    reachable by links, itself included).

    * Null or empty texts, and texts without words, have the empty set and link with nothing.
    * Texts of fewer words than a shingle have one shingle, the whole sequence.
    * Rows with a null id are returned with a null component_id and link with nothing.
    * Rows that share an id share a component; each gets its own n_shingles.
    * Texts of any length are hashed whole, about a MB at a time. An empty table gives no rows.
    * Only id_col and text_col are read; other columns are ignored whatever their names.
    """
    return _grouped(docs, shingle, num, den, id_col, text_col)[1]


def _grouped(docs: DataFrame, shingle: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The stored table of sets, and the rows of similar_documents()."""
    folds = _folds(num, den)
    table = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = stored(table.mapInArrow(_meta(shingle, num, den), _meta_schema(num, den)), "sets")
    same_set = ["n", "s1", "s2"]
    meta = stored(sets.select("id", *same_set), "sizes")
    usable = "n > 0 and id is not null"
    known = meta.where(usable)
    reps = known.groupBy(*same_set).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    # Documents that share an id are one node, so that node has an edge to each of its sets' representatives.
    node = joined(known.select("id", *same_set), reps, same_set, known.count(), "size")
    same = stored(node.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "same")

    # (A document that shares its id with a representative may publish too, which is one node all the same.)
    first = reps.select("rep").distinct()
    few = first.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = sets.where(usable)
    chosen = chosen.join(F.broadcast(first) if few else first, chosen["id"] == first["rep"]).drop("id")
    if not few:
        chosen = stored(chosen, "chosen")
    shape = chosen.select("rep", "n", *folds, "band", "wide").dropDuplicates(["rep", "n", *folds])
    shape = stored(shape, "shapes")
    rows = chosen.select("rep", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi").drop("hi")
    published = chosen.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    shared = stored(shared, "shared")
    likely = marked(rows, shared, ["key"], shared.count(), "likely").where("likely").drop("likely")  # most keys are one set's own
    buckets = stored(joined(likely, shared, ["key"], published, "size").select("key", "rep", "lo"), "buckets")
    for spent in (sets, shared, chosen):  # keys are most of what is stored
        dropped(spent)

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and folded sketches do not rule out."""
        x, y = shape.alias("x"), shape.alias("y")
        both = pairs.join(x, pairs["a"] == F.col("x.rep")).join(y, pairs["b"] == F.col("y.rep")).where(_near("x", "y", num, den))
        band = F.greatest("x.band", "y.band")
        bits = F.zip_with(F.get("x.wide", band - F.col("x.band")), F.get("y.wide", band - F.col("y.band")), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        apart = F.aggregate(bits, F.lit(0), lambda s, v: s + v)
        return both.where((den + num) * apart <= (den - num) * (F.col("x.n") + F.col("y.n"))).select("a", "b")

    def of_most(rows: DataFrame) -> DataFrame:
        """For each member b the hub a that it shares most buckets with."""
        times = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
        return times.groupBy("b").agg(F.max_by("a", F.struct(F.col("times"), -F.col("a"))).alias("a")).select("a", "b")

    known_links = _verified(possible(of_most(buckets.where("rep != lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")))), table, shingle, num, den)

    def torn_buckets(links: DataFrame) -> DataFrame:
        """Rows of the buckets whose members are not all connected yet: key, rep, component c, and how many rows the bucket has."""
        labels = components(links).select(F.col("id").alias("rep"), "component_id")
        labelled = stored(buckets.select("key", "rep").join(labels, "rep", "left").select("key", "rep", F.coalesce("component_id", "rep").alias("c")), "labelled")
        torn = labelled.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 != c1").select("key", "size")
        out = stored(joined(labelled, torn, ["key"], labelled.count(), "size"), "torn")
        dropped(labelled)
        return out

    sliced = F.pmod(F.xxhash64("key"), F.lit(SLICES)) == 0
    in_slice = buckets.where(sliced).groupBy("rep").agg(F.collect_set("key").alias("seen"))

    def across(torn: DataFrame, again: bool) -> DataFrame:
        """Pairs of members of different components in the same bucket; the second time without those that a bucket of the slice holds."""
        tiled = torn.withColumn("chunks", F.ceil(F.col("size") / TILE).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        tiled = tiled.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "rep", "c")
        rows = tiled.join(shape.drop("band", "wide"), "rep")
        if again:
            rows = rows.join(in_slice, "rep", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>")))
        x, y = rows.alias("x"), rows.alias("y")
        wanted = (F.col("x.key") == F.col("y.key")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
        wanted &= (F.col("x.c") < F.col("y.c")) & ((F.col("x.low") == F.col("x.high")) | (F.col("x.chunk") != F.col("y.chunk"))) & _near("x", "y", num, den)
        pairs = x.join(y, wanted & ~F.arrays_overlap("x.seen", "y.seen") if again else wanted)
        return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()

    torn = torn_buckets(known_links)
    known_links = known_links.union(_verified(possible(across(torn.where(sliced), False)), table, shingle, num, den))
    dropped(torn)
    torn = torn_buckets(known_links)
    links = known_links.union(_verified(possible(across(torn, True)), table, shingle, num, den)).union(same)
    dropped(torn)
    final = components(links).withColumnRenamed("id", "_id")
    out = meta.select("id", "n").join(final, F.col("id") == F.col("_id"), "left")
    return meta, out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest id of their group, with all columns.

    Rows with a null id stay, as nothing tells them apart. Rows that share an id that stays are one document: each of
    their different texts stays once (with the other columns of one of its rows). An empty table gives no rows.
    """
    meta, groups = _grouped(docs, shingle, num, den, id_col, text_col)
    others, repeated, text = unused(docs, "dropped", "repeated", "text_hash")
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias(others)).distinct()
    kept = docs.join(gone, docs[id_col] == gone[others], "left_anti")
    twice = stored(meta.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias(repeated)), "repeated")
    if twice.isEmpty():
        return kept
    one = kept.join(twice, kept[id_col] == twice[repeated], "left_semi").withColumn(text, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([id_col, text]).drop(text)
    return kept.join(twice, kept[id_col] == twice[repeated], "left_anti").unionByName(one)
