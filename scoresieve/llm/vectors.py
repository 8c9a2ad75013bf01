"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o, padded with zeros to a multiple of 64 components, is rotated at random and reduced to the signs x of
the result; x and f = <x, Po> / sqrt(dim), the stored correction factor, are its code. For another vector q,
<x, Pq> / (f * sqrt(dim)) is an unbiased estimate of <o, q>; given the inner product c its error has a standard deviation
of about sqrt(1 - f^2) / f * sqrt(1 - c^2) / sqrt(dim - 1). Pq is kept in four bits a component, rounded with a fixed
dither, as four planes of bits, so an estimate is four counts of common bits. A pair is computed exactly, in double
precision, unless its estimate lies so far below the threshold that the bound excludes it.

Candidates come from the same codes: rotations give as many bits as tables of `bits` bits need, and
vectors that agree in a table's bits are compared there, each pair only in the first such table. The number of
tables follows from the recall wanted at the threshold. Only codes go through all tables. The vectors themselves go
to the tables in which the estimates leave them a partner.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .skew import joined
from .scratch import stored

#: Share of the pairs at exactly the threshold that the tables must bring together; closer pairs meet more surely.
RECALL = 0.998
#: Vectors in a bucket by chance, about; tables get more bits as the number of vectors grows.
BY_CHANCE = 256
#: Rows of a bucket that are compared with one another in one piece; larger buckets are cut into tiles.
TILE = 1024
#: Standard deviations below the threshold at which an estimate excludes a pair.
SIGMAS = 5.0
SEED = 4
#: Bits in which a rotated component is kept.
PLANES = 4


def rotation(dim: int, number: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def width_of(dim: int) -> int:
    """Components after padding: a multiple of 64."""
    return -(-dim // 64) * 64


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a table, and the number of tables."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(4, round(math.log2(max(n, 2) / BY_CHANCE)))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits))


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares of very small or large numbers would not be finite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _blob(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _rows(blobs: pa.Array, dtype) -> np.ndarray:
    """The other way; all of the same length."""
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(blobs), -1).copy().view(dtype)


def sketch(unit: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of unit vectors: keys of the tables, signs of the first rotation, its bit planes, and (f, low, step, sum of levels)."""
    n, dim = unit.shape
    wide = width_of(dim)
    padded = np.zeros((n, wide))
    padded[:, :dim] = unit
    rotated = [padded @ rotation(wide, r).T for r in range(-(-bits * tables // wide))]
    signs = np.concatenate([x > 0 for x in rotated], axis=1)
    keys = (signs[:, : bits * tables].reshape(n, tables, bits).astype(np.int64) << np.arange(bits)).sum(2)
    first = rotated[0]
    factor = np.abs(first).sum(1) / math.sqrt(wide)
    low, high = first.min(1), first.max(1)
    step = np.maximum((high - low) / (2**PLANES - 1), 1e-300)
    dither = np.random.default_rng([SEED, wide]).random(wide)
    level = np.minimum(np.floor((first - low[:, None]) / step[:, None] + dither), 2**PLANES - 1).astype(np.uint8)
    packed = lambda x: np.packbits(x, axis=1).view(np.uint64)
    planes = np.concatenate([packed((level >> j) & 1) for j in range(PLANES)], axis=1)
    return keys, packed(signs[:, :wide]), planes, np.stack([factor, low, step, level.sum(1, dtype=np.float64)], 1)


def _scaled(factors: np.ndarray, ones: np.ndarray, others: np.ndarray, wide: int, common: np.ndarray) -> np.ndarray:
    low, step, total = others[..., 1], others[..., 2], others[..., 3]
    return (step * (2.0 * common - total) + low * (2.0 * ones - wide)) / (math.sqrt(wide) * factors[..., 0])


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the levels under set bits; the last axes hold words of signs, and planes of words."""
    words = x.shape[-1]
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.int32)
    for j in range(PLANES):
        for w in range(words):
            total += np.bitwise_count(x[..., w] & y[..., j * words + w]).astype(np.int32) << j
    return total


def estimates(signs: np.ndarray, factors: np.ndarray, planes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated inner products of vectors (by their signs and f) with others (by their planes); arrays are broadcast as usual."""
    ones = np.bitwise_count(signs).sum(-1, dtype=np.int64)
    return _scaled(factors, ones, others, 64 * signs.shape[-1], _common(signs, planes))


def spread_of(factors: np.ndarray, wide: int, step: np.ndarray | float, c: float) -> np.ndarray:
    """Standard deviation of an estimate where the inner product is c: that of the code, and at most that of the rounding."""
    f = factors[..., 0]
    code = (1 - f * f).clip(0) * (1 - c * c) / max(1, wide - 1)
    return np.sqrt(code + (step / 2) ** 2) / f


def _codes(bits: int, tables: int, dtype: str):
    def run(batches):
        for batch in batches:
            dims = np.asarray([len(x) for x in batch.column(1)])
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                raw = _matrix(part.column(1))
                keys, signs, planes, numbers = sketch(_unit(raw), bits, tables)
                keys += int(dim) << min(bits, 40)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                own = np.concatenate([keys.astype(np.int64).view(np.uint64), signs, planes, numbers.view(np.uint64)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), _blob(raw.astype(dtype)), _blob(own), lists], ["node", "raw", "code", "keys"])

    return run


def _tiles(batches, width: int):
    """Rows sorted by their first four columns (a tile), and the chunk that a row belongs to: (tile, columns) for each tile with several rows."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(ids)], strict=True):
            if tuple(ids[a]) != at:
                if sum(x.num_rows for x in held) > 1:
                    yield at, [pa.concat_arrays([x.column(i) for x in held]) for i in range(4, width)]
                at, held = tuple(ids[a]), []
            held.append(batch.slice(a, b - a))
    if sum(x.num_rows for x in held) > 1:
        yield at, [pa.concat_arrays([x.column(i) for x in held]) for i in range(4, width)]


def _fresh(tile: tuple, chunk: np.ndarray, keys: np.ndarray):
    """Blocks of a tile as (left rows, right rows, mask of the pairs that no earlier table brings together)."""
    table, _, low, high = tile
    keys = np.stack([np.unique(keys[:, t], return_inverse=True)[1] for t in range(table)], 1).astype(np.uint16) if table else np.zeros((len(chunk), 0), np.uint16)
    left, right = (np.flatnonzero(chunk == x) for x in (low, high))
    for a in range(0, len(left), 512):
        own = left[a : a + 512]
        fresh = own[:, None] < right[None, :] if low == high else np.ones((len(own), len(right)), bool)
        for t in range(table):
            fresh &= keys[own, t][:, None] != keys[right, t][None, :]
        yield own, right, fresh


def _possible(tables: int, threshold: float):
    """The rows of each tile that the estimates leave a partner in it."""

    def run(batches):
        for tile, (chunk, node, code) in _tiles(batches, 7):
            own = _rows(code, np.uint64)
            keys, rest = own[:, :tables].view(np.int64), own[:, tables:]
            words = (rest.shape[1] - 4) // (1 + PLANES)
            signs, planes, numbers = rest[:, :words], rest[:, words:-4], np.ascontiguousarray(rest[:, -4:]).view(np.float64)
            least = threshold - SIGMAS * spread_of(numbers, 64 * words, numbers[:, 2].max(), threshold)
            alive = np.zeros(len(own), bool)
            for left, right, fresh in _fresh(tile, chunk.to_numpy(zero_copy_only=False), keys):
                if fresh.mean() < 0.1:  # few are left: one by one
                    i, j = np.nonzero(fresh)
                    i, j = left[i], right[j]
                    keep = estimates(signs[i], numbers[i], planes[j], numbers[j]) >= least[i]
                    alive[i[keep]] = alive[j[keep]] = True
                else:
                    keep = fresh & (estimates(signs[left][:, None], numbers[left][:, None], planes[right][None], numbers[right][None]) >= least[left][:, None])
                    alive[left[keep.any(1)]] = alive[right[keep.any(0)]] = True
            some = np.flatnonzero(alive)
            if len(some):
                names = [pa.array(np.full(len(some), v), pa.int64()) for v in tile]
                yield pa.RecordBatch.from_arrays([*names, chunk.take(pa.array(some)), node.take(pa.array(some))], ["t", "key", "low", "high", "chunk", "node"])

    return run


def _links(tables: int, threshold: float, dtype: str):
    """Exact cosines of what is left of each tile: each row's links, and the edges of a spanning forest."""

    def run(batches):
        for tile, (chunk, node, copies, raw, code) in _tiles(batches, 9):
            unit = _unit(_rows(raw, dtype).astype(np.float64))
            found = []
            for left, right, fresh in _fresh(tile, chunk.to_numpy(zero_copy_only=False), _rows(code, np.uint64)[:, :tables].view(np.int64)):
                i, j = np.nonzero(fresh & (unit[left] @ unit[right].T >= threshold - 1e-9))
                i, j = left[i], right[j]
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                found.append((i[near], j[near]))
            i, j = (np.concatenate([x[k] for x in found]) for k in range(2))
            if not len(i):
                continue
            ids, times = (x.to_numpy(zero_copy_only=False) for x in (node, copies))
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, i, times[j])
            np.add.at(n, j, times[i])
            root = np.arange(len(ids))
            while True:  # least label over links
                low = np.minimum(root[i], root[j])
                new = root.copy()
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(n[some], pa.int64()), pa.array(ids[root[some]], pa.int64())], ["node", "links", "with"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link vectors whose cosine is at least threshold; found approximately, verified exactly, so no link is false.

    One row for each row of vectors: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id`` (smallest id
    reachable) and ``kept`` (vec_id = component_id).

    * Equal vectors are one node with a number of copies, and are linked (their cosine is 1).
    * Null vectors, empty or zero ones, and those with null or non-finite components link with nothing.
    * Vectors of different lengths do not link; any length goes. Ids that are null link with nothing and have a null component.
    * Rows that share an id are rows of their own in counts, and share a component.
    * A cosine of exactly the threshold, as double precision gives it, is a link. An empty table gives no rows.
    * Only id_col and vector_col are read; other columns are ignored whatever their names.
    """
    floats = dict(vectors.dtypes)[vector_col] in ("array<float>", "array<tinyint>", "array<smallint>")
    dtype, kind = ("float32", "float") if floats else ("float64", "double")
    v = F.col(vector_col).cast(f"array<{kind}>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    good, others = rows.where(usable), rows.where(~usable)
    good = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))  # -0 equals 0
    # Equal vectors are found by 128 bits of hashes, so that each vector is shuffled once, and copies not at all.
    good = good.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(SEED), "v").alias("g"))
    distinct = good.groupBy("h", "g").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("v").alias("v"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    n, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    bits, tables = plan(n, threshold)
    coded = stored(distinct.select("node", "v").mapInArrow(_codes(bits, tables, dtype), "node long, raw binary, code binary, keys array<bigint>"), "codes")
    placed = coded.select("node", "code", F.posexplode("keys").alias("t", "key"))
    sizes = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = joined(placed, sizes, ["t", "key"], n * tables, "size").withColumn("chunks", F.ceil(F.col("size") / TILE).cast("int"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tile = ["t", "key", "low", "high"]
    placed = placed.select("t", "key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "code")
    dealt = lambda x: x.repartition(*tile).sortWithinPartitions(*tile, "node")
    left = stored(dealt(placed).mapInArrow(_possible(tables, threshold), "t long, key long, low long, high long, chunk int, node long"), "possible")
    whole = left.join(coded.join(distinct.select("node", "copies"), "node"), "node").select(*tile, "chunk", "node", "copies", "raw", "code")
    found = stored(dealt(whole).mapInArrow(_links(tables, threshold, dtype), "node long, links long, with long"), "links")
    edges = found.select(F.col("node").alias("a"), F.col("with").alias("b"))
    # Rows that share an id join their vectors' nodes.
    key = F.struct("h", "g")
    shared = stored(good.groupBy("id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x != y").select("id", "x"), "shared")
    if not shared.isEmpty():
        ends = good.select("id", "h", "g").join(shared, "id").select("x", "h", "g").distinct()
        node = distinct.select("h", "g", "node")
        ends = ends.join(node.withColumnRenamed("node", "a"), ["h", "g"]).select(F.col("x.h").alias("h"), F.col("x.g").alias("g"), "a")
        edges = edges.union(ends.join(node.withColumnRenamed("node", "b"), ["h", "g"]).select("a", "b"))
    groups = components(edges).select(F.col("id").alias("node"), F.col("component_id").alias("group"))
    named = groups.join(distinct.select("node", "least"), "node").groupBy("group").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    labelled = joined(groups, named, ["group"], n, "members").select("node", "component_id")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = distinct.drop("v").join(labelled, "node", "left").join(counts, "node", "left")
    known = stored(known.select("h", "g", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "known")
    linked = joined(good.select("id", "h", "g"), known, ["h", "g"], total, "copies").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    every = linked.union(others.select("id", F.lit(0).cast("long"), "id"))
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
