"""Line dedup over a range-partitioned stream of line hashes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, stored, unused
from .skew import marked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Lines to a range partition, when the number of partitions is chosen.
ROWS_PER_RANGE = 2_000_000


def packed(n: int, positions: np.ndarray) -> bytes:
    """The keep bitmap of n lines without those at positions: a bit for each line, compressed."""
    keep = np.ones(n, np.uint8)
    keep[positions[positions < n]] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpacked(n: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def _runs(batch: pa.RecordBatch):
    h, d = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    new_doc = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]
    return h, d, starts, new_doc


def _ends(batches):
    """One row for a range: first and last key, their documents at its two ends, and in how many documents it has them."""
    from pyspark import TaskContext

    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, d, starts, new_doc = _runs(batch)
        counts = np.add.reduceat(new_doc.astype(np.int64), starts)
        for j in {0, len(starts) - 1}:
            at, to = starts[j], starts[j + 1] if j + 1 < len(starts) else len(h)
            n = int(counts[j])
            if last and last[0] == h[at]:
                n += last[3] - (last[2] == d[at])
                last = (h[at], last[1], d[to - 1], n)
                if first[0] == h[at]:
                    first = last
            else:
                last = (h[at], d[at], d[to - 1], n)
                first = first or last
    if first:
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "k0": int(first[0]), "a0": int(first[1]), "z0": int(first[2]), "n0": int(first[3]), "k1": int(last[0]), "a1": int(last[1]), "z1": int(last[2]), "n1": int(last[3])}])


_ENDS = "part long, k0 long, a0 long, z0 long, n0 long, k1 long, a1 long, z1 long, n1 long"


def _stitched(rows: list) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Document counts of the keys that lie on an edge of some range; for each range, the first key if an earlier range has it too."""
    total: dict[int, int] = {}
    end: dict[int, int] = {}
    continued: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        for k, a, z, n in [(r["k0"], r["a0"], r["z0"], r["n0"])] + [(r["k1"], r["a1"], r["z1"], r["n1"])] * (r["k1"] != r["k0"]):
            if k in total:
                continued[r["part"]] = k
                n -= end[k] == a
            total[k] = total.get(k, 0) + n
            end[k] = z
    return total, continued


def _drops(total: dict[int, int], continued: dict[int, int], min_docs: int, keep_first: bool):
    """Stream sorted lines; pass on those to drop. At most min_docs - 1 documents' lines of an undecided key are held back."""

    def run(batches):
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        key = doc = None
        docs = 0
        decided = False
        begun = continued.get(TaskContext.get().partitionId()) if keep_first else None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, d, starts, new_doc = _runs(batch)
            counts = np.add.reduceat(new_doc.astype(np.int64), starts)
            if key == h[0]:
                counts[0] += docs - (doc == d[0])
            else:
                held, decided = [], False
            frequent = counts >= min_docs
            for j in {0, len(starts) - 1}:
                frequent[j] |= total.get(int(h[starts[j]]), 0) >= min_docs
            frequent[0] |= key == h[0] and decided
            if frequent[0] and held:
                yield from held
            lengths = np.diff(np.r_[starts, len(h)])
            drop = np.repeat(frequent, lengths)
            if keep_first:
                fresh = starts[1:] if key == h[0] or begun == h[0] else starts
                drop[fresh] = False
            if drop.any():
                yield batch.filter(pa.array(drop))
            tail = batch.slice(starts[-1])
            same = len(starts) == 1 and key == h[0]
            if frequent[-1]:
                held, decided = [], True
            else:
                if keep_first and not (same or begun == h[starts[-1]]):
                    tail = tail.slice(1)
                held, decided = ([*held, tail] if same else [tail]), False
            key, doc, docs = h[-1], d[-1], int(counts[-1])
            begun = begun if begun == h[-1] else None

    return run


_ROWS = "h long, d long, t long, p int"


def _bitmaps(batches):
    for batch in batches:
        ps, ns = batch.column(3), batch.column(2).to_pylist()
        found = [packed(n, np.asarray(ps[i].as_py(), np.int64)) for i, n in enumerate(ns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["d", "t", "n", "bitmap"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compressed keep bitmaps of the documents that lose lines.

    A text is cut at each \\n. A line's key is the line without white space ([\\x20\\x09-\\x0D]) at both ends,
    with A-Z lower-cased. Keys found in at least min_docs documents lose all lines (keep="none") or all but the
    first by id and position (keep="first"). Empty keys lose none.

    Returns ``d`` (id; nulls as the smallest long), ``t`` (hash of the text), ``n`` (lines), ``bitmap``.
    Rows that share an id count as one document; their bitmaps are told apart by the text.
    Null ids together count as one document.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = F.split(F.translate(text, UPPER, LOWER), "\n", -1)
    hashed = F.transform(split, lambda x: F.when(F.btrim(x, F.lit(BLANKS)) != "", F.xxhash64(F.btrim(x, F.lit(BLANKS)))))
    shaped = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("t"), hashed.alias("hs"))
    lines = stored(shaped.select("d", "t", F.posexplode("hs").alias("p", "h")).where("h is not null").select("h", "d", "t", "p"), "lines")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // ROWS_PER_RANGE + 1)
    # Documents and places are part of the range key: a line that very many documents have is spread over ranges.
    ranged = lines.repartitionByRange(parts, "h", "d", "t", "p").sortWithinPartitions("h", "d", "t", "p").persist(StorageLevel.DISK_ONLY)
    total, continued = _stitched([r.asDict() for r in ranged.mapInArrow(_ends, _ENDS).collect()])  # two keys for each range
    drops = ranged.mapInArrow(_drops(total, continued, min_docs, keep == "first"), _ROWS)
    grouped = drops.groupBy("d", "t").agg(F.collect_set("p").alias("ps")).select("d", "t", (F.array_max("ps") + 1).alias("n"), "ps")
    out = stored(grouped.mapInArrow(_bitmaps, "d long, t long, n int, bitmap binary"), "bitmaps")
    ranged.unpersist()
    dropped(lines)
    return out


def _without(texts: pa.Array, ns: pa.Array, maps: pa.Array) -> pa.Array:
    kept, lines, dropped = [], [], []
    for text, n, bitmap in zip(texts.to_pylist(), ns.to_pylist(), maps.to_pylist(), strict=True):
        rows = (text or "").split("\n")
        lines.append(len(rows))
        if bitmap is not None:
            rows = [x for x, k in zip(rows, unpacked(n, bitmap), strict=False) if k] + rows[n:]
        kept.append("\n".join(rows))
        dropped.append(lines[-1] - len(rows))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])


def without_common_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column ``line_dedup``: a struct of the remaining text, n_lines and n_dropped; see ``keep_bitmaps``.

    One row for each row of docs, all columns kept whatever their names, in no order. Null texts are one empty line. A
    document that loses all lines has the empty text. Repeated rows are treated alike. Texts of any length are cut whole.
    A column named line_dedup is replaced. An empty table gives no rows.

    Only texts that may lose lines are shuffled to their bitmaps; a filter of hashed keys tells them (see ``skew.marked``).
    """
    docs = docs.drop("line_dedup")
    maps = keep_bitmaps(docs, min_docs, keep, id_col, text_col)
    d, t, n, bitmap, loses = unused(docs, "d", "t", "n", "bitmap", "loses")
    maps = maps.select(F.col("d").alias(d), F.col("t").alias(t), F.col("n").alias(n), F.col("bitmap").alias(bitmap))
    keyed = docs.withColumns({d: F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), t: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    told = marked(keyed, maps, [d, t], maps.count(), loses)
    applied = F.arrow_udf(_without, "struct<text string, n_lines long, n_dropped long>")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    rest = told.where(~F.col(loses)).withColumn("line_dedup", F.struct(whole.alias("text"), (F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")))
    some = told.where(F.col(loses)).join(maps, [d, t], "left").withColumn("line_dedup", applied(F.col(text_col), F.col(n), F.col(bitmap))).drop(n, bitmap)
    return rest.drop(d, t, loses).unionByName(some.drop(d, t, loses))
