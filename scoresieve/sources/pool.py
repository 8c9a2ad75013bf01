"""Pools of records in JSON lines: reading, writing, positions."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import numbers_only, others_only

#: What becomes of lines that hold no JSON object: "fail", "drop" or "keep" (as raw lines with nothing parsed).
ON_ERROR = ("fail", "drop", "keep")
#: File splits whose offsets may be broadcast, about 200 bytes each.
BROADCAST_SPLITS = 200_000
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def numbered(lines: DataFrame) -> DataFrame:
    """Add ``line_idx``, the position over all files by path, to rows of value, _file, _block and _at.

    Rows are counted by file split; one running sum over the splits gives their offsets, which are broadcast while the
    plan's splits are few enough and joined by a shuffle beyond that.
    """
    splits = lines.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("_file", "_block", (before - F.col("_first")).alias("_shift"))
    few = lines.rdd.getNumPartitions() + len(lines.inputFiles()) <= BROADCAST_SPLITS  # a split begins with a task or a file
    return lines.join(F.broadcast(offsets) if few else offsets, ["_file", "_block"]).withColumn("line_idx", F.col("_at") + F.col("_shift")).drop("_file", "_block", "_at", "_shift")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_idx`` (from 0, blank lines count) and ``raw`` for each line."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return numbered(lines).select("line_idx", "raw")


def _alone(raw: str, schema: str) -> Column:
    """The one JSON object of a line; null if the line is anything else or holds more. (Within brackets, what follows an object is an error.)"""
    found = F.from_json(F.concat(F.lit("["), F.col(raw), F.lit("]")), f"array<{schema}>", _STRICT)
    return F.when(F.size(found) == 1, found[0])


def parse(lines: DataFrame, score_field: str = "scores", fields: str = "id string, instruction string, input string, output string, cluster_id long, final_score double", on_error: str = "fail") -> DataFrame:
    """Parse raw lines, each once; blank lines are dropped, their positions stay taken.

    Returns line_idx, raw, the named fields, ``scores`` (numeric entries as doubles), ``scores_other`` (other entries as
    JSON) and ``has_scores`` (whether score_field is an object). Literal NaN and Infinity count as numbers.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    names = [f.name for f in T._parse_datatype_string(fields).fields]
    schema = f"struct<{fields}, `{score_field}` map<string,variant>, source map<string,variant>>"
    out = lines.where(F.trim("raw") != "").withColumn("_j", _alone("raw", schema)).withColumn("_ok", F.col("_j").isNotNull())
    if on_error == "fail":
        out = out.withColumn("_ok", F.when(F.col("_ok"), True).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line_idx"), F.lit(" is not JSON")))))
        out = out.where("_ok")
    elif on_error == "drop":
        out = out.where("_ok")
    scores = F.col(f"_j.`{score_field}`")
    return out.select("line_idx", "raw", *(F.col(f"_j.`{n}`").alias(n) for n in names), numbers_only(scores).alias("scores"), others_only(scores).alias("scores_other"), numbers_only(F.col("_j.source")).alias("source_scores"), scores.isNotNull().alias("has_scores"))


def read_pool(spark: SparkSession, path: str, score_field: str = "scores", on_error: str = "fail") -> DataFrame:
    return parse(read_lines(spark, path), score_field, on_error=on_error)


# ---- records whose other fields stay as they are


def _quoted(s: Column) -> Column:
    text = F.to_json(F.array(s))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _entries(texts: Column, kinds: Column) -> Column:
    """(key, text) of each field of an object, in order: texts as a map of strings, kinds as one of variants."""

    def one(e, v):
        kind = F.schema_of_variant(v)
        number = F.when(kind.rlike("^(DOUBLE|FLOAT)") & e["value"].startswith('"'), F.translate(e["value"], '"', ""))  # NaN and Infinity
        text = F.when(v.isNull() | (kind == "VOID"), "null").when(kind == "STRING", _quoted(e["value"]))
        return F.struct(e["key"].alias("key"), F.coalesce(text, number, e["value"], F.lit("null")).alias("text"))

    return F.zip_with(F.map_entries(texts), F.map_values(kinds), one)


def records(lines: DataFrame, score_field: str = "scores") -> DataFrame:
    """``line_idx``, ``raw``, ``fields``, ``entries``, ``scores`` and ``has_scores`` for each line, blank ones too.

    fields: (key, JSON text) of each field of the record in order, null where the line is not one JSON object (or an
    object in it has a key twice); entries: the same of the object in score_field; scores: its numbers as a map of
    doubles. ``rewritten`` makes lines of them again, so what nobody changes stays as it was: kinds, order, nested values.
    (Numbers of nested values may be written another way, as 1.50 and 1.5, and a NaN in them is quoted; not so one among the scores.)
    """
    out = lines.withColumns({"_t": _alone("raw", "map<string,string>"), "_v": _alone("raw", "map<string,variant>")})
    fields = F.when(F.col("_t").isNotNull() & F.col("_v").isNotNull(), _entries(F.col("_t"), F.col("_v")))
    inner = F.try_variant_get(F.col("_v")[score_field], "$", "map<string,variant>")
    has = F.coalesce(F.schema_of_variant(F.col("_v")[score_field]).startswith("OBJECT"), F.lit(False))
    out = out.withColumn("_s", F.when(has, F.from_json(F.col("_t")[score_field], "map<string,string>"))).withColumn("_n", F.when(has, inner))
    # (The variant's keys are sorted, the text's are not.)
    in_order = F.map_from_arrays(F.map_keys("_s"), F.transform(F.map_keys("_s"), lambda k: F.col("_n")[k]))
    out = out.select("line_idx", "raw", fields.alias("fields"), _entries(F.col("_s"), in_order).alias("entries"), numbers_only(F.col("_n")).alias("scores"), has.alias("has_scores"))
    return out.withColumn("fields", F.when(F.col("has_scores"), put(F.col("fields"), {score_field: object_text(F.col("entries"))})).otherwise(F.col("fields")))


def number_text(c: Column) -> Column:
    """A double as JSON; null, and NaN or Infinity as the words that readers of such files know."""
    return F.coalesce(c.cast("double").cast("string"), F.lit("null"))


def put(entries: Column, new: dict[str, Column]) -> Column:
    """Entries with those of `new` (JSON texts by key): in the place of one of that name, else at the end."""
    if not new:
        return entries
    wanted = F.create_map(*(x for k, text in new.items() for x in (F.lit(k), text)))
    kept = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.coalesce(wanted[e["key"]], e["text"]).alias("text")))
    have = F.transform(entries, lambda e: e["key"])
    added = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), text.alias("text")) for k, text in new.items())), lambda e: ~F.array_contains(have, e["key"]))
    return F.concat(kept, added)


def object_text(entries: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(": "), e["text"])), ", "), F.lit("}"))


def rewritten(fields: Column, raw: Column) -> Column:
    """The line of a record; as it was read where it is none."""
    return F.coalesce(object_text(fields), raw)


def scores_or_source(strict: bool = True) -> Column:
    """The scores; else the ``source`` field where that is an object; else an error (strict) or null."""
    found = F.coalesce(F.when(F.col("has_scores"), F.col("scores")), F.col("source_scores"))
    return F.coalesce(found, F.raise_error(F.lit("a record has neither scores nor an object as source")).cast("map<string,double>")) if strict else found


def first_record(pool: DataFrame) -> dict:
    """The first record that is not blank; an empty pool is an error."""
    row = pool.where(F.trim("raw") != "").orderBy("line_idx").select("raw").first()
    if row is None:
        raise ValueError("the pool is empty")
    return json.loads(row["raw"])


def score_keys(pool: DataFrame, wanted: str | list[str] | None = None, field: str = "scores") -> list[str]:
    """The wanted keys in their order (a list, or names between commas), or the sorted keys of the first record."""
    if wanted:
        return [k.strip() for k in (wanted.split(",") if isinstance(wanted, str) else wanted) if k.strip()]
    row = pool.orderBy("line_idx").select(F.array_sort(F.map_keys(field)).alias("k")).first()
    return list(row["k"] or []) if row else []


def every_key(pool: DataFrame, field: str = "scores") -> list[str]:
    """All keys that any record has, sorted."""
    return sorted(r[0] for r in pool.select(F.explode(F.map_keys(field))).distinct().collect())


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row; null fields are kept, and so are characters beyond ASCII."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_raw(df: DataFrame, path: str, raw: str = "raw") -> None:
    """The lines as they were read."""
    df.select(F.col(raw).alias("value")).write.mode("overwrite").text(path)


def _swapped(spark: SparkSession, path: str, write) -> None:
    """Write beside path, set the old table aside, put the new one in its place, and only then delete the old one."""
    mark = uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.{mark}.new", f"{path.rstrip('/')}.{mark}.old"
    write(new)
    place, new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place) and not files.rename(place, old):
        raise OSError(f"{path} could not be set aside")
    if not files.rename(new, place):
        files.rename(old, place)
        raise OSError(f"{path} could not be replaced")
    files.delete(old, True)


def replaced(df: DataFrame, path: str) -> None:
    """Write df as Parquet in the place of path, which df may itself read. At any time one of the two tables is whole."""
    _swapped(df.sparkSession, path, df.write.parquet)


def write_or_replace(df: DataFrame, path: str, source: str) -> None:
    """The lines of column raw at path; in the place of source, which df may itself read, where path is None or the same."""
    lines = df.select(F.col("raw").alias("value"))
    if path is None or path == source:
        _swapped(df.sparkSession, source, lines.write.text)
    else:
        lines.write.mode("overwrite").text(path)


def write_manifest(folder: str, name: str, file: str, prompt: str = "instruction", query: str = "input", response: str = "output") -> Path:
    """dataset_info.json: which file a data set is in, and which columns are prompt, query and response."""
    path = Path(folder) / "dataset_info.json"
    known = json.loads(path.read_text()) if path.exists() else {}
    known[name] = {"file_name": file, "columns": {"prompt": prompt, "query": query, "response": response}}
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(known, indent=2, ensure_ascii=False))
    return path
