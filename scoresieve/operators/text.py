"""Texts of records: assembly, truncation, embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def assembled(fields: Sequence[str]) -> Column:
    """The fields that are neither null nor empty, with line breaks between."""
    return F.concat_ws("\n", *(F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields))


def truncated(table: DataFrame, most: int, text: str = "text") -> DataFrame:
    """Replace text by its first `most` tokens between white space, where it has more; add n_tokens and truncated."""
    tokens = F.array_remove(F.split(F.col(text), r"\s+"), "")
    long = F.size(tokens) > most
    return table.withColumns({"n_tokens": F.size(tokens), "truncated": long, text: F.when(long, F.array_join(F.slice(tokens, 1, most), " ")).otherwise(F.col(text))})


def truncated_by(table: DataFrame, most: int, encode: Callable[[str], list], decode: Callable[[list], str], text: str = "text") -> DataFrame:
    """As ``truncated`` with a tokenizer of one's own, in Arrow batches."""

    @F.arrow_udf("struct<text string, n_tokens int, truncated boolean>")
    def cut(column: pa.Array) -> pa.Array:
        out = []
        for s in column.to_pylist():
            ids = encode(s or "")
            out.append({"text": s if len(ids) <= most else decode(ids[:most]), "n_tokens": len(ids), "truncated": len(ids) > most})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_tokens", pa.int32()), ("truncated", pa.bool_())]))

    return table.withColumn("_cut", cut(F.col(text))).withColumns({text: F.col("_cut.text"), "n_tokens": F.col("_cut.n_tokens"), "truncated": F.col("_cut.truncated")}).drop("_cut")


def truncation_report(table: DataFrame, line: str = "line_idx") -> DataFrame:
    """Lines of the truncated texts, in order."""
    return table.where("truncated").select(line).orderBy(line)


def embedded(table: DataFrame, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], text: str = "text", name: str = "vector", most: int = 16_384) -> DataFrame:
    """Add vectors from a model: load gives, once in each task, a function from a batch of at most `most` texts to their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in (whole.slice(at, most) for whole in batches for at in range(0, whole.num_rows, most)):
            model = model or load()
            vectors = model([s or "" for s in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            values = pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    schema = T.StructType([*table.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    return table.mapInArrow(run, schema)


def doc_metrics(table: DataFrame, text: str = "text") -> DataFrame:
    """Add chars, words and unique_words of a text, as simple scores."""
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), "")
    return table.withColumns({"chars": F.length(F.coalesce(F.col(text), F.lit(""))).cast("double"), "words": F.size(words).cast("double"), "unique_words": F.size(F.array_distinct(words)).cast("double")})
