"""Removal of repeated passages, found as three consecutive lines that occur more than once.

Every run of three non-blank lines of a document is hashed to 128 bits. A window that occurs at more than one place keeps
its first place (smallest document id, then text, then position) and loses the others; the lines that later windows cover
are merged and removed, so a passage of any number of lines from three on goes as a whole. Where a window overlaps its own
first occurrence (the same line many times), the lines of the first occurrence stay.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.llm.arrays import free_names, slices
from turnmill.session import materialize

WINDOW = 3
FLUSH = 1 << 15


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _windows(size: int):
    names = ["id", "mark", "pos", "hi", "lo"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [[], [], [], [], []]
                for i, (text, mark) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    lines = [x for x in map(str.strip, (text or "").split("\n")) if x]
                    for pos in range(len(lines) - size + 1):
                        value = xxhash.xxh3_128_intdigest("\n".join(lines[pos:pos + size]).encode("utf-8", "surrogatepass"))
                        for column, x in zip(rows, (i, mark, pos, _signed(value >> 64), _signed(value & ((1 << 64) - 1)))):
                            column.append(x)
                    if len(rows[0]) >= FLUSH:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[0])), *[pa.array(r, pa.int64()) for r in rows[1:]]], names=names)
                        rows = [[], [], [], [], []]
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[0])), *[pa.array(r, pa.int64()) for r in rows[1:]]], names=names)

    return run


def _strip(text: Column, spans: Column) -> Column:
    """struct(text, lines, removed): the text without the non-blank lines in the spans, and the line numbers taken out."""
    @F.arrow_udf("struct<text string, lines int, removed array<int>>")
    def run(texts: pa.Array, covers: pa.Array) -> pa.Array:
        kept, counts, gone = [], [], []
        for a, b in zip(slices(texts), slices(covers)):
            for value, cover in zip(a.to_pylist(), b.to_pylist()):
                lines = value.split("\n") if value is not None else []
                counts.append(len(lines))
                if not cover:
                    kept.append(value)
                    gone.append([])
                    continue
                full = [n for n, line in enumerate(lines) if line.strip()]
                drop, reach = set(), 0
                for span in sorted(cover, key=lambda s: (s["a"], s["b"])):
                    start = max(span["a"], reach)
                    drop.update(full[start:span["b"]])
                    reach = max(reach, span["b"])
                kept.append("\n".join(line for n, line in enumerate(lines) if n not in drop))
                gone.append(sorted(drop))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(counts, pa.int32()), pa.array(gone, pa.list_(pa.int32()))], names=["text", "lines", "removed"])

    return run(text, spans)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``id, mark, spans``: per document with repeated windows, the covered runs [a, b) of its non-blank lines."""
    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("mark"))
    windows = materialize(given.mapInArrow(_windows(size), f"id {id_type}, mark bigint, pos bigint, hi bigint, lo bigint"), "windows")
    # Null ids come last. Rows that agree in id and text are the same document, so they do not repeat each other.
    place = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("mark"), F.col("pos"))
    firsts = windows.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last")
    later = windows.join(firsts.select("hi", "lo", "first"), ["hi", "lo"]).filter(place != F.col("first"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    start = F.when(same, F.greatest("pos", F.col("first.pos") + size)).otherwise(F.col("pos"))
    spans = later.select("id", "mark", F.struct(start.alias("a"), (F.col("pos") + size).alias("b")).alias("span"))
    return spans.groupBy("id", "mark").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages taken out of the text, and the columns lines and removed added.

    ``lines`` counts the lines of the original text and ``removed`` lists the numbers (from 0) of those taken out. Null,
    empty and one- or two-line texts stay as they are; a null text has no lines. Rows that agree in id and text are one
    document and get the same result. An empty table gives no rows. Other columns stay.
    """
    spans = repeated_spans(docs, id_col, text_col, size).withColumnsRenamed({"id": "__id", "mark": "__mark", "spans": "__spans"})
    lines, removed = free_names(docs, "lines", "removed")
    marked = docs.withColumn("__own", F.xxhash64(F.col(text_col)))
    joined = marked.join(spans, marked[id_col].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")), "left")
    clean = joined.withColumn("__clean", _strip(F.col(text_col), F.col("__spans")))
    return clean.select(
        *[F.col("__clean.text").alias(text_col) if c == text_col else F.col(c) for c in docs.columns],
        F.col("__clean.lines").alias(lines), F.col("__clean.removed").alias(removed))
