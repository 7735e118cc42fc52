"""What several operators share: whole texts as byte buffers, and text blocks in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.scratch import stored

#: ASCII white space of the word definition: space and bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_SPLIT = r"[\x20\x09-\x0D]+"
#: Text bytes gathered in one block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Rows handed to Python at a time when blocks are made, which also bounds the rows of a block.
BATCH_ROWS = 2000


def share_library(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this library wherever the session was started.

    On a cluster it is shipped to the executors as any package is.
    """
    root = str(Path(__file__).resolve().parents[2])
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        own = spark.sparkContext.environment
        paths = [p for p in own.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            own["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


@contextmanager
def record_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows handed to Python at a time while the body runs its jobs; long texts make the usual 10,000 heavy."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Whole texts packed into compressed blocks and stored once: (block, size, ids, lengths, payload).

    A block and a place in it name a row from then on, whatever its id is (null or repeated ids too).
    Blocks hold about `block_bytes` of text, so a task has one of them in memory at a time.
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)

        def block(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([ids.to_pylist()], pa.list_(ids.type)),
                pa.array([len(data)], pa.int64()), pa.array([np.diff(offsets).tobytes()], pa.binary()),
                pa.array([press.compress(data.tobytes())], pa.binary())], ["ids", "size", "lengths", "payload"])

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1)
                last = min(last, batch.num_rows)
                yield block(batch.column(0).slice(first, last - first),
                            data[offsets[first]: offsets[last]], offsets[first: last + 1])
                first = last

    packed = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        pack, f"ids array<{id_type}>, size long, lengths binary, payload binary")
    with record_batches(docs.sparkSession, BATCH_ROWS * max(1, block_bytes // BLOCK_BYTES)):
        return stored(packed.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


def unpack(lengths: bytes, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a block."""
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))])
    data = zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, int(offsets[-1])))
    return np.frombuffer(data, np.uint8), offsets


def row_blocks(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Blocks whose ids are whole rows: a struct of all columns but the text."""
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c != text_column]
    return text_blocks(docs.select(F.struct(*others).alias("row"), F.col(f"`{text_column}`").alias("text")), "row", "text")


def flat_ids(side: pa.Table) -> pa.Array:
    """The ids of a block's texts."""
    return side["ids"].combine_chunks().flatten()


def take_rows(blocks: DataFrame, kept: DataFrame, docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of `docs` at the places (block, doc) of `kept`, from `row_blocks(docs)`."""
    row_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"row": flat_ids(left), "text": pa.array([], pa.string())})
        data, offsets = unpack(left["lengths"][0].as_py(), left["payload"][0].as_py())
        places = np.sort(right["doc"].to_numpy())
        raw = data.tobytes()
        texts = [raw[offsets[i]: offsets[i + 1]] for i in places.tolist()]
        return pa.table({"row": flat_ids(left).take(pa.array(places)), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    rows = blocks.groupBy("block").cogroup(kept.select("block", "doc").groupBy("block")).applyInArrow(
        run, f"row {row_type}, text string")
    return rows.select(*[F.col("text").alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
