"""CSV files read by many tasks each, though quoted fields may hold line breaks.

Files are split at line ends as texts are. A line begins a record where the quotes before it in the file are even in number,
which a doubled quote does not change. So the quotes of each split are counted, a running sum over the splits
says whether a split begins inside quotes, and every task puts its own lines together. What is left is at most two
fragments a split, of records that reach over its ends; they are joined in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.errors import DataError
from faultline.sources.scratch import stored

#: Pieces of records: whole ones, the end of one begun before, all of a split inside one, and the begin of one that goes on.
WHOLE, END, INSIDE, BEGIN = range(4)
PIECES = "_file string, _from long, _row long, kind int, text string"


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(lines with file and split, names that the folders bring); a task has the lines of a split in their order."""
    text = spark.read.text(path, lineSep="\n")
    folders = [c for c in text.columns if c != "value"]
    return text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
                       F.col("value").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in folders]).alias("_folders")), folders


def _split_parities(lines: DataFrame) -> DataFrame:
    """(file, split, odd): whether a split begins inside quotes. One narrow row a split."""
    quotes = F.sum(F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))).cast("long")
    sums = lines.groupBy("_file", "_from").agg(quotes.alias("n"), F.first("_folders").alias("_folders"))
    before = Window.partitionBy("_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_file", "_from", "_folders", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("odd"))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, split, odd, text) to pieces, numbered by their first line in the split. Lines that are records by
    themselves are passed on as they are."""
    split, seen, inside = None, 0, False
    held: list[str] = []                     # lines of the record that is open, what it is so far, and its first line
    kind, first = BEGIN, 0

    def pieces(kinds: list[int], rows, texts) -> pa.RecordBatch:
        n = len(kinds)
        return pa.RecordBatch.from_arrays([
            pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()), pa.array(rows, pa.int64()),
            pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], ["_file", "_from", "_row", "kind", "text"])

    def left() -> Iterator[pa.RecordBatch]:
        if held:
            yield pieces([INSIDE if kind == END else BEGIN], [first], ["\n".join(held)])

    for batch in batches:
        if not batch.num_rows:
            continue
        files, froms, odd, text = (batch.column(i) for i in range(4))
        changed = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(froms[1:], froms[:-1])).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, changed)).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if (here := (files[a].as_py(), froms[a].as_py())) != split:
                yield from left()
                split, seen, inside, held, first = here, 0, odd[a].as_py(), [], 0
                kind = END if inside else BEGIN
            own = text.slice(a, b - a)
            after = (np.cumsum(pc.count_substring(own, '"').to_numpy(zero_copy_only=False)) + inside) % 2 == 1
            before = np.append(inside, after[:-1])
            alone = np.flatnonzero(~before & ~after)
            if len(alone):
                yield pieces([WHOLE] * len(alone), seen + alone, own.take(pa.array(alone)))
            kinds, rows, texts = [], [], []
            for i in np.flatnonzero(before | after).tolist():
                if not before[i]:
                    held, kind, first = [], BEGIN, seen + i
                held.append(own[i].as_py())
                if not after[i]:
                    kinds.append(WHOLE if kind == BEGIN else END)
                    rows.append(first)
                    texts.append("\n".join(held))
                    held = []
            if texts:
                yield pieces(kinds, rows, texts)
            inside, seen = bool(after[-1]), seen + b - a
    yield from left()


def csv_records(lines: DataFrame, parities: DataFrame) -> DataFrame:
    """(_file, _from, _row, text): one row a record; the first three give its place."""
    # a row a split, so a millionth of the input at most
    parities = F.broadcast(parities.select("_file", "_from", "odd"))
    lines = lines.select("_file", "_from", "text")
    found = stored(lines.join(parities, ["_file", "_from"]).select("_file", "_from", "odd", "text").mapInArrow(_assemble, PIECES), "records")
    upto = Window.partitionBy("_file").orderBy("_from", F.col("kind") == BEGIN)
    torn = found.where(F.col("kind") != WHOLE).withColumn("group", F.sum(F.when(F.col("kind") == BEGIN, 1).otherwise(0)).over(upto))
    joined = torn.groupBy("_file", "group").agg(F.min(F.struct("_from", "_row")).alias("place"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_from", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return found.where(F.col("kind") == WHOLE).select("_file", "_from", "_row", "text").unionByName(
        joined.select("_file", "place._from", "place._row", "text"))


PLACE = ("_file", "_from", "_row")
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with `_file`, `_from` and `_row` as the place of each record.

    The names are the first record's of the first file; the first record of every file is left out. Blank records are none.
    Lines end in a line feed, with or without a carriage return.
    """
    lines, folders = _lines(spark, path)
    parities = stored(_split_parities(lines), "parities")
    records = csv_records(lines, parities).withColumn("text", F.regexp_replace("text", r"\r$", "")).where(F.length(F.trim("text")) > 0)
    heads = records.groupBy("_file").agg(F.min_by(F.struct("_from", "_row", "text"), F.struct("_from", "_row")).alias("head"))
    heads = stored(heads.select("_file", "head.*"), "heads")
    head = heads.orderBy("_file").first()
    if head is None:
        raise DataError(f"{path} is empty")
    width = spark.range(1).select(F.size(F.split(F.regexp_replace(F.lit(head.text), r'"(?:[^"]|"")*"', ""), ","))).first()[0]
    fields = spark.range(1).select(F.from_csv(F.lit(head.text.lstrip("\ufeff")), ", ".join(f"_{i} string" for i in range(width)), OPTIONS).alias("h")).first().h
    names = [n if n is not None else f"_c{i}" for i, n in enumerate(fields)]
    names = [f"{n}{i}" if [x.lower() for x in names].count(n.lower()) > 1 else n for i, n in enumerate(names)]
    body = records.join(F.broadcast(heads.select("_file", "_from", "_row")), ["_file", "_from", "_row"], "left_anti")
    parsed = F.from_csv("text", ", ".join(f"_{i} string" for i in range(width)), OPTIONS)
    row = body.select("_file", "_from", "_row", parsed.alias("r"))
    values = [F.col(f"r._{i}").alias(n) for i, n in enumerate(names)]
    if folders:
        of_file = parities.groupBy(F.col("_file").alias("_f")).agg(F.first("_folders").alias("_folders"))
        row = row.join(F.broadcast(of_file), F.col("_file") == F.col("_f"))
        values += [F.col(f"_folders.`{c}`").cast("string").alias(c) for c in folders]
    return row.select(*PLACE, *values)
