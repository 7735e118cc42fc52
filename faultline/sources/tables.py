"""Work orders and taxonomy: all-string readers, column mapping, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.config import REQUIRED, ColumnMap
from faultline.errors import DataError
from faultline.functions.text import NA_TOKENS
from faultline.operators.sizes import number_rows
from faultline.sources.csv_records import PLACE, read_csv


def require_columns(df: DataFrame, expected: Sequence[str], source: str) -> None:
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise DataError(f"{source} lacks {len(missing)} required columns: {', '.join(missing)}")


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def _format(spark: SparkSession, path: str) -> str:
    """Parquet by suffix of the path or of any file below it, else CSV."""
    if path.rstrip("/").endswith(".parquet"):
        return "parquet"
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    try:
        return "csv" if listing.load(path).select("path").isEmpty() else "parquet"
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise DataError(f"no data at {path}") from error
        raise


def _read(spark: SparkSession, path: str, multiline: bool, fmt: str | None = None) -> DataFrame:
    fmt = fmt or _format(spark, path)
    try:
        if fmt == "parquet":
            df = spark.read.parquet(path)
        elif multiline:
            df = read_csv(spark, path)
        else:
            # no inference: every column stays text, so codes keep their leading zeros
            df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"')
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise DataError(f"no data at {path}") from error
        raise
    if not df.columns:
        raise DataError(f"{path} is empty")
    if fmt == "csv":
        df = df.withColumns({c: na_to_null(F.col(f"`{c}`")) for c in df.columns if c not in PLACE})
    return df


def load_work_orders(
    spark: SparkSession, path: str, required: Sequence[str] = (), multiline: bool = True, fmt: str | None = None,
    numbered: bool = False,
) -> DataFrame:
    """CSV (quoted line breaks, doubled quotes, usual missing-value texts) or Parquet; `fmt` says which, else the
    file names do.

    CSV files are split over tasks; without quoted line breaks switch `multiline` off, which spares the
    count of quotes. `numbered` adds `row_id`, the place of each row in the whole source: files by name, rows as they
    stand; group texts then list their lines in that order.
    """
    df = _read(spark, path, multiline, fmt)
    require_columns(df, required, path)
    if not numbered:
        return df.drop(*PLACE)
    if "row_id" in df.columns:
        raise DataError(f"{path} has a column row_id of its own")
    return number_rows(_with_place(df), list(PLACE), "row_id").drop(*PLACE)


def _with_place(df: DataFrame) -> DataFrame:
    """Adds the place of each row in its source, where the reader has not."""
    if PLACE[0] in df.columns:
        return df
    # rows of a split are numbered in their order; a Parquet file's rows carry their own number, whatever splits there are
    hidden = df.select("_metadata").schema["_metadata"].dataType.names
    row = F.col("_metadata.row_index") if "row_index" in hidden else F.monotonically_increasing_id()
    block = F.lit(0).cast("long") if "row_index" in hidden else F.col("_metadata.file_block_start")
    return df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), block.alias(PLACE[1]), row.alias(PLACE[2]))


#: Names that the phases use for columns of their own.
RESERVED = {"row_id", "row_key", "branch", "skip", "code", "topology", "route", "spec", "spec_value", "context", "n_chars",
            "parts_hash", "line", "op_status", "op_reasoning", "non_failure", "needs_semantic", "options_key"}
KEPT = "_user_"


def map_columns(df: DataFrame, columns: ColumnMap) -> DataFrame:
    """User columns under canonical names, as text; absent optional ones are NULL.

    All other columns come along; one whose name the phases use for something else is put aside under a prefixed
    name, which `user_columns` takes off again. `row_id` gives rows their order: a column of that name if there is
    one, else the work order's number as text, in which 10 comes before 2.
    """
    require_columns(df, [user for canon, user in columns.pairs() if canon in REQUIRED], "work orders")
    row_id = F.col("row_id") if "row_id" in df.columns else F.col(f"`{columns.wo_id}`").cast("string")
    mapped = {user for _, user in columns.pairs()}
    taken = RESERVED | {canon for canon, _ in columns.pairs()}
    return df.select(row_id.alias("row_id"), *[
        (F.col(f"`{user}`").cast("string") if user in df.columns else F.lit(None).cast("string")).alias(canon)
        for canon, user in columns.pairs()], *[
        F.col(f"`{c}`").alias(f"{KEPT}{c}" if c.lower() in taken else c) for c in df.columns if c not in mapped])


def user_columns(df: DataFrame, columns: ColumnMap) -> DataFrame:
    """The reverse of `map_columns` for the final table: the user's own column names."""
    own = df.drop("row_id").withColumnsRenamed(dict(columns.pairs()))
    return own.withColumnsRenamed({c: c[len(KEPT):] for c in own.columns if c.startswith(KEPT)})


def load_taxonomy(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(ord, code, name) of a Code, Name table; its row order is kept as `ord`: files by name, rows as they stand."""
    df = _read(spark, path, multiline=True, fmt=fmt)
    require_columns(df, ["Code", "Name"], path)
    if "ord" in df.columns:
        taxonomy = df.select(F.col("ord").cast("bigint").alias("ord"), F.col("Code").alias("code"), F.col("Name").alias("name"))
    else:
        placed = _with_place(df).select(*PLACE, F.col("Code").alias("code"), F.col("Name").alias("name"))
        taxonomy = number_rows(placed, list(PLACE), "ord").select("ord", "code", "name")
    if taxonomy.isEmpty():
        raise DataError(f"{path} holds no taxonomy rows")
    return taxonomy


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV that `load_work_orders` reads back unchanged."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def export_final(df: DataFrame, path: str, fmt: str = "parquet", by_status: bool = False) -> None:
    """Labelled table as Parquet or CSV, one folder per QA status if asked."""
    if fmt == "csv" and not by_status:
        write_csv(df, path, "overwrite")
        return
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"',
                                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (writer.partitionBy("QA_Status") if by_status else writer).save(path)
