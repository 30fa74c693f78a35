"""Flow CSV folders: write (K1) and ingest.

Ingest reads a folder of CSV files with a declared schema (no inference
pass), strips header whitespace, derives ``day`` and ``source_file`` from the
file a row came from, reports unreadable files and malformed rows, and
assigns a global 0-based ``row_id`` in (file name, position) order with the
two-pass index -- the reference's "position after ordered concat".
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsieve.functions.columns import strip_column_names
from netsieve.functions.expressions import day_from_file
from netsieve.operators.rowindex import with_row_index

CORRUPT = "_corrupt_record"
# Identifier columns dropped at ingest when present.
ID_COLUMNS = ["Flow ID", "Source IP", "Destination IP", "Timestamp"]


def write_flow_csvs(df: DataFrame, path: str, file_col: str = "source_file",
                    order_col: str | None = None, files_per_source: int | None = None,
                    compression: str = "none") -> None:
    """K1: one folder per source file name (``file_col=value``), header line, rows in order.

    Range partitioning by (file, order) keeps each part file sorted and the
    part names in row order, without one task per source file.
    """
    out = df
    if order_col:
        n = files_per_source or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = df.repartitionByRange(n, file_col, order_col).sortWithinPartitions(file_col, order_col)
    out.write.mode("overwrite").option("header", True).option("compression", compression).partitionBy(file_col).csv(path)


def _data_files(spark: SparkSession, path: str) -> list[str]:
    """Data files under a folder, in name order."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    it = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    out = []
    while it.hasNext():
        p = it.next().getPath()
        if not p.getName().startswith(("_", ".")):
            out.append(p.toString())
    return sorted(out)


PIECE = 1 << 20
STATUS = "file string, header array<string>, n_bytes long, problem string"


def _inspect(name: str) -> tuple[list[str] | None, int | None, str | None]:
    """(column names, bytes, problem) of one file, streamed in pieces: a plain file up to its first line, gzip to its end.

    A line longer than a piece is no header.  Decompressed pieces are bounded too, however well a file packs.
    """
    import zlib

    import pyarrow as pa
    from pyarrow.fs import FileSystem
    try:
        remote = re.match(r"(?!file:)(\w+://[^/]*)(/.*)", name)  # the path is no URI: % is an ordinary character
        fs, root = FileSystem.from_uri(remote[1] + "/" if remote else "/")
        inner = root.rstrip("/") + (remote[2] if remote else re.sub(r"^file:/+", "/", name))
        size, head, more = fs.get_file_info(inner).size, b"", True
        with fs.open_input_stream(inner, compression=None) as stream:
            packed = zlib.decompressobj(31) if name.endswith(".gz") else None
            while (piece := stream.read(PIECE)) and more:
                if packed is None:
                    head += piece
                    more = b"\n" not in head and len(head) <= PIECE
                text = b""
                while packed is not None and (piece or len(text) == PIECE):  # a full piece may leave more inside
                    if packed.eof:
                        if not piece:
                            break
                        packed = zlib.decompressobj(31)  # the next member
                    text = packed.decompress(piece, PIECE)
                    if b"\n" not in head and len(head) <= PIECE:
                        head += text
                    piece = packed.unused_data if packed.eof else packed.unconsumed_tail
            if packed is not None and not packed.eof:
                return None, size, "cut short"
    except (OSError, pa.ArrowInvalid) as e:
        return None, None, f"not readable: {type(e).__name__}"
    except zlib.error:
        return None, size, "not gzip data"
    line, end, _ = head.partition(b"\n")
    if len(line) > PIECE:
        return None, size, "no header line"
    try:
        header = next(csv.reader([line.decode("utf-8-sig").rstrip("\r")]), [])
    except UnicodeDecodeError:
        return None, size, "header is not UTF-8"
    return (header, size, None) if header else (None, size, "empty")


def _inspect_rows(batches):
    import pyarrow as pa
    for batch in batches:
        for name in batch.column(0).to_pylist():
            header, size, problem = _inspect(name)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([header], pa.list_(pa.string())), pa.array([size], pa.int64()),
                 pa.array([problem], pa.string())], names=["file", "header", "n_bytes", "problem"])


def file_status(spark: SparkSession, path: str) -> DataFrame:
    """File, header, n_bytes and problem (NULL: readable) of every data file under a folder.

    Only names are listed on the driver.  Each file is opened and streamed in a
    task, so neither the number of headers nor the size of a gzip file matters to
    a single row or to the driver.  An empty folder gives no rows.
    """
    files = _data_files(spark, path)
    names = spark.createDataFrame([(f,) for f in files], "file string")
    dealt = names.repartition(max(1, min(len(files), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return dealt.mapInArrow(_inspect_rows, STATUS)


def readable_files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """{file: column names} of the files that can be read to their end, in name order."""
    good = file_status(spark, path).where("problem is null").select("file", "header").collect()
    return {r.file: list(r.header) for r in sorted(good, key=lambda r: r.file)}


def load_status(spark: SparkSession, path: str, df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """S2 + K4: per source, what the files say and what the ingest ``df`` of them kept, as one table.

    Columns: ``file_col``, n_columns, n_unreadable files, n_rows and n_malformed.
    A source whose files are all unreadable stays, with 0 rows and NULL columns.
    """
    folder = F.nullif(F.regexp_extract("file", f"/{re.escape(file_col)}=([^/]*)/", 1), F.lit(""))
    source = F.coalesce(F.try_url_decode(F.regexp_replace(folder, r"\+", "%2B")), folder,
                        F.regexp_extract("file", "([^/]*)$", 1))
    files = file_status(spark, path).groupBy(source.alias(file_col)).agg(
        F.max(F.size(F.filter("header", lambda c: c.isNotNull()))).alias("n_columns"),
        F.count_if(F.col("problem").isNotNull()).alias("n_unreadable"))
    rows = load_report(df, file_col).where(F.col(file_col).isNotNull())
    return files.join(rows, file_col, "left").select(
        file_col, F.when(F.col("n_columns") >= 0, F.col("n_columns")).alias("n_columns"), "n_unreadable",
        F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"),
        F.coalesce("n_malformed", F.lit(0).cast("long")).alias("n_malformed"))


def read_flow_csvs(spark: SparkSession, path: str, schema: T.StructType,
                   file_col: str = "source_file", index_col: str = "row_id",
                   drop_ids: bool = True) -> DataFrame:
    """S1 + S2 + C1 + C3 + F1 + W1 + U1: scan a CSV folder into one indexed flow table.

    ``schema`` lists the data columns (names are compared without surrounding
    blanks).  Columns are matched by header name, file by file: files of one
    header are one scan, scans are united by name, a column that a file lacks is
    NULL there, and a header name outside the schema is an error.  Rows that do
    not parse keep their text in ``_corrupt_record``; files that cannot be read
    to their end contribute nothing and are listed by ``file_status`` and ``missing_files``.
    """
    types = {f.name.strip(): f.dataType for f in schema.fields}
    by_header: dict[tuple, list[str]] = {}
    for file, header in readable_files(spark, path).items():
        unknown = [c for c in header if c.strip() not in types]
        if unknown:
            raise ValueError(f"columns {unknown} of {file} are not in the schema")
        by_header.setdefault(tuple(header), []).append(file)
    parts = []
    for header, files in by_header.items():
        fields = [T.StructField(c, types[c.strip()]) for c in header] + [T.StructField(CORRUPT, T.StringType())]
        raw = (spark.read.schema(T.StructType(fields)).option("header", True).option("mode", "PERMISSIVE")
               .option("enforceSchema", False).option("columnNameOfCorruptRecord", CORRUPT)
               .option("basePath", path).csv(files))
        if file_col not in raw.columns:  # plain folder: provenance from the file name
            raw = raw.withColumn(file_col, F.col("_metadata.file_name"))
        parts.append(strip_column_names(raw.select(
            "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seq"))))
    if not parts:
        empty = T.StructType([T.StructField(c, t) for c, t in types.items()]
                             + [T.StructField(c, T.StringType()) for c in (CORRUPT, file_col, "_file")]
                             + [T.StructField(c, T.LongType()) for c in ("_block", "_seq")])
        parts = [spark.createDataFrame([], empty)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    order = [*[c for c in types if c in df.columns], CORRUPT, file_col, "_file", "_block", "_seq"]
    df = df.select(*[F.col(f"`{c}`") for c in order]).withColumn("day", day_from_file(file_col))
    indexed = with_row_index(df, [file_col, "_file", "_block", "_seq"], index_col)
    out = indexed.drop("_file", "_block", "_seq")
    if drop_ids:
        out = out.drop(*ID_COLUMNS)
    return out


def load_report(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """S2 + S3: rows and malformed rows per file, plus a total row (file = NULL)."""
    bad = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    return df.rollup(file_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count_if(bad).alias("n_malformed"))


def missing_files(spark: SparkSession, path: str, df: DataFrame,
                  file_col: str = "source_file") -> list[str]:
    """Source folders/files present on storage that produced no row (unreadable)."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = set()
    for st in fs.listStatus(hpath):
        name = st.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        listed.add(name.split("=", 1)[1] if "=" in name else name)
    seen = {r[0] for r in df.select(file_col).distinct().collect()}
    return sorted(listed - seen)
