"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A shard file is a run of records, as little-endian fields:

    u64 length | u32 masked crc32 of the length | payload | u32 masked crc32 of the payload

and a payload is ``i64 id | u8 1 if the id is NULL | u8 bytes per token (2 or 4) | token ids``.
A masked checksum is the crc32 rotated right by 15 bits plus a constant, so that
a checksum stored in data that is checksummed again stays a useful check.  The index file next to a shard
holds ``i64 id | u64 offset of the record | u32 tokens`` per record: a reader
can visit records in any order without reading the shard through.

Texts go to shards by ascending id (a range shuffle), each task encodes and
streams one shard to the shared folder and reports it in the manifest.  Files
of a failed or repeated task attempt carry another name and are never listed.

Defined cases: NULL text is empty (its record has the end id only); NULL ids come first;
rows that repeat an id are ordered by text, all are kept; an empty table writes no file and
reads back empty; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsieve.llm import textarrays as T
from netsieve.llm.encoding import encoder
from netsieve.llm.packing import file_system
from netsieve.llm.storage import map_arrow, materialise, tasks
from netsieve.session import scratch_path

#: Fixed value of the checksum mask.
MASK_DELTA = 0xA282EAD8
END_ID = 0
READ_BYTES = 4 << 20
_HEAD, _INDEX = "<qBB", "<qQI"
_MANIFEST = ("part long, path string, index_path string, records long, tokens long, bytes long")


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    kind = "<u2" if len(ids) == 0 or int(ids.max()) < 1 << 16 else "<u4"
    return struct.pack(_HEAD, doc_id or 0, doc_id is None, int(kind[-1])) + ids.astype(kind).tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from(_HEAD, payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_HEAD))


def records(stream) -> tuple[int, bytes]:
    """(offset, payload) of every record of an open shard, checksums verified."""
    data, at, base = b"", 0, 0
    while True:
        need = 12
        if len(data) - at >= 12:
            if struct.unpack_from("<I", data, at + 8)[0] != masked_crc(data[at:at + 8]):
                raise ValueError(f"record length damaged at byte {base + at}")
            size = struct.unpack_from("<Q", data, at)[0]
            need = 16 + size
            if len(data) - at >= need:
                payload = data[at + 12:at + 12 + size]
                if struct.unpack_from("<I", data, at + 12 + size)[0] != masked_crc(payload):
                    raise ValueError(f"record damaged at byte {base + at}")
                yield base + at, payload
                at += need
                continue
        more = stream.read(max(READ_BYTES, need))
        if not more:
            if at != len(data):
                raise ValueError(f"shard cut short at byte {base + at}")
            return
        data, base, at = data[at:] + more, base + at, 0


def record_at(uri: str, offset: int) -> tuple[int | None, np.ndarray]:
    """The record at an offset of the index."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        size, crc = struct.unpack("<QI", f.read(12))
        if crc != masked_crc(struct.pack("<Q", size)):
            raise ValueError(f"no record at byte {offset}")
        payload = f.read(size)
        if struct.unpack("<I", f.read(4))[0] != masked_crc(payload):
            raise ValueError(f"record damaged at byte {offset}")
    return parse(payload)


def index_entries(uri: str) -> list[tuple[int, int, int]]:
    """(id, offset, tokens) of an index file."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return list(struct.iter_unpack(_INDEX, f.read()))


def _write_rows(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        enc, ctx = encoder(tokenizer), TaskContext.get()
        part, out, index = ctx.partitionId(), None, None
        n = tokens = offset = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, t in T.slices(batch.column(1)):
                if out is None:
                    fs, path = file_system(f"{folder}/part-{part:06d}-{ctx.taskAttemptId()}")
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, index = fs.open_output_stream(f"{path}.rec"), fs.open_output_stream(f"{path}.idx")
                ids, count = enc.slice(t)
                cut = np.concatenate(([0], np.cumsum(count)))
                for i in range(len(count)):
                    own = np.append(ids[cut[i]:cut[i + 1]], np.uint32(end_id))
                    doc_id = doc_ids[lo + i]
                    record = frame(payload_of(doc_id, own))
                    out.write(record)
                    index.write(struct.pack(_INDEX, doc_id or 0, offset, len(own)))
                    offset += len(record)
                    tokens += len(own)
                n += len(count)
        if out is not None:
            out.close()
            index.close()
            name = f"{folder}/part-{part:06d}-{ctx.taskAttemptId()}"
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{name}.rec", "index_path": f"{name}.idx",
                                               "records": n, "tokens": tokens, "bytes": offset}])
    return run


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the shards and return their manifest (one row a shard, in id order by ``part``)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "records")
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .repartitionByRange(tasks(spark), "id").sortWithinPartitions("id", "text"))
    return materialise(map_arrow(rows, _write_rows(folder, tokenizer, end_id), _MANIFEST, keeps_tables=True), "manifest")


def _read_rows(batches):
    for batch in batches:
        for x in batch.to_pylist():
            start = x["base"]
            fs, path = file_system(x["path"])
            rows = []
            with fs.open_input_stream(path) as stream:
                for _, payload in records(stream):
                    doc_id, ids = parse(payload)
                    rows.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids),
                                 "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, _DIGEST)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, _DIGEST)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read back from the shards.

    The manifest has one row a shard; their running token totals are one small window.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    spread = placed.select("path", "base").repartition(tasks(manifest.sparkSession), "path")
    return map_arrow(spread, _read_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write every document, read the files back."""
    return read_digests(write_records(docs, tokenizer))
