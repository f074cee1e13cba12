"""Token ids in length-delimited binary records (op6).

A shard is a sequence of records, each framed as: length of the payload (8 bytes, little-endian), masked CRC-32C of these 8 bytes
(4), the payload, masked CRC-32C of the payload (4). A payload is: document id (8, signed), flags (1: bit 0 the id is null, bit 1
ids are 4 bytes wide, else 2), then the ids, little-endian. Beside each shard stands an index of fixed entries - offset of the
record, its length, number of ids, each 8 bytes - for reads in any order.

Shards hold documents in ascending order of doc_id (nulls first; rows with the same id in the order of their texts), and shards are
in order themselves. A null text is an empty one; it has the end id only. Repeated rows are each written.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared, textscan, tokens

#: Fixed values of the format: the Castagnoli polynomial, reflected, and the constant of the mask.
CRC32C_POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

BLOCK = 64


def _crc_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The table of two bytes, and for each k the four byte tables that move a remainder past BLOCK * 2**k zero bytes."""
    state = textscan.process_state()
    if "crc" not in state:
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), t >> 1).astype(np.uint32)
        basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(BLOCK):
            basis = t[basis & 0xFF] ^ (basis >> 8)
        shifts = []
        for _ in range(40):
            tables = np.zeros((4, 256), np.uint32)
            for byte in range(4):
                for bit in range(8):
                    tables[byte, (np.arange(256) >> bit & 1).astype(bool)] ^= basis[8 * byte + bit]
            shifts.append(tables)
            basis = _moved(tables, basis)
        low, high = np.tile(np.arange(256), 256), np.repeat(np.arange(256), 256).astype(np.uint32)
        c = t[low] ^ high
        state["crc"] = t[c & 0xFF] ^ (c >> 8), shifts
    return state["crc"]


def _moved(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 0xFF] ^ tables[1][c >> 8 & 0xFF] ^ tables[2][c >> 16 & 0xFF] ^ tables[3][c >> 24]


def masked_crc32c(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each buf[offs[i]:offs[i+1]], all at once; each span has 4 bytes at least."""
    table, shifts = _crc_tables()
    raw, edges = memoryview(np.ascontiguousarray(buf)), offs.tolist()
    size = np.diff(offs)
    blocks = -(-size // BLOCK)
    # zero bytes in front change nothing
    wide = np.frombuffer(b"".join(bytes(raw[a:b]).rjust(n * BLOCK, b"\0") for a, b, n in zip(edges[:-1], edges[1:], blocks.tolist(), strict=True)), np.uint8).copy()
    first = np.cumsum(blocks) * BLOCK - size
    for k in range(4):
        wide[first + k] ^= 0xFF
    pairs = np.ascontiguousarray(wide.view("<u2").reshape(-1, BLOCK // 2).T)
    c = np.zeros(pairs.shape[1], np.uint32)
    for row in pairs:
        c = table[(c ^ row) & 0xFFFF] ^ (c >> 16)
    level = 0
    while len(blocks) and blocks.max() > 1:
        half = -(-blocks // 2)
        pairs = np.zeros(int(half.sum()) * 2, np.uint32)
        begin = 2 * (np.cumsum(half) - half) + (blocks & 1)
        pairs[np.repeat(begin - (np.cumsum(blocks) - blocks), blocks) + np.arange(int(blocks.sum()))] = c
        c = _moved(shifts[level], pairs[0::2]) ^ pairs[1::2]
        blocks, level = half, level + 1
    c = ~c
    return ((c >> 15) | (c << 17)) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """(records one after another, offset of each)."""
    size = np.array([len(p) for p in payloads], np.int64)
    heads = size.astype("<u8").view(np.uint8)
    head_crc = masked_crc32c(heads, np.arange(len(size) + 1) * 8).astype("<u4")
    body = np.frombuffer(b"".join(payloads), np.uint8)
    body_crc = masked_crc32c(body, np.concatenate([[0], np.cumsum(size)])).astype("<u4")
    parts = []
    for k, p in enumerate(payloads):
        parts += [heads[8 * k : 8 * k + 8].tobytes(), head_crc[k].tobytes(), p, body_crc[k].tobytes()]
    return b"".join(parts), np.concatenate([[0], np.cumsum(size + 16)[:-1]]) if len(size) else size


def unframe(data: bytes) -> list[bytes]:
    """Payloads of whole records; raises where a checksum doesn't hold or the data end within a record."""
    payloads, heads, crcs, at = [], [], [], 0
    while at < len(data):
        if at + 16 > len(data) or at + 16 + (n := struct.unpack_from("<Q", data, at)[0]) > len(data):
            raise ValueError("the data end within a record")
        heads.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + n])
        crcs.append((struct.unpack_from("<I", data, at + 8)[0], struct.unpack_from("<I", data, at + 12 + n)[0]))
        at += 16 + n
    if payloads:
        want = np.array(crcs, np.uint32)
        size = np.array([len(p) for p in payloads], np.int64)
        got = masked_crc32c(np.frombuffer(b"".join(heads), np.uint8), np.arange(len(size) + 1) * 8), masked_crc32c(np.frombuffer(b"".join(payloads), np.uint8), np.concatenate([[0], np.cumsum(size)]))
        if (got[0] != want[:, 0]).any() or (got[1] != want[:, 1]).any():
            raise ValueError("a record's checksum doesn't hold")
    return payloads


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pafs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's default file system has it: executors open the same files as Spark does."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/+", "file:///", full)


def write(docs: DataFrame, out_dir: str, vocabulary: str, end_id: int = 0, partitions: int | None = None) -> list[dict]:
    """Encode every text of docs (doc_id, text) and write shards with their indexes; returns a row for each shard, in order.

    Each task writes its shard under a name of its own and moves it into place when complete, so that a task that runs twice does no
    harm. The list that comes back has one row for each partition, whatever the number of documents.
    """
    out_dir = qualified(docs.sparkSession, out_dir)
    fs, root = _filesystem(out_dir)
    fs.create_dir(root, recursive=True)
    key = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text")
    rows = (rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")).sortWithinPartitions(*key)

    def run(batches):
        from pyspark import TaskContext

        code = tokens.encoder(vocabulary)
        ctx = TaskContext.get()
        name = f"shard-{ctx.partitionId():08d}"
        fs, root = _filesystem(out_dir)
        tmp = f"{root}/.{name}-{ctx.taskAttemptId()}-{uuid.uuid4().hex}"
        width, end = code.dtype.itemsize, np.array([end_id], code.dtype).tobytes()
        n_docs = n_ids = at = 0
        with fs.open_output_stream(f"{tmp}.rec") as out, fs.open_output_stream(f"{tmp}.idx") as idx:
            for batch in batches:
                for first in range(0, batch.num_rows, 1024):
                    part = batch.slice(first, 1024)
                    ids = code.encode([t or "" for t in part.column(1).to_pylist()])
                    payloads = [struct.pack("<qB", i or 0, (i is None) | 2 * (width == 4)) + x + end for i, x in zip(part.column(0).to_pylist(), ids, strict=True)]
                    data, offs = frame(payloads)
                    count = np.array([(len(p) - 9) // width for p in payloads], np.int64)
                    size = np.array([len(p) + 16 for p in payloads], np.int64)
                    out.write(data)
                    idx.write(np.stack([offs + at, size, count], 1).astype("<u8").tobytes())
                    at, n_docs, n_ids = at + len(data), n_docs + len(payloads), n_ids + int(count.sum())
        if n_docs:
            for kind in ("rec", "idx"):
                fs.move(f"{tmp}.{kind}", f"{root}/{name}.{kind}")
            yield pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [at]}, SHARD)
        else:
            for kind in ("rec", "idx"):
                fs.delete_file(f"{tmp}.{kind}")

    return sorted((r.asDict() for r in rows.mapInArrow(run, "shard string, n_docs long, n_ids long, n_bytes long").collect()), key=lambda r: (len(r["shard"]), r["shard"]))


SHARD = pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def payload_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc, flags = struct.unpack_from("<qB", payload)
    return None if flags & 1 else doc, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


def read_one(out_dir: str, shard: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th document of a shard by its index alone: one small read for a shuffled reader."""
    fs, root = _filesystem(out_dir)
    with fs.open_input_file(f"{root}/{shard}.idx") as f:
        at, size, _ = struct.unpack("<QQQ", f.read_at(24, 24 * k))
    with fs.open_input_file(f"{root}/{shard}.rec") as f:
        return payload_ids(unframe(f.read_at(size, at))[0])


def read_back(spark: SparkSession, out_dir: str, shards: list[dict], work, schema: str, fields: pa.Schema) -> DataFrame:
    """One task for each shard; ``work(doc_ids, arrays of ids, number of ids before them)`` gives a dict of columns for each few MB."""
    out_dir, start, rows = qualified(spark, out_dir), 0, []
    for s in shards:
        rows.append((s["shard"], start))
        start += s["n_ids"]
    listed = spark.createDataFrame(rows, "shard string, start long").repartition(max(1, len(rows)), "shard") if rows else spark.createDataFrame([], "shard string, start long")

    def run(batches):
        fs, root = _filesystem(out_dir)
        for batch in batches:
            for shard, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/{shard}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 3).astype(np.int64)
                with fs.open_input_stream(f"{root}/{shard}.rec") as f:
                    at = 0
                    while at < len(index):
                        last = max(at + 1, int(np.searchsorted(index[:, 0] + index[:, 1], index[at, 0] + (4 << 20), "right")))
                        docs = [payload_ids(p) for p in unframe(f.read(int(index[at:last, 1].sum())))]
                        starts = before + np.concatenate([[0], np.cumsum(index[at:last, 2])])
                        yield pa.RecordBatch.from_pydict(work([d for d, _ in docs], [i for _, i in docs], starts[:-1]), fields)
                        at, before = last, int(starts[-1])

    return listed.mapInArrow(run, schema)


def op6_binary_records(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Digest of each document as read from the record files: doc_id, start, n_tokens, ids_crc32."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    out_dir = f"{shared.shared_dir(spark)}/records-{uuid.uuid4().hex}"
    shards = write(shared.table(spark, sf_dir, "documents"), out_dir, vocabulary)

    def digest(docs, ids, starts):
        return {"doc_id": docs, "start": starts, "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]}

    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return read_back(spark, out_dir, shards, digest, "doc_id long, start long, n_tokens long, ids_crc32 long", fields)
