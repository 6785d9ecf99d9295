"""Token ids in frequency-ranked, byte-aligned variable-length files with separate control bytes.

Ids are renamed to ranks by how often they occur in all documents, so frequent ids have small ranks.  A rank takes
one to four bytes; four two-bit lengths fill one control byte, and control bytes stand apart from data bytes, so a
block is decoded with one table lookup per control byte and no loop over values.

A file holds blocks, each with this head in little-endian order: magic ``QVB2``, documents (u32), values (u64),
control bytes (u64), data bytes (u64); then doc ids (i64 each, 0 for null), a byte for each that says whether it is
null, tokens of each document (u32 each), control bytes, data bytes.  The ranking is a file of its own, ``ranks.u32``: the id of each rank.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillon.llm.common import ceil_div, materialize, scratch, table
from quillon.llm.shared_files import opened, written
from quillon.llm.tokens import encoder, public_path

END_ID = 1
HEAD = "<4sIQQQ"
MAGIC = b"QVB2"
#: Byte lengths of the four values of each control byte, by the rule "two bits each, lowest first, plus one".
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(ceil_div(len(v), 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    keep = np.arange(4)[None, :] < size[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of control and data bytes."""
    if not n:
        return np.zeros(0, np.uint32)
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4)[None, :] < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids): each text's ids and the end id, packed two bytes each where the vocabulary allows, else four."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col}: document ids in token files are integers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        narrow = "<u2" if e.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        end = np.array([END_ID], narrow).tobytes()
        for b in batches:
            ids = [np.frombuffer(e.encode(t.as_py() or ""), "<u4").astype(narrow).tobytes() + end for t in b["text"]]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "ids": pa.array(ids, pa.binary()), "width": np.full(len(ids), np.dtype(narrow).itemsize, np.int32)})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids binary, width int")


def id_ranks(tokens: DataFrame) -> np.ndarray:
    """Every occurring id, the most frequent first, ties by id; at most one row per vocabulary entry reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(0, np.int64)
        for b in batches:
            for raw, width in zip(b["ids"], b["width"]):
                got = np.bincount(np.frombuffer(raw, f"<u{width}"))
                if len(got) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(got) - len(counts), np.int64)])
                counts[: len(got)] += got
        ids = np.flatnonzero(counts)
        yield pd.DataFrame({"id": ids, "n": counts[ids]})

    rows = tokens.select("ids", "width").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_tokens: int = 16_000_000,
    block_tokens: int = 500_000,
) -> DataFrame:
    """Write all texts' ids to files in ascending doc_id order; return one row per file, in order.

    Null texts are empty: their only id is the end id.  Null doc_ids come first and stay null.  Rows with equal doc_ids
    follow each other by a hash of their ids, then by their ids.  Doc_ids that are not integers raise TypeError.  An empty
    table gives no file.  Other columns are ignored.
    Returned columns: file (its place in the order), uri, n_docs, n_tokens.
    """
    tokens = materialize(encode_documents(docs, tokenizer, id_col, text_col), "token-ids")
    total = tokens.agg(F.sum(F.length("ids") / F.col("width")).cast("long").alias("n")).first()["n"] or 0
    ranking = id_ranks(tokens)
    with written(f"{folder}/ranks.u32") as f:
        f.write(ranking.astype("<u4").tobytes())
    rank_of = np.zeros(int(ranking.max(initial=0)) + 1, np.uint32)
    rank_of[ranking] = np.arange(len(ranking), dtype=np.uint32)
    n_files = max(1, ceil_div(total, file_tokens))

    def block(part: list[tuple[int | None, np.ndarray]]) -> bytes:
        values = np.concatenate([v for _, v in part])
        control, data = encode_values(values)
        ids = np.array([d or 0 for d, _ in part], "<i8").tobytes() + bytes(d is None for d, _ in part)
        sizes = np.array([len(v) for _, v in part], "<u4").tobytes()
        return struct.pack(HEAD, MAGIC, len(part), len(values), len(control), len(data)) + ids + sizes + control + data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, part, held, n_docs, n_tokens = TaskContext.get().partitionId(), [], 0, 0, 0
        uri = f"{folder}/part-{k:06d}.qvb"
        with written(uri) as f:
            for b in batches:
                for d, raw, width in zip(b["doc_id"].to_pylist(), b["ids"], b["width"].to_pylist()):
                    values = rank_of[np.frombuffer(raw.as_buffer(), f"<u{width}")]
                    part.append((d, values))
                    held += len(values)
                    n_docs += 1
                    n_tokens += len(values)
                    if held >= block_tokens:
                        f.write(block(part))
                        part, held = [], 0
            if part:
                f.write(block(part))
        yield pa.RecordBatch.from_pydict({"file": [k], "uri": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    order, hashed = F.col("doc_id").asc_nulls_first(), tokens.withColumn("tie", F.xxhash64("ids"))
    ordered = hashed.repartitionByRange(n_files, order, "tie").sortWithinPartitions(order, "tie", "ids").drop("tie")
    return materialize(ordered.mapInArrow(run, "file long, uri string, n_docs long, n_tokens long"), "token-files").where("n_docs > 0")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before), n_tokens, ids (little-endian u32), block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(f"{folder}/ranks.u32") as f:
            ranking = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for uri, base in zip(b["uri"].to_pylist(), b["base"].to_pylist()):
                start = base
                with opened(uri) as f:
                    while head := f.read(struct.calcsize(HEAD)):
                        magic, n_docs, n, n_control, n_data = struct.unpack(HEAD, head)
                        if magic != MAGIC:
                            raise ValueError(f"{uri}: not a block")
                        ids, null = np.frombuffer(f.read(8 * n_docs), "<i8"), np.frombuffer(f.read(n_docs), bool)
                        sizes = np.frombuffer(f.read(4 * n_docs), "<u4").astype(np.int64)
                        values = ranking[decode_values(f.read(n_control), f.read(n_data), n)]
                        ends = np.cumsum(sizes)
                        each = [values[e - s : e].tobytes() for s, e in zip(sizes, ends)]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64(), mask=null), "start": start + ends - sizes, "n_tokens": sizes, "ids": pa.array(each, pa.binary())})
                        start += n

    #: A window over the list of files, one row per file.
    before = F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    based = files.select("file", "uri", F.coalesce(before, F.lit(0)).alias("base"))
    return based.repartitionByRange(max(1, files.count()), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: where each document's ids lie in the files, and their checksum, as read back from the files."""
    folder = scratch(spark, "qvb")
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_path("word_bpe_49k.json"))
    return read_token_files(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
