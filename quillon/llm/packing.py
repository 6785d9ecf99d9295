"""Hierarchical packing of documents into training sequences of several lengths.

Each document is routed by its length to a tier, the smallest window that holds it; what exceeds the longest window
is cut into whole longest windows.  Every tier's windows are opened by its own documents, the longest first, and their
gaps are filled from shorter tiers, and once these are used up from the tier itself, with the largest piece that fits
and else the start of one that does not.  Windows leave the packer only when exactly full.  A task packs a bounded
buffer at a time, of which less than one longest window is left over; what is left when its input ends is cut to powers
of two.  So a task holds a buffer and one text, and no texts are shuffled.  Step groups are numbered over all tasks,
from the tasks' counts of windows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, small, table
from quillon.llm.tokens import encoder, public_path

END_ID = 1
TIERS = (256, 512, 1024, 2048)
NUMBERS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "task", "rank")

Piece = tuple[int, int, int]  # length, document, start


def pack_buffer(items: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows as (size, pieces), and the pieces left over, together shorter than the longest tier; with last nothing
    is left over.

    Pieces are at most as long as the longest tier.
    """
    tier_of = lambda n: next(t for t in tiers if t >= n)
    pools: dict[int, list[Piece]] = {t: [] for t in tiers}
    for x in sorted(items):
        pools[tier_of(x[0])].append(x)
    full: list[tuple[int, list[Piece]]] = []
    rest: list[Piece] = []
    for t in reversed(tiers):
        own, shorter = pools[t], sorted(x for s in tiers if s < t for x in pools[s])
        while own:
            window = [own.pop()]
            gap = t - window[0][0]
            while gap and (shorter or own):
                source = shorter or own
                at = bisect_right(source, (gap, 1 << 62, 0))
                if at:
                    n, doc, start = source.pop(at - 1)
                else:
                    n, doc, start = source.pop(0)
                    insort(own if tier_of(n - gap) == t else shorter, (n - gap, doc, start + gap))
                    n = gap
                window.append((n, doc, start))
                gap -= n
            if gap:  # nothing is left to fill it with
                rest = window
            else:
                full.append((t, window))
        for s in tiers:
            if s < t:
                pools[s] = [x for x in shorter if tier_of(x[0]) == s]
    if last:
        full += cut_to_powers(rest, tiers[-1])
        rest = []
    return full, rest


def cut_to_powers(pieces: list[Piece], longest: int) -> list[tuple[int, list[Piece]]]:
    """Lay the pieces end to end and cut them to windows of decreasing powers of two, none with padding."""
    total, out, queue = sum(x[0] for x in pieces), [], list(pieces)[::-1]
    while total:
        size = min(longest, 1 << (total.bit_length() - 1))
        gap, window = size, []
        while gap:
            n, doc, start = queue.pop()
            if n > gap:
                queue.append((n - gap, doc, start + gap))
                n = gap
            window.append((n, doc, start))
            gap -= n
        out.append((size, window))
        total -= size
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    buffer_tokens: int = 2_000_000,
    step_tokens: int = 64 * 2048,
) -> DataFrame:
    """Pack every id of every text into exactly one piece; one row per piece.

    Null texts are empty: one end id.  Ids of any type are returned as they are; rows with equal or null ids are packed
    as documents of their own.  An empty table gives no rows.  Other columns are ignored.  A tier and a step_group name a
    group of windows with step_tokens ids together (a tier's last group may have fewer), so that every training step of
    a tier has the same amount of work.
    """
    longest = tiers[-1]
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are increasing powers of two")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, end, task = encoder(tokenizer), np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId()
        ids: dict[int, tuple[object, bytes]] = {}
        items: list[Piece] = []
        made: dict[int, int] = {}
        kind, met, held = None, 0, 0

        def emit(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            names, rows = [], []
            for size, pieces in windows:
                rank, offset = made.get(size, 0), 0
                for n, doc, start in pieces:
                    name, raw = ids[doc]
                    names.append(name)
                    rows.append((start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(raw) // 4, (task << 40) + sum(made.values()), offset, size, task, rank))
                    offset += n
                made[size] = rank + 1
            numbers = np.array(rows, np.int64).reshape(-1, len(NUMBERS))
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(names, kind)} | {c: numbers[:, k] for k, c in enumerate(NUMBERS)})

        for b in batches:
            kind = b["doc_id"].type
            for name, text in zip(b["doc_id"].to_pylist(), b["text"]):
                raw = e.encode(text.as_py() or "") + end
                ids[met] = (name, raw)
                n = len(raw) // 4
                items += [(longest, met, s) for s in range(0, n - longest + 1, longest)]
                if n % longest:
                    items.append((n % longest, met, n - n % longest))
                met += 1
                held += n
                if held >= buffer_tokens:
                    windows, items = pack_buffer(items, tiers, False)
                    yield emit(windows)
                    ids = {d: ids[d] for d in {x[1] for x in items}}
                    held = sum(x[0] for x in items)
        if items:
            yield emit(pack_buffer(items, tiers, True)[0])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(texts.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in NUMBERS)), "pieces")
    counts = pieces.where("offset = 0").groupBy("tier", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = small(counts.select("tier", "task", F.coalesce(before, F.lit(0)).alias("base")))
    group = F.floor((F.col("base") + F.col("rank")) * F.col("tier") / step_tokens).cast("long")
    return pieces.join(bases, ["tier", "task"]).select(
        F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("tier").cast("int").alias("tier"), group.alias("step_group")
    )


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's pieces in sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
