"""Best-fit packing of documents into token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import map_batches, stage, text_blocks
from graphmill.llm.tokens import default_path, tokenizer

#: Pieces that one task packs; more pieces make more groups, never larger ones.
GROUP_PIECES = 32_768


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; bins are numbered from 0 in order of opening.

    An item goes where the sum over gaps g of (open bins with gap g) ** 2 becomes smallest;
    ties go to the smallest gap. A bin is opened only if the item fits in none, and items come
    longest first: with both, measured packings reach the bound ceil(tokens / capacity).
    """
    out = np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; those without a gap are closed
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    moved = (np.arange(capacity + 1) > 0).astype(np.int64)
    none, opened = np.iinfo(np.int64).max, 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        was = count[s:capacity]
        change = np.where(was > 0, 2 * (count[: capacity - s] - was) + moved[: capacity - s], none) if s < capacity else was
        j = int(change.argmin()) if len(change) else 0
        if len(change) and change[j] != none:
            b, gap = stacks[s + j].pop(), j
            count[s + j] -= 1
        else:
            b, gap, opened = opened, capacity - s, opened + 1
        out[i] = b
        if gap:
            stacks[gap].append(b)
            count[gap] += 1
    return out


def pieces(docs: DataFrame, capacity: int, tokenizer_path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, order: the token pieces of every document, without the ids."""

    def cut(b: pa.RecordBatch):
        for at, to, data, offsets in text_blocks(b.column(1)):
            ids, rows = tokenizer(tokenizer_path).block(data, offsets)
            out: list[tuple] = []
            for doc, a, z in zip(b.column(0)[at:to].to_pylist(), rows[:-1].tolist(), rows[1:].tolist()):
                raw = np.append(ids[a:z], np.uint32(0)).astype("<u4").tobytes()
                n = len(raw) // 4
                out += [(doc, p, start, min(capacity, n - start), zlib.crc32(raw[4 * start : 4 * (start + capacity)])) for p, start in enumerate(range(0, n, capacity))]
            yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), (pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())))))

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    docs: doc_id, text and any other columns. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset for each piece. A document is its ids followed by id 0; a null or empty
    text is that 0 alone; only longer documents are cut. Repeated rows are packed once each, a
    null doc_id is kept, and an empty table gives an empty result.

    Scale: texts never move; pieces (a few numbers each) are dealt at random into groups of about
    group_pieces, packed independently. What a group leaves open is at most a sequence or so, so
    the number of groups does not show in the fill.
    """
    cut = stage(pieces(docs, capacity, tokenizer_path or default_path()), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    schema = cut.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        group = int(pdf.pop("pack_group").iloc[0])
        pdf["sequence_id"] = sum_of_squares(pdf["length"].to_numpy(), capacity) + (group << 32)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf

    # By place in the written table: rows alike in all columns are dealt apart too, so no group grows with repeats.
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(place, schema)
