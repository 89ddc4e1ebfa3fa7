"""Packing documents into fixed windows by minimum bin slack.

Documents are tokenised and cut into full windows and a rest.  Pieces are packed in groups of a few thousand, chosen by
the hash of the piece and of how often its task has met it, so that no task sees more than its group, whatever repeats.
Within a group only the counts of pieces of each length matter: the longest rest opens a window, a bitset subset-sum pass over the lengths left finds the multiset that
comes closest to the window's capacity, and backtracking gives how often each length is used.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, default_vocabulary

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Tells rows that repeat apart: a number that their map task gives them.
COPY = ", copy long"


@dataclass(frozen=True)
class PackParams:
    window: int = 2048
    #: Id that ends each document.
    end_id: int = 1
    #: Documents packed together, about.
    group_docs: int = 5000
    #: Path of the tokenizer's vocabulary; None: the public 50k byte-level one.
    vocabulary: str | None = None


def fill(capacity: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """The multiset of lengths, each at most counts times, whose sum comes closest to capacity from below.

    lengths falls strictly.  Bit s of ``reach`` says that some multiset sums to s.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    full = 1 << capacity
    for length in lengths:
        if length > capacity:
            continue
        for _ in range(min(counts[length], capacity // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach & full:
            break
    left, used = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            used.append(length)
            left -= length
    return used


def minimum_bin_slack(counts: dict[int, int], window: int) -> Iterator[tuple[list[int], int]]:
    """Windows as (lengths, how many windows are filled like that); together they use each length counts times."""
    counts = {k: v for k, v in counts.items() if v}
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        pattern = [longest, *fill(window - longest, lengths, counts)]
        counts[longest] += 1
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
        if any(not counts[x] for x in need):
            lengths = [x for x in lengths if counts[x]]
        yield pattern, times


def _pieces(params: PackParams):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(params.vocabulary or default_vocabulary())
        # rows that repeat are alike, so it does not matter which of them gets which number
        seen: dict[int, int] = {}
        task = TaskContext.get()
        place = (task.partitionId() if task else 0) << 40
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encoder.encode(text or ""), np.array([params.end_id], "<u4"))
                raw = ids.tobytes()
                view = memoryview(raw)
                n = len(ids)
                key = hash((None if pd.isna(doc_id) else int(doc_id), zlib.crc32(raw), n))
                seen[key] = copy = seen.get(key, -1) + 1
                for at in range(0, n, params.window):
                    length = min(params.window, n - at)
                    rows.append((doc_id, at, length, zlib.crc32(view[4 * at : 4 * (at + length)]), n, place + copy))
                if len(rows) >= 10_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return cut


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def pieces(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Each document's ids cut into full windows and a rest, with a number that tells rows that repeat apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_pieces(params), PIECE + COPY)


def _pack(params: PackParams):
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        order = ["length", "doc_id", "start", "ids_crc32"]
        group = group.sort_values(order, ascending=[False, True, True, True], kind="stable", ignore_index=True)
        length = group["length"].to_numpy()
        # rows of each length lie together: next[x] is the first that has no place yet
        values, first, number = np.unique(length, return_index=True, return_counts=True)
        following = dict(zip(values.tolist(), first.tolist()))
        sequence = np.empty(len(group), "int64")
        offset = np.empty(len(group), "int64")
        n = 0
        for pattern, times in minimum_bin_slack(dict(zip(values.tolist(), number.tolist())), params.window):
            for _ in range(times):
                at = 0
                for x in pattern:
                    row = following[x]
                    following[x] = row + 1
                    sequence[row], offset[row] = n, at
                    at += x
                n += 1
        group["sequence_id"] = (int(key[0]) << 32) + sequence
        group["offset"] = offset
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pack


def pack(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """docs: doc_id, text.  Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: one piece that holds the end id.  Rows that repeat are packed each, in several groups if
    they are many; so are rows without a doc_id.  Empty tables give an empty result.  Other columns are ignored.
    """
    groups = max(1, math.ceil(docs.count() / params.group_docs))
    cut = pieces(docs, params).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(groups)))
    return cut.groupBy("group").applyInPandas(_pack(params), PIECE + ", sequence_id long, offset long")
