"""SimHash near-duplicates by anchor-point covering.

A fixed pseudo-random code of K 64-bit words serves as anchors.  The covering distance near(x) of a fingerprint is the
distance to its nearest anchor, which is its home.  x is replicated to every anchor within near(x) plus the threshold t.
Of two fingerprints at most t apart, take the one with the smaller near: its home lies within near + t of the other, so
the two meet there, and no link is lost.  K grows with the square root of the number of fingerprints, which balances the
search for anchors against the comparisons.

Equal fingerprints are one node.  Per anchor, residents (those at home) are held against all members, in blocks; what
leaves an anchor is links of a spanning forest of what met there, at most one per member and block, and never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, slices
from .components import connected_components


@dataclass(frozen=True)
class SimHashParams:
    #: Words in a shingle.
    shingle: int = 3
    #: Fingerprints link at so many differing bits or fewer.
    threshold: int = 3
    seed: int = 42
    #: Members of an anchor that one task holds against each other; more are dealt out as pairs of blocks.
    block: int = 8192


def fingerprint(text: str | None, params: SimHashParams = SimHashParams()) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes; 0 for a text without words.

    Words are taken by slices of the text, with the last ones of the slice before, so that a long text needs no more memory
    than its bytes."""
    k, digest = params.shingle, xxhash.xxh64_intdigest
    total, n, words = np.zeros(64, dtype=np.int64), 0, []
    for part in slices((text or "").encode("utf-8", "surrogatepass").lower(), 1 << 18):
        words += part.split()
        if len(words) >= k:
            hashes = [digest(b" ".join(words[i : i + k]), params.seed) for i in range(len(words) - k + 1)]
            total += _bits(hashes)
            n += len(hashes)
            words = words[len(words) - k + 1 :]
    if n == 0:
        if not words:
            return 0
        total, n = _bits([digest(b" ".join(words), params.seed)]), 1
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    h = np.array(hashes, dtype="<u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), in the order of docs; a row per row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, params) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(work, "doc_id long, fp long")


def anchors(k: int) -> np.ndarray:
    """The code: k words from a fixed generator."""
    return np.random.default_rng(64).integers(0, 1 << 64, size=k, dtype=np.uint64)


def anchor_count(n: int) -> int:
    """A power of two about three times the square root of n."""
    return 1 << int(np.clip(round(np.log2(3 * max(1, n) ** 0.5)), 4, 20))


def _replicate(k: int, threshold: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = anchors(k)
        step = max(1, (1 << 19) // k)
        for batch in batches:
            every = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(every), step):
                fp = every[at : at + step]
                apart = np.bitwise_count(fp[:, None] ^ code[None, :])
                near = apart.min(axis=1)
                row, anchor = np.nonzero(apart <= (near + threshold)[:, None])
                home = anchor == apart.argmin(axis=1)[row]
                yield pd.DataFrame({"anchor": anchor.astype(np.int32), "fp": fp.view(np.int64)[row], "home": home})

    return work


def _forest(a: np.ndarray, b: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links a[i] - b[j] at most threshold apart, as a spanning forest over values."""
    values, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = number[: len(a)], number[len(a) :]
    parent = np.arange(len(values))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    out = []
    step = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), step):
        rows, cols = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= threshold)
        x, y = left[at + rows], right[cols]
        apart = parent[x] != parent[y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist()):
            if (ri := find(i)) != (rj := find(j)):
                parent[max(ri, rj)] = min(ri, rj)
                out.append((int(values[i]), int(values[j])))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return out


def _compare(threshold: int):
    """Rows come sorted by cell; a cell holds at most a block of residents and a block of members."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, homes, members = None, [], []

        def flush() -> pd.DataFrame:
            a = np.concatenate(homes) if homes else np.empty(0, np.uint64)
            b = np.concatenate(members) if members else np.empty(0, np.uint64)
            pairs = np.array(_forest(a, b, threshold) if len(a) and len(b) else [], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

        for batch in batches:
            cells = batch["cell"].to_numpy()
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            resident = batch["resident"].to_numpy(bool)
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if cells[lo] != key:
                    if key is not None:
                        yield flush()
                    key, homes, members = cells[lo], [], []
                mine = resident[lo:hi]
                homes.append(fp[lo:hi][mine])
                members.append(fp[lo:hi][~mine])
        if key is not None:
            yield flush()

    return work


def links(nodes: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """nodes: fp, distinct.  Returns u, v: enough links at most threshold apart to keep all that is connected connected."""
    n = nodes.count()
    k = anchor_count(n)
    placed = nodes.select("fp").mapInPandas(_replicate(k, params.threshold), "anchor int, fp long, home boolean")
    placed = materialize(placed, "anchors")
    # at most k rows: how many blocks each anchor's residents and members make
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("members"), F.sum(F.col("home").cast("long")).alias("homes"))
    blocks = sizes.where("homes > 0").select(
        "anchor",
        F.ceil(F.col("homes") / params.block).cast("int").alias("home_blocks"),
        F.ceil(F.col("members") / params.block).cast("int").alias("member_blocks"),
    )
    dealt = placed.join(F.broadcast(blocks), "anchor")
    block = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    several = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda h, m: F.concat_ws("-", "anchor", h, m).alias("cell")
    homes = dealt.where("home").select("fp", F.lit(True).alias("resident"), block("home_blocks").alias("h"), "anchor", F.explode(several("member_blocks")).alias("m"))
    members = dealt.select("fp", F.lit(False).alias("resident"), block("member_blocks").alias("m"), "anchor", F.explode(several("home_blocks")).alias("h"))
    rows = homes.select(cell("h", "m"), "fp", "resident").unionByName(members.select(cell("h", "m"), "fp", "resident"))
    spread = rows.repartition(partitions(nodes.sparkSession), "cell").sortWithinPartitions("cell")
    return spread.mapInPandas(_compare(params.threshold), "u long, v long")


def simhash_groups(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, fingerprint (16 hex digits), component_id; a row per row.

    component_id is the smallest doc_id that is reachable over links.  Null and empty texts have fingerprint zero and are
    linked like any other.  A null doc_id never becomes a component_id unless its component has no other.  Rows that
    repeat keep their rows.  Empty tables give an empty result.  Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, params), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = materialize(nodes, "nodes")
    parts = connected_components(links(nodes, params))
    named = nodes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(ids, "component").select(F.col("fp").alias("of_fp"), "component_id")
    return fps.join(of, F.col("fp") == F.col("of_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
