"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them and no others.

A node is a distinct set of shingle hashes.  Links of operator 1 are tried first: those that the sets confirm join what is
cheap to join.  The rest is a prefix-filtered set join that loses nothing: shingles have one global order, rare ones first
(by counts in hashed buckets; any order is right); two sets of 0.8 or more share one of the first n - ceil(0.8 n) + 1
shingles of each.  Pairs that meet there, in different components so far, are
held against each other: by sketches that bound what they share, then in full.  That is done twice.  The first time a set
is paired only with a few of each shingle, those that have the shingle first in their order: copies with few changes of
their own, which most others are like.  So nearly all that belongs together is joined by pairs in proportion to the sets; the
second time all pairs are taken that are still in different components.

Sets are not stored, as they take more room than the texts: whoever needs one computes it anew, and only sets of documents
in a pair that is tried are written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, materialize, partitions, release, slices, smaller_batches
from .components import connected_components
from .simhash import SimHashParams, fingerprint, links
from .suffix_dedup import inverse_powers, mixed, prefix_hashes

#: Words in a shingle, and the least similarity as LEAST[0] / LEAST[1].
SHINGLE, LEAST = 5, (4, 5)
#: Buckets in which shingles are counted for their order: an eighth of all shingles, within these powers of two, so that a
#: shingle that many sets have stands out from what shares its bucket.  A byte a bucket reaches every task.
LEAST_BUCKETS, MOST_BUCKETS = 17, 22
#: Buckets that are summed together.
BLOCK = 1 << 16
#: Ranges of hashes in which a sketch counts a set's shingles.
RANGES = 128
#: Sets of a shingle that all others are paired with at first.
HUBS = 8
#: Sets of a shingle from which on those outside its largest component are held against the others one by one.
MANY = 32
#: Factors of a shingle's words.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))



def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and begin of each word, A-Z lower-cased."""
    a = np.frombuffer(data.lower(), np.uint8)
    edge = np.diff(BLANK[a].astype(np.int8), prepend=1, append=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = prefix_hashes(a)
    return mixed((sums[end] - sums[begin]) * inverse_powers(len(a))[begin]), begin


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles; a text of fewer words is one shingle, one without words none."""
    n = len(words)
    if n < SHINGLE:
        return mixed((words * FACTORS[:n]).sum(keepdims=True) + np.uint64(n)) if n else words
    return mixed(sum(words[j : n - SHINGLE + 1 + j] * FACTORS[j] for j in range(SHINGLE)))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's distinct shingles, sorted."""
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    out: list[np.ndarray] = []
    run: list[bytes] = []

    def flush() -> None:
        if run:
            words, begin = _word_hashes(b" ".join(run))
            cuts = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in run])[:-1])
            out.extend(np.unique(_shingles(w).view(np.int64)) for w in np.split(words, cuts))
            run.clear()

    size = 0
    for t in raw:
        if len(t) > SLICE:
            flush()
            out.append(np.unique(_shingles(np.concatenate([_word_hashes(p)[0] for p in slices(t)])).view(np.int64)))
            continue
        run.append(t)
        size += len(t)
        if size > SLICE:
            flush()
            size = 0
    flush()
    return out


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _batches(texts, most: int = 2000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about four slices."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) if isinstance(t, str) else 0
        if size > 4 * SLICE or k + 1 - at >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _nodes(params: SimHashParams):
    """Rows of doc_id, digest, text to NODES."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            found = [(node_of(s), len(s)) for lo, hi in _batches(texts) for s in shingle_sets(texts[lo:hi])]
            node, size = np.array(found, np.int64).reshape(-1, 2).T
            fps = np.array([fingerprint(t, params) for t in texts], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"], "fp": fps, "node": node, "size": size.astype(np.int32)})

    return work


NODES = "doc_id long, digest long, fp long, node long, size int"


def _ranks(docs: DataFrame, shingles: int) -> np.ndarray:
    """For each bucket, a byte that grows with the logarithm of its count: an order is enough, and any is right."""
    bits = int(np.clip(np.ceil(np.log2(max(1, shingles) / 8)), LEAST_BUCKETS, MOST_BUCKETS))
    buckets = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.uint32)
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in _batches(texts):
                at, n = np.unique(np.concatenate(shingle_sets(texts[lo:hi])) & (buckets - 1), return_counts=True)
                total[at] += n.astype(np.uint32)
        squeeze = zstandard.ZstdCompressor(level=1)
        for k in range(0, buckets, BLOCK):
            yield pd.DataFrame({"block": [k // BLOCK], "counts": [squeeze.compress(total[k : k + BLOCK].tobytes())]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor()
        last, total = None, None

        def row() -> pd.DataFrame:
            return pd.DataFrame({"block": [last], "counts": [np.round(7 * np.log2(1 + total)).clip(0, 255).astype(np.uint8).tobytes()]})

        for batch in batches:
            for block, counts in zip(batch["block"], batch["counts"]):
                if block != last:
                    if last is not None:
                        yield row()
                    last, total = block, np.zeros(min(BLOCK, buckets), np.uint64)
                total += np.frombuffer(expand.decompress(counts), np.uint32)
        if last is not None:
            yield row()

    schema = "block int, counts binary"
    parts = docs.select("text").mapInPandas(count, schema).repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block")
    ranks = np.zeros(buckets, np.uint8)
    for r in parts.mapInPandas(add, schema).collect():  # a byte a bucket
        ranks[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint8)
    return ranks


def _prefixes(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """shingle, node, size, place: the first shingles of each set in the global order, that of rank by bucket.  Copies leave a
    task once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in _batches(texts):
                out = []
                for s in shingle_sets(texts[lo:hi]):
                    n = len(s)
                    if not n or (node := node_of(s)) in seen:
                        continue
                    seen.add(node)
                    first = n - (LEAST[0] * n + LEAST[1] - 1) // LEAST[1] + 1
                    # s is sorted, so a stable sort breaks ties by hash
                    head = s[np.argsort(rank[s & (len(rank) - 1)], kind="stable")[:first]]
                    out.append((head, np.full(first, node, np.int64), np.full(first, n, np.int32), np.arange(first, dtype=np.int32)))
                if out:
                    yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("shingle", "node", "size", "place"), zip(*out))})

    return docs.select("text").mapInPandas(work, "shingle long, node long, size int, place int")


def _hubs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shingle and what is left after it, longest first.  Pairs of a shingle's first rows with the others, in
    different components."""
    top, bottom = LEAST
    held: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        shingle, node, part = (batch[c].to_numpy(np.int64) for c in ("shingle", "node", "component"))
        size, left = batch["size"].to_numpy(np.int64), (batch["size"] - batch["place"]).to_numpy(np.int64)
        head = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        first = np.repeat(head, np.diff(np.append(head, len(batch))))
        rows = np.arange(len(batch))
        out = []
        for k in range(HUBS):
            hub = first + k
            row = np.flatnonzero(rows > hub)
            hub = hub[row]
            small, big = np.minimum(size[row], size[hub]), np.maximum(size[row], size[hub])
            least = np.minimum(left[row], left[hub]) * (top + bottom) >= top * (small + big)
            take = (bottom * small >= top * big) & least & (part[row] != part[hub])
            out.append(np.stack([node[row[take]], node[hub[take]]], axis=1))
        pairs = np.concatenate(out)
        yield pd.DataFrame(np.stack([pairs.min(axis=1), pairs.max(axis=1)], axis=1), columns=["u", "v"]).drop_duplicates()
        # the last shingle may go on in the next batch: its hubs are taken along
        held = batch.iloc[head[-1] : head[-1] + HUBS]


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shingle and size.  Pairs of one shingle that sizes and places allow to be alike, in different
    components."""
    top, bottom = LEAST

    def frame(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()

    def pairs(cells: pd.DataFrame) -> Iterator[pd.DataFrame]:
        shingle, node, part = (cells[c].to_numpy(np.int64) for c in ("shingle", "node", "component"))
        size, left = cells["size"].to_numpy(np.int64), (cells["size"] - cells["place"]).to_numpy(np.int64)

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """a, b: rows of one shingle, the shorter set first."""
            least = np.minimum(left[a], left[b]) * (top + bottom) >= top * (size[a] + size[b])
            return (bottom * size[a] >= top * size[b]) & least & (part[a] != part[b])

        head = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        number = np.diff(np.append(head, len(cells)))
        # few: pair each row with the one `gap` rows on
        alone = np.flatnonzero(np.repeat(number <= MANY, number))
        for gap in range(1, MANY):
            alone = alone[alone + gap < len(cells)]
            alone = alone[shingle[alone] == shingle[alone + gap]]
            if not len(alone):
                break
            take = alone[alike(alone, alone + gap)]
            if len(take):
                yield frame(node[take], node[take + gap])
        for lo, n in zip(head[number > MANY].tolist(), number[number > MANY].tolist()):
            rows = np.arange(lo, lo + n)
            values, counts = np.unique(part[rows], return_counts=True)
            if len(values) == 1:
                continue
            most = values[counts.argmax()]
            out, size_out = [], 0
            for row in rows[part[rows] != most].tolist():
                # with the rest, and with others of the few only once
                other = rows[(part[rows] == most) | (rows > row)]
                a, b = np.minimum(other, row), np.maximum(other, row)
                take = alike(a, b)
                out.append((node[a[take]], node[b[take]]))
                size_out += int(take.sum())
                if size_out > 1 << 18:
                    yield frame(*map(np.concatenate, zip(*out)))
                    out, size_out = [], 0
            if out:
                yield frame(*map(np.concatenate, zip(*out)))

    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        newest = batch["shingle"].iloc[-1]
        ends = batch["shingle"].to_numpy() == newest
        if held and held[0]["shingle"].iloc[0] == newest:
            held.append(batch)
            continue
        # the last shingle may go on in the next batch
        yield from pairs(pd.concat([*held, batch[~ends]], ignore_index=True).drop_duplicates(["shingle", "node"]))
        held = [batch[ends]]
    if held:
        yield from pairs(pd.concat(held, ignore_index=True).drop_duplicates(["shingle", "node"]))


def _met(docs: DataFrame, rank: np.ndarray, parts: DataFrame, every: bool) -> DataFrame:
    """Pairs u, v that may be alike, in different parts (node, component): every one, or with hubs only."""
    cells = _prefixes(docs, rank).join(parts, "node", "left").select("shingle", "node", "size", "place", F.coalesce("component", "node").alias("component"))
    spread = cells.repartition(partitions(docs.sparkSession), "shingle")
    if every:
        return spread.sortWithinPartitions("shingle", "size", "node").mapInPandas(_meet, "u long, v long")
    return spread.sortWithinPartitions("shingle", F.col("place") - F.col("size"), "node").mapInPandas(_hubs, "u long, v long")


def _bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose sketches allow them to be alike: sets share at most the lesser count of each range."""
    for batch in batches:
        if not len(batch):
            continue
        u, v = (np.frombuffer(b"".join(batch[k]), "<i4").reshape(len(batch), RANGES) for k in ("u_sketch", "v_sketch"))
        both, size = np.minimum(u, v).sum(axis=1, dtype=np.int64), u.sum(axis=1, dtype=np.int64) + v.sum(axis=1, dtype=np.int64)
        yield batch.loc[both * sum(LEAST) >= LEAST[0] * size, ["u", "v"]]


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of text to node, sketch (counts of hashes by range), set."""
    for batch in batches:
        texts = batch["text"].tolist()
        for lo, hi in _batches(texts):
            sets = shingle_sets(texts[lo:hi])
            sketches = [np.bincount(s & (RANGES - 1), minlength=RANGES).astype("<i4").tobytes() for s in sets]
            yield pd.DataFrame({"node": [node_of(s) for s in sets], "sketch": sketches, "set": sets})


def _confirmed(pairs: DataFrame, docs: DataFrame, owners: DataFrame) -> DataFrame:
    """The pairs u, v whose sets are alike enough.  owners: node, digest, one text of each node."""
    pairs = materialize(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    # written first, so that Spark knows its size
    digests = materialize(owners.join(ends, "node", "left_semi").select("digest"), "digests")
    asked = docs.join(digests, "digest", "left_semi")
    # copies of a text give the same set again
    sets = asked.select("text").mapInPandas(_sets, "node long, sketch binary, set array<long>").dropDuplicates(["node"])
    sets = materialize(sets, "sets")

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        # sets may be long: they are never broadcast
        side = lambda k: sets.select(F.col("node").alias(k), F.col(column).alias(f"{k}_{column}")).hint("merge")
        return pairs.join(side("u"), "u").join(side("v"), "v")

    tried, pairs = pairs, materialize(with_both(pairs, "sketch").mapInPandas(_bounded, "u long, v long"), "candidates")
    release(tried)
    both = F.size(F.array_intersect("u_set", "v_set"))
    alike = both * sum(LEAST) >= LEAST[0] * (F.size("u_set") + F.size("v_set"))
    found = materialize(with_both(pairs, "set").where(alike).select("u", "v"), "alike")
    release(sets)
    release(pairs)
    return found


def near_copy_groups(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, digest (XXH64 of the text, null as empty), component (one value for all that are
    reachable over pairs of similarity 0.8 or more); a row per row.  params: how operator 1 finds the links that are tried first.

    Null and empty texts are one group, as are all texts without words.  Other columns are ignored.  An empty table gives
    an empty result."""
    smaller_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    nodes = materialize(docs.mapInPandas(_nodes(params), NODES), "nodes")
    owners = nodes.groupBy("node").agg(F.min("digest").alias("digest"))
    leads = nodes.groupBy("fp").agg(F.min("node").alias("lead"))
    lead = lambda k: leads.select(F.col("fp").alias(k), F.col("lead").alias(f"{k}_lead"))
    linked = links(nodes.select("fp").distinct(), params).join(lead("u"), "u").join(lead("v"), "v").select(F.col("u_lead").alias("u"), F.col("v_lead").alias("v"))
    same = nodes.select("fp", "node").distinct().join(leads, "fp").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    first = _confirmed(linked.unionByName(same), docs, owners)
    rank = _ranks(docs, nodes.agg(F.sum("size")).first()[0] or 0)
    alike = first
    parts = connected_components(alike)
    for every in (False, True):
        alike = alike.unionByName(_confirmed(_met(docs, rank, parts, every), docs, owners))
        parts = connected_components(alike)
    return nodes.join(parts, "node", "left").select("doc_id", "digest", F.coalesce("component", "node").alias("component"))


def keep_first_copy(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id (null last, ties by a digest of the text), with
    the columns of docs, whatever they are called.  Of rows that repeat in doc_id and text one stays."""
    rows = near_copy_groups(docs, params).groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("best"))
    keys = materialize(best.select(F.col("best.doc_id").alias("kept_id"), F.col("best.digest").alias("kept_digest"), F.col("best.n").alias("kept_n")), "kept")
    carried = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("row_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_digest"),
    )
    same = (F.col("row_digest") == F.col("kept_digest")) & F.col("row_id").eqNullSafe(F.col("kept_id"))
    kept = carried.join(keys.where("kept_n = 1"), same, "left_semi").select("row.*")
    repeated = keys.where("kept_n > 1")
    if repeated.isEmpty():
        return kept
    one = carried.join(repeated, same, "left_semi").groupBy("row_id", "row_digest").agg(F.first("row").alias("row"))
    return kept.unionByName(one.select("row.*"))
