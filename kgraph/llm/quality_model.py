"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded from hashed byte trigrams and a few measures of its make-up by a
small layer; gated attention, learned from document labels alone, weighs the passages; the weighted passage
representation gives the score.  The model is fitted with numpy on a bounded sample of labelled documents and then scores
every document where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes in a passage, and buckets of its trigrams.
PASSAGE, BUCKETS = 512, 256
MEASURES = 6
WIDTH = BUCKETS + MEASURES
SLICE = 1 << 20


@dataclass(frozen=True)
class MilParams:
    #: The model is fitted on at most so many labelled documents, those with the smallest hash of doc_id,
    max_labelled: int = 6000
    #: of at most so many bytes each,
    max_bytes: int = 1 << 17
    #: and so many passages together, which bounds what the driver gets: 262 bytes a passage, four times that as floats.
    max_passages: int = 150_000
    hidden: int = 32
    gate: int = 16
    epochs: int = 24
    batch: int = 128
    rate: float = 4e-3
    decay: float = 1e-4
    #: predicted is 1 from this score on.
    threshold: float = 0.7
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


# ---- encoding --------------------------------------------------------------------------------------------------------


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all passages, and how many of them each text has (at least one).  Texts are taken whole, by slices."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], dtype=np.int64)
    rows = np.zeros((int(counts.sum()), WIDTH), dtype=np.float32)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    run: list[tuple[int, int, bytes]] = []  # (text, first passage's row, bytes)
    size = 0
    grams: list[np.ndarray] = []

    def flush() -> None:
        nonlocal run, size
        if run:
            _fill(rows, run, grams)
        run, size = [], 0

    for k, t in enumerate(texts):
        for at in range(0, len(t), SLICE):
            part = t[at : at + SLICE]
            run.append((k, int(begins[k]) + at // PASSAGE, part))
            size += len(part)
            if size >= SLICE:
                flush()
    flush()
    # how much of a text repeats: of its sampled 8-byte strings, those that are not new
    if grams:
        keys = np.concatenate(grams)
        whole = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=len(texts))
        new = np.bincount((np.unique(keys) >> np.uint64(40)).astype(np.int64), minlength=len(texts))
        repeats = 1 - (new + 1) / (whole + 1)
        rows[:, BUCKETS] = np.repeat(repeats, counts)
    rows[:, BUCKETS + 1] = np.repeat(np.log1p(np.array([len(t) for t in texts])) / 12, counts)
    return rows, counts


def _fill(rows: np.ndarray, run: list[tuple[int, int, bytes]], grams: list[np.ndarray]) -> None:
    data = np.frombuffer(b"".join(p + b"\0\0\0\0\0\0\0\0" for _, _, p in run), dtype=np.uint8)
    at = 0
    starts, passages, text_of, valid = [], [], [], np.zeros(len(data), dtype=bool)
    for k, row, part in run:
        n = len(part)
        valid[at : at + n] = True
        first = np.arange(0, n, PASSAGE)
        starts.append(first + at)
        passages.append(row + np.arange(len(first)))
        text_of.append(np.full(n + 8, k))
        at += n + 8
    edge = np.concatenate(starts)
    target = np.concatenate(passages)
    number = np.zeros(len(data), dtype=np.int32)
    number[edge[1:]] = 1
    number = np.cumsum(number, dtype=np.int32)
    n = len(edge)
    wide = data.astype(np.uint32)
    mixed = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
    mixed = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(24)
    cell = number[:-2] * BUCKETS + mixed.astype(np.int32)
    ok = valid[:-2]
    table = np.bincount(cell[ok], minlength=n * BUCKETS).reshape(n, BUCKETS)
    size = np.maximum(1, np.bincount(number[valid], minlength=n))
    rows[target, :BUCKETS] = np.sqrt(table / size[:, None])
    kinds = (
        (data >= 65) & (data <= 90),
        (data >= 48) & (data <= 57),
        (data > 32) & (data < 127) & ~((data | 32 >= 97) & (data | 32 <= 122)) & ~((data >= 48) & (data <= 57)),
        (data == 32) | ((data >= 9) & (data <= 13)),
    )
    for j, kind in enumerate(kinds):
        rows[target, BUCKETS + 2 + j] = np.bincount(number[kind & valid], minlength=n) / size
    # 8-byte strings, sampled by their own hash so that equal ones are sampled alike
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[:, ::-1].copy().view(np.uint64)[:, 0]
    inside = valid[: len(eight)] & valid[7 : 7 + len(eight)]
    h = eight * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    pick = inside & (h >> np.uint64(60) == 0)
    owner = np.concatenate(text_of)[: len(eight)][pick].astype(np.uint64)
    grams.append((owner << np.uint64(40)) | ((h[pick] >> np.uint64(16)) & np.uint64((1 << 40) - 1)))


# ---- model -----------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMil:
    """score = sigmoid(out . sum_i a_i h_i), h_i = tanh(W x_i), a = softmax(w . (tanh(V h_i) * sigmoid(U h_i)))."""

    def __init__(self, params: MilParams):
        rng = np.random.default_rng(params.seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean = np.zeros(WIDTH, np.float32)
        self.scale = np.ones(WIDTH, np.float32)
        self.w = {
            "W": draw(WIDTH, params.hidden),
            "b": np.zeros(params.hidden, np.float32),
            "V": draw(params.hidden, params.gate),
            "U": draw(params.hidden, params.gate),
            "w": draw(params.gate, 1)[:, 0],
            "c": draw(params.hidden, 1)[:, 0],
            "d": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        a = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"]), "first": first}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        w, f = self.w, self.forward(x, counts)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        dl = (f["p"] - y) / len(y)
        dz = np.repeat(dl[:, None] * w["c"], counts, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, f["first"]), counts))
        dt, ds = de[:, None] * w["w"] * s * (1 - t * t), de[:, None] * w["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        return {
            "W": f["x"].T @ dh,
            "b": dh.sum(axis=0),
            "V": h.T @ dt,
            "U": h.T @ ds,
            "w": (t * s).T @ de,
            "c": f["z"].T @ dl,
            "d": dl.sum(keepdims=True),
        }

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One score per text; texts are taken in runs of about a slice, so that memory is bounded by the longest."""
        out, run, size = [], [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size >= SLICE or len(run) >= 2000:
                out.append(self.forward(*bags(run))["p"])
                run, size = [], 0
        if run:
            out.append(self.forward(*bags(run))["p"])
        return np.concatenate(out).astype(np.float64) if out else np.empty(0)


class Constant:
    """Where labels know one class or none: the share of ones, smoothed."""

    def __init__(self, y: np.ndarray):
        self.p = float((y.sum() + 1) / (len(y) + 2))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.p)


def fit(rows: np.ndarray, counts: np.ndarray, y: np.ndarray, params: MilParams = MilParams()) -> AttentionMil | Constant:
    """Adam on the mean log loss of documents, in an order that the seed draws."""
    if len(y) == 0 or y.min() == y.max():
        return Constant(y)
    model = AttentionMil(params)
    model.mean = rows.mean(axis=0)
    model.scale = rows.std(axis=0) + np.float32(1e-3)
    rng = np.random.default_rng(params.seed)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    n_steps = params.epochs * -(-len(y) // params.batch)
    for _ in range(params.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), params.batch):
            pick = order[at : at + params.batch]
            where = np.concatenate([np.arange(begins[k], begins[k] + counts[k]) for k in pick])
            step += 1
            rate = params.rate * (1 - (step - 1) / n_steps)
            for k, g in model.gradients(rows[where], counts[pick], y[pick].astype(np.float32)).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model.w[k] -= (rate * (move + params.decay * model.w[k])).astype(np.float32)
    return model


# ---- tables ----------------------------------------------------------------------------------------------------------


def _bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def chosen_rows(docs: DataFrame, labels: DataFrame, params: MilParams = MilParams()) -> list[tuple[int, int, int]]:
    """(doc_id, digest of its text, label) of the rows that the model is fitted on: in order of the hash of doc_id, as many as
    the bounds allow.  Of several labels or texts of a doc_id the smallest counts; null and held-out ones never do."""
    named = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min("quality").alias("y"))
    )
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.octet_length(text).alias("bytes"))
    one = sized.where(F.col("bytes") <= params.max_bytes).groupBy("doc_id").agg(F.min(F.struct("digest", "bytes")).alias("d"))
    found = one.join(named, F.col("doc_id") == F.col("label_id")).orderBy(F.xxhash64("label_id"), "label_id").limit(params.max_labelled)
    rows = found.select("doc_id", "d.digest", "d.bytes", "y").collect()
    size = np.cumsum([max(1, -(-r["bytes"] // PASSAGE)) for r in rows])
    return [(r["doc_id"], r["digest"], int(r["y"] > 0)) for r, n in zip(rows, size) if n <= params.max_passages]


def train(docs: DataFrame, labels: DataFrame, params: MilParams = MilParams()) -> AttentionMil | Constant:
    """docs: doc_id, text.  labels: doc_id, quality.  Passages of chosen_rows come to the driver, as eight-bit rows."""
    rows = chosen_rows(docs, labels, params)
    chosen = docs.sparkSession.createDataFrame(rows, "label_id long, label_digest long, y int")
    text = F.coalesce("text", F.lit("")).alias("text")
    same = (F.col("doc_id") == F.col("label_id")) & (F.xxhash64("text") == F.col("label_digest"))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(chosen), same).select("doc_id", "y", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            batch = batch[~batch["doc_id"].isin(seen)].drop_duplicates("doc_id")
            seen |= set(batch["doc_id"].tolist())
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                rows, counts = bags(_bytes(part["text"]))
                cells = np.split(np.clip(np.rint(rows * 255), 0, 255).astype(np.uint8), np.cumsum(counts)[:-1])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "y": part["y"].to_numpy(), "cells": [c.tobytes() for c in cells]})

    # rows that repeat leave each task once, and reach the driver once
    got = sample.mapInPandas(encode, "doc_id long, y int, cells binary").groupBy("doc_id", "y").agg(F.min("cells").alias("cells")).toPandas()
    got = got.sort_values(["doc_id"], ignore_index=True)
    cells = [np.frombuffer(c, np.uint8).reshape(-1, WIDTH) for c in got["cells"]]
    rows = np.concatenate(cells).astype(np.float32) / 255 if cells else np.empty((0, WIDTH), np.float32)
    counts = np.array([len(c) for c in cells], dtype=np.int64)
    return fit(rows, counts, got["y"].to_numpy().astype(np.float64), params)


def score(docs: DataFrame, model: AttentionMil | Constant, params: MilParams = MilParams()) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, held_out, score, predicted; a row per row.

    Whole texts are scored; null and empty ones are a bag with one empty passage.  A null doc_id is not held out.  Other
    columns are ignored.  Empty tables give an empty result.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.scores(_bytes(batch["text"]))})

    scored = docs.select("doc_id", "text").mapInPandas(work, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame, params: MilParams = MilParams()) -> DataFrame:
    """docs: doc_id, text.  labels: doc_id, quality.  Returns doc_id, held_out, score, predicted; a row per row of docs.

    The model is fitted on chosen_rows and scores every row, whole texts, null ones as empty.  Without labels of both classes
    every score is the share of ones, smoothed.  Rows that repeat keep their rows.  Other columns are ignored.  An empty
    table gives an empty result."""
    return score(docs, train(docs, labels, params), params)
