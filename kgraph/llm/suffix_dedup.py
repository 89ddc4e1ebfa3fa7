"""Removal of repeated substrings by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller doc_id, or
earlier in the same one.  To decide that for every position without moving every suffix, positions are dealt out by
content:

1.  Every ``length``-byte window has a minimizer: of the ``gram``-byte strings in it, the leftmost with the least hash.
    Equal windows have equal minimizers at equal offsets, so it is enough to compare windows that share one.  Windows of
    a document that share a minimizer position are consecutive; such a run, not each window, is the unit that is shuffled.
2.  Runs that are equal as a whole (hash of the minimizer and prefix polynomial hash of the run's bytes) need no look at
    single windows: all but the earliest run go.  Map tasks settle that for their own runs before anything is shuffled,
    so a passage that a third of all documents share leaves each map task once; they hold the texts, and verify the bytes.
    What is settled after the shuffle is verified by BLAKE2 digests of both sides' bytes, runs that follow one another
    taken together; a run that fails goes on to step 3, as every run of another kind does.
3.  Where one minimizer has runs that differ (the ends of repeated passages), the bytes of the earliest run of each kind
    are fetched, and their windows are sorted as suffixes: a merge sort whose comparisons find the common extension of
    two suffixes by binary search over prefix polynomial hashes.  Neighbours that agree over the whole length are
    verified byte by byte.  Of each class of equal windows, all but the earliest go.  Where a minimizer has very many
    runs, its windows are dealt out one by one, by what they begin and end with, and windows that a task has already are
    settled there, so that no task gets them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Window starts that are hashed together, and runs of a map task that are settled together.
CHUNK, RUNS = 1 << 18, 1 << 18
#: doc_id of null, before all others.
NO_ID = -(1 << 63)
#: Distinct windows of those that a task remembers at a time.
HELD_WINDOWS = 1 << 16
#: Ranges of one source text that are verified together.
REQUESTS = 4096


@dataclass(frozen=True)
class SuffixParams:
    #: At most 128, and at least gram + 8.
    length: int = 100
    #: Bytes of the strings that minimizers are chosen from.
    gram: int = 32
    #: Runs of one minimizer that are sorted together; the windows of more are dealt out one by one.
    hot_runs: int = 2048
    #: Bits of a run's hash; fewer make more runs fail verification, and never change the result.
    bits: int = 64


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i up to n, modulo 2^64."""
    size = 1 << max(19, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        one = np.ones(1, np.uint64)
        _POWERS[size] = tuple(np.cumprod(np.concatenate([one, np.full(size, b, np.uint64)])) for b in (BASE, INVERSE))
    return _POWERS[size]


def inverse_powers(n: int) -> np.ndarray:
    return _powers(n)[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """sums[i] = sum over j < i of (data[j] + 1) * BASE^j."""
    power, _ = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return sums


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


# ---- minimizer runs --------------------------------------------------------------------------------------------------


def _window_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in h[i : i + width], for every i where that fits."""
    at = np.arange(len(h), dtype=np.int32)
    low, span = h, 1

    def merge(low, at, shift):
        n = len(low) - shift
        right = low[shift:] < low[:n]
        return np.where(right, low[shift:], low[:n]), np.where(right, at[shift:], at[:n])

    while span * 2 <= width:
        low, at = merge(low, at, span)
        span *= 2
    if span < width:
        low, at = merge(low, at, width - span)
    return at


def minimizer_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, params: SuffixParams) -> tuple[np.ndarray, ...]:
    """data: texts one after the other, text k at [begin[k], end[k]).

    Returns arrays, one entry per run: text number, first window start, last window start, minimizer position, hash of
    the minimizer, hash of the run's bytes.
    """
    length, gram = params.length, params.gram
    width = length - gram + 1
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = prefix_hashes(data)
    power, back = _powers(len(data))
    n = len(data) - gram + 1
    h = mixed((sums[gram:] - sums[:-gram]) * back[:n])
    at = _window_minimum(h, width)
    starts = len(data) - length + 1
    valid = np.zeros(starts + 1, np.int8)
    fits = end - begin >= length
    np.add.at(valid, begin[fits], 1)
    np.add.at(valid, end[fits] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    fresh = np.ones(starts, bool)
    fresh[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    fresh[begin[fits]] = True
    first = np.flatnonzero(fresh & valid)
    last_of = np.ones(starts, bool)
    last_of[:-1] = fresh[1:] | ~valid[1:]
    last = np.flatnonzero(last_of & valid)
    p = at[first].astype(np.int64)
    text = np.searchsorted(begin, first, side="right") - 1
    whole = (sums[last + length] - sums[first]) * back[first]
    shape = (p - first).astype(np.uint64) * np.uint64(256) + (last - p + length).astype(np.uint64)
    run = mixed(whole) ^ (mixed(shape + np.uint64(1)) >> np.uint64(7))
    return text, first, last, p, h[p], run >> np.uint64(64 - params.bits)


def _pack(tag: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """tag (15 bits), position (33), bytes of the run before it (7) and from it on (8), so that order is by tag, position."""
    return (tag << 48) | (at << 15) | (before << 8) | after


def _unpack(v: np.ndarray) -> tuple[np.ndarray, ...]:
    return v >> 48, (v >> 15) & ((1 << 33) - 1), (v >> 8) & 127, v & 255


RUN = "span boolean, h long, d long, doc long, place long"


def _same_bytes(data: bytes, at: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Is data[at : at + size] the same as data[of : of + size]?  Ranges that go on alike are compared as one."""
    out = np.ones(len(at), bool)
    order = np.lexsort((at, at - of))
    at, size, of = at[order], size[order], of[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] - of[1:] != at[:-1] - of[:-1]) | (at[1:] > at[:-1] + size[:-1])
    heads = np.flatnonzero(fresh)
    view = memoryview(data)
    for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(at)]):
        first, last = int(at[lo]), int((at[lo:hi] + size[lo:hi]).max())
        if view[first:last] != view[int(of[lo]) : int(of[lo]) + last - first]:
            for k in range(lo, hi):
                x, y, n = int(at[k]), int(of[k]), int(size[k])
                out[order[k]] = view[x : x + n] == view[y : y + n]
    return out


def _runs(params: SuffixParams):
    """Rows of runs, and of spans that go already, those of runs that this task has seen earlier (d: start, place: tag and
    end, h: anything that spreads them)."""

    def settle(runs: list[tuple[np.ndarray, ...]], data: bytes) -> Iterator[pd.DataFrame]:
        doc, tag, first, last, p, h, d, at = (np.concatenate(x) for x in zip(*runs))
        place = _pack(tag, p, p - first, last - p + params.length)
        order = np.lexsort((place, doc, d, h))
        doc, tag, first, last, h, d, place, at = (x[order] for x in (doc, tag, first, last, h, d, place, at))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
        rows = np.flatnonzero(again)
        again[rows] = _same_bytes(data, at[rows], (last - first + params.length)[rows], at[head[rows]])
        keep = ~again
        yield pd.DataFrame({"span": False, "h": h[keep].view(np.int64), "d": d[keep].view(np.int64), "doc": doc[keep], "place": place[keep]})
        gone = again & ((doc != doc[head]) | (place != place[head]))
        spans = _merged(doc[gone], tag[gone], first[gone], last[gone] + params.length)
        route = mixed((spans[0] + spans[2]).view(np.uint64)).view(np.int64)
        yield pd.DataFrame({"span": True, "h": route, "d": spans[2], "doc": spans[0], "place": (spans[1] << 48) | spans[3]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        n = size = 0
        for batch in batches:
            for doc, tag, offset, data, begin, end in _chunks(zip(batch["doc"], batch["text"]), params):
                text, first, last, p, h, d = minimizer_runs(data, begin, end, params)
                if len(text) == 0:
                    continue
                shift = offset[text] - begin[text]
                runs.append((doc[text], tag[text], first + shift, last + shift, p + shift, h, d, first + size))
                texts.append(data.tobytes())
                n, size = n + len(text), size + len(data)
                if n >= RUNS:
                    yield from settle(runs, b"".join(texts))
                    runs, texts, n, size = [], [], 0, 0
        if runs:
            yield from settle(runs, b"".join(texts))

    return work


def tag_of(text: bytes) -> int:
    """15 bits that tell texts under one doc_id apart."""
    return int.from_bytes(hashlib.sha256(text).digest()[:2], "big") >> 1


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _chunks(texts, params: SuffixParams):
    """Groups of texts, or of overlapping slices of long ones, of about a chunk: doc, tag, offset, data, begin, end."""

    def group(parts):
        sizes = np.array([len(x[3]) for x in parts], np.int64)
        end = np.cumsum(sizes)
        data = np.frombuffer(b"".join(x[3] for x in parts), np.uint8)
        return (*(np.array([x[j] for x in parts], np.int64) for j in range(3)), data, end - sizes, end)

    parts, size = [], 0
    for doc, text in texts:
        raw = _bytes(text)
        if len(raw) < params.length:
            continue
        tag = tag_of(raw)
        for at in range(0, len(raw) - params.length + 1, CHUNK):
            part = raw[at : at + CHUNK + params.length - 1]
            parts.append((doc, tag, at, part))
            size += len(part)
            if size >= CHUNK:
                yield group(parts)
                parts, size = [], 0
    if parts:
        yield group(parts)


def _merged(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each document with those that touch made one."""
    order = np.lexsort((end, start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    if len(doc) == 0:
        return doc, tag, start, end
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    # the furthest end so far, within the document: ends are lifted by document so that one running maximum does
    number = np.cumsum(other) - 1
    lift = number * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    fresh = other.copy()
    fresh[1:] |= start[1:] + lift[1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    last = np.append(heads[1:], len(doc)) - 1
    return doc[heads], tag[heads], start[heads], reach[last] - lift[last]


FOUND = "span boolean, h long, doc long, tag long, a long, b long, c long, sdoc long, stag long, sa long"


def _settle(params: SuffixParams):
    """Rows come by h, d, doc, place.  Gives spans (a, b: start, end; sdoc, stag, sa: where the same bytes start earlier, stag
    -1 if they are verified; c: bytes before both positions, and from the earlier one on) and, of minimizers with runs of several kinds, the earliest of each (a: position, b, c: bytes
    before it and from it on).  Holds one batch and two rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev = None  # (h, d, doc, place) of the last kind's earliest run
        given = False  # has it been given?
        for batch in batches:
            is_span = batch["span"].to_numpy(bool)
            if is_span.any():
                s = batch[is_span]
                place = s["place"].to_numpy(np.int64)
                yield _found(True, 0, s["doc"], place >> 48, s["d"], place & ((1 << 48) - 1), 0)
                batch = batch[~is_span]
            if len(batch) == 0:
                continue
            h, d, doc, place = (batch[c].to_numpy(np.int64) for c in ("h", "d", "doc", "place"))
            if prev is not None:
                h, d, doc, place = (np.concatenate([[p], x]) for p, x in zip(prev, (h, d, doc, place)))
            same_h = np.zeros(len(h), bool)
            same_h[1:] = h[1:] == h[:-1]
            same = np.zeros(len(h), bool)
            same[1:] = same_h[1:] & (d[1:] == d[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            gone = same & ((doc != doc[head]) | (place != place[head]))
            if gone.any():
                tag, p, before, after = _unpack(place[gone])
                of = head[gone]
                stag, sp, sbefore, safter = _unpack(place[of])
                shape = before | (sbefore << 8) | (safter << 16)
                yield _found(True, h[gone], doc[gone], tag, p - before, p + after, shape, doc[of], stag, sp - sbefore)
            kinds = np.flatnonzero(~same)
            shares = same_h[kinds]  # its minimizer with the kind before
            several = shares.copy()
            several[:-1] |= shares[1:]
            pick = several.copy()
            if given:
                pick[0] = False
            given = bool(several[-1]) or (given and len(kinds) == 1)
            prev = tuple(x[kinds[-1]] for x in (h, d, doc, place))
            if pick.any():
                rows = kinds[pick]
                tag, p, before, after = _unpack(place[rows])
                yield _found(False, h[rows], doc[rows], tag, p, before, after)

    return work


def _found(span, h, doc, tag, a, b, c, sdoc=0, stag=-1, sa=0) -> pd.DataFrame:
    parts = {"span": span, "h": h, "doc": doc, "tag": tag, "a": a, "b": b, "c": c, "sdoc": sdoc, "stag": stag, "sa": sa}
    n = len(doc)
    return pd.DataFrame({k: np.full(n, v) if np.isscalar(v) else np.asarray(v) for k, v in parts.items()})


# ---- suffix sort -----------------------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of one byte string, compared over at most ``limit`` bytes; each must have that many."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data, self.limit = data, limit
        self.sums = prefix_hashes(data)
        self.power, _ = _powers(len(data))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b: binary search over prefix hashes."""
        sums, power = self.sums, self.power
        pa, pb, sa, sb = power[a], power[b], sums[a], sums[b]
        low = np.zeros(len(a), np.int64)
        # most that meet are equal or differ early: try the whole first
        equal = (sums[a + self.limit] - sa) * pb == (sums[b + self.limit] - sb) * pa
        low[equal] = self.limit
        rest = np.flatnonzero(~equal)
        if len(rest):
            a, b, pa, pb, sa, sb = (x[rest] for x in (a, b, pa, pb, sa, sb))
            lo, hi = np.zeros(len(rest), np.int64), np.full(len(rest), self.limit - 1)
            while (lo < hi).any():
                mid = (lo + hi + 1) >> 1
                ok = (sums[a + mid] - sa) * pb == (sums[b + mid] - sb) * pa
                lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
            low[rest] = lo
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """Is suffix a before b (or equal to it)?"""
        n = self.common(a, b)
        done = n == self.limit
        at = np.where(done, 0, n)
        return np.where(done, or_equal, self.data[a + at] < self.data[b + at])

    def sort(self, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Order of the suffixes by bucket (which must not fall), then bytes; equal ones as they come.

        A merge sort, bottom up, all buckets at once: an element's place in a merge is its place in its run plus its rank
        in the other, found by binary search.
        """
        n = len(start)
        order = np.arange(n)
        head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.empty(0, np.int64)
        size = np.diff(np.append(head, n))
        base, total = np.repeat(head, size), np.repeat(size, size)
        local = np.arange(n) - base
        width = 1
        while n and width < size.max():
            run = local // width
            left = run % 2 == 0
            other = np.where(left, run + 1, run - 1) * width
            lo = np.zeros(n, np.int64)
            hi = np.clip(total - other, 0, width)
            own = start[order]
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                mid = (lo[live] + hi[live]) >> 1
                them = own[base[live] + other[live] + mid]
                # of equal ones, those of the left run come first
                before = np.empty(len(live), bool)
                is_left = left[live]
                for side in (True, False):
                    k = np.flatnonzero(is_left == side)
                    before[k] = self.less(them[k], own[live[k]], or_equal=not side)
                lo[live] = np.where(before, mid + 1, lo[live])
                hi[live] = np.where(before, hi[live], mid)
            place = base + (run - run % 2) * width + local % width + lo
            merged = np.empty_like(order)
            merged[place] = order
            order = merged
            width *= 2
        return order

    def verified_equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do suffixes a and b agree over the whole limit?  Where hashes say so, bytes decide."""
        out = self.common(a, b) == self.limit
        span = np.arange(self.limit)
        hits = np.flatnonzero(out)
        for at in range(0, len(hits), 1 << 15):
            k = hits[at : at + (1 << 15)]
            out[k] = (self.data[a[k, None] + span] == self.data[b[k, None] + span]).all(axis=1)
        return out


def repeated_windows(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which windows equal an earlier one of their bucket.  Windows must come earliest first."""
    word = np.lib.stride_tricks.sliding_window_view(data, 8)
    key = lambda at: np.ascontiguousarray(word[at]).view(np.uint64)[:, 0]
    # equal windows also share their first and last eight bytes: finer buckets make shorter merges
    keys = (key(start + length - 8), key(start), bucket)
    order = np.lexsort(keys)
    other = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        other[1:] |= k[1:] != k[:-1]
    fine = np.cumsum(other)
    many = np.bincount(fine)[fine] > 1 if len(fine) else np.empty(0, bool)
    order, fine = order[many], fine[many]
    suffixes = Suffixes(data, length)
    by = suffixes.sort(start[order], fine)
    order, fine = order[by], fine[by]
    again = np.zeros(len(order), bool)
    near = np.flatnonzero(fine[1:] == fine[:-1])
    s = start[order]
    again[near + 1] = suffixes.verified_equal(s[near], s[near + 1])
    out = np.zeros(len(start), bool)
    out[order[again]] = True
    return out


#: Bytes of contexts that are sorted together.
SORT_BYTES = 1 << 20


def _ends(params: SuffixParams):
    """Rows of (h, doc, tag, p, before, context), by h, doc, tag, p: the spans of windows that start earlier elsewhere."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["h", "doc", "tag", "p", "before"])
        size = rows["context"].map(len).to_numpy(np.int64)
        data = np.frombuffer(b"".join(rows["context"]), np.uint8)
        begin = np.cumsum(size) - size
        n = size - params.length + 1
        member = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
        h, before = rows["h"].to_numpy(np.int64), rows["before"].to_numpy(np.int64)
        group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))
        bucket = group[member] * 256 + (before[member] - step)
        again = repeated_windows(data, begin[member] + step, bucket, params.length)
        who, at = member[again], step[again]
        first = (rows["p"].to_numpy(np.int64) - before)[who] + at
        spans = _merged(rows["doc"].to_numpy(np.int64)[who], rows["tag"].to_numpy(np.int64)[who], first, first + params.length)
        return pd.DataFrame(dict(zip(("doc", "tag", "a", "b"), spans)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if len(batch) == 0:
                continue
            held.append(batch)
            size += sum(map(len, batch["context"]))
            newest = batch["h"].iloc[-1]
            if size >= SORT_BYTES and held[0]["h"].iloc[0] != newest:
                every = pd.concat(held)
                last = every["h"].to_numpy() == newest
                yield solve(every[~last])
                held, size = [every[last]], sum(map(len, every["context"][last]))
        if held:
            yield solve(pd.concat(held))

    return work


# ---- tables ----------------------------------------------------------------------------------------------------------

#: Of a text: contexts of runs (kind 0), ranges to be verified (kind 1: the text has at p as many bytes, before, as the
#: source has at h, with the digest in context), and spans that go (kind 2: before bytes at p).
PARTS = "kind int, h long, doc long, tag long, p long, before long, context binary, sdoc long, stag long"


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.iloc[at : at + 500]
            raw = [_bytes(t) for t in part["text"]]
            yield pd.DataFrame({"doc": part["doc"].to_numpy(), "tag": [tag_of(t) for t in raw], "packed": [squeeze.compress(t) for t in raw]})


def _digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def _joined(copied: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """copied: rows of a, b, sdoc, stag, sa.  The ranges that go on alike in one source, as one: a, b, sdoc, stag, sa."""
    order = np.lexsort((copied[:, 0], copied[:, 0] - copied[:, 4], copied[:, 3], copied[:, 2]))
    a, b, sdoc, stag, sa = copied[order].T
    fresh = np.ones(len(a), bool)
    fresh[1:] = (sdoc[1:] != sdoc[:-1]) | (stag[1:] != stag[:-1]) | (a[1:] - sa[1:] != a[:-1] - sa[:-1]) | (a[1:] > b[:-1])
    heads = np.flatnonzero(fresh)
    ends = np.maximum.reduceat(b, heads)
    yield from zip(*(x.tolist() for x in (a[heads], ends, sdoc[heads], stag[heads], sa[heads])))


def _parts(params: SuffixParams):
    """Rows of doc, tag, packed, ends, copied to PARTS."""
    length = params.length

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor()
        names = [c.split()[0] for c in PARTS.split(", ")]
        windows: dict[tuple[int, bytes], tuple] = {}
        for batch in batches:
            out = []
            for doc, tag, packed, ends, copied in zip(*(batch[c] for c in ("doc", "tag", "packed", "ends", "copied"))):
                raw = expand.decompress(packed)
                for h, p, before, after, hot in np.reshape(ends, (-1, 5)).tolist():
                    context = raw[p - before : p + after]
                    if not hot:
                        out.append((0, h, doc, tag, p, before, context, 0, 0))
                        continue
                    for k in range(len(context) - length + 1):
                        window = context[k : k + length]
                        at = p - before + k
                        # windows are dealt by the minimizer, its place in them, and what they begin and end with
                        digest = hashlib.blake2b(b"%d %d " % (h, before - k) + window[:8] + window[-8:], digest_size=8).digest()
                        key = int.from_bytes(digest, "little", signed=True)
                        first = windows.setdefault((key, window), (doc, tag, at))
                        if first == (doc, tag, at):
                            pass
                        elif first < (doc, tag, at):
                            out.append((2, 0, doc, tag, at, length, None, 0, 0))
                            continue
                        else:
                            # the earlier of the two is what others are held against
                            windows[key, window] = (doc, tag, at)
                        out.append((0, key, doc, tag, at + before - k, before - k, window, 0, 0))
                    if len(windows) > HELD_WINDOWS:
                        windows.clear()
                if len(copied):
                    for a, b, sdoc, stag, sa in _joined(np.reshape(copied, (-1, 5)).astype(np.int64)):
                        out.append((1, sa, doc, tag, a, b - a, _digest(raw[a:b]), sdoc, stag))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return work


SPANS = "doc long, tag long, a long, b long"


def _spans(docs: DataFrame, params: SuffixParams, bad: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: doc (long, not null), text.  Returns doc, tag, a, b: spans [a, b) that go, which may overlap; requests: what has
    to be verified for that; and where runs were settled (FOUND).

    bad: doc, tag, a of runs that are known not to be what their hash says; they are sorted like those of other kinds."""
    n = partitions(docs.sparkSession)
    runs = docs.mapInPandas(_runs(params), RUN)
    runs = runs.repartition(n, "h").sortWithinPartitions("h", "d", "doc", "place")
    found = materialize(runs.mapInPandas(_settle(params), FOUND), "runs")
    if bad is not None:
        # the run, and the one that it was taken for, as kinds of their own
        at = ["doc", "tag", "a"]
        wrong = found.where("span AND stag >= 0").join(bad, at, "left_semi")
        before, sbefore, safter = (F.shiftright("c", k).bitwiseAND(F.lit(255)) for k in (0, 8, 16))
        here = wrong.select(F.lit(False).alias("span"), "h", "doc", "tag", (F.col("a") + before).alias("a"), before.alias("b"), (F.col("b") - F.col("a") - before).alias("c"))
        there = wrong.select(F.lit(False).alias("span"), "h", F.col("sdoc").alias("doc"), F.col("stag").alias("tag"), (F.col("sa") + sbefore).alias("a"), sbefore.alias("b"), safter.alias("c"))
        kinds = here.unionByName(there).distinct().select("*", F.lit(0).cast("long").alias("sdoc"), F.lit(-1).cast("long").alias("stag"), F.lit(0).cast("long").alias("sa"))
        marked = found.join(bad.select(*at, F.lit(True).alias("bad")).distinct(), at, "left")
        found = marked.where("NOT (span AND stag >= 0 AND coalesce(bad, false))").select(*found.columns).unionByName(kinds)
    kinds = found.where("NOT span")
    hot = kinds.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > params.hot_runs).select("h", F.lit(1).cast("long").alias("hot"))
    ends = kinds.join(hot, "h", "left").select("doc", "tag", F.array("h", "a", "b", "c", F.coalesce("hot", F.lit(0))).alias("end"), F.lit(None).cast("array<long>").alias("copy"))
    copied = found.where("span AND stag >= 0").select("doc", "tag", F.lit(None).cast("array<long>").alias("end"), F.array("a", "b", "sdoc", "stag", "sa").alias("copy"))
    wanted = ends.unionByName(copied).groupBy("doc", "tag").agg(F.flatten(F.collect_list("end")).alias("ends"), F.flatten(F.collect_list("copy")).alias("copied"))
    packed = docs.mapInPandas(_packed, "doc long, tag long, packed binary")
    parts = packed.join(wanted, ["doc", "tag"]).select("doc", "tag", "packed", "ends", "copied")
    parts = materialize(parts.mapInPandas(_parts(params), PARTS), "parts")
    contexts = parts.where("kind = 0").select("h", "doc", "tag", "p", "before", "context")
    contexts = contexts.repartition(n, "h").sortWithinPartitions("h", "doc", "tag", "p")
    spans = found.where("span").select("doc", "tag", "a", "b").unionByName(contexts.mapInPandas(_ends(params), SPANS))
    spans = spans.unionByName(parts.where("kind = 2").select("doc", "tag", F.col("p").alias("a"), (F.col("p") + F.col("before")).alias("b")))
    requests = parts.where("kind = 1").select(F.col("sdoc").alias("doc"), F.col("stag").alias("tag"), F.col("h").alias("at"), F.col("before").alias("size"), F.col("context").alias("digest"), F.col("doc").alias("of_doc"), F.col("tag").alias("of_tag"), F.col("p").alias("of_a"))
    return spans, requests, found


#: A row per document (bad false), or per range of a source that failed (bad true; n_bytes, n_removed: where it starts, its
#: size; text_sha256: the digest that was asked for).
KEPT = (
    "bad boolean, doc long, tag long, n_bytes long, n_removed long, n_spans long, text_sha256 string, kept_sha256 string, kept string"
)


def _apply(with_text: bool):
    """Rows of doc, tag, packed, spans (null: none go), requests (null: none), result (is a row due?) to KEPT."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor()
        names = [c.split()[0] for c in KEPT.split(", ")]
        for batch in batches:
            out = []
            size = 0
            for doc, tag, packed, spans, requests, due in zip(*(batch[c] for c in ("doc", "tag", "packed", "spans", "requests", "due"))):
                raw = expand.decompress(packed)
                for r in requests if requests is not None else ():
                    if _digest(raw[r["at"] : r["at"] + r["size"]]) != r["digest"]:
                        out.append((True, doc, tag, r["at"], r["size"], 0, bytes(r["digest"]).hex(), None, None))
                if not due:
                    continue
                kept, removed, count, at = [], 0, 0, 0
                reach = -1
                for a, b in sorted(np.reshape(spans, (-1, 2)).tolist()) if spans is not None else ():
                    if a > reach:
                        kept.append(raw[at:a])
                        count += 1
                        removed += b - a
                        reach = b
                    elif b > reach:
                        removed += b - reach
                        reach = b
                    at = reach
                kept.append(raw[at:])
                left = b"".join(kept)
                size += len(left) if with_text else 0
                digests = (hashlib.sha256(x).hexdigest() for x in (raw, left))
                text = left.decode("utf-8", "ignore") if with_text else None
                out.append((False, doc, tag, len(raw), removed, count, *digests, text))
                if size > 1 << 24:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    return work


def _applied(docs: DataFrame, spans: DataFrame, requests: DataFrame, with_text: bool) -> DataFrame:
    """docs: doc, text.  KEPT: a row per row of docs, and one per request that fails."""
    spans = spans.groupBy("doc", "tag").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("spans"))
    # copies ask for the same; a text that very many others share parts with gets several lists
    asked = requests.select("doc", "tag", "at", "size", "digest").distinct()
    lists = asked.join(asked.groupBy("doc", "tag").agg(F.floor((F.count("*") - 1) / REQUESTS).alias("more")), ["doc", "tag"])
    one = F.struct("at", "size", "digest")
    lists = lists.groupBy("doc", "tag", F.pmod(F.xxhash64("at", "size", "digest"), F.col("more") + 1).alias("k")).agg(F.collect_list(one).alias("requests"))
    lists = materialize(lists, "requests")
    packed = docs.mapInPandas(_packed, "doc long, tag long, packed binary")
    columns = ["doc", "tag", "packed", "spans", "requests", "due"]
    joined = packed.join(spans, ["doc", "tag"], "left").join(lists.where("k = 0").drop("k"), ["doc", "tag"], "left").withColumn("due", F.lit(True)).select(columns)
    rest = lists.where("k > 0").drop("k")
    if not rest.isEmpty():
        more = packed.join(rest, ["doc", "tag"]).withColumns({"spans": F.lit(None).cast("array<long>"), "due": F.lit(False)})
        joined = joined.unionByName(more.select(columns))
    return joined.mapInPandas(_apply(with_text), KEPT)


def _one_text_per_id(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs: doc_id, text, to doc, text, where no two texts share a doc; and doc, doc_id where these differ.

    If a doc_id has several texts (rows without one usually do), the pairs of doc_id and text digest are numbered in order:
    a range partitioning, sorted, whose partition and row make the number."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    pairs = keyed.select("doc", "digest").distinct()
    if pairs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return keyed.select("doc", "text"), None
    ordered = pairs.repartitionByRange(partitions(docs.sparkSession), "doc", "digest").sortWithinPartitions("doc", "digest")
    numbered = materialize(ordered.select(F.col("doc").alias("old"), F.col("digest").alias("of"), F.monotonically_increasing_id().alias("doc")), "numbers")
    renamed = keyed.join(numbered.withColumnRenamed("doc", "number"), (F.col("doc") == F.col("old")) & (F.col("digest") == F.col("of")))
    return renamed.select(F.col("number").alias("doc"), "text"), numbered.select("doc", "old")


def deduplicated(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """The rows of docs with what is left of their texts (a null text is empty then), and n_chars, if there is one, counted
    anew; other columns as they are, whatever they are called."""
    kept = suffix_dedup(docs, params, with_text=True).select("doc_id", "text_sha256", "kept")
    if not kept.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text_sha256"])
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_of"), "kept")
    carried = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"),
        F.col("doc_id").cast("long").alias("row_id"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("row_of"),
    )
    joined = carried.join(kept, F.col("row_id").eqNullSafe(F.col("kept_id")) & (F.col("row_of") == F.col("kept_of")))
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def suffix_dedup(docs: DataFrame, params: SuffixParams = SuffixParams(), with_text: bool = False) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, n_bytes, n_removed, n_spans, text_sha256, kept_sha256 and kept (the
    remaining text, if asked for, without characters that were cut); a row per row.

    Null text counts as empty.  Null doc_ids come before all others.  Rows with equal doc_id and text are one document
    and get equal results; rows with equal doc_id and other texts are ordered by a digest of the text.  Empty tables give
    an empty result.  Other columns are ignored.
    """
    keyed, numbers = _one_text_per_id(docs)
    spans, requests, _ = _spans(keyed, params, None)
    out = materialize(_applied(keyed, spans, requests, with_text), "kept")
    failed = out.where("bad").select("doc", "tag", F.col("n_bytes").alias("at"), F.col("n_removed").alias("size"), F.unhex("text_sha256").alias("digest"))
    if not failed.isEmpty():
        out = _resolved(keyed, params, requests.join(failed, ["doc", "tag", "at", "size", "digest"], "left_semi"), with_text)
    out = out.where("NOT bad")
    out = out.join(numbers, "doc").withColumn("doc", F.col("old")) if numbers is not None else out
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return out.select(doc_id, "n_bytes", "n_removed", "n_spans", "text_sha256", "kept_sha256", "kept")


def _resolved(docs: DataFrame, params: SuffixParams, failed: DataFrame, with_text: bool) -> DataFrame:
    """The result where hashes have met by chance: every run within a range that failed is sorted."""
    failed = failed.select(F.col("of_doc").alias("doc"), F.col("of_tag").alias("tag"), F.col("of_a").alias("from"), (F.col("of_a") + F.col("size")).alias("to"))
    runs = materialize(_spans(docs, params, None)[2].where("span AND stag >= 0").select("doc", "tag", "a", "b"), "runs")
    inside = (F.col("a") >= F.col("from")) & (F.col("b") <= F.col("to"))
    bad = materialize(runs.join(failed, ["doc", "tag"]).where(inside).select("doc", "tag", "a").distinct(), "bad")
    spans, _, _ = _spans(docs, params, bad)
    none = docs.sparkSession.createDataFrame([], "doc long, tag long, at long, size long, digest binary, of_doc long, of_tag long, of_a long")
    return _applied(docs, spans, none, with_text)
