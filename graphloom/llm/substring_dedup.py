"""Exact substring dedup over a distributed, sparse enhanced suffix array.

Any string of ``LENGTH`` bytes contains an anchor: the ``GRAM`` bytes with the
smallest hash among its ``LENGTH - GRAM + 1`` places (the last of equal ones), so
equal strings have equal anchors at equal places.  Only suffixes that begin at
anchors are sorted.  Suffixes with the same anchor meet in one bucket of hashes;
there the right contexts and the reversed left contexts are sorted with their
common prefix lengths.  A scan with a stack closes the common-prefix intervals
of the right contexts; each is tested for the diversity of its left extensions
and divided where they differ, which gives the maximal groups of equal strings
with all their occurrences.  Of each group the smallest document keeps its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _bytes as B
from graphloom.plans.stash import stash

LENGTH, GRAM = 50, 20
#: Places of an anchor in a string.
PLACES = LENGTH - GRAM + 1
_LOW = np.uint64(0xFFFFFFFF)
#: Bits for positions beside the hash in one integer, and bytes looked at in one go.
_BITS, _PIECE = 26, 1 << 25
_CONTEXT = ["anchor", "doc", "row", "place", "near", "far", "bytes"]
#: Suffixes that are sorted at once (more if one anchor has more).
_SUFFIXES = 1 << 19


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM = 8 + 8 + 4 bytes from each place on."""
    wide = data.astype(np.uint64)
    two = wide[:-1] | wide[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(data) - GRAM + 1
    h = B.mix(eight[:n]) + eight[8 : 8 + n] * np.uint64(0x9E3779B97F4A7C15)
    return B.mix(h + four[16 : 16 + n] * np.uint64(0xD6E8FEB86659FD93))


def _anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all texts: place, hash, and first and last start of the strings that it is the anchor of."""
    found = []
    for lo in range(0, max(1, len(data) - LENGTH + 1), _PIECE):
        piece = data[lo : lo + _PIECE + LENGTH - 1]
        if len(piece) < LENGTH:
            break
        h = _gram_hashes(piece)
        last = np.uint64((1 << _BITS) - 1)
        key = (h & ~last) | (last - np.arange(len(h), dtype=np.uint64))
        width, low = 1, key
        while width * 2 <= PLACES:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        low = np.minimum(low[: len(low) - (PLACES - width)], low[PLACES - width :])
        inside = np.ones(len(low) + 1, np.int32)
        # strings must not reach over the end of a text
        ends = off[1:] - lo
        change = np.zeros(len(low) + 1, np.int32)
        np.add.at(change, np.clip(np.maximum(ends - LENGTH + 1, off[:-1] - lo), 0, len(low)), -1)
        np.add.at(change, np.clip(ends, 0, len(low)), 1)
        inside = (1 + np.cumsum(change))[:-1] > 0
        starts = np.flatnonzero(inside)
        if not len(starts):
            continue
        place = (last - (low[starts] & last)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        end = np.append(first[1:], len(starts)) - 1
        found.append((place[first] + lo, h[place[first]], starts[first] + lo, starts[end] + lo))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _packed(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


_BUNDLE = "chunk int, docs binary, counts binary, items binary"


def _bundles(doc: np.ndarray, items: np.ndarray, chunks: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Items (rows of 64-bit integers) of documents, packed by a hash of the document: one row a chunk."""
    if not len(doc):
        return []
    chunk = (B.mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(chunks)).astype(np.int64)
    order = np.lexsort((doc, chunk))
    doc, items, chunk = doc[order], items[order], chunk[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, len(doc)))
    edge = np.flatnonzero(np.diff(chunk[first], prepend=-1))
    at = np.append(first, len(doc))
    return [
        (int(chunk[first[a]]), doc[first[a:b]].astype("<i8").tobytes(), count[a:b].astype("<u4").tobytes(), items[at[a] : at[b]].astype("<i8").tobytes())
        for a, b in zip(edge, np.append(edge, len(first))[1:], strict=True)
    ]


def _bundle_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_packed(rows, [pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["chunk", "docs", "counts", "items"])])


def _by_document(bundles: DataFrame, name: str, width: int) -> DataFrame:
    """One row for each document with all its items: ``(doc_id, <name> binary)``."""

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
        doc = np.repeat(read("docs", "<i8"), read("counts", "<u4"))
        items = read("items", "<i8").reshape(-1, width)
        order = np.argsort(doc, kind="stable")
        doc, items = doc[order], items[order]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        data = [items[a:b].tobytes() for a, b in zip(first, np.append(first, len(doc))[1:], strict=True)]
        return pa.table({"doc_id": pa.array(doc[first], pa.int64()), name: pa.array(data, pa.binary())})

    return bundles.groupBy("chunk").applyInArrow(gather, f"doc_id long, {name} binary")


def shared_anchors(docs: DataFrame) -> DataFrame:
    """``(doc_id, codes)``: anchors of each document that stand in another document too (``doc_id``: any key of rows).

    A slice of documents sends each anchor that only one of its documents has to
    a bucket, packed; one that several have is settled in the slice and sent a
    single time, so that a passage of a third of all documents is sent once a
    slice.  Buckets answer by document.
    """
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = ["bucket", "codes", "docs", "common"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    signed = lambda code: code.astype(np.uint64).view(np.int64)[:, None]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, data, off in B.parts(batch.column("text"), 2 * B.SLICE):
                place, h, _, _ = _anchors(data, off)
                if not len(place):
                    continue
                doc = ids[lo:hi][np.searchsorted(off, place, "right") - 1]
                to = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                code = to.astype(np.uint64) << np.uint64(32) | (h & _LOW)
                order = np.lexsort((doc, code))
                code, doc = code[order], doc[order]
                fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])
                code, doc = code[fresh], doc[fresh]
                new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                length = np.diff(np.append(new, len(code)))
                several = np.repeat(length > 1, length)
                # settled here: answers for the documents themselves
                rows = [(-1 - k, items, own, counts) for k, own, counts, items in _bundles(doc[several], signed(code[several]), buckets)]
                common, code, doc = code[new[length > 1]], code[~several], doc[~several]
                order = np.lexsort((doc, code >> np.uint64(32)))
                code, doc = code[order], doc[order]
                cut = np.searchsorted(code >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                edge = np.searchsorted(common >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                for k in range(buckets):
                    a, b = cut[k], cut[k + 1]
                    if b > a or edge[k + 1] > edge[k]:
                        # differences of the sorted ids are small numbers, which compress well
                        apart = np.diff(doc[a:b], prepend=0)
                        rows.append((k, (code[a:b] & _LOW).astype("<u4").tobytes(), apart.astype("<i8").tobytes(), (common[edge[k] : edge[k + 1]] & _LOW).astype("<u4").tobytes()))
                yield _packed(rows, kinds, names)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        if k < 0:
            return pa.table({"chunk": pa.array([-1 - k] * table.num_rows, pa.int32()), "docs": table.column("docs"), "counts": table.column("common"), "items": table.column("codes")})
        code = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("codes")])
        doc = np.concatenate([np.cumsum(np.frombuffer(x.as_buffer(), "<i8")) for x in table.column("docs")])
        common = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("common")]))
        order = np.lexsort((doc, code))
        code, doc = code[order], doc[order]
        other = np.zeros(len(code), bool)
        if len(code):
            new = np.concatenate([[True], code[1:] != code[:-1]])
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(code)) - 1
            other = (doc[first] != doc[ends])[group] | np.isin(code, common)
        full = code[other].astype(np.uint64) | np.uint64(k) << np.uint64(32)
        return _bundle_table(_bundles(doc[other], signed(full), buckets))

    sent = docs.select("doc_id", "text").mapInArrow(send, "bucket int, codes binary, docs binary, common binary")
    told = sent.groupBy("bucket").applyInArrow(answer, _BUNDLE)
    return _by_document(told, "codes", 1)


def _zip(data: bytes) -> bytes:
    """Compressed, with the length in front: texts cross the network twice and contexts once."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _compressed(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, z)``: null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.utf8(batch.column("text"))
            z = [_zip(data[off[i] : off[i + 1]].tobytes()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(z, pa.binary())], ["doc_id", "key", "z"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, z binary")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of compressed texts."""
    z = batch.column("z")
    off = np.concatenate([[0], np.cumsum([int.from_bytes(x.as_buffer()[:8].to_pybytes(), "little") for x in z])]).astype(np.int64)
    for lo, hi in B.slices(off):
        data = np.frombuffer(b"".join(_unzip(x.as_buffer().to_pybytes()) for x in z[lo:hi]), np.uint8)
        yield lo, hi, data, off[lo : hi + 1] - off[lo]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all ranges, and the range that each belongs to."""
    size = last - first + 1
    at = np.cumsum(size) - size
    return np.repeat(first - at, size) + np.arange(size.sum()), np.repeat(np.arange(len(first)), size)


def _settled(h: np.ndarray, doc: np.ndarray, near: np.ndarray, far: np.ndarray, begin: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Of the suffixes of a slice, those whose whole context a smaller document of the slice has too."""
    length = far - near + LENGTH
    text = B.span_hashes(B.running(data), begin, begin + length)
    order = np.lexsort((doc, near, far, text, h))
    same = np.ones(len(order), bool)
    same[:1] = False
    for c in (h, text, near, far):
        same[1:] &= c[order[1:]] == c[order[:-1]]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.flatnonzero(doc[order] > doc[order[head]])
    a, b = order[later], order[head[later]]
    if not len(a):
        return a
    (x, own), (y, _) = (_spread(begin[i], begin[i] + length[i] - 1) for i in (a, b))
    return a[np.bincount(own, data[x] != data[y], len(a)) == 0]


def _contexts(docs: DataFrame, settle: bool = True) -> DataFrame:
    """Suffixes at shared anchors of ``docs(doc_id, key, z, codes)``, packed by bucket.

    For each: anchor, document, row, place, the range of its distances from the starts
    of its strings, and the bytes from the first start to the last string's end.
    With ``settle``, of suffixes of a slice with one context only those of the smallest
    document are sent; the others are known to be repeats, and their spans go to
    the buckets below zero, so that a passage of a third of all documents is sent once a slice.
    """
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["bucket", *_CONTEXT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
            held: dict[int, list[tuple]] = {}
            rows = []
            for lo, hi, data, off in _texts(batch):
                place, h, first, last = _anchors(data, off)
                own = np.searchsorted(off, place, "right") - 1
                code = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | (h & _LOW)
                keep = np.zeros(len(place), bool)
                edge = np.searchsorted(own, np.arange(hi - lo + 1))
                for i, codes in enumerate(batch.column("codes")[lo:hi]):
                    wanted = np.frombuffer(codes.as_buffer(), "<u8")
                    keep[edge[i] : edge[i + 1]] = np.isin(code[edge[i] : edge[i + 1]], wanted)
                at = np.flatnonzero(keep)
                if settle and len(at):
                    done = np.sort(at[_settled(h[at], ids[lo:hi][own[at]], place[at] - last[at], place[at] - first[at], first[at], data)])
                    # spans that meet are sent as one
                    new = np.flatnonzero(np.concatenate([[True], (own[done[1:]] != own[done[:-1]]) | (first[done[1:]] > last[done[:-1]] + LENGTH)])[: len(done)])
                    end = np.append(new[1:], len(done))[: len(new)] - 1
                    text = own[done[new]]
                    spans = np.column_stack([first[done[new]], last[done[end]] + LENGTH]) - off[text][:, None]
                    rows += [(-1 - k, b"", docs, counts, items, b"", b"", b"") for k, docs, counts, items in _bundles(keys[lo:hi][text], spans, buckets)]
                    keep[done] = False
                    at = np.flatnonzero(keep)
                if not len(at):
                    continue
                to = (code[at] >> np.uint64(32)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                at, to = at[order], to[order]
                cut = np.flatnonzero(np.diff(to, prepend=-1, append=buckets))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    k = at[a:b]
                    index, _ = _spread(first[k], last[k] + LENGTH - 1)
                    held.setdefault(int(to[a]), []).append(
                        (h[k].astype("<u8").tobytes(), ids[lo:hi][own[k]].astype("<i8").tobytes(), (keys - ids)[lo:hi][own[k]].astype("<i8").tobytes(), (place[k] - off[own[k]]).astype("<i8").tobytes(), (place[k] - last[k]).astype("u1").tobytes(), (place[k] - first[k]).astype("u1").tobytes(), data[index].tobytes())
                    )
            rows += [(k, *[_zip(b"".join(c)) for c in zip(*own, strict=True)]) for k, own in held.items()]
            yield _packed(rows, [pa.int32(), *[pa.binary()] * 7], names)

    return docs.mapInArrow(run, "bucket int, " + ", ".join(f"{n} binary" for n in names[1:]))


def _levels(group: np.ndarray, context: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``context`` rows within groups: the order, and the common prefix of each row
    with the one before it (-1 where a group begins).  ``length``: bytes that each row really has."""
    wide = np.zeros((len(context), -(-context.shape[1] // 8) * 8), np.uint8)
    wide[:, : context.shape[1]] = context
    columns = wide.view(">u8")
    order = np.lexsort((*columns.T[::-1], group))
    common = np.full(len(order), -1, np.int8)
    if len(order) > 1:
        a, b = context[order[1:]], context[order[:-1]]
        differ = a != b
        same = np.where(differ.any(1), differ.argmax(1), context.shape[1])
        same = np.minimum(same, np.minimum(length[order[1:]], length[order[:-1]]))
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], same, -1)
    return order, common


def intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, last row and depth of each interval of rows with a common prefix, by one scan with a stack.

    ``common``: common prefix of each row with the one before it, negative where none counts.
    """
    firsts, lasts, depths = [], [], []
    depth, first = [-1], [0]
    top = -1
    for i, c in enumerate([*common[1:].tolist(), -1]):
        if c == top:
            continue
        low = i
        while top > c:
            low = first.pop()
            firsts.append(low)
            lasts.append(i)
            depths.append(depth.pop())
            top = depth[-1]
        if c > top:
            depth.append(c)
            first.append(low)
            top = c
    return np.array(firsts, np.int64), np.array(lasts, np.int64), np.array(depths, np.int64)


class _Least:
    """Smallest value of any range of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows, width = [values], 1
        while 2 * width <= len(values):
            low = self.rows[-1].copy()
            low[: len(low) - width] = np.minimum(low[:-width], low[width:])
            self.rows.append(low)
            width *= 2
        self.rows = np.stack(self.rows)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of the values after place a, up to place b > a."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        return np.minimum(self.rows[k, a + 1], self.rows[k, b - (1 << k) + 1])


def maximal_groups(anchor: np.ndarray, doc: np.ndarray, near: np.ndarray, far: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal strings of at least ``LENGTH`` bytes around anchors that at least two documents
    have and that cannot be made longer for all members: (member suffix, its group), and for each group
    the bytes before and from the anchor on.

    ``data`` holds for each suffix, one after the other, the bytes from ``far`` bytes before the anchor to
    the end of the string that begins ``near`` before it; a group is the longest within these bytes.

    One scan with a stack gives the common-prefix intervals of the sorted right contexts.  The left contexts
    of an interval's members, in sorted order, are scanned in the same way: the intervals found there differ
    in the next byte to the left, and those whose members lie in one deeper right interval are left to that.
    """
    n = len(anchor)
    before, after = far, LENGTH - near
    begin = np.cumsum(far + after) - far - after
    group = np.unique(anchor, return_inverse=True)[1]
    # one more than the byte, so that no byte of UTF-8 equals what stands beyond the end
    right = np.zeros((n, LENGTH), np.uint8)
    for j in range(LENGTH):
        ok = j < after
        right[ok, j] = data[begin[ok] + far[ok] + j] + np.uint8(1)
    left = np.zeros((n, PLACES - 1), np.uint8)
    for j in range(PLACES - 1):
        ok = j < before
        left[ok, j] = data[begin[ok] + far[ok] - 1 - j] + np.uint8(1)
    r_order, r_common = _levels(group, right, after)
    l_order, l_common = _levels(group, left, before)
    del right, left
    r_common = np.where(r_common < GRAM, np.int8(-1), r_common)
    first, last, depth = intervals(r_common)
    none = np.zeros(0, np.int64)
    if not len(first):
        return none, none, none, none
    r_rank, l_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    r_rank[r_order], l_rank[l_order] = np.arange(n), np.arange(n)
    r_least, l_least = _Least(r_common), _Least(l_common)

    # members of each right interval by their left contexts
    row, own = _spread(first, last)
    member = r_order[row]
    start = np.flatnonzero(np.diff(own, prepend=-1))
    several = np.minimum.reduceat(doc[member], start) != np.maximum.reduceat(doc[member], start)
    inside = several[own]
    member, own = member[inside], own[inside]
    if not len(member):
        return none, none, none, none
    order = np.lexsort((l_rank[member], own))
    member, own = member[order], own[order]
    rank = l_rank[member]
    common = np.full(len(member), -1, np.int64)
    same = np.flatnonzero(own[1:] == own[:-1]) + 1
    common[same] = l_least.between(rank[same - 1], rank[same])
    common[common + depth[own] < LENGTH] = -1
    a, b, left_depth = intervals(common)
    if not len(a):
        return none, none, none, none
    row, g = _spread(a, b)
    start = np.flatnonzero(np.diff(g, prepend=-1))
    member_of = member[row]
    low, high = np.minimum.reduceat(r_rank[member_of], start), np.maximum.reduceat(r_rank[member_of], start)
    right_depth = depth[own[a]]
    several = np.minimum.reduceat(doc[member_of], start) != np.maximum.reduceat(doc[member_of], start)
    keep = several & (r_least.between(low, high) == right_depth)
    number = np.cumsum(keep) - 1
    chosen = keep[g]
    return member_of[chosen], number[g[chosen]], left_depth[keep], right_depth[keep]


def repeats(anchor: np.ndarray, doc: np.ndarray, near: np.ndarray, far: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each suffix and distance l from its start, whether the string of ``LENGTH`` bytes that
    begins l bytes before the anchor also begins in a smaller document (suffixes x places)."""
    member, group, left, right = maximal_groups(anchor, doc, near, far, data)
    change = np.zeros(len(anchor) * (PLACES + 1), np.int64)
    if len(member):
        least = np.minimum.reduceat(doc[member], np.flatnonzero(np.diff(group, prepend=-1)))
        later = doc[member] > least[group]
        member, group = member[later], group[later]
        change += np.bincount(member * (PLACES + 1) + LENGTH - right[group], minlength=len(change))
        change -= np.bincount(member * (PLACES + 1) + left[group] + 1, minlength=len(change))
    return np.cumsum(change.reshape(-1, PLACES + 1), axis=1)[:, :PLACES] > 0


def _suffixes(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Suffixes of a bucket, all of an anchor together, about ``_SUFFIXES`` at a time."""
    read = lambda c, t: np.concatenate([np.frombuffer(_unzip(x.as_buffer().to_pybytes()), t) for x in table.column(c)])
    anchor, doc, key, place, near, far, data = (read(c, t) for c, t in zip(_CONTEXT, ("<u8", "<i8", "<i8", "<i8", "u1", "u1", "u1"), strict=True))
    near, far = near.astype(np.int64), far.astype(np.int64)
    length = far - near + LENGTH
    begin = np.cumsum(length) - length
    order = np.argsort(anchor, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(anchor[order], prepend=~anchor[order[:1]])), len(order))
    lo = 0
    while lo < len(order):
        hi = int(edges[max(np.searchsorted(edges, lo + _SUFFIXES, "right") - 1, np.searchsorted(edges, lo, "right"))])
        at = order[lo:hi]
        index, _ = _spread(begin[at], begin[at] + length[at] - 1)
        yield anchor[at], doc[at], (doc + key)[at], place[at], near[at], far[at], data[index]
        lo = hi


def covered(contexts: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: of each row, known by its key, the byte ranges (from, to) that stand in a smaller document."""
    chunks = 2 * int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(bucket: tuple, table: pa.Table) -> pa.Table:
        k = bucket[0].as_py()
        if k < 0:  # settled before they were sent
            return pa.table({"chunk": pa.array([-1 - k] * table.num_rows, pa.int32()), "docs": table.column("doc"), "counts": table.column("row"), "items": table.column("place")})
        rows = []
        for anchor, doc, key, place, near, far, data in _suffixes(table):
            hit = repeats(anchor, doc, near, far, data)
            # neighbouring distances make one range
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, low = np.nonzero(edge == 1)
            _, high = np.nonzero(edge == -1)
            rows += _bundles(key[row], np.column_stack([place[row] - (high - 1), place[row] - low + LENGTH]), chunks)
        return _bundle_table(rows)

    return _by_document(contexts.groupBy("bucket").applyInArrow(scan, _BUNDLE), "spans", 2)


def _kept(data: bytes, spans: bytes) -> tuple[bytes, int, int]:
    """What is left of the text, bytes removed, maximal removed runs."""
    s = np.frombuffer(spans, "<i8").reshape(-1, 2)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, s[:, 0], 1)
    np.add.at(change, s[:, 1], -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, key)``: rows are known by their id where all ids are different (one narrow
    aggregation tells), otherwise by a hash of id and text."""
    repeated = bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))
    return docs.select("doc_id", "text", (F.xxhash64("doc_id", "text") if repeated else F.col("doc_id")).alias("key"))


def _anchored(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """The rows of ``packed`` that share an anchor with another, with its codes."""
    told = stash(shared_anchors(docs.where("doc_id is not null").select(F.col("key").alias("doc_id"), "text")), "anchors").withColumnRenamed("doc_id", "_key")
    return packed.join(told, packed["key"] == told["_key"]).where("doc_id is not null")


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """``(group, length, doc_id, start)``: one row for each occurrence (byte place) of each group of equal strings.

    A group has ``length`` >= ``LENGTH`` bytes around one anchor, stands in two or more documents, and no
    byte more on either side is common to all its occurrences, as far as the strings of this anchor reach
    (at most ``PLACES - 1`` bytes before the anchor and ``LENGTH`` from it on; a longer repeat is a chain of
    overlapping groups).  Rows without an id take no part.
    """
    docs = _keyed(docs)

    def scan(bucket: tuple, table: pa.Table) -> pa.Table:
        out = []
        for anchor, doc, _, place, near, far, data in _suffixes(table):
            member, group, left, right = maximal_groups(anchor, doc, near, far, data)
            edge = np.diff(group, prepend=-1) > 0
            # occurrences differ between groups of an anchor, so number and extent name a group
            extent = (left * (LENGTH + 1) + right).astype(np.uint64)
            first = B.mix((doc[member][edge].view(np.uint64) << np.uint64(20)) + place[member][edge].astype(np.uint64))
            name = (B.mix(anchor[member[edge]] + B.mix(extent)) ^ first).view(np.int64)
            out.append(pa.table({"group": pa.array(name[group], pa.int64()), "length": pa.array((left + right)[group], pa.int64()), "doc_id": pa.array(doc[member], pa.int64()), "start": pa.array(place[member] - left[group], pa.int64())}))
        return pa.concat_tables(out)

    return _contexts(_anchored(docs, _compressed(docs)), settle=False).groupBy("bucket").applyInArrow(scan, "group long, length long, doc_id long, start long")


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` and, if asked, ``kept`` (the bytes left).

    Removed is each byte covered by a string of ``LENGTH`` bytes that also starts
    in a document with a smaller id; strings are judged on the input.  Null and
    shorter texts lose nothing.  Rows of one id, equal or not, are parts of that
    document: each is judged by its own text, and they do not remove from each
    other.  Rows without an id are not compared and lose nothing.  An empty table
    gives an empty result.
    """
    docs = _keyed(docs)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes
    packed = _compressed(docs)
    spans = stash(covered(_contexts(_anchored(docs, packed))), "spans").withColumnRenamed("doc_id", "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, z, own in zip(batch.column("doc_id").to_pylist(), batch.column("z"), batch.column("spans").to_pylist(), strict=True):
                text = _unzip(z.as_buffer().to_pybytes())
                kept, n, runs = _kept(text, own) if own and text else (text, 0, 0)
                rows.append((doc, len(text), n, runs, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            yield _packed(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)], names)

    joined = packed.join(spans, packed["key"] == spans["_key"], "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same with all strings of all documents, as hexadecimal digits.
OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, n - 49))) AS i FROM n)),
m AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM m),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
e AS (SELECT doc_id, NULL AS a, 0 AS b FROM n UNION ALL SELECT doc_id, a, b FROM p),
k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY b, a NULLS FIRST) AS next_a FROM e)
SELECT n.doc_id, any_value(n) AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans,
       sha256(unhex(string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next_a, n) - b)), '' ORDER BY b, a NULLS FIRST))) AS kept_sha256
FROM n JOIN k ON k.doc_id = n.doc_id GROUP BY n.doc_id
"""
