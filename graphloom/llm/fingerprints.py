"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraph digests.

A text is cut into short paragraph pieces at places that its own words choose,
so an edit changes only the pieces around it.  Each piece is a 64-bit digest
(48 bits of hash, 16 of length).  A sketch adds each digest to three cells; two
sketches subtract cell by cell, what both texts share cancels, and peeling
cells that hold one digest recovers the digests that differ.  If peeling gets
stuck, the pair is tried again with twice the cells, until it comes out.

All texts of a slice share one array of cells, so each round of peeling is a
few numpy operations for the whole slice.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._bytes import SLICE, mix, running, slices, span_hashes, utf8, words
from graphloom.plans.stash import stash

#: Cells of a published fingerprint, a multiple of three (it tells some 16 differing pieces from the strings alone).
CELLS = 24
#: One word in so many ends a piece, and a piece has at most so many words.
PIECE, LONGEST = 4, 8
#: Words above so many bytes are cut themselves: where one in 16 runs of 8 bytes says so, at the latest after 256 bytes.
LONG, RUN, LONG_PIECE, LONG_MOST = 64, 8, 16, 256

_SEEDS = [np.uint64(0x2545F4914F6CDD1D * (2 * j + 1) % (1 << 64)) for j in range(4)]
_LENGTH = np.uint64(0xFFFF)


def _cut_long(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the long ones cut into several."""
    long = np.flatnonzero(ends - starts > LONG)
    if not len(long):
        return starts, ends, first
    cuts = []
    for lo, hi in zip(starts[long], ends[long]):
        at = np.arange(lo + RUN, hi)
        chosen = at[span_hashes(total, at - RUN, at) % np.uint64(LONG_PIECE) == 0]
        edges = np.concatenate([[lo], chosen, [hi]])
        more = [np.arange(a, b, LONG_MOST)[1:] for a, b in zip(edges[:-1], edges[1:]) if b - a > LONG_MOST]
        cuts += [chosen, *more]
    cuts = np.sort(np.concatenate(cuts))
    firsts = first + np.searchsorted(cuts, np.append(starts, ends[-1:] + 1)[first])
    return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts])), firsts


def digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all texts, and of each text the index of its first (len+1).

    A piece ends after a word whose hash says so, at the last word of a line,
    after ``LONGEST`` words, and with the text.  The k-th copy of a piece in a
    text has a digest of its own, so a text's digests are a set.
    """
    data, off = utf8(column)
    starts, ends, first = words(data, off)
    total = running(data)
    starts, ends, first = _cut_long(starts, ends, first, total)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    stop = span_hashes(total, starts, ends) % np.uint64(PIECE) == 0
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    stop[first[1:][first[1:] > 0] - 1] = True
    # words since the last stop; after every LONGEST of them there is one more
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(np.concatenate([[True], stop[:-1]]), place, 0))
    stop |= (place - last) % LONGEST == LONGEST - 1
    end = np.flatnonzero(stop)
    begin = np.concatenate([[0], end[:-1] + 1])
    h = span_hashes(total, starts[begin], ends[end])
    length = np.minimum(ends[end] - starts[begin], int(_LENGTH)).astype(np.uint64)
    of = np.searchsorted(begin, first)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    order = np.lexsort((h, text))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    at = np.arange(len(h))
    copy = np.empty(len(h), np.uint64)
    copy[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    out = mix(h + copy * _SEEDS[3]) & ~_LENGTH | length
    return out, of


def _cells(keys: np.ndarray, owner: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The three cells of each digest among ``size`` of its owner."""
    third = np.uint64(size // 3)
    for j in range(3):
        yield owner * size + j * (size // 3) + (mix(keys ^ _SEEDS[j]) % third).astype(np.int64)


def sketch(keys: np.ndarray, owner: np.ndarray, owners: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum of digests and sum of their checks (modulo 2^64) of each cell of each owner."""
    count, total, check = np.zeros(owners * size, np.int64), np.zeros(owners * size, np.uint64), np.zeros(owners * size, np.uint64)
    checks = mix(keys + _SEEDS[3])
    for at in _cells(keys, owner, size):
        np.add.at(count, at, 1)
        np.add.at(total, at, keys)
        np.add.at(check, at, checks)
    return count, total, check


def peel(cells: tuple[np.ndarray, np.ndarray, np.ndarray], owners: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests recovered from subtracted cells: owner, digest, side (1 or -1), and of each owner whether nothing is left."""
    count, total, check = (c.copy() for c in cells)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        side = count[look]
        key = np.where(side > 0, total[look], np.uint64(0) - total[look])
        sure = np.where(side > 0, check[look], np.uint64(0) - check[look]) == mix(key + _SEEDS[3])
        look, side, key = look[sure], side[sure], key[sure]
        owner = look // size
        order = np.lexsort((key, owner))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        order = order[new]
        owner, key, side = owner[order], key[order], side[order]
        if not len(key):
            break
        found.append((owner, key, side))
        touched = []
        checks = mix(key + _SEEDS[3])
        plus = side > 0
        for at in _cells(key, owner, size):
            np.subtract.at(count, at, side)
            np.subtract.at(total, at, np.where(plus, key, np.uint64(0) - key))
            np.subtract.at(check, at, np.where(plus, checks, np.uint64(0) - checks))
            touched.append(at)
        look = np.concatenate(touched)  # a cell may come twice; its digest counts once
        look = look[np.abs(count[look]) == 1]
    left = ((count != 0) | (total != 0) | (check != 0)).reshape(owners, size).any(axis=1)
    owner, key, side = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return owner, key, side, ~left


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of only one of two texts, for all pairs of texts: pair, digest, side (1: only the first's).

    Pairs that do not come out are tried again with twice the cells.
    """
    todo = np.arange(len(a[1]) - 1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    while len(todo):
        cells = None
        for keys, off in (a, b):
            n = np.diff(off)[todo]
            owner = np.repeat(np.arange(len(todo)), n)
            at = np.repeat(off[todo] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(owner))
            own = sketch(keys[at], owner, len(todo), size)
            cells = own if cells is None else tuple(x - y for x, y in zip(cells, own))
        owner, key, side, done = peel(cells, len(todo), size)
        kept = done[owner]
        out.append((todo[owner[kept]], key[kept], side[kept]))
        todo, size = todo[~done], size * 2
    return tuple(np.concatenate(x) for x in zip(*out))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share (0 to 1) of two texts' pieces, by length, that both have; 1 for two texts without pieces."""
    n = len(a[1]) - 1
    size = lambda d: np.bincount(np.repeat(np.arange(n), np.diff(d[1])), (d[0] & _LENGTH).astype(float), n)
    pair, key, _ = differing(a, b)
    apart = np.bincount(pair, (key & _LENGTH).astype(float), n)
    whole = size(a) + size(b)
    return np.where(whole > 0, 1 - apart / np.maximum(whole, 1), 1.0)


def written(d: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> list[str]:
    """Each text's fingerprint: pieces, their length, and the cells in base 64."""
    n = len(d[1]) - 1
    owner = np.repeat(np.arange(n), np.diff(d[1]))
    length = np.bincount(owner, (d[0] & _LENGTH).astype(float), n).astype(np.int64)
    count, total, check = sketch(d[0], owner, n, cells)
    row = np.zeros(n * cells, [("count", "<i4"), ("total", "<u8"), ("check", "<u4")])
    row["count"], row["total"], row["check"] = count, total, check & np.uint64(0xFFFFFFFF)
    step = cells * row.itemsize
    raw = row.tobytes()
    return [f"{k}:{size}:{base64.b64encode(raw[i * step : (i + 1) * step]).decode()}" for i, (k, size) in enumerate(zip(np.diff(d[1]), length))]


def edited(text: str, following: str) -> str:
    """``text`` whose last half is replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compared(ids: list, own: list[str], following: list[str]) -> pa.RecordBatch:
    """Results of texts, given the text that follows each."""
    new = [edited(t, f) for t, f in zip(own, following)]
    a, b, c = (digests(pa.array(x, pa.large_string())) for x in (own, new, following))
    columns = [ids, [len(t) for t in own], [hashlib.sha256(t.encode()).hexdigest() for t in new], written(a), written(b), likeness(a, b), likeness(a, c)]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _FIELDS)], schema=_FIELDS)


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` compressed, null as empty; all other columns as they are."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        small = pa.array([pack((t or "").encode()) for t in batch.column(at).to_pylist()], pa.binary())
        yield batch.set_column(at, pa.field("text", pa.binary()), small)


def _sliced(batch: pa.RecordBatch, *columns: str) -> Iterator[list[list]]:
    """The ids and the texts of some MB of rows at a time."""
    size = np.diff(np.frombuffer(batch.column(columns[0]).cast(pa.large_binary()).buffers()[1], np.int64)[: batch.num_rows + 1]) if batch.num_rows else np.zeros(0, np.int64)
    unpack = zstandard.ZstdDecompressor().decompress
    for lo, hi in slices(np.concatenate([[0], np.cumsum(size)]), SLICE // 2):
        part = batch.slice(lo, hi - lo)
        yield [part.column("doc_id").to_pylist(), *[[unpack(t).decode() for t in part.column(c).to_pylist()] for c in columns]]


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results along one sorted range; its first and last rows go on with their texts (edge 1 and 2), for the ranges beside it."""
    schema = _FIELDS.append(pa.field("edge", pa.int32())).append(pa.field("text", pa.binary())).append(pa.field("part", pa.int32()))
    pack = zstandard.ZstdCompressor(level=1).compress

    def border(edge: int, doc_id, text: str, part: int) -> pa.RecordBatch:
        row = {"doc_id": doc_id, "edge": edge, "text": pack(text.encode()), "part": part}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        for ids, texts in _sliced(batch, "text"):
            if held is None:
                yield border(1, ids[0], texts[0], part)
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1], part)
            if len(ids) > 1:
                done = _compared(ids[:-1], texts[:-1], texts[1:])
                n = done.num_rows
                yield pa.RecordBatch.from_arrays([*done.columns, pa.array([0] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([part] * n, pa.int32())], schema=schema)
    if held is not None:
        yield border(2, *held)


def _at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, own, following in _sliced(batch, "text", "following"):
            yield _compared(ids, own, following)


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of ``documents(doc_id, text)`` and of their edited texts (see ``op12_fingerprints``).

    Documents are sorted in ranges by falling id, and each task walks along its
    range with two texts at hand; texts travel compressed.  What one range's last document needs is the
    next range's first: those few come back with their texts and meet in a join.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), (F.monotonically_increasing_id() % 997).alias("_tie"))
    order = [F.desc_nulls_last("doc_id"), F.asc("_hash"), F.asc("_tie")]
    small = rows.mapInArrow(_zipped, "doc_id long, text binary, _hash long, _tie long")
    ranged = small.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    along = stash(ranged.mapInArrow(_along, f"{RESULT}, edge int, text binary, part int"), "fingerprints")
    # ranges that hold documents: one number each
    parts = sorted(r["part"] for r in along.where("edge = 1").select("part").collect())
    after = dict(zip(parts, [*parts[1:], *parts[:1]]))
    following = along.where("edge = 1").select(F.col("part").alias("_after"), F.col("text").alias("following"))
    last = along.where("edge = 2").select("doc_id", "text", F.element_at(F.create_map(*[F.lit(x) for p in after.items() for x in p]), F.col("part")).alias("_after") if parts else F.lit(0).alias("_after"))
    met = last.join(following, "_after").select("doc_id", "text", "following")
    names = _FIELDS.names
    return along.where("edge = 0").select(*names).unionByName(met.mapInArrow(_at_borders, RESULT))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its fingerprint and its edited text's, and what they share.

    Null texts are empty.  An empty text, or one of white space, has no pieces:
    its likeness to another such text is 1, to all others 0.  Documents follow each other by falling id, null ids
    last, rows of one id by their text; repeated rows follow themselves, and a
    single document too.  A very long text is a slice of its own.  No documents: no rows.  Other columns are not
    looked at.  ``near_edited`` and ``near_next`` are the length-weighted share of pieces that both texts have.
    """
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
