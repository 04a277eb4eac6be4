"""Best-fit packing of tokenised documents with Martello-Toth dominance reduction.

Every length lies between 1 and the capacity, so the instance is fully
described by one count per length.  That histogram (at most ``capacity`` rows,
whatever the corpus) is reduced and packed on the driver into patterns with
multiplicities; documents then find their places by their rank among the
pieces of equal length, which Spark computes in two steps without ordering
any length as a whole.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._bytes import slices, utf8
from graphloom.plans.stash import stash

CAPACITY = 2048
#: The tokenizer, and the same vocabulary as ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END = b"\0\0\0\0"
#: Pretokens a worker remembers.
REMEMBERED = 300_000
#: Letters, numbers and white space of the vocabulary's split pattern below U+0250.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_SPLIT = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Texts that need the tokenizer's own splitting: characters beyond those classes, and its special token.
_RARE = re.compile("[\x1c-\x1fɐ-\U0010ffff]|<\\|endoftext\\|>")


class Encoder(dict):
    """Token ids of a text as little-endian 32-bit bytes, remembering pretokens.

    Pretokens go to the same vocabulary's rank file, whose library encodes a
    single one four times as fast; texts with characters that the quick split
    does not know go to the tokenizer as a whole.
    """

    def __init__(self, vocabulary: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as f:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pretoken = tiktoken.Encoding("pretokens", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = out = np.array(self.pretoken(piece), "<u4").tobytes()
        return out

    def ids(self, text: str) -> bytes:
        if _RARE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _SPLIT.findall(text)))


_encoders: dict[str, Encoder] = {}


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS, keep_ids: bool = False) -> DataFrame:
    """Tokenise and cut: ``(doc_id, piece, start, length, ids_crc32)`` and, if asked, ``ids``.

    Null text counts as empty.  A document is its token ids and id 0; one longer
    than ``capacity`` is cut into full pieces, the first being the remainder.
    ``vocabulary`` and ``ranks`` name a public tokenizer's files, looked up on the executors.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _vocabulary(vocabulary)
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path, _vocabulary(ranks)))
        for batch in batches:
            texts, (_, off) = batch.column("text"), utf8(batch.column("text"))
            for lo, hi in slices(off):
                rows: list[tuple] = []
                for doc, text in zip(batch.column("doc_id")[lo:hi].to_pylist(), texts[lo:hi].to_pylist(), strict=True):
                    ids = encoder.ids(text or "") + END
                    n = len(ids) // 4
                    start, length = 0, (n - 1) % capacity + 1
                    for k in range((n + capacity - 1) // capacity):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, k, start, length, zlib.crc32(own), own)[: 5 + keep_ids])
                        start, length = start + length, capacity
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = list(zip(*rows, strict=True)) or [()] * (5 + keep_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names[: 5 + keep_ids])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def reduce_and_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Pack a histogram of lengths: ``[(sequences, [(length, how many in each), ...]), ...]``.

    Reduction, largest length j first, with r = capacity - j left beside it:
    {j} is fixed if nothing fits beside it; {j, k} with k the longest that fits
    is fixed if k fills r exactly, if no two others fit together, or if at most
    two others fit and no pair sums to more than k.  In each case every other
    feasible company of j could change places with k, so some optimum has that
    set.  Fixed sets leave the instance and the rules apply to what remains; a
    set is fixed as often as its lengths are there, so there are at most two
    steps for each length.  The remainder is packed best-fit, longest first; equal lengths move as one
    run, so the work depends on the capacity, not on the number of documents.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    lengths = sorted(left)
    plans: list[tuple[int, list[tuple[int, int]]]] = []

    def take(w: int, n: int) -> None:
        left[w] -= n
        if not left[w]:
            del left[w], lengths[bisect_left(lengths, w)]

    def smallest(n: int, without: int) -> list[int]:
        out: list[int] = []
        for w in lengths:
            out += [w] * min(n - len(out), left[w] - (w == without))
            if len(out) >= n:
                break
        return out

    j = capacity
    while (at := bisect_left(lengths, j + 1)) > 0:
        j = lengths[at - 1]
        r = capacity - j
        low = smallest(3, j)
        if not low or low[0] > r:
            plans.append((n := left[j], [(j, 1)]))
            take(j, n)
            continue
        k = lengths[bisect_left(lengths, r + 1) - 1]
        if k == j and left[j] == 1:
            below = bisect_left(lengths, j) - 1
            k = lengths[below]
        sure = k == r or len(low) < 2 or low[0] + low[1] > r
        if not sure and (len(low) < 3 or sum(low) > r):
            sure = _best_pair(lengths, left, j, r) <= k
        if not sure:
            j -= 1
            continue
        # what is left only gets less, so the rule holds until one of the two lengths is used up
        n = left[j] // 2 if k == j else min(left[j], left[k])
        plans.append((n, [(j, 2)] if k == j else [(j, 1), (k, 1)]))
        take(j, n)
        take(k, n)

    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, content: list[tuple[int, int]]) -> None:
        if n and room not in groups:
            insort(rooms, room)
        if n:
            groups.setdefault(room, []).append((n, content))

    for w in reversed(lengths):
        n = left[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                q = capacity // w
                put(capacity - q * w, n // q, [(w, q)])
                if n % q:
                    put(capacity - n % q * w, 1, [(w, n % q)])
                break
            room = rooms[at]
            many, content = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            q = room // w
            whole = min(many, n // q)
            put(room - q * w, whole, [*content, (w, q)])
            n -= whole * q
            if whole < many:
                put(room - n * w, int(n > 0), [*content, (w, n)])
                put(room, many - whole - int(n > 0), content)
                n = 0
    return plans + [g for own in groups.values() for g in own]


def _best_pair(lengths: list[int], left: dict[int, int], j: int, r: int) -> int:
    """The largest sum of two pieces beside j that fits into r."""
    best, a, b = 0, 0, bisect_left(lengths, r + 1) - 1
    while a <= b:
        x, y = lengths[a], lengths[b]
        if x + y > r:
            b -= 1
            continue
        if a < b or left[x] - (x == j) >= 2:
            best = max(best, x + y)
        a += 1
    return best


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces ``(doc_id, piece, length, ...)`` (a stashed table): adds ``sequence_id`` and ``offset``.

    Rank among equal lengths = pieces of that length in earlier hash buckets
    (from a count by length and bucket) + rank in the bucket, so no length, not
    even one shared by a third of all pieces, is ordered in one task.  Repeated
    rows are placed one by one.  An empty table gives an empty result.
    """
    spark = cut.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    b = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    held = b.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = held.withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for many, content in reduce_and_fit(counts, capacity):
        offset = 0
        for w, q in content:
            runs.append((w, used[w], used[w] + many * q, q, sequence, offset))
            used[w] += many * q
            offset += w * q
        sequence += many
    # a length's ranks are cut into as many steps as it has runs, so a piece meets the few runs of its step
    many = Counter(run[0] for run in runs)
    wide = {w: -(-n // many[w]) for w, n in counts.items()}
    runs = [(*run, step) for run in runs for step in range(run[1] // wide[run[0]], (run[2] - 1) // wide[run[0]] + 1)]
    # their number depends on the capacity alone
    runs = spark.createDataFrame(runs, "length long, _from long, _to long, _each long, _first long, _at long, _step long")
    base = base.join(F.broadcast(spark.createDataFrame(list(wide.items()), "length long, _wide long")), "length")
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    b = b.withColumn("_rank", F.row_number().over(order) - 1).join(base, ["length", "_bucket"])
    b = b.withColumn("_rank", F.col("_rank") + F.col("_base")).withColumn("_step", F.floor(F.col("_rank") / F.col("_wide")))
    b = b.join(F.broadcast(runs), ["length", "_step"]).where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    sequence_id = F.col("_first") + F.floor(nth / F.col("_each"))
    offset = F.col("_at") + nth % F.col("_each") * F.col("length")
    return b.select(*cut.columns, sequence_id.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(stash(pieces(docs), "pieces"))


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
