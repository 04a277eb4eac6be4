"""N-gram Jaccard join by prefix trees.

Documents become sets of word n-grams, globally ordered from rare to common.
Two sets that are similar enough share an n-gram among the first few of each
(their prefixes).  Sets that share one meet in units named by the smallest of
them; in a unit the sets are stored in a trie and joined by one traversal for
each set, in which sets with a common beginning share the work and subtrees are
cut as soon as what remains cannot reach the required overlap.

Rows of equal sets are one class throughout: thousands of copies cost one set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _bytes as B
from graphloom.operators.components import connected_components
from graphloom.plans.stash import stash

N, PERCENT = 5, 80
#: Counters of the frequency sketch: its size is fixed, whatever the corpus.
SLOTS = 1 << 19
CHUNK = 1 << 13
#: Prefix n-grams that a task holds before it sends them.
HELD = 2_000_000
#: A list of more sets than this is dealt by sizes.
LONG = 256
#: A unit with more n-grams than this is joined block by block.
BLOCK_NGRAMS = 4_000_000


def _per_document(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The n-gram hashes of each text, sorted and distinct."""
    data = B.LOWER[data]
    starts, ends, first = B.words(data, off)
    w = B.span_hashes(B.running(data), starts, ends)
    grams = B.chained(w, N)
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= N:
            yield np.unique(grams[a : b - N + 1])
        else:
            yield B.chained(w[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each set's hashes, as signed integers."""
    one = np.array([int(h.sum(dtype=np.uint64)) for h in sets], np.uint64)
    two = np.array([int(B.mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) for h in sets], np.uint64)
    return B.mix(one + two).view(np.int64), two.view(np.int64)


def _shapes(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, sig1, sig2)`` of every document."""
    names = ["doc_id", "text_hash", "n_shingles", "sig1", "sig2"]
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in B.parts(batch.column("text")):
                sets = list(_per_document(data, off))
                n = pa.array([len(h) for h in sets], pa.int64())
                own = [batch.column(c)[lo:hi] for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, n, *map(pa.array, _signatures(sets))], names)

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, sig1 long, sig2 long")


def _sketch(docs: DataFrame) -> np.ndarray:
    """How many of the texts have an n-gram of each slot: a table of fixed size.

    Each task adds up its own texts and hands over one row for each chunk of the
    table, so neither the shuffle nor what the driver holds grows with the
    number of documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, off in B.parts(batch.column("text")):
                h = np.concatenate(list(_per_document(data, off)))
                total += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        rows = [total[i : i + CHUNK].astype("<u4").tobytes() for i in range(0, SLOTS, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows)], ["chunk", "n"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for n in table.column("n"):
            total += np.frombuffer(n.as_buffer(), "<u4")
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": [total.astype("<i8").tobytes()]})

    parts = docs.select("text").mapInArrow(count, "chunk int, n binary").groupBy("chunk").applyInArrow(add, "chunk int, n binary")
    total = np.zeros(SLOTS, np.int64)
    for r in parts.collect():  # SLOTS counters
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["n"], "<i8")
    return np.minimum(total // max(1, int(total.max()) >> 16), (1 << 16) - 1).astype(np.uint16)


def _prefix(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The n-grams of a sorted set that a similar one must share one of: rare slots first, ties by hash."""
    order = np.argsort(rank[(h % np.uint64(SLOTS)).astype(np.int64)], kind="stable")
    return h[order[: len(h) - (PERCENT * len(h) + 99) // 100 + 1]]


def _prefixes(docs: DataFrame, rank: np.ndarray, buckets: int) -> DataFrame:
    """The prefixes of all texts, dealt by a hash of the n-gram and packed: one row for each task and bucket.

    ``grams`` and ``places`` (in the prefix) stand set after set; ``owner``,
    ``size`` and ``held`` tell each set's signature, its n-grams and how many of
    them the bucket gets.  Equal sets are sent once a task.
    """
    names = ["bucket", "grams", "places", "owner", "size", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, int, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            length = [len(p) for _, _, p in held]
            g = np.concatenate([p for _, _, p in held])
            own = np.repeat(np.arange(len(held)), length)
            place = np.concatenate([np.arange(n, dtype="<u4") for n in length])
            sig, size = np.array([s for s, _, _ in held], "<i8"), np.array([n for _, n, _ in held], "<u4")
            to = (g >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            g, own, place, to = g[order].astype("<u4"), own[order], place[order], to[order]
            cut = np.searchsorted(to, np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cut)):
                at = slice(cut[k], cut[k + 1])
                start = np.flatnonzero(np.diff(own[at], prepend=-1))
                who = own[at][start]
                count = np.diff(np.append(start, cut[k + 1] - cut[k])).astype("<u4")
                rows.append((k, *[x.tobytes() for x in (g[at], place[at], sig[who], size[who], count)]))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows, strict=True))], names)

        for batch in batches:
            for _, _, data, off in B.parts(batch.column("text")):
                sets = [h for h in _per_document(data, off) if len(h)]
                for h, sig in zip(sets, _signatures(sets)[0].tolist(), strict=True):
                    if sig not in seen:
                        seen.add(sig)
                        held.append((sig, len(h), _prefix(h, rank)))
                        total += len(held[-1][2])
                if total > HELD:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in names[1:]))


def _possible(n: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each member of a list sorted by size: whether another one's size is in its reach, and the other way round.

    ``reach``: the largest set that can be similar if this n-gram is the first
    common one, given how many n-grams come after it.
    """
    if len(n) == 2:
        return np.full(2, n[1] <= reach[0] and n[0] <= reach[1])
    end = np.searchsorted(n, reach, "right")  # all before are small enough; one of them must reach up to n
    best = np.maximum.accumulate(reach)
    upto = np.where(end > 0, best[np.maximum(end, 1) - 1], -1)
    # the largest reach may be the member's own: then the second largest decides
    second = np.full(len(n), -1)
    for i in range(1, len(n)):
        second[i] = max(second[i - 1], min(reach[i], best[i - 1]))
    own = (np.arange(len(n)) < end) & (reach == upto)
    upto = np.where(own, np.where(end > 0, second[np.maximum(end, 1) - 1], -1), upto)
    return upto >= n


def _meetings(own: np.ndarray, n: np.ndarray, gram: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of lists of a shared n-gram: ``(centre, member, size)``, distinct.

    A list is sorted by size and cut where no two sets across the cut can be
    similar; members that none of the others can be similar to go.  Long lists
    are dealt into windows of two neighbouring classes of sizes, in one of which
    any two similar sets meet.  The centre is the smallest signature.
    """
    none = np.zeros(0, np.int64)
    order = np.lexsort((place, own, n, gram))
    own, n, gram, place = own[order], n[order], gram[order], place[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
    own, n, gram, place = own[fresh], n[fresh], gram[fresh], place[fresh]

    def lists(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, len(new)))

    def starts() -> np.ndarray:
        new = np.ones(len(own), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (n[:-1] * 100 < n[1:] * PERCENT)
        return new

    first, count = lists(starts())
    several = np.repeat(count > 1, count)
    own, n, gram, place = own[several], n[several], gram[several], place[several]
    if not len(own):
        return none, none, none
    reach = (n - place) * (100 + PERCENT) // PERCENT - n
    keep = np.zeros(len(own), bool)
    for a, c in zip(*map(np.ndarray.tolist, lists(starts())), strict=True):
        keep[a : a + c] = _possible(n[a : a + c], reach[a : a + c])
    own, n, gram, place = own[keep], n[keep], gram[keep], place[keep]
    if not len(own):
        return none, none, none
    new = starts()
    first, count = lists(new)
    number = np.repeat(np.arange(len(first)), count)
    long = np.repeat(count > LONG, count)
    size_class = np.where(long, np.floor(np.log(n) / np.log(100 / (PERCENT - 1))).astype(np.int64), 0)
    at = np.concatenate([np.arange(len(own)), np.flatnonzero(long)])
    window = np.concatenate([size_class, size_class[long] - 1])
    order = np.lexsort((window, number[at]))
    at, window = at[order], window[order]
    new = np.ones(len(at), bool)
    new[1:] = (number[at][1:] != number[at][:-1]) | (window[1:] != window[:-1])
    first, count = lists(new)
    own, n = own[at], n[at]
    centre = np.repeat(np.minimum.reduceat(own, first), count)
    met = np.repeat(count > 1, count)
    pair, where = np.unique(np.stack([centre[met], own[met]], 1), axis=0, return_index=True)
    return pair[:, 0], pair[:, 1], n[met][where]


def _units(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """``(centre, node, n)``: sets that share a prefix n-gram are together in at least one centre's unit."""
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
        held = read("held", "<u4")
        own, n = np.repeat(read("owner", "<i8"), held), np.repeat(read("size", "<u4").astype(np.int64), held)
        found = _meetings(own, n, read("grams", "<u4"), read("places", "<u4").astype(np.int64))
        return pa.table(dict(zip(("centre", "node", "n"), map(pa.array, found), strict=True)))

    met = _prefixes(docs, rank, buckets).groupBy("bucket").applyInArrow(meet, "centre long, node long, n long")
    return met.groupBy("centre", "node").agg(F.max("n").alias("n"))


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


class _Trie:
    """A prefix tree over different sets that are sorted as sequences.

    Its nodes are ranges of sets, found from the common prefixes of neighbours
    with a stack, so its depth is not bounded by recursion; a chain without
    branches is one node, whose n-grams are a view of its first set.
    """

    def __init__(self, sets: list[np.ndarray]):
        size = [len(s) for s in sets]
        common = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            m = min(size[i - 1], size[i])
            differ = np.flatnonzero(sets[i - 1][:m] != sets[i][:m])
            common[i] = differ[0] if len(differ) else m
        sizes = np.array(size)
        self.low: list[int] = []
        self.high: list[int] = []
        self.run: list[np.ndarray] = []
        self.least: list[int] = []  # n-grams of the shortest set below
        self.rest: list[int] = []  # n-grams below this node at most
        self.leaves: list[int] = []  # the sets low..low + leaves - 1 end here
        self.children: list[list[int]] = []
        todo = [(0, len(sets), 0, -1)]
        while todo:
            low, high, depth, parent = todo.pop()
            if parent >= 0:
                self.children[parent].append(len(self.low))
            stop = int(common[low + 1 : high].min()) if high - low > 1 else size[low]
            stop = min(stop, size[low])
            leaf = low
            while leaf < high and size[leaf] == stop:
                leaf += 1
            self.low.append(low)
            self.high.append(high)
            self.run.append(sets[low][depth:stop])
            self.least.append(int(sizes[low:high].min()))
            self.rest.append(int(sizes[low:high].max()) - stop)
            self.leaves.append(leaf - low)
            self.children.append([])
            if leaf < high:
                cut = [leaf, *(np.flatnonzero(common[leaf + 1 : high] == stop) + leaf + 1).tolist(), high]
                todo += [(a, b, stop, len(self.low) - 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]


#: Traversals after which a trie's ranges are looked at anew for those that are one component.
REFRESH = 64


def trie_links(sets: list[np.ndarray], labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (pairs of positions) whose components are those of all pairs similar enough.

    Sets are inserted common n-grams first, so that similar sets share long
    paths.  Each set then walks the trie of those before it with its overlap so
    far; a subtree is left if even all of its remaining n-grams, or of the
    walker's, are too few for 100 |x & y| >= PERCENT |x | y|, or if all its sets
    are in the walker's component already.  ``labels``: if given, sets of the
    same label are in one component from the start.
    """
    links: list[tuple[int, int]] = []
    if len(sets) < 2:
        return links
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(every), np.int64)
    place[np.lexsort((every, -counts))] = np.arange(len(every))
    ordered = [np.sort(x) for x in np.split(place[inverse.reshape(-1)], np.cumsum([len(s) for s in sets])[:-1])]
    turn = sorted(range(len(sets)), key=lambda i: ordered[i].astype(">u4").tobytes())
    ordered = [ordered[i] for i in turn]
    several = int((counts > 1).sum())  # from this place on, n-grams of one set only
    forest = _Forest(len(sets))
    if labels is not None:
        first: dict[int, int] = {}
        for x, i in enumerate(turn):
            forest.up[x] = first.setdefault(labels[i], x)
    trie = _Trie(ordered)
    mask = np.zeros(len(every), bool)
    roots, changes, stale = [], np.zeros(0), True
    for x, own in enumerate(ordered):
        size = len(own)
        if np.searchsorted(own, several) * 100 < PERCENT * size:
            continue
        if stale and x % REFRESH == 0 or not len(roots):
            roots = [forest.root(i) for i in range(len(sets))]
            changes, stale = np.cumsum(np.diff(roots, prepend=roots[0]) != 0).tolist(), False
        mask[own] = True
        me = forest.root(x)
        stack = [(0, 0, size)]
        while stack:
            node, overlap, left = stack.pop()
            low, high = trie.low[node], min(trie.high[node], x)
            if low >= x or changes[low] == changes[high - 1] and forest.root(low) == me:
                continue
            shared = int(np.count_nonzero(mask[trie.run[node]]))
            overlap, left = overlap + shared, left - shared
            # |x & y| >= PERCENT (|x| + |y|) / (100 + PERCENT)
            if (overlap + min(left, trie.rest[node])) * (100 + PERCENT) < PERCENT * (size + trie.least[node]):
                continue
            for y in range(low, min(low + trie.leaves[node], x)):
                if overlap * (100 + PERCENT) >= PERCENT * (size + len(ordered[y])) and forest.root(y) != me:
                    forest.up[forest.root(y)] = me
                    links.append((turn[x], turn[y]))
                    stale = True
            stack += [(c, overlap, left) for c in trie.children[node]]
        mask[own] = False
    return links


def by_key(key: str, work: Callable[[list[dict]], list[tuple]], names: list[str], kinds: list[pa.DataType]) -> Callable:
    """For ``mapInArrow`` on rows sorted by ``key``: ``work`` on the rows of each key, one key in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            columns = list(zip(*work(rows), strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        held: list[dict] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in batch.slice(i, 256).to_pylist():
                    if held and held[0][key] != row[key]:
                        yield out(held)
                        held = []
                    held.append(row)
        if held:
            yield out(held)

    return run


def _join_unit(rows: list[dict]) -> list[tuple[int, int]]:
    rows = list({r["node"]: r for r in rows}.values())
    labels = [r["label"] for r in rows] if rows[0]["label"] is not None else None
    return [(rows[x]["node"], rows[y]["node"]) for x, y in trie_links([np.frombuffer(r["grams"], np.uint64) for r in rows], labels)]


def _joined(docs: DataFrame, members: DataFrame, every: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` inside the units of ``members(unit, node, label)``; texts are found by their rows in ``every``."""
    wanted = members.groupBy("node").agg(F.collect_list(F.struct("unit", "label")).alias("units"))
    wanted = wanted.join(every.select(F.col("sig1").alias("node"), F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")), "node")
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(wanted, (F.col("text_hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("node", "units", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in B.parts(batch.column("text")):
                units = batch.column("units")[lo:hi]
                grams = [h.tobytes() for h in _per_document(data, off)]
                at = np.repeat(np.arange(hi - lo), pc.list_value_length(units))
                flat = units.flatten()
                columns = [flat.field(0), flat.field(1), batch.column("node")[lo:hi].take(pa.array(at)), pa.array([grams[i] for i in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["unit", "label", "node", "grams"])

    rows = texts.mapInArrow(sets, "unit long, label long, node long, grams binary")
    rows = rows.repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(by_key("unit", _join_unit, ["src", "dst"], [pa.int64(), pa.int64()]), "src long, dst long")


def _links(docs: DataFrame, units: DataFrame, every: DataFrame) -> DataFrame:
    """Links inside the units ``(centre, node, n)`` (a stashed table).

    A unit of more than ``BLOCK_NGRAMS`` n-grams is cut into blocks, its centre
    standing in each, and first the blocks are joined by themselves.  Sets that
    are in the centre's component by then need not meet each other again; the
    others meet all sets of the unit, block by block.
    """
    weight = units.groupBy("centre").agg(F.ceil(F.sum("n") / BLOCK_NGRAMS).cast("int").alias("blocks")).where("blocks > 1")
    weight = stash(weight, "large")
    own = units.join(weight, "centre", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    block = F.explode(F.when(F.col("node") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(mine))
    first = own.withColumn("block", block).select(F.xxhash64("centre", "block").alias("unit"), "node", F.lit(None).cast("long").alias("label"))
    links = stash(_joined(docs, first, every), "links")
    if not weight.take(1):
        return links
    label = connected_components(links).withColumnRenamed("component", "label")
    named = units.join(weight.drop("blocks"), "centre").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    centre = label.select(F.col("node").alias("centre"), F.col("label").alias("of_centre"))
    named = named.join(centre, "centre", "left").withColumn("rest", F.col("label") != F.coalesce("of_centre", "centre"))
    named = stash(named.select("centre", "node", "n", "label", "rest"), "rest")
    cuts = named.groupBy("centre").agg(F.ceil(F.sum("n") / BLOCK_NGRAMS).cast("int").alias("all"), F.ceil(F.sum(F.when(F.col("rest"), F.col("n"))) / BLOCK_NGRAMS).cast("int").alias("others"))
    named = named.join(cuts.where("others > 0"), "centre")
    spread = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    whole = named.withColumn("a", spread(1, "all")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    rest = named.where("rest").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).withColumn("b", spread(2, "others"))
    again = whole.unionByName(rest).select(F.xxhash64("centre", "a", "b").alias("unit"), "node", "label").distinct()
    return links.unionAll(stash(_joined(docs, stash(again, "again"), every), "links"))


#: The columns that tell one set from another.
KEY = ["n_shingles", "sig1", "sig2"]


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(shaped, ends)``: every row's shape, and ``(*KEY, doc_id, text_hash, group, component_id)`` of every set that is not empty.

    ``doc_id`` and ``text_hash`` name the smallest row of a set (null ids last);
    a set is known by its first signature throughout, never by an id, which may
    be null or stand in rows of different texts.
    """
    docs = docs.select("doc_id", "text")
    shaped = stash(_shapes(docs), "shapes")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    every = shaped.where("n_shingles > 0").groupBy(*KEY).agg(F.min(row).alias("r")).select(*KEY, "r.no_id", "r.doc_id", "r.text_hash")
    every = stash(every, "every")
    units = stash(_units(docs, _sketch(docs)), "units")
    links = _links(docs, units, every)
    found = connected_components(links).select(F.col("node").alias("sig1"), F.col("component").alias("group"))
    found = stash(found.join(every.select("sig1", "doc_id"), "sig1"), "found")
    names = found.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    ends = every.join(found.join(names, "group").select("sig1", "group", "component_id"), "sig1", "left")
    ends = ends.select(*KEY, "no_id", "doc_id", "text_hash", F.coalesce("group", "sig1").alias("group"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return shaped, ends


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs(doc_id, text, ...)``.

    A text without words (null, empty) has the empty set and is linked with
    nothing; with fewer words than the n-gram length its whole sequence is one
    n-gram.  Rows with equal sets belong together; a repeated row is returned as
    often as it stands there.  Rows of one id with different texts, and rows
    without an id, are linked each by its own text; a component is named by its
    smallest id, by null if none of its rows has one.  An empty table gives an
    empty result.

    1. Equal sets (by size and two 64-bit sums of hashes) become one class.
    2. A sketch of fixed size counts the n-grams of all texts: the global order.
    3. Each task sends the prefixes of its sets to buckets of n-grams.  In the
       list of an n-gram only those sets stay that another one can be similar
       to by sizes and by the n-grams left after it; the list goes into the unit
       of its smallest set, so near copies, which share most of their prefixes,
       meet in one unit and not once for each n-gram.
    4. Each unit is joined by a trie; units beyond ``BLOCK_NGRAMS`` n-grams are
       cut into blocks (see :func:`_links`), so memory is bounded.
    """
    shaped, ends = _classes(docs)
    out = shaped.join(ends.select(*KEY, "component_id"), KEY, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group that :func:`jaccard_components` finds exactly one row.

    It is the row with the smallest id (a row without an id only if no other has
    one); of rows with that id and different texts or repeats a single one.
    Rows whose set is empty are in no group, and all of them stay.
    """
    shaped, ends = _classes(docs)
    row = F.struct("no_id", "doc_id", "text_hash")
    first = ends.groupBy("group").agg(F.min(row).alias("r")).select("r.doc_id", "r.text_hash", F.lit(True).alias("one"))
    empty = shaped.where("n_shingles = 0").select("doc_id", "text_hash", F.lit(False).alias("one")).distinct()
    stay = first.unionByName(empty)
    # the whole input row is one column, so that no name of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("of_id"), F.xxhash64("text").alias("of_hash"))
    kept = rows.join(stay, F.col("of_hash").eqNullSafe(F.col("text_hash")) & F.col("of_id").eqNullSafe(F.col("doc_id")))
    if not _repeats(shaped):
        return kept.select("row.*")
    single = kept.where("one").groupBy("of_id", "of_hash").agg(F.min_by("row", F.xxhash64(F.col("row").cast("string"))).alias("row"))
    return single.select("row.*").unionByName(kept.where("not one").select("row.*"))


def _repeats(shaped: DataFrame) -> bool:
    """Whether any id stands in two rows of the same text."""
    return bool(shaped.groupBy("doc_id", "text_hash").count().where("count > 1").take(1))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by counting common shingles of all pairs that have one.
OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y),
e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (
  WITH RECURSIVE r(node, root) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.root FROM r JOIN b ON r.node = b.x WHERE r.root < b.y)
  SELECT * FROM r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""
