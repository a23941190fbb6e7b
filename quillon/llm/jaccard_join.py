"""N-gram Jaccard join by signature trees.

Exact, in three steps. (1) Texts with one shingle set are one class. (2) Under any total order of
shingles two sets that link share one among their first ``n - ceil(0.75 n) + 1``; ordered by a
corpus-wide count of hashed shingles, rare first, those prefixes cut the classes into small
groups. Within a group a hierarchy of nodes holds OR-combined bitmaps and size ranges of the sets
below; a dual traversal drops node pairs whose largest possible overlap is too small. (3) What is
left is compared set by set where it is found, and only links that join two components come out.
Groups of near copies would still cost all their pairs, so classes are first linked to a few
fellows of their groups, and node pairs that lie in one component already are dropped as well:
every link that could join two components is tried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, filter_bits, filter_size, passes, pick, small_batches, texts_of
from quillon.llm.graph import components

WORDS, PERCENT = 5, 75
#: Counters of hashed shingles: 4 MB, whatever the input. They only choose an order.
COUNTERS, SLICES = 1 << 20, 64
#: A bitmap has four times its set's size in bits, rounded up to a power of two within these.
FEWEST, MOST = 256, 1 << 17
#: Sets of one leaf, and the weight of members that one task compares: each weighs one, and one
#: more for each 1024 of its shingles.
LEAF, BLOCK = 32, 1_000
#: Fellows that each class is compared with at first, and rounds for those still apart.
FELLOWS, ROUNDS = 3, 4
ODD = np.uint64(0x9E3779B97F4A7C15)
SEED = 2024


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """The 64-bit hash of each word met, made once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word, SEED)
        return value


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word n-grams, A-Z lower-cased.

    A text of fewer words is one n-gram by itself; a text without words has none.
    """
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = list(map(len, split))
    known = _Hashes()
    word = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, sum(sizes))
    del split, known
    gram = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        gram = gram * ODD + word[k : k + len(gram)]
    gram = _mixed(gram)
    out, at = [], 0
    for size in sizes:
        if size >= words:
            found = np.sort(gram[at : at + size - words + 1])
            out.append(found[np.r_[True, found[1:] != found[:-1]]])
        elif size:
            whole = np.full(1, size, np.uint64)
            for k in range(size):
                whole = whole * ODD + word[at + k : at + k + 1]
            out.append(_mixed(whole))
        else:
            out.append(word[:0])
        at += size
    return out


def class_of(found: np.ndarray) -> int:
    """A set's 64-bit name: equal sets have one name."""
    if not len(found):
        return 0
    value = int(_mixed(found * ODD + np.uint64(1)).sum(dtype=np.uint64)) ^ len(found) * int(ODD)
    return value & (1 << 64) - 1


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _bitmap(found: np.ndarray) -> bytes:
    bits = min(MOST, max(FEWEST, 1 << (4 * len(found) - 1).bit_length())) if len(found) else FEWEST
    marks = np.zeros(bits, bool)
    marks[(found >> np.uint64(40)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(marks).tobytes()


def _folded(packed: bytes, size: int) -> bytes:
    """A bitmap brought to fewer bytes: bits that then coincide are OR-combined."""
    while len(packed) > size:
        half = len(packed) // 2
        packed = (int.from_bytes(packed[:half]) | int.from_bytes(packed[half:])).to_bytes(half)
    return packed


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes fall to each counter."""
    joined = np.concatenate([*sets, np.zeros(0, np.uint64)])
    return np.bincount((joined & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)


def _marks(words: int):
    """Rows (doc_id, n, cls, bits) of documents, and the partition's shingle counts in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, waiting = np.zeros(COUNTERS, np.int64), [], 0
        names = ["doc_id", "n", "cls", "bits", "slice", "counts"]
        for batch in batches:
            sets = shingle_sets(texts_of(batch.column(1)), words)
            held += sets
            waiting += sum(map(len, sets))
            if waiting > COUNTERS:
                counts += _counted(held)
                held, waiting = [], 0
            none = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(_signed([class_of(s) for s in sets])),
                    pa.array([_bitmap(s) for s in sets], pa.binary()),
                    pa.nulls(none, pa.int32()),
                    pa.nulls(none, pa.binary()),
                ],
                names,
            )
        counts = np.minimum(counts + _counted(held), 0xFFFFFFFF).astype(np.uint32)
        if counts.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.nulls(SLICES, pa.int64()) for _ in range(3)),
                    pa.nulls(SLICES, pa.binary()),
                    pa.array(range(SLICES), pa.int32()),
                    pa.array(parts, pa.binary()),
                ],
                names,
            )

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(part), np.uint32)
            sums[at] = sums.get(at, np.zeros(len(own), np.uint64)) + own
    if sums:
        wide = [np.minimum(x, np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(wide)], ["slice", "counts"])


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(order, words: int, percent: int):
    """Rows (key, cls): the first shingles of each set, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(order.value, np.uint32)
        for batch in batches:
            keys, owners = [], []
            done: set[int] = set()
            for found in shingle_sets(texts_of(batch.column(1)), words):
                own = class_of(found)
                if not len(found) or own in done:
                    continue
                done.add(own)
                # In rising order of the count, then of the hash.
                first = _prefix(len(found), percent)
                at = np.argsort(counts[(found & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")[:first]
                keys.append(found[at])
                owners.append(np.full(first, own, np.uint64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(keys))), pa.array(_signed(np.concatenate(owners)))],
                    ["key", "cls"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, cls): the distinct ones whose key has another class."""
    held: tuple[int, int] | None = None  # last row, not yet known to be shared
    out_of = None  # key known to be shared
    for batch in batches:
        key, cls = (batch.column(i).to_numpy() for i in range(2))
        if held is not None:
            key, cls = np.r_[held[0], key], np.r_[held[1], cls]
        if not len(key):
            continue
        fresh = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
        key, cls = key[fresh], cls[fresh]
        same = np.r_[key[1:] == key[:-1], False]
        keep = same | np.r_[False, same[:-1]]
        if out_of is not None:
            keep |= key == out_of
        held = (int(key[-1]), int(cls[-1]))
        out_of = held[0] if keep[-1] else None
        if keep[:-1].any():
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(cls[keep])], ["key", "cls"])
    if held is not None and out_of is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["key", "cls"]
        )


def _sets(wanted, words: int):
    """Rows (cls, n, found) of texts whose slot passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted.value, batch.column(1).to_numpy())))
            sets = shingle_sets(texts_of(batch.column(0)), words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_signed([class_of(s) for s in sets])),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_signed(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["cls", "n", "found"],
            )

    return run


class Nodes:
    """Sets, or nodes over sets, side by side.

    bits: OR of the bitmaps below; low, high: range of the sizes; spare: the most by which a set
    below has more shingles than bits; comp: the component of all below, where one is True.
    """

    def __init__(self, bits, low, high, spare, comp, one):
        self.bits, self.low, self.high, self.spare, self.comp, self.one = bits, low, high, spare, comp, one

    def __len__(self) -> int:
        return len(self.low)

    def above(self, fan: int) -> Nodes:
        """The level of nodes over fan of these each."""
        at = np.arange(0, len(self), fan)
        least, most = np.minimum.reduceat(self.comp, at), np.maximum.reduceat(self.comp, at)
        return Nodes(
            np.bitwise_or.reduceat(self.bits, at, axis=0),
            np.minimum.reduceat(self.low, at),
            np.maximum.reduceat(self.high, at),
            np.maximum.reduceat(self.spare, at),
            least,
            (least == most) & np.logical_and.reduceat(self.one, at),
        )


def possible(nodes: Nodes, i: np.ndarray, j: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether a set below i and one below j, of different components, may still link.

    What two sets share falls on bits that both nodes have, and on each of those bits a set has
    one shingle, but for its spare ones; that bounds the overlap for all sets below at once.
    """
    common = np.bitwise_count(nodes.bits[i] & nodes.bits[j]).sum(1, dtype=np.int64)
    top = common + np.minimum(nodes.spare[i], nodes.spare[j])
    top = np.minimum(top, np.minimum(nodes.high[i], nodes.high[j]))
    union = np.maximum(nodes.low[i], top) + np.maximum(nodes.low[j], top) - top
    together = nodes.one[i] & nodes.one[j] & (nodes.comp[i] == nodes.comp[j])
    return ~together & (top > 0) & (100 * top >= percent * union)


def tree_pairs(leaves: Nodes, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal: pairs of sets, given in an order that keeps likes together, that may link."""
    levels = [leaves]
    while len(levels[-1]) > LEAF:
        levels.append(levels[-1].above(LEAF if len(levels) == 1 else 8))
    top = len(levels[-1])
    i, j = np.triu_indices(top)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # Node pairs still to look at, deepest level last; a slice at a time bounds memory.
    open_ = [(len(levels) - 1, i, j)]
    while open_:
        level, i, j = open_.pop()
        if len(i) > 20_000:
            open_.append((level, i[20_000:], j[20_000:]))
            i, j = i[:20_000], j[:20_000]
        if level == 0:
            i, j = i[i < j], j[i < j]
        ok = possible(levels[level], i, j, percent)
        i, j = i[ok], j[ok]
        if level == 0:
            found.append((i, j))
        elif len(i):
            fan = LEAF if level == 1 else 8
            step = np.arange(fan)
            a = (i[:, None, None] * fan + step[None, :, None]).repeat(fan, 2).ravel()
            b = (j[:, None, None] * fan + step[None, None, :]).repeat(fan, 1).ravel()
            inside = (a < len(levels[level - 1])) & (b < len(levels[level - 1])) & (a <= b)
            open_.append((level - 1, a[inside], b[inside]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (i[:0], j[:0])


def _leaves(n: np.ndarray, comp: np.ndarray, packed: list[bytes]) -> Nodes:
    bits = np.frombuffer(b"".join(packed), np.uint64).reshape(len(n), -1)
    spare = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
    return Nodes(bits, n, n, spare, comp, np.ones(len(n), bool))


def _pairs_by_width(n, comp, packed: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that trees leave over. Sets that link have bitmaps of one width or of neighbouring
    ones, so each tree holds the sets of a width and, folded, those of the next."""
    width = np.array([len(b) for b in packed])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own in np.unique(width).tolist():
        among = np.flatnonzero((width == own) | (width == 2 * own))
        if len(among) > 1:
            leaves = _leaves(n[among], comp[among], [_folded(packed[k], own) for k in among.tolist()])
            i, j = (among[x] for x in tree_pairs(leaves, percent))
            here = (width[i] == own) | (width[j] == own)
            left.append(i[here])
            right.append(j[here])
    return np.concatenate(left), np.concatenate(right)


def _tried(percent: int):
    """(place, cls): the classes of a place that its blocks' signature trees leave in some pair.
    Rows are sorted by place; first come its classes (n, bits), then the members of its blocks
    (comp, half). At most one row for each class of a place, however many pairs it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, classes, blocks in _places(batches):
            sizes = {r[2]: (r[5], r[6]) for r in classes}
            left: set[int] = set()
            for cls, i, j, _ in _blocks(blocks, sizes, percent):
                left.update(cls[i].tolist(), cls[j].tolist())
            if left:
                rows = pa.array(sorted(left), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(rows), pa.int64()), rows], ["place", "cls"])

    return run


def _linked(percent: int):
    """(a, b): links between components, found by comparing the sets that the trees leave over.

    As _tried, with the sets in place of the bitmaps. Components that a link has joined are one
    for the rest of the place, so a place gives fewer links than it has classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, classes, blocks in _places(batches):
            sets = {r[2]: np.asarray(r[5], np.int64).view(np.uint64) for r in classes}
            sizes = {cls: (len(found), _bitmap(found)) for cls, found in sets.items()}
            above: dict[int, int] = {}
            out: list[tuple[int, int]] = []
            for cls, i, j, comp in _blocks(blocks, sizes, percent):
                out += _joining(cls, i, j, comp, sets, above, percent)
            if out:
                a, b = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], Iterator[tuple]]]:
    """(place, rows of its classes, rows of its blocks) of rows sorted by place, classes first."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for place, own in groupby(rows, key=itemgetter(0)):
        classes: list[tuple] = []
        first = None
        for first in own:
            if first[1] is not None:
                break
            classes.append(first)
        else:
            continue
        yield place, classes, chain([first], own)


def _blocks(rows: Iterator[tuple], sizes: dict, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(classes, i, j, components) of each block: the pairs (i, j) that its trees leave over. Blocks
    of the same members as one before at this place give nothing new and are left out."""
    done: set[bytes] = set()
    for _, part in groupby(rows, key=itemgetter(1)):
        members = sorted((r for r in part if r[2] in sizes), key=lambda r: (r[3], sizes[r[2]][0], r[2]))
        if len(members) < 2:
            continue
        cls = np.array([r[2] for r in members], np.int64)
        half = np.array([r[4] for r in members], np.int64)
        mark = xxhash.xxh3_128_digest(cls.tobytes() + half.tobytes())
        if mark in done:
            continue
        done.add(mark)
        comp = np.array([r[3] for r in members], np.int64)
        n, bits = (list(x) for x in zip(*(sizes[r[2]] for r in members), strict=True))
        i, j = _pairs_by_width(np.array(n, np.int64), comp, bits, percent)
        # In a block made of two shares of a group, pairs within a share belong to other blocks.
        keep = (half[i] != half[j]) | (half[i] < 0)
        if keep.any():
            yield cls, i[keep], j[keep], comp


def _joining(cls, i, j, comp, sets: dict, above: dict[int, int], percent: int) -> list[tuple[int, int]]:
    """The links among the pairs (i, j) that join two components; above: their union-find forest."""

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    used = np.unique(np.r_[i, j])
    own = [sets[c] for c in cls[used].tolist()]
    _, code = np.unique(np.concatenate(own), return_inverse=True)
    ends = np.cumsum([len(x) for x in own])
    codes = dict(zip(used.tolist(), np.split(code, ends[:-1]), strict=True))
    marked = np.zeros(int(code.max()) + 1, bool)
    out: list[tuple[int, int]] = []
    order = np.argsort(i, kind="stable")
    for a, part in groupby(zip(i[order].tolist(), j[order].tolist(), strict=True), key=itemgetter(0)):
        marked[codes[a]] = True
        for _, b in part:
            x, y = root(int(comp[a])), root(int(comp[b]))
            if x == y:
                continue
            shared = int(np.count_nonzero(marked[codes[b]]))
            if 100 * shared >= percent * (len(codes[a]) + len(codes[b]) - shared):
                above[max(x, y)] = min(x, y)
                out.append((int(cls[a]), int(cls[b])))
        marked[codes[a]] = False
    return out


def _near(percent: int):
    """Of rows (a, b, n_a, bits_a, n_b, bits_b) the pairs whose bitmaps let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 4))
            bits_a, bits_b = (batch.column(k).to_pylist() for k in (3, 5))
            width = np.array([min(len(x), len(y)) for x, y in zip(bits_a, bits_b, strict=True)])
            keep = np.zeros(len(batch), bool)
            for own in np.unique(width).tolist():
                rows = np.flatnonzero(width == own)
                packed = [_folded(bits[k], own) for bits in (bits_a, bits_b) for k in rows.tolist()]
                nodes = _leaves(np.r_[n_a[rows], n_b[rows]], np.arange(2 * len(rows)), packed)
                at = np.arange(len(rows))
                keep[rows] = possible(nodes, at, at + len(rows), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def _sets_of(wanted: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """cls, n, found of the wanted classes, made again from one text each. The ids go to the texts
    as filter bits, so no text is moved; what the filter lets through besides goes in a join."""
    wanted = cut(classes.join(wanted, "cls", "left_semi").select("cls", "doc_id"), "jaccard-wanted")
    size = filter_size(wanted.count())
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(size)).cast("int").alias("slot")
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(wanted.select(slot), size))
    made = docs.select("text", slot).mapInArrow(_sets(bits, words), "cls long, n long, found array<long>")
    return cut(made.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "jaccard-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("found").alias("found_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("found").alias("found_b"))
    shared = F.size(F.array_intersect("found_a", "found_b"))
    linked = (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("shared", shared)
        .where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("shared")))
    )
    return cut(linked.select("a", "b").distinct(), "jaccard-links")


def jaccard_join(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id.

    Documents link when ``100 * |A and B| >= percent * |A or B|`` over their sets of n-gram
    hashes (64 bits, made from seeded xxh3 hashes of the words' bytes; unlike n-grams or sets with
    equal hashes, two of n with odds of n**2 in 2**65, are taken as equal). component_id is the
    smallest doc_id that links reach. class_id names the set: documents with equal sets share it.
    Null, empty and white-space texts have no shingles and link with nothing, so component_id is
    their own id. A row with a null id takes no part and has a null component_id. Rows that
    repeat an id are documents of their own under the same id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    marked = cut(
        docs.mapInArrow(
            _marks(words), "doc_id long, n long, cls long, bits binary, slice int, counts binary"
        ),
        "jaccard-marks",
    )
    summed = (
        marked.where("slice IS NOT NULL")
        .select("slice", "counts")
        .repartition("slice")
        .mapInArrow(_add_slices, "slice int, counts binary")
        .collect()
    )
    order = np.zeros((SLICES, COUNTERS // SLICES), np.uint32)
    for row in summed:
        order[row["slice"]] = np.frombuffer(row["counts"], np.uint32)
    order = spark.sparkContext.broadcast(order.tobytes())
    marked = marked.where("slice IS NULL").drop("slice", "counts")
    own = docs.where("doc_id IS NOT NULL")
    members = cut(
        own.mapInArrow(_prefixes(order, words, percent), "key long, cls long")
        .repartition("key")
        .sortWithinPartitions("key", "cls")
        .mapInArrow(_shared, "key long, cls long"),
        "jaccard-members",
    )
    classes = marked.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bits").alias("bits")
    )
    classes = cut(classes.join(members.select("cls").distinct(), "cls", "left_semi"), "jaccard-classes")
    members = members.join(classes.select("cls", "n"), "cls")
    seeds = _to_fellows(members, 0, percent)
    for turn in range(1, FELLOWS):
        seeds = seeds.unionByName(_to_fellows(members, turn, percent))
    seeds = cut(_possible(seeds.distinct(), classes, percent), "jaccard-pairs")
    sets = _sets_of(_sides(seeds), own, classes, words)
    links = _verified(seeds, sets, percent)
    comps = components(links)
    met = cut(members.join(sets.select("cls").distinct(), "cls", "left_semi"), "jaccard-members")
    for turn in range(FELLOWS, FELLOWS + ROUNDS):
        rest = _apart(_with_comps(met, comps))
        fresh = _verified(_possible(_to_fellows(rest, turn, percent), classes, percent), sets, percent)
        if not fresh.limit(1).count():
            break
        links = links.unionByName(fresh)
        comps = components(links)
    left = _apart(_with_comps(members, comps))
    links = links.unionByName(_tree_links(left, own, classes, words, percent))
    comps = components(links)
    marked = marked.drop("bits")
    group = marked.join(comps, marked["cls"] == comps["node"], "left").select(
        "doc_id", "n", "cls", F.coalesce("comp", "cls").alias("comp")
    )
    group = group.withColumn("comp", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("comp")))
    first = group.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("first"))
    return group.join(first, "comp", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("first", "doc_id").alias("component_id"),
        F.when(F.col("n") > 0, F.col("cls")).alias("class_id"),
    )


def _with_comps(members: DataFrame, comps: DataFrame) -> DataFrame:
    joined = members.join(comps, members["cls"] == comps["node"], "left")
    return joined.select("key", "cls", "n", F.coalesce("comp", "cls").alias("comp"))


def _to_fellows(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): for each class one fellow, the one that it meets most.

    In each group the fellow is the class with the smallest hash, another one each turn. These
    links only join what is plainly together; the trees look at all the rest.
    """
    apart = "comp" in rows.columns
    named = ["cls", "n", "comp"] if apart else ["cls", "n"]
    chosen = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), *named)).alias("to"))
    met = (
        rows.join(chosen, "key")
        .where("comp != to.comp" if apart else "cls != to.cls")
        .where((F.lit(100) * F.least("n", "to.n")) >= (F.lit(percent) * F.greatest("n", "to.n")))
        .groupBy("cls", F.col("to.cls").alias("fellow"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    best = met.groupBy("cls").agg(F.max_by("fellow", F.struct("times", "fellow")).alias("fellow"))
    return best.select(F.least("cls", "fellow").alias("a"), F.greatest("cls", "fellow").alias("b")).distinct()


def _sided(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b with n_a, bits_a, n_b, bits_b."""
    for side in ("a", "b"):
        own = classes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        pairs = pairs.join(own, side)
    return pairs.select("a", "b", "n_a", "bits_a", "n_b", "bits_b")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    return _sided(pairs, classes).mapInArrow(_near(percent), "a long, b long")


def _apart(rows: DataFrame) -> DataFrame:
    """The rows of groups that hold more than one component, with the group's place: the member
    with the smallest hash. Groups of much the same members mostly share it. main: the component
    with the most weight in the group; weight, beside: of it and of all others."""
    first = F.min(F.struct(F.xxhash64("cls").alias("h"), "cls")).alias("first")
    own = rows.groupBy("key", "comp").agg(F.sum(F.expr("1 + n div 1024")).alias("weight"), first)
    spread = own.groupBy("key").agg(
        F.max(F.struct("weight", "comp")).alias("top"),
        F.sum("weight").alias("all"),
        F.count(F.lit(1)).alias("comps"),
        F.min("first").alias("first"),
    )
    spread = spread.where("comps > 1").select(
        "key",
        F.col("top.comp").alias("main"),
        F.col("top.weight").alias("weight"),
        (F.col("all") - F.col("top.weight")).alias("beside"),
        F.col("first.cls").alias("place"),
    )
    return rows.join(spread, "key")


def _dealt(rows: DataFrame) -> DataFrame:
    """place, block, cls, comp, half: which task tries which members with each other.

    A group is one block, and groups of one place are tried together, so that each class goes
    there once; a place with many rows is dealt by group. A large group becomes several blocks at
    places of their own: the members of its main component, already joined to each other, and all
    others fall into shares each, and every share of the others meets every share of both kinds.
    So a large component costs a group in proportion to its size, not with its square.
    """
    small = rows.where(F.col("weight") + F.col("beside") <= BLOCK)
    per = small.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    small = small.join(per, "place").select(
        F.when(F.col("parts") == 1, F.col("place"))
        .otherwise(F.xxhash64("place", F.pmod(F.xxhash64("key"), "parts")))
        .alias("place"),
        F.col("key").alias("block"),
        "cls",
        "comp",
        F.lit(-1).alias("half"),
    )
    others, mains = (F.ceil(F.col(x) * 2 / BLOCK).cast("int") for x in ("beside", "weight"))
    inside = F.col("comp") == F.col("main")
    large = rows.where(F.col("weight") + F.col("beside") > BLOCK).withColumns({"others": others, "mains": mains})
    share = F.pmod(F.xxhash64("cls", "key"), F.when(inside, F.col("mains")).otherwise(F.col("others"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda low, high, kind: F.struct(low.alias("low"), high.alias("high"), F.lit(kind).alias("kind"))
    own = F.col("share")
    meets = F.when(inside, F.transform(upto("others"), lambda k: pair(k, own, 1))).otherwise(
        F.concat(
            F.transform(upto("others"), lambda k: pair(F.least(own, k), F.greatest(own, k), 0)),
            F.transform(upto("mains"), lambda k: pair(own, k, 1)),
        )
    )
    large = large.withColumn("share", share).withColumn("met", F.explode(meets))
    # 0, 1: the side of a block of two shares; -1: a share that meets itself.
    half = (
        F.when(F.col("met.kind") == 1, inside.cast("int"))
        .when(F.col("met.low") == F.col("met.high"), F.lit(-1))
        .otherwise((own == F.col("met.high")).cast("int"))
    )
    block = F.xxhash64("key", "met.low", "met.high", "met.kind")
    return small.unionByName(large.select(block.alias("place"), block.alias("block"), "cls", "comp", half.alias("half")))


def _at_places(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of each place together: first its classes with their two further columns, then the
    members of its blocks."""
    kinds = dict(classes.dtypes)
    extra = [name for name in classes.columns if name != "cls"]
    none = F.lit(None).cast("long")
    own = members.select("place", "cls").distinct().join(classes, "cls")
    own = own.select("place", none.alias("block"), "cls", none.alias("comp"), F.lit(0).alias("half"), *extra)
    rows = own.unionByName(members.select("*", *[F.lit(None).cast(kinds[name]).alias(name) for name in extra]))
    return rows.repartition("place").sortWithinPartitions("place", F.col("block").asc_nulls_first())


def _tree_links(rows: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links that join components, from signature trees over each group.

    The trees run twice: with bitmaps alone they say which classes of a place are in doubt, then
    the sets of these are sent to the place, and what the trees leave over is compared there.
    """
    members = cut(_dealt(rows), "jaccard-dealt")
    doubt = cut(
        _at_places(members, classes.select("cls", "n", "bits")).mapInArrow(_tried(percent), "place long, cls long"),
        "jaccard-doubt",
    )
    sets = _sets_of(doubt.select("cls").distinct(), docs, classes, words)
    members = members.join(doubt, ["place", "cls"], "left_semi").select("place", "block", "cls", "comp", "half")
    found = _at_places(members, sets.select("cls", "found")).mapInArrow(_linked(percent), "a long, b long")
    return cut(found.distinct(), "jaccard-links")
