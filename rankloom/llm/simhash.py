"""Near-duplicate detection by SimHash, with pivot distance tables.

A fingerprint has 128 bits and is that of the set of a text's lower-cased words. Its distances to the reference fingerprints
(the pivots) are computed once and travel with it; a pair whose distances to some pivot differ by more than the radius cannot
lie within it (triangle inequality) and is discarded; survivors are verified by their own Hamming distance. The pivots are
fingerprints of the data, drawn one after another so that each discards most of what the others leave of a sample of pairs.

In 128 bits unrelated fingerprints stand some 60 bits from each other and from every pivot, so pivots alone would leave most
of all pairs; which pairs are looked at first is decided by tables keyed by sampled bits. Their number follows from the number
of fingerprints so that a pair at the radius meets in some table with a chance of at least RECALL. A second search finds what
the first one left: the bits are parted into blocks such that a pair within the radius differs in FLIPS bits of some block at
most (pigeonhole), and every pair that does so is looked at, unless the first search has joined it. So every pair within the
radius is joined; nothing caps how many pairs are looked at. Documents joined by a chain of verified pairs form a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut, give_back, mix, runs, slices, unused, utf8, words

BITS = 128
#: Largest Hamming distance of near duplicates: documents that share about six words of seven.
RADIUS = 20
RECALL = 0.92
PIVOTS = 16
#: Fingerprints from which pivots are drawn and crowded keys are told, at most. Every fingerprint is searched.
SAMPLE = 20_000
#: Fingerprints of one key and table that a task holds, about: a crowded key is spread over tasks.
CROWD = 200_000
#: Differing bits of a block that the second search tries, at most. It changes work, not results.
FLIPS = 2
#: Fingerprints of one cell (the first bits of a block) that a task of the second search holds, about; more are dealt out to
#: chunks, every two of which meet.
CELL = 1 << 20
#: Pairs that the second search compares in one step.
AT_ONCE = 1 << 19
#: Up to this many fingerprints of one key, all their pairs are listed at once; larger sets are searched breadth first.
LISTED = 48

_EDGE = "a bigint, b bigint"


def pivots(sample: np.ndarray, radius: int = RADIUS, n: int = PIVOTS) -> np.ndarray:
    """At most n fingerprints of the sample, each the one that discards most of the sample's far pairs that are left."""
    if len(sample) < 2:
        return sample[:n]
    draw = np.random.default_rng(7)
    a, b = sample[draw.integers(0, len(sample), 20_000)], sample[draw.integers(0, len(sample), 20_000)]
    far = hamming(a, b) > radius
    a, b = a[far], b[far]
    among = sample[draw.permutation(len(sample))[:400]]
    discards = np.stack([np.abs(hamming(a, p) - hamming(b, p)) > radius for p in among])
    left, chosen = np.ones(len(a), bool), []
    for _ in range(min(n, len(among))):
        gain = (discards & left).sum(1)
        gain[chosen] = -1
        chosen.append(int(np.argmax(gain)))
        left &= ~discards[chosen[-1]]
    return among[chosen]


def fingerprint(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 array of shape (n, 2), number of distinct words). A text without words has fingerprint 0 and number 0."""
    out, count = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), np.int64)
    for lo, hi in slices(texts, 1 << 20):
        part = pc.utf8_lower(pc.fill_null(texts.slice(lo, hi - lo), ""))
        doc, _, _, hashed = words(*utf8(part))
        if not len(doc):
            continue
        _, at = np.unique(mix(hashed ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
        at.sort()
        doc, hashed = doc[at], hashed[at]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        number = np.diff(np.concatenate((first, [len(doc)])))
        count[lo + doc[first]] = number
        for a, b in runs(number, 1 << 13):  # a word takes some 640 bytes here
            some = hashed[first[a] : first[b - 1] + number[b - 1]]
            bits = np.unpackbits(np.stack([some, mix(some + np.uint64(0x632BE5AB))], 1).view(np.uint8).reshape(len(some), 16), axis=1)
            ones = np.add.reduceat(bits, first[a:b] - first[a], axis=0, dtype=np.int32)
            packed = np.packbits(ones * 2 > number[a:b, None], axis=1)
            out[lo + doc[first[a:b]]] = packed.view(np.uint64).reshape(-1, 2)
    return out, count


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def pivot_table(fps: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each pivot, uint8 of shape (n, pivots)."""
    return np.stack([np.bitwise_count(fps ^ p).sum(axis=1, dtype=np.uint8) for p in reference], 1) if len(reference) else np.zeros((len(fps), 0), np.uint8)


def nodes(fps: np.ndarray) -> np.ndarray:
    """A 64-bit name of each fingerprint."""
    return mix(fps[:, 0] ^ mix(fps[:, 1] + np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def survivors(table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Mask of the pairs whose largest coordinate difference does not exceed the radius; checks a few pivots at a time."""
    alive = np.arange(len(i))
    for k in range(0, table.shape[1], 8):
        block = table[:, k : k + 8].astype(np.int16)
        alive = alive[np.abs(block[i[alive]] - block[j[alive]]).max(axis=1) <= radius]
    mask = np.zeros(len(i), bool)
    mask[alive] = True
    return mask


def plan(n: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, number of tables) for n fingerprints: keys of about log2(n) bits, tables for the wanted recall."""
    bits = max(8, math.ceil(math.log2(max(n, 2))) - 1)
    hit = math.prod((BITS - radius - i) / (BITS - i) for i in range(bits))  # distinct positions
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def sampled(bits: int, tables: int) -> np.ndarray:
    """Bit positions of each table, shape (tables, bits); fixed by its arguments."""
    draw = np.random.default_rng(20_240_607)
    return np.stack([draw.permutation(BITS)[:bits] for _ in range(tables)])


def keys(fps: np.ndarray, positions: np.ndarray, first: int = 0) -> np.ndarray:
    """A 64-bit key, mixed, for each fingerprint and table: shape (n, tables); the tables are those from `first` on."""
    tables, bits = positions.shape
    spread = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), 16), axis=1)
    weight = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None]
    return np.stack([mix((spread[:, p].astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) + (np.uint64(t + 1) << np.uint64(48))) for t, p in enumerate(positions, first)], 1)


def near_pairs(key: np.ndarray, fps: np.ndarray, ids: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that connect, within each key, what all its pairs within the radius connect. table: their pivot distances."""
    order = np.lexsort((ids, key))
    key, fps, ids, table = key[order], fps[order], ids[order], table[order]
    n = len(key)
    if n < 2:
        return ids[:0], ids[:0]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [n])))
    left = np.repeat(first + size, size) - np.arange(n) - 1  # rows of the same key that follow
    small = np.repeat(size <= LISTED, size)
    found_i, found_j = [], []
    for gap in range(1, int(min(LISTED, size.max()))):
        i = np.flatnonzero(small & (left >= gap))
        if not len(i):
            break
        i = i[survivors(table, i, i + gap, radius)]
        i = i[hamming(fps[i], fps[i + gap]) <= radius]
        found_i.append(i), found_j.append(i + gap)
    for s, k in zip(first[size > LISTED], size[size > LISTED]):
        rest = np.arange(s, s + k)
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                maybe = np.abs(table[rest].astype(np.int16) - table[at].astype(np.int16)).max(axis=1) <= radius
                maybe[maybe] = hamming(fps[rest[maybe]], fps[at]) <= radius
                hit = rest[maybe]
                if len(hit):
                    found_i.append(np.full(len(hit), at)), found_j.append(hit)
                    queue += hit.tolist()
                    rest = rest[~maybe]
    if not found_i:
        return ids[:0], ids[:0]
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    return forest(ids[i], ids[j])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges with the same components: each node of a component with its least node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[root[keep]], nodes[keep]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of a graph of edges (a, b) and the least node of its component; nodes without edge don't appear.

    Alternating large-star and small-star steps: each is one shuffle, and their number grows with the logarithm of the
    longest path. Lineage is cut after each round in the shared checkpoint folder. The rounds end once number and checksum of
    the edges stay the same.
    """
    seal = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = seal(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = cut(small)
        after = seal(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def _fingerprints(text: Column) -> Column:
    @F.arrow_udf("struct<hi:bigint,lo:bigint,n:int,node:bigint>")
    def run(texts: pa.Array) -> pa.Array:
        fps, n = fingerprint(texts)
        give_back()
        cols = fps.view(np.int64)
        return pa.StructArray.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1]), pa.array(n.astype(np.int32)), pa.array(nodes(fps))], ["hi", "lo", "n", "node"])

    return run.asNondeterministic()(text)


def _partitions(df: DataFrame, rows: int, row_bytes: int) -> int:
    """Enough partitions for about 32 MB each, and no fewer than the session asks for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * row_bytes // (32 << 20) + 1)


def crowded(sample: np.ndarray, n: int, positions: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, parts, leaders) of keys that hold more than CROWD of n fingerprints, judged by a sample of them.

    parts: over how many tasks each is spread. leaders: fingerprints of the sample such that all the sample's of that key lie
    within the radius of one; they go to every part, so that groups that run through several parts meet at them.
    """
    scale = n / max(len(sample), 1)
    names, parts, leaders = [], [], []
    for t, column in enumerate(keys(sample, positions).T if len(sample) else ()):
        kinds, count = np.unique(column, return_counts=True)
        for k, c in zip(kinds, count):
            if c >= 8 and c * scale > CROWD:
                own, first = sample[column == k], []
                while len(own):
                    first.append(own[0])
                    own = own[hamming(own, own[0]) > radius]
                names.append(k), parts.append(math.ceil(c * scale / CROWD)), leaders.append(np.array(first))
    order = np.argsort(np.array(names, dtype=np.uint64))
    return np.array(names, dtype=np.uint64)[order], np.array(parts, dtype=np.int64)[order], [leaders[i] for i in order]


def blocks(radius: int = RADIUS) -> list[tuple[np.ndarray, int]]:
    """(bit positions, flips) of parts of a fingerprint such that any two within the radius differ in at most `flips` bits of
    some part: the sum of flips + 1 is radius + 1, which a pair with more differing bits in every part would reach."""
    whole, rest = divmod(radius + 1, FLIPS + 1)
    flips = [FLIPS] * whole + [rest - 1] * (rest > 0)
    return [(p[:20], f) for p, f in zip(np.array_split(np.arange(BITS), len(flips)), flips)]  # fewer bits of a part differ in no more


def block_keys(fps: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The bits at the positions as a number, the first one the highest."""
    spread = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), 16), axis=1)
    out = np.zeros(len(fps), np.int64)
    for p in positions:
        out = out << 1 | spread[:, p]
    return out


class _Joined:
    """Pairs of labels, thinned out to those that join something new whenever many have come."""

    def __init__(self, labels: int) -> None:
        self.root = np.arange(labels)
        self.a = self.b = self.root[:0]
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.root[a] != self.root[b]
        if new.any():
            self.new.append((a[new], b[new]))
            self.waiting += len(self.new[-1][0])
            if self.waiting > max(1 << 16, len(self.a)):
                self.pairs()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            self.a, self.b = forest(*(np.concatenate((old, *more)) for old, more in zip((self.a, self.b), zip(*self.new))))
            self.root[self.b] = self.a
            self.new, self.waiting = [], 0
        return self.a, self.b


def _all_pairs(stored: tuple, probes: tuple, same: bool, radius: int, joined: _Joined) -> None:
    (x, y, label), (u, v, other) = stored, probes
    for i in range(0, len(u), 64):
        for j in range(i if same else 0, len(x), 8192):
            d = np.bitwise_count(u[i : i + 64, None] ^ x[j : j + 8192]) + np.bitwise_count(v[i : i + 64, None] ^ y[j : j + 8192])
            q, s = np.nonzero(d <= radius)
            joined.add(other[i + q], label[j + s])


def _by_block(stored: tuple, probes: tuple, same: bool, bits: int, flips: int, radius: int, joined: _Joined) -> None:
    """Joins the labels of stored rows and probes (key, two words, label) within the radius whose keys of so many bits differ in
    `flips` bits at most; if same, the probes are the stored rows and each pair is looked at once."""
    if not len(stored[0]) or not len(probes[0]):
        return
    order = np.argsort(stored[0], kind="stable")
    key, x, y, label = (c[order] for c in stored)
    probe, u, v, other = (key, x, y, label) if same else (c[np.argsort(probes[0], kind="stable")] for c in probes)
    start = np.concatenate(([0], np.cumsum(np.bincount(key, minlength=1 << bits))))
    masks = [sum(1 << p for p in c) for f in range(flips + 1) for c in combinations(range(bits), f)]
    some = probe[:: -(-len(probe) // 1000)]
    if sum(int((start[(some ^ m) + 1] - start[some ^ m]).sum()) for m in masks) * 4 > len(some) * len(key):  # comparing all costs less
        return _all_pairs((x, y, label), (u, v, other), same, radius, joined)
    everything = np.arange(len(probe))
    unset = [np.flatnonzero(probe >> p & 1 == 0) for p in range(bits)] if same else []
    for m in masks:
        rows = unset[m.bit_length() - 1] if same and m else everything
        to = probe[rows] ^ m
        lo = rows + 1 if same and not m else start[to]
        number = start[to + 1] - lo
        some = np.flatnonzero(number > 0)
        rows, lo, number = rows[some], lo[some], number[some]
        end = np.cumsum(number)
        at = 0
        while at < len(rows):
            done = end[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(end, done + AT_ONCE, side="right")))
            count = number[at:upto]
            q = np.repeat(rows[at:upto], count)
            s = np.arange(end[upto - 1] - done) + np.repeat(lo[at:upto] - (end[at:upto] - count - done), count)
            d = np.bitwise_count(u[q] ^ x[s])
            maybe = np.flatnonzero(d <= radius)
            q, s, d = q[maybe], s[maybe], d[maybe]
            near = d + np.bitwise_count(v[q] ^ y[s]) <= radius
            joined.add(other[q[near]], label[s[near]])
            at = upto


def links(stored: tuple[np.ndarray, np.ndarray, np.ndarray], probes: tuple[np.ndarray, np.ndarray, np.ndarray] | None, bits: int, flips: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels that connect what all pairs of a stored row and a probe (key, fingerprint, label), or of two stored rows,
    connect whose keys differ in `flips` bits at most and whose fingerprints lie within the radius.

    Rows with the same label are connected already. Those of a label that holds a great part of the rows are never compared
    with each other, however near they are.
    """
    same, probes = probes is None, stored if probes is None else probes
    names, index = np.unique(np.concatenate((stored[2], probes[2])), return_inverse=True)
    size = np.bincount(index, minlength=len(names))
    great = np.flatnonzero(size >= max(256, len(index) // 64))
    group = np.zeros(len(names), np.int64)
    group[great] = np.arange(1, len(great) + 1)
    joined = _Joined(len(names))

    def columns(rows: tuple, label: np.ndarray) -> tuple:
        return rows[0], np.ascontiguousarray(rows[1][:, 0]), np.ascontiguousarray(rows[1][:, 1]), label

    left, right = columns(stored, index[: len(stored[0])]), columns(probes, index[len(stored[0]) :])
    of_left, of_right = group[left[3]], group[right[3]]
    take = lambda rows, mask: tuple(c[mask] for c in rows)
    for g in range(len(great) + 1):
        now = take(right, of_right == g)
        if same:
            if g == 0:
                _by_block(now, now, True, bits, flips, radius, joined)
            _by_block(take(left, of_left > g), now, False, bits, flips, radius, joined)
        else:
            _by_block(take(left, of_left != g) if g else left, now, False, bits, flips, radius, joined)
    a, b = joined.pairs()
    return names[a], names[b]


def missed(labelled: DataFrame, n: int, sample: np.ndarray, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of labels that connect what all pairs within the radius connect, of n rows (node, hi, lo, label).

    Rows of one block and cell, its first bits, go together; cells that differ in more bits than the block's flips needn't meet.
    A cell that holds more than CELL rows, judged by the sample, is dealt out to chunks by hash; every two chunks whose cells
    may hold a pair meet in a task. How many cells and chunks there are changes work, not results.
    """
    first = max(int(n > CELL >> 5), math.ceil(math.log2(max(n, 1) / CELL)) if n else 0)
    parts: list[tuple] = []  # (positions, bits after the cell's, chunks of each cell, number of its first, tasks and sides of each chunk)
    tasks: list[tuple[int, int, bool]] = []  # (block, flips left after the cells', a chunk with itself)
    for b, (positions, flips) in enumerate(blocks(radius)):
        head = min(first, len(positions))
        tail = len(positions) - head
        share = np.bincount(block_keys(sample, positions) >> tail, minlength=1 << head) * (n / max(len(sample), 1))
        chunks = np.maximum(1, np.ceil(share / CELL).astype(np.int64))
        cell = np.repeat(np.arange(1 << head), chunks)
        meets: list[list[tuple[int, int]]] = [[] for _ in cell]
        for i in range(len(cell)):
            for j in (i + np.flatnonzero(np.bitwise_count(cell[i:] ^ cell[i]) <= flips)).tolist():
                meets[i].append((len(tasks), 0))
                if j != i:
                    meets[j].append((len(tasks), 1))
                tasks.append((b, flips - int(cell[i] ^ cell[j]).bit_count(), i == j))
        parts.append((positions, tail, chunks, np.cumsum(chunks) - chunks, meets))
    copies = sum(np.mean([len(m) for m in meets]) for *_, meets in parts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, hi, lo, label = (batch.column(k).to_numpy() for k in ("node", "hi", "lo", "label"))
            packed = np.stack([hi, lo, label], 1)
            fps = np.ascontiguousarray(packed[:, :2]).view(np.uint64)
            task, side, data = [], [], []
            for positions, tail, chunks, start, meets in parts:
                cell = block_keys(fps, positions) >> tail
                chunk = start[cell] + (node.view(np.uint64) % chunks[cell].astype(np.uint64)).astype(np.int64)
                order = np.argsort(chunk, kind="stable")
                at = np.searchsorted(chunk[order], np.arange(len(meets) + 1))
                for c in np.flatnonzero(np.diff(at)).tolist():
                    rows = packed[order[at[c] : at[c + 1]]].tobytes()
                    for t, k in meets[c]:
                        task.append(t), side.append(k), data.append(rows)
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(side, pa.int32()), pa.array(data, pa.binary())], ["task", "side", "data"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for batch in batches:
            for t, k, data in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "data"))):
                held.setdefault(t, ([], []))[k].append(data)
        for t in list(held):
            b, flips, same = tasks[t]
            positions, tail = parts[b][:2]
            sides = []
            for blobs in held.pop(t):
                rows = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 3)
                fps = np.ascontiguousarray(rows[:, :2]).view(np.uint64)
                sides.append((block_keys(fps, positions) & ((1 << tail) - 1), fps, rows[:, 2]))
            a, c = links(sides[0], None if same else sides[1], tail, flips, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    where = max(_partitions(labelled, int(n * copies), 24), min(2 * len(tasks), 8 * labelled.sparkSession.sparkContext.defaultParallelism))
    blobs = labelled.select("node", "hi", "lo", "label").mapInArrow(spread, "task int, side int, data binary")
    return blobs.repartition(where, "task").mapInArrow(match, _EDGE)


def fingerprint_groups(distinct: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """(node, root) over fingerprints (node, hi, lo), all distinct: groups of those that chains of near pairs connect.

    A fingerprint and its pivot distances go to one task for each table, packed into blobs of one table and task; the key is
    made again from the fingerprint there. A key that very many fingerprints share is spread over tasks by hash; within each
    part all is searched, and its leaders are in every part. What no table and part has brought together is then searched by
    blocks, so that every pair within the radius is joined whatever the recall, which only says how much is left to that.
    """
    n = distinct.count()
    bits, tables = plan(n, radius, recall)
    drawn = distinct.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("hi", "lo").toPandas().to_numpy(np.int64)
    sample = np.ascontiguousarray(drawn).view(np.uint64).reshape(-1, 2)
    reference = pivots(sample, radius)
    width = 16 + len(reference)
    positions = sampled(bits, tables)
    hot, hot_parts, leaders = crowded(sample, n, positions, radius)
    total = _partitions(distinct, n * tables, width)
    each = max(1, -(-total // tables))  # tasks of a table

    def split(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, with the part of a crowded one worked in; index of the crowded key or -1)."""
        if not len(hot):
            return key, np.full(len(key), -1)
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        is_hot = hot[at] == key
        part = node.view(np.uint64) % np.where(is_hot, hot_parts[at], 1).astype(np.uint64)
        return np.where(is_hot, mix(key + part + np.uint64(1)), key), np.where(is_hot, at, -1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, hi, lo = (batch.column(k).to_numpy() for k in ("node", "hi", "lo"))
            fps = np.stack([hi, lo], 1).view(np.uint64)
            packed = np.concatenate((fps.view(np.uint8).reshape(len(fps), 16), pivot_table(fps, reference)), axis=1)
            key = keys(fps, positions)
            task, table, data = [], [], []
            for t in range(tables):
                where = (split(key[:, t], node)[0] % np.uint64(each)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                at = np.searchsorted(where[order], np.arange(each + 1))
                for p in np.flatnonzero(np.diff(at)).tolist():
                    task.append(t * each + p), table.append(t), data.append(packed[order[at[p] : at[p + 1]]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(table, pa.int32()), pa.array(data, pa.binary())], ["task", "t", "data"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for t, data in zip(b.column("t").to_pylist(), b.column("data").to_pylist()):
                blobs.setdefault(t, []).append(data)
        for t in list(blobs):
            rows = np.frombuffer(b"".join(blobs.pop(t)), np.uint8).reshape(-1, width)
            fps = np.ascontiguousarray(rows[:, :16]).view(np.uint64)
            table, node = np.ascontiguousarray(rows[:, 16:]), nodes(fps)
            key, crowd = split(keys(fps, positions[t : t + 1], t)[:, 0], node)
            if (crowd >= 0).any():
                more = [(k, leaders[i]) for k, i in {(int(k), int(i)) for k, i in zip(key[crowd >= 0], crowd[crowd >= 0])}]
                new = np.concatenate([x for _, x in more])
                key = np.concatenate((key, np.repeat(np.array([k for k, _ in more], np.uint64), [len(x) for _, x in more])))
                fps, table, node = np.concatenate((fps, new)), np.concatenate((table, pivot_table(new, reference))), np.concatenate((node, nodes(new)))
            a, c = near_pairs(key, fps, node, table, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    blobs = distinct.select("node", "hi", "lo").mapInArrow(spread, "task bigint, t int, data binary")
    near = components(blobs.repartition(tables * each, "task").select("t", "data").mapInArrow(match, _EDGE))
    labelled = distinct.join(near, "node", "left").withColumn("label", F.coalesce("root", "node"))
    more = cut(missed(labelled, n, sample, radius))
    if more.isEmpty():
        return near
    wider = components(more)
    over = wider.select(F.col("node").alias("root"), F.col("root").alias("over"))
    return near.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")).unionByName(wider)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """(doc_id, hash, rows, keeper, keeper_hash, size, keep) for each distinct (doc_id, text) whose text isn't empty.

    hash is the text's xxhash64. Texts with the same set of words have one fingerprint; all fingerprints within the radius are
    joined, by chains. Texts without letters and digits are joined if they are equal. A group keeps the row of least
    (doc_id, hash), its keeper, a null doc_id last. rows counts identical repeats, of which one stays; size is the number of
    rows in the group. Null and empty texts are no one's duplicate and don't appear.
    """
    narrow = docs.where("text is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("hash"), _fingerprints(F.col("text")).alias("f"))
    narrow = cut(narrow.groupBy("doc_id", "hash").agg(*[F.first(f"f.{c}").alias(c) for c in ("hi", "lo", "n")], F.first(F.when(F.col("f.n") > 0, F.col("f.node")).otherwise(F.xxhash64("hash"))).alias("node"), F.count("*").alias("rows")))
    distinct = narrow.where("n > 0").select("node", "hi", "lo").distinct()
    near = fingerprint_groups(distinct, radius, recall)
    marked = narrow.join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("hash").alias("hash")))
    best = marked.groupBy("root").agg(first.alias("k"), F.count("*").alias("members"), F.sum("rows").alias("size"))
    out = marked.join(best, "root")
    keep = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("hash") == F.col("k.hash"))
    return out.select("doc_id", "hash", "rows", F.col("k.doc_id").alias("keeper"), F.col("k.hash").alias("keeper_hash"), "size", keep.alias("keep"))


def duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """A row (doc_id, duplicate_of, group_size) for each row that has a near duplicate of lower standing.

    duplicate_of is the doc_id that the group keeps, its least. The keeper itself and documents without near duplicate don't
    appear; a row repeated k times appears k times, or k-1 times if it is its group's keeper. Null and empty texts are no
    one's duplicate, texts without letters and digits only of equal ones. An empty table gives an empty result; further columns don't matter.
    """
    d = near_duplicates(docs, radius, recall).where("size > 1")
    extra = F.col("rows") - F.col("keep").cast("int")
    return d.where(extra > 0).select("doc_id", F.col("keeper").alias("duplicate_of"), F.col("size").alias("group_size"), F.explode(F.expr("sequence(1, rows - int(keep))")).alias("k")).drop("k")


def keep_one(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """docs without all but one row of each group; empty and null texts all stay.

    What goes is found over (doc_id, hash) only, so texts are shuffled only if the list of what goes is too large to be
    broadcast under the session's own threshold.
    """
    i, h = unused(docs, "gone_id"), unused(docs, "gone_hash")
    marked = cut(near_duplicates(docs, radius, recall).where("size > 1"))
    gone = marked.where("not keep").select(F.col("doc_id").alias(i), F.col("hash").alias(h))
    twice = marked.where("keep and rows > 1").select(F.col("doc_id").alias(i), F.col("hash").alias(h))
    on = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    left = docs.join(gone, on, "left_anti")
    if twice.isEmpty():
        return left
    once = left.join(twice, on, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, on, "left_anti").unionByName(once)
