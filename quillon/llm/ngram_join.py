"""Exact Jaccard join of five-word shingle sets, by prefix trees.

1. Each text becomes a set of 64-bit shingle hashes and a 128-bit digest of the set.
   Texts with equal sets are one class from here on.
2. Shingles are dealt by hash to shards, packed in binary blocks, and each shard
   tells in how many classes each of its shingles occurs. A class whose shared
   shingles are fewer than the threshold asks of any partner is alone; most are.
3. The others' shared shingles are put into one global order, rarest first. Two sets
   that are similar enough share a shingle among the first few of each (the prefix).
   A list holds the sets that have a shingle in their prefix, likeliest first. Its first
   member, the pivot, is compared with the others; what that links becomes components.
   Then the next members are pivots, in windows that grow, and only for what is still in
   other components, until no list holds two. So a group of near copies costs about one
   comparison a member, and no link between components is lost. Pairs whose sizes,
   unshared shingles, places in the order or sketches rule out a link are left out.
4. The members to be compared with a pivot, in slices of bounded size, are stored in a
   prefix tree over the global order. The pivot's set runs down the tree: sets with a
   common beginning share its partial overlap, and a subtree is cut off when the
   overlap so far and what remains on either side cannot reach the threshold.
5. Connected components by label hooking and shortcutting; only narrow tables move.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_filter, maybe_among, shared_dir, stored, texts_to_python, unused, with_group

WORDS, SIMILAR, OUT_OF = 5, 75, 100
#: Shingles of a shard on average, and of a packed block at most; members of a slice.
SHARD_SHINGLES, BLOCK_SHINGLES, SLICE = 1_000_000, 1_000_000, 256
LEAST_SHARDS = 64
#: The most keys of rows that are broadcast to a scan of the texts; beyond, a shuffled join.
BROADCAST_KEYS = 200_000
#: The next window of pivots ends so many times further on; pairs that are looked at together.
WINDOW_GROWTH, CHUNK_PAIRS = 16, 1 << 19


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word windows; of the whole if it has fewer words."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(words))):
        out ^= h[k : k + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def least_overlap(n, m=None):
    """The fewest common shingles of similar sets of n and m; without m, with the best partner."""
    if m is None:
        return -(-SIMILAR * n // OUT_OF)
    return -(-SIMILAR * (n + m) // (OUT_OF + SIMILAR))


def _texts(b: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for v in b.column(column).cast(pa.binary()):
        yield v.as_buffer().to_pybytes() if v.is_valid else b""


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, digest): the size of each row's set, and the set's digest (null if empty)."""
    kind = dict(docs.dtypes)[id_col]
    texts_to_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sums = [], []
            for t in _texts(b, 1):
                s = shingles(t)
                n.append(len(s))
                sums.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.binary())], ["doc_id", "n", "digest"])

    return docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, digest binary")


# Packed blocks. Equal bytes of sorted numbers lie together, for the shuffle's compression.
def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _shard_of(s: np.ndarray, shards: int) -> np.ndarray:
    return ((s >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)


def _cuts(of: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(k, start, end) of each k below n that sorted numbers hold."""
    bounds = np.searchsorted(of, np.arange(n + 1))
    for k in range(n):
        if bounds[k] < bounds[k + 1]:
            yield k, int(bounds[k]), int(bounds[k + 1])


def _table(rows: list[tuple], names: str, kinds: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names.split())


def _columns(t: pa.Table, names: str) -> zip:
    return zip(*(t.column(c).to_pylist() for c in names.split()))


#: Rows of shard >= 0 hold a block's shingles of a shard; the row of shard -1 - block holds its sets' digests and sizes.
BLOCK, BLOCK_NAMES, BLOCK_KINDS = "shard bigint, block bigint, a binary, b binary", "shard block a b", [pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def packed(docs: DataFrame, text_col: str, shards: int) -> DataFrame:
    """All sets' shingles in blocks for the shards; equal sets of one block once."""
    texts_to_python(docs.sparkSession)

    def block(sets: list[np.ndarray], digests: list[bytes], number: int) -> pa.Table:
        s = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16 if len(sets) < 65536 else np.uint32), [len(x) for x in sets])
        order = np.argsort(s, kind="stable")
        s, owner = s[order], owner[order]
        rows = [(k, number, _planes(s[a:z]), owner[a:z].tobytes()) for k, a, z in _cuts(_shard_of(s, shards), shards)]
        rows.append((-1 - number, number, b"".join(digests), np.array([len(x) for x in sets], np.uint32).tobytes()))
        return _table(rows, BLOCK_NAMES, BLOCK_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        sets, digests, seen, held = [], [], set(), 0
        for b in batches:
            for t in _texts(b, 0):
                s = shingles(t)
                if len(s) and (d := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) not in seen:
                    seen.add(d)
                    sets.append(s)
                    digests.append(d)
                    held += len(s)
                    if held >= BLOCK_SHINGLES:
                        yield from block(sets, digests, number).to_batches()
                        sets, digests, seen, held, number = [], [], set(), 0, number + 1
        if sets:
            yield from block(sets, digests, number).to_batches()

    return docs.select(docs[f"`{text_col}`"].alias("text")).mapInArrow(run, BLOCK)


SHARED = "block bigint, digests binary, sizes binary, shingles binary, owners binary, df binary"
SHARED_NAMES, SHARED_KINDS = "block digests sizes shingles owners df", [pa.int64(), *[pa.binary()] * 5]


def shared_shingles(blocks: DataFrame) -> DataFrame:
    """For each block, its shingles that other sets have too, with how many sets have them."""

    def run(t: pa.Table) -> pa.Table:
        rows = list(_columns(t, BLOCK_NAMES))
        if rows[0][0] < 0:
            return _table([(k, a, b, None, None, None) for _, k, a, b in rows], SHARED_NAMES, SHARED_KINDS)
        parts = [_unplanes(a) for _, _, a, _ in rows]
        s = np.concatenate(parts)
        order = np.argsort(s, kind="stable")
        sorted_s = s[order]
        start = np.flatnonzero(np.concatenate([[True], sorted_s[1:] != sorted_s[:-1]]))
        count = np.diff(np.append(start, len(s)))
        df = np.empty(len(s), np.uint32)
        df[order] = np.repeat(count, count)
        out, at = [], 0
        for (_, block, _, b), x in zip(rows, parts):
            d = df[at : at + len(x)]
            at += len(x)
            if (two := d > 1).any():
                owner = np.frombuffer(b, np.uint16 if len(b) == 2 * len(x) else np.uint32)
                out.append((block, None, None, _planes(x[two]), owner[two].astype(np.uint32).tobytes(), np.minimum(d[two], 65535).astype(np.uint16).tobytes()))
        return _table(out, SHARED_NAMES, SHARED_KINDS)

    return blocks.groupBy("shard").applyInArrow(run, SHARED)


#: One shared shingle of a set: frequency (2 bytes) and hash (8 bytes), big-endian, so that bytes compare in the global order.
ITEM = np.dtype([("df", ">u2"), ("s", ">u8")])


#: Bits of a set's sketch: each shared shingle flips one. Sets differ in at least as many shingles as their sketches do in bits.
SKETCH_BITS = 256


def _sketch(s: np.ndarray) -> bytes:
    flips = np.bincount(((s >> np.uint64(8)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def candidates(shared: DataFrame) -> DataFrame:
    """Sets that may have a partner: (digest, n, shared, sketch, items), items in the global order."""

    def run(t: pa.Table) -> pa.Table:
        heads, sizes, s, owner, df = b"", b"", [], [], []
        for _, d, z, x, o, f in _columns(t, SHARED_NAMES):
            if d is not None:
                heads, sizes = d, z
            else:
                s.append(_unplanes(x))
                owner.append(np.frombuffer(o, np.uint32))
                df.append(np.frombuffer(f, np.uint16))
        sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
        rows = []
        if s:
            s, owner, df = np.concatenate(s), np.concatenate(owner), np.concatenate(df)
            count = np.bincount(owner, minlength=len(sizes))
            fit = count >= least_overlap(sizes)
            keep = fit[owner]
            s, df, owner = s[keep], df[keep], owner[keep]
            order = np.lexsort((s, df, owner))
            s = s[order]
            items = np.empty(len(s), ITEM)
            items["df"], items["s"] = df[order], s
            rows = [(heads[16 * k : 16 * k + 16], int(sizes[k]), int(count[k]), _sketch(s[a:z]), items[a:z].tobytes()) for k, a, z in _cuts(owner[order], len(sizes))]
        return _table(rows, "digest n shared sketch items", [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return shared.groupBy("block").applyInArrow(run, "digest binary, n bigint, shared bigint, sketch binary, items binary")


def prefixes(sets: DataFrame) -> DataFrame:
    """(digest, n, shared, sketch, prefix) of the sets: what the lists need, about a quarter of the items."""
    length = F.expr(f"shared - (n * {SIMILAR} + {OUT_OF - 1}) div {OUT_OF} + 1")  # what is not shared comes first
    return sets.select("digest", "n", "shared", "sketch", F.substring("items", F.lit(1), (length * ITEM.itemsize).cast("int")).alias("prefix"))


POSTING_NAMES = "shard digests sizes shared roots sketches shingles owners places"


def postings(sets: DataFrame, shards: int) -> DataFrame:
    """Prefix shingles of the candidates (digest, n, shared, sketch, prefix, root) in blocks for shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            heads, sizes, shared, sketches, firsts, roots = (b.column(c).to_pylist() for c in ("digest", "n", "shared", "sketch", "prefix", "root"))
            firsts = [np.frombuffer(x, ITEM)["s"].astype(np.uint64) for x in firsts]
            s, length = np.concatenate(firsts), np.array([len(x) for x in firsts])
            owner = np.repeat(np.arange(len(heads)), length)
            place = np.arange(len(s)) - np.repeat(np.cumsum(length) - length, length)
            of = _shard_of(s, shards)
            order = np.argsort(of, kind="stable")
            s, owner, place, of = s[order], owner[order], place[order], of[order]
            head, root = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, 16) for x in (heads, roots))
            sketch = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH_BITS // 8)
            size, known = np.array(sizes, np.uint32), np.array(shared, np.uint32)
            rows = []
            for k, a, z in _cuts(of, shards):
                own, at = np.unique(owner[a:z], return_inverse=True)
                rows.append((k, head[own].tobytes(), size[own].tobytes(), known[own].tobytes(), root[own].tobytes(), sketch[own].tobytes(), s[a:z].tobytes(), at.astype(np.uint32).tobytes(), place[a:z].astype(np.uint32).tobytes()))
            yield from _table(rows, POSTING_NAMES, [pa.int32(), *[pa.binary()] * 8]).to_batches()

    return sets.select("digest", "n", "shared", "sketch", "prefix", "root").mapInArrow(run, "shard int, " + ", ".join(f"{x} binary" for x in POSTING_NAMES.split()[1:]))


class Lists:
    """The lists of a shard: for each shingle the members that have it in their prefix.

    Members are numbered, and stand in each list, by how large a part of their shingles
    they share: the first is likeliest to be similar to the others.
    """

    def __init__(self, t: pa.Table):
        heads, sizes, shared, roots, sketches, s, owner, place, n = [], [], [], [], [], [], [], [], 0
        for _, d, z, k, c, f, x, o, at in _columns(t, POSTING_NAMES):
            heads.append(np.frombuffer(d, np.uint8).reshape(-1, 16))
            roots.append(np.frombuffer(c, ">u8").reshape(-1, 2).astype(np.uint64))
            sketches.append(np.frombuffer(f, np.uint64).reshape(-1, SKETCH_BITS // 64))
            sizes.append(np.frombuffer(z, np.uint32))
            shared.append(np.frombuffer(k, np.uint32))
            s.append(np.frombuffer(x, np.uint64))
            owner.append(np.frombuffer(o, np.uint32) + np.uint32(n))
            place.append(np.frombuffer(at, np.uint32))
            n += len(sizes[-1])
        heads, roots, sketches, sizes, shared, s, owner, place = (np.concatenate(x) for x in (heads, roots, sketches, sizes, shared, s, owner, place))
        key = np.ascontiguousarray(heads).view(">u8").astype(np.uint64)
        order = np.lexsort((key[:, 1], key[:, 0], -(shared / sizes)))
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        self.heads, self.sketches = heads[order], sketches[order]
        self.n, self.shared = sizes[order].astype(np.int64), shared[order].astype(np.int64)
        by_root = np.lexsort((roots[:, 1], roots[:, 0]))
        new = (roots[by_root][1:] != roots[by_root][:-1]).any(1)
        root = np.empty(n, np.int64)
        root[by_root] = np.concatenate([[0], np.cumsum(new)])
        self.root = root[order]
        at = number[owner]
        by = np.lexsort((at, s))
        s, self.at = s[by], at[by]
        self.rest = self.shared[self.at] - place[by]  # shared shingles from this one on
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        of_root = self.root[self.at]
        several = np.minimum.reduceat(of_root, start) != np.maximum.reduceat(of_root, start)
        self.start, self.end = start[several], np.append(start[1:], len(s))[several]

    def hopeful(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which members at p could be similar to those at q of the same list, this shingle the first they share.

        By roots, sizes, what is left from here on, what isn't shared, and sketches: all
        that are similar and in different groups are among them.
        """
        i, j = self.at[p], self.at[q]
        keep = np.flatnonzero(self.root[i] != self.root[j])
        i, j, p, q = i[keep], j[keep], p[keep], q[keep]
        n, m = self.n[i], self.n[j]
        need = least_overlap(n, m)
        fit = need <= np.minimum(np.minimum(n, m), np.minimum(self.rest[p], self.rest[q]))
        keep, i, j, need, spare = keep[fit], i[fit], j[fit], need[fit], (n + m)[fit]
        differ = spare - self.shared[i] - self.shared[j] + np.bitwise_count(self.sketches[i] ^ self.sketches[j]).sum(1, dtype=np.int64)
        return keep[spare - 2 * need >= differ]

    def pairs(self, first: int, last: int) -> np.ndarray:
        """Pivots at places first to last (exclusive) of the lists, with hopeful later members: pivot * members + member."""
        out, start, end = [np.zeros(0, np.int64)], self.start, self.end
        for k in range(first, last):
            live = end - start > k + 1
            start, end = start[live], end[live]
            if not len(start):
                break
            size = end - start - k - 1
            total = int(size.sum())
            upto = np.cumsum(size)
            for a in range(0, total, CHUNK_PAIRS):
                each = np.arange(a, min(total, a + CHUNK_PAIRS))
                of = np.searchsorted(upto, each, "right")
                p, q = start[of] + k, end[of] - upto[of] + each
                fit = self.hopeful(p, q)
                out.append(np.unique(self.at[p[fit]] * len(self.heads) + self.at[q[fit]]))
        return np.unique(np.concatenate(out))

    def open(self, last: int) -> np.ndarray:
        """Members of lists that hold several roots from place last on: those are to be looked at again."""
        found = [np.zeros(0, np.int64)]
        for a, z in zip(self.start, self.end):
            if z - a > last + 1:
                root = self.root[self.at[a + last : z]]
                if (root != root[0]).any():
                    found.append(self.at[a:z])
        return np.unique(np.concatenate(found))


PAIR = "pivot binary, member binary"


def list_pairs(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """Pairs of different roots, pivots at places first to last of their lists; members to be looked at again have a null pivot."""

    def run(t: pa.Table) -> pa.Table:
        x = Lists(t)
        # at first each set is a root of its own: every list would be looked at again
        pair, again = x.pairs(first, last), x.open(last) if first else np.zeros(0, np.int64)
        heads = [h.tobytes() for h in x.heads]
        rows = [(heads[k // len(heads)], heads[k % len(heads)]) for k in pair.tolist()]
        return _table([*rows, *((None, heads[k]) for k in again.tolist())], "pivot member", [pa.binary()] * 2)

    return blocks.groupBy("shard").applyInArrow(run, PAIR).distinct()


class Tree:
    """Prefix tree of sets of ranks in the global order.

    Held as the sets in lexicographic order, each with the depth at which its path
    leaves the one before: a walk along it visits every node of the tree once.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.common = [0] * len(sets)
        for k, (i, j) in enumerate(zip(self.order, self.order[1:]), 1):
            n = min(len(sets[i]), len(sets[j]))
            differ = np.flatnonzero(sets[i][:n] != sets[j][:n])
            self.common[k] = int(differ[0]) if len(differ) else n

    def similar(self, probe: np.ndarray, size: int, ranks: int) -> list[int]:
        """Sets similar to the probe, a set of ranks below `ranks`. size: of the whole set, unshared shingles included."""
        has = np.zeros(ranks, bool)
        has[probe] = True
        ahead = len(probe) - np.cumsum(has)  # what the probe still has after a rank
        overlap, rest = np.zeros(1, np.int64), np.full(1, len(probe))  # by depth, along the path at hand
        out = []
        for i, depth in zip(self.order, self.common):
            s, need = self.sets[i], least_overlap(size, self.sizes[i])
            depth = min(depth, len(overlap) - 1)
            overlap, rest = overlap[: depth + 1], rest[: depth + 1]
            if overlap[depth] + min(rest[depth], len(s) - depth) < need:
                continue  # the whole subtree below is cut off for this set
            tail = s[depth:]
            overlap = np.concatenate([overlap, overlap[depth] + np.cumsum(has[tail])])
            rest = np.concatenate([rest, ahead[tail]])
            short = np.flatnonzero(overlap + np.minimum(rest, len(s) - np.arange(len(overlap))) < need)
            if len(short):
                overlap, rest = overlap[: short[0] + 1], rest[: short[0] + 1]
            else:
                out.append(i)  # at the end nothing remains: the overlap itself reaches what is needed
        return out


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (pivot, member) pairs whose sets are similar, as (a, b). Of the sets, only those in pairs are shuffled."""
    ends = key_filter(pairs.select("pivot").unionAll(pairs.select("member")))
    slices = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices")).withColumnRenamed("pivot", "p")
    slices = stored(slices, shared_dir(sets.sparkSession))
    of_member = maybe_among(sets, "digest", ends).select(F.col("digest").alias("d"), F.col("n").alias("m"), "items")
    members = pairs.join(slices, F.col("pivot") == F.col("p")).withColumn("slice", F.pmod(F.xxhash64("member"), "slices")).select("pivot", "member", "slice")
    members = members.join(of_member, F.col("member") == F.col("d")).select("pivot", "slice", "member", "m", "items")
    pivots = slices.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    pivots = pivots.join(of_member, F.col("p") == F.col("d")).select(F.col("p").alias("pivot"), "slice", F.lit(None).cast("binary").alias("member"), "m", "items")

    def run(t: pa.Table) -> pa.Table:
        rows = list(_columns(t, "pivot member m items"))
        each = [np.frombuffer(r[3], ITEM) for r in rows]
        every = np.concatenate(each)
        s, df = every["s"].astype(np.uint64), every["df"].astype(np.uint16)
        order = np.lexsort((s, df))
        new = np.concatenate([[False], (s[order][1:] != s[order][:-1]) | (df[order][1:] != df[order][:-1])])
        rank = np.empty(len(s), np.int64)
        rank[order] = np.cumsum(new)
        sets = np.split(rank, np.cumsum([len(x) for x in each])[:-1])
        probe = next((k for k, r in enumerate(rows) if r[1] is None), None)
        others = [k for k, r in enumerate(rows) if r[1] is not None]
        hits = []
        if probe is not None and others:
            hits = Tree([sets[k] for k in others], [rows[k][2] for k in others]).similar(sets[probe], rows[probe][2], int(rank.max()) + 1)
        return _table([(rows[0][0], rows[others[k]][1]) for k in hits], "a b", [pa.binary()] * 2)

    return members.unionByName(pivots).groupBy("pivot", "slice").applyInArrow(run, "a binary, b binary")


def components(edges: DataFrame, top: str) -> DataFrame:
    """(node, root) of all ends of edges (a, b); root: the least node of the component.

    Each round hooks a node, and its parent, to the least grandparent among neighbours and
    itself; the number of rounds grows with the logarithm of the diameter.
    """
    both = stored(edges.unionAll(edges.select("b", "a")), f"{top}/edges")
    f = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("f")), f"{top}/f0")
    for k in itertools.count(1):
        up = f.select(F.col("v").alias("u"), F.col("f").alias("g"))
        grand = stored(f.join(up, F.col("f") == F.col("u")).select("v", "f", "g"), f"{top}/g{k}")
        best = both.join(grand.select(F.col("v").alias("u"), F.col("g")), F.col("b") == F.col("u")).groupBy("a").agg(F.min("g").alias("m"))
        near = grand.join(best, F.col("v") == F.col("a"))
        none = F.lit(None).cast("binary")
        hooks = F.array(F.struct(F.col("f").alias("v"), F.col("m").alias("new"), none.alias("was")), F.struct(F.col("v").alias("v"), F.least("m", "g").alias("new"), F.col("f").alias("was")))
        f = near.select(F.explode(hooks).alias("h")).groupBy("h.v").agg(F.min("h.new").alias("f"), F.max("h.was").alias("was"))
        f = stored(f, f"{top}/f{k}")
        if not f.where("f <> was").head(1):
            return f.select(F.col("v").alias("node"), F.col("f").alias("root"))


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, digest, root), one row for each row of docs.

    component_id: the least id that links lead to, the row's own included; null ids count
    only where there is no other. Rows without a word have an empty set and are linked
    with nothing: each is its own component, digest and root null. Rows with equal sets,
    repeated rows included, are in one component; root names it.
    """
    spark, top = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = stored(described(docs, id_col, text_col), f"{top}/rows")
    total, n_rows = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(LEAST_SHARDS, -(-total // SHARD_SHINGLES))
    sets = candidates(shared_shingles(packed(docs, text_col, shards)))
    sets = stored(sets.dropDuplicates(["digest"]), f"{top}/sets")
    roots = _settled(spark, sets, top, max(LEAST_SHARDS, partitions, shards // 8))
    classes = stored(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times")), f"{top}/least")
    classes = classes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    classes = stored(classes.select("digest", "least", "times", "root"), f"{top}/classes")
    of_root = classes.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    of_root = stored(of_root, f"{top}/of_root")
    named = with_group(classes, of_root, F.col("root") == F.col("r"), "members", n_rows)
    named = stored(named.select(F.col("digest").alias("d"), "times", "root", "component_id"), f"{top}/named")
    out = with_group(rows.where("digest is not null"), named, F.col("digest") == F.col("d"), "times", n_rows)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "digest", "root")
    none = F.lit(None).cast("binary")
    return out.unionByName(rows.where("digest is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "digest", none.alias("root")))


def _settled(spark: SparkSession, sets: DataFrame, top: str, shards: int) -> DataFrame:
    """(node, root) of all sets that have a link."""
    chosen, roots, first, last = prefixes(sets).withColumn("root", F.col("digest")), None, 0, 1
    for k in itertools.count(1):
        found = stored(list_pairs(postings(chosen, shards), first, last), f"{top}/found{k}")
        pairs, again = found.where("pivot is not null"), found.where("pivot is null")
        if pairs.head(1):
            links = stored(linked(pairs, sets), f"{top}/links{k}")
            if roots is not None:  # links between components
                for end in ("a", "b"):
                    of = roots.select(F.col("node").alias("n"), F.col("root").alias("r"))
                    links = links.join(of, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("r", end)).drop("n", "r")
                links = stored(links.distinct(), f"{top}/links{k}r")
            if links.head(1):
                merged = components(links, f"{top}/cc{k}")
                if roots is not None:
                    of = merged.select(F.col("node").alias("n"), F.col("root").alias("r"))
                    moved = roots.join(of, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"))
                    merged = moved.unionAll(merged).distinct()
                roots = stored(merged, f"{top}/roots{k}")
        if first and not again.head(1):
            break
        chosen = prefixes(sets)
        if first:
            again = again.select(F.col("member").alias("m"))
            chosen = maybe_among(chosen, "digest", key_filter(again)).join(again, F.col("digest") == F.col("m"), "left_semi")
        if roots is not None:
            chosen = chosen.join(roots, F.col("digest") == F.col("node"), "left").drop("node")
            chosen = chosen.withColumn("root", F.coalesce("root", "digest"))
        else:
            chosen = chosen.withColumn("root", F.col("digest"))
        first, last = last, last * WINDOW_GROWTH
    return roots if roots is not None else spark.createDataFrame([], "node binary, root binary")


def with_digest(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """docs with the digest of each row's set, null for rows without a word."""
    texts_to_python(docs.sparkSession)
    place, names = docs.columns.index(text_col), [*docs.columns, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s := shingles(t)) else None for t in _texts(b, place)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.binary())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.BinaryType())]))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the least id (null ids last), and all rows without a word.

    Rows of one id and set count as one. Only the rows that go are joined, by set and id:
    they are broadcast if they are few (they are counted), so that texts are not shuffled.
    """
    top = shared_dir(docs.sparkSession)
    found = joined(docs, id_col, text_col).where("digest is not null")
    keys = stored(found.groupBy("root", "digest", "doc_id").agg(F.count(F.lit(1)).alias("times")), f"{top}/keys")
    first = keys.groupBy(F.col("root").alias("r")).agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("digest").alias("d"))).alias("k"), F.count(F.lit(1)).alias("members"))
    first = stored(first, f"{top}/first")
    ranked = with_group(keys, first, F.col("root") == F.col("r"), "members", keys.count()).withColumn("stays", (F.col("digest") == F.col("k.d")) & F.col("doc_id").eqNullSafe(F.col("k.id")))
    mark, k_id, k_d = (unused(x, docs.columns) for x in ("_set_digest", "_key_id", "_key_digest"))
    ranked = stored(ranked.where(~F.col("stays") | (F.col("times") > 1)).select(F.col("doc_id").alias(k_id), F.col("digest").alias(k_d), "stays"), f"{top}/ranked")
    gone, tied = ranked.where(~F.col("stays")).drop("stays"), ranked.where("stays").drop("stays")

    def side(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if t.count() <= BROADCAST_KEYS else t

    rows = with_digest(docs, text_col, mark)
    key = (F.col(mark) == F.col(k_d)) & rows[f"`{id_col}`"].eqNullSafe(F.col(k_id))
    left = rows.join(side(gone), key, "left_anti")
    if tied.head(1):  # rows that repeat id and set: any of them stands for all
        left = left.join(side(tied), key, "left_anti").unionByName(rows.join(side(tied), key, "left_semi").dropDuplicates([mark]))
    return left.drop(mark)
