"""Operator 8: n-gram Jaccard join with signature trees.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents with equal sets form a class. The hash
space is cut into equal pieces, one and a half times as many as the members by which two similar sets of about that size
may differ. Each such member changes one piece, so similar sets agree in the whole content of more than a third of the
pieces, and in one of those that stay when a third of the pieces, the last ones of a common order, is left out. The
postings of the pieces route the classes to trees; one root over the whole corpus would compare all blocks with all. A
piece holds several members, so however frequent each of them is, unlike documents seldom agree in one. Where the
similarity is so low that pieces would hold about one member, the members that the prefix bound asks for are posted.

Postings travel as columns, one row for each task and hash range, and every task reduces what it holds before the
shuffle: copies post once, and of a member or piece that many classes share only a few postings leave the task, the
others being linked there.

Within a tree the classes are sorted by size and hierarchical nodes hold OR-combined bitmaps of their members and size
ranges; a dual traversal drops node pairs whose largest possible overlap is too small, and what remains is checked
exactly. A tree that is too large for one task is joined in two steps. First its classes meet in groups of equal
minimum hashes, split to a bounded size; that links nearly all that is similar, with a fixed number of copies of a set.
Then the classes are dealt into blocks that are uniform in what they are linked to, a traversal over the blocks' nodes
names the pairs of blocks that may still hold a link between different parts, and only those meet. Each task returns a
spanning forest of its links, never all pairs.

Pieces of more members come first; members by rarity, estimated from the frequencies of their words, which a fixed-size
counter array holds for all documents. Any common order keeps the result exact. A passage that many unlike documents
quote may fill whole pieces, has rare words but frequent members, and would link all who quote it into one tree. So where
a tree becomes large, what many classes were found to share moves to the end of the order, and the postings of the large
trees' classes, no others, are dealt out anew: what is similar shares a tree in any order.

Defined cases: null and empty texts have no set, are linked with nothing and are their own component; texts with fewer
words than n have their whole word sequence as the only member; repeated rows are copies; rows that share a doc_id are
one document; a null doc_id gives a null component of its own rows unless another id is linked; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, drop, free_shuffles, slices, splitmix, stash, trim
from .graph import components, stars


@dataclass(frozen=True)
class JoinConfig:
    n: int = 5
    #: the least similarity, in hundredths
    percent: int = 80
    counters: int = 1 << 20
    counter_slices: int = 64
    #: classes, and members of their sets, that one task joins at most.
    most_leaves: int = 1536
    most_members: int = 3_000_000
    #: at this similarity (in hundredths) and above, pieces are posted; below, members.
    pieces_from: int = 75
    #: members that at most so many classes share are counted pair by pair; beyond, all their classes share a tree.
    small_group: int = 64
    #: how often members of larger groups are moved to the end of the order, and how many of them are broadcast, at most;
    #: both bound the work of finding a better order, not the result.
    reorders: int = 3
    most_heavy: int = 2_000_000
    #: postings that a task holds before it deals them out, and postings of a hash range.
    flush: int = 1_000_000
    range_size: int = 500_000
    #: independent minimum hashes by which the classes of a large tree meet first.
    passes: int = 3
    leaf: int = 16
    fan: int = 8
    #: rows that are broadcast, at most; above, the join shuffles. Of ids alone more are, to leave other rows out before it.
    broadcast_rows: int = 200_000
    broadcast_ids: int = 10_000_000
    memo_words: int = 150_000


NONE = np.zeros(0, np.uint64)

#: The member of a posting travels as its upper 48 bits: one that equals another there only adds a candidate.
MEMBER_BYTES = 6


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


class Shingler:
    """Sorted distinct n-gram hashes of UTF-8 texts."""

    def __init__(self, cfg: JoinConfig):
        self.cfg, self.seen, self.cuts = cfg, _Hashes(), {}
        self.mult = splitmix(np.arange(1, 1 + max(cfg.n, 2), dtype=np.uint64)) | np.uint64(1)

    def words(self, text: bytes | None) -> np.ndarray:
        # bytes.lower() changes A-Z alone, bytes.split() cuts at blanks and 0x09-0x0D alone.
        words = text.lower().split() if text else []
        if len(self.seen) > self.cfg.memo_words:
            self.seen.clear()
        return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))

    def _windows(self, h: np.ndarray) -> np.ndarray:
        n = min(self.cfg.n, len(h))
        size = len(h) - n + 1
        out = h[:size] * self.mult[0] + np.uint64(n)
        for j in range(1, n):
            out += h[j : j + size] * self.mult[j]
        return splitmix(out)

    def members(self, h: np.ndarray) -> np.ndarray:
        return np.unique(self._windows(h)) if len(h) else h

    def rarest(self, h: np.ndarray, level: np.ndarray, heavy: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
        """All members, and the rarest ones by the frequencies of their words, the sorted ``heavy`` ones last: as many as
        the prefix bound asks for."""
        m, first = np.unique(self._windows(h), return_index=True)
        keep = len(m) - -(-self.cfg.percent * len(m) // 100) + 1
        if keep >= len(m):
            return m, m
        each = level[(h & np.uint64(self.cfg.counters - 1)).astype(np.int64)].astype(np.uint64)
        n = min(self.cfg.n, len(h))
        size = len(h) - n + 1
        least, total = each[:size].copy(), each[:size].copy()
        for j in range(1, n):
            least = np.minimum(least, each[j : j + size])
            total += each[j : j + size]
        # A member is no more frequent than its rarest word. Ties by all its words, then by hash: the order is the same
        # for every document.
        order = (least[first] << np.uint64(54)) | (total[first] << np.uint64(42)) | (m >> np.uint64(22))
        if len(heavy):
            # The reader of postings knows a member by its upper bytes. Seldom are all of a set's members heavy.
            short = m >> np.uint64(64 - 8 * MEMBER_BYTES)
            last = heavy[np.minimum(np.searchsorted(heavy, short), len(heavy) - 1)] == short
            order = (order >> np.uint64(1)) | (last.astype(np.uint64) << np.uint64(63))
        return m, m[np.argpartition(order, keep - 1)[:keep]]

    def _cut(self, band: int, differ: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of a band begin, and a number for each."""
        if band not in self.cuts:
            n = differ + 1 + -(-(differ + 1) // 2)
            at = np.arange(n, dtype=np.uint64)
            starts = (((at << np.uint64(32)) + np.uint64(n - 1)) // np.uint64(n)) << np.uint64(32)
            self.cuts[band] = starts, splitmix((at << np.uint64(32)) + np.uint64(band))
        return self.cuts[band]

    def pieces(self, m: np.ndarray, heavy: np.ndarray = NONE) -> np.ndarray:
        """Hashes of the first pieces of a set of sorted members, the sorted ``heavy`` ones last: one more than two
        similar sets may differ by, in each band of sizes that the smaller of them may be of."""
        out, sums = [NONE], np.r_[np.uint64(0), np.cumsum(splitmix(m))]
        for band, differ in _bands(len(m), self.cfg.percent):
            starts, salt = self._cut(band, differ)
            at = np.r_[np.searchsorted(m, starts), len(m)]
            piece = splitmix(np.diff(sums[at]) + salt)
            last = np.zeros(len(piece), np.uint64)
            if len(heavy):
                short = piece >> np.uint64(64 - 8 * MEMBER_BYTES)
                last = (heavy[np.minimum(np.searchsorted(heavy, short), len(heavy) - 1)] == short).astype(np.uint64)
            held = np.minimum(np.diff(at), 255).astype(np.uint64)
            order = (last << np.uint64(63)) | ((np.uint64(255) - held) << np.uint64(55)) | (piece >> np.uint64(9))
            out.append(piece[np.argpartition(order, differ)[: differ + 1]])
        return np.concatenate(out)


@lru_cache(100_000)
def _bands(size: int, percent: int) -> list[tuple[int, int]]:
    """The bands of sizes, by their least, that the smaller of two similar sets may be of when one has this size, and by
    how many members at most the two may differ; bands without unlike sets are left out."""
    out, low = [], 1
    while low <= size:
        past = max(low + 1, low * 7 // 5)
        most = past - 1
        differ = (most + 100 * most // percent) * (100 - percent) // (100 + percent)
        if 100 * most >= percent * size and differ:
            out.append((low, differ))
        low = past
    return out


def _name(members: np.ndarray) -> int:
    """A class's name: a hash of its whole set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes()))))


def profile(docs: DataFrame, cfg: JoinConfig) -> DataFrame:
    """(doc_id, n, class, slot, counts): a row for each document, and each task's counters in slices."""

    def part(batches):
        shingler, counts, waiting, size = Shingler(cfg), np.zeros(cfg.counters, np.uint32), [], 0

        def add():
            if waiting:
                counts[:] += np.bincount((np.concatenate(waiting) & np.uint64(cfg.counters - 1)).astype(np.int64), minlength=cfg.counters).astype(np.uint32)
                waiting.clear()

        for b in batches:
            n, names = [], []
            for text in b.column(1).to_pylist():
                h = shingler.words(text)
                m = shingler.members(h)
                n.append(len(m))
                names.append(_name(m) if len(m) else None)
                if cfg.percent >= cfg.pieces_from:
                    continue  # their order asks for no counters
                waiting.append(h)
                size += len(h)
                if size > 500_000:
                    add()
                    size = 0
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], ["doc_id", "n", "class", "slot", "counts"])
        add()
        if counts.any():
            cut = np.array_split(counts, cfg.counter_slices)
            none = pa.array([None] * len(cut), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(len(cut)), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], ["doc_id", "n", "class", "slot", "counts"])
        del counts, shingler
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"))
    return stash(rows.mapInArrow(part, "doc_id long, n long, class long, slot int, counts binary"), "join-profile")


def _counters(profile: DataFrame, cfg: JoinConfig) -> np.ndarray:
    """How often the words of each counter occur, as sixteenths of the logarithm."""

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint32).astype(np.uint64)
                sums[slot] = sums[slot] + x if slot in sums else x
        for slot, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slot", "counts"])

    # The slices of each counter range meet in one partition; a task there holds sums only.
    dealt = profile.where("slot is not null").select("slot", "counts").repartition("slot")
    rows = dealt.mapInArrow(total, "slot int, counts binary").collect()
    parts = {r.slot: np.frombuffer(r.counts, np.uint64) for r in rows}
    if not parts:
        return np.zeros(cfg.counters, np.uint16)
    counts = np.concatenate([parts[i] for i in range(cfg.counter_slices)])
    return np.minimum(np.log2(counts + 1.0) * 16, min(1023, 4095 // cfg.n)).astype(np.uint16)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The upper bytes of numbers, place by place: sorted numbers share the highest, which the shuffle compresses."""
    return x.view(np.uint8).reshape(len(x), x.itemsize)[:, x.itemsize - width :].T.tobytes()


def _unplanes(x: bytes, kind, width: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((len(x) // width, size), np.uint8)
    out[:, size - width :] = np.frombuffer(x, np.uint8).reshape(width, -1).T
    return out.view(kind).ravel()


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(x)])


def _order(member: np.ndarray, name: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct postings by member, then class."""
    by = np.lexsort((name, member))
    member, name, size = member[by], name[by], size[by]
    if len(member):
        new = np.r_[True, (member[1:] != member[:-1]) | (name[1:] != name[:-1])]
        member, name, size = member[new], name[new], size[new]
    return member, name, size


POSTING = "deal int, kind int, a binary, b binary, c binary"


def _of(batch: pa.RecordBatch, ids: np.ndarray | None) -> pa.RecordBatch:
    """The rows whose id, their second column, is one of the sorted ids; without ids, all rows."""
    if ids is None:
        return batch
    own = batch.column(1).to_numpy()
    return batch.filter(pa.array(ids[np.minimum(np.searchsorted(ids, own), len(ids) - 1)] == own if len(ids) else np.zeros(len(own), bool)))


def postings(docs: DataFrame, levels: np.ndarray, heavy: np.ndarray, ids: np.ndarray | None, ranges: int, cfg: JoinConfig) -> DataFrame:
    """Columns of postings by hash range (kind 0: members or pieces, classes, set sizes), and of links between classes
    that share one with many others in the task (kind 1: hub, class). With sorted ids, of these documents only."""
    shared = docs.sparkSession.sparkContext.broadcast((levels, heavy, ids))

    def deal(found, names, sizes):
        each = [len(x) for x in found]
        member, name, size = _order(np.concatenate(found), np.repeat(np.array(names, np.int64), each), np.repeat(np.array(sizes, np.int32), each))
        starts, lengths = _runs(member)
        rank = np.arange(len(member)) - np.repeat(starts, lengths)
        # Of a group of many classes the first few stand for all: enough for the reader to see that it is large.
        spare = rank > cfg.small_group
        if spare.any():
            hub = np.repeat(name[starts], lengths)
            u, v = stars(hub[spare], name[spare])
            at = int(v[0] % ranges) if len(v) else 0
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([1], pa.int32()), pa.array([u.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["deal", "kind", "a", "b", "c"])
            member, name, size = member[~spare], name[~spare], size[~spare]
        place = ((member >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        starts, lengths = _runs(place)
        for lo in range(0, len(starts), 256):
            cut = [slice(s, s + n) for s, n in zip(starts[lo : lo + 256].tolist(), lengths[lo : lo + 256].tolist(), strict=True)]
            cols = [pa.array([_planes(x[i], w) for i in cut], pa.binary()) for x, w in ((member, MEMBER_BYTES), (name, 8), (size, 4))]
            yield pa.RecordBatch.from_arrays([pa.array([int(place[i.start]) for i in cut], pa.int32()), pa.array([0] * len(cut), pa.int32()), *cols], ["deal", "kind", "a", "b", "c"])

    def part(batches):
        shingler, (level, last, some), whole = Shingler(cfg), shared.value, cfg.percent >= cfg.pieces_from
        done: set[int] = set()
        found, names, sizes, held = [], [], [], 0
        for b in batches:
            for text in _of(b, some).column(0).to_pylist():
                h = shingler.words(text)
                if not len(h):
                    continue
                m, rare = (shingler.members(h), NONE) if whole else shingler.rarest(h, level, last)
                if 100 * len(m) < cfg.percent * (len(m) + 1):
                    continue  # a set that is like no other than itself
                if (name := _name(m)) in done:
                    continue
                done.add(name)  # copies in one task post once
                if whole:
                    rare = shingler.pieces(m, last)
                found.append(rare)
                names.append(name)
                sizes.append(len(m))
                held += len(rare)
                if held > cfg.flush:
                    yield from deal(found, names, sizes)
                    found, names, sizes, held = [], [], [], 0
            if len(done) > 200_000:
                done.clear()
        if found:
            yield from deal(found, names, sizes)
        del found, names, sizes, shingler, done
        trim()

    docs = docs.select(F.col("text").cast("binary"), F.col("doc_id").cast("long").alias("id"))
    return (docs if ids is None else docs.where("id is not null")).mapInArrow(part, POSTING)


def _meet(table: pa.Table, cfg: JoinConfig) -> pa.Table:
    """Columns (u, v, p, q, common) of one hash range: pairs of classes of like size, their sizes and the number of
    members that both share with few others; with common 0, links between the classes of a member that many share; with
    common -1, that member (u, by its upper bytes) and the number of its classes here (v). Pieces are not counted: the
    classes of one are linked in the order of their sizes, and a spanning forest of all links is left."""
    kind = table.column("kind").to_numpy()
    a, b, c = (table.column(x).to_pylist() for x in "abc")
    posts, links = np.flatnonzero(kind == 0).tolist(), np.flatnonzero(kind == 1).tolist()
    kinds = ((np.uint64, MEMBER_BYTES), (np.int64, 8), (np.int32, 4))
    cols = [np.concatenate([np.zeros(0, k), *(_unplanes(x[i], k, w) for i in posts)]) for (k, w), x in zip(kinds, (a, b, c), strict=True)]
    member, name, size = _order(*cols)
    starts, lengths = _runs(member)
    own = np.repeat(lengths, lengths)
    big = own > cfg.small_group
    u = [np.repeat(name[starts], lengths)[big], *(np.frombuffer(a[i], np.int64) for i in links)]
    v = [name[big], *(np.frombuffer(b[i], np.int64) for i in links)]
    crowd = lengths > cfg.small_group
    many, wide = (member[starts[crowd]] >> np.uint64(64 - 8 * MEMBER_BYTES)).astype(np.int64), lengths[crowd].astype(np.int64)
    few = (own > 1) & ~big
    own, name, size, member = own[few], name[few], size[few], member[few]
    if cfg.percent >= cfg.pieces_from:
        # If two sizes are alike, so are all between them: neighbours link what all pairs of like size would.
        by = np.lexsort((size, member))
        x, y = size[by[:-1]].astype(np.int64), size[by[1:]].astype(np.int64)
        near = np.flatnonzero((member[by[:-1]] == member[by[1:]]) & (100 * x >= cfg.percent * y))
        u.append(name[by[near]])
        v.append(name[by[near + 1]])
        own, name, size, member = own[:0], name[:0], size[:0], member[:0]
    u, v = stars(np.concatenate(u), np.concatenate(v))
    tables, held = [], 0
    # A slice holds whole groups, so that no more than a bounded number of pairs is in memory.
    lo = 0
    while lo < len(member):
        hi = min(len(member), lo + 40_000)
        hi = lo + int(np.searchsorted(member[lo:], member[hi - 1], "right")) if hi < len(member) else hi
        m, s, left, right = member[lo:hi], size[lo:hi], [], []
        for gap in range(1, int(own[lo:hi].max())):
            i = np.flatnonzero(m[gap:] == m[:-gap])
            x, y = s[i].astype(np.int64), s[i + gap].astype(np.int64)
            i = i[100 * np.minimum(x, y) >= cfg.percent * np.maximum(x, y)]
            left.append(lo + i)
            right.append(lo + i + gap)
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        tables.append((name[i], name[j], size[i], size[j], np.ones(len(i), np.int32)))
        held += len(i)
        if held > 2_000_000:
            tables = [_summed(tables)]
            held = len(tables[0][0])
        lo = hi
    u, v, none = np.concatenate([u, many]), np.concatenate([v, wide]), np.zeros(len(u) + len(many), np.int32)
    kinds = np.repeat(np.array([0, -1], np.int32), [len(none) - len(many), len(many)])
    found = _summed([*tables, (name[:0], name[:0], size[:0], size[:0], kinds[:0])])
    return pa.table([pa.array(np.concatenate(x)) for x in zip((u, v, none, none, kinds), found, strict=True)], ["u", "v", "p", "q", "common"])


def _summed(tables: list[tuple]) -> tuple:
    """Pairs (u, v, p, q, common) with their counts summed."""
    u, v, p, q, common = (np.concatenate(x) for x in zip(*tables, strict=True))
    by = np.lexsort((v, u))
    u, v = u[by], v[by]
    new = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(by) else np.zeros(0, np.int64)
    return u[new], v[new], p[by[new]], q[by[new]], np.add.reduceat(common[by], new).astype(np.int32) if len(by) else common


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def _need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes at the similarity."""
    return -(-percent * (a + b) // (100 + percent))


class SignatureTree:
    """Nodes over sets sorted by size: OR-combined bitmaps, size ranges, and how many members bits may hide."""

    def __init__(self, sets: list[np.ndarray], percent: int, leaf: int, fan: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bits = int(min(1 << 15, max(256, 1 << int(np.ceil(np.log2(4 * self.sizes.max()))))))
        self.words = bits // 64
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            row = np.zeros(bits, bool)
            row[at] = True
            maps[i] = np.packbits(row)
        self.maps = maps.view(np.uint64)
        self.hidden = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        #: levels from the leaves up: bitmaps, least and largest size, most hidden members, first child, past last
        self.levels = []
        maps, low, high, hidden, step = self.maps, self.sizes, self.sizes, self.hidden, leaf
        while True:
            starts = np.arange(0, len(low), step)
            ends = np.minimum(starts + step, len(low))
            maps = np.bitwise_or.reduceat(maps, starts, axis=0)
            low, high, hidden = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(hidden, starts)
            self.levels.append((maps, low, high, hidden, starts, ends))
            if len(starts) == 1:
                break
            step = fan

    def _fits(self, level, p, q):
        maps, low, high, hidden, *_ = level
        ok = (100 * high[p] >= self.percent * low[q]) & (100 * high[q] >= self.percent * low[p])
        p, q = p[ok], q[ok]
        most = np.concatenate([np.bitwise_count(maps[p[i : i + 512]] & maps[q[i : i + 512]]).sum(1, dtype=np.int64) for i in range(0, len(p), 512)] or [np.zeros(0, np.int64)])
        ok = most + np.minimum(hidden[p], hidden[q]) >= _need(low[p], low[q], self.percent)
        return p[ok], q[ok]

    def leaf_pairs(self):
        """Pairs of leaves (p <= q) that the dual traversal cannot rule out."""
        p = q = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            p, q = self._fits(self.levels[depth], p, q)
            if depth == 0:
                break
            *_, starts, ends = self.levels[depth]
            kids = [(a, b) for x, y in zip(p.tolist(), q.tolist(), strict=True) for a in range(starts[x], ends[x]) for b in range(max(a, starts[y]), ends[y])]
            p, q = (np.array(x, np.int64) for x in (zip(*kids, strict=True) if kids else ((), ())))
        order = np.argsort(q - p, kind="stable")
        return p[order], q[order]

    def links(self, part: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """A spanning forest of the links. Sets of one part are linked already; with side, only sets of different sides
        are compared."""
        forest, out = _Forest(len(self.sets)), []
        if part is not None:
            _, first, at = np.unique(part, return_index=True, return_inverse=True)
            forest.up = first[at].tolist()
        *_, starts, ends = self.levels[0]
        step = max(1, (1 << 22) // (self.words * 256))
        p, q = self.leaf_pairs()
        for lo in range(0, len(p), step):
            roots = forest.roots()
            ij = [np.array(np.meshgrid(np.arange(starts[x], ends[x]), np.arange(starts[y], ends[y]), indexing="ij")).reshape(2, -1) for x, y in zip(p[lo : lo + step], q[lo : lo + step], strict=True)]
            i, j = np.concatenate(ij, axis=1)
            ok = (i < j) & (roots[i] != roots[j])
            ok &= (100 * self.sizes[i] >= self.percent * self.sizes[j]) & (100 * self.sizes[j] >= self.percent * self.sizes[i])
            if side is not None:
                ok &= side[i] != side[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            both = np.bitwise_count(self.maps[i] & self.maps[j]).sum(1, dtype=np.int64)
            need = _need(self.sizes[i], self.sizes[j], self.percent)
            most = both + np.minimum(self.hidden[i], self.hidden[j])
            ok = np.flatnonzero(most >= need)
            for k in ok[np.argsort(need[ok] - most[ok], kind="stable")].tolist():
                a, b = int(i[k]), int(j[k])
                if forest.root(a) == forest.root(b):
                    continue
                x, y = self.sets[a], self.sets[b]
                if len(np.intersect1d(x, y, assume_unique=True)) >= need[k]:
                    forest.up[forest.root(a)] = forest.root(b)
                    out.append((a, b))
        return out


def _links(group: pd.DataFrame, cfg: JoinConfig, parted: bool = False) -> list[tuple[int, int]]:
    """Links between the rows (rep, name, members) that meet; parted: rows of one ``part`` are linked already, and rows of one ``side`` do not meet."""
    group = group.drop_duplicates(["rep", "name"])
    sets = [np.frombuffer(x, np.uint64) for x in group.members]
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0]))
    sets, reps = [sets[i] for i in order], group.rep.to_numpy()[order]
    out = []
    if len(sets) == 2:
        (x, y), need = sets, int(_need(np.int64(len(sets[0])), np.int64(len(sets[1])), cfg.percent))
        out = [(0, 1)] if len(np.intersect1d(x, y, assume_unique=True)) >= need else []
    elif len(sets) > 2:
        part = group.part.to_numpy()[order] if parted else None
        side = group.side.to_numpy()[order] if parted else None
        if side is not None and (side == side[0]).all():
            side = None
        out = SignatureTree(sets, cfg.percent, cfg.leaf, cfg.fan).links(part, side)
    return [(int(reps[a]), int(reps[b])) for a, b in out]


def _meetings(met: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Edges (u, v) between classes that must share a tree.

    If a pair reaches the similarity, the prefix whose range ends first is short of the other set by no more members
    than the whole set may be; so the pair shares at least ``need + 1 - ceil(percent * size)`` prefix members. Members
    of few classes are counted pair by pair (a bounded number for each) and pairs below that number go. The classes of
    a member that more share are linked, whatever their counts. A piece that two classes share is enough.
    """
    if cfg.percent >= cfg.pieces_from:
        return met.where("common >= 0").select("u", "v")
    pairs = met.where("common > 0").groupBy("u", "v").agg(F.min("p").alias("a"), F.min("q").alias("b"), F.sum("common").alias("common"))
    p = cfg.percent
    up = lambda x, d: F.expr(f"({x} + {d} - 1) div {d}")
    need, most = up(f"{p} * (a + b)", 100 + p), F.greatest(up(f"{p} * a", 100), up(f"{p} * b", 100))
    fits = (100 * F.least("a", "b") >= p * F.greatest("a", "b")) & (F.col("common") >= need + 1 - most)
    return met.where("common = 0").select("u", "v").unionAll(pairs.where(fits).select("u", "v"))


def _ids(some: DataFrame) -> np.ndarray:
    """The sorted ids of the documents that stand for classes."""
    return np.unique(some.select("rep").toArrow().column(0).to_numpy())


def _sets(texts: DataFrame, some: DataFrame, rows: int, cfg: JoinConfig) -> DataFrame:
    """(rep, name, tree, members, keys) of the classes (rep, class, tree), at most so many, of texts (id, text): sorted
    members and minimum hashes of the set. Texts never shuffle: where the classes are not broadcast, sets do."""
    wide = rows > cfg.broadcast_rows
    ids = _ids(some) if wide and rows <= cfg.broadcast_ids else None
    shared = texts.sparkSession.sparkContext.broadcast(ids)
    seeds = splitmix(np.arange(900, 900 + cfg.passes, dtype=np.uint64))

    def part(batches):
        shingler, done, wanted = Shingler(cfg), set(), shared.value
        for b in batches:
            b, rows = _of(b, wanted), []
            for text, rep, name, tree in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if (rep, name) in done:
                    continue
                m = shingler.members(shingler.words(text))
                own = _name(m) if len(m) else None
                if len(m) and name in (own, None):  # rows that share a doc_id may hold other texts
                    name = own
                    done.add((rep, name))
                    rows.append((rep, name, tree, m.tobytes(), [int(splitmix(m ^ s).min().view(np.int64)) for s in seeds]))
            for lo, hi in slices([len(r[3]) for r in rows], 16_000_000):
                cols = list(zip(*rows[lo:hi], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(pa.int64()))], ["rep", "name", "tree", "members", "keys"])
        del shingler, done
        trim()

    form = "rep long, name long, tree long, members binary, keys array<long>"
    if not wide:
        return texts.join(F.broadcast(some), F.col("id") == F.col("rep")).select("text", "rep", "class", "tree").mapInArrow(part, form)
    none = F.lit(None).cast("long")
    found = texts.where("id is not null").select("text", F.col("id").alias("rep"), none.alias("class"), none.alias("tree")).mapInArrow(part, form)
    # The classes are hashed in memory, so that the sets need not be sorted.
    return found.drop("tree").join(some.select("rep", F.col("class").alias("name"), "tree").hint("shuffle_hash"), ["rep", "name"]).select("rep", "name", "tree", "members", "keys")


def _hinted(df: DataFrame, rows: int, cfg: JoinConfig) -> DataFrame:
    return F.broadcast(df) if rows <= cfg.broadcast_rows else df


def _join_by(rows: DataFrame, cfg: JoinConfig, parted: bool = False) -> DataFrame:
    """(u, v): links within the rows of each (deal, meeting); a deal is a bounded number of meetings in one task."""
    keep = ["rep", "name", "members", "deal", "meeting", *(("part", "side") if parted else ())]

    def join(group: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, g in group.groupby("meeting") for x in _links(g, cfg, parted)]
        trim()
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return rows.select(*keep).groupBy("deal").applyInPandas(join, "u long, v long").where("u <> v")


def _pieces(count, size, cfg: JoinConfig):
    """Into how many pieces so many sets with so many members are cut."""
    return F.greatest(F.ceil(count / F.lit(cfg.most_leaves / 2)), F.ceil(size / F.lit(cfg.most_members / 2))).cast("long")


def _large_trees(sets: DataFrame, cfg: JoinConfig) -> DataFrame:
    """(u, v): links within the trees that no single task can hold; see the module's text."""
    n = F.length("members") / 8
    keyed = sets.select("*", F.posexplode("keys").alias("pass", "key"))
    light = sets.select("tree", n.alias("n"), F.posexplode("keys").alias("pass", "key"))
    spread = light.groupBy("tree", "pass", "key").agg(F.count("*").alias("k"), F.sum("n").alias("m")).where(F.col("k") > 1)
    spread = stash(spread.select("tree", "pass", "key", "m", _pieces(F.col("k"), F.col("m"), cfg).alias("cuts")), "join-keys")
    shape = spread.agg(F.count("*").alias("rows"), F.sum("m").alias("m")).first()
    deals = max(1, int(shape.m or 0) // (cfg.most_members // 3) + 1)
    met = keyed.join(_hinted(spread.drop("m"), shape.rows, cfg), ["tree", "pass", "key"])
    met = met.withColumn("meeting", F.xxhash64("tree", "pass", "key", F.pmod(F.xxhash64("name", "pass"), F.col("cuts"))))
    first = stash(_join_by(met.withColumn("deal", F.when(F.col("cuts") > 1, F.col("meeting")).otherwise(F.pmod("meeting", F.lit(deals)))), cfg), "join-first")
    drop(spread)
    parts = components(first)
    ids = sets.select("rep", "tree", "name", n.alias("n"))
    count = parts.count()
    known = ids.join(_hinted(parts, count, cfg), F.col("rep") == F.col("id"), "left").select("rep", "name", "tree", "n", F.coalesce("root", "rep").alias("part"))
    known = stash(known, "join-parts")
    # Trees that are one part are done.
    trees = known.groupBy("tree").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("tree")
    left = known.join(trees, "tree", "left_semi")
    sums = left.groupBy("tree", "part").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    own = sums.where(F.col("k") >= cfg.most_leaves // 8).select("tree", F.col("part").alias("__part"), _pieces(F.col("k"), F.col("m"), cfg).alias("cuts"))
    own = stash(own, "join-own")
    placed = left.join(_hinted(own, own.count(), cfg).withColumnRenamed("tree", "__tree"), (F.col("tree") == F.col("__tree")) & (F.col("part") == F.col("__part")), "left")
    # Parts of many classes have blocks of their own; the others share blocks with sets of about their size.
    band = F.floor(F.log("n") / F.log(F.lit(1.12)))
    placed = placed.withColumn("band", F.when(F.col("cuts").isNull(), band))
    bands = placed.where("band is not null").groupBy("tree", "band").agg(F.count("*").alias("k"), F.sum("n").alias("m")).select(F.col("tree").alias("__t"), F.col("band").alias("__b"), _pieces(F.col("k"), F.col("m"), cfg).alias("wide"))
    placed = placed.join(bands, (F.col("tree") == F.col("__t")) & (F.col("band") == F.col("__b")), "left")
    block = F.when(F.col("cuts").isNotNull(), F.xxhash64("tree", "part", F.lit(1), F.pmod(F.xxhash64("name"), "cuts"))).otherwise(F.xxhash64("tree", "band", F.lit(2), F.pmod(F.xxhash64("part"), "wide")))
    placed = stash(placed.select("rep", "name", "part", block.alias("side")), "join-blocks")
    size = placed.count()
    if not size:
        return first
    rows = stash(sets.select("rep", "name", "tree", "members").join(_hinted(placed, size, cfg), ["rep", "name"]), "join-block-sets")

    def node(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in group.members]
        t = SignatureTree(sets, cfg.percent, max(1, len(sets)), cfg.fan)
        bits = 1 << 15
        at = np.zeros(bits, bool)
        worst = 0
        for s in sets:
            x = (s & np.uint64(bits - 1)).astype(np.int64)
            at[x] = True
            worst = max(worst, len(x) - len(np.unique(x)))
        parts = group.part.unique()
        return pd.DataFrame({"tree": [group.tree.iloc[0]], "side": [group.side.iloc[0]], "part": [parts[0] if len(parts) == 1 else None], "low": [t.sizes.min()], "high": [t.sizes.max()], "hidden": [worst], "bits": [np.packbits(at).tobytes()]}).astype({"part": "Int64"})

    nodes = rows.groupBy("side").applyInPandas(node, "tree long, side long, part long, low long, high long, hidden long, bits binary")
    nodes = stash(nodes, "join-nodes")

    def traverse(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["low", "high"], kind="stable")
        maps = np.stack([np.frombuffer(x, np.uint64) for x in group.bits])
        low, high, hidden, side = (group[c].to_numpy() for c in ("low", "high", "hidden", "side"))
        part = group.part.fillna(0).to_numpy(np.int64)
        mixed = group.part.isna().to_numpy()
        out = []
        for i in range(len(low)):
            j = np.arange(i, len(low))
            j = j[(100 * high[i] >= cfg.percent * low[j]) & (100 * high[j] >= cfg.percent * low[i]) & (mixed[i] | mixed[j] | (part[i] != part[j])) & ((j > i) | mixed[i])]
            most = np.bitwise_count(maps[j] & maps[i]).sum(1, dtype=np.int64) + np.minimum(hidden[i], hidden[j])
            j = j[most >= _need(low[i], low[j], cfg.percent)]
            out += [(side[i], side[k]) for k in j.tolist()]
        return pd.DataFrame(out, columns=["x", "y"], dtype="int64")

    pairs = stash(nodes.groupBy("tree").applyInPandas(traverse, "x long, y long"), "join-block-pairs")
    both = pairs.select(F.col("x").alias("side"), "x", "y").unionAll(pairs.where("x <> y").select(F.col("y").alias("side"), "x", "y"))
    met = rows.join(_hinted(both, 2 * pairs.count(), cfg), "side").withColumn("meeting", F.xxhash64("x", "y")).withColumn("deal", F.col("meeting"))
    second = stash(_join_by(met, cfg, True), "join-second")
    for t in (known, own, placed, rows, nodes, pairs):
        drop(t)
    return first.unionAll(second)


def _posted(n: str, cfg: JoinConfig) -> str:
    """About how many postings a set of n members has."""
    return f"({n} * (100 - {cfg.percent}) div {cfg.percent} + 1) * 8 div 5" if cfg.percent >= cfg.pieces_from else f"{n} - ({cfg.percent} * {n} + 99) div 100 + 1"


def _trees(documents: DataFrame, classes: DataFrame, levels: np.ndarray, ranges: int, cfg: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """(rep, class, tree, size) of the classes that share a tree with another, and the trees no single task can hold."""
    heavy, before, settled, left, ids = NONE, float("inf"), None, classes, None
    for again in range(cfg.reorders, -1, -1):
        posted = postings(documents, levels, heavy, ids, ranges, cfg)
        met = stash(posted.groupBy("deal").applyInArrow(lambda t: _meet(t, cfg), "u long, v long, p int, q int, common int"), "join-meetings")
        trees = components(_meetings(met, cfg))
        trees = trees.unionAll(trees.select(F.col("root").alias("id"), "root").distinct())
        # A document of a class that is left may hold another text too, whose class names no tree of two orders.
        wanted = stash(trees.join(left, trees.id == left["class"]).select("rep", "class", F.xxhash64("root", F.lit(again)).alias("tree"), "size"), "join-wanted")
        large = wanted.groupBy("tree").agg(F.count("*").alias("k"), F.sum("size").alias("m")).where((F.col("k") > cfg.most_leaves) | (F.col("m") > cfg.most_members))
        large = stash(large.select("tree", "k"), "join-large")
        worse, held = heavy, large.agg(F.sum("k").alias("k")).first().k or 0
        # Where the last order left the large trees as they were, as it does copies of one text, another is not tried.
        if again and 0 < held < 0.9 * before:
            before = held
            rows = met.where("common = -1").orderBy(F.desc("v"), "u").select("u").limit(max(0, cfg.most_heavy - len(heavy))).toArrow()
            worse = np.union1d(heavy, rows.column(0).to_numpy().astype(np.uint64))
        drop(met)
        if len(worse) == len(heavy):
            break
        # The classes of the small trees are settled: no order takes a tree from two that are similar.
        rows = large.count()
        small = stash(wanted.join(_hinted(large, rows, cfg), "tree", "left_anti").select(wanted.columns), "join-settled")
        settled = small if settled is None else settled.unionAll(small)
        last, left = left, stash(wanted.join(_hinted(large, rows, cfg), "tree", "left_semi").select(wanted.columns).drop("tree"), "join-left")
        if last is not classes:
            drop(last)
        if held <= cfg.broadcast_ids:
            ids, total = _ids(left), left.agg(F.sum(F.expr(_posted("size", cfg))).alias("n")).first().n
            ranges = max(8, -(-total // cfg.range_size))
        drop(wanted)
        drop(large)
        heavy = worse
        del posted, met, trees, wanted, large, last
        free_shuffles(documents.sparkSession)
    return wanted if settled is None else settled.unionAll(wanted), large


def jaccard_components(documents: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text)."""
    known = profile(by_batches(documents), cfg)
    docs = known.where("slot is null").select("doc_id", "n", "class")
    classes = docs.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n").alias("size"))
    total = docs.agg(F.sum(F.expr(_posted("n", cfg))).alias("n")).first().n or 0
    ranges = max(8, -(-total // cfg.range_size))
    wanted, large = _trees(documents, classes, _counters(known, cfg), ranges, cfg)
    shape = wanted.agg(F.count("*").alias("rows"), F.sum("size").alias("m")).first()
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    # Small trees share tasks; see ``_large_trees`` for the others.
    n_large = large.count()

    def sets_of(some: DataFrame) -> DataFrame:
        return _sets(texts, some, shape.rows, cfg)

    deals = max(4, int(shape.m or 0) // (cfg.most_members // 6) + 1)
    small = sets_of(wanted.join(_hinted(large, n_large, cfg), "tree", "left_anti") if n_large else wanted)
    linked = _join_by(small.withColumn("meeting", F.col("tree")).withColumn("deal", F.pmod(F.xxhash64("tree"), F.lit(deals))), cfg)
    if n_large:
        some = stash(sets_of(wanted.join(_hinted(large, n_large, cfg), "tree", "left_semi")), "join-large-sets")
        linked = linked.unionAll(_large_trees(some, cfg))
        drop(some)
    # Written first: two Python steps in one task would need two workers.
    linked = components(stash(linked, "join-links"))
    # Classes of one document that is linked with nothing name themselves.
    named = classes.join(linked, classes.rep == linked.id, "left").where("rep < last or root is not null").select("class", F.coalesce("root", "rep").alias("component"))
    named = stash(named, "join-named")
    out = docs.join(_hinted(named, named.count(), cfg), "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
