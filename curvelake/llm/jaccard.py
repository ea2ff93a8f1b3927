"""Exact Jaccard join on word shingles by universe partition.

Documents with equal shingle sets form one class, and only classes are
compared.  Sets are grouped into size bands; a band cuts the universe of
shingles into segments by a hash.  Two sets with similarity t or more differ
in at most H shingles, so when the segments' capacities add up to more than
H, some segment holds the pair: a plain segment (capacity 1) when its subsets
are equal, a segment with one-deletion neighbourhoods (capacity 2) when they
differ by one shingle at most.  How many segments of either kind a band gets
is allocated by cost.  Each set indexes the keys of its own band and, where a
smaller partner may lie there, of the band below; keys that meet are
candidates, which are verified on the whole sets.

Keys are dealt by their hash in packed blocks, so that a task sorts numbers,
not rows; each text is shingled and indexed once.  Capacities exceed H by a
slack, so similar sets meet not in one unit of capacity but in more of them,
as many as the slack and one, less what empty contents take.  Pairs are
counted, and those that met in fewer units than either set needs are dropped
unseen.  A key that more than ``BIG`` classes share is hot: it gives its
members with one of them only, and charges all of them its units, which are
taken off the need of their pairs.  A task finds what is hot among its own
keys first and sends on one member, so a key of a third of all classes is spread.  A pair that met in hot keys alone has lost as many units as it
needs on both sides; the sets that lost so much are cut anew into segments of
a shingle each, and those of different components that share one of their
rarest become candidates (the prefix principle).
Candidates are verified on the whole sets, one for each class first, so that
a group of near copies falls into one component by a linear number of pairs.
Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelake.llm import common

WORDS = 5
PERCENT = 80
#: Ratio of a band's sizes.
BAND = 1.5
#: Classes that share a key beyond which the key counts as hot.
BIG = 16
#: Bytes of text whose keys one block takes, on average, and how much that may grow to keep blocks few.
BLOCK_BYTES, MOST_BLOCKS, LARGEST = 4 << 20, 4096, 48 << 20
#: Classes of a block of a family, whose sets a task holds together with another block's.
FAMILY = 64
#: Counters of shingles, a byte each, by which the rarest are told.
COUNTER_BITS = 22
COUNTERS = 1 << COUNTER_BITS
#: Sets that share a rare shingle which are tried with one another first.
PART = 8
#: Key records that a task sorts at once.
FLUSH = 1_500_000
#: Most ids (8 to 16 bytes each) that are broadcast; more are joined by a shuffle.
MOST_IDS = 1_000_000
U = np.uint64
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits for each word, by a polynomial over its bytes."""
    data = np.frombuffer(b"".join(words), np.uint8)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens)
    starts = ends - lens
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(_P, len(data)), dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * _powers(_P_INV, len(data) + 1)[starts]
    return mix(h + lens.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; fewer words than a shingle make one of them all."""
    words = common.lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    k = min(size, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = mix(s * U(_P) + h[i : i + n])
    return np.unique(s)


def most_apart(total: int, percent: int = PERCENT) -> int:
    """The most shingles in which two sets of so many together can differ: 100 i >= percent u with i + u = total."""
    return total - 2 * -(-percent * total // (100 + percent))


def class_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def short_id(key: bytes) -> int:
    """The class key's first 40 bits: what blocks carry.  Classes that share one are told apart by the whole key later."""
    return int.from_bytes(key[:5], "little")


class Band:
    """Sizes low..high-1 of the smaller set of a pair; its segments of either kind and the slack."""

    def __init__(self, number: int, low: int, high: int, percent: int = PERCENT):
        self.number, self.low, self.high = number, low, high
        a = high - 1
        b = a * 100 // percent
        #: The most shingles in which a pair can differ: union - intersection, with 100 i >= percent u and i + u = a + b.
        self.differ = most_apart(a + b, percent)
        self.plain, self.wide = self._allocate()
        self.units = self.plain + 2 * self.wide
        self.slack = self.units - self.differ - 1

    def _allocate(self) -> tuple[int, int]:
        """The cheapest (plain, with deletions): keys to move, plus what keys of little content and sets without slack cost."""
        n = math.sqrt(self.low * (self.high - 1))
        best = None
        need = self.differ + 1
        # With less slack a passage that many documents share would cost its readers all of it.
        least = need // 5 + 3
        for extra in range(least, least + max(6, need // 5) + 1):
            for wide in sorted({0, 1, 2, need // 8, need // 4, need // 2, (need + extra) // 2}):
                plain = need + extra - 2 * wide
                if plain < 0 or plain + wide == 0:
                    continue
                lam = n / (plain + wide)
                p0, p1 = math.exp(-lam), lam * math.exp(-lam)
                lost = plain * p0 + wide * (2 * p0 + p1)
                var = plain * p0 + wide * (4 * p0 + p1)
                over = 0.5 * math.erfc((extra + 0.5 - lost) / math.sqrt(2 * max(var, 1e-9)))
                thin = plain * p1 + wide * (p1 * 2 + lam * lam / 2 * p0 * 2)
                cost = plain + wide * (1 + lam) + 1.0 * thin + 400 * over
                if best is None or cost < best[0]:
                    best = (cost, plain, wide)
        return best[1], best[2]


def bands(most: int, percent: int = PERCENT) -> list[Band]:
    """Bands up to a size.  Sets of fewer shingles than the first band holds are like no other set."""
    low = 1
    while (low * 100 // percent) <= low:
        low += 1
    out: list[Band] = []
    while not out or low <= most:
        high = max(low + 1, math.ceil(low * BAND))
        out.append(Band(len(out), low, high, percent))
        low = high
    return out


def _keys_of(s: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set in one band, and their flags: whether a key costs two units, and the set's need.

    The need is the units in which the set meets a similar one at least, as
    far as contents are not empty.  A set whose empty contents take all its
    slack keeps them as keys, in a space of their own that only such sets
    share; it still meets a similar set in one unit.
    """
    m = band.plain + band.wide
    x = mix(s ^ U(0x5851F42D4C957F2D * (band.number + 1) & (1 << 64) - 1))
    seg = ((x >> U(32)) * U(m)) >> U(32)
    seg = seg.astype(np.int64)
    y = mix(x + U(0x2545F4914F6CDD1D))
    order = np.argsort(seg, kind="stable")
    counts = np.bincount(seg, minlength=m)
    ends = np.cumsum(counts)
    csum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(y[order], dtype=np.uint64)])
    full = csum[ends] - csum[ends - counts]
    tag = mix(np.arange(m, dtype=np.uint64) + U(band.number << 32))
    lost = int((counts[: band.plain] == 0).sum() + 2 * (counts[band.plain :] == 0).sum() + (counts[band.plain :] == 1).sum())
    all_in = lost > band.slack
    held = np.flatnonzero(counts)
    keys, two = [mix(full[held] + tag[held])], [held >= band.plain]
    if band.wide:
        inside = seg >= band.plain
        w = seg[inside]
        solid = counts[w] > 1
        keys.append(mix(full[w[solid]] - y[inside][solid] + tag[w[solid]]))
        two.append(np.ones(len(keys[-1]), bool))
        if all_in:
            keys.append(mix(tag[np.unique(w[~solid])] ^ U(0xABCDEF)))
            two.append(np.ones(len(keys[-1]), bool))
    if all_in:
        bare = np.flatnonzero(counts == 0)
        keys.append(mix(tag[bare] ^ U(0xABCDEF)))
        two.append(bare >= band.plain)
    need = 1 if all_in else min(band.slack - lost + 1, NEED)
    return np.concatenate(keys), (np.concatenate(two) * TWO | need).astype(np.uint8)


def set_keys(s: np.ndarray, all_bands: list[Band], percent: int = PERCENT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys in the set's own band and in bands where a smaller partner may lie, with their flags."""
    n = len(s)
    least = -(-n * percent // 100)
    out = []
    for b in all_bands:
        if b.low <= n and b.high > least and b.low * 100 // percent >= b.low:
            keys, flags = _keys_of(s, b)
            out.append((keys, flags | np.uint8(OWN * (n < b.high))))
    return out


class Bands:
    """Bands up to the largest size seen so far."""

    def __init__(self, percent: int):
        self.percent, self.most, self.made = percent, 0, []

    def up_to(self, n: int) -> list[Band]:
        if n > self.most:
            self.most = 2 * n
            self.made = bands(self.most, self.percent)
        return self.made


#: Flags of a key: it costs two units; its band is the set's own; a task has found it hot.  The rest is the set's need.
TWO, OWN, HOT, NEED = 128, 64, 32, 31
#: What a block holds of a key (its block is known, and a false meeting is verified away), the short id, and flags: ten bytes.
KEY = np.dtype([("key", "<u4"), ("low", "<u4"), ("high", "u1"), ("flags", "u1")])
#: Two sides (a side is a short id and whether its band is its own), the units in which they met and their needs.
MET = np.dtype([("a", "<u8"), ("b", "<u8"), ("units", "u1"), ("need_a", "u1"), ("need_b", "u1")])
#: A side's part in a hot key.
SHARE = np.dtype([("group", "<u8"), ("side", "<u8"), ("cost", "u1"), ("need", "u1")])
#: Kinds of packed rows.
KEYS, PAIRS, SHARES, ROW = 0, 1, 2, 3


def _packed(rows: np.ndarray) -> np.ndarray:
    """Side and flags of key records in one number, the side first."""
    who = (rows["high"].astype(np.uint64) << U(32)) | rows["low"]
    return (((who << U(1)) | ((rows["flags"] & OWN) > 0).astype(np.uint64)) << U(8)) | rows["flags"]


def _met(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Records of packed sides that meet in a key; p is the lesser of each two.

    The band of a pair is its smaller set's own, so two sides that are both
    out of their own bands do not count here.
    """
    a, b = p >> U(8), q >> U(8)
    keep = (((a | b) & U(1)) > 0) & (a >> U(1) != b >> U(1))
    p, q = p[keep], q[keep]
    out = np.empty(len(p), MET)
    out["a"], out["b"], out["units"] = a[keep], b[keep], 1 + ((p & U(TWO)) > 0)
    out["need_a"], out["need_b"] = p & U(NEED), q & U(NEED)
    return out


def summed(rows: np.ndarray) -> np.ndarray:
    """One record for each pair, its units added up (more than a need can be are as good as that)."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["b"], rows["a"]))]
    at = np.flatnonzero(np.r_[True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])])
    out = rows[at]
    out["units"] = np.minimum(np.add.reduceat(rows["units"].astype(np.int64), at), 255)
    for c in ("need_a", "need_b"):
        out[c] = np.minimum.reduceat(rows[c], at)
    return out


def _hot(group: np.ndarray, packed: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What groups leave that are too large for all their pairs: each member with the first one, and each member's share."""
    first = np.repeat(starts, sizes)
    other = first != np.arange(len(packed))
    pairs = _met(packed[first[other]], packed[other])
    fresh = (packed & U(HOT)) == 0
    shares = np.empty(int(fresh.sum()), SHARE)
    shares["group"], shares["side"] = group[fresh], packed[fresh] >> U(8)
    shares["cost"], shares["need"] = 1 + ((packed[fresh] & U(TWO)) > 0), packed[fresh] & U(NEED)
    return pairs, shares


def meet(rows: np.ndarray, block: int = 0, big: int = BIG) -> tuple[np.ndarray, np.ndarray]:
    """Summed pairs among the records of a block, and the shares in its hot keys.

    Groups of up to ``big`` classes give all their pairs; a larger one, or
    one that a task has found hot, gives each member with the smallest.
    """
    key, packed = rows["key"], _packed(rows)
    order = np.lexsort((packed, key))
    key, packed = key[order], packed[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (packed[1:] != packed[:-1])
    key, packed = key[first], packed[first]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    hot = sizes > big
    if len(starts):
        hot |= np.logical_or.reduceat((packed & U(HOT)) > 0, starts)
    found = []
    for size in np.unique(sizes[(sizes > 1) & ~hot]).tolist():
        at = starts[(sizes == size) & ~hot]
        i, j = np.triu_indices(size, 1)
        found.append(_met(packed[at[:, None] + i].ravel(), packed[at[:, None] + j].ravel()))
    inside = np.repeat(hot, sizes)
    sizes = sizes[hot]
    pairs, shares = _hot((U(block) << U(32)) | key[inside], packed[inside], np.cumsum(sizes) - sizes, sizes)
    return summed(np.concatenate([*found, pairs])), shares


def presorted(rows: np.ndarray, block: np.ndarray, big: int = BIG) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A task's key records by block, with what is hot already taken out but for one marked member: rows, blocks, pairs, shares.

    So a key that a third of all classes share sends a few records of each task to its block.
    """
    group = (block.astype(np.uint64) << U(32)) | rows["key"]
    order = np.argsort(group, kind="stable")
    rows, group = rows[order], group[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    hot = sizes > big
    inside = np.repeat(hot, sizes)
    many, names = _packed(rows[inside]), group[inside]
    own = np.argsort(names, kind="stable") if not len(many) else np.lexsort((many, names))
    heads = np.cumsum(sizes[hot]) - sizes[hot]
    pairs, shares = _hot(names[own], many[own], heads, sizes[hot])
    marked = rows[inside][own][heads]
    marked["flags"] |= HOT
    rows = np.concatenate([rows[~inside], marked])
    group = np.concatenate([group[~inside], names[own][heads]])
    return rows, (group >> U(32)).astype(np.int32), summed(pairs), shares


def _deal(rows: np.ndarray, by: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(block, kind, packed records) by block number."""
    order = np.argsort(by, kind="stable")
    rows, by = rows[order], by[order]
    at = np.flatnonzero(np.diff(by, prepend=-1))
    edge = np.append(at, len(by)).tolist()
    return ((int(by[a]), kind, rows[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True))


def _pair_block(p: np.ndarray, n: int) -> np.ndarray:
    return (mix((p["a"] >> U(1)) * U(3) + (p["b"] >> U(1))) % U(n)).astype(np.int32)


def _side_block(p: np.ndarray, n: int) -> np.ndarray:
    return (mix(p["side"] >> U(1)) % U(n)).astype(np.int32)


def _gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """All records of each block of a partition; blocks arrive sorted."""
    now, parts = None, []
    for b in batches:
        for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
            if now is not None and block != now:
                yield now, np.concatenate(parts)
                parts = []
            now = block
            parts.append(np.frombuffer(data, kind))
    if parts:
        yield now, np.concatenate(parts)


def _exchange(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "block").sortWithinPartitions("block")


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Class key, short id, size and set of the classes of rows; a task gives each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            got = []
            for t in b.column(0).to_pylist():
                s = shingle_set(t, size)
                key = class_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    got.append((key, short_id(key), len(s), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["ckey", "who", "n", "set"])

    return docs.select(text_col).mapInArrow(run, "ckey binary, who long, n long, set binary")


class Packer:
    """Arrow batches of packed records and of the rows themselves."""

    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type

    def rows(self, ids: pa.Array, blocks: list[int], n: list[int], keys: list[bytes | None]) -> pa.RecordBatch:
        who = pa.array([None if k is None else short_id(k) for k in keys], pa.int64())
        return self._batch(blocks, [ROW] * len(n), [None] * len(n), ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), who)

    def packed(self, dealt: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(dealt), 256):
            part = dealt[a : a + 256]
            none = [pa.nulls(len(part), t) for t in (self.id_type, pa.int64(), pa.binary(), pa.int64())]
            yield self._batch([x[0] for x in part], [x[1] for x in part], [x[2] for x in part], *none)

    @staticmethod
    def _batch(block: list[int], kind: list[int], data: list, *rest: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()), *rest], names=["block", "kind", "data", "doc_id", "n", "ckey", "who"])


def indexed(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, n_blocks: int, big: int) -> DataFrame:
    """Each row's class, and the packed keys of all classes; a task shingles a text once and indexes each of its classes once."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_bands, seen = Bands(percent), set()
        held, blocks, size_now, at = [], [], 0, TaskContext.get().partitionId()
        out = None

        def flush() -> Iterator[pa.RecordBatch]:
            rows, by, pairs, shares = presorted(np.concatenate(held), np.concatenate(blocks), big)
            dealt = [*_deal(rows, by, KEYS), *_deal(pairs, _pair_block(pairs, n_blocks), PAIRS), *_deal(shares, _side_block(shares, n_blocks), SHARES)]
            yield from out.packed(dealt)

        for b in batches:
            out = out or Packer(b.column(0).type)
            ns, keys = [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, size)
                key = class_key(s) if len(s) else None
                ns.append(len(s))
                keys.append(key)
                if key is None or key in seen:
                    continue
                seen.add(key)
                who = short_id(key)
                for hashes, flags in set_keys(s, all_bands.up_to(len(s)), percent):
                    r = np.empty(len(hashes), KEY)
                    r["key"], r["low"], r["high"], r["flags"] = hashes >> U(32), who & 0xFFFFFFFF, who >> 32, flags
                    held.append(r)
                    blocks.append((hashes % U(n_blocks)).astype(np.int32))
                    size_now += len(r)
                if size_now > FLUSH:
                    yield from flush()
                    held, blocks, size_now = [], [], 0
            # Rows go to any block, so that a class of many rows is spread.
            yield out.rows(b.column(0), [(at * 7919 + i) % n_blocks for i in range(len(ns))], ns, keys)
            at += len(ns)
        if held:
            yield from flush()

    schema = f"block int, kind int, data binary, doc_id {kind}, n long, ckey binary, who long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def met_keys(keys: DataFrame, n_blocks: int, big: int) -> DataFrame:
    """Blocks of keys become pairs and shares; everything else is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting = None, []

        def keys_only() -> Iterator[pa.RecordBatch]:
            nonlocal out
            for b in batches:
                out = out or Packer(b.column("doc_id").type)
                is_key = pc.equal(b.column("kind"), KEYS)
                waiting.append(b.filter(pc.invert(is_key)))
                yield b.filter(is_key)

        for block, rows in _gathered(keys_only(), KEY):
            pairs, shares = meet(rows, block, big)
            yield from out.packed([*_deal(pairs, _pair_block(pairs, n_blocks), PAIRS), *_deal(shares, _side_block(shares, n_blocks), SHARES)])
            yield from waiting
            waiting.clear()
        yield from waiting

    return _exchange(keys, n_blocks).mapInArrow(run, keys.schema)


#: What one candidate is tried for at a time: each class, each class and component, and all the rest.
TURNS = (["b"], ["b", "la"], None)


class Join:
    """One run of the join over a table."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int):
        self.docs, self.id_col, self.text_col, self.size, self.percent = docs, id_col, text_col, size, percent
        self.big = BIG
        self.spark = docs.sparkSession
        self.scratch = common.Scratch(self.spark, "jaccard")

    def fetch(self, ids: DataFrame) -> DataFrame:
        """``ckey, who, n, set`` of the classes among ``ids``, from the text of one document of each."""
        small = ids.count() <= MOST_IDS
        hint = F.broadcast if small else (lambda df: df)
        reps = self.scratch.cut(self.classes.join(hint(ids), "who").select("ckey", "rep"))
        texts = self.docs.select(F.col(self.id_col).alias("_id"), F.col(self.text_col).alias("_t"))
        picked = texts.join(hint(reps.select("rep").distinct()), F.col("_id").eqNullSafe(F.col("rep")), "left_semi")
        # An id may have several texts: the class keys say which rows are meant.
        found = self.scratch.cut(sets_of(picked, "_id", "_t", self.size).join(hint(reps.select("ckey")), "ckey", "left_semi"))
        # Only where ids repeat may several tasks have found a class.
        return found if found.count() == reps.count() else self.scratch.cut(found.dropDuplicates(["ckey"]))

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``x, y`` class keys of the pairs that are similar enough, by their whole sets.

        Classes whose pairs reach one least class are of one family, which is
        cut into blocks of about ``FAMILY``; a pair belongs to a pair of
        blocks.  A set is sent once to each pair of blocks that needs it, not
        once a pair, and no pair of blocks holds more than two blocks' sets.
        """
        percent, spark = self.percent, self.spark
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("who"), F.col("b").alias("other")), F.struct(F.col("b").alias("who"), F.col("a").alias("other")))).alias("e"))
        family = ends.groupBy("e.who").agg(F.least(F.min("e.other"), F.col("who")).alias("family"))
        sizes = family.groupBy("family").agg(F.ceil(F.count("*") / FAMILY).alias("cuts"))
        of = self.scratch.cut(family.join(sizes, "family").select("who", F.xxhash64("family", F.pmod(F.xxhash64("who"), "cuts")).alias("part")))
        hint = F.broadcast if of.count() <= MOST_IDS else (lambda df: df)
        pa_, pb = (of.select(F.col("who").alias(c), F.col("part").alias(f"part_{c}")) for c in "ab")
        dealt = pairs.join(hint(pa_), "a").join(hint(pb), "b").select(F.xxhash64(F.least("part_a", "part_b"), F.greatest("part_a", "part_b")).alias("part"), "a", "b")
        dealt = self.scratch.cut(dealt)
        needed = self.scratch.cut(dealt.select("part", F.explode(F.array("a", "b")).alias("who")).distinct())
        sent = sets.join(F.broadcast(needed) if needed.count() <= MOST_IDS else needed, "who").select("part", F.lit(0).alias("kind"), F.col("who").alias("a"), F.lit(None).cast("long").alias("b"), "ckey", "set")
        asked = dealt.select("part", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("ckey"), F.lit(None).cast("binary").alias("set"))
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, {}
            for batch in batches:
                found = []
                for part, kind, a, b, key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if part != now:
                        now, held = part, {}
                    if kind == 0:
                        held.setdefault(a, []).append((key, np.frombuffer(raw, np.uint64)))
                        continue
                    for x, p in held[a]:
                        for y, q in held[b]:
                            if x != y and 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                                both = len(np.intersect1d(p, q, assume_unique=True))
                                if 100 * both >= percent * (len(p) + len(q) - both):
                                    found.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["x", "y"])

        both = sent.unionByName(asked).repartition(n, "part").sortWithinPartitions("part", "kind")
        return self.scratch.cut(both.mapInArrow(run, "x binary, y binary").distinct())

    def named(self, labels: DataFrame) -> DataFrame:
        """``who, label`` of short ids whose classes all lie in one component."""
        of = self.classes.join(labels, F.col("ckey") == F.col("x"), "left").select("who", F.coalesce("label", "ckey").alias("label"), F.col("label").isNotNull().alias("linked"))
        one = of.groupBy("who").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.max("linked").alias("linked"))
        return self.scratch.cut(one.where("label = other AND linked").select("who", F.xxhash64("label").alias("label")))

    def apart(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs that no component holds yet, with the label of a."""
        la, lb = (known.select(F.col("who").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        both = pairs.join(la, "a", "left").join(lb, "b", "left")
        return both.where("la IS NULL OR lb IS NULL OR la <> lb").select("a", "b", "units", F.coalesce("la", "a").alias("la"))

    def linked(self, pairs: DataFrame, sets: DataFrame, links: DataFrame | None = None, labels: DataFrame | None = None, turns: tuple = TURNS) -> tuple[DataFrame, DataFrame]:
        """Links, those before included, that connect what the pairs connect, and the components' labels.

        Pairs with the label of a are of different components already.
        Each class is first tried with the candidate that it met in most
        units; what a component then holds needs no more.  Next comes the best
        candidate of each class in each component that it may belong to, and
        last all pairs that are left.
        """
        left = pairs
        for keys in turns:
            if labels is not None:
                if "la" not in left.columns:
                    left = self.scratch.cut(self.apart(left, self.named(labels)))
                if left.isEmpty():
                    break
            now = left.select("a", "b")
            if keys:
                now = self.scratch.cut(left.groupBy(*keys).agg(F.max(F.struct("units", (-F.col("a")).alias("_a"))).alias("m")).select((-F.col("m._a")).alias("a"), "b"))
            new = self.verify(now, sets)
            links = new if links is None else links.unionByName(new)
            labels = components(links, self.scratch)
            left = left.select("a", "b", "units").join(now, ["a", "b"], "left_anti")
        return links, labels

    def run(self) -> DataFrame:
        return self._result(self.labels())

    def labels(self) -> DataFrame:
        """``x, label``: the component of each class that is linked with another."""
        scratch = self.scratch
        total = self.docs.agg(F.sum(F.octet_length(self.text_col))).first()[0] or 0
        n_blocks = max(16, min(-(-total // BLOCK_BYTES), max(MOST_BLOCKS, -(-total // LARGEST))))
        met, met_path = scratch.write(met_keys(indexed(self.docs, self.id_col, self.text_col, self.size, self.percent, n_blocks, self.big), n_blocks, self.big))
        common.release(self.spark)
        self.rows = scratch.cut(met.where(F.col("kind") == ROW).select("doc_id", "n", "ckey", "who"))
        self.classes = scratch.cut(self.rows.where(F.col("ckey").isNotNull()).groupBy("ckey", "who").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
        lost = self._lost(met)
        pairs = self._candidates(met, lost, n_blocks)
        sets = self.fetch(scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("who")).distinct()))
        links, labels = self.linked(pairs, sets)
        rest = self._rest(met, lost, labels)
        scratch.drop(met_path)
        if rest is not None:
            flat, sets = rest
            links, labels = self.linked(self._some(flat), sets, links, labels, TURNS[2:])
            labels = self.linked(self._unlike(flat, labels), sets, links, labels, TURNS[1:])[1]
        return labels

    def _lost(self, met: DataFrame) -> DataFrame:
        """``side, lost, need``: the units that hot keys cost each side (a pair's count may miss as many), and its need."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    r = np.concatenate([np.frombuffer(x, SHARE) for x in b.column(0).to_pylist()])
                    r = r[np.argsort(r["side"], kind="stable")]
                    at = np.flatnonzero(np.r_[True, r["side"][1:] != r["side"][:-1]])
                    cols = r["side"][at].astype(np.int64), np.add.reduceat(r["cost"].astype(np.int64), at), np.minimum.reduceat(r["need"], at).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["side", "lost", "need"])

        parts = met.where(F.col("kind") == SHARES).select("data").mapInArrow(run, "side long, lost long, need long")
        return self.scratch.cut(parts.groupBy("side").agg(F.sum("lost").alias("lost"), F.min("need").alias("need")))

    def _candidates(self, met: DataFrame, lost: DataFrame, n_blocks: int) -> DataFrame:
        """``a, b, units`` of classes that met in as many units as both their needs ask for, less what hot keys cost them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, r in _gathered(batches, MET):
                r = summed(r)
                yield pa.RecordBatch.from_arrays([pa.array(r[c].astype(np.int64)) for c in MET.names], names=list(MET.names))

        pairs = _exchange(met.where(F.col("kind") == PAIRS).select("block", "data"), n_blocks).mapInArrow(run, ", ".join(f"{c} long" for c in MET.names))
        hint = F.broadcast if lost.count() <= MOST_IDS else (lambda df: df)
        for c in "ab":
            side = lost.select(F.col("side").alias(c), F.col("lost").alias(f"lost_{c}"))
            pairs = pairs.join(hint(side), c, "left").where(F.col("units") >= F.col(f"need_{c}") - F.coalesce(f"lost_{c}", F.lit(0))).drop(f"lost_{c}")
        found = pairs.select(*(F.shiftrightunsigned(c, 1).alias(c) for c in "ab"), "units")
        # Classes that share a short id never meet in a key, so they are always tried.
        alike = self.classes.groupBy("who").count().where("count > 1").select(F.col("who").alias("a"), F.col("who").alias("b"), F.lit(0).cast("long").alias("units"))
        return self.scratch.cut(found.unionByName(alike))

    def _rest(self, met: DataFrame, lost: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """First shingles of sets that may be in pairs which met in hot keys only, and the sets: either side has lost as many units as it needs.

        The sets that lost so much in keys of several components are cut anew,
        into segments of a shingle each, of which only the rarest count: two
        similar sets share one among the first of either, in any order of the
        universe (the prefix principle).
        """
        short = self.scratch.cut(lost.where("lost >= need").select("side", "need"))
        n_short = short.count()
        if not n_short:
            return None
        hint = F.broadcast if n_short <= MOST_IDS else (lambda df: df)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for raw in b.column(0).to_pylist():
                    r = np.frombuffer(raw, SHARE)
                    yield pa.RecordBatch.from_arrays([pa.array(r[c].astype(np.int64)) for c in ("group", "side", "cost")], names=["grp", "side", "cost"])

        flat = met.where(F.col("kind") == SHARES).select("data").mapInArrow(unpack, "grp long, side long, cost long").join(hint(short), "side")
        known = self.named(labels)
        flat = flat.withColumn("who", F.shiftrightunsigned("side", 1)).join(known, "who", "left")
        flat = self.scratch.cut(flat.select("grp", "side", "who", "cost", "need", F.coalesce("label", "who").alias("label")))
        several = flat.groupBy("grp").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("grp")
        owing = flat.join(several, "grp", "left_semi").groupBy("side", "who", "label").agg(F.sum("cost").alias("cost"), F.min("need").alias("need"))
        owing = self.scratch.cut(owing.where("cost >= need").select("who", "label").distinct())
        if owing.isEmpty():
            return None
        sets = self.fetch(owing.select("who"))
        return self._rarest(sets), sets

    def _rarest(self, sets: DataFrame) -> DataFrame:
        """``grp, who, n, pos``: the first shingles of each set, by rising counts among these sets, which a similar set must share one of.

        Counts are kept for ``COUNTERS`` hashes of shingles, so what goes to
        the driver and back is bounded; the order only saves work.
        """
        percent = self.percent

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(COUNTERS, np.uint16)
            for b in batches:
                for raw in b.column(0).to_pylist():
                    at = np.unique((np.frombuffer(raw, np.uint64) >> U(64 - COUNTER_BITS)).astype(np.int64))
                    own[at] = np.minimum(own[at], 254) + 1
            at = np.flatnonzero(own)
            edge = np.searchsorted(at, np.arange(0, COUNTERS + 1, COUNTERS // 64)).tolist()
            for k, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                if y > x:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at[x:y].astype("<u4").tobytes() + own[at[x:y]].astype(np.uint8).tobytes()], pa.binary())], names=["block", "data"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n = len(raw) // 5
                    at = np.frombuffer(raw, "<u4", n).astype(np.int64) - k * (COUNTERS // 64)
                    own = sums.setdefault(k, np.zeros(COUNTERS // 64, np.uint16))
                    own[at] = np.minimum(own[at] + np.frombuffer(raw, np.uint8, n, 4 * n), 255)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.uint8).tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

        table = np.zeros(COUNTERS, np.uint8)
        for r in sets.select("set").mapInArrow(count, "block int, data binary").repartition(16, "block").mapInArrow(add, "block int, data binary").collect():  # COUNTERS bytes
            table[r["block"] * (COUNTERS // 64) :][: COUNTERS // 64] = np.frombuffer(r["data"], np.uint8)
        sent = self.spark.sparkContext.broadcast(table)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = sent.value
            for b in batches:
                cols: list[list[np.ndarray]] = [[] for _ in range(4)]
                for who, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    s = np.frombuffer(raw, np.uint64)
                    n = len(s)
                    c = counts[(s >> U(64 - COUNTER_BITS)).astype(np.int64)]
                    order = np.argsort(c, kind="stable")[: n - -(-n * percent // 100) + 1]
                    keep = c[order] > 1
                    got = s[order[keep]].astype(np.int64), np.flatnonzero(keep)
                    for col, x in zip(cols, (got[0], *(np.full(len(got[0]), v) for v in (who, n)), got[1]), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in cols], names=["grp", "who", "n", "pos"])

        return self.scratch.cut(sets.select("who", "set").mapInArrow(first, "grp long, who long, n long, pos long"))

    def _meeting(self, both: DataFrame) -> DataFrame:
        """``a, b, units`` (and the label of a, where there are labels) of pairs that may be similar: before the first shingle that they share neither has more than the rest."""
        least = F.ceil((F.col("n_a") + F.col("n_b")) * self.percent / (100 + self.percent))
        both = both.where((F.col("pos_a") + least <= F.col("n_a")) & (F.col("pos_b") + least <= F.col("n_b")))
        label = [F.min(F.when(F.col("who_a") < F.col("who_b"), F.col("label_a")).otherwise(F.col("label_b"))).alias("la")] if "label_a" in both.columns else []
        return self.scratch.cut(both.groupBy(F.least("who_a", "who_b").alias("a"), F.greatest("who_a", "who_b").alias("b")).agg(F.count("*").alias("units"), *label))

    def _some(self, flat: DataFrame) -> DataFrame:
        """A linear number of pairs, by which groups of near copies fall together: a group is dealt into parts of about ``PART``, anew for each shingle."""
        sizes = flat.groupBy("grp").agg(F.ceil(F.count("*") / PART).alias("cuts"))
        dealt = self.scratch.cut(flat.join(sizes, "grp").withColumn("cut", F.pmod(F.xxhash64("grp", "who"), "cuts")))
        left, right = (dealt.select("grp", "cut", *(F.col(c).alias(f"{c}_{x}") for c in ("who", "n", "pos"))) for x in "ab")
        return self._meeting(left.join(right, ["grp", "cut"]).where("who_a < who_b"))

    def _unlike(self, flat: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of different components.  Components are paired first, so that a large one's members are not paired with each other."""
        flat = self.scratch.cut(flat.join(self.named(labels), "who", "left").withColumn("label", F.coalesce("label", "who")))
        names = flat.groupBy("grp", "label").agg(F.min("n").alias("least"), F.max(F.col("n") - F.col("pos")).alias("left"))
        sides = (names.select("grp", *(F.col(c).alias(f"{c}_{x}") for c in ("label", "least", "left"))) for x in "ab")
        # The bound of ``_meeting`` for the most promising members.
        bound = (F.col("least_a") + F.col("least_b")) * self.percent <= F.least("left_a", "left_b") * (100 + self.percent)
        unlike = next(sides).join(next(sides), "grp").where((F.col("label_a") < F.col("label_b")) & bound).select("grp", "label_a", "label_b")
        left, right = (flat.select("grp", *(F.col(c).alias(f"{c}_{x}") for c in ("label", "who", "n", "pos"))) for x in "ab")
        return self._meeting(unlike.join(left, ["grp", "label_a"]).join(right, ["grp", "label_b"]))

    def representatives(self) -> DataFrame:
        """The rows of ``docs`` that stand for the components, in all their columns.

        A row is chosen by its class and id.  Where an id is of one row, the
        id finds it; among rows of absent or repeated ids the class key does.
        """
        labels = self.labels()
        of = self.classes.join(labels, F.col("ckey") == F.col("x"), "left").select(F.coalesce("label", "ckey").alias("label"), "ckey", "rep")
        best = of.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("absent"), "rep", "ckey")).alias("m")).select("m.rep", "m.ckey")
        many = self.scratch.cut(self.rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_many")))
        few = F.broadcast if many.count() <= MOST_IDS else (lambda df: df)
        best = self.scratch.cut(best.join(few(many), F.col("rep") == F.col("_many"), "left").select("rep", "ckey", (F.col("rep").isNotNull() & F.col("_many").isNull()).alias("alone")))
        docs, columns = self.docs, self.docs.columns
        doc_id, text = docs[self.id_col], docs[self.text_col]
        alone = best.where("alone").select("rep")
        hint = F.broadcast if alone.count() <= MOST_IDS else (lambda df: df)
        plain = docs.join(hint(alone), doc_id == F.col("rep"), "left_semi")
        wordless = docs.where(~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
        # Of rows alike in class and id the one of the least text stays, then of the least other columns.
        unclear = docs.where(doc_id.isNull()).unionByName(docs.join(few(many), doc_id == F.col("_many"), "left_semi"))
        order = [self.text_col, *(c for c in columns if c not in (self.id_col, self.text_col))]
        least = self._with_class(unclear).where("_ckey IS NOT NULL").groupBy("_ckey", F.col(self.id_col).alias("_id")).agg(F.min(F.struct(*order)).alias("_m"))
        least = least.join(best.where("NOT alone"), (F.col("_ckey") == F.col("ckey")) & F.col("_id").eqNullSafe(F.col("rep")), "left_semi")
        least = least.select(*(F.col("_id").alias(c) if c == self.id_col else F.col("_m")[c].alias(c) for c in columns))
        return plain.unionByName(least).unionByName(wordless)

    def _with_class(self, docs: DataFrame) -> DataFrame:
        """All columns, and ``_ckey``, the class key of each row."""
        at, size = docs.columns.index(self.text_col), self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [shingle_set(t, size) for t in b.column(at).to_pylist()]
                keys = pa.array([class_key(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, keys], names=[*b.schema.names, "_ckey"])

        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_ckey", T.BinaryType())]))

    def _result(self, labels: DataFrame) -> DataFrame:
        named = labels.join(self.classes.select("ckey", "rep"), F.col("x") == F.col("ckey")).select("ckey", "label", "rep")
        least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        linked = self.scratch.cut(named.join(least, "label").select("ckey", "component_id"))
        per = self.classes.join(linked, "ckey", "left").select("ckey", F.coalesce("component_id", "rep").alias("component_id"))
        out = self.rows.join(per, "ckey", "left")
        return out.select(
            F.col("doc_id").alias(self.id_col), F.col("n").alias("n_shingles"),
            F.when(F.col("ckey").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )


def components(links: DataFrame, scratch: common.Scratch) -> DataFrame:
    """``x, label``: the smallest key reachable from each linked key.

    Each round every key takes the least label among its own and its
    neighbours', then the label of its label, so that long chains halve.
    """
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    edges, edges_path = scratch.write(both)
    labels, path = scratch.write(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("x").alias("y"), F.col("label").alias("got")), "y").groupBy("x").agg(F.min("got").alias("got"))
        step = labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "got").alias("label"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label", "left").select("x", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        new, new_path = scratch.write(step)
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        scratch.drop(path)
        labels, path = new.select("x", "label"), new_path
        if not changed:
            scratch.drop(edges_path)
            return labels


def join(docs: DataFrame, *, shingle_words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets are similar: 100 * intersection >= percent * union.

    One row for each row of ``docs``: id, ``n_shingles`` and ``component_id``
    (the smallest id reachable by links, its own included).  An absent or empty text, or
    one without words, has no shingles and is linked with nothing.  Rows of
    equal sets are of one class; absent ids are rows of their own and never
    name a component unless all its ids are absent.  An empty table gives an
    empty result; other columns are not carried.
    """
    common.small_batches(docs.sparkSession)
    return Join(docs, id_col, text_col, shingle_words, percent).run()


def representatives(docs: DataFrame, *, shingle_words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``join``, in all its columns.

    It is the row of the smallest id, absent ones last, then of the smallest
    class key and text, so what stays does not depend on partitions.  Rows
    without words are linked with nothing, and all stay.
    """
    common.small_batches(docs.sparkSession)
    return Join(docs, id_col, text_col, shingle_words, percent).representatives()


def join_sql(size: int = WORDS, percent: int = PERCENT) -> str:
    """The same components in DuckDB's SQL, by counting shared shingles of all pairs that share any."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - {size} + 2), lambda i: array_to_string(ws[i:i + {size} - 1], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c WHERE 100 * k >= {percent} * (na + nb - k) UNION ALL SELECT y, x FROM c WHERE 100 * k >= {percent} * (na + nb - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT s.doc_id, len(s.sh) AS n_shingles, m.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = s.doc_id
"""
