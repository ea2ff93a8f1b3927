"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Encoding is byte-pair merging over an agenda: the candidate merge of best
score comes first, the leftmost among equals.  With dropout, a candidate that
comes up is skipped when a keyed hash of its place says so; a skipped pair
may be proposed again only as part of a new neighbour.  The hash is keyed by
the seed, the row (its id, its copy number and its text), the pre-token's
number in the text, the place in the pre-token and the piece that the merge
would make.  So each occurrence of a word draws for itself, and results do not
depend on partitions, workers or order.  Without dropout the result is the
library's.

Nothing is cached: all pre-tokens of one length in a batch are merged together,
a merge of each at a step, as arrays.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from curvelake.llm import bpe, common

DROPOUT = 0.1
SEED = 11
#: Characters of a pre-token up to which it is merged together with others (a place takes five bits), and how many go together, about.
WIDE = 31
TOGETHER = 200_000
#: Characters of a pre-token up to which its agenda is scanned.
LONG = 64
NEVER = 1 << 40
LAST = np.iinfo(np.int32).max
SLOTS = 20
MASK = (1 << 32) - 1
MASK64 = (1 << 64) - 1
U = np.uint64
SCHEMA = "ids array<int>, n_tokens int, lossless boolean"


class Codec:
    """One model's pieces, with encoding and decoding of whole texts."""

    def __init__(self, name: str, dropout: float = DROPOUT, seed: int = SEED):
        sp = bpe.processor(bpe.model_path(name))
        self.dropout, self.seed = dropout, seed
        self.bar = int(dropout * (MASK + 1))
        self.byte = [0] * 256
        self.piece: list[bytes] = []
        scored = []
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte[b] = i
                self.piece.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.piece.append(b"")
            else:
                scored.append((-sp.get_score(i), p, i))
                self.piece.append(p.replace(bpe.SPACE, " ").encode())
        # Pieces of equal score share a rank, so that the leftmost of them comes first.
        scores = {s: k for k, s in enumerate(sorted({s for s, _, _ in scored}))}
        self.rank: dict[str, int] = {p: scores[s] for s, p, _ in scored}
        self.number: dict[str, int] = {p: i for _, p, i in scored}
        self.bar_ids = array("i", [self.byte[c] for c in bpe.SPACE.encode()]).tobytes()
        self._tables()

    def _tables(self) -> None:
        """Symbols as numbers (pieces that merges make, and characters), and a hash table from two of them to what they make."""
        names = sorted(set(self.rank) | {c for p in self.rank for c in p})
        symbol = {p: i for i, p in enumerate(names)}
        self.none = len(names)  # a symbol that merges with nothing
        self.symbol_rank = np.array([self.rank.get(p, 0) for p in names], np.int32)
        self.symbol_id = np.array([self.number.get(p, -1) for p in names] + [-1], np.int32)
        self.char = np.full(0x110000, self.none, np.int32)
        for c in names:
            if len(c) == 1 and c in self.number:
                self.char[ord(c)] = symbol[c]
        pairs = {}
        for p in self.rank:
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * (self.none + 1) + b] = symbol[p]
        bits = max(SLOTS, (4 * len(pairs)).bit_length())
        self.shift, self.slots = U(64 - bits), (1 << bits) - 1
        self.pair, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        for key, to in pairs.items():
            at = ((key * 0x9E3779B97F4A7C15) & MASK64) >> (64 - bits)
            while self.pair[at] >= 0:
                at = (at + 1) & self.slots
            self.pair[at], self.made[at] = key, to

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbols that pairs make, -1 where none."""
        key = a.astype(np.int64) * (self.none + 1) + b
        at = ((key.astype(U) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.pair[at]
        out = np.where(found == key, self.made[at], -1)
        more = np.flatnonzero((found != key) & (found >= 0))
        while len(more):
            at[more] = (at[more] + 1) & self.slots
            found = self.pair[at[more]]
            same = found == key[more]
            out[more[same]] = self.made[at[more[same]]]
            more = more[~same & (found >= 0)]
        return out

    def _candidates(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs make, and their agenda entries: rank and place, or LAST."""
        to = self._made(a, b)
        return to, np.where(to >= 0, (self.symbol_rank[to] << 5) | place, LAST).astype(np.int32)

    @staticmethod
    def where(place: int, rank: int) -> int:
        """A candidate's part of the hash."""
        return (place * 0x94D049BB133111EB + rank * 0xD6E8FEB86659FD93) & MASK64

    def skipped(self, key: int, where: int) -> bool:
        x = key ^ where
        x = ((x ^ (x >> 32)) * 0x9E3779B97F4A7C15) & MASK64
        return (((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & MASK64) >> 32 < self.bar

    def merge(self, piece: str, key: int) -> bytes:
        """Token ids of one pre-token, four bytes each.

        The agenda holds a candidate for each pair of neighbours, its rank or
        ``NEVER``; the least comes up first, the leftmost among equals.
        """
        rank = self.rank.get
        sym, place = list(piece), list(range(len(piece)))
        agenda = [rank(piece[i : i + 2], NEVER) for i in range(len(sym) - 1)]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            if self.skipped(key, self.where(place[i], best)):
                agenda[i] = NEVER
                continue
            new = sym[i] = sym[i] + sym.pop(i + 1)
            del place[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(new + sym[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(sym[i - 1] + new, NEVER)
        return self._ids(sym)

    def _together(self, chars: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """``merge`` of many pre-tokens of one length, a row each: the symbol that starts at each place, or -1."""
        rows, size = chars.shape
        out = np.empty((rows, size), np.int32)
        # One column for each pre-token; the last place is a symbol that merges with nothing, on either side.
        sym = np.full((size + 1, rows), self.none, np.int32)
        sym[:size] = chars.T
        after = np.repeat(np.arange(1, size + 2, dtype=np.int32)[:, None], rows, 1)
        before = np.repeat(np.arange(-1, size, dtype=np.int32)[:, None], rows, 1)
        before[0] = size
        to = np.full((size + 1, rows), -1, np.int32)
        agenda = np.full((size + 1, rows), LAST, np.int32)
        for i in range(size - 1):
            to[i], agenda[i] = self._candidates(sym[i], sym[i + 1], i)
        who = np.arange(rows)
        while True:
            best = agenda.min(0)
            live = np.flatnonzero(best != LAST)
            if len(live) < 0.7 * len(who) or not len(live):
                ended = np.flatnonzero(best == LAST)
                out[who[ended]] = sym[:size, ended].T
                if not len(live):
                    return out
                who, keys, best = who[live], keys[live], best[live]
                sym, after, before, to, agenda = (np.ascontiguousarray(x[:, live]) for x in (sym, after, before, to, agenda))
                live = np.arange(len(who))
            else:
                best = best[live]
            n = len(who)
            i = (best & 31).astype(np.int64)
            x = keys[live] ^ (i.astype(U) * U(0x94D049BB133111EB) + (best >> 5).astype(U) * U(0xD6E8FEB86659FD93))
            x = (x ^ (x >> U(32))) * U(0x9E3779B97F4A7C15)
            skip = ((x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)) >> U(32) < U(self.bar)
            agenda.ravel()[(i * n + live)[skip]] = LAST
            r, i = live[~skip], i[~skip]
            at = i * n + r
            gone = after.ravel()[at] * n + r
            last = after.ravel()[gone]
            new = to.ravel()[at]
            sym.ravel()[at], sym.ravel()[gone] = new, -1
            agenda.ravel()[gone] = LAST
            after.ravel()[at], before.ravel()[last * n + r] = last, i
            to.ravel()[at], agenda.ravel()[at] = self._candidates(new, sym.ravel()[last * n + r], i)
            left = before.ravel()[at]
            at = left * n + r
            to.ravel()[at], agenda.ravel()[at] = self._candidates(sym.ravel()[at], new, left)

    def _ids(self, symbols: list[str]) -> bytes:
        number = self.number.get
        out = [number(x, -1) for x in symbols]
        if -1 in out:
            out = [j for x, i in zip(symbols, out, strict=True) for j in ([i] if i >= 0 else [self.byte[b] for b in x.encode("utf-8", "surrogatepass")])]
        return array("i", out).tobytes()

    def _long(self, piece: str, key: int) -> bytes:
        """The same for a pre-token too long for a scanned agenda: a heap of candidates over linked neighbours."""
        rank, n = self.rank, len(piece)
        sym: list[str | None] = list(piece)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple] = []

        def push(i: int, j: int) -> None:
            r = rank.get(sym[i] + sym[j])
            if r is not None and not self.skipped(key, self.where(i, r)):
                heapq.heappush(heap, (r, i, j, len(sym[i]) + len(sym[j])))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or right[i] != j or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i] += sym[j]
            sym[j] = None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return self._ids([x for x in sym if x is not None])

    def walk(self, pieces: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all occurrences, each under its key, and how many each has.  An empty one is a U+2581 of the text itself."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.zeros(len(pieces), np.int64)
        parts, alone = [], np.flatnonzero((lens == 0) | (lens > WIDE)).tolist()
        for size in np.unique(lens[(lens > 0) & (lens <= WIDE)]).tolist():
            at = np.flatnonzero(lens == size)
            text = "".join([pieces[i] for i in at.tolist()])
            chars = self.char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].reshape(-1, size)
            plain = (chars != self.none).all(1)  # others need bytes
            alone += at[~plain].tolist()
            at = at[plain]
            sym = self._together(chars[plain], keys[at])
            kept = sym >= 0
            counts[at] = kept.sum(1)
            parts.append((at, self.symbol_id[sym[kept]]))
        made = {}
        for i in alone:
            p, key = pieces[i], int(keys[i])
            raw = self.bar_ids if not p else self.merge(p, key) if len(p) <= LONG else self._long(p, key)
            made[i] = np.frombuffer(raw, "<i4")
            counts[i] = len(made[i])
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for at, ids in parts:
            c = counts[at]
            out[np.repeat(starts[at] - (np.cumsum(c) - c), c) + np.arange(len(ids))] = ids
        for i, ids in made.items():
            out[starts[i] : starts[i] + len(ids)] = ids
        return out, counts

    def encode_rows(self, texts: list[str], keys: list[int]) -> Iterator[np.ndarray]:
        """Token ids of whole texts, each under its row's key."""
        first = 0
        while first < len(texts):
            pieces, ends = [], []
            for t in texts[first:]:
                pieces += self._pieces(t)
                ends.append(len(pieces))
                if len(pieces) > TOGETHER:
                    break
            sizes = np.diff(ends, prepend=0)
            rows = np.repeat(np.array(keys[first : first + len(ends)], U), sizes)
            number = np.arange(len(pieces)) - np.repeat(np.array(ends) - sizes, sizes)
            ids, counts = self.walk(pieces, spread(rows + number.astype(U) * U(0x9E3779B97F4A7C15)))
            edge = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])].tolist()
            yield from (ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True))
            first += len(ends)

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        """Token ids of a whole text."""
        return next(self.encode_rows([text], [key]))

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens.  A U+2581 of the text itself, an empty one here, is spelled in bytes, so that it is told from a space."""
        if bpe.SPACE not in text:
            return bpe.pretokens(text)
        first, *rest = (bpe.PRETOKEN.findall(x) for x in self._parts(text))
        return [*first, *(p for x in rest for p in ("", *x))]

    @staticmethod
    def _parts(text: str) -> list[str]:
        first, *rest = text.split(bpe.SPACE)
        return [bpe.SPACE + first.replace(" ", bpe.SPACE), *(x.replace(" ", bpe.SPACE) for x in rest)]

    def decode(self, ids) -> str:
        """The text that was encoded."""
        out = b"".join(map(self.piece.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "surrogatepass")


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def row_key(seed: int, row: str, text: str) -> int:
    """The hash key of a row, of its id and copy number and of its text."""
    h = hashlib.blake2b(f"{seed}|{len(row)}|{row}|".encode(), digest_size=8)
    h.update(text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(h.digest(), "little")


_codecs: dict[tuple, Codec] = {}


def codec(name: str, dropout: float, seed: int) -> Codec:
    """One codec in a process, whose cache outlives a task."""
    key = (name, dropout, seed)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encoder(name: str, dropout: float, seed: int):
    """A Pandas UDF from a row's name (id and copy number) and text to the columns of SCHEMA."""

    @pandas_udf(SCHEMA)
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        c = codec(name, dropout, seed)
        for names, texts in batches:
            texts = [t if isinstance(t, str) else "" for t in texts]
            all_ids = c.encode_rows(texts, [row_key(seed, k, t) for k, t in zip(names, texts, strict=True)])
            rows = [(ids, len(ids), c.decode(ids.tolist()) == t) for ids, t in zip(all_ids, texts, strict=True)]
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "lossless"])

    return encode


def decoder(name: str):
    """A Pandas UDF from token ids to text."""

    @pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(name, 0.0, 0)
        for s in batches:
            yield pd.Series([None if x is None else c.decode(np.asarray(x).tolist()) for x in s], dtype=object)

    return decode


def encode(
    docs: DataFrame, *, model: str = "piece_bpe_32k.model", dropout: float = DROPOUT, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None,
) -> DataFrame:
    """Token ids of every whole text, one row for each row: id, ``ids``, ``n_tokens``, ``lossless``.

    ``lossless`` says that decoding gave the text back; it is always true.  An
    absent or empty text has no tokens.  Rows of one id and text get the same
    tokens, an absent id counting as an empty one, unless ``copy_col`` numbers
    them; an empty table gives an empty result; other columns are not carried.
    """
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be at least 0 and below 1")
    common.small_batches(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    if copy_col is not None:
        key = F.concat(key, F.lit("|"), F.coalesce(F.col(copy_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col), encoder(model, dropout, seed)(key, F.col(text_col)).alias("v")).select(id_col, "v.*")


def decode(rows: DataFrame, *, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of ``encode``'s rows, under the name ``text``; absent ids stay absent."""
    common.small_batches(rows.sparkSession)
    return rows.select(F.col(id_col), decoder(model)(F.col(ids_col)).alias("text"))
