"""Language-model scores from a hidden Markov model over words.

Counting: each partition counts its training words and the counts are summed
by word.  The words seen most are broadcast (a bounded table); the rest stay
in a written table and are looked up by a join of each document's rare words.

Model: a document is a walk over latent states; each state emits a word class
and the class emits the word.  The most frequent words are classes of their
own, all others share classes by a hash.  So the chance of a text is the
forward sum over its classes times a factor for each rare word, and both
parts are exact.  Baum-Welch starts from the class shares, tilted by a seeded
factor for each state, and every round reads all training documents whole: each
partition adds up its expected counts, Spark sums them, and the driver gets one
row for each class.

An unseen word counts half a time in its class, as it does in the base score,
so the model's chances sum to one over the known words and an unknown word
for each class.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.llm import common

STATES = 6
#: Words with a class of their own, classes that the others share, and words in the broadcast table.
OWN = 20_000
SHARED = 2_000
HEAD = 300_000
#: Rounds of Baum-Welch, each over all training documents.
ROUNDS = 14
#: Tokens of one padded group of documents, of the batches taken together (two bytes each), and of a segment of a longer sequence.
GROUP = 2_000_000
HELD = 4_000_000
SEGMENT = 100_000
#: Tokens whose expected counts are added to the classes at once.
BLOCK = 200_000
#: Bytes of words that one task holds while it counts.
COUNTED = 256 << 20
END = b"\n"  # no word is a line feed
ADDED = 0.5


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, then the end."""
    return [*common.lower_words(text), END]


@dataclass
class Vocabulary:
    """What all tasks know: the head's words by falling count, and totals."""

    words: bytes
    counts: np.ndarray
    n: int
    v: int
    own: int = OWN
    shared: int = SHARED

    def shared_class(self, word: bytes) -> int:
        return self.own + zlib.crc32(word) % self.shared

    @property
    def base_total(self) -> float:
        return self.n + ADDED * (self.v + 1)


_tables: dict[tuple, tuple[dict[bytes, int], np.ndarray]] = {}


def _table(voc: Vocabulary, words: bytes) -> tuple[dict[bytes, int], np.ndarray]:
    """Word to its place in the head, and each place's class; made once in a process."""
    key = zlib.crc32(words), len(words), voc.own, voc.shared
    if key not in _tables:
        _tables.clear()
        # A word holds no space, so spaces part the words; the end is the one line feed.
        names = words.split(b" ") if words else []
        classes = [i if i < voc.own else voc.shared_class(w) for i, w in enumerate(names)]
        _tables[key] = {w: i for i, w in enumerate(names)}, np.array(classes, np.int64)
    return _tables[key]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts, one after the other, and how many each text has; an absent text has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = pc.cast(pc.list_flatten(lists), pa.binary())
    lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # space at either end leaves an empty string there
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        ends = np.cumsum(lens)
        flat, lens = flat.filter(pa.array(full)), before[ends] - before[ends - lens]
    return flat, lens


def _summed(parts: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")])
    return pa.table({"word": summed["word"], "c": summed["c_sum"]})


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """``word, c`` over all rows; each task sums its own before anything moves."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for b in batches:
            words, _ = split_words(b.column(0))
            counts = words.value_counts()
            ends = pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([b.num_rows], pa.int64())})
            held += [pa.table({"word": counts.field("values"), "c": counts.field("counts")}), ends]
            rows, size = rows + len(counts), size + counts.nbytes
            if rows > 2_000_000 or size > COUNTED:
                held = [_summed(held)]
                rows, size = held[0].num_rows, held[0].nbytes
                if rows > 1_000_000 or size > COUNTED // 2:
                    yield from held[0].to_batches()
                    held, rows, size = [], 0, 0
        if held:
            yield from _summed(held).to_batches()

    return docs.select(text_col).mapInArrow(partial, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The words above a count that leaves at most ``most`` of them, by falling count.

    The count comes from a histogram over steps of its logarithm, so no task
    and not the driver sorts the vocabulary.
    """
    step = F.floor(F.log2("c") * 16)
    steps = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, taken = None, 0
    for s, n in steps:
        taken += n
        if taken > most:
            break
        least = s
    if least is None:
        return []
    rows = counts.where(step >= least).toPandas()
    return sorted(((bytes(w), int(c)) for w, c in zip(rows["word"], rows["c"], strict=True)), key=lambda x: (-x[1], x[0]))


ENCODED = "rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, head double, shared_log double, classes binary, rare array<struct<w:binary,n:int>>"


def encode(docs: DataFrame, voc: Vocabulary, id_col: str, text_col: str, held: F.Column) -> DataFrame:
    """Classes of every whole text, sums over its head words, and its rare words with their numbers."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((voc.words, voc.counts))
    total, own = voc.base_total, voc.own
    shell = Vocabulary(b"", voc.counts[:0], voc.n, voc.v, voc.own, voc.shared)
    id_type = dict(docs.dtypes)[id_col]
    schema = ENCODED.format(kind=id_type)
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = sent.value
        place, classes = _table(shell, words)
        log_head = np.log10((counts + ADDED) / total)
        log_count = np.log10(counts + ADDED)
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            words_here, lens = split_words(b.column(1))
            coded = words_here.dictionary_encode()
            distinct = [*coded.dictionary.to_pylist(), END]
            found = np.fromiter((place.get(w, -1) for w in distinct), np.int64, len(distinct))
            cls = classes[found] if len(classes) else found.copy()
            for i in np.flatnonzero(found < 0).tolist():
                cls[i] = shell.shared_class(distinct[i])
            # The end follows the words of each text.
            codes = np.full(len(words_here) + n, len(distinct) - 1, np.int64)
            of = np.repeat(np.arange(n), lens)
            codes[np.arange(len(of)) + of] = coded.indices.to_numpy()
            lens = lens + 1
            of, edge = np.repeat(np.arange(n), lens), np.concatenate([[0], np.cumsum(lens)])
            inside = found >= 0
            value = np.where(inside, log_head[found], 0.0) if len(log_head) else np.zeros(len(distinct))
            value_shared = np.where(found >= own, log_count[found], 0.0) if len(log_head) else value
            missing = np.flatnonzero(~inside[codes])
            pairs, times = np.unique(of[missing] * len(distinct) + codes[missing], return_counts=True)
            rare_edge = np.searchsorted(pairs, np.arange(n + 1) * len(distinct))
            rare = pa.StructArray.from_arrays([pa.array(distinct, pa.binary()).take(pa.array(pairs % len(distinct))), pa.array(times, pa.int32())], ["w", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(at, at + n), pa.int64()), b.column(0), b.column(2), pa.array(lens), pa.array(np.bincount(of, inside[codes], n).astype(np.int64)),
                    pa.array(np.bincount(of, value[codes], n)), pa.array(np.bincount(of, value_shared[codes], n)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * edge).astype(np.int32)), pa.py_buffer(cls[codes].astype("<u2"))]),
                    pa.ListArray.from_arrays(pa.array(rare_edge, pa.int32()), rare),
                ],
                names=["rid", "doc_id", "held_out", "n_tokens", "known", "head", "shared_log", "classes", "rare"],
            )
            at += n

    return cols.mapInArrow(run, schema)


@dataclass
class Hmm:
    """Start, transition and emission chances; emission is classes by states."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def class_mass(totals: np.ndarray, own: int) -> np.ndarray:
    """Totals with the half count of an unseen word; classes of their own that no word has got have none."""
    return np.where((totals > 0) | (np.arange(len(totals)) >= own), totals + ADDED, 0.0)


def first_model(mass: np.ndarray, k: int, seed: int = 3) -> Hmm:
    """Class shares, tilted by a seeded factor for each state, and states that last."""
    rng = np.random.default_rng(seed)
    emit = mass[:, None] * rng.uniform(0.5, 1.5, (len(mass), k))
    move = np.full((k, k), 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
    if k > 1:
        np.fill_diagonal(move, 0.9)
    return Hmm(np.full(k, 1 / k), move, emit / emit.sum(0))


def _groups(seqs: list[np.ndarray], most: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences of like length, longest first: which, their classes one time after the other, and how many still run at each time."""
    lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
    order = np.argsort(-lens, kind="stable")
    at = 0
    while at < len(order):
        longest = int(lens[order[at]])
        take = order[at : at + (1 if longest > SEGMENT else max(1, most // longest))]
        m = np.zeros((longest, len(take)), np.int64)
        for j, i in enumerate(take.tolist()):
            m[: lens[i], j] = seqs[i]
        live = np.searchsorted(-lens[take], -np.arange(longest), side="left")
        yield take.tolist(), m[np.arange(len(take))[None, :] < live[:, None]], live
        at += len(take)


def _every(model: Hmm) -> int:
    """Steps between two scalings: the chances of so many classes stay above 1e-150."""
    least = model.emit[model.emit > 0].min()
    return max(1, min(16, int(150 / max(1e-9, -math.log10(least)))))


_space = np.empty(0)


def _room(n: int, k: int) -> np.ndarray:
    """An array that every group of a process uses again, for new memory costs as much as a step over it."""
    global _space
    if _space.size < n * k:
        _space = np.empty(n * k)
    return _space[: n * k].reshape(n, k)


def _forward(model: Hmm, cls: np.ndarray, live: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Forward chances of all times, scaled to one at some times and at the last; those times' scales; and where each time starts.

    The chances stand where those of the next call will.
    """
    k, every, scales = len(model.start), _every(model), {}
    alpha, ones = _room(len(cls), k), np.ones(k)
    edge = np.concatenate([[0], np.cumsum(live)])
    at, last = edge.tolist(), len(live) - 1
    for t in range(len(live)):
        a, b = at[t], at[t + 1]
        x = alpha[a:b]
        if t:
            np.dot(alpha[at[t - 1] : at[t - 1] + b - a], model.move, out=x)
        else:
            x[:] = model.start if before is None else before @ model.move
        x *= model.emit.take(cls[a:b], 0, mode="clip")
        if t % every == 0 or t == last:
            scales[t] = np.dot(x, ones)
            x /= scales[t][:, None]
    return alpha, scales, edge


def _ends(alpha: np.ndarray, live: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """What the forward chances of each sequence add up to at its end, which need not be a time of scaling."""
    j = np.arange(int(live[0]))
    return alpha[edge[np.searchsorted(-live, -j, side="left") - 1] + j].sum(1)


def forward(model: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 of the chance of each class sequence, by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    for take, cls, live in _groups(seqs, GROUP):
        if len(live) > SEGMENT:  # one sequence, in parts
            before = None
            for a in range(0, len(cls), SEGMENT):
                part = cls[a : a + SEGMENT]
                alpha, scales, _ = _forward(model, part, np.ones(len(part), np.int64), before)
                before = alpha[-1:].copy()
                out[take] += np.log10(np.concatenate([*scales.values()])).sum()
            continue
        alpha, scales, edge = _forward(model, cls, live)
        sums = np.log10(_ends(alpha, live, edge))
        for x in scales.values():
            sums[: len(x)] += np.log10(x)
        out[take] = sums
    return out


class Expected:
    """Expected counts of Baum-Welch, which add up over documents and partitions."""

    def __init__(self, classes: int, k: int):
        self.emit, self.move, self.start = np.zeros((classes, k)), np.zeros((k, k)), np.zeros(k)
        self.log = 0.0

    def add(self, model: Hmm, seqs: list[np.ndarray]) -> None:
        """One pass over whole sequences.

        Of one beyond ``SEGMENT`` tokens only the forward chances at the ends
        of segments are kept; going back, each segment's are made again and the
        backward chances are handed on, so that counts are exact in bounded memory.
        """
        for _, cls, live in _groups(seqs, GROUP):
            if len(live) <= SEGMENT:
                self._add(model, cls, live)
                continue
            parts, ends = [cls[a : a + SEGMENT] for a in range(0, len(cls), SEGMENT)], [None]
            for p in parts[:-1]:
                ends.append(_forward(model, p, np.ones(len(p), np.int64), ends[-1])[0][-1:].copy())
            after = None
            for p, before in zip(parts[::-1], ends[::-1], strict=True):
                after = self._add(model, p, np.ones(len(p), np.int64), before, after)

    def _add(self, model: Hmm, cls: np.ndarray, live: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Counts of a group; ``before`` and ``after`` are the forward and backward chances that it follows and that it ends with."""
        alpha, scales, edge = _forward(model, cls, live, before)
        ended = _ends(alpha, live, edge)
        self.log += float(sum(np.log(x).sum() for x in scales.values()) + np.log(ended).sum())
        k, at = len(model.start), edge.tolist()
        beta = np.repeat(1 / ended[:, None], k, 1) if after is None else after.copy()
        back, moved = np.ascontiguousarray(model.move.T), np.zeros((k, k))
        for t in range(len(live) - 1, -1, -1):
            a, b = at[t], at[t + 1]
            n = b - a
            w = model.emit.take(cls[a:b], 0, mode="clip")
            w *= beta[:n]
            if t in scales:
                w /= scales[t][:, None]
            alpha[a:b] *= beta[:n]
            if t:
                moved += alpha[at[t - 1] : at[t - 1] + n].T @ w
                np.dot(w, back, out=beta[:n])
            elif before is None:
                self.start += alpha[a:b].sum(0)
            else:
                moved += before.T @ w
                beta = w @ back
        self.move += model.move * moved
        for a in range(0, len(cls), BLOCK):
            part, shares = cls[a : a + BLOCK], np.ascontiguousarray(alpha[a : a + BLOCK].T)
            for z in range(k):
                self.emit[:, z] += np.bincount(part, shares[z], len(self.emit))
        return beta

    def model(self, mass: np.ndarray) -> Hmm:
        """The next model.  Each class keeps a small share in every state, so that no text has chance 0."""
        share = mass / mass.sum()
        emit = self.emit + share[:, None] * np.maximum(10.0, 0.01 * self.emit.sum(0))
        move = self.move + 1.0
        start = self.start + 1.0
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _together(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches of about ``HELD`` tokens, with their class sequences: the more, the more long documents share the steps of a group."""
    held, seqs, size = [], [], 0
    for b in batches:
        held.append(b)
        new = [_sequence(x) for x in b.column(at).to_pylist()]
        seqs += new
        size += sum(map(len, new))
        if size >= HELD:
            yield held, seqs
            held, seqs, size = [], [], 0
    if held:
        yield held, seqs


def _sequence(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2")


def baum_welch(encoded: DataFrame, model: Hmm, mass: np.ndarray) -> Hmm:
    """One round over all training documents."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast((model.start, model.move, model.emit))
    size, k = model.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Hmm(*sent.value)
        e = Expected(size, k)
        for _, seqs in _together(batches, 0):
            e.add(now, seqs)
        # Rows size.. hold the transitions, the last one the starts.
        table = np.concatenate([e.emit, e.move, e.start[None]])
        rows = np.flatnonzero(table.sum(1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(table[rows, z]) for z in range(k))], names=["row", *(f"s{z}" for z in range(k))])

    parts = encoded.where(~F.col("held_out")).select("classes").mapInArrow(run, "row int, " + ", ".join(f"s{z} double" for z in range(k)))
    summed = parts.groupBy("row").agg(*(F.sum(f"s{z}").alias(f"s{z}") for z in range(k))).toPandas()  # at most one row a class
    sent.unpersist()
    e = Expected(size, k)
    table = np.zeros((size + k + 1, k))
    table[summed["row"].to_numpy()] = summed[[f"s{z}" for z in range(k)]].to_numpy()
    e.emit, e.move, e.start = table[:size], table[size:-1], table[-1]
    return e.model(mass)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, own: int = OWN, shared: int = SHARED, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """Base score and model score of every whole text, one row for each row.

    The model learns from rows whose crc32(id as text) modulo ``folds`` is not
    ``held``.  An absent text is empty and has one token, the end; an absent
    id counts as an empty text in the fold; repeated rows each count and are
    each scored.  With no training rows every word is unknown.  An empty table
    gives an empty result; other columns are not carried.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "hmm")
    held_out = common.fold(id_col, folds) == held
    counts = scratch.cut(count_words(docs.where(~held_out), text_col))
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts, head)
    words = [w for w, _ in top]
    voc = Vocabulary(b" ".join(words), np.array([c for _, c in top], np.float64), int(totals["n"] or 0), int(totals["v"] or 0), own, shared)
    # Exact totals of all classes: own ones from the head, shared ones summed where the words are.
    others = (
        counts.join(F.broadcast(spark.createDataFrame([(w,) for w in words[:own]], "word binary")), "word", "left_anti")
        .groupBy((F.crc32("word") % shared).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.sum(F.col("c") + ADDED).alias("m")).collect()
    )
    class_totals, mass = np.zeros(own + shared), np.full(shared, ADDED)
    class_totals[: min(own, len(words))] = voc.counts[:own]
    for r in others:
        class_totals[own + r["k"]] = r["c"]
        mass[r["k"]] += r["m"]
    encoded = scratch.cut(encode(docs, voc, id_col, text_col, held_out))
    weights = class_mass(class_totals, own)
    trained = first_model(weights, STATES)
    for _ in range(rounds):
        trained = baum_welch(encoded, trained, weights)
    # Rare words: their counts come to them by a join on the word.
    rare = encoded.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.w").alias("word"), F.col("r.n").alias("k"))
    found = rare.join(counts, "word", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ADDED))).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"), F.sum("k").alias("rare_n"),
    )
    sent = spark.sparkContext.broadcast((trained.start, trained.move, trained.emit, np.log10(mass)))
    total = voc.base_total
    kept = ["rid", "doc_id", "held_out", "n_tokens", "known", "head", "shared_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, log_mass = sent.value
        model = Hmm(start, move, emit)
        for held, seqs in _together(batches, len(kept)):
            logs = forward(model, seqs)
            # A word of a shared class has the chance (c + 0.5) / the class's mass within it.
            for i, s in enumerate(seqs):
                logs[i] -= log_mass[s[s >= own] - own].sum()
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(logs[: b.num_rows])], names=[*kept, "walk"])
                logs = logs[b.num_rows :]

    types = dict(encoded.dtypes)
    walked = encoded.select(*kept, "classes").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", walk double")
    out = walked.join(found, "rid", "left")
    rare_log, rare_n = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_n", F.lit(0))
    return out.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(voc.n).cast("long").alias("train_tokens"), (F.col("head") + rare_log - rare_n * F.lit(float(np.log10(total)))).alias("base_score"),
        (F.col("walk") + F.col("shared_log") + rare_log).alias("score"),
    )
