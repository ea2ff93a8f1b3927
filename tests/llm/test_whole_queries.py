"""Whole queries against plain recomputations of every row: no shared step but the trained weights and tables."""

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from curvelake.llm import bpe, common, crf, merge_dropout, quality_rules, queries, token_counts, toxicity

from ..conftest import DATA
from .test_spark import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    """All documents of the smallest tables, and the odd texts."""
    docs = common.read(spark, DATA, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(None if i is None else -i, t) for i, t in EDGE], "doc_id long, text string")
    return docs.unionByName(odd).repartition(5)


def held(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def answers(df, documents):
    """A query's rows beside their texts: (id, text, row), where the query hands on rows in the order of its input."""
    got = df.collect()
    ids = [r["doc_id"] for r in got]
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert ids == [i for i, _ in texts]
    return [(i, t, r) for (i, t), r in zip(texts, got, strict=True)]


def test_quality_rules(documents):
    pack = zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_checksum=False, write_content_size=False)

    def fits(data):
        low, high = next((a, b) for most, a, b in quality_rules.BANDS if most is None or len(data) < most)
        return low <= len(data) / len(pack.compress(data)) <= high

    for i, t, r in answers(quality_rules.rules(documents), documents):
        text = t or ""
        words = WORD.findall(text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        seen = Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        dups = sum(x in lines[:k] for k, x in enumerate(lines))
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))), i
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (dups, len(repeated)), i
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        assert r["base_failed"] == failed
        data = text.encode()
        size = quality_rules.CHUNK_BYTES
        chunks = [data[a : a + size] for a in range(0, len(data), size)]
        if len(chunks) > 1 and 2 * len(chunks[-1]) <= size:
            chunks[-2:] = [chunks[-2] + chunks[-1]]
        assert r["kept"] == (not failed and fits(data) and (len(data) <= size or all(map(fits, chunks)))), i


def test_token_counts(documents):
    sp = bpe.processor(bpe.model_path())
    for i, t, r in answers(token_counts.token_counts(documents), documents):
        n = len(sp.encode(t or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 4096), i


def test_token_counts_where_the_table_is_small(documents, monkeypatch):
    """Almost every pre-token misses the table and goes through the workers' caches."""
    monkeypatch.setattr(token_counts, "TABLE", 5)
    sp = bpe.processor(bpe.model_path())
    for i, t, r in answers(token_counts.token_counts(documents), documents):
        assert r["n_tokens"] == len(sp.encode(t or "")), i


def test_quality_field(spark, documents):
    field = crf.train(common.read(spark, DATA, "documents"), common.read(spark, DATA, "labels"))

    def chances(unary):
        """Forward and backward sums of one document, in logarithms, a line at a time."""
        at = [np.array([0.0, u]) for u in unary]
        ahead = [at[0]]
        for u in at[1:]:
            ahead.append(np.array([np.logaddexp(ahead[-1][0] + field.pair[0, y], ahead[-1][1] + field.pair[1, y]) + u[y] for y in (0, 1)]))
        back = [np.zeros(2)]
        for u in at[:0:-1]:
            back.append(np.array([np.logaddexp(field.pair[y, 0] + u[0] + back[-1][0], field.pair[y, 1] + u[1] + back[-1][1]) for y in (0, 1)]))
        return [1 / (1 + math.exp(min(700, (a + b)[0] - (a + b)[1]))) for a, b in zip(ahead, back[::-1], strict=True)]

    for i, t, r in answers(crf.classify(documents, field), documents):
        x, lengths = crf.features(t)
        p = chances(((x - field.mean) / field.dev) @ field.w)
        q = min(max(sum(a * b for a, b in zip(p, lengths, strict=True)) / sum(lengths), 1e-4), 1 - 1e-4)
        want = 1 / (1 + math.exp(-(field.link[0] * math.log(q / (1 - q)) + field.link[1])))
        assert abs(r["score"] - want) < 1e-9, i
        assert (r["held_out"], r["predicted"]) == (held(i, 4) == 2, int(r["score"] >= 0.7))


def test_toxicity(spark, documents):
    model = toxicity.train(common.read(spark, DATA, "documents"), common.read(spark, DATA, "labels"))
    sizes = toxicity.Sizes(model.ordinary).c, toxicity.Sizes(model.toxic).c
    values = [int(v) for v in toxicity._VALUES]

    def spelled(data):
        """Each byte of words as four bytes that depend on its word so far."""
        out, h, power = b"", 0, 1
        for b in data:
            if b == 32:
                h, power = 0, 1
            h = (h + values[b] * power) % (1 << 64)
            power = power * toxicity._BASE % (1 << 64)
            x = (h ^ (h >> 31)) * 0x94D049BB133111EB % (1 << 64)
            out += struct.pack("<I", x >> 32)
        return out

    n = toxicity.WINDOW_WORDS
    for i, t, r in answers(toxicity.classify(documents, model), documents):
        words = common.lower_words(t)
        if len(words) > 4000:
            continue  # test_long_texts_are_cut_at_windows; a byte at a time is slow here
        windows = [spelled(b" " + b" ".join(words[k : k + n])) for k in range(0, len(words), n)] or [spelled(b" ")[:1]]
        gains = [len(sizes[0].compress(w)) - len(sizes[1].compress(w)) for w in windows]
        over = sum(g >= model.limit for g in gains)
        top = [min(max(g, 0), 40) for g in sorted(gains)[-3:]]
        x = [min(max(gains), 40) / 10, sum(top) / len(top) / 10, math.log1p(over), over / math.sqrt(len(gains))]
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip([*x, 1.0], model.weights, strict=True))))
        assert abs(r["score"] - want) < 1e-9, i
        assert (r["held_out"], r["predicted"]) == (held(i, 5) == 0, int(r["score"] >= 0.5))


def test_merge_dropout(documents):
    """Every pre-token by scanning all pairs for the best that is not skipped."""
    c = merge_dropout.codec("piece_bpe_32k.model", merge_dropout.DROPOUT, merge_dropout.SEED)
    sp = bpe.processor(bpe.model_path())

    def pieces_of(piece, k):
        sym, place = list(piece), list(range(len(piece)))
        while True:
            found = [(c.rank[a + b], j) for j, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if a + b in c.rank]
            best = next(((rk, j) for rk, j in sorted(found) if not c.skipped(k, c.where(place[j], rk))), None)
            if best is None:
                break
            j = best[1]
            sym[j : j + 2] = [sym[j] + sym[j + 1]]
            del place[j + 1]
        return [x for s in sym for x in ([c.number[s]] if s in c.number else [c.byte[b] for b in s.encode()])]

    mask = merge_dropout.MASK64
    for i, t, r in answers(merge_dropout.encode(documents), documents):
        text = t or ""
        assert r["lossless"] and r["n_tokens"] == len(r["ids"]) and c.decode(r["ids"]) == text
        if bpe.SPACE in text or len(text) > 20_000:
            continue
        row = merge_dropout.row_key(merge_dropout.SEED, "" if i is None else str(i), text)
        want = []
        for number, p in enumerate(bpe.pretokens(text)):
            k = (row + number * 0x9E3779B97F4A7C15) & mask
            want += pieces_of(p, int(merge_dropout.spread(np.array([k], np.uint64))[0]))
        assert r["ids"] == want, i
    for i, t, r in answers(merge_dropout.encode(documents, dropout=0.0), documents):
        assert bpe.SPACE in (t or "") or r["ids"] == sp.encode(t or ""), i


def test_registered_queries_are_these_operators(spark):
    """The queries apply the operators above to the whole table."""
    docs = common.read(spark, DATA, "documents")
    ids = sorted(r[0] for r in docs.select("doc_id").collect())
    for name in ("op2_quality_rules", "op4_token_counts"):
        got = {r["doc_id"]: r for r in queries.queries()[name](spark, DATA).collect()}
        assert sorted(got) == ids
        own = {"op2_quality_rules": quality_rules.rules, "op4_token_counts": token_counts.token_counts}[name]
        assert got == {r["doc_id"]: r for r in own(docs).collect()}
