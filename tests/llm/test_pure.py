"""The operators' cores without Spark: brute force, exact round trips, held-out accuracy."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

from curvelake.llm import bpe, crf, hamming, hmm, jaccard, merge_dropout, quality_rules, sharding, token_counts, toxicity

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "  a  b ", "a\nb", "\n", "\n\n x", " \n y", "a\r\nb\tc", "<s> </s><unk>", "é ﬁ ２　x", "x▁y", "▁", "▁▁a ▁", " ▁a", "\x00a", "a" * 3000, "日本語 テスト\n梦", "  \n  \n", "### $$%%&&"]


def labelled(label):
    sql = f"SELECT doc_id, text, {label} FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) ORDER BY md5(doc_id::VARCHAR)"
    return duckdb.sql(sql).fetchall()


def texts(n=300):
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()]


# --- toxicity


def test_spelling_is_of_words():
    a, sa, _ = toxicity.windows([b"an idiot was".split()])
    b, sb, _ = toxicity.windows([b"the idiot".split()])
    assert a[3 * 4 : 9 * 4] == b[4 * 4 : 10 * 4]  # " idiot" is spelled alike wherever it stands
    assert sa[0][1] == len(b" an idiot was") * 4


def test_toxic_words_are_found_and_clean_text_is_not():
    rnd = random.Random(1)
    syl = ["an", "er", "th", "ing", "on", "re", "ed", "ha", "ou", "ti"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4)))
    bad = ["idiot", "clown", "pathetic", "scum"]

    def doc(toxic):
        ws = [word() for _ in range(rnd.randint(30, 200))]
        for _ in range(4 * toxic):
            ws[rnd.randrange(len(ws))] = rnd.choice(bad)
        return " ".join(ws)

    rows = [(doc(i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    model = toxicity.fit(rows[:400])
    got = model.scores([t for t, _ in rows[400:]]) >= 0.5
    want = np.array([y for _, y in rows[400:]], bool)
    assert (got == want).mean() > 0.95
    assert model.scores(["", None]).shape == (2,)


def test_dictionaries_are_trained_on_either_class():
    """Both come out of zstandard's training on windows; a repeated toxic beginning is in the toxic one only, a chance word in neither."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    ordinary = [" ".join(word() for _ in range(120)) for _ in range(400)]
    toxic = [" ".join([*(word() for _ in range(60)), "xyzzy" + word(), *(word() for _ in range(60))]) for _ in range(400)]
    own, rest = toxicity.dictionaries(toxic, ordinary)
    assert len(own) == len(rest) == toxicity.CLASS_BYTES + toxicity.BACKGROUND_BYTES
    gains = toxicity.Model(own, rest, 0.0, [0.0] * 5).gains([" ".join(["xyzzy" + word(), *(word() for _ in range(15))]), ordinary[0]])
    assert gains[0].min() >= 10 and abs(gains[1]).max() <= 3  # one word is enough, and chance matches are alike on both sides
    assert own[toxicity.CLASS_BYTES :] == rest[toxicity.CLASS_BYTES :]


def test_spelling_has_no_longest_word():
    long = b"a" * 300 + b"b"
    coded = np.frombuffer(toxicity.windows([[long, long[:-1] + b"c"]])[0], np.uint32)
    assert (coded[:301] == coded[302:603]).all() and coded[301] != coded[603]
    assert len(np.unique(coded[:302])) == 302


def test_toxicity_degenerate_fits():
    for rows in ([], [("a b c", 0)] * 5, [("a b", 1)] * 5, [("", 0), (None, 1)]):
        s = toxicity.fit(rows).scores(["a b c", None, ""])
        assert ((s >= 0) & (s <= 1)).all()


def test_long_texts_are_cut_at_windows():
    long = "word idiot " * 60_000
    model = toxicity.fit([("a b c d", 0)] * 4)
    assert sum(map(len, model.gains([long]))) == math.ceil(120_000 / toxicity.WINDOW_WORDS)


# --- quality rules


def brute_repeat(words, k=8):
    n = len(words) - k + 1
    seen = collections.Counter(tuple(words[i : i + k]) for i in range(max(0, n)))
    hit = set()
    for i in range(max(0, n)):
        if seen[tuple(words[i : i + k])] > 1:
            hit |= set(range(i, i + k))
    return len(hit)


def test_repeats_by_brute_force():
    rnd = random.Random(2)
    for n in (0, 3, 8, 9, 16, 40, 300):
        for kinds in (1, 2, 5):
            w = [str(rnd.randrange(kinds)).encode() for _ in range(n)]
            assert quality_rules.repeat_words(w) == brute_repeat(w)


def test_rules_counts_and_bands():
    c = zstandard.ZstdCompressor(level=3)
    pack = lambda b: len(c.compress(b))
    r = dict(zip([x.split()[0] for x in quality_rules.SCHEMA.split(", ")], quality_rules.judge("é a# \nb\n\nb\n \nb", pack), strict=True))
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (5, 6, 1, 2)
    assert quality_rules.judge(None, pack)[0] == 0 and not quality_rules.judge("", pack)[-1]
    keep = [quality_rules.judge(t, pack)[-1] for _, t, q in labelled("quality") if q == 1]
    assert np.mean(keep) > 0.93
    assert not quality_rules.judge("spam " * 400, pack)[-1]
    assert not quality_rules.judge(" ".join(random.Random(3).randbytes(6).hex() for _ in range(900)), pack)[-1]


# --- language model


def test_forward_by_all_paths():
    rng = np.random.default_rng(1)
    m = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [np.array(s) for s in ([0], [1, 4, 2], [3, 3, 0, 1], [2, 2])]
    for s, got in zip(seqs, hmm.forward(m, seqs), strict=True):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for i in range(1, len(s)):
                p *= m.move[path[i - 1], path[i]] * m.emit[s[i], path[i]]
            total += p
        assert math.isclose(got, math.log10(total), rel_tol=1e-12)


def test_expected_counts_by_all_paths():
    rng = np.random.default_rng(2)
    m = hmm.Hmm(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(4), 2).T)
    seqs = [np.array(s) for s in ([0, 1, 3], [2], [1, 1, 2, 0])]
    e = hmm.Expected(4, 2)
    e.add(m, list(seqs))
    emit, move, start = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2)
    for s in seqs:
        paths = {}
        for path in np.ndindex(*[2] * len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for i in range(1, len(s)):
                p *= m.move[path[i - 1], path[i]] * m.emit[s[i], path[i]]
            paths[path] = p
        z = sum(paths.values())
        for path, p in paths.items():
            start[path[0]] += p / z
            for i, k in enumerate(path):
                emit[s[i], k] += p / z
                if i:
                    move[path[i - 1], k] += p / z
    assert np.allclose(e.emit, emit) and np.allclose(e.move, move) and np.allclose(e.start, start)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(3)
    seqs = [rng.choice(6, 50, p=[0.4, 0.4, 0.05, 0.05, 0.05, 0.05] if i % 2 else [0.05, 0.05, 0.05, 0.05, 0.4, 0.4]) for i in range(60)]
    totals = np.bincount(np.concatenate(seqs), minlength=6).astype(float)
    m = hmm.first_model(totals, 2)
    before = hmm.forward(m, seqs).sum()
    for _ in range(15):
        e = hmm.Expected(6, 2)
        e.add(m, list(seqs))
        m = e.model(totals)
    assert hmm.forward(m, seqs).sum() > before + 50


def test_long_sequences_in_segments_count_the_same(monkeypatch):
    rng = np.random.default_rng(11)
    m = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [rng.integers(0, 5, n) for n in (1, 7, 23, 50, 8)]
    whole, parts = hmm.Expected(5, 3), hmm.Expected(5, 3)
    whole.add(m, seqs)
    logs = hmm.forward(m, seqs)
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    parts.add(m, seqs)
    for x in ("emit", "move", "start"):
        assert np.allclose(getattr(whole, x), getattr(parts, x))
    assert np.allclose(hmm.forward(m, seqs), logs) and abs(whole.log - parts.log) < 1e-9


def test_chances_are_scaled_at_few_times_and_stay_right():
    """By logarithms at every step; scaling each step was most of a round's cost."""
    rng = np.random.default_rng(12)
    emit = rng.dirichlet(np.ones(40), 3).T * 10.0 ** -rng.integers(0, 12, (40, 1))
    m = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), emit / emit.sum(0))
    seqs = [rng.integers(0, 40, n) for n in (300, 1, 17, 16, 250, 33, 300)]
    for s, got in zip(seqs, hmm.forward(m, seqs), strict=True):
        a = np.log(m.start) + np.log(m.emit[s[0]])
        for c in s[1:]:
            a = np.logaddexp.reduce(a[:, None] + np.log(m.move), 0) + np.log(m.emit[c])
        assert math.isclose(got, np.logaddexp.reduce(a) / math.log(10), rel_tol=1e-12)
    e = hmm.Expected(40, 3)
    e.add(m, seqs)
    assert np.allclose(e.emit.sum(1), np.bincount(np.concatenate(seqs), minlength=40)) and math.isclose(e.move.sum(), sum(len(s) - 1 for s in seqs))
    scales = hmm._forward(m, seqs[0], np.ones(300, np.int64))[1]
    assert len(scales) <= 300 // 8


def test_texts_are_split_into_the_words_of_tokens():
    texts = [None, "", " \n\t ", " a  B\x1c\x0bc\x85 ", "\u00c9 \u00e9\u00a0\u00c9 AbC\x00d", "".join(map(chr, range(1, 128))), "\U0001f600 A\u2003b", "q Q q"]
    words, lens = hmm.split_words(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in hmm.tokens(t)[:-1]]
    assert lens.tolist() == [len(hmm.tokens(t)) - 1 for t in texts]


def test_chances_of_a_small_vocabulary_sum_to_one():
    totals = np.array([9.0, 4, 0, 0, 2, 0])  # two words of their own, two empty places, two shared classes
    mass = hmm.class_mass(totals, 4)
    assert mass.tolist() == [9.5, 4.5, 0, 0, 2.5, 0.5]
    m = hmm.first_model(mass, 3)
    e = hmm.Expected(6, 3)
    e.add(m, [np.array([0, 1, 0, 4]), np.array([1, 1])])
    for x in (m, e.model(mass)):
        assert np.allclose(x.emit.sum(0), 1) and (x.emit[[2, 3]] == 0).all() and (x.emit[[0, 1, 4, 5]] > 0).all()


# --- tokens


@pytest.fixture(scope="module")
def sp():
    return bpe.processor(bpe.model_path())


def test_counts_equal_the_library(sp):
    assert bpe.splittable(bpe.model_path())
    for t in ODD + texts(150):
        assert sum(token_counts.piece_count(sp, p) for p in bpe.pretokens(t)) == len(sp.encode(t)), t[:40]


def test_encoding_without_dropout_is_the_librarys(sp):
    c = merge_dropout.Codec("piece_bpe_32k.model", 0.0, 0)
    for t in [x for x in ODD if "▁" not in x] + texts(100):
        assert c.encode(t).tolist() == sp.encode(t)


def test_dropout_varies_and_is_lossless():
    c = merge_dropout.Codec("piece_bpe_32k.model", 0.2, 5)
    some = ODD + texts(60)
    for t in some:
        for v in (0, 1):
            assert c.decode(c.encode(t, v).tolist()) == t
    a, b = ([c.encode(t, v).tolist() for t in some] for v in (0, 1))
    assert a != b and a == [merge_dropout.Codec("piece_bpe_32k.model", 0.2, 5).encode(t, 0).tolist() for t in some]


def test_scanned_and_linked_agendas_agree():
    for drop in (0.0, 0.3):
        c = merge_dropout.Codec("piece_bpe_32k.model", drop, 1)
        for w in ("▁thethethe" * 7, "abc" * 50, "あx" * 30, "▁" * 70):
            assert c.merge(w, 2) == c._long(w, 2)


def test_each_occurrence_draws_its_own_dropout():
    c = merge_dropout.Codec("piece_bpe_32k.model", 0.1, 11)
    pieces = bpe.pretokens("together " * 3000)
    keys = merge_dropout.spread(np.arange(len(pieces), dtype=np.uint64))
    ids, counts = c.walk(pieces, keys)
    got = [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [c.merge(p, int(k)) for p, k in zip(pieces, keys, strict=True)]
    assert len(set(got)) > 8  # four at most, before
    # A word of one merge stays unsplit at about a tenth of its places in any text.
    one = next(p for p in c.number if len(p) == 2 and p[0] == "▁" and p[1].isalpha())
    ids = [c.encode((one[1] + " ") * 4000, k).tolist() for k in (1, 2)]
    for x in ids:
        assert 0.07 < sum(i != c.number[one] for i in x) / 2 / 4000 < 0.13
    assert ids[0] != ids[1]


def test_rows_merged_together_are_as_alone(monkeypatch):
    c = merge_dropout.Codec("piece_bpe_32k.model", 0.2, 5)
    some = ODD + texts(25)
    pieces = [p for t in some for p in bpe.pretokens(t)]
    keys = merge_dropout.spread(np.arange(len(pieces), dtype=np.uint64))
    ids, counts = c.walk(pieces, keys)
    assert ids.tobytes() == b"".join(c.merge(p, int(k)) for p, k in zip(pieces, keys, strict=True))
    want = [x.tolist() for x in c.encode_rows(some, list(range(len(some))))]
    monkeypatch.setattr(merge_dropout, "TOGETHER", 50)
    assert want == [x.tolist() for x in c.encode_rows(some, list(range(len(some))))]


def test_recent_cache_keeps_what_is_used():
    made = []
    r = bpe.Recent(lambda p: made.append(p) or len(p), 4)
    for _ in range(10):
        r["hot"]
        for i in range(3):
            r[f"c{len(made)}{i}"]
    assert made.count("hot") <= 2


# --- quality field


def test_marginals_by_all_paths():
    rng = np.random.default_rng(4)
    pair = rng.normal(size=(2, 2))
    us = [rng.normal(size=n) for n in (1, 3, 4)]
    got, pairs, logz = crf.marginals(pair, us)
    want_z, want_pairs = 0.0, np.zeros((2, 2))
    for u, p in zip(us, got, strict=True):
        w = {}
        for path in np.ndindex(*[2] * len(u)):
            w[path] = math.exp(sum((u[i] if k else -u[i]) / 2 for i, k in enumerate(path)) + sum(pair[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(w.values())
        want_z += math.log(z)
        for i in range(len(u)):
            assert math.isclose(p[i], sum(x for path, x in w.items() if path[i]) / z)
        for path, x in w.items():
            for a, b in zip(path, path[1:], strict=False):
                want_pairs[a, b] += x / z
    assert math.isclose(logz, want_z) and np.allclose(pairs, want_pairs)


def test_quality_on_held_out_labels():
    rows = labelled("quality")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    field = crf.fit([(t, y) for i, t, y in rows if not held(i)])
    test = [(t, y) for i, t, y in rows if held(i)]
    s = crf.scores(field, [t for t, _ in test])
    assert ((s >= crf.BAR) == np.array([y for _, y in test], bool)).mean() > 0.95
    assert crf.scores(crf.fit([]), ["", None]).shape == (2,)


# --- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 100, 1009, 5000])
def test_permutation(n):
    got = [sharding.permute(i, n, 20) for i in range(n)]
    assert sorted(got) == list(range(n))
    assert all(sharding.row_at(p, n, 20) == i for i, p in enumerate(got))
    assert n < 100 or got != [sharding.permute(i, n, 21) for i in range(n)]


# --- Jaccard


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_bands_cover_every_pair_of_sizes():
    bands = jaccard.bands(400)
    for a in range(4, 300):
        for b in range(a, a * 100 // 80 + 1):
            common = [x for x in bands if x.low <= a < x.high]
            assert len(common) == 1 and common[0].low <= b
            most = max(u - i for i in range(a + 1) for u in [a + b - i] if 100 * i >= 80 * u) if any(100 * i >= 80 * (a + b - i) for i in range(a + 1)) else 0
            assert most <= common[0].differ and common[0].slack >= 0


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(5)
    bands = jaccard.bands(800)
    for _ in range(400):
        n = int(rng.integers(4, 500))
        base = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        drop = int(rng.integers(0, n // 9 + 1))
        add = int(rng.integers(0, n // 9 + 1))
        other = np.concatenate([base[drop:], rng.integers(1, 1 << 63, add, dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            if a.tolist() == b.tolist() or len(a) < 4 or len(b) < 4:
                continue
            met = 0
            for (ka, fa), (kb, fb) in ((x, y) for x in jaccard.set_keys(a, bands) for y in jaccard.set_keys(b, bands)):
                same, i, j = np.intersect1d(ka, kb, return_indices=True)
                if len(same) and (fa[0] | fb[0]) & jaccard.OWN:
                    met += int((1 + ((fa[i] & jaccard.TWO) > 0)).sum())
                    assert met >= max(fa[0] & jaccard.NEED, fb[0] & jaccard.NEED)
            assert met


def test_hot_keys_of_a_task_leave_one_member():
    rng = np.random.default_rng(8)
    rows = np.zeros(3000, jaccard.KEY)
    rows["key"] = np.where(np.arange(3000) < 1000, 7, rng.integers(100, 3000, 3000))
    rows["low"], rows["flags"] = rng.permutation(3000), jaccard.OWN | 2
    left, blocks, pairs, shares = jaccard.presorted(rows, np.full(3000, 3, np.int32))
    hot = left[left["key"] == 7]
    assert len(hot) == 1 and hot["flags"][0] & jaccard.HOT and (blocks == 3).all()
    assert (shares["group"] == (3 << 32 | 7)).sum() == 1000 and len(pairs) >= 999
    # The block that gets the member charges the others that it meets there.
    other = np.zeros(2, jaccard.KEY)
    other["key"], other["low"], other["flags"] = 7, [5000, 5001], jaccard.OWN | 2
    met, more = jaccard.meet(np.concatenate([hot, other]), 3)
    assert len(met) == 2 and sorted(more["side"] >> np.uint64(1)) == [5000, 5001]


def test_word_hashes_tell_words_apart():
    ws = [f"w{i}".encode() for i in range(5000)] + [b"a" * k for k in range(1, 200)]
    assert len(set(jaccard.word_hashes(ws).tolist())) == len(ws)
    assert jaccard.word_hashes([b"x", b"longer"])[1] == jaccard.word_hashes([b"other", b"y", b"longer"])[2]


# --- Hamming


def test_search_by_brute_force():
    rng = np.random.default_rng(6)
    for bits, n in ((64, 500), (20, 300), (9, 200), (64, 3)):
        base = rng.integers(0, 2, (n, bits)).astype(np.uint8)
        base[n // 2 :] = base[0]  # a hot code
        near = base.copy()
        near[np.arange(n), rng.integers(0, bits, n)] ^= 1
        rows = np.concatenate([base, near])
        codes = [np.packbits(r).tobytes() for r in rows]
        ids = list(range(len(rows)))
        got = hamming.search_block(ids[:20], codes[:20], ids, codes, bits, 4, 10)
        for q in range(min(20, len(rows))):
            want = sorted((int((rows[q] != r).sum()), i) for i, r in enumerate(rows))[:10]
            assert [(d, i) for x, d, i in got if x == q] == want
