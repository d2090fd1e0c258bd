import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from placeforge.llm import lm


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = {"x": ["th", "er", "on", "an", "re", "he"], "y": ["ci", "ón", "que", "la", "os", "ña"]}
    out = []
    for i in range(n):
        lang = rng.choice("xxy")
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 120))]
        out.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words), lang))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(400, 1) + [(401, None, None), (402, "", "z"), (5, "the same id Again", "x"), (None, "no id\x1cword", "x"), (403, "a" * 5000 + " b", "y"), (404, "b\0b é\x85é", "y")]
    docs = spark.createDataFrame([(*r, True, 3) for r in rows], "doc_id long, text string, lang string, held_out boolean, score int")
    return rows, {(r.doc_id, r.n_tokens): r for r in lm.score(docs, chunk_words=300).collect()}, docs


def test_counts_and_base_score(scored):
    rows, got, _ = scored
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter()
    for i, text, _ in rows:
        if not held(i):
            c.update([*plain_words(text), None])
    n, v = sum(c.values()), len(c)
    for i, text, _ in rows:
        tokens = [*plain_words(text), None]
        r = got[i, len(tokens)]
        assert (r.held_out, r.train_tokens) == (held(i), n)
        assert r.n_known == sum(c[t] > 0 for t in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + 1 * (v + 1))) for t in tokens), rel=1e-12)
        assert math.isfinite(r.score) and r.score < 0 < r.bits_per_byte
    assert len(got) == len(rows)


def test_model_is_better_than_base_on_held_out_text(scored):
    rows, got, _ = scored
    held = [r for r in got.values() if r.held_out and r.doc_id != 403]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_decisions_are_a_distribution():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 3))) for _ in range(200)})
    table, mixer = np.zeros((lm.SLOTS, 2)), lm.Mixer(lm.POSITIONS * 8, lm.LEVELS, lm.ORDERS)
    block = lm.Block(words, np.ones(len(words)))
    lm.count_block(block, table)
    lm.learn_block(block, table, mixer)
    odds, known = np.log((table[:, 1] + lm.PRIOR) / (table[:, 0] + lm.PRIOR)), np.minimum(table.sum(axis=1), 100).astype(np.int8)
    # codes of distinct words exclude each other, so their chances cannot exceed 1
    every = sorted({bytes(x) for n in (1, 2) for x in itertools.product([b for b in range(256) if b not in b" \n\t\r\x0b\x0c"], repeat=n)} | set(words) | {lm.END})
    chance = 10 ** lm.score_block(lm.Block(every), odds, known, mixer, np.zeros(len(every), int))
    assert 0.3 < chance.sum() < 1
    strange = [w.translate(bytes.maketrans(b"abc", b"xyz")) for w in words]
    score = lambda ws: lm.score_block(lm.Block(sorted(ws)), odds, known, mixer, np.zeros(len(ws), int)).mean()
    assert score(words) > score(strange) + 1


def test_sharing_prefixes_changes_nothing():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"ab\0z") for _ in range(rng.randint(1, 9))) for _ in range(300)} | {b"q" * 39, b"q" * 40, b"q" * 41, b"ab" * 90, lm.END})
    table, mixer = np.zeros((lm.SLOTS, 2)), lm.Mixer(lm.POSITIONS * 8, lm.LEVELS, lm.ORDERS)
    counts = np.array([rng.randint(1, 5) for _ in words], float)
    lm.count_block(lm.Block(words, counts), table)
    one = np.zeros((lm.SLOTS, 2))
    for w, c in zip(words, counts, strict=True):
        lm.count_block(lm.Block([w], np.array([c])), one)
    assert np.array_equal(table, one)
    odds, known = np.log((table[:, 1] + 1) / (table[:, 0] + 1)), np.minimum(table.sum(axis=1), 100).astype(np.int8)
    together = lm.score_block(lm.Block(words), odds, known, mixer, np.zeros(len(words), int))
    apart = [lm.score_block(lm.Block([w]), odds, known, mixer, np.zeros(1, int))[0] for w in words]
    assert together == pytest.approx(apart, rel=1e-9)


def test_chunks_change_nothing(scored, spark):
    rows, got, docs = scored
    again = lm.score(docs).collect()
    for r in again:
        assert (r.n_known, r.held_out) == (got[r.doc_id, r.n_tokens].n_known, got[r.doc_id, r.n_tokens].held_out)
        assert r.base_score == pytest.approx(got[r.doc_id, r.n_tokens].base_score, rel=1e-12)
        assert r.score == pytest.approx(got[r.doc_id, r.n_tokens].score, rel=1e-5)


def test_no_training_documents_and_empty(spark):
    ids = [i for i in range(100) if lm.held_out(i)][:2]
    docs = spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string")
    for r in lm.score(docs).collect():
        assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0
        assert r.score == pytest.approx(-(3 + 8 * 10) * math.log10(2), rel=1e-5)  # three symbols, two words with their spaces
    assert lm.score(docs.limit(0)).count() == 0


def model(seed, docs=60):
    """Symbols, states and a mixer learned from random documents, and the documents."""
    rng = random.Random(seed)
    own = [(b"w%d" % k, 400 - 9 * k) for k in range(40)] + [(lm.END, docs)]
    symbols = lm.Symbols(own, {b"ab": (30, 5), b"c ": (10, 1)}, (7, 3))
    texts = [np.array([rng.choice([rng.randrange(symbols.size), rng.randrange(8)]) for _ in range(rng.randint(1, 80))]) for _ in range(docs)]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
    tokens, bits = np.concatenate(texts), 14
    flags = lm.copy_flags(tokens, starts)
    stream = lm.Stream(tokens, flags, starts, symbols, bits)
    tables = np.zeros((lm.CONTEXTS, 1 << bits, 2), np.uint32)
    lm.count_stream(stream, tables)
    states, mixer = [lm.pack_states(t) for t in tables], lm.Mixer(lm.GATES, lm.STREAM_LEVELS, lm.CONTEXTS + 1)
    lm.learn_stream(stream, states, mixer)
    return symbols, states, mixer, bits, texts, flags, starts, stream


def test_copy_flags_against_a_plain_walk():
    rng = random.Random(4)
    for _ in range(40):
        texts = [[rng.randrange(rng.choice([2, 5, 40])) for _ in range(rng.randint(1, 60))] for _ in range(rng.randint(1, 5))]
        want = []
        for t in texts:
            one, two, run = {}, {}, 0
            for k, x in enumerate(t):
                guess = None
                by_two = k > 1 and (t[k - 2], t[k - 1]) in two
                if by_two:
                    guess = two[t[k - 2], t[k - 1]]
                elif k and t[k - 1] in one:
                    guess = one[t[k - 1]]
                right = guess == x
                want.append((guess is not None) * lm.PREDICTED + right * lm.RIGHT + by_two * lm.BY_TWO + min(run, 7) * lm.RUN)
                run = run + 1 if right else 0
                if k:
                    one[t[k - 1]] = x
                if k > 1:
                    two[t[k - 2], t[k - 1]] = x
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
        assert lm.copy_flags(np.concatenate(texts), starts).tolist() == want


def test_scores_against_a_plain_walk():
    """Token by token and bit by bit, with whole numbers of Python for the hashes."""
    symbols, states, mixer, bits, texts, flags, starts, stream = model(5)
    full, (phi, mix, node_) = (1 << 64) - 1, map(int, (lm._PHI, lm._MIX, lm._NODE))
    costs = [mixer.costs(g) for g in range(lm.GATES)]
    fold = lambda c: (c & full) ^ ((c & full) >> 32)
    for own in (False, True):
        got, want = lm.score_stream(stream, states, mixer, costs, own), []
        for text, start in zip(texts, starts.tolist(), strict=True):
            text = text.tolist()
            for k, x in enumerate(text):
                a, b = (text[k - 1] if k else symbols.size), (text[k - 2] if k > 1 else symbols.size)
                often = [y for y in text[:k] if y < lm.FREQUENT][::-1] + [symbols.size] * 2
                ctx = [fold((a + 1) * phi), fold((((a + 1) * mix) & full) ^ (((b + 2) * phi) & full)), fold((((often[0] + 3) * node_) & full) ^ (((often[1] + 4) * mix) & full))]
                flag = int(flags[start + k])
                steps = []
                if flag & lm.PREDICTED:
                    steps.append((0, [ctx[0], ctx[2], 0], ((flag & ~lm.RIGHT) * node_) & full, int(flag & lm.RIGHT > 0), 0.0))
                if not flag & lm.RIGHT:
                    steps += [(1 + min(d, lm.GATES - 2), ctx, int(symbols.name[d, x]), int(symbols.bit[d, x]), float(symbols.odds[d, x])) for d in range(int(symbols.length[x]))]
                total = 0.0
                for gate, contexts, name, bit, odds in steps:
                    pairs = []
                    for c, state in zip(contexts, states, strict=True):
                        held = int(state[(((c ^ name) * phi) & full) >> (64 - bits)])
                        n = [(v if v < 32 else 32 * 2 ** ((v - 32) / 4)) for v in (held & 63, held >> 6)]
                        n[bit] = max(n[bit] - own, 0)
                        pairs.append(n)
                    level = (sum(pairs[1]) > 0.5) + (sum(pairs[1]) > 3.5) + 3 * (sum(pairs[2]) > 0.5)
                    inputs = [odds, *(math.log((n[1] + lm.PRIOR) / (n[0] + lm.PRIOR)) for n in pairs), 1.0]
                    z = min(12.0, max(-12.0, float(np.dot(mixer.weights[gate, level], inputs))))
                    p = float(mixer.refined(gate, np.array([level]), np.array([z]))[0])
                    total += math.log10(p if bit else 1 - p)
                want.append(total)
        assert got == pytest.approx(want, abs=0.03) and got.sum() == pytest.approx(sum(want), rel=2e-3)


def test_symbols_are_a_distribution():
    symbols, states, mixer, bits, *_ = model(6)
    costs = [mixer.costs(g) for g in range(lm.GATES)]
    chance = 0.0
    for s in range(symbols.size):
        stream = lm.Stream(np.array([3, s]), np.zeros(2, np.uint8), np.array([0]), symbols, bits)
        chance += 10 ** lm.score_stream(stream, states, mixer, costs, False)[1]
    assert chance == pytest.approx(1.0, abs=1e-4)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(f"id-{k}", "some text again some text") for k in range(30)], "doc_id string, text string")
    got = lm.score(docs).collect()
    assert {r.doc_id for r in got} == {f"id-{k}" for k in range(30)} and all(r.held_out == lm.held_out(r.doc_id) for r in got)


def test_mixer_learns_from_every_document(spark, monkeypatch):
    """1.3 million tokens, by one shard and by four: all decisions are counted, and the scores are near."""
    symbols, _, _, bits, *_ = model(7)
    rng = np.random.default_rng(8)
    rows, decisions = [], 0
    for k in range(52):
        tokens = np.minimum(rng.geometric(0.08, 25_000), symbols.size) - 1
        flags = lm.copy_flags(tokens, np.zeros(1, int))
        rows.append((k, tokens.astype(np.uint16).tobytes(), flags.tobytes()))
        decisions += int(symbols.length[tokens[(flags & lm.RIGHT) == 0]].sum() + ((flags & lm.PREDICTED) > 0).sum())
    known = spark.createDataFrame(rows, "doc_id long, syms binary, flags binary").repartition(4)
    states = lm._count_contexts(known, symbols, bits, 52 * 25_000)
    stream = next(lm._streams([rows[0][1]], [rows[0][2]], symbols, bits))[0]
    score = lambda m: lm.score_stream(stream, states, m, [m.costs(g) for g in range(lm.GATES)], True).sum()
    found = []
    for least in (10**9, 325_000):
        monkeypatch.setattr(lm, "SHARD_TOKENS", least, raising=False)
        mixer = lm._learn_mixer(known, spark.sparkContext.broadcast((symbols, states)), bits, 52 * 25_000)
        assert mixer.seen.sum() == decisions
        found.append(score(mixer))
    assert found[1] == pytest.approx(found[0], rel=0.02) and found[0] > score(lm.Mixer(lm.GATES, lm.STREAM_LEVELS, lm.CONTEXTS + 1))


def test_spelling_learns_from_every_word(spark):
    words = sorted({b"%x" % (k * 2654435761 % 2**32) for k in range(130_000)})
    held = spark.createDataFrame([(lm._join(words[k::2]), np.ones(len(words[k::2]), np.int64).tobytes()) for k in (0, 1)], "words binary, totals binary")
    _, mixer = lm._learn_spelling(held, lm.Symbols([], {}, (1, 1)), len(words))
    # what comes last in a word is no shared prefix: each word has its own decisions at its end
    assert mixer.seen[(lm.POSITIONS - 1) * 8].sum() > len(words) * 1.5


def numbered(texts, at_once):
    """Words of the texts by numbers, read so many texts at a time."""
    found, some = None, []
    for a in range(0, len(texts), at_once):
        some.append(lm._encoded(texts.slice(a, at_once))[0])
    found, nums = lm._one_dictionary(found, some)
    return found, np.concatenate(nums)


def test_words_are_numbered_as_by_a_plain_walk():
    rng = random.Random(9)
    texts = [None, "", " ", " a ", "a\x1cb \x1d c\x85d\u2003e", "\t\n\x0b\x0c\rX", "A\0B \u00c9\u00e9 \u212a"]
    texts += ["".join(chr(rng.choice([*range(300), 0x2028, 0x3000, 0x1F600])) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for kind in (pa.string(), pa.large_string()):
        held = pa.array(texts, kind).slice(1)
        words, lengths, sizes = lm._encoded(held)
        want = [[w.encode() for w in plain_words(t)] for t in texts[1:]]
        assert lengths.tolist() == [len(w) + 1 for w in want]
        assert sizes.tolist() == [sum(map(len, w)) + len(w) + 1 for w in want]
        for at_once in (7, 1000):
            found, nums = numbered(held, at_once)
            held_words = found.cast(pa.large_binary()).to_pylist()
            assert len(set(held_words)) == len(held_words)
            assert [held_words[k] for k in nums] == [w for x in want for w in x]
        # a dictionary that goes on keeps its numbers
        more, again = lm._one_dictionary(found, [words, lm._encoded(pa.array(["one more", None], kind))[0]])
        assert more[: len(found)] == found and [more[int(k)].as_py() for k in again[1]] == ["one", "more"]
        assert np.array_equal(again[0], nums)


def test_numbering_costs_less_than_a_walk_over_the_words():
    """CPU seconds of 1.2 million words of 150,000; a dictionary that is asked word by word is what it cost before."""
    rng = np.random.default_rng(10)
    texts = pa.array([" ".join(f"w{k * 2654435761 % 2**32:x}" for k in rng.integers(0, 150_000, 1000).tolist()) for _ in range(1200)])

    def walk():
        numbers = lm._Numbers()
        return [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for w in (t.as_py().encode().lower().split() for t in texts)]

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    plain, now = (min(seconds(f) for _ in range(3)) for f in (walk, lambda: numbered(texts, 400)))
    assert now < 0.8 * plain


def test_learning_by_level_against_one_level_at_a_time():
    rng = np.random.default_rng(11)
    mixer, plain = lm.Mixer(2, 6, 4), lm.Mixer(2, 6, 4)
    for n in (1, 50, 3000, 3000, 20_000):
        level, now = np.minimum(rng.geometric(0.5, n) - 1, 5), rng.integers(0, 2, n)
        odds = [(rng.normal(0, 1, n) + now).astype(np.float32) for _ in range(4)]
        mixer.learn(1, level, odds, now)
        for v in set(level.tolist()):
            x = np.stack([*(o[level == v] for o in odds), np.ones((level == v).sum())]).astype(np.float64)
            y, w, held = now[level == v], plain.weights[1, v], plain.curves[1, v]
            p = 1 / (1 + np.exp(-np.clip(w @ x, -12, 12)))
            held += (x * np.maximum(p * (1 - p), 1e-4)) @ x.T
            w += np.clip(np.linalg.solve(held, x @ (y - p)), -0.5, 0.5)
            plain.seen[1, v, 0] += len(y)
            plain.ones[1, v, 0] += y.sum()
    assert mixer.weights == pytest.approx(plain.weights, abs=1e-4) and mixer.curves == pytest.approx(plain.curves, rel=1e-3, abs=0.05)
    assert np.array_equal(mixer.seen.sum(axis=2), plain.seen.sum(axis=2)) and np.array_equal(mixer.ones.sum(axis=2), plain.ones.sum(axis=2))
