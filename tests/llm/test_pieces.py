import random
from array import array

import pytest
import sentencepiece

from placeforge.llm import pieces as P


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL_PATH)


@pytest.fixture(scope="module")
def lexicon():
    return P.Lexicon.load()


def texts(n, seed):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "the", "and", "ß", "ü", "é", "ñ", "ción", "中", "文", "\U0001f600", "́", "A", "B", "THE", "!!", "%%%", "0", "42", "_", "-", ".", ",", "\n", "\t", " ", "  ", "    ", "\x00", "​", "Ⅷ", "aaaa", "zz"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_are_the_librarys(model, lexicon):
    given = [*texts(3000, 1), "", " ", "   x", "a" * 300, " " * 77 + "b", "ab" * 5000, "▁a"]
    ids, ends = P._Encoder(lexicon).encode(given)
    for x, a, b in zip(given, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == model.encode(x), repr(x)


def test_decoding_is_the_librarys(model, lexicon):
    for x in texts(500, 2):
        ids = model.encode(x)
        assert lexicon.decode(ids) == model.decode(ids) == x


def test_unigram_against_all_paths():
    pieces = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "▁ab", "ca"] + [f"<0x{b:02X}>" for b in range(256)]
    scores = [0, -2, -2.5, -3, -3.1, -3.2, -5.5, -1, -2.7, -4.4, -4.1] + [0] * 256
    lexicon = P.Lexicon(pieces, scores, list(range(1, 11)), list(range(11, 267)), "unigram")

    def best(word):
        if not word:
            return 0.0
        return max((scores[k] + best(word[len(p):]) for p, k in lexicon.ids.items() if word.startswith(p)), default=-1e9)

    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    for w, packed in lexicon.encode_words(words).items():
        ids = array("i", packed)
        assert "".join(pieces[i] for i in ids) == w
        assert sum(scores[i] for i in ids) == pytest.approx(best(w))


def test_operator_rows(spark, model):
    rows = [(1, "The heon is. é\U0001f600"), (2, None), (3, ""), (1, "The heon is. é\U0001f600"), (None, "x"), (4, "mark ▁ inside"), (5, "word " * 40_000)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, ids int")
    got = P.encode(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        assert r.ids == (None if text is None else model.encode(text))
        assert r.n_pieces == (None if text is None else len(r.ids))
        assert r.round_trip == (r.doc_id != 4)
    back = {r.doc_id: r.text for r in P.decode(P.encode(docs)).collect()}
    assert back[2] is None and back[3] == "" and back[1] == rows[0][1] and back[5] == rows[6][1]
    assert P.encode(docs.limit(0)).count() == 0
