import random

import pytest

from placeforge.llm import tokens as K


@pytest.fixture(scope="module")
def count():
    return K.counter(K.load_ranks())


PARTS = ["the", " heon", " It's", " don't", "  ", "\n", "\n\n", "\t", " ", "12", " 345", "é", " ñandú", "!!", "...", "\x1c", "\xa0", "中文", "\U0001f600", "a" * 40, " x", "'s", "'"]


def random_text(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, n)))


def test_runs_add_up(count):
    rng = random.Random(1)
    for _ in range(300):
        text = random_text(rng, 120)
        leaves = K.runs(text, 12)
        assert "".join(leaves) == text
        assert sum(map(count, leaves)) == count(text)


def test_edits_against_a_fresh_count(count):
    rng = random.Random(2)
    for _ in range(150):
        text = random_text(rng, 200)
        tree = K.SegmentTree.of(text, count, 16)
        for _ in range(12):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 10, 80]))
            new = random_text(rng, rng.choice([0, 1, 3, 60]))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text
            assert tree.total == count(text), (text, a, b, new)
            assert sum(tree.tokens[tree.size :]) == tree.total and tree.chars[1] == len(text)


def test_an_edit_touches_its_surroundings_only(count):
    tree = K.SegmentTree.of("some words in a row " * 20_000, count)
    assert tree.edit(200_000, 200_010, "others") < 4 * K.LEAF_CHARS


def test_operator_rows(spark, count):
    rows = [(1, "Write to a.b@c.org or +49 123 4567890."), (2, None), (3, ""), (1, "Write to a.b@c.org or +49 123 4567890."), (None, "see https://x.org/a"), (4, "word " * 50_000 + "a@b.cd")]
    docs = spark.createDataFrame([(*r, 5, "e") for r in rows], "doc_id long, text string, n_tokens int, edits string")
    trees = K.build_trees(docs)
    for r in trees.collect():
        assert r.n_tokens == count(r.text or "") == sum(r.leaf_tokens)
    got = K.recount(trees).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == count(r.text or "") == sum(r.leaf_tokens)
        assert (r.text is None) == (r.doc_id == 2)
    texts = {r.doc_id: r.text for r in got}
    assert texts[1] == "Write to <email> or <number>." and texts[None] == "see <url>" and texts[4].endswith("word <email>")
    own = trees.selectExpr("*", "array(named_struct('start', 0, 'end', 0, 'text', 'New ')) AS mine")
    for r in K.recount(own, "mine").collect():
        assert r.text.startswith("New ") and r.n_tokens == count(r.text) and r.n_edits == 1
    assert K.recount(K.build_trees(docs.limit(0))).count() == 0
