"""The pipeline against plain versions of its stages, on a small fixture."""

import random

import pytest
import sentencepiece

import corpus_pipeline as C
from placeforge.llm import pieces, quality, secrets
from tests.llm.test_quality import corpus
from tests.llm.test_nearcopies import plain_set, similar


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(5)
    docs, labels = corpus(500, 7)
    rows = [list(d) for d in docs]
    for k in range(60):  # exact and near copies of good documents
        source = rows[rng.randrange(400)]
        words = source[1].split(" ")
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append([1000 + k, " ".join(words), source[2], source[3], source[4]])
    rows += [[2000, f"token={'9f8A7b6C5d4E3f2G' * 2} " + rows[0][1], "en", "src1", 9], [2001, None, None, None, None], [2002, "", "en", "s", 0], [None, rows[1][1], "en", "s", 1], [0, *rows[0][1:]]]
    folder = str(tmp_path_factory.mktemp("world"))
    spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, good string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_have_effect_and_keep_the_columns(spark, world):
    docs = spark.read.parquet(f"{world}/documents.parquet")
    before = docs.select(*C.COLUMNS).collect()
    scores = {(r.doc_id, r.text): r.good for r in quality.judge(docs, spark.read.parquet(f"{world}/labels.parquet"), keep=["doc_id", "text"]).collect()}
    kept = C.good_quality(spark, docs, world)
    assert kept.columns == C.COLUMNS
    rows = kept.collect()
    assert sorted(map(str, rows)) == sorted(str(r) for r in before if scores[r.doc_id, r.text])
    assert 0 < len(rows) < len(before)

    one = C.one_of_near_copies(spark, kept, world)
    assert one.columns == C.COLUMNS
    own = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, key=str)
    sets = [plain_set((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for _, t in own]
    root = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if similar(sets[i], sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    want = {r: min(i for (i, _), q in zip(own, root, strict=True) if q == r) for r in set(root)}
    left = one.collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted(want.values())
    assert sum(r.doc_id is None for r in left) == sum(r.doc_id is None for r in rows)

    clean = C.without_secrets(spark, one, world)
    assert clean.columns == C.COLUMNS
    after = {r.doc_id: r for r in clean.collect()}
    for r in left:
        assert after[r.doc_id].text == secrets.redact(r.text, secrets.scan(r.text))
        assert not secrets.base_spans(after[r.doc_id].text or "")

    mixed = C.mixed_to_targets(spark, clean, world)
    assert mixed.columns == C.COLUMNS and {r.doc_id for r in mixed.collect()} == set(after)


def test_run_gives_the_librarys_ids(spark, world):
    got = C.run(spark, world)
    assert got.columns == ["doc_id", "ids", "n_pieces", "round_trip"]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rows = got.collect()
    assert len(rows) > 100
    for r in rows[:50]:
        if r.ids:
            assert model.encode(model.decode(r.ids)) == r.ids and r.round_trip
    assert not any("9f8A7b6C5d4E3f2G" in model.decode(r.ids) for r in rows if r.ids)


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert C.run(spark, folder).count() == 0


def test_guard_of_the_entry_module():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and len({n.split("_")[0] for n in names if n.startswith("op")}) == 10
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "pieces"]
