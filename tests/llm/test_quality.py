import random

import numpy as np
import pytest

from placeforge.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        text = [rng.choice(words) for _ in range(rng.randint(30, 150))]
        if kind == "junk":
            text = [w.upper() + "!!" for w in text]
        if kind == "toxic":
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["vile", "scum", "filth"])
        text = " ".join(text)
        docs.append((i, text, rng.choice(["en", "de", None]), f"src{i % 3}", len(text)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus(1500, 1)
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "long " * 60_000, "en", "s", 5), (None, "x y", "en", "s", 3), (0, *docs[0][1:])]
    frame = spark.createDataFrame([(*d, "clash", 0.1) for d in docs + odd], SCHEMA + ", good string, score double")
    known = [x for x in labels if x[0] % 3] + [(None, 1, 0), (77, None, None), (labels[1][0], *labels[1][1:])]
    return frame, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), docs, labels


def test_held_out_accuracy(frames):
    docs, labels, _, truth = frames
    got = Q.judge(docs, labels).collect()
    assert len(got) == 1505
    by = {r.doc_id: r for r in got}
    held = [(i, q == 1 and t == 0) for i, q, t in truth if i % 3 == 0]
    assert sum(by[i].good == g for i, g in held) >= 0.97 * len(held)
    assert sum(by[i].good for i, g in held if g) >= 0.99 * sum(g for _, g in held)
    twice = [r for r in got if r.doc_id == 0]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert all(0 <= r.score <= 1 for r in got)


def views_of(docs):
    words = [Q.words_of(d[1]) for d in docs]
    return Q.Views([Q.content(w).astype(np.int64) for w in words], np.array([Q.shape(d[1] or "", w) for d, w in zip(docs, words, strict=True)]), np.stack([Q.metadata(*d[2:]) for d in docs]).astype(float))


def local_pick(pool):
    """One round's choice over all of a pool in memory."""

    def pick(model, share, taken):
        names = np.array([k for k in range(len(pool.words)) if k not in taken])
        a, b = model.calibrated(pool.rows(names))
        best = sorted({int(k) for x in (a, b) for k in np.flatnonzero(Q.surest(x, share) >= 0)})
        return names[best].tolist(), pool.rows(names[best]), Q.surest(a[best], share), Q.surest(b[best], share)

    return pick


def sided(n, seed):
    """Documents whose source says much about their quality, and words that say it as well."""
    rng = random.Random(seed)
    docs, y = [], []
    for i in range(n):
        good = rng.random() < 0.5
        own = rng.randrange(150)
        text = [f"{'g' if good else 'b'}{(own + k) % 150}" if rng.random() < 0.25 else f"w{rng.randrange(300)}" for k in range(40)]
        source = f"src{rng.randrange(4) + (0 if good == (rng.random() < 0.95) else 4)}"
        docs.append((i, " ".join(text), "en", source, len(" ".join(text))))
        y.append(float(good))
    return docs, np.array(y)


def test_the_exchange_gains():
    gains = []
    for seed in range(3):
        docs, y = sided(2600, seed)
        views = views_of(docs)
        few, pool, test = np.arange(200), np.arange(200, 1800), np.arange(1800, 2600)
        model = Q.co_train(views.rows(few), y[few], local_pick(views.rows(pool)))
        alone = Q.co_train(views.rows(few), y[few])
        accuracy = [((m.score(views.rows(test))[2] >= 0.5) == (y[test] > 0)).mean() for m in (model, alone)]
        gains.append(accuracy[0] - accuracy[1])
    assert np.mean(gains) >= 0.01 and min(gains) >= -0.02, gains


def test_metadata_does_not_read_the_text():
    assert (Q.metadata("en", "s", 5) == Q.metadata("en", "s", 5)).all() and (Q.metadata(None, "s", None) != Q.metadata("", "s", 0)).any()


def test_distributed_choice_is_the_local_one(spark):
    docs, y = sided(700, 9)
    views = views_of(docs)
    model = Q.co_train(views.rows(np.arange(100)), y[:100])
    views.shapes = views.shapes.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(*d, None) for d in docs[100:]], SCHEMA + ", good int").repartition(5)
    features = Q._features(rows)
    share = (15, 9)
    names, found, a, b = Q.pick_from(features)(model, share, set())
    pool = views.rows(np.arange(100, 700))
    places, want, x, z = local_pick(pool)(model, share, set())
    for mine, other in ((model.calibrated(found), model.calibrated(want)),):
        assert [np.sort(p[q >= 0]) == pytest.approx(np.sort(r[t >= 0])) for p, q, r, t in zip(mine, (a, b), other, (x, z), strict=True)] == [True, True]
    assert [(a == k).sum() for k in (0, 1)] == [(x == k).sum() for k in (0, 1)] and [(b == k).sum() for k in (0, 1)] == [(z == k).sum() for k in (0, 1)]
    again = Q.pick_from(features)(model, share, set(names))[0]
    assert not set(again) & set(names)


def test_the_pool_is_found_without_moving_texts(frames, spark, monkeypatch):
    """Labelled ids leave the pool by a join that sees no text, whatever Spark broadcasts."""
    docs, labels, _, _ = frames
    plans, write = [], Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    names = []
    pick_from = Q.pick_from

    def spy(features, *known):
        pick = pick_from(features, *known)

        def noted(*given):
            out = pick(*given)
            names.extend(out[0])
            return out

        return noted

    monkeypatch.setattr(Q, "pick_from", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        Q.fit(docs, labels.limit(300))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        assert not any("Exchange" in line and "SinglePartition" not in line for line in plan.splitlines()) or "text" not in plan
    assert names


def test_labelled_rows_of_one_id_are_bounded(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "concat('t ', id) AS text", "'en' AS lang", "'s' AS source", "3L AS n_chars")
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.fit(docs, labels, max_labelled=200).prior > 0.99


def test_without_labels_and_empty(frames, spark):
    docs, labels, _, _ = frames
    assert {r.score for r in Q.judge(docs, labels.limit(0)).collect()} == {0.5}
    only_good = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    assert all(r.good for r in Q.judge(docs, only_good).collect())
    assert Q.judge(docs.limit(0), labels).count() == 0
