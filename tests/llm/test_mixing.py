import math
import random

import numpy as np
import pytest

from placeforge.llm import mixing as M

WORDS = {"a": ["red", "blue", "the"], "b": ["eins", "zwei", "the"], "c": ["uno", "dos", "tres"]}


def text(rng, *domains):
    return " ".join(rng.choice(WORDS[rng.choice(domains)]) for _ in range(rng.randint(5, 40)))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    labelled = [(text(rng, d), d) for d in "aaabbc" for _ in range(20)] + [(None, "a"), ("red", None), ("", "b")]
    docs = [(i, text(rng, *rng.choice(["a", "a", "a", "b", "c", "ab", "bc"]))) for i in range(300)]
    docs += [(900, None), (901, ""), (5, docs[5][1]), (None, "uno dos")]
    return (
        spark.createDataFrame([(*d, "x", 0.5) for d in docs], "doc_id long, text string, domain string, rate double"),
        spark.createDataFrame([(*x, 1) for x in labelled], "text string, domain string, rate int"), docs, labelled,
    )


def test_posteriors_against_plain_bayes(data):
    docs, labelled, rows, given = data
    model = M.fit_classifier(labelled)
    known = [(set((t or "").lower().split()), d) for t, d in given if d]
    n = {d: sum(x == d for _, x in known) for d in "abc"}
    vocabulary = {w for ws, _ in known for w in ws}
    assert set(model.words) == vocabulary
    share = {(w, d): (sum(w in ws and x == d for ws, x in known) + 0.5) / (n[d] + 1) for w in vocabulary for d in "abc"}
    members = {r.doc_id: r for r in M.with_membership(docs.select("doc_id", "text"), model).collect()}
    for i, t in rows:
        own = set((t or "").lower().split())
        logs = [math.log(n[d] / len(known)) + sum(math.log(share[w, d]) for w in vocabulary & own) for d in "abc"]
        p = np.exp(np.array(logs) - max(logs))
        assert members[i].posterior == pytest.approx((p / p.sum()).tolist(), abs=1e-9)
        assert members[i].n_tokens == len((t or "").split())


def test_expected_totals_meet_targets(data):
    docs, labelled, rows, _ = data
    targets = {"a": 0.2, "b": 0.3, "c": 0.5}
    got = M.mix(docs, labelled, targets).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    total = sum(r.n_tokens for r in got)
    for k, d in enumerate("abc"):
        assert sum(r.rate * r.n_tokens * r.posterior[k] for r in got) == pytest.approx(targets[d] * total, rel=1e-6)
        assert all(r.domain == d for r in got if r.posterior[k] > 0.5)


def test_extreme_targets_clip_rates(data):
    docs, labelled, _, _ = data
    got = M.mix(docs, labelled, {"c": 1.0}).collect()
    total = sum(r.n_tokens for r in got)
    sums = [sum(r.rate * r.n_tokens * r.posterior[k] for r in got) for k in range(3)]
    assert min(r.rate for r in got) == 0 and sums[2] == pytest.approx(total, rel=0.05) and sums[0] < 0.02 * total


def test_resampling_without_loss(data):
    docs, labelled, rows, _ = data
    got = M.resample(docs, labelled, keep_all=True).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows} and len(rows) <= len(got) <= 4 * len(rows)
    assert got and list(got[0].asDict()) == ["doc_id", "text", "domain", "rate"]
    assert all(r.rate == 0.5 and r.domain == "x" for r in got)


@pytest.mark.parametrize("targets", [{"a": 1, "b": 1, "c": 1}, {"a": 0.01, "b": 0.5, "c": 0.49}, {"a": 0.9, "b": 0.05, "c": 0.05}])
def test_resampling_meets_skewed_targets(spark, data, targets):
    _, labelled, _, _ = data
    rng = random.Random(3)
    rows = [(i, text(rng, rng.choice("aaab" if i % 3 else "c"))) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = {w: d for d, ws in WORDS.items() for w in ws if w != "the"}
    found, total = dict.fromkeys("abc", 0), sum(len(t.split()) for _, t in rows)
    for r in M.resample(docs, labelled, targets).collect():
        own = [words[w] for w in r.text.split() if w in words]
        if own:
            found[own[0]] += len(r.text.split())
    whole = sum(targets.values())
    assert sum(found.values()) == pytest.approx(total, rel=0.01)
    assert all(found[d] == pytest.approx(total * targets[d] / whole, abs=0.01 * total) for d in "abc")


def test_many_domains_share_the_rest(spark):
    labelled = spark.createDataFrame([(f"w{k} w{k} x", f"d{k:03}") for k in range(60) for _ in range(3)], "text string, domain string")
    model = M.fit_classifier(labelled)
    assert len(model.domains) == M.OWN_DOMAINS + 1 and M.REST in model.domains
    got = M.mix(labelled.selectExpr("1L AS doc_id", "text"), labelled).collect()
    assert len(got) == 180 and {r.domain for r in got} == set(model.domains)


def test_sample_of_one_repeated_text_is_bounded(spark):
    labelled = spark.range(5000).selectExpr("'one text' AS text", "'a' AS domain")
    assert M.fit_classifier(labelled, max_rows=100).domains == ["a"]
    from placeforge.llm.common import bounded_sample

    assert bounded_sample(labelled, 100, "text", "domain").count() <= 100


def test_nothing_labelled_and_empty(data):
    docs, labelled, rows, _ = data
    got = M.mix(docs, labelled.limit(0)).collect()
    assert len(got) == len(rows) and all(r.rate == 1 and r.domain == "unknown" for r in got)
    assert M.mix(docs.limit(0), labelled).count() == 0
