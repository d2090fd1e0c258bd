"""Mixing sources to target weights by soft domain membership.

1. A naive Bayes classifier is fitted on a labelled table (text, domain): a
   bounded, hash-chosen sample (``MAX_LABELLED`` rows) gives a lexicon of the
   ``LEXICON`` words that tell the domains apart best.
2. Every document gets the domains' posteriors from the lexicon words that it
   holds (one without any has the domains' shares), and its token count.
3. Nonnegative document rates are fitted by projected-gradient least squares:
   the expected token totals of the domains, sums of rate * tokens * posterior,
   shall meet the targets.  A step follows the gradient in the metric of the
   domains' Gram matrix over the documents with a positive rate; a pass over
   the documents gives the gradient and that matrix (domains x domains).

DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeforge.llm.common import bounded_sample, materialise, unit_hash

MAX_LABELLED, LEXICON, MAX_STEPS = 4000, 192, 40
#: Domains that are fitted each; rarer ones are one domain together, named ``REST``.
OWN_DOMAINS, REST = 24, "other"
_SPACE = r"[\x20\x09-\x0D]+"


def pieces_column(text: Column | str) -> Column:
    """Lower-cased words of a text, with an empty piece where it begins or ends with white space."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE)


def count_column(pieces: str) -> Column:
    """How many of the pieces are words."""
    n = F.size(pieces)
    first, last = F.get(pieces, F.lit(0)) == "", F.get(pieces, n - 1) == ""
    return (n - first.cast("int") - ((n > 1) & last).cast("int")).cast("long")


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]  # log
    words: list[str] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)  # by word: what its presence adds for each domain

    def logs(self, words: Column) -> Column:
        """array<double>: log-likelihoods with priors, in the order of ``domains``."""
        start = F.array(*[F.lit(p) for p in self.prior])
        if not self.words:
            return start
        table = F.map_from_arrays(F.array(*map(F.lit, self.words)), F.array(*[F.array(*map(F.lit, w)) for w in self.weights]))
        held = F.array_intersect(F.array(*map(F.lit, self.words)), words)
        return F.aggregate(held, start, lambda a, w: F.zip_with(a, table[w], lambda x, y: x + y))


def fit_classifier(labelled: DataFrame, max_rows: int = MAX_LABELLED, lexicon: int = LEXICON) -> Classifier:
    """From rows (text, domain); those without a domain are left out, rows are chosen by their text's hash."""
    known = labelled.select("text", F.col("domain").cast("string").alias("domain")).where("domain IS NOT NULL")
    known = bounded_sample(known, max_rows, "text", "domain")
    known = materialise(known.select("domain", F.array_remove(F.array_distinct(pieces_column("text")), "").alias("words")), "mix-labelled")
    kept = known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(OWN_DOMAINS).collect()
    own = [r["domain"] for r in kept]
    known = known.withColumn("domain", F.when(F.col("domain").isin(own), F.col("domain")).otherwise(REST)) if own else known
    rows = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # one more at most
    domains = sorted(rows)
    if not domains:
        return Classifier(["unknown"], [0.0])
    n = sum(rows.values())
    by_word = known.select("domain", F.explode("words").alias("word")).groupBy("word").agg(
        *[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]
    )
    share = [(F.col(f"n{k}") + 0.5) / (rows[d] + 1.0) for k, d in enumerate(domains)]
    mean = sum((share[k] * rows[d] / n for k, d in enumerate(domains)), F.lit(0.0))
    # the information that a word's presence gives on the domain
    worth = sum((s * rows[d] / n * F.log(s / mean) + (1 - s) * rows[d] / n * F.log((1 - s) / (1 - mean)) for s, d in zip(share, domains, strict=True)), F.lit(0.0))
    best = by_word.select("word", *[s.alias(f"s{k}") for k, s in enumerate(share)], worth.alias("worth")).orderBy(F.desc("worth"), "word").limit(lexicon).collect()
    shares = [[r[f"s{k}"] for k in range(len(domains))] for r in best]
    return Classifier(domains, [math.log(rows[d] / n) for d in domains], [r["word"] for r in best], [[math.log(x) for x in s] for s in shares])


def with_membership(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Adds n_tokens and posterior.

    Step by step: what a step uses more than once is a column before it, so
    that no text is split and no lexicon looked up again.
    """
    return (
        docs.withColumn("_words", pieces_column(docs["text"]))
        .withColumns({"n_tokens": count_column("_words"), "_logs": classifier.logs(F.col("_words"))})
        .withColumn("_powers", F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs"))))
        .withColumn("posterior", F.transform("_powers", lambda x: x / F.aggregate("_powers", F.lit(0.0), lambda a, y: a + y)))
        .drop("_words", "_logs", "_powers")
    )


def tempered(totals: dict[str, float], power: float = 0.7) -> dict[str, float]:
    """Target weights between the domains' own shares (power 1) and equal ones (power 0)."""
    return {d: x**power if x > 0 else 0.0 for d, x in totals.items()}


def _rate(steps: list[list[float]]) -> Column:
    rate = F.lit(1.0)
    for step in steps:
        moved = sum((F.get("posterior", F.lit(k)) * F.lit(float(s)) for k, s in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - moved)
    return rate


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float] | None = None, total: float | None = None, tolerance: float = 1e-9) -> tuple[Column, dict]:
    """The rate as a column over ``posterior``, and a report (targets, expected, steps).

    targets: relative weights, by default ``tempered`` shares.  total: tokens to
    have in all, by default as many as there are.  The least squares need not
    reach targets of domains that no document belongs to.
    """
    d = len(domains)

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        mass = F.col("n_tokens") * F.col("rate")
        p = [F.get("posterior", F.lit(k)) for k in range(d)]
        active = F.when(F.col("rate") > 0, F.col("n_tokens").cast("double")).otherwise(0.0)
        cols = [F.sum(mass * p[k]).alias(f"e{k}") for k in range(d)]
        cols += [F.sum(active * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]
        r = members.withColumn("rate", _rate(steps)).agg(*cols).first()
        gram = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                gram[i, j] = gram[j, i] = r[f"m{i}_{j}"] or 0.0
        return np.array([r[f"e{k}"] or 0.0 for k in range(d)]), gram

    expected, gram = sums([])
    own = dict(zip(domains, expected.tolist(), strict=True))
    weights = targets or tempered(own)
    whole = sum(weights.get(x, 0.0) for x in domains)
    total = expected.sum() if total is None else total
    want = np.array([weights.get(x, 0.0) / whole * total if whole else 0.0 for x in domains])
    steps: list[list[float]] = []
    size, error = 1.0, expected - want
    while len(steps) < MAX_STEPS and size > 1e-6 and np.abs(error).sum() > tolerance * max(total, 1.0):
        # the gradient of half the squared error, in the metric of the Gram matrix
        move = np.linalg.lstsq(gram + 1e-12 * max(np.trace(gram), 1e-300) * np.eye(d), error, rcond=None)[0]
        tried = [*steps, (size * move).tolist()]
        there, gram_there = sums(tried)
        if np.abs(there - want).sum() < np.abs(error).sum() * (1 - 1e-6):
            steps, expected, gram, error = tried, there, gram_there, there - want
            size = min(1.0, 2 * size)
        else:
            size /= 4
    report = {"own": own, "targets": dict(zip(domains, want.tolist(), strict=True)), "expected": dict(zip(domains, expected.tolist(), strict=True)), "steps": steps}
    return _rate(steps), report


def corner_rates(report: dict, d: int) -> list[float]:
    """Rates of documents wholly in one domain; all others' lie between, while none is cut off at 0."""
    out = [1.0] * d
    for step in report["steps"]:
        out = [max(0.0, r - s) for r, s in zip(out, step, strict=True)]
    return out


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain, posterior, rate for each row of ``docs`` (doc_id, text).

    domain is the likeliest (ties: the first by name), posterior follows the
    domains' names in order.  Null and empty texts have no tokens and the
    posterior of a text without lexicon words.  Repeated rows each give a row;
    without labelled rows there is one domain, ``unknown``, and every rate is 1;
    other columns are ignored.
    """
    classifier = fit_classifier(labelled)
    members = materialise(with_membership(docs.select("doc_id", "text"), classifier).drop("text"), "mix-members")
    rate, _ = fit_rates(members, classifier.domains, targets)
    names = F.array(*map(F.lit, classifier.domains))
    domain = F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    return members.select("doc_id", "n_tokens", domain.alias("domain"), "posterior", rate.alias("rate"))


def labelled_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """text, domain (the language) of documents labelled as good, of at most ``max_rows`` ids."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = bounded_sample(good, max_rows, "doc_id")
    return docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", F.col("lang").alias("domain"))


def gentle(totals: dict[str, float], most: float = 2.0) -> dict[str, float]:
    """Target weights that bring the domains nearer to each other, none by more than ``most`` times beside the largest."""
    held = [x for x in totals.values() if x > 0]
    apart = max(held) / min(held) if held else 1.0
    power = max(0.0, 1.0 - math.log(most) / math.log(apart)) if apart > 1 else 0.0
    return tempered(totals, power)


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, keep_all: bool = False, most: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: the whole part, and once more with the chance of the rest.

    Expected token totals meet the targets (``fit_rates``; by default
    ``tempered`` shares of as many tokens as there are), so rows with a rate
    below 1 may go.  With ``keep_all`` no row goes: the default targets are
    ``gentle`` ones, and the total is as much larger as makes the least rate 1;
    a row comes 2 * ``most`` times at most.  Chances are hashes of doc_id and
    text, so equal rows fare alike.  Null and empty texts have no tokens and the
    rate of the domains' shares; an empty table gives no rows; other columns
    stay.
    """
    classifier = fit_classifier(labelled)
    # memberships are computed once, beside the rows, and read back
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"], docs["text"])
    held = materialise(with_membership(rows, classifier).select("row", "n_tokens", "posterior"), "mix-members")
    if keep_all and targets is None:
        own = held.agg(*[F.sum(F.col("n_tokens") * F.get("posterior", F.lit(k))).alias(f"e{k}") for k in range(len(classifier.domains))]).first()
        targets = gentle({x: own[f"e{k}"] or 0.0 for k, x in enumerate(classifier.domains)}, most)
    rate, report = fit_rates(held, classifier.domains, targets, total)
    if keep_all:
        corners = corner_rates(report, len(classifier.domains))
        least = max(min(corners), max(corners) / (2 * most))
        rate = F.least(F.greatest(F.lit(1.0), rate / F.lit(least if least > 0 else 1.0)), F.lit(2.0 * most))
    rated = held.select("row", rate.alias("rate"))
    copies = F.floor("rate") + (unit_hash("row.doc_id", "row.text") < F.col("rate") - F.floor("rate")).cast("long")
    each = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))
    return rated.select("row", F.explode(each)).select("row.*")
