"""Quality classifier by co-training on two views of a document.

The content view sees which words a text has (hashed, presence only) and the
text's shape: shares of upper-case letters, digits and signs, lines, repeats,
links.  The metadata view sees only what the record says: language, source, both
together, and the length.  Both start from labelled documents.  In each round
each view labels the unlabelled documents of the whole corpus that it is surest
of, for the other view to learn from; documents on which the views' labels
conflict are left out; then both are fitted again.  Each view is calibrated on
labelled documents held back from training, and a logistic combination of the
calibrated log-odds scores all documents.  A round that does not make the combination
better on them is undone, and the exchange ends.

The labelled sample is bounded (``MAX_LABELLED`` rows, by hash).  The pool is
every unlabelled document: the features of all documents are written once, no
text is moved; in each round the log-odds of all are written, those beyond
``SURE`` lose the labelled ones by a join of ids, and the features of the surest
come to the driver (``CONFIDENT`` a view and round).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeforge.llm.common import bounded_sample, drop_table, materialise, words_of

MAX_LABELLED = 6000
WORD_BITS, ROUNDS, APART = 18, 2, 4.0
#: Pseudo-labels a view and round, and the calibrated log-odds that they need.
CONFIDENT, SURE = 400, 2.0
#: Values of a metadata column are hashed to so many indicators.
NAME_SLOTS = 64
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _SIGNS = b"0123456789", bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SHAPE = ("length", "words", "word_length", "upper", "digits", "signs", "wide", "lines", "line_length", "repeated_lines", "distinct_words", "bars", "bangs", "links", "runs")


def content(words: list[bytes]) -> np.ndarray:
    """Sorted distinct slots of the words, stripped of signs, and of the signs that words end in."""
    ends = {w[len(w.rstrip(_SIGNS)) :] for w in set(words)}
    slots = {zlib.crc32(w) for w in {w.strip(_SIGNS) for w in set(words)} | ends}
    found = np.fromiter(slots, np.int64, len(slots)) & ((1 << WORD_BITS) - 1)
    return np.unique(found).astype(np.int32)


def shape(text: str, words: list[bytes]) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n, m = max(1, len(raw)), max(1, len(words))
    without = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    lines = raw.split(b"\n")
    kept = [x for x in lines if x]
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / m, without(_UPPER), without(_DIGITS), without(_SIGNS),
        (len(raw) - len(text)) / n, math.log1p(len(lines)), math.log1p(len(raw) / len(lines)), 1 - len(set(kept)) / max(1, len(kept)),
        len(set(words)) / m, raw.count(b"|") / m, raw.count(b"!") / m, raw.count(b"://") / m, sum(w[-1:] * 2 == w[-2:] for w in words) / m,
    ]


#: Metadata: the length's logarithm, its steps, and three indicators by name.
_STEPS = (0, 50, 100, 200, 400, 800, 1600, 3200, 6400, 12_800, 25_600)
_META = 1 + len(_STEPS) + 3 * NAME_SLOTS


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What the record says of a document, without a look at its text; null is a value of its own."""
    out = np.zeros(_META, np.float32)
    out[0] = math.log1p(max(0, n_chars or 0))
    out[1 : 1 + len(_STEPS)] = [n_chars is not None and n_chars > x for x in _STEPS]
    names = [b"\0" if x is None else str(x).encode() for x in (lang, source)]
    for k, name in enumerate((*names, b"\1".join(names))):
        out[1 + len(_STEPS) + k * NAME_SLOTS + zlib.crc32(name) % NAME_SLOTS] = 1.0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights of a dense logistic regression; the last column is the constant, which is not held back."""
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (np.maximum(p * (1 - p), 1e-5) * weight)[:, None]).T @ x + np.diag(hold)
        w += np.clip(np.linalg.solve(h, x.T @ ((y - p) * weight) - hold * w), -5, 5)
    return w


@dataclass
class ContentView:
    """Logistic regression on word presence, each word scaled by its naive Bayes log-ratio.

    Only words whose presence differs between good and bad documents by
    ``APART`` standard deviations take part.
    """

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << WORD_BITS))
    constant: float = 0.0
    shape: MetadataView = field(default_factory=lambda: MetadataView())
    #: what the words' log-odds and the shape's count
    both: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))

    def _words(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows]) + self.constant

    def odds(self, rows: list[np.ndarray], shapes: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        parts = [np.clip(self._words(rows), -12, 12), np.clip(self.shape.odds(shapes), -12, 12), np.ones(len(rows))]
        return np.stack(parts, axis=1) @ self.both

    def fit(self, rows: list[np.ndarray], shapes: np.ndarray, y: np.ndarray) -> None:
        """Words and shape are weighed on rows that the words were not fitted on, then fitted on all."""
        part = np.arange(len(y)) % 3 == 2
        if len(set(y[part])) == 2 and len(set(y[~part])) == 2:
            self._fit([r for r, p in zip(rows, part, strict=True) if not p], shapes[~part], y[~part])
            held = [r for r, p in zip(rows, part, strict=True) if p]
            inputs = [np.clip(self._words(held), -12, 12), np.clip(self.shape.odds(shapes[part]), -12, 12), np.ones(len(held))]
            self.both = _newton(np.stack(inputs, axis=1), y[part], np.ones(len(held)), ridge=0.1)
        self._fit(rows, shapes, y)

    def _fit(self, rows: list[np.ndarray], shapes: np.ndarray, y: np.ndarray) -> None:
        self.shape.fit(shapes, y)
        self._fit_words(rows, y)

    def _fit_words(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 30) -> None:
        size = 1 << WORD_BITS
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        label = np.repeat(y, sizes)
        good, bad = y.sum(), (1 - y).sum()
        ratio = np.log((np.bincount(flat, label, size) + 0.5) / (good + 1)) - np.log((np.bincount(flat, 1 - label, size) + 0.5) / (bad + 1))
        df, rate = np.bincount(flat, minlength=size), bad / max(good + bad, 1)
        apart = (df - np.bincount(flat, label, size) - df * rate) / np.sqrt(np.maximum(df, 1) * max(rate * (1 - rate), 1e-9))
        ratio[np.abs(apart) < APART] = 0.0
        used = ratio[flat] != 0
        flat, owner = flat[used], owner[used]
        balance = np.where(y > 0.5, 0.5 / max(good, 1), 0.5 / max(bad, 1))
        # steps scaled by each word's own past gradients
        beta, b, past, past_b = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
        value = ratio[flat]
        for _ in range(epochs):
            z = np.bincount(owner, beta[flat] * value, len(rows)) + b
            error = (y - _sigmoid(z)) * balance
            g = np.bincount(flat, error[owner] * value, size) - 1e-5 * beta
            past += g * g
            past_b += error.sum() ** 2
            beta += 0.1 * g / np.sqrt(past)
            b += 0.1 * error.sum() / math.sqrt(past_b)
        self.weights, self.constant = beta * ratio, b


@dataclass
class MetadataView:
    """Logistic regression on scaled values and the first ones' squares; for the shape of a text as well."""

    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z[:, : len(_SHAPE)] ** 2, np.ones((len(z), 1))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self._inputs(x) @ self.weights

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        balance = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        self.weights = _newton(self._inputs(x), y, balance, ridge=1.0)


@dataclass
class Model:
    content: ContentView
    metadata: MetadataView
    #: per view: slope and constant of the calibration; then the combination
    platt: list[tuple[float, float]]
    joint: np.ndarray
    #: chance of a good document without any evidence, where nothing could be fitted
    prior: float | None = None

    def score(self, views: Views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances by content and by metadata, and the combined one."""
        n = len(views.words)
        if self.prior is not None or not n:
            same = np.full(n, 0.5 if self.prior is None else self.prior)
            return same, same, same
        odds = np.stack(self.calibrated(views), axis=1)
        both = np.hstack([np.clip(odds, -12, 12), np.ones((len(odds), 1))])
        return _sigmoid(odds[:, 0]), _sigmoid(odds[:, 1]), _sigmoid(both @ self.joint)

    def odds(self, views: Views) -> tuple[np.ndarray, np.ndarray]:
        return self.content.odds(views.words, views.shapes), self.metadata.odds(views.meta)

    def calibrated(self, views: Views) -> list[np.ndarray]:
        return [a * z + b for (a, b), z in zip(self.platt, self.odds(views), strict=True)]


@dataclass
class Views:
    """Documents' word slots, shapes and metadata."""

    words: list[np.ndarray]
    shapes: np.ndarray
    meta: np.ndarray

    def rows(self, at: np.ndarray) -> Views:
        return Views([self.words[i] for i in at.tolist()], self.shapes[at], self.meta[at])

    def plus(self, other: Views) -> Views:
        return Views(self.words + other.words, np.vstack([self.shapes, other.shapes]), np.vstack([self.meta, other.meta]))


def _empty() -> Views:
    return Views([], np.zeros((0, len(_SHAPE))), np.zeros((0, _META)))


def surest(odds: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Labels (1 and 0, -1 for none) of the surest rows: at most so many good and bad ones, with odds beyond ``SURE``."""
    label = np.full(len(odds), -1.0)
    order = np.argsort(-odds, kind="stable")
    label[order[: share[0]][odds[order[: share[0]]] > SURE]] = 1.0
    low = order[::-1][: share[1]]
    label[low[odds[low] < -SURE]] = 0.0
    return label


#: Gives a round's pseudo-labels: documents with the content view's and the metadata view's labels (-1: none).
Pick = Callable[["Model", tuple[int, int], set], tuple[list, Views, np.ndarray, np.ndarray]]


def co_train(views: Views, y: np.ndarray, pick: Pick | None = None, rounds: int = ROUNDS, confident: int = CONFIDENT) -> Model:
    """y: 1 good, 0 bad.  A fifth of the labelled rows is held back for calibration.

    ``pick`` is given the model, how many good and bad documents to label, and
    the names of those that have a label already.
    """
    if len(y) < 10 or y.min(initial=1) == y.max(initial=0):
        return Model(ContentView(), MetadataView(), [], np.zeros(3), float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        use = held = np.ones(len(y), bool)
    else:
        use = ~held
    own, kept, truth = views.rows(np.flatnonzero(use)), views.rows(np.flatnonzero(held)), y[held]
    share = max(1, round(confident * y.mean())), max(1, round(confident * (1 - y.mean())))
    for_content, for_metadata, taken = (_empty(), np.zeros(0)), (_empty(), np.zeros(0)), set()
    best: tuple[float, Model] | None = None
    for k in range(rounds + 1):
        model = Model(ContentView(), MetadataView(), [], np.zeros(3))
        more = own.plus(for_content[0])
        model.content.fit(more.words, more.shapes, np.concatenate([y[use], for_content[1]]))
        model.metadata.fit(own.plus(for_metadata[0]).meta, np.concatenate([y[use], for_metadata[1]]))
        odds = model.odds(kept)
        for z in odds:
            w = _newton(np.stack([z, np.ones(len(z))], axis=1), truth, np.ones(len(z)), ridge=1e-2)
            model.platt.append((max(0.0, float(w[0])), float(w[1])))
        inputs = np.stack([s * z + c for (s, c), z in zip(model.platt, odds, strict=True)] + [np.ones(len(truth))], axis=1)
        model.joint = _newton(np.clip(inputs, -12, 12), truth, np.ones(len(truth)), ridge=0.1)
        p = np.clip(model.score(kept)[2], 1e-6, 1 - 1e-6)
        loss = float(-np.log(np.where(truth > 0.5, p, 1 - p)).mean())
        if best is not None and loss >= best[0]:
            break
        best = (loss, model)
        if k == rounds or pick is None:
            break
        names, found, by_content, by_metadata = pick(model, share, taken)
        taken |= set(names)
        # where both are sure of different things, neither teaches
        agree = ~((by_content >= 0) & (by_metadata >= 0) & (by_content != by_metadata))
        learn = [np.flatnonzero((x >= 0) & agree) for x in (by_metadata, by_content)]
        for_content = (for_content[0].plus(found.rows(learn[0])), np.concatenate([for_content[1], by_metadata[learn[0]]]))
        for_metadata = (for_metadata[0].plus(found.rows(learn[1])), np.concatenate([for_metadata[1], by_content[learn[1]]]))
    return best[1]


_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _views(batch: pa.RecordBatch) -> Views:
    rows, shapes, meta = [], np.zeros((batch.num_rows, len(_SHAPE))), np.zeros((batch.num_rows, _META))
    other = [batch.column(i).to_pylist() for i in (2, 3, 4)]
    for k, x in enumerate(batch.column(1)):
        text = x.as_py() or ""
        words = words_of(text)
        rows.append(content(words))
        shapes[k] = shape(text, words)
        meta[k] = metadata(*(c[k] for c in other))
    return Views(rows, shapes, meta)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", docs["lang"].cast("string"), docs["source"].cast("string"), docs["n_chars"].cast("bigint"))


_FEATURES = "name string, good int, words binary, shapes binary, meta binary"


def _features(rows: DataFrame) -> DataFrame:
    """name (hash of the row), good, and the views, of rows with the columns of ``_plain`` and ``good``; then doc_id."""
    named = rows.withColumn("name", F.xxhash64("doc_id", "text", "lang", "source", "n_chars").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _views(batch)
            held = [[x.astype(np.int32).tobytes() for x in v.words], [x.astype(np.float32).tobytes() for x in v.shapes], [x.astype(np.float32).tobytes() for x in v.meta]]
            yield pa.RecordBatch.from_arrays([batch.column(6), batch.column(5), *[pa.array(x, pa.binary()) for x in held], batch.column(0)], ["name", "good", "words", "shapes", "meta", "doc_id"])

    kind = named.schema["doc_id"].dataType.simpleString()
    return named.select(*_COLUMNS, "good", "name").mapInArrow(run, f"{_FEATURES}, doc_id {kind}")


def _read(batch: pa.RecordBatch | pa.Table) -> Views:
    cols = [[x.as_py() for x in batch.column(k)] for k in (2, 3, 4)]
    if not cols[0]:
        return _empty()
    stack = lambda c: np.stack([np.frombuffer(x, np.float32) for x in c]).astype(np.float64)
    return Views([np.frombuffer(x, np.int32) for x in cols[0]], stack(cols[1]), stack(cols[2]))


def pick_from(features: DataFrame, known: DataFrame | None = None) -> Pick:
    """Picks from a table of features the surest rows without a label, whose doc_id is not in ``known`` either; equal rows once."""

    def pick(model: Model, share: tuple[int, int], taken: set) -> tuple[list, Views, np.ndarray, np.ndarray]:
        held = features.sparkSession.sparkContext.broadcast((model, taken))  # of bounded size
        kind = features.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, taken = held.value
            for batch in batches:
                odds = model.calibrated(_read(batch))
                sure = (np.abs(odds[0]) > SURE) | (np.abs(odds[1]) > SURE)
                sure &= np.array([x not in taken for x in batch.column(0).to_pylist()], bool)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), *map(pa.array, odds)], ["name", "doc_id", "a", "b"]).filter(pa.array(sure))

        sure = materialise(features.where("good IS NULL").mapInArrow(run, f"name string, doc_id {kind}, a double, b double"), "quality-sure")
        rest = sure if known is None else sure.join(known.select("doc_id"), "doc_id", "left_anti")
        pool = materialise(rest.select("name", "a", "b").dropDuplicates(["name"]), "quality-pool")
        ends = [pool.orderBy(*by).limit(n) for c in ("a", "b") for by, n in (((F.desc(c), "name"), share[0]), ((F.asc(c), "name"), share[1]))]
        best = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).dropDuplicates(["name"]).toArrow().sort_by("name")  # twice ``CONFIDENT``
        found = features.where(F.col("name").isin(best["name"].to_pylist())).drop("doc_id").dropDuplicates(["name"]).toArrow().sort_by("name")
        return best["name"].to_pylist(), _read(found), *(surest(best[c].to_numpy(), share) for c in "ab")

    return pick


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    """From ``labels`` (doc_id, quality, toxic): good is quality 1 and not toxic.

    A doc_id that is labelled more than once is good only if it always is.
    """
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))
    sample = bounded_sample(known, max_labelled, "doc_id", F.lit("quality"))
    given = _plain(docs).join(F.broadcast(sample), "doc_id").select(*_COLUMNS, "good")
    found = _features(bounded_sample(given, max_labelled, "doc_id", "text")).toArrow()
    order = np.argsort([zlib.crc32(x.encode()) for x in found["name"].to_pylist()], kind="stable")
    found = found.take(pa.array(order))
    y = np.array(found["good"].to_pylist(), np.float64)
    pick = features = None
    if rounds and len(set(y.tolist())) == 2:
        # labelled documents beyond the sample are no pool
        every = _plain(docs).withColumn("good", F.lit(None).cast("int")).select(*_COLUMNS, "good")
        features = materialise(_features(every), "quality-features")
        pick = pick_from(features, known)
    model = co_train(_read(found), y, pick, rounds)
    if features is not None:
        drop_table(features)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """p_content, p_metadata and score, beside doc_id or the columns ``keep``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kept = keep or ["doc_id"]
    plain = [docs["doc_id"], docs["text"], docs["lang"].cast("string"), docs["source"].cast("string"), docs["n_chars"].cast("bigint")]
    given = docs.select(*plain, F.struct(*[docs[c] for c in kept]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held.value.score(_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column(5), *map(pa.array, found)], ["row", "p_content", "p_metadata", "score"])

    row = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(run, f"row {row}, p_content double, p_metadata double, score double").select("row.*", "p_content", "p_metadata", "score")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """doc_id, p_content, p_metadata, score, good for each row of ``docs`` (doc_id, text, lang, source, n_chars).

    A null text counts as empty, null metadata is a value of its own; repeated
    rows each give a row and equal rows equal scores; very long texts are read
    whole; an empty table gives no rows.  Without labels of both kinds all
    documents get the share of good labels (one half without any).  Other
    columns are ignored.
    """
    scored = score(docs, fit(docs, labels), keep)
    return scored.withColumn("good", F.col("score") >= threshold)
