"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

All of it is DataFrame and SQL functions.  The trees are grown from histograms:
one aggregation per level over a bounded, hash-chosen sample of labelled URLs
(``MAX_LABELLED`` rows); only the histograms (nodes x features x bins) come to
the driver.  The finished trees are one SQL expression, so scoring is a scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeforge.llm.common import bounded_sample, materialise

#: Bound of the labelled rows that the trees are fitted on.
MAX_LABELLED = 40_000
ROUNDS, DEPTH, BINS, RATE, SMOOTH = 8, 3, 16, 0.5, 1.0
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "path_digits", "has_fragment", "suffix_rows", "suffix_blocked")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines like ``allow org/`` or ``block example.org/es/``."""
    out = []
    for line in lines:
        verdict, target = line.split()
        host, slash, path = target.partition("/")
        out.append(Rule(verdict, host, slash + path))
    return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path: both empty where the url is null or has no ``://``."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise(F.lit(""))
    frame = pages.withColumn("_rest", rest)
    host = F.regexp_extract("_rest", r"\A([^/?#]*)", 1)
    frame = frame.withColumn("_host", host)
    after = F.substr(F.col("_rest"), F.length("_host") + 1)
    return (
        frame.withColumn("host", lower_ascii(F.col("_host")))
        .withColumn("path", F.regexp_extract(after, r"\A([^?#]*)", 1))
        .drop("_rest", "_host")
    )


def rule_column(rules: list[Rule]) -> Column:
    """The index of the longest rule that fits host and path; null if none does."""
    chosen = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: (len(rules[k].text), -k)):  # longer ones are asked first
        r = rules[k]
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        chosen = F.when(fits, F.lit(k)).otherwise(chosen)
    return chosen


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of url, host and path, all but the suffix statistics, and ``suffix``."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    digits = n - F.length(F.translate(url, "0123456789", ""))
    chars = F.array_distinct(F.split(url, ""))
    share = F.transform(chars, lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    number = {
        "length": n, "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "host_labels": F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
        "path_digits": F.length("path") - F.length(F.translate("path", "0123456789", "")),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    return urls.withColumns({k: v.cast("double") for k, v in number.items()}).withColumn("suffix", F.regexp_extract("host", r"([^.]*)\z", 1))


def suffix_statistics(urls: DataFrame, label: str) -> DataFrame:
    """suffix, suffix_rows (log of its rows), blocked and labelled (how many) over all rows."""
    return urls.groupBy("suffix").agg(
        F.log1p(F.count(F.lit(1))).alias("suffix_rows"), F.coalesce(F.sum(F.col(label)), F.lit(0.0)).alias("blocked"), F.count_if(F.col(label).isNotNull()).alias("labelled"),
    )


def with_suffix(urls: DataFrame, stats: DataFrame, label: str | None = None) -> DataFrame:
    """Adds suffix_rows and suffix_blocked, the smoothed share of blocked labels; a row's own ``label`` is left out of it."""
    own, one = (F.col(label), 1) if label else (F.lit(0.0), 0)
    full = urls.join(stats, "suffix", "left").fillna({"suffix_rows": 0.0, "blocked": 0.0, "labelled": 0})
    return full.withColumn("suffix_blocked", (F.col("blocked") - own + 1) / (F.col("labelled") - one + 2)).drop("blocked", "labelled")


Tree = list  # nested: [feature, threshold, left, right] or a leaf's value


def tree_column(tree: Tree | float) -> Column:
    if not isinstance(tree, list):
        return F.lit(float(tree))
    feature, cut, left, right = tree
    return F.when(F.col(feature) <= F.lit(float(cut)), tree_column(left)).otherwise(tree_column(right))


def margin_column(model: dict) -> Column:
    total = F.lit(float(model["bias"]))
    for t in model["trees"]:
        total = total + tree_column(t)
    return total


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED, rounds: int = ROUNDS, depth: int = DEPTH, features: tuple[str, ...] = FEATURES) -> dict:
    """Boosted trees for ``label`` (1 blocked, 0 allowed) of rows with ``features`` and ``url``.

    Rows are chosen by their url's hash, ``max_rows`` at most, repeated urls one
    by one; all of them while there are no more.  Without both labels the model is constant.
    """
    size = labelled.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    chosen = materialise(bounded_sample(labelled, max_rows, "url", size=size).select("label", *features), "url-sample")
    cuts_of = [F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 2000).alias(f) for f in features]
    first = chosen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("y"), *cuts_of).first()
    n, y = first["n"], first["y"]
    model = {"bias": math.log((y + 0.5) / (n - y + 0.5)), "trees": []}
    if not 0 < y < n:
        return model
    cuts = {f: sorted(set(first[f])) for f in features}
    bins = chosen.select(
        "label",
        *features,
        F.posexplode(F.array(*[sum(((F.col(f) > F.lit(float(c))).cast("int") for c in cuts[f]), F.lit(0)) for f in features])).alias("f", "bin"),
    )
    binned = materialise(bins, "url-bins")  # a row for each row and feature, made once for all levels
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-margin_column(model)))
        tree: Tree | float = 0.0
        leaves: dict[tuple, float] = {(): 0.0}  # paths of left (0) and right (1) turns
        splits: dict[tuple, tuple[str, float]] = {}
        level = [()]
        for d in range(depth):
            node = _node_column(splits)
            sums = (
                binned.select(node.alias("node"), (F.col("label") - p).alias("g"), (p * (1 - p)).alias("h"), "f", "bin")
                .groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # nodes x features x bins
            )
            hist: dict[str, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in sums:
                hist.setdefault(r["node"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
            deeper = []
            for path in level:
                own = hist.get(_name(path))
                if not own:
                    continue
                split = _best_split(own, features, cuts)
                total = [sum(x[k] for x in own[0].values()) for k in (0, 1)]
                leaves[path] = RATE * total[0] / (total[1] + SMOOTH)
                if split:
                    gain, f, cut, gl, hl = split
                    splits[path] = (f, cut)
                    leaves[*path, 0] = RATE * gl / (hl + SMOOTH)
                    leaves[*path, 1] = RATE * (total[0] - gl) / (total[1] - hl + SMOOTH)
                    deeper += [(*path, 0), (*path, 1)]
            level = deeper
            if not level:
                break

        def grow(path: tuple) -> Tree | float:
            return [*splits[path], grow((*path, 0)), grow((*path, 1))] if path in splits else leaves[path]

        tree = grow(())
        model["trees"].append(tree)
    return model


def _name(path: tuple) -> str:
    return "r" + "".join(map(str, path))


def _node_column(splits: dict, path: tuple = ()) -> Column:
    if path not in splits:
        return F.lit(_name(path))
    f, cut = splits[path]
    return F.when(F.col(f) <= F.lit(float(cut)), _node_column(splits, (*path, 0))).otherwise(_node_column(splits, (*path, 1)))


def _best_split(hist: dict, features: tuple[str, ...], cuts: dict) -> tuple | None:
    """The split of greatest gain: (gain, feature, cut, left gradient, left weight); ties to the first."""
    best = None
    for k, f in enumerate(features):
        bins = hist[k]
        g, h = (sum(x[j] for x in bins.values()) for j in (0, 1))
        gl = hl = 0.0
        for b, cut in enumerate(cuts[f]):
            x = bins.get(b, (0.0, 0.0))
            gl, hl = gl + x[0], hl + x[1]
            if hl < 1e-3 or h - hl < 1e-3:
                continue
            gain = gl**2 / (hl + SMOOTH) + (g - gl) ** 2 / (h - hl + SMOOTH) - g**2 / (h + SMOOTH)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, cut, gl, hl)
    return best


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of ``pages`` (page_id, url).

    A rule decides where one fits; elsewhere the trees do: ``block`` where the
    chance of being blocked is at least one half.  They learn from ``labelled``
    (url, label: 1 blocked), by default from the URLs that the rules decide.
    Null urls and urls without ``://`` have empty host and path and are judged
    by the trees; repeated rows each give a row; other columns are ignored;
    with nothing labelled every verdict without a rule is ``allow``.
    """
    parts = with_parts(pages.select("page_id", "url")).withColumn("_k", rule_column(rules))
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array(F.lit(""))
    texts = F.array(*[F.lit(r.text) for r in rules]) if rules else F.array(F.lit(""))
    parts = parts.withColumn("_ruled", F.get(verdicts, F.col("_k"))).withColumn("rule", F.get(texts, F.col("_k")))
    own = F.when(F.col("_ruled").isNotNull(), (F.col("_ruled") == "block").cast("double"))
    scored = materialise(with_features(parts.withColumn("label", own)), "url-features")  # read for statistics, the sample and the scores
    if labelled is None:
        known = scored
        learn = scored.where(F.col("label").isNotNull())
    else:
        given = labelled.select(F.lit(None).cast("long").alias("page_id"), "url", F.col("label").cast("double").alias("label"))
        known = learn = with_features(with_parts(given))
    stats = suffix_statistics(known, "label")
    fitted = train(with_suffix(learn, stats, "label"))
    full = with_suffix(scored, stats)
    score = 1 / (1 + F.exp(-margin_column(fitted)))
    return full.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_ruled", F.when(score >= 0.5 if fitted["trees"] else F.lit(False), "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
