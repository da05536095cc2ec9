"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

A text becomes a few dozen statistics (shares of letters, symbols, blanks and
repeats, word lengths, entropies ...).  Standardised and mapped through
``cos(Wx + b)`` with Gaussian W they approximate a Gaussian kernel.  The ridge
fit needs only the sums Z'Z and Z'y: every partition adds up its own, row by row
of the matrix, and Spark adds the partitions' sums, so the fit reads all
labelled rows whatever their number and the driver holds one small matrix per
fold.  Scores become probabilities by isotonic regression over scores from
models that did not see the row (one fold out; sums of the other folds are
sums without that fold's), pooled in bins of ``1 / BINS``.

Statistics are computed from the text alone.  Fitting is deterministic up to
the order of floating-point sums.

Defined cases: null and empty texts have all statistics 0 and get a score like
any other; rows labelled null take no part in fitting; repeated documents and
labels count as often as they stand; with no labels, or labels of one kind
only, every score is the mean label (0.5 without labels); null ids are scored
and never used for fitting; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import stored, text_of

FEATURES = 256
RIDGE = 1e-2  # per labelled row
SEED = 7
FOLDS = 5
BINS = 2000
THRESHOLD = 0.3

NAMES = (
    "log_chars", "log_words", "word_length", "long_words", "short_words", "upper", "lower", "digits", "blanks",
    "marks", "signs", "sign_words", "mark_runs", "shouted_words", "pipes", "bars_per_line", "types", "top_word",
    "top_three", "same_again", "log_longest_repeat", "log_lines", "same_lines", "short_lines", "sentence_ends",
    "char_entropy", "word_entropy", "non_ascii", "title_words", "odd_case", "digit_words", "urls",
)
_MARK_RUN = re.compile(r"[^\w\s]{2,}")
_SIGN_WORD = re.compile(r"(?:^|(?<=\s))\S*[#$%&*@^~<>{}\[\]\\|=+_]\S*")
_URL = re.compile(r"https?://|www\.|@\w+\.")


def _entropy(counts) -> float:
    n = sum(counts)
    return -sum(c / n * math.log(c / n) for c in counts) if n else 0.0


def statistics(text: str) -> list[float]:
    """The statistics of a text, in the order of NAMES; all 0 without words."""
    words = text.split()
    n, w = len(text), len(words)
    if not w:
        return [0.0] * len(NAMES)
    chars = Counter(text)
    upper = lower = digits = blanks = marks = signs = wide = 0
    for c, k in chars.items():
        if c.isupper():
            upper += k
        elif c.islower():
            lower += k
        elif c.isdigit():
            digits += k
        elif c.isspace():
            blanks += k
        elif c in ".,;:!?'\"()-":
            marks += k
        else:
            signs += k
        if c > "\x7f":
            wide += k
    counts = Counter(words)
    top = counts.most_common(3)
    lengths = list(map(len, words))
    same = sum(map(str.__eq__, words, words[1:]))
    run = longest = 1
    if same:
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
    lines = [x for x in text.split("\n") if x]
    shouted = sum(1 for x, k in counts.items() for _ in range(k) if len(x) > 1 and x.isupper()) if upper else 0
    title = sum(k for x, k in counts.items() if x[0].isupper() and not x.isupper())
    odd = sum(k for x, k in counts.items() if not (x.islower() or x.isupper() or x.istitle()))
    bars = chars.get("|", 0)
    ends = chars.get(".", 0) + chars.get("!", 0) + chars.get("?", 0)
    return [
        math.log1p(n), math.log1p(w), min(sum(lengths) / w, 40.0),
        sum(x > 12 for x in lengths) / w, sum(x < 3 for x in lengths) / w,
        upper / n, lower / n, digits / n, blanks / n, marks / n, signs / n,
        min(1.0, len(_SIGN_WORD.findall(text)) / w) if signs else 0.0,
        min(2.0, len(_MARK_RUN.findall(text)) / w) if marks or signs else 0.0,
        shouted / w, bars / w, min(bars / len(lines), 20.0) if lines else 0.0,
        len(counts) / w, top[0][1] / w, sum(k for _, k in top) / w, same / w, math.log(longest),
        math.log1p(len(lines)), 1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(len(x) < 30 for x in lines) / len(lines) if lines else 0.0, min(ends / w, 2.0),
        _entropy(chars.values()), _entropy(counts.values()) / math.log(w + 1), wide / n, title / w, odd / w,
        sum(k for x, k in counts.items() if any(c.isdigit() for c in x)) / w if digits else 0.0,
        min(1.0, len(_URL.findall(text)) / w),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measured(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": list(map(statistics, b["text"]))})

    return (docs.select("doc_id", text_of().alias("text"))
            .mapInPandas(measured, f"doc_id {kind}, x array<double>"))


class Fourier:
    """Standardised statistics to ``features`` cosines and a constant."""

    def __init__(self, mean, scale, features: int = FEATURES, seed: int = SEED):
        d = len(mean)
        draw = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.w = draw.normal(0, 1 / math.sqrt(d), (d, features))  # kernel width sqrt(d)
        self.b = draw.uniform(0, 2 * math.pi, features)
        self.gain = math.sqrt(2 / features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([self.gain * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def normal_equations(rows: DataFrame, fourier: Fourier, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y of each fold.  ``rows``: (fold, x, y).  Each partition's sums go
    out one matrix row at a time, keyed by fold and row."""
    size = len(fourier.b) + 1

    def partition_sums(batches):
        total = np.zeros((folds, size, size + 1))
        for b in batches:
            if not len(b):
                continue
            z = fourier(np.stack(b["x"].to_numpy()))
            y, fold = b["y"].to_numpy(dtype=float), b["fold"].to_numpy()
            for f in np.unique(fold):
                own = z[fold == f]
                total[f, :, :size] += own.T @ own
                total[f, :, size] += own.T @ y[fold == f]
        for f in range(folds):
            if total[f, -1, -2]:  # the constant's own entry: the fold's rows
                yield pd.DataFrame({"fold": f, "place": range(size), "sums": list(total[f])})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[:1].copy()
        first["sums"] = [np.sum(np.stack(part["sums"].to_numpy()), axis=0)]
        return first

    schema = "fold int, place int, sums array<double>"
    summed = rows.mapInPandas(partition_sums, schema).groupBy("fold", "place").applyInPandas(added, schema)
    a, v = np.zeros((folds, size, size)), np.zeros((folds, size))
    for r in summed.toLocalIterator():  # folds * size rows, whatever the input
        a[r.fold, r.place], v[r.fold, r.place] = r.sums[:size], r.sums[size]
    return a, v


def solve(a: np.ndarray, v: np.ndarray, ridge: float) -> np.ndarray:
    n = max(a[-1, -1], 1.0)
    penalty = np.full(len(v), ridge * n / len(v))
    penalty[-1] = 1e-9 * n  # the constant is free
    return np.linalg.solve(a + np.diag(penalty), v)


def isotonic(score: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (score, probability), both rising."""
    blocks: list[list[float]] = []  # weight, mean, first and last score
    for s, w, m in sorted(zip(score, weight, mean)):
        blocks.append([w, m, s, s])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, _, last = blocks.pop()
            w1, m1, first, _ = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), first, last])
    x = [e for b in blocks for e in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    y = [b[1] for b in blocks for _ in range(2 if b[3] > b[2] else 1)]
    return np.array(x), np.array(y)


class Classifier:
    def __init__(self, fourier, weights, knots):
        self.fourier, self.weights, self.knots = fourier, weights, knots

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), self.knots)
        return np.interp(self.fourier(x) @ self.weights, *self.knots)


def remainder(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED,
        folds: int = FOLDS) -> Classifier:
    """Fits on the labelled rows whose remainder is not 0; ``labels``: (doc_id, y)."""
    rows = (stats.join(labels.where("doc_id IS NOT NULL AND y IS NOT NULL"), "doc_id")
            .withColumn("fold", remainder(F.col("doc_id"), folds)).where("fold <> 0")
            .select("fold", "x", F.col("y").cast("double").alias("y")))
    rows = stored(rows, "quality-train")
    d = len(NAMES)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
                     *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(d)],
                     *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(d)]).first()
    if not facts["n"] or facts["y"] in (0.0, 1.0):
        return Classifier(None, None, 0.5 if not facts["n"] else facts["y"])
    fourier = Fourier([facts[f"m{k}"] for k in range(d)], [facts[f"s{k}"] or 1.0 for k in range(d)], features, seed)
    a, v = normal_equations(rows, fourier, folds)
    used = [f for f in range(folds) if a[f, -1, -1]]
    whole = solve(a.sum(0), v.sum(0), ridge)
    # Scores of rows that a model has not seen, for the calibration.
    unseen = {f: solve(a.sum(0) - a[f], v.sum(0) - v[f], ridge) if len(used) > 1 else whole for f in used}

    def scored(batches):
        for b in batches:
            if not len(b):
                continue
            z = fourier(np.stack(b["x"].to_numpy()))
            w = np.stack([unseen[f] for f in b["fold"]])
            yield pd.DataFrame({"bin": np.rint((z * w).sum(1).clip(-1, 2) * BINS).astype("int64"), "y": b["y"]})

    bins = (rows.mapInPandas(scored, "bin long, y double").groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).toPandas())  # 3 * BINS + 1 rows at most
    knots = isotonic(bins["bin"].to_numpy() / BINS, bins["n"].to_numpy(float), bins["y"].to_numpy())
    return Classifier(fourier, whole, knots)


def score(stats: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``stats``."""
    @F.pandas_udf("double")
    def judged(x: pd.Series) -> pd.Series:
        return pd.Series(model(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return (stats.withColumn("score", judged("x"))
            .select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; ``labels``:
    (doc_id, y)."""
    stats = stored(document_statistics(docs), "quality-statistics")
    return score(stats, fit(stats, labels), threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject; columns unchanged.

    Statistics for the fit are those of labelled rows only.  A row is judged by its own
    text as it is read, so nothing is joined back."""
    labelled = labels.where("doc_id IS NOT NULL AND y IS NOT NULL").select("doc_id").distinct()
    own = docs.select("doc_id", "text").join(labelled, "doc_id", "left_semi")
    model = fit(document_statistics(own), labels)  # which stores the labelled rows

    @F.pandas_udf("double")
    def judged(text: pd.Series) -> pd.Series:
        return pd.Series(model(np.array(list(map(statistics, text)))) if len(text) else np.zeros(0))

    return docs.where(judged(text_of()) >= threshold)
