"""Language identification by hierarchical discrimination.

A text is first given to a language family, then one-versus-one linear support vector machines
tell that family's languages apart. Features are hashed byte 1- to 3-grams of the whole text (ASCII
letters lower-cased, other ASCII taken as a space), as the square roots of their shares, so that a
long text weighs no more than a short one.

The machines are fitted on a bounded sample of labelled rows: `max_train_rows` dealt evenly to the labels,
those with the smallest hash of id and text, and at least LEAST_ROWS a label where it has them. Labels
outside the family table are families of their own; where they are many, those that look most alike are
put into one family, about as many families as there are labels in each, so the number of machines grows
with the power 1.5 of the number of labels. `max_labels` bounds the driver's memory: beyond it, far more
than there are written languages in the table above, the most frequent labels are learned.
Predictions cover every row and see only its text.

Defined cases: a null text or one without a letter is `und` with score 0; with no labelled row at
all every text is `und`; repeated rows and
ties give repeated results (equal votes: the label that sorts first); an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_worker, fresh

UNKNOWN = "und"
#: Genealogical families of common language codes.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "indic": ["hi", "bn", "ur", "mr", "ne", "pa", "gu"],
    "semitic": ["ar", "he", "am", "mt"],
    "celtic": ["ga", "cy", "gd", "br"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
DIMENSIONS = 1 << 14
#: Rows of a label that are learned at least; labels outside the table that are families of their own at most; rows judged at once.
LEAST_ROWS, OWN_FAMILIES, ROWS_AT_ONCE = 8, 16, 128
_PIECE = 1 << 18
_CLEAN = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def features(text: str) -> np.ndarray:
    data = (" " + text + " ").encode("utf-8", "surrogatepass").translate(_CLEAN)
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(data), _PIECE):
        b = np.frombuffer(data[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        own = min(_PIECE, len(data) - at)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        for gram, tag in ((b[:own], 1), (two[:own], 2), (three[:own], 3)):
            hashed = ((gram + np.uint32(tag << 24)) * np.uint32(2654435761)) >> np.uint32(18)
            counts += np.bincount(hashed, minlength=DIMENSIONS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def fit_svm(x: np.ndarray, positive: np.ndarray, epochs: int = 12, c: float = 10.0, rows: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-loss linear machine; classes weigh the same in all. `rows`
    are the rows of x that `positive` speaks of, so that no part of x is copied."""
    rows = np.arange(len(x)) if rows is None else rows
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, len(y) / max(1, 2 * positive.sum()), len(y) / max(1, 2 * (~positive).sum()))
    damp = 1 / (2 * c * share)
    square = np.array([x[i] @ x[i] for i in rows]) + 1.0 + damp
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            own = x[rows[i]]
            gradient = y[i] * (own @ w + bias) - 1 + damp[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * own
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w, bias


class Duels:
    """One-versus-one machines among `labels`; `votes` are mean win chances, 0 to 1.

    x holds the features `active` alone, of all training rows; rows with another label are left out.
    """

    def __init__(self, labels: list[str], x: np.ndarray, y: np.ndarray, active: np.ndarray):
        self.labels = labels
        self.pairs = list(itertools.combinations(range(len(labels)), 2))
        self.w, self.bias = np.zeros((len(self.pairs), DIMENSIONS), np.float32), np.zeros(len(self.pairs))
        for n, (a, b) in enumerate(self.pairs):
            own = np.flatnonzero((y == labels[a]) | (y == labels[b]))
            self.w[n, active], self.bias[n] = fit_svm(x, y[own] == labels[a], rows=own)

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Of each row of x, a column a label."""
        if len(self.labels) == 1:
            return np.ones((len(x), 1))
        # row by row in the same order of additions, whatever rows are judged together
        margins = np.stack([self.w @ row for row in x]) + self.bias
        win = 1 / (1 + np.exp(-np.clip(4 * margins, -50, 50)))
        got = np.zeros((len(x), len(self.labels)))
        for n, (a, b) in enumerate(self.pairs):
            got[:, a] += win[:, n]
            got[:, b] += 1 - win[:, n]
        return got / (len(self.labels) - 1)


def families(x: np.ndarray, y: np.ndarray) -> dict[str, str]:
    """The family of each label of y: that of the table, or its own, or, where more than OWN_FAMILIES
    labels are outside the table, one shared with the labels whose mean features are nearest to its own."""
    labels = sorted(set(y))
    out = {v: _FAMILY.get(v, v) for v in labels}
    rest = [v for v in labels if v not in _FAMILY]
    if len(rest) <= OWN_FAMILIES:
        return out
    size = int(np.ceil(len(rest) ** 0.5))
    means = {v: x[y == v].mean(axis=0) for v in rest}
    while rest:
        near = sorted(rest, key=lambda v: (-float(means[v] @ means[rest[0]]) / float(np.linalg.norm(means[v]) + 1e-9), v))[:size]
        near = near if rest[0] in near else [rest[0], *near[:-1]]
        out |= dict.fromkeys(near, rest[0])
        rest = [v for v in rest if v not in near]
    return out


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, active: np.ndarray):
        of = families(x, y)
        family = np.array([of[v] for v in y], dtype=object)
        names = sorted(set(family))
        self.top = Duels(names, x, family, active)
        self.inner = {f: Duels(sorted(set(y[family == f])), x, y, active) for f in names}

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(label, score) of each text; of equal votes the label that sorts first."""
        x = np.stack([features(t) for t in texts])
        votes = self.top.votes(x)
        at, out = votes.argmax(axis=1), [("", 0.0)] * len(texts)
        for f in np.unique(at):
            rows, duels = np.flatnonzero(at == f), self.inner[self.top.labels[f]]
            own = duels.votes(x[rows])
            for r, best, p in zip(rows, own.argmax(axis=1), own.max(axis=1), strict=True):
                out[r] = (duels.labels[best], float(votes[r, f] * p))
        return out


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", max_train_rows: int = 1_024, max_labels: int = 512) -> Model | None:
    """Fit on `max_train_rows` labelled rows, or LEAST_ROWS a label if that is more, of at most `max_labels`
    labels (the most frequent, ties: the label that sorts first); only the features that occur in them reach the driver.

    Rows count as equal when id and text are. A label's rows below a hash that about twice its share
    passes are ranked, so the rows that meet in one task do not grow with the label.
    """
    rows = labelled.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("y"), F.xxhash64(F.col(id_col), F.col(text).cast("string")).alias("h")).filter(r"y is not null and t rlike '\\p{L}'")
    sizes = rows.groupBy("y").count().orderBy(F.desc("count"), "y").limit(max_labels).collect()
    if not sizes:
        return None
    each = max(LEAST_ROWS, max_train_rows // len(sizes))
    room = 2 * each + 64
    below = {r.y: int(-(2**63) + 2**64 * (room / r["count"])) if r["count"] > room else 2**63 - 1 for r in sizes}
    limits = labelled.sparkSession.createDataFrame(sorted(below.items()), "y string, below long")
    near = rows.join(F.broadcast(limits), "y").filter("h <= below").dropDuplicates(["y", "h"])
    first = Window.partitionBy("y").orderBy("h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean_worker()
        for batch in batches:
            sparse = [features(t) for t in batch["t"]]
            at = [np.flatnonzero(x) for x in sparse]
            yield pd.DataFrame({"h": batch["h"], "y": batch["y"], "at": [a.astype("<u2").tobytes() for a in at], "x": [x[a].tobytes() for x, a in zip(sparse, at, strict=True)]})

    # only the features that occur travel: a few kilobytes a row
    chosen = near.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= each).select("h", "y", "t")
    got = sorted(chosen.mapInPandas(run, "h long, y string, at binary, x binary").collect(), key=lambda r: (r.y, r.h))
    at = [np.frombuffer(r["at"], "<u2") for r in got]
    active = np.unique(np.concatenate(at))
    x = np.zeros((len(got), len(active)), np.float32)
    for row, own, r in zip(x, at, got, strict=True):
        row[np.searchsorted(active, own)] = np.frombuffer(r["x"], np.float32)
    return Model(x, np.array([r["y"] for r in got], dtype=object), active)


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs with the predicted label and its score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    legible: Column = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))

    @F.pandas_udf("label string, score double")
    def judge(texts: pd.Series, ok: pd.Series) -> pd.DataFrame:
        clean_worker()
        model = shared.value
        out = [(UNKNOWN, 0.0)] * len(texts)
        legible = np.flatnonzero(ok.to_numpy(bool)) if model else []
        for at in range(0, len(legible), ROWS_AT_ONCE):
            part = legible[at : at + ROWS_AT_ONCE]
            for i, found in zip(part, model.predict([texts.iloc[i] for i in part]), strict=True):
                out[i] = found
        return pd.DataFrame(out, columns=["label", "score"])

    own = fresh(docs, "_judged")
    judged = docs.select(*(keep or docs.columns), judge(F.col(text).cast("string"), legible).alias(own))
    return judged.withColumns({names[0]: F.col(f"{own}.label"), names[1]: F.col(f"{own}.score")}).drop(own)
