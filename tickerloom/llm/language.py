"""Language by families: first the family, then one-versus-one linear machines inside it.

Features are counts of hashed byte n-grams (one to three bytes of the lower-cased
text), scaled by square root and to unit length.  The languages are joined to families
by the likeness of their mean vectors; linear support vector machines (squared hinge
loss) tell the families apart and, inside a family, every two languages.

Training reads at most ``rows_per_language`` labelled rows of each language (taken by
a hash of id and text, documented bound); prediction reads every text whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; labels that
are null don't train; with no labelled row every text is ``und``, and with one language
every text with a letter gets it; equal rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inputs import id_and_text

BITS = 12
WIDTH = 1 << BITS
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of hashed byte n-grams."""
    raw = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    out = np.zeros(WIDTH, np.float32)
    for n in (1, 2, 3):
        m = len(raw) - n + 1
        if m <= 0:
            break
        gram = np.full(m, n, np.uint32)
        for i in range(n):
            gram = (gram * np.uint32(0x01000193)) ^ raw[i : i + m]
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        out += np.bincount(gram, minlength=WIDTH).astype(np.float32)
    out = np.sqrt(out)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def separate(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear support vector machine for signs y: squared hinge loss, accelerated gradient steps."""
    data = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    rate = 1.0 / (4.0 + penalty)  # rows have length sqrt(2) at most
    w = np.zeros(data.shape[1], np.float32)
    ahead, t = w, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (data @ ahead))
        new = ahead - rate * (penalty * ahead - 2 * data.T @ (share * y * slack))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + ((t - 1) / t2) * (new - w), new, t2
    return w[:-1], float(w[-1])


@dataclass
class Model:
    families: list[list[str]]
    between: dict[tuple[int, int], tuple[np.ndarray, float]]
    within: dict[tuple[str, str], tuple[np.ndarray, float]]

    @staticmethod
    def _vote(x: np.ndarray, names: list, machines: dict) -> tuple:
        """The name with most duels won, the larger margins among equals, and how clear it is (0 to 1)."""
        if len(names) == 1:
            return names[0], 1.0
        won = {n: [0, 0.0] for n in names}
        for (a, b), (w, bias) in machines.items():
            if a in won and b in won:
                margin = float(x @ w) + bias
                won[a if margin > 0 else b][0] += 1
                won[a][1] += margin
                won[b][1] -= margin
        best = max(names, key=lambda n: won[n])
        least = min(abs(float(x @ w) + bias) for (a, b), (w, bias) in machines.items() if best in (a, b))
        return best, 1.0 / (1.0 + float(np.exp(-4.0 * least)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text) or not self.families:
            return UNKNOWN, 0.0
        x = features(text)
        family, a = self._vote(x, list(range(len(self.families))), self.between)
        name, b = self._vote(x, self.families[family], self.within)
        return name, a * b


def group_families(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Join the most alike groups of languages while they are more alike than pairs are on average."""
    names = sorted(means)
    alike = {(a, b): float(means[a] @ means[b] / (np.linalg.norm(means[a]) * np.linalg.norm(means[b]))) for a, b in combinations(names, 2)}
    groups = [[n] for n in names]
    if len(names) < 3:
        return groups if len(names) < 2 else [names]
    usual = float(np.mean(list(alike.values())))
    while len(groups) > 2:
        score = lambda p: np.mean([alike[min(a, b), max(a, b)] for a in p[0] for b in p[1]])
        pair = max(combinations(groups, 2), key=score)
        if score(pair) <= usual:
            break
        groups = [g for g in groups if g not in pair] + [sorted(pair[0] + pair[1])]
    return sorted(groups)


def train(labelled: DataFrame, rows_per_language: int = 300) -> Model:
    """Fit the model on labelled rows (doc_id, text, lang), bounded per language.

    The rows are chosen by a ranked filter that Spark also applies before the shuffle; the
    number of languages times the bound, times one vector, is what the driver receives.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.md5("text")))
    # the ids alone are ranked; texts are fetched for the chosen ones
    chosen = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_language)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[[has_letter(t) for t in frame["text"]]]
            yield pd.DataFrame({"lang": frame["lang"], "x": [features(t).tobytes() for t in frame["text"]]})

    found = chosen.select("lang", "text").mapInPandas(each, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    by = {lang: np.stack([np.frombuffer(b, np.float32) for b in part["x"]]) for lang, part in found.groupby("lang")}
    families = group_families({lang: x.mean(axis=0) for lang, x in by.items()})

    def duel(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        return separate(np.r_[a, b], np.r_[np.ones(len(a)), -np.ones(len(b))].astype(np.float32))

    whole = [np.concatenate([by[n] for n in f]) for f in families]
    between = {(i, j): duel(whole[i], whole[j]) for i, j in combinations(range(len(families)), 2)}
    within = {(a, b): duel(by[a], by[b]) for f in families for a, b in combinations(f, 2)}
    return Model(families, between, within)


def predict(texts: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score added; ``text_col`` alone is read for it."""
    sent = texts.sparkSession.sparkContext.broadcast(model)  # bounded: one vector for each pair of languages

    def each(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for part in series:
            yield pd.DataFrame([m.predict(t) for t in part], columns=["lang_pred", "score"])

    guess = F.pandas_udf(each, "lang_pred string, score double")
    return texts.withColumn("guess", guess(F.col(f"`{text_col}`").cast("string"))).select(*texts.columns, "guess.lang_pred", "guess.score")


def held_out(id_column: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 2 when divided by 4; a null id trains."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, rows_per_language: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; labels outside the held-out part train."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(base.where(~held_out(F.col("doc_id"))), rows_per_language)
    return predict(base.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
