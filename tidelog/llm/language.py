"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of other characters than letters become one space, and all 2- and 3-grams of the whole text are
hashed into 2**BITS features. Document frequencies come from all training documents. The weights are learned by
follow-the-regularised-leader with elastic net (FTRL-proximal, per-coordinate rates) on a bounded sample of labelled rows,
chosen by a hash of the id, SAMPLE_PER_LANGUAGE of each language and SAMPLE_ROWS in all at most; one scale for the scores (a temperature) is then
fitted on a part of the sample that the weights don't see. The same part tells how much evidence (the best language's score before
the softmax) a text of a learned language has; a text with far less is of none of them, however the softmax shares it out.

Training documents are those with a label whose crc32(id as text) mod 4 isn't 2. Null texts and texts without letters get
`und` with score 0; so does everything if there is nothing to learn from. A null id is neither held out nor learned from.
Texts are read whole, however long. Rows map one to one, so repeated rows get equal predictions; of equal scores the first
language by name wins. Other columns stay as they are, unless they have the name of a result. An empty table gives no rows.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

BITS = 14
#: Labelled rows to learn from, about: of each language, and of all together (a row's features take 100 KB at most).
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 1500, 6000
#: Share of the sample that only the temperature is fitted on.
CALIBRATION_SHARE = 5
#: FTRL: learning rate, its smoothing, L1, L2, passes, rows of a step.
ALPHA, BETA, L1, L2, PASSES, STEP = 0.5, 1.0, 0.02, 0.5, 4, 32
UNKNOWN = "und"
#: A text is recognised with this share of the evidence that all but a hundredth of the calibration's texts have.
LEAST_EVIDENCE = 0.2


@cache
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature numbers, counts) of a whole text, or None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first other character after a letter stands for its run
    p = np.where(is_letter, points, np.uint32(32))[keep]
    if not is_letter.any():
        return None
    p = np.concatenate([[np.uint32(32)], p, [np.uint32(32)]]).astype(np.uint32)
    two = p[:-1] * np.uint32(0x9E3779B1) + p[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + p[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    both = np.concatenate([two, three])
    both ^= both >> np.uint32(15)
    counts = np.bincount((both * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found.astype(np.uint16), counts[found]


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # float32, features x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    evidence: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether the text has the evidence of a learned language)."""
        got = features(text)
        if got is None or not self.languages:
            return UNKNOWN, 0.0, False
        logits = weighed(*got, self.idf) @ self.weights[got[0]] + self.bias
        p = softmax(logits[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(logits[best] >= self.evidence)


def weighed(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[found]
    return (x / max(np.sqrt(x @ x), 1e-12)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with features, and how many of them have each feature."""

    def run(batches):
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if (got := features(text.as_py())) is not None:
                    total[got[0]] += 1
                    total[-1] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["feature", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for feature, n in train.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        out[feature] = n
    return int(out[-1]), out[:-1]


def sample(train: DataFrame, per_language: int) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(order, language, features, counts) of about per_language rows of each language, by a hash of the id."""
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    per_language = min(per_language, max(1, SAMPLE_ROWS // len(sizes)))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])[F.col("lang")]
    rows = train.where(order.cast("double") / 2.0**64 + 0.5 <= share).select(order.alias("order"), "lang", "text")

    def run(batches):
        for batch in batches:
            got = [(o, lang, f) for o, lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (f := features(t)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2][0].tobytes() for g in got], pa.binary()), pa.array([g[2][1].astype(np.uint32).tobytes() for g in got], pa.binary())],
                names=["order", "lang", "found", "counts"],
            )

    found = rows.mapInArrow(run, "order long, lang string, found binary, counts binary").toArrow().sort_by([("order", "ascending"), ("lang", "ascending"), ("found", "ascending")])
    return [(o, lang, np.frombuffer(f, np.uint16), np.frombuffer(c, np.uint32)) for o, lang, f, c in zip(*(c.to_pylist() for c in found.columns), strict=True)]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from (features, values, class) by FTRL-proximal with elastic net; the bias isn't penalised."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, n_classes)), np.zeros((size, n_classes))
    penalty = np.full((size, 1), L1)
    penalty[-1] = 0

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * penalty[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= penalty[at], 0, w)

    for turn in range(PASSES):
        order = np.random.default_rng(turn).permutation(len(rows))
        for b in range(0, len(rows), STEP):
            batch = [rows[i] for i in order[b : b + STEP]]
            at, back = np.unique(np.concatenate([r[0].astype(np.int64) for r in batch] + [[size - 1]]), return_inverse=True)
            x = np.zeros((len(batch), len(at)))
            row = np.repeat(np.arange(len(batch)), [len(r[0]) for r in batch])
            x[row, back[:-1]] = np.concatenate([r[1] for r in batch])
            x[:, -1] = 1
            w = weights(at)
            p = softmax(x @ w)
            p[np.arange(len(batch)), [r[2] for r in batch]] -= 1
            g = x.T @ p
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), w[-1]


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The scale of least log loss, by golden section over its logarithm."""
    if not len(classes):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(classes)), classes], 1e-12)).mean()
    a, b, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    lean(docs.sparkSession)
    rows = training_rows(docs)
    n, df = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    got = sample(rows, per_language)
    languages = sorted({r[1] for r in got})
    data = [(f, weighed(f, c, idf), languages.index(lang)) for _, lang, f, c in got]
    learn = [d for r, d in zip(got, data, strict=True) if r[0] % CALIBRATION_SHARE]
    check = [d for r, d in zip(got, data, strict=True) if not r[0] % CALIBRATION_SHARE]
    w, bias = ftrl(learn or data, len(languages)) if data else (np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    logits = np.array([x @ w[f] + bias for f, x, _ in check]).reshape(len(check), len(languages))
    evidence = LEAST_EVIDENCE * float(np.quantile(logits.max(1), 0.01)) if logits.size else -np.inf
    return Model(languages, w, bias, idf, temperature(logits, np.array([c for *_, c in check], int)), evidence)


def predict(docs: DataFrame, model: Model, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, and the language, the score and, by a third name, whether the language is recognised.

    Columns of docs that have one of the names are replaced.
    """
    lean(docs.sparkSession)
    rows = docs.drop(*names)
    kept, given = rows.columns, docs.sparkSession.sparkContext.broadcast(model)
    at = [n.lower() for n in kept].index("text")

    def run(batches):
        for batch in batches:
            got = [given.value.predict(t.as_py()) for t in batch.column(at)]
            told = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())[: len(names)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*kept, *names])

    empty = [F.lit(v).alias(n) for v, n in zip(("", 0.0, False), names)]  # noqa: B905
    return rows.mapInArrow(run, rows.select("*", *empty).schema)


def language_report(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    model = train(docs.select("doc_id", "text", "lang"), per_language)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
