"""Quality rules: a calibrated logistic regression on hashed words and character n-grams.

Every text is counted by fixed rules (words, symbols, repeated lines and
5-word windows; see BASE). The model sees the share of each hashed word and
each hashed run of 3 and 4 UTF-8 bytes. It is fitted on at most `SAMPLE`
labelled rows of either class, chosen by a hash of doc_id (a documented bound;
scoring and counting take every row and whole texts), calibrated on a fifth of
them by a logistic curve, and applied in Arrow batches: a row that passes the
rules is kept unless the calibrated probability of low quality exceeds REJECT.

Nulls: a null text has no words and fails the rules; labels of null quality or
doc_id are passed over. Without labelled rows of both classes the rules decide
alone. Repeated rows are judged alike. An empty table gives no row. Further
columns are kept by `keep_quality` and passed by otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, clean_text, lean, table

SAMPLE, REJECT, BITS = 700, 0.8, 16
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
WINDOW = 5
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of 5 words found at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    # each place of the window stirs its word in its own way, so that order counts
    h ^= h >> np.uint64(31)
    sums = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        sums += h[j : j + n] * _MULT[j]
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(found), 1)
    np.add.at(cover, np.flatnonzero(found) + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base(text: str) -> tuple[int, int, int, int, int, bool]:
    """BASE: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    again = repeated_words(words)
    return len(words), chars, symbols, repeated_lines(data), again, len(words) < 10 or 100 * again > 20 * len(words)


def buckets(text: str) -> list[np.ndarray]:
    """Hashed features of a text, a list for words, 3-grams and 4-grams of bytes; equal features repeat."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    out = [np.fromiter(map(crc32, words), np.uint32, len(words)) >> np.uint32(32 - BITS)]
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    for n in (3, 4):
        m = max(0, len(b) - n + 1)
        h = np.zeros(m, np.uint32)
        for j in range(n):
            h = h * np.uint32(257) + b[j : j + m]
        out.append((h * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return out


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # (3, 2**BITS)
    scale: float = 1.0
    shift: float = 0.0

    def logit(self, text: str) -> float:
        return self.bias + sum(float(w[k].mean()) for w, k in zip(self.weights, buckets(text), strict=True) if len(k))

    def low(self, text: str) -> float:
        """The calibrated probability that `text` is of low quality."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logit(text) + self.shift, -60, 60)))


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, share) of every feature of `texts`."""
    row, feature, share = [], [], []
    for i, t in enumerate(texts):
        for g, k in enumerate(buckets(t)):
            u, n = np.unique(k, return_counts=True)
            row.append(np.full(len(u), i))
            feature.append(u.astype(np.int64) + (g << BITS))
            share.append(n / max(1, len(k)))
    return np.concatenate(row), np.concatenate(feature), np.concatenate(share)


def fit(texts: list[str], low: list[int], rounds: int = 80, rate: float = 0.5, l2: float = 1e-4) -> Model | None:
    """Full-batch Adam on four fifths, Platt's curve on the rest; None without both classes."""
    y = np.array(low, float)
    held = np.arange(len(y)) % 5 == 4
    if len(set(low)) < 2 or len(set(y[~held])) < 2:
        return None
    row, feature, share = _rows([t for t, h in zip(texts, held, strict=True) if not h])
    target, used = y[~held], np.unique(feature)
    at = np.searchsorted(used, feature)
    balance = np.where(target > 0, 0.5 / target.mean(), 0.5 / (1 - target.mean())) / len(target)
    w, bias = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[at] * share, len(target)) + bias
        slip = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) * balance
        g = np.bincount(at, slip[row] * share, len(used)) + l2 * w / len(used)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        gb = slip.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        bias -= 0.1 * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    whole = np.zeros(3 << BITS)
    whole[used] = w
    model = Model(bias, whole.reshape(3, -1).astype(np.float32))
    model.scale, model.shift = _platt(np.array([model.logit(t) for t, h in zip(texts, held, strict=True) if h]), y[held])
    return model


def _platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift of the logit, by damped Newton steps with Platt's softened targets."""
    if len(set(y)) < 2:
        return 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, a = np.stack([z, np.ones_like(z)]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -60, 60)))
        hess = (x * (p * (1 - p))) @ x.T + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, x @ (p - t) + 0.1 * (a - np.array([1.0, 0.0])))
        a = a - step / max(1.0, float(np.abs(step).max()) / 0.5)
    return max(1e-3, float(a[0])), float(a[1])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model from at most `sample` labelled rows of either class, in a fixed order."""
    order = F.xxhash64("doc_id")
    known = labels.where("doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    parts = [known.where(F.col("quality") == q).groupBy("doc_id", "quality").count().orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "quality")
    rows = documents.select("doc_id", clean_text("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = sorted({(r.doc_id, r.quality, r.text) for r in rows.orderBy(order, "doc_id").limit(2 * sample).collect()}, key=lambda r: crc32(str(r[0]).encode()))
    return fit([r[2] for r in rows], [1 - r[1] for r in rows])


def kept(text: str, failed: bool, model: Model | None, reject: float) -> bool:
    return not failed and (model is None or model.low(text) <= reject)


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge_quality(docs: DataFrame, model: Model | None, reject: float = REJECT) -> DataFrame:
    """The counts and the verdict of every row of `docs`."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = base(t or "")
                rows.append((d, *found, kept(t or "", found[-1], model, reject)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in JUDGED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(lean(run), JUDGED)


def keep_quality(docs: DataFrame, model: Model | None, reject: float = REJECT) -> DataFrame:
    """The rows of `docs` that are kept; all columns stay."""
    arrow_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [kept(t or "", base(t or "")[-1], model, reject) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, train(docs, table(spark, sf_dir, "labels")))
