"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics describe a text's shape - letters, signs, case, repetition, lines - and never its language, source or
id. Trees are grown on binned values with second-order gradients and flattened into arrays, which are walked for all
documents at once. Training takes at most ``max_rows`` labelled rows (those with the smallest hashed ids), so what the
driver gathers has a fixed bound; every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices

NAMES = [
    "log_words", "log_chars", "word_length", "word_length_spread", "long_words", "upper", "digit", "blank", "sentence_signs", "odd_signs", "other_ascii",
    "non_ascii", "distinct_words", "top_word", "repeated_neighbours", "distinct_pairs", "log_lines", "line_words", "repeated_lines", "words_ending_odd", "upper_words", "bare_words",
]

_CLASS = np.zeros((256, 7), np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b, 0 if _b >= 128 else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:?'\"-()" else 5 if _c in "!#$%&*+/<=>@[\\]^_`{|}~" else 6] = 1
_ODD = re.compile(rb"[!#$%&*+/<=>@\[\\\]^_`{|}~]$")


def statistics(text: str) -> list[float]:
    """The values of NAMES for one text; an empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    non_ascii, upper, digit, blank, signs, odd, other = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = np.fromiter((w[-1] for w in words), np.uint8, n)
    letters = max(1, int(size - digit - blank - signs - odd))
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.std(), (lengths > 18).mean(), upper / letters, digit / size, blank / size, signs / size, odd / size, other / size,
        non_ascii / size, len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, pairs / n, np.log1p(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        _CLASS[ends, 5].mean(), sum(map(bytes.isupper, words)) / n, sum(1 for w in words if len(w) == 1 and _CLASS[w[0], 5]) / n,
    ]


def statistics_table(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


@dataclass
class Trees:
    """Flattened trees: for node i of tree t, feature[t, i] (-1: a leaf), threshold, and value; children at 2i+1, 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All rows walk down all trees, one level at a time."""
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.feature.shape[1] + 1)) - 1
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                feature = f[at]
                inner = feature >= 0
                right = x[rows, np.maximum(feature, 0)] > t[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += v[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, leaf_rows: int = 10, ridge: float = 1.0) -> Trees:
    """Logistic loss. Without both labels the score is the labels' mean (a half if there are none)."""
    nodes = 2 ** (depth + 1) - 1
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    out = Trees(np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)), float(np.log(mean / (1 - mean))))
    if len(set(y.tolist())) < 2:
        return out
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)  # bin b: at most cut b
    n, features = binned.shape
    flat = binned + np.arange(features) * bins
    margin = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            rows = np.flatnonzero(at >= first)
            if not len(rows):
                break
            slot = ((at[rows] - first)[:, None] * features * bins + flat[rows]).ravel()
            shape = (width, features, bins)
            g, h, c = (np.bincount(slot, np.repeat(w, features), minlength=np.prod(shape)).reshape(shape) for w in (gradient[rows], weight[rows], np.ones(len(rows))))
            gl, hl, cl = (a.cumsum(axis=2) for a in (g, h, c))
            gt, ht, ct = (a[:, :, -1:] for a in (gl, hl, cl))
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(cl < leaf_rows) | (ct - cl < leaf_rows)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for node in range(width):
                f, b = divmod(int(best[node]), bins)
                if gain[node, f, b] > 1e-9 and b < len(cuts[f]):
                    i = first + node
                    out.feature[t, i], out.threshold[t, i] = f, cuts[f][b]
            feature = out.feature[t, at[rows]]
            split = rows[feature >= 0]
            at[split] = 2 * at[split] + 1 + (x[split, feature[feature >= 0]] > out.threshold[t, at[split]])
        total_g, total_h = np.bincount(at, gradient, nodes), np.bincount(at, weight, nodes)
        out.value[t] = -rate * total_g / (total_h + ridge)
        out.value[t][out.feature[t] >= 0] = 0
        margin += out.value[t][at]
    return out


def held_out(id_col: str):
    """Whether crc32 of the id's text leaves no remainder by five; a null id's text is empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Trees:
    """Fit on at most ``max_rows`` labelled rows that aren't held out. Labels other than 0 and 1 are left out."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 40))
    labelled = usable.agg(F.count("*")).first()[0]
    share = min(1.0, 2 * max_rows / max(labelled, 1))  # leaves little more than max_rows to be sorted, however many there are
    chosen = usable.where(place < int(share * (1 << 40))).groupBy("_id").agg(F.avg("_label").alias("_label")).orderBy(place, "_id").limit(max_rows)  # at most max_rows pairs: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_text", "_label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = statistics_table(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    found = rows.mapInArrow(measure, "id long, label double, x array<double>")
    once = found.groupBy("id").agg(F.min(F.struct("x", "label")).alias("r")).toPandas().sort_values("id")  # one row an id: within max_rows
    x = np.array([list(r[0]) for r in once["r"]], np.float64).reshape(len(once), len(NAMES))
    return fit(x, np.array([r[1] for r in once["r"]], np.float64).round(), **options)


def score(docs: DataFrame, model: Trees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; a null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = shared.value.probability(statistics_table(b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Trees, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()]
            yield b.filter(pa.array(shared.value.probability(statistics_table(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
