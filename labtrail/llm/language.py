"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are the runs of 2, 3 and 4 letters inside its lower-cased
words, word borders included, hashed to ``BUCKETS`` rows of an embedding table.
Their average goes through a linear layer and a softmax.  Both layers are
trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows; part of that sample is held back to fit a temperature, so that the score
is a calibrated probability, and a threshold below which a text is rejected.

The sample is the only thing the driver holds: at most ``sample_rows`` rows of
hashed counts, drawn by a hash of the key from every language in proportion to
a count over all rows.  Prediction multiplies both layers once, which leaves a
table of BUCKETS x languages numbers, and scores every whole text in one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.llm.common import arrow_schema, row_batches

UNDETERMINED = "und"
BUCKETS = 1 << 14
DIMENSIONS = 16
SIZES = (2, 3, 4)
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 4000
#: Right answers of the rows held back that the threshold may reject.
MAY_REJECT = 0.001
#: And the highest score that it may reject.
HIGHEST_THRESHOLD = 0.4
#: Characters looked at in one step of a long text.
STEP = 1 << 20

PREDICTION = "lang_pred string, score double, rejected boolean"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's subwords, a step of the text at a time.  Nothing for a text without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kept = np.zeros(len(codes) + 2, np.uint32)
    kept[1:-1] = np.where(_letters()[codes], codes, 0)
    for at in range(0, len(kept), STEP):
        c = kept[at : at + STEP + max(SIZES) - 1]
        begins = min(STEP, len(kept) - at)
        found = []
        for n in SIZES:
            m = min(begins, len(c) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, 2166136261 + n, np.uint32)
            inner = np.ones(m, bool)
            for k in range(n):
                part = c[k : k + m]
                h = (h ^ part) * np.uint32(16777619)
                if 0 < k < n - 1:
                    inner &= part != 0
            # two borders alone, or a border and nothing of a word, say nothing
            if n == 2:
                inner = (c[:m] != 0) | (c[1 : m + 1] != 0)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            found.append((h >> np.uint32(32 - BUCKETS.bit_length() + 1))[inner])
        if found:
            yield np.concatenate(found)


def bucket_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in a text and how often each occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in subwords(text or ""):
        counts += np.bincount(part, minlength=BUCKETS)
    hit = np.flatnonzero(counts)
    return hit, counts[hit]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # both layers multiplied: a row for each bucket, a column for each language
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, buckets: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        rows = self.table[buckets]
        mean = rows.mean(0) if counts is None else counts @ rows / counts.sum()
        return mean + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        total, n = np.zeros(len(self.langs)), 0
        for part in subwords(text or ""):
            if len(part) > BUCKETS // 4:
                total += np.bincount(part, minlength=BUCKETS) @ self.table
            else:
                total += self.table[part].sum(0)
            n += len(part)
        if not n or not self.langs:
            return UNDETERMINED, 0.0, True
        p = softmax((total / n + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent over (language, buckets, counts); every fifth row calibrates instead."""
    langs = sorted({lang for lang, _, _ in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    kept = [(number[lang], b, (c / c.sum()).astype(np.float32)) for lang, b, c in rows if len(b)]
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out = np.zeros((DIMENSIONS, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    held = [r for k, r in enumerate(kept) if k % 5 == 4] or kept
    train = [r for k, r in enumerate(kept) if k % 5 != 4] or kept
    steps, done = epochs * max(1, len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            y, b, w = train[i]
            mean = w @ emb[b]
            g = softmax(mean @ out + bias)
            g[y] -= 1
            lr = np.float32(rate * (1 - done / steps))
            back = out @ g
            out -= lr * np.outer(mean, g)
            bias -= lr * g * 0.1
            # a bucket moves with its share of the text, scaled up as shares are small
            emb[b] -= lr * 20 * w[:, None] * back
            done += 1
    model = Model(langs, (emb @ out).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    if kept:
        z = np.array([model.logits(b, w) for _, b, w in held])
        y = np.array([y for y, _, _ in held])
        # smoothed targets keep a flawless sample from claiming certainty
        smooth = 1 / (len(held) + 2)
        target = np.full(z.shape, smooth / max(1, len(langs) - 1))
        target[np.arange(len(y)), y] = 1 - smooth
        loss = lambda t: -(target * np.log(softmax(z / t) + 1e-300)).sum()
        model.temperature = float(min(np.geomspace(0.02, 20, 61), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y]
        model.threshold = float(min(HIGHEST_THRESHOLD, np.quantile(right, MAY_REJECT))) if len(right) else HIGHEST_THRESHOLD
    return model


def learnable(key: Column) -> Column:
    """Rows a model may learn from: those not held out.  A null key is never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 != 0, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows with a label that may be learned from.

    Labels are counted over all rows; then a hash of the key draws about twice
    each label's quota, and the quota is taken in hash order.  Rare labels give
    all their rows.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y"))
    rows = rows.where(learnable(F.col("k")) & F.col("y").isNotNull() & F.col("t").isNotNull())
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(sample_rows).collect()}
    quota = max(1, sample_rows // max(1, len(counts)))
    draw = F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(None).cast("double")
    for lang, n in counts.items():
        share = F.when(F.col("y") == lang, F.lit(min(1.0, 2.0 * quota / n + 20 / n))).otherwise(share)
    drawn = rows.withColumn("u", draw).where(F.col("u") < share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [bucket_counts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([b.astype("<u2").tobytes() for b, _ in found], pa.binary()),
                pa.array([np.minimum(c, 2**31).astype("<u4").tobytes() for _, c in found], pa.binary()),
            ], names=["y", "u", "b", "c"])

    sample = drawn.select("y", "u", "t").mapInArrow(features, "y string, u double, b binary, c binary")
    first = F.row_number().over(Window.partitionBy("y").orderBy("u", "b"))
    sample = sample.withColumn("r", first).where(F.col("r") <= quota).orderBy("u", "y", "b").select("y", "b", "c")
    return fit([(r.y, np.frombuffer(r.b, "<u2"), np.frombuffer(r.c, "<u4")) for r in sample.collect()])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; columns of those names are replaced.

    A null text, or one without a letter, is ``und`` with score 0 and rejected,
    as is every text if nothing was learned.  Repeated rows stay; an empty
    table stays empty.  Very long texts are scored whole, a step at a time.
    """
    new = [f.name for f in arrow_schema(PREDICTION)]
    kept = docs.drop(*new)
    # the text goes to Python and back once; other columns pass through as they are
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [PREDICTION])
    at = kept.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            langs, scores, rejected = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names, *new],
            )

    return kept.mapInArrow(score, schema)
