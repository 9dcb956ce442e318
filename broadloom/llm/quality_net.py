"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer
network with temperature-calibrated probabilities.

Word vectors come from all documents: every word (hashed into ``buckets`` rows) and every
word shape adds the sparse ternary index vectors of its neighbours to its row. The table of
rows has a fixed size, so partial tables are summed by Spark and the result is broadcast
whatever the corpus size. A document is the mean of its words' vectors beside the mean of
its shapes' vectors. The network is trained with numpy on at most ``sample`` labelled rows.

Defined cases: null or empty text has a zero vector and still a score; unlabelled rows and
rows whose label is neither 0 nor 1 are scored and not learnt from; rows that repeat a
doc_id are scored each; of several labels of one doc_id the smallest counts; a null doc_id
is scored, held_out false. Without labels of both kinds every score is the share of label 1
(0.5 without labels). Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadloom.llm.shared import fresh, texts
from broadloom.llm.tokens import U, WordHasher, mix, text_slices, window_hashes, word_spans

SHAPES = 512


def word_rows(data, bounds, hasher, buckets: int):
    """(word row, shape row, word hash, first word of each text) of a slice of texts."""
    starts, ends, ptr = word_spans(data, bounds)
    h = hasher(data, starts, ends, lower=True)

    def per_word(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends] - total[starts]

    upper = per_word((data >= 65) & (data <= 90))
    digit = per_word((data >= 48) & (data <= 57))
    letter = per_word(((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)) | (data >= 128))
    n = ends - starts
    other = n - digit - letter
    wide = window_hashes(h, 5)
    again = np.zeros(len(h), np.int64)  # is this word's 5-word window met earlier in the text?
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a > 5:
            part = wide[a : b - 4]
            _, first = np.unique(part, return_index=True)
            seen = np.ones(len(part), np.int64)
            seen[first] = 0
            again[a : b - 4] = seen
    length = np.minimum(np.log2(n).astype(np.int64), 4)
    shape = np.minimum(other, 3) + 4 * np.minimum(upper, 2) + 12 * np.minimum(digit, 1) + 24 * length + 120 * (letter == 0) + 240 * again
    return (h % U(buckets)).astype(np.int64), shape, h, ptr


def index_places(keys: np.ndarray, dims: int, nonzero: int):
    """The places and signs of the sparse ternary index vector of each key."""
    m = mix(keys * U(0x9E3779B97F4A7C15) + U(1))
    place = np.stack([((m >> U(12 * j)) % U(dims)).astype(np.int64) for j in range(nonzero)])
    sign = np.stack([1 - 2 * ((m >> U(60 - j)) & U(1)).astype(np.int64) for j in range(nonzero)])
    return place, sign


def word_table(docs: DataFrame, buckets: int, dims: int, nonzero: int, strip: int = 128) -> np.ndarray:
    """Summed context vectors, one row per bucket and shape; the last column counts words."""
    rows = buckets + SHAPES

    def gather(batches):
        hasher, total = WordHasher(), np.zeros((rows, dims + 1))
        for _, data, bounds in text_slices(batches, budget=1 << 19):
            word, shape, h, ptr = word_rows(data, bounds, hasher, buckets)
            if not len(h):
                continue
            joined = np.ones(len(h) - 1, bool)  # neighbours in one text
            cut = ptr[1:-1]
            joined[cut[(cut > 0) & (cut < len(h))] - 1] = False
            left = np.flatnonzero(joined)
            flat, value = [], []
            for row, key in ((word, h), (buckets + shape, shape.astype(np.uint64))):
                place, sign = index_places(key, dims, nonzero)
                for j in range(nonzero):
                    flat += [row[left] * (dims + 1) + place[j][left + 1], row[left + 1] * (dims + 1) + place[j][left]]
                    value += [sign[j][left + 1], sign[j][left]]
                flat.append(row * (dims + 1) + dims)
                value.append(np.ones(len(row)))
            total += np.bincount(np.concatenate(flat), weights=np.concatenate(value), minlength=total.size).reshape(total.shape)
        for at in range(0, rows, strip):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + strip].astype(np.float32).tobytes()], pa.binary())], names=["at", "part"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
                sums[at] = sums[at] + value if at in sums else value
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["at", "part"])

    parts = texts(docs).select("text").mapInArrow(gather, "at int, part binary").repartition("at").mapInArrow(add, "at int, part binary")
    out = np.zeros((rows, dims + 1))
    for r in parts.toLocalIterator():  # a table of fixed size
        out[r["at"] : r["at"] + strip] += np.frombuffer(r["part"], np.float64).reshape(-1, dims + 1)
    return out


def unit_vectors(table: np.ndarray, buckets: int, dims: int, nonzero: int) -> np.ndarray:
    """Rows scaled to length 1, frequent words damped; a shape keeps its own index vector
    beside its context so that shapes with like neighbours stay apart."""
    ctx, n = table[:, :dims], table[:, dims]
    unit = ctx / np.maximum(1e-9, np.linalg.norm(ctx, axis=1, keepdims=True))
    share = n[:buckets] / max(1.0, n[:buckets].sum())
    unit[:buckets] *= (1e-3 / (1e-3 + share))[:, None]
    own = np.zeros((SHAPES, dims))
    place, sign = index_places(np.arange(SHAPES, dtype=np.uint64), dims, nonzero)
    for j in range(nonzero):
        np.add.at(own, (np.arange(SHAPES), place[j]), sign[j])
    unit[buckets:] = 0.3 * unit[buckets:] + own
    return unit.astype(np.float32)


def pooled(batches, vectors: np.ndarray, buckets: int):
    """(rows, document vectors) of Arrow batches."""
    hasher, dims = WordHasher(), vectors.shape[1]
    for rows, data, bounds in text_slices(batches, budget=1 << 19):
        word, shape, _, ptr = word_rows(data, bounds, hasher, buckets)
        n = np.diff(ptr)
        out = np.zeros((len(n), 2 * dims + 2), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            for at, row in ((0, word), (dims, buckets + shape)):
                out[full, at : at + dims] = np.add.reduceat(vectors[row], ptr[:-1][full], axis=0) / n[full, None]
        out[:, -2] = np.log1p(n) / 5
        out[:, -1] = n == 0
        yield rows, out


class TwoLayerNet:
    """Dense, ReLU, dense, sigmoid; trained by Adam; probabilities divided by a temperature."""

    def __init__(self, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> None:
        self.hidden, self.epochs, self.rate, self.decay, self.seed = hidden, epochs, rate, decay, seed
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> TwoLayerNet:
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        order = rng.permutation(len(y))
        check, train = order[: len(y) // 8], order[len(y) // 8 :]
        p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, step, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, (np.inf, p)
        for _ in range(self.epochs):
            for part in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
                h = np.maximum(0, z[part] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(d, p[2]) * (h > 0)
                step += 1
                for k, g in enumerate((z[part].T @ back + self.decay * p[0], back.sum(0), h.T @ d + self.decay * p[2], d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - self.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            self.p = p
            if len(check) and (loss := self._loss(self.logits(x[check]), y[check])) < best[0]:
                best = (loss, [a.copy() for a in p])
        if len(check):
            self.p = best[1]
            raw = self.logits(x[check])
            self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: self._loss(raw / t, y[check]))
        return self

    @staticmethod
    def _loss(logit: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(0, z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def held_out(folds: int, rest: int):
    """crc32 of the decimal doc_id leaves ``rest`` modulo ``folds``; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(folds)) == rest, F.lit(False))


def sampled_labels(labels: DataFrame, kind: str, folds: int, rest: int, sample: int) -> DataFrame:
    """At most about ``sample`` labelled ids outside the held-out fold, chosen by a hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(kind).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(folds, rest))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    n = known.count()
    limit = int(min(1.0, sample / max(1, n)) * 1_000_000)
    return known.filter(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1_000_000)) < limit)


def with_scores(docs: DataFrame, labels: DataFrame, column: str, sample: int = 20_000, buckets: int = 1 << 13, dims: int = 48, nonzero: int = 4) -> DataFrame:
    """All rows and columns, and the score in ``column``; texts are not shuffled."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(unit_vectors(word_table(docs, buckets, dims, nonzero), buckets, dims, nonzero))

    def features(batches):
        for rows, x in pooled(batches, vectors.value, buckets):
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("y")), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    chosen = sampled_labels(labels, "quality", 5, 0, sample)
    got = texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "y").mapInArrow(features, "y int, x binary").collect()  # about ``sample`` rows
    got.sort(key=lambda r: (r["y"], r["x"]))  # one order, so one net, however the rows are dealt
    y = np.array([r["y"] for r in got], float)
    if len(set(y)) == 2:
        model = TwoLayerNet().fit(np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(float), y)
    else:
        prior = float(y.mean()) if len(y) else 0.5
        model = lambda x: np.full(len(x), prior)

    def score(batches):
        for rows, x in pooled(batches, vectors.value, buckets):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model(x.astype(float)))], names=[*rows.schema.names, column])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted, a row per row."""
    scored = with_scores(texts(docs), labels, "score", **options)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **options) -> DataFrame:
    """The rows that score ``cut`` or more; all columns stay."""
    score = fresh("score")
    return with_scores(docs, labels, score, **options).filter(F.col(score) >= cut).drop(score)
