"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every token has a sparse ternary index vector that its hash fixes. A token's word vector adds to it the
index vectors of its neighbours in a sample; a document is the mean of its word vectors, where a word that
repeats the one before counts as a token `<again>` too. The network is
numpy, and its logits are divided by a temperature fitted on rows that it did not learn from.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, free_name, given_back

#: Bounds of what is learned from: labelled rows for the network, texts (and their bytes) for word vectors.
TRAIN_ROWS = 20_000
WORD_TEXTS = 1_500
WORD_TEXT_BYTES = 20_000
VOCABULARY = 20_000
DIMENSIONS = 96
NONZERO = 6
REACH = 2
HIDDEN = 24
EPOCHS = 40
THRESHOLD = 0.3
MEMO_TOKENS = 200_000

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    """What stands for a token outside the vocabulary."""
    if token.isdigit():
        return "<digits>"
    if not token[0].isalpha():
        return f"<sign{min(len(token), 4)}>"
    kind = "upper" if token.isupper() and len(token) > 1 else "title" if token[0].isupper() else "lower" if token.islower() else "mixed"
    return f"<{kind}{min(len(token) // 4, 4)}>"


def index_vector(token: str) -> np.ndarray:
    """NONZERO places of DIMENSIONS, half +1 and half -1, drawn from the token's hash."""
    rng = np.random.default_rng(zlib.crc32(token.encode()) | len(token) << 32)
    out = np.zeros(DIMENSIONS, np.float32)
    out[rng.choice(DIMENSIONS, NONZERO, replace=False)] = np.where(np.arange(NONZERO) % 2, 1.0, -1.0)
    return out


def repeats(line: list[str], is_word: np.ndarray) -> np.ndarray:
    """True for words that repeat the word before, with at most one other token between."""
    key = np.fromiter(map(hash, line), np.int64, len(line))
    out = np.zeros(len(line), bool)
    for d in (1, 2):
        out[d:] |= (key[d:] == key[:-d]) & is_word[d:]
    return out


@dataclass
class WordVectors:
    number: dict[str, int]
    vectors: np.ndarray
    is_word: np.ndarray

    @staticmethod
    def learn(texts: list[str]) -> WordVectors:
        tokens = [TOKEN.findall(t) for t in texts]
        counts = Counter(t for line in tokens for t in line)
        kept = [t for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n > 1][:VOCABULARY]
        names = kept + sorted({"<none>", *(shape(t) for t in counts), *(f"<{k}{n}>" for k in ("upper", "title", "lower", "mixed") for n in range(5)), *(f"<sign{n}>" for n in range(1, 5)), "<digits>", "<again>"})
        number = {t: k for k, t in enumerate(names)}
        index = np.array([index_vector(t) for t in names], np.float32)
        index[number["<none>"]] = 0
        context = np.zeros((len(names), DIMENSIONS), np.float64)
        for line in tokens:
            ids = np.array([number[t] if t in number else number[shape(t)] for t in line], np.int64)
            for d in range(1, REACH + 1):
                if len(ids) > d:
                    pair, n = np.unique(ids[d:] * len(names) + ids[:-d], return_counts=True)
                    here, there = np.divmod(pair, len(names))
                    np.add.at(context, here, index[there] * n[:, None])
                    np.add.at(context, there, index[here] * n[:, None])
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        vectors = index / np.sqrt(NONZERO) + np.divide(context, norm, out=np.zeros_like(context), where=norm > 0)
        is_word = np.array([t[0].isalpha() or t.startswith(("<upper", "<title", "<lower", "<mixed")) for t in names])
        return WordVectors(number, vectors.astype(np.float32), is_word)

    def pooled(self, texts: list[str | None], memo: dict[str, int]) -> np.ndarray:
        """Mean word vector of each whole text; zeros without tokens. memo: numbers of tokens seen."""
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        if len(memo) > MEMO_TOKENS:
            memo.clear()
        for k, text in enumerate(texts):
            line = TOKEN.findall(text or "")
            if not line:
                continue
            for t in set(line):
                if t not in memo:
                    memo[t] = self.number[t] if t in self.number else self.number.get(shape(t), self.number["<none>"])
            ids = np.fromiter(map(memo.__getitem__, line), np.int64, len(line))
            again = int(repeats(line, self.is_word[ids]).sum())
            total = again * self.vectors[self.number["<again>"]].astype(np.float64)
            for a in range(0, len(ids), 1 << 16):
                total += self.vectors[ids[a : a + (1 << 16)]].sum(axis=0)
            out[k] = total / (len(ids) + again)
        return out


@dataclass
class Network:
    """Logits of a hidden layer of tanh units over standardised features, over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 7) -> Network:
        """Adam on the cross entropy of rows not held; the temperature is the best of a grid on held rows."""
        x, y = x.astype(np.float64), y.astype(np.float64)
        if not len(y) or y.min() == y.max():
            rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
            return Network(np.zeros(DIMENSIONS), np.ones(DIMENSIONS), np.zeros((DIMENSIONS, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))))
        train = ~held if (~held).any() else np.ones(len(y), bool)
        rng = np.random.default_rng(seed)
        net = Network(x[train].mean(axis=0), x[train].std(axis=0) + 1e-3, rng.normal(0, DIMENSIONS**-0.5, (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
        z, t = (x[train] - net.mean) / net.scale, y[train]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
        step, batch = 0, 64
        for epoch in range(EPOCHS):
            order = rng.permutation(len(t))
            rate = 0.004 * (1 - epoch / EPOCHS) + 0.0002
            for a in range(0, len(t), batch):
                rows = order[a : a + batch]
                h = np.tanh(z[rows] @ net.w1 + net.b1)
                error = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -60, 60))) - t[rows]) / len(rows)
                back = np.outer(error, net.w2) * (1 - h * h)
                grads = (z[rows].T @ back + 1e-4 * net.w1, back.sum(axis=0), h.T @ error + 1e-4 * net.w2, np.array([error.sum()]))
                step += 1
                for k, g in enumerate(grads):
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    if k == 0:
                        net.w1 -= d
                    elif k == 1:
                        net.b1 -= d
                    elif k == 2:
                        net.w2 -= d
                    else:
                        net.b2 -= float(d[0])
        judge = held if held.any() else train
        raw = net.logits(x[judge])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        loss = [np.mean(np.logaddexp(0, np.where(y[judge] > 0, -raw, raw) / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
        return net


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _pool(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            pooled = words.value.pooled([x.as_py() for x in batch.column(3)], memo)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in pooled], pa.binary())], names=["doc_id", "quality", "fold", "vector"])

    return run


def learn(documents: DataFrame, labels: DataFrame) -> tuple[WordVectors, Network]:
    """Word vectors and network from at most about TRAIN_ROWS labelled rows with fold not 0.

    The rows are drawn by a hash of their id at a rate that follows from the number of labels, so the
    sample has the same size and make-up whatever the input. A document with several labels counts by their
    least, one with several rows by one of them.
    """
    spark = documents.sparkSession
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    usable = usable.filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = usable.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rate = lambda n: int(min(1.0, n / max(1, total)) * (1 << 30))
    sample = usable.filter(draw < rate(TRAIN_ROWS)).withColumn("words", draw < rate(WORD_TEXTS)).withColumn("fold", fold(F.col("doc_id")))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most about TRAIN_ROWS rows of two numbers.
    joined = docs.join(F.broadcast(sample), "doc_id")
    texts = joined.filter(F.col("words") & (F.octet_length("text") <= WORD_TEXT_BYTES)).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    words = WordVectors.learn([r.text for r in sorted(texts, key=lambda r: (r.doc_id, r.text))])
    pooled = joined.select("doc_id", "quality", "fold", "text").mapInArrow(_pool(spark.sparkContext.broadcast(words)), "doc_id bigint, quality int, fold bigint, vector binary")
    rows = pooled.groupBy("doc_id", "quality", "fold").agg(F.min("vector").alias("vector")).collect()
    rows = sorted(rows, key=lambda r: (r.vector, r.quality))
    x = np.array([np.frombuffer(r.vector, np.float32) for r in rows]).reshape(-1, DIMENSIONS)
    return words, Network.fit(x, np.array([r.quality for r in rows], np.float64), np.array([r.fold == 1 for r in rows], bool))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = model.value
        memo: dict[str, int] = {}
        for batch in batches:
            scores: list[float] = []
            part: list[str | None] = []
            size = 0
            for k, x in enumerate(batch.column(2)):
                part.append(x.as_py())
                size += len(part[-1] or "")
                if size >= PIECE_BYTES or k == len(batch) - 1:
                    scores += net.probability(words.pooled(part, memo)).tolist()
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null, empty and token-free texts have the score of the zero vector. Labels other than 0 and 1, of null
    ids, and of ids that are not in documents teach nothing; with labels of one kind or none the score is
    their rate, or a half. A null doc_id is not held out. Repeated rows each have their row. Empty table: no
    rows. Other columns are ignored.
    """
    model = documents.sparkSession.sparkContext.broadcast(learn(documents, labels))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(_score(model), "doc_id bigint, held_out boolean, score double, predicted int")


def _passes(model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = model.value
        memo: dict[str, int] = {}
        for batch in batches:
            at = batch.schema.get_field_index(column)
            good = []
            for a in range(0, len(batch), 256):
                part = [x.as_py() for x in batch.column(at).slice(a, 256)]
                good += (net.probability(words.pooled(part, memo)) >= THRESHOLD).tolist()
            yield batch.filter(pa.array(good, pa.bool_())).drop_columns([column])

    return given_back(run)


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those whose score is below THRESHOLD; all their columns stay."""
    model = documents.sparkSession.sparkContext.broadcast(learn(documents, labels))
    column = free_name(documents, "judged")
    return documents.withColumn(column, F.col("text").cast("string")).mapInArrow(_passes(model, column), documents.schema)
