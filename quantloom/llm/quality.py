"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

Units of a text: its words (runs of non-space characters, case kept), the character n-grams of each word
with its boundaries, and pairs of neighbouring words (a repeated word is one unit, whatever the word).
Units are hashed to rows of an embedding table; a document is the mean of its units' vectors; a softmax
layer gives the probability of label 1.

Training takes at most `rows` labelled documents (TRAIN_ROWS by default; the smallest hashes of doc_id, so
the choice agrees between runs): a bounded sample, fitted in one task on an executor, so that the driver
holds neither texts nor embeddings. Scoring covers every whole text: one narrow mapInArrow pass. The output
layer is linear in the mean, so each row of the table is projected to its one logit first (as many numbers
as there are buckets, which bounds the broadcast), and a worker remembers hash and sum of logits of the
words it has met, for at most `WORDS_HELD` words at a time.

Defined results: a null or empty text has no units and scores 0.5; repeated rows give repeated results;
without labelled rows of both labels every score is 0.5; null labels are not learned from; rows of labels
for one document count once, with their largest label; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import read_table, texts, trimmed

BUCKETS, DIM, NGRAMS = 1 << 18, 16, (2, 3, 4, 5)
#: The most labelled documents that training takes.
TRAIN_ROWS, EPOCHS, RATE, SEED = 4096, 6, 0.6, 7
WORDS_HELD = 200_000
#: The bucket of all repeated words, and how many units each weighs.
REPEATED, REPEAT_UNITS = 0, 8
BASE = np.uint64(0x100000001B3)
CHUNK = 256
PASS = 0.7


def word_units(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of every unit: of each word and of its character n-grams."""
    held = [b"<" + word + b">" for word in words]
    data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(held)), lengths)
    place = np.arange(len(data)) - starts[owner]
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), BASE))  # wraps around
    which, hashes = [np.arange(len(held))], [np.add.reduceat(data * powers[place], starts) if len(held) else np.zeros(0, np.uint64)]
    for n in NGRAMS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        rolled = np.full(size, np.uint64(n))
        for j in range(n):
            rolled = rolled * BASE + data[j : j + size]
        inside = owner[:size] == owner[n - 1 :]
        which.append(owner[:size][inside])
        hashes.append(rolled[inside])
    mixed = np.concatenate(hashes) * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate(which), ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def pair_buckets(hashes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Buckets of pairs of neighbouring words, from their hashes; a repeated word has one bucket whatever it is."""
    mixed = (hashes * BASE + after) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(hashes == after, REPEATED, ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64))


def pair_weights(buckets: np.ndarray) -> np.ndarray:
    return np.where(buckets == REPEATED, float(REPEAT_UNITS), 1.0)


def document_units(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of its units that fall to each."""
    words = (text or "").encode().split()
    counted = Counter(words)
    which, buckets = word_units(list(counted))
    weights = np.fromiter(counted.values(), float, len(counted))[which]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = pair_buckets(hashes[:-1], hashes[1:])
    ids, inverse = np.unique(np.concatenate([buckets, pairs]), return_inverse=True)
    shares = np.bincount(inverse, np.concatenate([weights, pair_weights(pairs)]), len(ids))
    return ids, shares / max(shares.sum(), 1)


class Projected:
    """A trained model as scoring needs it: one logit for each bucket."""

    def __init__(self, logits: np.ndarray):
        self._logits = logits

    def logits(self) -> np.ndarray:
        return self._logits


class Model:
    """table: vectors of the buckets; out: two rows of weights."""

    def __init__(self, table: np.ndarray, out: np.ndarray):
        self.table, self.out = table, out

    def logits(self) -> np.ndarray:
        """The log-odds of label 1 that each bucket alone would give."""
        return self.table.astype(float) @ (self.out[1] - self.out[0])


def train(samples: Iterable[tuple[str | None, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Plain SGD over one document at a time, with a rate that falls linearly to 0."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM))
    ids_, shares, ends, labels = array("i"), array("f"), [0], []  # one piece of memory each, which goes back at once
    for text, label in samples:
        ids, share = document_units(text)
        if len(ids):
            ids_.frombytes(ids.astype(np.int32).tobytes())
            shares.frombytes(share.astype(np.float32).tobytes())
            ends.append(len(ids_))
            labels.append(int(label))
    if len(set(labels)) < 2:
        return Model(table, out)
    all_ids, all_shares = np.frombuffer(ids_, np.int32), np.frombuffer(shares, np.float32)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for k in rng.permutation(len(labels)):
            ids, share, label = all_ids[ends[k] : ends[k + 1]], all_shares[ends[k] : ends[k + 1]], labels[k]
            now = rate * (1 - done / steps)
            mean = share @ table[ids]
            z = out @ mean
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ out
            out -= now * np.outer(error, mean)
            table[ids] -= np.outer(share * (min(len(ids), 32) * now), back).astype(np.float32)  # a mean's gradient is thin
            done += 1
    return Model(table, out)


def labelled_sample(docs: DataFrame, labels: DataFrame, learnable: Column, label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, label of at most `rows` documents; learnable: a condition on the doc_id of labels."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(learnable)
    chosen = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = texts(docs).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))  # rows of a repeated doc_id are one


def train_on_executor(sample: DataFrame) -> Projected:
    """Trains in one task, so that neither texts nor embeddings are held by the driver; only the logits come back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        got.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1] or ""))
        model = train((text, label) for _, text, label in got)
        yield pa.RecordBatch.from_arrays([pa.array([model.logits().tobytes()], pa.binary())], ["logits"])

    row = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(trimmed(run), "logits binary").first()  # a bounded sample
    return Projected(np.frombuffer(row["logits"]) if row else np.zeros(BUCKETS))


class Scorer:
    """Scores texts; remembers the hash, the sum of logits and the number of units of the words it has met."""

    def __init__(self, logits: np.ndarray):
        self.logits = logits
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.hashes, self.sums, self.counts = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        if len(self.numbers) > WORDS_HELD:
            self._forget()
        new = list(set(words).difference(self.numbers))
        if not new:
            return
        which, buckets = word_units(new)
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.hashes = np.append(self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)))
        self.sums = np.append(self.sums, np.bincount(which, self.logits[buckets], len(new)))
        self.counts = np.append(self.counts, np.bincount(which, minlength=len(new)))

    def scores(self, texts_: list[str | None]) -> list[float]:
        split = [(text or "").encode().split() for text in texts_]
        words = list(itertools.chain.from_iterable(split))
        self._learn(words)
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(split)), np.fromiter(map(len, split), np.int64, len(split)))
        z, n = np.bincount(doc, self.sums[at], len(split)), np.bincount(doc, self.counts[at], len(split))
        own, same = self.hashes[at], doc[:-1] == doc[1:]
        pairs, doc = pair_buckets(own[:-1][same], own[1:][same]), doc[1:][same]
        weights = pair_weights(pairs)
        z, n = z + np.bincount(doc, weights * self.logits[pairs], len(split)), n + np.bincount(doc, weights, len(split))
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z / np.maximum(n, 1), -50, 50))), 0.5).tolist()


def score_documents(frame: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability of label 1) of every row."""
    shared = frame.sparkSession.sparkContext.broadcast(model.logits())  # BUCKETS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                ids, own = batch.slice(start, CHUNK).columns
                yield pa.RecordBatch.from_arrays([ids, pa.array(scorer.scores(own.to_pylist()), pa.float64())], ["doc_id", "score"])

    return texts(frame, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, score double")


def keep_quality(frame: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of frame, with all their columns, whose score is at least threshold."""
    shared = frame.sparkSession.sparkContext.broadcast(model.logits())  # BUCKETS numbers
    at = frame.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                yield part.filter(pa.array([score >= threshold for score in scorer.scores(part.column(at).to_pylist())], pa.bool_()))

    return frame.mapInArrow(trimmed(run), frame.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Projected:
    return train_on_executor(labelled_sample(docs, labels, ~held_out(F.col("doc_id"))))


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= PASS, 1).otherwise(0).alias("predicted"))


QUERIES = {"op5_quality_scores": op5_quality_scores}
ORACLE_SQL: dict[str, str] = {}
