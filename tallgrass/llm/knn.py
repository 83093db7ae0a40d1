"""Quality by nearest-neighbour voting in a latent semantic space.

Texts become log-scaled, idf-weighted counts of hashed byte trigrams. A truncated SVD,
fitted on a bounded sample of labelled documents, gives the space; the sample's vectors
and labels are broadcast. Every document is compared with all of them by exact cosine
products, in blocks, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import small_batches

#: Hashed features, latent dimensions, labelled documents at most (about), neighbours that vote.
FEATURES = 2048
DIMENSIONS = 64
MAX_LABELLED = 4000
NEIGHBOURS = 15
#: A similarity counts as this power of it, so that close neighbours outweigh the rest.
SHARPNESS = 4


def trigram_counts(texts: list[str | None], features: int = FEATURES) -> np.ndarray:
    """log(1 + count) of each text's hashed byte trigrams, over the whole text."""
    out = np.zeros((len(texts), features), np.float32)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    k = 0
    while k < len(raw):
        end, size = k, 0
        while end < len(raw) and (end == k or (size + len(raw[end]) < 2_000_000 and end - k < 256)):
            size += len(raw[end])
            end += 1
        flat = np.frombuffer(b"".join(raw[k:end]), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(end - k), [len(x) for x in raw[k:end]])
        if len(flat) >= 3:
            h = (flat[:-2] * np.uint32(2654435761) + flat[1:-1] * np.uint32(2246822519) + flat[2:] * np.uint32(3266489917)) >> np.uint32(7)
            inside = owner[:-2] == owner[2:]
            place = owner[:-2] * features + (h % np.uint32(features))
            out[k:end] = np.log1p(np.bincount(place[inside], minlength=(end - k) * features)).reshape(-1, features)
        k = end
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


@dataclass
class Model:
    weight: np.ndarray  # idf of each feature
    basis: np.ndarray  # features x dimensions
    vectors: np.ndarray  # labelled documents, unit length
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(counts * self.weight) @ self.basis)

    def score(self, texts: list[str | None], neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        """The share of label 1 among the nearest labelled documents, by similarity; where
        nothing is similar (an empty text, say), its share among all of them."""
        prior = float(self.labels.mean())
        out = np.full(len(texts), prior)
        k = min(neighbours, len(self.labels))
        for i in range(0, len(texts), block):
            sims = self.embed(trigram_counts(texts[i : i + block], len(self.weight))) @ self.vectors.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sims, near, axis=1), 0.0).astype(np.float64) ** SHARPNESS
            whole = w.sum(axis=1)
            voted = (w * self.labels[near]).sum(axis=1) / np.where(whole == 0, 1, whole)
            out[i : i + block] = np.where(whole > 0, voted, prior)
        return np.clip(out, 0.0, 1.0)


def _svd_basis(x: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], dimensions)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    return np.ascontiguousarray(q)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, features: int = FEATURES, dimensions: int = DIMENSIONS) -> Model | None:
    """The model from ``labels(doc_id, <label> 0/1)``; of repeated labels the smaller counts.

    About ``max_labelled`` labelled documents are taken by a hash of doc_id, and their
    features (not their texts) reach the driver; of rows that share an id the least text
    counts. None without labelled documents.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("_y")).filter("doc_id IS NOT NULL AND _y IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("_y").alias("_y"))
    count = known.count()
    if not count:
        return None
    share = min(1.0, max_labelled / count)
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("knn")), F.lit(1 << 20)) < int(share * (1 << 20)))
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = trigram_counts(batch.column(2).to_pylist(), features)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "_y", "x"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")  # about max_labelled ids
    rows = rows.groupBy("doc_id", "_y").agg(F.min("text").alias("text"))  # of rows with one id the least text, so that ids bound what is collected
    got = rows.select("doc_id", "_y", "text").mapInArrow(run, "doc_id long, _y int, x binary").orderBy("doc_id", "x").collect()
    if not got:
        return None
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), features)
    weight = (np.log((1 + len(got)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    unit = _unit(x * weight)
    basis = _svd_basis(unit, min(dimensions, features))
    return Model(weight, basis, _unit(unit @ basis), np.array([r["_y"] for r in got], np.float64))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", **how) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs(doc_id, text)``.

    The text alone is scored, whole; null and empty texts get the labelled share; repeated
    rows and null ids are scored as rows; without labels each score is 0.5; an empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, label, **how)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        found = rows.select("doc_id", F.lit(0.5).alias("score"))
    else:
        small_batches(spark)
        sent = spark.sparkContext.broadcast(model)  # max_labelled x dimensions and features x dimensions floats

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

        found = rows.mapInArrow(run, "doc_id long, score double")
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def held_out(doc_id) -> object:
    """Rows that no label may be learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
