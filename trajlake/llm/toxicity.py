"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear support vector machine.

The kernel of two strings is the weight of their common subsequences of ``LENGTH`` characters, each gap costing a
factor ``DECAY``; so an insult still matches with characters put in, left out or added.  A sentence is compared with
a landmark by its best word (the share of the landmark's own weight found there, at most one), a document by its best
sentence.  Labels stand on documents, so in training a document is the bag of its sentences.

Landmarks are word beginnings and words of labelled toxic documents, taken greedily so that each
document is covered several times.  Kernel values are whitened by the landmarks' own kernel matrix (Nyström), the machine is fitted on
about ``SAMPLE_DOCS`` labelled documents, and its margin becomes a probability by a logistic fit.

Words are cut at white space, lose punctuation at their ends, are lower-cased and have digits and signs read as the
letters they stand for; three or more single characters in a row are one word; long words are read in overlapping
stretches.  A word that shares too few letters with a landmark has no kernel value with it (``OVERLAP``).

Defined results: NULL or empty text scores as a text without any match; very long texts are read whole; repeated
rows are scored row by row; labels without document, or documents without label, teach nothing; if the sample has
one class only, every score is that class's share; an empty table gives an empty result.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import held_out, labelled_sample, table, with_sample
from trajlake.session import cut_lineage

LENGTH = 3
DECAY = 0.5
OVERLAP = 0.6
STRETCH = 24
SAMPLE_DOCS = 6_000
LANDMARKS = 64
SHORTEST, LONGEST = 4, 10
TELLING = 0.9
SUPPORT = 3
LEAST_GAIN = 0.4
CANDIDATES = 3_000
THRESHOLD = 0.3
KNOWN_WORDS = 500_000
GROUP = 500

# Signs read as letters, and what is taken off the ends of words.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
ENDS = ".,;:!?\"'()[]{}<>|*#%&…-_"
SPELT = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")


def tokens(text: str | None) -> set[str]:
    """Distinct raw words of a text; single characters in a row are joined."""
    low = (text or "").lower()
    found = set(low.split())
    found.update(m[0].replace(" ", "") for m in SPELT.finditer(low))
    return found


def plain(token: str) -> str:
    return token.strip(ENDS).translate(LOOKALIKE)


def _codes(strings: list[str]) -> np.ndarray:
    width = max(map(len, strings))
    joined = "".join(s.ljust(width, "\0") for s in strings)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), width)


def letter_masks(codes: np.ndarray) -> np.ndarray:
    """Which letters occur: a bit for each of a to z, the rest share the bits above."""
    c = codes.astype(np.uint64)
    bit = np.where((c >= 97) & (c <= 122), c - 97, 26 + c % 37)
    return np.bitwise_or.reduce(np.where(c > 0, np.uint64(1) << bit.astype(np.uint64), np.uint64(0)), axis=1)


def kernel(codes: np.ndarray, landmark: str) -> np.ndarray:
    """Gap-weighted subsequence kernel of every row (code points, zero-padded) with the landmark."""
    n, width = codes.shape
    match = [(codes == ord(ch)) & (codes > 0) for ch in landmark]
    before = np.ones((len(landmark) + 1, width + 1, n), np.float32)  # sums over earlier places, gaps discounted
    for level in range(LENGTH):
        here = np.zeros((len(landmark), width, n), np.float32)
        for b in range(len(landmark)):
            here[b] = match[b].T * before[b, :width] * np.float32(DECAY * DECAY)
        if level == LENGTH - 1:
            return here.sum(axis=(0, 1))
        sums = np.zeros((len(landmark) + 1, width + 1, n), np.float32)
        for b in range(len(landmark)):
            for a in range(width):
                sums[b + 1, a + 1] = here[b, a] + DECAY * (sums[b, a + 1] + sums[b + 1, a]) - DECAY * DECAY * sums[b, a]
        before = sums
    return np.zeros(n, np.float32)


def stretches(word: str) -> list[str]:
    return [word] if len(word) <= STRETCH else [word[i : i + STRETCH] for i in range(0, len(word) - STRETCH // 2, STRETCH // 2)]


class Matcher:
    """Kernel values of words with the landmarks; only words that match something keep a row."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.own = np.array([float(kernel(_codes([x]), x)[0]) for x in landmarks], np.float32)
        self.masks = letter_masks(_codes(landmarks)) if landmarks else np.empty(0, np.uint64)
        letters = np.bitwise_count(self.masks)
        self.need = np.maximum(np.minimum(LENGTH, letters), np.ceil(OVERLAP * letters)).astype(np.uint8)
        self.clear()

    def clear(self) -> None:
        self.seen: set[str] = set()
        self.rows: dict[str, np.ndarray] = {}

    def meet(self, words: set[str]) -> None:
        if len(self.seen) > KNOWN_WORDS:
            self.clear()
        new = words - self.seen
        self.seen |= new
        parts = [(w, s) for w in new for s in stretches(plain(w)) if len(s) >= LENGTH]
        if not parts or not self.landmarks:
            return
        parts.sort(key=lambda p: len(p[1]))  # rows of like length are computed together
        for at in range(0, len(parts), 20_000):
            block = parts[at : at + 20_000]
            codes = _codes([s for _, s in block])
            masks = letter_masks(codes)
            for i, landmark in enumerate(self.landmarks):
                near = np.flatnonzero(np.bitwise_count(masks & self.masks[i]) >= self.need[i])
                for lo in range(0, len(near), 4_000):
                    some = near[lo : lo + 4_000]
                    share = np.minimum(1.0, kernel(codes[some], landmark) / self.own[i])
                    for j in np.flatnonzero(share > 0.05):
                        word = block[some[j]][0]
                        if word not in self.rows:
                            self.rows[word] = np.zeros(len(self.landmarks), np.float32)
                        self.rows[word][i] = max(self.rows[word][i], share[j])

    def features(self, words: set[str]) -> np.ndarray:
        found = [self.rows[w] for w in words if w in self.rows]
        return np.max(found, axis=0) if found else np.zeros(len(self.landmarks), np.float32)


def matched(batches: Iterator[pa.RecordBatch], landmarks: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    matcher = Matcher(landmarks)
    for whole in batches:
        for at in range(0, whole.num_rows, GROUP):
            b = whole.slice(at, GROUP)
            found = [tokens(t.as_py()) for t in b.column(1)]
            matcher.meet(set().union(*found))
            yield b, np.array([matcher.features(w) for w in found]).reshape(b.num_rows, len(landmarks))


class Model:
    """Landmarks and, on their kernel values, a linear margin with its slope and offset as a probability."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float, offset: float):
        self.landmarks, self.weights, self.bias, self.slope, self.offset = landmarks, weights, bias, slope, offset

    def scores(self, values: np.ndarray) -> np.ndarray:
        margin = values @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t in b.column(1):
            found = {plain(w)[:LONGEST] for w in tokens(t.as_py())}
            out.append(sorted({w[:n] for w in found for n in range(SHORTEST, len(w) + 1)}))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "y", "parts"])


def choose_landmarks(sample: DataFrame) -> list[str]:
    """A greedy, several-fold cover of the sampled toxic documents by word beginnings that hardly occur in the others."""
    kind = sample.schema["doc_id"].dataType.simpleString()
    parts = sample.select("doc_id", "text", "y").mapInArrow(_beginnings, f"doc_id {kind}, y int, parts array<string>")
    each = cut_lineage(parts.select("doc_id", "y", F.explode("parts").alias("part")))
    counts = each.groupBy("part").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    telling = counts.filter((F.col("bad") >= SUPPORT) & (F.col("bad") >= TELLING * F.col("n"))).orderBy(F.desc("bad"), F.length("part").desc(), "part").limit(CANDIDATES)
    held = each.filter("y = 1").join(F.broadcast(telling.select("part")), "part").groupBy("part").agg(F.collect_set("doc_id").alias("docs"))
    covers = {r["part"]: set(r["docs"]) for r in held.collect()}  # at most CANDIDATES parts of sampled documents
    worth: dict = {d: 1.0 for docs in covers.values() for d in docs}
    chosen: list[str] = []
    while covers and len(chosen) < LANDMARKS:
        gains = {p: sum(worth[d] for d in docs) for p, docs in covers.items()}
        best = max(gains, key=lambda p: (round(gains[p], 6), len(p), p))
        if gains[best] < LEAST_GAIN:
            break
        chosen.append(best)
        for d in covers.pop(best):
            worth[d] /= 2  # a document counts half as much for each landmark it already has
        covers = {p: docs for p, docs in covers.items() if not (p.startswith(best) or best.startswith(p))}
    return chosen


def nystroem(landmarks: list[str]) -> np.ndarray:
    """Inverse square root of the landmarks' normalised kernel matrix."""
    codes = _codes(landmarks)
    full = np.array([kernel(codes, x) for x in landmarks], float)
    norm = np.sqrt(np.diag(full))
    values, vectors = np.linalg.eigh(full / norm / norm[:, None])
    return vectors @ np.diag(1.0 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCS) -> Model:
    """Model from about ``bound`` labelled documents whose ids may be learned from."""
    sample = cut_lineage(with_sample(docs.select("doc_id", "text"), labelled_sample(labels, "toxic", bound, learnable_only=True)).select("doc_id", "text", "y"))
    seen = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()
    landmarks = choose_landmarks(sample) if 0 < seen["bad"] < seen["n"] else []
    if not landmarks:
        share = seen["bad"] / max(1, seen["n"])
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    whiten = nystroem(landmarks)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in matched(batches, landmarks):
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(list(x.astype(float) @ whiten), pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(values, "y int, x array<double>")
    ready = cut_lineage(rows.select(F.col("y").cast("double").alias("label"), array_to_vector("x").alias("features")).coalesce(4))
    machine = LinearSVC(regParam=1e-4, maxIter=60, standardization=False).fit(ready)
    margins = machine.setRawPredictionCol("raw").setPredictionCol("guess").transform(ready)
    one = margins.select("label", array_to_vector(F.array(vector_to_array("raw")[1])).alias("features"))
    fit = LogisticRegression(regParam=1e-3, maxIter=50).fit(one)
    return Model(landmarks, whiten @ machine.coefficients.toArray(), float(machine.intercept), float(fit.coefficients[0]), float(fit.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in matched(batches, shared.value.landmarks):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(x), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
