"""Language identification by segmentation-marginalised unigrams.

A word's probability in a language is the sum, over all ways to cut it into pieces of a fixed public vocabulary, of
the product of the pieces' probabilities there; a forward pass over the word sums them.  A text's score is the sum of
the logarithms over all its words.  Piece probabilities come from expected counts over all segmentations of the
words of a bounded sample of labelled documents (``SAMPLE_DOCS``), in ``ROUNDS`` rounds that each are one Spark job.

Words are maximal runs of letters (Unicode category L, for learning and scoring alike) in lower case, with the vocabulary's mark for a word's start; words over ``CUT``
letters are read in stretches of that length.  A letter that the vocabulary lacks has a small fixed probability.

Defined results: NULL text or text without a letter is ``und`` with score 0; very long texts are scored whole;
ties go to the language that sorts first; repeated rows are scored row by row; without labelled text every text is
``und``; an empty table gives an empty result.  Only ``doc_id``, ``text`` and, to learn, ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import held_out, table
from trajlake.session import cut_lineage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONGEST = 8
CUT = 32
SAMPLE_DOCS = 3_000
ROUNDS = 2
SMOOTH = 0.05
RARE = 1e-7
KNOWN_WORDS = 400_000
SLOTS = 22

LETTERS = regex.compile(r"\p{L}+")


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """Lower-case pieces of at most ``LONGEST`` characters, read on the driver."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {p.lower() for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i)) for p in [pieces.id_to_piece(i)]}
    return sorted(p for p in kept if len(p) <= LONGEST and LETTERS.fullmatch(p.removeprefix(MARK)))


def words_of(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    if any(len(w) > CUT for w in found):
        found = [w[i : i + CUT] for w in found for i in range(0, len(w), CUT)]
    return found


class Pieces:
    """Looks up all pieces in many words at once: by hashes of code points in two direct tables."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.absent = self.size + 1  # row of zeros; row ``size`` is a letter that the vocabulary lacks
        self.hashes = np.zeros(self.size + 2, np.uint64)
        self.tables = [np.full(1 << SLOTS, self.absent, np.int32) for _ in range(2)]
        for i, p in enumerate(pieces):
            c = np.frombuffer(p.encode("utf-32-le"), np.uint32)[None, :]
            h = self._hash(c, 0, len(p))[0]
            self.hashes[i] = h
            for slot, t in zip(self._slots(h), self.tables, strict=True):
                if t[slot] == self.absent:
                    t[slot] = i
                    break
            else:
                raise ValueError(f"no free slot for the piece {p!r}: raise SLOTS")

    @staticmethod
    def _hash(codes: np.ndarray, start: int, length: int) -> np.ndarray:
        h = np.full(len(codes), length, np.uint64)
        for k in range(start, start + length):
            h = (h ^ codes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h

    @staticmethod
    def _slots(h):
        return h >> np.uint64(64 - SLOTS), (h >> np.uint64(10)) & np.uint64((1 << SLOTS) - 1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        a, b = self._slots(h)
        first, second = self.tables[0][a], self.tables[1][b]
        return np.where(self.hashes[first] == h, first, np.where(self.hashes[second] == h, second, self.absent))

    def lattice(self, words: list[str]) -> list[list[tuple[int, np.ndarray]]]:
        """For words of one length: at each position the (length, piece ids) of what may start there."""
        n = len(words[0]) + 1
        codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        out = []
        for i in range(n):
            here = []
            for k in range(1, min(LONGEST, n - i) + 1):
                ids = self._find(self._hash(codes, i, k))
                if k == 1:
                    ids = np.where(ids == self.absent, self.size, ids)
                if k == 1 or (ids != self.absent).any():
                    here.append((k, ids))
            out.append(here)
        return out


def by_length(words: list[str]) -> list[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return [g[i : i + 20_000] for g in groups.values() for i in range(0, len(g), 20_000)]


def forward(lattice, probability: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Summed probability of all segmentations of each prefix, per language."""
    alpha = [np.zeros((n_words, probability.shape[1])) for _ in range(len(lattice) + 1)]
    alpha[0] += 1.0
    for i, here in enumerate(lattice):
        for k, ids in here:
            alpha[i + k] += alpha[i] * probability[ids]
    return alpha


def expected_counts(pieces: Pieces, words: list[str], counts: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, weighted by how often they occur."""
    out = np.zeros(pieces.size + 2)
    for group in by_length(words):
        lattice = pieces.lattice([words[i] for i in group])
        alpha = forward(lattice, probability, len(group))
        beta = [np.zeros((len(group), 1)) for _ in alpha]
        beta[-1] += 1.0
        weight = counts[group][:, None] / alpha[-1]
        for i in range(len(lattice) - 1, -1, -1):
            for k, ids in lattice[i]:
                part = probability[ids] * beta[i + k]
                beta[i] += part
                np.add.at(out, ids, (alpha[i] * part * weight)[:, 0])
    return out


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table_, vocab = shared.value
        pieces, total = Pieces(vocab), {}
        for b in batches:
            langs, found, n = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for at, lang in enumerate(names):
                own = [i for i, x in enumerate(langs) if x == lang]
                if own:
                    got = expected_counts(pieces, [found[i] for i in own], n[own].astype(float), table_[:, at : at + 1])
                    total[lang] = total.get(lang, 0) + got
        for lang, got in total.items():
            ids = np.flatnonzero(got[: pieces.size])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(got[ids])], names=["lang", "piece", "n"])

    return run


class Model:
    """Languages, their piece probabilities and the vocabulary."""

    def __init__(self, langs: list[str], probability: np.ndarray, pieces: list[str]):
        self.langs, self.probability, self.pieces = langs, probability, pieces


def _table(n_pieces: int, n_langs: int) -> np.ndarray:
    start = np.full((n_pieces + 2, n_langs), 1.0 / max(1, n_pieces))
    start[n_pieces], start[n_pieces + 1] = RARE, 0.0
    return start


def learn(docs: DataFrame, path: str = VOCABULARY, bound: int = SAMPLE_DOCS) -> Model:
    """Piece probabilities per language from about ``bound`` documents (text, lang), chosen by a hash of id and text."""
    spark, vocab = docs.sparkSession, vocabulary(path)
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, bound / max(1, known.select("lang").count()))
    sample = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    split = F.split(F.lower("text"), r"[^\p{L}]+")
    stretches = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length("w") - 1) / CUT), F.lit(0))), lambda i: F.substring("w", (i * CUT + 1).cast("int"), F.lit(CUT)))
    found = sample.select("lang", F.explode(split).alias("w")).filter("w <> ''").select("lang", F.explode(stretches).alias("w"))
    counted = cut_lineage(found.groupBy("lang", "w").agg(F.count("*").cast("double").alias("n")))
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    table_ = _table(len(vocab), len(langs))
    for _ in range(ROUNDS if langs else 0):
        shared = spark.sparkContext.broadcast((langs, table_, vocab))
        got = counted.mapInArrow(_expect(shared), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        count = np.zeros((len(vocab), len(langs)))
        for r in got:  # at most one number per piece and language
            count[r["piece"], langs.index(r["lang"])] = r["n"]
        table_ = _table(len(vocab), len(langs))
        table_[: len(vocab)] = (count + SMOOTH) / (count.sum(axis=0) + SMOOTH * len(vocab))
        shared.unpersist()
    return Model(langs, table_, vocab)


class Scorer:
    """Logarithms of word probabilities, remembered for the words met so far."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.pieces)
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(model.langs)))

    def meet(self, words: set[str]) -> None:
        if len(self.known) > KNOWN_WORDS:
            self.known, self.rows = {}, self.rows[:0]
            new = list(words)
        else:
            new = [w for w in words if w not in self.known]
        if not new:
            return
        more = np.empty((len(new), len(self.model.langs)))
        for group in by_length(new):
            lattice = self.pieces.lattice([new[i] for i in group])
            more[group] = np.log(forward(lattice, self.model.probability, len(group))[-1])
        self.known |= zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True)
        self.rows = np.concatenate([self.rows, more])

    def predict(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.model.langs:
            return "und", 0.0
        total = self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())


GROUP = 500


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP):
                b = whole.slice(at, GROUP)
                texts = [words_of(t.as_py() or "") for t in b.column(1)]
                scorer.meet(set().union(*texts))
                got = [scorer.predict(w) for w in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
