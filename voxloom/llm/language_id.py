"""Language identification with segmentation-marginalised unigrams.

Each language has its own probabilities of the pieces of one fixed public vocabulary.  The probability of a word is the
sum over all its segmentations into pieces (forward algorithm); a text's is the product over its words; the prediction
is the language with the highest posterior.  Probabilities are learned by expectation maximisation (forward-backward
over the distinct words of a bounded sample of labelled rows: about ``SAMPLE_CHARS`` characters a language, chosen by a
hash of id and text).  Words are runs of letters in lower case, of any length: short ones advance together, those of more
than ``SHORT`` letters one by one in logarithms (their probabilities may be below the least float).

Prediction runs per partition: word scores are kept in each worker, so that a word is scored once however often it
occurs, and the matrix of a batch of new words advances position by position in NumPy.

Defined results: null text, or one without letters, is ``und`` with score 0; ties go to the first language in order;
rows without language or text aren't learned from; more than ``MAX_LANGUAGES`` languages are an error; with no row to learn from every text is ``und``; a null id counts as
an empty one for the split; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm.common import arrow_map, slices

WORD = regex.compile(r"\p{L}+")
SHORT, SAMPLE_CHARS, ROUNDS, SMOOTHING, UNKNOWN = 24, 1_500_000, 3, 0.01, 1e-9
#: Languages of one model, which every worker holds.
MAX_LANGUAGES = 500
#: Distinct words whose scores a worker keeps; later ones are kept for one slice of text.  A bound on memory only.
WORDS_KEPT = 200_000
#: Bytes of text whose words are held at once.
SLICE = 2 << 20
UNDETERMINED = "und"


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], frozenset[str]]:
    """Vocabulary entries made of letters, with or without the word-start mark; and all their beginnings."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = sorted({p for i in range(sp.get_piece_size()) if (p := sp.id_to_piece(i)).removeprefix("▁").isalpha() and p == p.lower()} | {"▁"})
    return {p: i for i, p in enumerate(names)}, frozenset(p[:n] for p in names for n in range(1, len(p) + 1))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def arcs(s: str, i: int, path: str) -> Iterator[tuple[int, int]]:
    """(end, piece) of the pieces that start at ``i``; every letter can stand alone, so each word has a segmentation."""
    vocab, beginnings = pieces(path)
    single = False
    for j in range(i + 1, len(s) + 1):
        part = s[i:j]
        if part not in beginnings:
            break
        if (piece := vocab.get(part)) is not None:
            yield j, piece
            single |= j == i + 1
    if not single:
        yield i + 1, len(vocab)


def long_total(word: str, logs: np.ndarray, path: str) -> np.ndarray:
    """Log probability of a word in each language; holds no more positions than the longest piece has letters."""
    s, ahead = "▁" + word, {0: np.zeros(logs.shape[1])}
    for i in range(len(s)):
        here = ahead.pop(i)
        for j, piece in arcs(s, i, path):
            step = here + logs[piece]
            ahead[j] = np.logaddexp(ahead[j], step) if j in ahead else step
    return ahead[len(s)]


def long_expected(word: str, logs: np.ndarray, path: str, counts: np.ndarray, into: np.ndarray) -> None:
    """Adds the expected counts of the pieces of a word, weighted with its count in each language."""
    s = "▁" + word
    n = len(s)
    out = [list(arcs(s, i, path)) for i in range(n)]
    ahead, behind = np.full((n + 1, logs.shape[1]), -np.inf), np.full((n + 1, logs.shape[1]), -np.inf)
    ahead[0] = behind[n] = 0
    for i in range(n):
        for j, piece in out[i]:
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + logs[piece])
    for i in range(n - 1, -1, -1):
        for j, piece in out[i]:
            step = behind[j] + logs[piece]
            behind[i] = np.logaddexp(behind[i], step)
            into[piece] += counts * np.exp(ahead[i] + step - ahead[n])


@dataclass
class Lattice:
    """Arcs (word, start, end, piece) of all segmentations of a batch of short words, sorted by end and by start."""

    count: int
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, words: list[str], path: str) -> Lattice:
        vocab, beginnings = pieces(path)
        w, a, b, p = [], [], [], []
        for k, word in enumerate(words):  # as ``arcs``, in place: most of the time goes here
            s = "▁" + word
            n = len(s)
            for i in range(n):
                single = False
                for j in range(i + 1, n + 1):
                    part = s[i:j]
                    if part not in beginnings:
                        break
                    if (piece := vocab.get(part)) is not None:
                        w.append(k), a.append(i), b.append(j), p.append(piece)
                        single |= j == i + 1
                if not single:
                    w.append(k), a.append(i), b.append(i + 1), p.append(len(vocab))
        as_ints = lambda x: np.array(x, dtype=np.int64)
        return cls(len(words), as_ints(w), as_ints(a), as_ints(b), as_ints(p), as_ints([len(x) + 1 for x in words]))

    def _sweep(self, probs: np.ndarray, at: np.ndarray, other: np.ndarray, table: np.ndarray, order: range) -> None:
        """table[:, at] = sum over arcs of table[:, other] * probability, positions in ``order``."""
        by = np.lexsort((self.word, at))
        bounds = np.searchsorted(at[by], np.arange(table.shape[1] + 1))
        for j in order:
            k = by[bounds[j] : bounds[j + 1]]
            if len(k):
                w = self.word[k]
                heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                table[w[heads], j] += np.add.reduceat(table[w, other[k]] * probs[self.piece[k]], heads)

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """Words x positions x languages: probability of the first letters, over all their segmentations."""
        table = np.zeros((self.count, int(self.lengths.max(initial=0)) + 1, probs.shape[1]))
        table[:, 0] = 1
        self._sweep(probs, self.end, self.start, table, range(1, table.shape[1]))
        return table

    def totals(self, probs: np.ndarray) -> np.ndarray:
        return self.forward(probs)[np.arange(self.count), self.lengths]

    def expected(self, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Pieces x languages: expected counts, each word weighted with its count in the language."""
        ahead = self.forward(probs)
        total = ahead[np.arange(self.count), self.lengths]
        behind = np.zeros_like(ahead)
        behind[np.arange(self.count), self.lengths] = counts / total
        self._sweep(probs, self.start, self.end, behind, range(ahead.shape[1] - 2, -1, -1))
        mass = ahead[self.word, self.start] * probs[self.piece] * behind[self.word, self.end]
        return np.stack([np.bincount(self.piece, mass[:, k], len(probs)) for k in range(probs.shape[1])], axis=1)


@dataclass
class Model:
    languages: list[str]
    probs: np.ndarray  # pieces and, last, the unknown letter x languages
    path: str
    index: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def learn_words(self, words: list[str], block: int = 5_000) -> None:
        new = [np.log(Lattice.of(words[i : i + block], self.path).totals(self.probs)) for i in range(0, len(words), block)]
        self.index |= {w: len(self.index) + i for i, w in enumerate(words)}
        self.scores = np.concatenate([self.scores.reshape(-1, len(self.languages)), *new])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, posterior) of every text."""
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        split = [words_of(t) for t in texts]
        known, long = self.index, dict.fromkeys(w for words in split for w in words if len(w) > SHORT)
        if fresh := list(dict.fromkeys(w for words in split for w in words if w not in known and w not in long)):
            self.learn_words(fresh)
        logs = np.log(self.probs) if long else None
        for w in long:  # never stored: they are rare, and of any size
            long[w] = long_total(w, logs, self.path)
        out = []
        for words in split:
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            if long:
                total = sum((long[w] if w in long else self.scores[self.index[w]] for w in words), np.zeros(len(self.languages)))
            else:
                total = self.scores[list(map(self.index.__getitem__, words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        if (extra := max(0, len(self.index) - WORDS_KEPT)):
            for w in fresh[len(fresh) - min(extra, len(fresh)) :]:
                del self.index[w]
            self.scores = self.scores[: len(self.index)]
        return out


def bucket(id_col: str) -> Column:
    """The split of documents: crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def train(labelled: DataFrame, path: str, sample_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits a model; one pass counts characters a language, one takes the words of the sample."""
    rows = labelled.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"a model holds at most {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    vocab, _ = pieces(path)
    if not languages:
        return Model([], np.empty((len(vocab) + 1, 0)), path)
    part = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, float(min(1.0, sample_chars / max(1, n))))])[F.col("lang")]
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < part * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for some in slices(batch, "text", SLICE):
                for lang, text in zip(*(c.to_pylist() for c in some.columns)):
                    seen.update((lang, w) for w in words_of(text))
        langs, words = zip(*seen) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(seen.values(), pa.int64())], ["lang", "word", "n"])

    found = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    words = sorted(set(found["word"]), key=lambda w: (len(w) > SHORT, w))
    short = sum(len(w) <= SHORT for w in words)
    at, lang_at = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(words), len(languages)))
    for lang, word, n in zip(found["lang"], found["word"], found["n"]):
        counts[at[word], lang_at[lang]] = n
    probs = np.full((len(vocab) + 1, len(languages)), 1 / len(vocab))
    probs[-1] = UNKNOWN
    for _ in range(ROUNDS):
        total = np.zeros_like(probs)
        for i in range(0, short, 50_000):
            total += Lattice.of(words[i : min(short, i + 50_000)], path).expected(probs, counts[i : min(short, i + 50_000)])
        logs = np.log(probs)
        for word, n in zip(words[short:], counts[short:]):
            long_expected(word, logs, path, n, total)
        known = total[:-1] + SMOOTHING
        probs = np.concatenate([known / known.sum(axis=0) * (1 - UNKNOWN), np.full((1, len(languages)), UNKNOWN)])
    return Model(languages, probs, path)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages: bounded by the vocabulary

    def kernel(batch):
        got = shared.value.predict([t or "" for t in batch.column(len(keep)).to_pylist()])
        return {name: batch.column(i) for i, name in enumerate(keep)} | {"lang_pred": [x for x, _ in got], "score": [x for _, x in got]}

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(docs.select(*keep, F.col(text_col).cast("string").alias("__text")), kernel, f"{types}, lang_pred string, score double", "__text", SLICE)


def identify(docs: DataFrame, path: str, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Learns from the documents outside the held-out fifth, and predicts all."""
    model = train(docs.where(bucket("doc_id") != 0), path, sample_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket("doc_id") == 0).alias("held_out"), "text")
    return predict(rows, model, ("doc_id", "held_out"))


def keep_identified(docs: DataFrame, path: str, least: float = 0.5, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``docs`` without those whose language stays undetermined or is less likely than ``least``."""
    model = train(docs.where(bucket("doc_id") != 0), path, sample_chars)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                got = shared.value.predict([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in got]))

    return docs.mapInArrow(run, docs.schema)
