"""BPE encoding by speculation and verification, and decoding.

A word is first cut greedily into its longest vocabulary entries.  Byte-pair merging is local: a sequence of tokens is
the merge result of their concatenation exactly if that holds for every adjacent pair, and for a lone token itself.  So
the pairs of all new words of a slice of text are tested together against a table of known pairs (NumPy ``isin``); pairs
and lone tokens not seen before are settled once by exact merging; and only words with a failing test are merged exactly
as a whole.

Texts are cut into words by the file's own pattern.  Tables of character classes, cases and compositions differ between
versions of Unicode; so a text with a character outside ``PLAIN``, whose classes are the same in all of them, is
normalised and cut by the tokenizers library itself.

Results equal those of the tokenizers library for files with BPE model, end-of-word suffix, NFC and lower-case
normalisation, and no decoder (tokens joined by a space).  Defined results: null counts as empty text, which has no
tokens and decodes to the empty string; strings of special tokens in a text become those tokens; texts of any length are
taken whole (memory follows the longest text); repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from voxloom.llm.common import arrow_map, texts_as_bytes

#: Distinct words whose encodings a worker keeps; later ones are kept for one slice of text.  A bound on memory only.
WORDS_KEPT = 300_000
#: Characters whose letters, numbers, cases and compositions don't depend on the version of Unicode: Latin, Greek,
#: Cyrillic, common punctuation and signs, kana, Han, Hangul.
PLAIN = regex.compile("[\\x00-\u0377\u0384-\u038a\u038c\u038e-\u03a1\u03a3-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fa5\uac00-\ud7a3]*+")
#: Sorts after every merge.
NO_MERGE = (1 << 60, -1)


def byte_alphabet() -> list[str]:
    """Printable characters that stand for the 256 bytes in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.tokens = [""] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.token_bytes = [t.encode() for t in self.tokens]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.library = Tokenizer.from_file(path)
        self.longest = max(map(len, self.vocab))
        self.good, self.bad = np.empty(0, np.int64), np.empty(0, np.int64)
        self.lone: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.verified = self.merged = 0

    def symbols(self, word: str) -> list[int]:
        chars = [self.alphabet[b] for b in word.encode()]
        chars[-1] += self.suffix
        return [self.vocab[c] for c in chars]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, from the left; a heap over a linked list."""
        if len(ids) < 2:
            return ids
        if len(ids) <= 40:  # scanning a short list beats a heap
            ids, merges = [*ids], self.merges
            best = [merges.get(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
            while best and (low := min(best)) is not NO_MERGE:
                i = best.index(low)
                ids[i : i + 2] = [low[1]]
                if i + 1 < len(ids):
                    best[i : i + 2] = [merges.get((ids[i], ids[i + 1]), NO_MERGE)]
                else:
                    del best[i]
                if i:
                    best[i - 1] = merges.get((ids[i - 1], ids[i]), NO_MERGE)
            return ids
        ids, after, before = [*ids], [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)]
        end, merges = len(ids), self.merges
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(end - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < end and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def exact(self, word: str) -> list[int]:
        return self.merge(self.symbols(word))

    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left."""
        s = "".join([self.alphabet[b] for b in word.encode()])
        n, at, out, vocab, longest = len(s), 0, [], self.vocab, self.longest
        while at < n:
            rest = s[at:] + self.suffix
            if len(rest) <= longest and (i := vocab.get(rest)) is not None:
                out.append(i)
                break
            for stop in range(min(n - 1, at + longest), at, -1):
                if (i := vocab.get(s[at:stop])) is not None:
                    break
            else:
                return self.exact(word)
            out.append(i)
            at = stop
        return out

    def stands(self, ids: list[int]) -> bool:
        """Whether exact merging of the tokens' text gives these tokens."""
        text = "".join([self.tokens[i] for i in ids])
        chars = [*(text.removesuffix(self.suffix) if self.suffix else text)]
        if len(chars) < len(text):
            chars[-1] += self.suffix
        return self.merge([self.vocab[c] for c in chars]) == ids

    def settle(self, pairs: np.ndarray) -> None:
        """Exact merging of pairs not seen before; from then on they are known as good or bad."""
        new = np.setdiff1d(pairs, np.concatenate((self.good, self.bad)))
        if len(new):
            ok = np.array([self.stands([*divmod(code, len(self.tokens))]) for code in new.tolist()])
            self.good, self.bad = np.union1d(self.good, new[ok]), np.union1d(self.bad, new[~ok])

    def learn(self, words: list[str]) -> list[bytes]:
        """Encodes new words: proposals, one vectorised test of all their adjacent pairs, exact merging of failures."""
        proposals = [self.propose(w) for w in words]
        lengths = np.array([len(p) for p in proposals], np.int64)
        flat = np.fromiter((x for p in proposals for x in p), np.int64, int(lengths.sum()))
        of = np.repeat(np.arange(len(words)), lengths)
        inside = of[1:] == of[:-1]
        pairs = (flat[:-1] * len(self.tokens) + flat[1:])[inside]
        self.settle(np.unique(pairs))
        failing = np.zeros(len(words), bool)
        failing[of[:-1][inside][~np.isin(pairs, self.good)]] = True
        for i in np.flatnonzero(lengths == 1).tolist():  # a lone token has no pair to test
            if (token := proposals[i][0]) not in self.lone:
                self.lone[token] = self.stands([token])
            failing[i] = not self.lone[token]
        self.verified += int((~failing).sum())
        self.merged += int(failing.sum())
        for i in np.flatnonzero(failing):
            proposals[i] = self.exact(words[i])
        return [np.array(p, "<u4").tobytes() for p in proposals]

    def split(self, text: str) -> list[str | int]:
        """Words, and ids of special tokens."""
        parts: list[str | int] = []
        at = 0
        if self.specials and any(s in text for s in self.special):
            for m in self.specials.finditer(text):
                parts += [*self.split_plain(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
        return [*parts, *self.split_plain(text[at:])] if parts or at else self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        if not text.isascii():
            if not PLAIN.fullmatch(text):
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in cut]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form of sigma
        return self.words.findall(text.lower())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        new: dict[str | int, None] = {}
        for words in split:
            new.update(dict.fromkeys(words))
        fresh = [w for w in new if isinstance(w, str) and w not in self.known]
        self.known.update(zip(fresh, self.learn(fresh)))
        known, out = self.known, []
        for words in split:
            try:
                out.append(b"".join(map(known.__getitem__, words)))
            except KeyError:  # a special token
                out.append(b"".join(w.to_bytes(4, "little") if isinstance(w, int) else known[w] for w in words))
        for w in fresh[max(0, len(fresh) - max(0, len(known) - WORDS_KEPT)) :]:
            del known[w]
        return out

    def decode_batch(self, ids: list[bytes]) -> list[bytes]:
        token = self.token_bytes.__getitem__
        return [b" ".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the tokens of every whole text."""

    def kernel(batch):
        ids = encoder(tokenizer_path).encode_batch([x.decode() for x in texts_as_bytes(batch.column(1))])
        return {"doc_id": batch.column(0), "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>", "text")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars): digests of the tokens of every whole text and of
    the text decoded from them."""

    def kernel(batch):
        bpe = encoder(tokenizer_path)
        ids = bpe.encode_batch([x.decode() for x in texts_as_bytes(batch.column(1))])
        decoded = bpe.decode_batch(ids)
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
            "decoded_chars": [len(x.decode()) for x in decoded],
        }

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long", "text")
