"""Hierarchical packing of documents into sequences of several context sizes.

Every document is tokenised once and ended with one id.  Its full windows of the longest context stand alone; what
remains is routed to the smallest tier that holds it.  Tiers are packed from long to short: a sequence starts with the
longest waiting piece, and its gap is filled with the best-fitting pieces of shorter tiers; where none fits, the
shortest waiting piece is cut to fill it exactly and the rest waits on.  So every sequence is exactly full at its tier's
size.  The last, unfilled one of a partition goes down the ladder of powers of two.  Sequences are dealt into step groups
of about equal tokens, those with most attention work first.

Packing needs no shuffle: a partition packs its own documents in buffers of bounded tokens, and carries the unfilled
sequence on.  A retried task gives the same rows.  Defined results: null counts as empty text (its one token is the end
id); repeated rows and ids are packed as often as they occur; a text longer than a window is cut; an empty table has no
sequence; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from voxloom.llm.common import slices, texts_as_bytes

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that wait in a task before they are packed, and tokens of a step group.
BUFFER_TOKENS, STEP_TOKENS = 2 << 20, 64 << 10

#: Characters of a run that only the tokenizers library takes.
LONG_RUN = 20_000
RUN = re.compile(rf"\s{{{LONG_RUN}}}|\w{{{LONG_RUN}}}|[^\s\w]{{{LONG_RUN}}}")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, step_group long"


@lru_cache(maxsize=2)
def byte_tokenizer(json_path: str, ranks_path: str | None, pattern: str) -> Callable[[str], list[int]]:
    """Ids as the tokenizers library gives them.  The same vocabulary as a rank file is faster; texts with special
    tokens in them go to the library itself, and so do those with a long run of one kind of character, for which the
    faster one needs a stack as deep as the run."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(json_path)
    plain.no_truncation()
    plain.no_padding()
    if ranks_path is None:
        return lambda text: plain.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in plain.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or (len(text) > LONG_RUN and RUN.search(text)):
            return plain.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class Packer:
    """Packs pieces (document, start, length) into sequences that are exactly full."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers, self.top = tiers, tiers[-1]
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start), shortest first
        self.full: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc: int, n: int) -> None:
        """A whole document of ``n`` tokens: full windows at once, the rest waits."""
        whole = n // self.top * self.top
        self.full += [(self.top, [(doc, s, self.top)]) for s in range(0, whole, self.top)]
        if n > whole:
            self.waiting.append((n - whole, doc, whole))

    def _take(self, index: int, most: int) -> tuple[int, int, int]:
        length, doc, start = self.waiting.pop(index)
        if length > most:
            insort(self.waiting, (length - most, doc, start + most))
            length = most
        return doc, start, length

    def pack(self, last: bool) -> None:
        """Packs what waits; if not ``last``, the pieces of an unfilled sequence wait on."""
        self.waiting.sort()
        while self.waiting:
            size = next(c for c in self.tiers if c >= self.waiting[-1][0])
            pieces = [self._take(len(self.waiting) - 1, size)]
            gap = size - pieces[0][2]
            while gap and self.waiting:
                pieces.append(self._take(max(0, bisect_right(self.waiting, (gap, 1 << 62, 0)) - 1), gap))
                gap -= pieces[-1][2]
            if not gap:
                self.full.append((size, pieces))
            elif last:
                self._ladder(pieces)
            else:
                self.waiting = sorted((n, doc, start) for doc, start, n in pieces)
                return

    def _ladder(self, pieces: list[tuple[int, int, int]]) -> None:
        """The tail of a partition as sequences of falling powers of two."""
        queue, left = pieces[::-1], sum(p[2] for p in pieces)
        while left:
            size = gap = 1 << left.bit_length() - 1
            own = []
            while gap:
                doc, start, n = queue.pop()
                own.append((doc, start, min(n, gap)))
                if n > gap:
                    queue.append((doc, start + gap, n - gap))
                gap -= own[-1][2]
            self.full.append((size, own))
            left -= size

    def drain(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        out, self.full = self.full, []
        return out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The group of each sequence: most attention work first, each to the group with the fewest tokens so far."""
    groups = max(1, -(-sum(s[0] for s in sequences) // step_tokens))
    heap = [(0, 0, g) for g in range(groups)]
    work = [sum(n * n for _, _, n in pieces) for _, pieces in sequences]
    out = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-sequences[i][0], -work[i], i)):
        tokens, cost, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (tokens + sequences[i][0], cost + work[i], g))
    return out


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str = "", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence, the tier (``context``; on a partition's
    tail the power of two) and the step group.  ``tiers`` must be rising powers of two."""
    schema = _parse_datatype_string(SCHEMA)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokenizer(tokenizer_path, ranks_path, pattern)
        base = TaskContext.get().partitionId() << 34
        packer, buffered = Packer(tiers), 0
        ids: dict[int, tuple[int | None, np.ndarray]] = {}
        docs_seen = sequences = groups = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal sequences, groups, ids, buffered
            packer.pack(last)
            done = packer.drain()
            rows: list[tuple] = []
            step = step_groups(done, step_tokens)
            for (size, pieces), g in zip(done, step):
                offset = 0
                for doc, start, n in pieces:
                    doc_id, tokens = ids[doc]
                    rows.append((doc_id, start, n, zlib.crc32(tokens[start : start + n].tobytes()), len(tokens), base + sequences, offset, size, base + groups + g))
                    offset += n
                sequences += 1
            groups += max(step, default=-1) + 1
            kept = {doc for _, doc, _ in packer.waiting}
            ids = {doc: ids[doc] for doc in kept}
            buffered = sum(n for n, _, _ in packer.waiting)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(out), out)], schema=out)

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column(0).to_pylist(), texts_as_bytes(part.column(1))):
                    tokens = np.array([*encode(text.decode()), END_ID], "<u4")
                    ids[docs_seen] = doc_id, tokens
                    packer.add(docs_seen, len(tokens))
                    docs_seen += 1
                    buffered += len(tokens)
                    if buffered >= BUFFER_TOKENS:
                        yield flush(False)
        yield flush(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
