"""Katz backoff language model over words: bigrams, unigrams, unknown word.

Counts are discounted by Good-Turing: Turing's estimate for counts up to ``TURING`` where it lies between 0 and 1, else
the log-linear one, which is below 1 for every count; so each history leaves mass for backoff.  A history's weight is
exact: (1 - sum of its discounted probabilities) / (1 - sum of the unigram probabilities of the words seen after it).  A
token is scored recursively: its bigram if training has it, else the history's weight times the unigram's probability;
a history not seen has weight 1; unknown words share the mass that unigram discounting leaves, as one class.

Plan.  Text is tokenised once, into a written table of blocks: tokens as numbers of the block's own words, and a hash of
each word.  Every table of the model is hash-partitioned by n-gram, and a block asks it once: it sends its distinct
n-grams with its own counts, packed in a row a bucket, and gets the totals in the same order.  Thus a frequent word or
pair is one entry a block, however often it occurs, and bigrams are dealt by their own hash, not by their history.
A history's sums are made in parts, each bigram by the one block that owns it, and merged by history.  Three rounds
(unigrams, bigrams, weights) give all that the scores need; each is a written table, so that a lost executor costs a
retry and not a recount.  The driver sees counts of counts and totals only.  Buckets follow the number of tokens, so a
bucket, and a task, has as much to do at any size of the corpus.

``save`` also stores the model as plain tables, partitioned by n-gram: unigrams (word, count), bigrams (history, word,
count), weights (history, weight), totals.  ``score_stored`` scores any other corpus with such tables, by joins.

Words are told apart by 64-bit hashes, the same as Spark's ``xxhash64``, and within the rounds bigrams by 64-bit hashes of
two of those (of 10^9 distinct ones, under 0.03 pairs are expected to meet).  Defined results: null or blank text is the end token alone; a null id counts as
an empty one for the split; repeated rows are counted and scored as often as they occur; with nothing to train on every
token is unknown, with probability 1; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm.common import shared_dir, slices, texts_as_bytes, written

#: Tokens of a block, and about as many that a bucket of a count table is asked for.
BLOCK_TOKENS, BUCKET_TOKENS = 1_500_000, 2_000_000
SEED = 42  # Spark's
TURING, FITTED, DEFAULT_SLOPE = 5, 50, -1.5
#: Places of the end token and of a text's begin among the hashes.
END_HASH, BEGIN_HASH = np.uint64(1), np.uint64(2)


def squeeze(a: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""


def expand(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, "<u8"), dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys: buckets are equal ranges of hashes."""
    starts = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    k = first * np.uint64(0x9E3779B97F4A7C15) + second
    k = (k ^ k >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return k ^ k >> np.uint64(32)


class Block:
    """A stored block: its documents, their tokens as numbers of its words, and its distinct bigrams."""

    def __init__(self, row: dict) -> None:
        self.held, self.lengths = np.array(row["held"], bool), expand(row["lengths"], "<i4").astype(np.int64)
        self.words, self.tokens = expand(row["words"], "<u8"), expand(row["tokens"], "<i4")
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.word_order = np.argsort(self.words, kind="stable")

    def count_words(self) -> np.ndarray:
        return np.bincount(self.tokens[~self.held[self.doc]], minlength=len(self.words))

    def find_pairs(self) -> None:
        """Distinct (history, word); the history of a first token is the number after the last word."""
        n = len(self.words) + 1
        codes = np.empty(len(self.tokens), np.int64)
        codes[1:] = self.tokens[:-1]
        codes[self.starts] = n - 1
        codes *= n
        codes += self.tokens
        self.pair = np.argsort(codes).astype(np.int32)
        codes = codes[self.pair]
        new = np.append(True, codes[1:] != codes[:-1]) if len(codes) else np.empty(0, bool)
        place = np.cumsum(new, dtype=np.int32) - np.int32(1)
        codes = codes[new]
        order, self.pair = self.pair, np.empty_like(self.pair)
        self.pair[order] = place
        self.first, self.second = (codes // n).astype(np.int32), (codes % n).astype(np.int32)
        hashes = np.append(self.words, BEGIN_HASH)
        self.keys = pair_keys(hashes[self.first], hashes[self.second])
        self.pair_order = np.argsort(self.keys, kind="stable")

    def count_pairs(self) -> np.ndarray:
        return np.bincount(self.pair[~self.held[self.doc]], minlength=len(self.keys))


BLOCK_SCHEMA = "block long, n_tokens long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, tokens binary"
ASK_SCHEMA = "bucket int, block long, keys binary, counts binary"
ANSWER_SCHEMA = "block long, bucket int, totals binary, r array<long>, n array<long>"
PART_SCHEMA = "block long, bucket int, doc_ids array<long>, held array<boolean>, lengths binary, known binary, base binary, partial binary, waits_doc binary, waits_for binary, need binary, own binary, mass binary, lower binary, seen binary"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def blocks(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised documents, about ``BLOCK_TOKENS`` tokens a row."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 24, 0
        numbers: dict[bytes, int] = {}
        ids: list[int | None] = []
        held_out: list[bool] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        total = 0

        def row() -> pa.RecordBatch:
            words = np.array([END_HASH, *[xxhash.xxh64_intdigest(w, SEED) for w in numbers]], "<u8")
            values = [base + count, total, ids, held_out, squeeze(np.array(lengths, "<i4")), squeeze(words), squeeze(np.concatenate(parts))]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["block", "n_tokens", "doc_ids", "held", "lengths", "words", "tokens"])

        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                own: list[int] = []
                for doc_id, out, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts_as_bytes(some.column(2))):
                    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
                    own += [numbers.setdefault(w, len(numbers) + 1) for w in words]
                    own.append(0)
                    ids.append(doc_id), held_out.append(out), lengths.append(len(words) + 1)
                parts.append(np.array(own, "<i4"))
                total += len(own)
                if total >= BLOCK_TOKENS:
                    yield row()
                    count += 1
                    numbers, ids, held_out, lengths, parts, total = {}, [], [], [], [], 0
        if lengths:
            yield row()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _asks(block: int, keys: np.ndarray, counts: np.ndarray, order: np.ndarray, buckets: int) -> pa.RecordBatch:
    keys, counts = keys[order], counts[order]
    at = bucket_bounds(keys, buckets)
    full = [b for b in range(buckets) if at[b] < at[b + 1]]
    cut = [slice(at[b], at[b + 1]) for b in full]
    columns = [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([squeeze_sorted(keys[c]) for c in cut], pa.binary()), pa.array([squeeze(counts[c].astype("<i8")) for c in cut], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "keys", "counts"])


def ask_words(stored: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row)
            yield _asks(row["block"], b.words, b.count_words(), b.word_order, buckets)

    return stored.mapInArrow(run, ASK_SCHEMA)


def ask_pairs(stored: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row)
            b.find_pairs()
            yield _asks(row["block"], b.keys, b.count_pairs(), b.pair_order, buckets)

    return stored.mapInArrow(run, ASK_SCHEMA)


def answers(asks: DataFrame, buckets: int) -> DataFrame:
    """A bucket's part of a count table, as each block asked for it: 2 * total + 1 if the block owns the n-gram (it is
    the first with a count), else 2 * total.  Rows with a null block hold the bucket's counts of counts (r, n)."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blocks_, bucket = table["block"].to_pylist(), table["bucket"][0].as_py()
        keys, counts = [expand_sorted(x.as_py()) for x in table["keys"]], [expand(x.as_py(), "<i8") for x in table["counts"]]
        ends = np.cumsum([len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.concatenate(counts)
        total = np.bincount(at, own, len(distinct)).astype(np.int64)
        has = np.flatnonzero(own > 0)
        _, first = np.unique(at[has], return_index=True)
        owner = np.zeros(len(own), np.int64)
        owner[has[first]] = 1
        back = np.split(2 * total[at] + owner, ends[:-1])
        r, n = np.unique(total[total > 0], return_counts=True)
        columns = [[*blocks_, None], [bucket] * (len(back) + 1), [*map(squeeze, back), None], [None] * len(back) + [r.tolist()], [None] * len(back) + [n.tolist()]]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "bucket", "totals", "r", "n"])

    return _dealt(asks, "bucket", buckets).applyInArrow(merge, ANSWER_SCHEMA)


class Discount:
    """Good-Turing discounts: d(r) for a count r, from the counts of counts n_1 to n_{FITTED + 1}."""

    def __init__(self, counts: dict[int, int]) -> None:
        known = sorted(r for r in counts if r <= FITTED and counts[r] > 0)
        slope = DEFAULT_SLOPE
        if len(known) >= 3:
            # each n_r is spread over the gap to its neighbours before the line is fitted
            lows, highs = [0, *known[:-1]], [*known[1:], 2 * known[-1] - known[-2]]
            z = [2 * counts[r] / (b - a) for r, a, b in zip(known, lows, highs)]
            x, y = np.log(known), np.log(z)
            fit = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
            slope = fit if fit < -1.05 else DEFAULT_SLOPE
        self.slope = slope
        self.turing = {}
        for r in range(1, TURING + 1):
            if counts.get(r) and counts.get(r + 1) and 0 < (d := (r + 1) * counts[r + 1] / (r * counts[r])) < 1:
                self.turing[r] = d

    def __call__(self, r: np.ndarray) -> np.ndarray:
        d = (1 + 1 / np.maximum(r, 1)) ** (1 + self.slope)
        for k, v in self.turing.items():
            d = np.where(r == k, v, d)
        return d


def discounted(r: Column, slope: float, turing: dict[int, float]) -> Column:
    """A discount times its count, as a column."""
    d = F.pow(1 + 1 / r, F.lit(1 + slope))
    for k, v in turing.items():
        d = F.when(r == k, F.lit(float(v))).otherwise(d)
    return d * r


def _counts_of_counts(table: DataFrame) -> tuple[Discount, DataFrame]:
    """The discount, and the rows (r, n) that it came from; only n_r of small r reach the driver."""
    rows = table.where("block IS NULL").select(F.explode(F.arrays_zip("r", "n")).alias("x")).groupBy(F.col("x.r").alias("r")).agg(F.sum("x.n").alias("n"))
    return Discount({x["r"]: x["n"] for x in rows.where(F.col("r") <= FITTED + 1).collect()}), rows


def _dealt(rows: DataFrame, key: str, groups: int):
    """Groups by ``key``, in twice as many tasks as there are groups, so that few share one (or shuffle partitions, if more)."""
    return rows.repartition(max(2 * groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key).groupBy(key)


class Model:
    """Totals and discounts, small enough to travel with a task."""

    FIELDS = "tokens long, types long, unknown double, word_slope double, word_turing map<long, double>, pair_slope double, pair_turing map<long, double>"

    def __init__(self, tokens: int, types: int, unknown: float, words: Discount, pairs: Discount) -> None:
        self.tokens, self.types, self.unknown, self.words, self.pairs = tokens, types, unknown, words, pairs

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words with training counts ``c``."""
        return np.where(c > 0, self.words(c) * c / max(1, self.tokens), self.unknown)

    def row(self) -> tuple:
        return self.tokens, self.types, float(self.unknown), float(self.words.slope), self.words.turing, float(self.pairs.slope), self.pairs.turing

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _first_pass(model: Model, buckets: int):
    """Kernel of a block with its totals: scores but for backoff weights, and what the weights need."""

    def score(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row = next(x for x in rows if x["tokens"] is not None)
        b = Block(row)
        del table
        row["words"] = row["tokens"] = None
        b.find_pairs()
        total = {}
        for kind, size, order in (("w", len(b.words), b.word_order), ("p", len(b.keys), b.pair_order)):
            parts = sorted((x["bucket"], x["totals"]) for x in rows if x["kind"] == kind)
            total[kind], at = np.empty(size, np.int64), 0
            for _, x in parts:
                part = expand(x, "<i8")
                total[kind][order[at : at + len(part)]] = part
                at += len(part)
        c = total["w"] >> 1
        history = np.append(c, c[0])  # the begin of a document is a history as often as its end is a token
        r, owned = total["p"] >> 1, (total["p"] & 1) == 1
        uni = model.unigram(c)
        seen = r > 0
        kept = model.pairs(r) * r
        lp = np.where(seen, np.log10(np.where(seen, kept, 1) / np.maximum(history[b.first], 1)), np.log10(uni)[b.second])
        sums = lambda x: np.add.reduceat(x, b.starts)
        waits = (~seen & (history[b.first] > 0))[b.pair]
        asked, waits_for = np.unique(b.first[b.pair[waits]], return_inverse=True)
        hashes = np.append(b.words, BEGIN_HASH)
        n = len(hashes)
        mass, lower = np.bincount(b.first[owned], kept[owned], n), np.bincount(b.first[owned], uni[b.second[owned]], n)
        own = np.flatnonzero(np.bincount(b.first[owned], minlength=n))
        own, need = own[np.argsort(hashes[own])], np.argsort(hashes[asked])
        own_at, need_at = bucket_bounds(hashes[own], buckets), bucket_bounds(hashes[asked][need], buckets)
        place = np.empty(len(need), np.int64)
        place[need] = np.arange(len(need))  # weights come back in the order of the hashes
        docs = [row["block"], None, row["doc_ids"], row["held"], row["lengths"], squeeze(sums((c > 0)[b.tokens].astype(np.int64))), squeeze(sums(model.base(c)[b.tokens])), squeeze(sums(lp[b.pair])), squeeze(b.doc[waits].astype("<i4")), squeeze(place[waits_for].astype("<i4")), *[None] * 5]
        out = [docs]
        for k in range(buckets):
            mine, asks = own[own_at[k] : own_at[k + 1]], hashes[asked][need[need_at[k] : need_at[k + 1]]]
            if len(mine) or len(asks):
                out.append([row["block"], k, *[None] * 8, squeeze_sorted(asks), squeeze_sorted(hashes[mine]), squeeze(mass[mine]), squeeze(lower[mine]), squeeze(history[mine])])
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 11]
        names = [x.split()[0] for x in PART_SCHEMA.split(", ")]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return score


def _weights(table: pa.Table) -> pa.Table:
    """Kernel of a bucket of histories: their exact weights (log10), for the blocks that ask."""
    rows = [x for x in table.sort_by("block").to_pylist()]
    keys = [expand_sorted(x["own"]) for x in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    add = lambda name: np.bincount(at, np.concatenate([expand(x[name], "<f8") for x in rows]), len(distinct))
    seen = np.zeros(len(distinct), np.int64)
    seen[at] = np.concatenate([expand(x["seen"], "<i8") for x in rows])
    weight = np.log10(np.maximum((1 - add("mass") / np.maximum(seen, 1)) / np.maximum(1 - add("lower"), 1e-300), 1e-300))
    asks = [(x["block"], expand_sorted(x["need"])) for x in rows]
    back = [(block, rows[0]["bucket"], squeeze(weight[np.searchsorted(distinct, need)])) for block, need in asks if len(need)]
    columns = list(zip(*back)) or [[], [], []]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], names=["block", "bucket", "weights"])


def _last_pass(table: pa.Table) -> pa.Table:
    """Kernel of a block with its weights: the scores of its documents."""
    rows = table.to_pylist()
    row = next(x for x in rows if x["doc_ids"] is not None)
    weights = [expand(x["weights"], "<f8") for x in sorted((x for x in rows if x["weights"] is not None), key=lambda x: x["bucket"])]
    doc, waits = expand(row["waits_doc"], "<i4"), expand(row["waits_for"], "<i4")
    more = np.bincount(doc, np.concatenate(weights)[waits], len(row["doc_ids"])) if len(doc) else 0.0
    columns = [row["doc_ids"], row["held"], expand(row["lengths"], "<i4").astype(np.int64), expand(row["known"], "<i8"), expand(row["base"], "<f8"), expand(row["partial"], "<f8") + more]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", save: str | None = None) -> DataFrame:
    """Trains on the rows where ``held`` is false, and scores all whole texts (log10 probabilities).  The model's tables
    are stored in the folder ``save``, if one is given."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    stored = written(blocks(docs, F.coalesce(held, F.lit(False)), id_col, text_col), "blocks", folder, packed=True)
    size = stored.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    stored = stored.drop("n_tokens")
    buckets = max(1, math.ceil(size["tokens"] / BUCKET_TOKENS))
    words = written(answers(ask_words(stored, buckets), buckets), "unigrams", folder, packed=True)
    word_discount, word_counts = _counts_of_counts(words)
    kept = discounted(F.col("r").cast("double"), word_discount.slope, word_discount.turing)
    sums = word_counts.agg(F.sum(F.col("r") * F.col("n")).alias("tokens"), F.sum("n").alias("types"), F.sum(kept * F.col("n")).alias("kept")).first()
    tokens, types = sums["tokens"] or 0, sums["types"] or 0
    unknown = 1 - sums["kept"] / tokens if tokens else 1.0
    pairs = written(answers(ask_pairs(stored, buckets), buckets), "bigrams", folder, packed=True)
    pair_discount, _ = _counts_of_counts(pairs)
    model = Model(tokens, types, unknown, word_discount, pair_discount)

    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.where("block IS NOT NULL").select("block", F.lit(name).alias("kind"), "bucket", "totals")

    with_totals = stored.unionByName(kind(words, "w").unionByName(kind(pairs, "p")), allowMissingColumns=True)
    parts = written(_dealt(with_totals, "block", size["blocks"]).applyInArrow(_first_pass(model, buckets), PART_SCHEMA), "parts", folder, packed=True)
    asks = parts.where("bucket IS NOT NULL").select("block", "bucket", "need", "own", "mass", "lower", "seen")
    weights = written(_dealt(asks, "bucket", buckets).applyInArrow(_weights, "block long, bucket int, weights binary"), "weights", folder, packed=True)
    if save:
        _store(model, with_totals, size["blocks"], save)
    waiting = parts.where("bucket IS NULL").select("block", "doc_ids", "held", "lengths", "known", "base", "partial", "waits_doc", "waits_for")
    scored = _dealt(waiting.unionByName(weights, allowMissingColumns=True), "block", size["blocks"]).applyInArrow(_last_pass, SCORE_SCHEMA)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


# the model as plain tables


def _listed(table: pa.Table) -> pa.Table:
    """Kernel of a block with its totals: the bigrams that it owns, as (history, word, count)."""
    rows = table.to_pylist()
    b = Block(next(x for x in rows if x["tokens"] is not None))
    b.find_pairs()
    total = np.empty(len(b.keys), np.int64)
    total[b.pair_order] = np.concatenate([expand(x, "<i8") for _, x in sorted((x["bucket"], x["totals"]) for x in rows if x["kind"] == "p")])
    own, hashes = np.flatnonzero(total & 1), np.append(b.words, BEGIN_HASH).view(np.int64)
    return pa.table({"history": hashes[b.first[own]], "word": hashes[b.second[own]], "count": total[own] >> 1})


def _store(model: Model, with_totals: DataFrame, blocks_: int, folder: str) -> None:
    spark = with_totals.sparkSession
    spark.createDataFrame([model.row()], Model.FIELDS).write.mode("overwrite").parquet(f"{folder}/totals")
    listed = _dealt(with_totals, "block", blocks_).applyInArrow(_listed, "history long, word long, count long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed.repartition(max(parts, blocks_), "history", "word").write.mode("overwrite").parquet(f"{folder}/bigrams")
    bigrams = spark.read.parquet(f"{folder}/bigrams")
    # each token ends one bigram, so the counts of words are sums of bigrams'
    bigrams.groupBy("word").agg(F.sum("count").alias("count")).write.mode("overwrite").parquet(f"{folder}/unigrams")
    unigrams = spark.read.parquet(f"{folder}/unigrams")
    uni = discounted(F.col("c").cast("double"), model.words.slope, model.words.turing) / max(1, model.tokens)
    kept = discounted(F.col("count").cast("double"), model.pairs.slope, model.pairs.turing)
    rows = bigrams.join(unigrams.withColumnRenamed("count", "c"), "word").select("history", "count", kept.alias("kept"), uni.alias("uni"))
    sums = rows.groupBy("history").agg(F.sum("count").alias("seen"), F.sum("kept").alias("mass"), F.sum("uni").alias("lower"))
    weight = F.log10(F.greatest((1 - F.col("mass") / F.col("seen")) / F.greatest(1 - F.col("lower"), F.lit(1e-300)), F.lit(1e-300)))
    sums.select("history", "seen", weight.alias("weight")).write.mode("overwrite").parquet(f"{folder}/weights")


def score_stored(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, score) of every whole text with the model that ``score`` stored in ``folder``: each
    distinct bigram of a text is looked up once, then its history's weight and its word's count where it isn't there.
    DataFrame functions only; frequent words meet their rows of the tables in joins that Spark may split."""
    spark = docs.sparkSession
    t = spark.read.parquet(f"{folder}/totals").first()
    bigrams, unigrams, weights = (spark.read.parquet(f"{folder}/{n}") for n in ("bigrams", "unigrams", "weights"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = written(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), "texts")  # numbers that a retry keeps
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    ends = lambda n: F.array(F.lit(int(n)).cast("long"))
    pairs = F.arrays_zip(F.concat(ends(BEGIN_HASH), words).alias("history"), F.concat(words, ends(END_HASH)).alias("word"))
    asked = rows.select("row", F.explode(pairs).alias("p")).groupBy("row", F.col("p.history").alias("history"), F.col("p.word").alias("word")).agg(F.count("*").alias("n"))
    c, r = F.coalesce(F.col("c"), F.lit(0)), F.col("count")
    uni = F.when(c > 0, discounted(c.cast("double"), t["word_slope"], t["word_turing"]) / max(1, t["tokens"])).otherwise(F.lit(t["unknown"]))
    seen = discounted(r.cast("double"), t["pair_slope"], t["pair_turing"]) / F.col("seen")
    lp = F.when(r.isNotNull(), F.log10(seen)).otherwise(F.coalesce("weight", F.lit(0.0)) + F.log10(uni))
    looked = asked.join(bigrams, ["history", "word"], "left").join(unigrams.withColumnRenamed("count", "c"), "word", "left").join(weights, "history", "left")
    sums = looked.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * lp).alias("score"))
    return rows.select("doc_id", "row").join(sums, "row").select("doc_id", "n_tokens", "n_known", "score")
