"""Quality rules with cross-document line frequency; DataFrame functions only.

Rules on a text alone: counts of words, characters, symbols, repeated lines and repeated three-word windows.  Across
documents: lines are normalised (lower case, digit runs as 0, white space collapsed) and hashed; a line is
boilerplate, and is removed, if it stands in more than ``max_percent`` of its host's distinct documents and in more than
``min_docs`` of them; a document that loses more than ``max_removed_percent`` of its words to that is depleted and
rejected.  Documents are told apart by the hash of their whole text: exact copies count as one document, so that a group
of copies doesn't make its own text boilerplate (removing copies is for near-duplicate stages), and texts that differ in
anything are different documents.  Lines count whatever their length: a passage that fills one line is a line.

Per-line rows are pre-aggregated before each shuffle, first to distinct (host, line, document), so a line or host that
holds a third of all rows spreads over its documents.  The texts themselves are never shuffled by the query, but for
those that a line is removed from.

Defined results: null text has no words and fails the base rules; a null host is the empty host; rows are told apart by
id, host and text together, so repeated ids with different texts are judged apart and repeated rows alike; other
columns pass through ``clean`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm import bloom
from voxloom.llm.common import shared_dir, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate above this share of its host's distinct documents, and above so many of them.
MAX_PERCENT, MIN_DOCS = 1, 10
MAX_REMOVED_PERCENT = 70
SALTS = 64
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

#: Of each line with words: the hash of its normal form, and its words.
_LINES = r"""
filter(transform(split(text, '\n', -1), l -> struct(
    xxhash64(trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0'), '[\\x20\\x09-\\x0D]+', ' '))) AS h,
    size(filter(split(l, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')) AS n)), x -> x.n > 0)
"""


def _without(text: str, chars: str) -> str:
    out = text
    for c in chars:
        out = f"replace({out}, '{c}', '')"
    return out


def _fenced(sql: str) -> Column:
    """The expression as an array that filters above don't get pushed through: inlined into a lambda, it would be
    evaluated anew for each element.  Expressions that depend on the partition's number are never moved."""
    return F.expr(f"if(spark_partition_id() < 0, NULL, {sql})")


def text_features(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the column ``text`` (not null)."""
    spaces = "".join(rf"\u{ord(c):04x}" for c in " \t\n\x0b\x0c\r")
    bare = f"translate(text, '{spaces}', '')"
    first = docs.withColumns(
        {
            "__w": _fenced(r"filter(split(text, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')"),
            "word_chars": F.expr(f"cast(length({bare}) as bigint)"),
            "n_symbols": F.expr(f"cast(length(text) - length({_without('text', SYMBOLS)}) as bigint)"),
            "__l": _fenced(r"filter(split(text, '\n', -1), l -> trim(BOTH ' \t\n\u000b\u000c\r' FROM l) <> '')"),
        }
    )
    second = first.withColumns(
        {
            "n_words": F.expr("cast(size(__w) as bigint)"),
            "n_dup_lines": F.expr("cast(size(__l) - size(array_distinct(__l)) as bigint)"),
            # windows of three words, equal ones side by side
            "__s": _fenced("if(size(__w) < 3, array(), sort_array(transform(sequence(0, size(__w) - 3), i -> struct(xxhash64(__w[i], __w[i + 1], __w[i + 2]) AS h, i AS p))))"),
        }
    ).drop("__w", "__l")
    third = second.withColumn("__d", _fenced("sort_array(transform(filter(__s, (x, i) -> (i > 0 AND x.h = get(__s, i - 1).h) OR x.h = get(__s, i + 1).h), x -> x.p))")).drop("__s")
    covered = "aggregate(transform(__d, (p, i) -> least(3, coalesce(get(__d, i + 1) - p, 3))), 0L, (a, b) -> a + b)"
    return third.withColumn("n_repeat_words", F.expr(covered)).drop("__d")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Text and host without nulls, and two hashes by which rows are told apart."""
    return docs.withColumns({"__text": F.coalesce(F.col(text_col).cast("string"), F.lit("")), "__host": F.coalesce(F.col(host_col).cast("string"), F.lit(""))}).withColumns(
        {"__k1": F.xxhash64(F.col(id_col), F.col(host_col), F.col(text_col)), "__k2": F.hash(F.col(text_col), F.col(id_col), F.col(host_col))}
    )


def removed_lines(docs: DataFrame, folder: str, max_percent: int = MAX_PERCENT, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(__k1, __k2, lines, removed_words) for each document with boilerplate: the hashes of its lines above the limits,
    and the words that go with them."""
    own = _keyed(docs.select(id_col, text_col, host_col), id_col, text_col, host_col)
    lines = own.select("__k1", "__k2", "__host", F.col("__text").alias("text"), F.xxhash64("__text").alias("doc")).withColumn("__lines", _fenced(_LINES)).drop("text")
    rows = lines.select("__k1", "__k2", "__host", F.posexplode("__lines").alias("pos", "x"))
    rows = rows.select("__k1", "__k2", "__host", "pos", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    # a row of each document that stands for its host, without a line, counts the host's documents on the way
    of_host = lines.select("__host", "doc", F.explode(F.expr("if(size(__lines) = 0, array(), concat(array(cast(null AS bigint)), transform(__lines, x -> x.h)))")).alias("h"))
    counts = written(of_host.distinct().groupBy("__host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs), "line-counts", folder)
    hosts = counts.where("h IS NULL").select("__host", F.col("docs").alias("__all"))
    frequent = counts.where("h IS NOT NULL").join(hosts, "__host").where(F.col("docs") * 100 > F.col("__all") * max_percent).select("__host", "h")
    # most lines are no boilerplate: a Bloom filter spares them the shuffle.  A frequent line may stand in a third of all
    # documents: its rows meet it in as many places as there are salts
    frequent = written(frequent, "frequent-lines", folder)
    rows = bloom.mark(rows, F.xxhash64("__host", "h"), bloom.build(frequent, F.xxhash64("__host", "h"), frequent.count())).where("__hit").drop("__hit")
    salted = frequent.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = rows.select("__k1", "__k2", "__host", "pos", "h", "n", F.pmod("__k2", F.lit(SALTS)).alias("__salt")).join(salted, ["__host", "h", "__salt"])
    hit = found.select("__k1", "__k2", "pos", "h", "n").distinct()  # equal rows count once
    return hit.groupBy("__k1", "__k2").agg(F.collect_set("h").alias("lines"), F.sum("n").alias("removed_words"))


def _measured(docs: DataFrame, names: list[str], limits: tuple[int, int, int], id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The columns ``names`` and the features of every row, base_failed, removed_words and kept.  The documents with
    boilerplate are a table of their own."""
    folder, (max_percent, min_docs, max_removed_percent) = shared_dir(docs.sparkSession), limits
    removed = written(removed_lines(docs, folder, max_percent, min_docs, id_col, text_col, host_col), "removed-lines", folder)
    keyed = _keyed(docs, id_col, text_col, host_col).drop("__host").withColumnRenamed(text_col, "__was").withColumnRenamed("__text", "text")
    # few documents have boilerplate: a Bloom filter of their keys spares the others the shuffle
    marked = bloom.mark(keyed, F.col("__k1"), bloom.build(removed, F.col("__k1"), removed.count()))
    features = lambda rows: text_features(rows).withColumn("base_failed", base_failed()).select(*names, "__k1", "__k2", *FEATURES, "base_failed")
    exact = features(marked.where("__hit")).join(removed, ["__k1", "__k2"], "left")
    clear = features(marked.where("NOT __hit")).withColumns({"lines": F.lit(None).cast("array<bigint>"), "removed_words": F.lit(None).cast("long")})
    depleted = F.coalesce(F.col("removed_words"), F.lit(0)) * 100 > F.col("n_words") * max_removed_percent
    return exact.unionByName(clear).select(*names, *FEATURES, "base_failed", "lines", "removed_words", (~F.col("base_failed") & ~depleted).alias("kept"))


def judge(docs: DataFrame, max_percent: int = MAX_PERCENT, min_docs: int = MIN_DOCS, max_removed_percent: int = MAX_REMOVED_PERCENT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row per document: its features, base_failed, kept and removed_words."""
    rows = _measured(docs.select(id_col, text_col, host_col), [id_col], (max_percent, min_docs, max_removed_percent), id_col, text_col, host_col)
    return rows.select(F.col(id_col).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"))


def clean(docs: DataFrame, max_percent: int = MAX_PERCENT, min_docs: int = MIN_DOCS, max_removed_percent: int = MAX_REMOVED_PERCENT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The kept rows of ``docs`` without their boilerplate lines; ``chars_col`` follows where it is not null."""
    # columns go by number, so that none clashes with the names used here
    safe = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    of = dict(zip(docs.columns, safe.columns))
    names = ["__was" if c == text_col else of[c] for c in docs.columns]
    rows = _measured(safe, names, (max_percent, min_docs, max_removed_percent), of[id_col], of[text_col], of[host_col]).where("kept")
    line_hash = "xxhash64(trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0'), '[\\\\x20\\\\x09-\\\\x0D]+', ' ')))"
    left = F.expr(f"if(lines IS NULL, __was, array_join(filter(split(__was, '\\n', -1), l -> NOT array_contains(lines, {line_hash})), '\\n'))")
    rows = rows.withColumn("__new", F.when(F.spark_partition_id() < 0, F.lit(None)).otherwise(left))
    changed = lambda c: F.when(F.col("lines").isNull() | F.col(of[c]).isNull(), F.col(of[c])).otherwise(F.length("__new").cast(docs.schema[c].dataType))
    return rows.select(*[(F.col("__new") if c == text_col else changed(c) if c == chars_col else F.col(of[c])).alias(c) for c in docs.columns])
