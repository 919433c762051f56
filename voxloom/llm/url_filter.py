"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter (module ``bloom``) is built by a partial bit-or per block and broadcast up to a fixed size; for a longer list
there is none, and all URLs go to the exact join.  URLs that pass it go to an exact hash join with the list, which removes the false positives;
all others skip the join.  Everything is DataFrame functions.

Rules (host, path) fit a host and all its subdomains where the URL's path starts with the rule's; the longest fitting
rule decides, else the list.  Defined results: null, or no ``://``, is the empty host and path, which no rule fits and
the list never holds; a null url gets the list's verdict ``allow``; repeated rows give repeated rows; an empty list
blocks nothing; columns other than those named are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm import bloom

TRACKING = ("utm_", "fbclid=", "gclid=", "ref=")
SALTS = 8
Rule = tuple[str, str]


def _after() -> Column:
    """What follows the first ``://`` of the column url."""
    return F.when(F.contains("url", F.lit("://")), F.expr("substr(url, instr(url, '://') + 3)"))


def host() -> Column:
    raw = F.regexp_extract(_after(), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path() -> Column:
    return F.coalesce(F.regexp_extract(_after(), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, path and canonical: host without ``www.``, path without closing slashes, the query's parameters in
    order but for tracking ones; null where there is no host."""
    url = F.col("url")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    track = " AND ".join(f"NOT startswith(p, '{t}')" for t in TRACKING)
    rows = pages if url_col == "url" else pages.withColumn("url", F.col(url_col))
    rows = rows.withColumns({"host": host(), "path": path(), "__q": query})
    kept = F.expr(f"array_join(array_sort(filter(split(coalesce(__q, ''), '&', -1), p -> p <> '' AND {track})), '&')")
    plain = F.concat(F.regexp_replace("host", r"^www\.", ""), F.regexp_replace("path", "/+$", ""))
    return rows.withColumn("__k", kept).withColumn("canonical", F.when(F.col("host") != "", F.when(F.col("__k") == "", plain).otherwise(F.concat(plain, F.lit("?"), "__k")))).drop("__q", "__k")


def decided(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else null; rules are (verdict, host and path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per page: its id, host, path, rule (or null), verdict, canonical and listed (null where a rule decides).

    ``listed`` has a column ``canonical``."""
    keys = listed.where(F.col("canonical").isNotNull()).select("canonical").distinct()
    rule, verdict = decided(rules)
    rows = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))).withColumns({"rule": rule, "__verdict": verdict})
    rows = rows.select("page_id", "host", "path", "rule", "__verdict", "canonical", F.when(F.col("rule").isNull(), F.col("canonical")).alias("__asked"))
    possible = bloom.mark(rows, F.col("__asked"), bloom.build(keys, F.col("canonical"), keys.count())).drop("__asked")
    # a very common URL meets its key in as many places as there are salts; the list is never broadcast
    salted = keys.select("canonical", F.lit(True).alias("listed"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    asked = possible.where("__hit").withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    exact = asked.join(salted.hint("merge"), ["canonical", "__salt"], "left").select("page_id", "host", "path", "rule", "__verdict", "canonical", F.coalesce("listed", F.lit(False)).alias("listed"))
    clear = possible.where("NOT __hit").select("page_id", "host", "path", "rule", "__verdict", "canonical", F.when(F.col("rule").isNull(), F.lit(False)).alias("listed"))
    return exact.union(clear).withColumn("verdict", F.coalesce("__verdict", F.when(F.col("listed"), "block").otherwise("allow"))).drop("__verdict")


def listed_urls(pages: DataFrame, labels: tuple[str, ...], digits: str, url_col: str = "url") -> DataFrame:
    """(canonical): a list for tests and queries.  Of the URLs of ``pages``, those whose host has one of ``labels`` or whose
    MD5 starts with ``digits``; and as many that no page has."""
    rows = with_parts(pages.select(F.col(url_col).cast("string").alias("url")))
    named = F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in labels]))
    own = rows.where(named | F.md5(F.col("canonical").cast("binary")).startswith(digits)).select("canonical").distinct()
    return own.select(F.explode(F.array(F.col("canonical"), F.concat("canonical", F.lit("/#gone")))).alias("canonical"))
