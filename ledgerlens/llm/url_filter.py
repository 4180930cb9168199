"""URL filtering: a blocked Bloom filter of the listed entries, then an exact join.

A listed entry is a host and a path. It fits every URL of that host or of a subdomain whose path starts with the
entry's. So a URL can only meet the keys made of a suffix of its host with as many labels as a listed host has, and a
prefix of its path as long as a listed path. These keys are tested in a Bloom filter whose blocks are 64-bit words; the keys that pass
are joined with the list, which removes the false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import own_name
from ledgerlens.scratch import save
from ledgerlens.skew import broadcast_if_small

BITS_PER_ENTRY, HASHES = 16, 4
# at most so many words are ever sent to every executor: two megabytes of filter
MAX_WORDS = 2**18
# different lengths of listed paths, and label counts of listed hosts, that are tried key by key; entries of other
# lengths or with more labels are joined by a suffix of the host
MAX_LENGTHS = 256


def url_host(url: Column) -> Column:
    """From behind the first ``://`` to the next ``/``, ``?`` or ``#``, with A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _word(host: Column, path: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(words))


def _mask(host: Column, path: Column) -> Column:
    """``HASHES`` bits of one 64-bit word, from a second hash."""
    h = F.xxhash64(path, host, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(HASHES)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def _labels(host: str) -> Column:
    return F.size(F.split(host, r"\."))


def _suffix(host: str, labels: Column) -> Column:
    """The last ``labels`` labels of a host."""
    return F.call_function("substring_index", F.col(host), F.lit("."), -labels)


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; a taken name gets underscores in front.

    ``listed`` has host, path and verdict, and may be of any size; entries with nulls are ignored, and of equal entries
    with different verdicts the smaller verdict holds. Among the entries that fit a URL the longest (host and path
    together) wins, then the one with the longer host. ``rule`` is that entry's host and path, else null, and
    the verdict then ``default``. A null URL, or one without ``://``, has an empty host and path, which no entry fits.
    Repeated rows are judged alike; empty tables are fine.
    """
    rules = listed.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> ''")
    rules = save(rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")), "listed")
    entries = rules.count()
    words = min(MAX_WORDS, 2 ** math.ceil(math.log2(max(1, entries * BITS_PER_ENTRY / 64))))
    rules = rules.withColumn("_labels", _labels("host"))
    lengths = sorted(r["v"] for r in rules.groupBy(F.length("path").alias("v")).count().orderBy(F.desc("count"), "v").limit(MAX_LENGTHS).collect())
    counts = sorted(r["v"] for r in rules.select(F.col("_labels").alias("v")).distinct().orderBy("v").limit(MAX_LENGTHS).collect())
    most = max(counts, default=0)
    rest = rules.where(~F.length("path").isin(lengths) | (F.col("_labels") > most))
    others = rest.count()
    bloom = rules.groupBy(_word(F.col("host"), F.col("path"), words).alias("_word")).agg(
        F.bit_or(_mask(F.col("host"), F.col("path"))).alias("_bits"))

    host, path, rule, verdict = (own_name(pages, n) for n in ("host", "path", "rule", "verdict"))
    # the page travels as one struct, so none of its columns can clash
    judged = pages.select(
        F.struct(*pages.columns).alias("page"), url_host(F.col(url)).alias("page_host"), url_path(F.col(url)).alias("page_path"))
    # every different host and path once, however many pages it has
    places = judged.where("page_host <> ''").select(
        F.col("page_host").alias("_host"), F.col("page_path").alias("_path")).distinct()
    # a host of very many labels gives no more suffixes than there are listed label counts
    fitting = F.filter(F.array(*[F.lit(n) for n in counts]).cast("array<int>"), lambda n: n <= F.col("_labels"))
    suffixes = F.transform(fitting, lambda n: _suffix("_host", n))
    places = places.withColumn("_labels", _labels("_host"))
    cuts = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("_path"))
    keys = places.select("_host", "_path", F.explode(suffixes).alias("host"), cuts.alias("_cuts")).select(
        "_host", "_path", "host", F.explode("_cuts").alias("_cut")).select(
        "_host", "_path", "host", F.substring(F.col("_path"), F.lit(1), F.col("_cut")).alias("path"))
    keys = keys.withColumn("_word", _word(F.col("host"), F.col("path"), words)).withColumn(
        "_mask", _mask(F.col("host"), F.col("path")))
    possible = keys.join(F.broadcast(bloom), "_word").where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    # the hit keys of hot hosts are combined to one row for each URL before the last join
    found = ["_host", "_path", "host", "path", "verdict"]
    hits = possible.join(broadcast_if_small(rules, entries), ["host", "path"]).select(*found)
    if others:
        keyed = rest.withColumn("_key", _suffix("host", F.least("_labels", F.lit(most)))).drop("_labels")
        hits = hits.union(places.select("_host", "_path", F.explode(suffixes).alias("_key")).join(keyed, "_key").where(
            ((F.col("_host") == F.col("host")) | F.endswith("_host", F.concat(F.lit("."), "host"))) & F.startswith("_path", "path"),
        ).select(*found))
    best = hits.groupBy("_host", "_path").agg(F.max(F.struct(
        (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("m"),
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"))).alias("_best"))
    judged = judged.join(best, (F.col("page_host") == F.col("_host")) & (F.col("page_path") == F.col("_path")), "left")
    return judged.select(
        "page.*", F.col("page_host").alias(host), F.col("page_path").alias(path), F.col("_best.rule").alias(rule),
        F.coalesce("_best.verdict", F.lit(default)).alias(verdict))
