"""URL filters: host and path rules, and a blocked Bloom filter in front of an exact join. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.llm.staging import written

#: A block is eight 64-bit words; a key sets one bit in each.
WORDS = 8
BITS_PER_KEY = 12
MAX_BLOCKS = 1 << 17
SALTS = 8


class HostRule(NamedTuple):
    """Fits a host and all its subdomains where the path starts with the rule's."""

    host: str
    path: str
    verdict: str


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query of a URL; a null one, or one without ://, has three empty strings.

    The host runs from the first :// to /, ?, # or the end; the path then to ?, # or the end; the query from ? to # or the end.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path, query


def is_junk(html: Column, per_word: float = 0.25) -> Column:
    """Whether the text between the tags has more of ``#*$%|`` than ``per_word`` for each word; null and empty pages are no junk."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")
    symbols = F.length(text) - F.length(F.translate(text, "#*$%|", ""))
    return symbols > per_word * F.size(F.array_remove(F.split(text, r"[ \t-\r]+"), ""))


def canonical_url(host: Column, path: Column, query: Column, dropped: Sequence[str] = ("utm_", "ref=")) -> Column:
    """Host without a leading www. or m., path without a trailing slash, other parameters in order; null for an empty host."""
    kept = F.array_join(
        F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~_any(x.startswith(d) for d in dropped))), "&"
    )
    whole = F.concat(
        F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")
    )
    return F.when(host != "", whole)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def matched_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the longest is tested first, as it is added last
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.host + r.path)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _bits(key: Column) -> list[Column]:
    """Of each word the bit that the key sets: six bits each of a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """A blocked Bloom filter: at most n_blocks rows (block, w0 .. w7), whatever the number of keys."""
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block")
    return keys.select(block, *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))]).groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]
    )


def _probed(rows: DataFrame, key_col: str, keys: DataFrame, key: str, n: int, max_blocks: int) -> tuple[DataFrame, Column]:
    """The rows with the block of a filter of n keys that is theirs, and whether it may hold their key."""
    n_blocks = max(1, min(max_blocks, -(-n * BITS_PER_KEY // (64 * WORDS))))
    blocks = bloom_blocks(keys, key, n_blocks)
    met = F.lit(True)
    for i, b in enumerate(_bits(F.col(key_col))):
        met = met & (F.col(f"w{i}").bitwiseAND(b) != 0)
    return rows.withColumn("block", F.pmod(F.xxhash64(key_col), F.lit(n_blocks))).join(F.broadcast(blocks), "block", "left"), met


def possibly_listed(rows: DataFrame, keys: DataFrame, key: str, n: int, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows whose key is one of n, and few others. A column of the same name and type in both tables; no shuffle of the rows."""
    probed, met = _probed(rows, key, keys, key, n, max_blocks)
    return probed.where(met).select(*rows.columns)


def mark_listed(
    rows: DataFrame, listed: DataFrame, *, key_col: str, listed_col: str, salt_col: str, max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """The rows with a column ``listed``: is the key one of the listed ones?

    The filter is sized by the number of listed keys and never over max_blocks rows of 72 bytes (9 MB at the default), so it may
    be broadcast at any list size; a list beyond that only lets more rows through to the exact join. Rows that the filter
    rules out are done without a shuffle. The exact join is on the key and a salt of the row, so a key with a third of all rows
    is spread over tasks; the list, not the rows, is repeated. The list is written once to the shared folder. Null keys are never listed; repeated list entries count once.
    """
    keys = written(listed.select(F.col(listed_col).alias("_key")).where(F.col("_key").isNotNull()).distinct(), "listed")
    n = keys.count()
    probed, met = _probed(rows, key_col, keys, "_key", n, max_blocks)
    probed = probed.withColumn("_possible", F.coalesce(met & F.col(key_col).isNotNull(), F.lit(False))).drop("block", *[f"w{i}" for i in range(WORDS)])
    out = probed.where(~F.col("_possible")).drop("_possible").withColumn("listed", F.lit(False))
    salted = keys.select(F.col("_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_listed_salt"))
    near = probed.where("_possible").drop("_possible").withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), salt_col), F.lit(SALTS)).cast("int"))
    # Nothing but the filter is broadcast, however small the list.
    exact = near.join(salted.hint("shuffle_hash"), (F.col(key_col) == F.col("_key")) & (F.col("_salt") == F.col("_listed_salt")), "left")
    return out.unionByName(exact.withColumn("listed", F.col("_key").isNotNull()).drop("_key", "_salt", "_listed_salt"))


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[HostRule], *, id_col: str = "page_id", url_col: str = "url",
    listed_col: str = "canonical", max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Host, path, rule, canonical URL, listed and verdict of every page.

    The longest host and path rule that fits decides; where none fits, a page whose canonical URL is listed is blocked and any
    other allowed. ``listed`` holds canonical URLs (see canonical_url). URLs that are null or without :// have empty host and
    path and no canonical URL: allowed. Repeated rows each give a row, null ids too; columns other than id and URL are not read;
    either table may be empty.
    """
    d = with_canonical(pages, id_col, url_col)
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    d = mark_listed(
        d.withColumn("rule", rule).withColumn("_ruled", ruled), listed, key_col="canonical", listed_col=listed_col, salt_col="_id",
        max_blocks=max_blocks,
    )
    return d.select(
        F.col("_id").alias(id_col), "host", "path", "rule", "canonical", "listed",
        F.coalesce("_ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )


def with_canonical(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """Columns _id, host, path, canonical."""
    host, path, query = url_parts(F.col("_url"))
    d = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    d = d.select("_id", host.alias("host"), path.alias("path"), query.alias("_query"))
    return d.select("_id", "host", "path", canonical_url(F.col("host"), F.col("path"), F.col("_query")).alias("canonical"))
