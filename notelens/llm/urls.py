"""Operator 2: judging URLs by rules and by a list of canonical URLs.

The listed URLs fill a blocked Bloom filter: a URL's hash chooses one block of four
64-bit words and a bit in each word. A page whose bits are all set is a possible hit;
only possible hits are shuffled, to an exact hash join with the list, which removes
the false ones. All other pages are judged where they are. The filter's number of
blocks follows the list up to ``MAX_BLOCKS`` (about 2.5 MB), so its broadcast is
bounded; past that the filter passes more pages to the join, and results stay the same.
The join's sides are the written list and the pages, so that adaptive execution can
split a URL that very many pages carry.

Rules come first: a rule has a host, a path and a verdict, fits its host and all
subdomains and the paths that start with its path, and the longest that fits wins
(of equally long ones the one with the longer host, then the first). Without a
rule the verdict is ``block`` for listed URLs and ``allow`` for others.

Canonical: no scheme, query, fragment, port, leading ``www.`` or ``m.``, ending
``.html`` or slashes at the end; host in lower case. Null URLs and those without
``://`` have an empty host and path, are never listed, and are allowed. Repeated rows
are judged each; null, repeated or empty list entries do no harm. Outputs replace kept
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.llm.tables import staged

MAX_BLOCKS = 1 << 16
#: Listed URLs meant for a block of 256 bits.
PER_BLOCK = 16
LANES = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One spelling for the URLs of a page; null for an empty host."""
    bare = F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), r"^(www|m)\.", "")
    cut = F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"\.html$", "")
    return F.when(F.length(bare) > 0, F.concat(bare, cut))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    own = (host == rule.host) | host.endswith("." + rule.host)
    return own & path.startswith(rule.path)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The winning rule, written host and path, and its verdict; null where none fits. Rules are few: they stand in the plan."""
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host)))
    name = verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        fits = _fits(rule, host, path)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(blocks)).cast("int")


def _bits(url: Column) -> list[Column]:
    """A bit in each of the block's words, from six bits of a second hash each."""
    h = F.xxhash64(url, F.lit(2))
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftright(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(LANES)]


def bloom_filter(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """The filled blocks, (block, w0 to w3); blocks without a listed URL are left out."""
    bits = listed.select(_block(F.col(url), blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col(url)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(LANES)])


def possible_hits(urls: DataFrame, url: str, filled: DataFrame, blocks: int) -> DataFrame:
    """``urls`` with ``possible``: whether the filter holds the URL. ``filled`` has ``MAX_BLOCKS`` short rows at most."""
    probed = urls.withColumn("_block", _block(F.col(url), blocks)).join(
        F.broadcast(filled.withColumnRenamed("block", "_block")), "_block", "left")
    held = F.lit(True)
    for k, bit in enumerate(_bits(F.col(url))):
        held = held & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    return probed.withColumn("possible", F.coalesce(held, F.lit(False))).drop("_block", *[f"w{k}" for k in range(LANES)])


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The kept columns, ``host``, ``path``, ``rule``, ``listed`` and ``verdict``; ``listed`` has a column ``canonical``."""
    new = ("host", "path", "rule", "listed", "verdict")
    names = [n for n in keep if n not in new]
    entries = staged(listed.select("canonical").filter("canonical is not null and canonical <> ''").distinct(), "listed-urls")
    blocks = 1
    wanted = min(MAX_BLOCKS, entries.count() // PER_BLOCK + 1)
    while blocks < wanted:
        blocks *= 2
    filled = bloom_filter(entries, "canonical", blocks)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parts = pages.select(F.struct(*names).alias("_kept"), host.alias("_host"), path.alias("_path"))
    name, verdict = ruled(F.col("_host"), F.col("_path"), rules)
    parts = parts.select("_kept", "_host", "_path", name.alias("_rule"), verdict.alias("_verdict"),
                         canonical(F.col("_host"), F.col("_path")).alias("_url"))
    probed = possible_hits(parts, "_url", filled, blocks)
    found = entries.select(F.col("canonical").alias("_url"), F.lit(True).alias("_listed"))
    hits = probed.filter("possible").join(found, "_url", "left")
    rest = probed.filter(~F.col("possible")).withColumn("_listed", F.lit(False))
    every = hits.unionByName(rest).withColumn("_listed", F.coalesce("_listed", F.lit(False)))
    own = F.when(F.col("_listed"), "block").otherwise("allow")
    return every.select(
        *[F.col("_kept").getField(n).alias(n) for n in names], F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule").alias("rule"), F.col("_listed").alias("listed"), F.coalesce("_verdict", own).alias("verdict"))
