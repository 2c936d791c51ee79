"""URL filters (operator 10), in DataFrame functions alone.

Rules by host and path come first, the longest that fits decides. What no rule fits is checked against a list of URLs
in canonical form: a blocked Bloom filter of the listed hashes (each URL sets one bit in each of the eight words of one
block) passes possible hits to an exact hash join with the list, which removes the false positives. The filter's size
is set by ``MOST_BLOCKS`` and the length of the list, so it can be broadcast whatever the list; a longer list only
lets more false hits through to the join.

Canonical: scheme, user, port, fragment and the query are dropped, the host is lower-cased and loses a leading www. or
m., the path loses .html and trailing slashes.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, has no canonical form
and is allowed. Repeated rows are judged one by one. Rules of equal length that both fit: the first given decides.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import written

#: (verdict, host and path prefix)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Blocks of 512 bits: 2 ** 18 of them are 16 MB. Bits a listed URL in the mean, as long as the blocks suffice.
MOST_BLOCKS, BITS_A_URL = 2**18, 16
WORDS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without it."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def canonical(url: Column) -> Column:
    """Null where the url has no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@|:\d*$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html$", ""), r"/+$", "")
    return F.when(host != "", F.concat(host, path))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(list(rules)), key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _bits(url: Column) -> list[Column]:
    """One bit for each word of the block."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(i), url), F.lit(64)).cast("int")) for i in range(WORDS)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), url), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block and its words w0..w7, of the column ``listed``; a row for each block that isn't empty."""
    bits = listed.select(_block(F.col("listed"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("listed")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and in_list of each row of ``pages`` (page_id, url).

    ``listed`` has the blocked URLs in its column ``url``, in any form."""
    listed = listed.select(canonical(F.col("url").cast("string")).alias("listed")).where("listed is not null").distinct()
    listed = written(listed, "listed")
    blocks = min(MOST_BLOCKS, max(1, listed.count() * BITS_A_URL // (64 * WORDS)))
    sieve = F.broadcast(bloom(listed, blocks))  # MOST_BLOCKS rows of 72 bytes at most

    url = F.col("url").cast("string")
    pages = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), canonical(url).alias("canon"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("rule", rule).withColumn("ruled", ruled).withColumn("block", _block(F.col("canon"), blocks))
    pages = pages.join(sieve, "block", "left")
    passes = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canon"))):
        passes = passes & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    pages = pages.select("page_id", "host", "path", "rule", "ruled", "canon", F.coalesce(passes, F.lit(False)).alias("maybe"))
    hits = pages.where("maybe").join(listed, F.col("canon") == F.col("listed"), "left").withColumn("in_list", F.col("listed").isNotNull())
    rest = pages.where("not maybe").withColumn("in_list", F.lit(False))
    names = ["page_id", "host", "path", "rule", "ruled", "in_list"]
    out = hits.select(*names).unionByName(rest.select(*names))
    own = F.when(F.col("in_list"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "in_list")
