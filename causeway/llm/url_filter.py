"""URL filtering with DataFrame functions alone: rules by host and path, and a list of URLs
behind a blocked Bloom filter.

The filter is a table of 64-bit blocks. A listed URL sets a few bits of one block; a probed
URL whose bits aren't all set can't be listed and never reaches the exact join. The filter's
size is fixed by a parameter, whatever the list's length, so that it may be broadcast; a longer
list only lets more URLs through to the join, which removes every false hit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm import _bloom
from causeway.llm._io import require

#: Blocks of 64 bits in the filter: 2**17 blocks are 1 MiB of bits.
BLOCKS = 1 << 17

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, with A-Z lower-cased; else ''."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: What closes a path besides slashes, and the character that stands for it while closings are trimmed.
_MARKS = (("/index.html", "\x01"), ("/index.htm", "\x02"), (".html", "\x03"), (".htm", "\x04"))


def without_closing(path_: Column) -> Column:
    """A path without the slashes, index pages and endings that close it, however many: (/|/index.html?|.html?)+ at its end.

    Closings become single characters, which are trimmed: a repeated group of a pattern would need
    a stack as deep as a path has closings. Only paths that hold such characters take the pattern.
    """
    short = path_
    for closing, mark in _MARKS:
        short = F.replace(short, F.lit(closing), F.lit(mark))
    short = F.rtrim(short, F.lit("/" + "".join(mark for _, mark in _MARKS)))
    for closing, mark in _MARKS:
        short = F.replace(short, F.lit(mark), F.lit(closing))
    return F.when(path_.rlike("[\x01-\x04]"), F.regexp_replace(path_, r"(?:/|/index\.html?|\.html?)+$", "")).otherwise(short)


def canonical(url: Column) -> Column:
    """Host and path without scheme, query, fragment, 'www.' or 'm.' and closing slashes or index pages."""
    return F.concat(F.regexp_replace(host(url), r"^(?:www|m)\.", ""), without_closing(path(url)))


def longest_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits (as host + path) and its verdict, both null where none fits.

    rules: (verdict, host, path) by hand, so few that they are part of the plan. A rule fits its
    host and all subdomains if the URL's path starts with the rule's. The longest host + path
    wins; of equally long ones the one with the longer host, then the one listed first.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1][1] + x[1][2]), -len(x[1][1]), x[0]))
    for _, (says, at, prefix) in reversed(ordered):
        fits = ((host_ == F.lit(at)) | host_.endswith(F.lit("." + at))) & path_.startswith(F.lit(prefix))
        name = F.when(fits, F.lit(at + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def mark_listed(df: DataFrame, key: str, listed: DataFrame, listed_key: str, blocks: int = BLOCKS) -> DataFrame:
    """df with `listed` (boolean): whether the key is among the list's.

    Null keys are not listed; null and repeated entries of the list count once or not at all.
    """
    require(df, key)
    require(listed, listed_key)
    names = df.columns
    entries = listed.select(F.col(listed_key).alias("__entry")).where(F.col("__entry").isNotNull()).distinct()
    passed = _bloom.mark(df, key, _bloom.build(entries, "__entry", blocks), blocks, "__pass")
    hits = (
        passed.where("__pass")
        .join(entries, F.col(key) == F.col("__entry"), "left")
        .select(*names, F.col("__entry").isNotNull().alias("listed"))
    )
    return hits.unionByName(passed.where(~F.col("__pass")).select(*names, F.lit(False).alias("listed")))


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, listed_key: str, url: str = "url", carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Judges every row's URL: carry, host, path, rule, listed, verdict (allow or block).

    The rule's verdict holds where a rule fits; otherwise a URL is blocked if its canonical form
    is on the list. A null URL or one without :// has empty host and path, fits no rule and is
    allowed. Rows are kept one for one; other columns than `carry` are left out.
    """
    require(df, url, *carry)
    picked = df.select(*[F.col(c) for c in carry], host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), F.when(F.col(url).contains("://"), canonical(F.col(url))).alias("__key"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = mark_listed(picked.withColumns({"rule": name, "__says": verdict}), "__key", listed, listed_key)
    says = F.coalesce(F.col("__says"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(*carry, "host", "path", "rule", "listed", says.alias("verdict"))
