"""Scalar functions on text, sizes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """Line feeds, and one more for a last line without one."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return feeds + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def without_returns(text: Column) -> Column:
    """A text without carriage returns, for comparison."""
    return F.replace(text, F.lit("\r"), F.lit(""))


def is_crlf(text: Column) -> Column:
    """Every line break is a carriage return and a line feed, and there is one."""
    return (F.regexp_count(text, F.lit("\r\n")) > 0) & (F.regexp_count(text, F.lit("(?<!\r)\n")) == 0)


def with_endings(text: Column, crlf: Column) -> Column:
    """A text with one kind of line breaks."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.when(crlf, F.replace(unix, F.lit("\n"), F.lit("\r\n"))).otherwise(unix)


def clip(text: Column, most: int = 240) -> Column:
    """At most so many characters, with dots behind what is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def clip_at(text: Column, at: Column, most: int = 240) -> Column:
    """A window of a long line around the match at a place (from 0), with what is cut on either side."""
    total = F.length(text)
    start = F.least(F.greatest(at - 60, F.lit(0)), total - most)
    after = total - start - most
    window = F.concat(
        F.when(start > 0, F.concat(F.lit("...("), start, F.lit(" chars) "))).otherwise(""),
        F.trim(F.substring(text, start + 1, F.lit(most))),
        F.when(after > 0, F.concat(F.lit(" ...(+"), after, F.lit(" chars)"))).otherwise(""),
    )
    return F.when(total <= most + 20, F.trim(text)).otherwise(window)


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(size / float(1024**power), 1))).otherwise(out)
    return out


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def duration(seconds: Column) -> Column:
    """XmYYs, or Ns below a minute."""
    s = seconds.cast("int")
    return F.when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.concat(s, F.lit("s")))


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 of nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.round(100 * part / whole)).cast("long")


def mask_credentials(text: Column) -> Column:
    """Urls without the user and password before the host."""
    return F.regexp_replace(text, "://[^/@]*@", "://***@")


def like_literal(term: str) -> str:
    """A term whose LIKE wildcards are literal."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters without white space, in lower case."""
    chars = F.split(F.lower(F.regexp_replace(text, r"(?U)\s", "")), "")
    pairs = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, F.lit(1), pairs), F.slice(chars, F.lit(2), pairs), lambda a, b: F.concat(a, b))


def numbered(grams: str) -> Column:
    """The bigrams of a sorted array column, each with the number of its occurrence, so that sets of them are multisets. The array has to
    be a column of its own: an expression would be computed anew for every element."""
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("#"), i - F.array_position(F.col(grams), g)))


def simplify_type(text: Column) -> Column:
    """The type a return type names: in a smart pointer or optional, the last part of a path, capitalised."""
    inner = F.regexp_replace(F.trim(text), r"^.*?(?:shared_ptr|unique_ptr|weak_ptr|sp|RefPtr|[Oo]ptional)<", "")
    return F.nullif(F.regexp_extract(inner, r"(?:^|[^\p{Alnum}_:]|::)(\p{Lu}[\p{Alnum}_]*)(?![\p{Alnum}_]*::)", 1), F.lit(""))


def jni_mangle(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit("_1"))


def canonical_type(name: Column) -> Column:
    """The type that an impl block is for."""
    target = F.trim(F.regexp_extract(name, r"^impl (?:.* for )?([^<]*)", 1))
    return F.when(F.startswith(name, F.lit("impl ")), target).otherwise(name)


def line_of(text: Column, offset: Column) -> Column:
    """The number of the line, from 1, that a place in a text (from 0) is on (X11)."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def break_counts(text: Column) -> Column:
    """struct<crlf, lf>: how many line breaks of each kind a text has; both above 0 is mixed."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    return F.struct(crlf.alias("crlf"), (F.regexp_count(text, F.lit("\n")) - crlf).alias("lf"))


def let(value: Column, use) -> Column:
    """use of a value that is computed once, however often use names it. What use makes is no part of the generated code of a stage, so
    long rules do not make methods that Java does not compile."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
