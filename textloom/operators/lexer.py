"""Code without what only looks like code: comments and literals of whole files, across lines, by one scan per file.

A file's text is taken apart by one pattern of its language, whose alternatives are what can start at a place: a comment, a
raw or multi-line string, a string, a character. The leftmost wins, so a quote in a comment opens nothing and a comment sign in a
string starts nothing, whatever lines lie between. What matched is replaced by its quotes and its line breaks, so code keeps
its line numbers. Everything is a Spark function on the text; no alternative repeats a group, which Java's matcher would
recurse into, so strings of any length are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: The last sign of what can be escaped is not behind an odd number of backslashes (of up to 99).
_UNESCAPED = r"(?<=(?<!\\)(?:\\\\){0,49})"


def _quoted(mark: str, lines: bool = False) -> str:
    inside = r"[\s\S]" if lines else r"[^\n]"
    return rf"{mark}(?:{mark}(?!{mark})|{inside}*?(?={mark}){_UNESCAPED}{mark})"


#: What is no code, by kind. An end that is missing is the end of the text; a plain string that does not end on its line is none.
LINE, HASH = r"//[^\n]*", r"#[^\n]*"
BLOCK = r"/\*[\s\S]*?(?:\*/|\z)"
TRIPLE, TRIPLE_SINGLE = r'"""[\s\S]*?(?:"""|\z)', r"'''[\s\S]*?(?:'''|\z)"
DOUBLE, LONG, SINGLE, TICKS = _quoted('"'), _quoted('"', lines=True), _quoted("'"), _quoted("`", lines=True)
CHAR = r"'(?:\\[^\n][^'\n]{0,9}|[^'\\\n])'"
RAW_TICKS = r"`[^`]*(?:`|\z)"
RAW_RUST = r'\bb?r(#{0,16})"[\s\S]*?(?:"\1(?!#)|\z)'
RAW_CPP = r'\b(?:u8|[uUL])?R"([^\s()\\"]{0,16})\([\s\S]*?(?:\)\KEEP"|\z)'
VERBATIM = r'(?:@|\$@|@\$)"(?:"(?!")|[\s\S]*?(?<!")(?:""){0,99}"(?!"))'

TOKENS: dict[str, list[str]] = {
    "Kotlin": [LINE, BLOCK, TRIPLE, DOUBLE, CHAR],
    "Java": [LINE, BLOCK, TRIPLE, DOUBLE, CHAR],
    "C/C++": [LINE, BLOCK, RAW_CPP, DOUBLE, CHAR],
    "Rust": [LINE, BLOCK, RAW_RUST, LONG, CHAR],
    "Python": [HASH, TRIPLE, TRIPLE_SINGLE, DOUBLE, SINGLE],
    "TypeScript": [LINE, BLOCK, TICKS, DOUBLE, SINGLE],
    "Go": [LINE, BLOCK, RAW_TICKS, DOUBLE, CHAR],
    "Swift": [LINE, BLOCK, TRIPLE, DOUBLE],
    "C#": [LINE, BLOCK, TRIPLE, VERBATIM, DOUBLE, CHAR],
    "Dart": [LINE, BLOCK, TRIPLE, TRIPLE_SINGLE, DOUBLE, SINGLE],
}


def pattern(language: str) -> str:
    """The alternatives of a language as one expression; references to groups count from the first."""
    out, groups = [], 0
    for token in TOKENS[language]:
        if r"\1" in token or r"\KEEP" in token:
            groups += 1
            token = token.replace(r"\KEEP", rf"\{groups}").replace(r"\1", rf"\{groups}")
        out.append(token)
    return "|".join(out)


def _blank(token: Column) -> Column:
    """A comment as a space, a literal as its quotes, both with their line breaks."""
    breaks = F.when(F.contains(token, F.lit("\n")), F.regexp_replace(token, r"[^\n]+", "")).otherwise("")
    quote = F.regexp_extract(token, r"[\"'`]", 0)
    comment = F.startswith(token, F.lit("//")) | F.startswith(token, F.lit("/*")) | F.startswith(token, F.lit("#"))
    return F.when(comment, F.concat(F.lit(" "), breaks)).otherwise(F.concat(quote, quote, breaks))


#: Stands around what matched, so that one scan finds it; a text that holds this sign itself is scanned twice.
_MARK = "\x01"


def _without(text: Column, tokens: str) -> Column:
    gaps, found = F.split(text, tokens, -1), F.regexp_extract_all(text, F.lit(tokens), F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda gap, token: F.concat(gap, F.coalesce(_blank(token), F.lit("")))), "")


def code_only(text: Column, language: Column) -> Column:
    """The text of a file with comments and literals blanked, line by line at its place (E13). Languages without rules keep their
    text; null stays null."""
    marked = slow = text
    for name in TOKENS:
        marked = F.when(language == name, F.regexp_replace(text, pattern(name), f"{_MARK}$0{_MARK}")).otherwise(marked)
        slow = F.when(language == name, _without(text, pattern(name))).otherwise(slow)
    fast = F.array_join(F.transform(F.split(marked, _MARK), lambda x, i: F.when(i % 2 == 1, _blank(x)).otherwise(x)), "")
    return F.when(F.contains(text, F.lit(_MARK)), slow).otherwise(fast)


def with_code(files: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """files with code, the content without comments and literals."""
    return files.withColumn("code", let(F.col(content), lambda text: code_only(text, F.col(language))))
