"""Patterns from search terms, and what a text must hold to match them."""

from __future__ import annotations

import re

#: Signs by which a single term counts as a regular expression, and the preset for errors.
REGEX_SIGNS = (r"\b", r"\w", r"\d", r"\s", ".*", ".+")
ERRORS_PATTERN = r"\berror\b|\bfatal\b|\bLNK\d+|undefined reference|cannot (open|find)|\bfailed\b|exception|warning C\d+|^\[(exit|timed out)"
FLAGS = "(?iu)"


def _escape(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def search_pattern(terms: list[str], regex: bool | None = None, case_sensitive: bool = False) -> str:
    """The pattern of a search (X2), by what the terms are:

    several terms                                   any of them, literally
    one, asked for as an expression                 as it is; an error if it does not compile
    one that looks like an expression, and is one   as it is
    an identifier                                   that whole word
    any other                                       literally

    An expression may have grep's backslash-bar as alternation.
    """
    flags = "(?m)" if case_sensitive else "(?miu)"
    expression = terms[0].replace(r"\|", "|") if len(terms) == 1 and regex is not False else None
    if expression and regex and not _compiles(expression):
        raise ValueError(f"not a regular expression: {terms[0]}")
    if expression and (regex or _looks_regular(terms[0]) and _compiles(expression)):
        return flags + expression
    literals = [_escape(t) for t in terms]
    if len(terms) == 1 and re.fullmatch(r"\w+", terms[0]):
        literals = [rf"\b{literals[0]}\b"]
    return flags + "|".join(literals)


def _looks_regular(term: str) -> bool:
    return bool(re.search(r"\||^\^|\$$", term)) or any(sign in term for sign in REGEX_SIGNS)


def smart_pattern(pattern: str) -> str:
    """The pattern of a line filter (F14): case counts only if the pattern has capitals; an invalid one is literal."""
    flags = "" if any(c.isupper() for c in pattern) else FLAGS
    return flags + (pattern if _compiles(pattern) else _escape(pattern))


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match holds at least one (I1), or None if that cannot be told.

    Walks the syntax tree of the pattern for a run of literal characters at the start of each alternative. Literals
    shorter than three characters or beyond ASCII tell nothing, since matching folds case beyond ASCII.
    """
    import re._constants as sre
    import re._parser as parser

    body = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    try:
        tree = parser.parse(body)
    except re.error:
        return None

    def prefixes(items: list) -> list[str] | None:
        out = [""]
        for op, arg in items:
            if op is sre.AT:
                continue
            if op is sre.LITERAL:
                out = [o + chr(arg) for o in out]
            elif op is sre.SUBPATTERN and arg[1] == 0 and arg[2] == 0:
                inner = prefixes(list(arg[3]))
                if inner is None:
                    return out if all(out) else None
                return [o + i for o in out for i in inner]
            elif op is sre.BRANCH:
                inner = [prefixes(list(b)) for b in arg[1]]
                if any(i is None for i in inner):
                    return out if all(out) else None
                return [o + x for o in out for i in inner for x in i]
            else:
                break
        return out

    found = prefixes(list(tree))
    if not found or any(len(f) < 3 or not f.isascii() or set(f) & set("\n\r\0") for f in found):
        return None
    # K and S also match their Unicode look-alikes (Kelvin sign, long s), whose grams differ.
    if pattern.startswith("(?") and "u" in pattern[: pattern.find(")")]:
        found = [max(re.split("[ks]", f.lower()), key=len) for f in found]
        if any(len(f) < 3 for f in found):
            return None
    return sorted({f.lower() for f in found})
