"""References in text: calls, imports, links, and what is used against what is declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words before a bracket that are no calls; modules that come with the runtime.
NOT_CALLS = [
    "if", "for", "while", "switch", "match", "return", "catch", "fn", "def", "function", "class", "sizeof", "typeof", "new", "await", "async", "else", "loop", "when", "with",
    "assert", "super", "this", "self", "LOGD", "LOGE", "LOGI", "LOGW",
]
BUILTINS = [
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events",
    "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl",
    "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
]


def called(text: Column) -> Column:
    """Names before an opening bracket, without constructs (E15), each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1), lambda n: ~n.isin(NOT_CALLS)))


def imported(line: Column) -> Column:
    """Module specifiers of import, export-from, require and dynamic import on a line that is no comment."""
    forms = (r"""\bfrom\s+['"]([^'"]+)['"]""", r"""^\s*import\s+['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]""", r"""\bimport\(\s*['"]([^'"]+)['"]""")
    found = F.flatten(F.array(*[F.regexp_extract_all(line, F.lit(f), 1) for f in forms]))
    return F.when(line.rlike(r"^\s*(//|\*|/\*)"), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def package_of(spec: Column, aliases: tuple = ("@", "~")) -> Column:
    """The package of a specifier (X21): scope and name, or the first part; null for paths, urls, aliases, modules of the
    runtime, and what no package is named: blanks, braces, $ and *."""
    parts = F.split(spec, "/")
    name = F.when(F.startswith(spec, F.lit("@")) & (F.size(parts) > 1), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
    local = spec.rlike(r"^(\.|/|#|[a-z]+:)|[\s{}$*]") | F.get(parts, F.lit(0)).isin(list(aliases)) | name.isin(BUILTINS) | (spec == "")
    return F.when(~local, name)


def used_and_declared(used: DataFrame, declared: DataFrame, key: str = "package") -> DataFrame:
    """(key, status): missing if used and not declared, unused if declared and not used."""
    u, d = used.select(key).distinct(), declared.select(key).distinct()
    missing = u.join(d, key, "left_anti").select(key, F.lit("missing").alias("status"))
    return missing.unionByName(d.join(u, key, "left_anti").select(key, F.lit("unused").alias("status")))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)
