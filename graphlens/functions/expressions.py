"""Column expressions that the operators share."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CLASS_HINTS, DECLARATION_ENDS, EDGE_WEIGHTS, EXTENSIONS, FUNCTION_HINTS, NO_SYMBOLS


def saturate(x: Column, k: float) -> Column:
    """1 - 1 / (1 + x / k); 0 for x <= 0 or null."""
    return F.when(x > 0, 1 - 1 / (1 + x / F.lit(float(k)))).otherwise(F.lit(0.0))


def recency(modified: Column, now: Column, rate: float = 0.02) -> Column:
    """Exponential decay by whole days; 0.5 where the time is unknown."""
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(modified)) / F.lit(86_400_000_000)))
    return F.when(modified.isNull() | now.isNull(), F.lit(0.5)).otherwise(F.exp(-F.lit(rate) * days))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def split_name(name: Column) -> Column:
    """Distinct lower-case words of a camel, snake or kebab name, longer than one letter."""
    parts = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.transform(F.filter(F.split(parts, "[^a-zA-Z0-9]+"), lambda x: F.length(x) > 1), F.lower))


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: * and ? cross slashes, [..] is a class."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out})$"


def glob_match(value: Column, pattern: str) -> Column:
    return value.rlike(glob_regex(pattern))


def any_glob(value: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(glob_match(value, p), F.lit(False))
    return out


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def path_suffix_match(a: Column, b: Column) -> Column:
    """Equal, or one is the other's end at a slash."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def token_text(raw_code: Column, summary: Column) -> Column:
    return F.coalesce(F.nullif(raw_code, F.lit("")), F.nullif(summary, F.lit("")), F.lit(""))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)) + 15


def normalize_route(url: Column) -> Column:
    """Path of a URL without scheme, host, query and trailing slashes; parameters and numbers become {_}; lower case."""
    path = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    path = F.regexp_replace(F.when(path == "", F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.lit("/")).otherwise(url)).otherwise(path), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "\\{[^}]+\\}", "{_}"), "/:[A-Za-z_][A-Za-z0-9_]*", "/{_}"), "/[0-9]+", "/{_}"))


def edge_weight(kind: Column) -> Column:
    out = F.lit(0.5)
    for k, w in EDGE_WEIGHTS.items():
        out = F.when(kind == k, F.lit(w)).otherwise(out)
    return out


def detect_language(path: Column) -> Column:
    """Language by lower-cased extension, empty if unknown."""
    ext = F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, ext), F.lit(""))


def identifiers(code: Column, keywords) -> Column:
    """Distinct identifiers of more than one letter that are no keywords (ASCII)."""
    found = F.regexp_extract_all(code, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.filter(F.array_distinct(found), lambda x: (F.length(x) > 1) & (F.substring(x, 1, 1).rlike("[A-Za-z_]")) & ~x.isin(list(keywords)))


def node_class(node_type: Column) -> Column:
    """function or class for a parser's node type that declares a symbol, else null."""
    low = F.lower(node_type)
    has = lambda hints: reduce(lambda a, b: a | b, (F.contains(low, F.lit(h)) for h in hints))
    declares = reduce(lambda a, b: a | b, (node_type.endswith(e) for e in DECLARATION_ENDS))
    kind = F.when(has(FUNCTION_HINTS), "function").when(has(CLASS_HINTS), "class").otherwise("function")
    return F.when(declares & ~node_type.isin(NO_SYMBOLS), kind)


def symbol_kind(kind: Column, of_changes: bool = False) -> Column:
    """A symbol's node kind; unknown kinds are functions. A change's symbols may be modules and files, in any case of letters."""
    known = ["function", "method", "class", "type", "constant"] + (["module", "file"] if of_changes else [])
    kind = F.lower(kind) if of_changes else kind
    return F.when(kind.isin(known), kind).otherwise("function")


def rounded(x: Column, digits: int) -> Column:
    """Half to even, as reports have it: quality with 4 digits, catalogues with 3."""
    return F.bround(x, digits)


def map_to_json(x: Column) -> Column:
    """A map as JSON text; an empty or null map is null."""
    return F.when(F.size(x) > 0, F.to_json(x))


def map_from_json(x: Column) -> Column:
    return F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>"))
