"""What of a file is code: one pass with a stack over strings, comments and braces, for languages that have no parser here.

The stack holds what the scanner is inside of: code, a comment (which may nest), a string, or the code in a string's hole. The
result is the source with strings and comments blanked out, at the same places, and the pairs of its braces.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..schemas import FUNCTION_MODIFIERS, FUNCTION_WORDS, TYPE_MODIFIERS, TYPE_WORDS


@dataclass(frozen=True)
class Quote:
    """open: pattern; close: text, with {1} for the group g of open; escape: a pattern that doesn't close; hole: text before code."""

    open: str
    close: str
    escape: str = r"\\."
    lines: bool = False
    hole: str = ""


@dataclass(frozen=True)
class Lexis:
    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    nested: bool = False
    quotes: tuple[Quote, ...] = ()
    braces: bool = True
    #: Functions are told by `name(...) {` too, not by a keyword alone.
    bare: bool = False
    #: A slash where a value may stand begins a regular expression.
    regex: bool = False


_DOUBLE, _SINGLE = Quote('"', '"'), Quote("'", "'")
#: A character, so that a lone tick (a lifetime, a digit separator, a label) opens nothing.
_CHAR = Quote(r"'(?=\\?[^'\n]{1,10}?')", "'")
_TICK = Quote("'(?=(?:\\\\[^\n]|[^\\\\'\n])')", "'")
_TEMPLATE = Quote("`", "`", lines=True, hole="${")
_C = Lexis(quotes=(Quote(r'(?:u8|[uUL])?R"(?P<g>[^()\\\s]{0,16})\(', '){1}"', escape="", lines=True), _DOUBLE, _CHAR), bare=True)
_JAVA = Lexis(quotes=(Quote('"""', '"""', lines=True), _DOUBLE, _CHAR), bare=True)
_SCRIPT = Lexis(quotes=(_DOUBLE, _SINGLE, _TEMPLATE), bare=True, regex=True)
_HASH = Lexis(line=("#",), block=(), quotes=(_DOUBLE, _SINGLE), braces=False)
LEXIS: dict[str, Lexis] = {
    "c": _C, "cpp": _C, "java": _JAVA, "javascript": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT,
    "go": Lexis(quotes=(_DOUBLE, Quote("`", "`", escape="", lines=True), _CHAR)),
    "rust": Lexis(nested=True, quotes=(Quote('b?r(?P<g>#*)"', '"{1}', escape="", lines=True), Quote('"', '"', lines=True), _TICK)),
    "swift": Lexis(nested=True, quotes=(Quote('"""', '"""', lines=True, hole="\\("), Quote('(?P<g>#+)"', '"{1}', escape=""), Quote('"', '"', hole="\\("))),
    "kotlin": Lexis(nested=True, quotes=(Quote('"""', '"""', escape="", lines=True, hole="${"), Quote('"', '"', hole="${"), _CHAR)),
    "scala": Lexis(nested=True, quotes=(Quote('"""', '"""', escape="", lines=True), _DOUBLE, _TICK)),
    "c_sharp": Lexis(quotes=(Quote('\\$?@\\$?"', '"', escape='""', lines=True), Quote('\\$"', '"', hole="{"), _DOUBLE, _CHAR), bare=True),
    "php": Lexis(line=("//", "#"), quotes=(Quote('"', '"', lines=True), Quote("'", "'", lines=True)), bare=True),
    "dart": Lexis(nested=True, quotes=(Quote("r'", "'", escape=""), Quote('r"', '"', escape=""), Quote('"""', '"""', lines=True, hole="${"), Quote("'''", "'''", lines=True, hole="${"), Quote('"', '"', hole="${"), Quote("'", "'", hole="${")), bare=True),
    "zig": Lexis(block=(), quotes=(_DOUBLE, _CHAR)), "v": Lexis(nested=True, quotes=(_DOUBLE, _SINGLE)),
    "python": Lexis(line=("#",), block=(), quotes=(Quote('"""', '"""', lines=True), Quote("\'\'\'", "\'\'\'", lines=True), _DOUBLE, _SINGLE), braces=False),
    "ruby": Lexis(line=("#",), block=(("\n=begin", "\n=end"),), quotes=(Quote('"', '"', lines=True, hole="#{"), Quote("'", "'", lines=True)), braces=False),
    "lua": Lexis(line=(), block=(), quotes=(Quote(r"--\[(?P<g>=*)\[", "]{1}]", escape="", lines=True), Quote("--", "\n", escape="", lines=True), Quote(r"\[(?P<g>=*)\[", "]{1}]", escape="", lines=True), _DOUBLE, _SINGLE), braces=False),
    "elixir": Lexis(line=("#",), block=(), quotes=(Quote('"""', '"""', lines=True, hole="#{"), Quote('"', '"', lines=True, hole="#{")), braces=False),
    "julia": Lexis(line=("#",), block=(("#=", "=#"),), nested=True, quotes=(Quote('"""', '"""', lines=True), _DOUBLE), braces=False),
    "haskell": Lexis(line=("--",), block=(("{-", "-}"),), nested=True, quotes=(_DOUBLE,), braces=False), "ocaml": Lexis(line=(), block=(("(*", "*)"),), nested=True, quotes=(_DOUBLE,), braces=False),
    "r": _HASH, "yaml": _HASH, "toml": _HASH, "json": Lexis(line=(), block=(), quotes=(_DOUBLE,), braces=False),
}
_OPEN = {"${": "}", "{": "}", "#{": "}", "\\(": ")"}
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new))\s*$")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


@functools.lru_cache(64)
def _code(language: str) -> re.Pattern:
    """What ends a stretch of plain code."""
    x = LEXIS[language]
    parts = [f"(?P<b{i}>{re.escape(o)})" for i, (o, _) in enumerate(x.block)]
    parts += [f"(?P<q{i}>{q.open.replace('(?P<g>', f'(?P<g{i}>')})" for i, q in enumerate(x.quotes)]
    parts += [f"(?P<l{i}>{re.escape(o)})" for i, o in enumerate(x.line)]
    parts.append(r"(?P<brace>[{}()\[\]])")
    if x.regex:
        parts.append("(?P<slash>/)")
    return re.compile("|".join(parts))


@functools.lru_cache(512)
def _inside(escape: str, hole: str, lines: bool, close: str) -> re.Pattern:
    parts = [f"(?P<skip>{escape})"] if escape else []
    parts = [f"(?P<hole>{re.escape(hole)})", *parts] if hole else parts
    parts.append(f"(?P<close>{re.escape(close)})")
    if not lines:
        parts.append("(?P<line>\n)")
    return re.compile("|".join(parts), re.S)


@dataclass
class Scan:
    code: str
    #: (opening place, closing place or the end) of each brace pair in code, in order of opening.
    pairs: list[tuple[int, int]] = field(default_factory=list)


def scan(source: str, language: str) -> Scan:
    """The code of a source: strings and comments are spaces, line ends stay. What is open at the end closes there."""
    x = LEXIS.get(language)
    if x is None:
        return Scan(source)
    blank = lambda s: re.sub("[^\n]", " ", s)
    out: list[str] = []
    pairs: dict[int, int] = {}
    opened: list[int] = []
    stack: list[tuple[str, str, int]] = []  # holes: (pattern of the string around, closing character, depth inside)
    patterns: list[re.Pattern] = []
    at, n, find = 0, len(source), _code(language)

    def string(start: int, pattern: re.Pattern) -> int:
        """Blanks a string from start on; its end, or the place behind its hole's opening, when the hole is on the stack."""
        k = start
        while True:
            m = pattern.search(source, k)
            if m is None:
                out.append(blank(source[start:]))
                return n
            if m.lastgroup == "skip":
                k = m.end()
                continue
            if m.lastgroup == "hole":
                out.append(blank(source[start : m.end()]))
                stack.append((m["hole"], _OPEN[m["hole"]], 0))
                patterns.append(pattern)
                return m.end()
            end = m.start() if m.lastgroup == "line" else m.end()
            out.append(blank(source[start:end]))
            return end

    while at < n:
        m = find.search(source, at)
        if m is None:
            out.append(source[at:])
            break
        kind = m.lastgroup
        kind = next(k for k in m.groupdict() if m[k] is not None and not k.startswith("g")) if kind is None or kind.startswith("g") else kind
        out.append(source[at : m.start()])
        at = m.end()
        if kind == "brace":
            c = m["brace"]
            if stack:
                hole, closer, depth = stack[-1]
                opener = "(" if closer == ")" else "{"
                if c == closer and depth == 0:  # back into the string
                    stack.pop()
                    out.append(" ")
                    at = string(at, patterns.pop())
                    continue
                if c in (opener, closer):
                    stack[-1] = hole, closer, depth + (1 if c == opener else -1)
            if c == "{":
                opened.append(m.start())
                pairs[m.start()] = n
            elif c == "}" and opened:
                pairs[opened.pop()] = m.start()
            out.append(c)
        elif kind == "slash":
            r = _REGEX.match(source, m.start())
            if r and _BEFORE_REGEX.search(source[max(0, m.start() - 40) : m.start()]):
                out.append(blank(r[0]))
                at = r.end()
            else:
                out.append("/")
        elif kind[0] == "l":
            end = source.find("\n", at)
            end = n if end < 0 else end
            out.append(blank(source[m.start() : end]))
            at = end
        elif kind[0] == "b":
            o, c = x.block[int(kind[1:])]
            depth, k, either = 1, at, re.compile(f"{re.escape(o)}|{re.escape(c)}" if x.nested else re.escape(c))
            while depth:
                e = either.search(source, k)
                if e is None:
                    k = n
                    break
                depth, k = depth + (1 if e[0] == o else -1), e.end()
            out.append(blank(source[m.start() : k]))
            at = k
        else:
            i = int(kind[1:])
            q = x.quotes[i]
            group = m.groupdict().get(f"g{i}")
            out.append(blank(m[0]))
            at = string(at, _inside(q.escape, q.hole, q.lines, q.close.replace("{1}", group or "")))
    return Scan("".join(out), sorted(pairs.items()))


_NAMED = re.compile(r"(?P<name>[A-Za-z_$~][\w$]*)\s*(?:<[^<>(){};]*>)?\s*\(")
_RECEIVER = re.compile(r"\bfunc\s*\([^()]*\)\s*(?P<name>\w+)")
_GO_TYPE = re.compile(r"^\s*type\s+(?P<name>\w+)(?:\[[^\]\n]*\])?\s+(?:struct|interface)\b")
_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl\b(?:<[^{;\n]*?>)?\s*(?:[\w:<>, ]+?\bfor\s+)?(?P<name>\w+)")
_CONTROL = frozenset("if for while switch catch return new else do synchronized using lock fixed foreach when match loop unsafe with throw sizeof typeof await yield assert defer go select function def fn func fun elseif".split())
_TAIL = re.compile(r"(?:\s|const|noexcept|override|final|throws|async|->|=>|where|:(?!:)|[\w.<>,?\[\]|&*])*\{")


def _closing(code: str, at: int) -> int:
    """The place of the parenthesis that closes the one at `at`; -1 without."""
    depth = 0
    for m in re.compile("[()]").finditer(code, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start()
    return -1


def declarations(scanned: Scan, language: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, function or class, place, place behind the end) of what a file declares, in order of place.

    A body is the first brace behind the declared name before a semicolon; one without a body ends with its line. Names are those
    behind a keyword (with a receiver in Go, of an impl in Rust), or before parentheses and a body where the language has no keyword.
    """
    code, closes = scanned.code, dict(scanned.pairs)
    found: dict[int, tuple[str, str, int]] = {}
    start = 0
    for line in code.split("\n"):
        words = line.split()
        for kind, keywords, modifiers in (("function", FUNCTION_WORDS, FUNCTION_MODIFIERS), ("class", TYPE_WORDS, TYPE_MODIFIERS)):
            more = modifiers if kind == "function" else (*modifiers, "data", "case", "partial", "export", "default", "strictfp")
            k = next((k for k, w in enumerate(words) if w not in more and w not in ("export", "default", "extern", "unsafe", "suspend", "inline", "mutating", "const")), len(words))
            if words[k : k + 1] and words[k] in keywords and k + 1 < len(words):
                name = re.match(r"[\w$]+", words[k + 1])
                if name:
                    found[start] = name[0], kind, start + line.index(words[k + 1], line.index(words[k])) + len(name[0])
        for pattern, kind in ((_RECEIVER, "function"), *(((_GO_TYPE, "class"),) if language == "go" else ()), *(((_IMPL, "class"),) if language == "rust" else ())):
            if (m := pattern.search(line)) and start not in found:
                found[start] = m["name"], kind, start + m.end("name")
        start += len(line) + 1
    if LEXIS[language].bare:
        for m in _NAMED.finditer(code):
            if m["name"] in _CONTROL or (end := _closing(code, m.end() - 1)) < 0:
                continue
            tail = _TAIL.match(code, end + 1)
            before = code[code.rfind("\n", 0, m.start()) + 1 : m.start()].split()
            if tail is None or before[-1:] in (["new"], ["return"], ["="]) or any(c in "=.(" for c in "".join(before)):
                continue
            line = code.rfind("\n", 0, m.start()) + 1
            found.setdefault(line, (m["name"], "function", end))
    ordered = sorted(found.items())
    for place, (name, kind, behind) in ordered:
        body, stop = code.find("{", behind), code.find(";", behind)
        line_end = code.find("\n", behind)
        line_end = len(code) if line_end < 0 else line_end
        following = next((p for p, _ in ordered if p > behind), len(code))
        if 0 <= body < following and (stop < 0 or body < stop) and body in closes:
            yield name, kind, place, min(len(code), closes[body] + 1)
        else:
            yield name, kind, place, line_end


def symbols_of_braces(source: str, language: str) -> list[dict]:
    """Functions, methods and classes of a language with braces; a function in a class is a method, also in a function there."""
    scanned = scan(source, language)
    lines, starts = source.split("\n"), [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    number = {s: k for k, s in enumerate(starts)}
    import bisect

    out, inside = [], []
    for name, kind, place, end in declarations(scanned, language):
        while inside and inside[-1] <= place:
            inside.pop()
        first, last = number[place], bisect.bisect_right(starts, max(place, end - 1)) - 1
        out.append({
            "name": name, "kind": "method" if kind == "function" and inside else kind, "start_line": first + 1, "end_line": last + 1, "code": "\n".join(lines[first : last + 1]), "signature": lines[first].strip(),
            "docstring": None, "decorators": [],
        })
        if kind == "class":
            inside.append(end)
    return out
