"""Source files, diffs and their symbols."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import any_glob, detect_language, identifiers
from ..schemas import FUNCTION_MODIFIERS, FUNCTION_WORDS, KEYWORDS, LONGEST_DECLARATION, SYMBOLS, TYPE_MODIFIERS, TYPE_WORDS
from .lexer import LEXIS, scan, symbols_of_braces

def walk(spark: SparkSession, root: str, repo: str, excluded=(), max_kb: int = 500) -> DataFrame:
    """Files below root: repo, path (relative), content, length, modified. Excluded names and larger files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base), "")
    rows = files.where(F.col("length") <= max_kb * 1024).select(F.lit(repo).alias("repo"), path.alias("path"), F.decode("content", "UTF-8").alias("content"), "length", F.col("modificationTime").alias("modified"))
    return rows.where(~F.exists(F.split("path", "/"), lambda p: any_glob(p, excluded)))


def modules(files: DataFrame) -> DataFrame:
    """Every directory above a file: repo, path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.where(F.size(parts) > 1).select("repo", F.explode(above).alias("path")).distinct()


def _declared(words: list[str], keywords: tuple[str, ...], modifiers: tuple[str, ...]) -> str | None:
    """The name that a line's words declare: modifiers, a keyword, then the name."""
    k = next((k for k, w in enumerate(words) if w not in modifiers), len(words))
    name = re.match(r"\w+", words[k + 1]) if words[k : k + 1] and words[k] in keywords and k + 1 < len(words) else None
    return name[0] if name else None


def _block_ends(lines: list[str]) -> list[int]:
    """For each line, the next one that isn't indented more (the number of lines if there is none), from the last line back."""
    ends, open_ = [len(lines)] * len(lines), []  # open_: (indent, line) of what may end a block above, the nearest last
    for k in range(len(lines) - 1, -1, -1):
        text = lines[k].lstrip()
        if text:
            own = len(lines[k]) - len(text)
            while open_ and open_[-1][0] > own:
                open_.pop()
            ends[k] = open_[-1][1] if open_ else len(lines)
            open_.append((own, k))
    return ends


def symbols_by_pattern(source: str) -> list[dict]:
    """Functions, then classes, of any language: a symbol ends before the next line that isn't indented more."""
    lines = source.split("\n")
    ends = _block_ends(lines)
    split = [x.split() for x in lines]
    found = []
    for kind, keywords, modifiers in (("function", FUNCTION_WORDS, FUNCTION_MODIFIERS), ("class", TYPE_WORDS, TYPE_MODIFIERS)):
        for k, words in enumerate(split):
            if name := _declared(words, keywords, modifiers):
                end = min(ends[k], k + LONGEST_DECLARATION)
                found.append({"name": name, "kind": kind, "start_line": k + 1, "end_line": end, "code": "\n".join(lines[k:end]), "signature": lines[k].strip(), "docstring": None, "decorators": []})
    return found


def symbols_of_python(source: str) -> list[dict]:
    """Classes, functions and methods by Python's own parser; a file that doesn't parse falls back to patterns."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return symbols_by_pattern(source)
    lines, found = source.split("\n"), []

    def visit(node: ast.AST, inside: bool) -> None:
        for x in ast.iter_child_nodes(node):
            is_class = isinstance(x, ast.ClassDef)
            if is_class or isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if is_class else "method" if inside else "function"
                found.append({
                    "name": x.name, "kind": kind, "start_line": x.lineno, "end_line": x.end_lineno, "code": "\n".join(lines[x.lineno - 1 : x.end_lineno]), "signature": lines[x.lineno - 1].strip(),
                    "docstring": ast.get_docstring(x), "decorators": ["@" + ast.unparse(d) for d in x.decorator_list],
                })
                visit(x, inside or is_class)
            else:
                visit(x, inside)

    visit(tree, False)
    return found


def symbols_of(source: str, language: str) -> list[dict]:
    """By Python's parser, by braces, or by indentation, whichever the language has."""
    if language == "python":
        return symbols_of_python(source)
    return symbols_of_braces(source, language) if language in LEXIS and LEXIS[language].braces else symbols_by_pattern(source)


def code_of(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows(keep, code, language) with code as it is without strings and comments; an unknown language changes nothing."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["code"] = [scan(c, x).code if isinstance(c, str) else None for c, x in zip(batch["code"], batch["language"], strict=True)]
            yield batch[[*keep, "code"]]

    return rows.select(*keep, "code", "language").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", code string")


def code_identifiers(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, identifiers of rows(keep, code, language): those of the code itself, without strings and comments."""
    return code_of(rows, keep).select(*keep, identifiers(F.coalesce("code", F.lit("")), KEYWORDS).alias("identifiers"))


def symbols(files: DataFrame, language: str | None = None) -> DataFrame:
    """files(repo, path, content) -> one row per symbol; files of no known language give none, unless one is named for them."""
    found = detect_language(F.col("path"))
    known = files.withColumn("language", F.when(found == "", F.lit(language or "")).otherwise(found)).where("language != '' AND content IS NOT NULL").select("repo", "path", "language", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                own = symbols_of(f.content, f.language)
                rows += [{"repo": f.repo, "path": f.path, "seq": k, **s} for k, s in enumerate(own)]
            yield pd.DataFrame(rows, columns=SYMBOLS.names)

    return known.mapInPandas(run, SYMBOLS)


def unique_ids(rows: DataFrame) -> DataFrame:
    """rows(seq, base) with id: the base, and base_2, base_3 ... for later rows of one base."""
    rn = F.row_number().over(Window.partitionBy("base").orderBy("seq"))
    return rows.withColumn("rn", rn).withColumn("id", F.when(F.col("rn") > 1, F.concat_ws("_", "base", F.col("rn").cast("string"))).otherwise(F.col("base"))).drop("rn")


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """diffs(id, diff) -> id, file_seq, old_path, new_path, status, hunk_start, hunk_end, added, removed.

    A hunk's range is that of its header in the new file, the end one past its last line. Lines after the sign that start
    with the sign again twice count as context. Files without hunks have one row without a range.
    """
    line = F.posexplode(F.split("diff", "\n"))
    rows = diffs.select("id", line.alias("pos", "line"))
    by = Window.partitionBy("id").orderBy("pos")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("file_seq", F.sum(F.col("line").startswith("diff --git ").cast("int")).over(upto)).where("file_seq > 0")
    by_file = Window.partitionBy("id", "file_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk", F.sum(F.col("line").rlike("^@@ -\\d+").cast("int")).over(by_file))
    head = lambda p, g=1: F.max(F.when(F.col("hunk") == 0, F.nullif(F.regexp_extract("line", p, g), F.lit(""))))
    flag = lambda p: F.max((F.col("hunk") == 0) & F.col("line").startswith(p))
    heads = rows.groupBy("id", "file_seq").agg(head("^diff --git a/(.*) b/(.*)$").alias("old_path"), head("^diff --git a/(.*) b/(.*)$", 2).alias("new_path"), flag("new file").alias("n"), flag("deleted file").alias("d"), flag("rename from").alias("r"), F.max("hunk").alias("hunks"))
    status = F.when(F.col("n"), "added").when(F.col("d"), "deleted").when(F.col("r"), "renamed").otherwise("modified")
    sign = lambda c, stop: F.sort_array(F.collect_list(F.when(F.col("line").startswith(c) & ~F.col("line").startswith(stop), F.struct("pos", F.expr("substring(line, 2)").alias("s")))))
    start = F.max(F.nullif(F.regexp_extract("line", "^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@", 1), F.lit(""))).try_cast("int")
    count = F.max(F.when(F.col("line").startswith("@@ -"), F.regexp_extract("line", "^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@", 2)))
    size = F.when(count == "", 1).otherwise(count.try_cast("int"))
    hunks = rows.where("hunk > 0").groupBy("id", "file_seq", "hunk").agg(start.alias("hunk_start"), (start + size).alias("hunk_end"), F.transform(sign("+", "+++"), lambda x: x["s"]).alias("added"), F.transform(sign("-", "---"), lambda x: x["s"]).alias("removed"))
    return heads.join(hunks, ["id", "file_seq"], "left").select("id", "file_seq", "old_path", "new_path", status.alias("status"), "hunk_start", "hunk_end", "added", "removed")


def import_target(line):
    """Module that an added line imports: JavaScript, Go and Python forms; null if none."""
    forms = ("from\\s+['\"]([^'\"]+)['\"]", "require\\(\\s*['\"]([^'\"]+)['\"]\\s*\\)", "^\\s*import\\s+['\"]([^'\"]+)['\"]", "^\\s*from\\s+([\\w.]+)\\s+import\\b", "^\\s*import\\s+([\\w.]+)")
    return F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in forms))


def file_changes(changes: DataFrame) -> DataFrame:
    """changes(status, old_path, new_path) -> path, action: what to remove and what to parse; a rename is both."""
    s = F.col("status")
    remove = changes.where(s.isin("deleted", "modified", "renamed")).select(F.col("old_path").alias("path"), F.lit("remove").alias("action"))
    parse = changes.where(s != "deleted").select(F.col("new_path").alias("path"), F.lit("parse").alias("action"))
    return remove.unionByName(parse).distinct()
