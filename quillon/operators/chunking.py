"""Deterministic, line-spanned chunks of texts.

Line windows, overlap, the byte limit and duplicates are array expressions over each
row's own lines; functions in Python code are found by syntax, in an Arrow step.
Lines count from 1 and keep their terminators; limits count UTF-8 bytes.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import EngineError
from quillon.functions import ids

#: Lines of a chunk, lines that it shares with the one before, and bytes of a chunk at most.
LINES, OVERLAP, MOST_BYTES = 200, 40, 2500


def checked(lines: int, overlap: int) -> None:
    if lines <= 0 or not 0 <= overlap < lines:
        raise EngineError("splitter:invalid_config", "needs lines > 0 and 0 <= overlap < lines")


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines with their terminators; an empty text is one empty line."""

    def ended(parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit("\n"))).otherwise(x))

    # bound first: what a lambda's body names is computed again for each element
    return _bind(_bind(F.split(text, "\n", -1), ended), lambda p: F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def line_count(text: Column) -> Column:
    """The number of lines_of, without making them."""
    return _bind(text, lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when(F.endswith(t, F.lit("\n")), 0).otherwise(1))


def windows(n_lines: Column, lines: int, overlap: int = 0) -> Column:
    """array<struct<s, e>>: consecutive windows, each begun `overlap` lines before the last one's end."""
    checked(lines, overlap)

    def cut(n: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.ceil(n / lines).cast("int") - 1),
            lambda i: F.struct(F.greatest(F.lit(1), i * lines + 1 - F.when(i > 0, overlap).otherwise(0)).cast("int").alias("s"), F.least(n, (i + 1) * lines).cast("int").alias("e")),
        )

    return _bind(n_lines, cut)


def byte_limited(ranges: Column, sizes: Column, most: int) -> Column:
    """Each range cut, line by line, before it would exceed `most` bytes; a longer line stands alone."""

    def cut(r: Column) -> Column:
        none = F.array().cast("array<struct<s:int,e:int>>")
        start = F.struct(none.alias("out"), r["s"].alias("s"), F.lit(0).alias("size"))

        def add(out: Column, s: Column, e: Column) -> Column:
            return F.concat(out, F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))))

        def step(a: Column, line: Column) -> Column:
            size = F.coalesce(F.get(sizes, line - 1), F.lit(0))
            before = F.when(a["size"] > 0, add(a["out"], a["s"], line - 1)).otherwise(a["out"])
            alone = F.struct(add(before, line, line).alias("out"), (line + 1).alias("s"), F.lit(0).alias("size"))
            full = F.struct(before.alias("out"), line.alias("s"), size.alias("size"))
            more = F.struct(a["out"].alias("out"), a["s"].alias("s"), (a["size"] + size).alias("size"))
            return F.when(size > most, alone).when((a["size"] > 0) & (a["size"] + size > most), full).otherwise(more)

        return F.aggregate(F.sequence(r["s"], r["e"]), start, step, lambda a: F.when((a["size"] > 0) & (a["s"] <= r["e"]), add(a["out"], a["s"], r["e"])).otherwise(a["out"]))

    return F.flatten(F.transform(ranges, cut))


def fragments(content: Column, most: int) -> Column:
    """array<struct<text, a, z>>: pieces of at most `most` bytes that end between characters, with byte offsets.

    The fold walks over characters' byte sizes; a text of one piece is not walked over.
    """

    def walk(chars: Column) -> Column:
        none = F.array().cast("array<struct<text:string,a:int,z:int>>")
        start = F.struct(none.alias("out"), F.lit(0).alias("a"), F.lit(0).alias("size"), F.lit(1).alias("c"), F.lit(0).alias("n"))

        def put(x: Column) -> Column:
            piece = F.array_join(F.slice(chars, x["c"], x["n"]), "")
            return F.concat(x["out"], F.array(F.struct(piece.alias("text"), x["a"].alias("a"), (x["a"] + x["size"]).alias("z"))))

        def step(x: Column, ch: Column) -> Column:
            w = F.octet_length(ch)
            full = F.struct(put(x).alias("out"), (x["a"] + x["size"]).alias("a"), w.alias("size"), (x["c"] + x["n"]).alias("c"), F.lit(1).alias("n"))
            more = F.struct(x["out"].alias("out"), x["a"].alias("a"), (x["size"] + w).alias("size"), x["c"].alias("c"), (x["n"] + 1).alias("n"))
            return F.when((x["size"] > 0) & (x["size"] + w > most), full).otherwise(more)

        return F.aggregate(chars, start, step, lambda x: F.when(x["size"] > 0, put(x)).otherwise(x["out"]))

    whole = F.array(F.struct(content.alias("text"), F.lit(0).alias("a"), F.octet_length(content).alias("z")))
    return F.when(F.octet_length(content) <= most, whole).otherwise(_bind(F.split(content, ""), walk))


def chunked(files: DataFrame, lines: int = LINES, overlap: int = OVERLAP, most_bytes: int = MOST_BYTES, path_col: str = "relativePath", text_col: str = "content", language_col: str | None = None) -> DataFrame:
    """(relativePath, pos, startLine, endLine, fragmentStartByte, fragmentEndByte, content, id).

    Windows with overlap, cut at the byte limit, doubles dropped in order, then pieces of
    lines beyond the limit; offsets are set only where a chunk has several pieces. An
    empty file has no chunk.
    """
    checked(lines, overlap)

    def ranges(l: Column) -> Column:
        sizes = F.transform(l, lambda x: F.octet_length(x))
        return F.array_distinct(_bind(sizes, lambda z: byte_limited(windows(F.size(l), lines, overlap), z, most_bytes)))

    def pieces(l: Column) -> Column:
        def of(r: Column) -> Column:
            content = F.array_join(F.slice(l, r["s"], r["e"] - r["s"] + 1), "")
            return _bind(fragments(content, most_bytes), lambda f: F.transform(f, lambda x: F.struct(r["s"].alias("startLine"), r["e"].alias("endLine"), F.when(F.size(f) > 1, x["a"]).alias("fragmentStartByte"), F.when(F.size(f) > 1, x["z"]).alias("fragmentEndByte"), x["text"].alias("content"))))

        return F.flatten(F.transform(ranges(l), of))

    out = files.select(F.col(path_col).alias("relativePath"), F.posexplode(_bind(lines_of(F.col(text_col)), pieces)).alias("pos", "c")).select("relativePath", "pos", "c.*")
    return out.withColumn("id", ids.chunk_id(F.col("relativePath"), F.col("startLine"), F.col("endLine"), F.col("content"), F.col("fragmentStartByte"), F.col("fragmentEndByte")))


def limited(chunks: DataFrame, most: int) -> DataFrame:
    """The first chunks by path and place. A window over all rows is avoided: sort and limit."""
    return chunks.orderBy("relativePath", "pos").limit(most)


def deduped(ranges: DataFrame) -> DataFrame:
    """(doc, pos, s, e) without later doubles of a range: the least place of each, found before the shuffle as well."""
    return ranges.groupBy("doc", "s", "e").agg(F.min("pos").alias("pos")).select("doc", "pos", "s", "e")


# Spans by syntax


def python_spans(code: str) -> list[tuple[int, int]]:
    """Lines of the outermost functions, decorators included; classes are entered."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[int, int]] = []
    queue: list[ast.AST] = [tree]
    while queue:
        for node in ast.iter_child_nodes(queue.pop(0)):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno or node.lineno))
            elif isinstance(node, (ast.ClassDef, ast.If, ast.Try, ast.With)):
                queue.append(node)
    return sorted(out)


_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|`[^`]*`|'(?:\\.|[^'\\\n])'", re.S)
_CONTROL = re.compile(r"\s*(?:if|for|while|switch|match|else|do|catch|loop|select|return)\b")


def brace_spans(code: str) -> list[tuple[int, int]]:
    """Lines of the outermost blocks whose head has a parameter list and is no control statement."""
    bare = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    out: list[tuple[int, int]] = []
    opened: list[int] = []  # line of the head of each open function, 0 for other blocks
    at = 0  # where the statement at hand begins
    for m in re.finditer(r"[{};]", bare):
        head = bare[at : m.start()]
        if m[0] == "{":
            found = "(" in head and ")" in head and not _CONTROL.match(head) and not any(opened)
            opened.append(bare.count("\n", 0, at + len(head) - len(head.lstrip())) + 1 if found else 0)
        elif m[0] == "}" and opened and (line := opened.pop()):
            out.append((line, bare.count("\n", 0, m.start()) + 1))
        at = m.end()
    return out


def _windows(a: int, z: int, size: int) -> list[tuple[int, int]]:
    return [(s, min(z, s + size - 1)) for s in range(a, z + 1, size)]


def syntax_ranges(spans: list[tuple[int, int]], size: int, total: int) -> list[tuple[int, int]]:
    """Spans joined up to `size` lines, longer ones cut, and windows over what lies between."""
    if not spans:
        return _windows(1, total, size)
    kept: list[tuple[int, int]] = []
    held: tuple[int, int] | None = None
    for a, z in sorted((max(1, a), min(z, total)) for a, z in spans):
        if z - a + 1 > size:
            kept += ([held] if held else []) + _windows(a, z, size)
            held = None
        elif held and max(held[1], z) - held[0] + 1 <= size:
            held = (held[0], max(held[1], z))
        else:
            kept += [held] if held else []
            held = (a, z)
    kept += [held] if held else []
    out, at = [], 1
    for a, z in sorted(kept):
        out += _windows(at, a - 1, size) if at < a else []
        out.append((a, z))
        at = max(at, z + 1)
    return out + (_windows(at, total, size) if at <= total else [])


BRACES = ("rust", "go", "java", "javascript", "typescript", "c", "cpp")


def syntax_chunks(files: DataFrame, lines: int = LINES, path_col: str = "relativePath", text_col: str = "content", language_col: str = "language") -> DataFrame:
    """(relativePath, pos, startLine, endLine): ranges along functions where the language is known, else windows."""
    checked(lines, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text, lang in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                spans = python_spans(text) if lang == "python" else brace_spans(text) if lang in BRACES else []
                total = max(1, text.count("\n") + (not text.endswith("\n")))
                rows += [(path, k, s, e) for k, (s, e) in enumerate(syntax_ranges(spans, lines, total))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string() if j == 0 else pa.int32()) for j in range(4)], ["relativePath", "pos", "startLine", "endLine"])

    return files.select(path_col, text_col, language_col).mapInArrow(run, "relativePath string, pos int, startLine int, endLine int")
