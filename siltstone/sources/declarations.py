"""Declaration-aware chunks: one per function, method, class, interface, type or enum.

Python sources are parsed with the standard library's ``ast``.  Languages with
braces (and Ruby's ``end``) are read by a scanner that blanks comments and
strings, finds declaration heads by pattern and matches blocks.  Classes and
their members are both emitted, functions are not entered, code outside
declarations is not indexed where there is any declaration, and a file without
one falls back to line windows.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.functions.text import BLANKS

SIZE, OVERLAP = 60, 10


@dataclass(frozen=True)
class Declaration:
    name: str
    start: int  # 1-based, inclusive
    end: int


_JS_MODIFIERS = r"(?:export\s+|default\s+|declare\s+|abstract\s+|async\s+|public\s+|private\s+|protected\s+|static\s+|readonly\s+|override\s+)*"
_TYPED = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|synchronized|readonly|default)\s+)*"
_NOT_A_NAME = frozenset("if for while switch catch return else do try function new throw await typeof delete in of case with using lock foreach elif match loop unsafe sizeof".split())

#: (pattern with group ``name``, class-like, only inside a class) by language.
_HEADS: dict[str, list[tuple[str, bool, bool]]] = {
    "typescript": [
        (rf"{_JS_MODIFIERS}function\s*\*?\s*(?P<name>[\w$]+)", False, False),
        (rf"{_JS_MODIFIERS}class\s+(?P<name>[\w$]+)", True, False),
        (rf"{_JS_MODIFIERS}interface\s+(?P<name>[\w$]+)", True, False),
        (rf"{_JS_MODIFIERS}(?:const\s+)?enum\s+(?P<name>[\w$]+)", False, False),
        (rf"{_JS_MODIFIERS}type\s+(?P<name>[\w$]+)(?:<[^=]*>)?\s*=", False, False),
        (rf"{_JS_MODIFIERS}(?:get\s+|set\s+|\*\s*)?(?P<name>#?[\w$]+)\s*(?:<[^>(]*>)?\s*\((?=[^;{{]*\{{)", False, True),
    ],
    "go": [(r"func\s*(?:\([^)]*\)\s*)?(?P<name>\w+)\s*[\[(]", False, False), (r"type\s+(?P<name>\w+)\s", False, False)],
    "rust": [
        (r"(?:pub(?:\([^)]*\))?\s+|async\s+|const\s+|unsafe\s+|extern\s+\S*\s*)*fn\s+(?P<name>\w+)", False, False),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<name>\w+)", False, False),
        (r"(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)", True, False),
    ],
    "java": [
        (rf"{_TYPED}(?:class|interface)\s+(?P<name>\w+)", True, False),
        (rf"{_TYPED}enum\s+(?P<name>\w+)", False, False),
        (rf"{_TYPED}(?:<[^>]*>\s*)?(?:[\w.<>\[\],? ]+\s+)?(?P<name>\w+)\s*\([^;{{}}]*\)\s*(?:throws [\w., ]+)?\s*\{{", False, True),
    ],
    "cpp": [(r"(?:class|struct)\s+(?P<name>\w+)(?=[^;(]*\{)", True, False), (r"(?:[\w:*&<>,~]+[\s*&]+)+(?P<name>[\w:~]+)\s*\([^;{}]*\)[^;{}]*\{", False, False)],
    "c": [(r"(?:\w+[\s*]+)+(?P<name>\w+)\s*\([^;{}]*\)\s*\{", False, False)],
    "ruby": [(r"(?:class|module)\s+(?P<name>[\w:]+)", True, False), (r"def\s+(?P<name>(?:self\.)?[\w?!=]+)", False, False)],
}
_HEADS["tsx"] = _HEADS["typescript"]
_HEADS["javascript"] = [h for h in _HEADS["typescript"] if not any(k in h[0] for k in ("interface", "enum", "type\\s"))]
_HEADS["csharp"] = [(rf"{_TYPED}(?:class|interface)\s+(?P<name>\w+)", True, False), _HEADS["java"][2]]
_COMPILED = {lang: [(re.compile(p), k, inside) for p, k, inside in heads] for lang, heads in _HEADS.items()}

_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_RUBY_NOISE = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_RUBY_OPEN = re.compile(r"^\s*(?:class|module|def|if|unless|case|while|until|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def _python(source: str) -> list[Declaration]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[Declaration] = []

    def walk(body: list[ast.stmt], parent: str) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{parent}.{node.name}" if parent else node.name
                out.append(Declaration(name, node.lineno, node.end_lineno or node.lineno))
                if isinstance(node, ast.ClassDef):
                    walk(node.body, name)
            else:
                for part in ("body", "orelse", "finalbody"):
                    walk([n for n in getattr(node, part, []) or [] if isinstance(n, ast.stmt)], parent)

    walk(tree.body, "")
    return out


def _block_end(code: str, at: int) -> int:
    """The end of the declaration whose head ends at ``at``: the matching brace, or the statement's end."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
    return len(code)


def _braces(source: str, language: str) -> list[Declaration]:
    code = _NOISE.sub(_blank, source)
    out: list[Declaration] = []

    starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def line(i: int) -> int:
        return bisect_right(starts, i)

    def walk(start: int, end: int, parent: str, inside: bool) -> None:
        i = start
        while i < end:
            if code[i].isspace() or (i > start and not code[i - 1].isspace() and code[i - 1] not in "{};)"):
                i += 1
                continue
            hit = None
            for pattern, class_like, member in _COMPILED[language]:
                if member and not inside:
                    continue
                m = pattern.match(code, i, end)
                if m and (language == "rust" or m.group("name") not in _NOT_A_NAME):
                    hit = (m, class_like)
                    break
            if hit is None:
                i = _block_end(code, i) if code[i] == "{" else i + 1
                continue
            m, class_like = hit
            head = m.end() - 1 if code[m.end() - 1] == "{" else m.end()
            stop = min(end, _block_end(code, head))
            name = f"{parent}.{m.group('name')}" if parent else m.group("name")
            out.append(Declaration(name, line(i), line(max(i, stop - 1))))
            brace = code.find("{", head, stop)
            if class_like and brace >= 0:
                walk(brace + 1, stop - 1, name, True)
            i = max(stop, i + 1)

    walk(0, len(code), "", False)
    return out


def _ruby(source: str) -> list[Declaration]:
    lines = _RUBY_NOISE.sub(_blank, source).split("\n")
    out: list[tuple[int, Declaration]] = []
    stack: list[tuple[str | None, int, bool]] = []
    for no, text in enumerate(lines, 1):
        opened = bool(_RUBY_OPEN.search(text))
        if opened:
            name, class_like = None, False
            for pattern, k, _ in _COMPILED["ruby"]:
                m = pattern.match(text.lstrip())
                if m:
                    parents = [n for n, _, c in stack if n and c]
                    in_function = any(n and not c for n, _, c in stack)
                    name, class_like = (None if in_function else ".".join([*parents[-1:], m.group("name")])), k
                    break
            stack.append((name, no, class_like))
        if re.search(r"\bend\b\s*[.)\],]?\s*$", text) and stack:
            name, start, _ = stack.pop()
            if name:
                out.append((start, Declaration(name, start, no)))
    return [d for _, d in sorted(out, key=lambda x: x[0])]


def declarations(source: str, language: str) -> list[Declaration]:
    """Declarations in order of appearance, nested ones with dotted names."""
    if language == "python":
        return _python(source)
    if language == "ruby":
        return _ruby(source)
    return _braces(source, language) if language in _COMPILED else []


def vue_script(source: str) -> tuple[str, int] | None:
    """(code, lines before it) of a single-file component's first script block."""
    m = re.search(r"<script[^>]*>(.*?)</script>", source, re.S)
    return (m.group(1), source.count("\n", 0, m.start(1))) if m else None


def lines_of(source: str) -> list[str]:
    """Lines with their line feeds, as ``chunking.lines_of`` has them."""
    return re.findall(r"[^\n]*\n|[^\n]+", source)


def windows(lines: list[str], offset: int, max_chars: int | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) of line windows, as ``chunking.window_chunks`` makes them; one over ``max_chars`` keeps the leading lines that fit, at least one, cut."""
    for at in range(0, len(lines), SIZE - OVERLAP):
        part = lines[at : at + SIZE]
        if max_chars is not None:
            used, chars = 0, 0
            for text in part:
                if used and chars + len(text) > max_chars:
                    break
                used, chars = used + 1, chars + len(text)
            part = part[:used]
        text = "".join(part)[: max_chars or None].strip(BLANKS)
        if text:
            yield offset + at + 1, offset + at + len(part), text


def chunk_source(source: str, language: str, max_chars: int | None = None) -> list[tuple[int, int, str, str]]:
    """(start line, end line, symbol, text) of a file's chunks; a long declaration is cut into windows, the first has its symbol."""
    source = re.sub(r"\r\n?", "\n", source.removeprefix("﻿"))
    offset = 0
    if language == "vue":
        script = vue_script(source)
        found = declarations(script[0], "typescript") if script else []
        if found:
            source, offset = script
        language = "typescript"
    else:
        found = declarations(source, language)
    lines = lines_of(source)
    out: list[tuple[int, int, str, str]] = []
    for d in found:
        body = lines[d.start - 1 : d.end]
        text = "".join(body).strip(BLANKS)
        if len(body) <= SIZE and (max_chars is None or len(text) <= max_chars):
            if text:
                out.append((offset + d.start, offset + d.end, d.name, text))
        else:
            out += [(s, e, d.name if k == 0 else "", t) for k, (s, e, t) in enumerate(windows(body, offset + d.start - 1, max_chars))]
    return out or [(s, e, "", t) for s, e, t in windows(lines, 0, max_chars)]


def marked(chunks: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str, bool]]:
    """A file's chunks, each with whether another one on earlier lines has its text."""
    first: dict[str, tuple[int, int, int]] = {}
    for k, (s, e, _, text) in enumerate(chunks):
        first[text] = min(first.get(text, (s, e, k)), (s, e, k))
    return ((*c, first[c[3]][2] != k) for k, c in enumerate(chunks))


def declaration_chunks(files: DataFrame, max_chars: int | None = None, again: bool = False) -> DataFrame:
    """item_path, start_line, end_line, symbol_name, language, content from files (item_path, language, content).

    With ``again`` a column of that name says whether the file has the same text on earlier lines.
    """
    names = ["item_path", "start_line", "end_line", "symbol_name", "language", "content"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    if again:
        names, types = [*names, "again"], [*types, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (path, s, e, symbol, "typescript" if language == "vue" else language, text, *seen)
                for path, language, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
                for s, e, symbol, text, *seen in (marked if again else iter)(chunk_source(content or "", language or "", max_chars))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    schema = "item_path string, start_line int, end_line int, symbol_name string, language string, content string" + (", again boolean" if again else "")
    return files.select("item_path", "language", "content").mapInArrow(run, schema)
