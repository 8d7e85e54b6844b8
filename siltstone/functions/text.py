"""Column functions on text: normalising, trimming, hashing, languages, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space that a trim strips: Unicode spaces, line ends and the byte-order mark.
_BLANK = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: The same characters for ``str.strip``.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# File extension and its language.
LANGUAGES = {
    "c": "c",
    "cpp": "cpp",
    "cs": "csharp",
    "css": "css",
    "go": "go",
    "h": "c",
    "hpp": "cpp",
    "html": "html",
    "java": "java",
    "js": "javascript",
    "json": "json",
    "jsx": "javascript",
    "kt": "kotlin",
    "md": "markdown",
    "php": "php",
    "py": "python",
    "rb": "ruby",
    "rs": "rust",
    "scss": "scss",
    "sh": "bash",
    "swift": "swift",
    "toml": "toml",
    "ts": "typescript",
    "tsx": "tsx",
    "vue": "vue",
    "yaml": "yaml",
    "yml": "yaml",
}
# Endings of generated files, which have no language.
GENERATED = (".min.js", ".min.css", ".g.cs", ".designer.cs", ".Designer.cs", ".generated.cs")


def normalize_content(text: Column) -> Column:
    """One leading byte-order mark goes; CR LF and CR become LF."""
    return F.regexp_replace(F.regexp_replace(text, r"^\x{FEFF}", ""), r"\r\n?", "\n")


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_BLANK}+|{_BLANK}+$", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the normalised text, hex."""
    return F.sha2(normalize_content(text), 256)


def raw_hash(content: Column) -> Column:
    """SHA-256 of the bytes as they are."""
    return F.sha2(content.cast("binary"), 256)


def json_long(document: Column, name: str) -> Column:
    """A whole number of a JSON object's member."""
    return F.get_json_object(document, f"$.{name}").cast("long")


def language_of(path: Column) -> Column:
    """Language by extension; null for unknown extensions and generated files."""
    generated = F.lit(False)
    for end in GENERATED:
        generated = generated | path.endswith(end)
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.when(~generated, F.try_element_at(table, F.regexp_extract(F.lower(path), r"[^/]\.([a-z0-9]+)$", 1)))


def chunk_id(project: Column, source: Column, path: Column, url: Column, kind: Column, content: Column) -> Column:
    """Content-addressed id: SHA-256 over the six fields, parted by NUL; null counts as empty."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(c, F.lit("")) for c in (project, source, path, url, kind, content))), 256)


def legacy_chunk_id(project: Column, source: Column, language: Column, content: Column) -> Column:
    """Ids of the first scheme, which did not hold paths."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(c, F.lit("")) for c in (project, source, language, content))), 256)


def table_name(project: Column, source: Column, model: Column, dims: Column, profile: str = "code") -> Column:
    """code_ or knowledge_ and twelve hex digits of the identity's hash."""
    return F.concat(F.lit(f"{profile}_"), F.substring(F.sha2(F.concat_ws(":", project, source, model, dims.cast("string")), 256), 1, 12))


def branch_slug(branch: Column) -> Column:
    """``*`` is written _all_, ``/`` as two underscores."""
    return F.when(branch == "*", F.lit("_all_")).otherwise(F.replace(branch, F.lit("/"), F.lit("__")))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def ephemeral_label(ref: Column) -> Column:
    """A label under _ephemeral/ for a branch or a full ref."""
    short = F.regexp_replace(ref, r"^refs/(heads|remotes|tags)/", "")
    return F.when(short.startswith("_ephemeral/"), short).otherwise(F.concat(F.lit("_ephemeral/"), F.element_at(F.split(short, "/"), -1)))


def ticket_path(path: Column, url: Column) -> Column:
    """Old ``tickets/N`` paths become issues/N, with the note's number from the url's suffix."""
    number = F.regexp_extract(path, r"^tickets/(\d+)$", 1)
    note = F.regexp_extract(F.coalesce(url, F.lit("")), r"#note_(\d+)$", 1)
    return F.when(number == "", path).when(note == "", F.concat(F.lit("issues/"), number)).otherwise(F.concat(F.lit("issues/"), number, F.lit("#note_"), note))


def semver_key(version: Column) -> Column:
    """Orders dotted versions: three numbers; a pre-release sorts before its release."""
    plain = F.regexp_replace(version, r"^v", "")
    core = F.split(F.split(plain, "[-+]")[0], r"\.")
    part = [F.coalesce(F.get(core, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(3)]
    return F.struct(*(p.alias(f"p{i}") for i, p in enumerate(part)), F.when(plain.contains("-"), F.lit(0)).otherwise(F.lit(1)).alias("release"), F.regexp_extract(plain, r"-([^+]*)", 1).alias("pre"))


def result_line(score: Column, path: Column, start: Column, end: Column, language: Column, symbol: Column) -> Column:
    """One display line of a search result."""
    tail = F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit(" · "), symbol)).otherwise("")
    return F.concat(F.format_string("[%.3f] %s:%d-%d (%s)", score, path, start, end, language), tail)
