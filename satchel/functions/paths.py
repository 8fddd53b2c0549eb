"""Path, name and size expressions.

Every function takes and returns Columns, so all of it stays inside the JVM and
composes with filters, joins and aggregates.  Paths use ``/``; keys are compared
ignoring case through ``path_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extension -> language id of a fenced code block.
LANGUAGE_BY_EXTENSION = {
    ".cs": "csharp", ".js": "javascript", ".ts": "typescript", ".jsx": "jsx",
    ".tsx": "tsx", ".py": "python", ".rb": "ruby", ".php": "php", ".java": "java",
    ".kt": "kotlin", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".c": "c", ".h": "c", ".html": "html", ".css": "css",
    ".json": "json", ".xml": "xml", ".yml": "yaml", ".yaml": "yaml",
    ".toml": "toml", ".ini": "ini", ".md": "markdown", ".sh": "bash",
    ".ps1": "powershell", ".psm1": "powershell", ".psd1": "powershell",
    ".sql": "sql",
}

# Separates path levels inside sort keys: lower than any printable character, so
# a shorter name sorts before a longer one that starts with it.
LEVEL = "\u0001"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize(path: Column | str) -> Column:
    """``\\`` becomes ``/``; slashes at both ends are dropped."""
    return F.btrim(F.translate(_c(path), "\\", "/"), F.lit("/"))


def path_key(path: Column | str) -> Column:
    return F.upper(_c(path))


def segments(path: Column | str) -> Column:
    return F.split(_c(path), "/", -1)


def depth(path: Column | str) -> Column:
    """Number of segments; the root (empty path) has depth 0."""
    p = _c(path)
    return F.when(p == "", F.lit(0)).otherwise(F.size(segments(p)))


def name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def parent(path: Column | str) -> Column:
    p = _c(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty for none or for a final dot."""
    return F.lower(F.regexp_extract(name(path), r"(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    """The name without its extension (a leading-dot name counts as extension)."""
    return F.regexp_replace(name(path), r"\.[^.]*$", "")


def ancestors(path: Column | str, include_self: bool = False) -> Column:
    """Directories above a path, root (``''``) first; ``a/b/c`` -> ``['', 'a', 'a/b']``."""
    parts = segments(path)
    last = F.size(parts) if include_self else F.size(parts) - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def type_kind(path: Column | str) -> Column:
    n = name(path)
    return (
        F.when(F.startswith(n, F.lit(".")) & (F.length(n) > 1), F.lit("DotFile"))
        .when(extension(path) == "", F.lit("Extensionless"))
        .otherwise(F.lit("Extension"))
    )


def type_value(path: Column | str) -> Column:
    n = name(path)
    return F.when(
        F.startswith(n, F.lit(".")) & (F.length(n) > 1), F.lower(n)
    ).otherwise(extension(path))


def is_basic(path: Column | str, extensions: list[str], dot_files: list[str]) -> Column:
    """The type is one of the configured ones; a dot file counts by its full name."""
    kind, value = type_kind(path), type_value(path)
    return (
        F.when(kind == "Extension", value.isin([e.lower() for e in extensions]))
        .when(kind == "DotFile", value.isin([d.lower() for d in dot_files]))
        .otherwise(F.lit(False))
    )


def is_legible(path: Column | str, extensions: list[str], dot_files: list[str]) -> Column:
    """Extension in the set, or the exact name in the dot-file list."""
    return extension(path).isin([e.lower() for e in extensions]) | F.lower(name(path)).isin(
        [d.lower() for d in dot_files]
    )


def is_minified(path: Column | str) -> Column:
    return F.contains(F.lower(name(path)), F.lit(".min."))


def under(path: Column | str, focus: str) -> Column:
    """The path is ``focus`` or lies below it, ignoring case; ``''`` means everything."""
    key = focus.replace("\\", "/").strip("/").upper()
    if not key:
        return F.lit(True)
    return (path_key(path) == key) | F.startswith(path_key(path), F.lit(key + "/"))


def format_size(size: Column | str) -> Column:
    """Steps of 1024, one decimal above bytes, never beyond GB."""
    n = _c(size)
    d = n.cast("double")

    def scaled(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", d / float(1024**power))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, scaled(1, "KB"))
        .when(n < 1024**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def language_for(path: Column | str) -> Column:
    ext = extension(path)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.element_at(table, ext), F.substring(ext, 2, 2147483647))


def thousands(n: Column | str) -> Column:
    return F.format_number(_c(n), 0)


def safe_name(n: Column | str) -> Column:
    """A base name usable as a file name: runs of reserved characters become ``_``."""
    cleaned = F.regexp_replace(_c(n), r'[\\/:*?"<>|]+', "_")
    return F.when(F.trim(cleaned) == "", F.lit("dump")).otherwise(cleaned)


def estimate_tokens(size: Column | str) -> Column:
    """A quarter of the byte count, rounded up."""
    return F.shiftright(_c(size).cast("bigint") + 3, 2)


def comment_safe(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("--"), F.lit("—"))


# ---- sort keys -----------------------------------------------------------
# Each order is one string compared bytewise (or one array compared element by
# element), so a range-partitioned sort gives the total order without a global
# window.


def _per_level(path: Column | str, is_dir: Column | str, mark) -> Column:
    parts = segments(path)
    last = F.size(parts) - 1
    d = _c(is_dir)
    return F.transform(parts, lambda s, i: mark(s, (i == last) & ~d))


def tree_key(path: Column | str, is_dir: Column | str) -> Column:
    """Directories before files, then names ignoring case, at every level."""
    return F.array_join(
        _per_level(path, is_dir, lambda s, leaf: F.concat(
            F.when(leaf, F.lit("1")).otherwise(F.lit("0")), F.upper(s), F.lit(LEVEL), s)),
        LEVEL,
    )


def locale_key(path: Column | str, is_dir: Column | str) -> Column:
    """Directories before files at the first differing level, else locale order."""
    return _per_level(path, is_dir, lambda s, leaf: F.struct(
        leaf.cast("int").alias("leaf"), F.collate(s, "UNICODE").alias("name")))


def digest_key(path: Column | str, is_dir: Column | str) -> Column:
    """README, files, hidden files, directories, hidden directories; then lower-case name."""

    def mark(s: Column, leaf: Column) -> Column:
        low = F.lower(s)
        hidden = F.startswith(low, F.lit("."))
        group = (
            F.when(leaf & ((low == "readme") | F.startswith(low, F.lit("readme."))), F.lit("0"))
            .when(leaf & hidden, F.lit("2"))
            .when(leaf, F.lit("1"))
            .when(hidden, F.lit("4"))
            .otherwise(F.lit("3"))
        )
        return F.concat(group, low, F.lit(LEVEL), s)

    return F.array_join(_per_level(path, is_dir, mark), LEVEL)
