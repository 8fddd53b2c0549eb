"""Settings of one packing run."""

from __future__ import annotations

from dataclasses import dataclass

from satchel.functions.rules import DEFAULT_EXCLUDE_REGEX

# Types packed by default.
DEFAULT_EXTENSIONS = (
    ".html", ".css", ".js", ".ts", ".json", ".md", ".txt", ".php", ".py", ".cs", ".xml",
    ".yml", ".yaml",
)
DEFAULT_DOT_FILES = (".gitignore", ".gitattributes", ".editorconfig", ".env", ".env.example")

LAYOUTS = (
    "classic", "plain", "markdown", "markdown_ai", "markdown_compact", "json",
    "json_compact", "xml", "xml_compact", "repomix", "gitingest",
)
SCAN_MODES = ("Off", "Warn", "Redact", "Skip")
SELECTION_MODES = ("Basic", "Thorough", "None")


@dataclass(frozen=True)
class RunSettings:
    """What to select, protect and write.  Zero means no cap, no budget and no limit of findings."""

    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
    dot_files: tuple[str, ...] = DEFAULT_DOT_FILES
    exclude_regex: str = DEFAULT_EXCLUDE_REGEX
    respect_gitignore: bool = True
    use_extra_ignore: bool = True
    extra_ignore_name: str = ".packignore"
    include_globs: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] = ()
    selection_mode: str = "Basic"
    detect_binary: bool = True
    max_file_bytes: int = 0
    max_total_bytes: int = 0
    max_tokens: int = 0
    scan_mode: str = "Warn"
    scan_entropy: bool = False
    allow_patterns: tuple[str, ...] = ()
    hide_patterns: tuple[str, ...] = ()
    layout: str = "classic"
    only_changed: bool = False
    token_encoding: str = "estimate"
    producer: str = "Satchel"
    max_findings: int = 0

    def __post_init__(self) -> None:
        for value, known in (
            (self.scan_mode, SCAN_MODES),
            (self.selection_mode, SELECTION_MODES),
            (self.layout, LAYOUTS),
        ):
            if value not in known:
                raise ValueError(f"{value!r} is not one of {', '.join(known)}")
