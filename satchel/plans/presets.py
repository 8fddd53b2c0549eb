"""Named overlays of the selection settings.

A preset touches selection, caps and layout only; it never changes what is
scanned or hidden.
"""

from __future__ import annotations

from dataclasses import replace

from satchel.functions.rules import NO_EXCLUDE_REGEX
from satchel.plans.settings import DEFAULT_EXTENSIONS, RunSettings

# Extension sets of the two narrow presets.
FRONTEND_EXTENSIONS = (
    ".js", ".jsx", ".ts", ".tsx", ".vue", ".svelte", ".css", ".scss", ".html", ".json",
)
DOCS_EXTENSIONS = (".md", ".mdx", ".txt", ".rst", ".adoc")

# Default ignore list of the Repomix packing tool, as ignore rules.
REPOMIX_IGNORE = (
    "/.git", "/.hg", "/.hgignore", "/.svn", "**/node_modules", "**/bower_components",
    "**/jspm_packages", "/vendor", "**/.bundle", "**/.gradle", "/target", "/logs",
    "**/*.log", "**/npm-debug.log*", "**/yarn-debug.log*", "**/yarn-error.log*",
    "/pids", "/*.pid", "/*.seed", "/*.pid.lock", "/lib-cov", "/coverage",
    "/.nyc_output", "/.grunt", "/.lock-wscript", "/build/Release", "/typings",
    "**/.npm", "/.eslintcache", "/.rollup.cache", "/.webpack.cache", "/.parcel-cache",
    "/.sass-cache", "/*.cache", "/.node_repl_history", "/*.tgz", "**/.yarn",
    "**/.yarn-integrity", "/.env", "/.next", "/.nuxt", "/.vuepress/dist",
    "/.serverless", "/.fusebox", "/.dynamodb", "/dist", "**/.DS_Store",
    "**/Thumbs.db", "/.idea", "/.vscode", "**/*.swp", "**/*.swo", "**/*.swn",
    "**/*.bak", "/build", "/out", "/tmp", "/temp", "**/repomix-output.*",
    "**/repopack-output.*", "**/package-lock.json", "**/yarn-error.log",
    "**/yarn.lock", "**/pnpm-lock.yaml", "**/bun.lockb", "**/bun.lock",
    "**/__pycache__", "**/*.py[cod]", "**/venv", "**/.venv", "**/.pytest_cache",
    "**/.mypy_cache", "**/.ipynb_checkpoints", "**/Pipfile.lock", "**/poetry.lock",
    "**/uv.lock", "**/Cargo.lock", "**/Cargo.toml.orig", "**/target", "**/*.rs.bk",
    "**/composer.lock", "**/Gemfile.lock", "**/go.sum", "**/mix.lock",
    "**/stack.yaml.lock", "**/cabal.project.freeze",
)

# Default ignore set of the Gitingest digest tool, as ignore rules.
GITINGEST_IGNORE = (
    "*.pyc", "*.pyo", "*.pyd", "__pycache__", ".pytest_cache", ".coverage", ".tox",
    ".nox", ".mypy_cache", ".ruff_cache", ".hypothesis", "poetry.lock",
    "Pipfile.lock", "node_modules", "bower_components", "package-lock.json",
    "yarn.lock", ".npm", ".yarn", ".pnpm-store", "bun.lock", "bun.lockb", "*.class",
    "*.jar", "*.war", "*.ear", "*.nar", ".gradle/", "build/", ".settings/",
    ".classpath", "gradle-app.setting", "*.gradle", ".project", "*.o", "*.obj",
    "*.dll", "*.dylib", "*.exe", "*.lib", "*.out", "*.a", "*.pdb", "*.bin",
    ".build/", "*.xcodeproj/", "*.xcworkspace/", "*.pbxuser", "*.mode1v3",
    "*.mode2v3", "*.perspectivev3", "*.xcuserstate", "xcuserdata/", ".swiftpm/",
    "*.gem", ".bundle/", "vendor/bundle", "Gemfile.lock", ".ruby-version",
    ".ruby-gemset", ".rvmrc", "Cargo.lock", "**/*.rs.bk", "target/", "pkg/", "obj/",
    "*.suo", "*.user", "*.userosscache", "*.sln.docstates", "*.nupkg", "bin/", ".git",
    ".svn", ".hg", ".gitignore", ".gitattributes", ".gitmodules", "*.svg", "*.png",
    "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.pdf", "*.mov", "*.mp4", "*.mp3", "*.wav",
    "venv", ".venv", "env", ".env", "virtualenv", ".idea", ".vscode", ".vs", "*.swo",
    "*.swn", ".settings", "*.sublime-*", "*.log", "*.bak", "*.swp", "*.tmp", "*.temp",
    ".cache", ".sass-cache", ".eslintcache", ".DS_Store", "Thumbs.db", "desktop.ini",
    "build", "dist", "target", "out", "*.egg-info", "*.egg", "*.whl", "*.so",
    "site-packages", ".docusaurus", ".next", ".nuxt", "*.db", "*.sqlite",
    "*.sqlite3", "*.min.js", "*.min.css", "*.map", "*.tfstate*", "vendor/",
    "digest.txt",
)


def _tool(layout: str, ignore: tuple[str, ...]) -> dict:
    return dict(
        layout=layout, selection_mode="Thorough", respect_gitignore=True,
        detect_binary=True, include_globs=(), exclude_globs=ignore,
        exclude_regex=NO_EXCLUDE_REGEX, max_file_bytes=0, max_total_bytes=0,
    )


PRESETS: dict[str, dict] = {
    "classic": dict(
        layout="classic", selection_mode="Basic", respect_gitignore=False,
        use_extra_ignore=False, detect_binary=False, include_globs=(),
        extensions=DEFAULT_EXTENSIONS,
    ),
    "frontend": dict(extensions=FRONTEND_EXTENSIONS, selection_mode="Basic", include_globs=()),
    "docs only": dict(extensions=DOCS_EXTENSIONS, selection_mode="Basic", include_globs=()),
    "repomix": _tool("repomix", REPOMIX_IGNORE),
    "gitingest": _tool("gitingest", GITINGEST_IGNORE),
    "changed files": dict(only_changed=True),
}


def apply_preset(settings: RunSettings, name: str) -> RunSettings:
    """Overlay a preset by its name, ignoring case."""
    try:
        return replace(settings, **PRESETS[name.strip().lower()])
    except KeyError:
        raise ValueError(f"Unknown preset: {name}") from None
