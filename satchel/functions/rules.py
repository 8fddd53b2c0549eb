"""Gitignore-style path rules as Column expressions.

Rules are translated once to regular expressions, and most of them to look-ups: a rule that is a
plain name, a plain path or ``*.suffix`` of ASCII characters is an entry in a set, which a path
meets by its own name, its whole and the suffixes of its name.  Only the rest stays regexes,
neighbours of the same polarity merged into one alternation.  A list that is known when
the plan is made becomes such sets in the plan (``ignored``); lists that come out of the data become
maps from look-up keys to the number of the last rule (``rule_maps``, ``judged``), and regexes run only
where a later rule than the one already found could still match.

Rules ignore case as Java's Unicode case folding does: besides A-Z four other characters
meet ASCII letters, and keys fold them alike.  Paths with a line feed, which regexes treat in
their own way, are left to the regexes of all rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

# The built-in folder-name exclusion, on a path that starts with a
# backslash, and the pattern that switches it off.
DEFAULT_EXCLUDE_REGEX = r"\\(\.git|\.vs|node_modules|dist|build|bin|obj)(\\|$)"
NO_EXCLUDE_REGEX = "(?!)"

# Case-insensitive, Unicode case folding, and only \n ends a line.
FLAGS = "(?iud)"
_SPECIAL = set("\\.^$|?*+()[]{}#-&~ ")


@dataclass(frozen=True)
class PathRule:
    """One translated rule; ``body`` is the regex without anchors or flags.

    ``kind`` and ``key`` name the look-up that does the same: ``name``, ``suffix`` or ``path``; none for
    rules that need their regex.
    """

    body: str
    negate: bool = False
    dir_only: bool = False
    kind: str | None = None
    key: str | None = None

    @property
    def regex(self) -> str:
        return f"^{self.body}$"


def _escape(ch: str) -> str:
    return "\\" + ch if ch in _SPECIAL else ch


_TOKEN = re.compile(
    r"(?P<tree>\*\*/)|(?P<any>\*\*)|(?P<some>\*)|(?P<one>\?)"
    r"|\[(?P<neg>!?+)(?P<members>\]?+[^\]]*)\]|(?P<char>.)",
    re.S,
)
_WILDCARDS = {"tree": "(?:.*/)?", "any": ".*", "some": "[^/]*", "one": "[^/]"}


def _bracket(negated: str, members: str) -> str:
    """Regex class of a bracket expression, which never matches the separator."""
    text = re.sub(r"([\\\]\[&])", r"\\\1", members.replace("/", ""))
    if negated:
        # After the added '/', a leading '-' must stay a member, not a range.
        return "[^/" + ("\\" if text.startswith("-") else "") + text + "]"
    return "[" + text + "]" if text else "(?!)"


def _token_regex(m: re.Match) -> str:
    if m["char"] is not None:
        return _escape(m["char"])
    if m["members"] is not None:
        return _bracket(m["neg"], m["members"])
    return _WILDCARDS[m.lastgroup]


# What folds to an ASCII letter, and to which.
_FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u0130\u0131\u017f\u212a"
_FOLDS_TO = "abcdefghijklmnopqrstuvwxyziisk"
_PLAIN_NAME = re.compile(r"[ -~]+", re.A)


def _look_up(text: str, floating: bool) -> tuple[str | None, str | None]:
    """Kind and key of a rule that needs no regex."""
    # In any folder: the same as a rule without a separator.
    anywhere = text.startswith("**/")
    while text.startswith("**/"):
        text = text[3:]
    floating = floating or anywhere
    if floating and "/" in text:
        return None, None
    suffix = floating and text.startswith("*.")
    literal = text[1:] if suffix else text
    if not _PLAIN_NAME.fullmatch(literal) or any(c in literal for c in "*?["):
        return None, None
    return "suffix" if suffix else "name" if floating else "path", literal.lower()


def translate(line: str) -> PathRule | None:
    """One ignore line; ``None`` for blanks and comments; ValueError when malformed."""
    text = line.rstrip()
    if not text or text.startswith("#"):
        return None
    negate = text.startswith("!")
    text = text[1:] if negate else text
    dir_only = text.endswith("/")
    text = text[:-1] if dir_only else text
    if not text:
        return None
    floating = "/" not in text
    text = text[1:] if text.startswith("/") else text

    body = "".join(map(_token_regex, _TOKEN.finditer(text)))
    rule = PathRule(("(?:.*/)?" if floating else "") + body, negate, dir_only, *_look_up(text, floating))
    try:
        re.compile(rule.regex)
    except re.error:
        raise ValueError("A path rule is malformed; fix it before filtering.") from None
    return rule


def compile_rules(lines: Iterable[str]) -> list[PathRule]:
    return [r for r in map(translate, lines) if r is not None]


def folded(path: Column) -> Column:
    """The key of a path for look-ups."""
    return F.translate(path, _FOLDED, _FOLDS_TO)


def _name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def _suffixes(key: Column) -> Column:
    """Each end of the name that begins with a dot: ``.min.js`` and ``.js`` of ``a.min.js``."""
    parts = F.split(_name(key), r"\.")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.when(
        i <= F.size(parts), F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), "."))))


def _regex(path: Column, rules: list[PathRule]) -> Column:
    bodies = "|".join(dict.fromkeys(r.body for r in rules))
    return F.rlike(path, F.lit(f"{FLAGS}^(?:{bodies})$"))


def _matches(path: Column, rules: list[PathRule]) -> Column:
    """Any of the rules, by sets where there are such and by one regex for the rest."""
    keys = {kind: list(dict.fromkeys(r.key for r in rules if r.kind == kind)) for kind in ("name", "suffix", "path")}
    key = folded(path)
    tests = []
    if keys["name"]:
        tests.append(_name(key).isin(keys["name"]))
    if keys["path"]:
        tests.append(key.isin(keys["path"]))
    if keys["suffix"]:
        tests.append(F.exists(_suffixes(key), lambda x: F.coalesce(x.isin(keys["suffix"]), F.lit(False))))
    if rest := [r for r in rules if r.kind is None]:
        tests.append(_regex(path, rest))
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    if len(rest) == len(rules):
        return found
    return F.when(F.contains(path, F.lit("\n")), _regex(path, rules)).otherwise(found)


def _block_matches(path: Column, is_dir: Column, rules: list[PathRule]) -> Column:
    anywhere = [r for r in rules if not r.dir_only]
    dirs = [r for r in rules if r.dir_only]
    tests = []
    if anywhere:
        tests.append(_matches(path, anywhere))
    if dirs:
        tests.append(is_dir & _matches(path, dirs))
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


# Look-up maps hold, for each key, 2 * number of its last rule, one more if that rule re-includes;
# for all paths and for directories.
_LAST = T.MapType(T.StringType(), T.StructType([T.StructField("any", T.IntegerType()), T.StructField("dir", T.IntegerType())]))
_REST = T.ArrayType(T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("regex", T.StringType()), T.StructField("dir_only", T.BooleanType())]))
RULE_MAPS = T.StructType([T.StructField(n, _LAST) for n in ("names", "suffixes", "paths")] + [T.StructField(n, _REST) for n in ("rest", "every")])


def rule_maps(rules: list[PathRule]) -> dict:
    """One rule list, first rule first, as a value of ``RULE_MAPS``."""
    out: dict = {"names": {}, "suffixes": {}, "paths": {}, "rest": [], "every": []}
    kinds = {"name": "names", "suffix": "suffixes", "path": "paths"}
    for number, rule in enumerate(rules, 1):
        rank = 2 * number + rule.negate
        row = {"rank": rank, "regex": FLAGS + rule.regex, "dir_only": rule.dir_only}
        out["every"].append(row)
        if rule.kind is None:
            out["rest"].append(row)
            continue
        entry = out[kinds[rule.kind]].setdefault(rule.key, {"any": 0, "dir": 0})
        entry["dir"] = rank
        if not rule.dir_only:
            entry["any"] = rank
    return out


def judged(path: Column, is_dir: Column, maps: Column) -> Column:
    """Whether the last rule that matches excludes the path; ``maps`` as from ``rule_maps``, null: no rules."""
    key = folded(path)

    def rank(found: Column) -> Column:
        return F.coalesce(F.when(is_dir, found["dir"]).otherwise(found["any"]), F.lit(0))

    looked = F.greatest(
        rank(maps["names"][_name(key)]), rank(maps["paths"][key]),
        F.aggregate(_suffixes(key), F.lit(0), lambda a, x: F.greatest(a, F.when(x.isNotNull(), rank(maps["suffixes"][x])).otherwise(0))))

    def walked(rules: Column, begin: Column) -> Column:
        # A regex runs only where its rule comes after what was found.
        return F.aggregate(rules, begin, lambda a, r: F.when(
            (r["rank"] > a) & (is_dir | ~r["dir_only"]) & F.rlike(path, r["regex"]), r["rank"]).otherwise(a))

    # Last rules first: what they find spares those before.
    last = F.when(F.contains(path, F.lit("\n")), walked(F.reverse(maps["every"]), F.lit(0))).otherwise(walked(F.reverse(maps["rest"]), looked))
    return F.coalesce((last > 0) & (last % 2 == 0), F.lit(False))


def ignored(path: Column, is_dir: Column, rules: list[PathRule]) -> Column:
    """Last match wins: walk blocks of equal polarity from the end, stop at the first hit."""
    blocks: list[list[PathRule]] = []
    for rule in rules:
        if blocks and blocks[-1][0].negate == rule.negate:
            blocks[-1].append(rule)
        else:
            blocks.append([rule])
    chain = None
    for block in reversed(blocks):
        hit = _block_matches(path, is_dir, block)
        verdict = F.lit(not block[0].negate)
        chain = F.when(hit, verdict) if chain is None else chain.when(hit, verdict)
    return F.lit(False) if chain is None else chain.otherwise(F.lit(False))


def legacy_excluded(path: Column, pattern: str, full_path: Column | None = None) -> Column:
    """The hard layer no ``!`` rule can undo.

    The built-in pattern sees the relative path, so a corpus kept in a folder
    called ``build`` does not exclude itself; any other pattern sees the full
    path with backslashes.
    """
    if not pattern.strip() or pattern == NO_EXCLUDE_REGEX:
        return F.lit(False)
    if pattern == DEFAULT_EXCLUDE_REGEX or full_path is None:
        subject = F.concat(F.lit("\\"), F.translate(path, "/", "\\"))
    else:
        subject = F.translate(full_path, "/", "\\")
    return F.rlike(subject, F.lit("(?iu)" + pattern))


def excluded(
    path: Column,
    is_dir: Column,
    rules: list[PathRule],
    pattern: str = DEFAULT_EXCLUDE_REGEX,
    full_path: Column | None = None,
) -> Column:
    """This one entry is dropped (its ancestors are not looked at)."""
    hard = legacy_excluded(path, pattern, full_path)
    return hard | ignored(path, is_dir, rules)


def in_corpus(path: Column) -> Column:
    """The full path that user patterns see: below the corpus."""
    return F.concat(F.col("corpus"), F.lit("/"), path)


def excluded_with_ancestors(
    path: Column, is_dir: Column, rules: list[PathRule], pattern: str = DEFAULT_EXCLUDE_REGEX,
    full: Callable[[Column], Column] | None = None,
) -> Column:
    """Row-wise pruning: the entry or any directory above it is dropped.

    Needs no shuffle, so it also serves streams.  ``full`` makes a full path of a relative one.
    """
    parts = F.split(path, "/", -1)
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )
    test: Callable[[Column], Column] = lambda a: excluded(
        a, (a != path) | is_dir, rules, pattern, full(a) if full else None
    )
    return F.exists(above, test)


def included(path: Column, rules: list[PathRule]) -> Column:
    """Content eligibility under include globs; ``!`` and ``/`` suffixes carry no meaning here."""
    return _matches(path, rules) if rules else F.lit(True)
