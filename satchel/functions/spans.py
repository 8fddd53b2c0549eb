"""Spans inside a body, as arrays of structs; no UDF anywhere.

A span is ``(rule_id, tier, start, length, value)`` with a 0-based character
offset.  Matching, validation, overlap resolution, redaction and line numbers are
array expressions on the row that holds the body, so scanning never shuffles a
body.

The expressions are long, so they are composed as Spark SQL text: functions that
start with ``_`` take and return SQL, the public ones wrap it in a Column.
``_let`` binds a value to a name so that it is evaluated once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from satchel.functions.detectors import (
    ASSIGNMENT_GATE, CUSTOM, CUSTOM_ID, DETECTORS, ENTROPY, MARKED_GATE, MIN_ENTROPY, Detector,
)

SPAN = "array<struct<rule_id:string,tier:int,start:int,length:int,value:string>>"
_EMPTY = f"cast(array() as {SPAN})"
_names = itertools.count()


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fresh(stem: str) -> str:
    return f"{stem}{next(_names)}"


def _let(value: str, body: Callable[[str], str]) -> str:
    name = _fresh("x")
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


_BLOCK = 64


def _before(values: str, combine: str) -> str:
    """For each element of an array of numbers, what ``combine`` (of ``a`` and ``x``) makes of those before it, from 0.

    Up to a block, each from its beginning.  Beyond, blocks first, then inside each block:
    linear, where a growing array would be copied at every element.
    """
    v, w, b, k, i = (_fresh(x) for x in ("v", "w", "b", "k", "i"))
    fold = lambda part: f"aggregate({part}, 0, (a, x) -> {combine})"
    numbers = f"sequence(0, (size({v}) - 1) div {_BLOCK})"
    whole = f"transform({numbers}, {k} -> {fold(f'slice({v}, {k} * {_BLOCK} + 1, {_BLOCK})')})"
    placed = (
        f"flatten(transform({numbers}, {k} -> {_let(fold(f'slice({w}, 1, {k})'), lambda start: (
            f'transform(sequence(0, least({_BLOCK}, size({v}) - {k} * {_BLOCK}) - 1), {i} -> '
            f'aggregate(slice({v}, {k} * {_BLOCK} + 1, {i}), {start}, (a, x) -> {combine}))'))}))")
    with_blocks = f"element_at(transform(array({whole}), {w} -> {placed}), 1)"
    short = f"transform(sequence(0, size({v}) - 1), {i} -> {fold(f'slice({v}, 1, {i})')})"
    return (
        f"element_at(transform(array({values}), {v} -> CASE WHEN size({v}) = 0 THEN cast(array() as array<int>) "
        f"WHEN size({v}) = 1 THEN array(0) WHEN size({v}) <= {_BLOCK} THEN {short} ELSE {with_blocks} END), 1)")


def _hits(text: str, pattern: str, rule_id: str, tier: int, prefix: str = "", gate: str = "") -> str:
    """What one regex finds: the matches, the lengths of the text between them and of their context.

    The matches come from ``regexp_extract_all``, the text between them from ``split``; neither is
    looked at where ``gate`` does not hold.
    """
    p, none = _lit(pattern), "cast(array() as array<int>)"
    found = f"regexp_extract_all({text}, {p}, 0)"
    if gate:
        found = f"CASE WHEN {gate} THEN {found} ELSE cast(array() as array<string>) END"

    def described(m: str) -> str:
        gaps = f"CASE WHEN size({m}) > 0 THEN transform(slice(split({text}, {p}, -1), 1, size({m})), g -> length(g)) ELSE {none} END"
        skips = f"transform({m}, m -> length(regexp_extract(m, {_lit(prefix)}, 0)))" if prefix else none
        return f"named_struct('rule_id', {_lit(rule_id)}, 'tier', {tier}, 'found', {m}, 'gaps', {gaps}, 'skips', {skips})"

    return _let(found, described)


def _located(hits: str) -> str:
    """Spans of all rules that found something: adding up lengths gives the offsets."""
    h, m, i = _fresh("h"), _fresh("m"), _fresh("i")
    ends = _before(f"zip_with({h}.gaps, {h}.found, (x, y) -> x + length(y))", "a + x")
    skip = f"coalesce(get({h}.skips, {i}), 0)"

    def spans(before: str) -> str:
        return (
            f"transform({h}.found, ({m}, {i}) -> named_struct('rule_id', {h}.rule_id, 'tier', {h}.tier, "
            f"'start', get({before}, {i}) + get({h}.gaps, {i}) + {skip}, 'length', length({m}) - {skip}, 'value', substr({m}, {skip} + 1)))")

    some = _fresh("r")
    return f"flatten(transform(filter({hits}, {some} -> size({some}.found) > 0), {h} -> {_let(ends, spans)}))"


def _clusters(spans: str, end: str) -> str:
    """Spans sorted by start, cut where one begins at or after the ends of all before it.  ``end``: SQL over ``s``."""

    def cut(x: str) -> str:
        reach = _before(f"transform({x}, s -> {end})", "greatest(a, x)")
        firsts = _let(reach, lambda r: f"filter(sequence(0, size({x}) - 1), i -> i = 0 OR get({x}, i).start >= get({r}, i))")
        return _let(firsts, lambda f: (
            f"transform({f}, (c, k) -> slice({x}, c + 1, coalesce(get({f}, k + 1), size({x})) - c))"))

    return _let(spans, cut)


# ---- validators ----------------------------------------------------------


def _iban_valid(value: str) -> str:
    """The rearranged number leaves remainder 1 modulo 97."""
    code = "(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"

    def check(plain: str) -> str:
        turned = f"concat(substr({plain}, 5), substr({plain}, 1, 4))"
        folded = (
            f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, "
            f"(acc, c) -> (CASE WHEN {code} < 10 THEN acc * 10 ELSE acc * 100 END + {code}) % 97)"
        )
        return f"(length({plain}) BETWEEN 15 AND 34 AND {folded} = 1)"

    return _let(f"replace({value}, ' ', '')", check)


def _card_valid(value: str) -> str:
    """13 to 19 digits, Luhn checksum, not all zeros."""
    return _let(
        f"translate({value}, ' -', '')",
        lambda d: f"(length({d}) BETWEEN 13 AND 19 AND luhn_check({d}) AND NOT {d} RLIKE '^0+$')")


def _entropy(value: str) -> str:
    """Shannon entropy in bits per character."""
    return _let(
        f"filter(split({value}, ''), c -> c <> '')",
        lambda cs: (
            f"aggregate(transform(array_distinct({cs}), u -> size(filter({cs}, c -> c = u)) / size({cs})), "
            "double(0), (acc, p) -> acc - p * log2(p))"))


_VALID = {
    "iban": _iban_valid,
    "payment-card": _card_valid,
    ENTROPY.rule_id: lambda v: f"{_entropy(v)} > {MIN_ENTROPY}",
}


# ---- scanning ------------------------------------------------------------


def _any_of(text: str, literals: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(x)})" for x in literals) + ")"


def _detect(text: str, gated: str, d: Detector) -> str:
    return _hits(text, d.pattern, d.rule_id, d.tier, d.prefix, _any_of(gated, d.gate) if d.gate else "")


_HITS = "array<struct<rule_id:string,tier:int,found:array<string>,gaps:array<int>,skips:array<int>>>"


def _automatic(text: str, scan_entropy: bool, allow: Sequence[str]) -> str:
    """Spans of every built-in rule, before overlaps are resolved."""

    def family(name: str, gated: str, *more: Detector) -> str:
        return "array(" + ", ".join(_detect(text, gated, d) for d in (*(d for d in DETECTORS if d.family == name), *more)) + ")"

    none = f"cast(array() as {_HITS})"
    parts = [
        f"CASE WHEN {text} RLIKE {_lit(MARKED_GATE)} THEN {family('marked', text)} ELSE {none} END",
        f"CASE WHEN {_any_of(text, ASSIGNMENT_GATE)} THEN "
        + _let(f"lower({text})", lambda low: family("assignment", low)) + f" ELSE {none} END",
        family("", text, *((ENTROPY,) if scan_entropy else ())),
    ]
    valid = " ".join(f"WHEN {_lit(rule)} THEN {test('s.value')}" for rule, test in _VALID.items())
    found = f"filter({_located('concat(' + ', '.join(parts) + ')')}, s -> CASE s.rule_id {valid} ELSE true END)"
    if allow:
        # The allowlist looks at the detected value only.
        hits = " OR ".join(f"s.value RLIKE {_lit(p)}" for p in allow)
        found = f"filter({found}, s -> NOT ({hits}))"
    return found


_AS_SPAN = (
    "s -> named_struct('rule_id', s.rule_id, 'tier', s.tier, 'start', s.start, 'length', s.length, 'value', s.value)")


def _sorted(spans: str, first: Sequence[str]) -> str:
    """Spans ordered by the named fields; ``shorter`` puts longer spans first."""
    rest = [f for f in ("start", "shorter", "rule_id", "tier", "length", "value") if f not in first]
    pairs = ", ".join(
        f"'{f}', " + ("-s.length" if f == "shorter" else f"s.{f}") for f in (*first, *rest))
    return f"transform(array_sort(transform({spans}, s -> named_struct({pairs}))), {_AS_SPAN})"


def _if_several(spans: str, body: Callable[[str], str]) -> str:
    """Most bodies hold at most one span; only the others need ``body``."""
    return _let(spans, lambda x: f"CASE WHEN size({x}) < 2 THEN {x} ELSE {body(x)} END")


def _resolved(spans: str) -> str:
    """Among automatic spans the surer tier wins, then the earlier, then the longer.

    Only spans of one cluster can be in each other's way, so each cluster is resolved alone.
    """
    clear = "NOT exists(acc, k -> k.start < s.start + s.length AND s.start < k.start + k.length)"
    c = _fresh("c")
    one = (
        f"aggregate({_sorted(c, ('tier', 'start', 'shorter'))}, {_EMPTY}, "
        f"(acc, s) -> CASE WHEN {clear} THEN concat(acc, array(s)) ELSE acc END)")
    clusters = _clusters(_sorted(spans, ("start", "shorter")), "s.start + s.length")
    return f"flatten(transform({clusters}, {c} -> CASE WHEN size({c}) = 1 THEN {c} ELSE {one} END))"


def _all(text: str, automatic: bool, scan_entropy: bool, allow: Sequence[str], hide: Sequence[str]) -> str:
    parts = []
    if automatic:
        parts.append(_if_several(_automatic(text, scan_entropy, allow), _resolved))
    if hide:
        found = ", ".join(_hits(text, p, CUSTOM_ID, CUSTOM) for p in hide)
        parts.append(f"array_distinct({_located(f'array({found})')})")
    if not parts:
        return _EMPTY
    joined = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    return _if_several(joined, lambda x: _sorted(x, ("start", "shorter", "rule_id")))


def all_spans(text: str, automatic: bool = True, scan_entropy: bool = False,
              allow: Sequence[str] = (), hide: Sequence[str] = ()) -> Column:
    """Resolved automatic spans beside every custom span, in reading order.

    ``text`` names a column.
    """
    return F.expr(_all(f"`{text}`", automatic, scan_entropy, allow, hide))


def capped_spans(full: str, capped: str, shown: str) -> Column:
    """Spans of the whole and of the capped body, clipped to what stays visible.

    ``full`` and ``capped`` name span columns, ``shown`` the capped text.  A value
    that crosses the cap is recognised in the whole body only, one that exists
    only because of the cut in the capped body only; both must be hidden.
    """

    def union(visible: str) -> str:
        clipped = (
            f"transform(filter({full}, s -> s.start < {visible}), s -> named_struct('rule_id', s.rule_id, "
            f"'tier', s.tier, 'start', s.start, 'length', least(s.length, {visible} - s.start), 'value', s.value))")
        same = "s.start = c.start AND s.length = c.length AND s.rule_id = c.rule_id"
        return _let(clipped, lambda x: _sorted(
            f"concat({x}, filter({capped}, c -> NOT exists({x}, s -> {same})))", ("start", "shorter", "rule_id")))

    return F.expr(_let(f"length({shown})", union))


# ---- masking and redaction -----------------------------------------------


def masked_sql(rule_id: str, value: str, hide: Sequence[str] = ()) -> str:
    """A preview that never shows the value, and never a hidden part of it."""
    domain = f"substring_index({value}, '@', -1)"
    compact = f"translate({value}, ' -', '')"
    preview = f"""CASE
      WHEN {rule_id} = {_lit(CUSTOM_ID)} THEN '********'
      WHEN {rule_id} = 'private-key' THEN '[private key]'
      WHEN {rule_id} = 'email-address' THEN concat(left({value}, 1), '***@', left({domain}, 1), '***.',
        substring_index({domain}, '.', -1))
      WHEN {rule_id} = 'payment-card' THEN concat('**** **** **** ', right({compact}, 4))
      WHEN {rule_id} = 'iban' THEN concat('**** ', right({compact}, 4))
      WHEN {rule_id} = 'phone-number' THEN concat('*** ', right({compact}, 2))
      WHEN {rule_id} IN ('common-password', 'password-assignment')
        THEN concat(left({value}, 1), repeat('*', length({value}) - 1))
      WHEN length({value}) >= 16 THEN concat(left({value}, 4), '********')
      ELSE '********' END"""
    for pattern in hide:
        preview = f"regexp_replace({preview}, {_lit(pattern)}, '***')"
    return preview


def masked(rule_id: str, value: str, hide: Sequence[str] = ()) -> Column:
    return F.expr(masked_sql(rule_id, value, hide))


#: Characters of a block, and how many cuts of a text are worth having it in blocks.
_PIECE, _FEW_CUTS = 4096, 16
_LINE_END = "'\\\\r\\\\n|\\\\r|\\\\n'"


def _blocks(text: str) -> str:
    """The text in blocks of equal numbers of characters."""
    return f"regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0)"


def _part(blocks: str, start: str, end: str) -> str:
    """Characters from ``start`` up to ``end`` of a text in blocks; touches no other block."""
    first = f"(({start}) div {_PIECE})"
    joined = f"array_join(slice({blocks}, int({first} + 1), greatest(0, int((({end}) - 1) div {_PIECE} - {first} + 1))), '')"
    return f"CASE WHEN ({end}) > ({start}) THEN substr({joined}, int(({start}) - {first} * {_PIECE} + 1), ({end}) - ({start})) ELSE '' END"


def _lines(text: str, starts: str) -> str:
    """For each offset of an array the number of its line, from 1."""
    short = f"transform({starts}, x -> size(split(substr({text}, 1, x), {_LINE_END}, -1)))"

    def placed(b: str) -> str:
        # A line end of two characters may lie across two blocks, where it counts once.
        across = lambda k: f"({k} > 0 AND startswith(get({b}, int({k})), '\n') AND endswith(get({b}, int({k}) - 1), '\r'))"
        counts = f"transform({b}, (x, k) -> size(split(x, {_LINE_END}, -1)) - 1 - int({across('k')}))"
        inside = lambda k: f"substr(get({b}, int({k})), 1, x - {k} * {_PIECE})"
        k = f"(x div {_PIECE})"
        own = f"size(split(coalesce({inside(k)}, ''), {_LINE_END}, -1)) - int(x > {k} * {_PIECE} AND coalesce({across(k)}, false))"
        return _let(_before(f"concat({counts}, array(0))", "a + x"), lambda n: f"transform({starts}, x -> int(get({n}, int({k})) + {own}))")

    return f"CASE WHEN size({starts}) <= {_FEW_CUTS} THEN {short} ELSE {_let(_blocks(text), placed)} END"


def report(findings: str, text: str, names: dict[str, str], hide: Sequence[str] = ()) -> Column:
    """Findings as they may be shown: rule, place and masked preview."""
    labels = "map(" + ", ".join(_lit(x) for pair in names.items() for x in pair) + ")"
    lines = _lines(text, f"transform({findings}, s -> s.start)")
    return F.expr(_let(lines, lambda n: (
        f"transform({findings}, (s, i) -> named_struct('rule_id', s.rule_id, 'rule_name', {labels}[s.rule_id], "
        f"'tier', s.tier, 'start', s.start, 'length', s.length, 'line', get({n}, i), "
        f"'preview', {masked_sql('s.rule_id', 's.value', hide)}, 'always_redact', s.tier = {CUSTOM}))")))


def _merged(spans: str) -> str:
    """Union of overlapping spans, in order; the surest rule names the union."""
    ordered = (
        f"array_sort(transform({spans}, s -> named_struct('start', s.start, 'end', s.start + s.length, "
        "'tier', s.tier, 'rule_id', s.rule_id)))")
    c = _fresh("c")
    joined = (
        f"aggregate({c}, get({c}, 0), (acc, s) -> named_struct('start', acc.start, 'end', greatest(acc.end, s.end), "
        "'tier', least(acc.tier, s.tier), 'rule_id', CASE WHEN s.tier < acc.tier THEN s.rule_id ELSE acc.rule_id END))")
    return f"transform({_clusters(ordered, 's.end')}, {c} -> {joined})"


def redacted(text: str, spans: str) -> Column:
    """Every span becomes ``[REDACTED:rule-id]``; overlapping spans become one label.

    ``text`` names a column, ``spans`` is SQL for an array of spans.
    """

    def rebuilt(u: str) -> str:
        before = f"(CASE WHEN i = 0 THEN 0 ELSE get({u}, i - 1).end END)"
        last = f"element_at({u}, -1).end"

        def pieces(cut: Callable[[str, str], str], end: str) -> str:
            piece = f"(v, i) -> concat({cut(before, 'v.start')}, '[REDACTED:', v.rule_id, ']')"
            return f"concat(array_join(transform({u}, {piece}), ''), {cut(last, end)})"

        few = pieces(lambda x, y: f"substr({text}, {x} + 1, {y} - {x})", f"length({text})")
        many = _let(_blocks(text), lambda b: pieces(lambda x, y: _part(b, x, y), f"length({text})"))
        return f"CASE WHEN size({u}) <= {_FEW_CUTS} THEN {few} ELSE {many} END"

    return F.expr(
        f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {_let(_merged(spans), rebuilt)} END")
