"""Byte-pair encoding as a streaming transducer with bounded lookahead, and streaming decoding.

The vocabulary file (merges with word ends, lower case, white space dropped) is a
parameter; it is read on the driver and broadcast, being of a fixed, small size.

* **Sufficient lookahead.**  Whether a merge crosses a boundary depends on the text to
  its right only through the right-hand symbol: it must be complete, and neither it nor
  a symbol on its right spine may have been taken by an earlier merge with what follows,
  for which that in turn must be complete, and so on with ever smaller ranks.  The
  longest such chain, found by one pass over the merges in rank order, bounds the symbols
  that a decision needs (``Vocabulary.lookahead``).
* **Streaming.**  A word is read into a window of fixed size.  Tokens that end at least
  that far before the window's end are stable and leave it; what is left is encoded anew
  with what follows.  Every word passes through this transducer; answers of words of up to
  ``BLOCK`` characters are remembered.
* **Words.**  A long text is normalised and cut into words a slice at a time.  Slices end
  where no character composes with what follows; a word that a slice's end cuts stays open
  in its transducer.  Beyond the text itself and its ids, memory is constant, with or
  without white space.
* **Decoding** is a state machine fed with ids in pieces.  ``TokenText`` gives the tokens
  with a space between them, as a file without a decoder asks for; ``ByteText`` maps
  tokens back to bytes and these to text, holding back an unfinished character.

Null texts are empty texts: no tokens.  Equal texts get equal ids.  Strings of special
tokens inside a text become their ids, as the file says.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession, functions as F

# The file's word end, and the pattern of its words (white space is gone before).
WORD_END = "</w>"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"
# Unicode white space, without U+001C to U+001F.
WHITE = "[" + "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                                0x3000))) + "]+"
#: Characters of the longest ending among the words.
LONGEST_ENDING = 3
#: Symbols of a window beyond the lookahead.
BLOCK = 256
#: Entries of a worker's memory of words; it is emptied when full.
MEMORY = 300_000
#: Characters of a text, and ids, that are handled at once.
SLICE = 1 << 18


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """The symbols to the right of a boundary that decide whether a merge crosses it.

    ``merges``: (left, right, result) in rank order.
    """
    made: defaultdict[int, list[int]] = defaultdict(list)
    ranks: defaultdict[int, list[int]] = defaultdict(list)
    reach: defaultdict[int, list[int]] = defaultdict(list)
    most = 0
    for rank, (left, right, result) in enumerate(merges):
        further, todo = 0, [(right, rank)]
        while todo:
            x, deadline = todo.pop()
            if k := bisect_left(ranks[x], deadline):
                further = max(further, reach[x][k - 1])
            todo.extend((merges[m][1], m) for m in made[x] if m < deadline)
        need = length[right] + further
        ranks[left].append(rank)
        reach[left].append(max(need, reach[left][-1] if reach[left] else 0))
        made[result].append(rank)
        most = max(most, need)
    return most


class Vocabulary:
    """What a vocabulary file says, as tables."""

    _last: tuple[str, Vocabulary] | None = None

    def __init__(self, content: bytes):
        spec = json.loads(content)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids |= self.special
        self.tokens: dict[int, str] = {v: k for k, v in self.ids.items()}
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.final = [self.ids[c + WORD_END] for c in letters]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        listed = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        # A pair's key and its answer, rank and result, are one number each.
        self.merges = {a << 32 | b: rank << 32 | c for rank, (a, b, c) in reversed(list(enumerate(listed)))}
        self.length = dict.fromkeys([*self.inner, *self.final], 1)
        for a, b, c in listed:
            self.length[c] = self.length[a] + self.length[b]
        self.lookahead = sufficient_lookahead(listed, self.length)
        self.window = self.lookahead + max(BLOCK, *self.length.values())
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        back = {c: b for b, c in enumerate(letters)}
        self.bytes = {i: (t.encode() if t in self.special else bytes(back[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END))
                      for t, i in self.ids.items()}
        self.words, self.white = regex.compile(WORDS), re.compile(WHITE)
        # Words that the next slice may continue, by whether they begin with a letter.
        self.letters, self.others = regex.compile(r"\p{L}+"), regex.compile(r"[^\p{L}\p{N}]+")
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    @classmethod
    def of(cls, content: bytes) -> Vocabulary:
        """The vocabulary of a file, kept in this process until another one is asked for."""
        key = hashlib.sha256(content).hexdigest()
        if cls._last is None or cls._last[0] != key:
            cls._last = (key, cls(content))
        return cls._last[1]

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge by rank, then from the left."""
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        if n <= 40:
            out = list(symbols)
            best = [merges.get(a << 32 | b, _NEVER) for a, b in zip(out, out[1:])]
            while best and (m := min(best)) != _NEVER:
                at = best.index(m)
                out[at] = to = m & _LOW
                del out[at + 1], best[at]
                if at < len(best):
                    best[at] = merges.get(to << 32 | out[at + 1], _NEVER)
                if at:
                    best[at - 1] = merges.get(out[at - 1] << 32 | to, _NEVER)
            return out
        own: list[int | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m >> 32, k, m & _LOW, own[k], own[k + 1]) for k in range(n - 1) if (m := merges.get(own[k] << 32 | own[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, to, a, b = heapq.heappop(heap)
            j = after[k] if own[k] == a else n
            if j >= n or own[j] != b:
                continue
            own[k], own[j] = to, None
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
                if (m := merges.get(to << 32 | own[after[j]])) is not None:
                    heapq.heappush(heap, (m >> 32, k, m & _LOW, to, own[after[j]]))
            if (i := before[k]) >= 0 and (m := merges.get(own[i] << 32 | to)) is not None:
                heapq.heappush(heap, (m >> 32, i, m & _LOW, own[i], to))
        return [x for x in own if x is not None]

    def transduce(self, word: bytes) -> Iterator[list[int]]:
        """Encode one word of any length, in runs of stable tokens."""
        open_word = Transducer(self)
        yield from open_word.feed(word)
        yield open_word.finish()

    def _normal(self, text: str) -> str:
        # Character by character: the lower-case sigma does not depend on its place.
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _parts(self, run: str) -> Iterator[str]:
        """A run cut at strings of special tokens, which are parts of their own."""
        at = 0
        if self.cut and any(x in run for x in self.special):
            for m in self.cut.finditer(run):
                yield run[at:m.start()]
                yield m.group()
                at = m.end()
        yield run[at:]

    def _run(self, run: str) -> Iterator[list[int]]:
        """A run without white space."""
        for part in self._parts(run):
            if part in self.special:
                yield [self.special[part]]
            elif len(part) > SLICE:
                yield from self._long(part)
            else:
                for word in self.words.findall(self._normal(part)):
                    if len(word) > BLOCK:
                        yield from self.transduce(word.encode())
                    else:
                        yield self._word(word)

    def _long(self, part: str) -> Iterator[list[int]]:
        """The words of a part of any length, a slice at a time; the last word of a slice stays open."""
        at, rest, going, word = 0, "", None, None
        while at < len(part):
            to = _composed_end(part, at + SLICE)
            piece, at = rest + self._normal(part[at:to]), to
            start, last = 0, at == len(part)
            if word is not None:
                m = going.match(piece)
                start = m.end() if m else 0
                yield from word.feed(piece[:start].encode())
                if start == len(piece) and not last:
                    rest = ""
                    continue
                yield word.finish()
                word = None
            rest = ""
            for m in self.words.finditer(piece, start):
                if last or m.end() < len(piece) and m.start() + LONGEST_ENDING <= len(piece):
                    yield from [self._word(m.group())] if m.end() - m.start() <= BLOCK else self.transduce(m.group().encode())
                elif m.start() + LONGEST_ENDING > len(piece) or not (going := self._going(m.group())):
                    # What follows may make it another word; it waits for the next slice.
                    rest = piece[m.start():]
                    break
                else:
                    word = Transducer(self)
                    yield from word.feed(m.group().encode())
        if word is not None:
            yield word.finish()

    def _going(self, word: str):
        """The pattern that goes on with a word at the end of a slice; None if it has a fixed length."""
        return next((x for x in (self.letters, self.others) if x.fullmatch(word)), None)

    def _word(self, word: str) -> list[int]:
        ids = self.pieces.get(word)
        if ids is None:
            if len(self.pieces) >= MEMORY:
                self.pieces.clear()
            ids = self.pieces[word] = [x for stable in self.transduce(word.encode()) for x in stable]
        return ids

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a piece of the text at a time."""
        at, n, known = 0, len(text), self.known
        while at < n:
            to = min(n, at + SLICE)
            if to < n:
                to = m.end() if (m := self.white.search(text, to)) else n
            part, at = text[at:to], to
            runs = part.split() if not any(c in part for c in "\x1c\x1d\x1e\x1f") else [x for x in self.white.split(part) if x]
            out = []
            for run in runs:
                ids = known.get(run)
                if ids is None:
                    if len(run) > SLICE:
                        yield b"".join(out)
                        out = []
                        yield from map(_packed, self._run(run))
                        continue
                    if len(run) > BLOCK:
                        out.extend(_packed(x) for x in self._run(run))
                        continue
                    if len(known) >= MEMORY:
                        known.clear()
                    ids = known[run] = _packed(self._word(run.lower()) if run.isascii() and run.isalpha() else [x for y in self._run(run) for x in y])
                out.append(ids)
            yield b"".join(out)


_NEVER, _LOW = 1 << 62, (1 << 32) - 1


class Transducer:
    """One word, fed in pieces of bytes; gives runs of stable tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held, self.final = vocabulary, [], -1

    def feed(self, piece: bytes) -> Iterator[list[int]]:
        v, held, at, n = self.vocabulary, self.held, 0, len(piece)
        if n:
            self.final = v.final[piece[-1]]
        while at < n:
            if len(held) >= v.window:
                # Something follows, so the window's symbols are all inner ones.
                stable, out = 0, []
                for token in v.merge(held):
                    if stable + v.length[token] > len(held) - v.lookahead:
                        break
                    stable += v.length[token]
                    out.append(token)
                yield out
                del held[:stable]
            to = min(n, at + v.window - len(held))
            held += map(v.inner.__getitem__, piece[at:to])
            at = to

    def finish(self) -> list[int]:
        """The tokens of what is left; the last byte ends the word."""
        if not self.held:
            return []
        self.held[-1] = self.final
        return self.vocabulary.merge(self.held)


@cache
def _composing() -> frozenset[str]:
    """Characters that may compose with the one before: ends of canonical decompositions, and Hangul vowels and finals."""
    ends = (unicodedata.decomposition(chr(c)).split() for c in range(0xC0, 0x30000))
    return frozenset([chr(int(x[-1], 16)) for x in ends if len(x) == 2 and not x[0].startswith("<")]
                     + [chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))])


def _composed_end(text: str, at: int) -> int:
    """The first place from ``at`` on where normalising both sides apart changes nothing."""
    while at < len(text) and not ((c := text[at]).isascii() or not unicodedata.combining(c)
                                  and unicodedata.normalize("NFC", c) == c and c not in _composing()):
        at += 1
    return min(at, len(text))


def _packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


class TokenText:
    """Tokens with a space between them, fed in pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.table, self.begun = vocabulary.tokens, False

    def feed(self, ids: Iterable[int]) -> str:
        out = " ".join(map(self.table.__getitem__, ids))
        if out and self.begun:
            out = " " + out
        self.begun |= bool(out)
        return out

    def finish(self) -> str:
        return ""


class ByteText:
    """Tokens back to bytes and bytes to text; a word end is a space.

    An unfinished character waits for its other bytes; what is no UTF-8 becomes U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.table, self.text = vocabulary.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.text.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.text.decode(b"", True)


def load(spark: SparkSession, path: str):
    """Read a vocabulary file on the driver and broadcast it; such files have a few MB."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(text: Column, file) -> Column:
    """The ids of a text, array<int>.  ``file``: from :func:`load`."""

    def ids(column: pa.Array) -> pa.Array:
        vocabulary = Vocabulary.of(file.value)
        found = [b"".join(vocabulary.encode(x or "")) for x in column.to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))

    return F.arrow_udf(ids, "array<int>").asNondeterministic()(text)


def decode(ids: Column, file, as_bytes: bool = False) -> Column:
    """The text of ids: tokens with spaces between, or (``as_bytes``) the bytes' text.  Null: empty."""

    def back(column: pa.Array) -> pa.Array:
        vocabulary, out = Vocabulary.of(file.value), []
        for row in column.to_pylist():
            state = (ByteText if as_bytes else TokenText)(vocabulary)
            out.append(state.feed(row or []) + state.finish())
        return pa.array(out, pa.string())

    return F.arrow_udf(back, "string").asNondeterministic()(ids)


def digests(text: Column, file, with_ids: bool = False) -> Column:
    """``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of a text, encoded and decoded piece by piece; with ``ids`` if asked for."""
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(column: pa.Array) -> pa.Array:
        vocabulary, rows, found, ends = Vocabulary.of(file.value), [], [], [0]
        for value in column:
            n, of_ids, of_text, state = 0, hashlib.sha256(), hashlib.sha256(), TokenText(vocabulary)
            for part in vocabulary.encode(value.as_py() or ""):
                of_ids.update(part)
                n += len(part) // 4
                for k in range(0, len(part), 4 * SLICE):
                    ids = array("I")
                    ids.frombytes(part[k:k + 4 * SLICE])
                    of_text.update(state.feed(ids).encode())
                if with_ids:
                    found.append(part)
            of_text.update(state.finish().encode())
            rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
            ends.append(ends[-1] + n)
        cells = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())]
        if with_ids:
            cells.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"))))
        return pa.StructArray.from_arrays(cells, [*kinds, *(["ids"] if with_ids else [])])

    schema = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string" + (", ids: array<int>" if with_ids else "") + ">"
    return F.arrow_udf(run, schema).asNondeterministic()(text)
