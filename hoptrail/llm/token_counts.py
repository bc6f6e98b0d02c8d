"""Exact token counts of every prefix of a text, by dynamic programming.

Within one pre-token, the last token of a prefix's encoding is the only token
that ends there, can stand alone, and stays apart when merged with the last
token of the prefix before it. So ``last[i]`` follows from earlier entries, and
``count[i] = count[i - len(last[i])] + 1``: one pass gives the token count of
every prefix without encoding any of them again. Texts are sums of pre-tokens.

``prefix_table`` keeps, per document, the prefixes at which the count changes (or
all of them): an entry holds up to the next one, and the last entry is the whole
text. So ``tokens_within`` and ``longest_prefix`` answer budget and truncation
questions for every prefix in SQL.

Defined cases: a null or empty text has the table [0], [0]; special strings in a
text are one token each, as the library's default has it; other columns pass
through and result columns replace columns of the same name.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoptrail.llm.scratch import bounded_batches

#: A worker's memory: stretches and pieces of at most so many characters, and so many of either; when full it keeps what was asked for again.
CACHE_CHARS, CACHE_ENTRIES, CACHE_PIECES, CACHE_CHANGES = 48, 600_000, 125_000, 8_000_000
#: Beginnings of pieces of so many bytes are counted once, and so many of them are remembered.
HEADS, CACHE_HEADS = (10, 7, 4), 150_000
#: Where the pieces of a prefix aren't prefixes of the whole text's pieces.
_UNEVEN = regex.compile(r"\s\s|'(?:s|t|re|ve|m|ll|d)")
_CONTRACTION = regex.compile("'(?:s|t|re|ve|m|ll|d)")


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a vocabulary file of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens of prefixes; made once per Python worker.

    The tokens that end at a byte come from an automaton over the vocabulary, whose
    state is the longest end of what was read that begins some token.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.tokens = [as_bytes(t) for t in spec["model"]["vocab"]]
        self.vocabulary = {t: i for i, t in enumerate(self.tokens)}
        # By the ids of a pair: its rank and what it becomes.
        pairs = [tuple(map(as_bytes, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self._merges = {self.vocabulary[a] << 20 | self.vocabulary[b]: rank << 20 | self.vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}
        self._pair_of = {rank: (self.vocabulary[a], self.vocabulary[b]) for rank, (a, b) in enumerate(pairs)}
        self._last_merge: dict[int, int | None] = {}
        self._byte = [self.vocabulary[bytes([x])] for x in range(256)]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.pieces = regex.compile(pattern)
        self._begins = {t[:i] for t in self.tokens for i in range(len(t) + 1)}
        self._states: dict[bytes, tuple] = {}
        self._root = self._state(b"")
        self._apart: dict[int, bool] = {}
        self._pieces: dict[str, tuple] = {}
        self._older_pieces: dict[str, tuple] = {}
        self._heads: dict[bytes, tuple] = {}
        self._forget()

    def _forget(self) -> None:
        """Empty the memory of stretches: numbers by text, with and without a blank before it, and what each number stands for."""
        self._after_blank: dict[str, int] = {}
        self._other: dict[str, int] = {}
        self._places, self._counts, self._ends, self._sizes, self._totals = array("i"), array("i"), array("q", [0]), array("q"), array("q")
        self._again = np.zeros(CACHE_ENTRIES + 1, np.bool_)  # by number: whether a later text asked for it

    def _tidy(self) -> None:
        """Keep the stretches that were asked for again; start anew if that frees too little."""
        n = min(len(self._sizes), len(self._again))
        keep = np.flatnonzero(self._again[:n])
        chosen = np.full(len(self._sizes), -1, np.int64)
        chosen[keep] = np.arange(len(keep))
        at, many = self._held(keep)
        held = [np.frombuffer(x, np.int32)[at].tobytes() if len(x) else b"" for x in (self._places, self._counts)]
        held += [np.concatenate(([0], np.cumsum(many))).astype(np.int64).tobytes(), *(np.frombuffer(x, np.int64)[keep].tobytes() for x in (self._sizes, self._totals))]
        known = [{w: m for w, m in zip(d, chosen[list(d.values())].tolist(), strict=True) if m >= 0} for d in (self._after_blank, self._other)]
        self._forget()
        if 2 * len(keep) > CACHE_ENTRIES or 2 * len(at) > CACHE_CHANGES:
            return
        self._after_blank, self._other = known
        self._ends = array("q")
        for kept, raw in zip((self._places, self._counts, self._ends, self._sizes, self._totals), held, strict=True):
            kept.frombytes(raw)

    def _held(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the changes of stretches lie, one after another, and how many each has."""
        ends = np.frombuffer(self._ends, np.int64)
        start, many = ends[numbers], ends[numbers + 1] - ends[numbers]
        after = np.cumsum(many)
        return np.arange(after[-1] if len(after) else 0) + np.repeat(start - after + many, many), many

    def merge(self, ids: list[int], before: int = -1) -> list[int]:
        """Byte-pair merges in order of rank, up to the one that leaves ``before`` alone."""
        get, none = self._merges.get, 1 << 60
        while len(ids) > 1:
            best = min([get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)])
            if best == none:
                break
            (first, second), whole = self._pair_of[best >> 20], best & 0xFFFFF
            if len(ids) == 2 and whole == before:
                break
            out, i = [], 0
            while i < len(ids):
                if ids[i] == first and i + 1 < len(ids) and ids[i + 1] == second:
                    out.append(whole)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _state(self, read: bytes) -> tuple[dict, bytes, tuple]:
        """Next states by byte, what was read, and the tokens that end there with their lengths, longest first."""
        found = self._states.get(read)
        if found is None:
            ends = tuple((self.vocabulary[read[k:]], len(read) - k) for k in range(len(read)) if read[k:] in self.vocabulary and self._made_by(self.vocabulary[read[k:]]) is not None)
            found = self._states[read] = ({}, read, ends)
        return found

    def _next(self, state: tuple, byte: int) -> tuple:
        read = state[1] + bytes([byte])
        while read not in self._begins:
            read = read[1:]
        found = state[0][byte] = self._state(read)
        return found

    def _made_by(self, token: int) -> int | None:
        """The rank of the merge that makes a token last when it stands alone: -1 of a byte, None if it doesn't come out whole."""
        if token not in self._last_merge:
            parts, rank = self.merge([self._byte[x] for x in self.tokens[token]], before=token), -1
            if len(parts) == 2:
                rank = self._merges[parts[0] << 20 | parts[1]] >> 20
            self._last_merge[token] = rank if len(parts) == 2 or parts == [token] else None
        return self._last_merge[token]

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token``, which can stand alone, stays apart from the token before it (-1: none).

        Both are taken apart, the later merge first. The parts at the border merge across it if
        their own merge comes before those that take them up: of equal ranks, the left one.
        """
        if len(self._apart) > CACHE_ENTRIES:
            self._apart.clear()
        none = 1 << 60
        a, b, limit, found = before, token, none >> 20, before < 0
        while not found:
            if self._merges.get(a << 20 | b, none) >> 20 < limit:
                break
            x, y = self._made_by(a), self._made_by(b)
            if x > y:
                a, limit = self._pair_of[x][1], x
            elif y >= 0:
                b, limit = self._pair_of[y][0], y + 1
            else:
                found = True
        self._apart[before << 20 | token] = found
        return found

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of a pre-token, from 0 bytes to all."""
        state, last, count, apart, n = self._root, [-1], [0], self._apart, len(piece)
        for size in HEADS:
            if n > size and (head := self._heads.get(piece[:size])):
                state, last, count = head[0], [*head[1]], [*head[2]]
                break
        for i, byte in enumerate(piece[len(last) - 1 :], len(last)):
            state = state[0].get(byte) or self._next(state, byte)
            for token, size in state[2]:
                before = last[i - size]
                fits = apart.get(before << 20 | token)
                if fits is None:
                    fits = self._fits(before, token)
                if fits:
                    last.append(token)
                    count.append(count[i - size] + 1)
                    break
            if i in HEADS and i < n <= CACHE_CHARS:
                if len(self._heads) >= CACHE_HEADS:
                    self._heads.clear()
                self._heads[piece[:i]] = state, tuple(last), tuple(count)
        return count

    def _by_char(self, piece: str) -> list[int]:
        """Tokens of each prefix of a pre-token, from 0 characters to all."""
        raw = piece.encode()
        counts = self.counts(raw)
        return counts if len(raw) == len(piece) else [counts[b] for b in accumulate((len(c.encode()) for c in piece), initial=0)]

    def _piece(self, piece: str) -> tuple[tuple[int, ...], tuple[int, ...], int, int]:
        """Where the count changes within a piece, the counts there, characters and tokens."""
        found = self._older_pieces.get(piece)
        if found is None:
            n = self._by_char(piece)
            at = tuple([i for i in range(1, len(n)) if n[i] != n[i - 1]])
            found = at, tuple([n[i] for i in at]), len(piece), n[-1]
        if len(piece) <= CACHE_CHARS:
            if len(self._pieces) >= CACHE_PIECES:
                self._pieces, self._older_pieces = {}, self._pieces
            self._pieces[piece] = found
        return found

    def _number(self, stretch: str) -> int:
        """A new number, under which the stretch's changes are held."""
        word = stretch[1:] if stretch.startswith(" ") else stretch
        if word.isalpha():  # one piece
            at, n, size, total = self._pieces.get(stretch) or self._piece(stretch)
            self._places.extend(at)
            self._counts.extend(n)
        elif _UNEVEN.search(stretch):
            n = [0, *self._every_ordinary(stretch)]
            at = [i for i in range(1, len(n)) if n[i] != n[i - 1]]
            self._places.extend(at)
            self._counts.extend([n[i] for i in at])
            size, total = len(stretch), n[-1]
        else:
            size = total = 0
            for piece in self.pieces.findall(stretch):
                at, n, chars, tokens = self._pieces.get(piece) or self._piece(piece)
                self._places.extend([size + x for x in at] if size else at)
                self._counts.extend([total + x for x in n] if total else n)
                size += chars
                total += tokens
        self._sizes.append(size)
        self._totals.append(total)
        self._ends.append(len(self._places))
        return len(self._sizes) - 1

    def _numbers(self, text: str) -> list[int]:
        """Numbers of the stretches of an ordinary text: a blank between two characters that aren't white space begins one, whatever follows."""
        first, *words = text.split(" ")
        known = self._after_blank
        if not first or not first[-1].isspace():
            out = list(map(known.get, words))
            for k in [k for k, n in enumerate(out) if n is None] if None in out else ():
                word = words[k]
                if not word or word[0].isspace() or word[-1].isspace():
                    break  # white space touches the blank
                if (n := known.get(word)) is None:
                    n = self._number(" " + word)
                    if len(word) <= CACHE_CHARS:
                        known[word] = n
                out[k] = n
            else:
                return [self._numbered(first), *out] if first else out
        out, open_ = [], first
        for word in words:
            if open_ and word and not open_[-1].isspace() and not word[0].isspace():
                out.append(self._numbered(open_))
                open_ = " " + word
            else:
                open_ += " " + word
        return [*out, self._numbered(open_)]

    def _numbered(self, stretch: str) -> int:
        n = self._other.get(stretch)
        if n is None:
            n = self._number(stretch)
            if len(stretch) <= CACHE_CHARS:
                self._other[stretch] = n
        return n

    def _ordinary(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of prefixes of a text without special strings at which the count changes, and the counts, without (0, 0)."""
        if len(self._sizes) > CACHE_ENTRIES or len(self._places) > CACHE_CHANGES:
            self._tidy()
        before = min(len(self._sizes), len(self._again))
        own = np.array(self._numbers(text), np.int64)
        self._again[own[own < before]] = True
        sizes, totals = (np.frombuffer(x, np.int64) for x in (self._sizes, self._totals))
        size, total = sizes[own], totals[own]
        at, many = self._held(own)
        places, counts = (np.frombuffer(x, np.int32)[at] if len(x) else np.zeros(0, np.int32) for x in (self._places, self._counts))
        return places + np.repeat(np.cumsum(size) - size, many), counts + np.repeat(np.cumsum(total) - total, many)

    def changes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Prefix lengths in characters at which the token count changes and the counts from there on, from (0, 0) to the whole text."""
        zero = np.zeros(1, np.int64)
        chars, tokens, at, base = [zero], [zero], 0, 0
        for m in (*(self.split_special.finditer(text) if self.special else ()), None):
            run = text[at : m.end() - 1 if m else len(text)]  # a special string that is cut off is ordinary text
            c, n = self._ordinary(run)
            chars.append(c + at)
            tokens.append(n + base)
            if m:
                before = int(np.searchsorted(c, m.start() - at, side="right"))
                base += (int(n[before - 1]) if before else 0) + 1
                at = m.end()
                chars.append(zero + at)
                tokens.append(zero + base)
        c, n = np.concatenate(chars), np.concatenate(tokens)
        return (c, n) if c[-1] == len(text) else (np.append(c, len(text)), np.append(n, n[-1]))

    def every(self, text: str) -> list[int]:
        """Token counts of all prefixes of a text, character by character."""
        c, n = self.changes(text)
        return np.repeat(n, np.diff(np.append(c, len(text) + 1))).tolist()

    def _every_ordinary(self, run: str) -> list[int]:
        """Counts after each character of an ordinary text, by what pre-tokenisation makes of each prefix."""
        out, before = [], 0  # before: tokens of the whole pre-tokens so far
        blank_counts: list[int] = []
        blank_from = blank_base = 0
        for m in self.pieces.finditer(run):
            piece, a = m.group(), m.start()
            contraction = _CONTRACTION.fullmatch(piece)
            counts = self._by_char(piece)
            for k, c in enumerate(piece):
                i = a + k  # the character added
                if c.isspace() and regex.match(r"\s", c):
                    if i == 0 or not regex.match(r"\s", run[i - 1]):
                        end = regex.compile(r"\s+").match(run, i).end()
                        blank_from, blank_counts = i, self._by_char(run[i:end])
                        blank_base = out[-1] if out else 0
                    out.append(blank_base + blank_counts[i - blank_from + 1])
                elif contraction and k + 1 < len(piece):
                    out.append(before + sum(self._by_char(x)[-1] for x in self.pieces.findall(piece[: k + 1])))
                else:
                    out.append(before + counts[k + 1])
            before += counts[-1]
        return out


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def prefix_table(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", every_character: bool = False) -> DataFrame:
    """``docs`` with ``prefix_chars`` and ``prefix_tokens``: exact token counts of prefixes from each of these lengths up to the next."""
    bounded_batches(docs.sparkSession)
    ints = T.ArrayType(T.IntegerType())
    own = [f for f in docs.schema.fields if f.name not in ("prefix_chars", "prefix_tokens")]
    names = [f.name for f in own]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path, pattern)
        for batch in batches:
            chars, tokens = [], []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                if every_character:
                    n = count.every(text or "")
                    c = range(len(n))
                else:
                    c, n = count.changes(text or "")
                chars.append(np.asarray(c, np.int32))
                tokens.append(np.asarray(n, np.int32))
            ends = np.cumsum([0, *map(len, chars)], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (chars, tokens)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *lists], names=[*names, "prefix_chars", "prefix_tokens"])

    return docs.mapInArrow(run, T.StructType([*own, T.StructField("prefix_chars", ints), T.StructField("prefix_tokens", ints)]))


def total_tokens() -> Column:
    """Tokens of the whole text."""
    return F.element_at("prefix_tokens", -1).cast("long")


def longest_prefix(budget: int) -> Column:
    """Characters of the longest prefix that takes at most ``budget`` tokens."""
    ends = F.transform("prefix_chars", lambda c, i: F.coalesce(F.get("prefix_chars", i + 1) - 1, c))  # each count holds up to the next
    return F.array_max(F.zip_with(ends, "prefix_tokens", lambda end, n: F.when(n <= budget, end)))


def tokens_within(chars: int) -> Column:
    """Tokens of the prefix of ``chars`` characters, or of the whole text if that is shorter."""
    return F.element_at("prefix_tokens", F.size(F.filter("prefix_chars", lambda c: c <= chars)))
