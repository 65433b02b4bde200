"""Tokenizers compiled to finite-state transducers that run over numpy arrays.

A text passes two machines. The splitter is a deterministic transducer over character symbols; its transitions are
annotated with the piece starts they emit, at most one symbol late. A slice of text is cut into chunks; each chunk is
run from every state at once, which gives its state map; the maps compose through a parallel prefix scan; then each
chunk runs once more from its now known state and emits.

The token machine reads a piece byte by byte; each transition is annotated with the change in the number of tokens,
and the last state names the last token. It rests on two facts about merges by rank: of every prefix of a piece the
encoding has one last token, and a row of tokens is the encoding if each two neighbours stay apart when merged alone.
A state is the longest suffix read that some token may still continue, with the last token and the relative count at
each of its places; from it the next last token follows, so equal states have equal futures. States and transitions
are compiled when a text first needs them and kept by the worker; a count is the sum of a piece's annotations, taken
for all distinct pieces of a slice together, byte by byte, and for a few long pieces one after the other.

Character symbols are probed from the library's own splitter, so they follow its Unicode tables. Texts that hold a
special token's string, that aren't in normal form where the tokenizer normalises, or whose lower case changes length
go through the library whole; results are the library's in every case.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

from .shared import distinct, first_equal

SPACE, BLANK, QUOTE, STMD, R, V, L, E, LETTER, NUMBER, OTHER, END = range(12)
SYMBOLS = 12
(START, IN_LETTERS, IN_NUMBERS, IN_OTHER, SPACE_1, BLANK_1, SPACE_N, BLANK_N, AFTER_QUOTE, QUOTE_E, QUOTE_L) = range(11)
STATES = 11
HERE, BEFORE = 1, 2
CHUNK = 64
#: Pieces from which a step is one of arrays; new transitions that are kept apart from the sorted ones; states after
#: which a worker forgets what it compiled and begins again, so that its memory is bounded.
LANES, FRESH, STATES_KEPT = 24, 30_000, 200_000


def _begin(symbol: int) -> int:
    """The state after the first symbol of a piece."""
    return {SPACE: SPACE_1, BLANK: BLANK_1, QUOTE: AFTER_QUOTE, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}.get(symbol, IN_LETTERS)


def _step(state: int, symbol: int, keeps_space: bool) -> tuple[int, int]:
    """Next state and emission of one transition. keeps_space: blanks are pieces and a space leads the next piece."""
    letter = STMD <= symbol <= LETTER
    if symbol == END:
        return START, BEFORE if state in (QUOTE_E, QUOTE_L) else 0
    if state == AFTER_QUOTE:
        if symbol == STMD:
            return START, 0
        if symbol in (R, V, L):
            return (QUOTE_L if symbol == L else QUOTE_E), 0
        state = IN_OTHER
    if state in (QUOTE_E, QUOTE_L):
        if symbol == (E if state == QUOTE_E else L):
            return START, 0
        after, emitted = _step(IN_LETTERS, symbol, keeps_space)
        return after, emitted | BEFORE
    blank = symbol in (SPACE, BLANK)
    if not keeps_space:
        if blank:
            return (SPACE_1, HERE) if state != SPACE_1 else (SPACE_1, 0)
        if state == IN_LETTERS and letter or state == IN_OTHER and symbol in (QUOTE, OTHER):
            return state, 0
        return _begin(symbol), HERE
    if blank and state in (SPACE_1, BLANK_1, SPACE_N, BLANK_N):
        return (SPACE_N if symbol == SPACE else BLANK_N), 0
    if state in (SPACE_1, SPACE_N) and not blank:
        return (IN_OTHER if symbol == QUOTE else _begin(symbol)), (BEFORE if state == SPACE_N else 0)
    if state == BLANK_N and not blank:
        return _begin(symbol), HERE | BEFORE
    if state == IN_LETTERS and letter or state == IN_NUMBERS and symbol == NUMBER or state == IN_OTHER and symbol in (QUOTE, OTHER):
        return state, 0
    return _begin(symbol), HERE


class TokenMachine:
    """The transducer from the symbols of a piece (bytes, or 256 + byte for the last one of a marked piece) to token counts."""

    def __init__(self, tokens: dict[str, int], splits: dict[int, tuple[int, int]], ranks: dict[int, int]):
        self.tokens, self.splits, self.ranks = tokens, splits, ranks
        self.pairs = {pair: ranks[made] for made, pair in splits.items()}
        self.open = {text[:k] for text in tokens for k in range(1, len(text))}
        self.length = np.zeros(max(tokens.values()) + 1, np.int64)
        for text, name in tokens.items():
            self.length[name] = len(text)
        self._forget()

    def _forget(self) -> None:
        """Back to the first state alone."""
        first = self._packed(True, "", [-1], [0])
        self.apart: dict[int, bool] = {}
        self.states, self.names = [first], {first: 0}
        self.last = np.full(1024, -1, np.int32)
        self.keys, self.to, self.change = (np.zeros(0, t) for t in (np.int64, np.int32, np.int16))
        self.fresh_keys, self.fresh_to, self.fresh_change = self.keys, self.to, self.change
        self.missing: list[tuple[int, int, int]] = []

    @staticmethod
    def _packed(whole: bool, suffix: str, tokens: list[int], counts: list[int]) -> bytes:
        """A state: whether the suffix is the whole prefix, the suffix, and the last token and relative count at each of its places."""
        return bytes([whole]) + suffix.encode("utf-16-le") + array("i", tokens + counts).tobytes()

    @staticmethod
    def _unpacked(state: bytes) -> tuple[bool, str, list[int], list[int]]:
        depth = (len(state) - 9) // 10
        rows = array("i")
        rows.frombytes(state[1 + 2 * depth :])
        return bool(state[0]), state[1 : 1 + 2 * depth].decode("utf-16-le"), rows[: depth + 1].tolist(), rows[depth + 1 :].tolist()

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their joined text.

        Their merges are undone, latest first; a merge across the border that would have come before the next merge on
        either side (on the left one, being further left, also at the same rank) would have been taken.
        """
        found = self.apart.get(a << 20 | b)
        if found is None:
            left, right, far = a, b, 1 << 40
            until_left = until_right = far
            found = True
            while True:
                across = self.pairs.get((left, right), far)
                if across < until_left and across <= until_right:
                    found = False
                    break
                rank_left, rank_right = self.ranks.get(left, -1), self.ranks.get(right, -1)
                if rank_left < 0 and rank_right < 0:
                    break
                if rank_left > rank_right:
                    left, until_left = self.splits[left][1], rank_left
                else:
                    right, until_right = self.splits[right][0], rank_right
            self.apart[a << 20 | b] = found
        return found

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition of a state at a symbol: the next state and the change in the number of tokens."""
        whole, suffix, tokens, counts = self._unpacked(self.states[state])
        text, depth = suffix + chr(symbol), len(suffix)
        for n in range(1, depth + 2):
            token = self.tokens.get(text[-n:])
            if token is not None and (tokens[depth + 1 - n] < 0 or self.stay_apart(tokens[depth + 1 - n], token)):
                break
        else:
            raise AssertionError("a prefix without a last token")
        change = counts[depth + 1 - n] + 1
        keep = next((k for k in range(depth + 1, 0, -1) if text[-k:] in self.open), 0)
        new = self._packed(whole and keep == depth + 1, text[len(text) - keep :], [*tokens, token][-(keep + 1) :], [c - change for c in [*counts, change][-(keep + 1) :]])
        name = self.names.get(new)
        if name is None:
            name = self.names[new] = len(self.states)
            self.states.append(new)
            if name >= len(self.last):
                self.last = np.concatenate((self.last, np.full(len(self.last), -1, np.int32)))
            self.last[name] = token
        self.missing.append((state << 9 | symbol, name, change))
        return name, change

    def _keep(self) -> None:
        """Puts newly compiled transitions among the sorted ones."""
        rows, self.missing = self.missing, []
        if not rows:
            return
        keys, to, change = (np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int64, np.int32, np.int16), strict=True))
        fresh = np.concatenate((self.fresh_keys, keys)), np.concatenate((self.fresh_to, to)), np.concatenate((self.fresh_change, change))
        if len(fresh[0]) > FRESH:
            every = np.concatenate((self.keys, fresh[0])), np.concatenate((self.to, fresh[1])), np.concatenate((self.change, fresh[2]))
            order = np.argsort(every[0], kind="stable")
            self.keys, self.to, self.change = (x[order] for x in every)
            fresh = tuple(x[:0] for x in fresh)
        order = np.argsort(fresh[0], kind="stable")
        self.fresh_keys, self.fresh_to, self.fresh_change = (x[order] for x in fresh)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of many (state, symbol) keys."""
        to, change = np.full(len(keys), -1, np.int32), np.zeros(len(keys), np.int32)
        for known, states, changes in ((self.keys, self.to, self.change), (self.fresh_keys, self.fresh_to, self.fresh_change)):
            todo = np.flatnonzero(to < 0)
            if len(known) and len(todo):
                at = np.minimum(np.searchsorted(known, keys[todo]), len(known) - 1)
                hit = known[at] == keys[todo]
                to[todo[hit]], change[todo[hit]] = states[at[hit]], changes[at[hit]]
        todo = np.flatnonzero(to < 0)
        if len(todo):
            new, back = np.unique(keys[todo], return_inverse=True)
            moves = [self._compile(k >> 9, k & 511) for k in new.tolist()]
            to[todo] = np.array([m[0] for m in moves], np.int32)[back]
            change[todo] = np.array([m[1] for m in moves], np.int32)[back]
            self._keep()
        return to, change

    def run(self, symbols: np.ndarray, edges: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The tokens of each piece symbols[edges[k]:edges[k + 1]], and, if wanted, all ids in order."""
        if len(self.states) > STATES_KEPT:
            self._forget()
        size = np.diff(edges)
        order = np.argsort(-size, kind="stable")
        start, length = edges[:-1][order], size[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        ending = np.full(len(symbols), -1, np.int64) if want_ids else None
        most = int(length[0]) if len(length) else 0
        # lanes that are still inside their piece come first
        lanes = np.searchsorted(-length, -np.arange(most), "left")
        k = 0
        while k < most and lanes[k] >= LANES:
            n = lanes[k]
            to, change = self._find(state[:n] << 9 | symbols[start[:n] + k])
            state[:n] = to
            count[:n] += change
            if want_ids:
                ending[start[:n] + k] = self.last[to]
            k += 1
        if k < most:
            moves: dict[int, tuple[int, int]] = {}
            for lane in range(lanes[k]):
                now, total, ends = int(state[lane]), int(count[lane]), []
                for symbol in symbols[start[lane] + k : start[lane] + length[lane]].tolist():
                    key = now << 9 | symbol
                    move = moves.get(key)
                    if move is None:
                        to, change = self._find(np.array([key]))
                        move = moves[key] = int(to[0]), int(change[0])
                    now, total = move[0], total + move[1]
                    ends.append(now)
                count[lane] = total
                if want_ids:
                    ending[start[lane] + k : start[lane] + length[lane]] = self.last[np.array(ends, np.int64)]
        counts = np.empty(len(order), np.int64)
        counts[order] = count
        if not want_ids:
            return counts, None
        # a piece's tokens, from its end to its start, by the lengths of last tokens
        to_fill = np.cumsum(counts) - 1
        ids, at, live = np.empty(counts.sum(), np.int64), edges[1:] - 1, np.arange(len(counts))
        while len(live):
            token = ending[at[live]]
            ids[to_fill[live]] = token
            to_fill[live] -= 1
            at[live] -= self.length[token]
            live = live[at[live] >= edges[live]]
        return counts, ids


class Transducer:
    """A compiled tokenizer file of the library's JSON form, byte-level pieces, with or without an end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.folds = spec["normalizer"] is not None
        suffix = spec["model"]["end_of_word_suffix"] or ""
        table = [[_step(s, c, not self.folds) for c in range(SYMBOLS)] for s in range(STATES)]
        self.after = np.array([[x[0] for x in row] for row in table], np.int16).ravel() * SYMBOLS
        self.emit = np.array([[x[1] for x in row] for row in table], np.uint8).ravel()
        vocabulary = spec["model"]["vocab"]
        plain = [b for b in (*range(33, 127), *range(161, 173), *range(174, 256))]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # a symbol is a byte, or 256 + byte where it ends a piece that is marked
        self.marked = bool(suffix)
        symbol_of = {c: chr(b) for b, c in shown.items()}

        def text(token: str) -> str:
            if suffix and token.endswith(suffix):
                plain_part = token[: -len(suffix)]
                return "".join(symbol_of[c] for c in plain_part[:-1]) + chr(256 + ord(symbol_of[plain_part[-1]]))
            return "".join(symbol_of[c] for c in token)

        bases = [*shown.values(), *((c + suffix for c in shown.values()) if suffix else ())]
        splits = {vocabulary[a + b]: (vocabulary[a], vocabulary[b]) for a, b in merges}
        if len(splits) < len(merges):
            raise ValueError("two merges make the same token")
        ranks = {vocabulary[a + b]: k for k, (a, b) in enumerate(merges)}
        self.tokens = TokenMachine({text(t): vocabulary[t] for t in (*bases, *(a + b for a, b in merges))}, splits, ranks)
        self.symbol = np.full(0x110000, -1, np.int8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.odd = np.zeros(0x110000, bool)

    def _learn(self, points: np.ndarray) -> None:
        """Symbols of characters not met before, as the library's splitter treats them."""
        split = self._probe().pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            if len(split("a" + c)) == 1:
                kind = {"s": STMD, "t": STMD, "m": STMD, "d": STMD, "r": R, "v": V, "l": L, "e": E}.get(c.lower() if self.folds and p < 128 else c, LETTER)
            elif len(split("1" + c)) == 1:
                kind = NUMBER
            elif len(split("!" + c)) == 1:
                kind = QUOTE if c == "'" else OTHER
            else:
                kind = SPACE if c == " " else BLANK
            self.symbol[p] = kind
            if self.folds:
                low = c.lower() if c != "Σ" else "σ"
                self.lower[p], self.odd[p] = ord(low[0]), len(low) > 1

    @staticmethod
    @lru_cache(1)
    def _probe():
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=True)

    def _emissions(self, symbols: np.ndarray) -> np.ndarray:
        """The annotation of each transition, by state maps of chunks and their prefix scan."""
        n = len(symbols)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, END, np.int16)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        maps = np.empty((STATES, chunks), np.int16)
        for s in range(STATES):
            at = np.full(chunks, s * SYMBOLS, np.int16)
            for k in range(CHUNK):
                at = self.after[at + grid[k]]
            maps[s] = at // SYMBOLS
        step = 1
        while step < chunks:
            later = np.take_along_axis(maps[:, step:], maps[:, :-step], 0)
            maps = np.concatenate((maps[:, :step], later), 1)
            step *= 2
        at = np.zeros(chunks, np.int16)
        at[1:] = maps[START, :-1] * SYMBOLS
        out = np.empty((CHUNK, chunks), np.uint8)
        for k in range(CHUNK):
            move = at + grid[k]
            out[k] = self.emit[move]
            at = self.after[move]
        return out.T.ravel()[:n]

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Token counts, and ids (flat), of pieces."""
        lengths = ends - starts
        edges = np.concatenate(([0], np.cumsum(lengths)))
        symbols = data[np.arange(edges[-1]) - np.repeat(edges[:-1], lengths) + np.repeat(starts, lengths)].astype(np.int64)
        if self.marked:
            symbols[edges[1:] - 1] += 256
        return self.tokens.run(symbols, edges, want_ids)

    def _hard(self, text: str) -> bool:
        return any(x in text for x in self.special) or self.folds and not unicodedata.is_normalized("NFC", text)

    def run(self, data: np.ndarray, at: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of tokens of each text data[at[k]:at[k + 1]], and, if wanted, all their ids in order."""
        docs = len(at) - 1
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        char_at = lead[at]
        unknown = distinct(points[self.symbol[points] < 0])
        if len(unknown):
            self._learn(unknown)
        suspect = np.zeros(len(points), bool)
        if self.folds:
            suspect = self.odd[points] | (points >= 0x300)
        suspect[:-1] |= (points[:-1] == 60) & (points[1:] == 124)
        suspected = distinct(np.searchsorted(char_at, np.flatnonzero(suspect), "right") - 1)
        hard = [k for k in suspected.tolist() if self._hard(text[char_at[k] : char_at[k + 1]]) or self.folds and self.odd[points[char_at[k] : char_at[k + 1]]].any()]
        doc = np.repeat(np.arange(docs), np.diff(char_at))
        symbols = np.full(len(points) + docs, END, np.int16)
        place = np.arange(len(points)) + doc
        symbols[place] = self.symbol[points]
        if self.folds:
            text = self.lower[points].tobytes().decode("utf-32-le")
            data = np.frombuffer(text.encode(), np.uint8)
        emitted = self._emissions(symbols)
        starting = (emitted & HERE) > 0
        starting[:-1] |= (emitted[1:] & BEFORE) > 0
        starting = starting[place]
        some = char_at[:-1][np.diff(char_at) > 0]
        starting[some] = True
        begin = np.flatnonzero(starting)
        byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        stop = np.append(begin[1:], len(points))
        of = doc[begin]
        if self.folds:
            kept = ~np.isin(self.symbol[points[begin]], (SPACE, BLANK))
            begin, stop, of = begin[kept], stop[kept], of[kept]
        if hard:
            kept = ~np.isin(of, hard)
            begin, stop, of = begin[kept], stop[kept], of[kept]
        starts, ends = byte[begin], byte[stop]
        one, back = np.unique(first_equal(data, starts, ends), return_inverse=True)
        n, flat = self._pieces(data, starts[one], ends[one], want_ids)
        each = n[back]
        counts = np.bincount(of, each, docs).astype(np.int64)
        others = {}
        for k in hard:
            raw = points[char_at[k] : char_at[k + 1]].tobytes().decode("utf-32-le")
            others[k] = self.library.encode(raw, add_special_tokens=False).ids
            counts[k] = len(others[k])
        if not want_ids:
            return counts, None
        edges = np.concatenate(([0], np.cumsum(n)))[:-1]
        here = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.arange(here[-1]) - np.repeat(here[:-1], each) + np.repeat(edges[back], each)]
        if others:
            total = np.concatenate(([0], np.cumsum(counts)))
            full = np.empty(total[-1], np.int64)
            easy = np.ones(docs, bool)
            easy[hard] = False
            full[np.repeat(easy, counts)] = ids
            for k, x in others.items():
                full[total[k] : total[k + 1]] = x
            ids = full
        return counts, ids


@lru_cache(4)
def compiled(path: str) -> Transducer:
    """One compilation for each worker process and file."""
    return Transducer(path)
