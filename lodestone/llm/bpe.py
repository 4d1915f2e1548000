"""Byte-pair encoding of whole texts, word by word.

``Splitter`` finds the words of a batch of texts with array operations over
their code points. Each distinct word of a batch is encoded once and kept in a
bounded table, so a text's ids are gathered from its words' ids.

``PrefixTrie`` encodes distinct words by depth-first traversal of their trie.
Its state at a node is the last token of the prefix's encoding: the only token
that ends there and may follow the state at the place where it begins. Prefixes
that words share are worked out once, and a word's ids are read off by walking
back from its end.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from . import kernels as K

U64 = np.uint64
CHUNK_CHARS = 1 << 19
OTHER, LETTER, NUMBER, BLANK, BORDER, ODD = range(6)
TOP = 0x20000 + 0xA6E0
# Blocks whose classes are tabled; ideographs and syllables are letters throughout.
TABLED = [(0, 0x2E80), (0x3000, 0x3400), (0xA000, 0xABF0), (0xE000, 0xE010), (0xF900, 0x10300), (0x1F300, 0x1FA70)]
ALL_LETTERS = [(0x3400, 0x4DB6), (0x4E00, 0x9FF0), (0xAC00, 0xD7A4), (0x20000, TOP)]
# White space of the patterns, beside the ASCII kind.
BLANKS = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def default_vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; callers may name any other file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case, and whether composition may change it, of the code points below TOP. ODD: texts with it go to the library as a whole."""
    kind, lower, compose = np.full(TOP + 1, ODD, np.uint8), np.arange(TOP + 1, dtype=np.uint32), np.zeros(TOP + 1, bool)
    for a, b in TABLED:
        for c in range(a, b):
            x, category = chr(c), unicodedata.category(chr(c))
            low = x.lower()
            # The order of later marks differs between editions of Unicode.
            if category == "Cn" or len(low) > 1 or category[0] == "M" and unicodedata.ucd_3_2_0.category(x) == "Cn":
                continue
            kind[c] = LETTER if category[0] == "L" else NUMBER if category[0] == "N" else OTHER
            lower[c] = ord(low)
            # Marks and conjoining vowels join what is before them.
            compose[c] = category[0] == "M" or 0x1160 <= c < 0x1200 or unicodedata.normalize("NFC", x) != x
    for a, b in ALL_LETTERS:
        kind[a:b] = LETTER
    kind[[9, 10, 11, 12, 13, 32, *BLANKS]] = BLANK
    return kind, lower, compose


_KIND, _LOW, _COMPOSE = _classes()
_CODE = K.seeded(31, TOP + 1)
_ENDINGS = [("s", ""), ("t", ""), ("m", ""), ("d", ""), ("r", "e"), ("v", "e"), ("l", "l")]  # fixed: after an apostrophe


def texts(column: pa.Array, most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Rows as strings, in runs of about most characters; null counts as empty."""
    out, size = [], 0
    for x in column.to_pylist():
        x = x or ""
        if out and size + len(x) > most:
            yield out
            out, size = [], 0
        out.append(x)
        size += len(x)
    if out:
        yield out
    K.release()


class Splitter:
    """Words of texts as the two public patterns cut them; spaced: the one that keeps white space."""

    def __init__(self, spaced: bool):
        self.spaced = spaced

    @staticmethod
    def _points(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each row begins, and the code points of all rows with a newline after each."""
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(np.array([len(x) for x in rows], np.int64) + 1, out=at[1:])
        return at, np.frombuffer(("\n".join(rows) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)

    def __call__(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code points, starts, ends, words before each row, rows that need the library)."""
        at, cp = self._points(rows)
        if not self.spaced:
            joined = np.flatnonzero(_COMPOSE[np.minimum(cp, TOP)])
            again = [k for k in np.unique(np.searchsorted(at, joined, "right") - 1).tolist() if not unicodedata.is_normalized("NFC", rows[k])]
            if again:
                rows = list(rows)
                for k in again:
                    rows[k] = unicodedata.normalize("NFC", rows[k])
                at, cp = self._points(rows)
        small = np.minimum(cp, TOP)
        kind = _KIND[small]
        odd_at = np.flatnonzero(kind == ODD)
        odd = np.zeros(len(rows), bool)
        odd[np.searchsorted(at, odd_at, "right") - 1] = True
        kind[at[1:] - 1] = BORDER
        low = small if self.spaced else _LOW[small]
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        if not self.spaced:
            new |= kind == NUMBER
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(kind))
        what = kind[begin]
        after = np.append(what[1:], BORDER)
        gap = np.zeros(len(begin), bool)  # a blank given to the word after it
        if self.spaced:
            gap[1:] = (what[:-1] == BLANK) & (cp[begin[1:] - 1] == 32) & (what[1:] < BLANK)
        # an apostrophe alone, before a word that begins with one of the endings
        lone = (what == OTHER) & (end - begin == 1) & (cp[begin] == 39) & (after == LETTER) & ~gap
        take = np.zeros(len(begin), np.int64)
        i = np.flatnonzero(lone)
        if len(i):
            one, two = low[end[i]], low[np.minimum(end[i] + 1, len(low) - 1)]
            long = end[i + 1] - begin[i + 1] > 1
            for a, b in _ENDINGS:
                fits = (one == ord(a)) & ((b == "") | (long & (two == ord(b or " "))))
                take[i[fits & (take[i] == 0)]] = 1 + len(b)
        s, e = begin.copy(), end.copy()
        e += take
        s[1:] += take[:-1]
        s -= gap
        if self.spaced:
            # a run of blanks leaves its last one to the word after it: joined to it if it is a space, else on its own
            blank = (what == BLANK) & (after != BORDER)
            cut = np.flatnonzero(blank)
            given = gap[np.minimum(cut + 1, len(gap) - 1)]
            alone = cut[~given & (end[cut] - begin[cut] > 1)]
            e[cut[given]] -= 1
            e[alone] -= 1
            s, e = np.concatenate([s, e[alone]]), np.concatenate([e, e[alone] + 1])
            keep = (e > s) & (np.concatenate([what, np.full(len(alone), BLANK, what.dtype)]) != BORDER)
            s, e = s[keep], e[keep]
            order = np.argsort(s, kind="stable")
            s, e = s[order], e[order]
        else:
            keep = (e > s) & (what < BLANK)
            s, e = s[keep], e[keep]
        return low, s, e, np.searchsorted(s, at), odd


class WordTable:
    """Ids of words by their hashes, as arrays; emptied when it holds more than most words."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, keys)
        i[i == len(self.keys)] = 0
        return i, (self.keys[i] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(size) - size
        self.used += len(flat)
        i = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, i, keys), np.insert(self.start, i, start), np.insert(self.size, i, size)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[0]: start[0] + size[0]], then those of the next, and so on."""
    end = np.cumsum(size, dtype=np.int64)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]


Words = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class Encoder:
    """Ids of whole texts.

    words: ids of distinct words, one after the other, and their numbers; whole:
    encodes a text with code points that are not tabled; special: tokens that
    are found in a text before it is cut into words.
    """

    def __init__(self, spaced: bool, words: Words, whole: Callable[[str], list[int]], special: dict[str, int]):
        self.split, self.words, self.whole, self.special, self.table = Splitter(spaced), words, whole, special, WordTable()
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None

    def __call__(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, one after the other; number of ids of each row)."""
        pieces = {k: self.cut.split(x) for k, x in enumerate(rows) if "<" in x and self.cut.search(x)} if self.cut else {}
        if not pieces:
            return self._plain(rows)
        # What lies between special tokens is a text of its own.
        ids, counts = self._plain([y for k, x in enumerate(rows) for y in (pieces[k][::2] if k in pieces else [x])])
        parts, at, out = np.split(ids, np.cumsum(counts)[:-1]), 0, []
        for k in range(len(rows)):
            own = pieces.get(k, [""])
            mine = []
            for j in range(0, len(own), 2):
                mine.append(parts[at])
                at += 1
                if j + 1 < len(own):
                    mine.append(np.array([self.special[own[j + 1]]], np.uint32))
            out.append(np.concatenate(mine))
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _plain(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        low, s, e, at, odd = self.split(rows)
        h = K.SpanHash(_CODE[low])(s, e)
        keys, one, which = np.unique(h, return_index=True, return_inverse=True)
        i, known = self.table.find(keys)
        if not known.all():
            if len(self.table.keys) > self.table.most:
                self.table.clear()
                known[:] = False
            text = low.tobytes().decode("utf-32-le", "surrogatepass")
            new = np.flatnonzero(~known)
            self.table.add(keys[new], *self.words([text[a:b] for a, b in zip(s[one[new]].tolist(), e[one[new]].tolist(), strict=True)]))
            i, _ = self.table.find(keys)
        start, size = self.table.start[i][which], self.table.size[i][which]
        ids = gather(self.table.flat, start, size)
        before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        counts = before[at[1:]] - before[at[:-1]]
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd):
                parts[k] = np.array(self.whole(rows[k]), np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int32, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixTrie:
    """Encodes distinct words by depth-first traversal of their trie; end marks the last letter of a word.

    A node also keeps the place in an automaton of the vocabulary that holds
    the longest end of the prefix that begins a token. Its links lead from
    there to every token that ends at the node, the longest first.
    """

    END = 256

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.end = bool(end)
        self.rank, self.parts, self.pair = {}, {}, {}
        for r, (a, b) in enumerate(merges):
            t = vocab[a + b]
            if t not in self.rank:
                self.rank[t], self.parts[t] = r, (vocab[a], vocab[b])
            self.pair.setdefault((vocab[a], vocab[b]), r)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.size: dict[int, int] = {}
        self.next: dict[int, int] = {}  # place * 512 + byte -> place
        token, rows = [-1], [[(0, 0, 0)]]
        for x, t in vocab.items():
            last = bool(end) and x.endswith(end) and len(x) > len(end)
            letters = x[: -len(end)] if last else x
            if any(c not in back for c in letters):
                continue  # a special token
            self.size[t] = len(letters)
            at = 0
            for depth, code in enumerate([*(back[c] for c in letters), *([self.END] if last else [])], 1):
                to = self.next.get(at << 9 | code)
                if to is None:
                    to = self.next[at << 9 | code] = len(token)
                    token.append(-1)
                    if depth == len(rows):
                        rows.append([])
                    rows[depth].append((at, code, to))
                at = to
            token[at] = t
        self.token, self.fail = token, [0] * len(token)
        for row in rows[2:]:
            for at, code, to in row:
                self.fail[to] = self.step(self.fail[at], code)
        self.ending: dict[int, list[tuple[int, int]]] = {}
        self.next_to: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def step(self, at: int, code: int) -> int:
        """The place after one more letter."""
        to = self.next.get(at << 9 | code)
        while to is None and at:
            at = self.fail[at]
            to = self.next.get(at << 9 | code)
        return to or 0

    def tokens(self, at: int) -> list[tuple[int, int]]:
        """(letters, token) of the tokens that end here and are the encodings of their own letters, the longest first."""
        out = self.ending.get(at)
        if out is None:
            t = self.token[at]
            out = [(self.size[t], t)] if t >= 0 and self.stands(t) else []
            if at:
                out = out + self.tokens(self.fail[at])
            self.ending[at] = out
        return out

    def apart(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether a and b, side by side, never merge across their border.

        Time runs over the ranks of the merges. What touches the border is
        undone from the latest merge back; a pair that stood there while its
        own merge was due would have merged.
        """
        until_a = until_b = before  # the rank at which the left and the right neighbour of the border went into something larger
        while True:
            r = self.pair.get((a, b))
            if r is not None and r < until_a and r <= until_b and r < before:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until_a, a = ra, self.parts[a][1]
            else:
                until_b, b = rb, self.parts[b][0]

    def stands(self, t: int) -> bool:
        """Whether t is the encoding of its own letters."""
        ok = self.whole.get(t)
        if ok is None:
            if t not in self.rank:
                ok = True
            else:
                a, b = self.parts[t]
                ok = self.stands(a) and self.stands(b) and self.apart(a, b, self.rank[t])
            self.whole[t] = ok
        return ok

    def _last(self, d: int, at: int, states: list[int]) -> int:
        seen = self.next_to
        for n, t in self.ending.get(at) or self.tokens(at):
            if n == d:
                return t
            key = states[d - n - 1] << 20 | t
            ok = seen.get(key)
            if ok is None:
                ok = self.apart(states[d - n - 1], t)
                if len(seen) > 200_000:
                    seen.clear()
                seen[key] = ok
            if ok:
                return t
        raise ValueError("a word has letters outside the vocabulary")

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spelt = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[list[int]] = [[]] * len(words)
        path, states, places, size = b"", [], [0], self.size
        for k in sorted(range(len(words)), key=spelt.__getitem__):
            w = spelt[k]
            if not w:
                continue
            same, most = 0, min(len(path), len(w) - 1)
            while same < most and path[same] == w[same]:
                same += 1
            same = min(same, len(states))
            del states[same:], places[same + 1 :]
            for d in range(same, len(w) - 1):
                places.append(self.step(places[d], w[d]))
                states.append(self._last(d + 1, places[d + 1], states))
            path = w
            at = self.step(places[-1], w[-1])
            d, t, ids = len(w), self._last(len(w), self.step(at, self.END) if self.end else at, states), []
            while True:
                ids.append(t)
                d -= size[t]
                if d <= 0:
                    break
                t = states[d - 1]
            out[k] = ids[::-1]
        return _flat(out)


class LibraryWords:
    """Ids of distinct words from the library.

    Words that begin with a space and hold one class of letters stay words
    wherever they stand in a text, so they are encoded as one text, and their
    ids are told apart by the bytes that each id stands for. Others go singly.
    """

    def __init__(self, tokenizer, spaced: bool, size: np.ndarray):
        self.t, self.spaced, self.size = tokenizer, spaced, size

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.spaced:
            return _flat([e.ids for e in self.t.encode_batch_fast(words, add_special_tokens=False)])
        many = np.fromiter((len(w) > 1 and w[0] == " " and w[1] != " " for w in words), bool, len(words))
        joined, alone = [w for w, m in zip(words, many, strict=True) if m], [w for w, m in zip(words, many, strict=True) if not m]
        sizes = np.zeros(len(words), np.int32)
        flat = np.array(self.t.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, np.uint32) if joined else np.zeros(0, np.uint32)
        ends = np.cumsum(np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in joined), np.int64, len(joined)))
        at = np.searchsorted(np.cumsum(self.size[flat]), ends) + 1
        sizes[many] = np.diff(at, prepend=0)
        if not alone:
            return flat, sizes
        more, n = _flat([e.ids for e in self.t.encode_batch_fast(alone, add_special_tokens=False)])
        sizes[~many] = n
        start = np.zeros(len(words), np.int64)
        start[many], start[~many] = at - np.diff(at, prepend=0), len(flat) + np.cumsum(n) - n
        return gather(np.concatenate([flat, more]), start, sizes), sizes


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_made: dict = {}


def encoder(path: str, method: str) -> tuple[Encoder, list[str]]:
    """The worker's encoder for a vocabulary file, and the strings of its ids; kept between batches.

    method "trie": PrefixTrie; "library": the file's own library, for each distinct word.
    """
    if (path, method) not in _made:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        t, model = library(path), spec["model"]
        spaced = spec["normalizer"] is None
        names = [""] * t.get_vocab_size()
        for x, i in t.get_vocab().items():
            names[i] = x
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        whole = lambda x: t.encode(x, add_special_tokens=False).ids
        if method == "trie":
            words = PrefixTrie(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        else:
            # A byte is one letter of a token's string.
            words = LibraryWords(t, spaced, np.array([len(x) for x in names], np.int64))
        _made[path, method] = Encoder(spaced, words, whole, special), names
    return _made[path, method]
