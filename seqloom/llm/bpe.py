"""Byte-pair vocabularies of byte-level tokenizer files, and their pre-tokenisation.

Loaded once per Python worker and path. Nothing here is trained.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

NONE = np.iinfo(np.int32).max

# Fixed value: the pre-tokeniser's pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is visible Latin-1, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        self.path = path
        spec = self._spec()
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.byte_list = [ids[c] for c in byte_symbols()]
        self.byte_id = np.array(self.byte_list, np.int64)
        self._special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._find = regex.compile(PATTERN).findall
        self._odd = None

    def _spec(self) -> dict:
        """The file's contents, which aren't kept: each worker needs only one of the tables made from them."""
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    @functools.cached_property
    def token_bytes(self) -> dict[int, bytes]:
        back = {c: b for b, c in enumerate(byte_symbols())}
        out = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in self._spec()["model"]["vocab"].items()}
        return out | {i: t.encode() for t, i in self.special.items()}

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all pairs that merge, sorted, their ranks and what they become."""
        model = self._spec()["model"]
        ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        new = np.array([ids[a + b] for a, b in merges], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        return key[order], order.astype(np.int32), new[order]

    @functools.cached_property
    def ranks(self) -> dict[int, tuple[int, int]]:
        """(rank, new symbol) of each pair's key."""
        key, rank, new = (x.tolist() for x in self.pairs)
        return {k: (r, n) for k, r, n in zip(key, rank, new, strict=True)}

    def split_special(self, text: str) -> Iterator[tuple[str, bool]]:
        """(piece, is a special token): special tokens' strings stand alone, leftmost and longest first."""
        if self._special_re is None or not self._special_re.search(text):
            yield text, False
            return
        at = 0
        for m in self._special_re.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():  # letters of either's Unicode version, after a space or not
            return [text]
        if not text.isascii() and self._later_unicode().search(text):
            return self._exact(text)
        return self._find(text)

    def _later_unicode(self):
        """Characters whose class depends on the Unicode version: only there may the library differ from `regex`."""
        if self._odd is None:
            everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
            new = regex.findall(r"[\p{L}\p{N}\s]", everything)
            odd = [c for c in new if unicodedata.category(c) == "Cn"]
            from tokenizers import pre_tokenizers

            split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
            self.letters_of_odd = {c: "a" if len(split("a" + c)) == 1 else "1" if len(split("1" + c)) == 1 else "!" for c in odd}
            runs, start = [], None
            for a, b in zip(odd, [*odd[1:], None], strict=True):
                start = start or a
                if b is None or ord(b) != ord(a) + 1:
                    runs.append(f"{start}-{a}")
                    start = None
            self._odd = regex.compile(f"[{''.join(runs)}]")
        return self._odd

    def _exact(self, text: str) -> list[str]:
        """As `words`, with newly assigned characters classed as the library classes them."""
        plain = "".join(self.letters_of_odd.get(c, c) for c in text)
        out, at = [], 0
        for w in self._find(plain):  # one character stands for one, so the cuts are the same
            out.append(text[at : at + len(w)])
            at += len(w)
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


LONE = regex.compile(r"(?<=\S) (?=\S)")
CROWDED = regex.compile(r" \s|\s ")


def chunks(text: str) -> list[str]:
    """Pieces of a text, each but the first with the space before it; pre-tokens never cross such a cut.

    Only a space between two characters that aren't white space is cut at: in
    a longer run of white space of any kind the run decides where tokens end.
    """
    cut = LONE.split(text) if CROWDED.search(text) else text.split(" ")
    return [cut[0], *[f" {c}" for c in cut[1:]]] if len(cut) > 1 else cut


def merge_rounds(vocab: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Token ids of each word, by rounds over the symbols of all words in one flat array.

    A round looks all adjacent pairs up by binary search in the sorted pair
    keys, takes each word's lowest rank, and merges that pair wherever it
    occurs in the word, from the left. Words without a known pair leave.
    """
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    which = np.flatnonzero(lens)
    sym = vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    lens = lens[which]
    keys, ranks, new = vocab.pairs
    while len(which):
        starts = np.cumsum(lens) - lens
        key = np.empty(len(sym), np.int64)
        key[:-1] = sym[:-1] << 32 | sym[1:]
        key[starts + lens - 1] = -1
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank = np.where(keys[at] == key, ranks[at], NONE)
        least = np.minimum.reduceat(rank, starts)
        done = least == NONE
        if done.any():
            ids = sym.astype(np.uint32)
            for w, s, n in zip(which[done].tolist(), starts[done].tolist(), lens[done].tolist(), strict=True):
                out[w] = ids[s : s + n]
            keep = np.repeat(~done, lens)
            sym, rank, at = sym[keep], rank[keep], at[keep]
            which, lens, least = which[~done], lens[~done], least[~done]
            if not len(which):
                break
        hit = rank == np.repeat(least, lens)
        i = np.flatnonzero(hit)
        first = np.empty(len(i), bool)
        first[:1] = True
        first[1:] = i[1:] != i[:-1] + 1  # in a run such as aaaa, every other pair overlaps the one before
        run = np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
        i = i[(np.arange(len(i)) - run) % 2 == 0]
        sym[i] = new[at[i]]
        keep = np.ones(len(sym), bool)
        keep[i + 1] = False
        ends = np.cumsum(lens)
        gone = np.cumsum(~keep)
        upto = gone[ends - 1]
        lens = lens - np.diff(upto, prepend=0)
        sym = sym[keep]
    return out


def heap_count(vocab: Vocabulary, word: bytes) -> int:
    """Number of tokens of a word: symbols less merges, by a heap of pairs over a linked list; no id is given out."""
    n = len(word)
    if n < 2:
        return n
    ranks = vocab.ranks
    sym = vocab.byte_id[np.frombuffer(word, np.uint8)].tolist() if n > 64 else [vocab.byte_list[b] for b in word]
    heap = []
    for i in range(n - 1):
        k = sym[i] << 32 | sym[i + 1]
        if k in ranks:
            heap.append((ranks[k][0], i, k))
    if not heap:
        return n
    heapq.heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        _, i, k = heapq.heappop(heap)
        j = after[i]
        if j >= n or sym[i] < 0 or sym[i] << 32 | sym[j] != k:
            continue
        sym[i], sym[j] = ranks[k][1], -1
        left -= 1
        after[i] = nxt = after[j]
        if nxt < n:
            before[nxt] = i
            k = sym[i] << 32 | sym[nxt]
            if k in ranks:
                heapq.heappush(heap, (ranks[k][0], i, k))
        prev = before[i]
        if prev >= 0:
            k = sym[prev] << 32 | sym[i]
            if k in ranks:
                heapq.heappush(heap, (ranks[k][0], prev, k))
    return left
