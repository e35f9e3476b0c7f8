"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks the pairs up among the sorted pair keys by
binary search, takes in each word the pair of the lowest rank (the leftmost of equals), and merges it in all
words at once; the rounds end when no word has a pair left that can be merged.

Defined cases: a null text encodes as the empty text; the empty text has no tokens and decodes to the empty
text; a byte outside the vocabulary cannot occur, as the vocabulary holds all 256; repeated rows are encoded each; an
empty table gives no rows; columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_arrow

#: Unicode white space as the tokenizer's regular expressions see it.
SPACE = "\t-\r \x85\xa0  -     　"
# Letters that the tokenizer library's Unicode tables (version 16) do not know and `regex` may know, and
# capital letters that the library knows and Python may not.
NEWER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
).split()
NEWER_CAPITALS = {"\u1c89": "\u1c8a", "\ua7cb": "\u0264", "\ua7cc": "\ua7cd", "\ua7da": "\ua7db", "\ua7ce": "\ua7cf", "\ua7d2": "\ua7d3", "\ua7d4": "\ua7d5", "\ua7dc": "\u019b"}
NEWER_CAPITALS |= {chr(c): chr(c + 32) for c in range(0x10D50, 0x10D66)} | {chr(c): chr(c + 27) for c in range(0x16EA0, 0x16EB9)}
# Combining marks that the library's tables do not know as such, so that it leaves them where they are, and
# the second half of the one letter that it does not compose.
NEWER_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 "
    "11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 "
    "1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
).split()
_NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(shown))
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [names[b] for b in range(256)]


def _class(ranges: list[str]) -> str:
    """The inside of a character class."""
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges)


_MARKS = re.compile(f"([{_class(NEWER_MARKS)}])")


#: From the first of the newer capitals on: one range, which is looked for faster than their class.
_LATE = re.compile(f"[{min(NEWER_CAPITALS)}-\U0010ffff]")


def normalised(text: str) -> str:
    """The composed form (NFC) as the library has it: the newer marks neither move nor let others past."""
    if unicodedata.is_normalized("NFC", text):  # then the library, which knows fewer marks, changes nothing either
        return text
    if not _MARKS.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(_MARKS.split(text)))


class Encoder:
    """A word-end BPE vocabulary read from a tokenizer file (its path is a parameter)."""

    #: Words whose tokens are remembered; beyond it the memory is emptied, which only costs time.
    REMEMBERED = 400_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.names = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._word = regex.compile(pattern.replace(r"\s", SPACE))
        newer = _class(NEWER_LETTERS)
        self._newer = re.compile(f"[{newer}]")
        older = pattern.replace(r"\s", SPACE).replace(r"\p{L}", rf"[\p{{L}}--[{newer}]]").replace(r"\p{N}", rf"[\p{{N}}--[{newer}]]")
        self._older_word = regex.compile(older, regex.V1)
        self._capitals = re.compile("[" + "".join(NEWER_CAPITALS) + "]")
        self._space = re.compile(f"[{SPACE}]+")
        end = model["end_of_word_suffix"]
        byte = byte_symbols()
        self._inner = np.array([vocab[c] for c in byte], np.int64)
        self._last = np.array([vocab[c + end] for c in byte], np.int64)
        self._base = max(vocab.values()) + 1
        left, right, made = zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]), strict=True)
        keys = np.array(left, np.int64) * self._base + np.array(right, np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks, self._made = keys[order], order.astype(np.int64), np.array(made, np.int64)
        self._separators = re.compile("[\x1c-\x1f]")
        self._memory: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search over the sorted pair keys."""
        keys = left * self._base + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], _NO_RANK)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian, 32 bits) of each non-empty word, all words merged together."""
        if not words:
            return []
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        symbols = self._inner[flat]
        symbols[ends - 1] = self._last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done = [b""] * len(words)
        rank = np.full(len(symbols), _NO_RANK)  # of the pair that a symbol starts; none at a word's end
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, first)
            # words without a pair to merge are finished and leave the arrays
            over = least == _NO_RANK
            if over.any():
                cut = np.r_[first, len(symbols)]
                ids, at = symbols.astype("<u4").tobytes(), np.flatnonzero(over)
                for k, a, b in zip(owner[first[at]].tolist(), (4 * cut[at]).tolist(), (4 * cut[at + 1]).tolist(), strict=True):
                    done[k] = ids[a:b]
                keep = ~np.repeat(over, np.diff(cut))
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                if not len(symbols):
                    break
                first, least = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), least[~over]
            size = np.diff(np.r_[first, len(symbols)])
            hits = np.flatnonzero(rank == np.repeat(least, size))
            hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]  # leftmost of a word
            symbols[hits] = self._made[rank[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            rank[hits] = rank[hits + 1]  # an end of the word moves to the merged symbol
            place = np.cumsum(keep) - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            touched = np.r_[place[hits], place[hits] - 1]
            touched = touched[(touched >= 0) & (touched < len(symbols) - 1)]
            inside = owner[touched] == owner[touched + 1]
            rank[touched[~inside]] = _NO_RANK
            touched = touched[inside]
            rank[touched] = self._rank(symbols[touched], symbols[touched + 1])
            rank[-1] = _NO_RANK
        return done

    def chunks(self, text: str) -> list[str]:
        """Normalised text between white space; special tokens stand alone, marked by a leading space."""
        if self._special is not None and "<|" in text:
            out: list[str] = []
            for part in self._special.split(text):
                out += [" " + part] if part in self.specials else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # one character at a time: no special form of a final sigma
            text = normalised(text).replace("Σ", "σ")
            if _LATE.search(text) and self._capitals.search(text):
                text = self._capitals.sub(lambda m: NEWER_CAPITALS[m[0]], text)
        if self._separators.search(text):  # str.split() takes these for white space, the vocabulary does not
            return [c for c in self._space.split(text.lower()) if c]
        return text.lower().split()

    def _words_of(self, chunk: str) -> list[str]:
        if chunk.isalpha() and "'" not in chunk:
            return [chunk]
        if chunk[-1] in ".,!" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        if chunk[0] == " ":
            return []
        word = self._word if chunk.isascii() or not self._newer.search(chunk) else self._older_word
        return word.findall(chunk)

    def learn(self, texts: Iterable[list[str]]) -> dict[str, bytes]:
        """Ids of every chunk as little-endian unsigned 32-bit numbers, from memory or by merge rounds over all new words."""
        if len(self._memory) > self.REMEMBERED:
            self._memory = {}
        if len(self._words) > self.REMEMBERED:
            self._words = {}
        memory, known = self._memory, self._words
        new = set().union(*texts).difference(memory)
        found = {c: self._words_of(c) for c in new}
        words = list(set().union(*found.values()).difference(known))
        known.update(zip(words, self.merge_words([w.encode() for w in words]), strict=True))
        for c, ws in found.items():
            memory[c] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])
            if c[0] == " ":
                memory[c] = np.array([self.specials[c[1:]]], "<u4").tobytes()
        return memory

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        split = [self.chunks(t or "") for t in texts]
        known = self.learn(split)
        return [np.frombuffer(b"".join([known[c] for c in cs]), "<u4").tolist() for cs in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids: the tokens as the vocabulary spells them, joined by a space."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path)


class _Spelled(dict):
    """Strings made from a chunk's ids; emptied when they are more than the encoder remembers."""

    def __init__(self, enc: Encoder, spell):
        super().__init__()
        self.known: dict[str, bytes] = {}
        self._most, self._spell = enc.REMEMBERED, spell

    def over(self, known: dict[str, bytes]) -> _Spelled:
        """The same strings, for chunks of `known`."""
        self.known = known
        if len(self) > self._most:
            self.clear()
        return self

    def __missing__(self, chunk: str) -> str:
        out = self[chunk] = self._spell(np.frombuffer(self.known[chunk], "<u4").tolist())
        return out


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of each row's whole text (see the module's docstring)."""

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        enc = encoder(vocabulary)
        spelled_ids, spelled_names = _Spelled(enc, lambda x: " ".join(map(str, x))), _Spelled(enc, enc.decode)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for doc_ids, texts in batches:
            split = [enc.chunks(t or "") for t in texts]
            known = enc.learn(split)
            ids, names = spelled_ids.over(known), spelled_names.over(known)
            yield {
                "doc_id": doc_ids,
                "n_tokens": [sum([len(known[c]) for c in cs]) // 4 for cs in split],
                "ids_sha256": [sha(" ".join([ids[c] for c in cs])) for cs in split],
                "decoded_sha256": [sha(" ".join([names[c] for c in cs])) for cs in split],
            }

    return map_arrow(docs, ["doc_id", "text"], work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
