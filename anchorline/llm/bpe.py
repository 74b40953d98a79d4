"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

The leaf of a symbol holds the rank of the pair it makes with the next living symbol, the root holds the
smallest one with its leftmost place. A merge changes at most three leaves, each a walk of logarithmic length,
and the word is done when the root holds no pair.

Null texts count as empty; an empty text has no tokens and decodes to the empty string. Repeated rows and
repeated ids are encoded row by row, other columns are ignored, an empty table gives no rows. A text without any
break is one word of any length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from anchorline.llm.common import map_rows, text_of

#: Words, and chunks of words, that a worker keeps; beyond that it forgets them all and starts anew.
CACHE = 400_000
NO_PAIR = 1 << 62

#: The white space of the tokenizer's patterns.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Controls that str.split takes for white space and the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the others
    follow from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def merge_word(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the leftmost merge of the lowest rank until none is left."""
    n = len(symbols)
    if n < 2:
        return symbols
    base = 1 << (n - 1).bit_length()
    tree = [NO_PAIR] * (2 * base)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> int:
        j = after[i]
        rank = ranks.get((symbols[i], symbols[j])) if j < n else None
        return NO_PAIR if rank is None else rank * n + i

    def update(i: int, value: int) -> None:
        at = base + i
        tree[at] = value
        at >>= 1
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            least = left if left < right else right
            if tree[at] == least:
                return
            tree[at] = least
            at >>= 1

    for i in range(n - 1):
        tree[base + i] = leaf(i)
    for at in range(base - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    while tree[1] != NO_PAIR:
        i = tree[1] % n
        j = after[i]
        symbols[i] += symbols[j]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        update(j, NO_PAIR)
        update(i, leaf(i))
        if before[i] >= 0:
            update(before[i], leaf(before[i]))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class MergeForest:
    """The same segment tree for many words at once: one row for each word, one array operation for the same
    step of all of them. Words of a similar length share a forest; longer ones go through `merge_word`."""

    LONGEST = 64
    WORDS = 20_000

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], NO_PAIR)

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        n = np.array([len(w) for w in words])
        base = 1 << max(1, int(n.max() - 1).bit_length())
        here = np.arange(len(words))
        symbols = np.zeros((len(words), base + 1), np.int64)
        symbols[np.repeat(here, n), np.concatenate([np.arange(k) for k in n])] = [x for w in words for x in w]
        place = np.arange(base)
        after = np.tile(place + 1, (len(words), 1))
        before = np.tile(place - 1, (len(words), 1))
        tree = np.full((len(words), 2 * base), NO_PAIR, np.int64)
        pairs = place[None, :] < n[:, None] - 1
        rank = self.ranks(symbols[:, :base][pairs], symbols[:, 1:][pairs])
        tree[:, base:][pairs] = np.where(rank < NO_PAIR, rank * base + np.nonzero(pairs)[1], NO_PAIR)
        level = base
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            at = at + base
            tree[rows, at] = value
            while len(at) and at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        def pair(rows: np.ndarray, i: np.ndarray) -> np.ndarray:
            j = after[rows, i]
            found = self.ranks(symbols[rows, i], symbols[rows, j])
            return np.where((j < n[rows]) & (found < NO_PAIR), found * base + i, NO_PAIR)

        rows = here[tree[:, 1] < NO_PAIR]
        while len(rows):
            root = tree[rows, 1]
            i = root % base
            j = after[rows, i]
            k = after[rows, j]
            symbols[rows, i] = self.merged[root // base]
            after[rows, i] = k
            more = k < n[rows]
            before[rows[more], k[more]] = i[more]
            update(rows, j, NO_PAIR)
            update(rows, i, pair(rows, i))
            p = before[rows, i]
            some = p >= 0
            update(rows[some], p[some], pair(rows[some], p[some]))
            rows = rows[tree[rows, 1] < NO_PAIR]
        out = []
        for symbol, step, length in zip(symbols.tolist(), after.tolist(), n.tolist(), strict=True):
            made, i = [], 0
            while i < length:
                made.append(symbol[i])
                i = step[i]
            out.append(made)
        return out


class WordTokenizer:
    """Encoder and decoder for a vocabulary file with word-end marks, lower-cased text and no decoder of its
    own, so that decoded tokens are joined by spaces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model = given["model"]
        self.vocab = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.forest = MergeForest(self.vocab, merges)
        self.pair_ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.names = {i: token for token, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        self.first = [self.vocab[c] for c in self.alphabet]
        self.last = [self.vocab[c + self.end] for c in self.alphabet]
        self.words: dict[str, tuple[int, str, str]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, special ones kept."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def _long_word(self, raw: bytes) -> list[int]:
        symbols = [self.alphabet[b] for b in raw]
        symbols[-1] += self.end
        return [self.vocab[t] for t in merge_word(symbols, self.pair_ranks)]

    def _learn(self, words: set[str]) -> None:
        """Encode words that are not known yet."""
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            if len(raw) > MergeForest.LONGEST:
                self._keep(word, self._long_word(raw))
            else:
                sizes.setdefault((len(raw) - 1).bit_length(), []).append((word, raw))
        for group in sizes.values():
            for at in range(0, len(group), MergeForest.WORDS):
                part = group[at:at + MergeForest.WORDS]
                symbols = [[*[self.first[b] for b in raw[:-1]], self.last[raw[-1]]] for _, raw in part]
                for (word, _), ids in zip(part, self.forest.merge(symbols), strict=True):
                    self._keep(word, ids)

    def _keep(self, word: str, ids: list[int]) -> None:
        self.words[word] = (len(ids), " ".join(map(str, ids)), self.decode(ids))

    def _pieces(self, text: str) -> list[tuple[str, list[str]]]:
        """What each part of a text is made of: a special token, whole words, or chunks between white space."""
        out = []
        for part in self.special_at.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append((part, []))
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out.append(("words", WORD.findall(part)) if ODD_SPACE.search(part) else ("chunks", part.split()))
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of tokens, ids and decoded tokens, both joined by spaces."""
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        pieces = [self._pieces(t) for t in texts]
        new, words = {}, set()
        for text in pieces:
            for kind, items in text:
                if kind == "words":
                    words.update(items)
                else:
                    new.update({c: WORD.findall(c) for c in items if c not in self.chunks and c not in new})
        words.update(*new.values())
        self._learn({w for w in words if w not in self.words})
        known = self.words
        for chunk, items in new.items():
            if len(items) == 1:
                self.chunks[chunk] = known[items[0]]
            else:
                made = [known[w] for w in items]
                self.chunks[chunk] = (
                    sum([m[0] for m in made]), " ".join([m[1] for m in made]), " ".join([m[2] for m in made])
                )
        out = []
        for text in pieces:
            made = []
            for kind, items in text:
                if kind in self.special:
                    made.append((1, str(self.special[kind]), kind))
                else:
                    found = known if kind == "words" else self.chunks
                    made += [m for m in map(found.__getitem__, items) if m[0]]
            out.append((sum([m[0] for m in made]), " ".join([m[1] for m in made]), " ".join([m[2] for m in made])))
        return out


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every text: (id, n_tokens, ids, decoded), ids as decimals joined by a space."""
    def rows(part: dict[str, list]) -> dict[str, list]:
        made = load(path).encode(part["text"])
        return {"id": part["id"], "n_tokens": [m[0] for m in made], "ids": [m[1] for m in made],
                "decoded": [m[2] for m in made]}

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))
    return map_rows(source, rows, f"id {kind}, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode_decode`, with SHA-256 of both texts instead of the texts, so that little leaves the workers."""
    def rows(part: dict[str, list]) -> dict[str, list]:
        made = load(path).encode(part["text"])
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        return {"id": part["id"], "n_tokens": [m[0] for m in made], "ids_sha256": [sha(m[1]) for m in made],
                "decoded_sha256": [sha(m[2]) for m in made]}

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text"))
    return map_rows(source, rows, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
