"""Token ids of a byte-level vocabulary file, as little-endian unsigned 32-bit numbers."""

from __future__ import annotations

import json
from array import array

import tiktoken

from anchorline.llm.bpe import byte_alphabet

#: Fixed value: how byte-level vocabularies of this kind split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 500_000


class ByteTokenizer(dict):
    """Maps a text without spaces to the ids of a space and that text; ids of a whole text come from the pieces
    between its spaces, because no token reaches over a space that follows something else than white space.
    None marks a piece that ends in white space or is empty: then the whole text is encoded at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"]: t["id"] for t in given["added_tokens"]}
        vocab = {t: i for t, i in given["model"]["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in given["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("ids have to follow the order of the merges")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)

    def whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.encoding.encode(text, allowed_special="all")).tobytes()
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        made = None if not piece or piece[-1].isspace() else self.whole(" " + piece)
        if len(self) >= CACHE:
            self.clear()
        self[piece] = made
        return made

    def ids(self, text: str) -> bytes:
        """Four bytes for each token of the text."""
        first, *rest = text.split(" ")
        if not rest or first and first[-1].isspace():
            return self.whole(text)
        pieces = [self[p] for p in rest]
        return self.whole(text) if None in pieces else self.whole(first) + b"".join(pieces)


_LOADED: dict[str, ByteTokenizer] = {}


def load(path: str) -> ByteTokenizer:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]
