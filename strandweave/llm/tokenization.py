"""Byte-level BPE ids of whole texts, exact and cached by word.

The vocabulary is a public ``tokenizers`` JSON file whose path is a parameter. Ids equal
``Tokenizer.encode(text, add_special_tokens=False)`` with special strings as ordinary text;
tests hold the two against each other. A text is cut at single blanks between two visible
characters, where the pre-tokeniser always cuts, so each piece is encoded once per worker
and joined from a bounded cache; pieces not in the cache are encoded together and dealt
back by their byte lengths.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: the byte-level pre-tokeniser's pattern of the public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces that a worker keeps; beyond it the cache starts anew.
CACHE_PIECES = 1_000_000
_UNSAFE = re.compile(r"^ | $| \s|\s ")
_RARE_SPACE = re.compile(r"[^\S \n]")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


def _byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _unsafe(text: str) -> bool:
    """Whether some blank begins or ends the text or has white space beside it."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text:
        return True
    return bool(_RARE_SPACE.search(text)) and bool(_UNSAFE.search(text))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_of_letter()
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    return {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


class CachedEncoder:
    """Encodes texts to little-endian unsigned ids of ``width`` bytes."""

    def __init__(self, path: str, width: int = 4, cache_pieces: int = CACHE_PIECES):
        import tiktoken

        ranks = load_ranks(path)
        if width == 2 and max(ranks.values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary need 4 bytes")
        self._encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self._bytes[list(ranks.values())] = [len(t) for t in ranks]
        self._type = np.dtype("<u4" if width == 4 else "<u2")
        self._width, self._limit = width, cache_pieces
        self._cache: dict[str, bytes] = {"": b""}

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces (each but a text's first begins with a blank) as one text and cuts it back."""
        ids = np.array(self._encoding.encode_ordinary(" ".join(pieces)), dtype=np.int64)
        ends = np.cumsum(self._bytes[ids])
        sizes = np.array([len(p.encode("utf-8")) for p in pieces], dtype=np.int64)
        sizes[1:] += 1
        cuts = np.searchsorted(ends, np.cumsum(sizes), "right") * self._width
        data = ids.astype(self._type).tobytes()
        at = 0
        for piece, to in zip(pieces, cuts.tolist(), strict=True):
            self._cache[piece] = data[at:to]
            at = to

    def _plain(self, text: str) -> bytes:
        return np.array(self._encoding.encode_ordinary(text), dtype=self._type).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        seen: set[str] = set()
        for text in texts:
            if _unsafe(text):
                split.append(None)
                continue
            pieces = text.split(" ")
            split.append(pieces)
            seen.update(pieces[1:])
        cache = self._cache
        if missing := seen.difference(cache):
            if len(cache) + len(missing) > self._limit:
                cache.clear()
                missing = seen
            self._learn(["", *missing])
        out = []
        for text, pieces in zip(texts, split, strict=True):
            if pieces is None:
                # blanks beside other white space: encode the stretches between safe cuts as they stand
                out.append(b"".join(map(self._plain, _SAFE_CUT.split(text) if len(text) > 100_000 else [text])))
            else:
                head = self._plain(pieces[0])
                pieces[0] = ""
                out.append(head + b"".join(map(cache.__getitem__, pieces)))
        return out
