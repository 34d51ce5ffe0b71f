"""Token ids of whole texts by the tokenizers library, with a bounded cache of its pieces.

A vocabulary file of the ``word_bpe`` kind lower-cases a text, cuts it into
pieces by a pattern and runs byte-pair merges inside each piece. No piece holds
white space, so texts of Latin-1 characters are cut here at white space; each
new chunk is cut into pieces by the file's own pattern, and the library's model
turns each new piece into ids once. All other texts, and all texts for files of
another kind, go to the library whole.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata

import numpy as np

VOCABULARY = "word_bpe_49k.json"
CACHED_PIECES = 1_200_000
CACHED_LENGTH = 64
# White space or marks on which the library and Python's patterns may differ, and the start of special tokens.
_UNSURE = ("\x00", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "<|")


def byte_alphabet() -> dict[int, str]:
    """Byte -> visible character: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def latin_pattern(pattern: str) -> re.Pattern:
    """The pattern with its letter and number classes written out for lower-case Latin-1 text."""
    for kind in "LN":
        chars = "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
        pattern = pattern.replace(f"\\p{{{kind}}}", chars)
    return re.compile(pattern)


class Cache(dict):
    """Text without white space -> its ids, made by ``make`` where they are missing; emptied when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        found = self.make(text)
        if len(text) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[text] = found
        return found


class Encoder:
    """``ids(text)``: the ids as bytes, four little-endian ones for each, without special tokens of its own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache = Cache(self._chunk)
        self.alphabet = byte_alphabet()
        self.pieces = self._piece_pattern(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _piece_pattern(spec: dict) -> re.Pattern | None:
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
            and (cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == (False, False)
            and spec["post_processor"] is None
        )
        return latin_pattern(cuts[0]["pattern"]["Regex"]) if known else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()
        shown = piece if plain else "".join([self.alphabet[b] for b in piece.encode()])
        found = self.tokenizer.model.tokenize(shown)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def ids(self, text: str) -> bytes:
        if self.pieces is None or any(mark in text for mark in _UNSURE):
            return self.whole(text)
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.whole(text)
        return b"".join(map(self.cache.__getitem__, text.lower().split()))

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.pieces.findall(chunk)
        return self._piece(chunk) if pieces == [chunk] else b"".join([self.cache[p] for p in pieces])

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its token ends a sentence: its last character is a full stop or the like."""
        flags = np.zeros(self.size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            flags[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
        return flags


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The task's encoder: one for each file and Python worker."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
