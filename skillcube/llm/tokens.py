"""Token ids from a public tokenizer file, as bytes of little-endian unsigned integers.

Word-split BPE files (NFC, lower case, letters / digits / other runs apart, bytes as letters) get a faster way that
gives the same ids: no word reaches over white space, so each distinct run between white space is cut into words once
per process and each distinct word goes to the library's model once. Texts outside that way's alphabet, and any other kind
of file, go through the library whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array

import numpy as np

_TOKENIZERS: dict[str, "Encoder"] = {}

#: The split that the fast way reproduces, as it stands in the tokenizer's file.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]+|_+)+")
#: All but the code points for which Python's classes and the file's agree. Some digits are none for \d; the lower case
#: of U+0130 ends in a mark, which the library would put in order with those that follow.
_ODD = re.compile("[^\x00-ԯ]|[²³¹¼½¾İ]")
_SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space for Python only
RUN_CACHE = 600_000


def _letters_of_bytes() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _letters_of_bytes()


def encoder(path: str, runs: int = RUN_CACHE) -> "Encoder":
    """One per process and file; runs: how many runs of letters it keeps the ids of."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    _TOKENIZERS[path].most_runs = runs
    return _TOKENIZERS[path]


class Encoder:
    most_runs = RUN_CACHE

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.dtype = "<u2" if self.width == 2 else "<u4"
        self.runs: dict[str, bytes] = {}
        spec = json.load(open(path, encoding="utf-8"))
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.fast = kinds == ["NFC", "Replace", "Lowercase"] and (pre[0].get("pattern") or {}).get("Regex") == WORD_SPLIT and [p.get("type") for p in pre[1:]] == ["ByteLevel"]
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.model = self.tok.model

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(_LETTERS)
        ids = array("H" if self.width == 2 else "I", [t.id for t in self.model.tokenize(word)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _learn(self, runs) -> bool:
        """Caches the ids of runs; false if one has a character outside the alphabet."""
        known = self.runs
        if len(known) > self.most_runs:
            known.clear()
        for run in runs:
            if not run.isascii() and _ODD.search(run):
                return False
            out = []
            for word in _PIECES.findall(run):
                if word not in known:
                    known[word] = self._word(word)
                out.append(known[word])
            if len(out) != 1:
                known[run] = b"".join(out)
        return True

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text (null: none), `width` bytes each."""
        if not text:
            return b""
        if not self.fast or any(t in text for t in self.special) or any(c in text for c in _SEPARATORS):
            return self._whole(text)
        norm = unicodedata.normalize("NFC", text)
        try:
            norm.encode("latin-1")  # the quickest test of the alphabet's upper end
        except UnicodeEncodeError:
            if _ODD.search(norm):  # before the lower case hides it
                return self._whole(text)
            norm = norm.replace("Σ", "σ")  # the library has no rule for the last letter of a word
        runs, known = norm.lower().split(), self.runs
        try:
            return b"".join(map(known.__getitem__, runs))
        except KeyError:
            if not self._learn({r for r in runs if r not in known}):
                return self._whole(text)
            try:
                return b"".join(map(known.__getitem__, runs))
            except KeyError:  # the cache was emptied meanwhile
                return self._whole(text)
