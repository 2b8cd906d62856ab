"""Token ids through ``tokenizers`` at the speed of a dictionary.

A word-level BPE whose pre-tokenizer never reaches across white space gives a text the ids of its white-space
chunks, one after the other.  Chunks repeat, so each worker keeps a bounded table from chunk to packed ids and a
second one from pre-token to packed ids: "Word", "word." and "WORD!!" share the entry of "word".  What the short way
does not cover for certain (anything outside ASCII and Latin-1 letters) goes through ``Tokenizer.encode`` itself, and
``tests/llm/test_llm.py`` compares both on whole texts.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex
from tokenizers import Tokenizer

#: Entries of either table; beyond them a chunk is encoded anew each time, so memory stays bounded.
TABLE_ENTRIES = 250_000

#: Chunks for which lower-casing and NFC act on each character alone: printable ASCII and Latin-1 from U+00A1 on.
_PLAIN = re.compile(r"[!-~\xa1-\xff]+")

#: ASCII marks: neither letters nor digits nor white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def default_path() -> str:
    """Where the public word BPE lies; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE puts in place of each byte: a printable byte stands for itself and the
    others take the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class _Pieces(dict):
    """Pre-token to packed ids, by the model of the tokenizer alone."""

    def __init__(self, tokenizer: Tokenizer, kind: np.dtype):
        super().__init__()
        self.model, self.letters = tokenizer.model, _byte_letters()
        self.packed = [np.array(i, kind).tobytes() for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        ids = b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])
        if len(self) < TABLE_ENTRIES:
            self[piece] = ids
        return ids


class ChunkIds(dict):
    """UTF-8 chunk without ASCII white space to its packed little-endian ids."""

    def __init__(self, path: str, kind: str = "<u4"):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype(kind)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        kinds = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in (said.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.by_chunk = kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["invert"]
        if self.by_chunk:
            self.pieces = _Pieces(self.tokenizer, self.kind)
            self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not _PLAIN.fullmatch(text):
            ids = self._encoded(text)
        elif (word := (low := text.lower()).rstrip(_MARKS)).isalpha():  # letters, then at most one run of marks
            ids = self.pieces[word] if len(word) == len(low) else self.pieces[word] + self.pieces[low[len(word) :]]
        else:
            ids = b"".join(map(self.pieces.__getitem__, self.split(low)))
        if len(self) < TABLE_ENTRIES:
            self[chunk] = ids
        return ids

    def of(self, text: bytes | None) -> bytes:
        """Packed ids of a whole UTF-8 text; of a null or empty one, none."""
        if not text:
            return b""
        if self.by_chunk:
            return b"".join(map(self.__getitem__, text.split()))
        return self._encoded(text.decode())


@functools.cache
def chunk_ids(path: str, kind: str = "<u4") -> ChunkIds:
    """One table for each worker process, tokenizer and id width."""
    return ChunkIds(path, kind)
