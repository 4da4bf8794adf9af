"""Public BPE tokenizers over Arrow text batches, with a cache of chunks.

The pre-tokenizers of the two files never join text across white space, so a text is cut there first
and every distinct chunk is encoded once per worker by the ``tokenizers`` library; most of a text is
then a table lookup.  The ids are those of ``encode`` over the whole text.  With ``added_tokens`` the strings of the
file's added tokens in a text get those tokens' ids, as ``encode`` does by itself; without, they are ordinary text.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: The characters with the property White_Space, which the tokenizers' patterns call ``\s`` (fixed value).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: Letters, and ASCII signs but the apostrophe, between which both patterns always cut.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@[-`{-~"
_CUTS = f"[{_LETTERS}]+(?=[{_SIGNS}'{WHITE_SPACE}]|$)|[{_SIGNS}]+(?=[{_LETTERS}{WHITE_SPACE}]|$)|[^{WHITE_SPACE}]+"
#: Files with word ends drop white space; byte-level files keep it: a space goes with what follows, other runs stand alone.
_DROPPING = re.compile(_CUTS)
_KEEPING = re.compile(f" ?(?:{_CUTS})|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")

#: Chunks in a worker's cache, and the longest chunk that is kept there.
CACHE_CHUNKS, CACHE_CHARS = 250_000, 40


class ChunkEncoder(dict):
    """Ids of texts as the bytes of little-endian unsigned 32-bit integers.  It is itself the cache: a chunk that is not
    in it is encoded, and kept while there is room; frequent chunks come early."""

    def __init__(self, path: str, added_tokens: bool = False, chunks: int = CACHE_CHUNKS):
        super().__init__()
        self.chunks = chunks
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        added = self.tokenizer.get_added_tokens_decoder() if added_tokens else {}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError(f"{path} has added tokens that are not found by their exact string")
        self.added = {t.content: np.uint32(i).astype("<u4").tobytes() for i, t in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.fold = self.tokenizer.normalizer is not None
        self.pattern = _DROPPING if self.fold else _KEEPING
        self.model = self.tokenizer.model.tokenize
        self.one_word = re.compile(f" ?[{_LETTERS}]+").fullmatch if self.vocabulary_size <= len(_ID) else lambda chunk: None

    @property
    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not any(content in text for content in self.added):
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        parts = self.split(text)  # ordinary text and added tokens by turns
        parts[::2] = [b"".join(map(self.__getitem__, self.pattern.findall(part))) for part in parts[::2]]
        parts[1::2] = [self.added[content] for content in parts[1::2]]
        return b"".join(parts)

    def __missing__(self, chunk: str) -> bytes:
        """A chunk of letters only (and a space before them) is a single word for the model, so it skips the tokenizer's
        normaliser and pre-tokenizer, which leave such a word as it is but for its case."""
        if self.one_word(chunk):
            word = (chunk.lower() if self.fold else chunk).encode().decode("latin-1").translate(_BYTE_LEVEL)
            ids = b"".join([_ID[t.id] for t in self.model(word)])
        else:
            ids = np.array(self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids, "<u4").tobytes()
        if len(chunk) <= CACHE_CHARS and len(self) < self.chunks:
            self[chunk] = ids
        return ids


def byte_level() -> dict[int, str]:
    """Byte -> character of byte-level BPE: printable bytes stand for themselves, the others, in order, for 256 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_BYTE_LEVEL = byte_level()
_ID = [np.uint32(i).astype("<u4").tobytes() for i in range(1 << 16)]


_encoders: dict[tuple[str, bool, int], ChunkEncoder] = {}


def encoder(path: str, added_tokens: bool = False, chunks: int = CACHE_CHUNKS) -> ChunkEncoder:
    """The worker's encoder of a tokenizer file, with room for so many chunks; its path is the same on all machines."""
    key = (path, added_tokens, chunks)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(*key)
    return _encoders[key]
