"""Encoding whole texts with a public word-level vocabulary, through a table of white-space chunks.

The vocabulary's pre-tokenizer never joins characters across white space, so a
text's ids are the ids of its chunks in order; chunks repeat, so most are looked
up. What a chunk misses is encoded by the tokenizers library itself.
"""

from __future__ import annotations

import string
import struct
from functools import cache
from unicodedata import is_normalized

from emberline.llm.common import CACHE_ENTRIES

VOCABULARY = "word_bpe_49k.json"
MARKS = string.punctuation.encode()


class ChunkIds(dict):
    """White-space chunk -> its ids as little-endian unsigned 32-bit bytes.

    Plain words of Latin letters go to the vocabulary's merge model directly, after
    the normalizer's steps, which for them are lower case only; every other chunk
    goes through the whole tokenizer. The table is bounded: once it is full it becomes
    the older generation, from which repeated chunks are taken over.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [chr(c) for c in range(0x80, 0x250) if chr(c).isalpha() and is_normalized("NFC", chr(c)) and chr(c).lower() == chr(c)]
        self.shown = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in latin}
        self.plain = frozenset("abcdefghijklmnopqrstuvwxyz") | frozenset(latin)

    def _encode(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        word = text
        if text[:1].isupper() and len(text[0].lower()) == 1:
            word = text[0].lower() + text[1:]
        if self.plain.issuperset(word):
            ids = [token.id for token in self.model.tokenize(word if chunk.isascii() else word.translate(self.shown))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        value = self.older.get(chunk)
        if value is None:
            head = chunk.rstrip(MARKS)
            if head and len(head) < len(chunk) and head.decode("utf-8", "replace").isalpha():
                # letters and the marks after them are separate pieces for the pre-tokenizer
                value = self[head] + self[chunk[len(head):]]
            else:
                value = self._encode(chunk)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[chunk] = value
        return value


@cache
def chunk_ids(vocabulary: str) -> ChunkIds:
    import public_tokenizers

    return ChunkIds(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def encoded(text: bytes, table: ChunkIds) -> bytes:
    """The ids of a whole text, four bytes each."""
    return b"".join(map(table.__getitem__, text.split()))
