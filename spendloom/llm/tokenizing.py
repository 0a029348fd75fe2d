"""Whole-text token ids by the tokenizers library, with the ids of repeated words kept per worker.

Both vocabularies cut a text at white space before any merge, so a text's ids are the ids of its
white-space pieces in order. Only pieces not seen before go to the library; words repeat, so most
of a text is a dictionary lookup. Texts that hold an added token (<|endoftext|>) go to the library whole. ``tests/llm`` compares ids with those of the whole text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import public_tokenizers

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"

#: Unicode White_Space, the class that both files' own patterns call \s.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters without combining marks that stay one letter in lower case. A run of them before an ASCII sign
#: other than the apostrophe, or before an ASCII digit, ends a word in both files.
_LETTERS = "a-zA-Z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u024f"
_RUN = f"[{_LETTERS}]+(?=[!-&(-@\\[-`{{-~{_WS}]|$)"
#: word_bpe drops white space; byte_bpe joins one space to the word that follows it.
_PIECES = {
    WORD_BPE: re.compile(f"{_RUN}|[^{_WS}]+"),
    BYTE_BPE: re.compile(f" ?{_RUN}| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"),
}
#: Pieces of such letters, which need no normalising but lower case: the model takes them as they are.
_PLAIN = re.compile(f" ?[{_LETTERS}]+")
#: Pieces kept per worker, and the longest piece worth keeping; both only affect speed.
KEPT_PIECES = 500_000
KEPT_LENGTH = 40


def _byte_letters() -> dict[int, str]:
    """How byte-level models write each byte: visible ones as themselves, the others as the letters from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [byte for byte in range(256) if byte not in visible]
    return {byte: chr(byte) for byte in visible} | {byte: chr(256 + i) for i, byte in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class _Known(dict):
    """Ids of pieces, learnt when asked for; those met lately are kept, with those met before them."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn, self.older = learn, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.learn(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PieceIds:
    """Ids of texts as little-endian unsigned 32-bit bytes; remembers those of pieces."""

    def __init__(self, path: str, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # in any case: texts that hold no added token after all lose only speed
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.pieces = _PIECES[vocabulary]
        self.lower = vocabulary == WORD_BPE
        self.known = _Known(self._learn)

    def _learn(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return self._whole(piece)
        letters = (piece.lower() if self.lower else piece).encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each whole text, as bytes."""
        find, held, ids = self.pieces.findall, self.added.search, self.known.__getitem__
        return [self._whole(text) if held(text) else b"".join(map(ids, find(text))) for text in texts]


@lru_cache(maxsize=2)
def piece_ids(vocabulary: str, path: str | None = None) -> PieceIds:
    """The worker's encoder of one vocabulary; ``path`` overrides the installed file."""
    return PieceIds(path or public_tokenizers.path(vocabulary), vocabulary)
