"""Ids and counts of single pre-tokens for byte-level BPE vocabularies.

The file of a public tokenizer holds its merges in order.  ``PieceEncoder``
hands the same merges to a faster merge loop for pre-tokens made of ASCII and
precomposed Latin letters, digits and signs; everything else goes through the
tokenizers library.  Both give the same ids (tests compare them).
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

#: Letters that the short patterns know: ASCII and precomposed Latin.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Anything else calls for the library.
OTHER = re.compile(f"[^\x00-\x7f{LATIN}]")


def resolve(name: str) -> str:
    """An absolute path as it is; any other name through ``public_tokenizers.path`` on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The usual printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PieceEncoder:
    """Encodes one pre-token at a time; ``tail`` is the vocabulary's end-of-word mark, if it has one."""

    def __init__(self, name: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        path = resolve(name)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tail = model.get("end_of_word_suffix") or ""
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        letters, vocab = byte_letters(), model["vocab"]

        def raw(piece: str) -> bytes:
            ends = bool(self.tail) and piece.endswith(self.tail)
            body = piece[: -len(self.tail)] if ends else piece
            return bytes(letters[c] for c in body) + b"\xff" * ends

        # 0xFF never occurs in UTF-8, so it can stand for the end of a word
        pieces = [(bytes([b]), vocab.get(c)) for c, b in sorted(letters.items(), key=lambda x: x[1])]
        if self.tail:
            pieces += [(bytes([b, 255]), vocab.get(c + self.tail)) for c, b in letters.items()]
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pieces.append((raw(left + right), vocab[left + right]))
        ranks: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        for piece, number in pieces:
            if piece not in ranks:
                ranks[piece] = len(ranks)
                self.ids.append(number)
        self._engine = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        self._piece = self._engine._encode_single_piece
        self._mark = b"\xff" if self.tail else b""

    def count(self, piece: str) -> int:
        """Number of tokens of a pre-token that needs no normalising."""
        return len(self._piece(piece.encode() + self._mark))

    def piece(self, piece: str) -> bytes:
        """Ids of a pre-token that needs no normalising, as little-endian unsigned 32-bit integers."""
        pack = self.packed
        return b"".join([pack[i] for i in self._piece(piece.encode() + self._mark)])

    @cached_property
    def packed(self) -> list[bytes]:
        return [(i or 0).to_bytes(4, "little") for i in self.ids]

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids
