"""Encoding with a tokenizers file on executors, equal to encoding each whole text with the library.

White space separates tokens in these files and is dropped. A text of plain characters (PLAIN: ASCII and the letters of Latin-1, all of them unchanged by
NFC) is lower-cased and cut here by the file's own pattern, and each distinct word goes through the file's BPE model once. In other texts the pieces
between blanks that aren't plain go through the library. Ids are remembered in memos that hold MEMO_BYTES together and end with the task; the encoder itself
stays with the worker.

The strings of the file's special tokens in a text are ordinary text (encode_special_tokens), as the tokenizer files' own README has it: a document can't
forge an end mark.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Bytes that the two memos hold together, about; an entry counts its key, its ids and ENTRY_BYTES of Python's own.
MEMO_BYTES = 80_000_000
ENTRY_BYTES = 180
MEMO_CHARS = 64

_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xc0-\xff¡¿«»“”‘’„–—…€]*")
#: The file's pattern over lower-cased plain text.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\t-\r\x20{_LETTERS}0-9]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level files: printable bytes are themselves, the others follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}


class _Memo(dict):
    held = 0

    def forget(self) -> None:
        self.clear()
        self.held = 0


class _Words(_Memo):
    """word -> ids (little-endian unsigned 32-bit) by the BPE model alone."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def __missing__(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(spelt)])
        if len(word) <= MEMO_CHARS:
            self[word] = ids
            self.held += ENTRY_BYTES + len(word) + len(ids)
        return ids


class _Pieces(_Memo):
    """piece without blanks -> ids by the library, or by the words of a plain piece."""

    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if self.encoder.plain(piece):
            ids = self.encoder.by_words(piece)
        else:
            ids = np.array(self.encoder.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
            self.held += ENTRY_BYTES + len(piece) + len(ids)
        return ids


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism; threads would only wait for each other
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        known = [x["type"] for x in steps[0]] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps[1]] == ["Split", "ByteLevel"]
        self.known = known and steps[1][0]["pattern"] == {"Regex": PATTERN}  # of any other file, every piece goes through the library
        self.words, self.pieces = _Words(self.tokenizer.model), _Pieces(self)

    def plain(self, text: str) -> bool:
        return self.known and PLAIN.fullmatch(text) is not None

    def by_words(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in WORDS.findall(text.lower())])

    def encode_one(self, text: str) -> bytes:
        if self.plain(text):
            return self.by_words(text)
        pieces = self.pieces
        return b"".join([pieces[p] for p in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if p])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; none for null."""
        out = []
        for text in texts:
            if self.words.held + self.pieces.held > MEMO_BYTES:
                self.forget()
            out.append(np.frombuffer(self.encode_one(text or ""), dtype="<u4"))
        return out


    def forget(self) -> None:
        self.words.forget()
        self.pieces.forget()


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """This worker's encoder. Tasks call forget() when they end."""
    return WordEncoder(path)
