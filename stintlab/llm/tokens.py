"""Token ids of texts with a public tokenizer file, reusing words that were encoded before."""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np

#: distinct words remembered by a worker before it starts afresh
REMEMBERED_WORDS = 800_000
#: words handed to the tokenizer in one call
CALL_WORDS = 2_000

_encoders: dict[str, "WordEncoder"] = {}


def vocabulary(name: str) -> str:
    """Path of a tokenizer file of the ``public_tokenizers`` package on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The tokenizers library's tokenizer of a file, one thread, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Remembered:
    """Ids of strings that were encoded before, end to end in one growing array."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.index: dict = {}
        self.starts = np.zeros(1024, np.int64)
        self.sizes = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.used = 0

    def _room(self, name: str, need: int) -> None:
        array = getattr(self, name)
        if len(array) < need:
            grown = np.zeros(max(need, 2 * len(array)), array.dtype)
            grown[:len(array)] = array
            setattr(self, name, grown)

    def keep(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember new keys and their ids (``sizes`` of them each, end to end)."""
        known = len(self.index)
        for name in ("starts", "sizes"):
            self._room(name, known + len(keys))
        self._room("flat", self.used + len(ids))
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[known:known + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[known:known + len(keys)] = sizes
        self.used += len(ids)
        self.index.update(zip(keys, range(known, known + len(keys))))

    def lookup(self, keys: list) -> tuple[np.ndarray, list[int]]:
        """Number of each key (-1 if new), and where the new ones are."""
        at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        return at, np.flatnonzero(at < 0).tolist()

    def joined(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered keys end to end and their ``len + 1`` bounds."""
        sizes = self.sizes[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(self.starts[at] - upto[:-1], sizes)
        where += np.arange(upto[-1])
        return self.flat[where], upto


# The steps that plain words go through in a tokenizer file of the kind handled below.
FOLDING = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: words of printable ASCII and Latin-1 letters: folding them is lower-casing, and the pattern needs no tables
NOT_PLAIN = re.compile("[^\\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_LETTER = "a-z\u00df-\u00f6\u00f8-\u00ff"
PLAIN_PIECES = re.compile(f"\\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9\\n]+")


def byte_letters() -> dict[int, str]:
    """The characters byte-level vocabularies write for each byte: bytes that are printable in Latin-1
    as themselves, the others in order as the characters from U+0100 on."""
    themselves = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in themselves]
    return {b: chr(b) for b in themselves} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class WordEncoder(Remembered):
    """Ids of UTF-8 texts for tokenizers that drop white space before their merges.

    For such a tokenizer no token and no special token crosses white space, so the ids of a text are
    the ids of its white-space separated words in a row. Each distinct word is encoded once and kept;
    the memory is bounded by starting afresh after ``REMEMBERED_WORDS`` words. If the file has the known
    folding and splitting steps, plain words are folded and split here and only their distinct pieces go
    to the file's merges, which spares the tokenizer's bookkeeping of character positions.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        split = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.known_steps = steps["normalizer"] == FOLDING and split == SPLITTING
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """The worker's encoder for a file: kept between the tasks of a worker."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def forget(self) -> None:
        super().forget()
        self.pieces = Remembered()
        self.pieces.keep(["\n"], np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _plain_ids(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, one a line (the last line ends too), and how many each word has."""
        found = PLAIN_PIECES.findall(lines.lower())
        at, missing = self.pieces.lookup(found)
        if missing:
            new = list(dict.fromkeys([found[i] for i in missing]))
            spelled = [p.encode().decode("latin-1").translate(self.letters) for p in new]
            coded = [[t.id for t in self.tokenizer.model.tokenize(p)] for p in spelled]
            self.pieces.keep(new, np.array([i for c in coded for i in c], np.int32), np.array([len(c) for c in coded], np.int64))
            at[missing] = [self.pieces.index[found[i]] for i in missing]
        ids, bounds = self.pieces.joined(at)
        return ids, np.diff(bounds[np.flatnonzero(at == 0)], prepend=0)

    def _learn(self, words: list[bytes]) -> None:
        lines = b"\n".join(words).decode()
        if self.known_steps and (NOT_PLAIN.search(lines) or any(s in lines for s in self.special)):
            texts = [w.decode() for w in words]
            plain = [not NOT_PLAIN.search(t) and not any(s in t for s in self.special) for t in texts]
            self._learn_all([w for w, ok in zip(words, plain) if not ok])
            words = [w for w, ok in zip(words, plain) if ok]
            lines = b"\n".join(words).decode()
        if not self.known_steps:
            self._learn_all(words)
        elif words:
            self.keep(words, *self._plain_ids(lines + "\n"))

    def _learn_all(self, words: list[bytes]) -> None:
        """Any words, by the whole tokenizer."""
        for at in range(0, len(words), CALL_WORDS):
            part = words[at:at + CALL_WORDS]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
            self.keep(part, np.array([i for c in coded for i in c], np.int32), np.array([len(c) for c in coded], np.int64))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end and the ``len + 1`` bounds of the texts."""
        words: list[bytes] = []
        ends = [0]
        for text in texts:
            words += text.split()
            ends.append(len(words))
        if len(self.index) > REMEMBERED_WORDS:
            self.forget()
        at, missing = self.lookup(words)
        if missing:
            self._learn(list(dict.fromkeys([words[i] for i in missing])))
            at[missing] = [self.index[words[i]] for i in missing]
        ids, bounds = self.joined(at)
        return ids, bounds[ends]
