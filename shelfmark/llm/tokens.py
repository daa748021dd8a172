"""Token ids of whole texts from a public tokenizer file, with words remembered.

A byte-level BPE with the usual pattern never joins text across a single space
or line break that has other characters on both sides, nor letters with the
marks behind them, so a text is cut there, pieces seen before are looked up,
and only new ones go through the tokenizers library. What is only letters is
one piece to its pattern as well and goes to its model directly. The ids are
those of the whole text. Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import string
import sys
import types

import numpy as np

GAP = re.compile(r"(?<=\S) (?=\S)")
# Every character that Python counts as white space, but for the space itself.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
MARKS = string.punctuation
LONGEST, GENERATION, KEPT = 48, 200_000, 50_000


def _pieces(text: str) -> list[str]:
    parts = text.split(" ")
    if "" in parts or any(
        c in text and (f" {c}" in text or f"{c} " in text) for c in OTHER_SPACE
    ):
        return GAP.split(text)
    return parts


def _byte_letters() -> str:
    """The character that stands for each byte in the vocabulary of a byte-level model."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = itertools.count(0x100)
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


def _letters(merge, codes: list[bytes]):
    """The ids of letters, by the library's model without the cutting before it."""
    table = _byte_letters()
    spaces = {"": "", " ": table[0x20]}

    def ids(before: str, text: str) -> bytes:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(table)
        return b"".join([codes[token.id] for token in merge(spaces[before] + text)])

    return ids


class Words(dict):
    """Ids of words as they read after a space, found out when they are first asked for.

    A key with a line break in front is a word that follows it. ``whole`` and ``letters`` give
    the ids of any text and of letters that the model never parts before it joins them.
    """

    def __init__(self, known: dict[str, bytes], whole, letters):
        super().__init__(known)
        self.whole, self.letters = whole, letters
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.long: dict[str, bytes] = {}  # the long ones, to forget

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is not None:
            if len(self) < GENERATION:  # it moves on, so that both hold no word twice
                self[word] = self.old.pop(word)
            return ids
        if (ids := self.long.get(word)) is None:
            if word.isalpha():
                ids = self.letters(" ", word)
            elif (body := word.rstrip(MARKS)).isalpha():
                # Letters and the marks behind them are never joined.
                seen = body in self or body in self.old
                ids = self[body] + self._tail(word[len(body):])
                if not seen:  # most such words never come again
                    return ids
            elif word[0] == "\n":
                if body[1:].isalpha():
                    ids = self._tail("\n") + self.letters("", body[1:]) + self._tail(word[len(body):])
                else:
                    ids = self.whole(word)
            elif "\n" in word and (lines := word.split("\n")) == word.split():
                # A line break between two other characters is joined with neither.
                return self[lines[0]] + b"".join([self["\n" + line] for line in lines[1:]])
            else:
                ids = self.whole(" " + word)
        if len(word) > LONGEST:
            self.long[word] = ids
            return ids
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _tail(self, marks: str) -> bytes:
        if (ids := self.tails.get(marks)) is None:
            ids = self.whole(marks) if marks else b""
            if len(marks) <= LONGEST and len(self.tails) < GENERATION:
                self.tails[marks] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian bytes, ``width`` bytes an id."""

    def __init__(self, path: str, known: dict[str, bytes] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        size = self.model.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 65_536 else "<u4")
        cut = self.model.pre_tokenizer
        self.cuts = (
            self.model.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel)
            and not cut.add_prefix_space and cut.use_regex
            and isinstance(self.model.model, models.BPE)
            and all(t.special for t in self.model.get_added_tokens_decoder().values())
        )
        codes = [n.to_bytes(self.dtype.itemsize, "little") for n in range(size)]
        self.words = Words(known or {}, self._whole, _letters(self.model.model.tokenize, codes))

    def _whole(self, text: str) -> bytes:
        ids = self.model.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; of a null text none."""
        if not self.cuts:
            return [self._whole(t) if t else b"" for t in texts]
        find, out = self.words.__getitem__, []
        for text in texts:
            parts = _pieces(text) if text else [""]
            head = self._whole(parts[0]) if parts[0] else b""
            del parts[:1]
            out.append(head + b"".join(map(find, parts)))
        self.words.long.clear()
        return out


@contextlib.contextmanager
def encoding(path: str):
    """An encoder for one task, with the words that the worker's last task met first.

    Functions reach workers by value, so what is to outlive a task is kept in
    a module of the worker's own: KEPT words, not the model and not all words,
    because idle workers share an executor with later stages.
    """
    kept = sys.modules.setdefault("kept_words", types.ModuleType("kept_words")).__dict__
    model = Encoder(path, kept.pop(path, None))
    try:
        yield model
    finally:
        words = model.words
        kept[path] = dict(itertools.islice(
            itertools.chain(words.items(), words.old.items()), KEPT))


def slices(texts: list, characters: int = 1_000_000):
    """Ranges of consecutive texts of together about ``characters``."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= characters:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
