"""Whole texts to token ids with the tokenizers library, remembering words per worker.

Both kinds of vocabulary cut a text at white space before they merge, so the ids of a text are
those of its chunks in order. A worker keeps the ids of chunks it has met; only new ones go to
the library. Texts in which the cut is not certain go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

from tilewright.llm.common import held_alone

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks and characters a worker remembers before it starts anew.
MEMO_CHUNKS = 700_000
MEMO_CHARS = 32_000_000
#: Characters turned into ids at a time.
SLICE_CHARS = 2_000_000
#: Below this code point all Unicode versions agree on letters, case and composition.
LATIN_END = "ɐ"
#: Marks that are a token group of their own after a letter; an apostrophe may not be.
ENDING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Python counts these as white space, the library does not.
UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f")


#: White space in runs, or other than a space or line end; then the plain split below is not certain.
RUNS = re.compile("[^\\S \n]|\\s\\s|\0")
#: The same for ASCII texts, which plain look-ups find much sooner.
ASCII_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f", "\0")
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def spaced_chunks(text: str) -> list[str]:
    """Words with the one space before them, and white space on its own."""
    if any(r in text for r in ASCII_RUNS) if text.isascii() else RUNS.search(text):
        return SPACED.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def bare_chunks(text: str) -> list[str]:
    """What is between spaces, tabs and line ends; empty chunks have no ids."""
    if "\t" in text or "\r" in text:
        text = text.replace("\t", " ").replace("\r", " ")
    return text.replace("\n", " ").split(" ")


class Memo(dict):
    """Chunk to number; the ids of a number lie in ``flat[start:start + length]``.

    A new chunk gets its number at once and waits until ``resolve``, which makes the ids of all
    waiting ones together: plain words go to the library as one text, of which each is one word.
    """

    def __init__(self, tokenizer, spaced: bool) -> None:
        super().__init__()
        self.tokenizer, self.spaced = tokenizer, spaced
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.chars = 0
        self.waiting: list[str] = []
        self.flat, self.start, self.length = array("i"), array("i"), array("i")
        self.uses = np.zeros(0, np.int64)

    def thin_out(self) -> None:
        """Forget chunks that were met once; all of them, if that leaves more than half."""
        often = np.flatnonzero(self.uses > 1)
        chunks = list(self)  # in the order of their numbers
        kept = [chunks[n] for n in often]
        if 2 * len(kept) > MEMO_CHUNKS or 2 * sum(map(len, kept)) > MEMO_CHARS:
            self.forget()
            return
        ids, ends = self.gather(often)
        sizes = np.diff(ends, prepend=0)
        self.forget()
        self.update(zip(kept, range(len(kept)), strict=True))
        self.chars = sum(map(len, kept))
        for held, values in ((self.flat, ids), (self.start, ends - sizes), (self.length, sizes)):
            held.frombytes(values.astype(np.int32).tobytes())

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.waiting.append(chunk)
        return n

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these chunks, and where each chunk's end."""
        self.resolve()
        # The views go before anything is added, which would move the memory under them.
        flat, start, length = (np.frombuffer(a, np.int32) if a else np.zeros(0, np.int32) for a in (self.flat, self.start, self.length))
        n = length[numbers]
        ends = np.cumsum(n, dtype=np.int64)
        return flat[np.repeat(start[numbers] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends

    def parted(self, chunk: str) -> tuple[str, str] | None:
        """A plain word (with the space before it) and the marks after it; None for other chunks."""
        head = chunk.rstrip(ENDING)
        core = head[1:] if self.spaced and head[:1] == " " else head
        if not core.isalpha() or not (core.isascii() or (max(core) < LATIN_END and "İ" not in core)):
            return None
        return (head if self.spaced else head.lower()), chunk[len(head) :]

    def resolve(self) -> None:
        """Ids of all waiting chunks: a word's and those of the marks after it."""
        waiting, self.waiting = self.waiting, []
        if not waiting:
            return
        known = len(self.start)
        new: dict[str, int] = {}  # words to encode, by their place in ``parts``
        odd: dict[str, int] = {"": 0}  # marks and other chunks, likewise, counted from the other end
        first, second = [], []
        for chunk in waiting:
            p = self.parted(chunk)
            if p is None:
                first.append(-1 - odd.setdefault(chunk, len(odd)))
                second.append(-1)
                continue
            head, tail = p
            n = self.get(head, known)
            if n < known:
                first.append(n)
            elif self.spaced and head[0] != " ":
                first.append(-1 - odd.setdefault(head, len(odd)))
            else:
                first.append(known + new.setdefault(head, len(new)))
            second.append(-1 - odd.setdefault(tail, len(odd)))
        # Words that have so far been met with marks only are kept as well.
        for head in new:
            if head not in self:
                self[head] = len(self)
                first.append(known + new[head])
                second.append(-1)
                self.chars += len(head)
        self.chars += sum(map(len, waiting))
        ids, counts = self._words(list(new))
        others = [np.array(self._alone(c) if c else (), np.int32) for c in odd]
        pool = np.concatenate([np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), ids, *others])
        length = np.concatenate([np.frombuffer(self.length, np.int32) if known else np.zeros(0, np.int32), counts, [len(o) for o in others]])
        start = np.concatenate([np.frombuffer(self.start, np.int32) if known else np.zeros(0, np.int32), len(self.flat) + np.cumsum(length[known:]) - length[known:]])
        # Places from the other end lie behind the words.
        both = np.array([first, second], np.int64).T.ravel()
        both = np.where(both < 0, known + len(counts) - 1 - both, both)
        n = length[both]
        ends = np.cumsum(n)
        made = pool[np.repeat(start[both] - (ends - n), n) + np.arange(ends[-1])].astype(np.int32)
        sizes = n.reshape(-1, 2).sum(axis=1)
        at = len(self.flat) + np.cumsum(sizes) - sizes
        del pool, start, length  # views end before the arrays grow
        self.flat.frombytes(made.tobytes())
        self.start.frombytes(at.astype(np.int32).tobytes())
        self.length.frombytes(sizes.astype(np.int32).tobytes())

    def _alone(self, chunk: str) -> Sequence[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _words(self, heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these plain words, and their number per word: one text, each word of which is one."""
        found = self.tokenizer.encode(("" if self.spaced else " ").join(heads), add_special_tokens=False)
        counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(heads))
        if len(counts) == len(heads) and counts.all():
            return np.array(found.ids, np.int32), counts
        parts = [np.array(self._alone(h), np.int32) for h in heads]
        return np.concatenate([*parts, np.zeros(0, np.int32)]), np.array([len(p) for p in parts], np.int64)


class Encoder:
    """Ids of whole texts; a null text is empty."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made["added_tokens"]]
        pre, norm = made["pre_tokenizer"] or {}, made["normalizer"]
        parts = pre.get("pretokenizers", [])
        self.memo, self.chunks = None, None
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            self.memo, self.chunks = Memo(self.tokenizer, True), spaced_chunks
        elif (
            [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
            and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        ):
            self.memo, self.chunks = Memo(self.tokenizer, False), bare_chunks

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """One array of ids per text, in order."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= SLICE_CHARS:
                yield from self._slice(held)
                held, size = [], 0
        yield from self._slice(held)

    def _slice(self, texts: list[str]) -> Iterator[np.ndarray]:
        memo = self.memo
        if memo is None:
            yield from map(self._whole, texts)
            return
        if len(memo) > MEMO_CHUNKS or memo.chars > MEMO_CHARS:
            memo.thin_out()
        sure = [not any(s in t for s in (*UNSURE, *self.special)) for t in texts]
        numbers = [
            np.fromiter(map(memo.__getitem__, found), np.int64, len(found))
            for found in (self.chunks(t) if ok else [] for t, ok in zip(texts, sure, strict=True))
        ]
        every = np.concatenate([*numbers, np.zeros(0, np.int64)])
        ids, ends = memo.gather(every)
        uses = np.bincount(every, minlength=len(memo))
        uses[: len(memo.uses)] += memo.uses
        memo.uses = uses
        chunk_ends = np.cumsum([len(x) for x in numbers], dtype=np.int64)
        stops = np.r_[0, ends][chunk_ends]
        begin = 0
        for text, ok, stop in zip(texts, sure, stops, strict=True):
            yield ids[begin:stop] if ok else self._whole(text)
            begin = stop


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return held_alone(Encoder, path)
