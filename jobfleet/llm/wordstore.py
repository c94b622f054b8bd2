"""Texts as concatenations of remembered words: what is known of a word is looked up, not redone."""

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
import sys
from types import ModuleType

import numpy as np

#: Characters of text that go together; one longer text is a batch of its own.
BATCH_CHARS = 1 << 19


def per_process(key: tuple, make: Callable):
    """An object that a Python worker process makes once and keeps from task to task."""
    kept = sys.modules.setdefault("_llm_kept", ModuleType("_llm_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def grouped(texts: Iterable[str], most: int = BATCH_CHARS) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


class WordStore:
    """Encodes texts whose encoding is the concatenation of their words' encodings.

    At most ``most`` words are remembered, beyond those of one batch; when the store is full, the
    half that was used most stays.
    """

    #: Characters of text that are encoded at once.
    at_once = BATCH_CHARS

    def __init__(self, split: Callable[[str], list[str]], ids_of: Callable[[list[str]], list[list[int]]], most: int):
        self.split, self.ids_of, self.most = split, ids_of, most
        self.codes: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 12, np.int64)
        self.uses = np.zeros(1 << 12, np.int32)

    def _ids_of_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words, one word after the other, and how many each has."""
        encoded = self.ids_of(words)
        return np.array([i for ids in encoded for i in ids], np.uint32), np.array([len(ids) for ids in encoded], np.int64)

    def _learn(self, words: list[str]) -> None:
        flat, lengths = self._ids_of_new(words)
        first, start = len(self.codes), int(self.bounds[len(self.codes)])
        while len(self.ids) < start + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.bounds) <= first + len(words):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.ids[start : start + len(flat)] = flat
        self.bounds[first + 1 : first + 1 + len(words)] = start + np.cumsum(lengths)
        self.uses[first : first + len(words)] = 0
        self.codes.update(zip(words, range(first, first + len(words)), strict=True))

    def _forget(self) -> None:
        """Keep the words used most, and halve their counts."""
        stay = np.sort(np.argsort(-self.uses[: len(self.codes)], kind="stable")[: self.most // 2])
        lengths = self.bounds[stay + 1] - self.bounds[stay]
        flat = self._gather(stay)
        words = list(self.codes)  # in the order of their codes
        self.codes = {words[old]: new for new, old in enumerate(stay.tolist())}
        self.uses[: len(stay)] = self.uses[stay] // 2
        self.ids[: len(flat)] = flat
        self.bounds[: len(stay) + 1] = np.concatenate([[0], np.cumsum(lengths)])

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        starts = self.bounds[codes]
        return self.ids[runs(starts, self.bounds[codes + 1] - starts)]

    def _look_up(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ids for some in grouped(texts, self.at_once) for ids in self._encode(some)]

    def _codes_of(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The codes of all words, and where each text's end."""
        words, ends = [], []
        for text in texts:
            words += self.split(text)
            ends.append(len(words))
        codes = self._look_up(words)
        unknown = np.nonzero(codes < 0)[0]
        if len(unknown):
            new = list(dict.fromkeys(words[i] for i in unknown.tolist()))
            if len(self.codes) + len(new) > self.most and self.codes:
                self._forget()
                codes = self._look_up(words)
                unknown = np.nonzero(codes < 0)[0]
                new = list(dict.fromkeys(words[i] for i in unknown.tolist()))
            self._learn(new)
            codes[unknown] = [self.codes[words[i]] for i in unknown.tolist()]
        if len(codes):
            counts = np.bincount(codes)
            self.uses[: len(counts)] += counts.astype(np.int32)
        return codes, ends

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        codes, ends = self._codes_of(texts)
        ids = self._gather(codes)
        sizes = np.concatenate([[0], np.cumsum(self.bounds[codes + 1] - self.bounds[codes])])
        return np.split(ids, sizes[ends[:-1]]) if texts else []
