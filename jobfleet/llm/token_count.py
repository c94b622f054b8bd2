"""Token counts by a Viterbi search that carries counts only.

An Aho-Corasick automaton enumerates the matches of a unigram vocabulary; per end position the
search keeps the best score and the number of pieces on that path, and no path. The rules of the
exact tokenizer: scores are summed in double precision; candidates for an end position are taken
by ascending start and only a strictly better one replaces; a character that is no piece itself
costs ``UNKNOWN_PENALTY`` below the least score and counts as its UTF-8 bytes (byte fallback) or
as one per run. A space is written as the mark U+2581 and a mark is put before the text.

No piece holds a mark after another character (checked when the vocabulary is built; if one does,
texts are searched whole), nor a line feed, so a text's best path is that of its marked words put
together and the counts of words are remembered.

The only public vocabulary with scores here belongs to a merge-based model; its pieces and
scores are used as a unigram vocabulary.

Defined results: null and empty texts have 0 tokens; texts are read whole; repeated rows are
counted each; an empty table gives an empty result; all columns are kept, and a column
``n_tokens`` is replaced.
"""

from collections.abc import Iterable, Iterator
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfleet.llm.wordstore import per_process

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 300_000
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


def vocabulary(model_file: str) -> tuple[list[tuple[str, float]], bool]:
    """The pieces that can stand in a text with their scores, and whether bytes stand in for the rest."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as file:
        model.ParseFromString(file.read())
    pieces = [(p.piece, p.score) for p in model.pieces if p.type in (NORMAL, USER_DEFINED)]
    return pieces, any(p.type == BYTE for p in model.pieces)


class Counter:
    """Counts tokens of texts; made once per task."""

    def __init__(self, pieces: Iterable[tuple[str, float]], byte_fallback: bool, most: int = CACHE_WORDS):
        import ahocorasick

        pieces = list(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback, self.most = byte_fallback, most
        crossing = any(MARK in p.lstrip(MARK) or "\n" in p for p, _ in pieces)
        known_mark = any(p == MARK for p, _ in pieces)
        # without bytes a run of unknown characters is one piece, so only a known mark ends it
        word = r" *[^ \n]+| +|\n+" if byte_fallback else r" *[^ ]+| +"
        self.cut = None if crossing or not (byte_fallback or known_mark) else re.compile(word).findall
        self.seen: dict[str, int] = {}

    def search(self, text: str) -> int:
        """Pieces on the best path of an already marked text."""
        end = len(text)
        score: list[float | None] = [None] * (end + 1)
        count, unknown_last = [0] * (end + 1), [False] * (end + 1)
        score[0] = 0.0
        matches: list[list[tuple[int, float]]] = [[] for _ in range(end)]
        for last, found in self.automaton.iter(text):
            matches[last].append(found)  # longest first: ascending start
        for at in range(1, end + 1):
            best, pieces, single = None, 0, False
            for length, value in matches[at - 1]:
                single |= length == 1
                total = score[at - length] + value
                if best is None or total > best:
                    best, pieces = total, count[at - length] + 1
            if not single:
                total = score[at - 1] + self.unknown
                if best is None or total > best:
                    best, unknown_last[at] = total, True
                    if self.byte_fallback:
                        pieces = count[at - 1] + len(text[at - 1].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = count[at - 1] + (not unknown_last[at - 1])
            score[at], count[at] = best, pieces
        return count[end]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = " " + text.replace(MARK, " ")
        if self.cut is None:
            return self.search(text.replace(" ", MARK))
        total, seen = 0, self.seen
        for word in self.cut(text):
            n = seen.get(word)
            if n is None:
                n = seen[word] = self.search(word.replace(" ", MARK))
            total += n
        if len(seen) > self.most:
            seen.clear()
        return total


def count_tokens(documents: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``documents`` with ``n_tokens``."""
    pieces, byte_fallback = vocabulary(model_file)
    held = documents.sparkSession.sparkContext.broadcast((pieces, byte_fallback))  # the size of a vocabulary

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = per_process(("token_count", model_file), lambda: Counter(*held.value))
        for batch in batches:
            yield batch.map(counter.count, na_action=None).astype("int64")

    return documents.withColumn("n_tokens", counted(F.col(text)))
