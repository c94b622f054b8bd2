"""SentencePiece encoding and decoding as weighted transducers.

Compiled once per model: the normaliser (the model's rules, of which the longest that fits a place is
taken, from left to right; runs of spaces made one and outer ones left out where the model asks for it; a space
written as the mark U+2581, a mark put before the text), the lexicon transducer (a trie from characters to pieces), byte fallback arcs
for characters that are no piece, and, for merge-based models, an acceptor over adjacent pieces.
Composing them with an input gives a lattice over its positions; the encoding is the shortest path
in the tropical semiring.

* Unigram models: an arc weighs minus the piece's score.
* Merge-based models: an arc weighs nothing. The acceptor lets piece b follow piece a just when
  the merges of the string ab give a, b. A sequence of pieces is what the merges of a text give
  if and only if all its neighbours are accepted, so every position of the lattice is reached by
  exactly one path, and that path is the model's encoding. Pieces that their own merges do
  not give are left out of the lexicon. Acceptor states are made as inputs need them.

Decoding is the inverse: pieces to characters, runs of byte pieces to UTF-8.

No piece holds a mark after another character, or a line feed (checked when the model is
compiled), so texts are composed marked word by marked word and words are remembered.

Defined results: null and empty texts, and those of which the normaliser leaves nothing, give no ids and decode to the
empty text; texts are encoded whole; equally good paths are settled as the model's library does; repeated rows are encoded each; an empty table gives an empty result; all columns
are kept, and columns named like the results are replaced.
"""

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobfleet.llm.wordstore import WordStore, grouped, per_process

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000
CACHE_PAIRS = 1_000_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNKNOWN_TEXT = " ⁇ "
_SPACES = re.compile(" +")


@dataclass
class Model:
    """What is compiled from a model file; its size is that of the vocabulary."""

    kind: int
    pieces: list[str]
    types: list[int]
    scores: list[float]
    dummy_prefix: bool
    rules: tuple[tuple[str, str], ...] = ()
    squeeze: bool = False


def load(model_file: str) -> Model:
    from sentencepiece import SentencePieceNormalizer, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as file:
        proto.ParseFromString(file.read())
    spec = proto.normalizer_spec
    if not spec.escape_whitespaces:
        raise ValueError("only normalisers with escaped spaces are compiled")
    rules = SentencePieceNormalizer(model_file=model_file).decompile() if spec.precompiled_charsmap else ()
    if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only unigram and merge-based models with leading marks are compiled")
    if any(p.type == USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces are not compiled")
    if any(p.type == NORMAL and (MARK in p.piece.lstrip(MARK) or "\n" in p.piece) for p in proto.pieces):
        raise ValueError("a piece crosses words")
    return Model(
        proto.trainer_spec.model_type,
        [p.piece for p in proto.pieces],
        [p.type for p in proto.pieces],
        [p.score for p in proto.pieces],
        spec.add_dummy_prefix,
        tuple(rules),
        spec.remove_extra_whitespaces,
    )


class Normaliser:
    """Rewrites texts by rules (from, to); ``squeeze`` makes runs of spaces one and leaves out outer ones."""

    def __init__(self, rules: Iterable[tuple[str, str]], squeeze: bool):
        self.rules, self.squeeze = dict(rules), squeeze
        self.reach: dict[str, int] = {}
        alone, first, second = set(), set(), set()
        for source in self.rules:
            self.reach[source[0]] = max(len(source), self.reach.get(source[0], 0))
            if len(source) == 1:
                alone.add(source)
            else:
                first.add(source[0])
                second.add(source[1])
        among = lambda found: "[" + "".join(map(re.escape, sorted(found))) + "]" if found else "(?!)"
        #: Where a rule may begin; most places of most texts are none.
        self.begins = re.compile(f"{among(alone)}|{among(first)}(?={among(second)})")

    def steps(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of the rewritten text, and whether a part was made by one rule."""
        at = 0
        while (found := self.begins.search(text, at)) is not None:
            start = found.start()
            for n in range(min(self.reach[text[start]], len(text) - start), 0, -1):
                made = self.rules.get(text[start : start + n])
                if made is not None:
                    yield text[at:start], False
                    yield made, True
                    at = start + n
                    break
            else:
                yield text[at : start + 1], False
                at = start + 1
        yield text[at:], False

    def __call__(self, text: str) -> str:
        """The rewritten text, where spaces stand for marks."""
        if not self.squeeze:
            return ("".join(part for part, _ in self.steps(text)) if self.rules else text).replace(MARK, " ")
        out, after_space = [], True
        for part, by_rule in self.steps(text):
            if not by_rule:
                part = _SPACES.sub(" ", part)
            if after_space:
                part = part.lstrip(" ")
            if part:
                out.append(part)
                after_space = part.endswith(" ")
        return "".join(out).replace(MARK, " ").rstrip(" ")


class Codec:
    """The composed transducers of one model; made once per task."""

    def __init__(self, model: Model):
        self.model = model
        self.normal = Normaliser(model.rules, model.squeeze)
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == NORMAL}
        self.unknown_id = model.types.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}
        self.bytes = {i: bytes([b]) for b, i in self.byte_ids.items()}
        as_text = {NORMAL: lambda p: p.replace(MARK, " "), UNKNOWN: lambda p: UNKNOWN_TEXT, BYTE: lambda p: chr(int(p[3:5], 16))}
        self.text_of = [as_text.get(t, lambda p: "")(p) for p, t in zip(model.pieces, model.types, strict=True)]
        #: Byte pieces that are only part of a character; those below 128 are one by themselves.
        self.high_byte = np.array([i in self.bytes and self.bytes[i] >= b"\x80" for i in range(len(model.pieces))])
        self.score = {p: model.scores[i] for p, i in self.ids.items()}
        self.unknown_weight = UNKNOWN_PENALTY - min(self.score.values(), default=0.0)
        #: Acceptor states by number: pieces first, then characters that are no piece as inputs bring them.
        self.states, self.others = list(model.pieces), {}
        self.pairs: dict[int, bool] = {}
        self.trie: dict = {}
        self.lexicon = {p: i for p, i in self.ids.items() if model.kind != BPE or len(p) == 1 or self.merged(p) == [p]}
        #: By the last three characters of a piece, the lengths of such pieces from the longest on.
        self.lengths = self._lengths()
        for piece in self.lexicon:
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, [{}, None])[0]
            node.setdefault(piece[-1], [{}, None])[1] = piece
        self.store = WordStore(re.compile(r" *[^ \n]+| +|\n").findall, self.words, CACHE_WORDS)

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored, then leftmost, neighbours until none makes a piece."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = max((s for s in joined if s is not None), default=None)
            if best is None:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _lengths(self) -> dict[str, tuple[int, ...]]:
        lengths: dict[str, set[int]] = {}
        for piece in self.lexicon:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], {2, 1}).add(len(piece))
        return {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}

    def accepts(self, left: int, right: int) -> bool:
        """Whether the merges of two states' text give just these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            a, b = self.states[left], self.states[right]
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def other(self, character: str) -> int:
        """The state of a character that is no piece."""
        state = self.others.get(character)
        if state is None:
            state = self.others[character] = len(self.states)
            self.states.append(character)
        return state

    def accepted(self, words: list[str]) -> list[list[str]]:
        """For each word the pieces on the one path through its lattice that the acceptor lets pass.

        All arcs weigh the same and every position is reached by one path, so the arcs into a position are
        tried from the longest on, and the first one that may follow the path to its start is it. What
        reaches a position depends on the text before it alone: words are taken in sorted order, and each
        one goes on from what it has in common with the word before.
        """
        lexicon, known, lengths = self.lexicon.get, self.pairs.get, self.lengths.get
        states, starts, last = [0], [0], ""
        paths: list[list[str]] = [[]] * len(words)
        for place in sorted(range(len(words)), key=words.__getitem__):
            text, same = words[place], 0
            for x, y in zip(text, last):
                if x != y:
                    break
                same += 1
            del states[same + 1 :], starts[same + 1 :]
            last = text
            for to in range(same + 1, len(text) + 1):
                for n in lengths(text[to - 3 : to], (2, 1)) if to > 2 else (2, 1):
                    at = to - n
                    if at < 0:
                        continue
                    state = lexicon(text[at:to])
                    if state is None:
                        if n > 1:
                            continue
                        state = self.other(text[at])
                    if at:
                        verdict = known(states[at] << 32 | state)
                        if not (self.accepts(states[at], state) if verdict is None else verdict):
                            continue
                    states.append(state)
                    starts.append(at)
                    break
            path, at = [], len(text)
            while at:
                path.append(self.states[states[at]])
                at = starts[at]
            paths[place] = path[::-1]
        return paths

    def shortest(self, text: str) -> list[str]:
        """The pieces on the path of least weight."""
        end = len(text)
        weight: list[float | None] = [None] * (end + 1)
        back: list[tuple[int, str]] = [(0, "")] * (end + 1)
        weight[0] = 0.0
        for at in range(end):
            if weight[at] is None:
                continue
            node, arcs = self.trie, []
            for to in range(at, end):
                step = node.get(text[to])
                if step is None:
                    break
                node, piece = step
                if piece is not None:
                    arcs.append((to + 1, piece, -self.score[piece]))
            if text[at] not in self.ids:
                arcs.append((at + 1, text[at], self.unknown_weight))
            for to, piece, cost in arcs:
                total = weight[at] + cost
                if weight[to] is None or total < weight[to]:
                    weight[to], back[to] = total, (at, piece)
        path, at = [], end
        while at:
            at, piece = back[at]
            path.append(piece)
        return path[::-1]

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words, by the shortest paths through their lattices."""
        words = [w.replace(" ", MARK) for w in words]
        paths = self.accepted(words) if self.model.kind == BPE else map(self.shortest, words)
        return [self.ids_of(path) for path in paths]

    def ids_of(self, path: list[str]) -> list[int]:
        out: list[int] = []
        for piece in path:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown_id:
                out.append(self.unknown_id)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        prefix = " " if self.model.dummy_prefix else ""
        ready = [(t, self.normal(t)) for t in texts]
        return self.store.encode([prefix + made if made or (t and not self.model.squeeze) else "" for t, made in ready])

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if self.high_byte[ids].any():
            out, run = [], b""
            for i in ids.tolist():
                if self.high_byte[i]:
                    run += self.bytes[i]
                else:
                    out.append(run.decode("utf-8", "replace") + self.text_of[i])
                    run = b""
            text = "".join(out) + run.decode("utf-8", "replace")
        else:
            text = "".join(map(self.text_of.__getitem__, ids.tolist()))
        cut = 0  # the mark before the text, or, where outer spaces are left out, that of each piece up to the first character
        for i in ids.tolist() if self.model.dummy_prefix or self.model.squeeze else ():
            if self.model.types[i] == CONTROL:
                continue
            marked = self.model.types[i] == NORMAL and self.model.pieces[i].startswith(MARK)
            cut += marked
            if not (marked and self.model.squeeze and self.model.pieces[i] == MARK):
                break
        return text[cut:]


def encode(documents: DataFrame, model_file: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """``documents`` with the column ``ids`` (array of int), and their text decoded again if a column for it is named."""
    held = documents.sparkSession.sparkContext.broadcast(astuple(load(model_file)))
    if decoded in (text, "ids"):
        raise ValueError("the decoded text needs a column of its own")
    rest = documents.drop("ids", *([] if decoded is None else [decoded]))
    place = rest.columns.index(text)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_process(("sp_codec", model_file), lambda: Codec(Model(*held.value)))
        for batch in batches:
            texts, at = (x.as_py() or "" for x in batch.column(place)), 0
            for some in grouped(texts):  # a batch goes out in parts of bounded size
                ids = codec.encode(some)
                offsets = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids).astype(np.int32)
                part = batch.slice(at, len(some))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                made = {"ids": lists}
                if decoded is not None:
                    made[decoded] = pa.array([codec.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *made.values()], [*batch.schema.names, *made])
                at += len(some)

    schema = T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded is not None:
        schema = schema.add(decoded, T.StringType())
    return rest.mapInArrow(encoded, schema)


def decode(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``; null ids decode to the empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(astuple(load(model_file)))

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = per_process(("sp_codec", model_file), lambda: Codec(Model(*held.value)))
        for batch in batches:
            yield pd.Series(["" if x is None else codec.decode(x) for x in batch], dtype=object)

    return encoded.withColumn("decoded", decoded(F.col(ids)))


def round_trip(documents: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``documents`` with n_pieces, n_byte_pieces, ids_crc32 and decodes (the normalised text came back), in one pass.

    The mark U+2581 comes back as a space, as the model has it.
    """
    held = documents.sparkSession.sparkContext.broadcast(astuple(load(model_file)))

    @F.pandas_udf("n_pieces long, n_byte_pieces long, ids_crc32 long, decodes boolean")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zlib

        codec = per_process(("sp_codec", model_file), lambda: Codec(Model(*held.value)))
        is_byte = np.array([t == BYTE for t in codec.model.types])
        for batch in batches:
            rows = []
            for part in grouped(batch.fillna("")):
                for whole, ids in zip(part, codec.encode(part), strict=True):
                    same = codec.decode(ids) == codec.normal(whole)
                    rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), same))
            yield pd.DataFrame(rows, columns=["n_pieces", "n_byte_pieces", "ids_crc32", "decodes"])

    names = ["n_pieces", "n_byte_pieces", "ids_crc32", "decodes"]
    out = documents.drop(*names).withColumn("_digest", digest(F.col(text)))
    return out.select("*", "_digest.*").drop("_digest")
