"""Token-id files of directly addressable codes.

An id is split into chunks, low bits first. Level k holds chunk k of every id that has one, packed
at the level's width, with one continuation bit per entry that says whether the id goes on at the
next level; a rank directory counts the continuation bits before each block of ``RANK_BLOCK``
entries. Entry i of a level is found by its position, its place on the next level by rank, so any
token is read in a handful of byte ranges without decoding a block. Each segment of at most
``SEGMENT`` ids chooses the widths that make it smallest, from its counts of bit lengths.

Documents are dealt out by ranges of doc_id and sorted; task p writes file p, first under a name
of its own and then moved to its place. A repeated attempt writes the same bytes, so it leaves a whole file that
stands there, and replaces a cut one. A manifest table (one row per file) is the only thing that is gathered.
The folder is resolved as Spark resolves it, so one without a scheme is on the default file system.

File: segments, then a JSON directory with the byte ranges of all parts and the documents' ids and
token offsets (as two int64 arrays), then the directory's length (8 bytes) and ``MAGIC``.

Defined results: null and empty texts hold the end id alone; a null doc_id sorts first and stays
null; rows with equal doc_id are ordered by a hash of their text; an empty table makes no file
and no row; texts are encoded whole; extra columns are ignored.
"""

from collections.abc import Iterator
from itertools import islice
import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobfleet.llm.common import columns_of, qualified, scratch, tasks_for
from jobfleet.llm.wordstore import WordStore, grouped, per_process, runs

MAGIC = b"DACIDS01"
SEGMENT = 1 << 19
RANK_BLOCK = 512
MAX_LEVELS = 4
CACHE_WORDS = 500_000
NULL_ID = -(1 << 63)  # stands for a null doc_id in files
MANIFEST = "file_no int, path string, n_docs long, n_tokens long"


# --- the codes -----------------------------------------------------------------------------

def best_widths(ids: np.ndarray) -> list[int]:
    """Level widths of least total size; an id with b bits reaches the level that covers bit b."""
    if ids.max(initial=0) < 1 << 20:
        upto = np.concatenate([[0], np.cumsum(np.bincount(ids))])
        lengths = np.diff(upto[np.minimum(np.concatenate([[0], 1 << np.arange(33)]), len(upto) - 1)])
    else:
        lengths = np.bincount(np.searchsorted(1 << np.arange(32, dtype=np.int64), ids, side="right"), minlength=33)
    most = max(1, int(np.nonzero(lengths)[0].max(initial=1)))
    longer = [int(lengths[b + 1 :].sum()) if b else len(ids) for b in range(most + 1)]  # ids over b bits
    best: dict[tuple[int, int], tuple[int, list[int]]] = {}

    def cost(covered: int, levels: int) -> tuple[int, list[int]]:
        if covered == most:
            return 0, []
        if (covered, levels) not in best:
            options = []
            for to in range(covered + 1, most + 1):
                if levels > 1 or to == most:
                    rest = cost(to, levels - 1)
                    options.append((longer[covered] * (to - covered + (to < most)) + rest[0], [to - covered, *rest[1]]))
            best[covered, levels] = min(options)
        return best[covered, levels]

    return cost(0, MAX_LEVELS)[1]


def pack(values: np.ndarray, width: int) -> bytes:
    octets = values.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    bits = np.unpackbits(octets, axis=1, count=width, bitorder="little")
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    out = np.zeros(count, np.uint32)
    for k in range(width):
        out |= bits[:, k].astype(np.uint32) << np.uint32(k)
    return out


def encode_segment(ids: np.ndarray) -> tuple[list[dict], list[bytes]]:
    """Levels as directory entries, and their parts: chunks, continuation bits, ranks."""
    rest, levels, parts = ids.astype(np.uint32), [], []
    for width in best_widths(ids):
        low = rest & np.uint32((1 << width) - 1)
        rest = rest >> np.uint32(width)
        more = rest > 0
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK)))])
        parts += [pack(low, width), np.packbits(more, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()]
        levels.append({"width": width, "count": len(low)})
        rest = rest[more]
    return levels, parts


def decode_segment(levels: list[dict], read) -> np.ndarray:
    """All ids of a segment; ``read(start, end)`` gives bytes of the file."""
    out: np.ndarray | None = None
    for level in reversed(levels):
        low = unpack(read(*level["chunks"]), level["width"], level["count"])
        if out is not None:
            more = np.unpackbits(np.frombuffer(read(*level["more"]), np.uint8), count=level["count"], bitorder="little")
            low[more.astype(bool)] |= out << np.uint32(level["width"])
        out = low
    return np.zeros(0, np.uint32) if out is None else out


def access(levels: list[dict], read, i: int) -> int:
    """Id number i of a segment, from a few bytes of each level it reaches."""
    value, shift = 0, 0
    for level in levels:
        width, (start, _) = level["width"], level["chunks"]
        first, last = i * width // 8, (i * width + width - 1) // 8
        chunk = int.from_bytes(read(start + first, start + last + 1), "little") >> (i * width % 8)
        value |= (chunk & ((1 << width) - 1)) << shift
        shift += width
        block = i // RANK_BLOCK
        bits_from = level["more"][0] + block * RANK_BLOCK // 8
        bits = int.from_bytes(read(bits_from, level["more"][0] + i // 8 + 1), "little")
        if not bits >> (i % RANK_BLOCK) & 1:
            break
        at = level["ranks"][0] + 4 * block
        rank = int.from_bytes(read(at, at + 4), "little")
        i = rank + (bits & ((1 << (i % RANK_BLOCK)) - 1)).bit_count()
    return value


# --- files ---------------------------------------------------------------------------------

def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pyarrow.fs.FileSystem.from_uri(f"file://{os.path.abspath(path)}")
    return pyarrow.fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


class Writer:
    """Appends documents' ids and writes full segments as they come."""

    def __init__(self, path: str, attempt: str):
        self.fs, self.path = store(path)
        self.draft = f"{self.path}.{attempt}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.at, self.segments, self.waiting, self.held = 0, [], [], 0
        self.doc_ids: list[int] = []
        self.ends: list[int] = []
        self.n_tokens = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n_tokens)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= SEGMENT:
            whole = np.concatenate(self.waiting)
            full = len(whole) // SEGMENT * SEGMENT
            for i in range(0, full, SEGMENT):
                self._segment(whole[i : i + SEGMENT])
            self.waiting, self.held = [whole[full:]], len(whole) - full

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), self.at

    def _segment(self, ids: np.ndarray) -> None:
        levels, parts = encode_segment(ids)
        for k, level in enumerate(levels):
            level["chunks"], level["more"], level["ranks"] = (self._put(p) for p in parts[3 * k : 3 * k + 3])
        self.segments.append(levels)

    def close(self) -> None:
        if self.held:
            self._segment(np.concatenate(self.waiting))
        docs = self._put(np.array(self.doc_ids, "<i8").tobytes())
        ends = self._put(np.array(self.ends, "<i8").tobytes())
        directory = json.dumps({"segments": self.segments, "docs": docs, "ends": ends, "n_tokens": self.n_tokens}).encode()
        self._put(directory + len(directory).to_bytes(8, "little") + MAGIC)
        self.out.close()
        there = self.fs.get_file_info(self.path)
        if there.type == pyarrow.fs.FileType.File and there.size == self.at:
            self.fs.delete_file(self.draft)
            return
        if there.type == pyarrow.fs.FileType.File:
            self.fs.delete_file(self.path)
        self.fs.move(self.draft, self.path)


class Reader:
    """Random access to one file: ``token(i)``, ``document(k)`` and ``segment(s)``."""

    def __init__(self, path: str):
        fs, path = store(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a token-id file")
        length = int.from_bytes(tail[:8], "little")
        self.directory = json.loads(self.file.read_at(length, size - 16 - length))
        self.doc_ids = np.frombuffer(self.read(*self.directory["docs"]), "<i8")
        self.ends = np.frombuffer(self.read(*self.directory["ends"]), "<i8")
        self.n_tokens = self.directory["n_tokens"]

    def read(self, start: int, end: int) -> bytes:
        return self.file.read_at(end - start, start)

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        return access(self.directory["segments"][i // SEGMENT], self.read, i % SEGMENT)

    def segment(self, s: int) -> np.ndarray:
        return decode_segment(self.directory["segments"][s], self.read)

    def documents(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(doc_id, first token, its ids in pieces), holding one segment at a time."""
        held, start = -1, 0
        for doc_id, end in zip(self.doc_ids.tolist(), self.ends.tolist(), strict=True):
            pieces, at = [], start
            while at < end:
                if at // SEGMENT != held:
                    held = at // SEGMENT
                    ids = self.segment(held)
                upto = min(end, (held + 1) * SEGMENT)
                pieces.append(ids[at - held * SEGMENT : upto - held * SEGMENT])
                at = upto
            yield doc_id, start, pieces
            start = end


# --- encoding ------------------------------------------------------------------------------

#: The letters of plain words, and the marks that may follow them.
_LETTERS = "".join(chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªµº")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters whose lower case may depend on others, or take up more or fewer of them.
_NOT_FOLDED = re.compile("[^\\x00-\\xff\\u2010-\\u2027\\u20ac]")
_TOGETHER = 64  # plain words that are encoded as one text


def word_encoder(tokenizer_file: str) -> WordStore:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordEncoder(Tokenizer.from_file(tokenizer_file))


class WordEncoder(WordStore):
    """Encodes texts word by word with a tokenizer that never joins across white space.

    A batch's words are looked up once each. A plain word is letters that are lower-cased one by
    one and stay one unit, perhaps before a run of marks other than apostrophes, which the
    tokenizer makes a unit of its own. Plain words that are not remembered without their marks
    are encoded many at a time, told apart by the mark that ends each unit, and runs of marks
    once; all other words are encoded by themselves.
    """

    at_once = 1 << 21  # the more, the fewer words are looked up again

    def __init__(self, tokenizer):
        super().__init__(split_words, lambda words: ids_by_itself(tokenizer, words), CACHE_WORDS)
        vocabulary = tokenizer.get_vocab()
        self.ends_unit = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_unit[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks: dict[str, list[int]] = {"": []}
        self.splits = self.ids_of(["a,*#"])[0] == sum(self.ids_of(["a", ",*#"]), [])
        self.of_letters = letters_tokenizer(tokenizer)
        capitals = [chr(c) for c in range(256) if chr(c).lower() != chr(c)]
        self.folds = self.ids_of(capitals) == self.ids_of([c.lower() for c in capitals])
        self.added = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]

    def _folded(self, text: str) -> str:
        """In lower case where the tokenizer makes no difference, so that fewer words are learned."""
        if self.folds and (text.isascii() or not _NOT_FOLDED.search(text)):
            lower = text.lower()
            if not any(token in lower for token in self.added):
                return lower
        return text

    def _codes_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [self._folded(text) for text in texts]
        if any(c in text for c in _NO_SPACE for text in texts):
            cut = pa.array([self.split(text) for text in texts], pa.list_(pa.string()))
        else:
            cut = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        found = cut.values.dictionary_encode()
        words, places = as_list(found.dictionary), found.indices.to_numpy()
        codes = self._look_up(words)
        if len(self.codes) + np.count_nonzero(codes < 0) > self.most and self.codes:
            self._forget()
            codes = self._look_up(words)
        unknown = np.flatnonzero(codes < 0)
        if len(unknown):
            first = len(self.codes)
            self._learn([words[i] for i in unknown.tolist()])
            codes[unknown] = np.arange(first, len(self.codes))
        self.uses[codes] += np.bincount(places, minlength=len(words)).astype(np.int32)
        return codes[places], cut.offsets.to_numpy()[1:]

    def _ids_of_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.array(words, pa.string())
        letters = pc.utf8_rtrim(texts, characters=_MARKS)
        plain = pc.match_substring_regex(letters, f"^[{_LETTERS}]+$").to_numpy(zero_copy_only=False) & self.splits
        units = pc.utf8_lower(letters.filter(plain)).dictionary_encode()
        tails = pc.utf8_ltrim(texts.filter(plain), characters=_LETTERS).dictionary_encode()
        others = self.ids_of(as_list(texts.filter(~plain)))
        lists = [*self._ids_of_marks(as_list(tails.dictionary)), *others, []]

        # Parts of words: units, runs of marks, other words, and nothing.
        ids, sizes = self._ids_of_units(as_list(units.dictionary))
        ids = np.concatenate([ids, np.array([i for part in lists for i in part], np.uint32)])
        n_tails = len(tails.dictionary)
        parts = np.full((len(words), 2), len(sizes) + len(lists) - 1)
        parts[plain, 0] = units.indices.to_numpy()
        parts[plain, 1] = len(sizes) + tails.indices.to_numpy()
        parts[~plain, 0] = len(sizes) + n_tails + np.arange(len(others))
        sizes = np.concatenate([sizes, np.array([len(part) for part in lists], np.int64)])
        starts, lengths = (np.cumsum(sizes) - sizes)[parts], sizes[parts]
        return ids[runs(starts.ravel(), lengths.ravel())], lengths.sum(axis=1)

    def _ids_of_marks(self, tails: list[str]) -> list[list[int]]:
        if len(self.marks) > CACHE_WORDS:
            self.marks.clear()
        new = [tail for tail in tails if tail not in self.marks]
        self.marks.update(zip(new, self.ids_of(new), strict=True))
        return [self.marks[tail] for tail in tails]

    def _ids_of_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like ``_ids_of_new``, for the lower-case letters of plain words; those remembered as words are not encoded."""
        codes = self._look_up(units)
        known, unknown = np.flatnonzero(codes >= 0), np.flatnonzero(codes < 0).tolist()
        texts = [" ".join(units[i] for i in unknown[k : k + _TOGETHER]) for k in range(0, len(unknown), _TOGETHER)]
        new = np.array([i for ids in ids_by_itself(self.of_letters, texts) for i in ids], np.uint32)
        ends = np.flatnonzero(self.ends_unit[new])
        if len(ends) != len(unknown):
            raise ValueError("the tokenizer does not mark the ends of units")
        sizes = np.zeros(len(units), np.int64)
        sizes[known] = self.bounds[codes[known] + 1] - self.bounds[codes[known]]
        sizes[unknown] = np.diff(ends, prepend=-1)
        starts = np.zeros(len(units), np.int64)
        starts[known] = np.cumsum(sizes[known]) - sizes[known]
        starts[unknown] = sizes[known].sum() + np.cumsum(sizes[unknown]) - sizes[unknown]
        return np.concatenate([self._gather(codes[known]), new])[runs(starts, sizes)], sizes


def as_list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def letters_tokenizer(tokenizer):
    """One for plain words' letters in lower case: without the steps that leave such as they are, if the tokenizer has those."""
    from tokenizers import Tokenizer

    parts = json.loads(tokenizer.to_str())
    steps = (parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    letters = " ".join(c for c in _LETTERS if c == c.lower())
    stays = tokenizer.normalizer is None or tokenizer.normalizer.normalize_str(letters) == letters
    if not stays or [step.get("type") for step in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return tokenizer
    steps = [{"type": "WhitespaceSplit"}, steps[1]]
    return Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": parts["pre_tokenizer"] | {"pretokenizers": steps}, "added_tokens": []}))


def ids_by_itself(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_NO_SPACE = "\x1c\x1d\x1e\x1f"


def split_words(text: str) -> list[str]:
    """Words between Unicode white space; Python also splits at four control characters that are none."""
    if any(c in text for c in _NO_SPACE):
        stand_in = {0x1C + k: 0xF0000 + k for k in range(4)}
        back = {0xF0000 + k: 0x1C + k for k in range(4)}
        return [w.translate(back) for w in text.translate(stand_in).split()]
    return text.split()


def write(documents: DataFrame, folder: str, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write the ids of ``documents`` in ascending doc_id order; returns the manifest, not yet run."""
    folder = qualified(documents.sparkSession, folder)
    docs = columns_of(documents, "doc_id", "text").select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.repartitionByRange(tasks_for(total), *order).sortWithinPartitions(*order)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        number, writer, encoder = context.partitionId(), None, None
        path = f"{folder}/ids-{number:07d}.dac"
        for batch in batches:
            if writer is None:
                writer = Writer(path, f"try-{context.taskAttemptId()}")
                encoder = per_process(("token_file", tokenizer_file), lambda: word_encoder(tokenizer_file))
            doc_ids = iter(batch["doc_id"])
            for texts in grouped(batch["text"], encoder.at_once):
                for doc_id, ids in zip(islice(doc_ids, len(texts)), encoder.encode(texts), strict=True):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pd.DataFrame([[number, path, len(writer.doc_ids), writer.n_tokens]], columns=["file_no", "path", "n_docs", "n_tokens"])

    return dealt.mapInPandas(task, MANIFEST)


def read(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    The running total is over one row per file.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = manifest.count() if tasks is None else tasks

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                rows = []
                for doc_id, start, pieces in Reader(path).documents():
                    crc = 0
                    for ids in pieces:
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    n = sum(map(len, pieces))
                    rows.append((None if doc_id == NULL_ID else doc_id, base + start, n, crc))
                frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return placed.repartitionByRange(max(1, files), "file_no").mapInPandas(
        task, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(documents: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    spark = documents.sparkSession
    folder = scratch(spark, "token-files")
    manifest_at = f"{folder}/manifest"
    write(documents, f"{folder}/ids", tokenizer_file, end_id).write.parquet(manifest_at)
    return read(spark.read.schema(MANIFEST).parquet(manifest_at))
