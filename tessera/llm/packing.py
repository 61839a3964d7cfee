"""Best-fit packing into token sequences: bounded-space online best fit.

Pieces arrive in turn. A fixed number of bins is open, in stacks by free space; a bitset has a bit for each free space
that some open bin has, so the tightest bin that a piece fits is the lowest set bit at or over the piece's length. A bin
that is full closes; when too many are open, the fullest closes first.

Whole texts are tokenised. A document's ids end with an end id; only longer ones are cut, into pieces of a sequence's
length, of which all but the last fill a sequence each. What is packed is the pieces' lengths, dealt to tasks by number.

Given results: null text is packed as empty text, which has the end id alone; rows that repeat a doc_id are packed each on
its own; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, resident, slices, spread, table, written

LENGTH = 4096
END_ID = 1
OPEN_BINS = 1024
#: Pieces that one task packs.
PER_TASK = 100_000


class BestFit:
    """Bounded-space online best fit; `closed` gets (bin, free space) as bins close."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.most = length, open_bins
        self.bits, self.stacks = 0, {}
        self.n_open, self.made = 0, 0

    def add(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of `size` tokens, 1 to the sequence's length."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = self.stacks[free]
            at = stack.pop()
            if not stack:
                self.bits &= ~(1 << free)
        else:
            free, at = self.length, self.made
            self.made += 1
            self.n_open += 1
        left = free - size
        if left:
            self.stacks.setdefault(left, []).append(at)
            self.bits |= 1 << left
            if self.n_open > self.most:
                self.close_fullest()
        else:
            self.n_open -= 1
        return at, self.length - free

    def close_fullest(self) -> None:
        free = (self.bits & -self.bits).bit_length() - 1
        stack = self.stacks[free]
        stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1


class WordTokens:
    """Ids by the tokenizers library of a word-wise vocabulary, with each distinct word of a worker tokenised once.

    White space gives no token and no token spans it, so a text's ids are those of its words, cut at ASCII white space. A
    word of Latin-1 letters and marks after them is its letters' ids, in lower case, and its marks' ids. Lower-case letters
    need no normalising and no cutting, so they go straight to the merges."""

    MOST = 400_000
    MARKS = "!#$%&()*+,./:;=?@[]^_~-"
    WORD, LOWER = "^[A-Za-zÀ-ÖØ-öø-þ]+$", "^[a-zß-öø-þ]+$"
    #: Words that go to the library at once.
    AT_ONCE = 20_000

    def __init__(self, file: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.t, self.letters = Tokenizer.from_file(file), Tokenizer.from_file(file)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.t.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # which ids end a word
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Forget all words. The ids of word i are ids[starts[i] : starts[i] + sizes[i]]; word 0 is empty."""
        self.known = pa.array([""])
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int32), np.zeros(1, np.int32)

    def learn(self, words: pa.Array) -> np.ndarray:
        """Adds distinct words that are not known; returns their numbers."""
        plain = pc.match_substring_regex(words, self.LOWER)
        letters, others = words.filter(plain), words.filter(pc.invert(plain))
        ids, sizes = [self.ids], []
        for i in range(0, len(letters), self.AT_ONCE):
            got = self.letters.encode_batch_fast([letters[i : i + self.AT_ONCE].to_pylist()], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got[0].ids, np.uint32))
            sizes.append(np.diff(np.flatnonzero(self.ends[ids[-1]]), prepend=-1))
        for i in range(0, len(others), self.AT_ONCE):
            got = [e.ids for e in self.t.encode_batch_fast(others[i : i + self.AT_ONCE].to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
        sizes, first = np.concatenate(sizes).astype(np.int32), len(self.known)
        self.known = pa.concat_arrays([self.known, letters, others])
        self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate(ids)
        plain = plain.to_numpy(zero_copy_only=False)
        return first + np.where(plain, np.cumsum(plain) - 1, len(letters) + np.cumsum(~plain) - 1)

    def halves(self, words: pa.Array) -> np.ndarray:
        """For each distinct word two known words, of which the second may be the empty one: all first ones, then all second ones."""
        if len(self.known) > self.MOST:
            self.clear()
        stems = pc.utf8_rtrim(words, self.MARKS)
        split = pc.match_substring_regex(stems, self.WORD)
        firsts = pc.if_else(split, pc.utf8_lower(stems), words)
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
        marks = np.where(split.to_numpy(zero_copy_only=False), sizes - pc.binary_length(stems).to_numpy(zero_copy_only=False), 0).astype(np.int32)
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int32)[words.offset + 1 : words.offset + 1 + len(words)]
        text = np.frombuffer(data or b"", np.uint8)[spread(ends - marks, marks)]
        seconds = pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(marks)]).astype(np.int32)), pa.py_buffer(text))
        both = pa.concat_arrays([firsts, seconds]).dictionary_encode()
        place = pc.index_in(both.dictionary, self.known)
        new = pc.is_null(place)
        numbers = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).copy()
        if place.null_count:
            numbers[new.to_numpy(zero_copy_only=False)] = self.learn(both.dictionary.filter(new))
        return numbers[both.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text). texts has no null."""
        flat = pc.ascii_split_whitespace(texts)
        edges = flat.offsets.to_numpy() - flat.offsets[0].as_py()
        words = flat.flatten().dictionary_encode()
        place = words.indices.to_numpy(zero_copy_only=False)
        if not len(place):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        parts = self.halves(words.dictionary).reshape(2, -1).T.ravel()
        every = self.ids[spread(self.starts[parts], self.sizes[parts])]  # of the distinct words, in turn
        sizes = self.sizes[parts].reshape(-1, 2).sum(1, dtype=np.int32)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes[place]
        bounds = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        return every[spread(starts[place], each)], np.diff(bounds[edges])


def words_of(file: str) -> WordTokens:
    """This worker's WordTokens."""
    return resident(("words", file), lambda: WordTokens(file))


def pieces(docs: DataFrame, file: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids with the end id, cut after every `length` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(file)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                ids, sizes = words.encode(pc.fill_null(part.column(1), ""))
                doc, piece, start, size, crc, at = [], [], [], [], [], 0
                for i, n in enumerate(sizes.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k, a in enumerate(range(0, n + 1, length)):
                        cut = own[a : a + length]
                        doc.append(i)
                        piece.append(k)
                        start.append(a)
                        size.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())] + [T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32")])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(in_batches, run, out)


def pack(found: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, per_task: int = PER_TASK) -> DataFrame:
    """found with sequence_id and offset, from its columns doc_id, piece, start and length. The pieces that fill a sequence each take no part in the
    packing, and the others are dealt evenly to tasks of about per_task pieces, so no key makes a task large."""
    found = written(found, "pieces")
    n = found.where(F.col("length") < length).count()
    tasks = max(1, -(-n // per_task))
    columns = found.columns
    dealt = found.where(F.col("length") < length).repartition(tasks, F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())).sortWithinPartitions(F.xxhash64("doc_id", "piece"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, task = BestFit(length, open_bins), TaskContext.get().partitionId()
        for batch in batches:
            placed = [bins.add(n) for n in batch.column("length").to_pylist()]
            more = [pa.array([(task << 40) + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "sequence_id", "offset"])

    out = T.StructType(found.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    # Numbers of sequences that a piece fills alone are below zero.
    alone = found.where(F.col("length") >= length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return dealt.transform(in_batches, run, out).unionByName(alone)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_file()))
