"""SentencePiece encoding and decoding with suffix-array matching.

A worker's new words (a run of word marks with what follows up to the next one; no piece crosses into another) are
concatenated, each once. The suffixes of that text are sorted to the depth of the longest piece, and every piece of the vocabulary is
binary-searched for its range of occurrences. The occurrences, as edges sorted by position, are then relaxed. The vocabulary
is of byte-pair merges, for which a shortest path over the edges is not what the model defines: so edges are relaxed in
the order of the merges' scores, leftmost first, each joining two neighbours that its span consists of. Characters without a piece
become their bytes' pieces.

Given results: null text gives null ids, empty text none; a word mark in a text decodes as a space; bytes that are no UTF-8 decode as U+FFFD;
ids out of the vocabulary raise an error; a long word (a text without spaces, say) is matched in parts where its characters allow it, so what
a worker holds goes with its longest stretch of characters that pieces join, and the ids are the same; repeated rows and null doc_id each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, resident, slices, spread, table

MARK = "\u2581"
#: Characters of new words in one index, about; characters of a word over which its merges go through a heap.
INDEX_CHARS, LONG = 1 << 18, 48
#: Characters of a word from which it is cut where no piece can join what is on both sides.
WORD_CHARS = 1 << 14
NORMAL, UNKNOWN, BYTE = 1, 2, 6


class Vocabulary:
    """Pieces, their order of merging and their bytes."""

    def __init__(self, file: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("the model's merges or normalisation aren't known here")
        self.prefix = spec.add_dummy_prefix
        kinds = np.array([p.type for p in model.pieces])
        self.normal = np.flatnonzero(kinds == NORMAL).astype(np.int32)
        texts = [model.pieces[i].piece for i in self.normal.tolist()]
        self.depth = max(map(len, texts))
        if any(MARK in t[1:].lstrip(MARK) for t in texts):
            raise ValueError("a piece spans words")
        self.sizes = np.array([len(t) for t in texts], np.int32)
        self.codes = np.full((len(texts), self.depth), -1, np.int32)
        for i, t in enumerate(texts):
            self.codes[i, : len(t)] = [ord(c) for c in t]
        inner = np.flatnonzero((self.codes[:, 1:] >= 0).ravel())
        #: Neighbouring characters of pieces: no merge joins others.
        self.joined = np.unique((self.codes[:, :-1].astype(np.int64) << 21 | self.codes[:, 1:].astype(np.int64)).ravel()[inner])
        score = np.array([p.score for p in model.pieces])
        self.rank = np.zeros(len(score), np.int64)
        self.rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b" \xe2\x81\x87 " if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"" for p in model.pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.array(list(map(len, raw)), np.int32)
        self.raw_starts = (np.cumsum(self.raw_sizes) - self.raw_sizes).astype(np.int32)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of text (int32 symbols), sorted to `depth` symbols or more by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while width < depth:
        then = np.zeros(len(rank), np.int64)
        then[:-width] = rank[width:]
        rank = np.unique(rank * (rank.max() + 1) + then, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    return np.argsort(rank, kind="stable").astype(np.int32)


def ranges(text: np.ndarray, sa: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, where in the suffix array its occurrences start and end: binary searches, all pieces a step at a time."""
    depth = codes.shape[1]
    padded = np.concatenate([text, np.full(depth, -2, np.int32)])
    inside = np.arange(depth) < sizes[:, None]
    found = []
    for after in (False, True):
        lo, hi = np.zeros(len(codes), np.int32), np.full(len(codes), len(sa), np.int32)
        for _ in range(len(sa).bit_length()):
            mid = np.minimum((lo + hi) >> 1, len(sa) - 1)
            other = (padded[sa[mid][:, None] + np.arange(depth)] - codes) * inside
            at = (other != 0).argmax(1)
            sign = other[np.arange(len(codes)), at]
            right = (sign < 0) | ((sign == 0) & after)
            go = lo < hi
            lo, hi = np.where(go & right, mid + 1, lo).astype(np.int32), np.where(go & ~right, mid, hi).astype(np.int32)
        found.append(lo)
    return found[0], found[1]


class PieceTokens:
    """Ids of texts; each distinct word of a worker is matched once."""

    MOST = 600_000

    def __init__(self, file: str):
        self.v = Vocabulary(file)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        long = [w for w in words if len(w) > WORD_CHARS]
        for w in long:
            ids = np.concatenate([self.match([part])[0] for part in self.parts(w)])
            self.place[w] = len(self.sizes)
            self.starts, self.sizes = np.append(self.starts, np.int32(len(self.ids))), np.append(self.sizes, np.int32(len(ids)))
            self.ids = np.concatenate([self.ids, ids])
        words, at = [w for w in words if len(w) <= WORD_CHARS] if long else words, 0
        while at < len(words):
            n, size = at, 0
            while n < len(words) and (n == at or size + len(words[n]) < INDEX_CHARS):
                size += len(words[n]) + 1
                n += 1
            ids, sizes = self.match(words[at:n])
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            self.place.update(zip(words[at:n], range(len(self.sizes), len(self.sizes) + n - at), strict=True))
            self.ids, self.starts, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.starts, starts.astype(np.int32)]), np.concatenate([self.sizes, sizes])
            at = n

    def parts(self, word: str) -> Iterator[str]:
        """A long word in parts of WORD_CHARS characters at least, cut where no piece has the two characters beside the cut: merges never join them."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64)
        seams = np.flatnonzero(~np.isin(codes[:-1] << 21 | codes[1:], self.v.joined)) + 1
        at = 0
        while at < len(word):
            k = np.searchsorted(seams, at + WORD_CHARS)
            end = int(seams[k]) if k < len(seams) else len(word)
            yield word[at:end]
            at = end

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in turn, number of ids of each)."""
        v = self.v
        lengths = np.array(list(map(len, words)), np.int64)
        text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.int32).copy()
        first = np.cumsum(lengths + 1) - lengths - 1
        text[first + lengths] = 0x110000  # between words; in no piece
        sa = sorted_suffixes(text, v.depth)
        lo, hi = ranges(text, sa, v.codes, v.sizes)
        n = hi - lo
        edges = np.full((len(text), v.depth), -1, np.int32)  # by position and length
        edges[sa[spread(lo, n)], np.repeat(v.sizes, n) - 1] = np.repeat(v.normal, n)
        symbols = self.relaxed(edges, first, lengths)
        starts, ends = symbols
        ids = edges[starts, np.minimum(ends - starts, v.depth) - 1]
        sizes = np.ones(len(ids), np.int64)
        bare = np.flatnonzero(ids < 0)
        spelled = {int(k): [v.byte[b] for b in chr(text[starts[k]]).encode("utf-8", "surrogatepass")] for k in bare}
        sizes[bare] = [len(spelled[int(k)]) for k in bare]
        out = np.repeat(ids, sizes)
        offsets = np.cumsum(sizes) - sizes
        for k, bs in spelled.items():
            out[offsets[k] : offsets[k] + len(bs)] = bs
        of = np.searchsorted(first, starts, "right") - 1
        return out, np.bincount(of, sizes, len(words)).astype(np.int32)

    def relaxed(self, edges: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the symbols of all words: edges applied by rank, leftmost first, until none joins two neighbours."""
        rank, depth = self.v.rank, self.v.depth
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(lengths > LONG):
            done.append(self.by_heap(edges, int(first[k]), int(lengths[k])))
        short = np.flatnonzero(lengths <= LONG)
        word = np.repeat(np.arange(len(short)), lengths[short])
        start = spread(first[short].astype(np.int32), lengths[short].astype(np.int32)).astype(np.int64)
        end = start + 1
        none = np.int64(1) << 62
        while len(start):
            key = np.full(len(start), none)
            pair = np.flatnonzero((word[1:] == word[:-1]) & (end[1:] - start[:-1] <= depth))
            ids = edges[start[pair], end[pair + 1] - start[pair] - 1]
            pair, ids = pair[ids >= 0], ids[ids >= 0]
            key[pair] = (rank[ids] << 32) | pair
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(key, heads)
            sizes = np.diff(heads, append=len(word))
            over = np.repeat(best == none, sizes)
            if over.any():
                done.append((start[over], end[over]))
            left = (best[best != none] & 0xFFFFFFFF).astype(np.int64)
            end[left] = end[left + 1]
            keep = ~over
            keep[left + 1] = False
            start, end, word = start[keep], end[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, end = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], end[order]

    def by_heap(self, edges: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        rank, depth = self.v.rank.tolist(), self.v.depth
        own = edges[first : first + n]
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by start; before: the neighbour's start
        alive = bytearray(b"\1" * n)

        def offer(a: int) -> None:
            b = ends[a]
            if b < n and ends[b] - a <= depth and (i := own[a, ends[b] - a - 1]) >= 0:
                heapq.heappush(heap, (rank[i], a, ends[b]))

        heap: list[tuple[int, int, int]] = []
        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, z = heapq.heappop(heap)
            b = ends[a]
            if not alive[a] or b >= n or ends[b] != z:
                continue
            ends[a], alive[b] = z, 0
            if z < n:
                before[z] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        starts = np.flatnonzero(np.frombuffer(alive, np.uint8))
        return starts + first, np.array(ends, np.int64)[starts] + first

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text). texts has no null."""
        if len(self.place) > self.MOST:
            self.clear()
        whole = pc.replace_substring(texts, " ", MARK)
        if self.v.prefix:
            whole = pc.if_else(pc.equal(pc.binary_length(whole), 0), whole, pc.binary_join_element_wise(MARK, whole, ""))
        # A word's first mark follows another character: cut there.
        parts = pc.split_pattern(pc.replace_substring_regex(whole, f"([^{MARK}])({MARK})", "\\1\U0010fffe\\2"), "\U0010fffe") if not pc.any(pc.match_substring(whole, "\U0010fffe")).as_py() else _cut(whole)
        edges = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        place = words.indices.to_numpy(zero_copy_only=False)
        names = words.dictionary.to_pylist()
        new = [w for w in names if w not in self.place]
        if new:
            self.learn(new)
        own = np.fromiter(map(self.place.__getitem__, names), np.int32, len(names))[place] if len(names) else np.zeros(0, np.int32)
        each = self.sizes[own]
        bounds = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        return self.ids[spread(self.starts[own], each)], np.diff(bounds[edges])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        v = self.v
        data = v.raw[spread(v.raw_starts[ids], v.raw_sizes[ids])].tobytes()
        bounds = np.concatenate([[0], np.cumsum(v.raw_sizes[ids], dtype=np.int64)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = []
        for a, z in zip(bounds[at[:-1]].tolist(), bounds[at[1:]].tolist(), strict=True):
            b = data[a:z]
            out.append((b[1:] if v.prefix and b[:1] == b" " else b).decode("utf-8", "replace"))
        return out


def _cut(whole: pa.Array) -> pa.Array:
    """The same cuts for texts that hold the character that otherwise marks them."""
    import re

    return pa.array([re.split(f"(?<=[^{MARK}])(?={MARK})", t) for t in whole.to_pylist()], pa.list_(pa.string()))


def tokens_of(file: str) -> PieceTokens:
    """This worker's PieceTokens."""
    return resident(("pieces", file), lambda: PieceTokens(file))


def encoded(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(file)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                ids, sizes = tokens.encode(pc.fill_null(part.column(1), ""))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                if part.column(1).null_count:
                    lists = pc.if_else(pc.is_valid(part.column(1)), lists, None)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(in_batches, run, out)


def decoded(rows: DataFrame, file: str) -> DataFrame:
    """(doc_id, text) of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(file)
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            if len(flat) and not (0 <= flat.min() and flat.max() < len(tokens.v.raw_sizes)):
                raise ValueError("an id isn't in the vocabulary")
            texts, at = [], 0
            for i in range(0, len(sizes), 256):
                part = sizes[i : i + 256]
                n = int(part.sum())
                texts += tokens.decode(flat[at : at + n], part)
                at += n
            text = pa.array(texts, pa.string())
            if lists.null_count:
                text = pc.if_else(pc.is_valid(lists), text, None)
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    out = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text", T.StringType())])
    return rows.select("doc_id", "ids").transform(in_batches, run, out)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256): of the ids as little-endian unsigned 32-bit numbers, and of the text decoded from them."""
    file = tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        tokens = tokens_of(file)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                ids, sizes = tokens.encode(pc.fill_null(part.column(1), ""))
                at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                flat = ids.astype("<u4")
                crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(at, at[1:], strict=False)]
                sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in tokens.decode(ids, sizes)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha)], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents")
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(in_batches, run, out)
