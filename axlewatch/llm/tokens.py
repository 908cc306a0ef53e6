"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Files hold ascending ranges of doc_id, sorted inside, so a reader prunes files, stripes and row groups by their
statistics, tells absent ids by the Bloom filter, and reads stripes in parallel. Row: doc_id, text_hash, n_tokens, ids.

Defined results: a null or empty text is the end id alone; a null doc_id comes first; rows of one doc_id are ordered by
their text's hash, which is stored, and rows equal in both are alike; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch.llm.common import batches_of, new_path

END_ID = 2
#: Documents that a Python worker gets at once.
BATCH_ROWS = 1000
#: Characters that are encoded at once; results are several times as large as the texts.
SLICE_CHARS = 1 << 20
#: Pieces whose ids a Python worker keeps, at about 60 bytes each; beyond, those stay that were met again.
CACHE_PIECES = 1_500_000
#: Pieces of under so many times 8 bytes are kept, as their bytes.
LANES = 3
PLAIN = "^ ?[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$"
#: The pre-tokenizer that the cuts below are right for: byte-level with its own pattern, no prefix space.
EXPECTED = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
SPACE, FEED = 0x20, 0x0A
KIND = np.zeros(256, np.uint8)  # 1 white space, 2 what may begin or be white space beyond ASCII, 3 letters and digits, 4 closing marks
KIND[[*range(9, 14), SPACE]] = 1
KIND[[*range(0x1C, 0x20), *range(0x80, 0xC0), 0xC2, 0xE1, 0xE2, 0xE3]] = 2
KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = 3
KIND[[*b".,;:!?"]] = 4


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all stretches, laid one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def lanes(words: pa.StringArray) -> np.ndarray:
    """The first 8 * LANES - 1 bytes of each word, and its length, as LANES integers; unequal for unequal words up to that length."""
    n, width = len(words), 8 * LANES
    if not n:
        return np.zeros((0, LANES), np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    size = np.diff(offsets)[:, None]
    place = np.arange(width)
    inside = place < size
    out = np.where(inside, data[np.minimum(offsets[:-1, None] + place, len(data) - 1)], 0).astype(np.uint8)
    out[:, -1] = np.minimum(size[:, 0], 255)
    return np.ascontiguousarray(out).view(np.uint64)


def mixed(words: np.ndarray) -> np.ndarray:
    """A hash of each row of lanes."""
    h = np.zeros(len(words), np.uint64)
    for k in range(LANES):
        h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def is_space_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place may be white space; at > 0."""
    one = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    ascii_ = one < 0x80
    return (ascii_ & np.isin(KIND[one], (1, 2))) | (~ascii_ & ((two == 0xC2) | np.isin(three, (0xE1, 0xE2, 0xE3))))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in UTF-8 data at which a piece begins, those of texts (offsets) included, ascending.

    The pattern never joins a character that isn't white space to white space after it, nor a letter or digit to a
    mark after it, so a cut is right before a run of white space, before a closing mark after a letter or digit, and
    behind a single line feed that stands between two other characters.
    """
    kind = KIND[data]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[:1] = 0
    at = np.flatnonzero((kind == 1) & (before != 1))
    at = at[at > 0]
    at = at[~is_space_after(data, at)]
    marks = np.flatnonzero((kind == 4) & (before == 3))
    feeds = at[(data[at] == FEED) & (at + 1 < len(data))] + 1
    feeds = feeds[(kind[feeds] != 1) & (kind[feeds] != 2)]
    here = np.zeros(len(data) + 1, bool)
    for x in (at, marks, feeds, offsets):
        here[x] = True
    return np.flatnonzero(here[:-1])


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    A piece is a stretch of text that the library encodes by itself, whatever stands around it. A tokenizer whose
    pattern isn't the expected one, and texts with one of its added tokens, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        split = config.get("pre_tokenizer") or {}
        self.fits = not config.get("normalizer") and not config.get("truncation") and all(split.get(k, True) == v for k, v in EXPECTED.items()) and "type" in split
        self.added = [x["content"] for x in config.get("added_tokens", [])]
        self.tab = self.tok.encode("\t", add_special_tokens=False).ids
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.int32
        self.words, self.again = np.zeros((0, LANES), np.uint64), np.zeros(0, bool)
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.size, self.store = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    def forget(self) -> None:
        """Keeps the pieces that were met again, if they are under half of the limit."""
        stay = np.flatnonzero(self.again)
        stay = stay if len(stay) < CACHE_PIECES // 2 else stay[:0]
        words, sizes, ids = self.words[stay], self.size[stay], self.store[spread(self.begin[stay], self.size[stay])]
        self.words, self.again = self.words[:0], self.again[:0]
        self.hashes, self.rows = self.hashes[:0], self.rows[:0]
        self.begin, self.size, self.store = self.begin[:0], self.size[:0], self.store[:0]
        self.keep(words, ids, sizes)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The row of each piece (its bytes), or -1."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        h = mixed(words)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        rows = self.rows[at].astype(np.int64)
        return np.where((self.words[rows] == words).all(axis=1), rows, -1)

    def keep(self, words: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds rows. Of pieces whose hashes are equal the first alone is found again."""
        n, h = len(self.words), mixed(words)
        order = np.argsort(h, kind="stable")
        at = np.searchsorted(self.hashes, h[order], side="right")
        self.hashes, self.rows = np.insert(self.hashes, at, h[order]), np.insert(self.rows, at, (n + order).astype(np.int32))
        self.begin = np.append(self.begin, len(self.store) + np.cumsum(sizes) - sizes)
        self.size, self.store = np.append(self.size, sizes.astype(np.int32)), np.append(self.store, ids)
        self.words, self.again = np.concatenate([self.words, words]), np.append(self.again, np.zeros(len(words), bool))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids for each piece). Pieces are encoded together, parted by tabs; a tab is a token of its own there."""
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for s in range(0, len(pieces), 2000):
            part = pieces[s : s + 2000]
            got = self.whole(["\t".join(part)])[0]
            tabs = np.flatnonzero(got == self.tab[0])
            if len(self.tab) == 1 and len(tabs) == len(part) - 1:
                starts = np.insert(tabs + 1, 0, 0)
                ids.append(np.delete(got, tabs))
                sizes.append(np.append(tabs, len(got)) - starts)
            else:
                each = self.whole(part)
                ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, pieces: pa.Array, words: np.ndarray) -> np.ndarray:
        """Adds a row for each piece and gives their order. Only pieces of one word, with one space before it or none, can stand beside tabs."""
        plain = pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False)
        ids, sizes = self.encode_pieces(pc.filter(pieces, pa.array(plain)).to_pylist())
        others = self.whole(pc.filter(pieces, pa.array(~plain)).to_pylist())
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        self.keep(words[order], np.concatenate([ids, *others]), np.concatenate([sizes, np.array([len(x) for x in others], np.int64)]))
        return order

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with the end id after each text, number of ids for each text)."""
        loose = np.full(len(texts), not self.fits)
        for token in self.added if self.fits else []:
            loose |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        fast = pc.filter(texts, pa.array(~loose)) if loose.any() else texts
        offsets = np.frombuffer(fast.buffers()[1], np.int32)[fast.offset : fast.offset + len(fast) + 1] if len(fast) else np.zeros(1, np.int32)
        first, last = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(fast.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        offsets = offsets - first
        at = cuts(data, offsets)
        ends = np.append(at, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        distinct = pieces.dictionary
        words = lanes(distinct)
        long = pc.binary_length(distinct).to_numpy() >= 8 * LANES  # these are encoded each time
        if len(self.words) + len(words) > CACHE_PIECES:
            self.forget()
        rows = self.find(words)
        rows[long] = -1
        self.again[rows[rows >= 0]] = True
        new = np.flatnonzero(rows < 0)
        if len(new):
            known = len(self.words)
            plain = self.learn(distinct.take(pa.array(new)), words[new])
            rows[new[plain]] = known + np.arange(len(new))
        index = rows[pieces.indices.to_numpy()]
        odd = self.whole(pc.filter(texts, pa.array(loose)).to_pylist()) if loose.any() else []
        # stretches of the store: a text's pieces, or itself if it is loose, and the end id
        stretches = np.full(len(texts), 2, np.int64)
        stretches[~loose] = np.diff(np.searchsorted(at, offsets)) + 1
        end = np.cumsum(stretches) - 1
        begin, size = np.zeros(stretches.sum(), np.int64), np.ones(stretches.sum(), np.int64)
        inside = np.repeat(~loose, stretches)
        inside[end] = False
        begin[inside], size[inside] = self.begin[index], self.size[index]
        own = [*odd, np.array([END_ID], self.dtype)]
        sizes = np.array([len(x) for x in own], np.int64)
        starts = len(self.store) + np.cumsum(sizes) - sizes
        alone = end[loose] - 1
        begin[alone], size[alone], begin[end] = starts[:-1], sizes[:-1], starts[-1]
        ids = np.concatenate([self.store, *own])[spread(begin, size)].astype(np.int32)
        return ids, np.add.reduceat(size, end - stretches + 1) if len(texts) else np.zeros(0, np.int64)


def encoder_of(path: str) -> Encoder:
    """This Python worker's encoder: one for all its tasks, so words stay known and memory is taken once.

    It is held by the tokenizers module, as functions that travel with a job have no module of their own in a worker.
    """
    import tokenizers

    held = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs(doc_id, text, ..) -> doc_id, text_hash, n_tokens, ids; the end id closes each document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            block = (np.cumsum(pc.binary_length(texts).to_numpy()) // SLICE_CHARS) if len(texts) else np.zeros(0, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                ids, counts = encoder.encode(texts.slice(a, b - a))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["doc_id", "text_hash", "n_tokens", "ids"])
            pa.default_memory_pool().release_unused()

    out = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(each, out)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, stripe_mb: int = 16) -> None:
    """Writes docs(doc_id, text) as ORC files in ascending doc_id order."""
    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_mb << 20), "compression": "zstd"}
    with batches_of(docs.sparkSession, BATCH_ROWS):
        encoded(ranged, tokenizer_path).write.options(**options).orc(path)


def documents_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The stored rows of some documents. The ids are pushed into the scan: statistics and Bloom filters skip files, stripes and row groups without them."""
    return spark.read.orc(path).where(F.col("doc_id").isin(*doc_ids))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and file, read back from the files.

    Offsets are sums by file, then inside a file; ids never leave the task that reads their stripe.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], crc], names=["file", "doc_id", "text_hash", "n_tokens", "ids_crc32"])

    stored = spark.read.orc(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"), "doc_id", "text_hash", "n_tokens", "ids")
    out = T.StructType([T.StructField("file", T.IntegerType()), stored.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    with batches_of(spark, BATCH_ROWS):
        rows = stored.mapInArrow(digest, out).checkpoint()
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = files.select(F.col("file").alias("b_file"), (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("before"))  # a row per file
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(F.broadcast(before), rows["file"] == before["b_file"]).select(
        "doc_id", (F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32", "file"
    )


def tokenized(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes docs' ids to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "token-ids")
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(docs.sparkSession, path).drop("file")
