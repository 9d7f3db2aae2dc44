"""Token ids in files of fixed-width bit packing.

Each id takes the least number of bits that holds the vocabulary. A file has a header, blocks
of BLOCK ids packed from the lowest bit on, a footer with every block's and every document's
place, and a trailer, so a numpy reader gets any document or range of ids without the rest of
the file. Documents are dealt to files by ranges of doc_id, and a table beside the files, index,
has a row for each document: its file, first id and number of ids.

A task writes its file under a name of its own attempt, and the index, which Spark commits,
names the files of the attempts that count; so tasks may be repeated at any time.

    header   8 bytes magic, then width, ids a block (unsigned 32), size of the vocabulary (unsigned 64)
    blocks   each ceil(ids * width / 8) bytes
    footer   blocks' places and the end (unsigned 64), documents' first ids and the end (unsigned 64)
    trailer  number of ids, of documents, place of the footer (unsigned 64), 8 bytes magic
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

MAGIC = b"FWBITS1\n"
BLOCK = 4096
#: Ids read, packed or unpacked at a time.
CHUNK = 1 << 20
#: Characters that are tokenized at a time; words after which a worker starts to remember anew, and their mean bytes.
SLICE_CHARS = 1 << 21
REMEMBERED = 500_000
WORD_BYTES = 16


def width_of(vocab: int) -> int:
    """Bits that hold the ids 0 to vocab - 1, one at least."""
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids one after the other in width bits each, the lowest bit first; zero bits up to a whole byte."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return raw[:, : width // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first n ids of packed data."""
    out = np.zeros((n, 4), dtype=np.uint8)
    if width % 8 == 0:
        out[:, : width // 8] = np.frombuffer(data, dtype=np.uint8, count=n * width // 8).reshape(n, width // 8)
    else:
        bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width, bitorder="little").reshape(n, width)
        packed = np.packbits(bits, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
    return out.view("<u4").reshape(-1)


class Writer:
    """Writes one file; ids of documents come in order and leave as blocks."""

    def __init__(self, stream, vocab: int, block: int = BLOCK) -> None:
        if block % 8:
            raise ValueError("ids a block must be a multiple of 8, so that blocks end with a byte")
        self.stream, self.width, self.block = stream, width_of(vocab), block
        self.at = stream.write(struct.pack("<8sIIQ", MAGIC, self.width, block, vocab))
        self.vocab, self.places, self.starts, self.n, self.held, self.n_held = vocab, [], [], 0, [], 0

    def add(self, ids: np.ndarray) -> tuple[int, int]:
        """Appends a document; its first id's number in the file, and its number of ids."""
        if len(ids) and int(ids.max()) >= self.vocab:
            raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {self.vocab}")
        first = self.n
        self.starts.append(first)
        self.held.append(ids)
        self.n += len(ids)
        self.n_held += len(ids)
        if self.n_held >= CHUNK:
            self._flush(self.n_held - self.n_held % self.block)
        return first, len(ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, dtype=np.uint32)
        for k in range(0, n, self.block):
            self.places.append(self.at + k * self.width // 8)
        self.at += self.stream.write(pack(ids[:n], self.width))
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        footer = np.array([*self.places, self.at, *self.starts, self.n], dtype="<u8").tobytes()
        self.stream.write(footer + struct.pack("<QQQ8s", self.n, len(self.starts), self.at, MAGIC))
        self.stream.close()


class Reader:
    """Reads any document or range of ids of one file (a seekable binary stream)."""

    def __init__(self, stream) -> None:
        self.stream = stream
        magic, self.width, self.block, self.vocab = struct.unpack("<8sIIQ", self._bytes(0, 24))
        size = stream.seek(0, 2)
        self.n, self.docs, footer, end = struct.unpack("<QQQ8s", self._bytes(size - 32, 32))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a whole file of packed ids")
        blocks = -(-self.n // self.block)
        self.places = np.frombuffer(self._bytes(footer, 8 * (blocks + 1)), dtype="<u8").astype(np.int64)
        self.starts_at = footer + 8 * (blocks + 1)

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from the one numbered first, from the blocks that hold them alone."""
        if first < 0 or n < 0 or first + n > self.n:
            raise IndexError(f"ids {first} to {first + n} of {self.n}")
        if n == 0:
            return np.empty(0, dtype=np.uint32)
        b, e = first // self.block, -(-(first + n) // self.block)
        data = self._bytes(int(self.places[b]), int(self.places[e] - self.places[b]))
        return unpack(data, min(self.n, e * self.block) - b * self.block, self.width)[first - b * self.block :][:n]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        if not 0 <= k < self.docs:
            raise IndexError(f"document {k} of {self.docs}")
        first, end = struct.unpack("<QQ", self._bytes(self.starts_at + 8 * k, 16))
        return self.ids(first, end - first)


#: A place where every text may be cut: a space before a character that is no white space.
_CUT = re.compile(r" (?=\S)")
#: Beyond these letters, libraries may disagree on what is a letter: the tokenizer's own cutting applies.
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_LETTER, _NUMBER, _BLANK, _OTHER, _BEYOND, _BEYOND_BLANK = range(6)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, _BEYOND, dtype=np.uint8)
    for c in range(0x250):
        out[c] = next((k for k, p in enumerate((r"\p{L}", r"\p{N}", r"\s")) if regex.match(p, chr(c))), _OTHER)
    out[[c for c in range(0x250, 0x110000) if chr(c).isspace()]] = _BEYOND_BLANK
    return out


def _byte_signs() -> np.ndarray:
    """The sign of each byte in a byte-level vocabulary: printable ones their own, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return np.array([b if b in own else 256 + others.index(b) for b in range(256)], dtype="<u4")


_SIGNS = _byte_signs()


def _word_starts(code: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where the words of texts begin, as a byte-level pre-tokenizer cuts them; between two cuts with a character beyond Latin all is one.

    code: the texts' code points, one text behind the other (one at least). docs: where each text begins. The words are
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n, kind, space = len(code), _classes()[code], code == 32
    first = np.zeros(n + 1, dtype=bool)
    first[docs] = first[n] = True
    first, last = first[:-1], first[1:]
    blank = (kind == _BLANK) | (kind == _BEYOND_BLANK)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last of some white space begins a word, and goes with what follows if it is a space.
    ends = blank & ~last
    ends[:-1] &= ~blank[1:]
    start |= ends
    cut = space & ends
    start[1:] &= ~cut[:-1]
    marks = np.flatnonzero(start & ~last & (code == 39))
    if len(marks):
        # What follows a mark; nothing at the text's end.
        far = np.minimum(marks + 2, n - 1)
        one, two = code[marks + 1], np.where(last[marks + 1], 0, code[far])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[marks[short | long] + 1] = False
        for at in (marks[short] + 2, marks[long] + 3):
            at = at[at < n]
            start[at[kind[at] == _LETTER]] = True
    beyond = np.flatnonzero(kind >= _BEYOND)
    if not len(beyond):
        return np.flatnonzero(start)
    cuts, out = np.flatnonzero(first | cut), np.flatnonzero(start | cut)
    whole = np.zeros(len(cuts), dtype=bool)
    whole[np.searchsorted(cuts, beyond, "right") - 1] = True
    return out[~whole[np.searchsorted(cuts, out, "right") - 1] | (first | cut)[out]]


class Encoder:
    """Texts to ids, each word once.

    A byte-level pre-tokenizer without normalizer begins a token at every space that a character other than white
    space follows, whatever stands around; so a text may be cut there. Slices of texts are cut into words as the
    pre-tokenizer does, Arrow numbers a slice's different words, and the tokenizer's model encodes those that are
    new; what lies between two cuts and has a character beyond Latin is encoded by the tokenizer as a whole. Ids of
    words are remembered in one array, up to a number of words and of their bytes. Other tokenizers get whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        kind = self.tokenizer.pre_tokenizer
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not t.special]
        self.cuts = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and kind.use_regex and self.tokenizer.normalizer is None and not added
        self.vocab = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        """No word is known: its number by word; ids of all words, and where those of each end."""
        self.words: dict[bytes, int] = {}
        self.ids, self.ends, self.held = array("I"), array("q", [0]), 0

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """The ids of new words."""
        every = b"".join(words)
        signs = _SIGNS[np.frombuffer(every, dtype=np.uint8)].tobytes().decode("utf-32-le")
        latin, plain, beyond, at = every.isascii(), [], [], 0
        tokenize, ids, ends = self.model.tokenize, self.ids, self.ends
        for w in words:
            to = at + len(w)
            if latin or w.isascii() or not _BEYOND_LATIN.search(w.decode()):
                ids.extend([t.id for t in tokenize(signs[at:to])])
                ends.append(len(ids))
                plain.append(w)
            else:
                beyond.append(w)
            at = to
        for k in range(0, len(beyond), 10_000):
            for own in self._raw([w.decode() for w in beyond[k : k + 10_000]]):
                ids.frombytes(own)
                ends.append(len(ids))
        self.words.update(zip([*plain, *beyond], range(len(self.words), len(ends) - 1), strict=True))
        self.held += len(every)

    def _slice(self, texts: list[str]) -> list[bytes]:
        whole = "".join(texts)
        if not whole:
            return [b""] * len(texts)
        if len(self.words) > REMEMBERED or self.held > REMEMBERED * WORD_BYTES:
            self._forget()
        docs = np.cumsum([0, *map(len, texts)])
        code, raw = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4"), np.frombuffer(whole.encode(), dtype=np.uint8)
        starts = _word_starts(code, docs[:-1][np.diff(docs) > 0])
        places = starts if len(raw) == len(code) else np.flatnonzero((raw & 0xC0) != 0x80)[starts]
        offsets = np.append(places, len(raw)).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in words if w not in self.words])
        ends = np.array(self.ends, dtype=np.int64)
        number = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        here = found.indices.to_numpy()
        sizes, begins = (ends[number + 1] - ends[number])[here], ends[number][here]
        upto = np.cumsum(sizes)
        ids = np.array(self.ids, dtype="<u4")[np.repeat(begins - upto + sizes, sizes) + np.arange(upto[-1])]
        bounds = np.append(0, upto)[np.searchsorted(starts, docs)]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; long texts go by parts that end where a text may be cut."""
        if not self.cuts:
            return self._raw(texts)
        if len(texts) != 1 or len(texts[0]) <= SLICE_CHARS:
            return self._slice(texts)
        out, at = [], 0
        while at < len(texts[0]):
            cut = _CUT.search(texts[0], at + SLICE_CHARS)
            to = cut.start() if cut else len(texts[0])
            out += self._slice([texts[0][at:to]])
            at = to
        return [b"".join(out)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def _writing(tokenizer: str, folder: str, end_id: int, block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bits"
        writer, end = None, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows, at = [], 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= SLICE_CHARS):
                    chars += len(texts[to])
                    to += 1
                code = encoder(tokenizer)
                if writer is None:
                    disk, path = fs.FileSystem.from_uri(folder)
                    writer = Writer(disk.open_output_stream(f"{path}/{name}"), max(code.vocab, end_id + 1), block)
                rows += [writer.add(np.frombuffer(ids + end, dtype="<u4")) for ids in code.encode(texts[at:to])]
                at = to
            if rows:
                first, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([name] * len(rows)), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "file", "first", "n_tokens"])
        if writer is not None:
            writer.close()

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, block: int = BLOCK) -> None:
    """Tokenizes docs (doc_id, text) into files of packed ids in a new folder, in ascending order of doc_id.

    tokenizer: path of a file of the tokenizers library, the same on every machine. Its special tokens' strings in
    a text are ordinary text, and none are added but end_id behind each document. folder: a folder that driver and
    executors share, by a path or URI that pyarrow knows. Null text is empty and has its end id; null ids stand
    first; rows of one id stand in the order of a hash of their text, equal rows anywhere among themselves; each
    counts. An empty table has no file and an empty index. Texts are encoded whole, whatever their length. Other
    columns of docs are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # The hash and row number cut what one id, or one row again and again, may fill.
    dealt = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    _make(folder)
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("file", StringType()), StructField("first", LongType()), StructField("n_tokens", LongType())])
    dealt.mapInArrow(_writing(tokenizer, folder, end_id, block), schema).write.parquet(f"{folder}/index")
    _tidy(docs.sparkSession, folder)


def _make(folder: str) -> None:
    disk, path = fs.FileSystem.from_uri(folder)
    disk.create_dir(path, recursive=True)


def _tidy(spark: SparkSession, folder: str) -> None:
    """Files that the index does not name are of attempts that failed: they go."""
    disk, path = fs.FileSystem.from_uri(folder)
    named = {r["file"] for r in spark.read.parquet(f"{folder}/index").select("file").distinct().collect()}
    for x in disk.get_file_info(fs.FileSelector(path)):
        if x.base_name.endswith(".bits") and x.base_name not in named:
            disk.delete_file(x.path)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file, first, n_tokens, start): start counts the ids of all documents before.

    Files follow each other by name; the table of their sizes has one row a file.
    """
    own = spark.read.parquet(f"{folder}/index")
    sizes = own.groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy("file").collect()
    before, rows = 0, []
    for r in sizes:
        rows.append((r["file"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "file string, before long")
    return own.join(F.broadcast(starts), "file").withColumn("start", F.col("before") + F.col("first")).drop("before")


def _reading(folder: str, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, path = fs.FileSystem.from_uri(folder)
        name, reader = None, None
        for batch in batches:
            files, first, n = (batch.column(c).to_pylist() for c in ("file", "first", "n_tokens"))
            at = 0
            while at < len(files):
                if files[at] != name:
                    name, reader = files[at], Reader(disk.open_input_file(f"{path}/{files[at]}"))
                to = at + 1
                while to < len(files) and files[to] == name and first[to] == first[to - 1] + n[to - 1] and first[to] + n[to] - first[at] <= CHUNK:
                    to += 1
                out = [*(batch.column(c).slice(at, to - at) for c in ("doc_id", "start", "n_tokens"))]
                if with_ids:
                    ids = reader.ids(first[at], first[to - 1] + n[to - 1] - first[at])
                    cuts = np.array([x - first[at] for x in [*first[at:to], first[to - 1] + n[to - 1]]], dtype=np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32))))
                elif to == at + 1:
                    # One document, of any length: by chunks.
                    crc = 0
                    for k in range(0, n[at], CHUNK):
                        crc = zlib.crc32(reader.ids(first[at] + k, min(CHUNK, n[at] - k)).tobytes(), crc)
                    out.append(pa.array([crc], pa.int64()))
                else:
                    ids = reader.ids(first[at], first[to - 1] + n[to - 1] - first[at])
                    out.append(pa.array([zlib.crc32(ids[a - first[at] : a - first[at] + k]) for a, k in zip(first[at:to], n[at:to], strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])
                at = to

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder that write() has filled: doc_id, start, n_tokens, ids (array of int)."""
    return _read(spark, folder, StructField("ids", ArrayType(IntegerType())))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """The same with ids_crc32, of the ids read as little-endian unsigned 32-bit integers, in place of the ids."""
    return _read(spark, folder, StructField("ids_crc32", LongType()))


def _read(spark: SparkSession, folder: str, what: StructField) -> DataFrame:
    rows = index(spark, folder).select("doc_id", "file", "first", "n_tokens", "start")
    schema = StructType([rows.schema["doc_id"], StructField("start", LongType()), StructField("n_tokens", LongType()), what])
    return rows.mapInArrow(_reading(folder, what.name == "ids"), schema)
