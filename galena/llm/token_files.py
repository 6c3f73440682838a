"""Token-id files: a shared zstandard dictionary, one frame a document, an offset index.

Files are images of this layout (little-endian):

    magic "GTOK", u16 version, u16 bytes of an id, 32 bytes SHA-256 of the dictionary,
    u64 documents, u64 ids,
    u64 offsets of the frames, one more than documents, counted from the first frame,
    u32 ids of each document, i64 doc_id of each, u8 whether it has one,
    the frames

An image holds consecutive documents of ascending doc_id (null first; equal ids
by the hash of their text) and is closed at IMAGE_BYTES.  Images are the rows of
a Parquet table (part, seq, n_docs, n_ids, image), so that executors write and
read them in any store Spark knows; ``dictionary`` beside it holds the shared
dictionary and says whether it was trained or, where zstandard's trainer found too
little to train on, is made of raw id arrays.  ``part, seq`` give the order of images.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.llm.caches import claim, register
from galena.llm.chunks import Pieces, slices

MAGIC, VERSION = b"GTOK", 1
HEAD = struct.Struct("<4sHH32sQQ")
IMAGE_BYTES = 1 << 20
#: The dictionary is trained on the id arrays of so many distinct texts, those of the smallest hash. They are
#: cut into blocks, of which the driver gets so many bytes, again by hash, so from all parts of the texts.
SAMPLE_TEXTS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 4 << 20, 64 << 10
#: Sizes of blocks, tried until the trainer has enough of them.
BLOCKS = (4096, 512, 64)
END_ID = 0
#: What a worker remembers: pre-tokens, pieces between spaces, and the characters of each at most.
MEMO_PIECES, MEMO_CHUNKS, MEMO_CHARS = 150_000, 500_000, 48
#: Characters that are encoded together.
SLICE_CHARS = 6 << 20


#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder(Pieces):
    """What the tokenizers library's encode() gives, asked once for each pre-token that is remembered."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        model, code = library.model, "H" if library.get_vocab_size() <= 1 << 16 else "I"
        self.width = {"H": "<u2", "I": "<u4"}[code]
        added = library.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that look at what is beside them are not known here")
        # Added tokens are found in the text before it is cut into pre-tokens, the longest first.
        self.added = {t.content: array(code, [i]).tobytes() for i, t in added.items()}
        self.at_added = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")")

        space, tokenize = chr(_VISIBLE[32]), model.tokenize

        def ask(piece: str) -> bytes:
            # What encode() does with a pre-token, without the cutting that has been done here.
            word = piece[1:]
            shown = space + word if piece[:1] == " " and word.isascii() and word.isalpha() else piece.encode().decode("latin-1").translate(_VISIBLE)
            return array(code, [t.id for t in tokenize(shown)]).tobytes()

        super().__init__(ask, regex.compile(pattern).findall, MEMO_PIECES, MEMO_CHUNKS, MEMO_CHARS, self.width)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        plain = [t for t in texts if not any(c in t for c in self.added)]
        if len(plain) == len(texts):
            return super().encode_many(texts)
        done = iter(super().encode_many(plain))
        return [self.encode(t) if any(c in t for c in self.added) else next(done) for t in texts]

    def encode(self, text: str) -> bytes:
        if not any(c in text for c in self.added):
            return super().encode(text)
        encode = super().encode
        return b"".join(self.added[p] if p in self.added else encode(p) for p in self.at_added.split(text) if p)


_OWN: dict[tuple[str, str], Encoder] = {}
register("tokens", _OWN.clear)


def _encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process, however many tasks it runs."""
    claim("tokens", "tokens")
    if (path, pattern) not in _OWN:
        _OWN[path, pattern] = Encoder(path, pattern)
    return _OWN[path, pattern]


def train_dictionary(docs: DataFrame, tokenizer: str, pattern: str, text_col: str = "text") -> tuple[bytes, bool]:
    """A zstandard dictionary of id arrays, and whether it was trained.

    Where there is too little to train on, it is the id arrays themselves (eight
    zero bytes if there are none).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).filter("text <> ''")
    chosen = rows.select(F.col("h").alias("wanted")).distinct().orderBy("wanted").limit(SAMPLE_TEXTS)
    sample = rows.join(F.broadcast(chosen), F.col("h") == F.col("wanted"), "left_semi").groupBy("h").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, pattern)
        for batch in batches:
            for some, texts in slices(batch, 1):
                blocks = []
                for raw in encoder.encode_many(texts):
                    blocks += [raw[i : i + BLOCKS[0]] for i in range(0, len(raw), BLOCKS[0])]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["block"])

    blocks = sample.select("h", "text").mapInArrow(run, "block binary")
    arrays = [bytes(r.block) for r in blocks.orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BYTES // BLOCKS[0]).collect()]
    for size in BLOCKS:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, [a[i : i + size] for a in arrays for i in range(0, len(a), size)], level=3).as_bytes(), True
        except (zstandard.ZstdError, ValueError):
            continue
    return b"".join(arrays)[-DICTIONARY_BYTES:].rjust(8, b"\0"), False


class Image:
    """One file image: random access to its documents."""

    def __init__(self, raw: bytes, dictionary: bytes):
        magic, version, width, digest, self.n, self.ids = HEAD.unpack_from(raw)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token file of this version")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        at = HEAD.size
        self.offsets = np.frombuffer(raw, "<u8", self.n + 1, at)
        self.counts = np.frombuffer(raw, "<u4", self.n, at := at + 8 * (self.n + 1))
        self.doc_ids = np.frombuffer(raw, "<i8", self.n, at := at + 4 * self.n)
        self.has_id = np.frombuffer(raw, "u1", self.n, at := at + 8 * self.n)
        self.start, self.raw, self.width = at + self.n, raw, f"<u{width}"
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        size = int(self.counts[i]) * int(self.width[2])
        return np.frombuffer(self.open.decompress(self.raw[self.start + a : self.start + b], max_output_size=size), self.width)


def _image(width: str, dictionary: bytes, frames: list[bytes], counts: list[int], ids: list[int | None]) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    head = HEAD.pack(MAGIC, VERSION, int(width[2]), hashlib.sha256(dictionary).digest(), len(frames), sum(counts))
    arrays = (offsets, np.array(counts, "<u4"), np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], "u1"))
    return b"".join([head, *(a.tobytes() for a in arrays), *frames])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``path``/images and ``path``/dictionary.

    Every row's whole text is encoded and ended by END_ID; a null text is empty.
    Null doc_ids come first; rows of equal doc_id are each written, ordered by
    the hash of their text.  An empty table gives no image.  Other columns are
    not looked at.
    """
    spark = docs.sparkSession
    dictionary, trained = train_dictionary(docs, tokenizer, pattern, text_col)
    schema = "name string, sha256 string, dictionary binary, trained boolean"
    own = [("zstandard", hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary), trained)]
    spark.createDataFrame(own, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    sent = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shared = _encoder(tokenizer, pattern), sent.value
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared), write_checksum=False)
        end = np.array([END_ID], encoder.width).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        frames: list[bytes] = []
        counts: list[int] = []
        ids: list[int | None] = []

        def closed() -> pa.RecordBatch:
            values = [part], [seq], [len(frames)], [sum(counts)], [_image(encoder.width, shared, frames, counts, ids)]
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "seq", "n_docs", "n_ids", "image"])

        size = 0
        for batch in batches:
            for some, texts in slices(batch, 2, SLICE_CHARS):
                for doc_id, raw in zip(some.column(0).to_pylist(), encoder.encode_many(texts), strict=True):
                    frames.append(press.compress(raw + end))
                    counts.append(len(raw) // len(end) + 1)
                    ids.append(doc_id)
                    size += len(frames[-1])
                    if size >= IMAGE_BYTES:
                        yield closed()
                        frames, counts, ids, size, seq = [], [], [], 0, seq + 1
        if frames:
            yield closed()

    images = rows.mapInArrow(run, "part int, seq long, n_docs long, n_ids long, image binary")
    images.write.mode("overwrite").option("compression", "none").parquet(f"{path}/images")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (array) of all files under ``path``.

    One row for each row that was written: null and repeated doc_ids, empty texts
    (their end alone) and repeated rows have theirs.  No images give no rows.
    """
    shared = spark.sparkContext.broadcast(read_dictionary(spark, path))
    images = spark.read.parquet(f"{path}/images")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                image = Image(raw.as_py(), shared.value)
                crcs, arrays = [], []
                for i in range(image.n):
                    ids = image.document(i).astype("<u4")
                    crcs.append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        arrays.append(ids)
                n, ends = image.n, np.cumsum(image.counts, dtype="i8")
                columns = [
                    pa.array(np.full(n, part.as_py(), "i4")), pa.array(np.full(n, seq.as_py(), "i8")),
                    pa.array(image.doc_ids.astype("i8"), mask=image.has_id == 0),
                    pa.array(ends - image.counts), pa.array(image.counts.astype("i8")), pa.array(crcs, pa.int64()),
                ]
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(arrays, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = "part int, seq long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = images.select("part", "seq", "image").mapInArrow(run, fields)
    # A row for each part; then one for each image: neither has anything of a document.
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    within = Window.partitionBy("part").orderBy("seq")
    bases = images.select("part", "seq", "n_ids").join(parts.select("part", "base"), "part")
    bases = bases.select("part", "seq", (F.col("base") + F.sum("n_ids").over(within) - F.col("n_ids")).alias("base"))
    rest = ["n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return found.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), *rest)


def read_document(images: Iterable[tuple[bytes, bytes]], doc_id: int) -> np.ndarray | None:
    """The ids of one document from (image, dictionary) pairs: only its own frame is decompressed.

    Of several with that doc_id the first; None if there is none, or for a null one.
    """
    for raw, dictionary in images:
        image = Image(raw, dictionary)
        if len(at := np.flatnonzero((image.doc_ids == doc_id) & (image.has_id == 1))):
            return image.document(int(at[0]))
    return None
