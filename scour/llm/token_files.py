"""Token-ID output: files of frequency-ranked ids in byte-aligned codes of variable length.

Ids are replaced by their rank in the corpus, most frequent first, and written in one to four bytes.
Control bytes stand apart from the data: each has the lengths of four ids, two bits each, so that a
block is decoded by table lookup without a loop over ids. Documents are dealt by range of their key
and sorted; each range becomes one file, written as it streams by. A table lists the files of the
tasks that succeeded, with their place in the order; what a lost task left behind is not listed.

A file is a series of blocks (number of ids and of data bytes, control bytes, data), an index (the
keys of the documents, whether they have one, their numbers of ids), and a tail (place of the index,
number of documents, magic). Numbers are little-endian.

Defined cases: a null text is empty. Each document ends with the end id. Null keys come first;
documents that share a key are ordered by their ids. Very long documents cross blocks. Files without
documents are not written, an empty table gives an empty list of files. Other columns are not read.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scour.llm.bpe import UNSURE, WORDS, byte_symbols
from scour.llm.remembered import Remembered
from scour.sources.staging import scratch_path

MAGIC = b"RANKVB01"
BLOCK_IDS = 1 << 20
HEAD, TAIL = struct.Struct("<QQ"), struct.Struct("<QQ8s")
#: Bytes of the latest distinct pieces that a Python worker remembers, and as many from before.
REMEMBERED = 128 << 20
#: Documents that are encoded or written at a time.
GROUP_TEXTS = 256
# Python splits at these controls, the tokenizer doesn't take them for white space.
_CONTROLS = re.compile("[\x1c-\x1f]")

#: Lengths of the four ids of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1).astype(np.uint8)


# --- codes ----------------------------------------------------------------------------------------


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1).astype(np.uint8)
    used = np.arange(4) < lengths[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_block(count: int, control: bytes, data: bytes) -> np.ndarray:
    """The ranks of a block."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ranks = np.zeros((count, 4), np.uint8)
    ranks[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return ranks.view("<u4").reshape(-1)


# --- tokens ---------------------------------------------------------------------------------------


class PieceIds(Remembered):
    """The packed ids of pieces between white space, made with a tokenizer when first asked for.

    This tokenizer lower-cases, drops white space and merges only within words, so the ids of a text
    are those of its pieces, and those of a piece are those of its words. Pieces of Latin letters and
    common signs are cut into words here, which go to the tokenizer's model; other pieces, and those
    that hold a special token, go through the whole tokenizer.
    """

    def __init__(self, file: str):
        super().__init__(REMEMBERED)
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.symbols = "".join(byte_symbols())
        self.words = regex.compile(WORDS)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of one word of the tokenizer's own rules."""
        if not (word.isascii() and word.isalpha()):
            word = codecs.charmap_decode(word.encode(), "strict", self.symbols)[0]
        return array(self.code, [token.id for token in self.model.tokenize(word)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        packed = self.before.get(piece)
        if packed is None:
            word = piece.lower()
            if piece.isascii() and word == piece and piece.isalpha():
                packed = self.word(piece)
            elif UNSURE.search(piece):
                packed = self.whole(piece)
            elif word.isalpha():
                packed = self.word(word) if word == piece else self[word]
            elif piece[-1] in ".," and word[:-1].isalpha():
                packed = self[piece[:-1]] + self[piece[-1]]
            elif len(word) != len(piece) or any(map(piece.__contains__, self.special)):
                packed = self.whole(piece)
            else:
                parts = self.words.findall(word)
                packed = self.word(word) if parts == [word] else b"".join(map(self.__getitem__, parts))
        self.keep(piece, packed)
        return packed

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _CONTROLS.search(text):
            return self.whole(text)
        lower = text.lower()
        if lower == text or self.plain(text, lower):
            text = lower
        return b"".join(map(self.__getitem__, text.split()))

    def plain(self, text: str, lower: str) -> bool:
        """Whether a text may be lower-cased before it is cut, so that fewer of its pieces differ."""
        return (
            len(lower) == len(text)
            and not UNSURE.search(text)
            and not any(map(lower.__contains__, self.special))
        )


_encoders: dict[int, PieceIds] = {}


def _read_tokenizer(path: str) -> tuple[str, str, int]:
    """The file, the numpy type that holds its ids, and how many there are."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    pieces = PieceIds(content)
    return content, f"<u{array(pieces.code).itemsize}", pieces.tokenizer.get_vocab_size()


def _encoded(documents: DataFrame, rules: str, kind: str, size: int, end_id: int) -> DataFrame:
    """key and packed ids, with the end id, of each document; and a row of counts from each task.

    `documents` has the columns key and text.
    """
    content = documents.sparkSession.sparkContext.broadcast(rules)
    last = np.array([end_id], kind).tobytes()
    size = max(size, end_id + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hash(content.value)
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = PieceIds(content.value)
        encode = _encoders[name].encode
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_TEXTS):
                part = batch.slice(at, GROUP_TEXTS)
                packed = [encode(value) + last for value in part.column("text").to_pylist()]
                counts += np.bincount(np.frombuffer(b"".join(packed), kind), minlength=size)
                none = pa.nulls(len(packed), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(packed, pa.binary()), none], ["key", "ids", "counts"]
                )
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                ["key", "ids", "counts"],
            )

    return documents.mapInArrow(run, "key long, ids binary, counts binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """id and count, from the counts of the tasks. One row an id that is there."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            for packed in batch["counts"]:
                total = total + np.frombuffer(packed, np.int64)
        if not isinstance(total, int):
            present = np.flatnonzero(total)
            yield pd.DataFrame({"id": present, "count": total[present]})

    return (
        encoded.where("counts IS NOT NULL")
        .select("counts")
        .mapInPandas(read, "id long, count long")
        .groupBy("id")
        .agg(F.sum("count").alias("count"))
    )


# --- files ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TokenFiles:
    """Folder of the files, of their list and of the ids by rank."""

    folder: str

    @property
    def listing(self) -> str:
        return f"{self.folder}/list"

    @property
    def ranks(self) -> str:
        return f"{self.folder}/ranks"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def _ids_by_rank(spark: SparkSession, files: TokenFiles) -> np.ndarray:
    """The id of each rank; as many as the vocabulary has."""
    rows = spark.read.parquet(files.ranks).collect()
    ids = np.zeros(len(rows), np.uint32)
    for row in rows:
        ids[row["rank"]] = row["id"]
    return ids


def _write_ranks(encoded: DataFrame, files: TokenFiles) -> None:
    by_count = Window.orderBy(F.desc("count"), "id")
    id_counts(encoded).select(
        (F.row_number().over(by_count) - 1).alias("rank"), "id", "count"
    ).write.parquet(files.ranks)


class _Writer:
    """Streams documents into one file."""

    def __init__(self, path: str):
        system, place = _open(path)
        system.create_dir(os.path.dirname(place), recursive=True)
        self.stream = system.open_output_stream(place, compression=None)
        self.waiting: list[np.ndarray] = []
        self.waiting_ids = self.written = 0
        self.keys: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, keys: list[int | None], sizes: list[int], ranks: np.ndarray) -> None:
        """Some documents: how many ranks each has, and all of them in a row."""
        self.keys += keys
        self.sizes += sizes
        self.waiting.append(ranks)
        self.waiting_ids += len(ranks)
        while self.waiting_ids >= BLOCK_IDS:
            self._block()

    def _block(self) -> None:
        joined = np.concatenate(self.waiting)
        block, rest = joined[:BLOCK_IDS], joined[BLOCK_IDS:]
        control, data = encode_block(block)
        for part in (HEAD.pack(len(block), len(data)), control, data):
            self.stream.write(part)
            self.written += len(part)
        self.waiting, self.waiting_ids = [rest], len(rest)

    def close(self) -> None:
        if self.waiting_ids:
            self._block()
        present = np.array([key is not None for key in self.keys], np.uint8)
        keys = np.array([0 if key is None else key for key in self.keys], "<i8")
        for part in (keys, present, np.array(self.sizes, "<u8")):
            self.stream.write(part.tobytes())
        self.stream.write(TAIL.pack(self.written, len(self.keys), MAGIC))
        self.stream.close()


def write_token_files(
    documents: DataFrame,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
) -> TokenFiles:
    """Encode the documents and write them in ascending order of an integer key.

    The ids are encoded once and kept as a table until the files are written, as ranks need the
    counts of the whole corpus.
    """
    spark = documents.sparkSession
    files = TokenFiles(folder or scratch_path(spark, "tokens"))
    kept = f"{files.folder}/ids"
    rules, kind, size = _read_tokenizer(tokenizer)
    named = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    _encoded(named, rules, kind, size, end_id).withColumn("tie", F.crc32("ids")).withColumn(
        "row", F.monotonically_increasing_id()
    ).write.option("compression", "zstd").parquet(kept)
    encoded = spark.read.parquet(kept)
    tokens = encoded.where("ids IS NOT NULL").drop("counts")
    _write_ranks(encoded, files)
    ids = _ids_by_rank(spark, files)
    ranks = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    ranks[ids] = np.arange(len(ids), dtype=np.uint32)
    table = spark.sparkContext.broadcast(ranks)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, writer, path = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            if writer is None and len(batch):
                path = f"{files.folder}/part-{part:06d}-{uuid.uuid4().hex}.rvb"
                writer = _Writer(path)
            for at in range(0, len(batch), GROUP_TEXTS):
                piece = batch.iloc[at : at + GROUP_TEXTS]
                keys = [int(v) if k else None for v, k in zip(piece["key"], piece["known"])]
                packed = piece["ids"].tolist()
                sizes = [len(value) // np.dtype(kind).itemsize for value in packed]
                writer.add(keys, sizes, table.value[np.frombuffer(b"".join(packed), kind)])
        if writer is not None:
            writer.close()
            yield pd.DataFrame(
                {"part": [part], "path": [path], "documents": [len(writer.sizes)],
                 "tokens": [sum(writer.sizes)]}
            )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("row")]
    (
        tokens.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select(F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNotNull().alias("known"), "ids")
        .mapInPandas(write, "part int, path string, documents long, tokens long")
        .write.parquet(files.listing)
    )
    return files


def _documents(path: str, ids_by_rank: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """Keys and ids of the documents of a file, block by block."""
    system, place = _open(path)
    with system.open_input_file(place) as file:
        end = file.size()
        file.seek(end - TAIL.size)
        index, count, magic = TAIL.unpack(file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        file.seek(index)
        keys = np.frombuffer(file.read(8 * count), "<i8").tolist()
        present = np.frombuffer(file.read(count), np.uint8).tolist()
        sizes = np.frombuffer(file.read(8 * count), "<u8").tolist()
        file.seek(0)
        waiting, have = [], 0
        for key, known, size in zip(keys, present, sizes):
            while have < size:
                ids, data = HEAD.unpack(file.read(HEAD.size))
                control = file.read(-(-ids // 4))
                waiting.append(ids_by_rank[decode_block(ids, control, file.read(data))])
                have += ids
            joined = waiting[0] if len(waiting) == 1 else np.concatenate(waiting or [ids_by_rank[:0]])
            yield key if known else None, joined[:size]
            waiting, have = [joined[size:]], have - size


def read_token_files(spark: SparkSession, files: TokenFiles, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it) and packed ids of each document.

    Only the list of files, one row a file, is added up in order; each file is read in one task.
    """
    ids_by_rank = spark.sparkContext.broadcast(_ids_by_rank(spark, files))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = spark.read.parquet(files.listing).select(
        "part", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                rows, size = [], 0
                for value, ids in _documents(path, ids_by_rank.value):
                    rows.append((value, start, ids.astype("<u4").tobytes()))
                    start += len(ids)
                    size += 4 * len(ids)
                    if size >= BLOCK_IDS * 4:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)

    def _frame(rows: list) -> pd.DataFrame:
        keys, starts, packed = zip(*rows)
        return pd.DataFrame(
            {key: pd.array(keys, "Int64"), "start": np.array(starts, np.int64), "ids": list(packed)}
        )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "part").mapInPandas(
        read, f"`{key}` long, start long, ids binary"
    )
