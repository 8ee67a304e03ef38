"""Token ids of a corpus in binary files of entropy-coded blocks, written and read in parallel.

Writing sorts the documents by id over range partitions, and each task streams one file. Ids gather until a run of blocks
is full; they are counted, and the counts become the static frequency table that the run's blocks share. Blocks are
independent, with interleaved coder lanes, checkpoints and checksums (see rans.py). The file's foot has the place of each
segment, table and document. A task names its file by attempt, and only files listed in the returned manifest belong to the
output, so a lost executor or a repeated task leaves at most a file that nobody reads.

Reading deals segments to tasks: each decodes its own, owns the documents that start in it, and goes on into the
next segments only to end its last document.

A file: magic, runs (a frequency table, then segments), foot (numpy arrays), and the foot's length and crc32.

Ids come from the tokenizers library. A text's pre-tokens never cross a single space or line feed between other
characters, so ids are looked up by word in a worker's cache, which the library fills: words of letters alone, one pre-token
each, by its model without the steps around it. Texts with other white space
are cut at the safe places only, and texts with an added token's string go to the library whole.

Defined results: null and empty texts hold the end id alone. Null ids come first; rows of equal id are ordered by the
md5 of their text. An empty table gives no file and an empty result. Only the id and the text are read, so names of other
columns cannot clash. A text of any length is encoded whole; its words are held while it is (some 60 bytes each), its ids are
written in runs of a fixed size. Range sampling for the order takes a bounded number of ids and digests to the driver (Spark
samples 100 rows for each output partition), whatever the number of documents.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.rans import BLOCK_SEGMENTS, SEGMENT, Frequencies, decode_segment, encode_block
from faultline.llm.support import file_system, hash_sample, materialise, new_folder, table, worker_value

MAGIC = b"FLTOKEN1"
TAIL = "<QI"  # length and crc32 of the foot
TAIL_BYTES = struct.calcsize(TAIL)
#: Words a worker keeps, of at most so many characters.
CACHED_WORDS, WORD_CHARS = 800_000, 32
#: Words that every worker is given at the start, counted in about so many rows of texts of at most so many characters. They
#: save time only: the ids do not depend on them.
FREQUENT_WORDS, SAMPLE_ROWS, SAMPLE_CHARS = 65_536, 1_000, 20_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Ids that share a frequency table.
RUN = 4 * BLOCK_SEGMENTS * SEGMENT
#: How a byte-level vocabulary spells bytes (marks stand for themselves), and letters that are such in every version of Unicode.
BYTE_LEVEL = {byte: chr(256 + at) for at, byte in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
LETTERS = {c: c.encode().decode("latin-1").translate(BYTE_LEVEL) for c in map(chr, range(0x250)) if c.isalpha()}
SAFE = re.compile(r"(?<=\S)[ \n](?=\S)")
#: Segments that a reading task decodes, about.
TASK_SEGMENTS = 16
MANIFEST = "path string, file_no int, n_documents long, n_tokens long, n_segments int, n_bytes long"


class WordIds(dict):
    """The ids of a word with the space or line feed before it, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_json: str, frequent: tuple[str, bytes, bytes] = ("", b"", b"")):
        super().__init__()
        words, lengths, ids = frequent
        at = 0
        for word, length in zip(words.split("\0"), lengths, strict=False):
            self[word] = ids[at : at + 4 * length]
            at += 4 * length
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model if splits_at_letters(tokenizer_json) else None

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_word(self, word: str) -> bytes:
        """The ids of a word. Letters after at most one space are one pre-token, which the library's model takes as it is."""
        if self.model is None:
            return self.encode(word)
        before = word[:1] if word[:1] in " \n" else ""
        try:
            spelt = "".join(map(LETTERS.__getitem__, word[len(before) :]))
        except KeyError:
            return self.encode(word)
        if before == "\n":
            return self["\n"] + self[word[1:]] if spelt else self.encode(word)
        return array("I", [token.id for token in self.model.tokenize(BYTE_LEVEL[0x20] + spelt if before else spelt)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        body = word.rstrip(PUNCTUATION)
        if len(body) < len(word) and body[-1:].isalpha():  # a pre-token ends between a letter and punctuation
            ids = self[body] + self[word[len(body) :]]
        else:
            ids = self.encode_word(word)
        if len(self) < CACHED_WORDS and len(word) <= WORD_CHARS:
            self[word] = ids
        return ids

    def of_text(self, text: str | None) -> bytes:
        """The ids of a whole text."""
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.encode(text)
        return b"".join(map(self.__getitem__, words_with_separators(text)))


def splits_at_letters(tokenizer_json: str) -> bool:
    """Whether a tokenizer only cuts a text by the byte-level pattern before its model merges bytes."""
    parts = json.loads(tokenizer_json)
    pre, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    by_pattern = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return parts.get("normalizer") is None and by_pattern and model.get("type") == "BPE" and not model.get("dropout")


def words_with_separators(text: str) -> list[str]:
    """The words of a text, each with the space or line feed before it."""
    if "\0" not in text and " ".join(text.split()) == text.replace("\n", " "):
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
    return safe_parts(text)


def safe_parts(text: str) -> list[str]:
    """Cuts before a single space or line feed that stands between two characters that aren't white space."""
    cuts = [0, *(found.start() for found in SAFE.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def word_ids(shared: Broadcast) -> WordIds:
    """The worker's cache for the tokenizer and the frequent words in the broadcast `shared`."""
    tokenizer_json, frequent = shared.value
    return worker_value(("word ids", zlib.crc32(tokenizer_json.encode()), zlib.crc32(frequent[2])), lambda: WordIds(tokenizer_json, frequent))


def frequent_words(texts: DataFrame, tokenizer_json: str) -> tuple[str, bytes, bytes]:
    """Frequent words of a bounded sample, joined by a character that none has, the number of ids of each, and the ids.

    `texts` has the columns doc_id and text.
    """
    sample = hash_sample(texts.where(F.length("text") <= SAMPLE_CHARS), SAMPLE_ROWS, "doc_id").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counted.update(w for w in words_with_separators(text) if 0 < len(w) <= WORD_CHARS and "\0" not in w)
        known = WordIds(tokenizer_json)
        best = [(w, known[w]) for w, n in counted.most_common(FREQUENT_WORDS) if n > 1 and not any(a in w for a in known.added)]
        best = [(w, ids) for w, ids in best if len(ids) < 4 * 256]
        columns = ["\0".join(w for w, _ in best)], [bytes(len(ids) // 4 for _, ids in best)], [b"".join(ids for _, ids in best)]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["words", "lengths", "ids"])

    rows = sample.coalesce(1).mapInArrow(count, "words string, lengths binary, ids binary").collect()
    return (rows[0].words, bytes(rows[0].lengths), bytes(rows[0].ids)) if rows else ("", b"", b"")


class FileWriter:
    """Streams documents into one file, a run of blocks at a time."""

    def __init__(self, path: str):
        system, place = file_system(path)
        self.out = system.open_output_stream(place)
        self.out.write(MAGIC)
        self.size = len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0
        self.places: list[tuple[int, int, int]] = []
        self.doc_id: list[int | None] = []
        self.doc_tokens: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_id.append(doc_id)
        self.doc_tokens.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= RUN:
            waiting = np.concatenate(self.held)
            full = len(waiting) // RUN * RUN
            for at in range(0, full, RUN):
                self._run(waiting[at : at + RUN])
            self.held, self.n_held = [waiting[full:]], len(waiting) - full

    def _run(self, ids: np.ndarray) -> None:
        frequencies = Frequencies.from_counts(np.bincount(ids))
        packed, table_at = frequencies.packed(), self.size
        self.out.write(packed)
        self.size += len(packed)
        for at in range(0, len(ids), BLOCK_SEGMENTS * SEGMENT):
            for segment in encode_block(ids[at : at + BLOCK_SEGMENTS * SEGMENT], frequencies):
                self.places.append((self.size, len(segment), table_at))
                self.out.write(segment)
                self.size += len(segment)

    def close(self) -> None:
        if self.n_held:
            self._run(np.concatenate(self.held))
        foot = io.BytesIO()
        np.savez(
            foot,
            places=np.array(self.places, np.int64).reshape(-1, 3),
            doc_id=np.array([x or 0 for x in self.doc_id], np.int64),
            doc_null=np.array([x is None for x in self.doc_id], bool),
            doc_tokens=np.array(self.doc_tokens, np.int64),
        )
        packed = zlib.compress(foot.getvalue(), 1)
        self.out.write(packed + struct.pack(TAIL, len(packed), zlib.crc32(packed)))
        self.size += len(packed) + TAIL_BYTES
        self.out.close()


class FileReader:
    """Random access to the segments and documents of one file."""

    def __init__(self, path: str):
        system, place = file_system(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        length, checksum = struct.unpack(TAIL, self.file.read_at(TAIL_BYTES, size - TAIL_BYTES))
        packed = self.file.read_at(length, size - TAIL_BYTES - length)
        if zlib.crc32(packed) != checksum or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is damaged")
        foot = np.load(io.BytesIO(zlib.decompress(packed)))
        self.places, self.doc_id, self.doc_null, self.doc_tokens = (foot[k] for k in ("places", "doc_id", "doc_null", "doc_tokens"))
        self.doc_start = np.concatenate([[0], np.cumsum(self.doc_tokens)]).astype(np.int64)
        self.table_at = -1

    def segment(self, number: int) -> np.ndarray:
        start, length, table_at = map(int, self.places[number])
        if table_at != self.table_at:  # the table ends where the run's first segment starts
            end = int(self.places[self.places[:, 2] == table_at, 0].min())
            self.frequencies = Frequencies.unpacked(self.file.read_at(end - table_at, table_at))
            self.slots, self.table_at = self.frequencies.slots(), table_at
        return decode_segment(self.file.read_at(length, start), self.frequencies, self.slots)

    def documents(self, first: int, last: int) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Id, start in the file and parts of the ids of each document that starts in segments first to last - 1."""
        at, held = first, self.segment(first)
        begin, end = np.searchsorted(self.doc_start[:-1], [first * SEGMENT, last * SEGMENT])
        for number in range(int(begin), int(end)):
            start, stop = int(self.doc_start[number]), int(self.doc_start[number + 1])
            parts: list[np.ndarray] = []
            while True:
                base = at * SEGMENT
                if start < base + len(held):
                    part = held[max(start - base, 0) : stop - base]
                    parts.append(part)
                if stop <= base + len(held):
                    break
                at += 1
                held = self.segment(at)
            yield (None if self.doc_null[number] else int(self.doc_id[number])), start, iter(parts)

    def close(self) -> None:
        self.file.close()


def write_token_files(documents: DataFrame, folder: str, tokenizer_json: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write `documents` into `folder` and return the manifest, a row for each file."""
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast((tokenizer_json, frequent_words(texts, tokenizer_json)))
    if file_system(folder)[0].type_name == "local":
        file_system(folder)[0].create_dir(file_system(folder)[1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, ids, writer = TaskContext.get(), word_ids(shared), None
        path = f"{folder}/tokens-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                writer = writer or FileWriter(path)
                writer.add(number, np.append(np.frombuffer(ids.of_text(value), "<u4"), np.uint32(end_id)))
        if writer:
            writer.close()
            row = {"path": path, "file_no": context.partitionId(), "n_documents": len(writer.doc_id), "n_tokens": writer.n_tokens, "n_segments": len(writer.places), "n_bytes": writer.size}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("file_no", pa.int32()), ("n_documents", pa.int64()), ("n_tokens", pa.int64()), ("n_segments", pa.int32()), ("n_bytes", pa.int64())]))

    ordered = texts.orderBy("doc_id", F.md5("text"))
    return materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, decoded in parallel.

    Tasks get runs of neighbouring segments, not files. The running total is over one manifest row for each file.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = manifest.withColumn("before", before).select("path", "before", F.explode(F.sequence(F.lit(0), F.col("n_segments") - 1)).alias("segment"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = "", None
        for batch in batches:
            for piece in batch.to_pylist():
                rows = []
                if reader is None or path != piece["path"]:
                    path, reader = piece["path"], FileReader(piece["path"])
                for doc_id, start, parts in reader.documents(piece["segment"], piece["segment"] + 1):
                    crc = length = 0
                    for part in parts:
                        crc, length = zlib.crc32(part.astype("<u4").tobytes(), crc), length + len(part)
                    rows.append((doc_id, piece["before"] + start, length, crc))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    segments = manifest.agg(F.sum("n_segments")).first()[0] or 0
    run = F.floor(F.col("segment") / TASK_SEGMENTS)
    dealt = pieces.repartition(-(-segments // TASK_SEGMENTS) or 1, "path", run).sortWithinPartitions("path", "segment")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer_json = file.read()
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), tokenizer_json, end_id=2))
