"""Token ids in binary files whose document boundaries are Elias-Fano coded.

File: the magic ``TBEF1``, a JSON header and the sections it names. ``ids`` is the
concatenated id array, two bytes each where the vocabulary fits, else four.
``ends`` and ``docs`` hold the end offset and the id of every document as two
monotone sequences in Elias-Fano form: ``low`` bits packed, high bits in unary,
and a position kept for every 256th one, from which select starts. No table of
64-bit offsets is stored or built.

Documents are range-partitioned by id; a task writes its range as one or more
files under names that follow from partition and part, through a temporary name
and a rename, so a task that runs twice leaves the same files. Starts over all
files come from a running sum over the manifest, one row per file.

A null text has no ids but its end id; a null doc_id sorts first and is counted
in the header. Documents of one id lie in order of their texts; repeated rows are
separate documents. Extra columns are ignored. A text of any length lies whole in one
file, which then exceeds ``FILE_IDS``. An empty table gives no files.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._common import durable, shared_dir, small_batches
from ._words import chunks

#: Ids in one file; a task's memory is a few times this.
FILE_IDS = 4_000_000
MAGIC = b"TBEF1\n"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about ``2 + log2(u / n)`` bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        field = np.zeros(int(ones[-1]) + 1, np.uint8)
        field[ones] = 1
        return cls(n, bits, low, np.packbits(field, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _ones(self, i: int, j: int) -> np.ndarray:
        """Positions of the ones i to j (exclusive), read from the sample before i on."""
        block = i // SAMPLE
        start = int(self.samples[block]) // 8
        after = (j - 1) // SAMPLE + 1
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        at = np.flatnonzero(np.unpackbits(self.high[start:stop], bitorder="little")) + start * 8
        at = at[at >= int(self.samples[block])]
        return at[i - block * SAMPLE : j - block * SAMPLE]

    def select_range(self, i: int, j: int) -> np.ndarray:
        """Values i to j (exclusive)."""
        if j <= i:
            return np.zeros(0, np.int64)
        upper = self._ones(i, j) - np.arange(i, j)
        b = self.low_bits
        if not b:
            return upper
        first = i * b
        bits = np.unpackbits(self.low[first // 8 : (j * b + 7) // 8], bitorder="little")[first % 8 :][: (j - i) * b]
        return (upper << b) | (bits.reshape(j - i, b).astype(np.int64) << np.arange(b)).sum(1)

    def select(self, i: int) -> int:
        return int(self.select_range(i, i + 1)[0])

    def sections(self, name: str) -> tuple[dict, dict]:
        return {f"{name}.n": self.n, f"{name}.low_bits": self.low_bits}, {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.samples": self.samples}

    @classmethod
    def from_sections(cls, name: str, head: dict, get: Callable) -> EliasFano:
        return cls(head[f"{name}.n"], head[f"{name}.low_bits"], get(f"{name}.low", np.uint8), get(f"{name}.high", np.uint8), get(f"{name}.samples", np.uint32))


def pack_file(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file; ``doc_ids`` ascend, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    head, parts = {"nulls": nulls, "base": base, "width": ids.dtype.itemsize}, {"ids": ids}
    for name, ef in (("ends", EliasFano.encode(ends)), ("docs", EliasFano.encode((known - base).astype(np.uint64)))):
        h, p = ef.sections(name)
        head |= h
        parts |= p
    at, head["parts"] = 0, {}
    for name, a in parts.items():
        head["parts"][name] = [at, a.nbytes]
        at += a.nbytes
    text = json.dumps(head).encode()
    return MAGIC + len(text).to_bytes(4, "little") + text + b"".join(a.tobytes() for a in parts.values())


class TokenFile:
    """A file's documents by rank: ``doc_id(i)``, ``bounds(i)``, ``tokens(i)``."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(data[len(MAGIC) : len(MAGIC) + 4], "little")
        at = len(MAGIC) + 4
        head = json.loads(data[at : at + n])
        get = lambda name, kind: np.frombuffer(data, kind, head["parts"][name][1] // np.dtype(kind).itemsize, at + n + head["parts"][name][0])
        self.nulls, self.base = head["nulls"], head["base"]
        self.ids = get("ids", np.dtype(f"<u{head['width']}"))
        self.ends, self.docs = (EliasFano.from_sections(x, head, get) for x in ("ends", "docs"))

    def __len__(self) -> int:
        return self.ends.n

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.docs.select(i - self.nulls) + self.base

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def tokens(self, i: int) -> np.ndarray:
        lo, hi = self.bounds(i)
        return self.ids[lo:hi]

    def all_bounds(self) -> tuple[list, np.ndarray]:
        docs = [None] * self.nulls + (self.docs.select_range(0, self.docs.n) + self.base).tolist()
        return docs, np.concatenate([[0], self.ends.select_range(0, self.ends.n)])


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letters for bytes that do not print: the n-th of them is letter 256 + n."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in prints)}


class WordEncoder(dict):
    """Ids of whole texts with a tokenizer that never joins across white space.

    Texts are cut at spaces and line feeds; each distinct piece is encoded once, on
    first sight, and kept, as most words of a text are frequent. The name of a special
    token in a text gets that token's id, as from the library.
    """

    LIMIT = 600_000

    def __init__(self, path: str, dtype):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.code = np.dtype(dtype).char
        spec = json.loads(self.tok.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        #: Letters, then marks: pieces that the normaliser only lower-cases and the cutter splits in two at most.
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"] and "[\\p{L}]+" in spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", "")
        self.letters, self.model, self.tails = _byte_letters(), self.tok.model, {"": b""}

    def _ids(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        """Letters with marks behind them go straight to the library's model, other pieces through all its steps."""
        core = word.rstrip(".,;:!?")
        if self.plain and core.isalpha() and "\u03a3" not in core and "\u0130" not in core and (core.isascii() or unicodedata.is_normalized("NFC", core)):
            low, tail = core.lower(), word[len(core) :]
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(self.letters)
            if tail not in self.tails:
                self.tails[tail] = self._ids(tail)
            found = self._ids(low) + self.tails[tail]
        else:
            found = array(self.code, self.tok.encode(word, add_special_tokens=False).ids).tobytes() if word else b""
        self[word] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > self.LIMIT:
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


_encoders: dict[tuple, WordEncoder] = {}


def encoder_for(path: str, dtype) -> WordEncoder:
    """One encoder per Python worker; its known pieces serve all tasks that the worker runs."""
    key = (path, str(dtype))
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, dtype)
    return _encoders[key]


def _write(fs_uri: str, data: bytes) -> None:
    fs, path = pa.fs.FileSystem.from_uri(fs_uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS, id_bytes: int = 2) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files under ``folder``; returns the manifest ``part, seq, path, n_docs, n_ids``.

    ``id_bytes`` is 2 for vocabularies of at most 65,536 ids, else 4.
    """
    small_batches(docs.sparkSession)
    dtype = np.dtype(f"<u{id_bytes}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, end = None, np.array([end_id], dtype).tobytes()
        ids, blobs, ends, total, seq = [], [], [], 0, 0

        def flush():
            path = f"{folder}/part-{part:06d}-{seq:06d}.tok"
            _write(path, pack_file(ids, np.array(ends, np.uint64), np.frombuffer(b"".join(blobs), dtype)))
            row = {"part": [part], "seq": [seq], "path": [path], "n_docs": [len(ids)], "n_ids": [total]}
            ids.clear(), blobs.clear(), ends.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for b in batches:
            encoder = encoder or encoder_for(tokenizer, dtype)
            for c in chunks(b):
                for d, e in zip(c.column("doc_id").to_pylist(), encoder.encode([t or "" for t in c.column("text").to_pylist()]), strict=True):
                    ids.append(d)
                    blobs += (e, end)
                    total += len(e) // id_bytes + 1
                    ends.append(total)
                    if total >= file_ids:
                        yield flush()
                        total, seq = 0, seq + 1
        if ids:
            yield flush()

    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(int(n), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return durable(ordered.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, offset in zip(b.column("path").to_pylist(), b.column("offset").to_pylist(), strict=True):
                fs, name = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(name) as f:
                    file = TokenFile(f.read())
                docs, cut = file.all_bounds()
                crc = [zlib.crc32(file.ids[i:j].astype("<u4").tobytes()) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(cut[:-1] + offset, pa.int64()), "n_tokens": pa.array(np.diff(cut), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("path", before.alias("offset")).repartition(n)
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest)


QUERIES: dict[str, Callable] = {"op9_token_files": query}
