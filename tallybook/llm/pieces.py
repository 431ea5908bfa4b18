"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is cut where no piece can cross: before a run of spaces, and around line
feeds. Distinct words of equal length form a matrix of code points and advance
together: prefix hashes give the hash of every substring, those are looked up in
the sorted keys of the pieces of that length, and for each end position the best
of the candidate starts is one vectorised maximum whose argument is the
backpointer. Words once encoded are kept per Python worker, up to a bound.

The best segmentation is that of the greatest sum of scores. Models of the unigram
kind bring scores as log probabilities (``scores="model"``). The scores of a BPE
model are merge ranks, which do not add up; for those ``scores="rank"`` takes the
log probability that Zipf's law gives a rank. Ids are therefore the best unigram
reading of such a vocabulary, not the library's merge order. Characters without a
piece become byte pieces. Decoding joins pieces and bytes and is exact for every
text without the space mark U+2581.

A null or empty text has no ids and decodes to an empty text. Repeated rows and
extra columns do no harm; a column ``ids`` of the input is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import small_batches
from ._words import chunks

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Zipf's law: the log probability of rank r is -log(r + ZIPF_SHIFT), up to a constant.
ZIPF_SHIFT = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary: ``encode(text)`` and ``decode(ids)``."""

    LIMIT = 300_000

    def __init__(self, path: str, scores: str = "rank"):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        names = {i: sp.id_to_piece(i) for i in normal}
        raw = np.array([sp.get_score(i) for i in normal])
        if scores == "rank":
            rank = np.empty(len(normal))
            rank[np.lexsort((np.arange(len(normal)), -raw))] = np.arange(len(normal))
            raw = -np.log(rank + ZIPF_SHIFT)
        self.score = dict(zip(normal, raw.astype(np.float32), strict=True))
        self.unknown = np.float32(raw.min() - UNKNOWN_PENALTY)
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk_id = sp.unk_id()
        self.table = [names[i].replace(MARK, " ").encode() if i in names else b"" for i in range(n)]
        for b, i in self.bytes.items():
            self.table[i] = bytes([b])
        crossing = [p for p in names.values() if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross word starts: {crossing[:3]}")
        free = "" if any("\n" in p for p in names.values()) else "\n"
        self.cut = re.compile(f" *[^ {free}]+" + (f"|{free}" if free else "") + "| +")
        by_len: dict[int, list[int]] = {}
        for i, p in names.items():
            by_len.setdefault(len(p), []).append(i)
        self.keys = {}
        for k, ids in by_len.items():
            code = np.array([[ord(c) for c in names[i]] for i in ids], np.uint64)
            h = np.zeros(len(ids), np.uint64)
            for j in range(k):
                h = h * _BASE + code[:, j] + np.uint64(1)
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces share a hash")
            self.keys[k] = h[order], np.array([self.score[i] for i in ids], np.float32)[order], np.array(ids, np.int32)[order]
        self.longest = max(self.keys)
        self.names, self.known = names, {}

    def _viterbi(self, words: list[str]) -> np.ndarray:
        """Ids of words of one length, a row each; -1 stands for a character without a piece, -2 fills up at the left."""
        n, size = len(words), len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64)
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * _BASE + code[:, i] + np.uint64(1)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        power = np.cumprod(np.full(self.longest + 1, _BASE))
        for k in range(1, min(self.longest, size) + 1):
            if k not in self.keys and k > 1:
                continue
            h = prefix[k:] - prefix[: size - k + 1] * power[k - 1]
            key, score, ids = self.keys.get(k, (np.zeros(1, np.uint64), np.full(1, -np.inf, np.float32), np.full(1, -1, np.int32)))
            at = np.minimum(np.searchsorted(key, h), len(key) - 1)
            ok = key[at] == h
            found[k] = np.where(ok, score[at], self.unknown if k == 1 else np.float32(-np.inf)), np.where(ok, ids[at], -1)
        lengths = sorted(found, reverse=True)
        best = np.full((size + 1, n), -np.inf, np.float32)
        best[0] = 0
        back = np.zeros((size + 1, n), np.int32)
        for end in range(1, size + 1):
            use = [k for k in lengths if k <= end]
            cand = np.stack([best[end - k] + found[k][0][end - k] for k in use])
            pick = cand.argmax(0)
            best[end] = cand[pick, np.arange(n)]
            back[end] = np.array(use)[pick]
        ids = np.full((lengths[0] + 1, size + 1, n), -1, np.int32)
        for k in found:
            ids[k, : size - k + 1] = found[k][1]
        rows, end, steps = np.arange(n), np.full(n, size), []
        while len(rows):
            k = back[end, rows]
            end = end - k
            step = np.full(n, -2, np.int32)
            step[rows] = ids[k, end, rows]
            steps.append(step)
            rows, end = rows[end > 0], end[end > 0]
        return np.stack(steps[::-1], 1)

    def _learn(self, new: list[str]) -> None:
        by_len: dict[int, list[str]] = {}
        for w in new:
            by_len.setdefault(len(w), []).append(w)
        for size, group in by_len.items():
            step = max(1, 60_000 // size)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                marked = [w.replace(" ", MARK) for w in part]
                ids = self._viterbi(marked)
                odd = np.flatnonzero((ids == -1).any(1))
                for r in odd:
                    self.known[part[r]] = np.array(self._with_bytes(marked[r], ids[r][ids[r] > -2].tolist()), "<u4").tobytes()
                ids[odd] = -2
                flat = ids[ids > -2]
                stop = np.cumsum((ids > -2).sum(1)) * 4
                plain = np.delete(np.arange(len(part)), odd).tolist()
                if b"".join(map(self.table.__getitem__, flat.tolist())).decode() != "".join(marked[r] for r in plain).replace(MARK, " "):
                    raise ValueError("a substring shares its hash with a piece")
                data = flat.astype("<u4").tobytes()
                stop = stop.tolist()
                self.known.update((part[r], data[stop[r - 1] if r else 0 : stop[r]]) for r in plain)

    def _with_bytes(self, word: str, ids: list[int]) -> list[int]:
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.names[i])
            else:
                out += [self.bytes.get(b, self.unk_id) for b in word[at].encode("utf-8", "surrogatepass")]
                at += 1
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        fresh = set().union(*cut) - self.known.keys() if cut else set()
        if len(self.known) + len(fresh) > self.LIMIT:
            self.known = {}
            fresh = set().union(*cut)
        if fresh:
            self._learn(sorted(fresh))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_loaded: dict[tuple, Pieces] = {}


def pieces_for(path: str, scores: str) -> Pieces:
    """One vocabulary per Python worker and model."""
    if (path, scores) not in _loaded:
        _loaded[path, scores] = Pieces(path, scores)
    return _loaded[path, scores]


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def encode(docs: DataFrame, model: str, scores: str = "rank") -> DataFrame:
    """``docs`` with the column ``ids``."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "ids"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"])

    def run(batches):
        for b in batches:
            p = pieces_for(model, scores)
            for c in chunks(b):
                blobs = p.encode_many(_texts(c))
                off = np.zeros(len(blobs) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in blobs], out=off[1:])
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.column(k) for k in keep), ids], [*keep, "ids"])

    return docs.select(keep).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, scores: str = "rank") -> DataFrame:
    """``rows(ids, ...)`` with the column ``decoded``; null ids decode to an empty text."""
    keep = [c for c in rows.columns if c != "decoded"]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "decoded string"])

    def run(batches):
        for b in batches:
            p = pieces_for(model, scores)
            text = pa.array([p.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), text], [*keep, "decoded"])

    return rows.select(keep).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, scores: str = "rank") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32 (as 32-bit little-endian integers), exact (decoding gives the text back).

    Both directions run in one pass, so ids need not leave the task.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            p = pieces_for(model, scores)
            for c in chunks(b):
                texts = _texts(c)
                blobs = p.encode_many(texts)
                same = [p.decode(np.frombuffer(x, "<u4").tolist()) == t for x, t in zip(blobs, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array([len(x) // 4 for x in blobs], pa.int64()), pa.array([zlib.crc32(x) for x in blobs], pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, exact boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable] = {"op4_pieces": query}
