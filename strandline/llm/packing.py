"""Packing documents into fixed-length sequences along a Hilbert curve."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("curve", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])
_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


#: White space of the tokenizer's pre-tokenization (fixed values).
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, a batch of texts at a time.

    A single space between two characters that are not white space always starts a token of its
    own in the tokenizer's pre-tokenization, so a text may be cut before it, and equal words have
    equal ids: the words of a batch are looked up once each and their ids gathered. Texts with
    other white space next to a space go to the tokenizer whole.
    """

    _ODD = f"[{_WHITE}] | [{_WHITE}]"

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain}
        back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in back.values())}
        ranks = {}
        for piece, i in vocab.items():
            if all(c in back for c in piece) and piece != "<|endoftext|>":
                ranks[bytes(back[c] for c in piece)] = i
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = max(vocab.values()) + 1
        self.wide = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.bytes = np.zeros(self.size, dtype=np.int64)
        for piece, i in ranks.items():
            self.bytes[i] = len(piece)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each on its own, one after the other, and how many each has."""
        each = [np.array(self.encode(t), dtype=self.wide) for t in texts]
        return np.concatenate([np.zeros(0, dtype=self.wide), *each]), np.array([len(x) for x in each], dtype=np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words after a space, one after the other, and how many each has: all in one call, told apart by their bytes."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.array(self.encode(" " + " ".join(words.to_pylist())) if len(words) else [], dtype=self.wide)
        upto = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(size + 1), side="left") + 1
        return ids, np.diff(upto, prepend=0)

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null) one after the other, each with ``end`` behind, and how many each has."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, self._ODD).to_numpy(zero_copy_only=False).astype(bool)
        parts = pc.split_pattern(texts, " ")
        starts = parts.offsets.to_numpy().astype(np.int64)
        words = parts.flatten().dictionary_encode()
        code, names = words.indices.to_numpy().astype(np.int64), words.dictionary
        n_parts, lead = np.diff(starts), starts[:-1] - starts[0]
        row = np.repeat(np.arange(n), n_parts)
        inner = ~odd[row]
        inner[lead] = False
        # The pool: the batch's distinct words after a space, a space alone, first words and odd texts, the end.
        used = np.zeros(len(names), dtype=bool)
        used[code[inner]] = True
        blank = pc.equal(names, "").to_numpy(zero_copy_only=False)
        used[blank] = False
        ids, size = self._words(names.filter(pa.array(used)))
        firsts = names.take(pa.array(code[lead])).to_pylist()
        own, own_size = self._whole([" ", *[texts[i].as_py() if o else firsts[i] for i, o in enumerate(odd.tolist())]])
        pool = np.concatenate([ids, own, np.array([end], dtype=self.wide)])
        size = np.concatenate([size, own_size, [1]])
        at_word = np.cumsum(used) - 1
        at_word[blank] = len(size) - n - 2
        code = at_word[code]
        code[lead] = np.arange(n) + len(size) - n - 1
        keep = inner
        keep[lead] = True
        row, code = row[keep], code[keep]
        code = np.insert(code, np.searchsorted(row, np.arange(n), side="right"), len(size) - 1)
        row = np.sort(np.r_[row, np.arange(n)], kind="stable")
        each = size[code]
        ends = np.cumsum(each)
        flat = pool[np.repeat((np.cumsum(size) - size)[code] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.bincount(row, weights=each, minlength=n).astype(np.int64)

    def ids(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()), 0)[0][:-1]


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with integer coordinates below 2^bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _curve_keys(flat: np.ndarray, lengths: np.ndarray, width: int, bucket: np.ndarray, basis: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of documents whose ids stand one after another in ``flat``: hashed counts, to unit length, on ``basis``."""
    keys = np.zeros(len(lengths), dtype=np.int64)
    ends = np.cumsum(lengths)
    for lo in range(0, len(lengths), 512):
        hi = min(lo + 512, len(lengths))
        part = flat[(ends[lo - 1] if lo else 0) : ends[hi - 1]]
        row = np.repeat(np.arange(hi - lo, dtype=np.int64), lengths[lo:hi])
        counts = np.bincount(row * width + bucket[part], minlength=(hi - lo) * width).reshape(hi - lo, width)
        norm = np.sqrt((counts.astype(np.float64) ** 2).sum(1))
        at = (counts @ basis) / np.maximum(norm, 1e-12)[:, None]
        cells = np.clip((at + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
        keys[lo:hi] = hilbert_index(cells, bits)
    return keys


def pack(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1,
    width: int = 1024, dims: int = 3, bits: int = 20, seed: int = 1, chunk: int = 1 << 16,
) -> DataFrame:
    """Sequences of at most ``length`` tokens, neighbours on the curve side by side.

    Returns a row per piece: doc_id (of ``key``), start, length, ids_crc32, doc_tokens, sequence_id,
    offset and ids (little-endian, 16 bits where the vocabulary allows, else 32).

    Each text (null: empty) becomes ids and ``end_id``. Its ids are counted in ``width`` hashed
    buckets, brought to unit length, projected on ``dims`` random orthogonal directions and put on
    a Hilbert curve. Rows are range-sorted by (curve, key, start, crc); each range is cut every
    ``length`` tokens, so only the last sequence of a range can be short. Equal texts share a curve
    position and are told apart by key, and texts over ``chunk`` tokens travel in chunks, so
    neither copies nor long texts pile up in one task. Null keys and repeated rows are packed like
    any other row; an empty table gives no piece; other columns are ignored.
    """
    ids_stage = staged(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lambda batches: _tokenize(batches, tokenizer, end_id, width, dims, bits, seed, chunk),
        "doc_id long, start long, doc_tokens long, curve long, crc long, ids binary"), "pack-ids")
    order = ["curve", "doc_id", "start", "crc"]
    return ids_stage.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).mapInArrow(lambda b: _cut(b, length, chunk), PIECES)


def _tokenize(batches: Iterator[pa.RecordBatch], path, end_id, width, dims, bits, seed, chunk) -> Iterator[pa.RecordBatch]:
    import zstandard

    bpe, rng = ByteBpe(path), np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((width, dims)))[0]
    bucket = rng.integers(0, width, max(bpe.size, end_id + 1))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        keys, texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "")
        room = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(keys):  # a bounded share of a batch at a time
            hi = max(lo + 1, int(np.searchsorted(room, (room[lo - 1] if lo else 0) + 16_000_000, side="right")))
            flat, sizes = bpe.batch(texts.slice(lo, hi - lo), end_id)
            curve = _curve_keys(flat, sizes, width, bucket, basis, bits)
            rows = ([], [], [], [], [], [])
            ends = np.cumsum(sizes)
            for i in range(hi - lo):
                x = flat[ends[i] - sizes[i] : ends[i]]
                for s in range(0, len(x), chunk):
                    raw = x[s : s + chunk].tobytes()
                    for column, v in zip(rows, (keys[lo + i], s, len(x), int(curve[i]), zlib.crc32(raw), squeeze(raw)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _ROWS.types, strict=True)], schema=_ROWS)
            lo = hi


def _cut(batches: Iterator[pa.RecordBatch], length: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a sorted range; its sequences are numbered from its own number times 2^40."""
    import zstandard

    loosen = zstandard.ZstdDecompressor().decompress
    at, seq = 0, None
    for batch in batches:
        rows: tuple[list, ...] = tuple([] for _ in _OUT.names)
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "_p")]
        blobs = batch.column("ids")
        for i, (doc, start, total, p) in enumerate(zip(*columns, strict=True)):
            seq = p << 40 if seq is None else seq
            raw = loosen(blobs[i].as_py())
            x = np.frombuffer(raw, dtype=f"<u{len(raw) // min(chunk, total - start)}")
            s = 0
            while s < len(x):
                n = min(length - at, len(x) - s)
                part = x[s : s + n]
                for column, v in zip(rows, (doc, start + s, n, zlib.crc32(part.astype("<u4").tobytes()), total, seq, at, part.tobytes()), strict=True):
                    column.append(v)
                s, at = s + n, at + n
                if at == length:
                    seq, at = seq + 1, 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _OUT.types, strict=True)], schema=_OUT)
