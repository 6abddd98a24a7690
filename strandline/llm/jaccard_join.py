"""Exact Jaccard self-join of word n-gram sets by a token-group matrix, and its connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_bits, release, reread, staged, staged_small
from .components import connected_components

N, NUM, DEN = 5, 3, 4  # words in a shingle; similarity NUM/DEN or more
_MUL, _MARK = np.uint64(0x9E3779B97F4A7C15), np.iinfo(np.int64).min
_KEYS = 8
_SEND_TOKENS = 1_000_000  # held by a task before they are sent
_SHARE_TOKENS = 1 << 20  # most tokens that a task gets of a bucket, where classes are counted; a quarter of it, where sets are paired
_SENT = "bucket int, tokens binary, ids binary, groups binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("ids", pa.binary()), ("groups", pa.binary())])


# Sets of one text.


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles (few words: of the whole sequence; none: nothing)."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(self) > 400_000:
            self.clear()
        w = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(w) == 0:
            return w
        with np.errstate(over="ignore"):
            if len(w) < N:
                h = np.uint64(len(w))
                for x in w:
                    h = h * _MUL + x
                return mix(np.array([h]) ^ np.uint64(0x5DEECE66D))
            h = w[: len(w) - N + 1].copy()
            for k in range(1, N):
                h *= _MUL
                h += w[k : len(w) - N + 1 + k]
            return np.unique(mix(h))


def overlap_needed(n):
    """Least number of common shingles that a set of ``n`` must have with any partner."""
    return -(-NUM * n // DEN)


def prefix_length(n: int, part: int) -> int:
    """Of an n/part-fold prefix: two similar sets share at least prefix_matches() of their prefixes."""
    return n - overlap_needed(n) + max(1, n // part)


def prefix_matches(n, part: int):
    return np.maximum(1, overlap_needed(n) // part) if isinstance(n, np.ndarray) else max(1, overlap_needed(n) // part)


def set_hash(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


# Which sets share enough prefix tokens with sets of other groups.


def _send(batches, bits: int, part: int) -> Iterator[pa.RecordBatch]:
    """Prefix tokens by bucket. A token met in two groups of a task already is credited here and sent once, marked."""

    def flush(ids: list[int], groups: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        rows: tuple[list, ...] = ([], [], [], [])
        own, grp = np.array(ids, dtype=np.int64), np.array(groups, dtype=np.int64)
        at = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        t = np.concatenate(sets)
        order = np.lexsort((grp[at], t))
        t, at = t[order], at[order]
        g = grp[at]
        new = np.r_[True, t[1:] != t[:-1]]
        run = np.cumsum(new) - 1
        twice = np.zeros(run[-1] + 1, dtype=bool)
        twice[run[1:][~new[1:] & (g[1:] != g[:-1])]] = True
        shared = twice[run]
        credit = np.bincount(at[shared], minlength=len(sets))
        hit = np.flatnonzero(credit)
        if len(hit):
            for column, v in zip(rows, (-1 - int(own[0] % (1 << bits)), b"", own[hit].tobytes(), credit[hit].astype(np.int64).tobytes()), strict=True):
                column.append(v)
        keep = ~shared | new
        t, ids_ = t[keep], np.where(shared, _MARK, own[at])[keep]
        g = g[keep]
        lone = part == FIRST  # there, every set is a group of its own
        for b, s in _buckets(t, bits):
            for column, v in zip(rows, (b, t[s].tobytes(), _pack(ids_[s]), b"" if lone else g[s].tobytes()), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, _SENT_ARROW.types, strict=True)], schema=_SENT_ARROW)

    ids, groups, sets, n = [], [], [], 0
    for batch in batches:
        blobs = batch.column("tokens")
        for r, (i, g) in enumerate(zip(batch.column("i").to_pylist(), batch.column("g").to_pylist(), strict=True)):
            x = np.frombuffer(blobs[r].as_py(), dtype=np.uint64)
            ids.append(i)
            groups.append(g)
            sets.append(x)
            n += len(x)
            if n > _SEND_TOKENS:
                yield flush(ids, groups, sets)
                ids, groups, sets, n = [], [], [], 0
    if n:
        yield flush(ids, groups, sets)


FIRST, SECOND = 16, 4  # parts of the two prefix filters


def _buckets(t: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets (the leading ``bits``) of sorted tokens, with the place of each."""
    b = (t >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else [0]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(b[lo]), slice(lo, hi)


def _bucket_bits(bytes_: int, of_bucket: int, least: int) -> int:
    """So many leading bits that a bucket holds about ``of_bucket`` bytes at any size (31 would be petabytes)."""
    return min(31, max(least, (bytes_ // of_bucket).bit_length()))


def _pack(ids: np.ndarray) -> bytes:
    """Row numbers as a base and 32-bit steps where they fit, the mark as all ones."""
    real = ids[ids != _MARK]
    base = int(real.min()) if len(real) else 0
    if len(real) and int(real.max()) - base >= 0xFFFFFFFF:
        return b"\1" + ids.tobytes()
    return b"\0" + base.to_bytes(8, "little", signed=True) + np.where(ids == _MARK, 0xFFFFFFFF, ids - base).astype(np.uint32).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\1":
        return np.frombuffer(raw, dtype=np.int64, offset=1)
    x = np.frombuffer(raw, dtype=np.uint32, offset=9).astype(np.int64)
    return np.where(x == 0xFFFFFFFF, _MARK, x + int.from_bytes(raw[1:9], "little", signed=True))


def _credit(table: pa.Table) -> pa.Table:
    """Of one bucket: for each set, how many of its tokens other groups hold as well."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        ids = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("ids")])
        return pa.table({"i": ids, "c": np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("groups")])})
    t = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("tokens")])
    ids = np.concatenate([_unpack(x.as_py()) for x in table.column("ids")])
    raw = [x.as_py() for x in table.column("groups")]
    g = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in raw]) if any(raw) else ids
    order = np.lexsort((g, t))
    t, ids, g = t[order], ids[order], g[order]
    new = np.r_[True, t[1:] != t[:-1]]
    run = np.cumsum(new) - 1
    shared = np.zeros(run[-1] + 1, dtype=bool)
    shared[run[1:][~new[1:] & (g[1:] != g[:-1])]] = True
    shared[run[ids == _MARK]] = True
    got, counts = np.unique(ids[shared[run] & (ids != _MARK)], return_counts=True)
    return pa.table({"i": got, "c": counts.astype(np.int64)})


def _shared_counts(rows: DataFrame, part: int, tokens: int) -> DataFrame:
    """(i, c): how many prefix tokens of set i occur in other groups too. rows: i, g, tokens (the prefix); some 250,000 tokens a bucket."""
    bits = _bucket_bits(8 * tokens, 2_000_000, 8)
    sent = rows.select("i", "g", "tokens").mapInArrow(lambda b: _send(b, bits, part), _SENT)
    return sent.groupBy("bucket").applyInArrow(_credit, "i long, c long").groupBy("i").agg(F.sum("c").alias("c"))


# The join.


def _sets(batches) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for batch in batches:
        texts, out = batch.column("text"), ([], [], [])
        for r in range(batch.num_rows):
            x = hashes.shingles(texts[r].as_py())
            for column, v in zip(out, (len(x), set_hash(x) if len(x) else None, x[: prefix_length(len(x), FIRST)].tobytes() if len(x) else None), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("doc_id"), batch.column("text_hash"), *[pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.binary(), pa.binary()), strict=True)]], names=["i", "doc_id", "text_hash", "n", "sh", "tokens"])


def _full_sets(batches, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole sets and min-hash keys of the texts that may be wanted, each set once a task."""
    hashes, seen = WordHash(), set()
    rng = np.random.default_rng(10)
    muls = rng.integers(1, 1 << 63, 2 * _KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        texts, out = batch.column("text"), ([], [], [], [])
        for r in _passing(batch, wanted):
            x = hashes.shingles(texts[int(r)].as_py())
            if len(x) == 0 or (sh := set_hash(x)) in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add(sh)
            least = np.array([mix(x * m).min() for m in muls])
            keys = mix(least[::2] * _MUL + least[1::2] + np.arange(_KEYS, dtype=np.uint64)).view(np.int64)
            for column, v in zip(out, (sh, len(x), x.tobytes(), keys.tolist()), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["sh", "n", "tokens", "keys"])


def _bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash ``at`` below 2^bits: passes all that is in it (and a little more)."""
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    rows = hashes.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def _passing(batch: pa.RecordBatch, wanted: np.ndarray) -> np.ndarray:
    at = batch.column("at").to_numpy(zero_copy_only=False)
    return np.flatnonzero((wanted[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))


def _filtered(batches, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.take(pa.array(_passing(batch, wanted))).select(["r", "n", "tokens", "keys"])


def _verify(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("ta"), batch.column("tb")
        ok = [linked(np.frombuffer(a[r].as_py(), dtype=np.uint64), np.frombuffer(b[r].as_py(), dtype=np.uint64)) for r in range(batch.num_rows)]
        keep = pa.array(np.flatnonzero(np.array(ok, dtype=bool)))
        yield pa.RecordBatch.from_arrays([batch.column("u").take(keep), batch.column("v").take(keep)], names=["u", "v"])


def _deal(tokens: list[np.ndarray], own: list[np.ndarray], bits: int, names: list[str]) -> pa.RecordBatch:
    """Tokens with the numbers of their sets, a row for each bucket of tokens."""
    at = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    t = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.uint64)
    order = np.argsort(t, kind="stable")
    t, at = t[order], at[order]
    full, cut = zip(*_buckets(t, bits), strict=True) if len(t) else ((), ())
    columns = [pa.array([t[s].tobytes() for s in cut], pa.binary())] + [pa.array([x[at[s]].tobytes() for s in cut], pa.binary()) for x in own]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *columns], names=["bucket", "tokens", *names])


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _scatter(batches, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _deal([np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column("tokens")], _numbers(batch, "r", "c"), bits, ["ids", "classes"])


def _cut(batches, names: tuple[str, ...], by: str) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket as they are if it has one share, else cut into its shares by a hash of ``by``."""
    for batch in batches:
        shares = batch.column("shares").to_numpy(zero_copy_only=False)
        out: tuple[list, ...] = tuple([] for _ in range(3 + len(names)))
        for i in range(batch.num_rows):
            columns = [np.frombuffer(batch.column(c)[i].as_py(), dtype=np.uint64) for c in names]
            with np.errstate(over="ignore"):
                own = mix(columns[names.index(by)] * _MUL) % np.uint64(shares[i])
            for share in [0] if shares[i] == 1 else np.unique(own).tolist():
                picked = [x.tobytes() if shares[i] == 1 else x[own == share].tobytes() for x in columns]
                for column, v in zip(out, (batch.column("bucket")[i].as_py(), share, int(shares[i]), *picked), strict=True):
                    column.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * len(names))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["bucket", "share", "shares", *names])


_CUT = "bucket int, share long, shares long, "


def _shared_out(rows: DataFrame, names: tuple[str, ...], by: str, most: int) -> DataFrame:
    """The staged ``rows`` of buckets with (share, shares): a bucket of more than ``most`` tokens, as a token of very many sets makes, has several shares."""
    sizes = rows.groupBy("bucket").agg(F.sum(F.octet_length("tokens") / 8).alias("n"))
    large = staged_small(sizes.filter(F.col("n") > most).select("bucket", F.ceil(F.col("n") / most).cast("long").alias("shares")), "join-large")
    if large.isEmpty():
        return rows.select("bucket", F.lit(0).cast("long").alias("share"), F.lit(1).cast("long").alias("shares"), *names)
    told = reread(rows).join(large, "bucket", "left").select("bucket", *names, F.coalesce("shares", F.lit(1).cast("long")).alias("shares"))
    return told.mapInArrow(lambda b: _cut(b, names, by), _CUT + ", ".join(f"{c} binary" for c in names))


def _joined(table: pa.Table, **kinds) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_py(), dtype=k) for x in table.column(c)] or [np.zeros(0, dtype=k)]) for c, k in kinds.items()]


def _class_counts(table: pa.Table) -> pa.Table:
    """Of one share of a bucket: its tokens with the number of classes that hold them there, and the least and greatest of these."""
    t, c = _joined(table, tokens=np.uint64, classes=np.int64)
    order = np.lexsort((c, t))
    t, c = t[order], c[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    last = np.r_[first[1:], len(t)] - 1
    n = np.add.reduceat((np.r_[True, t[1:] != t[:-1]] | np.r_[True, c[1:] != c[:-1]]).astype(np.int64), first)
    blob = [x.tobytes() for x in (t[first], n, c[first], c[last])]
    return pa.table({"bucket": table.column("bucket")[:1], "share": table.column("share")[:1], "shares": table.column("shares")[:1]} | {k: pa.array([x], pa.binary()) for k, x in zip(("t", "n", "lo", "hi"), blob, strict=True)})


def _class_sums(table: pa.Table) -> pa.Table:
    """Of one bucket: its tokens with their classes over all shares, summed; 1 where all shares have one and the same class."""
    t, n, lo, hi = _joined(table, t=np.uint64, n=np.int64, lo=np.int64, hi=np.int64)
    order = np.argsort(t, kind="stable")
    t, n, lo, hi = t[order], n[order], lo[order], hi[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    one = np.minimum.reduceat(lo, first) == np.maximum.reduceat(hi, first)
    total = np.where(one, 1, np.add.reduceat(n, first))
    return pa.table({"bucket": table.column("bucket")[:1], "shares": table.column("shares")[:1], "t": pa.array([t[first].tobytes()], pa.binary()), "f": pa.array([total.tobytes()], pa.binary())})


def _frequencies(postings: pa.Table, sums: pa.Table) -> pa.Table:
    """Of one share of a bucket: for each set its tokens here with the number of classes that hold them."""
    t, r = _joined(postings, tokens=np.uint64, ids=np.int64)
    if not len(t):
        return pa.table({"r": pa.array([], pa.int64()), "t": pa.array([], pa.binary()), "f": pa.array([], pa.binary())})
    of, f = _joined(sums, t=np.uint64, f=np.int64)
    order = np.argsort(r, kind="stable")
    t, r = t[order], r[order]
    n = f[np.searchsorted(of, t)]
    edges = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
    cut = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"r": r[edges[:-1]], "t": pa.array([t[s].tobytes() for s in cut], pa.binary()), "f": pa.array([n[s].tobytes() for s in cut], pa.binary())})


def _with_frequencies(on: DataFrame, bits: int) -> DataFrame:
    """(r, t, f): pieces of each set's tokens with the number of classes that hold them; a count that several shares add up may be too large, but is the same for all, and is 1 only where it is 1."""
    dealt = staged(on.mapInArrow(lambda b: _scatter(b, bits), "bucket int, tokens binary, ids binary, classes binary"), "join-dealt")
    shared = lambda: _shared_out(dealt, ("tokens", "ids", "classes"), "ids", _SHARE_TOKENS)
    counted = shared().groupBy("bucket", "share").applyInArrow(_class_counts, _CUT + "t binary, n binary, lo binary, hi binary")
    sums = staged(counted.groupBy("bucket").applyInArrow(_class_sums, "bucket int, shares long, t binary, f binary"), "join-sums")
    each = sums.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "t", "f")
    return shared().select("bucket", "share", "tokens", "ids").groupBy("bucket", "share").cogroup(each.groupBy("bucket", "share")).applyInArrow(_frequencies, "r long, t binary, f binary")


def _rarest(batches, bits: int) -> Iterator[pa.RecordBatch]:
    """The rows of the token-group matrix that are needed: of each set, the prefix of its rarest tokens that a partner must share, if classes share them."""
    for batch in batches:
        kept = []
        for parts in batch.column("parts").to_pylist():
            t = np.concatenate([np.frombuffer(x["t"], dtype=np.uint64) for x in parts])
            f = np.concatenate([np.frombuffer(x["f"], dtype=np.int64) for x in parts])
            first = np.lexsort((t, f))[: len(t) - overlap_needed(len(t)) + 1]
            kept.append(t[first[f[first] > 1]])
        yield _deal(kept, _numbers(batch, "r", "c", "g"), bits, ["ids", "classes", "grps"])


_PAIRS = "q long, g long, qs binary, own binary, gs binary"
_BLOCK = 512


def _asking(own: np.ndarray, q: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """(q, g) of sets q in groups ``own`` and of ``groups`` of the same or a higher number."""
    i, j = np.nonzero(own[:, None] <= groups[None, :])
    return np.stack([q[i], groups[j]], 1)


_ASKED = pa.schema([("q", pa.int64()), ("g", pa.int64()), ("qs", pa.binary()), ("own", pa.binary()), ("gs", pa.binary())])


def _asked_rows(pairs: np.ndarray, blocks: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
    none, n = [None] * len(pairs), [None] * len(blocks)
    columns = [pairs[:, 0].tolist() + n, pairs[:, 1].tolist() + n, *[none + [x[i] for x in blocks] for i in range(3)]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ASKED.types, strict=True)], schema=_ASKED)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one cell of a bucket of tokens: (q, g) if set q shares a prefix token with a set of group g, of its own group number or a higher one, in another class.

    A cell holds one share of the bucket, or two, whose sets are then paired with each other only.
    A token of many sets in many groups gives blocks of sets and groups, to be paired elsewhere.
    """
    table = pa.Table.from_batches(batches)
    t, r, c, g = _joined(table, tokens=np.uint64, ids=np.int64, classes=np.int64, grps=np.int64)
    side = np.repeat(table.column("share").to_numpy(), [len(x.as_py()) // 8 for x in table.column("tokens")])
    two = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
    order = np.lexsort((g, t))
    t, r, c, g, side = t[order], r[order], c[order], g[order], side[order]
    edges = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True])
    no_pairs = np.zeros((0, 2), dtype=np.int64)
    seen, found, n_found, blocks = set(), [no_pairs], 0, []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo < 2 or (c[lo:hi] == c[lo]).all() or (key := r[lo:hi].tobytes()) in seen:
            continue
        seen.add(key)
        own, q, of = g[lo:hi], r[lo:hi], side[lo:hi] == side[lo]
        for mine, theirs in ((of, ~of), (~of, of)) if two else ((slice(None), slice(None)),):
            og, oq, groups = own[mine], q[mine], np.unique(own[theirs])
            if len(oq) * len(groups) <= _BLOCK * _BLOCK:
                found.append(_asking(og, oq, groups))
                n_found += len(found[-1])
                continue
            for i in range(0, len(oq), _BLOCK):
                blocks += [(oq[i : i + _BLOCK].tobytes(), og[i : i + _BLOCK].tobytes(), groups[j : j + _BLOCK].tobytes()) for j in range(0, len(groups), _BLOCK) if groups[j : j + _BLOCK][-1] >= og[i]]
                if len(blocks) > 1000:
                    yield _asked_rows(no_pairs, blocks)
                    blocks = []
        if n_found > 2_000_000:
            found = [np.unique(np.concatenate(found), axis=0)]
            if len(found[0]) > 1_000_000:
                yield _asked_rows(found[0], [])
                found = [no_pairs]
            n_found = len(found[0])
    yield _asked_rows(np.unique(np.concatenate(found), axis=0), blocks)


def _asked(matrix: DataFrame) -> DataFrame:
    """What sets ask what groups, from the rows (bucket, tokens, ids, classes, grps) of the token-group matrix.

    Each two shares of a large bucket meet in one cell of their own, and each share has one.
    """
    names = ("tokens", "ids", "classes", "grps")
    shared = _shared_out(matrix, names, "grps", max(1, _SHARE_TOKENS // 4))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("other")
    cells = shared.select("bucket", "share", other, *names).withColumns({"lo": F.least("share", "other"), "hi": F.greatest("share", "other")})
    return cells.drop("other").groupBy("bucket", "lo", "hi").applyInArrow(_candidates, _PAIRS)


def _paired(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            q, own, g = (np.frombuffer(row[k], dtype=np.int64) for k in ("qs", "own", "gs"))
            pairs = np.unique(_asking(own, q, g), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["q", "g"])


def _union(group: pa.Table) -> pa.Table:
    """The union of a group's sets: one column of the token-group matrix."""
    tokens = np.unique(np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in group.column("tokens")]))
    return pa.table({"g": group.column("g")[:1], "tokens": pa.array([tokens.tobytes()], pa.binary())})


def _bound(queries: pa.Table, unions: pa.Table) -> pa.Table:
    """Sets whose overlap with a group's union reaches what they need with any partner."""
    keep = []
    if queries.num_rows and unions.num_rows:
        t = np.frombuffer(unions.column("tokens")[0].as_py(), dtype=np.uint64)
        for i, blob in enumerate(queries.column("tokens")):
            q = np.frombuffer(blob.as_py(), dtype=np.uint64)
            at = np.minimum(np.searchsorted(t, q), len(t) - 1)
            if np.count_nonzero(t[at] == q) >= overlap_needed(len(q)):
                keep.append(i)
    return queries.select(["q", "g"]).take(pa.array(keep, pa.int64()))


def _open(queries: pa.Table, group: pa.Table) -> pa.Table:
    """Links between classes, found by holding the sets of one group against an opened one: overlaps with all its sets at once, from its token lists."""
    if not queries.num_rows or not group.num_rows:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in group.column("tokens")]
    size, cls = np.array([len(x) for x in sets]), group.column("c").to_numpy()
    t = np.concatenate(sets)
    order = np.argsort(t, kind="stable")
    t, who = t[order], np.repeat(np.arange(len(sets)), size)[order]
    found = set()
    for blob, c in zip(queries.column("tokens"), queries.column("c").to_pylist(), strict=True):
        q = np.frombuffer(blob.as_py(), dtype=np.uint64)
        lo, hi = np.searchsorted(t, q, side="left"), np.searchsorted(t, q, side="right")
        n = hi - lo
        ends = np.cumsum(n)
        members = who[np.repeat(lo - ends + n, n) + np.arange(ends[-1])]
        both = np.bincount(members, minlength=len(sets))
        hit = (DEN * both >= NUM * (len(q) + size - both)) & (cls != c)
        found.update((c, int(x)) for x in np.unique(cls[hit]))
    pairs = np.array(sorted({(min(p), max(p)) for p in found}), dtype=np.int64).reshape(-1, 2)
    return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})


def _meet(asking: DataFrame, sets: DataFrame, held: DataFrame, of_share: int, run, schema: str) -> DataFrame:
    """``run`` on the sets that ask a group (q, g) and what is held of it, in shares of a bounded number of askers, each with all that is held."""
    shares = staged(asking.groupBy("g").agg(F.ceil(F.count("*") / of_share).alias("shares")), "join-shares")
    share = F.pmod(F.xxhash64("q"), F.col("shares")).cast("long").alias("share")
    left = asking.join(shares, "g").select("g", share, "q").join(reread(sets).select(F.col("r").alias("q"), "c", "tokens"), "q").select("g", "share", "q", "c", "tokens")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1)).alias("share")
    right = held.join(reread(shares), "g").select("g", each, *[c for c in held.columns if c != "g"])
    return left.groupBy("g", "share").cogroup(right.groupBy("g", "share")).applyInArrow(run, schema)


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text", group_size: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest key reachable by links, its own included), text_hash and lead of every row.

    Two rows link if their sets of distinct N-word shingles (ASCII lower case) have a Jaccard
    similarity of 3/4 or more. Texts under N words have one shingle, texts without words none and
    no links. Equal sets are linked. Null texts are empty; a null key is below no other; rows are
    kept one for one, repeated rows too; only the named columns are read. ``lead`` tells components
    apart where keys are null or repeated: key and text_hash of the component's first row, null keys
    last; null in rows that link with no other.

    1. Shingle hashes are ordered by value. Similar sets share at least a known number of the
       tokens in a prefix of that order, so sets that share fewer prefix tokens with all others
       together have no link; that settles most texts by one exchange of prefix tokens.
    2. The rest, once per distinct set, are counted again on a longer prefix and grouped: min-hash
       keys lead each set to the set of its bucket that has most in common with others, the pair
       is verified, and connected sets are a class.
    3. Tokens are counted again, by class, on the prefix and then on whole sets: a set goes on only
       if enough of its tokens occur in other classes.
    4. What goes on is put in groups of about ``group_size`` sets with one leading set, so of
       similar texts. Tokens are ordered by the number of classes that hold them; of each set only
       the rarest, one of which a partner must share, enter the token-group matrix, which says
       what groups a set asks. The union of each group's sets is stored; a set's overlap with it
       bounds its overlap with any member. Only where the bound reaches what the set needs is
       the group opened, and the set compared with the whole group at once.
       A token that very many sets hold is dealt with in shares of its sets: counts are added up
       over shares, and each two shares are paired in a task of their own.
    Links of 2 and 4 are contracted to components. No link is missed (up to collisions of 64-bit
    hashes), no pair within a class is emitted, links between classes are emitted once a pair of
    classes, and each step's state is written in between.
    """
    src = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    numbered = src.select(F.monotonically_increasing_id().alias("i"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    docs = staged(numbered.mapInArrow(_sets, "i long, doc_id long, text_hash long, n long, sh binary, tokens binary"), "join-docs")
    some = docs.filter("n > 0")
    total = some.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    counts = _shared_counts(some.withColumn("g", F.col("i")), FIRST, total // 8)
    need = lambda part: F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * NUM / DEN) / part))
    kept = staged(some.select("i", "doc_id", "text_hash", "n", "sh").join(counts, "i").filter(F.col("c") >= need(FIRST)).select("doc_id", "text_hash", "sh"), "join-kept")
    narrow = staged(docs.select("doc_id", "text_hash", "n", "sh"), "join-rows")
    release(docs)
    at = lambda c, bits: F.pmod(F.xxhash64(c), F.lit(1 << bits)).alias("at")
    bits = filter_bits(kept.count())
    wanted = _bit_filter(kept.select(at("doc_id", bits)), bits)
    full = src.select(at("doc_id", bits), "text").mapInArrow(lambda b: _full_sets(b, wanted), "sh binary, n long, tokens binary, keys array<long>")
    full = full.join(kept.select("sh").distinct(), "sh", "left_semi").groupBy("sh").agg(F.first(F.struct("n", "tokens", "keys")).alias("s"))
    sets = staged(full.select("sh", "s.*").withColumn("r", F.monotonically_increasing_id()), "join-sets")

    cut = F.expr(f"substring(tokens, 1, cast(8 * (n - ceil(n * {NUM} / {DEN}) + greatest(1, floor(n / {SECOND}))) as int))")
    total = sets.agg(F.sum("n")).first()[0] or 0
    counts = _shared_counts(sets.select(F.col("r").alias("i"), F.col("r").alias("g"), cut.alias("tokens")), SECOND, total // 2)
    alike = staged(sets.select("r", "n").join(counts, sets["r"] == counts["i"]).filter(F.col("c") >= need(SECOND)).select("r", (F.col("c") / F.col("n")).alias("share")), "join-alike")
    bits = filter_bits(alike.count())
    wanted_sets = _bit_filter(alike.select(at("r", bits)), bits)
    some_sets = sets.select(at("r", bits), "r", "n", "tokens", "keys").mapInArrow(lambda b: _filtered(b, wanted_sets), "r long, n long, tokens binary, keys array<long>")
    some_sets = staged(some_sets, "join-some-sets")
    slim = staged(sets.select("r", "sh"), "join-set-ids")
    release(sets)

    # The set with the largest share of common tokens leads its bucket: copies of one text link to that text, not always to each other.
    keys = some_sets.select("r", F.explode("keys").alias("k")).join(alike, "r")
    pivots = staged(keys.groupBy("k").agg(F.min(F.struct((-F.col("share")).alias("rank"), "r")).alias("b"), F.count("*").alias("m")).filter("m > 1").select("k", "b.rank", F.col("b.r").alias("p")), "join-pivots")
    pairs = staged(keys.select("r", "k").join(pivots, "k").filter("p <> r").select("r", "p").distinct(), "join-pairs")
    blobs = some_sets.select("r", "tokens")
    both = pairs.join(blobs.withColumnRenamed("tokens", "ta"), "r").join(blobs.select(F.col("r").alias("p"), F.col("tokens").alias("tb")), "p")
    near = staged(both.select(F.col("r").alias("u"), F.col("p").alias("v"), "ta", "tb").mapInArrow(_verify, "u long, v long"), "join-near")
    classes = connected_components(near)

    classed = some_sets.select("r", "n", "tokens").join(classes, some_sets["r"] == classes["node"], "left").withColumn("c", F.coalesce("component", "r")).select("r", "n", "c", "tokens")
    on = staged(classed, "join-classed")
    for part in (SECOND, 1):  # of half the tokens, then of all
        total = on.agg(F.sum("n")).first()[0] or 0
        tokens = cut if part == SECOND else F.col("tokens")
        counts = _shared_counts(on.select(F.col("r").alias("i"), F.col("c").alias("g"), tokens.alias("tokens")), part, total)
        counts = counts.withColumnRenamed("c", "shared")
        fewer = staged(on.join(counts, on["r"] == counts["i"]).filter(F.col("shared") >= need(part)).select("r", "n", "c", "tokens"), "join-on")
        release(on)
        on = fewer
    leaders = keys.select("r", "k").join(pivots, "k").groupBy("r").agg(F.min(F.struct("rank", "p")).alias("b")).select("r", F.col("b.p").alias("p"))
    on = staged(on.join(leaders, "r", "left").withColumn("lead", F.coalesce("p", "r")).drop("p"), "join-led")
    parts = staged(on.groupBy("lead").agg(F.ceil(F.count("*") / group_size).alias("parts")), "join-parts")
    on = staged(on.join(parts, "lead").withColumn("g", F.xxhash64("lead", F.pmod(F.xxhash64("r"), F.col("parts")))).select("r", "c", "g", "tokens"), "join-groups")
    total = on.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    bits = _bucket_bits(total, 2_000_000, 3)
    parts = _with_frequencies(on, bits).groupBy("r").agg(F.collect_list(F.struct("t", "f")).alias("parts")).join(reread(on).select("r", "c", "g"), "r")  # a row for each set
    matrix = staged(parts.mapInArrow(lambda b: _rarest(b, bits), "bucket int, tokens binary, ids binary, classes binary, grps binary"), "join-matrix")
    asked = staged(_asked(matrix), "join-asked")
    release(matrix)
    blocks = asked.filter("q is null").select("qs", "own", "gs").repartition(F.xxhash64("qs", "gs")).mapInArrow(_paired, "q long, g long")
    asking = staged(asked.filter("q is not null").select("q", "g").unionByName(blocks).distinct(), "join-asking")
    unions = staged(on.select("g", "tokens").groupBy("g").applyInArrow(_union, "g long, tokens binary"), "join-unions")
    opened = staged(_meet(asking, on, unions, 4 * group_size, _bound, "q long, g long"), "join-opened")
    far = staged(_meet(opened, on, on.select("g", "c", "tokens"), 4 * group_size, _open, "u long, v long"), "join-far")
    release(on, asked, asking, unions, opened, some_sets)
    final = connected_components(near.union(far))

    label = slim.join(final, slim["r"] == final["node"], "left").select("sh", F.coalesce("component", "r").alias("label"))
    label = staged(label, "join-labels")
    with_label = kept.join(label, "sh")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    least = staged(with_label.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(first).alias("lead")), "join-least")
    of_set = staged(label.join(least, "label").select("sh", "component_id", F.struct("lead.doc_id", "lead.text_hash").alias("lead")), "join-of-set")
    out = narrow.join(of_set, "sh", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "lead")
