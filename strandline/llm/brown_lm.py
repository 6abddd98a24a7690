"""Class-based bigram language model with Brown (exchange) clustering, trained and applied over the whole corpus."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged

#: Words with a unit of their own and an exact count in every worker; those clustered one by one first; groups of rarer words by ending.
HEAD, LEADS, ENDINGS = 1 << 17, 768, 256
#: Smoothing: of class transitions, units in a class, words in a group.
ALPHA, BETA, DELTA = 5.0, 0.5, 0.5
SWEEPS = 3
END = b"\n"  # its key; no word holds white space
_KEEP = 400_000
_COUNTS = pa.schema([("key", pa.binary()), ("grp", pa.int32()), ("n", pa.int64())])
_CODED = pa.schema([("i", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("codes", pa.binary()), ("key", pa.binary()), ("grp", pa.int32()), ("n", pa.int64())])
_SCORED = pa.schema([("i", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("k", pa.int64()), ("b", pa.float64()), ("s", pa.float64())])
_SENT = pa.schema([("strand", pa.int64()), ("bucket", pa.int32()), ("side", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
_SENT_SQL = "strand long, bucket int, side int, at binary, n binary"
_SHARE = 1024  # units whose contexts are gathered together
_FAN = 32  # tasks whose contexts are added up at once


def key_of(word: bytes) -> bytes:
    """A word of up to 15 bytes itself, a longer one's MD5 (16 bytes)."""
    return word if len(word) < 16 else hashlib.md5(word, usedforsecurity=False).digest()


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        texts = batch.column("text")
        for i, d in enumerate(batch.column("doc_id").to_pylist()):
            if not held_out(d):
                yield words_of(texts[i].as_py())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    docs = 0

    def rows() -> pa.RecordBatch:
        words = list(seen)
        columns = ([key_of(w) for w in words] + [END] * (docs > 0), [group_of(w) for w in words] + [-1] * (docs > 0), list(seen.values()) + [docs] * (docs > 0))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COUNTS.types, strict=True)], schema=_COUNTS)

    for words in _training(batches):
        seen.update(words)
        docs += 1
        if len(seen) > _KEEP:
            yield rows()
            seen.clear()
            docs = 0
    yield rows()


class Codes(dict):
    """Word -> its unit: its row of the head, or HEAD size + group; filled as words come, bounded."""

    def __init__(self, head: dict[bytes, int]):
        super().__init__()
        self.head = head

    def __missing__(self, word: bytes) -> int:
        code = self.head.get(key_of(word))
        code = len(self.head) + group_of(word) if code is None else code
        if len(word) < 64:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _KEEP:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint32, count=len(words))


def _encode(batches: Iterator[pa.RecordBatch], head: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """A row for each text with the units of its words, and one for each of its distinct words outside the head."""
    codes, size = Codes(head), len(head)
    for batch in batches:
        ids, rows, texts = batch.column("doc_id").to_pylist(), batch.column("_i").to_pylist(), batch.column("text")
        out: tuple[list, ...] = tuple([] for _ in _CODED.names)

        def add(*values) -> None:
            for column, v in zip(out, values, strict=True):  # noqa: B023
                column.append(v)

        for j, (i, d) in enumerate(zip(rows, ids, strict=True)):
            words = words_of(texts[j].as_py())
            c = codes.of(words)
            add(i, d, held_out(d), len(words) + 1, c.tobytes(), None, None, None)
            for w, n in Counter([words[p] for p in np.flatnonzero(c >= size)]).items():
                add(i, None, None, None, None, key_of(w), group_of(w), n)
            if len(out[0]) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _CODED.types, strict=True)], schema=_CODED)
                out = tuple([] for _ in _CODED.names)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _CODED.types, strict=True)], schema=_CODED)


def _streams(batches: Iterator[pa.RecordBatch], end: int, most: int = 2_500_000) -> Iterator[np.ndarray]:
    """Units of many texts one after the other, the end before, between and after them."""
    stop = np.array([end], dtype=np.uint32)
    held, n = [stop], 0
    for batch in batches:
        for blob in batch.column("codes"):
            held += [np.frombuffer(blob.as_py(), dtype=np.uint32), stop]
            n += len(held[-2]) + 1
            if n > most:
                yield np.concatenate(held)
                held, n = [stop], 0
    if n:
        yield np.concatenate(held)


def _count_pairs(batches: Iterator[pa.RecordBatch], onto: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours, each unit mapped by ``onto`` to a number below n."""
    total = np.zeros(n * n, dtype=np.int64)
    for u in _streams(batches, len(onto) - 1):
        u = onto[u]
        total += np.bincount(u[:-1] * n + u[1:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])


def _contexts(batches: Iterator[pa.RecordBatch], cls: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Counts of (unit, class to its right) and (unit, class to its left), packed by share of the units; strand: the task."""
    strand = TaskContext.get().partitionId()
    for u in _streams(batches, len(cls) - 1):
        g, rows = cls[u].astype(np.int64), []
        for side, x in enumerate((u[:-1].astype(np.int64) * k + g[1:], u[1:].astype(np.int64) * k + g[:-1])):
            at, n = np.unique(x.astype(np.uint32) if len(cls) * k < 1 << 32 else x, return_counts=True)
            share = at // (_SHARE * k)
            edges = np.flatnonzero(np.r_[True, share[1:] != share[:-1], True])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                rows.append((strand, int(share[lo]), side, *_packed(at[lo:hi].astype(np.int64) - int(share[lo]) * _SHARE * k, n[lo:hi])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SENT.types, strict=True)], schema=_SENT)


def _packed(at: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    return press(np.diff(at, prepend=0).astype(np.uint32).tobytes()), press(n.astype(np.int64).tobytes())


def _summed(table: pa.Table, k: int) -> np.ndarray:
    """Counts of one share of the units, two sides, from packed ones."""
    import zstandard

    loosen, total = zstandard.ZstdDecompressor().decompress, np.zeros((2, _SHARE * k), dtype=np.int64)
    for side, at, n in zip(table.column("side").to_pylist(), table.column("at"), table.column("n"), strict=True):
        total[side][np.cumsum(np.frombuffer(loosen(at.as_py()), dtype=np.uint32).astype(np.int64))] += np.frombuffer(loosen(n.as_py()), dtype=np.int64)
    return total


def _add_up(key: tuple, table: pa.Table, k: int) -> pa.Table:
    """The packed counts of one share from up to _FAN strands, as those of one strand."""
    strand, bucket = key[0].as_py(), key[1].as_py()
    rows = [(strand, bucket, side, *_packed(at, x[at])) for side, x in enumerate(_summed(table, k)) if len(at := np.flatnonzero(x))]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _SENT.types, strict=True)], schema=_SENT)


def _gather(table: pa.Table, cls: np.ndarray, k: int) -> pa.Table:
    """The summed contexts of one share of the units, and what they add to the counts of class pairs."""
    import zstandard

    bucket, total, m = table.column("bucket")[0].as_py(), _summed(table, k), np.zeros((k, k), dtype=np.int64)
    own = cls[bucket * _SHARE : (bucket + 1) * _SHARE]
    np.add.at(m, own, total[0].reshape(_SHARE, k)[: len(own)])
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "counts": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())], "m": [m.tobytes()]})


def best_classes(right: np.ndarray, left: np.ndarray, own: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For units of classes ``own`` with class counts to both sides: the class that raises the likelihood most, to first order in the unit's counts.

    A unit's own counts are taken out of its class first. The last class is the end's; a unit
    without counts stays; equal gains fall to the lower class.
    """
    k = len(m)
    log = lambda x: np.log(np.maximum(x, 0) + 0.5)
    out, in_ = right.sum(1, keepdims=True), left.sum(1, keepdims=True)
    rows, cols = m.sum(1), m.sum(0)
    score = right @ log(m).T + left @ log(m) - out * log(rows)[None, :] - in_ * log(cols)[None, :]
    here = (right * log(m[own] - right)).sum(1) + (left * log(m[:, own].T - left)).sum(1) - (out[:, 0] * log(rows[own] - out[:, 0])) - (in_[:, 0] * log(cols[own] - in_[:, 0]))
    at = np.arange(len(own))
    score[at, own] = here
    score[:, k - 1] = -np.inf
    best = score.argmax(1)
    stay = (score[at, own] >= score[at, best] - 1e-9) | (out[:, 0] + in_[:, 0] == 0)
    return np.where(stay | (own == k - 1), own, best)


def _move(batches: Iterator[pa.RecordBatch], cls: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    import zstandard

    loosen, k = zstandard.ZstdDecompressor().decompress, len(m)
    for batch in batches:
        best = []
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("counts"), strict=True):
            own = cls[bucket * _SHARE : (bucket + 1) * _SHARE]
            right, left = np.frombuffer(loosen(blob.as_py()), dtype=np.int64).reshape(2, _SHARE, k)[:, : len(own)].astype(np.float64)
            best.append(best_classes(right, left, own, m).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(best, pa.binary())], names=["bucket", "best"])


def likelihood(m: np.ndarray) -> float:
    """What the classes add to the log likelihood of the units."""
    f = lambda x: float((x * np.log(np.maximum(x, 1.0))).sum())
    return f(m) - f(m.sum(1)) - f(m.sum(0))


def cluster(coded: DataFrame, n_head: int, group_of_head: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, counts of class pairs) from the training texts of ``coded``.

    Units are the head's words, the groups of other words and the end, in this order. The LEADS
    most frequent words and, for all others, their groups are clustered by exact exchange over
    their counts of neighbours; the other words start in their group's class. Then all words are
    moved at once, by their counts of neighbouring classes, SWEEPS times or until the likelihood
    of all training texts falls. What reaches the driver is bounded by LEADS, HEAD and classes.
    """
    spark = coded.sparkSession
    n, leads = n_head + ENDINGS + 1, min(LEADS, n_head)
    onto = np.concatenate([np.where(np.arange(n_head) < leads, np.arange(n_head), leads + group_of_head), leads + np.arange(ENDINGS + 1)]).astype(np.int64)
    n_lead = leads + ENDINGS + 1
    texts = coded.filter("key is null and not held_out").select("codes")
    n_tasks = texts.rdd.getNumPartitions()
    pairs, shared = np.zeros((n_lead, n_lead)), spark.sparkContext.broadcast(onto)
    found = texts.mapInArrow(lambda b: _count_pairs(b, shared.value, n_lead), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs.ravel()[found["pair"].to_numpy()] = found["n"].to_numpy()
    cls, best = exchange_clusters(pairs, classes)[onto], None
    for sweep in range(SWEEPS + 1):
        given = spark.sparkContext.broadcast(cls)
        sent = texts.mapInArrow(lambda b: _contexts(b, given.value, classes), _SENT_SQL)  # noqa: B023
        strands = n_tasks
        while strands > _FAN:  # no task gets more than _FAN tasks' contexts of a share, however large the corpus
            sent = sent.groupBy(F.floor(F.col("strand") / _FAN).alias("_up"), F.col("bucket").alias("_of")).applyInArrow(lambda key, t: _add_up(key, t, classes), _SENT_SQL)
            strands = -(-strands // _FAN)
        held = staged(sent.groupBy("bucket").applyInArrow(lambda t: _gather(t, given.value, classes), "bucket int, counts binary, m binary"), "brown-contexts")  # noqa: B023
        m = np.zeros((classes, classes))
        for r in held.select("m").collect():
            m += np.frombuffer(bytes(r["m"]), dtype=np.int64).reshape(classes, classes)
        value = likelihood(m)
        if best is not None and value <= best[0]:
            release(held)
            break
        best = value, cls, m
        moved = cls.copy()
        if sweep < SWEEPS:
            for r in held.mapInArrow(lambda b: _move(b, given.value, m), "bucket int, best binary").collect():  # noqa: B023
                x = np.frombuffer(bytes(r["best"]), dtype=np.int32)
                moved[r["bucket"] * _SHARE : r["bucket"] * _SHARE + len(x)] = x
        release(held)
        if (moved == cls).all():
            break
        cls = moved
    return best[1], best[2]


def exchange_clusters(pairs: np.ndarray, n_classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of each unit: each in turn moves to the class that raises the likelihood of the class bigrams most.

    ``pairs[u, v]`` counts unit v after unit u. The last unit (the end) keeps the last class to
    itself. Ties go to the lower class; the sweeps end early when nothing moves.
    """
    n, k = len(pairs), n_classes
    cls = np.arange(n) % (k - 1)
    cls[-1] = k - 1
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    onto = np.zeros((n, k))
    onto[np.arange(n), cls] = 1
    out_, in_, self_ = pairs @ onto, pairs.T @ onto, pairs.diagonal()  # of each unit: counts to and from classes
    m = onto.T @ out_
    for _ in range(sweeps):
        moved = 0
        for w in range(n - 1):
            a, r, c, s = cls[w], out_[w].copy(), in_[w].copy(), self_[w]
            r[a] -= s
            c[a] -= s  # without the unit itself
            m[a, :] -= r
            m[:, a] -= c
            m[a, a] -= s
            fm = f(m)
            gain = (f(m + r[None, :]) - fm).sum(1) + (f(m + c[:, None]) - fm).sum(0)
            d = m.diagonal()
            gain += f(d + r + c + s) - f(d + r) - f(d + c) + f(d)
            rows, cols = m.sum(1), m.sum(0)
            gain -= f(rows + r.sum() + s) - f(rows) + f(cols + c.sum() + s) - f(cols)
            gain[k - 1] = -np.inf
            b = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else a
            m[b, :] += r
            m[:, b] += c
            m[b, b] += s
            if b != a:
                moved += 1
                cls[w] = b
                out_[:, a] -= pairs[:, w]
                out_[:, b] += pairs[:, w]
                in_[:, a] -= pairs[w, :]
                in_[:, b] += pairs[w, :]
        if not moved:
            break
    return cls


def class_tables(m: np.ndarray, cls: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of class transitions P(h | g) from the counts of class pairs, and of units in their class P(u | class)."""
    k = len(m)
    each, members = np.bincount(cls, weights=counts, minlength=k), np.bincount(cls, minlength=k)
    first = (m.sum(0) + 1) / (m.sum() + k)
    move = (m + ALPHA * first[None, :]) / (m.sum(1) + ALPHA)[:, None]
    unit = (counts + BETA) / (each[cls] + BETA * members[cls])
    return np.log10(move), np.log10(unit)


def _score(batches, n_head, move, cls, emit, known, base) -> Iterator[pa.RecordBatch]:
    end = len(cls) - 1
    for batch in batches:
        c = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in batch.column("codes")]
        k, b, s = [], [], []
        for x in c:
            g = cls[np.concatenate([[end], x, [end]])]
            k.append(int(known[x].sum() + known[end]))
            b.append(float(base[x].sum() + base[end]))
            s.append(float(move[g[:-1], g[1:]].sum() + emit[x].sum() + emit[end]))
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in _SCORED.names[:4]], pa.array(k, pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64())], schema=_SCORED)


def n_classes(n_head: int) -> int:
    """Grows with the words that have a unit of their own: 111 for a full head."""
    return max(4, int(n_head**0.4))


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text", told: dict | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Rows whose crc32(key as text) mod 7 is not 2 are the training part; a null key reads as ''.
    Words are lower-cased in ASCII; each text (null: empty) ends with one end token.

    Training counts every word of every training row. The most frequent words, HEAD at most, are
    units of their own, rarer ones fall into ENDINGS units by their last three bytes, the end is a
    unit. Exchange clustering on the neighbours of every unit in all training texts (see
    cluster()) assigns each to one of n_classes() classes. The score is the sum of
    log10 P(class | previous class) + log10 P(unit | class) + log10 P(word | unit), each smoothed;
    unseen words share one slot of their unit, so probabilities sum to one.

    Texts are turned into units once, and sweeps and scores read those. What reaches the driver is
    bounded: at most HEAD words with their counts and classes, and the counts of lead and class
    pairs. Counts of rarer words are joined by word, one row for each document and distinct rare
    word; words that are frequent anywhere in training are in the head and never meet in that
    join. Long texts are read whole, repeated rows are scored and counted each, words of equal
    count are ordered by their bytes; an empty table gives an empty result; only the two named
    columns are read. A dictionary ``told`` is given what was learned.
    """
    spark = df.sparkSession
    src = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    vocab = staged(src.mapInArrow(_count_words, "key binary, grp int, n long").groupBy("key").agg(F.max("grp").alias("grp"), F.sum("n").alias("n")), "brown-vocab")
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = vocab.groupBy(level.alias("b")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()
    n_all, v_all = sum(r["n"] for r in levels), sum(r["v"] for r in levels)
    room, least = HEAD, None
    for r in sorted(levels, key=lambda r: -r["b"]):
        room -= r["v"]
        if room < 0:
            break
        least = r["b"]
    top = vocab.filter((level >= least) if least is not None else F.lit(False)).filter(F.col("grp") >= 0).toArrow()
    ends = sum(r["n"] for r in vocab.filter(F.col("grp") < 0).collect())
    top = top.sort_by([("n", "descending"), ("key", "ascending")])
    head, n_head = {k: i for i, k in enumerate(top["key"].to_pylist())}, len(top)
    count, grp = top["n"].to_numpy().astype(np.float64), top["grp"].to_numpy().astype(np.int64)
    del top
    group_n, group_v = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in vocab.filter(F.col("grp") >= 0).groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        group_n[r["grp"]], group_v[r["grp"]] = r["n"], r["v"]
    group_n -= np.bincount(grp, weights=count, minlength=ENDINGS)  # of the rarer words
    group_v -= np.bincount(grp, minlength=ENDINGS)
    shared = spark.sparkContext.broadcast(head)
    coded = staged(
        src.withColumn("_i", F.monotonically_increasing_id()).mapInArrow(
            lambda b: _encode(b, shared.value), "i long, doc_id long, held_out boolean, n_tokens long, codes binary, key binary, grp int, n long"),
        "brown-coded", "zstd",
    )
    k = n_classes(n_head)
    cls, m = cluster(coded, n_head, grp, k)
    move, of_unit = class_tables(m, cls, np.concatenate([count, group_n, [ends]]))
    known = np.concatenate([np.ones(n_head), np.zeros(ENDINGS), [ends > 0]]).astype(np.int64)
    bottom = n_all + v_all + 1
    base = np.concatenate([np.log10((count + 1) / bottom), np.zeros(ENDINGS), [math.log10((ends + 1) / bottom)]])
    if told is not None:
        told |= {"head": head, "cls": cls, "m": m, "move": move, "of_unit": of_unit, "group_n": group_n, "group_v": group_v}
    tables = spark.sparkContext.broadcast((n_head, move, cls, of_unit, known, base))
    docs = coded.filter("key is null").select("i", "doc_id", "held_out", "n_tokens", "codes")
    docs = docs.mapInArrow(lambda b: _score(b, *tables.value), "i long, doc_id long, held_out boolean, n_tokens long, k long, b double, s double")
    c = F.coalesce(F.col("c"), F.lit(0))
    at = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("grp") + 1)
    rare = coded.filter("key is not null").select("i", "key", "grp", "n").join(vocab.select("key", F.col("n").alias("c")), "key", "left")
    rare = rare.select(
        "i", (F.col("n") * (c > 0).cast("long")).alias("k"), (F.col("n") * F.log10((c + 1) / F.lit(float(bottom)))).alias("b"),
        (F.col("n") * F.log10((c + DELTA) / at(group_n + DELTA * (group_v + 1)))).alias("s"),
    )
    docs = docs.select("i", F.struct("doc_id", "held_out", "n_tokens").alias("d"), "k", "b", "s")
    both = docs.unionByName(rare, allowMissingColumns=True).groupBy("i").agg(F.max("d").alias("d"), F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    return both.select("d.doc_id", "d.held_out", "d.n_tokens", F.col("k").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), F.col("b").alias("base_score"), F.col("s").alias("score"))
