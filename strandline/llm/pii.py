"""Personal data: exact patterns and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("O", "EMAIL", "IP", "CARD", "PHONE")
BASE = ("email", "ip", "card", "phone")
#: Words whose scores a worker holds; words decoded at once.
_KEEP, _SHARE = 400_000, 500_000
_SPACE = "\x20\x09-\x0D"
_WORD = re.compile(f"[^{_SPACE}]+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")  # possessive: long digit runs take linear time
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OUT = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in BASE] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64())])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        total += x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds: leftmost non-overlapping matches, failing ones dropped without retries."""
    found = []
    at = text.find("@")
    done = 0
    while at >= 0:
        # The local part reaches back over its characters; a match starts as early as it may.
        s = at
        while s > done and (c := text[s - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            found.append((s, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


_DIGIT = re.compile("[0-9]")


def features(word: str) -> tuple[str, ...]:
    """Shape of a whole word: character classes with runs folded (head and tail of a long shape), sizes in bands, telling characters."""
    shape, digits, rest = [], 0, word
    body = word[:-1] if word[-1] in ".," else word
    if body.isalpha() and (body.islower() or body[0].isupper() and body[1:].islower()):  # most words
        shape, rest = ["x"] if body.islower() else ["X", "x"], word[len(body) :]
    for c in rest:
        k = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c if c in "@.+-()_/:=%\"'," else "?"
        digits += k == "d"
        if not shape or shape[-1] != k:
            shape.append(k)
    whole = "".join(shape)
    brief = lambda x: x if len(x) <= 24 else f"{x[:12]}~{x[-12:]}"
    number = word.strip(".,") if digits > 12 else ""
    return (
        f"shape={brief(whole)}", f"core={brief(whole.strip(_EDGES))}", f"digits={min(digits, 20)}", f"dots={min(word.count('.'), 5)}", f"at={min(word.count('@'), 2)}",
        f"first={shape[0]}", f"last={shape[-1]}", f"mixed={'x' in shape and 'd' in shape}", f"long={len(word) > 24}", f"fenced={'(x)' in whole or '?x?' in whole}",
        f"luhn={number.isascii() and number.isdigit() and len(number) < 20 and luhn(number)}", f"word={cue if (cue := word.lower().strip('.,')) in _CUES else ''}",
    )


_EDGES = ".,;:\"'?()"
#: Words that stand in written-out addresses and before numbers (fixed values).
_CUES = frozenset("at dot mail email e-mail phone tel call fax mobile card visa ip host address from to version page license commit sha id com net org".split())


class Crf:
    """Linear chain: a score for each label from the features of a word and of its neighbours, and for each pair of labels."""

    SIDES = (-1, 0, 1)

    def __init__(self):
        self.index: dict[tuple[int, str], int] = {}
        self.weights = np.zeros((0, len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))
        self.scores: WordScores | None = None

    def _rows(self, words: list[str], grow: bool) -> list[list[int]]:
        named = [features(w) for w in words]
        out = []
        for t in range(len(words)):
            row = []
            for side in self.SIDES:
                for name in named[t + side] if 0 <= t + side < len(words) else ("edge",):
                    at = self.index.setdefault((side, name), len(self.index)) if grow else self.index.get((side, name), -1)
                    if at >= 0:
                        row.append(at)
            out.append(row)
        return out

    def train(self, table: list[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Crf:
        """Maximum likelihood with a quadratic penalty, by Adam on all rows of the (small) table at once."""
        rows = [self._rows(words, True) for words, _ in table]
        k, n, longest = len(LABELS), len(table), max(len(w) for w, _ in table)
        gold, mask = np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
        seq, pos, feat = [], [], []
        for i, (words, labels) in enumerate(table):
            mask[i, : len(words)] = True
            gold[i, : len(words)] = [LABELS.index(x) for x in labels]
            for t, r in enumerate(rows[i]):
                seq += [i] * len(r)
                pos += [t] * len(r)
                feat += r
        x_all = np.zeros((n * longest, len(self.index)))
        np.add.at(x_all, (np.array(seq) * longest + np.array(pos), np.array(feat)), 1)
        self.weights = np.zeros((len(self.index), k))
        hit, pair = x_all.T @ (np.eye(k)[gold] * mask[..., None]).reshape(-1, k), np.zeros((k, k))
        both = mask[:, 1:]
        np.add.at(pair, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        params = [self.weights, self.moves]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            e = (x_all @ self.weights).reshape(n, longest, k)
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for t in range(1, longest):
                x = a[:, t - 1, :, None] + self.moves[None]
                top = x.max(1, keepdims=True)
                y = e[:, t] + (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]
                a[:, t] = np.where(mask[:, t, None], y, a[:, t - 1])
            top = a[:, -1].max(1, keepdims=True)
            z = (top + np.log(np.exp(a[:, -1] - top).sum(1, keepdims=True)))[:, 0]
            for t in range(longest - 2, -1, -1):
                x = self.moves[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :]
                top = x.max(2, keepdims=True)
                y = (top + np.log(np.exp(x - top).sum(2, keepdims=True)))[..., 0]
                b[:, t] = np.where(mask[:, t + 1, None], y, 0.0)
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            q = np.exp(a[:, :-1, :, None] + self.moves[None, None] + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
            expect = x_all.T @ p.reshape(-1, k)
            grads = [(hit - expect) / n - decay * self.weights, (pair - q.sum((0, 1))) / n - decay * self.moves]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                params[i] += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """Best labels of each sentence."""
        sizes = np.array([len(x) for x in sentences], dtype=np.int64)
        labels = self.decode_lines([[w.encode("utf-8", "surrogatepass") for w in x] for x in sentences if x], sizes[sizes > 0])
        return np.split(labels, np.cumsum(sizes)[:-1])

    def decode_lines(self, lines: list[list[bytes]], sizes: np.ndarray) -> np.ndarray:
        """Best labels of all words of the lines (none empty), one after the other: Viterbi over all lines at once, the longest first."""
        if not lines:
            return np.zeros(0, dtype=int)
        if self.scores is None or len(self.scores) > _KEEP or self.scores.n > _KEEP:
            self.scores = WordScores(self)
        c = np.fromiter(map(self.scores.__getitem__, chain.from_iterable(lines)), dtype=np.int64, count=int(sizes.sum()))
        before, here, after = self.scores.table.transpose(1, 0, 2)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        left, right = np.roll(c, 1), np.roll(c, -1)
        left[starts] = right[ends - 1] = 0  # the edge
        e = here[c] + before[left] + after[right]
        lanes = starts[np.argsort(-sizes, kind="stable")]
        live = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max())), side="right")  # lines with a word at t
        back = np.zeros(e.shape, dtype=np.int8)
        best = e[lanes]
        for t in range(1, len(live)):
            at = lanes[: live[t]] + t
            x = best[: live[t], :, None] + self.moves
            back[at] = x.argmax(1)
            best[: live[t]] = x.max(1) + e[at]
        labels = np.zeros(len(c), dtype=np.int64)
        labels[np.sort(-sizes) * -1 + lanes - 1] = best.argmax(1)
        for t in range(len(live) - 1, 0, -1):
            at = lanes[: live[t]] + t
            labels[at - 1] = back[at, labels[at]]
        return labels


class WordScores(dict):
    """Word -> row of ``table``: what it adds to the scores of the next word, of itself and of the word before; row 0 is the edge."""

    def __init__(self, crf: Crf):
        super().__init__()
        self.crf, self.rows, self.n = crf, {}, 0
        self.table = np.zeros((1024, len(crf.SIDES), len(LABELS)))
        self._row(("edge",))

    def _row(self, named: tuple[str, ...]) -> int:
        at = self.rows.get(named)
        if at is None:
            at = self.rows[named] = self.n
            self.n += 1
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for i, side in enumerate(self.crf.SIDES):
                known = [self.crf.index[side, x] for x in named if (side, x) in self.crf.index]
                self.table[at, i] = self.crf.weights[known].sum(0)
        return at

    def __missing__(self, word: bytes) -> int:
        at = self._row(features(word.decode("utf-8", "surrogatepass")))
        if len(word) < 64:
            self[word] = at
        return at


def labelled_table(n: int = 400, seed: int = 9) -> list[tuple[list[str], list[str]]]:
    """A small labelled table made by rule: sentences with personal data in several spellings, and look-alikes without."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda a, b: "".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(a, b)))

    plain_cues = ("at", "at", "to", "from", "to", "at", "version", "page", "address", "card", "host", "call", "dot", "com", "net")
    signs = ("|", "#", "-", "*", "=", "{", "}", "[", "]", "/", "&", "...", "--", "==", "[x]", "#x", "<p>", "(x)")

    def filler() -> list[str]:
        words = [rng.choice(plain_cues) if rng.random() < 0.2 else letters(2, 11) for _ in range(rng.randint(0, 7))]
        words = [w.capitalize() if rng.random() < 0.1 else w + rng.choice(["", "", "", ".", ","]) for w in words]
        return [rng.choice(signs) if rng.random() < 0.03 else w for w in words]

    def card() -> str:
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def item() -> tuple[list[str], str]:
        kind = rng.randrange(18)
        name, host = letters(3, 8), letters(3, 7)
        octets = [str(rng.randint(0, 255)) for _ in range(4)]
        c = card()
        area, mid, end = digits(3), digits(3), digits(4)
        stop = rng.choice(["", "", ".", ","])
        if kind == 0:
            return [f"{name}.{digits(2)}@{host}{digits(1)}.example.com{stop}"], "EMAIL"
        if kind == 1:
            return [f"<{name}@{host}.org>{stop}"], "EMAIL"
        if kind == 2:
            return [f"{name}{digits(rng.choice((0, 2)))}", "at", host, "dot", rng.choice(("com", "net", "org")) + stop], "EMAIL"
        if kind == 3:
            return [f"{name}{rng.choice(('(at)', '[at]'))}{host}.net{stop}"], "EMAIL"
        if kind == 4:
            return [".".join(octets) + stop], "IP"
        if kind == 5:
            return ["[.]".join(octets) + stop], "IP"
        if kind == 6:
            return [c + stop], "CARD"
        if kind == 7:
            return [c[i : i + 4] for i in range(0, 16, 4)], "CARD"
        if kind == 8:
            return [f"+1 ({area}) {mid}-{end}{stop}"][0].split(" "), "PHONE"
        if kind == 9:
            return [f"({area})", f"{mid}-{end}{stop}"], "PHONE"
        if kind == 10:
            return [f"{area}-{mid}-{end}{stop}"], "PHONE"
        if kind == 11:
            return [digits(rng.randint(1, 6)) + stop], "O"
        if kind == 12:
            return [rng.choice([f"{name}{digits(3)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{digits(1)}.{digits(2)}", f"{digits(1)},{digits(3)}", f"{digits(2)}%"])], "O"
        if kind == 13:
            return [rng.choice([f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"password={''.join(rng.choice('0123456789abcdef') for _ in range(18))}", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))])][0].split(" "), "O"
        if kind == 14:
            return [f"@{name}"], "O"
        if kind == 15:
            return [rng.choice(["at", "at", "and", name]) for _ in range(rng.randint(2, 4))], "O"  # no address: nothing with a dot
        if kind == 16:
            body = digits(15)
            return [next(body + c for c in "0123456789" if not luhn(body + c)) + stop], "O"
        return [digits(rng.randint(17, 30))], "O"

    table = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(rng.randint(1, 2)):
            f = filler()
            x, label = item()
            words += f + x
            labels += ["O"] * len(f) + [label] * len(x)
        f = filler()
        table.append((words + f, labels + ["O"] * len(f)))
    return table


def _shares(texts: list[str]) -> Iterator[list[tuple[int, int, int, list[bytes]]]]:
    """The words of every line of every text, with the number of the text and the line's start and end in it, in shares of bounded size."""
    held, n = [], 0
    for i, text in enumerate(texts):
        start = 0
        for line in text.split("\n"):
            words = line.encode("utf-8", "surrogatepass").split()  # bytes: the white space of _SPACE
            if words:
                held.append((i, start, start + len(line), words))
                n += len(words)
            start += len(line) + 1
            if n > _SHARE:
                yield held
                held, n = [], 0
    if held:
        yield held


_NAME = r"[^\W_](?:[\w.%+-]*\w)?"
#: What a span of the model must be to stay: an address with a sign (or its spelling) between name and host, four numbers up to 255, digits that pass Luhn, seven to fifteen digits.
_ADDRESS = re.compile(rf"{_NAME}\s*(?:@|[(\[{{]\s*at\s*[)\]}}])\s*{_NAME}|(?!(?:at|dot|and)\b){_NAME}\s+at\s+(?!(?:at|dot|and)\b){_NAME}\s+dot\s+[^\W\d_]{{2,}}", re.IGNORECASE)


def well_formed(kind: int, found: str) -> bool:
    """Whether a span that the model labels LABELS[kind] can be such data."""
    if LABELS[kind] == "EMAIL":
        return _ADDRESS.search(found) is not None
    if LABELS[kind] == "IP":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = "".join(c for c in found if "0" <= c <= "9")
    return 12 <= len(digits) <= 19 and luhn(digits) if LABELS[kind] == "CARD" else 7 <= len(digits) <= 15


class Taken:
    """Spans of one text, asked for overlaps in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [a for a, _, _ in spans]  # in order
        self.ends = list(accumulate((b for _, _, b in spans), max))

    def meets(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s


def find_spans(texts: list[str], crf: Crf) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and the spans that only the model finds; every word of every line is decoded, and time is linear in lines and words."""
    base = [base_spans(t) for t in texts]
    taken = [Taken(b) for b in base]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for part in _shares(texts):
        sizes = np.array([len(w) for *_, w in part], dtype=np.int64)
        flat, ends = crf.decode_lines([w for *_, w in part], sizes), np.cumsum(sizes)
        for row in np.unique(np.searchsorted(ends, np.flatnonzero(flat), side="right")):
            i, start, end, _ = part[row]
            words, labels = list(_WORD.finditer(texts[i], start, end)), flat[ends[row] - sizes[row] : ends[row]]
            t = 0
            while t < len(words):
                u = t + 1
                while u < len(words) and labels[u] == labels[t]:
                    u += 1
                if labels[t]:
                    s, e = words[t].start(), words[u - 1].end()
                    while e > s + 1 and texts[i][e - 1] in ".,;:>\"'":
                        e -= 1
                    while s < e - 1 and texts[i][s] in "<\"'":
                        s += 1
                    if not taken[i].meets(s, e) and well_formed(labels[t], texts[i][s:e]):
                        added[i].append((s, len(BASE) + labels[t] - 1, e))
                t = u
    return [(b, sorted(set(a))) for b, a in zip(base, added, strict=True)]


NAMES = (*BASE, *[f"crf_{k.lower()}" for k in LABELS[1:]])


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", table: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_crf for every row.

    Base spans come from the patterns alone and always stay. The field is trained on ``table``
    (sentences of words and LABELS; by default labelled_table()) and decodes every word of every
    line of every text; its spans are added where they do not overlap base spans, as crf_email,
    crf_ip, crf_card or crf_phone, and where they are well_formed() (a card passes Luhn, an address
    has its parts).

    Null and empty texts have no spans. Rows are kept one for one, repeated rows and null keys
    too; other columns are ignored; an empty table gives an empty result. No shuffle; the model is
    a few thousand numbers; a batch is worked on in shares of bounded size. Very long texts and words
    are read whole in linear time. Of labels that score alike, the first of LABELS wins.
    """
    crf = Crf().train(table or labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = lambda spans: ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [x or "" for x in part.column("text").to_pylist()]
                found = find_spans(texts, crf)
                columns = [part.column("doc_id"), *[pa.array([sum(k == j for _, k, _ in b) for b, _ in found], pa.int64()) for j in range(len(BASE))]]
                columns.append(pa.array([hashlib.sha256(show(b).encode()).hexdigest() for b, _ in found], pa.string()))
                columns.append(pa.array([show(sorted(b + a)) for b, a in found], pa.string()))
                columns.append(pa.array([len(a) for _, a in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_crf long"
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
