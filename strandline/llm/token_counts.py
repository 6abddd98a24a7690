"""Token counts of a unigram tokenizer without making the tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: What an unknown character costs below the worst piece.
UNKNOWN = 10.0
WINDOW = 1 << 20  # characters that are parted into words at once
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])


def unigram_vocab(model_path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with unigram scores.

    The public files hold merge ranks, not probabilities, so a piece at rank r gets the Zipf
    score -ln((r + 1) H), H the harmonic number of the vocabulary; control and byte pieces keep
    rank order too. Nothing is trained.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    h = sum(1 / r for r in range(1, n + 1))
    return [(sp.id_to_piece(i), -math.log((i + 1) * h)) for i in range(n)]


class ViterbiCounter:
    """Best score and piece count of a word.

    Aho-Corasick lists the pieces that end at each character, longest first. As in the exact
    tokenizer, a later start must be strictly better to replace an earlier one, a character with
    no piece of its own costs the lowest score less UNKNOWN, and it counts as its UTF-8 bytes
    (byte fallback).
    """

    def __init__(self, vocab: list[tuple[str, float]], keep: int = 400_000):
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        self.single = set()
        for piece, score in vocab:
            if piece in ("<unk>", "<s>", "</s>") or len(piece) == 6 and piece.startswith("<0x"):
                continue
            self.tree.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.tree.make_automaton()
        self.longest = max((len(p) for p, _ in vocab), default=1)
        self.unknown = min(s for _, s in vocab) - UNKNOWN
        self.cache: dict[str, tuple[int, float]] = {}
        self.keep = keep

    def _word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of a word of any length, keeping states of the longest piece's characters only."""
        room, unknown, single = self.longest + 1, self.unknown, self.single
        best, count = [0.0] * room, [0] * room  # of the prefix of each length, modulo room
        found = self.tree.iter(word)
        end, value = next(found, (-1, None))
        for e, c in enumerate(word, 1):
            top, pieces = None, 0
            while end == e - 1:
                size, score = value
                s = (e - size) % room
                total = score + best[s]
                if top is None or total > top:
                    top, pieces = total, count[s] + 1
                end, value = next(found, (-1, None))
            if c not in single:
                s = (e - 1) % room
                total = unknown + best[s]
                if top is None or total > top:
                    top, pieces = total, count[s] + len(c.encode("utf-8", "surrogatepass"))
            best[e % room], count[e % room] = top, pieces
        return count[len(word) % room], best[len(word) % room]

    def text(self, text: str) -> tuple[int, int, float]:
        """(tokens, marked words, score): each space becomes a mark, one more stands before the text, words start at marks."""
        cache, tokens, words, score, at = self.cache, 0, 0, 0.0, 0
        if text[:1] in (" ", MARK):
            at = 1  # the mark before the text is this one
        elif not text:
            return 0, 0, 0.0
        while at <= len(text):
            cut = min((k for k in (text.find(" ", at + WINDOW), text.find(MARK, at + WINDOW)) if k >= 0), default=len(text))
            parts = text[at:cut].replace(MARK, " ").split(" ")
            at = cut + 1
            if len(cache) > self.keep:
                cache.clear()
            for p in parts:
                x = cache.get(p)
                if x is None:
                    x = self._word(MARK + p)
                    if len(p) < 64:
                        cache[p] = x
                tokens += x[0]
                score += x[1]
            words += len(parts)
        return tokens, words, score


def count_tokens(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_words (marked words) and score (best total) of every row.

    Null and empty texts have no tokens. Rows are kept one for one, repeated rows and null keys
    too; other columns are ignored; an empty table gives an empty result. No shuffle; memory is
    the automaton, a bounded cache of words and a window of each text, however long it or its words
    are. Among equal scores the split whose last piece is longest wins, as in the exact tokenizer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ViterbiCounter(unigram_vocab(model_path))
        for batch in batches:
            texts = batch.column("text")
            found = [counter.text(texts[i].as_py() or "") for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([x[i] for x in found], t) for i, t in enumerate(_OUT.types[1:])]], schema=_OUT)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_words long, score double")
