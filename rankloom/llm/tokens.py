"""Token counts by a count-only Viterbi search.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each position; dynamic programming carries the best
score and the number of pieces of the best path, and no back-pointers. Ties go the way unigram tokenizers resolve them: of
equally good paths to a position the one whose last piece starts first, that is, is longest.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabulary file; its pieces and scores are read, never copied or trained.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Counts of word forms that a worker remembers, at most; the memory is emptied when full.
REMEMBERED = 400_000

_SPACE = "▁"
_CACHE: dict[str, Unigram] = {}


class Unigram(dict):
    """Counts pieces of a text as a unigram tokenizer with byte fallback would; as a dict it remembers units.

    vocabulary: (piece, score) pairs, without control and byte pieces. A character that no piece of its own covers costs the
    least score less UNKNOWN_PENALTY and counts as one piece for each of its UTF-8 bytes.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in vocabulary:
            scores.setdefault(piece.replace(_SPACE, " "), score)
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.empty = not scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        # No piece crosses from a word into the space after it, or contains a line break: then texts fall apart there exactly.
        words = all(" " not in p.lstrip(" ") for p in scores)
        breaks = not any("\n" in p for p in scores)
        if words:
            self.units = re.compile(r"\n| *[^ \n]+| +" if breaks else r" *[^ ]+| +").findall
        else:
            self.units = lambda text: [text]

    def __missing__(self, unit: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[unit] = n = self.viterbi(unit)
        return n

    def viterbi(self, unit: str) -> int:
        n = len(unit)
        none = float("-inf")
        best, pieces = [none] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        at, alone = 0, False  # the end that is being filled, and whether a piece of one character ends there
        for last, (length, score) in () if self.empty else self.automaton.iter(unit):
            end = last + 1
            while at < end:
                if at and not alone:
                    self._unknown(unit, at, best, pieces)
                at, alone = at + 1, False
            start = end - length
            if best[start] + score > best[end]:
                best[end], pieces[end] = best[start] + score, pieces[start] + 1
            alone = alone or length == 1
        while at <= n:
            if at and not alone:
                self._unknown(unit, at, best, pieces)
            at, alone = at + 1, False
        return pieces[n]

    def _unknown(self, unit: str, end: int, best: list[float], pieces: list[int]) -> None:
        score = best[end - 1] + self.unknown
        if score > best[end]:
            best[end], pieces[end] = score, pieces[end - 1] + len(unit[end - 1].encode("utf-8", "replace"))

    def count(self, text: str | None) -> int | None:
        """Pieces of the whole text with the customary space before it. Null gives null, an empty text 0."""
        if text is None:
            return None
        return sum(map(self.__getitem__, self.units(" " + text.replace(_SPACE, " ")))) if text else 0


def load(path: str = MODEL) -> Unigram:
    """The counter over a sentencepiece file's ordinary pieces and their scores."""
    if path not in _CACHE:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        _CACHE[path] = Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in ids])
    return _CACHE[path]


def count_tokens(text: Column, path: str = MODEL) -> Column:
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        counter = load(path)
        return pa.array([counter.count(t.as_py()) for t in texts], pa.int64())

    return run.asNondeterministic()(text)


def token_counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and n_tokens of each row: null for null texts, 0 for empty ones; repeated rows are counted one by one; an empty
    table gives an empty result; further columns don't matter."""
    return docs.select("doc_id", count_tokens(F.col("text"), path).alias("n_tokens"))
