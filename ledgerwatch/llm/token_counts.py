"""Token counts of a unigram tokenizer, without building tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each place of
a word; dynamic programming keeps the best score and the number of pieces of the
best path, and nothing of the path itself. Ties go as in the tokenizers library:
a candidate replaces the best one only if its score is strictly higher, in order
of rising start; a character that is no piece costs the least score less 10 and
neighbouring unknown ones count as one piece.

The vocabulary and its order come from a sentencepiece file; a piece's score is
-log(rank + 1), its Zipf log frequency up to a constant. Words are the runs
without Unicode white space, each with the mark U+2581 before it, and are
segmented each by itself, so counts of words can be kept: a worker holds at most
MAX_CACHED of them.

Defined cases: a null or empty text has 0 tokens. Repeated rows give a row each.
Texts are counted whole, in time linear in the text for words of a bounded
length of pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerwatch.llm.common import bounded_batches

MARK = "▁"
#: The setting that names a vocabulary file, where no path is given.
VOCABULARY = "spark.ledgerwatch.vocabulary"
#: Cached counts of words in a worker.
MAX_CACHED = 200_000
#: Words above this length aren't cached.
MAX_CACHED_CHARS = 64
UNKNOWN_PENALTY = 10.0

#: str.split() also splits at these four, which aren't Unicode white space.
_ODD = re.compile("[\x1c-\x1f]")
_WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")


def default_vocabulary_path() -> str:
    """The file of a package of public tokenizers, if that is installed; else a path must be given or set."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, by id; control, byte and unknown pieces are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))]
    # Stored scores fall with the rank.
    ids.sort(key=lambda i: (-m.get_score(i), i))
    return [(m.id_to_piece(i), -math.log(rank + 1)) for rank, i in enumerate(ids, 1)]


def words_of(text: str) -> list[str]:
    """Runs without Unicode white space."""
    return _WORD.findall(text) if _ODD.search(text) else text.split()


class Counter:
    """Piece counts of words under a vocabulary."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def pieces(self, marked: str) -> int:
        """The number of pieces on the best path over a marked word.

        The automaton gives pieces by their end and, of one end, the longest first,
        which is the order of rising start.
        """
        if not self.single.issuperset(marked):
            return self._with_unknown(marked)
        best, count = [0.0] * (len(marked) + 1), [0] * (len(marked) + 1)
        before = -1
        for last, (size, score) in self.automaton.iter(marked):
            start = last + 1 - size
            score += best[start]
            if last != before or score > best[last + 1]:
                before = last
                best[last + 1], count[last + 1] = score, count[start] + 1
        return count[-1]

    def _with_unknown(self, marked: str) -> int:
        """As pieces(), for a word with characters that are no piece."""
        n = len(marked)
        low = float("-inf")
        best, count, open_ = [0.0] + [low] * n, [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(marked):
            ends[last + 1].append((last + 1 - size, score))
        for at in range(1, n + 1):
            top, pieces, unk = low, 0, False
            for start, score in ends[at]:
                s = score + best[start]
                if s > top:
                    top, pieces, unk = s, count[start] + 1, False
            if marked[at - 1] not in self.single:
                s = self.unknown + best[at - 1]
                if s > top:
                    top, pieces, unk = s, count[at - 1] + (not open_[at - 1]), True
            best[at], count[at], open_[at] = top, pieces, unk
        return count[n]

    def word(self, word: str) -> int:
        n = self.pieces(MARK + word)
        if len(word) <= MAX_CACHED_CHARS:
            if len(self.cache) >= MAX_CACHED:
                self.cache.clear()
            self.cache[word] = n
        return n

    def text(self, text: str | None) -> tuple[int, int]:
        """Tokens and words of a text."""
        if not text:
            return 0, 0
        words = words_of(text)
        get, total = self.cache.get, 0
        for w in words:
            n = get(w)
            total += self.word(w) if n is None else n
        return total, len(words)


def count_tokens(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The kept columns (those of these names are replaced), n_tokens and n_words.

    The vocabulary file is read once on the driver (its size is bounded by the
    tokenizer) and sent to the workers, which build the automaton once each.
    """
    bounded_batches(df.sparkSession)
    made = ("n_tokens", "n_words")
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text_col, *made)]
    path = path or df.sparkSession.conf.get(VOCABULARY, None) or default_vocabulary_path()
    sent = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    chosen = df.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = StructType([*kept.schema.fields, *(StructField(n, LongType()) for n in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for b in batches:
            both = [counter.text(t.as_py()) for t in b.column(0)]
            counts = [pa.array([x[i] for x in both], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *counts], names=[*keep, *made])

    return chosen.mapInArrow(run, schema)
