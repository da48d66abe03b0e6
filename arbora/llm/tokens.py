"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both encodings agree.

The vocabulary lower-cases, drops white space and never joins pieces across it, nor across a digit, nor from a letter
to a sign. Such a place is a boundary that is proved by the tokenizer's own rules: normal form C composes nothing
across it, and neither a special string nor a piece holds it. Two encodings of overlapping chunks are spliced at a
token start that both have, that is such a place, and from which on both list the same tokens. An overlap without one
is widened; where a whole chunk has none, the chunk is, to twice its size, so that a text without any boundary costs
a few times its length.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import no_cycles

#: Characters of a chunk and of an overlap, characters of text encoded at once, words remembered by a worker.
CHUNK, OVERLAP, AT_ONCE, REMEMBERED = 1 << 16, 1 << 10, 1 << 18, 400_000
LONG_WORD = 256
#: How the vocabulary's pre-tokenizer splits lower-case text (a fixed value of the file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these code points only, and without the opening of a special string, may be split here: normal form C and
#: lower case then change nothing beyond single characters.
PLAIN = re.compile("[\x21-\x7f\xa1-\xff]+")


#: Proved boundaries: behind white space, beside a digit (no special string holds one), from a letter to a sign other than |.
BOUNDARY = re.compile(r"(?<=[ \n\t\r])(?=\S)|(?<=[0-9])(?=[!-~])|(?<=[!-~])(?=[0-9])|(?<=[A-Za-z])(?=[!-/:-@\[-`{}~])")


class Counter:
    """Counts tokens as the library does with the vocabulary at path, without begin, end or added special tokens."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunk, self.overlap, self.words, self.pieces = chunk, overlap, {"": 0}, {}
        self.split = regex.compile(SPLIT).findall
        self.widened = 0
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def counts(self, texts: list[str]) -> list[int]:
        """Texts up to a chunk are sums over their words, each word being encoded once while it is remembered."""
        split = [None if len(t) > self.chunk else t.replace("\n", " ").split(" ") for t in texts]
        new = {w for words in split if words for w in words if w not in self.words}
        parts = {w: self.split(w.lower()) if len(w) <= LONG_WORD and PLAIN.fullmatch(w) and "<|" not in w else [w] for w in new}
        fresh = list({p for own in parts.values() for p in own if p not in self.pieces})
        for k in range(0, len(fresh), 4096):
            self.pieces.update(self.sizes(fresh[k : k + 4096]))
        extra = {}
        for w, own in parts.items():
            (extra if len(w) > LONG_WORD else self.words)[w] = sum(map(self.pieces.__getitem__, own))
        got = self.words if not extra else {**{w: self.words[w] for words in split if words for w in words if w in self.words}, **extra}
        out = [self.huge(t) if words is None else sum(map(got.__getitem__, words)) for t, words in zip(texts, split)]
        if len(self.words) > REMEMBERED or len(self.pieces) > REMEMBERED:
            self.words, self.pieces = {"": 0}, {}
        for w in extra:
            self.pieces.pop(w, None)
        return out

    def sizes(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word. Plain words are encoded as one text: each then ends with the first token that ends a word."""
        one = [w for w in words if PLAIN.fullmatch(w) and "<|" not in w and len(self.split(w)) == 1]
        ids = np.array(self.library.encode_batch_fast([" ".join(one)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(one):  # another vocabulary: each word by itself
            one, ends = [], ends[:0]
        out = dict(zip(one, np.diff(ends, prepend=-1).tolist()))
        rest = [w for w in words if w not in out]
        return out | dict(zip(rest, map(len, self.library.encode_batch_fast(rest, add_special_tokens=False))))

    def piece(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(id, start, end) of the tokens of text[start:end], offsets in the whole text."""
        e = self.library.encode(text[start:end], add_special_tokens=False)
        return [(i, a + start, b + start) for i, (a, b) in zip(e.ids, e.offsets)]

    def huge(self, text: str) -> int:
        """Tokens of a text of any length, from overlapping chunks; holds one or two chunks' tokens."""
        total, start, size = 0, 0, self.chunk
        stop = min(size, len(text))
        piece = self.piece(text, start, stop)
        while stop < len(text):
            overlap, cut = self.overlap, None
            while cut is None and overlap < 2 * (stop - start):
                begin = max(start, stop - overlap)
                if any(True for _ in BOUNDARY.finditer(text, begin + 1, stop)):
                    end = min(len(text), stop + self.chunk - min(self.overlap, self.chunk // 2))
                    after = self.piece(text, begin, end)
                    cut = self.agree(text, piece, after, begin, stop)
                if cut is None:
                    overlap *= 2
                    self.widened += 1
            if cut is None:  # no boundary was proved since the last one
                size *= 2
                self.widened += 1
                stop = min(len(text), start + size)
                piece = self.piece(text, start, stop)
            else:
                total += cut[0]
                piece, size = after[cut[1] :], self.chunk
                start, stop = piece[0][1], end
        return total + len(piece)

    def agree(self, text: str, done: list, after: list, start: int, end: int) -> tuple[int, int] | None:
        """Where to leave the first list and enter the second, or None if no common boundary is proved.

        It is the first token of the overlap that both lists start at the same boundary; from there to the last
        boundary before the first chunk's end, both must list the same tokens.
        """
        proved = [m.start() for m in BOUNDARY.finditer(text, start, end) if m.start() > start]
        if not proved:
            return None
        sure = proved[-1]
        low = len(done)
        while low and done[low - 1][1] >= start:
            low -= 1
        places = {done[k][1]: k for k in range(low, len(done))}
        known = set(proved)
        for j, (_, a, _) in enumerate(after):
            if a >= sure:
                break
            if a in known and a in places:
                k = places[a]
                both = sum(1 for x in done[k:] if x[1] < sure)
                if both and done[k : k + both] == after[j : j + both]:
                    return k, j
        return None


def token_counts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row of docs; other columns, whatever their names, are left out.

    A null text counts as empty: 0 bytes, 0 tokens. Ids may be null and of any type. Repeated rows give repeated rows.
    An empty table gives an empty one. No text is cut. Nothing is shuffled; a worker holds one batch and a bounded
    memory of words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        with no_cycles():
            yield from counted(counter, batches)

    def counted(counter: Counter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, held, part = b.column(1), [], 0, []
            for t in texts:
                t = t.as_py() or ""
                part.append(t)
                held += len(t)
                if held >= AT_ONCE:
                    n += counter.counts(part)
                    held, part = 0, []
            n += counter.counts(part)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["_id", "_bytes", "_n"])

    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("_bytes"))
    got = source.mapInArrow(count, f"_id {kind}, _bytes long, _n long")
    return got.select(F.col("_id").alias(id_column), F.col("_bytes").alias("n_bytes"), F.col("_n").alias("n_tokens"), (F.col("_n") > limit).alias("over_limit"))
