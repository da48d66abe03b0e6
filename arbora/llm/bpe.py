"""Byte-level BPE: pre-tokenisation by arrays and an associative scan, cached pair merging, decoding by offsets.

Code points become symbols (their class, and for white space and apostrophes what stands next). Each symbol is a
function from the state before it to the state after it. Compositions of these functions form a small closed set, so a
composition is one look-up in a table and all prefix compositions come from a work-efficient scan, without regex and
without a loop over characters.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import no_cycles

# What may follow an apostrophe as a piece of its own.
ONE, TWO = "stmd", ("re", "ve", "ll")

#: States: a new piece must begin; in letters, digits, other, white space; after a blank that begins a piece; one or
#: two letters of a contraction left.
RESET, LETTER, DIGIT, OTHER, SPACE, PREFIX, LEFT1, LEFT2 = range(8)
#: Symbols: letter, digit, other; an apostrophe before a contraction of one or two letters; a blank before a
#: non-space, other white space before a non-space, white space before white space or the end; the end of a text.
S_LETTER, S_DIGIT, S_OTHER, S_ONE, S_TWO, S_BLANK, S_LAST, S_MORE, S_END = range(9)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece begins at it."""
    if symbol == S_END:
        return RESET, True
    if symbol == S_BLANK:
        return PREFIX, True
    if symbol == S_LAST:
        return RESET, True
    if symbol == S_MORE:
        return SPACE, state != SPACE
    if symbol == S_LETTER:
        if state == LEFT2:
            return LEFT1, False
        if state == LEFT1:
            return RESET, False
        return LETTER, state not in (LETTER, PREFIX)
    if symbol == S_DIGIT:
        return DIGIT, state not in (DIGIT, PREFIX)
    if state in (OTHER, PREFIX) or symbol == S_OTHER:
        return OTHER, state not in (OTHER, PREFIX)
    return (LEFT1 if symbol == S_ONE else LEFT2), True


def closure() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the symbols' functions, the table of compositions, and each function's result from RESET."""
    own = [tuple(step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {tuple(range(8)): 0}
    todo = list(known)
    for f in own:
        if f not in known:
            known[f] = len(known)
            todo.append(f)
    for f in todo:
        for g in own:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    table = np.zeros((len(known), len(known)), np.uint8)
    for f, a in known.items():
        for g, b in known.items():
            table[a, b] = known[tuple(g[s] for s in f)]
    return np.array([known[f] for f in own], np.uint8), table, np.array([f[RESET] for f in known], np.uint8)


FUNCTION, COMPOSED, FROM_RESET = closure()
BEGINS = np.array([[step(s, x)[1] for x in range(9)] for s in range(8)])


def scan(f: np.ndarray) -> np.ndarray:
    """Prefix compositions f[0], f[0] f[1], ...: halves, scans the half, and fills in (work in proportion to n)."""
    if len(f) < 2:
        return f.copy()
    even = len(f) & ~1
    half = scan(COMPOSED[f[0:even:2], f[1:even:2]])
    out = np.empty_like(f)
    out[1:even:2] = half
    out[0] = f[0]
    out[2::2] = COMPOSED[half[: len(out[2::2])], f[2::2]]
    return out


def classes(letters: str = r"\p{L}", digits: str = r"\p{N}", spaces: str = r"\s") -> np.ndarray:
    """The class of each code point, with the library's own Unicode tables: 0 letter, 1 digit, 2 other, 3 space."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 2, np.uint8)
    for k, pattern in ((0, letters), (1, digits), (3, spaces)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = probe.decode(probe.encode_ordinary(every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = k
    return out


def pieces(texts: list[str], kinds: np.ndarray) -> list[list[str]]:
    """The pre-tokens of each text."""
    if not texts:
        return []
    joined = "\0".join(texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = kinds[c]
    after = np.full(len(c), 3, np.uint8)
    after[:-1] = kind[1:]
    after[ends - 1] = 3  # the end of a text is as white space to what stands before it
    symbol = kind.copy()
    space = kind == 3
    symbol[space] = np.where(after[space] == 3, S_MORE, np.where(c[space] == 32, S_BLANK, S_LAST))
    quote = np.flatnonzero(c == 39)
    if len(quote):
        padded = np.append(c, [0, 0])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(x) for x in ONE])
        two = np.zeros(len(quote), bool)
        for x in TWO:
            two |= (a == ord(x[0])) & (b == ord(x[1]))
        symbol[quote] = np.where(one, S_ONE, np.where(two, S_TWO, S_OTHER))
    symbol[ends] = S_END
    state = FROM_RESET[scan(FUNCTION[symbol])]
    before = np.empty_like(state)
    before[0] = RESET
    before[1:] = state[:-1]
    at = np.flatnonzero(BEGINS[before, symbol])
    cuts, first, out = at.tolist(), np.searchsorted(at, np.append(0, ends + 1)).tolist(), []
    for k in range(len(texts)):
        own = cuts[first[k] : first[k + 1]]  # the last of them is the end itself
        out.append([joined[i:j] for i, j in zip(own, own[1:])])
    return out


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Remembered(dict):
    """Token ids of pieces; merges a piece that is asked for the first time."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> list[int]:
        got = self.merge(piece.encode())
        if len(piece) <= 64:
            self[piece] = got
        return got


class Codec:
    """Encodes and decodes with the ranks at path; remembers a bounded number of merged pieces."""

    def __init__(self, path: str, kinds: np.ndarray, remembered: int = 300_000):
        import tiktoken

        own = ranks(path)
        # The library's merge loop for one piece; its pattern is never used.
        merging = tiktoken.Encoding("merging", pat_str=r"(?!)", mergeable_ranks=own, special_tokens={})
        self.kinds, self.remembered, self.cache = kinds, remembered, Remembered(merging._core_bpe.encode_single_piece)
        top = max(own.values()) + 1
        self.bytes_of, self.text_of = [b""] * top, list(map(str, range(top)))
        for b, i in own.items():
            self.bytes_of[i] = b

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [list(chain.from_iterable(map(self.cache.__getitem__, own))) for own in pieces(texts, self.kinds)]
        if len(self.cache) > self.remembered:
            self.cache.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[int]:
        """The byte at which each token begins."""
        return [0, *np.cumsum([len(self.bytes_of[i]) for i in ids])[:-1].tolist()] if ids else []


_codecs: dict[str, Codec] = {}


def encode(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, at_once: int = 1 << 18) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row; with_ids adds ids and offsets, from which any span decodes.

    A null text is encoded as an empty one: 0 tokens, the digests of nothing. Ids may be null and of any type. Repeated rows give repeated rows, an
    empty table an empty one; other columns are left out whatever their names. No text is cut; very long ones and
    pieces are merged in time n log n. Nothing is shuffled.
    """
    kinds = np.packbits(np.unpackbits(classes()[:, None], axis=1)[:, -2:]).tobytes()  # 2 bits a code point

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path not in _codecs:
            bits = np.unpackbits(np.frombuffer(kinds, np.uint8)).reshape(-1, 2)
            _codecs[ranks_path] = Codec(ranks_path, bits[:, 0] * np.uint8(2) + bits[:, 1])
        codec = _codecs[ranks_path]
        with no_cycles():
            yield from encoded(codec, batches)

    def encoded(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, part, held = [], [], 0

            def flush() -> None:
                for ids in codec.encode(part):
                    row = [len(ids), hashlib.sha256(" ".join(map(codec.text_of.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()]
                    rows.append(row + [ids, codec.offsets(ids)] if with_ids else row)

            for t in b.column(1):
                part.append(t.as_py() or "")
                held += len(part[-1])
                if held >= at_once:
                    flush()
                    part, held = [], 0
            flush()
            kind = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(columns, kind))], ["_id", *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "offsets"] * with_ids
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, offsets array<long>" * with_ids
    got = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).mapInArrow(work, schema)
    return got.select(F.col("_id").alias(id_column), *names)
