"""Encoding texts with a public byte-level tokenizer.

Texts are cut into the tokenizer's pieces (contractions, blank and letters, blank and digits, blank and other signs, white space)
by array operations over whole Arrow batches; each distinct piece of a batch is mapped byte by byte to the vocabulary's
characters and encoded once by the tokenizers library, and the ids are gathered back. Ids are those of encoding the whole text
without special tokens: byte-level BPE never merges across pieces, and strings of special tokens are ordinary text.

``encode_with_offsets`` adds the characters of the text that each id stands for: the vocabulary tells its bytes, and their positions
in the text's UTF-8 the characters. The ids of a character split between tokens all have that character.

Decoding reverses the byte table, of whole batches at once; bytes of a character split between tokens are joined before they are decoded.

Defined results: null and empty texts have an empty list of ids. Lone surrogates, which UTF-8 doesn't have, become U+FFFD. Ids that the
vocabulary doesn't have, and bytes that are no UTF-8, decode to U+FFFD. Null ids decode to a null text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.vectext import BREAK, LETTER, OTHER, SPACE, batches, class_table, code_points, span_hashes

TOKENIZERS = "/opt/tokenizers"


def byte_table() -> list[str]:
    """The character that stands for each byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]


BYTES = byte_table()
UNBYTES = {c: b for b, c in enumerate(BYTES)}


@cache
def load(folder: str, name: str):  # noqa: ANN201
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{folder}/{name}.json")


def piece_starts(cp: np.ndarray) -> np.ndarray:
    """Start of every piece. Separators between texts (class BREAK) start a piece of their own."""
    k = class_table()[cp]
    n = len(cp)
    start = np.empty(n, dtype=bool)
    start[:1] = True
    start[1:] = k[1:] != k[:-1]
    start |= k == BREAK
    space = k == SPACE
    follows = np.zeros(n, dtype=bool)  # a white space before something else of its text
    follows[:-1] = space[:-1] & ~space[1:] & (k[1:] != BREAK)
    start |= follows  # the last white space of a run is not part of the run
    joins = follows & (cp == 0x20)
    start[1:] &= ~joins[:-1]  # a blank goes with what follows
    # Contractions: an apostrophe that starts a piece and is the whole of its run.
    q = np.flatnonzero((cp[:-2] == 0x27) & start[:-2] & (k[1:-1] == LETTER)) if n > 2 else np.zeros(0, dtype=np.int64)
    if len(q):
        one, two = cp[q + 1], cp[q + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, width in ((q[short], 2), (q[long & ~short], 3)):
            start[at + 1] = False
            after = at + width
            if width == 3:
                start[at + 2] = False
            inside = k[after] == LETTER
            start[after[inside]] = True
    return np.flatnonzero(start)


class Pieces:
    """Ids of the distinct pieces met so far, as one flat array; keyed by hash."""

    def __init__(self, folder: str, name: str, most: int = 300_000) -> None:
        self.model = load(folder, name).model
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.flat: list[int] = []
        self.begin: list[int] = [0]

    def slots(self, hashes: np.ndarray, spans: list[tuple[int, int]], cp: np.ndarray) -> np.ndarray:
        if len(self.at) > self.most:
            self.clear()
        out = np.empty(len(hashes), dtype=np.int64)
        for i, (h, (a, b)) in enumerate(zip(hashes.tolist(), spans)):
            slot = self.at.get(h)
            if slot is None:
                raw = cp[a:b].astype("<u4").tobytes().decode("utf-32-le", "replace").encode()
                ids = [t.id for t in self.model.tokenize("".join([BYTES[x] for x in raw]))]
                slot = self.at[h] = len(self.begin) - 1
                self.flat += ids
                self.begin.append(len(self.flat))
            out[i] = slot
        return out


def encode_arrays(texts: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the number of each text's ids."""
    all_ids, counts = [], np.zeros(len(texts), dtype=np.int64)
    for group in batches(texts):
        cp, starts = code_points([texts[i] for i in group])
        a = piece_starts(cp)
        b = np.append(a[1:], len(cp))
        real = cp[a] != 0x110000
        a, b = a[real], b[real]
        if not len(a):
            continue
        h, first, back = np.unique(span_hashes(cp, a, b), return_index=True, return_inverse=True)
        slot = pieces.slots(h, list(zip(a[first].tolist(), b[first].tolist())), cp)[back]
        begin = np.asarray(pieces.begin, dtype=np.int64)
        flat = np.asarray(pieces.flat, dtype=np.int32)
        size = begin[slot + 1] - begin[slot]
        ends = np.cumsum(size)
        all_ids.append(flat[np.repeat(begin[slot] - (ends - size), size) + np.arange(ends[-1])])
        doc = np.searchsorted(starts, a, side="right") - 1
        counts[group] = np.bincount(doc, weights=size, minlength=len(group)).astype(np.int64)
    return (np.concatenate(all_ids) if all_ids else np.zeros(0, dtype=np.int32)), counts


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the token ids of every row's text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(folder, tokenizer)
        for r in rows:
            ids, counts = encode_arrays(_texts(r.column(1)), pieces)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([r.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens): the number of ids only, which is all that leaves the workers."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(folder, tokenizer)
        for r in rows:
            _, counts = encode_arrays(_texts(r.column(1)), pieces)
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long")


@cache
def _id_bytes(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, flat, and where each id's begin; the last entry, for ids beyond the vocabulary, is U+FFFD."""
    t = load(folder, name)
    raw = [bytes(UNBYTES[c] for c in x) if (x := t.id_to_token(i)) is not None and all(c in UNBYTES for c in x) else (x or "\ufffd").encode() for i in range(t.get_vocab_size())]
    raw.append("\ufffd".encode())
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def offsets(texts: list[str], ids: np.ndarray, counts: np.ndarray, folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each id's bytes, and the one behind the last, in the text that the id is from."""
    _, begin = _id_bytes(folder, name)
    cp, starts = code_points(texts)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + ((cp >= 0x10000) & (cp < 0x110000))
    width[cp == 0x110000] = 0  # between texts
    ends = np.cumsum(width)
    size = begin[ids + 1] - begin[ids]
    to = np.cumsum(size)  # as the ids of all texts in a row are all bytes of all texts
    base = np.repeat(starts[:-1], counts)
    return np.searchsorted(ends, to - size, side="right") - base, np.searchsorted(ends, to - 1, side="right") + 1 - base


def encode_with_offsets(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids, starts, ends): the token ids of every row's text, and the characters from ``starts`` to before ``ends`` that each is of."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(folder, tokenizer)
        for r in rows:
            texts = _texts(r.column(1))
            ids, counts = encode_arrays(texts, pieces)
            at = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ids, *offsets(texts, ids, counts, folder, tokenizer))]
            yield pa.RecordBatch.from_arrays([r.column(0), *lists], names=[key, "ids", "starts", "ends"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>")


def decode_lists(ids: np.ndarray, counts: np.ndarray, folder: str, name: str) -> list[str]:
    """The texts of lists of ids, given in a row."""
    flat, begin = _id_bytes(folder, name)
    ids = np.where((ids < 0) | (ids >= len(begin) - 2), len(begin) - 2, ids)
    size = begin[ids + 1] - begin[ids]
    ends = np.cumsum(size)
    raw = flat[np.repeat(begin[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def decode_ids(ids: list[int], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """The text of a list of ids."""
    return decode_lists(np.asarray(ids, dtype=np.int64), np.array([len(ids)]), folder, tokenizer)[0]


def decode(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) of ids; null ids give a null text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            lists = r.column(1)
            counts = np.diff(np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))))
            found = decode_lists(lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), counts.astype(np.int64), folder, tokenizer)
            texts = [t if ok else None for t, ok in zip(found, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, F.col(ids)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


__all__ = ["OTHER", "decode", "decode_ids", "encode", "encode_arrays", "encode_with_offsets", "piece_starts", "token_counts"]
