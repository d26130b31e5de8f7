"""BPE encoding and decoding through a table of distinct words.

Texts are split on ASCII white space, which no token of the vocabulary spans.  Every distinct word is
encoded once and kept with its ids in a word table; the ids are joined back by position with array
gathers.  Decoding joins each id with its piece.  The word table lives in the Python worker and is emptied
beyond ``TABLE_WORDS`` words, so memory is bounded whatever the corpus; no row is shuffled.

The cuts below are those of one normalizer and pre-tokenizer, ``KNOWN``.  Texts of a vocabulary file with others go through the
library whole, and so does decoding where the file names a decoder.

A null text counts as empty.  An empty text has no ids and decodes to the empty string.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import by_batch, byte_order, distinct_words, prepare, ragged

#: Words that a worker's table holds before it is emptied.
TABLE_WORDS = 400_000


#: What the vocabulary file must say for words to be cut here.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Words of printable ASCII and precomposed Latin letters, which normalization leaves as they are but for case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿŒœ]*").fullmatch
#: The pre-tokenizer of the vocabulary, for such words in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^a-zß-öø-ÿœ0-9]+").findall
#: Texts that hold anything but such words and ASCII white space, or an apostrophe, or what may be a special token.
_ODD = "[^\\t-\\r -~À-ÖØ-öø-ÿŒœ]|'|<\\|"
#: Kinds of a byte of the other texts: white space, letter, digit, other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_KIND[ord("0") : ord("9") + 1] = 2


def pre_tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Like ``distinct_words``, for texts that are not odd: runs of letters, single digits, runs of others."""
    texts = pc.utf8_lower(texts)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return [], np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[start : start + ends[-1]]
    kind = _KIND[raw]
    fresh = np.empty(len(kind), bool)
    fresh[0] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    fresh |= kind == 2
    fresh[ends[:-1][ends[:-1] < len(kind)]] = True
    shown = kind != 0
    fresh = fresh[shown]
    begin = np.flatnonzero(fresh)
    body = np.ascontiguousarray(raw[shown])
    offsets = np.append(begin, len(body)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(body)).dictionary_encode()
    # how many pre-tokens begin before each text's end
    before = np.searchsorted(begin, np.concatenate([[0], np.cumsum(shown)])[ends])
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.concatenate([[0], before])


def _byte_letters() -> list[str]:
    """Byte-level BPE writes printable bytes as themselves and the others as letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + rest.index(b)) for b in range(256)]


_BYTES = _byte_letters()


class WordTable:
    """Distinct words and their ids: word -> row; row -> slice of one flat id array."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(self.tokenizer.to_str())
        self.known = all(file.get(k) == v for k, v in KNOWN.items())
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.flat = np.zeros(8192, np.uint32)
        self.used = 0

    def lookup(self, words: list[str]) -> np.ndarray:
        """The table row of each of the (distinct) words; unknown ones are encoded first."""
        if len(self.rows) + len(words) > TABLE_WORDS:
            self.clear()
        rows = self.rows
        found = list(map(rows.get, words))
        new = [w for w, r in zip(words, found, strict=True) if r is None]
        if new:
            encoded = [self.encode_word(w) for w in new]
            lengths = np.fromiter(map(len, encoded), np.int64, len(new))
            ids = np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum()))
            first, end = len(rows), self.used + len(ids)
            while end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while first + len(new) > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.flat[self.used : end] = ids
            self.lengths[first : first + len(new)] = lengths
            self.starts[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.used = end
            rows.update(zip(new, range(first, first + len(new)), strict=True))
            found = [rows[w] if r is None else r for w, r in zip(words, found, strict=True)]
        return np.array(found, np.int64)

    def encode_word(self, word: str) -> list[int]:
        """The ids of a word: plain ones are cut as the pre-tokenizer cuts them, others go through the library whole."""
        if not _PLAIN(word) or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        tokenize, out = self.tokenizer.model.tokenize, []
        for p in _PARTS(word.lower()):
            out += [t.id for t in tokenize(p if p.isascii() else "".join([_BYTES[b] for b in p.encode()]))]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the offset of each text in them."""
        if not self.known:
            each = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.array(list(chain.from_iterable(each)), np.uint32), np.cumsum([0, *map(len, each)])
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        parts = []
        for rows, split in ((np.flatnonzero(~odd), pre_tokens), (np.flatnonzero(odd), distinct_words)):
            if len(rows):
                words, at, offsets = split(texts if len(rows) == len(texts) else texts.take(pa.array(rows)))
                row = self.lookup(words)[at] if len(at) else np.zeros(0, np.int64)
                lengths = self.lengths[row]
                ids = self.flat[ragged(self.starts[row], lengths)]
                parts.append((rows, ids, np.concatenate([[0], np.cumsum(lengths)])[offsets]))
        if len(parts) == 1:
            return parts[0][1], parts[0][2]
        size, start, shift = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        for rows, ids, offsets in parts:
            size[rows], start[rows], shift = np.diff(offsets), offsets[:-1] + shift, shift + len(ids)
        return np.concatenate([p[1] for p in parts])[ragged(start, size)], np.concatenate([[0], np.cumsum(size)])


@lru_cache(maxsize=4)
def word_table(path: str) -> WordTable:
    """The worker's table for a vocabulary file."""
    return WordTable(path)


@lru_cache(maxsize=4)
def pieces(path: str) -> pa.Array:
    """The piece of each id."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return pa.array([t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))], pa.string())


def slices(texts: pa.Array, size: int = 4_000_000):
    """Runs of rows of about ``size`` bytes at most (one row at least): [first, end)."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if i > first and total + n > size:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def encode(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, ids): the token ids of each whole text, as the library gives them without added special tokens."""
    prepare(df.sparkSession)
    out = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            texts = byte_order(b.column(1))
            for i, j in slices(texts):
                ids, offsets = word_table(path).encode(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j].cast(pa.int64()), lists], schema=out)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` bigint, ids array<int>")


def decode(df: DataFrame, id_col: str, path: str) -> DataFrame:
    """(id, ids, decoded): the pieces of the ids, joined by a blank as the library does for this vocabulary.

    A null list of ids, or an empty one, decodes to the empty string; an id outside the vocabulary is skipped.
    """
    prepare(df.sparkSession)

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(1).cast(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([b.column(0), lists, decoded(lists, path)], names=[id_col, "ids", "decoded"])

    return df.select(id_col, "ids").mapInArrow(by_batch(step), f"`{id_col}` bigint, ids array<int>, decoded string")


def decoded(lists: pa.ListArray, path: str) -> pa.Array:
    """The id-to-piece join of one batch."""
    tokenizer = word_table(path).tokenizer
    if tokenizer.decoder is not None:
        return pa.array([tokenizer.decode([i for i in x or [] if tokenizer.id_to_token(i) is not None], skip_special_tokens=False) for x in lists.to_pylist()], pa.string())
    table = pieces(path)
    flat = lists.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    if not pc.all(known).as_py() and len(flat):
        kept = np.concatenate([[0], np.cumsum(pc.fill_null(known, False).to_numpy(zero_copy_only=False))])
        flat, offsets = flat.filter(known), kept[offsets]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), table.take(flat)), " ")


def digests(df: DataFrame, id_col: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of a table with ids and decoded."""

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(1).cast(pa.list_(pa.int32()))
        flat = lists.flatten().to_numpy().astype("<u4").view(np.uint8).data
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = 4 * np.cumsum(n)
        sha = [hashlib.sha256(flat[a:z]).hexdigest() for a, z in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)]
        text = [hashlib.sha256((x or "").encode()).hexdigest() for x in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sha), pa.array(text)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, "ids", "decoded").mapInArrow(by_batch(step), f"`{id_col}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
