"""Byte-level BPE encoding and decoding over Arrow batches (operator 5).

A text is cut at single spaces into units (``" word,"``); the merges never cross such a cut, since the splitting
pattern always starts a new piece at a space that precedes a visible character.  Every distinct unit of a batch is
encoded once by the library's model, piece by piece of the pattern, and the ids of all documents are gathered from those
with numpy.  Texts that have a space before white space or at their end are encoded whole.

Defined cases: a null text counts as the empty one (no ids); strings of special tokens are ordinary text; repeated
rows give repeated results; lone characters outside the vocabulary cannot occur, as all 256 bytes are in it; an empty table
gives no rows; further columns are ignored; a text is encoded whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow, slices

#: Distinct units that a worker remembers (some 300 bytes each); beyond it the memory is emptied.  A batch has about 200,000, so fewer would be forgotten at every batch.
UNITS_KEPT = 1_000_000
#: Marks, digits and line ends that a worker remembers.
PIECES_KEPT = 150_000
#: Bytes of text that are encoded together.
BATCH_BYTES = 6 << 20


# fixed value: the splitting pattern of byte-level vocabularies, for ASCII text
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print keep their code point; the rest, in order, take the code points from 256.
    """
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteTable:
    """Bytes of every id, from the vocabulary's strings and the reversed byte table."""

    def __init__(self, vocab: dict[str, int]):
        back = {c: b for b, c in enumerate(byte_chars())}
        self.of = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.of[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        self.lens = np.array([len(b) for b in self.of], np.int64)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of ids.  A character that is split over ids is whole again once all its bytes are there; a torn one becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def byte_offsets(self, ids) -> np.ndarray:
        """(start, end) in bytes of each id."""
        ends = np.cumsum(self.lens[np.asarray(ids, np.int64)]) if len(ids) else np.zeros(0, np.int64)
        return np.stack([np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends], 1)


def char_offsets(text: str, spans: np.ndarray) -> np.ndarray:
    """Byte spans as spans of code points: start is the character that holds the first byte, end is after the one that holds the last."""
    raw = np.frombuffer(text.encode(), np.uint8)
    index = np.concatenate([np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]]) if len(raw) else np.zeros(1, np.int64)
    return np.stack([index[spans[:, 0]], index[spans[:, 1] - 1] + 1], 1) if len(spans) else spans


class Encoder:
    """Ids of whole texts.  ``library``: "tokenizers" or "tiktoken"; both give the same ids for the same vocabulary.

    ``special``: strings of special tokens have the special ids (tokenizers only); else they are ordinary text.
    """

    def __init__(self, file: str, library: str = "tokenizers", pattern: str | None = None, special: bool = False):
        #: Strings that have an id of their own; a text that holds one is encoded whole.
        self.special: tuple[str, ...] = ()
        if library == "tokenizers":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(file)
            whole.encode_special_tokens = not special
            if special:
                self.special = tuple(t.content for t in whole.get_added_tokens_decoder().values())
            chars, tokenize = byte_chars(), whole.model.tokenize
            space = chars[32]
            self.vocabulary = whole.get_vocab

            def letters(word: str) -> list[int]:
                # ASCII letters stand for themselves
                return [t.id for t in tokenize(space + word if word.isascii() else "".join([chars[b] for b in (" " + word).encode()]))]

            def one(text: str) -> list[int]:
                return whole.encode(text, add_special_tokens=False).ids

            shown = {b: chars[b] for b in range(128)}
            others: dict[str, list[int]] = {}

            def ascii_unit(unit: str) -> list[int]:
                ids = []
                for piece in _ASCII_PIECES.findall(" " + unit):
                    if piece[-1].isalpha():
                        ids += [t.id for t in tokenize(piece.translate(shown))]
                        continue
                    # marks, digits and line ends are few
                    got = others.get(piece)
                    if got is None:
                        got = [t.id for t in tokenize(piece.translate(shown))]
                        if len(piece) <= 16 and len(others) < PIECES_KEPT:
                            others[piece] = got
                    ids += got
                return ids
        else:
            import tiktoken

            with open(file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            ascii_unit = None
            own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            single = getattr(own._core_bpe, "encode_single_piece", None)
            one = own.encode_ordinary

            def letters(word: str) -> list[int]:
                return single((" " + word).encode()) if single else one(" " + word)

        #: Ids of a space and a run of letters, which is one piece of the pattern; of any text.
        self.letters, self.one, self.ascii_unit = letters, one, ascii_unit
        #: Ids of single marks that follow a word.
        self.marks = {c: one(c) for c in ",.;:!?"}
        self._forget()

    def _forget(self) -> None:
        #: Number of each unit that is remembered; 0 has no ids.  The ids of unit k are pool[begin[k] : begin[k + 1]].
        self.known: dict[str, int] = {}
        self.pool, self.begin = array("I"), array("i", [0, 0])

    def _add(self, ids: list[int]) -> int:
        self.pool.fromlist(ids)
        self.begin.append(len(self.pool))
        return len(self.begin) - 2

    def _learn(self, units: list[str], special: list[str]) -> None:
        """Remember units that are new."""
        known, letters, marks, one, ascii_unit = self.known, self.letters, self.marks, self.one, self.ascii_unit
        pool, put, ends, n = self.pool, self.pool.fromlist, self.begin, len(self.begin) - 1
        size = len(self.pool)
        for u in units:
            if u.isalpha():
                ids = letters(u)
            elif u[-1:] in marks and u[:-1].isalpha():
                # letters and one mark are two pieces of the pattern; the letters may be known
                k = known.get(u[:-1])
                ids = (pool[ends[k] : ends[k + 1]].tolist() if k else letters(u[:-1])) + marks[u[-1]]
            elif u and not u[0].isspace() and not any(x in u for x in special):
                ids = ascii_unit(u) if ascii_unit and u.isascii() else one(" " + u)
            else:
                # no ids mark a unit that is empty or starts with white space: the text has a space before white space or
                # its end; and a unit with a special token
                known[u] = 0
                continue
            put(ids)
            size += len(ids)
            ends.append(size)
            known[u] = n
            n += 1

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one entry more than texts)."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        units = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = units.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], units.flatten()
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        first = offsets[:-1]
        # strings with an id of their own that occur here
        special = [x for x in self.special if pc.any(pc.match_substring(texts, x)).as_py()]
        if len(self.known) > UNITS_KEPT:
            self._forget()
        self._learn([u for u in names if u not in self.known], special)
        number = np.fromiter(map(self.known.__getitem__, names), np.int32, len(names))
        codes = number[coded.indices.to_numpy()]
        odd = codes == 0
        odd[first] = False
        odd_text = np.add.reduceat(odd, first) > 0
        # the first unit of a text has no space before it; an odd text is one unit
        starts: dict[str, int] = {}
        seen = flat.take(pa.array(first)).to_pylist()
        for k in range(n):
            key = texts[k].as_py() if odd_text[k] else seen[k]
            if key not in starts:
                starts[key] = self._add(self.one(key)) if key else 0
            codes[first[k]] = starts[key]
        if odd_text.any():
            keep = np.ones(len(codes), bool)
            for k in np.flatnonzero(odd_text):
                keep[offsets[k] + 1 : offsets[k + 1]] = False
            bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
            codes = codes[keep]
        else:
            bounds = offsets
        # a batch of strings has fewer than 2**31 bytes, so its ids are numbered with 32 bits
        begin, pool = np.frombuffer(self.begin, np.int32), np.frombuffer(self.pool, np.uint32)
        each = np.diff(begin)[codes]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        where = np.repeat((begin[codes] - ends[:-1]).astype(np.int32), each)
        where += np.arange(ends[-1], dtype=np.int32)
        ids = pool[where]
        # the buffers may grow again
        del begin, pool
        # what a special token makes of a unit holds for its text alone
        for u in [u for u in self.known if any(x in u for x in special)] if special else ():
            del self.known[u]
        return ids, ends[bounds]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(file: str, library: str = "tokenizers", pattern: str | None = None, special: bool = False) -> Encoder:
    """The worker's own encoder of ``file``."""
    key = (file, library, pattern, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, token ids, and (start, end) of each token in bytes and in code points."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        table = ByteTable(enc.vocabulary())
        for b in slices(batches, text_col, BATCH_BYTES):
            ids, at = enc.batch(b.column(text_col))
            out: dict[str, list] = {"ids": [], "byte_offsets": [], "char_offsets": []}
            for k, text in enumerate(b.column(text_col).to_pylist()):
                own = ids[at[k] : at[k + 1]]
                spans = table.byte_offsets(own)
                out["ids"].append(own.astype(np.int32))
                out["byte_offsets"].append(spans.astype(np.int32).ravel())
                out["char_offsets"].append(char_offsets(text or "", spans).astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(v, pa.list_(pa.int32())) for v in out.values())], [id_col, *out])

    return arrow(docs.select(id_col, text_col), kernel, f"`{id_col}` {kind}, ids array<int>, byte_offsets array<int>, char_offsets array<int>")


def decode(encoded: DataFrame, file: str, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``encode``: the text that its ids stand for."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ByteTable(encoder(file).vocabulary())
        for b in batches:
            texts = [table.decode(x or ()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    return arrow(encoded.select(id_col, "ids"), kernel, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, SHA-256 of its ids (decimal, one space between) and of the bytes decoded from them, and offsets_crc32.

    The last is the CRC-32 of the (start, end) in code points of all its tokens, as little-endian 32-bit numbers.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        table = ByteTable(enc.vocabulary())
        shown, raw, sha = [str(i) for i in range(len(table.of))], table.of, hashlib.sha256
        for b in slices(batches, text_col, BATCH_BYTES):
            ids, at = enc.batch(b.column(text_col))
            a, d, o = [], [], []
            for k, text in enumerate(b.column(text_col).to_pylist()):
                own = ids[at[k] : at[k + 1]].tolist()
                a.append(sha(" ".join(map(shown.__getitem__, own)).encode()).hexdigest())
                d.append(sha(b"".join(map(raw.__getitem__, own))).hexdigest())
                o.append(zlib.crc32(char_offsets(text or "", table.byte_offsets(own)).astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(np.diff(at), pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(o, pa.int64())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "offsets_crc32"])

    return arrow(docs.select(id_col, text_col), kernel, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_crc32 long")
