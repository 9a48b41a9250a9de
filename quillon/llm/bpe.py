"""Byte-pair encoding in linear time, and decoding.

Encoding follows the backtracking construction: an Aho-Corasick automaton over
the vocabulary finds, in one pass over a piece, the longest token that starts at
each byte; the encoder takes longest tokens from left to right and steps back to
the next shorter token whenever a token cannot stand beside its left neighbour.
Whether two tokens can be neighbours is read from a table of pairs, filled on
demand by undoing merges across the seam. A sequence of tokens in which all
neighbours are compatible is the one that the merge rules give, so the result is
exact. Decoding gathers bytes from one blob by an offset table.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts_to_python

#: How byte-level vocabularies cut a text into pieces (fixed value of the public format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces, and as many encoded words, of a generation that a worker remembers (there
#: are two: what the older holds moves on when it is met again), and the longest of them.
CACHE_PIECES, CACHE_BYTES = 80_000, 48
#: Pairs of tokens that the compatibility table remembers.
TABLE_PAIRS = 160_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [out[b] for b in range(256)]


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id; ids that nothing uses have none."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for t, i in vocab.items():
        out[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    for t, i in special.items():
        out[i] = t.encode()
    return out


class Decoder:
    """All tokens' bytes in one blob, and where each begins."""

    def __init__(self, spec: dict):
        as_bytes = token_bytes(spec)
        self.blob = np.frombuffer(b"".join(as_bytes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in as_bytes])]).astype(np.int64)

    def decode(self, ids: bytes | None) -> str:
        """Text of packed ids; bytes that are not UTF-8 become U+FFFD. Null counts as empty."""
        if not ids:
            return ""
        out, all_ids, offsets = [], np.frombuffer(ids, "<u4").astype(np.int64), self.offsets
        for k in range(0, len(all_ids), 1 << 18):
            i = all_ids[k : k + (1 << 18)]
            start, size = offsets[i], offsets[i + 1] - offsets[i]
            ends = np.cumsum(size)
            out.append(self.blob[np.arange(ends[-1]) + np.repeat(start - ends + size, size)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


class Encoder:
    """Encoder of one byte-level vocabulary (the parsed tokenizer file)."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout") if model.get(k)]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges") or odd:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens with strip or word rules are not supported")
        as_bytes = token_bytes(spec)
        size = len(as_bytes)
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pieces = regex.compile(PIECES)
        self.bytes_of, self.length = as_bytes, [len(b) for b in as_bytes]
        # merges: rank and result by pair; how each token falls apart again
        self.rank: dict[tuple[int, int], int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.made_at = [-1] * size
        self.split: list[tuple[int, int] | None] = [None] * size
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            if pair not in self.rank:
                self.rank[pair], self.joined[pair] = r, whole
            if self.split[whole] is None:
                self.split[whole], self.made_at[whole] = pair, r
        # tokens that the merges of their own bytes arrive at
        self.id_of: dict[bytes, int] = {}
        single = {}
        for t, i in vocab.items():
            if len(as_bytes[i]) == 1:
                single[as_bytes[i][0]] = i
        self.single = [single[b] for b in range(256)]
        for i in sorted(vocab.values(), key=lambda i: len(as_bytes[i])):
            if len(as_bytes[i]) == 1 or self.split[i] and self.by_merging(as_bytes[i]) == [i]:
                self.id_of[as_bytes[i]] = i
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        # the next shorter token that starts a token
        self.shorter = [-1] * size
        for b, i in self.id_of.items():
            for n in range(len(b) - 1, 0, -1):
                if (j := self.id_of.get(b[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.size = size
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # the same for whole words after a space
        self.old_spaced: dict[str, bytes] = {}

    def by_merging(self, data: bytes) -> list[int]:
        """The merge rules applied one by one: quadratic, for tokens only."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda k: self.rank.get((ids[k], ids[k + 1]), 1 << 60))
            if (pair := (ids[best], ids[best + 1])) not in self.rank:
                break
            ids[best : best + 2] = [self.joined[pair]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of left's and right's bytes leave exactly these two tokens.

        The seam stays open if no merge joins across it before the merges that
        build the two tokens on either side have run; so undo the later of the two
        tokens' last merges, again and again, and look for a pair that would have
        joined earlier than what has been undone.
        """
        key = left * self.size + right
        known = self.fits.get(key)
        if known is not None:
            return known
        a, b, rank, made_at, split = left, right, self.rank, self.made_at, self.split
        before, at_equal = 1 << 60, False
        fine = True
        while True:
            r = rank.get((a, b))
            # at the same rank the leftmost place joins first: the seam lies to the
            # left of a merge inside the right token, to the right of one in the left
            if r is not None and (r < before or r == before and at_equal):
                fine = False
                break
            if split[a] is None and split[b] is None:
                break
            if made_at[a] > made_at[b]:
                before, at_equal = made_at[a], False
                a = split[a][1]
            else:
                before, at_equal = made_at[b], True
                b = split[b][0]
        if len(self.fits) >= TABLE_PAIRS:
            self.fits.clear()
        self.fits[key] = fine
        return fine

    def piece(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        n = len(data)
        if (whole := self.id_of.get(data)) is not None:
            return [whole]
        where = [0] * n  # matches come by their ends, so the last of a start is its longest
        for end, (size, i) in self.automaton.iter(data.decode("latin-1")):
            where[end - size + 1] = i
        shorter, length, known, many = self.shorter, self.length, self.fits.get, self.size
        out: list[int] = []
        dead = bytearray(n + 1)  # places from which the rest was found to have no encoding
        at, token = 0, where[0]
        while True:
            end = at + length[token]
            if out and not dead[end]:
                fine = known(out[-1] * many + token)
                if fine is None:
                    fine = self.compatible(out[-1], token)
            else:
                fine = not dead[end]
            if fine:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = where[at]
                continue
            token = shorter[token]
            while token < 0:  # nothing starts here after out[-1]: shorten that one
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def segment(self, text: str, keep: bool = True) -> bytes:
        """Ids of a stretch of text that begins and ends where pieces do; keep: remember its pieces."""
        cache, out = self.cache, []
        for p in self.pieces.findall(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.old.get(p)
                if ids is None:
                    ids = array("I", self.piece(p.encode())).tobytes()
                if keep and len(p) <= CACHE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        self.old, cache = cache, {}
                        self.cache = cache
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)

    def plain(self, text: str) -> list[bytes]:
        """Ids of a text without special tokens.

        Pieces never run across the change from another character to white space,
        and a single space before another character belongs to what follows; so
        words are looked up whole, each with the space before it. Longer white
        space goes to the pattern together with the next word.
        """
        first, *words = text.split(" ")
        found = list(map(self.spaced.get, words))
        if first and not first[-1].isspace():
            out, pending = [self.segment(first)], None
            if None not in found:
                return out + found
        else:
            out, pending = [], first
        for w, ids in zip(words, found):
            if pending is not None:
                pending += " " + w
                if w and not w[-1].isspace():
                    out.append(self.segment(pending))
                    pending = None
            elif ids is not None:
                out.append(ids)
            elif w and not w[-1].isspace() and not w[0].isspace():
                out.append(self.word(w))
            elif w and not w[-1].isspace():
                out.append(self.segment(" " + w))
            else:
                pending = " " + w
        if pending is not None:
            out.append(self.segment(pending))
        return out

    def word(self, w: str) -> bytes:
        """Ids of a space and a word after it."""
        ids = self.spaced.get(w)
        if ids is None:
            ids, short = self.old_spaced.get(w), len(w) <= CACHE_BYTES
            if ids is None:
                ids = self.segment(" " + w, not (short and w.isalpha()))  # a word of letters is one piece: remembered here
            if short:
                if len(self.spaced) >= CACHE_PIECES:
                    self.old_spaced, self.spaced = self.spaced, {}
                self.spaced[w] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Null counts as empty."""
        if not text:
            return b""
        if self.cut is None:
            return b"".join(self.plain(text))
        out: list[bytes] = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                out.extend(self.plain(part))
        return b"".join(out)


_made: dict[tuple, Encoder | Decoder] = {}


def made(kind: type, raw: bytes) -> Encoder | Decoder:
    """The coder of a vocabulary file, made once in each worker process."""
    key = (kind, hashlib.sha256(raw).digest())
    if key not in _made:
        _made[key] = kind(json.loads(raw))
    return _made[key]


def _mapped(df: DataFrame, schema: str, raw: bytes, kinds: tuple[type, ...], work) -> DataFrame:
    texts_to_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(raw)  # one vocabulary file, 1.5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [made(k, shared.value) for k in kinds]
        for b in batches:
            yield from work(*coders, b)

    return df.mapInArrow(run, schema)


def _cuts(b: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values hold about `most` bytes, so that very long texts don't add up."""
    start = size = 0
    for k, v in enumerate(b.column(column)):
        size += v.as_buffer().size if v.is_valid else 0
        if size >= most:
            yield b.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < b.num_rows:
        yield b.slice(start)


def encode(docs: DataFrame, tokenizer: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each whole text's token ids, packed as little-endian uint32.

    tokenizer: content of the vocabulary file. A null text encodes as an empty one;
    ids may be null or repeat, each row stands for itself; other columns are not read.
    Narrow: no shuffle, and memory is bounded by the longest text.
    """
    t = dict(docs.dtypes)[id_col]

    def work(c: Encoder, b: pa.RecordBatch):
        for part in _cuts(b, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.encode(x) for x in part.column(1).to_pylist()], pa.binary())], ["id", "ids"])

    out = _mapped(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")), f"id {t}, ids binary", tokenizer, (Encoder,), work)
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, tokenizer: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): the text that packed ids stand for. Null ids decode as empty."""
    t = dict(rows.dtypes)[id_col]

    def work(c: Decoder, b: pa.RecordBatch):
        for part in _cuts(b, 1, 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.decode(x) for x in part.column(1).to_pylist()], pa.string())], ["id", "ids", "decoded"])

    out = _mapped(rows.select(rows[f"`{id_col}`"].alias("id"), rows[f"`{ids_col}`"].alias("ids")), f"id {t}, ids binary, decoded string", tokenizer, (Decoder,), work)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("ids", ids_col)


def round_trip(docs: DataFrame, tokenizer: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): encode and decode in one pass, with the rules of both."""
    t = dict(docs.dtypes)[id_col]

    def work(e: Encoder, d: Decoder, b: pa.RecordBatch):
        for part in _cuts(b, 1):
            ids = [e.encode(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([d.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    out = _mapped(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")), f"id {t}, ids binary, decoded string", tokenizer, (Encoder, Decoder), work)
    return out.withColumnRenamed("id", id_col)
