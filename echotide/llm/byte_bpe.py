"""BPE encoding and decoding with forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary marks a certain cut: no
token can span it. Texts are split at these pairs first, in one array operation over
the bytes of a batch, where the cut also starts a piece of the pre-tokenizer (a space
after a byte that isn't white space, a mark after a letter). Fragments are encoded independently, and their ids
joined. Inside a fragment, pieces of the pre-tokenizer are cut again at pairs that
occur nowhere, and the library's merge step runs on each part alone. Fragments recur, so a worker keeps the ids of a
bounded number of them.

Cases: null counts as empty; an empty text has no ids; a special token's string in a
text becomes its id, as the library does by default; texts of any length are handled
whole; rows with null or repeated doc_id are kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, batch, table, text_of

#: Fixed value: how byte-level BPE cuts a text before any merge.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Fragments that are plainly a piece of letters, or one with a piece of marks behind.
_PLAIN = re.compile(rb"( ?[A-Za-z]+)([.,;:!?]*)")
_MARKS, _LETTERS = np.zeros(256, bool), np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
KEPT_FRAGMENTS = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBPE:
    def __init__(self, path: str, keep: int = KEPT_FRAGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id: dict[int, bytes] = {i: as_bytes(t) for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ids = {b: i for i, b in self.by_id.items()}
        self.by_id |= {i: t.encode() for t, i in self.special.items()}
        self.special_bytes = {t.encode(): i for t, i in self.special.items()}
        # Runs the merges of one piece, given in the letters that stand for bytes.
        self.merges = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "truncation": None, "padding": None}))
        self.letter = {b: c for c, b in letters.items()}
        self.space = self.letter[32]
        self.decimal = {i: str(i) for i in self.by_id}
        # never[a, b]: no token has byte b right after byte a.
        self.never = np.ones((256, 256), bool)
        for token in self.ids:
            t = np.frombuffer(token, np.uint8)
            self.never[t[:-1], t[1:]] = False
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.keep, self.known = keep, {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places in the bytes of valid UTF-8 where both the vocabulary and the pre-tokenizer force a cut.

        Before a space: the byte before ends no white-space character (it is ASCII above the space, or
        ends a two-byte character from U+00C0 on). Between an ASCII letter and a mark.
        """
        if len(data) < 3:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(data[1:] == 32)
        last, before = data[at], data[np.maximum(at - 1, 0)]
        plain = (last > 32) & (last < 127) | (last >= 128) & (before >= 0xC3) & (before <= 0xDF)
        spaces = at[plain & self.never[last, 32]]
        at = np.flatnonzero(_MARKS[data[1:]])
        marks = at[_LETTERS[data[at]] & self.never[data[at], data[at + 1]]]
        return np.sort(np.concatenate([spaces, marks]), kind="stable") + 1

    def pieces(self, fragment: bytes) -> list[bytes]:
        """Pieces of the pre-tokenizer and special tokens."""
        if m := _PLAIN.fullmatch(fragment):
            return [m[1], m[2]] if m[2] else [fragment]
        found: list[bytes] = []
        text = fragment.decode()
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            found += [part.encode()] if k % 2 else map(str.encode, PIECES.findall(part))
        return found

    def _cut(self, pieces: list[bytes]) -> dict[bytes, list[bytes]]:
        """The pieces that have forced pairs inside, cut at them; looked up over all pieces at once."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(list(map(len, pieces)))
        at = np.flatnonzero(self.never[data[:-1], data[1:]]) + 1
        inside = np.ones(len(data) + 1, bool)
        inside[ends] = False
        at = at[inside[at]]
        out: dict[bytes, list[bytes]] = {}
        for k, cut in zip(np.searchsorted(ends, at, "right").tolist(), at.tolist()):
            piece = pieces[k]
            done = out.setdefault(piece, [piece])
            cut -= int(ends[k]) - len(done[-1])  # what is left of the piece ends where it does
            done[-1:] = [done[-1][:cut], done[-1][cut:]]
        return out

    def _learn(self, fragments: set[bytes]) -> None:
        new = fragments.difference(self.known)
        if len(self.known) + len(new) > self.keep:
            self.known, new = {}, fragments
        found = {f: self.pieces(f) for f in new}
        # A piece that was a fragment by itself is known already.
        unknown = list(set(chain.from_iterable(found.values())).difference(self.known, self.special_bytes))
        cut = self._cut(unknown) if unknown else {}
        ids: dict[bytes, Sequence[int]] = {p: (i,) for p, i in self.special_bytes.items()}
        merge = list({x for p in unknown for x in cut.get(p, (p,))})
        if merge:
            letters = [p.decode().replace(" ", self.space) if p.isalnum() or p[1:].isalnum() and p[:1] == b" " and p.isascii() else p.decode("latin-1").translate(self.letter) for p in merge]
            done = self.merges.encode(letters, is_pretokenized=True, add_special_tokens=False)
            flat, ends = done.ids, np.cumsum(np.bincount(np.array(done.word_ids), minlength=len(merge))).tolist()
            ids |= zip(merge, map(lambda a, z: flat[a:z], [0, *ends[:-1]], ends))
        for p, parts in cut.items():
            ids[p] = list(chain.from_iterable(map(ids.__getitem__, parts)))
        decimal, token = self.decimal.__getitem__, self.by_id.__getitem__
        for f, parts in found.items():
            of = [ids[p] if p in ids else self.known[p][0] for p in parts]
            own = of[0] if len(of) == 1 else list(chain.from_iterable(of))
            # Tokens decode independently, so a fragment's bytes and decimals can be joined too.
            self.known[f] = (own, ",".join(map(decimal, own)), b"".join(map(token, own)))

    def fragments(self, texts: pa.Array) -> list[list[tuple[Sequence[int], str, bytes]]]:
        """(ids, ids as decimals, bytes that they decode to) of each fragment of each text; nulls have none."""
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        raw = whole.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if whole else b""
        starts = offsets - offsets[0]
        bounds = np.sort(np.concatenate([self.cuts(np.frombuffer(raw, np.uint8)), starts]), kind="stable")
        bounds = bounds[np.append(True, bounds[1:] != bounds[:-1])]
        parts = list(map(raw.__getitem__, map(slice, bounds[:-1].tolist(), bounds[1:].tolist())))
        self._learn(set(parts))
        done = list(map(self.known.__getitem__, parts))
        # An empty text begins and ends at one place and so has no fragments.
        at = np.searchsorted(bounds, starts).tolist()
        return [done[a:z] for a, z in zip(at, at[1:])]

    def encode(self, texts: pa.Array) -> list[list[int]]:
        """Ids of each text; nulls have none."""
        return [list(chain.from_iterable(f[0] for f in parts)) for parts in self.fragments(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """One per worker. Its table of many small objects holds no cycles, so Python looks for them less often."""
    gc.set_threshold(500_000, 50, 50)
    return ByteBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in tokens.slices(batches):
            yield batch(schema, b.column("doc_id"), bpe.encode(b.column("text")))

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that ids stand for."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in batches:
            yield batch(schema, b.column("doc_id"), [bpe.decode(x or []) for x in b.column("ids").to_pylist()])

    return arrow_map(encoded, rows, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, sha256 of its ids as decimals, sha256 of what they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in tokens.slices(batches):
            out = []
            for doc, parts in zip(b.column("doc_id").to_pylist(), bpe.fragments(b.column("text"))):
                ids, decimals, raw = zip(*parts) if parts else ((), (), ())
                text = b"".join(raw).decode("utf-8", "replace")
                out.append((doc, sum(map(len, ids)), hashlib.sha256(",".join(decimals).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            yield batch(schema, *zip(*out))

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
