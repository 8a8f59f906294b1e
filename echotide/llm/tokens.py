"""Word-cached encoding with a tokenizer of the `tokenizers` library.

Its pre-tokenizer never lets a piece cross white space, so the ids of a text are those of its
words one after another. Arrow splits a batch of texts into words and numbers the distinct
ones; each of these is looked up, or encoded once and kept, and the ids of all words are then
gathered in array operations. The lookup table has a bounded size.

A text is lower-cased beforehand only where the normalizer does just that: where all of it is
Latin-1 and no special token can be in it. Marks behind a word are looked up apart from it
only where it ends in a letter or digit that the normalizer leaves as it is; the apostrophe and the
marks of special tokens stay with their word.
"""

from __future__ import annotations

import functools
import gc
import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by a worker; bytes of text handled at a time, and encoded at a time.
KEPT_WORDS, SLICE_CHARS, ENCODED_CHARS = 450_000, 2_000_000, 8_000_000
END_ID = 1
#: Words that are one piece and that the normalizer leaves alone; words that marks can be cut off from end in one of these before their marks.
_LETTERS, _MARKS = "^[a-zß-öø-ÿ]+$", "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_BEFORE_MARKS = pa.array([c for c in map(chr, range(256)) if c.isdecimal() or c.islower() and c not in "ªµº"], pa.large_string())

#: Stands for the end of a text in the table of words; no word is white space.
_END = "\n"


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at starts and are sizes long, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _listed(words: pa.Array) -> list[str]:
    """Words without white space as a list; quicker than one by one."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_py().split(" ")


def _after(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """What follows the first so many bytes of each word."""
    if not len(words):
        return words
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    starts = offsets[:-1] + sizes
    left = offsets[1:] - starts
    ends = np.concatenate([[0], np.cumsum(left)])
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(np.frombuffer(data, np.uint8)[gathered(starts, left)]))


class _Store:
    """Ids of words, one after another in one array, and how often each word was looked for."""

    def __init__(self, dtype: np.dtype):
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.starts, self.sizes, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the new words are kept."""
        at, to = len(self.index), len(self.index) + len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while to > len(self.starts):
            self.starts, self.sizes, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.uses))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at:to] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at:to] = sizes
        self.uses[at:to] = 1
        self.used += len(ids)
        self.index.update(zip(words, range(at, to)))
        return np.arange(at, to)

    def find(self, words: list[str]) -> np.ndarray:
        """Where words are kept, -1 for others."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        self.uses[at[at >= 0]] += 1
        return at

    def most_used(self, n: int) -> _Store:
        """A store of the n words looked for most often, later ones first where equal; earlier uses count half from then on."""
        order = np.sort(np.argsort(self.uses[: len(self.index)], kind="stable")[-n:])
        words, sizes, kept = list(self.index), self.sizes[order], _Store(self.flat.dtype)
        kept.add([words[i] for i in order.tolist()], self.flat[gathered(self.starts[order], sizes)], sizes)
        kept.uses[: len(order)] = self.uses[order] // 2
        return kept


class WordEncoder:
    """Ids of whole texts."""

    def __init__(self, path: str, keep: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        # Takes many words of lower-case Latin letters at once, whose bytes stand as the letters that ByteLevel puts for them.
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit(" ")
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = "".join(map(chr, range(0xDF, 0x100)))
        self.renamed = sorted({(a, b) for a, b in zip(letters.encode().decode("latin-1"), by_bytes.pre_tokenize_str(letters)[0][0]) if a != b})
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = os.path.commonprefix(special) or None
        self.dtype = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.keep, self.known = keep, _Store(self.dtype)

    def _lowered(self, text: str) -> str:
        if self.special is None or self.special in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the store keeps each of these distinct words, learnt if need be."""
        listed = _listed(words)
        at = self.known.find(listed)
        new = np.flatnonzero(at < 0)
        if len(self.known.index) + len(new) > self.keep:
            self.known = self.known.most_used(self.keep // 2)
            at = self.known.find(listed)
            new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        fresh = words.take(pa.array(new))
        simple = pc.match_substring_regex(fresh, _LETTERS)
        plain = fresh.filter(simple)
        simple = simple.to_numpy(zero_copy_only=False)
        letters = " ".join(_listed(plain)).encode().decode("latin-1")
        for a, b in self.renamed:
            letters = letters.replace(a, b)
        ids = np.array(self.plain.encode_batch_fast([letters], add_special_tokens=False)[0].ids, self.dtype)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(plain):  # A vocabulary without an end in each word: no shortcut.
            simple, ids, stops = np.zeros(len(new), bool), ids[:0], stops[:0]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(_listed(fresh.filter(pa.array(~simple))), add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum()))])
        order = np.concatenate([new[simple], new[~simple]])
        at[order] = self.known.add(_listed(fresh.take(pa.array(np.argsort(~simple, kind="stable")))), ids, np.concatenate([np.diff(stops, prepend=0), sizes]))
        return at

    def encode(self, texts: list[str], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id behind each, and where each text's ids end."""
        split = pc.ascii_split_whitespace(pa.array([self._lowered(t) for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        # A distinct word is one entry of the store, or two: what is before the marks behind it, and these.
        bare = pc.ascii_rtrim(words, characters=_MARKS)
        sizes = pc.binary_length(bare)
        marked = pc.and_(pc.less(sizes, pc.binary_length(words)), pc.is_in(pc.utf8_slice_codeunits(bare, -1), _BEFORE_MARKS))
        marks = _after(words.filter(marked), sizes.filter(marked).to_numpy())
        both = pa.concat_arrays([pc.if_else(marked, bare, words), marks]).dictionary_encode()
        place = self._places(both.dictionary)[both.indices.to_numpy()]
        marked = marked.to_numpy(zero_copy_only=False)
        entries = np.insert(place[: len(words)], np.flatnonzero(marked) + 1, place[len(words) :])
        n = marked + 1
        taken = n[index]
        ends = np.concatenate([[0], np.cumsum(taken)])[split.offsets.to_numpy()[1:]]
        entry = entries[gathered((np.cumsum(n) - n)[index], taken)]
        if _END not in self.known.index:
            self.known.add([_END], np.array([end_id], self.dtype), np.array([1]))
        entry = np.insert(entry, ends, self.known.index[_END])
        sizes = self.known.sizes[entry]
        ids = self.known.flat[gathered(self.known.starts[entry], sizes)]
        return ids, np.cumsum(sizes)[ends + np.arange(len(texts))]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker. Its table of many small objects holds no cycles, so Python looks for them less often."""
    gc.set_threshold(500_000, 50, 50)
    return WordEncoder(path)


def crc32_of(ids: np.ndarray, start: int = 0) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"), start)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part has about `chars` bytes of text, or one row."""
    for b in batches:
        sizes = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + chars, "right")))
            yield b.slice(at, to - at)
            at = to


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int = END_ID) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each part of the batches with the ids of its texts, end_id behind each, and where each text's ids end."""
    enc = encoder(path)
    for part in slices(batches, chars=ENCODED_CHARS):
        yield part, *enc.encode([t or "" for t in part.column("text").to_pylist()], end_id)
