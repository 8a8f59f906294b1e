"""Benchmark decontamination: windows of test items found in training texts, verified, and cut out or dropped with their documents.

Words are runs of digits, letters and everything beyond ASCII, after A-Z is lower-cased. A window is `size`
consecutive words of an item; an item of fewer words, but not none, is one window. A word of a document is
hit where it is inside any occurrence of a window.

The windows' hashes are a sorted set that is broadcast with the items' words; texts are scanned as bytes in array operations:
sums of bytes times powers give the hash of any word, and sums of these the hash of any window of words. A window whose hash is in the set
is compared byte by byte. The set is broadcast only where the items have at most `most_bytes` of text; beyond
that a filter of fixed size (2^FILTER_BITS bits) is broadcast instead, and the windows that pass it meet the items' in a join.

Cases: null and empty texts have no words; null and repeated doc_ids are kept, a row each; texts and
items are read whole, in parts, so memory follows the longest word and the part, not the text; item_ids
count once however many rows carry them, and a row with a null item_id is looked for but has no id to
report; an item without words, or an empty benchmark, hits nothing; an empty table gives an empty result;
other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, materialize, table, text_of, unused

#: Words of a window; bytes of items up to which their windows are broadcast; bits of the filter that stands in beyond, as a power of 2.
SIZE, MOST_BYTES, FILTER_BITS = 10, 32 << 20, 26
#: Bytes of a text that are looked at together, and windows compared together.
PART, COMPARED = 1 << 20, 1 << 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
#: Odd multipliers of the two sums.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * PART), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _sums(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of values that depends on the values in it only."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=total[1:])
    return _mixed((total[ends] - total[starts]) * _power(pow(base, -1, 1 << 64), len(values) + 1)[starts])


@dataclass
class Words:
    """Words of a stretch of bytes: where they begin and end, their hashes, the text of each; bytes in lower case."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    texts: np.ndarray

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all runs of n words of one text."""
        count = len(self.starts) - n + 1
        if count < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.texts[:count] == self.texts[n - 1 :])
        return first, _sums(self.hashes, _WORD, first, first + n)

    def same(self, at: np.ndarray, other: Words, other_at: np.ndarray, n: int) -> np.ndarray:
        """Whether n words from each place equal those of the other, byte by byte."""
        out = np.zeros(len(at), bool)
        for low in range(0, len(at), COMPARED):
            a, b = (p[low : low + COMPARED, None] + np.arange(n) for p in (at, other_at))
            sizes = self.ends[a] - self.starts[a]
            alike = (sizes == other.ends[b] - other.starts[b]).all(1)
            a, b, sizes = a[alike], b[alike], sizes[alike].ravel()
            if len(a):
                equal = self.data[tokens.gathered(self.starts[a].ravel(), sizes)] == other.data[tokens.gathered(other.starts[b].ravel(), sizes)]
                firsts = np.concatenate(([0], np.cumsum(sizes)[n - 1 :: n][:-1]))
                out[low + np.flatnonzero(alike)] = np.logical_and.reduceat(equal, firsts)
        return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts that lie one behind another in data, at offsets."""
    mask = _IS_WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = after[inner - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    lower = _LOWER[data]
    return Words(lower, starts, ends, _sums(lower.astype(np.uint64), _BYTE, starts, ends), np.searchsorted(offsets, starts, "right") - 1)


def parts(data: np.ndarray, offsets: np.ndarray, most: int, part: int = PART) -> Iterator[tuple[Words, int, int]]:
    """(words, byte where they were cut out, number of words known before) of consecutive parts.

    A part ends where a word or a text ends, and the next one begins with its last `most` - 1 words, so each
    window of up to `most` words is whole in some part.
    """
    at, to, known = 0, 0, 0
    while to < len(data):
        to = min(len(data), to + part)
        cut = offsets[np.searchsorted(offsets, to)]
        while to < cut and _IS_WORD[data[to]]:
            ahead = np.flatnonzero(~_IS_WORD[data[to : min(cut, to + part)]])
            to = to + int(ahead[0]) if len(ahead) else min(cut, to + part)
        w = words_of(data[at:to], np.clip(offsets - at, 0, to - at))
        yield w, at, known
        kept = max(0, len(w.starts) - (most - 1))
        at, known = (at + int(w.starts[kept]) if kept < len(w.starts) else to), known + kept


@dataclass
class Items:
    """All windows of the items: by number of words, sorted hashes, a place in words for each, and the items that have it."""

    words: Words
    ids: list
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list, texts: list[bytes], size: int = SIZE) -> Items:
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        words = words_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
        counts = np.bincount(words.texts, minlength=len(texts))
        by_size = {}
        for n in sorted({min(int(c), size) for c in counts if c}):
            first, hashes = words.windows(n)
            mine = counts[words.texts[first]]
            whole = (mine >= size) if n == size else (mine == n)
            first, hashes = first[whole], hashes[whole]
            order = np.argsort(hashes, kind="stable")
            first, hashes = first[order], hashes[order]
            # Windows of one text are one; of different ones with equal hashes, each that differs from the first stays by itself.
            lead = np.searchsorted(hashes, hashes)
            alone = ~words.same(first, words, first[lead], n)
            new = alone | (lead == np.arange(len(first)))
            own = np.where(alone, np.arange(len(first)), lead)
            window = np.cumsum(new)[own] - 1
            pairs = np.unique(np.stack((window, words.texts[first])), axis=1)
            by_size[n] = (hashes[new], first[new], np.searchsorted(pairs[0], np.arange(int(new.sum()) + 1)), pairs[1])
        return Items(words, ids, by_size)


def occurrences(data: np.ndarray, offsets: np.ndarray, items: Items, part: int = PART) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Words of each text, and all verified occurrences: text, word (numbered over all texts), n, start and end byte, window."""
    counts, found, most = np.zeros(len(offsets) - 1, np.int64), [], max(items.by_size, default=1)
    total = 0
    for w, at, known in parts(data, offsets, most, part):
        counts += np.bincount(w.texts[total - known :], minlength=len(counts))
        total = known + len(w.starts)
        for n, (hashes, places, _, _) in items.by_size.items():
            first, seen = w.windows(n)
            low = np.searchsorted(hashes, seen)
            keep = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == seen)
            first, low, high = first[keep], low[keep], np.searchsorted(hashes, seen[keep], "right")
            while len(first):
                right = w.same(first, items.words, places[low], n)
                p = first[right]
                found.append((w.texts[p], p + known, np.full(len(p), n), w.starts[p] + at, w.ends[p + n - 1] + at, low[right]))
                more = low + 1 < high
                first, low, high = first[more], low[more] + 1, high[more]
    names = ("text", "word", "n", "start", "end", "window")
    return counts, {k: np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i, k in enumerate(names)}


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals: those that overlap become one."""
    order = np.lexsort((end, begin))
    begin, top = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] >= top[:-1])) if len(begin) else np.zeros(0, bool)
    return begin[new], top[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(begin) - 1]))] if len(begin) else top


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, and where its values begin and end in them."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and data.size else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
LEAK = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: int, end: int>>>"
_LEAK = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])


def _points(data: np.ndarray, offsets: np.ndarray, texts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points of a text before bytes of it."""
    if not len(places):
        return places
    out = np.zeros(len(places), np.int64)
    for t in np.unique(texts):
        mine, base = np.flatnonzero(texts == t), int(offsets[t])
        order = mine[np.argsort(places[mine])]
        cuts = np.concatenate(([base], places[order]))
        steps = [np.count_nonzero((data[a:b] & 0xC0) != 0x80) for a, b in zip(cuts[:-1], cuts[1:])]
        out[order] = np.cumsum(steps)
    return out


def _leaks(data: np.ndarray, offsets: np.ndarray, items: Items) -> list[dict]:
    """LEAK of each text."""
    counts, hits = occurrences(data, offsets, items)
    out = [{"n_words": int(c), "n_hit": 0, "items": [], "spans": []} for c in counts]
    if not len(hits["text"]):
        return out
    begin, end = _merged(hits["word"], hits["word"] + hits["n"])
    hit = np.zeros(len(counts), np.int64)
    np.add.at(hit, np.searchsorted(np.cumsum(counts), begin, "right"), end - begin)
    low, high = _merged(hits["start"], hits["end"])
    mine = np.searchsorted(offsets, low, "right") - 1
    for t, s, e in zip(mine.tolist(), _points(data, offsets, mine, low).tolist(), _points(data, offsets, mine, high).tolist()):
        out[t]["spans"].append({"start": s, "end": e})
    for n, (_, _, ends, owners) in items.by_size.items():
        pick = hits["n"] == n
        text, window = np.unique(np.stack((hits["text"][pick], hits["window"][pick])), axis=1)
        sizes = ends[window + 1] - ends[window]
        for t, i in set(zip(np.repeat(text, sizes).tolist(), owners[tokens.gathered(ends[window], sizes)].tolist())):
            if items.ids[i] is not None:
                out[t]["items"].append(items.ids[i])
    for t in np.flatnonzero(hit):
        out[t] |= {"n_hit": int(hit[t]), "items": sorted(set(out[t]["items"]))}
    return out


def _scanned(docs: DataFrame, text: str, leak: str, items: Items) -> DataFrame:
    """docs with LEAK of each row; text: a binary column, which is dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, text):
            at = b.schema.get_field_index(text)
            found = pa.array(_leaks(*_buffers(b.column(at)), shared.value), _LEAK)
            kept = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), found], names=[*(b.schema.names[i] for i in kept), leak])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), f"{leak} {LEAK}"])
    return arrow_map(docs, rows, schema)


_WINDOW = "hash long, words binary"


def _item_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(hash, words, item) of all windows of the items, a table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches):
            data, offsets = _buffers(b.column("text"))
            names, counts, total = b.column("item").to_pylist(), np.zeros(b.num_rows, np.int64), 0
            for w, _, known in parts(data, offsets, size):
                counts += np.bincount(w.texts[total - known :], minlength=len(counts))
                total = known + len(w.starts)
            mine, out = np.minimum(counts, size), []
            for w, _, _ in parts(data, offsets, size):
                for n in np.unique(mine[mine > 0]).tolist():
                    first, h = w.windows(n)
                    pick = mine[w.texts[first]] == n
                    out += [(int(x), _text(w, p, n), names[t]) for x, p, t in zip(h[pick].view(np.int64), first[pick], w.texts[first[pick]])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.binary(), pa.string()))], names=["hash", "words", "item"])

    plain = benchmark.select(F.col(item_col).cast("string").alias("item"), text_of(text_col).cast("binary").alias("text"))
    return materialize(arrow_map(plain, rows, f"{_WINDOW}, item string").distinct(), "windows")


def _text(w: Words, first: int, n: int) -> bytes:
    """n words with a space between them."""
    return b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[first : first + n], w.ends[first : first + n]))


def _filter(windows: DataFrame, bits: int) -> np.ndarray:
    """A table of 2^bits bits, set where a window's hash begins so: at most 2^(bits - 6) rows come to the driver."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    words = windows.groupBy(F.shiftright(place, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int)))").alias("w"))
    out = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    for b in words.toArrow().to_batches():
        out[b.column("at").to_numpy()] = b.column("w").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _joined(docs: DataFrame, text: str, leak: str, windows: DataFrame, size: int, bits: int) -> DataFrame:
    """As _scanned, where the windows are too many to broadcast: those of the documents that pass a filter are shuffled by hash."""
    shared = docs.sparkSession.sparkContext.broadcast((_filter(windows, bits), [r[0] for r in windows.select(F.expr("size(split(cast(words as string), ' '))").alias("n")).distinct().collect()]))
    row, place = unused(docs, "row", "place")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, sizes = shared.value
        for b in tokens.slices(batches):
            data, offsets = _buffers(b.column("text"))
            ids, counts, total, out = b.column("row").to_numpy(), np.zeros(b.num_rows, np.int64), 0, []
            for w, at, known in parts(data, offsets, max(sizes, default=1)):
                counts += np.bincount(w.texts[total - known :], minlength=len(counts))
                total = known + len(w.starts)
                for n in sizes:
                    first, h = w.windows(n)
                    pick = table_[(h >> np.uint64(64 - bits)).astype(np.int64)]
                    first, h = first[pick], h[pick]
                    t = w.texts[first]
                    begin, end = (_points(data, offsets, t, p + at) for p in (w.starts[first], w.ends[first + n - 1]))
                    out += [(int(ids[i]), None, int(x), _text(w, p, n), int(p) + known, n, int(s), int(e)) for i, x, p, s, e in zip(t, h.view(np.int64), first, begin, end)]
            out += [(int(i), int(c), None, None, None, None, None, None) for i, c in zip(ids, counts)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["row", "n_words", "hash", "words", "word", "n", "start", "end"])

    seen = materialize(arrow_map(numbered.select(F.col(row).alias("row"), F.col(text).alias("text")), rows, f"row long, n_words long, {_WINDOW}, word long, n int, start int, end int"), "seen")
    hits = seen.where("hash is not null").distinct().join(windows, ["hash", "words"])
    # Spans and items of one row: as many as it has words, and as there are items.
    grouped = hits.groupBy("row").agg(F.collect_set(F.struct("word", "n")).alias("places"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["word"], p["word"] + p["n"] - 1)))))
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < last(acc)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s)))
    empty = F.array().cast("array<struct<start: int, end: int>>")
    found = grouped.select("row", hit.cast("long").alias("n_hit"), F.aggregate("spans", empty, step).alias("spans"), "items")
    whole = seen.where("n_words is not null").select("row", "n_words").join(found, "row", "left")
    made = whole.select(F.col("row").alias(row), F.struct("n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", empty).alias("spans")).cast(LEAK).alias(leak))
    return numbered.drop(text).join(made, row).drop(row)


def annotate(docs: DataFrame, benchmark: DataFrame, leak: str = "leak", size: int = SIZE, item_col: str = "item_id", text_col: str = "text", item_text_col: str = "text", most_bytes: int = MOST_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with a column `leak`: n_words, n_hit, items (distinct item_ids as strings, sorted), spans (code points, end exclusive, overlapping ones joined)."""
    if unused(docs, leak) != [leak]:
        raise ValueError(f"docs have a column {leak} already")
    (text,) = unused(docs, "body")
    raw = docs.withColumn(text, text_of(text_col).cast("binary"))
    bytes_ = benchmark.agg(F.sum(F.octet_length(text_of(item_text_col)))).first()[0] or 0
    if bytes_ <= most_bytes:
        kept = benchmark.select(F.col(item_col).cast("string"), text_of(item_text_col).cast("binary")).collect()
        return _scanned(raw, text, leak, Items.of([r[0] for r in kept], [bytes(r[1]) for r in kept], size))
    return _joined(raw, text, leak, _item_windows(benchmark, item_col, item_text_col, size), size, filter_bits)


def drop_documents(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.0, **options) -> DataFrame:
    """docs without those of which more than a share of the words is hit (without any hit, by default)."""
    (leak,) = unused(docs, "leak")
    found = annotate(docs, benchmark, leak, **options)
    return found.where(F.col(f"{leak}.n_hit") <= most_share * F.col(f"{leak}.n_words")).select(*(F.col(f"`{c}`") for c in docs.columns))


def cut_spans(docs: DataFrame, benchmark: DataFrame, mark: str = "", text_col: str = "text", **options) -> DataFrame:
    """docs with each hit span of the text replaced by a mark; a null text stays null."""
    (leak,) = unused(docs, "leak")

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for t, s in zip(texts, spans):
            if t is not None and len(s):
                at, pieces = 0, []
                for x in s:
                    pieces += [t[at : x["start"]], mark]
                    at = x["end"]
                t = "".join(pieces) + t[at:]
            out.append(t)
        return texts.__class__(out, index=texts.index, dtype=object)

    found = annotate(docs, benchmark, leak, text_col=text_col, **options)
    return found.withColumn(text_col, cut(F.col(text_col), F.col(f"{leak}.spans"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op11(spark, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col("leak.items")
    return found.select("doc_id", "leak.n_words", "leak.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
seen AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS words FROM places),
hits AS (SELECT r, i, n, item_id FROM seen JOIN windows USING (n, words)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
