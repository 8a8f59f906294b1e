"""N-gram Jaccard join with Bayesian pruning of candidates.

A document is the set of its runs of five words (lower case; letters, digits and underscores
of any script make words, as \\w+ does, and anything else parts them). Documents with equal
sets are one representative from the start.
MinHash values of representatives, in bands, name buckets. Within a bucket:

1. every member is compared with one pivot, the pairs deduplicated over buckets;
2. members not yet known to be connected are compared in blocks of bounded size, in the
   tasks; only pairs that survive the pruning leave them, so a large group of near copies
   costs rows in proportion to its members, not its pairs.

Comparing is incremental: 25 MinHash values at a time, and a pair is dropped once the
posterior probability of a similarity at the threshold or above falls below the
tolerance. The pairs left connect candidates into groups. Within a group every pair is verified
exactly on the sets of shingles, in blocks bounded in members and bytes; a task emits one row per member of its
blocks, with its number of links and one link of a spanning forest. Classes are the connected
components of verified links. Counting all links of a group of g different texts takes in the order of
g^2 / BLOCK rows of work, whatever their classes; groups of equal texts take none.

With 40 bands of 5 values a link of similarity 0.8 shares no bucket with a probability of
1.2e-7, and is pruned with about 1e-6; links above are missed less often.

Cases: null counts as empty; texts without words are linked only if they are equal; a text of one
to four words is one shingle; rows with equal texts are linked, whatever their doc_id; a null
doc_id ranks last as a class id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, batch, materialize, shuffle_partitions, table, text_of, unused

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 40, 5, 25
#: Members, and bytes of shingle sets, that a block has on average at most.
BLOCK, BLOCK_BYTES = 256, 1 << 25
_PARTING = re.compile(r"\W+")
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending 64-bit hashes."""
    # In texts beyond ASCII whatever is no part of a word becomes a space; then bytes from 128 on are parts of words.
    parts = [(t.lower() if t.isascii() else _PARTING.sub(" ", t.lower())).encode() for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    first = np.cumsum(sizes) - sizes
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
    mask = inside[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask]).astype(np.int8), append=0))
    starts, ends = edge[::2], edge[1::2]
    # Hash of a word: its bytes as digits of a polynomial, from sums over the whole batch.
    powers = np.full(len(data) + 1, _P, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    back = np.full(len(data) + 1, inverse, np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    words = _mix((sums[ends] - sums[starts]) * back[starts])
    bounds = np.searchsorted(starts, np.append(first, len(data)))
    out = []
    rolled = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):
        rolled[: len(words) - k] = rolled[: len(words) - k] * _Q + words[k:]
    for a, z in zip(bounds.tolist(), bounds[1:].tolist()):
        if z - a >= width:
            out.append(np.unique(_mix(rolled[a : z - width + 1])))
        elif z > a:
            h = z - a
            for w in words[a:z].tolist():
                h = (h * int(_Q) + w) % (1 << 64)
            out.append(_mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_rng = np.random.default_rng(2_024)
_A = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        best = np.minimum(best, (h[at : at + 1024, None] * _A + _B).min(0))
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _Q + rows[:, k])
    return key.view(np.int64)


_SIGNED = "doc_id long, row long, text_md5 binary, digest binary, n long, signature binary, bands array<long>"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("text_md5", pa.binary()), ("digest", pa.binary()), ("n", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _digest(text: str, shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes() if len(shingles) else b"no words" + text.encode())


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table with the digest of each row's set, its MinHash signature (a byte of each value) and band keys."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.md5(text_of(text_col).cast("binary"))).alias("text_md5"), text_of(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches):
            texts = b.column("text").to_pylist()
            out = []
            for text, s in zip(texts, shingle_sets(texts)):
                values = minhash(s)
                out.append((_digest(text, s), len(s), (values & 255).astype(np.uint8).tobytes(), band_keys(values) if len(s) else []))
            yield batch(_SIGNED_ARROW, b.column("doc_id"), b.column("row"), b.column("text_md5"), *zip(*out))

    return materialize(arrow_map(source, rows, _SIGNED), "signed")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of values compared, the matches below which a pair is dropped.

    Uniform prior on the similarity; bytes of unequal values agree once in 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    c = s + (1 - s) / 256
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(c) + (n - m) * np.log1p(-c)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() >= tolerance * p.sum():
                out[n] = m
                break
    return out


def prune(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Indices of the pairs of signatures (rows of bytes) that are not dropped."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for n, m in least.items():
        matches += (left[alive, n - STEP : n] == right[alive, n - STEP : n]).sum(1)
        keep = matches >= m
        alive, matches = alive[keep], matches[keep]
    return alive


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _pruned(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the posterior leaves."""
    least = least_matches(threshold)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(prune(_signatures(b.column("x")), _signatures(b.column("y")), least))
            yield batch(schema, b.column("a").take(keep), b.column("b").take(keep))

    x, y = (reps.select(F.col("rep").alias(k), F.col("signature").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    return arrow_map(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), rows, "a long, b long")


def _sets(docs: DataFrame, involved: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A table of (rep, hashes) of the representatives in involved (rep, doc_id, text_md5)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_md5", F.unhex(F.md5(F.col("text").cast("binary"))))
    schema = pa.schema([("rep", pa.int64()), ("hashes", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches):
            yield batch(schema, b.column("rep"), [s.tobytes() for s in shingle_sets(b.column("text").to_pylist())])

    found = source.join(involved, source["text_md5"].eqNullSafe(involved["md5"]) & source["doc_id"].eqNullSafe(involved["id"])).select("rep", "text")
    return materialize(arrow_map(found, rows, "rep long, hashes binary").dropDuplicates(["rep"]), "sets")


def components(edges: DataFrame) -> DataFrame:
    """A table of (id, comp): the smallest id that links (a, b) connect to each id."""
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        low = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", "comp", F.least("comp", "c").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("further"))
        new = materialize(low.join(jump, "low").select("id", F.least("low", "further").alias("comp"), (F.least("low", "further") != F.col("comp")).alias("moved")), "labels")
        labels = new.select("id", "comp")
        if new.where("moved").isEmpty():
            return labels


def _in_blocks(rows: DataFrame, group: str, carried: Column | None = None) -> DataFrame:
    """Each row once for every pair of blocks of its group that it takes part in: (group, i, j, block).

    rows has group, rep and size (members of the group); blocks have about BLOCK members, and about
    BLOCK_BYTES where carried says how many bytes all members of the group carry.
    """
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.lit(0.0) if carried is None else carried / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    return rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from rows sorted by them; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            this = tuple(k[a])
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = this
    if held:
        yield pa.Table.from_batches(held)


def _sorted(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j")


def _unconnected(members: DataFrame, labels: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share a bucket, are not connected yet, and that the posterior leaves."""
    known = members.join(labels.select(F.col("id").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rows = _in_blocks(known.where("size > 2").join(mixed, "key").join(reps.select("rep", "signature"), "rep"), "key")
    least = least_matches(threshold)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ("key", "i", "j")):
            rep, comp, pivot, block = (g.column(c).to_numpy() for c in ("rep", "comp", "pivot", "block"))
            x, y = np.triu_indices(len(rep), 1)
            # Two blocks: only pairs across them. Pairs with the pivot were compared before.
            want = (comp[x] != comp[y]) & (rep[x] != pivot[x]) & (rep[y] != pivot[y])
            if g.column("i")[0] != g.column("j")[0]:
                want &= block[x] != block[y]
            x, y = x[want], y[want]
            s = _signatures(g.column("signature"))
            for at in range(0, len(x), 50_000):
                a, b = x[at : at + 50_000], y[at : at + 50_000]
                keep = prune(s[a], s[b], least)
                yield batch(schema, np.minimum(rep[a[keep]], rep[b[keep]]), np.maximum(rep[a[keep]], rep[b[keep]]))

    return arrow_map(_sorted(rows.select("key", "i", "j", "block", "rep", "comp", "pivot", "signature"), "key"), pairs, "a long, b long").distinct()


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each member, the first member that links connect it to."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(np.where(linked, root, len(root)).min(1, initial=len(root)), root)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _links(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """A table of (rep, linked, root) per member and pair of blocks: documents of other members that are linked with it
    there, and a member that links connect it to. groups: rep, comp, size, shingles (of all members), copies.
    """
    rows = _in_blocks(groups.where("size > 1").join(sets, "rep"), "comp", F.col("shingles") * 8)
    schema = pa.schema([("rep", pa.int64()), ("linked", pa.int64()), ("root", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ("comp", "i", "j")):
            rep, copies, block = (g.column(c).to_numpy() for c in ("rep", "copies", "block"))
            hashes = [np.frombuffer(h, np.uint64) for h in g.column("hashes").to_pylist()]
            sizes = np.array(list(map(len, hashes)))
            linked = _shared(hashes) >= threshold * (sizes[:, None] + sizes) / (1 + threshold) - 1e-6
            np.fill_diagonal(linked, False)
            if g.column("i")[0] != g.column("j")[0]:
                linked &= block[:, None] != block
            yield batch(schema, rep, linked @ copies, rep[_forest(linked)])

    return materialize(arrow_map(_sorted(rows.select("comp", "i", "j", "block", "rep", "copies", "hashes"), "comp"), found, "rep long, linked long, root long"), "links")


def _shared(hashes: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles that each two sets share, from products of slices of their incidence matrix."""
    shingle, where = np.unique(np.concatenate(hashes), return_inverse=True)
    member = np.repeat(np.arange(len(hashes)), list(map(len, hashes)))
    common = np.bincount(where) > 1
    place = np.cumsum(common) - 1
    member, column = member[common[where]], place[where[common[where]]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    both, width = np.zeros((len(hashes), len(hashes))), 4096
    for at in range(0, int(common.sum()), width):
        a, z = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(hashes), min(width, int(common.sum()) - at)), np.float32)
        x[member[a:z], column[a:z] - at] = 1
        both += x @ x.T
    return both


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, row, text_md5, class_id (smallest doc_id of the class), comp, first (whether it is the class's first row) and n_links.

    n_links is the number of other rows with a similarity at the threshold or above, which is THRESHOLD at least:
    the bands are laid out for that, and would miss links below it.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"bands find links from a similarity of {THRESHOLD} on, not {threshold}")
    signed = sign(docs, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_md5", "signature", "bands", "n")).alias("f")
    reps = materialize(signed.groupBy("digest").agg(first, F.count("*").alias("copies")).select(F.col("f.row").alias("rep"), F.col("f.doc_id").alias("id"), F.col("f.text_md5").alias("md5"), "f.signature", "f.bands", "f.n", "copies", "digest"), "representatives")
    entries = reps.select("rep", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    members = materialize(entries.join(buckets, "key"), "buckets")
    star = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    alike = materialize(_pruned(star, reps, threshold), "candidates")
    more = materialize(_unconnected(members, components(alike), reps, threshold), "candidates")
    groups = components(alike.unionByName(more)).withColumnRenamed("id", "rep")
    groups = groups.join(reps.select("rep", "copies", "n"), "rep")
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    sets = _sets(docs, groups.select("rep").join(reps, "rep").select("rep", "id", "md5"), id_col, text_col)
    links = _links(groups.join(sizes, "comp"), sets, threshold)
    labels = components(links.where("rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b")))
    known = reps.select("rep", "id", "copies", "digest").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    known = materialize(known, "classes")
    sizes = known.groupBy("comp").agg(F.count("*").alias("size"), F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rep"))["rep"].alias("keep"))
    classes = known.join(sizes, "comp")
    linked = links.groupBy("rep").agg(F.sum("linked").alias("linked"))
    classes = classes.join(linked, "rep", "left").withColumn("n_links", F.coalesce("linked", F.lit(0)) + F.col("copies") - 1)
    classes = classes.select("digest", "class_id", "comp", "class_size", "n_links", "keep")
    return signed.select("doc_id", "row", "text_md5", "digest").join(classes, "digest").select("doc_id", "row", "text_md5", "class_id", "comp", "class_size", "n_links", (F.col("row") == F.col("keep")).alias("first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class (its smallest doc_id), all columns kept."""
    (own,) = unused(docs, "own")

    def key(md5: Column, doc_id: Column) -> Column:  # One column, so that dropping equal rows needs no further exchange.
        return F.md5(F.concat(md5, F.coalesce(doc_id.cast("string"), F.lit("none")).cast("binary")))

    kept = join(docs, id_col, text_col, threshold).where("first").select(key(F.col("text_md5"), F.col("doc_id")).alias(own))
    marked = docs.withColumn(own, key(F.unhex(F.md5(text_of(text_col).cast("binary"))), F.col(id_col).cast("long")))
    return marked.join(kept, own).dropDuplicates([own]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size")
