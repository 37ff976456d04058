"""Operator 1, n-gram Jaccard join: token-combination prefixes.

The tokens of a document are its distinct word shingles, as 64-bit hashes. All documents use one order
of the tokens: rare ones first, then frequent ones, by hash within each. Two sets that overlap in `o`
tokens differ in at most n - o tokens each, so their prefixes must meet:

* Rare tokens are indexed one by one, the first n - o + 1 of each set.
* A set with too few rare tokens extends its prefix into all its frequent tokens. These are dealt into B
  classes by hash, and each class is indexed as one combination, of all the set's tokens in it. If two
  linked sets share no rare token, they differ in at most n * (100 - percent) / percent frequent ones less
  the rare ones; with more classes than that, one class at least is the same in both. Where some classes
  stay empty, the set is indexed with twice as many as well, until enough are filled. A combination of
  frequent passages thus has to be shared token by token in a whole class, about five of them.

An index entry carries its set's size and its rank `v` (what the prefix counted before it; of a
combination, the rare tokens), so that a pair is a candidate only if v <= n - o on both sides for the
overlap o that its two sizes call for. B depends on a band of sizes; a set is indexed for its own band and
for the next one, so sets that can be linked have one in common. Candidates are verified on the whole
sets, so results are exact.

Which tokens are rare is read from a map of 2**bits cells counted over all documents: its size is fixed,
and where it is too small for a corpus, tokens that share a cell count as frequent: that costs time, not
results. A rare token has fewer than MOST documents, so all pairs of its list are taken. Lists of
combinations may be long (a group of near copies): they are first linked to one hub each, one of a few
for all the lists of a group; components are joined up, and only pairs that are still in different components are
then compared, dealt over more tasks the longer the list. Equal sets are joined by digest beforehand and
indexed once.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, docs_of, dropped, id_cells, in_batches, in_cells, relabelled, salted_join, stored
from .textvec import NON_SPACE, mix, release, shingles, slices, words

PARTS = 256
#: A token is frequent from FILL times the mean load of a cell on, which is taken as FREQUENT at least and as MOST at most.
FREQUENT, FILL, MOST = 16, 4, 64
MAX_BITS = 26
#: A list of so many entries is worked on in one partition more, in LIST_PARTS at most.
LIST_ROWS, LIST_PARTS = 2000, 512
#: Different hubs for the lists of a group.
HUBS = 4


def sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes, row by row."""
    for lo, hi in slices(column):
        hashes, first = shingles(words(column.slice(lo, hi - lo), NON_SPACE), size)
        for i in range(hi - lo):
            yield lo + i, np.unique(hashes[first[i] : first[i + 1]])


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def bits_for(n_bytes: int) -> int:
    """Cells for a corpus of so many bytes: about one for four or five words, from 2**16 to 2**MAX_BITS."""
    return int(min(MAX_BITS, max(16, np.ceil(np.log2(max(n_bytes, 1) / 32)))))


def _count(size: int, bits: int):
    """Rows of a partition: its documents' sizes and digests, then its share of the cell counts (saturating at 255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint8)
        mask = np.uint64((1 << bits) - 1)
        seen = 0
        for batch in batches:
            sizes, digests, recent, held = [], [], [], 0
            for _, tokens in sets_of(batch.column(1), size):
                sizes.append(len(tokens))
                digests.append(digest_of(tokens))
                recent.append(tokens & mask)
                held += len(tokens)
                if held > 1 << 19:
                    _add(cells, recent)
                    recent, held = [], 0
            _add(cells, recent)
            seen += len(sizes)
            yield _counted(batch.column(0), sizes, digests, None, None)
            release()
        if seen:
            width = (1 << bits) // PARTS
            for part in range(PARTS):
                if (own := cells[part * width : (part + 1) * width]).any():
                    yield _counted([None], [None], [None], [part], [zlib.compress(own.tobytes(), 1)])

    return run


def _add(cells: np.ndarray, recent: list[np.ndarray]) -> None:
    if recent:
        at, n = np.unique(np.concatenate(recent), return_counts=True)
        at = at.astype(np.int64)
        cells[at] = np.minimum(cells[at] + n, 255)


COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("part", pa.int32()), ("cells", pa.binary())])


def _counted(ids, sizes, digests, part, cells) -> pa.RecordBatch:
    n = len(sizes)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip((ids, sizes, digests, part or [None] * n, cells or [None] * n), COUNTED, strict=True)], schema=COUNTED)


def _merge(limit: int):
    """Sums the shares of each part and marks the cells that reach the limit. Holds one sum for each part of its partition, whatever the number of shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                share = np.frombuffer(zlib.decompress(cells.as_buffer()), np.uint8).astype(np.int32)
                sums[part] = sums[part] + share if part in sums else share
        for part, total in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(total >= limit, bitorder="little").tobytes()])})

    return run


def allowed(n: np.ndarray | int, percent: int):
    """How many of its n tokens a set may lack in the smallest set that it can be linked to."""
    return n - -(-percent * n // 100)


def band_of(n: int, percent: int, starts: dict[int, list[int]] = {}) -> int:  # noqa: B006
    """Band of a size: each ends with the largest size that can be linked to its first, so linked sets are in the same or in neighbouring bands."""
    own = starts.setdefault(percent, [1])
    while own[-1] <= n:
        own.append(own[-1] * 100 // percent + 1)
    return bisect_right(own, n) - 1


def classes_of(band: int, percent: int) -> int:
    """Classes for the sets that meet in a band: one more than the tokens in which two linked ones may differ, with a tenth for classes that stay empty."""
    n = (100 / percent) ** (band + 1)
    return int(1.1 * n * (100 - percent) / percent) + 1


def entries(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures and ranks of a set; the first so many are single rare tokens, the rest combinations."""
    n = len(tokens)
    most = int(allowed(n, percent))
    rare = tokens[~frequent][: most + 1]
    sig, rank = [rare], [np.arange(len(rare))]
    apart = n * (100 - percent) // percent  # tokens in which a set that is linked to this one may differ; none: only equal sets are
    differ = apart - len(rare)
    if len(rare) <= most and apart > 0 and differ >= 0:
        common = tokens[frequent]
        mixed, own = mix(common), mix(common + np.uint64(0x9FB21C651E98DF25))
        for band in (band_of(n, percent), band_of(n, percent) + 1):
            classes = classes_of(band, percent)
            while True:
                kind = mixed % np.uint64(classes)
                order = np.argsort(kind, kind="stable")
                kind = kind[order]
                first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
                total = np.add.reduceat(own[order], first)
                sig.append(mix(total + mix(kind[first] + np.uint64((band << 48) + (classes << 24)))))
                rank.append(np.full(len(first), len(rare)))
                if len(first) > differ or len(first) == len(common):
                    break
                classes *= 2
    return np.concatenate(sig), np.concatenate(rank), len(rare)


#: Longs of the parity map that an entry of a combination carries.
SMALL = [f"p{k}" for k in range(4)]
ENTRY = ["set_id", "n", "v", *SMALL]
ENTRIES = pa.schema([("sig", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("v", pa.int32()), ("combined", pa.bool_()), *((p, pa.int64()) for p in SMALL)])


def _index(size: int, bits: int, frequent, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(frequent.value, np.uint8)

        def rows(sig, ids, n, rank, single, parity):
            lengths = [len(s) for s in sig]
            combined = np.concatenate([np.arange(k) >= s for k, s in zip(lengths, single, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), lengths)), pa.array(np.repeat(np.array(n, np.int32), lengths)), pa.array(np.concatenate(rank).astype(np.int32)), pa.array(combined), *(pa.array(np.where(combined, np.repeat(p, lengths), 0)) for p in np.array(parity).T)], schema=ENTRIES)

        for batch in batches:
            out, held = ([], [], [], [], [], []), 0
            for _, tokens in sets_of(batch.column(0), size):
                if len(tokens) == 0:
                    continue
                sig, rank, single = entries(tokens, in_cells(marks, tokens, bits), percent)
                for to, what in zip(out, (sig, set_id(digest_of(tokens)), len(tokens), rank, single, parity_of(tokens, 64 * len(SMALL))), strict=True):
                    to.append(what)
                held += len(sig)
                if held > 200_000:
                    yield rows(*out)
                    out, held = ([], [], [], [], [], []), 0
            if held:
                yield rows(*out)
            out = None
            release()

    return run


def set_id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _list_pairs(percent: int):
    """Candidate pairs of the lists of rare tokens, which arrive sorted by signature. Such a list has fewer than the limit of rows, so only the last one of a batch is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            sig = now[0]
            cut = int(np.searchsorted(sig, sig[-1]))
            rest = [c[cut:] for c in now]
            if cut:
                yield from pairs(*(c[:cut] for c in now))
        if rest is not None:
            yield from pairs(*rest)

    def pairs(sig, ids, n, v) -> Iterator[pa.RecordBatch]:
        found = []
        for gap in range(1, len(sig)):
            same = np.flatnonzero(sig[gap:] == sig[:-gap])
            if not len(same):
                break
            i, j = same, same + gap
            need = -(-percent * (n[i].astype(np.int64) + n[j]) // (100 + percent))
            ok = (ids[i] != ids[j]) & (v[i] <= n[i] - need) & (v[j] <= n[j] - need) & (100 * np.minimum(n[i], n[j]).astype(np.int64) >= percent * np.maximum(n[i], n[j]).astype(np.int64))
            found.append(np.stack([np.minimum(ids[i], ids[j])[ok], np.maximum(ids[i], ids[j])[ok]], 1))
        if found:
            unique = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(unique[:, 0]), pa.array(unique[:, 1])], schema=PAIRS)

    return run


#: Bits of a set's parity map.
PARITY = 2048


def parity_of(tokens: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """Parities of the numbers of tokens that fall on each of so many bits, packed in longs. Two sets that differ in d tokens differ in d bits at most."""
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _tokens(size: int, log2: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            keep = in_cells(marks, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64), log2)
            if keep.any():
                batch = batch.filter(pa.array(keep))
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                out, sets, parity, held, made = [], [], [], 0, 0
                for i, tokens in sets_of(batch.column(1), size):
                    out.append(tokens.view(np.int64))
                    sets.append(set_id(digest_of(tokens)))
                    parity.append(parity_of(tokens))
                    held += len(tokens)
                    if held > 200_000 or i == len(ids) - 1:
                        yield pa.RecordBatch.from_pydict({"rep": pa.array(ids[made : i + 1]), "set_id": pa.array(sets, pa.int64()), "parity": pa.array(parity, pa.list_(pa.int64())), "tokens": pa.array(out, pa.list_(pa.int64()))})
                        out, sets, parity, held, made = [], [], [], 0, i + 1
            release()

    return run


def _fits(percent: int, a: str, b: str) -> str:
    """SQL condition on two index entries of combinations: both ranks lie in the prefixes that the two sizes call for, and the parity maps are not farther apart than the sets of a link can be."""
    need = f"ceil({percent} * ({a}.n + {b}.n) / {100 + percent}.0)"
    apart = " + ".join(f"bit_count({a}.{p} ^ {b}.{p})" for p in SMALL)
    return f"{a}.v <= {a}.n - {need} and {b}.v <= {b}.n - {need} and 100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {apart} <= {a}.n + {b}.n - 2 * {need}"


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: documents whose sets of word shingles have a Jaccard similarity of percent / 100 or more are linked; component_id is the smallest identifier that links reach.

    Null and empty texts and texts without words have an empty set and are linked with nothing: their
    component is their own identifier. Equal rows and repeated identifiers each keep a row. A row with a
    null identifier takes its component's smallest non-null one, if there is one. Other columns of docs are
    not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs_of(docs, id_col, text_col)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(n_bytes)
    counted = stored(in_batches(docs, _count(size, bits), "doc_id long, n int, digest binary, part int, cells binary"), "sets")
    sets = counted.where("part is null").select("doc_id", "n", "digest")
    reps = stored(sets.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep")).where("rep is not null").select("digest", "rep", F.expr("cast(conv(substr(hex(digest), 1, 16), 16, -10) as long)").alias("set_id")), "reps")

    load = (sets.agg(F.sum("n")).first()[0] or 0) / (1 << bits)
    limit = int(np.clip(FILL * load, FREQUENT, MOST))
    parts = counted.where("part is not null").select("part", "cells").repartition(min(PARTS, 64), "part").mapInArrow(_merge(limit), "part int, bits binary").collect()  # PARTS rows, 2**bits bits in all
    marks = np.zeros((1 << bits) // 8, np.uint8)
    width = len(marks) // PARTS
    for row in parts:
        marks[row.part * width : (row.part + 1) * width] = np.frombuffer(row.bits, np.uint8)
    frequent = spark.sparkContext.broadcast(marks.tobytes())  # 2**MAX_BITS / 8 bytes = 8 MB at most

    index = stored(in_batches(docs.select("text"), _index(size, bits, frequent, percent), "sig long, set_id long, n int, v int, combined boolean, " + ", ".join(f"{p} long" for p in SMALL)), "index")
    single = index.where("not combined").select("sig", "set_id", "n", "v")
    pairs = in_batches(single.repartition("sig").sortWithinPartitions("sig"), _list_pairs(percent), "a long, b long").distinct()
    combined = index.where("combined").select("sig", *ENTRY).dropDuplicates(["sig", "set_id"])
    # a hub has few rare tokens, so that it fits most of its list; the lists of a group share HUBS different ones, so a set gets about so many links
    ranked = F.struct(F.floor(10 * F.col("v") / F.col("n")).alias("share"), F.xxhash64("set_id", F.pmod("sig", F.lit(HUBS))).alias("draw"), *ENTRY)
    once = combined = stored(combined, "combined")
    hubs = combined.groupBy("sig").agg(F.count("*").alias("m"), F.min(ranked).alias("hub")).where("m > 1").select("sig", F.struct(*[F.col(f"hub.{c}").alias(c) for c in ENTRY]).alias("hub"))
    combined = stored(salted_join(combined, hubs, "sig", by="set_id"), "lists")
    star = _pairs(combined.select(F.struct(*ENTRY).alias("x"), F.col("hub").alias("y")), percent)
    pairs = stored(pairs.union(star).distinct(), "pairs")
    dropped(index, once)
    wanted = stored(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(combined.select("set_id")).distinct().join(reps, "set_id").select("set_id", "rep"), "wanted")

    log2 = 24
    cells = spark.sparkContext.broadcast(id_cells(wanted, "rep", log2).tobytes())  # 2 MB
    tokens = in_batches(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("cell")).where("doc_id is not null"), _tokens(size, log2, cells), "rep long, set_id long, parity array<long>, tokens array<long>")
    tokens = stored(tokens, "tokens")  # a few more rows than wanted: the joins by identifier and set drop them

    links = stored(_linked(pairs, wanted, tokens, percent), "links")
    labels = connected(links)
    crossing = _crossing(combined, wanted, labels, tokens, percent)
    crossing = stored(crossing.join(pairs, ["a", "b"], "left_anti"), "crossing")
    if crossing.limit(1).count():
        more = _linked(crossing, wanted, tokens, percent)
        labels = with_links(labels, more)
    dropped(combined, pairs, wanted, tokens)
    members = sets.join(reps.select("digest", "rep"), "digest", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return members.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "rep", "doc_id").alias("component_id"))


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) of components after more links (a, b), which join these up: only the new links are gone through. An end that has no label yet is a component of its own."""
    known = stored(labels.union(links.select("a", "a").union(links.select("b", "b")).toDF("id", "label").join(labels, "id", "left_anti").distinct()), "labels")
    of = lambda end: known.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    return relabelled(known, connected(between))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) in order, of rows with two index entries x and y that may lead to a link."""
    return rows.where("x.set_id <> y.set_id and " + _fits(percent, "x", "y")).selectExpr("least(x.set_id, y.set_id) as a", "greatest(x.set_id, y.set_id) as b").distinct()


def _linked(pairs: DataFrame, wanted: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b): representatives of the pairs of set ids whose whole sets reach the threshold.

    First the parity maps: they bound the overlap from above, so most pairs that fail go before any
    whole set is moved. What is left is compared on the whole sets.
    """

    def with_sides(rows: DataFrame, frame: DataFrame, on: list[str], more: list[str]) -> DataFrame:
        for k in "ab":
            side = frame.select(*[F.col(c).alias(k if c == "set_id" else f"{c}_{k}") for c in ["set_id", *on, *more]])
            rows = rows.join(side, [k, *[f"{c}_{k}" for c in on]])
        return rows

    rows = with_sides(pairs.select("a", "b"), wanted, [], ["rep"])
    sizes = tokens.select("rep", "set_id", "parity", F.size("tokens").alias("n"))
    rows = with_sides(rows, sizes, ["rep"], ["parity", "n"])
    apart = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    need = F.ceil((percent * (F.col("n_a") + F.col("n_b"))) / F.lit(100.0 + percent))
    rows = stored(rows.where(F.col("n_a") + F.col("n_b") - apart >= 2 * need).select("a", "rep_a", "b", "rep_b").distinct(), "likely")
    rows = with_sides(rows, tokens, ["rep"], ["tokens"])
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    rows = rows.select("rep_a", "rep_b", shared.alias("shared"), (F.size("tokens_a") + F.size("tokens_b")).alias("sizes"))
    return rows.where(f"100 * shared >= {percent} * (sizes - shared)").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def _crossing(lists: DataFrame, wanted: DataFrame, labels: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of the combination lists whose sets are still in different components: entries outside a list's most usual component, each against the list. A list is dealt over more partitions the longer it is.

    Entries take the whole parity maps of their sets along, which are asked in the join: a list of sets
    that share common passages and nothing else makes no rows, however long it is.
    """
    reps = wanted.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_id", "rep", F.coalesce("label", "rep").alias("label"))
    now = lists.select("sig", *ENTRY).join(reps, "set_id")
    per = now.groupBy("sig", "label").agg(F.count("*").alias("m"))
    usual = per.groupBy("sig").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("k"), F.sum("m").alias("all")).where("k > 1")
    usual = usual.select("sig", F.col("top.label").alias("usual"), F.expr(f"cast(least(1 + all div {LIST_ROWS}, {LIST_PARTS}) as int)").alias("salts"))
    maps = tokens.select("rep", "set_id", "parity").dropDuplicates(["rep", "set_id"])
    now = stored(salted_join(now, usual, "sig", by="set_id").join(maps, ["rep", "set_id"]), "crossing")
    entry = F.struct(*ENTRY, "label", "parity")
    left = now.where("label <> usual").select("sig", F.pmod(F.xxhash64("set_id"), F.col("salts")).cast("int").alias("salt"), entry.alias("x"))
    right = now.select("sig", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), entry.alias("y"))
    far = "aggregate(zip_with(x.parity, y.parity, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)"
    near = f"x.label <> y.label and x.set_id <> y.set_id and {_fits(percent, 'x', 'y')} and {far} <= x.n + y.n - 2 * ceil({percent} * (x.n + y.n) / {100 + percent}.0)"
    found = left.join(right, ["sig", "salt"]).where(near)
    return found.selectExpr("least(x.set_id, y.set_id) as a", "greatest(x.set_id, y.set_id) as b").distinct()


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with docs' columns, that represent their component: the one with its smallest identifier.

    Documents without words are linked with nothing and stay. Rows that repeat an identifier and a text
    leave one row; rows with a null identifier stay unless all of them are linked to rows with one.
    """
    groups = ngram_components(docs, id_col, text_col, size, percent)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.withColumn("__key", F.col(id_col).cast("long"))
    kept = rows.join(first, F.col("__key").eqNullSafe(F.col("__id")), "left_semi")
    return kept.withColumn("__text", F.xxhash64(text_col)).dropDuplicates(["__key", "__text"]).select(*[F.col(f"`{c}`") for c in docs.columns])
