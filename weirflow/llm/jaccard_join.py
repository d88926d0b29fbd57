"""N-gram Jaccard join by PartEnum signatures.

Two sets of sizes x and y have Jaccard similarity of at least p percent only if
their symmetric difference is at most (100-p)(x+y)/(100+p). Sets fall into size
bands; within a band whose largest size is r, a similar pair differs in at most
k = 2(100-p)r/(100+p) elements. The feature domain is cut into n > k partitions
by hash, so a similar pair agrees on at least n - k of them: each partition's
content, hashed, is one signature. A set signs for every later band, too, in which
a similar larger set may lie (for percent from 67 on that is the next at most). Partitions that are empty
in both sets agree without meaning: n has a slack above k, a set with no more
empty partitions than the slack leaves them out, one with more signs them.

The slack is half of k, so that a set of a similar pair shares not one but at
least slack + 1 - (its empty partitions) signatures with others. Sets that share
fewer can have no partner and drop out; that removes documents that have only a
passage in common. Others keep, of the signatures they share, all but the most
frequent ones, as many as they need at least less one: two sets that share so many
still have one in common, and passages of many documents join no groups any more.
Signatures are exact: no similar pair is missed.

They are shuffled as packed arrays, one row per task and part, and within a task
only the smallest holder of a signature is sent on, so that a signature that a
third of all documents share arrives as one entry per task. Holders of shared
signatures, edges to a signature's smallest holder and components of these give
candidate groups; only documents of these are read again, once per distinct set,
and a group's true links are counted on the sets themselves, taken as symmetric
differences from one of them, which for near copies are short. Groups of many sets
travel as such differences and are resolved as pairs of blocks, each of bounded
size. No pair is emitted: tasks return a forest and each document's links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import frugal, kept, partitions_for, stored, text_rows
from .components import apart, connected_components
from .textvec import mix, shingle_sets

BAND_RATIO = 1.5
FLUSH = 1 << 18


def bands(percent: int, top: int) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, slack, partitions) of each size band up to the one that holds ``top``."""
    out, low = [], 1
    while not out or out[-1][1] < top:
        high = max(low, int(low * BAND_RATIO))
        k = 2 * (100 - percent) * high // (100 + percent)
        slack = 2 + k // 2
        out.append((low, high, slack, k + slack + 1))
        low = high + 1
    return out


LEVEL_BITS = 6
WIDTH = 7  # bytes of a signature; chance agreement only makes a candidate


def _thin(sig: np.ndarray) -> bytes:
    return sig.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _thick(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.reshape(-1).view(np.uint64)


def signatures(elements: np.ndarray, percent: int, table: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, int, list[int]]:
    """All PartEnum signatures of one set of distinct 64-bit hashes, their low bits the band.

    Also its band, and for that and each later band it signs for the least number
    of signatures there that a set with a partner shares with others. ``table``
    must reach the band of the largest partner.
    """
    size = len(elements)
    if not size:
        return np.zeros(0, np.uint64), 0, []
    b = int(np.searchsorted(np.array([t[1] for t in table]), size))
    found, least = [], []
    for level in range(b, len(table)):
        if level > b and 100 * size < percent * (table[level - 1][1] + 1):
            break  # the smallest set of this band is already too large
        slack, n = table[level][2:]
        part = (elements % np.uint64(n)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sums = np.cumsum(mix(elements[order]))
        last = np.cumsum(np.bincount(part, minlength=n))
        ends = np.concatenate([[np.uint64(0)], sums])[last]
        total = ends.copy()
        total[1:] -= ends[:-1]
        held = np.diff(last, prepend=0) > 0
        signed = mix(total ^ (np.uint64(level) << np.uint64(32) | np.arange(n, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
        signed = (signed >> np.uint64(LEVEL_BITS) << np.uint64(LEVEL_BITS) | np.uint64(level)) & np.uint64((1 << 8 * WIDTH) - 1)
        empty = n - int(held.sum())
        found.append(signed[held] if empty <= slack else signed)
        least.append(max(1, slack + 1 - empty))
    return np.concatenate(found), b, least


def _grouped(sig: np.ndarray, doc: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by signature and id; (first of its signature, its holders are several) per entry."""
    order = np.lexsort((doc, sig))
    sig, doc, more = sig[order], doc[order], more[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(new)
    several = (np.diff(np.r_[at, len(sig)]) > 1) | np.logical_or.reduceat(more, at)
    return sig, doc, new, several[np.cumsum(new) - 1]


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(u):
        return u, v
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    keep = np.ones(len(u), bool)
    keep[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[keep], v[keep]


_DOC = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n", "fp", "fp2", "band")), ("least", pa.list_(pa.int64()))])
_SIGNED = pa.schema([("part", pa.int32()), *_DOC, ("sigs", pa.binary()), ("docs", pa.binary()), ("more", pa.binary())])
_MET = pa.schema([*_DOC, ("sig", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
_SPARK = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SPARK[f.type]}" for f in schema)


def _rows(schema: pa.Schema, n_rows: int, **columns) -> pa.RecordBatch:
    """A batch of ``n_rows``, null in the columns that aren't given."""
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n_rows, f.type) for f in schema], schema=schema)


def _sign(n_words: int, percent: int, parts: int):
    """Rows of documents; packed signatures by part; entries of signatures that the task sees again (part, and no id).

    ``sigs`` with null ``docs`` are pairs of ids, exact copies within the task.
    """

    def packed(sigs: list, docs: list) -> Iterator[pa.RecordBatch]:
        sig, doc, first, several = _grouped(np.concatenate(sigs), np.concatenate(docs), np.zeros(sum(map(len, sigs)), bool))
        rows = []
        part = (mix(sig) >> np.uint64(20)) % np.uint64(parts)
        for kind in (first, ~first):
            s, d, m, p = sig[kind], doc[kind], several[kind], part[kind].astype(np.int64)
            order = np.lexsort((d, p))  # ids in order pack well as differences
            s, d, m, ends = s[order], d[order], m[order], np.cumsum(np.bincount(p, minlength=parts))
            for k, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                if b > a:
                    rows.append((k, _thin(s[a:b]), np.diff(d[a:b], prepend=0).tobytes(), m[a:b].tobytes() if kind is first else None))
        yield _rows(_SIGNED, len(rows), part=pa.array([r[0] for r in rows], pa.int32()), **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("sigs", "docs", "more"), 1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bands(percent, 1 << 10)
        first: dict[tuple[int, int], int] = {}
        sigs, docs, held = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            of = {c: np.zeros(len(ids), np.int64) for c in _DOC.names[1:-1]}
            copies, least = [], [[] for _ in range(len(ids))]
            for i, s in enumerate(shingle_sets(batch.column(1), n_words)):
                of["n"][i] = len(s)
                if not len(s):
                    continue
                if 100 * len(s) > percent * table[-1][1]:
                    table = bands(percent, 200 * len(s) // percent)
                key = (int(mix(s).sum()), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()))
                of["fp"][i], of["fp2"][i] = np.array(key, np.uint64).view(np.int64)
                seen = first.setdefault(key, ids[i])
                if seen != ids[i]:
                    copies.append((ids[i], seen))
                    continue
                got, of["band"][i], least[i] = signatures(s, percent, table)
                sigs.append(got)
                docs.append(np.full(len(got), ids[i], np.int64))
                held += len(got)
                if held >= FLUSH:
                    yield from packed(sigs, docs)
                    sigs, docs, held = [], [], 0
            if len(first) > FLUSH // 4:
                first.clear()
            spread = pa.array(ids % parts, pa.int32())
            yield _rows(_SIGNED, len(ids), part=spread, doc_id=pa.array(ids, pa.int64()), least=pa.array(least, pa.list_(pa.int64())), **{c: pa.array(v) for c, v in of.items()})
            if copies:
                pairs = np.array(copies, np.int64)
                yield _rows(_SIGNED, 1, part=pa.array([int(pairs[0, 0] % parts)], pa.int32()), sigs=pa.array([pairs.tobytes()], pa.binary()))
        if sigs:
            yield from packed(sigs, docs)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of part. Signatures of a part meet, those with several holders go on; documents and copies pass."""
    part, held = None, []

    def entries(sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        return _rows(_MET, len(sig), sig=pa.array(sig.view(np.int64)), u=pa.array(doc))

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            sig, doc, _, several = _grouped(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            yield entries(sig[several], doc[several])

    for batch in batches:
        docs = batch.filter(pa.compute.is_valid(batch.column("doc_id")))
        if docs.num_rows:
            yield _rows(_MET, docs.num_rows, **{c: docs.column(c) for c in _DOC.names})
        rest = batch.filter(pa.compute.is_valid(batch.column("sigs")))
        for p, *blobs in zip(rest.column("part").to_pylist(), *(rest.column(c).to_pylist() for c in ("sigs", "docs", "more"))):
            if blobs[1] is None:
                pairs = np.frombuffer(blobs[0], np.int64).reshape(-1, 2)
                yield _rows(_MET, len(pairs), u=pa.array(pairs[:, 0]), v=pa.array(pairs[:, 1]))
                continue
            sig, doc = _thick(blobs[0]), np.cumsum(np.frombuffer(blobs[1], np.int64))
            if blobs[2] is None:
                yield entries(sig, doc)
                continue
            if p != part:
                yield from close()
                part = p
            held.append((sig, doc, np.frombuffer(blobs[2], bool)))
    yield from close()


def link_sets(sets: list[np.ndarray], sizes: np.ndarray, coded: bool, weight: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """True links among the sets of one group: (label, the smallest index in reach; number of links by weight).

    ``sizes`` are those of the sets; where ``coded``, ``sets`` are their symmetric
    differences from one pivot, and |X and Y| = (|X| + |Y| - |dX| - |dY|) / 2 + |dX and dY|.
    ``side`` restricts links to sets of different sides. Cost: the postings that
    ``sets`` share, which for near copies are few in differences.
    """
    m = len(sets)
    held = np.array([len(s) for s in sets], np.int64)
    base = sizes - held if coded else np.zeros(m, np.int64)
    owner = np.repeat(np.arange(m), held)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    ranked, posting = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(flat)]
    element = np.empty(len(flat), np.int64)
    element[order] = np.cumsum(new) - 1
    at = np.r_[0, np.cumsum(held)]
    label, links = np.arange(m), np.zeros(m, np.int64)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for x in range(m - 1):
        mine = element[at[x] : at[x + 1]]
        b, count = begin[mine], (end - begin)[mine]
        b, count = b[count > 1], count[count > 1]
        if len(b):
            spots = np.repeat(b - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            common = np.bincount(posting[spots], minlength=m)[x + 1 :]
        elif coded:
            common = np.zeros(m - x - 1, np.int64)
        else:
            continue
        if coded:
            common = (base[x] + base[x + 1 :]) // 2 + common
        good = 100 * common >= percent * (sizes[x] + sizes[x + 1 :] - common)
        if side is not None:
            good &= side[x + 1 :] != side[x]
        linked = np.flatnonzero(good) + x + 1
        links[x] += weight[linked].sum()
        links[linked] += weight[x]
        for y in linked:
            a, c = root(x), root(y)
            if a != c:
                label[max(a, c)] = min(a, c)
    return np.array([root(i) for i in range(m)], np.int64), links


_GROUPED = "doc_id long, comp long, blocks int, block int, copies long, coded boolean, pivot boolean, size long, elements binary"


def _sets(n_words: int):
    """(doc_id, text, comp, blocks, block, copies, coded, pivot) to rows with the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            sets = list(shingle_sets(batch.column(1), n_words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:8], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=[c.split()[0] for c in _GROUPED.split(", ")],
            )

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with sets and, last, their group's pivot set: the sets as differences from it."""
    for batch in batches:
        made, raw, pivot = [], None, np.zeros(0, np.uint64)
        for own, other in zip(batch.column("elements"), batch.column("other")):
            if (other := other.as_py()) != raw:
                raw, pivot = other, np.frombuffer(other, np.uint64)
            made.append(np.setxor1d(np.frombuffer(own.as_buffer(), np.uint64), pivot, assume_unique=True).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(made, pa.binary())], names=batch.schema.names[:-1])


def _resolve(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def solved(rows: list) -> pa.RecordBatch:
        rows = [next(same) for _, same in groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0])]  # a repeated row once
        sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        _, _, _, block, size, i, j, coded = zip(*rows)
        coded = coded[0]
        if not coded and len(rows) > 2:
            other = [np.setxor1d(s, sets[0], assume_unique=True) for s in sets]
            if sum(map(len, other)) < sum(map(len, sets)):
                sets, coded = other, True
        side = None if i[0] == j[0] else np.array(block)
        label, links = link_sets(sets, np.array(size, np.int64), coded, np.array([r[2] for r in rows]), side, percent)
        ids = np.array([r[0] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label]), pa.array(links)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for comp, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j", "doc_id", "elements", "copies", "block", "size", "i", "j", "coded"))):
                if (comp, i, j) != key:
                    if len(rows) > 1:
                        yield solved(rows)
                    key, rows = (comp, i, j), []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield solved(rows)

    return run


def ngram_jaccard_join(
    docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_sets: int = 128, most_blocks: int = 64, block_shingles: int = 1 << 20
) -> DataFrame:
    """Documents whose sets of word n-grams have a Jaccard similarity of at least ``percent`` / 100.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by
    links) and n_links (documents linked directly, exact copies included).
    Null or empty texts, or texts of white space, have no shingle and no link;
    texts with fewer words have one shingle, their whole word sequence. Rows
    with a null id come back with a null component and no links; repeated ids
    come back once per row and count as one document, by one of their texts if
    these differ.
    Other columns are ignored. An empty table gives an empty result.

    Candidate groups of more than ``block_shingles`` shingles are resolved as pairs
    of blocks of about so many; groups of sets of like sizes, as copies are, in
    blocks of ``block_sets`` distinct sets or, beyond ``most_blocks`` of these, larger
    ones.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col)
    ids = rows.where("doc_id is not null")
    parts = partitions_for(spark)
    met = stored(
        ids.mapInArrow(frugal(spark, _sign(n_words, percent, 4 * parts)), _ddl(_SIGNED))
        .repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(frugal(spark, _meet), _ddl(_MET)),
        "partenum",
    )
    summary = met.where("doc_id is not null").select("doc_id", "n", "fp", "fp2")
    levels = F.posexplode("least").alias("above", "least")
    least = met.where("doc_id is not null and n > 0").select(F.col("doc_id").alias("u"), "band", levels).select("u", (F.col("band") + F.col("above")).alias("level"), "least")
    shared = met.where("sig is not null").select("sig", "u", F.col("sig").bitwiseAND((1 << LEVEL_BITS) - 1).alias("level"))
    frequency = shared.groupBy("sig").agg(F.count("*").alias("often"))
    own = Window.partitionBy("u", "level")  # a document's own signatures
    ranked = shared.join(apart(frequency, "sig"), "sig").withColumns({"count": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("often", "sig"))})
    holders = ranked.join(least, ["u", "level"]).where("rank <= count - least + 1").select("sig", "u")
    heads = holders.groupBy("sig").agg(F.min("u").alias("v"), F.max("u").alias("top")).where("v < top").select("sig", "v")
    edges = holders.join(apart(heads, "sig"), "sig").where("u <> v").select("u", "v").distinct()
    edges = edges.union(met.where("v is not null").select("u", "v"))
    groups = kept(connected_components(edges)).select(
        F.col("node").alias("doc_id"), F.col("component").alias("comp")
    )
    classes = kept(
        summary.join(groups, "doc_id").groupBy("comp", "fp", "fp2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.min("n").alias("n"))
    )
    open_groups = classes.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("rep").alias("first"), (2 * F.max("n") <= 3 * F.min("n")).alias("alike")).where("m > 1")
    in_sets = F.when(F.col("alike"), F.least(F.ceil(F.col("m") / block_sets), F.lit(most_blocks))).otherwise(1)
    todo = (
        classes.join(apart(open_groups, "comp"), "comp")
        .withColumn("blocks", F.greatest(in_sets, F.ceil(F.col("total") / block_shingles)).cast("int"))
        .withColumn("coded", F.col("alike") & (F.col("blocks") > 1))
        .select(F.col("rep").alias("doc_id"), "comp", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "copies", "coded", (F.col("rep") == F.col("first")).alias("pivot"))
    )
    sets = kept(ids.join(todo.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "comp", "blocks", "block", "copies", "coded", "pivot").mapInArrow(frugal(spark, _sets(n_words)), _GROUPED))
    # large groups of sets of like sizes travel as differences from their pivot
    pivots = sets.where("pivot and coded").groupBy("comp").agg(F.min("elements").alias("other"))
    large = sets.where("coded").join(apart(pivots, "comp"), "comp").select(*(c.split()[0] for c in _GROUPED.split(", ")), "other").mapInArrow(_differences, _GROUPED)
    paired = (
        sets.where("not coded").unionByName(large)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
        .repartition(parts, "comp", "i", "j")
        .sortWithinPartitions("comp", "i", "j")
    )
    solved = kept(paired.mapInArrow(frugal(spark, _resolve(percent)), "u long, v long, links long"))
    final = connected_components(solved.select("u", "v"))
    degree = solved.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    by_class = (
        classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(degree, "rep", "left")
        .select("comp", "fp", "fp2", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    by_doc = groups.join(summary, "doc_id").join(by_class, ["comp", "fp", "fp2"]).select("doc_id", "fp", "fp2", "component_id", "n_links")
    out = summary.join(by_doc.distinct(), ["doc_id", "fp", "fp2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    lost = rows.where("doc_id is null").mapInArrow(_sizes(n_words), "doc_id long, n_shingles long, component_id long, n_links long")
    return out.union(lost)


def _sizes(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(s) for s in shingle_sets(batch.column(1), n_words)], pa.int64())
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, n, none, pa.array(np.zeros(len(n), np.int64))], names=["doc_id", "n_shingles", "component_id", "n_links"])

    return run
