"""Document fingerprints by I-Match.

A lexicon holds the terms (words, A-Z lower-cased) whose inverse document
frequency lies in a chosen band. A document's distinct lexicon terms are sorted,
and each of several random subsets of the lexicon gives a hash of those it
contains. The fingerprint is the list of these hashes; the likeness of two is
the share of hashes that are equal among those that either has.

Subsets come in families of levels, of which each is half of the one before: dense
ones tell apart short texts and find exact copies, sparse ones hold a few terms of
a long text and survive when half of it changes.

Document frequencies are exact counts over all documents. Terms above the band are
few, however large the corpus (each is in a set share of all documents), and are
kept as they are; terms within it, from ``min_docs`` documents on, are the lexicon.
They set a bit of a bitmap of ``1 << bits``, as long as they are an eighth as many
as bits. Of a larger lexicon the terms in most documents do; the rest stays a table
by hash part, and the terms of texts that neither set of terms tells are looked up
in it, by a shuffle: each range of rows sends those it meets once and gets back
which are in the lexicon. So the bitmap's size is fixed, no term of the band is
left out, and a term outside the band shares a set bit with a chance of an eighth
at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import partitions_for, stored, text_rows
from .textvec import HashIndex, mix, text_words
from .wordcounts import bin_of, by_part, count_words, first_bin, histogram, part_of

BITS = 25
PARTS = 256  # of the lexicon; a part's bits lie together


def _terms(arr: pa.Array) -> Iterator[np.ndarray]:
    """The distinct terms of each text, one text's after another's."""
    for i, j, words, at in text_words(arr):
        yield np.concatenate([np.unique(words[at[k] : at[k + 1]]) for k in range(j - i)])


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """A term's bit: parts of the hash take turns in contiguous stretches."""
    slots = (1 << bits) // PARTS
    return part_of(keys, PARTS) * slots + (mix(keys) % np.uint64(slots)).astype(np.int64)


@dataclass
class Lexicon:
    """The bits of terms in the band, terms above it, and the random subsets: all of the lexicon, and ``draws`` families of ``levels`` nested ones.

    ``rest`` is the table (part, keys) of the band's terms that set no bit, None where all do.
    """

    marked: np.ndarray
    common: np.ndarray
    bits: int = BITS
    draws: int = 24
    levels: int = 10
    seeds: np.ndarray = field(default_factory=lambda: mix(np.arange(101, 165, dtype=np.uint64)))
    rest: DataFrame | None = None

    @classmethod
    def fit(cls, docs: DataFrame, max_share: float, min_docs: int, bits: int = BITS, marks: int | None = None, **how) -> Lexicon:
        """Of the terms in at least ``min_docs`` documents and at most ``max_share`` of all; ``docs`` has the column text.

        At most ``marks`` terms set a bit, by default an eighth as many as bits.
        """
        texts = docs.select("text")
        n = texts.count()
        counted = count_words(texts, _terms, PARTS)
        low = first_bin(histogram(counted)[2], (1 << bits) // 8 if marks is None else marks)
        slots, most = (1 << bits) // PARTS, max_share * n

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p, k, c in zip(*(batch.column(x).to_pylist() for x in ("part", "keys", "counts"))):
                    keys, counts = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                    flags = np.zeros(slots, bool)
                    flags[_places(keys[(bin_of(counts) >= low) & (counts >= min_docs) & (counts <= most)], bits) - p * slots] = True
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()), pa.array([keys[counts > most].tobytes()], pa.binary())], names=["part", "flags", "common"])

        got = counted.select("part", "keys", "counts").mapInArrow(mark, "part int, flags binary, common binary").toArrow()  # 1 << bits bits, and some words
        marked = np.zeros((1 << bits) // 8, np.uint8)
        for p, flags in zip(got.column("part").to_pylist(), got.column("flags").to_pylist()):
            marked[p * slots // 8 : (p + 1) * slots // 8] = np.frombuffer(flags, np.uint8)

        def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p, k, c in zip(*(batch.column(x).to_pylist() for x in ("part", "keys", "counts"))):
                    keys, counts = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([keys[(bin_of(counts) < low) & (counts >= min_docs) & (counts <= most)].tobytes()], pa.binary())], names=["part", "keys"])

        some = low > int(bin_of(np.array([max(min_docs, 1)]))[0])
        rest = stored(counted.select("part", "keys", "counts").mapInArrow(unmarked, "part int, keys binary"), "lexicon") if some else None
        counted.unpersist()
        return cls(marked, np.sort(np.frombuffer(b"".join(got.column("common").to_pylist()), np.uint64)), bits, rest=rest, **how)

    def sent(self, spark: SparkSession):
        """A broadcast of ``1 << bits`` bits, and some words."""
        return spark.sparkContext.broadcast(replace(self, rest=None))

    def _told(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which terms' bits are set, and which are above the band."""
        place = _places(terms, self.bits)
        bit = self.marked[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
        if not len(self.common):
            return bit, np.zeros(len(terms), bool)
        at = np.minimum(np.searchsorted(self.common, terms), len(self.common) - 1)
        return bit, self.common[at] == terms

    def holds(self, terms: np.ndarray, known: HashIndex | None = None) -> np.ndarray:
        """``known`` are those of the rest's terms that may be among ``terms``."""
        bit, common = self._told(terms)
        inside = bit & ~common
        return inside if known is None else inside | (known.find(terms) >= 0)

    def open_terms(self, arr: pa.Array) -> np.ndarray:
        """The distinct terms of all texts of which only the rest tells whether it has them."""
        found = [np.zeros(0, np.uint64)]
        for _, _, words, _ in text_words(arr):
            terms = np.unique(words)
            bit, common = self._told(terms)
            found.append(terms[~bit & ~common])
        return np.unique(np.concatenate(found))

    def fingerprints(self, arr: pa.Array, known: HashIndex | None = None) -> list[str]:
        """One string per text: ``DIGITS`` hexadecimal digits a subset, zeros where it has no term.

        A text without lexicon terms is hashed by all its distinct words; one
        without words has zeros alone.
        """
        out = []
        for i, j, words, at in text_words(arr):
            sets = [np.unique(words[at[k] : at[k + 1]]) for k in range(j - i)]
            doc = np.repeat(np.arange(j - i), [len(s) for s in sets])
            terms = np.concatenate(sets)
            inside = self.holds(terms, known)
            none = np.bincount(doc, weights=inside, minlength=j - i) == 0
            use = inside | none[doc]
            out += self._hashes(terms[use], doc[use], j - i)
        return out

    def _hashes(self, terms: np.ndarray, doc: np.ndarray, n: int) -> list[str]:
        """A subset's hash adds up the scrambled hashes of its sorted terms, and the number of them."""
        width = self.levels + 1
        out = np.zeros((n, 1 + self.draws * self.levels), np.uint16)

        def add(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
            total = np.zeros(size, np.uint64)
            np.add.at(total, at, values)
            return total

        def short(total: np.ndarray) -> np.ndarray:
            return np.where(total > 0, np.maximum(mix(total) >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype(np.uint16)

        out[:, 0] = short(add(doc, mix(terms), n))
        for d in range(self.draws):
            drawn = mix(terms ^ self.seeds[d])
            level = _ZEROS[(drawn >> np.uint64(64 - _TOP)).astype(np.int64)]
            held = level > 0
            at = doc[held] * width + np.minimum(level[held], self.levels)
            each = add(at, mix(drawn[held] + self.seeds[d]), n * width).reshape(n, width)
            nested = np.cumsum(each[:, :0:-1], axis=1, dtype=np.uint64)[:, ::-1]  # a level holds the levels above it
            out[:, 1 + d * self.levels : 1 + (d + 1) * self.levels] = short(nested)
        text = out.astype(">u2").tobytes().hex()
        size = DIGITS * out.shape[1]
        return [text[k : k + size] for k in range(0, len(text), size)]


DIGITS = 4
_TOP = 12
#: Leading zeros of numbers of ``_TOP`` bits.
_ZEROS = np.array([_TOP - int(x).bit_length() for x in range(1 << _TOP)])


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """For each two fingerprints the share of equal subset hashes among those that either has; 1 for two without any."""
    if not a:
        return np.zeros(0)
    x, y = (np.frombuffer(bytes.fromhex("".join(f)), ">u2").reshape(len(f), -1) for f in (a, b))
    either = ((x > 0) | (y > 0)).sum(axis=1)
    return np.where(either > 0, ((x == y) & (x > 0)).sum(axis=1) / np.maximum(either, 1), 1.0)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, HashIndex | None]]:
    """(range, rows of it, known terms of the rest) of rows (range, tail, doc_id, text), before which, with the column known, those with a range's known terms come."""
    at, known, index = None, [], None
    for whole in batches:
        ranges = whole.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(ranges)]):
            if a == b:
                continue
            if ranges[a] != at:
                at, known, index = ranges[a], [], None
            if whole.num_columns == 5:
                given = whole.column(4).slice(a, b - a)
                n = len(given) - given.null_count
                known += [np.frombuffer(k, np.uint64) for k in given.slice(0, n).to_pylist()]
                a += n
                if a < b and index is None:
                    index, known = HashIndex(np.unique(np.concatenate([np.zeros(0, np.uint64), *known]))), []
            for k in range(a, b, 1000):
                yield at, whole.slice(k, min(1000, b - k)), index


def _with_known(rows: DataFrame, lexicon: Lexicon, texts: Callable) -> DataFrame:
    """``rows`` (range, tail, doc_id, text), ordered in each range as by ``_with_next``, and ahead of a range's rows some with the column known: terms it meets that the lexicon's rest holds.

    ``texts`` gives, of such rows' batches, (range, array of texts) for all texts
    whose terms will be asked for. Each term is sent once for a range, or where a
    range has very many, once for each stretch of it.
    """
    spark = rows.sparkSession
    parts, held, flush = partitions_for(spark), lexicon.sent(spark), 1 << 19

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_terms, size = None, [], 0

        def out() -> pa.RecordBatch:
            terms = np.unique(np.concatenate(open_terms))
            found = [(p, k) for p, k, _ in by_part(terms, terms, PARTS)]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([at] * len(found), pa.int32()), pa.array([k for _, k in found], pa.binary())], names=["part", "range", "keys"])

        for now, arr in texts(batches):
            if open_terms and (now != at or size > flush):
                yield out()
                open_terms, size = [], 0
            at = now
            open_terms.append(held.value.open_terms(arr))
            size += len(open_terms[-1])
        if open_terms:
            yield out()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, index = None, None
        for batch in batches:
            for p, at, k in zip(*(batch.column(c).to_pylist() for c in ("part", "range", "keys"))):
                keys = np.frombuffer(k, np.uint64)
                if at is None:  # the rest's, ahead of those asked for
                    part, index = p, HashIndex(keys)
                elif p == part:
                    found = keys[index.find(keys) >= 0]
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["range", "known"])

    asked = rows.mapInArrow(ask, "part int, range int, keys binary")
    told = lexicon.rest.select("part", F.lit(None).cast("int").alias("range"), "keys").unionByName(asked)
    known = stored(told.repartition(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("range")).mapInArrow(answer, "range int, known binary"), "known")
    every = rows.withColumn("known", F.lit(None).cast("binary")).unionByName(known.withColumn("tail", F.lit(False)), allowMissingColumns=True)
    order = ["range", F.col("known").isNull(), "tail", F.desc(F.coalesce("doc_id", F.lit(-(2**63)))), "text"]
    return every.repartition(parts, "range").sortWithinPartitions(*order).select("range", "tail", "doc_id", "text", "known")


def fingerprint_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every whole text; null counts as empty."""
    spark = docs.sparkSession
    held, rows = lexicon.sent(spark), text_rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch, known in _stretches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(held.value.fingerprints(batch.column(3), known), pa.string())], names=["doc_id", "fingerprint"])

    in_range = F.lit(0) if lexicon.rest is None else F.pmod(F.xxhash64("doc_id", "text"), F.lit(2 * partitions_for(spark))).cast("int")
    rows = rows.select(in_range.alias("range"), F.lit(False).alias("tail"), "doc_id", "text")
    if lexicon.rest is not None:
        rows = _with_known(rows, lexicon, lambda batches: ((at, batch.column(3)) for at, batch, _ in _stretches(batches)))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def _range_of(number: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie below ``number``, by halving."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    padded = F.array(*[F.lit(c).cast("long") for c in [*cuts, *[2**63 - 1] * ((1 << steps) - 1 - len(cuts))]])
    halves = F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)])
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(padded, at + half - 1) < number, at + half).otherwise(at))


def _with_next(rows: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text) in partitions by ranges of ids, each in descending order and closed by a copy of the row that follows.

    Ranges hold about the same number of bytes: ids are cut finely first, and
    neighbours put together by their sizes. Only the cuts' bounds, sizes and
    largest ids reach the driver, eight for each partition.
    """
    spark = rows.sparkSession
    ordered = rows.withColumn("ord", F.coalesce("doc_id", F.lit(-(2**63))))
    fine = 8 * parts
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / fine for i in range(1, fine)], 0.2 / fine)}) if parts > 1 else []
    sizes = ordered.select("ord", F.octet_length("text").alias("bytes")).groupBy(_range_of(F.col("ord"), cuts).alias("cut"))
    found = sorted(tuple(r) for r in sizes.agg(F.sum(F.col("bytes") + 200), F.max("ord")).collect())
    if not found:
        return ordered.select(F.lit(0).alias("range"), F.lit(False).alias("tail"), "doc_id", "text")
    share, held, bounds, heads = sum(size for _, size, _ in found) / (2 * parts), 0, [], []
    for _, size, head in found:
        if heads and held + size <= share:
            heads[-1] = head
            held += size
        else:
            bounds += heads[-1:]
            heads.append(head)
            held = size
    # a range's last row is followed by the head of the range below, the lowest's by the highest head
    follow = [(heads[i - 1], i) for i in range(len(heads))]
    ordered = ordered.withColumn("range", _range_of(F.col("ord"), bounds).cast("int"))
    tails = spark.createDataFrame(follow, "ord long, range int")
    copies = ordered.drop("range").join(F.broadcast(tails), "ord")  # one row a range
    every = ordered.select("range", F.lit(False).alias("tail"), "ord", "doc_id", "text").unionByName(copies.select("range", F.lit(True).alias("tail"), "ord", "doc_id", "text"))
    # ranges take turns over the partitions, by keys that hash to these
    keys = {r["at"]: r["id"] for r in spark.range(20 * parts + 100).select("id", F.pmod(F.hash(F.col("id")), F.lit(parts)).alias("at")).collect()}
    turns = F.array(*[F.lit(keys.get(k, k)).cast("long") for k in range(parts)])
    dealt = every.withColumn("turn", F.get(turns, F.col("range") % parts))
    return dealt.repartition(parts, "turn").sortWithinPartitions("range", "tail", F.desc("ord"), "text").select("range", "tail", "doc_id", "text")


def _edited(batches: Iterator[pa.RecordBatch], prints: Callable) -> Iterator[tuple]:
    """Over rows of ``_with_next``: (range, its known terms, texts, rows whose next has come, their edited texts).

    Such a row is (id, text, fingerprint, next text, next fingerprint); ``prints``
    gives the fingerprints of an array of texts.
    """
    carried = []  # at most one row whose next is to come
    for at, batch, known in _stretches(batches):
        out = []
        for now in zip(*(batch.column(k).to_pylist() for k in range(4)), prints(batch.column(3), known)):
            if carried and carried[0][0] == now[0] and not carried[0][1]:
                out.append((*carried[0][2:], now[3], now[4]))
            carried = [now]
        yield at, known, batch.column(3), out, [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, _, n, _ in out]


def _edited_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    for at, _, texts, _, edited in _edited(batches, lambda arr, known: repeat(None)):
        yield at, texts
        yield at, pa.array(edited, pa.large_string())


def edited_fingerprints(docs: DataFrame, max_share: float = 0.2, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", marks: int | None = None) -> DataFrame:
    """Each document's fingerprint, its edited text's and their likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many, or all, of the next document's in descending order of ids;
    the first follows the last. Null text is empty, null ids come last, rows
    that repeat an id are ordered by text; they, and all rows with a null id, fall
    into one range and so into one task. The lexicon holds the terms in at least
    ``min_docs`` documents and at most ``max_share`` of them; for ``marks`` see
    ``Lexicon.fit``. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col)
    lexicon = Lexicon.fit(rows, max_share, min_docs, marks=marks)
    held = lexicon.sent(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        for _, known, _, out, edited in _edited(batches, lex.fingerprints):
            if not out:
                continue
            prints = lex.fingerprints(pa.array(edited, pa.large_string()), known)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.int64()), pa.array([len(r[1]) for r in out], pa.int64()), pa.array([sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([r[2] for r in out]), pa.array(prints), pa.array(likeness([r[2] for r in out], prints)), pa.array(likeness([r[2] for r in out], [r[4] for r in out])),
                ], schema=schema,
            )

    follows = _with_next(rows, partitions_for(spark))
    if lexicon.rest is not None:
        follows = _with_known(follows, lexicon, _edited_texts)
    return follows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
