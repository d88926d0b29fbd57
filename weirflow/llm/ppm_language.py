"""Language identification by prediction by partial matching.

Each language has a variable-order context tree of bytes: for every context of
up to ``order`` bytes the counts of the byte that follows. A byte that a context
has seen c times among n, with d distinct successors, has probability c/(n+d);
one it has not seen costs an escape of d/(n+d) and is looked for in the context
shorter by one byte, below the empty context as one of 256. Contexts that were
never seen cost nothing to leave. Statistics are frozen after training, so a
text's code length is a sum of table entries: the tables hold, for each byte
sequence that any language has seen, its resolved cost in every language, and
a text takes one lookup per byte, and one more for each order it has to leave.
A-Z are read as a-z. Contexts begin at the start of a text.

The tables' size is bounded by the training sample, ``max_rows`` texts of each
language, whatever the size of the corpus; or, where all texts teach, by the number
of distinct sequences of ``order + 1`` bytes in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import frugal, give_back, partitions_for, with_text
from .textvec import LOWER, HashIndex, slices, utf8
from .wordcounts import summed

_PLAIN_LETTER = re.compile("[A-Za-z]")
_NO_LETTERS = re.compile("[\x00-\x40\x5b-\x60\x7b-\x7f]+")
UNDETERMINED = "und"
#: Bits that any text may take beyond its limit for each byte; matters for short ones.
SLACK_BITS = 256
#: Tasks over a bounded sample; each sends its own counts to the driver.
SPREAD = 4
#: Steps of a bit in which costs a byte are counted.
STEPS = 4096


def grams(data: np.ndarray, part: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, end positions) of all g-byte sequences inside single texts."""
    n = len(data)
    if n < g:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n - g + 1, np.uint64)
    for k in range(g):
        value = value << np.uint64(8) | data[k : n - g + 1 + k]
    ok = np.ones(n - g + 1, bool)
    for cut in part[1:-1]:
        ok[max(cut - g + 1, 0) : min(cut, n - g + 1)] = False
    at = np.flatnonzero(ok)
    return value[at], at + g - 1


@dataclass
class PpmModel:
    """Per gram length g: known grams with their costs in bits, and known contexts of g - 1 bytes with their escape costs."""

    languages: list[str]
    order: int
    costs: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    def prepared(self) -> PpmModel:
        if not hasattr(self, "_cost"):
            self._cost = [HashIndex(k) for k, _ in self.costs]
            self._escape = [HashIndex(k) for k, _ in self.escapes]
        return self

    def code_lengths(self, arr: pa.Array) -> np.ndarray:
        """Bits of every text in every language."""
        self.prepared()
        data, offsets = utf8(arr)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, j in slices(offsets):
            part = offsets[i : j + 1] - offsets[i]
            raw = LOWER[data[offsets[i] : offsets[j]]]
            n = len(raw)
            if not n:
                continue
            bits = np.zeros((n, len(self.languages)), np.float32)
            left = np.arange(n)
            value = np.zeros(n, np.uint64)
            for k in range(self.order + 1):  # the byte and what precedes it in the text
                value[k:] |= raw[: n - k].astype(np.uint64) << np.uint64(8 * k)
            room = left - np.repeat(part[:-1], np.diff(part))
            for g in range(self.order + 1, 0, -1):
                mask = np.uint64((1 << 8 * g) - 1)
                fits = room[left] >= g - 1
                now, later = left[fits], left[~fits]
                key = value[now] & mask
                found = self._cost[g - 1].find(key)
                hit = found >= 0
                bits[now[hit]] += self.costs[g - 1][1][found[hit]]
                miss = now[~hit]
                context = self._escape[g - 1].find(key[~hit] >> np.uint64(8))
                known = context >= 0
                bits[miss[known]] += self.escapes[g - 1][1][context[known]]
                left = np.concatenate([later, miss]) if len(later) else miss
            bits[left] += 8.0
            full = np.flatnonzero(np.diff(part))
            out[i + full] = np.add.reduceat(bits, part[full], axis=0, dtype=np.float64)
        return out


def build(counts: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int) -> PpmModel:
    """``counts``: per language and gram length 1.. the distinct grams and how often each came."""
    languages = sorted(counts)
    m = len(languages)
    costs, escapes = [], []
    below_keys, below = None, None
    for g in range(1, order + 2):
        keys = np.unique(np.concatenate([counts[x][g - 1][0] for x in languages])) if m else np.zeros(0, np.uint64)
        contexts = np.unique(keys >> np.uint64(8))
        cost, escape = np.zeros((len(keys), m)), np.zeros((len(contexts), m))
        where = np.searchsorted(contexts, keys >> np.uint64(8))
        if g == 1:
            shorter = np.full((len(keys), m), 8.0)
        else:
            shorter = below[np.searchsorted(below_keys, keys & np.uint64((1 << 8 * (g - 1)) - 1))]
        for a, x in enumerate(languages):
            own, c = counts[x][g - 1]
            count = np.zeros(len(keys))
            count[np.searchsorted(keys, own)] = c
            n = np.bincount(where, weights=count, minlength=len(contexts))
            d = np.bincount(where, weights=count > 0, minlength=len(contexts))
            seen = n > 0
            escape[seen, a] = np.log2((n[seen] + d[seen]) / d[seen])
            total = (n + d)[where]
            with np.errstate(divide="ignore", invalid="ignore"):
                cost[:, a] = np.where(count > 0, np.log2(total / count), escape[where, a] + shorter[:, a])
        costs.append((keys, cost.astype(np.float32)))
        escapes.append((contexts, escape.astype(np.float32)))
        below_keys, below = keys, cost
    return PpmModel(languages, order, costs, escapes)


_COUNTS = "lang string, g int, keys binary, counts binary"


class _Held:
    """Counts of grams by language and length, added up as they grow."""

    def __init__(self):
        self.parts: dict[tuple[str, int], tuple[list[np.ndarray], list[np.ndarray]]] = {}

    def add(self, lang: str, g: int, keys: np.ndarray, counts: np.ndarray) -> None:
        k, c = self.parts.setdefault((lang, g), ([], []))
        k.append(keys)
        c.append(counts.astype(np.int64))
        if sum(map(len, k)) > max(1 << 18, 2 * len(k[0])):
            k[:], c[:] = ([x] for x in summed(k, c))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (lang, g), found in sorted(self.parts.items()):
            keys, counts = summed(*found)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([g], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["lang", "g", "keys", "counts"])


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                data, offsets = utf8(batch.column(1).filter(pa.array(langs == lang)))
                for i, j in slices(offsets):
                    raw = LOWER[data[offsets[i] : offsets[j]]]
                    for g in range(1, order + 2):
                        held.add(lang, g, *np.unique(grams(raw, offsets[i : j + 1] - offsets[i], g)[0], return_counts=True))
        yield from held.rows()

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of language and length to one row for each."""
    held, at = _Held(), None
    for batch in batches:
        for lang, g, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "g", "keys", "counts"))):
            if (lang, g) != at:
                yield from held.rows()
                held, at = _Held(), (lang, g)
            held.add(lang, g, np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64))
    yield from held.rows()


def _rows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null and lang is not null")


def _sample(labelled: DataFrame, max_rows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame | None:
    """(lang, text) of at most ``max_rows`` rows of each language, by the hash of their ids; None if there are no languages.

    The scan keeps its partitions: each task passes on the rows of small hashes, of
    each language about twice the bound over all tasks, and ranking sees only these.
    """
    rows = _rows(labelled, id_col, text_col, lang_col)
    held = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    thinned = None
    for lang, n in held.items():
        keep = (F.col("lang") == lang) & (chance < min(1.0, 2 * max_rows / n + 20 / n))
        thinned = keep if thinned is None else thinned | keep
    if thinned is None:
        return None
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    return rows.where(thinned).withColumn("r", F.row_number().over(first)).where(F.col("r") <= max_rows).select("lang", "text")


def fit_languages(labelled: DataFrame, order: int = 3, max_rows: int | None = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PpmModel:
    """Frozen statistics of at most ``max_rows`` rows of each language, by the hash of their ids; of all rows with None.

    Rows with a null language or id are left out; a null text adds nothing; rows
    that repeat an id count each, towards the bound too.
    """
    spark = labelled.sparkSession
    if max_rows is None:
        each = _rows(labelled, id_col, text_col, lang_col).select("lang", "text").mapInArrow(frugal(spark, _count(order)), _COUNTS)
        together = each.repartition(partitions_for(spark), "lang", "g").sortWithinPartitions("lang", "g")
        got = together.mapInArrow(frugal(spark, _add_up), _COUNTS).toArrow()  # a row for each language and length
    else:
        sample = _sample(labelled, max_rows, id_col, text_col, lang_col)
        if sample is None:
            return build({}, order)
        got = sample.repartition(SPREAD).mapInArrow(frugal(spark, _count(order)), _COUNTS).toArrow()
    parts: dict[tuple[str, int], list] = {}
    for lang, g, keys, counts in zip(*(got.column(c).to_pylist() for c in ("lang", "g", "keys", "counts"))):
        parts.setdefault((lang, g), []).append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)))
    counts = {}
    for (lang, g), found in sorted(parts.items()):
        keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        counts.setdefault(lang, []).append((keys, np.bincount(inverse, weights=np.concatenate([c for _, c in found]))))
    del got, parts
    model = build(counts, order)
    del counts
    give_back()
    return model


def _quantile(values: np.ndarray, counts: np.ndarray, share: float) -> float:
    """``numpy.quantile`` of sorted ``values`` that come ``counts`` times each."""
    upto = np.cumsum(counts)
    place = share * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, k, side="right")] for k in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def code_limits(labelled: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each language the bits a byte beyond which a text is taken to be in none.

    All rows of half of the ids teach a model, and all texts of the other half are
    coded by it; the limit is twice what 99 of 100 of them take at most, to a step
    of 1/``STEPS`` bit, but never above the 8 bits of a byte that nothing is known
    of, which is the limit too where fewer than 20 texts were coded. What reaches
    the driver are numbers of texts by step, up to 4 bits.
    """
    half = F.pmod(F.xxhash64(id_col), F.lit(2))
    model = fit_languages(labelled.where(half == 0), order, None, id_col, text_col, lang_col)
    if not model.languages:
        return {}
    spark = labelled.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            size = np.diff(utf8(batch.column(1))[1])
            bits = held.value.code_lengths(batch.column(1)).min(axis=1) / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ceil(np.minimum(bits, 4.0) * STEPS).astype(np.int32))], names=["lang", "step"])

    coded = _rows(labelled.where(half == 1), id_col, text_col, lang_col).where("text <> ''").select("lang", "text").mapInArrow(frugal(spark, run), "lang string, step int")
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, step, n in coded.groupBy("lang", "step").count().toLocalIterator():
        found.setdefault(lang, []).append((step, n))
    limits = {}
    for lang, steps in sorted(found.items()):
        values, counts = np.array(sorted(steps), np.int64).T
        if counts.sum() >= 20:
            limits[lang] = min(8.0, 2 * _quantile(values / STEPS, counts, 0.99))
    return limits


def has_letter(text: str | None) -> bool:
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def identify_languages(
    docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text", limits: dict[str, float] | None = None,
    keep: list[str] | None = None, lang_out: str = "lang_pred", score_out: str = "score",
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all), and ``lang_out`` and ``score_out``.

    lang_out is the language with the shortest code for the whole text, ties
    to the first in alphabetical order; ``und`` with score 0 where the text is
    null or has no letter, and for every text if nothing was learned. score_out is
    that language's share when codes are read as probabilities. That share says
    nothing of texts in no learned language: with ``limits``, of ``code_limits``,
    a text whose shortest code takes more than its language's bits a byte (8 where
    none is given) and ``SLACK_BITS``, both whole and with all but its letters
    read as spaces, is ``und`` too. Columns of ``docs`` with the names of the two
    results are replaced. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in (docs.columns if keep is None else keep) if c not in (lang_out, score_out)]
    base, where = with_text(docs, carried, text_col)
    schema = docs.select(*carried).schema.add(lang_out, "string").add(score_out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            text = batch.column(where)
            letters = np.array([has_letter(t) for t in text.to_pylist()], bool)
            if m.languages and batch.num_rows:
                bits = m.code_lengths(text)
                best = bits.argmin(axis=1)
                if limits is not None:
                    a_byte = np.array([limits.get(x, 8.0) for x in m.languages])
                    over = bits.min(axis=1) > a_byte[best] * np.diff(utf8(text)[1]) + SLACK_BITS
                    if over.any():  # digits and signs that were not learned say nothing of the language
                        plain = pa.array([_NO_LETTERS.sub(" ", t) if t else "" for t in text.filter(pa.array(over)).to_pylist()], pa.string())
                        again = m.code_lengths(plain)
                        letters[over] &= again.min(axis=1) <= a_byte[again.argmin(axis=1)] * np.diff(utf8(plain)[1]) + SLACK_BITS
                score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            else:
                best, score, letters = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            best = np.where(letters, best, len(m.languages))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0))], names=[*carried, lang_out, score_out])

    return base.mapInArrow(frugal(docs.sparkSession, run), schema)


def language_predictions(docs: DataFrame, labelled: DataFrame, **fit) -> DataFrame:
    """doc_id, lang_pred and score of every document; see ``identify_languages``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return identify_languages(rows, fit_languages(labelled, **fit), keep=["doc_id"])
