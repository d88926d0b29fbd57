"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

Tokens are words, A-Z lower-cased, and one end mark a text. Counts over all
training texts give the add-0.1 unigram base. The model is P(class | context)
times P(word | class, context). Words fall into classes of about equal mass: the
most frequent ones are first grouped by the company they keep (how often texts that
hold them hold each of the very most frequent words), others by frequency, and
all words beyond a table of bounded size form the tail class. P(class | context)
is a softmax of summed weight rows: of the word before, of the pair before, and
of the words two and three before (skips), each hashed into its own region of a
table. P(word | class, context) goes down a binary tree over the class's words that
halves their mass at each fork: a softmax of two at the first ``depth`` forks, from
the log odds of the sides' add-0.1 counts and a weight for the word before and one
for the pair before, hashed with the fork into a second table; below these, where few and rare words are left, the add-0.1 share of the
word's count. In the tail that share alone holds; an unknown word is one event of
the tail. Both tables grow with the number of distinct words, up to a size that
every task can hold.

Weights are trained on all training texts, each once: in every round the texts of
its share are read where they lie, each task takes gradient steps from the
round's weights, and the tasks' changes are averaged: rows of classes by the
tokens a task saw, weights of forks by the size of the gradients it saw for them.
Scoring goes over arrays of tokens. Counts of tail words never reach the driver
or a broadcast: tail occurrences meet the counts in a shuffle by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import partitions_for
from .textvec import HashIndex, mix, text_words
from .wordcounts import bin_of, by_part, count_words, first_bin, histogram

END, BEGIN, RARE = np.uint64(1), np.uint64(2), np.uint64(3)
ADD = 0.1
#: Which features forks use, by their places: the word before and the pair before. With the skips, too, texts held out from sf0.1 scored 0.01 lower a token.
FORK_FEATURES = (0, 3)


@dataclass(frozen=True)
class Tables:
    """Rows of the classes' weight table for each feature, and bits of the forks' table."""

    regions: tuple[int, int, int, int]
    fork_bits: int

    @classmethod
    def of(cls, n_words: int, max_row_bits: int, max_fork_bits: int) -> Tables:
        """For so many distinct words: rows for one word in 32, cells for four times as many forks, within bounds."""
        size = max(n_words, 1).bit_length()
        row = min(max(size - 5, 8), max_row_bits)
        return cls((1 << row, 1 << row - 1, 1 << row - 1, 1 << row), min(max(size + 2, 12), max_fork_bits))

    @property
    def rows(self) -> int:
        return sum(self.regions)

    @property
    def cells(self) -> int:
        return 1 << self.fork_bits


def tokens(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Over slices of a text column: (first row, end row, tokens with end marks, begins)."""
    for i, j, words, at in text_words(arr):
        yield i, j, np.insert(words, at[1:], END), at + np.arange(len(at))


def _add_arrays(rows: DataFrame, tasks: int, per_task: Callable, length: int, kind: type = np.float32, fan_in: int = 32) -> np.ndarray:
    """Sum over ``tasks`` tasks of an array of a fixed length, which each task makes of its rows and sends as ``kind``.

    Arrays are cut in pieces of about a megabyte and added up in as many steps as it
    takes for no task to read a piece of more than ``fan_in`` others.
    """
    ddl, names = "piece int, turn int, total binary", ["piece", "turn", "total"]
    pieces = min(256, max(1, length >> 18))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = per_task(batches)
        if made is not None:
            turn = TaskContext.get().partitionId() // fan_in
            for p, x in enumerate(np.array_split(made, pieces)):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([turn], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary())], names=names)

    def add(kind: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for p, t, x in zip(batch.column("piece").to_pylist(), batch.column("turn").to_pylist(), batch.column("total")):
                    part = np.frombuffer(x.as_buffer(), kind)
                    if (p, t) in total:
                        total[p, t] += part
                    else:
                        total[p, t] = part.astype(np.float64)
            for (p, t), x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([t // fan_in], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=names)

        return run

    summed, groups = rows.coalesce(tasks).mapInArrow(make, ddl), -(-tasks // fan_in)
    spread = partitions_for(rows.sparkSession)
    while True:
        summed = summed.repartition(max(1, min(spread, pieces * groups)), "piece", "turn").mapInArrow(add(kind), ddl)
        if groups == 1:
            break
        groups, kind = -(-groups // fan_in), np.float32
    got = summed.toArrow()
    out = [np.zeros(len(x)) for x in np.array_split(np.zeros(length), pieces)]
    for p, x in zip(got.column("piece").to_pylist(), got.column("total").to_pylist()):
        out[p] += np.frombuffer(x, np.float32)
    return np.concatenate(out)


# counts


def _tokens_alone(arr: pa.Array) -> Iterator[np.ndarray]:
    for _, _, t, _ in tokens(arr):
        yield t


def most_frequent(counted: DataFrame, at_most: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(keys, counts, N, V): the at most ``at_most`` tokens above a count, by falling count."""
    n, v, sizes = histogram(counted)
    least = first_bin(sizes, at_most)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                top = bin_of(counts) >= least
                yield pa.RecordBatch.from_arrays([pa.array([keys[top].tobytes()], pa.binary()), pa.array([counts[top].tobytes()], pa.binary())], names=["keys", "counts"])

    got = counted.select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").toArrow()  # at_most entries
    keys = np.frombuffer(b"".join(got.column(0).to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(got.column(1).to_pylist()), np.int64)
    order = np.lexsort((keys, -counts))
    return keys[order], counts[order], n, v


# classes


def company(train: DataFrame, tasks: int, keys: np.ndarray, anchors: int) -> np.ndarray:
    """For each of ``keys``, by falling count, the summed profiles of the texts that hold it; a profile is a text's shares of the ``anchors`` first keys."""
    held = train.sparkSession.sparkContext.broadcast(keys)  # a bounded table

    def per_task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        index = HashIndex(held.value)
        out = np.zeros((len(held.value), anchors), np.float32)
        for batch in batches:
            for i, j, t, at in tokens(batch.column(0)):
                rank = index.find(t)
                for k in range(j - i):
                    own = rank[at[k] : at[k + 1]]
                    profile = np.bincount(own[(own >= 0) & (own < anchors)], minlength=anchors).astype(np.float32)
                    total = profile.sum()
                    if total:
                        out[np.unique(own[own >= 0])] += profile / total
        return out.ravel()

    return _add_arrays(train, tasks, per_task, len(keys) * anchors).reshape(len(keys), anchors)


def _clusters(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Weighted k-means on square roots of shares (Hellinger distance), centres spread far apart at first."""
    x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1e-9))
    x = x - np.average(x, axis=0, weights=weight)
    centres = x[[0]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(k, len(x)):
        centres = np.concatenate([centres, x[[int(np.argmax(near * np.sqrt(weight)))]]])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = np.average(x[own == c], axis=0, weights=weight[own == c])
    return own


def _cut(counts: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word so that classes, in the order given, have about the same mass."""
    if not len(counts):
        return np.zeros(0, np.int64)
    middle = np.cumsum(counts) - counts / 2
    return np.unique((middle / counts.sum() * classes).astype(np.int64), return_inverse=True)[1]


@dataclass
class Forks:
    """For each class a binary tree over its words, by falling count, that halves their mass at each fork."""

    bias: np.ndarray  # by fork, log odds of its right side
    steps: np.ndarray  # (words, depth): 2 * fork + side down a word's path, -1 beyond its end
    rest: np.ndarray  # log10 of a word's share of the mass below its last step

    @classmethod
    def build(cls, classes: np.ndarray, counts: np.ndarray, depth: int) -> Forks:
        n, order = len(classes), np.argsort(classes, kind="stable")
        mass = np.r_[0, np.cumsum(counts[order] + ADD)]
        ends = np.cumsum(np.bincount(classes)) if n else np.zeros(0, np.int64)
        low, high = (np.r_[0, ends[:-1]][classes[order]], ends[classes[order]]) if n else (ends, ends)
        bias, steps = np.zeros(n + 1, np.float32), np.full((n, depth), -1, np.int32)
        for d in range(depth):
            left = np.flatnonzero(high - low > 1)
            a, b = low[left], high[left]
            fork = np.clip(np.searchsorted(mass, (mass[a] + mass[b]) / 2), a + 1, b - 1)  # the place of the cut, unlike any other's
            right = left >= fork
            bias[fork] = np.log((mass[b] - mass[fork]) / (mass[fork] - mass[a]))
            steps[order[left], d] = 2 * fork + right
            low[left], high[left] = np.where(right, fork, a), np.where(right, b, fork)
        rest = np.zeros(n)
        rest[order] = np.log10((counts[order] + ADD) / (mass[high] - mass[low]))
        return cls(bias, steps, rest)

    def walk(self, found: np.ndarray, context: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(token, fork, side, cells by feature) of each step of the tokens' paths; unknown ones (-1) take none."""
        if not hasattr(self, "_hash"):
            self._hash = (mix(np.arange(len(self.bias), dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
        known = np.flatnonzero(found >= 0)
        paths = self.steps.take(found[known], axis=0).ravel()
        taken = np.flatnonzero(paths >= 0)
        step, token = paths[taken], known[taken // max(self.steps.shape[1], 1)]
        fork = step >> 1
        own, cells = self._hash.take(fork), []
        for k in FORK_FEATURES:
            x = context[k].take(token)
            x ^= own
            x *= np.uint32(0x9E3779B1)
            x >>= np.uint32(32 - bits)
            cells.append(x.astype(np.int64))
        return token, fork, (step & 1).astype(np.float32), cells

    def odds(self, weights: np.ndarray, fork: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
        z = self.bias.take(fork)
        for c in cells:
            z += weights.take(c)
        return np.clip(z, -30, 30, out=z)

    def learn(self, weights: np.ndarray, squares: np.ndarray, found: np.ndarray, context: np.ndarray, bits: int, rate: float) -> None:
        _, fork, side, cells = self.walk(found, context, bits)
        g = 1 / (1 + np.exp(-self.odds(weights, fork, cells))) - side
        square = g * g
        for c in cells:
            np.add.at(squares, c, square)
        g *= -rate
        for c in cells:
            np.add.at(weights, c, g / np.sqrt(squares.take(c)))

    def log_share(self, weights: np.ndarray, found: np.ndarray, context: np.ndarray, bits: int) -> np.ndarray:
        """log10 P(word | class, context) of each token, 0 for unknown ones."""
        token, fork, side, cells = self.walk(found, context, bits)
        z = self.odds(weights, fork, cells)
        out = np.bincount(token, weights=np.log1p(np.exp(np.where(side > 0, -z, z))), minlength=len(found)) / -np.log(10)
        known = found >= 0
        out[known] += self.rest[found[known]]
        return out


@dataclass
class Vocabulary:
    """Known words by falling count, their classes; the last class is the tail."""

    keys: np.ndarray
    classes: np.ndarray
    n_classes: int
    log_count: np.ndarray  # log10 of count + 0.1
    tail_mass: float  # its count, and 0.1 for each of its words and the unknown one
    n: int
    v: int
    class_mass: np.ndarray
    forks: Forks

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, n: int, v: int, groups: np.ndarray, n_classes: int, depth: int = 9) -> Vocabulary:
        """``groups``: of the first words; the other known ones get classes by frequency alone."""
        classes = np.zeros(len(keys), np.int64)
        first, total, used = len(groups), max(int(counts.sum()), 1), 0
        sets = [np.flatnonzero(groups == g) for g in np.unique(groups)] + [np.arange(first, len(keys))]
        for own in sets:
            if len(own):
                cut = _cut(counts[own], max(1, round((n_classes - 1) * counts[own].sum() / total)))
                classes[own] = used + cut
                used += int(cut.max()) + 1
        mass = np.bincount(classes, weights=counts + ADD, minlength=used + 1)
        tail = n - int(counts.sum()) + ADD * (v - len(keys) + 1)
        mass[used] = tail
        return cls(keys, classes, used + 1, np.log10(counts + ADD), tail, n, v, mass, Forks.build(classes, counts, depth))


# model


def contexts(t: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Hashes of each token's features: (4, tokens). Context words that aren't known count as one."""
    c = np.where(known, t, RARE)
    place = np.arange(len(t)) - np.repeat(at[:-1], np.diff(at))
    before = []
    for back in (1, 2, 3):
        x = np.full(len(t), BEGIN)
        x[back:] = c[:-back] if back < len(t) else c[:0]
        before.append(np.where(place >= back, x, BEGIN))
    pair = mix(before[0] * np.uint64(0x9E3779B97F4A7C15) + before[1])
    return np.stack([mix(x + np.uint64(k)) for k, x in enumerate((*before, pair))])


def feature_rows(context: np.ndarray, tables: Tables) -> np.ndarray:
    """Rows of the classes' table for each feature and token: (4, tokens)."""
    out, first = np.empty(context.shape, np.uint16 if tables.rows <= 1 << 16 else np.uint32), 0
    for k, (x, size) in enumerate(zip(context, tables.regions)):
        out[k] = (x % np.uint64(size)).astype(np.uint32) + np.uint32(first)
        first += size
    return out


def fork_contexts(context: np.ndarray) -> np.ndarray:
    return (context >> np.uint64(32)).astype(np.uint32)


def _summed_rows(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Classes' scores for each token, kept where single precision can raise e to them."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += bias
    return np.clip(z, -60, 60, out=z)


def _sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def _log_softmax(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = _summed_rows(bias, weights, rows)
    z -= np.log(_sums(np.exp(z)))[:, None]
    return z


def _step(bias: np.ndarray, weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, y: np.ndarray, rate: float) -> None:
    g = _summed_rows(bias, weights, rows)
    np.exp(g, out=g)
    g /= _sums(g)[:, None]
    g[np.arange(len(y)), y] -= 1
    for r in rows:
        order = np.argsort(r, kind="stable")
        r = r[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        s, r = np.add.reduceat(g.take(order, axis=0), first, axis=0), r[first].astype(np.int64)
        q = squares.take(r, axis=0)
        q += s * s
        squares[r] = q
        np.sqrt(q, out=q)
        np.divide(s, q, out=q)
        q *= rate
        weights[r] -= q


def train_weights(train: DataFrame, share: Callable[[int], DataFrame], tasks: int, words: Vocabulary, tables: Tables, rounds: int, rate: float, fork_rate: float, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bias, weights, weights of forks) after each round's share of the training texts."""
    context = train.sparkSession.sparkContext
    bias = np.log(np.maximum(words.class_mass, 1e-9) / max(words.class_mass.sum(), 1e-9)).astype(np.float32)
    shape, cells = (tables.rows, words.n_classes), tables.cells
    weights, forks = np.zeros(shape, np.float32), np.zeros(cells, np.float32)
    held_words = context.broadcast(words)
    for r in range(rounds):
        held = context.broadcast((weights, forks))

        def per_task(batches: Iterator[pa.RecordBatch], held=held) -> np.ndarray | None:
            words = held_words.value
            index = HashIndex(words.keys)
            before, forks_before = held.value
            # new arrays: np.add.at is several times slower on the type objects of unpickled ones
            own, own_forks = np.zeros(shape, np.float32), np.zeros(cells, np.float32)
            own += before
            own_forks += forks_before
            squares, fork_squares, seen = np.ones(shape, np.float32), np.ones(cells, np.float32), 0
            for batch in batches:
                for _, _, t, at in tokens(batch.column(0)):
                    found = index.find(t)
                    features = contexts(t, at, found >= 0)
                    rows, features = feature_rows(features, tables), fork_contexts(features)
                    y = np.where(found >= 0, words.classes[np.maximum(found, 0)] if len(words.classes) else 0, words.n_classes - 1)
                    for a in range(0, len(t), step):
                        _step(bias, own, squares, rows[:, a : a + step], y[a : a + step], rate)
                        words.forks.learn(own_forks, fork_squares, found[a : a + step], features[:, a : a + step], tables.fork_bits, fork_rate)
                    seen += len(t)
            if not seen:
                return None
            seen /= 1 << 20  # sums stay in the range of half precision
            own -= before
            mass = np.sqrt(fork_squares - 1)
            return np.concatenate([own.ravel() * np.float32(seen), (own_forks - forks_before) * mass, mass, np.array([seen], np.float32)])

        total = _add_arrays(share(r), tasks, per_task, weights.size + 2 * cells + 1, np.float16)
        if total[-1] > 0:
            weights = weights + (total[: weights.size] / total[-1]).reshape(shape).astype(np.float32)
            moved, mass = total[weights.size : weights.size + cells], total[weights.size + cells : -1]
            forks = (forks + moved / np.maximum(mass, 1e-6)).astype(np.float32)
        held.unpersist()
    return bias, weights, forks


# scoring

_PASS = [("uid", "long"), ("doc_id", "long"), ("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("model", "double")]


def _score(words, parts: int):
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tables, bias, weights, forks = words.value
        index = HashIndex(vocabulary.keys)
        per_token = np.log10(vocabulary.n + ADD * (vocabulary.v + 1))
        uid = TaskContext.get().partitionId() << 33
        tail_class = vocabulary.n_classes - 1
        keys, values, held = [], [], 0
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((4, n))
            for i, j, t, at in tokens(batch.column(2)):
                found = index.find(t)
                known = found >= 0
                y = np.where(known, vocabulary.classes[np.maximum(found, 0)] if len(vocabulary.classes) else 0, tail_class)
                features = contexts(t, at, known)
                where, features = feature_rows(features, tables), fork_contexts(features)
                model = np.empty(len(t))
                for a in range(0, len(t), 1 << 14):
                    z = _log_softmax(bias, weights, where[:, a : a + (1 << 14)])
                    model[a : a + (1 << 14)] = z[np.arange(len(z)), y[a : a + (1 << 14)]]
                model /= np.log(10)
                for a in range(0, len(t), 1 << 14):
                    model[a : a + (1 << 14)] += vocabulary.forks.log_share(forks, found[a : a + (1 << 14)], features[:, a : a + (1 << 14)], tables.fork_bits)
                model[~known] -= np.log10(vocabulary.tail_mass)
                base = np.where(known, vocabulary.log_count[np.maximum(found, 0)] if len(vocabulary.keys) else 0.0, 0.0) - per_token
                out[:, i:j] = [np.diff(at), np.add.reduceat(known, at[:-1]), np.add.reduceat(base, at[:-1]), np.add.reduceat(model, at[:-1])]
                doc = np.repeat(np.arange(i, j), np.diff(at))[~known]
                keys.append(t[~known])
                values.append(uid + doc)
                held += len(doc)
            yield rows(n, part=pa.array((uid + np.arange(n)) % parts, pa.int32()), kind=pa.array(np.full(n, 2), pa.int32()), uid=pa.array(uid + np.arange(n)), doc_id=batch.column(0), held_out=batch.column(1), n_tokens=pa.array(out[0].astype(np.int64)), n_known=pa.array(out[1].astype(np.int64)), base=pa.array(out[2]), model=pa.array(out[3]))
            uid += n
            if held > 1 << 18:
                yield from tail(keys, values)
                keys, values, held = [], [], 0
        if held:
            yield from tail(keys, values)

    def tail(keys: list, values: list) -> Iterator[pa.RecordBatch]:
        got = list(by_part(np.concatenate(keys), np.concatenate(values).astype(np.int64), parts))
        yield rows(len(got), part=pa.array([r[0] for r in got], pa.int32()), kind=pa.array([1] * len(got), pa.int32()), keys=pa.array([r[1] for r in got], pa.binary()), values=pa.array([r[2] for r in got], pa.binary()))

    return run, schema


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (part, kind): a part's counts, then occurrences of tail words, then documents."""
    schema = pa.schema([(c, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[k]) for c, k in _PASS])
    part, keys, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        docs = batch.filter(pa.array(batch.column("kind").to_numpy() == 2))
        if docs.num_rows:
            yield pa.RecordBatch.from_arrays([docs.column(c) for c, _ in _PASS], schema=schema)
        rest = batch.filter(pa.array(batch.column("kind").to_numpy() < 2))
        for p, kind, k, v in zip(*(rest.column(c).to_pylist() for c in ("part", "kind", "keys", "values"))):
            if p != part:
                part, keys, counts = p, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if kind == 0:
                keys, counts = np.frombuffer(k, np.uint64), np.frombuffer(v, np.int64)
                continue
            t, uid = np.frombuffer(k, np.uint64), np.frombuffer(v, np.int64)
            at = np.minimum(np.searchsorted(keys, t), max(len(keys) - 1, 0))
            known = keys[at] == t if len(keys) else np.zeros(len(t), bool)
            log = np.log10(np.where(known, counts[at] if len(keys) else 0, 0) + ADD)
            own, inverse = np.unique(uid, return_inverse=True)
            total = pa.array(np.bincount(inverse, weights=log))
            zeros = pa.array(np.zeros(len(own), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.bool_()), zeros, pa.array(np.bincount(inverse, weights=known).astype(np.int64)), total, total], schema=schema)


def score_texts(
    docs: DataFrame, held_out, table_size: int = 1 << 18, grouped: int = 1 << 15, anchors: int = 48, groups: int = 8, n_classes: int = 16, depth: int = 9, max_row_bits: int = 14, max_fork_bits: int = 21,
    rounds: int = 2, rate: float = 0.15, fork_rate: float = 0.2, step: int = 8192, task_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Base and model log10 probabilities of each whole text.

    ``held_out``, a condition on ``docs``, marks texts not learned from (null:
    learned from). Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score, one row for each row of ``docs``, repeated ones too. A
    null text is empty and has the end mark alone. If nothing is learned, all
    tokens are unknown. An empty table gives an empty result.

    Bounds that don't depend on the data: ``table_size`` words with a class of
    their own, ``max_row_bits`` and ``max_fork_bits`` of the weight tables. A
    training task reads about ``task_tokens`` tokens a round, or fewer where that
    would leave cores idle, so that the weights it sends are small beside its texts.
    """
    spark = docs.sparkSession
    parts = 2 * partitions_for(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learned = rows.where(~F.col("held_out"))
    train = learned.select("text")
    counted = count_words(train, _tokens_alone, parts)
    keys, counts, n, v = most_frequent(counted, table_size)
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // (rounds * task_tokens)))
    top = min(grouped, len(keys))
    own = _clusters(company(train, tasks, keys[:top], min(anchors, top)), counts[:top].astype(float), groups) if top else np.zeros(0, np.int64)
    words, tables = Vocabulary.build(keys, counts, n, v, own, n_classes, depth), Tables.of(v, max_row_bits, max_fork_bits)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    bias, weights, forks = train_weights(train, lambda r: learned.where(turn == r).select("text"), tasks, words, tables, rounds, rate, fork_rate, step)
    run, schema = _score(spark.sparkContext.broadcast((words, tables, bias, weights, forks)), parts)
    ddl = ", ".join(f"{f.name} {({pa.int32(): 'int', pa.binary(): 'binary', pa.int64(): 'long', pa.bool_(): 'boolean', pa.float64(): 'double'})[f.type]}" for f in schema)
    scored = rows.mapInArrow(run, ddl)
    known = counted.select("part", F.lit(0).alias("kind"), "keys", F.col("counts").alias("values"), *[F.lit(None).cast(k).alias(c) for c, k in _PASS])
    met = known.unionByName(scored).repartition(partitions_for(spark), "part").sortWithinPartitions("part", "kind").mapInArrow(_look_up, ", ".join(f"{c} {k}" for c, k in _PASS))
    return met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("model").alias("score"),
    ).drop("uid")
