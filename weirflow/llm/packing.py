"""Best-fit packing by a grouping genetic algorithm on islands.

A solution is a list of bins, each a group of pieces. Crossover injects whole
well-filled bins of one parent into another, removes the bins that hold one of
their pieces already, and best-fits the displaced pieces, largest first;
mutation dissolves some of the emptiest bins in the same way. Pieces as long as
a sequence fill one alone and take no part.

Pieces are dealt at random to blocks of about ``block`` pieces. Several islands
evolve each block, from best fit in different orders, and after every epoch an
island's elite moves to the next island of the ring. A block stops as soon as it
has as many bins as its total length or its pieces above half a sequence need at
least. The worst-filled bins of all blocks are then opened and their pieces
packed again in the same way, in ever fewer blocks, until one block is left; so
the rest that each block leaves does not add up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .chunked_bpe import HELD, WordEncoder
from .common import frugal, partitions_for, stored, text_rows

_encoders: dict[tuple[str, int], WordEncoder] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, word_end: str = "</w>", id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """One row for each piece of each document's ids and end mark: doc_id, piece, start, length, ids_crc32.

    ``path`` names a tokenizers file that drops white space and marks words' ends;
    the ids are those of its ``encode(text, add_special_tokens=False)``. Documents longer than ``capacity`` are cut into pieces of that length, the
    last one shorter. A null text is empty and has the end mark alone. A worker
    keeps the ids of about ``held`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((path, held)) or _encoders.setdefault((path, held), WordEncoder(Tokenizer.from_file(path), word_end, held))
        end, size = int(end_id).to_bytes(4, "little"), 4 * capacity
        for whole in batches:
            for at in range(0, whole.num_rows, 2500):
                batch = whole.slice(at, 2500)
                doc, piece, start, length, crc = [], [], [], [], []
                got, cuts = encoder.encode_batch(batch.column(1))
                raw = got.astype("<u4").tobytes()
                for d, a, b in zip(batch.column(0).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    ids = raw[4 * a : 4 * b] + end
                    for k, i in enumerate(range(0, len(ids), size)):
                        part = ids[i : i + size]
                        doc.append(d)
                        piece.append(k)
                        start.append(i // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return text_rows(docs, id_col, text_col).mapInArrow(frugal(None, run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Groups:
    """Bins of one solution with a best-fit index: for each amount of free room the bins that have it."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.held = 0  # bit r: some bin has room r
        self.next = 0

    def copy(self) -> Groups:
        out = Groups(self.sizes, self.capacity)
        for items in self.bins.values():
            out.insert(list(items))
        return out

    def insert(self, items: list[int]) -> int:
        b, self.next = self.next, self.next + 1
        self.bins[b] = items
        self._place(b, self.capacity - int(sum(self.sizes[i] for i in items)))
        return b

    def _place(self, b: int, room: int) -> None:
        self.room[b] = room
        self.by_room[room].add(b)
        self.held |= 1 << room

    def _unplace(self, b: int) -> None:
        room = self.room.pop(b)
        self.by_room[room].discard(b)
        if not self.by_room[room]:
            self.held &= ~(1 << room)

    def remove(self, b: int) -> list[int]:
        self._unplace(b)
        return self.bins.pop(b)

    def best_fit(self, items: list[int]) -> None:
        """Each item into the bin with the least sufficient room, a new one if there is none."""
        for i in items:
            s = int(self.sizes[i])
            fits = self.held >> s
            if fits:
                room = s + (fits & -fits).bit_length() - 1
                b = min(self.by_room[room])
                self._unplace(b)
                self.bins[b].append(i)
                self._place(b, room - s)
            else:
                self.insert([i])

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.bins), sum((1 - r / self.capacity) ** 2 for r in self.room.values())


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


def crossover(a: Groups, b: Groups, rng: np.random.Generator) -> Groups:
    child = a.copy()
    full = sorted(b.bins, key=lambda k: b.room[k])
    top = full[: max(1, len(full) // 2)]
    take = [top[i] for i in rng.permutation(len(top))[: max(1, len(top) // 4)]]
    injected = {i for k in take for i in b.bins[k]}
    displaced = []
    for k in [k for k, items in child.bins.items() if not injected.isdisjoint(items)]:
        displaced += [i for i in child.remove(k) if i not in injected]
    for k in take:
        child.insert(list(b.bins[k]))
    child.best_fit(sorted(displaced, key=lambda i: (-child.sizes[i], i)))
    return child


def mutate(g: Groups, rng: np.random.Generator) -> None:
    worst = sorted(g.bins, key=lambda k: -g.room[k])[: max(2, len(g.bins) // 50)]
    some = list(g.bins)
    chosen = {*worst, *(some[i] for i in rng.integers(0, len(some), max(1, len(some) // 100)))}
    loose = [i for k in chosen for i in g.remove(k)]
    g.best_fit(sorted(loose, key=lambda i: (-g.sizes[i], rng.random())))


def evolve(sizes: np.ndarray, capacity: int, migrants: list[list[list[int]]], seed: int, population: int = 4, generations: int = 6) -> Groups:
    """One epoch of one island; ``migrants`` are solutions to start from."""
    rng = np.random.default_rng(seed)
    least = least_bins(sizes, capacity)
    people: list[Groups] = []
    for bins in migrants:
        g = Groups(sizes, capacity)
        for items in bins:
            g.insert(list(items))
        people.append(g)
    while len(people) < population:
        if people and max(p.fitness() for p in people)[0] == -least:
            break
        spread = 0.0 if not people else 0.02 * len(people)
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i] * (1 + spread * rng.random()), i))
        g = Groups(sizes, capacity)
        g.best_fit(order)
        people.append(g)
    for _ in range(generations):
        people.sort(key=Groups.fitness, reverse=True)
        if len(people[0].bins) == least or len(people) < 2:
            break
        a, b = people[0], people[int(rng.integers(1, len(people)))]
        for child in (crossover(a, b, rng), crossover(b, a, rng)):
            mutate(child, rng)
            people.append(child)
        people.sort(key=Groups.fitness, reverse=True)
        del people[population:]
    return max(people, key=Groups.fitness)


def _assigned(g: Groups, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(sorted(g.bins, key=lambda k: min(g.bins[k]))):
        out[g.bins[b]] = k
    return out


def _as_bins(assigned: np.ndarray) -> list[list[int]]:
    order = np.argsort(assigned, kind="stable")
    cuts = np.flatnonzero(np.diff(assigned[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(order) else []


_BLOCK = "block long, sizes binary, items binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of block, largest first, to a row for each block."""
    key, sizes, items = None, [], []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.concatenate(sizes).tobytes()], pa.binary()), pa.array([np.concatenate(items).tobytes()], pa.binary())], names=["block", "sizes", "items"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if blocks[a] != key:
                if sizes:
                    yield row()
                key, sizes, items = blocks[a], [], []
            sizes.append(batch.column("length").to_numpy()[a:b].astype(np.int32))
            items.append(batch.column("item").to_numpy()[a:b].astype(np.int64))
    if sizes:
        yield row()


def _epoch(capacity: int, epoch: int, population: int, generations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, island, sizes, elite, migrant in zip(*(batch.column(c).to_pylist() for c in ("block", "island", "sizes", "elite", "migrant"))):
                size = np.frombuffer(sizes, np.int32)
                start = [_as_bins(np.frombuffer(x, np.int32)) for x in (elite, migrant) if x is not None]
                best = evolve(size, capacity, start, hash((block, island, epoch)) & 0xFFFFFFFF, population, generations)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([island], pa.int32()), pa.array([_assigned(best, len(size)).tobytes()], pa.binary()), pa.array([len(best.bins) - least_bins(size, capacity)], pa.int32())], names=["block", "island", "elite", "over"]
                )

    return run


def _spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, sizes, items, elite in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "items", "elite"))):
            assigned, size = np.frombuffer(elite, np.int32), np.frombuffer(sizes, np.int32).astype(np.int64)
            order = np.argsort(assigned, kind="stable")
            bins, length = assigned[order], size[order]
            total = np.bincount(bins, weights=length).astype(np.int64)
            before = np.cumsum(length) - length
            offset = before - np.r_[0, np.cumsum(total)[:-1]][bins]
            n = len(order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(items, np.int64)[order]), pa.array(length), pa.array(np.full(n, block, np.int64)), pa.array(bins.astype(np.int64)), pa.array(offset), pa.array(total[bins])], names=["item", "length", "block", "bin", "offset", "filled"]
            )


def _pack_level(items: DataFrame, capacity: int, blocks: int, islands: int, epochs: int, population: int, generations: int, salt: int) -> DataFrame:
    """(item, length) to (item, length, block, bin, offset, filled), one block at a time."""
    spark = items.sparkSession
    parts = partitions_for(spark)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(blocks)))
    rows = stored(
        dealt.repartition(min(parts, blocks), "block").sortWithinPartitions("block", F.desc("length"), "item").select("block", "length", "item").mapInArrow(_gather, _BLOCK), "blocks"
    )
    state = rows.select("block", "sizes").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = state.select("block", F.col("island").cast("int"), "sizes", F.lit(None).cast("binary").alias("elite"), F.lit(None).cast("binary").alias("migrant"))
    finished: list[DataFrame] = []
    for epoch in range(epochs):
        elites = stored(state.repartition(min(parts, blocks * islands), "block", "island").mapInArrow(frugal(None, _epoch(capacity, epoch, population, generations)), "block long, island int, elite binary, over int"), "elites")
        settled = elites.groupBy("block").agg(F.min("over").alias("least")).withColumn("open", F.col("least") > 0)
        now = elites.join(settled.select("block", "open"), "block")
        last = epoch + 1 == epochs or settled.where("open").isEmpty()
        finished.append(elites if last else now.where("not open").drop("open"))
        if last:
            break
        open_ones = now.where("open")
        moved = open_ones.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("migrant"))
        state = open_ones.select("block", "island", "elite").join(moved, ["block", "island"]).join(rows.select("block", "sizes"), "block").select("block", "island", "sizes", "elite", "migrant")
    result = finished[0]
    for f in finished[1:]:
        result = result.unionByName(f)
    chosen = result.groupBy("block").agg(F.min_by("elite", F.struct("over", "island")).alias("elite"))
    return rows.join(chosen, "block").mapInArrow(_spread_out, "item long, length long, block long, bin long, offset long, filled long")


def pack(pieces: DataFrame, capacity: int, block: int = 4096, islands: int = 2, epochs: int = 3, population: int = 4, generations: int = 6, open_below: float = 0.97, least_gain: float = 0.5) -> DataFrame:
    """(item, length) to (item, sequence_id, offset): sequences of at most ``capacity``, without gaps.

    ``item`` is a unique long and lengths are 1 to ``capacity``; empty input
    gives empty output. After each level, sequences filled to ``open_below`` of the
    capacity stay; the others are opened and packed again at the next level. Where
    opening them leaves more than 1 - ``least_gain`` of a level's items, pieces are
    so few to a sequence that another order of them gains nothing, and sequences
    stay as they are: what that may cost is the room left in them, below
    1 - ``open_below`` of the sequences' total elsewhere.
    """
    full = pieces.where(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, out, level = pieces.where(F.col("length") < capacity).select("item", "length"), [full], 0
    count = left.count()
    while count:
        blocks = -(-count // block)
        packed = stored(_pack_level(left, capacity, blocks, islands, epochs, population, generations, level), "packed")
        # sequences take the id of their first item: unique over levels, as an item is packed once
        named = packed.join(packed.where("offset = 0").select("block", "bin", F.col("item").alias("sequence_id")), ["block", "bin"])
        if blocks == 1:
            out.append(named.select("item", "sequence_id", "offset"))
            break
        # the emptiest bins of each block, about as many as it has above the least
        loose = F.col("filled") < open_below * capacity
        out.append(named.where(~loose).select("item", "sequence_id", "offset"))
        left = packed.where(loose).select("item", "length")
        before, count, level = count, left.count(), level + 1
        if count > (1 - least_gain) * before:
            out.append(named.where(loose).select("item", "sequence_id", "offset"))
            break
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, held: int = HELD, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each document.

    See ``token_pieces`` for the pieces and ``pack`` for the sequences. Rows that
    repeat an id are packed each; a null id stays null. An empty table gives an
    empty result.
    """
    pieces = stored(token_pieces(docs, path, capacity, held=held).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("item", "length"), capacity, **how)
    return pieces.join(placed, "item").drop("item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
