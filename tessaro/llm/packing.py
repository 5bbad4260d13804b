"""Best-fit packing of tokenized documents by a grouping genetic algorithm.

Texts are tokenized where they are read and only lengths travel on.  Pieces are dealt
into blocks of bounded size; each block is packed by several islands, every one a
Spark row that evolves a small population.  The first population puts the pieces, in
random orders, where they fit best.  Every generation crosses two of them: whole
well-filled sequences of one parent are injected into the other, sequences that now hold
a piece twice are dropped, and what they held besides is best-fitted.  After an epoch
each island's elite goes to the next island of its block.  The best island's plan is then
applied to the block's pieces; ``born`` tells in which generation a sequence was filled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaro.llm._work import Remembered, settle

CAPACITY, END_ID = 4096, 1
#: Pieces of a block, islands of a block, and how long they evolve: every generation is run.
BLOCK_PIECES, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 12_000, 3, 2, 8, 4
#: Islands that one task evolves at most.
TASK_ISLANDS = 500
#: Words whose ids a worker keeps, twice over.
MEMO_WORDS = 250_000
#: Trailing characters that the tokenizer always splits from letters before them; no apostrophe, which it may join.
_TAIL = b"#$%&*!.,|;:?()\""


class _Ids:
    """word (bytes without white space) -> its ids as little-endian 32-bit numbers.

    The tokenizer drops white space and never joins ids across it, so a text's ids are
    those of its words in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.words, self.tails = Remembered(self.word, MEMO_WORDS), Remembered(self.encode, 10_000)

    def word(self, word: bytes) -> bytes:
        core = word.lower().rstrip(_TAIL)
        if not (core.isascii() and core.isalpha()):
            return self.encode(word)
        ids = np.array([t.id for t in self.full.model.tokenize(core.decode())], "<u4").tobytes()
        tail = word[len(core) :]
        return ids + self.tails[tail] if tail else ids

    def encode(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def token_bytes(text: str | None, ids: _Ids) -> bytes:
    """All ids of a text and the end id, four bytes each; null counts as empty."""
    # White space of ASCII ends words here; the tokenizer treats it, and all other white space, as a gap.
    raw = (text or "").encode("utf-8", "replace")
    if b"<|" not in raw:  # a special token's name must be met as it is written; all else is lower-cased anyway
        raw = raw.lower()
    return b"".join(map(ids.words.__getitem__, raw.split())) + END_ID.to_bytes(4, "little")


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def _cutter(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, met = _ids(path), Counter()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = token_bytes(text.as_py(), ids)
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    crc = zlib.crc32(part)
                    name = (doc_id, piece, crc)
                    # Repeated rows are dealt apart; only they depend on how rows lie in tasks, and they are interchangeable.
                    deal = zlib.crc32(f"{doc_id} {piece} {crc} {met[name]}".encode())
                    met[name] += 1
                    rows.append((doc_id, piece, at // 4, len(part) // 4, crc, deal))
            if len(met) > MEMO_WORDS:
                met.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut


class _Plan:
    """Where each piece of a block goes: bins from 0, none empty, with the generation in which each was filled."""

    def __init__(self, bins: np.ndarray, born: np.ndarray, lengths: np.ndarray, capacity: int):
        self.bins, self.born = bins, born
        self.fill = np.bincount(bins, weights=lengths, minlength=len(born)).astype(np.int64)
        self.count = len(born)
        self.score = (-self.count, float(np.square(self.fill / capacity).sum()))


def best_fit(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, fill: list[int], capacity: int) -> None:
    """Puts the pieces of order, one by one, where they leave least room, or into a new bin; updates bins and fill."""
    rooms: dict[int, list[int]] = {}
    mask = 0  # bit r: some bin has exactly r tokens of room
    for b, f in enumerate(fill):
        if 0 < f < capacity:
            rooms.setdefault(capacity - f, []).append(b)
            mask |= 1 << (capacity - f)
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            held = rooms[room]
            b = held.pop()
            if not held:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i] = b
        fill[b] += n
        if room > n:
            rooms.setdefault(room - n, []).append(b)
            mask |= 1 << (room - n)


def fitted(order: np.ndarray, lengths: np.ndarray, capacity: int) -> _Plan:
    """Best fit of all pieces in this order."""
    bins, fill = np.zeros(len(lengths), np.int64), []
    best_fit(order, lengths, bins, fill, capacity)
    return _Plan(bins, np.zeros(len(fill), np.int64), lengths, capacity)


def crossover(a: _Plan, b: _Plan, lengths: np.ndarray, capacity: int, rng: np.random.Generator, generation: int) -> _Plan:
    """a with some of b's best-filled bins in place of those that share a piece with them."""
    well = np.flatnonzero(b.fill >= np.quantile(b.fill, 0.5))
    chosen = rng.choice(well, max(1, len(well) // 20), replace=False)
    injected = np.isin(b.bins, chosen)
    doubled = np.zeros(a.count, bool)
    doubled[a.bins[injected]] = True
    # The emptiest bins are opened too: only what they hold can fill others up.
    doubled[np.argsort(a.fill, kind="stable")[: 1 + a.count // 6]] = True
    displaced = np.flatnonzero(doubled[a.bins] & ~injected)
    bins = np.where(injected, a.count + b.bins, a.bins)
    keep = np.ones(len(bins), bool)
    keep[displaced] = False
    names, dense = np.unique(bins[keep], return_inverse=True)
    placed = np.zeros(len(bins), np.int64)
    placed[keep] = dense
    fill = np.bincount(dense, weights=lengths[keep], minlength=len(names)).astype(np.int64).tolist()
    best_fit(displaced[np.argsort(-lengths[displaced], kind="stable")], lengths, placed, fill, capacity)
    born = np.full(len(fill), generation, np.int64)
    born[: len(names)] = np.concatenate([a.born, b.born])[names]
    born[placed[displaced]] = generation
    return _Plan(placed, born, lengths, capacity)


def evolve(lengths: np.ndarray, island: int, elites: list[_Plan], capacity: int, epoch: int, seed: int) -> _Plan:
    """One epoch of an island: the best of its offspring and elites.

    lengths are in decreasing order.  Where the elites that came in still need more bins
    than best fit decreasing, that plan immigrates and takes part in the crossovers.
    """
    rng = np.random.default_rng([seed, epoch, island])
    people = list(elites) or [fitted(rng.permutation(len(lengths)), lengths, capacity) for _ in range(POPULATION)]
    if elites and max(elites, key=lambda p: p.score).count > -(-int(lengths.sum()) // capacity):
        greedy = fitted(np.arange(len(lengths)), lengths, capacity)
        if greedy.count < min(p.count for p in people):
            people.append(greedy)
    for generation in range(epoch * GENERATIONS + 1, (epoch + 1) * GENERATIONS + 1):
        people.sort(key=lambda p: p.score, reverse=True)
        i, j = rng.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
        people.append(crossover(people[min(i, j)], people[max(i, j)], lengths, capacity, rng, generation))
        people = sorted(people, key=lambda p: p.score, reverse=True)[:POPULATION]
    return people[0]


_ISLAND = "block long, island int, lengths binary, plan binary, born binary, bins long, score double"


def _evolver(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<i4").astype(np.int64)
                plan = lambda a, b: _Plan(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(b, "<i4").astype(np.int64), lengths, capacity)  # noqa: E731, B023
                elites = [plan(r[p], r[b]) for p, b in (("plan", "born"), ("guest", "guest_born")) if r.get(p) is not None]
                best = evolve(lengths, r["island"], elites, capacity, epoch, seed=r["block"])
                raw = [x.astype("<i4").tobytes() for x in (best.bins, best.born)]
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "island": r["island"], "lengths": r["lengths"], "plan": raw[0], "born": raw[1], "bins": best.count, "score": best.score[1]}], _ISLAND_ARROW)

    return run


_ISLAND_ARROW = pa.schema(
    [("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("plan", pa.binary()), ("born", pa.binary()), ("bins", pa.int64()), ("score", pa.float64())]
)


def _block_lengths(key: tuple, pieces: pa.Table) -> pa.Table:
    """A block's lengths in decreasing order, as one row."""
    lengths = np.sort(pieces.column("length").to_numpy())[::-1].astype("<i4")
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "lengths": pa.array([lengths.tobytes()], pa.binary())})


def _applier(capacity: int):
    def apply(key: tuple, pieces: pa.Table, plans: pa.Table) -> pa.Table:
        """The block's pieces with sequence, offset and generation; full pieces get sequences of their own."""
        # Decreasing lengths, as _block_lengths has them; the rest of the order makes reruns agree.
        doc_id = pieces.column("doc_id")
        ids = (doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy())
        order = np.lexsort((pieces.column("ids_crc32").to_numpy(), pieces.column("piece").to_numpy(), *ids, -pieces.column("length").to_numpy()))
        lengths = pieces.column("length").to_numpy()[order]
        plan, born = (np.frombuffer(plans.column(c)[0].as_py(), "<i4").astype(np.int64) if plans.num_rows else np.zeros(0, np.int64) for c in ("plan", "born"))
        by_bin = np.argsort(plan, kind="stable")
        run = np.cumsum(lengths[by_bin]) - lengths[by_bin]
        first = np.r_[True, np.diff(plan[by_bin]) != 0]
        start = np.maximum.accumulate(np.where(first, run, 0))
        offset = np.zeros(len(plan), np.int64)
        offset[by_bin] = run - start
        out = pieces.take(pa.array(order)).select(["doc_id", "piece", "start", "length", "ids_crc32"])
        made = pa.array(born[plan].astype(np.int32))
        for name, values in (("sequence_id", pa.array(key[0].as_py() * 2**32 + plan)), ("offset", pa.array(offset)), ("born", made)):
            out = out.append_column(name, values)
        return out

    return apply


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, born.

    Null and empty texts are the end id alone.  Only documents longer than
    ``capacity`` are cut.  Null ids and repeated rows are documents like others.
    born: the generation that filled the sequence, 0 for the first population, null
    for a piece that fills one alone.  Only doc_id and text are read; no rows in, none out.
    """
    cut = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    pieces = settle(cut.mapInArrow(_cutter(tokenizer or tokenizer_path(), capacity), _PIECES))
    short = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // BLOCK_PIECES))
    dealt = short.withColumn("block", F.pmod("deal", F.lit(blocks)))
    lengths = dealt.groupBy("block").applyInArrow(_block_lengths, "block long, lengths binary")
    islands = lengths.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    # One row is one island: they are few and long, so their tasks are counted out, and stay as many.
    tasks = min(blocks * ISLANDS, max(8 * docs.sparkSession.sparkContext.defaultParallelism, blocks * ISLANDS // TASK_ISLANDS))
    deal = lambda df: df.repartition(tasks, "block", "island")
    islands = settle(deal(islands.select("block", "island", "lengths")).mapInArrow(_evolver(capacity, 0), _ISLAND))
    for epoch in range(1, EPOCHS):
        ring = Window.partitionBy("block").orderBy("island")
        whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        elite = F.struct("plan", "born")
        guests = islands.withColumn("guest", F.coalesce(F.lead(elite).over(ring), F.first(elite).over(whole)))
        guests = deal(guests.select("block", "island", "lengths", "plan", "born", F.col("guest.plan").alias("guest"), F.col("guest.born").alias("guest_born")))
        islands = settle(guests.mapInArrow(_evolver(capacity, epoch), _ISLAND))
    best = islands.groupBy("block").agg(F.min_by(F.struct("plan", "born"), F.struct("bins", -F.col("score"), "island")).alias("best")).select("block", "best.*")
    packed = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, born int"
    shared = dealt.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_applier(capacity), packed)
    # A piece that fills a sequence needs no plan and meets no others; sequences of this kind have negative numbers.
    full = pieces.where(F.col("length") >= capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("int").alias("born")
    )
    return shared.union(full)
