"""N-gram Jaccard join over prefix trees.

A document is the set of its word n-grams, as 64-bit numbers whose order is the global
one: rare first, by a sketch of how many documents hold each n-gram; the order decides
how much work there is, never what is linked.  Equal sets are one class.  Two sets of Jaccard similarity t or
more share k of their n - ceil(t n) + k least elements, and are of sizes within a factor
of t.  Sets that share too few such elements with all others leave; what is left is counted
anew, in a finer sketch that only these sets fill, so that what many share comes last again.
Where few sets share such an element they are paired, and a pair must share k of
them; where many do, they are chained from size to size.  Sets joined by these candidate
edges make up blocks, and a set goes to one block only.  In a block, sets are stored in a
trie; each new set walks it once, sharing the overlap counted on common paths, and leaves
a subtree when what remains of both sets cannot reach the overlap that the threshold asks
for, or when all of the subtree is linked to the set already.  A block too large for a
task is linked in parts, dealt twice; only where that leaves it in several components are
its parts compared with each other.  Verified links are the edges of the components that
come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaro.llm._work import Remembered, join_on, may_be_among, settle
from tessaro.llm.components import connected_components

#: Elements are counted in 2 ** SKETCH_BITS cells (4 bytes each), kept as logarithms of one byte: the part that is broadcast.  Each
#: task sends its cells, so a width that grew with the corpus would make that grow with its square.  Cells travel in segments.
SKETCH_BITS, SEGMENT_BITS, CLASS_BITS = 21, 14, 56
#: The same for the sets that can have a partner: elements of a fraction of the corpus, in eight times the cells.
FINE_BITS = 24
#: Sets that share an element are paired up to so many, and chained beyond; a chain counts as this many shared elements.
PAIRED, CHAINED = 4, 1 << 20
#: Elements of the sets that one task compares at once; larger blocks are dealt over pairs of parts.
CELL_ELEMENTS = 1_200_000
MEMO_WORDS = 200_000


_hashes = Remembered(xxhash.xxh3_64_intdigest, MEMO_WORDS)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Distinct n-word shingles of a whole text as sorted 64-bit hashes; A-Z lower-cased, words by ASCII white space.

    A text of fewer words is one shingle; without words, none.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    size = min(n, len(ids))
    mixed = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = mixed * _ODD + ids[k : len(ids) - size + 1 + k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def ordered_set(text: str | None, n: int, levels: np.ndarray) -> np.ndarray:
    """The set in global order: level of the sketch first, then the hash."""
    h = shingle_hashes(text, n)
    level = levels[_cells(h, len(levels).bit_length() - 1)].astype(np.uint64)
    return np.sort((level << np.uint64(CLASS_BITS)) | (h & np.uint64(2**CLASS_BITS - 1)))


#: Two sets must share one prefix element, and one more for every so many of their own.
ELEMENTS_A_SHARED = 16


def prefix_length(size: int, percent: int) -> int:
    """How many least elements of a set of this size share 1 + size // 16 with any partner's, if the partner's prefix is made alike."""
    return min(size, size - (percent * size + 99) // 100 + 1 + size // ELEMENTS_A_SHARED)


# --- the sketch ---------------------------------------------------------------


def _counter(n: int, bits: int):
    width = 2**SEGMENT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(2**bits, np.uint32), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(_cells(shingle_hashes(text.as_py(), n), bits))
                waiting += len(held[-1])
                if waiting > 2_000_000:
                    _add(total, np.concatenate(held))
                    held, waiting = [], 0
        if held:
            _add(total, np.concatenate(held))
        for at in range(0, len(total), 64 * width):
            parts = [(i // width, total[i : i + width]) for i in range(at, min(at + 64 * width, len(total)), width)]
            parts = [(i, _sent(p, bits > SKETCH_BITS)) for i, p in parts if p.any()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["segment", "counts"])

    return count


def _add(total: np.ndarray, cells: np.ndarray) -> None:
    if len(total) <= 2**SKETCH_BITS:
        total += np.bincount(cells, minlength=len(total)).astype(np.uint32)
    else:  # no second table of all cells
        np.add.at(total, cells, np.uint32(1))


def _sent(counts: np.ndarray, sparse: bool) -> bytes:
    """A segment's counts: in one byte where they fit, most of what travels is small; sparse: as pairs of place and count where few are not 0."""
    if counts.max() >= 256:
        return counts.tobytes()
    at = np.flatnonzero(counts)
    if not sparse or 4 * len(at) > len(counts):
        return counts.astype(np.uint8).tobytes()
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.uint8).tobytes()


def _received(raw: pa.Buffer) -> np.ndarray:
    if raw.size == 2**SEGMENT_BITS:
        return np.frombuffer(raw, np.uint8).astype(np.int64)
    if raw.size == 4 * 2**SEGMENT_BITS:
        return np.frombuffer(raw, np.uint32).astype(np.int64)
    n = raw.size // 3  # three bytes a pair: never as many as a power of two
    counts = np.zeros(2**SEGMENT_BITS, np.int64)
    counts[np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw, np.uint8, n, 2 * n)
    return counts


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of segments, one at a time in memory for each that this task was dealt."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = _received(counts.as_buffer())
            sums[segment] = sums[segment] + part if segment in sums else part
    levels = [np.minimum(255, 12 * np.log2(1 + s)).astype(np.uint8).tobytes() for s in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["segment", "levels"])


def frequency_levels(docs: DataFrame, n: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """One byte a cell: how frequent its n-grams are.  2 MB (16 MB of FINE_BITS), whatever the corpus; each segment of the cells is summed on its own."""
    counted = docs.select("text").mapInArrow(_counter(n, bits), "segment int, counts binary")
    summed = counted.repartition("segment").mapInArrow(_adder, "segment int, levels binary").collect()
    levels = np.zeros(2**bits, np.uint8)
    for r in summed:
        levels[r["segment"] << SEGMENT_BITS : (r["segment"] + 1) << SEGMENT_BITS] = np.frombuffer(r["levels"], np.uint8)
    return levels


# --- classes and candidates ---------------------------------------------------


def _signer(n: int, percent: int, levels):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sigs, prefixes = [], [], []
            for text in batch.column(1):
                s = ordered_set(text.as_py(), n, levels.value)
                sizes.append(len(s))
                sigs.append(_signature(s))
                prefixes.append(s[: prefix_length(len(s), percent)].view(np.int64) if len(s) else None)
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "sig", "prefix"])

    return sign


def _signature(s: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).view(np.int64)) if len(s) else None


def _near_sizes(percent: int, tokens: np.ndarray, low: np.ndarray, high: np.ndarray, before: tuple[int, int] = (0, -1)) -> np.ndarray:
    """Whether each row, in order of (token, low), is of a size that the rows before it with its token can be similar to.

    before: token and greatest size of what came earlier.
    """
    group = np.cumsum(np.r_[0, tokens[1:] != tokens[:-1]])
    width = int(high.max()) + 2
    start = before[1] if len(tokens) and tokens[0] == before[0] else -1
    reach = np.maximum.accumulate(np.r_[max(start, -1), high + group * width][: len(high)]) - group * width
    return (reach >= 0) & (100 * reach >= percent * low)


_RUNS = "token long, low long, high long, sig long, near long"
_EDGES = "src long, dst long, shared int, needed int"


def _fold(percent: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(token, low, high, sig, near): a token's sets; of more than PAIRED in one batch, as runs of sizes, with edges within them.

        A token of very many sets leaves a batch as a few runs (high < 0 - low marks them); the
        edges carry a token of their own.
        """
        for batch in batches:
            lists = batch.column(2)
            tokens, counts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            sigs, sizes = np.repeat(batch.column(0).to_numpy(), counts), np.repeat(batch.column(1).to_numpy(), counts)
            if not len(tokens):
                continue
            order = np.lexsort((sizes, tokens))
            tokens, sigs, sizes = tokens[order], sigs[order], sizes[order]
            group = np.cumsum(np.r_[0, tokens[1:] != tokens[:-1]])
            many = np.bincount(group)[group] > PAIRED
            joined = _near_sizes(percent, tokens, sizes, sizes) & many
            first = np.flatnonzero(~joined)
            last = np.r_[first[1:], len(tokens)] - 1
            lead = np.repeat(sigs[first], last - first + 1)
            rest = np.flatnonzero(joined)
            none = np.zeros(len(rest), np.int64)
            high = np.where(many[first], -1 - sizes[last], sizes[last])
            columns = [np.r_[tokens[first], sigs[rest] ^ tokens[rest]], np.r_[sizes[first], none], np.r_[high, none], np.r_[sigs[first], sigs[rest]]]
            near = pa.array(np.r_[np.zeros(len(first), np.int64), lead[rest]], pa.int64(), mask=np.r_[np.ones(len(first), bool), np.zeros(len(rest), bool)])
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], near], ["token", "low", "high", "sig", "near"])

    return fold


def _paired(percent: int, starts: np.ndarray, lengths: np.ndarray, size: np.ndarray, sig: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Edges between the sets of each short group that are of similar sizes."""
    out = []
    for a in range(PAIRED):
        for b in range(a + 1, PAIRED):
            i = starts[lengths > b] + a
            j = i - a + b
            fit = 100 * size[i] >= percent * size[j]  # in order of size: i is the smaller
            i, j = i[fit], j[fit]
            out.append((sig[i], sig[j], np.ones(len(i), np.int64), 1 + size[i] // ELEMENTS_A_SHARED))
    return out


def _edges_of(percent: int):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of rows in order of (token, low): pairs of a short group, a chain of a long one; and the edges passed on."""
        held: list[pa.RecordBatch] = []
        before, previous = None, 0  # the long group that goes on: (token, greatest size), and its last sig
        for last, batch in _marked_last(batches):
            passed = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            drawn, runs = batch.filter(pa.array(passed)), pa.Table.from_batches([*held, batch.filter(pa.array(~passed))]).combine_chunks()
            ends = np.full(drawn.num_rows, CHAINED), np.ones(drawn.num_rows, np.int64)
            out = [(drawn.column(3).to_numpy(), drawn.column(4).to_numpy(), *ends)]
            token, low, high, sig = (runs.column(i).to_numpy() for i in range(4))
            held = []
            if len(token):
                starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                lengths = np.diff(np.r_[starts, len(token)])
                folded = np.add.reduceat(high < 0, starts) > 0
                size = np.where(high < 0, -1 - high, high)
                long = folded | (lengths > PAIRED)
                if before is not None and token[0] == before[0]:
                    long[0] = True
                if not last and not long[-1]:  # a short group may go on in the next batch
                    held = runs.slice(int(starts[-1])).to_batches()
                    starts, lengths, long = starts[:-1], lengths[:-1], long[:-1]
                short = ~long
                out += _paired(percent, starts[short], lengths[short], low, sig)
                at = np.flatnonzero(np.repeat(long, lengths))
                if len(at):
                    t, g = token[at], sig[at]
                    joined = _near_sizes(percent, t, low[at], size[at], before or (0, -1))
                    count = int(joined.sum())
                    out.append((g[joined], np.r_[previous, g[:-1]][joined], np.full(count, CHAINED), np.ones(count, np.int64)))
                    reach = int(size[at][t == t[-1]].max())
                    before = (int(t[-1]), max(reach, before[1]) if before and before[0] == t[-1] else reach)
                    previous = g[-1]
            src, dst, shared, needed = (np.concatenate(x) for x in zip(*out))
            columns = [pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst)), pa.array(shared.astype(np.int32)), pa.array(needed.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["src", "dst", "shared", "needed"])

    return edges


def _marked_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    previous = None
    for batch in batches:
        if batch.num_rows:
            if previous is not None:
                yield False, previous
            previous = batch
    if previous is not None:
        yield True, previous


def _drawn(classes: DataFrame, percent: int) -> DataFrame:
    """(src, dst, shared, needed): an edge for each pair and each step of a chain, once a shared element."""
    rows = classes.select("sig", "size", "prefix").mapInArrow(_fold(percent), _RUNS)
    return rows.repartition("token").sortWithinPartitions("token", "low").mapInArrow(_edges_of(percent), _EDGES)


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of sigs that can be similar: they share as many prefix elements as the smaller asks for, or are steps of a chain.

    If a pair shares an element that many hold, the chain connects it, if only over sets
    of sizes between; if it shares none such, each shared element draws its edge, and
    there are 1 + smaller size // 16 at least.
    """
    drawn = _drawn(classes, percent).groupBy("src", "dst").agg(F.sum(F.col("shared").cast("long")).alias("shared"), F.max("needed").alias("needed"))
    return drawn.where("shared >= needed").select("src", "dst")


def often_shared(classes: DataFrame, percent: int) -> DataFrame:
    """classes whose prefixes share as many elements with others as one partner of the least similar size would ask for, and a few others.

    A partner has percent of this set's size at least, so both prefixes share 1 + that size // 16.  Every
    shared element draws one edge at least at each set that shares it with a set of similar size.
    """
    ends = _drawn(classes, percent).select(F.explode(F.array("src", "dst")).alias("sig"))
    counted = ends.groupBy("sig").agg(F.count("*").alias("shared"))
    needed = 1 + F.floor(F.ceil(F.col("size") * percent / 100) / ELEMENTS_A_SHARED)
    shared = classes.select("sig", "size").join(counted, "sig").where(F.col("shared") >= needed).select("sig")
    return classes.where(may_be_among(F.col("sig"), shared))


# --- the trie -----------------------------------------------------------------


class _Node:
    __slots__ = ("run", "kids", "low", "high", "ends", "one")

    def __init__(self, run: list[int], low: int, high: int):
        self.run, self.kids, self.low, self.high, self.ends = run, {}, low, high, []
        self.one = -1  # a set below here, if all sets below were linked when last looked at


class TrieJoin:
    """Links sets of similarity percent or more, until they are all connected that can be."""

    def __init__(self, percent: int):
        self.percent, self.root = percent, _Node([], 1 << 62, 0)
        self.parent: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, elements: list[int], known: int | None = None) -> int:
        """Links the set to earlier ones, then stores it; returns its number.  known: a set that it is connected with already."""
        me = len(self.parent)
        self.parent.append(me if known is None else self.find(known))
        self._walk(self.root, elements, set(elements), me, 0, 0, 0)
        self._store(elements, me)
        return me

    def _reaches(self, node: _Node, size: int, overlap: int, depth: int, left: int) -> bool:
        """Whether a set below can still have the overlap that its own size asks for."""
        # More elements help until the set has as many left as this one; beyond, they only ask for more.
        best = min(max(depth + left, node.low), node.high)
        return (overlap + min(best - depth, left)) * (100 + self.percent) >= self.percent * (best + size)

    def _spare(self, node: _Node, size: int) -> int:
        """How many elements a set below may have that this one lacks: most for the largest set of a similar size."""
        largest = min(node.high, 100 * size // self.percent)
        return largest - (self.percent * (largest + size) + 99 + self.percent) // (100 + self.percent)

    def _walk(self, node: _Node, s: list[int], members: set, me: int, overlap: int, depth: int, passed: int) -> None:
        """Depth first; passed: how many elements of s are not above the path's last one."""
        stack = [(node, overlap, depth, passed)]
        while stack:
            node, overlap, depth, passed = stack.pop()
            if node.one >= 0 and self.find(node.one) == self.find(me):
                continue
            for other in node.ends:
                if overlap * (100 + self.percent) >= self.percent * (depth + len(s)):
                    a, b = self.find(other), self.find(me)
                    if a != b:
                        self.parent[a] = b
                        self.links.append((other, me))
            near = []
            for kid in node.kids.values():
                run = kid.run
                spare = self._spare(kid, len(s)) - (depth - overlap)
                if spare < 0 or (len(run) > spare and members.isdisjoint(run[: spare + 1])):
                    continue  # its first elements alone are too many that this set lacks
                shared = len(members.intersection(run))
                last = passed + shared if shared == len(run) else _bisect(s, run[-1], passed)
                entry = (kid, overlap + shared, depth + len(run), last)
                if self._reaches(kid, len(s), overlap + shared, depth + len(run), len(s) - last):
                    near.append((shared, entry))
            near.sort(key=lambda x: x[0])
            stack += [e for _, e in near]

    def _store(self, s: list[int], me: int) -> None:
        node, at, path = self.root, 0, []
        while True:
            node.low, node.high = min(node.low, len(s)), max(node.high, len(s))
            path.append(node)
            if at == len(s):
                node.ends.append(me)
                break
            kid = node.kids.get(s[at])
            if kid is None:
                leaf = node.kids[s[at]] = _Node(s[at:], len(s), len(s))
                leaf.ends.append(me)
                path.append(leaf)
                break
            same = 0
            for x, y in zip(kid.run, s[at:]):
                if x != y:
                    break
                same += 1
            if same < len(kid.run):
                top = _Node(kid.run[:same], kid.low, kid.high)
                top.one = kid.one
                kid.run = kid.run[same:]
                top.kids[kid.run[0]] = kid
                node.kids[s[at]] = kid = top
            node, at = kid, at + same
        for node in reversed(path):
            below = [k.one for k in node.kids.values()] + node.ends
            roots = {self.find(i) if i >= 0 else -1 for i in below}
            node.one = below[0] if len(roots) == 1 and -1 not in roots else -1


def _bisect(s: list[int], x: int, low: int) -> int:
    from bisect import bisect_right

    return bisect_right(s, x, low)


def _joiner(n: int, percent: int, levels):
    def link(group: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
        sets, component = {}, {}
        for sig, of, text in group:
            if sig not in sets:
                sets[sig], component[sig] = ordered_set(text, n, levels.value), of
        if len(set(component.values())) < 2:
            return []
        sigs = sorted(sets, key=lambda k: (len(sets[k]), k))
        _, numbers = np.unique(np.concatenate([sets[k] for k in sigs]), return_inverse=True)
        tries, at, seen = TrieJoin(percent), 0, {}
        for k in sigs:
            mine = numbers[at : at + len(sets[k])]
            at += len(mine)
            seen.setdefault(component[k], tries.add(mine.tolist(), seen.get(component[k])))
        return [(sigs[a], sigs[b]) for a, b in tries.links]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["src", "dst"])

        for batch in batches:
            for block, cell, sig, of, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (block, cell) != key:
                    if len(group) > 1:
                        yield out(link(group))
                    key, group = (block, cell), []
                group.append((sig, of, text))
        if len(group) > 1:
            yield out(link(group))

    return join


def _links(docs: DataFrame, members: DataFrame, cells: Column, join) -> DataFrame:
    """Verified links between members of one (block, cell); members has doc_id, text_hash, sig, component, block."""
    texts = join_on(docs, members.select("doc_id", "text_hash", "sig", "component", "block", cells.alias("cells")), ["doc_id", "text_hash"])
    dealt = texts.select("block", F.explode("cells").alias("cell"), "sig", "component", "text").repartition("block", "cell").sortWithinPartitions("block", "cell")
    return dealt.mapInArrow(join, "src long, dst long")


def _all_links(docs: DataFrame, members: DataFrame, join) -> DataFrame:
    """Links that connect whatever can be connected within blocks: members has doc_id, text_hash, sig, size, block."""
    parts = members.groupBy("block").agg(F.ceil(F.sum("size") / CELL_ELEMENTS).alias("parts"))
    members = settle(join_on(members, parts, ["block"]).withColumn("component", F.col("sig")))
    part = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "sig"), "parts")
    # Small blocks are one part; large ones are dealt twice, so that what is alike meets and grows together.
    links = settle(_links(docs, members, F.when(F.col("parts") > 1, F.array(part(0), F.col("parts") + part(1))).otherwise(F.array(part(0))), join))
    large = members.where("parts > 1")
    if large.isEmpty():
        return links
    roots = connected_components(links).withColumnsRenamed({"node": "sig", "root": "of"})
    large = large.join(roots, "sig", "left").withColumn("component", F.coalesce("of", "sig")).drop("of")
    mixed = large.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("block")
    large = settle(large.join(mixed, "block", "left_semi"))
    # What is left in several components: each part meets every part once.
    here = part(0)
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(o, here) * F.col("parts") + F.greatest(o, here))
    return links.union(settle(_links(docs, large, others, join)))


def _one_row_each(read: DataFrame, sets: DataFrame) -> DataFrame:
    """read with one row for each (doc_id, text_hash): only rows of keys that come again are brought together, reduced in each task first."""
    keys = ["doc_id", "text_hash"]
    again = settle(sets.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    if again.isEmpty():
        return read
    several = join_on(read, again.withColumn("again", F.lit(True)), keys, "left")
    one = several.where("again").groupBy(*keys).agg(F.first("text").alias("text"))
    return several.where("again is null").select("doc_id", "text", "text_hash").unionByName(one)


def _signed_anew(read: DataFrame, classes: DataFrame, sign) -> DataFrame:
    """classes with the prefixes that sign gives their texts; the sigs stay what they are."""
    made = read.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, sig long, prefix array<long>").select("doc_id", "text_hash", "prefix")
    return join_on(classes, made, ["doc_id", "text_hash"]).groupBy("sig").agg(*[F.first(c).alias(c) for c in ("doc_id", "text_hash", "size", "prefix")])


def _placed_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, sig and component (the sig that leads it), both null for empty sets."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, n))
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sets = settle(read.mapInArrow(_signer(n, percent, levels), "doc_id long, text_hash long, n_shingles long, sig long, prefix array<long>"))
    filled = sets.where("sig is not null")
    # Most sets stand alone: they are classes as they are, and their prefixes do not travel.
    several = may_be_among(F.col("sig"), filled.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig"))
    classes = filled.where(several).groupBy("sig").agg(F.min(F.struct("doc_id", "text_hash")).alias("holder"), F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"))
    alone = filled.where(~several).select("sig", "doc_id", "text_hash", F.col("n_shingles").alias("size"), "prefix")
    classes = settle(classes.select("sig", "holder.doc_id", "holder.text_hash", "size", "prefix").union(alone))
    # Only texts of sets that can have a partner are read from here on, and only those of sets that are in a block travel.
    row = F.xxhash64("doc_id", "text_hash")
    among = lambda few: may_be_among(row, few.select(row))
    some = settle(often_shared(classes, percent).drop("prefix"))
    wanted = settle(read.where(among(some)))
    fine = docs.sparkSession.sparkContext.broadcast(frequency_levels(wanted, n, FINE_BITS))
    some = settle(often_shared(settle(_signed_anew(wanted, some, _signer(n, percent, fine))), percent))
    # Edges run from size to size: they are drawn anew among the sets that can have a partner.
    blocks = connected_components(candidate_edges(some, percent))
    members = settle(blocks.join(some, blocks["node"] == F.col("sig")).select("sig", "doc_id", "text_hash", "size", F.col("root").alias("block")))
    links = settle(_all_links(_one_row_each(wanted.where(among(members)), sets), members, _joiner(n, percent, fine)))
    roots = connected_components(links).withColumnsRenamed({"node": "sig", "root": "component"})
    joined = filled.drop("prefix").join(roots, "sig", "left")
    columns = ["doc_id", "text_hash", "n_shingles", "sig"]
    # Empty sets have no sig: they go around the join.
    none = sets.where("sig is null").select(*columns, F.lit(None).cast("long").alias("component"))
    return joined.select(*columns, F.coalesce("component", "sig").alias("component")).union(none)


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that links reach).

    Sets link at 100 * intersection >= percent * union.  Texts that are null, empty or
    white space have the empty set, which links with nothing: component_id is their own
    id.  Equal sets are linked.  A null doc_id is never the least; a component of null
    ids only has a null component_id.  Repeated rows come back repeated.  Only doc_id
    and text are read; no rows in, none out.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = settle(_placed_rows(docs, n, percent))
    placed = rows.where("component is not null")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    none = rows.where("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.join(least, "component").select("doc_id", "n_shingles", "component_id").union(none)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group, that of its least doc_id (null last; then by a hash of the text).

    Texts without words are in no group.  Rows alike in id and text become one, that of
    the least hash of all columns.  All columns of the kept rows are kept.
    """
    rows = settle(_placed_rows(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), n, percent))
    keys = settle(rows.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")
    groups = keys.where("component is not null").groupBy("component").agg(F.min(key).alias("k"), F.count("*").alias("keys"))
    kept = settle(groups.select("component", "k.doc_id", "k.text_hash", "k.n", "keys").union(keys.where("component is null").withColumn("keys", F.lit(1).cast("long"))))
    # A key that is kept and held by one row stays where it is; only rows of other keys travel.
    hashed = F.xxhash64("doc_id", "text_hash").alias("number")
    several = kept.where("keys > 1")
    others = keys.where("component is not null").where(may_be_among(F.col("component"), several.select("component")))
    others = join_on(others, several.select("component", "doc_id", "text_hash", F.lit(True).alias("is_kept")), ["component", "doc_id", "text_hash"], "left")
    number = F.xxhash64(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))
    travels = may_be_among(number, others.where("is_kept is null").select(hashed).union(kept.where("n > 1").select(hashed)))
    whole = docs.where(travels).select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    first = F.min_by("row", F.xxhash64(F.to_json("row")))
    several = join_on(whole, kept.select("doc_id", "text_hash"), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(first.alias("row"))
    return docs.where(~travels).union(several.select("row.*"))
