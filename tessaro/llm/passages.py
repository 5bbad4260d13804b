"""Line dedup: winnowed fingerprints find repeated runs of words, wherever in a line they begin or end.

A window is ``min_words`` words; the gram of least hash inside it, the leftmost of equal
ones, is its fingerprint.  Only these minima are kept, each with the stretch of text that
it speaks for: the windows in a row that select it.  Equal windows have equal
fingerprints, so positions are joined on them.  Stretches whose fingerprint occurs again
are extended as a whole, one row for all their windows: what repeats an earlier stretch is
cut.  Where a fingerprint stands in different stretches, a run begins or ends inside: of
each of them the first occurrence is extended window by window.  What has occurred before
makes up the cuts.  All steps are aggregations and equi joins on hashes: work
grows with the words, never with the pairs of a passage's occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm._work import bitmap, in_bitmap, join_on, may_be_among, settle

MIN_WORDS = 50
#: Bytes of texts, and of words, that are hashed at once.
GROUP, SEGMENT = 2**20, 2**17
#: For how many repeated fingerprints or texts with cuts a bitmap is used: beyond, they are joined to the texts.
BITMAP_MOST = 2**24
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n or more powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, x in enumerate((_BASE, _BACK)):
            _POWERS[i] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(2 * n, x, np.uint64))])
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


#: A random number for each byte, and which bytes part words.
_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) * np.uint64(_BASE))
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _minima(h: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` values in a row, where the least stands; its first 32 bits tell, and of equal ones the leftmost."""
    key = (h & ~np.uint64(2**32 - 1)) | np.arange(len(h), dtype=np.uint64)
    n, done = len(h) - width + 1, 1
    while 2 * done <= width:
        key, done = np.minimum(key[:-done], key[done:]), 2 * done
    return (np.minimum(key[:n], key[width - done : width - done + n]) & np.uint64(2**32 - 1)).astype(np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one behind the other in data, and how many each text has.

    A word's hash is a sum over its bytes, so that all words of a stretch of texts are
    hashed at once; a word longer than a segment is hashed by itself.
    """
    space = _SPACE[data]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins, ends = np.r_[True, space[:-1]][: len(data)], np.r_[space[1:], True][: len(data)]
    begins[cut], ends[cut - 1] = True, True
    starts, stops = np.flatnonzero(begins & ~space), np.flatnonzero(ends & ~space) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + SEGMENT, "right")))
        low, high = int(starts[at]), int(stops[to - 1])
        if high - low > SEGMENT:
            out[at] = xxhash.xxh3_64_intdigest(data[low:high].tobytes())
        else:
            forth, back = _powers(SEGMENT + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data[low:high]] * forth[: high - low], dtype=np.uint64)])
            first, last = starts[at:to] - low, stops[at:to] - low
            out[at:to] = _mixed((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64) * _LENGTH)
        at = to
    return out, np.diff(np.searchsorted(starts, offsets))


class Stretches:
    """Fingerprints of some texts' words (``one``: their hashes, ``counts`` of them a text).

    row: the text that each is of; first to last: the windows that select it, as places in
    the text; at: first among all the words; hashes of windows (by place among all the
    words) and of stretches.
    """

    def __init__(self, one: np.ndarray, counts: np.ndarray, min_words: int):
        n = len(one)
        forth, back = _powers(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * forth[:n], dtype=np.uint64)])
        of = lambda k: _mixed((total[k:] - total[:-k]) * back[: n - k + 1])
        short = max(1, 2 * min_words // 5)
        grams = of(short)
        self.windows = of(min_words)
        places = _minima(grams, min_words - short + 1)
        end = np.cumsum(counts)
        # Windows that lie in one text.
        whole = np.flatnonzero(np.repeat(end, counts)[: n - min_words + 1] >= np.arange(min_words, n + 1))
        places = places[whole]
        new = np.flatnonzero(np.r_[True, places[1:] != places[:-1]][: len(places)])
        self.at = whole[new]
        last = whole[np.r_[new[1:], len(places)] - 1] if len(new) else self.at
        self.row = np.searchsorted(end, self.at, "right")
        begin = (end - counts)[self.row]
        self.first, self.last = self.at - begin, last - begin
        self.fingerprints = grams[places[new]]
        long = last - self.at + min_words
        self.wholes = (total[self.at + long] - total[self.at]) * back[self.at]
        self.wholes = _mixed(self.wholes + long.astype(np.uint64) * _LENGTH)
        self._set_apart(min_words)

    def _set_apart(self, min_words: int) -> None:
        """Stretches that overlap an equal one before them get a hash of their own: their windows are to be told one by one."""
        order = np.lexsort((self.at, self.wholes))
        before, after = order[:-1], order[1:]
        near = (self.wholes[before] == self.wholes[after]) & (self.row[before] == self.row[after]) & (self.at[after] - self.at[before] < min_words)
        apart = after[near]
        self.wholes[apart] = _mixed(self.wholes[apart] + (self.first[apart] + 1).astype(np.uint64))


def _texts(batch: pa.RecordBatch, min_words: int) -> Iterator[tuple[int, int, Stretches]]:
    """(first row, rows, stretches) of texts that are GROUP bytes together, or one longer text; some have too few words for any."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + GROUP, "right")) - 1)
        one, counts = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        if len(one) >= min_words and counts.max() >= min_words:
            yield low, high - low, Stretches(one, counts, min_words)
        low = high


def _winnow(min_words: int, owned: bool):
    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(fingerprint, whole) of every selected minimum; owned: with its text instead of whole."""
        for batch in batches:
            for low, _, s in _texts(batch, min_words):
                columns = [pa.array(s.fingerprints.view(np.int64))]
                if owned:
                    names = _owner(batch)
                    yield pa.RecordBatch.from_arrays(columns + [batch.column(c).take(pa.array(low + s.row)) for c in names], ["fingerprint", *names])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(s.wholes.view(np.int64))], ["fingerprint", "whole"])

    return winnow


def _owner(batch: pa.RecordBatch) -> list[str]:
    """The columns that tell whose a text is."""
    return [c for c in ("doc_id", "text_hash") if c in batch.schema.names]


def _given(batch: pa.RecordBatch, parts: Iterator[tuple[int, Stretches, np.ndarray, np.ndarray]], min_words: int) -> Iterator[pa.RecordBatch]:
    """The stretches whose fingerprint occurs again; with the hashes of their windows where it stands in different ones."""
    names = _owner(batch)
    for low, s, again, apart in parts:
        kept = np.flatnonzero(again)
        count = np.where(apart[kept], s.last[kept] - s.first[kept] + 1, 0)
        each = np.repeat(s.at[kept] - np.cumsum(count) + count, count) + np.arange(count.sum())
        owner = [batch.column(c).take(pa.array(low + s.row[kept])) for c in names]
        places = [pa.array(x.astype(np.int32)) for x in (s.first[kept], s.last[kept] + min_words)]
        # A stretch without windows has the place of none in the list.
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(s.windows[each].view(np.int64)), mask=pa.array(count == 0))
        yield pa.RecordBatch.from_arrays([pa.array(s.wholes[kept].view(np.int64)), *owner, *places, lists], ["whole", *names, "start", "end", "windows"])


def _by_bitmap(min_words: int, again: np.ndarray, apart: np.ndarray):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _given(batch, ((low, s, in_bitmap(again, s.fingerprints), in_bitmap(apart, s.fingerprints)) for low, _, s in _texts(batch, min_words)), min_words)

    return segments


def _listed(column: pa.ListArray, s: Stretches) -> np.ndarray:
    """Whether each fingerprint is in the list of its text."""
    lists, rows = column.flatten().to_numpy(), np.repeat(np.arange(len(column)), pc.fill_null(column.value_lengths(), 0).to_numpy())
    known, number = np.unique(np.concatenate([s.fingerprints.view(np.int64), lists]), return_inverse=True)
    key = np.concatenate([s.row, rows]) * len(known) + number
    return np.isin(key[: len(s.row)], key[len(s.row) :])


def _by_list(min_words: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = ((low, s, *(_listed(batch.column(c).slice(low, rows), s) for c in ("again", "apart"))) for low, rows, s in _texts(batch, min_words))
            yield from _given(batch, parts, min_words)

    return segments


def _segments(read: DataFrame, min_words: int, bitmap_most: int) -> DataFrame:
    """(whole, owner's columns, start, end, windows): stretches that may have an equal, with windows where these may have one elsewhere."""
    owner = [c for c in read.columns if c != "text"]
    named = ", ".join(f"{c} long" for c in owner)
    segments = f"whole long, {named}, start int, end int, windows array<long>"
    minima = read.select("text").mapInArrow(_winnow(min_words, owned=False), "fingerprint long, whole long")
    met = minima.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    repeated = settle(met.where("n > 1").select("fingerprint", (F.col("low") != F.col("high")).alias("apart")))
    if repeated.count() <= bitmap_most:
        # A bit that two fingerprints share lets more stretches through, alike in all texts: the cuts stay the same.
        return read.mapInArrow(_by_bitmap(min_words, bitmap(repeated, "fingerprint"), bitmap(repeated.where("apart"), "fingerprint")), segments)
    owned = read.mapInArrow(_winnow(min_words, owned=True), f"fingerprint long, {named}")
    lists = owned.join(repeated, "fingerprint").groupBy(*owner).agg(
        F.collect_set("fingerprint").alias("again"), F.collect_set(F.when(F.col("apart"), F.col("fingerprint"))).alias("apart")
    )
    return join_on(read, lists, owner).mapInArrow(_by_list(min_words), segments)


def owner_columns(docs: DataFrame) -> list[str]:
    """What tells documents apart: the id where each has its own, else also a hash of the text."""
    ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return ["doc_id"] if ids[0] == ids[1] else ["doc_id", "text_hash"]


def repeated_runs(docs: DataFrame, owner: list[str], min_words: int = MIN_WORDS, bitmap_most: int = BITMAP_MOST) -> DataFrame:
    """(owner's columns, cuts): for each text with later repeats, its repeated words as array of start * 2**32 + end, end excluded.

    Occurrences are ordered by doc_id (null first), then a hash of the text, then place.
    A repeat in the text of its first occurrence counts if it does not overlap it.  Rows
    of equal id and text are one document here.
    """
    known = {"doc_id": docs["doc_id"].cast("long"), "text_hash": F.xxhash64(docs["text"])}
    read = docs.select(*[known[c].alias(c) for c in owner], docs["text"].alias("text")).where("text is not null")
    segments = settle(_segments(read, min_words, bitmap_most))
    place = F.struct(*owner, "start")
    firsts = settle(segments.groupBy("whole").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("windows").alias("windows")))
    later = segments.drop("windows").join(firsts.where("n > 1").select("whole", "first"), "whole").where(place > F.col("first"))
    windows = firsts.where("windows is not null").select("first.*", F.posexplode("windows").alias("at", "key"))
    windows = windows.select("key", *owner, (F.col("start") + F.col("at")).alias("start"))
    origin = windows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    elsewhere = ~F.struct(*owner).eqNullSafe(F.struct(*[f"first.{c}" for c in owner]))
    again = windows.join(origin, "key").where((place > F.col("first")) & (elsewhere | (F.col("first.start") + min_words <= F.col("start"))))
    span = lambda end: (F.shiftleft(F.col("start").cast("long"), 32) + end).alias("span")
    cuts = later.select(*owner, span(F.col("end"))).union(again.select(*owner, span(F.col("start") + min_words)))
    return cuts.groupBy(*owner).agg(F.collect_set("span").alias("cuts"))


def without(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """text without the words from starts to ends, and how many whole lines and words went."""
    lines = text.split(b"\n")
    parts = [x.split() for x in lines]
    n = sum(map(len, parts))
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    gone = np.cumsum(edge) > 0
    # through[i]: one run holds both word i - 1 and word i.
    np.add.at(edge, starts, -1)
    np.add.at(edge, starts + 1, 1)
    through = np.cumsum(edge) > 0
    kept, at, lost = [], 0, 0
    for line, words in zip(lines, parts):
        inside = gone[at : at + len(words)]
        whole = bool(inside.all() if words else through[at])
        at += len(words)
        if whole:
            lost += 1
        else:
            kept.append(_line(line, words, inside) if inside.any() else line)
    return b"\n".join(kept), lost, int(gone.sum())


def _line(line: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """What is left of a line, as it stood; one space where words went from its middle."""
    left, start, end, run = [], None, 0, 0
    for word, out in zip(words, gone.tolist()):
        begin = line.index(word, end)
        if out and start is not None:
            left.append(line[start:end])
            start = None
        elif not out and start is None:
            start = begin if run else 0
        end, run = begin + len(word), run + 1
    if start is not None:
        left.append(line[start:])
    return b" ".join(left)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, words = batch.column(0), [0] * batch.num_rows, [0] * batch.num_rows
        cuts = batch.column(1)
        if cuts.null_count < batch.num_rows:
            clean = texts.to_pylist()
            for i in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)).tolist():
                runs = cuts[i].values.to_numpy()
                out, lines[i], words[i] = without(clean[i].encode(), runs >> 32, runs & (2**32 - 1))
                clean[i] = out.decode()
            texts = pa.array(clean, texts.type)
        names = ["_clean", "_removed_lines", "_removed_words", *(f.name for f in list(batch.schema)[2:])]
        yield pa.RecordBatch.from_arrays([texts, pa.array(lines, pa.int32()), pa.array(words, pa.int64()), *batch.columns[2:]], names)


def _cleaned(docs: DataFrame, min_words: int, bitmap_most: int = BITMAP_MOST) -> DataFrame:
    """_clean, _removed_lines and _removed_words of every row, and its other columns as _c0, _c1, ..."""
    owner = owner_columns(docs.select(docs["doc_id"].cast("long").alias("doc_id")))
    known = {"doc_id": docs["doc_id"].cast("long"), "text_hash": F.xxhash64(docs["text"])}
    rows = docs.select(*[known[c].alias(c) for c in owner], *[docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    cuts = settle(repeated_runs(docs, owner, min_words, bitmap_most=bitmap_most))
    text, others = f"_c{docs.columns.index('text')}", [f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"]
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.select(*others).schema.fields)
    cut = lambda some: join_on(some, cuts, owner, "left").select(text, "cuts", *others).mapInArrow(_cut, "_clean string, _removed_lines int, _removed_words long" + kinds)
    if cuts.count() > bitmap_most:
        return cut(rows)
    # Only texts that something is cut from travel, and a few that share a bit with them.
    number = F.xxhash64(*owner)
    marked = may_be_among(number, cuts.select(number))
    none = rows.where(~marked).select(F.col(text).alias("_clean"), F.lit(0).alias("_removed_lines"), F.lit(0).cast("long").alias("_removed_words"), *others)
    return cut(rows.where(marked)).union(none)


def passage_report(docs: DataFrame, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """Per row: doc_id, text (cleaned), removed_lines, removed_words.

    A word goes if it lies in a run of at least ``min_words`` words that occurs earlier,
    in any document or its own, whatever the line ends.  A line of which no word is left
    goes as a whole (removed_lines), as does one without words inside a run.  The first
    occurrence stays, also of a run that overlaps its own repeat: ten equal lines of 25
    words keep two.  Null, empty and shorter texts pass unchanged; null ids order first;
    repeated rows are cut alike; no rows give none.
    """
    doc_id = F.col(f"_c{docs.columns.index('doc_id')}").alias("doc_id")
    out = _cleaned(docs, min_words, **options)
    return out.select(doc_id, F.col("_clean").alias("text"), F.col("_removed_lines").alias("removed_lines"), F.col("_removed_words").alias("removed_words"))


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """docs with their texts cleaned as in passage_report; documents of which no word is left are dropped.

    All columns are kept; n_chars, if there is one, is that of the cleaned text.
    """
    out = _cleaned(docs, min_words, **options).where((F.col("_removed_words") == 0) | F.col("_clean").rlike(r"[^\x20\x09-\x0D]"))
    named = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[named.get(c, F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)])
