"""Removal of repeated byte strings by a hash-compared suffix sort (operator 3).

Every byte is removed that lies in a string of ``width`` bytes which also starts anywhere
else, in the same text or another.  Texts are UTF-8 bytes; strings are judged on the input
and never cross texts; overlaps count.

Not all suffixes are sorted.  Each window of ``width`` bytes is owned by an anchor, the
``core`` bytes of least hash within it, which depends on the window's bytes alone: equal
windows have equal anchors at equal offsets.  Neighbouring windows share anchors, so a
text of n bytes has about 2n / (width - core) of them.

1. Anchors are counted by core, and by core and a 128-bit BLAKE2b digest of all bytes of
   the windows they own.  If these bytes occur twice, all their windows are repeated; if
   the core occurs once, none is.  Counting combines before it shuffles, so a passage in a
   third of all texts is no hot spot.
2. What is left are anchors at the edges of repeats.  Their bytes, and those of one anchor
   for each of the strings found in 1, are gathered by core, in bounded buckets, and sorted
   there: suffixes from the anchor on and, backwards, prefixes up to it, each by a mergesort whose comparisons find the common extension by a binary
   search over prefix polynomial hashes.  Extensions of neighbours are verified on the bytes
   themselves.  A window is repeated if another one stands with it in one class of both
   orders.  A core with more anchors than a bucket holds is split; windows that are single
   in their part are compared across parts, first by what neighbouring ones share, then by
   a digest of their own.
3. Ranges are merged to spans, and texts are joined with them.

``repeats`` can also report passages: with ``passage = (bytes, words)`` the same search runs
for strings of that many bytes, fewer than ``width``, and those of its spans count that hold
more than so many whole words.  The search for ``width`` then looks only at texts that have a
span of ``width`` bytes there, as all its strings lie in such a span.

Results: a null text is empty; a text shorter than ``width`` loses nothing.  Repeated rows
count as texts of their own, so a row that stands there twice loses all its windows.  An
empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekframe.llm.rolling import U, common_extension, prefix_hash, window_hash
from seekframe.llm.runtime import discard, materialise, release, text_batches, tidy, utf8_chunks

WIDTH, CORE = 400, 100
#: Fragments in a bucket, and those of one core beyond which it is split.
BUCKET = 1500
#: Low bits of a composite that hold a position; a pass is shorter than that.
AT_BITS = 26


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of ``w`` values, by running minima from both sides of blocks."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors_of(data: np.ndarray, offsets: np.ndarray, width: int, core: int):
    """(text number, first, last, anchor, core hash) of each anchor.

    Positions are within ``data``; the anchor owns the windows from ``first`` to ``last``.
    """
    prefix = prefix_hash(data)
    hashes = window_hash(prefix, core)
    w = width - core + 1
    none = np.zeros(0, np.int64)
    if len(hashes) < w:
        return none, none, none, none, none.astype(np.uint64)
    low = U((1 << AT_BITS) - 1)
    owner = (_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), w) & low).astype(np.int64)
    starts, ends = offsets[:-1], offsets[1:] - width + 1
    text = np.flatnonzero(ends > starts)
    counts = ends[text] - starts[text]
    of = np.repeat(text, counts)
    s = np.arange(counts.sum()) + np.repeat(starts[text] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    p = owner[s]
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    first, last, anchor = s[at], s[np.append(at[1:], len(s)) - 1], p[at]
    return of[at], first, last, anchor, hashes[anchor]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of spans of bytes, as two longs each."""
    whole = memoryview(data.tobytes())
    out = b"".join([hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, "<i8").reshape(-1, 2)


def _anchor_rows(width: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in utf8_chunks(batch.column("t")):
                of, first, last, anchor, cores = anchors_of(data, offsets, width, core)
                owned = digests(data, first, last + width)
                where = ((first - offsets[of]) << 20) | ((anchor - first) << 10) | (anchor - last)
                keys = batch.select(["k1", "k2"]).slice(a, b - a).take(pa.array(of))
                yield pa.RecordBatch.from_arrays(
                    [keys.column("k1"), keys.column("k2"), pa.array(cores.view(np.int64)), *(pa.array(owned[:, i]) for i in (0, 1)), pa.array(where)],
                    ["k1", "k2", "core", "owned", "owned2", "place"],
                )

    return run


def merge_sort(n: int, less) -> np.ndarray:
    """A stable bottom-up mergesort of 0..n-1; ``less(a, b)`` says elementwise whether a goes before b.

    All runs of one level are merged at once: each item finds its place in the sibling run
    by a binary search, and moves there.
    """
    order = np.arange(n)
    run = 1
    while run < n:
        at = np.arange(n)
        start = at // (2 * run) * (2 * run)
        is_left = at - start < run
        low = np.where(is_left, np.minimum(start + run, n), start)
        end = np.where(is_left, np.minimum(start + 2 * run, n), start + run)
        base, high = low.copy(), end.copy()
        while (open_ := low < high).any():
            i = np.flatnonzero(open_)
            mid = (low[i] + high[i]) >> 1
            mine, other = order[i], order[mid]
            left = is_left[i]
            # of equal items those of the left run come first
            before = np.empty(len(i), bool)
            before[left] = less(other[left], mine[left])
            before[~left] = ~less(mine[~left], other[~left])
            low[i] = np.where(before, mid + 1, low[i])
            high[i] = np.where(before, high[i], mid)
        rank = np.where(is_left, at - start, at - start - run)
        target = start + rank + (low - base)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order, run = merged, 2 * run
    return order


def suffix_sort(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the given suffixes, and each one's verified common extension with the one before it."""
    prefix = prefix_hash(data)
    padded = np.append(data.astype(np.int16), -1)

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(length[a], length[b])
        same = common_extension(prefix, start[a], start[b], most)
        ended = same == most
        x, y = padded[np.where(ended, 0, start[a] + same)], padded[np.where(ended, 0, start[b] + same)]
        return np.where(ended, length[a] < length[b], x < y)

    order = merge_sort(len(start), less)
    shared = np.zeros(len(start), np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        shared[1:] = common_extension(prefix, start[a], start[b], np.minimum(length[a], length[b]))
        for i in range(1, len(order)):
            n = int(shared[i])
            one, two = data[start[order[i - 1]] :][:n], data[start[order[i]] :][:n]
            if not np.array_equal(one, two):
                shared[i] = int(np.argmax(one != two))
    return order, shared


def repeated_windows(fragments: list[bytes], place: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each fragment its windows, by number, that are repeated among these fragments; and which of them leads its class.

    ``place`` says how far the anchor is from the first window (bits 10 to 19) and from the
    last (bits 0 to 9).
    """
    sizes = np.array([len(f) for f in fragments])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(fragments), np.uint8)
    most, least = (place >> 10) & 1023, place & 1023
    anchor = begin + most
    after, after_shared = suffix_sort(data, anchor, sizes - most)
    mirrored = data[::-1].copy()
    before, before_shared = suffix_sort(mirrored, len(data) - anchor, most)
    count = len(fragments)
    found = [np.zeros(m - n + 1, bool) for m, n in zip(most, least, strict=True)]
    leads = [np.zeros(m - n + 1, bool) for m, n in zip(most, least, strict=True)]
    for back in range(int(least.min()), int(most.max()) + 1):
        has = np.flatnonzero((least <= back) & (back <= most))
        if len(has) < 2:
            continue
        right, left = np.empty(count, np.int64), np.empty(count, np.int64)
        right[after] = np.cumsum(after_shared < width - back)
        left[before] = np.cumsum(before_shared < back)
        key = right[has] * (count + 1) + left[has]
        _, lead, group, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        for i in has[n[group] > 1]:
            found[i][most[i] - back] = True
        for i in has[lead[n > 1]]:
            leads[i][most[i] - back] = True
    return found, leads


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [*zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


#: Windows of a split core that are compared across parts under one key, the bytes they all have.
TIER = 8
OPEN = "k1 bigint, k2 int, a bigint, b bigint, t1 bigint, t2 bigint, windows array<struct<a:bigint,d1:bigint,d2:bigint>>"


def _digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _resolve(width: int):
    """Ranges [a, b) of repeated bytes; in a part of a split core also its single windows and one of each class.

    These come in tiers: ``TIER`` neighbouring windows with the digest of the bytes they share, and their own.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        place = table.column("place").to_numpy()
        fragments = table.column("bytes").to_pylist()
        k1, k2 = table.column("k1").to_pylist(), table.column("k2").to_pylist()
        split = table.column("part")[0].as_py() >= 0
        found, leads = repeated_windows(fragments, place, width)
        rows = []
        for i, (flags, lead) in enumerate(zip(found, leads, strict=True)):
            first, most = int(place[i]) >> 20, (int(place[i]) >> 10) & 1023
            rows += [(k1[i], k2[i], first + a, first + b - 1 + width, None, None, None) for a, b in _runs(flags)]
            if split:
                tiers: dict[int, list] = {}
                for s in np.flatnonzero(~flags | lead).tolist():
                    tiers.setdefault((most - s) // TIER, []).append({"a": first + s, **dict(zip(("d1", "d2"), _digest(fragments[i][s : s + width]), strict=True))})
                for t, windows in tiers.items():
                    key = fragments[i][most - t * TIER : most + width - t * TIER - TIER + 1]
                    rows.append((k1[i], k2[i], None, None, *_digest(key), windows))
        columns = [*zip(*rows, strict=True)] or [[]] * 7
        window = pa.list_(pa.struct([("a", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())]))
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 4, window]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k1", "k2", "a", "b", "t1", "t2", "windows"])

    return run


def _fragments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text, edges in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "t", "edges")), strict=True):
                data = (text or "").encode("utf-8")
                for e in edges:
                    place = e["place"]
                    first = place >> 20
                    last = first + ((place >> 10) & 1023) - (place & 1023)
                    rows.append((k1, k2, e["core"], place, data[first : last + width]))
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["k1", "k2", "core", "place", "bytes"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with two hashes of id and text, which stand for the row from here on."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("k1", F.xxhash64(F.col(id_col), t)).withColumn("k2", F.hash(t, F.col(id_col))).withColumn("t", t)


def _spans(width: int):
    """Merges whole places and ranges of a row to maximal spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for whole, ranges in zip(batch.column("whole").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                found = [(x["a"], x["b"]) for x in ranges or []]
                for place in whole or []:
                    first = place >> 20
                    found.append((first, first + ((place >> 10) & 1023) - (place & 1023) + width))
                merged: list[list[int]] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                spans.append([{"a": a, "b": b} for a, b in merged])
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            longest = [max((x["b"] - x["a"] for x in s), default=0) for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(spans, kind), pa.array(longest, pa.int64())], ["k1", "k2", "spans", "longest"])

    return run


def repeated_spans(keyed: DataFrame, width: int, core: int) -> DataFrame:
    """k1, k2, spans and the longest one's size of each row of ``keyed`` (k1, k2, t) that has any; a table."""
    spark = keyed.sparkSession
    anchors = keyed.select("k1", "k2", "t").mapInArrow(tidy(_anchor_rows(width, core)), "k1 bigint, k2 int, core bigint, owned bigint, owned2 bigint, place bigint")
    me = F.xxhash64("k1", "k2", "place")
    pairs = anchors.groupBy("core", "owned", "owned2").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("lead"))
    # tables, so that both sides of the joins below are dealt out by an exchange of their own and a hot core can be split
    pairs = materialise(pairs, "dedup-pairs")
    cores = materialise(pairs.groupBy("core").agg(F.sum("n").alias("n"), (F.count(F.lit(1)) > 1).alias("mixed")).where("n > 1").select("core", "mixed"), "dedup-cores")
    release(spark)
    twice = pairs.where("n > 1").select("core", "owned", "owned2", "lead")
    judged = anchors.join(cores, "core").join(twice, ["core", "owned", "owned2"], "left")
    # one anchor stands for all whose windows are the same: others at this core may share some of them
    shown = F.col("lead").isNull() | (F.col("mixed") & (F.col("lead") == me))
    status = judged.groupBy("k1", "k2").agg(
        F.collect_list(F.when(F.col("lead").isNotNull(), F.col("place"))).alias("whole"),
        F.collect_list(F.when(shown, F.struct("core", "place"))).alias("edges"),
    )
    status = materialise(status, "dedup-anchors")
    discard(pairs, cores)
    release(spark)
    edges = status.where(F.size("edges") > 0).select("k1", "k2", "edges")
    # repeated rows have one key: the text is needed once, and each row's anchors are listed
    texts = keyed.select("k1", "k2", "t").join(edges, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    pieces = materialise(texts.mapInArrow(tidy(_fragments(width)), "k1 bigint, k2 int, core bigint, place bigint, bytes binary"), "dedup-edges")
    release(spark)
    count = pieces.count()
    hot = pieces.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
    parts = F.ceil(F.col("n") / BUCKET)
    dealt = pieces.join(hot, "core", "left").withColumn("part", F.when(F.col("n").isNull(), -1).otherwise(F.pmod(F.xxhash64("k1", "k2", "place"), parts)).cast("int"))
    dealt = dealt.withColumn("bucket", F.when(F.col("part") >= 0, F.col("core")).otherwise(F.pmod(F.xxhash64("core"), F.lit(max(1, math.ceil(count / BUCKET))))))
    resolved = materialise(dealt.drop("n").groupBy("bucket", "part").applyInArrow(_resolve(width), OPEN), "dedup-resolved")
    discard(pieces)
    release(spark)
    twice_in = lambda df, *key: df.join(df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), [*key], "left_semi")
    tiers = twice_in(resolved.where(F.col("t1").isNotNull()).select("k1", "k2", "t1", "t2", "windows"), "t1", "t2")
    single = twice_in(tiers.select("k1", "k2", F.explode("windows").alias("w")).select("k1", "k2", "w.a", "w.d1", "w.d2"), "d1", "d2")
    ranges = resolved.where(F.col("t1").isNull()).select("k1", "k2", "a", "b").unionByName(single.select("k1", "k2", "a", (F.col("a") + width).alias("b")))
    ranges = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    both = status.select("k1", "k2", "whole").join(ranges, ["k1", "k2"], "left")
    spans = materialise(both.mapInArrow(tidy(_spans(width)), "k1 bigint, k2 int, spans array<struct<a:bigint,b:bigint>>, longest bigint").where("longest > 0"), "dedup-spans")
    discard(status, resolved)
    release(spark)
    return spans


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def whole_words(data: np.ndarray, spans: list[tuple[int, int]], more_than: int) -> list[tuple[int, int]]:
    """Of ``spans`` those that hold more than so many whole words, each cut back to them."""
    word = np.concatenate([[False], ~_BLANK[data], [False]]).astype(np.int8)
    begin, end = np.flatnonzero(np.diff(word) == 1), np.flatnonzero(np.diff(word) == -1)
    out = []
    for a, b in spans:
        first, last = int(np.searchsorted(begin, a)), int(np.searchsorted(end, b, side="right"))
        if last - first > more_than:
            out.append((int(begin[first]), int(end[last - 1])))
    return out


def _without(data: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    keep = np.ones(len(data), bool)
    for a, b in spans:
        keep[a:b] = False
    return data[keep].tobytes()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row of ``docs`` as one column, with its two keys and its text."""
    text_batches(docs.sparkSession)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text"))
    return _keyed(own, "row_id", "row_text").drop("row_id", "row_text")


def remove_repeats(docs: DataFrame, width: int = WIDTH, core: int | None = None, *, words: int | None = None, id_col: str = "doc_id", text_col: str = "text", kept: bool = True) -> DataFrame:
    """``docs`` with dedup_bytes, dedup_removed, dedup_spans, dedup_sha256 and, if ``kept``, dedup_kept
    (the bytes left) and dedup_text (their whole characters).

    With ``words`` only spans with more whole words than that go, and of them the whole words.
    Columns of ``docs`` named k1, k2, t or spans are passed through under their names too.
    """
    keyed = _rows(docs, id_col, text_col)
    spans = repeated_spans(keyed, _checked(width), core or max(1, width // 4))
    joined = keyed.join(spans.select("k1", "k2", "spans"), ["k1", "k2"], "left").select("row", "t", "spans")
    row = joined.schema["row"].dataType.simpleString()
    schema = f"row {row}, n_bytes bigint, n_removed bigint, n_spans bigint, sha string" + ", kept binary, whole_text string" * kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                left = data = text.encode("utf-8")
                gone = [(x["a"], x["b"]) for x in found or []]
                if gone:
                    array = np.frombuffer(data, np.uint8)
                    gone = gone if words is None else whole_words(array, gone, words)
                    left = _without(array, gone)
                out.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest(), left))
            columns = [*zip(*out, strict=True)] or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)][: 5 if kept else 4]
            if kept:
                arrays.append(pa.array([c.decode("utf-8", "ignore") for c in columns[4]], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], ["row", "n_bytes", "n_removed", "n_spans", "sha", "kept", "whole_text"][: 1 + len(arrays)])

    done = joined.mapInArrow(tidy(run), schema)
    names = {"n_bytes": "dedup_bytes", "n_removed": "dedup_removed", "n_spans": "dedup_spans", "sha": "dedup_sha256"} | ({"kept": "dedup_kept", "whole_text": "dedup_text"} if kept else {})
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *[F.col(a).alias(b) for a, b in names.items()])


def _checked(width: int) -> int:
    if width >= 1024:
        raise ValueError("a window of 1024 bytes or more doesn't fit the packed places")
    return width


def repeats(docs: DataFrame, width: int, passage: tuple[int, int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row its id, n_bytes, n_removed, n_spans and kept_sha256 as ``remove_repeats`` has them
    for ``width``, and n_passages and passage_bytes: spans of repeated strings of ``passage[0]`` bytes
    that hold more than ``passage[1]`` whole words, and the bytes of these words."""
    least, words = passage
    if least >= _checked(width):
        raise ValueError("passages are shorter than the strings that are removed")
    keyed = _rows(docs.select(id_col, text_col), id_col, text_col)
    short = repeated_spans(keyed, least, least // 4)
    # every string of ``width`` bytes that stands twice lies in a span that long, on both sides
    some = materialise(keyed.select("k1", "k2", "t").join(short.where(F.col("longest") >= width).select("k1", "k2"), ["k1", "k2"], "left_semi"), "dedup-some")
    long = repeated_spans(some, width, width // 4)
    discard(some)
    found = short.select("k1", "k2", "spans").join(long.select("k1", "k2", F.col("spans").alias("cut")), ["k1", "k2"], "left")
    joined = keyed.join(found, ["k1", "k2"], "left").select("row", "t", "spans", "cut")
    kind = joined.schema["row"].dataType[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found, cut in zip(*(batch.column(c).to_pylist() for c in ("t", "spans", "cut")), strict=True):
                left = data = text.encode("utf-8")
                gone = [(x["a"], x["b"]) for x in cut or []]
                passages: list[tuple[int, int]] = []
                if found:
                    array = np.frombuffer(data, np.uint8)
                    passages = whole_words(array, [(x["a"], x["b"]) for x in found], words)
                    left = _without(array, gone) if gone else data
                out.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest(), len(passages), sum(b - a for a, b in passages)))
            columns = [*zip(*out, strict=True)] or [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2
            ids = batch.column("row").field(0)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"])

    return joined.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, passage_bytes bigint")
