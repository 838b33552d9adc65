"""Near-duplicate documents by ProbMinHash (operator 5).

Shingles are five words, lower-cased; a shingle's weight is how often it stands in the
text.  Each shingle sends points into a signature's registers by a Poisson process whose
rate is its weight and whose random numbers depend on the shingle alone; a register keeps
the shingle of its first point.  Arrivals stop as soon as a shingle's next point comes
later than every register's first.  Two signatures agree in a register with the
probability Jaccard similarity of the two texts.

Signatures are cut into bands; texts that agree in a band are candidates.  Candidates of a
band are compared with one hub of the band (the text that shares bands with most), not with each other, and exactly, on their
texts: they are linked if their probability Jaccard similarity, or the plain one of the shingle sets, is at
least ``least``.  Recall holds for the former only: a pair that is alike by the plain one alone
is met by chance, as bands come from weighted signatures.  Links join texts into classes.  After two rounds with a hub, bands that
still hold texts of different classes are compared within: a task takes a band, or two
blocks of a large one (so it never holds more than about twice ``BLOCK`` texts), and finds the links between classes through an index of shingles,
so no link between candidates is lost and no pair leaves a task but a link.

Exact copies of a text are one node throughout, so their number costs nothing; they are
in one class by definition.

Results: a null or wordless text has no shingles, and is a class of its own.  A class is
named by its smallest id (nulls last), which is also the one to keep; of repeated rows of
one id and text one is kept.  An empty table gives an empty result.  Further columns are
ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekframe.llm.rolling import U, mix
from seekframe.llm.runtime import materialise, release, text_batches, tidy, utf8_chunks
from seekframe.llm.shingles import ID_BITS, lowered, packed, shingle_counts, shingles_of

WIDTH, LEAST = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.99995 at 0.8.
BANDS, ROWS = 25, 5
#: Rounds in which a band is compared with one hub; what then still falls apart is compared within bands.
HUB_ROUNDS = 2
#: Texts of one band in a block.
BLOCK = 500


def prob_min_hash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The signatures (n x registers) of n texts, each of which has at least one shingle."""
    first = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(shingle))
    latest = np.full(n, np.inf)
    active = np.arange(len(shingle))
    turn = 0
    while len(active):
        turn += 1
        seed = mix(shingle[active] ^ mix(np.array([turn], np.uint64)))
        uniform = ((seed >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        time[active] -= np.log(uniform) / weight[active]
        active_in = time[active] < latest[text[active]]
        active, seed = active[active_in], seed[active_in]
        register = ((mix(seed + U(1)) >> U(32)) * U(registers)) >> U(32)
        slot = text[active] * registers + register.astype(np.int64)
        arrival = time[active]
        np.minimum.at(first, slot, arrival)
        won = arrival == first[slot]
        holder[slot[won]] = shingle[active[won]]
        latest = first.reshape(n, registers).max(1)
        active = active[arrival < latest[text[active]]]
    return holder.reshape(n, registers)


def _bands(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in utf8_chunks(lowered(batch.column("t"))):
                keys, weight = shingle_counts(data, offsets, width)
                text, has = np.unique((keys >> U(ID_BITS)).astype(np.int64), return_inverse=True)
                if not len(text):
                    continue
                shingle = mix(keys & U((1 << ID_BITS) - 1))
                signature = prob_min_hash(has, shingle, weight.astype(np.float64), len(text), bands * rows)
                parts = signature.reshape(len(text), bands, rows)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15), (len(text), bands)).copy()
                for j in range(rows):
                    band = mix(band * U(0x100000001B3) + parts[:, :, j])
                own = batch.select(["id", "node"]).slice(a, b - a).take(pa.array(text))
                values = pa.ListArray.from_arrays(np.arange(len(text) + 1, dtype=np.int32) * bands, pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("node"), values], ["id", "node", "bands"])

    return run


def similarities(one: pa.Array, other: pa.Array, width: int) -> np.ndarray:
    """The larger of probability Jaccard and plain Jaccard similarity of each pair of texts."""
    (*key_a, w_a), (*key_b, w_b) = shingles_of(one, width), shingles_of(other, width)
    key_a, key_b = packed(*key_a), packed(*key_b)
    both = np.union1d(key_a, key_b)
    a, b = np.zeros(len(both)), np.zeros(len(both))
    a[np.searchsorted(both, key_a)] = w_a
    b[np.searchsorted(both, key_b)] = w_b
    pair = (both >> U(ID_BITS)).astype(np.int64)
    shared = (a > 0) & (b > 0)
    n = len(one)
    union = np.bincount(pair, minlength=n)
    plain = np.bincount(pair[shared], minlength=n) / np.maximum(union, 1)
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.lexsort((ratio, pair))
    pair, ratio, a, b, shared = pair[order], ratio[order], a[order], b[order], shared[order]
    run = np.ones(len(pair), bool)
    run[1:] = (pair[1:] != pair[:-1]) | (ratio[1:] != ratio[:-1])
    group = np.cumsum(run) - 1
    at = np.append(np.flatnonzero(run), len(pair))
    sum_a, sum_b = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(b)])
    begin = np.searchsorted(pair, pair)
    end = np.searchsorted(pair, pair, side="right")
    low = at[group]
    # what has a smaller ratio counts by b, the rest by a
    total = (sum_b[low] - sum_b[begin]) / np.where(shared, b, 1) + (sum_a[end] - sum_a[low]) / np.where(shared, a, 1)
    out = np.bincount(pair[shared], weights=1 / total[shared], minlength=n)
    return np.maximum(out, plain)


def _verify(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pa.compute.add(pa.compute.binary_length(batch.column("text_a")), pa.compute.binary_length(batch.column("text_b"))))
            chunk = np.cumsum(lengths) // (1 << 20)
            for start in np.flatnonzero(np.diff(chunk, prepend=-1)):
                part = batch.slice(start, int((chunk == chunk[start]).sum()))
                close = similarities(part.column("text_a"), part.column("text_b"), width) >= least
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(close)], ["a", "b", "close"])

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that ``links`` (a, b) lead to.

    Each round every node takes the least label around it, then its label's label; the rounds
    needed grow with the logarithm of the longest chain in most graphs.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "near-labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        next_ = labels.join(around, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        hop = next_.select(F.col("node").alias("to"), F.col("to").alias("far"))
        labels = materialise(next_.join(hop, "to").select("node", F.least("to", "far").alias("label"), "was"), "near-labels")
        if labels.where("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the nodes in ``wanted`` (node, id of a row that has the text)."""
    wanted = wanted.select(F.col("node").alias("its_node"), F.col("id").alias("its_id"))
    found = docs.join(wanted, (F.col("node") == F.col("its_node")) & F.col("id").eqNullSafe(F.col("its_id")))
    return found.select("its_node", "its_id", "t").dropDuplicates(["its_node", "its_id"]).select(F.col("its_node").alias("node"), "t")


def linked(docs: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Labels of the nodes that are linked with another; ``rows`` has id, node and bands."""
    spark = docs.sparkSession
    nodes = materialise(rows.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "near-nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(banded.join(shared, "band"), "near-met")
    # a text that shares its bands with many stands in the middle of its kind: the best hub there is
    degrees = met.groupBy("node").agg(F.sum("n").alias("degree"))
    open_ = materialise(met.join(degrees, "node").select("node", "band", "degree"), "near-open")
    release(spark)
    wanted = open_.select("node").distinct().join(nodes.select("node", "id"), "node")
    texts = materialise(_texts_of(docs, wanted), "near-texts")
    release(spark)
    tried = links = None
    labels = spark.createDataFrame([], "node binary, label binary")
    for turn in range(HUB_ROUNDS + 1):
        state = open_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        bands = state.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("degree", "node", "label")).alias("top"))
        bands = bands.where(F.col("low") < F.col("high")).select("band", "n", F.col("top.node").alias("hub"), F.col("top.label").alias("hub_label"))
        rest = materialise(state.join(bands, "band"), "near-round")
        if turn == HUB_ROUNDS:
            new = _closed(rest, texts, width, least)
        else:
            pairs = rest.where(F.col("label") != F.col("hub_label")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
            pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
            # the hub's text comes last: its row is the one that many pairs share
            with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("text_b")), "b")
            with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("t").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
            done = materialise(with_both.mapInArrow(tidy(_verify(width, least)), "a binary, b binary, close boolean"), "near-verified")
            tried = done.select("a", "b") if tried is None else tried.unionByName(done.select("a", "b"))
            new = done.where("close").select("a", "b")
            # a hub has been compared with its whole band and needs no further look there
            open_ = rest.where(F.col("node") != F.col("hub")).select("node", "band", "degree")
        release(spark)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links)
    return labels


def _closed(rest: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The links between texts of different classes in one band.

    The texts of a band are dealt out to blocks, and those that stand apart from its hub's
    class to blocks of their own kind too.  A task holds one block of each, whatever the band
    holds: it compares the apart ones with all of the other through an index of shingles, and
    gives nothing but links.
    """
    apart = F.col("label") != F.col("hub_label")
    counts = rest.groupBy("band").agg(F.count(F.when(apart, 1)).alias("n_apart"))
    blocks, kinds = (F.greatest(F.ceil(F.col(c) / BLOCK).cast("int"), F.lit(1)) for c in ("n", "n_apart"))
    dealt = rest.join(counts, "band").select(
        "band", "node", "label", blocks.alias("blocks"), kinds.alias("kinds"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.when(apart, F.pmod(F.xxhash64("node", F.lit(1)), kinds)).otherwise(-1).cast("int").alias("own_kind")
    )
    among = F.transform(F.sequence(F.lit(0), F.col("kinds") - 1), lambda i: F.struct(i.alias("kind"), F.col("own").alias("block")))
    against = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.col("own_kind").alias("kind"), i.alias("block")))
    tasks = F.when(F.col("own_kind") < 0, among).otherwise(F.array_union(among, against))
    met = dealt.select("band", "node", "label", "own", "own_kind", F.explode(tasks).alias("task")).select("band", "node", "label", "own", "own_kind", "task.kind", "task.block")
    found = met.join(texts, "node").groupBy("band", "kind", "block").applyInArrow(_links_within(width, least), "a binary, b binary")
    return materialise(found.distinct(), "near-closed")


def _links_within(width: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, text = table.column("node").to_pylist(), table.column("t").combine_chunks()
        label = np.unique(np.array([x.hex() for x in table.column("label").to_pylist()]), return_inverse=True)[1]
        here = table.column("own").to_numpy() == table.column("block").to_numpy()
        apart = np.flatnonzero(table.column("own_kind").to_numpy() == table.column("kind").to_numpy())
        n, found = len(node), []
        if len(apart):
            doc, shingle, weight = shingles_of(text, width)
            place = np.unique(shingle, return_inverse=True)[1]
            share = weight / np.bincount(doc, weights=weight, minlength=n)[doc]
            size = np.bincount(doc, minlength=n)
            uneven = np.bincount(doc, weights=weight > 1, minlength=n) > 0
            by_place = np.argsort(place, kind="stable")
            begin = np.concatenate([[0], np.cumsum(np.bincount(place))])
            first = np.concatenate([[0], np.cumsum(size)])
            for o in apart:
                mine = slice(first[o], first[o + 1])
                p = place[mine]
                lengths = begin[p + 1] - begin[p]
                at_ = by_place[np.repeat(begin[p] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())]
                shared = np.bincount(doc[at_], minlength=n)
                other = here & (label != label[o])
                close = shared >= least * (size[o] + size - shared)
                bound = np.bincount(doc[at_], weights=np.minimum(np.repeat(share[mine], lengths), share[at_]), minlength=n)
                maybe = np.flatnonzero(other & ~close & (uneven | uneven[o]) & (bound >= least))
                if len(maybe):
                    exact = similarities(text.take(pa.array(maybe)), text.take(pa.array(np.full(len(maybe), o))), width)
                    close[maybe[exact >= least]] = True
                found += [(min(node[o], node[x]), max(node[o], node[x])) for x in np.flatnonzero(other & close)]
        found = sorted(set(found))
        return pa.table({"a": pa.array([x[0] for x in found], pa.binary()), "b": pa.array([x[1] for x in found], pa.binary())})

    return run


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, node (digest of the text), class_id, class_size and keep for each row of ``docs``."""
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("node"), text.alias("t"))
    kind = keyed.schema["id"].dataType.simpleString()
    signed = materialise(keyed.mapInArrow(tidy(_bands(width, bands, rows)), f"id {kind}, node binary, bands array<bigint>"), "near-signatures")
    labels = linked(keyed, signed, width, least)
    members = signed.select("id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("node")))
    names = members.groupBy("label").agg(best.alias("best"), F.count(F.lit(1)).alias("class_size"))
    named = members.join(names, "label").select("id", "node", F.col("best.id").alias("class_id"), "class_size", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("node") == F.col("best.node"))).alias("keep"))
    wordless = keyed.where(~F.col("t").rlike(r"[^\x20\x09-\x0D]")).select("id", "node", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("keep"))
    return named.unionByName(wordless)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` without those whose class is kept by another; wordless rows all stay."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    wordless = ~text.rlike(r"[^\x20\x09-\x0D]")
    kept = classes(docs.where(~wordless), id_col=id_col, text_col=text_col, **more).where("keep").select(F.col("id").alias("__near_id"), F.col("node").alias("__near_node")).distinct()
    # rows travel as one column, so none of theirs can be mistaken for these
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.where(~wordless).select(row.alias("row"), F.col(id_col).alias("own_id"), F.unhex(F.md5(text)).alias("own_node"))
    found = own.join(kept, F.col("own_id").eqNullSafe(F.col("__near_id")) & (F.col("own_node") == F.col("__near_node")))
    found = found.dropDuplicates(["__near_id", "__near_node"])
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.where(wordless))
