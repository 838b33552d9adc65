"""Language identification by nearest centroids (operator 1).

A text becomes a vector of byte n-gram counts (lower-cased UTF-8, everything in ASCII that
is no letter being a blank), hashed to ``DIM`` places, damped by a logarithm, weighted by
inverse document frequency and scaled to length one.  Each language has a few centroids,
found by clustering the vectors of a bounded sample of its labelled rows; a text gets the
language of the centroid with the largest cosine.  A text farther from its centroid than
all but one in a hundred training texts of about its length is rejected; short texts have
low cosines, so the limit is fitted on beginnings of training texts too.

Results: a null text, or one without a letter, is ``und`` with score 0, and rejected.  Ties
go to the language first in order.  With no labelled row to learn from all texts are
``und``.  A row with a null id is never learned from and not held out.  Repeated rows give
repeated results, an empty table an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekframe.llm.rolling import U, mix
from seekframe.llm.runtime import text_batches, tidy, utf8_chunks

DIM, GRAMS = 4096, (1, 2, 3)
#: The classifier is fitted on about so many rows of each language, drawn by a hash of the id.
SAMPLE_PER_LANG = 400
CENTROIDS = 4
UNKNOWN = "und"
#: A text is rejected below the cosine that all but one in a hundred training texts of its level of length reach.
REJECT_QUANTILE = 0.01
#: A level of length spans a factor of four in n-grams; one with fewer training texts than LEAST_TEXTS has no limit of its own.
LEVELS, LEAST_TEXTS = 16, 50
#: Bytes of the beginnings of training texts on which the limits of short texts are fitted.
CUTS = (4, 12, 40, 150, 600)

_PLAIN = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text; grams of blanks only or with two in a row don't count."""
    n = len(offsets) - 1
    letters = _PLAIN[data]
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    blank = letters == 32
    out = np.zeros(n * DIM)
    for width in GRAMS:
        room = len(letters) - width + 1
        if room <= 0:
            continue
        value = np.zeros(room, np.uint64)
        fine = text[:room] == text[width - 1 :]
        fine &= ~blank[:room] if width == 1 else True
        for j in range(width):
            value = (value << U(8)) | letters[j : j + room]
            if j:
                fine &= ~(blank[j - 1 : j - 1 + room] & blank[j : j + room])
        at = np.flatnonzero(fine)
        bucket = (mix(value[at] + U(width << 32)) >> U(52)).astype(np.int64)
        out += np.bincount(text[at] * DIM + bucket, minlength=n * DIM)
    return out.reshape(n, DIM)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(1), 1)) / 2, LEVELS - 1).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    lang_of: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and whether it is rejected, for each row."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(1)
        score = cosine[np.arange(len(best)), best]
        return self.lang_of[best], score, score < self.reject_below[level_of(counts)]


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of length one by spherical k-means; the first are far from each other."""
    random = np.random.default_rng(seed)
    centre = x[[int(random.integers(len(x)))]]
    while len(centre) < min(k, len(x)):
        far = 1 - (x @ centre.T).max(1)
        if far.max() < 1e-9:
            break
        centre = np.vstack([centre, x[random.choice(len(x), p=np.maximum(far, 0) / np.maximum(far, 0).sum())]])
    for _ in range(rounds):
        group = (x @ centre.T).argmax(1)
        sums = np.vstack([x[group == g].sum(0) if (group == g).any() else centre[g] for g in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


def limits(level: np.ndarray, cosine: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The cosine below which a text of each level is rejected; ``whole`` has the cosines of uncut texts."""

    def limit(x: np.ndarray) -> float:
        return np.quantile(x, REJECT_QUANTILE, method="lower") - 1e-9

    filled = np.flatnonzero(np.bincount(level, minlength=LEVELS) >= LEAST_TEXTS)
    if not len(filled):
        return np.full(LEVELS, limit(whole))
    out = np.zeros(LEVELS)  # shorter texts than were learned from are not judged
    for at in filled:
        out[at:] = limit(cosine[level == at])
    return out


def fit_model(langs: list[str], counts: np.ndarray, centroids: int = CENTROIDS, cuts: Iterator[tuple[list[str], np.ndarray]] = ()) -> Model:
    """A model of texts of ``langs``; ``cuts`` has the languages and counts of beginnings of them, in batches."""
    names = sorted(set(langs))
    seen = (counts > 0).sum(0)
    model = Model(names, np.zeros(0, np.int64), np.zeros((0, DIM)), np.log((1 + len(counts)) / (1 + seen)) + 1, np.zeros(0))
    if not names:
        return model
    x, own = model.vectors(counts), np.array(langs)
    parts = [cluster(x[own == name], centroids) for name in names]
    model.lang_of = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    model.centroids = np.vstack(parts)

    def reached(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        cosine = x @ model.centroids.T
        cosine[own[:, None] != np.array(names)[model.lang_of]] = -1
        return cosine.max(1)

    whole = reached(x, own)
    level, cosine = [level_of(counts)], [whole]
    for cut_langs, cut in cuts:
        level.append(level_of(cut))
        cosine.append(reached(model.vectors(cut), np.array(cut_langs)))
    model.reject_below = limits(np.concatenate(level), np.concatenate(cosine), whole)
    return model


def beginnings(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts are longer than ``size`` bytes, and the first ``size`` of each as (data, offsets)."""
    longer = np.flatnonzero(np.diff(offsets) > size)
    return longer, data[(offsets[longer][:, None] + np.arange(size)).ravel()], np.arange(len(longer) + 1) * size


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in utf8_chunks(pc.utf8_lower(batch.column("text"))):
            langs = batch.column("lang").slice(a, b - a)
            for size in (0, *CUTS):
                rows, *part = beginnings(data, offsets, size) if size else (np.arange(b - a), data, offsets)
                counts = gram_counts(*part)
                places = [np.flatnonzero(row) for row in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(pa.array(rows)),
                        pa.array(np.full(len(rows), size, np.int32)),
                        pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32())),
                        pa.array([r[p].astype(np.int32) for r, p in zip(counts, places, strict=True)], pa.list_(pa.int32())),
                    ],
                    ["lang", "cut", "place", "n"],
                )


def fit(labelled: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """A model from about ``per_lang`` rows of each language; only their n-gram counts reach the driver."""
    text_batches(labelled.sparkSession)
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col)).agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return fit_model([], np.zeros((0, DIM)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))])
    drawn = labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000)) < F.element_at(share, F.col(lang_col)) * 1_000_000)
    rows = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(tidy(_counted), "lang string, cut int, place array<int>, n array<int>").collect()
    rows.sort(key=lambda r: (r["lang"], r["place"], r["n"]))

    def dense(part: list) -> tuple[list[str], np.ndarray]:
        counts = np.zeros((len(part), DIM))
        for i, r in enumerate(part):
            counts[i, r["place"]] = r["n"]
        return [r["lang"] for r in part], counts

    cut = [r for r in rows if r["cut"] and r["place"]]
    return fit_model(*dense([r for r in rows if not r["cut"]]), cuts=(dense(cut[i : i + 500]) for i in range(0, len(cut), 500)))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """The id, held_out, lang_pred, score and rejected of each row of ``docs``, after learning from those not held out."""
    text, key = F.col(text_col), F.col(id_col)
    labelled = docs.where(F.col(lang_col).isNotNull() & key.isNotNull() & ~is_held_out(key))
    model = fit(labelled, id_col=id_col, text_col=text_col, lang_col=lang_col, per_lang=per_lang)
    rows = docs.select(key.alias("id"), is_held_out(key).alias("held_out"), has_letter(text).alias("letters"), text.alias("text"))
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean"
    names = np.array([*model.langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in utf8_chunks(pc.utf8_lower(batch.column("text"))):
                part = batch.select(["id", "held_out", "letters"]).slice(a, b - a)
                known = np.asarray(part.column("letters")) & (len(model.langs) > 0)
                lang, score, rejected = np.full(b - a, len(model.langs)), np.zeros(b - a), np.ones(b - a, bool)
                if known.any():
                    lang[known], score[known], rejected[known] = (v[known] for v in model.predict(gram_counts(data, offsets)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(names[lang], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(rejected)],
                    [id_col, "held_out", "lang_pred", "score", "rejected"],
                )

    return rows.mapInArrow(tidy(run), schema)


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is identified and not rejected, in one pass over the texts."""
    key = F.col(id_col)
    labelled = docs.where(F.col(lang_col).isNotNull() & key.isNotNull() & ~is_held_out(key))
    model = fit(labelled, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not model.langs:
        return docs.limit(0)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.where(has_letter(F.col(text_col))).select(row.alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in utf8_chunks(pc.utf8_lower(batch.column("text"))):
                _, _, rejected = model.predict(gram_counts(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a).filter(pa.array(~rejected))], ["row"])

    kept = rows.mapInArrow(tidy(run), f"row {rows.schema['row'].dataType.simpleString()}")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
