"""Language ID with language-bitmask n-gram filters.

Each language has the set of its most frequent byte n-grams. All sets share one
bit-sliced Bloom filter: a slot holds a mask with a bit per language, and the AND
of an n-gram's slots names every language that has it. For every text the bits
are counted per language; the counts, corrected for the filter's false
positives, decide.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.llm.shared import share_model
from fleetscope.llm.words import by_bytes, mix

SIZES = (3, 4, 5)
#: n-grams kept for each language.
TOP = 5_000
#: Labelled documents of a language to learn from, about: the bound of the training sample.
SAMPLE = 3_000
PROBES = 3
#: Slots for each kept n-gram.
ROOM = 24
PIECE = 1 << 20
#: Bytes of text that a task works on at once; a longer text is alone.
HELD = 4 << 20
UNKNOWN = "und"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def _flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as one byte array with runs of other ASCII characters as one space, and offsets."""
    encoded = [(" " + (text or "").lower() + " ").encode() for text in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
    data = _PLAIN[np.frombuffer(b"".join(encoded), np.uint8)]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offsets[:-1]] = True
    lengths = np.add.reduceat(keep, offsets[:-1], dtype=np.int64) if len(texts) else []
    return data[keep], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _grams(data: np.ndarray, starts: np.ndarray, size: int, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the n-grams that begin in [at, end) and stay in one text. starts: where texts begin."""
    end = min(end, len(data) - size + 1)
    if end <= at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(end - at, np.uint64(size), np.uint64)
    inside = np.ones(end - at, bool)
    for i in range(size):
        h = (h << np.uint64(8)) | data[at + i : end + i]
        if i:
            inside &= ~starts[at + i : end + i]
    places = np.flatnonzero(inside)
    return places + at, mix(h[places])


def _slots(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return [(grams + np.uint64(i) * step) & np.uint64(slots - 1) for i in range(PROBES)]


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filter over the n-grams of up to 64 languages a plane."""

    langs: list[str]
    planes: list[np.ndarray]
    false_rate: np.ndarray

    @classmethod
    def build(cls, langs: list[str], grams: list[np.ndarray]) -> LanguageFilter:
        most = max([len(g) for g in grams], default=1)
        slots = 1 << int(np.ceil(np.log2(max(64, most * ROOM))))
        planes, rates = [], []
        for first in range(0, max(len(langs), 1), 64):
            part = grams[first : first + 64]
            kind = np.uint8 if len(part) <= 8 else np.uint64
            plane = np.zeros(slots, kind)
            for bit, own in enumerate(part):
                for slot in _slots(own, slots):
                    plane[slot] |= kind(1 << bit)
                rates.append(float(np.mean((plane >> kind(bit)) & kind(1))) ** PROBES)
            planes.append(plane)
        return cls(langs, planes, np.array(rates))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its share of all corrected counts) for each text."""
        data, offsets = _flat(texts)
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets] = True
        hits = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        for at in range(0, len(data), PIECE):
            for size in SIZES:
                places, grams = _grams(data, starts, size, at, at + PIECE)
                lo = np.searchsorted(offsets, places[0], "right") - 1 if len(places) else 0
                hi = np.searchsorted(offsets, places[-1], "right") if len(places) else 0
                bounds = np.searchsorted(places, offsets[lo : hi + 1])
                total[lo:hi] += np.diff(bounds)
                slots = _slots(grams, len(self.planes[0]))
                for number, plane in enumerate(self.planes):
                    mask = plane[slots[0]]
                    for slot in slots[1:]:
                        mask &= plane[slot]
                    for bit in range(min(64, len(self.langs) - 64 * number)):
                        count = np.concatenate([[0], np.cumsum((mask >> plane.dtype.type(bit)) & plane.dtype.type(1), dtype=np.int64)])
                        hits[lo:hi, 64 * number + bit] += np.diff(count[bounds])
        rate = self.false_rate
        fixed = np.maximum(hits - total[:, None] * rate, 0) / (1 - rate)
        best = fixed.argmax(1)
        whole = fixed.sum(1)
        return best, np.where(whole > 0, fixed.max(1) / np.maximum(whole, 1e-9), 0.0)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of labelled(lang, text), with the top ``TOP`` of each language."""

    def count(batches):
        for batch in (part for whole in batches for part in by_bytes(whole, 1, HELD)):
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                data, offsets = _flat([texts[i] for i in np.flatnonzero(langs == lang)])
                starts = np.zeros(len(data) + 1, bool)
                starts[offsets] = True
                for at in range(0, len(data), PIECE):
                    found = np.concatenate([_grams(data, starts, size, at, at + PIECE)[1] for size in SIZES])
                    grams, n = np.unique(found.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": n.astype(np.int64)}
                    )

    counts = labelled.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= TOP)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageFilter:
    """Learns from labelled rows: about ``sample`` documents a language, chosen by a hash of the id.

    Rows without language or text are left out. What comes to the driver is at most ``TOP`` n-grams a language.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(sample / n))]) if sizes else None
    if not sizes:
        return LanguageFilter.build([], [])
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    rows = gram_counts(labelled.where(place < chance[F.col("lang")])).select("lang", "gram").toArrow()
    names, grams = rows.column("lang").to_pylist(), rows.column("gram").to_numpy().view(np.uint64)
    names = np.array(names, object)
    langs = sorted(sizes)
    return LanguageFilter.build(langs, [grams[names == lang] for lang in langs])


def predict(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (replaced if there).

    ``und`` with score 0 for a null text or one without a letter, or if nothing was
    learned. A text with letters but no known n-gram gets the first language, score 0.
    Ties go to the first language by code point.
    """
    rest = docs.drop("lang_pred", "score")
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    shared = share_model(docs.sparkSession, model)
    known = bool(model.langs)

    def run(batches):
        own = pickle.loads(shared.value)
        for batch in (part for whole in batches for part in by_bytes(whole, at, HELD)):
            letters = batch.column(batch.num_columns - 1).to_pylist()
            best, share = own.score(batch.column(at).to_pylist()) if known else ([0] * len(letters), [0.0] * len(letters))
            pred = [own.langs[b] if has and known else UNKNOWN for b, has in zip(best, letters)]
            score = [float(s) if has else 0.0 for s, has in zip(share, letters)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"],
            )

    at = rest.columns.index(text_col)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    flag = "_letters"
    while flag in rest.columns:
        flag += "_"
    return rest.withColumn(flag, has_letter).mapInArrow(run, T.StructType([*rest.schema, *added]))
