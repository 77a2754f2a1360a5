"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's (or document's) most frequent n-grams,
one to three letters with a blank at word bounds, by falling count. A
document gets the language whose profile has the least out-of-place
distance: the sum, over the document's n-grams, of how far apart the two
ranks are, or the profile's length where the language lacks the n-gram.

An n-gram is one long: three code points of 21 bits each, so every script
is counted exactly. Profiles are trained on every training row: each task
counts its own batches, Spark sums them by language and n-gram, and only
``size`` n-grams a language reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE_SIZE = 400
#: Characters of a long text whose n-grams are made at once.
PIECE = 1 << 20
#: Code points, or distinct n-grams, of a language that a task holds before it sums, or sends, them.
COUNT_CODES = 500_000
UNDETERMINED = "und"
_BITS = 21
_BLANK = 32
_SPACE = re.compile(r"\s")


@lru_cache(1)
def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points, one blank around each word."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    padded = np.full(len(raw) + 2, _BLANK, dtype=np.int64)
    padded[1:-1] = np.where(_letters()[raw], raw, _BLANK)
    blank = padded == _BLANK
    return padded[~(blank & np.concatenate(([False], blank[:-1])))]


def _grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of one to three; a blank only at an end, never alone."""
    if len(codes) < 3:
        return codes[:0]
    two = codes[:-1] << _BITS | codes[1:]
    three = (two[:-1] << _BITS | codes[2:])[codes[1:-1] != _BLANK]
    return np.concatenate((codes[codes != _BLANK], two, three))


def pieces(text: str) -> Iterable[str]:
    """A long text in pieces that end behind white space; they have the same
    n-grams together, as a blank stands around every word."""
    at = 0
    while len(text) - at > PIECE:
        cut = _SPACE.search(text, at + PIECE)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return grams, np.bincount(at, np.concatenate((a[1], b[1]))).astype(np.int64)


def document_profile(text: str | None, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent n-grams of a whole text, ties by code; empty if no letter."""
    total = None
    for piece in pieces(text or ""):
        own = np.unique(_grams(_codes(piece)), return_counts=True)
        total = own if total is None else _merged(total, own)
    grams, counts = total
    order = np.argsort(-counts, kind="stable")[:size]
    return grams[order]


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text), summed by Spark."""

    def count(batches: Iterable):
        import pyarrow as pa

        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def summed(lang: str) -> None:
            # Each text ends and starts with a blank: joined texts make no other n-gram.
            codes = waiting.pop(lang)
            joined = np.concatenate([c if i == 0 else c[1:] for i, c in enumerate(codes)])
            own = np.unique(_grams(joined), return_counts=True)
            sums[lang] = _merged(sums[lang], own) if lang in sums else own
            sizes[lang] = 0

        def rows_of(lang: str):
            grams, n = sums.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                for codes in map(_codes, pieces(text.as_py())):
                    waiting.setdefault(lang, []).append(codes)
                    sizes[lang] = sizes.get(lang, 0) + len(codes)
                    if sizes[lang] >= COUNT_CODES:
                        summed(lang)
                        if len(sums[lang][0]) >= COUNT_CODES:
                            yield rows_of(lang)
        for lang in list(waiting):
            summed(lang)
        for lang in list(sums):
            yield rows_of(lang)

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Rank profiles by language, ready to score documents."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.languages, self.size = sorted(profiles), size
        # Postings by n-gram: which languages hold it, at which rank.
        grams = np.concatenate([np.zeros(0, np.int64), *(np.array(profiles[x], dtype=np.int64) for x in self.languages)])
        owner = np.repeat(np.arange(len(self.languages)), [len(profiles[x]) for x in self.languages])
        rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(profiles[x])) for x in self.languages)])
        order = np.argsort(grams, kind="stable")
        self.grams, starts = np.unique(grams[order], return_index=True)
        self.starts = np.append(starts, len(grams))
        self.owner, self.rank = owner[order].astype(np.int32), rank[order].astype(np.int32)

    def distances(self, profile: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language: the full length for every
        n-gram, less what a language that holds it is nearer."""
        whole = np.full(len(self.languages), len(profile) * self.size, dtype=np.int64)
        if not len(self.grams):
            return whole
        at = np.minimum(np.searchsorted(self.grams, profile), len(self.grams) - 1)
        own = np.flatnonzero(self.grams[at] == profile)
        counts = self.starts[at[own] + 1] - self.starts[at[own]]
        flat = np.repeat(self.starts[at[own]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        nearer = self.size - np.abs(self.rank[flat] - np.repeat(own, counts))
        return whole - np.bincount(self.owner[flat], nearer, len(self.languages)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float, float | None]:
        """Language, confidence from 0 to 1, and mean distance from 0 to 1."""
        profile = document_profile(text, self.size)
        if not len(profile) or not self.languages:
            return UNDETERMINED, 0.0, None
        d = self.distances(profile) / (len(profile) * self.size)
        best = int(np.argmin(d))
        others = np.delete(d, best)
        sure = 1.0 if not len(others) else float(others.min() / (others.min() + d[best])) if others.min() > 0 else 0.5
        return self.languages[best], sure, float(d[best])


def train(rows: DataFrame, size: int = PROFILE_SIZE) -> LanguageModel:
    """Profiles from every row of (lang, text); rows without a lang or text teach nothing."""
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = count_grams(rows.where("lang IS NOT NULL")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in kept.orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(r.lang, []).append(r.gram)
    return LanguageModel(profiles, size)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``distance``, from the text alone.

    Null or letterless text gives ``und``, score 0 and a null distance. All
    columns are kept; three are added (an equal name is replaced). Repeated
    rows give repeated results; no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    added = ["lang_pred", "score", "distance"]
    kept = docs.drop(*added)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("distance", T.DoubleType())])
    place = kept.columns.index(text)

    def run(batches: Iterable):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            found = list(zip(*(m.predict(t.as_py()) for t in batch.column(place)))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.float64())], names=schema.fieldNames())

    return kept.mapInArrow(run, schema)


def held_out_split(doc_id: Column, folds: int = 4, held: int = 2) -> Column:
    """True for held-out ids; a null id is not held out (and teaches nothing)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def identify(docs: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """Train on the labelled rows that aren't held out, predict every row."""
    split = held_out_split(F.col("doc_id"))
    model = train(docs.where(F.col("doc_id").isNotNull() & ~split).select("lang", "text"), size)
    slim = docs.select("doc_id", split.alias("held_out"), "text")
    return predict(slim, model).drop("text")


#: Mean distance above which the pipeline takes a text of at least so many
#: n-grams for no known language.
REJECT_DISTANCE = 0.8


def keep_identified(docs: DataFrame, reject_distance: float = REJECT_DISTANCE) -> DataFrame:
    """Rows whose text is in a known language, with the columns of ``docs``.

    Rejected are texts without any letter, null texts, and texts whose
    distance to the nearest profile is above ``reject_distance``. Where no
    labelled row teaches a profile, only the first two can be rejected.
    """
    split = held_out_split(F.col("doc_id"))
    model = train(docs.where(F.col("doc_id").isNotNull() & ~split).select("lang", "text"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = predict(docs, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("distance") <= reject_distance))
    return kept.select(*docs.columns)
