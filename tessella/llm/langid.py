"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, with_workers

#: A dictionary holds one excerpt from each of so many slots of documents, so long each.
#: This bounds what is learned from a language at SLOTS * EXCERPT characters.
SLOTS, EXCERPT = 512, 1024
#: A text is compressed in blocks of so many bytes, so a long text can't learn from itself
#: more than from the dictionary.
BLOCK = 2048
#: Lazy matching that also takes matches of three bytes: syllables count.
LEVEL, SHORTEST = 6, 3
#: Zstandard stores very short blocks raw, so each block, of any length, is followed by so
#: many bytes of itself, over and over; the repeats cost every language the same.
REPEATED = 256
#: A text is rejected if its second-best size exceeds the best by at most so many square
#: roots of the best: sizes vary about so with their own length, so one rule fits all
#: lengths. Of 3358 held-out documents it rejects 6, of which 5 have a wrong language.
NARROW = 0.15
UNKNOWN = "und"
NAMES = ("lang_pred", "score", "rejected")


def _letters(text: str) -> str:
    """What is compressed: lower case, runs of other characters than letters as one space."""
    return _other(" ", text.lower()).strip()


_other = regex.compile(r"[^\p{L}\p{M}]+").sub
_letter = regex.compile(r"\p{L}").search


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", slots: int = SLOTS, excerpt: int = EXCERPT) -> dict[str, bytes]:
    """Raw dictionary content of each language, from a bounded sample of labelled rows.

    Each language's rows are dealt into ``slots`` by a hash of the text, and of each slot
    the row of least hash gives an excerpt, from a place that its hash chooses. The
    aggregation combines before its shuffle; the driver gets ``slots`` excerpts a
    language, of any input.
    Rows without language or text are not learned from.
    """
    text = F.col(text_col)
    hashed = docs.where(F.col(lang_col).isNotNull() & text.isNotNull() & (F.length(text) > 0)).select(
        F.col(lang_col).alias("lang"),
        F.xxhash64(text).alias("h"),
        F.substring(text, F.pmod(F.xxhash64(text, F.lit("place")), F.greatest(F.lit(1), F.length(text) - excerpt + 1)).cast("int") + 1, F.lit(excerpt)).alias("excerpt"),
    )
    rows = (
        hashed.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot"))
        .agg(F.min_by("excerpt", F.struct("h", "excerpt")).alias("excerpt"))
        .orderBy("lang", "slot")
        .collect()
    )
    parts: dict[str, list[str]] = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(_letters(r["excerpt"]))
    return {lang: " ".join(x).encode() for lang, x in parts.items()}


class Compressors:
    """One zstandard compressor for each language."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL) -> None:
        self.langs = sorted(content)
        self.of = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                level, source_size=BLOCK + REPEATED, dict_size=len(content[lang]), min_match=SHORTEST, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            d.precompute_compress(compression_params=how)
            self.of.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))

    def sizes(self, raw: bytes, block: int = BLOCK) -> np.ndarray:
        parts = [raw[k : k + block] + b" " for k in range(0, len(raw), block)]
        parts = [x + (x * (REPEATED // len(x) + 1))[:REPEATED] for x in parts]
        return np.array([sum(len(c.compress(x)) for x in parts) for c in self.of], np.int64)

    def predict(self, text: str | None, narrow: float = NARROW) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected. Ties go to the first in alphabet."""
        if not text or not self.langs or not _letter(text):
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        sizes = self.sizes(_letters(text).encode())
        best, second = np.partition(sizes, 1)[:2].tolist()
        return self.langs[int(np.argmin(sizes))], float(1 - 0.5 * np.exp(-25 * (second - best) / second)), second - best <= narrow * best**0.5


_made: dict[int, Compressors] = {}


def classify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), narrow: float = NARROW, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``<id>, [keep...,] lang_pred, score, rejected`` for each row; narrow, over whole texts.

    ``und`` with score 0, rejected: null text or no letter (also where nothing was learned).
    A text with a narrow margin, by one rule for all lengths, is rejected but still gets
    the best language. Texts of any length go block by block; ties go to the first
    language in alphabet and are rejected; repeated rows and null ids pass row by row, as
    do the columns of ``keep``; where one of those has the name of a result, give other
    ``names``. An empty table gives an empty result.
    """
    kept = list(dict.fromkeys([id_col, *keep]))
    key = hash(tuple(sorted(content.items())))
    shared = docs.sparkSession.sparkContext.broadcast(content)  # SLOTS * EXCERPT characters a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:
            _made.clear()
            _made[key] = Compressors(shared.value)
        for batch in batches:
            found = [_made[key].predict(x, narrow) for x in batch.column(0).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch(
                [*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*kept, *names],
            )

    schema = T.StructType([*(docs.schema[c] for c in kept), *map(T.StructField, names, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    return with_workers(docs).select(docs[text_col].cast("string").alias(free(kept, "text")[0]), *kept).mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold
