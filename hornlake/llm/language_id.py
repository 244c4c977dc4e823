"""Language identification by compression.

Each language has a zstandard raw-content dictionary of labelled text.  A text's words of letters, in lower case, are
cut into blocks; each block is compressed with every dictionary, and the language whose dictionary makes the text
smallest is chosen.  Every text's first `HEAD` bytes are compressed once more from each of several starts, for sizes
finer than a byte; the rule is one for all lengths, and in a long text that part hardly counts.  The margin,
the saving against the runner-up as a share of the runner-up's size, is the score; a text whose margin is narrow is
rejected.  Whole texts are compressed: blocks only keep the dictionary, not the text's own past, decisive.

The dictionaries are fitted on a bounded sample: of each language `sample_docs` labelled texts, low in a hash,
`sample_chars` characters of each, `dictionary_bytes` in all.  Everything else covers all rows.

Defined results: null text and text without a letter are `und` with score 0 and rejected.  A tie goes to the
language first in order, with score 0.  Without any labelled text all rows are `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornlake.llm.shared import hash_sample, prepare

UNDETERMINED = "und"
BLOCK, HEAD = 2048, 96
STARTS = [*range(2, 32, 2), *range(32, HEAD, 8)]

_letters = re.compile(r"[^\W\d_]+").findall


def normal(text: str) -> bytes:
    """What is compressed: the runs of letters in lower case, joined by spaces."""
    return " ".join(_letters(text.lower())).encode()


def fit_dictionaries(docs: DataFrame, labelled: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 160, sample_chars: int = 600, dictionary_bytes: int = 64_000) -> dict[str, bytes]:
    """A raw-content dictionary for each label; reads only rows for which `labelled` holds."""
    rows = docs.filter(labelled & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    start = rows.select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, sample_chars).alias("text"))
    out: dict[str, list[str]] = {}
    for row in sorted(hash_sample(start, "text", sample_docs, "lang").collect(), key=lambda r: (r["lang"], r["h"])):
        out.setdefault(row["lang"], []).append(row["text"])
    return {lang: b"\n".join(dict.fromkeys(map(normal, texts[:sample_docs])))[:dictionary_bytes] for lang, texts in sorted(out.items())}


class Classifier:
    """Sizes of a text under each dictionary, and the choice by them."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK):
        import zstandard as z

        self.langs, self.block = sorted(dictionaries), block
        params = z.ZstdCompressionParameters.from_level(3, strategy=z.STRATEGY_LAZY2, min_match=3, window_log=17, hash_log=16, chain_log=16, search_log=4, format=z.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.compress = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress for lang in self.langs]

    def sizes(self, text: str) -> list[int]:
        raw = normal(text)
        pieces = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        pieces += [raw[i:HEAD] for i in STARTS if i < len(raw)]
        return [sum(map(len, map(f, pieces))) for f in self.compress]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        ranked = sorted(zip(self.sizes(text), self.langs, strict=True))
        if len(ranked) == 1:
            return ranked[0][1], 1.0
        return ranked[0][1], (ranked[1][0] - ranked[0][0]) / ranked[1][0]


@lru_cache(4)
def _classifier(dictionaries: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dict(dictionaries))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", margin: float = 0.005) -> DataFrame:
    """All columns of `docs`, then lang_pred, score and rejected (score < margin, or undetermined), in place of any of those names."""
    prepare(docs.sparkSession)
    key = tuple(sorted(dictionaries.items()))
    broadcast = docs.sparkSession.sparkContext.broadcast(key)
    names = ["lang_pred", "score", "rejected"]
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hornlake.llm.language_id import _classifier

        classifier = _classifier(broadcast.value)
        for batch in batches:
            out = [classifier.predict(t.as_py()) for t in batch.column(at)]
            lang, score = pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())
            rejected = pa.array([x == UNDETERMINED or s < margin for x, s in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, score, rejected], names=[*batch.schema.names, *names])

    from pyspark.sql import types as T

    return docs.mapInArrow(predicted, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: a quarter of all ids, by a checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
