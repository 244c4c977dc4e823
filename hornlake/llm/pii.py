"""Personal data: spans by fixed patterns, and further ones by a character-level BiLSTM-CRF.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass the kind's check.  The model
(tagger.py) is trained in numpy when first used, with a fixed seed, on labelled spans: sentences of invented words
with values of each kind, and a bounded sample of `sample_docs` documents (low in a hash of their beginnings,
`sample_chars` characters of each) labelled with their base spans.  It reads every text wherever a value can be: around
an at sign, also a spelled one, and around four digits within 16 characters (`possible`); no other character can be of a
span.  A text's labels are the best sequence for the whole text; a run of one label becomes a span if it can be of its
kind and touches no base span.  Base spans always stay.

Defined results: null and empty texts have no spans.  Offsets are code points, ends exclusive.  The operator's
columns replace columns of the same names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornlake.llm.pii_examples import KINDS, Examples
from hornlake.llm.shared import hash_sample, prepare
from hornlake.llm.tagger import Weights, classes, loaded, packed, train

Span = tuple[int, int, str]

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A dotted number's leftmost match begins where its digits begin, so no start inside a run of digits is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
# A run of fewer than 12 digits fails the check in any case.
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    parts = text.split(".")
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _emails(text: str) -> Iterator[Span]:
    """The matches of local part, @ and host, found from the @ signs: a local part holds none."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done, "email"
        else:
            done = max(done, at + 1)  # a match that begins later begins behind this sign
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """By start, then by kind as listed."""
    out = list(_emails(text)) if "@" in text else []
    for kind, pattern, holds in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if holds(m[0])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_AT = re.compile(r"@|\bat\b|\[at\]|\(at\)", re.I)
_DOT = re.compile(r"\.|\bdot\b|\[dot\]|\(dot\)", re.I)
_SEPARATED_PHONE = re.compile(r"[+(]?[0-9][0-9 ().-]*[ ().-][0-9 ().-]*[0-9]")


def plausible(kind: str, text: str) -> bool:
    """Whether a span that the model proposes can be of its kind."""
    if kind == "email":
        parts = _AT.split(text)
        return len(parts) == 2 and len(text.split()) <= 7 and bool(re.search(r"\w", parts[0])) and bool(_DOT.search(parts[1])) and ("@" in text or bool(re.search(r"[\[(]at|\bdot\b", text, re.I)))
    if kind == "ip":
        groups = re.findall(r"[0-9]+", text)
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and text.count(".") >= 3 and not re.search(r"[^\W\d_]", text)
    if kind == "card":
        return not re.search(r"[^0-9 ./-]", text) and _is_card(text)
    return bool(_SEPARATED_PHONE.fullmatch(text)) and _is_phone(text)


_SPELLED = re.compile(r"[\[(]at|\bdot\b", re.I)


def possible(texts: list[str]) -> np.ndarray:
    """The places, in the joined texts, of characters that a span other than a base span must have near."""
    joined = "".join(texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    digit = (c >= 48) & (c <= 57)
    sums = np.concatenate([[0], np.cumsum(digit)])
    ahead = sums[np.minimum(np.arange(len(c)) + 16, len(c))] - sums[:-1]
    at = np.flatnonzero((digit & (ahead >= 4)) | (c == 64))
    return np.union1d(at, np.array([m.start() for m in _SPELLED.finditer(joined)], np.int64)).astype(np.int64)


_RUNS = re.compile(rb"\x01+|\x02+|\x03+|\x04+")


def model_spans(text: str, labels: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of a label that can be of its kind, without outer spaces and punctuation, clear of base spans."""
    out = []
    for run in _RUNS.finditer(labels.tobytes()):
        a, b = run.span()
        kind = KINDS[labels[a] - 1]
        while a < b and text[a] in " ,;:.\n\t":
            a += 1
        while a < b and text[b - 1] in " ,;:.\n\t":
            b -= 1
        if a < b and plausible(kind, text[a:b]) and not any(x < b and a < y for x, y, _ in base):
            before, after = text[a - 1 : a] if a else "", text[b : b + 1]
            # A word may run into a number, but a value is not cut out of a longer number or name.
            if not (before.isdigit() or after.isalnum() or (kind == "email" and before.isalnum())):
                out.append((a, b, kind))
    return out


def fit(docs: DataFrame, *, text_col: str = "text", sample_docs: int = 400, sample_chars: int = 2000, steps: int = 400, batch: int = 160, length: int = 56, seed: int = 1) -> Weights:
    """Weights of the tagger; two thirds of the training text are generated, the rest is the sample."""
    start = docs.select(F.substring(F.col(text_col), 1, sample_chars).alias("t"))
    rows = sorted((r["h"], r["t"]) for r in hash_sample(start, "t", sample_docs).collect())[:sample_docs]
    return dict(_fitted("\n".join(t for _, t in rows), steps, batch, length, seed))


@lru_cache(2)
def _fitted(sample: str, steps: int, batch: int, length: int, seed: int) -> Weights:
    x, y = classes(sample), np.zeros(len(sample), np.int64)
    for a, b, kind in base_spans(sample):
        y[a:b] = 1 + KINDS.index(kind)
    made = Examples(seed).batches(steps, batch, length)
    rng = np.random.default_rng(seed)

    def mixed():
        for own_x, own_y in made:
            if len(x) > length:
                part = batch // 3
                at = rng.integers(0, len(x) - length, part)[None, :] + np.arange(length)[:, None]
                own_x, own_y = own_x.copy(), own_y.copy()
                own_x[:, :part], own_y[:, :part] = x[at], y[at]
            yield own_x, own_y

    return train(mixed(), 1 + len(KINDS))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or group of overlapping spans, replaced by the first one's kind in brackets."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, weights: Weights, *, text_col: str = "text", redact: bool = False, group_chars: int = 1 << 18) -> DataFrame:
    """All columns of `docs`, then `spans` in order of start and kind; with `redact` the text has them replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop("spans")
    broadcast = docs.sparkSession.sparkContext.broadcast(packed(weights))
    names, at = docs.columns, docs.columns.index(text_col)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hornlake.llm.words import slices

        tagger = loaded(broadcast.value)
        for part in slices(batches, text_col, group_chars):
            given = part.column(at).to_pylist()
            texts = [t or "" for t in given]
            rows, columns = [], list(part.columns)
            for k, (text, labels) in enumerate(zip(texts, tagger.tag(texts, possible(texts)), strict=True)):
                base = base_spans(text)
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in model_spans(text, labels, base)], key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"kind": kind, "start": a, "end": b, "base": own} for a, b, kind, own in spans])
                if redact and spans:
                    given[k] = redacted(text, [s[:3] for s in spans])
            if redact:
                columns[at] = pa.array(given, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _SPANS)], names=[*names, "spans"])

    return docs.mapInArrow(found, T.StructType([*docs.schema.fields, T.StructField("spans", SPANS)]))
