"""Statistics of whole documents, counted over UTF-8 bytes in Arrow batches."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FileNumbers, map_arrow, text_batches, with_rid

#: Counts of a text, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_letters", "n_digits", "n_shouts", "n_stops", "n_same_next", "n_distinct")
#: Statistics that models are fitted on, in this order.
FEATURES = ("log_words", "word_length", "symbols", "shouts", "upper", "digits", "stops",
            "same_next", "distinct", "repeats", "dup_lines")
WINDOW = 8


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5)))
_BYTES = {
    "n_symbols": _table(b"#*$%&|<>"), "n_upper": _UPPER, "n_letters": _LETTER,
    "n_digits": _table(b"0123456789"), "n_shouts": _table(b"!"), "n_stops": _table(b".,;:?"),
    "word_chars": _table(bytes(b for b in range(256) if not 0x80 <= b < 0xC0 and b != 32 and not 9 <= b <= 13)),
}


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` (a power of two) words found twice or more, the first included."""
    step, grams = 1, ids
    while step < window:
        if len(grams) <= step:
            return 0
        pairs = grams[:-step] * (int(grams.max()) + 1) + grams[step:]
        kinds, grams = np.unique(pairs, return_inverse=True)
        if len(kinds) == len(pairs):
            return 0
        step *= 2
    again = np.bincount(grams)[grams] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Each of ``COUNTS`` for each text; null counts as empty."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.array([len(t) for t in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin, full = np.cumsum(sizes) - sizes, sizes > 0
    out = {n: np.zeros(len(raw), np.int64) for n in COUNTS}
    if full.any():
        for name, table in _BYTES.items():
            out[name][full] = np.add.reduceat(table[data], begin[full], dtype=np.int64)
    for k, t in enumerate(raw):
        words = t.split()  # bytes split at ASCII white space only
        kinds = defaultdict(count().__next__)
        ids = np.fromiter(map(kinds.__getitem__, words), np.int64, len(words))
        lines = [x for x in t.split(b"\n") if x.strip()]
        out["n_words"][k] = len(words)
        out["n_distinct"][k] = len(kinds)
        out["n_lines"][k] = len(lines)
        out["n_dup_lines"][k] = len(lines) - len(set(lines))
        out["n_same_next"][k] = (ids[1:] == ids[:-1]).sum()
        out["n_repeat_words"][k] = repeated_words(ids)
    return out


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, a row per text, defined for empty texts too.

    Shares are taken over the count plus a constant, so that a few characters of a tiny text
    weigh little, and square roots even out their spread.
    """
    words, chars = c["n_words"].astype(float), c["word_chars"].astype(float)
    share = lambda n, of, more: np.sqrt(n / (of + more))
    return np.column_stack([
        np.log1p(words),
        np.log((chars + 50) / (words + 10)),
        share(c["n_symbols"], chars, 50), share(c["n_shouts"], chars, 50),
        share(c["n_upper"], c["n_letters"], 50), share(c["n_digits"], chars, 50),
        share(c["n_stops"], chars, 50), share(c["n_same_next"], words, 10),
        np.log1p(c["n_distinct"]) - np.log1p(words) * 0.9,
        share(c["n_repeat_words"], words, 10), share(c["n_dup_lines"], c["n_lines"], 3)])


def document_stats(docs: DataFrame, names: tuple[str, ...], *, id_col: str = "doc_id",
                   text_col: str = "text", file_no: FileNumbers | None = None) -> DataFrame:
    """(_rid, id, features array<double>, and the counts in ``names``) of each row."""
    schema = "_rid long, id long, features array<double>" + "".join(f", {n} long" for n in names)

    def make(batches):
        for batch in text_batches(batches):
            c = counts(batch["text"])
            f = features(c)
            cols = {"_rid": batch["_rid"], "id": batch["id"],
                    "features": pa.FixedSizeListArray.from_arrays(
                        pa.array(f.ravel()), f.shape[1]).cast(pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(cols | {n: pa.array(c[n]) for n in names})

    rows = with_rid(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
                    file_no)
    return map_arrow(rows.select("_rid", "id", "text"), make, schema)
