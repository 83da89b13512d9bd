"""Toxicity by compression distance: which of two zstandard dictionaries makes a text's windows shorter.

Both dictionaries end with the same content, which zstandard's trainer selects from ordinary text; in front of it
stand the segments by which one class differs from the other, so a difference in length comes from these alone.
The differences of a text's windows make three figures, and a logistic calibration on labelled rows that the
dictionaries have not seen turns them into a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import prepare, whole

#: Labelled rows that dictionaries (of each class) and calibration are fitted on at most, chosen by a hash of the
#: id; rows of longer texts are not chosen, and no more text of a class than this many characters.
TOXIC_ROWS, ORDINARY_ROWS, CALIBRATION_ROWS, ROW_CHARS, CLASS_CHARS = 2000, 3000, 4000, 16_000, 12_000_000
#: Bytes of a window, of the common content, and of what is told apart by its counts.
WINDOW, COMMON, GRAM = 128, 16_384, 6
FOLDS = 5
#: Windows that the trainer of the common dictionary sees at most.
WINDOWS = 60_000


@dataclass(frozen=True)
class Model:
    """Two raw dictionaries and the weights of the calibration: constant first, then one per figure."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def normalised(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().split()) + b" "


def windows_of(data: bytes, size: int = WINDOW) -> list[bytes]:
    """The text cut before ``size`` bytes, at a space in the second half of a window if there is one."""
    made, at = [], 0
    while at < len(data):
        end = at + size
        if end < len(data) and (space := data.rfind(b" ", at + size // 2, end)) > 0:
            end = space
        made.append(data[at:end])
        at = end
    return made


def compressor(content: bytes):
    params = zs.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=32,
        strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    if not content:
        return zs.ZstdCompressor(compression_params=params).compress
    dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=dictionary, compression_params=params).compress


def figures(text: str, ordinary, toxic) -> list[float]:
    """Mean, largest and summed saving of the toxic dictionary over the text's windows, on a log scale."""
    saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows_of(normalised(text))], float)
    kept = [max(saved.mean() * 10, 0), max(saved.max(), 0), np.maximum(saved - 3, 0).sum()]
    return [float(np.log1p(x)) for x in kept]


def _grams(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(raw) - GRAM + 1)
    made = np.zeros(n, np.uint64)
    for i in range(GRAM):
        made = (made << np.uint64(8)) | raw[i : i + n]
    return made


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    each = [np.unique(_grams(x)) for x in texts]
    return np.unique(np.concatenate(each), return_counts=True)


def _segments(own: list[bytes], other: list[bytes], counted, against, size: int) -> bytes:
    """Stretches of ``own`` texts whose grams are far more frequent there; the most frequent stretch comes last."""
    (grams, n), (others, m) = counted, against
    at = np.minimum(np.searchsorted(others, grams), len(others) - 1)
    m = np.where(others[at] == grams, m[at], 0)
    total = len(own) + len(other)
    share = (n + m) / total
    spread = np.sqrt(np.maximum(len(own) * share * (1 - share) * len(other) / total, 1e-9))
    z = (n - len(own) * share) / spread
    good = (z > 4.5) & (n >= 3) & (n / len(own) > 8 * (m + 0.5) / len(other))
    if not good.any():
        return b""
    good &= z > 0.25 * z[good].max()
    chosen, found = grams[good], Counter()
    for text in own:
        codes = _grams(text)
        if not len(codes):
            continue
        hit = chosen[np.minimum(np.searchsorted(chosen, codes), len(chosen) - 1)] == codes
        cover = np.zeros(len(text) + 1, np.int64)
        starts = np.flatnonzero(hit)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + GRAM, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover)[:-1] > 0, [0]]).astype(np.int8)))
        found.update(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    kept, used = [], 0
    for segment, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if used + len(segment) > size:
            break
        if not any(segment in x for x in kept):
            kept.append(segment)
            used += len(segment)
    return b"".join(reversed(kept))


def _distinct(texts: list[str], held: int = CLASS_CHARS) -> list[bytes]:
    """Normalised texts without near copies, up to a total length.

    Of texts with the same smallest word hash one is kept, so unrelated ones that share that word go too.
    """
    made, seen, used = [], set(), 0
    for text in texts:
        data = normalised(text)
        mark = min((zlib.crc32(w) for w in data.split()), default=0)
        if mark not in seen and used + len(data) <= held:
            seen.add(mark)
            made.append(data)
            used += len(data)
    return made


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Weights for the figures as they are, of a ridge regression on standardised figures by Newton steps."""
    mean, sd = x.mean(0), x.std(0) + 1e-6
    a = np.c_[np.ones(len(x)), (x - mean) / sd]
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0] - (w[1:] * mean / sd).sum()), *(float(v) for v in w[1:] / sd))


def fit(toxic: list[str], ordinary: list[str], calibration: list[tuple[str, int]]) -> Model:
    """Dictionaries from texts of both classes, weights from other labelled texts (all of them if these lack a class)."""
    share = sum(y for _, y in calibration) / len(calibration) if calibration else 0.0
    flat = Model(b"", b"", (float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0, 0.0, 0.0))
    bad, good = _distinct(toxic), _distinct(ordinary)
    if not bad or not good:
        return flat
    n_bad, n_good = _counts(bad), _counts(good)
    if not len(n_bad[0]) or not len(n_good[0]):
        return flat
    front = _segments(bad, good, n_bad, n_good, COMMON // 8)
    if not front:
        return flat
    plain = b"".join(good)
    behind = _segments(good, bad, n_good, n_bad, len(front)) or b""
    behind += plain[: len(front) - len(behind)]
    try:
        common = zs.train_dictionary(COMMON, [w for text in good for w in windows_of(text)][:WINDOWS]).as_bytes()
    except zs.ZstdError:  # too few samples for the trainer
        common = plain[-COMMON:]
    a, b = behind + common, front + common
    if len({y for _, y in calibration}) < 2:
        calibration = [*((t, 1) for t in toxic), *((t, 0) for t in ordinary)]
    with_a, with_b = compressor(a), compressor(b)
    x = np.array([figures(t, with_a, with_b) for t, _ in calibration])
    return Model(a, b, _logistic(x, np.array([y for _, y in calibration], float)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows whose crc32(doc_id) mod 5 is not 0.

    Folds 1 to 3 serve the dictionaries, fold 4 the calibration. Ids with contradicting labels and null labels are
    left out. The bounds are TOXIC_ROWS, ORDINARY_ROWS, CALIBRATION_ROWS, ROW_CHARS, CLASS_CHARS and WINDOWS; the sampled ids
    are so few that they are broadcast.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    known = labels.where(f"{label} is not null and doc_id is not null").groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z"))
    known = known.where("y = z and y in (0, 1)").select(F.col("doc_id").alias("id"), F.col("y").cast("int").alias("y"), fold.alias("fold"))
    order = F.xxhash64("id")

    def some(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(order, "id").limit(n)

    learn = known.where("fold between 1 and 3")
    chosen = some(learn.where("y = 1"), TOXIC_ROWS).unionByName(some(learn.where("y = 0"), ORDINARY_ROWS))
    chosen = chosen.unionByName(some(known.where("fold = 4"), CALIBRATION_ROWS))
    texts = docs.select("doc_id", whole().alias("text")).where(F.length("text") <= ROW_CHARS)
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", "fold", "text").distinct().collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["text"]))
    part = [[r["text"] for r in rows if r["fold"] < 4 and r["y"] == y] for y in (1, 0)]
    return fit(*part, [(r["text"], r["y"]) for r in rows if r["fold"] == 4])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a score (0 to 1) of each whole text; an empty or null text gets that of no toxic window.

    Rows are handled one by one, so repeated rows and null ids stay; all columns come along, and one that is
    already named score is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = compressor(model.ordinary), compressor(model.toxic)
        for batch in batches:
            made = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                x = figures(text or "", a, b) if model.toxic else [0.0, 0.0, 0.0]
                z = model.weights[0] + sum(w * v for w, v in zip(model.weights[1:], x, strict=True))
                made.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield batch.append_column("score", pa.array(made, pa.float64()))

    prepare(docs.sparkSession)
    kept = docs.drop("score")
    return kept.mapInArrow(run, kept.withColumn("score", F.lit(0.0)).schema)


def held_out() -> Column:
    """Whether a row is kept from learning: crc32(doc_id) mod 5 is 0; a row without an id never is learnt from."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(rest == 0, F.lit(True))
