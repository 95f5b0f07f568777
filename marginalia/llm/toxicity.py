"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart by zstandard's own training: one on windows of ordinary text, one on the
toxic texts' own stretches, that is toxic text without what ordinary text holds about as often (byte strings are
compared by a likelihood test over texts). Toxic documents are ordinary prose with some toxic words in it, so a window
is compressed with the ordinary dictionary alone, padded to the same length so that ordinary matches cost the same, and
with the toxic one put behind it. A document is cut into windows of whole words; the bytes that the toxic dictionary
saves on a window are the window's distance. Thresholds and weights on a document's distances are calibrated on
labelled documents that the dictionaries used there have not seen.

Labels are learned from a bounded sample of labelled rows (`SAMPLE_ROWS` rows of `SAMPLE_BYTES` characters at most, in the
order of a hash of the id; whole texts; of rows that repeat an id the greatest text). Executors train, a task for each
fold; the driver gets features and dictionaries only. Null text counts as empty; empty text gets the score of a
document without any distance. Without labels of both classes, and without toxic stretches, every score is 0.
Repeated rows get equal scores. An empty table gives an empty result. Extra columns are carried along.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, crc_mod, extended, prepare, shingles_of, words_of

#: Labelled rows, and characters of them, that the model is fitted on, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 32_000_000
#: Characters of a window, about; windows end at a word's end.
WINDOW = 72
#: Lengths of byte strings that are tested; evidence, and times the ordinary rate, that toxic text's own ones need.
GRAMS, MARKED, OFTENER = (5, 6, 7, 8), 20.0, 6
#: Different toxic texts that such a string occurs in at least: copies of a few texts mark nothing.
COMMON_TEXTS = 8
#: Bytes of the dictionaries, and zstandard's segment and string lengths for training them.
ORDINARY_SIZE, TOXIC_SIZE, ORDINARY_SEGMENT, TOXIC_SEGMENT, TRAINED = 32_768, 16_384, 64, 32, 6
FOLDS = 4
_TO_LOWER = {i: i + 32 for i in range(65, 91)}
_WINDOW = re.compile(r"\S(?:.{%d}\S*|.+)" % WINDOW, re.S)


def windows(text: str) -> list[bytes]:
    """The whole text, A-Z lower-cased, in windows of about WINDOW characters that start and end with words."""
    return [w.encode() for w in _WINDOW.findall(text.translate(_TO_LOWER))]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    floor: float
    weights: tuple[float, ...]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=16, search_log=9, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        return tuple(zstandard.ZstdCompressor(compression_params=how, dict_data=_dictionary(d, how)) for d in (self.toxic, self.ordinary))

    def distances(self, compressors, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        toxic, ordinary = compressors
        return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)], float)

    def score(self, distances: np.ndarray) -> float:
        z = float(np.dot(self.weights, features(distances, self.floor)))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))


def _dictionary(content: bytes, how) -> zstandard.ZstdCompressionDict:
    out = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    out.precompute_compress(compression_params=how)
    return out


def features(distances: np.ndarray, floor: float) -> np.ndarray:
    """1, the largest distances, and the sum, share and squares of what windows have above the floor."""
    over = distances[distances > floor] - floor
    top = np.sort(np.concatenate([distances, np.zeros(3)]))[::-1].clip(0, 12)
    return np.array([1.0, top[0] / 4, top[1] / 4, top[2] / 4, math.log1p(over.sum()), math.log1p((over**2).sum()), len(over) / max(1, len(distances))])


def _grams(data: bytes, n: int) -> np.ndarray:
    """Each run of n bytes as a number."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    m = max(0, len(a) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out << np.uint64(8) | a[j : j + m]
    return out


def _surprise(a: np.ndarray, b: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Twice the log-likelihood ratio of the two classes having rates of their own."""
    out = np.zeros(len(a))
    for x, n in ((a, n0), (b, n1)):
        for got, p in ((x, (a + b) / (n0 + n1)), (n - x, 1 - (a + b) / (n0 + n1))):
            out += np.where(got > 0, 2 * got * np.log(np.maximum(got, 1) / np.maximum(n * p, 1e-9)), 0)
    return out


def unlike(texts: list[str]) -> list[str]:
    """The texts, in order, without those half of whose runs of five words earlier ones hold: copies, near copies and
    repeated passages of a few texts are no evidence. One run in four is looked at."""
    seen: set[int] = set()
    out = []
    for text in texts:
        grams = shingles_of(*words_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), WORD), 5)[0]
        own = set(grams[grams & np.uint64(3) == 0].tolist())
        if len(own & seen) * 2 < len(own) or not own:
            out.append(text)
            seen |= own
    return out


def own_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of the toxic texts that are covered by byte strings of toxic text's own."""
    covered = [np.zeros(len(t), bool) for t in toxic]
    for n in GRAMS:
        of = [_grams(t, n) for t in toxic]
        strings, b = np.unique(np.concatenate([np.unique(g) for g in of]), return_counts=True)
        strings, b = strings[b >= COMMON_TEXTS], b[b >= COMMON_TEXTS]
        if not len(strings):
            continue
        a = np.zeros(len(strings), np.int64)
        for t in ordinary:
            x = _grams(t, n)
            at = np.minimum(np.searchsorted(strings, x), len(strings) - 1)
            a[np.unique(at[strings[at] == x])] += 1
        own = strings[(b / len(toxic) > OFTENER * a / len(ordinary)) & (_surprise(a, b, len(ordinary), len(toxic)) > MARKED)]
        if not len(own):
            continue
        for g, c in zip(of, covered, strict=True):
            hits = np.flatnonzero(own[np.minimum(np.searchsorted(own, g), len(own) - 1)] == g)
            for j in range(n):
                c[hits + j] = True
    out = []
    for t, c in zip(toxic, covered, strict=True):
        cuts = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
        out += [t[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)]
    return out


def _trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """A dictionary by zstandard's training; samples too few for that are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=TRAINED).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def train_dictionaries(texts: list[str], toxic: list[int]) -> tuple[bytes, bytes] | None:
    """Raw-content dictionaries (toxic, ordinary) of equal length; None where toxic text has nothing of its own. Copies and near copies count once."""
    apart = [unlike([t for t in dict.fromkeys(t for t, label in zip(texts, toxic, strict=True) if label == c) if t]) for c in (0, 1)]
    if not all(apart):
        return None
    ordinary, of_toxic = ([t.translate(_TO_LOWER).encode() for t in c] for c in apart)
    own = own_stretches(of_toxic, ordinary)
    if not own:
        return None
    marks = _trained(TOXIC_SIZE, [b" " + x.strip() + b" " for x in own], TOXIC_SEGMENT)
    base = _trained(ORDINARY_SIZE, [w for t in apart[0] for w in windows(t)], ORDINARY_SEGMENT)
    return base + marks, base + bytes(len(marks))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def fold_of(texts: list[str], toxic: list[int], mine: list[bool]) -> tuple[tuple[bytes, bytes] | None, list[np.ndarray]]:
    """Dictionaries from the texts that are not `mine`, and the distances of those that are."""
    both = train_dictionaries([t for t, m in zip(texts, mine, strict=True) if not m], [x for x, m in zip(toxic, mine, strict=True) if not m])
    if both is None:
        return None, [np.zeros(0) for m in mine if m]
    model = Model(*both, 0, (0,))
    compressors = model.compressors()
    return both, [model.distances(compressors, t) for t, m in zip(texts, mine, strict=True) if m]


def calibrated(both: tuple[bytes, bytes] | None, apart: list[np.ndarray], toxic: list[int]) -> Model | None:
    """A model with the floor and weights that fit distances of unseen texts best."""
    if both is None or len(set(toxic)) < 2:
        return None
    y, best = np.array(toxic, float), None
    for floor in (0, 1, 2, 3, 4):
        x = np.array([features(d, floor) for d in apart])
        w = _fit(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        if best is None or loss < best[0]:
            best = (loss, floor, tuple(w))
    return Model(*both, best[1], best[2])


def fit(texts: list[str], toxic: list[int], folds: int = FOLDS) -> Model | None:
    """Dictionaries from all texts; floor and weights from distances under dictionaries that lack the text's fold."""
    if len(set(toxic)) < 2:
        return None
    apart, labels = [], []
    for f in range(folds):
        mine = [i % folds == f for i in range(len(texts))]
        apart += fold_of(texts, toxic, mine)[1]
        labels += [x for x, m in zip(toxic, mine, strict=True) if m]
    return calibrated(train_dictionaries(texts, toxic), apart, labels)


def fit_labels(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, folds: int = FOLDS) -> Model | None:
    """A model from labelled documents whose crc32(id) mod 5 is not 0: `sample_rows` and `sample_bytes` at most, a task for each fold."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    place = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # of sample_rows rows at most
    sample = rows.withColumn("place", F.row_number().over(place)).withColumn("upto", F.sum(F.length("text")).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sample = sample.where(F.col("upto") <= sample_bytes).select((F.col("place") % folds).alias("part"), "place", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    dealt = sample.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds))))  # fold `folds` has no text of its own: the model's dictionaries

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        fold, texts, toxic, part = table.column("fold")[0].as_py(), table.column("text").to_pylist(), table.column("toxic").to_pylist(), table.column("part").to_pylist()
        mine = [p == fold for p in part]
        both, apart = fold_of(texts, toxic, mine)
        dictionaries = both if both and fold == folds else (b"", b"")
        own = json.dumps([[d.tolist(), x] for d, x in zip(apart, [x for x, m in zip(toxic, mine, strict=True) if m], strict=True)])
        return pa.table({"fold": pa.array([fold], pa.int32()), "toxic": pa.array([dictionaries[0]], pa.binary()), "ordinary": pa.array([dictionaries[1]], pa.binary()), "apart": pa.array([own])})

    dealt = dealt.repartition(4 * (folds + 1), "fold")  # a task for each fold; Spark would put so few bytes into one
    got = sorted(dealt.groupBy("fold").applyInArrow(run, "fold int, toxic binary, ordinary binary, apart string").collect(), key=lambda r: r.fold)
    if not got or not got[-1].toxic:
        return None
    apart = [(np.array(d), x) for r in got for d, x in json.loads(r.apart)]
    return calibrated((bytes(got[-1].toxic), bytes(got[-1].ordinary)), [d for d, _ in apart], [x for _, x in apart])


def scored(documents: DataFrame, model: Model | None, keep_text: bool = True) -> DataFrame:
    """documents (without text, if so asked) with score and predicted; columns of these names are replaced."""
    prepare(documents.sparkSession)
    keep = documents.drop("score", "predicted")
    carried = [c for c in keep.columns if keep_text or c != "text"]
    schema = extended(keep.select(*carried).schema, score="double", predicted="int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors() if model else None
        for b in batches:
            scores = [model.score(model.distances(both, t or "")) if model else 0.0 for t in b.column("text").to_pylist()]
            added = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *added], [*carried, "score", "predicted"])

    return keep.mapInArrow(run, schema)


def kept_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents that the model does not reject, with their own columns; each text is carried once."""
    prepare(documents.sparkSession)
    model = fit_labels(documents, labels)
    if model is None:
        return documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors()
        for b in batches:
            yield b.filter(pa.array([model.score(model.distances(both, t.as_py() or "")) < 0.5 for t in b.column("text")], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
