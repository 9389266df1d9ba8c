"""Quality by co-training: a view of the text and a view of the page's metadata teach each other.

The text view has a text's words, hashed, and how they and its characters are used; the metadata view has
language, source and stated size, and nothing of the text. Each row's views are computed once and written,
a few hundred bytes a row. Two logistic classifiers start from the same labelled rows. In each round, each
one labels those of all unlabelled rows that it is surest of, and the other one learns from them; rows of
equal views are handed over once. At the end, both are calibrated on labelled rows set aside, and the
calibrated views are combined by weights fitted on the same rows; that model scores all documents.

The fit takes a bounded sample of labelled rows (``FIT_DOCS`` of each label) and, from all others, what is
handed over; texts are taken whole. Null and empty texts are scored by what their metadata say and by an
empty text's features; null metadata are a value of their own. Labels given twice count as good if one is.
Without usable labels of both kinds every row has the share of good labels as its score (1 without any).
Repeated rows score alike. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Words, batches, dropped, mixed, utf8, written

#: Fixed value: labelled rows of each label that are fitted on.
FIT_DOCS = 2000
#: Rounds; rows that a view hands over in a round; the least confidence of those.
ROUNDS, HANDED, SURE = 5, 200, 0.95
#: Hashed places for words, and for languages and sources.
LEXICON, PLACES = 128, 32
#: Score from which a document is kept.
KEEP = 0.5

_KINDS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"\x20\t\n\r\x0b\x0c", b".,;:'\"-()", b"!?", b"|<>{}[]_=~^\\/`", b"#$%&*+@"), 1):
    _KINDS[list(_chars)] = _i
_KINDS[128:] = 9
#: Features of use, which come first and also have their squares, and all of the text view; all of the metadata view.
USE = 10 + 9
TEXT_FEATURES, META_FEATURES = USE + LEXICON, 2 * PLACES + 6


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: shares of kinds of bytes, how its words are used, and which words it has, by signed hashes."""
    n = len(offsets) - 1
    out = np.zeros((n, TEXT_FEATURES), np.float64)
    kinds = np.frombuffer(data.tobytes().translate(_KINDS.astype(np.uint8).tobytes()), np.uint8)
    size = np.maximum(np.diff(offsets), 1)
    words = Words(data, offsets)
    for i in range(n):
        out[i, :10] = np.bincount(kinds[offsets[i] : offsets[i + 1]], minlength=10)[:10] / size[i]
        h = words.hash[words.doc[i] : words.doc[i + 1]]
        k = len(h)
        if k:
            length = words.length[words.doc[i] : words.doc[i + 1]]
            own, counts = np.unique(h, return_counts=True)
            out[i, 10:USE] = (1, np.log1p(k) / 10, length.mean() / 10, length.std() / 10, len(counts) / k, counts.max() / k, (h[1:] == h[:-1]).mean() if k > 1 else 0, min(size[i] / k / 20, 3), (length == 1).mean())
            m = mixed(own + np.uint64(77))
            weight = np.log1p(counts) * np.where(m >> np.uint64(63), 1.0, -1.0)
            out[i, USE:] = np.bincount((m & np.uint64(LEXICON - 1)).astype(np.int64), weight, LEXICON) / np.sqrt((np.log1p(counts) ** 2).sum())
    return out


def meta_view(lang, source, n_chars) -> np.ndarray:
    """Of each row: its language and source, hashed, and its stated size."""
    out = np.zeros((len(lang), META_FEATURES), np.float64)
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, zlib.crc32(str(a).encode()) % PLACES] = 1
        out[i, PLACES + zlib.crc32(str(b).encode()) % PLACES] = 1
        known = c is not None and c >= 0
        c = c if known else 0
        out[i, 2 * PLACES :] = (1, float(known), np.log1p(c) / 10, min(c, 2000) / 2000, min(c, 20_000) / 20_000, float(c < 200))
    return out


@dataclass
class View:
    """A logistic classifier over standardised features and the squares of the first of them, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    squares: int = 0
    slope: float = 1.0
    intercept: float = 0.0

    def spread(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        square = z[:, : self.squares or None]
        return np.concatenate([z, square * square / 3, np.ones((len(z), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x) @ self.weights

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.slope + self.intercept


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps, drawn towards ``start``."""
    middle = np.zeros(x.shape[1]) if start is None else start
    b = np.zeros(x.shape[1]) if start is None else start.copy()
    w = w / w.sum()
    for _ in range(50):
        p = sigmoid(x @ b)
        g = x.T @ (w * (p - y)) + ridge * (b - middle)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(b))
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        b -= step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-7:
            break
    return b


def _even(y: np.ndarray) -> np.ndarray:
    return np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))


def _fit_view(x: np.ndarray, y: np.ndarray) -> View:
    wide = x.shape[1] == TEXT_FEATURES
    v = View(x.mean(0), np.maximum(x.std(0), 1e-3), np.zeros(0), USE if wide else 0)
    # many hashed words to few rows: drawn more towards nothing
    v.weights = _newton(v.spread(x), y, _even(y), max(2e-4, 2.0 / len(y) if wide else 0))
    return v


@dataclass
class Model:
    views: list[View]
    combined: np.ndarray
    constant: float | None = None

    def score(self, *xs: np.ndarray) -> np.ndarray:
        """One column for each calibrated view, and the combined score first."""
        if self.constant is not None:
            return np.full((len(xs[0]), 3), self.constant)
        logits = np.stack([v.calibrated(x) for v, x in zip(self.views, xs, strict=True)], 1)
        both = logits @ self.combined[:2] + self.combined[2]
        return sigmoid(np.concatenate([both[:, None], logits], 1))


def co_train(xs: list[np.ndarray], y: np.ndarray, held: np.ndarray, surest, shares: tuple[float, float], rounds: int = ROUNDS) -> Model:
    """``xs``: both views of labelled rows, of which those ``held`` calibrate.

    ``surest(views, wanted)`` gives both views of the unlabelled rows that each view is surest of: for view
    ``v`` and label ``l``, at most ``wanted[l]``, of a confidence of ``SURE`` at least, none of them twice.
    """
    y = np.asarray(y, float)
    known = ~held
    if len(set(y[known])) < 2 or len(set(y[held])) < 2:
        return Model([], np.zeros(3), shares[1] / sum(shares) if sum(shares) else 1.0)
    own = [[x[known] for x in xs] for _ in range(2)]  # each view's training rows, in both views
    ys = [y[known].copy() for _ in range(2)]
    # as many of each label as the labels' shares ask for
    wanted = {label: max(1, round(HANDED * shares[label] / max(sum(shares), 1e-9))) for label in (0, 1)}
    for _ in range(rounds):
        views = [_fit_view(own[v][v], ys[v]) for v in range(2)]
        got = surest(views, wanted)
        for (v, label), rows in got.items():
            own[1 - v] = [np.concatenate([own[1 - v][i], rows[i]]) for i in range(2)]
            ys[1 - v] = np.concatenate([ys[1 - v], np.full(len(rows[0]), float(label))])
        if not any(len(rows[0]) for rows in got.values()):
            break
    views = [_fit_view(own[v][v], ys[v]) for v in range(2)]
    yh = y[held]
    w = np.where(yh == 1, shares[1] / max(yh.sum(), 1), shares[0] / max((1 - yh).sum(), 1))
    for v, view in enumerate(views):
        raw = view.raw(xs[v][held])
        view.slope, view.intercept = _newton(np.stack([raw, np.ones(len(raw))], 1), yh, w, 1e-3, np.array([1.0, 0.0]))
    logits = np.stack([view.calibrated(xs[v][held]) for v, view in enumerate(views)] + [np.ones(len(yh))], 1)
    return Model(views, _newton(np.clip(logits, -20, 20), yh, w, 1e-2, np.array([0.8, 0.8, 0.0])))


# -- tables ---------------------------------------------------------------------------------------


def _columns(docs: DataFrame, text_col: str = "text") -> list[Column]:
    has = set(docs.columns)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [
        text.alias("text"), (F.col("lang") if "lang" in has else F.lit(None)).cast("string").alias("lang"), (F.col("source") if "source" in has else F.lit(None)).cast("string").alias("source"),
        (F.col("n_chars") if "n_chars" in has else F.lit(None)).cast("bigint").alias("n_chars"),
    ]


def _packed(x: np.ndarray):
    import pyarrow as pa

    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, "<f2")], pa.binary())


def _unpacked(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").astype(np.float64).reshape(-1, width)


def _views_of(b, at: int = 1) -> list[np.ndarray]:
    return [_unpacked(b.column(at), TEXT_FEATURES), _unpacked(b.column(at + 1), META_FEATURES)]


def _view_batches(rows):
    import pyarrow as pa

    for b in batches(rows):
        yield pa.RecordBatch.from_arrays([b.column(0), _packed(text_view(*utf8(b.column(1)))), _packed(meta_view(*(b.column(i).to_pylist() for i in range(2, 5))))], names=["id", "text_view", "meta_view"])


def viewed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, text_view, meta_view, y`` of each row, written: one pass over whole texts; ``y`` is null without a label."""
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *_columns(docs))
    made = rows.mapInArrow(_view_batches, f"id {docs.schema[id_col].dataType.simpleString()}, text_view binary, meta_view binary")
    return written(made.join(known, "id", "left"), "views")


def _surest_batches(rows, shared, wanted: dict):
    """Of a task's rows, those that each view is surest of: ``view, label, sure, digest, text_view, meta_view``; at most ``wanted`` of each."""
    import pyarrow as pa
    import xxhash

    views, gone = shared.value
    best: dict[tuple[int, int], dict[int, tuple]] = {(v, label): {} for v in range(2) for label in wanted}
    floors = dict.fromkeys(best, SURE)
    for b in batches(rows):
        xs = _views_of(b)
        for v, view in enumerate(views):
            p = sigmoid(view.raw(xs[v]))
            for label in wanted:
                sure, own = p if label else 1 - p, best[v, label]
                for i in np.nonzero(sure >= floors[v, label])[0].tolist():
                    t, m = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                    digest = xxhash.xxh64_intdigest(t + m) >> 1
                    if digest not in gone:
                        own[digest] = (float(sure[i]), t, m)
                if len(own) > 2 * wanted[label]:
                    own = best[v, label] = dict(heapq.nlargest(wanted[label], own.items(), key=lambda x: (x[1][0], x[0])))
                    floors[v, label] = min(x[0] for x in own.values())
    out = [(v, label, x[0], d, x[1], x[2]) for (v, label), own in best.items() for d, x in heapq.nlargest(wanted[label], own.items(), key=lambda x: (x[1][0], x[0]))]
    if out:
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["view", "label", "sure", "digest", "text_view", "meta_view"])


def _surest(views_table: DataFrame):
    """The ``surest`` of :func:`co_train` over all unlabelled rows of a table of views; a few hundred rows come to the driver."""
    spark, gone = views_table.sparkSession, set()
    free = views_table.where("y is null")

    def surest(views: list, wanted: dict) -> dict:
        shared = spark.sparkContext.broadcast((views, frozenset(gone)))
        found = free.mapInArrow(partial(_surest_batches, shared=shared, wanted=wanted), "view int, label int, sure double, digest bigint, text_view binary, meta_view binary")
        found = written(found, "surest")
        got = {}
        for v in range(2):
            for label, n in wanted.items():
                rows = []
                # repeats of one row may come from several tasks
                for r in found.where((F.col("view") == v) & (F.col("label") == label)).groupBy("digest").agg(F.max("sure").alias("sure"), F.min("text_view").alias("t"), F.min("meta_view").alias("m")).orderBy(F.desc("sure"), "digest").limit(n).collect():
                    if r["digest"] not in gone:
                        gone.add(r["digest"])
                        rows.append((r["t"], r["m"]))
                got[v, label] = [np.array([np.frombuffer(x[i], "<f2") for x in rows], np.float64).reshape(-1, k) for i, k in enumerate((TEXT_FEATURES, META_FEATURES))]
        dropped(found)
        return got

    return surest


def train(views_table: DataFrame, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit on a bounded sample of labelled rows, picked by hashes of identifiers, and on what all others hand over."""
    known = views_table.where("y is not null")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.countDistinct("id").alias("n")).collect()}
    rows = []
    for y in (0, 1):
        rows += known.where(F.col("y") == y).groupBy("id").agg(F.min("text_view").alias("t"), F.min("meta_view").alias("m")).withColumn("held", F.pmod(F.xxhash64("id", F.lit("held")), F.lit(4)) == 0).withColumn("y", F.lit(y)).orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(fit_docs).collect()
    xs = [np.array([np.frombuffer(r[c], "<f2") for r in rows], np.float64).reshape(-1, k) for c, k in (("t", TEXT_FEATURES), ("m", META_FEATURES))]
    return co_train(xs, np.array([r["y"] for r in rows]), np.array([r["held"] for r in rows], bool), _surest(views_table), (counts.get(0, 0), counts.get(1, 0)), rounds)


def _score_batches(rows, shared):
    import pyarrow as pa

    for b in batches(rows):
        s = shared.value.score(*_views_of(b))
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(s[:, i])) for i in range(3)]], names=["id", "score", "text_score", "meta_score"])


def score(views_table: DataFrame, model: Model) -> DataFrame:
    """``id, score, text_score, meta_score`` of each row of a table of views; no shuffle."""
    shared = views_table.sparkSession.sparkContext.broadcast(model)
    kind = views_table.schema["id"].dataType.simpleString()
    return views_table.select("id", "text_view", "meta_view").mapInArrow(partial(_score_batches, shared=shared), f"id {kind}, score double, text_score double, meta_score double")


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, score, text_score, meta_score`` of each document, by a model trained on ``labels`` and the documents themselves."""
    table = viewed(docs, labels, id_col)
    return score(table, train(table))
