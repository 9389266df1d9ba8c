"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's vector is the mean of hashed embeddings of the word and of its beginnings, so that unseen
words with a known beginning count. Filters of several widths run over whole texts; the largest
response of each filter goes to a logistic layer. Scores are calibrated on rows not fitted on.

The fit takes a bounded sample of labelled rows: ``FIT_DOCS`` of each label, in the order of a hash, as
long as they have ``FIT_BYTES`` in all; a text of more than a sixteenth of that isn't fitted on. Texts are
taken whole, there and in scoring, which takes all rows. Embeddings begin with how much more often a word
is in toxic texts of the sample. Labels, language, source and identifiers are never inputs of a score; the
language only picks the threshold of :func:`reject`.

Null and empty texts get the score of a text without words; without usable labels of both kinds
every score is the share of toxic labels (0 without any). Labels given twice count as toxic if one
is. Repeated rows score alike. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Words, batches, by_slices, dropped, mixed, small_batches, utf8, written

#: Bounds of the fitting sample: rows of each label, and bytes of each label's texts in all.
FIT_DOCS, FIT_BYTES = 3000, 8 << 20
#: Fixed values of the model.
BUCKETS, DIM, FILTERS, WIDTHS, HEADS = 1 << 15, 16, 12, (1, 2, 3), (3, 4, 5, 6, 7)
EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 8, 320, 64, 0.02, 1e-4, 11
#: Words convolved at a time: longer texts are taken in overlapping blocks, whose maxima are joined.
BLOCK = 1 << 17


def word_ids(words: Words) -> np.ndarray:
    """Embedding rows of each word: its own hash, and one for each beginning in HEADS."""
    mask = np.uint64(BUCKETS - 1)
    out = np.empty((len(words.hash), len(HEADS) + 1), np.uint16)
    out[:, 0] = words.hash & mask
    for k, n in enumerate(HEADS, 1):
        out[:, k] = mixed((words.head & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n)) & mask
    return out


@dataclass
class Model:
    """Embeddings, filters by width, the logistic layer, and the calibration of its output."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0
    constant: float | None = None
    thresholds: dict = field(default_factory=dict)
    threshold: float = 0.7

    @classmethod
    def fresh(cls) -> Model:
        rng = np.random.default_rng(SEED)
        return cls(
            rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32),
            [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(FILTERS * len(WIDTHS), np.float32),
            rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        )

    def begin(self, odds: np.ndarray) -> None:
        """The first component of embeddings is the rows' log odds, and one filter of each width looks for it."""
        self.table[:, 0] = np.clip(odds, -3, 3)
        for n, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            f[::DIM, 0] = 2.0 / w
            self.out[n * FILTERS] = 1.0

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Of each filter at each place; beyond the end words are zero."""
        n = len(ids)
        x = np.zeros((n + max(WIDTHS) - 1, DIM), np.float32)
        for k in range(ids.shape[1]):
            x[:n] += self.table[ids[:, k]]
        x[:n] /= ids.shape[1]
        return np.concatenate([sum(x[j : j + n] @ f[j * DIM : (j + 1) * DIM] for j in range(w)) for w, f in zip(WIDTHS, self.filters, strict=True)], 1)

    def pooled(self, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Each text's largest response of each filter, zero at least; ``cuts`` are word numbers of texts' ends and begins."""
        best = np.zeros((len(cuts) - 1, len(self.bias)), np.float32)
        first = 0
        while first < len(cuts) - 1:
            # texts as many as fit in a block, or one long text, block by block
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + BLOCK, "right")) - 1)
            for a in range(int(cuts[first]), int(cuts[last]), BLOCK):
                b = min(a + BLOCK, int(cuts[last]))
                end = min(b + max(WIDTHS) - 1, int(cuts[last])) if last == first + 1 else b
                full = np.nonzero(np.diff(cuts[first : last + 1]))[0]
                part = self._padded(ids[a:end], cuts[first : last + 1][full] - a if last > first + 1 else np.zeros(1, np.int64), b - a)
                best[first + full] = np.maximum(best[first + full], np.maximum(part + self.bias, 0))
            first = last
        return best

    def _padded(self, ids: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
        """Maxima over texts that begin at ``begins``, with empty places between texts."""
        pad = max(WIDTHS) - 1
        if len(begins) == 1:
            return self.responses(ids)[:n].max(0, keepdims=True)
        text = np.zeros(len(ids), np.int64)
        text[begins[1:]] = 1
        place = np.arange(len(ids)) + np.cumsum(text) * pad
        rows = np.full((len(ids) + pad * (len(begins) - 1), ids.shape[1]), BUCKETS, np.int32)  # a row of zeros
        rows[place] = ids
        held = self.table
        self.table = self._with_zero()
        try:
            r = self.responses(rows)
        finally:
            self.table = held
        empty = np.ones(len(rows), bool)
        empty[place] = False
        r[empty] = -np.inf
        return np.maximum.reduceat(r, begins + np.arange(len(begins)) * pad, axis=0)

    def _with_zero(self) -> np.ndarray:
        """The table with a last row of zeros."""
        if getattr(self, "_zero", None) is None or self._of is not self.table:
            self._zero, self._of = np.concatenate([self.table, np.zeros((1, DIM), np.float32)]), self.table
        return self._zero

    def raw(self, ids, cuts) -> np.ndarray:
        return self.pooled(ids, cuts) @ self.out + self.shift

    def score(self, ids, cuts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(cuts) - 1, self.constant)
        return sigmoid(self.raw(ids, cuts).astype(np.float64) * self.slope + self.intercept)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words, and where texts begin; some texts at a time."""
    ids, sizes, held, size = [], [], [], 0

    def done():
        w = Words(np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in held])]).astype(np.int64))
        ids.append(word_ids(w)), sizes.append(np.diff(w.doc))

    for t in texts:
        held.append(t.encode())
        size += len(held[-1])
        if size > 1 << 20:
            done()
            held, size = [], 0
    done()
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _odds(ids: np.ndarray, cuts: np.ndarray, docs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of each embedding row, the smoothed log odds that a toxic text has a word of it, against other texts."""
    counts = np.ones((2, BUCKETS))
    for d in docs:
        counts[int(labels[d]), np.unique(ids[cuts[d] : cuts[d + 1]])] += 1
    of = np.array([(labels[docs] == y).sum() + 2 for y in (0, 1)])
    return np.log(counts[1] / of[1]) - np.log(counts[0] / of[0])


def fit(texts: list[str], labels: np.ndarray, languages: list, held: np.ndarray, shares: tuple[float, float]) -> Model:
    """Train on rows not ``held``; calibrate on those held, weighted so that labels have their true ``shares``."""
    model = Model.fresh()
    labels = np.asarray(labels, np.float32)
    prior = shares[1] / max(sum(shares), 1e-9)
    if len(set(labels[~held].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        model.constant = float(prior)
        return model
    ids, cuts = _encoded(texts)
    rng, train = np.random.default_rng(SEED), np.nonzero(~held)[0]
    model.begin(_odds(ids, cuts, train, labels))
    weight = np.where(labels == 1, 0.5 / max(labels[train].mean(), 1e-6), 0.5 / max(1 - labels[train].mean(), 1e-6)).astype(np.float32)
    slow: dict = {}

    def step(name, value, grad, rate=RATE):
        """Adam."""
        m, v, t = slow.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        slow[name][2] = t = t + 1
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)

    epochs = max(EPOCHS, -(-STEPS * BATCH // len(train)))  # small samples are gone through more often
    for epoch in range(epochs):
        rng.shuffle(train)
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(train), BATCH):
            docs = train[i : i + BATCH]
            pooled, args = np.zeros((len(docs), len(model.bias)), np.float32), np.full((len(docs), len(model.bias)), -1)
            for k, d in enumerate(docs):
                a, b = cuts[d], cuts[d + 1]
                if b > a:
                    r = model.responses(ids[a:b])
                    args[k] = r.argmax(0)
                    pooled[k] = r[args[k], np.arange(r.shape[1])]
            z = pooled + model.bias
            h = np.maximum(z, 0) * (args >= 0)
            p = sigmoid(h @ model.out + model.shift)
            dl = ((p - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            dh = dl[:, None] * model.out * ((z > 0) & (args >= 0))
            dtable, dfilters = np.zeros_like(model.table), [np.zeros_like(f) for f in model.filters]
            k, col = np.nonzero(dh)
            at, grad = cuts[docs[k]] + args[k, col], dh[k, col]
            for n, w in enumerate(WIDTHS):
                own = col // FILTERS == n
                for j in range(w):
                    ok = own & (at + j < cuts[docs[k] + 1])
                    rows, c, g = ids[at[ok] + j], col[ok] % FILTERS, grad[ok]
                    x = model.table[rows].mean(1)
                    np.add.at(dfilters[n][j * DIM : (j + 1) * DIM].T, c, x * g[:, None])
                    dx = model.filters[n][j * DIM : (j + 1) * DIM].T[c] * (g / rows.shape[1])[:, None]
                    np.add.at(dtable, rows.ravel(), np.repeat(dx, rows.shape[1], 0))
            step("table", model.table, dtable, rate)
            for n, g in enumerate(dfilters):
                step(f"f{n}", model.filters[n], g + DECAY * model.filters[n], rate)
            step("bias", model.bias, dh.sum(0), rate)
            step("out", model.out, h.T @ dl + DECAY * model.out, rate)
            model.shift -= float(rate * dl.sum())
    _calibrate(model, ids, cuts, labels, languages, held, shares)
    return model


def _calibrate(model, ids, cuts, labels, languages, held, shares):
    """Platt's line on held rows, then the threshold of the best F1 for each language, drawn towards the common one."""
    rows = np.nonzero(held)[0]
    x = np.array([model.raw(ids[cuts[d] : cuts[d + 1]], np.array([0, cuts[d + 1] - cuts[d]]))[0] for d in rows], np.float64)
    y = labels[rows].astype(np.float64)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    w = np.where(y == 1, shares[1] / n1, shares[0] / n0)
    w = w / w.sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton on two numbers, damped
        p = sigmoid(a * x + b)
        g = np.array([(w * (p - goal) * x).sum() + 1e-4 * (a - 1), (w * (p - goal)).sum()])
        r = w * p * (1 - p)
        hess = np.array([[(r * x * x).sum() + 1e-4, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-6]]) + 1e-6 * np.eye(2)
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = max(1e-3, a - move[0]), b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    model.slope, model.intercept = float(a), float(b)
    p, langs = sigmoid(a * x + b), np.array([str(languages[d]) for d in rows])

    def best(ok) -> tuple[float, float]:
        cand = np.linspace(0.2, 0.9, 36)
        f1 = [2 * (w * y * (p >= t))[ok].sum() / max(((w * (p >= t)) + w * y)[ok].sum(), 1e-12) for t in cand]
        top = np.nonzero(np.array(f1) >= max(f1) - 1e-9)[0]
        return float(cand[top].mean()), float(y[ok].sum())

    model.threshold = best(np.ones(len(rows), bool))[0]
    for lang in sorted(set(langs.tolist())):
        t, n = best(langs == lang)
        model.thresholds[lang] = (n * t + 20 * model.threshold) / (n + 20)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: CRC-32 of the identifier as text leaves 1 by 3."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a sample of labelled rows outside the held-out third; at most ``fit_docs`` and ``fit_bytes`` of each label."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(fit_docs)
        picked = one if picked is None else picked.union(one)
    # at most 2 * fit_docs narrow rows: a proven bound
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), lang.alias("lang"))
    texts = texts.where(F.octet_length("text") <= fit_bytes // 16).join(F.broadcast(picked), "id").withColumn("held", F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0)
    some = written(texts, "sample")
    rows = {}
    for y in (0, 1):
        size = 0
        for r in some.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit("fit")), "id", "text").toLocalIterator():
            size += len(r["text"].encode())
            if size > fit_bytes:
                break
            rows.setdefault(r["id"], r)
    dropped(some)
    rows = sorted(rows.values(), key=lambda r: r["id"])
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows]), [r["lang"] for r in rows], np.array([r["held"] for r in rows], bool), (counts.get(0, 0), counts.get(1, 0)))


def _score_texts(column, model: Model) -> np.ndarray:
    data, offsets = utf8(column)
    words = Words(data, offsets)
    return model.score(word_ids(words), words.doc)


def _score_batches(rows, shared):
    import pyarrow as pa

    for b in batches(rows):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_score_texts(b.column(1), shared.value).astype(np.float64))], names=["id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of each row; one pass over whole texts, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(partial(_score_batches, shared=shared), f"id {kind}, score double")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose score reaches the threshold of their language; columns as they were."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts):
        import pyarrow as pa

        return pa.array(by_slices(texts, lambda x: _score_texts(x, shared.value).astype(np.float64), float))

    limit = F.lit(model.threshold)
    if "lang" in docs.columns:
        for lang, t in sorted(model.thresholds.items()):
            limit = F.when(F.col("lang").cast("string") == lang, t).otherwise(limit)
    # a null score can't be: null texts are scored as empty ones
    return docs.where(scored(F.col(f"`{text_col}`")) < limit)
