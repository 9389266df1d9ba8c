"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit checks.

A CGK walk reads a window of words: at each step it gives out the word under its pointer, and a
random bit of that word and step moves the pointer on or not. Windows at a small edit distance give
out sequences at a small Hamming distance, so samples of steps, drawn again and again over several
walks, agree with a good chance; windows whose samples agree are candidates. Windows are as large as the
item, of whatever length; of items of ``SHORT`` words and more up to a quarter less, which leaves room for
windows at every ``STRIDE``-th word of the texts alone. How many samples a size takes is found when the
index is built: on random items with as many edits as are allowed, until ``target`` of them are met.
Each candidate is checked over the whole item: the exact least edit distance, in words, of the item to any
stretch of text around it, by bit-parallel dynamic programming. An item is found if that is at most
``max_share`` of its words. An item's recall depends on its length alone, not on which others there are.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased by ASCII. Items without
words are never found. Null and empty texts hold nothing; whole texts of any length are searched;
repeated rows give a row each. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Words, batches, by_slices, mixed, small_batches, utf8

#: Items below so many words have windows of their own length at every word; others at every STRIDE-th word.
SHORT, STRIDE = 12, 4
#: Walks, samples of each at most, and steps in a sample at most.
WALKS, SAMPLES, STEPS = 4, 40, 8
#: The recall of edited items that samples are drawn for; trials that it is measured on; candidates by chance that a text's window may have.
TARGET, TRIALS, CHANCE = 0.95, 96, 1e-4
#: Items that one broadcast holds, by words; more items make more passes over the texts.
ITEM_WORDS = 400_000
#: Words of texts walked at a time.
BLOCK = 1 << 16
_K = np.uint64(0x9E3779B97F4A7C15)


def window(n: int) -> tuple[int, bool]:
    """Words in the windows of an item of ``n`` words, and whether it is short: then all of it, else the largest of 9, 12, 16, 21, ... (each a third more) that is smaller by STRIDE - 1 at least."""
    if n < SHORT:
        return n, True
    c = 9
    while round(c * 4 / 3) <= n - STRIDE + 1:
        c = round(c * 4 / 3)
    return c, False


def _edited(words: np.ndarray, edits: int, rng) -> list:
    out = words.tolist()
    for _ in range(edits):
        p, op, new = int(rng.integers(len(out))), rng.random(), int(rng.integers(1, 1 << 62))
        out[p : p + 1] = [new] if op < 0.5 else [] if op < 0.75 and len(out) > 1 else [out[p], new]
    return out


@dataclass
class Index:
    """Sampled windows of the items: for each size a list of tables, each of sorted keys with the window they are of."""

    ids: list
    words: list[np.ndarray]
    max_share: float
    target: float = TARGET
    seed: int = 5
    sizes: dict = field(default_factory=dict)

    def build(self) -> Index:
        of: dict[tuple[int, bool], list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                of.setdefault(window(len(w)), []).append(i)
        if not of:
            return self
        # how often two words of items are the same one tells how selective a step is
        counts = np.unique(np.concatenate([w for w in self.words if len(w)]), return_counts=True)[1]
        same = float(np.clip((counts / counts.sum() * counts / counts.sum()).sum(), 1e-6, 0.5))
        for kind, items in sorted(of.items()):
            c = kind[0]
            owner = np.concatenate([np.full(len(self.words[i]) - c + 1, i, np.int32) for i in items])
            offset = np.concatenate([np.arange(len(self.words[i]) - c + 1, dtype=np.int32) for i in items])
            m = int(np.clip(np.ceil(np.log(CHANCE / (len(owner) * 64)) / np.log(same)), 2, STEPS))
            plan = self._plan(c, m)
            tables, met = self._needed(kind, max(len(self.words[i]) for i in items), plan)
            plan, made = plan[:tables], []
            bits = int(np.clip(np.ceil(np.log2(64 * len(owner))), 10, 22))
            for keys in self._walked(*self._laid([self.words[i] for i in items], c), {kind: plan})[kind]:
                order = np.argsort(keys, kind="stable").astype(np.int32)
                seen = np.zeros(1 << bits, bool)
                seen[keys >> np.uint64(64 - bits)] = True
                made.append((keys[order], order, seen))
            self.sizes[kind] = {"owner": owner, "offset": offset, "plan": plan, "tables": made, "shift": np.uint64(64 - bits), "recall": met}
        return self

    @staticmethod
    def _laid(items: list, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Items one after another, with room for walks past their ends, and where their windows begin."""
        parts, begins, at = [], [], 0
        for w in items:
            parts += [np.asarray(w, np.uint64), np.zeros(2 * size + 2, np.uint64)]
            begins.append(at + np.arange(len(w) - size + 1))
            at += len(w) + 2 * size + 2
        return np.concatenate(parts), np.concatenate(begins)

    def _plan(self, size: int, steps: int) -> list[tuple[int, np.ndarray]]:
        """Walk and sampled steps of each table, in the order in which they are taken: within the steps that the window feeds."""
        rng = np.random.default_rng([self.seed, size])
        span = max(1, round(1.6 * size)) if size > 1 else 1
        return [(w, np.sort(rng.choice(span, min(steps, span), replace=False))) for _ in range(SAMPLES) for w in range(WALKS)]

    def _needed(self, kind: tuple[int, bool], n: int, plan: list) -> tuple[int, float]:
        """How many tables meet the target for items of ``n`` words with as many edits as are allowed, and the share that they meet."""
        size, short = kind
        most = int(self.max_share * n)
        if not most:
            return 1, 1.0  # windows without an edit agree in every sample
        rng = np.random.default_rng([self.seed, size, n])
        items, texts, whose = [], [], []
        for t in range(TRIALS):
            items.append(rng.integers(1, 1 << 62, n).astype(np.uint64))
            around = rng.integers(1, 1 << 62, STRIDE + 3 * size + 3).tolist()
            lead = STRIDE + int(rng.integers(STRIDE))
            texts.append(np.array(around[:lead] + _edited(items[-1], most, rng) + around[lead:], np.uint64))
            whose += [t] * (len(texts[-1]) - size + 1)
        flat, begins = self._laid(texts, size)
        own = np.concatenate([np.arange(len(x) - size + 1) for x in texts]) % (1 if short else STRIDE) == 0
        whose = np.array(whose)[own]
        mark = mixed(np.arange(1, TRIALS + 1).astype(np.uint64))  # keys of one trial meet each other alone
        a = self._walked(*self._laid(items, size), {kind: plan})[kind]
        b = self._walked(flat, begins[own], {kind: plan})[kind]
        hit = np.zeros((TRIALS, len(plan)), bool)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            hit[whose[np.isin(y ^ mark[whose], x ^ np.repeat(mark, n - size + 1))], i] = True
        met = np.logical_or.accumulate(hit, 1).mean(0)
        enough = np.nonzero(met >= min(1.0, self.target + 0.02))[0]
        k = int(enough[0]) + 1 if len(enough) else len(plan)
        return k, float(met[k - 1])

    def _walked(self, words: np.ndarray, begins: np.ndarray, plans: dict) -> dict:
        """Keys of each table of ``plans`` for the windows that begin at ``begins``; sizes share walks. Short windows are walked alone, as what follows them has no say."""
        out = {kind: [np.zeros(len(begins), np.uint64) for _ in plan] for kind, plan in plans.items()}
        at, bit = np.empty(len(begins), np.int64), np.empty(len(begins), np.uint64)
        given = np.empty(len(begins), np.uint64)
        long = [kind for kind in plans if not kind[1]]
        together = [[kind] for kind in plans if kind[1]] + ([long] if long else [])
        for w in range(WALKS):
            bits = None
            for kinds in together:
                at_step: dict[int, list[np.ndarray]] = {}
                for kind in kinds:
                    for key, (walk, steps) in zip(out[kind], plans[kind], strict=True):
                        for step in steps.tolist() if walk == w else ():
                            at_step.setdefault(step, []).append(key)
                if not at_step:
                    continue
                bits = mixed(words + np.uint64((w + 1) * int(_K) % 2**64)) if bits is None else bits
                at[:] = begins
                ends = begins + kinds[0][0] if kinds[0][1] else None
                for step in range(max(at_step) + 1):
                    np.take(bits, at, out=given, mode="clip")
                    if ends is not None:
                        given[at >= ends] = 0
                    for key in at_step.get(step, ()):
                        key += given
                    np.right_shift(given, np.uint64(step % 61), out=bit)
                    np.bitwise_and(bit, np.uint64(1), out=bit)
                    at += bit.view(np.int64)
        return out

    def find(self, words: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``text, item, distance, first word, words`` of the best place of each item in each text."""
        if not self.sizes or not len(words):
            return []
        room = 2 * max(c for c, _ in self.sizes) + 2
        padded = np.append(words, np.zeros(room, np.uint64))
        todo = []
        for short in (True, False):
            plans, stride = {kind: x["plan"] for kind, x in self.sizes.items() if kind[1] == short}, 1 if short else STRIDE
            for a in range(0, len(words), BLOCK) if plans else ():
                begins = np.arange(a + (-a) % stride, min(a + BLOCK, len(words)), stride)
                for kind, keys in self._walked(padded[a : a + BLOCK + room], begins - a, plans).items():
                    todo.append(self._met(self.sizes[kind], keys, begins))
        return self._checked(words, cuts, np.unique(np.concatenate(todo), axis=0))

    @staticmethod
    def _met(of: dict, keys: list, begins: np.ndarray) -> np.ndarray:
        """``begin, item, offset`` of windows that share a table's key."""
        out = [np.zeros((0, 3), np.int64)]
        for key, (known, order, seen) in zip(keys, of["tables"], strict=True):
            hit = np.nonzero(seen[key >> of["shift"]])[0]
            if not len(hit):
                continue
            lo, hi = np.searchsorted(known, key[hit], "left"), np.searchsorted(known, key[hit], "right")
            n = hi - lo
            if not n.any():
                continue
            row = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            out.append(np.stack([np.repeat(begins[hit], n), of["owner"][row], of["offset"][row]], 1).astype(np.int64))
        return np.unique(np.concatenate(out), axis=0)

    def _checked(self, words, cuts, todo):
        """Candidates of a text and item are tried place by place, until one has no edit."""
        text = np.searchsorted(cuts, todo[:, 0], "right") - 1
        most = (self.max_share * np.array([len(w) for w in self.words], np.int64)).astype(np.int64)
        start = todo[:, 0] - todo[:, 2]
        place = start // np.maximum(1, most[todo[:, 1]] + 1) if len(todo) else start
        _, first = np.unique(np.stack([text, todo[:, 1], place], 1), axis=0, return_index=True)
        rows = zip(text[first].tolist(), todo[first, 1].tolist(), start[first].tolist(), strict=True)
        out = []
        for (t, item), own in groupby(rows, key=lambda r: r[:2]):
            n, k, best = len(self.words[item]), int(most[item]), None
            for _, _, at in own:
                a, b = max(int(cuts[t]), at - 2 * k - 1), min(int(cuts[t + 1]), at + n + 2 * k + 1)
                got = nearest(self.words[item], words[a:b], k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a + got[1] - int(cuts[t]), got[2] - got[1])
                    if not best[0]:
                        break
            if best:
                out.append((t, item, *best))
        return out


def _scan_ends(item: list[int], text: list[int]) -> list[int]:
    """Least edit distance of the item to a stretch that ends before each place of the text, bit-parallel."""
    n = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, out = full, 0, n, [n]
    for w in text:
        eq = places.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & full
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv
        out.append(score)
    return out


def nearest(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """``distance, begin, end`` of the stretch of the text that is nearest to the item, if within ``most``."""
    a, b = item.tolist(), text.tolist()
    ends = _scan_ends(a, b)
    d = min(ends)
    if d > most:
        return None
    end = ends.index(d)
    back = _scan_ends(a[::-1], b[:end][::-1])
    return d, end - (len(back) - 1 - back[::-1].index(d)), end


def _tokens(texts: list[str | None]) -> list[np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    return [w.hash[a:b] for a, b in zip(w.doc, w.doc[1:], strict=False)]


def indexes(benchmark: DataFrame, max_share: float = 0.2, item_words: int = ITEM_WORDS, **kw):
    """The items in one index, or in several of at most ``item_words`` words: items stream to the driver, a part at a time."""
    ids, words, n = [], [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator():
        (w,) = _tokens([r["text"]])
        if n and n + len(w) > item_words:
            yield Index(ids, words, max_share, **kw).build()
            ids, words, n = [], [], 0
        ids.append(r["item_id"]), words.append(w)
        n += len(w)
    yield Index(ids, words, max_share, **kw).build()


def _find_in(column, index: Index):
    data, offsets = utf8(column)
    w = Words(data, offsets)
    return index.find(w.hash, w.doc)


def _find_batches(rows, shared):
    import pyarrow as pa

    index = shared.value
    for b in batches(rows):
        got = _find_in(b.column(1), index)
        if got:
            t, i, d, at, n = (list(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(t)), pa.array([index.ids[x] for x in i], pa.int64()), pa.array(d, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int32())],
                names=["id", "item_id", "distance", "first_word", "n_words"],
            )


def leaks(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.2, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``id, item_id, distance, first_word, n_words``: a row for each item found in each row of ``docs``; no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for index in indexes(benchmark, max_share, **kw):
        one = rows.mapInArrow(partial(_find_batches, shared=spark.sparkContext.broadcast(index)), f"id {docs.schema[id_col].dataType.simpleString()}, item_id bigint, distance int, first_word bigint, n_words int")
        out = one if out is None else out.union(one)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.2, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without rows in whose text an item is found; columns as they were, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in indexes(benchmark, max_share, **kw):
        shared = spark.sparkContext.broadcast(index)

        def kept(texts, shared=shared):
            out = np.ones(len(texts), bool)
            out[[x[0] for x in _find_in(texts, shared.value)]] = False
            return out

        @F.arrow_udf("boolean")
        def clean(texts, kept=kept):
            import pyarrow as pa

            return pa.array(by_slices(texts, kept, bool))

        docs = docs.where(clean(F.col(f"`{text_col}`")))
    return docs
