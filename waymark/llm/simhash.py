"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming checks, components.

``Plan`` fixes the shingles, the bits and the blocks. With ``m`` blocks of which a pair within
``distance`` bits shares at least ``m - distance``, one table for each choice of that many blocks
finds every such pair: no link is lost. Wider fingerprints, where so many blocks can't be shared,
take tables of two bytes each, or of more in a larger corpus; what they find is measured in the README. A plan with a ``similarity``
then checks links on the texts' shingle sets, so that nothing below it is linked, and where a link
fails, all pairs of what it linked. Its fingerprints are of distinct shingles, as its similarity is,
and texts are one node where their sets of shingles are equal, not where their fingerprints are.

Null and empty texts have fingerprint zero, linked like any other in :func:`near_duplicates`;
repeated rows share a fingerprint and so a component; a null ``doc_id`` keeps its row but names no
component of others. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial
from itertools import combinations
from math import ceil, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import batches, components, dropped, small_batches, written

#: Shingles hashed at a time, so that long texts take bounded memory.
BLOCK = 1 << 16
#: Fingerprints of one bucket that one kernel call compares; larger buckets are dealt out in pairs of parts.
BUCKET = 4096
#: Rows in a part, and bytes of their shingles, where large blocks are compared by similarity; parts grow to eight times the rows.
PART, PART_BYTES = 256, 1 << 24


@dataclass(frozen=True)
class Plan:
    """``words`` in a shingle, ``bits`` of a fingerprint, ``distance`` in bits that links, ``tables``, and the ``similarity`` that links must have.

    A table is a list of ``(word of 64 bits, mask)``; fingerprints that agree under all its masks meet.
    """

    words: int = 4
    bits: int = 64
    distance: int = 4
    tables: tuple = ()
    similarity: float | None = None


def _choices(places: list[int], blocks: int, distance: int) -> list[int]:
    """Masks over all choices of ``blocks - distance`` of so many blocks of the bits at ``places``."""
    cuts = [round(i * len(places) / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]


def exact_tables(bits: int = 64, blocks: int = 7, distance: int = 4) -> tuple:
    """Choices of ``blocks - distance`` of ``blocks`` blocks: every pair within ``distance`` shares one."""
    return tuple(((0, mask),) for mask in _choices(list(range(bits)), blocks, distance))


def paired_tables(bits: int = 256, steps: tuple = ((1,), (5,))) -> tuple:
    """A byte of the fingerprint and those ``steps`` further, all round, for each table."""
    n = bits // 8
    return tuple(tuple(((j % n) // 8, 255 << (8 * ((j % n) % 8))) for j in (i, *(i + s for s in step))) for step in steps for i in range(n))


#: The contract's plan: no link within 4 of 64 bits is lost.
EXACT = Plan(4, 64, 4, exact_tables())
#: Five-word shingles at a similarity of 0.8: 256 bits, of which such pairs differ in about 39, give or take 6.
SIMILAR = Plan(5, 256, 56, paired_tables(), 0.8)
#: Fingerprints in a bucket on average, up to which keys of two bytes do.
AVERAGE = 1024


def scaled(plan: Plan, rows: int) -> Plan:
    """The plan for so many fingerprints: keys of more bytes where buckets would grow with the corpus, and tables enough to find as many pairs.

    Of the bits of a pair at 0.8, 0.85 agree: a key of ``k`` bytes does in ``0.85 ** (8 * k)`` of tables.
    """
    size = 2
    while rows > AVERAGE << (8 * size):
        size += 1
    if plan.similarity is None or size == 2:
        return plan
    missed = (1 - 0.85**16) ** len(plan.tables)
    need = ceil(log(missed) / log(1 - 0.85 ** (8 * size)) / (plan.bits // 8))
    n = plan.bits // 8
    steps = [c for c in combinations(range(1, n), size - 1)]
    return replace(plan, tables=paired_tables(plan.bits, tuple(steps[i * len(steps) // need] for i in range(need))))



def _hashes(words: list[bytes], k: int):
    import xxhash

    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - k + 1)
    for a in range(0, n, BLOCK):
        part = words[a : a + BLOCK + k - 1] if len(words) > k else words
        m = max(1, len(part) - k + 1)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        joined = b" ".join(part)
        lo, hi = [0, *ends[: m - 1].tolist()], (ends[len(part) - m :] - 1).tolist()
        yield np.fromiter((h(joined[x:y], 42) for x, y in zip(lo, hi, strict=True)), "<u8", m)


def _wider(h: np.ndarray, more: int) -> np.ndarray:
    """Further 64-bit hashes from the first one, for wide fingerprints."""
    from waymark.llm.common import mixed

    return np.stack([h, *[mixed(h + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) for i in range(more)]], 1)


def _names(plan: Plan) -> list[str]:
    """Columns that tell nodes apart: the fingerprint's words and, with a similarity, the digest of the set of shingles."""
    return [*[f"f{i}" for i in range(plan.bits // 64)], *(["digest"] if plan.similarity is not None else [])]


def fingerprint(text: str | None, plan: Plan = EXACT) -> list[int]:
    """The fingerprint as unsigned 64-bit words: a bit is 1 if set in over half of the shingles' hashes."""
    return _of_bytes((text or "").encode(), plan)


def _of_bytes(raw: bytes, plan: Plan) -> list[int]:
    return _node(raw, plan)[0][: plan.bits // 64]


def _node(raw: bytes, plan: Plan) -> tuple[list[int], bytes]:
    """The fingerprint; with a similarity, of distinct shingles, with the digest of their set after it, and the set itself."""
    wide = plan.bits // 64
    words = raw.lower().split()  # bytes: A-Z alone are lower-cased, and ASCII white space alone splits
    if not words:
        return [0] * len(_names(plan)), b""
    import xxhash

    ones, n, kinds, parts = np.zeros(plan.bits, np.int64), 0, b"", _hashes(words, plan.words)
    if plan.similarity is not None:
        distinct = np.unique(np.concatenate(list(parts)))
        kinds = np.unique((distinct & np.uint64(0xFFFFFFFF)).astype("<u4")).tobytes()
        parts = (distinct[a : a + BLOCK] for a in range(0, len(distinct), BLOCK))
    for h in parts:
        n += len(h)
        h = _wider(h, wide - 1) if wide > 1 else h
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), plan.bits // 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    print_ = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8").tolist()
    return print_ + ([xxhash.xxh64_intdigest(kinds)] if plan.similarity is not None else []), kinds


def _print_batches(rows, plan: Plan):
    import pyarrow as pa

    for b in batches(rows):
        data = b.column(1).cast(pa.large_binary())
        prints = np.array([_node(x.as_py() or b"", plan)[0] for x in data], dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(prints[:, i]) for i in range(prints.shape[1])]], names=["id", *_names(plan)])


def fingerprints(docs: DataFrame, plan: Plan = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, f0, f1, ...``: a row for each row of ``docs``, 64 bits in each signed long; with a similarity, ``digest`` too."""
    small_batches(docs.sparkSession)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{x} bigint" for x in _names(plan))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(partial(_print_batches, plan=plan), schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(plan: Plan) -> Column:
    """The fingerprint's key in each table, as an array of structs."""
    out = []
    for t, parts in enumerate(plan.tables):
        masked = [F.col(f"f{w}").bitwiseAND(F.lit(_signed(mask))) for w, mask in parts]
        key = masked[0] if len(masked) == 1 else F.xxhash64(*masked)
        out.append(F.struct(F.lit(t).cast("smallint").alias("t"), key.alias("k")))
    return F.array(*out)


def _within(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints ^ one).sum(1, dtype=np.int32)


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``distance`` bits, one less than each group has members.

    Each row is reached once and then leaves the rows yet to be searched, so a dense group takes
    time in proportion, and no pairs are written out.
    """
    links, left = [], np.arange(len(prints))
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            near = _within(prints[left], prints[todo.pop()]) <= distance
            if near.any():
                got = left[near]
                left = left[~near]
                links += [(int(root), int(x)) for x in got]
                todo += got.tolist()
    return links


def spanning(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """The links of a least spanning forest: each row hangs on the one nearest to what is reached.

    What a failed check takes apart is compared again in :func:`similar_components`.
    """
    links, far = [], np.int32(1 << 30)
    near, via, done = np.full(len(prints), far), np.zeros(len(prints), np.int64), np.zeros(len(prints), bool)
    x = 0
    for _ in range(len(prints) - 1):
        done[x] = True
        near[x] = far
        d = _within(prints, prints[x])
        closer = (d < near) & ~done
        near[closer], via[closer] = d[closer], x
        x = int(near.argmin())
        if near[x] <= distance:
            links.append((int(via[x]), x))
    return links


def _groups(rows, distance: int, join=forest, wide: int | None = None):
    """Links within runs of equal ``g`` of sorted rows ``g, f0, ...``, of which ``wide`` are compared; a run may cross batches."""
    import pyarrow as pa

    def cols(b):
        return np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)], 1)

    def links(x: np.ndarray):
        g, n = x[:, 0], len(x)
        prints = np.ascontiguousarray(x[:, 1 : None if wide is None else 1 + wide]).view(np.uint64)
        cut = np.concatenate([[0], np.nonzero((x[1:, 0] != x[:-1, 0]))[0] + 1, [n]])
        size = np.diff(cut)
        small = np.repeat(size <= 8, size)
        for d in range(1, 8):  # small runs: all at once, by shifts
            if n <= d:
                break
            ok = np.nonzero((g[d:] == g[:-d]) & small[d:])[0]
            if not len(ok):
                break
            ok = ok[np.bitwise_count(prints[ok] ^ prints[ok + d]).sum(1, dtype=np.int32) <= distance]
            if len(ok):
                yield ok, ok + d
        for i in np.nonzero(size > 8)[0]:
            got = join(prints[cut[i] : cut[i + 1]], distance)
            if got:
                ab = np.array(got) + cut[i]
                yield ab[:, 0], ab[:, 1]

    def out(x: np.ndarray):
        for ab in links(x):
            raw = [np.ascontiguousarray(x[i, 1:]).astype("<i8") for i in ab]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()) for rows in raw], names=["a", "b"])

    held: list[np.ndarray] = []
    for b in rows:
        if not b.num_rows:
            continue
        x = cols(b)
        held.append(x)
        whole = np.concatenate(held) if len(held) > 1 else x
        last = np.nonzero(whole[:, 0] != whole[-1, 0])[0]
        if not len(last):
            held = [whole]
            continue
        yield from out(whole[: last[-1] + 1])
        held = [whole[last[-1] + 1 :]]
    if held:
        yield from out(np.concatenate(held))


def links(prints: DataFrame, plan: Plan) -> DataFrame:
    """``a, b`` (fingerprints as binaries) that connect all distinct fingerprints linked by the plan.

    Rows meet by table and key. Buckets above ``BUCKET`` rows, found from counts that are combined before
    their shuffle, are taken apart before their rows are moved: an exact plan meets them again in blocks
    of the bits that the bucket doesn't share; what is large still is dealt out as pairs of parts, each no
    larger than half a bucket. So no task holds a large bucket and no link is left out.
    """
    fs = _names(plan)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = prints.select(*fs, F.explode(_keys(plan)).alias("x")).select("x.t", "x.k", *fs)

    def large(rows: DataFrame, by: list[str]) -> DataFrame:
        return written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET), "large")

    def parted(rows: DataFrame, by: list[str]) -> DataFrame:
        """Rows of large buckets, each part to meet each other one and so itself."""
        parts = F.ceil(F.col("n") * 2 / BUCKET).cast("int")
        rows = rows.withColumns({"p": parts, "o": F.pmod(F.xxhash64(*fs), parts).cast("int")}).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).where("j <> o")
        return rows.select(F.xxhash64(*by, F.least("o", "j"), F.greatest("o", "j")).alias("g"), *fs)

    by, hot = ["t", "k"], large(met, ["t", "k"])
    if hot.isEmpty():
        rows = met.select(F.xxhash64(*by).alias("g"), *fs)
        dropped(hot)
    else:
        met = met.join(hot, by, "left")
        rows, met = met.where("n is null").select(F.xxhash64(*by).alias("g"), *fs), met.where("n is not null")
        if plan.similarity is None and plan.bits == 64:
            masks = [_choices([i for i in range(64) if not mask >> i & 1], 7, plan.distance) for ((_, mask),) in plan.tables]
            every, per = F.array(*[F.lit(_signed(m)) for own in masks for m in own]), len(masks[0])
            met = met.drop("n").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
            met = met.withColumn("k2", F.col("f0").bitwiseAND(F.get(every, F.col("t").cast("int") * per + F.col("s"))))
            by = [*by, "s", "k2"]
            met = met.join(large(met, by), by, "left")
            rows = rows.union(met.where("n is null").select(F.xxhash64(*by).alias("g"), *fs))
            met = met.where("n is not null")
        rows = rows.union(parted(met, by))
    kernel = partial(_groups, distance=plan.distance, join=forest if plan.similarity is None else spanning, wide=plan.bits // 64)
    return rows.repartition(n, "g").sortWithinPartitions("g").mapInArrow(kernel, "a binary, b binary").distinct()


def _set_batches(rows, plan: Plan):
    """``node, shingles``: a text's node (fingerprint and digest), and its distinct shingles as sorted 32-bit hashes."""
    import pyarrow as pa

    for b in batches(rows):
        for a in range(0, b.num_rows, 64):
            nodes, sets = [], []
            for x in b.column(0).slice(a, 64).cast(pa.large_binary()):
                node, kinds = _node(x.as_py() or b"", plan)
                nodes.append(np.array(node, "<u8").tobytes())
                sets.append(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "shingles"])


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sorted sets of 32-bit hashes."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _check_batches(rows, least: float):
    import pyarrow as pa

    for b in batches(rows):
        ok = [jaccard(x.as_buffer(), y.as_buffer()) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def grown(roots: list[bytes], sets: list[bytes], least: float) -> set[tuple[bytes, bytes]]:
    """Pairs of roots that connect all rows whose sets are ``least`` similar; rows of one root are connected already.

    A row that fails against one row stays and is tried against all others that are reached, so no
    pair is left out unless both of its rows are connected otherwise.
    """
    sizes = np.array([len(x) // 4 for x in sets])
    starts = np.cumsum(sizes) - sizes
    kinds, ids = np.unique(np.frombuffer(b"".join(sets), "<u4"), return_inverse=True)
    names, label = np.unique(np.array(roots, object), return_inverse=True)
    mark, left, out = np.zeros(len(kinds), bool), np.arange(len(sets)), set()
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            got = label[left] == label[x]
            short, long = np.minimum(sizes[left], sizes[x]), np.maximum(sizes[left], sizes[x])
            may = np.nonzero(~got & (short > 0) & (short / np.maximum(1, long) >= least))[0]  # no pair of other sizes can be so similar
            if len(may):
                y = left[may]
                ends = np.cumsum(sizes[y])
                own = ids[starts[x] : starts[x] + sizes[x]]
                mark[own] = True
                both = np.add.reduceat(mark[ids[np.arange(ends[-1]) + np.repeat(starts[y] - ends + sizes[y], sizes[y])]], ends - sizes[y], dtype=np.int64)
                mark[own] = False
                good = may[both / (sizes[x] + sizes[y] - both) >= least]
                got[good] = True
                out |= {(names[label[x]], names[k]) for k in np.unique(label[left[good]])}
            todo += left[got].tolist()
            left = left[~got]
    return out


def _grow_batches(rows, least: float):
    """:func:`grown` over runs of equal ``g`` of sorted rows ``g, root, shingles``; a run may cross batches."""
    import pyarrow as pa

    def out(roots, sets):
        pairs = sorted(grown(roots, sets, least)) if len(roots) > 1 else []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], names=["a", "b"])

    at, roots, sets = None, [], []
    for b in batches(rows):
        for g, root, shingles in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if g != at:
                yield from out(roots, sets)
                at, roots, sets = g, [], []
            roots.append(root), sets.append(shingles)
    yield from out(roots, sets)


def _rooted(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``df`` with the root of ``column`` in its place, where it has one."""
    r = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return df.join(r, F.col(column) == F.col("__node"), "left").withColumn(column, F.coalesce("__root", column)).drop("__node", "__root")


def similar_components(found: DataFrame, kinds: DataFrame, docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """``node, root`` of every fingerprint in ``found``: components by links as similar as the plan asks for.

    The links found are checked first. Where some fail, so that what they linked in bits is apart,
    all rows of those parts are compared with one another by similarity alone: a link that fails
    costs no other pair. Texts without any link aren't looked at again.
    """
    fs = _names(plan)
    found = written(found, "links")
    nodes = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    ids = written(kinds.withColumn("node", _raw(fs)).join(nodes, "node", "left_semi").select(F.col("first").alias("__id")).distinct(), "linked")
    texts = docs.join(ids, docs[id_col].eqNullSafe(ids["__id"]), "left_semi").select(F.col(f"`{text_col}`").alias("text"))
    # rows of one id may differ in text, so a set goes by its text's node
    sets = written(texts.mapInArrow(partial(_set_batches, plan=plan), "node binary, shingles binary").dropDuplicates(["node"]), "sets")
    rows = found.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    tested = written(rows.select("a", "b", "x", "y").mapInArrow(partial(_check_batches, least=plan.similarity), "a binary, b binary, ok boolean"), "tested")
    roots = components(tested.where("ok").select("a", "b"))
    apart = written(_rooted(_rooted(tested.where("not ok").select("a", "b"), "a", roots), "b", roots).where("a <> b").distinct(), "apart")
    if apart.isEmpty():
        return roots
    blocks = components(apart).select(F.col("node").alias("root"), F.col("root").alias("block"))
    members = _rooted(sets.withColumn("root", F.col("node")), "root", roots).join(blocks, "root").select("block", "root", "node", "shingles")
    members = written(members, "members")
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    sizes = sizes.select("block", F.greatest(F.least(F.ceil(F.col("n") / PART), F.lit(16)), F.ceil(F.col("n") / (8 * PART)), F.ceil(F.col("bytes") / PART_BYTES)).cast("int").alias("p"))
    # large blocks are dealt out as pairs of parts; a part meets itself in its pairs with others
    dealt = members.join(sizes, "block").withColumn("o", F.pmod(F.xxhash64("node"), "p").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).where("p = 1 or j <> o")
    dealt = dealt.select(F.xxhash64("block", F.least("o", "j"), F.greatest("o", "j")).alias("g"), "root", "shingles")
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = dealt.repartition(n, "g").sortWithinPartitions("g").mapInArrow(partial(_grow_batches, least=plan.similarity), "a binary, b binary")
    more = components(more.distinct())
    whole = written(_rooted(_rooted(sets.select("node", F.col("node").alias("root")), "root", roots), "root", more), "similar")
    dropped(found, ids, sets, tested, roots, apart, members, more)
    return whole


def grouped(prints: DataFrame, plan: Plan, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``f0, ..., first, component``: least id of each distinct fingerprint (and set of shingles), and of its component.

    ``docs`` are the rows that ``prints`` are of; a plan with a ``similarity`` needs them.
    """
    fs = _names(plan)
    kinds = written(prints.groupBy(*fs).agg(F.min("id").alias("first")), "kinds")
    plan = scaled(plan, kinds.count())
    found = links(kinds, plan)
    found = components(found) if plan.similarity is None else similar_components(found, kinds, docs, plan, id_col, text_col)
    raw = _raw(fs)
    marked = kinds.withColumn("node", raw).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    marked = written(marked.select(*fs, "first", "root"), "marked")
    least = written(marked.groupBy("root").agg(F.min("first").alias("component")), "roots")
    out = written(marked.join(least, "root").select(*fs, "first", "component"), "grouped")
    dropped(kinds, found, marked, least)
    return out


def _raw(fs: list[str]) -> Column:
    """The fingerprint as the kernel's little-endian bytes."""
    return F.concat(*[F.unhex(F.concat(*[F.substring(F.lpad(F.hex(f), 16, "0"), 15 - 2 * i, 2) for i in range(8)])) for f in fs])


def near_duplicates(docs: DataFrame, plan: Plan = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, f0, ..., component``: for each row the least id reachable over links, its own included."""
    fs = _names(plan)
    prints = written(fingerprints(docs, plan, id_col, text_col), "prints")
    return prints.join(grouped(prints, plan, docs, id_col, text_col).drop("first"), fs, "left")


def keep_first(docs: DataFrame, plan: Plan = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the least id; columns as they were.

    Rows with no words, or no id, aren't copies of one another and stay. Rows of one id stay or go
    together.
    """
    fs = _names(plan)
    empty = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    some = docs.where(~empty & F.col(f"`{id_col}`").isNotNull())
    prints = written(fingerprints(some, plan, id_col, text_col), "prints")
    firsts = grouped(prints, plan, some, id_col, text_col)
    later = prints.join(firsts, fs).where("id <> component").select("id")
    later = written(later.distinct(), "later")
    return docs.join(later, docs[id_col] == later["id"], "left_anti")
