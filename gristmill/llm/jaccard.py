"""N-gram Jaccard join by PartEnum signatures, and the link components it yields.

Sets whose sizes lie in one band are compared in one *instance*. Two sets of
Jaccard similarity t or more differ in at most ``k`` elements there. The feature
domain is cut into first-level parts so many that some part holds at most
``k2`` of the differences, each part is cut again into ``n2`` parts, and every
choice of ``n2 - k2`` second-level parts becomes one signature: a hash of the
elements that fall there. Similar sets therefore share a signature.

Steps, all of them Spark jobs: texts with equal shingle sets collapse into a
class; signatures of class representatives are grouped; members of a signature
group are compared with the group's smallest member; components of the verified
links are formed; and where a signature group still spans several components,
its members are compared block by block. No step emits all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import settle
from gristmill.llm.graph import components
from gristmill.llm.wordhash import mix, shingles, slices

_U = np.uint64
#: Cells of the count sketch that bounds a difference from below.
CELLS = 256
#: Members of a signature group that are compared in one block.
BLOCK = 1500
#: Representatives up to this many copies' ids are broadcast (16 bytes each), else joined by shuffle.
COPIES_BROADCAST = 500_000


class Plan:
    """Size bands and PartEnum parameters for one similarity threshold."""

    def __init__(self, percent: int = 80, ratio: float = 1.3, slack: float = 1.2, n2: int = 2, k2: int = 1, largest: int = 1 << 40):
        self.percent, self.n2, self.k2 = percent, n2, k2
        bounds = [1]
        while bounds[-1] <= largest:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * ratio)))
        self.low = np.array(bounds, dtype=np.int64)
        top = np.append(self.low[1:] - 1, self.low[-1])
        self.k = self.differences(2 * top)
        self.n1 = np.maximum(1, np.ceil((self.k // (k2 + 1) + 1) * slack).astype(np.int64))
        self.n1[self.k == 0] = 1

    def differences(self, sizes: np.ndarray) -> np.ndarray:
        """Most elements in which two linked sets of this total size differ."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def instances(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own band, and whether a set of size n also meets sets of the next band."""
        own = np.searchsorted(self.low, n, side="right") - 1
        return own, n * 100 >= self.low[own + 1] * self.percent


def signatures(elements: np.ndarray, count: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(set index, signature) of all sets; ``elements`` lists them one after another.

    A signature of no element says nothing and is left out, unless a set has so
    few filled parts that the differences could touch all of them.
    """
    live = np.flatnonzero(count > 0)
    own, up = plan.instances(count[live])
    sets, bands = np.concatenate([live, live[up]]), np.concatenate([own, own[up] + 1])
    sizes, starts = count[sets], (np.cumsum(count) - count)[sets]
    row = np.repeat(np.arange(len(sets)), sizes)
    x = elements[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[row]]
    n1, k = plan.n1[bands], plan.k[bands]
    place = mix(x + _U(0x51ED270B))
    part = (place >> _U(20)) % n1[row].astype(np.uint64)
    whole = (k == 0)[row]
    sub = np.where(whole, _U(0), place % _U(plan.n2))
    cells = n1 * plan.n2
    base = np.cumsum(cells) - cells
    cell = base[row] + (part * _U(plan.n2) + sub).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, x = cell[order], mix(x[order] ^ _U(0x2545F4914F6CDD1D))
    starts = np.flatnonzero(np.diff(cell, prepend=-1)) if len(cell) else np.zeros(0, np.int64)
    total = int(cells.sum())
    filled = np.zeros(total, dtype=bool)
    summed = np.zeros(total, dtype=np.uint64)
    if len(starts):
        filled[cell[starts]] = True
        summed[cell[starts]] = np.add.reduceat(x, starts)
    cell_set = np.repeat(np.arange(len(sets)), cells)
    few = np.bincount(cell_set[filled], minlength=len(sets)) <= k
    out_set, out_sig = [], []
    own_row = np.repeat(np.arange(len(sets)), n1)
    first = np.repeat(base, n1) + (np.arange(len(own_row)) - np.repeat(np.cumsum(n1) - n1, n1)) * plan.n2
    label = mix((bands[own_row].astype(np.uint64) << _U(40)) + (first - base[own_row]).astype(np.uint64))
    for chosen in _choices(plan.n2, plan.n2 - plan.k2):
        sig, any_filled = label + _U(sum(1 << c for c in chosen)), np.zeros(len(own_row), dtype=bool)
        for c in chosen:
            sig = mix(sig * _U(0x9E3779B97F4A7C15) + summed[first + c])
            any_filled |= filled[first + c]
        keep = any_filled | (few[own_row] & (k[own_row] > 0))
        out_set.append(sets[own_row[keep]])
        out_sig.append(sig[keep])
    return np.concatenate(out_set), np.concatenate(out_sig)


def _choices(n: int, r: int) -> list[tuple[int, ...]]:
    from itertools import combinations

    return list(combinations(range(n), r))


def _sketch(elements: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Elements per cell, at most 255: sums of differences bound the set difference from below."""
    row = np.repeat(np.arange(len(count)), count)
    cell = row * CELLS + (mix(elements ^ _U(0xD6E8FEB86659FD93)) % _U(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=len(count) * CELLS), 255).astype(np.uint8).reshape(len(count), CELLS)


def _profile(width: int):
    """Per text: size, a 128-bit hash of its shingle set, and the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                x, n = shingles(texts[lo:hi], width)
                at = np.cumsum(n) - n
                sums = [np.add.reduceat(np.append(mix(x ^ _U(s)), _U(0)), at) if len(at) else np.zeros(0, np.uint64) for s in (3, 5)]
                vec = _sketch(x, n)
                yield pa.record_batch([ids[lo:hi], pa.array(n), *(pa.array(np.where(n > 0, s, 0).astype(np.uint64).view(np.int64)) for s in sums), pa.array([v.tobytes() for v in vec], pa.binary())], ["id", "n", "h1", "h2", "vec"])

    return run


def _sign(width: int, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo, hi in slices(texts, 500_000):
                x, n = shingles(texts[lo:hi], width)
                s, sig = signatures(x, n, plan)
                yield pa.record_batch([pa.array(sig.view(np.int64)), pa.array(ids[lo:hi][s])], ["sig", "id"])

    return run


def _near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, plan: Plan) -> np.ndarray:
    """False where sizes or count sketches prove that two sets are not linked."""
    ok = (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * plan.percent)
    if ok.any():
        gap = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=-1, dtype=np.int64)
        ok &= gap <= plan.differences(na + nb)
    return ok


def _prune(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a, c = (np.frombuffer(b"".join(b[k]), np.uint8).reshape(len(b), CELLS) for k in ("vec_a", "vec_b"))
                yield b.loc[_near(a, c, b["n_a"].to_numpy(), b["n_b"].to_numpy(), plan), ["a", "b"]]

    return run


def _blocks(plan: Plan):
    """Possible links between components within one block of a signature group.

    Rows come sorted by block. All blocks of a batch are compared together, each
    row with the row d places on for d = 1, 2, ... as far as any block reaches.
    """

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sig, i, j, side, ids, comp, n = (t.column(k).to_numpy() for k in ("sig", "i", "j", "side", "id", "comp", "n"))
        vec = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.uint8).reshape(len(sig), CELLS)
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(sig)))
        after = np.repeat(length, length) - (np.arange(len(sig)) - np.repeat(first, length)) - 1
        p, d = np.flatnonzero(after > 0), 1
        while len(p):
            q = p + d
            live = (comp[p] != comp[q]) & ((i[p] == j[p]) | (side[p] != side[q]))
            live &= np.minimum(n[p], n[q]) * 100 >= np.maximum(n[p], n[q]) * plan.percent
            for lo in range(0, int(live.sum()), 20_000):
                a, b = p[live][lo : lo + 20_000], q[live][lo : lo + 20_000]
                near = _near(vec[a], vec[b], n[a], n[b], plan)
                if near.any():
                    a, b = ids[a[near]], ids[b[near]]
                    yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])
            d += 1
            p = p[after[p] >= d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            last = [held.column(k)[-1].as_py() for k in ("sig", "i", "j")]
            tail = np.logical_and.reduce([held.column(k).to_numpy() == v for k, v in zip(("sig", "i", "j"), last, strict=True)])
            cut = int(np.argmax(tail))
            if cut:
                yield from pairs(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from pairs(held.combine_chunks())

    return run


def _verify(width: int, percent: int):
    """Exact check of the pairs that were gathered for one text against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            ta, tb = ta.to_pylist(), tb.to_pylist()
            keep = np.zeros(len(ta), dtype=bool)
            for lo, hi in slices([x + y for x, y in zip(ta, tb, strict=True)]):
                xa, na = shingles(ta[lo:hi], width)
                xb, nb = shingles(tb[lo:hi], width)
                row = np.concatenate([np.repeat(np.arange(hi - lo), na), np.repeat(np.arange(hi - lo), nb)])
                x = np.concatenate([xa, xb])
                order = np.lexsort((x, row))
                x, row = x[order], row[order]
                twin = (x[1:] == x[:-1]) & (row[1:] == row[:-1])
                both = np.bincount(row[1:][twin], minlength=hi - lo)
                keep[lo:hi] = (100 * both >= percent * (na + nb - both)) & (both > 0)
            mask = pa.array(keep)
            yield pa.record_batch([a.filter(mask), b.filter(mask)], ["u", "v"])

    return run


def _links(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that truly link; texts are fetched by two joins on the id."""
    left, right = docs.select(F.col("id").alias("a"), F.col("text").alias("ta")), docs.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(width, percent), "u long, v long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    Two rows link when ``100 * intersection >= percent * union`` of their distinct
    ``width``-word shingles; component_id is the smallest id reachable by links.
    Null or wordless texts have 0 shingles and stand alone. Rows with a null id
    are not linked: their component_id is null. Rows that repeat an id are one
    node that carries the sets of all of them. Other columns are ignored; an
    empty table gives an empty result.
    """
    plan = Plan(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = settle(docs.mapInArrow(_profile(width), "id long, n long, h1 long, h2 long, vec binary"))
    known = profile.filter("n > 0 and id is not null")
    sets = known.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    # Written first, so that a set which most rows share is one side's plain key and Spark can split its rows.
    shared = settle(sets.filter("rep != last").drop("last"))
    shared = F.broadcast(shared) if shared.count() <= COPIES_BROADCAST else shared
    copies = settle(known.join(shared, ["n", "h1", "h2"]).filter("id != rep").select("id", "rep"))
    # An id that repeats may copy one set and represent another: only ids all of whose rows are copies leave the search.
    gone = settle(copies.groupBy("id").agg(F.count("*").alias("rows")).join(known.groupBy("id").agg(F.count("*").alias("rows")), ["id", "rows"]).select("id"))
    gone = F.broadcast(gone) if gone.count() <= COPIES_BROADCAST else gone
    alone = docs.filter("id is not null and text is not null").join(gone, "id", "left_anti").select("id", "text")

    by_sig = Window.partitionBy("sig")
    groups = alone.mapInArrow(_sign(width, plan), "sig long, id long").select("sig", "id", F.min("id").over(by_sig).alias("hub"), F.max("id").over(by_sig).alias("far")).filter("hub != far").drop("far")
    groups = settle(groups.distinct())
    # Copies keep their set's sketch under the representative's id.
    vecs = known.join(gone, "id", "left_anti").select("id", "n", "vec")
    star = groups.filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    star = (
        star.join(vecs.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("vec").alias("vec_a")), "a")
        .join(vecs.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("vec").alias("vec_b")), "b")
        .mapInPandas(_prune(plan), "a long, b long")
        .distinct()
    )
    linked = settle(_links(alone, settle(star), width, percent))

    root = settle(components(linked))
    placed = groups.select("sig", "id").join(root, "id", "left").select("sig", "id", F.coalesce("root", "id").alias("comp"))
    spread = placed.select("sig", "id", "comp", F.min("comp").over(by_sig).alias("lo"), F.max("comp").over(by_sig).alias("hi")).filter("lo != hi").drop("lo", "hi")
    sized = spread.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    spread = spread.join(sized, "sig").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("sig", "id", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    rest = (
        dealt.join(vecs, "id")
        .select("sig", "i", "j", "side", "id", "comp", "n", "vec")
        .repartition("sig", "i", "j")
        .sortWithinPartitions("sig", "i", "j")
        .mapInArrow(_blocks(plan), "a long, b long")
        .distinct()
    )
    more = settle(_links(alone, settle(rest), width, percent))
    tied = more.select("u", "v").unionByName(root.select(F.col("id").alias("u"), F.col("root").alias("v"))).unionByName(copies.select(F.col("id").alias("u"), F.col("rep").alias("v")))
    final = components(tied)
    return (
        profile.select(F.col("id"), F.col("n").alias("n_shingles"))
        .join(final, "id", "left")
        .select("id", "n_shingles", F.coalesce("root", "id").alias("component_id"))
    )
