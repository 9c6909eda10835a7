"""Exact self join of documents on the Jaccard similarity of their word n-gram sets, up to connected components.

Jaccard distance is a metric, so pivots can cut the space into Voronoi regions:
a pair within distance r of each other meets in the region of either one's
nearest pivot if a document is copied to every region whose pivot is at most
2r farther from it than its nearest. Regions join recursively and exactly.

Unrelated texts all lie at distance 1 from each other and from any pivot, where
no window excludes anything (see the README). So regions are laid only where
distances differ, in families: equal sets are first one class; then, as linked
sets of n and m grams differ in at most k = (n + m)(1 - t) / (1 + t) grams, at
least one of k + 1 parts of the grams (by hash) is equal in both, and classes
that have an equal part are candidates. Connected candidates form a family. A
family is joined by pivots, windows and recursion, a large one over several
tasks. Every link is decided on whole sets in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

U = np.uint64
#: Classes that one task joins by itself; larger families are cut by pivots, and what pivots can't cut by blocks.
LEAF = 500
PIVOTS, MOST_DEPTH, SALTS = 12, 4, 32
#: Tasks of a shuffle at the most; a driver keeps track of no more. Beyond 10**11 grams tasks grow.
MOST_PARTS = 100_000
#: Bytes of grams that a round of pairs of blocks moves, or a quarter of the grams of all documents if that is more.
ROUND_BYTES = 1 << 28
#: Rows of class keys up to which a semi join sends them to all executors (8 bytes each); more are shuffled.
BROADCAST_ROWS = 400_000


class Rule:
    """similarity >= num/100 of sets of k-word shingles, and the parts that give candidates."""

    def __init__(self, k: int = 3, percent: int = 90):
        self.k, self.percent = k, percent
        self.r = 1 - percent / 100
        ratio = 1.3 if percent >= 88 else 1.5
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * ratio)))
        self.low = np.array(low, np.int64)
        self.high = (self.low[1:] - 1) * 100 // percent  # the largest partner of a set of this level
        differ = (self.low[1:] - 1 + self.high) * (100 - percent) // (100 + percent)
        spare = np.where(differ > 0, 1 + differ // 12, 0)
        self.parts = np.where(differ > 0, differ + 1 + spare, 0)  # none: only equal sets link
        self.spare = spare
        mean = self.low[:-1] / np.maximum(self.parts, 1)
        self.weak = np.select([mean >= 6, mean >= 4], [2, 1], 0)  # a part of so few grams says little

    def level(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def linked(self, inter, n, m):
        return 100 * inter >= self.percent * (n + m - inter)


def tidy(run):
    """run, and then the task's freed memory goes back to the system; an idle worker would keep it."""

    def to_the_end(batches):
        yield from run(batches)
        common.trim()

    return to_the_end


def gram_sets(rule: Rule, data: np.ndarray, offsets: np.ndarray):
    """(distinct grams sorted, document of each, offsets, class key) of documents; the key of an empty set is 0."""
    n = len(offsets) - 1
    start, end, doc = common.words(data, offsets)
    grams, doc = common.shingles(common.word_hashes(data, start, end), doc, n, rule.k)
    grams, doc, at = common.in_groups(grams, doc, n)
    a, b = np.zeros(n, U), np.zeros(n, U)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        a[some] = np.add.reduceat(common.mix(grams ^ U(0x5851F42D4C957F2D)), at[some])
        b[some] = np.add.reduceat(common.mix(grams * U(0xDA942042E4DD58B5)), at[some])
    key = common.mix(a ^ common.mix(b + (at[1:] - at[:-1]).astype(U)))
    key[at[1:] == at[:-1]] = 0
    return grams, doc, at, key.view(np.int64)


def part_keys(rule: Rule, grams: np.ndarray, doc: np.ndarray, at: np.ndarray):
    """(key, document) of the parts of every document that has any, in its own level and, near its lower border, the one below."""
    n = np.diff(at)
    level = rule.level(np.maximum(n, 1))
    out_k, out_d = [], []
    for down in (0, 1):
        lv = level - down
        on = (n > 0) & (lv >= 0)
        lv = np.maximum(lv, 0)
        if down:
            on &= n <= rule.high[lv]
        parts = np.where(on, rule.parts[lv], 0)
        base = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)
        if not base[-1]:
            continue
        use = parts[doc] > 0
        g, d = grams[use], doc[use]
        h = common.mix(g + U(0x2545F4914F6CDD1D))
        slot = base[d] + ((h >> U(32)) * parts[d].astype(U) >> U(32)).astype(np.int64)
        total = np.zeros(base[-1], U)
        np.add.at(total, slot, common.mix(h))
        size = np.bincount(slot, minlength=base[-1])
        owner = np.repeat(np.arange(len(n)), parts)
        weak = size <= rule.weak[lv][owner]
        many = np.bincount(owner, weak, minlength=len(n)) > rule.spare[lv]
        keep = ~weak | many[owner]  # with few weak parts, one of those equal in both is not weak
        name = (lv[owner].astype(U) << U(40)) + (np.arange(base[-1]) - base[:-1][owner]).astype(U)
        out_k.append(common.mix(total + common.mix(name + (size.astype(U) << U(52))))[keep])
        out_d.append(owner[keep])
    if not out_k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_k).view(np.int64), np.concatenate(out_d)


def stars(keys: np.ndarray, classes: np.ndarray):
    """For each key its least class, and an edge from that to each other class of the key: (keys, leasts, edges)."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = classes[first][np.cumsum(first) - 1]
    other = classes != least
    edges = np.unique(np.stack([least[other], classes[other]], 1), axis=0)
    return keys[first], classes[first], edges


def classes_of(docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, n, c): the size of each document's set and its class."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        common.begin("powers")
        for b in batches:
            for i, j, data, offsets in common.chunks(b.column(1)):
                _, _, at, key = gram_sets(rule, data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(key)], ["id", "n", "c"])

    return docs.mapInArrow(tidy(run), f"id {kind}, n bigint, c bigint")


def candidate_edges(docs: DataFrame, rule: Rule, n_parts: int) -> DataFrame:
    """(a, b): edges that connect all classes with an equal part.

    Each task makes stars of what it has read and sends on one class for each part, so a part that a third of all
    documents share arrives as often as there are tasks.
    """

    def packed(batches):
        common.begin("powers")
        for b in batches:
            for _, _, data, offsets in common.chunks(b.column(0), 4_000_000):
                ks, cs = [], []
                for grams, doc, at, key in pieces(rule, data, offsets):  # sets in small pieces, stars over all
                    k, d = part_keys(rule, grams, doc, at)
                    ks.append(k)
                    cs.append(key[d])
                k, c, edges = stars(np.concatenate(ks), np.concatenate(cs))
                if len(edges):
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - int(edges[0, 0] % n_parts)], pa.int64()), pa.array([edges[:, 0].tobytes()]), pa.array([edges[:, 1].tobytes()])], ["part", "a", "b"])
                yield dealt(k, c, n_parts)

    def joined(batches):
        common.begin("powers")
        out = []
        keys, classes, edges = gathered(batches)
        if len(keys):
            out.append(stars(keys, classes)[2])
        out += edges
        if out:
            edges = np.unique(np.concatenate(out), axis=0)
            for i in range(0, len(edges), 1 << 16):
                part = np.ascontiguousarray(edges[i : i + (1 << 16)].T)
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], ["a", "b"])

    rows = docs.select("text").mapInArrow(tidy(packed), "part bigint, a binary, b binary")
    return rows.repartition(n_parts, "part").mapInArrow(tidy(joined), "a bigint, b bigint").distinct()


def pieces(rule: Rule, data: np.ndarray, offsets: np.ndarray, limit: int = 1_000_000):
    """gram_sets of runs of documents of about `limit` bytes."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = min(len(offsets) - 1, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield gram_sets(rule, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def dealt(keys: np.ndarray, classes: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """A row for each part with its keys, of which 32 bits are enough beside the part (equal ones are only candidates), and classes."""
    part = (keys.view(U) % U(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n_parts + 1))
    k, c = (keys.view(U)[order] >> U(32)).astype(np.uint32), classes[order]
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([k[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary()), pa.array([c[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary())], ["part", "a", "b"])


def gathered(batches) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, classes, edges) of a task's rows of dealt(); rows of negative parts are edges."""
    ks, cs, edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for b in batches:
        for part, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            y = np.frombuffer(y.as_buffer(), np.int64)
            if part < 0:
                edges.append(np.stack([np.frombuffer(x.as_buffer(), np.int64), y], 1))
            else:
                ks.append(np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) | part << 32)
                cs.append(y.copy())
    return np.concatenate(ks), np.concatenate(cs), edges


def promising(docs: DataFrame, rule: Rule, n_parts: int) -> DataFrame:
    """(c, shared): in how many of its grams each class meets another class, or a few more where docs repeat a class.

    A gram goes to its task once for each run of documents: with its class if that is the only one there, else as a mark
    (class 0), so a gram that a third of all documents share arrives as often as there are runs.
    """

    def packed(batches):
        common.begin("powers")
        for b in batches:
            for _, _, data, offsets in common.chunks(b.column(0), 4_000_000):
                ks, cs = [], []
                for grams, doc, _, key in pieces(rule, data, offsets):
                    ks.append(common.mix(grams + U(0x632BE59BD9B4E019)).view(np.int64))
                    cs.append(key[doc])
                keys, classes, shared = together(np.concatenate(ks), np.concatenate(cs))
                # grams that two classes have here are counted here; other tasks only need to know that there are some
                yield totals(classes[shared], 1)
                first = np.ones(len(keys), bool)
                first[1:] = keys[1:] != keys[:-1]
                yield dealt(keys[first], np.where(shared, 0, classes)[first], n_parts)

    def together(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, sorted by key, and which keys stand with more than one class. Class 0 is a class of its own in each row."""
        order = np.lexsort((classes, keys))
        keys, classes = keys[order], classes[order]
        keep = np.ones(len(keys), bool)
        keep[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])
        keys, classes = keys[keep], classes[keep]
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        return keys, classes, same[1:] | same[:-1]

    def totals(classes: np.ndarray, side: int) -> pa.RecordBatch:
        """How often each class comes, packed for the tasks of classes, a row for each pair of tasks; side 1 goes past the tasks of grams."""
        c, n = np.unique(classes[classes != 0], return_counts=True)
        part = (c.view(U) % U(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        c, n = c[order], n[order].astype(np.int64)
        cut = np.searchsorted(part[order], np.arange(n_parts + 1))
        full = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([pa.array(-1 - full if side else full, pa.int64()), pa.array([n[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary()), pa.array([c[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary())], ["part", "a", "b"])

    def counted(batches):
        common.begin("powers")
        mine = []
        for b in batches:
            past = np.array([p < 0 for p in b.column(0).to_pylist()], bool)
            if past.any():
                on = b.filter(pa.array(past))
                yield pa.RecordBatch.from_arrays([pa.array([-1 - p for p in on.column(0).to_pylist()], pa.int64()), on.column(1), on.column(2)], ["part", "a", "b"])
            if not past.all():
                mine.append(b.filter(pa.array(~past)))
        keys, classes, _ = gathered(mine)
        _, classes, shared = together(keys, classes)
        yield totals(classes[shared], 0)

    def added(batches):
        ns, cs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            for x, y in zip(b.column(1), b.column(2), strict=True):
                ns.append(np.frombuffer(x.as_buffer(), np.int64).copy())
                cs.append(np.frombuffer(y.as_buffer(), np.int64).copy())
        c, at = np.unique(np.concatenate(cs), return_inverse=True)
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.bincount(at, np.concatenate(ns)).astype(np.int64))], ["c", "shared"])

    kind = "part bigint, a binary, b binary"
    counts = docs.select("text").mapInArrow(tidy(packed), kind).repartition(n_parts, "part").mapInArrow(tidy(counted), kind)
    return counts.repartition(n_parts, "part").mapInArrow(tidy(added), "c bigint, shared bigint")


#: Edges up to which one task joins a graph (16 bytes each, some 100 MB of work); larger graphs go in rounds over all tasks.
ONE_TASK_EDGES = 1_000_000


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node connected to each)."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return nodes, nodes[label]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def connected(edges: DataFrame) -> DataFrame:
    """(c, f): every node of edges (a, b) with one label for each component.

    A graph of at most ONE_TASK_EDGES edges is one task's work. In a larger one each node takes its least neighbour as
    label, edges are drawn anew between labels, and so on while any is left; labels are hashes, so each round leaves a
    fraction of the edges, and the rest goes to one task as soon as it is small.
    """

    def join(batches):
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in batches:
            a.append(x.column(0).to_numpy())
            b.append(x.column(1).to_numpy())
        c, f = labelled(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(f)], ["c", "f"])

    edges = common.saved(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        if edges.count() <= ONE_TASK_EDGES:
            step = edges.repartition(1).mapInArrow(tidy(join), "c bigint, f bigint")
            if labels is None:
                return common.saved(step, "labels")
            return labels.join(step.select(F.col("c").alias("f"), F.col("f").alias("g")), "f", "left").select("c", F.coalesce("g", "f").alias("f"))
        step = edges.select(F.col("a").alias("c"), F.col("b").alias("o")).union(edges.select(F.col("b").alias("c"), F.col("a").alias("o")))
        step = common.saved(step.groupBy("c").agg(F.min("o").alias("m")).select("c", F.least("c", "m").alias("f")), "step")
        if labels is None:
            labels = step
        else:
            labels = common.saved(labels.join(step.select(F.col("c").alias("f"), F.col("f").alias("g")), "f", "left").select("c", F.coalesce("g", "f").alias("f")), "labels")
        ends = edges.join(step.select(F.col("c").alias("a"), F.col("f").alias("x")), "a").join(step.select(F.col("c").alias("b"), F.col("f").alias("y")), "b")
        edges = common.saved(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")


class Family:
    """Exact components of the sets of one region."""

    def __init__(self, rule: Rule, sets: list[np.ndarray]):
        self.rule = rule
        self.n = np.array([len(s) for s in sets], np.int64)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.n)
        shared = count[code] > 1  # a gram of one set alone is in no intersection
        self.code, owner = code[shared], owner[shared]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
        self.mark = np.zeros(len(count), np.int32)
        self.root = np.arange(len(sets))

    def find(self, i):
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def union(self, i, others):
        a = self.find(i)
        for o in others:
            b = self.find(o)
            if a != b:
                a, b = min(a, b), max(a, b)
                self.root[b] = a

    def intersections(self, p: int, flat, starts, some, size):
        """Size of the intersection of p with each set of a region in flat form."""
        mine = self.code[self.at[p] : self.at[p + 1]]
        self.mark[mine] = 1
        out = np.zeros(size, np.int64)
        if len(flat):
            out[some] = np.add.reduceat(self.mark[flat], starts)
        self.mark[mine] = 0
        return out

    def flat(self, members):
        width = self.at[members + 1] - self.at[members]
        some = np.flatnonzero(width)
        total = np.cumsum(width)
        index = np.arange(total[-1] if len(total) else 0) + np.repeat(self.at[members] - np.concatenate([[0], total[:-1]]), width)
        return self.code[index], (total - width)[some], some

    def distances(self, p, members, form):
        inter = self.intersections(p, *form, len(members))
        whole = self.n[members] + self.n[p] - inter
        ball = members[self.rule.linked(inter, self.n[members], self.n[p])]
        self.union(p, ball)
        return 1 - inter / np.maximum(whole, 1)

    def region(self, members: np.ndarray, depth: int = 0):
        if len(members) < 2:
            return
        if len(members) > 48 and depth < 12:
            form = self.flat(members)
            pivots, d = [int(members[0])], None
            near = None
            for _ in range(PIVOTS):
                row = self.distances(pivots[-1], members, form)
                d = row[None] if d is None else np.concatenate([d, row[None]])
                near = d.min(0)
                far = int(near.argmax())
                if near[far] <= 0 or len(pivots) == PIVOTS:
                    break
                pivots.append(int(members[far]))
            if len(set(map(self.find, members.tolist()))) == 1:
                return  # balls that meet are one component
            inside = d[: len(d)] <= near + 2 * self.rule.r + 1e-9
            if inside.sum(1).max() <= 0.7 * len(members):
                home = d.argmin(0)
                for j in range(len(d)):
                    if (home == j).any():
                        self.region(members[inside[j]], depth + 1)
                return
        self.all_pairs(members)

    def all_pairs(self, members: np.ndarray):
        """What pivots can't cut: every set against those of like size."""
        members = members[np.argsort(self.n[members], kind="stable")]
        n = self.n[members]
        root = np.array([self.find(i) for i in members.tolist()])
        if (root == root[0]).all():
            return
        if len(members) <= 48 or not len(self.code):
            for i in range(len(members) - 1):
                p = members[i]
                self.mark[self.code[self.at[p] : self.at[p + 1]]] = 1
                for j in range(i + 1, len(members)):
                    if n[i] * 100 < self.rule.percent * n[j]:
                        break
                    q = members[j]
                    if self.find(p) != self.find(q):
                        inter = int(self.mark[self.code[self.at[q] : self.at[q + 1]]].sum())
                        if self.rule.linked(inter, n[i], n[j]):
                            self.union(p, (q,))
                self.mark[self.code[self.at[p] : self.at[p + 1]]] = 0
            return
        flat, starts, some = self.flat(members)
        width = self.at[members + 1] - self.at[members]
        end = np.cumsum(width)
        for i in range(len(members) - 1):
            top = int(np.searchsorted(n, n[i] * 100 // self.rule.percent, "right"))
            lo, hi = i + 1, max(i + 1, top)
            if hi <= lo or (root[lo:hi] == root[i]).all():
                continue  # those of one component need no comparison
            p = members[i]
            self.mark[self.code[self.at[p] : self.at[p + 1]]] = 1
            run = np.concatenate([[0], np.cumsum(self.mark[flat[end[i] : end[hi - 1]]])])
            inter = run[end[lo:hi] - end[i]] - run[end[lo:hi] - width[lo:hi] - end[i]]
            self.mark[self.code[self.at[p] : self.at[p + 1]]] = 0
            hit = self.rule.linked(inter, n[lo:hi], n[i])
            if (hit & (root[lo:hi] != root[i])).any():
                self.union(p, members[lo:hi][hit])
                root = np.array([self.find(j) for j in members.tolist()])

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.root))])


def solved(sets: DataFrame, rule: Rule, n_parts: int) -> DataFrame:
    """(c, f): in each region (column g) of rows (g, c, grams, ball), the least class of c's component there. Rows of one ball are known to be connected."""

    def run(batches):
        group, cs, ss, bs = None, [], [], []

        def out():
            key = np.array(cs, np.int64)
            order = np.argsort(key, kind="stable")
            keep = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]  # equal classes may come twice
            family = Family(rule, [ss[i] for i in keep])
            heads: dict = {}
            for i, k in enumerate(keep):
                if bs[k] is not None:
                    family.union(heads.setdefault(bs[k], i), (i,))
            family.region(np.arange(len(keep)))
            key = key[keep]
            return key, key[family.roots()]

        done: list[list] = [[], []]
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                for g, c, s, ball in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), strict=True):
                    if g != group:
                        if cs:
                            for k, x in enumerate(out()):
                                done[k].append(x)
                        group, cs, ss, bs = g, [], [], []
                    cs.append(c)
                    ss.append(np.frombuffer(s.as_buffer(), U))
                    bs.append(ball)
                if sum(map(len, done[0])) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in done], ["c", "f"])
                    done = [[], []]
        if cs:
            for k, x in enumerate(out()):
                done[k].append(x)
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in done], ["c", "f"])

    return sets.select("g", "c", "grams", "ball").repartition(n_parts, "g").sortWithinPartitions("g").mapInArrow(tidy(run), "c bigint, f bigint")


def pivot_rows(rows: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cuts each region g of rows (g, c, grams, ball) by pivots: (rows of the new regions, the same rows uncut with their balls, edges (a, b) of links to pivots).

    A region has PIVOTS pivots at most, the first classes by a hash, those outside of balls before others, so a row meets
    a fixed number of them. All that link with a pivot are its ball, and balls that share a row are one: the edges make
    them a component, so rows of one ball are never compared, and a region of one ball alone is done.
    """
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.col("ball").isNotNull(), F.xxhash64("c", "g"), "c"))
    heads = rows.groupBy("g", "c").agg(F.max("ball").alias("ball")).withColumn("k", rank).where(F.col("k") <= PIVOTS).select("g", F.col("c").alias("p"))
    pivots = heads.join(rows.select("g", F.col("c").alias("p"), F.col("grams").alias("own")), ["g", "p"]).dropDuplicates(["g", "p"])
    percent, r = rule.percent, rule.r

    def measure(batches):
        for b in batches:
            i, u = [], []
            for x, y in zip(b.column(3), b.column(4), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                same = len(np.intersect1d(x, y, assume_unique=True))
                i.append(same)
                u.append(len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(i, pa.int64()), pa.array(u, pa.int64())], ["g", "c", "p", "i", "u"])

    # a region of many rows is no one task's work: its rows are dealt by salt, and its few pivots go to each
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int"))
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = common.saved(salted.join(pivots, ["g", "salt"]).select("g", "c", "p", "grams", "own").mapInArrow(tidy(measure), "g bigint, c bigint, p bigint, i bigint, u bigint"), "pivots")
    linked = F.col("i") * 100 >= F.col("u") * percent
    edges = near.where(linked).where("c != p").select(F.col("p").alias("a"), F.col("c").alias("b"))
    d = 1 - F.col("i") / F.greatest("u", F.lit(1))
    least = near.groupBy("g", "c").agg(F.min(d).alias("least"), F.min(F.when(linked, F.col("p"))).alias("p0"), F.collect_set(F.when(linked, F.col("p"))).alias("ps"))
    least = common.saved(least, "least")
    meet = least.select(F.col("p0").alias("a"), F.explode("ps").alias("b")).distinct()  # pivots alone
    roots = connected(meet).select(F.col("c").alias("p0"), "f")
    balls = least.join(roots, "p0", "left").select("g", "c", "least", F.coalesce("f", "p0").alias("own_ball"))
    labelled = rows.join(balls.select("g", "c", "own_ball"), ["g", "c"]).select("g", "c", "grams", F.coalesce("ball", "own_ball").alias("ball"))
    labelled = common.saved(labelled, "labelled")
    homes = near.join(balls, ["g", "c"]).where(d <= F.col("least") + 2 * r + 1e-9).select("g", "c", "p")
    regions = unfinished(labelled).join(homes, ["g", "c"]).select(F.xxhash64("g", "p").alias("g"), "c", "grams", "ball")
    return unfinished(common.saved(regions, "regions")), unfinished(labelled), edges


def unfinished(rows: DataFrame) -> DataFrame:
    """Rows of regions that are more than one ball."""
    some = rows.groupBy("g").agg(F.min("ball").alias("x"), F.max("ball").alias("y"), F.count("*").alias("n"), F.count("ball").alias("k")).where("k < n OR x != y").select("g")
    return rows.join(some, "g", "left_semi")


def by_size(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    count = rows.groupBy("g").agg(F.count("*").alias("size"))
    return count.where(F.col("size") <= limit), count.where(F.col("size") > limit)


def sized(rows: DataFrame, rule: Rule) -> DataFrame:
    """rows with a level of their sets' sizes, such that sets that link are of one level or of neighbouring ones."""
    most = rows.agg(F.max(F.length("grams"))).first()[0] or 0
    low = [1, 2]
    while low[-1] <= most // 8:
        low.append(max(low[-1] + 1, (low[-1] - 1) * 100 // rule.percent + 1))
    n = F.length("grams") / 8
    return rows.withColumn("level", F.size(F.filter(F.lit(low), lambda x: x <= n)))


def block_rows(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of irreducible regions, dealt to pairs of blocks: each pair of rows of one or of neighbouring levels that is not of the region's greatest ball meets in one region at least."""
    sizes = rows.groupBy("g", "ball").agg(F.count("*").alias("k"))
    top = sizes.where("ball IS NOT NULL").groupBy("g").agg(F.max_by("ball", "k").alias("top"))
    rows = rows.join(top, "g", "left").withColumn("in_top", F.coalesce(F.col("ball") == F.col("top"), F.lit(False)))
    kind = lambda level, in_top: 2 * level + in_top
    rows = rows.withColumn("kind", kind(F.col("level"), F.col("in_top").cast("int")))
    n = rows.groupBy("g", "kind").agg(F.ceil(F.count("*") / (limit // 2)).cast("int").alias("n"))
    n = n.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("blocks"))
    rows = rows.join(F.broadcast(n), "g")  # a row for each region that has more rows than one task joins

    def named(kind, block):
        return kind.cast("long") * (1 << 32) + block

    def others(level, in_top: int):
        of = kind(level, F.lit(in_top))
        count = F.coalesce(F.try_element_at("blocks", of), F.lit(0))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: named(of, i))).otherwise(F.array().cast("array<bigint>"))

    own = named(F.col("kind"), F.pmod(F.xxhash64("c"), F.col("blocks")[F.col("kind")]))
    near = [F.col("level") + i for i in (-1, 0, 1)]
    theirs = F.when(~F.col("in_top"), F.concat(*[others(level, 1) for level in near])).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("g", "c", "grams", "ball", own.alias("own"), F.explode(F.concat(*[others(level, 0) for level in near], theirs)).alias("other"))
    return rows.select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "c", "grams", "ball")


def in_rounds(rows: DataFrame, rule: Rule, n_parts: int, most: int) -> list[DataFrame]:
    """solved() of all regions, in rounds that move about `most` bytes each: rows dealt to pairs of blocks grow with the square of a region, and the disk need not."""
    rounds = max(1, -(-(rows.agg(F.sum(F.length("grams"))).first()[0] or 0) // most))
    return [common.saved(solved(rows.where(F.pmod("g", F.lit(rounds)) == i), rule, n_parts), "blocks") for i in range(rounds)]


def links(docs: DataFrame, rule: Rule, classes: DataFrame) -> DataFrame:
    """(c, f): classes that link with any other, with the least class of their component. docs: (id, text)."""
    total = classes.where("n > 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = common.n_partitions(docs.sparkSession)
    # about half a million part keys a task, until there are MOST_PARTS tasks
    n_parts = max(2 * parts, min(MOST_PARTS, int(total // 1_000_000)))

    def texts_of(some: DataFrame) -> DataFrame:
        """One text of each class."""
        ids = classes.join(some, "c", "left_semi").groupBy("c").agg(F.min("id").alias("id")).select("id").distinct()
        ids = common.saved(ids, "ids")
        few = ids.count() <= BROADCAST_ROWS
        ids = ids.withColumnRenamed("id", "id_")
        return docs.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("id_")), "left_semi").select("text")

    edges = common.saved(candidate_edges(docs, rule, n_parts), "candidates")
    if rule.percent < 88:
        # parts are small then, and a passage that many documents share can be all of one: leave out who can't link
        nodes = edges.select(F.col("a").alias("c")).union(edges.select(F.col("b").alias("c"))).distinct()
        shared = promising(texts_of(nodes), rule, n_parts)
        some = shared.join(classes.groupBy("c").agg(F.max("n").alias("n")), "c").where(F.col("shared") * 100 >= F.col("n") * rule.percent).select("c")
        some = common.saved(some, "promising")
        edges = candidate_edges(texts_of(some), rule, n_parts)
    families = connected(edges)
    texts = texts_of(families)

    def run(batches):
        for b in batches:
            for _, _, data, offsets in common.chunks(b.column(0)):
                grams, _, at, key = gram_sets(rule, data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([grams[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], ["c", "grams"])

    rows = texts.mapInArrow(tidy(run), "c bigint, grams binary").join(families, "c").select(F.col("f").alias("g"), "c", "grams", F.lit(None).cast("long").alias("ball"))
    rows = common.saved(rows, "families")
    found = []
    whole = True
    for depth in range(MOST_DEPTH):
        small, big = by_size(rows, LEAF)
        big = common.saved(big, "big")
        if not big.limit(1).count():
            found.append(solved(rows, rule, parts))
            break
        whole = False
        found.append(solved(rows.join(big, "g", "left_anti"), rule, parts))
        rows = rows.join(big, "g", "left_semi")
        cut, uncut, edges = pivot_rows(rows, rule)
        found.append(edges.select(F.col("b").alias("c"), F.col("a").alias("f")))
        # regions that keep most of a family's rows would never get small: what is not one ball there goes to blocks
        if depth == MOST_DEPTH - 1 or cut.count() > 0.5 * PIVOTS * rows.count():
            found += in_rounds(block_rows(sized(uncut, rule), LEAF), rule, parts, max(ROUND_BYTES, 2 * total))
            break
        rows = cut
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.union(x)
    pairs = pairs.where("c != f")
    if whole:
        pairs = common.saved(pairs, "links")
        return pairs.union(pairs.select(F.col("f").alias("c"), "f").distinct())
    return connected(pairs.select(F.col("c").alias("a"), F.col("f").alias("b")))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Sets are of distinct k-word shingles, A-Z in lower case; a text of fewer words is one shingle, and one without
    words (or null) has none and links with nothing. Documents link at percent/100 or more. Rows with null ids take
    part; the smallest id is then of those that are not null.
    """
    rule = Rule(k, percent)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    classes = common.saved(classes_of(docs, rule), "classes")
    roots = links(docs, rule, classes)
    least = classes.where("n > 0").groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    least = least.join(roots, "c", "left").select("c", F.coalesce("f", "c").alias("f"), "least", "copies", F.col("f").isNotNull().alias("linked"))
    least = common.saved(least.where("linked OR copies > 1"), "least")  # all others are alone
    by_root = least.groupBy("f").agg(F.min("least").alias("component"))
    component = least.join(by_root, "f").select("c", "component")
    out = classes.join(component, "c", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles at 0.9."""
    return components(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest (id, text digest), null ids last. Groups are of five-word shingles at 0.8.

    Of rows with the same id and text one stays. Rows without words (or with null text) are in no group, and all stay.
    Columns may have any name.
    """
    rule = Rule(5, 80)
    digest = F.xxhash64("text")
    texts = docs.select(F.struct(F.col("doc_id").alias("i"), digest.alias("d")).alias("id"), F.col("text").alias("text"))
    classes = common.saved(classes_of(texts, rule), "classes")
    roots = links(texts, rule, classes)
    rows = classes.where("n > 0").groupBy("c", "id").agg(F.count("*").alias("copies"))
    least = rows.groupBy("c").agg(F.min(F.struct(F.col("id.i").isNull().alias("none"), F.col("id.i").alias("i"), F.col("id.d").alias("d"), "copies")).alias("x"))
    least = least.join(roots, "c", "left").groupBy(F.coalesce("f", "c").alias("f")).agg(F.min("x").alias("x"))
    keep = least.select(F.col("x.i").alias("_i"), F.col("x.d").alias("_d"), F.col("x.copies").alias("_n"))
    keep = common.saved(keep.union(classes.where("n = 0").select("id.i", "id.d", F.lit(1).cast("long")).distinct()), "keep")
    same = [F.col("id").eqNullSafe(F.col("_i")), F.col("digest").eqNullSafe(F.col("_d"))]
    held = common.packed(docs, id=F.col("doc_id"), digest=digest)
    once = held.join(keep.where("_n = 1"), same, "left_semi").select("row")
    repeated = keep.where("_n > 1")
    if not repeated.isEmpty():
        once = once.union(held.join(repeated, same, "left_semi").dropDuplicates(["id", "digest"]).select("row"))
    return once.select("row.*")


QUERIES = {"op7_ngram_join": op7_ngram_join}
ORACLE_SQL: dict[str, str] = {}
