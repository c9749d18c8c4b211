"""MinHash near-dedup by chosen-path set similarity join.

A document's set are its distinct shingles of five words (lower-cased A-Z, words
without blanks); a shorter text is one shingle, a text without words has none
and is linked with nothing. Equal sets form a class. ``TREES`` independent trees
branch the classes by selected minwise tokens: a node passes each class on to
``BRANCHES`` children, each named by one coordinate of the signature and its
value there. A link of similarity 0.75 misses all four children of one node with
probability 0.004, and all three trees already at their roots with 6e-8.

Every class of a root's child is first compared with that node's first class, and
links join components, so that most of a group of near copies is one component
before anything is compared exhaustively. At each level nodes within one component
are done. Of the others, a node branches again, by coordinates that no level above
has used, where that lessens the comparisons: its children's squared sizes
sum up to less than its own. Nodes that don't shrink (their classes are alike, but
not linked), those with at most ``FEW`` classes outside their largest component,
those with at most ``SMALL`` classes and all of the last level are compared
exhaustively between components, so nothing is dropped. Two classes that meet in
several of a tree's first nodes are compared in one of them.

Comparisons run in cells of at most about ``BLOCK`` by ``BLOCK`` classes, whatever the size
of a node, and a cell gives links alone, never pairs that may be links. It
first meets sizes, then sketches: the set's smallest hash in each of
``BINS`` ranges, kept as four bits. Of two sets' bins that aren't empty in both, a
true link differs in a quarter on average, and is passed over when the share is
five standard deviations above that (3e-7; the deviation is a sample's without
replacement from the union). The full sets of 64-bit shingle hashes are then
sent to the cells of the classes concerned, the likeliest pairs are confirmed
first, and pairs of classes that have been joined by other links are left out: a
cell gives fewer links than it has classes. Sets are computed again from the
texts; texts themselves are never shuffled.

Cases: null and empty texts have no shingles and are their own component. A null
id gets a null component and is kept. Rows that repeat an id are one document;
where their texts differ it is linked through either. Of a group the smallest
id is kept. Extra columns are ignored by near_groups and kept by near_dedup, whatever
their names. Ties don't arise, as ids are distinct. Very long texts are read in
bounded parts and their sets are whole. An empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import textspans as S
from tallyglass.llm.bitmaps import flagged
from tallyglass.llm.components import components
from tallyglass.llm.storage import discard, settle

WORDS = 5
PERCENT = 75
COORDINATES = 40
TREES = 3
BRANCHES = 4
FEW = 32
SMALL = 1024
LEVELS = 3
BLOCK = 1024
BINS = 256
ROOTS = TREES * BRANCHES
TOGETHER = 32  # pairs of one class confirmed at once
_MARKS = np.uint64(0x1111111111111111)

_random = np.random.default_rng(20240601)
_TIMES = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_PLACES = _random.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], size: int = WORDS):
    """The sorted distinct 64-bit shingle hashes of each text."""
    for a, b in S.chunks(texts):
        codes, starts, ends, first = S.words(texts[a:b])
        words = S.span_hashes(codes, starts, ends)
        n = len(words)
        rolled = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size if n >= size else 0):
            rolled += words[k : n - size + 1 + k] * _PLACES[k]
        rolled = S.mix64(rolled)
        for i in range(b - a):
            low, high = first[i], first[i + 1]
            if high - low >= size:
                yield np.unique(rolled[low : high - size + 1])
            elif high > low:
                with np.errstate(over="ignore"):
                    yield S.mix64(np.array([(words[low:high] * _PLACES[: high - low]).sum() + np.uint64(high - low)]))
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (int32), a row of COORDINATES for each non-empty set."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    done = 0
    while done < len(sets):
        upto, held = done, 0
        while upto < len(sets) and (upto == done or held + len(sets[upto]) <= 1 << 16):
            held += len(sets[upto])
            upto += 1
        joined = np.concatenate(sets[done:upto])
        begin = np.cumsum([0, *(len(s) for s in sets[done : upto - 1])])
        for k in range(COORDINATES):
            out[done:upto, k] = np.minimum.reduceat(((joined * _TIMES[k] + _PLUS[k]) >> np.uint64(32)).astype(np.uint32), begin)
        done = upto
    return out.view(np.int32)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Four bits of the smallest hash of each of BINS ranges (0: none), packed as int64, a row for each sorted set."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    joined = np.concatenate(sets)
    bins = (joined >> np.uint64(56)).astype(np.int64) + BINS * doc
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    held = np.zeros(len(sets) * BINS, np.uint8)
    held[bins[first]] = (joined[first] & np.uint64(0xFFFFFFFF)) % np.uint64(15) + np.uint64(1)
    return (held[::2] | held[1::2] << 4).view(np.int64).reshape(len(sets), BINS // 16)


def _marks(x: np.ndarray) -> np.ndarray:
    """The lowest bit of each four, set where any of the four is."""
    x = x | x >> np.uint64(1)
    return (x | x >> np.uint64(2)) & _MARKS


def _alike(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of bins that differ, and whether each of the sketches a may link with b; ``most``: the size of the union if just so."""
    used = np.bitwise_count(_marks(a | b)).sum(axis=1, dtype=np.int64)
    differ = np.bitwise_count(_marks(a ^ b)).sum(axis=1, dtype=np.int64)
    return differ / np.maximum(1, used), differ <= 0.25 * used + 5 * np.sqrt(0.1875 * used * np.maximum(0, 1 - used / most)) + 1


class _Cell:
    """Classes that meet: ``left`` ones with ``right`` ones; ``minor``: right in any cell of the node."""

    def __init__(self, **columns: np.ndarray):
        self.__dict__ |= columns

    @staticmethod
    def columns(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        traits = np.frombuffer(b"".join(rows["traits"]), np.uint8).reshape(len(rows), -1)
        out = {c: rows[c].to_numpy() for c in ("cls", "comp", "skip", "left", "right", "minor", "n")}
        return out | {"sketch": traits[:, : BINS // 2].copy().view(np.uint64), "roots": traits[:, BINS // 2 :].copy().view(np.int32)}

    def pairs(self):
        """For each right class the left ones that may link with it, likeliest first (indices)."""
        order = np.flatnonzero(self.left)
        order = order[np.argsort(self.n[order], kind="stable")]
        sizes, ids, comps, minors, kept, roots = (x[order] for x in (self.n, self.cls, self.comp, self.minor, self.sketch, self.roots))
        few = np.ascontiguousarray(kept[:, :4])  # a quarter of the bins settles most pairs
        for r in np.flatnonzero(self.right).tolist():
            n = self.n[r]
            low, high = np.searchsorted(sizes, -(-PERCENT * n // 100)), np.searchsorted(sizes, 100 * n // PERCENT, side="right")
            some = low + np.flatnonzero((comps[low:high] != self.comp[r]) & (~minors[low:high] | (ids[low:high] < self.cls[r])))
            for a, b in ((few, self.sketch[r, :4]), (kept, self.sketch[r])):
                differ, alike = _alike(a[some], b, (sizes[some] + n) * (100 / (100 + PERCENT)))
                some, differ = some[alike], differ[alike]
            met = np.flatnonzero(self.skip[r] >> np.arange(ROOTS) & 1)  # compared in these nodes already
            if len(met) and len(some):
                new = (roots[some][:, met] != self.roots[r, met]).all(axis=1)
                some, differ = some[new], differ[new]
            if len(some):
                yield r, order[some[np.argsort(differ, kind="stable")]]

    def involved(self) -> np.ndarray:
        """The classes that may have links here (indices)."""
        some = np.zeros(len(self.cls), bool)
        for r, with_ in self.pairs():
            some[r] = True
            some[with_] = True
        return np.flatnonzero(some)

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links that join the components of the cell's linked classes."""
        _, place = np.unique(self.comp, return_inverse=True)
        root = np.arange(int(place.max()) + 1)
        out = []
        for r, some in self.pairs():
            while True:
                some = some[root[place[some]] != root[place[r]]]
                if not len(some):
                    break
                now, some = some[:TOGETHER], some[TOGETHER:]
                both = _shared(sets[r], [sets[i] for i in now.tolist()])
                for i in now[100 * both >= PERCENT * (self.n[now] + self.n[r] - both)].tolist():
                    if root[place[i]] != root[place[r]]:
                        out.append((int(self.cls[i]), int(self.cls[r])))
                        root[root == root[place[i]]] = root[place[r]]
        return out


def _shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted x each of the other sets holds; none is empty."""
    joined = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, joined), len(x) - 1)] == joined
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *(len(s) for s in others[:-1])]))


def _cells(batches):
    """Batches sorted by ``cell`` as whole cells: rows, and each cell with its first row; holds one batch and one cell."""

    def cut(rows, ends):
        columns = _Cell.columns(rows)
        begins = [0, *ends[:-1]]
        return rows, [(a, _Cell(**{k: x[a:b] for k, x in columns.items()})) for a, b in zip(begins, ends, strict=True)]

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat((held, batch))
        ends = (np.flatnonzero(np.diff(held["cell"].to_numpy())) + 1).tolist()
        if ends:
            yield cut(held.iloc[: ends[-1]], ends)
            held = held.iloc[ends[-1] :]
    if held is not None and len(held):
        yield cut(held, [len(held)])


def _involved(batches):
    S.trim()
    for rows, cells in _cells(batches):
        yield rows.iloc[np.concatenate([a + cell.involved() for a, cell in cells])]


def _links(batches):
    S.trim()
    for rows, cells in _cells(batches):
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        out = [link for a, cell in cells for link in cell.links(sets[a : a + len(cell.cls)])]
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _class_of(s: np.ndarray) -> int:
    return int(S.mix64((S.mix64(s) * np.uint64(3) + np.uint64(len(s))).sum(keepdims=True))[0].view(np.int64)) if len(s) else 0


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls, sig (int array) and traits (sketch and root coordinates) of every row."""

    def run(batches):
        S.trim()
        for batch in batches:
            sets = list(shingle_sets(batch["text"].tolist()))
            some = [i for i, s in enumerate(sets) if len(s)]
            sig, traits = [None] * len(sets), [None] * len(sets)
            if some:
                full = [sets[i] for i in some]
                for i, x, y in zip(some, signatures(full), sketches(full), strict=True):
                    sig[i], traits[i] = x, y.tobytes() + x[:ROOTS].tobytes()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": [len(s) for s in sets], "cls": [_class_of(s) for s in sets], "sig": sig, "traits": traits})

    return docs.mapInPandas(run, "doc_id long, n long, cls long, sig array<int>, traits binary")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        S.trim()
        for batch in batches:
            sets = list(shingle_sets(batch["text"].tolist()))
            yield pd.DataFrame({"cls": [_class_of(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return docs.mapInPandas(run, "cls long, shingles binary")


class _Join:
    def __init__(self, docs: DataFrame, classes: DataFrame, first: DataFrame):
        self.docs, self.classes = docs, classes
        self.links = components(first)  # u, v: every class that isn't its component's smallest
        self.found: list[DataFrame] = []
        self.passing: list[DataFrame] = []

    def settled(self, df: DataFrame) -> DataFrame:
        """A table that goes with the next call of done()."""
        self.passing.append(settle(df))
        return self.passing[-1]

    def done(self) -> None:
        while self.passing:
            discard(self.passing.pop())

    def open(self, rows: DataFrame) -> DataFrame:
        """rows (node, cls, k, skip) of nodes with more than one component, with their component, the node's classes (all), its largest component (major), the classes outside it (rest) and its first class."""
        names = self.links.select(F.col("u").alias("cls"), F.col("v").alias("comp"))
        rows = self.settled(rows.join(names, "cls", "left").select("node", "cls", "k", "skip", F.coalesce("comp", "cls").alias("comp")))
        counts = rows.groupBy("node", "comp").agg(F.count("*").alias("n"), F.min("cls").alias("first"))
        nodes = counts.groupBy("node").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"), F.min("first").alias("first"))
        nodes = nodes.where(F.col("all") > F.col("top.n")).select("node", "all", F.col("top.comp").alias("major"), (F.col("all") - F.col("top.n")).alias("rest"), "first")
        return rows.join(self.settled(nodes), "node")  # of two tables, so that a node of very many rows can be split

    def branching(self, rows: DataFrame, level: int) -> DataFrame:
        """The nodes, of open rows, that branch: comparing their children takes fewer comparisons."""
        large = rows.where((F.col("rest") > FEW) & (F.col("all") > SMALL))
        sizes = _children(large.select("cls", "node", "all", "skip"), self.classes, level).groupBy("parent", "node").agg(F.count("*").alias("n"), F.first("all").alias("all"))
        return sizes.groupBy("parent").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"), F.first("all").alias("all")).where(F.col("work") < F.col("all").cast("double") * F.col("all")).select(F.col("parent").alias("node"))

    def close(self) -> None:
        """Joins the components of all links confirmed so far."""
        found, self.found = [self.links, *self.found], []
        self.links = components(functools.reduce(DataFrame.unionByName, found))
        for x in found:
            discard(x)
        self.done()

    def compare(self, rows: DataFrame, right: Column, rights: Column) -> None:
        """Adds links of each open node's rows with its ``right`` rows (``rights`` of them).

        A node's rows are cut in blocks, and its right rows too; two blocks meet in one cell.
        """
        wide, high = (F.ceil(c / BLOCK).cast("int") for c in (F.col("all"), rights))
        at, to = (F.pmod(F.xxhash64("cls", F.lit(k)), c).cast("int") for k, c in enumerate((wide, high)))
        place = lambda i, j, left, second: F.struct(F.xxhash64("node", i, j).alias("cell"), left.alias("left"), second.alias("right"))
        yes, no = F.lit(True), F.lit(False)
        alone = F.array(place(F.lit(0), F.lit(0), yes, right))
        lefts = F.transform(F.sequence(F.lit(0), high - 1), lambda j: place(at, j, yes, right & (j == to)))
        others = F.transform(F.filter(F.sequence(F.lit(0), wide - 1), lambda i: i != at), lambda i: place(i, to, no, yes))
        cells = F.when((wide == 1) & (high == 1), alone).when(right, F.concat(lefts, others)).otherwise(lefts)
        spread = rows.select("cls", "comp", "skip", right.alias("minor"), F.explode(cells).alias("c")).select("c.*", "cls", "comp", "skip", "minor")
        traits = self.classes.select("cls", "n", "rep", "traits")
        full = spread.join(traits, "cls").repartition("cell").sortWithinPartitions("cell")
        some = self.settled(full.mapInPandas(_involved, full.schema))
        asked = self.settled(some.select("cls", "rep").distinct())
        wanted = flagged(self.docs, F.col("doc_id"), asked, F.col("rep"), "wanted").where("wanted")
        sets = self.settled(_sets(wanted.select("doc_id", "text")).join(asked.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]))
        met = some.join(sets, "cls").repartition("cell").sortWithinPartitions("cell")
        self.found.append(settle(met.mapInPandas(_links, "u long, v long")))


def _children(rows: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """Each row's class in BRANCHES children of its node (now ``parent``), by coordinates of the next level's own that the node's hash selects."""
    each = (COORDINATES - ROOTS) // (LEVELS - 1)
    start = F.pmod("node", F.lit(each)).cast("int")
    step = (F.pmod(F.xxhash64("node"), F.lit(each // BRANCHES)) + 1).cast("int")
    at = [(start + k * step) % each + ROOTS + (level - 1) * each for k in range(BRANCHES)]
    held = rows.join(classes.select("cls", "sig"), "cls")
    kept = [c for c in rows.columns if c != "node"]
    return held.select(*kept, F.col("node").alias("parent"), F.explode(F.array(*[F.xxhash64("node", x, F.col("sig")[x]) for x in at])).alias("node"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    base = settle(_base(docs))
    sets = base.where("n > 0 AND doc_id IS NOT NULL")
    classes = settle(sets.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("sig").alias("sig"), F.first("traits").alias("traits")))
    twice = sets.groupBy("doc_id").agg(F.min("cls").alias("v"), F.max("cls").alias("most")).where("v < most").select("doc_id", "v")
    join = _Join(docs, classes, sets.join(twice, "doc_id").select(F.col("cls").alias("u"), "v"))
    roots = [F.xxhash64(F.lit(k), F.col("sig")[k]) for k in range(ROOTS)]
    rows = classes.select("cls", F.posexplode(F.array(*roots)).alias("k", "node")).withColumn("skip", F.lit(0))
    for level in range(1, LEVELS + 1):
        now = join.settled(join.open(rows))
        if level > 1:
            discard(rows)
        if now.isEmpty():
            break
        if level == 1:
            join.compare(now, F.col("cls") == F.col("first"), F.lit(1))
            met = settle(now.select("cls", "k", "node", "skip"))
            join.close()
            now = join.settled(join.open(met))
            discard(met)
        now = now.withColumn("bit", F.expr("shiftleft(1, k)" if level == 1 else "0"))
        if level < LEVELS:
            deeper = join.settled(join.branching(now, level))
            rows = now.join(deeper, "node", "left_semi")
            now = now.join(deeper, "node", "left_anti")
        if level == 1:  # of each class, the first nodes in which it is compared
            bits = join.settled(now.groupBy("cls").agg(F.bit_or("bit").alias("bits")))
            now = now.join(bits, "cls").withColumn("skip", F.expr("bits & (bit - 1)"))
            rows = rows.join(bits, "cls", "left").withColumn("skip", F.coalesce("bits", F.lit(0)))
        if level < LEVELS:
            rows = settle(_children(rows.select("cls", "node", "k", "skip"), classes, level).drop("parent"))
        join.compare(now, F.col("comp") != F.col("major"), F.col("rest"))
        join.close()
    of = classes.select("cls", "rep").join(join.links.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = of.join(least, "root").select("cls", "component_id")
    out = base.where("n > 0").join(named, "cls", "left").unionByName(base.where("n = 0").withColumn("component_id", F.col("doc_id")))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one document of each group, with docs' columns."""
    work = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    key = f"c{docs.columns.index(id_col)}"
    gone = settle(near_groups(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct())
    marked = flagged(work, F.col(key), gone, F.col("gone"), "maybe")  # only these few texts are shuffled
    left = marked.where("maybe").join(gone, F.col(key) == F.col("gone"), "left_anti")
    return marked.where("NOT maybe").unionByName(left).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
