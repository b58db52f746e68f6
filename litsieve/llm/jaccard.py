"""Operator 6: n-gram Jaccard join with count vectors and R-trees, and its linked groups.

A document's set is its distinct shingles of ``shingle`` words. Two documents link when their sets' Jaccard
similarity is at least ``per_100`` hundredths. All links count; the result is exact. Operator 6's own query takes
three words and 0.9, the pipeline's stage five words and 0.8.

*Dealing out.* A link allows few differing shingles: at most ``a // 9`` for a smaller set of a at 0.9, ``a // 4``
at 0.8. Shingles are hashed into more groups than that, so two linked documents agree on all of some group, and do
so within the first groups that hold one more than may differ: each signs with those alone. Sizes fall in classes,
each document signs with its own class's groups and, if a link reaches that far, with those of the class below, and
linked documents share a signature: pigeonholes instead of prefixes, so a passage that many documents share brings
few of them together (at 0.9 hardly any; at 0.8 groups are smaller). Each signature's documents are linked as a star
to one of them, which makes no pairs within a group.

*Bounding and verifying.* A document's shingles are hashed into groups, and the group counts are its point; the
summed coordinate minima of a point and of an R-tree node's upper corner bound the overlap. Points have about as many coordinates
as the set has shingles (``dims``), so sets that are no more alike than two templated texts stay apart. First each
document's point meets its star's centre; pairs that may link are verified on their sets. The documents that fail
there meet the whole star, points only, in tiles of bounded size, passing over what is already connected. Texts
are copied only to tiles where a point's bound leaves a pair to verify.

Exact copies are one node throughout. A node is a 64-bit hash of the whole set; a second, independent hash of the set
is compared over all documents of a node, and nodes that turn out to hold two sets are renamed (``clashes``, ``told_apart``), so only
sets with 128 equal bits could be taken for one. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import BROADCAST_BYTES, batches, doc_groups, semi_join_checked, texts, tidy, tune
from litsieve.operators.graph import connected_components
from litsieve.storage import bounded, drop, let_go, materialize, scratch

DIMENSIONS, LEAF = 32, 16
#: Operator 6's own query: words in a shingle; link when PER_100 / 100 * union <= intersection.
SHINGLE, PER_100 = 3, 90
TILE_ROWS, TILE_BYTES = 256, 8 << 20
#: A tile of points.
POINT_ROWS, POINT_BYTES = 2048, 8 << 20
#: Signatures are dealt out in so many rounds, each over its share of their values; a round's shuffle goes before the next.
SLICES = 4
#: Rows of a table of stars (a few numbers each) that are broadcast; larger ones are shuffled.
STARS = 500_000
_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)
_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PI)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=_U)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of lowered bytes: a polynomial over its bytes, from running sums."""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.empty(len(b) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[b], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if len(b) > 1 << 20 and len(cuts := _pieces(b)) > 1:  # one very long text: words piece by piece, in the same numbers
        return np.concatenate([word_hashes(raw[i:j]) for i, j in cuts])
    p, inv = _powers(len(b) + 1)
    total = np.empty(len(b) + 1, dtype=_U)
    total[0] = 0
    np.cumsum((b.astype(_U) + _U(1)) * p[: len(b)], dtype=_U, out=total[1:])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def _pieces(b: np.ndarray, size: int = 1 << 19) -> list[tuple[int, int]]:
    """Cuts at white space, about ``size`` apart; a word that is longer than that stays whole."""
    cuts, at = [0], 0
    space = np.flatnonzero(_SPACE[b])
    while len(b) - at > size:
        k = int(np.searchsorted(space, at + size))
        if k == len(space):
            break
        at = int(space[k])
        cuts.append(at)
    return list(zip(cuts, [*cuts[1:], len(b)], strict=True))


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes; fewer words than a shingle has are one shingle, none are none."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    return np.unique(_shingles(h, shingle))


def _shingles(h: np.ndarray, shingle: int) -> np.ndarray:
    if not len(h):
        return h
    n = min(shingle, len(h))
    out = np.full(len(h) - n + 1, n, dtype=_U)
    for k in range(n):
        out = mix(out * _U(0x2545F4914F6CDD1D) + h[k : k + len(out)])
    return out


def shingle_sets(some: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """``shingle_set`` of each text; the hashing runs over all of them at once."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in some]
    if sum(map(len, raw)) > 1 << 20:
        return [np.unique(_shingles(word_hashes(r), shingle)) for r in raw]
    h = word_hashes(b" ".join(raw))
    out, at = [], 0
    for r in raw:
        n = len(r.split())
        out.append(np.unique(_shingles(h[at : at + n], shingle)))
        at += n
    return out


_NONE = np.zeros(0, dtype=np.int64)
#: A class's upper end is at least this many hundredths of the one below; wider classes sign fewer sets twice.
WIDTH = 150


@cache
def size_classes(per_100: int = PER_100, limit: int = 1 << 40) -> np.ndarray:
    """Upper ends of the size classes up to one that holds ``limit``; sets of the first cannot differ and link."""
    ends = [(per_100 - 1) // (100 - per_100)]
    while ends[-1] < limit:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // per_100, ends[-1] * WIDTH // 100 if per_100 < 90 else 0))
    return np.array(ends)


def signatures(u: np.ndarray, per_100: int = PER_100) -> np.ndarray:
    """What a set signs with; linked sets that differ share one at least."""
    ends = size_classes(per_100)
    own = int(np.searchsorted(ends, len(u)))
    below = own > 0 and len(u) * per_100 <= int(ends[own - 1]) * 100  # a link with a set of the class below is possible
    return np.concatenate([_signed(u, c, int(ends[c]), per_100) for c in (own, own - 1)[: 1 + below] if c > 0] or [_NONE])


def _signed(u: np.ndarray, c: int, end: int, per_100: int) -> np.ndarray:
    odd = 100 - per_100
    most = end * odd // per_100
    differ = min(len(u), end) * odd // per_100  # the smaller of two linked sets has at most so many shingles
    m = most + 2 + int(7 * (most + 24) * np.exp(-per_100 / odd))  # the smaller the groups, the more of them are empty
    group = ((u >> _U(32)) * _U(m)) >> _U(32)  # rises with u
    at = np.searchsorted(group, np.arange(m + 1, dtype=_U))
    full = np.flatnonzero(at[1:] > at[:-1])
    total = np.zeros(m, dtype=_U)
    total[full] = np.add.reduceat(mix(u), at[full])
    # of the first groups that hold more than differ, one agrees and is not empty, on both sides; too few: all are signed with
    keep = full[: differ + 1] if len(full) > differ else np.arange(m)
    return mix(total[keep] * _U(0x9FB21C651E98DF25) + keep.astype(_U) * _U(0xA24BAED4963EE407) + _U(c)).view(np.int64)


def _digest(u: np.ndarray, key: int) -> int | None:
    """The set as one number; none for the empty set."""
    if not len(u):
        return None
    return int(mix(mix(u ^ _U(key)).sum(dtype=_U)[None] + _U(len(u)))[0].view(np.int64))


def node_of(u: np.ndarray) -> int | None:
    return _digest(u, 0x5851F42D4C957F2D)


def check_of(u: np.ndarray) -> int | None:
    return _digest(u, 0x14057B7EF767814F)


def sets(docs: DataFrame, shingle: int = SHINGLE, per_100: int = PER_100) -> DataFrame:
    """``doc_id, n_shingles, node, chk, s0 .. s<SLICES - 1>``: signatures by slice; copies within a task sign once."""
    tune(docs.sparkSession)
    names = [f"s{k}" for k in range(SLICES)]
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_shingles", "node", "chk")), *((c, pa.list_(pa.int64())) for c in names)])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        for b in parts:
            rows: list[tuple] = []
            signed: list[list[np.ndarray]] = [[] for _ in names]
            for doc_ids, some in doc_groups([b], 64):
                for doc_id, u in zip(doc_ids, shingle_sets(some, shingle), strict=True):
                    node = node_of(u)
                    fresh = node is not None and doc_id is not None and node not in seen
                    if fresh and len(seen) < 1_000_000:
                        seen.add(node)
                    rows.append((doc_id, len(u), node, check_of(u)))
                    sig = signatures(u, per_100) if fresh else _NONE
                    of = sig.view(_U) % _U(SLICES)
                    for k, held in enumerate(signed):
                        held.append(sig[of == _U(k)])
            if rows:
                flat = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate([_NONE, *held]))) for held in signed]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), *flat], schema=schema)

    kinds = ", ".join([*(f"{c} long" for c in ("doc_id", "n_shingles", "node", "chk")), *(f"{c} array<long>" for c in names)])
    return texts(docs).mapInArrow(tidy(run), kinds)


def clashes(signed: DataFrame) -> DataFrame | None:
    """``node`` of documents that share a node but not the second hash; none, as good as always, if there are no such."""
    found = signed.where("node is not null").groupBy("node").agg(F.min("chk").alias("x"), F.max("chk").alias("y")).where("x <> y").select("node", F.lit(True).alias("clash"))
    found = materialize(found, "clashes")
    return None if found.isEmpty() else found


def told_apart(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """The rows with clashing nodes renamed by both hashes."""
    if clash is None:
        return rows
    return rows.join(clash, "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "chk")).otherwise(F.col("node"))).drop("clash")


class CountTree:
    """An R-tree over count vectors, packed by sorting (sort-tile-recursive on the widest coordinates)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, per_100: int = PER_100):
        self.per_100 = per_100
        order = self._tile(points, np.arange(len(points)))
        self.points, self.sizes, self.order = points[order], sizes[order], order
        self.levels = []  # (upper corner, least size) of each node, leaves first
        top, least = self.points, self.sizes
        while len(top) > LEAF:
            cuts = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((top, least))

    def _tile(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if len(rows) <= LEAF:
            return rows
        own = points[rows]
        rows = rows[np.argsort(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], kind="stable")]
        half = (len(rows) // 2 + LEAF - 1) // LEAF * LEAF
        return np.concatenate([self._tile(points, rows[:half]), self._tile(points, rows[half:])])

    def candidates(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows whose overlap with the point may reach the threshold."""
        nodes = None
        for top, least in reversed(self.levels):
            nodes = np.arange(len(top)) if nodes is None else self._below(nodes, len(top))
            nodes = nodes[self._may(top[nodes], least[nodes], point, size)]
        rows = np.arange(len(self.points)) if nodes is None else self._below(nodes, len(self.points))
        return self.order[rows[self._may(self.points[rows], self.sizes[rows], point, size)]]

    @staticmethod
    def _below(nodes: np.ndarray, n: int) -> np.ndarray:
        rows = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        return rows[rows < n]

    def _may(self, top: np.ndarray, size: np.ndarray, point: np.ndarray, own: int) -> np.ndarray:
        return (100 + self.per_100) * np.minimum(top, point).sum(axis=1) >= self.per_100 * (size + own)


def count_vector(u: np.ndarray, d: int = DIMENSIONS) -> np.ndarray:
    return np.bincount((u % _U(d)).astype(np.int64), minlength=d)


def dims(n: int) -> int:
    """Coordinates of the point of a set of n: about one shingle to each, a power of two, so larger points fold."""
    return max(DIMENSIONS, 1 << max(n - 1, 0).bit_length())


def packed(u: np.ndarray) -> bytes:
    """The point of a set in one byte a coordinate, in four where a count is larger."""
    v = count_vector(u, dims(len(u)))
    return v.astype(np.uint8 if v.max() < 256 else np.uint32).tobytes()


def unpacked(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8 if len(raw) == dims(n) else np.uint32).astype(np.int32)


def folded(v: np.ndarray, d: int) -> np.ndarray:
    return v if len(v) == d else v.reshape(-1, d).sum(axis=0)


def may_link(n: int, v: np.ndarray, m: int, w: np.ndarray, per_100: int) -> bool:
    """Whether the bound of two points leaves a link possible."""
    d = min(len(v), len(w))
    return (100 + per_100) * int(np.minimum(folded(v, d), folded(w, d)).sum()) >= per_100 * (n + m)


def linked(a: np.ndarray, b: np.ndarray, per_100: int = PER_100) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_100 * (len(a) + len(b) - both)


def tile_links(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]], per_100: int = PER_100) -> Iterator[tuple[int, int]]:
    """Verified links (node, node) between the sides, each (node, component, set), that connect what is not yet connected."""
    if not left or not right:
        return
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    tree = CountTree(np.array([count_vector(s) for _, _, s in left]), np.array([len(s) for _, _, s in left]), per_100)
    for node, comp, s in right:
        for k in tree.candidates(count_vector(s), len(s)).tolist():
            other, its, t = left[k]
            a, b = find(comp), find(its)
            if a != b and linked(s, t, per_100):
                root[a] = b
                yield other, node


def _join_tiles(rows: DataFrame, keys: list[str], shingle: int, per_100: int) -> DataFrame:
    """``a, b`` of the links found in each tile; rows: keys, side, node, component, z."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        names = table.column_names
        col = lambda n: table.column(names.index(n)).to_pylist()
        sides: tuple[dict, dict] = ({}, {})
        for side, node, comp, z in zip(col("side"), col("node"), col("component"), col("z"), strict=True):
            if node not in sides[side]:
                sides[side][node] = (node, comp, shingle_set(zstandard.decompress(z).decode("utf-8", "surrogatepass"), shingle))
        found = list(tile_links(list(sides[0].values()), list(sides[1].values()), per_100))
        return pa.Table.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

    # dealt by tile: rows that joins left by centre would bring all tiles of a star to one task
    return rows.select(*keys, "side", "node", "component", "z").repartition(*keys).groupBy(*keys).applyInArrow(run, "a long, b long")


def _points(docs: DataFrame, wanted: DataFrame, n: int, shingle: int) -> DataFrame:
    """``node, chk, z, w, n, v``: the compressed text of each wanted document and its length, its set's size and its point."""
    schema = pa.schema([("node", pa.int64()), ("chk", pa.int64()), ("z", pa.binary()), ("w", pa.int64()), ("n", pa.int64()), ("v", pa.binary())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)

        def rows():
            for _, some in doc_groups(parts):
                for text, u in zip(some, shingle_sets(some, shingle), strict=True):
                    if len(u):
                        yield node_of(u), check_of(u), zip_.compress(text.encode("utf-8", "surrogatepass")), len(text), len(u), packed(u)

        yield from batches(rows(), schema)

    kinds = "node long, chk long, z binary, w long, n long, v binary"
    return semi_join_checked(texts(docs), wanted, "doc_id", n).select("doc_id", "text").mapInArrow(tidy(run), kinds).dropDuplicates(["node", "chk"])


def _chunks(rows: DataFrame, by: str, name: str, weight: str = "w", most: int = 0, size: int = 0) -> DataFrame:
    """How many tiles one side of each star takes: by rows and by bytes."""
    return rows.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / F.lit(most or TILE_ROWS)), F.ceil(F.sum(weight) / F.lit(size or TILE_BYTES)), F.lit(1)).cast("int").alias(name))


def _pairs_that_may(pairs: DataFrame, per_100: int) -> DataFrame:
    """``centre, node`` of pairs whose points leave a link possible; rows: centre, node, n, v, m, u."""
    schema = pa.schema([("centre", pa.int64()), ("node", pa.int64())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = zip(*(c.to_pylist() for c in b.columns[2:6]), strict=True)
            stay = pa.array([may_link(n, unpacked(n, v), m, unpacked(m, u), per_100) for n, v, m, u in rows], type=pa.bool_())
            yield pa.RecordBatch.from_arrays(list(b.columns[:2]), schema=schema).filter(stay)

    return pairs.select("centre", "node", "n", "v", "m", "u").mapInArrow(tidy(run), "centre long, node long")


def _forest(rows: list[tuple], per_100: int) -> dict[tuple[int, int], tuple[CountTree, np.ndarray]]:
    """Trees of points by (coordinates compared, coordinates held); links join sets whose coordinates differ twofold at most."""
    by: dict[int, list[int]] = {}
    for k, row in enumerate(rows):
        by.setdefault(len(row[2]), []).append(k)
    out = {}
    for d, at in by.items():
        sizes = np.array([rows[k][1] for k in at])
        for e in (d, d // 2) if d > DIMENSIONS else (d,):
            out[e, d] = CountTree(np.array([folded(rows[k][2], e) for k in at]), sizes, per_100), np.array(at)
    return out


def near_tiles(left: list[tuple], right: list[tuple], per_100: int) -> tuple[np.ndarray, np.ndarray]:
    """What must be verified: (row of left, text tile of right) and (row of right, text tile of left).

    Rows are (component, set size, point, text tile). Pairs of one component are passed over.
    """
    forest = _forest(left, per_100)
    comp, tile = np.array([r[0] for r in left]), np.array([r[3] for r in left])
    need_left = np.zeros((len(left), 1 + max(r[3] for r in right)), dtype=bool)
    need_right = np.zeros((len(right), 1 + int(tile.max())), dtype=bool)
    for k, (its, n, v, t) in enumerate(right):
        d = len(v)
        for e, held in ((d, d), (d, 2 * d), (d // 2, d // 2)):
            if (found := forest.get((e, held))) is None:
                continue
            rows = found[1][found[0].candidates(folded(v, e), n)]
            rows = rows[comp[rows] != its]
            need_left[rows, t] = True
            need_right[k, tile[rows]] = True
    return np.argwhere(need_left), np.argwhere(need_right)


def _near_rows(rows: DataFrame, per_100: int) -> DataFrame:
    """``centre, i, j, side, node, component`` of the texts that each text tile needs; rows: centre, vi, vj, side, tile, node, component, n, v."""
    schema = pa.schema([("centre", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("node", pa.int64()), ("component", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(k).to_pylist() for k, c in enumerate(table.column_names)}
        sides: tuple[list, list] = ([], [])
        names: tuple[list, list] = ([], [])
        for side, tile, node, comp, n, v in zip(*(col[c] for c in ("side", "tile", "node", "component", "n", "v")), strict=True):
            sides[side].append((comp, n, unpacked(n, v), tile))
            names[side].append(node)
        found = []
        if sides[0] and sides[1]:
            for side, need in enumerate(near_tiles(*sides, per_100)):
                for k, other in need.tolist():
                    own = sides[side][k]
                    found.append((col["centre"][0], *((own[3], other) if side == 0 else (other, own[3])), side, names[side][k], own[0]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 6, schema, strict=True)], schema=schema)

    keys = ["centre", "vi", "vj"]
    return rows.select(*keys, "side", "tile", "node", "component", "n", "v").repartition(*keys).groupBy(*keys).applyInArrow(run, "centre long, i int, j int, side int, node long, component long")


def stars_of(signed: DataFrame) -> DataFrame:
    """``centre, node``: each signature's nodes around one of them, slice by slice of the signatures.

    The centre is the node that shares the most signatures, ties to the larger: the text that others are edits of comes
    before the edits, which often link with it and not with each other.
    """
    sharing = None
    for k in range(SLICES):
        rows = signed.where(f"doc_id is not null and size(s{k}) > 0").select(F.explode(f"s{k}").alias("sig"), "node")
        sigs = materialize(rows.groupBy("sig").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("sig"), "shared")
        let_go(signed.sparkSession)
        part = materialize(rows.join(sigs, "sig", "left_semi"), "sharing")
        let_go(signed.sparkSession)
        sharing = part if sharing is None else sharing.unionByName(part)
    degree = sharing.groupBy("node").agg(F.count("*").alias("degree"))
    centres = materialize(sharing.join(degree, "node").groupBy("sig").agg(F.max_by("node", F.struct("degree", "node")).alias("centre")), "centres")
    return materialize(sharing.join(centres, "sig").where("node <> centre").select("centre", "node").distinct(), "stars")


def links(docs: DataFrame, signed: DataFrame, stars: DataFrame, clash: DataFrame | None, shingle: int = SHINGLE, per_100: int = PER_100) -> DataFrame | None:
    """``a, b``: links between nodes that connect all that is connected; none if nothing shares a signature."""
    ends = stars.select("node").union(stars.select("centre")).distinct()
    first = signed.where("doc_id is not null and node is not null").groupBy("node", "chk").agg(F.min("doc_id").alias("doc_id"))
    wanted = materialize(first.join(ends, "node").select("doc_id").distinct(), "wanted")
    n = wanted.count()
    if not n:
        return None
    points = materialize(told_apart(_points(docs, wanted, n, shingle), clash), "points")
    # each document against its star's centre
    light = points.select("node", "n", "v")
    pairs = stars.join(light, "node").join(light.select(F.col("node").alias("centre"), F.col("n").alias("m"), F.col("v").alias("u")), "centre")
    members = materialize(_pairs_that_may(pairs, per_100), "may")
    let_go(docs.sparkSession)
    members = members.join(points.select("node", "z", "w"), "node")
    tiles = bounded(_chunks(members, "centre", "k"), "tiles", STARS)
    right = members.join(tiles, "centre").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    heads = tiles.select(F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("tile")).join(points, "node")
    both = heads.select(F.col("node").alias("centre"), "tile", F.lit(0).alias("side"), "node", F.col("node").alias("component"), "z").unionByName(
        right.select("centre", "tile", F.lit(1).alias("side"), "node", F.col("node").alias("component"), "z")
    )
    found = materialize(_join_tiles(both, ["centre", "tile"], shingle, per_100), "links")
    let_go(docs.sparkSession)
    missed = materialize(stars.join(found.select(F.col("a").alias("centre"), F.col("b").alias("node")), ["centre", "node"], "left_anti"), "missed")
    if missed.isEmpty():
        return found
    # what failed there against the rest of the star, unless connected by now
    near = connected_components(found, "a", "b").withColumnRenamed("component", "label")
    known = lambda df: df.join(near, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")
    whole = known(stars.join(bounded(missed.select("centre").distinct(), "centres", STARS), "centre", "left_semi"))
    # two documents that are not connected are not both in the star's largest component; a star of one component is done
    most = whole.groupBy("centre", "component").count().groupBy("centre").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("centre", "main")
    whole = whole.join(bounded(most, "open", STARS), "centre").join(points.select("node", "n", "v", "w"), "node").withColumn("b", F.length("v"))
    whole = materialize(whole, "whole")
    lost = whole.where("component <> main")
    sizes = _chunks(lost, "centre", "nl").join(_chunks(whole, "centre", "nr"), "centre")
    sizes = sizes.join(_chunks(lost, "centre", "pl", "b", POINT_ROWS, POINT_BYTES), "centre").join(_chunks(whole, "centre", "pr", "b", POINT_ROWS, POINT_BYTES), "centre")
    sizes = bounded(sizes, "sizes", STARS)
    at = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int").alias("tile")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.least(F.col(f"p{k}"), F.col(f"n{k}")) - 1))
    own = lambda k: F.pmod("tile", F.least(F.col(f"p{k}"), F.col(f"n{k}")))  # noqa: E731  # a text tile is in one tile of points
    left = lost.join(sizes, "centre").select("*", at("nl")).select("centre", own("l").alias("vi"), every("r").alias("vj"), F.lit(0).alias("side"), "tile", "node", "component", "n", "v")
    other = whole.join(sizes, "centre").select("*", at("nr")).select("centre", every("l").alias("vi"), own("r").alias("vj"), F.lit(1).alias("side"), "tile", "node", "component", "n", "v")
    needed = materialize(_near_rows(left.unionByName(other), per_100), "needed")
    let_go(docs.sparkSession)
    more = materialize(_join_tiles(needed.join(points.select("node", "z"), "node"), ["centre", "i", "j"], shingle, per_100), "more")
    let_go(docs.sparkSession)
    return materialize(found.unionByName(more), "links")


def join(docs: DataFrame, shingle: int = SHINGLE, per_100: int = PER_100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    ``component_id`` is the smallest doc_id that links reach. Documents without words (null or blank
    texts) have no shingles and are linked with nothing. A row with a null doc_id has a null component and
    links nothing. Rows that repeat a doc_id are nodes by their texts. An empty table gives no rows. Columns
    other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        raw = materialize(sets(docs, shingle, per_100), "sets")
        clash = clashes(raw)
        told = told_apart(raw, clash)
        stars = stars_of(told)
        signed = keep(materialize(told.select("doc_id", "n_shingles", "node", "chk"), "nodes"))
        drop(raw)  # its signatures are of no more use
        edges = links(docs, signed, stars, clash, shingle, per_100)
        nodes = signed.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
        if edges is None:
            least = nodes.select("node", F.col("first").alias("component_id"))
        else:
            near = materialize(connected_components(edges, "a", "b"), "components")
            labelled = nodes.join(near, "node", "left").select("node", "first", F.coalesce("component", "node").alias("label"))
            lowest = labelled.join(near.select(F.col("component").alias("label")).distinct(), "label").groupBy("label").agg(F.min("first").alias("lowest"))
            least = labelled.join(lowest, "label", "left").select("node", F.coalesce("lowest", "first").alias("component_id"))
        least = keep(materialize(least, "least"))
    let_go(spark)
    return signed.select("doc_id", "n_shingles", "node").join(least, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, per_100: int = PER_100) -> DataFrame:
    """One document of each linked group (the smallest doc_id), in the columns they came with.

    Rows with a null doc_id stay. Rows that repeat a doc_id with an equal text become one; a doc_id whose
    rows have several texts goes only if each of them is linked to a smaller one.
    """
    found = materialize(join(docs, shingle, per_100).where("doc_id is not null").select("doc_id", "component_id").distinct(), "groups")
    gone = found.where("doc_id <> component_id").select("doc_id")
    stay = found.where("doc_id = component_id").select("doc_id")
    gone = materialize(gone.join(stay, "doc_id", "left_anti").distinct(), "gone")
    n = gone.count()
    side = F.broadcast(gone) if n * 32 <= BROADCAST_BYTES else gone
    kept = docs.join(side, "doc_id", "left_anti").select(*docs.columns)
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    n = again.count()
    if not n:
        return kept
    side = F.broadcast(again) if n * 32 <= BROADCAST_BYTES else again
    single = kept.join(side, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(side, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
