"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

What a search needs of a vector is its inner product with queries that point its way, so the part of a quantisation error
that is parallel to the vector costs more than the rest, by the factor ``eta``. Codebooks of 16 words for every two
components are learned for that loss (words by weighted least squares, codes by coordinate descent, as the parallel
errors of all components add up). A vector becomes four bits a word, two words a byte. A query makes a table
of its products with all words; a scan adds up table entries by the codes' bytes. The squared distance is
|q|**2 - 2 <q, x> + |x|**2, with |x|**2 kept exactly. The ``rerank`` best of a scan are judged on the vectors themselves, in
double precision.

Equal vectors form a class that keeps its k + 1 least ids, which is all that k neighbours can need of it. Classes lie in cells around
centroids; what is quantised is the way from the centroid, in the cell's own scale. A query scans the ``probe`` nearest cells. A cell of more than ``BLOCK`` classes
is dealt to blocks, one of more than ``QUERIES`` queries scans them in parts, so that tasks stay bounded; only the k
best of each block travel on. Centroids and codebooks are learned from a bounded sample (``SAMPLE`` rows, ``MOST_BYTES``), but every row is indexed.

Recall is measured in every search: some ``AUDIT`` queries are compared with all vectors, and ``probe``, then
``rerank`` (of a block) are raised fourfold until they find ``recall`` of those neighbours. Then both are raised further, each time for
the queries alone whose neighbours changed the time before: rare vectors of another scale or density need more than the mean tells. When
all cells are probed and all of a block is reranked, the search is exact.

Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do rows without
vec_id. Vectors of different lengths aren't comparable. A row given twice counts once; a vec_id with several vectors asks with each of them
and isn't its own neighbour. Components beyond ``HUGE`` are compared exactly, by all queries. Other columns aren't read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import Scratch

SAMPLE, MOST_BYTES, MOST_CENTROIDS = 50_000, 64 << 20, 8192
#: Rows of the sample that codebooks are fitted to.
FITTED = 4096
#: Rows of a length in the sample from which it gets cells and codes.
LEAST = 256
WORDS, WIDTH = 16, 2
#: Vectors shorter than this part of a query's length against it decide how much parallel errors weigh.
NEAR = 0.2
BLOCK, QUERIES, AUDIT = 4096, 512, 64
HUGE = 1e12


def weight(dimensions: int, near: float = NEAR) -> float:
    """How many times a parallel error costs an orthogonal one, for inner products above ``near`` of the largest."""
    return max(1.0, (dimensions - 1) * near * near / (1 - near * near))


def subspaces(x: np.ndarray) -> np.ndarray:
    """Rows cut into words of ``WIDTH`` components, the last filled with zeros; an even number of words."""
    n, d = x.shape
    count = -(-d // (2 * WIDTH)) * 2
    return np.pad(x, ((0, 0), (0, count * WIDTH - d))).reshape(n, count, WIDTH)


def nearest_centre(x: np.ndarray, centre: np.ndarray, k: int = 1) -> np.ndarray:
    """Row numbers of the k nearest centroids."""
    far = (centre * centre).sum(1)[None] - 2 * (x @ centre.T)
    return far.argmin(1)[:, None] if k == 1 else np.argpartition(far, k - 1, 1)[:, :k] if k < len(centre) else np.tile(np.arange(len(centre)), (len(x), 1))


def k_means(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(5)
    centre = x[rng.permutation(len(x))[:count]].copy()
    for _ in range(rounds):
        near = np.concatenate([nearest_centre(x[i : i + 4096], centre)[:, 0] for i in range(0, len(x), 4096)])
        total, many = np.zeros_like(centre), np.bincount(near, minlength=len(centre))
        np.add.at(total, near, x)
        centre = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centre)
    return centre


@dataclass(frozen=True)
class Space:
    """Centroids and codebooks (words by subspace) for vectors of one length; ``scale`` is what a cell's words are multiplied by, 1 if not given."""

    centre: np.ndarray
    book: np.ndarray
    eta: float
    scale: np.ndarray | None = None

    def encode(self, x: np.ndarray, cell: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of rows in their cells: of all words the one of least loss, given the parallel errors of the other subspaces."""
        rest, way, loss, along = self._errors(x, cell)
        code = loss.argmin(2)
        rows, total = np.arange(len(x)), 0
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for s in range(code.shape[1]):
                others = total - along[rows, s, code[:, s]]
                code[:, s] = (loss[:, s] + (self.eta - 1) * (others[:, None] + along[:, s]) ** 2).argmin(1)
                total = others + along[rows, s, code[:, s]]
        return code

    def _errors(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, ...]:
        size = np.sqrt((x * x).sum(1, keepdims=True))
        rest = x - self.centre[cell]
        rest = subspaces(rest if self.scale is None else rest / self.scale[cell][:, None])
        way = subspaces(x / np.maximum(size, 1e-30))
        gap = rest[:, :, None] - self.book[None]
        return rest, way, (gap * gap).sum(3), np.einsum("nsjw,nsw->nsj", gap, way)

    def refit(self, x: np.ndarray, cell: np.ndarray) -> Space:
        """The words that cost least for the codes of ``x``."""
        code = self.encode(x, cell)
        rest, way, _, along = self._errors(x, cell)
        rows, extra, book = np.arange(len(x)), self.eta - 1, self.book.copy()
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for s in range(code.shape[1]):
            others = total - along[rows, s, code[:, s]]
            r, u, own = rest[:, s], way[:, s], code[:, s]
            left, right = np.zeros((WORDS, WIDTH, WIDTH)), np.zeros((WORDS, WIDTH))
            np.add.at(left, own, np.eye(WIDTH) + extra * u[:, :, None] * u[:, None])
            np.add.at(right, own, r + extra * (others + (r * u).sum(1))[:, None] * u)
            used = np.bincount(own, minlength=WORDS) > 0
            book[s, used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            total = others + ((r - book[s, own]) * u).sum(1)
        return Space(self.centre, book.astype(np.float32), self.eta, self.scale)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """By byte of a code, query and value of the byte: what the byte's two words add to the inner product."""
        single = np.einsum("qsw,sjw->qsj", subspaces(queries), self.book)
        low, high = single[:, 0::2], single[:, 1::2]
        return (low[:, :, None, :] + high[:, :, :, None]).reshape(len(queries), low.shape[1], WORDS * WORDS).transpose(1, 0, 2)


def packed(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, the first in the lower half."""
    return (code[:, 0::2] | code[:, 1::2] << 4).astype(np.uint8)


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """By query and vector the sum of the table entries that the vector's bytes name."""
    out = np.zeros((tables.shape[1], len(codes)), np.float32)
    for table, byte in zip(tables, codes.T, strict=True):
        out += table.take(byte, axis=1)
    return out


def scales(rest: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """By cell the size of its ways from the centroid against the middle one's, as a power of two; 1 for a cell without any."""
    size = np.sqrt(np.bincount(cell, (rest.astype(np.float64) ** 2).sum(1), cells) / np.maximum(np.bincount(cell, minlength=cells), 1))
    out = np.ones(cells, np.float32)
    if (size > 0).any():
        out[size > 0] = 2.0 ** np.clip(np.round(np.log2(size[size > 0] / np.median(size[size > 0]))), -60, 60)
    return out


def train(sample: np.ndarray, cells: int, rounds: int = 3) -> Space:
    x = sample.astype(np.float32)
    centre = k_means(x, max(1, min(cells, len(x) // 8)))
    cell = np.concatenate([nearest_centre(x[i : i + 4096], centre)[:, 0] for i in range(0, len(x), 4096)])
    scale = scales(x - centre[cell], cell, len(centre))
    some = np.random.default_rng(6).permutation(len(x))[:FITTED]
    x, cell = x[some], cell[some]
    rest = subspaces((x - centre[cell]) / scale[cell][:, None])
    book = np.stack([np.resize(k_means(np.ascontiguousarray(rest[:, s]), WORDS), (WORDS, WIDTH)) for s in range(rest.shape[1])])
    space = Space(centre, book, weight(x.shape[1]), scale)
    for _ in range(rounds):
        space = space.refit(x, cell)
    return space


def exact(measure: str, query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The measure in double precision of one query and rows; a distance beyond the squares' range is scaled first."""
    if measure == "ip":
        return x @ query
    gap = x - query
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt(np.add.accumulate(gap * gap, 1)[:, -1])  # one by one in order, so that the sum doesn't follow the width of the machine's registers
        top = np.abs(gap).max(1)
        odd = (top > 0) & ~((out < 1e150) & (out > 1e-150))
        out[odd] = top[odd] * np.sqrt(((gap[odd] / top[odd, None]) ** 2).sum(1))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = batch.column("embedding").value_lengths().to_numpy()
    for size in np.unique(sizes).tolist():
        yield batch.take(pa.array(np.flatnonzero(sizes == size)))


def _index(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Length, cell and code of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = shared.value
        for batch in batches:
            for part in _by_length(batch) if batch.num_rows else ():
                for low in range(0, part.num_rows, 1024):
                    own = part.slice(low, 1024)
                    x = _matrix(own.column("embedding"))
                    n, d = x.shape
                    cell, codes = np.zeros(n, np.int64), [b""] * n
                    if d in spaces:
                        space, plain = spaces[d], np.abs(x).max(1) <= HUGE
                        y = x[plain].astype(np.float32)
                        cell[~plain] = -1
                        if len(y):
                            near = nearest_centre(y, space.centre)[:, 0]
                            cell[plain] = near
                            for i, code in zip(np.flatnonzero(plain).tolist(), packed(space.encode(y, near)), strict=True):
                                codes[i] = code.tobytes()
                    columns = [pa.array(np.full(n, d, np.int32)), pa.array(cell), pa.array(codes, pa.binary()), *(own.column(c) for c in ("node", "ids", "embedding"))]
                    yield pa.RecordBatch.from_arrays(columns, ["dim", "cell", "code", "node", "ids", "embedding"])

    return run


def _probes(shared, probe: int, measure: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for every cell that a query scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = shared.value
        for batch in batches:
            for part in _by_length(batch) if batch.num_rows else ():
                x = _matrix(part.column("embedding"))
                n, d = x.shape
                cells: list[np.ndarray] = [np.array([0])] * n
                if d in spaces:
                    centre = spaces[d].centre
                    plain = np.abs(x).max(1) <= HUGE
                    near = np.tile(np.arange(len(centre)), (n, 1))
                    if probe < len(centre):
                        y = np.where(plain[:, None], x, 0).astype(np.float32)
                        near = nearest_centre(y, centre, probe) if measure == "l2" else np.argpartition(-(y @ centre.T), probe - 1, 1)[:, :probe]
                    # outsized queries scan all cells, outsized vectors are scanned by all
                    cells = [np.r_[-1, near[i] if plain[i] else np.arange(len(centre))] for i in range(n)]
                row = pa.array(np.repeat(np.arange(n), list(map(len, cells))))
                columns = [pa.array(np.full(len(row), d, np.int32)), pa.array(np.concatenate(cells)), *(part.column(c).take(row) for c in ("query_id", "query", "embedding"))]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "cell", "query_id", "query", "embedding"])

    return run


_FOUND = "query_id long, query long, vec_id long, score double"


def _search(shared, k: int, rerank: int, measure: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best of a block for each of a part of its cell's queries."""
    sign = -1 if measure == "ip" else 1

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            x, q = _matrix(vectors.column("embedding")), _matrix(queries.column("embedding"))
            lists = vectors.column("ids").to_pylist()
            sizes = np.array(list(map(len, lists)))
            ids, starts = np.concatenate([np.array(i, np.int64) for i in lists]), np.cumsum(np.r_[0, sizes])
            cell, space, n = vectors.column("cell")[0].as_py(), shared.value.get(x.shape[1]) if shared else None, len(x)
            scanned = space is not None and cell >= 0 and n > rerank
            wide = np.abs(q).max(1) > HUGE
            if scanned:
                codes = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(n, -1)
                y = np.where(wide[:, None], 0, q).astype(np.float32)
                near = scan(space.tables(y), codes) * (1 if space.scale is None else space.scale[cell]) + (y @ space.centre[cell])[:, None]
                far = -near if measure == "ip" else (x * x).sum(1)[None] - 2 * near
                best = np.argpartition(far, rerank - 1, 1)[:, :rerank]
            for i, (name, node) in enumerate(zip(queries.column("query_id").to_pylist(), queries.column("query").to_pylist(), strict=True)):
                use = best[i] if scanned and not wide[i] else np.arange(n)
                score = exact(measure, q[i], x[use])
                at = np.repeat(starts[use] - np.r_[0, np.cumsum(sizes[use])[:-1]], sizes[use]) + np.arange(sizes[use].sum())
                own, value = ids[at], np.repeat(score, sizes[use])
                keep = own != name
                own, value = own[keep], value[keep]
                top = np.lexsort((own, sign * value))[:k]
                for column, values in zip(out, ([name] * len(top), [node] * len(top), own[top].tolist(), value[top].tolist()), strict=True):
                    out[column] += values
        return pa.table({c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in out.items()})

    return run


def _compare(shared, k: int, measure: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of each batch of classes for the audited queries."""
    search = _search(None, k, 1 << 62, measure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        lengths = np.array([len(v) for v in queries.column("embedding").to_pylist()])
        for batch in batches:
            for part in _by_length(batch) if batch.num_rows else ():
                own = pa.Table.from_batches([part])
                asked = queries.take(pa.array(np.flatnonzero(lengths == len(part.column("embedding")[0]))))
                if asked.num_rows:
                    yield from search(own.append_column("cell", pa.array([-1] * own.num_rows)), asked).to_batches()

    return run


def _best(found: DataFrame, k: int, measure: str) -> DataFrame:
    """The k best of each query over all that was found."""
    first = F.desc("score") if measure == "ip" else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(first, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class Index:
    """All vectors of a table (vec_id, embedding), quantised, for searches of up to ``k`` neighbours."""

    def __init__(self, vectors: DataFrame, k: int = 10, cell: int = 1000, measure: str = "l2") -> None:
        if measure not in ("l2", "ip"):
            raise ValueError(f"measure must be l2 or ip, not {measure}")
        self.scratch, self.k, self.measure = Scratch(vectors.sparkSession, "search"), k, measure
        self.spark = vectors.sparkSession
        rows = self.scratch.save(sound(vectors), "rows")
        least = F.row_number().over(Window.partitionBy("node", "other").orderBy("vec_id"))
        ids = rows.select("node", "other", "vec_id").withColumn("at", least).where(F.col("at") <= k + 1).groupBy("node", "other").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        vector = rows.groupBy("node", "other").agg(F.first("embedding").alias("embedding"))
        self.classes = self.scratch.save(ids.join(vector, ["node", "other"]).select("node", "ids", "embedding"), "classes")
        self.rows = rows
        n, wide = self.classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
        most = max(1, min(SAMPLE, MOST_BYTES // (8 * wide)))
        some = self.classes.where(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30))).select("node", "embedding").toArrow().sort_by("node")
        spaces: dict[int, Space] = {}
        for batch in some.combine_chunks().to_batches():
            for part in _by_length(batch):
                x = _matrix(part.column("embedding"))
                x = x[np.abs(x).max(1) <= HUGE]
                if len(x) >= LEAST:
                    spaces[x.shape[1]] = train(x, min(MOST_CENTROIDS, round(n * len(x) / some.num_rows / cell)))
        self.cells = max([len(s.centre) for s in spaces.values()], default=1)
        self.spaces = self.spark.sparkContext.broadcast(spaces)
        kind = vectors.schema["embedding"].dataType.simpleString()
        kind = kind if kind == "array<float>" else "array<double>"
        self.kind = kind
        coded = self.scratch.save(self.classes.mapInArrow(_index(self.spaces), f"dim int, cell long, code binary, node long, ids array<bigint>, embedding {kind}"), "coded")
        # at most MOST_CENTROIDS cells a length, and those are few
        self.blocks = self.scratch.save(coded.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
        self.coded = coded

    def queries(self, condition: Column) -> DataFrame:
        """The indexed rows that hold, as queries."""
        return self.rows.where(condition).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"), "embedding")

    def _run(self, scratch: Scratch, queries: DataFrame, probe: int, rerank: int, name: str) -> DataFrame:
        asked = queries.mapInArrow(_probes(self.spaces, probe, self.measure), f"dim int, cell long, query_id long, query long, embedding {self.kind}")
        asked = scratch.save(asked.join(self.blocks, ["dim", "cell"]), f"asked-{name}-{probe}-{rerank}")
        parts = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        keys = ["dim", "cell", "block", "part"]
        every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
        sizes = self.blocks.join(parts, ["dim", "cell"])  # a row a cell that is asked for
        own = self.coded.join(sizes, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks")).cast("int"))
        vectors = own.select("dim", "cell", "block", every("parts").alias("part"), "code", "ids", "embedding")
        theirs = asked.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "query_id"), F.col("parts")).cast("int"))
        theirs = theirs.select("dim", "cell", every("blocks").alias("block"), "part", "query_id", "query", "embedding")
        found = vectors.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(_search(self.spaces, self.k, rerank, self.measure), _FOUND)
        return _best(found, self.k, self.measure)

    def search(self, queries: DataFrame, probe: int = 8, rerank: int = 64, recall: float = 0.97) -> DataFrame:
        """query_id, rank, vec_id, score of the nearest of each query (query_id, query, embedding), the query's own id aside."""
        scratch = Scratch(self.spark, "search")  # results are lazy, and an index is searched more than once
        queries = scratch.save(queries, "queries")
        count = queries.count()
        audit = scratch.save(queries.where(F.pmod(F.xxhash64(F.lit(4), "query_id", "query"), F.lit(1 << 30)) < int(min(1.0, AUDIT / max(1, count)) * (1 << 30))), "audit")
        shared = self.spark.sparkContext.broadcast(audit.toArrow())
        truth = scratch.save(_best(self.classes.mapInArrow(_compare(shared, self.k, self.measure), _FOUND), self.k, self.measure), "truth")
        all_true = truth.count()
        while probe < self.cells or rerank < BLOCK:
            got = self._run(scratch, audit, probe, rerank, "audit").join(truth, ["query_id", "query", "vec_id"], "left_semi").count()
            if got >= recall * all_true:
                break
            probe, rerank = (min(self.cells, probe * 4), rerank) if probe < self.cells else (probe, rerank * 4)
        # the audit is a mean, and a few hard queries don't move it: each one goes on until four times the effort finds it nothing else
        keys, done, found = ["query_id", "query"], [], None
        while True:
            # an overfull block can hold more than BLOCK classes by chance, so all of it is asked for in the end
            now = self._run(scratch, queries, probe, rerank if rerank < BLOCK else 1 << 62, "all")
            if probe >= self.cells and rerank >= BLOCK:
                done.append(now)
                break
            now = scratch.save(now, f"found-{probe}-{rerank}")
            if found is not None:
                moved = scratch.save(now.join(found, [*keys, "vec_id", "score"], "left_anti").select(*keys).distinct(), f"moved-{probe}-{rerank}")
                done.append(now.join(moved, keys, "left_anti"))
                queries = scratch.save(queries.join(moved, keys, "left_semi"), f"queries-{probe}-{rerank}")
                if queries.isEmpty():
                    break
            found, probe, rerank = now, min(self.cells, probe * 4), rerank * 4
        found = reduce(DataFrame.unionByName, done)
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id, two hashes that name the vector, and the vector of the rows that take part, each once."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    floats = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    good = F.forall(floats, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(floats, lambda v: v != 0) & F.col("vec_id").isNotNull()
    keyed = vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), floats.alias("embedding"))
    named = keyed.select("vec_id", F.xxhash64("embedding").alias("node"), F.xxhash64(F.lit(3), "embedding").alias("other"), "embedding")
    return named.groupBy("vec_id", "node", "other").agg(F.first("embedding").alias("embedding"))


def nearest_of_hundredth(vectors: DataFrame, k: int = 10) -> DataFrame:
    """The contract's query: rows whose vec_id is divisible by 100 against all rows, by Euclidean distance."""
    index = Index(vectors, k)
    return index.search(index.queries(F.col("vec_id") % 100 == 0))
