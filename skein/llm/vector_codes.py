"""Product codes of vectors by filtering Lloyd rounds.

Vectors become integers and are cut into equal parts. Each partition packs its vectors into blocks and builds a kd-tree over each part of a block once, with the bounding box, sum and count of every node
beside the points. A round walks each tree level by level with the codebook: entries that can be nearest to no point of a node's box are eliminated, a node with one entry left is
assigned whole from its cached sum and count, and only what is left in leaves is compared point by point. A task sends one sum for each entry. All is integer arithmetic, so the codebooks do not
depend on blocks, partitions or order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.store import bound_batches, cut, looked_up
from skein.llm.textkit import column

#: Integers in a block, and points in a leaf at most.
BLOCK_VALUES, LEAF = 1 << 17, 16
SCALE = 4096
#: Integers are held within these bounds, so that no squared distance of a part of up to 256 components leaves 64 bits.
LIMIT = 1 << 25
_FAR = np.iinfo(np.int64).max


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integers) of the rows whose embedding is there and has neither null nor non-finite components."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c.cast("double") * SCALE))).cast("int")
    return vectors.filter(x.isNotNull()).filter(~bad).select("vec_id", "label", F.transform(x, whole).alias("v"))


def _levels(n: int) -> int:
    """Levels below the root of a tree over n points: leaves have at most LEAF."""
    return max(0, int(np.ceil(np.log2(n / LEAF)))) if n else 0


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in the tree's order of points, and n."""
    return n * np.arange((1 << level) + 1, dtype=np.int64) >> level


class Trees:
    """kd-trees over the parts of a block: order and points (parts, n[, width]) in the trees' order; low, high, sums (parts, nodes, width), nodes in heap order."""

    COLUMNS = ("order", "points", "low", "high", "sums")
    TYPES = (np.int32, np.int32, np.int32, np.int32, np.int64)

    def __init__(self, n: int, width: int, arrays: list[np.ndarray]):
        self.n, self.width = n, width
        self.order, self.points, self.low, self.high, self.sums = arrays

    @classmethod
    def build(cls, v: np.ndarray) -> Trees:
        """v: (n, parts, width). A node's points are halved at the median of the box's longest side."""
        n, parts, width = v.shape
        depth, every = _levels(n), []
        for p in range(parts):
            x, order = v[:, p, :], np.arange(n)
            for level in range(depth):
                at = _bounds(n, level)
                y = x[order]
                side = (np.maximum.reduceat(y, at[:-1]) - np.minimum.reduceat(y, at[:-1])).argmax(1)
                node = np.repeat(np.arange(1 << level), np.diff(at))
                order = order[np.lexsort((y[np.arange(n), side[node]], node))]
            y = x[order]
            starts = [_bounds(n, level)[:-1] for level in range(depth + 1)]
            over = lambda f, **k: np.concatenate([f.reduceat(y, s, **k) for s in starts])  # noqa: B023, E731
            every.append((order, y, over(np.minimum), over(np.maximum), over(np.add, dtype=np.int64)))
        return cls(n, width, [np.stack(a).astype(t) for a, t in zip(zip(*every, strict=True), cls.TYPES, strict=True)])

    def packed(self) -> list[bytes]:
        return [getattr(self, c).tobytes() for c in self.COLUMNS]

    @classmethod
    def unpacked(cls, n: int, parts: int, width: int, raw: list[bytes]) -> Trees:
        nodes = (2 << _levels(n)) - 1
        shapes = [(parts, n), (parts, n, width), *[(parts, nodes, width)] * 3]
        return cls(n, width, [np.frombuffer(r, t).reshape(s) for r, t, s in zip(raw, cls.TYPES, shapes, strict=True)])

    def assign(self, p: int, entries: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums (entries, width) and counts of the points of a part by nearest entry, ties to the lower one; codes (n,) gets each point's, in the tree's order."""
        z, k = entries.astype(np.int64), len(entries)
        sums, counts = np.zeros((k, self.width), np.int64), np.zeros(k, np.int64)
        depth, nodes, open_ = _levels(self.n), np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(depth + 1):
            at, first = _bounds(self.n, level), (1 << level) - 1
            low, high = self.low[p, first + nodes].astype(np.int64), self.high[p, first + nodes].astype(np.int64)
            to_middle = ((2 * z[None] - (low + high)[:, None]) ** 2).sum(2)
            best = np.where(open_, to_middle, _FAR).argmin(1)
            b = z[best][:, None]
            corner = np.where(z[None] > b, high[:, None], low[:, None])  # the point of the box that lies most in an entry's favour
            loss = ((z[None] - b) * (z[None] + b - 2 * corner)).sum(2)
            open_ = open_ & ((loss < 0) | ((loss == 0) & (np.arange(k) <= best[:, None])))
            sure = open_.sum(1) == 1
            np.add.at(counts, best[sure], np.diff(at)[nodes[sure]])
            np.add.at(sums, best[sure], self.sums[p, first + nodes[sure]])
            if codes is not None:
                _fill(codes, at, nodes[sure], best[sure])
            nodes, open_ = nodes[~sure], open_[~sure]
            if not len(nodes):
                return sums, counts
            if level < depth:
                nodes, open_ = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(open_, 2, axis=0)
        size = np.diff(at)[nodes]
        place = np.repeat(at[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        x = self.points[p, place].astype(np.int64)
        away = (z * z).sum(1)[None] - 2 * (x @ z.T)
        to = np.where(np.repeat(open_, size, axis=0), away, _FAR).argmin(1)
        np.add.at(counts, to, 1)
        np.add.at(sums, to, x)
        if codes is not None:
            codes[place] = to
        return sums, counts


def _fill(codes: np.ndarray, at: np.ndarray, nodes: np.ndarray, to: np.ndarray) -> None:
    for a, b, e in zip(at[nodes].tolist(), at[nodes + 1].tolist(), to.tolist(), strict=True):
        codes[a:b] = e


def _blocks(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """Rows of up to BLOCK_VALUES integers: n, ids, labels and the packed trees."""
    most = max(LEAF, BLOCK_VALUES // max(1, parts * width))
    names = ["n", "ids", "labels", *Trees.COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            n, lists = len(rows), rows["v"].combine_chunks()
            ends = lists.offsets.to_numpy().astype(np.int64)
            v = np.zeros((n, parts * width), np.int64)
            length = np.diff(ends)
            row = np.repeat(np.arange(n), length)
            v[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], length)] = lists.flatten().to_numpy()
            packed = Trees.build(v.reshape(n, parts, width)).packed()
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows[c].combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), whole("vec_id"), whole("label"), *[pa.array([x], pa.binary()) for x in packed]], names=names)

        held, n = [], 0
        for batch in batches:
            while len(batch):
                some = batch.slice(0, most - n)
                held, n, batch = [*held, some], n + len(some), batch.slice(len(some))  # noqa: PLW2901
                if n == most:
                    yield pack(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))

    types = dict(vectors.dtypes)
    return vectors.mapInArrow(run, f"n int, ids array<{types['vec_id']}>, labels array<{types['label']}>, " + ", ".join(f"{c} binary" for c in Trees.COLUMNS))


def _each(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, Trees]]:
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1)
            yield row, Trees.unpacked(column(row, "n")[0].as_py(), parts, width, [column(row, c)[0].as_buffer() for c in Trees.COLUMNS])


def _sums(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """(parts, entries, 1 + width): count and sums of the points nearest to each entry. Each task sends one number for each of these."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, 1 + width), np.int64)
        for _, trees in _each(batches, parts, width):
            for p in range(parts):
                s, n = trees.assign(p, books[p])
                total[p, :, 0] += n
                total[p, :, 1:] += s
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "x"])

    out = np.zeros(parts * k * (1 + width), np.int64)
    for r in blocks.mapInArrow(run, "at bigint, x bigint").groupBy("at").agg(F.sum("x").alias("x")).collect():  # a row for each number of the codebooks
        out[r["at"]] = r.x
    return out.reshape(parts, k, 1 + width)


def _codes(blocks: DataFrame, books: np.ndarray, id_type: str, label_type: str) -> DataFrame:
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, trees in _each(batches, parts, width):
            codes, error, mine = np.zeros((trees.n, parts), np.uint8), np.zeros(trees.n, np.int64), np.zeros(trees.n, np.int64)
            for p in range(parts):
                trees.assign(p, books[p], mine)
                codes[trees.order[p], p] = mine
                error[trees.order[p]] += ((trees.points[p].astype(np.int64) - books[p][mine]) ** 2).sum(1)
            spelled = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([column(row, "ids").flatten(), column(row, "labels").flatten(), pa.array(spelled, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error bigint")


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame | None, np.ndarray]:
    """(blocks, codebooks (parts, entries, width)) of vectors (vec_id, label, v) as integers() gives them. No blocks without vectors.

    Codebooks start as the parts of the vectors with the smallest vec_ids (null last, those of one vec_id in order of components; fewer than `entries` if there are fewer vectors), then come
    `rounds` rounds of assignment and floor(sum / count); an entry without points stays. The parts of a vector are as long as an equal cut of the longest vector into whole components needs;
    what a vector lacks is zero.
    """
    bound_batches(vectors.sparkSession)
    longest = vectors.agg(F.max(F.size("v")).alias("n")).first().n
    if longest is None:
        return None, np.zeros((parts, 0, 0), np.int64)
    width = max(1, -(-longest // parts))
    first = [np.pad(np.array(r.v, np.int64), (0, parts * width - len(r.v))) for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    books = np.stack(first).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    blocks = cut(_blocks(vectors, parts, width), "vector-blocks")
    for _ in range(rounds):
        total = _sums(blocks, books)
        n = total[:, :, :1]
        books = np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), books)
    return blocks, books


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, pd.DataFrame]:
    """(vec_id, label, code, error, label_error of every usable row of embeddings (vec_id, embedding, label); the codebooks as part, entry, v).

    Rows with a null vector, or one with null or non-finite components, are dropped. A component x counts as floor(4096 x), within 2^25 either way. code: entries in order of parts, two
    hexadecimal digits each. error: squared distances to the entries, summed over parts. label_error: errors summed over the rows of a label, nulls together. Repeated rows are coded each; a vector without components has
    those of zeros; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    vectors = integers(embeddings)
    blocks, books = fit(vectors, parts, entries, rounds)
    table = pd.DataFrame([(p, e, books[p, e].tolist()) for p in range(books.shape[0]) for e in range(books.shape[1])], columns=["part", "entry", "v"])
    if blocks is None:
        nothing = vectors.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"))
        return nothing, table
    types = dict(vectors.dtypes)
    coded = cut(_codes(blocks, books, types["vec_id"], types["label"]), "vector-codes").withColumn("_l", F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn("_no", F.col("label").isNull())
    by_label = cut(coded.groupBy("_l", "_no").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    return looked_up(coded, by_label, ["_l", "_no"], "_n").select("vec_id", "label", "code", "error", "label_error"), table


def digest(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256: that of all components by part, entry and place, in decimal, joined by commas."""
    rows, table = compress(embeddings)
    books = hashlib.sha256(",".join(str(x) for v in table.sort_values(["part", "entry"]).v for x in v).encode()).hexdigest()
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books).alias("codebooks_sha256"))


def _oracle(rounds: int = 6) -> str:
    """The query in DuckDB's SQL: a codebook b0, b1, ... a round, each from the assignment a0, a1, ... to the one before."""
    ctes = ["""k AS (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
            "x AS (SELECT vec_id, (i - 1) // (len(v) // 8) AS part, (i - 1) % (len(v) // 8) AS place, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM k))",
            "f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 16)",
            "b0 AS (SELECT part, entry, place, x AS z FROM x JOIN f USING (vec_id))"]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM (SELECT vec_id, part, entry, sum((x - z) * (x - z)) AS d FROM x JOIN b{r} USING (part, place) GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)""")
        if r < rounds:
            ctes.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(s.z, b.z) AS z FROM b{r} b LEFT JOIN
                (SELECT part, entry, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS z FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL) s USING (part, entry, place))""")
    ctes.append(f"e AS (SELECT vec_id, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    return f"""WITH {", ".join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(z::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256 FROM e JOIN k USING (vec_id)"""


ORACLE = _oracle()
