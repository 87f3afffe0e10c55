"""Vector code compression: product quantisation in whole numbers, nearest entries by a kd-tree over each codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import doc_key, skew_safe_lookup, staged

#: A component x becomes floor(SCALE x). Beyond LIMIT it counts as LIMIT, so that squares and their sums fit 64 bits.
SCALE = 4096
LIMIT = 1 << 27
PARTS, ENTRIES, ROUNDS = 8, 16, 6


@dataclass
class KdTree:
    """A codebook's entries. ``low`` and ``high`` box them in; a leaf holds entries that are all equal, an inner node has two children."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    index: np.ndarray | None = None
    children: tuple[KdTree, KdTree] | None = None

    @classmethod
    def over(cls, entries: np.ndarray, index: np.ndarray | None = None) -> KdTree:
        """Split at the median of the widest dimension until all entries of a node are equal."""
        index = np.arange(len(entries)) if index is None else index
        low, high = entries.min(axis=0), entries.max(axis=0)
        if not len(low) or (low == high).all():
            return cls(low, high, entries[:1], index[:1].copy() if len(index) == 1 else np.array([index.min()]))
        axis = int((high - low).argmax())
        below = entries[:, axis] <= (low[axis] + high[axis]) // 2
        return cls(low, high, children=(cls.over(entries[below], index[below]), cls.over(entries[~below], index[~below])))

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Least squared distance that an entry in the box can have to each row."""
        off = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (off * off).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry; of equally near ones the least index.

        Branch and bound for all rows at once: the nearer child first, then the other for those rows that it may still
        serve. A bound equal to the best distance is followed too, so an entry of lower index that ties is found.
        """
        best = np.full(len(x), np.iinfo(np.int64).max)
        who = np.full(len(x), np.iinfo(np.int64).max)
        self._visit(x, np.arange(len(x)), np.zeros(len(x), np.int64), best, who)
        return who, best

    def _visit(self, x: np.ndarray, rows: np.ndarray, bound: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        rows = rows[bound <= best[rows]]
        if not len(rows):
            return
        if self.children is None:
            off = x[rows] - self.entries[0]
            d = (off * off).sum(axis=1)
            better = (d < best[rows]) | ((d == best[rows]) & (self.index[0] < who[rows]))
            best[rows[better]], who[rows[better]] = d[better], self.index[0]
            return
        one, two = self.children
        b1, b2 = one.bound(x[rows]), two.bound(x[rows])
        near = b1 <= b2
        one._visit(x, rows[near], b1[near], best, who)
        two._visit(x, rows, b2, best, who)
        one._visit(x, rows[~near], b1[~near], best, who)


def whole_vectors(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """``rows`` with a vector of finite components as whole numbers in _v (array<int>), and the length that most of them have (the greater on a tie); others go."""
    x = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.filter(x.isNotNull() & sound)
    lengths = kept.groupBy(F.size(F.col(f"`{vector}`")).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    width = lengths.n if lengths else 0
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    return kept.filter(F.size(F.col(f"`{vector}`")) == width).withColumn("_v", whole), width


def part_values(column, width: int, parts: int) -> np.ndarray:
    """(rows, parts, numbers of a part) of an Arrow list column; a last part that is short is filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    size = -(-width // parts)
    return np.pad(flat, ((0, 0), (0, size * parts - width))).reshape(len(column), parts, size)


def fit_codebooks(spark: SparkSession, vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, number) after so many rounds over ``vectors`` (_k long, _v array<int>).

    They start as the parts of the vectors of least _k (then least _v), as many as ``entries`` at most. Each round sends every
    part to its nearest entry and replaces an entry by the floored mean of what it got; an entry that gets nothing stays.
    Trees go to the workers by broadcast and sums come back, parts x entries rows whatever the input.
    """
    size = -(-width // parts)
    first = vectors.orderBy("_k", "_v").limit(entries).select("_v").collect()
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), width)
    books = np.pad(books, ((0, 0), (0, size * parts - width))).reshape(len(first), parts, size).transpose(1, 0, 2).copy()
    if not len(first) or not width:
        return books
    names = [f"s{i}" for i in range(size)]

    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree.over(b) for b in books])

        def sums(batches: Iterator, trees=trees, many=len(first)) -> Iterator:
            import pyarrow as pa

            total, count = np.zeros((parts, many, size), np.int64), np.zeros((parts, many), np.int64)
            for b in batches:
                x = part_values(b.column(0), width, parts)
                for p, tree in enumerate(trees.value):
                    who, _ = tree.nearest(x[:, p])
                    count[p] += np.bincount(who, minlength=many)
                    np.add.at(total[p], who, x[:, p])
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), *(pa.array(total[p, e, i]) for i in range(size))], names=["part", "entry", "n", *names])

        partial = vectors.select("_v").mapInArrow(sums, "part int, entry int, n long, " + ", ".join(f"{n} long" for n in names))
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names)).collect():
            books[r.part, r.entry] = [r[n] // r.n for n in names]
        trees.destroy()
    return books


def encode(spark: SparkSession, vectors: DataFrame, books: np.ndarray, width: int, keep: list[str]) -> DataFrame:
    """(``keep``, code, error): entry numbers of all parts, two hex digits each, and the squared distances to them, summed."""
    trees = spark.sparkContext.broadcast([KdTree.over(b) for b in books] if books.size else [])
    parts = len(books)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*(f"`{c}`" for c in keep)).schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            codes, error = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, np.int64)
            if trees.value:
                x = part_values(b.column(0), width, parts)
                for p, tree in enumerate(trees.value):
                    who, d = tree.nearest(x[:, p])
                    codes[:, p], error = who, error + d
            text = codes.tobytes().hex()
            code = [text[2 * parts * i : 2 * parts * (i + 1)] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(code, pa.string()), pa.array(error)], names=[*keep, "code", "error"])

    return vectors.select("_v", *(f"`{c}`" for c in keep)).mapInArrow(run, f"{schema}, code string, error long")


def books_text(books: np.ndarray, width: int) -> str:
    """All numbers by part, entry and place, without what fills up a short last part."""
    size = books.shape[2]
    return ",".join(str(int(x)) for p, book in enumerate(books) for entry in book for x in entry[: max(0, width - p * size)])


def compress_vectors(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of each row whose vector has finite components.

    Vectors are cut into ``parts`` consecutive parts of equal length, filled up with zeros if need be. Codebooks are fitted by
    :func:`fit_codebooks`; code and error are by :func:`encode`; label_error is the error summed over equal labels, nulls
    together. codebooks_sha256 is of all entries' numbers by part, entry and place, joined by commas.

    A null vector and one with a null, NaN or infinite component have no row, nor has one of another length than most have.
    Components beyond LIMIT / SCALE count as that. Rows without an id count as those of largest id; ties in it go by the
    vector. Repeated rows all come back. Fewer rows than ``entries``: smaller codebooks. An empty table gives an empty
    result. Other columns don't come back, whatever their names. A label with a third of the rows is looked up by broadcast.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    chosen = rows.select(F.col(f"`{id_col}`"), F.col(f"`{label}`"), F.col(f"`{vector}`"))
    whole, width = whole_vectors(chosen, vector)
    whole = staged(spark, whole.select(doc_key(f"`{id_col}`").alias("_k"), F.col(f"`{id_col}`"), F.col(f"`{label}`"), "_v"), "whole-vectors")
    books = fit_codebooks(spark, whole, width, parts, entries, rounds)
    coded = staged(spark, encode(spark, whole, books, width, ["_k", id_col, label]), "codes")
    # null labels are one label: a hash, the label as text and a mark for null are the key
    coded = coded.withColumns({"_l": F.xxhash64(F.col(f"`{label}`")), "_ls": F.coalesce(F.col(f"`{label}`").cast("string"), F.lit("")), "_ln": F.col(f"`{label}`").isNull()})
    totals = staged(spark, coded.groupBy("_l", "_ls", "_ln").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    out = skew_safe_lookup(coded, totals, ["_l", "_ls", "_ln"], ["label_error"], "_n", ["_k", "code"])
    sha = hashlib.sha256(books_text(books, width).encode()).hexdigest()
    return out.select(F.col(f"`{id_col}`"), F.col(f"`{label}`"), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
