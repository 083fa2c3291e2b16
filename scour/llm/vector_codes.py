"""Vector codes: each part of a vector is replaced by the nearest entry of that part's codebook.

Components become whole numbers, vectors are cut into equal parts, and each part position has a
codebook that rounds of assignment and averaging improve. All of that is integer arithmetic, so
reruns agree to the last digit, however the rows are dealt.

Most distances are never computed. With each part of a vector the state keeps an upper bound of the
distance to its entry, the b closest other entries in order, a lower bound for each and one outer
bound for all entries beyond. When entries move, bounds move by as much. The first lower bound above
the upper bound ends the entries that can matter: none, and the part keeps its entry; else only those
before it are compared, by their integer distances, so that ties are settled exactly. Only a part
that has overtaken the outer bound sees the whole codebook. b starts at a quarter of the entries and
falls to what the last round needed, an eighth at least.

The state is written to the shared folder in each round, with what it sums up to, and the round
before is deleted once the next one is there. Sums of parts are added up by Spark; only the sums of
the entries come to the driver, as many numbers as the codebooks hold.

Defined cases: rows whose vector is null or holds null or non-finite components take no part, nor do
rows whose vector has another length than the most common one (the longer of a tie), or all rows if
that length can't be cut into the parts. Components beyond +-2^14 make no row: an error is raised,
as distances would leave 64 bits. Fewer rows than entries make as many entries. The first entries go
by id, null ids last, equal ids by vector. Repeated rows count as often as they are there. Ties of
distance go to the lower index. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.sources.staging import discard, stage

#: The largest component that is accepted, and rows whose distances are computed at a time.
LARGEST, SLICE = 1 << 14, 4096
#: Labels whose sums are broadcast; more are joined.
BROADCAST = 100_000
#: Tasks that the rows of a label are spread over in that join.
SPREAD = 32


@dataclass(frozen=True)
class Shape:
    parts: int
    size: int  # components of a part
    scale: int
    entries: int

    @property
    def first_bound(self) -> int:
        """b of the first round: entries with a bound of their own."""
        return max(1, min(self.entries - 1, math.ceil(self.entries / 4)))

    @property
    def least_bound(self) -> int:
        return max(1, min(self.entries - 1, math.ceil(self.entries / 8)))


# --- arithmetic -----------------------------------------------------------------------------------


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(vectors * scale).astype(np.int64)


def distances(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, of each row of `values` to all entries or, row by row, to some of them."""
    if entries.ndim == 2:
        entries = entries[None]
    return ((values[:, None, :] - entries) ** 2).sum(2)


def _up(values: np.ndarray) -> np.ndarray:
    return np.nextafter(values.astype(np.float32), np.float32(np.inf))


def _down(values: np.ndarray) -> np.ndarray:
    return np.nextafter(values.astype(np.float32), np.float32(-np.inf))


@dataclass
class Bounds:
    """What is kept of one part of some rows."""

    code: np.ndarray  # the entry
    upper: np.ndarray  # not below the distance to it
    close: np.ndarray  # the b closest other entries
    lower: np.ndarray  # not above their distances, rising, and the outer bound in the last column

    @classmethod
    def fresh(cls, values: np.ndarray, codebook: np.ndarray, b: int) -> Bounds:
        """From all distances."""
        squared = distances(values, codebook)
        order = np.argsort(squared, axis=1, kind="stable")
        rooted = np.sqrt(np.take_along_axis(squared, order[:, : b + 2], 1).astype(float))
        lower = np.full((len(values), b + 1), np.inf, np.float32)
        lower[:, : rooted.shape[1] - 1] = _down(rooted[:, 1:])
        close = np.zeros((len(values), b), np.uint8)
        close[:, : order.shape[1] - 1] = order[:, 1 : b + 1]
        return cls(order[:, 0].astype(np.uint8), _up(rooted[:, 0]), close, lower)

    def move(self, moved: np.ndarray) -> None:
        """Follow entries that have moved by these distances."""
        self.upper = _up(self.upper.astype(float) + moved[self.code])
        self.lower[:, :-1] = _down(self.lower[:, :-1].astype(float) - moved[self.close])
        self.lower[:, -1] = _down(self.lower[:, -1].astype(float) - moved.max())
        # Rising again: no bound is above a later one.
        self.lower = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1].copy()

    def shrink(self, b: int) -> None:
        """Keep fewer entries; the bound of the first one that is dropped becomes the outer bound."""
        self.close, self.lower = self.close[:, :b], self.lower[:, : b + 1]

    def assign(self, values: np.ndarray, codebook: np.ndarray) -> int:
        """Exact entries again. Returns how many close entries a row had to be compared with."""
        b = self.close.shape[1]
        open_ = np.flatnonzero(self.upper >= self.lower[:, 0])
        own = ((values[open_] - codebook[self.code[open_]]) ** 2).sum(1)
        self.upper[open_] = _up(np.sqrt(own.astype(float)))
        needed = (self.upper[open_, None] >= self.lower[open_]).sum(1)
        for z in range(1, b + 1):
            rows = open_[needed == z]
            if not len(rows):
                continue
            some = np.concatenate([self.code[rows, None], self.close[rows, :z]], axis=1)
            # By index first, so that the stable order puts ties to the lower index.
            some.sort(axis=1)
            squared = distances(values[rows], codebook[some])
            order = np.argsort(squared, axis=1, kind="stable")
            some = np.take_along_axis(some, order, 1)
            rooted = np.sqrt(np.take_along_axis(squared, order, 1).astype(float))
            self.code[rows], self.upper[rows] = some[:, 0], _up(rooted[:, 0])
            self.close[rows, :z] = some[:, 1:]
            # All beyond are at least as far as the next bound.
            self.lower[rows, :z] = np.minimum(_down(rooted[:, 1:]), self.lower[rows, z, None])
        rows = open_[needed > b]
        if len(rows):
            new = Bounds.fresh(values[rows], codebook, b)
            self.code[rows], self.upper[rows] = new.code, new.upper
            self.close[rows], self.lower[rows] = new.close, new.lower
        return int(min(needed.max(initial=0), b))


# --- state ----------------------------------------------------------------------------------------


def _schema(key: T.DataType, label: T.DataType) -> T.StructType:
    """Rows of the state, and a row of sums for each batch of them."""
    binary = T.BinaryType()
    fields = {"key": key, "label": label, "values": binary, "codes": binary, "upper": binary}
    fields |= {"close": binary, "lower": binary, "error": T.LongType()}
    fields |= {"sums": T.ArrayType(T.LongType()), "needed": T.IntegerType()}
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _table(column: pd.Series, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), *shape).copy()


def _packed(table: np.ndarray) -> list[bytes]:
    rows = np.ascontiguousarray(table).reshape(len(table), -1)
    return [row.tobytes() for row in rows]


def _sums(values: np.ndarray, codes: np.ndarray, shape: Shape) -> list[int]:
    """Part by part and entry by entry: count, then the sum of each component."""
    out = np.zeros((shape.parts, shape.entries, 1 + shape.size), np.int64)
    for part in range(shape.parts):
        np.add.at(out[part, :, 0], codes[:, part], 1)
        np.add.at(out[part, :, 1:], codes[:, part], values[:, part])
    return out.ravel().tolist()


def _round(shape: Shape, codebooks: np.ndarray, moved: np.ndarray | None, kept: int, b: int, last: bool):
    """Assign all parts. Without `moved` from all distances; else from bounds, `kept` entries each."""

    def assigned(values: np.ndarray, batch: pd.DataFrame) -> tuple[list[Bounds], int]:
        if moved is None:
            every = [Bounds.fresh(values[:, p], codebooks[p], b) for p in range(shape.parts)]
            return every, b
        codes = _table(batch["codes"], np.uint8, shape.parts)
        upper = _table(batch["upper"], np.float32, shape.parts)
        close = _table(batch["close"], np.uint8, shape.parts, kept)
        lower = _table(batch["lower"], np.float32, shape.parts, kept + 1)
        every, needed = [], 0
        for p in range(shape.parts):
            bounds = Bounds(codes[:, p], upper[:, p], close[:, p], lower[:, p].copy())
            bounds.shrink(b)
            bounds.move(moved[p])
            needed = max(needed, bounds.assign(values[:, p], codebooks[p]))
            every.append(bounds)
        return every, needed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), SLICE):
                batch = whole_batch.iloc[at : at + SLICE]
                if moved is None:
                    vectors = np.array(batch["vector"].tolist(), np.float64)
                    values = whole(vectors, shape.scale).reshape(len(batch), shape.parts, shape.size)
                else:
                    values = _table(batch["values"], np.int32, shape.parts, shape.size).astype(np.int64)
                every, needed = assigned(values, batch)
                codes = np.stack([bounds.code for bounds in every], axis=1)
                error = np.zeros(len(batch), np.int64)
                if last:
                    for p in range(shape.parts):
                        error += ((values[:, p] - codebooks[p][codes[:, p]]) ** 2).sum(1)
                state = pd.DataFrame({"key": batch["key"], "label": batch["label"]})
                state["values"] = _packed(values.astype("<i4"))
                state["codes"] = _packed(codes)
                state["upper"] = _packed(np.stack([bounds.upper for bounds in every], axis=1))
                state["close"] = _packed(np.stack([bounds.close for bounds in every], axis=1))
                state["lower"] = _packed(np.stack([bounds.lower for bounds in every], axis=1))
                state["error"] = error
                state["sums"], state["needed"] = None, None
                yield state
                sums = dict.fromkeys(state.columns)
                sums |= {"sums": _sums(values, codes, shape), "needed": needed}
                yield pd.DataFrame([sums], columns=state.columns)

    return run


def _added(state: DataFrame) -> tuple[np.ndarray, int]:
    """The sums of all batches, and the largest number of close entries that was needed."""
    # More than 64 bits are possible over all rows.
    added = (
        state.where("sums IS NOT NULL")
        .select(F.posexplode("sums").alias("at", "value"), "needed")
        .groupBy("at")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.max("needed").alias("needed"))
        .collect()  # as many rows as the codebooks have numbers
    )
    values = {row["at"]: int(row["value"]) for row in added}
    return np.array([values[i] for i in range(len(values))], object), max(r["needed"] for r in added)


def averaged(codebooks: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means; entries of no part stay."""
    new = codebooks.copy()
    table = sums.reshape(*codebooks.shape[:2], -1)
    for place in np.argwhere(table[:, :, 0] > 0):
        count, *totals = table[tuple(place)]
        new[tuple(place)] = [total // count for total in totals]
    return new


# --- operator -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Coded:
    """Codes of the rows, and the codebooks: parts, entries, components."""

    rows: DataFrame  # key, label, codes (binary, a byte a part), error
    codebooks: np.ndarray


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def _usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    doubles = F.col(vector).cast("array<double>")
    finite = F.forall(doubles, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    return rows.where(doubles.isNotNull() & finite).select(
        F.col(key).alias("key"), F.col(label).alias("label"), doubles.alias("vector")
    )


def encode(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> Coded:
    """Fit codebooks on all rows and code them. At most 256 entries."""
    usable = _usable(rows, key, vector, label)
    kinds = [usable.schema[name].dataType for name in ("key", "label")]
    lengths = usable.groupBy(F.size("vector").alias("size")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common and common["size"] % parts == 0 else 0
    usable = usable.where(F.size("vector") == size) if size else usable.where("false")
    # Ids, then vectors, so that equal ids have an order too.
    first = usable.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        empty = usable.select(
            "key", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")
        )
        return Coded(empty, np.zeros((parts, 0, 0), np.int64))
    large = F.exists("vector", lambda v: F.abs(v) > LARGEST)
    usable = usable.withColumn(
        "vector",
        F.when(large, F.raise_error(F.lit(f"A component is beyond {LARGEST}"))).otherwise(F.col("vector")),
    )
    shape = Shape(parts, size // parts, scale, len(first))
    start = whole(np.array([row["vector"] for row in first]), scale)
    codebooks = start.reshape(len(first), parts, shape.size).transpose(1, 0, 2).copy()
    schema = _schema(*kinds)
    state, moved, kept, b = usable, None, 0, shape.first_bound
    for turn in range(rounds + 1):
        step = _round(shape, codebooks, moved, kept, b, last=turn == rounds)
        before, state = state, stage(state.mapInPandas(step, schema), "codes")
        if turn:
            discard(before)
        if turn < rounds:
            sums, needed = _added(state)
            new = averaged(codebooks, sums)
            moved = np.sqrt(((new - codebooks) ** 2).sum(2).astype(float)) * (1 + 1e-9)
            codebooks, kept = new, b
            b = max(shape.least_bound, min(b, needed))
            state = state.where("sums IS NULL")
    return Coded(state.where("sums IS NULL").select("key", "label", "codes", "error"), codebooks)


def with_label_errors(rows: DataFrame, into: str = "label_error") -> DataFrame:
    """The errors summed over the rows of each label, nulls together.

    Sums of few labels are broadcast; many are joined, each repeated so that the rows of one label
    are spread over tasks.
    """
    totals = stage(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias(into)), "labels")
    same = F.col("label").eqNullSafe(F.col("of"))
    if totals.count() <= BROADCAST:
        return rows.join(F.broadcast(totals), same).drop("of")
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("key", "codes"), F.lit(SPREAD)))
    copies = totals.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(copies, same & (F.col("deal") == F.col("to"))).drop("of", "deal", "to")


def as_hex(codes: Column) -> Column:
    return F.lower(F.hex(codes))
