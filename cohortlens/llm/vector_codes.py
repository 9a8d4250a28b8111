"""Product codes for vectors, with codebooks fitted by integer k-means under norm-of-sum bounds.

A vector is cut into equal parts; every part position has a codebook. A row keeps, for each part, its entry, an upper bound of
the distance to it and a lower bound of the distance to all others, each bound with the round it was taken in. The codebooks of
all rounds are kept (a few thousand numbers), so a bound is moved by how far entries really went since its round, the norm of
the summed moves, and not by the moves added up round by round, which are never shorter. Where the bounds leave a doubt, the
distance to the own entry is taken first; only if that does not settle it are all entries scanned. Distances that decide are
sums of integers and exact; bounds are rounded outwards and must differ strictly, so ties always reach the scan, where the
lower index wins.

A round is one ``mapInArrow`` pass over a stored table of rows and bounds. It writes the next table, and in it one row per task
with the change of the sums and counts of the entries that parts moved between. Those rows are added up by Spark; only sums per
entry reach the driver. A table is removed once the next one is written. Vectors are never shuffled.

Rows and columns: rows whose vector is null or has null or non-finite components are dropped. A codebook starts from the rows
of smallest id; rows without an id are coded but never start an entry, and among rows of one id the smaller vector comes first.
With fewer rows than entries there are fewer entries. Vectors whose length is not that of the first of these rows, or does not
divide into the parts (an empty one, say), take no part and keep a null code and error, as does every row where no row has an
id. Other columns pass through; ``code`` and ``error`` are replaced. An empty table gives no rows. A component beyond 2^50, or
an error beyond 64 bits, is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.shared import discarded, scratch_path, ship_package
from cohortlens.session import checkpoint_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
ROWS_AT_ONCE = 4096
LARGEST = 2.0**50
LABELS_HELD = 200_000    # label sums that are broadcast; more are joined by a salted exchange
SALTS = 32
_EXACT = 1 << 24         # components up to which squared distances surely fit 64 bits, for up to 4,096 of them a part
_STATE = "code binary, upper array<float>, lower array<float>, upper_round binary, lower_round binary"


@dataclass(frozen=True)
class Codebooks:
    """Entries per part: integers, parts x entries x width."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


# ---------------------------------------------------------------------------------------------------------------------
# One pass over a batch of vectors


def _squares(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to single entries; whole numbers without bound where 64 bits could be too few."""
    apart = parts - entries
    if apart.size and (np.abs(apart).max() > 2 * _EXACT or apart.shape[-1] > 4096):
        apart = apart.astype(object)
    return (apart * apart).sum(-1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


class _Travel:
    """How far entries are from where they were in each earlier round: rounds x parts x entries."""

    def __init__(self, history: list[np.ndarray]):
        now = history[-1].astype(float)
        moved = np.stack([now - past.astype(float) for past in history])
        self.own = np.sqrt((moved * moved).sum(-1)) * (1 + 1e-12)
        # the farthest of the others, for each entry
        entries = self.own.shape[2]
        self.others = np.zeros_like(self.own)
        for entry in range(entries):
            rest = np.delete(self.own, entry, axis=2)
            self.others[:, :, entry] = rest.max(axis=2) if entries > 1 else 0.0


def _assigned(vectors: np.ndarray, state: dict[str, np.ndarray] | None, history: list[np.ndarray], travel: _Travel):
    """Entries of the parts of some vectors under the last codebooks, and their bounds. Also how many parts were scanned."""
    books = history[-1]
    parts, entries, width = books.shape
    at, now = vectors.reshape(len(vectors), parts, width), len(history) - 1
    if state is None:
        shape = (len(vectors), parts)
        state = {
            "code": np.zeros(shape, np.uint8), "upper": np.zeros(shape, np.float32), "lower": np.zeros(shape, np.float32),
            "upper_round": np.zeros(shape, np.uint8), "lower_round": np.zeros(shape, np.uint8),
        }
        doubt = np.ones(shape, bool)
    else:
        state = {name: values.copy() for name, values in state.items()}
        column = np.arange(parts)[None, :]
        upper = state["upper"] + travel.own[state["upper_round"], column, state["code"]]
        lower = state["lower"] - travel.others[state["lower_round"], column, state["code"]]
        # the true distance to the own entry, wherever the moved bounds leave a doubt
        row, part = np.nonzero(~(upper < lower))
        own = np.sqrt(_squares(at[row, part], books[part, state["code"][row, part]]).astype(float))
        state["upper"][row, part], state["upper_round"][row, part] = _up(own), now
        doubt = np.zeros(upper.shape, bool)
        doubt[row, part] = ~(state["upper"][row, part] < lower[row, part])
    scanned = int(doubt.sum())
    for part in range(parts):
        row = np.flatnonzero(doubt[:, part])
        if not len(row):
            continue
        far = _squares(at[row, part][:, None, :], books[part][None, :, :])
        best = far.argmin(1)
        own = far[np.arange(len(row)), best]
        if entries > 1:
            rest = far.copy()
            rest[np.arange(len(row)), best] = rest.max() + 1
            second = np.sqrt(rest.min(1).astype(float))
        else:
            second = np.full(len(row), np.inf)
        state["code"][row, part] = best
        state["upper"][row, part], state["lower"][row, part] = _up(np.sqrt(own.astype(float))), _down(second)
        state["upper_round"][row, part] = state["lower_round"][row, part] = now
    return state, scanned


def _moved_sums(vectors: np.ndarray, before: np.ndarray | None, after: np.ndarray, shape: tuple[int, int, int]):
    """Change of the sums and counts of all entries, as whole numbers without bound."""
    parts, entries, width = shape
    sums, counts = np.zeros(shape, object), np.zeros((parts, entries), object)
    at = vectors.reshape(len(vectors), parts, width)
    for part in range(parts):
        moved = np.arange(len(vectors)) if before is None else np.flatnonzero(before[:, part] != after[:, part])
        for codes, sign in ((after, 1), (before, -1)):
            if codes is None or not len(moved):
                continue
            of = codes[moved, part]
            order = np.argsort(of, kind="stable")
            begins = np.flatnonzero(np.diff(of[order].astype(int), prepend=-1))
            # at most ROWS_AT_ONCE numbers of 50 bits
            added = np.add.reduceat(at[moved[order], part], begins, axis=0)
            for entry, row in zip(of[order][begins], added):
                sums[part, entry] += sign * row.astype(object)
            counts[part] += sign * np.bincount(of, minlength=entries).astype(object)
    return sums, counts


# ---------------------------------------------------------------------------------------------------------------------
# Arrow


def _matrix(column: pa.Array, kind) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0), kind)
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).astype(kind)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def _bytes_column(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), rows, [None, pa.py_buffer(np.ascontiguousarray(values))])
    return fixed.cast(pa.binary())


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel(), kind)
    )


def _round_task(history: list[np.ndarray], fields: list[T.StructField], whole: pa.Schema):
    """Writes every row with its bounds under the last codebooks, then what its parts add to the sums."""
    shape = history[-1].shape
    width = shape[0] * shape[2]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        travel = _Travel(history)
        sums, counts, scanned, rows = np.zeros(shape, object), np.zeros(shape[:2], object), 0, 0
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, ROWS_AT_ONCE):
                batch = whole_batch.slice(start, ROWS_AT_ONCE)
                vectors = _matrix(batch.column("vector"), np.int64).reshape(batch.num_rows, width)
                state = None
                if len(history) > 1:
                    state = {
                        f.name: _matrix(batch.column(f.name), np.uint8 if f.dataType == T.BinaryType() else np.float32)
                        for f in fields
                    }
                before = None if state is None else state["code"]
                after, looked = _assigned(vectors, state, history, travel)
                more, number = _moved_sums(vectors, before, after["code"], shape)
                sums, counts = sums + more, counts + number
                scanned, rows = scanned + looked, rows + len(vectors)
                columns = {
                    name: _bytes_column(after[name]) if after[name].dtype == np.uint8 else _lists(after[name], pa.float32())
                    for name in after
                }
                yield pa.RecordBatch.from_arrays([
                    columns[f.name] if f.name in columns else batch.column(f.name) if f.name in batch.schema.names
                    else pa.nulls(batch.num_rows, f.type) for f in whole
                ], schema=whole)
        if rows:
            last = {
                "sums": pa.array([[int(x) for x in sums.ravel()] + [int(x) for x in counts.ravel()]], whole.field("sums").type),
                "scanned": pa.array([scanned], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(
                [last[f.name] if f.name in last else pa.nulls(1, f.type) for f in whole], schema=whole
            )

    return task


def _final_task(books: np.ndarray, names: list[str]):
    parts, _, width = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), np.int64).reshape(-1, parts, width)
            code = _matrix(batch.column("code"), np.uint8).reshape(-1, parts)
            errors = np.zeros(len(vectors), object)
            for part in range(parts):
                errors += _squares(vectors[:, part], books[part, code[:, part]]).astype(object)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array([row.tobytes().hex() for row in code], pa.string()),
                 pa.array([int(e) for e in errors], pa.int64())], [*names, "code", "error"],
            )

    return task


# ---------------------------------------------------------------------------------------------------------------------
# Spark


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down."""
    scaled = lambda x: x.cast("double") * scale
    too_large = F.raise_error(F.lit("a component is too large for whole-number codes")).cast("bigint")
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < LARGEST, F.floor(scaled(x))).otherwise(too_large))


def _complete(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & fine


def _next_books(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Floor of the mean of the parts of each entry; an entry without parts stays."""
    out = books.copy()
    for part, entry in zip(*np.nonzero(counts)):
        out[part, entry] = [int(x) // int(counts[part, entry]) for x in sums[part, entry]]
    return out


def with_codes(
    df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE, trace: list | None = None,
) -> tuple[DataFrame, Codebooks]:
    """The usable rows with ``code`` (two hex digits a part) and ``error``, the squared distance to what the code stands for;
    and the codebooks. ``trace`` collects, round by round, how many parts were scanned."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    ship_package(spark)
    kept_names = [c for c in df.columns if c not in ("code", "error")]
    renamed = [f"kept_{i}" for i in range(len(kept_names))]
    # columns travel under names of their own, so that none can clash
    given = F.col(f"`{vector_col}`")
    # the test again, because filters may be evaluated in any order
    rows = df.where(_complete(given)).select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(kept_names, renamed)],
        F.when(_complete(given), whole_numbers(given, scale)).alias("vector"), F.col(f"`{id_col}`").alias("start_id"),
    )
    fits = (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    first = rows.where(fits & F.col("start_id").isNotNull()).orderBy("start_id", "vector").select("vector")
    width = first.limit(1).collect()
    back = [F.col(n).alias(c) for c, n in zip(kept_names, renamed)]
    if not width:
        nothing = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")]
        return rows.select(*back, *nothing), Codebooks(np.zeros((parts, 0, 0), np.int64))
    size = len(width[0]["vector"])
    starts = np.array([r["vector"] for r in first.where(F.size("vector") == size).limit(entries).collect()], np.int64)
    books = starts.reshape(len(starts), parts, size // parts).transpose(1, 0, 2)

    history, path = [books], None
    sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], object)
    fields = T.StructType.fromDDL(_STATE).fields
    source = rows.where(F.size("vector") == size).drop("start_id")
    others = T.StructType.fromDDL("sums array<decimal(38,0)>, scanned bigint").fields
    schema = T.StructType(source.schema.fields + fields + others)
    whole = to_arrow_schema(schema)
    for number in range(rounds + 1):
        written = scratch_path(spark, f"codes-{number}")
        source.mapInArrow(_round_task(history, fields, whole), schema).write.parquet(written)
        table = spark.read.schema(schema).parquet(written)
        discarded(spark, path)
        path, source = written, table.where("sums is null").drop("sums", "scanned")
        added = table.where("sums is not null")
        if trace is not None:
            trace.append(added.agg(F.sum("scanned")).first()[0])
        if number == rounds:
            break
        entry_sums = added.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
        flat = np.zeros(sums.size + counts.size, object)
        for row in entry_sums.collect():    # one row per component of an entry
            flat[row["at"]] = int(row["value"])
        sums, counts = sums + flat[: sums.size].reshape(sums.shape), counts + flat[sums.size :].reshape(counts.shape)
        history.append(_next_books(history[-1], sums, counts))
    coded_schema = T.StructType(
        [f for f in schema.fields if f.name in renamed] + T.StructType.fromDDL("code string, error bigint").fields
    )
    coded = source.mapInArrow(_final_task(history[-1], renamed), coded_schema)
    odd = rows.where(F.size("vector") != size).select(
        *renamed, F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")
    )
    result = coded.unionByName(odd).select(*back, "code", "error")
    return result, Codebooks(history[-1])


def with_group_error(coded: DataFrame, label_col: str = "label", name: str = "label_error") -> DataFrame:
    """``name``: the error summed over the rows of a label; rows without a label form one group.

    Sums are combined within tasks, so a label with most rows costs no more than others. They are broadcast up to
    ``LABELS_HELD`` labels; more are joined by label and salt, which spreads the rows of a frequent label.
    """
    label = F.col(f"`{label_col}`")
    checkpoint_dir(coded.sparkSession)
    sums = coded.groupBy(label.alias("_sum_label")).agg(F.sum("error").alias("_sum_error")).checkpoint()
    if sums.count() <= LABELS_HELD:
        joined = coded.join(F.broadcast(sums), label.eqNullSafe(F.col("_sum_label")))
    else:
        salted = sums.withColumn("_sum_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = coded.withColumn("_row_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = spread.join(
            salted, label.eqNullSafe(F.col("_sum_label")) & (F.col("_row_salt") == F.col("_sum_salt"))
        )
    return joined.select(*[f"`{c}`" for c in coded.columns if c != name], F.col("_sum_error").alias(name))
