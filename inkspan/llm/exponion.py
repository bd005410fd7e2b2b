"""Vector codes by product quantisation: codebooks of integer entries, found by exponion search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import scratch
from .common import delete, table, written, written_at

#: Sums are kept in limbs of so many bits, so that they are exact for any size and number of components.
LIMB = 40
#: Squared distances times four stay under this in 64 bits; larger components are reckoned with as Python's integers.
SAFE = 1 << 62
_LONG = 1 << 63

Books = list[np.ndarray]  # of each part: entries x positions


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly, for a scale that is a power of two: 64-bit integers where squared distances fit, else Python's."""
    x = np.floor(flat.astype(np.float64) * scale)
    if not len(x) or np.abs(x).max() < 1 << 26:
        return x.astype(np.int64)
    # a double is a fraction with a power of two below, so that this is exact where scale * x is not
    return np.array([(scale * n) // d for n, d in (float(v).as_integer_ratio() for v in flat.tolist())], object)


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """Where each part of a vector is: equal ones, or as equal as can be."""
    return [(k * width // parts, (k + 1) * width // parts) for k in range(parts)]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(-1)


def exponion(x: np.ndarray, entries: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the nearest entry, ties to the smaller index, its squared distance, and how many were examined.

    The search begins at the entry of the round before, at a squared distance d. An entry that is as near or nearer is
    within 2 * sqrt(d) of that entry (triangle inequality), so its neighbours, sorted by their distance to it, are scanned
    while their squared distance to it is at most 4 * d. All in integers."""
    n, k = len(x), len(entries)
    big = x.dtype == object or entries.dtype == object or (max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(abs(int(entries.max(initial=0))), abs(int(entries.min(initial=0))))) ** 2 * max(1, x.shape[1]) * 4 >= SAFE
    x, entries = (v.astype(object if big else np.int64) for v in (x, entries))
    between = np.array([_squares(entries, c) for c in entries]).reshape(k, k)
    best, least = start.copy(), _squares(x, entries[start])
    seen = n
    for a in np.unique(start).tolist():
        near = sorted((i for i in range(k) if i != a), key=lambda i: (between[a][i], i))
        rows = np.flatnonzero(start == a)
        radius = 4 * least[rows]
        for i in near:
            inside = radius >= between[a][i]
            if not inside.any():
                break
            rows, radius = rows[inside], radius[inside]
            d = _squares(x[rows], entries[i])
            seen += len(rows)
            closer = (d < least[rows]) | ((d == least[rows]) & (i < best[rows]))
            best[rows[closer]], least[rows[closer]] = i, d[closer]
    return best, least, seen


def _limbs(v: int) -> list[int]:
    """v = sum of limb * 2**(LIMB * place); all limbs have the sign of v."""
    sign, v, out = (1 if v >= 0 else -1), abs(v), []
    while v:
        out.append(sign * (v & ((1 << LIMB) - 1)))
        v >>= LIMB
    return out


def assign(rows: DataFrame, books: Books, scale: int, sums: bool) -> DataFrame:
    """rows (vec_id, label, vector, code) with their new code (a byte a part) and its error; sums: also the sums of each
    entry's rows as rows (part, entry, position, limb, value), position -1 for their number. Map-only."""
    parts = len(books)
    names = ["vec_id", "label", "vector", "code", "error", "part", "entry", "position", "limb", "value"]
    width = sum(b.shape[1] for b in books)
    cuts = bounds(width, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for b in batches:
            if not (n := b.num_rows):
                continue
            v = b.column("vector")
            x = integers(v.flatten().to_numpy(zero_copy_only=False), scale).reshape(n, width)
            old = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts)
            code, error = np.zeros((n, parts), np.uint8), np.zeros(n, x.dtype)
            for k, (lo, hi) in enumerate(cuts):
                best, least, _ = exponion(x[:, lo:hi], books[k], old[:, k].astype(np.int64))
                code[:, k] = best
                error = error + least
                if sums:
                    for e in np.unique(best).tolist():
                        own = best == e
                        count[k][e] += int(own.sum())
                        total[k][e] += x[own, lo:hi].sum(0).astype(object)
            error = pa.array([e if e < _LONG else None for e in error.tolist()], pa.int64())
            none = [pa.nulls(n, t) for t in kinds[5:]]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), v, pa.array([c.tobytes() for c in code], pa.binary()), error, *none], names)
        if sums:
            out = [(k, e, p, i, x) for k in range(parts) for e in np.flatnonzero(count[k]).tolist() for p, s in [(-1, int(count[k][e])), *enumerate(total[k][e].tolist())] for i, x in enumerate(_limbs(int(s)))]
            cols = list(zip(*out)) or [[]] * 5
            first = [pa.nulls(len(out), t) for t in (given["vec_id"], given["label"], given["vector"], pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*first, *(pa.array(c, t) for c, t in zip(cols, kinds[5:]))], names)

    given = {c: to_arrow_type(rows.schema[c].dataType) for c in ("vec_id", "label", "vector")}
    kinds = [*given.values(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    of = lambda c: f"{c} {rows.schema[c].dataType.simpleString()}"
    made = f"{of('vec_id')}, {of('label')}, {of('vector')}, code binary, error long, part int, entry int, position int, limb int, value long"
    return rows.select("vec_id", "label", "vector", "code").mapInArrow(run, made)


def replaced(books: Books, sums: DataFrame) -> Books:
    """Books with each entry that has rows replaced by their componentwise floor(sum / count). sums: at most one row for each
    number of all entries and limb of it, whatever the input."""
    found: dict[tuple[int, int, int], int] = {}
    for r in sums.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")).collect():
        at = (r.part, r.entry, r.position)
        found[at] = found.get(at, 0) + (r.value << (LIMB * r.limb))
    out = []
    for k, b in enumerate(books):
        new = [[found.get((k, e, p), 0) // found[k, e, -1] for p in range(b.shape[1])] if (k, e, -1) in found else b[e].tolist() for e in range(len(b))]
        out.append(_book(new, b.shape[1]))
    return out


def _book(rows: list[list[int]], width: int) -> np.ndarray:
    small = all(abs(v) < 1 << 31 for r in rows for v in r)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), width)


def vector_codes(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code (two hex digits a part), error (long: squared distance to the code's entries), label_error (sum of error
    over equal labels, nulls together), codebooks_sha256; other columns are left alone.

    Components become floor(scale * x). The codebook of each part begins as that part of the `entries` smallest vec_ids (null
    last, equal ones by vector), fewer if there are no more rows. Rows without a vector, with a null or non-finite component,
    or of another length than the smallest vec_id's take no part; lengths that don't divide by `parts` are cut as equally
    as can be. Repeated rows: each counts. error is null beyond a long, label_error then, too. Empty table: no rows.

    A round is one pass: tasks assign their rows by exponion search from the codes of the round before, and write rows
    and, beside them, the exact sums of their entries. The table of the round before is deleted when the next is whole."""
    real = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.coalesce(real, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    lead = rows.orderBy(*order).select(F.size("vector").alias("n")).first()
    width = lead.n if lead else 0
    rows = rows.where(F.size("vector") == width)
    first = [r.vector for r in rows.orderBy(*order).select("vector").limit(entries).collect()]  # the first codebooks
    cuts = bounds(width, parts)
    start = [[(scale * n) // d for n, d in (float(v).as_integer_ratio() for v in x)] for x in first]
    books = [_book([x[lo:hi] for x in start], hi - lo) for lo, hi in cuts]
    now, path = rows.withColumn("code", F.unhex(F.lit("00" * parts))), None
    if first:
        for _ in range(rounds):
            done = written_at(assign(now, books, scale, True), place := scratch(df.sparkSession, "vector-codes"))
            if path:
                delete(df.sparkSession, path)
            books, path = replaced(books, done.where("entry IS NOT NULL")), place
            now = done.where("code IS NOT NULL")
    text = ",".join(str(v) for b in books for e in b.tolist() for v in e)
    last = assign(now, books, scale, False).select("vec_id", "label", "code", "error") if first else now.select("vec_id", "label", "code", F.lit(0).cast("long").alias("error"))
    last = written(last, "vector-codes-last", narrow=True)
    if path:
        delete(df.sparkSession, path)
    exact = F.when(F.count("error") == F.count("*"), F.try_sum("error"))
    by = last.groupBy(F.col("label").alias("l")).agg(exact.alias("label_error"))
    joined = last.join(by, F.col("label").eqNullSafe(F.col("l")), "left")
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def op12_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same in SQL: every entry is compared, one row for each component."""
    sql = [
        "kept as materialized (select vec_id, label, embedding, row_number() over (order by vec_id nulls last, embedding) as r from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        "same as materialized (select * from kept where len(embedding) = (select len(embedding) from kept where r = 1))",
        f"p as materialized (select r, k // (len(embedding) // {parts}) as part, k % (len(embedding) // {parts}) as pos, floor(4096 * embedding[k + 1]::double)::bigint as x from (select *, unnest(range(len(embedding))) as k from same))",
        f"b0 as materialized (select part, r - 1 as entry, pos, x from p where r <= {entries})",
    ]
    for k in range(rounds + 1):
        sql.append(f"d{k} as (select p.r, part, entry, sum((p.x - b.x) * (p.x - b.x)) as d from p join b{k} as b using (part, pos) group by all)")
        sql.append(f"a{k} as materialized (select r, part, min(struct_pack(d := d, entry := entry)) as best from d{k} group by all)")
        sql.append(f"s{k} as (select part, best.entry as entry, pos, sum(x) as s, count(*) as n from a{k} join p using (r, part) group by all)")
        sql.append(f"b{k + 1} as materialized (select part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, x)::bigint as x from b{k} left join s{k} using (part, entry, pos))")
    sql.append(f"c as (select r, string_agg(printf('%02x', best.entry), '' order by part) as code, sum(best.d)::bigint as error from a{rounds} group by r)")
    books = f"(select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) from b{rounds})"
    return f"with {', '.join(sql)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, {books} as codebooks_sha256 from same join c using (r)"


#: For the registry; rows of one length that divides by the parts.
CODES_SQL = _oracle()
