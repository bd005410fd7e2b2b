"""Homomorphic multiset fingerprints of documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, table

#: 8 lanes modulo 2**32 for equality, and 128 counters of 32 bits (2 to a long) for likeness.
LANES, FIELDS = 8, 32
_ONES = 0x0000000100000001
_LOW = (1 << FIELDS) - 1


def with_multiset(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: struct(lanes array<long>, counters array<long>, n long), the sums over the paragraphs of df's text.

    Lanes: each paragraph's (line's) SHA-256 as 8 numbers of 32 bits, summed modulo 2**32: equal multisets of
    paragraphs have equal sums, whatever their order, and a paragraph is put in or taken out by adding or subtracting
    its own vector. Counters: each clause of a paragraph (between line ends and marks) has a vector of 128 bits, summed;
    no text has 2**32 clauses. n counts clauses. Null: as the empty text. The hashes are columns of their own, so each is computed once.
    """
    d, *h = free_names(df, f"_{out}_digests", f"_{out}_h0", f"_{out}_h1")
    t = F.coalesce(F.col(text), F.lit(""))
    clauses = F.filter(F.split(t, r"[\n.,!?;:|]+\s*"), lambda x: x != "")
    df = df.withColumn(d, F.transform(F.split(t, "\n"), lambda p: F.sha2(p.cast("binary"), 256)))
    df = df.withColumn(h[0], F.transform(clauses, lambda x: F.xxhash64(x))).withColumn(h[1], F.transform(h[0], lambda x: F.xxhash64(x, F.lit(1))))
    zero = F.lit(0).cast("long")

    def lane(i: int) -> Column:
        return F.aggregate(d, zero, lambda a, x: (a + F.conv(F.substring(x, i * 8 + 1, 8), 16, 10).cast("long")).bitwiseAND(F.lit((1 << 32) - 1)))

    def counters(hashes: str, shift: int) -> Column:
        return F.aggregate(hashes, zero, lambda a, x: a + F.shiftright(x, shift).bitwiseAND(F.lit(_ONES)))

    lanes = F.array(*[lane(i) for i in range(LANES)])
    sums = F.array(*[counters(c, s) for c in h for s in range(32)])
    return df.withColumn(out, F.struct(lanes.alias("lanes"), sums.alias("counters"), F.size(h[0]).cast("long").alias("n"))).drop(d, *h)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's and b's paragraphs together; with sign -1, b's taken out of a's."""
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x + sign * y).bitwiseAND(F.lit((1 << 32) - 1)))
    # each field by itself, so that none carries into the next
    high = lambda x, y: F.shiftleft(F.shiftrightunsigned(x, FIELDS) + sign * F.shiftrightunsigned(y, FIELDS), FIELDS)
    low = lambda x, y: (x.bitwiseAND(F.lit(_LOW)) + sign * y.bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(_LOW))
    counters = F.zip_with(a["counters"], b["counters"], lambda x, y: high(x, y).bitwiseOR(low(x, y)))
    return F.struct(lanes.alias("lanes"), counters.alias("counters"), (a["n"] + sign * b["n"]).alias("n"))


def as_text(m: Column) -> Column:
    """The fingerprint as hex: lanes, number of clauses, counters."""
    lanes = F.array_join(F.transform(m["lanes"], lambda x: F.lpad(F.hex(x), 8, "0")), "")
    counters = F.array_join(F.transform(m["counters"], lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.lower(F.concat(lanes, F.lit("-"), F.hex(m["n"]), F.lit("-"), counters))


def _signed(m: Column) -> Column:
    """The 128 sums of +1 and -1 that the counters stand for."""
    fields = F.flatten(F.transform(m["counters"], lambda x: F.array(x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, FIELDS))))
    return F.transform(fields, lambda c: (2 * c - m["n"]).cast("double"))


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """df with each name in pairs: the likeness (0 to 1) of the two fingerprint columns: the cosine of the counted
    vectors, an estimate of the share of clauses in common; equal fingerprints: 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    used = sorted({c for p in pairs.values() for c in p})
    sums = dict(zip(used, free_names(df, *[f"_s_{c}" for c in used])))
    squares = dict(zip(used, free_names(df, *[f"_q_{c}" for c in used])))
    df = df.select("*", *[_signed(F.col(c)).alias(sums[c]) for c in used])
    df = df.select("*", *[dot(sums[c], sums[c]).alias(squares[c]) for c in used])
    for name, (a, b) in pairs.items():
        size = F.sqrt(F.col(squares[a]) * F.col(squares[b]))
        df = df.withColumn(name, F.when(F.col(a) == F.col(b), 1.0).when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(sums[a], sums[b]) / size))).otherwise(0.0))
    return df.drop(*sums.values(), *squares.values())


def with_next(docs: DataFrame, columns: list[str], per_bucket: int = 4096, steps: int = 256) -> DataFrame:
    """docs with next: struct of `columns` of the following row in descending doc_id (ties by text; nulls last), after
    the last row that of the first. Ranges of doc_id are windows of their own: `steps` ranges of about as many rows each,
    from quantiles of the ids, so that ids far out don't empty the others; each of them cut evenly into ranges of about
    per_bucket rows. Each range gets the first row of the range below, looked up over one row for each range. Rows
    of equal ids stay together."""
    q = [k / steps for k in range(1, steps)]
    r = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"), F.percentile_approx("doc_id", q, 100 * steps).alias("q")).first()
    edges = sorted({x for x in [r.lo, *(r.q or []), r.hi] if x is not None}) or [0]
    within = max(1, -(-r.n // (per_bucket * steps)))
    marks = F.array(*[F.lit(x).cast("long") for x in edges])
    bucket, lead, rank, head_, for_ = free_names(docs, "_bucket", "_lead", "_rank", "_head", "_for")
    step = F.greatest(F.size(F.filter(marks, lambda x: x <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(marks, step).cast("double"), F.element_at(marks, F.least(step + 1, F.lit(len(edges)))).cast("double")
    part = F.least(F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * within), F.lit(within - 1))
    d = docs.withColumn(bucket, F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise((step - 1).cast("long") * within + F.greatest(part, F.lit(0)).cast("long")))
    tops = d.select(bucket).distinct()
    down = Window.orderBy(F.col(bucket).desc())  # one row a range: `steps` times the ranges in a step
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.withColumn(for_, F.coalesce(F.lag(bucket).over(down), F.last(bucket).over(everything)))
    w = Window.partitionBy(bucket).orderBy(F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")).desc())
    d = d.withColumn(lead, F.lead(F.struct(*columns)).over(w)).withColumn(rank, F.row_number().over(w))
    # the ranges' first rows come from the same shuffle as the rest
    head = d.where(F.col(rank) == 1).select(bucket, F.struct(*columns).alias(head_)).join(tops, bucket).select(F.col(for_).alias(bucket), head_)
    return d.join(head, bucket, "left").withColumn("next", F.coalesce(lead, head_)).drop(bucket, lead, head_, rank)


def op5_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(with_multiset(docs, "text", "own"), ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.col("next.text"), F.lit(1), half)))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "edited", "own", F.col("next.own").alias("following"))
    d = with_multiset(d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "changed")
    d = with_likeness(d, {"near_edited": ("own", "changed"), "near_next": ("own", "following")})
    return d.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next")
