"""Merkle manifest of a dataset: leaves in aligned buckets go through DuckDB level by level on the executors; Spark combines the
buckets' roots and joins the outer proofs."""

from __future__ import annotations

import math
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Nodes that make one of the next level, and levels inside a bucket, which so has FAN**INNER leaves at most.
FAN, INNER = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:`, the value."""
    v = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*columns), 256)


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with idx (from 0, in ascending order within the group) and n (rows of the group); group isn't null.

    Ranges of (group, order, row) are dealt out and sorted, so that neither a hot group nor equal rows meet in one task. Only
    the ranges' sizes, one row for each range and group in it, go through a window. Equal rows: in the order read."""
    by = [group, *order, "_row"]
    sorted_ = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = written(sorted_.drop("_row").withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), f"{name}-ranked")
    runs = placed.groupBy(group, "_part").agg(F.count("*").alias("_k"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_k").over(Window.partitionBy(group))
    runs = runs.select(group, "_part", "_first", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), total.alias("n"))
    return placed.join(runs, [group, "_part"]).withColumn("idx", F.col("_seq") - F.col("_first") + F.col("_before")).drop("_part", "_seq", "_first", "_before")


def paths(nodes: DataFrame, name: str) -> DataFrame:
    """nodes (g, idx, n, h), g not null, n the nodes of g: for each node (g, idx, top, before, after), the root of its tree
    and its siblings' digests to the left and right, put together, level by level from below.

    A level has an eighth of the rows of the one below; each is a table in the shared folder."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    levels, now = [], nodes
    roots = [now.where("n = 1").select("g", "idx", F.col("h").alias("top"), F.lit(0).alias("level"))]
    while most > 1:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"])  # eight at most
        up = now.where("n > 1").groupBy("g", F.expr(f"idx div {FAN}").alias("idx")).agg(F.first("n").alias("n"), kids.alias("kids"))
        up = up.select("g", "idx", F.ceil(F.col("n") / FAN).alias("n"), "kids", F.sha2(F.array_join("kids", ""), 256).alias("h"))
        levels.append(now := written(up, f"{name}-level"))
        roots.append(now.where("n = 1").select("g", "idx", F.col("h").alias("top"), F.lit(len(levels)).alias("level")))
        most = math.ceil(most / FAN)
    none = F.array().cast("array<string>")
    start = lambda k: roots[k].select("g", "idx", "top", none.alias("before"), none.alias("after"))
    found = start(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        down = levels[k].select("g", "idx", "kids").join(found, ["g", "idx"]).select("*", F.posexplode("kids").alias("pos", "_kid"))
        side = lambda a, b, c: F.concat(F.array(F.array_join(F.slice("kids", a, b), "")), c)
        down = down.select("g", (F.col("idx") * FAN + F.col("pos")).alias("idx"), "top", side(F.lit(1), F.col("pos"), F.col("before")).alias("before"), side(F.col("pos") + 2, F.lit(FAN), F.col("after")).alias("after"))
        found = down.unionByName(start(k))
    return found


def inner_levels(n: int, most: int = INNER) -> int:
    """Levels of a bucket of a group of n leaves: up to its root, or up to the bucket's where the group has more buckets."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // FAN), k + 1
    return k


class BlockEngine:
    """One DuckDB of a worker process: level queries over one bucket's leaves at a time (4096 rows at most, in memory)."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})

    def _run(self, sql: str, values=()) -> list[tuple]:
        """Runs to its end: a connection takes no other work before."""
        return self.db.execute(sql, list(values)).fetchall()

    def _level(self, k: int) -> None:
        """Level k + 1 from level k: kids, the digests of a run put together in order, and their own."""
        self._run(f"create or replace temp table l{k + 1} as select i, kids, sha256(kids) as h from (select i // {FAN} as i, string_agg(h, '' order by i) as kids from l{k} group by i // {FAN})")

    def root(self, leaves: pa.Table, levels: int) -> str:
        """leaves (idx, leaf)."""
        self.db.register("given", leaves)
        self._run(f"create or replace temp table l0 as select idx - min(idx) over () as i, leaf as h from given")
        for k in range(levels):
            self._level(k)
        self.db.unregister("given")
        return self._run(f"select h from l{levels}")[0][0]

    def proofs(self, leaves: pa.Table, levels: int, before: list[str], after: list[str], root: str) -> pa.Table:
        """leaves (idx, leaf, changed) with proof_sha256, folded_root and verified. before, after: what the levels above have."""
        self.root(leaves, levels)
        self.db.register("given", leaves)
        self._run(f"create or replace temp table f as select *, idx - min(idx) over () as i, coalesce(changed, leaf) as f, '' as proof from given")
        for k in range(levels):
            at = f"64 * (f.i // {FAN**k} % {FAN})"
            self._run(f"create or replace temp table f as select f.* replace (sha256(left(kids, {at}) || f.f || substr(kids, {at} + 65)) as f, proof || left(kids, {at}) || substr(kids, {at} + 65) as proof) from f join l{k + 1} as l on l.i = f.i // {FAN ** (k + 1)}")
        for a, b in zip(before, after):
            self._run("create or replace temp table f as select * replace (sha256(? || f || ?) as f, proof || ? || ? as proof) from f", [a, b, a, b])
        out = self.db.execute("select * exclude (i, f, proof), sha256(proof) as proof_sha256, f as folded_root, f = ? as verified from f order by i", [root]).to_arrow_table()
        self.db.unregister("given")
        return out


_engines: list[BlockEngine] = []


def engine() -> BlockEngine:
    """One for each worker process."""
    if not _engines:
        _engines.append(BlockEngine())
    return _engines[0]


def merkle_manifest(docs: DataFrame, inner: int = INNER) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of docs (doc_id, source, lang, n_chars, text); other
    columns are left alone.

    A leaf is the digest of a row's fields. Per lang, in the order of doc_id (null first, equal ones by leaf), eight nodes make
    one until one is left, the subroot; the subroots of all langs (null first) make the root in the same way. Only digests
    are shuffled: leaves are made where the rows are read. Rows whose crc32(doc_id) is divisible by 3 are folded from the leaf of
    a changed row (A-Z of the text in lower case), the others from their own. inner: levels inside a bucket. Repeated rows: a leaf each, alike but for their
    places. Null doc_id: not changed. Null in any field: a leaf of its own kind. Empty table: no rows."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaf = lambda text: digest(*[field(text if c == "text" else F.col(c)) for c in FIELDS])
    changed = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & (lower != F.col("text")), leaf(lower))
    # "-" for null is before "=" and whatever follows it
    g = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    leaves = written(docs.select(g.alias("g"), "doc_id", leaf(F.col("text")).alias("leaf"), changed.alias("changed")), "merkle-leaves")
    placed = written(ranked(leaves, "g", ["doc_id", "leaf"], "merkle").withColumn("bucket", F.expr(f"idx div {FAN**inner}")), "merkle-placed")

    def block_root(key, t):
        n = t.column("n")[0].as_py()
        h = engine().root(t.select(["idx", "leaf"]), inner_levels(n, inner))
        return pa.table({"g": [key[0].as_py()], "idx": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([max(1, -(-n // FAN**inner))], pa.int64()), "h": [h]})

    blocks = written(placed.select("g", "bucket", "idx", "n", "leaf").groupBy("g", "bucket").applyInArrow(block_root, "g string, idx long, n long, h string"), "merkle-blocks", narrow=True)
    within = written(paths(blocks, "merkle"), "merkle-blocks-up", narrow=True)
    subroots = within.where("idx = 0").select(F.col("g").alias("lang_"), F.col("top").alias("h"), F.lit("all").alias("g"))
    subroots = written(ranked(subroots, "g", ["lang_"], "merkle-subroots"), "merkle-subroots", narrow=True)
    top = paths(subroots.select("g", "idx", "n", "h"), "merkle-top").join(subroots, ["g", "idx"])
    top = top.select(F.col("lang_").alias("g"), F.col("h").alias("subroot"), F.col("top").alias("root"), F.col("before").alias("above_l"), F.col("after").alias("above_r"))
    outer = within.join(top, "g").select("g", F.col("idx").alias("bucket"), "subroot", "root", F.concat("before", "above_l").alias("before"), F.concat("after", "above_r").alias("after"))

    def block_proofs(left, right):
        o = right.to_pylist()[0]
        t = engine().proofs(left.select(["doc_id", "idx", "leaf", "changed"]), inner_levels(left.column("n")[0].as_py(), inner), o["before"], o["after"], o["root"])
        t = t.append_column("subroot", pa.array([o["subroot"]] * len(t), pa.string())).append_column("root", pa.array([o["root"]] * len(t), pa.string()))
        return t.select(["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    made = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return placed.groupBy("g", "bucket").cogroup(outer.groupBy("g", "bucket")).applyInArrow(block_proofs, made)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def _oracle(levels: int = 10) -> str:
    """The same in SQL: each level is a query, nodes that are alone stay as they are; for up to FAN**levels leaves of a group."""
    fields = lambda text: " || ".join(f"coalesce(strlen(({x})::varchar)::varchar || ':' || ({x})::varchar, '-')" for x in (*FIELDS[:-1], text))
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    # crc32, bit by bit: the reversed polynomial of the common checksum, a fixed value
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    octets = "list_transform(range(length(doc_id::varchar)), lambda k: ascii(substr(doc_id::varchar, k::bigint + 1, 1))::bigint)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: {byte}), 4294967295)"
    parts = [
        f"leaves as (select doc_id, coalesce('=' || lang, '-') as lang, sha256({fields('text')}) as leaf, case when {crc} % 3 = 0 then sha256({fields(lower)}) end as changed from documents)",
        "placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaves)",
    ]

    def tree(source: str, p: str) -> list[str]:
        """Tables of source (g, i, n, h): p, the top of each node; before and after of each level, put together with `,`."""
        out = [f"{p}0 as (select g, i, n, h from ({source}))"]
        for k in range(levels):
            out.append(f"{p}{k + 1}k as (select g, i // {FAN} as i, any_value(n) as m, string_agg(h, '' order by i) as kids from {p}{k} group by g, i // {FAN})")
            out.append(f"{p}{k + 1} as (select g, i, ceil(m / {FAN})::bigint as n, case when m = 1 then kids else sha256(kids) end as h, kids, m from {p}{k + 1}k)")
        return out

    def folded(own: str, p: str) -> str:
        """own (g, i, f, proof, ...) taken up through the levels of p."""
        for k in range(levels):
            at = f"64 * (t.i // {FAN**k} % {FAN})"
            cut = f"left(kids, {at})", f"substr(kids, {at} + 65)"
            own = f"(select t.* replace (case when m = 1 then f else sha256({cut[0]} || f || {cut[1]}) end as f, case when m = 1 then proof else proof || {cut[0]} || {cut[1]} end as proof) from {own} as t join {p}{k + 1} as l on l.g = t.g and l.i = t.i // {FAN ** (k + 1)})"
        return own

    parts += tree("select lang as g, i, n, leaf as h from placed", "a")
    parts.append(f"subs as (select g as lang, h as subroot, row_number() over (order by g) - 1 as i, count(*) over () as n from a{levels})")
    parts += tree("select 1 as g, i, n, subroot as h from subs", "b")
    inner = folded("(select lang as g, i, doc_id, leaf, coalesce(changed, leaf) as f, '' as proof from placed)", "a")
    parts.append(f"up as (select u.* exclude (g, i), s.subroot, 1 as g, s.i from {inner} as u join subs as s on s.lang = u.g)")
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from {folded('up', 'b')} as r cross join b{levels}"


#: For the registry.
MERKLE_SQL = _oracle()
