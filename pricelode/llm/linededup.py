"""Line dedup: lines whose key is in several documents stay only in the document with the least doc_id, with DataFrame
functions only.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case; keys shorter than ``LEAST``
code points are never dropped.  What moves is a row of numbers for each line: two 64-bit hashes of its key, the document
(doc_id and a hash of its text), and its position.  These rows are dealt by ranges of the hashes and sorted by document and
position in each; the first row of a key says where it stays, and the others, of other documents, are dropped.  The
dropped positions of a document come back as a compressed bitmap of the lines to keep, runs as (start, length) and where the
last run starts; texts are not moved but to meet their bitmap.

A key that holds a large share of all lines would make one range.  Frequent-item sketches over slices of the hash space find such keys
(at most four a shuffle partition); their first documents come from a minimum that is combined before the shuffle, and are
broadcast, so their lines are decided where they are.  A key that a sketch misses has at most 3.5 / ``tracked`` of the lines
of its slice.  The sketches set only how rows are dealt, not the result.

Null text is as empty, one empty line.  Rows with one doc_id are one document; null doc_ids are one that comes
last (as does 2**63 - 1, which is taken for it).  Repeated rows each give their row.  Empty tables give an empty result; other columns are ignored.
Distinct keys with equal hashes (128 bits) would count as one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.llm.common import Scratch, documents, partitions

LEAST = 10
SPACE = " \t\n\x0b\x0c\r"
SLICES = 16
LAST = (1 << 63) - 1
HOT_A_PARTITION = 4


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z in lower case; whole-ASCII lines by the faster function."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), and the document's key ``d`` (doc_id, nulls last) and ``k`` (hash of its text)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("k"))


def lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """d, k, position and key hashes of each line whose key has ``least`` code points."""
    each = keyed(docs).select("d", "k", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("d", "k", "pos", line_key(F.col("line")).alias("key"))
    return each.filter(F.length("key") >= least).select("d", "k", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def hot_keys(rows: DataFrame) -> DataFrame:
    """h1 of keys that hold more than a quarter of a shuffle partition's share of all lines, by sketches."""
    parts = partitions(rows.sparkSession)
    tracked = min(8192, 1 << (max(256, HOT_A_PARTITION * parts) - 1).bit_length())
    top = F.expr(f"approx_top_k(h1, {tracked // 2}, {tracked})")
    sliced = rows.groupBy(F.shiftrightunsigned("h1", 64 - (SLICES - 1).bit_length()).alias("slice")).agg(F.count(F.lit(1)).alias("n"), top.alias("top"))
    found = sliced.select(F.sum("n").over(Window.partitionBy()).alias("all"), F.explode("top").alias("it"))  # a row for each slice
    return found.filter(F.col("it.count") * (HOT_A_PARTITION * parts) > F.col("all")).select(F.col("it.item").alias("h1"))


def dropped_lines(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """d, k, pos of the lines of ``rows`` whose key has an earlier document."""
    hot = scratch.staged(hot_keys(rows), "hot-keys")  # bounded by the number of partitions
    firsts = rows.join(F.broadcast(hot), "h1", "left_semi").groupBy("h1", "h2").agg(F.min("d").alias("first"))
    by_first = rows.join(F.broadcast(scratch.staged(firsts, "hot-firsts")), ["h1", "h2"])
    ranged = rows.join(F.broadcast(hot), "h1", "left_anti").repartitionByRange(partitions(rows.sparkSession), "h1", "h2")
    order = Window.partitionBy("h1", "h2").orderBy("d", "pos")
    by_range = ranged.withColumn("first", F.first("d").over(order))
    return by_first.select("d", "k", "pos", "first").union(by_range.select("d", "k", "pos", "first")).filter("d > first").select("d", "k", "pos")


def keep_bitmaps(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """d, k, n_dropped, ``runs`` (array of start and length of kept lines) and ``tail`` (start of the last run, which goes on to the
    end) of each document that loses a line."""
    rows = scratch.staged(lines(docs, least), "lines")
    each = dropped_lines(rows, scratch).groupBy("d", "k").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    begins = F.concat(F.array(F.lit(0)), F.transform("at", lambda p: p + 1))
    runs = F.zip_with(F.slice(begins, 1, F.size("at")), F.col("at"), lambda b, p: F.struct(b.alias("start"), (p - b).alias("length")))
    return each.select("d", "k", F.size("at").alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("runs"), (F.element_at("at", -1) + 1).alias("tail"))


def with_kept(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_runs (start+length, blank between), kept_text."""
    joined = keyed(docs).join(bitmaps, ["d", "k"], "left").withColumn("own", F.split("text", "\n"))
    n = F.size("own")
    tail = F.coalesce("tail", F.lit(0))
    none = F.array().cast("array<struct<start:int,length:int>>")
    last = F.when(tail < n, F.array(F.struct(tail.alias("start"), (n - tail).alias("length")))).otherwise(none)
    every = joined.withColumn("runs", F.concat(F.coalesce("runs", none), last))
    text = F.when(F.col("n_dropped").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("own", r["start"] + 1, r["length"]))), "\n"))
    shown = F.array_join(F.transform("runs", lambda r: F.concat_ws("+", r["start"].cast("string"), r["length"].cast("string"))), " ")
    return every.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), shown.alias("kept_runs"), text.alias("kept_text"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with Scratch(spark) as scratch:
        bitmaps = scratch.kept(keep_bitmaps(docs, scratch), "keep-bitmaps")
    return with_kept(docs, bitmaps).select("doc_id", "n_lines", "n_dropped", "kept_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_sql() -> str:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""with d as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
lines as materialized (select rid, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from d),
keys as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{upper}', '{lower}') as key from lines),
firsts as (select key, min(coalesce(doc_id, {LAST})) as first from keys where length(key) >= {LEAST} group by key),
flags as materialized (select rid, pos, line, coalesce(coalesce(doc_id, {LAST}) > first, false) as gone from keys left join firsts using (key)),
runs as (select rid, min(pos) as start, count(*) as n from (select rid, pos, pos - row_number() over (partition by rid order by pos) as grp from flags where not gone) group by rid, grp),
shown as (select rid, string_agg(start || '+' || n, ' ' order by start) as kept_runs from runs group by rid),
kept as (select rid, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from flags group by rid)
select doc_id, n_lines, n_dropped, coalesce(kept_runs, '') as kept_runs, sha256(kept) as kept_sha256 from kept join d using (rid) left join shown using (rid)"""
