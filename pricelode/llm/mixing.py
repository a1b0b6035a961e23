"""Mixing sources to target weights, with DataFrame functions only.

Iterative proportional fitting rakes the token weights of the cells source x language x topic until their sums along
each of the three dimensions meet the targets.  A document of cell c is then kept with probability
p(c) = raked weight(c) / tokens(c), scaled so that the largest is 1: in expectation the sample's tokens have the raked
mix, and no larger sample has it without repeating documents.  A document's draw is a hash of its doc_id, so any run
keeps the same ones.

Targets are shares of a dimension's levels.  ``temper(alpha)`` takes them from the corpus, share ** alpha, made to sum
to one: 1 keeps the corpus's own mix, 0 gives every level the same.  A dict gives them outright; levels it does not
name share ``rest``.  Raking ends when every sum is within ``TOLERANCE`` of its target, or after ``SWEEPS`` (where cells
that are not there keep the targets from being met together).

The tables hold no topic, so by default a document's topic is its kind of writing by ``TOPICS``, which holds in any
language (topics by a language's own words would repeat the language marginal); any other column can be given.

Null source, lang or topic is a level of its own, ``(none)``; a null or wordless text has no tokens, does not count
and is kept.  Repeated rows are drawn alike; null doc_ids are drawn by their text alone.  An empty table gives an
empty result; other columns are ignored by ``weights`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.llm.common import documents, staged

SWEEPS = 30
TOLERANCE = 1e-9
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: Exponents of the three dimensions' shares.
TEMPER = {"source": 0.8, "lang": 0.8, "topic": 0.9}
#: Topics by what a text is written like, the first that holds: (topic, one of these strings is in the text).
TOPICS = (("table", (" | ",)), ("contact", ("@",)), ("legal", ("License", "license", "Copyright", "copyright")), ("marked", ("***", "%%%", "###", "!!")), ("question", ("?",)))
#: Sweeps in a job, after which convergence is tested.
SWEEPS_A_JOB = 5


def topic(text: Column) -> Column:
    """The topic of a text by ``TOPICS``; ``prose`` otherwise, ``(none)`` for null."""
    out = F.when(text.isNull(), F.lit(NONE))
    for name, parts in TOPICS:
        hit = text.contains(parts[0])
        for p in parts[1:]:
            hit = hit | text.contains(p)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("prose"))


def _level(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE))


def _described(docs: DataFrame, topic_of: Column | None) -> DataFrame:
    """``docs`` with every row's cell (__source, __lang, __topic), __tokens (words), and __draw in [0, 1)."""
    hashed = F.md5(F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.sha2("text", 256), F.lit("")), F.lit("mix")))
    return docs.withColumns({
        "__source": _level(F.col("source")),
        "__lang": _level(F.col("lang")),
        "__topic": _level(topic_of if topic_of is not None else topic(F.col("text"))),
        "__tokens": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"),
        "__draw": F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / F.lit(float(16**13)),
    })


def targets(cells: DataFrame, dimension: str, wanted: dict[str, float] | float, rest: float = 0.0) -> DataFrame:
    """(level, aim): tokens each level of a dimension shall have; ``wanted``: an exponent, or shares by level."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("t"))
    total = sums.agg(F.sum("t")).scalar()
    if isinstance(wanted, dict):
        named = F.lit(None).cast("double")
        for k, v in wanted.items():
            named = F.when(F.col(dimension) == k, F.lit(float(v))).otherwise(named)
        own = F.when(F.col("t") > 0, F.coalesce(named, F.lit(float(rest)) * F.col("t")))
    else:
        own = F.when(F.col("t") > 0, F.pow("t", F.lit(float(wanted))))
    aims = sums.select(dimension, F.coalesce(own, F.lit(0.0)).alias("own"))
    norm = aims.agg(F.sum("own")).scalar()
    return aims.select(dimension, F.when(norm > 0, F.col("own") / norm * total).otherwise(F.lit(0.0)).alias("aim"))


def rake(cells: DataFrame, wanted: dict[str, dict[str, float] | float], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with the raked ``weight``; the cells are few against the documents, but
    stay a table of their own all the way."""
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, w in wanted.items():
        now = now.join(targets(cells, d, w).withColumnRenamed("aim", f"aim_{d}"), d)
    now, columns = staged(now, "aims"), cells.columns
    for done in range(0, sweeps, SWEEPS_A_JOB):
        for _ in range(min(SWEEPS_A_JOB, sweeps - done)):
            off = F.lit(0.0)
            for d in wanted:
                now = now.withColumn("sum", F.sum("weight").over(Window.partitionBy(d)))
                now = now.withColumn(f"off_{d}", F.when(F.col("sum") > 0, F.col(f"aim_{d}") / F.col("sum")).otherwise(F.lit(1.0)))
                now = now.withColumn("weight", F.col("weight") * F.col(f"off_{d}"))
                off = F.greatest(off, F.abs(F.col(f"off_{d}") - 1))
            now = now.withColumn("off", off)
        now = staged(now, "raked")
        worst = now.filter("tokens > 0").agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return now.select(*columns, "weight")


def _factors(rows: DataFrame, wanted: dict[str, dict[str, float] | float] | None) -> DataFrame:
    """Per cell of ``rows``: raked over own tokens, and that scaled to 1 at most."""
    cells = staged(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    factor = rake(cells, wanted or TEMPER).select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).alias("factor"))
    largest = factor.agg(F.max("factor")).scalar()
    scaled = factor.select(*DIMENSIONS, "factor", F.round(F.col("factor") / largest, 6).alias("scaled"))
    return staged(scaled, "factors")


def weights(docs: DataFrame, wanted: dict[str, dict[str, float] | float] | None = None, topic_of: Column | None = None) -> DataFrame:
    """Every row's cell, tokens, relative ``weight`` (raked over own tokens), ``probability`` and whether it is kept."""
    names = (*DIMENSIONS, "tokens", "draw")
    rows = staged(_described(docs, topic_of).select("doc_id", *(F.col(f"__{k}").alias(k) for k in names)), "described")
    p = F.when(F.col("tokens") > 0, F.col("scaled")).otherwise(F.lit(1.0)).alias("probability")
    out = rows.join(_factors(rows, wanted), list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "tokens", F.round("factor", 6).alias("weight"), p, "draw")
    return out.withColumn("kept", F.col("draw") < F.col("probability")).drop("draw")


def mix(docs: DataFrame, wanted: dict[str, dict[str, float] | float] | None = None, topic_of: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the calibrated draw keeps."""
    keyed = _described(docs, topic_of)
    cells = keyed.select(*(F.col(f"__{k}").alias(k) for k in (*DIMENSIONS, "tokens"))).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    factors = _factors(cells, wanted)
    table = factors.select(*(F.col(d).alias(f"__{d}_of") for d in DIMENSIONS), F.col("scaled").alias("__scaled"))
    same = [keyed[f"__{d}"] == table[f"__{d}_of"] for d in DIMENSIONS]
    kept = (F.col("__tokens") == 0) | (F.col("__draw") < F.col("__scaled"))
    return keyed.join(table, same, "left").filter(kept).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(documents(spark, sf_dir))


def op1_sql(sweeps: int = 20) -> str:
    """The same in DuckDB's SQL, with a fixed number of sweeps (more than the tables need)."""
    case = " ".join("when " + " or ".join(f"contains(text, '{p}')" for p in parts) + f" then '{name}'" for name, parts in TOPICS)
    word = WORD.replace(r"\x20", " ")
    steps, last = [], "w0"
    for d in DIMENSIONS:
        steps.append(
            f"aim_{d} as materialized (select {d}, own / sum(own) over () * sum(t) over () as aim from"
            f" (select {d}, sum(tokens)::double as t, case when sum(tokens) > 0 then pow(sum(tokens)::double, {TEMPER[d]}) else 0 end as own from cells group by {d}))"
        )
    for i in range(sweeps * len(DIMENSIONS)):
        d, new = DIMENSIONS[i % len(DIMENSIONS)], f"w{i + 1}"
        steps.append(
            f"{new} as materialized (select source, lang, topic, tokens, case when s > 0 then weight * aim / s else weight end as weight"
            f" from (select *, sum(weight) over (partition by {d}) as s from {last}) join aim_{d} using ({d}))"
        )
        last = new
    return f"""
with docs as materialized (
  select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang,
    case when text is null then '{NONE}' {case} else 'prose' end as topic,
    coalesce(len(regexp_extract_all(text, '{word}')), 0)::bigint as tokens,
    ('0x' || substr(md5(concat_ws('#', coalesce(doc_id::varchar, sha256(text), ''), 'mix')), 1, 13))::bigint::double / {float(16**13)!r} as draw
  from documents),
cells as materialized (select source, lang, topic, sum(tokens)::bigint as tokens from docs group by all),
w0 as materialized (select *, tokens::double as weight from cells),
{", ".join(steps)},
f as materialized (select source, lang, topic, case when tokens > 0 then weight / tokens end as factor from {last}),
p as (select *, round(factor / max(factor) over (), 6) as scaled from f)
select doc_id, source, lang, topic, tokens, round(factor, 6) as weight,
  case when tokens > 0 then scaled else 1.0::double end as probability,
  draw < case when tokens > 0 then scaled else 1.0 end as kept
from docs join p using (source, lang, topic)"""
