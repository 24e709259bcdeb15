"""Mixing sources to target weights: Sainte-Laguë quotas of blocks of one word, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import WORD, fresh, stored

#: Documents of a shard, on average.
SHARD_DOCS = 256


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, size) with the target of each source.

    Sources in code-point order, null last, take the weights in turn and share all sizes. A target stops at ``most`` times
    its source's size; the excess is shared by weight among the others until none is above. In closed form: ordered by
    size per weight, a source is capped if its cap is below its share of what the capped ones before it leave.
    The table has one row per source.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    own = sources.withColumn("_w", weigh).withColumn("_cap", F.col("size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = own.withColumn("_level", left / F.sum("_w").over(onwards))
    # once a source is below its cap, so are all after it: the level stays that of the first of them
    open_ = F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.col("_level"))
    reached = level.withColumn("_final", F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.least("_cap", F.col("_final") * F.col("_w")), "_cap")
    return reached.select("source", "size", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: each group's ``seats`` go one by one to the highest quotient votes / (2 * held + 1).

    The quotients that can matter are few. With n parties, the seats below round(share * (S - n) / S) are sure, those above
    round(share * (S + n) / S) + 1 are out, so that each party lists only its seats in between, about 2n a group in all.
    """
    whole = Window.partitionBy(*group)
    total, n = F.sum(votes).over(whole), F.count(F.lit(1)).over(whole)
    sized = parties.withColumn("_share", F.when(total > 0, F.col(votes).cast("double") * F.col(seats) / total).otherwise(0.0)).withColumn("_n", n)
    ratio = F.when(F.col(seats) > 0, F.col("_n") / F.col(seats)).otherwise(0.0)
    sized = sized.withColumn("_low", F.greatest(F.lit(0), F.round(F.col("_share") * (1 - ratio))).cast("long")).withColumn(
        "_high", (F.round(F.col("_share") * (1 + ratio)) + 1).cast("long")
    )
    spare = F.col(seats) - F.sum("_low").over(whole)
    listed = sized.withColumn("_spare", spare).withColumn("_seat", F.explode(F.sequence(F.col("_low"), F.col("_high"))))
    quotient = F.col(votes) / (2 * F.col("_seat") + 1)
    ranked = listed.withColumn("_rank", F.row_number().over(whole.orderBy(quotient.desc(), F.col(party), "_seat")))
    won = (F.col("_rank") <= F.col("_spare")) & (F.col(votes) > 0)
    keys = [*group, party]
    kept = [c for c in parties.columns if c not in keys]
    return ranked.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in kept], (F.first("_low") + F.sum(won.cast("long"))).alias("quota")
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, twin, size): the words of each whole text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", F.xxhash64("text").alias("twin"), size.alias("size"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7, sizes: DataFrame | None = None
) -> DataFrame:
    """(doc_id, source, twin, size, source_size, target, quota_words, taken): the words that the mix takes of each document.

    Documents of a source go by a seeded hash into shards of about ``SHARD_DOCS`` documents, in a seeded order; shards lie in
    nests, about as many as a nest has shards, so that no task lists all shards of a source. The blocks of
    a shard are its words: a block of one word is the only one that every shard and the smallest source resolve, and the
    quotas cost the same for any number of blocks. They are allotted by highest quotients, first to sources by their
    targets, then to a source's nests and in each to its shards by their words. A shard's quota is met by whole passes and, for the rest, by a
    seeded run of words on the ring of its words; since the order is seeded, a run is a random draw. A document takes the
    words that it shares with them, so none exceeds ``most`` times its size, rounded up.

    * null text: size 0, taken 0; * null source: a source of its own, last; * null doc_id: a document like others; * repeated
    rows: each is a document; * an empty table, or one without words: no quota, taken 0; * extra columns are ignored.
    """
    own = sizes if sizes is not None else stored(document_sizes(docs), "mix-sizes")
    spot = F.xxhash64(F.lit(seed), "doc_id")
    per_source = own.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    shards = F.ceil(F.col("docs") / SHARD_DOCS)
    nests = F.ceil(F.sqrt(shards)).cast("long")
    counts = per_source.select("source", nests.alias("nests"), F.ceil(shards / nests).cast("long").alias("shards"))
    targets = source_targets(per_source.select("source", "size"), weights, most)
    seats = F.round(F.sum("target").over(Window.partitionBy())).cast("long")
    named = targets.withColumn("all", F.lit(0)).withColumn("seats", seats).withColumn("name", F.struct(F.col("source").isNull().alias("none"), "source"))
    sources = sainte_lague(named, ["all"], "name", "target", "seats").select(
        F.col("name.source").alias("source"), F.col("size").alias("source_size"), "target", F.col("quota").alias("source_quota")
    )
    plan = stored(sources.join(counts, sources["source"].eqNullSafe(counts["source"])).select(sources["*"], "nests", "shards"), "mix-plan")
    # one row a source: Spark broadcasts the written table if its size allows, else splits the hot source
    dealt = own.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(plan["source"])).drop("s")
    hashed = F.xxhash64(F.lit(seed + 1), "doc_id")
    dealt = dealt.withColumn("nest", F.pmod(hashed, F.col("nests"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 3), "doc_id"), F.col("shards")))
    sized = dealt.groupBy("source", "nest", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    per_shard = stored(sized, "mix-shards")
    per_nest = per_shard.groupBy("source", "nest").agg(F.sum("words").alias("words"), F.first("source_quota").alias("source_quota"))
    nested = sainte_lague(per_nest, ["source"], "nest", "words", "source_quota").select(
        F.col("source").alias("n_source"), F.col("nest").alias("n_nest"), F.col("quota").alias("nest_quota")
    )
    shared = per_shard.join(nested, F.col("source").eqNullSafe(F.col("n_source")) & (F.col("nest") == F.col("n_nest")))
    quotas = sainte_lague(shared.select(*per_shard.columns, "nest_quota"), ["source", "nest"], "shard", "words", "nest_quota")
    quotas = quotas.withColumn("quota", F.least("quota", (F.col("words") * F.lit(most)).cast("long")))
    quotas = stored(
        quotas.select(
            F.col("source").alias("q_source"), F.col("nest").alias("q_nest"), F.col("shard").alias("q_shard"), F.col("words").alias("ring"),
            F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(0).cast("long").alias("passes"),
            F.when(F.col("words") > 0, F.col("quota") % F.col("words")).otherwise(0).alias("rest"),
            F.when(F.col("words") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source", "nest", "shard"), F.col("words"))).otherwise(0).alias("first"),
        ),
        "mix-quotas",
    )
    on = dealt["source"].eqNullSafe(quotas["q_source"]) & (dealt["nest"] == quotas["q_nest"]) & (dealt["shard"] == quotas["q_shard"])
    placed = dealt.join(quotas, on)
    order = Window.partitionBy("source", "nest", "shard").orderBy(spot, "doc_id", "size", "twin")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    low, high = F.col("first"), F.col("first") + F.col("rest")
    run = _overlap(low, F.least(high, F.col("ring"))) + _overlap(F.lit(0), high - F.col("ring"))
    taken = F.col("passes") * F.col("size") + run
    return placed.select(
        "doc_id", "source", "twin", "size", "source_size", "target", F.col("source_quota").alias("quota_words"), taken.alias("taken")
    )


def _overlap(low: Column, high: Column) -> Column:
    """Words of a document's stretch that lie from ``low`` up to ``high``."""
    return F.greatest(F.lit(0), F.least("end", high) - F.greatest("start", low)).cast("long")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as its words are taken, rounded to whole documents, half up.

    Rows that share doc_id, source and text are alike; the copies of one are dealt by the words that all of them take.
    """
    d, s, t, n, k, w = fresh(docs, "mix_doc_", "mix_source_", "mix_twin_", "mix_rows_", "mix_copy_", "mix_words_")
    mixed = mix_sources(docs.select("doc_id", "source", "text"), **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    rows = mixed.withColumn("copies", copies).groupBy("doc_id", "source", "twin").agg(F.sum("copies").alias("c"), F.count("*").alias("r")).where("c > 0")
    # equal rows meet as many joined rows as there are of them: each takes its part of the sum, rounded up
    rows = rows.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("twin").alias(t), F.ceil(F.col("c") / F.col("r")).cast("int").alias(n))
    own = docs.withColumn(w, F.xxhash64("text"))
    on = own["doc_id"].eqNullSafe(rows[d]) & own["source"].eqNullSafe(rows[s]) & (own[w] == rows[t])
    return own.join(rows, on).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
