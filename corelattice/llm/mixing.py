"""Mixing sources to target weights: Sainte-Lague apportionment of token blocks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelattice.operators.current import plain_text
from corelattice.plans.lineage import written
from corelattice.plans.sizes import broadcast_if_small

BLOCK = 1024  # tokens of one block
SHARD_ROWS = 20_000  # items of a shard, about
SHARDS_ON_DRIVER = 1024  # shards of all sources whose quotas the driver works out


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 j + 1), no party beyond its cap.

    Ties go to the earlier party.  If the caps hold fewer seats than there are,
    all caps are filled.  The quotient of the last seat is found by bisection, so
    the work does not grow with the number of seats.
    """
    live = [i for i, (w, c) in enumerate(zip(weights, caps)) if w > 0 and c > 0]
    out = [0] * len(weights)
    if sum(caps[i] for i in live) <= seats:
        for i in live:
            out[i] = caps[i]
        return out
    if seats <= 0 or not live:
        return out

    def at(t: float) -> list[int]:  # seats with a quotient above t
        return [min(caps[i], max(0, math.ceil((weights[i] / t - 1) / 2))) for i in live]

    low, high = 0.0, max(weights[i] for i in live)
    while True:  # at(high) <= seats, at(low) > seats
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    got = at(high)
    for n, i in enumerate(live):
        out[i] = got[n]
    rest = seats - sum(got)
    order = sorted((i for i in live if out[i] < caps[i]), key=lambda i: (-weights[i] / (2 * out[i] + 1), i))
    for i in order[:rest]:
        out[i] += 1
    return out


def mix(items: DataFrame, targets: DataFrame, key: str, source: str, size: str, seed: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The drawn items, and the report of each source.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``.  All tokens
    of ``items`` are the size of the mix.  The mix is cut into blocks of
    ``block`` tokens; blocks go to sources by Sainte-Lague, none beyond what its
    items give when each is used ``max_repeats`` times, and what such a source
    cannot fill goes to the others.  A source's blocks go to its shards (items
    dealt by hash) in the same way; beyond ``SHARDS_ON_DRIVER`` shards the shards
    of a source are in groups, and blocks go to groups first, then to the shards
    of each group.  In a shard whole passes are drawn first, then items in seeded
    order up to the quota; the item at the edge is drawn if half of it lies below
    the quota.

    Names of sources are compared without case and runs of blanks.  Items with a
    NULL or unknown source count for the size of the mix and are not drawn; a
    NULL size counts as 0 and an item of size 0 is not drawn.  Of a source listed
    twice in ``targets`` the one row with the greatest share counts.  NULL shares
    and repeats count as 0.

    Drawn: key, ``source``, ``size``, ``repeats``.  Report: ``source``,
    ``target_share``, ``max_repeats``, ``pages``, ``available`` (tokens),
    ``capacity`` (times repeats), ``wanted`` (share of all tokens), ``blocks``
    (its quota), ``uncapped`` (its quota if repeats had no bound), ``short``
    (whether its quota is held down by its repeats: it is at what its items give,
    which is less than its share), ``drawn`` (tokens), ``reached_share`` (of all
    drawn tokens).
    """
    spark = items.sparkSession
    own = items.select(F.col(key).alias("k"), plain_text(F.col(source)).alias("s"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("w"))
    goal = targets.select("source", plain_text(F.col("source")).alias("s"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).cast("long").alias("max_repeats"))
    goal = goal.where("s is not null").withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("target_share"), "source"))).where("r = 1").drop("r")
    own = written(own, "sizes")
    counted = own.groupBy("s").agg(F.count(F.lit(1)).alias("pages"), F.sum("w").alias("w")).collect()  # a row for each source
    total = sum(r.w for r in counted)
    goals = sorted(goal.collect(), key=lambda r: r.s)
    known = {r.s: r for r in counted}
    caps = [-(-known[g.s].w * g.max_repeats // block) if g.s in known else 0 for g in goals]
    shares = [g.target_share for g in goals]
    quota = sainte_lague(shares, total // block, caps)
    free = sainte_lague(shares, total // block, [total // block] * len(goals))
    # a quota at its cap; within the last block of the share the tokens decide
    short = [
        b >= c - 1 and (known[g.s].w if g.s in known else 0) * g.max_repeats < g.target_share * total
        for g, b, c in zip(goals, quota, caps)
    ]
    shards = max([1, *(-(-known[g.s].pages // SHARD_ROWS) for g in goals if g.s in known)])
    group = max(1, -(-shards // max(1, SHARDS_ON_DRIVER // max(1, len(goals)))))  # shards of a group

    named = spark.createDataFrame(
        [(g.s, g.source, float(g.target_share), g.max_repeats, b, f, t) for g, b, f, t in zip(goals, quota, free, short)],
        "s string, source string, target_share double, max_repeats long, blocks long, uncapped long, short boolean",
    )
    dealt = own.where("w > 0").join(F.broadcast(named.select("s", "source", "max_repeats")), "s").withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int"))
    sizes = dealt.groupBy("s", "max_repeats", "shard").agg(F.sum("w").alias("w")).withColumn("grp", F.floor(F.col("shard") / group).cast("int"))
    sizes = written(sizes, "shards")
    parts = sizes.groupBy("s", "grp").agg(F.sum("w").alias("w"), F.sum(F.ceil(F.col("w") * F.col("max_repeats") / block)).alias("most")).collect()  # SHARDS_ON_DRIVER at most, or one for each source
    rows = []
    for g, blocks, cap in zip(goals, quota, caps):
        mine = sorted((p for p in parts if p.s == g.s), key=lambda p: p.grp)
        share = [p.most for p in mine] if blocks == cap else sainte_lague([p.w for p in mine], blocks, [p.most for p in mine])  # a source at its cap gives all
        rows += [(g.s, p.grp, n) for p, n in zip(mine, share)]
    quotas = spark.createDataFrame(rows, "s string, grp int, blocks long")

    def split(t: pd.DataFrame) -> pd.DataFrame:  # the blocks of a group of shards
        t = t.sort_values("shard")
        most = [-(-w * r // block) for w, r in zip(t["w"], t["max_repeats"])]
        n = sainte_lague(t["w"].tolist(), int(t["blocks"].iloc[0]), most)
        want = [min(b * block, w * r) for b, w, r in zip(n, t["w"], t["max_repeats"])]
        return pd.DataFrame({"s": t["s"], "shard": t["shard"], "shard_w": t["w"], "want": want})

    quotas = sizes.join(F.broadcast(quotas), ["s", "grp"]).groupBy("s", "grp").applyInPandas(split, "s string, shard int, shard_w long, want long")
    quotas = broadcast_if_small(written(quotas, "quotas"))
    seeded = Window.partitionBy("s", "shard").orderBy(F.xxhash64(F.lit(seed), "k"), "k")
    drawn = dealt.join(quotas, ["s", "shard"]).withColumn("upto", F.sum("w").over(seeded.rowsBetween(Window.unboundedPreceding, 0)))
    passes = F.floor(F.col("want") / F.col("shard_w"))
    left = F.col("want") - passes * F.col("shard_w")
    more = F.when((F.col("upto") - F.col("w") / 2.0 <= left) & (passes < F.col("max_repeats")), 1).otherwise(0)
    drawn = drawn.withColumn("repeats", (passes + more).cast("long")).where("repeats > 0").select(F.col("k").alias(key), "s", "source", F.col("w").alias("size"), "repeats")

    got = drawn.groupBy("s").agg(F.sum(F.col("size") * F.col("repeats")).alias("drawn"))
    there = spark.createDataFrame([(r.s, r.pages, r.w) for r in counted if r.s is not None], "s string, pages long, available long")
    out = named.join(there, "s", "left").join(got, "s", "left")
    zero = F.lit(0).cast("long")
    out = out.select(
        "source", "target_share", "max_repeats", F.coalesce("pages", zero).alias("pages"), F.coalesce("available", zero).alias("available"),
        (F.coalesce("available", zero) * F.col("max_repeats")).alias("capacity"), (F.col("target_share") * F.lit(float(total))).alias("wanted"), "blocks", "uncapped", "short", F.coalesce("drawn", zero).alias("drawn"),
    )
    all_drawn = F.sum("drawn").over(Window.partitionBy())  # one row for each source
    return drawn.drop("s"), out.withColumn("reached_share", F.coalesce(F.col("drawn") / F.nullif(all_drawn, F.lit(0)), F.lit(0.0)))
