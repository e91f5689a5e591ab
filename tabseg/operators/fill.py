"""Filling missing values from rows of the same group, parent group or time (problem 1).

Numeric fields follow a mixed-effects model: value = mean + parent effect + time effect + group effect +
error. Variance components come from moments of the grouped sums; parent and time effects are their shrunk (best linear
unbiased) predictions, fitted in turn until they no longer change. `predicted` adds the group's shrunk mean. What is filled in is the
robust form of that: with errors and group effects of Laplace's kind the most probable level of a group is the median of its
rows and of the expected value, which counts as sqrt(within / between) rows. So a group whose rows mostly hold one value gives that
value, and a group that says little is drawn to what parent and time make expect. Categories follow a multinomial model
with effects of parent and time, fitted by iterative proportional scaling to margins that are shrunk towards the overall shares; it serves as
the Dirichlet prior of the group's own counts, and the value of largest posterior share is filled in. An exact check follows: where more than half
of a group's stated rows hold one value and the model would fill in another, that value is taken.

All statistics are sums per key, pre-aggregated before any shuffle, so that a key which holds a third of
the rows costs no more than any other. Only the distinct values of a group pass through one task (in order, and on disk where they
are many), never its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabseg.session import broadcast_if_small, forget, gathered, join_nulls, letters_key, materialise

OUT = ["id", "field", "fill", "predicted", "filled", "level", "group_rows", "agreeing_rows", "agreed"]
#: Share of the error's deviation by which effects may still change, share of a margin by which it may still be missed, and most rounds of either.
STILL, FIT, ROUNDS = 1e-3, 2e-2, 5


def _stored(df: DataFrame) -> DataFrame:
    return gathered(materialise(df))


def _rows(df: DataFrame, id_col: str, value: Column, group: list[Column], parent: Column, time: Column) -> DataFrame:
    """id, v, g (null if any part of the group's key is null), p, t."""
    key = F.when(_all_set(group), F.concat_ws("\x1f", *[c.cast("string") for c in group]))
    return df.select(F.col(id_col).alias("id"), value.alias("v"), key.alias("g"), parent.alias("p"), time.alias("t"))


def _all_set(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull()
    return out


def _component(sums: DataFrame, key: str) -> dict:
    """Variance within and between the keys, from per-key n, s, ss (one-way analysis of variance)."""
    per = sums.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    r = per.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"),
        F.sum("ss").alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    n, k = r["n"] or 0, r["k"] or 0
    if n <= k or k < 2:
        return {"within": 1.0, "between": 0.0}
    within = max((r["ss"] - r["b"]) / (n - k), 1e-12)
    spread = n - r["nn"] / n
    between = max(((r["b"] - r["s"] ** 2 / n) - (k - 1) * within) / spread, 0.0) if spread > 0 else 0.0
    return {"within": within, "between": between}


def _effect(cells: DataFrame, key: str, other: DataFrame | None, other_key: str, mean: float, c: dict, name: str) -> DataFrame:
    """Shrunk effect per key, after the other effect is taken off."""
    if other is not None:
        cells = cells.join(other, other_key, "left").withColumn("s", F.col("s") - F.col("n") * F.coalesce(F.col(f"{other_key}_effect"), F.lit(0.0)))
    ratio = c["within"] / c["between"] if c["between"] > 0 else float("inf")
    return cells.where(F.col(key).isNotNull()).groupBy(key).agg(((F.sum("s") - F.sum("n") * F.lit(mean)) / (F.sum("n") + F.lit(ratio))).alias(name))


def fill_numeric(df: DataFrame, id_col: str, field: str, value: Column, group: list[Column], parent: Column, time: Column, decimals: int = 1) -> DataFrame:
    """One row per row of df whose value is null, with columns OUT; `fill` is text with `decimals` decimals.

    predicted is the model's mean; level names what it rests on: 'group', 'parent' (parent and time),
    'overall', or 'none' (no stated value anywhere: fill null, filled false). agreed: the value that more than half of the group's
    stated rows hold, else null. NaN must be made null by the caller. Null keys form no group. An empty table gives an empty result.
    """
    rows = _rows(df, id_col, value.cast("double"), group, parent, time)
    stated = rows.where(F.col("v").isNotNull())
    cells = _stored(stated.groupBy("p", "t").agg(F.count("*").cast("double").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss")))
    mean = cells.agg(F.sum("s") / F.sum("n")).first()[0]
    text = F.lit(None).cast("string")
    if mean is None:
        nothing = rows.where(F.col("v").isNull()).select("id", F.lit(field).alias("field"), text.alias("fill"), F.lit(None).cast("double").alias("predicted"))
        return nothing.withColumns({"filled": F.lit(False), "level": F.lit("none"), "group_rows": F.lit(0).cast("bigint"), "agreeing_rows": F.lit(0).cast("bigint"), "agreed": text})
    of_p, of_t = _component(cells, "p"), _component(cells, "t")
    p_effect, t_effect = _effects(cells, mean, of_p, of_t)
    expect = F.lit(mean) + F.coalesce(F.col("p_effect"), F.lit(0.0)) + F.coalesce(F.col("t_effect"), F.lit(0.0))
    rows = rows.join(broadcast_if_small(p_effect), "p", "left").join(broadcast_if_small(t_effect), "t", "left").withColumn("expect", expect)
    per_value = materialise(
        rows.where(F.col("v").isNotNull() & F.col("g").isNotNull()).withColumn("r", F.col("v") - F.col("expect"))
        .groupBy("g", "v").agg(F.count("*").alias("c"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    )
    sums = per_value.groupBy("g").agg(F.sum("c").cast("double").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    of_g = _component(sums, "g")
    ratio = of_g["within"] / of_g["between"] if of_g["between"] > 0 else float("inf")
    pull = F.lit(math.sqrt(ratio))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("v"))
    whole = F.sum("c").over(Window.partitionBy("g"))
    placed = per_value.withColumns({"upto": upto, "n": whole})
    # the median with the expected value among the rows is that value, held between two quantiles of the rows
    groups = placed.groupBy("g").agg(
        F.first("n").alias("n"), F.sum("s").alias("s"), F.max("c").alias("top"), F.min(F.when(2 * F.col("c") > F.col("n"), F.col("v"))).alias("most"),
        F.min(F.when(2 * F.col("upto") >= F.col("n") - pull, F.col("v"))).alias("low"), F.min(F.when(2 * F.col("upto") >= F.col("n") + pull, F.col("v"))).alias("high"), F.first(F.col("n") > pull).alias("holds"),
    )
    gaps = rows.where(F.col("v").isNull()).join(groups, "g", "left")
    known = F.col("n").isNotNull()
    predicted = F.col("expect") + F.when(known, F.col("s") / (F.col("n") + F.lit(ratio))).otherwise(0.0)
    level = F.when(known & F.col("holds"), F.least(F.greatest("expect", "low"), F.coalesce("high", F.lit(float("inf"))))).otherwise(F.col("expect"))
    return gaps.select(
        "id", F.lit(field).alias("field"), F.format_string(f"%.{decimals}f", F.coalesce("most", level)).alias("fill"), predicted.alias("predicted"),
        F.lit(True).alias("filled"), F.when(known, "group").when(F.col("p_effect").isNotNull() | F.col("t_effect").isNotNull(), "parent").otherwise("overall").alias("level"),
        F.coalesce(F.col("n"), F.lit(0)).alias("group_rows"), F.coalesce(F.col("top"), F.lit(0)).alias("agreeing_rows"), F.when(F.col("most").isNotNull(), F.format_string(f"%.{decimals}f", "most")).alias("agreed"),
    )


def _effects(cells: DataFrame, mean: float, of_p: dict, of_t: dict) -> tuple[DataFrame, DataFrame]:
    """(p, p_effect), (t, t_effect): fitted in turn until the parents' effects change by less than STILL of the error's deviation."""
    t_effect = _stored(_effect(cells, "t", None, "p", mean, of_t, "t_effect"))
    p_effect = None
    for _ in range(ROUNDS):
        new = _stored(_effect(cells, "p", t_effect, "t", mean, of_p, "p_effect"))
        moved = float("inf")
        if p_effect is not None:
            moved = new.join(p_effect.withColumnRenamed("p_effect", "was"), "p").agg(F.max(F.abs(F.col("p_effect") - F.col("was")))).first()[0] or 0.0
        newer = _stored(_effect(cells, "t", new, "p", mean, of_t, "t_effect"))
        forget(t_effect, p_effect)
        p_effect, t_effect = new, newer
        if moved < STILL * math.sqrt(of_p["within"]):
            break
    return p_effect, t_effect


def fill_category(df: DataFrame, id_col: str, field: str, value: Column, group: list[Column], parent: Column, time: Column) -> DataFrame:
    """As fill_numeric, for categories: `predicted` is the posterior share of the value filled in.

    The prior of a group are the multinomial model's shares for the gap's parent and time; its strength is the concentration that
    explains how often two rows of one group agree. Ties go to the first value in order of text.
    """
    rows = _rows(df, id_col, value.cast("string"), group, parent, time)
    per = materialise(rows.where(F.col("v").isNotNull()).groupBy("g", "p", "t", "v").agg(F.count("*").alias("c")))
    cells = _stored(per.groupBy("p", "t", "v").agg(F.sum("c").cast("double").alias("c")))
    overall = cells.groupBy("v").agg(F.sum("c").alias("c"))
    total = overall.agg(F.sum("c")).first()[0]
    gaps = rows.where(F.col("v").isNull()).drop("v")
    text = F.lit(None).cast("string")
    if total is None:
        nothing = gaps.select("id", F.lit(field).alias("field"), text.alias("fill"), F.lit(None).cast("double").alias("predicted"))
        return nothing.withColumns({"filled": F.lit(False), "level": F.lit("none"), "group_rows": F.lit(0).cast("bigint"), "agreeing_rows": F.lit(0).cast("bigint"), "agreed": text})
    share = _stored(overall.select("v", (F.col("c") / F.lit(float(total))).alias("all_share")))
    chance = share.agg(F.sum(F.col("all_share") * F.col("all_share"))).first()[0]
    prior = _multinomial(cells, share, chance)
    best = prior.groupBy("p", "t").agg(F.max_by("v", F.struct("prior", "v")).alias("best"), F.max("prior").alias("best_prior"))
    k = _concentration(per, "g", chance)
    counts = per.where(F.col("g").isNotNull()).groupBy("g", "v").agg(F.sum("c").alias("c"))
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n"))
    # what each group with gaps holds, weighed with the prior of the gap's parent and time
    asked = gaps.where(F.col("g").isNotNull()).groupBy("g", "p", "t").agg(F.count("*").alias("asked"))
    seen = asked.join(counts, "g").join(sizes, "g")
    seen = join_nulls(seen, prior, ["p", "t", "v"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    post = (F.col("c") + F.lit(k) * F.col("prior")) / (F.col("n") + F.lit(k))
    winner = seen.groupBy("g", "p", "t").agg(F.max("n").alias("n"), F.max("c").alias("top"), F.min_by("v", F.struct(-post, F.col("v"))).alias("v"), F.max(post).alias("post"), F.min(F.when(2 * F.col("c") > F.col("n"), F.col("v"))).alias("most"))
    found = join_nulls(gaps, winner, ["g", "p", "t"], "left")
    found = join_nulls(found, broadcast_if_small(best), ["p", "t"], "left")
    first = share.orderBy(F.desc("all_share"), "v").first()
    known, placed = F.col("n").isNotNull(), F.col("best").isNotNull()
    outside = F.lit(k) * F.col("best_prior") / (F.col("n") + F.lit(k))
    fill = F.when(known & placed & (outside > F.col("post")), F.col("best")).when(known, F.col("v")).when(placed, F.col("best")).otherwise(F.lit(first["v"]))
    sure = F.when(known, F.greatest("post", F.coalesce(outside, F.lit(0.0)))).when(placed, F.col("best_prior")).otherwise(F.lit(float(first["all_share"])))
    return found.select(
        "id", F.lit(field).alias("field"), F.coalesce("most", fill).alias("fill"), sure.alias("predicted"), F.lit(True).alias("filled"),
        F.when(known, "group").when(placed, "parent").otherwise("overall").alias("level"), F.coalesce(F.col("n"), F.lit(0)).alias("group_rows"), F.coalesce(F.col("top"), F.lit(0)).alias("agreeing_rows"), F.col("most").alias("agreed"),
    )


def _concentration(counts: DataFrame, key: str, chance: float) -> float:
    """From the rate at which two rows of one key agree; large where keys tell nothing."""
    by = counts.where(F.col(key).isNotNull()).groupBy(key, "v").agg(F.sum("c").cast("double").alias("c"))
    sizes = by.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    r = sizes.agg(F.sum("same").alias("same"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).first()
    if not r["pairs"]:
        return 1.0
    agree = r["same"] / r["pairs"]
    return min(max((1 - agree) / max(agree - chance, 1e-6), 1e-3), 1e6)


def _multinomial(cells: DataFrame, share: DataFrame, chance: float) -> DataFrame:
    """(p, t, v, prior): shares of the values by parent and time, over the values that the parent has.

    Log-linear effects of parent x value and time x value, fitted by scaling to one margin and the other in turn (the maximum likelihood of
    the multinomial model), until no share of a margin is missed by more than FIT. Margins are shrunk: each key's counts are joined by as many overall
    rows as its concentration says. A missing parent or time is a key of its own.
    """
    gone = "\x00"
    x = cells.select(F.coalesce(F.col("p").cast("string"), F.lit(gone)).alias("p"), F.coalesce(F.col("t").cast("string"), F.lit(gone)).alias("t"), "v", "c")
    small = broadcast_if_small(share)

    def margin(key: str, name: str) -> DataFrame:
        a = _concentration(x, key, chance)
        by, size = x.groupBy(key, "v").agg(F.sum("c").alias("c")), x.groupBy(key).agg(F.sum("c").alias("size"))
        return by.join(size, key).join(small, "v").select(key, "v", ((F.col("c") + a * F.col("all_share")) / (F.col("size") + a)).alias(name))

    by_p, by_t = _stored(margin("p", "p_share")), _stored(margin("t", "t_share"))
    places = x.groupBy("p", "t").agg(F.sum("c").alias("rows"))
    state = places.join(by_p, "p").join(by_t, ["t", "v"], "left").join(small, "v")
    state = state.withColumn("t_share", F.coalesce("t_share", "all_share"))
    state = _stored(state.select("p", "t", "v", "rows", "p_share", "t_share", (F.col("p_share") * F.col("t_share") / F.col("all_share")).alias("w")))
    for _ in range(ROUNDS):
        missed = 0.0
        for key in ("t", "p"):  # the parents' margins come last and hold exactly
            here = F.sum("w").over(Window.partitionBy("p", "t"))
            y = state.withColumn("said", F.col("w") / here)
            # shares that the model gives the key's values, against the wanted ones among the values that the key has here
            got = y.groupBy(key, "v").agg(F.sum(F.col("said") * F.col("rows")).alias("got"), F.first(f"{key}_share").alias("want"))
            whole = got.groupBy(key).agg(F.sum("got").alias("all_got"), F.sum("want").alias("all_want"))
            scale = got.join(whole, key).select(key, "v", ((F.col("want") / F.col("all_want")) / (F.col("got") / F.col("all_got"))).alias("scale"), F.abs(F.col("got") / F.col("all_got") - F.col("want") / F.col("all_want")).alias("off"))
            new = _stored(y.join(scale, [key, "v"]).select("p", "t", "v", "rows", "p_share", "t_share", (F.col("said") * F.col("scale")).alias("w"), "off"))
            missed = max(missed, new.agg(F.max("off")).first()[0] or 0.0)
            forget(state)
            state = new.drop("off")
            state._stored_at = new._stored_at
        if missed < FIT:
            break
    out = state.withColumn("prior", F.col("w") / F.sum("w").over(Window.partitionBy("p", "t")))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    back = [F.when(F.col(c) != gone, F.col(c)).cast(kinds[c]).alias(c) for c in ("p", "t")]
    return materialise(out.select(*back, "v", "prior"))


def stated_age(c: Column) -> Column:
    return F.when((c > 0) & (c <= 120), c)


def with_port(df: DataFrame, ports: DataFrame, column: str = "embarked", name: str = "port") -> DataFrame:
    """Adds the port code for which `column` stands (a code or a name of `ports`), null if for none."""
    either = ports.select(letters_key(F.col("port_code")).alias("__key"), "port_code").unionByName(ports.select(letters_key(F.col("port_name")).alias("__key"), "port_code"))
    known = either.where(F.col("__key") != "").groupBy("__key").agg(F.min("port_code").alias(name))
    return df.withColumn("__key", letters_key(F.col(column))).join(broadcast_if_small(known), "__key", "left").drop("__key")


def fill_titanic(titanic: DataFrame, ports: DataFrame) -> DataFrame:
    """Every gap in `age` and `embarked` of the passenger table, filled (columns OUT).

    age: group is the passenger, parent the voyage, time the day of boarding. embarked: group is the
    ticket (voyage_id, ticket_no), the rest as for age.
    """
    t = with_port(titanic.select("row_id", "passenger_id", "voyage_id", "ticket_no", "age", "embarked", F.to_date("boarded_at").alias("day")), ports)
    ages = fill_numeric(t, "row_id", "age", stated_age(F.col("age")), [F.col("passenger_id")], F.col("voyage_id"), F.col("day"))
    ports_ = fill_category(t, "row_id", "embarked", F.col("port"), [F.col("voyage_id"), F.col("ticket_no")], F.col("voyage_id"), F.col("day"))
    return ages.unionByName(ports_)


def apply_fills(df: DataFrame, id_col: str, field: str, current: Column, fills: DataFrame, kind: str) -> DataFrame:
    """df with `field` completed from the fills, and `{field}_filled`, the mask of what was filled in."""
    f = fills.where((F.col("field") == field) & F.col("filled")).select(F.col("id").alias("__id"), F.col("fill").alias("__fill"))
    joined = df.join(f, df[id_col] == F.col("__id"), "left")
    return joined.withColumns({field: F.coalesce(current.cast(kind), F.col("__fill").cast(kind)), f"{field}_filled": F.col("__id").isNotNull()}).drop("__id", "__fill")
