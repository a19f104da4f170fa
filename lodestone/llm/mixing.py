"""Mixing documents to target weights by iterative proportional fitting (raking), in DataFrame operations only.

Token weights are summed per cell of source, language and topic. Raking scales the cells in turn to the target shares of each margin
until all three hold within a tolerance; the ratio of a cell's raked to its real weight, times one scale for all cells, is the chance with which each of
its documents is drawn. The scale is 1 over the largest ratio while the tokens kept then reach the budget; where a rare cell's ratio
would push them below it, the scale is the one that meets the budget, and cells whose chance would pass 1 are taken whole.
Draws come from a hash of the id, so they repeat exactly.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, fresh

MARGINS = ("source", "lang", "topic")
#: Sweeps before the margins are looked at, and again as many while one is farther from its target than TOLERANCE of all tokens; then a warning.
SWEEPS, MOST_SWEEPS, TOLERANCE = 12, 120, 1e-6
#: Natural shares are raised to this power and made to sum to 1: below 1 it lifts small sources and languages.
FLATTEN = 0.8
#: The token budget: at least this share of the tokens that can be drawn is kept, in expectation.
KEEP = 0.5
#: Up to so many cells raking runs in one task and the cells are broadcast; beyond that cells are joined to the sums of their margins, and
#: documents to their cells in SALT parts of each cell.
FEW_CELLS, SALT = 100_000, 16
OUT = ("mix_topic", "mix_tokens", "mix_weight", "mix_chance")


def topic_of(text: str = "text") -> Column:
    """A coarse topic from the text's form: tables, and prose by length."""
    size = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.when(F.contains(F.col(text), F.lit(" | ")), "table").when(size < 600, "short").when(size < 3000, "medium").otherwise("long")


def tokens_of(text: str = "text") -> Column:
    """Token weight of a text where no counts are given: a token for each four bytes, and one for its end."""
    return F.floor(F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) / F.lit(4)).cast("long") + 1


def _margin(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _few(cells: DataFrame, most: int) -> bool:
    return cells.limit(most + 1).count() <= most


def _margins(cells: DataFrame, *columns: str) -> DataFrame:
    """A row (margin, value, ...) for each margin of each cell, with the columns (name or name_margin) that are asked for."""
    named = lambda m, c: F.col(f"{c}_{m}" if f"{c}_{m}" in cells.columns else c).alias(c)
    return cells.select(F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(m).alias("value"), *(named(m, c) for c in columns)) for m in MARGINS))).alias("x")).select("x.*")


def _with_goals(cells: DataFrame, targets: dict[str, dict[str, float]] | None, flatten: dict[str, float], few: bool) -> DataFrame:
    """cells with goal_source, goal_lang and goal_topic; totals are three numbers, which go through the driver."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    shares = F.lit(None).cast("double")
    for m in MARGINS:
        share = F.pow(F.col("t") / F.lit(total), F.lit(flatten[m]))
        if targets and m in targets:
            share = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(targets[m].items()) for x in kv])[F.col("value")].cast("double"), F.lit(0.0))
        shares = F.when(F.col("margin") == m, share).otherwise(shares)
    values = cut(_margins(cells, "tokens").groupBy("margin", "value").agg(F.sum("tokens").alias("t")).withColumn("g", shares), "rake-values")
    sums = {r.margin: r.s for r in values.groupBy("margin").agg(F.sum("g").alias("s")).collect()}
    for m in MARGINS:
        goals = values.filter(F.col("margin") == m).select(F.col("value").alias(m), (F.col("g") / F.lit(sums.get(m, 1.0)) * F.lit(total)).alias(f"goal_{m}"))
        cells = cells.join(F.broadcast(goals) if few else goals, m)
    return cells


def _swept(cells: DataFrame, few: bool) -> DataFrame:
    """One sweep: the weights scaled to the goals of each margin in turn."""
    for m in MARGINS:
        if few:
            cells = cells.withColumn("now", F.sum("weight").over(Window.partitionBy(m)))
        else:
            cells = cells.join(cells.groupBy(m).agg(F.sum("weight").alias("now")), m)
        cells = cells.withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.col(f"goal_{m}") / F.col("now")).otherwise(F.lit(0.0))).drop("now")
    return cells


def _gap(cells: DataFrame, total: float) -> float:
    """How far the worst value of any margin is from its goal, as a share of all tokens."""
    sums = _margins(cells, "weight", "goal").groupBy("margin", "value").agg(F.abs(F.sum("weight") - F.first("goal")).alias("far"))
    return (sums.agg(F.max("far")).first()[0] or 0.0) / max(total, 1.0)


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, flatten: dict[str, float] | None = None, sweeps: int = SWEEPS, most_sweeps: int = MOST_SWEEPS, few_cells: int = FEW_CELLS) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: tokens raked to the target shares of all three margins, same total.

    targets gives shares per margin and value; values it does not name get weight 0. A margin without targets takes its natural
    shares to the power flatten[margin] (FLATTEN for source and lang, 1 for topic). Targets that no weights can meet end in a warning.
    """
    flatten = {"source": FLATTEN, "lang": FLATTEN, "topic": 1.0} | (flatten or {})
    few = _few(cells, few_cells)
    cells = cut(_with_goals(cells, targets, flatten, few).withColumn("weight", F.col("tokens").cast("double")), "rake-goals")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    done, steps = 0, 4 if few else 1
    while done < most_sweeps:
        for _ in range(min(steps, sweeps)):
            cells = _swept(cells.coalesce(1) if few else cells, few)
            done += 1
        cells = cut(cells, "rake")
        if done % sweeps == 0 and _gap(cells, total) <= TOLERANCE:
            break
    else:
        warnings.warn(f"a margin is still {_gap(cells, total):.2g} of all tokens from its target after {done} sweeps", stacklevel=2)
    return cells.drop(*(f"goal_{m}" for m in MARGINS))


def with_chances(weights: DataFrame, keep: float = KEEP) -> DataFrame:
    """weights (tokens, weight) with mix_weight and mix_chance = least(1, mix_weight * scale); cells of weight 0 are outside the budget.

    The scale is 1 over the largest ratio if that keeps enough. If not, it is the one at which the cells not taken whole, scaled, and those taken whole
    together meet the budget: as it rises more cells are taken whole, so it is found again until their number stays.
    """
    weights = weights.withColumn("mix_weight", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0)))
    live = weights.filter("mix_weight > 0")
    top, budget, total = live.agg(F.max("mix_weight"), F.lit(keep) * F.sum("tokens"), F.sum("weight")).first()
    if not top:
        return weights.withColumn("mix_chance", F.lit(0.0))
    scale, whole = 1 / top, 0
    if total * scale < budget:
        scale = budget / total
        while True:
            is_whole = F.col("mix_weight") * F.lit(scale) > 1
            n, taken, rest = live.agg(F.count_if(is_whole), F.sum(F.when(is_whole, F.col("tokens")).otherwise(F.lit(0))), F.sum(F.when(~is_whole, F.col("weight")))).first()
            if n == whole or not rest:
                break
            scale, whole = (budget - taken) / rest, n
    return weights.withColumn("mix_chance", F.least(F.col("mix_weight") * F.lit(scale), F.lit(1.0)))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, tokens: Column | None = None, sweeps: int = SWEEPS, flatten: dict[str, float] | None = None, keep: float = KEEP, few_cells: int = FEW_CELLS, most_sweeps: int = MOST_SWEEPS, extras: bool = True) -> DataFrame:
    """The drawn rows of docs with mix_topic, mix_tokens, mix_weight and mix_chance; other columns as they are.

    Columns of docs with one of these four names are replaced; without extras the result has the columns of docs, unchanged, and no others. A null source or language counts as the value '', a null text as the empty text.
    Where the id is null the text decides the draw; rows of equal id are drawn together. A very long text is drawn like any other, whole. An empty
    table gives no rows. Every row has a chance: sampling is what this operator does. The rows drawn hold, in expectation, the target
    shares, but for cells that the budget keep (a share of the tokens) makes it take whole: those hold less than their share, and no
    document is repeated.
    """
    names = [n for n in docs.columns if not extras or n.lower() not in OUT]
    own = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    x = fresh(names, "raking")
    keys = [f"{x}_{m}" for m in MARGINS]
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double")
    margins = [_margin("source"), _margin("lang"), F.coalesce(topic_of() if topic is None else topic, F.lit(""))]
    rows = docs.select(*own, *(c.alias(k) for c, k in zip(margins, keys)), (tokens_of() if tokens is None else tokens).alias(f"{x}_tokens"), draw.alias(f"{x}_draw"))
    cells = rows.groupBy(*(F.col(k).alias(m) for k, m in zip(keys, MARGINS))).agg(F.sum(f"{x}_tokens").alias("tokens"))
    cells = cut(cells, "mix-cells")
    weights = cut(with_chances(raked(cells, targets, flatten, sweeps, most_sweeps, few_cells), keep), "mix-weights")
    side = weights.select(*(F.col(m).alias(k) for m, k in zip(MARGINS, keys)), F.col("mix_weight").alias(f"{x}_weight"), F.col("mix_chance").alias(f"{x}_chance"))
    if _few(weights, few_cells):
        joined = rows.join(F.broadcast(side), keys)
    else:
        salt = f"{x}_salt"
        joined = rows.withColumn(salt, F.floor(F.col(f"{x}_draw") % SALT).cast("int")).join(side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*keys, salt])
    drawn = joined.filter((F.col(f"{x}_draw") + 0.5) / F.lit(4294967296.0) < F.col(f"{x}_chance"))
    return drawn.select(*own, *(F.col(f"{x}_{c}").alias(f"mix_{c}") for c in ("topic", "tokens", "weight", "chance") if extras))


def oracle(table: str = "documents", sweeps: int = SWEEPS) -> str:
    """DuckDB SQL for (doc_id, source, lang, topic, tokens, weight, chance) of the drawn rows, for the default targets and so many sweeps in all."""
    size = "strlen(coalesce(text, ''))"
    parts = [
        f"rows_ as (select doc_id, text, coalesce(source, '') as source, coalesce(lang, '') as lang, case when contains(text, ' | ') then 'table' when {size} < 600 then 'short' when {size} < 3000 then 'medium' else 'long' end as topic, {size} // 4 + 1 as tokens from {table})",
        "cells as (select source, lang, topic, sum(tokens)::double as tokens from rows_ group by all)",
        "total_ as (select sum(tokens) as total from cells)",
    ]
    for m in MARGINS:
        power = 1.0 if m == "topic" else FLATTEN
        parts.append(f"raw_{m} as (select {m}, pow(sum(tokens) / any_value(total), {power}) as g from cells, total_ group by {m})")
        parts.append(f"goal_{m} as (select {m}, g / (select sum(g) from raw_{m}) * total as goal from raw_{m}, total_)")
    parts.append("w0 as (select *, tokens as weight from cells)")
    at = 0
    for _ in range(sweeps):
        for m in MARGINS:
            parts.append(f"w{at + 1} as materialized (select w.* exclude (weight), weight * goal / sum(weight) over (partition by {m}) as weight from w{at} w join goal_{m} using ({m}))")
            at += 1
    parts.append(f"ratio as (select source, lang, topic, weight / tokens as r, weight / tokens / max(weight / tokens) over () as chance from w{at})")
    draw = "(('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 8))::ubigint::double + 0.5) / 4294967296.0"
    return "with " + ",\n".join(parts) + f"\nselect doc_id, source, lang, topic, tokens::bigint as tokens, round(r, 6) as weight, round(chance, 6) as chance from rows_ join ratio using (source, lang, topic) where {draw} < chance"
