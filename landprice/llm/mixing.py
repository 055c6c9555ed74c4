"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. Weights of these cells are raked to the target
share of each source, language and topic in turn; a cell is never asked for more tokens than it
has, and what a full cell cannot give the other cells of its group do. A group that holds less than
its target is asked for all it has, and the rest of the budget goes to the other groups in proportion
(``reachable``). A document is then kept with probability asked / present of its cell, decided by a
hash of its id, so the expected tokens are the budget and, where the margins can be met together,
those of each margin are the reachable target; ``margin_report`` states both. DataFrame functions only.

Defined results: a null source or language is a group of its own; null text has no tokens and
is kept with its cell's probability; a cell without tokens has probability 1, since it costs
nothing; rows repeated with one id are decided alike; a null id is decided like an empty one;
an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landprice.llm.batches import free_name
from landprice.session import materialised

#: Share of all tokens to keep.
BUDGET = 0.5
#: Target shares are present shares raised to this power: under 1 lifts small groups.
FLATTENING = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Rounds over the three margins.
SWEEPS = 8
#: Relative differences under this are rounding, not a cell with room or a group over its target.
ROUNDING = 1e-9
#: Topics by the first marker that a text holds, in this order; the rest is prose.
TOPICS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("legal", ("License", "Licensed under", "Copyright")),
    ("credentials", ("token = ",)),
    ("contact", ("@", "+1 (")),
    ("table", (" | ",)),
)
OTHER_TOPIC = "prose"
DIMENSIONS = ("source", "lang", "topic")
_SPACE = " \\t\\n\\x0B\\f\\r"


def topic_of(text: Column, topics: Sequence[tuple[str, tuple[str, ...]]] = TOPICS) -> Column:
    """A topic by fixed markers; byte search only."""
    out = F.lit(OTHER_TOPIC)
    for name, markers in reversed(topics):
        held = F.lit(False)
        for marker in markers:
            held = held | F.coalesce(text.contains(marker), F.lit(False))
        out = F.when(held, name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{_SPACE}]++")), F.lit(0)).cast("long")


def draw_of(identifier: Column) -> Column:
    """A number from 0 up to 1 by a hash of an id."""
    digits = F.substring(F.md5(F.coalesce(identifier.cast("string"), F.lit(""))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def _keys(df: DataFrame, text: str, topics) -> dict[str, Column]:
    return {
        "source": F.coalesce(df["source"].cast("string"), F.lit("")),
        "lang": F.coalesce(df["lang"].cast("string"), F.lit("")),
        "topic": topic_of(df[text], topics),
    }


def cells(slim: DataFrame) -> DataFrame:
    """Tokens of each source, language and topic; sums are combined before the shuffle."""
    return slim.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))


def flattened_targets(table: DataFrame, powers: dict[str, float] = FLATTENING) -> dict[str, DataFrame]:
    """Target shares of each dimension: present shares to a power, summing to one."""
    out = {}
    for name in DIMENSIONS:
        sums = table.groupBy(name).agg(F.sum("tokens").alias("n")).filter("n > 0")
        sums = sums.select(name, F.pow("n", F.lit(powers[name])).alias("part"))
        whole = sums.agg(F.sum("part")).first()[0] or 1.0
        out[name] = sums.select(name, (F.col("part") / whole).alias("target"))
    return out


def reachable(table: DataFrame, targets: DataFrame, name: str, budget: float = BUDGET) -> DataFrame:
    """``targets`` of one dimension cut at what its groups hold, the rest spread over the others.

    All groups that are not full get one multiple of their target. It only grows from round to
    round, and each round fills another group, so the rounds end; one number comes to the driver.
    """
    total = table.agg(F.sum("tokens")).first()[0] or 0
    held = table.groupBy(name).agg(F.sum("tokens").alias("n")).filter("n > 0")
    held = held.select(name, (F.col("n") / F.lit(float(budget * total or 1))).alias("most"))
    groups = materialised(held.join(targets, name), "margins")
    multiple, before = 1.0, 0
    while True:
        full = F.col("target") * F.lit(multiple) >= F.col("most")
        now = groups.agg(
            F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("target")))
        ).first()
        if now[0] == before or not now[2]:
            break
        before, multiple = now[0], (1 - now[1]) / now[2]
    return groups.select(name, F.least("most", F.col("target") * F.lit(multiple)).alias("target"))


def fitted(
    table: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, sweeps: int = SWEEPS
) -> DataFrame:
    """``table`` with ``probability``. Cells without a target in some dimension are not asked for.

    A cell's weight may exceed what it holds; it counts as full then and only the other cells of a
    group are scaled, so that a group's sum is its target. If the full cells alone exceed the target,
    all of the group are scaled down from what they hold. Margins are summed with map-side combine
    and joined back; the written rounds keep plans short and make a lost executor cost one round.
    """
    total = table.agg(F.sum("tokens")).first()[0] or 0
    asked = budget * total
    targets = {name: reachable(table, targets[name], name, budget) for name in DIMENSIONS}
    now = table.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    most = F.col("tokens") / F.lit(float(asked or 1))
    full = F.col("weight") >= most * F.lit(1 - ROUNDING)
    for sweep in range(sweeps):
        for name in DIMENSIONS:
            sums = now.groupBy(name).agg(
                F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)).alias("held"),
                F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("free"),
            )
            target = F.coalesce("target", F.lit(0.0))
            over = F.col("held") > target * F.lit(1 + ROUNDING)
            factors = sums.join(targets[name], name, "left").select(
                name,
                over.alias("over"),
                F.when(over, target / (F.col("held") + F.col("free")))
                .when(F.col("free") > 0, (target - F.col("held")) / F.col("free"))
                .otherwise(1.0).alias("factor"),
            )
            start = F.when(F.col("over"), F.least(most, F.col("weight"))).otherwise(F.col("weight"))
            now = now.join(factors, name).withColumn("weight", start * F.col("factor"))
            now = now.select(*DIMENSIONS, "tokens", "weight")
        now = materialised(now, "rake")
    share = F.when(F.col("tokens") > 0, F.col("weight") * asked / F.col("tokens")).otherwise(1.0)
    return now.select(*DIMENSIONS, "tokens", F.least(F.lit(1.0), share).alias("probability"))


def margin_report(
    table: DataFrame, chances: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET
) -> DataFrame:
    """Per dimension and group: shares of the budget that were wanted, could be had, and are expected."""
    total = table.agg(F.sum("tokens")).first()[0] or 0
    asked, out = F.lit(float(budget * total or 1)), None
    for name in DIMENSIONS:
        expected = chances.groupBy(name).agg(
            (F.sum(F.col("tokens") * F.col("probability")) / asked).alias("expected")
        )
        could = reachable(table, targets[name], name, budget).withColumnRenamed("target", "reachable")
        rows = targets[name].join(could, name).join(expected, name).select(
            F.lit(name).alias("dimension"), F.col(name).alias("group"),
            F.col("target").alias("wanted"), "reachable", "expected",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _slim(df: DataFrame, text: str, topics, id_column: str) -> DataFrame:
    rows = df.select(
        df[id_column].alias("doc_id"), *(x.alias(k) for k, x in _keys(df, text, topics).items()),
        token_count(df[text]).alias("n_tokens"),
    )
    return materialised(rows, "tokens")


def sample_report(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", topics=TOPICS, budget: float = BUDGET
) -> DataFrame:
    """Each row's cell, tokens and probability, and whether the sample holds it."""
    slim = _slim(df, text, topics, id_column)
    table = materialised(cells(slim), "cells")
    chances = materialised(fitted(table, flattened_targets(table), budget), "chances")
    return slim.join(chances.drop("tokens"), list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "n_tokens", F.round("probability", 6).alias("probability"),
        (draw_of(F.col("doc_id")) < F.col("probability")).alias("kept"),
    )


def sample(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", topics=TOPICS, budget: float = BUDGET
) -> DataFrame:
    """The sampled rows of ``df`` with its columns. The texts are read twice and not shuffled
    as long as the table of cells is under the session's broadcast threshold."""
    slim = _slim(df, text, topics, id_column)
    table = materialised(cells(slim), "cells")
    chances = fitted(table, flattened_targets(table), budget)
    names = {x: free_name(df, f"_mix_{x}") for x in (*DIMENSIONS, "probability")}
    chances = materialised(chances.select(*(F.col(x).alias(n) for x, n in names.items())), "chances")
    keys = _keys(df, text, topics)
    on = [keys[x] == chances[names[x]] for x in DIMENSIONS]
    kept = df.join(chances, on).filter(draw_of(df[id_column]) < chances[names["probability"]])
    return kept.select(*(df[x] for x in df.columns))


def oracle_sql(topics=TOPICS, budget: float = BUDGET, sweeps: int = SWEEPS) -> str:
    """The same sample as DuckDB SQL over ``documents``."""
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(text, '{m}')" for m in markers) + f" THEN '{name}'"
        for name, markers in topics
    )
    steps, before = [], "w0"
    for sweep in range(sweeps):
        for name in DIMENSIONS:
            now = f"w{sweep}_{name}"
            steps.append(f"""
{now} AS (SELECT * EXCLUDE (most, target, held, free, weight),
    CASE WHEN held > target * {1 + ROUNDING} THEN least(most, weight) * target / (held + free)
         WHEN free > 0 THEN weight * (target - held) / free ELSE weight END AS weight
    FROM (SELECT *, coalesce(sum(most) FILTER (weight >= most * {1 - ROUNDING}) OVER g, 0) AS held,
        coalesce(sum(weight) FILTER (weight < most * {1 - ROUNDING}) OVER g, 0) AS free
        FROM (SELECT {before}.*, tokens / (SELECT asked FROM totals) AS most,
              coalesce(target, 0) AS target FROM {before} LEFT JOIN t_{name} USING ({name}))
        WINDOW g AS (PARTITION BY {name})))""")
            before = now
    # Groups in the order in which they fill up; the first that does not sets the multiple.
    targets = ",".join(
        f"""
p_{name} AS (SELECT {name}, sum(tokens) / (SELECT asked FROM totals) AS most,
    pow(sum(tokens), {FLATTENING[name]}) / sum(pow(sum(tokens), {FLATTENING[name]})) OVER () AS part
    FROM cells GROUP BY {name} HAVING sum(tokens) > 0),
m_{name} AS (SELECT most / part AS fills,
    (1 - coalesce(sum(most) OVER b, 0)) / (sum(part) OVER r) AS multiple FROM p_{name}
    WINDOW b AS (ORDER BY most / part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           r AS (ORDER BY most / part ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t_{name} AS (SELECT {name}, least(most, part * (
    SELECT coalesce(min_by(multiple, fills) FILTER (multiple < fills), max(fills)) FROM m_{name}
    )) AS target FROM p_{name})"""
        for name in DIMENSIONS
    )
    return f"""
WITH slim AS (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
           CASE {cases} ELSE '{OTHER_TOPIC}' END AS topic,
           CAST(coalesce(len(regexp_extract_all(text, '[^{_SPACE}]+')), 0) AS BIGINT) AS n_tokens
    FROM documents
), cells AS (
    SELECT source, lang, topic, sum(n_tokens) AS tokens FROM slim GROUP BY ALL
), totals AS (SELECT sum(tokens) AS total, {budget} * sum(tokens) AS asked FROM cells),
{targets},
w0 AS (SELECT *, tokens / (SELECT total FROM totals) AS weight FROM cells),
{",".join(steps)},
chances AS (
    SELECT source, lang, topic, CASE WHEN tokens > 0
        THEN least(1.0, weight * (SELECT asked FROM totals) / tokens) ELSE 1.0 END AS chance
    FROM {before}
)
SELECT doc_id, source, lang, topic, n_tokens, round(chance, 6) AS probability,
       CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
           / 4294967296.0 < chance AS kept
FROM slim JOIN chances USING (source, lang, topic)
"""
