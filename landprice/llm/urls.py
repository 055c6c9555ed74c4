"""URL filter: rules, and for other URLs the ratio of two character language models.

URLs that a rule accepts or rejects teach two variable-order Markov models, smoothed from order
three down to none (Witten-Bell). A URL's score is the difference of its log-likelihoods
divided by its length; it is held against the point where the scores of the taught classes,
each taken as a normal law, part in equal units of spread. DataFrame functions only.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule;
null counts as empty text for the models; of rules of one length the first listed wins; if a
class was not taught or all scores are equal, the method allows; a repeated row gives a
repeated row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landprice.session import materialised

#: Characters of context at most.
ORDER = 3
_CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, if the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the filter query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What is between ``://`` and the path, lower-cased, and the path without query."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (
        lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits, else null. The rules are a short list."""
    fits = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda x: len(x.name)):
        here = (host == rule.host) | host.endswith("." + rule.host)
        fits = F.when(here & path.startswith(rule.path), F.lit(value(rule))).otherwise(fits)
    return fits


def _grams(text: Column) -> Column:
    """Each character with the three before it; the text is padded, its end is a character.

    Taken from chunks, so that a long text is not searched from its start for each of them.
    """
    padded = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor(F.length(text) / _CHUNK).cast("int")),
        lambda i: F.substr(padded, i * _CHUNK + 1, F.lit(_CHUNK + ORDER)),
    )
    return F.flatten(
        F.transform(
            chunks,
            lambda part: F.transform(
                F.filter(F.sequence(F.lit(1), F.lit(_CHUNK)), lambda i: i <= F.length(part) - ORDER),
                lambda i: F.substr(part, i, F.lit(ORDER + 1)),
            ),
        )
    )


def _smoothed(grams: DataFrame) -> DataFrame:
    """``gram`` and ``ratio``, the log of its probabilities' ratio under the two models."""
    lower = None
    for order in range(ORDER + 1):
        own = grams.groupBy(F.right("gram", F.lit(order + 1)).alias("gram")).agg(
            F.sum("allowed").alias("a"), F.sum("blocked").alias("b")
        )
        own = own.withColumn("context", F.left("gram", F.lit(order)))
        seen = own.groupBy("context").agg(
            F.sum("a").alias("a_all"), F.sum("b").alias("b_all"),
            F.count_if(F.col("a") > 0).alias("a_kinds"), F.count_if(F.col("b") > 0).alias("b_kinds"),
            F.count("*").alias("kinds"),
        )
        joined = own.join(seen, "context")
        if lower is None:
            joined = joined.withColumns({x: 1 / (F.col("kinds") + 1) for x in ("a_low", "b_low")})
        else:
            lower = lower.select(
                F.col("gram").alias("tail"), F.col("p_a").alias("a_low"), F.col("p_b").alias("b_low")
            )
            joined = joined.join(lower, F.right(joined["gram"], F.lit(order)) == lower["tail"])
        lower = joined.select(
            "gram",
            *(
                F.when(
                    F.col(f"{x}_all") > 0,
                    (F.col(x) + F.col(f"{x}_kinds") * F.col(f"{x}_low"))
                    / (F.col(f"{x}_all") + F.col(f"{x}_kinds")),
                ).otherwise(F.col(f"{x}_low")).alias(f"p_{x}")
                for x in "ab"
            ),
        )
    return lower.select("gram", F.log(F.col("p_a") / F.col("p_b")).alias("ratio"))


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url: str = "url"
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of each row."""
    named = pages.select(
        pages[id_column].alias("page_id"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url")
    )
    host, path = host_and_path(F.col("url"))
    # Equal URLs are judged once; copies of a page only count.
    distinct = named.groupBy("url").agg(F.count("*").alias("pages"))
    distinct = distinct.withColumns({"host": host, "path": path})
    distinct = distinct.withColumns({
        "rule": fitting_rule(F.col("host"), F.col("path"), rules, lambda x: x.name),
        "said": fitting_rule(F.col("host"), F.col("path"), rules, lambda x: x.verdict),
    })
    distinct = materialised(distinct, "urls")
    taught = {
        name: F.when(F.col("said") == verdict, F.col("pages")).otherwise(0)
        for name, verdict in (("allowed", "allow"), ("blocked", "block"))
    }
    each = distinct.select("url", "pages", "said", F.explode(_grams(lower_ascii(F.col("url")))).alias("gram"))
    grams = each.groupBy("gram").agg(*(F.sum(x).alias(name) for name, x in taught.items()))
    model = _smoothed(materialised(grams, "grams"))
    scored = (
        each.select("url", "gram").join(model, "gram")
        .groupBy("url").agg((F.sum("ratio") / F.count("*")).alias("score"))
    )
    scored = materialised(distinct.join(scored, "url"), "judged")

    spread = scored.filter("said is not null").groupBy("said").agg(
        F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("score")).alias("s"),
        F.sum(F.col("pages") * F.col("score") * F.col("score")).alias("ss"),
    ).collect()  # two rows
    limit = boundary({x["said"]: (x["n"], x["s"], x["ss"]) for x in spread})
    method = F.when(F.col("score") >= limit, "allow").otherwise("block") if limit is not None else F.lit("allow")
    verdicts = scored.select(
        "url", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score"
    )
    return named.join(verdicts, "url").select(
        "page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score")
    )


def boundary(sums: dict[str, tuple[float, float, float]]) -> float | None:
    """The score as many standard deviations from one class's mean as from the other's."""
    if set(sums) != {"allow", "block"}:
        return None
    means, widths = {}, {}
    for name, (n, s, ss) in sums.items():
        means[name] = s / n
        widths[name] = max(0.0, ss / n - means[name] ** 2) ** 0.5
    total = sum(widths.values())
    if not total:
        return (means["allow"] + means["block"]) / 2 if means["allow"] != means["block"] else None
    return (means["allow"] * widths["block"] + means["block"] * widths["allow"]) / total


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same judgement as DuckDB SQL over ``pages``."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase

    def chosen(value) -> str:
        def when(rest: str, rule: Rule) -> str:
            return (
                f"CASE WHEN (host = '{rule.host}' OR ends_with(host, '.{rule.host}')) "
                f"AND starts_with(path, '{rule.path}') THEN '{value(rule)}' ELSE {rest} END"
            )

        return reduce(when, sorted(reversed(rules), key=lambda x: len(x.name)), "CAST(NULL AS VARCHAR)")

    levels = []
    for k in range(ORDER + 1):
        low_a, low_b, join = "1.0 / (c.kinds + 1)", "1.0 / (c.kinds + 1)", ""
        if k:
            low_a, low_b = "l.p_a", "l.p_b"
            join = f"JOIN p{k - 1} l ON l.gram = right(o.gram, {k})"
        sides = ", ".join(
            f"CASE WHEN c.{x}_all > 0 THEN (o.{x} + c.{x}_kinds * {low}) / (c.{x}_all + c.{x}_kinds) "
            f"ELSE {low} END AS p_{x}"
            for x, low in (("a", low_a), ("b", low_b))
        )
        levels.append(f"""
o{k} AS (SELECT right(gram, {k + 1}) AS gram, sum(allowed) AS a, sum(blocked) AS b FROM grams GROUP BY 1),
c{k} AS (SELECT left(gram, {k}) AS context, sum(a) AS a_all, sum(b) AS b_all,
    count(*) FILTER (a > 0) AS a_kinds, count(*) FILTER (b > 0) AS b_kinds, count(*) AS kinds
    FROM o{k} GROUP BY 1),
p{k} AS (SELECT o.gram, {sides} FROM o{k} o JOIN c{k} c ON c.context = left(o.gram, {k}) {join})""")
    return f"""
WITH rests AS (
    SELECT page_id, coalesce(url, '') AS url,
           CASE WHEN position('://' IN url) > 0
                THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
), ruled AS (
    SELECT *, {chosen(lambda x: x.name)} AS rule, {chosen(lambda x: x.verdict)} AS said FROM parts
), padded AS (
    SELECT *, repeat(chr(2), {ORDER}) || translate(url, '{upper}', '{lower}') || chr(3) AS padded
    FROM ruled
), pieces AS (
    SELECT page_id, said, substring(padded, i, {ORDER + 1}) AS gram
    FROM (SELECT page_id, said, padded, unnest(range(1, length(padded) - {ORDER} + 1)) AS i FROM padded)
), grams AS (
    SELECT gram, count(*) FILTER (said = 'allow') AS allowed,
           count(*) FILTER (said = 'block') AS blocked
    FROM pieces GROUP BY gram
), {",".join(levels)}
, scored AS (
    SELECT page_id, sum(ln(p_a / p_b)) / count(*) AS score
    FROM pieces JOIN p{ORDER} USING (gram) GROUP BY page_id
), spread AS (
    SELECT avg(score) FILTER (said = 'allow') AS ma, avg(score) FILTER (said = 'block') AS mb,
           stddev_pop(score) FILTER (said = 'allow') AS sa,
           stddev_pop(score) FILTER (said = 'block') AS sb
    FROM ruled JOIN scored USING (page_id)
), bound AS (
    SELECT CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb)
                WHEN ma <> mb THEN (ma + mb) / 2 END AS least FROM spread
)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN least IS NULL OR score >= least THEN 'allow' ELSE 'block' END) AS verdict,
       round(score, 6) AS score
FROM ruled JOIN scored USING (page_id), bound
"""
