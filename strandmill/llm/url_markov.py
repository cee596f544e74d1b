"""URL filter: ratio of two smoothed variable-order Markov models over characters.

One model is learned from accepted and one from rejected URLs, both from URLs that the rule
list judges. A URL that no rule fits is judged by the difference of its log-likelihoods per
character, against a threshold calibrated on the judged URLs.

Only DataFrame functions are used. Characters are counted once per distinct URL and weighted
by its number of rows, so a hot URL or host is counted by partial aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import ascii_lower, materialise

PAD, END = "\x02", "\x03"
ALPHABET = 256
UNIT = 1_000_000  # log-ratios are summed as whole millionths, so that sums have one result
BROADCAST_GRAMS = 200_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty for null or without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equally long ones, a block rule wins.

    A rule ``host/path`` fits its host and every subdomain if the path starts with ``/path``.
    The list is part of the plan: a few hundred rules at most.
    """

    def fits(rule: str) -> Column:
        rule_host, slash, rest = rule.partition("/")
        return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)

    ordered = sorted(rules, key=lambda rule: (-len(rule[0]), rule[1] != "block", rule[0]))
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return tuple(
        reduce(lambda chosen, rule: chosen.when(fits(rule[0]), rule[k]), ordered[1:], F.when(fits(ordered[0][0]), ordered[0][k]))
        for k in (0, 1)
    )


def _grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character of ``u`` and its end, with the ``order`` characters before it."""
    padded = F.concat(F.lit(PAD * order), F.col("u"), F.lit(END))
    return urls.select(*keep, padded.alias("padded"), F.explode(F.sequence(F.lit(1), F.length("u") + 1)).alias("i")).select(
        *keep,
        F.substring("padded", F.col("i"), F.lit(order)).alias("ctx"),
        F.substring("padded", F.col("i") + order, F.lit(1)).alias("ch"),
    )


def gram_ratios(urls: DataFrame, order: int) -> DataFrame:
    """(ctx, ch, ratio): log10 P(ch|ctx) of the accepted less that of the rejected, in units.

    ``urls`` has (u, n_allow, n_block) per distinct URL. P interpolates every order from
    ``order`` to 0 with Witten-Bell weights: (count + kinds * P of the shorter context) /
    (total + kinds), and ends in the uniform distribution over 256 symbols. A context that
    a model has not seen passes the shorter context's probability on.
    """
    counted = materialise(
        _grams(urls, order, "n_allow", "n_block")
        .groupBy("ctx", "ch")
        .agg(F.sum("n_allow").alias("allow"), F.sum("n_block").alias("block")),
        "url-grams",
    )
    shorter = None
    for length in range(order + 1):
        level = (
            counted.groupBy(F.substring("ctx", order - length + 1, length).alias("ctx"), "ch").agg(
                F.sum("allow").alias("allow"), F.sum("block").alias("block")
            )
            if length < order
            else counted
        )
        stats = level.groupBy("ctx").agg(
            *(F.sum(k).alias(f"{k}_all") for k in ("allow", "block")),
            *(F.sum(F.when(F.col(k) > 0, 1).otherwise(0)).alias(f"{k}_kinds") for k in ("allow", "block")),
        )
        level = level.join(stats, "ctx")
        if shorter is None:
            level = level.withColumns({f"{k}_low": F.lit(1.0 / ALPHABET) for k in ("allow", "block")})
        else:
            level = level.withColumn("tail", F.expr("substring(ctx, 2)")).join(
                shorter.select(F.col("ctx").alias("tail"), "ch", F.col("allow_p").alias("allow_low"), F.col("block_p").alias("block_low")),
                ["tail", "ch"],
            )
        shorter = level.select(
            "ctx",
            "ch",
            *(
                F.when(
                    F.col(f"{k}_all") > 0,
                    (F.col(k) + F.col(f"{k}_kinds") * F.col(f"{k}_low")) / (F.col(f"{k}_all") + F.col(f"{k}_kinds")),
                )
                .otherwise(F.col(f"{k}_low"))
                .alias(f"{k}_p")
                for k in ("allow", "block")
            ),
        )
    ratio = F.round((F.log10("allow_p") - F.log10("block_p")) * UNIT).cast("long")
    return shorter.select("ctx", "ch", ratio.alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", order: int = 4) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, score.

    ``score`` is the log10-likelihood difference per character in units of 1e-6 (null where
    a rule decides). The threshold is halfway between the mean scores of the accepted and of the
    rejected URLs, each row counting once. Where no row is accepted or none is rejected, a URL without
    a rule is allowed, with a null score. Nulls: a null URL has an empty host and path and is
    judged as such; a null id is returned as null. Repeated rows are judged alike and all returned.
    An empty table gives an empty result. Other columns of ``pages`` are not read.
    """
    host, path = host_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "by_rule": verdict})
    urls = materialise(
        parsed.groupBy("host", "path")
        .agg(
            *(F.sum(F.when(F.col("by_rule") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("allow", "block")),
        )
        .withColumn("u", F.concat("host", "path")),
        "urls",
    )
    ratios = materialise(gram_ratios(urls, order), "url-ratios")
    if ratios.count() <= BROADCAST_GRAMS:
        ratios = F.broadcast(ratios)
    scored = materialise(
        _grams(urls, order, "host", "path", "u")
        .join(ratios, ["ctx", "ch"])
        .groupBy("host", "path")
        .agg((F.sum("ratio") / F.count("*")).alias("score"))
        .join(urls.select("host", "path", "n_allow", "n_block"), ["host", "path"]),
        "url-scores",
    )
    means = scored.agg(
        *(F.sum(F.col("score") * F.col(f"n_{k}")).alias(f"s_{k}") for k in ("allow", "block")),
        *(F.sum(f"n_{k}").alias(f"w_{k}") for k in ("allow", "block")),
    ).first()
    usable = bool(means["w_allow"]) and bool(means["w_block"])
    threshold = round(0.5 * (means["s_allow"] / means["w_allow"] + means["s_block"] / means["w_block"]), 3) if usable else None
    open_urls = scored.where((F.col("n_allow") == 0) & (F.col("n_block") == 0)).select("host", "path", F.round("score", 3).alias("score"))
    if not usable:
        open_urls = open_urls.withColumn("score", F.lit(None).cast("double"))
    judged = F.when(F.col("score") < F.lit(threshold), "block").otherwise("allow")
    return parsed.join(open_urls, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", judged).alias("verdict"), "score"
    )
