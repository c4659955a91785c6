"""URL filter: allow and block rules, and a character language-model ratio for the urls that no rule decides.

Two variable-order Markov models are counted from urls that rules accept and reject. The chance of a character after
its context is that of the longest context seen, mixed with those of shorter ones by the number of characters that
followed each (Witten-Bell); so the order in use varies with the evidence. A url's score is the difference of the two
log-likelihoods divided by its length. The threshold is the one that best parts accepted from rejected urls of a fold
that the models have not counted.

Windows of characters are joined with counts as rows; nothing is gathered on the driver but a histogram of the fold.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from turnstile.llm.common import ascii_lower, written

#: Longest context in characters.
ORDER = 4
#: Every so many-th accepted or rejected url, by hash, is kept for the threshold.
FOLDS = 5
#: Chance of a character that no model has seen.
UNSEEN = 1 / 256
#: Scores are binned by hundredths of a nat, between these bounds, to find the threshold.
_BINS, _REACH = 100, 2000
_START = "\x02"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _windows(url: Column) -> Column:
    """For each character of a url, it and up to ORDER characters before it; start marks fill up the first ones."""
    chars = F.concat(F.array(*[F.lit(_START)] * ORDER), F.array_remove(F.split(ascii_lower(url), ""), ""))
    return F.transform(F.sequence(F.lit(1), F.size(chars) - ORDER), lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""))


def _merged(rows: DataFrame, others: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Both joined by sorting, at any size.

    Spark would judge by the size of compressed files and take a url's windows for about as large as the url, so it
    would broadcast rows by way of the driver that do not fit there.
    """
    return rows.join(others.hint("merge"), on, how)


def _suffixes(window: Column) -> Column:
    """The last 1, 2, ... ORDER + 1 characters of a window."""
    return F.array(*[F.struct(F.lit(k).alias("order"), F.right(window, F.lit(k + 1)).alias("gram")) for k in range(ORDER + 1)])


def _counts(urls: DataFrame) -> DataFrame:
    """How often each character followed each context in accepted and in rejected urls."""
    rows = urls.select("accepted", F.explode(_windows(F.col("url"))).alias("window"))
    windows = rows.groupBy("window").agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    grams = windows.select("good", "bad", F.explode(_suffixes(F.col("window"))).alias("s")).select("s.gram", "good", "bad")
    return grams.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def window_weights(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Log ratio of each distinct window, in millionths of a nat."""
    context = lambda gram: F.expr(f"substring({gram}, 1, length({gram}) - 1)")
    follow = counts.select(context("gram").alias("context"), "good", "bad").groupBy("context").agg(
        *(f(c).alias(f"{c}_{n}") for c in ("good", "bad") for n, f in (("sum", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0))))
    )
    rows = windows.select("window", F.explode(_suffixes(F.col("window"))).alias("s")).select("window", "s.order", "s.gram")
    rows = _merged(rows.withColumn("context", context("gram")), counts, "gram", "left")
    rows = _merged(rows, follow, "context", "left")
    names = ("good", "good_sum", "good_kinds", "bad", "bad_sum", "bad_kinds")
    flat = rows.groupBy("window").agg(*(F.coalesce(F.max(F.when(F.col("order") == k, F.col(n))), F.lit(0)).alias(f"{n}{k}") for k in range(ORDER + 1) for n in names))
    out = flat
    for c in ("good", "bad"):
        chance = F.lit(UNSEEN)
        for k in range(ORDER + 1):
            n, total, kinds = (F.col(f"{c}{x}{k}") for x in ("", "_sum", "_kinds"))
            out = out.withColumn(f"{c}_chance{k}", F.when(total > 0, (n + kinds * chance) / (total + kinds)).otherwise(chance))
            chance = F.col(f"{c}_chance{k}")
    ratio = F.log(F.col(f"good_chance{ORDER}")) - F.log(F.col(f"bad_chance{ORDER}"))
    return out.select("window", F.round(ratio * 1e6).cast("long").alias("weight"))


def scores(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(url, score) of distinct urls: weights summed over the characters, by length, in nats."""
    rows = urls.select("url", F.explode(_windows(F.col("url"))).alias("window"))
    weights = window_weights(rows.select("window").distinct(), counts)
    return _merged(rows, weights, "window").groupBy("url").agg((F.sum("weight") / F.count("*") / 1e6).alias("score"))


def threshold(marked: DataFrame) -> float:
    """The score that best parts `accepted` true from false: largest sum of both rates; the middle one of equals."""
    bins = {
        r["bin"]: (r["good"], r["bad"])
        for r in marked.groupBy(F.greatest(F.least(F.floor(F.col("score") * _BINS), F.lit(_REACH)), F.lit(-_REACH)).alias("bin"))
        .agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
        .collect()
    }
    goods, bads = (sum(v[i] for v in bins.values()) for i in (0, 1))
    if not goods or not bads:
        return 0.0
    best, ties = -1.0, [0]
    below_good = below_bad = 0
    for b in range(-_REACH, _REACH + 1):
        rate = (goods - below_good) / goods + below_bad / bads
        if rate > best:
            best, ties = rate, []
        if rate == best:
            ties.append(b)
        good, bad = bins.get(b, (0, 0))
        below_good, below_bad = below_good + good, below_bad + bad
    return ties[len(ties) // 2] / _BINS


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row.

    A url that a rule fits has that rule's verdict and no score. Others are allowed if their score is not under the
    threshold. A null or empty url has no score and is allowed, as is every url if rules accept or reject none. Equal
    urls are scored once; repeated rows give repeated results; ids may be null; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    urls = written(rows.filter("url <> ''").groupBy("url").agg((F.first("found.verdict") == "allow").alias("accepted")), "urls")
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    counts = written(_counts(urls.filter("accepted IS NOT NULL").filter(~held)), "counts")
    asked = urls.filter(F.col("accepted").isNull() | held)
    scored = written(_merged(scores(asked, counts), asked, "url"), "scores")
    limit = threshold(scored.filter("accepted IS NOT NULL"))
    method = F.when(F.col("score") < limit, "block").otherwise("allow")
    named = _merged(rows, scored.filter("accepted IS NULL").select("url", "score"), "url", "left")
    return named.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), "score")
