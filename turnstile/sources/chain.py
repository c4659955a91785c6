"""The chain of landed pages, walked from its first page by pointer doubling.

A page announces the cursor of the next one. The walk starts at the page that was asked for without a cursor and ends at
a page without tickets, without a next cursor, or whose next page never landed. Pages that it does not come by are not
part of a pull. Following one page after another would take a round for each; here every page keeps a jump, which a
round doubles in length by joining jumps to jumps, and the pages reached so far jump on together. A chain of a hundred
thousand pages takes about 17 rounds of two equality joins over cursors; the tickets wait until the ranks are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.session import written

_FEED = "feed"
#: A walk of so many pages is broadcast, with some 300 bytes for each.
_FEW_PAGES = 100_000


def _links(page_rows: DataFrame) -> DataFrame:
    """One row per cursor: (feed, at, page_file, following, n_landed). The first page is at ''.

    If a cursor landed more than once, the page with the smallest file name stands for it.
    """
    feed = F.col(_FEED) if _FEED in page_rows.columns else F.lit("")
    following = F.when(F.size("data") > 0, F.nullif("next_cursor", F.lit("")))
    rows = page_rows.select(
        F.coalesce(feed.cast("string"), F.lit("")).alias(_FEED),
        F.coalesce("cursor", F.lit("")).alias("at"),
        F.struct("page_file", following.alias("following")).alias("page"),
    )
    first = rows.groupBy(_FEED, "at").agg(
        F.min("page").alias("page"), F.count(F.lit(1)).alias("n_landed")
    )
    return first.select(_FEED, "at", "page.*", "n_landed")


def _ranks(links: DataFrame) -> DataFrame:
    """(feed, at, arrival) of the pages on the walk; the first page of each feed has arrival 0."""
    landed = links.select(_FEED, F.col("at").alias("to"))
    jumps = (
        links.filter(F.col("following").isNotNull())
        .select(_FEED, "at", F.col("following").alias("to"))
        .join(landed, [_FEED, "to"])
    )
    jumps = written(jumps.select(_FEED, "at", "to"), "jumps")
    zero = F.lit(0).cast("long").alias("arrival")
    reached = written(links.filter("at = ''").select(_FEED, "at", zero), "reached")
    length, n = 1, reached.count()
    while n:
        onward = reached.join(jumps, [_FEED, "at"]).select(
            _FEED, F.col("to").alias("at"), (F.col("arrival") + length).alias("arrival")
        )
        both = reached.unionByName(onward).groupBy(_FEED, "at").agg(F.min("arrival").alias("arrival"))
        reached, before = written(both, "reached"), n
        n = reached.count()
        if n == before:  # nothing lies farther on, or the chain has come round to itself
            break
        second = jumps.select(_FEED, F.col("at").alias("to"), F.col("to").alias("beyond"))
        doubled = jumps.join(second, [_FEED, "to"]).select(_FEED, "at", F.col("beyond").alias("to"))
        jumps, length = written(doubled, "jumps"), 2 * length
    return reached


def walk(page_rows: DataFrame) -> DataFrame:
    """The pages on the walk, each once, with ``arrival``: its place in the order of asking.

    With a column ``feed`` every feed (say, an organiser's fetch) has a chain of its own and all are
    walked together. What the pages hold is joined once, at the end.
    """
    links = written(_links(page_rows), "links")
    found = links.join(_ranks(links), [_FEED, "at"]).select(_FEED, "at", "page_file", "arrival")
    found = written(found, "found")
    if found.count() <= _FEW_PAGES:  # the pages, with all they hold, stay where they are read
        found = F.broadcast(found)
    keyed = page_rows
    if _FEED in page_rows.columns:
        keyed = keyed.withColumn(_FEED, F.coalesce(F.col(_FEED).cast("string"), F.lit("")))
    else:
        keyed = keyed.withColumn(_FEED, F.lit(""))
    keyed = keyed.withColumn("at", F.coalesce("cursor", F.lit("")))
    out = keyed.join(found, [_FEED, "at", "page_file"]).drop("at")
    return out if _FEED in page_rows.columns else out.drop(_FEED)


def audit(page_rows: DataFrame) -> DataFrame:
    """(feed, cursor, problem) of everything that keeps landed pages from being one chain per feed.

    ``missing``: announced, but never landed. ``repeated``: landed more than once. ``unannounced``:
    landed, but no page announces it (the first page needs no announcement). ``unreached``:
    announced, but the walk does not come by: it ends before, or the page lies on a cycle apart.
    ``cycle``: a page on the walk announces this one, where the walk has been before.
    """
    links = written(_links(page_rows), "links")
    ranks = _ranks(links).select(_FEED, "at", "arrival")
    told = links.filter(F.col("following").isNotNull()).join(ranks, [_FEED, "at"], "left")
    announced = told.groupBy(_FEED, F.col("following").alias("at")).agg(
        F.max("arrival").alias("last_announcer")
    )
    known = (
        links.select(_FEED, "at", "n_landed")
        .join(ranks, [_FEED, "at"], "left")
        .join(announced.withColumn("told", F.lit(True)), [_FEED, "at"], "full")
    )
    first, landed, reached = F.col("at") == "", F.col("n_landed").isNotNull(), F.col("arrival").isNotNull()
    untold = landed & ~first & F.col("told").isNull()
    problems = F.array_compact(
        F.array(
            F.when(~landed, "missing"),
            F.when(F.col("n_landed") > 1, "repeated"),
            F.when(untold, "unannounced"),
            F.when(landed & ~reached & ~untold & ~first, "unreached"),
            F.when(reached & (F.col("last_announcer") >= F.col("arrival")), "cycle"),
        )
    )
    return known.select(_FEED, F.nullif("at", F.lit("")).alias("cursor"), F.explode(problems).alias("problem"))
