"""Audiences, price histograms, auctions and counters of advertisements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.maths import MAX, rand
from quillon.operators.predicate import Keyword, compiled

MOST_ADS = 10_000


def targeting(users: DataFrame, ads: dict[int, str], keywords: dict[str, Keyword]) -> DataFrame:
    """id, ad for each user and each ad whose query they meet; one pass over users, the queries compiled side by side."""
    if len(ads) > MOST_ADS:
        raise ValueError("too many ads for one pass; go in blocks")
    hits = F.array_compact(F.array(*(F.when(compiled(t, keywords), F.lit(a)) for a, t in ads.items())))
    return users.select("id", F.explode(hits).alias("ad"))


def audience(users: DataFrame, base: str, aux: dict[str, str], keywords: dict[str, Keyword]) -> DataFrame:
    """One row: total of the base query, and the count of each auxiliary query within it."""
    return users.where(compiled(base, keywords)).agg(F.count("*").alias("total"), *(F.count_if(compiled(t, keywords)).alias(k) for k, t in aux.items()))


def sampled_audience(users: DataFrame, base: str, aux: dict[str, str], keywords: dict[str, Keyword], most: int, seed: int = 0) -> DataFrame:
    """As audience over the most users of least seeded hash, with scanned."""
    some = users.where(compiled(base, keywords)).orderBy(rand(0, MAX, seed, F.col("id")), "id").limit(most)
    return some.agg(F.count("*").alias("scanned"), *(F.count_if(compiled(t, keywords)).alias(k) for k, t in aux.items()))


def price_histogram(prices: DataFrame, place: int, limit: int, user: str = "user", price: str = "price") -> DataFrame:
    """bucket, users, reached: prices (user, price) in steps; the place-th highest price of each user, cut at limit - 1; reached counts users at or under a bucket, bucket 0 all of them."""
    w = Window.partitionBy(user).orderBy(F.desc(price))
    nth = prices.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == place).select(user, F.least(F.col(price), F.lit(limit - 1)).cast("int").alias("bucket"))
    counts = nth.groupBy("bucket").agg(F.count("*").alias("users"))
    full = counts.sparkSession.range(limit).select(F.col("id").cast("int").alias("bucket"))
    # limit rows at most pass through the window
    return full.join(counts, "bucket", "left").select("bucket", F.coalesce("users", F.lit(0)).alias("users")).withColumn("reached", F.sum("users").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def recent(events: DataFrame, now: int, keys: list[str], seconds: int = 300, time: str = "time") -> DataFrame:
    """Counts of the events of the last seconds by the keys."""
    return events.where((F.col(time) > now - seconds) & (F.col(time) <= now)).groupBy(*keys).agg(F.count("*").alias("cnt"))


def click_table(events: DataFrame, ad: str = "ad", user: str = "user", kind: str = "kind", money: str = "money", time: str = "time") -> DataFrame:
    """ad, clicks, views, money, ctr: views of an ad by a user after their first click of it don't count."""
    first = events.where(F.col(kind) == "click").groupBy(ad, user).agg(F.min(time).alias("_first"))
    e = events.join(first, [ad, user], "left")
    view = (F.col(kind) == "view") & (F.col("_first").isNull() | (F.col(time) <= F.col("_first")))
    out = e.groupBy(ad).agg(F.count_if(F.col(kind) == "click").alias("clicks"), F.count_if(view).alias("views"), F.sum(F.when(F.col(kind) == "click", F.col(money)).otherwise(0.0)).alias("money"))
    return out.withColumn("ctr", F.when(F.col("views") > 0, F.col("clicks") / F.col("views")).otherwise(0.0))


def estimated_gain(price: Column, clicks: Column, views: Column, prior_clicks: float = 1.0, prior_views: float = 1000.0) -> Column:
    """Price times the click rate with priors."""
    return price * (clicks + prior_clicks) / (views + prior_views)


def auction(pairs: DataFrame, n: int, score: str = "score", user: str = "user", domain: str = "domain", ad: str = "ad") -> DataFrame:
    """The n best ads of each user, one of each domain; ties go to the lesser ad. place counts from 1."""
    each = Window.partitionBy(user, domain).orderBy(F.desc(score), ad)
    best = Window.partitionBy(user).orderBy(F.desc(score), ad)
    one = pairs.withColumn("_r", F.row_number().over(each)).where("_r = 1").drop("_r")
    return one.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
