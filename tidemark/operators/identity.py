"""Whose session it is: fingerprints of sessions and hosts, resolved for whole batches.

Defined cases: a session seen before keeps its user; a new one takes the user with most hits on
its host and platform, ties to the smaller name; without a host, or with one nobody used, it gets
a name of its own, the same at every run; several sessions of one new host share the name; null
parts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import fingerprint

MOST_HITS = 10_000


def marked(sessions: DataFrame) -> DataFrame:
    """``sessions`` (session_id, platform, hostname) with their fingerprint."""
    parts = [F.coalesce(c, F.lit("")) for c in ("session_id", "platform", "hostname")]
    return sessions.withColumns({"platform": parts[1], "hostname": parts[2], "fingerprint": fingerprint(*parts)})


def resolved(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """(fingerprint, platform, hostname, user_id, how, n): every distinct session with its user, how
    it was found (session, host, new) and how often it came; ``known`` has (fingerprint, user_id,
    platform, hostname, hit_count)."""
    batch = marked(sessions).groupBy("fingerprint", "platform", "hostname").agg(F.count(F.lit(1)).alias("n"))
    own = known.select("fingerprint", F.col("user_id").alias("own"))
    hosts = known.filter(F.coalesce("hostname", F.lit("")) != "").groupBy("hostname", F.coalesce("platform", F.lit("")).alias("platform")).agg(
        F.min_by("user_id", F.struct((-F.coalesce("hit_count", F.lit(0))).alias("h"), "user_id")).alias("theirs")
    )
    joined = batch.join(own, "fingerprint", "left").join(hosts, ["hostname", "platform"], "left")
    place = F.when(F.col("hostname") != "", F.concat_ws("|", F.lit("host"), "hostname", "platform")).otherwise(F.col("fingerprint"))
    fresh = F.concat(F.lit("anon_"), F.substring(F.sha2(place, 256), 1, 8))
    return joined.select(
        "fingerprint", "platform", "hostname", F.coalesce("own", "theirs", fresh).alias("user_id"),
        F.when(F.col("own").isNotNull(), "session").when(F.col("theirs").isNotNull(), "host").otherwise("new").alias("how"), "n",
    )


def remembered(known: DataFrame, found: DataFrame, at) -> DataFrame:
    """``known`` after a batch: hits counted up to a limit, new fingerprints added."""
    new = found.select("fingerprint", F.col("user_id").alias("_u"), F.col("platform").alias("_p"), F.col("hostname").alias("_h"), "n")
    both = known.join(new, "fingerprint", "full_outer")
    values = {
        "user_id": F.coalesce("user_id", "_u"), "platform": F.coalesce("platform", "_p"), "hostname": F.coalesce("hostname", "_h"),
        "first_seen": F.coalesce("first_seen", at), "last_seen": F.when(F.col("n").isNotNull(), at).otherwise(F.col("last_seen")),
        "hit_count": F.least(F.lit(MOST_HITS), F.coalesce("hit_count", F.lit(0)) + F.coalesce("n", F.lit(0))),
    }
    return both.select("fingerprint", *[v.alias(k) for k, v in values.items()])
