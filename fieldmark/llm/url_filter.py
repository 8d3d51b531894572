"""URL filter lists with dates (DataFrame functions only).

A list entry gives a domain a status (``block`` or ``allow``) from a date on, until the domain's
next entry; entries thus become validity intervals.  Each capture is judged by the entries active
at its fetch date for its host or a parent domain, the most specific first.  The as-of join is an
equi-join on the domain with a range condition, over the distinct (host, date) pairs of the
captures, so a host with a third of all captures costs one row a date; intervals are a stored
table, broadcast if counted to be small, else joined by an exchange that can be split at hot domains.

Edge cases: urls that are null or have no host, and captures without a date, match nothing and are
kept; entries with null fields are ignored; of a domain's entries of one date, ``block``
holds, else the first action by name; hosts compare lower-cased and without a final dot; an IP address (IPv6 ones in their
brackets) matches entries for itself only; repeated captures are judged alike; columns
keep their names, whatever they are, and the verdict is one struct, ``_verdict``, in place of a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, small, stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)"
ADDRESS = r"^(\[.*|[0-9.]+)$"


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, since, until) from entries (domain, action, listed_at); until is exclusive."""
    one = entries.dropna(subset=["domain", "action", "listed_at"]).groupBy(F.lower("domain").alias("domain"), "listed_at").agg(F.min_by("action", F.struct(F.col("action") != "block", "action")).alias("action"))
    later = Window.partitionBy("domain").orderBy("listed_at")
    return one.select("domain", "action", F.col("listed_at").alias("since"), F.lead("listed_at").over(later).alias("until"))


def judged(captures: DataFrame, entries: DataFrame, url_col: str = "url", date_col: str = "fetched_at") -> DataFrame:
    """``captures`` with a struct ``_verdict``: host, matched, action, since, kept."""
    rows = carried(captures, host_of(F.col(url_col)).alias("own"), F.col(date_col).alias("day"), without=("_verdict",))
    pairs = rows.where("own is not null and day is not null").select(F.col("own").alias("host"), F.col("day").alias("at")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host").rlike(ADDRESS), F.array("host")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    probes = pairs.select("host", "at", F.posexplode(suffixes).alias("depth", "domain"))
    active = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    found = probes.join(small(stored(intervals(entries), "intervals")), "domain").where(active)
    best = found.groupBy("host", "at").agg(F.min_by(F.struct("domain", "action", "since"), "depth").alias("m"))
    out = rows.join(best, (F.col("own") == F.col("host")) & (F.col("day") == F.col("at")), "left")
    kept = F.coalesce(F.col("m.action") != "block", F.lit(True))
    verdict = F.struct(F.col("own").alias("host"), F.col("m.domain").alias("matched"), F.col("m.action").alias("action"), F.col("m.since").alias("since"), kept.alias("kept"))
    return out.select("row.*", verdict.alias("_verdict"))
