"""URL filters by a temporal list join.

A list is a log of dated entries: from a day on, a list has (or no longer has) a rule for a host suffix or a
host with a path prefix. The entries of a rule become validity intervals; every capture of a page looks up
the rules that its address can match and is judged by those in force on the day it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and dots at its end; an address in brackets as it is."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1)
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def rule_keys(url: Column) -> Column:
    """Rules that may match, the most specific first: host with first path part, host, its parent domains."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    first = F.regexp_extract(path_of(url), r"^(/[^/]+)", 1)
    paths = F.when(first != "", F.array(F.concat(host, first))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(paths, suffixes)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, rule, valid_from, valid_to, action) of dated entries (list, rule, day, action).

    An entry holds until the next entry of its list for the same rule; action "remove" ends the rule. Of
    several entries on one day the greatest action stands, "remove" after "block" after "allow". Entries
    with a null rule, day or action hold never.
    """
    known = entries.where("rule is not null and day is not null and action is not null").groupBy("list", "rule", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(W.partitionBy("list", "rule").orderBy("day"))
    return known.select("list", "rule", F.col("day").alias("valid_from"), until.alias("valid_to"), "action").where("action <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """(page_id, verdict, rule, list) of each capture, as of its day.

    The most specific rule in force decides, "allow" before "block" at one rule, then the first list; without
    one the verdict is "pass". Null, odd and empty addresses and null days pass. Captures with one id and
    day (or none) are one capture, also of several addresses: the decision by the most specific rule among them
    stands. Addresses are read whole; other columns are ignored, whatever their names. An empty table gives an
    empty result.
    """
    # The join is by rule with the day as a further condition. The intervals are cut, so that both sides come
    # straight from a shuffle and a hot host's captures can be split between tasks.
    asked = captures.select(F.col(id_col).alias("page_id"), F.col(day_col).alias("day"), F.posexplode_outer(rule_keys(F.col(url_col))).alias("pos", "rule"))
    valid = cut(intervals(entries))
    in_force = (asked["rule"] == valid["rule"]) & (asked["day"] >= valid["valid_from"]) & (valid["valid_to"].isNull() | (asked["day"] < valid["valid_to"]))
    hits = asked.join(valid, in_force, "left").select("page_id", "day", "pos", asked["rule"], "list", "action")
    order = F.struct("pos", F.col("action"), "list", "rule")
    best = hits.groupBy("page_id", "day").agg(F.min(F.when(F.col("action").isNotNull(), order)).alias("b"))
    return best.select("page_id", "day", F.coalesce("b.action", F.lit("pass")).alias("verdict"), F.col("b.rule").alias("rule"), F.col("b.list").alias("list"))
