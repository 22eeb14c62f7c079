"""Registrable domains by whole public suffix lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import urls

#: Largest list, in rules, that is broadcast; longer ones are shuffled.
BROADCAST_RULES = 100_000


def host_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, suffix, domain of distinct hosts (host) by the rules of a suffix list (rule).

    A host's own tails are joined to the rules by equality: tail = rule for plain rules and
    exceptions, what follows the tail's first label for *. rules. Of the rules that hold an exception
    wins, then the longest. A host of which no rule holds has no suffix and is its own domain, as is a bare suffix.
    """
    r = rules.select(F.lower(F.trim("rule")).alias("rule")).where("rule <> ''").distinct()
    r = r.select("rule", F.startswith("rule", F.lit("*.")).alias("__wild"), F.regexp_replace("rule", r"^(\*\.|!)", "").alias("__name"))
    r = F.broadcast(r) if r.count() <= BROADCAST_RULES else r
    one = hosts.select("host").where("host is not null").distinct()
    each = one.select("host", F.explode(urls.tails(F.col("host"))).alias("tail"))
    names = F.array(F.struct(F.col("tail").alias("n"), F.lit(False).alias("w")), F.struct(F.when(F.contains("tail", F.lit(".")), F.regexp_replace("tail", r"^[^.]*\.", "")).alias("n"), F.lit(True).alias("w")))
    asked = each.select("host", "tail", F.explode(names).alias("a")).select("host", "tail", F.col("a.n").alias("__name"), F.col("a.w").alias("__wild")).where("__name is not null")
    held = asked.join(r, ["__name", "__wild"]).select("host", F.startswith("rule", F.lit("!")).alias("exception"), urls.suffix_labels(F.col("tail"), F.col("rule")).alias("n"))
    best = held.groupBy("host").agg(F.max(F.struct("exception", "n")).alias("b"))
    every = urls.tails(F.col("host"))
    n = F.col("b.n")
    return one.join(best, "host", "left").select("host", F.get(every, n - 1).alias("suffix"), F.when(n.isNull() | (F.size(every) <= n), F.col("host")).otherwise(F.get(every, n)).alias("domain"))


def with_domain(df: DataFrame, value: Column, name: str, rules: DataFrame | None = None) -> DataFrame:
    """df with the registrable domain of a URL or host: by the rules of a list, else by the short list in constants."""
    if rules is None:
        return df.withColumn(name, urls.registrable_domain(value))
    df = df.withColumn("__host", urls.host_of(value))
    known = host_domains(df.select(F.col("__host").alias("host")), rules).select(F.col("host").alias("__host"), F.col("domain").alias(name))
    return df.drop(name).join(known, "__host", "left").drop("__host")
