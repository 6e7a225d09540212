"""URL filtering by nested host and path rules: a sort-merge range join in SQL functions only.

Method. A host is turned round label by label into a canonical key (``www.example.com`` becomes ``com.example.www.``), so
that a rule's host and all its subdomains are one interval of keys, ``[key, key + U+10FFFF)``. Intervals of hosts nest or are
disjoint. The sweep sorts each interval's ends together with the URLs; every end carries the stack of hosts that are
active from there on, and a URL takes the stack of the last end before it. Of the stacked rules whose path begins the
URL's path, the longest wins.

Scale. The sweep runs in parallel over (bucket, salt): the bucket is the hash of the first two labels of the key, so an
interval of two labels or more lies in one bucket, while the few of one label go to every bucket. URLs of a bucket are
dealt over salts, and a bucket's ends are copied to each salt: a host with a third of all rows is spread evenly. No side
is broadcast, nothing is collected.

Defined cases: a URL that is null or has no ``://`` has empty host and path; such URLs and hosts that no rule fits get
the default verdict and a null rule. Rules with a null or empty host are ignored; a null path is empty. Repeated rules
count once; of equal host and path with different verdicts the smallest verdict in text order wins. Repeated URLs are
judged separately. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.common import without

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Above every character that a host can hold.
_TOP = "\U0010FFFF"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    head = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    return F.translate(head, _AZ, _az), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def host_key(host: Column) -> Column:
    """Reversed labels, each ended by a dot."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(key, ".", 2)), F.lit(buckets)).cast("int")


def _rule_stacks(rules: DataFrame, host: str, path: str, verdict: str) -> DataFrame:
    """One row for each end of a host's interval: (key, stack of rules active from there on).

    The rules' side is small next to the URLs', but may be large: ancestors are found by an equi-join on the at most
    ``labels`` prefixes of each key, not by comparing rules with rules.
    """
    r = (
        rules.select(F.translate(F.col(host), _AZ, _az).alias("h"), F.coalesce(F.col(path), F.lit("")).alias("p"), F.col(verdict).alias("v"))
        .where(F.coalesce(F.length("h"), F.lit(0)) > 0)
        .groupBy("h", "p")
        .agg(F.min("v").alias("v"))
        .withColumn("k", host_key(F.col("h")))
    )
    own = r.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "h", "v"))).alias("own"))
    labels = F.split(F.expr("substring(k, 1, length(k) - 1)"), r"\.", -1)
    ups = own.select("k", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))).alias("depth", "up"))
    stack = (
        ups.join(own.select(F.col("k").alias("up"), "own"), "up")
        .groupBy("k")
        .agg(F.flatten(F.array_sort(F.collect_list(F.struct("depth", "own"))).getField("own")).alias("stack"))
    )
    # The end of an interval brings back the stack of the innermost interval around it.
    parent = ups.join(own.select(F.col("k").alias("up")), "up").where(F.col("up") != F.col("k")).groupBy("k").agg(F.max_by("up", "depth").alias("up"))
    after = stack.select("k").join(parent, "k", "left").join(stack.select(F.col("k").alias("up"), F.col("stack").alias("outer")), "up", "left")
    none = F.lit(None).cast(stack.schema["stack"].dataType)
    ends = stack.select("k", F.col("k").alias("at"), F.lit(0).alias("side"), F.length("k").alias("depth"), "stack")
    return ends.unionByName(after.select("k", F.concat("k", F.lit(_TOP)).alias("at"), F.lit(1).alias("side"), (-F.length("k")).alias("depth"), F.coalesce("outer", F.when(F.lit(False), none)).alias("stack")))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    host: str = "host",
    path: str = "path",
    verdict: str = "verdict",
    default: str = "allow",
    buckets: int = 16,
    salts: int | None = None,
) -> DataFrame:
    """``pages`` with its columns and ``host, path, rule, verdict`` (of the URL). ``rules``: columns ``host, path, verdict``."""
    h, p = split_url(F.col(url))
    base = without(pages, "host", "path", "rule", "verdict")
    if salts is None:  # so that even a bucket with a third of all rows keeps its parts small
        salts = max(64, min(4096, base.select(F.lit(1)).count() // 500_000))
    kept = [F.col(c) for c in base.columns]
    u = base.select(F.struct(*kept).alias("row"), h.alias("h"), p.alias("p")).withColumn("at", host_key(F.col("h")))
    u = u.withColumn("bucket", _bucket(F.col("at"), buckets)).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))

    e = _rule_stacks(rules, host, path, verdict)
    wide = F.size(F.split("k", r"\.", -1)) <= 2  # one label and the empty end
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    e = e.withColumn("bucket", F.explode(F.when(wide, every).otherwise(F.array(_bucket(F.col("k"), buckets))))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    row, stack = u.schema["row"].dataType, e.schema["stack"].dataType
    both = u.select("bucket", "salt", "at", F.lit(2).alias("side"), F.lit(0).alias("depth"), "row", "h", "p", F.lit(None).cast(stack).alias("stack")).unionByName(
        e.select("bucket", "salt", "at", F.col("side"), "depth", F.lit(None).cast(row).alias("row"), F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("p"), "stack")
    )
    # At one key a start comes before the URLs; ends lie at keys that no URL has, outer ones after inner ones.
    w = Window.partitionBy("bucket", "salt").orderBy("at", "side", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("active", F.last(F.when(F.col("side") < 2, F.struct("stack")), ignorenulls=True).over(w)).where("side = 2")
    fits = F.filter(F.col("active.stack"), lambda x: F.startswith(F.col("p"), x["p"]))
    best = F.array_max(F.transform(fits, lambda x: F.struct((F.length(x["h"]) + F.length(x["p"])).alias("n"), F.length(x["h"]).alias("m"), x["h"].alias("h"), x["p"].alias("p"), x["v"].alias("v"))))
    out = swept.withColumn("best", best)
    return out.select("row.*", F.col("h").alias("host"), F.col("p").alias("path"), F.concat("best.h", "best.p").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
