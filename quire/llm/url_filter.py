"""URL filters by a temporal list join (operator 7), in DataFrame functions only.

A list is a log of dated entries: (list, kind, pattern, action, since). kind is 'domain' (the host and all below
it), 'host' (that host alone) or 'prefix' (host and whole path segments); action is 'add' or 'remove'. The entries
of a pattern in a list become validity intervals: each holds from its date until the next entry of that pattern,
and of entries of one moment the removal wins. A capture is evaluated against the intervals that hold its fetch
time: its URL gives every key that could match (each domain above the host, the host, each leading path), keys meet
patterns in an equi-join, and the state as of the fetch time is taken there. A pattern's intervals are one row, a
timeline of the moments at which they begin or end with the lists active from each on, so the join makes no more rows
than there are keys.

Decisions depend on URL and fetch time alone, so distinct pairs are evaluated once. Keys that hold over a thousandth of
all rows, such as a common domain, are salted by their own size; there are fewer than a thousand of them.

A capture whose URL is null or has no host, or whose fetch time is null, matches nothing. Entries with a null in
pattern, list, action or date, or of another kind or action, are ignored; repeated entries count once. Repeated
captures are kept; empty tables give an empty result or one without matches. All columns of captures are returned,
but for old ones named blocked, lists or n_active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: No salt of a key holds over this part of all rows, about.
PIECES = 1000
_KINDS = {"domain": "d:", "host": "h:", "prefix": "p:"}


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and last dot; '' if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def path_of(url: Column) -> Column:
    """Path of an absolute URL, without query and fragment, starting with a slash."""
    return F.concat(F.lit("/"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1))


def keys_of(url: Column) -> Column:
    """All keys that a URL's entries can have."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    paths = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))
    found = F.array_distinct(F.concat(domains, F.array(F.concat(F.lit("h:"), host)), paths))
    return F.when(url.isNotNull() & (host != ""), found).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """key, list, since, until (null: still valid) of every 'add' that a later entry doesn't end at once."""
    kind = F.col("kind")
    pattern = F.lower(F.trim("pattern"))
    bare = F.regexp_replace(F.regexp_replace(pattern, r"^\.+|\.+$", ""), "/.*$", "")
    path = F.concat(F.regexp_extract(pattern, "^[^/]*", 0), F.lit("/"), F.array_join(F.filter(F.split(F.regexp_extract(F.trim("pattern"), "^[^/]*(/.*)$", 1), "/"), lambda x: x != ""), "/"))
    key = F.when(kind == "prefix", F.concat(F.lit("p:"), path)).when(kind.isin("domain", "host"), F.concat(F.substring(kind, 1, 1), F.lit(":"), bare))
    log = entries.select(key.alias("key"), F.col("list").cast("string").alias("list"), F.col("action").alias("action"), F.col("since").cast("timestamp").alias("since"))
    log = log.filter(F.col("key").isNotNull() & F.col("list").isNotNull() & F.col("since").isNotNull() & F.col("action").isin("add", "remove"))
    log = log.groupBy("key", "list", "since").agg(F.max("action").alias("action"))  # 'remove' is the greater
    after = F.lead("since").over(Window.partitionBy("key", "list").orderBy("since"))
    return log.withColumn("until", after).filter("action = 'add'").select("key", "list", "since", "until")


def timelines(spans: DataFrame) -> DataFrame:
    """key, line: for each moment at which an interval of the key begins or ends, in order, the lists active from then on."""
    by_key = spans.groupBy("key").agg(F.collect_list(F.struct("list", "since", "until")).alias("spans"))
    moments = F.array_sort(F.array_distinct(F.filter(F.concat(F.transform("spans", lambda s: s["since"]), F.transform("spans", lambda s: s["until"])), lambda t: t.isNotNull())))
    active = lambda t: F.transform(F.filter("spans", lambda s: (s["since"] <= t) & (s["until"].isNull() | (t < s["until"]))), lambda s: s["list"])
    return by_key.select("key", F.transform(moments, lambda t: F.struct(t.alias("since"), active(t).alias("lists"))).alias("line"))


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", pieces: int = PIECES) -> DataFrame:
    """captures with blocked (boolean), lists (sorted names of lists with an active match) and n_active (active entries that match)."""
    spark = captures.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    asked = captures.select(F.col(url).cast("string").alias("u"), F.col(fetched).cast("timestamp").alias("t")).filter("u is not null and t is not null").repartition(n, "u", "t").distinct()
    keyed = asked.withColumn("key", F.explode(keys_of(F.col("u"))))
    lines = timelines(intervals(entries))
    # Keys that hold over a share of 1 / pieces of the rows, fewer than pieces of them, are dealt to as many salts as bring them below it.
    each = keyed.groupBy("key").agg(F.count("*").alias("n"))
    whole = each.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(each.filter(F.col("n") * pieces > whole).select("key", F.ceil(F.col("n") * pieces / F.lit(max(1, whole))).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    keyed = keyed.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("u", "t"), salts).cast("int")).drop("salts")
    lines = lines.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    # as of the fetch time: the last moment that is not after it
    state = F.element_at(F.filter("line", lambda s: s["since"] <= F.col("t")), -1)
    met = keyed.join(lines, ["key", "salt"]).withColumn("active", F.when(F.size(F.filter("line", lambda s: s["since"] <= F.col("t"))) > 0, state["lists"]))
    hits = met.filter(F.size("active") > 0).groupBy("u", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("active")))).alias("lists"), F.sum(F.size("active")).cast("long").alias("n_active"))
    # the input's columns have names of their own while they are joined
    own = captures.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(captures.columns)], F.col(url).cast("string").alias("quire_url"), F.col(fetched).cast("timestamp").alias("quire_time"))
    out = own.join(hits, F.col("quire_url").eqNullSafe(F.col("u")) & F.col("quire_time").eqNullSafe(F.col("t")), "left")
    kept = [F.col(f"c{k}").alias(c) for k, c in enumerate(captures.columns) if c not in ("blocked", "lists", "n_active")]
    return out.select(*kept, F.col("n_active").isNotNull().alias("blocked"), F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"))
