"""URL filters by a temporal list join.

List entries are dated: from `since` on, a list has or hasn't a pattern. A pattern is a host (its subdomains
included) or a host with the beginning of a path. Successive entries of one list and pattern become validity
intervals, and each capture is held against the intervals that are open at its fetch time (an as-of join).

The join is on equality: a capture's keys are its host's suffixes of as many labels as some pattern of the list has,
each alone and with every leading part of the path up to the list's deepest pattern. Captures of one host meet as distinct (host, path start, fetch time) rows
before they are joined, so that a host with very many captures of few paths is cheap; a small list is broadcast
after its size is counted, and a larger one is joined by shuffles in which the captures' keys are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Intervals up to this number are broadcast; SALTS copies of a longer list meet salted captures.
SENT, SALTS = 200_000, 16
ENTRIES_SCHEMA = "list string, pattern string, since timestamp, listed boolean"

#: The dated lists that the query uses: (list, pattern, since, listed).
LISTS = (
    ("spam", "spam-farm.example.org", "2023-01-01", True),
    ("spam", "spam-farm.example.com", "2023-03-01", True),
    ("spam", "spam-farm.example.com", "2023-09-01", False),
    ("spam", "cheap-pills.example.com", "2023-02-15", True),
    ("spam", "cheap-pills.example.net", "2023-06-01", True),
    ("spam", "cheap-pills.example.net", "2023-06-20", False),
    ("spam", "cheap-pills.example.net", "2023-10-05", True),
    ("abuse", "tionsh.example.net", "2023-04-10", True),
    ("abuse", "tionsh.example.net", "2023-07-10", False),
    ("abuse", "tionble.example.com", "2023-05-01", True),
    ("abuse", "example.org", "2023-11-15", True),
    ("abuse", "example.org", "2023-12-01", False),
    ("optout", "example.net/es", "2023-03-20", True),
    ("optout", "tionsh.example.net/en", "2023-08-01", True),
    ("optout", "ththth.example.org/de", "2023-01-15", True),
)

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


#: Addresses aren't cut at their dots.
ADDRESS = r"^[0-9]+(\.[0-9]+){3}$"


def labels_of(host: Column) -> Column:
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))


def host_of(url: Column) -> Column:
    """The host in lower case without port, credentials and final dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, from, until): when each list holds each pattern; until is null while it still does.

    Of entries with the same list, pattern and date the last in the order false, true counts, so that a listing wins.
    Entries with a null list, pattern or date have no effect, and a null `listed` ends a listing.
    """
    pattern = F.rtrim(F.lower(F.trim(F.col("pattern"))), F.lit("/"))
    own = entries.where("list is not null and pattern is not null and since is not null").groupBy("list", pattern.alias("pattern"), "since").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    following = F.lead("since").over(Window.partitionBy("list", "pattern").orderBy("since"))
    return own.select("list", "pattern", F.col("since").alias("from"), following.alias("until"), "listed").where("listed").drop("listed")


def keys(host: Column, parts: Column, lengths: list[int], deepest: int) -> Column:
    """Every pattern that would match: the host's suffixes of so many labels, each with 0 to `deepest` leading parts of the path."""
    labels = labels_of(host)
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(fitting, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    starts = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(deepest))), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(i, F.lit(1))), "/"))))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p)))))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(page_id, host, fetched, n_matches, lists, blocked): every capture against the entries active when it was fetched.

    Repeated rows get a row each, as do null ids. A null or hostless url and a null time match nothing. Paths match by whole parts, names by
    whole labels and numeric addresses whole; urls are read to their end, whatever their length. An entry counts from its very date
    on, and the next one of its list and pattern ends it. An empty list blocks nothing; an empty table gives an empty result. Columns besides
    the three are not read, whatever their names. Very many captures of one page at one time are one row of the join, and a
    key that many rows share when matches come back is split by adaptive execution.
    """
    own = captures.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"), F.col(f"`{time_col}`").cast("timestamp").alias("fetched"))
    active = intervals(entries)
    labels = F.size(labels_of(F.split("pattern", "/")[0]))
    n, lengths, deepest = active.agg(F.count("*"), F.array_sort(F.collect_set(labels)), F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0))).first()
    parts = F.slice(F.filter(F.split("path", "/"), lambda p: p != ""), 1, max(1, deepest)) if deepest else F.expr("cast(array() as array<string>)")
    own = own.withColumn("start", F.lower(F.array_join(parts, "/"))).drop("path")
    met = own.where("host <> '' and fetched is not null").select("host", "start", "fetched").distinct()
    start = F.when(F.col("start") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("start", "/"))
    wide = met.withColumn("pattern", F.explode(keys(F.col("host"), start, lengths, deepest)))
    if n <= SENT:
        held, on = F.broadcast(active), ["pattern"]
    else:
        held, on = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["pattern", "salt"]
        wide = wide.withColumn("salt", F.pmod(F.xxhash64("host", "start", "fetched"), F.lit(SALTS)).cast("int"))
    hits = wide.join(held, on).where((F.col("fetched") >= F.col("from")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    found = hits.groupBy("host", "start", "fetched").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = own.join(found, ["host", "start", "fetched"], "left")
    return out.select("page_id", "host", "fetched", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n_matches").isNotNull().alias("blocked"))


def query_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, c, d) for a, b, c, d in LISTS], "list string, pattern string, since string, listed boolean").withColumn("since", F.concat("since", F.lit("T00:00:00Z")).cast("timestamp"))


def with_times(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times: page n counts as fetched n * 37 mod 365 days and n mod 24 hours into 2023."""
    seconds = F.pmod(F.col("page_id") * 37, F.lit(365)) * 86400 + F.pmod("page_id", F.lit(24)) * 3600
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1672531200) + seconds).alias("fetched"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "host", F.unix_timestamp("fetched").alias("fetched_s"), "n_matches", "lists", "blocked")


_VALUES = ", ".join(f"('{a}', '{b}', TIMESTAMP '{c}', {str(d).lower()})" for a, b, c, d in LISTS)
ORACLE_SQL = rf"""
WITH entries(list, pattern, since, listed) AS (VALUES {_VALUES}),
active AS (
  SELECT list, pattern, since AS start, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS until, listed FROM entries),
captures AS (
  SELECT page_id, rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') AS host,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path,
    TIMESTAMP '2023-01-01' + to_seconds((page_id * 37 % 365) * 86400 + page_id % 24 * 3600) AS fetched FROM pages),
hits AS (
  SELECT page_id, list FROM captures JOIN active ON listed AND fetched >= start AND (until IS NULL OR fetched < until)
    AND (host = split_part(pattern, '/', 1) OR host LIKE '%.' || split_part(pattern, '/', 1))
    AND (pattern NOT LIKE '%/%' OR split_part(path, '/', 2) = split_part(pattern, '/', 2))
  WHERE host <> ''),
found AS (SELECT page_id, count(*) AS n_matches, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hits GROUP BY page_id)
SELECT page_id, host, CAST(epoch(fetched) AS BIGINT) AS fetched_s, coalesce(n_matches, 0) AS n_matches, coalesce(lists, '') AS lists, n_matches IS NOT NULL AS blocked
FROM captures LEFT JOIN found USING (page_id)
"""
