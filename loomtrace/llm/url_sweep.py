"""URL rules by a sort-merge range join.

A host is written with its labels reversed and a dot behind each
(``a.example.com`` is ``com.example.a.``). A rule for a host then covers one
interval of keys, all that begin with its own key, and intervals nest. Urls and
rules are dealt to ranges of keys, a rule to every range that its interval
meets, and each range is read once in key order with a stack of the rules whose
interval holds the present key. Memory is the stack; a hot host is cut into
several ranges, since the path and a number of the row take part in the order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Urls of one range, until there are so many ranges; from then on ranges grow, which the sweep does not mind.
RANGE_ROWS = 200_000
RANGES = 10_000
#: Sampled keys for each range bound, and characters of a key that a bound holds: at most 60 MB in all.
SAMPLED = 30
BOUND_CHARS = 200
_END = "\U0010ffff"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _ranges(bounds: list[str]):
    """Number of the first and the last range of an interval of keys."""

    @F.arrow_udf("struct<first:int,last:int>")
    def of(low: pa.Array, high: pa.Array) -> pa.Array:
        first = pa.array([bisect_right(bounds, x) for x in low.to_pylist()], pa.int32())
        last = pa.array([bisect_right(bounds, x) for x in high.to_pylist()], pa.int32())
        return pa.StructArray.from_arrays([first, last], ["first", "last"])

    return of


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[tuple[str, str, str]]]] = []
        at = None
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("part", "key", "rule_host", "host", "path", "rule_verdict")}
            take, rules, verdicts = [], [], []
            for i, (part, key, rule_host, host, path, said) in enumerate(zip(*cols.values())):
                if part != at:
                    stack, at = [], part
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rule_host is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((rule_host, path, said))
                    continue
                best = max(((len(h) + len(p), len(h), h + p, v) for _, held in stack for h, p, v in held if path.startswith(p)), default=None)
                take.append(i)
                rules.append(best[2] if best else None)
                verdicts.append(best[3] if best else default)
            urls = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([urls.column("row"), urls.column("host"), urls.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["row", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict for each row.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if
    the url's path starts with its path. The longest rule (host and path
    together) wins, of equally long ones that with the longer host, then the
    greater text, then the greater verdict. Without a rule the verdict is
    ``default`` and rule is null. A null url, or one without ``://``, has an
    empty host and path and meets no rule; rules with a null or empty host are
    passed over and a null path counts as empty. Columns of ``pages`` named like
    the four results are replaced; all others move with their url, so give only
    those that are needed. Repeated rows are judged each, urls of any length whole;
    an empty table gives an empty result.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    urls = pages.drop(*{"host", "path", "rule", "verdict"} - {url_col}).select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", F.concat(host_key(F.col("host")), "path")).withColumn("salt", F.hex(F.monotonically_increasing_id()))
    n = urls.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(RANGES, ceil(n / RANGE_ROWS)))
    # Equal urls differ in the salt, so a url that is repeated often is cut into several ranges.
    low = F.concat("key", F.lit("\x00"), F.reverse("salt"))
    cut = F.when(F.length("key") < BOUND_CHARS, low).otherwise(F.substring("key", 1, BOUND_CHARS))
    sample = sorted(x[0] for x in urls.select(cut).sample(min(1.0, SAMPLED * parts / max(n, 1)), seed=7).collect())
    bounds = [sample[k * len(sample) // parts] for k in range(1, parts)] if sample else []
    ranges = _ranges(bounds)
    dealt = urls.withColumn("part", ranges(low, low)["first"]).select("part", "key", F.lit(None).cast("string").alias("rule_host"), "row", "host", "path", F.lit(None).cast("string").alias("rule_verdict"))
    named = rules.where("host is not null and host <> ''").select(host_key(F.col("host")).alias("key"), F.col("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict").alias("rule_verdict"))
    spread = named.withColumn("r", ranges(F.col("key"), F.concat("key", F.lit(_END)))).withColumn("part", F.explode(F.sequence("r.first", "r.last")))
    row = F.lit(None).cast(urls.schema["row"].dataType)
    spread = spread.select("part", "key", "rule_host", row.alias("row"), F.lit(None).cast("string").alias("host"), "path", "rule_verdict")
    both = dealt.union(spread).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", F.col("rule_host").isNull())
    out = T.StructType([urls.schema["row"], *(T.StructField(x, T.StringType()) for x in ("host", "path", "rule", "verdict"))])
    return both.mapInArrow(_sweep(default), out).select("row.*", "host", "path", "rule", "verdict")

