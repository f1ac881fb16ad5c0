"""URL filters by a sort-merge range join of prefix rules.

Canonical key: the host's labels reversed, each with a dot after it
("blog.example.net" -> "net.example.blog.").  A rule for a host then fits
exactly the keys in the interval that begins with its own key, subdomains
included, and rule intervals either nest or are disjoint.  Sorted keys and
sorted rules are swept together; a stack holds the rules whose intervals are
open.  Of these, the longest rule (host plus path) whose path begins the url's
path wins; of equally long ones, a block.

A sweep needs its rows sorted among themselves only, so rows stay in the
partitions they are read in, however hot a host is, and the rules come to
them: up to RULES_A_SWEEP rules, and RULE_CHARS characters of them, as a value
whose size has been checked, more in slices, one sweep for each, of which the
longest match stays.  A sweep starts at its first key: the rules that are open
there are those of the key's own labels.

Defined results: a null url, or one without "://", has an empty host and path
and fits no rule; an empty host fits none either; rules with a null host, path or
verdict are ignored; repeated pages are judged each; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES_A_SWEEP, RULE_CHARS = 50_000, 8 << 20
DEFAULT_VERDICT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def sweep(keys: list[str], paths: list[str], rules: list[tuple[str, str, str, str]]) -> list[tuple[str, str] | None]:
    """Best (rule, verdict) for each of the sorted keys; rules (key, path, name,
    verdict) sorted by key."""
    out: list[tuple[str, str] | None] = []
    stack: list[tuple[str, str, str, str]] = []
    i = 0
    if keys:
        i = bisect_left(rules, (keys[0],))
        labels = keys[0].split(".")[:-1]
        for n in range(1, len(labels)):  # open before the first key
            above = ".".join(labels[:n]) + "."
            stack += rules[bisect_left(rules, (above,)) : bisect_right(rules, (above, "\U0010ffff"))]
    for key, path in zip(keys, paths, strict=True):
        while i < len(rules) and rules[i][0] <= key:
            while stack and not rules[i][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[i])
            i += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        fits = [r for r in stack if path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[2]), r[3] == "block"), default=None)
        out.append(best and (best[2], best[3]))
    return out


def _judged(rules: list[tuple[str, str, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            order = pc.sort_indices(column(part, "key"))
            part = part.take(order)
            found = sweep(column(part, "key").to_pylist(), column(part, "path").to_pylist(), rules)
            # an earlier slice of the rules may have found a longer one
            names = [c for c in part.schema.names if c not in ("rule", "verdict")]
            old = zip(column(part, "rule").to_pylist(), column(part, "verdict").to_pylist(), strict=True)
            pairs = [max([x for x in (f, o if o[0] is not None else None) if x], key=lambda x: (len(x[0]), x[1] == "block"), default=(None, None)) for f, o in zip(found, old, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(column(part, c) for c in names), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], names=[*names, "rule", "verdict"]
            )

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """pages (page_id, url) against rules (host, path, verdict): page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    body = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).select("page_id", host.alias("host"), path.alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    key = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))
    empty = F.lit(None).cast("string")
    body = body.withColumn("key", key).withColumn("rule", empty).withColumn("verdict", empty)
    schema = "page_id long, host string, path string, key string, rule string, verdict string"
    rules = rules.where("host is not null and path is not null and verdict is not null and host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").distinct()
    count, chars = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    slices = max(1, -(-count // RULES_A_SWEEP), -(-chars // RULE_CHARS))
    for s in range(slices):
        part = rules if slices == 1 else rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(slices)) == s)
        known = sorted((host_key(r["host"]), r["path"], r["host"] + r["path"], r["verdict"]) for r in part.collect())
        body = body.mapInArrow(_judged(known), schema)
    return body.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
