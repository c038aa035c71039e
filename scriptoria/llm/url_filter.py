"""URL filters on DataFrame functions alone: rules first, then a path-template tree learnt from what the rules decide.

Per host, urls are counted by path template: segments that look variable (numbers, hashes, dates, long ones) become ``*``, as
do the children of a node that has many rare ones, at every depth. Urls that a rule decides are the labels. Branches of a host that have the same
depth and wildcards in the same places are merged if both are labelled and alike: a branch whose blocked labels are more than APART standard
deviations from what the share among all of them makes likely, and one without labels, stands alone. A template is rejected if its
smoothed share of blocked labels, in which its unlabelled urls count half at the rate of all hosts, is at least REJECT; one without
labels has just that rate.

Defined cases: a null url, or one without ``://``, has an empty host and path, and is allowed unless a rule fits; very long urls and
paths of any depth are whole; repeated rows are urls like any other; null page_ids stay; other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

MANY, RARE = 8, 3.0  # children of a node; urls for each of them, below which they are variable
SMOOTH, HALF, REJECT = 4.0, 0.5, 0.6
APART = 2.0
VARIABLE = r"^(?:\d+|[0-9a-f]{8,}|\d{4}-\d{2}(?:-\d{2})?|[0-9a-f-]{32,}|.{25,})(?:\.[A-Za-z0-9]{1,5})?$"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 2)


def _fitting(rules: tuple[UrlRule, ...], value: str) -> Column:
    """Of the longest rule that fits host and path: its name or its verdict; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))


def templates(urls: DataFrame) -> DataFrame:
    """host, shape, template of the distinct shapes of urls (host, shape, label: 1 blocked, 0 allowed, null), with their counts n,
    labelled and blocked. The tree is walked level by level to the paths' full depth; a path leaves the walk as it is once so few urls
    lie below its node that no node further down can have MANY children."""
    units = cut(urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")))
    deepest = units.agg(F.max(F.size("shape"))).first()[0] or 0
    walked = units.select("host", "shape", "n", F.col("shape").alias("rest"), F.array().cast("array<string>").alias("above"))
    done = None
    for _ in range(deepest):
        ended = walked.where(F.size("rest") == 0)
        walked = walked.where(F.size("rest") > 0).withColumn("child", F.col("rest")[0])
        nodes = walked.groupBy("host", "above", "child").agg(F.sum("n").alias("n"))
        wide = nodes.groupBy("host", "above").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("n"))
        wide = wide.select("host", "above", ((F.col("children") >= MANY) & (F.col("n") < RARE * F.col("children"))).alias("wide"), F.col("n").alias("below"))
        walked = walked.join(wide, ["host", "above"])
        step = F.when(F.col("wide"), F.lit("*")).otherwise(F.col("child"))
        walked = walked.withColumn("above", F.concat("above", F.array(step))).withColumn("rest", F.expr("slice(rest, 2, greatest(size(rest) - 1, 0))"))
        small = F.col("below") < MANY
        ended = ended.select("host", "shape", F.col("above").alias("template")).unionByName(walked.where(small).select("host", "shape", F.concat("above", "rest").alias("template")))
        done = ended if done is None else done.unionByName(ended)
        walked = cut(walked.where(~small).select("host", "shape", "n", "rest", "above"))
        if walked.isEmpty():
            break
    last = walked.select("host", "shape", F.concat("above", "rest").alias("template"))
    return units.join(last if done is None else done.unionByName(last), ["host", "shape"])


def purities(units: DataFrame) -> DataFrame:
    """host, shape, template, branch, purity. A branch is named by its depth and its wildcards, and by its template if it stands alone."""
    form = F.array_join(F.transform("template", lambda s: F.when(s == "*", s).otherwise(F.lit("+"))), "/")
    units = units.withColumn("form", form).withColumn("template", F.concat(F.lit("/"), F.array_join("template", "/")))
    counted = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    nodes = units.groupBy("host", "form", "template").agg(*counted)
    alike = nodes.groupBy("host", "form").agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("share"))
    far = F.abs(F.col("blocked") - F.col("labelled") * F.col("share")) > APART * F.sqrt(F.col("labelled") * F.col("share") * (1 - F.col("share")))
    nodes = nodes.join(alike, ["host", "form"]).withColumn("branch", F.when(far | (F.col("labelled") == 0), F.col("template")).otherwise(F.col("form")))
    rate = nodes.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("rate"))
    weight = SMOOTH + HALF * (F.col("n") - F.col("labelled"))
    merged = nodes.groupBy("host", "branch").agg(*counted).join(F.broadcast(rate))  # rate: one row
    merged = merged.select("host", "branch", ((F.col("blocked") + weight * F.col("rate")) / (F.col("labelled") + weight)).alias("purity"))
    judged = nodes.select("host", "template", "branch").join(merged, ["host", "branch"])
    return units.join(judged, ["host", "template"]).select("host", "shape", "template", "branch", "purity")


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.select("page_id", "host", "path", _segments(F.col("path")).alias("shape"), _fitting(rules, "name").alias("rule"), _fitting(rules, "verdict").alias("ruled"))
    urls = urls.withColumn("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    learnt = purities(cut(templates(urls)))
    verdict = F.coalesce("ruled", F.when((F.col("purity") >= reject) & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow")))
    return urls.join(learnt, ["host", "shape"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
