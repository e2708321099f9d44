"""URL filter: explicit host and path rules first, then a tree of path templates learned per host.

A path becomes a template: numbers and hexadecimal ids are wildcards at once; at every depth of a host, segments too rare to
be a fixed part of the site become ``*``. The templates of a host form a tree, and one more tree holds all hosts together.
Pages that a rule decides are the labels. Walking from the root to a template, a branch whose share of blocked pages is
statistically like that of its parent (a two-proportion z test) is merged with it and adds nothing; a branch that differs
updates the running purity, smoothed towards the parent's. Each depth asks the common tree first and the host's own tree
next, so hosts without labels fall back on what the same path means elsewhere. Templates of purity at or above
``reject_at`` are blocked.

Only DataFrame functions. Templates are counted before any join, and their verdicts are written to the shared folder, so the
last join meets one row per template.

Defined cases: null urls and urls without ``://`` have an empty host and path and the template ``""``; an empty path fits no
rule; without any labels the purity is ``PRIOR`` everywhere; repeated rows get equal verdicts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import let, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRIOR = 0.25  # blocked share assumed before any label is seen
SMOOTHING = 4.0  # pages the parent's purity counts for
DIFFERENT = 1.96  # z value from which a branch stands on its own
RARE_SHARE = 0.01  # a fixed segment has at least this share of its host's pages at its depth
MANY_VALUES, UNREPEATED = 10, 0.5  # a depth with more values than this, most of them once, is variable throughout


@dataclass(frozen=True)
class UrlRule:
    """``text`` is host, slash, start of path, such as ``example.org/es/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path of a url."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Text of the longest rule that fits, else null."""
    found = [
        F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.lit(r.text))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return F.coalesce(*found, F.lit(None).cast("string"))


def shape(path: Column) -> Column:
    """Segments of a path, numbers and hexadecimal ids as wildcards that keep a file ending."""
    ending = lambda s: F.regexp_extract(s, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = lambda s: F.regexp_replace(s, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
    token = lambda s: (
        F.when(stem(s).rlike(r"^[0-9]+$"), F.concat(F.lit("{n}"), ending(s)))
        .when(stem(s).rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.concat(F.lit("{h}"), ending(s)))
        .otherwise(s)
    )
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), token)


def generalise(shapes: DataFrame) -> DataFrame:
    """Replace variable segments of ``(host, shape, n, ...)`` rows by ``*``; adds ``tokens``."""
    steps = shapes.select("host", "shape", "n", F.posexplode("shape").alias("depth", "token"))
    values = steps.groupBy("host", "depth", "token").agg(F.sum("n").alias("pages"))
    depths = values.groupBy("host", "depth").agg(
        F.sum("pages").alias("all"), F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("pages") == 1).alias("once")
    )
    variable = (F.col("distinct") > MANY_VALUES) & (F.col("once") > UNREPEATED * F.col("distinct"))
    rare = (F.col("pages") < RARE_SHARE * F.col("all")) | variable
    starred = (
        values.join(depths, ["host", "depth"])
        .where(rare & ~F.col("token").startswith("{"))
        .select("host", "depth", "token", F.lit(True).alias("star"))
    )
    marked = steps.join(starred, ["host", "depth", "token"], "left")
    token = F.when(F.col("star"), F.lit("*")).otherwise(F.col("token"))
    rebuilt = marked.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("depth", token.alias("token")))).alias("_t"))
    rebuilt = rebuilt.select("host", "shape", F.col("_t.token").alias("tokens"))
    keys = ["host", "shape"]
    joined = shapes.join(rebuilt, keys, "left")
    return joined.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def _chain(root: Column, tokens: Column) -> Column:
    """Node numbers from the root down to the template: each is the hash of its parent and its own token."""
    step = lambda nodes, token: F.concat(nodes, F.array(F.xxhash64(F.element_at(nodes, -1), token)))
    return F.aggregate(tokens, F.array(F.xxhash64(root)), step)


def _purity(counts: Column) -> Column:
    """Walk ``counts`` (allowed, blocked and the parent's counts per node, in order) to the smoothed blocked share."""

    def different(x: Column) -> Column:
        n, m = x["allowed"] + x["blocked"], x["up_allowed"] + x["up_blocked"]
        pooled = (x["blocked"] + x["up_blocked"]) / (n + m)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
        gap = F.abs(x["blocked"] / n - x["up_blocked"] / m)
        return F.when((n == 0) | (m == 0), n > 0).otherwise(gap > DIFFERENT * spread)

    def walk(p: Column, x: Column) -> Column:
        own = (x["blocked"] + SMOOTHING * p) / (x["allowed"] + x["blocked"] + SMOOTHING)
        return F.when(different(x), own).otherwise(p)

    return F.aggregate(counts, F.lit(PRIOR), walk)


def template_verdicts(shapes: DataFrame, reject_at: float) -> DataFrame:
    """Verdict of every ``(host, shape)`` from the labelled counts ``allowed`` and ``blocked``."""
    trees = generalise(shapes)
    common, own = _chain(F.lit(""), F.col("tokens")), _chain(F.concat(F.lit("//"), F.col("host")), F.col("tokens"))
    both = F.arrays_zip(common.alias("common"), own.alias("own"))
    nodes = trees.select("host", "shape", "allowed", "blocked", F.posexplode(both).alias("depth", "pair"), F.col("tokens"))
    one = lambda side, rank: F.struct(
        (2 * F.col("depth") + rank).alias("turn"), F.col(f"pair.{side}").alias("node")
    )
    sides = nodes.select("host", "shape", "allowed", "blocked", F.explode(F.array(one("common", 0), one("own", 1))).alias("x"))
    stats = sides.groupBy(F.col("x.node").alias("node")).agg(F.sum("allowed").alias("na"), F.sum("blocked").alias("nb"))
    met = sides.select("host", "shape", "x.turn", "x.node").join(stats, "node")
    chains = met.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("turn", "na", "nb"))).alias("c"))

    def counts(c: Column) -> Column:
        # the parent stands two places earlier: the same tree, one depth up; a host's root has the common root
        up = lambda i: F.when(i >= 2, F.get(c, i - 2)).when(i == 1, F.get(c, F.lit(0))).otherwise(F.get(c, F.lit(0)))
        return F.transform(
            c,
            lambda x, i: F.struct(
                x["na"].alias("allowed"),
                x["nb"].alias("blocked"),
                F.when(i == 0, F.lit(0)).otherwise(up(i)["na"]).alias("up_allowed"),
                F.when(i == 0, F.lit(0)).otherwise(up(i)["nb"]).alias("up_blocked"),
            ),
        )

    rated = chains.select("host", "shape", let(F.col("c"), lambda c: _purity(counts(c))).alias("purity"))
    named = trees.select("host", "shape", F.concat(F.lit("/"), F.array_join("tokens", "/")).alias("template"))
    verdict = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return rated.join(named, ["host", "shape"]).select("host", "shape", "template", "purity", verdict.alias("learned"))


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], reject_at: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every row of ``(page_id, url)``."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = split.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    split = split.withColumn("shape", F.array_join(shape(F.col("path")), "/"))
    by_text = {r.text: r.verdict for r in rules}
    ruled = F.coalesce(*[F.when(F.col("rule") == t, F.lit(v)) for t, v in by_text.items()], F.lit(None).cast("string"))
    split = split.withColumn("ruled", ruled)
    shapes = split.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ruled") == "allow").alias("allowed"),
        F.count_if(F.col("ruled") == "block").alias("blocked"),
    )
    tokens = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))
    verdicts = template_verdicts(stored(shapes.withColumn("shape", tokens), "shapes"), reject_at)
    verdicts = stored(verdicts.withColumn("shape", F.array_join("shape", "/")), "templates")
    judged = split.join(verdicts, ["host", "shape"], "left")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"), "template", "purity"
    )
