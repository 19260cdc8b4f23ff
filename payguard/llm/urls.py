"""URL filters: a tree of path templates per host, judged by smoothed labelled purity.

Level by level, the segments below a node that have too few pages of their own are variable
and become one wildcard branch. The others and the wildcard are branches with a labelled share
of bad pages; in order of that share, neighbours that a two-proportion test can't tell apart
are merged, pair by pair, each merge pooling its counts. So ids and slugs generalise and
similar branches are one. A template is rejected where its smoothed purity is low. Levels are
grouped sums; rows meet only the branches that have enough pages, and a node's branches are
pooled by 200ths of their share before they are merged, so that no host is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

#: Fixed values of the contract: verdict by host and path prefix.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
#: Standard deviations of a one-sided bound of 95 %.
SURE = 1.645


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule whose host is the url's or a parent domain and whose path starts its path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        found = F.when(fits, rule).otherwise(found)
    return found


def _merged(items: Column, apart: float) -> Column:
    """Array of (rate, l, b, n, first, variable) -> array of groups of neighbours that are alike.

    A group has the pooled counts and, as ``rates``, the rates it spans. Branches without labels,
    and such as are all good or all bad alike, are alike.
    """
    start = F.transform(F.slice(items, 1, 1), lambda x: _group(x, F.array(x["rate"])))

    def step(groups: Column, x: Column) -> Column:
        last = F.element_at(groups, -1)
        l, b = last["l"] + x["l"], last["b"] + x["b"]
        share = b / l
        gap = F.abs(last["b"] / last["l"] - x["b"] / x["l"])
        spread = F.sqrt(share * (1 - share) * (1 / last["l"] + 1 / x["l"]))
        alike = F.coalesce((last["l"] == 0) | (x["l"] == 0) | (b == 0) | (b == l) | (gap < apart * spread), F.lit(True))
        pooled = F.struct(
            l.alias("l"), b.alias("b"), (last["n"] + x["n"]).alias("n"), F.least(last["first"], x["first"]).alias("first"),
            (last["variable"] | x["variable"]).alias("variable"), F.concat(last["rates"], F.array(x["rate"])).alias("rates"),
        )
        others = F.slice(groups, 1, F.size(groups) - 1)
        return F.when(alike, F.concat(others, F.array(pooled))).otherwise(F.concat(groups, F.array(_group(x, F.array(x["rate"])))))

    return F.aggregate(F.slice(items, 2, 1000), start, step)


def _group(x: Column, rates: Column) -> Column:
    return F.struct(x["l"].alias("l"), x["b"].alias("b"), x["n"].alias("n"), x["first"].alias("first"), x["variable"].alias("variable"), rates.alias("rates"))


def _branches(rows: DataFrame, level: int, support: int, apart: float, weight: float) -> DataFrame:
    """(host, template, seg) -> part: the names of the segments that are branches of their own or of a group.

    All other segments of a node are ``/*``. A group of several segments is named by its least
    one and how many more it has; ``#`` can't be in a path.
    """
    seg = F.get("segs", F.lit(level))
    child = rows.filter(seg.isNotNull()).groupBy("host", "template", seg.alias("seg")).agg(
        F.count(F.lit(1)).alias("pages"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")
    )
    child = written(child, "branches")
    node = child.groupBy("host", "template").agg((F.sum("b") / F.greatest(F.sum("l"), F.lit(1))).alias("share"), F.max("pages").alias("most"))
    node = written(node.filter(F.col("most") >= support), "nodes")
    near = lambda l, b: F.round(200 * (F.col(b) + weight * F.col("share")) / (F.col(l) + weight)).cast("int").alias("rate")
    own = child.filter(F.col("pages") >= support).join(node, ["host", "template"]).select("host", "template", "seg", near("l", "b"), "l", "b")
    own = written(own, "supported")
    rest = child.filter(F.col("pages") < support).groupBy("host", "template").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    rest = rest.join(node, ["host", "template"]).select("host", "template", F.lit(None).cast("string").alias("seg"), near("l", "b"), "l", "b")
    pooled = own.union(rest).groupBy("host", "template", "rate").agg(
        F.sum("l").alias("l"), F.sum("b").alias("b"), F.count("seg").alias("n"), F.min("seg").alias("first"), F.max(F.col("seg").isNull()).alias("variable")
    )
    items = F.array_sort(F.collect_list(F.struct("rate", "l", "b", "n", "first", "variable")))
    groups = pooled.groupBy("host", "template").agg(items.alias("items")).select("host", "template", F.explode(_merged(F.col("items"), apart)).alias("g"))
    alone = (F.col("g.n") == 1) & (F.col("g.first") != "*")
    name = F.when(F.col("g.variable"), "/*").when(alone, F.concat(F.lit("/"), F.col("g.first"))).otherwise(F.concat(F.lit("/"), F.col("g.first"), F.lit("#+"), (F.col("g.n") - 1).cast("string")))
    named = written(groups.select("host", "template", F.explode("g.rates").alias("rate"), name.alias("part")).filter("part <> '/*'"), "groups")
    return written(own.join(named, ["host", "template", "rate"]).select(F.col("host").alias("kh"), F.col("template").alias("kt"), F.col("seg").alias("ks"), "part"), "literal")


def templates(labelled: DataFrame, support: int = 20, apart: float = 2.5, weight: float = 10.0) -> DataFrame:
    """(id, host, path, bad: 0/1/null) -> id, host, bad, template.

    A segment is a branch with ``support`` pages or more; branches differ where a z of two
    proportions is ``apart`` or more. The tree goes on until no node has ``support`` pages below
    it, so no branch is left out; what is still below then is ``/**``.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = labelled.select("id", "host", "bad", segments.alias("segs"), F.lit("").alias("template"))
    level = 0
    while not rows.filter(F.size("segs") > level).groupBy("host", "template").count().filter(F.col("count") >= support).isEmpty():
        literal = _branches(rows, level, support, apart, weight)
        seg = F.get("segs", F.lit(level))
        met = rows.join(literal, (rows["host"] == F.col("kh")) & (rows["template"] == F.col("kt")) & (seg == F.col("ks")), "left")
        part = F.when(seg.isNull(), "").otherwise(F.coalesce("part", F.lit("/*")))
        rows = written(met.select("id", "host", "bad", "segs", F.concat("template", part).alias("template")), "templates")
        level += 1
    rest = F.when(F.size("segs") > level, "/**").otherwise("")
    return rows.select("id", "host", "bad", F.concat("template", rest).alias("template"))


def purity(labelled: DataFrame, support: int = 20, apart: float = 2.5, weight: float = 10.0) -> DataFrame:
    """(id, host, path, bad: 0/1/null) -> id, template, n_labelled, purity, purity_at_most.

    Purity is smoothed with ``weight`` rows at the host's rate, that one with as many at the
    whole table's. ``purity_at_most`` is its upper bound on one side, of 95 %: by ``SURE`` standard deviations of the beta
    distribution whose mean the smoothed purity is. Few labels leave it high, whatever they say.
    """
    rows = templates(labelled, support, apart, weight)
    sums = rows.groupBy("host", "template").agg(F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    sums = written(sums, "sums")
    hosts = sums.groupBy(F.col("host").alias("hh")).agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    overall = sums.agg((F.coalesce(F.sum("b"), F.lit(0)) / F.greatest(F.sum("l"), F.lit(1))).alias("rate"))
    hosts = hosts.crossJoin(F.broadcast(overall)).select("hh", ((F.col("hb") + weight * F.col("rate")) / (F.col("hl") + weight)).alias("hr"))
    bad_rate = (F.col("b") + weight * F.col("hr")) / (F.col("l") + weight)
    judged = sums.join(hosts, F.col("host") == F.col("hh")).select(F.col("host").alias("jh"), F.col("template").alias("jt"), F.col("l").alias("n_labelled"), (1 - bad_rate).alias("purity"), (1 - bad_rate + SURE * F.sqrt(bad_rate * (1 - bad_rate) / (F.col("l") + weight + 1))).alias("purity_at_most"))
    judged = written(judged, "purity")
    out = rows.join(judged, (F.col("host") == F.col("jh")) & (F.col("template") == F.col("jt")))
    return out.select("id", "template", "n_labelled", "purity", "purity_at_most")


def judge(pages: DataFrame, labels: DataFrame, least: float = 0.75) -> DataFrame:
    """(page_id, url) and (doc_id, quality) -> page_id, host, path, rule, template, purity, verdict.

    A page is bad where the label of its number has quality 0; several labels of one number
    count as bad if any is. Rules go first, then a template is blocked whose purity is under ``least`` even at
    its upper bound: surely more than a quarter of its pages are bad. On a host of 15 % bad pages that takes six
    labels, if all are bad. A null url has an empty host and
    path; rows that repeat count and are judged each; no labels, no blocks; an empty table gives
    no rows; other columns of pages, clashing ones too, are not looked at.
    """
    bad = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    slim = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    slim = written(slim.withColumn("id", F.monotonically_increasing_id()), "urls")
    marked = slim.join(bad, F.col("page_id") == F.col("of"), "left").select("id", "host", "path", "bad")
    found = purity(marked)
    out = slim.join(found, "id").withColumn("rule", rule_for(F.col("host"), F.col("path")))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in RULES.items():
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    own = F.when(F.col("purity_at_most") < least, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(by_rule, own))
