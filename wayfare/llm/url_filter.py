"""URL filters from path-template trees. DataFrame functions only.

For each host the url paths form a tree of segments. From the top down, values of a
segment that don't recur are variable and become the wildcard ``*``; siblings whose
share of good labels differs no more than chance allows are merged into one branch.
A template (the branch's path) is rejected when its smoothed share of good labels is
under a threshold. Fixed rules go first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import drop, stored

#: (list, host, path), of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Steps of the share of good labels within which siblings are alike.
GRADES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first :// up to /, ?, # or the end, A-Z lower-cased; then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its list; of equally long ones the first given. Nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(reversed(rules), key=lambda r: (len(r[1]) + len(r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def path_parts(path: Column) -> Column:
    """The path's segments, without empty ones."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def alike(g1: Column, n1: Column, g2: Column, n2: Column, up: Column, z: float, weight: float) -> Column:
    """Two-proportion test, each side with ``weight`` more labels that are good as often as the parent's are: whether the shares are within z standard errors."""
    a, m, b, k = g1 + weight * up, n1 + weight, g2 + weight * up, n2 + weight
    p, gap = (a + b) / (m + k), a / m - b / k
    return gap * gap <= z * z * p * (1 - p) * (1 / m + 1 / k)


def merged(kids: DataFrame, z: float, weight: float) -> DataFrame:
    """(host, template, name, label): siblings that are alike under one label. kids: host, template, name, labelled, good, up.

    Siblings stand in the order of their smoothed shares, in ``GRADES`` steps, those with
    more labels first; each joins the branch before it if it is like all of that, else
    it begins a new one. Siblings of one grade and one magnitude of labels are
    alike and summed up beforehand, so the order has a bounded number of places however
    many siblings there are. A label is ``*`` if the wildcard takes part, else the
    smallest name and the largest.
    """
    grade = F.floor((F.col("good") + weight * F.col("up")) / (F.col("labelled") + weight) * GRADES)
    graded = kids.withColumn("grade", grade).withColumn("few", -F.length(F.bin(F.col("labelled"))))
    cells = graded.groupBy("host", "template", "grade", "few").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), F.first("up").alias("up"))
    lined = cells.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("grade", "few", "labelled", "good", "up"))).alias("line"))
    start = F.struct(F.array().cast("array<struct<grade: bigint, few: int, branch: int>>").alias("out"), F.lit(-1).alias("branch"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("labelled"))

    def step(own: Column, x: Column) -> Column:
        joins = (own["branch"] >= 0) & alike(own["good"], own["labelled"], x["good"], x["labelled"], x["up"], z, weight)
        branch = F.when(joins, own["branch"]).otherwise(own["branch"] + 1)
        return F.struct(
            F.array_append(own["out"], F.struct(x["grade"].alias("grade"), x["few"].alias("few"), branch.alias("branch"))).alias("out"),
            branch.alias("branch"),
            (F.when(joins, own["good"]).otherwise(0) + x["good"]).alias("good"),
            (F.when(joins, own["labelled"]).otherwise(0) + x["labelled"]).alias("labelled"),
        )

    branches = lined.select("host", "template", F.explode(F.aggregate("line", start, step, lambda own: own["out"])).alias("b")).select("host", "template", "b.*")
    named = graded.select("host", "template", "name", "grade", "few").join(branches.hint("merge"), ["host", "template", "grade", "few"])
    of = named.groupBy("host", "template", "branch").agg(F.bool_or(F.col("name") == "*").alias("wild"), F.min("name").alias("low"), F.max("name").alias("high"), F.count(F.lit(1)).alias("names"))
    label = F.when(F.col("wild"), "*").when(F.col("names") == 1, F.col("low")).otherwise(F.concat("low", F.when(F.col("names") == 2, "|").otherwise("|..|"), "high"))
    return named.select("host", "template", "name", "branch").join(of.select("host", "template", "branch", label.alias("label")).hint("merge"), ["host", "template", "branch"]).drop("branch")


def templates(pages: DataFrame, least: int = 5, z: float = 1.96, weight: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """The tree's branches, and the pages with their branch.

    pages: host, path, good (1, 0 or null without a label) and any others.
    Returns the branches (host, template, n, labelled, good, purity), and pages with
    template and purity. A segment's values with fewer than ``least`` urls don't recur, and
    are one wildcard, as are those without labels, which nothing tells apart; their share
    of the parent doesn't count. Then siblings merge, the wildcard among them: merged().
    A branch goes on to the next segment while ``least`` urls do and there are good and bad labels
    among them; below, all segments are wildcards. So there are as many rounds as the
    deepest branch with both has segments. purity = (good + weight * parent's) /
    (labelled + weight), from the root's share of all labels down. ``*`` and ``|`` of urls are
    percent-encoded in templates.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    used: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        used.append(path)
        return df

    # one row for each distinct path of a host is enough for the tree: hot hosts and pages sum up before they are dealt
    live = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    live = keep(live.withColumn("rest", F.size(path_parts(F.col("path")))).withColumn("template", F.lit("")), "url-paths")
    root = live.agg(((F.sum("good") + 1) / (F.sum("labelled") + 2)).alias("up"))

    def smoothed(g: str, n: str, up: str) -> Column:
        return (F.col(g) + weight * F.coalesce(up, F.lit(0.5))) / (F.col(n) + weight)

    def deeper(left: Column) -> list[Column]:
        """Of what goes on: how many urls, labels and good ones."""
        return [F.sum(F.when(left > 0, F.col(c)).otherwise(0)).alias(f"deep_{c}") for c in ("n", "labelled", "good")]

    grows = (F.col("deep_n") >= least) & (F.col("deep_good") > 0) & (F.col("deep_good") < F.col("deep_labelled"))
    nodes = live.groupBy("host", "template").agg(*sums, *deeper(F.col("rest"))).crossJoin(F.broadcast(root))
    nodes = keep(nodes.select("host", "template", smoothed("good", "labelled", "up").alias("pp"), grows.alias("grows")), "url-nodes")
    level, done = 0, []
    while True:
        # urls that end here, and all of a branch that doesn't grow, are told apart by how many segments follow
        live = keep(live.join(nodes.hint("merge"), ["host", "template"]), "url-rows")
        done.append(live.where("rest = 0 or not grows").select("host", "path", "n", "labelled", "good", "template", "rest", "pp"))
        live = live.where("rest > 0 and grows")
        if not nodes.where("grows").limit(1).count():
            break
        live = live.drop("grows").withColumn("s", F.get(path_parts(F.col("path")), F.lit(level)))
        seg = live.groupBy("host", "template", "s").agg(*sums, *deeper(F.col("rest") - 1), F.first("pp").alias("up"))
        own = F.replace(F.replace(F.col("s"), F.lit("*"), F.lit("%2A")), F.lit("|"), F.lit("%7C"))
        seg = keep(seg.withColumn("name", F.when((F.col("n") >= least) & (F.col("labelled") > 0), own).otherwise("*")), "url-segments")
        kids = seg.groupBy("host", "template", "name").agg(*sums, F.first("up").alias("up"))
        label = merged(kids, z, weight)
        seg = keep(seg.join(label.hint("merge"), ["host", "template", "name"]).withColumn("next", F.concat("template", F.lit("/"), "label")), "url-level")
        nodes = seg.groupBy("host", F.col("next").alias("template")).agg(*sums, *(F.sum(f"deep_{c}").alias(f"deep_{c}") for c in ("n", "labelled", "good")), F.first("up").alias("up"))
        nodes = keep(nodes.select("host", "template", smoothed("good", "labelled", "up").alias("pp"), grows.alias("grows")), "url-nodes")
        # both sides are plain tables, so a hot host is split when they are joined
        live = live.join(seg.select("host", "template", "s", "next").hint("merge"), ["host", "template", "s"]).select("host", "path", "n", "labelled", "good", (F.col("rest") - 1).alias("rest"), F.col("next").alias("template"))
        level += 1
    rows = reduce(DataFrame.unionByName, done)
    name = F.concat("template", F.repeat(F.lit("/*"), F.col("rest")))
    rows = keep(rows.select("host", "path", F.when(name == "", "/").otherwise(name).alias("template"), "n", "labelled", "good", "pp"), "url-done")
    branches = rows.groupBy("host", "template").agg(*sums, F.first("pp").alias("pp"))
    branches, _ = stored(branches.select("host", "template", "n", "labelled", "good", smoothed("good", "labelled", "pp").alias("purity")), "url-templates")
    found, _ = stored(rows.select("host", "path", "template").join(branches.select("host", "template", "purity").hint("merge"), ["host", "template"]), "url-named")
    drop(pages.sparkSession, *used)
    return branches, pages.join(found.hint("merge"), ["host", "path"]).select(*pages.columns, "template", "purity")


def judge(pages: DataFrame, labels: DataFrame, least_purity: float = 0.5, rules=RULES, **tree: float) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of pages.

    pages: page_id, url. labels: page_id, good (1 or 0); several of a page count as
    their minimum, pages without one are unlabelled. verdict is the rule's if one
    fits, else block if the purity of the page's template is under least_purity,
    else allow. Null urls and urls without :// have an empty host and path and share
    one template. Equal rows and null ids stay; empty tables give an empty result.
    """
    host, path = split_url(F.col("url"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = labels.groupBy("page_id").agg(F.min("good").alias("good"))
    base, _ = stored(parsed.join(own, "page_id", "left"), "url-pages")
    _, found = templates(base, **tree)
    return found.withColumn("rule", rule).withColumn("verdict", verdict).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("purity") < least_purity, "block").otherwise("allow")).alias("verdict"), "template", "purity"
    )
