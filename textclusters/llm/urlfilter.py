"""URL verdicts by rules and by a path-template tree with labelled purity.

Each host has a tree of path templates. A segment's digits become a wildcard at
once; where a node of the tree has many children of small share each, they become
one wildcard too, with or without digits. Branches of one host with the same skeleton
(literals aside; a number, with what stands around it, is kept) are merged with each
other: they lie in order of their labelled share of bad pages, in STEPS steps, and
neighbouring steps become one branch where their shares do not differ more than
chance allows. A branch is rejected if its smoothed share of bad pages is too high.
All of it is DataFrame operations; each step is an aggregation with partial sums.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textclusters.llm.shared import lower_ascii

#: Children of a node from which rare ones are generalised, and the share of the node's pages below which a child is rare.
FANOUT, RARE_SHARE = 20, 0.05
#: Steps of the share of bad pages; standard errors within which two shares are alike; weight of the overall share; limit of the smoothed share, which it reaches to be bad.
STEPS, SIMILAR, PRIOR_WEIGHT, LIMIT = 20, 1.96, 4.0, 0.5
#: (verdict, rule): the rule's host with all subdomains, then the path's prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(slash + of_path)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _templates(pages: DataFrame, fanout: int, rare_share: float) -> DataFrame:
    """(host, path, template, skeleton) for each distinct host and path.

    The node of a segment is told by host, depth and the segments before it with
    their digits generalised: by two running sums of their hashes, so that a path of
    very many segments costs no more than its length.
    """
    paths = pages.groupBy("host", "path").agg(F.count("*").alias("pages"))
    segments = F.filter(F.split(F.regexp_replace("path", r"[0-9]+", "{n}"), "/"), lambda s: s != "")
    each = paths.select("host", "path", "pages", F.posexplode(segments).alias("depth", "segment"))
    before = Window.partitionBy("host", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    upto = [F.coalesce(F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k), "segment", "depth"), 24)).over(before), F.lit(0)) for k in (0, 1)]
    each = each.withColumn("parent", F.struct(*upto))
    child = each.groupBy("host", "depth", "parent", "segment").agg(F.sum("pages").alias("n"))
    node = child.groupBy("host", "depth", "parent").agg(F.count("*").alias("children"), F.sum("n").alias("total"))
    wide = child.join(node, ["host", "depth", "parent"]).where((F.col("children") >= fanout) & (F.col("n") < rare_share * F.col("total")))
    marked = each.join(wide.select("host", "depth", "parent", "segment", F.lit("*").alias("wild")), ["host", "depth", "parent", "segment"], "left")
    # The segments of one path.
    leaf = marked.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("depth", F.coalesce("wild", "segment").alias("s")))).alias("x"))
    leaf = paths.select("host", "path").join(leaf, ["host", "path"], "left").withColumn("x", F.coalesce(F.transform("x", lambda e: e["s"]), F.array().cast("array<string>")))
    one_number = lambda s: F.size(F.split(s, r"\{n\}")) == 2
    plain = F.transform("x", lambda s: F.when(one_number(s) | (s == "*"), s).otherwise(F.lit("*")))
    return leaf.select("host", "path", F.concat(F.lit("/"), F.array_join("x", "/")).alias("template"), F.concat(F.lit("/"), F.array_join(plain, "/")).alias("skeleton"))


def _branches(leaf: DataFrame) -> DataFrame:
    """leaf(host, skeleton, template, m, b) with bad and all_, the labels of the branch
    that its template belongs to; one without labels belongs to the whole skeleton."""
    leaf = leaf.withColumn("step", F.when(F.col("m") > 0, F.floor(STEPS * F.col("b") / F.greatest("m", F.lit(1)))))
    steps = leaf.where("m > 0").groupBy("host", "skeleton", "step").agg(F.sum("m").alias("sm"), F.sum("b").alias("sb"))
    # At most STEPS + 1 rows of one host and skeleton.
    order = Window.partitionBy("host", "skeleton").orderBy("step")
    m, b = F.lag("sm").over(order), F.lag("sb").over(order)
    share = (b + F.col("sb")) / (m + F.col("sm"))
    apart = F.abs(F.col("sb") / F.col("sm") - b / m) > SIMILAR * F.sqrt(share * (1 - share) * (1 / m + 1 / F.col("sm")))
    steps = steps.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("branch", F.sum("apart").over(order))
    branch = Window.partitionBy("host", "skeleton", "branch")
    steps = steps.select("host", "skeleton", "step", F.sum("sb").over(branch).alias("bad"), F.sum("sm").over(branch).alias("all_"))
    pool = leaf.groupBy("host", "skeleton").agg(F.sum("b").alias("pb"), F.sum("m").alias("pm"))
    joined = leaf.join(steps, ["host", "skeleton", "step"], "left").join(pool, ["host", "skeleton"])
    return joined.select("host", "skeleton", "template", "m", "b", F.coalesce("bad", "pb").alias("bad"), F.coalesce("all_", "pm").alias("all_"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, fanout: int = FANOUT, rare_share: float = RARE_SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for every row of pages(page_id, url).

    labels(page_id, bad): 1 for a bad page, 0 for a good one, for some pages; a
    page with several counts as often. The verdict is the rule's; without one, block
    if the branch's smoothed share of bad pages reaches the limit, else allow.
    A url that is null or has no :// has an empty host and path, and its template
    is "/". Rows without page_id are judged but have no label; rows that repeat a
    page_id are each judged, and their labels count for each; labels without bad
    do not count; other columns are ignored.
    """
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    leaves = _templates(seen, fanout, rare_share)
    placed = seen.join(leaves, ["host", "path"])
    known = labels.select("page_id", F.col("bad").cast("long").alias("bad")).where("page_id IS NOT NULL AND bad IS NOT NULL")
    leaf = placed.join(known, "page_id", "left").groupBy("host", "skeleton", "template").agg(F.count("bad").alias("m"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    overall = leaf.agg((F.sum("b") / F.greatest(F.sum("m"), F.lit(1))).alias("overall"))
    scored = _branches(leaf).crossJoin(F.broadcast(overall))
    scored = scored.withColumn("purity", (F.col("bad") + PRIOR_WEIGHT * F.col("overall")) / (F.col("all_") + PRIOR_WEIGHT))
    method = F.when(F.col("purity") >= LIMIT, "block").otherwise("allow")
    judged = placed.join(scored.select("host", "template", "skeleton", method.alias("method")), ["host", "template", "skeleton"], "left").withColumn("x", rule_of(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("x.rule").alias("rule"), F.coalesce("x.verdict", "method").alias("verdict"), "template")
