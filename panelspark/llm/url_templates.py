"""URL verdicts: host rules first, then path templates learned per host.

A path's segments are generalised by form (runs of digits, long hexadecimal
codes). All paths of a host make a tree; level by level, a node's branches are
merged into a wildcard when they have few labels, or when their share of bad labels
does not differ from their siblings' beyond chance. What remains are templates; one is rejected when its smoothed share of bad labels is too high.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import named, written

# (verdict, host and path) of the query's contract (fixed values)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ENOUGH_LABELS = 5  # fewer say nothing of a branch's own rate
SIMILAR_Z = 1.96
PRIOR_WEIGHT = 20.0
REJECT_ABOVE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    name = verdict = None
    for outcome, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, outcome) if verdict is None else verdict.when(fits, outcome)
    empty = F.lit(None).cast("string")
    return (empty, empty) if name is None else (name, verdict)


def segments(path: Column) -> Column:
    """All generalised segments."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?i)[0-9a-f]{16,}", "{hex}"), r"[0-9]+", "{n}"))


def _next_level(tree: DataFrame, level: int) -> int | None:
    """The first level after ``level`` where templates of one node part, None if none do."""
    longer = tree.where(F.size("template") > level).groupBy("host", F.slice("template", 1, level).alias("above"))
    ends = longer.agg(F.min("template").alias("low"), F.max("template").alias("high")).where("low <> high")
    same = F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b))
    return ends.agg(F.min(F.array_position(same, False))).first()[0]


def templates(pages: DataFrame) -> DataFrame:
    """(host, form, template, n_labelled, n_bad) of every generalised path.

    ``pages`` has host, form (the segments) and bad (1, 0 or null). Counts are
    summed in the map tasks first, so a hot host sends few rows. Levels at which
    no node branches are passed over; the last one is where the last node does.
    """
    tree = written(
        pages.groupBy("host", "form").agg(
            F.count("bad").alias("n_labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("n_bad")
        ).withColumn("template", F.col("form")),
        "path-tree",
    )
    level = 0
    while level := _next_level(tree, level):
        above = F.slice("template", 1, level - 1)
        branches = (
            tree.where(F.size("template") >= level)
            .groupBy("host", above.alias("above"), F.element_at("template", level).alias("branch"))
            .agg(F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad"))
        )
        branches = written(branches, "path-branches")
        nodes = branches.groupBy("host", "above").agg(
            F.count("*").alias("n_branches"), F.sum("n").alias("n_all"), F.sum("bad").alias("bad_all")
        )
        nodes = written(nodes.where("n_branches > 1"), "path-nodes")
        rate = (F.col("bad_all") + 1) / (F.col("n_all") + 2)
        apart = F.abs(F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1e-9)
        merged = written(
            branches.join(nodes, ["host", "above"])
            .where((F.col("n") < ENOUGH_LABELS) | (apart <= SIMILAR_Z))
            .select("host", F.col("above").alias("up"), F.col("branch").alias("old")),
            "merged-branches",
        )
        wild = F.concat(above, F.array(F.lit("*")), F.slice("template", F.lit(level + 1), F.size("template")))
        # try_element_at keeps shorter templates in the join without an error
        hit = (tree.host == merged.host) & (above == merged.up) & (F.try_element_at("template", F.lit(level)) == merged.old)
        tree = written(
            tree.join(merged, hit, "left").select(
                tree.host, "form", "n_labelled", "n_bad",
                F.when(F.col("old").isNotNull(), wild).otherwise(F.col("template")).alias("template"),
            ),
            "path-tree",
        )
    return tree


def judge_urls(
    df: DataFrame,
    labels: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, badness.

    ``labels`` has page_id and bad (1 or 0; null and repeated rows of a page are
    ignored but for the worst). The longest fitting rule decides; else a
    template is blocked when (bad + w * base) / (labelled + w) exceeds 0.5, with
    base the share of bad labels overall and w = 20. Null urls and urls without
    ``://`` have an empty host and path and are judged as one template. Without
    labels only the rules block. Repeated pages are judged alike; an empty
    table gives an empty result; other columns are not read.
    """
    picked = df.select(named(df, id_column).alias("page_id"), named(df, url_column).alias("url"))
    host, path = host_and_path(F.col("url"))
    picked = picked.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "form", segments(F.col("path"))
    )
    known = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    tree = templates(picked.join(known, "page_id", "left").select("host", "form", "bad"))
    total = tree.agg(F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad")).first()
    base = (total["bad"] / total["n"]) if total["n"] else 0.0
    sums = tree.groupBy("host", "template").agg(F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad"))
    badness = ((F.col("bad") + PRIOR_WEIGHT * base) / (F.col("n") + PRIOR_WEIGHT)).alias("badness")
    sums = written(sums.select("host", "template", badness), "template-purity")
    judged = written(tree.select("host", "form", "template").join(sums, ["host", "template"]), "judged-templates")
    rule, outcome = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("badness") > REJECT_ABOVE, "block").otherwise("allow")
    return picked.join(judged, ["host", "form"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(outcome, learned).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "badness",
    )
