"""URL filters: host and path rules, then a tree of path templates for each host.

The paths of a host form a tree of segments. Digits become wildcards at once. From the root down, a node whose
children are many for the urls below it is a variable segment, and its children become one wildcard branch; so do
children whose share of blocked urls does not differ from that of their siblings by a two-proportion test. What
results is a template; one with labels is rejected if the share of blocked urls among them, smoothed toward the
host's, is high. A template without labels is no evidence and passes. Labels come from the rules, and from a column
if there is one; no host bears on another. All steps are aggregations and joins on counts of distinct paths, so a
host with a third of all urls is no single task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def split_url(rows: DataFrame, url_col: str) -> DataFrame:
    """``rows`` with host and path."""
    url = f"coalesce(`{url_col}`, '')"
    return (
        rows.withColumn("_rest", F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END"))
        .withColumn("_host", F.regexp_extract("_rest", r"^([^/?#]*)", 1))
        .withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^([^?#]*)", 1))
        .withColumn("host", F.translate("_host", UPPER, LOWER))
        .drop("_rest", "_host")
    )


def ruled(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` (host, path) with rule and rule_verdict of the longest rule that fits, the first of equally long ones."""
    rule = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.text) if rule is None else rule.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return rows.withColumn("rule", none if rule is None else rule).withColumn("rule_verdict", none if verdict is None else verdict)


def templates(counts: DataFrame, many: int, share: float, z: float) -> DataFrame:
    """``counts`` (host, key, segs, n, lab, bad) to (host, key, lab, bad, template): segments after generalisation.

    Paths of any depth: a round passes over the segments that all paths below a node share and settles the next, at
    which they fork; a path alone below its node ends there. So there are as many rounds as forks on one path.
    """
    live = written(counts.withColumn("done", F.lit("")))
    out = []
    row = ("host", "key", "lab", "bad")

    def onward(segs):
        return F.when(F.size(segs) > 0, F.concat(F.lit("/"), F.array_join(segs, "/"))).otherwise("")

    while True:
        out.append(live.filter(F.size("segs") == 0).select(*row, F.col("done").alias("template")))
        here = live.filter(F.size("segs") > 0)
        if here.isEmpty():
            return reduce(DataFrame.unionByName, out)
        ends = here.groupBy("host", "done").agg(F.min("segs").alias("lo"), F.max("segs").alias("hi"))
        fork = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
        same = ends.select("host", "done", F.when(fork < 0, F.size("lo")).otherwise(fork).alias("same"))
        here = here.join(same, ["host", "done"]).withColumn("passed", onward(F.slice("segs", F.lit(1), F.col("same")))).withColumn("segs", F.slice("segs", F.col("same") + 1, F.size("segs")))
        here = here.withColumn("seg", F.get("segs", F.lit(0)))
        child = here.filter("seg IS NOT NULL").groupBy("host", "done", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "lab", "bad")))
        node = child.groupBy("host", "done").agg(F.count("*").alias("kids"), *(F.sum(c).alias(f"{c}_all") for c in ("n", "lab", "bad")))
        rest, rest_bad = F.col("lab_all") - F.col("lab"), F.col("bad_all") - F.col("bad")
        pooled = F.col("bad_all") / F.col("lab_all")
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("lab") + 1 / rest))
        alike = F.when((F.col("lab") > 0) & (rest > 0), (error == 0) | (F.abs(F.col("bad") / F.col("lab") - rest_bad / rest) < z * error)).otherwise(F.col("lab_all") == 0)
        merge = ((F.col("kids") >= many) & (F.col("kids") >= share * F.col("n_all"))) | ((F.col("kids") > 1) & alike)
        kind = child.join(node, ["host", "done"]).select("host", "done", "seg", F.when(merge, "*").otherwise(F.col("seg")).alias("to"))
        live = written(
            here.join(kind, ["host", "done", "seg"], "left")
            .withColumn("done", F.concat("done", "passed", F.coalesce(F.concat(F.lit("/"), "to"), F.lit(""))))
            .withColumn("segs", F.slice("segs", F.lit(2), F.greatest(F.size("segs") - 1, F.lit(0)))).drop("same", "passed", "seg", "to")
        )


def judge(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, label_col: str | None = None,
    many: int = 8, share: float = 0.2, z: float = 2.0, smoothing: float = 4.0, prior: float = 0.25, reject: float = 0.6,
) -> DataFrame:
    """A row for each row of ``pages``: id, host, path, rule, verdict, template, purity (blocked share, smoothed).

    A url that a rule fits gets the rule's verdict; any other is blocked if its template has labels and a purity of
    at least ``reject``. Labels are the rules' verdicts or, where there is no rule, ``label_col`` (true: bad). The
    purity of a template is smoothed toward its host's, and that toward ``prior``, each with the weight of
    ``smoothing`` labels. A null, empty or odd url has empty host and path and is judged as any other; repeated rows
    stay; an empty table gives no rows.
    """
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    rows = ruled(split_url(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), label.alias("label")), "url"), rules)
    bad = F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("int")).otherwise(F.col("label"))
    rows = rows.withColumn("bad", bad).withColumn("key", F.regexp_replace("path", "[0-9]+", "#"))
    counts = rows.groupBy("host", "key").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counts = counts.withColumn("segs", F.filter(F.split("key", "/"), lambda s: s != ""))
    tree = templates(counts, many, share, z)
    hosts = tree.groupBy("host").agg(((F.sum("bad") + smoothing * prior) / (F.sum("lab") + smoothing)).alias("host_share"))
    by_template = tree.groupBy("host", "template").agg(F.sum("bad").alias("t_bad"), F.sum("lab").alias("t_lab"))
    purity = by_template.join(hosts, "host").select("host", "template", "t_lab", ((F.col("t_bad") + smoothing * F.col("host_share")) / (F.col("t_lab") + smoothing)).alias("purity"))
    judged = written(tree.select("host", "key", "template").join(purity, ["host", "template"]))
    verdict = F.coalesce("rule_verdict", F.when((F.col("t_lab") > 0) & (F.col("purity") >= reject), "block").otherwise("allow"))
    return rows.join(judged, ["host", "key"]).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
