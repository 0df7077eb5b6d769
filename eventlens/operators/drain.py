"""Template mining: lines with variable parts masked, grouped, and merged where they are alike.

The definition is our own and doesn't depend on arrival. A line's values are masked by kind; lines of equal masked text are
one group (a partial aggregate, so a million equal lines are one row). Groups fall into leaves of a tree: by their number
of tokens, then by their first tokens, as many as the depth says; a node has its commonest children and one for all
others. In a leaf groups are merged, most frequent first, where the share of equal tokens reaches the similarity;
differing tokens become <*>.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks
from ..functions.strings import _c

#: The kinds that are masked, in this order.
KINDS = "ipv4_port ipv4 ipv6 email url fqdn uuid mac md5 sha1 sha256 path oauth function hexcolor version hexnum duration timestamp date time num".split()
_DAY, _CLOCK = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?"
#: Kinds that lines hold in other forms than texts: versions without a v, paths of two components or more, short durations, times, numbers that stand alone.
OWN = {
    "version": r"(?<![\w.])[Vv]?[0-9]+\.[0-9]+(?:\.[0-9]+)?(?:-[0-9A-Za-z]+)?(?![\w.])", "path": r"(?<![\w/])(?:/[\w.-]+){2,}", "duration": r"(?<![\w.])[0-9]+(?:\.[0-9]+)?(?:us|ms|ns|[smhd])\b",
    "timestamp": rf"\b{_DAY}T{_CLOCK}(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})?", "date": rf"\b{_DAY}\b", "time": rf"\b{_CLOCK}", "num": r"(?<![\w.])[-+]?[0-9]+(?:\.[0-9]+)?(?:[Ee][-+]?[0-9]+)?(?![\w.])",
}
DEPTH, CHILDREN, SIMILARITY = 4, 100, 0.4


def masked(text, kinds: list[str] | None = None) -> Column:
    """The text with its values masked and single blanks between tokens."""
    return F.trim(F.regexp_replace(masks.normalized(_c(text), KINDS if kinds is None else kinds, OWN), r"\s+", " "))


def template_id(template) -> Column:
    """v1: and 16 hex digits of the template's SHA-256, white space aside."""
    return F.concat(F.lit("v1:"), F.substring(F.sha2(F.regexp_replace(F.trim(_c(template)), r"\s+", " "), 256), 1, 16))


def merge(masked_counts: list[tuple[str, int]], similarity: float = SIMILARITY) -> dict[str, str]:
    """Each masked text's template, among texts of one token count and lead."""
    out, templates = {}, []
    for text, _ in sorted(masked_counts, key=lambda x: (-x[1], x[0])):
        tokens = text.split(" ")
        best, at = -1.0, -1
        for i, (t, _) in enumerate(templates):
            same = sum(a == b for a, b in zip(t, tokens)) / max(1, len(tokens))
            if same > best:
                best, at = same, i
        if best >= similarity:
            t, members = templates[at]
            templates[at] = ([a if a == b else "<*>" for a, b in zip(t, tokens)], [*members, text])
        else:
            templates.append((tokens, [text]))
    for t, members in templates:
        for m in members:
            out[m] = " ".join(t)
    return out


def _leaves(groups: DataFrame, depth: int, children: int) -> DataFrame:
    """groups with the key of their leaf. Tokens with a digit or a mask lead to the child for all others."""
    tokens = F.split("masked", " ")
    out = groups.withColumn("key", F.size(tokens).cast("string"))
    for i in range(max(1, depth - 2)):
        t = F.get(tokens, F.lit(i))
        out = out.withColumn("__t", F.when(t.isNull() | t.rlike(r"[0-9]|<"), "<*>").otherwise(t))
        # a node's children by the lines below them; the rank is over different tokens of the node
        sums = out.groupBy("key", "__t").agg(F.sum("count").alias("__n"))
        ranked = sums.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("__n"), "__t")))
        out = out.join(ranked.where(F.col("__r") <= children).select("key", "__t", F.lit(True).alias("__own")), ["key", "__t"], "left")
        out = out.withColumn("key", F.concat_ws(" ", "key", F.when(F.col("__own"), F.col("__t")).otherwise("<*>"))).drop("__t", "__own")
    return out


def drain(df: DataFrame, text: str, similarity: float = SIMILARITY, depth: int = DEPTH, children: int = CHILDREN, filters: list[str] | None = None) -> DataFrame:
    """(masked, template, count): each distinct masked text with its template."""
    groups = df.where(F.col(text).isNotNull()).select(masked(text, filters).alias("masked")).groupBy("masked").agg(F.count("*").alias("count"))
    keyed = _leaves(groups, max(2, depth), max(1, children))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = merge(list(zip(pdf["masked"], pdf["count"])), min(1.0, max(0.0, similarity)))
        return pd.DataFrame({"masked": pdf["masked"], "template": pdf["masked"].map(found), "count": pdf["count"]})

    return keyed.groupBy("key").applyInPandas(run, "masked string, template string, count long")


def templates(df: DataFrame, text: str, line: str | None = None, **options) -> DataFrame:
    """template, template_id, count; with a column of line numbers also a sample and the first and last line. By count descending, then template, where it is shown."""
    if line is None:
        found = drain(df, text, **options).groupBy("template").agg(F.sum("count").alias("count"))
        return found.select("template", template_id("template").alias("template_id"), "count")
    own = with_template(df.select(F.col(text).alias("__text"), F.col(line).alias("__line")), "__text", **options).where("template is not null")
    per = own.groupBy("template").agg(F.count("*").alias("count"), F.min_by("__text", "__line").alias("sample"), F.min("__line").alias("first_line"), F.max("__line").alias("last_line"))
    return per.select("template", template_id("template").alias("template_id"), "count", "sample", "first_line", "last_line")


def with_template(df: DataFrame, text: str, name: str = "template", **options) -> DataFrame:
    """df with each line's template."""
    found = drain(df, text, **options).select(F.col("masked").alias("__m"), F.col("template").alias(name))
    return df.withColumn("__m", masked(text, options.get("filters"))).join(found, "__m", "left").drop("__m")


def report(df: DataFrame, text: str, form: str = "table", line: str | None = None, **options) -> str:
    """Templates as text: table (count and template), full (with lines and a sample below each), id (ids and templates), json."""
    import json

    rows = templates(df, text, line, **options).orderBy(F.desc("count"), "template").collect()
    if form == "json":
        return json.dumps([{k: v for k, v in r.asDict().items() if v is not None} for r in rows], ensure_ascii=False)
    if not rows:
        return "No templates found"
    if form == "id":
        return "\n".join(f"{r['template_id']}: {r['template']}" for r in rows)
    if form not in ("table", "full"):
        raise ValueError(f"unknown form: {form}")
    width = max(len(str(r["count"])) for r in rows)
    out = [f"templates ({len(rows)} items):"]
    for r in rows:
        out.append(f"  {r['count']:>{width}}  {r['template']}")
        if form == "full" and line is not None:
            out += [f"  {'':>{width}}    lines {r['first_line']}-{r['last_line']}", f"  {'':>{width}}    sample: {r['sample']}"]
    return "\n".join(out)
