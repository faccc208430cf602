"""URL filter: host and path rules, and a character language-model ratio where no rule fits, in DataFrame functions.

URLs that a rule allows or blocks teach two Markov models of variable order: Witten-Bell smoothing mixes the orders by
how many continuations each context has shown. A URL without a rule is judged by the difference of its log-likelihoods
per character against a threshold calibrated on labelled URLs that were held out of the counts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, rows_at_most, stored

#: Longest gram: a character and the context before it.
ORDER = 5
#: Log ratios are kept as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
FOLDS = 5
START, END = "\x02", "\x03"
#: Up to this number of grams (some 40 bytes each) the model is broadcast to the URLs, beyond it joined by shuffle.
BROADCAST_GRAMS = 300_000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    """Lower-cased host; empty for null and for texts without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and starts the path; else NULL."""
    kind = "struct<rule:string,verdict:string>"
    found = F.lit(None).cast(kind)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(text: Column) -> Column:
    """Every character and the end mark, each with the ORDER - 1 characters before it."""
    padded = F.concat(F.lit(START * (ORDER - 1)), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def model(counts: DataFrame) -> DataFrame:
    """(gram, lr): log ratio of every gram, in millionths, from counts (gram, a, r) of both classes.

    Order by order: P(g) = (c(g) + T P'(g)) / (C + T), where C counts the context, T the distinct characters seen
    after it and P' is the estimate of the next lower order; the lowest mixes with a uniform one. A context that was
    never seen leaves P' as it is.
    """
    lower: DataFrame | None = None
    for k in range(1, ORDER + 1):
        level = (counts.groupBy(F.substring("gram", ORDER + 1 - k, k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
                 .withColumn("ctx", F.substring("g", 1, k - 1)))
        seen = level.groupBy("ctx").agg(
            F.sum("a").alias("ca"), F.sum("r").alias("cr"), F.count(F.lit(1)).alias("v"),
            F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("r") > 0).cast("long")).alias("tr"))
        level = level.join(seen, "ctx")
        if lower is None:
            level = level.withColumns({"pa0": 1 / F.col("v"), "pr0": 1 / F.col("v")})
        else:
            below = lower.select(F.col("g").alias("tail"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0"))
            level = level.withColumn("tail", F.substring("g", 2, k - 1)).join(below, "tail")
        mixed = lambda c, t, n, p: F.when(F.col(n) > 0, (F.col(c) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p))
        lower = level.select("g", mixed("a", "ta", "ca", "pa0").alias("pa"), mixed("r", "tr", "cr", "pr0").alias("pr"))
    return lower.select(F.col("g").alias("gram"), F.round((F.log("pa") - F.log("pr")) * UNIT).cast("long").alias("lr"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: (id_col, host, path, rule, verdict, ratio).

    ``verdict`` is the rule's, else ``allow`` if ``ratio``, the log-likelihood difference per character, reaches the
    calibrated threshold and ``block`` below it. Null URLs are judged as empty ones. Equal URLs are counted by their
    number and judged once. If a class is missing among the held-out URLs the threshold is 0; without any labelled
    URL all ratios are 0 and the verdict is ``allow``. Other columns are not read.

    Counts come from all rows; a fifth of the distinct URLs (by md5) is held out for the threshold.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).withColumn("text", ascii_lower(F.coalesce("url", F.lit(""))))
    urls = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    # The rule of a text is that of all its spellings in capitals, as far as the path has none.
    urls = urls.withColumns({"verdict": rule_of(host(F.col("text")), path(F.col("text")), rules)["verdict"],
                             "held": F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 4), 16, 10).cast("int") % FOLDS == 0})
    urls = stored(urls)
    taught = lambda v: F.when((F.col("verdict") == v) & ~F.col("held"), F.col("n")).otherwise(F.lit(0))
    grams = urls.select("n", taught("allow").alias("a"), taught("block").alias("r"), F.explode(_grams(F.col("text"))).alias("gram"))
    ratios = stored(model(grams.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))))
    if rows_at_most(ratios, BROADCAST_GRAMS):
        ratios = F.broadcast(ratios)
    each = urls.select("text", "n", "verdict", "held", F.explode(_grams(F.col("text"))).alias("gram")).join(ratios, "gram")
    scored = stored(each.groupBy("text").agg(F.first("n").alias("n"), F.first("verdict").alias("verdict"), F.first("held").alias("held"),
                                             (F.sum("lr") / F.count("lr") / UNIT).alias("ratio")))
    threshold = calibrated(scored)
    by_ratio = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    found = rows.join(scored.select("text", "ratio"), "text").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    found = found.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"),
                        F.coalesce("hit.verdict", by_ratio).alias("verdict"), "ratio")


def calibrated(scored: DataFrame) -> float:
    """The ratio as many standard deviations below the held-out allowed mean as above the blocked one."""
    rows = scored.where(F.col("held") & F.col("verdict").isNotNull())
    w, x = F.col("n"), F.col("ratio")
    sums = {r["verdict"]: r for r in rows.groupBy("verdict").agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("s"), F.sum(w * x * x).alias("q")).collect()}
    if len(sums) < 2:
        return 0.0
    mean = {v: r["s"] / r["n"] for v, r in sums.items()}
    sd = {v: max(r["q"] / r["n"] - mean[v] ** 2, 0.0) ** 0.5 for v, r in sums.items()}
    if sd["allow"] + sd["block"] == 0:
        return (mean["allow"] + mean["block"]) / 2
    return (mean["allow"] * sd["block"] + mean["block"] * sd["allow"]) / (sd["allow"] + sd["block"])


def sql(rules: list[Rule]) -> str:
    """The same as DuckDB SQL over ``pages``, without the ratio."""
    def parsed(url: str) -> tuple[str, str]:
        pattern = PARTS.replace("'", "''")
        return (f"coalesce(translate(regexp_extract({url}, '{pattern}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')",
                f"coalesce(regexp_extract({url}, '{pattern}', 2), '')")

    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    whens = lambda out: " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(v, h, p)}'" for v, h, p in longest)
    rule, verdict = (f"CASE {whens(f)} END" for f in (lambda v, h, p: h + p, lambda v, h, p: v))
    th, tp = parsed("text")
    uh, up = parsed("url")
    parts = [f"""rows_ AS (SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM pages),
u0 AS (SELECT text, count(*) AS n, {th} AS host, {tp} AS path FROM rows_ GROUP BY text),
urls AS (SELECT text, n, {verdict} AS verdict, CAST('0x' || substr(md5(text), 1, 4) AS INTEGER) % {FOLDS} = 0 AS held FROM u0),
ex AS (SELECT text, n, verdict, held, substr(repeat(chr(2), {ORDER - 1}) || text || chr(3), i, {ORDER}) AS gram
  FROM urls, unnest(range(1, length(text) + 2)) AS t(i)),
gr AS (SELECT gram, sum(CASE WHEN verdict = 'allow' AND NOT held THEN n ELSE 0 END) AS a,
  sum(CASE WHEN verdict = 'block' AND NOT held THEN n ELSE 0 END) AS r FROM ex GROUP BY gram)"""]
    for k in range(1, ORDER + 1):
        below = "1.0::DOUBLE / v AS pa0, 1.0::DOUBLE / v AS pr0 FROM l1 JOIN s1 USING (ctx)" if k == 1 else (
            f"m{k - 1}.pa AS pa0, m{k - 1}.pr AS pr0 FROM l{k} JOIN s{k} USING (ctx) JOIN m{k - 1} ON m{k - 1}.g = substr(l{k}.g, 2)")
        parts.append(f"""l{k} AS (SELECT substr(gram, {ORDER + 1 - k}) AS g, substr(gram, {ORDER + 1 - k}, {k - 1}) AS ctx, sum(a) AS a, sum(r) AS r FROM gr GROUP BY 1, 2),
s{k} AS (SELECT ctx, sum(a) AS ca, sum(r) AS cr, count(*) AS v, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM l{k} GROUP BY ctx),
j{k} AS (SELECT l{k}.g, l{k}.a, l{k}.r, ca, cr, ta, tr, {below}),
m{k} AS (SELECT g, CASE WHEN ca > 0 THEN (a::DOUBLE + ta::DOUBLE * pa0) / (ca + ta)::DOUBLE ELSE pa0 END AS pa,
  CASE WHEN cr > 0 THEN (r::DOUBLE + tr::DOUBLE * pr0) / (cr + tr)::DOUBLE ELSE pr0 END AS pr FROM j{k})""")
    parts.append(f"""lr AS (SELECT g AS gram, CAST(round((ln(pa) - ln(pr)) * {UNIT}) AS BIGINT) AS lr FROM m{ORDER}),
scored AS (SELECT text, any_value(n) AS n, any_value(verdict) AS verdict, bool_or(held) AS held,
  CAST(sum(lr) AS DOUBLE) / count(lr) / {UNIT} AS ratio FROM ex JOIN lr USING (gram) GROUP BY text),
st AS (SELECT verdict, sum(n * ratio) / sum(n) AS m, sqrt(greatest(sum(n * ratio * ratio) / sum(n) - (sum(n * ratio) / sum(n)) ** 2, 0)) AS sd
  FROM scored WHERE held AND verdict IS NOT NULL GROUP BY verdict),
ba AS (SELECT a.m AS ma, a.sd AS sa, b.m AS mb, b.sd AS sb FROM st a, st b WHERE a.verdict = 'allow' AND b.verdict = 'block'),
th AS (SELECT coalesce(max(CASE WHEN sa + sb = 0 THEN (ma + mb) / 2 ELSE (ma * sb + mb * sa) / (sa + sb) END), 0) AS t FROM ba),
f AS (SELECT page_id, text, {uh} AS host, {up} AS path FROM rows_)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN ratio >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM (SELECT f.*, s.ratio, th.t FROM f JOIN scored s ON s.text = f.text, th)""")
    return "WITH " + ",\n".join(parts)
