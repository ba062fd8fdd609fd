"""URL filter: rules, and gradient-boosted trees on lexical features for what no rule covers.

Everything on the main path is DataFrame expressions and Spark's own tree learner; no Python runs on executors.
The trees learn from labelled URLs: those given, or else those that the rules decide. Training reads at most
`train_rows` of them, taken by the hash of the URL; that bound is the only sample here. Suffix statistics are counted
over all labelled URLs; a URL that is trained on has those of the other folds by host only, as its own label must not
tell itself. A suffix without any gets the overall share.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the
end. Defined cases: a null url or one without `://` has empty host and path, fits no rule and is judged by
the trees; with labels of one class only (or none), undecided urls get that class (or allow); repeated rows
give repeated results; an empty table gives an empty result; columns other than the id and url are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# The rules (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
FOLDS, SMOOTHING = 5, 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_length", "f_host", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_suffix", "f_suffix2", "f_suffix_n"]


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as text and as verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for _, h, p in ordered]
    return (
        F.coalesce(*[F.when(c, h + p) for c, (_, h, p) in zip(fits, ordered)]),
        F.coalesce(*[F.when(c, v) for c, (v, _, _) in zip(fits, ordered)]),
    )


def _lexical(df: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    count = lambda c, x: (F.char_length(c) - F.char_length(F.replace(c, F.lit(x), F.lit("")))).cast("double")
    chars = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    share = lambda c: (F.char_length(url) - F.char_length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.char_length(F.regexp_replace(url, "[^0-9]", "")) / n
    labels = F.split("host", r"\.")
    last = F.element_at(labels, -1)
    return df.withColumns(
        {
            "f_length": n,
            "f_host": F.char_length("host").cast("double"),
            "f_depth": count(F.col("path"), "/"),
            "f_labels": F.size(labels).cast("double"),
            "f_digits": digits,
            "f_entropy": entropy,
            "f_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0),
            "f_hyphens": count(F.col("host"), "-"),
            "suffix": last,
            "suffix2": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        }
    )


def _suffix_stats(labelled: DataFrame, share: float) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Shares of blocked urls, smoothed towards the overall share, by last label and by last two labels of the host: over
    all labelled urls, and over those of other folds by (label, fold), for rows that are trained on."""
    out = {}
    for key in ("suffix", "suffix2"):
        by_fold = labelled.groupBy(key, "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
        by_fold = materialize(by_fold, f"urls-{key}")
        every = Window.partitionBy(key)
        smooth = lambda s, n: (s + SMOOTHING * share) / (n + SMOOTHING)
        rest_s, rest_n = F.sum("s").over(every) - F.col("s"), F.sum("n").over(every) - F.col("n")
        others = by_fold.select(key, "fold", smooth(rest_s, rest_n).alias(f"f_{key}"), rest_n.alias(f"_n_{key}"))
        whole = by_fold.groupBy(key).agg(smooth(F.sum("s"), F.sum("n")).alias(f"f_{key}"), F.sum("n").alias(f"_n_{key}"))
        out[key] = (whole, others)
    return out


def _with_suffix_stats(df: DataFrame, stats: dict[str, tuple[DataFrame, DataFrame]], share: float, trained: bool) -> DataFrame:
    """df with the statistics; a suffix that no labelled url (of another fold) has gets the overall share."""
    for key, (whole, others) in stats.items():
        df = df.join(others if trained else whole, [key, "fold"] if trained else key, "left").fillna({f"f_{key}": share})
    return df.withColumn("f_suffix_n", F.log1p(F.coalesce("_n_suffix2", F.lit(0)).cast("double"))).drop("_n_suffix", "_n_suffix2")


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    labels: DataFrame | None = None,
    train_rows: int = 20_000,
    trees: int = 8,
    depth: int = 3,
    threshold: float = 0.5,
) -> DataFrame:
    """(id, url, host, path, rule, verdict, blocked_score); blocked_score is null where a rule decides. labels: labelled
    urls (url, blocked), of which those without either take no part."""
    host, path = split_url(F.col("url"))
    base = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    base = base.withColumns({"host": host, "path": path})
    rule, by_rule = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "by_rule": by_rule})
    if labels is None:
        known = base.where("by_rule is not null").select("url", "host", "path", (F.col("by_rule") == "block").cast("double").alias("label"))
    else:
        host, path = split_url(F.col("url"))
        known = labels.where("url is not null and blocked is not null").select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("boolean").cast("double").alias("label")).withColumns({"host": host, "path": path})
    # a host's urls are in one fold, so that no trained row's statistics know its host
    names = _lexical(known).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    share = names.agg(F.avg("label")).first()[0] or 0.0
    stats = _suffix_stats(names, share)
    sample = _with_suffix_stats(names, stats, share, True)
    sample = materialize(
        sample.select("label", *FEATURES, F.xxhash64("url").alias("_o")).orderBy("_o").limit(train_rows).drop("_o").coalesce(4), "urls-train"
    )
    classes = {r[0] for r in sample.select("label").distinct().collect()}
    out = [F.col(id_col), "url", "host", "path", "rule"]
    if len(classes) < 2:
        only = "block" if classes == {1.0} else "allow"
        return base.select(*out, F.coalesce("by_rule", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("blocked_score"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    learner = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, labelCol="label", featuresCol="features")
    model = learner.fit(vector.transform(sample))
    scored = model.transform(vector.transform(_with_suffix_stats(_lexical(base), stats, share, False)))
    p = vector_to_array("probability")[1]
    return scored.select(
        *out,
        F.coalesce("by_rule", F.when(p > threshold, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("by_rule").isNull(), p).alias("blocked_score"),
    )
