"""URL filters: rules by host and path, and boosted trees for all other URLs.

The trees see lexical features: lengths, depth, digit ratio, entropy, numbers of
parameters and hyphens, and the log odds of the host's suffix, of its last two
labels and of the path's first part, counted over all labelled URLs.  They are
trained on a sample of at most ``SAMPLE`` labelled rows, chosen by a hash of the
row's id and URL, which goes to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import bounded_sample, refuse_clash, small_batches

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, SMOOTH = 60, 3, 0.2, 32, 20, 20.0

#: (verdict, host, path) of the production rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own_host, own_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule = F.when(fits, F.lit(own_host + own_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _keys(host: str, path: str) -> tuple[str, str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), (path.split("/") + [""])[1] if path else ""


def features(url: str, host: str, path: str, odds: tuple[dict, dict, dict]) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    digits = sum("0" <= c <= "9" for c in url)
    return [
        len(url),
        len(host),
        len(path),
        host.count("."),
        sum(1 for x in path.split("/") if x),
        digits / max(1, len(url)),
        sum("0" <= c <= "9" for c in host),
        _entropy(url),
        _entropy(host),
        query.count("&") + 1 if query else 0,
        url.count("-"),
        float(url.startswith("https")),
        float("#" in url),
        *(table.get(key, 0.0) for table, key in zip(odds, _keys(host, path), strict=True)),
    ]


def suffix_odds(labelled: DataFrame) -> tuple[dict, dict, dict]:
    """Smoothed log odds of a blocked URL by suffix, last two labels, and first part of the path."""
    host, part = F.col("host"), F.coalesce(F.get(F.split("path", "/"), 1), F.lit(""))
    keys = F.array(F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), part)
    y = F.col("blocked").cast("long")
    n, high = labelled.agg(F.count("*"), F.coalesce(F.sum(y), F.lit(0))).first()
    prior = (high + 1) / (n + 2)
    counted = labelled.select(F.posexplode(keys).alias("which", "key"), y.alias("y")).groupBy("which", "key").agg(F.count("*").alias("n"), F.sum("y").alias("high"))
    out = ({}, {}, {})
    for which, key, n, high in counted.filter(F.col("n") >= LEAST_LEAF).collect():
        p = (high + SMOOTH * prior) / (n + SMOOTH)
        out[which][key] = math.log(p / (1 - p)) - math.log(prior / (1 - prior))
    return out


@dataclass
class Trees:
    """Boosted trees of one depth: a feature and cut for each inner node, a value for each leaf."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss over histograms of the features."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for k in range(width)]
    binned = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") for k in range(width)], axis=1) if n else np.zeros((0, width), dtype=np.int64)
    rate = (y.sum() + 1) / (n + 2)
    start = math.log(rate / (1 - rate))
    margin, inner, leaves = np.full(n, start), 2**DEPTH - 1, 2**DEPTH
    features_, cuts_, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for at in range(inner):
            own = np.flatnonzero(node == at)
            best = 1e-6
            for k in range(width) if len(own) >= 2 * LEAST_LEAF else ():
                g = np.bincount(binned[own, k], weights=gradient[own], minlength=BINS).cumsum()
                h = np.bincount(binned[own, k], weights=weight[own], minlength=BINS).cumsum()
                c = np.bincount(binned[own, k], minlength=BINS).cumsum()
                gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
                gain[(c < LEAST_LEAF) | (c[-1] - c < LEAST_LEAF)] = 0
                gain[len(cuts[k]) :] = 0
                j = int(np.argmax(gain))
                if gain[j] > best:
                    best, feature[at], cut[at] = gain[j], k, cuts[k][j]
            node[own] = 2 * at + 1 + (x[own, feature[at]] > cut[at])
        leaf = node - inner
        g, h = np.bincount(leaf, weights=gradient, minlength=leaves), np.bincount(leaf, weights=weight, minlength=leaves)
        value = RATE * g / (h + 1)
        margin += value[leaf]
        features_.append(feature)
        cuts_.append(cut)
        values.append(value)
    return Trees(start, np.array(features_), np.array(cuts_), np.array(values))


def _scorer(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, odds = shared.value
        for batch in batches:
            url, host, path = (batch.column(batch.num_columns - 3 + k).to_pylist() for k in range(3))
            x = np.array([features(*row, odds) for row in zip(url, host, path, strict=True)], dtype=np.float64).reshape(len(url), -1)
            p = 1 / (1 + np.exp(-trees.margin(x))) if len(url) else np.zeros(0)
            yield pa.record_batch([*[batch.column(k) for k in range(batch.num_columns)], pa.array(p)], schema=schema)

    return run


def train(labelled: DataFrame, sample: int = SAMPLE, ids: tuple[str, ...] = ()) -> tuple[Trees, tuple[dict, dict, dict]]:
    """Trees, on at most ``sample`` rows, and suffix tables, of all rows, from (url, host, path, blocked).

    Rows are chosen by ``ids`` and the URL, so that copies of one URL are chosen apart.
    """
    rows = bounded_sample(labelled, sample, *ids, "url").select("url", "host", "path", F.col("blocked").cast("int")).collect()
    y = np.array([r[3] for r in rows], dtype=np.float64)
    odds = suffix_odds(labelled)
    x = np.array([features(r[0], r[1], r[2], odds) for r in rows], dtype=np.float64).reshape(len(rows), 16)
    return fit(x, y), odds


def judge(
    pages: DataFrame, labelled: DataFrame | None = None, carry: tuple[str, ...] = ("page_id",), url_column: str = "url", rules=RULES, sample: int = SAMPLE
) -> DataFrame:
    """A row per page: the carried columns, ``host``, ``path``, ``rule``, ``p_block``
    (of the trees) and ``verdict``: the longest fitting rule's, else block where
    the trees give it more than a half.

    ``labelled`` has ``url`` and ``blocked``, and may have carried columns; without it, the pages that a rule
    decides are the labelled URLs.  A null URL, or one without ``://``, has an
    empty host and path.  Without labelled URLs the trees say a half, which
    allows.  Repeated rows and null ids are judged row by row.  A carried column may
    not have the name of an added one or begin with two underscores (``ValueError``).
    """
    refuse_clash(carry, ("host", "path", "rule", "p_block", "verdict"))
    spark = pages.sparkSession
    small_batches(spark)
    host, path = host_and_path(F.col("__url"))
    located = lambda df: df.withColumns({"host": host, "path": path})
    rows = located(pages.select(*[pages[c] for c in carry], F.coalesce(pages[url_column].cast("string"), F.lit("")).alias("__url")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ids = carry if labelled is None else tuple(c for c in carry if c in labelled.columns)
    named = tuple(f"__id{k}" for k in range(len(ids)))
    if labelled is None:
        known = rows.select(*[F.col(c).alias(n) for c, n in zip(ids, named, strict=True)], F.col("__url").alias("url"), "host", "path", (verdict == "block").alias("blocked"))
        known = known.dropna(subset=["blocked"])
    else:
        own = labelled.dropna(subset=["url", "blocked"])
        own = own.select(*[own[c].alias(n) for c, n in zip(ids, named, strict=True)], own["url"].alias("__url"), "blocked")
        known = located(own).withColumnRenamed("__url", "url")
    shared = spark.sparkContext.broadcast(train(known, sample, named))
    schema = T.StructType([pages.schema[c] for c in carry] + [T.StructField(n, T.StringType()) for n in ("__url", "host", "path")] + [T.StructField("p_block", T.DoubleType())])
    scored = rows.select(*carry, "__url", "host", "path").mapInArrow(_scorer(shared, to_arrow_schema(schema)), schema)
    return scored.select(
        *carry,
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"),
        "p_block",
    )
