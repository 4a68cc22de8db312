"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule names a host, with its subdomains, and the beginning of a path; the
longest that fits decides. URLs that a rule fits are the labelled ones. Trees
are fitted to a bounded sample of them, on features of the URL's letters and
on the share of allowed URLs by host suffix and by first path segment, taken
from all labelled rows. They are then written out as one column expression.
Only DataFrame functions touch the pages.

Defined cases: null URLs and those without ``://`` have an empty host and
path, fit no rule and are judged by the trees like any other; repeated rows
are judged each for itself; other columns are ignored; without labelled URLs
of both kinds everything unlabelled gets the more frequent verdict, or
``allow`` if there are none; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, rule)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
NUMBERS = ("length", "host_length", "host_labels", "depth", "path_length", "digits", "entropy", "params", "dashes", "secure", "fragment", "suffix_allowed", "segment_allowed")
SAMPLE, TREES, DEPTH, RATE, BINS, SMOOTH = 20_000, 40, 3, 0.3, 16, 10.0
BROADCAST_ROWS = 20_000


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("")
    out = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring("_rest", F.length(host) + 1, F.length("_rest")), r"^[^?#]*", 0)
    return out.withColumns({"host": F.translate(host, ALPHABET, ALPHABET.lower()), "path": path}).drop("_rest")


def with_rule(parts: DataFrame, rules=RULES) -> DataFrame:
    """``parts`` with rule and rule_verdict, null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    rule = verdict = None
    for said, text in order:
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule = rule.when(fits, text) if rule is not None else F.when(fits, text)
        verdict = verdict.when(fits, said) if verdict is not None else F.when(fits, said)
    none = F.lit(None).cast("string")
    return parts.withColumns({"rule": none if rule is None else rule, "rule_verdict": none if verdict is None else verdict})


def with_numbers(parts: DataFrame) -> DataFrame:
    """``parts`` with the lexical features, whole numbers, and the host's suffix and first path segment."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))).cast("double") / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = n - F.length(F.translate(url, "0123456789", ""))
    numbers = {
        "length": n,
        "host_length": F.length("host"),
        "host_labels": F.length("host") - F.length(F.translate("host", ".", "")),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "path_length": F.length("path"),
        "digits": F.coalesce(F.floor(F.try_divide(100 * digits, n)), F.lit(0)),
        "entropy": F.when(n > 0, F.floor(10 * entropy)).otherwise(0),
        "params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "dashes": F.length("path") - F.length(F.translate("path", "-_", "")),
        "secure": url.startswith("https").cast("int"),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    return parts.withColumns({**{k: v.cast("int") for k, v in numbers.items()}, "_suffix": F.element_at(F.split("host", r"\."), -1), "_segment": F.regexp_extract("path", "^/([^/]*)", 1)})


def _rates(labelled: DataFrame, by: str, name: str, overall: float) -> DataFrame:
    """Per cent of allowed URLs by a column, drawn towards the overall share where URLs are few."""
    rate = (F.sum("y") + SMOOTH * overall) / (F.count("*") + SMOOTH)
    return labelled.groupBy(by).agg(F.floor(100 * rate).cast("int").alias(name))


def _joined(rows: DataFrame, rates: DataFrame, by: str) -> DataFrame:
    """By broadcast if the counted rows are few, else by a shuffle that Spark splits where skewed."""
    few = rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(rates) if few else rates, by, "left")


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list]:
    """Start value and trees of a logistic model. A tree is a number or (feature, threshold, tree if <= threshold, other tree)."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1)
    share = float(np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    score, found = np.full(len(y), start), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        G, H = g[rows].sum(), h[rows].sum()
        leaf = float(rate * G / (H + 1.0))
        best = (1e-6, None)
        if left:
            for f in range(x.shape[1]):
                k = len(cuts[f]) + 1
                gs, hs = (np.cumsum(np.bincount(binned[rows, f], v[rows], k))[:-1] for v in (g, h))
                ok = (hs > 1.0) & (H - hs > 1.0)
                gain = np.where(ok, gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, int(np.argmax(gain))))
        if best[1] is None:
            score[rows] += leaf
            return leaf
        f, b = best[1]
        low = binned[rows, f] <= b
        return (f, float(cuts[f][b]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        found.append(grow(np.arange(len(y)), weight * (y - p), weight * p * (1 - p), depth))
    return start, found


def _expression(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(F.col(NUMBERS[f]) <= cut, _expression(low)).otherwise(_expression(high))


def scored(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of allow) for every page."""
    rows = written(with_numbers(with_rule(with_parts(pages.select("page_id", "url")), rules)), "urls")
    labelled = rows.filter("rule IS NOT NULL").withColumn("y", (F.col("rule_verdict") == "allow").cast("int"))
    n, allowed = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    overall = (allowed + 1) / (n + 1)
    for by, name in (("_suffix", "suffix_allowed"), ("_segment", "segment_allowed")):
        rows = _joined(rows, written(_rates(labelled, by, name, overall), "rates"), by)
        rows = rows.withColumn(name, F.coalesce(name, F.lit(int(100 * overall))))
    if 0 < allowed < n:
        # A share of the labelled rows by hash: about ``sample`` of them reach the driver.
        part = F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / n))
        y = (F.col("rule_verdict") == "allow").cast("int").alias("y")
        fit = rows.filter("rule IS NOT NULL").filter(part).groupBy(*NUMBERS, y).agg(F.count("*").alias("n")).orderBy(*NUMBERS, "y").collect()
        data = np.array([tuple(r) for r in fit], np.float64).reshape(-1, len(NUMBERS) + 2)
        start, trees = boosted(data[:, :-2], data[:, -2], data[:, -1])
    else:
        start, trees = (5.0 if allowed or not n else -5.0), []
    odds = F.lit(start)
    for t in trees:
        odds = odds + _expression(t)
    # Stored, so that the trees are walked once and not again for the verdict.
    out = written(rows.select("page_id", "host", "path", "rule", "rule_verdict", (1 / (1 + F.exp(-odds))).alias("score")), "scores")
    said = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", said).alias("verdict"), "score")
