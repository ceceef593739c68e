"""URL filter: rules first, then gradient-boosted trees on lexical features of the url.

Labelled urls are those a rule decides; a sample of ``SAMPLE`` distinct ones at most, those with the
lowest hashes, is what is learned from. One half of it, by hash, gives the share of blocked
urls by host suffix; the trees are fitted on the other half, so that no label is seen twice. Trees
are grown level by level from histograms: each level is one aggregation by node, feature and
bin, whose result (nodes x features x bins) is all that the driver sees. The trees then are
one sum of CASE expressions over the features, evaluated in the scan. Suffixes with fewer than
``LEAST`` labels count as half blocked, so that the table of the others, which is broadcast, has
``SAMPLE`` / ``LEAST`` rows at most. Training and scoring are SQL expressions only.

Null urls and urls without "://" have empty host and path and are scored as such. Ties in
training go to the lower feature, then the lower bin. Repeated rows are judged each; columns of
other names are ignored; an empty table gives none; without both labels the verdict is allow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, saved

#: (host suffix, path prefix, verdict); the longest that fits wins
RULES = [("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block")]
#: Labelled urls that the trees are trained on, at most: those with the lowest hashes.
SAMPLE = 20_000
#: Labels that a host suffix needs to have a share of its own; the share of all others, in percent.
LEAST, SHARE = 20, 50
TREES, DEPTH, RATE, BINS, LEAF, SMOOTH = 8, 3, 0.4, 16, 5, 1.0


def after_scheme(url: Column) -> Column:
    """What follows the first "://"."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path, by the first "://"."""
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = after_scheme(url)
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), az, az.lower())
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*/([^?#]*)", 1)
    return host, path


def whole_path(url: Column) -> Column:
    """What follows the host up to "?" or "#", with the slash that it begins with."""
    return F.regexp_extract(after_scheme(url), r"(?s)\A[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as "host/path", and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}/{p}").otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Whole numbers: lengths, depths, shares in percent, entropy in hundredths of a bit."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    chars = F.split(u, "")
    seen = F.array_distinct(chars)
    entropy = F.aggregate(seen, F.lit(0.0), lambda s, c: s - (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n * F.log2((F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n))
    suffix = F.regexp_extract(host, r"([^.]*)\z", 1)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return {
        "url_length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_depth": count(host, "."),
        "path_depth": count(path, "/"),
        "digit_percent": F.floor(100 * (F.length(u) - F.length(F.translate(u, "0123456789", ""))) / n).cast("int"),
        "mark_percent": F.floor(100 * F.length(F.regexp_replace(u, "[A-Za-z0-9]", "")) / n).cast("int"),
        "entropy": F.when(F.length(u) == 0, 0).otherwise(F.floor(100 * F.round(entropy, 6))).cast("int"),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "suffix_length": F.length(suffix),
        "first_segment_length": F.length(F.regexp_extract(path, r"\A([^/]*)", 1)),
        "last_segment_length": F.length(F.regexp_extract(path, r"([^/]*)\z", 1)),
        "hyphens": count(host, "-"),
    }


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)\z", 1)


def suffix_statistics(labelled: DataFrame, least: int = LEAST) -> DataFrame:
    """(suffix, suffix_blocked): percent blocked by host suffix, of suffixes with ``least`` labels."""
    stats = labelled.groupBy("suffix").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("k"), F.count("*").alias("urls"))
    return stats.where(F.col("urls") >= least).select("suffix", F.floor(100 * F.col("k") / F.col("n")).cast("int").alias("suffix_blocked"))


class Model:
    """Boosted trees: ``score`` is their sum as one expression over feature columns."""

    def __init__(self, names: list[str], bias: float, trees: list[dict]):
        self.names, self.bias, self.trees = names, bias, trees

    def tree(self, tree: dict, node: int = 1) -> Column:
        if "value" in tree[node]:
            return F.lit(tree[node]["value"])
        at = tree[node]
        return F.when(F.col(at["feature"]) <= at["most"], self.tree(tree, 2 * node)).otherwise(self.tree(tree, 2 * node + 1))

    def score(self) -> Column:
        out = F.lit(self.bias)
        for t in self.trees:
            out = out + self.tree(t)
        return out


def _node(tree: dict, node: int = 1) -> Column:
    """The leaf so far that a row falls into."""
    if "feature" not in tree.get(node, {}):
        return F.lit(node)
    return F.when(F.col(tree[node]["feature"]) <= tree[node]["most"], _node(tree, 2 * node)).otherwise(_node(tree, 2 * node + 1))


def train(rows: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH) -> Model | None:
    """Logistic boosting of rows with 0/1 ``y``, weight ``w`` and whole-number features."""
    n, k = rows.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.col("w") * F.col("y")), F.lit(0))).head()
    if not 0 < k < n:
        return None
    cuts = rows.select(*(F.array_distinct(F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 1000)).alias(c) for c in names)).head()
    cuts = {c: sorted(set(cuts[c])) for c in names}
    bias = math.log(k / (n - k))
    grown: list[dict] = []
    for _ in range(trees):
        p = 1 / (1 + F.exp(-Model(names, bias, grown).score()))
        # sums of whole numbers do not depend on the order of adding
        base = rows.select("*", F.round((F.col("y") - p) * 1e6).cast("long").alias("_g"), F.round(p * (1 - p) * 1e6).cast("long").alias("_q"))
        tree: dict = {}
        for level in range(depth + 1):
            bins = F.array(*(F.struct(F.lit(i).alias("f"), sum((F.when(F.col(c) > x, 1).otherwise(0) for x in cuts[c]), F.lit(0)).alias("b")) for i, c in enumerate(names)))
            if level == depth:
                bins = F.array(F.struct(F.lit(0).alias("f"), F.lit(0).alias("b")))
            cells = base.select(_node(tree).alias("node"), "w", "_g", "_q", F.explode(bins).alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum(F.col("w") * F.col("_g")).alias("g"), F.sum(F.col("w") * F.col("_q")).alias("q"), F.sum("w").alias("n")).collect()
            hist: dict = {}
            for r in cells:
                hist.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"] / 1e6, r["q"] / 1e6, r["n"])
            for node, by in hist.items():
                if "value" in tree.get(node, {}):
                    continue
                g, q, m = (sum(x[i] for x in by[0].values()) for i in range(3))
                best = None
                for f, col in sorted(by.items()) if level < depth else ():
                    a, b, c = 0.0, 0.0, 0
                    for x, most in enumerate(cuts[names[f]]):
                        a, b, c = (s + v for s, v in zip((a, b, c), col.get(x, (0, 0, 0)), strict=True))
                        if min(c, m - c) >= LEAF:
                            gain = a * a / (b + SMOOTH) + (g - a) ** 2 / (q - b + SMOOTH) - g * g / (q + SMOOTH)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, names[f], most)
                tree[node] = {"feature": best[1], "most": best[2]} if best else {"value": RATE * g / (q + SMOOTH)}
        grown.append(tree)
    return Model(names, bias, grown)


def ruled(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, suffix, rule, ruled)."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return rows.select("*", suffix_of(F.col("host")).alias("suffix"), rule.alias("rule"), verdict.alias("ruled"))


def with_features(rows: DataFrame, stats: DataFrame, *keep: str) -> DataFrame:
    feats = {n: c.cast("int").alias(n) for n, c in features(F.col("url"), F.col("host"), F.col("path")).items()}
    # as many rows as a sample has suffixes with LEAST labels, at most
    known = rows.join(F.broadcast(stats), "suffix", "left")
    return known.select(*keep, *feats.values(), F.coalesce("suffix_blocked", F.lit(SHARE)).alias("suffix_blocked"))


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[str], Model | None]:
    """Suffix statistics, feature names and trees of the ruled among ``rows``."""
    labelled = rows.where("ruled IS NOT NULL").select("url", "host", "path", "suffix", (F.col("ruled") == "block").cast("int").alias("y"))
    # equal urls are one weighted row; the lowest hashes of urls are the sample
    few = labelled.groupBy("url", "host", "path", "suffix", "y").agg(F.count("*").alias("w")).orderBy(F.xxhash64("url"), "url").limit(sample)
    few = saved(few, "url-sample")
    half = F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2))
    stats = saved(suffix_statistics(few.where(half == 0)), "url-suffixes")
    names = [*features(F.col("url"), F.col("host"), F.col("path")), "suffix_blocked"]
    training = with_features(few.where(half == 1), stats, "y", "w").groupBy("y", *names).agg(F.sum("w").alias("w"))
    training = saved(training.coalesce(1), "url-training")
    model = train(training, names)
    release(training)
    release(few)
    return stats, names, model


def judge(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, url_path): path is without the slash it begins with,
    url_path with it; score is the trees' log-odds of block."""
    rows = ruled(pages)
    stats, _, model = fit(rows, sample)
    score = model.score() if model else F.lit(-1.0)
    out = with_features(rows, stats, "page_id", "host", "path", "rule", "ruled", "url")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"), whole_path(F.col("url")).alias("url_path"))
