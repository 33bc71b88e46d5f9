"""URL filter: rules by host and path, and for the other URLs a ratio of character language models.

URLs that the rules decide are the examples: one smoothed variable-order Markov model is fitted on the allowed ones,
one on the blocked ones (Witten-Bell interpolation over contexts of up to ORDER characters, case folded, digits as
one character). A URL's score is the difference of its log-likelihoods, divided by its length; the threshold is the
one that best separates the examples kept apart for calibration.

Every gram of the examples is kept. The counts are a table in the shared folder, as are the probabilities of the grams
that any URL needs, which are made order by order; scores are sums over a join of places with that table. Logarithms
are summed in steps of 1/STEPS, so that sums do not depend on the order of rows.

Null URLs, and those without `://`, have empty host and path and no rule. A null or empty URL scores 0 and is blocked;
without examples of both kinds all other URLs are allowed. Ties between rules of one length go to the first listed.
Very long URLs are scored whole. Repeated rows get a row each, an empty table no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm import common

#: Characters of context at most.
ORDER = 5
#: One example in so many calibrates the threshold; the others fit the models.
CALIBRATE = 5
#: Characters that are possible anywhere, for the uniform end of the interpolation.
ALPHABET = 256
#: Width of the bins, in nats a character, in which calibration scores are counted.
BIN = 0.005
#: Steps in a nat, in which log-likelihoods are summed.
STEPS = 1 << 32
# Host, path and verdict of the rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a URL."""
    text = F.coalesce(F.col(url), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(text, pattern, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, pattern, 2)


def with_rules(pages: DataFrame, rules=RULES, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, url, host, path, rule, ruled: the longest rule that fits, and its verdict."""
    host, path = parts(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule = ruled = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        ruled = F.when(fits, F.lit(verdict)) if ruled is None else ruled.when(fits, F.lit(verdict))
    none = F.lit(None).cast("string")
    return rows.withColumns({"rule": none if rule is None else rule, "ruled": none if ruled is None else ruled})


def normal(url: Column) -> Column:
    """What the models read of a URL."""
    return F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")


def _grams(text: Column, least: int = 1) -> Column:
    """Grams of `least` to ORDER+1 characters that end at each place of a text. Texts are padded in front, so that every
    place has a context of each length."""
    padded = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    return F.flatten(F.transform(
        F.sequence(F.lit(ORDER + 1), F.length(padded)),
        lambda i: F.transform(F.sequence(F.lit(least), F.lit(ORDER + 1)), lambda k: F.substring(padded, i - k + 1, k))))


def ngrams(examples: DataFrame) -> DataFrame:
    """(ruled, gram, n) of (ruled, text): grams of 1 to ORDER+1 characters, the last one predicted by the others."""
    return examples.select("ruled", F.explode(_grams(F.col("text"))).alias("gram")).groupBy("ruled", "gram").agg(F.count(F.lit(1)).alias("n"))


class Markov:
    """Interpolated model of the grams of one class, in memory: what ratios() computes by joins."""

    def __init__(self, grams: dict[str, int]):
        self.grams = grams
        self.seen: dict[str, list[int]] = {}  # context -> [count, different followers]
        for gram, n in grams.items():
            entry = self.seen.setdefault(gram[:-1], [0, 0])
            entry[0] += n
            entry[1] += 1
        self.known: dict[str, float] = {}

    def probability(self, gram: str) -> float:
        """Of the last character after the others."""
        found = self.known.get(gram)
        if found is None:
            lower = self.probability(gram[1:]) if len(gram) > 1 else 1.0 / ALPHABET
            n, kinds = self.seen.get(gram[:-1], (0, 0))
            found = (self.grams.get(gram, 0) + kinds * lower) / (n + kinds) if n else lower
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[gram] = found
        return found

    def log_likelihood(self, text: str) -> float:
        padded = "\x02" * ORDER + text + "\x03"
        return sum(math.log(self.probability(padded[i - ORDER : i + 1])) for i in range(ORDER, len(padded)))


def difference(accepted: Markov, rejected: Markov, text: str) -> float:
    """Length-normalised log-likelihood difference; above 0 the text is more like the accepted ones."""
    return (accepted.log_likelihood(text) - rejected.log_likelihood(text)) / (len(text) + 1) if text else 0.0


def ratios(texts: DataFrame) -> DataFrame:
    """(gram, places, ratio): for each gram of ORDER+1 characters in the texts, its places in them, and the difference of
    its log-probabilities, in steps, by the models of all grams of the texts that count as allow and as block.
    texts: (text, allow, block), the last two being how often a text is an example."""
    counts = texts.select("allow", "block", F.explode(_grams(F.col("text"))).alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("places"), F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    counts = counts.withColumns({"order": F.length("gram"), "context": F.expr("left(gram, length(gram) - 1)")})
    same = Window.partitionBy("context")  # as many rows as there are characters, at most
    for v in ("allow", "block"):
        counts = counts.withColumns({f"{v}_seen": F.sum(v).over(same), f"{v}_kinds": F.count_if(F.col(v) > 0).over(same)})
    counts = common.materialize(counts.drop("context"), "grams")

    def probability(v: str, lower: Column) -> Column:
        seen, kinds = F.col(f"{v}_seen"), F.col(f"{v}_kinds")
        return F.when(seen > 0, (F.col(v) + kinds * lower) / (seen + kinds)).otherwise(lower).alias(f"{v}_p")

    known = None
    for k in range(1, ORDER + 2):
        rows = counts.filter(F.col("order") == k)
        if known is None:
            lower = {v: F.lit(1.0 / ALPHABET) for v in ("allow", "block")}
        else:
            rows = rows.join(known.select(F.col("gram").alias("shorter"), F.col("allow_p").alias("allow_l"), F.col("block_p").alias("block_l")), F.expr("substring(gram, 2)") == F.col("shorter"))
            lower = {v: F.col(f"{v}_l") for v in ("allow", "block")}
        known = rows.select("gram", "places", *[probability(v, lower[v]) for v in ("allow", "block")])
    return known.select("gram", "places", F.round((F.log("allow_p") - F.log("block_p")) * STEPS).cast("long").alias("ratio"))


def scored(texts: DataFrame) -> DataFrame:
    """Adds score to the distinct texts (id, text, allow, block), of which some are examples of allow, and of block."""
    table = common.materialize(ratios(texts), "ratios")
    places = texts.filter("text <> ''").select("id", F.explode(_grams(F.col("text"), ORDER + 1)).alias("gram"))
    total = table.agg(F.sum("places")).first()[0]
    sums = common.left_join_groups(places, table, ["gram"], "places", total).groupBy("id").agg(F.sum("ratio").alias("sum"))
    score = F.coalesce(F.col("sum") / F.lit(float(STEPS)) / (F.length("text") + 1), F.lit(0.0))
    return texts.join(sums, "id", "left").withColumn("score", score).drop("sum")


def threshold(calibration: DataFrame) -> float:
    """The score from which to allow: where the share of allowed examples above and of blocked ones below is greatest.
    calibration: (score, ruled, n). The driver sees counts by bin and verdict."""
    bins = calibration.groupBy(F.floor(F.col("score") / BIN).alias("bin"), "ruled").agg(F.sum("n").alias("count")).collect()
    total = {v: sum(r["count"] for r in bins if r["ruled"] == v) for v in ("allow", "block")}
    if not total["allow"] or not total["block"]:
        return 0.0
    edges = sorted({r["bin"] for r in bins} | {max(r["bin"] for r in bins) + 1})
    def worth(edge: int) -> float:
        return sum(r["count"] for r in bins if r["ruled"] == "allow" and r["bin"] >= edge) / total["allow"] + sum(r["count"] for r in bins if r["ruled"] == "block" and r["bin"] < edge) / total["block"]
    best = max(map(worth, edges))
    good = [e for e in edges if worth(e) == best]
    return good[len(good) // 2] * BIN


def judge(pages: DataFrame, rules=RULES, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per page."""
    rows = with_rules(pages, rules, url_col, id_col).withColumn("text", normal(F.col("url")))
    apart = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("text")), F.lit(CALIBRATE)) == 0
    by = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("ruled") == v).alias(v) for v in ("allow", "block")])
    by = by.select("text", "n", *[F.when(apart, 0).otherwise(F.col(v)).alias(v) for v in ("allow", "block")], *[F.when(apart, F.col(v)).otherwise(0).alias(f"{v}_apart") for v in ("allow", "block")])
    texts = common.materialize(by.withColumn("id", F.monotonically_increasing_id()), "urls")
    count = texts.agg(F.sum("n"), F.sum("allow"), F.sum("block")).first()
    both = bool(count[1] and count[2])
    found = common.materialize(scored(texts), "scores") if both else texts.withColumn("score", F.lit(0.0))
    held = [found.filter(F.col(f"{v}_apart") > 0).select("score", F.lit(v).alias("ruled"), F.col(f"{v}_apart").alias("n")) for v in ("allow", "block")]
    limit = threshold(held[0].unionByName(held[1])) if both else 0.0
    method = F.when(F.col("text") == "", "block").when(F.col("score") >= limit, "allow").otherwise("block")
    judged = common.left_join_groups(rows, found.select("text", "n", "score"), ["text"], "n", count[0] or 0)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
