"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the urls that no rule fits."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyload.llm.common import per_text
from skyload.operators.staging import stage

#: Labelled urls that the trees are fitted to, about; and what they grow to.
TRAINING_URLS, TREES, DEPTH, STEP = 20_000, 20, 4, 0.3
#: Labelled urls that the overall share of blocked ones counts as in a suffix's own share.
PRIOR = 20.0
#: Host suffixes of one, two and three labels have statistics.
LEVELS = (1, 2, 3)

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict on a host, its subdomains and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parsed(pages: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, ruled): the parts of a url, and the longest rule that fits it with its verdict.

    The host is what follows the first ``://`` up to a slash, question mark, hash sign or the end, A-Z in lower case; the path goes on
    to a question mark, hash sign or the end. Both are empty for a null url and one without ``://``. Rules that fit and
    are equally long: the one with the longer host, then the one named first.
    """
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    begin = F.locate("://", url)
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.char_length(url))).otherwise("")
    rows = pages.select(F.col(id_column).alias("page_id"), url.alias("url"), rest.alias("rest")).select(
        "page_id",
        "url",
        F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), LETTERS.upper(), LETTERS).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    longest = sorted(rules, key=lambda rule: (len(rule.name), len(rule.host)), reverse=True)
    for rule in reversed(longest):
        fits = rule.fits(F.col("host"), F.col("path"))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return rows.select("*", name.alias("rule"), verdict.alias("ruled"))


def entropy(text: str) -> float:
    """Bits per character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def lexical(url: bytes) -> list[float]:
    """Lengths, depth, labels, digit shares, entropies, parameters and hyphens of a whole url."""
    text = url.decode()
    _, _, rest = text.partition("://")
    before, _, fragment = rest.partition("#")
    before, _, query = before.partition("?")
    host, slash, path = before.partition("/")
    segments = [segment for segment in path.split("/") if segment]
    digits = sum(map(str.isdigit, text))
    return [
        float(len(text)),
        float(len(host)),
        float(len(path)),
        float(len(query)),
        float(len(fragment)),
        float(len(segments)),
        float(host.count(".") + 1 if host else 0),
        digits / len(text) if text else 0.0,
        sum(map(str.isdigit, host)) / len(host) if host else 0.0,
        entropy(host),
        entropy(path),
        float(sum(1 for parameter in query.split("&") if parameter)),
        float(host.count("-")),
        float("." in segments[-1]) if segments else 0.0,
        float(bool(slash) and path.endswith("/")),
    ]


def suffix(host: Column, labels: int) -> Column:
    """The last labels of a host; null if it has fewer."""
    parts = F.split(host, "\\.")
    return F.when((host != "") & (F.size(parts) >= labels), F.substring_index(host, ".", -labels))


def suffix_counts(rows: DataFrame) -> DataFrame:
    """(suffix, urls, labelled, blocked) of every host suffix of one to three labels, over all rows; a written table."""
    each = F.array_compact(F.array(*[suffix(F.col("host"), labels) for labels in LEVELS]))
    exploded = rows.select(F.explode(each).alias("suffix"), "blocked")
    return stage(exploded.groupBy("suffix").agg(F.count(F.lit(1)).alias("urls"), F.count("blocked").alias("labelled"), F.sum("blocked").alias("blocks")))


def described(rows: DataFrame, share: float) -> DataFrame:
    """``rows`` with ``features``: the lexical ones, and per level of suffix its frequency and its share of blocked urls.

    That share leaves out the row's own label and is drawn to the overall ``share``. The counts are a written table, sent to all tasks
    below Spark's broadcast limit and else joined by shuffle, where adaptive execution splits a frequent suffix.
    """
    counts = suffix_counts(rows)
    features = [per_text(lexical, "array<double>", pa.list_(pa.float64()))("url")]
    own, own_block = F.col("blocked").isNotNull().cast("int"), F.coalesce("blocked", F.lit(0))
    for labels in LEVELS:
        names = [f"{name}_{labels}" for name in ("urls", "labelled", "blocks")]
        level = counts.select(F.col("suffix").alias(f"suffix_{labels}"), *[F.col(old).alias(new) for old, new in zip(("urls", "labelled", "blocks"), names)])
        rows = rows.withColumn(f"suffix_{labels}", suffix(F.col("host"), labels)).join(level, f"suffix_{labels}", "left")
        urls, labelled, blocks = (F.coalesce(F.col(name), F.lit(0)) for name in names)
        known = F.col(f"suffix_{labels}").isNotNull().cast("int")
        blocked_share = (blocks - own_block * known + PRIOR * share) / (labelled - own * known + PRIOR)
        features.append(F.array(F.log1p(urls.cast("double")), blocked_share.cast("double")))
    return rows.withColumn("features", F.concat(*features))


def fitted(rows: DataFrame, urls: int, training_urls: int) -> GBTClassificationModel:
    """Trees fitted to about ``training_urls`` different labelled urls, chosen by a hash of the url, as each counts once."""
    parts = 1 << 20
    kept = F.pmod(F.xxhash64(F.lit(11), "url"), F.lit(parts)) < math.ceil(parts * min(1.0, training_urls / urls))
    chosen = rows.where(F.col("blocked").isNotNull() & kept).select("url", "blocked", "features").dropDuplicates(["url"])
    training = stage(chosen).select(F.col("blocked").cast("double").alias("label"), array_to_vector("features").alias("features"))
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=1).fit(training.orderBy("label", F.xxhash64("features")))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    labels: DataFrame | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    training_urls: int = TRAINING_URLS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score), one row per row of ``pages``.

    The verdict, allow or block, is the longest fitting rule's; else that of the trees. They are trained on labelled
    urls: those with a rule's verdict, or the rows of ``labels`` (url, blocked 0 or 1), of which a url that is labelled
    both ways counts as blocked. Statistics of suffixes cover all rows; only the trees are fitted to a bounded
    sample. ``block_score`` is their probability of block for every url, ruled or not. If all labelled urls have one verdict it stands for
    all others, if there are none they are allowed; the score is then 1 or 0. Null urls are empty and judged like any
    other; repeated rows and null ids stay. Other columns are not read.
    """
    rows = parsed(pages, rules, id_column, url_column)
    if labels is None:
        rows = rows.withColumn("blocked", (F.col("ruled") == "block").cast("int"))
    else:
        one = labels.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).groupBy("url").agg(F.max(F.col("blocked").cast("int")).alias("blocked"))
        rows = rows.join(stage(one), "url", "left")
    total = rows.agg(
        F.count("blocked").alias("labelled"),
        F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocks"),
        F.approx_count_distinct(F.when(F.col("blocked").isNotNull(), F.col("url"))).alias("urls"),
    ).first()
    if total["blocks"] in (0, total["labelled"]):
        score = F.lit(1.0 if total["blocks"] else 0.0)
        scored = rows.withColumn("block_score", score)
    else:
        rows = described(rows, total["blocks"] / total["labelled"])
        model = fitted(rows, max(total["urls"], 1), training_urls).setFeaturesCol("vector").setProbabilityCol("chance")
        scored = model.transform(rows.withColumn("vector", array_to_vector("features")))
        scored = scored.withColumn("block_score", F.element_at(vector_to_array("chance"), 2))
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")

