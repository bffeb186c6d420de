"""Weight tuning: sums of products per fold, candidate weights scored on them, rank statistics.

Rows are read once. Everything after works on matrices of sums, one row per fold, whose size depends on the number of
features and folds only; the algebra and the search on them are column expressions, so nothing is fetched to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyload.functions.columns import flag, or_zero
from skyload.operators.spread import prior_totals
from skyload.operators.staging import fit_generated_code, stage

ONE, TARGET = "one", "target"


def with_target(scored: DataFrame, target: str = "delay") -> tuple[DataFrame, bool]:
    """Add the tuning target: delay minutes if asked for and known, else difficult or not."""
    if target == "delay" and "dep_delay_minutes" in scored.columns:
        return scored.withColumn(TARGET, or_zero(F.col("dep_delay_minutes")).cast("double")), False
    return scored.withColumn(TARGET, flag(F.col("difficulty_class") == "Difficult").cast("double")), True


def design_columns(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """One column ``x_<feature>`` per feature: the daily scaled value if there is one, else the
    value scaled between the extremes of the whole table (0 if it does not vary)."""
    raw = [name for name in features if f"{name}_scaled" not in scored.columns]
    added = {f"x_{name}": F.col(f"{name}_scaled") for name in features if name not in raw}
    if not raw:
        return scored.withColumns(added)
    values = scored.select(*[F.col(name).cast("double").alias(name) for name in raw])
    ends = [F.struct(F.min(name).alias("low"), F.max(name).alias("high")).alias(name) for name in raw]
    known = scored.withColumn("_ends", values.agg(F.struct(*ends)).scalar())
    for name in raw:
        low, high = F.col(f"_ends.{name}.low"), F.col(f"_ends.{name}.high")
        added[f"x_{name}"] = F.coalesce((F.col(name).cast("double") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    return known.withColumns({f"x_{name}": added[f"x_{name}"] for name in features}).drop("_ends")


def with_fold(df: DataFrame, key: Sequence[str], k: int = 5) -> DataFrame:
    """A fold per row from a hash of its key: the same row lands in the same fold in every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*key), F.lit(k)).cast("int"))


# Rows that the shift of a column is the median of.
SHIFT_ROWS = 1_000


def shifted(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The design with each feature and the target moved by a value from the middle of a few of its rows.

    Sums of products are taken of what is left, so they keep their digits far from zero and are exactly 0 for a column that does not
    vary. Covariances do not depend on the shift, so any few rows will do; they are read by a subquery of the same job.
    """
    names = [*features, TARGET]
    few = df.select(*[design_value(name).alias(f"v{at}") for at, name in enumerate(names)]).limit(SHIFT_ROWS)
    middle = few.agg(F.struct(*[F.coalesce(F.percentile_approx(f"v{at}", 0.5), F.lit(0.0)).alias(f"v{at}") for at in range(len(names))]).alias("middle")).scalar()
    known = df.withColumn("_middle", middle)
    moved = {f"x_{name}" if name != TARGET else TARGET: design_value(name) - F.col(f"_middle.v{at}") for at, name in enumerate(names)}
    return known.withColumns(moved).drop("_middle")


# A sum of squares about the mean below this share of the sum of squares is rounding.
NOISE = 1e-12


def product_matrices(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (…by, sums): the sums of the products of each two of the constant 1, the features and the target, as a matrix.

    Each row is taken once per name i, inside the same task, and adds its products with all names to
    that name's sums. These are combined before the shuffle, which so carries one short row per task,
    group and name; a matrix is put together from the names of a group.
    """
    fit_generated_code(df.sparkSession)
    names = [ONE, *features, TARGET]
    values = df.select(*by, *[design_value(name).alias(f"v{at}") for at, name in enumerate(names)])
    columns = [F.col(f"v{at}") for at in range(len(names))]
    sums = (
        values.select(*by, *columns, F.posexplode(F.array(*columns)).alias("_i", "_x"))
        .groupBy(*by, "_i")
        .agg(*[F.sum(F.col("_x") * column).alias(f"s{at}") for at, column in enumerate(columns)])
    )
    lines = F.array_sort(F.collect_list(F.struct("_i", F.array(*[f"s{at}" for at in range(len(names))]).alias("line"))))
    return sums.groupBy(*by).agg(F.transform(lines, lambda line: line["line"]).alias("sums"))


def design_value(name: str) -> Column:
    if name == ONE:
        return F.lit(1.0)
    return F.col(TARGET) if name == TARGET else F.col(f"x_{name}")


def cells(matrices: DataFrame, matrix: str, names: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """A matrix as rows (…by, i, j, value)."""
    labels = F.array(*[F.lit(name) for name in names])
    lines = matrices.select(*by, F.posexplode(matrix).alias("_i", "_line"))
    return lines.select(*by, "_i", F.posexplode("_line").alias("_j", value)).select(
        *by, F.get(labels, F.col("_i")).alias("i"), F.get(labels, F.col("_j")).alias("j"), value, "_i", "_j"
    )


def product_sums(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (…by, i, j, s) of :func:`product_matrices`; ``i`` comes before ``j`` in (one, features, target)."""
    long = cells(product_matrices(df, features, by), "sums", [ONE, *features, TARGET], by, "s")
    return long.where("_j >= _i").drop("_i", "_j")


def fold_matrices(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (fold, test, train): the product sums of a held-out fold and of all others.

    The sums are written, as the algebra on them is a plan of its own: the only pass over the rows ends here. All folds meet in one
    row, whose size depends on the number of folds and features.
    """
    own = stage(product_matrices(df, features, ["fold"]))
    every = own.agg(F.array_sort(F.collect_list(F.struct("fold", "sums"))).alias("every"))

    def added(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p + q))

    others = F.filter("every", lambda part: part["fold"] != F.col("own.fold"))
    nothing = F.transform("own.sums", lambda line: F.transform(line, lambda _: F.lit(0.0)))
    train = F.aggregate(others, nothing, lambda total, part: added(total, part["sums"]))
    return every.select("every", F.explode("every").alias("own")).select("own.fold", F.col("own.sums").alias("test"), train.alias("train"))


def fold_sums(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Product sums (fold, part, i, j, s) per held-out fold and part: its own rows (``test``) and all others (``train``)."""
    parted = in_parts(fold_matrices(df, features))
    return cells(parted, "m", [ONE, *features, TARGET], ["fold", "part"], "s").where("_j >= _i").drop("_i", "_j")


def in_parts(folds: DataFrame) -> DataFrame:
    """Rows (fold, part, m) of the two matrices of a fold."""
    parts = [F.struct(F.lit(part).alias("part"), F.col(part).alias("m")) for part in ("test", "train")]
    return folds.select("fold", F.explode(F.array(*parts)).alias("p")).select("fold", "p.part", "p.m")


def covariance(sums: Column) -> Column:
    """The matrix of sums about the mean, without the constant; exactly 0 for a column that does not vary.

    The product sums are those of shifted columns. The first line of their matrix holds the count and the totals.
    """
    first = F.element_at(sums, 1)
    n = F.element_at(first, 1)
    rest = F.slice(sums, F.lit(2), F.size(sums) - 1)

    def about(line: Column, at: Column) -> Column:
        total = F.element_at(line, 1)

        def entry(value: Column, other: Column) -> Column:
            left = value - total * F.get(first, other + 1) / n
            return F.when((other == at) & (left <= F.lit(NOISE) * value), 0.0).otherwise(left)

        return F.transform(F.slice(line, F.lit(2), F.size(line) - 1), entry)

    return F.transform(rest, about)


def covariances(matrices: DataFrame, by: Sequence[str], features: Sequence[str], sums: str = "sums") -> DataFrame:
    """Rows (…by, i, j, c) of :func:`covariance`, in both orders."""
    known = matrices.select(*by, covariance(F.col(sums)).alias("_c"))
    return cells(known, "_c", [*features, TARGET], by, "c").drop("_i", "_j")


def fold_covariances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (fold, part, i, j, c) of a design."""
    return covariances(in_parts(fold_matrices(shifted(df, features), features)), ["fold", "part"], features, "m")


def correlation_matrix(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Correlations (feature_a, feature_b, corr) of complete columns; null where one does not vary."""
    named = df.select(F.lit(0.0).alias(TARGET), *[F.col(column).cast("double").alias(f"x_{name}") for name, column in columns.items()])
    names = list(columns)
    known = stage(product_matrices(shifted(named, names), names)).select(covariance(F.col("sums")).alias("c"))
    spread = F.transform("c", lambda line, at: F.get(line, at))

    def correlations(line: Column, at: Column) -> Column:
        def entry(value: Column, other: Column) -> Column:
            own, its = F.get(F.col("spread"), at), F.get(F.col("spread"), other)
            return F.when((own > 0) & (its > 0), value / (F.sqrt(own) * F.sqrt(its)))

        return F.transform(line, entry)

    matrix = known.select("c", spread.alias("spread")).select(F.transform("c", correlations).alias("r"))
    pairs = cells(matrix, "r", [*names, TARGET], [], "corr").where((F.col("i") != TARGET) & (F.col("j") != TARGET))
    return pairs.select(F.col("i").alias("feature_a"), F.col("j").alias("feature_b"), "corr")


def simplex_projection(
    candidates: DataFrame, candidate: str = "candidate", feature: str = "feature", value: str = "value"
) -> DataFrame:
    """Nearest point with non-negative coordinates that add up to 1, for each candidate.

    Windows hold one candidate, that is, one row per feature.
    """
    ranked = Window.partitionBy(candidate).orderBy(F.col(value).desc(), feature)
    running = F.sum(value).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    sorted_rows = candidates.withColumns({"_i": F.row_number().over(ranked), "_sum": running})
    shift = (F.col("_sum") - 1) / F.col("_i")
    last = F.max(F.when(F.col(value) - shift > 0, F.struct("_i", shift.alias("shift"))))
    shifted = sorted_rows.withColumn("_shift", last.over(Window.partitionBy(candidate))["shift"])
    return shifted.select(candidate, feature, F.greatest(F.col(value) - F.col("_shift"), F.lit(0.0)).alias("weight"))


def score_candidates(candidates: DataFrame, covariance: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlation of each candidate's weighted sum with the target, in each group of the sums."""
    by = list(by)
    used = candidates.where(F.col("weight") != 0)
    left = used.select("candidate", F.col("feature").alias("i"), F.col("weight").alias("wi"))
    right = used.select("candidate", F.col("feature").alias("j"), F.col("weight").alias("wj"))
    own = covariance.where((F.col("i") == TARGET) & (F.col("j") == TARGET)).select(*by, F.col("c").alias("target_c"))
    with_target_sum = (
        covariance.where((F.col("j") == TARGET) & (F.col("i") != TARGET))
        .join(F.broadcast(left), "i")
        .groupBy(*by, "candidate")
        .agg(F.sum(F.col("wi") * F.col("c")).alias("up"))
    )
    spread = (
        covariance.where((F.col("i") != TARGET) & (F.col("j") != TARGET))
        .join(F.broadcast(left), "i")
        .join(F.broadcast(right), ["candidate", "j"])
        .groupBy(*by, "candidate")
        .agg(
            F.sum(F.col("wi") * F.col("wj") * F.col("c")).alias("down"),
            F.sum(F.abs(F.col("wi") * F.col("wj") * F.col("c"))).alias("size"),
        )
    )
    joined = with_target_sum.join(spread, [*by, "candidate"]).join(F.broadcast(own), by)
    varies = (F.col("down") > NOISE * F.col("size")) & (F.col("target_c") > 0)
    below = F.when(varies, F.sqrt(F.col("down")) * F.sqrt(F.col("target_c")))
    return joined.select(*by, "candidate", (F.col("up") / below).alias("corr"))


def start_candidates(features: Sequence[str], defaults: Mapping[str, float]) -> list[tuple[str, str, float]]:
    """Uniform weights, each feature alone, the default weights, and even mixes of two features."""
    rows = [("uniform", name, 1.0 / len(features)) for name in features]
    rows += [(f"only:{name}", name, 1.0) for name in features]
    known = {name: defaults[name] for name in features if defaults.get(name)}
    rows += [("default", name, weight / sum(known.values())) for name, weight in known.items()]
    for at, a in enumerate(features):
        for b in features[at + 1 :]:
            rows += [(f"mix:{a}+{b}", a, 0.5), (f"mix:{a}+{b}", b, 0.5)]
    return rows


CANDIDATE_SCHEMA = "candidate string, feature string, weight double"


def best_of(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best candidate of each group, the first by name among equals."""
    place = Window.partitionBy(*by).orderBy(F.col("corr").desc_nulls_last(), "candidate")
    return scores.withColumn("_place", F.row_number().over(place)).where(F.col("_place") == 1).drop("_place")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def applied(matrix: Column, vector: Column) -> Column:
    return F.transform(matrix, lambda line: dot(line, vector))


def on_simplex(point: Column) -> Column:
    """The nearest point with non-negative coordinates that add up to 1: all move by one shift, found from the largest down."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("shift"))

    def longer(state: Column, value: Column) -> Column:
        n, total = state["n"] + 1, state["total"] + value
        return let((total - 1) / n, lambda shift: F.struct(n.alias("n"), total.alias("total"), F.when(value > shift, shift).otherwise(state["shift"]).alias("shift")))

    shift = F.aggregate(F.sort_array(point, asc=False), start, longer, lambda state: state["shift"])
    return let(shift, lambda by: F.transform(point, lambda value: F.greatest(value - by, F.lit(0.0))))


def parts_of(c: Column, size: int) -> tuple[Column, Column, Column]:
    """Covariances of the features, theirs with the target, and the target's own."""
    lines = F.slice(c, 1, size)
    square = F.transform(lines, lambda line: F.slice(line, 1, size))
    return square, F.transform(lines, lambda line: F.element_at(line, size + 1)), F.element_at(F.element_at(c, size + 1), size + 1)


def gradient_weights(c: Column, size: int, steps: int = 400, rate: float = 0.05) -> Column:
    """Projected gradient ascent of the correlation with the target from uniform weights; the best point visited.

    ``c`` is a matrix of :func:`covariance` with ``size`` features. The steps are one expression on its row, so every fold is searched
    where its row is. Raising one weight lowers the positive ones evenly, so only the slope beyond their mean counts.
    """

    def search(known: Column) -> Column:
        square, cross, target = known["square"], known["cross"], known["target"]

        def quality(w: Column, image: Column) -> Column:
            return let(dot(w, image) * target, lambda spread: F.when(spread > 0, dot(w, cross) / F.sqrt(spread)).otherwise(F.lit(float("-inf"))))

        def state(w: Column, image: Column, best: Column, reached: Column) -> Column:
            return F.struct(w.alias("w"), image.alias("image"), best.alias("best"), reached.alias("reached"))

        def moved(now: Column, slope: Column) -> Column:
            raised = F.zip_with(now["w"], slope, lambda w, g: F.when(w > 0, g).otherwise(0.0))
            total = F.aggregate(raised, F.lit(0.0), lambda sum, g: sum + g)
            count = F.size(F.filter(now["w"], lambda w: w > 0))

            def beyond(facts: Column) -> Column:
                mean = lambda w, g: F.when(w > 0, facts["total"] / facts["count"]).otherwise((facts["total"] + g) / (facts["count"] + 1))
                return F.zip_with(now["w"], slope, lambda w, g: w + F.lit(rate) * (g - mean(w, g)))

            def judged(w: Column) -> Column:
                def kept(image: Column) -> Column:
                    return let(
                        quality(w, image),
                        lambda reached: state(w, image, F.when(reached > now["reached"], w).otherwise(now["best"]), F.greatest(reached, now["reached"])),
                    )

                return let(applied(square, w), kept)

            point = let(F.struct(total.alias("total"), count.alias("count")), beyond)
            return let(let(point, on_simplex), judged)

        def step(now: Column, _: Column) -> Column:
            def go(facts: Column) -> Column:
                root, up = F.sqrt(facts["spread"]), facts["up"]
                slope = F.zip_with(cross, now["image"], lambda c, m: (c / root - up * m / (facts["spread"] * root)) / F.sqrt(target))
                return F.when((facts["spread"] > 0) & (target > 0), let(slope, lambda g: moved(now, g))).otherwise(now)

            return let(F.struct(dot(now["w"], now["image"]).alias("spread"), dot(now["w"], cross).alias("up")), go)

        def run(image: Column) -> Column:
            start = state(even, image, even, quality(even, image))
            return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda end: end["best"])

        even = F.array_repeat(F.lit(1.0 / size), size)
        return let(applied(square, even), run)

    square, cross, target = parts_of(c, size)
    return let(F.struct(square.alias("square"), cross.alias("cross"), target.alias("target")), search)


def weighted_corr(c: Column, w: Column, size: int) -> Column:
    """Correlation of the weighted sum with the target; null where either does not vary."""
    square, cross, target = parts_of(c, size)
    down = dot(w, applied(square, w))
    terms = dot(F.transform(w, F.abs), applied(F.transform(square, lambda line: F.transform(line, F.abs)), F.transform(w, F.abs)))

    def ratio(known: Column) -> Column:
        varies = (known["down"] > F.lit(NOISE) * known["size"]) & (known["target"] > 0)
        return F.when(varies, known["up"] / (F.sqrt(known["down"]) * F.sqrt(known["target"])))

    return let(F.struct(down.alias("down"), terms.alias("size"), dot(w, cross).alias("up"), target.alias("target")), ratio)


def candidate_search(
    covariance: DataFrame, features: Sequence[str], defaults: Mapping[str, float], spark: SparkSession, rounds: int = 2
) -> DataFrame:
    """Best weights per fold among the start candidates and, in each round, mixes of a fold's best
    with every single feature."""
    train = covariance.where(F.col("part") == "train").drop("part")
    candidates = spark.createDataFrame(start_candidates(features, defaults), CANDIDATE_SCHEMA)
    best = stage(best_of(score_candidates(candidates, train, ["fold"]), ["fold"]).join(candidates, "candidate"))
    for turn in range(rounds):
        share = 0.25 / (turn + 1)
        kept = best.select(F.concat_ws(":", F.lit("keep"), "fold").alias("candidate"), "feature", "weight")
        mixes = (
            best.withColumn("other", F.explode(F.array(*[F.lit(name) for name in features])))
            .select(F.concat_ws(":", F.lit("mix"), "fold", "other").alias("candidate"), "feature", F.col("weight") * (1 - share))
            .toDF("candidate", "feature", "weight")
        )
        added = (
            best.select("fold").distinct().withColumn("other", F.explode(F.array(*[F.lit(name) for name in features])))
            .select(F.concat_ws(":", F.lit("mix"), "fold", "other"), F.col("other"), F.lit(share))
            .toDF("candidate", "feature", "weight")
        )
        tried = (
            kept.unionByName(mixes).unionByName(added).groupBy("candidate", "feature").agg(F.sum("weight").alias("weight"))
        )
        tried = stage(tried)
        best = stage(best_of(score_candidates(tried, train, ["fold"]), ["fold"]).join(tried, "candidate"))
    return best.select("fold", "feature", "weight")


def tune_weights(
    design: DataFrame,
    features: Sequence[str],
    defaults: Mapping[str, float],
    method: str = "gradient",
) -> DataFrame:
    """Weights tuned by cross-validation: rows (feature, weight, train_corr, test_corr), largest first.

    ``design`` has the columns of :func:`design_columns`, :func:`with_target` and :func:`with_fold`.
    The weight is the mean over folds; the correlations are means over folds of the fold's own
    weights on the rows they were fitted to and on the rows held out.
    """
    if method == "gradient":
        return gradient_tuned(design, features)
    if method != "candidates":
        raise ValueError(f"unknown search method: {method}")
    spark = design.sparkSession
    known = stage(fold_covariances(design, features))
    found = stage(candidate_search(known, features, defaults, spark))
    chosen = found.select(F.col("fold").cast("string").alias("candidate"), "feature", "weight")
    quality = score_candidates(chosen, known, ["fold", "part"]).where(F.col("candidate") == F.col("fold").cast("string"))
    ends = [F.avg(F.when(F.col("part") == part, F.col("corr"))).alias(f"{part}_corr") for part in ("train", "test")]
    folds = known.agg(F.greatest(F.count_distinct("fold"), F.lit(1))).scalar()
    unused = spark.createDataFrame([(None, name, 0.0) for name in features], "fold int, feature string, weight double")
    return (
        found.unionByName(unused)
        .groupBy("feature")
        .agg((F.sum("weight") / folds).alias("weight"))
        .withColumns({name: quality.agg(end).scalar() for name, end in zip(("train_corr", "test_corr"), ends)})
        .orderBy(F.col("weight").desc(), "feature")
    )


def gradient_tuned(design: DataFrame, features: Sequence[str]) -> DataFrame:
    """:func:`tune_weights` by gradient: covariances, search and quality are one lazy plan over the written sums."""
    size = len(features)
    folds = fold_matrices(shifted(design, features), features)
    known = folds.select("fold", *[covariance(F.col(part)).alias(part) for part in ("test", "train")])
    searched = known.withColumn("w", gradient_weights(F.col("train"), size))
    scored = searched.select("fold", "w", *[weighted_corr(F.col(part), F.col("w"), size).alias(part) for part in ("train", "test")])
    ends = scored.agg(F.array_sort(F.collect_list(F.struct("fold", "w"))).alias("all"), F.avg("train").alias("train_corr"), F.avg("test").alias("test_corr"))
    nothing = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate("all", nothing, lambda sum, fold: F.zip_with(sum, fold["w"], lambda a, b: a + b))
    mean = F.transform(total, lambda weight: weight / F.greatest(F.size("all"), F.lit(1)))
    labels = F.array(*[F.lit(name) for name in features])
    return (
        ends.select(F.posexplode(mean).alias("at", "weight"), "train_corr", "test_corr")
        .select(F.get(labels, F.col("at")).alias("feature"), "weight", "train_corr", "test_corr")
        .orderBy(F.col("weight").desc(), "feature")
    )


def blend(design: DataFrame, weights: Mapping[str, float] | DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """Add ``blend``, the weighted sum of the design columns; weights by name, or rows (feature, weight) of the ``features``."""
    if isinstance(weights, DataFrame):
        known = weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight")))).scalar()
        parts = [F.col(f"x_{name}") * F.coalesce(F.col("_weights")[name], F.lit(0.0)) for name in features]
        table = design.withColumn("_weights", known)
    else:
        parts = [F.col(f"x_{name}") * F.lit(weight) for name, weight in weights.items()]
        table = design
    return table.withColumn("blend", reduce(lambda a, b: a + b, parts, F.lit(0.0))).drop("_weights")


def rank_quality(df: DataFrame, score: str = "blend", target: str = TARGET, points: int = 1_000_000_000) -> DataFrame:
    """Area under the ROC curve of a score against a 0/1 target, ties counted half.

    Scores are compared at nine digits. Rows are counted per score, and the negatives below each score
    come from bucketed running totals, so nothing is ever sorted in one task.
    """
    hit = F.col(target) == 1
    cells = prior_totals(
        df.withColumn("_points", F.round(F.col(score) * points).cast("bigint")),
        [],
        "_points",
        {"hits": F.count_if(hit), "misses": F.count_if(~hit)},
    )
    wins = F.sum(F.col("hits") * (F.col("misses_before") + F.col("misses") / 2))
    all_pairs = F.sum("hits").cast("double") * F.sum("misses").cast("double")
    return cells.agg(
        (wins / F.nullif(all_pairs, F.lit(0.0))).alias("auc"), F.sum("hits").alias("positives"), F.sum("misses").alias("negatives")
    )


def top_weights(tuned: DataFrame, top_n: int = 15) -> DataFrame:
    """The largest tuned weights."""
    return tuned.orderBy(F.col("weight").desc(), "feature").limit(top_n)
