r"""Quality rules whose cutoffs carry a guarantee on labelled documents.

Fixed base rules come first (too few words, too much repetition). The other
rules have cutoffs chosen for each stratum from labelled documents that pass
the base rules. For a rule, the candidate cutoffs are fixed in advance and
tested from the loosest to the strictest: with k of n good documents rejected,
"more than ``risk`` / rules of good documents are rejected" is refuted at level
``delta`` / (strata x rules) when the exact binomial tail P(X <= k) at that rate
is no larger, which is the Clopper-Pearson upper bound in other words. Testing
stops at the first cutoff that is not certified (fixed-sequence testing, so the
candidates of a rule share one level), and strata and rules share ``delta`` by
Bonferroni's correction. Hence with probability 1 - delta no stratum loses more
than ``risk`` of its good documents to all rules together. Among certified
cutoffs the one with the largest gap between rejected bad and rejected good
documents is used, the loosest on ties; a rule without such a cutoff in a
stratum (too few labels, nothing gained) rejects nothing there.

All of it is built from DataFrame functions. Texts are never shuffled: the
features of a row are made from that row alone, and of the labelled rows only
numbers are joined and counted (strata x rules x cutoffs counters).

Repeated windows inside a text: all windows of eight words are hashed; where
two hashes agree the windows' words themselves decide.

Defined cases: a null text has no words and fails the base rules. A null
stratum is a stratum. A document without a label only lacks influence; several
labels of a document count as bad when one says so; labels without a document
or with a null quality are ignored. Repeated rows are judged one by one.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.llm.common import SPACE, let, stored, table, with_columns

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
RISK, DELTA = 0.05, 0.05
#: A good document lost weighs as much as this many bad ones kept, in choosing among certified cutoffs.
GOOD_WEIGHT = 20
#: rule -> (measure of a document, candidate cutoffs from loose to strict); above the cutoff: rejected.
RULES = {
    "symbols_per_word": ("n_symbols / n_words", [3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "upper_share": ("n_upper / n_chars", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4]),
    "dup_line_share": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "word_length": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0]),
}


def _covered(words: Column, suspects: Column) -> Column:
    """Words inside windows whose own words occur twice or more; ``suspects``: starts, in order."""
    def windows(starts):
        return F.array_sort(F.transform(starts, lambda i: F.struct(
            F.slice(words, i + 1, WINDOW).alias("w"), i.alias("i"))))

    def twice(rows):
        return F.array_sort(F.transform(F.filter(
            F.transform(rows, lambda x, k: F.struct(
                x["i"].alias("i"),
                (F.coalesce(F.get(rows, k - 1)["w"] == x["w"], F.lit(False))
                 | F.coalesce(F.get(rows, k + 1)["w"] == x["w"], F.lit(False))).alias("again"))),
            lambda x: x["again"]), lambda x: x["i"]))

    def spread(starts):
        return F.aggregate(F.transform(starts, lambda i, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - i, F.lit(WINDOW)))),
            F.lit(0), lambda s, x: s + x)

    return let(windows(suspects), lambda rows: let(twice(rows), spread))


def _suspects(hashes: Column) -> Column:
    """Starts of the windows whose hash occurs twice or more."""
    def again(rows):
        return F.transform(F.filter(
            F.transform(rows, lambda x, k: F.struct(
                x["i"].alias("i"),
                (F.coalesce(F.get(rows, k - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(rows, k + 1)["h"] == x["h"], F.lit(False))).alias("again"))),
            lambda x: x["again"]), lambda x: x["i"])

    return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), again)


def repeat_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more in ``words``, the first included."""
    def joined(h, step):  # hashes of windows of twice the width
        return let(h, lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - step - 1),
                                            lambda i: F.xxhash64(F.get(a, i), F.get(a, i + step))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = joined(hashes, step)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
                .otherwise(_covered(words, _suspects(h))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(found).cast("bigint")


def features(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with one more column ``quality``: the counts that rules are made of."""
    source = documents.select(F.struct("*").alias("row"),
                              F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.select("row", "text", F.filter(F.split("text", r"[\x20\x09-\x0D]+"),
                                                   lambda w: w != "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def count(pattern):
        return F.regexp_count("text", F.lit(pattern)).cast("bigint")

    counts = F.struct(
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
        count("[A-Z]").alias("n_upper"), F.length("text").cast("bigint").alias("n_chars"))
    return source.select(*[F.col("row").getField(c).alias(c) for c in documents.columns
                           if c != "quality"], counts.alias("quality"))


def base_failed(q: str = "quality") -> Column:
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{q}.n_repeat_words") > REPEAT_PERCENT * F.col(f"{q}.n_words"))


def _measure(rule: str) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.col(f"quality.{top}") / F.greatest(F.col(f"quality.{bottom}"), F.lit(1))


def _log_choose(n: Column, k: Column) -> Column:
    """ln of the binomial coefficient, by Stirling's series on shifted arguments."""
    def log_factorial(x):
        y = x + 10.0
        tail = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y)
        return tail - F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0.0),
                                  lambda s, i: s + F.ln(x + i.cast("double")))

    n, k = n.cast("double"), k.cast("double")
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of the binomial distribution with n trials at ``rate``.

    Summed from the term at k downwards; below the mean the terms fall at least
    as fast as a bell curve, so those beyond 40 deviations are nothing.
    """
    top = _log_choose(n, k) + k * F.ln(F.lit(rate)) + (n - k) * F.ln(F.lit(1 - rate))
    steps = F.least(k, F.ceil(40 * F.sqrt(n)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state, i):
        j = k - i  # the next term has j successes
        term = state["term"] * (j + 1) * (1 - rate) / ((n - j) * rate)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    total = F.when(steps < 1, F.lit(1.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, add,
                    lambda s: s["sum"]))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def thresholds(featured: DataFrame, labels: DataFrame, stratum_col: str = "lang",
               id_col: str = "doc_id", label_id: str = "doc_id", label_col: str = "quality",
               risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, and one nullable cutoff column for each rule)."""
    marks = (labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
             .groupBy(F.col(label_id).cast("bigint").alias("label_id"))
             .agg((F.min(label_col) > 0).alias("good")))
    known = (featured.where(~base_failed())
             .select(F.col(id_col).cast("bigint").alias("label_id"), F.col(stratum_col).alias("stratum"),
                     *[_measure(r).alias(r) for r in RULES]).join(marks, "label_id"))
    counters = [F.count_if((F.col(r) > c) & F.col("good").eqNullSafe(g)).alias(f"{r}_{i}_{g}")
                for r, (_, cuts) in RULES.items() for i, c in enumerate(cuts) for g in (True, False)]
    counted = known.groupBy("stratum").agg(F.count_if("good").alias("n_good"),
                                           F.count_if(~F.col("good")).alias("n_bad"), *counters)
    strata = counted.select(F.count("*").alias("strata"))
    tests = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"),
                      F.col(f"{r}_{i}_True").alias("k"), F.col(f"{r}_{i}_False").alias("hit"))
             for r, (_, cuts) in RULES.items() for i, c in enumerate(cuts)]
    rows = counted.select("stratum", "n_good", "n_bad", F.explode(F.array(*tests)).alias("t")) \
        .select("stratum", "n_good", "n_bad", "t.*")
    level = F.lit(delta / len(RULES)) / strata.scalar().cast("double")
    tail = binomial_tail(F.col("k").cast("double"), F.col("n_good").cast("double"), risk / len(RULES))
    rows = rows.withColumn("failed", F.when((F.col("n_good") > 0) & (tail <= level), 0).otherwise(1))
    gain = (F.col("hit") / F.greatest("n_bad", F.lit(1))
            - GOOD_WEIGHT * F.col("k") / F.greatest("n_good", F.lit(1)))
    path = rows.groupBy("stratum", "rule").agg(F.array_sort(F.collect_list(
        F.struct("step", "cutoff", "failed", gain.alias("gain")))).alias("path"))
    stop = F.coalesce(F.nullif(F.array_position(F.transform("path", lambda x: x["failed"]), 1),
                               F.lit(0)) - 1, F.size("path")).cast("int")
    best = F.array_max(F.transform(F.filter(F.slice("path", F.lit(1), stop), lambda x: x["gain"] > 0),
                                   lambda x: F.struct(x["gain"].alias("gain"), (-x["step"]).alias("loose"),
                                                      x["cutoff"].alias("cutoff"))))
    chosen = path.select("stratum", "rule", best["cutoff"].alias("cutoff"))
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r)
                                           for r in RULES])


def judged(featured: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id",
           risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``featured`` with base_failed and kept (which replace columns of these names)."""
    cuts = stored(thresholds(featured, labels, stratum_col, id_col, risk=risk, delta=delta),
                  "quality-cutoffs")
    cut = cuts.select(F.struct(*RULES).alias("_cut"), F.col("stratum").alias("_stratum"))
    joined = featured.select(F.struct("*").alias("_row"), F.col(stratum_col).alias("_at"),
                             F.col("quality"), base_failed().alias("_failed")).join(
        cut, F.col("_at").eqNullSafe(F.col("_stratum")), "left")
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(_measure(rule) > F.col(f"_cut.{rule}"), F.lit(False))
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in featured.columns if c not in ("base_failed", "kept")],
        F.col("_failed").alias("base_failed"), (~F.col("_failed") & ~over).alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base rules and their stratum's cutoffs, unchanged."""
    columns = documents.columns
    held = documents.select(F.struct("*").alias("row"), "doc_id", "text", "lang")
    featured = stored(features(held).drop("text"), "quality-features")
    kept = judged(featured, labels).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    featured = stored(features(documents).drop("text"), "quality-features")
    out = judged(featured, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols",
                      "quality.n_dup_lines", "quality.n_repeat_words", "base_failed", "kept")
