"""Quality rules whose cutoffs come from a labelled holdout, with a guarantee on false rejection.

Every rule rejects a document when one of its ratios lies beyond a cutoff. The rules' cutoffs form one ladder from mild to strict: each step
tightens one rule by one cutoff, and the rules on a step act together with all steps below. In every stratum the steps are tested in that fixed
order, each by an exact binomial test on the holdout's good documents at level delta / strata, until one fails: the steps before it are taken.
Testing in a fixed order needs no share of delta for each step, and Bonferroni over the strata makes the guarantee joint: with confidence 1 - delta,
no stratum loses alpha of its good documents or more to all rules together. A stratum with so few good documents that even a step that rejects
none of them can't pass (under some 460 by default) has no rule: pooling it with others would give up the guarantee for it.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared

GAP = r"[\x20\x09-\x0D]+"
#: Up to so many repeated windows are found by membership.
FEW = 48
#: Values of the hashes that thin out the rows graded for the holdout; so many are broadcast at most (8 MB).
SLOTS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """value: SQL over the base columns; a document fails if value > cutoff (value < cutoff if below), cutoffs from mild to strict."""

    name: str
    value: str
    cutoffs: tuple[float, ...]
    below: bool = False

    def fails(self, cutoff: float) -> str:
        return f"{self.value} {'<' if self.below else '>'} {cutoff!r}D"


RULES = (
    Rule("long_words", "word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)),
    Rule("short_words", "word_chars / n_words", (1.25, 1.5, 2.0, 2.5, 3.0, 3.5), below=True),
    Rule("symbols", "n_symbols / n_words", (2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    Rule("dup_lines", "n_dup_lines / n_words", (0.5, 0.3, 0.2, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)),
    Rule("repeats", "n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
)


@dataclass(frozen=True)
class Risk:
    """alpha: the largest share of a stratum's good documents that may go; delta: the chance that some stratum loses more."""

    alpha: float = 0.01
    delta: float = 0.05
    strata: tuple[str, ...] = ("en", "fr", "de", "es")
    rules: tuple[Rule, ...] = field(default=RULES)

    @property
    def level(self) -> float:
        return self.delta / (len(self.strata) + 1)

    @property
    def ladder(self) -> list[tuple[Rule, float]]:
        """The steps: each rule's cutoffs in order, the rules side by side."""
        steps = [((i + 1) / len(r.cutoffs), j, r, c) for j, r in enumerate(self.rules) for i, c in enumerate(r.cutoffs)]
        return [(r, c) for _, _, r, c in sorted(steps, key=lambda x: x[:2])]

    def first_step(self) -> str:
        """SQL over the base columns: the first step that rejects a document, or a number past the last."""
        tests = [f"case {' '.join(f'when {r.fails(c)} then {i}' for i, (q, c) in enumerate(self.ladder) if q is r)} else {len(self.ladder)} end" for r in self.rules]
        return f"least({', '.join(tests)})"


def base_columns(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, text_id) of every row, and the struct `row` of all its columns if carry; a null text has no words.

    Words in repeated windows: the hashes of all three-word windows; if they are all distinct, none. Otherwise the windows whose hash is
    among the repeated ones, found by membership while those are few, by sorting (hash, place) when they are many. Each such
    window covers up to three words, fewer if the next one begins before. Windows are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = ["row"] * carry
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang"), text.alias("t"), F.xxhash64(text).alias("text_id"), *[F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(k) for k in key])
    df = df.withColumn("w", F.filter(F.split("t", GAP), lambda x: x != ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "doc_id", "lang", "w", "text_id", *key,
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("t", GAP, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    df = df.withColumn("h", F.expr("if(n_words < 3, array(), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))")).drop("w")
    df = df.withColumn("hs", F.expr("if(size(array_distinct(h)) = size(h), array(), sort_array(h))"))
    df = df.withColumn("d", F.expr("array_distinct(filter(hs, (x, i) -> i > 0 and x = hs[i - 1]))")).drop("hs")
    few = f"filter(transform(h, (x, i) -> if(array_contains(d, x), i, null)), x -> x is not null)"
    df = df.withColumn("z", F.expr(f"if(size(d) > {FEW}, sort_array(transform(h, (x, i) -> struct(x as h, i as i))), array())"))
    many = "sort_array(transform(filter(z, (x, i) -> (i > 0 and x.h = z[i - 1].h) or (i < size(z) - 1 and x.h = z[i + 1].h)), x -> x.i))"
    df = df.withColumn("p", F.expr(f"if(size(d) = 0, array(), if(size(d) > {FEW}, {many}, {few}))")).drop("h", "d", "z")
    df = df.withColumn("n_repeat_words", F.expr("cast(aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0, (a, x) -> a + x) as bigint)")).drop("p")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ln_gamma(x: Column) -> Column:
    """Stirling's series, from x + 8 on; good to 1e-13 for x >= 1."""
    y = x + 8
    down = F.lit(0.0)
    for i in range(8):
        down = down + F.ln(x + i)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - down


def binomial_tail(k: Column, n: Column, p: float, terms: int = 20_000) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), for k < n * p; 1 elsewhere.

    The sum runs down from k, by ratios under 1; what is left after that many terms is bounded from above.
    """
    k, n = k.cast("double"), n.cast("double")
    mass = F.exp(_ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc, i):
        term = acc["term"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(float(terms))).cast("int"))).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(steps, start, step)
    rest = F.when(k > terms, folded["term"] * (n * p) / (n * p - k)).otherwise(0.0)
    return F.when(k < n * p, mass * (folded["sum"] + rest)).otherwise(1.0)


def steps_taken(good: DataFrame, risk: Risk) -> DataFrame:
    """(stratum, taken): the number of steps taken, at most one row a stratum.

    good: stratum, text_id and first_step of the holdout's good documents; equal texts of a stratum count once, since they are no independent trials
    (near copies do count each). One aggregation counts the documents of each first step: at most as many rows a stratum as there are steps.
    """
    last = len(risk.ladder)
    counted = good.select("stratum", "text_id", "first_step").distinct().groupBy("stratum", "first_step").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("stratum")
    below = whole.orderBy("first_step").rowsBetween(Window.unboundedPreceding, 0)
    sums = counted.select("stratum", "first_step", F.sum("c").over(whole).alias("n"), F.sum("c").over(below).alias("k"))
    failed = F.when((F.col("first_step") < last) & (binomial_tail(F.col("k"), F.col("n"), risk.alpha) > risk.level), F.col("first_step"))
    none = F.max(binomial_tail(F.lit(0), F.col("n"), risk.alpha)) > risk.level
    return sums.groupBy("stratum").agg(F.when(none, 0).otherwise(F.coalesce(F.min(failed), F.lit(last))).alias("taken"))


def stratum(risk: Risk) -> Column:
    return F.when(F.col("lang").isin(*risk.strata), F.col("lang")).otherwise(F.lit("other"))


def _maybe_in(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ids, and few or, past some SLOTS ids, many others: a semi-join by hashes of SLOTS values, so what is broadcast is bounded."""
    slot = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(SLOTS))
    return rows.withColumn("slot", slot).join(F.broadcast(ids.select(slot.alias("slot")).distinct()), "slot", "left_semi").drop("slot")


def _graded(docs: DataFrame, risk: Risk, carry: bool = False) -> DataFrame:
    """Base columns, stratum and first_step, which is null just where the base fails."""
    return base_columns(docs, carry).withColumn("stratum", stratum(risk)).withColumn("first_step", F.when(~F.col("base_failed"), F.expr(risk.first_step())))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), carry: bool = False) -> DataFrame:  # noqa: B008
    """Base columns of every row of docs (doc_id, text, lang), the struct `row` of all columns of docs if carry, and kept: false if base_failed, else whether no rule of its stratum rejects it.

    labels (doc_id, quality, toxic): documents with quality 1 and not toxic (on each of their rows) that pass the base are the
    holdout. Languages outside risk.strata and null ones share the stratum "other". Null or empty texts fail the base. Repeated rows are judged each by
    itself. Without labels only the base decides. Other columns of either table are ignored.

    The holdout is graded first, by a scan of its own that writes numbers only. All rows are then graded and judged in one scan, so no text is
    shuffled or written.
    """
    trusted = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    maybe = _maybe_in(trusted, docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang"))
    holdout = write_shared(_graded(maybe, risk).select("doc_id", "stratum", "text_id", "first_step"), "holdout")
    taken = write_shared(steps_taken(holdout.filter("first_step is not null").join(trusted, "doc_id", "left_semi"), risk), "taken")
    # at most len(risk.strata) + 1 rows are broadcast
    rows = _graded(docs, risk, carry).join(F.broadcast(taken), "stratum", "left")
    # one comparison of both sides: a test of base_failed alone would be pushed down and evaluated twice
    kept = F.coalesce("first_step", F.lit(-1)) >= F.coalesce("taken", F.lit(0))
    return rows.select("doc_id", *["row"] * carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
