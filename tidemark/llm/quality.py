"""Quality rules: weak supervision in place of all-must-pass filtering.

Nine rules look at counts of a document and vote good (1), bad (-1) or abstain (0). The votes of the
corpus are summed up in a histogram of vote patterns, which has 3^9 rows at most whatever the corpus.
Expectation-maximisation over that histogram fits a mixture of classes, in each of which every rule votes
bad at a rate of its own, with flat priors: nothing but the votes says how accurate a rule is. It starts from
one class of documents without a bad vote and one for each rule; classes are then merged as long as that
lowers the Bayesian information criterion. So a class of bad documents remains only where several rules agree
on it, and a rule that votes bad alone, whatever the others say, becomes an inaccurate one that decides
nothing by itself. The class with the fewest bad votes is the good one. A document's posterior probability of
being good then follows from its votes. The path over the documents is built of DataFrame functions alone.

Defined cases: null and blank texts have no words, which fails the base filter. An empty table gives
an empty result. Equal rows get equal verdicts. Other columns, of any name, pass through `filter_documents`
as they are. A very long text is split whole, and takes memory in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_columns, materialize, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_FROM = 0.5
#: A mark at the end of a word, and a run of anything but letters and white space.
SYMBOL_END = r"[#*$%&|<>](?=[\x20\x09-\x0D]|$)"
MARKS = r"[^\p{L}\x20\x09-\x0D]+"
RULES = ("length", "symbols", "symbol_ends", "marks", "lines", "repeats", "shouting", "variety", "word_length")


def _repeat_words() -> Column:
    """Words inside 5-word windows that occur twice or more, counted once each.

    Hashes of the windows tell texts without any repeat, exactly, as equal windows have equal hashes.
    Only where two hashes agree are the windows themselves sorted, and equal neighbours marked."""
    at = ", ".join(f"__q_words[i + {k}]" for k in range(WINDOW))
    hashes = f"transform(sequence(0, __q_n - {WINDOW}), i -> xxhash64({at}))"
    return F.expr(f"CASE WHEN __q_n < {WINDOW + 1} THEN array() ELSE {hashes} END").cast("array<bigint>")


_MARKED = (
    "filter(__q_sorted, (x, i) -> (i > 0 AND __q_sorted[i - 1].w = x.w)"
    " OR (i < size(__q_sorted) - 1 AND __q_sorted[i + 1].w = x.w))"
)


def features(docs: DataFrame) -> DataFrame:
    """row: a struct of the columns of docs; and `__q_` columns: the base counts and what the rules look at."""
    df = docs.select(F.struct(*as_columns(docs)).alias("row"))
    df = df.withColumn("__q_text", F.coalesce(F.col("row.text"), F.lit(""))).withColumn("__q_words", words(F.col("row.text")))
    df = df.withColumns({
        "__q_n": F.size("__q_words"),
        "__q_lines": F.filter(F.split("__q_text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""),
    })
    df = df.withColumn("__q_windows", _repeat_words())
    repeated = f"size(array_distinct(__q_windows)) < size(__q_windows)"
    df = df.withColumn(
        "__q_sorted",
        F.expr(
            f"CASE WHEN {repeated} THEN array_sort(transform(sequence(0, __q_n - {WINDOW}),"
            f" i -> struct(array_join(slice(__q_words, i + 1, {WINDOW}), ' ') AS w, i AS i))) END"
        ),
    )
    df = df.withColumn("__q_at", F.expr(f"CASE WHEN __q_sorted IS NOT NULL THEN sort_array(transform({_MARKED}, x -> x.i)) END"))
    covered = f"aggregate(transform(__q_at, (x, i) -> CASE WHEN i < size(__q_at) - 1 THEN least({WINDOW}, __q_at[i + 1] - x) ELSE {WINDOW} END), 0, (a, x) -> a + x)"
    df = df.withColumns({
        "__q_n_words": F.col("__q_n").cast("long"),
        "__q_word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
        "__q_n_symbols": F.regexp_count("__q_text", F.lit(SYMBOLS)).cast("long"),
        "__q_n_symbol_ends": F.regexp_count("__q_text", F.lit(SYMBOL_END)).cast("long"),
        "__q_n_marks": F.regexp_count("__q_text", F.lit(MARKS)).cast("long"),
        "__q_n_lines": F.size("__q_lines").cast("long"),
        "__q_n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "__q_n_repeat_words": F.expr(f"CASE WHEN __q_at IS NULL THEN 0 ELSE {covered} END").cast("long"),
        "__q_n_shouted": F.expr("size(filter(__q_words, w -> w = upper(w) AND w <> lower(w)))").cast("long"),
        "__q_n_distinct": F.size(F.array_distinct("__q_words")).cast("long"),
    })
    return df.drop("__q_text", "__q_words", "__q_n", "__q_lines", "__q_windows", "__q_sorted", "__q_at")


def base_failed() -> Column:
    n = F.col("__q_n_words")
    return (n < MIN_WORDS) | (100 * F.col("__q_n_repeat_words") > MAX_REPEAT_PERCENT * n)


def votes() -> dict[str, Column]:
    """Vote of each rule; shares are compared as products of counts, so nothing divides by zero."""
    n, lines = F.col("__q_n_words"), F.col("__q_n_lines")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    c = lambda name: F.col(f"__q_{name}")
    return {
        "length": vote(n < MIN_WORDS, n >= 40),
        "symbols": vote(c("n_symbols") * 10 > n, (c("n_symbols") * 50 <= n) & (n > 0)),
        "symbol_ends": vote(c("n_symbol_ends") * 20 > n, (c("n_symbol_ends") * 100 <= n) & (n > 0)),
        "marks": vote(c("n_marks") * 5 > 2 * n, (c("n_marks") * 4 <= n) & (n > 0)),
        "lines": vote((c("n_dup_lines") * 4 > lines) & (c("n_dup_lines") > 2), (c("n_dup_lines") == 0) & (lines > 2)),
        "repeats": vote(c("n_repeat_words") * 100 > MAX_REPEAT_PERCENT * n, (c("n_repeat_words") * 20 <= n) & (n >= 20)),
        "shouting": vote(c("n_shouted") * 2 > n, (c("n_shouted") * 5 <= n) & (n > 0)),
        "variety": vote((c("n_distinct") * 5 < n), (c("n_distinct") * 10 >= n * 4) & (n >= 20)),
        "word_length": vote((c("word_chars") > 14 * n) | (c("word_chars") * 2 < 5 * n), (c("word_chars") <= 10 * n) & (c("word_chars") >= 3 * n) & (n > 0)),
    }


Histogram = list[tuple[tuple[int, ...], int]]


class Mixture:
    """share[k]: part of the documents in class k; rate[k, j]: bad votes among those of rule j on them."""

    def __init__(self, histogram: Histogram, posterior) -> None:
        """The most probable values given each pattern's posterior over classes, with one vote more of either kind."""
        import numpy as np

        votes, n = _arrays(histogram)
        weight = posterior * n[:, None]
        self.share = (weight.sum(0) + 1) / (n.sum() + posterior.shape[1])
        self.rate = (weight.T @ (votes < 0) + 1) / (weight.T @ (votes != 0) + 2)
        self.order = np.argsort(self.rate.mean(1), kind="stable")

    @property
    def good(self) -> int:
        return int(self.order[0])

    def logs(self, votes):
        """log of share and likelihood of each pattern in each class; abstaining says nothing."""
        import numpy as np

        return np.log(self.share) + (votes < 0) @ np.log(self.rate).T + (votes > 0) @ np.log1p(-self.rate).T

    def posterior(self, votes):
        """(posterior of each pattern over classes, log likelihood of each)."""
        import numpy as np

        logs = self.logs(votes)
        top = logs.max(1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
        return np.exp(logs - total), total[:, 0]


def _arrays(histogram: Histogram):
    import numpy as np

    return np.array([v for v, _ in histogram], float).reshape(-1, len(histogram[0][0])), np.array([n for _, n in histogram], float)


def start(histogram: Histogram):
    """A class for documents without a bad vote, and one for each rule that votes bad, in equal parts."""
    import numpy as np

    votes, _ = _arrays(histogram)
    bad, voted = votes < 0, np.maximum((votes != 0).sum(1), 1)
    share = bad.sum(1) / voted
    return np.c_[1 - share, bad / np.maximum(bad.sum(1, keepdims=True), 1) * share[:, None]]


def maximise(histogram: Histogram, posterior, iterations: int = 500, tolerance: float = 1e-10) -> tuple[Mixture, float]:
    """Expectation-maximisation from a posterior; the mixture and its log likelihood."""
    votes, n = _arrays(histogram)
    last = None
    for _ in range(iterations):
        model = Mixture(histogram, posterior)
        posterior, logs = model.posterior(votes)
        fit_of = float(logs @ n)
        if last is not None and abs(fit_of - last) <= tolerance * max(1.0, abs(fit_of)):
            break
        last = fit_of
    return model, fit_of


def fit(histogram: Histogram) -> dict:
    """model, and accuracy by rule: how often it is right when it votes (None if it never does)."""
    import numpy as np

    votes, n = _arrays(histogram)
    model, fit_of = maximise(histogram, start(histogram))
    price = (votes.shape[1] + 1) * float(np.log(n.sum())) / 2  # of the values of one class
    while len(model.share) > 1:
        posterior, _ = model.posterior(votes)
        tries = []
        for k in range(len(model.share)):
            for m in range(k):
                merged = np.delete(posterior, k, 1)
                merged[:, m] += posterior[:, k]
                tries.append((float(Mixture(histogram, merged).posterior(votes)[1] @ n), -k, -m, merged))
        found, found_fit = maximise(histogram, max(tries, key=lambda t: t[:3])[3])
        if fit_of - found_fit >= price:
            break
        model, fit_of = found, found_fit
    good = model.posterior(votes)[0][:, model.good]
    right = [float(n @ (np.where(votes[:, j] > 0, good, 1 - good) * (votes[:, j] != 0))) for j in range(votes.shape[1])]
    voted = [float(n @ (votes[:, j] != 0)) for j in range(votes.shape[1])]
    return {"model": model, "accuracy": [r / v if v else None for r, v in zip(right, voted)]}


def fit_votes(df: DataFrame) -> dict | None:
    """Fit to a frame with `__q_` columns, of which the pattern counts alone reach the driver."""
    cast = votes()
    rows = df.select(*[cast[r].cast("int").alias(r) for r in RULES]).groupBy(*RULES).count().collect()
    return fit(sorted((tuple(r[x] for x in RULES), r["count"]) for r in rows)) if rows else None


def with_quality(df: DataFrame, fitted: dict | None) -> DataFrame:
    """df plus vote columns and the posterior of the good class, as one expression of the votes."""
    cast, held = votes(), [f"__q_vote_{r}" for r in RULES]
    df = df.withColumns({h: cast[r].cast("int") for h, r in zip(held, RULES)})
    if fitted is None:
        return df.withColumn("__q_quality", F.lit(None).cast("double"))
    import numpy as np

    model = fitted["model"]
    good, odds = model.good, F.lit(1.0)
    for k in range(len(model.share)):
        if k != good:
            bad, fine = (np.log(x[k]) - np.log(x[good]) for x in (model.rate, 1 - model.rate))
            terms = (F.when(F.col(h) < 0, float(bad[j])).when(F.col(h) > 0, float(fine[j])).otherwise(0.0) for j, h in enumerate(held))
            odds = odds + F.exp(sum(terms, F.lit(float(np.log(model.share[k] / model.share[good])))))
    return df.withColumn("__q_quality", 1 / odds)


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base counts, base_failed, the votes, the posterior and the verdict."""
    counts = features(docs.select("doc_id", "text"))
    counts = materialize(counts.select(F.col("row.doc_id").alias("doc_id"), *[c for c in counts.columns if c != "row"]), "quality")
    out = with_quality(counts, fit_votes(counts)).select(
        "doc_id",
        *[F.col(f"__q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"),
        *[F.col(f"__q_vote_{r}").alias(f"vote_{r}") for r in RULES],
        F.col("__q_quality").alias("quality"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    held = materialize(features(docs), "quality")
    return with_quality(held, fit_votes(held)).filter(~base_failed() & (F.col("__q_quality") >= KEEP_FROM)).select("row.*")
