"""Weak supervision over quality rules, in DataFrame functions only.

Every rule votes for (1) or against (-1) a text or abstains (0).  Texts with the same votes are
counted, expectation-maximisation runs over the counted vote patterns (at most 3 to the number of
rules, whatever the input), as one nested ``aggregate`` expression, and each pattern's posterior
probability of good quality joins back to its texts.

Texts fail in different ways, so there is one latent class of good text and one for each kind of
fault.  Two rules look at every kind from two sides: the votes of a pair depend on each other through
their class, the rest is independent.  A lone vote against a text, which the pair's other rule
contradicts, is outvoted as far as the rule's estimated accuracy says; two that agree are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import carried, cut

#: Characters that separate words, and symbol characters (fixed values of the contract).
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
#: Words of a block. Longer texts have fewer distinct words to a word, so these are counted block by block.
BLOCK = 2000
ROUNDS = 20
#: A text that passes the base tests is kept if its posterior reaches this.
KEEP = 0.5
#: Where expectation-maximisation starts: the share of good texts, and the chances of votes -1, 0, 1 on
#: good text, of the rules made for a kind of fault on text that has it, and of the other rules on it.
START_PRIOR = 0.8
START_GOOD = {-1: 0.02, 0: 0.08, 1: 0.9}
START_HIT = {-1: 0.9, 0: 0.07, 1: 0.03}
START_PASS = {-1: 0.05, 0: 0.15, 1: 0.8}
STRENGTH = 2.0

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further statistics that only the rules read.
FACTS = ["n_lines", "n_distinct", "n_block_distinct", "n_exclaims", "n_capitals", "n_marked", "n_echoes"]
#: The rules by the kind of fault that they were made for: two views of each.
KINDS = {"size": ("length", "word_size"), "symbols": ("symbols", "marks"), "copies": ("repeats", "lines"), "monotony": ("variety", "echoes"), "shouting": ("shouting", "capitals")}
VOTES = [rule for pair in KINDS.values() for rule in pair]
OWN = [*STATS, *FACTS, "base_failed", "pattern", "posterior", "kept"]


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def word_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """Append the statistics that the rules read; long columns. Temporary columns are dropped.

    Words in windows found twice: the windows' 64-bit hashes are sorted once to see whether any
    repeats; only then are (hash, place) pairs sorted and the places' union measured, so a text of n
    words takes n log n steps however often it repeats itself.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(F.col("__t"), F.lit(SPACES))
    df = docs.withColumn("__t", t).withColumn("__w", F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("__t", "\n"), lambda s: F.length(without(s, SPACES)) > 0)
    # every symbol as #, every space as a blank: a word ends in a symbol where "# " stands
    df = df.withColumn("__m", F.concat(F.translate(F.col("__t"), SYMBOLS + SPACES, "#" * len(SYMBOLS) + " " * len(SPACES)), F.lit(" ")))
    df = (
        df.withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.length(without(F.col("__t"), SPACES)).cast("long"))
        .withColumn("n_symbols", (F.length("__t") - F.length(without(F.col("__t"), SYMBOLS))).cast("long"))
        .withColumn("n_exclaims", (F.length("__t") - F.length(F.replace(F.col("__t"), F.lit("!"), F.lit("")))).cast("long"))
        .withColumn("n_capitals", (F.length("__t") - F.length(without(F.col("__t"), CAPITALS))).cast("long"))
        .withColumn("n_marked", (F.length("__m") - F.length(F.replace(F.col("__m"), F.lit("# "), F.lit(" ")))).cast("long"))
        .withColumn("__l", lines)
        .withColumn("n_lines", F.size("__l").cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("n_distinct", F.size(F.array_distinct("__w")).cast("long"))
        .withColumn("n_echoes", F.size(F.filter("__w", lambda w, i: F.get("__w", i - 1) == w)).cast("long"))
    )
    starts = F.sequence(F.lit(1), F.size("__w"), F.lit(BLOCK))
    per_block = F.aggregate(F.transform(starts, lambda i: F.size(F.array_distinct(F.slice("__w", i, BLOCK)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_block_distinct", F.when(F.size("__w") > BLOCK, per_block.cast("long")).otherwise(F.col("n_distinct")))
    hashes = F.when(F.size("__w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__w") - WINDOW + 1), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__h", hashes).withColumn("__again", F.size(F.array_distinct("__h")) < F.size("__h"))
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__p", F.when(F.col("__again"), pairs))

    def repeated(p: Column, k: Column) -> Column:
        same = lambda j: F.coalesce(F.get("__p", j)["h"] == p["h"], F.lit(False))
        return same(k - 1) | same(k + 1)

    df = df.withColumn("__s", F.sort_array(F.transform(F.filter("__p", repeated), lambda p: p["i"])))
    union = F.aggregate(
        "__s",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("__again"), union), F.lit(0)).cast("long"))
    return df.drop("__t", "__w", "__m", "__l", "__h", "__again", "__p", "__s")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ballot(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, over the statistics of ``word_stats``."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    per_word = F.col("word_chars") / n
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    variety = F.col("n_block_distinct") / n
    again = F.col("n_dup_lines") / lines
    told = F.col("n_words") >= 20  # shares of a few words say nothing: abstain
    return {
        "length": ballot(F.col("n_words") >= 50, F.col("n_words") < 20),
        "word_size": ballot((per_word >= 3) & (per_word <= 10), (per_word < 2) | (per_word > 14)),
        "symbols": ballot(F.col("n_symbols") / n <= 0.05, F.col("n_symbols") / n > 0.3),
        "marks": ballot(F.col("n_marked") / n <= 0.05, F.col("n_marked") / n > 0.3),
        "repeats": ballot(told & (F.col("n_repeat_words") / n <= 0.2), F.col("n_repeat_words") / n > 0.3),
        "lines": ballot(told & (again <= 0.3), (again > 0.5) & (F.col("n_dup_lines") >= 3)),
        "variety": ballot(told & (variety >= 0.45), variety < 0.3),
        "echoes": ballot(told & (F.col("n_echoes") / n <= 0.1), F.col("n_echoes") / n > 0.3),
        "shouting": ballot(F.col("n_exclaims") / n <= 0.1, F.col("n_exclaims") / n > 0.3),
        "capitals": ballot(F.col("n_capitals") / chars <= 0.2, F.col("n_capitals") / chars > 0.5),
    }


def pattern() -> Column:
    """The votes as one number in base 3."""
    total = F.lit(0)
    cast = votes()
    for rule in VOTES:
        total = total * 3 + cast[rule] + 1
    return total.cast("int")


def ballots(code: Column) -> Column:
    """The votes of a pattern, 0 (against), 1 (abstention) or 2 (for), rule by rule."""
    size = len(VOTES)
    return F.array(*[(F.floor(code / 3 ** (size - 1 - k)) % 3).cast("int") for k in range(size)])


def memberships(v: Column, model: Column) -> Column:
    """Posterior probability of each latent class given the votes."""
    size = len(VOTES)
    logs = F.transform(
        F.sequence(F.lit(0), F.lit(len(KINDS))),
        lambda c: F.log(F.get(model["prior"], c)) + F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda s, k: s + F.log(F.get(model["chance"], c * 3 * size + k * 3 + F.get(v, k)))),
    )
    # shifted by the largest before exp, then scaled to one; one-element transforms bind a value once
    odds = F.flatten(F.transform(F.array(logs), lambda x: F.transform(x, lambda y: F.exp(y - F.array_max(x)))))
    return F.flatten(F.transform(F.array(odds), lambda x: F.transform(x, lambda y: y / F.aggregate(x, F.lit(0.0), lambda s, z: s + z))))


def posterior(code: Column, model: Column) -> Column:
    """Probability of good quality of a vote pattern."""
    return F.get(memberships(ballots(code), model), F.lit(0))


def expectation_maximisation(patterns: Column) -> Column:
    """Model (prior, chance) fitted to an array of (code, n) structs: latent class analysis of the votes.

    Class 0 is good text, class 1 + k text with the k-th kind of fault.  ``chance`` holds, class by
    class and rule by rule, how likely a vote against, an abstention and a vote for are: the rules'
    accuracies.  START_* are the first values; STRENGTH observations of them stay in every estimate,
    which defines empty classes and keeps classes from trading places.
    """
    size, classes = len(VOTES), 1 + len(KINDS)
    spots = [(c, r, v) for c in range(classes) for r in VOTES for v in (-1, 0, 1)]
    hits = [(), *KINDS.values()]
    first = [(START_GOOD if c == 0 else START_HIT if r in hits[c] else START_PASS)[v] for c, r, v in spots]
    shares = [START_PRIOR, *[(1 - START_PRIOR) / len(KINDS)] * len(KINDS)]
    numbers = lambda x: F.array(*[F.lit(float(y)) for y in x])
    start = F.struct(numbers(shares).alias("prior"), numbers(first).alias("chance"))

    def step(model: Column, _: Column) -> Column:
        scored = F.transform(patterns, lambda p: F.struct(p["n"].cast("double").alias("n"), ballots(p["code"]).alias("v")))
        scored = F.transform(scored, lambda p: F.struct(p["v"].alias("v"), F.transform(memberships(p["v"], model), lambda q: q * p["n"]).alias("w")))

        def add(acc: Column, p: Column) -> Column:
            return F.struct(
                F.zip_with(acc["w"], p["w"], lambda a, b: a + b).alias("w"),
                F.transform(acc["hit"], lambda x, i: x + F.when(F.get(p["v"], F.floor(i / 3).cast("int") % size) == i % 3, F.get(p["w"], F.floor(i / (3 * size)).cast("int"))).otherwise(0.0)).alias("hit"),
            )

        zero = F.struct(numbers([0] * classes).alias("w"), numbers([0] * len(spots)).alias("hit"))

        def estimate(a: Column) -> Column:
            total = F.aggregate(a["w"], F.lit(0.0), lambda s, x: s + x)
            return F.struct(
                F.zip_with(a["w"], numbers(shares), lambda x, y: (x + STRENGTH * y) / (total + STRENGTH)).alias("prior"),
                F.transform(F.zip_with(a["hit"], numbers(first), lambda x, y: x + STRENGTH * y), lambda x, i: x / (F.get(a["w"], F.floor(i / (3 * size)).cast("int")) + STRENGTH)).alias("chance"),
            )

        return F.aggregate(scored, zero, add, estimate)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the statistics, base_failed, pattern, posterior and kept (never true for a base failure).

    A null text counts as empty: no words, so it fails the base tests.  All columns (or ``keep``) are
    carried; one named like a new one is replaced.  Repeated rows get the same verdict.  An empty
    table stays empty.  The statistics with what is carried are written to the checkpoint folder, as
    the fit and the verdicts both read them.
    """
    staying = carried(docs, OWN, keep)
    clean = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*staying, text_col])])
    stats = word_stats(clean, text_col).withColumn("base_failed", base_failed()).withColumn("pattern", pattern())
    facts = cut(stats.select(*[F.col(f"`{c}`") for c in staying], *STATS, *FACTS, "base_failed", "pattern"))
    counted = facts.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    # one row: the counted patterns are at most 3 ** len(VOTES)
    table = counted.agg(F.sort_array(F.collect_list(F.struct(F.col("pattern").alias("code"), "n"))).alias("patterns"))
    fitted = cut(table.select("patterns", expectation_maximisation(F.col("patterns")).alias("model")))
    scored = fitted.select(F.explode("patterns").alias("p"), "model").select(F.col("p.code").alias("pattern"), posterior(F.col("p.code"), F.col("model")).alias("posterior"))
    out = facts.join(F.broadcast(scored), "pattern")  # at most 3 ** len(VOTES) rows
    return out.select(*[F.col(f"`{c}`") for c in staying], *STATS, *FACTS, "base_failed", "pattern", "posterior", (~F.col("base_failed") & (F.col("posterior") >= KEEP)).alias("kept"))
