"""Quality rules with host-level verdicts.

Each document is measured on its whole text. A base rule rejects it by itself. Further rules only raise suspicion:
their failures are counted by host, and a host's failure rate is shrunk towards the corpus by a beta prior whose mean
and strength come from the spread of the hosts' own rates. A host whose shrunk rate for a rule passes the bar is
condemned for that rule, and its verdict goes back to the documents: those of the host that fail the very rule are
rejected. A document that fails no rule is kept whatever its host. ``quality`` also returns what the verdict rests on: the
host's shrunk rates, the rules that the document fails, and those its host is condemned for.

All of it is DataFrame functions. Counts by host are combined before the shuffle, so a host with a third of all rows
costs one row per task.

Defined results: null is the empty text, with zero counts and base_failed; a null host is a host of its own; equal rows
are judged row by row; an empty table gives an empty one; columns of other names pass through ``judged``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelkin.session import materialize

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rules that are judged by host: name -> condition on the measures.
HOST_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
#: Shrunk failure rate from which a host is condemned; bounds of the prior's strength in documents.
CONDEMNED = 0.5
STRENGTH = (1.0, 1000.0)


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of its ``text`` as struct ``_q``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Each step is a column of its own, so that later ones do not repeat it.
    steps = docs.withColumn("_words", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    steps = steps.withColumn("_n", F.size("_words").cast("long")).withColumn(
        "_windows",
        F.when(F.col("_n") < 5, F.array().cast("array<long>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.col("_n").cast("int") - 4), lambda i: F.xxhash64(F.slice("_words", i, 5)))
        ),
    )
    # Only texts with some window twice need to know which.
    pairs = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    steps = steps.withColumn(
        "_sorted",
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs),
    )
    twice = F.filter(
        "_sorted",
        lambda x, k: F.coalesce(x.h == F.get("_sorted", k - 1).h, F.lit(False))
        | F.coalesce(x.h == F.get("_sorted", k + 1).h, F.lit(False)),
    )
    steps = steps.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x.i)))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct(
            (acc.total + F.least(F.lit(5), i - acc.last)).alias("total"), i.alias("last")
        ),
        lambda acc: acc.total,
    )
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(_without(line, WHITE)) > 0)
    steps = steps.withColumn("_lines", lines)
    return steps.withColumn(
        "_q",
        F.struct(
            F.col("_n").alias("n_words"),
            F.length(_without(text, WHITE)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        ),
    ).drop("_words", "_n", "_windows", "_sorted", "_at", "_lines")


def _of(rule: str) -> Column:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    for name in names:
        rule = rule.replace(name, f"_q.{name}")
    return F.expr(rule)


def base_failed() -> Column:
    return _of("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def host_rates(scored: DataFrame, host: str = "source") -> DataFrame:
    """(host, rule, docs, failures, rate): failure rates of each host, shrunk to the corpus, one row for each rule."""
    fails = [F.count_if(_of(rule)).alias(name) for name, rule in HOST_RULES.items()]
    counted = scored.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("docs"), *fails)
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("failures")) for n in HOST_RULES))
    by_rule = materialize(counted.select("host", "docs", F.inline(rules)), "hosts")
    raw = F.col("failures") / F.col("docs")
    # One row for each rule.
    prior = by_rule.groupBy("rule").agg(
        (F.sum("failures") / F.sum("docs")).alias("mean"), F.var_pop(raw).alias("spread")
    )
    low, high = map(F.lit, STRENGTH)
    strength = F.when(F.col("spread") > 0, F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1)
    prior = prior.withColumn("strength", F.greatest(low, F.least(high, F.coalesce(strength, high))))
    rate = (F.col("mean") * F.col("strength") + F.col("failures")) / (F.col("strength") + F.col("docs"))
    return by_rule.join(F.broadcast(prior), "rule").select("host", "rule", "docs", "failures", rate.alias("rate"))


def judged(scored: DataFrame, host: str = "source") -> DataFrame:
    """``scored`` (a frame from ``measured``) with ``_base_failed``, ``_kept`` and the struct ``_host``.

    ``_host`` has the rules failed by the document and the shrunk rates of its host. Verdicts are stored first; Spark then
    sees their size and sends them to the documents where they are small.
    """
    rates = host_rates(scored.select(host, "_q"), host)
    by_rule = [F.max(F.when(F.col("rule") == name, F.col("rate"))).alias(f"_rate_{name}") for name in HOST_RULES]
    verdicts = materialize(rates.groupBy(F.col("host").alias("_of_host")).agg(*by_rule), "verdicts")
    listed = lambda test: F.array_compact(F.array(*(F.when(test(n), F.lit(n)) for n in HOST_RULES)))
    about = F.struct(
        listed(lambda n: _of(HOST_RULES[n])).alias("fails"),
        listed(lambda n: F.col(f"_rate_{n}") > CONDEMNED).alias("condemned"),
        *(F.col(f"_rate_{n}").alias(f"rate_{n}") for n in HOST_RULES),
    )
    return (
        scored.join(verdicts, F.col(host).eqNullSafe(F.col("_of_host")), "left")
        .withColumn("_host", about)
        .withColumn("_base_failed", base_failed())
        .withColumn("_kept", ~F.col("_base_failed") & ~F.arrays_overlap("_host.fails", "_host.condemned"))
        .drop("_of_host", *(f"_rate_{n}" for n in HOST_RULES))
    )


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, kept, host_fails, host_condemned, rates) of every row of ``docs`` (doc_id, source, text).

    The lists of rules are comma-joined; rates are rounded to six digits.
    """
    scored = materialize(measured(docs.select("doc_id", "source", "text")).drop("text"), "measured")
    return judged(scored).select(
        "doc_id",
        *(f"_q.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.array_join("_host.fails", ",").alias("host_fails"),
        F.array_join("_host.condemned", ",").alias("host_condemned"),
        *(F.round(f"_host.rate_{n}", 6).alias(f"rate_{n}") for n in HOST_RULES),
    )
