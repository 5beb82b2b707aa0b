"""Quality rules at the level of hosts, with DataFrame functions only.

Every text is measured inside its row. Documents that fail a base rule go. The
other rules are judged with their host: failures are summed by host, rates are
shrunk towards a beta prior fitted to all hosts, and the verdicts are joined
back. A document goes if it fails a rule that its host fails too often to be
trusted with, or if nearly all of its host's documents fail some rule.

Defined results: a null text has no words and fails the base rules. Documents
without a host are judged by the prior alone. Null ids and repeated rows are
documents of their own. Empty tables give empty results. Other columns pass
through unless they carry a name that this operator returns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import quoted, set_aside, written

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class HostRules:
    """Thresholds. Rates are shares of a host's documents."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Symbols per hundred words, repeated lines per hundred lines.
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    min_mean_word: int = 3
    max_mean_word: int = 12
    #: From this shrunk rate on a host isn't trusted with a rule.
    trust_rate: float = 0.02
    #: From this shrunk rate of documents that fail some rule on, the whole host goes.
    host_rate: float = 0.9
    #: A prior weighs at most this many documents.
    max_prior: float = 1000.0


SOFT = ["symbols", "dup_lines", "word_length"]
#: Names that this operator makes.
RESERVED = [
    *MEASURES,
    *("n_lines", "base_failed", "kept", "_text", "_words", "_lines", "_runs", "_again", "_host"),
    *(f"_{r}" for r in SOFT),
    *(f"_rate_{r}" for r in [*SOFT, "some"]),
]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``MEASURES`` and ``n_lines``, counted over each whole text."""
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in RESERVED]
    text = F.col("_text")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, _SPACES) != "")
    split = docs.select(*kept, F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("_text")).select(
        *kept, "_text", words.alias("_words"), lines.alias("_lines")
    )
    # A run of three words is told by its hash; equal hashes stand side by side once sorted.
    runs = F.when(
        F.size("_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3),
            lambda i: F.struct(
                F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")
            ),
        ),
    )
    hashed = split.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(text, _SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        runs.alias("_runs"),
    )
    again = F.when(
        F.size(F.array_distinct(F.col("_runs.h"))) < F.size("_runs"),
        F.sort_array("_runs"),
    )
    ordered = hashed.withColumn("_again", again)
    repeated = F.filter(
        "_again",
        lambda x, k: (x["h"] == F.get("_again", k - 1)["h"]) | (x["h"] == F.get("_again", k + 1)["h"]),
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    )
    count = F.when(F.col("_again").isNull(), F.lit(0)).otherwise(covered).cast("long")
    return ordered.select(*kept, *MEASURES[:4], "n_lines", count.alias("n_repeat_words"))


def failures(measures: DataFrame, rules: HostRules) -> DataFrame:
    """Adds ``base_failed`` and one flag per soft rule."""
    n = F.col("n_words")
    return measures.withColumns(
        {
            "base_failed": (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n),
            "_symbols": 100 * F.col("n_symbols") > rules.max_symbol_percent * n,
            "_dup_lines": 100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"),
            "_word_length": (F.col("word_chars") < rules.min_mean_word * n)
            | (F.col("word_chars") > rules.max_mean_word * n),
        }
    )


def verdicts(
    failed: DataFrame, rules: HostRules, host_column: str = "source", broadcast_bytes: int = 32 << 20
) -> tuple[DataFrame, dict[str, float]]:
    """Shrunk failure rates per host and the prior rates of each rule.

    The rates are marked for a broadcast if they take ``broadcast_bytes`` at most, which
    spares the documents a shuffle by host; else the join is left to adaptive skew splitting.
    """
    host = F.col(quoted(host_column))
    some = F.col("base_failed") | F.col("_symbols") | F.col("_dup_lines") | F.col("_word_length")
    flags = {**{r: F.col(f"_{r}") for r in SOFT}, "some": some}
    hosts = (
        failed.where(host.isNotNull())
        .groupBy(host.alias("_host"))
        .agg(F.count("*").alias("n"), *[F.sum(flag.cast("long")).alias(r) for r, flag in flags.items()])
    )
    # Mean and variance of the rates over hosts: one row.
    row = hosts.agg(
        *[F.avg(F.col(r) / F.col("n")).alias(f"{r}_mean") for r in flags],
        *[F.var_samp(F.col(r) / F.col("n")).alias(f"{r}_var") for r in flags],
        F.sum(F.octet_length(F.col("_host").cast("string")) + 64).alias("bytes"),
    ).collect()[0]
    prior, shrunk = {}, []
    for r in flags:
        mean, var = row[f"{r}_mean"] or 0.0, row[f"{r}_var"] or 0.0
        weight = mean * (1 - mean) / var - 1 if var > 0 else rules.max_prior
        weight = min(max(weight, 1.0), rules.max_prior)
        prior[r] = mean
        shrunk.append(((F.col(r) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))).alias(f"_rate_{r}"))
    rates = hosts.select("_host", *shrunk)
    return F.broadcast(rates) if (row["bytes"] or 0) <= broadcast_bytes else rates, prior


def judged(
    docs: DataFrame,
    rules: HostRules = HostRules(),
    host_column: str = "source",
    text_column: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` with measures, ``base_failed`` and ``kept``.

    Measures are taken once and written to the shared folder; the text goes
    along only on demand.
    """
    measures = measured(docs, text_column)
    if not keep_text:
        measures = measures.drop(text_column)
    failed = failures(written(measures, "measures"), rules)
    rates, prior = verdicts(failed, rules, host_column)
    joined = failed.join(rates, F.col(quoted(host_column)) == F.col("_host"), "left")

    def rate(rule: str) -> Column:
        return F.coalesce(F.col(f"_rate_{rule}"), F.lit(prior[rule]))

    rejected = rate("some") >= rules.host_rate
    for rule in SOFT:
        rejected = rejected | (F.col(f"_{rule}") & (rate(rule) >= rules.trust_rate))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(
        "_host", *[f"_{r}" for r in SOFT], *[f"_rate_{r}" for r in [*SOFT, "some"]]
    )


def accepted(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns."""
    apart, back = set_aside(docs, RESERVED)
    kept = judged(apart, rules, keep_text=True).where("kept")
    return kept.select(*[F.col(quoted(c)) for c in apart.columns]).withColumnsRenamed(back)
