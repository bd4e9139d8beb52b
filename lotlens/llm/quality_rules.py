"""Quality rules by host: rule failures per host, shrunk by an empirical beta prior, and joined back to documents.

Every document gets counts and rule failures of its own. Per host the failing share is shrunk towards a beta prior,
which is fitted to all hosts by moments: its mean is the share of all documents, and its strength follows from how much
the shares differ beyond what chance does among hosts of such sizes. A host is judged by what its posterior share
exceeds with a chance of 95 %, so a host with few documents is not judged by chance. Its verdict sets how many soft
failures its documents may have: none on a suspect host, one elsewhere; a blocked host loses all of them. Where hosts
differ by chance alone, no verdict changes a row. Only DataFrame functions are used; texts are never exploded or
shuffled.

A null or empty text has no words and fails the length rule. A null host is a host of its own. Repeated rows are
judged one by one; there are no ties. An empty table gives an empty result. Very long texts are read whole. Other
columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.spark_util import materialize, pick

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; one separator first, so that the trimmed text has no empty piece at its ends."""
    trimmed = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " +"))


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each three-word window."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.array().cast("array<bigint>")).otherwise(hashes)


def _repeated_places(ordered: Column) -> Column:
    """Sorted places of the windows that stand in a text twice or more.

    `ordered` holds the windows sorted by hash with their places, so that equal ones are neighbours.
    """
    same = F.filter(ordered, lambda x, i: (F.when(i > 0, F.get(ordered, i - 1)["h"]) == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]))
    return F.array_sort(F.transform(same, lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Words covered by three-word windows at sorted places."""
    return F.when(F.size(places) == 0, F.lit(0)).otherwise(
        F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    )


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts of each whole text; one narrow pass."""
    text = F.coalesce(docs[text_col], F.lit(""))
    df = pick(docs, doc_id=docs[id_col].cast("long"), host=docs[host_col], text=text)
    df = df.withColumn("words", _words(F.col("text")))
    df = df.withColumn("hashes", _window_hashes(F.col("words")))
    h = F.col("hashes")
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    # most texts repeat no window, which a set of the hashes tells without a sort
    df = df.withColumn("ordered", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    df = df.withColumn("places", _repeated_places(F.col("ordered")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    df = df.withColumn("lines", lines)
    return df.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


#: Standard deviations below the posterior mean that a share exceeds with a chance of 95 %, and the strongest prior.
SURE, STRONGEST = 1.645, 1e6


def host_verdicts(counts: DataFrame, suspect: float = 1.5, blocked: float = 3.0) -> DataFrame:
    """host, its documents and failures, the shrunk failing share and the verdict.

    suspect, blocked: how many times the share of all documents a host's share must exceed with a chance of 95 %, by
    the normal approximation of the posterior; a blocked host must also fail in more than half of its documents.

    The prior is the beta distribution whose correlation within hosts is (S / (m (1 - m)) - (k - 1)) over
    (N - sum n^2 / N - (k - 1)), for k hosts with n of N documents, the overall share m, and S the squared deviations
    of the hosts' shares weighted by n. Without spread beyond chance its strength is held at STRONGEST documents, with
    very wide spread at 1.
    """
    hosts = counts.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    n, x = (F.col(c).cast("double") for c in ("host_docs", "host_failed"))
    sums = hosts.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.sum(n * n).alias("nn"), F.sum(x * x / n).alias("xx"), F.count("*").alias("k"))
    sums = sums.withColumn("m", F.col("x") / F.col("n")).withColumn("within", F.col("m") * (1 - F.col("m"))).withColumn("room", F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))
    spread = F.when((F.col("within") > 0) & (F.col("room") > 0), ((F.col("xx") - F.col("x") * F.col("m")) / F.col("within") - (F.col("k") - 1)) / F.col("room")).otherwise(0.0)
    prior = sums.withColumn("spread", spread).select("m", F.when(F.col("spread") > 1 / STRONGEST, F.greatest(F.lit(1.0), F.least(F.lit(STRONGEST), 1 / F.col("spread") - 1))).otherwise(STRONGEST).alias("strength"))
    rate, weight = (x + F.col("m") * F.col("strength")) / (n + F.col("strength")), n + F.col("strength") + 1
    judged = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", rate)
    judged = judged.withColumn("low", F.col("host_rate") - SURE * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / weight))
    verdict = F.when(F.col("low") > F.greatest(blocked * F.col("m"), F.lit(0.5)), "blocked").when(F.col("low") > suspect * F.col("m"), "suspect").otherwise("good")
    return judged.withColumn("host_verdict", verdict).select("host", "host_docs", "host_failed", "host_rate", "host_verdict")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The counts, `base_failed`, the host's shrunk rate and verdict, and `kept` for every document."""
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    symbols = 10 * F.col("n_symbols") > n
    soft = ((100 * F.col("n_dup_lines") > 30 * F.col("n_lines")).cast("int") + ((F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n)).cast("int"))
    counts = document_counts(docs, id_col, text_col, host_col).withColumn("base_failed", base).withColumn("hard", symbols).withColumn("soft", soft)
    counts = materialize(counts.withColumn("failed", F.col("base_failed") | F.col("hard") | (F.col("soft") > 0)))
    key = F.struct(F.coalesce("host", F.lit("")).alias("s"), F.col("host").isNull().alias("z"))
    joined = counts.withColumn("_k", key).join(host_verdicts(counts).withColumn("_k", key).drop("host"), "_k")
    allowed = F.when(F.col("host_verdict") == "suspect", 0).otherwise(1)
    kept = ~F.col("base_failed") & ~F.col("hard") & (F.col("host_verdict") != "blocked") & (F.col("soft") <= allowed)
    return joined.withColumn("kept", kept).select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed", F.round("host_rate", 9).alias("host_rate"), "host_verdict")
