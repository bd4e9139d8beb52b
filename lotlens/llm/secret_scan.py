"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every whole text and located by the lengths of what lies between them. Each candidate value
is then counted over the corpus by distinct documents, repositories and owners: a value that many owners hold, or many
repositories of a few owners, was copied from an example; a value that one owner holds, and that looks random, is taken
for a live credential.

A value looks random if it has 12 signs or more, a digit and a letter among them, and their entropy is at least three
quarters of the most that so many signs of its alphabet (digits and small hex letters, or more) could have.

Nulls and empty texts have no candidates; a null owner or repository counts as one of its own, apart from all named
ones. Repeated rows are scanned one by one; spans that begin together stand in the order of the kinds. An empty table
gives an empty result. Very long texts are read whole. Other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.llm.spark_util import materialize, pick, skew_join


@dataclass(frozen=True)
class Kind:
    """A pattern, the group with the secret itself, its least length, and a cheap test that texts must pass first."""

    name: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 0
    base: bool = False
    #: The same for engines without look-behind, which read a token once anyway; it also begins after a hyphen.
    plain: str | None = None


# The base kinds in the order in which they are listed, then the method's own, which are bounded so that
# a long run of letters is read once.
KINDS = [
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)pass|secret|token|api", 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", r"AKIA", 0, 20, True),
    Kind("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 0, 24, True),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN "),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"eyJ", plain=r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("ghtoken", r"gh[pousr]_[A-Za-z0-9]{36}", r"gh[pousr]_"),
    Kind("urlpass", r"[a-z][a-z0-9+]{0,30}://[^\s:/@]+:[^\s:/@]+@", r"://"),
]


def _found(text: Column, kind: Kind, order: int) -> Column:
    """The matches of one kind as structs: place in the text's list, gap before, length, value, long enough."""
    gaps = F.split(text, kind.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)) if kind.group else values
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), values.alias("value")),
        lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("length"), F.when(F.length(x["value"]) >= kind.least, x["value"]).alias("value")),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,length:int,value:string>>")
    return F.when(text.rlike(kind.gate), rows).otherwise(none)


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """All documents as (row, doc_id), and the candidates as (row, kind, start, end, value, owner, repo).

    Runs of hex digits under the least length stay in the list of matches, since they are gaps to nothing else:
    a text with a long run passes its gate, all others are never split.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = pick(docs, row=F.monotonically_increasing_id(), doc_id=docs[id_col].cast("long"), owner=docs[owner_col].cast("string"), repo=docs[repo_col].cast("string"), text=text)
    kinds = [Kind(k.name, "[0-9a-f]{24,}", k.gate, 0, k.least, True) if k.name == "hex" else k for k in KINDS]  # the same long runs, greedy as they are
    rows = materialize(rows.select("row", "doc_id", "owner", "repo", F.concat(*[_found(F.col("text"), k, i) for i, k in enumerate(kinds)]).alias("found")))
    spans = rows.filter(F.size("found") > 0).select("row", "owner", "repo", F.inline("found"))
    upto = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    spans = spans.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).filter("value is not null")
    return rows.select("row", "doc_id"), spans.select("row", "kind", "start", "end", "value", "owner", "repo")


def looks_random(value: Column) -> Column:
    """By length, digits and letters, and entropy against the most that the alphabet allows."""
    size = F.length(value)
    signs = F.array_distinct(F.split(value, ""))
    part = lambda x: (size - F.length(F.replace(value, x, F.lit("")))) / size
    entropy = F.aggregate(F.transform(signs, lambda x: -part(x) * F.log2(part(x))), F.lit(0.0), lambda a, x: a + x)
    alphabet = F.when(value.rlike("^[0-9a-f]*$"), 16).when(value.rlike("^[0-9a-z]*$|^[0-9A-Z]*$"), 36).otherwise(64)
    most = F.least(F.log2(size), F.log2(alphabet))
    return (size >= 12) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.round(entropy, 6) >= F.round(0.75 * most, 6))


def ownership(spans: DataFrame, example_owners: int = 3, example_repos: int = 6) -> DataFrame:
    """value_hash with its places, repositories, owners and class: example, live or plain.

    An example is held by `example_owners` owners or in `example_repos` repositories; what looks random and is held by
    one owner in fewer repositories is live. Distinct (value, repository, owner) come first, so a value that a third of
    all rows holds is counted by partial sums and never gathered.
    """
    name = lambda c: F.struct(F.coalesce(c, F.lit("")).alias("name"), F.col(c).isNull().alias("none"))
    held = spans.select("value_hash", name("owner").alias("owner"), name("repo").alias("repo"), looks_random(F.col("value")).alias("random"))
    held = held.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"), F.bool_or("random").alias("random"))
    # a repository's name is its own in each owner
    per_owner = held.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.bool_or("random").alias("random"), F.count("*").alias("repos"))
    out = per_owner.groupBy("value_hash").agg(F.sum("n").alias("places"), F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.bool_or("random").alias("random"))
    widely = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    return out.withColumn("class", F.when(widely, "example").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("plain"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", example_owners: int = 3, example_repos: int = 6) -> DataFrame:
    """doc_id, counts of the base kinds, digests of the spans, and live and copied values of every document.

    All base spans are returned; those of the method's own kinds unless their value is a widely copied example.
    most_owners and most_repos are those of the document's most widely held value.
    """
    rows, spans = find_candidates(docs, id_col, text_col, owner_col, repo_col)
    spans = materialize(spans.withColumn("value_hash", F.sha2("value", 256)))
    owned = ownership(spans, example_owners, example_repos).select("value_hash", "class", "owners", "repos")
    spans = skew_join(spans.select("row", "kind", "start", "end", "value_hash"), owned, "value_hash")
    base = F.col("kind") < sum(k.base for k in KINDS)
    name = F.get(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind"))
    item = F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("text"))
    kept = spans.filter(base | (F.col("class") != "example"))
    joined = lambda items: F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), ",")
    per_row = kept.groupBy("row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base],
        joined(F.collect_list(F.when(base, item))).alias("base_spans"),
        joined(F.collect_list(item)).alias("spans"),
        F.count_if(F.col("class") == "live").alias("n_live"),
        F.count_if(F.col("class") == "example").alias("n_example"),
        F.max("owners").alias("most_owners"),
        F.max("repos").alias("most_repos"),
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in (*[f"n_{k.name}" for k in KINDS if k.base], "n_live", "n_example", "most_owners", "most_repos")]
    out = rows.join(per_row, "row", "left")
    return out.select("doc_id", *counts, F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
