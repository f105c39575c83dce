"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions only.

Every text is searched for candidates.  A candidate's value is hashed, and the
hashes are counted over the whole corpus: in how many distinct repositories (by
default each distinct text is one, so copies of a document count once) and under how
many distinct owners (the source; of a repository under several owners the first by
name).  A value that looks live (mixed characters, no run of a filler) and has few
owners and few repositories is owner-specific and gets a span `owned`; one that many
owners share, or that one owner repeats over many repositories, is a widely copied
example.  The base spans stay as they are.

How it runs.  One pass over the texts makes a slim table of spans and candidate
hashes, written to the shared folder; all later steps work on it.  Counting first
reduces to one row for each (hash, repository), then for each (hash, owner), then by
hash, each with partial aggregation and under a key of its own, so that no task holds
all repositories of a hash.  The counts return to the occurrences by a join that Spark may split.

Defined results.  Null or empty text: no spans.  Null owner or repository: an owner
or repository named "".  Ties in start: base kinds in their listed order, then
`owned`.  Repeated rows: each is reported, but one repository only.  Empty table:
empty result.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import let, materialize, span_list, text_or_empty


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    value_group: int = 0
    least: int = 0


#: Fixed patterns.  A run of hex digits or of AKIA characters is maximal, so its least length can stand in the pattern;
#: a failing `assign` still uses up its text, so it is matched first and dropped after.
BASE = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: Bare runs that may be keys: counted over the corpus like the base values.
BARE = Kind("bare", r"[A-Za-z0-9_-]{24,}")
OWNED = "owned"
#: A value under more owners, or in more repositories, than these is an example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 10
#: Matches whose places are added up at once.
BLOCK = 128
#: Distinct characters that a live-looking value has at least.
LEAST_DISTINCT = 8


def located(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, value, value_start>> of the pattern's leftmost matches, in code points.

    The pieces between the matches and the matches themselves add up to the text, which gives the places.
    """

    place = "array<struct<start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end")))).alias("out"))

    def places(pieces: Column) -> Column:
        """Running sums block by block, since every addition to an array copies it."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(pieces, k * BLOCK + 1, BLOCK), F.struct(F.lit(0).alias("at"), F.array().cast(place).alias("out")), step))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,out:{place}>>").alias("out"))
        based = F.aggregate(blocks, begin, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x["out"].alias("out")))).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.transform(based, lambda b: F.transform(b["out"], lambda p: F.struct((b["at"] + p["start"]).alias("start"), (b["at"] + p["end"]).alias("end")))))

    def walk(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(1 + kind.value_group))
        pieces = let(F.split(text, kind.pattern), lambda g: F.transform(found, lambda m, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(m).alias("n"))))
        return F.zip_with(let(pieces, places), values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    # texts without a match, the most by far, are read once by the cheapest call
    out = F.when(text.rlike(kind.pattern), let(F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(1)), walk)).otherwise(none)
    return F.filter(out, lambda x: F.length(x["value"]) >= kind.least) if kind.least else out


def _named(spans: Column, order: int, name: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), F.lit(name).alias("kind"), x["end"].alias("end")))


def looks_live(value: Column) -> Column:
    """Digits and letters both, enough distinct characters, no four equal ones in a row, no word that marks a filler."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (
        value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= LEAST_DISTINCT) & ~value.rlike(r"(.)\1{3}") & ~F.lower(value).rlike("example|sample|dummy|changeme|placeholder|your")
    )


def candidates(docs: DataFrame, repository: str | None = None, owner: str = "source") -> DataFrame:
    """One slim row for each document: id, repository, owner, base spans and hashed candidates."""
    place = F.col(repository).cast("string") if repository else F.hex(F.xxhash64(text_or_empty()))
    spans = {k.name: located(F.col("_text"), k) for k in BASE}
    held = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(place, F.lit("")).alias("repository"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), text_or_empty().alias("_text")
    ).select("*", *[v.alias(f"_{k}") for k, v in spans.items()], located(F.col("_text"), BARE).alias("_bare"))
    base = F.concat(*[_named(F.col(f"_{k.name}"), i, k.name) for i, k in enumerate(BASE)])
    # the value of an assignment ends where its match ends
    value = lambda x: F.struct(F.unhex(F.substring(F.sha2(x["value"], 256), 1, 32)).alias("hash"), (x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), looks_live(x["value"]).alias("live"))
    found = F.array_distinct(F.transform(F.concat(F.col("_assign"), F.col("_access"), F.col("_hex"), F.col("_bare")), value))
    return held.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "repository", "owner", *[F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE], base.alias("base"), found.alias("found")
    )


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories and n_owners of every candidate value."""
    once = found.groupBy("hash", "repository").agg(F.min("owner").alias("owner"))
    return once.groupBy("hash", "owner").count().groupBy("hash").agg(F.sum("count").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, repository: str | None = None, owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Base counts and spans of each document, with the spans of owner-specific live-looking values and how many values are examples."""
    slim = materialize(candidates(docs, repository, owner), "secret-spans")
    found = slim.where(F.size("found") > 0).select("row_id", "owner", "repository", F.inline("found"))
    counts = materialize(ownership(found), "secret-counts")  # a plain table, so that Spark may split the join on a hot hash
    example = (F.col("n_owners") > most_owners) | (F.col("n_repositories") > most_repositories)
    judged = found.join(counts, "hash").withColumns({"example": example, "owned": F.col("live") & ~example})
    span = F.struct("start", F.lit(len(BASE)).alias("ord"), F.lit(OWNED).alias("kind"), "end")
    added = judged.groupBy("row_id").agg(
        F.collect_set(F.when(F.col("owned"), span)).alias("added"),
        F.sum(F.col("owned").cast("long")).alias("n_owned"),
        F.sum(F.col("example").cast("long")).alias("n_copied"),
        F.max("n_repositories").alias("most_repositories"),
    )
    out = slim.join(added, "row_id", "left")
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id", *[f"n_{k.name}" for k in BASE], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.concat("base", F.coalesce("added", empty))).alias("spans"), zero("n_owned"), zero("n_copied"), zero("most_repositories")
    )
