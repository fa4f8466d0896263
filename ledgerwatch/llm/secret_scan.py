"""Secret scan: spans by pattern, then corpus-wide ownership frequency of the values.

Three base kinds are found by regular expressions. The method adds a fourth:
long random-looking runs outside the base spans, whose value is seen with few
owners over the whole corpus; a value that many owners share is a copied
example. Positions come from built-in functions alone: the pieces between the
matches (split) and the matches (regexp_extract_all) alternate, so running sums
of their lengths are the offsets, in code points. Sums run within runs of RUN
matches and over the runs, and a base span next to a candidate is found by halving,
so that a text of many matches costs little more than its length.

Plan: one scan writes the spans and candidate hashes of every text (a few bytes a
text) below the shared folder; values are reduced to distinct (value, repository,
owner) by partial aggregation, so that a value in a third of all rows costs no
task more than its distinct places; only owner-specific values go back to their
texts.

Without an owner column, a text's owner is the first e-mail address in it, or its
repository if it has none.

Defined cases: a null text is empty and has no spans; a null repository or owner
counts as one repository or owner named by the empty string; a null or repeated
id keeps its rows apart (they are told apart by a row number of the scan's
result, not by the id). Texts are scanned whole. Kept columns may have any names;
base, spans, n_live and n_example are added beside them. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import whole, written

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")

_KEYS = r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"(?:{_KEYS})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
_ASSIGN_HEAD = rf"^(?:{_KEYS})[\"']?\x20*[:=]\x20*[\"']?"
#: A run that is too short is skipped whole, so these give the runs of the least length.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RANDOM = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
#: Values with at most so many owners, in at most so many repositories, are an owner's own.
MAX_OWNERS = 2
MAX_REPOS = 4
#: Matches of a run, within which offsets are summed.
RUN = 128
#: Least number of different characters in a random-looking value.
MIN_DISTINCT = 10

_SPAN = "struct<s:bigint,k:int,e:bigint,v:string>"


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _offsets(sizes: str) -> Column:
    """The sum of all sizes before each run of RUN, of an array column."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda k: _sum(F.slice(sizes, k * RUN + 1, RUN)))
    return F.aggregate(runs, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _spans(found: str, gaps: str, sizes: str, offsets: str, kind: int) -> Column:
    """Spans of matches from the lengths of the gaps before them, of both together, and the sums before runs."""

    def span(v: Column, i: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        before = F.get(F.col(offsets), run) + _sum(F.slice(sizes, run * RUN + 1, i - run * RUN))
        return F.struct((before + F.get(F.col(gaps), i)).alias("s"), F.lit(kind).alias("k"), (before + F.get(F.col(sizes), i)).alias("e"), v.alias("v"))

    return F.transform(F.col(found), span)


def _found(df: DataFrame, kind: int, pattern: str) -> DataFrame:
    """Adds __s{kind}, the spans of the pattern in __t; texts without a match are looked through once."""
    t, no, none = F.col("__t"), F.array().cast("array<string>"), F.array().cast("array<bigint>")
    p, m, g, z, o = (f"__{x}{kind}" for x in "pmgzo")
    df = df.withColumn("__any", F.regexp_like(t, F.lit(pattern)))
    df = df.withColumns(
        {
            p: F.when(F.col("__any"), F.split(t, pattern)).otherwise(no),
            m: F.when(F.col("__any"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(no),
        }
    )
    length = lambda x: F.char_length(x).cast("bigint")
    df = df.withColumn(g, F.transform(F.slice(p, F.lit(1), F.size(m)), length))
    df = df.withColumn(z, F.zip_with(g, m, lambda a, x: a + length(x)))
    df = df.withColumn(o, F.when(F.size(z) > 0, _offsets(z)).otherwise(none))
    return df.withColumn(f"__s{kind}", F.when(F.size(m) > 0, _spans(m, g, z, o, kind)).otherwise(_none())).drop(p, m, g, z, o, "__any")


def _meets(spans: str, x: Column) -> Column:
    """Whether x overlaps one of the spans of a column, which are in order and apart from each other."""
    size = F.size(F.col(spans))
    # Halving finds the first span that ends behind the start of x.
    step = lambda a, _: F.when(a["l"] >= a["h"], a).otherwise(
        F.when(F.get(F.col(spans), F.floor((a["l"] + a["h"]) / 2).cast("int"))["e"] > x["s"], F.struct(a["l"].alias("l"), F.floor((a["l"] + a["h"]) / 2).cast("int").alias("h")))
        .otherwise(F.struct((F.floor((a["l"] + a["h"]) / 2).cast("int") + 1).alias("l"), a["h"].alias("h")))
    )
    start = F.struct(F.lit(0).alias("l"), size.alias("h"))
    at = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(size + F.lit(1))).cast("int")), start, step, lambda a: a["l"])
    return (size > 0) & F.coalesce(F.get(F.col(spans), at)["s"] < x["e"], F.lit(False))


def _value(span: Column) -> Column:
    """What the span assigns, or the run itself."""
    return F.when(span["k"] == 0, F.regexp_replace(span["v"], _ASSIGN_HEAD, "")).otherwise(span["v"])


def scan(df: DataFrame, text_col: str, keep: list[str], repo_col: str, owner_col: str | None) -> DataFrame:
    """Base spans (array of s, k, e, h, ordered) and random-looking candidates outside them, of each text.

    The kept columns come in a struct, whose names clash with none here.
    """
    c = lambda n: F.col(f"`{n}`")
    place = lambda n: F.coalesce(c(n).cast("string"), F.lit(""))
    kept = F.struct(*[c(n) for n in keep])
    owner = F.lit(None).cast("string") if owner_col is None else place(owner_col)
    out = df.select(kept.alias("__keep"), place(repo_col).alias("__repo"), owner.alias("__owner"), whole(c(text_col)).alias("__t"))
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX, RANDOM)):
        out = _found(out, kind, pattern)
    out = out.withColumn("__s0", F.filter("__s0", lambda x: F.char_length(_value(x)) >= 6))
    out = out.withColumn("base", F.array_sort(F.concat("__s0", "__s1", "__s2")))
    looks = lambda x: (
        x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(x["v"], ""))) >= MIN_DISTINCT)
    )
    out = out.withColumn("maybe", F.filter("__s3", looks))
    out = out.withColumn("maybe", F.filter("maybe", lambda x: ~(_meets("__s0", x) | _meets("__s1", x) | _meets("__s2", x))))
    if owner_col is None:
        # Texts without a span need no owner.
        email = F.regexp_extract("__t", EMAIL, 0)
        out = out.withColumn("__owner", F.when(F.size("base") + F.size("maybe") > 0, F.coalesce(F.nullif(email, F.lit("")), F.col("__repo"))))
    hashed = lambda c: F.transform(
        c, lambda x: F.struct(x["s"], x["k"], x["e"], F.unhex(F.sha2(_value(x), 256)).alias("h"))
    )
    return out.select("__keep", "__repo", "__owner", hashed(F.col("base")).alias("base"), hashed(F.col("maybe")).alias("maybe"))


def ownership(scanned: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each value (h) over the whole corpus, and its rows."""
    spans = scanned.select(F.col("__repo").alias("r"), F.col("__owner").alias("o"), F.explode(F.concat("base", "maybe")).alias("x"))
    by_place = spans.groupBy(F.col("x.h").alias("h"), "r", "o").agg(F.count(F.lit(1)).alias("n"))
    return by_place.groupBy("h").agg(F.count_distinct("o").alias("owners"), F.count_distinct("r").alias("repos"), F.sum("n").alias("uses"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined, in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["k"], x["e"]))),
            lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )


def find(
    df: DataFrame, text_col: str = "text", keep: list[str] | None = None, repo_col: str = "source", owner_col: str | None = None,
    max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS,
) -> DataFrame:
    """The kept columns, base and spans (arrays of s, k, e, h) and n_live, n_example over the base values.

    spans has the base spans and the added ones. A base value with at most max_owners
    owners and in at most max_repos repositories counts as live, else as a copied example.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    # A row's number is fixed by what is written: later reads see the same one.
    scanned = written(scan(df, text_col, keep, repo_col, owner_col).withColumn("__row", F.monotonically_increasing_id()), "secrets")
    own = ownership(scanned).where((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).select("h")
    hits = scanned.select("__row", F.explode(F.concat("base", "maybe")).alias("x"))
    live = (
        hits.join(own, F.col("x.h") == own["h"], "left_semi")
        .groupBy("__row")
        .agg(
            F.collect_list(F.when(F.col("x.k") == 3, F.col("x"))).alias("__add"),
            F.count_if(F.col("x.k") < 3).alias("n_live"),
        )
    )
    out = scanned.join(live, "__row", "left")
    spans = F.concat(F.col("base"), F.coalesce(F.col("__add"), F.array().cast("array<struct<s:bigint,k:int,e:bigint,h:binary>>")))
    n_live = F.coalesce(F.col("n_live"), F.lit(0)).cast("bigint")
    return out.select(
        *[F.col(f"__keep.`{c}`").alias(c) for c in keep], F.col("base"), spans.alias("spans"), n_live.alias("n_live"),
        (F.size("base") - n_live).cast("bigint").alias("n_example"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <kind>; overlapping spans merge under the first one's kind."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    zero = F.lit(0).cast("bigint")
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda acc, x: F.when(
        x["s"] >= acc["at"],
        F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], x["s"]), F.get(names, x["k"]))).alias("out")),
    ).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["k"], x["e"])))
    rest = lambda a: F.array_join(F.concat(a["out"], F.array(piece(a["at"], F.char_length(text).cast("bigint")))), "")
    return F.aggregate(ordered, F.struct(zero.alias("at"), F.array().cast("array<string>").alias("out")), step, rest)
