"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The model is trained by SQL functions from a small labelled URL table and read as
weights of the buckets that occur in it, which become one array literal of the
scoring projection. So scoring is a projection above the scan, without a shuffle.

The labelled table (data/labelled_urls.csv, 185 urls) was written by hand for this
library: hosts of gambling, adult, pill, piracy, fraud, spam and advertising sites
against hosts of ordinary ones, half of these made-up names, all below reserved
example domains. A url's label holds for its host behind each of BEGINS too.

Defined cases: a null url, or one without "://", has an empty host and path; an
empty pair fits no rule and is allowed. Repeated rows give a row each. Urls of
any length are scored whole, in time linear in their length. Columns named host,
path, rule, score and verdict are replaced. An empty labelled table gives no
weights and the score 0.5; an empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.common import pinned

#: Buckets of the n-grams' hashes.
N_BUCKETS = 1 << 18
#: Lengths of the character n-grams.
GRAMS = (3, 4, 5)
#: The labelled table is cut to so many rows, by the hash of the url.
MAX_LABELLED = 2000
#: Rules are compiled into the plan; a longer list is refused.
MAX_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """Host and path prefix, as in `example.com/en/`; the host stands for its subdomains too."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


DEFAULT_RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)

LABELLED = Path(__file__).parent / "data" / "labelled_urls.csv"
#: What a host may begin with.
BEGINS = ("", "www.", "m.", "blog.")


@dataclass(frozen=True)
class Model:
    """Weights by bucket (0 where none is given) and the bias."""

    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)


def labelled_urls(spark: SparkSession, path: Path = LABELLED) -> DataFrame:
    """The labelled table (url, label) in all its forms; label 1 means block. The file is this library's own."""
    out = []
    for line in path.read_text().splitlines()[1:]:
        url, y = line.rsplit(",", 1)
        scheme, rest = url.split("://")
        name = reduce(str.removeprefix, BEGINS, rest)
        out += [(f"{scheme}://{begin}{name}", int(y)) for begin in BEGINS]
    return spark.createDataFrame(out, "url string, label int")


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path to df; they replace columns of these names."""
    u = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    raw = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    tail = F.substring(rest, F.length(raw) + 1, F.length(rest))
    low = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns(
        {"host": low, "path": F.substring_index(F.substring_index(tail, "?", 1), "#", 1)}
    )


def rule_column(rules: tuple[Rule, ...], take: str) -> Column:
    """The pattern or verdict of the longest rule that fits host and path; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled into a plan")
    host, path = F.col("host"), F.col("path")
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        fits = (host == r.host) | F.endswith(host, F.lit(f".{r.host}"))
        out = F.when(fits & F.startswith(path, F.lit(r.path)), F.lit(getattr(r, take))).otherwise(out)
    return out


def gram_buckets(chars: Column) -> Column:
    """Buckets of all character n-grams of an array of characters."""
    none = F.array().cast("array<int>")

    def of(n: int) -> Column:
        at = F.sequence(F.lit(0), F.size(chars) - n)
        gram = lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])
        cells = F.transform(at, lambda i: F.pmod(F.xxhash64(gram(i)), F.lit(N_BUCKETS)).cast("int"))
        return F.when(F.size(chars) >= n, cells).otherwise(none)

    return F.concat(*[of(n) for n in GRAMS])


def with_buckets(df: DataFrame) -> DataFrame:
    """Adds __b, the buckets of host and path."""
    chars = df.withColumn("__c", F.array_remove(F.split(F.concat(F.col("host"), F.lit(" "), F.col("path")), ""), ""))
    return chars.withColumn("__b", gram_buckets(F.col("__c"))).drop("__c")


def train(labelled: DataFrame, steps: int = 50, rate: float = 4.0, keeps: float = 0.85, decay: float = 0.0005) -> Model:
    """Weights by gradient descent with momentum over all rows at once, classes weighing the same.

    At most MAX_LABELLED rows, those of the smallest url hashes, are gathered in one
    array of rows with their cells, and one of buckets with their rows. A step is in
    three parts, the rows' errors, the momentum and the weights, so that each is
    evaluated once and reads only cells that are there. Rows with a null url or label are left out.
    """
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(MAX_LABELLED)
    b = with_buckets(with_parts(rows)).withColumn("__n", F.sqrt(F.greatest(F.size("__b"), F.lit(1)).cast("double")))
    b = b.withColumn("id", F.row_number().over(Window.orderBy(F.xxhash64("url"), "url", "y")) - 1)
    cells = b.select("id", F.explode("__b").alias("c"), (1 / F.col("__n")).alias("v")).groupBy("id", "c").agg(F.sum("v").alias("v"))
    posts = cells.groupBy("c").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("at"), "v"))).alias("rows"))
    posts = posts.agg(F.sort_array(F.collect_list(F.struct("c", "rows"))).alias("posts"))
    at = posts.select(F.posexplode("posts").alias("at", "p")).select("at", F.col("p.c").alias("c"))
    by_row = cells.join(at, "c").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("cells"))
    by_row = b.select("id", "y").join(by_row, "id", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<at:int,v:double>>")))
    of = lambda y: F.greatest(F.count_if(F.col("y") == y), F.lit(1))
    share = F.struct((0.5 / of(1)).alias("one"), (0.5 / of(0)).alias("none")).alias("share")
    table = by_row.agg(F.sort_array(F.collect_list(F.struct("id", "y", "cells"))).alias("rows"), share).crossJoin(posts)  # a row each
    r, p, w = F.col("rows"), F.col("posts"), lambda x: F.when(x["y"] == 1, F.col("share.one")).otherwise(F.col("share.none"))
    zeros = lambda c: F.transform(c, lambda _: F.lit(0.0))

    def step(acc: Column, i: Column) -> Column:
        margin = lambda x: acc["bias"] + F.aggregate(x["cells"], F.lit(0.0), lambda a, c: a + c["v"] * F.get(acc["w"], c["at"]))
        errors = F.transform(r, lambda x: w(x) * (x["y"] - 1 / (1 + F.exp(-margin(x)))))
        pull = lambda x: F.aggregate(x["rows"], F.lit(0.0), lambda a, c: a + c["v"] * F.get(acc["e"], c["at"]))
        speed = F.zip_with(acc["m"], p, lambda a, x: keeps * a + rate * pull(x))
        new = F.zip_with(acc["w"], acc["m"], lambda a, x: a * (1 - rate * decay) + x)
        bias = acc["bias"] + rate * 0.1 * F.aggregate(acc["e"], F.lit(0.0), lambda a, x: a + x)
        state = lambda **x: F.struct(*[x.get(k, acc[k]).alias(k) for k in ("w", "m", "bias", "e")])
        return F.when(i % 3 == 0, state(e=errors)).when(i % 3 == 1, state(m=speed)).otherwise(state(w=new, bias=bias))

    start = F.struct(zeros(p).alias("w"), zeros(p).alias("m"), F.lit(0.0).alias("bias"), zeros(r).alias("e"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(3 * steps - 1)), start, step)
    out = table.select(F.transform("posts", lambda x: x["c"]).alias("c"), end.alias("end")).select("c", "end.w", "end.bias").first()
    return Model(out["bias"], dict(zip(out["c"], out["w"], strict=True)))


def weight_array(model: Model) -> Column:
    """All buckets' weights as one array; a literal once Spark has folded it."""
    texts = ["0"] * N_BUCKETS
    for c, x in model.weights.items():
        texts[c] = repr(x)
    return F.split(F.lit(",".join(texts)), ",").cast("array<double>")


def score(df: DataFrame, model: Model) -> DataFrame:
    """Adds score, the probability that a url (by its host and path) is to be blocked."""
    b = with_buckets(df)
    weights = weight_array(model)
    total = F.aggregate("__b", F.lit(0.0), lambda a, c: a + F.get(weights, c))
    margin = total / F.sqrt(F.greatest(F.size("__b"), F.lit(1)).cast("double")) + F.lit(model.bias)
    return b.withColumn("score", pinned(1 / (1 + F.exp(-margin)))).drop("__b")


def judge(
    df: DataFrame, model: Model, url_col: str = "url", rules: tuple[Rule, ...] = DEFAULT_RULES, threshold: float = 0.5
) -> DataFrame:
    """Adds host, path, rule, score and verdict (the rule's, else block from the threshold on)."""
    out = score(with_parts(df, url_col), model)
    empty = (F.col("host") == "") & (F.col("path") == "")
    by_model = F.when(~empty & (F.col("score") >= threshold), "block").otherwise("allow")
    return out.withColumns(
        {"rule": rule_column(rules, "pattern"), "verdict": F.coalesce(rule_column(rules, "verdict"), by_model)}
    )
