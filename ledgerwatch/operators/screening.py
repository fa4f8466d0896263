"""Screening of names against lists: exact, edit distance, Jaro-Winkler and phonetic similarity.

Names are made distinct first, so a counterparty of many transactions is compared
once. List aliases are normalised once and blown up to one row each. Where only
exact and edit-distance similarity are asked for, pairs are first joined on
length classes, which loses none; the phonetic one has no such bound, so it
compares all pairs of distinct names and list entries (a stated list, checked in size).
Jaro-Winkler, which runs in Python, is left to pairs whose common letters let it
reach the threshold, or that another similarity brings there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.text import ALGORITHMS, heard, plain_name_udf, sounds

#: A list of more rows (aliases included) isn't broadcast.
MAX_LIST = 200_000
DEFAULT_ALGORITHMS = ("exact", "jaro_winkler", "levenshtein", "phonetic")


def prepared(entries: DataFrame) -> DataFrame:
    """A row for the name and each alias of an entry: entry_id, place, plain."""
    rows = entries.select("entry_id", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("place", "alias"))
    return rows.withColumn("plain", plain_name_udf("alias")).where("plain <> ''").select("entry_id", "place", "plain")


def _letters(c: Column) -> Column:
    """The letters of a text, repeated ones told apart by their number."""
    each = F.array_sort(F.array_remove(F.split(c, ""), ""))
    return F.transform(each, lambda x, i: F.concat(x, (i - F.array_position(each, x)).cast("string")))


def _jaro_winkler_bound() -> Column:
    """What Jaro-Winkler can be at most, from the number of common letters."""
    common = F.size(F.array_intersect("ql", "pl"))
    jaro = F.when(common == 0, F.lit(0.0)).otherwise((common / F.size("ql") + common / F.size("pl") + 1) / 3)
    return F.when(jaro <= 0.7, jaro).otherwise(jaro + 0.4 * (1 - jaro))


def matches(names: DataFrame, entries: DataFrame, threshold: float, algorithms: Sequence[str] = DEFAULT_ALGORITHMS, name_col: str = "name") -> DataFrame:
    """name, entry_id, score (4 places) and algorithm of each name and entry from the threshold on.

    Per pair the best algorithm counts, of equal ones the first; per entry the best
    alias, of equal ones the first.
    """
    distinct = names.select(F.col(name_col).alias("name")).where("name is not null").distinct()
    distinct = distinct.withColumn("q", plain_name_udf("name")).where("q <> ''")
    listed = prepared(entries)
    if "jaro_winkler" in algorithms:
        distinct, listed = distinct.withColumn("ql", _letters(F.col("q"))), listed.withColumn("pl", _letters(F.col("plain")))
    if "phonetic" in algorithms:
        # Coded once a name, not once a pair.
        distinct, listed = distinct.withColumn("qs", sounds(F.col("q"))), listed.withColumn("ps", sounds(F.col("plain")))
    score = lambda a: heard(F.col("qs"), F.col("ps")) if a == "phonetic" else ALGORITHMS[a](F.col("q"), F.col("plain"))
    if set(algorithms) <= {"exact", "levenshtein"}:
        # 1 - d / longest >= t leaves lengths within the factor t; classes by the logarithm of t meet their neighbours only.
        step = F.lit(-1.0) * F.log(F.lit(max(0.05, min(threshold, 0.99))))
        cls = lambda c: F.floor(F.log(F.char_length(c).cast("double")) / step).cast("int")
        near = listed.withColumn("cls", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cls(F.col("plain")) + d)))
        pairs = distinct.withColumn("cls", cls(F.col("q"))).join(near, "cls").drop("cls")
    else:
        n = listed.count()
        listed = F.broadcast(listed) if n <= MAX_LIST else listed
        pairs = distinct.join(listed, F.lit(True))
    scored = {a: F.struct(score(a).alias("s"), F.lit(-i).alias("o"), F.lit(a).alias("a")) for i, a in enumerate(algorithms)}
    slow = scored.pop("jaro_winkler", None)
    none = F.array().cast("array<struct<s:double,o:int,a:string>>")
    pairs = pairs.withColumn("best", F.array_max(F.array(*scored.values())) if scored else F.array_max(none))
    if slow is not None:
        reach = (F.col("best.s") >= threshold) | (_jaro_winkler_bound() >= threshold - 1e-9)
        pairs = pairs.where(F.coalesce(reach, _jaro_winkler_bound() >= threshold - 1e-9))
        pairs = pairs.withColumn("best", F.array_max(F.filter(F.array("best", slow), lambda x: x.isNotNull())))
    best = pairs.where(F.col("best.s") >= threshold)
    best = best.select("name", "entry_id", "place", F.round("best.s", 4).alias("score"), F.col("best.a").alias("algorithm"))
    one = best.groupBy("name", "entry_id").agg(F.max(F.struct("score", (-F.col("place")).alias("o"), "algorithm")).alias("m"))
    return one.select("name", "entry_id", "m.score", "m.algorithm")


def search(names: DataFrame, entries: DataFrame, threshold: float = 0.85, algorithms: Sequence[str] = DEFAULT_ALGORITHMS, country: str | None = None, name_col: str = "name") -> DataFrame:
    """matches() with the entries' fields, best first; country narrows the list, whatever its case."""
    if country is not None:
        entries = entries.where(F.lower("country") == country.lower())
    facts = entries.select("entry_id", F.col("name").alias("matched_name"), "entity_type", "source", "country", "risk_level")
    return matches(names, entries, threshold, algorithms, name_col).join(facts, "entry_id").orderBy(F.desc("score"), "matched_name", "entry_id")


def screen_name(name: str, sanctions: DataFrame, pep: DataFrame | None = None, threshold: float = 0.85, pep_threshold: float = 0.8, algorithms: Sequence[str] = DEFAULT_ALGORITHMS) -> DataFrame:
    """search() of one name in both lists; the list of politically exposed persons is asked with the lower of the thresholds."""
    asked = sanctions.sparkSession.createDataFrame([(name,)], "name string")
    out = search(asked, sanctions, threshold, algorithms).withColumn("list", F.lit("sanctions"))
    if pep is not None:
        out = out.unionByName(search(asked, pep, min(threshold, pep_threshold), algorithms).withColumn("list", F.lit("pep")))
    return out.orderBy("list", F.desc("score"), "matched_name", "entry_id")


def keyword_hits(names: DataFrame, params: dict) -> DataFrame:
    """What stands in for a list where none is loaded: counterparty and h, one hit for the first keyword in it."""
    from ledgerwatch.operators.rules import first_keyword, hit

    word = first_keyword(F.col("counterparty"), [k.lower() for k in params.get("keywords", ())])
    reason = F.concat(F.lit("Counterparty name matches sanctions keyword: '"), F.col("k"), F.lit("'"))
    h = hit("SanctionsScreening", {"severity": "high", **params}, reason, counterparty=F.col("counterparty"), keyword=F.col("k"), method=F.lit("keyword_fallback"))
    return names.distinct().withColumn("k", word).where("k is not null").select("counterparty", h.alias("h"))


def screening_hits(txns: DataFrame, sanctions: DataFrame | None, pep: DataFrame | None, params: dict) -> DataFrame:
    """counterparty and screening: the hits that every transaction with this counterparty gets.

    One hit for each entry of a list; without a list of sanctions, keywords take its place.
    """
    names = txns.select("counterparty")

    def of(entries: DataFrame, rule: str, threshold: float, delta: float, severity):
        found = search(names, entries, threshold, params["algorithms"], name_col="counterparty")
        evidence = F.to_json(F.struct(
            F.col("name").alias("counterparty"), "matched_name", F.col("score").alias("match_confidence"), F.col("algorithm").alias("match_algorithm"),
            F.col("source").alias("sanctions_list"), "entity_type", "source", "country",
        ))
        return found.select(F.col("name").alias("counterparty"), F.struct(
            F.lit(rule).alias("rule_id"), severity.alias("severity"),
            F.concat(F.lit("Counterparty matches '"), F.col("matched_name"), F.lit("' ("), F.format_string("%.2f%%", F.col("score") * 100), F.lit(")")).alias("reason"),
            evidence.alias("evidence"), F.lit(float(delta)).alias("score_delta"),
        ).alias("h"))

    if sanctions is None:
        out = keyword_hits(names, params)
    else:
        out = of(sanctions, "SanctionsScreening", params["threshold"], params["score_delta"], F.lit("high"))
    if pep is not None:
        level = F.when(F.lower("risk_level") == "high", "high").otherwise("medium")
        out = out.unionByName(of(pep, "SanctionsScreening", params["pep_threshold"], 0.8 * params["score_delta"], level))
    return out.groupBy("counterparty").agg(F.sort_array(F.collect_list("h")).alias("screening"))
