"""Places: administrative units with their paths, and addresses resolved to points by postal code, name, unit or country."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Kinds of points, the most precise first; the least part of a postal code that names an area.
PRECISION = ("premises", "street", "postal_area", "locality", "subdivision", "country")
LEAST_PREFIX, MOST_PLACES = 2, 12


@F.pandas_udf(StringType())
def normal_name(names: pd.Series) -> pd.Series:
    """Names for comparison: composed, without case, with single blanks. Spark has no function that composes or folds letters."""
    return names.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()).casefold())


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else x.strip().casefold())


def normal_postal_code(code: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(code, F.lit("")))), r"[\s\-./]", "")


def at_least_as_precise(new: Column, old: Column) -> Column:
    """Whether a point of kind `new` may replace one of kind `old`; any may replace none, and unknown kinds come last."""
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRECISION)), c), F.lit(0)), F.lit(10))
    return F.when(F.coalesce(old, F.lit("")) == "", True).otherwise(rank(new) <= rank(old))


def unit_problems(units: DataFrame) -> DataFrame:
    """(country, level, code, problem) of units (country, level, code, parent_code, name): no code, no name, twice, no parent, a parent that isn't there, a parent at the top."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    top = units.groupBy("country").agg(F.min("level").alias("_top"))
    counts = units.groupBy("country", "level", "code").agg(F.count("*").alias("_n"))
    parents = units.select("country", (F.col("level") + 1).alias("level"), F.col("code").alias("parent_code"), F.lit(True).alias("_found")).distinct()
    d = units.join(top, "country").join(counts, ["country", "level", "code"], "left").join(parents, ["country", "level", "parent_code"], "left")
    at_top = F.col("level") == F.col("_top")
    checks = [(blank("code"), "no code"), (blank("name"), "no name"), (F.col("_n") > 1, "twice"), (at_top & ~blank("parent_code"), "parent at the top"), (~at_top & blank("parent_code"), "no parent"), (~at_top & ~blank("parent_code") & F.col("_found").isNull(), "parent is not there")]
    found = F.filter(F.array(*[F.when(c, p) for c, p in checks]), lambda x: x.isNotNull())
    return d.select("country", "level", "code", F.explode(found).alias("problem")).distinct()


def with_paths(units: DataFrame, most_levels: int = 6) -> DataFrame:
    """units with admin_path, their codes from the country down. A join for each level there is, most_levels at most."""
    levels = sorted(r[0] for r in units.select("level").distinct().limit(most_levels + 1).collect())
    if len(levels) > most_levels:
        raise ValueError(f"more than {most_levels} levels")
    done: list[DataFrame] = []
    for level in levels:
        own = units.where(F.col("level") == level)
        if done:
            above = done[-1].select("country", F.col("code").alias("parent_code"), F.col("admin_path").alias("_above"))
            own = own.join(above, ["country", "parent_code"], "left")
        else:
            own = own.withColumn("_above", F.lit(None).cast("string"))
        done.append(own.select(*units.columns, F.concat_ws("/", F.coalesce("_above", "country"), "code").alias("admin_path")))
    return reduce(DataFrame.unionByName, done) if done else units.withColumn("admin_path", F.lit("").cast("string"))


def _longest_begins(addresses: DataFrame, postal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(country, _code, _key) of each code that is asked for, as normal_postal_code has it, with its longest begin that postal has; and postal with _key."""
    # distinct codes only: few that many addresses share would else be hot keys of the join by begin
    codes = addresses.select("country", normal_postal_code(F.col("postal_code")).alias("_code")).distinct().where(F.length("_code") >= LEAST_PREFIX)
    begins = codes.withColumn("_key", F.explode(F.transform(F.sequence(F.lit(LEAST_PREFIX), F.length("_code")), lambda n: F.substr("_code", F.lit(1), n))))
    keys = postal.withColumn("_key", normal_postal_code(F.col("code")))
    return begins.join(keys.select("country", "_key").distinct(), ["country", "_key"]).groupBy("country", "_code").agg(F.max_by("_key", F.length("_key")).alias("_key")), keys


def by_postal_code(addresses: DataFrame, postal: DataFrame) -> DataFrame:
    """(address_id, key, place, latitude, longitude, position) of the longest begin, of LEAST_PREFIX characters or more, that postal (country, code, place, latitude, longitude, position) has of an address's code."""
    longest, keys = _longest_begins(addresses, postal)
    coded = addresses.select("address_id", "country", normal_postal_code(F.col("postal_code")).alias("_code"))
    return coded.join(longest, ["country", "_code"]).join(keys, ["country", "_key"]).select("address_id", F.col("code").alias("key"), "place", "latitude", "longitude", "position")


def _best_named(addresses: DataFrame, localities: DataFrame) -> DataFrame:
    """(country, locality, _best) of the names that are asked for: the MOST_PLACES best entries (rank, less, place, latitude, longitude), in order.

    Each name keeps its own MOST_PLACES first, as a name's places have one rank; what is compared are distinct names. Both cuts are
    of ordered rows, so that no group is held whole.
    """
    asked = addresses.select("country", "locality").distinct().withColumn("_asked", folded("locality")).where(F.length("_asked") >= 2)
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.length("_name") - n + 1), lambda k: F.substr("_name", k, F.lit(n)))
    entry = ["less", "place", "latitude", "longitude"]
    first = lambda d, group, order: d.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= MOST_PLACES)
    named = localities.withColumn("_name", folded("place")).where(F.length("_name") >= 2).withColumn("less", -F.coalesce("population", F.lit(0)))
    names = first(named, ["country", "_name"], entry).groupBy("country", "_name").agg(F.collect_list(F.struct(*entry)).alias("_places"))
    grams = F.array_distinct(F.concat(gram(2), F.when(F.length("_name") >= 3, gram(3)).otherwise(F.array().cast("array<string>"))))
    # merged: a name's grams are many times what its file's size lets Spark expect, too much to send to every task
    met = asked.withColumn("_gram", F.substring("_asked", 1, 3)).join(names.withColumn("_gram", F.explode(grams)).hint("merge"), ["country", "_gram"])
    rank = F.when(F.col("_name") == F.col("_asked"), 0).when(F.startswith("_name", "_asked"), 1).when(F.contains("_name", "_asked"), 2)
    each = met.withColumn("rank", rank).where("rank IS NOT NULL").select("country", "locality", "rank", F.explode("_places").alias("e")).select("country", "locality", "rank", "e.*")
    return first(each, ["country", "locality"], ["rank", *entry]).groupBy("country", "locality").agg(F.array_sort(F.collect_list(F.struct("rank", *entry))).alias("_best"))


def by_name(addresses: DataFrame, localities: DataFrame) -> DataFrame:
    """(address_id, place, latitude, longitude, rank, population): the MOST_PLACES localities (country, place, latitude, longitude, population) that are, begin with or hold an address's locality, in that order, then by population.

    What a name holds shares each of its three letters in a row with it, so both sides meet by country and the asked name's first three (two of a
    name of two); only distinct names are asked for.
    """
    best = _best_named(addresses, localities)
    return addresses.join(best, ["country", "locality"]).select("address_id", F.explode("_best").alias("b")).select("address_id", "b.place", "b.latitude", "b.longitude", "b.rank", (-F.col("b.less")).alias("population"))


def resolved(addresses: DataFrame, postal: DataFrame, localities: DataFrame, subdivisions: DataFrame, countries: DataFrame) -> DataFrame:
    """address_id, latitude, longitude, precision, n_candidates, postal_code_unknown and available of addresses (address_id, country, postal_code, locality, subdivision).

    The point is that of the first place of its postal code, else of the first place of its name, else of its subdivision (country, code,
    latitude, longitude), else of its country (country, latitude, longitude). Places that share a code are counted, not chosen from
    by guess. A country without any entry is not available, and its addresses have no point.
    """
    # places are brought down to the first and their number before addresses come, as each may have as many as postal holds
    longest, keys = _longest_begins(addresses, postal)
    firsts = keys.groupBy("country", "_key").agg(F.min(F.struct("position", "latitude", "longitude")).alias("p"), F.count("*").alias("_n_code"))
    code = longest.join(firsts, ["country", "_key"]).select("country", F.col("_code").alias("_typed"), F.struct("p.latitude", "p.longitude").alias("_code"), "_n_code")
    best = F.col("_best")[0]
    name = _best_named(addresses, localities).select("country", "locality", F.struct(best["latitude"].alias("latitude"), best["longitude"].alias("longitude")).alias("_name"), F.size("_best").cast("long").alias("_n_name"))
    unit = subdivisions.select("country", F.upper(F.trim("code")).alias("_unit"), F.struct("latitude", "longitude").alias("_sub"))
    whole = countries.select("country", F.struct("latitude", "longitude").alias("_whole"))
    has = postal.select("country").distinct().withColumn("_postal", F.lit(True))
    every = reduce(DataFrame.union, [d.select("country") for d in (postal, localities, subdivisions, countries)]).distinct().withColumn("_any", F.lit(True))
    d = addresses.withColumn("_typed", normal_postal_code(F.col("postal_code"))).join(code, ["country", "_typed"], "left").join(name, ["country", "locality"], "left").withColumn("_unit", F.upper(F.trim("subdivision")))
    # as many rows as countries
    d = d.join(unit, ["country", "_unit"], "left").join(whole, "country", "left").join(F.broadcast(has), "country", "left").join(F.broadcast(every), "country", "left")
    point = F.coalesce("_code", "_name", "_sub", "_whole")
    precision = F.when(F.col("_code").isNotNull(), "postal_area").when(F.col("_name").isNotNull(), "locality").when(F.col("_sub").isNotNull(), "subdivision").when(F.col("_whole").isNotNull(), "country")
    typed = F.trim(F.coalesce("postal_code", F.lit(""))) != ""
    return d.select(
        "address_id", point["latitude"].alias("latitude"), point["longitude"].alias("longitude"), precision.alias("precision"), F.coalesce("_n_code", "_n_name", F.lit(0)).alias("n_candidates"),
        (typed & F.coalesce("_postal", F.lit(False)) & F.col("_code").isNull()).alias("postal_code_unknown"), F.coalesce("_any", F.lit(False)).alias("available"),
    )
