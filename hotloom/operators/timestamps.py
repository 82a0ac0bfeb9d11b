"""Mixed time notations to one UTC instant, by a dictionary of distinct values.

Raw strings are reduced to distinct (text, source, zone) values, each is parsed once with built-in expressions, the
result is kept as a table that later loads only add to, and rows get their instants by a join on the text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotloom.operators.skew import HOT_SHARE, same, split_join
from hotloom.session import named_stage, stage_path

LOCAL_ZONE = "Asia/Kolkata"
#: Minutes east of UTC of the abbreviations that have one meaning here.
ABBREVIATIONS = {"Z": 0, "GMT": 0, "UTC": 0, "IST": 330, "EST": -300, "EDT": -240}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

DAY_US = 86_400_000_000
_ZONE = r"((?:[Zz]|[+-]\d{2}(?::?\d{2})?)?)\s*\[?((?:[A-Za-z][A-Za-z0-9_+/-]*)?)\]?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_MONTH = rf"({'|'.join(MONTHS)})[a-z]*\.?"
#: Notation, pattern and the groups that hold year, month, day, hour, minute, second, fraction, half of day, offset, zone, week day.
NOTATIONS = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK}\s*{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9, 0)),
    ("month_first", rf"^(\d{{1,2}})([-/])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:[T ]+{_CLOCK}\s*((?:[AaPp][Mm])?)\s*{_ZONE})?$", (4, 1, 3, 5, 6, 7, 8, 9, 10, 11, 0)),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?\s*{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9, 0)),
    ("named_month", rf"(?i)^(?:({'|'.join(DAYS)})[a-z]*,?\s+)?(\d{{1,2}})[ -]{_MONTH}[ -,]+(\d{{4}})(?:\s+{_CLOCK}\s*((?:[ap]m)?)\s*{_ZONE})?$", (4, 3, 2, 5, 6, 7, 8, 9, 10, 11, 1)),
]
FIELDS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "offset", "zone", "week_day")


def _parts(text: Column) -> Column:
    """The fields of the notation that matches, each as text; null if none does.

    Each pattern covers the whole text and rewrites it to fields between bars, which no later pattern matches.
    """
    fields = text
    for _, pattern, groups in NOTATIONS:
        fields = F.regexp_replace(fields, pattern, "|".join(f"${g}" if g else "" for g in groups))
    return F.when(~text.contains("|") & ~text.rlike(r"^(\d{10}|\d{13})?$"), F.split(fields, r"\|", -1))


def _shown(us: Column, zone: Column) -> Column:
    """What the zone's clocks show at an instant, both in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _clock_in_zone(df: DataFrame, clock: str, zone: str, into: str, fixed: str) -> DataFrame:
    """Add the one instant (microseconds) at which the zone's clocks showed ``clock``; null for none or two.

    The offsets a day before and after give the two candidates; each counts if the zone shows the clock time then. Rows
    of the zone ``fixed`` take a path on which that zone is looked up once.
    """
    def at(us: Column) -> Column:
        return F.when(F.col(zone) == fixed, _shown(us, F.lit(fixed))).when(F.col(zone).isNotNull(), _shown(us, F.col(zone)))

    c = F.col(clock)
    df = df.withColumns({"__early": at(c - F.lit(DAY_US)), "__late": at(c + F.lit(DAY_US))})
    candidates = F.array_distinct(F.array(c - (F.col("__early") - c + F.lit(DAY_US)), c - (F.col("__late") - c - F.lit(DAY_US))))
    df = df.withColumn("__fit", F.filter(candidates, lambda us: at(us) == c))
    return df.withColumn(into, F.when(F.size("__fit") == 1, F.col("__fit")[0])).drop("__early", "__late", "__fit")


def parse_stamps(df: DataFrame, text: str, zone: str, zones: list[str]) -> DataFrame:
    """Add utc_micros (long) and local_month, local_day of ``LOCAL_ZONE`` (YYYY-MM, date) for a text column.

    ``zone`` is a column with the zone that holds where a text names none; ``zones`` are the known zone names. Null
    results: null, empty and blank text, text that is no stamp, impossible dates and times (a week day that isn't the
    date's counts as one), unknown zones, and clock times that a named zone skipped or showed twice. Fractions beyond
    microseconds are cut. All other columns stay.
    """
    blank = r"(?U)^\s+|\s+$"
    own = list(df.columns)
    df = df.withColumn("__t", F.regexp_replace(F.col(text), blank, ""))
    df = df.withColumn("__a", _parts(F.col("__t")))
    df = df.withColumn("__a", F.when(F.size("__a") == len(FIELDS), F.col("__a")))
    field = {name: F.col("__a")[k] for k, name in enumerate(FIELDS)}
    named_month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(field["month"])).cast("int")
    # guarded casts: a cast that fails is far dearer than one that isn't made. As an array function this also ends the
    # generated method, which would otherwise be too large for the JVM to compile.
    df = df.withColumn("__n", F.transform(F.slice("__a", 1, 7), lambda x: F.when((x != "") & (x < ":"), x.cast("int")).otherwise(0)))
    df = df.withColumns({
        **{f"__{n}": F.coalesce(F.col("__n")[FIELDS.index(n)], F.lit(0)) for n in ("year", "day", "hour", "minute", "second")},
        "__month": F.when(F.col("__n")[1] > 0, F.col("__n")[1]).otherwise(named_month), "__short": F.length(field["year"]) == 2,
        "__half": F.lower(field["half"]), "__off": F.translate(field["offset"], ":", ""), "__zone": field["zone"], "__week": F.lower(field["week_day"]),
        "__us": F.when(field["fraction"] != "", F.rpad(F.substring(field["fraction"], 1, 6), 6, "0").cast("long")).otherwise(0),
    })
    c = {n: F.col(f"__{n}") for n in ("year", "month", "day", "hour", "minute", "second", "half", "off", "zone", "week")}
    df = df.withColumns({
        "__year": c["year"] + F.when(F.col("__short"), 2000).otherwise(0),
        "__h": F.when(c["half"] == "", c["hour"]).when(c["hour"].between(1, 12), c["hour"] % 12 + F.when(c["half"] == "pm", 12).otherwise(0)).otherwise(99),
        "__hours": F.when(F.length("__off") > 1, F.substring("__off", 2, 2).cast("int")), "__minutes": F.when(F.length("__off") > 3, F.substring("__off", 4, 2).cast("int")).otherwise(0),
    })
    df = df.withColumn("__first", F.make_date(F.greatest(c["year"], F.lit(1)), F.least(F.greatest(c["month"], F.lit(1)), F.lit(12)), F.lit(1)))
    df = df.withColumn("__date", F.date_add("__first", c["day"] - 1))
    fits = (
        (c["year"] >= 1) & c["month"].between(1, 12) & (c["day"] >= 1) & (c["day"] <= F.dayofmonth(F.last_day("__first")))
        & (F.col("__h") <= 23) & (c["minute"] <= 59) & (c["second"] <= 59)
        & ((c["week"] == "") | (F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.weekday("__date") + 1) == c["week"]))
    )
    clock = F.unix_date("__date").cast("long") * F.lit(DAY_US) + (F.col("__h") * 3600 + c["minute"] * 60 + c["second"]).cast("long") * 1_000_000 + F.col("__us")
    df = df.withColumn("__clock", F.when(fits, clock))
    signed = F.when(F.upper("__off") == "Z", 0).when((F.col("__hours") <= 18) & (F.col("__minutes") <= 59), F.when(c["off"].startswith("-"), -1).otherwise(1) * (F.col("__hours") * 60 + F.col("__minutes")))
    fixed = F.when(c["off"] != "", signed)
    for name, east in ABBREVIATIONS.items():
        fixed = fixed.when(c["zone"] == name, east)
    where = F.when(c["off"] == "", F.when(c["zone"] == "", F.col(zone)).when(~c["zone"].isin(*ABBREVIATIONS), c["zone"]))
    df = df.withColumns({"__east": fixed, "__where": where})
    df = df.withColumn("__where", F.when(F.col("__clock").isNotNull() & ((F.col("__where") == LOCAL_ZONE) | F.col("__where").isin(zones)), F.col("__where")))
    df = _clock_in_zone(df, "__clock", "__where", "__in_zone", LOCAL_ZONE)
    seconds = F.when(F.col("__a").isNull() & F.col("__t").rlike(r"^(\d{10}|\d{13})$"), F.col("__t").cast("long") * F.when(F.length("__t") == 10, 1_000_000).otherwise(1000))
    utc = F.coalesce(seconds, F.col("__clock") - F.col("__east").cast("long") * 60_000_000, F.col("__in_zone"))
    df = df.select(*[x for x in own if x not in ("utc_micros", "local_day", "local_month")], utc.alias("utc_micros"))
    df = df.withColumn("local_day", F.date_from_unix_date(F.floor(_shown(F.col("utc_micros"), F.lit(LOCAL_ZONE)) / F.lit(DAY_US)).cast("int")))
    return df.withColumn("local_month", F.substring(F.col("local_day").cast("string"), 1, 7))


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names of the session's tz database (about 600, whatever the data)."""
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


#: Columns of the dictionary's key: the text as received, where it came from, and the zone that holds where it names none.
KEY = ["raw", "source", "zone"]
DICTIONARY = "raw string, source string, zone string, n long, utc_micros long, local_day date, local_month string"


def _named(source: str | None, zone: str | None) -> dict[str, Column]:
    return {"source": F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit(""), "zone": F.coalesce(F.col(zone), F.lit(LOCAL_ZONE)) if zone else F.lit(LOCAL_ZONE)}


def distinct_stamps(df: DataFrame, text: str, zone: str | None = None, source: str | None = None) -> DataFrame:
    """(raw, source, zone, n): each distinct text with its source (empty for none) and the zone that holds for it, and
    its rows; null texts are left out."""
    named = _named(source, zone)
    return df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("raw"), named["source"].alias("source"), named["zone"].alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def dictionary_there(spark: SparkSession, path: str) -> bool:
    """Whether a load has written to the dictionary."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def grow_dictionary(df: DataFrame, path: str, text: str, zone: str | None = None, source: str | None = None) -> DataFrame:
    """Parse those texts of ``df`` that the dictionary at ``path`` lacks, add them as a new batch, return the whole.

    The dictionary is a Parquet folder (raw, source, zone, n, utc_micros, local_day, local_month), n from the load that
    brought the text; a missing folder counts as empty. A batch is complete once written; running a load again adds
    nothing. One load at a time may write to a folder.
    """
    spark = df.sparkSession
    new = distinct_stamps(df, text, zone, source)
    if dictionary_there(spark, path):
        new = new.join(spark.read.schema(DICTIONARY).parquet(path).select(*KEY), KEY, "left_anti")
    parse_stamps(new, "raw", "zone", known_zones(spark)).write.mode("append").parquet(path)
    return spark.read.schema(DICTIONARY).parquet(path)


def stamp_entries(df: DataFrame, path: str, text: str, zone: str | None = None, source: str | None = None) -> DataFrame:
    """The dictionary, grown by ``df``, with n as the number of rows in ``df``, not in the load that brought the text: so
    a text that turns frequent later is joined as a frequent one. Exact for frequent texts; 0 stands for any others of an
    older load."""
    known = dictionary_there(df.sparkSession, path)
    entries = grow_dictionary(df, path, text, zone, source)
    if not known:
        return entries
    # frequent in this load: at most 1 / HOT_SHARE texts
    counts = distinct_stamps(df, text, zone, source)
    rows = df.where(F.col(text).isNotNull()).count()
    often = counts.where(F.col("n") > F.lit(rows * HOT_SHARE)).select(*[F.col(k).alias(f"__f_{k}") for k in KEY], F.col("n").alias("__often"))
    found = entries.drop("n").join(F.broadcast(often), same(entries, often, {k: f"__f_{k}" for k in KEY}), "left")
    return found.withColumn("n", F.coalesce("__often", F.lit(0))).drop("__often", *[f"__f_{k}" for k in KEY])


def normalise_stamps(df: DataFrame, text: str, zone: str | None = None, path: str | None = None, source: str | None = None) -> DataFrame:
    """Rows whose text denotes one instant, with utc_micros, local_day and local_month added.

    Rows with null, empty or unreadable text don't come out. The dictionary of texts, sources and zones at ``path`` is
    grown first and kept; without a path it lasts as long as the driver. A frequent text is joined by broadcast, so it
    makes no large task, also if an earlier load brought it. Columns of ``df`` named like the results are replaced.
    """
    added = ["utc_micros", "local_day", "local_month"]
    df = df.drop(*added)
    entries = stamp_entries(df, path or stage_path(df.sparkSession, "stamps"), text, zone, source).where(F.col("utc_micros").isNotNull())
    used = ["raw", *["source"] * bool(source), *["zone"] * bool(zone)]
    entries = entries.select(*[F.col(k).alias(f"__{k}") for k in used], F.col("n").alias("__n"), *added)
    named = _named(source, zone)
    df = df.withColumns({f"__in_{k}": named[k] for k in used[1:]}) if used[1:] else df
    keys = {text: "__raw", **{f"__in_{k}": f"__{k}" for k in used[1:]}}
    return split_join(df, entries, keys, "__n").drop(*keys.values(), *[f"__in_{k}" for k in used[1:]], "__n")


def kept_dictionary(spark: SparkSession, name: str) -> str:
    """Where the dictionary of a named input is kept: in the folder that the setting hotloom.stamps.path names, for all
    later loads; else in the shared folder, for all queries of this application, until it ends."""
    kept = spark.conf.get("hotloom.stamps.path", None)
    key = hashlib.sha1(name.encode()).hexdigest()[:16]
    if kept:
        return f"{kept.rstrip('/')}/stamps-{key}"
    return named_stage(spark, f"stamps-{spark.sparkContext.applicationId}-{key}")
