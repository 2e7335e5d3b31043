"""Column codecs that write a cell as its difference from the one above, by windows within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

REPEAT = "~"
#: Rows that a group needs, shares that coding has to save by codec.
LEAST_ROWS, LEAST_EXACT, LEAST_SAVED = 3, 0.30, 0.20


def _quoted(text: Column, like: str) -> Column:
    """A cell that reads as a mark, quoted any number of times, gets one more quotation mark in front."""
    return F.when(text.rlike(f'^"*(?:{like})$'), F.concat(F.lit('"'), text)).otherwise(text)


def _unquoted(text: Column, like: str) -> Column:
    return F.when(text.rlike(f'^"+(?:{like})$'), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def exact(c: Column, w: WindowSpec) -> Column:
    """``~`` for a cell that equals the one above; a literal ``~`` is quoted."""
    text = c.cast("string")
    first = F.row_number().over(w) == 1
    return F.when(~first & text.eqNullSafe(F.lag(text).over(w)), REPEAT).otherwise(_quoted(text, REPEAT))


def exact_back(c: Column, w: WindowSpec) -> Column:
    """The last cell that isn't ``~``; null cells stay apart from skipped ones in a struct."""
    cell = F.when(~c.eqNullSafe(F.lit(REPEAT)), F.struct(_unquoted(c, REPEAT).alias("v")))
    return F.last(cell, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["v"]


def numeric(c: Column, w: WindowSpec) -> Column:
    """``+n`` or ``-n`` from the cell above; a first, equal or null-neighboured cell stays whole, a negative one quoted."""
    d = c - F.lag(c).over(w)
    whole = _quoted(c.cast("string"), r"[+-]\d+")
    return F.when(d.isNull() | (d == 0), whole).when(d > 0, F.concat(F.lit("+"), d.cast("string"))).otherwise(F.concat(F.lit("-"), F.abs(d).cast("string")))


def numeric_back(df: DataFrame, cell: str, keys: list[str], order: str, out: str) -> DataFrame:
    """Running sums that begin anew at every whole number."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(cell).rlike(r"^[+-]\d+$")
    df = df.withColumn("__run", F.sum((~F.coalesce(step, F.lit(False))).cast("int")).over(w))
    run = Window.partitionBy(*keys, "__run").orderBy(order)
    return df.withColumn(out, F.sum(_unquoted(F.col(cell), r"[+-]\d+").cast("long")).over(run)).drop("__run")


def encode_columns(df: DataFrame, cols: list[str], keys: list[str], order: str) -> DataFrame:
    """``df`` with the columns as texts, coded by group where that pays, and ``codecs``: by column temporal, numeric, exact or plain.

    Tried in this order: ISO times of one zone, whole numbers without nulls,
    then repeats of 30% of the cells below the first row. The first two need a
    fifth of the characters saved and some cell that moves, all of them three
    rows. One shuffle by ``keys``, with which all windows agree.
    """
    w, all_ = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    names = df.columns
    for c in cols:
        kind = df.schema[c].dataType.typeName()
        df = df.withColumn("__n", F.count(F.lit(1)).over(all_))
        times = F.lit(False)
        if kind == "string":
            df = temporal(df, c, keys, order, "__t")
            times = F.max((F.col("__t").rlike(_STEP)).cast("int")).over(all_) == 1
        df = df.withColumn("__text", F.col(c).cast("string")).withColumn("__times", F.coalesce(times, F.lit(False)))
        whole = kind in ("byte", "short", "integer", "long")
        df = df.withColumn("__c", numeric(F.col(c), w) if whole else F.lit(None).cast("string")).withColumn("__e", exact(F.col(c), w))
        plain, coded = F.sum(F.length("__text")).over(all_), F.sum(F.length("__c")).over(all_)
        moves = F.max(F.col("__c").rlike(r"^[+-]").cast("int")).over(all_) == 1
        full = F.count("__text").over(all_) == F.col("__n")
        numbers = (F.lit(whole) & full & moves & (coded <= plain * (1 - LEAST_SAVED))) if whole else F.lit(False)
        same = F.sum((F.col("__e") == REPEAT).cast("int")).over(all_) >= LEAST_EXACT * (F.col("__n") - 1)
        which = F.when(F.col("__n") < LEAST_ROWS, "plain").when(F.col("__times"), "temporal").when(F.coalesce(numbers, F.lit(False)), "numeric").when(F.coalesce(same, F.lit(False)), "exact").otherwise("plain")
        df = df.withColumn(f"__k_{c}", which)
        time = F.col("__t") if kind == "string" else F.col("__text")
        k = F.col(f"__k_{c}")
        df = df.withColumn(f"__o_{c}", F.when(k == "temporal", time).when(k == "numeric", F.col("__c")).when(k == "exact", F.col("__e")).otherwise(F.col("__text")))
        df = df.drop("__n", "__t", "__text", "__times", "__c", "__e")
    codecs = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(f"__k_{c}"))])
    return df.select(*[F.col(f"__o_{c}").alias(c) if c in cols else F.col(c) for c in names], codecs.alias("codecs"))


def decode_columns(df: DataFrame, cols: list[str], keys: list[str], order: str) -> DataFrame:
    """The texts that ``encode_columns`` was given, without ``codecs``."""
    w = Window.partitionBy(*keys).orderBy(order)
    names = [c for c in df.columns if c != "codecs"]
    for c in cols:
        k = F.col("codecs")[c]
        df = temporal_back(df, c, keys, order, "__t")
        df = numeric_back(df.withColumn("__i", F.when(k == "numeric", F.col(c))), "__i", keys, order, "__c")
        df = df.withColumn("__e", exact_back(F.col(c), w))
        df = df.withColumn(c, F.when(k == "temporal", F.col("__t")).when(k == "numeric", F.col("__c").cast("string")).when(k == "exact", F.col("__e")).otherwise(F.col(c))).drop("__t", "__c", "__i", "__e")
    return df.select(*names)


def repeat_ratio(df: DataFrame, cols: list[str], keys: list[str], order: str) -> DataFrame:
    """By group: rows and cells that equal the one above; the exact codec pays from 30% of the cells below the first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    hits = sum((((n > 1) & F.col(c).eqNullSafe(F.lag(c).over(w))).cast("long") for c in cols), F.lit(0).cast("long"))
    return df.select(*keys, hits.alias("hits")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("hits").alias("repeats"))


def savings(df: DataFrame, c: str, keys: list[str], order: str) -> DataFrame:
    """By group: characters of the plain and of the numeric codec's cells; it pays from a fifth saved and three rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.select(*keys, F.length(F.col(c).cast("string")).alias("plain"), F.length(numeric(F.col(c), w)).alias("coded"))
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("plain").cast("long").alias("plain"), F.sum("coded").cast("long").alias("coded"))


#: ISO times in whole seconds: without a zone, in UTC or at a fixed offset.
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})?$"
_STEP = r"^T[+-](0|[1-9]\d*)$"


def _zone(c: Column) -> Column:
    return F.regexp_extract(c, _ISO, 1)


def _epoch(c: Column) -> Column:
    """Seconds of an ISO time, a missing zone being UTC; null for any other text."""
    zone = F.when(_zone(c) == "", "Z").otherwise(_zone(c))
    return F.when(c.rlike(_ISO), F.unix_seconds(F.concat(F.substring(c, 1, 19), zone).try_cast("timestamp")))


def _temporal(df: DataFrame, c: str, keys: list[str], order: str) -> DataFrame:
    """``df`` with ``__step`` from the cell above, the group's ``__n``, ``__plain`` and ``__coded`` characters, and whether coding it ``__pays``: three rows, all ISO times of one zone, not all equal, and a fifth saved."""
    w, all_ = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    df = df.withColumn("__at", _epoch(F.col(c))).withColumn("__step", F.col("__at") - F.lag("__at").over(w))
    size = F.when(F.row_number().over(w) == 1, F.length(c)).when(F.col("__step") == 0, 1).otherwise(2 + F.length(F.abs("__step").cast("string")))
    df = df.withColumn("__size", size)
    same = (F.count("__at").over(all_) == F.count(F.lit(1)).over(all_)) & (F.min(_zone(F.col(c))).over(all_) == F.max(_zone(F.col(c))).over(all_))
    df = df.withColumn("__n", F.count(F.lit(1)).over(all_)).withColumn("__plain", F.sum(F.length(c)).over(all_)).withColumn("__same", same)
    df = df.withColumn("__coded", F.when(F.col("__same"), F.sum("__size").over(all_)).otherwise(F.col("__plain")))
    moves = F.coalesce(F.max(F.abs("__step")).over(all_) > 0, F.lit(False))
    return df.withColumn("__pays", F.col("__same") & moves & (F.col("__n") >= 3) & (5 * (F.col("__plain") - F.col("__coded")) >= F.col("__plain")))


def temporal(df: DataFrame, c: str, keys: list[str], order: str, out: str) -> DataFrame:
    """``T+n`` or ``T-n``, in seconds, from the ISO time above, in groups where that pays; first and equal cells stay whole.

    A cell that itself reads as a step gets a quotation mark in front, one more if it has any.
    """
    step = F.col("__step")
    coded = F.concat(F.when(step > 0, "T+").otherwise("T-"), F.abs(step).cast("string"))
    plain = F.when(F.col(c).rlike(r'^"*T[+-](0|[1-9]\d*)$'), F.concat(F.lit('"'), c)).otherwise(F.col(c))
    return _temporal(df, c, keys, order).withColumn(out, F.when(F.col("__pays") & (step != 0), coded).otherwise(plain)).select(*df.columns, out)


def temporal_back(df: DataFrame, cell: str, keys: list[str], order: str, out: str) -> DataFrame:
    """Running sums that begin anew at every whole time, written in that time's zone. Steps without a time above stay as they are."""
    w = Window.partitionBy(*keys).orderBy(order)
    at, c = _epoch(F.col(cell)), F.col(cell)
    step = F.when(c.rlike(_STEP), F.substring(c, F.lit(2), F.length(c)).cast("long"))
    coded = df.withColumn("__at", at).withColumn("__step", step).withColumn("__run", F.count("__at").over(w))
    coded = coded.withColumn("__zone", F.last(F.when(F.col("__at").isNotNull(), _zone(c)), ignorenulls=True).over(w))
    run = Window.partitionBy(*keys, "__run").orderBy(order)
    now = F.sum(F.coalesce("__at", "__step")).over(run)
    part = lambda first: F.substring("__zone", first, 2).cast("long")
    offset = F.when(F.length("__zone") == 6, F.when(F.col("__zone").startswith("-"), -1).otherwise(1) * (part(2) * 3600 + part(5) * 60)).otherwise(0)
    local = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(now + offset).cast("decimal(18,6)"))
    text = F.concat(F.replace(local.cast("string"), F.lit(" "), F.lit("T")), "__zone")
    quoted = c.rlike(r'^"+T[+-](0|[1-9]\d*)$')
    again = F.when(F.col("__step").isNotNull() & (F.col("__run") > 0), text).when(quoted, F.substring(c, F.lit(2), F.length(c))).otherwise(c)
    return coded.withColumn(out, again).select(*df.columns, out)


def temporal_savings(df: DataFrame, c: str, keys: list[str], order: str) -> DataFrame:
    """By group: characters of the ISO texts and of the temporal codec's cells, a repeat as one, and whether the codec pays."""
    per = _temporal(df, c, keys, order).groupBy(*keys)
    return per.agg(F.first("__n").alias("n_rows"), F.first("__plain").alias("plain"), F.first("__coded").cast("long").alias("coded"), F.first("__pays").alias("pays"))
