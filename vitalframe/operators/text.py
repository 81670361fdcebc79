"""Rows from free text: lab lines, quick logs, stated times; and a check that a text's numbers come from its data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Biomarkers in the order they are tried, with aliases, units and plausible range.
BIOMARKERS = [
    ("HbA1c", ["hba1c", "hemoglobin a1c", "glycated hemoglobin", "a1c"], ["%", "mmol/mol"], 3.0, 20.0),
    ("Fasting Glucose", ["fasting glucose", "fasting blood glucose", "fasting plasma glucose", "glucose fasting", "glucose"], ["mg/dl", "mmol/l"], 40.0, 500.0),
    ("Total Cholesterol", ["total cholesterol", "cholesterol total", "cholesterol, total"], ["mg/dl", "mmol/l"], 50.0, 500.0),
    ("LDL Cholesterol", ["ldl cholesterol", "ldl-c", "ldl"], ["mg/dl", "mmol/l"], 20.0, 400.0),
    ("HDL Cholesterol", ["hdl cholesterol", "hdl-c", "hdl"], ["mg/dl", "mmol/l"], 10.0, 150.0),
    ("Triglycerides", ["triglycerides", "trigs", "tg"], ["mg/dl", "mmol/l"], 20.0, 2000.0),
    ("Hemoglobin", ["hemoglobin", "haemoglobin", "hgb", "hb"], ["g/dl", "g/l"], 5.0, 25.0),
    ("Hematocrit", ["hematocrit", "haematocrit", "hct"], ["%"], 15.0, 65.0),
    ("WBC", ["white blood cell", "wbc", "leukocytes"], ["10^3/ul", "x10^9/l", "/ul"], 1.0, 50.0),
    ("RBC", ["red blood cell", "rbc", "erythrocytes"], ["10^6/ul", "x10^12/l"], 2.0, 8.0),
    ("Platelets", ["platelet count", "platelets", "plt"], ["10^3/ul", "x10^9/l"], 50.0, 800.0),
    ("Vitamin D", ["vitamin d", "25-hydroxyvitamin d", "25-oh vitamin d", "25 oh vitamin d", "vit d"], ["ng/ml", "nmol/l"], 5.0, 150.0),
    ("Vitamin B12", ["vitamin b12", "b12", "cobalamin"], ["pg/ml", "pmol/l"], 100.0, 2000.0),
    ("Ferritin", ["ferritin"], ["ng/ml", "ug/l"], 5.0, 1000.0),
    ("TSH", ["tsh", "thyroid stimulating hormone", "thyrotropin"], ["miu/l", "uiu/ml", "µiu/ml"], 0.05, 20.0),
    ("Free T3", ["free t3", "ft3", "triiodothyronine free"], ["pg/ml", "pmol/l"], 1.0, 12.0),
    ("Free T4", ["free t4", "ft4", "thyroxine free"], ["ng/dl", "pmol/l"], 0.4, 4.0),
    ("Total Testosterone", ["total testosterone", "testosterone total", "testosterone"], ["ng/dl", "nmol/l"], 50.0, 1500.0),
    ("Cortisol", ["cortisol"], ["ug/dl", "nmol/l"], 1.0, 60.0),
    ("CRP", ["c-reactive protein", "hs-crp", "crp"], ["mg/l", "mg/dl"], 0.0, 100.0),
]
#: Words of each kind of log line, in the order the kinds are tried.
LOG_WORDS = [
    ("caffeine", "coffee|espresso|latte|caffeine|chai|tea|red ?bull"),
    ("alcohol", "beer|wine|whisk|vodka|drink|alcohol"),
    ("med", "magnesium|omega|vitamin|tablet|capsule|med|pill"),
    ("symptom", "sore|pain|headache|fatigue|dizzy|nausea|cramp"),
    ("water", "water|hydrat"),
    ("food", "ate|meal|lunch|dinner|breakfast|snack"),
]
#: The forms of numbers, reference ranges and bounds.
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
_PLAIN = r"[0-9]+(?:\.[0-9]+)?"
RANGE, BELOW, ABOVE = rf"({_PLAIN})\s*(?:-|–|to)\s*({_PLAIN})", rf"[<≤]\s*({_PLAIN})", rf"[>≥]\s*({_PLAIN})"
#: A stated time, 4pm, at 4:30 PM, 7 a.m.; or at 16:00 with the word before it.
STATED = r"\b(?:at\s+)?([0-9]{1,2})(?::([0-5][0-9]))?\s*([apAP])\.?[mM]\.?\b|\b[aA][tT]\s+([0-9]{1,2}):([0-5][0-9])\b"


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of the non-blank lines, trimmed."""
    return texts.select(key, F.posexplode(F.split(text, "\r\n|[\n\r]")).alias("line_no", "line")).withColumn("line", F.trim("line")).filter("line <> ''")


def lab_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, biomarker, value, unit, ref_low, ref_high, confidence) from lines such as `LDL 110 mg/dL 0 - 100`.

    A line gives one row at most: of the first biomarker in table order one of whose aliases (the longest first) occurs in it
    with a number behind. The range is read behind the value, as a - b (or a to b), < x or > x; the unit anywhere behind the
    alias. A (biomarker, value) counts once per key. Null and empty texts give nothing.
    """
    specs = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.array(*[F.lit(a) for a in sorted(al, key=len, reverse=True)]).alias("aliases"), F.array(*[F.lit(u) for u in un]).alias("units"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            for n, al, un, lo, hi in BIOMARKERS
        ]
    )
    low = F.lower("line")
    found = F.transform(specs, lambda s: F.struct(s.alias("s"), F.get(F.filter(s["aliases"], lambda a: F.instr(low, a) > 0), F.lit(0)).alias("alias")))
    tails = F.transform(F.filter(found, lambda x: x["alias"].isNotNull()), lambda x: F.struct(x["s"].alias("s"), F.expr("line").substr(F.instr(low, x["alias"]) + F.length(x["alias"]), F.length("line")).alias("tail")))
    any_alias = "|".join(re.escape(a) for _, al, _, _, _ in BIOMARKERS for a in al)
    lines = lines_of(texts, key, text).filter(F.col("line").rlike("[0-9]") & low.rlike(any_alias))  # most lines go before the lists are tried
    df = lines.withColumn("hit", F.get(F.filter(tails, lambda x: F.regexp_extract(x["tail"], _NUMBER, 0) != ""), F.lit(0))).filter("hit is not null")
    df = df.select(key, "line_no", F.col("hit.s").alias("s"), F.col("hit.tail").alias("tail"), F.regexp_extract("hit.tail", _NUMBER, 0).alias("raw"))
    df = df.withColumn("after", F.expr("substring(tail, instr(tail, raw) + length(raw))"))
    grab = lambda pattern, k: F.nullif(F.regexp_extract("after", pattern, k), F.lit("")).try_cast("double")
    a, b, lt, gt = grab(RANGE, 1), grab(RANGE, 2), grab(BELOW, 1), grab(ABOVE, 1)
    df = df.withColumns(
        {
            "value": F.col("raw").cast("double"),
            "ref_low": F.when(a.isNotNull(), a).when(lt.isNull(), gt),
            "ref_high": F.when(a.isNotNull(), b).otherwise(lt),
            "unit": F.get(F.filter("s.units", lambda u: F.instr(F.lower("tail"), u) > 0), F.lit(0)),
        }
    )
    plausible = (F.col("value") >= F.col("s.lo")) & (F.col("value") <= F.col("s.hi"))
    tenths = 5 + F.when(F.col("unit").isNotNull(), 2).otherwise(0) + F.when(F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull(), 2).otherwise(0) + F.when(plausible, 1).otherwise(-2)
    df = df.withColumn("confidence", F.greatest(F.lit(0.05), F.least(F.lit(0.95), tenths / 10.0)))
    entry = F.struct("unit", "ref_low", "ref_high", "confidence")
    return df.groupBy(key, F.col("s.name").alias("biomarker"), "value").agg(F.min_by(entry, "line_no").alias("e")).select(key, "biomarker", "value", "e.*")


def lab_id(date: Column, name: Column, value: Column) -> Column:
    """The first 16 digits of the SHA-256 of date, name and value."""
    return F.substring(F.sha2(F.concat_ws("|", date.cast("string"), name, value.cast("string")), 256), 1, 16)


def store_labs(stored: DataFrame | None, confirmed: DataFrame, version: str) -> DataFrame:
    """`stored` (None for an empty store) with the confirmed rows (date, name, value, ..., version) upserted by lab_id.

    Rows lacking a date, name or value are skipped. Of rows with one id that of the greatest `version` holds.
    """
    rows = confirmed.filter(F.col("date").isNotNull() & (F.trim("name") != "") & F.col("value").isNotNull())
    rows = rows.withColumn("lab_id", lab_id(F.col("date"), F.col("name"), F.col("value")))
    both = rows if stored is None else stored.unionByName(rows, allowMissingColumns=True)
    names = [c for c in both.columns if c not in ("lab_id", version)]
    kept = both.groupBy("lab_id").agg(F.max_by(F.struct(*names), version).alias("r"), F.max(version).alias(version))
    return kept.select("lab_id", "r.*", version)


def lab_flag(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "Low").when(value > high, "High").otherwise("")


def reference_text(low: Column, high: Column) -> Column:
    n = lambda x: x.cast("string")
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(n(low), F.lit(" to "), n(high))).when(high.isNotNull(), F.concat(F.lit("< "), n(high))).when(low.isNotNull(), F.concat(F.lit("> "), n(low))).otherwise("")


def panel_date(text: Column) -> Column:
    """The first date of the forms yyyy-MM-dd, dd/MM/yyyy, dd-MM-yyyy, in that order of forms; impossible dates are skipped."""
    # fixed values
    forms = [("[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd"), ("[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy"), ("[0-9]{2}-[0-9]{2}-[0-9]{4}", "dd-MM-yyyy")]
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(text, p, 0), F.lit("")), F.lit(f))) for p, f in forms])


def log_kind(text: Column) -> Column:
    """The kind of a log line by its words, whole words in any case; note where none fits."""
    out = None
    for kind, words in LOG_WORDS:
        hit = text.rlike(f"(?i)(^|[^a-z0-9_])({words})([^a-z0-9_]|$)")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("note")


def guarded_kind(proposed: Column, text: Column) -> Column:
    """A proposed kind, overruled by the words of the text where those say caffeine or alcohol; without a proposal the words decide."""
    said = log_kind(text)
    return F.when(said.isin("caffeine", "alcohol"), said).otherwise(F.coalesce(proposed, said))


def guarded_amount(amount: Column) -> Column:
    """An amount of at most 40 letters, digits and `.,/x%-` or spaces; anything else gives an empty text."""
    return F.when(amount.rlike(r"^[A-Za-z0-9_ .,/×%-]{0,40}$"), amount).otherwise("")


def stated_minutes_ago(text: Column, now: Column) -> Column:
    """Minutes from the time stated in the text to `now`, null without one.

    The most recent past occurrence counts: a bare hour up to 12 may be either half of the day, a time still ahead was
    yesterday. Hours over 12 with am or pm and over 23 are no times.
    """
    g = lambda k: F.nullif(F.regexp_extract(text, STATED, k), F.lit("")).cast("int")
    half, minute = F.lower(F.regexp_extract(text, STATED, 3)), F.coalesce(g(2), g(5), F.lit(0))
    named = F.when(g(1) <= 12, g(1) % 12 + F.when(half == "p", 12).otherwise(0))
    bare = g(4)
    at = F.hour(now) * 60 + F.minute(now)
    ago = lambda hour: F.pmod(at - (hour * 60 + minute), F.lit(1440))
    return F.when(half != "", ago(named)).when(bare > 23, None).when(bare > 12, ago(bare)).otherwise(F.least(ago(bare), ago(F.pmod(bare + 12, F.lit(24)))))


#: Words that a text for the wearer must not have.
BLOCKLIST = r"(?i)\b(diagnos\w*|prescri\w*|dosage|dose of|mg of|take \d+ ?mg|disease|disorder|syndrome|you (have|suffer)|medical emergency)\b"


def blocked_word(text: Column) -> Column:
    """The first blocked word of a text as it stands there; null without one."""
    return F.nullif(F.regexp_extract(text, BLOCKLIST, 0), F.lit(""))


def _six_digits(number: Column) -> Column:
    """A key that is equal for numbers with the same six significant digits."""
    power = F.floor(F.log10(F.when(number > 0, number)))
    return F.coalesce(F.concat(F.round(number / F.pow(F.lit(10.0), power - 5)).cast("long").cast("string"), F.lit("e"), power.cast("string")), F.lit("0e0"))


def _forms(number: Column) -> Column:
    return F.array(F.format_string("%.0f", number), F.format_string("%.1f", number), F.format_string("%.2f", number), _six_digits(number))


def ungrounded_numbers(text: Column, payload: Column) -> Column:
    """Numbers of `text` none of whose renderings (0, 1 or 2 decimals, six significant digits) equals one of a number in `payload`;
    thousands separators don't count.

    Numbers up to 3 and parts of clock times pass. Null text gives an empty array.
    """
    token = r"[0-9]+(?:[.,][0-9]+)?"
    numbers = lambda c: F.transform(F.coalesce(F.regexp_extract_all(c, F.lit(token), F.lit(0)), F.array().cast("array<string>")), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    clockless = F.regexp_replace(text, rf"{token}(?=:)|(?<=:){token}", " ")
    allowed = F.array_distinct(F.flatten(F.transform(numbers(payload), _forms)))
    return F.array_distinct(F.filter(numbers(clockless), lambda x: (x > 3) & ~F.arrays_overlap(_forms(x), allowed)))
