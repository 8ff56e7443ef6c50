"""Column functions: every one is a composition of built-in expressions, none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.limits import ACCEPTED_STATUSES, MAX_NAME, REJECTED_STATUSES, SCOPES, SOURCE_KINDS


def utf16_len(s: Column) -> Column:
    """Length in UTF-16 code units, which the limits count."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def name_ok(name: Column) -> Column:
    """A metric name: segments of a-z, 0-9 and _ joined by dots, 128 characters at most; null is none."""
    return F.coalesce(name.rlike(r"^[a-z0-9_]+([.][a-z0-9_]+)*\z") & (F.length(name) <= MAX_NAME), F.lit(False))


def filled(s: Column, most: int) -> Column:
    """Neither null nor blank (in any script's white space), and not over most code units."""
    return F.coalesce(~s.rlike(r"(?U)^\s*\z") & (utf16_len(s) <= most), F.lit(False))


def escape_label(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def canonical_labels(labels: Column) -> Column:
    """One text for equal label sets: keys in binary order, quoted and escaped; no labels and null give {}."""
    quote = F.lit('"')
    pair = lambda e: F.concat(quote, escape_label(e["key"]), F.lit('":"'), escape_label(e["value"]), quote)
    return F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(labels)), pair), ","), F.lit("}")), F.lit("{}"))


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def to_utc(ts: Column) -> Column:
    """A wire time stamp, with any offset, as an instant; null if it cannot be read."""
    return F.try_to_timestamp(ts)


def week_start(ts: Column) -> Column:
    """Monday, 00:00 UTC (the session's zone is UTC)."""
    return F.date_trunc("week", ts)


def partition_name(table: str, week: Column) -> Column:
    return F.concat(F.lit(f"{table}_"), F.date_format(week, "yyyyMMdd"))


def parse_partition_name(table: str, name: Column) -> Column:
    """The date in a partition's name, or null where the name is not one of the table's."""
    digits = F.regexp_extract(name, rf"^{table}_([0-9]{{8}})\z", 1)
    return F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMdd"))


def week_bounds(week: Column) -> Column:
    form = "yyyy-MM-dd HH:mm:ss'+00:00'"
    return F.struct(F.date_format(week, form).alias("lower"), F.date_format(week + F.expr("INTERVAL 7 DAYS"), form).alias("upper"))


def used_percent(total: Column, remaining: Column) -> Column:
    """Share in use, from 0 to 100; 0 where there is no total."""
    share = F.lit(100.0) * (total - remaining) / F.when(total > 0, total)
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))).otherwise(F.when(total.isNotNull(), 0.0))


def spool_parked_at(file_name: Column) -> Column:
    """The time in a spool file's name, or the epoch where there is none that can be read."""
    stamp = F.substring_index(file_name, "-", 1)
    good = F.when(stamp.rlike(r"^[0-9]{8}T[0-9]{13}\z"), stamp)
    return F.coalesce(F.try_to_timestamp(good, F.lit("yyyyMMdd'T'HHmmssSSSSSSS")), F.timestamp_seconds(F.lit(0)))


def spool_name(ts: Column, sequence: Column, token: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmssSSSSSS"), F.lit("0-"), F.lpad(sequence.cast("string"), 6, "0"), F.lit("-"), token, F.lit(".json"))


def classify_outcome(status: Column) -> Column:
    """What becomes of a batch after an answer: accepted, rejected for good, or to be sent again."""
    return F.when(status.isin(ACCEPTED_STATUSES), "accepted").when(status.isin(REJECTED_STATUSES), "rejected").otherwise("retry")


def scope_name(scope: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in SCOPES.items():
        out = F.when(scope == code, name).otherwise(out)
    return out


def code_of(names: dict[int, str], text: Column) -> Column:
    """The code of a name in any case; null if there is no such name."""
    out = F.lit(None).cast("int")
    for code, name in names.items():
        out = F.when(F.lower(text) == name, code).otherwise(out)
    return out


def parse_scope(text: Column) -> Column:
    return code_of(SCOPES, text)


def parse_kind(text: Column) -> Column:
    return code_of(SOURCE_KINDS, text)


def scope_satisfies(granted: Column, required: Column) -> Column:
    """Whether a granted scope covers the required one; names are compared as they are written."""
    same = (granted == required) & granted.isin(*SCOPES.values())
    return F.coalesce(same | ((granted == "control") & (required == "read")), F.lit(False))
