"""Identities by length-prefixed hashing, and checks of dates and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlex.functions import text as T

#: Domain tags of the identities: this library's own. Who needs identities that another system made gives its tags to the functions.
ENTRY_TAG, GROUP_TAG, CASE_TAG, PROVENANCE_TAG = "textlex-entry", "textlex-group", "textlex-case", "textlex-provenance"
#: The schema version and name segments that people may not have.
DECISION_VERSION = "review-decision-v1"
RESERVED = ["ai", "assistant", "auto", "automatic", "bot", "chatgpt", "system"]


def number(n: Column) -> Column:
    """Eight bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def field(value: Column) -> Column:
    """The bytes of a string after their number."""
    return F.concat(number(F.octet_length(value)), value.cast("binary"))


def _joined(parts: Column) -> Column:
    """All binaries of an array, end to end."""
    return F.aggregate(parts, F.lit(b""), lambda s, p: F.concat(s, p))


def fields(values: Column) -> Column:
    return _joined(F.transform(values, field))


def entry_id(source: Column, revision: Column, display: Column, normalized: Column, flags: Column, morphology: Column, tag: str = ENTRY_TAG) -> Column:
    head = F.concat(*map(field, (F.lit(tag), source, revision, T.nfc(display), T.normalize_text(normalized), flags)))
    return F.sha2(F.concat(head, fields(F.array_sort(morphology))), 256)


def group_id(normalized: Column, members: Column, tag: str = GROUP_TAG) -> Column:
    return F.sha2(F.concat(field(F.lit(tag)), field(T.normalize_text(normalized)), fields(F.array_sort(members))), 256)


def _optional(present: Column, body: Column) -> Column:
    return F.when(present, F.concat(F.lit(b"\1"), body)).otherwise(F.lit(b"\0"))


def _flag(value: Column) -> Column:
    return _optional(value.isNotNull(), F.when(value, F.lit(b"\1")).otherwise(F.lit(b"\0")))


def _list(values: Column) -> Column:
    return F.concat(number(F.size(values)), fields(values))


def expectation(e: Column) -> Column:
    """Canonical bytes of a struct accepted, preserve_exact, expected, forbidden, allow_none, top_k."""
    k = e.getField("top_k")
    return F.concat(
        _flag(e.getField("accepted")), _flag(e.getField("preserve_exact")), _list(F.array_sort(e.getField("expected"))),
        _list(F.array_sort(e.getField("forbidden"))), _flag(e.getField("allow_none")), _optional(k.isNotNull(), number(k)),
    )


def case_id(task: Column, category: Column, given: Column, context: Column, expected: Column, tag: str = CASE_TAG) -> Column:
    """The context keeps its order; none counts as an empty one."""
    empty = F.array().cast("array<string>")
    return F.sha2(F.concat(field(F.lit(tag)), field(task), field(category), field(given), _list(F.coalesce(context, empty)), expectation(expected)), 256)


def provenance_id(kind: Column, source: Column, document: Column, record: Column, tag: str = PROVENANCE_TAG) -> Column:
    optional = lambda c: _optional(c.isNotNull(), field(F.coalesce(c, F.lit(""))))
    return F.sha2(F.concat(field(F.lit(tag)), field(kind), optional(source), optional(document), optional(record)), 256)


def _calendar(date: Column) -> Column:
    parts = F.split(date, "-")
    return F.try_to_date(F.concat_ws("-", F.lpad(F.get(parts, 0), 4, "0"), F.lpad(F.get(parts, 1), 2, "0"), F.lpad(F.get(parts, 2), 2, "0")), "yyyy-MM-dd").isNotNull()


def review_date_ok(date: Column) -> Column:
    """Years 2000 to 2100; months and days may lack their zero."""
    year = F.regexp_extract(date, r"^(\d{1,9})-", 1).try_cast("int")
    return date.rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}$") & year.between(2000, 2100) & _calendar(date)


def strict_date_ok(date: Column) -> Column:
    return date.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~date.startswith("0000") & _calendar(date)


def reviewer_ok(name: Column) -> Column:
    shape = name.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$") & name.rlike("[a-z]") & F.char_length(name).between(3, 64)
    return shape & ~F.arrays_overlap(F.split(name, "-"), F.array(*map(F.lit, RESERVED)))


def commit_ok(sha: Column) -> Column:
    return sha.rlike("^[0-9a-fA-F]{40}$")


def safe_path(path: Column) -> Column:
    """A relative path without empty, `.` or `..` parts, backslashes or a drive."""
    return ~path.rlike(r"^$|^/|\\|^[A-Za-z]:|(^|/)\.{0,2}(/|$)")
