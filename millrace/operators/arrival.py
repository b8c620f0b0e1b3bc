"""Checks of arriving files: accept or quarantine each file as a whole, with the reason.

One row per file, no shuffle: every check is an expression over the head of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.dates import file_name_date
from millrace.schemas import CUSTOMER_HEADER, MANIFEST, POS_HEADER

ACCEPTED, QUARANTINED, FAILED = "accepted", "quarantined", "failed"
# Folder and suffix of each source, and the separator of its header (none for JSON).
ROUTES = {"pos": (".csv", ","), "ecommerce": (".json", None), "customers": (".txt", "|")}
ORDER_KEYS = ("orderId", "items")
REASON_CHARS = 80
# Reject reasons.
EMPTY = "file is empty"
NOT_UTF8 = "not valid UTF-8 text"
NO_HEADER = "no header row"
WRONG_HEADER = "unexpected header: "
HEADER_ONLY = "header only, no data rows"
NO_ROWS = "no data rows"
NOT_JSON = "first line is not JSON"
NO_ORDER = "first line has no orderId or items"

# White space as text functions of scripting languages see it: Unicode spaces and the separators.
_SPACE = r"[\s\x{1C}-\x{1F}]"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def first_line(head: Column) -> Column:
    return strip(F.split_part(head, F.lit("\n"), F.lit(1)))


def after_first_line(head: Column) -> Column:
    return F.regexp_replace(head, r"\A[^\n]*\n?", "")


def first_filled_line(head: Column) -> Column:
    return first_line(F.regexp_replace(head, rf"(?U)\A{_SPACE}+", ""))


def cells(line: Column, separator: str) -> Column:
    return F.transform(F.split(line, f"[{separator}]"), strip)


# Text in double quotes without raw control characters; the loops give nothing back.
_STRING = r'"[^"\\\x00-\x1F]*+(?:\\[^\x00-\x1F][^"\\\x00-\x1F]*+)*+"'
_NOT_FINITE = r"(?<![A-Za-z0-9_])(?:NaN|-?Infinity)(?![A-Za-z0-9_])"


def is_json(line: Column) -> Column:
    """Whether the whole line is one JSON value; text after the value makes it invalid.

    Single quotes and raw control characters in texts are invalid, NaN and Infinity are valid. Lines that
    have such a thing are judged without their texts, the others as they are.
    """
    bare = F.regexp_replace(F.regexp_replace(line, _STRING, '""'), _NOT_FINITE, "0")
    odd = line.rlike(r"['\x00-\x1F]|NaN|Infinity")
    judged = F.when(odd & bare.rlike(r"['\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit("")).when(odd, bare).otherwise(line)
    as_array = F.json_array_length(F.concat(F.lit("["), judged, F.lit("]")))
    return F.coalesce(as_array == 1, F.lit(False))


def is_order(line: Column) -> Column:
    keys = F.json_object_keys(F.when(line.rlike("NaN|Infinity"), F.regexp_replace(line, _NOT_FINITE, "0")).otherwise(line))
    has_keys = [F.array_contains(keys, key) for key in ORDER_KEYS]
    return F.coalesce(has_keys[0] & has_keys[1], F.lit(False))


def order_problem(head: Column, not_json: str = NOT_JSON) -> Column:
    line = first_filled_line(head)
    return (
        F.when(line == "", F.lit(NO_ROWS))
        .when(~is_json(line), F.lit(not_json))
        .when(~is_order(line), F.lit(NO_ORDER))
    )


def table_problem(head: Column, separator: str, header: tuple[str, ...]) -> Column:
    line = first_line(head)
    expected = F.array(*[F.lit(name) for name in header])
    return (
        F.when(line == "", F.lit(NO_HEADER))
        .when(cells(line, separator) != expected, F.concat(F.lit(WRONG_HEADER), F.left(line, F.lit(REASON_CHARS))))
        .when(strip(after_first_line(head)) == "", F.lit(HEADER_ONLY))
    )


def source_of(key: Column) -> Column:
    """Source by folder and suffix; NULL for a file that belongs to none."""
    source = F.lit(None).cast("string")
    for name, (suffix, _) in ROUTES.items():
        source = F.when(key.startswith(f"{name}/") & key.endswith(suffix), F.lit(name)).otherwise(source)
    return source


def landing_date(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, "/dt=([^/]+)/", 1), F.lit(""))


def manifest(heads: DataFrame, pos_header: tuple[str, ...] = POS_HEADER) -> DataFrame:
    """One row per routed file: accepted, quarantined under quarantine/ with the reason, or failed when
    it could not be read at all (no verdict, so the next run tries it again)."""
    head, source, error = F.col("head"), F.col("source"), F.col("error")
    headers = {"pos": pos_header, "customers": CUSTOMER_HEADER}
    content = F.when(source == "ecommerce", order_problem(head))
    for name, header in headers.items():
        content = content.when(source == name, table_problem(head, ROUTES[name][1], header))
    problem = (
        F.when(error.isNotNull(), error)
        .when(F.col("size") == 0, F.lit(EMPTY))
        .when(head.isNull(), F.lit(NOT_UTF8))
        .otherwise(content)
    )
    if "modified" not in heads.columns:
        heads = heads.withColumn("modified", F.lit(None).cast("timestamp"))
    named = heads.withColumn("source", source_of(F.col("key"))).filter(source.isNotNull())
    judged = named.withColumns({
        "reason": F.regexp_replace(problem, "[^ -~]", "?"),
        "dt": landing_date(F.col("key")),
    }).withColumn(
        "status",
        F.when(error.isNotNull(), F.lit(FAILED))
        .when(F.col("reason").isNull(), F.lit(ACCEPTED))
        .otherwise(F.lit(QUARANTINED)),
    )
    target = F.when(F.col("status") == ACCEPTED, F.col("key")).when(
        F.col("status") == QUARANTINED, F.concat(F.lit("quarantine/"), F.col("key"))
    )
    return judged.withColumns({"target_key": target, "checked_at": F.current_timestamp()}).select(*MANIFEST.names)


STATE = ("path", "size", "modified")


def routed(files: DataFrame) -> DataFrame:
    """Files that belong to a source, by key alone: the others are never opened."""
    return files.where(source_of(F.col("key")).isNotNull())


def not_yet_seen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose state (path, size and time of change) has no verdict in `seen`."""
    states = seen.select(*STATE).distinct()
    same = [files[name].eqNullSafe(states[name]) for name in STATE]
    return files.join(states, same[0] & same[1] & same[2], "left_anti")


def last_verdicts(files: DataFrame) -> DataFrame:
    """The last verdict of each path: of its latest state, and of that the latest check."""
    order = F.struct("modified", "checked_at")
    names = [name for name in files.columns if name != "path"]
    last = files.groupBy("path").agg(F.max_by(F.struct(*names), order).alias("last"))
    return last.select("path", "last.*")


def accepted_now(verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a listing whose last verdict is acceptance and that have not changed since (path, source, dt).

    A file that has changed and has not been checked, or could not be read, is not among them.
    """
    last = last_verdicts(verdicts).filter(F.col("status") == ACCEPTED)
    there = files.select(*[F.col(name).alias(f"now_{name}") for name in STATE])
    same = [F.col(name).eqNullSafe(F.col(f"now_{name}")) for name in STATE]
    return last.join(there, same[0] & same[1] & same[2]).select("path", "source", "dt")


# ---- the sender's own check, before files enter the landing zone

FORMATS = {"csv": ("pos", ".csv"), "json": ("ecommerce", ".json"), "psv": ("customers", ".txt")}
NOT_JSON_SENT = "first line is not valid JSON"
NOT_TABLE = "cannot be read as CSV"


def _loose_table_problem(head: Column, separator: str) -> Column:
    # A carriage return ends a record too.
    head = F.regexp_replace(head, "\r\n?", "\n")
    line = F.split_part(head, F.lit("\n"), F.lit(1))
    parts = cells(F.replace(line, F.lit('"'), F.lit("")), separator)
    problem = F.when(~F.exists(parts, lambda cell: cell != ""), F.lit(NO_HEADER))
    if separator != ",":
        problem = problem.when(F.size(parts) < 2, F.lit(f"header does not use the '{separator}' delimiter"))
    return problem.when(after_first_line(head) == "", F.lit(HEADER_ONLY))


def _sent_problem(kind: str) -> Column:
    head = F.col("head")
    if kind == "json":
        content, not_text = order_problem(head, NOT_JSON_SENT), NOT_JSON_SENT
    else:
        content, not_text = _loose_table_problem(head, "," if kind == "csv" else "|"), NOT_TABLE
    return F.when(F.col("size") == 0, F.lit(EMPTY)).when(head.isNull(), F.lit(not_text)).otherwise(content)


def landing_key(folder: str | Column, name: Column) -> Column:
    """Place of a file in the landing zone by the date in its name."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    day = F.coalesce(F.concat(F.lit("dt="), file_name_date(name)), F.lit("undated"))
    return F.concat_ws("/", folder, day, name)


def sending_list(
    heads: DataFrame, landed: DataFrame, kinds: tuple[str, ...] = ("csv",), folder: str | None = None
) -> DataFrame:
    """What happens to each local file of the given kinds: uploaded, skipped (same key and size landed)
    or failed.

    A file with a problem is flagged and sent all the same; the arrival check is the gate.
    """
    name = F.element_at(F.split(F.col("key"), "/"), -1)
    kind = target = problem = F.lit(None).cast("string")
    for each in kinds:
        default_folder, suffix = FORMATS[each]
        kind = F.when(F.lower(name).endswith(suffix), F.lit(each)).otherwise(kind)
        target = F.when(F.col("kind") == each, F.lit(folder or default_folder)).otherwise(target)
        problem = F.when(F.col("kind") == each, _sent_problem(each)).otherwise(problem)
    files = heads.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        name.alias("file_name"),
        landing_key(target, name).alias("key"),
        file_name_date(name).alias("dt"),
        "size",
        F.when(F.col("error").isNull(), problem).alias("problem"),
        "error",
    )
    there = landed.select("key", "size").distinct().withColumn("landed", F.lit(True))
    status = (
        F.when(F.col("error").isNotNull(), F.lit("failed"))
        .when(F.col("landed"), F.lit("skipped"))
        .otherwise(F.lit("uploaded"))
    )
    return files.join(there, ["key", "size"], "left").select(
        "file_name", "key", "dt", "size", "problem", status.alias("status")
    )


def sending_summary(files: DataFrame) -> DataFrame:
    return files.agg(
        *[F.count_if(F.col("status") == status).alias(status) for status in ("uploaded", "skipped", "failed")],
        F.count_if(F.col("problem").isNotNull()).alias("flagged"),
    ).select("uploaded", "skipped", "flagged", "failed")


def arrival_summary(files: DataFrame) -> DataFrame:
    """Files and dated folders per source, status and reason."""
    return files.groupBy("source", "status", "reason").agg(
        F.count("*").alias("files"), F.count_distinct("dt").alias("days")
    )
