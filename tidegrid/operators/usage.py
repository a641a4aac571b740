"""Usage quotas, lockout, listings, settings and translations as DataFrame queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTA_ZONE = "Asia/Taipei"
LOCKOUT_FAILURES = 5
LOCKOUT_MINUTES = 15
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100


def period_start(ts: Column, period: Column | str) -> Column:
    """Local midnight, or Monday midnight for a weekly period, as a UTC timestamp."""
    p = F.lit(period) if isinstance(period, str) else period
    local = F.from_utc_timestamp(ts, QUOTA_ZONE)
    start = F.when(p == "weekly", F.date_trunc("week", local)).otherwise(F.date_trunc("day", local))
    return F.to_utc_timestamp(start, QUOTA_ZONE)


def next_reset(ts: Column, period: Column | str) -> Column:
    """Next local midnight, or next Monday midnight (never today)."""
    p = F.lit(period) if isinstance(period, str) else period
    local = F.from_utc_timestamp(ts, QUOTA_ZONE)
    ahead = F.when(
        p == "weekly", F.date_trunc("week", local) + F.expr("INTERVAL 7 DAYS")
    ).otherwise(F.date_trunc("day", local) + F.expr("INTERVAL 1 DAY"))
    return F.to_utc_timestamp(ahead, QUOTA_ZONE)


def valid_quota(limit: Column, period: Column) -> Column:
    return (limit >= 1) & period.isin("daily", "weekly")


def usage_by_period(events: DataFrame, user: str, ts: str, period: str) -> DataFrame:
    """Events per user and quota period; partial counts combine before the shuffle."""
    return events.groupBy(F.col(user).alias("user_id"), period_start(F.col(ts), period).alias("period_start")).agg(
        F.count("*").alias("used")
    )


def quota_status(
    users: DataFrame, assessments: DataFrame, now: Column, limit: int, period: str
) -> DataFrame:
    """Per user of ``users(user_id, last_reset)``: used, remaining, allowed, next_reset.

    A reset older than the current period is stale and counts as reset now, so
    nothing has been used since.
    """
    boundary = period_start(now, period)
    state = users.withColumn(
        "since", F.when(F.col("last_reset") < boundary, now).otherwise(F.col("last_reset"))
    )
    used = (
        assessments.join(state.select("user_id", "since"), "user_id")
        .filter(F.col("created_at") >= F.col("since"))
        .groupBy("user_id").agg(F.count("*").alias("used"))
    )
    out = state.join(used, "user_id", "left").na.fill(0, ["used"])
    return out.select(
        "user_id", "used",
        F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"),
        (F.col("used") < limit).alias("allowed"),
        next_reset(now, period).alias("next_reset"),
    )


def lockout_checks(
    attempts: DataFrame, max_failures: int = LOCKOUT_FAILURES, minutes: int = LOCKOUT_MINUTES
) -> DataFrame:
    """For every attempt, failures of that user in the preceding minutes and the lock state.

    ``attempts`` is (user_id, attempted_at, success). The range is open at its
    lower end. Attempts are split into time slices of one window length and
    each is also copied into the following slice, so a user holding most rows
    is spread over many tasks.
    """
    micros = F.unix_micros(F.col("attempted_at").cast("timestamp"))
    span = minutes * 60 * 1_000_000
    slice_no = F.floor(micros / span)
    copies = attempts.withColumns({"__us": micros, "__own": slice_no}).withColumn(
        "__slice", F.explode(F.array(F.col("__own"), F.col("__own") + 1))
    )
    recent = W.partitionBy("user_id", "__slice").orderBy("__us").rangeBetween(-(span - 1), 0)
    failures = F.count_if(~F.col("success")).over(recent)
    return (
        copies.withColumn("failures", failures)
        .filter(F.col("__slice") == F.col("__own"))
        .select(*attempts.columns, "failures", (F.col("failures") >= max_failures).alias("blocked"))
    )


def is_blocked(attempts: DataFrame, now: Column, max_failures: int = LOCKOUT_FAILURES,
               minutes: int = LOCKOUT_MINUTES) -> DataFrame:
    """Lock state of every user with failures in the window before ``now``."""
    since = now - F.expr(f"INTERVAL {minutes} MINUTES")
    return attempts.filter(~F.col("success") & (F.col("attempted_at") > since)).groupBy("user_id").agg(
        F.count("*").alias("failures"), (F.count("*") >= max_failures).alias("blocked")
    )


def page_bounds(page: int, size: int) -> tuple[int, int]:
    """(offset, limit); values out of range fall back to the first page and 20 rows."""
    page = page if page >= 1 else 1
    size = size if 1 <= size <= MAX_PAGE_SIZE else DEFAULT_PAGE_SIZE
    return (page - 1) * size, size


def paginate(df: DataFrame, order: list[Column], page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page; a top-k sort, so no task sees more than offset plus limit rows of a partition."""
    offset, limit = page_bounds(page, size)
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page with ``total``, the number of all rows; a page past the end is empty."""
    total = df.agg(F.count("*")).first()[0]
    return paginate(df, order, page, size).withColumn("total", F.lit(total).cast("long"))


def user_history(
    assessments: DataFrame, uploads: DataFrame, user_id, page: int = 1, size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """A user's assessments, newest first."""
    own = user_assessments(assessments, uploads.filter(F.col("user_id") == user_id))
    return page_with_total(own, [F.desc("created_at"), F.asc("id")], page, size)


def user_assessments(assessments: DataFrame, uploads: DataFrame) -> DataFrame:
    """Assessments with their upload's user and file name."""
    return assessments.join(uploads, "upload_id")


def usage_since(assessments: DataFrame, uploads: DataFrame, since: Column) -> DataFrame:
    return user_assessments(assessments, uploads).filter(F.col("created_at") >= since).groupBy(
        "user_id"
    ).agg(F.count("*").alias("used"))


def users_with_usage(users: DataFrame, usage: DataFrame, limit: int) -> DataFrame:
    """Every user with used and remaining, in one join."""
    return users.join(usage, "user_id", "left").na.fill(0, ["used"]).withColumn(
        "remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used"))
    )


def latest_per(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """Latest row per key by aggregation (no window over a hot key)."""
    rest = [c for c in df.columns if c != key]
    picked = F.max_by(F.struct(*rest), F.struct(order, tie))
    return df.groupBy(key).agg(picked.alias("__row")).select(key, "__row.*")


def owned_by(df: DataFrame, row_id, user_id) -> DataFrame:
    """A row only if it belongs to the user."""
    return df.filter((F.col("id") == row_id) & (F.col("user_id") == user_id))


def backfill_filename(assessments: DataFrame, uploads: DataFrame) -> DataFrame:
    """Missing names take the upload's file name without its extension."""
    files = uploads.select("upload_id", F.regexp_replace("filename", r"\.[^.]*$", "").alias("__stem"))
    return assessments.join(files, "upload_id", "left").withColumn(
        "filename", F.coalesce(F.nullif("filename", F.lit("")), "__stem")
    ).drop("__stem")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or update by key; the latest change wins."""
    rest = [c for c in current.columns if c not in keys]
    both = current.unionByName(changes)
    return both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("__row")
    ).select(*keys, "__row.*").select(*current.columns)


def search_translations(entries: DataFrame, locale: str | None, query: str | None) -> DataFrame:
    """Entries of a locale whose key or value contains the text, ignoring case."""
    if locale:
        entries = entries.filter(F.col("locale") == locale)
    if query:
        entries = entries.filter(F.col("key").ilike(f"%{query}%") | F.col("value").ilike(f"%{query}%"))
    return entries


def translation_page(
    entries: DataFrame, locale: str | None, query: str | None, page: int = 1, size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """A page of the entries found, ordered by key and locale."""
    return page_with_total(search_translations(entries, locale, query), [F.asc("key"), F.asc("locale")], page, size)


def locale_map(entries: DataFrame, locale: str) -> DataFrame:
    """One row with the key-to-value map of a locale (a dictionary of UI texts)."""
    return entries.filter(F.col("locale") == locale).groupBy("locale").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("texts")
    )
