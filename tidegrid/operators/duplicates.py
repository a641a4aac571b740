"""Exact and near duplicates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.gaps import BEFORE, BEHIND, FIRST_AT, GAPS_AT, INPUT, KEYS, LAST_AT, gap_keys
from tidegrid.operators.positions import first_rows
from tidegrid.session import materialize
from tidegrid.sheet import Sheets

NEAR_COLUMNS = 5
NEAR_VALUES = 200
NEAR_DISTANCE = 2
NEAR_MIN_CHARS = 3
#: In the full search, values of up to so many characters meet by what two gaps leave, longer ones by thirds.
GAP_CHARS = 32
#: Blocks with more values than this are dealt out to several tasks.
HOT_BLOCK = 2000
#: Buckets of keys in which the blocks are counted.
HOT_BUCKETS = 1 << 16
#: Values that a task makes keys of, and keys that a task of their join gets, about.
TASK_VALUES = 20_000
TASK_KEYS = 500_000
#: Every so many values tell the sizes of the blocks; only how they are dealt out rests on it.
SIZING = 8


def near_candidates(flagged: DataFrame, max_columns: int = NEAR_COLUMNS) -> DataFrame:
    """Leftmost eligible columns per sheet."""
    eligible = flagged.filter("is_near_dup_candidate").select("sheet_id", "col_idx")
    return first_rows(eligible, ["sheet_id"], ["col_idx"], max_columns).drop("rank")


def near_values(
    sheets: Sheets, values: DataFrame, candidates: DataFrame, limit: int = NEAR_VALUES
) -> DataFrame:
    """Distinct values to compare: sheet_id, col_idx, rank, value, first_row.

    The rule itself is defined on the first 200 values in first-seen order;
    each task keeps only its own first ``limit`` values before the shuffle.
    """
    longer = values.filter(F.col("n_chars") > NEAR_MIN_CHARS).join(
        candidates, ["sheet_id", "col_idx"], "left_semi"
    )
    longer = first_rows(longer, ["sheet_id", "col_idx"], ["first_row"], limit)
    chosen = materialize(
        longer.select("sheet_id", "col_idx", "rank", "value", "is_long", "first_row")
    )
    return _whole_values(sheets, chosen, candidates)


def _whole_values(sheets: Sheets, chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    plain = chosen.filter(~F.col("is_long")).drop("is_long")
    long_ones = chosen.filter("is_long")
    if long_ones.isEmpty():
        return plain
    # Long values travel as digests; read the whole texts back by position.
    texts = sheets.cells_of(candidates).withColumnRenamed("row_idx", "first_row")
    whole = long_ones.drop("value", "is_long").join(
        texts, ["sheet_id", "col_idx", "first_row"]
    )
    return plain.unionByName(whole.withColumnRenamed("raw", "value"))


def near_pairs(chosen: DataFrame) -> DataFrame:
    """Pairs within edit distance 2 among at most ``NEAR_VALUES`` values per column.

    The other values of the column are one short array, so nothing is paired by
    a join and only matching pairs leave the expression.
    """
    entry = F.struct("rank", "value", "first_row")
    lists = chosen.groupBy("sheet_id", "col_idx").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    each = lists.select("sheet_id", "col_idx", "all", F.explode("all").alias("a"))
    later = F.filter(
        "all",
        lambda b: (b["rank"] > F.col("a.rank"))
        & (F.levenshtein(F.col("a.value"), b["value"], NEAR_DISTANCE) >= 0),
    )
    return each.select("sheet_id", "col_idx", "a", F.explode(later).alias("b")).select(
        "sheet_id", "col_idx",
        F.col("a.rank").alias("rank1"), F.col("b.rank").alias("rank2"),
        F.col("a.value").alias("value1"), F.col("b.value").alias("value2"),
        F.col("a.first_row").alias("row1"), F.col("b.first_row").alias("row2"),
    )


def near_pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("sheet_id").agg(F.count("*").alias("n_near"))


def all_near_values(sheets: Sheets, values: DataFrame, flagged: DataFrame) -> DataFrame:
    """Every distinct value of every eligible column: sheet_id, col_idx, value, first_row."""
    eligible = materialize(flagged.filter("is_near_dup_candidate").select("sheet_id", "col_idx"))
    longer = values.filter(F.col("n_chars") > NEAR_MIN_CHARS).join(eligible, ["sheet_id", "col_idx"], "left_semi")
    chosen = materialize(longer.select("sheet_id", "col_idx", "value", "is_long", "first_row"))
    return materialize(_whole_values(sheets, chosen, eligible))


def _key(*parts: Column) -> Column:
    return F.xxhash64("sheet_id", "col_idx", *parts)


def _meeting(index: DataFrame, probe: DataFrame, *more: str, sizing: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Rows of ``index`` and ``probe`` with equal keys and columns ``more``, as a and b; hot keys are dealt out by salt.

    ``sizing``: keys of one index row in so many, enough to tell the hot ones; else all are counted.
    """
    counted, each = sizing or (index, 1)
    # Keys are counted in buckets, as most keys are rare: a hot one makes its bucket stand out.
    bucket = F.pmod("key", F.lit(HOT_BUCKETS)).cast("int").alias("bucket")
    sizes = materialize(counted.groupBy(bucket).agg((F.count("*") * each).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    usual = total // HOT_BUCKETS
    hot = materialize(
        sizes.filter(F.col("n") > HOT_BLOCK + 2 * usual)
        .select("bucket", F.ceil(F.col("n") / HOT_BLOCK).cast("int").alias("salts"))
    )
    salts = F.coalesce("salts", F.lit(1))
    a = index.withColumn("bucket", bucket).join(hot, "bucket", "left").withColumn("salt", F.pmod(F.hash("first_row"), salts))
    b = probe.withColumn("bucket", bucket).join(hot, "bucket", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    a, b = a.drop("bucket", "salts"), b.drop("bucket", "salts")
    on = ["key", "salt", *more]
    if (parts := total // TASK_KEYS) > int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        a, b = a.repartition(parts, *on), b.repartition(parts, *on)
    # The planner takes an exploded side for as small as what it came from and would send it whole to
    # every task by way of the driver.
    return a.alias("a").join(b.hint("merge").alias("b"), on)


def _forks(short: DataFrame) -> DataFrame:
    """The values with heads and tails: bits of the positions where others of the column go on, or lead up to
    the rest, by another character; longer_heads and longer_tails: those of them in a value longer by two or more."""
    text, at, owner = F.col("value"), F.col("at"), ["sheet_id", "col_idx", "first_row"]
    size = F.length(text)
    each = short.select(*owner, "value", size.alias("size"), F.explode(F.sequence(F.lit(0), size)).alias("at"))
    heads = each.select(
        *owner, "at", "size", F.lit(True).alias("is_head"),
        _key(F.lit(0), F.substring(text, F.lit(1), at)).alias("key"), F.substring(text, at + 1, F.lit(1)).alias("char"))
    tails = each.select(
        *owner, "at", "size", F.lit(False).alias("is_head"),
        _key(F.lit(1), F.substring(text, at + 1, F.col("size"))).alias("key"),
        F.when(at > 0, F.substring(text, at, F.lit(1))).otherwise("").alias("char"))
    ends = heads.unionByName(tails)
    forks = ends.groupBy("key").agg(
        F.min("char").alias("lo"), F.max("char").alias("hi"), F.max("size").alias("most")
    ).filter("lo <> hi").select("key", "most")
    longer = F.col("most") >= F.col("size") + NEAR_DISTANCE

    def bits(which: Column) -> Column:
        return F.coalesce(F.bit_or(F.when(which, F.expr("shiftleft(1L, at)"))), F.lit(0))

    head = F.col("is_head")
    masks = ends.join(forks.hint("merge"), "key").groupBy(*owner).agg(
        bits(head).alias("heads"), bits(~head).alias("tails"),
        bits(head & longer).alias("longer_heads"), bits(~head & longer).alias("longer_tails"))
    v, m = short.alias("v"), masks.hint("merge").alias("m")
    same = [F.col(f"v.{n}").eqNullSafe(F.col(f"m.{n}")) for n in owner]
    return v.join(m, reduce(and_, same)).select("v.*", *INPUT[3:])


def _short_pairs(short: DataFrame) -> DataFrame:
    """Within two edits, both values are a common beginning, middle and end with at most one character in each gap.

    The beginning and the end are the longest common ones, so each pair is met once (``gaps``).
    """
    owner = ["sheet_id", "col_idx", "first_row"]
    # Keys are many times the values, so the size of the table says too little about the tasks they need.
    forked = materialize(_forks(short))
    parts = max(forked.sparkSession.sparkContext.defaultParallelism, forked.count() // TASK_VALUES)
    forked = forked.repartition(parts).select(
        *owner, F.encode("value", "UTF-32").alias("codes"), _key(F.lit(0)).alias("seed"), _key(F.lit(1)).alias("seed2"),
        *INPUT[3:])

    def rows(values: DataFrame, columns: list[str], *gaps: int) -> DataFrame:
        types = [f"{n} {values.schema[n].dataType.simpleString()}" for n in columns]
        return values.select(*columns, *INPUT).mapInArrow(gap_keys(*gaps), ", ".join([*types, KEYS]))

    # Every pair has a value with a character before the middle.
    index = rows(forked, owner, BEFORE, BEFORE | BEHIND)
    probe = rows(forked, ["first_row"], 0, BEFORE, BEHIND, BEFORE | BEHIND)
    some = rows(forked.filter(F.pmod(F.xxhash64("codes"), F.lit(SIZING)) == 0), ["first_row"], BEFORE, BEFORE | BEHIND)
    a, b = F.col("a.marks"), F.col("b.marks")
    row1, row2 = F.col("a.first_row"), F.col("b.first_row")
    other = a.bitwiseXOR(b)
    # Else the common beginning or end goes on.
    longest = (F.shiftright(other, FIRST_AT) != 0) & (other.bitwiseAND((1 << FIRST_AT) - (1 << LAST_AT)) != 0)
    gaps1, gaps2 = (F.shiftright(x, GAPS_AT).bitwiseAND(BEFORE | BEHIND) for x in (a, b))
    shifted = (gaps1 == BEFORE) & (gaps2 == BEHIND) & (row1 != row2) & (a.bitwiseAND(b).bitwiseAND(1) == 0)
    once = (gaps1 > gaps2) | ((gaps1 == gaps2) & (row1 < row2)) | shifted
    return _meeting(index, probe, "check", sizing=(some, SIZING)).filter(longest & once).select(
        "sheet_id", "col_idx", row1.alias("row1"), row2.alias("row2"))


def _long_pairs(long: DataFrame) -> DataFrame:
    """Within two edits, one third of the shorter value stands whole in the other, shifted by at most two.

    Only keys and rows travel; the texts of the pairs that meet are joined to them.
    """
    text, size = F.col("value"), F.length("value")

    def third(chars: Column, i: int, shift: int) -> Column:
        start, end = F.floor(chars * i / 3), F.floor(chars * (i + 1) / 3)
        piece = F.substring(text, (start + 1 + shift).cast("int"), (end - start).cast("int"))
        return F.when(start + shift >= 0, _key(chars, F.lit(i), piece))

    def rows(keys: list[Column]) -> DataFrame:
        each = F.explode(F.array_compact(F.array_distinct(F.array(*keys)))).alias("key")
        return long.select("sheet_id", "col_idx", "first_row", size.alias("size"), each)

    index = rows([third(size, i, 0) for i in range(3)])
    probe = rows([
        third(size - more, i, shift) for more in range(NEAR_DISTANCE + 1) for i in range(3)
        for shift in range(-NEAR_DISTANCE, NEAR_DISTANCE + 1) if abs(shift) + abs(more - shift) <= NEAR_DISTANCE
    ])
    n_a, n_b = F.col("a.size"), F.col("b.size")
    once = (n_a < n_b) | ((n_a == n_b) & (F.col("a.first_row") < F.col("b.first_row")))
    met = _meeting(index, probe, "sheet_id", "col_idx").filter(once).select(
        "sheet_id", "col_idx", F.col("a.first_row").alias("row1"), F.col("b.first_row").alias("row2")
    ).distinct()
    for n in ("1", "2"):
        texts = long.select("sheet_id", "col_idx", F.col("first_row").alias(f"row{n}"), text.alias(f"value{n}"))
        met = met.join(texts, ["sheet_id", "col_idx", f"row{n}"])
    near = F.levenshtein(F.col("value1"), F.col("value2"), NEAR_DISTANCE) >= 0
    # Two short ones have met already.
    return met.filter(near & (F.greatest(F.length("value1"), F.length("value2")) > GAP_CHARS)).select(
        "sheet_id", "col_idx", "row1", "row2")


def all_near_pairs(values: DataFrame) -> DataFrame:
    """All pairs within edit distance 2: sheet_id, col_idx, row1 < row2 (first rows of the values)."""
    size = F.length("value")
    found = _short_pairs(values.filter(size <= GAP_CHARS))
    # Values near the limit are in both parts, so that pairs across it are found.
    long = values.filter(size > GAP_CHARS - NEAR_DISTANCE)
    if not long.isEmpty():
        found = found.unionByName(_long_pairs(long))
    found = found.select(
        "sheet_id", "col_idx", F.least("row1", "row2").alias("row1"), F.greatest("row1", "row2").alias("row2"))
    # Each pair of values is found once; only values that share a first row can bring a pair of rows again.
    shared = values.groupBy("sheet_id", "col_idx", "first_row").count().filter("count > 1")
    return found if shared.isEmpty() else found.distinct()


def near_neighbours(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Values with a near one: sheet_id, col_idx, value, first_row, n_near, first_near."""
    sides = pairs.sparkSession.sql(
        "SELECT sheet_id, col_idx, first_row, other FROM {pairs} "
        "UNPIVOT INCLUDE NULLS ((first_row, other) FOR side IN ((row1, row2), (row2, row1)))", pairs=pairs)
    counted = sides.groupBy("sheet_id", "col_idx", "first_row").agg(
        F.count("*").alias("n_near"), F.min("other").alias("first_near"))
    return values.join(counted, ["sheet_id", "col_idx", "first_row"]).select(
        "sheet_id", "col_idx", "value", "first_row", "n_near", "first_near")


def exact_duplicate_examples(facts: DataFrame, max_rows: int = 5) -> DataFrame:
    """First two rows of each duplicate group in first-seen order: sheet_id, row_idx.

    Mostly empty rows (over 70 % blank) are left out. The two smallest positions
    of a group come from aggregates, not from sorting the group.
    """
    dense = facts.filter((F.col("n_cols") - F.col("n_filled")) / F.col("n_cols") <= 0.7)
    groups = dense.groupBy("sheet_id", "row_key").agg(
        F.count("*").alias("n"), F.min("row_idx").alias("first_row")
    )
    repeated = groups.filter(F.col("n") > 1)
    # Two rows per group, so ceil(max_rows / 2) groups are enough.
    top = first_rows(repeated, ["sheet_id"], ["first_row"], (max_rows + 1) // 2)
    top = materialize(top.select("sheet_id", "row_key", "first_row", "rank"))
    members = dense.join(top, ["sheet_id", "row_key"]).filter(F.col("row_idx") > F.col("first_row"))
    second = members.groupBy("sheet_id", "rank").agg(F.min("row_idx").alias("row_idx"))
    both = top.select("sheet_id", "rank", F.col("first_row").alias("row_idx")).unionByName(second)
    return first_rows(
        both.withColumnRenamed("rank", "grp"), ["sheet_id"], ["grp", "row_idx"], max_rows
    ).select("sheet_id", F.col("rank").alias("pos"), "row_idx")
