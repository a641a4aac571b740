"""Issue detectors: one row per issue, with nested example rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.functions import cells as fx
from tidegrid.operators import duplicates as du
from tidegrid.operators import entities as en
from tidegrid.operators import examples as ex
from tidegrid.operators import hits as hx
from tidegrid.operators import profile as pf
from tidegrid.operators import structure as st
from tidegrid.operators.positions import BUCKET_ROWS, first_rows
from tidegrid.session import materialize
from tidegrid.sheet import Sheets

COLUMNS = [
    "sheet_id", "pos", "title", "severity", "affected_rows", "unit", "description",
    "indicator", "examples",
]


def _severity(score: str) -> Column:
    return F.when(F.col(score) < 60, "High").otherwise("Medium")


def _issue(
    df: DataFrame, pos: int, title, severity, affected, unit: str, description, indicator: str,
    examples: Column,
) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        "sheet_id", F.lit(pos).alias("pos"), lit(title).alias("title"),
        lit(severity).alias("severity"), affected.cast("long").alias("affected_rows"),
        F.lit(unit).alias("unit"), lit(description).alias("description"),
        F.lit(indicator).alias("indicator"),
        F.coalesce(examples, F.array()).cast(f"array<{ex.EXAMPLE_SCHEMA}>").alias("examples"),
    )


def _collect(df: DataFrame, order: list[str], limit: int, name: str = "examples") -> DataFrame:
    """Example rows to one ordered array per sheet, at most ``limit`` entries.

    ``df`` holds rows already cut to the first few per sheet and kind.
    """
    ordered = F.slice(F.array_sort(F.collect_list(F.struct(*order, "example"))), 1, limit)
    return df.groupBy("sheet_id").agg(F.transform(ordered, lambda x: x["example"]).alias(name))


class IssueTables:
    """Shared inputs of the detectors for one assessment."""

    def __init__(self, assessment) -> None:
        a = assessment
        self.a = a
        self.sheets: Sheets = a.sheets
        self.columns: DataFrame = a.columns
        scores = a.scores
        low = scores.select(
            "sheet_id",
            F.when(F.col("column_completeness") < 60, 0.5).otherwise(0.7).alias("low_threshold"),
        )
        self.company = pf.company_column(self.sheets.headers)
        self.layout = materialize(ex.sheet_layout(self.sheets, self.columns))
        self.problems = materialize(ex.problem_columns(self.columns, low, self.company))
        self.positions = ex.used_positions(self.problems)
        self.scores = materialize(scores.join(self.layout.drop("n_cols"), "sheet_id").join(self.problems, "sheet_id"))
        self.any = self.scores.agg(*[
            F.coalesce(F.max(F.expr(cond)), F.lit(False)).alias(name)
            for name, cond in {
                "subtotal": "has_subtotal", "mixed": "format_consistency < 80",
                "duplicates": "duplicate_similar < 80", "tables": "has_multiple_tables",
                "orphans": "n_orphans > 0",
            }.items()
        ]).first()
        self.find_hits()
        self.wanted: list[DataFrame] = []
        self.needed: list[DataFrame] = [self.first]
        self.variants: DataFrame | None = None
        self.merged: DataFrame | None = None

    def find_hits(self) -> None:
        """Masks of all row problems from one scan, with the keys of the rows where equal rows are shown."""
        low = self.scores.withColumn("wants_keys", F.col("duplicate_similar") < 80)
        rows = pf.row_facts(self.sheets, keep_cells=True) if self.any.duplicates else self.sheets.rows.join(
            self.layout.select("sheet_id", "n_cols"), "sheet_id")
        rows = rows.join(self.problems.join(low.select("sheet_id", "wants_keys"), "sheet_id"), "sheet_id")
        mixed = bool(self.any.mixed)
        bits = hx.problem_bits(self.sheets, self.positions, mixed, bool(self.any.subtotal))
        also, keep = [], None
        if self.any.duplicates:
            also = [F.when(F.col("wants_keys"), F.col("row_key")).alias("row_key"), F.col("n_cols"), F.col("n_filled")]
            keep = F.col("row_key").isNotNull()
        self.hits = materialize(hx.hit_rows(self.sheets, rows, bits, mixed, also, keep))
        counts = materialize(hx.hit_counts(self.hits, bits))
        self.affected = hx.affected_rows(counts, bits)
        self.first = materialize(hx.first_hits(self.hits, counts, bits, ex.MAX_STRUCTURE_EXAMPLES))

    def shown(self, kind: str, problem: Column, limit: int, label: Column | None = None) -> DataFrame:
        """Examples of one kind with display columns chosen around ``problem``."""
        rows = self.rows.filter(F.col("kind") == kind).join(self.scores_layout(), "sheet_id")
        display = ex.display_columns(problem, F.col("context_col"))
        rows = rows.withColumn("display", display)
        built = ex.example(
            F.transform("display", lambda i: F.get("names", i)),
            F.col("row_idx") + F.col("header_row_index") + 2,
            ex.shown_cells(F.col("cells"), F.col("display")),
            ex.positions_in(F.col("display"), F.col("flagged")),
            label,
        )
        return _collect(rows.select("sheet_id", "ord", "row_idx", built.alias("example")),
                        ["ord", "row_idx"], limit)

    def scores_layout(self) -> DataFrame:
        return self.layout.join(self.problems, "sheet_id")

    def with_examples(self, examples: DataFrame) -> DataFrame:
        counted = [c for c in self.affected.columns if c != "sheet_id"]
        return self.scores.join(examples, "sheet_id", "left").join(self.affected, "sheet_id", "left").na.fill(0, counted)

    def want(self, rows: DataFrame, kind: str, order: list, display: Column, flagged: Column,
             label: str = "") -> None:
        """Ask for example rows by position; all requests share one pass over the sheet."""
        first, second = [F.col(x) if isinstance(x, str) else x for x in order]
        self.wanted.append(rows.join(self.scores_layout(), "sheet_id").select(
            "sheet_id", "row_idx", F.lit(kind).alias("kind"), first.cast("long").alias("ord1"),
            second.cast("long").alias("ord2"), display.alias("display"),
            flagged.cast("array<int>").alias("flagged"), F.lit(label).alias("label"),
        ))

    def fetch(self) -> None:
        """The cells of all rows to show, by position and in one pass."""
        wanted = materialize(reduce(DataFrame.unionByName, self.wanted)) if self.wanted else None
        needed = self.needed if wanted is None else [*self.needed, wanted]
        positions = materialize(reduce(
            DataFrame.unionByName, [n.select("sheet_id", "row_idx") for n in needed]).distinct())
        self.at = materialize(self.sheets.rows.select(
            "sheet_id", "row_idx", *self.sheets.cell_names).join(positions, ["sheet_id", "row_idx"], "left_semi"))
        self.rows = materialize(hx.shown_rows(
            self.sheets, self.first, self.at, self.problems.join(
                self.layout.select("sheet_id", "n_cols"), "sheet_id"), self.positions))
        self.fetched = None
        if wanted is None:
            return
        cells = self.at.select("sheet_id", "row_idx", F.array(*self.sheets.cell_columns).alias("cells"))
        rows = wanted.join(cells, ["sheet_id", "row_idx"]).join(self.layout, "sheet_id")
        built = ex.example(
            F.transform("display", lambda i: F.get("names", i)),
            F.col("row_idx") + F.col("header_row_index") + 2,
            ex.shown_cells(F.col("cells"), F.col("display")),
            ex.positions_in(F.col("display"), F.col("flagged")), F.col("label"),
        )
        self.fetched = materialize(rows.select("sheet_id", "kind", "ord1", "ord2", built.alias("example")))

    def examples_of(self, kind: str, limit: int, name: str = "examples") -> DataFrame:
        return _collect(
            self.fetched.filter(F.col("kind") == kind).drop("kind"), ["ord1", "ord2"], limit, name
        )


def _names_where(columns: DataFrame, cond: Column, extra: list[Column] = ()) -> DataFrame:
    shown = fx.display_name(F.col("name"), F.col("col_idx")).alias("shown")
    return columns.filter(cond).groupBy("sheet_id").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", shown, *extra))).alias("cols")
    )


def row_completeness(t: IssueTables) -> DataFrame:
    df = t.with_examples(t.shown("empty", F.col("flagged"), ex.MAX_EXAMPLES))
    high = F.col("row_completeness") < 60
    n = F.col("n_incomplete")
    return _issue(
        df.filter(F.col("row_completeness") < 80), 1,
        F.when(high, "資料大量缺漏").otherwise("部分資料缺漏"), _severity("row_completeness"), n, "列受影響",
        F.when(high, F.format_string("共 %d 列存在空值欄位，平均每列填寫率僅 %.0f%%", n, "row_completeness"))
        .otherwise(F.format_string("共 %d 列存在部分空值，建議補齊資料以提升品質", n)),
        "row_completeness", F.col("examples"),
    )


def column_completeness(t: IssueTables) -> DataFrame:
    threshold = F.when(F.col("column_completeness") < 60, 0.5).otherwise(0.7)
    low = t.scores.select("sheet_id", threshold.alias("thr"))
    missing = ((1 - F.col("fill_ratio")) * 100).cast("int").alias("missing")
    named = _names_where(
        t.columns.join(low, "sheet_id"), F.col("fill_ratio") < F.col("thr"), [missing]
    )
    df = t.with_examples(t.shown("lowfill", F.col("lowfill"), ex.MAX_EXAMPLES)).join(named, "sheet_id")
    first = F.transform(
        F.slice("cols", 1, 3), lambda x: F.format_string("「%s」(%d%%)", x["shown"], x["missing"])
    )
    text = F.concat(F.lit("以下欄位嚴重缺漏："), F.array_join(first, "、"))
    rest = F.when(F.size("cols") > 3, F.format_string("⋯等 %d 欄", F.size("cols"))).otherwise("")
    high = F.col("column_completeness") < 60
    return _issue(
        df.filter(F.col("column_completeness") < 80), 2,
        F.when(high, "資料大量缺漏").otherwise("部分資料缺漏"), _severity("column_completeness"),
        F.col("rows_lowfill"), "列受影響", F.concat(text, rest), "column_completeness", F.col("examples"),
    )


def format_consistency(t: IssueTables) -> DataFrame:
    mixed = _names_where(t.columns, F.col("consistency") < 0.8)
    rows = t.rows.filter(F.col("kind") == "format").join(
        t.layout, "sheet_id"
    ).join(mixed, "sheet_id")
    nth = F.array_position(F.transform("cols", lambda x: x["col_idx"]), F.col("item"))
    n_cols = F.least(F.size("cols"), F.lit(ex.MAX_MIXED_COLUMNS))
    budget = F.greatest(F.floor(F.lit(ex.MAX_EXAMPLES) / n_cols), F.lit(2))
    keep = (nth <= ex.MAX_MIXED_COLUMNS) & (
        F.col("rank") <= F.when(F.col("dominant"), 1).otherwise(budget - 1)
    )
    rows = rows.filter(keep).withColumn(
        "display", ex.display_columns(F.col("flagged"), F.col("context_col"))
    )
    kind = fx.format_label(fx.format_type(F.get("cells", F.col("item"))))
    built = ex.example(
        F.transform("display", lambda i: F.get("names", i)),
        F.col("row_idx") + F.col("header_row_index") + 2,
        ex.shown_cells(F.col("cells"), F.col("display")),
        F.when(~F.col("dominant"), ex.positions_in(F.col("display"), F.col("flagged"))),
        F.get("names", F.col("item")), None,
        F.transform("display", lambda i: F.when(i == F.col("item"), kind).otherwise("")),
    )
    listed = rows.select(
        "sheet_id", "item", (~F.col("dominant")).alias("side"), "row_idx", built.alias("example")
    )
    df = t.with_examples(_collect(listed, ["item", "side", "row_idx"], ex.MAX_EXAMPLES)).join(
        mixed, "sheet_id"
    )
    high = F.col("format_consistency") < 60
    return _issue(
        df.filter(F.col("format_consistency") < 80), 3,
        F.when(high, "日期格式不一致").otherwise("格式混用"), _severity("format_consistency"),
        F.col("rows_text"), "列",
        F.concat(F.lit("以下欄位格式不一致（同欄位中混合了不同格式）：\n"),
                 F.array_join(F.transform("cols", lambda x: x["shown"]), "\n")),
        "format_consistency", F.col("examples"),
    )


def duplicate_rows(t: IssueTables) -> None:
    if not t.any.duplicates:
        return
    exact = du.exact_duplicate_examples(t.hits.filter(F.col("row_key").isNotNull()), ex.MAX_EXAMPLES)
    every = ex.first_columns(F.col("n_cols"))
    t.want(exact, "exact", ["pos", "row_idx"], every, every)
    pairs = first_rows(t.a.near, ["sheet_id"], ["col_idx", "rank1", "rank2"], ex.MAX_EXAMPLES)
    sides = pairs.select(
        "sheet_id", "col_idx", F.col("rank").alias("nth"),
        F.posexplode(F.array("row1", "row2")).alias("side", "row_idx"),
    )
    one = F.array("col_idx")
    t.want(sides, "near", ["nth", "side"], ex.display_columns(one, F.col("context_col")), one)


def duplicate_similar(t: IssueTables) -> DataFrame | None:
    if not t.any.duplicates:
        return None
    df = t.scores.join(t.examples_of("exact", ex.MAX_EXAMPLES), "sheet_id", "left").join(
        t.examples_of("near", ex.MAX_EXAMPLES, "near_examples"), "sheet_id", "left"
    )
    kept = (F.col("duplicate_similar") * F.col("n_rows") / 100).cast("long")
    n = F.greatest(F.lit(0), F.least(F.col("n_rows"), F.col("n_rows") - kept))
    shown = F.coalesce("examples", "near_examples")
    return _issue(
        df.filter(F.col("duplicate_similar") < 80), 4, "疑似重複資料", _severity("duplicate_similar"), n, "組",
        F.when(shown.isNull(), "偵測到欄位中有近似值（如拼寫相近的名稱），建議統一命名以避免混淆")
        .otherwise(F.format_string("偵測到約 %d 列重複或近似資料，建議清理以避免統計偏差", n)),
        "duplicate_similar", shown,
    )


def variant_rows(t: IssueTables) -> None:
    company = materialize(t.company)
    if company.isEmpty():
        return
    named = materialize(en.spellings(t.sheets, company))
    groups = materialize(en.variant_groups(named))
    t.variants = groups.groupBy("sheet_id").agg(
        F.count("*").alias("n_groups"), F.sum(F.col("total_rows") - F.col("canonical_count")).alias("n")
    )
    # Three groups of two rows fill the examples.
    top = first_rows(groups, ["sheet_id"], ["first_row"], 3).select(
        "sheet_id", "col_idx", "key", F.col("rank").alias("grp")
    )
    spelled = materialize(named.join(materialize(top), ["sheet_id", "col_idx", "key"]).select(
        "sheet_id", "col_idx", "spelling", "grp"
    ))
    spelling = F.replace(fx.trim_ws(F.col("raw")), F.lit("\n"), F.lit(" "))
    cells = t.sheets.cells_of(company).withColumn("spelling", spelling)
    rows = first_rows(
        cells.join(spelled, ["sheet_id", "col_idx", "spelling"]), ["sheet_id", "grp"], ["row_idx"], 2
    ).select("sheet_id", "col_idx", "grp", "row_idx")
    one = F.array("col_idx")
    t.want(rows, "variants", ["grp", "row_idx"], ex.display_columns(one, F.col("context_col")), one)


def name_variants(t: IssueTables) -> DataFrame | None:
    if t.variants is None:
        return None
    df = t.variants.filter("n > 0").join(t.examples_of("variants", ex.MAX_EXAMPLES), "sheet_id", "left")
    return _issue(
        df, 5, "客戶名稱不一致", "Medium", F.col("n"), "列",
        F.format_string("偵測到 %d 組客戶名稱有多種寫法，建議統一", "n_groups"), "name_variants", F.col("examples"),
    )


def merged_rows(t: IssueTables) -> None:
    """The first data rows with cells merged over columns."""
    if t.sheets.merged is None:
        return
    c = F.col
    wide = t.sheets.merged.filter(c("end_col") > c("start_col")).join(t.layout, "sheet_id").select(
        "sheet_id", (c("start_row") - c("header_row_index") - 2).cast("long").alias("row_idx"),
        (c("start_col") - 1).alias("lo"), (c("end_col") - 1).alias("hi"),
    ).join(t.scores.select("sheet_id", "n_rows"), "sheet_id")
    inside_data = (c("row_idx") >= 0) & (c("row_idx") < c("n_rows"))
    t.merged = materialize(first_rows(
        wide.filter(inside_data), ["sheet_id"], ["row_idx", "lo"], ex.MAX_EXAMPLES
    ).drop("rank", "n_rows"))
    t.needed.append(t.merged)


def _merged_examples(t: IssueTables) -> DataFrame | None:
    if t.merged is None:
        return None
    c = F.col
    cells = t.at.select("sheet_id", "row_idx", F.array(*t.sheets.cell_columns).alias("cells"))
    rows = t.merged.join(cells, ["sheet_id", "row_idx"]).join(t.layout, "sheet_id").withColumn(
        "display", ex.first_columns(c("n_cols")))
    inside = F.filter("display", lambda i: (i >= c("lo")) & (i <= c("hi")))
    span = F.size(inside)
    merges = F.when(span > 1, F.array(F.struct(F.get(inside, F.lit(0)).alias("start_col"), span.alias("span"))))
    built = ex.example(
        F.transform("display", lambda i: F.get("names", i)),
        c("row_idx") + c("header_row_index") + 2,
        ex.shown_cells(c("cells"), c("display")), inside, F.lit(lx.STRUCTURE_LABELS["merged"]), merges,
    )
    return _collect(rows.select("sheet_id", "row_idx", "lo", built.alias("example")),
                    ["row_idx", "lo"], ex.MAX_EXAMPLES)


def _leading_examples(t: IssueTables) -> DataFrame | None:
    if t.sheets.leading is None:
        return None
    c = F.col
    rows = t.sheets.leading.filter(c("cells").isNotNull()).join(t.layout, "sheet_id").join(
        t.scores.filter("has_multi_header").select("sheet_id"), "sheet_id"
    ).withColumn("display", ex.first_columns(c("n_cols")))
    built = ex.example(
        F.transform("display", lambda i: F.get("names", i)), c("row_no") + 1,
        F.transform("display", lambda i: fx.truncate(F.coalesce(F.get("cells", i), F.lit("")))),
        F.when(c("row_no") < c("header_row_index"), F.sequence(F.lit(0), F.size("display") - 1)),
        F.lit(lx.STRUCTURE_LABELS["multi_header"]),
    )
    return _collect(rows.select("sheet_id", "row_no", built.alias("example")), ["row_no"], ex.MAX_EXAMPLES)


def block_rows(t: IssueTables) -> None:
    """The first three rows of the first two blocks and one row of the gap between."""
    if not t.any.tables:
        return
    split = t.scores.filter("has_multiple_tables")
    blocks = materialize(
        st.data_blocks(t.a.sparse, split).filter("n_blocks > 1 AND block_idx < 2")
    )
    # Inside a block at most every other row is blank, so the first six
    # positions hold the first three data rows.
    near_start = blocks.withColumn("row_idx", F.explode(F.sequence(
        F.col("start_row"), F.least(F.col("end_row"), F.col("start_row") + 6) - 1
    ))).select("sheet_id", "block_idx", "row_idx")
    blank = t.a.sparse.filter("n_filled = 0").select("sheet_id", "row_idx")
    in_block = near_start.join(blank, ["sheet_id", "row_idx"], "left_anti")
    data = first_rows(in_block, ["sheet_id", "block_idx"], ["row_idx"], 3).select(
        "sheet_id", "row_idx", F.lit(True).alias("is_data")
    )
    gap = blocks.filter("block_idx = 0").select(
        "sheet_id", F.col("end_row").alias("row_idx"), F.lit(False).alias("is_data")
    )
    display = ex.display_columns(F.col("filled"), F.col("context_col"))
    t.want(
        data.unionByName(gap), "blocks", ["row_idx", F.lit(0)], display,
        F.when(F.col("is_data"), display).otherwise(F.array()),
        lx.STRUCTURE_LABELS["multi_table"],
    )


def table_structure(t: IssueTables) -> DataFrame:
    """One issue listing the problems that can be shown, then orphan totals under the same title."""
    words = t.rows.filter(F.col("kind") == "subtotal").groupBy("sheet_id").agg(
        F.array_distinct(F.flatten(F.collect_list("flagged"))).alias("word_cols")
    )
    subtotal = t.rows.filter(F.col("kind") == "subtotal").join(words, "sheet_id").join(
        t.layout, "sheet_id"
    ).withColumn("display", ex.display_columns(F.col("word_cols"), F.col("context_col")))
    subtotal = subtotal.select("sheet_id", "row_idx", ex.example(
        F.transform("display", lambda i: F.get("names", i)),
        F.col("row_idx") + F.col("header_row_index") + 2,
        ex.shown_cells(F.col("cells"), F.col("display")),
        ex.positions_in(F.col("display"), F.col("flagged")), F.lit(lx.STRUCTURE_LABELS["subtotal"]),
    ).alias("example"))
    parts = {
        "merged": _merged_examples(t),
        "multi_header": _leading_examples(t),
        "subtotal": _collect(subtotal, ["row_idx"], ex.MAX_EXAMPLES),
        "multi_table": t.examples_of("blocks", ex.MAX_STRUCTURE_EXAMPLES) if t.any.tables else None,
        "newlines": t.shown(
            "newline", F.col("newline"), ex.MAX_EXAMPLES, F.lit(lx.STRUCTURE_LABELS["newlines"])
        ),
    }
    df = t.scores
    for name, part in parts.items():
        if part is None:
            df = df.withColumn(f"ex_{name}", F.lit(None).cast(f"array<{ex.EXAMPLE_SCHEMA}>"))
        else:
            df = df.join(part.withColumnRenamed("examples", f"ex_{name}"), "sheet_id", "left")
    present = {
        "merged": "has_merged", "multi_header": "has_multi_header", "subtotal": "has_subtotal",
        "multi_table": "has_multiple_tables", "newlines": "any_is_newline_heavy",
    }
    shown = {k: F.when(F.col(flag), F.col(f"ex_{k}")) for k, flag in present.items()}
    problems = st.structure_problems({k: shown[k].isNotNull() for k in present})
    joined = F.flatten(F.array(*[F.coalesce(shown[k], F.array()) for k in present]))
    df = df.select("sheet_id", "table_structure", problems.alias("problems"), joined.alias("examples"))
    severity = F.when(F.col("table_structure") < 60, "High").when(
        F.col("table_structure") < 80, "Medium"
    ).otherwise("Low")
    return _issue(
        df.filter((F.col("table_structure") < 100) & (F.size("problems") > 0)), 6, "表格結構問題",
        severity, F.size("problems"), "處",
        F.concat(F.lit("偵測到"), F.array_join("problems", "、")), "table_structure", F.col("examples"),
    )


def orphan_totals(t: IssueTables) -> DataFrame | None:
    if not t.any.orphans:
        return None
    orphans = st.orphan_rows(
        t.a.sparse, t.scores.select("sheet_id", "post_gap")
    ).join(t.layout, "sheet_id")
    display = ex.first_columns(F.col("n_cols"))
    cells = F.array(*t.sheets.cell_columns)
    filled = F.filter(display, lambda i: ~fx.is_empty(F.get(cells, i)))
    number = F.col("row_idx") + F.col("header_row_index") + 2
    built = ex.example(
        F.transform(display, lambda i: F.get("names", i)), number,
        ex.shown_cells(cells, display), filled, F.lit("孤立合計列"),
    )
    listed = orphans.select("sheet_id", "row_idx", number.alias("number"), built.alias("example"))
    totals = listed.groupBy("sheet_id").agg(F.count("*").alias("n"))
    # The sentence names every row: first the rows of a bucket, then the buckets in order.
    parts = listed.groupBy("sheet_id", F.floor(F.col("row_idx") / BUCKET_ROWS).alias("bucket")).agg(
        F.array_join(F.array_sort(F.collect_list("number")).cast("array<string>"), "、").alias("part"))
    numbers = parts.groupBy("sheet_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("bucket", "part")))["part"], "、").alias("numbers"))
    top = first_rows(listed, ["sheet_id"], ["row_idx"], ex.MAX_EXAMPLES).select(
        "sheet_id", "row_idx", "example"
    )
    df = totals.join(numbers, "sheet_id").join(
        _collect(top, ["row_idx"], ex.MAX_EXAMPLES), "sheet_id"
    )
    return _issue(
        df, 7, "表格結構問題", "Medium", F.col("n"), "處",
        F.format_string("偵測到孤立合計列：第 %s 列（位於資料區塊後方的獨立數值列）",
                        F.col("numbers")),
        "table_structure", F.col("examples"),
    )


def placeholders(t: IssueTables) -> DataFrame:
    numeric = t.columns.filter("n_placeholder > 0").groupBy("sheet_id").agg(
        F.max("is_numeric_for_placeholder").alias("in_numbers")
    )
    df = t.with_examples(t.shown("placeholder", F.col("placeholder"), ex.MAX_EXAMPLES)).join(
        numeric, "sheet_id"
    )
    text = F.format_string(
        "有 %d 個儲存格寫著「同XX」（例如「同AH2」），意思是「跟上面某格一樣」，但 AI 無法理解這種寫法", "n_placeholders"
    )
    extra = F.when(F.col("in_numbers"), "。這些出現在金額欄位中，導致 AI 無法計算正確的合計金額").otherwise("")
    return _issue(
        df, 8, "「同XX」引用未填入實際值", "High", F.col("rows_placeholder"), "列受影響",
        F.concat(text, extra), "cell_reference_placeholder", F.col("examples"),
    )


def type_mismatch(t: IssueTables) -> DataFrame:
    mismatched = F.col("n_mismatch") > 0
    named = _names_where(t.columns, mismatched)
    worst = t.columns.filter(mismatched).groupBy("sheet_id").agg(
        (F.max(F.col("n_mismatch") / F.col("n_nonempty")) > 0.1).alias("many")
    )
    df = t.with_examples(t.shown("mismatch", F.col("mismatch"), ex.MAX_TYPE_EXAMPLES)).join(
        named, "sheet_id"
    ).join(worst, "sheet_id")
    return _issue(
        df, 9, "欄位型別不一致", F.when(F.col("many"), "High").otherwise("Medium"),
        F.col("rows_mismatch"), "列受影響",
        F.concat(F.lit("以下數值欄位中出現了非數字的值，AI 無法正確進行計算：\n"),
                 F.array_join(F.transform("cols", lambda x: x["shown"]), "\n")),
        "column_type_mismatch", F.col("examples"),
    )


def header_card_columns(blank: Column, n_cols: Column) -> Column:
    """Blank headers with their neighbours, filled up to six columns from the left, at most eight."""
    def grow(acc: Column, col: Column) -> Column:
        before = F.when(
            (col > 0) & ((F.size(acc) == 0) | (F.element_at(acc, -1) != col - 1)), F.array(col - 1)
        ).otherwise(F.array().cast("array<int>"))
        after = F.when(col + 1 < n_cols, F.array(col + 1)).otherwise(F.array().cast("array<int>"))
        return F.slice(F.concat(acc, before, F.array(col), after), 1, 8)

    near = F.aggregate(blank, F.array().cast("array<int>"), lambda acc, c: F.when(
        F.size(acc) >= 8, acc).otherwise(grow(acc, c)))
    fill = F.filter(F.sequence(F.lit(0), n_cols - 1), lambda c: ~F.array_contains(near, c))
    missing = F.greatest(F.lit(0), 6 - F.size(near))
    return F.array_sort(F.concat(near, F.slice(fill, 1, missing)))


def empty_headers(t: IssueTables) -> DataFrame | None:
    blank = F.when(fx.is_empty(F.col("name")), F.col("col_idx"))
    heads = materialize(t.sheets.headers.groupBy("sheet_id").agg(
        F.array_sort(F.collect_list(blank)).alias("blank"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("col_idx", fx.trim_ws(F.col("name")).alias("h")))),
            lambda x: F.when(F.coalesce(x["h"], F.lit("")) == "", "(空白)").otherwise(x["h"]),
        ).alias("titles"),
    ).filter(F.size("blank") > 0))
    if heads.isEmpty():
        return None
    cols = ["sheet_id", "n_cols", "header_row_index", "blank", "titles", "display"]
    heads = heads.join(t.layout, "sheet_id").withColumn(
        "display", header_card_columns(F.col("blank"), F.col("n_cols"))
    ).select(*cols)
    labels = F.transform("display", lambda i: F.get("titles", i))
    card = heads.select("sheet_id", F.lit(-1).cast("long").alias("row_idx"), ex.example(
        labels, F.lit(1), labels, ex.positions_in(F.col("display"), F.col("blank"))).alias("example"))
    top = t.sheets.rows.filter("row_idx < 2").select(
        "sheet_id", "row_idx", F.array(*t.sheets.cell_columns).alias("cells")
    ).join(heads, "sheet_id")
    context = top.select("sheet_id", "row_idx", ex.example(
        labels, F.col("row_idx") + F.col("header_row_index") + 2,
        ex.shown_cells(F.col("cells"), F.col("display"), 15), F.array().cast("array<int>"),
    ).alias("example"))
    df = heads.join(_collect(card.unionByName(context), ["row_idx"], 3), "sheet_id")
    places = F.array_join(F.transform("blank", lambda i: F.format_string("第%d欄", i + 1)), "、")
    return _issue(
        df, 10, "空白標題欄", "Medium", F.size("blank"), "欄",
        F.format_string("共 %d 個欄位標題為空白：%s。AI 無法判斷該欄位代表的意義", F.size("blank"), places),
        "empty_header", F.col("examples"),
    )


def inline_remarks(t: IssueTables) -> DataFrame:
    n = t.columns.filter("is_structured").groupBy("sheet_id").agg(F.sum("n_remark").alias("n_cells"))
    df = t.with_examples(t.shown("remark", F.col("remark"), ex.MAX_EXAMPLES)).join(n, "sheet_id")
    return _issue(
        df.filter("n_cells > 0"), 11, "行內備註混入資料欄", "Medium", F.col("n_cells"), "處",
        F.format_string("偵測到 %d 個儲存格在結構化欄位中混入括號備註，建議分離備註以利 AI 比對", "n_cells"),
        "inline_remark", F.col("examples"),
    )


def strike_rows(t: IssueTables) -> None:
    if t.sheets.strikes is None:
        return
    struck = t.sheets.strikes
    cols = struck.groupBy("sheet_id").agg(F.collect_set("col_idx").alias("strike_cols"))
    per_row = struck.groupBy("sheet_id", "row_idx").agg(F.collect_set("col_idx").alias("struck"))
    top = first_rows(per_row, ["sheet_id"], ["row_idx"], ex.MAX_EXAMPLES).drop("rank")
    t.want(
        top.join(cols, "sheet_id"), "strikes", ["row_idx", F.lit(0)],
        ex.display_columns(F.col("strike_cols"), F.col("context_col")), F.col("struck"),
    )


def strikethrough(t: IssueTables) -> DataFrame | None:
    if t.sheets.strikes is None:
        return None
    totals = t.sheets.strikes.groupBy("sheet_id").agg(
        F.count("*").alias("n_cells"), F.count_distinct("row_idx").alias("n_rows")
    )
    df = totals.join(t.examples_of("strikes", ex.MAX_EXAMPLES), "sheet_id", "left")
    return _issue(
        df, 12, "儲存格含刪除線格式", "Medium", F.col("n_rows"), "列受影響",
        F.format_string("有 %d 個儲存格使用刪除線標記，可能為待刪除但未移除的資料，建議確認是否應刪除或保留", "n_cells"),
        "strikethrough_formatting", F.col("examples"),
    )


def query_readiness(t: IssueTables) -> DataFrame:
    thin = _names_where(t.columns, F.col("fill_ratio") < 0.5)
    df = t.scores.join(thin, "sheet_id", "left")
    headers = F.array(F.lit("待改善項目"), F.lit("目前狀態"))

    def check(failed: Column, item: str, state) -> Column:
        text = F.lit(state) if isinstance(state, str) else state
        return F.when(failed, ex.example(
            headers, F.lit(0), F.array(F.lit(item), text), F.array(F.lit(1))))

    checks = F.array_compact(F.array(
        check(~F.col("good_names"), "欄位名稱", "部分欄位名稱為空或過短"),
        check(F.col("cols").isNotNull(), "每欄資料量",
              F.format_string("欄位「%s」超過一半為空", F.get("cols", F.lit(0))["shown"])),
        check(F.col("format_consistency") < 80, "格式一致性", "部分欄位格式混合使用"),
        check(F.col("duplicate_similar") < 80, "資料唯一性", "存在相似或重複的資料"),
        check(F.col("table_structure") < 100, "表格結構", "含有合併儲存格或小計列等"),
    ))
    return _issue(
        df.filter(F.col("ai_query_readiness") < 80), 13, "AI 應用完備度",
        _severity("ai_query_readiness"), F.col("n_rows"), "列",
        "部分結構化條件未滿足，可能影響 AI 分析的精準度與完整性", "ai_query_readiness", checks,
    )


DETECTORS = [
    row_completeness, column_completeness, format_consistency, duplicate_similar, name_variants,
    table_structure, orphan_totals, placeholders, type_mismatch, empty_headers, inline_remarks,
    strikethrough, query_readiness,
]


def merge_by_title(issues: DataFrame) -> DataFrame:
    """Issues of one title become one: largest count, highest severity, joined descriptions.

    A sheet has at most one issue per detector, so a group holds a handful of rows.
    """
    rank = F.create_map(*[F.lit(x) for kv in lx.SEVERITY_RANK.items() for x in kv])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "description", "examples", "unit", "indicator")))
    merged = issues.groupBy("sheet_id", "title").agg(
        F.min("pos").alias("pos"),
        F.max_by("severity", F.element_at(rank, F.col("severity"))).alias("severity"),
        F.max("affected_rows").alias("affected_rows"),
        ordered.alias("parts"),
    )
    first = F.get("parts", F.lit(0))
    several = F.size("parts") > 1
    # Later examples only fill up to the cap; a longer first list stays whole.
    total = F.flatten(F.transform("parts", lambda p: p["examples"]))
    room = F.greatest(F.size(first["examples"]), F.lit(ex.MAX_EXAMPLES))
    return merged.select(
        "sheet_id", "pos", "title", "severity", "affected_rows", first["unit"].alias("unit"),
        F.array_join(F.transform("parts", lambda p: p["description"]), "\n").alias("description"),
        F.when(several, "completeness").otherwise(first["indicator"]).alias("indicator"),
        F.slice(total, F.lit(1), room).alias("examples"),
    )


def translate(issues: DataFrame) -> DataFrame:
    titles = F.create_map(*[F.lit(x) for kv in lx.TITLE_EN.items() for x in kv])
    texts = F.create_map(*[F.lit(x) for kv in lx.DESCRIPTION_EN.items() for x in kv])
    return issues.select(
        "*",
        F.coalesce(F.get(F.array(F.element_at(titles, F.col("title"))), F.lit(0)), "title").alias("title_en"),
        F.coalesce(F.element_at(texts, F.col("indicator")), "description").alias("description_en"),
    )


def detect_issues(assessment, merge: bool = True) -> DataFrame:
    """All issues of all sheets in display order; ``pos`` counts from 1 per sheet."""
    tables = IssueTables(assessment)
    for rows in (duplicate_rows, variant_rows, block_rows, strike_rows, merged_rows):
        rows(tables)
    tables.fetch()
    found = [d(tables) for d in DETECTORS]
    # One union, so the small jobs of the detectors run side by side.
    issues = materialize(reduce(DataFrame.unionByName, [f.select(*COLUMNS) for f in found if f is not None]))
    if merge:
        issues = merge_by_title(issues)
    order = W.partitionBy("sheet_id").orderBy("pos")
    return translate(issues.withColumn("pos", F.row_number().over(order)))


def flagged_cells(assessment) -> DataFrame:
    """Cell-level list: sheet_id, row_idx, col_idx, col_name, raw, issue_type."""
    a = assessment
    columns = a.columns.select(
        "sheet_id", "col_idx", "is_mostly_numeric", "is_structured",
        fx.display_name(F.col("name"), F.col("col_idx")).alias("col_name"),
    )
    raw = F.col("raw")
    kinds = F.array_compact(F.array(
        F.when(fx.is_placeholder(raw), "cell_reference_placeholder"),
        F.when(F.col("is_mostly_numeric") & ~fx.is_numeric_currency(raw), "column_type_mismatch"),
        F.when(F.col("is_structured") & fx.has_inline_remark(raw), "inline_remark"),
    ))
    cells = a.sheets.cells().join(columns, ["sheet_id", "col_idx"]).select(
        "sheet_id", "row_idx", "col_idx", "col_name", "raw", F.explode(kinds).alias("issue_type")
    )
    blank = a.sheets.headers.filter(fx.is_empty(F.col("name"))).select(
        "sheet_id", F.lit(-1).cast("long").alias("row_idx"), "col_idx",
        fx.display_name(F.col("name"), F.col("col_idx")).alias("col_name"),
        F.lit("").alias("raw"), F.lit("empty_header").alias("issue_type"),
    )
    return cells.unionByName(blank)
