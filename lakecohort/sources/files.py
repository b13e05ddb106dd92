"""File discovery, tabular and JSON readers, form and dictionary sources."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecohort.sources import workbooks

TABULAR = (".xlsx", ".csv")
#: Kinds of tables that may be folders of parts, which follow each other by name.
PARTED = (".csv",)
JUNK = (".DS_Store", "Thumbs.db", "desktop.ini", ".gitkeep")
FORM = (
    "form_name string, source_pdf string, version string, summary string, "
    "sections map<string, struct<context: string, variables: array<string>>>, "
    "variables map<string, struct<description: string, values: map<string, string>, depends_on: string, condition: string, section_context: string>>"
)


def discover(folder: str, suffixes: Sequence[str] = TABULAR, junk: Sequence[str] = JUNK, label: str = "data") -> list[Path]:
    """Files of a folder itself, by name, without hidden, lock and junk files."""
    path = Path(folder)
    if not path.is_dir():
        raise FileNotFoundError(f"no {label} folder: {folder}")
    found = sorted(p for p in path.iterdir() if p.is_file() and p.suffix.lower() in suffixes and not p.name.startswith((".", "~$")) and p.name not in junk)
    if not found:
        raise ValueError(f"no {label} files in {folder}")
    return found


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Only the empty string is missing; NA and the like are values. Without a schema one more pass infers it."""
    reader = spark.read.options(header=True, encoding="UTF-8", nullValue="", emptyValue="")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def xlsx_sheets(path: str) -> list[tuple[str, list[list[str | None]]]]:
    """(sheet, rows of cell texts) of a workbook of dictionary size, read where it is called."""
    return [(name, [cells for _, cells in workbooks.rows(path, member)]) for name, member in workbooks.sheets(path).items()]


def unique_names(names: Sequence[str | None]) -> list[str]:
    """Name, Name_1, Name_2; a missing name is Unnamed."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = "Unnamed" if n is None or not str(n).strip() else str(n)
        out.append(n if n not in seen else f"{n}_{seen[n]}")
        seen[n] = seen.get(n, 0) + 1
    return out


def read_xlsx(spark: SparkSession, path: str, rows_per_partition: int = workbooks.ROWS) -> list[tuple[str, DataFrame]]:
    """(sheet, table of texts with the first row as header) of each sheet with a header; rows are parsed where Spark reads them, in ranges."""
    spark.dataSource.register(workbooks.Workbooks)
    out = []
    for name in workbooks.sheets(path):
        df = spark.read.format("workbook").option("sheet", name).option("rowsPerPartition", rows_per_partition).load(path)
        if df.columns:
            out.append((name, df))
    return out


def read_table(spark: SparkSession, path: str) -> list[tuple[str, DataFrame]]:
    """(logical sheet, table) of a CSV file or workbook."""
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        return [("sheet1", read_csv(spark, str(path)))]
    if suffix == ".xlsx":
        return read_xlsx(spark, str(path))
    raise ValueError(f"unknown kind of file: {path}")


def discover_all(spark: SparkSession, folder: str, suffixes: Sequence[str] = TABULAR, junk: Sequence[str] = JUNK, folders: bool | Sequence[str] = False) -> list[str]:
    """As discover, of a folder of any Hadoop file system: paths of its files by name. folders: tables that are folders count, all or those of these suffixes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"no data folder: {folder}")
    counts = lambda name: folders is True or bool(folders) and Path(name).suffix.lower() in folders
    names = sorted(n for n, plain in ((s.getPath().getName(), s.isFile()) for s in fs.listStatus(path)) if plain or counts(n))
    found = [n for n in names if Path(n).suffix.lower() in suffixes and not n.startswith((".", "~$")) and n not in junk]
    if not found:
        raise ValueError(f"no data files in {folder}")
    return [f"{folder.rstrip('/')}/{n}" for n in found]


def parted(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folder's tables that are folders of parts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(path) if fs.exists(path) else ()
    return sorted(s.getPath().getName() for s in found if s.isDirectory() and Path(s.getPath().getName()).suffix.lower() in PARTED)


def texts(spark: SparkSession, path: str) -> list[tuple[str, DataFrame]]:
    """(output name, table of texts) of a CSV file or folder of parts, of which only the header is read here, or of a workbook's sheets (a local file)."""
    if path.lower().endswith(".csv"):
        found = [("sheet1", spark.read.options(header=True, encoding="UTF-8", nullValue="", emptyValue="").csv(path))]
    else:
        found = read_xlsx(spark, path.removeprefix("file://").removeprefix("file:"))
    return [(output_name(path, sheet, len(found)), df) for sheet, df in found]


def has_blocks(df: DataFrame) -> bool:
    """Is the table read from a file, so that rows know their block?"""
    try:
        return bool(df.select("_metadata.file_block_start").columns)
    except AnalysisException:
        return False


def output_name(path: str, sheet: str, sheets: int) -> str:
    return Path(path).stem if sheets == 1 else f"{Path(path).stem}__{sheet}"


def read_jsonl(spark: SparkSession, path: str, strict: bool = False, schema: T.StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of JSON lines; malformed ones are skipped, or raise if strict."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df if limit is None else df.limit(limit)


def parse_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """line columns with parsed (struct, null if the line is no object) and bad (the line, where it isn't one)."""
    parsed = F.from_json(F.col(column), schema)
    is_object = F.trim(F.col(column)).startswith("{") & F.try_parse_json(F.col(column)).isNotNull()
    return lines.withColumn("parsed", F.when(is_object, parsed)).withColumn("bad", F.when(~is_object & (F.trim(F.col(column)) != ""), F.col(column)))


def read_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Form descriptions (*_variables.json) that name variables, with their file."""
    df = spark.read.schema(FORM).option("multiLine", True).option("pathGlobFilter", "[!.~]*_variables.json").json(folder)
    return df.withColumn("file", F.input_file_name()).filter(F.size("variables") > 0)


#: Rows of a block whose running sums one task works out.
FAN = 1 << 16


def running(df: DataFrame, at: str, value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows before, by the numbers (0 to 2^32) of the column at.

    In two levels: sums within blocks of 65536 numbers start from the sums of the blocks before, so no window holds more rows
    than a block, or blocks than a block of blocks.
    """
    before = lambda c, block, order: F.coalesce(F.sum(c).over(Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = df.withColumn("__value", value).withColumn("__own", F.expr(f"`{at}` div {FAN}"))
    totals = own.groupBy("__own").agg(F.sum("__value").alias("__total"))
    bases = totals.select("__own", before("__total", F.expr(f"__own div {FAN}"), "__own").alias("__base"))
    return own.withColumn("__inside", before("__value", "__own", at)).join(bases, "__own").withColumn(name, F.col("__inside") + F.col("__base")).drop("__value", "__own", "__inside", "__base")


def is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def strips(df: DataFrame, order: str = "row_index") -> DataFrame:
    """Rows that aren't empty, with the number of their strip: empty rows part strips. For one sheet of any length, whose rows are numbered (with gaps or not)."""
    cells = [F.col(f"`{c}`") for c in df.columns if c != order]
    marked = df.withColumn("__empty", reduce(Column.__and__, map(is_blank, cells), F.lit(True)))
    placed = running(marked.withColumn("__order", F.col(order).cast("long")), "__order", F.lit(1), "__pos").withColumn("__block", F.expr(f"__pos div {FAN}"))
    # the row before lies in the same block, or is the last of the block before
    last = placed.groupBy((F.col("__block") + 1).alias("__block")).agg(F.max_by("__empty", "__pos").alias("__last"))
    before = F.coalesce(F.lag("__empty").over(Window.partitionBy("__block").orderBy("__pos")), F.col("__last"), F.lit(True))
    opened = placed.join(last, "__block", "left").withColumn("__opens", ~F.col("__empty") & before)
    counted = running(opened, "__pos", F.col("__opens").cast("int"), "__strips")
    return counted.filter("not __empty").withColumn("strip", (F.col("__strips") + F.col("__opens").cast("int")).cast("int")).select(*df.columns, "strip")


def promoted(df: DataFrame, sheet: str, source: str, order: str = "row_index", marker: str = "ignore below") -> list[tuple[str, str, DataFrame]]:
    """(folder, name, table) of each table of a sheet: strips of rows, parted by columns that are empty throughout the strip.

    The first row of a table that isn't empty is its header; from a table that begins with the marker on, the folder is
    extras. The driver sees which columns each strip fills and the headers, not the rows.
    """
    cells = [c for c in df.columns if c != order]
    known = strips(df, order)
    filled = known.groupBy("strip").agg(*[F.max(~is_blank(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(cells)]).orderBy("strip").collect()  # a row a strip
    tables = [(row["strip"], run) for row in filled for run in _runs([c if row[str(i)] else None for i, c in enumerate(cells)])]
    if not tables:
        return []
    some = lambda run: reduce(Column.__or__, [~is_blank(F.col(f"`{c}`")) for c in run])
    content = lambda k, run: (F.col("strip") == k) & some(run)
    head = lambda run: F.struct(F.col(order).alias("at"), F.array(*[F.col(f"`{c}`").cast("string") for c in run]).alias("names"))
    heads = known.agg(*[F.min_by(head(run), F.when(content(k, run), F.col(order))).alias(str(i)) for i, (k, run) in enumerate(tables)]).first()
    out, folder = [], ""
    for i, (k, run) in enumerate(tables):
        first, rows = heads[i], known.filter(content(k, run))
        if any(marker in str(v).lower() for v in first["names"] if v is not None):
            folder = "extras"
            first = rows.filter(F.col(order) > first["at"]).agg(F.min_by(head(run), order)).first()[0]
        if first is not None:
            body = rows.filter(F.col(order) > first["at"])
            made = body.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(run, unique_names(first["names"]))])
            out.append((folder, f"{sheet}_table_{i + 1}", tagged(made, sheet, str(i + 1), source)))
    return out


def _runs(names: Sequence[str | None]) -> list[list[str]]:
    """Runs of names between the missing ones."""
    out: list[list[str]] = [[]]
    for n in names:
        if n is not None:
            out[-1].append(n)
        elif out[-1]:
            out.append([])
    return [x for x in out if x]


def column_islands(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    """Runs of columns that aren't empty throughout."""
    row = df.agg(*[F.max(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != "").alias(str(i)) for i, c in enumerate(columns)]).first()
    out: list[list[str]] = [[]]
    for i, c in enumerate(columns):
        if row[str(i)]:
            out[-1].append(c)
        elif out[-1]:
            out.append([])
    return [x for x in out if x]


def split_sheet(rows: list[list[str | None]]) -> list[list[list[str | None]]]:
    """Tables of a dictionary sheet (bounded by a workbook): parted by empty rows, then by empty columns."""
    blank = lambda v: v is None or not str(v).strip()
    width = max(map(len, rows), default=0)
    rows = [[*r, *[None] * (width - len(r))] for r in rows]
    bands: list[list] = [[]]
    for r in rows:
        if all(map(blank, r)):
            if bands[-1]:
                bands.append([])
        else:
            bands[-1].append(r)
    tables = []
    for band in (b for b in bands if b):
        run: list[int] = []
        for c in range(width + 1):
            if c < width and not all(blank(r[c]) for r in band):
                run.append(c)
            elif run:
                tables.append([[r[i] for i in run] for r in band])
                run = []
    return tables


def promote(spark: SparkSession, tables: list[list[list[str | None]]], sheet: str, source: str, marker: str = "ignore below") -> list[tuple[str, str, DataFrame]]:
    """(folder, name, table): the first row is the header; from a table that begins with the marker on, the folder is extras."""
    out, folder = [], ""
    for k, rows in enumerate(tables):
        if any(marker in str(v).lower() for v in rows[0] if v is not None):
            folder = "extras"
            rows = rows[1:]
        rows = [r for r in rows if any(v is not None and str(v).strip() for v in r)]
        if not rows:
            continue
        head = unique_names(rows[0])
        df = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows[1:]], T.StructType([T.StructField(h, T.StringType()) for h in head]))
        out.append((folder, f"{sheet}_table_{k + 1}", tagged(df, sheet, str(k + 1), source)))
    return out


def tagged(df: DataFrame, sheet: str, table: str, source: str) -> DataFrame:
    """Rows that aren't null throughout, with where they are from."""
    return df.dropna(how="all").withColumns({"__sheet__": F.lit(sheet), "__table__": F.lit(table), "__source_file__": F.lit(source)})


def label_descriptions(texts: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """key, variable and description of lines LABEL: description; texts with too few labels give none, the first of a label counts."""
    pattern = r"^\s*([A-Z][A-Z0-9_]{2,30})\s*:\s*(.{5,200}?)\s*$"
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("place", "line"))
    found = lines.select(key, "place", F.regexp_extract("line", pattern, 1).alias("variable"), F.regexp_extract("line", pattern, 2).alias("description")).filter("variable <> ''")
    first = found.groupBy(key, "variable").agg(F.min_by("description", "place").alias("description"))
    enough = first.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(key)
    return first.join(enough, key, "left_semi")


def merge_tiers(model: DataFrame, code: DataFrame, fields: Sequence[str], key: str = "variable") -> DataFrame:
    """Per variable the fields of the first source; the second fills gaps."""
    a, b = model.alias("a"), code.alias("b")
    pick = [F.coalesce(F.nullif(F.trim(F.col(f"a.{f}")), F.lit("")), F.col(f"b.{f}")).alias(f) for f in fields]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *pick)


def view_name(stem: str) -> str:
    return "df_" + re.sub(r"\W", "_", stem)


def expose(frames: dict[str, DataFrame]) -> list[str]:
    """Register tables as views df_<stem>; their names."""
    for stem, df in frames.items():
        df.createOrReplaceTempView(view_name(stem))
    return [view_name(s) for s in frames]


def flatten_forms(forms: DataFrame) -> DataFrame:
    """form_name, variable (null: the form itself) and text of each snippet."""
    whole = forms.select("form_name", F.lit(None).cast("string").alias("variable"), F.col("summary").alias("text"))
    each = forms.select("form_name", F.explode("variables").alias("variable", "v"))
    condition = F.when(F.col("v.condition").isNotNull(), F.concat(F.lit("Condition: "), F.col("v.condition")))
    parts = each.select("form_name", "variable", F.concat_ws("  ", F.col("v.description"), condition, F.col("v.section_context")).alias("text"))
    return whole.unionByName(parts).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
