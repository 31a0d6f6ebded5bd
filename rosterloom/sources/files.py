"""Readers of the domain's files, and writers of its tables."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATE = re.compile(r"(\d{4})[-_](\d{2})[-_](\d{2})|(\d{2})[-_](\d{2})[-_](\d{4})")


def file_date(name: str) -> str | None:
    """The date in a file name as YYYY-MM-DD; both year-first and year-last are known."""
    m = _DATE.search(name)
    if not m:
        return None
    return f"{m[1]}-{m[2]}-{m[3]}" if m[1] else f"{m[6]}-{m[4]}-{m[5]}"


def newest(names: Iterable[str], pattern: str) -> str:
    """The matching name with the latest date; one undated name is taken, several are an error."""
    found = [n for n in names if re.search(pattern, n)]
    dated = [(d, n) for n in found if (d := file_date(n))]
    if dated:
        return max(dated)[1]
    if len(found) == 1:
        return found[0]
    raise FileNotFoundError(f"no file matches {pattern}" if not found else f"several undated files match {pattern}: {sorted(found)}")


def newest_by_slug(names: Iterable[str], kind: str = "csv") -> dict[str, str]:
    """The latest file of every roster, named ``slug_date.kind``; undated and other names are left out."""
    found: dict[str, tuple[str, str]] = {}
    for n in names:
        m = _DATE.search(n)
        if m and n.endswith(f".{kind}") and (slug := n[: m.start()].rstrip("_-")):
            found[slug] = max(found.get(slug, ("", "")), (file_date(n), n))
    return {slug: n for slug, (_, n) in sorted(found.items())}


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """File names in a folder of any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def wide_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """All columns as strings."""
    return spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, multiLine=True, escape='"')


def _zip_rows(encoding: str, chunk: int = 10_000):
    """(file, place, cells) of the CSV members of ZIP files; a member is read row by row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns]):
                with zipfile.ZipFile(io.BytesIO(content)) as packed:
                    for member in sorted(n for n in packed.namelist() if n.lower().endswith(".csv")):
                        held, place = [], 0
                        with packed.open(member) as raw:
                            for cells in csv.reader(io.TextIOWrapper(raw, encoding, newline="")):
                                held.append((f"{path}/{member}", place, cells))
                                place += 1
                                if len(held) == chunk:
                                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), _ZIP_TYPES)], ["file", "place", "cells"])
                                    held = []
                        if held:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), _ZIP_TYPES)], ["file", "place", "cells"])

    return rows


_ZIP_TYPES = [pa.string(), pa.int64(), pa.list_(pa.string())]


def zipped_csv(spark: SparkSession, path: str, encoding: str = "latin-1") -> DataFrame:
    """All columns as strings, from the CSV members of the ZIP files at ``path`` (up to 2 GB each, one task a file).

    All members have the header of the first; empty cells are null.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = raw.mapInArrow(_zip_rows(encoding), "file string, place long, cells array<string>")
    first = rows.filter("place = 0").orderBy("file").first()
    header = first.cells if first else []
    return rows.filter("place > 0").select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(header)])


def by_state(spark: SparkSession, folder: str) -> DataFrame:
    """All per-state Parquet files of a folder as one table; ``state`` comes from the name (``.._NY.parquet``)."""
    df = spark.read.option("mergeSchema", True).parquet(f"{folder}/*_[A-Z][A-Z].parquet")
    return df.withColumn("state", F.regexp_extract("_metadata.file_path", r"_([A-Z]{2})\.parquet", 1))


def fetch(spark: SparkSession, folder: str, column: str, wanted: list[str]) -> DataFrame:
    """The rows of some partitions of a table written by ``column``; other partitions are not read, absent keys are no error."""
    return spark.read.parquet(folder).filter(F.col(column).cast("string").isin(*wanted))


def territories(spark: SparkSession, path: str) -> DataFrame:
    """(state, code, name, email) of a YAML file with ``people`` (code: {name: .., email: ..}) and ``territories`` (code: [states])."""
    body = spark.read.text(path, wholetext=True)
    section = lambda name: F.regexp_extract("value", rf"(?ms)^{name}:[^\n]*\n(.*?)(?=^\w|\z)", 1)
    each = lambda text, pattern, *n: F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"f{i}") for i in n])
    owned = body.select(F.explode(each(section("territories"), r"(?m)^ +(\w+): *\[([^\]]*)\]", 1, 2)).alias("x"))
    owned = owned.select(F.col("x.f1").alias("code"), F.explode(F.split("x.f2", r"\s*,\s*")).alias("state"))
    who = body.select(F.explode(each(section("people"), r"(?m)^ +(\w+): *\{ *name: *([^,}]*), *email: *([^,} ]*)", 1, 2, 3)).alias("x"))
    who = who.select(F.col("x.f1").alias("code"), F.trim("x.f2").alias("name"), F.col("x.f3").alias("email"))
    return owned.join(who, "code", "left").select(F.trim("state").alias("state"), "code", "name", "email")


def normal_header(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def by_header(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns by normalised header; of several sources the first that is filled. Unknown ones are null."""
    have = {normal_header(c): c for c in df.columns}
    out: list[Column] = []
    for name, sources in wanted.items():
        found = [F.col(f"`{have[normal_header(s)]}`") for s in sources if normal_header(s) in have]
        filled = [F.when((F.trim(c) != "") & (F.lower(F.trim(c)) != "nan"), F.trim(c)) for c in found]
        out.append((F.coalesce(*filled) if filled else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def rename(df: DataFrame, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(mapped columns under their own names, the key and all unmapped columns)."""
    mapped = df.select(*[F.col(f"`{raw}`").alias(new) for new, raw in names.items() if raw in df.columns])
    key = next(iter(names))
    rest = df.select(F.col(f"`{names[key]}`").alias(key), *[F.col(f"`{c}`") for c in df.columns if c not in names.values()])
    return mapped, rest


_TEXT = T.StringType()


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(f"_{n}", _TEXT) for n in names]


def _many(tag: str, *fields: T.StructField) -> T.StructType:
    return T.StructType([T.StructField(tag, T.ArrayType(T.StructType(list(fields))))])


#: The individual feed: attributes are strings, repeated elements are arrays even if they occur once.
INDIVIDUAL = T.StructType([
    T.StructField("Info", T.StructType(_fields("indvlPK", "firstNm", "midNm", "lastNm", "sufNm"))),
    T.StructField("OthrNms", _many("OthrNm", *_fields("firstNm", "midNm", "lastNm"))),
    T.StructField("CrntEmps", _many("CrntEmp", *_fields("orgPK", "orgNm", "city", "state", "postlCd"),
        T.StructField("CrntRgstns", _many("CrntRgstn", *_fields("regAuth", "regCat", "st", "stDt"))),
        T.StructField("BrnchOfLocs", _many("BrnchOfLoc", *_fields("str1", "str2", "city", "state", "postlCd", "cntry"))))),
    T.StructField("Exms", _many("Exm", *_fields("exmCd", "exmNm", "exmDt"))),
    T.StructField("PrevRgstns", _many("PrevRgstn", *_fields("orgPK", "orgNm", "regBeginDt", "regEndDt"))),
    T.StructField("EmpHss", _many("EmpHs", *_fields("orgNm", "city", "state", "fromDt", "toDt"))),
    T.StructField("OthrBuss", _many("OthrBus", *_fields("desc"))),
])


def individuals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "Indvl").schema(INDIVIDUAL).load(path)


def individual_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """advisors, employments, branches, history, exams, other_business, prior_registrations."""
    crd = F.col("Info._indvlPK").alias("advisor_crd")
    each = lambda path: raw.select(crd, F.explode(path).alias("x"))
    used = F.try_element_at(F.filter("OthrNms.OthrNm", lambda n: (n["_lastNm"] == F.col("Info._lastNm")) & (n["_firstNm"] != F.col("Info._firstNm"))), F.lit(1))
    count = lambda path: F.coalesce(F.size(path), F.lit(0)).alias
    emps = each("CrntEmps.CrntEmp")
    sets = lambda f: F.array_join(F.array_sort(F.array_distinct(F.col(f"x.CrntRgstns.CrntRgstn.{f}"))), "|")
    branches = emps.select("advisor_crd", F.col("x._orgPK").alias("firm_crd"), F.explode("x.BrnchOfLocs.BrnchOfLoc").alias("b"))
    return {
        "advisors": raw.select(crd, F.col("Info._firstNm").alias("first_name"), F.col("Info._lastNm").alias("last_name"), used["_firstNm"].alias("used_first_name"), count("Exms.Exm")("n_exams")),
        "employments": emps.select("advisor_crd", F.col("x._orgPK").alias("firm_crd"), F.col("x._city").alias("emp_city"), F.col("x._state").alias("emp_state"), sets("_regCat").alias("reg_categories"), sets("_regAuth").alias("reg_states"), F.array_min("x.CrntRgstns.CrntRgstn._stDt").alias("reg_earliest_date")),
        "branches": branches.select("advisor_crd", "firm_crd", *[F.col(f"b._{a}").alias(n) for a, n in (("str1", "branch_street1"), ("str2", "branch_street2"), ("city", "branch_city"), ("state", "branch_state"), ("postlCd", "branch_postal"), ("cntry", "branch_country"))]).filter("branch_state is not null").distinct(),
        "history": each("EmpHss.EmpHs").select("advisor_crd", F.col("x._orgNm").alias("firm_name_on_record"), F.col("x._city").alias("city"), F.col("x._state").alias("state"), F.col("x._fromDt").alias("from_date"), F.col("x._toDt").alias("to_date")),
        "exams": each("Exms.Exm").select("advisor_crd", F.col("x._exmCd").alias("exam_code"), F.col("x._exmNm").alias("exam_name"), F.col("x._exmDt").alias("exam_date")),
        "other_business": each("OthrBuss.OthrBus").select("advisor_crd", F.col("x._desc").alias("description")),
        "prior_registrations": each("PrevRgstns.PrevRgstn").select("advisor_crd", F.col("x._orgPK").alias("firm_crd"), F.col("x._orgNm").alias("firm_name_on_record"), F.col("x._regBeginDt").alias("reg_begin"), F.col("x._regEndDt").alias("reg_end")),
    }


FIRM = T.StructType([
    T.StructField("Info", T.StructType(_fields("FirmCrdNb", "BusNm"))),
    T.StructField("StateRgstn", T.StructType([T.StructField("Rgltrs", _many("Rgltr", *_fields("Cd", "St", "Dt")))])),
    T.StructField("WebAddrs", T.StructType([T.StructField("WebAddr", T.ArrayType(_TEXT))])),
])
#: Hosts that are no firm's own site.
SOCIAL = ["facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com"]


def firm_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    raw = spark.read.format("xml").option("rowTag", "Firm").schema(FIRM).load(path)
    crd = F.col("Info._FirmCrdNb").alias("firm_crd")
    sites = raw.select(crd, F.posexplode("WebAddrs.WebAddr").alias("pos", "url"))
    social = F.lower("url").rlike("|".join(rf"(^|[/.]){re.escape(s)}" for s in SOCIAL))
    return {
        "state_registrations": raw.select(crd, F.explode("StateRgstn.Rgltrs.Rgltr").alias("x")).select("firm_crd", F.col("x._Cd").alias("regulator"), F.col("x._St").alias("status"), F.col("x._Dt").alias("date")).distinct(),
        "websites": sites.withColumn("is_social", social),
    }


def primary_website(sites: DataFrame) -> DataFrame:
    """Per firm: the first own site (else the first), and how many of each kind."""
    return sites.groupBy("firm_crd").agg(F.min_by("url", F.struct("is_social", "pos")).alias("url"), F.count("*").alias("sites"), F.count_if("is_social").alias("social"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def slots(df: DataFrame, key: str, fields: str, names: list[list[str]]) -> DataFrame:
    """Repeated groups of custom fields as rows: ``names`` holds the field names of each slot."""
    groups = [F.struct(F.lit(i + 1).alias("slot"), *[F.nullif(F.trim(F.element_at(fields, F.lit(n))), F.lit("")).alias(f"f{j}") for j, n in enumerate(ns)]) for i, ns in enumerate(names)]
    out = df.select(key, F.explode(F.array(*groups)).alias("s")).select(key, "s.*")
    return out.filter(F.coalesce(*[F.col(f"f{j}") for j in range(len(names[0]))]).isNotNull())


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet", partition: dict[str, str] | None = None) -> None:
    """Every table of the list; some partitioned by a column, their old partitions replaced."""
    for name, df in tables.items():
        w = df.write.mode("overwrite").format(kind).option("header", True).option("partitionOverwriteMode", "dynamic")
        (w.partitionBy(partition[name]) if partition and name in partition else w).save(f"{folder}/{name}")


def write_shards(df: DataFrame, key: str, folder: str) -> None:
    """A folder for each last two characters of the key."""
    df.withColumn("shard", F.lpad(F.right(F.col(key).cast("string"), F.lit(2)), 2, "0")).write.mode("overwrite").partitionBy("shard").parquet(folder)


def write_export(df: DataFrame, path: str, provenance: str) -> None:
    """A CSV with formula leaders neutralised and the provenance in a column of its own.

    Every file begins with a byte order mark, by which spreadsheets know UTF-8.
    """
    from ..functions.text import csv_guard

    cells = [(csv_guard(F.col(c)) if t == "string" else F.col(c)).alias(("\ufeff" if i == 0 else "") + c) for i, (c, t) in enumerate(df.dtypes)]
    df.select(*cells, F.lit(provenance).alias("provenance")).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def write_name_shards(index: DataFrame, folder: str) -> None:
    """A folder for each prefix of a name index, rebuilt as a whole."""
    index.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(folder)


def rankings(spark: SparkSession, path: str) -> DataFrame:
    """Ranking rows of a JSON list with their details as columns; the scope says what a rank counts in."""
    from ..operators.rosters import detail_columns

    raw = json_array(spark, path, "ranking string, year int, state string, rank int, advisor string, firm string, location string, crd string, detail map<string,string>")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return raw.select(
        "ranking", "year", blank("state").alias("rank_state"), "rank", F.col("advisor").alias("advisor_name"), F.col("firm").alias("firm_name"), "location", blank("crd").alias("advisor_crd"),
        F.when(F.col("ranking") == "top1500", "state").otherwise("national").alias("rank_scope"), *[c.alias(n) for n, c in detail_columns(F.col("detail")).items()],
    )


def write_sized(df: DataFrame, key: str, folder: str, target_bytes: int = 12_000_000) -> list[str]:
    """JSON shards of about ``target_bytes`` in order of the key, and a manifest beside them; gives the shard names.

    The size is that of the rows as JSON, not their number.
    """
    rows = df.select(F.col(key).alias("__key"), F.to_json(F.struct(*df.columns)).alias("value"))
    size = rows.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    count = max(1, -(-size // target_bytes))
    rows.repartitionByRange(count, "__key").sortWithinPartitions("__key").select("value").write.mode("overwrite").text(f"{folder}/shards")
    names = [n for n in list_names(df.sparkSession, f"{folder}/shards") if n.startswith("part-")]
    df.sparkSession.createDataFrame([(n,) for n in names], "shard string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return names


def write_team_shards(teams: DataFrame, members: DataFrame, team: str, state: str, folder: str) -> None:
    """A folder for each state with the teams that have a member there; a team of two states is in both."""
    where = members.filter(F.col(state).isNotNull()).select(team, F.col(state).alias("shard")).distinct()
    teams.join(where, team).write.mode("overwrite").partitionBy("shard").parquet(folder)
