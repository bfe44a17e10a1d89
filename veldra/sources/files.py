"""Readers and writers of files.  S1 to S6, S10 to S16, S29, S30, S35, S37, K12."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions.text import clean, format_salary, markdown_field, markdown_url, trim, tsv_field

#: S3: columns that come first.
PREFERRED = ["market", "company", "title", "location", "employmentType", "publishedAt", "source", "applyUrl", "jobDetailUrl", "jobListUrl", "campaignLandingUrl", "companyCareerHomeUrl", "sourceUrl", "applicationActive", "discoveredAt"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON document (a list, or an object with companies, records or candidates), of JSON lines or of
    CSV, by the name's ending."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
        return df.toDF(*(c.strip() for c in df.columns))
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(path)
    df = spark.read.option("multiLine", True).json(path)
    for name in ("companies", "records", "candidates"):
        if name in df.columns:
            rows = df.select(F.explode(name).alias("_r"), *(["market"] if "market" in df.columns and name == "companies" else [])).select("_r.*", *([F.col("market").alias("_m")] if "market" in df.columns and name == "companies" else []))
            if "_m" in rows.columns:
                own = F.nullif(F.col("market"), F.lit("")) if "market" in rows.columns else F.lit(None).cast("string")
                rows = rows.withColumn("market", F.coalesce(own, "_m", F.lit(""))).drop("_m")
            return rows
    return df


def ordered(records: DataFrame) -> DataFrame:
    """S3: the preferred columns first."""
    first = [c for c in PREFERRED if c in records.columns]
    return records.select(*first, *(c for c in records.columns if c not in first))


def as_text(records: DataFrame) -> DataFrame:
    """S3: nested values as JSON, null as empty."""
    nested = ("struct", "array", "map")
    return ordered(records).select(*(F.coalesce(F.to_json(c) if t.startswith(nested) else F.col(c).cast("string"), F.lit("")).alias(c) for c, t in ordered(records).dtypes))


def write_records(records: DataFrame, path: str, kind: str) -> None:
    """A folder of files of a kind: json, jsonl or csv."""
    if kind == "csv":
        as_text(records).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        ordered(records).write.mode("overwrite").json(path)


def student_rows(records: DataFrame) -> DataFrame:
    """The eight columns of the workbook."""
    date = lambda *cs: F.coalesce(*(F.date_format(F.try_to_timestamp(F.col(c)), "yyyy-MM-dd") for c in cs))
    text = lambda c: clean(F.col(c))
    return records.select(text("company").alias("公司"), text("companyType").alias("公司类型"), text("batch").alias("招聘批次"), text("title").alias("岗位"), text("location").alias("地点"), F.coalesce(date("publishedAt"), F.lit("未披露")).alias("发布时间"), F.coalesce(date("closesAt"), F.when(text("deadlineType") == "until_filled", "招满即止"), F.lit("未披露")).alias("截止时间"), hyperlink(F.col("url"), F.lit("查看岗位并投递")).alias("投递链接"))


def hyperlink(url: Column, label: Column) -> Column:
    """A formula that links, or shows the label where links don't work; empty without url."""
    q = lambda x: F.replace(x, F.lit('"'), F.lit('""'))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(F.lit('=IFERROR(HYPERLINK("'), q(url), F.lit('","'), q(label), F.lit('"),"'), q(label), F.lit('")')))


def _cells(n: int, values: Sequence) -> str:
    def column(k: int) -> str:
        out = ""
        while k >= 0:
            out, k = chr(65 + k % 26) + out, k // 26 - 1
        return out

    cells = []
    for k, v in enumerate(values):
        ref, v = f"{column(k)}{n}", "" if v is None else str(v)
        cells.append(f'<c r="{ref}"><f>{escape(v[1:])}</f></c>' if v.startswith("=IFERROR(HYPERLINK(") else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
    return f'<row r="{n}">{"".join(cells)}</row>'


def write_workbook(rows: DataFrame, file: str, sheet: str = "投递清单") -> int:
    """A workbook of one sheet; rows come to the driver partition by partition and go straight to the file.
    Returns their number.  A sheet holds 1,048,576 rows, which is what bounds it."""
    n = 1
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        z.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", head + f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write((head + '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + _cells(1, rows.columns)).encode())
            for row in rows.toLocalIterator():
                n += 1
                if n > 1_048_576:
                    raise ValueError("a sheet holds 1,048,576 rows; split the table")
                out.write(_cells(n, row).encode())
            out.write(b"</sheetData></worksheet>")
    return n - 1


#: Columns of the scan history.
HISTORY = "url string, first_seen string, portal string, title string, company string, status string, location string, fingerprint string, posted string"


def history_rows(offers: DataFrame, date: str, status: str = "added") -> DataFrame:
    """Rows for the scan history, safe in a spreadsheet."""
    day = F.when(F.col("posted_at") > 0, F.date_format(F.timestamp_millis("posted_at"), "yyyy-MM-dd")).otherwise("")
    columns = {"url": F.col("url"), "first_seen": F.lit(date), "portal": F.col("source"), "title": F.col("title"), "company": F.col("company"), "status": F.lit(status), "location": F.col("location"), "fingerprint": F.col("fingerprint"), "posted": day}
    return offers.select(*(tsv_field(c).alias(n) for n, c in columns.items()))


def append_history(rows: DataFrame, path: str) -> None:
    """S10"""
    rows.write.mode("append").option("sep", "\t").option("emptyValue", "").csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """S14, K12"""
    return spark.read.schema(HISTORY).option("sep", "\t").csv(path)


def pipeline_lines(offers: DataFrame) -> DataFrame:
    """A checklist line for each offer (url, company, title, location, salary, posted_at, note)."""
    base = F.concat(F.lit("- [ ] "), markdown_url(F.col("url")), F.lit(" | "), markdown_field(F.col("company")), F.lit(" | "), markdown_field(F.col("title")))
    pay, place, note = F.coalesce(format_salary(F.col("salary")), F.lit("")), markdown_field(F.col("location")), markdown_field(F.col("note"))
    more = F.when(pay != "", F.concat(F.lit(" | "), place, F.lit(" | "), pay)).when(place != "", F.concat(F.lit(" | "), place)).otherwise("")
    posted = F.when(F.col("posted_at") > 0, F.concat(F.lit(" | posted: "), F.date_format(F.timestamp_millis("posted_at"), "yyyy-MM-dd"))).otherwise("")
    return offers.select(F.concat(base, more, posted, F.when(note != "", F.concat(F.lit(" | note: "), note)).otherwise("")).alias("value"))


def pending(spark: SparkSession, path: str) -> DataFrame:
    """(url, company, title) of the open lines of a checklist."""
    p = r"^- \[ \] (\S+) \| ([^|]*) \| ([^|]*)"
    lines = spark.read.text(path).where(F.col("value").rlike(p))
    return lines.select(*(F.trim(F.regexp_extract("value", p, i)).alias(n) for i, n in ((1, "url"), (2, "company"), (3, "title"))))


def seen_urls(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """Addresses in checklists and trackers."""
    found = F.regexp_extract_all("value", F.lit(r"(https?://[^\s|)]+)"), F.lit(1))
    return spark.read.text(list(texts)).select(F.explode(found).alias("url")).distinct()


#: S13 (Q8): headings of a tracker's columns.
HEADINGS = {"#": "num", "num": "num", "date": "date", "company": "company", "role": "role", "title": "role", "score": "score", "status": "status", "pdf": "pdf", "report": "report", "notes": "notes", "location": "location", "via": "via"}
LEGACY = {"num": 1, "date": 2, "company": 3, "role": 4, "score": 5, "status": 6, "pdf": 7, "report": 8, "notes": 9}


def tracker_columns(lines: Sequence[str]) -> dict[str, int]:
    """Places of the columns by the first heading row, or the old ones."""
    for line in lines:
        if line.startswith("|"):
            cells = [c.strip().lower() for c in line.split("|")]
            found = {HEADINGS[c]: i for i, c in enumerate(cells) if c in HEADINGS}
            if {"num", "company", "role", "score", "status"} <= found.keys():
                return found
    return LEGACY


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Markdown table; a score that stands in the status' place is put right."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("|")))
    head = [r["value"] for r in lines.where(F.lower("value").contains("company") & F.lower("value").contains("role")).limit(5).collect()]
    at = tracker_columns(head)
    cells = F.transform(F.split("value", r"\|"), trim)
    get = lambda k: F.coalesce(F.get(cells, F.lit(at[k])), F.lit("")) if k in at else F.lit("")
    rows = lines.where(F.get(cells, F.lit(at["num"])).try_cast("int").isNotNull()).where(F.size(cells) > max(at.values()))
    is_score = lambda x: F.replace(x, F.lit("**"), F.lit("")).rlike(r"^(?:\d+(?:\.\d+)?/5|N/A|DUP)$")
    a, b = get("score"), get("status")
    swap = ~is_score(a) & is_score(b)
    return rows.select(get("num").cast("int").alias("num"), *(get(k).alias(k) for k in ("date", "company", "role")), F.when(swap, b).otherwise(a).alias("score"), F.when(swap, a).otherwise(b).alias("status"), *(get(k).alias(k) for k in ("pdf", "report", "notes", "location", "via")))


def last_json_line(lines: DataFrame) -> DataFrame:
    """Of lines (pos, value) the last that is JSON."""
    return lines.where(F.try_parse_json("value").isNotNull() & F.startswith(F.trim("value"), F.lit("{"))).agg(F.max_by("value", "pos").alias("value"))


def directory_companies(files: DataFrame, pattern: str = r"^[a-z0-9][a-z0-9._-]*$") -> DataFrame:
    """Valid, distinct slugs of a directory's files (content: a base64 text of a JSON list)."""
    text = F.decode(F.unbase64(F.regexp_replace(F.get_json_object("payload", "$.content"), r"\s", "")), "UTF-8")
    slugs = F.explode(F.from_json(F.coalesce(text, F.col("payload")), "array<string>")).alias("slug")
    return files.select(slugs).select(F.lower(F.trim("slug")).alias("slug")).where(F.col("slug").rlike(pattern)).distinct()


def seed_companies(payloads: DataFrame) -> DataFrame:
    """(slug, name, website) of portfolio companies (seq, payload: a JSON list), the first of each slug."""
    from veldra.operators.pick import first_by

    items = payloads.select("seq", F.posexplode(F.from_json("payload", "array<struct<name:string,slug:string,website:string>>")).alias("pos", "c"))
    rows = items.select("seq", "pos", F.lower(F.trim("c.slug")).alias("slug"), trim(F.col("c.name")).alias("name"), F.col("c.website").alias("website")).where(F.col("slug").rlike(r"^[a-z0-9][a-z0-9-]*$"))
    return first_by(rows, ["slug"], F.col("seq"), F.col("pos")).drop("seq", "pos")


def digest_lines(digest: DataFrame) -> Iterator[str]:
    """A digest (section, project_id, company, deadline) as Markdown lines, section by section."""
    section = None
    for r in digest.orderBy("section", "company", "project_id").toLocalIterator():
        if r["section"] != section:
            section = r["section"]
            yield f"## {section}"
        yield f"- {r['company']}｜{r['project_id']}｜{r['deadline'] or '待确认'}"


#: Columns of the scan runs' table.
RUN_COLUMNS = ["companies", "boards", "found", "title", "tier", "location", "age", "salary", "content", "cooldown", "seen", "added", "errors"]


def run_summary(staged: DataFrame, timestamp: str, companies: int, boards: int, errors: int = 0) -> DataFrame:
    """One row of counters of a scan, from its postings' stages."""
    n = {c: F.count_if(F.col("stage") == c) for c in RUN_COLUMNS if c not in ("companies", "boards", "found", "seen", "errors")}
    n |= {"companies": F.lit(companies), "boards": F.lit(boards), "found": F.count("*"), "seen": F.count_if(F.col("stage").isin("seen_url", "seen_role")), "errors": F.lit(errors)}
    return staged.agg(*(n[c].alias(c) for c in RUN_COLUMNS)).select(F.lit(timestamp).alias("timestamp"), F.lit("completed").alias("status"), *RUN_COLUMNS)


def append_runs(summary: DataFrame, path: str) -> None:
    """Append-only."""
    summary.write.mode("append").option("sep", "\t").option("header", True).csv(path)
