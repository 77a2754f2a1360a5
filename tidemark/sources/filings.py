"""Bulk filing feed: zipped JSON per filer, columnar arrays to rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Forms that the feed keeps.
FORMS = (
    "8-K", "8-K/A", "10-K", "10-Q", "PREM14A", "DEFM14A", "SC 14D9", "SC14D9C", "SC 13E3",
    "SC TO-T", "25-NSE", "15-12B",
)
BLOCK = "struct<accessionNumber:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,form:array<string>,items:array<string>>"
FILER = f"cik string, name string, entityType string, sic string, tickers array<string>, exchanges array<string>, formerNames array<struct<name:string>>, filings struct<recent:{BLOCK}>"
_MEMBER = re.compile(r"CIK(\d{10})(-submissions-\d+)?\.json$")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(member, cik, body) of the ``CIK*.json`` members of zip archives.

    Archives come through Spark's binary reader, so any store works; one
    archive is one task, thus large feeds should come as several archives.
    """
    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if m := _MEMBER.search(name):
                            yield pd.DataFrame({"member": [name], "cik": [int(m[1])], "body": [z.read(name).decode("utf-8")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "member string, cik long, body string")


def _unnest(rows: DataFrame, block: str, src: str) -> DataFrame:
    b = F.col(block)
    zipped = F.arrays_zip(b.accessionNumber, b.filingDate, b.acceptanceDateTime, b.form, b["items"])
    r = rows.select("cik", F.explode(zipped).alias("z"))
    fields = [F.col("z").getField(n) for n in ("accessionNumber", "filingDate", "acceptanceDateTime", "form", "items")]
    accession, filed, accepted, form, items = fields
    stamp = F.replace(F.replace(accepted, F.lit("T"), F.lit(" ")), F.lit(".000Z"), F.lit("")).try_cast("timestamp_ntz")
    out = r.where(form.isin(*FORMS))
    return out.select("cik", accession.alias("accession"), filed.try_cast("date").alias("filing_date"), stamp.alias("accepted_json"), form.alias("form"), F.coalesce(items, F.lit("")).alias("items"), F.lit(src).alias("src"))


def load_feed(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, filings): main files give a company row and its recent
    filings, continuation files only filings. Forms are filtered at once."""
    main = members.where(~F.col("member").contains("-submissions-")).select("cik", F.from_json("body", FILER).alias("p"))
    more = members.where(F.col("member").contains("-submissions-")).select("cik", F.from_json("body", BLOCK).alias("p"))
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|", "")
    companies = main.select("cik", F.col("p.name").alias("name"), F.col("p.entityType").alias("entity_type"), F.col("p.sic").alias("sic"), joined(F.col("p.tickers")).alias("tickers"), joined(F.col("p.exchanges")).alias("exchanges"), joined(F.col("p.formerNames.name")).alias("former_names"))
    recent = main.select("cik", F.col("p.filings.recent").alias("b"))
    filings = _unnest(recent, "b", "recent").unionByName(_unnest(more.withColumnRenamed("p", "b"), "b", "file"))
    return companies, filings.distinct()


def pages_covering(pages: DataFrame, day: str) -> DataFrame:
    """Continuation pages (path, filing_from, filing_to) whose dates cover a day."""
    d = F.lit(day).cast("date")
    return pages.where((F.col("filing_from") <= d) & (F.col("filing_to") >= d))
