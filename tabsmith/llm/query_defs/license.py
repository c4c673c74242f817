from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.llm import query
from tabsmith.llm.common import read_table
from tabsmith.llm.license import license_scan


@query("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    """License of every page, by its own notice or its site's directories; any page with a notice speaks for its directory."""
    pages = read_table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    return license_scan(pages.select("page_id", path.alias("path"), F.col("html").alias("text")), ["page_id"], licence_file=".*")
